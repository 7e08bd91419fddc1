"""Exact deduplication against a persistent digest index.

The index is a table of digests, bucketed and sorted by digest. A batch is reduced to
one row per digest, anti-joined with the index by sort-merge (the index side is read
bucket by bucket, without a shuffle), and what is new is appended. Texts are equal when
they are identical after each run of white space becomes one space.

Defined cases: a null text counts as empty; a group of null ids only keeps one row with
a null ``keep_id``; of rows that repeat id and text exactly one is kept; a text that an
earlier load holds is dropped in favour of that load's row; an empty table gives an empty
result; a very long text is normalised and hashed as one value; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylog.llm.common import LAST, ROW, SPACE, stored, whole_text, with_rows

BUCKETS = 64


class DigestIndex:
    """Digests seen so far: ``digest``, ``keep_id`` and the ``load`` that brought them.

    ``buckets`` is fixed when the table is made: about one per 100 million digests, and
    at least as many as there are cores. One writer at a time.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int = BUCKETS):
        self.spark, self.name, self.buckets = spark, name, buckets

    def create(self) -> DigestIndex:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, load STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS"
        )
        return self

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, firsts: DataFrame) -> DataFrame:
        """Rows of ``firsts`` whose digest is not in the index."""
        return firsts.repartition(self.buckets, "digest").join(
            self.table().select("digest").hint("merge"), "digest", "left_anti"
        )

    def append(self, firsts: DataFrame, load: str) -> None:
        """Add one row per digest; each bucket gets one sorted file."""
        rows = firsts.select("digest", "keep_id", F.lit(load).alias("load"))
        rows.repartition(self.buckets, "digest").write.bucketBy(self.buckets, "digest").sortBy("digest").mode(
            "append"
        ).format("parquet").saveAsTable(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def digests(docs: DataFrame) -> DataFrame:
    """Row number, id and digest of each normalised text."""
    normal = F.regexp_replace(whole_text(), SPACE, " ")
    return with_rows(docs.select("doc_id", "text")).select(
        ROW, F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(normal, 256)).alias("digest")
    )


def deduplicate(docs: DataFrame, index: DigestIndex, load: str) -> DataFrame:
    """One row per document: row number, doc_id, keep_id, group_size, kept, text_sha256.

    What is new is appended to the index under ``load``. The texts are read once: only
    ids and digests are stored, shuffled and joined. The last join is on a key of its own
    (the digest as text), so that both sides are shuffled for it and a digest with very
    many rows is split over tasks at run time.
    """
    keyed = stored(digests(docs))
    firsts = stored(
        keyed.groupBy("digest").agg(
            F.min("doc_id").alias("keep_id"),
            F.min_by(ROW, F.coalesce("doc_id", F.lit(LAST))).alias("keep_row"),
            F.count(F.lit(1)).alias("group_size"),
        )
    )
    index.append(stored(index.unseen(firsts)), load)
    seen = index.table().select("digest", F.col("keep_id").alias("indexed_id"), "load").hint("merge")
    keepers = firsts.join(seen, "digest").select(
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.when(F.col("load") == load, F.col("keep_row")).alias("keep_row"),
        F.col("indexed_id").alias("keep_id"),
        "group_size",
    )
    rows = keyed.select(ROW, "doc_id", F.lower(F.hex("digest")).alias("text_sha256"))
    return rows.join(keepers, "text_sha256").select(
        ROW,
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col(ROW) == F.col("keep_row"), F.lit(False)).alias("kept"),
        "text_sha256",
    )


#: DuckDB SQL of the result over an empty index, without the row number.
SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM {docs}
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
