"""Words, tables and row marks that the operators of this subpackage share."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylog.session import checkpointed as stored  # noqa: F401

#: Fixed patterns: a word, and the white space between words.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

ROW = "_row"
LAST = (1 << 63) - 1
LEAST_SPLITS = 64


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, where null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def word_count(column: str = "text") -> Column:
    return F.regexp_count(whole_text(column), F.lit(WORD)).cast("long")


def with_rows(docs: DataFrame) -> DataFrame:
    """Docs with a number per row.

    The number is the same whenever the same files are scanned with the same
    settings, so a decision made on a narrow copy can be joined to the whole rows. How
    files are split must not depend on the executors there are at the time, so the
    session's least number of splits is fixed unless it is set.
    """
    spark = docs.sparkSession
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(LEAST_SPLITS))
    return docs.withColumn(ROW, F.monotonically_increasing_id())


def keep_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The docs whose row number is in ``rows``; ``docs`` must be a table scan.

    The columns go along in a struct, so their names can't clash.
    """
    whole = with_rows(docs.select(F.struct("*").alias("doc")))
    return whole.join(rows.select(ROW), ROW, "left_semi").select("doc.*")


def held_out(column: str = "doc_id") -> Column:
    """Rows that no label may be learned from: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, most: dict[int, int], seed: int = 11) -> DataFrame:
    """``doc_id, label, n_class``: at most ``most[c]`` labelled ids of each class, none held out.

    ``n_class`` is the number of all such ids of the class. The choice is by hash, and the
    result has at most the sum of ``most`` rows.
    """
    rows = (
        labels.where(~held_out())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    )
    parts = []
    for value, limit in most.items():
        own = rows.where(F.col("label") == value)
        chosen = own.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(limit)
        parts.append(chosen.withColumn("n_class", F.lit(own.count()).cast("long")))
    sample = parts[0]
    for part in parts[1:]:
        sample = sample.union(part)
    return sample


_SPACE_AT = re.compile(r"[\x20\x09-\x0D]")


def text_pieces(text: str, size: int = 1 << 20):
    """The text in parts of about ``size`` characters, cut at the first white space of any kind after that."""
    start = 0
    while len(text) - start > 2 * size:
        cut = _SPACE_AT.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]
