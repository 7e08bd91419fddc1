"""Mixing sources to target weights.

Words are summed per source, targets are set by weight under a cap, and the repetition
rate of a source is its target over its size. Each document is taken floor(rate) times,
and once more with probability equal to the fraction, drawn from a hash of seed and id.

Defined cases: a null text has size 0; a null source is a source of its own, last in
order; a null id draws as the text "null"; rows that repeat an id draw alike; a source of
size 0 has target 0 and is not taken; a very long text is counted as one value; extra columns, whatever
their names, don't matter to ``mix`` and go along in ``emit``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallylog.llm.common import ROW, stored, with_rows, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2
SEED = 7
#: Rates of up to so many sources are broadcast (about 1 MB); beyond it they are joined by shuffle.
BROADCAST_SOURCES = 10_000


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """Targets per source, from ``source`` and ``source_size`` (one row each).

    Sources are ranked in code point order, null last: they are range-partitioned, and each
    partition adds the number of sources before it, so no task holds all of them. Resharing
    repeats until no source is above its cap; only two sums per round reach the driver.
    """
    order = F.col("source").asc_nulls_last()
    placed = stored(
        sizes.repartitionByRange(order).withColumn("part", F.spark_partition_id())
    )
    parts = placed.groupBy("part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("part", before.alias("before"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = stored(
        placed.join(offsets, "part").select(
            "source", "source_size", weight.alias("weight"), (F.col("source_size") * float(most)).alias("most")
        )
    )
    whole = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    goal, rest, free = share * (whole[0] or 0), share * (whole[0] or 0), whole[1] or 0.0
    level = rest / free if free else 0.0
    while True:
        above = F.col("most") <= F.col("weight") * F.lit(level)
        sums = ranked.agg(
            F.sum(F.when(above, F.col("most"))), F.sum(F.when(~above, F.col("weight")))
        ).first()
        rest, still = goal - (sums[0] or 0.0), sums[1] or 0.0
        if still == free or not still:
            break
        free, level = still, rest / still
    target = F.least(F.col("most"), F.col("weight") * F.lit(level))
    return ranked.select("source", "source_size", target.alias("target"))


def draw(seed: int = SEED):
    """Number in [0, 1) from 52 bits of a hash of seed and id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(1 << 52)


def mix(docs: DataFrame, seed: int = SEED, **shares) -> DataFrame:
    """One row per document: row number, doc_id, size, source_size, target, copies, taken.

    Only ids, sources and sizes are stored and joined; a hot source is summed per task first.
    """
    sized = stored(with_rows(docs.select("doc_id", "source", "text")).select(ROW, "doc_id", "source", word_count().alias("size")))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(sizes, **shares)).withColumnRenamed("source", "of_source")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = (F.floor(rate) + (draw(seed) < rate - F.floor(rate)).cast("int")).cast("long")
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col("of_source")))
    return joined.select(ROW, "doc_id", "size", "source_size", "target", copies.alias("copies")).withColumn(
        "taken", F.col("size") * F.col("copies")
    )


def emit(docs: DataFrame, seed: int = SEED, **shares) -> DataFrame:
    """The mix itself: each document as often as it is taken; ``docs`` must be a table scan."""
    chosen = mix(docs, seed, **shares).where("copies > 0").select(ROW, F.col("copies").alias("_copies"))
    rows = with_rows(docs.select(F.struct("*").alias("doc"))).join(chosen, ROW)
    return rows.select("doc", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("doc.*")


#: DuckDB SQL of mix() with the standard parameters, without the row number.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight
  FROM d GROUP BY source
), f AS (
  SELECT *, 2.0 * source_size AS most,
         (SELECT CAST(1.5 AS DOUBLE) * sum(source_size) FROM s)
           - coalesce(sum(2.0 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
  FROM s WINDOW o AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST)
), t AS (
  SELECT source, source_size, CAST(least(most, weight * (SELECT coalesce(
           arg_min(CAST(rest AS DOUBLE) / free, most / weight) FILTER (most > weight * (CAST(rest AS DOUBLE) / free)), 0) FROM f)) AS DOUBLE) AS target
  FROM f
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         CAST(('0x' || substr(md5('7:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT)
           / 4503599627370496.0 AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies,
       CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
