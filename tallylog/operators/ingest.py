"""Row-shaping steps between a valid entry and the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallylog.functions.ids import partition_name, uuid_from


def unnest(arrays: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """Parallel arrays to rows; shorter arrays are filled up with NULLs."""
    zipped = F.explode(F.arrays_zip(*columns)).alias("row")
    return arrays.select(*keep, zipped).select(*keep, "row.*")


def with_defaults(rows: DataFrame, key: list[str], now: Column | None = None) -> DataFrame:
    """Fill in ``id``, ``attributes`` and ``ingested_at`` where the row has none.

    The id comes from the row's ``key``, not from a random source, so that a
    task that runs twice gives the same rows.
    """

    def given(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in rows.columns else default

    empty = F.expr("cast(map() as map<string,string>)")
    return rows.withColumns(
        {
            "id": given("id", uuid_from(*(F.col(k) for k in key))),
            "attributes": given("attributes", F.lit("{}")),
            "attr": given("attr", empty),
            "ingested_at": given("ingested_at", now if now is not None else F.current_timestamp()),
        }
    )


def with_day(rows: DataFrame) -> DataFrame:
    """Add the partition each row belongs to: its UTC day."""
    return rows.withColumn("day", F.to_date("ts"))


def with_partition_name(rows: DataFrame) -> DataFrame:
    return rows.withColumn("partition_name", partition_name(F.col("day")))


def insert_if_absent(
    new: DataFrame, existing: DataFrame, keys: list[str], order: list[Column] | None = None
) -> DataFrame:
    """Rows of ``new`` whose key ``existing`` does not hold, one per key.

    Of several new rows with one key the first in ``order`` is taken, or any if
    no order is given. Both sides are reduced to one row per key before they
    meet, so a key that many rows share costs the join one row.
    """
    if order is None:
        single = new.dropDuplicates(keys)
    else:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        single = new.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")
    return single.join(existing.select(*keys).distinct(), keys, "left_anti")
