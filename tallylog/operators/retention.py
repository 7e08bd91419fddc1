"""Expiry of whole days."""

from __future__ import annotations

import logging
from datetime import date
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylog.functions.ids import partition_name
from tallylog.model import RETENTION_DAYS
from tallylog.sources.log_table import LogTable, RejectTable

# Days named in one statement; producers decide how many days there are.
DROPPED_AT_ONCE = 100

_log = logging.getLogger(__name__)


def partition_inventory(logs: DataFrame) -> DataFrame:
    """Each day's name and range, with its row count and first and last time."""
    daily = logs.groupBy("day").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("ts").alias("min_ts"),
        F.max("ts").alias("max_ts"),
    )
    return daily.select(
        partition_name(F.col("day")).alias("partition_name"),
        F.col("day").alias("range_start"),
        F.date_add("day", 1).alias("range_end"),
        "rows",
        "min_ts",
        "max_ts",
    )


def expired(partitions: DataFrame, as_of: date, days: int = RETENTION_DAYS) -> DataFrame:
    """Partitions that ended on or before the day ``days`` before ``as_of``."""
    cutoff = F.date_sub(F.lit(as_of), days)
    return partitions.where(F.col("range_end") <= cutoff)


def drop_expired(table: LogTable | RejectTable, as_of: date, days: int = RETENTION_DAYS) -> list[str]:
    """Drop expired days and return their names, oldest first.

    Works on the catalog's list of days; the files go with the partition and no
    row is read.
    """
    dropped = []
    with table.lease():
        gone = expired(table.partitions(), as_of, days).orderBy("range_start").toLocalIterator()
        while part := list(islice(gone, DROPPED_AT_ONCE)):
            table.drop_days([row.range_start for row in part])
            dropped += [row.partition_name for row in part]
    return dropped


def run_retention(table: LogTable, as_of: date, days: int = RETENTION_DAYS) -> list[str]:
    """One maintenance run. A failure is logged and left to the next run."""
    try:
        dropped = drop_expired(table, as_of, days)
    except Exception:
        _log.exception("retention of %s failed", table.name)
        return []
    if dropped:
        _log.info("retention dropped %s", ", ".join(dropped))
    return dropped
