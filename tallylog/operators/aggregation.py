"""Counts per time bucket."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylog import model
from tallylog.functions.timestamps import bucket_start_seconds, iso_millis
from tallylog.operators.filters import InvalidArgument, LogFilter, check_level, check_order, check_time


def check_aggregate(
    start: str | None,
    end: str | None,
    bucket: str | None,
    group_by: str | None = None,
    level: str | None = None,
    service: str | None = None,
    q: str | None = None,
    attributes: Mapping[str, str] | None = None,
) -> LogFilter:
    """Filter of an aggregate call, checked in the contract's order."""
    since, until = check_time(start, "start"), check_time(end, "end")
    if since is None:
        raise InvalidArgument(model.START_REQUIRED)
    if until is None:
        raise InvalidArgument(model.END_REQUIRED)
    check_order(since, until)
    if bucket not in model.BUCKET_SECONDS:
        raise InvalidArgument(model.BUCKET_INVALID)
    if group_by is not None and group_by not in model.GROUP_COLUMNS:
        raise InvalidArgument(model.GROUP_INVALID)
    return LogFilter(
        service=service,
        level=check_level(level),
        start=since,
        end=until,
        q=q,
        attributes=dict(attributes or {}),
    )


def bucket_counts(
    logs: DataFrame,
    condition: LogFilter,
    bucket: str,
    group_by: str | None = None,
    count_type: str = "int",
) -> DataFrame:
    """``start, group, count`` of the matching rows, empty buckets left out.

    Counts are combined on the map side under an integer bucket key, so what is
    shuffled is one row per bucket and group and task, however many rows a
    service or an hour holds. ``count_type="bigint"`` goes past 2^31 - 1.
    """
    group = F.col(group_by) if group_by else F.lit(None).cast("string")
    keyed = condition.apply(logs).select(
        bucket_start_seconds(F.col("ts"), model.BUCKET_SECONDS[bucket]).alias("bucket"),
        group.alias("group"),
    )
    return summed_buckets(keyed, F.count(F.lit(1)), group_by, count_type)


def summed_buckets(rows: DataFrame, count: Column, group_by: str | None, count_type: str = "int") -> DataFrame:
    """``start, group, count`` from ``bucket, group`` rows and the aggregate that counts them."""
    keys = ["bucket", "group"] if group_by else ["bucket"]
    counted = rows.groupBy(*keys).agg(count.cast(count_type).alias("count"))
    return counted.orderBy(*keys).select(
        iso_millis(F.timestamp_seconds("bucket")).alias("start"),
        F.col("group") if group_by else F.lit(None).cast("string").alias("group"),
        "count",
    )
