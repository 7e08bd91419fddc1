"""Newest-first pages and the ordered export."""

from __future__ import annotations

from datetime import datetime, timedelta
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallylog.functions.cursors import cursor_column
from tallylog.functions.timestamps import iso_millis
from tallylog.operators.filters import LogFilter

_EPOCH = datetime.fromisoformat("1970-01-01T00:00:00+00:00")


def _newest_first() -> list[Column]:
    return [F.col("ts").desc(), F.col("id").desc()]


def page_rows(logs: DataFrame) -> DataFrame:
    """The six output columns, with the time as ISO text."""
    return logs.select(
        "id", iso_millis(F.col("ts")).alias("timestamp"), "level", "service", "message", "attributes"
    )


def page(logs: DataFrame, condition: LogFilter, limit: int) -> DataFrame:
    """One page: the six output columns and ``next_cursor``, the same on each row.

    One row more than the page is fetched to learn whether another page follows;
    the cursor is NULL if not. Each task keeps its own newest ``limit + 1`` rows,
    so the window below sees at most that many.
    """
    newest = (
        condition.apply(logs)
        .select("id", "ts", "level", "service", "message", "attributes")
        .orderBy(*_newest_first())
        .limit(limit + 1)
    )
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbered = newest.withColumn("position", F.row_number().over(Window.orderBy(*_newest_first())))
    last = F.when(F.col("position") == limit, cursor_column(F.col("ts"), F.col("id")))
    marked = numbered.select(
        "*",
        F.when(
            F.count(F.lit(1)).over(everything) > limit, F.max(last).over(everything)
        ).alias("next_cursor"),
    )
    return (
        marked.where(F.col("position") <= limit)
        .orderBy("position")
        .select(
            "id",
            iso_millis(F.col("ts")).alias("timestamp"),
            "level",
            "service",
            "message",
            "attributes",
            "next_cursor",
        )
    )


class Bound(NamedTuple):
    """``found`` rows, limit + 1 at most, none older than ``since`` (None: no bound)."""

    found: int
    since: datetime | None


def lower_bound(
    logs: DataFrame,
    condition: LogFilter,
    limit: int,
    oldest: datetime,
    newest: datetime,
    first: timedelta = timedelta(hours=1),
    growth: int = 8,
) -> Bound:
    """Time that no row of the page is older than, and how many rows the page will find.

    A page comes from the newest rows that match, yet a top-k over the whole
    table reads all of it. So the newest hour is tried first, then the seven hours
    before it, and so on back to ``oldest``; each try reads only its own span, and
    only ``ts`` and the columns the filter names. If there are fewer matches than a page
    takes, the bound is the oldest match. The page itself then reads its wide columns from
    the bound on. The answer is exact: rows at the bound itself are all included. The last
    try has no lower end but the filter's own, since rows may be older than any datetime.
    """
    top = newest
    if condition.end is not None:
        top = min(top, condition.end)
    if condition.cursor is not None:
        top = min(top, condition.cursor.ts + timedelta(microseconds=1))
    bottom = oldest if condition.start is None else max(oldest, condition.start)
    span, wanted, bound, until = first, limit + 1, None, condition.end
    while top > bottom:
        reach = top - span if span < top - bottom else bottom
        found = (
            (condition if reach == bottom else condition.since(reach))
            .until(until)
            .apply(logs)
            .select("ts")
            .orderBy(F.col("ts").desc())
            .limit(wanted)
            .agg(F.count(F.lit(1)).alias("n"), F.unix_micros(F.min("ts")).alias("at"))
            .first()
        )
        if found["n"]:
            bound = found["at"]
        wanted -= found["n"]
        if not wanted or reach == bottom:
            break
        span, until = span * growth, reach
    try:
        since = None if bound is None else _EPOCH + timedelta(microseconds=bound)
    except OverflowError:
        since = None
    return Bound(limit + 1 - wanted, since)


def export_ordered(logs: DataFrame, condition: LogFilter = LogFilter()) -> DataFrame:
    """Every matching row in page order, with the cursor that continues after it.

    What a client gets by following cursors to the end, in one range-partitioned
    sort. The id breaks ties, so equal timestamps still spread over partitions.
    """
    ordered = condition.apply(logs).orderBy(*_newest_first())
    return ordered.select(
        "id",
        iso_millis(F.col("ts")).alias("timestamp"),
        "level",
        "service",
        "message",
        "attributes",
        cursor_column(F.col("ts"), F.col("id")).alias("cursor"),
    )
