"""The log store as its users see it."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import replace
from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallylog.model import PAGE_COLUMNS, RETENTION_DAYS
from tallylog.operators import aggregation, paging, retention
from tallylog.operators.filters import LogFilter, check_limit
from tallylog.operators.validation import batch_outcome, validate
from tallylog.session import configure, fresh_name
from tallylog.sources.envelopes import explode_entries, parse_envelopes
from tallylog.sources.file_index import FileIndex
from tallylog.sources.log_table import LogTable, OutcomeTable, RejectTable, create_database
from tallylog.streaming.ingest_stream import start_ingest, store


class LogStore:
    """Ingest, query, aggregate and expire logs kept in one database.

    >>> store = LogStore(spark, "logs_db")
    >>> store.ingest(read_bodies(spark, "s3://landing/"))
    >>> store.query(service="checkout", level="error", limit=50)
    >>> store.aggregate(start="2024-01-01", end="2024-02-01", bucket="1h", group_by="level")
    """

    def __init__(self, spark: SparkSession, database: str):
        self.spark = configure(spark)
        create_database(spark, database)
        self.logs = LogTable(spark, f"{database}.logs")
        self.rejects = RejectTable(spark, f"{database}.rejects")
        self.deliveries = OutcomeTable(spark, f"{database}.outcomes")
        self.files = FileIndex(spark, database, self.logs)

    def ingest(
        self, bodies: DataFrame, as_of: Column | datetime | None = None, load: str | None = None
    ) -> tuple[int, int]:
        """Validate and store ``batch_id, raw`` bodies; returns how many entries were
        accepted and rejected, and stored, by this call.

        With a ``load`` name the call can be repeated: it adds only what an earlier call
        of that name did not store, so the same load twice is stored once, and one that
        failed between its writes is completed. What became of each body is in ``deliveries``. For
        more than the cluster's disks hold at once, use :meth:`stream` with ``available_now``.
        """
        return store(
            self._validated(bodies, as_of),
            self.logs,
            self.rejects,
            load or fresh_name("load"),
            replay=load is not None,
            outcomes=self.deliveries,
        )

    def outcomes(self, bodies: DataFrame, as_of: Column | datetime | None = None) -> DataFrame:
        """Per body what ingest makes of it, without storing anything: accepted and
        rejected entries, and ``refused`` when none is accepted."""
        return batch_outcome(self._validated(bodies, as_of)).drop("ingested_at")

    def _validated(self, bodies: DataFrame, as_of: Column | datetime | None) -> DataFrame:
        entries = explode_entries(parse_envelopes(bodies))
        return validate(entries, as_of if as_of is not None else F.current_timestamp())

    def stream(self, bodies: DataFrame, name: str, **options) -> StreamingQuery:
        """Continuous ingest; see :func:`tallylog.streaming.ingest_stream.start_ingest`."""
        return start_ingest(bodies, self.logs, self.rejects, name, outcomes=self.deliveries, **options)

    def _source(self, condition: LogFilter) -> tuple[DataFrame, LogFilter]:
        """The rows to filter, without files that can't match, and the conditions left to check."""
        rows, attributes = self.logs.with_attributes(self.files.search(self.logs.scan(), condition), condition.attributes)
        return rows, replace(condition, attributes=attributes)

    def page(
        self,
        limit: int | str | None = None,
        cursor: str | None = None,
        **conditions,
    ) -> DataFrame:
        """One newest-first page as a DataFrame with a ``next_cursor`` column.

        Conditions: ``service``, ``level``, ``start`` (inclusive), ``end``
        (exclusive), ``q`` (text in the message), ``attributes`` (key to text).
        """
        condition = LogFilter.of(**conditions)
        size = check_limit(limit)
        condition = condition.after(cursor)
        bound = self.files.page_bound(condition, size)
        rows, rest = self._source(condition)
        if bound is None:
            span = self.logs.time_range()
            bound = paging.Bound(0, None) if span is None else paging.lower_bound(rows, rest, size, *span)
        if not bound.found:
            return paging.page(self.logs.scan().limit(0), rest, size)
        return paging.page(rows, rest.since(bound.since), size)

    def query(
        self,
        limit: int | str | None = None,
        cursor: str | None = None,
        **conditions,
    ) -> dict:
        """One page as ``{"logs": [...], "next_cursor": ...}``, at most 1,000 rows."""
        rows = self.page(limit, cursor, **conditions).collect()
        logs = []
        for row in rows:
            entry = {name: row[name] for name in PAGE_COLUMNS}
            entry["attributes"] = json.loads(entry["attributes"])
            logs.append(entry)
        return {"logs": logs, "next_cursor": rows[0]["next_cursor"] if rows else None}

    def export(self, **conditions) -> DataFrame:
        """All matching rows, newest first, each with its cursor."""
        return paging.export_ordered(*self._source(LogFilter.of(**conditions)))

    def aggregate(
        self,
        start: str | None = None,
        end: str | None = None,
        bucket: str | None = None,
        group_by: str | None = None,
        level: str | None = None,
        service: str | None = None,
        q: str | None = None,
        attributes: Mapping[str, str] | None = None,
        count_type: str = "int",
    ) -> DataFrame:
        """``start, group, count`` per bucket of 1m, 1h or 1d.

        Without a text or attribute condition the counts of indexed files are added up; otherwise,
        and for files that are not indexed, rows are counted.
        """
        condition = aggregation.check_aggregate(
            start, end, bucket, group_by, level, service, q, attributes
        )
        counted = self.files.bucket_counts(condition, bucket, group_by)
        if counted is not None:
            return aggregation.summed_buckets(counted, F.sum("n"), group_by, count_type)
        rows, rest = self._source(condition)
        return aggregation.bucket_counts(rows, rest, bucket, group_by, count_type)

    def index(self, first: date | None = None, last: date | None = None) -> int:
        """Count and index the files of these days that are new; returns how many.

        A maintenance run, beside loads and streams. Until it has run, new files are read by every query.
        """
        return self.files.update(first, last)

    def promote(self, keys: list[str] | None = None, most: int = 8, least_share: float = 0.05) -> list[str]:
        """Give these attributes (or the most frequent ones) columns that filters on them use; returns all that have one.

        Rows written from now on have the columns, and days that are compacted.
        """
        return self.logs.promote(self.logs.frequent_attributes(most, least_share) if keys is None else keys)

    def partitions(self) -> DataFrame:
        """Stored days, from the catalog; no data is read."""
        return self.logs.partitions()

    def partition_statistics(self, first: date | None = None, last: date | None = None) -> DataFrame:
        """Stored days from ``first`` to ``last`` with row counts and time ranges, read from ``ts``."""
        logs = self.logs.scan()
        if first is not None:
            logs = logs.where(F.col("day") >= F.lit(first))
        if last is not None:
            logs = logs.where(F.col("day") <= F.lit(last))
        return retention.partition_inventory(logs)

    def compact(self, day: date) -> int:
        """Rewrite a closed day into few sorted files and index them; returns its rows."""
        with self.files.lease():
            rows = self.logs.compact(day)
            if rows:
                self.files.forget([day])
        if rows:
            self.files.update(day, day)
        return rows

    def compact_small(self, before: date, least_files: int = 8, least_bytes: int = 64 << 20) -> dict[str, list[date]]:
        """Compact the days before ``before`` that hold many small files; returns them by table.

        For logs that is the day of the rows, for reports the day of ingest. Logs that still arrive for a
        day wait until its rewrite is done.
        """
        done = {}
        for table in (self.logs, self.rejects, self.deliveries):
            days = table.small_days(least_files, least_bytes, before)
            for day in days:
                self.compact(day) if table is self.logs else table.compact(day)
            done[table.name.rpartition(".")[2]] = days
        return done

    def expire(self, as_of: date | None = None, days: int = RETENTION_DAYS) -> list[str]:
        """Drop logs of days older than ``days``, and reports taken that long ago; returns the dropped log partitions.

        A failure is raised. :func:`tallylog.operators.retention.run_retention` is the
        scheduled run, which logs it and leaves the days to the next one.
        """
        today = as_of or datetime.now(timezone.utc).date()
        with self.files.lease():
            gone = [row.range_start for row in retention.expired(self.logs.partitions(), today, days).toLocalIterator()]
            dropped = retention.drop_expired(self.logs, today, days)
            self.files.forget(gone)
        for table in (self.rejects, self.deliveries):
            retention.drop_expired(table, today, days)
        return dropped
