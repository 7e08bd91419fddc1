"""What is known of stored log files: counts per minute and hour, and the trigrams of their messages.

A log file never changes, so what was worked out for it holds as long as the file does, whichever load
wrote it. A query lists the files there are now and asks which of them are indexed: those are answered
from here, the others are read. So replays, compaction and expiry need no bookkeeping, and an index
that lags behind costs time, not rows.

Three tables: ``log_counts`` (rows per file, bucket, service and level, and per file and minute in all),
``log_trigrams`` (three letters to the files whose messages hold them) and ``indexed_files``, which is
written last. Rows of a run that failed before that name a build that no indexed file has, and are not used.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from datetime import date, datetime, timedelta, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylog import model
from tallylog.functions.patterns import literal_parts
from tallylog.functions.timestamps import bucket_start_seconds
from tallylog.operators.filters import LogFilter
from tallylog.operators.paging import Bound
from tallylog.session import checkpointed, fresh_name
from tallylog.sources.lease import Lease
from tallylog.sources.log_table import LogTable, current, write_rows

#: Files that one build indexes; more are taken in several builds.
FILES_AT_ONCE = 10_000
#: Trigrams that a task holds before it hands them on.
HELD_TRIGRAMS = 1 << 20
#: An hour with more rows than this is narrowed down to its minutes before a page reads it.
REFINED_ROWS = 100_000
#: Between texts that trigrams are taken from; no trigram holds it.
SEPARATOR = "\U0010ffff"
#: Rows of counts that a task sorts and writes. They shrink too well in a shuffle for its bytes to bound a task.
COUNTS_PER_TASK = 250_000

MINUTE, HOUR = 60, 3600
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)

_COUNTS = "file STRING, build STRING, bucket BIGINT, service STRING, level STRING, n BIGINT, day DATE, grain STRING, month DATE"
_TRIGRAMS = "trigram BIGINT, file STRING, day DATE"
_FILES = "file STRING, build STRING, n BIGINT, day DATE"


def trigram_codes(text: str) -> np.ndarray:
    """The distinct trigrams of a text as numbers, without those over a separator."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    if len(points) < 3:
        return np.empty(0, np.int64)
    inside = points != ord(SEPARATOR)
    codes = (points[:-2] << 42) | (points[1:-1] << 21) | points[2:]
    return np.unique(codes[inside[:-2] & inside[1:-1] & inside[2:]])


def _all_trigrams(texts: pa.Array) -> np.ndarray:
    """The trigrams of texts, repeats included; none spans two texts."""
    texts = texts.drop_null()
    if not len(texts):
        return np.empty(0, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if ends[-1] == ends[0]:
        return np.empty(0, np.int64)
    held = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    if held.max() < 128:
        points = held.astype(np.int64)
    else:
        points = np.frombuffer(held.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        ends = np.concatenate(([0], np.cumsum((held & 0xC0) != 0x80)))[ends]
    inside = np.ones(len(points) + 2, bool)
    # The last two places of each text start no trigram.
    for back in (1, 2):
        inside[np.maximum(ends[1:] - back, ends[:-1])[ends[1:] > ends[:-1]]] = False
    codes = (points[:-2] << 42) | (points[1:-1] << 21) | points[2:]
    return codes[inside[: len(codes)]]


def _file_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``trigram, file, day`` from ``file, day, message``, once per file and task, or a little more often."""
    held: dict[tuple, np.ndarray] = {}

    def handed_on() -> Iterator[pa.RecordBatch]:
        for (file, day), codes in held.items():
            n = len(codes)
            columns = [pa.array(codes), pa.array([file] * n, pa.string()), pa.array([day] * n, pa.date32())]
            yield pa.RecordBatch.from_arrays(columns, ["trigram", "file", "day"])
        held.clear()

    for batch in batches:
        # A file is of one day.
        files = batch.column("file").dictionary_encode()
        owners, messages = files.indices.to_numpy(), batch.column("message")
        for number, file in enumerate(files.dictionary.to_pylist()):
            own = np.flatnonzero(owners == number)
            key = (file, batch.column("day")[int(own[0])].as_py())
            codes = np.unique(_all_trigrams(messages if len(own) == len(messages) else messages.take(pa.array(own))))
            held[key] = np.union1d(held[key], codes) if key in held else codes
        if sum(map(len, held.values())) > HELD_TRIGRAMS:
            yield from handed_on()
    yield from handed_on()


def _path(uri: str) -> str:
    """A listed file in the form that rows name it."""
    return re.sub(r"^file:/+", "file:/", uri)


def _ceiling(moment: datetime, seconds: int) -> int:
    return -((_EPOCH - moment) // timedelta(seconds=seconds)) * seconds


def _floor(moment: datetime, seconds: int) -> int:
    return (moment - _EPOCH) // timedelta(seconds=seconds) * seconds


def _moment(seconds: int) -> datetime:
    return _EPOCH + timedelta(seconds=seconds)


@dataclass(frozen=True)
class Coverage:
    """The files that hold a time range now, and the builds of those that are indexed."""

    files: frozenset[str]
    builds: dict[str, str]
    #: Whether the index also holds files that are gone, or a file twice.
    stale: bool

    @property
    def open_files(self) -> list[str]:
        return sorted(self.files - self.builds.keys())


class FileIndex:
    def __init__(self, spark: SparkSession, database: str, logs: LogTable):
        self.spark, self.logs = spark, logs
        self.counts, self.trigrams, self.files = (f"{database}.{n}" for n in ("log_counts", "log_trigrams", "indexed_files"))
        for name, columns, tail in (
            (self.counts, _COUNTS, "PARTITIONED BY (grain, month)"),
            (self.trigrams, _TRIGRAMS, "PARTITIONED BY (day)"),
            (self.files, _FILES, ""),
        ):
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet OPTIONS (compression 'zstd') {tail}")
        self._known: dict[tuple[str, str], date] = {}
        self._read: frozenset[str] = frozenset()

    def lease(self) -> Lease:
        """The right to index files, and to remove files that may be indexed."""
        return Lease(self.spark, self.files)

    # --- Building ---

    def update(self, first: date | None = None, last: date | None = None) -> int:
        """Index the files of these days that are not indexed; returns how many."""
        condition = LogFilter(
            start=first and datetime(first.year, first.month, first.day, tzinfo=timezone.utc),
            end=last and datetime(last.year, last.month, last.day, tzinfo=timezone.utc) + timedelta(days=1),
        )
        with self.lease():
            missing = self.coverage(condition).open_files
            for at in range(0, len(missing), FILES_AT_ONCE):
                self._build(condition, missing[at : at + FILES_AT_ONCE])
        return len(missing)

    def _build(self, condition: LogFilter, files: list[str]) -> None:
        build = fresh_name("build")
        rows = self._within(condition).where(F.col("_metadata.file_path").isin(files))
        rows = rows.select(F.col("_metadata.file_path").alias("file"), "day", "ts", "service", "level", "message")
        by_minute = checkpointed(
            rows.groupBy("file", "day", bucket_start_seconds(F.col("ts"), MINUTE).alias("bucket"), "service", "level").agg(
                F.count(F.lit(1)).alias("n")
            )
        )
        hour = F.col("bucket") - F.pmod("bucket", F.lit(HOUR))
        nothing = F.lit(None).cast("string")
        summed = [
            ("minute", by_minute),
            ("hour", by_minute.groupBy("file", "day", hour.alias("bucket"), "service", "level").agg(F.sum("n").alias("n"))),
            (
                "total",
                by_minute.groupBy("file", "day", "bucket")
                .agg(F.sum("n").alias("n"))
                .withColumns({"service": nothing, "level": nothing}),
            ),
        ]
        order = ["grain", "month", "bucket"]
        for grain, counts in summed:
            named = counts.withColumns({"build": F.lit(build), "grain": F.lit(grain), "month": F.trunc("day", "month")})
            shaped = named.select("file", "build", "bucket", "service", "level", "n", "day", "grain", "month")
            parts = -(-shaped.count() // COUNTS_PER_TASK)
            spread = shaped.repartitionByRange(max(parts, 1), "month", "bucket", "file", "service", "level")
            write_rows(spread.sortWithinPartitions(*order), self.counts)
        found = rows.select("file", "day", F.lower("message").alias("message")).mapInArrow(
            _file_trigrams, "trigram long, file string, day date"
        )
        found = found.dropDuplicates(["trigram", "file"]).hint("rebalance", F.col("day"))
        write_rows(found.sortWithinPartitions("day", "trigram"), self.trigrams)
        done = by_minute.groupBy("file", "day").agg(F.sum("n").alias("n"))
        write_rows(done.select("file", F.lit(build), "n", "day").coalesce(1), self.files)

    def forget(self, days: list[date]) -> None:
        """Drop what is known of days whose files are gone; counts go with the last day of their month."""
        if not days:
            return
        specs = ", ".join(f"PARTITION (day = DATE'{day}')" for day in days)
        self.spark.sql(f"ALTER TABLE {self.trigrams} DROP IF EXISTS {specs}")
        held = {row["range_start"].replace(day=1) for row in self.logs.partitions().select("range_start").toLocalIterator()}
        for month in sorted({day.replace(day=1) for day in days} - held):
            for grain in ("minute", "hour", "total"):
                self.spark.sql(f"ALTER TABLE {self.counts} DROP IF EXISTS PARTITION (grain = '{grain}', month = DATE'{month}')")

    # --- Reading ---

    def _within(self, condition: LogFilter, rows: DataFrame | None = None) -> DataFrame:
        rows = self.logs.scan() if rows is None else rows
        for bound in condition.days():
            rows = rows.where(bound)
        return rows

    def coverage(self, condition: LogFilter) -> Coverage:
        """Which files hold the time range, and which of them are indexed.

        Both lists are as long as the list of files that Spark's own reader keeps to plan a scan. The
        second is remembered until its table has new files, as an indexed file stays so.
        """
        files = frozenset(map(_path, self._within(condition).inputFiles()))
        indexed = current(self.spark, self.files)
        parts = frozenset(indexed.inputFiles())
        if parts != self._read:
            self._known = {(row["file"], row["build"]): row["day"] for row in indexed.toLocalIterator()}
            self._read = parts
        builds: dict[str, str] = {}
        stale = False
        for (file, build), day in sorted(self._known.items()):
            if file in files and file not in builds:
                builds[file] = build
            else:
                stale = stale or condition.may_hold(day)
        return Coverage(files, builds, stale)

    def _valid_counts(self, grain: str, condition: LogFilter, coverage: Coverage) -> DataFrame:
        """Counts of the indexed files that are still there, under the filter's days, service and level."""
        rows = self._within(condition, current(self.spark, self.counts)).where(F.col("grain") == grain)
        if condition.start is not None:
            rows = rows.where(F.col("month") >= F.trunc(F.lit(condition.start.date()), "month"))
        if condition.end is not None:
            rows = rows.where(F.col("month") <= F.lit(condition.end.date()))
        if condition.service:
            rows = rows.where(F.col("service") == condition.service)
        if condition.level:
            rows = rows.where(F.col("level") == condition.level)
        builds = sorted(set(coverage.builds.values()))
        if not coverage.stale and len(builds) <= FILES_AT_ONCE:
            return rows.where(F.col("build").isin(builds))
        pairs = pa.table({"file": list(coverage.builds.keys()), "build": list(coverage.builds.values())})
        return rows.join(self.spark.createDataFrame(pairs), ["file", "build"], "left_semi")

    def bucket_counts(self, condition: LogFilter, bucket: str, group_by: str | None) -> DataFrame | None:
        """``bucket, group, n`` of the rows that meet the filter, several rows per bucket; None to read them all.

        Counts of indexed files give the whole minutes (or hours) of the range; rows are read for its
        ends, and of files that are not indexed.
        """
        seconds = model.BUCKET_SECONDS[bucket]
        grouped = bool(group_by or condition.service or condition.level)
        grain, unit = ("hour", HOUR) if seconds >= HOUR else ("minute" if grouped else "total", MINUTE)
        if condition.q or condition.attributes or condition.start is None or condition.end is None:
            return None
        low, high = _ceiling(condition.start, unit), _floor(condition.end, unit)
        coverage = self.coverage(condition)
        if low >= high or not coverage.builds:
            return None

        group = F.col(group_by) if group_by else F.lit(None).cast("string")

        def of_rows(part: LogFilter, files: Iterable[str], without: bool = False) -> DataFrame:
            among = F.col("_metadata.file_path").isin(list(files))
            rows = part.apply(self.logs.scan().where(~among if without else among))
            return rows.groupBy(bucket_start_seconds(F.col("ts"), seconds).alias("bucket"), group.alias("group")).agg(
                F.count(F.lit(1)).alias("n")
            )

        counted = self._valid_counts(grain, condition, coverage).where((F.col("bucket") >= low) & (F.col("bucket") < high))
        at = F.col("bucket") - F.pmod("bucket", F.lit(seconds).cast("bigint"))
        found = counted.select(at.alias("bucket"), group.alias("group"), "n")
        open_files = coverage.open_files
        if open_files:
            found = found.unionByName(of_rows(condition, open_files))
        for start, end in ((condition.start, _moment(low)), (_moment(high), condition.end)):
            if start < end:
                found = found.unionByName(of_rows(replace(condition, start=start, end=end), open_files, without=True))
        return found

    def page_bound(self, condition: LogFilter, limit: int) -> Bound | None:
        """Time that no row of the page is older than, from counts; None if they can't tell.

        Rows of files that are not indexed can only make the page newer. The hours that lie in the
        range as a whole are added up from the newest until they hold a page and one row more, then the
        minutes of the last of them, if it has many rows. At most one row per stored hour is gathered.
        """
        if condition.q or condition.attributes:
            return None
        coverage = self.coverage(condition)
        if not coverage.builds:
            return Bound(0, None) if not coverage.files else None
        end = condition.end
        if condition.cursor is not None:
            after = condition.cursor.ts + timedelta(microseconds=1)
            end = after if end is None else min(end, after)
        until = replace(condition, cursor=None, end=end)
        wanted = limit + 1
        for grain, unit in (("hour", HOUR), ("minute", MINUTE)):
            rows = self._valid_counts(grain, until, coverage)
            if until.start is not None:
                rows = rows.where(F.col("bucket") >= _floor(until.start, unit))
            if until.end is not None:
                rows = rows.where(F.col("bucket") < _ceiling(until.end, unit))
            sums = rows.groupBy("bucket").agg(F.sum("n").alias("n")).orderBy(F.col("bucket").desc()).collect()
            reached = None
            for row in sums:
                whole = until.start is None or row["bucket"] >= _ceiling(until.start, unit)
                whole = whole and (until.end is None or row["bucket"] + unit <= _floor(until.end, unit))
                if not whole:
                    continue
                if row["n"] >= wanted:
                    reached = row["bucket"]
                    break
                wanted -= row["n"]
            if reached is None:
                if grain == "minute":
                    return Bound(limit + 1, until.start)
                if coverage.open_files:
                    return None
                return Bound(len(sums), self._moment_or_none(sums[-1]["bucket"])) if sums else Bound(0, None)
            until = replace(until, start=self._moment_or_none(reached), end=self._moment_or_none(reached + unit))
            if until.start is None or until.end is None:
                return Bound(limit + 1, None)
            if row["n"] <= REFINED_ROWS:
                break
        return Bound(limit + 1, until.start)

    @staticmethod
    def _moment_or_none(seconds: int) -> datetime | None:
        try:
            return _moment(seconds)
        except OverflowError:
            return None

    def matching_files(self, condition: LogFilter) -> list[str] | None:
        """Files that may hold a message with the searched text; None if that can't be told or is all of them.

        Each trigram of the text's literal parts must be in the file; files that are not indexed may hold it.
        """
        needles = self._needles(condition.q)
        if not needles:
            return None
        coverage = self.coverage(condition)
        if not coverage.builds:
            return None
        rows = self._within(condition, current(self.spark, self.trigrams)).where(F.col("trigram").isin(needles))
        held = rows.groupBy("file").agg(F.count_distinct("trigram").alias("n")).where(F.col("n") == len(needles))
        found = {row["file"] for row in held.select("file").collect()} & coverage.files
        files = found | set(coverage.open_files)
        return None if len(files) == len(coverage.files) else sorted(files)

    def _needles(self, q: str | None) -> list[int]:
        """Trigrams that every matching message holds, in lower case by Spark's own rule."""
        parts = literal_parts(q) if q else []
        if not any(len(part) >= 3 for part in parts):
            return []
        lower = self.spark.sql("SELECT " + ", ".join("lower(?)" for _ in parts), args=parts).first()
        return sorted({int(code) for part in lower for code in trigram_codes(part)})

    def search(self, rows: DataFrame, condition: LogFilter) -> DataFrame:
        """The scan ``rows``, without the files that can't hold the searched text."""
        files = self.matching_files(condition) if condition.q else None
        return rows if files is None else rows.where(F.col("_metadata.file_path").isin(files))
