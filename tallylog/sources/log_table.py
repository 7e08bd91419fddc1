"""The stored logs and the stored rejections.

Both are Parquet tables of the session's catalog. Logs are partitioned by UTC day,
so that a time range opens only its days and an expired day goes as a whole.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallylog import model
from tallylog.functions.ids import partition_name
from tallylog.operators.ingest import insert_if_absent, with_day, with_defaults
from tallylog.session import checkpointed, shared_folder
from tallylog.sources.lease import Lease

#: Days whose files a task that writes reports keeps open; rows of more are sorted.
OPEN_DAYS = 2

_EPOCH = datetime.fromisoformat("1970-01-01T00:00:00+00:00")
_FIRST = datetime.min.replace(tzinfo=_EPOCH.tzinfo)
_LAST = datetime.max.replace(tzinfo=_EPOCH.tzinfo)


def _moment(seconds: int) -> datetime:
    """Seconds since 1970 as a datetime, within the years a datetime can hold."""
    since = timedelta(seconds=seconds)
    return min(max(since, _FIRST - _EPOCH), _LAST - _EPOCH) + _EPOCH


def create_database(spark: SparkSession, name: str) -> None:
    """Database whose tables live in the shared folder."""
    location = f"{shared_folder(spark)}/{name}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{location}'")


def _create(spark: SparkSession, name: str, schema: T.StructType, tail: str) -> None:
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet OPTIONS (compression 'zstd') {tail}")


def current(spark: SparkSession, name: str) -> DataFrame:
    """The table with its present files.

    A session keeps the file list of a table it has read, and a stream writes
    from a session of its own, so the list is dropped first.
    """
    spark.catalog.refreshTable(name)
    return spark.table(name)


def _quoted(text: str) -> str:
    """The text as a string of SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Columns of promoted attributes are numbered from 1; the column's comment is the attribute's key.
_PROMOTED = "promoted_"


def _promoted_column(number: int) -> str:
    return f"{_PROMOTED}{number}"


def _promoted_in(logs: DataFrame) -> list[str]:
    found = {f.name: f.metadata.get("comment") for f in logs.schema if f.name.startswith(_PROMOTED)}
    return [found[_promoted_column(n)] for n in range(1, len(found) + 1)]


def write_rows(rows: DataFrame, table: str, overwrite: bool = False) -> int:
    """Write by position; returns how many rows the finished job wrote."""
    written = Observation()
    rows.observe(written, F.count(F.lit(1)).alias("rows")).write.insertInto(table, overwrite=overwrite)
    return written.get["rows"]


def write_unsorted(rows: DataFrame, table: str, overwrite: bool = False) -> int:
    """As :func:`write_rows`, for rows of few days in any order.

    Spark sorts a task's rows by day before it writes them, unless it may keep the files of several days
    open. Rows of one day need no sort, and their writer then holds no more than a row group.
    """
    conf, name = rows.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name)
    conf.set(name, str(OPEN_DAYS))
    try:
        return write_rows(rows, table, overwrite)
    finally:
        conf.set(name, before)


def _left_behind(rows: DataFrame, table: str, load: str) -> DataFrame | None:
    """Stored rows of the load in the days of ``rows``; None if there are no rows.

    ``day`` prunes directories, and the file statistics of ``load`` skip the
    files of all other loads.
    """
    days = rows.agg(F.min("day").alias("first"), F.max("day").alias("last")).first()
    if days["first"] is None:
        return None
    return current(rows.sparkSession, table).where(
        F.col("day").between(days["first"], days["last"]) & (F.col("load") == load)
    )


class _Table:
    """A day-partitioned table; whoever writes to it holds its lease."""

    def __init__(self, spark: SparkSession, name: str, schema: T.StructType):
        self.spark = spark
        self.name = name
        _create(spark, name, schema, "PARTITIONED BY (day)")

    def lease(self) -> Lease:
        return Lease(self.spark, self.name)

    def scan(self) -> DataFrame:
        return current(self.spark, self.name)

    def partitions(self) -> DataFrame:
        """``partition_name, range_start, range_end`` of each stored day, from the
        catalog alone; no data is read."""
        day = F.substring_index("partition", "=", -1).cast("date")
        return self.spark.sql(f"SHOW PARTITIONS {self.name}").select(
            partition_name(day).alias("partition_name"),
            day.alias("range_start"),
            F.date_add(day, 1).alias("range_end"),
        )

    def drop_days(self, days: list[date]) -> None:
        """Drop these days, if they are stored, with their files."""
        if days:
            specs = ", ".join(f"PARTITION (day = DATE'{day}')" for day in days)
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS {specs}")

    def _shaped(self, rows: DataFrame) -> DataFrame:
        return rows.hint("rebalance", F.col("day"))

    def compact(self, day: date) -> int:
        """Rewrite a day into few files; returns its rows.

        A stream leaves a file per micro-batch. The lease keeps other writers out, so no row that is
        written meanwhile is lost. The rows are stored in the checkpoint folder first, and the new
        files replace the old ones when the write commits, so one that fails leaves the day as it was.
        """
        with self.lease() as lease:
            table = self.scan()
            held = checkpointed(self._rewritten(table.where(F.col("day") == F.lit(day))).select(*table.columns))
            if held.isEmpty():
                return 0
            lease.check()
            mode = "spark.sql.sources.partitionOverwriteMode"
            before = self.spark.conf.get(mode)
            self.spark.conf.set(mode, "dynamic")
            try:
                return write_rows(self._shaped(held), self.name, overwrite=True)
            finally:
                self.spark.conf.set(mode, before)

    def _rewritten(self, rows: DataFrame) -> DataFrame:
        return rows

    def small_days(self, least_files: int, least_bytes: int, before: date) -> list[date]:
        """Stored days before ``before`` with at least so many files of less than so many bytes.

        Files are listed, not opened: the reader of binary files gives sizes without contents.
        """
        if not self.partitions().head(1):
            return []
        details = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.name}")
        location = details.where("col_name = 'Location'").first()["data_type"]
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(location)
        small = (
            files.where((F.col("length") < least_bytes) & (F.col("day") < F.lit(before)))
            .groupBy(F.col("day").cast("date").alias("day"))
            .agg(F.count(F.lit(1)).alias("files"))
            .where(F.col("files") >= least_files)
        )
        return [row["day"] for row in small.orderBy("day").toLocalIterator()]


class LogTable(_Table):
    """Append and scan of the day-partitioned log table.

    Attributes that many rows have can be promoted to columns of their own, which a filter on them
    reads instead of the map. Promoted columns are numbered; ``promoted`` says how many a row has, since
    rows written before a promotion lack the column until their day is compacted.
    """

    def __init__(self, spark: SparkSession, name: str):
        super().__init__(spark, name, model.LOG_SCHEMA)

    def promoted(self) -> list[str]:
        """The promoted attributes in the order of their columns."""
        return _promoted_in(self.scan())

    def promote(self, keys: list[str]) -> list[str]:
        """Give attributes columns of their own from now on; returns all that have one."""
        with self.lease():
            own = self.promoted()
            new = [key for key in dict.fromkeys(keys) if key not in own]
            if new:
                columns = ", ".join(
                    f"{_promoted_column(n)} STRING COMMENT {_quoted(key)}" for n, key in enumerate(new, len(own) + 1)
                )
                self.spark.sql(f"ALTER TABLE {self.name} ADD COLUMNS ({columns})")
            return own + new

    def frequent_attributes(self, most: int, least_share: float, first: date | None = None) -> list[str]:
        """At most ``most`` attribute keys that at least this share of the rows since ``first`` have, most frequent first."""
        rows = self.scan() if first is None else self.scan().where(F.col("day") >= F.lit(first))
        total = rows.count()
        counts = rows.select(F.explode(F.map_keys("attr")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        chosen = counts.where(F.col("n") >= least_share * total).orderBy(F.col("n").desc(), "key").limit(most)
        return [row["key"] for row in chosen.collect()]

    def with_attributes(self, rows: DataFrame, attributes: Mapping[str, str]) -> tuple[DataFrame, dict[str, str]]:
        """Rows of the scan that have the promoted ones of these attributes, and the attributes left to check.

        Rows that have the columns are found by them, in Parquet's statistics, dictionaries and Bloom
        filters; of the files written earlier (``promoted`` is the same in all rows of a file) the map is read.
        """
        columns = {key: n for n, key in enumerate(_promoted_in(rows), 1) if key in attributes}
        if not columns:
            return rows, dict(attributes)
        newest = max(columns.values())
        own = rows.where(F.col("promoted") >= newest)
        earlier = rows.where(F.col("promoted").isNull() | (F.col("promoted") < newest))
        for key, number in columns.items():
            own = own.where(F.col(_promoted_column(number)) == attributes[key])
            earlier = earlier.where(F.col("attr")[key] == attributes[key])
        return own.unionByName(earlier), {k: v for k, v in attributes.items() if k not in columns}

    def _shaped(self, rows: DataFrame) -> DataFrame:
        return rows.hint("rebalance", F.col("day")).sortWithinPartitions("day", "service", "ts")

    def _rewritten(self, rows: DataFrame) -> DataFrame:
        keys = self.promoted()
        columns = {_promoted_column(n): F.col("attr")[key] for n, key in enumerate(keys, 1)}
        return rows.withColumns(columns | {"promoted": F.lit(len(keys))})

    def _prepared(self, rows: DataFrame, load: str) -> DataFrame:
        """Rows in table shape, checked, and laid out for reading.

        The rebalance brings a day's rows together for files of a good size, and
        splits a day that outgrows one task, so a backfill with most rows in one
        day still writes in parallel. Within a file rows are sorted by service
        and time, which lets row groups be skipped on either.
        """
        filled = self._rewritten(with_day(with_defaults(rows, key=["id"])).withColumn("load", F.lit(load)))
        broken = ~F.col("level").isin(*model.LEVELS)
        for name in model.LOG_SCHEMA.names:
            broken = broken | F.col(name).isNull()
        guarded = filled.select(*self.scan().columns).withColumn(
            "level",
            F.when(
                F.coalesce(broken, F.lit(True)),
                F.raise_error(F.lit("row breaks the log table's level or NOT NULL constraint")),
            ).otherwise(F.col("level")),
        )
        return self._shaped(guarded)

    def append(self, rows: DataFrame, load: str) -> int:
        """Add rows; returns how many were written."""
        with self.lease():
            return self._append(rows, load)

    def _append(self, rows: DataFrame, load: str) -> int:
        for number in range(1, len(self.promoted()) + 1):
            self.spark.conf.set(f"parquet.bloom.filter.enabled#{_promoted_column(number)}", "true")
        self.spark.conf.set("parquet.bloom.filter.adaptive.enabled", "true")
        return write_rows(self._prepared(rows, load), self.name)

    def append_missing(self, rows: DataFrame, load: str) -> int:
        """Add those rows that an interrupted write of the same load did not leave."""
        with self.lease():
            left = _left_behind(with_day(rows), self.name, load)
            if left is None:
                return 0
            return self._append(insert_if_absent(rows, left, ["id"]), load)

    def time_range(self) -> tuple[datetime, datetime] | None:
        """Start of the oldest stored day and end of the newest, from the catalog."""
        seconds = F.unix_date("range_start").cast("bigint") * 86400
        row = self.partitions().agg(F.min(seconds).alias("low"), F.max(seconds).alias("high")).first()
        if row["low"] is None:
            return None
        return _moment(row["low"]), _moment(row["high"] + 86400)


class RejectTable(_Table):
    """Append and scan of the rejection report, partitioned by day of ingest."""

    def __init__(self, spark: SparkSession, name: str):
        super().__init__(spark, name, model.REJECT_SCHEMA)

    def append(self, rows: DataFrame, load: str) -> int:
        with self.lease():
            return self._append(rows, load)

    def _append(self, rows: DataFrame, load: str) -> int:
        shaped = rows.select(
            F.col("batch_id").cast("string"),
            F.col("index").cast("int"),
            "reason",
            "raw",
            "ingested_at",
            F.lit(load).alias("load"),
            F.to_date("ingested_at").alias("day"),
        )
        return write_unsorted(self._shaped(shaped), self.name)

    def append_missing(self, rows: DataFrame, load: str) -> int:
        """As for logs. The report has no id, and a refused batch has no index."""
        keyed = rows.withColumns(
            {
                "batch_id": F.col("batch_id").cast("string"),
                "position": F.coalesce("index", F.lit(-1)),
                "day": F.to_date("ingested_at"),
            }
        )
        with self.lease():
            left = _left_behind(keyed, self.name, load)
            if left is None:
                return 0
            stored = left.select("batch_id", F.coalesce("index", F.lit(-1)).alias("position"))
            return self._append(insert_if_absent(keyed, stored, ["batch_id", "position"]), load)


class OutcomeTable(_Table):
    """What became of each delivery: its counts, whether it was accepted or refused, and why."""

    def __init__(self, spark: SparkSession, name: str):
        super().__init__(spark, name, model.OUTCOME_SCHEMA)

    def append(self, outcomes: DataFrame, load: str) -> int:
        with self.lease():
            return self._append(outcomes, load)

    def _append(self, outcomes: DataFrame, load: str) -> int:
        days = outcomes.withColumns({"load": F.lit(load), "day": F.to_date("ingested_at")})
        return write_unsorted(self._shaped(days.select(*model.OUTCOME_SCHEMA.names)), self.name)

    def append_missing(self, outcomes: DataFrame, load: str) -> int:
        """As for logs, by delivery."""
        keyed = outcomes.withColumn("day", F.to_date("ingested_at"))
        with self.lease():
            left = _left_behind(keyed, self.name, load)
            if left is None:
                return 0
            return self._append(insert_if_absent(keyed, left, ["batch_id"]), load)
