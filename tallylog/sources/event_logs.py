"""Log rows and ingest bodies derived from the ``events`` table.

``events(event_id, ts, user_id, event_type, value, props)`` has the shape of a log
stream; these views give it the log store's columns, so that every query can run
on it. Nothing here is cut down: each event gives one log row and one entry.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylog.functions.ids import uuid_from
from tallylog.functions.timestamps import iso_micros

AS_OF = "2024-02-01T00:00:00Z"
BATCH_SIZE = 100
EVENT_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)


def read_events(
    spark: SparkSession,
    sf_dir: str,
    start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    """Events, with the time range handed to the Parquet scan.

    The stored type has no zone, so the bounds are literals of that type.
    """
    events = spark.read.schema(EVENT_SCHEMA).parquet(f"{sf_dir}/events.parquet")

    def bound(moment: datetime) -> Column:
        return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")

    if start is not None:
        events = events.where(F.col("ts") >= bound(start))
    if end is not None:
        events = events.where(F.col("ts") < bound(end))
    return events


def logs_from_events(
    spark: SparkSession,
    sf_dir: str,
    start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    """``id, ts, level, service, message, attributes, attr, day`` for each event.

    ``start`` and ``end`` are whole milliseconds, so bounding the raw timestamp
    is the same as bounding the truncated one, and it prunes row groups.
    """
    events = read_events(spark, sf_dir, start, end)
    user = F.col("user_id").cast("string")
    kind = F.col("event_type")
    ts = F.date_trunc("millisecond", "ts").cast("timestamp")
    attributes = F.concat(
        F.expr("substr(props, 1, length(props) - 1)"),
        F.lit(', "user_id": "'),
        user,
        F.lit('", "vip": '),
        F.when(F.col("user_id") % 2 == 0, "true").otherwise("false"),
        F.lit("}"),
    )
    return events.select(
        uuid_from(F.col("event_id")).alias("id"),
        ts.alias("ts"),
        F.when(kind == "error", "error")
        .when(kind == "signup", "warn")
        .when(kind == "purchase", "info")
        .otherwise("debug")
        .alias("level"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 7).cast("string")).alias("service"),
        F.concat(
            kind,
            F.lit("_"),
            user,
            F.when(F.col("event_id") % 10 == 0, " 100% DONE").otherwise(" ok"),
        ).alias("message"),
        attributes.alias("attributes"),
        F.from_json(attributes, "map<string,string>").alias("attr"),
        F.to_date(ts).alias("day"),
    )


# One entry per event, written once for both engines; {iso} is the event's time as
# ISO text. Nine of twenty entries break one rule each (the ninth breaks two).
ENTRY_SQL = """
CASE event_id % 20
  WHEN 0 THEN '{"level":"info","service":"s","message":"m"}'
  WHEN 1 THEN concat('{"timestamp":"', {iso}, '","level":"critical","service":"s","message":"m"}')
  WHEN 2 THEN concat('{"timestamp":"', {iso}, '","level":"info","service":"","message":"m"}')
  WHEN 3 THEN '[1]'
  WHEN 4 THEN concat('{"timestamp":"', {iso}, '","level":"info","service":"s","message":"m","attributes":{"o":{"x":1}}}')
  WHEN 5 THEN concat('{"timestamp":"', {iso}, '","level":"info","service":"s","message":"m","host":"h"}')
  WHEN 6 THEN '{"timestamp":"2030-01-01T00:00:00Z","level":"info","service":"s","message":"m"}'
  WHEN 7 THEN concat('{"timestamp":"', {iso}, '","level":"info","service":"s","message":5}')
  WHEN 8 THEN '{"timestamp":"nope","level":"critical","service":"s","message":"m"}'
  ELSE concat('{"timestamp":"', {iso}, '","level":"info","service":"s","message":"m","attributes":', props, '}')
END
"""

# Further faults, one in each remainder of 20: types, nulls, and two at once.
MORE_ENTRY_SQL = """
CASE event_id % 20
  WHEN 0 THEN '{"timestamp":null,"level":"info","service":"s","message":"m"}'
  WHEN 1 THEN concat('{"timestamp":"', {iso}, '","service":"s","message":""}')
  WHEN 2 THEN concat('{"timestamp":"', {iso}, '","level":true,"service":"s","message":"m"}')
  WHEN 3 THEN concat('{"timestamp":"', {iso}, '","level":"info","message":"m"}')
  WHEN 4 THEN concat('{"timestamp":"', {iso}, '","level":"info","service":{"a":1},"message":"m"}')
  WHEN 5 THEN concat('{"timestamp":"', {iso}, '","level":"info","service":"s","host":"h"}')
  WHEN 6 THEN concat('{"timestamp":"', {iso}, '","level":"critical","service":"s","message":""}')
  WHEN 7 THEN concat('{"timestamp":"', {iso}, '","level":"info","service":"s","message":"m","attributes":null}')
  WHEN 8 THEN concat('{"timestamp":"', {iso}, '","level":"info","service":"s","message":"m","attributes":[1]}')
  WHEN 9 THEN concat('{"timestamp":"', {iso}, '","level":"info","service":"s","message":"m","attributes":{"k":null}}')
  WHEN 10 THEN concat('{"zone":"z","timestamp":"', {iso}, '","level":"critical","service":"s","message":"m","host":"h"}')
  WHEN 11 THEN '{"timestamp":"14:00","level":"info","service":"s","message":"m"}'
  WHEN 12 THEN '"text"'
  WHEN 13 THEN 'null'
  WHEN 14 THEN '{"timestamp":"2024-02-01T00:05:00.001Z","level":"info","service":"s","message":"m"}'
  WHEN 15 THEN '{"timestamp":"2024-02-01T00:05:00.000Z","level":"warn","service":"s","message":"m"}'
  WHEN 16 THEN concat('{"timestamp":"', {iso}, '","level":"info","service":"s","message":"m","attributes":{"a":[1]},"host":"h"}')
  WHEN 17 THEN concat('{"timestamp":"', {iso}, '","level":"INFO","service":"s","message":"m"}')
  WHEN 18 THEN '{"timestamp":20240101,"level":"info","service":"s","message":"m"}'
  ELSE concat('{"timestamp":"', {iso}, '","level":"error","service":"s","message":"m","attributes":{"n":3.0,"b":false,"t":"x"}}')
END
"""


def _spread(rows: DataFrame) -> DataFrame:
    """Hash rows by batch into all shuffle partitions.

    The grouping that follows uses this shuffle. With a number given, small
    partitions are not merged: what comes after is costly for its size.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "batch_id")


def bodies_from_events(
    spark: SparkSession, sf_dir: str, entry_sql: str = ENTRY_SQL
) -> DataFrame:
    """Bodies of 100 entries each: ``batch_id, raw``. A group never holds more."""
    iso = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")"
    entries = read_events(spark, sf_dir).select(
        F.floor(F.col("event_id") / BATCH_SIZE).cast("bigint").alias("batch_id"),
        "event_id",
        F.expr(entry_sql.replace("{iso}", iso)).alias("entry"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("event_id", "entry")))
    return _spread(entries).groupBy("batch_id").agg(
        F.concat(F.lit('{"logs":['), F.array_join(ordered["entry"], ","), F.lit("]}")).alias(
            "raw"
        )
    )


# What a broken delivery looks like, one kind per remainder of the batch number:
# cut off, wrong top level, wrong field, empty list, text after the end.
BROKEN_SQL = """
CASE batch_id % 5
  WHEN 0 THEN substr(raw, 1, length(raw) - 1)
  WHEN 1 THEN concat('[', raw, ']')
  WHEN 2 THEN concat('{"entries":', substr(raw, 9))
  WHEN 3 THEN '{"logs":[]}'
  ELSE concat(raw, ' trailing')
END
"""


def deliveries_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every body once as it is, once broken (negative number), and its first entry,
    which breaks a rule, alone in a body of its own (numbers from one billion)."""
    bodies = bodies_from_events(spark, sf_dir)
    variants = F.array(
        F.struct(F.col("batch_id").alias("batch_id"), F.col("raw").alias("raw")),
        F.struct((-F.col("batch_id") - 1).alias("batch_id"), F.expr(BROKEN_SQL).alias("raw")),
        F.struct(
            (F.col("batch_id") + 1_000_000_000).alias("batch_id"),
            F.lit('{"logs":[{"level":"info","service":"s","message":"m"}]}').alias("raw"),
        ),
    )
    return bodies.select(F.inline(variants))


def column_arrays_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five parallel arrays per 100 events: ``batch_id, ts, level, service, message,
    attributes``. A group never holds more."""
    events = read_events(spark, sf_dir)
    user = F.col("user_id").cast("string")
    row = F.struct(
        "event_id",
        iso_micros(F.col("ts")).alias("ts"),
        F.when(F.col("event_type") == "error", "error").otherwise("info").alias("level"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 7).cast("string")).alias("service"),
        F.concat("event_type", F.lit("_"), user).alias("message"),
        F.col("props").alias("attributes"),
    )
    rows = events.select(
        F.floor(F.col("event_id") / BATCH_SIZE).cast("bigint").alias("batch_id"), row.alias("row")
    )
    grouped = _spread(rows).groupBy("batch_id").agg(
        F.array_sort(F.collect_list("row")).alias("rows")
    )
    names = ("ts", "level", "service", "message", "attributes")
    return grouped.select("batch_id", *(F.col("rows")[n].alias(n) for n in names))
