"""The engine's queries over a folder of tables, by name.

Each takes ``(spark, sf_dir)`` and returns a DataFrame. All of them read whole
tables. Times are given as ISO text and counts as integers, so that results can be
compared with another engine's.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylog.functions.cursors import cursor_column, decode_column
from tallylog.functions.json_text import (
    VARIANT_MAP,
    attribute_classes,
    attribute_json,
    attribute_map,
    field_text,
    number_text,
    variant_kind,
)
from tallylog.functions.timestamps import bucket_start, iso_micros, iso_millis, parse_iso, parse_iso_text
from tallylog.operators import aggregation, ingest, paging, retention, validation
from tallylog.operators.filters import LogFilter, check_limit
from tallylog.plans.log_store import LogStore
from tallylog.session import configure, fresh_name, remove_folder, shared_folder
from tallylog.sources import event_logs
from tallylog.sources.envelopes import MICRO_BATCH_BYTES, explode_entries, parse_envelopes, stream_body_lines
from tallylog.sources.log_table import LogTable, RejectTable, create_database
from tallylog.streaming.ingest_stream import start_ingest, store

Query = Callable[[SparkSession, str], DataFrame]

MONTH = {"start": "2024-01-01T00:00:00Z", "end": "2024-02-01T00:00:00Z"}
RETENTION_AS_OF = date(2024, 2, 15)

_queries: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        def configured(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(configure(spark), sf_dir)

        _queries[name] = configured
        return run

    return register


def all_queries() -> dict[str, Query]:
    return dict(_queries)


def _as_of():
    return parse_iso_text(event_logs.AS_OF)


def _logs(spark: SparkSession, sf_dir: str, condition: LogFilter = LogFilter()) -> DataFrame:
    """The log view, with the filter's time range at the scan.

    The view is not partitioned, so its ``day`` is left out.
    """
    end = condition.end
    if condition.cursor is not None:
        after = condition.cursor.ts + timedelta(milliseconds=1)
        end = after if end is None else min(end, after)
    return event_logs.logs_from_events(spark, sf_dir, condition.start, end).drop("day")


# --- Scan, filters and projections ---


@query("scan_logs")
def scan_logs(spark, sf_dir):
    return _logs(spark, sf_dir).select(
        "id", iso_micros(F.col("ts")).alias("ts"), "level", "service", "message", "attributes"
    )


@query("project_rows")
def project_rows(spark, sf_dir):
    return paging.page_rows(_logs(spark, sf_dir))


FILTERS = {
    "filter_service": {"service": "svc-3"},
    "filter_level": {"level": "error"},
    "filter_time": {"start": "2024-01-10T06:30:00.500Z", "end": "2024-01-20T00:00:00+02:00"},
    "filter_message": {"q": "PURCHASE"},
    "filter_message_wildcard": {"q": "e%_1_ O"},
    "filter_message_escape": {"q": "00\\% D\\one"},
    "filter_message_end": {"q": "0\\% done"},
    "filter_attr": {"attributes": {"k": "69"}},
    "filter_attr_boolean": {"attributes": {"vip": "true"}},
    "filter_attr_absent": {"attributes": {"region": "eu"}},
    "filter_attr_multi": {"attributes": {"user_id": "42", "vip": "true"}},
    "filter_none": {"service": "", "q": "", "attributes": {}},
    "filter_combined": {
        "service": "svc-2",
        "level": "debug",
        "start": "2024-01-03",
        "end": "2024-01-28",
        "q": "CLICK_",
        "attributes": {"vip": "false"},
    },
}


def _filter_query(arguments: dict) -> Query:
    def run(spark, sf_dir):
        condition = LogFilter.of(**arguments)
        return paging.page_rows(condition.apply(_logs(spark, sf_dir, condition)))

    return run


for _name, _arguments in FILTERS.items():
    query(_name)(_filter_query(_arguments))

DOCUMENT_PATTERNS = {
    "filter_message_documents": "ÉTRE",
    "filter_message_documents_wildcard": "ÉR_ %ÇON",
}


def _document_query(q: str) -> Query:
    def run(spark, sf_dir):
        documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
        logs = documents.select("doc_id", F.col("text").alias("message"))
        return LogFilter.of(q=q).apply(logs)

    return run


for _name, _q in DOCUMENT_PATTERNS.items():
    query(_name)(_document_query(_q))


@query("attr_as_text")
def attr_as_text(spark, sf_dir):
    attributes = F.col("attributes")
    return _logs(spark, sf_dir).select(
        "id", *(field_text(attributes, k).alias(k) for k in ("k", "user_id", "vip", "region"))
    )


@query("number_text")
def number_text_query(spark, sf_dir):
    """Event values over many magnitudes, in both written forms."""
    value = F.col("value") * F.pow(F.lit(2.0), F.col("event_id") % 160 - 80)
    power = (F.col("event_id") % 9 + 1).cast("double")
    return event_logs.read_events(spark, sf_dir).select(
        "event_id",
        number_text(F.col("value")).alias("plain"),
        number_text(F.floor(F.col("value")).cast("double")).alias("whole"),
        number_text(power * 1e20, exponents=True).alias("json_e20"),
        number_text(power * 1e21, exponents=True).alias("json_e21"),
        number_text(power / 1e6, exponents=True).alias("json_millionth"),
        number_text(power / 1e7, exponents=True).alias("json_smaller"),
        (number_text(value).cast("double") == value).alias("plain_reads_back"),
        (number_text(value, exponents=True).cast("double") == value).alias("json_reads_back"),
    )


ATTRIBUTES_SQL = """
concat('{"user_id": "', user_id, '", "v": ', value, ', "k": ', event_id, '.0, "e": ', user_id,
       'e2, "b": true, "dup": 1, "dup": "', event_type, '"}')
"""


@query("attributes_canonical")
def attributes_canonical(spark, sf_dir):
    given, values = F.col("given"), F.col("values")
    parsed = (
        event_logs.read_events(spark, sf_dir)
        .select("event_id", F.try_parse_json(F.expr(ATTRIBUTES_SQL)).alias("given"))
        .withColumn("values", F.try_variant_get("given", "$", VARIANT_MAP))
        .withColumn("classes", attribute_classes(values))
    )
    text = attribute_map(given, values, F.col("classes"))
    return parsed.select(
        "event_id", attribute_json(given, values, F.col("classes")).alias("attributes"), text.alias("text")
    ).select("event_id", "attributes", *(F.col("text")[k].alias(k) for k in ("k", "e", "dup", "b")))


ISO_TEXT_SQL = """
CASE event_id % 16
  WHEN 0 THEN concat({iso}, 'Z')
  WHEN 1 THEN concat({iso}, '+02:00')
  WHEN 2 THEN concat({iso}, '-05:30')
  WHEN 3 THEN substr({iso}, 1, 10)
  WHEN 4 THEN concat(substr({iso}, 1, 16), 'Z')
  WHEN 5 THEN concat(substr({iso}, 1, 10), 'T24:00:00Z')
  WHEN 6 THEN substr({iso}, 12, 5)
  WHEN 7 THEN concat({iso}, '+0200')
  WHEN 8 THEN concat({iso}, '-05')
  WHEN 9 THEN concat('+00', {iso}, 'Z')
  WHEN 10 THEN concat(substr({iso}, 1, 10), ' ', substr({iso}, 12, 8))
  WHEN 11 THEN concat(substr({iso}, 1, 10), 't', substr({iso}, 12, 8), 'z')
  WHEN 12 THEN concat({iso}, ' or so')
  ELSE {iso}
END
"""


@query("parse_iso")
def parse_iso_query(spark, sf_dir):
    iso = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")"
    texts = event_logs.read_events(spark, sf_dir).select(
        "event_id", F.expr(ISO_TEXT_SQL.replace("{iso}", iso)).alias("text")
    )
    return texts.select("event_id", iso_micros(parse_iso(F.col("text"))).alias("timestamp"))


@query("bucket_expr")
def bucket_expr(spark, sf_dir):
    ts = F.col("ts")
    return _logs(spark, sf_dir).select(
        "id",
        iso_millis(bucket_start(ts, 60)).alias("minute"),
        iso_millis(bucket_start(ts, 3600)).alias("hour"),
        iso_millis(bucket_start(ts, 86400)).alias("day"),
        iso_millis(bucket_start(ts - F.expr("INTERVAL 60 YEARS"), 3600)).alias("hour_before_1970"),
    )


# --- Pages ---

PAGE = {"level": "debug"}


@query("page_first")
def page_first(spark, sf_dir):
    return paging.page(_logs(spark, sf_dir), LogFilter.of(), check_limit(None))


@query("page_filtered")
def page_filtered(spark, sf_dir):
    return paging.page(_logs(spark, sf_dir), LogFilter.of(**PAGE), check_limit("1000"))


@query("page_next")
def page_next(spark, sf_dir):
    first = paging.page(_logs(spark, sf_dir), LogFilter.of(**PAGE), check_limit(None))
    condition = LogFilter.of(**PAGE).after(first.first()["next_cursor"])
    return paging.page(_logs(spark, sf_dir, condition), condition, check_limit(None))


@query("export_ordered")
def export_ordered(spark, sf_dir):
    return paging.export_ordered(_logs(spark, sf_dir))


@query("cursor_column")
def cursor_column_query(spark, sf_dir):
    return _logs(spark, sf_dir).select("id", cursor_column(F.col("ts"), F.col("id")).alias("cursor"))


@query("cursor_decode")
def cursor_decode(spark, sf_dir):
    """Cursors read back, and the same cursors damaged."""
    cursor = cursor_column(F.col("ts"), F.col("id"))
    given = _logs(spark, sf_dir).select("id", cursor.alias("cursor"))
    good, cut, reversed_ = (
        decode_column(c)
        for c in (
            F.col("cursor"),
            F.expr("substr(cursor, 1, length(cursor) - 20)"),
            F.reverse("cursor"),
        )
    )
    return given.select(
        "id",
        good["id"].alias("cursor_id"),
        iso_micros(good["ts"]).alias("cursor_ts"),
        cut.isNull().alias("cut_is_null"),
        reversed_.isNull().alias("reversed_is_null"),
    )


# --- Counts per bucket ---

AGGREGATES = {
    "agg_1m": {**MONTH, "bucket": "1m"},
    "agg_1h": {**MONTH, "bucket": "1h"},
    "agg_1d": {**MONTH, "bucket": "1d"},
    "agg_1m_service": {**MONTH, "bucket": "1m", "group_by": "service"},
    "agg_1h_service": {**MONTH, "bucket": "1h", "group_by": "service"},
    "agg_1d_level": {**MONTH, "bucket": "1d", "group_by": "level"},
    "agg_filtered": {
        "start": "2024-01-02T03:04:05Z",
        "end": "2024-01-29T12:00:00Z",
        "bucket": "1h",
        "group_by": "level",
        "service": "svc-4",
        "q": "ok",
        "attributes": {"vip": "true"},
    },
    "agg_errors": {**MONTH, "bucket": "1h", "group_by": "service", "level": "error"},
}


def _aggregate_query(arguments: dict) -> Query:
    def run(spark, sf_dir):
        condition = aggregation.check_aggregate(**arguments)
        return aggregation.bucket_counts(
            _logs(spark, sf_dir, condition),
            condition,
            arguments["bucket"],
            arguments.get("group_by"),
        )

    return run


for _name, _arguments in AGGREGATES.items():
    query(_name)(_aggregate_query(_arguments))


# --- Ingest ---


def _entries(spark: SparkSession, sf_dir: str, entry_sql: str) -> DataFrame:
    return explode_entries(
        parse_envelopes(event_logs.bodies_from_events(spark, sf_dir, entry_sql))
    )


def _validated(spark: SparkSession, sf_dir: str, entry_sql: str = event_logs.ENTRY_SQL) -> DataFrame:
    return validation.validate(_entries(spark, sf_dir, entry_sql), _as_of())


def _validated_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    deliveries = event_logs.deliveries_from_events(spark, sf_dir)
    return validation.validate(explode_entries(parse_envelopes(deliveries)), _as_of())


@query("ingest_envelopes")
def ingest_envelopes(spark, sf_dir):
    parsed = parse_envelopes(event_logs.deliveries_from_events(spark, sf_dir))
    return parsed.select(
        "batch_id",
        F.col("entries").isNull().alias("refused"),
        F.when(F.col("entries").isNotNull(), F.size("entries")).alias("n_entries"),
    )


@query("ingest_entries")
def ingest_entries(spark, sf_dir):
    return _entries(spark, sf_dir, event_logs.MORE_ENTRY_SQL).select(
        "batch_id",
        "index",
        variant_kind(F.col("entry")).alias("kind"),
        F.try_variant_get("entry", "$.timestamp", "string").alias("timestamp"),
        F.size("unknown").alias("n_unknown"),
    )


@query("unnest_arrays")
def unnest_arrays(spark, sf_dir):
    arrays = event_logs.column_arrays_from_events(spark, sf_dir)
    return ingest.unnest(
        arrays, ["ts", "level", "service", "message", "attributes"], keep=["batch_id"]
    )


@query("validate_reasons")
def validate_reasons(spark, sf_dir):
    return _validated(spark, sf_dir).select("batch_id", "index", "reason")


@query("validate_reasons_more")
def validate_reasons_more(spark, sf_dir):
    return _validated(spark, sf_dir, event_logs.MORE_ENTRY_SQL).select(
        "batch_id", "index", "reason"
    )


@query("validate_accepted")
def validate_accepted(spark, sf_dir):
    return validation.accepted_entries(_validated(spark, sf_dir)).select(
        "batch_id",
        "index",
        "id",
        iso_micros(F.col("ts")).alias("timestamp"),
        "level",
        "service",
        "message",
        "attributes",
        F.col("attr")["k"].alias("k"),
    )


@query("rejects")
def rejects(spark, sf_dir):
    return validation.rejected_entries(_validated_deliveries(spark, sf_dir)).select(
        "batch_id", "index", "reason"
    )


@query("batch_outcome")
def batch_outcome(spark, sf_dir):
    return validation.batch_outcome(_validated_deliveries(spark, sf_dir)).drop("ingested_at")


@query("with_defaults")
def with_defaults(spark, sf_dir):
    rows = event_logs.read_events(spark, sf_dir).select(
        "event_id",
        F.lit(None).cast("string").alias("id"),
        F.when(F.col("event_type") == "click", F.col("props")).alias("attributes"),
    )
    filled = ingest.with_defaults(rows, key=["event_id"])
    return filled.select(
        "event_id", "id", "attributes", F.col("ingested_at").isNotNull().alias("has_time")
    )


@query("day_routing")
def day_routing(spark, sf_dir):
    dated = ingest.with_partition_name(ingest.with_day(_logs(spark, sf_dir)))
    return dated.select("id", F.col("day").cast("string").alias("day"), "partition_name")


@query("insert_if_absent")
def insert_if_absent(spark, sf_dir):
    """First log of each service and minute that has no error log."""
    logs = _logs(spark, sf_dir).select(
        "id", "ts", "level", "service", bucket_start(F.col("ts"), 60).alias("minute")
    )
    absent = ingest.insert_if_absent(
        logs,
        logs.where(F.col("level") == "error"),
        ["service", "minute"],
        order=[F.col("ts"), F.col("id")],
    )
    return absent.select("service", iso_millis(F.col("minute")).alias("minute"), "id")


_databases: dict[tuple[str, str], str] = {}


def _new_database(spark: SparkSession, owner: str) -> str:
    """New database for a query; the one of the same query's last call is dropped, with its tables."""
    key = (spark.sparkContext.applicationId, owner)
    if key in _databases:
        spark.sql(f"DROP DATABASE IF EXISTS {_databases[key]} CASCADE")
    _databases[key] = fresh_name("tallylog")
    return _databases[key]


def _new_tables(spark: SparkSession, owner: str) -> tuple[LogTable, RejectTable]:
    database = _new_database(spark, owner)
    create_database(spark, database)
    return LogTable(spark, f"{database}.logs"), RejectTable(spark, f"{database}.rejects")


@query("append_counts")
def append_counts(spark, sf_dir):
    logs, rejected = _new_tables(spark, "append_counts")
    n_accepted, n_rejected = store(_validated(spark, sf_dir), logs, rejected, fresh_name("load"))
    return (
        logs.scan()
        .agg(F.count(F.lit(1)).alias("stored"))
        .select(
            "stored",
            F.lit(n_accepted).cast("bigint").alias("inserted"),
            F.lit(n_rejected).cast("bigint").alias("rejected"),
        )
    )


# --- Partitions and retention ---


@query("partition_inventory")
def partition_inventory(spark, sf_dir):
    return retention.partition_inventory(event_logs.logs_from_events(spark, sf_dir)).select(
        "partition_name",
        F.col("range_start").cast("string").alias("range_start"),
        F.col("range_end").cast("string").alias("range_end"),
        "rows",
        iso_millis(F.col("min_ts")).alias("min_ts"),
        iso_millis(F.col("max_ts")).alias("max_ts"),
    )


@query("retention_expired")
def retention_expired(spark, sf_dir):
    inventory = retention.partition_inventory(event_logs.logs_from_events(spark, sf_dir))
    return retention.expired(inventory, RETENTION_AS_OF).select("partition_name", "rows")


def _stored_logs(spark: SparkSession, sf_dir: str, owner: str) -> LogTable:
    logs, _ = _new_tables(spark, owner)
    logs.append(event_logs.logs_from_events(spark, sf_dir), fresh_name("load"))
    return logs


@query("retention_kept")
def retention_kept(spark, sf_dir):
    logs = _stored_logs(spark, sf_dir, "retention_kept")
    retention.drop_expired(logs, RETENTION_AS_OF)
    return paging.page_rows(logs.scan())


@query("retention_run")
def retention_run(spark, sf_dir):
    """Names that the first run drops; the days left over are what the second finds."""
    logs = _stored_logs(spark, sf_dir, "retention_run")
    dropped = retention.run_retention(logs, RETENTION_AS_OF)
    again = retention.run_retention(logs, RETENTION_AS_OF)
    kept = logs.partitions().select("partition_name", F.lit("kept").alias("state"))
    names = [(name, "dropped") for name in dropped] + [(name, "dropped twice") for name in again]
    return kept.unionByName(
        spark.createDataFrame(names, "partition_name string, state string")
    )


# --- Streaming ---


def _ingested_by_stream(spark: SparkSession, arriving: DataFrame, owner: str) -> LogStore:
    store_ = LogStore(spark, _new_database(spark, owner))
    store_.stream(arriving, fresh_name("ingest"), as_of=_as_of(), available_now=True).awaitTermination()
    return store_


def _streamed(spark: SparkSession, bodies: DataFrame, owner: str) -> LogStore:
    """Bodies laid down as files, then ingested by a stream that takes all there is."""
    landing = f"{shared_folder(spark)}/{fresh_name('landing')}"
    bodies.write.parquet(landing)
    arriving = (
        spark.readStream.schema("batch_id bigint, raw string")
        .option("maxBytesPerTrigger", MICRO_BATCH_BYTES)
        .parquet(landing)
    )
    store_ = _ingested_by_stream(spark, arriving, owner)
    remove_folder(spark, landing)
    return store_


@query("stream_ingest_accepted")
def stream_ingest_accepted(spark, sf_dir):
    store_ = _streamed(spark, event_logs.bodies_from_events(spark, sf_dir), "stream_ingest_accepted")
    return paging.page_rows(store_.logs.scan())


@query("stream_ingest_rejects")
def stream_ingest_rejects(spark, sf_dir):
    store_ = _streamed(spark, event_logs.bodies_from_events(spark, sf_dir), "stream_ingest_rejects")
    return store_.rejects.scan().select("batch_id", "index", "reason")


@query("stream_ingest_outcomes")
def stream_ingest_outcomes(spark, sf_dir):
    """What became of each delivery that a stream took, bodies refused as a whole among them."""
    store_ = _streamed(spark, event_logs.deliveries_from_events(spark, sf_dir), "stream_ingest_outcomes")
    return store_.deliveries.scan().select(F.col("batch_id").cast("bigint").alias("batch_id"), "accepted", "rejected", "outcome", "error")


@query("stream_ingest_lines")
def stream_ingest_lines(spark, sf_dir):
    """The same bodies in files of one body per line; ids follow file and line, so they are left out."""
    landing = f"{shared_folder(spark)}/{fresh_name('landing')}"
    event_logs.bodies_from_events(spark, sf_dir).select("raw").write.text(landing)
    store_ = _ingested_by_stream(spark, stream_body_lines(spark, landing), "stream_ingest_lines")
    remove_folder(spark, landing)
    return paging.page_rows(store_.logs.scan()).drop("id")


# --- Through the store, over its day-partitioned table ---


@query("ingest_repeated")
def ingest_repeated(spark, sf_dir):
    """The same load twice: the second call stores nothing."""
    store_ = LogStore(spark, _new_database(spark, "ingest_repeated"))
    bodies = event_logs.bodies_from_events(spark, sf_dir)
    calls = [store_.ingest(bodies, as_of=_as_of(), load=load) for load in ("one", "one")]
    counts = [F.lit(n).cast("bigint").alias(f"{what}_{i}") for i, call in enumerate(calls, 1) for what, n in zip(("accepted", "rejected"), call, strict=True)]
    stored = store_.logs.scan().agg(F.count(F.lit(1)).alias("stored"), F.count_distinct("id").alias("ids"))
    return stored.crossJoin(store_.rejects.scan().agg(F.count(F.lit(1)).alias("reported"))).select("*", *counts)


@query("ingest_renamed")
def ingest_renamed(spark, sf_dir):
    """The same bodies under another load's name: a delivery of its own, stored again."""
    store_ = LogStore(spark, _new_database(spark, "ingest_renamed"))
    bodies = event_logs.bodies_from_events(spark, sf_dir)
    for load in ("one", "two", "two"):
        store_.ingest(bodies, as_of=_as_of(), load=load)
    logs = store_.logs.scan().groupBy("load").agg(F.count(F.lit(1)).alias("stored"))
    rejected = store_.rejects.scan().groupBy("load").agg(F.count(F.lit(1)).alias("reported"))
    return logs.join(rejected, "load")


@query("store_compacted")
def store_compacted(spark, sf_dir):
    """Two loads, then the first days rewritten: the same rows."""
    store_ = LogStore(spark, _new_database(spark, "store_compacted"))
    logs = event_logs.logs_from_events(spark, sf_dir)
    early = F.col("level") == "error"
    store_.logs.append(logs.where(early), "errors")
    store_.logs.append(logs.where(~early), "others")
    for number in (1, 2):
        store_.compact(date(2024, 1, number))
    return store_.export()


_stores: dict[tuple[str, str], LogStore] = {}


def _store(spark: SparkSession, sf_dir: str) -> LogStore:
    """All events of the folder, stored once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        store_ = LogStore(spark, fresh_name("tallylog"))
        store_.logs.append(event_logs.logs_from_events(spark, sf_dir), "events")
        _stores[key] = store_
    return _stores[key]


STORE_CALLS: dict[str, Callable[[LogStore], DataFrame]] = {
    "store_page_first": lambda s: s.page(),
    "store_page_filtered": lambda s: s.page("1000", **PAGE),
    "store_page_next": lambda s: s.page(cursor=s.query(**PAGE)["next_cursor"], **PAGE),
    "store_page_sparse": lambda s: s.page(limit=1000, service="svc-3", q="purchase", attributes={"k": "69"}),
    "store_page_none": lambda s: s.page(service="none", limit=5),
    "store_filter_time": lambda s: s.export(**FILTERS["filter_time"]),
    "store_export": lambda s: s.export(),
    "store_agg_1m": lambda s: s.aggregate(**AGGREGATES["agg_1m"]),
    "store_agg_1h_service": lambda s: s.aggregate(**AGGREGATES["agg_1h_service"]),
    "store_agg_filtered": lambda s: s.aggregate(**AGGREGATES["agg_filtered"]),
    "store_partitions": lambda s: s.partition_statistics().select(
        "partition_name",
        F.col("range_start").cast("string").alias("range_start"),
        F.col("range_end").cast("string").alias("range_end"),
        "rows",
        iso_millis(F.col("min_ts")).alias("min_ts"),
        iso_millis(F.col("max_ts")).alias("max_ts"),
    ),
}


_indexed_stores: dict[tuple[str, str], LogStore] = {}


def _indexed_store(spark: SparkSession, sf_dir: str) -> LogStore:
    """All events in a store with a past, stored once per session.

    Errors came first, then an attribute was promoted; other rows but debug ones followed, all were
    indexed, one day was compacted, the first two days expired, and debug rows came last, in a load
    that was repeated and is not indexed.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexed_stores:
        store_ = LogStore(spark, fresh_name("tallylog"))
        logs, level = event_logs.logs_from_events(spark, sf_dir), F.col("level")
        store_.logs.append(logs.where(level == "error"), "errors")
        store_.promote(["vip"])
        store_.logs.append(logs.where(level.isin("warn", "info")), "others")
        store_.index()
        store_.compact(date(2024, 1, 5))
        store_.expire(date(2024, 2, 2), days=30)
        late = logs.where((level == "debug") & (F.col("ts") >= "2024-01-03"))
        store_.logs.append(late.where(F.col("service") < "svc-3"), "debug")
        store_.logs.append_missing(late, "debug")
        _indexed_stores[key] = store_
    return _indexed_stores[key]


UNALIGNED = {"start": "2024-01-03T10:20:30.5Z", "end": "2024-01-29T12:34:56Z"}

INDEXED_CALLS: dict[str, Callable[[LogStore], DataFrame]] = {
    "store_filter_message_indexed": lambda s: s.export(q="PURCHASE_4"),
    "store_filter_message_indexed_wildcard": lambda s: s.export(q="err%_4_ 100\\%"),
    "store_filter_message_indexed_short": lambda s: s.export(q="9 "),
    "store_filter_attr_promoted": lambda s: s.export(attributes={"vip": "true"}),
    "store_filter_attr_unpromoted": lambda s: s.export(attributes={"k": "69"}),
    "store_filter_attr_mixed": lambda s: s.export(attributes={"vip": "false", "k": "69"}, level="error"),
    "store_agg_1m_rollup": lambda s: s.aggregate(bucket="1m", **MONTH),
    "store_agg_1m_level_rollup": lambda s: s.aggregate(bucket="1m", group_by="level", service="svc-2", **UNALIGNED),
    "store_agg_1h_service_rollup": lambda s: s.aggregate(bucket="1h", group_by="service", **UNALIGNED),
    "store_agg_1d_errors_rollup": lambda s: s.aggregate(bucket="1d", level="error", **UNALIGNED),
    "store_page_rollup": lambda s: s.page(50, service="svc-3", level="error"),
    "store_page_rollup_next": lambda s: s.page(cursor=s.query(50, level="warn")["next_cursor"], limit=50, level="warn"),
}


def _store_query(call: Callable[[LogStore], DataFrame], of=_store) -> Query:
    return lambda spark, sf_dir: call(of(spark, sf_dir))


for _name, _call in STORE_CALLS.items():
    query(_name)(_store_query(_call))
for _name, _call in INDEXED_CALLS.items():
    query(_name)(_store_query(_call, _indexed_store))
