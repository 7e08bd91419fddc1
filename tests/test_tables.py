import io
import logging
import re
from contextlib import redirect_stdout
from datetime import date

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tallylog.functions.ids import uuid_from
from tallylog.functions.timestamps import parse_iso, parse_iso_text
from tallylog.operators import ingest, retention
from tallylog.operators.filters import LogFilter
from tallylog.sources.event_logs import AS_OF, bodies_from_events, logs_from_events

SMALL = "/root/testdata/sf0.001"


def test_store_end_to_end(spark, new_store):
    store = new_store()
    assert store.ingest(bodies_from_events(spark, SMALL), as_of=parse_iso_text(AS_OF)) == (550, 450)
    assert store.rejects.scan().count() == 450
    outcomes = store.outcomes(bodies_from_events(spark, SMALL), as_of=parse_iso_text(AS_OF)).collect()
    assert {(r.accepted, r.rejected, r.outcome) for r in outcomes} == {(55, 45, "accepted")}
    found = store.query(service="s", limit=5)
    assert len(found["logs"]) == 5 and isinstance(found["logs"][0]["attributes"], dict)
    hourly = store.aggregate(start="2024-01-01", end="2024-02-01", bucket="1h").collect()
    assert sum(row["count"] for row in hourly) == 550
    assert store.partition_statistics().agg(F.sum("rows")).first()[0] == 550
    wide = store.aggregate(start="2024-01-01", end="2024-02-01", bucket="1d", count_type="bigint")
    assert dict(wide.dtypes)["count"] == "bigint"


def test_rows_are_in_their_day_and_files_are_sorted(spark, new_store):
    store = new_store()
    store.logs.append(logs_from_events(spark, SMALL), "load")
    wrong = store.logs.scan().where(F.to_date("ts") != F.col("day"))
    assert wrong.count() == 0
    located = store.logs.scan().select(
        F.col("_metadata.file_path").alias("file"),
        F.regexp_extract(F.col("_metadata.file_path"), r"day=([^/]+)", 1).alias("folder"),
        F.col("day").cast("string").alias("day"),
    )
    assert located.where("folder != day").count() == 0
    placed = store.logs.scan().select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"), "service", "ts"
    )
    rows = [tuple(r) for r in placed.orderBy("file", "place").collect()]
    assert all(a[2:] <= b[2:] for a, b in zip(rows, rows[1:], strict=False) if a[0] == b[0])


def test_compaction_keeps_the_rows(spark, new_store):
    store, logs = new_store(), logs_from_events(spark, SMALL)
    for number in range(4):
        store.logs.append(logs.where(F.crc32("id") % 4 == number), f"load {number}")
    before = sorted(map(tuple, store.logs.scan().drop("attr", "ingested_at").collect()))
    day = F.col("day") == F.lit("2024-01-05")
    files = store.logs.scan().where(day).select("_metadata.file_path").distinct
    held = store.logs.scan().where(day).count()
    assert files().count() == 4
    assert store.compact(date(2024, 1, 5)) == held and store.compact(date(1999, 1, 1)) == 0
    assert store.logs.scan().where(day).select("_metadata.file_path").distinct().count() == 1
    assert sorted(map(tuple, store.logs.scan().drop("attr", "ingested_at").collect())) == before


def test_the_same_load_is_stored_once(spark, new_store):
    store, bodies, now = new_store(), bodies_from_events(spark, SMALL), parse_iso_text(AS_OF)
    assert store.ingest(bodies, as_of=now, load="x") == (550, 450)
    assert store.ingest(bodies, as_of=now, load="x") == (0, 0)
    assert store.logs.scan().count() == 550 and store.rejects.scan().count() == 450


def test_a_load_cut_short_is_completed(spark, new_store, monkeypatch):
    store, bodies, now = new_store(), bodies_from_events(spark, SMALL), parse_iso_text(AS_OF)

    def fail(*_):
        raise OSError("disk full")

    with monkeypatch.context() as patch:
        patch.setattr(type(store.rejects), "append_missing", fail)
        with pytest.raises(OSError):
            store.ingest(bodies, as_of=now, load="x")
    assert store.logs.scan().count() == 550 and store.rejects.scan().count() == 0
    assert store.ingest(bodies, as_of=now, load="x") == (0, 450)
    assert store.logs.scan().count() == 550


def test_outcomes_can_be_combined(spark, new_store):
    store, bodies, now = new_store(), bodies_from_events(spark, SMALL), parse_iso_text(AS_OF)
    both = store.outcomes(bodies, as_of=now).union(store.outcomes(bodies, as_of=now))
    assert both.count() == 20


def test_a_hot_day_is_written_by_several_tasks(spark, new_store):
    store = new_store()
    many = spark.range(60_000).select(
        F.concat(F.lit("2024-01-10T12:00:00."), F.lpad(F.col("id") % 1000, 3, "0"), F.lit("Z")).alias("time"),
        F.col("id").cast("int").alias("n"),
    )
    rows = many.select(
        uuid_from(F.col("n")).alias("id"),
        parse_iso(F.col("time")).alias("ts"),
        F.lit("info").alias("level"),
        F.lit("hot").alias("service"),
        F.sha2(F.col("n").cast("string"), 512).alias("message"),
        F.lit("{}").alias("attributes"),
    )
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "1m")
    try:
        assert store.logs.append(rows.repartition(8), "load") == 60_000
    finally:
        spark.conf.set(key, before)
    files = store.logs.scan().select("_metadata.file_path").distinct().count()
    assert files > 3
    assert store.logs.scan().count() == 60_000


def test_time_filter_opens_only_its_days(spark, new_store):
    store = new_store()
    store.logs.append(logs_from_events(spark, SMALL), "load")
    out = io.StringIO()
    with redirect_stdout(out):
        store.aggregate(
            start="2024-01-03", end="2024-01-05", bucket="1h", group_by="service", level="error"
        ).explain("formatted")
    plan = out.getvalue()
    days = re.search(r"PartitionFilters: (.*)", plan).group(1)
    assert re.sub(r"#\d+", "", days) == "[isnotnull(day), (day >= 2024-01-03), (day <= 2024-01-04)]"
    assert "EqualTo(level,error)" in plan
    assert "ReadSchema: struct<ts:timestamp,level:string,service:string>" in plan
    assert "partial_count(1)" in plan


@pytest.mark.parametrize("column, value", [("level", "fatal"), ("service", None), ("message", None)])
def test_constraint_stops_the_write(spark, new_store, log_rows, column, value):
    store = new_store()
    rows = log_rows([(1, "2024-01-01", "s")]).withColumn(column, F.lit(value).cast("string"))
    with pytest.raises(Exception, match="constraint"):
        store.logs.append(rows, "load")
    assert store.logs.scan().count() == 0


def test_missing_rows_only(spark, new_store, log_rows):
    store = new_store()
    rows = log_rows([(i, f"2024-01-0{1 + i % 3}T00:00:00Z", "s") for i in range(9)])
    assert store.logs.append(rows.where("message < 'm4'"), "s/1") == 4
    assert store.logs.append_missing(rows, "s/1") == 5
    assert store.logs.append_missing(rows, "s/1") == 0
    # Another load with the same ids is another delivery.
    assert store.logs.append_missing(rows, "s/2") == 9
    assert store.logs.append_missing(rows.limit(0), "s/3") == 0
    assert store.logs.scan().count() == 18


def test_insert_if_absent_keeps_one_row_per_new_key(spark):
    new = spark.createDataFrame([(1, "b"), (1, "a"), (2, "x"), (3, "y")], "k int, v string")
    old = spark.createDataFrame([(2,), (2,), (9,)], "k int")
    ordered = ingest.insert_if_absent(new, old, ["k"], order=[F.col("v")])
    assert sorted((r.k, r.v) for r in ordered.collect()) == [(1, "a"), (3, "y")]
    assert sorted(r.k for r in ingest.insert_if_absent(new, old, ["k"]).collect()) == [1, 3]
    out = io.StringIO()
    with redirect_stdout(out):
        ordered.explain()
    # Each map task keeps one row per key before the shuffle.
    assert "WindowGroupLimit" in out.getvalue() and "Partial" in out.getvalue()


def test_unnest_fills_short_arrays(spark):
    frame = spark.createDataFrame([(1, [1, 2, 3], ["a"])], "b int, x array<int>, y array<string>")
    rows = ingest.unnest(frame, ["x", "y"], keep=["b"]).collect()
    assert [tuple(r) for r in rows] == [(1, 1, "a"), (1, 2, None), (1, 3, None)]


def test_defaults_fill_only_what_is_absent(spark):
    frame = spark.createDataFrame([(7, None, "{}"), (8, "given", None)], "n int, id string, attributes string")
    rows = {r.n: r for r in ingest.with_defaults(frame, key=["n"]).collect()}
    assert rows[8].id == "given" and rows[8].attributes == "{}" and rows[8].attr == {}
    assert len(rows[7].id) == 36 and rows[7].ingested_at is not None


def test_retention_boundary(spark, new_store, log_rows):
    store = new_store()
    days = ["2024-01-14T23:59:59.999Z", "2024-01-15T23:59:59.999Z", "2024-01-16", "1999-05-05", "2024-02-20"]
    store.logs.append(log_rows([(i, day, "s") for i, day in enumerate(days)]), "load")
    # The day exactly 30 days ago stays.
    as_of = date(2024, 2, 15)
    assert store.expire(as_of) == ["logs_1999_05_05", "logs_2024_01_14", "logs_2024_01_15"]
    assert store.expire(as_of) == []
    assert {r.message for r in store.logs.scan().collect()} == {"m2", "m4"}
    assert store.expire(as_of, days=0) == ["logs_2024_01_16"]


def test_rows_can_come_back_after_their_day_was_dropped(spark, new_store, log_rows):
    store = new_store()
    rows = log_rows([(1, "2024-01-01", "s")])
    store.logs.append(rows, "a")
    assert store.expire(date(2024, 3, 1)) == ["logs_2024_01_01"]
    store.logs.append(rows, "b")
    assert store.logs.scan().count() == 1
    assert store.query()["logs"][0]["timestamp"] == "2024-01-01T00:00:00.000Z"


def test_failed_retention_is_logged_and_survived(spark, new_store, caplog):
    store = new_store()
    spark.sql(f"DROP TABLE {store.logs.name}")
    with caplog.at_level(logging.ERROR):
        assert retention.run_retention(store.logs, date(2024, 3, 1)) == []
    assert "failed" in caplog.text
    with pytest.raises(AnalysisException):
        store.expire(date(2024, 3, 1))


def test_many_days_are_dropped_in_parts(spark, new_store, log_rows, monkeypatch):
    monkeypatch.setattr(retention, "DROPPED_AT_ONCE", 2)
    store = new_store()
    store.logs.append(log_rows([(i, f"2024-01-0{i}", "s") for i in range(1, 6)]), "load")
    assert len(store.expire(date(2024, 3, 1))) == 5 and store.logs.scan().count() == 0


def test_empty_store(spark, new_store):
    store = new_store()
    assert store.query() == {"logs": [], "next_cursor": None}
    assert store.aggregate(start="2024-01-01", end="2024-01-02", bucket="1m").collect() == []
    assert store.expire(date(2024, 3, 1)) == []
    assert LogFilter().apply(store.logs.scan()).count() == 0


def test_outcomes_are_stored_once(spark, new_store):
    store, now = new_store(), parse_iso_text(AS_OF)
    bodies = spark.createDataFrame(
        [(1, '{"logs":[{"timestamp":"2024-01-01","level":"info","service":"s","message":"m"}, 3]}'), (2, "[]"), (3, '{"logs":[7]}')],
        "batch_id int, raw string",
    )
    for _ in range(2):
        store.ingest(bodies, as_of=now, load="x")
    refused = "request body must be a JSON object with a non-empty 'logs' array"
    rows = store.deliveries.scan().select("batch_id", "accepted", "rejected", "outcome", "error").collect()
    assert sorted(map(tuple, rows)) == [
        ("1", 1, 1, "accepted", None),
        ("2", 0, 0, "refused", refused),
        ("3", 0, 1, "refused", None),
    ]


def test_outcome_gives_the_real_reason(spark, new_store):
    deep = '{"logs":[' + "[" * 2000 + "]" * 2000 + "]}"
    bodies = spark.createDataFrame([(1, deep)], "batch_id int, raw string")
    store = new_store()
    store.ingest(bodies)
    outcome = store.outcomes(bodies).first()
    assert outcome.error == store.rejects.scan().first().reason
    assert outcome.error.startswith("request body exceeds a limit")


def test_small_files_are_compacted_by_plan(spark, new_store, log_rows):
    store = new_store()
    for number in range(3):
        store.logs.append(log_rows([(number, "2024-01-01", "s"), (10 + number, f"2024-01-0{2 + number}", "s")]), f"l{number}")
        store.ingest(spark.createDataFrame([(number, "no")], "n int, raw string").withColumnRenamed("n", "batch_id"))
    far = date(2999, 1, 1)
    assert store.compact_small(date(2024, 1, 1), least_files=3)["logs"] == []
    done = store.compact_small(far, least_files=3)
    assert done["logs"] == [date(2024, 1, 1)]
    assert len(done["rejects"]) == len(done["outcomes"]) == 1
    for table, rows in ((store.logs, 6), (store.rejects, 3), (store.deliveries, 3)):
        assert table.scan().count() == rows
    files = store.rejects.scan().select("_metadata.file_path").distinct().count()
    assert files == 1
    assert store.compact_small(far, least_files=3) == {"logs": [], "rejects": [], "outcomes": []}


def test_reports_expire(spark, new_store):
    store = new_store()
    store.ingest(spark.createDataFrame([(1, "no")], "batch_id int, raw string"), as_of=parse_iso_text("2024-01-01"))
    store.ingest(spark.createDataFrame([(2, "no")], "batch_id int, raw string"), as_of=parse_iso_text("2024-03-01"))
    assert store.expire(date(2024, 3, 2), days=30) == []
    assert [r.batch_id for r in store.rejects.scan().collect()] == ["2"]
    assert [r.batch_id for r in store.deliveries.scan().collect()] == ["2"]


def test_reports_of_one_day_are_written_without_a_sort(spark, new_store, monkeypatch):
    from tallylog.sources import log_table

    store, sorts, write = new_store(), {}, log_table.write_rows

    def watched(rows, table, overwrite=False):
        rows.createOrReplaceTempView("written_rows")
        plan = spark.sql(f"EXPLAIN INSERT INTO {table} TABLE written_rows").first()[0]
        sorts[table.rpartition(".")[2]] = "Sort [" in plan
        return write(rows, table, overwrite)

    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    monkeypatch.setattr(log_table, "write_rows", watched)
    assert store.ingest(bodies_from_events(spark, SMALL), as_of=parse_iso_text(AS_OF)) == (550, 450)
    # The sort in the plan of the outcomes is their grouping's.
    assert sorts["logs"] and not sorts["rejects"]
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    days = [f"2024-01-{d:02d}" for d in range(1, 8)] * 3
    rows = spark.createDataFrame([(str(i), i, "r", "x", d) for i, d in enumerate(days)], "batch_id string, index int, reason string, raw string, ingested_at string")
    assert store.rejects.append(rows.withColumn("ingested_at", F.col("ingested_at").cast("timestamp")), "days") == 21
    kept = store.rejects.scan().where("load = 'days'").groupBy("day").count().collect()
    assert sorted((str(r.day), r["count"]) for r in kept) == [(d, 3) for d in sorted(set(days))]
