import json

from pyspark.sql import functions as F

from tallylog.functions.timestamps import parse_iso_text
from tallylog.operators.paging import page_rows
from tallylog.session import fresh_name, shared_folder
from tallylog.sources.envelopes import stream_bodies
from tallylog.sources.event_logs import AS_OF, bodies_from_events

SMALL = "/root/testdata/sf0.001"
NOW = parse_iso_text(AS_OF)


def bodies_folder(spark, parts):
    folder = f"{shared_folder(spark)}/{fresh_name('landing')}"
    bodies_from_events(spark, SMALL).repartition(parts).write.parquet(folder)
    return folder


def body_stream(spark, folder, files_per_trigger=2):
    reader = spark.readStream.schema("batch_id bigint, raw string")
    return reader.option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def rows_of(store):
    accepted = sorted(tuple(r) for r in page_rows(store.logs.scan()).collect())
    rejected = sorted(
        tuple(r) for r in store.rejects.scan().select("batch_id", "index", "reason").collect()
    )
    return accepted, rejected


def run(store, stream, name, **options):
    query = store.stream(stream, name, as_of=NOW, available_now=True, **options)
    query.awaitTermination()
    return query


def test_stream_equals_batch(spark, new_store):
    batch = new_store()
    batch.ingest(bodies_from_events(spark, SMALL), as_of=NOW)
    streamed = new_store()
    query = run(streamed, body_stream(spark, bodies_folder(spark, 4), 1), fresh_name("s"))
    assert query.lastProgress["batchId"] >= 1
    seen = [p["observedMetrics"]["validation"] for p in query.recentProgress if p["numInputRows"]]
    assert sum(m["accepted"] for m in seen) == 550 and sum(m["rejected"] for m in seen) == 450
    assert rows_of(streamed) == rows_of(batch)
    assert len(rows_of(batch)[0]) == 550


def test_replay_adds_nothing_and_new_files_continue(spark, new_store):
    folder, name = bodies_folder(spark, 3), fresh_name("s")
    store = new_store()
    run(store, body_stream(spark, folder), name)
    before = rows_of(store)

    # The same name from an empty checkpoint repeats every micro-batch number.
    # Only the first of them is taken for a replay, so one trigger takes all.
    whole = new_store()
    run(whole, body_stream(spark, folder, 100), name, checkpoint=f"{folder}-a")
    run(whole, body_stream(spark, folder, 100), name, checkpoint=f"{folder}-b")
    assert rows_of(whole) == before

    # The kept checkpoint finds nothing new, then only the new file.
    run(store, body_stream(spark, folder), name)
    assert rows_of(store) == before
    extra = spark.createDataFrame(
        [(999, '{"logs":[{"timestamp":"2024-01-31","level":"warn","service":"late","message":"m"},7]}')],
        "batch_id bigint, raw string",
    )
    extra.write.mode("append").parquet(folder)
    run(store, body_stream(spark, folder), name)
    accepted, rejected = rows_of(store)
    assert len(accepted) == len(before[0]) + 1
    assert ("999", 1, "entry must be a JSON object") in rejected


def test_batch_cut_short_is_completed(spark, new_store):
    """The accepted rows of half the bodies were written before the crash."""
    from tallylog.operators.validation import accepted_entries, validate
    from tallylog.sources.envelopes import explode_entries, parse_envelopes

    folder, name = bodies_folder(spark, 2), fresh_name("s")
    store = new_store()
    bodies = spark.read.parquet(folder).where("batch_id < 5")
    done = accepted_entries(validate(explode_entries(parse_envelopes(bodies)), NOW))
    store.logs.append(done, f"{name}/{0:012d}")
    run(store, body_stream(spark, folder, 100), name)
    accepted, rejected = rows_of(store)
    assert (len(accepted), len(rejected)) == (550, 450)
    assert len({row[0] for row in accepted}) == 550


def test_files_as_they_arrive_and_late_rows(spark, new_store, tmp_path):
    """Whole-file bodies; current time guards the future; old rows find their day."""
    good = {"timestamp": "2001-02-03T04:05:06.789Z", "level": "info", "service": "s", "message": "m"}
    ahead = {**good, "timestamp": "2999-01-01T00:00:00Z"}
    (tmp_path / "a.json").write_text(json.dumps({"logs": [good, ahead]}, indent=1))
    (tmp_path / "b.json").write_text("not json")
    store = new_store()
    name = fresh_name("files")
    for _ in range(2):
        store.stream(stream_bodies(spark, str(tmp_path)), name, available_now=True).awaitTermination()
    rows = store.logs.scan().collect()
    assert [(str(r.day), r.attributes) for r in rows] == [("2001-02-03", "{}")]
    reasons = store.rejects.scan().select("index", "reason", "raw", F.col("load")).collect()
    assert {(r["index"], r.reason) for r in reasons} == {
        (1, "timestamp must not be more than five minutes in the future"),
        (None, "request body must be a JSON object with a non-empty 'logs' array"),
    }
    assert {r.raw for r in reasons if r["index"] is None} == {"not json"}


def test_running_stream_is_queryable_while_it_runs(spark, new_store):
    folder = bodies_folder(spark, 2)
    store = new_store()
    query = store.stream(
        body_stream(spark, folder), fresh_name("live"), as_of=NOW, interval="1 second"
    )
    try:
        query.processAllAvailable()
        assert store.logs.scan().count() == 550
        assert len(store.query(limit=1000)["logs"]) == 550
    finally:
        query.stop()
