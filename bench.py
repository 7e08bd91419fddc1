"""Headline timings; prints one JSON line.

``queries`` holds the median seconds of each query over the tables in
``BENCH_SF_DIR``, after one warm-up run. ``stored`` holds the same for a stored
day-partitioned table of ten copies of the events (a million rows at sf0.1), ``indexed``
for the same table once its files are indexed, and ``ingest`` the validation and storage of as
many entries.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallylog.functions.ids import uuid_from
from tallylog.functions.timestamps import parse_iso_text
from tallylog.plans.log_store import LogStore
from tallylog.plans.queries import all_queries
from tallylog.session import fresh_name, shared_folder
from tallylog.sources.event_logs import AS_OF, bodies_from_events, logs_from_events

HEADLINE = [
    "agg_1m",
    "agg_1h",
    "agg_1d",
    "agg_1h_service",
    "agg_1d_level",
    "agg_filtered",
    "agg_errors",
    "filter_service",
    "filter_time",
    "filter_message",
    "filter_message_wildcard",
    "filter_message_documents",
    "filter_attr",
    "filter_combined",
    "page_first",
    "page_next",
    "export_ordered",
    "partition_inventory",
    "insert_if_absent",
    "unnest_arrays",
    "validate_reasons",
    "validate_accepted",
    "batch_outcome",
]
COPIES = 10
RUNS = 3


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        # Recording a call site for every expression takes longer than the queries.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def seconds(action, runs: int = RUNS, warm_up: bool = True) -> float:
    if warm_up:
        action()
    times = []
    for _ in range(runs):
        started = time.perf_counter()
        action()
        times.append(time.perf_counter() - started)
    return round(statistics.median(times), 3)


def consume(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session()
    known = all_queries()
    consume(known["agg_1h"](spark, sf_dir))
    timings = {name: seconds(lambda n=name: consume(known[n](spark, sf_dir))) for name in HEADLINE}

    store = LogStore(spark, fresh_name("bench"))
    copy = F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))
    copies = logs_from_events(spark, sf_dir).withColumn("copy", copy)
    copies = copies.withColumn("id", uuid_from(F.col("id"), F.col("copy")))
    started = time.perf_counter()
    rows = store.logs.append(copies, "bench")
    stored = {"rows": rows, "append": round(time.perf_counter() - started, 3)}
    month = {"start": "2024-01-01", "end": "2024-02-01"}
    day = {"start": "2024-01-10", "end": "2024-01-11"}
    cursor = store.query()["next_cursor"]
    calls = {
        "agg_1h_service": lambda: store.aggregate(bucket="1h", group_by="service", **month).collect(),
        "agg_1m": lambda: store.aggregate(bucket="1m", **month).collect(),
        "agg_filtered": lambda: store.aggregate(
            bucket="1h", group_by="level", service="svc-4", q="ok", attributes={"vip": "true"}, **month
        ).collect(),
        "page_none": lambda: store.query(service="none"),
        "agg_1m_one_day": lambda: store.aggregate(bucket="1m", **day).collect(),
        "agg_1d_errors": lambda: store.aggregate(bucket="1d", level="error", **month).collect(),
        "page_first": lambda: store.query(),
        "page_next": lambda: store.query(cursor=cursor),
        "page_filtered": lambda: store.query(service="svc-3", q="purchase", attributes={"vip": "true"}),
        "export": lambda: consume(store.export()),
    }
    stored.update({name: seconds(call) for name, call in calls.items()})
    rare = f"purchase_{store.query(q='purchase', limit=1)['logs'][0]['message'].split('_')[1][:4]}"
    searches = {
        "search": lambda: store.query(q=rare),
        "attribute": lambda: consume(store.export(attributes={"vip": "true"}, level="error")),
    }
    stored.update({name: seconds(call) for name, call in searches.items()})
    started = time.perf_counter()
    indexed = {"files": store.index(), "index": round(time.perf_counter() - started, 3)}
    indexed.update({name: seconds(call) for name, call in (calls | searches).items()})

    bodies = bodies_from_events(spark, sf_dir).withColumn("copy", copy)
    landing = f"{shared_folder(spark)}/{fresh_name('bodies')}"
    numbered = F.concat_ws("/", "batch_id", "copy").alias("batch_id")
    bodies.select(numbered, "raw").repartition(16).write.parquet(landing)
    as_of = parse_iso_text(AS_OF)
    LogStore(spark, fresh_name("warm")).ingest(bodies_from_events(spark, sf_dir), as_of=as_of)
    target = LogStore(spark, fresh_name("bench"))
    started = time.perf_counter()
    accepted, rejected = target.ingest(spark.read.parquet(landing), as_of=as_of)
    took = time.perf_counter() - started
    ingest = {
        "entries": accepted + rejected,
        "seconds": round(took, 3),
        "entries_per_second": round((accepted + rejected) / took),
    }

    live = LogStore(spark, fresh_name("bench"))
    arriving = f"{shared_folder(spark)}/{fresh_name('arriving')}"
    one = bodies_from_events(spark, sf_dir)
    one.limit(1).coalesce(1).write.parquet(arriving)
    stream = spark.readStream.schema(one.schema).parquet(arriving)
    running = live.stream(stream, fresh_name("live"), as_of=as_of, interval="1 second")
    delays, loaded = [], []
    for _ in range(3):
        rows = live.logs.scan().count()
        one.coalesce(4).write.mode("append").parquet(arriving)
        started = time.perf_counter()
        while live.logs.scan().count() == rows and time.perf_counter() - started < 60:
            if not running.isActive:
                raise running.exception() or RuntimeError("the stream stopped")
            loaded.append(seconds(calls["agg_1h_service"], runs=1, warm_up=False))
        delays.append(round(time.perf_counter() - started, 3))
    # Stopped in the middle of a batch, Spark matches the interrupted call's long message by a pattern that overflows its stack.
    running.processAllAvailable()
    running.stop()
    ingest["seconds_to_visible"] = statistics.median(delays)
    ingest["agg_1h_service_meanwhile"] = statistics.median(loaded) if loaded else None

    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
                "stored": stored,
                "indexed": indexed,
                "ingest": ingest,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
