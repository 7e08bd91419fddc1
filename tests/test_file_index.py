"""Skipping files by trigrams, promoted attributes, counts per file, and page bounds from them."""

import io
import random
import re
from contextlib import redirect_stdout
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallylog.functions.ids import uuid_from
from tallylog.functions.patterns import literal_parts
from tallylog.functions.timestamps import parse_iso
from tallylog.operators import aggregation, paging
from tallylog.operators.filters import LogFilter
from tallylog.sources import file_index
from tallylog.sources.file_index import FileIndex, trigram_codes

MONTH = {"start": "2024-01-01", "end": "2024-02-01"}


def log_frame(spark, rows):
    """Rows of (time, service, level, message, attributes)."""
    frame = spark.createDataFrame(
        [(n, *row) for n, row in enumerate(rows)],
        "n int, time string, service string, level string, message string, attr map<string,string>",
    )
    return frame.select(
        uuid_from(F.col("n"), F.col("message")).alias("id"),
        parse_iso(F.col("time")).alias("ts"),
        "level",
        "service",
        "message",
        F.coalesce(F.to_json("attr"), F.lit("{}")).alias("attributes"),
        F.coalesce("attr", F.expr("cast(map() as map<string,string>)")).alias("attr"),
    )


def scanned_files(frame):
    """How many files the scans of a query open, once it has run."""
    frame.collect()
    found = []

    def walk(node):
        name = node.getClass().getName()
        if "AdaptiveSparkPlan" in name:
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        if node.metrics().contains("numFiles"):
            found.append(node.metrics().apply("numFiles").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(frame._jdf.queryExecution().executedPlan())
    return sum(found)


def messages(frame):
    return sorted(r.message for r in frame.collect())


def plan_of(frame):
    out = io.StringIO()
    with redirect_stdout(out):
        frame.explain("formatted")
    return out.getvalue()


@pytest.fixture
def three_days(spark, new_store):
    store = new_store()
    texts = {1: ["Connection REFUSED by peer", "ok"], 2: ["disk full", "İstanbul çay"], 3: ["timeout: peer gone", "x"]}
    for day, found in texts.items():
        rows = [(f"2024-01-0{day}T0{i}:00:00Z", "s", "info", text, None) for i, text in enumerate(found)]
        store.logs.append(log_frame(spark, rows), f"day {day}")
    assert store.index() == 3 and store.index() == 0
    return store


def test_files_without_the_text_are_not_opened(three_days):
    for q, expected, files in [
        ("refused", ["Connection REFUSED by peer"], 1),
        ("PEER", ["Connection REFUSED by peer", "timeout: peer gone"], 2),
        ("ÇAY", ["İstanbul çay"], 1),
        ("con%peer", ["Connection REFUSED by peer"], 1),
        ("nothing like it", [], 0),
        ("sk_full", ["disk full"], 1),
    ]:
        found = three_days.export(q=q)
        assert (messages(found), scanned_files(found)) == (expected, files), q


def test_short_texts_read_all_files(three_days):
    for q, expected in [("ok", ["ok"]), ("x", ["x"]), ("f_l", ["disk full"]), ("%", 6), ("i_k", ["disk full"])]:
        found = three_days.export(q=q)
        assert messages(found) == expected if isinstance(expected, list) else found.count() == expected
        assert scanned_files(found) == 3


def test_search_is_bounded_by_time_too(three_days):
    found = three_days.export(q="peer", start="2024-01-02", end="2024-01-04")
    assert messages(found) == ["timeout: peer gone"] and scanned_files(found) == 1
    counted = three_days.aggregate(q="peer", bucket="1d", **MONTH)
    assert [(r.start[:10], r["count"]) for r in counted.collect()] == [("2024-01-01", 1), ("2024-01-03", 1)]
    assert [e["message"] for e in three_days.query(q="peer", limit=1)["logs"]] == ["timeout: peer gone"]


def test_new_files_are_read_until_they_are_indexed(spark, three_days):
    three_days.logs.append(log_frame(spark, [("2024-01-02T05:00:00Z", "s", "info", "late peer", None)]), "late")
    found = three_days.export(q="peer")
    assert len(messages(found)) == 3 and scanned_files(found) == 3
    found = three_days.export(q="gone")
    assert messages(found) == ["timeout: peer gone"] and scanned_files(found) == 2
    assert three_days.index() == 1
    assert scanned_files(three_days.export(q="gone")) == 1


def test_compaction_and_expiry_keep_searches_right(spark, three_days):
    three_days.logs.append(log_frame(spark, [("2024-01-02T05:00:00Z", "s", "info", "late peer", None)]), "late")
    three_days.index()
    assert three_days.compact(date(2024, 1, 2)) == 3
    assert messages(three_days.export(q="disk")) == ["disk full"]
    assert scanned_files(three_days.export(q="disk")) == 1
    assert three_days.expire(date(2024, 2, 1), days=30) == ["logs_2024_01_01"]
    assert messages(three_days.export(q="peer")) == ["late peer", "timeout: peer gone"]
    assert three_days.aggregate(bucket="1d", **MONTH).agg(F.sum("count")).first()[0] == 5
    # The day comes back with other rows.
    three_days.logs.append(log_frame(spark, [("2024-01-01T05:00:00Z", "s", "info", "a new peer", None)]), "again")
    assert len(messages(three_days.export(q="peer"))) == 3
    three_days.index()
    assert len(messages(three_days.export(q="peer"))) == 3
    assert three_days.aggregate(bucket="1d", **MONTH).agg(F.sum("count")).first()[0] == 6


def test_a_build_that_failed_is_not_used(spark, three_days, monkeypatch):
    three_days.logs.append(log_frame(spark, [("2024-01-02T05:00:00Z", "s", "info", "late peer", None)]), "late")
    write = file_index.write_rows

    def fail(rows, table, **options):
        if table.endswith("indexed_files"):
            raise OSError("lost")
        return write(rows, table, **options)

    with monkeypatch.context() as patch:
        patch.setattr(file_index, "write_rows", fail)
        with pytest.raises(OSError):
            three_days.index()
    count = three_days.aggregate(bucket="1d", **MONTH)
    assert sum(r["count"] for r in count.collect()) == 7
    assert three_days.index() == 1
    assert sum(r["count"] for r in three_days.aggregate(bucket="1d", **MONTH).collect()) == 7
    assert len(messages(three_days.export(q="peer"))) == 3


def test_another_session_object_sees_the_index(three_days):
    again = FileIndex(three_days.spark, three_days.logs.name.partition(".")[0], three_days.logs)
    assert len(again.coverage(LogFilter()).builds) == 3
    assert again.matching_files(LogFilter(q="disk full")) is not None


def test_trigrams_and_literal_parts():
    def texts(codes):
        return sorted("".join(chr(code >> shift & 0x1FFFFF) for shift in (42, 21, 0)) for code in codes.tolist())

    assert texts(trigram_codes("abcab")) == ["abc", "bca", "cab"]
    assert texts(trigram_codes("a😀é" + file_index.SEPARATOR + "xyz")) == ["a😀é", "xyz"]
    assert texts(trigram_codes("ab")) == [] and texts(trigram_codes("")) == []
    assert literal_parts("100\\% d%o_e") == ["100% d", "o", "e"]
    assert literal_parts("plain") == ["plain"] and literal_parts("%_%") == [] and literal_parts("") == []
    assert literal_parts("end\\") == ["end%"]


def test_trigrams_are_handed_on_in_parts(spark, new_store, monkeypatch):
    store = new_store()
    draw = random.Random(1)
    texts = ["".join(draw.choice("abcdefgh") for _ in range(40)) for _ in range(200)]
    store.logs.append(log_frame(spark, [(f"2024-01-0{1 + i % 4}", "s", "info", t, None) for i, t in enumerate(texts)]), "x")
    monkeypatch.setattr(file_index, "FILES_AT_ONCE", 2)
    assert store.index() == 4
    assert spark.table(store.files.files).select("build").distinct().count() == 2
    for text in texts[:6]:
        assert messages(store.export(q=text[3:30].upper())) == [text]
    hourly = store.aggregate(bucket="1h", **MONTH)
    assert sum(r["count"] for r in hourly.collect()) == 200


# --- Promoted attributes ---


def attribute_rows(values):
    return [(f"2024-01-0{1 + i % 2}", "s", "info", f"m{i}", attr) for i, attr in enumerate(values)]


def test_promoted_attributes(spark, new_store):
    store = new_store()
    before = [{"vip": "true", "k": "1"}, {"vip": "false"}, None]
    after = [{"vip": "true", "it's \\ odd": "x"}, {"k": "1"}, {"vip": "1.5", "k": "2"}]
    store.logs.append(log_frame(spark, attribute_rows(before)), "a")
    assert store.promote(["vip", "it's \\ odd"]) == ["vip", "it's \\ odd"]
    store.logs.append(log_frame(spark, [(t, s, lv, "n" + m, a) for t, s, lv, m, a in attribute_rows(after)]), "b")
    assert store.promote(["k", "vip"]) == ["vip", "it's \\ odd", "k"] == store.logs.promoted()

    def check():
        for attributes, expected in [
            ({"vip": "true"}, ["m0", "nm0"]),
            ({"vip": "1.5"}, ["nm2"]),
            ({"it's \\ odd": "x"}, ["nm0"]),
            ({"k": "1"}, ["m0", "nm1"]),
            ({"vip": "true", "k": "1"}, ["m0"]),
            ({"vip": "true", "absent": "x"}, []),
        ]:
            assert messages(store.export(attributes=attributes)) == expected, attributes
        assert [e["message"] for e in store.query(attributes={"vip": "true"}, level="info")["logs"]] != []

    check()
    for number in (1, 2):
        store.compact(date(2024, 1, number))
    check()
    assert store.logs.scan().where("promoted < 3").count() == 0


def test_promoted_filter_reaches_the_scan(spark, new_store):
    store = new_store()
    store.promote(["vip"])
    store.logs.append(log_frame(spark, attribute_rows([{"vip": "true", "k": "1"}, {"vip": "false"}])), "a")
    plan = plan_of(store.export(attributes={"vip": "true"}))
    assert re.search(r"PushedFilters: \[.*EqualTo\(promoted_1,true\)", plan)
    assert "EqualTo(promoted_1" not in plan_of(store.export(attributes={"k": "1"}))


def test_frequent_attributes(spark, new_store):
    store = new_store()
    rows = [{"a": "1", "b": "1"}] * 3 + [{"a": "1"}] * 4 + [{"rare": "1"}]
    store.logs.append(log_frame(spark, attribute_rows(rows)), "a")
    assert store.logs.frequent_attributes(5, 0.3) == ["a", "b"] and store.logs.frequent_attributes(1, 0.0) == ["a"]
    assert store.promote(most=1) == ["a"]


# --- Counts and page bounds ---


@pytest.fixture
def random_rows():
    draw = random.Random(3)
    return [
        (
            f"2024-01-{draw.choice([1, 1, 2, 9]):02}T{draw.randrange(24):02}:{draw.randrange(60):02}:{draw.randrange(60):02}.{draw.randrange(1000):03}Z",
            draw.choice(["a", "b"]),
            draw.choice(["info", "error"]),
            f"m{i}",
            None,
        )
        for i in range(400)
    ]


@pytest.fixture
def half_indexed(spark, new_store, random_rows):
    store = new_store()
    frame = log_frame(spark, random_rows)
    store.logs.append(frame.where("crc32(message) % 3 = 0"), "one")
    store.logs.append(frame.where("crc32(message) % 3 = 1"), "two")
    store.index()
    store.logs.append(frame.where("crc32(message) % 3 = 2"), "three")
    return store


RANGES = [
    ("2024-01-01", "2024-02-01"),
    ("2024-01-01T10:00:00Z", "2024-01-01T11:00:00Z"),
    ("2024-01-01T10:15:30.5Z", "2024-01-09T20:15:30.25Z"),
    ("2024-01-01T10:15:30Z", "2024-01-01T10:15:40Z"),
    ("2023-12-31T23:59:59.999Z", "2024-01-02T00:00:00.001Z"),
    ("2025-01-01", "2025-02-01"),
]


def test_counts_equal_counted_rows(half_indexed):
    kinds = [("1m", None, {}), ("1h", "service", {}), ("1m", "level", {"service": "a"}), ("1d", None, {"level": "error"})]
    for start, end in RANGES:
        for bucket, group_by, given in kinds:
            condition = aggregation.check_aggregate(start, end, bucket, group_by, **given)
            rows = aggregation.bucket_counts(half_indexed.logs.scan(), condition, bucket, group_by)
            found = half_indexed.aggregate(start, end, bucket, group_by, **given)
            assert found.columns == rows.columns and found.dtypes == rows.dtypes
            assert found.collect() == rows.collect()


def test_counts_read_no_file_of_whole_days(spark, three_days):
    counted = three_days.aggregate(bucket="1h", group_by="service", **MONTH)
    assert "log_counts" in plan_of(counted) and three_days.logs.name not in plan_of(counted)


@pytest.mark.parametrize("refined", [0, 100_000])
def test_pages_equal_the_sorted_rows(half_indexed, monkeypatch, refined):
    monkeypatch.setattr(file_index, "REFINED_ROWS", refined)
    every = half_indexed.logs.scan().collect()
    for given in [{}, {"service": "a"}, {"level": "error", "service": "b"}, {"start": "2024-01-01T12:34:56Z", "end": "2024-01-09T03:00:00.5Z"}]:
        condition = LogFilter.of(**given)
        wanted = [
            r.id
            for r in sorted(every, key=lambda r: (r.ts, r.id), reverse=True)
            if (not condition.service or r.service == condition.service)
            and (not condition.level or r.level == condition.level)
            and (condition.start is None or condition.start.timestamp() <= r.ts.timestamp() < condition.end.timestamp())
        ]
        for indexed in (False, True):
            if indexed:
                half_indexed.index()
            got, cursor = [], None
            while True:
                found = half_indexed.query(limit=97, cursor=cursor, **given)
                got += [e["id"] for e in found["logs"]]
                cursor = found["next_cursor"]
                if cursor is None:
                    break
            assert got == wanted


def test_a_page_without_rows_opens_no_file(three_days, monkeypatch):
    def fail(*_, **__):
        raise AssertionError("searched for a bound")

    monkeypatch.setattr(paging, "lower_bound", fail)
    for given in [{"service": "none"}, {"level": "error"}, {"start": "2024-01-05"}, {"service": "s", "end": "2023-01-01"}]:
        page = three_days.page(limit=5, **given)
        assert page.collect() == [] and "Scan parquet" not in plan_of(page)
    page = three_days.page(limit=1)
    assert [r.message for r in page.collect()] == ["x"] and "(day >= 2024-01-03)" in re.sub(r"#\d+", "", plan_of(page))


def test_empty_store_has_no_index(new_store):
    store = new_store()
    assert store.index() == 0 and store.query(q="abc") == {"logs": [], "next_cursor": None}
    assert store.aggregate(bucket="1h", **MONTH).collect() == []


def test_counts_are_written_by_tasks_of_bounded_rows(spark, new_store, monkeypatch):
    monkeypatch.setattr(file_index, "COUNTS_PER_TASK", 50)
    store = new_store()
    rows = [(f"2024-01-01T{n // 60:02d}:{n % 60:02d}:00Z", f"s{n % 3}", "info", "m", None) for n in range(600)]
    store.logs.append(log_frame(spark, rows), "load")
    store.index()
    minutes = spark.table(store.files.counts).where("grain = 'minute'")
    files = [r["count"] for r in minutes.groupBy(F.col("_metadata.file_path").alias("f")).count().collect()]
    assert sum(files) == 600 and len(files) >= 8 and max(files) <= 150
    found = store.aggregate(bucket="1m", **MONTH).collect()
    assert len(found) == 600 and {r["count"] for r in found} == {1}


def test_trigrams_of_a_batch_are_those_of_its_texts():
    import pyarrow as pa

    rng = random.Random(3)
    for alphabet in ("abc", "aé😀İ"):
        texts = ["".join(rng.choices(alphabet, k=rng.randrange(7))) for _ in range(200)]
        files = [f"f{i // 70}" for i in range(200)]
        columns = [pa.array(files), pa.array([date(2024, 1, 1 + int(f[1:])) for f in files]), pa.array(["cut off", *texts])[1:]]
        batch = pa.RecordBatch.from_arrays(columns, ["file", "day", "message"])
        found = {}
        for made in file_index._file_trigrams(iter([batch.slice(0, 100), batch.slice(100)])):
            for row in made.to_pylist():
                found.setdefault((row["file"], row["day"]), []).append(row["trigram"])
        for n in range(3):
            own = file_index.SEPARATOR.join(t for t, f in zip(texts, files, strict=True) if f == f"f{n}")
            assert found[f"f{n}", date(2024, 1, 1 + n)] == trigram_codes(own).tolist()
    assert len(file_index._all_trigrams(pa.array(["ab", None, "", "abc"]))) == 1
