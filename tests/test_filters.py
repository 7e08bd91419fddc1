import pytest
from pyspark.sql import functions as F

from tallylog.functions.patterns import contains_pattern, plain_text
from tallylog.functions.timestamps import iso_millis, parse_iso_text
from tallylog.operators.aggregation import bucket_counts, check_aggregate
from tallylog.operators.filters import (
    InvalidArgument,
    LogFilter,
    aggregate_arguments,
    check_limit,
    query_arguments,
)


@pytest.mark.parametrize(
    "raw, size", [(None, 100), (1, 1), (1000, 1000), ("10", 10), ("1e2", 100), (5.0, 5), ("0x10", 16), (" 7 ", 7)]
)
def test_limit(raw, size):
    assert check_limit(raw) == size


@pytest.mark.parametrize(
    "raw, text",
    [
        ("x", "limit must be an integer"),
        (1.5, "limit must be an integer"),
        ("nan", "limit must be an integer"),
        ("1_0", "limit must be an integer"),
        ("inf", "limit must be an integer"),
        ([], "limit must be an integer"),
        (0, "limit must be between 1 and 1000"),
        ("", "limit must be between 1 and 1000"),
        (1001, "limit must be between 1 and 1000"),
        (-1, "limit must be between 1 and 1000"),
    ],
)
def test_bad_limit(raw, text):
    with pytest.raises(InvalidArgument, match=f"^{text}$"):
        check_limit(raw)


@pytest.mark.parametrize(
    "arguments, text",
    [
        ({"start": "nope", "end": "nope"}, "invalid timestamp for 'start'"),
        ({"start": "2024-01-01", "end": ""}, "invalid timestamp for 'end'"),
        ({"start": "2024-01-02", "end": "2024-01-02", "level": "x"}, "'end' must be later than 'start'"),
        ({"level": "fatal"}, "unsupported log level: 'fatal'"),
        ({"level": ""}, "unsupported log level: ''"),
    ],
)
def test_bad_query_arguments(arguments, text):
    with pytest.raises(InvalidArgument) as error:
        LogFilter.of(**arguments)
    assert str(error.value) == text


@pytest.mark.parametrize("cursor", ["abc", "e30", "W10", "é", "eyJ0cyI6MSwiaWQiOjJ9"])
def test_bad_cursor(cursor):
    with pytest.raises(InvalidArgument, match="^invalid or malformed cursor$"):
        LogFilter().after(cursor)


def test_order_of_checks(new_store):
    store = new_store()
    bad = {"start": "x", "level": "x", "limit": "x", "cursor": "x"}
    for name, text in [
        ("start", "invalid timestamp for 'start'"),
        ("level", "unsupported log level: 'x'"),
        ("limit", "limit must be an integer"),
        ("cursor", "invalid or malformed cursor"),
    ]:
        with pytest.raises(InvalidArgument) as error:
            store.query(**bad)
        assert str(error.value) == text
        del bad[name]


GOOD_AGGREGATE = {"start": "2024-01-01", "end": "2024-01-02", "bucket": "1h"}


@pytest.mark.parametrize(
    "changes, text",
    [
        ({"start": None, "end": None}, "'start' is required"),
        ({"end": None, "bucket": "2h"}, "'end' is required"),
        ({"end": "2023-01-01", "bucket": "2h"}, "'end' must be later than 'start'"),
        ({"bucket": None}, "bucket must be one of: 1m, 1h, 1d"),
        ({"bucket": "5m", "group_by": "id"}, "bucket must be one of: 1m, 1h, 1d"),
        ({"group_by": "id", "level": "x"}, "group_by must be 'service' or 'level'"),
        ({"group_by": ""}, "group_by must be 'service' or 'level'"),
        ({"level": "x"}, "unsupported log level: 'x'"),
    ],
)
def test_bad_aggregate_arguments(changes, text):
    with pytest.raises(InvalidArgument) as error:
        check_aggregate(**{**GOOD_AGGREGATE, **changes})
    assert str(error.value) == text


def test_empty_texts_are_no_filter(spark):
    assert LogFilter.of(service="", q="").after("").predicates(by_day=True) == []


MESSAGES = ["100% DONE", "100 done", "a_b", "axb", "C:\\dir", "line\nbreak", "ÉTÉ", "50%", "dd", "d"]

PATTERNS = {
    "done": {"100% DONE", "100 done"},
    "0%d": {"100% DONE", "100 done"},
    "0\\% d": {"100% DONE"},
    "a_b": {"a_b", "axb"},
    "a\\_b": {"a_b"},
    "c:\\\\D": {"C:\\dir"},
    "\\d\\d": {"dd"},
    "\\": {"50%"},
    "0\\": {"50%"},
    "\\\\": {"C:\\dir"},
    "line_break": {"line\nbreak"},
    "e%b": {"line\nbreak"},
    "été": {"ÉTÉ"},
    "%": set(MESSAGES),
    "_": set(MESSAGES),
}


@pytest.mark.parametrize("q", PATTERNS)
def test_message_patterns(spark, q):
    frame = spark.createDataFrame([(m,) for m in MESSAGES], "message string")
    found = LogFilter.of(q=q).apply(frame)
    assert {r.message for r in found.collect()} == PATTERNS[q]
    # The substring form and the general form agree.
    general = frame.where(F.col("message").ilike(contains_pattern(q)))
    assert {r.message for r in general.collect()} == PATTERNS[q]


def test_which_patterns_are_substrings():
    assert plain_text(contains_pattern("done")) == "done"
    assert plain_text(contains_pattern("0\\% \\done")) == "0% done"
    assert plain_text(contains_pattern("a_b")) is None
    assert plain_text(contains_pattern("a\\")) is None


def test_attribute_filter_with_awkward_keys(spark):
    rows = [({"a.b": "1", "q'k": "x"},), ({"a.b": "2"},), ({"q'k": None},)]
    frame = spark.createDataFrame(rows, "attr map<string,string>")
    assert LogFilter.of(attributes={"a.b": "1", "q'k": "x"}).apply(frame).count() == 1
    assert LogFilter.of(attributes={"q'k": ""}).apply(frame).count() == 0


def test_time_range_is_half_open(spark, log_rows):
    rows = log_rows([(i, f"2024-01-01T00:00:0{i}Z", "s") for i in range(4)])
    found = LogFilter.of(start="2024-01-01T00:00:01Z", end="2024-01-01T00:00:03Z").apply(rows)
    assert {r.message for r in found.collect()} == {"m1", "m2"}


def test_buckets_are_sparse_and_floor_before_1970(spark, log_rows):
    rows = log_rows(
        [
            (1, "1969-12-31T23:59:59.999Z", "a"),
            (2, "1970-01-01T00:00:00Z", "a"),
            (3, "1970-01-01T02:00:00Z", "b"),
        ]
    )
    condition = check_aggregate("1969-01-01", "1971-01-01", "1h", "service")
    assert [tuple(r) for r in bucket_counts(rows, condition, "1h", "service").collect()] == [
        ("1969-12-31T23:00:00.000Z", "a", 1),
        ("1970-01-01T00:00:00.000Z", "a", 1),
        ("1970-01-01T02:00:00.000Z", "b", 1),
    ]
    ungrouped = bucket_counts(rows, condition, "1d", None).collect()
    assert [tuple(r) for r in ungrouped] == [
        ("1969-12-31T00:00:00.000Z", None, 1),
        ("1970-01-01T00:00:00.000Z", None, 2),
    ]


def test_counts_add_up_to_the_filtered_rows(spark):
    from tallylog.sources.event_logs import logs_from_events

    logs = logs_from_events(spark, "/root/testdata/sf0.001")
    for level in (None, "error"):
        condition = check_aggregate("2024-01-05", "2024-01-20", "1m", level=level)
        total = bucket_counts(logs, condition, "1m").agg(F.sum("count")).first()[0]
        assert total == condition.apply(logs).count()


def test_scan_bound_equals_filter_on_truncated_time(spark):
    """A bound handed to the raw scan keeps the same rows as the filter alone."""
    from tallylog.sources.event_logs import logs_from_events

    whole = logs_from_events(spark, "/root/testdata/sf0.001")
    middle = whole.select(iso_millis(F.col("ts")).alias("t")).orderBy("t").collect()[500].t
    condition = LogFilter.of(start=middle)
    bounded = logs_from_events(spark, "/root/testdata/sf0.001", start=parse_iso_text(middle))
    assert condition.apply(bounded).count() == condition.apply(whole).count() == 500


def test_flat_parameters():
    given = {"service": "a", "limit": "5", "attributes.a.b": "1", "attributes.k": ["x"], "other": "y"}
    assert query_arguments(given) == {"service": "a", "limit": "5", "attributes": {"a.b": "1"}}
    assert query_arguments({"q": ["x"], "level": ["x"]}) == {"level": ["x"], "attributes": {}}
    given = {"start": "2024", "bucket": "1h", "group_by": "level", "cursor": "c"}
    assert aggregate_arguments(given) == {
        "start": "2024",
        "bucket": "1h",
        "group_by": "level",
        "attributes": {},
    }
