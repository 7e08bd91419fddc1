import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from tallylog.functions.cursors import cursor_column, decode_text
from tallylog.operators.filters import LogFilter
from tallylog.operators.paging import export_ordered, lower_bound, page
from tallylog.sources.event_logs import logs_from_events

SMALL = "/root/testdata/sf0.001"


def walk(fetch):
    """Follow cursors to the end."""
    ids, cursor = [], None
    while True:
        result = fetch(cursor)
        ids += [row["id"] for row in result["logs"]]
        cursor = result["next_cursor"]
        if cursor is None:
            return ids


def test_pages_and_export_give_the_same_order(spark, new_store):
    store = new_store()
    store.logs.append(logs_from_events(spark, SMALL), "load")
    pages = walk(lambda cursor: store.query(limit=300, cursor=cursor))
    exported = [row.id for row in store.export().collect()]
    assert pages == exported
    assert len(set(pages)) == 1000


def test_ties_and_sparse_data(spark, new_store, log_rows):
    """A third of the rows share one time; others lie far apart."""
    store = new_store()
    rows = [(i, "2024-01-10T12:00:00Z", "hot") for i in range(20)]
    rows += [(100 + i, f"2024-01-{10 + i}T00:00:00.001Z", "cold") for i in range(15)]
    rows += [(200 + i, f"20{10 + i}-06-01T23:59:59.999Z", "old") for i in range(10)]
    store.logs.append(log_rows(rows), "load")
    expected = [r.id for r in store.logs.scan().orderBy(F.desc("ts"), F.desc("id")).collect()]
    for limit in (7, 44, 45, 46):
        assert walk(lambda c: store.query(limit=limit, cursor=c)) == expected
    hot = walk(lambda c: store.query(limit=9, cursor=c, service="hot"))
    assert hot == [r.id for r in store.logs.scan().where("service = 'hot'").orderBy(F.desc("id")).collect()]
    assert store.query(service="none") == {"logs": [], "next_cursor": None}


def test_rows_from_the_first_years(spark, new_store, log_rows):
    store = new_store()
    times = ["0001-01-01T00:00:00Z", "0001-01-01T00:00:00+01:00", "2024-01-01T00:00:00Z"]
    store.logs.append(log_rows([(i, t, "s") for i, t in enumerate(times)]), "load")
    assert [r.message for r in store.page(limit=3).collect()] == ["m2", "m0", "m1"]
    assert [r.message for r in store.page(limit=1, end="2023-01-01").collect()] == ["m0"]


def test_exactly_one_page_has_no_cursor(spark, log_rows):
    rows = log_rows([(i, f"2024-01-01T00:00:0{i}Z", "s") for i in range(3)])
    full = page(rows, LogFilter(), 3).collect()
    assert [r.message for r in full] == ["m2", "m1", "m0"] and full[0].next_cursor is None
    part = page(rows, LogFilter(), 2).collect()
    assert [r.message for r in part] == ["m2", "m1"] and part[0].next_cursor == part[1].next_cursor
    cursor = decode_text(part[0].next_cursor)
    assert [r.message for r in page(rows, LogFilter(cursor=cursor), 2).collect()] == ["m0"]


def test_lower_bound_is_the_time_of_the_last_row_needed(spark, new_store):
    store = new_store()
    store.logs.append(logs_from_events(spark, SMALL), "load")
    logs, span = store.logs.scan(), store.logs.time_range()
    times = [r[0] for r in logs.select(F.unix_micros("ts")).orderBy(F.desc("ts")).collect()]
    for limit in (1, 10, 999):
        bound = lower_bound(logs, LogFilter(), limit, *span)
        assert bound.found == limit + 1 and int(bound.since.timestamp() * 1e6) == times[limit]
    fewer = lower_bound(logs, LogFilter(), 1000, *span)
    assert fewer.found == 1000 and int(fewer.since.timestamp() * 1e6) == times[-1]
    assert lower_bound(logs, LogFilter(service="none"), 5, *span) == (0, None)


def test_each_widening_reads_its_own_span(spark, new_store, monkeypatch):
    store = new_store()
    store.logs.append(logs_from_events(spark, SMALL), "load")
    tried = []
    apply = LogFilter.apply
    monkeypatch.setattr(LogFilter, "apply", lambda self, logs: tried.append((self.start, self.end)) or apply(self, logs))
    lower_bound(store.logs.scan(), LogFilter(service="none"), 5, *store.logs.time_range())
    assert len(tried) > 2 and all(late[0] == early[1] for late, early in zip(tried, tried[1:], strict=False))


def test_sparse_pages_are_bounded(spark, new_store):
    store = new_store()
    store.logs.append(logs_from_events(spark, SMALL), "load")
    out = io.StringIO()
    with redirect_stdout(out):
        store.page(service="none", limit=5).explain("formatted")
    assert "Scan parquet" not in out.getvalue()
    newest = store.query(limit=3)["logs"]
    out = io.StringIO()
    with redirect_stdout(out):
        store.page(start=newest[-1]["timestamp"], limit=50).explain("formatted")
    assert out.getvalue().count("day=2024-01-") == 1
    assert len(store.query(start=newest[-1]["timestamp"], limit=50)["logs"]) == 3
    assert store.query(end="0001-01-01")["logs"] == store.query(end="0000-01-01")["logs"] == []


def test_page_opens_only_the_newest_day(spark, new_store):
    store = new_store()
    store.logs.append(logs_from_events(spark, SMALL), "load")
    out = io.StringIO()
    with redirect_stdout(out):
        store.page(limit=5).explain("formatted")
    plan = out.getvalue()
    assert "PartitionFilters: [isnotnull(day" in plan
    assert "TakeOrderedAndProject" in plan
    assert "GreaterThanOrEqual(ts," in plan
    assert plan.count("day=2024-01-") == 1


def test_cursor_condition_reaches_the_scan(spark, new_store):
    store = new_store()
    store.logs.append(logs_from_events(spark, SMALL), "load")
    cursor = store.query(limit=500)["next_cursor"]
    out = io.StringIO()
    with redirect_stdout(out):
        LogFilter().after(cursor).apply(store.logs.scan()).explain("formatted")
    plan = out.getvalue()
    assert "LessThanOrEqual(ts," in plan and "Or(LessThan(ts," in plan and "LessThan(id," in plan
    assert "PartitionFilters: [isnotnull(day" in plan


@pytest.mark.parametrize("damage", [lambda c: c[:-10], lambda c: c[::-1], lambda c: "!" + c, lambda c: c + "A"])
def test_damaged_cursors(spark, log_rows, damage):
    rows = log_rows([(1, "2024-01-01T00:00:00.123Z", "s")])
    cursor = rows.select(cursor_column(F.col("ts"), F.col("id")).alias("c"), "id").first()
    good = decode_text(cursor.c)
    assert good.id == cursor.id and good.ts.isoformat() == "2024-01-01T00:00:00.123000+00:00"
    assert decode_text(cursor.c + "=") == good
    assert decode_text(damage(cursor.c)) is None


def test_export_is_range_partitioned(spark):
    out = io.StringIO()
    with redirect_stdout(out):
        export_ordered(logs_from_events(spark, SMALL)).explain()
    assert "rangepartitioning(ts" in out.getvalue()
