"""One writer at a time, and what stands in for one that stopped."""

import threading
import time
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallylog.functions.timestamps import parse_iso_text
from tallylog.session import fresh_name
from tallylog.sources import lease as lease_module
from tallylog.sources.event_logs import AS_OF, bodies_from_events, logs_from_events
from tallylog.sources.lease import Lease, TableBusy

SMALL = "/root/testdata/sf0.001"


def test_only_one_holds_it(spark):
    name = fresh_name("table")
    with Lease(spark, name):
        with pytest.raises(TableBusy, match=name), Lease(spark, name, wait=0.2):
            pass
    with Lease(spark, name, wait=0.2):
        pass


def test_many_threads_take_turns(spark):
    name, inside, most, errors = fresh_name("table"), [0], [0], []

    def work():
        try:
            for _ in range(3):
                with Lease(spark, name, wait=60):
                    inside[0] += 1
                    most[0] = max(most[0], inside[0])
                    time.sleep(0.01)
                    inside[0] -= 1
        except Exception as error:
            errors.append(error)

    threads = [threading.Thread(target=work) for _ in range(5)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert most == [1] and not errors


def test_a_lease_that_is_not_renewed_is_taken_over(spark, monkeypatch):
    name = fresh_name("table")
    stalled = Lease(spark, name, held=0.3)
    monkeypatch.setattr(Lease, "_renew", lambda self: None)
    stalled.__enter__()
    with Lease(spark, name, wait=5) as second:
        with pytest.raises(TableBusy, match="ended while"):
            stalled.check()
        stalled.__exit__()
        second.check()


def test_a_long_write_keeps_its_lease(spark):
    name = fresh_name("table")
    with Lease(spark, name, held=0.6) as first:
        time.sleep(1.5)
        first.check()
        with pytest.raises(TableBusy), Lease(spark, name, wait=0.1):
            pass


def test_two_loads_at_once_both_end_whole(spark, new_store):
    """Two ingests and a compaction from threads of their own."""
    store, now, errors = new_store(), parse_iso_text(AS_OF), []
    store.logs.append(logs_from_events(spark, SMALL), "before")

    def run(action):
        try:
            action()
        except Exception as error:
            errors.append(error)

    actions = [lambda n=n: store.ingest(bodies_from_events(spark, SMALL), as_of=now, load=f"load {n}") for n in range(2)]
    actions.append(lambda: store.compact(date(2024, 1, 5)))
    threads = [threading.Thread(target=run, args=(action,)) for action in actions]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert not errors
    loads = {r["load"]: r["n"] for r in store.logs.scan().groupBy("load").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert loads == {"before": 1000, "load 0": 550, "load 1": 550}
    assert store.rejects.scan().count() == 900
    assert store.deliveries.scan().count() == 20


def test_a_writer_that_can_not_wait_is_refused(spark, new_store, monkeypatch):
    store = new_store()
    monkeypatch.setattr(lease_module.Lease, "__init__", _impatient(lease_module.Lease.__init__))
    with store.logs.lease():
        with pytest.raises(TableBusy, match="another writer"):
            store.logs.append(logs_from_events(spark, SMALL), "x")
    assert store.logs.append(logs_from_events(spark, SMALL), "x") == 1000


def _impatient(init):
    return lambda self, spark, name: init(self, spark, name, wait=0.2)
