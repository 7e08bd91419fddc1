"""Periodic runs against a comparison of every pair of words at every distance."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from conftest import SMALL
from test_operators import DOC_SCHEMA, documents, empty, odd, odd_rows  # noqa: F401

from tallylog.llm import periodic_runs
from tallylog.llm.queries import llm_queries


def brute_runs(words):
    found = {}
    for period in range(1, len(words) // 4 + 1):
        at = 0
        while at + period < len(words):
            end = at
            while end + period < len(words) and words[end] == words[end + period]:
                end += 1
            if end - at + period >= max(6, 4 * period):
                found.setdefault((at, end - at + period), period)
            at = end + 1
    return sorted((start, length, period) for (start, length), period in found.items())


def brute_row(doc_id, text, plant):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if plant and n and doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            a = (h // 10) % n
            period = 1 + (n - a) // (3 + (h // 10) % 8)
            words = [words[i] if i < a else words[a + (i - a) % period] for i in range(n)]
    runs = brute_runs(words)
    dropped = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    listed = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    exponent = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, exponent, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept)))


def rows_of(frame):
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    return sorted((tuple(r) for r in frame.select(*names).collect()), key=str)


def digested(frame):
    from pyspark.sql import functions as F

    return frame.withColumn("collapsed_sha256", F.sha2("collapsed", 256))


def texts_with_runs(seed, count):
    """Few letters, periods of every scale, and periodic parts inside periods."""
    draw = random.Random(seed)
    for _ in range(count):
        words = []
        for _ in range(draw.randint(1, 5)):
            letters = draw.choice([2, 2, 3, 50])
            base = [draw.randrange(letters) for _ in range(draw.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 24, 31, 33, 40]))]
            if draw.random() < 0.4:
                base += [draw.randrange(2) for _ in range(draw.randint(1, 4))] * draw.randint(4, 12)
            words += base * draw.randint(1, 7) + base[: draw.randint(0, len(base))]
            words += [draw.randrange(letters) for _ in range(draw.randint(0, 10))]
        yield words


def test_runs_equal_brute_force():
    for words in texts_with_runs(1, 1500):
        assert periodic_runs.find_runs(np.array(words)) == brute_runs(words)


def test_binary_and_fibonacci_words():
    draw = random.Random(2)
    for _ in range(100):
        words = [draw.randrange(2) for _ in range(draw.randint(0, 300))]
        assert periodic_runs.find_runs(np.array(words, np.int64)) == brute_runs(words)
    a, b = [0], [0, 1]
    while len(b) < 900:
        a, b = b, b + a
    assert periodic_runs.find_runs(np.array(b)) == brute_runs(b)


def test_long_periods_and_long_runs():
    draw = np.random.default_rng(3)
    unit = draw.integers(0, 9, 5000)
    words = np.concatenate((draw.integers(0, 9, 777), np.tile(unit, 4), draw.integers(0, 9, 50)))
    found = [r for r in periodic_runs.find_runs(words) if r[2] == 5000]
    assert len(found) == 1 and found[0][1] >= 20_000
    assert periodic_runs.find_runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]


def test_synchronising_set_is_consistent_and_dense():
    """Equal contexts are chosen alike, and a scale's starts hold one unless they are highly periodic."""
    words = np.random.default_rng(4).integers(0, 2, 4000)
    hashes = periodic_runs._mixed(words.astype(np.uint64) + np.uint64(1))
    for width in (1, 2, 4):
        hashes = periodic_runs._doubled(hashes, width)
    found = periodic_runs._Found()
    periodic_runs._small_periods(words, found)
    regions = {i for first, end in found.regions(8) for i in range(first, end)}
    chosen = set(periodic_runs._chosen(hashes.copy(), 8, found).tolist())
    kind = {}
    for i in range(len(words) - 16):
        assert kind.setdefault(tuple(words[i : i + 16]), i in chosen) == (i in chosen)
        if i + 32 < len(words):
            assert chosen & set(range(i, i + 8)) or set(range(i, i + 16)) <= regions


@pytest.mark.parametrize("together", [40, 1 << 18])
def test_query_equals_brute_force(spark, monkeypatch, together):
    monkeypatch.setattr(periodic_runs, "TOGETHER", together)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    expected = sorted((brute_row(r.doc_id, r.text, True) for r in docs.collect() if len(r.text or "") < 20_000), key=str)
    found = rows_of(llm_queries()["op12_periodic_runs"](spark, SMALL))
    ids = {r[0] for r in expected}
    assert [r for r in found if r[0] in ids] == expected and len(found) == docs.count()
    assert sum(r[1] > 0 for r in expected) > 10


def test_planted_small_texts(spark):
    rows = [(i, " ".join(map(str, words)), "s") for i, words in enumerate(texts_with_runs(5, 150))]
    found = rows_of(digested(periodic_runs.detect(spark.createDataFrame(documents(rows), DOC_SCHEMA), plant=True)))
    assert found == sorted((brute_row(i, t, True) for i, t, _ in rows), key=str)


def test_odd_rows(odd, empty):  # noqa: F811
    short = odd.where("length(text) < 5000 or text is null")
    expected = sorted((brute_row(r.doc_id, r.text, False) for r in short.collect()), key=str)
    assert rows_of(digested(periodic_runs.detect(short))) == expected
    assert rows_of(digested(periodic_runs.detect(odd, plant=True)))
    assert periodic_runs.detect(empty).collect() == []
