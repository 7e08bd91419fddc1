"""Packing: the library's ids, every piece once, no sequence too long, and few sequences."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import SMALL
from test_operators import DOC_SCHEMA, documents, empty, odd, odd_rows  # noqa: F401
from tokenizers import Tokenizer

from tallylog.llm import packing
from tallylog.llm.queries import llm_queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as file:
        return packing.WordEncoder(file.read())


def expected_pieces(library, doc_id, text, size=1024):
    ids = library.encode(text or "", add_special_tokens=False).ids + [2]
    starts = [0, *range(len(ids) % size or size, len(ids), size), len(ids)]
    return [
        (doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
        for k, (a, b) in enumerate(zip(starts, starts[1:], strict=False))
    ]


def check(rows, expected, size=1024):
    """Rows are the expected pieces, gapless in their sequences; returns the number of sequences."""
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(expected, key=str)
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= size
    return len(held)


def test_ids_are_the_librarys(library, encoder):
    draw = random.Random(5)
    parts = [*" \t\n  aZ9_'.,é日  \x1c\x85᠎", "<|endoftext|>", "'s", " the", "\r\n"]
    for _ in range(5000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 14)))
        assert encoder.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_ids_do_not_depend_on_parts_or_memory(library, encoder, monkeypatch):
    monkeypatch.setattr(packing, "PART", 7)
    monkeypatch.setattr(packing, "CACHED", 20)
    draw = random.Random(6)
    for _ in range(200):
        text = " ".join(draw.choice(["alpha", "be,ta", "x  y", "\n", "é", "Gamma's"]) + str(draw.randrange(30)) for _ in range(40))
        assert encoder.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def histograms():
    draw = np.random.default_rng(7)
    yield "uniform", Counter(draw.integers(1, 1025, 20_000).tolist()), 1.01
    yield "short", Counter((np.minimum(1023, draw.lognormal(4, 1, 20_000)).astype(int) + 1).tolist()), 1.005
    yield "long", Counter((np.minimum(1023, draw.lognormal(6, 1, 20_000)).astype(int) + 1).tolist()), 1.01
    yield "halves", Counter({512: 999, 1024: 5}), 1.01
    yield "no partner", Counter({600: 10_000, 424: 100}), 1.0
    yield "one", Counter({1: 10}), 1.0
    yield "none", Counter(), 1.0


@pytest.mark.parametrize("name, histogram, most", list(histograms()), ids=[n for n, _, _ in histograms()])
def test_plan_takes_every_piece_once(name, histogram, most):
    fillings = packing.plan(dict(histogram))
    used = Counter()
    for filling, repeats in fillings:
        assert sum(filling) <= 1024 and repeats > 0
        for length in filling:
            used[length] += repeats
    assert used == +histogram
    least = max(-(-sum(n * k for n, k in histogram.items()) // 1024), sum(k for n, k in histogram.items() if n > 512))
    assert packing.sequences(fillings) <= most * least + 1


def test_fit_reaches_the_histogram():
    counts = np.zeros(65, np.int64)
    for a, b, c in [(30, 20, 14), (40, 24, 0), (50, 10, 4)]:
        for n in (a, b, c):
            counts[n] += 100 if n else 0
    rows = packing.patterns(counts)
    assert (rows.sum(axis=1) == 64).all() and (counts[rows][rows > 0] > 0).all()
    x = packing.fitted(rows, counts)
    back = sum(np.bincount(rows[:, k], x, 65) for k in range(3))
    assert (x >= 0).all() and np.allclose(back[1:], counts[1:], atol=1)


def test_patterns_are_all_of_them():
    counts = np.ones(31, np.int64)
    brute = {(a, b, c) for a in range(1, 31) for b in range(a + 1) for c in range(b + 1) if a + b + c == 30}
    assert {tuple(r) for r in packing.patterns(counts).tolist()} == brute


def test_query(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    expected = [p for r in docs for p in expected_pieces(library, r.doc_id, r.text)]
    rows = llm_queries()["op13_packing"](spark, SMALL).collect()
    assert check(rows, expected) <= 1.01 * -(-sum(p[3] for p in expected) // 1024) + 1


def test_many_tasks_share_a_length(spark, library):
    """A length that most pieces have, over several tasks, and a small size."""
    rows = [(i % 50, "the same text here", "s") for i in range(300)] + [(i, "word " * (i % 40), "s") for i in range(100)]
    docs = spark.createDataFrame(documents(rows), DOC_SCHEMA).repartition(6)
    expected = [p for i, t, _ in rows for p in expected_pieces(library, i, t, 16)]
    found = packing.pack(docs, PATH, size=16).collect()
    assert check(found, expected, 16) <= 1.05 * -(-sum(p[3] for p in expected) // 16) + 1


def test_odd_rows(spark, library, odd, empty):  # noqa: F811
    expected = [p for r in odd.collect() for p in expected_pieces(library, r.doc_id, r.text)]
    check(packing.pack(odd, PATH).collect(), expected)
    assert packing.pack(empty, PATH).collect() == []
