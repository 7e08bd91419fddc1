"""Piecewise hashing against a reading of the text byte by byte and a table of edit distances."""

import hashlib
import random

import pytest
from conftest import SMALL

from tallylog.llm import ctph
from tallylog.llm.queries import llm_queries

BITS32, BITS64 = (1 << 32) - 1, (1 << 64) - 1


def plain_fingerprint(text):
    data = text.encode()
    rolled = []
    for i in range(len(data)):
        h = 0
        for back in range(min(7, i + 1)):
            h += int(ctph._ROLL[data[i - back]]) * pow(0x9E3779B1, back, 1 << 32)
        h &= BITS32
        h ^= h >> 15
        h = h * 0x85EBCA77 & BITS32
        rolled.append(h ^ h >> 13)

    def signature(block):
        letters, total, place = [], 0, 0
        for byte, h in zip(data, rolled, strict=True):
            total += int(ctph._BYTES[byte]) * pow(0x9E3779B97F4A7C15, place & 0xFFFF, 1 << 64)
            place += 1
            if h % block == 0 and len(letters) < 63:
                letters.append(total & BITS64)
                total, place = 0, 0
        if place:
            letters.append(total & BITS64)
        out = ""
        for x in letters:
            x = x * 0xC2B2AE3D27D4EB4F & BITS64
            x = (x ^ x >> 32) * 0x9E3779B97F4A7C15 & BITS64
            out += "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"[x >> 58]
        return out

    block = 3
    while block * 64 < len(data):
        block *= 2
    while block > 3 and sum(h % block == 0 for h in rolled) + 1 < 32:
        block //= 2
    return f"{block}:{signature(block)}:{signature(2 * block)}"


def shortened(signature):
    out = ""
    for c in signature:
        if out[-3:] != 3 * c:
            out += c
    return out


def edit_distance(a, b):
    """Insertions and deletions, from the whole table."""
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        before, row = row, [i]
        for j, d in enumerate(b, 1):
            row.append(before[j - 1] if c == d else 1 + min(before[j], row[j - 1]))
    return row[-1]


def plain_alike(a, b):
    a, b = shortened(a), shortened(b)
    if min(len(a), len(b)) < 7:
        return float(a == b and a != "")
    if not any(a[i : i + 7] in b for i in range(len(a) - 6)):
        return 0.0
    return 1 - edit_distance(a, b) / (len(a) + len(b))


def plain_likeness(one, other):
    if one == other:
        return 1.0
    (n, a1, a2), (m, b1, b2) = one.split(":"), other.split(":")
    pairs = {1: [(a1, b1), (a2, b2)], 2: [(a1, b2)], 0.5: [(a2, b1)]}.get(int(n) / int(m), [])
    return max((plain_alike(a, b) for a, b in pairs), default=0.0)


def test_fingerprints_byte_by_byte():
    draw = random.Random(3)
    texts = ["", "a", "é", "abcabc" * 40, "x" * 3000]
    texts += ["".join(draw.choice("abcdefgh é日 ") for _ in range(draw.randint(0, 2500))) for _ in range(40)]
    for text in texts:
        assert ctph.fingerprint(text) == plain_fingerprint(text)


def test_likeness_by_table():
    draw = random.Random(4)
    seen = set()
    for _ in range(60):
        text = " ".join(draw.choice(["alpha", "beta", "gamma", "delta"]) + str(draw.randrange(50)) for _ in range(draw.randint(5, 300)))
        cut = draw.randrange(len(text))
        for other in (text[cut:], text[:cut] + "new words" + text[cut:], text + text, text[::-1]):
            one, two = ctph.fingerprint(text), ctph.fingerprint(other)
            assert ctph.likeness(one, two) == pytest.approx(plain_likeness(one, two))
            seen.add(round(plain_likeness(one, two), 1))
    assert len(seen) > 3


def test_query_equals_plain_version(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    texts = [(r.doc_id, r.text or "") for r in sorted(rows, key=lambda r: -r.doc_id)]
    prints = {i: plain_fingerprint(t) for i, t in texts if len(t) < 4000}
    expected = {}
    for (i, text), (after, other) in zip(texts, texts[1:] + texts[:1], strict=True):
        if i in prints and after in prints:
            half = len(text) // 2
            edited = text[: len(text) - half] + other[:half]
            changed = plain_fingerprint(edited)
            near = plain_likeness(prints[i], changed), plain_likeness(prints[i], prints[after])
            expected[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), prints[i], changed, *near)
    found = {r.doc_id: tuple(r)[1:] for r in llm_queries()["op6_fingerprints"](spark, SMALL).collect()}
    assert len(expected) > 100 and len(found) == len(texts)
    for i, row in expected.items():
        assert found[i][:4] == row[:4] and found[i][4:] == pytest.approx(row[4:])
