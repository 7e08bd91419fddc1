"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over seven bytes ends a chunk wherever it meets the block size, each chunk
gives one character, and a fingerprint has the characters at one block size and at twice
that. Fingerprints at compatible block sizes are compared by the edit distance (insert and
delete) of their signatures; signatures without seven characters in a row in common count
as unlike.

A signature has 64 characters at most, the last of which covers all the rest of the text.
A text is read in segments, so memory doesn't grow with its length.

Defined cases: null and empty texts have the fingerprint ``3::`` and are like each other only;
equal texts have equal fingerprints and likeness 1; of documents with equal ids (or null
ids, which come last) the order is by text; a single document follows itself; a very
long text is hashed whole; extra columns are ignored, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallylog.llm.batches import BATCH_BYTES, bounded_batches
from tallylog.llm.common import ROW, stored, whole_text, with_rows

WINDOW, LEAST_BLOCK, SIGNATURE = 7, 3, 64
SEGMENT = 1 << 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_LETTERS = np.frombuffer(ALPHABET.encode(), np.uint8)

_random = np.random.default_rng(20240607)
_ROLL = _random.integers(1, 1 << 32, 256, np.uint32)
_BYTES = _random.integers(1, 1 << 63, 256, np.uint64)
_ROLL_POWERS = [np.uint32(pow(0x9E3779B1, back, 1 << 32)) for back in range(WINDOW)]
_POWERS = np.cumprod(np.where(np.arange(1 << 16) == 0, np.uint64(1), np.uint64(0x9E3779B97F4A7C15)))


def _rolled(data: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Rolling hash at each byte plus one, given up to six bytes before."""
    own = _ROLL[np.concatenate((before, data))]
    padded = np.concatenate((np.zeros(WINDOW - 1 - len(before), np.uint32), own))
    n, hashed = len(data), np.zeros(len(data), np.uint32)
    for back, power in enumerate(_ROLL_POWERS):
        hashed += padded[WINDOW - 1 - back : WINDOW - 1 - back + n] * power
    hashed ^= hashed >> np.uint32(15)
    hashed *= np.uint32(0x85EBCA77)
    hashed ^= hashed >> np.uint32(13)
    return hashed


def _segments(data: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Offset, bytes and rolling hashes of each segment."""
    for at in range(0, len(data), SEGMENT):
        own = data[at : at + SEGMENT]
        yield at, own, _rolled(own, data[max(0, at - WINDOW + 1) : at])


def _signature(segments, level: int) -> str:
    """One character per chunk; a chunk ends where the hash is divisible by 3 * 2**level."""
    sums: list[np.ndarray] = []
    ended, opened, start, end = 0, np.uint64(0), 0, 0
    for at, own, hashed in segments:
        marks = np.flatnonzero((hashed & np.uint32((1 << level) - 1)) == 0)
        marks = marks[hashed[marks] % np.uint32(3) == 0][: SIGNATURE - 1 - ended]
        begins = np.concatenate(([0], marks + 1))
        place = np.arange(len(own)) - np.repeat(begins, np.diff(np.append(begins, len(own))))
        first = int(marks[0]) + 1 if len(marks) else len(own)
        place[:first] += at - start
        weighed = _BYTES[own] * _POWERS[place & 0xFFFF]
        found = np.add.reduceat(weighed, begins[begins < len(own)])
        found[:1] += opened
        ended, end = ended + len(marks), at + len(own)
        if len(marks) and marks[-1] == len(own) - 1:
            sums.append(found)
            opened, start = np.uint64(0), end
        else:
            sums.append(found[:-1])
            opened, start = found[-1], start if not len(marks) else at + int(marks[-1]) + 1
    if start < end:
        sums.append(np.array([opened], np.uint64))
    if not sums:
        return ""
    mixed = np.concatenate(sums) * np.uint64(0xC2B2AE3D27D4EB4F)
    return _LETTERS[(mixed ^ mixed >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(58)].tobytes().decode()


def fingerprint(text: str) -> str:
    """Block size and the signatures at it and at twice it."""
    data = np.frombuffer(text.encode(), np.uint8)
    segments = list(_segments(data)) if len(data) <= SEGMENT else None

    def each():
        return segments if segments is not None else _segments(data)

    counts = np.zeros(34, np.int64)
    for _, _, hashed in each():
        even = hashed[hashed % np.uint32(3) == 0]
        lowest = even & (~even + np.uint32(1))
        levels = np.where(even == 0, 32, np.log2(np.maximum(lowest, 1)).astype(np.int64))
        counts[:33] += np.bincount(levels, minlength=33)
    at_least = counts[::-1].cumsum()[::-1]
    level = 0
    while (LEAST_BLOCK << level) * SIGNATURE < len(data):
        level += 1
    while level and at_least[min(level, 32)] + 1 < SIGNATURE // 2:
        level -= 1
    return f"{LEAST_BLOCK << level}:{_signature(each(), level)}:{_signature(each(), level + 1)}"


def _without_runs(signature: str) -> str:
    """Runs of one character are cut to three; they say little."""
    return "".join(c for i, c in enumerate(signature) if i < 3 or not c == signature[i - 1] == signature[i - 2] == signature[i - 3])


def _alike(a: str, b: str) -> float:
    a, b = _without_runs(a), _without_runs(b)
    if len(a) < WINDOW or len(b) < WINDOW:
        return float(a == b and a != "")
    if {a[i : i + WINDOW] for i in range(len(a) - WINDOW + 1)}.isdisjoint(
        b[i : i + WINDOW] for i in range(len(b) - WINDOW + 1)
    ):
        return 0.0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        met = row & places.get(c, 0)
        row = (row + met | row - met) & full
    common = len(a) - row.bit_count()
    distance = len(a) + len(b) - 2 * common
    return 1 - distance / (len(a) + len(b))


def likeness(one: str, other: str) -> float:
    """From 0 to 1; 1 for equal fingerprints, 0 at incompatible block sizes."""
    if one == other:
        return 1.0
    (size, a1, a2), (other_size, b1, b2) = one.split(":"), other.split(":")
    if int(size) == int(other_size):
        return max(_alike(a1, b1), _alike(a2, b2))
    if int(size) == 2 * int(other_size):
        return _alike(a1, b2)
    if 2 * int(size) == int(other_size):
        return _alike(a2, b1)
    return 0.0


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(text) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(ROW), batch.column("doc_id"), pa.array(found)], [ROW, "doc_id", "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Row number, doc_id and fingerprint of each document."""
    bounded_batches(docs.sparkSession)
    rows = with_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")))
    return rows.mapInArrow(_fingerprint_batches, f"{ROW} long, doc_id long, fingerprint string")


_WALK = pa.schema(
    [
        ("part", pa.int32()), ("kind", pa.string()), ("doc_id", pa.int64()), ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string()),
    ]
)
_WALK_DDL = (
    "part int, kind string, doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double, text string"
)


def _compared(part: int, doc_id, text: str, own: str, next_text: str, next_own: str) -> tuple:
    """The result row of a document and the one after it."""
    half = len(text) // 2
    edited = text[: len(text) - half] + next_text[:half]
    changed = own if edited == text else fingerprint(edited)
    digest = hashlib.sha256(edited.encode()).hexdigest()
    return part, "whole", doc_id, len(text), digest, own, changed, likeness(own, changed), likeness(own, next_own), None


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition, each compared with the next; its first and last document for the seams."""
    part, last, rows, held = TaskContext.get().partitionId(), None, [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own = fingerprint(text)
            if last is None:
                rows.append((part, "first", doc_id, None, None, own, None, None, None, text))
            else:
                rows.append(_compared(part, *last, text, own))
            last, held = (doc_id, text, own), held + len(text)
            if held > BATCH_BYTES:
                yield _walked(rows)
                rows, held = [], 0
    if last is not None:
        rows.append((part, "last", last[0], None, None, last[2], None, None, None, last[1]))
    if rows:
        yield _walked(rows)


def _walked(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _WALK, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=_WALK)


def _seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_compared(*row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        if rows:
            yield _walked(rows)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against its edited text's and the next document's.

    The next document is the one with the next smaller id; after the last comes the first. In
    the edited text the second half is the beginning of the next document. Documents are
    range-partitioned and sorted by id, so each text is shuffled once and compared as it is
    read; the first and last document of each partition are stored and joined at the seams.
    """
    bounded_batches(docs.sparkSession)
    order = F.col("doc_id").desc_nulls_last()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    walked = stored(rows.repartitionByRange(order).sortWithinPartitions(order, "text").mapInArrow(_walk, _WALK_DDL))
    firsts = walked.where("kind = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_own"))
    parts = walked.where("kind = 'first'").select("part")
    ordered = Window.orderBy("part")
    after = F.coalesce(F.lead("part").over(ordered), F.first("part").over(ordered)).alias("next_part")
    lasts = walked.where("kind = 'last'").join(parts.select("part", after), "part").join(firsts, "next_part")
    seams = lasts.select("part", "doc_id", "text", "fingerprint", "next_text", "next_own").mapInArrow(_seams, _WALK_DDL)
    return walked.where("kind = 'whole'").union(seams).drop("part", "kind", "text")
