"""Periodic runs of words by string synchronising sets.

A run is a stretch of words that repeats with a smallest period, at least ``LEAST_EXPONENT`` times
and over at least ``LEAST_LENGTH`` words, and that no neighbouring word extends. Runs with a period of
t to 2t - 1 words are looked for at the scales t = 8, 16, 32, ...

At scale t a position belongs to the synchronising set if, of the hashes of the t + 1 windows of t
words that start up to t words after it, the least is the first or the last. Whether it belongs depends
on the 2t words from it on alone, so in a run the chosen positions repeat with the period; and every t
starts in a row hold a chosen one unless their windows lie in a highly periodic region, whose equal
windows would all be chosen and are left out instead. Chosen positions followed by the same 2t words
propose their distance as a period, and each proposal is extended word by word, so hashes decide
nothing. Highly periodic regions are detected separately: periods under 8 by comparing each word
with the one so many words before, larger ones as the runs of the smaller scales, which supply the
periods that the larger scales leave out.

A run with period q holds 4q words and t <= q < 2t, so among its first t starts is a chosen one whose
2t words lie in it twice, q words apart; by the periodicity lemma no other such position lies between,
so the next position with the same words gives q, and no run is lost.

Texts of a batch that are about equally long are searched together, with a word of its own after each.

Defined cases: a null, empty or blank text has no words, no run and the digest of nothing; ids may be null
(never planted) or repeat; of equally repetitive runs the first is reported, then the one of the smallest
period; a text is searched whole, in some hundred bytes of memory per word of it; an empty table gives an
empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylog.llm.batches import bounded_batches

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
FIRST_SCALE = 8
#: Words of texts that are searched together.
TOGETHER = 1 << 18

_LAST = np.uint64(2**64 - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD1B54A32D192ED03)
    return x ^ (x >> np.uint64(32))


def _doubled(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of windows of ``2 * width`` words from those of ``width`` words."""
    return _mixed(hashes[:-width] * np.uint64(3) + _mixed(hashes[width:]))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width + 1`` values in a row; ``width`` is a power of two."""
    least, reach = values, 1
    while reach < width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    return np.minimum(least[: len(values) - width], values[width:])


def _shortest(period: int) -> int:
    return max(LEAST_LENGTH, LEAST_EXPONENT * period)


def _forward(words: np.ndarray, a: int, b: int) -> int:
    """How many words from a and from b on are equal."""
    done, step = 0, 64
    while True:
        size = min(step, len(words) - b - done)
        if size <= 0:
            return done
        unequal = words[a + done : a + done + size] != words[b + done : b + done + size]
        first = int(unequal.argmax())
        if unequal[first]:
            return done + first
        done, step = done + size, step * 2


def _backward(words: np.ndarray, a: int, b: int) -> int:
    """How many words before a and before b are equal."""
    done, step = 0, 64
    while True:
        size = min(step, a - done)
        if size <= 0:
            return done
        unequal = (words[a - done - size : a - done] != words[b - done - size : b - done])[::-1]
        first = int(unequal.argmax())
        if unequal[first]:
            return done + first
        done, step = done + size, step * 2


class _Found:
    """Runs by their place; of stretches found with several periods the smallest is kept."""

    def __init__(self):
        self.periods: dict[tuple[int, int], int] = {}

    def add(self, start: int, length: int, period: int) -> None:
        if length >= _shortest(period):
            self.periods[start, length] = min(period, self.periods.get((start, length), period))

    def regions(self, width: int) -> Iterator[tuple[int, int]]:
        """Starts of the windows of ``width`` words in runs of at most a quarter of that period."""
        for (start, length), period in self.periods.items():
            if length >= width >= LEAST_EXPONENT * period:
                yield start, start + length - width + 1


def _small_periods(words: np.ndarray, found: _Found) -> None:
    for period in range(1, FIRST_SCALE):
        if len(words) <= period:
            return
        equal = np.concatenate(([False], words[period:] == words[:-period], [False]))
        edges = np.flatnonzero(equal[1:] != equal[:-1])
        starts, lengths = edges[::2], edges[1::2] - edges[::2] + period
        for at in np.flatnonzero(lengths >= _shortest(period)):
            found.add(int(starts[at]), int(lengths[at]), period)


def _chosen(hashes: np.ndarray, scale: int, found: _Found) -> np.ndarray:
    """Positions of the synchronising set at this scale."""
    for first, end in found.regions(scale):
        hashes[first:end] = _LAST
    least = _least(hashes, scale)
    either = (hashes[: len(least)] == least) | (hashes[scale:] == least)
    return np.flatnonzero(either & (least != _LAST))


def _proposals(words: np.ndarray, context: np.ndarray, chosen: np.ndarray, scale: int, found: _Found) -> None:
    chosen = chosen[chosen < len(context)]
    chosen = chosen[np.argsort(context[chosen], kind="stable")]
    same = context[chosen[1:]] == context[chosen[:-1]]
    periods = chosen[1:] - chosen[:-1]
    near = same & (periods >= scale) & (periods < 2 * scale)
    places, periods = chosen[:-1][near], periods[near]
    order = np.lexsort((places, periods))
    period, until = 0, 0
    for place, own in zip(places[order].tolist(), periods[order].tolist(), strict=True):
        if own == period and place < until:
            continue
        period = own
        back = _backward(words, place, place + period)
        until = place + _forward(words, place, place + period)
        found.add(place - back, until - place + back + period, period)


def find_runs(words: np.ndarray, longest: int | None = None) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of an array of word numbers, by start and period.

    ``longest`` is the length of the longest text in it, if the array holds several.
    """
    found = _Found()
    _small_periods(words, found)
    most = (longest or len(words)) // LEAST_EXPONENT
    hashes, scale = _mixed(words.astype(np.uint64) + np.uint64(1)), 1
    while scale < FIRST_SCALE and FIRST_SCALE <= most:
        hashes, scale = _doubled(hashes, scale), scale * 2
    while FIRST_SCALE <= scale <= most and len(hashes) > scale:
        context = _doubled(hashes, scale)
        _proposals(words, context, _chosen(hashes, scale, found), scale, found)
        hashes, scale = context, scale * 2
    return sorted((start, length, period) for (start, length), period in found.periods.items())


def planted(words: np.ndarray, doc_id: int | None) -> np.ndarray:
    """The words with a periodic tail, for every tenth document by hash of its id."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return np.concatenate((words[:a], words[a + np.arange(n - a) % period]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words are in no run after its first period."""
    marks = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        marks[start + period] += 1
        marks[start + length] -= 1
    return np.cumsum(marks[:n]) == 0


def most_repetitive(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; the first of equals."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _size_class(n: int) -> int:
    return max(n, LEAST_LENGTH).bit_length()


class _Batch:
    """The words of a batch's texts as numbers, searched in groups of similar length."""

    def __init__(self, texts: list[bytes | None], ids: list[int | None], plant: bool):
        split = [(text or b"").split() for text in texts]
        encoded = pa.array([w for words in split for w in words], pa.binary()).dictionary_encode()
        self.names = encoded.dictionary.to_pylist()
        numbers = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum([len(words) for words in split])[:-1] if split else []
        self.words = np.split(numbers, ends) if split else []
        if plant:
            self.words = [planted(w, i) for w, i in zip(self.words, ids, strict=True)]
        self.runs: list[list[tuple[int, int, int]]] = [[] for _ in split]
        group, held = [], 0
        for at in sorted(range(len(split)), key=lambda i: len(self.words[i])):
            size = len(self.words[at])
            if size < LEAST_LENGTH:
                continue
            if group and (held + size > TOGETHER or _size_class(size) != _size_class(len(self.words[group[0]]))):
                self._search(group)
                group, held = [], 0
            group.append(at)
            held += size
        if group:
            self._search(group)

    def _search(self, group: list[int]) -> None:
        parts, starts, at = [], [], 0
        for number, i in enumerate(group):
            parts += [self.words[i], np.array([len(self.names) + number])]
            starts.append(at)
            at += len(self.words[i]) + 1
        for start, length, period in find_runs(np.concatenate(parts), len(self.words[group[-1]])):
            own = int(np.searchsorted(starts, start, "right")) - 1
            self.runs[group[own]].append((start - starts[own], length, period))

    def rows(self) -> Iterator[tuple]:
        for words, runs in zip(self.words, self.runs, strict=True):
            best = most_repetitive(runs)
            listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
            left = words[kept_words(len(words), runs)] if runs else words
            joined = b" ".join([self.names[i] for i in left.tolist()])
            exponent = 1000 * best[1] // best[2] if best else None
            yield (
                len(runs),
                *(best or (None, None, None)),
                exponent,
                hashlib.sha256(listed.encode()).hexdigest(),
                joined,
                [{"start": s, "length": n, "period": p} for s, n, p in runs],
            )


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_TYPES = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.list_(_RUN)]
_NAMES = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed", "runs"]
_KINDS = ["long"] * 5 + ["string", "string", "array<struct<start:bigint,length:bigint,period:bigint>>"]


def detect(docs: DataFrame, plant: bool = False) -> DataFrame:
    """One row per document: doc_id, number of runs, the most repetitive run, all runs, the collapsed text.

    ``collapsed`` is the text's words without those that a run repeats, joined by one space;
    ``runs_sha256`` is the digest of the runs written as lines. With ``plant`` every tenth document
    gets a periodic tail first.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            done = list(_Batch(batch.column("text").to_pylist(), ids, plant).rows())
            if done:
                columns = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), _TYPES, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *_NAMES])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} {k}" for n, k in zip(_NAMES, _KINDS, strict=True)))
