"""Best-fit packing of documents into sequences, by patterns from non-negative least squares.

Each document is encoded with the tokenizers library and closed by an end token; one that is longer
than a sequence is cut into pieces of a whole sequence, of which the first may be shorter. Only the
histogram of piece lengths is needed to plan: patterns of up to three lengths that fill a sequence are
enumerated, their repeat counts are fitted to the histogram by non-negative least squares (errors in long
pieces weigh more, since short ones fit in anywhere), rounded, and cut to the pieces there are. What is left
is packed best fit first, as counts of lengths: the longest piece opens a sequence and the longest piece that
fits is added until none does; the same filling is repeated as often as the pieces last.

The plan is a list of slots, ranges of pieces of one length at one place of consecutive sequences. A piece's
rank among those of its length is its rank in its task plus the pieces of that length in earlier tasks,
and the rank selects the slot, so no group of a length is ever brought together.

Bounds: the histogram has at most ``size`` lengths, of which at most ``size**2 / 12 + size`` patterns are
enumerated; the plan has as many slots at most, besides a few per length, whatever the number of documents.

Defined cases: a null or empty text is one piece that holds the end token only; a special token's
string in a text is encoded as the library does by default; ids may be null or repeat, and each row is packed;
pieces of equal length are placed in the order of the table's files; a very long text is encoded in parts
and its pieces are packed apart; an empty table gives an empty result; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallylog.llm.batches import bounded_batches
from tallylog.llm.common import stored

SIZE = 1024
END_TOKEN = 2
#: Steps of the least-squares fit, and the shares of it that are tried; what a share leaves is best fit.
STEPS, SHARES = 1500, (1.0, 0.9, 0.75, 0.5, 0.25)
#: Distinct words a worker process remembers; the table starts anew when it is full.
CACHED = 400_000
#: Words that are looked up at a time.
PART = 1 << 18

#: A space before a character that is no white space always opens a match of the byte-level split pattern.
_CUT = re.compile(r" (?=[!-~\w])")
_ODD = re.compile(r" (?![!-~\w])")
#: How byte-level tokens write a space.
_SPACE = "\u0120"


class WordEncoder:
    """Ids of texts under a byte-level tokenizer; remembers the ids of each word with its space."""

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.known: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith(_SPACE)]] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, words: list[str]) -> None:
        """New words are encoded in one text, which is cut where a token opens with a space."""
        new = list(set(words).difference(self.known))
        if len(self.known) + len(new) > CACHED:
            self.known, new = {}, list(set(words))
        whole = [w for w in new if " " not in w]
        ids = self._ids("".join(" " + w for w in whole))
        at, raw = np.flatnonzero(self.opens[ids]).tolist(), ids.tobytes()
        for word, start, end in zip(whole, at, [*at, len(ids)][1:], strict=True):
            self.known[word] = raw[4 * start : 4 * end]
        for word in new:
            if " " in word:
                self.known[word] = self._ids(" " + word).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        words = text.split(" ") if _ODD.search(text) is None else _CUT.split(text)
        ids = [self._ids(words[0]).tobytes()]
        for at in range(1, len(words), PART):
            part = words[at : at + PART]
            try:
                ids += [self.known[w] for w in part]
            except KeyError:
                self._learn(part)
                ids += [self.known[w] for w in part]
        return b"".join(ids)


@lru_cache(maxsize=1)
def _encoder(tokenizer: str) -> WordEncoder:
    """The encoder of a worker process, which keeps its words from task to task."""
    return WordEncoder(tokenizer)


def pieces(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end_token: int = END_TOKEN) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, ids`` and the piece's place: ``task`` and ``place``.

    ``place`` counts the pieces of the same length in the task before it.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as file:
        shipped = spark.sparkContext.broadcast(file.read())
    end = np.array([end_token], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, seen = _encoder(shipped.value), TaskContext.get().partitionId(), [0] * (size + 1)
        for batch in batches:
            rows = []
            for doc_id, text in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "text")), strict=True):
                ids = encoder.encode(text or "") + end
                n = len(ids) // 4
                start, number = 0, 0
                while start < n:
                    length = (n - start) % size or size
                    own = ids[4 * start : 4 * (start + length)]
                    rows.append((doc_id, number, start, length, zlib.crc32(own), own, task, seen[length]))
                    seen[length] += 1
                    start, number = start + length, number + 1
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "task", "place"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    kinds = ["long", "int", "long", "long", "long", "binary", "long", "long"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def patterns(counts: np.ndarray) -> np.ndarray:
    """Rows of three lengths, longest first and 0 for none, that add up to a whole sequence.

    ``counts`` are the pieces of each length from 0 to the size; only lengths that occur are used.
    """
    size = len(counts) - 1
    a, b = np.meshgrid(np.arange(1, size + 1), np.arange(size + 1), indexing="ij")
    c = size - a - b
    fits = (a >= b) & (b >= c) & (c >= 0)
    found = np.stack((a[fits], b[fits], c[fits]), axis=1)
    occurs = counts > 0
    occurs[0] = True
    return found[occurs[found].all(axis=1)]


def fitted(rows: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns with the least weighted squared error to the histogram.

    Accelerated projected gradient; a product with the pattern matrix is a sum over its three columns.
    """
    size = len(counts) - 1
    weights = np.arange(size + 1) / size
    weights[0] = 0.0
    scale = max(float(counts.max()), 1.0)
    target = counts / scale * weights

    def forward(x):
        return sum(np.bincount(rows[:, k], x, size + 1) for k in range(3)) * weights

    def backward(r):
        r = r * weights
        return r[rows].sum(axis=1)

    probe = np.ones(len(rows))
    for _ in range(20):
        probe = backward(forward(probe))
        norm = np.linalg.norm(probe)
        probe /= norm
    x = y = np.zeros(len(rows))
    t, close = 1.0, 1e-9 * float(target @ target)
    for _ in range(steps):
        error = forward(y) - target
        if error @ error <= close:
            break
        ahead = np.maximum(y - backward(error) / (1.02 * norm), 0.0)
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = ahead + (t - 1) / t_next * (ahead - x)
        x, t = ahead, t_next
    return x * scale


def _best_fit(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Fillings and their repeats for what is left of the histogram; empties ``left``."""
    size, out = len(left) - 1, []
    for longest in range(size, 0, -1):
        while left[longest]:
            filling, space, used = [], size, {}
            length = longest
            while space:
                free = np.flatnonzero(left[1 : min(space, length) + 1])
                length = int(free[-1]) + 1 if len(free) else 0
                while length and left[length] <= used.get(length, 0):
                    lower = np.flatnonzero(left[1:length])
                    length = int(lower[-1]) + 1 if len(lower) else 0
                if not length:
                    break
                times = min(space // length, int(left[length]) - used.get(length, 0))
                filling += [length] * times
                used[length] = used.get(length, 0) + times
                space -= times * length
            repeats = min(int(left[n]) // times for n, times in used.items())
            for n, times in used.items():
                left[n] -= repeats * times
            out.append((tuple(filling), repeats))
    return out


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Fillings (lengths in order of their place) and how many sequences each one fills.

    Every piece of the histogram is in exactly one of them.
    """
    left = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    out = []
    if left[size]:
        out.append(((size,), int(left[size])))
        left[size] = 0
    rows = patterns(left)
    if not len(rows):
        return out + _best_fit(left)
    repeats = fitted(rows, left)
    return out + min((_rounded(rows, repeats * share, left.copy()) for share in SHARES), key=sequences)


def sequences(fillings: list[tuple[tuple[int, ...], int]]) -> int:
    return sum(repeats for _, repeats in fillings)


def _rounded(rows: np.ndarray, repeats: np.ndarray, left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Whole repeats of the patterns, as far as the pieces last, and best fit for the rest.

    What a pattern's rounding leaves off is owed to the next ones, so the total stays near the fit.
    """
    out, owed = [], 0.0
    for row, share in zip(rows.tolist(), repeats.tolist(), strict=True):
        owed += share
        filling = tuple(n for n in row if n)
        times = min(int(owed), *(int(left[n]) // filling.count(n) for n in filling))
        if times > 0:
            owed -= times
            for n in filling:
                left[n] -= times
            out.append((filling, times))
        owed = min(owed, 1.0)
    return out + _best_fit(left)


@dataclass
class Slots:
    """The plan by length and rank: where the pieces of a range of ranks go."""

    starts: np.ndarray
    sequences: np.ndarray
    offsets: np.ndarray
    span: int

    @classmethod
    def of(cls, fillings: list[tuple[tuple[int, ...], int]]) -> Slots:
        used: dict[int, int] = {}
        rows, sequence = [], 0
        for filling, repeats in fillings:
            offset = 0
            for length in filling:
                rows.append((length, used.get(length, 0), sequence, offset))
                used[length] = used.get(length, 0) + repeats
                offset += length
            sequence += repeats
        span = max(used.values(), default=0) + 1
        lengths, firsts, sequences, offsets = np.array(sorted(rows), np.int64).reshape(-1, 4).T
        return cls(lengths * span + firsts, sequences - firsts, offsets, span)

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces with these lengths and ranks among pieces of their length."""
        at = np.searchsorted(self.starts, lengths * self.span + ranks, "right") - 1
        return self.sequences[at] + ranks, self.offsets[at]


def pack(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end_token: int = END_TOKEN) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    own = ["doc_id", "piece", "start", "length", "ids_crc32"]
    cut = stored(pieces(docs, tokenizer_path, size, end_token).drop("ids"))
    counts = stored(cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()
    slots = spark.sparkContext.broadcast(Slots.of(plan({r["length"]: r["n"] for r in histogram}, size)))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = cut.join(before, ["task", "length"]).select(*own, (F.col("before") + F.col("place")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (batch.column(n).to_numpy() for n in ("length", "rank"))
            found = slots.value.place(lengths, ranks)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in own), *map(pa.array, found)], [*own, "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
