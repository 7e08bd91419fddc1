"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Texts are vectors over all words of the labelled examples. A word weighs by its inverse document
frequency, counted over all documents, times its relevance: G / (G + 50), where G is the likelihood
ratio of the word and the label over the examples. So words that come with either label draw texts
together, others weigh little but are all compared, and a copy of an example has cosine 1.

The examples form a block-max inverted index: each posting list is cut at blocks of examples, and the
largest weight of each list in each block bounds what the block can score. The blocks with the highest
bounds are scored first, then all that can still reach the k-th best; the k nearest are exact.

Votes weigh by inverse distance, and by how many labelled rows an example stands for. The share of
toxic votes is calibrated by one increasing logistic curve, fitted to the examples' own shares when
each is searched among the others. The evidence are the k examples that voted, and their cosines.

Fixed bound: the index holds at most ``TOXIC + CLEAN`` examples, all their words included. Held-out
rows (crc32 of the id, mod 5, is 0) give no labels.

Defined cases: null and empty texts, and others without a word of any example, get the calibrated
share of toxic rows among all; without toxic labels every score is 0, without clean ones the calibrated
share is that of the votes; equal texts get equal scores; ids may be null or repeat, and of several texts
with one labelled id the first in order is the example; equally near examples are taken in index order;
very long texts are read in pieces cut at white space, which no word spans; an empty table gives an
empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylog.llm.batches import bounded_batches
from tallylog.llm.common import ROW, held_out, labelled_sample, stored, text_pieces, whole_text, with_rows

TOXIC, CLEAN = 1000, 2000
NEIGHBOURS, NEAREST_DISTANCE, RELEVANCE, THRESHOLD = 15, 0.02, 50.0, 0.5
BLOCK, FIRST_BLOCKS = 64, 4
#: Scored vectors a task remembers, for texts that repeat; the table starts anew when it is full.
CACHED = 20_000
#: Characters of text whose words are looked up together.
LOOKED_UP = 1 << 20

#: A word is a run of letters; every character beyond ASCII counts as one.
_SEPARATED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """The lower-case words of a text in UTF-8."""
    return [w for piece in text_pieces(text) for w in piece.lower().encode("utf-8", "surrogatepass").translate(_SEPARATED).split()]


def _example_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [sorted(Counter(words_of(text or "")).items()) for text in batch.column("text").to_pylist()]
        words = pa.array([[w for w, _ in c] for c in counts], pa.list_(pa.binary()))
        numbers = pa.array([[n for _, n in c] for c in counts], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), words, numbers], ["doc_id", "label", "words", "counts"])


class Vocabulary:
    """Numbers of the examples' words."""

    def __init__(self, words: list[bytes]):
        self.words = pa.array(words, pa.binary())

    def _cells(self, split: list[tuple[int, list[bytes]]]) -> np.ndarray:
        """For each known word its text's place times the number of words, plus its own number."""
        flat = pa.array([w for _, words in split for w in words], pa.binary())
        numbers = pc.index_in(flat, value_set=self.words).fill_null(-1).to_numpy().astype(np.int64)
        owners = np.repeat(np.array([place for place, _ in split], np.int64), [len(words) for _, words in split])
        known = numbers >= 0
        return owners[known] * max(len(self.words), 1) + numbers[known]

    def vectors(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text the numbers and counts of its known words, by number.

        Words are held of about ``LOOKED_UP`` characters at a time, however long the texts are together.
        """
        found, held, length = [], [], 0
        for place, text in enumerate(texts):
            for piece in text_pieces(text):
                held.append((place, words_of(piece)))
                length += len(piece)
                if length >= LOOKED_UP:
                    found.append(self._cells(held))
                    held, length = [], 0
        found.append(self._cells(held))
        size = max(len(self.words), 1)
        cells, counts = np.unique(np.concatenate(found), return_counts=True)
        ends = np.searchsorted(cells, np.arange(1, len(texts)) * size)
        return list(zip(np.split(cells % size, ends), np.split(counts, ends), strict=True))


def _frequencies(shipped, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, found = Vocabulary(shipped.value), np.zeros(size, np.int64)
        for batch in batches:
            for ids, _ in vocabulary.vectors(batch.column("text").to_pylist()):
                found[ids] += 1
        ids = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(found[ids])], ["i", "n"])

    return run


class BlockMaxIndex:
    """Inverted index over unit vectors, with the largest weight of each list in each block."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK):
        self.n, self.block = len(vectors), block
        self.n_blocks = -(-self.n // block)
        terms = np.concatenate([ids for ids, _ in vectors] or [np.empty(0, np.int64)])
        owners = np.repeat(np.arange(self.n), [len(ids) for ids, _ in vectors])
        weights = np.concatenate([w for _, w in vectors] or [np.empty(0)])
        order = np.lexsort((owners, terms))
        terms, self.owners, self.weights = terms[order], owners[order].astype(np.int32), weights[order]
        self.starts = np.searchsorted(terms, np.arange(n_terms + 1))
        # Cells: the part of a list in a block, with its largest weight.
        cells = terms * self.n_blocks + self.owners // block
        firsts = np.flatnonzero(np.diff(cells, prepend=-1))
        self.cell_blocks = (cells[firsts] % self.n_blocks).astype(np.int32) if len(cells) else np.empty(0, np.int32)
        self.largest = np.maximum.reduceat(self.weights, firsts) if len(firsts) else np.empty(0)
        self.cell_firsts = np.append(firsts, len(cells))
        self.cell_starts = np.searchsorted(terms[firsts], np.arange(n_terms + 1))

    @staticmethod
    def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places in all ranges, and the lengths of the ranges."""
        lengths = ends - starts
        places = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
        places += np.arange(len(places))
        return places, lengths

    def _scores(self, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Sums per example over the postings in the ranges, each times its range's weight."""
        places, lengths = self._ranges(starts, ends)
        return np.bincount(self.owners[places], self.weights[places] * np.repeat(weights, lengths), self.n)

    def nearest(self, ids: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples with the largest positive products, largest first, and the products.

        ``without`` is an example to leave out.
        """
        if not len(ids) or not self.n:
            return np.empty(0, np.int64), np.empty(0)
        cells, lengths = self._ranges(self.cell_starts[ids], self.cell_starts[ids + 1])
        blocks, heights = self.cell_blocks[cells], np.repeat(weights, lengths)
        bounds = np.bincount(blocks, self.largest[cells] * heights, self.n_blocks)
        order = np.argsort(-bounds, kind="stable")

        def of_blocks(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            marked = np.zeros(self.n_blocks, bool)
            marked[chosen] = True
            own = marked[blocks]
            at = cells[own]
            return self._best(self._scores(self.cell_firsts[at], self.cell_firsts[at + 1], heights[own]), k, without)

        first = order[:FIRST_BLOCKS]
        best = of_blocks(first)
        least = best[1][-1] if len(best[0]) == k else 0.0
        rest = order[FIRST_BLOCKS:]
        reach = rest[(bounds[rest] > 0) & (bounds[rest] >= least - 1e-9)]
        if not len(reach):
            return best
        if 2 * len(reach) < self.n_blocks:
            return of_blocks(np.concatenate((first, reach)))
        return self._best(self._scores(self.starts[ids], self.starts[ids + 1], weights), k, without)

    @staticmethod
    def _best(sums: np.ndarray, k: int, without: int) -> tuple[np.ndarray, np.ndarray]:
        sums = np.round(sums, 9)
        if without >= 0:
            sums[without] = 0.0
        best = np.flatnonzero(sums >= np.partition(sums, -k)[-k]) if len(sums) > k else np.arange(len(sums))
        best = best[sums[best] > 0]
        best = best[np.argsort(-sums[best], kind="stable")][:k]
        return best, sums[best]


def _entropy_part(observed: np.ndarray, expected: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(observed > 0, observed * np.log(observed / expected), 0.0)


def relevance(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """From 0 to 1: how surely a word's rate differs between toxic and clean examples.

    1 for all words if there are examples of one label only.
    """
    if not n_toxic or not n_clean:
        return np.ones(len(toxic))
    share = (toxic + clean) / (n_toxic + n_clean)
    ratio = 2 * (
        _entropy_part(toxic, n_toxic * share)
        + _entropy_part(clean, n_clean * share)
        + _entropy_part(n_toxic - toxic, n_toxic * (1 - share))
        + _entropy_part(n_clean - clean, n_clean * (1 - share))
    )
    ratio = np.maximum(ratio, 1e-3)
    return ratio / (ratio + RELEVANCE)


def _log_odds(share):
    share = np.clip(share, 1e-3, 1 - 1e-3)
    return np.log(share / (1 - share))


def calibration(shares: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope (positive) and offset of the logistic curve that fits the labels best; 1 and 0 for one label."""
    if len(set(labels.tolist())) < 2:
        return 1.0, 0.0
    x = _log_odds(shares)
    ones, zeros = weights[labels == 1].sum(), weights[labels == 0].sum()
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    design = np.stack((x, np.ones_like(x)), axis=1)
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ at))
        gradient = design.T @ (weights * (p - target))
        curve = (design * (weights * p * (1 - p))[:, None]).T @ design + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        at = at - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return (float(at[0]), float(at[1])) if at[0] > 0 else (1.0, 0.0)


class Voter:
    """What the tasks need: an index, the labels and ids of its examples, word weights and calibration.

    ``examples`` are doc_id, label, and the word numbers and counts, in index order.
    """

    def __init__(self, examples: list[tuple], n_class: dict[int, int], idf: np.ndarray):
        self.labels = np.array([e[1] for e in examples], np.int64)
        self.ids = np.array([e[0] for e in examples], np.int64)
        used = Counter(self.labels.tolist())
        found = [np.bincount(np.concatenate([e[2] for e in examples if e[1] == c] or [np.empty(0, np.int64)]), minlength=len(idf)) for c in (1, 0)]
        self.weights = idf * relevance(*found, used[1], used[0])
        self.index = BlockMaxIndex([self.unit(ids, counts) for _, _, ids, counts in examples], len(idf))
        self.votes = np.array([n_class[c] / used[c] for c in self.labels.tolist()])
        whole = sum(n_class[c] for c in used)
        self.prior = n_class.get(1, 0) / whole if used[1] else 0.0
        self.vectors = [(ids, counts) for _, _, ids, counts in examples]
        self.slope, self.offset = 1.0, 0.0

    def own_share(self, at: int) -> float:
        """The share of toxic votes among the other examples' votes on an example."""
        return self.share(*self.index.nearest(*self.unit(*self.vectors[at]), without=at))

    def calibrate(self, shares: np.ndarray) -> None:
        """Fit the curve to the examples' own shares; the vectors are not needed any more."""
        self.slope, self.offset = calibration(shares, self.labels, self.votes)
        self.vectors = []

    def unit(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weights = (1 + np.log(counts)) * self.weights[ids]
        return ids, weights / (np.linalg.norm(weights) or 1.0)

    def share(self, best: np.ndarray, products: np.ndarray) -> float:
        """Toxic votes among the votes of the nearest examples, by inverse distance."""
        votes = self.votes[best] / (1 - np.minimum(products, 1.0) + NEAREST_DISTANCE)
        every = votes.sum()
        return float((votes * self.labels[best]).sum() / every) if every else self.prior

    def score(self, ids: np.ndarray, counts: np.ndarray) -> tuple[float, list[int], list[float]]:
        """Calibrated score, and the ids and cosines of the examples that voted."""
        best, products = self.index.nearest(*self.unit(ids, counts))
        if not self.prior:
            return 0.0, self.ids[best].tolist(), products.tolist()
        at = self.slope * _log_odds(self.share(best, products)) + self.offset
        return float(1 / (1 + np.exp(-at))), self.ids[best].tolist(), products.tolist()


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> tuple[list[bytes], Voter]:
    """The words of the examples and the voter. Document frequencies are counted over all documents."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sample = stored(labelled_sample(labels, label, {1: TOXIC, 0: CLEAN}))
    n_class = {row["label"]: row["n_class"] for row in sample.select("label", "n_class").distinct().collect()}
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    chosen = texts.join(F.broadcast(sample.select("doc_id", "label")), "doc_id")
    examples = chosen.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("text").alias("text"))
    found = examples.mapInArrow(_example_words, "doc_id long, label int, words array<binary>, counts array<int>").toArrow()
    found = found.sort_by([("label", "ascending"), ("doc_id", "ascending")]).combine_chunks()
    words = sorted(set(found["words"].combine_chunks().flatten().to_pylist()))
    number = {word: i for i, word in enumerate(words)}
    vectors = []
    for row in zip(*(found[n].to_pylist() for n in ("doc_id", "label")), found["words"], found["counts"], strict=True):
        ids = np.array([number[w] for w in row[2].as_py()], np.int64)
        vectors.append((row[0], row[1], ids, np.array(row[3].as_py(), np.int64)))
    shipped = spark.sparkContext.broadcast(words)
    counted = texts.select("text").mapInArrow(_frequencies(shipped, len(words)), "i long, n long")
    table = counted.groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(len(words))
    frequency[table["i"].to_numpy()] = table["n"].to_numpy()
    idf = np.log((1 + docs.count()) / (1 + frequency)) + 1
    voter = Voter(vectors, n_class, idf)
    voter.calibrate(_own_shares(spark, voter))
    return words, voter


def _own_shares(spark: SparkSession, voter: Voter) -> np.ndarray:
    """Each example's share, found by the executors; at most ``TOXIC + CLEAN`` numbers."""
    shipped = spark.sparkContext.broadcast(voter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = [shipped.value.own_share(at) for at in batch.column("id").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(shares, pa.float64())], ["id", "share"])

    found = spark.range(0, len(voter.ids), 1, 16).mapInArrow(run, "id long, share double").toArrow().sort_by("id")
    shipped.destroy()
    return found["share"].to_numpy()


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """One row per document: row number, doc_id, held_out, score, predicted and the evidence.

    ``evidence_ids`` and ``evidence_similarities`` are the nearest examples, nearest first.
    """
    words, voter = fit(docs, labels, label)
    shipped = docs.sparkSession.sparkContext.broadcast((words, voter))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, own = shipped.value
        vocabulary, known = Vocabulary(words), {}
        for batch in batches:
            found = []
            for ids, counts in vocabulary.vectors(batch.column("text").to_pylist()):
                key = blake2b(ids.tobytes() + counts.tobytes(), digest_size=16).digest()
                if key not in known:
                    if len(known) >= CACHED:
                        known.clear()
                    known[key] = own.score(ids, counts)
                found.append(known[key])
            columns = [
                pa.array([x[0] for x in found], pa.float64()),
                pa.array([x[1] for x in found], pa.list_(pa.int64())),
                pa.array([x[2] for x in found], pa.list_(pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(ROW), batch.column("doc_id"), *columns], names)

    names = [ROW, "doc_id", "score", "evidence_ids", "evidence_similarities"]
    kinds = ["long", "long", "double", "array<bigint>", "array<double>"]
    rows = with_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")))
    scored = rows.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    return scored.select(
        ROW,
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "evidence_ids",
        "evidence_similarities",
    )
