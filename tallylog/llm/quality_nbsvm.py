"""Text quality by naive Bayes support vectors.

Each word is reduced to its shape (runs of upper-case letters, lower-case letters and
digits, other signs kept), with a mark if it repeats the word before. The indicators of
n-grams of up to three shapes are scaled by the ratio of the classes' log-counts, and a
linear hinge-loss model is fitted to them by dual coordinate descent. Margins of a fifth of
the sample, left out of the fit, map to probabilities by a logistic curve.

Fixed bounds: the model is fitted on at most ``LOW + HIGH`` labelled rows of at most
``FEATURES`` hashed n-grams each. Held-out rows (crc32 of the id, mod 5, is 0) are not among them.

Defined cases: null and empty texts have no n-grams and get the score of the bias alone;
with labels of one class only every score is that class; equal texts get equal scores;
ids may be null or repeat, and of several texts with one labelled id the first in order is learned
from; very long texts are read in pieces with the n-grams of the whole; extra columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylog.llm.batches import bounded_batches
from tallylog.llm.common import ROW, held_out, labelled_sample, text_pieces, whole_text, with_rows

LOW, HIGH = 4000, 8000
FEATURES = 1 << 17
THRESHOLD = 0.3
SMOOTHING, COST, ROUNDS = 1.0, 1.0, 30
#: Distinct words a task remembers; the table starts anew when it is full.
CACHED = 400_000

#: Words that a piece of a text takes over from the one before: two of an n-gram, and the one before them.
CARRIED = 3

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def shape(word: str) -> str:
    """``A``, ``a`` and ``0`` for runs of letters and digits, and each run of another sign once."""
    out, last = [], ""
    for c in word:
        kind = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "a" if c.isalpha() else c
        if kind != last:
            out.append(kind)
            last = kind
    return "".join(out)


class Shapes:
    """Hashed n-gram indicators of texts."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def _code(self, word: str) -> int:
        code = self.known.get(word)
        if code is None:
            if len(self.known) >= CACHED:
                self.known.clear()
            code = zlib.crc32(word.encode()) << 32 | zlib.crc32(shape(word).encode())
            self.known[word] = code
        return code

    def features(self, text: str) -> np.ndarray:
        """Sorted numbers of the n-grams in the text.

        A very long text is taken in pieces. Each goes on from the last two words of the one before, whose
        marks need the word before them, so the n-grams are those of the whole text.
        """
        found, before, seen = [], [], 0
        for piece in text_pieces(text):
            words = before + piece.split()
            found.append(self._features(words, first=seen <= CARRIED))
            seen += len(words) - len(before)
            before = words[-CARRIED:]
        return found[0] if len(found) == 1 else np.unique(np.concatenate(found))

    def _features(self, words: list[str], first: bool = True) -> np.ndarray:
        """The n-grams of the words; unless they are the ``first`` of a text, the first word only marks the next."""
        codes = np.fromiter(map(self._code, words), np.uint64, len(words))
        shapes = (codes & np.uint64(0xFFFFFFFF)) << np.uint64(1)
        shapes[1:] |= (codes[1:] == codes[:-1]).astype(np.uint64)
        shapes = shapes if first else shapes[1:]
        parts, grams = [], np.zeros(len(shapes), np.uint64)
        for n, mix in enumerate(_MIX):
            if len(shapes) <= n:
                break
            grams = (grams[: len(shapes) - n] + shapes[n:] + np.uint64(n + 1)) * mix
            grams ^= grams >> np.uint64(29)
            parts.append((grams * _MIX[0] >> np.uint64(47)).astype(np.int32) % FEATURES)
        return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int32)


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Log of the classes' smoothed n-gram shares, good over bad."""
    counts = {c: np.full(FEATURES, SMOOTHING) for c in (0, 1)}
    for ids, label in zip(rows, labels, strict=True):
        counts[int(label)][ids] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, rounds: int = ROUNDS, cost: float = COST) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised hinge-loss model.

    One dual variable per row, each moved to its optimum given the others, in a shuffled order,
    between 0 and the cost of its class (classes weigh alike).
    """
    signs = np.where(labels == 1, 1.0, -1.0)
    share = {s: max(1, int((signs == s).sum())) for s in (1.0, -1.0)}
    upper = np.array([cost * len(rows) / (2 * share[s]) for s in signs])
    squares = np.array([v @ v + 1.0 for v in values])
    weights, bias, alpha = np.zeros(FEATURES), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(5)
    for _ in range(rounds):
        largest = 0.0
        for i in order.permutation(len(rows)):
            gradient = signs[i] * (weights[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / squares[i], 0.0), upper[i])
            step = (new - alpha[i]) * signs[i]
            if step:
                weights[rows[i]] += step * values[i]
                bias += step
                largest = max(largest, abs(step))
                alpha[i] = new
        if largest < 1e-3:
            break
    return weights, bias


def logistic_curve(margins: np.ndarray, labels: np.ndarray, row_weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset that fit probabilities to margins, by Newton's method with a small ridge."""
    x = np.stack([margins, np.ones_like(margins)], 1)
    fitted = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ fitted, -30, 30)))
        gradient = x.T @ (row_weights * (p - labels)) + 1e-3 * fitted
        hessian = (x * (row_weights * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        fitted = fitted - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(fitted[0]), 1e-6), float(fitted[1])


class Model:
    """Weights per hashed n-gram, with the log-count ratios multiplied in."""

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray, row_weights: np.ndarray):
        if len(set(labels.tolist())) < 2:
            self.weights, self.bias, self.curve = None, float(labels.mean()) if len(labels) else 1.0, None
            return
        fold = np.arange(len(rows)) % 5 == 0
        fit = np.flatnonzero(~fold) if len(set(labels[~fold].tolist())) == 2 else np.arange(len(rows))
        ratios = log_count_ratios([rows[i] for i in fit], labels[fit])
        values = [self._values(ratios, rows[i]) for i in fit]
        weights, self.bias = dual_coordinate_descent([rows[i] for i in fit], values, labels[fit])
        self.weights, self.ratios = weights * ratios, ratios
        left = np.flatnonzero(fold) if len(set(labels[fold].tolist())) == 2 else fit
        margins = np.array([self.margin(rows[i]) for i in left])
        self.curve = logistic_curve(margins, labels[left].astype(float), row_weights[left])

    @staticmethod
    def _values(ratios: np.ndarray, ids: np.ndarray) -> np.ndarray:
        values = ratios[ids]
        return values / (np.linalg.norm(values) or 1.0)

    def margin(self, ids: np.ndarray) -> float:
        norm = np.linalg.norm(self.ratios[ids]) or 1.0
        return float(self.weights[ids].sum() / norm + self.bias)

    def score(self, ids: np.ndarray) -> float:
        if self.weights is None:
            return self.bias
        slope, offset = self.curve
        return float(1 / (1 + np.exp(-np.clip(slope * self.margin(ids) + offset, -30, 30))))


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shapes = Shapes()
    for batch in batches:
        found = [shapes.features(text) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("label"), batch.column("n_class"), pa.array(found, pa.list_(pa.int32()))],
            ["doc_id", "label", "n_class", "ids"],
        )


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """The model; only the n-grams of the bounded sample reach the driver."""
    bounded_batches(docs.sparkSession)
    sample = labelled_sample(labels, label, {0: LOW, 1: HIGH})
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    chosen = texts.join(F.broadcast(sample), "doc_id")
    examples = chosen.groupBy("doc_id", "label", "n_class").agg(F.min("text").alias("text"))
    rows = examples.mapInArrow(_sample_features, "doc_id long, label int, n_class long, ids array<int>").collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], len(r["ids"])))
    found = np.array([r["label"] for r in rows], np.int64)
    used = {c: max(1, int((found == c).sum())) for c in (0, 1)}
    weights = np.array([r["n_class"] / used[r["label"]] for r in rows])
    return Model([np.array(r["ids"], np.int64) for r in rows], found, weights / (weights.mean() if len(rows) else 1.0))


def score(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """One row per document: row number, doc_id, held_out, score and predicted."""
    shipped = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, shapes = shipped.value, Shapes()
        for batch in batches:
            scores = [model.score(shapes.features(text)) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(ROW), batch.column("doc_id"), pa.array(scores, pa.float64())], [ROW, "doc_id", "score"]
            )

    rows = with_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")))
    scored = rows.mapInArrow(run, f"{ROW} long, doc_id long, score double")
    return scored.select(
        ROW, "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
