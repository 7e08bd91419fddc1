"""Removal of repeated word windows, with a count-min prefilter.

Every window of ``window`` words is counted under its anchor (see ``anchors``). The anchors'
counts go into a count-min sketch of two lines: each partition counts the cells it meets,
and the partition sketches are merged by summing cells. Cells are kept sparse, so a line
can be wide enough for any corpus. A cell's sum is never below the count of a window filed
under it, so a window whose estimate is below two occurs once and leaves; none is lost.

What is left is grouped exactly, in two steps. The windows in a row under one anchor form a
segment; segments with equal words repeat as a whole. The windows of the other segments
are compared one by one with each other and with one copy of each repeated segment under
the same anchor, by 128-bit digests of their words. Windows are judged on the input.

No table is larger than the anchors, and each text is shuffled once. A passage that very many
documents share is summed per task before it is shuffled, and joins to it can be split.

Defined cases: a null or empty text has no words; a text of fewer words than a window stays
whole; a window may repeat in its own document; ids may be null or repeat (rows are told
apart by number); a very long text is read in pieces and its windows over the cuts are those of the whole;
extra columns are ignored, whatever their names; an empty table gives an empty result. ``docs``
must be a table scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylog.llm.anchors import window_anchors, word_hashes
from tallylog.llm.batches import bounded_batches
from tallylog.llm.common import ROW, stored, text_pieces, whole_text, with_rows

WINDOW, GRAM = 35, 12
#: Cells of a sketch line: 2**44, for up to some 10**12 anchors.
WIDTH_BITS = 44
#: Rows of Arrow batches that tasks send back.
OUT_ROWS = 50_000


def _word_runs(text: str, overlap: int) -> Iterator[tuple[int, list[bytes]]]:
    """Number of the first word, and the words, of each piece of a text; pieces overlap."""
    base, carried = 0, []
    for piece in text_pieces(text):
        words = carried + piece.encode().split()
        yield base, words
        carried = words[len(words) - overlap :] if overlap and len(words) >= overlap else words if overlap else []
        base += len(words) - len(carried)


def text_segments(text: str, window: int = WINDOW, gram: int = GRAM) -> Iterator[tuple[int, int, int, int]]:
    """Anchor hash, digest of the words, first window and number of windows of each segment."""
    for base, words in _word_runs(text, window - 1):
        if len(words) < window:
            continue
        joined = b" ".join(words)
        starts, hashes = word_hashes(joined)
        anchors, _, firsts = window_anchors(hashes, window, gram)
        begins, ends = starts[firsts[:-1]], starts[firsts[1:] - 1 + window] - 1
        digests = (blake2b(joined[a:b], digest_size=8).digest() for a, b in zip(begins.tolist(), ends.tolist(), strict=True))
        words_of = np.frombuffer(b"".join(digests), "<i8")
        yield from zip(
            anchors.view(np.int64).tolist(), words_of.tolist(), (firsts[:-1] + base).tolist(), np.diff(firsts).tolist(), strict=True
        )


def _anchor_batches(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[int] = []
            for text in batch.column("text").to_pylist():
                found += [s[0] for s in text_segments(text, window, gram)]
                if len(found) > OUT_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["anchor"])
                    found = []
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["anchor"])

    return run


def _segment_batches(window: int, gram: int):
    names = [ROW, "anchor", "words", "span"]

    def batch_of(rows, anchors, words, spans):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (rows, anchors, words, spans)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: tuple[list[int], ...] = ([], [], [], [])
            for row, text in zip(batch.column(ROW).to_pylist(), batch.column("text").to_pylist(), strict=True):
                for anchor, words, first, n in text_segments(text, window, gram):
                    for column, value in zip(columns, (row, anchor, words, first << 8 | n), strict=True):
                        column.append(value)
                if len(columns[0]) > OUT_ROWS:
                    yield batch_of(*columns)
                    columns = ([], [], [], [])
            yield batch_of(*columns)

    return run


def cell(line: int, anchor: Column) -> Column:
    """Cell of an anchor in a line of the sketch."""
    hashed = anchor if line == 0 else F.xxhash64(F.lit(line), anchor)
    return F.shiftrightunsigned(hashed, 64 - WIDTH_BITS)


def repeated_cells(texts: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``line, cell`` of the merged sketch's cells with a count of two or more."""
    anchors = texts.select("text").mapInArrow(_anchor_batches(window, gram), "anchor long")
    cells = F.array(*[F.struct(F.lit(line).alias("line"), cell(line, F.col("anchor")).alias("cell")) for line in (0, 1)])
    return (
        anchors.select(F.explode(cells).alias("c"))
        .groupBy("c.line", "c.cell")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("line", "cell")
    )


def _window_batches(window: int):
    """Digests of the windows in the spans asked for."""
    names = [ROW, "start", "alone", "high", "low"]

    def batch_of(rows, starts, alone, digests):
        halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        columns = [pa.array(rows, pa.int64()), pa.array(starts, pa.int64()), pa.array(alone, pa.bool_())]
        return pa.RecordBatch.from_arrays([*columns, pa.array(halves[:, 0]), pa.array(halves[:, 1])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for row, doc, asked in zip(
                batch.column(ROW).to_pylist(), batch.column("doc").to_pylist(), batch.column("asked").to_pylist(), strict=True
            ):
                for base, words in _word_runs(doc["text"], window - 1):
                    joined = b" ".join(words)
                    places = word_hashes(joined)[0].tolist() if len(words) >= window else []
                    last = base + len(words) - window
                    for one in asked:
                        first, n = one["span"] >> 8, one["span"] & 255
                        for start in range(max(first, base), min(first + n - 1, last) + 1):
                            a, b = places[start - base], places[start - base + window] - 1
                            digest = blake2b(joined[a:b], digest_size=16).digest()
                            for column, value in zip(out, (row, start, one["alone"], digest), strict=True):
                                column.append(value)
                if len(out[0]) > OUT_ROWS:
                    yield batch_of(*out)
                    out = ([], [], [], [])
            yield batch_of(*out)

    return run


def kept_words(text: str, spans: list[int], window: int = WINDOW) -> tuple[int, int, str]:
    """Number of words, number removed, and the kept words joined by one space."""
    firsts = np.array([s >> 8 for s in spans], np.int64)
    ends = firsts + np.array([s & 255 for s in spans], np.int64) + window - 1
    whole, removed, parts = 0, 0, []
    for base, words in _word_runs(text, 0):
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, np.clip(firsts - base, 0, len(words)), 1)
        np.add.at(change, np.clip(ends - base, 0, len(words)), -1)
        covered = np.cumsum(change)[:-1] > 0
        whole, removed = whole + len(words), removed + int(covered.sum())
        parts += [word for word, gone in zip(words, covered.tolist(), strict=True) if not gone]
    return whole, removed, b" ".join(parts).decode()


def _kept_batches(window: int):
    names = [ROW, "doc_id", "n_words", "n_removed", "kept_text"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (row, doc["doc_id"], *kept_words(doc["text"], spans or [], window))
                for row, doc, spans in zip(
                    batch.column(ROW).to_pylist(), batch.column("doc").to_pylist(), batch.column("spans").to_pylist(), strict=True
                )
            ]
            if rows:
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document: row number, doc_id, n_words, n_removed, kept_text."""
    if not 1 <= gram <= window or window - gram >= 255:
        raise ValueError("the gram must fit the window, with fewer than 255 places in it")
    bounded_batches(docs.sparkSession)
    rows = with_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")))
    cells = stored(repeated_cells(rows, window, gram))
    first_line, second_line = (cells.where(F.col("line") == line).select(F.col("cell").alias(f"cell{line}")) for line in (0, 1))

    segments = rows.select(ROW, "text").mapInArrow(
        _segment_batches(window, gram), f"{ROW} long, anchor long, words long, span long"
    )
    shared = stored(segments.join(first_line, cell(0, F.col("anchor")) == F.col("cell0"), "left_semi"))
    grouped = shared.groupBy("anchor", "words").agg(
        F.count(F.lit(1)).alias("n"), F.first(ROW).alias(ROW), F.first("span").alias("span")
    )
    # Joined on the complement: both sides are then shuffled for the join, and a passage that very
    # many documents share is split over tasks.
    repeated = grouped.where("n > 1").select(F.bitwise_not("anchor").alias("a"), F.col("words").alias("w"))
    same = (F.bitwise_not("anchor") == F.col("a")) & (F.col("words") == F.col("w"))
    whole = shared.join(repeated, same, "left_semi").select(ROW, "span")

    mixed = (
        grouped.groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("kinds"), F.sum((F.col("n") == 1).cast("int")).alias("alone"))
        .where("kinds > 1 AND alone > 0")
        .select(F.col("anchor").alias("a"))
        .join(second_line, cell(1, F.col("a")) == F.col("cell1"), "left_semi")
    )
    asked = (
        grouped.join(mixed, F.col("anchor") == F.col("a"), "left_semi")
        .groupBy(ROW)
        .agg(F.collect_list(F.struct("span", (F.col("n") == 1).alias("alone"))).alias("asked"))
    )
    texts = rows.select(ROW, F.struct("doc_id", "text").alias("doc"))
    windows = texts.join(asked, ROW).mapInArrow(
        _window_batches(window), f"{ROW} long, start long, alone boolean, high long, low long"
    )
    counts = windows.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n"))
    again = counts.where("n > 1").select(F.bitwise_not("high").alias("h"), F.col("low").alias("l"))
    single = (
        windows.where("alone")
        .join(again, (F.bitwise_not("high") == F.col("h")) & (F.col("low") == F.col("l")), "left_semi")
        .select(ROW, (F.shiftleft("start", 8).bitwiseOR(F.lit(1))).alias("span"))
    )
    spans = whole.union(single).groupBy(ROW).agg(F.collect_list("span").alias("spans"))
    return texts.join(spans, ROW, "left").mapInArrow(
        _kept_batches(window), f"{ROW} long, doc_id long, n_words long, n_removed long, kept_text string"
    )
