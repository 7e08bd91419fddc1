"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints that differ in at most ``distance`` bits differ in at most as many of their
8 bytes, so they share at least 8 - distance bytes at the same positions. Posting lists
are kept per four byte positions (two of the four byte pairs: one pair of the four stays
untouched twice over when two bytes differ), which makes them short. The bytes that a
pair shares at all 8 positions are tallied, pairs below the guaranteed minimum leave, and
the bit distance of the rest is verified.

A posting list longer than ``list_limit`` is not paired up. Its fingerprints are linked
over midpoints instead: each is listed under itself and its 64 one-bit changes, and two
fingerprints meet in such a list exactly if they differ in two bits or fewer. A midpoint has
65 fingerprints at most, so its members are chained to one of them. The links differ, the
components don't.

Defined cases: null and empty texts have fingerprint zero and are linked like any other;
null ids are never a component's id unless it has no other; repeated rows share a
component, of which one row is kept; a very long text is hashed whole, some hundred bytes of memory per
word; extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylog.llm.batches import bounded_batches
from tallylog.llm.common import LAST, ROW, stored, with_rows
from tallylog.llm.components import components

SHINGLE = 3
DISTANCE = 2
HASH_SEED = 42
LIST_LIMIT = 64
#: Hashes whose bits are counted at a time (64 bytes each).
CHUNK = 1 << 16


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles, repeats included, as a signed 64-bit number."""
    joined = b" ".join(text.encode().lower().split())
    if not joined:
        return 0
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate(([0], spaces + 1))
    ends = np.append(spaces, len(joined))
    if len(starts) > shingle:
        starts, ends = starts[: len(starts) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        spans = zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[s:e], HASH_SEED) for s, e in spans), "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    set_bits = (2 * counts > len(starts)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<i8")[0])


def _fingerprint_batches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py() or "", shingle) for t in batch.column("text")]
            columns = [batch.column(ROW), batch.column("doc_id"), pa.array(found, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [ROW, "doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Row number, doc_id and fingerprint ``fp`` of each document."""
    bounded_batches(docs.sparkSession)
    rows = with_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return rows.mapInArrow(_fingerprint_batches(shingle), f"{ROW} long, doc_id long, fp long")


def _byte(column, position: int):
    return F.shiftrightunsigned(column, 8 * position).bitwiseAND(F.lit(0xFF))


def postings(distinct: DataFrame) -> DataFrame:
    """Six postings per fingerprint: the bytes at each two of the byte pairs."""
    pairs = [(a, b) for a in range(4) for b in range(a + 1, 4)]
    masks = [(0xFFFF << 16 * a) | (0xFFFF << 16 * b) for a, b in pairs]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    slots = F.array(
        *[
            F.struct(F.lit(i).alias("slot"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
            for i, m in enumerate(signed)
        ]
    )
    return distinct.select("fp", F.explode(slots).alias("p")).select("p.slot", "p.key", "fp")


def links(distinct: DataFrame, distance: int = DISTANCE, list_limit: int = LIST_LIMIT) -> DataFrame:
    """Links ``u``, ``v`` whose components are those of all pairs within ``distance`` bits.

    ``distinct`` has one row per fingerprint ``fp``.
    """
    if not 0 <= distance <= 2:
        raise ValueError("the index guarantees distances of up to 2 bits")
    listed = postings(distinct)
    sizes = listed.groupBy("slot", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(listed.join(sizes, ["slot", "key"]))
    short = shared.where(F.col("n") <= list_limit)
    left, right = short.select("slot", "key", F.col("fp").alias("u")), short.select("slot", "key", F.col("fp").alias("v"))
    tally = sum((_byte(F.col("u"), i) == _byte(F.col("v"), i)).cast("int") for i in range(8))
    paired = (
        left.join(right, ["slot", "key"])
        .where("u < v")
        .where(tally >= 8 - distance)
        .where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance)
        .select("u", "v")
    )
    crowded = shared.where(F.col("n") > list_limit).select("fp").distinct()
    if distance == 2:
        bits = [1 << i for i in range(63)] + [-(1 << 63)]
        middles = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(b)) for b in bits])
        met = crowded.select("fp", F.explode(middles).alias("middle")).groupBy("middle")
        chained = (
            met.agg(F.collect_set("fp").alias("fps"))
            .where(F.size("fps") > 1)
            .select(F.array_min("fps").alias("u"), F.explode("fps").alias("v"))
            .where("u <> v")
        )
    else:
        near = [0] + ([1 << i for i in range(63)] + [-(1 << 63)] if distance else [])
        around = crowded.select(F.col("fp").alias("u"), F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(b)) for b in near])).alias("v"))
        chained = around.join(crowded.select(F.col("fp").alias("v")), "v").where("u < v").select("u", "v")
    return paired.union(chained).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, list_limit: int = LIST_LIMIT) -> DataFrame:
    """One row per document: row number, doc_id, fingerprint (hex), component_id, n_links, kept.

    ``n_links`` counts the links found between this fingerprint and different ones. One row of
    each component is kept, the one with the smallest id. Copies are reduced to one row per
    fingerprint before anything is compared, and come back in a join that can be split.
    """
    marked = stored(fingerprints(docs, shingle))
    classes = stored(
        marked.groupBy("fp").agg(
            F.min("doc_id").alias("least_id"),
            F.min_by(ROW, F.coalesce("doc_id", F.lit(LAST))).alias("least_row"),
        )
    )
    found = stored(links(classes.select("fp"), distance, list_limit))
    roots = components(found)
    degrees = (
        found.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    )
    linked = degrees.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "n_links")
    rooted = stored(
        classes.join(linked, F.col("fp") == F.col("node"), "left").select(
            "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "least_id", "least_row"
        )
    )
    whole = rooted.groupBy("root").agg(
        F.min("least_id").alias("component_id"),
        F.min_by("least_row", F.coalesce("least_id", F.lit(LAST))).alias("keep_row"),
    )
    members = rooted.join(whole, "root").select(_hex("fp").alias("fingerprint"), "component_id", "keep_row", "n_links")
    return (
        marked.select(ROW, "doc_id", _hex("fp").alias("fingerprint"))
        .join(members, "fingerprint")
        .select(ROW, "doc_id", "fingerprint", "component_id", "n_links", (F.col(ROW) == F.col("keep_row")).alias("kept"))
    )


def _hex(column: str):
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
