"""Merkle manifest of a dataset as a content-addressed DAG, with proofs by descent.

Each document is a leaf, the sha256 of its fields. The leaves of a source, in order of doc_id,
are combined sixteen at a time until one node, the subroot, is left; the subroots, in order of
source, are combined likewise into the root. The store holds a record from digest to children
for every inner node, once per digest. A proof is found from the root down: at each height the
nodes on requested paths are looked up by digest, the next digit of the rank selects a child, and
the children not selected become a segment of the path. Paths are shared until they part, so a
node is looked up once however many leaves lie below it. Reversed, the segments are the proof.

Ranks come from one range-partitioned sort by source and doc_id, so a source that holds most rows is
spread over tasks; only the first and last source of each partition reach the driver.

Defined cases: a null field is written ``-``, so a null text differs from an empty one; null
sources and ids come first; rows that share source and doc_id are ordered by leaf, and equal
rows have equal leaves and, each at its own rank, own proofs; a null doc_id is never tampered with;
a very long text is hashed whole and goes no further; an empty table has no root and gives an empty
result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylog.llm.batches import bounded_batches
from tallylog.llm.common import ROW, stored, with_rows

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY_BITS = 4
HEX = 64
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_PATH = "array<struct<digit:int,others:string>>"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(text: Column | None = None) -> Column:
    """Digest of a row's fields, with another text if one is given."""
    values = [text if name == "text" and text is not None else F.col(name) for name in FIELDS]
    return F.sha2(F.concat(*map(_field, values)), 256)


def tampered_leaf() -> Column:
    """For every fifth document by hash of its id, the leaf with its text in lower case; else null."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return F.when(chosen, leaf_digest(F.translate("text", CAPITALS, CAPITALS.lower())))


def _joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows range-partitioned and sorted by source and doc_id (stored)."""
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col(ROW)]
    return stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop(ROW))


def _with_places(ordered: DataFrame) -> DataFrame:
    """``at`` and, within its partition, each row's number of source and its rank in the source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, number, rank = None, -1, 0
        for batch in batches:
            numbers, ranks = [], []
            for source in batch.column("source").to_pylist():
                if number < 0 or source != last:
                    last, number, rank = source, number + 1, 0
                numbers.append(number)
                ranks.append(rank)
                rank += 1
            columns = [batch.column(n) for n in names]
            columns += [pa.array(numbers, pa.int64()), pa.array(ranks, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "number", "place"])

    rows = ordered.withColumn("part", F.shiftright(F.monotonically_increasing_id(), 33))
    names = rows.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, number long, place long")


def ranked_leaves(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, tampered, tree, rank``: ``tree`` is the source's place, ``rank`` the leaf's in it."""
    spark = docs.sparkSession
    bounded_batches(spark)
    own = with_rows(docs.select(*FIELDS))
    narrow = stored(own.select("source", F.col("doc_id").cast("long").alias("doc_id"), leaf_digest().alias("leaf"), tampered_leaf().alias("tampered"), ROW))
    placed = _with_places(_ordered(narrow))
    ends = (
        placed.groupBy("part", "number")
        .agg(F.first(F.sha2(_field(F.col("source")), 256)).alias("key"), F.count(F.lit(1)).alias("n"))
        .groupBy("part")
        .agg(
            F.max("number").alias("last"),
            F.min_by("key", "number").alias("first_key"),
            F.max_by("key", "number").alias("last_key"),
            F.max_by("n", "number").alias("n_last"),
        )
        .orderBy("part")
    )
    # One row per partition. A partition goes on with the last source before it, or starts a new one.
    bases, tree, key, held = [], -1, None, 0
    for row in ends.collect():
        goes_on = row["first_key"] == key
        first = tree if goes_on else tree + 1
        bases.append((row["part"], first, held if goes_on else 0))
        tree = first + row["last"]
        held = row["n_last"] + (held if goes_on and not row["last"] else 0)
        key = row["last_key"]
    before = spark.createDataFrame(bases, "part long, first_tree long, held long")
    return placed.join(F.broadcast(before), "part").select(
        "doc_id",
        "leaf",
        "tampered",
        (F.col("first_tree") + F.col("number")).alias("tree"),
        (F.col("place") + F.when(F.col("number") == 0, F.col("held")).otherwise(0)).alias("rank"),
    )


def _combined(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Inner records (``digest, children``) by height from 1, and ``tree, digest, height`` of the tops.

    ``nodes`` are ``tree, rank, digest`` with ranks from 0. A run that starts at 0 with one node
    means that the tree has no other node, so it is done.
    """
    records, tops, height = [], None, 0
    while True:
        runs = stored(
            nodes.groupBy("tree", F.shiftright("rank", ARITY_BITS).alias("rank"))
            .agg(F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("members"))
            .select("tree", "rank", F.col("members.digest").alias("children"))
            .withColumn("done", (F.col("rank") == 0) & (F.size("children") == 1))
        )
        done = runs.where("done").select("tree", F.col("children")[0].alias("digest"), F.lit(height).alias("height"))
        tops = done if tops is None else tops.unionByName(done)
        open_runs = runs.where("not done")
        if open_runs.isEmpty():
            return records, tops
        nodes = stored(open_runs.select("tree", "rank", F.sha2(_joined(F.col("children")), 256).alias("digest"), "children"))
        records.append(nodes.select("digest", "children").dropDuplicates(["digest"]))
        nodes, height = nodes.drop("children"), height + 1


@dataclass
class Manifest:
    """Digest-to-children records of the trees of sources and of the tree above them."""

    leaves: DataFrame
    records: list[DataFrame]
    subroots: DataFrame
    top_records: list[DataFrame]
    root: str | None


def build(docs: DataFrame) -> Manifest:
    leaves = ranked_leaves(docs)
    records, tops = _combined(leaves.select("tree", "rank", F.col("leaf").alias("digest")))
    subroots = stored(tops)
    above = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"), "digest")
    top_records, roots = _combined(above)
    root = roots.first()
    return Manifest(leaves, records, subroots, top_records, root["digest"] if root else None)


def _segment(children: Column, digit: Column) -> Column:
    """What a path keeps of a node: the digit that selects a child, and the other children."""
    others = F.concat(_joined(F.slice(children, F.lit(1), digit)), _joined(F.slice(children, digit + 2, F.size(children))))
    return F.struct(digit.cast("int").alias("digit"), others.alias("others"))


def _opened(frontier: DataFrame, records: DataFrame) -> DataFrame:
    """The children of the nodes at the frontier, each with its path."""
    found = frontier.join(records, "digest").select("tree", "rank", "path", "children", F.posexplode("children").alias("digit", "child"))
    return found.select(
        "tree",
        (F.shiftleft("rank", ARITY_BITS) + F.col("digit")).alias("rank"),
        F.col("child").alias("digest"),
        F.concat("path", F.array(_segment(F.col("children"), F.col("digit")))).alias("path"),
    )


def paths(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """``doc_id, leaf, tampered, subroot`` and ``path`` (segments from the root down) of requested leaves.

    ``requests`` are rows of ``manifest.leaves``; without them all leaves are requested. The last
    height is opened where the requests are, so no path of a single leaf is shuffled.
    """
    spark = manifest.subroots.sparkSession
    wanted = manifest.leaves if requests is None else requests

    def on_path(frontier: DataFrame, prefix: list[Column], keys: list[str]) -> DataFrame:
        if requests is None:
            return frontier
        return frontier.join(requests.select(*prefix).distinct(), keys, "left_semi")

    start = spark.createDataFrame([(0, 0, manifest.root)], "tree long, rank long, digest string")
    frontier = start.withColumn("path", F.expr(f"cast(array() as {_PATH})"))
    for height in range(len(manifest.top_records), 0, -1):
        opened = _opened(frontier, manifest.top_records[height - 1])
        prefix = F.shiftright("tree", ARITY_BITS * (height - 1)).alias("rank")
        frontier = stored(on_path(opened, [prefix], ["rank"]))
    reached = frontier.select(F.col("rank").alias("tree"), F.col("digest").alias("subroot"), "path")
    heights = manifest.subroots.select("tree", "height")
    reached = stored(reached.join(heights, "tree").select("*", F.lit(0).cast("long").alias("rank"), F.col("subroot").alias("digest")))
    frontier = reached.where("false").select("tree", "rank", "digest", "path")
    for height in range(len(manifest.records), 1, -1):
        entered = reached.where(F.col("height") == height).select("tree", "rank", "digest", "path")
        opened = _opened(frontier.unionByName(entered), manifest.records[height - 1])
        prefix = F.shiftright("rank", ARITY_BITS * (height - 1)).alias("rank")
        frontier = stored(on_path(opened, ["tree", prefix], ["tree", "rank"]))
    lowest = frontier.unionByName(reached.where("height = 1").select("tree", "rank", "digest", "path"))
    bottom = reached.where("height = 0").select("tree", "rank", "path", F.lit(None).cast("array<string>").alias("children"))
    if manifest.records:
        bottom = bottom.unionByName(lowest.join(manifest.records[0], "digest").select("tree", "rank", "path", "children"))
    bottom = bottom.join(reached.select("tree", "subroot"), "tree").withColumnRenamed("rank", "run")
    leaves = wanted.withColumn("run", F.shiftright("rank", ARITY_BITS))
    digit = F.col("rank").bitwiseAND((1 << ARITY_BITS) - 1).cast("int")
    last = F.when(F.col("children").isNull(), F.expr(f"cast(array() as {_PATH})")).otherwise(F.array(_segment(F.col("children"), digit)))
    return leaves.join(bottom, ["tree", "run"]).select("doc_id", "leaf", "tampered", "subroot", F.concat("path", last).alias("path"))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof (segments from the leaf up) give."""

    def step(node: Column, segment: Column) -> Column:
        before = HEX * segment["digit"]
        others = segment["others"]
        return F.sha2(F.concat(F.substr(others, F.lit(1), before), node, F.substr(others, before + 1)), 256)

    return F.aggregate(proof, leaf, step)


def verify(docs: DataFrame) -> DataFrame:
    """Per document its leaf, subroot and root, its proof's digest, and the root its (tampered) leaf gives."""
    manifest = build(docs)
    if manifest.root is None:
        return docs.sparkSession.createDataFrame(
            [], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        )
    proof = F.reverse("path")
    root = F.lit(manifest.root)
    return (
        paths(manifest)
        .withColumns({"root": root, "folded_root": folded(F.coalesce("tampered", "leaf"), proof)})
        .select(
            "doc_id",
            "leaf",
            "subroot",
            "root",
            F.sha2(_joined(F.transform(proof, lambda s: s["others"])), 256).alias("proof_sha256"),
            "folded_root",
            (F.col("folded_root") == F.col("root")).alias("verified"),
        )
    )


def _sql_field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def _sql_leaf(text: str) -> str:
    return f"sha256({' || '.join(_sql_field(text if name == 'text' else name) for name in FIELDS)})"


#: DuckDB SQL of :func:`verify`. crc32 is written out over the digits of the id.
SQL = f"""
WITH RECURSIVE d AS (
  SELECT *, list_reduce(
    [4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))
  ) AS inverted
  FROM documents
), leaves AS (
  SELECT doc_id, source, {_sql_leaf("text")} AS leaf,
         CASE WHEN xor(inverted, 4294967295) % 5 = 0 THEN {_sql_leaf(f"translate(text, '{CAPITALS}', '{CAPITALS.lower()}')")} END AS tampered
  FROM d
), ranked AS (
  SELECT doc_id, leaf, tampered, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank
  FROM leaves
), nodes AS (
  SELECT tree, 0 AS h, rank, count(*) OVER (PARTITION BY tree) AS n, leaf AS digest FROM ranked
  UNION ALL
  SELECT tree, h + 1, rank // 16, (any_value(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY rank))
  FROM nodes WHERE n > 1 GROUP BY tree, h, rank // 16
), subroots AS (
  SELECT tree, digest FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS h, tree AS rank, count(*) OVER () AS n, digest FROM subroots
  UNION ALL
  SELECT h + 1, rank // 16, (any_value(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY rank))
  FROM tops WHERE n > 1 GROUP BY h, rank // 16
), runs AS (
  SELECT tree, h, rank // 16 AS run, string_agg(digest, '' ORDER BY rank) AS members
  FROM nodes WHERE n > 1 GROUP BY tree, h, rank // 16
), top_runs AS (
  SELECT h, rank // 16 AS run, string_agg(digest, '' ORDER BY rank) AS members FROM tops WHERE n > 1 GROUP BY h, rank // 16
), cells AS (
  SELECT r.tree, r.rank, 0 AS above, runs.h, (r.rank >> (4 * runs.h)) % 16 AS digit, members
  FROM ranked r JOIN runs ON runs.tree = r.tree AND runs.run = r.rank >> (4 * runs.h + 4)
  UNION ALL
  SELECT r.tree, r.rank, 1, t.h, (r.tree >> (4 * t.h)) % 16, members
  FROM ranked r JOIN top_runs t ON t.run = r.tree >> (4 * t.h + 4)
), segments AS (
  SELECT tree, rank, row_number() OVER (PARTITION BY tree, rank ORDER BY above, h) AS step,
         substr(members, 1, 64 * digit) AS head, substr(members, 64 * digit + 65) AS tail
  FROM cells
), proofs AS (
  SELECT tree, rank, string_agg(head || tail, '' ORDER BY step) AS proof, max(step) AS steps FROM segments GROUP BY tree, rank
), folds AS (
  SELECT tree, rank, 0 AS step, coalesce(tampered, leaf) AS node FROM ranked
  UNION ALL
  SELECT f.tree, f.rank, s.step, sha256(head || node || tail)
  FROM folds f JOIN segments s ON s.tree = f.tree AND s.rank = f.rank AND s.step = f.step + 1
)
SELECT r.doc_id, r.leaf, s.digest AS subroot, root.digest AS root, sha256(coalesce(p.proof, '')) AS proof_sha256,
       f.node AS folded_root, f.node = root.digest AS verified
FROM ranked r JOIN subroots s USING (tree)
CROSS JOIN (SELECT digest FROM tops WHERE n = 1) root
LEFT JOIN proofs p ON p.tree = r.tree AND p.rank = r.rank
JOIN folds f ON f.tree = r.tree AND f.rank = r.rank AND f.step = coalesce(p.steps, 0)
"""
