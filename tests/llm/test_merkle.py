"""The Merkle manifest against a tree built in plain Python."""

import hashlib
import zlib

from conftest import SMALL
from test_operators import DOC_SCHEMA, documents, empty, odd, odd_rows  # noqa: F401

from tallylog.llm import merkle
from tallylog.session import fresh_name, shared_folder


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def written(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, text):
    return digest(*map(written, (row.doc_id, row.source, row.lang, row.n_chars, text)))


def levels(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [digest(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        out.append(nodes)
    return out


def proof_of(tree, at):
    proof = []
    for level in tree[:-1]:
        first = at // 16 * 16
        proof.append((at % 16, [x for i, x in enumerate(level[first : first + 16]) if i != at % 16]))
        at //= 16
    return proof


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row.source, []).append(row)
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for own in groups.values():
        own.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text)))
    trees = [levels([leaf_of(r, r.text) for r in groups[s]]) for s in sources]
    top = levels([t[-1][0] for t in trees])
    found = []
    for number, source in enumerate(sources):
        for at, row in enumerate(groups[source]):
            proof = proof_of(trees[number], at) + proof_of(top, number)
            text = row.text
            if text is not None and row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf_of(row, text)
            for digit, others in proof:
                node = digest(*others[:digit], node, *others[digit:])
            siblings = digest(*(x for _, others in proof for x in others))
            root = top[-1][0]
            found.append((row.doc_id, leaf_of(row, row.text), trees[number][-1][0], root, siblings, node, node == root))
    return sorted(found, key=str)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_equals_plain_tree(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    expected = brute(docs.collect())
    assert rows_of(merkle.verify(docs)) == expected
    assert {r[-1] for r in expected} == {True, False}


def test_deep_trees_and_many_sources(spark):
    """A hot source over many partitions, sources of one leaf, and repeated rows."""
    rows = [(i, "Hot", "hot") for i in range(700)] + [(i, "Rare", f"s{i:03}") for i in range(700, 760)]
    rows += [(5, "Same", "same")] * 40 + [(None, "N", None), (None, "N", None)]
    path = f"{shared_folder(spark)}/{fresh_name('tree')}"
    spark.createDataFrame(documents(rows), DOC_SCHEMA).repartition(7).write.parquet(path)
    docs = spark.read.parquet(path)
    assert rows_of(merkle.verify(docs)) == brute(docs.collect())


def test_odd_rows(odd):  # noqa: F811
    assert rows_of(merkle.verify(odd)) == brute(odd.collect())


def test_one_row_and_no_row(spark, empty):  # noqa: F811
    one = spark.createDataFrame(documents([(3, "Text", "a")]), DOC_SCHEMA)
    assert rows_of(merkle.verify(one)) == brute(one.collect())
    assert merkle.verify(empty).collect() == []


def test_proofs_of_some_leaves(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    manifest = merkle.build(docs)
    asked = manifest.leaves.where("doc_id % 7 = 0")
    expected = {r.doc_id: r.path for r in merkle.paths(manifest).collect()}
    some = {r.doc_id: r.path for r in merkle.paths(manifest, asked).collect()}
    assert some == {i: path for i, path in expected.items() if i % 7 == 0}


def test_records_name_their_content(spark):
    manifest = merkle.build(spark.read.parquet(f"{SMALL}/documents.parquet"))
    for records in manifest.records + manifest.top_records:
        rows = records.collect()
        assert all(r.digest == digest(*r.children) for r in rows)
        assert len({r.digest for r in rows}) == len(rows)
