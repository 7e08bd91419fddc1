"""The registered queries against their SQL, and the pipeline against brute force."""

import hashlib

import pytest
from conftest import SMALL
from oracle_check import connect, differences
from test_operators import brute_components, brute_fingerprint, reference_encoding

import __spark_entry__ as contract
import corpus_pipeline
from tallylog.llm.queries import llm_oracles, llm_queries


@pytest.mark.parametrize("name", sorted(llm_oracles()))
def test_query_equals_sql(spark, name):
    assert differences(llm_queries()[name](spark, SMALL), connect(SMALL), llm_oracles()[name]) is None


def test_queries_are_registered():
    names = set(contract.queries())
    assert set(llm_queries()) | {"pipeline"} <= names
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in llm_queries()}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages, path = dict(corpus_pipeline.STAGES), None
    from tallylog.session import fresh_name, shared_folder

    kept = {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        path = f"{shared_folder(spark)}/{fresh_name('stage')}/{number}"
        stage(spark, docs, SMALL).write.parquet(path)
        docs = spark.read.parquet(path)
        assert sorted(docs.columns) == ["doc_id", "lang", "n_chars", "source", "text"]
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
        if name == "toxicity":
            before = kept[name]
            assert len(before) > 0.7 * 200
        elif name == "exact dedup":
            firsts = {}
            for i in sorted(before):
                firsts.setdefault(" ".join((before[i] or "").encode().decode().split()), i)
            assert set(kept[name]) == set(firsts.values())
            before = kept[name]
        elif name == "SimHash near-dedup":
            ids = sorted(before)
            assert set(kept[name]) == set(brute_components(ids, [brute_fingerprint(before[i]) for i in ids]))
    mixed = docs.collect()
    assert set(kept["mixing sources to target weights"]) <= set(kept["SimHash near-dedup"]) and len(mixed) >= len(kept)
    reference = reference_encoding()
    last = stages["byte-level BPE encoding and decoding"](spark, docs, SMALL).collect()
    assert len(last) == len(mixed)
    texts = kept["mixing sources to target weights"]
    assert all(r.ids == reference.encode_ordinary(texts[r.doc_id]) for r in last)


def test_last_stage_decodes(spark):
    rows = [(1, "some words, and é"), (2, None), (2, "x"), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = dict(corpus_pipeline.STAGES)["byte-level BPE encoding and decoding"](spark, docs, SMALL).collect()
    digests = sorted((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert sorted((r.doc_id, r.decoded_sha256) for r in found) == digests
    assert all(r.n_tokens == len(r.ids) for r in found)


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows and extra columns; and no rows."""
    long = "many " + " ".join(f"w{i * i % 997}x{i}" for i in range(40_000)) + " "
    rows = [(1, "one two three four", "en", "a", 18)] * 2 + [(2, None, "en", "b", None), (None, None, None, None, None)]
    rows += [(3, "", None, None, 0), (4, " \t\n", "en", "c", 3), (5, long, "en", "a", 1), (6, long + "end", "en", "b", 1)]
    rows += [(1, "another text of that id", "en", "a", 2), (7, "You idiot, you worthless scum! " * 20, "en", "a", 9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    stages = dict(corpus_pipeline.STAGES)
    from tallylog.session import fresh_name, shared_folder

    def stage(name, frame):
        path = f"{shared_folder(spark)}/{fresh_name('odd')}"
        frame.write.parquet(path)
        return stages[name](spark, spark.read.parquet(path), SMALL)

    docs = spark.createDataFrame(rows, schema)
    kept = stage("toxicity", docs)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.collect()]
    assert all(texts.count(t) in (0, [r[1] for r in rows].count(t)) for t in {r[1] for r in rows})
    exact = sorted(((r.doc_id, r.text) for r in stage("exact dedup", docs).collect()), key=str)
    assert len(exact) == 7 and [r for r in exact if r[0] == 1] == [(1, "another text of that id"), (1, "one two three four")]
    assert {i for i, t in exact if not (t or "").strip()} == {2, 4}
    near = stage("SimHash near-dedup", docs).collect()
    assert [r.doc_id for r in near if not (r.text or "").strip()] == [2]
    assert len([r for r in near if (r.text or "").startswith("many")]) == 1
    mixed = stage("mixing sources to target weights", docs)
    assert mixed.columns == docs.columns and {r.text for r in mixed.collect()} <= {r[1] for r in rows}
    tokens = stage("byte-level BPE encoding and decoding", docs).collect()
    assert len(tokens) == len(rows) and all(r.n_tokens == 0 for r in tokens if r.doc_id in (2, 3, None))
    for name in stages:
        assert stage(name, docs.limit(0)).count() == 0
        clashing = docs.withColumns({c: docs["lang"] for c in ("_row", "kept", "fp", "score", "source_size", "ids")})
        if name != "byte-level BPE encoding and decoding":
            assert stage(name, clashing).columns == clashing.columns


def test_pipeline_runs(spark):
    found = corpus_pipeline.run(spark, SMALL)
    assert found.count() > 0 and "ids" in found.columns


def test_scores_are_stored_before_whole_documents_are_shuffled(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = corpus_pipeline.toxicity_stage(spark, docs, SMALL)
    assert "MapInArrow" not in kept._jdf.queryExecution().executedPlan().toString()
    assert 0 < kept.count() < docs.count()
