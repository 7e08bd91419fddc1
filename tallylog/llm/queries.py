"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylog.llm import (
    bpe,
    ctph,
    exact_dedup,
    html_cut,
    merkle,
    mixing,
    packing,
    periodic_runs,
    quality_nbsvm,
    simhash,
    toxicity_knn,
    warc,
    window_dedup,
)
from tallylog.llm.common import read, stored
from tallylog.session import configure, fresh_name, remove_folder, shared_folder

Query = Callable[[SparkSession, str], DataFrame]


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_cut.extract(read(spark, sf_dir, "pages"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_nbsvm.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = window_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    decoded = bpe.decode(encoded, ranks, keep=("doc_id", "n_tokens", "ids_sha256"))
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "copies", "taken")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.compare_with_next(read(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return marked.select("doc_id", "fingerprint", "component_id")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over new archives, which are deleted once the result is stored."""
    folder = f"{shared_folder(spark)}/{fresh_name('warc')}"
    warc.write_archives(warc.records_of(read(spark, sf_dir, "pages")), folder)
    records = stored(warc.read_archives(spark, folder, payloads=False).drop("url", "payload"))
    remove_folder(spark, folder)
    return warc.with_originals(records).select(
        "page_id", F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to"
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity_knn.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", "evidence_ids")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over a new index, which is dropped once the result is stored."""
    index = exact_dedup.DigestIndex(spark, fresh_name("digest_index")).create()
    try:
        found = exact_dedup.deduplicate(read(spark, sf_dir, "documents"), index, "documents")
        return stored(found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256"))
    finally:
        index.drop()


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(read(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.detect(read(spark, sf_dir, "documents"), plant=True)
    return found.withColumn("collapsed_sha256", F.sha2("collapsed", 256)).drop("collapsed", "runs")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Query] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_quality": op2_quality,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_mixing": op5_mixing,
    "op6_fingerprints": op6_fingerprints,
    "op7_simhash": op7_simhash,
    "op8_warc": op8_warc,
    "op9_toxicity": op9_toxicity,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_merkle": op11_merkle,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_packing": op13_packing,
}

SQL: dict[str, str] = {
    "op5_mixing": mixing.SQL,
    "op8_warc": warc.SQL,
    "op10_exact_dedup": exact_dedup.SQL.format(docs="documents"),
    "op11_merkle": merkle.SQL,
}


def llm_queries() -> dict[str, Query]:
    def configured(run: Query) -> Query:
        return lambda spark, sf_dir: run(configure(spark), sf_dir)

    return {name: configured(run) for name, run in QUERIES.items()}


def llm_oracles() -> dict[str, str]:
    return dict(SQL)
