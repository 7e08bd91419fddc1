"""Cleaning pipeline over ``documents``: stages that each call one operator.

``run`` writes each stage's result as Parquet under the session's shared folder and reads
it again as the next stage's input; a stage's files are deleted when the next are written.

Defined cases: null texts count as empty: they get the toxicity score of texts without known words, are equal
to empty ones for exact dedup and to blank ones for near-dedup, and have no words to mix and no tokens; null ids, sources and languages are kept; repeated
rows are exact copies; very long texts are worked on whole; extra columns, whatever their names, go along up to
the last stage, which returns its own; an empty table passes every stage empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylog.llm import bpe, exact_dedup, mixing, simhash, toxicity_knn
from tallylog.llm.common import ROW, keep_rows, read, stored
from tallylog.session import configure, fresh_name, remove_folder, shared_folder


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't toxic.

    The row numbers are stored before the whole documents are shuffled, so that an executor doesn't hold
    the scoring's Python workers at their largest and a shuffle's buffers at once.
    """
    scored = toxicity_knn.score(docs, read(spark, sf_dir, "labels"))
    return keep_rows(docs, stored(scored.where("predicted = 0").select(ROW)))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    index = exact_dedup.DigestIndex(spark, fresh_name("digest_index")).create()
    try:
        kept = stored(exact_dedup.deduplicate(docs, index, "pipeline").where("kept"))
    finally:
        index.drop()
    return keep_rows(docs, kept)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return keep_rows(docs, simhash.near_duplicates(docs).where("kept"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources; a document may come twice or not at all."""
    return mixing.emit(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, without its text, and the digest of what they decode to."""
    ranks, own = public_tokenizers.path("byte_bpe_50k.tiktoken"), ("doc_id", "lang", "source", "n_chars")
    encoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN, keep=own)
    decoded = bpe.decode(encoded, ranks, keep=(*own, "n_tokens", "ids", "ids_sha256"))
    return decoded.withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", near_stage),
    ("mixing sources to target weights", mixing_stage),
    ("byte-level BPE encoding and decoding", token_stage),
]

#: The stages use trained models and SimHash, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    folder = f"{shared_folder(spark)}/{fresh_name('pipeline')}"
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if number:
            remove_folder(spark, f"{folder}/{number - 1}")
    return docs
