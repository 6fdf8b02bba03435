"""From raw documents to token ids: five stages, each over all that the one before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents. What a stage decides takes effect: rejected rows are gone from the next one's input.

Null texts are empty in every stage: never toxic by their words, near copies of each other (one stays), free of leaks, without words to mix. Null doc_ids are rows
like any other. Repeated rows are near copies. Empty tables give no rows. Other columns, with names that operators use themselves, are carried through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmark.llm import decontaminate, frames, idstore, mixing, nearcopies, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine calls toxic go. It learns from the labelled rows among docs that are not held out."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, frames.table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: sets of 5-word shingles with a Jaccard similarity of 0.8 or more."""
    return nearcopies.deduplicate(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window that matches a benchmark item go."""
    return decontaminate.clean(docs, frames.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each use of a document in the mix, in training order."""
    return mixing.mixed_documents(docs)


def store_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in a content-addressed store; its digest, read back."""
    return idstore.ids_digest(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("token_ids", store_token_ids),
]

#: XXH64 fingerprints, a trained model and a tokenizer have no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = frames.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = frames.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}", "snappy")
    return docs
