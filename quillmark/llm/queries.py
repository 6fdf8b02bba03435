"""The queries of this subpackage, each over its whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import alignment, audit, chat, decontaminate, frames, idstore, mixing, neighbours, quality, secrets, simhash, suffix_dedup, token_counts, toxicity
from .oracles import ORACLES  # noqa: F401


def op1_suffix_dedup(spark, sf_dir):
    return suffix_dedup.dedup_digest(frames.table(spark, sf_dir, "documents"))


def op2_token_counts(spark, sf_dir):
    return token_counts.token_counts(frames.table(spark, sf_dir, "documents"))


def op3_decontaminate(spark, sf_dir):
    return decontaminate.matches(frames.table(spark, sf_dir, "documents"), frames.table(spark, sf_dir, "benchmark"))


def op4_mix_sources(spark, sf_dir):
    return mixing.mix_digest(frames.table(spark, sf_dir, "documents"))


def op5_secret_scan(spark, sf_dir):
    return secrets.secret_spans(frames.table(spark, sf_dir, "documents"))


def op6_chat_format(spark, sf_dir):
    rows = frames.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.chat_digest(rows.unionByName(extra))


def op7_quality_rules(spark, sf_dir):
    return quality.quality_verdicts(frames.table(spark, sf_dir, "documents"))


def op8_simhash_dedup(spark, sf_dir):
    return simhash.near_duplicates(frames.table(spark, sf_dir, "documents"))


def op9_toxicity(spark, sf_dir):
    docs = frames.table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, frames.table(spark, sf_dir, "labels")))


def op10_token_store(spark, sf_dir):
    return idstore.ids_digest(frames.table(spark, sf_dir, "documents"))


def op11_filter_audit(spark, sf_dir):
    return audit.audit(frames.table(spark, sf_dir, "documents"), frames.table(spark, sf_dir, "labels"))


def op12_nearest_neighbours(spark, sf_dir):
    e = frames.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.search(e, e.filter("vec_id % 100 = 0"))


def op13_align_tokenizers(spark, sf_dir):
    return alignment.alignment_digest(frames.table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_token_counts, op3_decontaminate, op4_mix_sources, op5_secret_scan, op6_chat_format, op7_quality_rules, op8_simhash_dedup, op9_toxicity, op10_token_store, op11_filter_audit, op12_nearest_neighbours, op13_align_tokenizers)}
