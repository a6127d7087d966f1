"""Queries of the operators over whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orogen.llm import chat, forest, html, lm, media, mixing, neardup, packing, tokens, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(id, by: int):
    return F.crc32(id.cast("string").cast("binary")) % by


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.main_text(_table(spark, sf_dir, "pages"))


def op2_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest other rows of every 50th vector."""
    return forest.neighbours(_table(spark, sf_dir, "embeddings"), lambda id: id % 50 == 0)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a machine that has not seen the held-out fifth."""
    docs = _table(spark, sf_dir, "documents")
    held_out = lambda id: _remainder(id, 5) == 0
    machine = toxicity.learn(docs, _table(spark, sf_dir, "labels"), held_out=held_out)
    scored = toxicity.score(docs.select("doc_id", "text"), machine)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents."""
    return tokens.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    odd = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(odd)
    return chat.read_back(chat.format_conversations(turns))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document the mix takes."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model that has not seen the held-out seventh."""
    return lm.score(_table(spark, sf_dir, "documents"), lambda id: _remainder(id, 7) != 2)


def op9_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as telephony audio, resampled, and what is read back of both columns."""
    return media.described(media.store(_table(spark, sf_dir, "documents")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all pieces of documents."""
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    ops = (op1_main_text, op2_hash_forest, op3_toxicity, op4_token_counts, op5_minhash_neardup, op6_chat_format, op7_mix_sources, op8_lm_score, op9_telephony, op10_packing, pipeline)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op7_mix_sources": mixing.SQL}
