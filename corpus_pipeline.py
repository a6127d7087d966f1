"""A corpus pipeline of four stages, each over all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orogen.llm import mixing, neardup, packing, toxicity
from orogen.llm.cluster import written

#: The rows cannot be stated in SQL: the first stage is a fitted model.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a machine fitted to labels does not take for toxic.

    Null and empty texts, null ids and repeated rows are scored and kept like others; no column changes.  Without
    labels all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = toxicity.learn(docs, labels)
    return toxicity.score(docs, machine, names=("__toxic_score", "__toxic")).filter("__toxic = 0").select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id, one row of it.

    Texts are told apart by their keys, so rows with a null id are kept like others; a group without ids
    keeps a row of one of its texts.  Texts without words (null ones too) are one group.  No column changes.
    """
    rows, texts = neardup.grouped(docs)
    first = texts.groupBy("group").agg(F.min(F.struct(F.col("least").isNull(), "least", "k1", "k2")).alias("first"))
    first = first.select(F.col("first.k1").alias("__k1"), F.col("first.k2").alias("__k2"), F.col("first.least").alias("__least"))
    kept = written(first, "pipeline-kept")
    own = neardup.keyed(docs, names=("__k1", "__k2"))
    out = own.join(kept, ["__k1", "__k2"]).filter(F.col("doc_id").cast("long").eqNullSafe(F.col("__least")))
    if not rows.groupBy("id", "k1", "k2").count().filter("count > 1").isEmpty():
        out = out.dropDuplicates(["__k1", "__k2"])
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null source is one source; documents without words are not taken; no column changes.
    """
    return mixing.emitted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of the documents in sequences of 2048 tokens.

    Null texts are one piece (the end), null ids stay, repeated rows are packed as often as they come.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", reject_toxic), ("near duplicates", keep_one_of_each_group), ("mixing", mix_sources), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
