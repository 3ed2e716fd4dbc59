"""A training corpus from raw documents: quality classifier, exact dedup, near-duplicate join, mixing
to target weights, packing. Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all
but the last return the columns of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import exact_dedup, mixing, near_dedup, packing, quality
from cadenza.llm.common import free_name, stage

#: SQL can't express the classifier or the tokenizer.
ORACLE_SQL = None


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs.where(~quality.held_out()).select("doc_id", "text"), labels)
    name = free_name(docs, "score")
    return quality.score(docs, model, name=name).where(F.col(name) >= 0.7).drop(name)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", reject_low_quality), ("exact dedup", drop_exact), ("n-gram Jaccard join", drop_near), ("mixing", mix_sources), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage_function in STAGES[:-1]:
        docs = stage(stage_function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
