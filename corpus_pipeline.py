"""A training-data pipeline: language ID, line dedup, near-duplicate groups, source mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm.common import materialize
from roadloom.llm.jaccard import near_groups
from roadloom.llm.language import predict, train
from roadloom.llm.lines import dedup_lines
from roadloom.llm.mixing import with_copies
from roadloom.llm.packing import pack
from roadloom.llm.queries import TOKENIZERS


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that could be learned stay; a text that is null or has no letter goes."""
    return predict(docs, train(docs), keep=True).where("lang_pred <> 'und'").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; so does a document that has no line left."""
    out = dedup_lines(docs)
    left = out.where(~((F.col("n_removed") > 0) & (F.length(F.trim("text")) == 0))).drop("n_lines", "n_removed")
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest doc_id."""
    groups = near_groups(docs, k=5, least=(4, 5)).where("doc_id <> component_id").select(F.col("doc_id").alias("id_")).distinct()
    return docs.join(groups, docs["doc_id"] == groups["id_"], "left_anti")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes of it: none, one or two."""
    mix = with_copies(docs).where("__copies > 0")
    return mix.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    return pack(docs, TOKENIZERS, capacity=1024, end_id=2)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("source mix", source_mix),
    ("best-fit packing", packing),
]

#: Language ID and hash-ordered mixing can't be written in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
