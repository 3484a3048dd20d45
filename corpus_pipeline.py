"""The corpus pipeline: toxicity, quality rules, near-duplicates, mixing and packing, over whole documents.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns
of documents. Null ids and texts, repeated rows, empty tables and further columns have the results that the operators'
docstrings state.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stratocast.llm import mixing, packing, rules, simhash, toxicity
from stratocast.llm.common import materialize
from stratocast.session import ship_package

#: SQL has neither trained classifiers nor XXH64 nor tokenizers: the stages are tested against brute-force versions.
ORACLE_SQL = None


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores toxic go."""
    ship_package(spark)
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, _labels(spark, sf_dir)), threshold=0.5)


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the trees go."""
    ship_package(spark)
    return rules.keep_good(docs, rules.fit_rules(docs, _labels(spark, sf_dir)), threshold=0.5)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    ship_package(spark)
    return simhash.keep_one_of_each(docs, most=3)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand as often as the mix takes them."""
    ship_package(spark)
    return mixing.mixed_documents(docs, weights=(3, 1, 2), share=1.5, most=2)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix packed into sequences of at most 2048 ids: a row for each piece."""
    ship_package(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), window=2048, end_id=1)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality rules", rules_stage),
    ("near-duplicates", near_duplicates_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
