"""A training corpus from the documents table: five stages, each written as Parquet and read again by the next.

Stages take (spark, docs, sf_dir) and return the columns of `documents`; the last returns packed pieces. Toxic documents
go, of equal texts and of near copies one row stays, sources are repeated towards the mix, and all is cut into windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgertide.llm import exact_dedup, jaccard_join, mixing, packing, toxicity
from ledgertide.llm.work import prepare, settle

#: No source is repeated more often than another by more than this.
REPEAT = 1.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return jaccard_join.drop_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least; sources that are short for their weight are read again."""
    prepare(spark)
    return mixing.realise(docs, mixing.Target(repeat=REPEAT))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: The trained classifier of the first stage cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    name, stage = STAGES[-1]
    return settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
