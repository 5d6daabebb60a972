"""The corpus pipeline: toxicity, near-duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on every document its predecessor kept; all but
the last return the columns of documents.  No stage is expressible in SQL as a whole, so the
pipeline is tested against a brute-force version instead of ORACLE_SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm import minhash, mixing, packing, substring_dedup
from skerry.llm import toxicity as tox
from skerry.llm.scratch import materialize


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below 0.5; labels come from the labels table."""
    model = tox.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return tox.score(docs, model).filter("toxic_score < 0.5").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more)."""
    return minhash.drop_near_duplicates(docs)


def substring_cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-word windows that an earlier document holds; n_chars follows the text."""
    cut = substring_dedup.remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))
    return cut.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: each document as often as its source's rate says."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its length bucket, batch and place."""
    return packing.pack(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("substring_dedup", substring_cut), ("mixing", mix), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
