"""Corpus pipeline: toxicity, exact and near duplicates, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.common import read, stored
from flowlens.llm.exact_dedup import keep_one_copy
from flowlens.llm.packing import best_fit_packing
from flowlens.llm.pii import pii
from flowlens.llm.queries import pseudonym_key
from flowlens.llm.simhash import keep_one_per_group
from flowlens.llm.toxicity import keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 stay."""
    return keep_clean(docs, read(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the one with the largest id stays."""
    return keep_one_copy(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at 3 or fewer differing bits the document with the smallest id stays."""
    return keep_one_per_group(docs, shingle=3, max_bits=3)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced in the text; ``n_chars`` follows it."""
    out = pii(docs, key=pseudonym_key(spark)).drop("pii")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return best_fit_packing(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("simhash_near_dedup", simhash_near_dedup),
          ("pii", pseudonyms), ("best_fit_packing", packing)]

# Model scores, pseudonyms and token ids are beyond SQL; tests/llm holds the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again as the next one's input."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
