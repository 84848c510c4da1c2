"""The corpus pipeline: stages over the documents table, each written and read again.

Each stage takes (spark, docs, sf_dir) and returns what it keeps. All but the last return
the columns of documents; the last adds the fitted rates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quantmill.llm.bagminhash import keep_one
from quantmill.llm.decontaminate import clean
from quantmill.llm.language_id import keep_identified
from quantmill.llm.mixing import mix
from quantmill.llm.pii import redact
from quantmill.llm.shared import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified stay."""
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; all documents stay."""
    return redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its rate; those with rate 0 take no part in the mixture and go."""
    return mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("rate > 0")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixture", mixture),
]

#: Learned models and signatures are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents; between stages the rows are written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
