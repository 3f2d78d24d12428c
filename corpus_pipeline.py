"""The corpus pipeline: from raw documents to the sharded training mix.

Each stage works on all rows that the one before it kept, and every stage but the last returns the columns of
``documents``. ``run`` writes each stage's rows to the shared folder before the next reads them, as the stages are
written and reread when they are run one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm import langid
from turnwise.llm.common import configure, materialize
from turnwise.llm.decontaminate import clean
from turnwise.llm.mixing import emit, mixed
from turnwise.llm.sharding import placed
from turnwise.llm.simhash import keep_one

#: A document whose language is known with less than this calibrated probability is rejected.
LANGUAGE_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learnt; those without a letter, or of no likely language, go."""
    configure(spark)
    found = langid.identified(docs, langid.train(docs))
    sure = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LANGUAGE_SCORE)
    return found.filter(sure).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first by doc_id and text, of each group linked by near-equal fingerprints."""
    configure(spark)
    return keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    configure(spark)
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    configure(spark)
    return emit(docs, mixed(docs))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the slot and the shard they belong to."""
    configure(spark)
    return placed(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("mix", mix), ("shard", shard)]

#: The language model and the fingerprints have no SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other over the documents table."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
