"""Queries of the operators that train a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm import langid, toxicity
from turnwise.llm.common import held_out, source_table
from turnwise.llm.registry import query


@query("op3_language")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = source_table(spark, sf_dir, "documents")
    found = langid.identified(documents.select("doc_id", "text"), langid.train(documents))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = source_table(spark, sf_dir, "documents")
    scorer = toxicity.train(documents, source_table(spark, sf_dir, "labels"))
    found = toxicity.scored(documents.select("doc_id", "text"), scorer)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
