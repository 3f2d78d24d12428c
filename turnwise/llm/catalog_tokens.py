"""Queries of the tokenizer operators."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from turnwise.llm.common import source_table, work_dir
from turnwise.llm.registry import query
from turnwise.llm.token_counts import token_counts
from turnwise.llm.token_files import token_layout, write_token_files


def tokenizer_file() -> str:
    return str(Path(public_tokenizers.path("word_bpe_49k.json")))


@query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = source_table(spark, sf_dir, "documents")
    return token_counts(documents, tokenizer_file(), work_dir(spark, "token-cache"))


@query("op5_token_files")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = source_table(spark, sf_dir, "documents")
    return token_layout(write_token_files(documents, tokenizer_file(), work_dir(spark, "token-ids")))
