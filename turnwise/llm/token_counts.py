"""Token counts through a cache keyed by digests of the content and of the tokenizer file.

Texts are brought to a normal form that the tokenizer cannot tell from the text, digested with SHA-256 and joined to
the counts the cache holds for this tokenizer. What is missing is reduced to one text per digest (copies meet on the
map side first, so a text that a third of all rows share is moved once per task), encoded, and appended to the cache.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm.common import join_split, materialize
from turnwise.llm.encoding import encoder, tokenizer_digest

CACHE_SCHEMA = "tokenizer string, content binary, n_tokens bigint"
#: Up to this many missing digests (of 32 bytes) are broadcast to leave known texts where they are.
BROADCAST_DIGESTS = 200_000


def normal_text(text: Column, path: str) -> Column:
    """The text, or with runs of blanks as one where the tokenizer does the same before anything else; null is empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    if encoder(path).by_piece:
        return F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))
    return text


def read_cache(spark: SparkSession, cache_path: str, tokenizer: str) -> DataFrame:
    """(content, n_tokens) of one tokenizer, one row per content; empty if nothing was stored yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], CACHE_SCHEMA).select("content", "n_tokens")
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    return stored.filter(F.col("tokenizer") == tokenizer).groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))


def _counted(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = encoder(path).encoded(batch.column(1))[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["content", "n_tokens"])

    return count


def token_counts(documents: DataFrame, path: str, cache_path: str, limit: int = 2048) -> DataFrame:
    """Per row of ``documents``: doc_id, n_bytes, n_tokens, over_limit; counts of new contents are added to the cache.

    ``path`` is a tokenizer file that every worker can read (a file of an installed package); ``cache_path`` a shared
    folder. Null texts count as empty: 0 bytes, 0 tokens. Repeated rows come out as often as they come in, and null
    doc_ids stay. Other columns are not read. An empty table encodes nothing.
    """
    spark = documents.sparkSession
    tokenizer = tokenizer_digest(path)
    text = documents["text"].cast("string")
    content = documents.select(documents["doc_id"].cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), normal_text(text, path).alias("normal"))
    content = content.withColumn("content", F.unhex(F.sha2("normal", 256)))
    narrow = materialize(content.select("doc_id", "n_bytes", "content"), "digests")

    contents = materialize(narrow.groupBy("content").agg(F.count("*").alias("rows")), "contents")
    missing = materialize(contents.select("content").join(read_cache(spark, cache_path, tokenizer), "content", "left_anti"), "missing")
    count = missing.count()
    if count:
        if count <= BROADCAST_DIGESTS:
            # Whether or not known texts are left out here, one text for each missing digest is encoded.
            content = content.join(F.broadcast(missing), "content", "left_semi")
        distinct = content.groupBy("content").agg(F.first("normal").alias("normal"))
        if count > BROADCAST_DIGESTS:
            distinct = distinct.join(missing, "content", "left_semi")
        fresh = distinct.select("content", "normal").mapInArrow(_counted(path), "content binary, n_tokens bigint")
        fresh.select(F.lit(tokenizer).alias("tokenizer"), "content", "n_tokens").write.mode("append").parquet(cache_path)
    # Both sides have a row per content here; the rows of the documents then join without a hot key.
    counts = materialize(read_cache(spark, cache_path, tokenizer).join(contents, "content"), "counts")
    told = join_split(narrow, counts, "content", "rows", narrow.count())
    return told.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
