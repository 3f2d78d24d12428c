"""A written index of letter triples, so that a search reads only turns that may match.

Whatever contains a term contains its triples. The index lists, for every triple of the lowered texts and path texts, the
turns that have it, some hundred texts to a row, filed by a hash of the triple; a search looks up the rarest triples of its
terms, keeps the turns that have all of them on one side, and applies the literal test of ``search`` to these. Terms of
fewer than three letters have no triple; if no term has one, all turns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.operators import search

#: Letters of the texts of which the turns of a triple are listed together.
SLICE_LETTERS = 1 << 21
#: Folders the triples are filed in, and how many triples of a term are looked up.
BUCKETS, LOOKED_UP = 64, 3
SIDES = ("canonical_text", "path_text")


_POSTING = "triple string, side int, turns array<string>"


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (turn_id and the sides) to a row per side and triple with the turns of a slice of texts that have it."""
    for batch in batches:
        ids = batch.column(0)
        for side in range(len(SIDES)):
            texts = batch.column(1 + side).to_pylist()
            sizes = np.array([len(t) for t in texts], np.int64)
            ends = np.cumsum(sizes)
            first = 0
            while first < len(texts):
                last = max(first + 1, int(np.searchsorted(ends, ends[first] - sizes[first] + SLICE_LETTERS, "right")))
                yield _slice(ids.slice(first, last - first), texts[first:last], sizes[first:last], side)
                first = last


def _slice(ids: pa.Array, texts: list[str], sizes: np.ndarray, side: int) -> pa.RecordBatch:
    letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    inside = owner[2:] == owner[:-2]
    # A code point has 21 bits, so a run of three letters is one number.
    runs, owner = (letters[:-2] << 42 | letters[1:-1] << 21 | letters[2:])[inside], owner[:-2][inside]
    order = np.argsort(runs, kind="stable")
    runs, owner = runs[order], owner[order]
    new = np.ones(len(runs), bool)
    new[1:] = runs[1:] != runs[:-1]
    # Owners ascend within a run, so repeats lie side by side.
    kept = new.copy()
    kept[1:] |= owner[1:] != owner[:-1]
    runs, owner, new = runs[kept], owner[kept], new[kept]
    starts = np.flatnonzero(new)
    low = (1 << 21) - 1
    named = [chr(r >> 42) + chr(r >> 21 & low) + chr(r & low) for r in runs[starts].tolist()]
    turns = pa.ListArray.from_arrays(pa.array(np.append(starts, len(runs)), pa.int32()), ids.take(pa.array(owner)))
    return pa.RecordBatch.from_arrays([pa.array(named, pa.string()), pa.array([side] * len(named), pa.int32()), turns], names=["triple", "side", "turns"])


def _bucket(triple: Column) -> Column:
    return F.pmod(F.xxhash64(triple), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class Index:
    """Where an index was written."""

    path: str

    def lists(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"{_POSTING}, n long, bucket int").parquet(f"{self.path}/postings")

    def postings(self, spark: SparkSession) -> DataFrame:
        return self.lists(spark).select("triple", F.explode("turns").alias("turn_id"), "side", "bucket")

    def counts(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("triple string, turns long, bucket int").parquet(f"{self.path}/counts")


def write_index(candidates: DataFrame, path: str) -> Index:
    """Index the texts and path texts of search candidates; every file holds triples of one folder, in order."""
    spark = candidates.sparkSession
    texts = [F.lower(F.coalesce(side, F.lit(""))).alias(side) for side in SIDES]
    each = candidates.select(F.col("turn_id").cast("string"), *texts).mapInArrow(_posted, _POSTING)
    # A triple that all turns have is spread by the slices of texts too, so no task gets all of a common one.
    placed = each.select("*", F.size("turns").cast("long").alias("n"), _bucket(F.col("triple")).alias("bucket")).repartition("bucket", F.pmod(F.xxhash64(F.get("turns", F.lit(0))), F.lit(8)))
    placed.sortWithinPartitions("bucket", "triple").write.partitionBy("bucket").parquet(f"{path}/postings")
    index = Index(path)
    counted = index.lists(spark).groupBy("bucket", "triple").agg(F.sum("n").alias("turns"))
    counted.repartition("bucket").sortWithinPartitions("bucket", "triple").write.partitionBy("bucket").parquet(f"{path}/counts")
    return index


def _of_term(term: str) -> list[str]:
    return list(dict.fromkeys(term[i : i + 3] for i in range(len(term) - 2)))


def possible_turns(spark: SparkSession, index: Index, terms: list[str]) -> DataFrame | None:
    """(turn_id) of the turns that may contain all terms on one side; None if the terms are too short to tell."""
    wanted = {t: _of_term(t) for t in terms if len(t) >= 3}
    if not wanted:
        return None
    asked = sorted({x for own in wanted.values() for x in own})
    buckets = spark.createDataFrame([(x,) for x in asked], "triple string").select("triple", _bucket(F.col("triple")).alias("bucket")).collect()
    of_bucket = lambda df: df.filter(F.col("bucket").isin(*{r.bucket for r in buckets}) & F.col("triple").isin(*asked))
    # As many rows as the request has triples.
    seen = {r.triple: r.turns for r in of_bucket(index.counts(spark)).select("triple", "turns").collect()}
    chosen = sorted({x for own in wanted.values() for x in sorted(own, key=lambda x: (seen.get(x, 0), x))[:LOOKED_UP]})
    if any(x not in seen for x in chosen):
        return spark.createDataFrame([], "turn_id string")
    kept = {r.bucket for r in buckets if r.triple in chosen}
    found = index.postings(spark).filter(F.col("bucket").isin(*kept) & F.col("triple").isin(*chosen))
    return found.groupBy("turn_id", "side").agg(F.count_distinct("triple").alias("n")).filter(F.col("n") == len(chosen)).select("turn_id").distinct()


def narrowed(candidates: DataFrame, index: Index, query: str) -> DataFrame:
    """The candidates that a query has to read; any search over them gives the same rows as over all."""
    possible = possible_turns(candidates.sparkSession, index, search.search_terms(query))
    return candidates if possible is None else candidates.join(possible, "turn_id", "left_semi")
