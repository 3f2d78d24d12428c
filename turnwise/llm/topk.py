"""Exact top-k search by tiled matrix products.

Queries come in blocks of bounded size that every task holds; each task walks over the tiles of its shard of the
candidates, multiplies, keeps the best k of a tile and merges them with what it has, so it hands on k rows per query.
Lists are merged in two levels: by groups of tasks, then all groups of a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnwise.llm.common import materialize, work_dir

SCALE, K, EVERY = 1024, 10, 100
#: Queries held by a task, and the sides of a tile: a tile of scores takes 8 MB.
BLOCK_QUERIES, TILE_QUERIES, TILE_ROWS = 8192, 512, 2048
#: Groups of tasks whose lists are merged first.
FAN = 32
LONGEST = (1 << 63) - 1


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows that take part: an id, and a vector whose components are all finite numbers."""
    vector = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embeddings.filter(fine).select(F.col("vec_id").cast("long"), vector.alias("vector"))


def _matrix(vectors: pa.Array, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Vectors of one length each time: (length, ids in ascending order, components as whole numbers in doubles)."""
    lengths = np.asarray(vectors.value_lengths())
    flat = np.floor(np.asarray(vectors.flatten(), dtype=np.float64) * SCALE)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        rows = rows[np.argsort(ids[rows], kind="stable")]
        yield int(length), ids[rows], flat[starts[rows][:, None] + np.arange(length)]


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products as 64-bit integers; a score beyond 64 bits is held at the end of the range."""
    bound = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * max(queries.shape[1], 1)
    if bound < 2.0**53:
        return (queries @ rows.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in line] for line in m], object).reshape(m.shape)
    return np.clip(whole(queries) @ whole(rows).T, -LONGEST - 1, LONGEST).astype(np.int64)


class Best:
    """The k best (score, id) of each query so far; ties go to the smaller id. Unused places have an id of LONGEST."""

    def __init__(self, queries: int, k: int) -> None:
        self.scores = np.full((queries, k), -LONGEST - 1, np.int64)
        self.ids = np.full((queries, k), LONGEST, np.int64)

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray, fits: np.ndarray) -> None:
        """Scores of queries from ``first`` on (down) with rows of ascending ids (across), where they fit."""
        at = slice(first, first + len(scores))
        k = self.scores.shape[1]
        # Queries whose worst place nothing here can take are left alone.
        open_place = (self.ids[at, -1] == LONGEST)[:, None]
        better = fits & (open_place | (scores > self.scores[at, -1, None]) | (scores == self.scores[at, -1, None]) & (ids[None] < self.ids[at, -1, None]))
        live = np.flatnonzero(better.any(1))
        if not len(live):
            return
        better, left = better[live], scores[live]
        if better.sum() > 4 * k * len(live) and left.shape[1] > k:
            # Most of a first tile is better than nothing: only what reaches each query's k-th best goes on.
            bar = np.partition(np.where(better, left, -LONGEST - 1), left.shape[1] - k, axis=1)[:, left.shape[1] - k]
            better &= left >= bar[:, None]
        who, column = np.nonzero(better)
        kept = self.ids[first + live] != LONGEST
        old, place = np.nonzero(kept)
        who = np.concatenate([old, who])
        all_scores = np.concatenate([self.scores[first + live[old], place], left[better]])
        all_ids = np.concatenate([self.ids[first + live[old], place], ids[column]])
        # Per query the highest scores first, without negating the least number, then the smallest ids.
        order = np.lexsort((all_ids, ~all_scores, who))
        who, all_scores, all_ids = who[order], all_scores[order], all_ids[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        top = rank < k
        self.scores[first + live[who[top]], rank[top]], self.ids[first + live[who[top]], rank[top]] = all_scores[top], all_ids[top]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined to at least TILE_ROWS rows each."""
    waiting, rows = [], 0
    for batch in batches:
        waiting.append(batch)
        rows += batch.num_rows
        if rows >= TILE_ROWS:
            yield pa.concat_batches(waiting)
            waiting, rows = [], 0
    if rows:
        yield pa.concat_batches(waiting)


def _search(blocks: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """Tiles of candidates against all queries of a block; ``blocks`` has the queries by vector length."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = {length: Best(len(ids), k) for length, (ids, _) in blocks.items()}
        for batch in _tiles(batches):
            for length, ids, rows in _matrix(batch.column(1), np.asarray(batch.column(0))):
                if length not in blocks:
                    continue
                query_ids, queries = blocks[length]
                for top in range(0, len(ids), TILE_ROWS):
                    tile_ids, tile = ids[top : top + TILE_ROWS], rows[top : top + TILE_ROWS]
                    for left in range(0, len(query_ids), TILE_QUERIES):
                        scores = _products(queries[left : left + TILE_QUERIES], tile)
                        kept[length].add(left, scores, tile_ids, tile_ids[None] != query_ids[left : left + TILE_QUERIES, None])
        for length, (query_ids, _) in blocks.items():
            for left in range(0, len(query_ids), 4096):
                scores, ids = kept[length].scores[left : left + 4096], kept[length].ids[left : left + 4096]
                who, rank = np.nonzero(ids != LONGEST)
                if len(who):
                    yield pa.RecordBatch.from_arrays([pa.array(query_ids[left + who]), pa.array(ids[who, rank]), pa.array(scores[who, rank])], names=["query_id", "vec_id", "score"])

    return search


def top_k(embeddings: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the k best candidates of each query, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by ``every``; candidates all rows of another id. Components x count as
    floor(1024 * x). Rows without an id or with a null vector or component, or one that is not finite, take no part; an
    empty vector scores 0 against empty vectors; vectors of different lengths are not compared. A repeated row is a
    candidate as often as it occurs; a repeated query is asked once
    (with the smallest of its vectors). A query without candidates gives no row. Columns
    other than vec_id and embedding are not read.
    """
    spark = embeddings.sparkSession
    vectors = whole_vectors(embeddings)
    queries = materialize(vectors.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector")), "queries")
    blocks = -(-queries.count() // BLOCK_QUERIES) or 1
    path = work_dir(spark, "tops")
    for block in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toArrow()
        held = _matrix(part.column(1).combine_chunks(), np.asarray(part.column(0)))
        chosen = {length: (ids, rows) for length, ids, rows in held}
        found = vectors.mapInArrow(_search(chosen, k), "query_id bigint, vec_id bigint, score bigint")
        found.withColumn("part", F.spark_partition_id()).write.mode("append").parquet(path)
    tops = spark.read.schema("query_id bigint, vec_id bigint, score bigint, part int").parquet(path)
    order = [F.desc("score"), F.asc("vec_id")]
    group = F.pmod(F.col("part"), F.lit(FAN))
    merged = tops.withColumn("r", F.row_number().over(Window.partitionBy("query_id", group).orderBy(*order))).filter(F.col("r") <= k)
    ranked = merged.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
