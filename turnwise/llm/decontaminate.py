"""Benchmark decontamination by winnowing.

Both sides are cut into words and hashed in 5-word grams; of each 6 consecutive grams the smallest hash is kept (all of
them, on ties). Any shared span of 10 words therefore shares a kept gram. Documents look their kept grams up among the
kept grams of the benchmark, and each hit is extended to the 10-word windows around it, which are then joined with the
benchmark's windows by their text. Items shorter than a window have one window of their own length and are looked up
by the hash of the whole item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnwise.llm.common import BASE, materialize, mix, power_tables, same_row, text_digest, text_slices, work_dir

GRAM, WINDOW = 5, 10
#: Fingerprints of the benchmark held by a Python worker at once (8 bytes each and a bitmap); more make further passes.
BLOCK_FINGERPRINTS = 2_000_000

WORDS_SQL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_fold = np.arange(256, dtype=np.uint8)
_fold[ord("A") : ord("Z") + 1] += 32
_is_word = np.zeros(256, bool)
_is_word[ord("0") : ord("9") + 1] = _is_word[ord("a") : ord("z") + 1] = _is_word[128:] = True

class Words:
    """The words of a run of texts: byte bounds, the text each is in, and a hash of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data = _fold[data]
        inside = _is_word[self.data]
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = offsets[1:-1]
        before[edges[edges < len(data)]] = False
        after[edges[edges > 0] - 1] = False
        self.starts, self.ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        self.text = np.searchsorted(offsets, self.starts, "right") - 1
        #: Index of each text's first word, and behind the last.
        self.first = np.searchsorted(self.text, np.arange(len(offsets)))
        power, inverse = power_tables(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts])

    def grams(self, n: int) -> np.ndarray:
        """Hash of each run of ``n`` words, also of runs over the end of a text."""
        count = max(len(self.hashes) - n + 1, 0)
        total = np.full(count, n, np.uint64)
        for k in range(n):
            total = total * np.uint64(BASE) + self.hashes[k : k + count]
        return mix(total)

    def within(self, n: int) -> np.ndarray:
        """Whether each run of ``n`` words stays in one text."""
        count = max(len(self.text) - n + 1, 0)
        return self.text[:count] == self.text[n - 1 : n - 1 + count]

    def phrase(self, start: int, n: int) -> str:
        return b" ".join(self.data[self.starts[i] : self.ends[i]].tobytes() for i in range(start, start + n)).decode()


def winnow(grams: np.ndarray, within: np.ndarray, span: int) -> np.ndarray:
    """Positions of grams that are smallest in some window of ``span`` grams that ``within`` admits."""
    if len(grams) < span or not len(within):
        return np.zeros(0, np.int64)
    count = len(grams) - span + 1
    low = grams[:count].copy()
    for k in range(1, span):
        np.minimum(low, grams[k : k + count], out=low)
    low[~within[:count]] = 0
    high = np.zeros(len(grams), np.uint64)
    for k in range(span):
        np.maximum(high[k : k + count], low, out=high[k : k + count])
    return np.flatnonzero((high == grams) & (high > 0))


def _signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """Per window of an item: item_id, n (its words), window (its text), and kept, the fingerprints chosen in the item.

    ``kept`` stands on the first window of an item only.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, last, data, offsets in text_slices(batch.column(1)):
                words = Words(data, offsets)
                grams, within = words.grams(GRAM), words.within(WINDOW)
                kept = winnow(grams, within, WINDOW - GRAM + 1)
                kept_text = words.text[kept]
                out: dict[str, list] = {"item": [], "n": [], "window": [], "kept": []}
                for k in range(last - first):
                    lo, hi = int(words.first[k]), int(words.first[k + 1])
                    n = min(WINDOW, hi - lo)
                    if not n:
                        continue
                    own = _signed(grams[kept[kept_text == k]]) if n == WINDOW else _signed(words.grams(n)[lo : lo + 1])
                    for start in range(lo, hi - n + 1):
                        out["item"].append(ids[first + k].as_py())
                        out["n"].append(n)
                        out["window"].append(words.phrase(start, n))
                        out["kept"].append(own if start == lo else [])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["item"], pa.string()), pa.array(out["n"], pa.int32()), pa.array(out["window"], pa.string()), pa.array(out["kept"], pa.list_(pa.int64()))],
                    names=["item_id", "n", "window", "kept"],
                )

    items = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    return items.mapInArrow(cut, "item_id string, n int, window string, kept array<bigint>")


class _Lookup:
    """Membership of hashes in a block of fingerprints: a bitmap first, then a search in the sorted hashes."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.unique(hashes)
        bits = max(16, int(16 * len(self.hashes)).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[self.hashes & self.mask] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.seen[hashes & self.mask])
        at = np.searchsorted(self.hashes, hashes[maybe])
        at[at == len(self.hashes)] = 0
        return maybe[self.hashes[at] == hashes[maybe]] if len(self.hashes) else maybe[:0]


def _scan(lengths_and_hashes: dict[int, np.ndarray], everything: bool):
    """Documents to their word count and the windows around fingerprint hits."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("window", pa.string())])))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookups = {n: _Lookup(hashes) for n, hashes in lengths_and_hashes.items()}
        for batch in batches:
            ids, digests = batch.column(0), batch.column(2)
            for first, last, data, offsets in text_slices(batch.column(1)):
                words = Words(data, offsets)
                found: list[tuple[np.ndarray, int]] = []
                for n, lookup in lookups.items():
                    if n == WINDOW:
                        grams, within = words.grams(GRAM), words.within(WINDOW)
                        kept = winnow(grams, within, WINDOW - GRAM + 1)
                        hit = kept[lookup(grams[kept])]
                        starts = np.unique((hit[:, None] - np.arange(WINDOW - GRAM + 1)).ravel())
                        starts = starts[(starts >= 0) & (starts < len(within))]
                    else:
                        within = words.within(n)
                        starts = lookup(words.grams(n))
                    found.append((starts[within[starts]], n))
                hits: list[list] = [[] for _ in range(last - first)]
                for starts, n in found:
                    for start in starts.tolist():
                        k = int(words.text[start])
                        hits[k].append({"start": start - int(words.first[k]), "n": n, "window": words.phrase(start, n)})
                counts = np.diff(words.first)
                rows = range(last - first) if everything else [k for k, own in enumerate(hits) if own]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[first + k].as_py() for k in rows], pa.int64()),
                        pa.array([digests[first + k].as_py() for k in rows], pa.binary()),
                        pa.array([int(counts[k]) for k in rows], pa.int64()),
                        pa.array([hits[k] for k in rows], schema.field("hits").type),
                    ],
                    schema=schema,
                )

    return scan


def _found(documents: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, n_words) per row of ``documents``; (hit_id, hit_digest, n_hit, n_items, items) per id and text with a hit."""
    spark = documents.sparkSession
    windows = materialize(benchmark_windows(benchmark), "benchmark-windows")
    kept = windows.select("n", F.explode("kept").alias("h")).distinct()
    blocks = -(-kept.count() // BLOCK_FINGERPRINTS) or 1
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_digest(F.col("text")).alias("digest"))
    schema = "doc_id bigint, digest binary, n_words bigint, hits array<struct<start:int,n:int,window:string>>"
    path = work_dir(spark, "scanned")
    for block in range(blocks):
        # At most about BLOCK_FINGERPRINTS rows reach the driver at once; hashes are dealt evenly over the blocks.
        part = kept.filter(F.pmod(F.xxhash64("h"), F.lit(blocks)) == block).toArrow() if blocks > 1 else kept.toArrow()
        lengths, hashes = np.asarray(part["n"]), np.asarray(part["h"]).astype(np.int64).view(np.uint64)
        chosen = {int(n): hashes[lengths == n] for n in np.unique(lengths)}
        texts.mapInArrow(_scan(chosen, block == 0), schema).withColumn("first", F.lit(block == 0)).write.mode("append").parquet(path)
    scanned = spark.read.schema(f"{schema}, first boolean").parquet(path)

    row = ["doc_id", "digest"]
    hits = scanned.filter(F.size("hits") > 0).select(*row, F.explode("hits").alias("hit")).select(*row, "hit.*")
    named = windows.select("window", "n", "item_id").distinct()
    known = named.select("window", "n").distinct()
    real = materialize(hits.join(known, ["window", "n"], "left_semi").distinct(), "real-hits")

    order = Window.partitionBy(*row).orderBy("start", "n")
    reached = F.max(F.col("start") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    covered = real.select(*row, "start", (F.col("start") + F.col("n")).alias("end"), reached.alias("reached"))
    words = covered.groupBy(*row).agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce("reached", F.lit(0))))).alias("n_hit"))
    items = (
        real.select(*row, "window", "n").distinct().join(named.filter("item_id IS NOT NULL"), ["window", "n"])
        .select(*row, "item_id").distinct()
        .groupBy(*row).agg(F.count("*").alias("n_items"), F.concat_ws(",", F.sort_array(F.collect_list("item_id"))).alias("items"))
    )
    same = words.doc_id.eqNullSafe(items.doc_id) & (words.digest == items.digest)
    found = words.join(items, same, "left").select(words.doc_id.alias("hit_id"), words.digest.alias("hit_digest"), "n_hit", "n_items", "items")
    return scanned.filter("first").select(*row, "n_words"), found


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in an occurrence of a window of some item. One row comes out per row of ``documents``, and
    its hits are those of its own text, also where a doc_id is null or shared. Null and empty texts have no words and no
    hits; items with null or empty text have no window; items without an id mark words but are not named or counted.
    Other columns of either side are not read.
    """
    base, found = _found(documents, benchmark)
    return base.join(found, base.doc_id.eqNullSafe(found.hit_id) & (base.digest == found.hit_digest), "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``documents`` whose text has no hit, with all columns, whatever their names.

    Null and empty texts have none and stay; rows of equal id and text stay or go together; no documents give no row.
    """
    found = _found(documents, benchmark)[1]
    return documents.join(found, same_row(documents, found["hit_id"], found["hit_digest"]), "left_anti")
