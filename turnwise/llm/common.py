"""What the corpus operators share: settings, column rules, bounded Arrow batches and distributed running sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwise import session as base
from turnwise.session import discard, materialize, work_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of anything but the six ASCII blanks.
BLANK_SEPARATED = r"[^\x20\x09-\x0D]+"
#: Rows and bytes of one Arrow batch, so that a Python worker's memory does not depend on the partition.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20

__all__ = [
    "BASE", "BATCH_BYTES", "BATCH_ROWS", "BLANK_SEPARATED", "LOWER", "UPPER", "configure", "discard", "file_uri", "free_names", "held_out", "join_split", "learnable",
    "materialize", "mix", "power_tables", "prefix_sums", "runs", "same_row", "source_table", "text_digest", "text_slices", "unit_hash", "work_dir",
]


def configure(spark: SparkSession) -> SparkSession:
    """The library's settings, and Arrow batches bounded in rows and bytes."""
    base.configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


#: Odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for positions below ``n``."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        tables = []
        for factor in (BASE, pow(BASE, -1, 1 << 64)):
            table = np.full(size, factor, np.uint64)
            table[0] = 1
            tables.append(np.cumprod(table, dtype=np.uint64))
        _powers = tables[0], tables[1]
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def source_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the fold no model may learn from; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def learnable(doc_id: Column) -> Column:
    return ~held_out(doc_id)


def text_digest(text: Column) -> Column:
    """128 bits of a text; with the doc_id it tells rows apart of which the id is null or shared."""
    return F.unhex(F.md5(text.cast("string")))


def same_row(documents: DataFrame, doc_id: Column, digest: Column) -> Column:
    """Whether a row of ``documents`` has this id and text; null is a value."""
    return documents["doc_id"].cast("long").eqNullSafe(doc_id) & text_digest(documents["text"]).eqNullSafe(digest)


def free_names(taken: list[str], *names: str) -> list[str]:
    """The names, each with underscores behind it until no column is called so, in any case."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def unit_hash(*columns: Column) -> Column:
    """A stable value in [0, 1) for hash-ordered samples."""
    return (F.xxhash64(*columns).bitwiseAND(F.lit((1 << 52) - 1))) / F.lit(float(1 << 52))


#: A key with more than one in HOT_SHARE of all rows is hot; there are fewer than HOT_SHARE such keys.
HOT_SHARE = 1000


def join_split(facts: DataFrame, lookup: DataFrame, key: str, rows: str, total: int, how: str = "inner") -> DataFrame:
    """Join ``facts`` with the one row that ``lookup`` has per key, whatever share of the facts a key holds.

    ``lookup.rows`` tells how many of the ``total`` facts have the key, so less than HOT_SHARE lookup rows are hot: these
    are broadcast and their facts stay where they are. All other facts are shuffled by a key that is never hot. ``how``
    is inner or left; the column ``rows`` is left out. A null key matches nothing.
    """
    heavy = F.col(rows) * HOT_SHARE > total
    hot, rest = lookup.filter(heavy).drop(rows), lookup.filter(~heavy).drop(rows)
    stay = facts.join(F.broadcast(hot), key)
    move = facts.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key, how)
    return stay.unionByName(move)


def file_uri(path: str) -> str:
    """A path as pyarrow's file systems take it: with a scheme, and an empty host where none is named."""
    if "://" in path:
        return path
    scheme, colon, rest = path.partition(":/")
    return f"{scheme}:///{rest.lstrip('/')}" if colon else f"file://{path}"


def text_slices(column: pa.Array, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, last row, UTF-8 bytes, offsets) of runs of texts of about ``limit`` bytes; null reads as empty.

    A single text above the limit makes a run of its own, so memory follows the longest text and not the batch.
    """
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows of a sorted stream by their first ``keys`` columns, which hold no null; one group is held at a time."""
    key, held = None, []
    for batch in batches:
        columns = [np.asarray(batch.column(k)) for k in range(keys)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1 if batch.num_rows else []
        for first, last in zip([0, *change], [*change, batch.num_rows]):
            if first == last:
                continue
            now = tuple(c[first] for c in columns)
            if now != key and held:
                yield key, pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(first, last - first))
    if held:
        yield key, pa.Table.from_batches(held)


def prefix_sums(df: DataFrame, keys: list[str], order: list[Column], label: str, **values: Column) -> DataFrame:
    """Add, per key and in ``order``, the sum of each value over all earlier rows (exclusive; nulls count as zero).

    Rows are range-partitioned by key and order and written once with their range number, so a key with any share of
    the rows spreads over many ranges. Each range is summed by itself, one summary row per (range, key) is carried
    forward, and rows add what their range inherits. ``order`` should end in a unique column; rows equal in all of it
    come in an arbitrary but fixed order.
    """
    spark = df.sparkSession
    names = list(values)
    marked = df.select("*", *[F.coalesce(v, F.lit(0)).alias(f"_v_{n}") for n, v in values.items()], *[c.alias(f"_o{i}") for i, c in enumerate(order)], F.monotonically_increasing_id().alias("_place"))
    sort = [F.col(f"_o{i}").asc_nulls_last() for i in range(len(order))]
    # Rows equal in all of it may be a third of all, so their place in the input cuts between them.
    by = [*[F.col(k).asc_nulls_last() for k in keys], *sort, F.col("_place")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(
        marked.repartitionByRange(parts, *by).drop("_place").select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_row")), label
    )
    inside = Window.partitionBy("_range", *keys).orderBy(*sort, "_row").rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select("*", *[F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)).alias(f"_l_{n}") for n in names])
    # One row per range and key: as many rows as ranges and keys together.
    totals = ranged.groupBy("_range", *keys).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
    before = Window.partitionBy(*keys, F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        F.col("_range").alias("_c_range"),
        *[F.col(k).alias(f"_c_{k}") for k in keys],
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_sum_{n}") for n in names],
    )
    match = F.col("_range") == F.col("_c_range")
    for key in keys:
        match = match & F.col(key).eqNullSafe(F.col(f"_c_{key}"))
    return local.join(carry, match, "inner").select(*df.columns, *[(F.col(f"_l_{n}") + F.col(f"_c_sum_{n}")).alias(n) for n in names])
