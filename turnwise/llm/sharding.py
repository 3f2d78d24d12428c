"""Placement by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a prime-sized table; shards take turns and each claims
the next slot in its order that is still free. Each shard ends up with size / shards slots give or take one, and
adding or removing a shard moves few slots between the others. Documents are hashed to a slot, and the table of a
fixed number of rows is broadcast, so a placement costs one probe.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime; over a hundred slots for each of up to several hundred shards keeps shares even to about a percent.
TABLE_SIZE = 65537
SHARDS = tuple(f"shard-{k:03d}" for k in range(128))


def filled_table(shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> list[int]:
    """Slot to number of the shard, filled in turns."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shards must be distinct, at least one, and no more than slots")
    digests = [hashlib.md5(name.encode()).digest() for name in shards]
    at = [int.from_bytes(d[:8], "big") % size for d in digests]
    step = [int.from_bytes(d[8:], "big") % (size - 1) + 1 for d in digests]
    table, free = [-1] * size, size
    while True:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % size
            table[at[k]] = k
            free -= 1
            if not free:
                return table


def lookup(spark: SparkSession, shards: tuple[str, ...], size: int) -> DataFrame:
    """(slot, shard): ``size`` rows, whatever the data."""
    slots = spark.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, filled_table(shards, size)))), ",")).alias("slot", "number"))
    names = F.array(*[F.lit(name) for name in shards])
    return slots.select("slot", F.element_at(names, F.col("number").cast("int") + 1).alias("shard"))


def slot_of(key: Column, size: int) -> Column:
    return (F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long") % size).cast("int")


def placed(documents: DataFrame, shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """All columns of ``documents``, with slot and shard (columns of these names are replaced).

    The key is the doc_id; a row without one is placed by its text, and one without both by a fixed key. Rows of equal
    keys share a shard. No shuffle.
    """
    key = F.coalesce(documents["doc_id"].cast("string"), F.concat(F.lit("text:"), F.md5(documents["text"].cast("string"))), F.lit("none"))
    kept = [documents[c] for c in documents.columns if c.lower() not in ("slot", "shard")]
    slotted = documents.select(*kept, slot_of(key, size).alias("slot"))
    table = lookup(documents.sparkSession, shards, size)
    return slotted.join(F.broadcast(table), "slot").select(*[slotted[c] for c in slotted.columns[:-1]], "slot", "shard")


def write_shards(documents: DataFrame, path: str, files_per_shard: int = 1, **options) -> None:
    """Write one folder per shard, of ``files_per_shard`` files dealt by a hash of the row key."""
    rows = placed(documents, **options)
    deal = F.pmod(F.xxhash64("doc_id", "text"), F.lit(files_per_shard))
    rows.repartition(F.col("shard"), deal).write.partitionBy("shard").parquet(path)
