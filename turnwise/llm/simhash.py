"""SimHash near-duplicates with covering locality-sensitive hashing.

A fingerprint is the bitwise majority of the 64-bit hashes of a text's 4-word shingles. Fingerprints within ``RADIUS``
bits are found with 2**(RADIUS + 1) - 1 bit masks: bit i carries a non-zero vector of RADIUS + 1 bits, and the mask of
each non-zero vector v keeps the bits whose vectors have an odd product with v. For any RADIUS differing bits some v is
orthogonal to all of their vectors, so that mask ignores them and both fingerprints fall into one bucket of its table:
no pair is missed. Each mask keeps 32 to 34 of the 64 bits.

Only distinct fingerprints are compared, so exact copies cost one row. A bucket of at most ``BUCKET`` fingerprints is
linked by comparing them in one place. The members of larger buckets are linked by midpoints instead: two of them are within 4
bits exactly if they share a value at most 2 bits away from each, and all that share a value are within 4 bits of each
other. Each value links its fingerprints to the smallest one; rows grow with the members and not with their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import free_names, materialize, same_row, text_digest
from turnwise.llm.components import connected_components

SHINGLE, SEED, RADIUS = 4, 42, 4
BUCKET = 256

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None) -> int:
    """Bits set in over half the shingle hashes; 0 for a text without words. A text of under 4 words is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    span = min(SHINGLE, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[span - 1 :].tolist())), np.uint64)
    lanes = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(values.view(np.int64))], names=["doc_id", "fp"])


def _keyed_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(values.view(np.int64))], names=["doc_id", "digest", "fp"])


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """Masks of which at least one ignores any given ``radius`` bits."""
    span = (1 << (radius + 1)) - 1
    vectors = [i % span + 1 for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, span + 1)]


def _as_long(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets to the links that join their members, each member linked to the root of its part of the bucket."""
    for batch in batches:
        a: list[int] = []
        b: list[int] = []
        for members in batch.column(0):
            own = np.array(members.as_py(), np.int64)
            near = np.bitwise_count(own.view(np.uint64)[:, None] ^ own.view(np.uint64)[None, :]) <= RADIUS
            left = np.ones(len(own), bool)
            while left.any():
                root = int(np.flatnonzero(left)[0])
                part, edge = np.zeros(len(own), bool), np.zeros(len(own), bool)
                part[root] = edge[root] = True
                while edge.any():
                    edge = near[edge].any(axis=0) & ~part
                    part |= edge
                left &= ~part
                part[root] = False
                a += own[part].tolist()
                b += [int(own[root])] * int(part.sum())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _midpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every fingerprint with all values at most RADIUS / 2 bits away."""
    flips = [0, *(sum(1 << i for i in chosen) for k in range(1, RADIUS // 2 + 1) for chosen in combinations(range(64), k))]
    flips = np.array(flips, np.uint64)
    for batch in batches:
        own = np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)
        for at in range(0, len(own), 64):
            part = own[at : at + 64]
            points = (part[:, None] ^ flips[None, :]).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(points.view(np.int64)), pa.array(np.repeat(part, len(flips)).view(np.int64))], names=["point", "fp"])


def fingerprint_links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Distinct ``fp`` to links (a, b) that join exactly the fingerprints reachable over steps of at most RADIUS bits."""
    masks = F.array(*[F.lit(_as_long(m)) for m in covering_masks()])
    # Each fingerprint becomes a row per mask, so the few bytes of them are dealt to all tasks first.
    distinct = distinct.select("fp").repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    keyed = distinct.select("fp", F.posexplode(masks).alias("t", "mask")).select("t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    sized = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    # Spark takes a row per mask or midpoint for as many bytes as the fingerprint had, so it would send millions of rows
    # through the driver as a small table; these joins are shuffled whatever it expects.
    shared = materialize(keyed.join(sized.hint("merge"), ["t", "key"]), "buckets")
    small = shared.filter(F.col("n") <= bucket).groupBy("t", "key").agg(F.collect_list("fp").alias("members")).select("members")
    links = small.mapInArrow(_linked, "a bigint, b bigint")

    crowded = shared.filter(F.col("n") > bucket).select("fp").distinct()
    points = crowded.mapInArrow(_midpoints, "point bigint, fp bigint")
    met = points.groupBy("point").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low <> high").select("point", "low")
    stars = points.join(met.hint("merge"), "point").filter("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()
    return links.unionByName(stars).distinct()


def fingerprinted(documents: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row, fp as a signed 64-bit integer; written once."""
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return materialize(texts.mapInArrow(_fingerprints, "doc_id bigint, fp bigint"), "fingerprints")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """Per row of ``documents``: doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable).

    Null and empty texts have fingerprint zero and are linked like any other. Rows that repeat a doc_id come out as
    often; a null doc_id stays null and gets the smallest known id of its component, or null. Columns other than
    doc_id and text are not read.
    """
    prints = fingerprinted(documents)
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    components = connected_components(fingerprint_links(distinct.select("fp")))
    rooted = distinct.join(components, distinct.fp == components.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = materialize(rooted.join(lowest, "root").select("fp", "component_id"), "known")
    return prints.join(known, "fp").select("doc_id", _hex(F.col("fp")).alias("fingerprint"), "component_id")


def _hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(documents: DataFrame) -> DataFrame:
    """Rows of ``documents`` that are the first of their group of near-duplicates, by doc_id (null last) and text; all columns stay.

    Rows are decided by id and text, so rows whose id is null or shared are told apart. Rows that
    repeat the id and text that stay all stay; of equal texts without an id one stays. The columns may have any names.
    """
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_digest(F.col("text")).alias("digest"))
    prints = materialize(texts.mapInArrow(_keyed_fingerprints, "doc_id bigint, digest binary, fp bigint"), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("least"))
    components = connected_components(fingerprint_links(distinct.select("fp")))
    rooted = distinct.join(components, distinct.fp == components.node, "left").select("least", F.coalesce("root", "fp").alias("root"))
    first_id, first_digest, row = free_names(documents.columns, "first_id", "first_digest", "row")
    first = materialize(rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.doc_id").alias(first_id), F.col("least.digest").alias(first_digest)), "first")
    known, unnamed = first.filter(F.col(first_id).isNotNull()), first.filter(F.col(first_id).isNull())
    own = [documents[c] for c in documents.columns]
    named = documents.join(known, same_row(documents, known[first_id], known[first_digest]), "left_semi").select(*own)
    equal = documents.filter(documents["doc_id"].isNull()).join(unnamed, same_row(documents, unnamed[first_id], unnamed[first_digest]))
    one = equal.groupBy(first_digest).agg(F.min_by(F.struct(*own), F.xxhash64(*own)).alias(row))
    return named.unionAll(one.select(f"{row}.*"))
