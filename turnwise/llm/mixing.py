"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected target / size times in the mix. Within a source, documents are laid end to end
by those expectations, in order of their size so that every stretch of the line has its share of short and long ones;
one offset is drawn per source, and a document is taken once for every whole number its stretch crosses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import BLANK_SEPARATED, free_names, materialize, prefix_sums, same_row, text_digest

#: Expected copies are whole multiples of 2**-BITS, so that sums are exact in any order.
BITS = 40


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(BLANK_SEPARATED)), F.lit(0)).cast("long")


def cycled_weights(sizes: DataFrame, cycle: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """(source, weight): weights dealt in turn to the sources in order of code point, null last."""
    ranked = prefix_sums(sizes.select("source"), [], [F.col("source")], "source-ranks", rank=F.lit(1))
    weights = F.array(*[F.lit(w) for w in cycle])
    return ranked.select("source", F.element_at(weights, (F.col("rank") % len(cycle) + 1).cast("int")).cast("long").alias("weight"))


def water_levels(sizes: DataFrame, weights: DataFrame, share: float, cap: int) -> DataFrame:
    """(source, source_size, target): ``share`` of all sizes dealt by weight, no target above ``cap`` times its source.

    With the sources in order of cap over weight, the first one that its equal-by-weight part of what the earlier ones
    leave does not fill sets the level for itself and all later ones; the earlier ones get their cap. Sources without a
    weight, or with none above zero, get nothing.
    """
    known = weights.filter(F.col("weight") > 0).select(F.col("source").alias("_w_source"), "weight")
    both = sizes.join(known, F.col("source").eqNullSafe(F.col("_w_source")), "left").drop("_w_source")
    both = both.withColumn("cap", F.col("source_size") * cap).withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    both = materialize(both, "source-sizes")
    ordered = prefix_sums(both.filter("weight IS NOT NULL"), [], [F.col("ratio"), F.col("source")], "source-levels", capped=F.col("cap"), passed=F.col("weight"))
    total = both.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("all_sizes"), F.coalesce(F.sum("weight"), F.lit(0)).alias("all_weights"))
    level = (F.lit(share) * F.col("all_sizes") - F.col("capped")) / (F.col("all_weights") - F.col("passed"))
    # One row each: the totals and the level.
    first = F.struct("ratio", F.col("source").isNull(), "source")
    levels = ordered.join(F.broadcast(total)).select("*", level.alias("level")).filter("level <= ratio").agg(F.min_by("level", first).alias("level"))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("weight"))
    return both.join(F.broadcast(levels)).select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def source_offset(source: Column, seed: str) -> Column:
    """The random offset of a source: BITS bits of a digest of the seed and its name."""
    name = F.coalesce(F.concat(F.lit("s:"), source), F.lit("null"))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), name)), 1, BITS // 4), 16, 10).cast("long")


def copies_by_systematic_sampling(expected: DataFrame, seed: str = "mix") -> DataFrame:
    """Add ``copies`` to rows of (doc_id, source, size, text_digest, expected): expected is in units of 2**-BITS.

    The copies of a source add up to its summed expectations rounded down or up, and those of a document to its own.
    """
    placed = prefix_sums(expected, ["source"], [F.col("size"), F.col("doc_id"), F.col("text_digest")], "mix-order", before=F.col("expected").cast("decimal(20,0)"))
    unit = 1 << BITS
    # Only the part below one matters: a stretch crosses as many whole numbers wherever it begins.
    start = F.pmod(F.col("before") + source_offset(F.col("source"), seed), F.lit(unit).cast("decimal(20,0)")).cast("long")
    return placed.select(*expected.columns, F.floor((start + F.col("expected")) / F.lit(float(unit))).cast("long").alias("copies"))


def mixed(documents: DataFrame, weights: DataFrame | None = None, share: float = 1.5, cap: int = 2, seed: str = "mix") -> DataFrame:
    """Per row of ``documents``: doc_id, source, size (words), source_size, target of its source, copies, taken, text_digest.

    ``weights`` has (source, weight); by default weights 5, 2, 1 are dealt in turn. Null and empty texts have size 0 and
    their copies take no words; a null source is a source; repeated rows are rows of their own; a source of size zero has
    target zero and is not taken. Reruns give the same copies. Other columns are not read.
    """
    sized = documents.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text")).alias("size"), text_digest(F.col("text")).alias("text_digest"))
    sized = materialize(sized, "sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(water_levels(sizes, weights if weights is not None else cycled_weights(sizes), share, cap), "targets")
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * F.lit(float(1 << BITS))).cast("long")).otherwise(0)
    rates = targets.select(F.col("source").alias("_t_source"), "source_size", "target", rate.alias("expected"))
    expected = sized.join(rates, F.col("source").eqNullSafe(F.col("_t_source"))).select("doc_id", "source", "size", "source_size", "target", "text_digest", "expected")
    return copies_by_systematic_sampling(expected, seed).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "text_digest"
    )


def emit(documents: DataFrame, mix: DataFrame) -> DataFrame:
    """The rows of ``documents``, as often as the mix takes them.

    Rows equal in doc_id, source and text come out as often, together, as the mix takes all of them: each as often as the
    least taken, and one of them for what is left. Null ids, sources and texts are values like others; the columns may have
    any names; no documents, or a mix that takes none, give no row.
    """
    own_id, own_source, digest, copies, left, copy, row = free_names(documents.columns, "id", "source", "digest", "copies", "left", "copy", "row")
    per = mix.groupBy(F.col("doc_id").alias(own_id), F.col("source").alias(own_source), F.col("text_digest").alias(digest))
    taken = materialize(per.agg(F.min("copies").alias(copies), (F.sum("copies") - F.min("copies") * F.count("*")).alias(left)), "copies")
    own = [documents[c] for c in documents.columns]

    def match(rows: DataFrame) -> Column:
        return same_row(documents, rows[own_id], rows[digest]) & documents["source"].cast("string").eqNullSafe(rows[own_source])

    def repeated(rows: DataFrame, times: str) -> DataFrame:
        return rows.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(times).cast("int"))))

    each, rest = taken.filter(F.col(copies) > 0).drop(left), taken.filter(F.col(left) > 0).drop(copies)
    always = repeated(documents.join(each, match(each)), copies).select(*own)
    one = documents.join(rest, match(rest)).groupBy(own_id, own_source, digest, left).agg(F.min_by(F.struct(*own), F.xxhash64(*own)).alias(row))
    return always.unionAll(repeated(one, left).select(f"{row}.*"))
