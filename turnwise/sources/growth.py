"""Files that grow while they are read: what was captured, what came behind it, and what has to be read anew.

A capture is a row per file and a table of chunk digests. A file has grown if all extents captured before still have
their digests and what follows begins at a line end; then only its suffix is read and ordinals go on. Every other change
makes a new capture of the whole file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.session import materialize
from turnwise.sources import ranges

#: What is known of a captured file, and of its chunks.
CAPTURE = "origin_path string, size_bytes long, modified_at timestamp, generation long, record_count long, clean boolean"
CHUNK = "origin_path string, chunk long, begin long, end long, digest string, last_byte int"

UNCHANGED, APPENDED, REWRITTEN, NEW, GONE = "unchanged", "appended", "rewritten", "new", "gone"


def nothing_captured(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], CAPTURE), spark.createDataFrame([], CHUNK)


def growth(captures: DataFrame, chunks: DataFrame, now: DataFrame) -> DataFrame:
    """What became of every file: (origin_path, uri, status, length, modified_at, generation, start, base).

    ``captures`` and ``chunks`` tell what was captured (columns of CAPTURE and CHUNK), ``now`` is a listing. A file of the
    same size and time is taken as unchanged without being read. ``start`` and ``base`` say from which byte on, and with
    which ordinal, a file is to be read. A file whose capture held a broken record is read anew, since the record may have
    been cut short; so is one that kept its size or shrank.
    """
    old = captures.select("origin_path", "size_bytes", F.col("modified_at").alias("was_at"), "generation", "record_count", "clean")
    both = materialize(now.withColumnRenamed("modificationTime", "modified_at").join(old, "origin_path", "full"), "listing")
    same = (F.col("length") == F.col("size_bytes")) & (F.col("modified_at") == F.col("was_at"))
    longer = both.filter((F.col("length") > F.col("size_bytes")) & F.col("clean"))

    extents = chunks.withColumnsRenamed({"digest": "was", "last_byte": "was_last"}).join(longer.select("uri", "origin_path"), "origin_path")
    extents = materialize(extents, "captured-extents")
    checked = ranges.extent_digests(extents).select("origin_path", "chunk", "digest")
    compared = extents.join(checked, ["origin_path", "chunk"])
    kept = compared.groupBy("origin_path").agg(
        F.bool_and(F.coalesce(F.col("was") == F.col("digest"), F.lit(False))).alias("kept"), F.max_by("was_last", "chunk").alias("last_byte")
    )
    behind = longer.select("uri", "origin_path", F.lit(0).cast("long").alias("chunk"), F.col("size_bytes").alias("begin"), (F.col("size_bytes") + 1).alias("end"))
    following = ranges.extent_digests(behind).select("origin_path", F.col("last_byte").alias("next_byte"))
    # 10 and 13 end a line; a file that was empty has nothing before the suffix.
    known = longer.select("origin_path", "size_bytes").join(kept, "origin_path", "left").join(following, "origin_path")
    at_line = F.col("last_byte").isin(10, 13) | F.col("next_byte").isin(10, 13) | (F.col("size_bytes") == 0)
    grown = known.select("origin_path", (F.coalesce("kept", F.col("size_bytes") == 0) & at_line).alias("grown"))

    status = (
        F.when(F.col("length").isNull(), GONE)
        .when(F.col("size_bytes").isNull(), NEW)
        .when(same, UNCHANGED)
        .when(F.coalesce("grown", F.lit(False)), APPENDED)
        .otherwise(REWRITTEN)
    )
    told = both.join(grown, "origin_path", "left").withColumn("status", status)
    goes_on = F.col("status").isin(APPENDED, UNCHANGED)
    return told.select(
        "origin_path",
        "uri",
        "status",
        "length",
        "modified_at",
        F.when(F.col("status") == NEW, 0).when(F.col("status") == REWRITTEN, F.col("generation") + 1).otherwise(F.col("generation")).cast("long").alias("generation"),
        F.when(goes_on, F.col("size_bytes")).otherwise(0).cast("long").alias("start"),
        F.when(goes_on, F.col("record_count")).otherwise(0).cast("long").alias("base"),
    )


def read_growth(changes: DataFrame, size: int = ranges.RANGE_BYTES) -> DataFrame:
    """Lines of what is new: (origin_path, generation, ordinal, at, raw_json), read from the byte where each file goes on."""
    fresh = changes.filter(F.col("status").isin(APPENDED, REWRITTEN, NEW))
    lines = ranges.numbered_lines(fresh.select("uri", "origin_path", "length", "start", "base", F.col("generation").alias("mark")), size)
    return lines.select("origin_path", F.col("mark").cast("long").alias("generation"), "ordinal", "at", "raw_json")


def captured(changes: DataFrame, lines: DataFrame, captures: DataFrame, chunks: DataFrame, size: int = ranges.CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """The captures and chunks after ``changes``, of which ``lines`` were read; chunks that were whole are not read again."""
    parsed = F.try_parse_json("raw_json").isNotNull()
    told = lines.groupBy("origin_path").agg(F.count("*").alias("n"), F.bool_and(parsed).alias("fine"))
    was = captures.select("origin_path", F.col("clean").alias("was_clean"))
    there = changes.filter(F.col("status") != GONE)
    goes_on = F.col("status").isin(APPENDED, UNCHANGED)
    after = there.join(told, "origin_path", "left").join(was, "origin_path", "left").select(
        "origin_path",
        F.col("length").alias("size_bytes"),
        "modified_at",
        "generation",
        (F.col("base") + F.coalesce("n", F.lit(0))).alias("record_count"),
        (F.coalesce("fine", F.lit(True)) & F.when(goes_on, F.col("was_clean")).otherwise(True)).alias("clean"),
    )
    # Of a file that went on, the chunks that were full stay; the one that was not and those behind it are new.
    still = chunks.join(there.filter(goes_on).select("origin_path", "status"), "origin_path")
    stay = still.filter((F.col("end") - F.col("begin") == size) | (F.col("status") == UNCHANGED)).select(*chunks.columns)
    first = F.when(F.col("status") == APPENDED, F.floor(F.col("start") / size) * size).otherwise(0).cast("long")
    again = there.filter(F.col("status") != UNCHANGED).select("uri", "origin_path", "length", first.alias("start"))
    cut = ranges.byte_ranges(again, size).select("uri", "origin_path", F.floor(F.col("begin") / size).cast("long").alias("chunk"), "begin", "end")
    return after, stay.unionByName(ranges.extent_digests(cut).select(*chunks.columns))
