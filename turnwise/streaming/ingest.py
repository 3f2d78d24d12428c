"""Transcripts that arrive and change while they are read, and the tables that follow them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from turnwise.functions.tokens import FIELDS
from turnwise.session import materialize
from turnwise.sources import growth, ranges

# --- files that grow -------------------------------------------------------------------------------------------------

LINE = "origin_path string, generation long, ordinal long, at long, raw_json string"


class GrowingFiles:
    """The records of files that are added, appended to, rewritten and deleted between one run and the next.

    A run reads only what is new and appends it to a table, one folder per run. Its captures are written last and commit
    it; a run that was cut off before is done again and replaces what it left. A record belongs to a generation of its
    file, and the records that count are those of the generations last captured.
    """

    def __init__(self, spark: SparkSession, roots: str | list[str], folder: str, glob: str | None = None, range_bytes: int = ranges.RANGE_BYTES, chunk_bytes: int = ranges.CHUNK_BYTES) -> None:
        self.spark, self.roots, self.folder, self.glob, self.range_bytes, self.chunk_bytes = spark, roots, folder.rstrip("/"), glob, range_bytes, chunk_bytes

    def _exists(self, path: str) -> bool:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)

    def _at(self, run: int, name: str) -> str:
        return f"{self.folder}/{name}/run={run}"

    def runs(self) -> int:
        """How many runs are committed."""
        run = 0
        while self._exists(f"{self._at(run, 'captures')}/_SUCCESS"):
            run += 1
        return run

    def captured(self) -> tuple[DataFrame, DataFrame]:
        """Captures and chunk digests after the last run."""
        done = self.runs()
        if not done:
            return growth.nothing_captured(self.spark)
        read = self.spark.read.schema
        return read(growth.CAPTURE).parquet(self._at(done - 1, "captures")), read(growth.CHUNK).parquet(self._at(done - 1, "chunks"))

    def run(self) -> DataFrame:
        """Read what is new; returns what became of every file, as ``growth.growth``."""
        run, (captures, chunks) = self.runs(), self.captured()
        changes = materialize(growth.growth(captures, chunks, ranges.listed(self.spark, self.roots, self.glob)), "changes")
        records = self._at(run, "records")
        growth.read_growth(changes, self.range_bytes).write.mode("overwrite").parquet(records)
        lines = self.spark.read.schema(LINE).parquet(records)
        after, after_chunks = growth.captured(changes, lines, captures, chunks, self.chunk_bytes)
        after_chunks.write.mode("overwrite").parquet(self._at(run, "chunks"))
        after.write.mode("overwrite").parquet(self._at(run, "captures"))
        return changes

    def records(self) -> DataFrame:
        """(origin_path, generation, ordinal, at, raw_json) of all files as they were at the last run."""
        done = self.runs()
        if not done:
            return self.spark.createDataFrame([], LINE)
        lines = self.spark.read.schema(LINE).parquet(*[self._at(run, "records") for run in range(done)])
        return lines.join(self.captured()[0].select("origin_path", "generation"), ["origin_path", "generation"], "left_semi")


# --- running counters ------------------------------------------------------------------------------------------------

DELTAS = {name: f"delta_{name.removesuffix('_tokens')}" for name in FIELDS}
DELTA_SCHEMA = "session_ref string, counter string, pos long, " + ", ".join(f"{delta} long" for delta in DELTAS.values())


#: Groups that the counters of a stream are dealt to; a group is gone through at once, its counters being a few of all.
COUNTER_GROUPS = 256


class RunningPeaks(StatefulProcessor):
    """Per (session, counter) the largest values so far; emits what each checkpoint adds to them.

    ``counter`` is the baseline key: checkpoints of one running counter share it, and a new one starts from zero. A
    counter that a checkpoint leaves out adds nothing and keeps its peak. Many counters are one group of the stream, since
    calling Python for each would take longer than its rows; only the peaks of counters that have rows are read.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.peaks = handle.getMapState("peaks", "session_ref string, counter string", ", ".join(f"{name} long" for name in FIELDS))

    def handleInitialState(self, key, known: pd.DataFrame, timer_values) -> None:
        """The peaks that a batch run left for the counters of the group."""
        for session_ref, counter, *top in known[["session_ref", "counter", *FIELDS]].itertuples(index=False):
            self.peaks.updateValue(_counter(session_ref, counter), tuple(int(v) for v in top))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        # What arrived for the group in one trigger; the source's files per trigger bound it.
        batch = pd.concat(list(rows)).sort_values("pos", ignore_index=True)
        group = batch.groupby(["session_ref", "counter"], dropna=False, sort=False).ngroup()
        first = ~group.duplicated()
        named = batch.loc[first, ["session_ref", "counter"]].itertuples(index=False)
        counters = {number: _counter(*name) for number, name in zip(group[first], named)}
        known = [self.peaks.getValue(counters[number]) if self.peaks.containsKey(counters[number]) else [0] * len(FIELDS) for number in range(len(counters))]
        top = {name: np.array([int(peaks[i]) for peaks in known], np.int64) for i, name in enumerate(FIELDS)}
        out = {"session_ref": batch["session_ref"], "counter": batch["counter"], "pos": batch["pos"].astype("int64")}
        for name in FIELDS:
            before = top[name][group]
            seen = batch[name].groupby(group).cummax().clip(lower=before)
            out[DELTAS[name]] = seen - seen.groupby(group).shift(fill_value=0).where(~first, before)
            top[name] = seen.groupby(group).max().to_numpy()
        for number, name in counters.items():
            self.peaks.updateValue(name, tuple(int(top[field][number]) for field in FIELDS))
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def _counter(session_ref, counter) -> tuple[str | None, str | None]:
    return tuple(None if pd.isna(v) else v for v in (session_ref, counter))


def _checkpoints(checkpoints: DataFrame) -> DataFrame:
    given = [F.coalesce(F.col(name).cast("long") if name in checkpoints.columns else F.lit(None), F.lit(0).cast("long")).alias(name) for name in FIELDS]
    return checkpoints.select("session_ref", "counter", "pos", *given)


def _grouped(checkpoints: DataFrame):
    return checkpoints.withColumn("group", F.pmod(F.xxhash64("session_ref", "counter"), F.lit(COUNTER_GROUPS))).groupBy("group")


def batch_peaks(checkpoints: DataFrame) -> DataFrame:
    """(session_ref, counter, peaks) that a batch of checkpoints leaves: the state from which a stream goes on."""
    return _checkpoints(checkpoints).groupBy("session_ref", "counter").agg(*[F.max(name).alias(name) for name in FIELDS])


def stream_usage_deltas(checkpoints: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Increments of running counters over appended checkpoints (session_ref, counter, pos, and any of the usage fields).

    ``known`` gives the peaks of ``batch_peaks`` that the first run of the stream starts from.
    """
    return _grouped(_checkpoints(checkpoints)).transformWithStateInPandas(
        statefulProcessor=RunningPeaks(), outputStructType=DELTA_SCHEMA, outputMode="Append", timeMode="None",
        initialState=_grouped(known) if known is not None else None,
    )


# --- sessions that follow their turns ----------------------------------------------------------------------------------

TURN_VERSION = "session_ref string, turn_id string, version long, last_activity_at string, deleted boolean"


def turn_changes(turns: DataFrame) -> DataFrame:
    """Changes of the turn table that deliveries (session_ref, turn_id, version, last_activity_at, deleted) make, as TURN_VERSION.

    A delivery replaces an earlier one of its turn if its version is higher; ``deleted`` takes the turn away. A turn comes
    out with its new version, in update mode, and not at all where what is delivered was known already. The state is an
    aggregate, so no turn costs a call of its own.
    """
    arrived = F.unix_millis(F.current_timestamp())
    given = turns.select(
        "session_ref", "turn_id", F.col("version").cast("long"), F.col("last_activity_at").cast("string"), F.coalesce("deleted", F.lit(False)).alias("deleted"), arrived.alias("arrived")
    )
    # Of equal versions the one that came first counts.
    last = F.max_by(F.struct("version", "last_activity_at", "deleted", "arrived"), F.struct("version", -F.col("arrived"))).alias("last")
    return given.groupBy("session_ref", "turn_id").agg(last).filter(F.col("last.arrived") == arrived).select("session_ref", "turn_id", "last.version", "last.last_activity_at", "last.deleted")


def upsert_sessions(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Append the changes of all deliveries that are there to a table, and stop; ``merged_sessions`` reads its state.

    Changes are written under their batch number, so a batch that is done again replaces itself.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    turn_changes(stream).writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def merged_sessions(spark: SparkSession, target: str) -> DataFrame:
    """(session_ref, turn_count, last_activity_at) of the sessions that have a turn.

    A turn is what its highest version says, so one that was taken back takes its time with it: the latest time is that
    of a turn that is still there.
    """
    rows = spark.read.schema(TURN_VERSION).parquet(target)
    turns = rows.groupBy("session_ref", "turn_id").agg(F.max_by(F.struct("last_activity_at", "deleted"), "version").alias("last")).filter("not last.deleted")
    return turns.groupBy("session_ref").agg(F.count("*").alias("turn_count"), F.max("last.last_activity_at").alias("last_activity_at"))
