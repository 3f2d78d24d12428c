"""What keeps the work of a query in proportion to its input."""

from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from turnwise.sources import ranges
from turnwise.streaming import ingest


def test_small_ranges_share_tasks(spark):
    work = spark.range(20_000).select(F.lit("file:/x").alias("uri"), (F.col("id") * 256).alias("begin"), (F.col("id") * 256 + 256).alias("end"))
    assert ranges.dealt(work, "begin", "end").rdd.getNumPartitions() <= max(20, ranges.TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    large = spark.range(50).select(F.lit("file:/x").alias("uri"), (F.col("id") * (1 << 26)).alias("begin"), ((F.col("id") + 1) * (1 << 26)).alias("end"))
    assert ranges.dealt(large, "begin", "end").rdd.getNumPartitions() >= min(50, ranges.TASKS_PER_CORE * spark.sparkContext.defaultParallelism)


def test_a_range_is_read_and_not_what_follows(tmp_path, monkeypatch):
    path = tmp_path / "lines"
    path.write_bytes(b'{"a":1}\r\n' * 200_000 + b"x" * 2_000_000 + b"\r\n")
    read, plain = [], ranges.Bytes.read
    monkeypatch.setattr(ranges.Bytes, "read", lambda self, start, end: read.append(got := plain(self, start, end)) or got)
    found = list(ranges.lines(ranges.Bytes(str(path)), 900_000, 900_256, path.stat().st_size))
    assert [at for at, _ in found] == list(range(900_000, 900_256, 9)) and sum(map(len, read)) < 16_384
    # A range inside a long line holds no line, and is all that is read for it.
    read.clear()
    assert list(ranges.lines(ranges.Bytes(str(path)), 2_000_000, 2_000_256, path.stat().st_size)) == [] and sum(map(len, read)) < 16_384


def test_turns_need_no_call_each(spark, tmp_path):
    schema = "session_ref string, turn_id string, version long, last_activity_at string, deleted boolean"
    plan = ingest.turn_changes(spark.readStream.schema(schema).parquet(str(tmp_path)))._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" not in plan and "max_by" in plan


@pytest.mark.parametrize("start", [False, True])
def test_counters_share_groups(spark, tmp_path, start):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "session_ref string, counter string, pos long, input_tokens long, output_tokens long"
    rows = [(None if c == 7 else f"s{c}", None if c == 8 else str(c % 2), p * 1000 + c, (p * 37 + c) % 50 or None, 2**60 + p - c) for c in range(700) for p in range(6)]
    known = ingest.batch_peaks(spark.createDataFrame([r for r in rows if r[2] < 2000], schema)) if start else None
    want, top = {}, {}
    for session, counter, pos, *values in sorted(rows, key=lambda r: r[2]):
        peaks = top.setdefault((session, counter), [0, 0])
        want[pos] = tuple(max((v or 0) - p, 0) for v, p in zip(values, peaks))
        top[session, counter] = [max(v or 0, p) for v, p in zip(values, peaks)]
    for low, high in ((2000 if start else 0, 4000), (4000, 6000)):
        spark.createDataFrame([r for r in rows if low <= r[2] < high], schema).write.mode("append").parquet(str(tmp_path / "in"))
        deltas = ingest.stream_usage_deltas(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), known)
        assert "pmod" in deltas._jdf.queryExecution().analyzed().toString()
        query = deltas.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).toPandas()
    assert dict(zip(found["pos"], zip(found["delta_input"], found["delta_output"]))) == {p: v for p, v in want.items() if p >= (2000 if start else 0)}
    assert len(found) == len(rows) - (1400 if start else 0) and found["session_ref"].isna().sum() == (4 if start else 6)


def test_threads_lie_in_few_folders(spark, tmp_path, monkeypatch):
    from turnwise.plans.catalog import sources

    (tmp_path / "sf").mkdir()
    pd.DataFrame([(c, t, "user", "x") for c in range(600) for t in range(2)], columns=["conv_id", "turn", "role", "text"]).to_parquet(tmp_path / "sf" / "conversations.parquet")
    monkeypatch.setattr("turnwise.session.work_dir", lambda spark, label: str(tmp_path / label))
    found = sources.thread_documents(spark, str(tmp_path / "sf"))
    assert found.groupBy("turn").count().collect() and found.count() == 1800 and found.select("conv_id").distinct().count() == 600
    folders = [f for f in Path(tmp_path / "threads").iterdir() if f.is_dir()]
    assert len(folders) <= sources.FOLDERS and len(list(Path(tmp_path / "threads").rglob("*.json"))) == 600


def test_index_lists_turns_by_slices(spark, tmp_path, monkeypatch):
    from turnwise.operators import search_index

    monkeypatch.setattr(search_index, "SLICE_LETTERS", 40)
    texts = ["The Data \U0001f600\U0001f600\U0001f600", "ab", None, "", "data datadata", "x" * 100, "the data"]
    rows = [(f"t{i}", t, "a/path" if i % 2 else None) for i, t in enumerate(texts)] + [(None, "the end", None), ("t0", "again data", None)]
    turns = spark.createDataFrame(rows, "turn_id string, canonical_text string, path_text string").coalesce(1)
    index = search_index.write_index(turns, str(tmp_path / "index"))
    cut = lambda t: {t[i : i + 3] for i in range(len(t) - 2)}
    want = sorted((x, r[0] or "", side) for r in rows for side in (0, 1) for x in cut((r[1 + side] or "").lower()))
    assert sorted((r.triple, r.turn_id or "", r.side) for r in index.postings(spark).collect()) == want
    assert {r.triple: r.turns for r in index.counts(spark).collect()} == pd.Series([x for x, _, _ in want]).value_counts().to_dict()
    assert index.lists(spark).count() < len(want) and index.lists(spark).agg(F.max("n")).first()[0] > 1
