"""Files in byte ranges, files that grow, and tables that follow deliveries."""

import hashlib
import random
import re

import pytest

from turnwise.sources import files, growth, ranges
from turnwise.streaming import ingest


def _plain(data: bytes) -> list[str]:
    lines = (x.decode("utf-8", "replace").strip(ranges.BLANKS) for x in re.split(b"\r\n|\r|\n", data))
    return [x for x in lines if x]


def _random_file(rng, count):
    parts = ["{}", '{"a": 1}', "é中😀" * 3, " ", "", "\t x  ", "y" * 90, "﻿z"]
    return "".join(rng.choice(parts) + rng.choice(["\n", "\r", "\r\n", "\n\n", "\r\r\n"]) for _ in range(count)).encode() + rng.choice([b"", b"tail", b"\xff\xfe"])


@pytest.mark.parametrize("block", [7, 64, 4 << 20])
def test_lines_at_every_cut(tmp_path, monkeypatch, block):
    monkeypatch.setattr(ranges, "BLOCK_BYTES", block)
    rng = random.Random(block)
    for k in range(12):
        data = _random_file(rng, 25)
        path = tmp_path / f"{k}.jsonl"
        path.write_bytes(data)
        for size in (1, 2, 3, 10, 101, len(data)):
            found = [x for begin in range(0, len(data), size) for x in ranges.lines(ranges.Bytes(str(path)), begin, min(begin + size, len(data)), len(data))]
            assert [text for _, text in found] == _plain(data)
            assert all(data[at:].startswith(text[:1].encode()) or not data[at : at + 1].strip() or text[:1] in "z�" or data[at] in (0xC2, 0xEF, 0xFF) for at, text in found)


def test_records_do_not_depend_on_ranges(spark, tmp_path):
    rng = random.Random(3)
    whole = {f"{k}.jsonl": _random_file(rng, 40) for k in range(5)} | {"empty.jsonl": b"", "long.jsonl": b'{"x": "' + b"w" * 300_000 + b'"}\n{}'}
    for name, data in whole.items():
        (tmp_path / name).write_bytes(data)
    told = []
    for size in (97, 1000, 1 << 20):
        rows = files.read_jsonl(spark, str(tmp_path), "src", range_bytes=size).select("origin_path", "ordinal", "raw_json", "blob_id", "record_id").collect()
        told.append(sorted(map(tuple, rows)))
    assert told[0] == told[1] == told[2]
    for name, data in whole.items():
        assert [(r[1], r[2]) for r in told[0] if r[0].endswith("/" + name)] == list(enumerate(_plain(data)))


def test_capture_in_blocks(spark, tmp_path):
    rows = [f'{{"timestamp":"2026-03-12T10:00:{k % 60:02d}.000Z","pad":"{"p" * 900}"}}' for k in range(300)]
    (tmp_path / "a.jsonl").write_text("\n".join(rows))
    (tmp_path / "b.jsonl").write_text('{"timestamp":5}\nnot json\n{"timestamp":"2026-01-01T00:00:00Z"}\n')
    (tmp_path / "c.jsonl").write_bytes(b"")
    got = {r.origin_path[-7:]: r for r in files.capture(spark, str(tmp_path), "src").collect()}
    for name, r in got.items():
        data = (tmp_path / name).read_bytes()
        assert (r.size_bytes, r.checksum) == (len(data), hashlib.sha1(data).hexdigest())
    # An empty file holds nothing to capture and is not listed.
    assert sorted(got) == ["a.jsonl", "b.jsonl"]
    assert [got[f"{c}.jsonl"].content_max_timestamp for c in "ab"] == ["2026-03-12T10:00:59.000Z", "2026-01-01T00:00:00.000Z"]


def _status(changes):
    return {r.origin_path.rsplit("/", 1)[1]: (r.status, r.start, r.base) for r in changes.collect()}


def test_growing_files(spark, tmp_path):
    root, state = tmp_path / "in", tmp_path / "state"
    root.mkdir()
    follower = ingest.GrowingFiles(spark, str(root), str(state), range_bytes=11, chunk_bytes=16)
    assert follower.records().count() == 0
    start = {"grows": b'{"a":1}\r\n{"a":2}\r', "cut": b'{"a":1}\n{"a"', "open": b'{"a":1}\n{"a":2}', "head": b'{"a":1}\n', "same": b"{}\n", "gone": b"{}\n", "blank": b"", "tail": b'{"a":1}\n' * 9}
    for name, data in start.items():
        (root / name).write_bytes(data)
    assert set(_status(follower.run()).values()) == {("new", 0, 0)}
    later = {"grows": start["grows"] + b'\n{"a":3}\n', "cut": start["cut"] + b":2}\n", "open": start["open"] + b'\n{"a":3}', "head": b'{"b":1}\n{"a":2}\n', "blank": b"{}\n", "added": b"{}", "tail": start["tail"] + b'{"a":2}'}
    for name, data in later.items():
        (root / name).write_bytes(data)
    (root / "gone").unlink()
    assert _status(follower.run()) == {
        "grows": ("appended", 17, 2), "cut": ("rewritten", 0, 0), "open": ("appended", 15, 2), "head": ("rewritten", 0, 0), "same": ("unchanged", 3, 1),
        "gone": ("gone", 0, 0), "blank": ("new", 0, 0), "added": ("new", 0, 0), "tail": ("appended", 72, 9),
    }
    # A run that was cut off before its captures were written is done again.
    (root / "tail").write_bytes(later["tail"] + b"\n{}")
    follower.run()
    import shutil

    shutil.rmtree(state / "captures" / "run=2")
    follower.run()
    (root / "tail").write_bytes(later["tail"][:-1] + b"]\n{}")
    assert _status(follower.run())["tail"][0] == "rewritten"
    read = {}
    for r in follower.records().collect():
        read.setdefault(r.origin_path.rsplit("/", 1)[1], []).append((r.ordinal, r.raw_json))
    assert {n: sorted(x) for n, x in read.items()} == {f.name: list(enumerate(_plain(f.read_bytes()))) for f in root.iterdir() if f.stat().st_size}


def test_files_beyond_four_gigabytes_need_no_int(spark):
    listing = spark.createDataFrame([("file:/x", "/x", 5 << 32)], "uri string, origin_path string, length long")
    cut = ranges.byte_ranges(listing, 1 << 32).orderBy("begin").collect()
    assert [(r.begin, r.end) for r in cut] == [(k << 32, (k + 1) << 32) for k in range(5)]


def _deliver(spark, tmp_path, name, rows):
    schema = "session_ref string, turn_id string, version long, last_activity_at string, deleted boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ingest.upsert_sessions(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
    return {r.session_ref: (r.turn_count, r.last_activity_at) for r in ingest.merged_sessions(spark, str(tmp_path / "out")).collect()}


def test_sessions_follow_their_turns(spark, tmp_path):
    first = [("s", "t1", 1, "2026-01-01", False), ("s", "t2", 1, "2026-01-05", False), ("s", "t2", 1, "2026-01-05", False), ("u", "t3", 1, None, None)]
    assert _deliver(spark, tmp_path, "a", first) == {"s": (2, "2026-01-05"), "u": (1, None)}
    again = [("s", "t2", 2, "2026-01-02", False), ("s", "t1", 1, "2029-01-01", False), ("u", "t3", 2, None, True), ("v", "t4", 3, "2026-02-01", True)]
    assert _deliver(spark, tmp_path, "b", again) == {"s": (2, "2026-01-02")}
    assert _deliver(spark, tmp_path, "c", [("u", "t3", 1, "2026-03-01", False), ("u", "t3", 4, "2026-04-01", False)]) == {"s": (2, "2026-01-02"), "u": (1, "2026-04-01")}


def test_growth_of_nothing(spark, tmp_path):
    captures, chunks = growth.nothing_captured(spark)
    listing = spark.createDataFrame([], "uri string, origin_path string, length long, modificationTime timestamp")
    assert growth.growth(captures, chunks, listing).count() == 0
