"""Exports with a manifest, the index of letter triples, and the one-pass parse stage."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from turnwise.operators import search, search_index
from turnwise.sources import sinks
from turnwise.sources.formats import fragments_of, parse_stage


def _tables(spark, count=300):
    turns = spark.createDataFrame([(f"t{k}", f"2024-01-{k % 28 + 1:02d}T00:00:00.000Z", f"text {k}\nline two" if k % 3 else None) for k in range(count)], "turn_id string, submission_started_at string, canonical_text string")
    return {"turn": turns.withColumn("created_at", F.col("submission_started_at")), "source": spark.createDataFrame([("b",), ("a",)], "source_id string")}


def test_export_in_order_with_a_manifest(spark, tmp_path):
    tables, path = _tables(spark), str(tmp_path / "out")
    left = tmp_path / "out" / sinks.UNFINISHED
    left.mkdir(parents=True)
    (left / "of-a-lost-attempt").write_text("half a")
    sinks.export_jsonl(tables, path)
    manifest = sinks.read_manifest(path)
    assert manifest["kinds"] == [["source", 2], ["turn", 300]] and manifest["lines"] == 302 and len(manifest["parts"]) > 1
    assert sorted(p.name for p in Path(path).iterdir() if not p.name.startswith(".")) == sorted([sinks.MANIFEST, *[p["name"] for p in manifest["parts"]]])
    lines = [json.loads(line) for part in manifest["parts"] for line in (Path(path) / part["name"]).read_text().splitlines()]
    order = sorted((r for r in tables["turn"].collect()), key=lambda r: r.turn_id)
    order.sort(key=lambda r: r.submission_started_at, reverse=True)
    assert [x["value"].get("source_id") or x["value"]["turn_id"] for x in lines] == ["a", "b", *[r.turn_id for r in order]]
    read = sinks.read_export(spark, path).orderBy("place").collect()
    assert [r.place for r in read] == list(range(302)) and [json.loads(r.line) for r in read] == lines
    assert sinks.broken_parts(spark, path).isEmpty()
    last = Path(path) / manifest["parts"][-1]["name"]
    last.write_bytes(last.read_bytes()[:-2] + b"x\n")
    assert [r.name for r in sinks.broken_parts(spark, path).collect()] == [last.name]
    with pytest.raises(FileExistsError):
        sinks.export_jsonl(tables, path)


def test_a_failed_export_leaves_nothing(spark, tmp_path):
    rows = sinks.export_rows(_tables(spark), "s").withColumn("line", F.when(F.col("k3") == "t77", F.raise_error(F.lit("broken"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="broken"):
        sinks.write_export(rows, str(tmp_path / "out"), "jsonl", "s")
    assert not [p for p in (tmp_path / "out").rglob("*") if p.is_file()]


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    rng = random.Random(4)
    parts = ["data", "Daten", "é中😀", "İstanbul", "worthless", "the", "a b", "zzz", "xy"]
    rows = [(f"t{k}", "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 12))), rng.choice(["/w/data", "", None, "/THE/zzz"])) for k in range(400)]
    turns = spark.createDataFrame(rows, "turn_id string, canonical_text string, path_text string")
    index = search_index.write_index(turns, str(tmp_path / "index"))
    for query in ("data", "DATA the", "é中", "é中😀", "worth less", "zz", "x", "qqq", "zzz data worthless", "", "a b", "ta the"):
        terms = search.search_terms(query)
        want = {r.turn_id for r in (turns.where(search.search_match(terms)) if terms else turns).collect()}
        narrowed = search_index.narrowed(turns, index, query)
        assert {r.turn_id for r in (narrowed.where(search.search_match(terms)) if terms else narrowed).collect()} == want
    assert search_index.narrowed(turns, index, "worthless zzz").count() < 200 and search_index.narrowed(turns, index, "qqq").isEmpty()


def test_records_are_parsed_once(spark):
    lines = ['{"role":"user","content":"hi"}', "{broken", "[1]", '{"what":"?"}', '{"type":"turn_ended"}']
    rows = [("s", "cursor", "b", "/l", "sess:cursor:1", f"r{k}", k, None, "2024-01-01T00:00:00.000Z", x) for k, x in enumerate(lines * 7)]
    names = "source_id string, source_platform string, blob_id string, origin_path string, session_ref string, record_id string, ordinal long, pointer string, observed_at string, raw_json string"
    records = spark.createDataFrame(rows, names)
    fragments, audits, counts = parse_stage(records, "generic")
    assert counts == {"records": 35, "unparsed": 14, "fragments": 28, "audits": 21}
    assert (fragments.count(), audits.count()) == (28, 21)
    plain, found = fragments_of(records, "generic")
    assert sorted(map(str, fragments.collect())) == sorted(map(str, plain.collect())) and sorted(map(str, audits.collect())) == sorted(map(str, found.collect()))
    plan = plain._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
