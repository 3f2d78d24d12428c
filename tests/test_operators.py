import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from turnwise.functions import paths
from turnwise.functions.ordered import last_value, next_value, position_chunk, running_max, running_sum, with_running
from turnwise.functions.usertext import chunks_of
from turnwise.operators import atoms as atom_ops
from turnwise.operators import questions
from turnwise.operators import turns as turn_ops
from turnwise.operators import variants
from turnwise.operators.projects import connected_labels
from turnwise.operators.search import highlights
from turnwise.schemas import ATOM, complete
from turnwise.streaming.ingest import stream_usage_deltas


def test_chunked_scan_equals_plain_window(spark):
    rng = random.Random(7)
    rows = [(f"s{rng.randrange(3)}", i, rng.randrange(50), rng.choice([None, f"v{i}"])) for i in range(400)]
    df = spark.createDataFrame(rows, "key string, pos long, n long, v string")
    chunks = [position_chunk("pos", 7), position_chunk("pos", 50)]
    ours = with_running(
        df, ["key"], ["pos"], chunks, total=running_sum(F.col("n")), peak=running_max(F.col("n"), False), prev=last_value(F.col("v"), False), nxt=next_value(F.col("v"))
    )
    w = Window.partitionBy("key").orderBy("pos")
    plain = df.select(
        "*",
        F.sum("n").over(w).alias("total"),
        F.max("n").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("peak"),
        F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("prev"),
        F.first("v", True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("nxt"),
    )
    assert Counter(map(tuple, ours.collect())) == Counter(map(tuple, plain.collect()))


def _procedural_groups(kinds):
    """Group starts by walking the atoms, the way the rule is worded."""
    starts, open_group, replied = [], False, False
    for kind in kinds:
        if kind == "reply":
            replied = open_group or replied
        start = kind in ("authored", "injected") and (not open_group or (replied and kind == "authored"))
        if start:
            open_group, replied = True, False
        starts.append(start)
    return starts


def test_groups_equal_the_procedure(spark):
    rng = random.Random(3)
    sequences = {f"s{i}": [rng.choice(["authored", "injected", "reply", "hidden", "tool"]) for _ in range(rng.randrange(1, 12))] for i in range(300)}
    rows = []
    for session, kinds in sequences.items():
        for pos, kind in enumerate(kinds):
            actor = {"authored": "user", "injected": "user", "tool": "tool"}.get(kind, "assistant")
            origin = {"authored": "user_authored", "injected": "injected_user_shaped"}.get(kind, "assistant_authored")
            rows.append(("src", "generic", session, pos, f"{session}:{pos}", actor, origin, "tool_call" if kind == "tool" else "text", "hide" if kind == "hidden" else "show"))
    atoms = complete(
        spark.createDataFrame(rows, "source_id string, source_platform string, session_ref string, pos long, atom_id string, actor_kind string, origin_kind string, content_kind string, display_policy string"),
        ATOM,
    )
    found = {(r.session_ref, r.pos): r.starts_group for r in turn_ops.tag_groups(atoms).select("session_ref", "pos", "starts_group").collect()}
    for session, kinds in sequences.items():
        assert [found[session, pos] for pos in range(len(kinds))] == _procedural_groups(kinds)


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)]
    hub = [("h000", f"h{i:03d}") for i in range(1, 30)]
    edges = spark.createDataFrame(chain + hub, "a string, b string")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = {r.node: r.label for r in connected_labels(edges, nodes).collect()}
    assert set(labels.values()) == {"n000", "h000"}
    assert all(label[0] == node[0] for node, label in labels.items())


def test_scope_counts_whole_segments(spark):
    df = spark.createDataFrame([("/work/app",), ("/work/app/x",), ("/work/app2",), (None,)], "p string")
    assert [r[0] for r in df.select(paths.scope_match(F.col("p"), "/work/app/")).collect()] == [True, True, False, False]


def test_touching_highlights_merge(spark):
    df = spark.createDataFrame([("Needle needle x need",)], "t string")
    spans = df.select(highlights(F.col("t"), ["needle", " needle", "need"])).first()[0]
    assert [(s.start, s.end) for s in spans] == [(0, 13), (16, 20)]


def test_user_text_chunks():
    kinds = lambda text, tagged=False: [(c["origin_kind"], c["text"]) for c in chunks_of(text, tagged)]
    assert kinds("<command-name>/review</command-name><command-args>the diff</command-args>")[1] == ("user_authored", "the diff")
    assert len(kinds("<command-name>/clear</command-name>")) == 1
    assert kinds("a [User Request] b") == [("injected_user_shaped", "a"), ("user_authored", "b")]
    assert kinds("<timestamp>now</timestamp><user_query>do</user_query> more", True)[-1] == ("user_authored", "do\n\nmore")
    assert kinds("<INSTRUCTIONS>never closed")[0][0] == "injected_user_shaped"


def _alike(left, right):
    """The rule for two prompts in plain Python."""
    plain = [re.sub(r"[\W_]+", " ", x.lower().replace("**", "").replace("`", "")).strip() for x in (left, right)]
    if not all(plain):
        return False
    short, long = sorted(plain, key=len)
    if short == long or (len(short) >= 24 and short in long):
        return True
    stems = []
    for side in plain:
        words = set()
        for w in side.split():
            if re.fullmatch("[a-z]{3,}", w):
                w = w[:-3] + "y" if len(w) > 4 and w.endswith("ies") else w[:-1] if len(w) > 4 and w.endswith("s") and not w.endswith("ss") else w
            elif len(w) < (3 if w.isascii() else 2):
                continue
            if w not in variants.COMMON_WORDS:
                words.add(w)
        stems.append(words)
    shared, (fewer, more) = len(stems[0] & stems[1]), sorted(map(len, stems))
    return shared >= 4 and shared >= 0.6 * fewer and shared >= 0.45 * more


def test_alike_prompts(spark):
    pairs = [("Please fix the **parser** tests", "please fix the parser tests"), ("fix parser", "write docs"), ("", ""), ("run `all` queries now", "Run all query now!"), ("été ici là 中文 stories", "stories 中文 là ici été bug")]
    words = "fix the parsers parser tests test class classes bodies body for été là 中 中文 ab abc 12 123 now".split()
    rng = random.Random(11)
    for _ in range(400):
        left = rng.choices(words, k=rng.randint(0, 9))
        right = rng.sample(left, rng.randint(len(left) // 2, len(left))) + rng.choices(words, k=rng.randint(0, 3))
        pairs.append((" ".join(left), "-".join(right)))
    side = lambda c: F.struct(variants.plain_prompt(F.col(c)).alias("plain"), variants.word_stems(variants.plain_prompt(F.col(c))).alias("stems"))
    rows = spark.createDataFrame(pairs, "l string, r string").select("l", "r", variants.prompts_alike(side("l"), side("r")).alias("alike")).collect()
    assert [r.alike for r in rows] == [_alike(r.l, r.r) for r in rows] and 20 < sum(r.alike for r in rows) < 300


@pytest.mark.parametrize("chunk", [1, 3, 256])
def test_prompt_chains_in_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(variants, "CHUNK_PROMPTS", chunk)
    rng = random.Random(5)
    said = ["please fix the parser tests in module one", "fix parser test module one two", "fix the parser module two three four", "write docs", "two three four five parser module"]
    rows, want = [], set()
    for chain in range(30):
        ms, kept = 0, None
        for place in range(rng.randint(1, 25)):
            ms += rng.choice([0, 60_000, 200_000])
            text = rng.choice(said[: 2 + chain % 4])
            key = f"{chain}:{place}"
            rows.append(("s", chain, place, key, text, ms))
            if kept and ms - kept[1] <= variants.VARIANT_GAP_MS and _alike(kept[0], text):
                want.add(key)
            else:
                kept = text, ms
    df = spark.createDataFrame(rows, "source_id string, chain long, place long, atom_id string, text string, ms long")
    assert {r.atom_id for r in variants.dropped_variants(df, ["source_id", "chain"]).collect()} == want and len(want) > 50


def test_answers():
    asked = [{"id": "q", "question": "Which?", "options": [{"label": "Red"}, {"label": "Blue"}]}]
    label = lambda output: [(a["selected_label"], a["free_text"]) for a in questions.answers_of(asked, output)]
    assert label(json.dumps({"answers": {"q": {"answers": ["blue", "soon"]}}})) == [("Blue", "soon")]
    assert label('Your questions have been answered: "Which?"="Red"') == [("Red", None)]
    assert label("green") == [(None, "green")]


def test_streamed_deltas_equal_batch(spark, tmp_path):
    rows = [("s", "c", i, v, v * 2) for i, v in enumerate([60, 120, 100, 135])]
    schema = "session_ref string, counter string, pos long, input_tokens long, output_tokens long"
    for i, row in enumerate(rows):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = stream_usage_deltas(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    found = {r.pos: r.delta_input for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {0: 60, 1: 60, 2: 0, 3: 15}


def test_tool_result_pairs_with_latest_call(spark):
    rows = [("tool_call", 0), ("tool_result", 1), ("tool_call", 2), ("tool_result", 3)]
    atoms = complete(
        spark.createDataFrame([("src", "s", "c", kind, pos, f"a{pos}") for kind, pos in rows], "source_id string, session_ref string, call_id string, content_kind string, pos long, atom_id string"), ATOM
    )
    assert {(r.from_atom_id, r.to_atom_id) for r in atom_ops.edges_tool_result(atoms).collect()} == {("a1", "a0"), ("a3", "a2")}


def test_equal_rows_are_numbered_over_ranges(spark):
    from turnwise.functions.ordered import ranged, with_position

    rows = spark.createDataFrame([("k", 5)] * 3000 + [("k", None)] * 10, "key string, t long").repartition(4)
    assert ranged(rows, ["key"], ["t"]).groupBy("_range").count().agg(F.max("count")).first()[0] < 1500
    placed = with_position(rows, ["key"], ["t"], "pos").collect()
    assert sorted(r.pos for r in placed) == list(range(3010)) and all(r.pos < 10 for r in placed if r.t is None)
