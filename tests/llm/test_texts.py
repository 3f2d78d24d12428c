import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from turnwise.llm import decontaminate as dec
from turnwise.llm import simhash
from turnwise.llm.components import connected_components
from turnwise.llm.quotes import reply_conversations

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_decontaminate(docs, items):
    cut = lambda t: re.findall(dec.WORDS_SQL, (t or "").translate(FOLD))
    windows = {}
    for item, text in items:
        w = cut(text)
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, found = cut(text), set(), set()
        for n in range(1, 11):
            for s in range(len(w) - n + 1):
                items_here = windows.get(tuple(w[s : s + n]))
                if items_here:
                    hit |= set(range(s, s + n))
                    found |= {str(i) for i in items_here if i is not None}
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_decontaminate_against_plain_version(spark, odd_documents):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(12)] + ["É", "中文", "a_b", "X"]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 9, 10, 11, 30])))) for k in range(60)]
    items += [(60, None), (None, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (61, items[5][1]), (61, items[5][1])]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 80)))) for k in range(150)]
    docs += [(200 + k, "zz " + (text or "") + ", yy") for k, (_, text) in enumerate(items)]
    docs += [(None, None), (400, ""), (401, items[-1][1] + " " + items[-1][1])]
    got = dec.decontaminate(
        spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_hit", F.lit(1)).repartition(3),
        spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit("x")),
    ).collect()
    assert sorted(map(tuple, got), key=str) == plain_decontaminate(docs, items)


def test_decontaminate_blocks_and_odd_rows(spark, odd_documents, no_documents, monkeypatch):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog near the river bank"), (2, "ohne Nummer")], "item_id long, text string")
    whole = sorted(map(tuple, dec.decontaminate(odd_documents, items).collect()), key=str)
    monkeypatch.setattr(dec, "BLOCK_FINGERPRINTS", 1)
    assert sorted(map(tuple, dec.decontaminate(odd_documents, items).collect()), key=str) == whole
    assert len(whole) == odd_documents.count()
    assert {r[0] for r in whole if r[5]} == {1, 2, None}
    assert dec.decontaminate(no_documents, items).count() == 0
    assert not any(r.contaminated for r in dec.decontaminate(odd_documents, items.limit(0)).collect())


def test_winnowing_keeps_a_gram_of_every_window():
    rng = np.random.default_rng(5)
    grams = rng.integers(1, 9, 400).astype(np.uint64)
    kept = set(dec.winnow(grams, np.ones(395, bool), 6).tolist())
    assert all(kept & set(range(k, k + 6)) for k in range(395))


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    ids = list(prints)
    root = {k: k for k in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {k: find(k) for k in ids}


def test_covering_masks_miss_no_pair():
    masks = simhash.covering_masks()
    assert len(masks) == 31 and all(30 <= m.bit_count() <= 36 for m in masks)
    rng = random.Random(1)
    for _ in range(20_000):
        flipped = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(m & flipped == 0 for m in masks)


@pytest.mark.parametrize("bucket", [256, 2])
def test_links_against_all_pairs(spark, bucket):
    rng = random.Random(7)
    prints = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 12])):
            x ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5, 6])))
            prints.add(x)
    signed = {(x - (1 << 64) if x >> 63 else x): x for x in prints}
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r.node: r.root for r in connected_components(simhash.fingerprint_links(df, bucket)).collect()}
    want = plain_groups(signed)
    assert {k: got.get(k, k) for k in signed} == want


def test_near_duplicates_of_odd_rows(odd_documents, no_documents):
    rows = simhash.near_duplicates(odd_documents).collect()
    texts = {(r.doc_id, r.text) for r in odd_documents.collect()}
    assert len(rows) == odd_documents.count()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert all(by_id[i].fingerprint == f"{plain_fingerprint(t):016x}" for i, t in texts if i is not None)
    assert by_id[2].component_id == 1 and by_id[3].component_id == by_id[4].component_id == by_id[5].component_id == 3
    assert sorted(str(r.component_id) for r in rows if r.doc_id is None) == ["3", "None"]
    assert simhash.near_duplicates(no_documents).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).select((F.col("id") * 7 % 301).alias("a"), ((F.col("id") + 1) * 7 % 301).alias("b"))
    assert {r.root for r in connected_components(edges).collect()} == {0}


def test_reply_order(spark):
    rows = [
        (1, 0, "u", "Hello world.\nHow are you?"), (1, 1, "a", "Fine thanks."), (1, 2, "u", "On Monday Bob wrote:\n> Hello world.\n> How are you?\n\nI am well."),
        (1, 3, "a", "> > How are you?\n> I am well.\nGreat"), (1, 4, "u", "> Fine thanks.\nok"), (1, 4, "u", "> Fine thanks.\nok"), (1, 5, "a", ">>> never said\n\nOn we go wrote:\nyes"),
        (2, 0, "u", None), (2, 1, "a", "> nothing known\nx"), (None, None, None, ""), (3, None, "u", "a > b"),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("body", F.lit(1)).withColumn("pos", F.lit(2))
    got = {(r.conv_id, r.turn): (r.position, r.depth, r.parent_turn, r.linked, r.n_passages, r.n_linked, r.body) for r in reply_conversations(table).collect()}
    assert got == {
        (1, 0): (0, 0, None, False, 0, 0, "Hello world.\nHow are you?"), (1, 1): (1, 1, 0, False, 0, 0, "Fine thanks."), (1, 4): (2, 2, 1, True, 1, 1, "ok"),
        (1, 5): (3, 3, 4, False, 1, 0, "On we go wrote:\nyes"), (1, 2): (4, 1, 0, True, 1, 1, "I am well."), (1, 3): (5, 2, 2, True, 2, 2, "Great"),
        (2, 0): (0, 0, None, False, 0, 0, ""), (2, 1): (1, 1, 0, False, 1, 0, "x"), (None, None): (0, 0, None, False, 0, 0, ""), (3, None): (0, 0, None, False, 0, 0, "a > b"),
    }
    assert reply_conversations(table.limit(0)).count() == 0


def test_walk_against_recursion(spark):
    from turnwise.llm.quotes import reply_order

    rng = random.Random(2)
    parents = [None] + [rng.choice([None, *range(k)]) for k in range(1, 60)]
    children = {}
    for k, p in enumerate(parents):
        children.setdefault(p, []).append(k)
    want = []

    def walk(k, depth):
        want.append((k, depth))
        for c in children.get(k, []):
            walk(c, depth + 1)

    for k in children[None]:
        walk(k, 0)
    got = reply_order(spark.createDataFrame([("c", k, p) for k, p in enumerate(parents)], "conv string, pos long, parent long")).orderBy("position").collect()
    assert [(r.pos, r.depth) for r in got] == want


def test_reply_order_against_sql(spark):
    """Random threads whose messages quote, at several levels, whole earlier messages, single lines of them, or nothing known."""
    import duckdb

    from turnwise.llm.catalog_text import REPLY_ORDER_SQL

    rng = random.Random(11)
    words = ["alpha", "Beta", "gamma,", "delta", "Été", "zeta!"]
    rows = []
    for conv in range(40):
        own = []
        for turn in range(rng.randint(1, 12)):
            lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 3))]
            text = []
            if own and rng.random() < 0.6:
                for level in rng.sample([1, 2, 3], rng.randint(1, 2)):
                    text += ["On some day X wrote:"] if rng.random() < 0.5 else []
                    text += [">" * level + rng.choice(["", " "]) + x for x in (rng.choice(own) if rng.random() < 0.8 else ["never said"])]
                    text += rng.choice([[], [""]])
            own.append(lines)
            rows.append((conv, turn, rng.choice("ua"), "\n".join(text + lines)))
    rows += rows[:5]
    want_db = duckdb.connect()
    want_db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    want_db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    cursor = want_db.execute(REPLY_ORDER_SQL)
    names = [d[0] for d in cursor.description]
    want = sorted(cursor.fetchall())
    got = reply_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select(*names)
    assert sorted(map(tuple, got.collect())) == want
    assert any(row[names.index("n_linked")] for row in want)


LEAK = "one two three four five six seven eight nine ten eleven twelve"


@pytest.fixture
def shared_ids(spark):
    rows = [(None, LEAK), (None, "a clean text without a number"), (7, LEAK + " more"), (7, "another clean text of seven"), (8, None), (None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_decontaminate_null_and_shared_ids(spark, shared_ids):
    items = spark.createDataFrame([(1, LEAK)], "item_id long, text string")
    got = dec.decontaminate(shared_ids, items).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.contaminated) for r in got) == sorted([("None", 12, 12, True), ("None", 6, 0, False), ("7", 13, 12, True), ("7", 5, 0, False), ("8", 0, 0, False), ("None", 0, 0, False)])
    kept = dec.clean(shared_ids, items)
    assert kept.columns == shared_ids.columns and sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [(None, "a clean text without a number"), (7, "another clean text of seven"), (8, None), (None, None)]))


def test_keep_one_of_null_and_shared_ids(spark, shared_ids, odd_documents, no_documents):
    many = shared_ids.union(shared_ids.filter("doc_id IS NULL")).union(spark.createDataFrame([(3, LEAK.upper())], "doc_id long, text string"))
    kept = sorted(map(str, map(tuple, simhash.keep_one(many).collect())))
    assert kept == sorted(map(str, [(3, LEAK.upper()), (None, "a clean text without a number"), (7, LEAK + " more"), (7, "another clean text of seven"), (8, None)]))
    assert sorted((r.doc_id for r in simhash.keep_one(odd_documents).collect()), key=str) == sorted([1, 1, 3, 6, 7, 8, None], key=str)
    assert simhash.keep_one(no_documents).count() == 0


def test_rewrapped_paragraphs_link(spark):
    """A quote of two paragraphs, wrapped anew and marked, links to its message by its paragraphs; so it does in SQL."""
    import duckdb

    from turnwise.llm.catalog_text import REPLY_ORDER_SQL

    said = "Intro line.\n\nThe first paragraph has several words in it.\n\nThe second one has some more words.\n\nBye."
    quote = "> The first paragraph has\n> several words in it.\n>\n> The second one\n> has some more words.\nI agree."
    rows = [(1, 0, "u", said), (1, 1, "a", "Something else."), (1, 2, "u", quote)]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    cursor = con.execute(REPLY_ORDER_SQL)
    names = [d[0] for d in cursor.description]
    got = reply_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(cursor.fetchall())
    last = got.filter("turn = 2").first()
    assert last.linked and last.parent_turn == 0 and last.body == "I agree."


def test_very_long_quotes_take_linear_time(spark):
    import time

    def took(lines):
        text = "\n".join(f"> line {k} of a quote" if k % 50 else ">" for k in range(lines))
        rows = spark.createDataFrame([(1, 0, "u", "line 7 of a quote"), (1, 1, "a", text)], "conv_id long, turn long, role string, text string")
        began = time.perf_counter()
        assert reply_conversations(rows).filter("linked").count() == 1
        return time.perf_counter() - began

    took(100)
    short, long = took(8000), took(32_000)
    assert long < 4 * short + 3
