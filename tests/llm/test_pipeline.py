"""The corpus pipeline: each stage against a plain version of it, and the whole run against its stages."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from turnwise.llm import simhash
from turnwise.llm.mixing import mixed
from turnwise.llm.sharding import SHARDS, TABLE_SIZE, filled_table

#: Names that the stages use for what they add, which documents may have too.
NAMES = ["id", "digest", "_digest", "copies", "_copies", "left", "copy", "row", "first_id", "first_digest", "hit_id", "hit_digest", "_id", "lang_pred", "score", "slot", "size", "place"]
WORDS = {
    "en": "the quick brown fox and with house over there thing should water", "de": "der schnelle braune fuchs und mit haus über dort ding sollte wasser",
    "fr": "le rapide renard brun et avec maison sur là chose devrait eau", "es": "el rápido zorro marrón y con casa sobre allí cosa debería agua",
}
PASSAGE = "seven lazy painters carried eleven heavy wooden ladders through twelve muddy gardens before sunrise"


def _documents(seed=0, count=160):
    rng, rows = random.Random(seed), []
    for k in range(count):
        lang = rng.choice(list(WORDS))
        text = " ".join(rng.choice(WORDS[lang].split()) + rng.choice(["", "", "s", "en"]) for _ in range(rng.randint(20, 60)))
        if k % 17 == 3:
            text = text + " " + PASSAGE.upper() + "."
        if k % 13 == 5 and rows:
            text = rows[-1][1]
        rows.append((k, text, lang if k % 5 else None, rng.choice(["web", "books", "code", None])))
    rows += [(None, None, None, None), (900, "", "en", "web"), (901, "123 456 !!", "en", "web"), (None, rows[4][1], "en", "web"), (None, rows[4][1], "en", "web"), (7, "another text of number seven in english with the house", "en", "web"), rows[9], rows[9]]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    frame = spark.createDataFrame(_documents(), "doc_id long, text string, lang string, source string")
    frame.withColumns({n: F.lit(n) for n in NAMES}).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([("b1", PASSAGE), ("b2", None)], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def _rows(frame):
    return [tuple(r[c] for c in ("doc_id", "text", "lang", "source")) for r in frame.collect()]


def _key(row):
    return (row[0] is None, row[0] or 0, hashlib.md5((row[1] or "").encode()).digest() if row[1] is not None else b"")


def test_every_stage_in_turn(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "benchmark", "mix", "shard"]

    found = stages["language"](spark, docs, folder)
    assert found.columns == docs.columns
    kept, given = Counter(_rows(found)), Counter(_rows(docs))
    lettered = Counter({r: n for r, n in given.items() if r[1] and any(c.isalpha() for c in r[1])})
    # Nothing without a letter stays, rows that are equal stay or go together, and hardly a plain text goes.
    assert all(n == given[r] for r, n in kept.items()) and not kept - lettered and sum(kept.values()) > 0.95 * sum(lettered.values())
    docs = docs.filter(F.col("text").rlike(r"\p{L}"))

    # Near duplicates: union of all pairs within the radius, the first by id and text of each group stays.
    rows = _rows(docs)
    prints = [simhash.fingerprint(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= simhash.RADIUS and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    first = {}
    for g, r in zip(group, rows):
        first[g] = min(first.get(g, r), r, key=_key)
    want = Counter()
    for r in first.values():
        want[r] = 1 if r[0] is None else rows.count(r)
    found = stages["near_duplicates"](spark, docs, folder)
    assert found.columns == docs.columns and Counter(_rows(found)) == want

    found = stages["benchmark"](spark, docs, folder)
    words = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    windows = {tuple(words(PASSAGE)[i : i + 10]) for i in range(len(words(PASSAGE)) - 9)}
    hit = lambda t: any(tuple(words(t)[i : i + 10]) in windows for i in range(len(words(t))))
    assert found.columns == docs.columns and Counter(_rows(found)) == Counter(r for r in rows if not hit(r[1]))
    assert any(hit(r[1]) for r in rows)

    copies = Counter()
    for r in mixed(docs).collect():
        copies[r.doc_id, r.source, bytes(r.text_digest)] += r.copies
    found = stages["mix"](spark, docs, folder)
    told = Counter((r[0], r[3], hashlib.md5(r[1].encode()).digest()) for r in _rows(found))
    assert found.columns == docs.columns and told == Counter({k: n for k, n in copies.items() if n})

    table, found = filled_table(), stages["shard"](spark, docs, folder)
    for r in found.collect():
        key = str(r.doc_id) if r.doc_id is not None else "text:" + hashlib.md5(r.text.encode()).hexdigest()
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % TABLE_SIZE
        assert (r.slot, r.shard) == (slot, SHARDS[table[slot]])
    assert found.count() == len(rows)


def test_run_is_its_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    told = lambda frame: Counter(tuple(r[c] for c in ("doc_id", "text", "source", "slot", "shard")) for r in frame.collect())
    assert told(corpus_pipeline.run(spark, folder)) == told(docs) and docs.count() > 50


def test_no_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_documents_that_are_all_null(spark, folder):
    docs = spark.createDataFrame([(None, None, None, None)] * 3, "doc_id long, text string, lang string, source string")
    kept = {name: stage(spark, docs, folder).count() for name, stage in corpus_pipeline.STAGES}
    assert kept == {"language": 0, "near_duplicates": 1, "benchmark": 3, "mix": 0, "shard": 3}
