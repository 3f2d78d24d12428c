import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from turnwise.llm import langid, sharding, token_counts, token_files, topk, toxicity
from turnwise.llm.common import held_out, prefix_sums, work_dir
from turnwise.llm.encoding import Encoder
from turnwise.llm.mixing import emit, mixed

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(str(WORDS))


def test_prefix_sums(spark):
    rows = [(random.Random(k).choice(["a", "b", None]), k * 7919 % 1000, k % 13) for k in range(1000)]
    got = prefix_sums(spark.createDataFrame(rows, "g string, o long, v long"), ["g"], [F.col("o")], "sums", s=F.col("v")).collect()
    run, want = defaultdict(int), {}
    for g, o, v in sorted(rows, key=lambda r: r[1]):
        want[g, o] = run[g]
        run[g] += v
    assert {(r.g, r.o): r.s for r in got} == want


def test_pieces_are_the_library_s(library):
    rng = random.Random(4)
    chars = [*map(chr, range(0x180)), *"ſİΣς́’中😀 \xa0\x85"]
    parts = ["'s", "'ll", "'", "S", "<|endoftext|>", "<|", "é", "²", "12", "  ", "\n", "µ", "ª", "\xad", "ß", "ŉ"]
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 50))) for _ in range(3000)] + ["".join(rng.choice(parts) for _ in range(9)) for _ in range(3000)]
    coder = Encoder(str(WORDS))
    assert coder.by_piece
    want = [np.asarray(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert coder.packed(texts) == want and coder.packed(texts) == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(name):
    assert [len(x) for x in Encoder(str(public_tokenizers.path(name))).packed(["", "Hello world"])][0] == 0


def test_token_counts_and_cache(spark, odd_documents, no_documents, library, monkeypatch):
    cache = work_dir(spark, "test-cache")
    want = Counter((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in odd_documents.collect())
    first = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(odd_documents, str(WORDS), cache).collect())
    stored = spark.read.parquet(cache).count()
    again = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(odd_documents, str(WORDS), cache).collect())
    assert first == again == want and spark.read.parquet(cache).count() == stored
    monkeypatch.setattr(token_counts, "BROADCAST_DIGESTS", 0)
    more = odd_documents.unionByName(odd_documents.limit(1).withColumn("text", F.lit("quite new")).withColumn("doc_id", F.lit(99)))
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(more, str(WORDS), cache).collect()}[99] == 2
    assert spark.read.parquet(cache).count() == stored + 1
    assert token_counts.token_counts(no_documents, str(WORDS), cache).count() == 0


def test_token_files(spark, odd_documents, no_documents, library, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_BYTES", 64)
    files = token_files.write_token_files(odd_documents, str(WORDS), work_dir(spark, "test-ids"))
    rows = sorted(odd_documents.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    want, start = [], 0
    for r in rows:
        ids = np.asarray([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((r.doc_id, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = token_files.token_layout(files).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(want)
    ends = sorted((r.start, r.start + r.n_tokens, r.doc_id is None, r.doc_id or 0) for r in got)
    assert ends[0][0] == 0 and ends[-1][1] == start and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    assert [e[2:] for e in ends] == sorted(e[2:] for e in ends)
    some = token_files.read_token_files(files, [2, 6]).collect()
    assert sorted(r.doc_id for r in some) == [2, 6] and len({r.doc_id: r.ids for r in some}[2]) % 4 == 0
    empty = token_files.write_token_files(no_documents, str(WORDS), work_dir(spark, "test-ids"))
    assert token_files.token_layout(empty).count() == 0


def test_frames_are_independent_and_checked(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_BYTES", 100)
    uri = f"file://{tmp_path}/a.zst"
    writer = token_files.ShardWriter(uri)
    docs = {k: struct.pack(f"<{k + 1}I", *range(k + 1)) for k in range(50)}
    for k, ids in docs.items():
        writer.add(k, ids)
    writer.close()
    reader = token_files.ShardReader(uri)
    assert {d: i for d, _, i in reader.documents()} == docs
    read = []
    monkeypatch.setattr(reader, "frame", lambda k, f=reader.frame: read.append(k) or f(k))
    assert list(reader.documents([30]))[0][2] == docs[30] and len(read) == 1
    import zstandard

    raw = (tmp_path / "a.zst").read_bytes()
    assert zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read() == b"".join(docs.values())
    (tmp_path / "a.zst").write_bytes(raw[:6] + bytes([raw[6] ^ 1]) + raw[7:])
    with pytest.raises(Exception):
        list(token_files.ShardReader(uri).documents())


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vectors = {k: np.float32(rng.integers(-3, 4, 5) / 4) for k in range(400)}
    rows = [(k, [float(x) for x in v]) for k, v in vectors.items()] + [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0]), (402, [float("nan")] * 5), (403, [float("inf")] * 5), (None, [1.0] * 5), (500, [1.0, 2.0]), (600, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).repartition(3)
    whole = {k: np.floor(1024 * v.astype(float)).astype(int) for k, v in vectors.items()}
    want = []
    for q in range(0, 400, 50):
        scores = sorted((-int(whole[q] @ whole[c]), c) for c in whole if c != q)[:10]
        want += [(q, r, c, -s) for r, (s, c) in enumerate(scores, 1)]
    assert sorted(map(tuple, topk.top_k(table, 50).collect())) == want
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(topk, "TILE_ROWS", 7)
    assert sorted(map(tuple, topk.top_k(table, 50).collect())) == want
    assert topk.top_k(table.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1e30, 1.0]), (0, [1e30, 1.0]), (1, [1e30, 1.0]), (2, [-1e30, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(few).orderBy("rank").collect()] == [(0, 1, 1, topk.LONGEST), (0, 2, 2, -topk.LONGEST - 1)]


def test_mix_of_odd_rows(odd_documents, no_documents):
    rows = mixed(odd_documents).collect()
    again = mixed(odd_documents.repartition(5)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again)) and len(rows) == odd_documents.count()
    total = sum(r.size for r in rows)
    targets = {r.source: (r.target, r.source_size) for r in rows}
    assert all(0 <= r.copies <= 2 and r.taken == r.copies * r.size for r in rows)
    assert abs(sum(t for t, _ in targets.values()) - 1.5 * total) < 1e-6 and all(t <= 2 * s for t, s in targets.values())
    assert mixed(no_documents).count() == 0
    assert emit(odd_documents, mixed(odd_documents)).columns == odd_documents.columns


def test_mix_comes_near_targets(spark):
    rng = random.Random(1)
    docs = [(k, "w " * int(rng.paretovariate(1.2) * 3), f"s{rng.choice('aaaaabc')}") for k in range(4000)]
    rows = mixed(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    taken, targets, largest = Counter(), {}, Counter()
    for r in rows:
        taken[r.source] += r.taken
        targets[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - t) <= 2 * largest[s] for s, t in targets.items())


def test_table_is_even_and_stable(spark, odd_documents, no_documents):
    shards = tuple(f"n{k}" for k in range(10))
    table = sharding.filled_table(shards, 1009)
    counts = Counter(table)
    assert set(counts) == set(range(10)) and max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.filled_table(shards[:9], 1009)
    assert sum(a != b for a, b in zip(table, fewer) if a != 9) < 0.25 * 1009
    placed = sharding.placed(odd_documents)
    assert placed.count() == odd_documents.count() and placed.columns[-2:] == ["slot", "shard"]
    assert placed.filter("shard IS NULL").isEmpty() and sharding.placed(no_documents).count() == 0
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    folder = work_dir(spark, "test-shards")
    sharding.write_shards(odd_documents.select("doc_id", "text"), folder, 2)
    assert spark.read.parquet(folder).count() == odd_documents.count()


def _accuracy(rows):
    return sum(rows) / max(len(rows), 1)


def test_language_held_out(spark, odd_documents, no_documents):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs)
    found = langid.identified(docs, model).withColumn("out", held_out(F.col("doc_id"))).filter("out").collect()
    assert _accuracy([r.lang == r.lang_pred for r in found]) > 0.97
    assert all(0 <= r.score <= 1 for r in found)
    odd = langid.identified(odd_documents, model).collect()
    assert len(odd) == odd_documents.count() and all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in odd)
    assert langid.identified(odd_documents, langid.train(no_documents)).filter("lang_pred <> 'und'").isEmpty()
    assert langid.identified(no_documents, langid.train(odd_documents)).count() == 0


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(4000, 3))
    p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    labels = np.array([rng.choice(3, p=row) for row in p])
    assert 0.8 < langid.fit_temperature(logits, labels) < 1.25 and 4 < langid.fit_temperature(logits * 5, labels) < 6.25


def test_toxicity_held_out(spark, odd_documents, no_documents):
    rng = random.Random(6)
    common, bad = ["".join(rng.choice("abdeginorst") for _ in range(rng.randint(2, 9))) for _ in range(800)], ["vilest", "grobian", "schuft", "lumpenkerl"]
    docs, labels = [], []
    for k in range(1200):
        toxic = k % 6 == 0
        words = [rng.choice(common) for _ in range(rng.randint(5, 200))]
        if toxic:
            words += [rng.choice(bad) + rng.choice(["", "s", "en"]) for _ in range(rng.randint(2, 5))]
        rng.shuffle(words)
        docs.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    known = spark.createDataFrame([*labels, (None, 1), (5, None), (1, 0)], "doc_id long, toxic int")
    scorer = toxicity.train(table, known)
    found = toxicity.scored(table, scorer).withColumn("out", held_out(F.col("doc_id"))).filter("out").collect()
    assert _accuracy([(r.doc_id % 6 == 0) == (r.predicted == 1) for r in found]) > 0.97
    odd = toxicity.scored(odd_documents, scorer).collect()
    assert len(odd) == odd_documents.count() and all(0 <= r.score <= 1 and r.predicted == 0 for r in odd)
    assert toxicity.scored(odd_documents, toxicity.train(odd_documents, known.limit(0))).filter("predicted = 1").isEmpty()
    assert toxicity.scored(no_documents, toxicity.train(no_documents, known)).count() == 0


@pytest.mark.parametrize("n_toxic, n_clean, leak", [(8, 40, 0.0), (24, 24, 0.0), (150, 900, 0.08), (3, 40, 0.0)], ids=["few", "balanced", "common", "three"])
def test_toxicity_of_few_balanced_and_common_words(spark, n_toxic, n_clean, leak):
    rng = random.Random(11)
    common, bad = ["".join(rng.choice("abdeginorst") for _ in range(rng.randint(3, 9))) for _ in range(600)], ["vilest", "grobian", "schuft"]
    docs = []
    for k in range(4 * (n_toxic + n_clean)):
        toxic = k % (n_toxic + n_clean) < n_toxic
        words = [rng.choice(common) for _ in range(rng.randint(20, 80))]
        # Each toxic text has the three words; where they leak, one of them is in a clean text now and then.
        words += bad if toxic else [w for w in bad if rng.random() < leak]
        docs.append((k, " ".join(rng.sample(words, len(words))), int(toxic)))
    table = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    rows = toxicity.scored(table, toxicity.train(table, table.filter(f"doc_id < {n_toxic + n_clean}").select("doc_id", "toxic"))).filter(f"doc_id >= {n_toxic + n_clean}").collect()
    caught, spared = [r.predicted == 1 for r in rows if r.toxic], [r.predicted == 0 for r in rows if not r.toxic]
    assert _accuracy(caught) > 0.9 and _accuracy(spared) > 0.9


def test_toxicity_voters_of_one_document_a_side():
    rows = [np.array([1, 2, 3], np.int32), np.array([1, 4], np.int32)]
    assert set(toxicity.choose_voters(np.array([True, False]), rows)) <= {2, 3} and len(toxicity.choose_voters(np.array([True, False]), rows))
    assert not len(toxicity.choose_voters(np.array([True, True]), rows))


def test_emit_of_null_and_shared_ids_meets_the_mix(spark):
    rows = [(k % 3 or None, f"w{k} " * (k % 7 + 1), f"s{k % 4}") for k in range(120)] + [(5, "same text", "s0")] * 9
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixed(docs)
    want = Counter()
    for r in mix.collect():
        want[r.source, r.doc_id, bytes(r.text_digest)] += r.copies
    got = Counter((r.source, r.doc_id, hashlib.md5(r.text.encode()).digest()) for r in emit(docs, mix).collect())
    assert got == +want


def test_rows_without_an_id_spread_over_files(spark):
    rows = [(None if k % 12 else k, f"text {k % 50}" if k % 3 else "the same text") for k in range(4000)]
    folder = work_dir(spark, "test-ids")
    orphan = Path(folder) / "ids-00000000-00000-lost.zst"
    orphan.parent.mkdir(parents=True)
    orphan.write_bytes(b"half a file")
    files = token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), str(WORDS), folder)
    sizes = [r.n for r in token_files.read_token_files(files).groupBy("shard", "part").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 8 and sum(sizes) == 4000 and max(sizes) < 1000
    assert not orphan.exists() and len(list(Path(folder).glob("ids-*"))) == 8
    assert token_files._per_file(files).rdd.getNumPartitions() == 8


def test_pieces_beyond_sixteen_bytes_and_full_tables(library, monkeypatch):
    from turnwise.llm import encoding

    monkeypatch.setattr(encoding, "REMEMBERED", 300)
    rng = random.Random(9)
    words = ["".join(rng.choice("aeiouéßñstr") for _ in range(rng.randint(1, 30))) for _ in range(900)]
    texts = [" ".join(rng.choice(words) + rng.choice(["", "'s", "'re", "'really", "''t", ".", "!'d"]) for _ in range(40)) for _ in range(200)]
    texts[7:7] = ["", "中文 plain", "a<|endoftext|>b", None]
    coder = Encoder(str(WORDS))
    for first in range(0, len(texts), 16):
        part = texts[first : first + 16]
        ids, counts = coder.encoded(pa.array(part))
        want = [library.encode(t or "", add_special_tokens=False).ids for t in part]
        assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]


def test_hot_keys_join_without_being_gathered(spark, monkeypatch):
    from turnwise.llm import common

    monkeypatch.setattr(common, "HOT_SHARE", 10)
    facts = spark.createDataFrame([("hot" if k % 2 else f"k{k % 300}" if k % 5 else None, k) for k in range(3000)], "key string, v long")
    lookup = facts.filter("key IS NOT NULL AND key <> 'k2'").groupBy("key").agg(F.count("*").alias("n"), F.max("v").alias("most"))
    for how in ("inner", "left"):
        want = facts.join(lookup.drop("n"), "key", how)
        assert Counter(map(tuple, common.join_split(facts, lookup, "key", "n", 3000, how).select("key", "v", "most").collect())) == Counter(map(tuple, want.select("key", "v", "most").collect()))


def test_samples_of_repeated_rows_are_bounded(spark, monkeypatch):
    """30,000 equal rows without an id are one row of a sample; rows that share a sampled id are one, too."""
    rows = [(None, "ein und derselbe text", "de")] * 30_000 + [(k, f"text number {k} of many", "en") for k in range(400)]
    seen = []
    monkeypatch.setattr(langid, "materialize", lambda df, label: seen.append(langid_materialize(df, label)) or seen[-1])
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4))
    assert seen[-1].filter("lang = 'de'").count() == 1 and seen[-1].count() <= 1.1 * langid.SAMPLE_PER_LANGUAGE + 2
    assert model.languages == ("de", "en")

    same = [(1, f"bad{k % 7} word number {k}", 1) for k in range(30_000)] + [(k, f"fine word {k}", 0) for k in range(2, 300)]
    docs = spark.createDataFrame(same, "doc_id long, text string, toxic int").repartition(4)
    chosen = docs.select("doc_id", F.col("toxic").cast("double").alias("aim")).distinct()
    aims, features, _ = toxicity._features_of(docs.select("doc_id", "text"), chosen)
    assert len(aims) == len(features) <= 299


langid_materialize = langid.materialize


def test_equal_rows_spread_over_ranges(spark, monkeypatch):
    from turnwise.llm import common

    seen = []
    write = common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, label: seen.append(write(df, label)) or seen[-1])
    rows = spark.createDataFrame([("g", 1)] * 4000, "g string, o long").repartition(4)
    got = common.prefix_sums(rows, ["g"], [F.col("o")], "equal", n=F.lit(1))
    assert sorted(r.n for r in got.collect()) == list(range(4000))
    assert seen[0].groupBy("_range").count().agg(F.max("count")).first()[0] < 1500
