"""Hard negatives against all pairs, and the tree against full scans."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from turnwise.llm import gnat

SCHEMA = "vec_id long, embedding array<float>, label int, score long, region int, low double, rank int, anchor_id long"


def _plain(rows):
    """All anchors against all rows, in whole numbers of any size."""
    kept = []
    for vec_id, x, label, *_ in rows:
        if vec_id is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        # 32-bit floats, as the table holds them.
        kept.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * float(np.float32(v))) for v in x]))
    anchors = {}
    for vec_id, label, x in kept:
        if vec_id % 50 == 0:
            anchors[vec_id] = min(anchors.get(vec_id, (label, x)), (label, x))
    out = []
    for anchor, (label, a) in anchors.items():
        scored = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(p * q for p, q in zip(a, x)))), i, own) for i, own, x in kept if len(x) == len(a) and (i != anchor or own != label))
        for p, positive, _ in [s for s in scored if s[2] == label][:5]:
            fits = [s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p]
            out += [(anchor, positive, rank, i, -p, -n) for rank, (n, i, _) in enumerate(fits[:3], 1)]
    return Counter(out)


def _told(spark, rows, parts=4):
    given = spark.createDataFrame([(*r, 1, 2, 0.5, 3, 4) for r in rows], SCHEMA).repartition(parts)
    return Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in gnat.hard_negatives(given).collect())


def _clustered(rng, count, length=6):
    centres = [[rng.gauss(0, 1) for _ in range(length)] for _ in range(12)]
    return [(k, [c + rng.gauss(0, 0.15) for c in rng.choice(centres)], rng.randrange(4)) for k in range(count)]


@pytest.mark.parametrize("chunk, regions, block", [(4096, 64, 8192), (300, 3, 7)])
def test_all_pairs(spark, chunk, regions, block, monkeypatch):
    monkeypatch.setattr(gnat, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(gnat, "REGIONS", regions)
    monkeypatch.setattr(gnat, "BLOCK_ANCHORS", block)
    rows = _clustered(random.Random(1), 2600)
    want = _plain(rows)
    assert len(want) > 500 and _told(spark, rows) == want


def test_odd_rows(spark):
    rng = random.Random(2)
    rows = _clustered(rng, 400, 3)
    rows += [(None, [1.0, 1.0, 1.0], 1), (1000, None, 1), (1050, [1.0, None, 1.0], 1), (1100, [float("nan"), 1.0, 1.0], 1), (1150, [float("inf"), 1.0, 1.0], 2), (1200, [1.0, 1.0, 1.0], None)]
    rows += [(2000 + k, [], k % 2) for k in range(0, 200, 25)] + [(3000 + k, [rng.gauss(0, 1), 1.0], k % 3) for k in range(0, 300, 10)]
    # Equal vectors and scores, zeros, a repeated candidate, and an anchor with two labels.
    rows += [(4000 + k, [1.0, 1.0, 0.0], k % 5) for k in range(120)] + [(4200 + k, [0.0, 0.0, 0.0], k % 2) for k in range(60)]
    rows += [(4001, [1.0, 1.0, 0.0], 1)] * 3 + [(4050, [1.0, 0.5, 0.0], 2), (4050, [1.0, 0.5, 0.0], 2)]
    assert _told(spark, rows) == _plain(rows)


def test_scores_beyond_doubles(spark):
    rng = random.Random(3)
    rows = [(k, [rng.uniform(-1, 1) * 10.0 ** rng.randint(3, 9) for _ in range(4)], k % 3) for k in range(160)]
    assert _told(spark, rows) == _plain(rows)


def test_a_vector_of_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(gnat, "CHUNK_ROWS", 200)
    rng = random.Random(4)
    rows = [(k, [0.5] * 5 if k % 3 == 0 else [rng.gauss(0, 0.5) for _ in range(5)], rng.randrange(3)) for k in range(1800)]
    given = spark.createDataFrame([(*r, 1, 2, 0.5, 3, 4) for r in rows], SCHEMA)
    index = gnat.build(gnat.participants(given))
    sizes = [len(gnat.pickle.loads(r.tree)[0]) for r in index.trees.collect()]
    assert sum(sizes) == 1800 and max(sizes) < 300
    assert _told(spark, rows) == _plain(rows)


def test_nothing(spark):
    assert not _told(spark, []) and not _told(spark, [(50, None, 1)]) and not _told(spark, [(50, [1.0], 1)])


@pytest.mark.parametrize("seed", range(4))
def test_tree_rules_out_only_what_cannot_match(seed, monkeypatch):
    monkeypatch.setattr(gnat, "LEAF_ROWS", 16)
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 300, (20, 4))
    rows = np.floor(centres[rng.integers(0, 20, 3000)] + rng.normal(0, 12, (3000, 4)))
    space = gnat.Space(float((rows**2).sum(1).max()))
    tree = gnat.grown(rows, space)
    ids, labels, anchors = np.arange(3000), np.zeros(3000, int), rows[:40]
    scores = anchors @ rows.T
    top = scores.max(1)
    low, high = np.stack([top * 0.8, top * 0.3], 1), np.stack([top * 0.9, top * 0.32], 1)
    hunt = gnat.Hunt(space, np.arange(40) - 100, np.ones(40, int), anchors, low, high, False, 3)
    hunt.walk(tree, rows, ids, labels, np.arange(40))
    for a in range(40):
        for w in range(2):
            fits = sorted((-scores[a, i], i) for i in range(3000) if low[a, w] <= scores[a, i] <= high[a, w])[:3]
            got = [(-s, i) for s, i in zip(hunt.scores[a, w], hunt.found[a, w]) if s > -np.inf]
            assert got == fits
    assert hunt.looked < 0.35 * 40 * 3000
