"""Hard negatives from a multiway hyperplane tree with distance ranges.

Vectors are lifted to one length (a further component makes up what a vector lacks to the longest), so that a score is a
distance: the higher the inner product with an anchor, the nearer the vector. A window of scores is then an annulus around
the anchor.

The tree has two parts. At the top, up to REGIONS split points, chosen far apart from a bounded sample, deal every row to
the nearest of them; per pair of a split point and a region the least and greatest distance of all rows of the region is
kept. Regions are dealt into chunks of bounded size, and a task builds the lower levels of a chunk in the same way: split
points, children nearest to them, and the range of distances of every split point to every child, down to small leaves.

An anchor's window rules a region or child out if for some split point the distances that the triangle inequality allows
from its range miss the annulus. Anchors first look where they lie themselves; what they find there narrows their windows
for all other places. Leaves are compared exactly, so ruling out never changes a result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnwise.llm.common import discard, materialize, runs, unit_hash

SCALE, ANCHORS, SHIFTED, LABELS = 256, 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
#: A negative's score in hundredths of the positive's: from, to.
LOW, HIGH = 50, 95
#: Split points at the top, and rows of the sample they are chosen from.
REGIONS, SAMPLE_ROWS = 64, 4096
#: Rows of a chunk at most (less where twice the mean of a region is less, but not below the second), split points of an
#: inner node, rows of a leaf.
CHUNK_ROWS, SMALL_CHUNK, DEGREE, LEAF_ROWS = 4096, 512, 16, 256
#: Anchors that one task holds against a chunk, and at a time.
BLOCK_ANCHORS, TILE_ANCHORS = 8192, 512
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Products and their sums are exact in doubles below this bound.
EXACT = 2.0**53

_HIT = "anchor_id long, slot int, vec_id long, score long"


def participants(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, vector of whole numbers in doubles) of the rows that take part, with every SHIFTED-th label moved on."""
    given, label = embeddings["embedding"].cast("array<double>"), embeddings["label"].cast("int")
    rows = embeddings.select(embeddings["vec_id"].cast("long").alias("vec_id"), label.alias("label"), F.transform(given, lambda x: F.floor(x * SCALE).cast("double")).alias("vector"), given.alias("given"), F.transform(given, lambda x: x * SCALE).alias("scaled"))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("scaled", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    moved = F.when(F.col("vec_id") % SHIFTED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    # Floor gives a long, which ends where doubles have been whole for long.
    whole = F.zip_with("scaled", "vector", lambda s, v: F.when(F.abs(s) < EXACT, v).otherwise(s))
    return rows.filter(fine).select("vec_id", moved.alias("label"), whole.alias("vector"))


# --- the tree ----------------------------------------------------------------------------------------------------------


@dataclass
class Space:
    """Distances between vectors lifted to the squared length ``top``; infinite if products are not exact in doubles."""

    top: float

    @property
    def exact(self) -> bool:
        return self.top < EXACT

    @property
    def slack(self) -> float:
        """More than rounding can move a distance."""
        return 1e-6 * np.sqrt(self.top) + 1e-9

    def lift(self, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.top - np.einsum("ij,ij->i", rows, rows), 0))

    def between(self, points: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Distances of rows (down) to points (across), both lifted."""
        product = rows @ points.T + np.outer(self.lift(rows), self.lift(points))
        return np.sqrt(np.maximum(2 * self.top - 2 * product, 0))

    def to_anchors(self, points: np.ndarray, anchors: np.ndarray) -> np.ndarray:
        return self.of_scores(anchors, anchors @ points.T)

    def of_scores(self, anchors: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Distance from an anchor, which has no lift, to a lifted vector of a given score."""
        squared = np.einsum("ij,ij->i", anchors, anchors)[:, None] + self.top
        return np.sqrt(np.maximum(squared - 2 * scores, 0))


def scores_of(anchors: np.ndarray, rows: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products: doubles that hold whole numbers, or Python's own whole numbers held within 64 bits."""
    if exact:
        return anchors @ rows.T
    whole = lambda m: np.array([[int(x) for x in line] for line in m], object).reshape(m.shape)
    return np.clip(whole(anchors) @ whole(rows).T, LEAST, MOST) if rows.shape[1] else np.zeros((len(anchors), len(rows)), object)


def far_apart(rows: np.ndarray, count: int, space: Space) -> np.ndarray:
    """Up to ``count`` different rows, each the farthest from those chosen before."""
    chosen = [0]
    least = space.between(rows[:1], rows)[:, 0]
    while len(chosen) < count and least.max() > space.slack:
        chosen.append(int(least.argmax()))
        least = np.minimum(least, space.between(rows[chosen[-1:]], rows)[:, 0])
    return rows[chosen]


def split_ranges(distances: np.ndarray, child: np.ndarray, children: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance of each split point (down) to the rows of each child (across)."""
    low, high = np.full((children, distances.shape[1]), np.inf), np.full((children, distances.shape[1]), -np.inf)
    np.minimum.at(low, child, distances)
    np.maximum.at(high, child, distances)
    return low.T, high.T


def possible(to_points: np.ndarray, low: np.ndarray, high: np.ndarray, near: np.ndarray, far: np.ndarray, slack: float) -> np.ndarray:
    """Which anchors (down) may have a row of a child (across) in one of their annuli.

    A row at a distance from ``low`` to ``high`` of a split point is, from an anchor at distance d of the point, no nearer
    than low - d or d - high and no farther than d + high.
    """
    d = to_points[:, :, None]
    least = np.maximum(low[None] - d, d - high[None]).max(1)
    most = (d + high[None]).min(1)
    hit = (near[:, None, :] <= most[:, :, None] + slack) & (far[:, None, :] >= least[:, :, None] - slack)
    return hit.any(2)


def grown(rows: np.ndarray, space: Space, at: np.ndarray | None = None):
    """A tree over rows: a leaf is the array of their places; a node is (split points, low, high, children)."""
    at = np.arange(len(rows)) if at is None else at
    if len(at) <= LEAF_ROWS or not space.exact:
        return at
    sample = rows[at[np.linspace(0, len(at) - 1, 4 * DEGREE).astype(int)]]
    points = far_apart(sample, DEGREE, space)
    distances = space.between(points, rows[at])
    child = distances.argmin(1)
    sizes = np.bincount(child, minlength=len(points))
    if sizes.max() == len(at):
        return at
    low, high = split_ranges(distances, child, len(points))
    return points, low, high, [grown(rows, space, at[child == j]) for j in range(len(points))]


class Hunt:
    """The best rows of each window of a tile of anchors, gathered while trees are walked."""

    def __init__(self, space: Space, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, keep: int) -> None:
        self.space, self.ids, self.labels, self.vectors, self.low, self.high, self.same, self.keep = space, ids, labels, vectors, low, high, same, keep
        kind = float if space.exact else object
        self.scores = np.full((*low.shape, keep), -np.inf, kind)
        self.found = np.full((*low.shape, keep), MOST, np.int64)
        self.looked = 0

    def floors(self, who: np.ndarray) -> np.ndarray:
        """What a row must score at least to count in a window: the window's end, or the worst of what is kept."""
        return np.maximum(self.low[who], self.scores[who, :, -1])

    def walk(self, node, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, who: np.ndarray) -> None:
        if not len(who):
            return
        if isinstance(node, np.ndarray):
            for first in range(0, len(node), LEAF_ROWS):
                self.compare(rows, ids, labels, node[first : first + LEAF_ROWS], who)
            return
        points, low, high, children = node
        anchors = self.vectors[who]
        to_points = self.space.to_anchors(points, anchors)
        near = self.space.of_scores(anchors, self.high[who])
        for j, child in enumerate(children):
            far = self.space.of_scores(anchors, self.floors(who))
            may = possible(to_points, low[:, j : j + 1], high[:, j : j + 1], near, far, self.space.slack)[:, 0]
            self.walk(child, rows, ids, labels, who[may])

    def compare(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, at: np.ndarray, who: np.ndarray) -> None:
        """Rows of a leaf against anchors; ``ids`` ascend along ``at``, so the first of equal scores is the smallest id."""
        self.looked += len(at) * len(who)
        scores = scores_of(self.vectors[who], rows[at], self.space.exact)
        like = labels[at][None] == self.labels[who][:, None]
        fits = like & (ids[at][None] != self.ids[who][:, None]) if self.same else ~like
        floors = self.floors(who)
        for slot in range(self.low.shape[1]):
            left = np.where(fits & (scores >= floors[:, slot, None]) & (scores <= self.high[who, slot, None]), scores, -np.inf)
            live = np.flatnonzero((left > -np.inf).any(1))
            if not len(live):
                continue
            left, line = left[live], np.arange(len(live))
            new_scores, new_ids = [self.scores[who[live], slot]], [self.found[who[live], slot]]
            for _ in range(self.keep):
                best = left.argmax(1)
                new_scores.append(left[line, best][:, None])
                new_ids.append(np.where(left[line, best] > -np.inf, ids[at[best]], MOST)[:, None])
                left[line, best] = -np.inf
            all_scores, all_ids = np.concatenate(new_scores, 1), np.concatenate(new_ids, 1)
            by_id = np.argsort(all_ids, axis=1, kind="stable")
            all_scores, all_ids = np.take_along_axis(all_scores, by_id, 1), np.take_along_axis(all_ids, by_id, 1)
            order = np.argsort(-all_scores, axis=1, kind="stable")[:, : self.keep]
            self.scores[who[live], slot] = np.take_along_axis(all_scores, order, 1)
            self.found[who[live], slot] = np.take_along_axis(all_ids, order, 1)

    def hits(self) -> pa.RecordBatch:
        who, slot, rank = np.nonzero(self.scores > -np.inf)
        scores = [int(s) for s in self.scores[who, slot, rank]] if not self.space.exact else self.scores[who, slot, rank].astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids[who]), pa.array(slot.astype(np.int32)), pa.array(self.found[who, slot, rank]), pa.array(scores, pa.int64())],
            names=["anchor_id", "slot", "vec_id", "score"],
        )


# --- the index ---------------------------------------------------------------------------------------------------------


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix."""
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), len(flat) // len(column) if len(column) else 0)


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, matrix) of the vectors of each length."""
    lengths = np.asarray(column.value_lengths())
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        yield int(length), at, _matrix(column.take(pa.array(at)))


@dataclass
class Index:
    """The top of the tree, and the table of trees of its chunks: (dim, region, chunk, tree)."""

    space: Space
    points: dict[int, np.ndarray]
    ranges: dict[int, tuple[np.ndarray, np.ndarray]]
    chunks: DataFrame
    sizes: DataFrame
    trees: DataFrame


def _one(column: pa.ChunkedArray) -> pa.Array:
    joined = column.combine_chunks()
    return pa.concat_arrays(joined.chunks) if isinstance(joined, pa.ChunkedArray) else joined


def build(rows: DataFrame) -> Index:
    """Index of all ``rows`` (vec_id, label, vector); split points at the top come from SAMPLE_ROWS rows by hash.

    Vectors of a length that the sample does not hold are one region, which no window rules out.
    """
    longest = rows.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)), F.count("*")).first()
    space = Space(float(longest[0] or 0.0))
    points: dict[int, np.ndarray] = {}
    if space.exact and longest[1]:
        place = unit_hash(F.col("vec_id"))
        sample = rows.filter(place < 2.0 * SAMPLE_ROWS / longest[1]).orderBy(place, "vec_id").limit(SAMPLE_ROWS).select("vector").toArrow()
        for length, _, matrix in _by_length(_one(sample.column(0))):
            points[length] = far_apart(matrix, min(REGIONS, -(-len(matrix) // 32)), space)

    def nearest(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        split = points.get(matrix.shape[1])
        distances = space.between(split, matrix) if split is not None else np.zeros((len(matrix), 1))
        return distances, distances.argmin(1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, region = np.asarray(batch.column(2).value_lengths()).astype(np.int32), np.zeros(batch.num_rows, np.int32)
            for _, at, matrix in _by_length(batch.column(2)):
                region[at] = nearest(matrix)[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lengths), pa.array(region)], names=["vec_id", "label", "vector", "dim", "region"])

    dealt = materialize(rows.mapInArrow(assign, "vec_id long, label int, vector array<double>, dim int, region int"), "regions")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for length, at, matrix in _by_length(batch.column(0)):
                if length in points:
                    distances, region = nearest(matrix)
                    new = split_ranges(distances, region, len(points[length]))
                    old = known.get(length, new)
                    known[length] = np.minimum(old[0], new[0]), np.maximum(old[1], new[1])
        for length, (low, high) in known.items():
            i, j = np.nonzero(low <= high)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), length, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(low[i, j]), pa.array(high[i, j])],
                names=["dim", "point", "region", "low", "high"],
            )

    spans = dealt.select("vector").mapInArrow(measure, "dim int, point int, region int, low double, high double")
    ranges: dict[int, tuple[np.ndarray, np.ndarray]] = {d: (np.full((len(p), len(p)), np.inf), np.full((len(p), len(p)), -np.inf)) for d, p in points.items()}
    # At most REGIONS squared rows of a length, and fewer than SAMPLE_ROWS split points in all.
    for r in spans.groupBy("dim", "point", "region").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        ranges[r.dim][0][r.point, r.region], ranges[r.dim][1][r.point, r.region] = r.low, r.high

    # A crowded region is cut finer than its neighbours, so that no task has much more to do than the others.
    regions = sum(map(len, points.values())) or 1
    rows_each = min(CHUNK_ROWS, max(SMALL_CHUNK, 2 * longest[1] // regions))
    sizes = materialize(dealt.groupBy("dim", "region").agg(F.ceil(F.count("*") / rows_each).cast("int").alias("chunks")), "chunk-counts")
    place = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("chunks").cast("long")).cast("int")
    # One row per region: fewer than SAMPLE_ROWS, and one for each length that the sample did not hold.
    chunked = dealt.join(sizes, ["dim", "region"]).select("dim", "region", place.alias("chunk"), "vec_id", "label", "vector")
    keys = ["dim", "region", "chunk"]

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, table in runs(batches, 3):
            ids, labels, vectors = np.asarray(_one(table.column(3))), np.asarray(_one(table.column(4))), _matrix(_one(table.column(5)))
            tree = pickle.dumps((ids, labels, vectors, grown(vectors, space)), protocol=5)
            yield pa.RecordBatch.from_arrays([*(pa.array([k], pa.int32()) for k in key), pa.array([tree], pa.large_binary()).cast(pa.binary())], names=[*keys, "tree"])

    tasks = _tasks(rows, sizes.agg(F.sum("chunks")).first()[0] or 1)
    planted = chunked.repartition(tasks, *keys).sortWithinPartitions(*keys, "vec_id").mapInArrow(plant, "dim int, region int, chunk int, tree binary")
    trees = materialize(planted, "trees")
    discard(dealt)
    return Index(space, points, ranges, trees.select(*keys), sizes, trees)


def _tasks(df: DataFrame, groups: int) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(int(groups), 100_000))


def search(index: Index, anchors: DataFrame, same: bool, keep: int, home: bool) -> DataFrame:
    """(anchor_id, slot, vec_id, score): the best ``keep`` rows of each chunk for each window of each anchor.

    ``anchors`` has (anchor_id, label, vector, low, high): arrays with the windows' ends, both within. With ``home`` only
    the region an anchor lies in is searched, else all others that its windows may reach. ``same``: rows of the anchor's
    label with another id, else rows of other labels.
    """
    space, points, ranges = index.space, index.points, index.ranges

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, at, matrix in _by_length(batch.column(2)):
                rows = batch.take(pa.array(at))
                if length not in points:
                    may = np.full((len(at), 1), home)
                else:
                    own = space.between(points[length], matrix).argmin(1)
                    may = np.zeros((len(at), len(points[length])), bool)
                    if not home:
                        low, high = _windows(rows.column(3)), _windows(rows.column(4))
                        near, far = space.of_scores(matrix, high), space.of_scores(matrix, np.where(low > high, np.inf, low))
                        near = np.where(low > high, np.inf, near)
                        may = possible(space.to_anchors(points[length], matrix), *ranges[length], near, far, space.slack)
                    may[np.arange(len(at)), own] = home
                who, region = np.nonzero(may)
                for first in range(0, len(who), 4096):
                    part = rows.take(pa.array(who[first : first + 4096]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(part.num_rows, length, np.int32)), pa.array(region[first : first + 4096].astype(np.int32)), *part.columns],
                        names=["dim", "region", "anchor_id", "label", "vector", "low", "high"],
                    )

    count = anchors.count()
    blocks = max(1, -(-count // BLOCK_ANCHORS))
    shape = "dim int, region int, anchor_id long, label int, vector array<double>, low array<long>, high array<long>"
    sent = anchors.select("anchor_id", "label", "vector", "low", "high").mapInArrow(route, shape).join(index.sizes, ["dim", "region"])
    keys = ["block", "dim", "region", "chunk"]
    asked = sent.select(
        F.pmod(F.xxhash64("anchor_id"), F.lit(blocks)).cast("int").alias("block"), "dim", "region", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
        F.lit(1).alias("kind"), "anchor_id", "label", "vector", "low", "high", F.lit(None).cast("binary").alias("tree"),
    )
    held = index.trees.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "dim", "region", "chunk", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("anchor_id"),
        F.lit(None).cast("int").alias("label"), F.lit(None).cast("array<double>").alias("vector"), F.lit(None).cast("array<long>").alias("low"), F.lit(None).cast("array<long>").alias("high"), "tree",
    )

    def hunt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planted = None
        # The tree of a chunk comes before the anchors that look into it, and these in bounded batches.
        for batch in batches:
            for key, table in runs(iter([batch]), 5):
                if key[4] == 0:
                    planted = key[:4], pickle.loads(table.column(10)[0].as_py())
                    continue
                if planted is None or planted[0] != key[:4]:
                    raise ValueError(f"no tree for the chunk {key[:4]}")
                rows_ids, rows_labels, rows, tree = planted[1]
                for part in table.to_batches(TILE_ANCHORS):
                    tile = Hunt(space, np.asarray(part.column(5)), np.asarray(part.column(6)), _matrix(part.column(7)), _windows(part.column(8)), _windows(part.column(9)), same, keep)
                    tile.walk(tree, rows, rows_ids, rows_labels, np.arange(part.num_rows))
                    yield tile.hits()

    tasks = _tasks(anchors, index.chunks.count() * blocks)
    return held.unionByName(asked).repartition(tasks, *keys).sortWithinPartitions(*keys, "kind").mapInArrow(hunt, _HIT)


def _windows(column: pa.Array) -> np.ndarray:
    """Ends of windows, one line per anchor; all anchors of a search have as many (unused ones are empty)."""
    ends = _matrix(column.cast(pa.list_(pa.float64()), safe=False))
    return np.where(ends >= float(MOST), np.inf, np.where(ends <= float(LEAST), -np.inf, ends))


def _best(hits: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), F.asc("vec_id"))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def best_in_windows(index: Index, anchors: DataFrame, same: bool, keep: int) -> DataFrame:
    """(anchor_id, slot, rank, vec_id, score): the best ``keep`` rows of each window, ties to the smaller vec_id."""
    near = materialize(_best(search(index, anchors, same, keep, home=True), keep), "near")
    # A window that is full where the anchor lies needs nothing below what it has.
    full = near.filter(F.col("rank") == keep).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("floors"))
    floor = lambda low, slot: F.greatest(low, F.coalesce(F.try_element_at("floors", slot), low))
    narrowed = anchors.join(full, "anchor_id", "left").withColumn("low", F.transform("low", floor)).drop("floors")
    far = search(index, materialize(narrowed, "narrowed"), same, keep, home=False)
    return _best(near.drop("rank").unionByName(far), keep)


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of anchors and their first positives.

    Rows without vec_id, label or vector, or with a component that is null or not finite (also after scaling), take no
    part. A vec_id divisible by SHIFTED moves its label on. Anchors are rows whose vec_id is divisible by ANCHORS; an id
    that occurs more than once is one anchor, with the smallest of its labels and then vectors, and as many candidates.
    Positives are the POSITIVES best rows of the anchor's label and another id; negatives the first NEGATIVES rows of
    other labels with a score from LOW to HIGH hundredths of the positive's. Higher scores come first, then smaller ids.
    Vectors of different lengths are not compared, empty ones score 0; scores beyond 64 bits are held at their ends. An
    anchor or positive without a match gives no row, an empty table none. Other columns are not read.
    """
    rows = materialize(participants(embeddings), "vectors")
    index = build(rows)
    chosen = rows.filter(F.col("vec_id") % ANCHORS == 0).groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("a"))
    anchors = materialize(chosen.select(F.col("vec_id").alias("anchor_id"), "a.label", "a.vector", F.array(F.lit(LEAST)).alias("low"), F.array(F.lit(MOST)).alias("high")), "anchors")
    positives = materialize(best_in_windows(index, anchors, True, POSITIVES), "positives")

    # A positive's window: 50 p <= 100 n <= 95 p; a window without any whole number is empty.
    wide = F.col("score").cast("decimal(38,0)")
    low = F.ceil(wide * LOW / 100).cast("decimal(38,0)").cast("long")
    high = F.floor(wide * HIGH / 100).cast("decimal(38,0)").cast("long")
    window = positives.filter("score >= 0").select("anchor_id", (F.col("rank") - 1).alias("slot"), low.alias("low"), high.alias("high"))
    listed = window.groupBy("anchor_id").agg(*[F.map_from_entries(F.collect_list(F.struct("slot", c))).alias(f"{c}s") for c in ("low", "high")])
    slots = F.array(*[F.lit(s) for s in range(POSITIVES)])
    end = lambda ends, none: F.transform(slots, lambda slot: F.coalesce(F.try_element_at(F.col(ends), slot), F.lit(none)))
    windows = materialize(anchors.drop("low", "high").join(listed, "anchor_id").withColumns({"low": end("lows", MOST), "high": end("highs", LEAST)}).drop("lows", "highs"), "windows")
    negatives = best_in_windows(index, windows, False, NEGATIVES)
    told = positives.select("anchor_id", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return negatives.join(told, ["anchor_id", "slot"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
