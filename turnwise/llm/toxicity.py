"""Toxicity scores by weak supervision.

1. From a bounded sample of labelled documents, words and word beginnings that are surely commoner in toxic ones become
   voters, far commoner ones first; three more look at whether none, one or several of these fire. Pattern voters look at
   how a text is written, whatever its words: masked spellings, drawn-out letters, shouting, rows of marks, and whether it
   speaks to somebody.
2. All documents are voted on. A generative model of the votes (for each voter, how often it fires in either class) is
   fitted by expectation-maximisation over the counts of all vote patterns, with the labelled sample as anchor; the
   correlations of voters within the classes discount voters that say the same thing.
3. The model's posteriors are the labels of a linear classifier over all words and word beginnings, trained on a bounded
   sample of documents, which scores every text.

Labels are only read for documents that may be learnt from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from turnwise.llm.common import learnable, materialize, mix, power_tables, unit_hash

DIMENSIONS = 1 << 20
#: Documents of either class in the labelled sample, and of either side of the posterior in the classifier's sample.
SAMPLE_TOXIC, SAMPLE_CLEAN = 2000, 6000
#: Voters at most, the labelled toxic documents a voter needs, and how often each of those should be covered.
VOTERS, SUPPORT, COVER = 255, 4, 4
#: How much likelier in toxic documents, at the cautious end of its estimate, a feature is that no weaker one needs to back.
LIFT = 25.0
ROUNDS = 5
#: Features of the linear classifier.
VOCABULARY = 2000
THRESHOLD = 0.3

_letters = np.zeros(0, bool)


def _is_letter() -> np.ndarray:
    """Whether each code point is a letter; made once per worker."""
    global _letters
    if not len(_letters):
        _letters = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _letters


def features(text: str | None) -> np.ndarray:
    """Distinct features of a text, in ascending order: each word in lower case, and its first 4, 5 and 6 letters.

    A word is a run of letters. Its hash is the difference of two prefix sums, so all of a text are hashed at once.
    """
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    inside = np.zeros(len(points) + 2, bool)
    inside[1:-1] = _is_letter()[points]
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    power, inverse = power_tables(len(points) + 1)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(points.astype(np.uint64) * power[: len(points)], out=sums[1:])
    cuts = np.concatenate([ends, *[np.minimum(starts + k, ends) for k in (4, 5, 6)]])
    begins = np.tile(starts, 4)
    kinds = np.repeat(np.array([1, 4, 5, 6], np.uint64), len(starts))
    hashes = mix((sums[cuts] - sums[begins]) * inverse[begins] * np.uint64(8) + kinds)
    return np.unique((hashes >> np.uint64(64 - DIMENSIONS.bit_length() + 1)).astype(np.int32))


#: Signs that stand for letters inside a word, and words that speak to somebody.
SIGNS = "*@#$%!0123456789"
ADDRESS = "you your yourself du dich dir dein deine ihr euch tu toi vous ton ta vos votre tú te tus usted ustedes vosotros".split()
#: Pattern voters, in the order of their numbers.
PATTERNS = ("masked", "drawn_out", "shouting", "marks", "address")
_address = np.zeros(0, np.int32)
#: Bytes to what they are inside a word: L for letters (and bytes of longer characters), S for signs; and C for capitals.
_in_word = bytes(ord("L") if c >= 128 or chr(c).isalpha() else ord("S") if chr(c) in SIGNS else ord(" ") for c in range(256))
_capitals = bytes(ord("C") if c < 128 and chr(c).isupper() else ord(" ") for c in range(256))
_shouts = re.compile(b"C{4,}").findall


def patterns_of(text: str | None, ids: np.ndarray) -> list[int]:
    """Numbers of the patterns that a text shows; ``ids`` are its features.

    masked: one or two signs or digits within a word; drawn_out: a plain letter three times in a row; shouting: two or more
    runs of four plain capitals; marks: two exclamation or question marks in a row; address: a word that speaks to somebody.
    """
    global _address
    if not len(_address):
        _address = np.unique(np.array([word_feature(w) for w in ADDRESS], np.int32))
    data = (text or "").encode("utf-8", "surrogatepass")
    kinds, capitals = data.translate(_in_word), data.translate(_capitals)
    found = []
    # One byte is found much faster than several, and most texts have no such sign or mark at all.
    if b"S" in kinds and (b"LSL" in kinds or b"LSSL" in kinds):
        found.append(0)
    plain = np.frombuffer(data, np.uint8)
    same = plain[1:] == plain[:-1]
    thrice = np.flatnonzero(same[1:] & same[:-1])
    if len(thrice) and any(c < 128 and chr(c).isalpha() for c in np.unique(plain[thrice]).tolist()):
        found.append(1)
    if capitals.count(b"CCCC") >= 2 and len(_shouts(capitals)) >= 2:
        found.append(2)
    if (b"!" in data or b"?" in data) and any(pair in data for pair in (b"!!", b"??", b"!?", b"?!")):
        found.append(3)
    place = np.searchsorted(ids, _address)
    if len(ids) and (ids[np.minimum(place, len(ids) - 1)] == _address).any():
        found.append(4)
    return found


def word_feature(word: str) -> int:
    """The feature of a whole word, as ``features`` has it."""
    points = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.uint64)
    total = (points * power_tables(len(points))[0][: len(points)]).sum(dtype=np.uint64, keepdims=True)
    return int(mix(total * np.uint64(8) + np.uint64(1))[0] >> np.uint64(64 - DIMENSIONS.bit_length() + 1))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).to_pylist()
        ids = [features(t) for t in texts]
        sketches = [np.array(_sketch(own), "<u4").tobytes() for own in ids]
        shown = [patterns_of(t, own) for t, own in zip(texts, ids)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sketches, pa.binary()), pa.array(ids, pa.list_(pa.int32())), pa.array(shown, pa.list_(pa.int32()))], names=["doc_id", "aim", "sketch", "ids", "shown"]
        )


def _features_of(documents: DataFrame, chosen: DataFrame) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(aim, features, patterns) of the chosen (doc_id, aim) rows, a bounded number of them, in a stable order.

    Of texts that share a doc_id one counts, so no more rows come than were chosen; and near copies would make any of their
    words look typical: of those with one sketch and side, the first by a hash counts. Both are thinned before they leave
    the tasks.
    """
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")
    rows = texts.select("doc_id", "aim", "text").mapInArrow(_sampled, "doc_id bigint, aim double, sketch binary, ids array<int>, shown array<int>")
    place = F.struct(F.xxhash64("ids").alias("place"), F.col("aim").alias("side"))
    one = rows.groupBy("doc_id").agg(F.min_by(F.struct("aim", "sketch", "ids", "shown"), place).alias("r")).select("doc_id", F.xxhash64("r.ids").alias("place"), "r.*")
    one = materialize(one, "toxic-sample")
    # Which one of a sketch counts is told by narrow rows; the features of the others stay where they are.
    first = one.groupBy((F.col("aim") > 0.5).alias("toxic"), "sketch").agg(F.min(F.struct("place", "aim", "doc_id")).alias("first")).select("first.doc_id")
    got = one.join(first, "doc_id").select("place", "aim", "ids", "shown").toArrow()
    places, aims = np.asarray(got["place"]), np.asarray(got["aim"], dtype=np.float64)
    ids, shown = ([np.asarray(i.values) for i in got[c]] for c in ("ids", "shown"))
    order = np.lexsort((aims, places))
    return aims[order], [ids[k] for k in order], [shown[k] for k in order]


def _sketch(ids: np.ndarray) -> list[int]:
    return np.sort(ids.astype(np.uint32) * np.uint32(0x9E3779B1))[:12].tolist()


def labelled_sample(labels: DataFrame) -> tuple[DataFrame, float]:
    """(doc_id, aim), and the share of toxic documents among all labelled ones: about SAMPLE_TOXIC toxic and SAMPLE_CLEAN clean labelled documents, by hash.

    A document is toxic if any of its labels says so; rows without an id or a label are left out.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("double").alias("aim"))
    known = known.filter(learnable(F.col("doc_id"))).withColumn("place", unit_hash(F.col("doc_id")))
    return _cut(known, F.lit(0.5))


def _cut(rows: DataFrame, bar) -> tuple[DataFrame, float]:
    """(doc_id, aim), and the share of aims above the bar: rows with the smallest ``place``, about SAMPLE_TOXIC with an aim above the bar and SAMPLE_CLEAN others."""
    rows = materialize(rows.select("doc_id", "aim", "place"), "labelled")
    row = rows.agg(F.count_if(F.col("aim") > bar).alias("toxic"), F.count("*").alias("n")).first()
    share = F.when(F.col("aim") > bar, F.lit(SAMPLE_TOXIC / max(row.toxic, 1))).otherwise(F.lit(SAMPLE_CLEAN / max(row.n - row.toxic, 1)))
    return rows.filter(F.col("place") < share).select("doc_id", "aim"), row.toxic / max(row.n, 1)


def choose_voters(toxic: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Features that vote: likelier in toxic documents, surest first, while they cover ones that few others cover.

    Those likelier by LIFT come first; others cover only documents that none of these covers. Features count if the
    difference of their rates is beyond chance for as many features as were seen, and if none is, the best of those that
    are likelier at all, so both sides having a document with words is enough for a voter unless no word tells them apart.
    """
    n_toxic, n_clean = int(toxic.sum()), int((~toxic).sum())
    if not n_toxic or not n_clean:
        return np.zeros(0, np.int64)
    count = lambda chosen: np.bincount(np.concatenate([np.zeros(0, np.int32), *[r for r, c in zip(rows, chosen) if c]]), minlength=DIMENSIONS)
    hits, false = count(toxic), count(~toxic)
    rate = (hits + false) / len(rows)
    surely = (hits / n_toxic - false / n_clean) / np.sqrt(rate * (1 - rate) * (1 / n_toxic + 1 / n_clean) + 1e-9)
    # About the largest value that chance gives among as many features.
    chance = np.sqrt(2 * np.log(max(int((hits + false > 0).sum()), 2)))
    cautious = (np.maximum(hits - np.sqrt(hits), 0) / n_toxic) / ((false + 1) / n_clean)
    clear = (hits >= SUPPORT) & (cautious >= LIFT)
    for enough in (clear | ((hits >= SUPPORT) & (surely >= chance)), hits >= SUPPORT, hits > 0):
        candidates = np.flatnonzero(enough & (surely > 0))
        if len(candidates):
            break
    candidates = candidates[np.lexsort((candidates, -surely[candidates], -cautious[candidates], ~clear[candidates]))]
    where: dict[int, list[int]] = {int(c): [] for c in candidates}
    for k in np.flatnonzero(toxic):
        for f in rows[k].tolist():
            if f in where:
                where[f].append(int(k))
    covered, clearly = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
    voters = []
    for f in candidates.tolist():
        at = np.array(where[f])
        wanted = (covered[at] < COVER) & (clear[f] | ~clearly[at])
        if wanted.sum() >= min(2, len(at)):
            covered[at] += 1
            clearly[at] |= clear[f]
            voters.append(f)
            if len(voters) == VOTERS:
                break
    return np.array(voters, np.int64)


def votes_of(ids: np.ndarray, slots: np.ndarray, shown: list[int] | np.ndarray) -> np.ndarray:
    """Numbers of the voters that fire; ``slots`` maps a feature to its voter or -1.

    Behind them, three voters look at whether none, one or several of them fire, and one stands for each pattern shown.
    """
    fired = slots[ids]
    fired = np.sort(fired[fired >= 0])
    words = slots.max() + 1
    return np.concatenate([fired, [words + min(len(fired), 2)], words + 3 + np.asarray(shown, np.int64)]).astype(np.int64)


@dataclass
class LabelModel:
    prior: float
    toxic: np.ndarray  # how often each voter fires in toxic documents
    clean: np.ndarray
    discount: np.ndarray

    def weights(self) -> tuple[float, np.ndarray]:
        """(bias, weight of each vote): log odds of being toxic; silence speaks through the voter for it."""
        fire = np.log(self.toxic / self.clean)
        return float(np.log(self.prior / (1 - self.prior))), self.discount * fire


def _statistics(bias: float, weight: np.ndarray):
    """Vote patterns to expected counts: (row, column, kind, n); kind 1 counts toxic, 0 clean, each voter with each."""
    voters = len(weight)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, voters + 1, voters + 1))
        for batch in batches:
            for votes, n in zip(batch.column(0), batch.column(1).to_pylist()):
                at = np.append(np.asarray(votes.values), voters)
                p = 1 / (1 + np.exp(-(bias + weight[at[:-1]].sum())))
                sums[np.ix_([1], at, at)] += n * p
                sums[np.ix_([0], at, at)] += n * (1 - p)
        kind, row, column = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in (kind, row, column)], pa.array(sums[kind, row, column])], names=["kind", "row", "col", "n"])

    return expect


def fit_label_model(patterns: DataFrame, toxic: np.ndarray, votes: list[np.ndarray], voters: int, prior: float) -> LabelModel:
    """Fit on ``patterns`` (votes, n) of all documents, starting from and anchored by the labelled sample.

    ``prior`` is the share of toxic documents among the labelled; it stays, since votes alone cannot tell toxic from any
    other split of the corpus. For the same reason all documents together weigh as much as the sample.
    """
    anchor = np.zeros((2, voters + 1, voters + 1))
    for y, own in zip(toxic, votes):
        at = np.append(own, voters).astype(np.int64)
        anchor[np.ix_([int(y)], at, at)] += 1

    def model(sums: np.ndarray) -> LabelModel:
        n = sums[:, voters, voters]
        rate = np.stack([(sums[c].diagonal()[:voters] + 1) / (n[c] + 2) for c in (0, 1)])
        # Correlation of each two voters within a class, the stronger of both classes.
        strength = np.zeros((voters, voters))
        for c in (0, 1):
            together = sums[c, :voters, :voters] / max(n[c], 1e-9)
            spread = np.sqrt(rate[c] * (1 - rate[c]))
            strength = np.maximum(strength, (together - np.outer(rate[c], rate[c])) / np.outer(spread, spread))
        strength = np.clip(strength, 0, 1)
        np.fill_diagonal(strength, 1)
        return LabelModel(prior, rate[1], rate[0], 1 / np.sqrt(np.maximum((strength**2).sum(axis=1), 1)))

    fitted = model(anchor)
    for _ in range(ROUNDS):
        bias, weight = fitted.weights()
        got = patterns.mapInArrow(_statistics(bias, weight), "kind bigint, row bigint, col bigint, n double").groupBy("kind", "row", "col").agg(F.sum("n").alias("n")).toArrow()
        sums = np.zeros_like(anchor)
        sums[np.asarray(got["kind"]), np.asarray(got["row"]), np.asarray(got["col"])] = np.asarray(got["n"])
        everything = sums[:, voters, voters].sum()
        fitted = model(anchor + sums * (len(votes) / max(everything, 1)))
    return fitted


def train_linear(rows: list[np.ndarray], aims: np.ndarray, steps: int = 600, l1: float = 4e-4, l2: float = 1e-4) -> tuple[float, np.ndarray]:
    """Logistic regression on soft labels with elastic net, by accelerated proximal gradient; (bias, weights).

    The features are the VOCABULARY whose rates differ most surely between the two sides.
    """
    many = lambda weight: np.bincount(np.concatenate(rows), weights=np.repeat(weight, [len(r) for r in rows]), minlength=DIMENSIONS)
    n_toxic, n_clean = max(aims.sum(), 1e-9), max((1 - aims).sum(), 1e-9)
    toxic, clean = many(aims), many(1 - aims)
    rate = (toxic + clean) / len(rows)
    surely = np.abs(toxic / n_toxic - clean / n_clean) / np.sqrt(rate * (1 - rate) * (1 / n_toxic + 1 / n_clean) + 1e-9)
    chosen = np.lexsort((np.arange(DIMENSIONS), -surely))[:VOCABULARY]
    slots = np.full(DIMENSIONS, -1, np.int64)
    slots[chosen] = np.arange(len(chosen))
    x = np.zeros((len(rows), len(chosen) + 1), np.float32)
    x[:, -1] = 1
    for k, ids in enumerate(rows):
        at = slots[ids]
        x[k, at[at >= 0]] = 1

    v = np.ones(x.shape[1], np.float32)
    for _ in range(30):
        v = x.T @ (x @ (v / np.linalg.norm(v)))
    step = 4 * len(rows) / np.linalg.norm(v)
    w = ahead = np.zeros(x.shape[1], np.float32)
    pace = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        moved = ahead - step * (x.T @ (p - aims).astype(np.float32) / len(rows) + l2 * ahead)
        shrunk = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0)
        shrunk[-1] = moved[-1]
        following = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead, w, pace = (shrunk + (pace - 1) / following * (shrunk - w)).astype(np.float32), shrunk.astype(np.float32), following
    weights = np.zeros(DIMENSIONS)
    weights[chosen] = w[:-1]
    return float(w[-1]), weights


@dataclass(frozen=True)
class Scorer:
    bias: float
    weights: np.ndarray

    def __call__(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[features(text)].sum(), -30, 30))))


def train(documents: DataFrame, labels: DataFrame) -> Scorer:
    """Fit voters, label model and classifier; without toxic or clean labels to learn from every text scores about 0.

    So it does if no word at all is likelier in toxic documents than in clean ones.
    """
    sample, share = labelled_sample(labels)
    aims, rows, shown = _features_of(documents, sample)
    toxic = aims > 0.5
    chosen = choose_voters(toxic, rows)
    if not len(chosen):
        return Scorer(-30.0, np.zeros(DIMENSIONS, np.float32))
    slots = np.full(DIMENSIONS, -1, np.int64)
    slots[chosen] = np.arange(len(chosen))
    voters = len(chosen) + 3 + len(PATTERNS)
    held = documents.sparkSession.sparkContext.broadcast(slots)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            votes = [votes_of(ids, held.value, patterns_of(t, ids)) for t, ids in zip(texts, map(features, texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes, pa.list_(pa.int32()))], names=["doc_id", "votes"])

    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    voted = materialize(texts.mapInArrow(vote, "doc_id bigint, votes array<int>"), "votes")
    patterns = materialize(voted.groupBy("votes").agg(F.count("*").cast("double").alias("n")), "patterns")
    fitted = fit_label_model(patterns, toxic, [votes_of(r, slots, p) for r, p in zip(rows, shown)], voters, min(max(share, 1e-4), 0.5))

    bias, weight = fitted.weights()
    log_odds = F.lit(bias) + F.aggregate(F.transform("votes", lambda v: F.element_at(F.array(*[F.lit(float(x)) for x in weight]), v + 1)), F.lit(0.0), lambda a, b: a + b)
    posteriors = voted.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(1 / (1 + F.exp(-log_odds))).alias("aim")).withColumn("place", unit_hash(F.col("doc_id"), F.lit("posterior")))
    soft, texts_ids, _ = _features_of(documents, _cut(posteriors, F.lit(0.5))[0])
    bias, weights = train_linear(texts_ids, soft)
    return Scorer(bias, weights.astype(np.float32))


def scored(documents: DataFrame, scorer: Scorer) -> DataFrame:
    """All columns of ``documents`` with score and predicted (columns of these names are replaced); reads text only.

    Null and empty texts get the score of a text without words.
    """
    kept = [c for c in documents.columns if c.lower() not in ("score", "predicted")]
    at = next(k for k, c in enumerate(kept) if c.lower() == "text")
    rows = documents.select(*[documents[c] for c in kept])
    held = documents.sparkSession.sparkContext.broadcast(scorer)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([held.value(t) for t in batch.column(at).cast(pa.string()).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return rows.mapInArrow(score, StructType([*rows.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())]))
