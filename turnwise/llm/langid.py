"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are reduced to their lower-case words and cut into n-grams of 1 to 3 characters, hashed to ``DIMENSIONS``
features; document frequencies are counted over all documents one may learn from. Weights are trained with
follow-the-regularised-leader, whose elastic-net penalty leaves most of them at zero, on a bounded sample of labelled
documents, and a temperature fitted on a part of the sample that the weights never saw calibrates the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from turnwise.llm.common import learnable, materialize, unit_hash

DIMENSIONS = 1 << 16
#: Different labelled documents that train the model: about this many of each language, and of all languages together at most.
SAMPLE_PER_LANGUAGE, SAMPLE_ALL = 400, 8000
#: One in so many of the sample is kept for the temperature.
CALIBRATION = 5
UNKNOWN = "und"
BROADCAST_LANGUAGES = 10_000

_words = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall


def features(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(feature ids in ascending order, how often each occurs); None for a text without a letter."""
    words = _words((text or "").lower())
    if not words:
        return None
    points = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    h = points * np.uint32(0x9E3779B1)
    grams = [h]
    for shift in (1, 2):
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + points[shift:] * np.uint32(0xC2B2AE3D)
        grams.append(h)
    ids = np.concatenate(grams)
    ids = ((ids ^ (ids >> np.uint32(16))) * np.uint32(0x27D4EB2F)) >> np.uint32(32 - DIMENSIONS.bit_length() + 1)
    counts = np.bincount(ids, minlength=DIMENSIONS)
    present = np.flatnonzero(counts)
    return present, counts[present]


def _weighted(ids: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    values = (1 + np.log(counts)) * idf[ids]
    norm = np.sqrt(values @ values)
    return values / norm if norm > 0 else values


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray  # languages x (DIMENSIONS + 1), the last column is the bias
    temperature: float

    def logits(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.weights[:, ids] @ _weighted(ids, counts, self.idf) + self.weights[:, -1]

    def predict(self, text: str | None) -> tuple[str, float]:
        found = features(text)
        if found is None or not self.languages:
            return UNKNOWN, 0.0
        z = self.logits(*found) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> np.ndarray:
    """FTRL-proximal with elastic-net penalties over (ids, values) rows, in the given order; (classes, DIMENSIONS + 1).

    Classes weigh alike whatever their number of rows.
    """
    z, n = np.zeros((classes, DIMENSIONS + 1)), np.zeros((classes, DIMENSIONS + 1))
    share = len(labels) / (classes * np.maximum(np.bincount(labels, minlength=classes), 1))
    for _ in range(epochs):
        for (ids, values), label in zip(rows, labels):
            ids, values = np.append(ids, DIMENSIONS), np.append(values, 1.0)
            zi, ni = z[:, ids], n[:, ids]
            w = _proximal(zi, ni, alpha, beta, l1, l2)
            scores = w @ values
            p = np.exp(scores - scores.max())
            p /= p.sum()
            p[label] -= 1
            g = (share[label] * p)[:, None] * values
            n[:, ids] = ni + g * g
            z[:, ids] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
    return _proximal(z, n, alpha, beta, l1, l2)


def _proximal(z: np.ndarray, n: np.ndarray, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    return -np.sign(z) * np.maximum(np.abs(z) - l1, 0) / ((beta + np.sqrt(n)) / alpha + l2)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden-section search over its logarithm.

    Of each label, 1 / (rows + 2) goes to the other classes: a sample without errors does not prove that there are none.
    """
    if not len(labels):
        return 1.0
    classes = logits.shape[1]
    aim = np.full(logits.shape, 1 / (len(labels) + 2) / max(classes - 1, 1))
    aim[np.arange(len(labels)), labels] = 1 - 1 / (len(labels) + 2)

    def loss(log_t: float) -> float:
        z = logits / np.exp(log_t)
        z = z - z.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - (aim * z).sum(axis=1)))

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to (feature, documents that have it), one row per feature and task; feature -1 counts the documents."""
    seen, documents = np.zeros(DIMENSIONS, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            found = features(text.as_py())
            documents += found is not None
            if found is not None:
                seen[found[0]] += 1
    present = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(present, -1), pa.int64()), pa.array(np.append(seen[present], documents), pa.int64())], names=["feature", "n"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, counts = [], []
        for text in batch.column(2):
            found = features(text.as_py()) or (np.zeros(0, np.int64), np.zeros(0, np.int64))
            ids.append(found[0].astype(np.int32))
            counts.append(found[1].astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["place", "lang", "ids", "counts"])


def train(documents: DataFrame) -> Model:
    """Fit the model on the rows of ``documents`` that may be learnt from: those not held out, with a language."""
    may = documents.select(F.col("doc_id").cast("string").alias("key"), F.col("text").cast("string"), F.col("lang").cast("string")).filter(learnable(F.col("key")))
    counted = may.select("text").mapInArrow(_frequencies, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    frequency = np.zeros(DIMENSIONS)
    real = counted[counted.feature >= 0]
    frequency[real.feature.to_numpy()] = real.n.to_numpy()
    total = counted.n[counted.feature < 0].sum()
    idf = np.log((1 + total) / (1 + frequency)) + 1

    # Rows equal in id and text have one place, so a text that is repeated any number of times is one row of the sample.
    place = unit_hash(F.col("key"), F.col("text")).alias("place")
    labelled = may.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", place)
    per_language = labelled.groupBy("lang").agg(F.approx_count_distinct("place", 0.02).alias("n"))
    languages = per_language.count()
    if not languages:
        return Model((), idf, np.zeros((0, DIMENSIONS + 1)), 1.0)
    each = max(2, min(SAMPLE_PER_LANGUAGE, SAMPLE_ALL // languages))
    # A sample by hash: about ``each`` different rows of every language, all of a rare one.
    # One row per language, counted above; the texts stay where they are and only the sample goes on.
    sizes = F.broadcast(per_language) if languages <= BROADCAST_LANGUAGES else per_language
    rated = labelled.join(sizes, "lang").filter(F.col("place") * F.col("n") < each).groupBy("lang", "place").agg(F.min("text").alias("text"))
    rows = materialize(rated.select("place", "lang", "text").mapInArrow(_sampled, "place double, lang string, ids array<int>, counts array<int>"), "sample").orderBy("place", "lang").toArrow()
    names = tuple(sorted(set(rows["lang"].to_pylist())))
    labels = np.array([names.index(x) for x in rows["lang"].to_pylist()], np.int64)
    pairs = [(np.asarray(i.values), np.asarray(c.values)) for i, c in zip(rows["ids"], rows["counts"])]
    train_at, check_at = [], []
    seen = dict.fromkeys(range(len(names)), 0)
    for k, label in enumerate(labels.tolist()):
        # The first rows of a language train; of the others every CALIBRATION-th is for the temperature.
        (check_at if seen[label] % CALIBRATION == CALIBRATION - 1 else train_at).append(k)
        seen[label] += 1
    weights = train_ftrl([(pairs[k][0], _weighted(*pairs[k], idf)) for k in train_at], labels[train_at], len(names))
    model = Model(names, idf, weights, 1.0)
    logits = np.array([model.logits(*pairs[k]) for k in check_at]).reshape(len(check_at), len(names))
    return Model(names, idf.astype(np.float32), weights.astype(np.float32), fit_temperature(logits, labels[check_at]))


def identified(documents: DataFrame, model: Model) -> DataFrame:
    """All columns of ``documents`` with lang_pred and score (columns of these names are replaced); reads text only.

    A null text or one without a letter is ``und`` with score 0, and so is any text if nothing could be learnt.
    """
    kept = [c for c in documents.columns if c.lower() not in ("lang_pred", "score")]
    at = kept.index("text") if "text" in kept else next(k for k, c in enumerate(kept) if c.lower() == "text")
    rows = documents.select(*[documents[c] for c in kept])
    held = documents.sparkSession.sparkContext.broadcast(model)

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [held.value.predict(t) for t in batch.column(at).cast(pa.string()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    schema = StructType([*rows.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.mapInArrow(identify, schema)
