"""Quality grades by ordinal cumulative-link regression.

P(grade <= k) = logistic(threshold_k - w . x): one set of hashed text weights is shared by all grades,
and ordered thresholds cut its line. x has the words and stems that a text holds, and how large a share
of its words each shape takes and how many of them repeat others (in eighths). A text's expected grade is the sum of its tail
probabilities P(grade >= k); it is selected if the tail from a given grade on is likely.

Defined results: null and empty texts have no features, so the thresholds alone decide; with one grade
or none among the labels nothing is learned and every text gets that grade (0 if there is none).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.llm._common import LOWER_WORDS, text_bytes
from tideglass.llm.hashed import SIZE, Memory, frequent, labelled_sample, shape, stem_feature, word_feature


def _shapes(counts: Counter, n: int, distinct: int) -> list[int]:
    """Features of shapes: one for each eighth of the words that a shape reaches, or that repeat others."""
    counts = counts | Counter({b"again": max(0, n - distinct)})
    return [crc32(b"%s#%d" % (s, k)) % SIZE for s, c in counts.items() for k in range(1, 8 * c // max(1, n) + 1)]


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # of grades 0 .. K - 2, ascending

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. K - 1."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -60, 60)))


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for text in text_bytes(batch, 1):
            words = set(text.translate(LOWER_WORDS).split())
            raw = text.split()
            found.append(np.unique(np.array([f(w) for w in words for f in (word_feature, stem_feature)] + _shapes(Counter(map(shape, raw)), len(raw), len(set(raw))), np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "y", "features"])


def train(docs: DataFrame, ratings: DataFrame, max_rows: int = 8000, epochs: int = 24, rate: float = 0.2, least_docs: int = 5, l2: float = 1e-4) -> Model:
    """A model from ratings (doc_id, y 0 .. K - 1) of about max_rows documents at most, by Adagrad on batches of them.

    One task holds the features of that bounded sample and sends the weights to the driver.
    """
    sample = labelled_sample(docs, ratings, max_rows, seed=31)
    rows = sample.mapInArrow(_featurize, f"doc_id {dict(sample.dtypes)['doc_id']}, y int, features array<int>")
    run = partial(_fit_task, epochs=epochs, rate=rate, least_docs=least_docs, l2=l2)
    found = rows.repartition(1).sortWithinPartitions("doc_id").select("y", "features").mapInArrow(run, "weights binary, thresholds array<double>").first()
    return Model(np.frombuffer(found["weights"], np.float32), np.array(found["thresholds"], float)) if found else Model(np.zeros(SIZE, np.float32), np.zeros(0))


def _fit_task(batches: Iterator[pa.RecordBatch], **options) -> Iterator[pa.RecordBatch]:
    parts = list(batches)
    y = np.concatenate([p.column(0).to_numpy() for p in parts] or [np.zeros(0, np.int32)]).astype(np.int64)
    sizes = np.concatenate([p.column(1).value_lengths().to_numpy() for p in parts] or [np.zeros(0, np.int64)])
    features = np.concatenate([p.column(1).flatten().to_numpy() for p in parts] or [np.zeros(0, np.int32)])
    model = fit(y, sizes, features, **options)
    yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.thresholds.tolist()], pa.list_(pa.float64()))], ["weights", "thresholds"])


def fit(y: np.ndarray, sizes: np.ndarray, features: np.ndarray, epochs: int, rate: float, least_docs: int, l2: float) -> Model:
    """y and the number of features of each document, and the features of all."""
    grades = int(y.max(initial=0)) + 1
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(SIZE, np.float32), np.full(grades - 1, -20.0))
    doc = np.repeat(np.arange(len(y)), sizes)
    features = np.where(frequent(doc, features, least_docs)[features], features, SIZE)
    at = np.r_[0, np.cumsum(sizes)]
    share = np.clip([(y <= k).mean() for k in range(grades - 1)], 0.01, 0.99)
    cuts = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(grades - 1))
    weights, squares, cut_squares = np.zeros(SIZE + 1), np.full(SIZE + 1, 1e-2), np.full(grades - 1, 1e-2)
    order = np.random.default_rng(7)
    logistic = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    for _ in range(epochs):
        for batch in np.array_split(order.permutation(len(y)), max(1, len(y) // 128)):
            tokens = np.concatenate([np.arange(at[d], at[d + 1]) for d in batch])
            owner = np.repeat(np.arange(len(batch)), sizes[batch])
            f, own = features[tokens], y[batch]
            z = np.bincount(owner, weights[f], len(batch))
            below = np.hstack([np.zeros((len(batch), 1)), logistic(cuts[None, :] - z[:, None]), np.ones((len(batch), 1))])
            row = np.arange(len(batch))
            upper, lower = below[row, own + 1], below[row, own]
            p = np.maximum(upper - lower, 1e-9)
            slope_up, slope_low = upper * (1 - upper) / p, lower * (1 - lower) / p
            gz = (slope_low - slope_up) / len(batch)
            g = np.bincount(f, gz[owner], SIZE + 1) - l2 * weights
            g[SIZE] = 0
            squares += g * g
            weights += rate * g / np.sqrt(squares)
            gc = np.array([slope_up[own == k].sum() - slope_low[own == k + 1].sum() for k in range(grades - 1)]) / len(batch)
            cut_squares += gc * gc
            cuts = np.maximum.accumulate(cuts + rate * gc / np.sqrt(cut_squares))
    return Model(weights[:SIZE].astype(np.float32), cuts)


def _score(batches: Iterator[pa.RecordBatch], model, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    m = model.value
    weights = m.weights
    stems = Memory(lambda w: float(stem_feature(w)))
    words = Memory(lambda w: float(weights[word_feature(w)]))
    shapes: dict[bytes, bytes] = {}
    for batch in batches:
        z = []
        for text in text_bytes(batch, 1):
            text = text or b""
            own = list(set(text.translate(LOWER_WORDS).split()))
            raw = Counter(text.split())
            if len(shapes) > 1 << 18:
                shapes.clear()
            counts: Counter = Counter()
            for w, n in raw.items():
                s = shapes.get(w)
                if s is None:
                    s = shapes[w] = shape(w)
                counts[s] += n
            by_shape = np.unique(np.array(_shapes(counts, sum(raw.values()), len(raw)), np.int64))
            z.append(words(own).sum() + weights[np.unique(stems(own).astype(np.int64))].sum() + weights[by_shape].sum())
        tails = m.tails(np.array(z, float))
        columns = [batch.column(0).cast(id_type), pa.array(tails.sum(axis=1)), pa.array(tails.tolist(), pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "expected_grade", "tails"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, expected_grade, tails) of every whole text; tails: P(grade >= k) for k from 1 on."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # SIZE weights
    kind = "string" if dict(docs.dtypes)["doc_id"] == "string" else "bigint"
    cols = docs.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("text").cast("binary").alias("text"))
    run = partial(_score, model=held, id_type=pa.string() if kind == "string" else pa.int64())
    return cols.mapInArrow(run, f"doc_id {kind}, expected_grade double, tails array<double>")
