"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

A sentence's probability is logistic in the hashed weights of its words and their stems; a document's
is the noisy-or of its sentences, 1 - prod(1 - p). Only documents are labelled: the gradient of the
document's likelihood shares the blame among its sentences. Scoring gives the document's probability
and the places of the sentences that reach one half by themselves.

Defined results: null and empty texts have no sentence and score 0; with no labels of one kind the
model is all zero weights at the share of toxic labels (0 if there are none); rows may repeat.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.llm._common import LOWER_WORDS, by_crc, text_bytes
from tideglass.llm.hashed import SIZE, Memory, frequent, labelled_sample, stem_feature, word_feature

#: Sentences end at . ! ? and line ends.
_END = re.compile(rb"[.!?\n]")
_MARK = b"\x01"
_TO_WORDS = bytes(1 if b in b".!?\n" else LOWER_WORDS[b] for b in range(256))


def _tokens(text: bytes | None) -> list[bytes]:
    """Words, with a mark at the end of each sentence."""
    return text.translate(_TO_WORDS).replace(_MARK, b" \x01 ").split() if text else []


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def word(self, word: bytes) -> float:
        return float(self.weights[word_feature(word)] + self.weights[stem_feature(word)])


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, y, word features with -1 at sentence ends, stem features) of each labelled text."""
    for batch in batches:
        words, stems = [], []
        for text in text_bytes(batch, 1):
            tokens = _tokens(text)
            words.append(np.array([-1 if t == _MARK else word_feature(t) for t in tokens], np.int32))
            stems.append(np.array([-1 if t == _MARK else stem_feature(t) for t in tokens], np.int32))
        kind = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), pa.array(words, kind), pa.array(stems, kind)], ["doc_id", "y", "words", "stems"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, epochs: int = 20, rate: float = 0.35, least_docs: int = 3, l2: float = 1e-5, toxic_weight: float = 3.0) -> Model:
    """A model from labels (doc_id, y 0/1) of about max_rows documents at most, by Adagrad on batches of them.

    toxic_weight: how much a toxic document counts, for they are few. least_docs: documents that a feature needs.
    One task holds the features of that bounded sample and sends the weights to the driver.
    """
    sample = labelled_sample(docs, labels, max_rows, seed=21)
    rows = sample.mapInArrow(_featurize, f"doc_id {dict(sample.dtypes)['doc_id']}, y int, words array<int>, stems array<int>")
    run = partial(_fit_task, epochs=epochs, rate=rate, least_docs=least_docs, l2=l2, toxic_weight=toxic_weight)
    found = rows.repartition(1).sortWithinPartitions("doc_id").select("y", "words", "stems").mapInArrow(run, "weights binary, bias double").first()
    return Model(np.frombuffer(found["weights"], np.float32), found["bias"]) if found else Model(np.zeros(SIZE, np.float32), -20.0)


def _fit_task(batches: Iterator[pa.RecordBatch], **options) -> Iterator[pa.RecordBatch]:
    parts = list(batches)
    flat = lambda k: np.concatenate([p.column(k).flatten().to_numpy() for p in parts] or [np.zeros(0, np.int32)])
    y = np.concatenate([p.column(0).to_numpy() for p in parts] or [np.zeros(0)]).astype(float)
    sizes = np.concatenate([p.column(1).value_lengths().to_numpy() for p in parts] or [np.zeros(0, np.int64)])
    model = fit(y, sizes, flat(1), flat(2), **options)
    yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias])], ["weights", "bias"])


def fit(y: np.ndarray, sizes: np.ndarray, words: np.ndarray, stems: np.ndarray, epochs: int, rate: float, least_docs: int, l2: float, toxic_weight: float) -> Model:
    """y and the number of tokens of each document; the features of all tokens, -1 at sentence ends."""
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(SIZE, np.float32), 20.0 if len(y) and y.min() else -20.0)
    doc = np.repeat(np.arange(len(y)), sizes)
    sentence = np.cumsum(words == -1) + doc  # a new one after each mark and at each document
    real = words >= 0
    words, stems, doc, sentence = words[real], stems[real], doc[real], np.unique(sentence[real], return_inverse=True)[1]
    use = frequent(doc, words, least_docs), frequent(doc, stems, least_docs)
    words, stems = np.where(use[0][words], words, SIZE), np.where(use[1][stems], stems, SIZE)  # SIZE: no weight
    doc_of = np.zeros(int(sentence.max(initial=-1)) + 1, np.int64)
    doc_of[sentence] = doc
    token_at, sentence_at = np.searchsorted(doc, np.arange(len(y) + 1)), np.searchsorted(doc_of, np.arange(len(y) + 1))
    weights, squares = np.zeros(SIZE + 1), np.full(SIZE + 1, 1e-2)
    bias, bias_square = -4.0, 1e-2
    order = np.random.default_rng(5)
    for _ in range(epochs):
        for batch in np.array_split(order.permutation(len(y)), max(1, len(y) // 128)):
            batch = np.sort(batch)
            tokens = np.concatenate([np.arange(token_at[d], token_at[d + 1]) for d in batch])
            sents = np.concatenate([np.arange(sentence_at[d], sentence_at[d + 1]) for d in batch])
            if not len(sents):
                continue
            w, s = words[tokens], stems[tokens]
            at = np.searchsorted(sents, sentence[tokens])
            owner = np.searchsorted(batch, doc_of[sents])
            z = bias + np.bincount(at, weights[w] + weights[s], len(sents))
            log_not = -np.logaddexp(0, z)  # log(1 - p)
            p = np.exp(z + log_not)
            log_q = np.bincount(owner, log_not, len(batch))
            q = np.exp(log_q)
            pull = np.where(y[batch] > 0, q / np.maximum(1 - q, 1e-9) * toxic_weight, -1.0)
            g = pull[owner] * p / len(batch)  # ascent direction of z
            gw = np.bincount(w, g[at], SIZE + 1) + np.bincount(s, g[at], SIZE + 1) - l2 * weights
            gw[SIZE] = 0
            squares += gw * gw
            weights += rate * gw / np.sqrt(squares)
            bias_square += g.sum() ** 2
            bias = min(-2.0, bias + 0.1 * g.sum() / np.sqrt(bias_square))
    return Model(weights[:SIZE].astype(np.float32), float(bias))


def _score(batches: Iterator[pa.RecordBatch], model, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    m = model.value
    memory = Memory(lambda w: float("nan") if w == _MARK else m.word(w))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
    for batch in batches:
        scores, places = [], []
        for text in text_bytes(batch, 1):
            tokens = _tokens(text)
            values = memory(tokens)
            ends = np.flatnonzero(np.isnan(values))
            number = np.zeros(len(values), np.int64)
            number[ends] = 1
            number = np.cumsum(number)
            real = ~np.isnan(values)
            of, at = np.unique(number[real], return_inverse=True)
            z = m.bias + np.bincount(at, values[real], len(of))
            log_not = -np.logaddexp(0, z)
            scores.append(float(-np.expm1(log_not.sum())))
            worst = np.flatnonzero(z >= 0)
            places.append(_places(text, of[worst], 1 / (1 + np.exp(-z[worst]))) if len(worst) else [])
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(id_type), pa.array(scores, pa.float64()), pa.array(places, span)], ["doc_id", "score", "sentences"])


def _places(text: bytes, numbers: np.ndarray, p: np.ndarray) -> list[dict]:
    bounds = [0, *(m.end() for m in _END.finditer(text)), len(text)]
    chars = lambda n: len(text[:n].decode())
    return [{"start": chars(bounds[k]), "end": chars(bounds[k + 1]), "p": float(x)} for k, x in zip(numbers.tolist(), p)]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, sentences) of every whole text; sentences: (start, end, p) in code points of those with p >= 0.5."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # SIZE weights
    kind = dict(docs.dtypes)["doc_id"]
    kind = kind if kind == "string" else "bigint"
    cols = docs.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("text").cast("binary").alias("text"))
    run = partial(_score, model=held, id_type=pa.string() if kind == "string" else pa.int64())
    return cols.mapInArrow(run, f"doc_id {kind}, score double, sentences array<struct<start:int,end:int,p:double>>")


def held_out(doc_id: str = "doc_id"):
    return by_crc(doc_id, 5) == 0
