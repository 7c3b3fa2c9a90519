"""Words as hashed features, and bounded samples of labelled texts, for the models over words."""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weights that a model has: the size of what is broadcast, whatever the corpus.
SIZE = 1 << 18
#: Words whose weights a task remembers.
REMEMBERED = 1 << 19
_RUNS = re.compile(rb"(.)\1+")
_SHAPE = bytes(ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else b for b in range(256))


def word_feature(word: bytes) -> int:
    return crc32(word) % SIZE


def stem_feature(word: bytes) -> int:
    """Of a word's first four characters: it links the forms of a word."""
    return crc32(b"^" + word.decode("utf-8", "replace")[:4].encode()) % SIZE


def shape(word: bytes) -> bytes:
    """Capitals, letters and digits as A, a and 0, other characters as they are, runs once; of that, eight bytes at most make the feature (the word's own feature has all of it)."""
    return _RUNS.sub(rb"\1", word.translate(_SHAPE))[:8]


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int, seed: int) -> DataFrame:
    """docs (doc_id, text) with the column y of labels (doc_id, y), about max_rows rows by a hash of doc_id."""
    labels = labels.where("y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    part = min(1.0, max_rows / max(1, labels.count()))
    labels = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < part * 1_000_000)
    labels = labels.withColumnRenamed("doc_id", "__id")
    return docs.join(labels, F.col("doc_id") == F.col("__id")).select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), "y")


def frequent(doc_of: np.ndarray, feature: np.ndarray, least: int) -> np.ndarray:
    """Which of SIZE features at least `least` documents have."""
    pairs = np.unique(doc_of.astype(np.int64) * SIZE + feature)
    return np.bincount(pairs % SIZE, minlength=SIZE) >= least


class Memory:
    """word -> number, computed once for each word and forgotten when there are too many."""

    def __init__(self, of):
        self.of, self.known = of, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        new = set(words).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, set(words)
        of = self.of
        self.known.update((w, of(w)) for w in new)
        return np.fromiter(map(self.known.__getitem__, words), np.float64, len(words))
