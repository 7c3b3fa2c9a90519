"""Language identification by interpolated Kneser-Ney character models.

A language's model gives the probability of each letter (or of a break between words) after the three
before it. Spark counts the n-grams of a bounded sample of labelled texts; discounts, continuation
counts and back-off weights follow from those counts. All languages share sorted arrays of n-gram
hashes: a row holds the log probability of that n-gram in every language, already backed off where a
language lacks it. A text's language is the one of the lowest cross-entropy per character of the whole
text; texts whose entropy lies above what calibration texts of that language reach are rejected.

Defined results: null texts and texts without a letter are `und` with score 0; ties go to the first
language by code point; with nothing to learn from, everything is `und`; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.llm._common import by_crc

ORDER = 4
UND = "und"
_PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Code points that are scored at once.
_CHUNK = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, starts): lower-cased letters with one space for all between; each text after ORDER - 1 zeros."""
    letters, parts, starts, at = _letters(), [], [], 0
    pad = np.zeros(ORDER - 1, np.uint32)
    for t in texts:
        points = np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letters[points]
        points = np.where(is_letter, points, 32)
        keep = is_letter | np.r_[True, is_letter[:-1]][: len(points)]
        points = points[keep] if is_letter.any() else points[:0]
        starts.append(at)
        parts += [pad, points]
        at += ORDER - 1 + len(points)
    return (np.concatenate(parts) if parts else pad[:0]).astype(np.uint64), np.array(starts, np.int64)


def hashes(points: np.ndarray, order: int) -> np.ndarray:
    """A 64-bit hash of the order code points that end at each place (the first order - 1 places are of no use)."""
    h = np.zeros(len(points), np.uint64)
    for back in range(order - 1, -1, -1):
        shifted = np.r_[np.zeros(back, np.uint64), points[: len(points) - back]] if back else points
        h = (h ^ (shifted + np.uint64(order))) * _PRIME
        h ^= h >> np.uint64(29)
    return h


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (lang, gram, n) of each batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            frame = batch.slice(at, 256).to_pandas()
            for lang, rows in frame.groupby("lang"):
                points, starts = characters(rows["text"].tolist())
                real = np.ones(len(points), bool)
                for k in range(ORDER - 1):
                    real[starts + k] = False
                ends = np.flatnonzero(real)
                if not len(ends):
                    continue
                _, first, n = np.unique(hashes(points, ORDER)[ends], return_index=True, return_counts=True)
                grams = points[ends[first][:, None] + np.arange(1 - ORDER, 1)].astype(np.uint32)
                texts = [g.tobytes().decode("utf-32-le", "surrogatepass") for g in grams]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array(texts), pa.array(n, pa.int64())], ["lang", "gram", "n"])


class _Language:
    """The counts of one language as Kneser-Ney probabilities: per order, hash -> log p, and context hash -> log back-off weight."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, alphabet: int):
        levels = [(grams, counts)]
        for k in range(ORDER - 1, 0, -1):
            kinds, n = np.unique(levels[-1][0][:, 1:], axis=0, return_counts=True)
            levels.append((kinds, n))
        self.p: list[tuple[np.ndarray, np.ndarray]] = []
        self.back: list[tuple[np.ndarray, np.ndarray]] = []
        for k, (g, c) in enumerate(reversed(levels), 1):
            once, twice = int((c == 1).sum()), int((c == 2).sum())
            discount = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
            context = _row_hashes(g[:, :-1])
            of, at = np.unique(context, return_inverse=True)
            total, kinds = np.bincount(at, c), np.bincount(at)
            weight = discount * kinds / total
            lower = np.full(len(g), 1 / alphabet) if k == 1 else np.exp(self._level(k - 1, _row_hashes(g[:, 1:])))
            p = (c - discount) / total[at] + weight[at] * lower
            key = _row_hashes(g)
            order = np.argsort(key)
            self.p.append((key[order], np.log(p[order])))
            self.back.append((of, np.log(weight)))
        self.unseen = self.back[0][1][0] - np.log(alphabet)

    def _level(self, k: int, keys: np.ndarray) -> np.ndarray:
        known, values = self.p[k - 1]
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, values[at], np.nan)

    def backoff(self, k: int, contexts: np.ndarray) -> np.ndarray:
        known, values = self.back[k - 1]
        at = np.minimum(np.searchsorted(known, contexts), len(known) - 1)
        return np.where(known[at] == contexts, values[at], 0.0)

    def log_p(self, grams: np.ndarray) -> np.ndarray:
        """Of rows of code points, backed off as far as needed."""
        k = grams.shape[1]
        out = self._level(k, _row_hashes(grams))
        gone = np.isnan(out)
        if gone.any():
            below = grams[gone]
            out[gone] = self.unseen if k == 1 else self.backoff(k, _row_hashes(below[:, :-1])) + self.log_p(below[:, 1:])
        return out


def _row_hashes(grams: np.ndarray) -> np.ndarray:
    n, k = grams.shape
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = (h ^ (grams[:, j].astype(np.uint64) + np.uint64(k))) * _PRIME
        h ^= h >> np.uint64(29)
    return h


@dataclass
class Model:
    """Sorted hash arrays shared by all languages, and what calibration set."""

    langs: list[str]
    keys: list[np.ndarray]  # per order, sorted
    values: list[np.ndarray]  # per order [keys, languages]: log p
    contexts: list[np.ndarray]
    weights: list[np.ndarray]  # per order [contexts, languages]: log back-off weight
    unseen: np.ndarray
    limits: np.ndarray | None = None  # cross-entropy beyond which a language is rejected
    heat: float = 10.0

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(nats per character [texts, languages], characters) of whole texts."""
        points, starts = characters(texts)
        sizes = np.diff(np.r_[starts, len(points)]) - (ORDER - 1)
        sums = np.zeros((len(texts), len(self.langs)))
        for at in range(0, len(points), _CHUNK):
            begin = max(0, at - ORDER + 1)
            window = points[begin : at + _CHUNK]
            offset = at - begin
            keys = {k: hashes(window, k)[offset:] for k in (ORDER,)}
            n = len(window) - offset
            out = np.zeros((n, len(self.langs)), np.float32)
            todo = np.arange(n)
            for k in range(ORDER, 0, -1):
                key = keys[k] if k in keys else hashes(window, k)[offset:][todo]
                known = self.keys[k - 1]
                place = np.minimum(np.searchsorted(known, key), len(known) - 1)
                found = known[place] == key
                out[todo[found]] += self.values[k - 1][place[found]]
                todo = todo[~found]
                if not len(todo):
                    break
                if k == 1:
                    out[todo] += self.unseen
                else:  # the context is the gram of one less that ends a place before
                    context = np.r_[np.uint64(0), hashes(window, k - 1)[:-1]][offset:][todo]
                    known = self.contexts[k - 1]
                    place = np.minimum(np.searchsorted(known, context), len(known) - 1)
                    seen = known[place] == context
                    out[todo[seen]] += self.weights[k - 1][place[seen]]
            where = np.arange(at, at + n)
            doc = np.searchsorted(starts, where, "right") - 1
            out[where - starts[doc] < ORDER - 1] = 0
            first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            sums[doc[first]] += np.add.reduceat(out.astype(np.float64), first, axis=0)
        return -sums / np.maximum(sizes, 1)[:, None], sizes


def build(counts: pd.DataFrame) -> Model | None:
    """The model of counts (lang, gram, n)."""
    if counts.empty:
        return None
    langs = sorted(counts["lang"].unique())
    points = lambda rows: np.array([np.frombuffer(g.encode("utf-32-le", "surrogatepass"), np.uint32) for g in rows["gram"]])
    grams = [points(counts[counts["lang"] == lang]) for lang in langs]
    alphabet = len(np.unique(np.concatenate(grams)[:, -1])) + 1
    own = [_Language(g, counts.loc[counts["lang"] == lang, "n"].to_numpy(float), alphabet) for lang, g in zip(langs, grams)]
    keys, values, contexts, weights = [], [], [], []
    for k in range(1, ORDER + 1):
        kinds = np.unique(np.concatenate([g[:, ORDER - k :] for g in grams]), axis=0)
        key = _row_hashes(kinds)
        order = np.argsort(key)
        keys.append(key[order])
        values.append(np.stack([m.log_p(kinds)[order] for m in own], axis=1).astype(np.float32))
        context = np.unique(np.concatenate([m.back[k - 1][0] for m in own]))
        contexts.append(context)
        weights.append(np.stack([m.backoff(k, context) for m in own], axis=1).astype(np.float32))
    return Model(langs, keys, values, contexts, weights, np.array([m.unseen for m in own], np.float32))


def _sample(labelled: DataFrame, per_language: int, seed: int) -> DataFrame:
    """About per_language rows of each language, by a hash of doc_id."""
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return labelled
    keep = F.create_map(*(x for lang, n in sorted(sizes.items()) for x in (F.lit(lang), F.lit(min(1.0, per_language / n) * 1_000_000))))
    return labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < keep[F.col("lang")])


def train(labelled: DataFrame, per_language: int = 2000, calibration: int = 300, miss: float = 0.005) -> Model | None:
    """A model from labelled rows (doc_id, text, lang).

    N-grams are counted in about per_language rows of each language; rejection limits (the share `miss` of a
    language's own texts lies beyond) and the scale of scores come from `calibration` others of each.
    """
    labelled = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    aside = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(8)) == 0
    chosen = _sample(labelled.where(~aside), per_language, 9).select("text", "lang")
    counts = chosen.mapInArrow(_count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    model = build(counts.toPandas().sort_values(["lang", "gram"]))
    if model is None:
        return None
    tests = _score(_sample(labelled.where(aside), calibration, 10).select("lang", "text"), model, "lang", "string").toPandas()
    tests = tests[tests["best"].notna()]
    model.limits = np.full(len(model.langs), np.inf)
    for k, lang in enumerate(model.langs):
        own = tests.loc[(tests["id"] == lang) & (tests["best"] == lang), "entropy"]
        if len(own):
            model.limits[k] = float(np.quantile(own, 1 - miss)) + 0.25
    right, gap = (tests["best"] == tests["id"]).to_numpy(), tests["gap"].to_numpy()
    p = lambda heat: np.clip(1 / (1 + np.exp(-heat * gap)), 1e-6, 1 - 1e-6)
    loss = {h: -np.log(np.where(right, p(h), 1 - p(h))).mean() if len(gap) else 0 for h in (1.0, 2.0, 5.0, 10.0, 20.0, 50.0)}
    model.heat = min(loss, key=loss.get)
    return model


def _predict(batches: Iterator[pa.RecordBatch], model, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    m = model.value if hasattr(model, "value") else model
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            entropy, sizes = m.entropies(part.column(1).to_pylist())
            best = entropy.argmin(axis=1)
            ordered = np.sort(entropy, axis=1)
            gap = ordered[:, 1] - ordered[:, 0] if entropy.shape[1] > 1 else np.full(len(best), 50.0)
            lowest = ordered[:, 0]
            score = 1 / (1 + np.exp(-m.heat * np.minimum(gap, 50)))
            limits = m.limits if m.limits is not None else np.full(len(m.langs), np.inf)
            none = sizes <= 0
            columns = [
                part.column(0).cast(id_type),
                pa.array([None if x else m.langs[k] for k, x in zip(best, none)], pa.string()),
                pa.array(np.where(none, 0.0, score)),
                pa.array(np.where(none, 0.0, lowest)),
                pa.array(np.where(none, 0.0, gap)),
                pa.array((lowest > limits[best]) | none),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "best", "score", "entropy", "gap", "rejected"])


def _score(rows: DataFrame, model: Model, id_column: str, id_kind: str) -> DataFrame:
    """(id, best, score, entropy, gap, rejected) of rows (id, text)."""
    held = rows.sparkSession.sparkContext.broadcast(model)  # as large as the bounded sample makes it
    cols = rows.select(F.col(id_column).cast(id_kind).alias("id"), "text")
    run = partial(_predict, model=held, id_type=pa.string() if id_kind == "string" else pa.int64())
    return cols.mapInArrow(run, f"id {id_kind}, best string, score double, entropy double, gap double, rejected boolean")


def identify(docs: DataFrame, model: Model | None, reject: bool = True) -> DataFrame:
    """(doc_id, lang, score, entropy, rejected) of every whole text; rejected texts are `und` if reject."""
    kind = dict(docs.dtypes)["doc_id"]
    if model is None:
        return docs.select("doc_id", F.lit(UND).alias("lang"), F.lit(0.0).alias("score"), F.lit(0.0).alias("entropy"), F.lit(True).alias("rejected"))
    out = _score(docs, model, "doc_id", kind if kind in ("string", "bigint") else "bigint")
    best = F.coalesce("best", F.lit(UND))
    return out.select(F.col("id").alias("doc_id"), (F.when(F.col("rejected"), UND).otherwise(best) if reject else best).alias("lang"), "score", "entropy", "rejected")


def held_out(doc_id: str = "doc_id"):
    return by_crc(doc_id, 4) == 2
