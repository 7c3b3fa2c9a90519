"""Substring dedup by sliding sentence spans.

A run is `least` or more consecutive sentences that just reach `min_words` words, forwards from its first or
backwards from its last sentence. Every run of every text is hashed; Spark finds the hashes that more than
one document holds and the first of these documents (smallest doc_id, then text hash). The sentences that such
runs cover go from every other document. Runs reach the words both ways, so a passage of `least` whole sentences and
min_words words that an earlier document holds goes whole, to its last sentence.

A text that repeats a passage in itself alone keeps it: only what documents share is cut (quality rules judge the rest).

Only hashes, ids and places are shuffled before the cut. Counting is pre-aggregated, and the join that finds the
other places may be split where one passage is very frequent. The runs to cut are gathered for each document
and merged as intervals, so nothing is made for each sentence of each run.

Defined results: null and empty texts have no sentence; a document is a (doc_id, text) pair, so rows that
repeat one are the same place and all keep or lose the same sentences, and rows of one doc_id (null included) with
different texts are different documents; texts of fewer sentences or words have no run; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.llm._common import LOWER_SPACED, staged, text_bytes

#: A sentence ends after . ! ? before white space, or at a line end.
_END = re.compile(rb"(?<=[.!?])[ \t\r]+|[ \t\r]*\n\s*")


def sentence_bounds(text: bytes | None) -> list[tuple[int, int]]:
    """[start, end) in bytes of the sentences that hold a word."""
    if not text:
        return []
    cuts = [0]
    for m in _END.finditer(text):
        cuts += m.span()
    cuts.append(len(text))
    return [(a, b) for a, b in zip(cuts[::2], cuts[1::2]) if text[a:b].strip()]


def runs_of(n_words: list[int], min_words: int, least: int) -> np.ndarray:
    """[first sentence, sentences] of the runs of a text whose sentences have so many words, each run once."""
    n = len(n_words)
    upto = np.cumsum([0, *n_words])
    here = np.arange(n)
    ends = np.maximum(np.searchsorted(upto, upto[:-1] + min_words, "left"), here + least)  # forwards: the run ends before this sentence
    begins = np.minimum(np.searchsorted(upto, upto[1:] - min_words, "right") - 1, here + 1 - least)  # backwards: it begins here
    forwards = np.stack([here, ends - here], axis=1)[ends <= n]
    backwards = np.stack([begins, here + 1 - begins], axis=1)[begins >= 0]
    return np.unique(np.concatenate([forwards, backwards]), axis=0)


def spans(text: bytes | None, min_words: int, least: int) -> tuple[list[int], np.ndarray]:
    """(hashes, [first sentence, sentences]) of the runs of a text."""
    from xxhash import xxh3_64_intdigest

    sentences = [text[a:b].translate(LOWER_SPACED).split() for a, b in sentence_bounds(text)]
    if len(sentences) < least:
        return [], np.zeros((0, 2), np.int64)
    joined = [b" ".join(s) for s in sentences]
    whole = b" ".join(joined)
    starts = np.cumsum([0, *map(len, joined)]) + np.arange(len(joined) + 1)
    runs = runs_of([len(s) for s in sentences], min_words, least)
    begin, end = starts[runs[:, 0]].tolist(), (starts[runs.sum(axis=1)] - 1).tolist()
    return [xxh3_64_intdigest(whole[a:b]) for a, b in zip(begin, end)], runs


def _span_rows(batches: Iterator[pa.RecordBatch], min_words: int, least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            found = [spans(text, min_words, least) for text in text_bytes(part, 2)]
            offsets = pa.array(np.cumsum([0, *(len(h) for h, _ in found)]), pa.int32())
            runs = np.concatenate([r for _, r in found])
            flat = np.array([x for h, _ in found for x in h], np.uint64).view(np.int64)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v, t)) for v, t in ((flat, pa.int64()), (runs[:, 0], pa.int32()), (runs[:, 1], pa.int32()))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists], ["doc_id", "text_hash", "h", "first", "size"])


def _documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, text as bytes) of every row."""
    kind = "string" if dict(docs.dtypes)["doc_id"] == "string" else "bigint"
    return docs.select(F.col("doc_id").cast(kind).alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))


def repeated_spans(docs: DataFrame, min_words: int = 20, least: int = 2) -> DataFrame:
    """(doc_id, text_hash, runs): for each document with sentences to remove, the runs (first, size) that cover them."""
    cols = _documents(docs)
    run = partial(_span_rows, min_words=min_words, least=least)
    hashed = staged(cols.mapInArrow(run, f"doc_id {dict(cols.dtypes)['doc_id']}, text_hash bigint, h array<bigint>, first array<int>, size array<int>"))
    places = hashed.select(F.struct("doc_id", "text_hash").alias("doc"), F.inline(F.arrays_zip("h", "first", "size")))
    seen = places.groupBy("h").agg(F.min("doc").alias("kept"), F.max("doc").alias("last"))
    repeated = staged(seen.where("NOT kept <=> last").select("h", "kept"))
    again = places.join(repeated, "h").where("NOT doc <=> kept").select("doc.*", F.struct("first", "size").alias("run"))
    return again.groupBy("doc_id", "text_hash").agg(F.collect_set("run").alias("runs"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, gone, numbers, texts = [], [], [], []
        for text, runs in zip(text_bytes(batch, 1), batch.column(2).to_pylist()):
            bounds = sentence_bounds(text)
            edges = np.zeros(len(bounds) + 1, np.int64)
            for r in runs or ():
                edges[r["first"]] += 1
                edges[r["first"] + r["size"]] -= 1
            drop = np.flatnonzero(np.cumsum(edges[:-1]) > 0).tolist()
            counts.append(len(bounds))
            gone.append(len(drop))
            numbers.append(drop)
            at, kept = 0, []
            for k in drop:
                a, b = bounds[k]
                kept.append(text[at:a])
                at = b
            texts.append(b"".join([*kept, text[at:]]).decode() if drop else text and text.decode())
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(numbers, pa.list_(pa.int32())), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_sentences", "n_removed", "removed", "text"])


def remove_repeated(docs: DataFrame, min_words: int = 20, least: int = 2) -> DataFrame:
    """(doc_id, n_sentences, n_removed, removed, text without the removed sentences) of every row of docs; removed: their numbers in order."""
    runs = staged(repeated_spans(docs, min_words, least)).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "runs")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))
    rows = _documents(docs).join(runs, same, "left").select("doc_id", "text", "runs")
    return rows.mapInArrow(_cut, f"doc_id {dict(rows.dtypes)['doc_id']}, n_sentences bigint, n_removed bigint, removed array<int>, text string")
