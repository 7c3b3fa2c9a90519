"""Benchmark decontamination with an FM-index per training shard.

A task gathers documents into a shard, numbers their words by the vocabulary of the test phrases, and
indexes every run of known words that is long enough to hold a phrase (no other part of a text can
match). Phrases are searched backwards, all at once, through the ranks of a wavelet matrix over the
Burrows-Wheeler transform; occurrences are located from sampled suffix positions; the words they cover
are merged into removal spans. Nothing is shuffled: a shard is a part of a Spark partition.

The phrases are a stated query set. They are read in blocks of at most `block_words` words, and each
block is broadcast by itself, so what a task holds does not grow with the benchmark.

Defined results: null and empty texts have no words; items without words never occur; repeated
documents and repeated items count each for itself; with an empty benchmark nothing is hit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideglass.llm._common import LOWER_WORDS, text_bytes

#: Words of documents that a shard holds at least before it is indexed (unless the partition ends).
SHARD_WORDS = 1 << 21
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ONE = np.uint64(1)


class Bits:
    """A bit vector with ranks: 64-bit words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded.reshape(-1, 8), axis=1, bitorder="little").reshape(-1, 8).copy().view("<u8").ravel()
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((ONE << bit) - ONE))

    def at(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & ONE).astype(np.int64)


class WaveletMatrix:
    """Symbols with rank and access; a level for each bit, high bits first, zeros before ones."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = []
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            ones = (symbols >> bit) & 1
            self.levels.append((bit, Bits(ones), int(len(ones) - ones.sum())))
            symbols = np.r_[symbols[ones == 0], symbols[ones == 1]]

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol is among the first i."""
        start = np.zeros_like(i)
        for bit, bits, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            before, upto = bits.rank(start), bits.rank(i)
            start = np.where(one, zeros + before, start - before)
            i = np.where(one, zeros + upto, i - upto)
        return i - start

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i, and how often it is among the first i."""
        symbol, start = np.zeros_like(i), np.zeros_like(i)
        for bit, bits, zeros in self.levels:
            one = bits.at(i).astype(bool)
            before, upto = bits.rank(start), bits.rank(i)
            symbol |= one.astype(np.int64) << bit
            start = np.where(one, zeros + before, start - before)
            i = np.where(one, zeros + upto, i - upto)
        return symbol, i - start


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of text; its zeros are separators, each distinct, in order of their places. By prefix doubling."""
    n = len(text)
    zero = text == 0
    start = np.where(zero, np.cumsum(zero), text + int(zero.sum()))
    rank = np.unique(start, return_inverse=True)[1].astype(np.int64)
    order, span = np.argsort(rank, kind="stable"), 1
    while n and rank[order[-1]] < n - 1:
        key = (rank + 1) * (n + 2)
        key[: max(0, n - span)] += rank[span:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
        span *= 2
    return order


class FMIndex:
    """text: symbols from 1 on, with a 0 after each run. Finds sequences of symbols inside runs."""

    def __init__(self, text: np.ndarray, sample: int = 16):
        order, top = suffix_array(text), int(text.max(initial=0))
        before = text[order - 1] if len(text) else text
        self.n, self.top = len(text), top
        self.less = np.r_[0, np.cumsum(np.bincount(text, minlength=top + 1))]
        self.matrix = WaveletMatrix(before, top)
        sampled = (order % sample == 0) | (before == 0)
        self.marks, self.places = Bits(sampled), order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[low, high) of the suffixes that begin with each row of phrases."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.flatnonzero((phrases <= self.top).all(axis=1))
        high[np.setdiff1d(np.arange(len(phrases)), live)] = 0
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, k]
            low[live] = self.less[symbol] + self.matrix.rank(symbol, low[live])
            high[live] = self.less[symbol] + self.matrix.rank(symbol, high[live])
            live = live[low[live] < high[live]]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of these suffixes: steps back until a sampled one."""
        place, steps, todo = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(todo):
            here = rows[todo]
            known = self.marks.at(here) == 1
            place[todo[known]] = self.places[self.marks.rank(here[known])] + steps
            todo, here = todo[~known], here[~known]
            symbol, count = self.matrix.access(here)
            rows[todo] = self.less[symbol] + count
            steps += 1
        return place


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of letters, digits and characters beyond ASCII."""
    return text.translate(LOWER_WORDS).split() if text else []


class Phrases:
    """A block of items as windows over a vocabulary."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.number: dict[bytes, int] = {}
        of: dict[tuple[int, ...], list[str]] = {}
        for item_id, item in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in item]
            for k in range(max(1, len(ids) - window + 1)) if ids else ():
                of.setdefault(tuple(ids[k : k + window]), []).append(item_id)
        by_length: dict[int, list[tuple[int, ...]]] = {}
        for phrase in of:
            by_length.setdefault(len(phrase), []).append(phrase)
        self.by_length = {n: (np.array(p, np.int64), [of[x] for x in p]) for n, p in by_length.items()}
        self.shortest = min(by_length, default=0)


def _occurrences(ids: np.ndarray, doc_starts: np.ndarray, phrases: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray, list[list[str]], int]]:
    """(first words, phrase numbers, items of the phrases, words) of all occurrences; ids: numbers of a shard's words, 0 if unknown."""
    known = ids > 0
    begins = known & ~np.r_[False, known[:-1]]
    begins[doc_starts[doc_starts < len(ids)]] |= known[doc_starts[doc_starts < len(ids)]]
    first = np.flatnonzero(begins)
    ends = np.flatnonzero(known & ~np.r_[known[1:] & ~begins[1:], False]) + 1
    long = ends - first >= phrases.shortest
    first, ends = first[long], ends[long]
    if not len(first) or not phrases.shortest:
        return
    size = ends - first + 1  # with the separator
    at = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(at, size) + np.repeat(first, size)
    last = at + size - 1
    place[last] = -1
    text = np.where(place < 0, 0, ids[place])
    index = FMIndex(text)
    for n, (rows, items) in phrases.by_length.items():
        low, high = index.search(rows)
        found = np.flatnonzero(low < high)
        count = (high - low)[found]
        suffix = np.repeat(low[found], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        yield place[index.locate(suffix)], np.repeat(found, count), items, n


def _char_spans(text: bytes, spans: list[tuple[int, int]]) -> list[dict]:
    """Spans of words as spans of code points."""
    at = [m.span() for m in _WORD.finditer(text)]
    chars = lambda n: len(text[:n].decode())
    return [{"start": chars(at[a][0]), "end": chars(at[b - 1][1])} for a, b in spans]


class _Searcher:
    """Searches shards of whole texts for all blocks of phrases."""

    def __init__(self, blocks: list, window: int):
        self.blocks, self.window, self.held = blocks, window, None

    def _phrases(self, k: int) -> Phrases:
        if len(self.blocks) > 1 or self.held is None:
            self.held = Phrases(self.blocks[k].value, self.window)
        return self.held

    def shard(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, list[set[str]], list[list[tuple[int, int]]]]:
        """For each text: its words, those hit, the items found, and the merged spans of words."""
        split = [words(t) for t in texts]
        sizes = np.array([len(w) for w in split], np.int64)
        starts = np.cumsum(sizes) - sizes
        total = int(sizes.sum())
        edges = np.zeros(total + 1, np.int64)
        items: list[set[str]] = [set() for _ in texts]
        for k in range(len(self.blocks)):
            phrases = self._phrases(k)
            number = phrases.number.get
            numbers = np.fromiter((number(w, 0) for ws in split for w in ws), np.int64, total)
            for place, phrase, of, n in _occurrences(numbers, starts, phrases):
                np.add.at(edges, place, 1)
                np.add.at(edges, place + n, -1)
                doc = np.searchsorted(starts, place, "right") - 1
                for pair in np.unique(doc * len(of) + phrase).tolist():
                    items[pair // len(of)].update(of[pair % len(of)])
        hit = np.cumsum(edges[:-1]) > 0
        spans, n_hit = [], np.zeros(len(texts), np.int64)
        for k, found in enumerate(items):
            own = hit[starts[k] : starts[k] + sizes[k]].astype(np.int8) if found else np.zeros(0, np.int8)
            n_hit[k] = own.sum()
            spans.append(np.flatnonzero(np.diff(np.r_[0, own, 0])).reshape(-1, 2).tolist())
        return sizes, n_hit, items, spans


def _gathered(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[pa.RecordBatch], list[bytes | None]]]:
    """Batches and their texts, gathered to shards of SHARD_WORDS words (counted as six bytes each) at least."""
    held, texts, size = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            new = list(text_bytes(part, column))
            held.append(part)
            texts += new
            size += sum(len(t or b"") // 6 + 1 for t in new)
            if size >= SHARD_WORDS:
                yield held, texts
                held, texts, size = [], [], 0
    if texts:
        yield held, texts


def _search(batches: Iterator[pa.RecordBatch], blocks: list, window: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    searcher = _Searcher(blocks, window)
    types = [id_type, pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
    for held, texts in _gathered(batches, 1):
        sizes, n_hit, items, spans = searcher.shard(texts)
        ids = [x for part in held for x in part.column(0).to_pylist()]
        columns = [ids, sizes, n_hit, [sorted(s) for s in items], [_char_spans(t, s) if s else [] for t, s in zip(texts, spans)]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "n_words", "n_hit", "items", "spans"])


def _clean(batches: Iterator[pa.RecordBatch], blocks: list, window: int, column: int) -> Iterator[pa.RecordBatch]:
    searcher = _Searcher(blocks, window)
    for held, texts in _gathered(batches, column):
        clean = searcher.shard(texts)[1] == 0
        at = 0
        for part in held:
            yield part.filter(pa.array(clean[at : at + part.num_rows]))
            at += part.num_rows


def _blocks(benchmark: DataFrame, block_words: int) -> list:
    """The items as broadcasts of at most about block_words words each."""
    context = benchmark.sparkSession.sparkContext
    blocks, block, size = [], [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).toLocalIterator():
        item = words(bytes(row[1]) if row[1] is not None else None)
        if item:
            block.append((row[0], item))
            size += len(item)
        if size >= block_words:
            blocks.append(context.broadcast(block))
            block, size = [], 0
    return [*blocks, context.broadcast(block)] if block or not blocks else blocks


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 1 << 20) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) of every row of docs.

    A window is `window` consecutive words of an item, or all words of a shorter one. items: the item_ids
    (as strings, sorted) with a window in the text; n_hit: words inside occurrences; spans: their merged
    places as code points [start, end). benchmark: item_id, text.
    """
    kind = dict(docs.dtypes)["doc_id"]
    cols = docs.select(F.col("doc_id").cast("bigint" if kind != "string" else kind).alias("doc_id"), F.col("text").cast("binary").alias("text"))
    run = partial(_search, blocks=_blocks(benchmark, block_words), window=window, id_type=pa.string() if kind == "string" else pa.int64())
    return cols.mapInArrow(run, f"doc_id {dict(cols.dtypes)['doc_id']}, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:int,end:int>>")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 1 << 20) -> DataFrame:
    """The rows of docs, all columns as they are, whose text holds no window of an item. Nothing is joined or shuffled."""
    run = partial(_clean, blocks=_blocks(benchmark, block_words), window=window, column=docs.columns.index("text"))
    return docs.mapInArrow(run, docs.schema)


def cut_spans(text: Column | str, spans: Column | str) -> Column:
    """text without its spans."""
    text, spans = (F.col(c) if isinstance(c, str) else c for c in (text, spans))
    empty = F.struct(F.lit("").alias("kept"), F.lit(0).alias("upto"))
    step = lambda acc, s: F.struct(F.concat(acc["kept"], F.substring(text, acc["upto"] + 1, s["start"] - acc["upto"])).alias("kept"), s["end"].alias("upto"))
    done = lambda acc: F.concat(acc["kept"], F.substring(text, acc["upto"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, empty, step, done)).otherwise(text)
