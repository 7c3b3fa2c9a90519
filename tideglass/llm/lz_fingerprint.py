"""Document fingerprints: the phrases of a Lempel-Ziv parse, compared by minimum hashes.

A text is cut into phrases as LZ78 does: each is the longest phrase seen before and one more character (code point).
Two texts that compress each other well share many phrases. The fingerprint holds, for each of N_HASHES hash
functions, 16 bits of the least hash of the phrase set; the share of equal ones estimates the sets' Jaccard similarity.

Neighbours in doc_id order are needed without a global sort of the texts: ids alone are range-partitioned, the least id of
each partition becomes a cut, and each text goes to the part that its id falls in, those at a cut to the part before as
well. Parts are streamed in order, two texts at a time.

Definitions. Null texts count as empty; an empty text has no phrase and the fingerprint of the empty set, alike (1.0) to
itself alone. Null ids come first. Rows of one id go by the digest of their text and stay in one part. Repeated rows come
back once each. The row after the last is the first, so a lone row is its own next. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideglass.llm._common import parallelism

#: Hash functions of a fingerprint, and hex digits of each.
N_HASHES, DIGITS = 128, 4
_MASK = (1 << 64) - 1
#: Bits of a code point.
_CODE = 21
#: The odd multiplier of phrase hashes, the constants of a public 64-bit finalizer, and an odd multiplier for each hash function.
_GROW = 0x9E3779B97F4A7C15
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_FUNCTIONS = np.random.default_rng(13).integers(0, 1 << 63, N_HASHES, np.uint64) * np.uint64(2) + np.uint64(1)


def parse(codes: list[int], trie: dict[int, int], node: int = 0) -> int:
    """Adds the phrases of these code points to the trie; returns the node of the phrase that is still open (0: none).

    The trie maps a node and a code point, in the low _CODE bits, to the node of the longer phrase; the k-th key is phrase k.
    """
    get, last = trie.get, len(trie) << _CODE
    for c in codes:
        key = node | c
        grown = get(key)
        if grown is None:
            last += 1 << _CODE
            trie[key] = last
            node = 0
        else:
            node = grown
    return node


def phrase_hashes(trie: dict[int, int], known: np.ndarray) -> np.ndarray:
    """The hashes of the empty phrase and all phrases of the trie; known: those of the first ones. A phrase's hash comes of its prefix's and its last character."""
    keys = np.fromiter(trie, np.int64, len(trie))
    above, codes = keys >> _CODE, (keys & ((1 << _CODE) - 1)).astype(np.uint64)
    out, done = np.zeros(len(keys) + 1, np.uint64), np.zeros(len(keys) + 1, bool)
    out[: len(known)], done[: len(known)] = known, True
    left = np.arange(len(known) - 1, len(keys))
    while len(left):
        ready = done[above[left]]
        now, left = left[ready], left[~ready]
        out[now + 1] = _mixed(out[above[now]] + (codes[now] + np.uint64(1)) * np.uint64(_GROW))
        done[now + 1] = True
    return out


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    """The least hash of each function."""
    least = np.full(N_HASHES, _MASK, np.uint64)
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[at : at + 1024, None] * _FUNCTIONS).min(axis=0))
    return least


def signature(least: np.ndarray, n_phrases: int) -> np.ndarray:
    """16 bits of each least hash; of no phrases: all ones."""
    if not n_phrases:
        return np.full(N_HASHES, 0xFFFF, np.uint16)
    return (_mixed(least) >> np.uint64(48)).astype(np.uint16)  # the high bits of a least hash are mostly zeros


def _mixed(hashes: np.ndarray) -> np.ndarray:
    for factor in _MIX:
        hashes = (hashes ^ hashes >> np.uint64(33)) * factor
    return hashes ^ hashes >> np.uint64(33)


def to_hex(found: np.ndarray) -> str:
    return found.astype(">u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """The share of equal minima of two fingerprints, 0 to 1."""
    return sum(a[k : k + DIGITS] == b[k : k + DIGITS] for k in range(0, len(a), DIGITS)) / N_HASHES


def _codes(text: str) -> list[int]:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).tolist()


class _Document:
    """A text on its way: its code points, the trie of its first three quarters, and its whole fingerprint."""

    def __init__(self, doc_id, text: str) -> None:
        self.doc_id, self.codes, self.text = doc_id, _codes(text), text
        self.cut = len(self.codes) - len(self.codes) // 4
        self.head: dict[int, int] = {}
        self.open = parse(self.codes[: self.cut], self.head)
        self.hashes = phrase_hashes(self.head, np.zeros(1, np.uint64))
        self.least = least_hashes(self.hashes[1:])
        self.found = self._with(self.codes[self.cut :])

    def _with(self, tail: list[int]) -> np.ndarray:
        """The fingerprint of the first three quarters followed by tail."""
        trie = dict(self.head)
        parse(tail, trie, self.open)
        hashes = phrase_hashes(trie, self.hashes)
        return signature(np.minimum(self.least, least_hashes(hashes[len(self.hashes) :])), len(trie))

    def edited(self, next_: _Document) -> tuple[str, np.ndarray]:
        """The text with its last quarter replaced by the beginning of the next, and its fingerprint."""
        few = len(self.codes) - self.cut
        return self.text[: self.cut] + next_.text[:few], self._with(next_.codes[:few])


_SCHEMA = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _fingerprints(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows (part, ahead, doc_id, text) in order; those ahead are the next of the part's last."""
    types = [kind, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
    names = ["doc_id", *(x.split()[0] for x in _SCHEMA.split(", "))]
    before: _Document | None = None
    of, done, size = None, [], 0

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(types)], names)
        done.clear()
        return out

    for batch in batches:
        for part, ahead, doc_id, text in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3)):
            if part != of:
                of, before = part, None
            if ahead and before is None:
                continue  # the part's rows ahead are done
            now = _Document(doc_id, text.as_py() or "")
            if before:
                text_, found = before.edited(now)
                same = lambda x, y: float((x == y).sum()) / N_HASHES
                done.append((before.doc_id, len(before.codes), hashlib.sha256(text_.encode("utf-8", "surrogatepass")).hexdigest(), to_hex(before.found), to_hex(found), same(before.found, found), same(before.found, now.found)))
                if len(done) == 2000:
                    yield flush()
            before = None if ahead else now
    if done:
        yield flush()


def _part(cuts: list, column: Column) -> Column:
    """The number of the part that an id falls in: the last cut that is not above it, by bisection (nulls first)."""
    if len(cuts) == 1:
        return F.lit(0)
    known = F.array(*(F.lit(c) for c in cuts[1:]))
    halves = F.array(*(F.lit(1 << k) for k in reversed(range((len(cuts) - 1).bit_length()))))
    return F.aggregate(halves, F.lit(0), lambda at, k: at + F.when(F.coalesce(F.get(known, at + k - 1) <= column, F.lit(False)), k).otherwise(0))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, {_SCHEMA}"
    rows = docs.select("doc_id", "text")
    ids = rows.select("doc_id").repartitionByRange(parallelism(docs.sparkSession) * 4, F.asc_nulls_first("doc_id"))
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("id"))).alias("first")
    firsts = sorted((tuple(r["first"]) for r in ids.groupBy(F.spark_partition_id()).agg(first).collect()), key=lambda r: (r[0], r[1] if r[0] else 0))
    cuts = [r[1] for r in firsts]
    if not cuts:
        return rows.sparkSession.createDataFrame([], schema)
    part = _part(cuts, F.col("doc_id"))
    same = F.col("doc_id").eqNullSafe
    # the rows of a part's least id go to the part before too, those of the first to the last; the least id may be one of rows with equal ids
    at_cut = F.when(F.lit(len(cuts) > 1) & (F.col("__part") > 0), F.get(F.array(*(F.lit(c) for c in cuts)), F.col("__part")).eqNullSafe(F.col("doc_id"))).otherwise(same(F.lit(cuts[0])))
    before = F.when(F.col("__part") > 0, F.col("__part") - 1).otherwise(len(cuts) - 1)
    where = F.array(F.struct(F.col("__part").alias("part"), F.lit(0).alias("ahead")))
    both = F.array(F.struct(F.col("__part").alias("part"), F.lit(0).alias("ahead")), F.struct(before.alias("part"), F.lit(1).alias("ahead")))
    dealt = rows.withColumn("__part", part).withColumn("__to", F.explode(F.when(at_cut, both).otherwise(where)))
    dealt = dealt.select("__to.part", "__to.ahead", "doc_id", F.coalesce("text", F.lit("")).alias("text")).repartition("part")
    dealt = dealt.sortWithinPartitions("part", "ahead", F.asc_nulls_first("doc_id"), F.xxhash64("text"))
    return dealt.mapInArrow(partial(_fingerprints, kind=to_arrow_type(kind)), schema)
