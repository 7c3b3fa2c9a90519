"""SimHash near-duplicates by a self-join of binary tries.

`signatures` gives each document one or more 64-bit SimHash words. `trie_edges` links distinct
signatures: it walks pairs of trie nodes downwards together, adds up the bits in which they differ,
and drops a pair of nodes once the error budget is exceeded. The top levels of the trie are spread
over Spark groups (one group per pair of prefixes within the budget, further down where signatures
crowd), the levels below are walked inside a task with numpy. Each task reports a spanning forest of its
links, never all pairs of a group. `components` joins the forests in Spark with star contraction.

Defined results: null and empty texts have no words and signature zero, and link like any other;
repeated rows get the same component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideglass.llm._common import LOWER_SPACED, staged, text_bytes

#: Odd multipliers that derive further 64-bit hashes of a shingle from its XXH64.
_MIX = [0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3]
#: Shingles whose bits are counted at once, and node pairs that a task walks at once.
_CHUNK, _FRONTIER = 1 << 15, 1 << 21
#: Bits of the map of ids that texts are filtered by before they are joined.
_SLOTS = 1 << 24


def _words_of(digests: bytes, n_words: int) -> np.ndarray:
    """SimHash words of the shingles with these big-endian XXH64 digests."""
    base = np.frombuffer(digests, ">u8").astype(np.uint64)
    out = np.zeros(n_words, np.uint64)
    for k in range(n_words):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(base), _CHUNK):
            h = base[at : at + _CHUNK]
            if k:
                h = h * np.uint64(_MIX[k - 1])
                h = (h ^ (h >> np.uint64(29))) * np.uint64(_MIX[k])
                h = h ^ (h >> np.uint64(32))
            ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
        out[k] = int.from_bytes(np.packbits(2 * ones > len(base)).tobytes(), "big")
    return out


def _digests(text: bytes | None, shingle: int) -> bytes:
    """Big-endian XXH64 digests of the shingles of a text."""
    from xxhash import xxh64_digest

    words = text.translate(LOWER_SPACED).split() if text else []
    if not words:
        return b""
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_digest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends.tolist()]
    return b"".join([xxh64_digest(joined[a : b - 1], 42) for a, b in zip(starts, starts[shingle:])])


def _signature(text: bytes | None, shingle: int, n_words: int) -> np.ndarray:
    return _words_of(_digests(text, shingle), n_words)


def _sign(batches: Iterator[pa.RecordBatch], shingle: int, n_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_signature(t, shingle, n_words) for t in text_bytes(batch, 1)]
        flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, n_words, np.int32)), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "sig"])


def signatures(docs: DataFrame, shingle: int = 3, n_words: int = 1) -> DataFrame:
    """(doc_id, sig array<bigint> of n_words SimHash words) of every whole text; words are runs of non-space, A-Z lower-cased."""
    cols = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return cols.mapInArrow(partial(_sign, shingle=shingle, n_words=n_words), f"doc_id {dict(cols.dtypes)['doc_id']}, sig array<bigint>")


# --- the walk inside a task ---------------------------------------------------------------------


def _levels(keys: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level from the root: child node ids [nodes, 2] (-1: none) and key counts of the nodes. keys: sorted, distinct."""
    levels = []
    starts = np.array([0]) if len(keys) else np.zeros(0, np.int64)
    for bit in range(bits - 1, -1, -1):
        prefix = keys >> np.uint64(bit)
        below = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]])
        parent = np.searchsorted(starts, below, "right") - 1
        child = np.full((len(starts), 2), -1, np.int32)
        child[parent, (prefix[below] & np.uint64(1)).astype(np.int64)] = np.arange(len(below))
        levels.append((child, np.diff(np.r_[starts, len(keys)])))
        starts = below
    return levels


def trie_pairs(left: np.ndarray, right: np.ndarray | None, bits: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of keys that differ in at most budget of their low bits; right None joins left with itself (i < j)."""
    own = right is None
    a = _levels(left, bits)
    b = a if own else _levels(right, bits)
    if not len(left) or not own and not len(right):
        return
    zero = np.zeros(1, np.int32)
    work = [(0, zero, zero, np.zeros(1, np.int8))]
    while work:
        level, u, v, errors = work.pop()
        if len(u) > _FRONTIER:
            half = len(u) // 2
            work += [(level, u[half:], v[half:], errors[half:]), (level, u[:half], v[:half], errors[:half])]
            continue
        if level == bits:
            keep = u != v if own else np.ones(len(u), bool)
            if keep.any():
                yield u[keep], v[keep]
            continue
        if own:
            several = (u != v) | (a[level][1][u] > 1)
            u, v, errors = u[several], v[several], errors[several]
        if not len(u):
            continue
        cu, cv = a[level][0][u], b[level][0][v]
        parts = []
        for x in (0, 1):
            for y in (0, 1):
                ok = (cu[:, x] >= 0) & (cv[:, y] >= 0)
                if x != y:
                    ok &= errors < budget
                    if own and x > y:
                        ok &= u != v
                parts.append((cu[ok, x], cv[ok, y], errors[ok] + np.int8(x != y)))
        work.append((level + 1, *(np.concatenate(p) for p in zip(*parts))))


def _union(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins i with j in label, which holds the smallest index of each group."""
    while True:
        p, q = label[i], label[j]
        apart = p != q
        if not apart.any():
            return
        i, j, p, q = i[apart], j[apart], p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def least_forest(n: int, i: np.ndarray, j: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which edges (i, j) make up a spanning forest of n points of least weight: each group takes its lightest edge, until none joins two groups."""
    order = np.argsort(weight, kind="stable")
    i, j = i[order], j[order]
    label, live, chosen = np.arange(n), np.arange(len(i)), []
    while True:
        p, q = label[i[live]], label[j[live]]
        live, p, q = live[p != q], p[p != q], q[p != q]
        if not len(live):
            return order[np.concatenate(chosen)] if chosen else order[:0]
        best = np.full(n, len(i))
        np.minimum.at(best, p, live)
        np.minimum.at(best, q, live)
        pick = np.unique(best[best < len(i)])
        chosen.append(pick)
        _union(label, i[pick], j[pick])


def _slice_keys(words: np.ndarray, place: int, bits: int) -> np.ndarray:
    """The bits of signatures [rows, words] from this place on."""
    word, start = divmod(place, 64)
    value = words[:, word] >> np.uint64(start)
    if start + bits > 64:
        value = value | words[:, word + 1] << np.uint64(64 - start)
    return value if bits == 64 else value & np.uint64((1 << bits) - 1)


def _walk_group(rows: pd.DataFrame, places: list[int], bits: int, budget: int, limit: int, sure: int) -> pd.DataFrame:
    """The links of one group: those of at most sure bits as a forest over its signatures, and a least forest of the others (unsure) between its trees."""
    words = np.array(rows["sig"].tolist(), np.int64).reshape(len(rows), -1).view(np.uint64)
    side, first = rows["side"].to_numpy(), rows.iloc[0]
    low = _slice_keys(words, places[first["trie"]], bits) & np.uint64((1 << (bits - int(first["depth"]))) - 1)
    at = [np.flatnonzero(side == s) for s in (0, 1)]
    own, apart = not first["two_sided"], int(first["apart"])
    node = rows["node"].to_numpy()
    if not len(at[0]) or not own and not len(at[1]):
        return pd.DataFrame({"a": node[:0], "b": node[:0], "unsure": np.zeros(0, bool)})
    keyed = []  # for each side: its distinct keys, and where the rows of each begin in the order of keys
    for k in at[:1] if own else at:
        order = k[np.argsort(low[k], kind="stable")]
        keys, starts = np.unique(low[order], return_index=True)
        keyed.append((keys, order, np.r_[starts, len(order)]))
    (ka, oa, sa), (kb, ob, sb) = keyed[0], keyed[-1]
    label = np.arange(len(rows))
    na, nb = np.diff(sa), np.diff(sb)
    held = [np.zeros((3, 0), np.int64)]  # unsure pairs: rows i, j and the bits between them

    def thin() -> None:
        i, j, apart_by = np.concatenate(held, axis=1)
        new = label[i] != label[j]
        i, j, apart_by = i[new], j[new], apart_by[new]
        keep = least_forest(len(rows), label[i], label[j], apart_by)
        i, j, apart_by = i[keep], j[keep], apart_by[keep]
        held[:] = [np.stack([i, j, apart_by])]

    def link(i: np.ndarray, j: np.ndarray) -> None:
        new = label[i] != label[j]
        i, j = i[new], j[new]
        bits_apart = np.bitwise_count(words[i] ^ words[j]).sum(axis=1, dtype=np.int64)
        near = bits_apart <= sure
        _union(label, i[near], j[near])
        if limit > sure:
            perhaps = ~near & (bits_apart <= limit)
            held.append(np.stack([i[perhaps], j[perhaps], bits_apart[perhaps]]))
            if sum(h.shape[1] for h in held[1:]) > _FRONTIER:
                thin()

    def link_keys(u: np.ndarray, v: np.ndarray) -> None:
        """Links the rows of keys u with those of keys v, slice by slice, leaving out keys whose rows are one group already."""
        most = 1 << 16
        while len(u):
            least_a, most_a, least_b, most_b = (f.reduceat(label[o], s[:-1]) for o, s in ((oa, sa), (ob, sb)) for f in (np.minimum, np.maximum))
            todo = (least_a[u] != most_a[u]) | (least_b[v] != most_b[v]) | (least_a[u] != least_b[v])
            u, v = u[todo], v[todo]
            upto = max(1, int(np.searchsorted(np.cumsum(na[u] * nb[v]), most, "right")))
            p, q, most = u[:upto], v[:upto], min(2 * most, _FRONTIER)
            u, v = u[upto:], v[upto:]
            size = na[p] * nb[q]
            within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            width = np.repeat(nb[q], size)
            link(oa[np.repeat(sa[p], size) + within // width], ob[np.repeat(sb[q], size) + within % width])

    if own:  # rows with equal keys but other bits elsewhere
        for k in np.flatnonzero(na > 1):
            same = oa[sa[k] : sa[k + 1]]
            for at_row in range(len(same) - 1):
                rest = same[at_row + 1 :]
                link(np.full(len(rest), same[at_row]), rest)
    for u, v in trie_pairs(ka, None if own else kb, bits - int(first["depth"]), budget - apart):
        link_keys(u, v)
    thin()
    moved = np.flatnonzero(label != np.arange(len(rows)))
    p, q, _ = held[0]
    return pd.DataFrame({"a": np.r_[node[moved], node[p]], "b": np.r_[node[label[moved]], node[q]], "unsure": np.r_[np.zeros(len(moved), bool), np.ones(len(p), bool)]})


def spread_depth(n: int, bits: int, node_size: int) -> int:
    """Levels of a trie of n keys above the nodes of about node_size keys."""
    return min(bits - 1, max(0, math.ceil(math.log2(max(1, n) / node_size))))


def _places(tables: int, bits: int, width: int) -> list[int]:
    """Where the slices of the tries begin: side by side, or spread evenly with overlap."""
    return [t * bits if tables * bits <= width else round(t * (width - bits) / (tables - 1)) for t in range(tables)]


def tries_needed(width: int, bits: int, above: int, budget: int, apart: float, recall: float, pairs: int = 20_000) -> int:
    """Tries (no error in their levels above) that find this share of pairs whose bits differ with probability apart, by simulation: slices may overlap."""
    differ = np.random.default_rng(0).random((pairs, width)) < apart
    upto = np.c_[np.zeros(pairs, np.int32), np.cumsum(differ, axis=1, dtype=np.int32)]
    for tables in range(1, width - bits + 1):
        at = np.array(_places(tables, bits, width))
        split, end = at + bits - above, at + bits
        if ((upto[:, end] == upto[:, split]) & (upto[:, split] - upto[:, at] <= budget)).any(axis=1).mean() >= recall:
            return tables
    return max(1, width - bits)


def _key(place: int, bits: int):
    """The bits of the column sig from this place on."""
    word, start = divmod(place, 64)
    value = F.shiftrightunsigned(F.col("sig")[word], start)
    if start + bits > 64:
        value = value.bitwiseOR(F.shiftleft(F.col("sig")[word + 1], 64 - start))
    return value if bits == 64 else value.bitwiseAND((1 << bits) - 1)


def _deeper(rows: DataFrame, bits: int, depth: int, step: int, budget: int) -> DataFrame:
    """rows (trie, key, own, other, ...) of pairs of trie nodes at this depth, moved to the pairs of their children `step` levels below within the budget."""
    masks = [sum(1 << k for k in c) for r in range(min(budget, step) + 1) for c in combinations(range(step), r)]
    below = F.shiftrightunsigned("key", bits - depth - step).bitwiseAND((1 << step) - 1)
    apart = F.bit_count(F.col("own").bitwiseXOR(F.col("other"))) + F.bit_count("mask")
    rows = rows.withColumn("mask", F.explode(F.array(*(F.lit(m).cast("long") for m in masks)))).where(apart <= budget)
    rows = rows.withColumn("own", F.shiftleft("own", step).bitwiseOR(below)).withColumn("other", F.shiftleft("other", step).bitwiseOR(below.bitwiseXOR(F.col("mask"))))
    return rows.drop("mask")


def trie_edges(nodes: DataFrame, n: int, tables: int, bits: int, budget: int, limit: int, node_size: int = 1 << 15, strict: bool = False, width: int = 64, sure: int | None = None) -> DataFrame:
    """Edges (a, b, unsure) that connect all nodes linked by a trie.

    nodes: (node, sig), one row per distinct signature of `width` bits, n of them. Each of `tables` tries holds
    `bits` bits of the signature; their places are spread evenly over it. Two nodes link if they differ in at
    most `budget` bits of some trie (none of them in its levels above the groups, if strict) and in at most
    `limit` bits of the whole signature. Pairs of at most `sure` bits (default: limit) are linked; between the trees of
    these a least forest of the other pairs is reported as unsure.

    A group is a pair of trie nodes. It holds about node_size keys a side; where signatures crowd and it holds more
    than four times that, the pair is walked further down in Spark, until its parts are smaller. Rows that share all
    of a trie's bits are dealt over pairs of blocks instead.
    """
    depth, most = spread_depth(n, bits, node_size), 4 * node_size
    places = _places(tables, bits, width)
    rows = nodes.select("node", "sig", F.posexplode(F.array(*(_key(p, bits) for p in places))).alias("trie", "key"))
    zero = F.lit(0).cast("long")
    if strict or not depth:
        top = F.shiftrightunsigned("key", bits - depth) if depth else zero
        rows = rows.withColumn("own", top).withColumn("other", top)
    else:
        rows = _deeper(rows.withColumn("own", zero).withColumn("other", zero), bits, 0, depth, budget)
    lo, hi = F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")
    parts = []
    while True:
        sizes = rows.groupBy("trie", lo, hi).agg(F.count("*").alias("__n")).where(F.col("__n") > most)
        hot = staged(sizes.select(F.col("trie").alias("__trie"), F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), F.ceil(F.col("__n") / most).cast("int").alias("blocks")))
        if not hot.limit(1).count():
            parts.append((depth, rows, False))
            break
        same = (F.col("trie") == F.col("__trie")) & (F.least("own", "other") == F.col("__lo")) & (F.greatest("own", "other") == F.col("__hi"))
        parts.append((depth, rows.join(hot, same, "left_anti"), False))
        rows = rows.join(hot, same).drop("__trie", "__lo", "__hi")
        step = min(4, bits - depth)
        if not step:
            parts.append((depth, rows, True))
            break
        rows = _deeper(rows.drop("blocks"), bits, depth, step, budget)
        depth += step
    side = (F.col("own") > F.col("other")).cast("int")
    dealt = []
    for d, part, in_blocks in parts:
        part = part.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int") if in_blocks else F.lit(0))
        part = part.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)) if in_blocks else F.lit(0))
        one = F.col("own") == F.col("other")
        dealt.append(
            part.select(
                "trie", F.lit(d).alias("depth"), lo, hi, "node", "sig", F.bit_count(F.col("own").bitwiseXOR(F.col("other"))).cast("int").alias("apart"),
                F.when(one | (side == 0), F.when(one, F.least("block", "with")).otherwise(F.col("block"))).otherwise(F.col("with")).alias("x"),
                F.when(one | (side == 0), F.when(one, F.greatest("block", "with")).otherwise(F.col("with"))).otherwise(F.col("block")).alias("y"),
                F.when(one, (F.col("block") > F.col("with")).cast("int")).otherwise(side).alias("side"),
                (~one | (F.col("block") != F.col("with"))).alias("two_sided"),
            )
        )
    walk = partial(_walk_group, places=places, bits=bits, budget=budget, limit=limit, sure=limit if sure is None else sure)
    spread = dealt[0]
    for part in dealt[1:]:
        spread = spread.unionByName(part)
    return spread.groupBy("trie", "depth", "lo", "hi", "x", "y").applyInPandas(lambda rows: walk(rows), "a bigint, b bigint, unsure boolean")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of edges (a, b); large-star and small-star rounds until nothing moves."""
    edges = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or not state["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = staged(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())


def link_documents(
    docs: DataFrame, shingle: int = 3, n_words: int = 1, bits: int | None = 64, budget: int = 2, limit: int = 2, recall: float = 0.99, similarity: float | None = None, node_size: int = 1 << 15, sure: int | None = None
) -> DataFrame:
    """(doc_id, sig, component_id) of every row of docs; component_id is the smallest doc_id reachable over links.

    bits None takes log2(n) + 6 bits a trie, so that chance pairs stay in proportion to n, lets errors only below
    the levels that are spread over groups, so that each trie ships a signature once, and takes as many tries as
    find a pair of this similarity with this recall. With sure, pairs of more than sure bits link only if the Jaccard
    similarity of their shingles is at least similarity (see checked_edges).
    """
    signed = staged(signatures(docs, shingle, n_words))
    # numbered once, when it is written: no two signatures share a node
    nodes = staged(signed.groupBy("sig").agg(F.min("doc_id").alias("first_id")).withColumn("node", F.monotonically_increasing_id()))
    n = nodes.count()
    tables, strict, width = 1, bits is None, 64 * n_words
    if strict:
        bits = min(62, max(12, math.ceil(math.log2(max(2, n))) + 6))
        above = spread_depth(n, bits, node_size)
        tables = tries_needed(width, bits, above, budget, math.acos(2 * similarity / (1 + similarity)) / math.pi, recall)
    edges = trie_edges(nodes.select("node", "sig"), n, tables, bits, budget, limit, node_size, strict, width, sure)
    if sure is not None:
        repeated = signed.groupBy("doc_id").agg(F.count("*").alias("__n")).where("__n > 1").limit(1).count() > 0
        edges = checked_edges(staged(edges), nodes, docs, shingle, n_words, limit, similarity, repeated=repeated)
    roots = components(edges)
    rooted = staged(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    first = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_sig = staged(rooted.join(first, "root").select("sig", "component_id"))
    return signed.join(of_sig, "sig").select("doc_id", "sig", "component_id")


def _sets(batches: Iterator[pa.RecordBatch], shingle: int, n_words: int) -> Iterator[pa.RecordBatch]:
    """Rows (root, label, node, sig, text, blocks) with the text's distinct shingle hashes instead of it; texts of another signature go."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            digests = [_digests(t, shingle) for t in text_bytes(part, 4)]
            same = [_words_of(d, n_words).view(np.int64).tolist() == sig for d, sig in zip(digests, part.column(3).to_pylist())]
            sets = pa.array([np.unique(np.frombuffer(d, ">u8").astype(np.uint64)).tobytes() for d in digests], pa.binary())
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(4)), sets, part.column(5)], ["root", "label", "node", "sig", "shingles", "blocks"]).filter(pa.array(same, pa.bool_()))


def _link_group(rows: pd.DataFrame, limit: int, similarity: float) -> pd.DataFrame:
    """Edges (a, b) between the known components of a block, or of two, whose texts have this similarity: candidate pairs in order of their bits, until all are joined."""
    words = np.array(rows["sig"].tolist(), np.int64).view(np.uint64)
    node, side, own = rows["node"].to_numpy(), rows["side"].to_numpy(), not rows["two_sided"].iloc[0]
    sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
    of = np.unique(rows["label"].to_numpy(), return_inverse=True)[1]
    label, out = list(range(int(of.max()) + 1)), []
    candidates = [np.zeros((3, 0), np.int64)]
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if own else 1))
    for i in left:
        others = right[right > i] if own else right
        others = others[of[others] != of[i]]
        apart = np.bitwise_count(words[others] ^ words[i]).sum(axis=1, dtype=np.int64)
        near = apart <= limit
        candidates.append(np.stack([np.full(int(near.sum()), i), others[near], apart[near]]))
    pairs = np.concatenate(candidates, axis=1)

    def root(k: int) -> int:
        while label[k] != k:
            label[k] = label[label[k]]
            k = label[k]
        return k

    for k in np.argsort(pairs[2], kind="stable").tolist():
        i, j = int(pairs[0, k]), int(pairs[1, k])
        p, q = root(of[i]), root(of[j])
        if p == q:
            continue
        x, y = sets[i], sets[j]
        least = similarity * max(len(x), len(y))
        if min(len(x), len(y)) < least:
            continue
        both = len(np.intersect1d(x, y, assume_unique=True))
        if both >= similarity * (len(x) + len(y) - both):
            label[max(p, q)] = min(p, q)
            out.append((node[i], node[j]))
    return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)


def marked(rows: DataFrame, ids: DataFrame, key: Column | str = "doc_id") -> DataFrame:
    """rows and __maybe: whether the key has the hash of one of ids, so that few others are shuffled to a join with these.

    The hashes are a bit map of _SLOTS bits: what is broadcast is at most _SLOTS / 64 rows, whatever the number of ids.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(_SLOTS))  # noqa: E731  of a column or its name
    bit = lambda c: F.expr(f"shiftleft(1L, CAST({c} % 64 AS INT))")
    marks = ids.select(slot(ids.columns[0]).alias("__s")).select((F.col("__s") / 64).cast("int").alias("__word"), bit("__s").alias("__bit"))
    marks = marks.groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    near = rows.withColumn("__s", slot(key)).withColumn("__w", (F.col("__s") / 64).cast("int"))
    near = near.join(F.broadcast(marks), F.col("__w") == F.col("__word"), "left")
    return near.select(*rows.columns, (F.coalesce("__bits", F.lit(0).cast("long")).bitwiseAND(bit("__s")) != 0).alias("__maybe"))


def checked_edges(edges: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, n_words: int, limit: int, similarity: float, block: int = 1 << 10, repeated: bool = True) -> DataFrame:
    """Edges (a, b): the sure ones of edges (a, b, unsure), and those between their components that the exact similarity of texts makes.

    Unsure edges join sure components to candidate components, outside of which no candidate pair lies. Each text of a
    candidate component with unsure edges is read once, as its set of shingle hashes, and all its pairs of at most
    `limit` bits between sure components are compared inside one task, or, beyond `block` texts, in one task for each pair of blocks.
    repeated: whether rows of one doc_id may hold one text several times.
    """
    sure = staged(edges.where("NOT unsure").select("a", "b"))
    label = staged(components(sure))
    root = staged(components(edges.select("a", "b")))
    of = lambda name: label.select(F.col("node").alias(name), F.col("root").alias(f"{name}_label"))
    open_edges = edges.where("unsure").join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("a_label", "a") != F.coalesce("b_label", "b"))
    torn = open_edges.join(root.withColumnRenamed("node", "a"), "a", "left").select(F.coalesce("root", "a").alias("root")).distinct()
    members = root.join(torn, "root", "left_semi").unionByName(torn.select(F.col("root").alias("node"), "root"))
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    need = nodes.join(members.join(sizes, "root"), "node").join(label.withColumnRenamed("root", "label"), "node", "left")
    need = staged(need.select(F.col("first_id").alias("__id"), "root", F.coalesce("label", "node").alias("label"), "node", "sig", "blocks"))
    texts = marked(docs.select("doc_id", F.col("text").cast("binary").alias("__text")), need.select("__id")).where("__maybe")
    rows = texts.join(need, F.col("doc_id").eqNullSafe(F.col("__id"))).select("root", "label", "node", "sig", "__text", "blocks")
    sets = rows.mapInArrow(partial(_sets, shingle=shingle, n_words=n_words), "root bigint, label bigint, node bigint, sig array<bigint>, shingles binary, blocks int")
    if repeated:
        sets = sets.dropDuplicates(["node"])
    sets = sets.withColumn("number", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    sets = sets.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = sets.select(
        "root", F.least("number", "with").alias("x"), F.greatest("number", "with").alias("y"), (F.col("number") > F.col("with")).cast("int").alias("side"),
        (F.col("number") != F.col("with")).alias("two_sided"), "label", "node", "sig", "shingles",
    )
    link = partial(_link_group, limit=limit, similarity=similarity)
    return sure.unionByName(dealt.groupBy("root", "x", "y").applyInPandas(lambda rows: link(rows), "a bigint, b bigint"))


def near_dedup(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, n_words: int = 6) -> DataFrame:
    """docs without the near copies: one row, that of the smallest doc_id (among equal ids: of the smallest text hash), of each group of texts stays.

    Rows are told apart by doc_id and text, so that rows of one id with different texts are judged each for itself, and
    rows equal in both count as copies.

    A pair of this similarity (Jaccard, of sets of shingles) differs in acos(2 s / (1 + s)) / pi of n_words * 64
    SimHash bits on average. Pairs up to three standard deviations above are candidates, which their exact similarity
    decides; those four below are taken without. Bits, depth and number of tries follow the number of texts; candidates
    at the limit are found with a recall of 0.99 at any size, so a single pair there may be found in one table and not in another.
    """
    apart = math.acos(2 * similarity / (1 + similarity)) / math.pi
    mean, deviation = 64 * n_words * apart, math.sqrt(64 * n_words * apart * (1 - apart))
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("hash")).alias("doc_id"), "text")
    linked = link_documents(keyed, shingle, n_words, None, 2, math.ceil(mean + 3 * deviation), 0.99, similarity, 1 << 17, math.floor(mean - 4 * deviation))
    # the rows that go are few and the texts are wide: only rows that may be of such a key are shuffled
    own = F.col("doc_id").eqNullSafe(F.col("component_id"))
    kept = staged(linked.groupBy("doc_id").agg(F.count_if(own).alias("__rows")).where("__rows <> 1"))
    key = F.struct("doc_id", F.xxhash64("text").alias("hash"))
    gone, twice = (kept.where(c).select(F.col("doc_id").alias("__id")) for c in ("__rows = 0", "__rows > 1"))
    split = marked(docs, kept.select(F.col("doc_id").alias("__id")), key)
    perhaps = split.where("__maybe").drop("__maybe").withColumn("__key", key)
    same = F.col("__key").eqNullSafe(F.col("__id"))
    rest = perhaps.join(gone, same, "left_anti")
    once = rest.join(twice, same, "left_semi").dropDuplicates(["__key"])
    return split.where("NOT __maybe").drop("__maybe").unionByName(rest.join(twice, same, "left_anti").unionByName(once).drop("__key"))


def hex_fingerprint(column: str = "sig"):
    return F.lpad(F.lower(F.hex(F.col(column)[0])), 16, "0")
