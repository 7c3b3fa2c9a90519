"""Text and vector retrieval: BM25, exact top-k by cosine, hybrid scores, rank fusion, quotas, context packing."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideglass.operators import products
from tideglass.operators.ordered import in_order_by

#: BM25's constants, the weight of a source's authority, and rank fusion's constant.
K1, B = 1.5, 0.75
AUTHORITY = {1: 1.0, 2: 0.95, 3: 0.85, 4: 0.75}
RRF_K = 60
#: Vectors that are compared with a block of queries at a time.
SLICE = 2048


def bm25(chunks: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, chunk_id, score) of chunks that share a term with a query.

    chunks: chunk_id, tokens. queries: query_id, tokens (a repeated term counts repeatedly), a stated set that is
    compared in blocks. Statistics are those of all chunks; only document frequencies are shuffled.
    """
    return _bm25_pairs(chunks, queries, k1, b, ["chunk_id"], None).select("query_id", F.col("id.chunk_id").alias("chunk_id"), "score")


def bm25_best(chunks: DataFrame, queries: DataFrame, k: int, keys: Sequence[str] = (), prior: Column | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, chunk_id, keys, score): of bm25 those that can be among a query's k best of each of keys (columns of chunks) by score times prior, when both are rounded to six places. A batch of chunks sends on its own best alone."""
    of = ["chunk_id", *keys] if prior is None else ["chunk_id", *keys, "__prior"]
    chunks = chunks if prior is None else chunks.withColumn("__prior", prior)
    found = _bm25_pairs(chunks, queries, k1, b, of, partial(_leading, k=k, keys=list(keys), prior=prior is not None))
    return found.select("query_id", *(F.col(f"id.{c}").alias(c) for c in ["chunk_id", *keys]), "score")


def _bm25_pairs(chunks: DataFrame, queries: DataFrame, k1: float, b: float, of: Sequence[str], keep) -> DataFrame:
    n_all, mean_length = chunks.agg(F.count("*"), F.avg(F.size("tokens"))).first()
    rows = products.texts(chunks, of)
    near = products.frequencies(rows).select(F.col("term").alias("asked"), "term", "df", F.lit(1.0).alias("worth"))
    asked = products.asked_by(queries, ["query_id"]).withColumn("n", F.lit(0))
    find = partial(_bm25_found, mean_length=mean_length, k1=k1, b=b, keep=keep)
    return products.pairs(rows.select(F.struct(*of).alias("id"), "texts"), asked, near, n_all, find, "score double")


def _bm25_found(s: products.Slice, block: products.Block, mean_length: float, k1: float, b: float, keep):
    score = products.parts(s, block, mean_length, k1, b, best=False) @ block.times
    r, q = np.nonzero((score > 0) & keep(s, score) if keep else score > 0)
    return r, q, [("score", pa.array(score[r, q]))]


def _leading(s: products.Slice, score: np.ndarray, k: int, keys: list[str], prior: bool) -> np.ndarray:
    """Which scores can be among a query's k best of their keys in these rows, rounding included."""
    ids = s.rows.column(s.rows.schema.get_field_index("id"))
    ranked = score * pc.struct_field(ids, "__prior").to_numpy(zero_copy_only=False)[:, None] if prior else score
    kinds = np.zeros(len(ids), np.int64)
    for c in keys:
        code = pc.struct_field(ids, c).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        kinds = np.unique(kinds * (code.max(initial=0) + 1) + code, return_inverse=True)[1]
    keep = np.zeros(score.shape, bool)
    for kind in range(kinds.max(initial=-1) + 1):
        at = np.flatnonzero(kinds == kind)
        few = min(k, len(at))
        keep[at] = ranked[at] >= np.partition(ranked[at], -few, axis=0)[-few] - 4e-6
    return keep


def top_k(scored: DataFrame, keys: Sequence[str], order: Sequence, k: int, rank: str = "rank") -> DataFrame:
    return scored.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def authority(score: Column, level: Column) -> Column:
    """The score times the prior of its source's authority level (1 to 4; others as 4)."""
    prior = F.lit(AUTHORITY[4])
    for k in (3, 2, 1):
        prior = F.when(level == k, AUTHORITY[k]).otherwise(prior)
    return score * prior


def quota(ranked: DataFrame, keys: Sequence[str], group: str, order: Sequence, per_group: int, k: int) -> DataFrame:
    """The k best of each key with at most per_group of a group."""
    few = top_k(ranked, [*keys, group], order, per_group, "__place").drop("__place")
    return top_k(few, keys, order, k)


def _best(batches: Iterator[pa.RecordBatch], queries, k: int) -> Iterator[pa.RecordBatch]:
    """Candidates of a batch for each query of a block. Vectors that are null, of another length than the queries' or not finite have no cosine with them and are no candidates. A batch is compared by slices: the scores held don't grow with it."""
    ids, matrix = queries.value
    for whole in batches:
        for start in range(0, whole.num_rows, SLICE):
            batch = whole.slice(start, SLICE)
            listed = batch.column(1)
            rows = np.zeros((len(listed), matrix.shape[1]))
            known = pc.fill_null(pc.equal(pc.list_value_length(listed), matrix.shape[1]), False).to_numpy(zero_copy_only=False)
            rows[known] = pc.list_flatten(listed.filter(pa.array(known))).to_numpy(zero_copy_only=False).reshape(-1, matrix.shape[1])
            known &= np.isfinite(rows).all(axis=1)
            if not known.any():
                continue
            rows, own = rows[known], batch.column(0).to_numpy(zero_copy_only=False)[known]
            norm = np.linalg.norm(rows, axis=1)
            score = matrix @ (rows / np.where(norm > 0, norm, 1)[:, None]).T
            few = min(k, score.shape[1])
            # ties at the cut stay: all that reach the k-th score go on
            least = np.partition(score, -few, axis=1)[:, -few][:, None]
            q, r = np.nonzero(score >= least - 1e-9)
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(own[r]), pa.array(score[q, r])], ["query_id", "id", "score"])


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int, block: int = 1024) -> DataFrame:
    """(query_id, id, score, rank): the k vectors of highest cosine for each query, exactly; ties by id.

    vectors: id, vector. queries: query_id, vector, a stated set that is compared in blocks of `block`
    vectors, so what is broadcast does not grow with it. Each batch of rows sends on its own best k only.
    """
    context = vectors.sparkSession.sparkContext
    found, held = [], []

    def flush() -> None:
        ids, matrix = np.array([r[0] for r in held]), np.array([r[1] for r in held], float)
        norm = np.linalg.norm(matrix, axis=1)
        queries_block = context.broadcast((ids, matrix / np.where(norm > 0, norm, 1)[:, None]))
        found.append(vectors.select("id", "vector").mapInArrow(partial(_best, queries=queries_block, k=k), "query_id bigint, id bigint, score double"))
        held.clear()

    for row in queries.where("vector is not null").select("query_id", "vector").toLocalIterator():
        held.append(row)
        if len(held) == block:
            flush()
    if held or not found:
        if not held:
            return vectors.sparkSession.createDataFrame([], "query_id bigint, id bigint, score double, rank int")
        flush()
    everything = found[0]
    for more in found[1:]:
        everything = everything.unionByName(more)
    return top_k(everything.withColumn("score", F.round("score", 9)), ["query_id"], [F.desc("score"), "id"], k)


def max_normalize(rows: DataFrame, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """score / the key's highest score; all 0 where that is not positive."""
    top = F.max(score).over(Window.partitionBy(*keys))
    return rows.withColumn(score, F.when(top > 0, F.col(score) / top).otherwise(0.0))


def hybrid(accurate: DataFrame, semantic: DataFrame, weight: float, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """weight * normalized accurate + (1 - weight) * normalized semantic score; a list that lacks an id gives 0. Inputs: keys, id, score."""
    a = max_normalize(accurate, "score", keys).select(*keys, "id", F.col("score").alias("a"))
    s = max_normalize(semantic, "score", keys).select(*keys, "id", F.col("score").alias("s"))
    both = a.join(s, [*keys, "id"], "full")
    return both.select(*keys, "id", (weight * F.coalesce("a", F.lit(0.0)) + (1 - weight) * F.coalesce("s", F.lit(0.0))).alias("score"))


def rrf(lists: DataFrame, keys: Sequence[str] = (), k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (keys, list_no, pos, id): sum of 1 / (k + rank).

    Rank is the place in its list; an id that a list repeats counts at its first place, and the places after
    it do not move up. Order: score, best rank, id.
    """
    ranked = lists.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "list_no").orderBy("pos")))
    first = ranked.groupBy(*keys, "list_no", "id").agg(F.min("rank").alias("rank"))
    out = first.groupBy(*keys, "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("score"), F.min("rank").alias("best_rank"), F.count("*").alias("n_lists"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "best_rank", "id")))


def fill_from(first: DataFrame, second: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Hits (keys, pos, id) of the first list, then of the second those that are new, k in all."""
    both = first.withColumn("source", F.lit(1)).unionByName(second.withColumn("source", F.lit(2)))
    once = top_k(both, [*keys, "id"], ["source", "pos"], 1, "__n").drop("__n")
    return top_k(once, keys, ["source", "pos", "id"], k)


def pack_context(ranked: DataFrame, keys: Sequence[str], budget: int) -> DataFrame:
    """Blocks "[rank] title, line, text" in order while their characters fit; the first always stays. ranked: keys, rank, title, text."""
    block = F.concat(F.lit("["), F.col("rank"), F.lit("] "), F.col("title"), F.lit("\n"), F.col("text"))
    used = F.sum(F.length("block")).over(Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    out = ranked.withColumn("block", block).withColumn("used", used).where((F.col("used") <= budget) | (F.col("rank") == 1))
    return out.withColumn("span_hash", F.substring(F.sha2("text", 256), 1, 16))


def pack_sizes(docs: DataFrame, keys: Sequence[str], order: Sequence[str], budget: int) -> DataFrame:
    """(keys, rank, used, span_hash): pack_context of docs (keys, order, title, text) ranked by order, without a task that holds a key's rows: sizes and hashes alone are ordered, by ranges."""
    room = F.length("title") + F.length("text") + 4
    slim = docs.select(*keys, *order, room.alias("__room"), F.substring(F.sha2("text", 256), 1, 16).alias("span_hash"))
    ranked = in_order_by(slim, keys, order, place="rank").withColumn("__size", F.coalesce(F.col("__room") + F.length(F.col("rank").cast("string")), F.lit(0))).withColumn("__blocks", F.col("__room").isNotNull().cast("int"))
    used = in_order_by(ranked.select(*keys, F.col("rank").cast("int").alias("rank"), "span_hash", "__size", "__blocks"), keys, ["rank"], ["__size", "__blocks"])
    used = used.withColumn("used", F.when(F.col("__blocks_upto") > 0, F.col("__size_upto")))
    return used.where((F.col("used") <= budget) | (F.col("rank") == 1)).select(*keys, "rank", "used", "span_hash")
