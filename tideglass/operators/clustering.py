"""Document vectors, k-means with a chosen k, and merging of near-equal clusters."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.operators.graph import components

#: Vectors of a block that are compared with as many others in one group, and so many of them at a time.
TILE, STRIP = 4096, 512


def weighted_mean(chunks: DataFrame, key: str, vector: str, weight: str) -> DataFrame:
    """(key, vector): the mean of each key's vectors, weighted."""
    parts = chunks.select(key, weight, F.posexplode(vector).alias("i", "x"))
    sums = parts.groupBy(key, "i").agg((F.sum(F.col("x").cast("double") * F.col(weight)) / F.sum(weight)).alias("x"))
    listed = sums.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return listed.select(key, F.transform("v", lambda p: p["x"]).alias("vector"))


def k_means(vectors: DataFrame, k: int, seed: int = 42, iterations: int = 300) -> DataFrame:
    """vectors with cluster and the silhouette of the whole clustering."""
    rows = vectors.withColumn("features", array_to_vector(F.transform("vector", lambda x: x.cast("double"))))
    out = KMeans(k=k, seed=seed, maxIter=iterations).fit(rows).transform(rows)
    score = ClusteringEvaluator().evaluate(out) if k > 1 else 0.0
    return out.drop("features").withColumnRenamed("prediction", "cluster").withColumn("silhouette", F.lit(score))


def choose_k(vectors: DataFrame) -> int:
    """2 for fewer than 3 rows, from sqrt(n / 2) for fewer than 20, else the k up to min(15, n / 10) of the best silhouette."""
    n = vectors.count()
    if n < 3:
        return max(2, n)
    if n < 20:
        return max(3, min(int(math.sqrt(n / 2)), 15))
    scores = {k: k_means(vectors, k).select("silhouette").first()[0] for k in range(2, max(3, min(15, n // 10) + 1))}
    return max(scores, key=lambda k: (scores[k], -k))


def duplicate_pairs(vectors: DataFrame, least_cosine: float = 0.98, most_apart: float = 0.01) -> DataFrame:
    """(a, b), a < b, of one block that are near copies: cosine at least 0.98 and a distance of 1 % of the mean norm at most. vectors: id, block, vector.

    A block's vectors are dealt out in tiles; each pair of tiles is one group, a product of two matrices in strips of STRIP rows. Work grows with
    the square of a block, memory does not. Vectors of other lengths, or with a null, are near to none.
    """
    fit = F.col("block").isNotNull() & F.col("id").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull())
    rows = vectors.where(fit).select("block", F.size("vector").alias("width"), "id", F.transform("vector", lambda x: x.cast("double")).alias("v"))
    tiles = rows.groupBy("block", "width").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    rows = rows.join(tiles, ["block", "width"]).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: F.struct(F.least("tile", k).alias("x"), F.greatest("tile", k).alias("y")))
    dealt = rows.select("block", "width", "tile", "id", "v", F.explode(pairs).alias("p")).select("block", "width", "p.x", "p.y", "tile", "id", "v")

    def near(tile: pa.Table) -> pa.Table:
        at = tile["tile"].to_numpy()
        v = tile["v"].combine_chunks().flatten().to_numpy().reshape(len(at), -1)
        norm = np.sqrt((v * v).sum(axis=1))
        x, y = tile["x"][0].as_py(), tile["y"][0].as_py()
        left, right, same, found = np.flatnonzero(at == x), np.flatnonzero(at == y), x == y, []
        for start in range(0, len(left), STRIP):
            a = left[start : start + STRIP]
            product, norms = v[a] @ v[right].T, norm[a][:, None] * norm[right]
            apart = np.sqrt(np.maximum(0, norm[a][:, None] ** 2 + norm[right] ** 2 - 2 * product))
            yes = (norms > 0) & (product / np.where(norms > 0, norms, 1) >= least_cosine) & (apart <= most_apart * (norm[a][:, None] + norm[right]) / 2)
            if same:
                yes &= a[:, None] < right
            i, j = np.nonzero(yes)
            found.append(np.stack([a[i], right[j]]))
        i, j = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return pa.table({"a": tile["id"].take(pa.array(i)), "b": tile["id"].take(pa.array(j))})

    kind = dict(vectors.dtypes)["id"]
    both = dealt.groupBy("block", "width", "x", "y").applyInArrow(near, f"a {kind}, b {kind}").where("a <> b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def merge_duplicates(clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """clusters (id, cluster) where clusters that share near copies (a, b) become the smallest of them."""
    of = lambda n: clusters.select(F.col("id").alias(n), F.col("cluster").cast("bigint").alias(f"{n}_c"))
    links = pairs.join(of("a"), "a").join(of("b"), "b").select(F.col("a_c").alias("src"), F.col("b_c").alias("dst")).where("src <> dst")
    roots = components(links)
    out = clusters.join(roots, F.col("cluster").cast("bigint") == F.col("node"), "left")
    return out.select("id", F.coalesce("component", F.col("cluster").cast("bigint")).alias("cluster"))
