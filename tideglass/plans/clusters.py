"""Clustering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideglass.operators import clustering as C
from tideglass.plans._base import query, table


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))


@query("""WITH p AS (SELECT label, 1 + vec_id % 3 AS w, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, i, sum(x * w) / sum(w) AS x FROM p GROUP BY 1, 2)
  SELECT label, CAST(i AS INTEGER) AS i, round(x, 6) AS x FROM m""")
def doc_vectors(spark, sf_dir):
    means = C.weighted_mean(vectors(spark, sf_dir).withColumn("w", F.col("id") % 3 + 1), "label", "vector", "w")
    return means.select("label", F.posexplode("vector").alias("i", "x")).withColumn("x", F.round("x", 6))


@query()
def kmeans_clusters(spark, sf_dir):
    return C.k_means(vectors(spark, sf_dir), 10).select("id", "label", "cluster")


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.3 AND list_distance(a.v, b.v) <= 1.1 * (sqrt(list_dot_product(a.v, a.v)) + sqrt(list_dot_product(b.v, b.v))) / 2""")
def duplicate_pairs(spark, sf_dir):
    return C.duplicate_pairs(vectors(spark, sf_dir).withColumnRenamed("label", "block"), 0.3, 1.1)


@query("""WITH RECURSIVE c AS (SELECT vec_id AS id, vec_id % 12 AS cluster, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT DISTINCT a.cluster AS x, b.cluster AS y FROM c a JOIN c b ON a.label = b.label AND a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.45
  AND list_distance(a.v, b.v) <= 1.05 * (sqrt(list_dot_product(a.v, a.v)) + sqrt(list_dot_product(b.v, b.v))) / 2), w AS (SELECT x, y FROM p UNION SELECT y, x FROM p), r AS (SELECT cluster AS n, cluster AS t FROM c UNION SELECT r.n, w.y FROM r JOIN w ON r.t = w.x)
  SELECT id, m.t AS cluster FROM c JOIN (SELECT n, min(t) AS t FROM r GROUP BY 1) m ON m.n = c.cluster""")
def duplicate_merge(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return C.merge_duplicates(v.select("id", (F.col("id") % 12).alias("cluster")), C.duplicate_pairs(v.withColumnRenamed("label", "block"), 0.45, 1.05))
