"""Assignment, calibration and alignment over parts, customers, orders and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideglass.operators import alignment as A
from tideglass.operators import matching as M
from tideglass.plans._base import query, table

_GOLD = """g AS (SELECT p_partkey AS place, 'T' || p_size % 5 AS type, p_brand || '/' || p_name AS anchor, '#' || p_size AS field, CASE WHEN p_size <= 20 THEN 'Verified' WHEN p_size <= 35 THEN 'corrected' ELSE 'negative' END AS status FROM part)"""
_CALIBRATED = f"""WITH RECURSIVE {_GOLD}, m AS MATERIALIZED (SELECT row_number() OVER (ORDER BY c_custkey) AS i, c_custkey AS item, CASE WHEN c_nationkey = 0 THEN 'UNCHANGED' ELSE 'T' || c_nationkey % 5 END AS type, 'Brand#' || c_custkey % 25 || '/red ring' AS own, lower(c_mktsegment) || ' #' || c_custkey % 53 || ' #' || c_nationkey AS points FROM customer),
  e AS MATERIALIZED (SELECT i, anchor, CASE WHEN own = anchor THEN 0 ELSE 1 END AS pref, place FROM m JOIN g USING (type) WHERE status IN ('Verified', 'corrected') AND (own = anchor OR contains(own || ' ' || points, field))),
  b AS MATERIALIZED (SELECT i, anchor, min(pref * 1000000000 + place) AS w FROM e GROUP BY ALL),
  r AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS VARCHAR) AS x UNION ALL
    SELECT i, CASE WHEN x IS NULL THEN used ELSE list_append(used, x) END, x FROM (SELECT r.i + 1 AS i, used, arg_min(b.anchor, w) AS x FROM r LEFT JOIN b ON b.i = r.i + 1 AND NOT list_contains(used, b.anchor) WHERE r.i < (SELECT max(i) FROM m) GROUP BY r.i, used))"""


def gold(spark, sf_dir):
    status = F.when(F.col("p_size") <= 20, "Verified").when(F.col("p_size") <= 35, "corrected").otherwise("negative")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("place"), F.concat(F.lit("T"), F.col("p_size") % 5).alias("change_type"), F.concat_ws("/", "p_brand", "p_name").alias("anchor"), F.concat(F.lit("#"), "p_size").alias("field"), status.alias("status"))


def machine(spark, sf_dir):
    kind = F.when(F.col("c_nationkey") == 0, "UNCHANGED").otherwise(F.concat(F.lit("T"), F.col("c_nationkey") % 5))
    own = F.concat(F.lit("Brand#"), F.col("c_custkey") % 25, F.lit("/red ring"))
    points = F.concat(F.lower("c_mktsegment"), F.lit(" #"), F.col("c_custkey") % 53, F.lit(" #"), "c_nationkey")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item"), kind.alias("change_type"), own.alias("anchor"), points.alias("points"))


@query(f"{_CALIBRATED} SELECT item, x AS anchor FROM r JOIN m USING (i) WHERE x IS NOT NULL")
def calibration_pairs(spark, sf_dir):
    return M.calibration_pairs(machine(spark, sf_dir), gold(spark, sf_dir))


@query(f"""{_CALIBRATED}, c AS (SELECT count(x) AS matched, (SELECT count(*) FROM g WHERE status <> 'negative') AS gold_total, (SELECT count(*) FROM m WHERE type <> 'UNCHANGED') AS machine_total, (SELECT count(*) FROM g WHERE status = 'negative') AS unverified_excluded FROM r)
  SELECT *, matched / machine_total AS precision, matched / gold_total AS recall FROM c""")
def calibration(spark, sf_dir):
    return M.calibrate(machine(spark, sf_dir), gold(spark, sf_dir))


@query("""WITH RECURSIVE l AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n, l_suppkey AS s, l_quantity AS q, l_discount AS d FROM lineitem), o AS (SELECT k, n, row_number() OVER (PARTITION BY k ORDER BY n, s, q, d) AS p, s, q, d FROM l WHERE n <= 3),
  e AS (SELECT o.k, o.p, i.s, max(round(o.q * (1 + i.d) / (1 + (o.s + i.s) % 7), 6)) AS w FROM o JOIN l i ON i.k = o.k AND i.n >= 3 GROUP BY ALL),
  x AS (SELECT k, p, s, w FROM e UNION ALL SELECT DISTINCT k, p, NULL, 0 FROM e),
  m AS (SELECT DISTINCT k, CAST(0 AS BIGINT) AS p, CAST([] AS BIGINT[]) AS used, CAST(0 AS DOUBLE) AS total FROM e UNION ALL
    SELECT m.k, m.p + 1, CASE WHEN x.s IS NULL THEN used ELSE list_append(used, x.s) END, total + w FROM m JOIN x ON x.k = m.k AND x.p = m.p + 1 AND (x.s IS NULL OR NOT list_contains(used, x.s)))
  SELECT k AS l_orderkey, round(max(total), 4) AS total FROM m GROUP BY k""")
def optimal_assignment(spark, sf_dir):
    """Within each order, the first lines choose suppliers of the later ones: the largest total of scores with one supplier a line."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("s"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("d")).distinct()
    o, i = l.where("n <= 3"), l.where("n >= 3").select("k", F.col("s").alias("is"), F.col("d").alias("id"))
    score = F.round(F.col("q") * (1 + F.col("id")) / (1 + (F.col("s") + F.col("is")) % 7), 6)
    edges = o.join(i, "k").select("k", F.struct("k", "n", "s", "q", "d").alias("o"), F.struct("k", "is").alias("i"), score.alias("score"))
    text = lambda c: F.to_json(c)  # noqa: E731  owners and items of an order as strings
    found = M.assign(edges.select("k", text("o").alias("owner"), text("i").alias("item"), "score"), within="k")
    return found.groupBy(F.get_json_object("owner", "$.k").cast("bigint").alias("l_orderkey")).agg(F.round(F.sum("score"), 4).alias("total"))


@query("""WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
  t AS (SELECT * FROM p WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) = 1)
  SELECT vec_id AS query_id, id, round(score, 6) AS score, CASE WHEN score > 0.8 THEN 'merge' WHEN score IS NOT NULL THEN 'adjudicate' ELSE 'pending' END AS decision FROM embeddings LEFT JOIN t ON vec_id = query_id WHERE vec_id % 20 = 0""")
def entity_alignment(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return A.align(e, e.where("id % 20 = 0").withColumnRenamed("id", "query_id")).withColumn("score", F.round("score", 6))
