"""Evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideglass.operators import evaluation as E
from tideglass.plans._base import query, table


def runs(spark, sf_dir):
    """Runs of questions: users are questions, events their runs."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("question_id"), "event_type", "value", (F.col("value") >= 50).cast("int").alias("pass"))


@query("""WITH q AS (SELECT user_id, avg(CAST(value >= 50 AS INT)) AS acc, sum(CAST(value >= 50 AS INT)) AS p FROM events GROUP BY 1)
  SELECT round(avg(acc), 4) AS accuracy, round(avg(CAST(p >= 20 AS DOUBLE)), 4) AS pass20, round(avg(CAST(p >= 30 AS DOUBLE)), 4) AS pass30, count(*) AS n_questions FROM q""")
def pass_k(spark, sf_dir):
    return E.pass_k(runs(spark, sf_dir), ks=(20, 30))


@query("""WITH g AS (SELECT event_type, sum(CAST(value >= 50 AS INT))::DOUBLE AS k, count(*)::DOUBLE AS n FROM events GROUP BY 1)
  SELECT event_type, round(greatest(0, (k / n + 3.8416::DOUBLE / (2 * n) - 1.96::DOUBLE * sqrt(k / n * (1 - k / n) / n + 3.8416::DOUBLE / (4 * n * n))) / (1 + 3.8416::DOUBLE / n)), 6) AS low,
  round(least(1, (k / n + 3.8416::DOUBLE / (2 * n) + 1.96::DOUBLE * sqrt(k / n * (1 - k / n) / n + 3.8416::DOUBLE / (4 * n * n))) / (1 + 3.8416::DOUBLE / n)), 6) AS high FROM g""")
def wilson(spark, sf_dir):
    g = runs(spark, sf_dir).groupBy("event_type").agg(F.sum("pass").alias("k"), F.count("*").alias("n"))
    low, high = E.wilson(F.col("k"), F.col("n"))
    return g.select("event_type", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("""WITH s AS (SELECT event_type, least(value / 100, 1.0) AS x FROM events), d AS (SELECT DISTINCT event_type, b FROM events, range(5) t(b))
  SELECT d.event_type, CAST(d.b AS INTEGER) AS bucket, count(x) AS n FROM d LEFT JOIN s ON s.event_type = d.event_type AND x >= d.b * 0.2 AND x < CASE WHEN d.b = 4 THEN 1.01 ELSE (d.b + 1) * 0.2 END GROUP BY ALL""")
def score_histogram(spark, sf_dir):
    scores = table(spark, sf_dir, "events").select("event_type", F.least(F.col("value") / 100, F.lit(1.0)).alias("x"))
    return E.histogram(scores, "x", ["event_type"])


@query("""WITH s AS (SELECT 'quality' AS evaluator, quality::DOUBLE AS v FROM labels UNION ALL SELECT 'toxic', toxic::DOUBLE FROM labels)
  SELECT evaluator, count(*) AS n, round(avg(v), 6) AS mean, min(v) AS least, max(v) AS most, CAST(sum(CAST(v >= 0.5 AS INT)) AS BIGINT) AS n_passed FROM s GROUP BY 1""")
def evaluator_stats(spark, sf_dir):
    cases = table(spark, sf_dir, "labels").select(F.create_map(F.lit("quality"), F.col("quality").cast("double"), F.lit("toxic"), F.col("toxic").cast("double")).alias("score"))
    return E.evaluator_stats(cases)


@query("""SELECT lang, CAST(sum(CAST(quality = 0 AS INT)) AS BIGINT) AS n_0, CAST(sum(CAST(quality = 1 AS INT)) AS BIGINT) AS n_1 FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def cross_table(spark, sf_dir):
    return E.cross_table(table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id"), "lang", "quality", [0, 1])


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS n, count(*) OVER (PARTITION BY event_type) AS c FROM events)
  SELECT event_type, value AS q_value FROM r WHERE n = round_even(0.95::DOUBLE * (c - 1), 0) + 1""")
def p95_half_even(spark, sf_dir):
    return E.nearest_quantile(runs(spark, sf_dir), "value", 0.95, ["event_type"])


@query("""SELECT user_id AS question_id, count(*) AS attempts, CAST(sum(CAST(value >= 50 AS INT)) AS BIGINT) AS passes,
  CASE WHEN sum(CAST(value >= 50 AS INT)) = count(*) THEN 'stable_pass' WHEN sum(CAST(value >= 50 AS INT)) = 0 THEN 'stable_fail' ELSE 'unstable' END AS kind FROM events GROUP BY 1""")
def repeat_stability(spark, sf_dir):
    return E.repeat_stability(runs(spark, sf_dir), "question_id", "pass")


@query("""WITH e AS (SELECT doc_id FROM documents), g AS (SELECT doc_id + 3 AS doc_id, count(*) AS n, sum(CAST(NULLIF(quality, 0) IS NULL AS INT)) AS z FROM labels GROUP BY 1), b AS (SELECT e.doc_id AS w, g.* FROM e FULL JOIN g ON e.doc_id = g.doc_id),
  s AS (SELECT count(*) FILTER (w IS NOT NULL AND n IS NULL) AS n_missing, count(*) FILTER (w IS NULL) AS n_unexpected, count(*) FILTER (n > 1) AS n_duplicate, count(*) FILTER (z > 0) AS n_score_missing FROM b)
  SELECT *, n_missing + n_unexpected + n_duplicate + n_score_missing = 0 AS complete FROM s""")
def run_integrity(spark, sf_dir):
    results = table(spark, sf_dir, "labels").select((F.col("doc_id") + 3).alias("doc_id"), F.nullif(F.col("quality"), F.lit(0)).alias("score"))
    return E.run_integrity(table(spark, sf_dir, "documents"), results, "doc_id", "score")


@query("""WITH t AS (SELECT conv_id, turn + CAST(turn >= 3 AS INTEGER) AS turn FROM conversations), c AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) + 1 AS expected FROM t) SELECT conv_id, turn, expected FROM c WHERE turn <> expected""")
def turn_continuity(spark, sf_dir):
    return E.turn_continuity(table(spark, sf_dir, "conversations").withColumn("turn", F.col("turn") + (F.col("turn") >= 3).cast("int")), "conv_id", "turn")


@query("SELECT o_orderpriority, count(*) AS n, CAST(floor(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM orders)) AS INTEGER) AS percent FROM orders GROUP BY 1")
def value_distribution(spark, sf_dir):
    return E.value_distribution(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("""WITH m AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1) SELECT event_id, round(CASE WHEN hi > lo THEN greatest(0, least(1, (value - lo) / (hi - lo))) ELSE 0 END, 6) AS normalized FROM events JOIN m USING (event_type)""")
def score_min_max(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    bounds = e.groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return e.join(bounds, "event_type").select("event_id", F.round(E.min_max(F.col("value"), F.col("lo"), F.col("hi")), 6).alias("normalized"))
