"""Memory queries. The time they take as now is 2024-01-31."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideglass.operators import memory as M
from tideglass.plans._base import query, table

def now():
    return F.lit("2024-01-31").cast("timestamp")


def hits(spark, sf_dir):
    """Retrieval hits made of events."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("hit_id"), (F.col("event_id") % 200).alias("memory_id"), F.sha2(F.concat("event_type", "props"), 256).alias("query_hash"), (F.col("value") / 1000).alias("score"),
        (F.col("event_type") == "purchase").alias("grounded"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("ts").alias("occurred_at"), "user_id",
    )


_HITS = """WITH h AS (SELECT event_id % 200 AS memory_id, event_type || props AS q, value / 1000 AS score, event_type = 'purchase' AS grounded, CAST(ts AS DATE) AS day, ts FROM events),
  s AS (SELECT memory_id, count(*) AS recall_count, CAST(sum(CAST(grounded AS INT)) AS BIGINT) AS grounded_count, count(DISTINCT day) AS n_days, count(DISTINCT q) AS n_queries, sum(score) AS total, max(ts) AS last, max(day) - min(day) AS span FROM h GROUP BY 1)"""
_METRICS = f"""{_HITS}, m AS (SELECT *, recall_count + grounded_count AS signal, least(1, greatest(0, ln(1 + (recall_count + grounded_count)::DOUBLE) / ln(11.0::DOUBLE))) AS frequency, least(1, greatest(0, total / greatest(1, recall_count + grounded_count))) AS relevance,
  least(1, greatest(n_days, n_queries) / 5.0::DOUBLE) AS diversity, exp(-ln(2.0::DOUBLE) * ((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(last)) / 86400000000.0::DOUBLE) / 14) AS recency,
    CASE n_days WHEN 0 THEN 0 WHEN 1 THEN 0.2::DOUBLE ELSE greatest(least(1, .55::DOUBLE * least(1, ln(n_days::DOUBLE) / ln(5.0::DOUBLE)) + .45::DOUBLE * least(1, span / 7.0::DOUBLE)), least(1, grounded_count / 3.0::DOUBLE)) END AS consolidation FROM s),
  z AS (SELECT *, least(1, greatest(0, .24::DOUBLE * frequency + .30::DOUBLE * relevance + .15::DOUBLE * diversity + .15::DOUBLE * recency + .10::DOUBLE * consolidation)) AS score FROM m)"""


@query(f"{_HITS} SELECT memory_id, recall_count, grounded_count, n_days, n_queries, round(total, 6) AS total_score, last AS last_recalled_at, CAST(span AS INTEGER) AS span_days FROM s")
def hit_stats(spark, sf_dir):
    return M.hit_stats(hits(spark, sf_dir)).withColumn("total_score", F.round("total_score", 6))


@query(f"{_METRICS} SELECT memory_id, signal, round(frequency, 6) AS frequency, round(relevance, 6) AS relevance, round(diversity, 6) AS diversity, round(recency, 6) AS recency, round(consolidation, 6) AS consolidation, round(score, 6) AS score FROM z")
def dreaming_metrics(spark, sf_dir):
    scored = M.dreaming_score(M.dreaming_metrics(M.hit_stats(hits(spark, sf_dir)), now()))
    return scored.select("memory_id", "signal", *(F.round(c, 6).alias(c) for c in ("frequency", "relevance", "diversity", "recency", "consolidation", "score")))


@query(f"""{_METRICS}, r AS (SELECT memory_id, round(score, 6) AS score, CASE WHEN memory_id % 11 = 0 THEN 'noise' WHEN score < 0.5 THEN 'score_below_threshold' WHEN recall_count < 3 THEN 'recall_below_threshold'
  WHEN greatest(n_days, n_queries) < 2 THEN 'diversity_below_threshold' END AS reason FROM z) SELECT memory_id, score, reason, reason IS NULL AS promote FROM r""")
def dreaming_select(spark, sf_dir):
    scored = M.dreaming_score(M.dreaming_metrics(M.hit_stats(hits(spark, sf_dir)), now()))
    return M.dreaming_select(scored, F.col("memory_id") % 11 == 0, least_score=0.5).select("memory_id", F.round("score", 6).alias("score"), "reason", "promote")


@query("""SELECT event_id, round(CASE WHEN event_type = 'view' THEN value * 0.8::DOUBLE ELSE value END, 6) AS fused FROM events""")
def score_fusion(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(M.score_fusion(F.col("value"), F.col("event_type") == "view"), 6).alias("fused"))


@query("""SELECT event_id, round(CASE WHEN event_type = 'click' THEN value * pow(0.5::DOUBLE, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 86400000000.0::DOUBLE / 14) ELSE value END, 6) AS decayed FROM events""")
def temporal_decay(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(M.temporal_decay(F.col("value"), M.age_days(F.col("ts"), now()), F.col("event_type") == "click"), 6).alias("decayed"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def content_dedup(spark, sf_dir):
    return M.content_dedup(table(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id")


@query("""SELECT source, doc_id, used FROM (SELECT source, doc_id, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS used FROM documents) WHERE used <= 6000""")
def token_budget_prefix(spark, sf_dir):
    return M.token_budget(table(spark, sf_dir, "documents"), "n_chars", ["doc_id"], 6000, ["source"]).select("source", "doc_id", "used")


@query("""WITH s AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS t FROM conversations)
  SELECT a.conv_id, a.turn, round(CASE WHEN len(a.t) + len(b.t) = 0 THEN 0 ELSE len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))) END, 6) AS similarity FROM s a JOIN s b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def jaccard_pairs(spark, sf_dir):
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", M.token_set(F.col("text")).alias("t"))
    both = s.join(s.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("u")), ["conv_id", "turn"])
    return both.select("conv_id", "turn", F.round(M.jaccard(F.col("t"), F.col("u")), 6).alias("similarity"))


@query()
def mmr_select(spark, sf_dir):
    pool = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("pos"), F.col("doc_id").alias("id"), (F.pmod(F.xxhash64("doc_id"), F.lit(1000)) / 1000).alias("score"), "text")
    return M.mmr(pool, "source")


@query("""WITH RECURSIVE o AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
  f AS (SELECT source, n, CASE WHEN n_chars <= 5000 THEN n_chars ELSE 0 END AS used, n_chars <= 5000 AS kept, doc_id FROM o WHERE n = 1
    UNION ALL SELECT o.source, o.n, f.used + CASE WHEN f.used + o.n_chars <= 5000 THEN o.n_chars ELSE 0 END, f.used + o.n_chars <= 5000, o.doc_id FROM f JOIN o ON o.source = f.source AND o.n = f.n + 1)
  SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY n) - 1 AS INTEGER) AS place, doc_id FROM f WHERE kept""")
def summary_fallback(spark, sf_dir):
    return M.fill_budget(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", "n_chars", "doc_id", 5000)


@query("""WITH h AS (SELECT event_id % 200 AS memory_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE ts >= TIMESTAMP '2024-01-10') SELECT m.memory_id, m.memory_id % 5 + count(h.day) AS recall_count,
  array_to_string(list_sort(list_distinct(list_concat(['2024-01-01'], coalesce(list(h.day) FILTER (h.day IS NOT NULL), []::VARCHAR[])))), ',') AS days FROM (SELECT DISTINCT event_id % 200 AS memory_id FROM events) m LEFT JOIN h USING (memory_id) GROUP BY m.memory_id""")
def recall_update(spark, sf_dir):
    h = hits(spark, sf_dir)
    old = h.select("memory_id").distinct().select("memory_id", F.array(F.lit("2024-01-01")).alias("days"), F.array().cast("array<string>").alias("hashes"), (F.col("memory_id") % 5).alias("recall_count"))
    return M.recall_update(old, h.where("occurred_at >= timestamp_ntz'2024-01-10'")).select("memory_id", "recall_count", F.array_join(F.array_sort("days"), ",").alias("days"))
