"""Catalogue lookups, counts and checks, greedy compaction and evidence of runs, over the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideglass.operators import catalog as C
from tideglass.operators import evaluation, memory
from tideglass.plans._base import query, table


@query("""WITH v AS (SELECT l_partkey AS agent_id, CAST(l_suppkey % 2 AS INTEGER) AS tenant_id, l_linenumber AS version_no, l_orderkey || ':' || l_linenumber AS version_name, l_shipdate AS create_time FROM lineitem WHERE l_returnflag <> 'R')
  SELECT p_partkey AS agent_id, version_name, create_time FROM part LEFT JOIN v ON agent_id = p_partkey AND tenant_id = p_size % 2 AND version_no = p_size % 7""")
def draft_versions(spark, sf_dir):
    drafts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("agent_id"), (F.col("p_size") % 2).alias("tenant_id"), (F.col("p_size") % 7).alias("current_version_no"))
    lines = table(spark, sf_dir, "lineitem")
    versions = lines.select(F.col("l_partkey").alias("agent_id"), (F.col("l_suppkey") % 2).cast("int").alias("tenant_id"), F.col("l_linenumber").alias("version_no"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("version_name"), F.col("l_shipdate").alias("create_time"), F.when(F.col("l_returnflag") == "R", "Y").otherwise("N").alias("delete_flag"))
    return C.with_current_version(drafts, versions).select("agent_id", "version_name", "create_time")


@query("""SELECT l_suppkey, coalesce(sum(CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS BIGINT) END), 0)::BIGINT AS downloads FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1""")
def downloads_by_agent(spark, sf_dir):
    counted = table(spark, sf_dir, "lineitem").select("l_suppkey", F.when(F.col("l_linestatus") == "F", F.col("l_quantity").cast("bigint")).alias("n"))
    wanted = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return C.totals_of(counted, wanted, "l_suppkey", "n", "downloads")


@query("SELECT p_brand AS bucket_id, count(*) AS n FROM part WHERE p_size % 4 <> 0 GROUP BY 1")
def definitions_by_bucket(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return C.live_counts(p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("bucket_id"), F.when(F.col("p_size") % 4 == 0, "Y").otherwise("N").alias("delete_flag")), "bucket_id")


@query("""WITH h AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 'm' || vec_id WHEN vec_id % 5 = 0 THEN NULL ELSE CAST(vec_id AS VARCHAR) END AS memory_id FROM embeddings) SELECT vec_id, memory_id, source, lang FROM h LEFT JOIN documents ON TRY_CAST(memory_id AS BIGINT) = doc_id""")
def enriched_hits(spark, sf_dir):
    v = F.col("vec_id")
    hits = table(spark, sf_dir, "embeddings").select("vec_id", F.when(v % 7 == 0, F.concat(F.lit("m"), v)).when(v % 5 == 0, None).otherwise(v.cast("string")).alias("memory_id"))
    return C.enriched(hits, table(spark, sf_dir, "documents"), "memory_id", "doc_id", ["source", "lang"])


@query("""WITH b AS (SELECT s_nationkey AS sources, NULL AS models FROM supplier UNION ALL SELECT c_nationkey, nullif(c_mktsegment, 'FURNITURE') FROM customer) SELECT DISTINCT 'sources' AS facet, CAST(sources AS VARCHAR) AS value FROM b WHERE sources IS NOT NULL UNION ALL SELECT DISTINCT 'models', models FROM b WHERE models IS NOT NULL""")
def listing_facets(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("sources"), F.lit(None).cast("string").alias("models"))
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("sources"), F.nullif("c_mktsegment", F.lit("FURNITURE")).alias("models"))
    return C.combined_facets(s, c, ["sources", "models"])


@query("""WITH w AS (SELECT CAST(l_suppkey + CASE WHEN l_orderkey % 50 = 0 THEN 1000000 ELSE 0 END AS VARCHAR) AS id FROM lineitem WHERE l_linenumber = 1), a AS (SELECT id, count(*) AS n FROM w GROUP BY 1)
  SELECT id, CASE WHEN n > 1 THEN 'duplicate' ELSE 'unresolved' END AS fault FROM a WHERE n > 1 OR id NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier)""")
def item_subset_faults(spark, sf_dir):
    wanted = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select((F.col("l_suppkey") + F.when(F.col("l_orderkey") % 50 == 0, 1_000_000).otherwise(0)).alias("id"))
    return C.subset_faults(wanted, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")), "id")


@query("""SELECT coalesce(message_id, 0) AS message_id, coalesce(step_index, 0) AS step_index, string_agg(event_type || ':' || event_id, ' ' ORDER BY ts, event_id) AS units FROM (SELECT *, nullif(user_id, 3) AS message_id, CASE WHEN event_id % 4 > 0 THEN event_id % 4 END AS step_index FROM events) GROUP BY 1, 2""")
def units_by_step(spark, sf_dir):
    units = table(spark, sf_dir, "events").select(F.nullif("user_id", F.lit(3)).alias("message_id"), F.nullif(F.col("event_id") % 4, F.lit(0)).alias("step_index"), "ts", "event_id", "event_type")
    grouped = C.grouped_units(units, ["ts", "event_id"], ["event_type", "event_id"])
    return grouped.select("message_id", "step_index", F.array_join(F.transform("units", lambda u: F.concat_ws(":", u["event_type"], u["event_id"])), " ").alias("units"))


@query("""SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM lineitem WHERE l_returnflag <> 'R' AND l_discount > 0.02""")
def gated_evidence(spark, sf_dir):
    keep = F.when(F.col("l_returnflag") == "R", None).otherwise(F.col("l_discount") > 0.02)
    return C.gated(table(spark, sf_dir, "lineitem"), keep, ["l_orderkey"], [F.desc("l_extendedprice"), "l_linenumber"]).select("l_orderkey", "l_linenumber", "rank")


@query("""WITH i AS (SELECT l_orderkey, l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey AS n, l_returnflag = 'N' AS act, l_linenumber % 5 <> 0 AS ok, CAST(l_quantity AS BIGINT) * 10 AS t, CASE WHEN l_discount > 0.08 THEN CAST(l_quantity AS BIGINT) * 10 + 7 ELSE l_partkey % 40 END AS c FROM lineitem),
  g AS (SELECT *, CASE WHEN act THEN CASE WHEN row_number() OVER (PARTITION BY l_orderkey, act ORDER BY n DESC) > 2 THEN 0 ELSE 2 END WHEN ok THEN 1 END AS stage FROM i),
  o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY stage NULLS LAST, greatest(CASE WHEN stage IS NULL THEN 0 ELSE t - c END, 0) DESC, n) AS k, sum(t) OVER (PARTITION BY l_orderkey) AS total FROM g),
  l AS (SELECT a.l_orderkey, a.k, a.total - coalesce(sum(b.t - b.c) FILTER (WHERE b.stage IS NOT NULL), 0) AS remaining FROM o a LEFT JOIN o b ON b.l_orderkey = a.l_orderkey AND b.k < a.k GROUP BY a.l_orderkey, a.k, a.total)
  SELECT l_orderkey, n AS position, stage, stage IS NOT NULL AND NOT EXISTS (SELECT 1 FROM l WHERE l.l_orderkey = o.l_orderkey AND l.k <= o.k AND remaining <= 500) AS compacted FROM o""")
def greedy_compaction(spark, sf_dir):
    """Lines as items of an order's context, placed by number, part and supplier; a few short forms are longer than the item."""
    tokens = F.col("l_quantity").cast("bigint") * 10
    position = F.col("l_linenumber") * F.lit(1_000_000_000_000) + F.col("l_partkey") * 100_000 + F.col("l_suppkey")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", position.alias("position"), (F.col("l_returnflag") == "N").alias("is_action"), (F.col("l_linenumber") % 5 != 0).alias("compactable"), tokens.alias("tokens"), F.when(F.col("l_discount") > 0.08, tokens + 7).otherwise(F.col("l_partkey") % 40).alias("compact_tokens"))
    return memory.compacted(items, ["l_orderkey"], "position", 500).select("l_orderkey", "position", "stage", "compacted")


@query("""WITH i AS (SELECT o_custkey, CASE o_orderkey % 3 WHEN 0 THEN 'available' WHEN 1 THEN 'unavailable' END AS status, o_orderkey % 9 + 1 AS a, o_orderkey % 5 AS h, o_orderkey % 101 AS c, o_orderkey % 997 AS t FROM orders),
  s AS (SELECT o_custkey, count(*) AS item_count, coalesce(sum(a) FILTER (WHERE status = 'available'), 0)::BIGINT AS a, coalesce(sum(h) FILTER (WHERE status = 'available'), 0)::BIGINT AS h, coalesce(sum(c) FILTER (WHERE status = 'available'), 0)::BIGINT AS c, coalesce(sum(t) FILTER (WHERE status = 'available'), 0)::BIGINT AS t, coalesce(bool_or(status = 'unavailable'), FALSE) AS off FROM i GROUP BY 1)
  SELECT o_custkey, CASE WHEN a > 0 THEN 'available' WHEN off THEN 'unavailable' ELSE 'unsupported' END AS status, item_count, a AS available_calls, h AS hit_calls, round(h / nullif(a, 0), 4) AS hit_rate, c AS cached_tokens, t AS input_tokens, round(c / nullif(t, 0), 4) AS cached_ratio FROM s""")
def cache_evidence(spark, sf_dir):
    k = F.col("o_orderkey")
    items = table(spark, sf_dir, "orders").select("o_custkey", F.when(k % 3 == 0, "available").when(k % 3 == 1, "unavailable").alias("status"), (k % 9 + 1).alias("available_calls"), (k % 5).alias("hit_calls"), (k % 101).alias("cached_tokens"), (k % 997).alias("input_tokens"))
    return evaluation.cache_evidence(items, ["o_custkey"])


@query("""SELECT l_suppkey, count(*) AS total_items, count(*) FILTER (WHERE l_quantity > 25) AS over_soft, count(*) FILTER (WHERE l_quantity > 45) AS over_hard, count(*) FILTER (WHERE l_returnflag = 'R') AS compressed, round(1 - count(*) FILTER (WHERE l_quantity > 45) / count(*), 4) AS overflow_avoidance, max(CAST(l_quantity AS BIGINT)) AS max_peak, CAST(round_even(avg(CAST(l_quantity AS BIGINT)), 0) AS BIGINT) AS avg_peak FROM lineitem GROUP BY 1""")
def budget_evidence(spark, sf_dir):
    q = F.col("l_quantity")
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", (q > 25).alias("over_soft"), (q > 45).alias("over_hard"), (F.col("l_returnflag") == "R").alias("compressed"), q.cast("bigint").alias("peak_tokens"))
    return evaluation.budget_evidence(items, ["l_suppkey"])
