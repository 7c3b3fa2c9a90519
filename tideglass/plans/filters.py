"""Filters, lookups and rankings of a multi-tenant store, over the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideglass.operators import filters as X
from tideglass.plans._base import query, table

NOW = "2024-01-20"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def records(spark, sf_dir):
    """Orders as records with an owner, a flag and a state."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("tenant_id"), F.col("o_custkey").alias("user_id"), F.when(F.col("o_orderkey") % 10 == 0, "Y").otherwise("N").alias("delete_flag"), F.col("o_orderpriority").alias("status"), F.col("o_totalprice").alias("score"))


_RECORDS = "WITH r AS (SELECT o_orderkey AS id, o_orderstatus AS tenant_id, o_custkey AS user_id, CASE WHEN o_orderkey % 10 = 0 THEN 'Y' ELSE 'N' END AS delete_flag, o_orderpriority AS status, o_totalprice AS score FROM orders)"


@query(f"{_RECORDS} SELECT id, user_id FROM r WHERE tenant_id = 'F' AND delete_flag = 'N'")
def tenant_isolation(spark, sf_dir):
    return X.not_deleted(X.isolated(records(spark, sf_dir), tenant_id="F")).select("id", "user_id")


@query(f"{_RECORDS} SELECT 'given' AS kind, id FROM r WHERE tenant_id = 'O' AND status = '1-URGENT' UNION ALL SELECT 'default', id FROM r WHERE tenant_id = 'O' AND status = '2-HIGH' UNION ALL SELECT 'all', id FROM r WHERE tenant_id = 'O'")
def optional_filters(spark, sf_dir):
    r, default = records(spark, sf_dir), {"status": "2-HIGH"}
    asked = {"given": {"tenant_id": "O", "status": "1-URGENT"}, "default": {"tenant_id": "O", "user_id": ""}, "all": {"tenant_id": "O", "status": "", "user_id": None}}
    parts = [X.optional(r, w, default).select(F.lit(k).alias("kind"), "id") for k, w in asked.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT p_partkey FROM part WHERE p_name ILIKE '%l_ w%e%'")
def ilike_pattern(spark, sf_dir):
    return table(spark, sf_dir, "part").where(X.contains_pattern("p_name", "L_ w%E")).select("p_partkey")


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') ILIKE '%1%'")
def json_filter(spark, sf_dir):
    return table(spark, sf_dir, "events").where(X.json_contains("props", "$.k", "1")).select("event_id")


@query("SELECT l.doc_id, e.vec_id FROM labels l JOIN embeddings e ON CAST(l.doc_id AS VARCHAR) = CAST(e.vec_id AS VARCHAR)")
def cross_type_keys(spark, sf_dir):
    ids = table(spark, sf_dir, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("name"))
    return table(spark, sf_dir, "labels").join(ids, F.col("doc_id").cast("string") == F.col("name")).select("doc_id", "vec_id")


@query("SELECT p_partkey, p_size / 50.0::DOUBLE AS score FROM part WHERE p_size / 50.0::DOUBLE >= 0.65::DOUBLE")
def score_threshold(spark, sf_dir):
    return X.score_at_least(table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("score")))


@query("SELECT p_partkey FROM part WHERE p_partkey % 7 <> 0 AND p_brand = 'Brand#13' AND p_size >= 10 AND p_partkey % 5 <> 0")
def asset_postfilter(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    hits = p.select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, "failed").otherwise("parsed").alias("parse_status"), F.col("p_type").alias("modality"), F.col("p_brand").alias("doc_type"), F.col("p_size").alias("authority_level"), (F.col("p_partkey") % 5 == 0).alias("superseded"))
    return X.assets(hits, doc_type="Brand#13", least_authority=10).select("p_partkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 20)")
def whitelist_filter(spark, sf_dir):
    lists = {"l_suppkey": table(spark, sf_dir, "supplier").where("s_acctbal > 0").select("s_suppkey"), "l_partkey": table(spark, sf_dir, "part").where("p_size < 20").select("p_partkey")}
    return X.allowed(table(spark, sf_dir, "lineitem"), lists).select("l_orderkey", "l_linenumber")


@query(f"""SELECT name, count(*) AS n FROM events, (VALUES ('24h', 24), ('7d', 168), ('30d', 720), ('odd', 24)) v(name, hours) WHERE ts >= TIMESTAMP '{NOW}' - hours * INTERVAL 1 HOUR GROUP BY 1
  UNION ALL SELECT 'days', count(*) FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 3 DAY""")
def time_ranges(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    parts = [e.where(X.in_range(F.col("ts"), now(), name)).groupBy(F.lit(name).alias("name")).agg(F.count("*").alias("n")) for name in ("24h", "7d", "30d", "odd")]
    out = e.where(X.within_days(F.col("ts"), now(), 3)).agg(F.lit("days").alias("name"), F.count("*").alias("n"))
    for part in parts:
        out = out.unionByName(part)
    return out


@query("SELECT p_name, p_size FROM part")
def field_projection(spark, sf_dir):
    return X.fields(table(spark, sf_dir, "part"), ["p_name", "no_such_field", "p_size"])


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#11' OR p_size % 4 = 0 OR (p_size % 4 = 1 AND (p_size = 5 OR p_size = 9))")
def group_visibility(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    groups = F.when(F.col("p_size") % 4 == 0, "").when(F.col("p_size") % 4 == 1, F.concat_ws(", ", F.lit("x"), F.col("p_size").cast("string"))).otherwise("x")
    return X.visible_to(p.withColumn("group_ids", groups).withColumn("created_by", F.col("p_brand")), "Brand#11", ["5", "9"]).select("p_partkey")


@query("SELECT l_orderkey AS path_id FROM lineitem GROUP BY 1 HAVING bool_and(l_shipdate <= TIMESTAMP '1997-01-01' AND (l_linenumber % 3 > 0 OR l_shipdate + INTERVAL 400 DAY > TIMESTAMP '1997-01-01'))")
def pinned_paths(spark, sf_dir):
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path_id"), F.col("l_shipdate").alias("valid_at"), F.expr("CASE WHEN l_linenumber % 3 = 0 THEN l_shipdate + INTERVAL 400 DAY END").alias("invalid_at"))
    return X.valid_paths(steps, F.lit("1997-01-01").cast("timestamp_ntz"))


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN TIMESTAMP '2000-01-01' WHEN o_orderkey % 5 = 1 THEN o_orderdate WHEN o_orderkey % 5 = 2 THEN o_orderdate + INTERVAL 1 DAY ELSE TIMESTAMP '{NOW}' END AS at,
  CASE o_orderkey % 5 WHEN 0 THEN 'explicit' WHEN 1 THEN 'fact_cutoff' WHEN 2 THEN 'version_created_at' ELSE 'now' END AS origin FROM orders""")
def version_clocks(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    at, source = X.version_clock(F.when(k == 0, F.lit("2000-01-01").cast("timestamp_ntz")), F.when(k == 1, F.col("o_orderdate").cast("timestamp_ntz")), F.when(k == 2, F.expr("CAST(o_orderdate AS timestamp_ntz) + INTERVAL 1 DAY")), now())
    return table(spark, sf_dir, "orders").select("o_orderkey", at.alias("at"), source.alias("origin"))


@query("""WITH d AS (SELECT DISTINCT p_partkey AS doc_id, unnest(string_split(p_name, ' ')) AS term FROM part), q AS (SELECT DISTINCT p_partkey AS query_id, unnest(string_split(p_name, ' ')) AS term FROM part WHERE p_partkey % 20 = 0), w AS (SELECT query_id, count(*) AS n FROM q GROUP BY 1)
  SELECT query_id, doc_id FROM q JOIN d USING (term) JOIN w USING (query_id) GROUP BY query_id, doc_id, n HAVING count(*) = n""")
def all_terms_match(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    return X.all_terms(p.select(F.col("p_partkey").alias("doc_id"), F.explode(words).alias("term")), p.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), F.explode(words).alias("term")))


@query("SELECT user_id, event_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type IN ('error', 'purchase') GROUP BY 1 HAVING count(DISTINCT event_type) >= 2) AND event_type IN ('error', 'purchase')")
def ignition_gate(spark, sf_dir):
    return X.ignited(table(spark, sf_dir, "events").where("event_type in ('error', 'purchase')"), "user_id", "event_type").select("user_id", "event_id")


@query("""WITH u AS (SELECT event_id AS memory_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS s FROM events WHERE event_type <> 'view' AND event_id NOT IN (SELECT doc_id FROM labels))
  SELECT user_id, memory_id, CAST(n AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, s DESC, memory_id) AS n FROM u) WHERE n <= 3""")
def source_top_n(spark, sf_dir):
    units = table(spark, sf_dir, "events").select(F.col("event_id").alias("memory_id"), "user_id", (F.col("event_type") != "view").alias("promote"), F.col("value").alias("score"), F.get_json_object("props", "$.k").cast("int").alias("signal_count"))
    return X.source_top(units, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("memory_id")), ["user_id"], 3).select("user_id", "memory_id", "place")


@query("""WITH q AS (SELECT p_partkey AS query_id, string_split(p_name, ' ')[-1] AS q FROM part WHERE p_partkey % 20 = 0), r AS (SELECT query_id, query_id AS id, 1 AS tier, 1 AS rank FROM q UNION ALL SELECT query_id, p_partkey, CASE WHEN lower(p_name) LIKE '%' || lower(q) || '%' THEN 2 ELSE 3 END, 0 FROM q, part WHERE lower(p_name) LIKE '%' || lower(q) || '%' OR p_brand LIKE '%' || q || '%'),
  b AS (SELECT query_id, id, min(tier) AS tier FROM r GROUP BY ALL) SELECT query_id, id, tier, CAST(n AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, id) AS n FROM b) WHERE n <= 5""")
def entity_lookup(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    asked = p.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), F.element_at(F.split("p_name", " "), -1).alias("query"))
    entities = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.array("p_brand").alias("aliases"))
    return X.entity_lookup(entities, asked, asked.select("query_id", F.col("query_id").alias("id"), F.lit(1).alias("rank")))


@query("SELECT o_orderkey, CAST(n AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END DESC NULLS LAST, o_orderkey) AS n FROM orders) WHERE n <= 10")
def json_score_sort(spark, sf_dir):
    scores = table(spark, sf_dir, "orders").withColumn("result", F.when(F.col("o_orderkey") % 3 > 0, F.to_json(F.struct(F.col("o_totalprice").alias("score")))))
    return X.top_by(scores.withColumn("score", F.get_json_object("result", "$.score").cast("double")), ["o_orderstatus"], [F.desc_nulls_last("score"), "o_orderkey"], 10).select("o_orderkey", "place")


@query("SELECT p_partkey, CAST(n AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 4 + 1, p_retailprice DESC, p_partkey) AS n FROM part) WHERE n <= 2")
def asset_fallback(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("authority_level", F.col("p_size") % 4 + 1)
    return X.top_by(p, ["p_brand"], ["authority_level", F.desc("p_retailprice"), "p_partkey"], 2).select("p_partkey", "place")
