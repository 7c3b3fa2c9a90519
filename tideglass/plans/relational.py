"""Relational and operational queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideglass.operators import relational as R
from tideglass.operators.ordered import in_order
from tideglass.plans._base import query, table

_CALLS = """WITH c AS (SELECT event_type, event_type = 'error' AS is_error, value AS duration,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""


def calls(spark, sf_dir):
    """Model calls made of events."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", (F.col("event_type") == "error").alias("is_error"), F.col("value").alias("duration"), (k % 2 == 0).alias("is_streaming"), k.alias("tokens"))


@query(f"""{_CALLS} SELECT event_type, count(*) AS n_calls, round(sum(CAST(is_error AS INTEGER)) * 100.0::DOUBLE / count(*), 4) AS error_rate,
  round(avg(duration), 4) AS avg_duration, round(avg(CASE WHEN k % 2 = 0 THEN duration END), 4) AS avg_streaming_duration,
  CAST(sum(k) AS BIGINT) AS total_tokens FROM c GROUP BY event_type""")
def model_metrics(spark, sf_dir):
    return R.model_metrics(calls(spark, sf_dir), ["event_type"]).orderBy(F.desc("n_calls"), "event_type")


def assignments(spark, sf_dir):
    """(resource_id, definition, value): language, source and labels of documents as tags."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = d.join(l, "doc_id", "left").select(F.col("doc_id").alias("resource_id"), F.expr("stack(4, 'lang', lang, 'source', source, 'quality', cast(quality as string), 'toxic', cast(toxic as string)) as (definition, value)"))
    return rows.where("value is not null")


_TAGS = """WITH t AS (SELECT doc_id AS resource_id, 'lang' AS definition, lang AS value FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents
  UNION ALL SELECT doc_id, 'quality', CAST(quality AS VARCHAR) FROM labels UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS VARCHAR) FROM labels)"""


@query(f"""{_TAGS} SELECT resource_id FROM t WHERE (definition = 'lang' AND value IN ('en', 'fr')) OR (definition = 'quality' AND value = '1')
  GROUP BY resource_id HAVING count(DISTINCT definition) = 2""")
def tag_division(spark, sf_dir):
    return R.tag_division(assignments(spark, sf_dir), {"lang": ["en", "fr"], "quality": ["1"]})


@query(f"""{_TAGS} SELECT DISTINCT resource_id FROM t WHERE definition = 'lang' AND value = 'en'
  AND resource_id IN (SELECT resource_id FROM t WHERE definition = 'toxic' AND value = '1')""")
def tag_filter_iter(spark, sf_dir):
    return R.tag_filter_all(assignments(spark, sf_dir), [("lang", "en"), ("toxic", "1")])


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey - 1 END AS supersede_of FROM orders)
  SELECT o_orderkey FROM o WHERE NOT EXISTS (SELECT 1 FROM o s WHERE s.supersede_of = o.o_orderkey)""")
def not_superseded(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") - 1).alias("supersede_of"))
    return R.not_superseded(orders, "o_orderkey", "supersede_of").select("o_orderkey")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
  AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O')""")
def eval_case_semi(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return R.semi_all(table(spark, sf_dir, "orders"), ["o_orderkey"], [items.where("l_returnflag = 'R'"), items.where("l_linestatus = 'O'")]).select("o_orderkey", "o_custkey")


@query("""SELECT c.c_custkey, n.n_name, r.r_name, coalesce(u.n, 0) AS n_orders FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey AND r.r_name <> 'ASIA' LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) u ON u.o_custkey = c.c_custkey""")
def left_joins_usage(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region").where("r_name <> 'ASIA'")
    rows = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return R.with_counts(rows, table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", "n_orders").select("c_custkey", "n_name", "r_name", "n_orders")


@query("SELECT l_orderkey, count(DISTINCT l_returnflag) AS n_values FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def having_multi(spark, sf_dir):
    return R.having_several(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag")


@query("SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS tag FROM part) GROUP BY 1")
def unnest_tag_stats(spark, sf_dir):
    return R.tag_stats(table(spark, sf_dir, "part").select(F.split("p_name", " ").alias("tags")), "tags")


@query("""SELECT p_partkey, p_name, (SELECT min(p_partkey) FROM (SELECT p_partkey FROM part WHERE p_partkey < 150 ORDER BY 1 DESC LIMIT 20)) AS next_cursor
  FROM part WHERE p_partkey < 150 ORDER BY p_partkey DESC LIMIT 20""")
def keyset_page(spark, sf_dir):
    return R.keyset_page(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", 150, 20)


@query("""SELECT s_suppkey, s_name, (SELECT count(*) FROM supplier) AS total, CAST(ceil((SELECT count(*) FROM supplier) / 7.0) AS BIGINT) AS pages
  FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 7 OFFSET 7""")
def offset_page(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier")
    return R.offset_page(rows, [F.desc("s_acctbal"), "s_suppkey"], 2, 7).select("s_suppkey", "s_name", "total", "pages")


@query("SELECT conv_id, turn, role, row_number() OVER (ORDER BY conv_id, turn) AS place FROM conversations")
def session_order(spark, sf_dir):
    return in_order(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"])


@query("""SELECT id, name, origin FROM (SELECT c_custkey AS id, c_name AS name, 'first' AS origin FROM customer UNION ALL SELECT s_suppkey, s_name, 'second' FROM supplier)
  ORDER BY lpad(CAST(id AS VARCHAR), 12, '0'), origin LIMIT 30 OFFSET 10""")
def ordered_union_page(spark, sf_dir):
    first = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    second = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return R.merge_ordered(first, second, [F.lpad(F.col("id").cast("string"), 12, "0"), "origin"], 10, 30)


@query("SELECT lang, count(*) AS n_docs, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS n_bytes, count(DISTINCT source) AS n_sources FROM documents GROUP BY lang")
def coalesce_bytes(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("n_chars"), F.lit(0)).cast("bigint").alias("n_bytes"), F.countDistinct("source").alias("n_sources"))


@query("SELECT o_custkey, max(o_totalprice) AS max_o_totalprice FROM orders GROUP BY 1")
def max_per_group(spark, sf_dir):
    return R.max_per_group(table(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%ring%'")
def ilike_contains(spark, sf_dir):
    return table(spark, sf_dir, "part").where(R.contains_text("p_name", "RING")).select("p_partkey", "p_name")


@query("SELECT a.doc_id FROM (SELECT doc_id FROM documents WHERE lang = 'en') a JOIN (SELECT doc_id FROM labels WHERE quality = 1) b USING (doc_id)")
def set_intersection(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id").intersect(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").subtract(table(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'purchase') WHERE n = 1")
def receiver_dedup(spark, sf_dir):
    return R.first_per_key(table(spark, sf_dir, "events").where("event_type = 'purchase'"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query("""SELECT CASE WHEN a IS NULL OR b IS NULL THEN 'missing' WHEN a AND b THEN 'both' WHEN a THEN 'first_only' WHEN b THEN 'second_only' ELSE 'neither' END AS outcome, count(*) AS n
  FROM (SELECT doc_id, quality = 1 AS a FROM labels) x FULL JOIN (SELECT doc_id + 3 AS doc_id, toxic = 0 AS b FROM labels) y USING (doc_id) GROUP BY 1""")
def paired_outcomes(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return R.paired_outcomes(labels.select("doc_id", (F.col("quality") == 1).alias("ok")), labels.select((F.col("doc_id") + 3).alias("doc_id"), (F.col("toxic") == 0).alias("ok")), "doc_id", "ok")
