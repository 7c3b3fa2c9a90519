"""Queries of splitters, sessions, memory phases and drawn significance."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideglass.functions import answers as A
from tideglass.operators import chunking as C
from tideglass.operators import memory as M
from tideglass.operators import splitters as S
from tideglass.operators import versions as V
from tideglass.plans._base import query, table
from tideglass.plans.memory import hits, now


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CAST(greatest(1, ceil(n_chars / greatest(1, doc_id % 7)::DOUBLE)) AS BIGINT) ELSE CASE WHEN doc_id % 5 = 0 THEN 5242880 ELSE doc_id % 5 END END AS size FROM documents""")
def part_size(spark, sf_dir):
    parts = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 7)
    return table(spark, sf_dir, "documents").select("doc_id", S.part_size(F.col("n_chars"), F.col("doc_id") % 5, parts).alias("size"))


@query()
def plain_chunks(spark, sf_dir):
    return C.explode_with(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", lambda t: S.plain_chunks(t, 300), "chunk string")


def sessions(spark, sf_dir):
    """Conversations with their turns in order."""
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("turns"))


@query()
def json_array_packs(spark, sf_dir):
    listed = sessions(spark, sf_dir).select("conv_id", F.to_json(F.col("turns.text")).alias("listed"))
    return C.explode_with(listed, "listed", lambda t: S.json_array_packs(t, 400), "chunk string")


@query()
def markdown_parts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("# "), "source", F.lit("\n"), F.regexp_replace("text", r"\n([A-Z])", "\n## $1")).alias("text"))
    return C.explode_with(docs, "text", lambda t: S.markdown_parts(t, 500), "chunk string")


@query()
def xml_parts(spark, sf_dir):
    element = lambda t: F.concat(F.lit("<t role='"), t["role"], F.lit("'>"), F.regexp_replace(t["text"], r"[<>&\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}]", " "), F.lit("</t>"))
    written = F.concat(F.lit("<c>"), F.array_join(F.transform("turns", element), ""), F.lit("</c>"))
    return C.explode_with(sessions(spark, sf_dir).select("conv_id", written.alias("xml")), "xml", lambda t: S.xml_parts(t, 400), "chunk string")


@query("""SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS content, arg_min(role, turn) AS language FROM conversations GROUP BY conv_id""")
def whole_documents(spark, sf_dir):
    return S.whole_documents(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text", "role")


@query("""WITH n AS (SELECT o_custkey AS doc, CAST(o_orderkey AS VARCHAR) AS number, NULL AS parent FROM orders
    UNION ALL SELECT o_custkey, l_orderkey || '.' || l_linenumber, CAST(l_orderkey AS VARCHAR) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber <> 2
    UNION ALL SELECT o_custkey, l_orderkey || '.' || l_linenumber || '.1', CASE WHEN l_linenumber = 2 THEN CAST(l_orderkey AS VARCHAR) ELSE l_orderkey || '.' || l_linenumber END FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
  SELECT DISTINCT doc, number, parent FROM n""")
def section_parents(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("key"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber").join(orders, "key")
    second = F.concat_ws(".", "key", "l_linenumber")
    numbers = orders.select("doc", F.col("key").cast("string").alias("number")).union(lines.where("l_linenumber <> 2").select("doc", second)).union(lines.select("doc", F.concat(second, F.lit(".1"))))
    return S.section_parents(numbers.distinct(), ["doc"])


@query("""WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)
  SELECT conv_id % 10 AS question, CAST(row_number() OVER (PARTITION BY conv_id % 10 ORDER BY conv_id % 3, conv_id) - 1 AS INTEGER) AS session_idx, CAST(n AS INTEGER) AS n_turns FROM c""")
def session_flatten(spark, sf_dir):
    groups = sessions(spark, sf_dir).withColumns({"question": F.col("conv_id") % 10, "g": F.col("conv_id") % 3}).groupBy("question", "g").agg(F.sort_array(F.collect_list(F.struct("conv_id", "turns"))).alias("s"))
    nested = groups.select("question", "g", F.concat(F.col("s.turns"), F.array(F.array().cast(groups.schema["s"].dataType.elementType["turns"].dataType))).alias("sessions"))
    nested = nested.groupBy("question").agg(F.transform(F.sort_array(F.collect_list(F.struct("g", "sessions"))), lambda g: g["sessions"]).alias("groups"))
    return S.flat_sessions(nested, ["question"], "groups").select("question", "session_idx", F.size("turns").alias("n_turns"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN CAST(event_id AS VARCHAR) ELSE '[' || event_type END AS answer FROM events""")
def first_of_list(spark, sf_dir):
    written = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" ['"), "event_type", F.lit("', 'b'] "))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("["), "event_id", F.lit("]"))).otherwise(F.concat(F.lit("["), "event_type", F.lit(" ")))
    return table(spark, sf_dir, "events").select("event_id", S.first_of_list(written).alias("answer"))


@query(r"""WITH c AS (SELECT source, doc_id, text, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos FROM documents),
  k AS (SELECT *, CASE WHEN n <= 3 THEN 'all' WHEN pos = 1 THEN 'first' WHEN pos < n AND length(text) > 500 THEN 'dense' WHEN pos = n THEN 'last' END AS why,
    len(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda w: lower(w)))) * 0.5::DOUBLE + length(text) * 0.001::DOUBLE AS density FROM c),
  p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE why WHEN 'first' THEN 1 WHEN 'dense' THEN 2 ELSE 3 END, density DESC, doc_id) AS place FROM k WHERE why IS NOT NULL)
  SELECT source, doc_id, why FROM p WHERE why = 'all' OR place <= 3""")
def representatives(spark, sf_dir):
    words = F.size(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(A.SEARCH_WORD), F.lit(1)), lambda w: F.lower(w))))
    return S.representatives(table(spark, sf_dir, "documents"), ["source"], "doc_id", "text", words).select("source", "doc_id", "why")


@query("""SELECT source, count(*) AS n_docs, array_to_string(list_sort(list_distinct(list(lang) FILTER (lang IS NOT NULL))), ',') AS kinds, array_to_string((list(text[1:20] ORDER BY doc_id))[1:3], '|') AS previews FROM documents GROUP BY source""")
def coherence(spark, sf_dir):
    found = S.coherence(table(spark, sf_dir, "documents"), "source", "lang", "text", "doc_id", 3, 20)
    return found.select("source", "n_docs", F.array_join("kinds", ",").alias("kinds"), F.array_join("previews", "|").alias("previews"))


@query()
def memory_pipeline(spark, sf_dir):
    """Documents as memories of their source, a third of them external, two thirds short-term, ages from their ids."""
    of = lambda n: F.col("doc_id") % n
    records = table(spark, sf_dir, "documents").select(
        "source", F.col("doc_id").alias("pos"), F.col("doc_id").alias("id"), (F.pmod(F.xxhash64("doc_id"), F.lit(1000)) / 1000).alias("score"), "text",
        F.element_at(F.array(*map(F.lit, ("agent", "tenant", "user", "agent"))), (of(4) + 1).cast("int")).alias("layer"), F.when(of(3) == 0, "long_term").otherwise("short_term").alias("memory_type"),
        (of(3) == 1).alias("external"), of(30).cast("double").alias("age_days"), F.size(F.split("text", r"\s+")).alias("tokens"),
    )
    return M.retrieve(records, "source", 1200)


def memories(spark, sf_dir):
    """Memories with counters of an earlier round."""
    of = lambda n: F.col("memory_id") % n
    ids = table(spark, sf_dir, "events").select((F.col("event_id") % 250).alias("memory_id")).distinct()
    return ids.select(
        "memory_id", of(5).alias("recall_count"), of(2).alias("grounded_count"), of(3).alias("daily_count"), F.lit(None).cast("timestamp_ntz").alias("last_recalled_at"), of(4).alias("light_hits"), F.lit(None).cast("timestamp").alias("last_light_at"),
        F.when(of(7) == 0, "archived").otherwise("active").alias("status"), F.when(of(3) == 0, "long_term").otherwise("short_term").alias("memory_type"), F.lit("agent").alias("layer"),
        (now() - F.make_dt_interval(of(60).cast("int"))).alias("created_at"), F.array().cast("array<string>").alias("concept_tags"), of(6).alias("rem_hits"), F.lit(None).cast("timestamp").alias("last_rem_at"),
    )


@query("""WITH h AS (SELECT event_id % 200 AS memory_id, event_type = 'purchase' AS g, CAST(ts AS DATE) AS day, ts FROM events), s AS (SELECT memory_id, count(*) AS n, count(*) FILTER (g) AS g, count(DISTINCT day) AS d, max(ts) AS last FROM h GROUP BY 1),
  m AS (SELECT DISTINCT event_id % 250 AS id FROM events)
  SELECT id AS memory_id, coalesce(n, id % 5) AS recall_count, coalesce(g, id % 2) AS grounded_count, coalesce(d, id % 3) AS daily_count, last AS last_recalled_at, id % 4 + (n IS NOT NULL)::INT AS light_hits FROM m LEFT JOIN s ON id = memory_id""")
def light_phase(spark, sf_dir):
    found = M.light_phase(memories(spark, sf_dir), M.hit_stats(hits(spark, sf_dir)), now())
    return found.select("memory_id", "recall_count", "grounded_count", "daily_count", "last_recalled_at", "light_hits")


@query("""WITH m AS (SELECT DISTINCT event_id % 250 AS id FROM events), d AS (SELECT id, id % 7 <> 0 AND id % 3 <> 0 AND id % 60 <= 30 AS due FROM m)
  SELECT id AS memory_id, CASE WHEN due THEN 'seen' ELSE '' END AS tags, id % 6 + (due AND id % 11 <> 0)::INT AS rem_hits, due AND id % 11 <> 0 AS hit FROM d""")
def rem_phase(spark, sf_dir):
    found = M.rem_phase(memories(spark, sf_dir), now(), 30, F.array(F.lit("seen")), F.col("memory_id") % 11 == 0)
    return found.select("memory_id", F.array_join("concept_tags", ",").alias("tags"), "rem_hits", F.col("last_rem_at").isNotNull().alias("hit"))


@query("""SELECT c_custkey, count(o_orderkey) AS n_draws, count(*) FILTER (o_totalprice >= c_acctbal * 20) AS n_ge, round((count(*) FILTER (o_totalprice >= c_acctbal * 20) + 1) / (count(o_orderkey) + 1)::DOUBLE, 9) AS p
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def permutation_p(spark, sf_dir):
    observed = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") * 20).alias("similarity"))
    draws = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("similarity"))
    return V.permutation_p(observed, draws, ["c_custkey"]).select("c_custkey", "n_draws", "n_ge", F.round("p", 9).alias("p"))


@query("""SELECT round(count(*) FILTER (p_name IN (SELECT w FROM (SELECT unnest(string_split(p_type, ' ')) AS w FROM part) UNION SELECT p_name FROM part WHERE p_size > 40)) / count(*)::DOUBLE, 4) AS cov,
  round(count(*) FILTER (p_size > 10 AND p_partkey % 3 = 0) / count(*)::DOUBLE, 4) AS red, round(count(*) FILTER (p_partkey % 4 = 0) / count(*)::DOUBLE, 4) AS align FROM part""")
def ontology_shares(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    classes = part.select(F.col("p_name").alias("name"), F.when(F.col("p_size") > 10, F.col("p_brand")).alias("parent"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).alias("also_parent"), F.when(F.col("p_partkey") % 4 == 0, "x").otherwise("").alias("anchor"))
    seeds = part.select(F.explode(F.split("p_type", " ")).alias("word")).union(part.where("p_size > 40").select("p_name"))
    return V.ontology_shares(classes, seeds)
