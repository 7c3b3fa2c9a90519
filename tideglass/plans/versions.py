"""Versions, runs, communities and schedules over the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideglass.functions import answers as A
from tideglass.operators import communities as C
from tideglass.operators import schedules as S
from tideglass.operators import versions as V
from tideglass.plans._base import query, table


def proposals(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50).alias("confidence"), (F.col("p_partkey") % 5 / 5).alias("novelty"), (F.col("p_partkey") % 7 / 7).alias("impact"), F.when(F.col("p_partkey") % 9 == 0, "rejected").alias("status"), F.split("p_name", " ").alias("documents"))


@query("""WITH p AS (SELECT p_partkey AS id, p_size / 50.0::DOUBLE AS c, (p_partkey % 5) / 5.0::DOUBLE AS n, (p_partkey % 7) / 7.0::DOUBLE AS i, CASE WHEN len(list_distinct(string_split(p_name, ' '))) >= 2 THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END AS ev, p_partkey % 9 = 0 AS rejected FROM part),
  s AS (SELECT *, round(0.5::DOUBLE * c + 0.2::DOUBLE * n + 0.3::DOUBLE * i, 6) AS score FROM p) SELECT id, score, ev, c >= 0.6::DOUBLE AND NOT rejected AND ev = 1 AS auto, row_number() OVER (ORDER BY score DESC, ev DESC, id) AS place FROM s""")
def proposal_rank(spark, sf_dir):
    from tideglass.operators.ordered import in_order

    p = proposals(spark, sf_dir)
    p = p.select("id", F.round(V.proposal_score(F.col("confidence"), F.col("novelty"), F.col("impact")), 6).alias("score"), V.evidence_richness(F.col("documents")).alias("ev"), V.auto_accepted(0.6).alias("auto"))
    return in_order(p, [F.desc("score"), F.desc("ev"), "id"])


@query("SELECT l_partkey AS name, 0.5::DOUBLE AS confidence, least(1.0::DOUBLE, count(*) / 10.0::DOUBLE) AS impact FROM lineitem GROUP BY 1 HAVING count(*) >= 3")
def pending_backflow(spark, sf_dir):
    return V.pending_proposals(table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("name")).agg(F.count("*").alias("mention_count")))


@query("""SELECT l_orderkey, string_agg(op, ',' ORDER BY l_linenumber, i) AS ops FROM (SELECT l_orderkey, l_linenumber, unnest([l_returnflag, l_linestatus]) AS op, unnest([1, 2]) AS i FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_returnflag, l_linestatus) WHERE l_linenumber > 1 AND l_linenumber <= 4) GROUP BY 1""")
def version_diff(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("position")).agg(F.min(F.struct("l_returnflag", "l_linestatus")).alias("m"))
    diff = V.version_diff(rows.select("l_orderkey", "position", F.array("m.l_returnflag", "m.l_linestatus").alias("ops")), ["l_orderkey"], F.lit(1), F.lit(4))
    return diff.select("l_orderkey", F.array_join("ops", ",").alias("ops"))


@query("""SELECT user_id, k AS item FROM (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS k, event_type, row_number() OVER (PARTITION BY user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 ORDER BY event_id DESC) AS n FROM events WHERE event_type IN ('signup', 'click', 'error')) WHERE n = 1 AND event_type <> 'error'""")
def oplog_fold(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("user_id", (F.get_json_object("props", "$.k").cast("int") % 10).alias("item"), "event_id", F.col("event_type").alias("op"))
    return V.fold_log(log, ["user_id"], "item", "event_id", ["signup", "click"], ["error"]).select("user_id", "item")


@query("SELECT p_type AS change_type, lower(p_brand) AS topic, count(*) AS n, array_to_string(list_sort(list_distinct(flatten(list(string_split(p_name, ' '))))), ' ') AS words FROM part WHERE p_type <> 'PROMO' GROUP BY 1, 2")
def change_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("change_type"), F.concat(F.lit(" "), F.col("p_brand"), F.lit("  ")).alias("anchor"), F.split("p_name", " ").alias("tokens"))
    return V.change_groups(rows, unchanged="PROMO").select("change_type", "topic", "n", F.array_join("tokens", " ").alias("words"))


@query("SELECT c_nationkey, c_mktsegment, count(*) AS support, count(*) >= 3 AS kept FROM customer GROUP BY 1, 2")
def group_cards(spark, sf_dir):
    return V.cards(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], 3)


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, event_type) AS n FROM c) SELECT user_id, string_agg(event_type, ' -> ' ORDER BY n) AS hint FROM r WHERE n <= 3 GROUP BY 1""")
def relation_hint(spark, sf_dir):
    return V.relation_hint(table(spark, sf_dir, "events"), ["user_id"], "event_type", 3)


@query("SELECT doc_id, quality AS score FROM labels WHERE doc_id < 100 UNION ALL SELECT doc_id, toxic FROM labels WHERE doc_id >= 100")
def partial_merge(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return V.merge_partial(labels.select("doc_id", F.col("quality").alias("score")), labels.select("doc_id", F.col("toxic").alias("score")), "doc_id", F.lit(100))


@query("SELECT o_custkey, max(o_orderkey) + 1 AS next FROM orders GROUP BY 1")
def next_version_number(spark, sf_dir):
    return V.next_number(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey")


@query("""WITH d AS (SELECT unnest(['view', 'click', 'purchase', 'refund']) AS kind), e AS (SELECT event_type AS kind, count(*) AS n, count(*) FILTER (user_id % 4 > 0) AS n_judged, count(*) FILTER (value > 150) AS n_fault, count(*) FILTER (user_id % 4 = 1)::DOUBLE AS good, round(quantile_cont(value, 0.95), 4) AS p95 FROM events GROUP BY 1)
  SELECT d.kind, coalesce(n, 0) AS n, coalesce(n_judged, 0) AS n_judged, coalesce(n_fault, 0) AS n_fault, round(good / n_judged, 4) AS accuracy, p95 FROM d LEFT JOIN e USING (kind)""")
def run_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.when(F.col("user_id") % 4 > 0, F.col("user_id") % 4 == 1).alias("passed"), (F.col("value") > 150).alias("fault"), F.col("value").alias("seconds"))
    return V.run_summary(rows, ["view", "click", "purchase", "refund"])


@query("SELECT l_returnflag, round(sum(l_quantity), 4) AS baseline, round(sum(l_quantity * (1 - l_discount)), 4) AS changed, round(1 - sum(l_quantity * (1 - l_discount)) / sum(l_quantity), 4) AS saved FROM lineitem GROUP BY 1")
def token_reduction(spark, sf_dir):
    out = V.reduction(table(spark, sf_dir, "lineitem"), F.col("l_quantity"), F.col("l_quantity") * (1 - F.col("l_discount")), ["l_returnflag"])
    return out.select("l_returnflag", F.round("baseline", 4).alias("baseline"), F.round("changed", 4).alias("changed"), "saved")


@query("SELECT event_id, count(value) OVER w AS n_so_far, round(avg(value) OVER w, 6) AS mean_so_far FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def running_means(spark, sf_dir):
    return V.running_mean(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "n_so_far", F.round("mean_so_far", 6).alias("mean_so_far"))


@query("SELECT o_custkey, o_orderkey, CAST(n AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 3")
def timeline(spark, sf_dir):
    return V.timeline(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey", 3).select("o_custkey", "o_orderkey", "place")


@query("SELECT o_orderkey, o_orderstatus = 'F' OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) AS rerun FROM orders")
def mark_for_rerun(spark, sf_dir):
    cards = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("rerun"))
    return V.mark(cards, table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "rerun")


@query("""WITH f AS (SELECT conv_id, min_by(text, turn) FILTER (role = 'user') AS a, min_by(text, turn) FILTER (role = 'assistant') AS b FROM conversations GROUP BY 1) SELECT conv_id, CASE WHEN b IS NOT NULL THEN a END AS first_user, CASE WHEN a IS NOT NULL THEN b END AS first_answer FROM f""")
def first_pairs(spark, sf_dir):
    units = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("kind"), F.col("text").alias("content"))
    return V.first_pairs(units, ["conv_id"], "turn", "user", "assistant").select("conv_id", F.col("pair.user").alias("first_user"), F.col("pair.assistant").alias("first_answer"))


@query("SELECT event_type, round(count(*) FILTER (value > 50) / count(*)::DOUBLE, 6) AS rate, CASE WHEN count(*) FILTER (value > 50) >= 0.8 * count(*) THEN 'excellent' WHEN count(*) FILTER (value > 50) >= 0.5 * count(*) THEN 'good' ELSE 'needs_improvement' END AS level, CASE WHEN count(*) FILTER (value > 100) >= 0.7 * count(*) THEN 'high' WHEN count(*) FILTER (value > 100) >= 0.4 * count(*) THEN 'medium' ELSE 'low' END AS quality FROM events GROUP BY 1")
def level_bands(spark, sf_dir):
    n = F.count("*")
    rate = F.count_if(F.col("value") > 50) / n
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(rate, 6).alias("rate"), A.score_level(rate).alias("level"), A.quality_level(F.count_if(F.col("value") > 100), n).alias("quality"))


@query("""WITH t AS (SELECT p_partkey, lower(p_name) AS a, lower(p_brand || ' ' || p_type) AS b FROM part) SELECT p_partkey, array_to_string(list_filter(string_split(a, ' ') , lambda x: regexp_matches(x, '^[a-z0-9_]+$')), ' ') AS terms FROM t""")
def search_term_sets(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(A.search_terms(F.col("p_name")), " ").alias("terms"))


@query()
def greedy_communities(spark, sf_dir):
    return C.greedy_modularity(_trade(spark, sf_dir))


@query()
def propagated_labels(spark, sf_dir):
    return C.label_propagation(_trade(spark, sf_dir))


def _trade(spark, sf_dir):
    """Nations linked by the suppliers and customers of an order."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    pairs = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return pairs.groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT p_partkey AS node, p_brand AS community FROM part), q AS (SELECT p_partkey AS query_id, unnest(string_split(p_name, ' ')) AS term FROM part WHERE p_partkey % 20 = 0), t AS (SELECT DISTINCT p_brand AS community, unnest(string_split(p_name, ' ')) AS term FROM part), z AS (SELECT p_brand AS community, count(*) AS size FROM part GROUP BY 1),
  s AS (SELECT query_id, community, size, count(*) AS score FROM (SELECT DISTINCT * FROM q) JOIN t USING (term) JOIN z USING (community) GROUP BY ALL) SELECT query_id, community, score, CAST(n AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, size DESC, community) AS n FROM s) WHERE n <= 3""")
def community_rank(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    size = p.groupBy("p_brand").agg(F.count("*").alias("size"))
    terms = p.join(size, "p_brand").select(F.col("p_brand").alias("community"), "size", F.explode(F.split("p_name", " ")).alias("term"))
    return C.rank_communities(p.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), F.explode(F.split("p_name", " ")).alias("term")), terms)


_SKELETONS = """WITH e AS (SELECT s_suppkey AS id, 's' || s_suppkey AS src, 'n' || s_nationkey AS community, s_name AS claim FROM supplier), m AS (SELECT src AS node, community FROM e UNION ALL SELECT 'n' || n_nationkey, 'n' || n_nationkey FROM nation),
  nm AS (SELECT 's' || s_suppkey AS node, s_name AS name FROM supplier UNION ALL SELECT 'n' || n_nationkey, n_name FROM nation), dg AS (SELECT node, CASE WHEN node = community THEN (SELECT count(*) FROM e WHERE e.community = m.community) ELSE 1 END AS degree FROM m),
  t AS (SELECT community, count(*) AS size, list(name ORDER BY degree DESC, node)[1:8] AS top_entities FROM m JOIN nm USING (node) JOIN dg USING (node) GROUP BY 1),
  k AS (SELECT community, ['located_in:' || count(*)] AS rel_types, list(claim ORDER BY id)[1:3] AS claims FROM e GROUP BY 1),
  sk AS (SELECT community, size, top_entities, coalesce(rel_types, []) AS rel_types, coalesce(claims, []) AS claims FROM t LEFT JOIN k USING (community))"""


def _located(spark, sf_dir):
    """Suppliers and nations: edges, membership by nation, names."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    edges = s.select(F.col("s_suppkey").alias("id"), name("s", "s_suppkey").alias("src"), name("n", "s_nationkey").alias("dst"), F.lit("located_in").alias("rel_type"), F.col("s_name").alias("claim"))
    members = s.select(name("s", "s_suppkey").alias("node"), name("n", "s_nationkey").alias("community")).unionByName(n.select(name("n", "n_nationkey").alias("node"), name("n", "n_nationkey").alias("community")))
    names = s.select(name("s", "s_suppkey").alias("node"), F.col("s_name").alias("name")).unionByName(n.select(name("n", "n_nationkey").alias("node"), F.col("n_name").alias("name")))
    return edges, members, names


@query(f"""{_SKELETONS} SELECT community, size, array_to_string(top_entities, '|') AS top_entities, array_to_string(rel_types, '|') AS rel_types, array_to_string(claims, '|') AS claims,
  sha256(CAST(to_json({{'community': community, 'size': size, 'top_entities': top_entities, 'rel_types': rel_types, 'claims': claims}}) AS VARCHAR)) AS fingerprint FROM sk""")
def community_skeletons(spark, sf_dir):
    edges, members, names = _located(spark, sf_dir)
    shown = C.skeletons(members, edges, names)
    return shown.select("community", "size", *(F.array_join(c, "|").alias(c) for c in ("top_entities", "rel_types", "claims")), "fingerprint")


@query(f"""{_SKELETONS}, g AS (SELECT n_nationkey AS query_id, unnest(list_distinct(regexp_extract_all(lower(n_name || ' Supplier#00000000' || n_nationkey), '[a-z0-9_]+'))) AS term FROM nation),
  st AS (SELECT DISTINCT community, size, unnest(regexp_extract_all(lower(array_to_string(top_entities || claims, ' ') || CASE WHEN len(rel_types) > 0 THEN ' located_in' ELSE '' END), '[a-z0-9_]+')) AS term FROM sk),
  h AS (SELECT query_id, community, count(*) AS score, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, size DESC, community) AS place FROM g JOIN st USING (term) GROUP BY query_id, community, size QUALIFY place <= 2),
  mm AS (SELECT query_id, node, min(place) AS place FROM h JOIN m USING (community) GROUP BY ALL),
  x AS (SELECT DISTINCT query_id, 'r' || n_regionkey AS node FROM mm JOIN nation ON node = 'n' || n_nationkey)
  SELECT query_id, node, CAST(0 AS INTEGER) AS hop, CAST(place AS INTEGER) AS place FROM mm UNION ALL SELECT query_id, node, 1, NULL FROM x""")
def global_route(spark, sf_dir):
    """Nations' names ask; communities are nations with their suppliers, and edges to regions lead out of them."""
    edges, members, names = _located(spark, sf_dir)
    n = table(spark, sf_dir, "nation")
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    out = n.select((-F.col("n_nationkey") - 1).alias("id"), name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst"), F.lit("in_region").alias("rel_type"), F.lit(None).cast("string").alias("claim"))
    asked = n.select(F.col("n_nationkey").alias("query_id"), F.concat("n_name", F.lit(" Supplier#00000000"), F.col("n_nationkey")).alias("query"))
    return C.global_route(asked, edges.unionByName(out), names, members, top_n=2, depth=1)[1]


@query("""SELECT o_orderkey, o_orderdate + INTERVAL 1 HOUR * (CASE WHEN TIMESTAMP '1998-01-01' <= o_orderdate THEN 0 ELSE (date_diff('second', o_orderdate, TIMESTAMP '1998-01-01') // (3600 * (1 + o_orderkey % 5)) + 1) * (1 + o_orderkey % 5) END) AS next_at FROM orders""")
def next_interval(spark, sf_dir):
    none, at = F.lit(None), F.lit("1998-01-01").cast("timestamp_ntz")
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.lit("interval").alias("mode"), none.cast("string").alias("rule"), (3600 * (1 + F.col("o_orderkey") % 5)).alias("interval_seconds"), F.col("o_orderdate").cast("timestamp_ntz").alias("start_at"),
        none.cast("timestamp_ntz").alias("end_at"), at.alias("after"), F.lit(1).alias("fire_count"), none.cast("int").alias("max_fire_count"), none.cast("string").alias("zone"),
    )
    return S.next_fire(o).select("o_orderkey", "next_at")


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderdate AS s, greatest(o_orderdate, TIMESTAMP '1996-06-15 06:30:00') AS b, TIMESTAMP '1996-06-15 06:30:00' <= o_orderdate AS same FROM orders),
  n AS (SELECT k, CASE k % 4 WHEN 0 THEN CASE WHEN k % 8 = 0 THEN b END WHEN 1 THEN CASE WHEN same THEN s ELSE s + INTERVAL 1 HOUR * ((date_diff('second', s, b) // 18000 + 1) * 5) END
    WHEN 2 THEN date_trunc('day', b) + INTERVAL 390 MINUTE + CASE WHEN date_trunc('day', b) + INTERVAL 390 MINUTE < b OR (date_trunc('day', b) + INTERVAL 390 MINUTE = b AND NOT same) THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END
    ELSE CASE WHEN date_trunc('month', b) = b AND same THEN b ELSE date_trunc('month', b) + INTERVAL 1 MONTH END END AS fire FROM o)
  SELECT k AS o_orderkey, CASE WHEN fire <= TIMESTAMP '1998-06-30' THEN fire END AS next_at FROM n""")
def next_by_mode(spark, sf_dir):
    """Orders as one-off, interval, daily and monthly schedules from their dates on, some fired already, all of them over in mid 1998."""
    k, none = F.col("o_orderkey"), F.lit(None)
    ntz = lambda c: c.cast("timestamp_ntz")
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k % 4 == 0, "once").when(k % 4 == 1, "interval").otherwise("cron").alias("mode"), F.when(k % 4 == 2, "30 6 * * *").when(k % 4 == 3, "0 0 1 * *").alias("rule"), F.lit(18_000).alias("interval_seconds"),
        ntz(F.col("o_orderdate")).alias("start_at"), ntz(F.lit("1998-06-30")).alias("end_at"), ntz(F.lit("1996-06-15 06:30:00")).alias("after"), (k % 8 == 4).cast("int").alias("fire_count"), none.cast("int").alias("max_fire_count"), none.cast("string").alias("zone"),
    )
    return S.next_fire(o).select("o_orderkey", "next_at")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1997-01-01' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def due_schedules(spark, sf_dir):
    due = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("schedule_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("next_at"))
    active = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("schedule_id"))
    return S.materialise(due, active, F.lit("1997-01-01").cast("timestamp_ntz")).select(F.col("schedule_id").alias("o_orderkey"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY")
def retention(spark, sf_dir):
    return S.retained(table(spark, sf_dir, "events"), "ts", F.lit("2024-01-31").cast("timestamp_ntz"), 7).select("event_id")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN false WHEN o_orderkey % 4 = 1 THEN true ELSE TIMESTAMP '1998-01-01' >= o_orderdate + INTERVAL 1 DAY AND (o_orderkey % 3 = 0 OR o_orderkey % 3 = 1) END AS due FROM orders""")
def summary_due(spark, sf_dir):
    k, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp_ntz")
    last, interval = F.when(k % 4 != 1, at), F.when(k % 4 > 0, F.make_dt_interval(F.lit(1)))
    changed = F.when(k % 3 == 1, at + F.make_dt_interval(F.lit(2))).when(k % 3 == 2, at)
    return table(spark, sf_dir, "orders").select("o_orderkey", S.due_for_summary(last, interval, changed, F.lit("1998-01-01").cast("timestamp_ntz")).alias("due"))


@query("SELECT c_custkey, replace(replace(replace(to_base64(encode('[\"' || c_name || '\",\"' || c_mktsegment || '\"]')), '+', '-'), '/', '_'), '=', '') AS coded, c_name AS first FROM customer")
def resource_ids(spark, sf_dir):
    coded = A.resource_id(F.col("c_name"), F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", coded.alias("coded"), A.resource_parts(coded)[0].alias("first"))
