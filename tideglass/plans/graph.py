"""Graph queries over nodes and edges made of the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideglass.operators import graph as G
from tideglass.plans._base import query, table

AT = "1998-01-01"


def edges(spark, sf_dir):
    """Orders placed by customers (valid from the order to its first shipment), nations of customers and suppliers, regions."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    shipped = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("invalid_at"))
    never, start = F.lit(None).cast("timestamp_ntz"), F.lit("1992-01-01").cast("timestamp_ntz")
    name = lambda letter, column: F.concat(F.lit(letter), F.col(column).cast("string"))
    placed = o.join(shipped, "o_orderkey", "left").select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst"), F.lit("placed").alias("rel_type"), F.col("o_orderdate").alias("valid_at"), "invalid_at")
    part = lambda t, a, b, la, lb, rel: table(spark, sf_dir, t).select(name(la, a).alias("src"), name(lb, b).alias("dst"), F.lit(rel).alias("rel_type"), start.alias("valid_at"), never.alias("invalid_at"))
    rest = part("customer", "c_custkey", "c_nationkey", "c", "n", "located_in").unionByName(part("supplier", "s_suppkey", "s_nationkey", "s", "n", "located_in")).unionByName(part("nation", "n_nationkey", "n_regionkey", "n", "r", "in_region"))
    return placed.unionByName(rest).withColumn("id", F.concat_ws(":", "src", "rel_type", "dst"))


_EDGES = """WITH RECURSIVE sh AS (SELECT l_orderkey, min(l_shipdate) AS d FROM lineitem GROUP BY 1), e0 AS (SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst, 'placed' AS rel_type, o_orderdate AS valid_at, d AS invalid_at FROM orders LEFT JOIN sh ON l_orderkey = o_orderkey
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'located_in', TIMESTAMP '1992-01-01', NULL FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'located_in', TIMESTAMP '1992-01-01', NULL FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'in_region', TIMESTAMP '1992-01-01', NULL FROM nation),
  e AS (SELECT *, concat_ws(':', src, rel_type, dst) AS id FROM e0), w AS (SELECT src AS node, dst AS other, id, rel_type, valid_at, invalid_at FROM e UNION ALL SELECT dst, src, id, rel_type, valid_at, invalid_at FROM e)"""
_ASOF = f"valid_at <= TIMESTAMP '{AT}' AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '{AT}')"


def at():
    return F.lit(AT).cast("timestamp_ntz")


def seeds(spark, sf_dir):
    return table(spark, sf_dir, "supplier").where("s_suppkey % 20 = 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"))


@query(f"""{_EDGES}, v AS (SELECT DISTINCT node, other FROM w WHERE {_ASOF}), b AS (SELECT 's' || s_suppkey AS seed, 's' || s_suppkey AS node, 0 AS hop FROM supplier WHERE s_suppkey % 20 = 0
  UNION SELECT b.seed, v.other, b.hop + 1 FROM b JOIN v ON v.node = b.node WHERE b.hop < 2) SELECT seed, node, CAST(min(hop) AS INTEGER) AS hop FROM b GROUP BY 1, 2""")
def neighbors_asof(spark, sf_dir):
    return G.neighbors(edges(spark, sf_dir), seeds(spark, sf_dir), 2, at())


@query(f"{_EDGES} SELECT (SELECT count(*) FROM customer) AS n_entities, count(*) AS n_edges, CAST(sum(CAST({_ASOF} AS INT)) AS BIGINT) AS n_valid_edges FROM e")
def graph_stats(spark, sf_dir):
    return G.stats(table(spark, sf_dir, "customer"), edges(spark, sf_dir), at())


@query(f"""{_EDGES}, v AS (SELECT DISTINCT node, other FROM w WHERE {_ASOF}), b AS (SELECT 's' || s_suppkey AS seed, 's' || s_suppkey AS node, 0 AS hop FROM supplier WHERE s_suppkey % 20 = 0
  UNION SELECT b.seed, v.other, b.hop + 1 FROM b JOIN v ON v.node = b.node WHERE b.hop < 2), m AS (SELECT seed, node, min(hop) AS hop FROM b GROUP BY 1, 2), g AS (SELECT node, count(DISTINCT id) AS degree FROM w GROUP BY 1),
  r AS (SELECT seed, m.node, hop, degree, row_number() OVER (PARTITION BY seed ORDER BY hop, degree DESC NULLS LAST, m.node) AS rank FROM m LEFT JOIN g ON g.node = m.node) SELECT seed, node, CAST(hop AS INTEGER) AS hop, degree, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def degree_route(spark, sf_dir):
    e = edges(spark, sf_dir)
    return G.route(G.neighbors(e, seeds(spark, sf_dir), 2, at()), G.degree(e), 10).select("seed", "node", "hop", "degree", "rank")


def entities(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("name"), F.col("c_name")).alias("props"), F.array("c_name").alias("aliases"), F.lit("1992-01-01").cast("timestamp_ntz").alias("valid_at"))


@query("""WITH i AS (SELECT o_custkey + 5 AS id, max(o_orderstatus || o_orderkey) AS x, max_by(o_orderstatus, o_orderkey) AS status, min_by(o_orderdate, o_orderkey) AS first_at, count(DISTINCT o_orderpriority) AS n_alias FROM orders GROUP BY 1)
  SELECT coalesce(c_custkey, i.id) AS id, c_mktsegment AS segment, i.status AS status, CAST((c_name IS NOT NULL)::INT + coalesce(n_alias, 0) AS INTEGER) AS n_aliases, CASE WHEN c_custkey IS NULL THEN first_at ELSE TIMESTAMP '1992-01-01' END AS valid_at
  FROM customer FULL JOIN i ON c_custkey = i.id""")
def upsert_merge(spark, sf_dir):
    incoming = table(spark, sf_dir, "orders").select((F.col("o_custkey") + 5).alias("id"), F.col("o_orderkey").alias("pos"), F.create_map(F.lit("status"), F.col("o_orderstatus")).alias("props"), F.array("o_orderpriority").alias("aliases"), F.col("o_orderdate").alias("valid_at"))
    merged = G.upsert_entities(entities(spark, sf_dir), incoming)
    return merged.select("id", F.col("props")["segment"].alias("segment"), F.col("props")["status"].alias("status"), F.size("aliases").alias("n_aliases"), "valid_at")


def tracked(spark, sf_dir):
    return edges(spark, sf_dir).withColumns({"superseded_at": F.lit(None).cast("timestamp_ntz"), "reason": F.lit(None).cast("string"), "claim": F.col("rel_type")})


@query(f"{_EDGES} SELECT id, CASE WHEN src LIKE 'c1%' THEN TIMESTAMP '{AT}' ELSE invalid_at END AS invalid_at, CASE WHEN src LIKE 'c1%' THEN 'newer edition' END AS reason FROM e")
def supersede(spark, sf_dir):
    e = tracked(spark, sf_dir)
    return G.supersede(e, e.where("src like 'c1%'"), at(), "newer edition").select("id", "invalid_at", "reason")


@query(f"{_EDGES} SELECT id, CASE WHEN src LIKE 'c1%' THEN NULL ELSE invalid_at END AS invalid_at, CASE WHEN src LIKE 'c1%' THEN 'newer edition' END AS reason FROM e")
def restore_edges(spark, sf_dir):
    e = tracked(spark, sf_dir)
    hit = e.where("src like 'c1%'")
    return G.restore(G.supersede(e, hit, at(), "newer edition"), hit).select("id", "invalid_at", "reason")


@query(f"""{_EDGES}, i AS (SELECT DISTINCT src, dst, rel_type, CASE WHEN src LIKE '%2' THEN 'other' ELSE rel_type END AS claim FROM e WHERE src LIKE 'c%')
  SELECT src, dst, rel_type, rel_type AS claim, valid_at, invalid_at, id FROM e UNION ALL SELECT src, dst, rel_type, claim, NULL, NULL, NULL FROM i WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src = i.src AND e.dst = i.dst AND e.rel_type = i.rel_type AND e.rel_type = i.claim AND e.invalid_at IS NULL)""")
def upsert_relations(spark, sf_dir):
    e = tracked(spark, sf_dir)
    incoming = e.where("src like 'c%'").select("src", "dst", "rel_type", F.when(F.col("src").endswith("2"), "other").otherwise(F.col("rel_type")).alias("claim"))
    return G.upsert_relations(e, incoming).select("src", "dst", "rel_type", "claim", "valid_at", "invalid_at", "id")


@query(f"{_EDGES} SELECT a.src, a.dst AS via, b.dst FROM e a JOIN e b ON a.dst = b.src WHERE a.rel_type = 'located_in' AND b.rel_type = 'in_region'")
def two_hop_paths(spark, sf_dir):
    return G.two_hop(edges(spark, sf_dir), "located_in", "in_region")


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS node, CASE WHEN p_partkey >= 4 THEN p_partkey // 4 END AS parent FROM part), d AS (SELECT node, 0 AS depth FROM p WHERE parent IS NULL UNION ALL SELECT p.node, d.depth + 1 FROM p JOIN d ON p.parent = d.node WHERE d.depth < 3)
  SELECT p.node, CAST(depth AS INTEGER) AS depth, depth IS NOT NULL AS ok FROM p LEFT JOIN d USING (node)""")
def depth_check(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") >= 4, F.floor(F.col("p_partkey") / 4)).alias("parent"))
    return G.depths(parts, 3)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('R') OR l_linestatus IN ('R') OR CAST(l_suppkey AS VARCHAR) IN ('3', 'R')")
def impact_overlap(spark, sf_dir):
    evidence = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_returnflag", "l_linestatus", F.col("l_suppkey").cast("string")).alias("entity_refs"))
    return G.impact(evidence, ["R", "3"]).select("l_orderkey", "l_linenumber")


@query("""WITH RECURSIVE e AS (SELECT o_orderkey AS a, CASE WHEN o_orderkey % 16 = 15 THEN o_orderkey ELSE o_orderkey + 1 END AS b FROM orders), w AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
  r AS (SELECT a AS node, a AS reach FROM w UNION SELECT r.node, w.b FROM r JOIN w ON r.reach = w.a) SELECT node, min(reach) AS component FROM r GROUP BY 1""")
def connected_components(spark, sf_dir):
    """Chains of up to 16 orders."""
    next_one = F.when(F.col("o_orderkey") % 16 == 15, F.col("o_orderkey")).otherwise(F.col("o_orderkey") + 1)
    e = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), next_one.alias("dst"))
    return G.components(e)


@query("""WITH e AS (SELECT DISTINCT least(l_suppkey, l_partkey % 50) AS a, greatest(l_suppkey, l_partkey % 50) AS b FROM lineitem WHERE l_suppkey <> l_partkey % 50), m AS (SELECT count(*) AS m FROM e), c AS (SELECT a % 4 AS ca, b % 4 AS cb FROM e),
  i AS (SELECT ca AS c, count(*) AS e FROM c WHERE ca = cb GROUP BY 1), k AS (SELECT c, count(*) AS k FROM (SELECT ca AS c FROM c UNION ALL SELECT cb FROM c) GROUP BY 1) SELECT round(sum(coalesce(e, 0) / m::DOUBLE - pow(k / (2.0::DOUBLE * m), 2)), 9) AS q FROM k LEFT JOIN i USING (c), m""")
def modularity(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") % 50).alias("p")).where("l_suppkey <> p")
    e = l.select(F.least("l_suppkey", "p").alias("src"), F.greatest("l_suppkey", "p").alias("dst")).distinct()
    nodes = e.select("src").union(e.select("dst")).distinct().select(F.col("src").alias("node"), (F.col("src") % 4).alias("community"))
    return G.modularity(e, nodes)


@query()
def beam_walk(spark, sf_dir):
    return G.beam_walk(edges(spark, sf_dir), seeds(spark, sf_dir))


@query("""WITH ed AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey * 2 END AS ev FROM orders), ev AS (SELECT l_orderkey AS e, l_partkey AS d, l_orderkey + 1 AS listed FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) WHERE n = 1),
  li AS (SELECT listed AS id, min(e) AS e FROM ev GROUP BY 1), u AS (SELECT ed.id, coalesce(ed.ev, li.e) AS use FROM ed LEFT JOIN li USING (id)), x AS (SELECT u.id, use, d, CASE WHEN p_size > 25 THEN p_size END AS published FROM u LEFT JOIN ev ON use = ev.e LEFT JOIN part ON d = p_partkey)
  SELECT CASE WHEN use IS NULL THEN 'no_evidence' WHEN d IS NULL THEN 'evidence_missing' WHEN published IS NULL THEN 'no_date' ELSE 'repaired' END AS reason, count(*) AS n FROM x GROUP BY 1""")
def fact_time_repair(spark, sf_dir):
    from tideglass.operators.relational import first_per_key

    ed = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") * 2).alias("evidence_id"))
    one = first_per_key(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"])
    ev = one.select(F.col("l_orderkey").alias("evidence_id"), F.col("l_partkey").alias("doc_id"), F.array(F.col("l_orderkey") + 1).alias("edge_ids"))
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.when(F.col("p_size") > 25, F.col("p_size")).alias("published"))
    return G.fact_times(ed, ev, docs).groupBy("reason").agg(F.count("*").alias("n"))
