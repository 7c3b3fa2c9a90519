"""Bi-temporal property graph: upserts, as-of neighbourhoods, beam walks, supersession, components, modularity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideglass.operators.relational import current_view

#: Nodes found that a seed's row carries along.
FEW = 100


def upsert_entities(nodes: DataFrame, incoming: DataFrame) -> DataFrame:
    """nodes (id, props map, aliases array, valid_at) merged with incoming rows (the same and pos, their order).

    Incoming properties win, later ones over earlier; new aliases are appended once; a node keeps the valid_at
    of its first row.
    """
    merge = lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)
    empty_map, empty = F.create_map().cast("map<string,string>"), F.array().cast("array<string>")
    listed = F.array_sort(F.collect_list(F.struct("pos", F.map_entries(F.coalesce("props", empty_map)).alias("props"), "aliases", "valid_at")))
    rows = incoming.groupBy("id").agg(listed.alias("rows"))
    new = rows.select(
        F.col("id").alias("__id"),
        F.aggregate("rows", empty_map, lambda acc, r: merge(acc, F.map_from_entries(r["props"]))).alias("__props"),
        F.array_distinct(F.flatten(F.transform("rows", lambda r: F.coalesce(r["aliases"], empty)))).alias("__aliases"),
        F.element_at("rows", 1)["valid_at"].alias("__valid_at"),
    )
    both = nodes.join(new, F.col("id") == F.col("__id"), "full")
    return both.select(
        F.coalesce("id", "__id").alias("id"),
        merge(F.coalesce("props", empty_map), F.coalesce("__props", empty_map)).alias("props"),
        F.array_distinct(F.concat(F.coalesce("aliases", empty), F.coalesce("__aliases", empty))).alias("aliases"),
        F.coalesce("valid_at", "__valid_at").alias("valid_at"),
    )


def upsert_relations(edges: DataFrame, incoming: DataFrame) -> DataFrame:
    """edges with those of incoming (src, dst, rel_type, claim ...) that no current edge states; a new claim is a new row.

    Current edges and incoming rows are grouped together, so that a key is held once: not in a map of distinct
    rows and in the sorted rows of an anti-join. A key with a null in it is stated by no edge.
    """
    key = ["src", "dst", "rel_type", "claim"]
    whole = " and ".join(f"{k} is not null" for k in key)
    stated = edges.where(f"invalid_at is null and {whole}").select(*key, F.lit(True).alias("__stated"))
    rest = [F.first(c).alias(c) for c in incoming.columns if c not in key]
    rows = incoming.unionByName(stated, allowMissingColumns=True).groupBy(*key).agg(F.max("__stated").alias("__stated"), *rest)
    new = rows.where("__stated is null").select(*incoming.columns)
    return edges.unionByName(new, allowMissingColumns=True)


def supersede(edges: DataFrame, ids: DataFrame, at: Column, reason: str) -> DataFrame:
    """edges with those of ids (id) ended: invalid_at, superseded_at and reason are set, nothing is deleted."""
    hit = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    out = edges.join(hit, "id", "left")
    set_to = lambda name, value: F.when(F.col("__hit"), value).otherwise(F.col(name)).alias(name)
    changed = {"invalid_at": at, "superseded_at": at, "reason": F.lit(reason)}
    return out.select(*(set_to(c, changed[c]) if c in changed else F.col(c) for c in edges.columns))


def restore(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Undoes supersede for ids; the reason stays."""
    hit = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    out = edges.join(hit, "id", "left")
    clear = lambda name: F.when(F.col("__hit"), F.lit(None)).otherwise(F.col(name)).alias(name)
    return out.select(*(clear(c) if c in ("invalid_at", "superseded_at") else F.col(c) for c in edges.columns))


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, other, id, rel_type): each edge from either end."""
    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), "id", "rel_type")
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "id", "rel_type").unionByName(back)


def neighbors(edges: DataFrame, seeds: DataFrame, hops: int, at: Column | None = None, rel_types: Sequence[str] = ()) -> DataFrame:
    """(seed, node, hop): the least number of edges from a seed, undirected, up to `hops`; many seeds at once.

    Each hop is one equi-join of the frontier with the edges seen from both ends, so no OR-join is needed.
    """
    if at is not None:
        edges = current_view(edges, at)
    if rel_types:
        edges = edges.where(F.col("rel_type").isin(list(rel_types)))
    ways = both_ways(edges).select("node", "other").distinct()
    found = seeds.select(F.col("node").alias("seed"), "node").distinct().withColumn("hop", F.lit(0))
    frontier = found
    for k in range(1, hops + 1):
        frontier = _step(frontier, found, ways).withColumn("hop", F.lit(k))
        if k < hops:
            frontier = frontier.checkpoint()  # each hop is read by all later ones
        found = found.unionByName(frontier)
    return found


def _step(frontier: DataFrame, found: DataFrame, ways: DataFrame) -> DataFrame:
    """(seed, node): the new nodes one edge beyond the frontier.

    A seed with one frontier node meets no node twice: while it has found at most FEW nodes, these go along in its row, and the join's
    rows are neither gathered nor shuffled, however many a node has. The other seeds' are made distinct.
    """
    one = frontier.groupBy("seed").count().where("count = 1").select("seed").join(found.groupBy("seed").count().where(F.col("count") <= FEW).select("seed"), "seed")
    seen = found.join(one, "seed", "left_semi").groupBy("seed").agg(F.collect_list("node").alias("__seen"))
    plain = frontier.join(seen, "seed").join(ways, "node").where(~F.coalesce(F.array_contains("__seen", F.col("other")), F.lit(False))).select("seed", F.col("other").alias("node"))
    step = frontier.join(one, "seed", "left_anti").join(ways, "node").select("seed", F.col("other").alias("node")).distinct()
    return plain.unionByName(step.join(found.select("seed", "node"), ["seed", "node"], "left_anti"))


def degree(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("node").agg(F.countDistinct("id").alias("degree"))


def route(found: DataFrame, degrees: DataFrame, k: int) -> DataFrame:
    """The k nodes of each seed by (hop, degree descending, name)."""
    order = Window.partitionBy("seed").orderBy("hop", F.desc_nulls_last("degree"), "node")
    return found.join(degrees, "node", "left").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def stats(nodes: DataFrame, edges: DataFrame, at: Column) -> DataFrame:
    """One row: entities, edges, edges valid at a time."""
    valid = (F.col("valid_at") <= at) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > at))
    e = edges.agg(F.count("*").alias("n_edges"), F.coalesce(F.sum(valid.cast("bigint")), F.lit(0)).alias("n_valid_edges"))
    return nodes.agg(F.count("*").alias("n_entities")).crossJoin(e)  # one row each


def beam_walk(edges: DataFrame, seeds: DataFrame, depth: int = 3, beam: int = 3) -> DataFrame:
    """(seed, place, path): greedy walks without cycles, undirected.

    A path goes on over the first `beam` edges (by id) of its last node, those back into the path left out
    after that choice; a path that can't go on stays. Per seed and step the `beam` longest paths are kept, by path.
    """
    ranked = both_ways(edges).withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy("id", "other"))).where(F.col("n") <= beam)
    live = seeds.select(F.col("node").alias("seed"), F.array("node").alias("path")).distinct()
    for _ in range(depth):
        ends = live.withColumn("node", F.element_at("path", -1))
        longer = ends.join(ranked, "node").where(~F.array_contains("path", F.col("other"))).select("seed", F.concat("path", F.array("other")).alias("path"), F.col("path").alias("before"))
        stuck = live.join(longer.select("seed", F.col("before").alias("path")).distinct(), ["seed", "path"], "left_anti")
        every = longer.select("seed", "path").unionByName(stuck).distinct()
        best = Window.partitionBy("seed").orderBy(F.desc(F.size("path")), F.array_join("path", ">"))
        live = every.withColumn("n", F.row_number().over(best)).where(F.col("n") <= beam).drop("n").checkpoint()  # else the plan doubles with each step
    order = Window.partitionBy("seed").orderBy(F.desc(F.size("path")), F.array_join("path", ">"))
    return live.select("seed", F.row_number().over(order).alias("place"), F.array_join("path", ">").alias("path"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of the edges reaches. Large-star and small-star rounds with checkpoints."""
    pairs = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct().checkpoint()
    seen = None
    while True:
        state = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or not state["n"]:
            break
        seen = state
        ways = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = ways.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct().checkpoint()
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """One row q: sum over communities of e / m - (k / 2m)^2, for a simple undirected graph."""
    m = membership.select("node", "community")
    at = edges.join(m.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(m.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst")
    inside = at.where("a = b").groupBy(F.col("a").alias("community")).agg(F.count("*").alias("e"))
    ends = at.select(F.explode(F.array("a", "b")).alias("community")).groupBy("community").agg(F.count("*").alias("k"))
    total = edges.agg(F.count("*").alias("m"))
    parts = ends.join(inside, "community", "left").crossJoin(F.broadcast(total))  # one row
    return parts.agg(F.round(F.sum(F.coalesce("e", F.lit(0)) / F.col("m") - F.pow(F.col("k") / (2.0 * F.col("m")), 2)), 9).alias("q"))


def two_hop(edges: DataFrame, first: str, second: str) -> DataFrame:
    """(src, via, dst) over an edge of the first and one of the second type."""
    a = edges.where(F.col("rel_type") == first).select("src", F.col("dst").alias("via"))
    return a.join(edges.where(F.col("rel_type") == second).select(F.col("src").alias("via"), "dst"), "via").select("src", "via", "dst")


def depths(parents: DataFrame, most: int = 5) -> DataFrame:
    """(node, depth, ok) of a forest (node, parent or null): steps to a root; deeper than `most`, or in a cycle: depth null, not ok."""
    level = parents.where("parent is null").select("node", F.lit(0).alias("depth"))
    found = level
    for k in range(1, most + 1):
        level = parents.join(level.select(F.col("node").alias("parent")), "parent").select("node", F.lit(k).alias("depth"))
        found = found.unionByName(level)
    return parents.select("node").join(found, "node", "left").withColumn("ok", F.col("depth").isNotNull())


def impact(evidence: DataFrame, changed: Sequence[str]) -> DataFrame:
    """Evidence rows whose entity_refs overlap the changed entities."""
    return evidence.where(F.arrays_overlap("entity_refs", F.array(*map(F.lit, changed))))


def fact_times(edges: DataFrame, evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, valid_at, reason): the date of the document behind an edge: by its evidence_id, else by evidence that lists the edge."""
    e = evidence.select(F.col("evidence_id").alias("__ev"), F.col("doc_id").alias("__doc"))
    listed = evidence.select(F.explode("edge_ids").alias("id"), "evidence_id").groupBy("id").agg(F.min("evidence_id").alias("__listed"))
    out = edges.select("id", "evidence_id").join(listed, "id", "left")
    out = out.withColumn("__use", F.coalesce("evidence_id", "__listed")).join(e, F.col("__use") == F.col("__ev"), "left")
    out = out.join(documents.select(F.col("doc_id").alias("__d"), "published"), F.col("__doc") == F.col("__d"), "left")
    reason = F.when(F.col("__use").isNull(), "no_evidence").when(F.col("__doc").isNull(), "evidence_missing").when(F.col("published").isNull(), "no_date").otherwise("repaired")
    return out.select("id", F.col("published").alias("valid_at"), reason.alias("reason"))
