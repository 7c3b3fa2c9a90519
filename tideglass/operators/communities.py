"""Communities of a simple undirected graph: label propagation, greedy modularity, skeletons, ranking, expansion, the global route.

Both clusterings are sequential by definition, but what happens in one connected component depends on no other
(greedy modularity needs the number of all edges besides). Components of up to a stated number of edges are
clustered exactly, a task each. Larger ones are clustered in rounds over tables, which follow the same rule for many nodes or
pairs at once: their communities may differ from the sequential ones, and `graph.modularity` measures how good they are.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideglass.functions.answers import search_terms
from tideglass.operators.graph import components
from tideglass.operators.rounds import settled

#: Passes of label propagation, entities and claims of a skeleton, communities of an answer, new neighbours a node.
MOST_PASSES, TOP_ENTITIES, TOP_CLAIMS, TOP_COMMUNITIES, BEAM = 16, 8, 3, 3, 3

#: Edges of a component that is clustered in one task; parts of the nodes of larger ones that take turns in a pass.
MOST_EDGES, _SHARES = 200_000, 8


def simple_edges(edges: DataFrame) -> DataFrame:
    """(src, dst) as strings, src < dst, each once."""
    a, b = F.col("src").cast("string"), F.col("dst").cast("string")
    return edges.where(a != b).select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).distinct()


def _neighbours(rows: pd.DataFrame) -> dict[str, set[str]]:
    out: dict[str, set[str]] = {}
    for a, b in zip(rows["src"], rows["dst"]):
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set()).add(a)
    return out


def _frame(label: dict[str, str]) -> pd.DataFrame:
    least: dict[str, str] = {}
    for node, of in label.items():
        least[of] = min(least.get(of, node), node)
    return pd.DataFrame([(n, least[of]) for n, of in label.items()], columns=["node", "community"])


def _propagate(rows: pd.DataFrame, passes: int) -> pd.DataFrame:
    near = _neighbours(rows)
    label = {n: n for n in near}
    for _ in range(passes):
        before = dict(label)
        for node in sorted(near):
            votes: dict[str, int] = {}
            for other in near[node]:
                votes[label[other]] = votes.get(label[other], 0) + 1
            most = max(votes.values())
            label[node] = min(of for of, n in votes.items() if n == most)
        if label == before:
            break
    return _frame(label)


def _merge(rows: pd.DataFrame, m: int) -> pd.DataFrame:
    """Gains are compared as whole numbers: 2 m^2 dQ = 2 m e_ab - K_a K_b. A heap holds them; entries that changed since are passed over."""
    near = _neighbours(rows)
    weight = {n: len(x) for n, x in near.items()}
    between = {n: dict.fromkeys(x, 1) for n, x in near.items()}
    members = {n: [n] for n in near}
    gain = lambda a, b: 2 * m * between[a][b] - weight[a] * weight[b]
    heap = [(-gain(a, b), a, b) for a, x in between.items() for b in x if a < b]
    heapq.heapify(heap)
    while heap:
        loss, a, b = heapq.heappop(heap)
        if loss >= 0:
            break
        if b not in between.get(a, ()) or -loss != gain(a, b):
            continue
        weight[a] += weight.pop(b)
        members[a] += members.pop(b)
        for c, e in between.pop(b).items():
            del between[c][b]
            if c != a:
                between[a][c] = between[c][a] = between[a].get(c, 0) + e
        for c in between[a]:
            heapq.heappush(heap, (-gain(a, c), min(a, c), max(a, c)))
    return _frame({n: of for of, some in members.items() for n in some})


def _propagate_in_rounds(edges: DataFrame, passes: int) -> DataFrame:
    """A pass moves one of _SHARES parts of the nodes, by a hash, after another: nodes that move at once spread small names over bridges, more parts come closer to the sequential walk."""
    ways = edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other")))
    ways = settled(ways.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(_SHARES))))
    label = settled(ways.select("node", "part", F.col("node").alias("label")).distinct())
    still = 0
    for k in range(_SHARES * passes):
        part = F.col("part") == k % _SHARES
        votes = ways.where(part).join(label.select(F.col("node").alias("other"), "label"), "other").groupBy("node", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("loss"), "label")).alias("best")).select("node", F.col("best.label").alias("new"))
        moved = settled(label.where(part).join(best, "node").select("node", "part", F.col("new").alias("label"), (F.col("new") != F.col("label")).alias("moves")))
        if not moved.where("moves").limit(1).count():
            still += 1
            if still == _SHARES:
                break
            continue
        still = 0
        label = settled(label.where(~part).unionByName(moved.drop("moves")))
    return _named(label)


def _merge_in_rounds(edges: DataFrame, m: int) -> DataFrame:
    """Each round merges all pairs of communities that gain at least half of what the best pair does and are each other's best, by gain and then name; the best pair is one of them, so rounds end when no merge gains."""
    number = lambda c: c.cast("decimal(38,0)")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("c"))
    weight = settled(ends.groupBy("c").agg(number(F.count("*")).alias("k")))
    between = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), number(F.lit(1)).alias("e"))
    label = weight.select(F.col("c").alias("node"), F.col("c").alias("label"))
    while True:
        of = lambda end: weight.select(F.col("c").alias(end), F.col("k").alias(f"k_{end}"))
        gains = between.join(of("a"), "a").join(of("b"), "b").withColumn("loss", number(F.col("k_a") * F.col("k_b")) - number(F.lit(2 * m) * F.col("e"))).where("loss < 0")
        gains = settled(gains)
        top = gains.agg(F.min("loss").alias("top"))  # one row
        best = gains.crossJoin(F.broadcast(top)).where("2 * loss <= top").select(F.explode(F.array("a", "b")).alias("c"), F.struct("loss", "a", "b").alias("pair")).groupBy("c").agg(F.min("pair").alias("pair"))
        merged = settled(best.groupBy("pair.a", "pair.b").agg(F.count("*").alias("n")).where("n = 2").select(F.col("a").alias("into"), F.col("b").alias("gone")))
        if not merged.limit(1).count():
            return _named(label)
        moved = lambda df, c: df.join(merged, F.col(c) == F.col("gone"), "left").withColumn(c, F.coalesce("into", c)).drop("into", "gone")
        between = settled(moved(moved(between, "a"), "b").where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(number(F.sum("e")).alias("e")))
        weight = settled(moved(weight, "c").groupBy("c").agg(number(F.sum("k")).alias("k")))
        label = settled(moved(label, "label"))


def _named(label: DataFrame) -> DataFrame:
    """(node, community) of (node, label): communities go by their smallest node."""
    return label.join(label.groupBy("label").agg(F.min("node").alias("community")), "label").select("node", "community")


def _clustered(edges: DataFrame, nodes: DataFrame | None, in_task: Callable, in_rounds: Callable, most: int) -> DataFrame:
    labelled = edges.join(components(edges).select(F.col("node").alias("src"), "component"), "src").checkpoint()
    large = labelled.groupBy("component").agg(F.count("*").alias("__n")).where(F.col("__n") > most).select("component").checkpoint()
    found = labelled.join(large, "component", "left_anti").groupBy("component").applyInPandas(lambda rows: in_task(rows), "node string, community string")
    if large.limit(1).count():
        found = found.unionByName(in_rounds(labelled.join(large, "component", "left_semi").select("src", "dst").checkpoint()))
    if nodes is None:
        return found
    found = found.checkpoint()
    alone = nodes.select(F.col("node").cast("string").alias("node")).where("node IS NOT NULL").distinct().join(found, "node", "left_anti")
    return found.unionByName(alone.select("node", F.col("node").alias("community")))


def label_propagation(edges: DataFrame, passes: int = MOST_PASSES, nodes: DataFrame | None = None, most: int = MOST_EDGES) -> DataFrame:
    """(node, community): nodes in order take the most frequent label of their neighbours, the smallest on a tie, pass by pass; a community is named by its smallest node. Nodes (node) without edges are communities of their own."""
    return _clustered(simple_edges(edges), nodes, partial(_propagate, passes=passes), partial(_propagate_in_rounds, passes=passes), most)


def greedy_modularity(edges: DataFrame, nodes: DataFrame | None = None, most: int = MOST_EDGES) -> DataFrame:
    """(node, community): the pair of communities whose merge raises modularity most is merged, the first by name on a tie, until none does. Nodes (node) without edges are communities of their own."""
    edges = simple_edges(edges)
    m = edges.count()
    return _clustered(edges, nodes, partial(_merge, m=m), partial(_merge_in_rounds, m=m), most)


def skeletons(membership: DataFrame, edges: DataFrame, names: DataFrame, entities: int = TOP_ENTITIES, claims: int = TOP_CLAIMS) -> DataFrame:
    """(community, size, top_entities, rel_types, claims, fingerprint) of communities (node, community).

    edges: id, src, dst, rel_type, claim; names: node, name. Entities go by degree inside the community, claims by edge id.
    """
    of = lambda end: membership.select(F.col("node").alias(end), F.col("community").alias(f"{end}_of"))
    inside = edges.join(of("src"), "src").join(of("dst"), "dst").where("src_of = dst_of").withColumnRenamed("src_of", "community")
    degree = inside.select("community", F.explode(F.array("src", "dst")).alias("node")).groupBy("community", "node").agg(F.count("*").alias("degree"))
    ranked = membership.join(degree, ["community", "node"], "left").join(names, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), "node"))
    listed = lambda rows, n, item, name: rows.where(F.col("n") <= n).groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.col(item).alias("x")))), lambda s: s["x"]).alias(name))
    top = listed(ranked.withColumn("n", place), entities, "name", "top_entities")
    rel = inside.groupBy("community", "rel_type").agg(F.count("*").alias("c")).withColumn("n", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("c"), "rel_type")))
    rel = listed(rel.withColumn("shown", F.concat_ws(":", "rel_type", F.col("c").cast("string"))), 2**31 - 1, "shown", "rel_types")
    said = inside.where("claim is not null").withColumn("n", F.row_number().over(Window.partitionBy("community").orderBy("id")))
    out = membership.groupBy("community").agg(F.count("*").alias("size")).join(top, "community", "left").join(rel, "community", "left").join(listed(said, claims, "claim", "claims"), "community", "left")
    none = F.array().cast("array<string>")
    out = out.select("community", "size", *(F.coalesce(c, none).alias(c) for c in ("top_entities", "rel_types", "claims")))
    return out.withColumn("fingerprint", F.sha2(F.to_json(F.struct("community", "size", "top_entities", "rel_types", "claims")), 256))


def rank_communities(terms: DataFrame, skeleton_terms: DataFrame, top_n: int = TOP_COMMUNITIES) -> DataFrame:
    """(query_id, community, score, place): communities by the distinct terms that they share with a query, larger ones first, then by name.

    terms: query_id, term. skeleton_terms: community, size, term. Communities that share none are left out.
    """
    score = terms.distinct().join(skeleton_terms.distinct(), "term").groupBy("query_id", "community", "size").agg(F.count("*").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("size"), "community")
    return score.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top_n).select("query_id", "community", "score", "place")


def expand(edges: DataFrame, seeds: DataFrame, hops: int, beam: int = BEAM) -> DataFrame:
    """(seed, node, hop): from each node of a hop the first `beam` neighbours (by name) that its seed has not reached go on; seeds: node, or seed and node where a seed starts at several nodes."""
    edges = simple_edges(edges)
    ways = edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other")))
    found = seeds.select(F.col("seed" if "seed" in seeds.columns else "node").alias("seed"), "node").distinct().withColumn("hop", F.lit(0))
    frontier = found
    for k in range(1, hops + 1):
        new = frontier.select("seed", "node").join(ways, "node").join(found.select("seed", F.col("node").alias("other")), ["seed", "other"], "left_anti")
        few = new.withColumn("n", F.row_number().over(Window.partitionBy("seed", "node").orderBy("other"))).where(F.col("n") <= beam)
        frontier = few.select("seed", F.col("other").alias("node")).distinct().withColumn("hop", F.lit(k)).checkpoint()
        found = found.unionByName(frontier)
    return found


def global_route(queries: DataFrame, edges: DataFrame, names: DataFrame, membership: DataFrame | None = None, top_n: int = TOP_COMMUNITIES, depth: int = 3, beam: int = BEAM) -> tuple[DataFrame, DataFrame]:
    """Communities and entities that answer a question on the whole graph: cluster (unless membership is given), summarise, rank, expand.

    queries: query_id, query; edges and names as skeletons takes them. Returns hits (query_id, community, score, place), and entities
    (query_id, node, hop, place): the members of hits with their hit's place, and what depth hops reach from them.
    """
    membership = greedy_modularity(edges, names.select("node")) if membership is None else membership
    shown = skeletons(membership, edges, names)
    said = F.concat_ws(" ", "top_entities", F.transform("rel_types", lambda r: F.regexp_replace(r, ":[0-9]+$", "")), "claims")
    terms = shown.select("community", "size", F.explode(search_terms(said)).alias("term"))
    hits = rank_communities(queries.select("query_id", F.explode(search_terms(F.col("query"))).alias("term")), terms, top_n)
    members = hits.select("query_id", "community", "place").join(membership, "community").checkpoint()
    reached = expand(edges, members.select(F.col("query_id").alias("seed"), "node"), depth, beam).withColumnRenamed("seed", "query_id")
    places = members.groupBy("query_id", "node").agg(F.min("place").alias("place"))
    return hits, reached.join(places, ["query_id", "node"], "left").select("query_id", "node", "hop", "place")
