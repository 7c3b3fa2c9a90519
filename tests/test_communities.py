"""Clusterings against brute force over the whole graph at once."""

import random
from collections import Counter
from itertools import combinations

import pytest

from tideglass.operators import communities as C


def graph(seed):
    rng = random.Random(seed)
    edges = {tuple(sorted(rng.sample([f"{g}{k}" for k in range(7)], 2))) for g in "abcd" for _ in range(11)}
    edges |= {("a0", "b0"), ("b3", "a2"), ("c1", "d5")}
    return sorted(tuple(sorted(e)) for e in edges)


def q(edges, label):
    m, degree, inside = len(edges), Counter(), Counter()
    for a, b in edges:
        degree[label[a]] += 1
        degree[label[b]] += 1
        inside[label[a]] += label[a] == label[b]
    return sum(inside[c] / m - (degree[c] / (2 * m)) ** 2 for c in degree)


def brute_modularity(edges):
    label = {n: n for e in edges for n in e}
    while True:
        now, best = q(edges, label), None
        for a, b in combinations(sorted(set(label.values())), 2):
            if any({label[u], label[v]} == {a, b} for u, v in edges):
                gain = q(edges, {n: a if c == b else c for n, c in label.items()}) - now
                if gain > 1e-12 and (best is None or gain > best[0] + 1e-12):
                    best = (gain, a, b)
        if best is None:
            return label
        label = {n: best[1] if c == best[2] else c for n, c in label.items()}


def brute_labels(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    label = {n: n for n in near}
    for _ in range(16):
        for n in sorted(near):
            label[n] = sorted(Counter(label[x] for x in near[n]).items(), key=lambda kv: (-kv[1], kv[0]))[0][0]
    return label


def groups(label):
    out = {}
    for n, c in label.items():
        out.setdefault(c, set()).add(n)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("seed", [1, 2])
def test_clusterings(spark, seed):
    edges = graph(seed)
    rows = spark.createDataFrame([*edges, *[(b, a) for a, b in edges[:5]], ("a0", "a0")], "src string, dst string")
    for found, brute in ((C.greedy_modularity(rows), brute_modularity), (C.label_propagation(rows), brute_labels)):
        got = {r["node"]: r["community"] for r in found.collect()}
        assert groups(got) == groups(brute(edges)) and all(c == min(n for n, x in got.items() if x == c) for c in got.values())


def test_expand(spark):
    rows = spark.createDataFrame([("s", x) for x in "abcde"] + [("a", "f"), ("a", "b"), ("f", "g")], "src string, dst string")
    got = {(r["node"], r["hop"]) for r in C.expand(rows, spark.createDataFrame([("s",)], "node string"), 2, 2).collect()}
    assert got == {("s", 0), ("a", 1), ("b", 1), ("f", 2)}


def test_isolated_nodes(spark):
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    nodes = spark.createDataFrame([("a",), ("z",), ("z",), (None,)], "node string")
    for cluster in (C.greedy_modularity, C.label_propagation):
        assert sorted(map(tuple, cluster(edges, nodes=nodes).collect())) == [("a", "a"), ("b", "a"), ("z", "z")]
        assert cluster(edges.limit(0), nodes=nodes.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_clusterings_in_rounds(spark, seed):
    """Components beyond the bound: every node once, no community across components, a modularity near the sequential one."""
    edges = graph(seed)
    rows = spark.createDataFrame(edges, "src string, dst string")
    for found, least in ((C.greedy_modularity(rows, most=0), 0.9 * q(edges, brute_modularity(edges))), (C.label_propagation(rows, most=0), 0.75 * q(edges, brute_labels(edges)))):
        got = {r["node"]: r["community"] for r in found.collect()}
        assert set(got) == {n for e in edges for n in e} and q(edges, got) >= least
        assert all(c == min(n for n, x in got.items() if x == c) for c in got.values())


def test_global_route(spark):
    """Two stars and a bridge: the one whose words the question shares, its members, and what a hop reaches."""
    pairs = [("a", "a1"), ("a", "a2"), ("a1", "a2"), ("b", "b1"), ("b", "b2"), ("b1", "b2"), ("a", "b")]
    edges = spark.createDataFrame([(k, s, d, "treats", f"{s} helps {d}" if k else None) for k, (s, d) in enumerate(pairs)], "id int, src string, dst string, rel_type string, claim string")
    names = spark.createDataFrame([("a", "Heart failure"), ("a1", "Beta blocker"), ("a2", "Diuretic"), ("b", "Asthma"), ("b1", "Inhaler"), ("b2", "Steroid"), ("z", "Alone")], "node string, name string")
    asked = spark.createDataFrame([(1, "Which diuretic for heart failure?"), (2, "inhaler"), (3, "nothing of it")], "query_id int, query string")
    hits, entities = C.global_route(asked, edges, names, top_n=1, depth=1)
    assert sorted((r["query_id"], r["community"], r["score"]) for r in hits.collect()) == [(1, "a", 3), (2, "b", 1)]
    got = {(r["query_id"], r["node"]): (r["hop"], r["place"]) for r in entities.collect()}
    assert got == {(1, "a"): (0, 1), (1, "a1"): (0, 1), (1, "a2"): (0, 1), (1, "b"): (1, None), (2, "b"): (0, 1), (2, "b1"): (0, 1), (2, "b2"): (0, 1), (2, "a"): (1, None)}
