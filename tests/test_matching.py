"""Assignment, calibration, substring joins and alignment against brute force."""

import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideglass.operators import alignment, filters, matching


def largest_total(edges, capacity):
    """By exhaustion: every item goes to one of its owners or to none."""
    by = {}
    for o, i, s in edges:
        by.setdefault(i, {})[o] = max(s, by.get(i, {}).get(o, 0))
    best = 0.0
    for choice in product(*([None, *row] for row in by.values())):
        if all(choice.count(o) <= capacity for o in {*choice} - {None}):
            best = max(best, sum(row[o] for row, o in zip(by.values(), choice) if o is not None))
    return best


def random_edges(rng, parts=4):
    """Several components with ties, repeated pairs and scores that don't count."""
    out = []
    for c in range(parts):
        owners, items = rng.randrange(1, 4), rng.randrange(1, 6)
        for o, i in product(range(owners), range(items)):
            if rng.random() < 0.8:
                out.append((10 * c + o, 10 * c + i, rng.choice([0.0, -1.0, 0.25, 0.5, 0.5, round(rng.random(), 2)])))
    return out + out[:3]


def check_assignment(found, edges, capacity, room):
    total, best = sum(r["score"] for r in found), largest_total([e for e in edges if e[2] > 0], capacity)
    assert best - room - 1e-9 <= total <= best + 1e-9
    assert len({r["item"] for r in found}) == len(found)
    owners = [r["owner"] for r in found]
    assert all(owners.count(o) <= capacity for o in owners)


@pytest.mark.parametrize("capacity", [1, 2])
def test_assignment(spark, capacity):
    rng = random.Random(capacity)
    edges = random_edges(rng)
    df = spark.createDataFrame(edges, "owner bigint, item bigint, score double")
    for k in range(4):  # each component apart: exhaustion is exponential
        part = [e for e in edges if e[0] // 10 == k]
        check_assignment([r for r in matching.assign(df, capacity).collect() if r["owner"] // 10 == k], part, capacity, 0)
    small = matching.assign(df.limit(0), capacity)
    assert small.collect() == []


def test_kernel():
    rng = random.Random(8)
    for _ in range(300):
        capacity = rng.randrange(1, 4)
        edges = [e for e in random_edges(rng, 1) if e[2] > 0]
        score = {}
        for o, i, s in edges:
            score[o, i] = max(s, score.get((o, i), 0))
        pairs = matching._best_assignment(sorted(edges), capacity)
        assert sum(score[p] for p in pairs) == pytest.approx(largest_total(edges, capacity))
        assert len({i for _, i in pairs}) == len(pairs) and all([o for o, _ in pairs].count(o) <= capacity for o, _ in pairs)


@pytest.mark.parametrize("capacity", [1, 2])
def test_auction(spark, capacity):
    """The distributed rounds: within epsilon a slot, more owners than items and the other way round."""
    rng = random.Random(20 + capacity)
    few = [(o, i, round(rng.random(), 3)) for o in range(5) for i in range(3)]
    many = [(100 + o, 100 + i, round(rng.random(), 3)) for o in range(3) for i in range(6) if rng.random() < 0.8]
    found = matching.assign(spark.createDataFrame(few + many, "owner bigint, item bigint, score double"), capacity, epsilon=0.01, most=0).collect()
    check_assignment([r for r in found if r["owner"] < 100], few, capacity, 0.01 * 5 * capacity)
    check_assignment([r for r in found if r["owner"] >= 100], many, capacity, 0.01 * 3 * capacity)


def walk(machine, gold):
    """The sequential rule: each item in turn takes the first remaining gold row that it matches."""
    left, out = [g for g in gold if (g[4] or "").lower() in ("verified", "corrected")], []
    for item, kind, anchor, points in machine:
        if kind == "UNCHANGED":
            continue
        text = f"{anchor} {points}"
        row = next((g for g in left if g[1] == kind and g[2].strip() == anchor.strip()), None) or next((g for g in left if g[1] == kind and (g[3] or g[2]) and (g[3] or g[2]) in text), None)
        if row and row[2]:
            out.append((item, row[2]))
            left = [g for g in left if g[2] != row[2]]
    return out


def test_calibration_is_the_sequential_walk(spark):
    for seed in range(2):
        rng = random.Random(seed)
        word = lambda: rng.choice(["a", "bb", "ccc", "dddd", "eeeee", ""])
        kind = lambda: rng.choice(["ADD", "MOD", "UNCHANGED"])
        machine = [(k, kind(), word() + word(), f"{word()} {word()}") for k in range(40)]
        gold = [(k, kind(), word() + word(), word(), rng.choice(["verified", "Corrected", "negative", None])) for k in range(25)]
        m = spark.createDataFrame(machine, "item int, change_type string, anchor string, points string")
        g = spark.createDataFrame(gold, "place int, change_type string, anchor string, field string, status string")
        want = walk(machine, gold)
        for most in (100_000, 0) if seed else (100_000,):  # walked in tasks, and in rounds
            assert sorted(map(tuple, matching.calibration_pairs(m, g, most).collect())) == want
        (r,) = matching.calibrate(m, g).collect()
        assert r["matched"] == len(want) and r["machine_total"] == sum(x[1] != "UNCHANGED" for x in machine)
    (r,) = matching.calibrate(m, g.limit(0)).collect()
    assert (r["matched"], r["precision"], r["recall"]) == (0, None, None)


def test_contains_pairs(spark):
    rng = random.Random(4)
    texts = [(k, "".join(rng.choice("abc") for _ in range(rng.randrange(0, 30)))) for k in range(60)] + [(60, None), (61, "é中文😀x")]
    needles = [(k, "".join(rng.choice("abc") for _ in range(rng.randrange(0, 7)))) for k in range(40)] + [(40, None), (41, "文😀"), (42, "zzz"), (43, "a"), (44, "%_")]
    df, asked = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(needles, "needle_id int, needle string")
    want = {(i, n) for i, t in texts for n, x in needles if x and t and x in t}
    got = matching.contains_pairs(df, asked)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert matching.contains_pairs(df, asked.limit(0)).count() == 0
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_entity_lookup_plan(spark):
    entities = spark.createDataFrame([(1, "Blue Bolt", ["bb", "Bolt X"]), (2, "red", None), (3, "Bolts", ["q"])], "id int, name string, aliases array<string>")
    asked = spark.createDataFrame([(1, " bolt "), (2, "Bolt X"), (3, ""), (4, "nothing")], "query_id int, query string")
    ranked = spark.createDataFrame([(1, 2, 1)], "query_id int, id int, rank int")
    found = filters.entity_lookup(entities, asked, ranked)
    assert sorted(map(tuple, found.collect())) == [(1, 1, 2, 2), (1, 2, 1, 1), (1, 3, 2, 3), (2, 1, 3, 1)]
    assert "NestedLoop" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("block", [7, 2048])
def test_best_above(spark, block):
    """Clusters, copies, ties, other lengths, zero vectors and nulls; small blocks deal a cell over tasks."""
    rng = np.random.default_rng(block)
    centres = rng.standard_normal((6, 12))
    vectors = [(k, (centres[k % 6] + 0.4 * rng.standard_normal(12)).round(4).tolist()) for k in range(300)]
    vectors += [(1000 + k, vectors[40][1]) for k in range(60)] + [(2000, [0.0] * 12), (2001, None), (2002, [1.0, 2.0]), (2003, [2.0, 4.0]), (2004, [1.0, None])]
    df = spark.createDataFrame(vectors, "id bigint, vector array<double>")
    asked = df.where("id % 20 = 0 OR id > 1990").withColumnRenamed("id", "query_id")
    known = {i: np.array(v) for i, v in vectors if v and None not in v and any(v)}
    cosine = lambda a, b: round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9)
    for threshold in (0.6, 0.95):
        got = {r["query_id"]: (r["id"], r["score"]) for r in alignment.best_above(df, asked, threshold, pivots=5, block=block).collect()}
        want = {}
        for q in (r["query_id"] for r in asked.collect()):
            near = [(-cosine(known[q], v), i) for i, v in known.items() if q in known and i != q and len(v) == len(known[q])]
            if near and -min(near)[0] >= threshold:
                want[q] = min(near)
        assert set(got) == set(want)
        for q, (loss, i) in want.items():
            assert got[q][1] == pytest.approx(-loss, abs=1e-8) and (got[q][0] == i or got[q][1] == pytest.approx(cosine(known[q], known[got[q][0]]), abs=1e-8))
    rows = alignment.align(df, asked).collect()
    assert len(rows) == asked.count() and {r["decision"] for r in rows} == {"merge", "pending"} | ({"adjudicate"} & {r["decision"] for r in rows})
    assert alignment.align(df.limit(0), asked).where("decision <> 'pending'").count() == 0 == alignment.align(df, asked.limit(0)).count()


def test_alignment_tiers(spark):
    entities = spark.createDataFrame([(1, [1.0, 0.0])], "id bigint, vector array<double>")
    asked = entities.select(F.explode(F.array(*(F.struct(F.lit(q).alias("query_id"), F.array(F.lit(x), F.lit(y)).alias("vector")) for q, x, y in ((11, 0.9, 0.435), (12, 0.8, 0.6), (13, 0.7, 0.714), (14, 0.6, 0.8), (15, 0.5, 0.866))))).alias("q")).select("q.*")
    assert [r["decision"] for r in alignment.align(entities, asked).orderBy("query_id").collect()] == ["merge", "adjudicate", "adjudicate", "adjudicate", "pending"]
