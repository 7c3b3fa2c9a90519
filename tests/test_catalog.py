"""Greedy compaction against a walk, evidence of nothing, and asked ids."""

import random

import pytest

from tideglass.operators import catalog, evaluation, memory


def walk(items, target, keep_recent):
    """One context: which positions are replaced; items (position, is_action, compactable, tokens, compact_tokens)."""
    actions = [i for i in items if i[1]]
    recent = actions[len(actions) - keep_recent :] if keep_recent else []
    stages = [[i for i in actions if i not in recent], [i for i in items if not i[1] and i[2]], recent]
    total, gone = sum(i[3] for i in items), set()
    for stage in stages:
        for i in sorted(stage, key=lambda i: (-max(0, i[3] - i[4]), i[0])):
            if total <= target:
                return gone
            gone.add(i[0])
            total += i[4] - i[3]
    return gone


@pytest.mark.parametrize("keep_recent", [0, 2])
def test_compaction_is_the_walk(spark, keep_recent):
    rng = random.Random(keep_recent)
    contexts = {c: [(p, rng.random() < 0.5, rng.random() < 0.7, rng.randrange(60), rng.randrange(40)) for p in range(rng.randrange(1, 14))] for c in range(150)}
    rows = spark.createDataFrame([(c, *i) for c, items in contexts.items() for i in items], "ctx int, position int, is_action boolean, compactable boolean, tokens int, compact_tokens int")
    got = {c: set() for c in contexts}
    for r in memory.compacted(rows, ["ctx"], "position", 150, keep_recent).where("compacted").collect():
        got[r["ctx"]].add(r["position"])
    assert got == {c: walk(items, 150, keep_recent) for c, items in contexts.items()} and any(got.values())


def test_evidence_of_nothing(spark):
    items = spark.createDataFrame([], "status string, available_calls int, hit_calls int, cached_tokens int, input_tokens int")
    assert evaluation.cache_evidence(items).collect() == [("unsupported", 0, 0, 0, None, 0, 0, None)]
    budgets = spark.createDataFrame([], "over_soft boolean, over_hard boolean, compressed boolean, peak_tokens int")
    assert evaluation.budget_evidence(budgets).collect() == [(0, 0, 0, 0, None, 0, 0)]
    off = spark.createDataFrame([("unavailable", 5, 5, 5, 5), (None, 1, 1, 1, 1)], items.schema)
    assert evaluation.cache_evidence(off).collect() == [("unavailable", 2, 0, 0, None, 0, 0, None)]


def test_item_subset(spark):
    items = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "id int, v string")
    asked = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    assert sorted(r["v"] for r in catalog.item_subset(items, asked("2", "1"), "id").collect()) == ["a", "b", "c"]
    assert catalog.subset_faults(asked("1", "1", "9"), items, "id").orderBy("id").collect() == [("1", "duplicate"), ("9", "unresolved")]
    with pytest.raises(ValueError, match=r"1 \(duplicate\), 9 \(unresolved\)"):
        catalog.item_subset(items, asked("1", "1", "9"), "id")


def test_enriched_keys(spark):
    hits = spark.createDataFrame([("1",), (" 2 ",), ("x",), ("99999999999999999999",), (None,)], "id string")
    rows = spark.createDataFrame([(1, "one"), (2, "two")], "key int, name string")
    assert sorted((r["id"] or "", r["name"] or "") for r in catalog.enriched(hits, rows, "id", "key", ["name"]).collect()) == [("", ""), (" 2 ", "two"), ("1", "one"), ("99999999999999999999", ""), ("x", "")]
