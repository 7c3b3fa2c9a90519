"""Fuzzy terms, sloppy phrases, word lattices and term weights against brute force and golden values."""

import math
import random
from itertools import permutations

import pytest

from tideglass.operators import lexical


def edits(a, b):
    """Insertions, deletions, substitutions and swaps of neighbours, each part of a word in any number of them up to two."""
    near = lambda w: {w[:k] + w[k + 1 :] for k in range(len(w))} | {w[:k] + c + w[k:] for k in range(len(w) + 1) for c in "abc*"} | {w[:k] + c + w[k + 1 :] for k in range(len(w)) for c in "abc*"} | {w[:k] + w[k + 1] + w[k] + w[k + 2 :] for k in range(len(w) - 1)}
    if a == b:
        return 0
    once = near(a)
    return 1 if b in once else 2 if once & near(b) else None


def test_fuzzy_terms(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(0, 14)))
    have, want = {word() for _ in range(250)} | {"c" * 300, ""}, {word() for _ in range(60)} | {"c" * 299 + "a"}
    df = lambda words: spark.createDataFrame([(w,) for w in words], "term string")
    found = {(r["asked"], r["term"]): r["distance"] for r in lexical.fuzzy_terms(df([*have, "a", None]), df([*want, *want, None])).collect()}
    expect = {}
    for a in want - {""}:
        k = 0 if len(a) <= 2 else 1 if len(a) <= 5 else 2
        for b in have - {""} | {"a"}:
            if abs(len(a) - len(b)) <= k and len(a) < 100 and (d := edits(a, b)) is not None and d <= k:
                expect[a, b] = d
    expect["c" * 299 + "a", "c" * 300] = 1
    assert found == expect


def slop_by_exhaustion(tokens, phrase, slop):
    places = [[k for k, t in enumerate(tokens) if t == term] for term in phrase]

    def all_ways(q, used):
        if q == len(phrase):
            yield []
        else:
            for p in places[q]:
                if p not in used:
                    for rest in all_ways(q + 1, used | {p}):
                        yield [p - q, *rest]

    widths = [max(w) - min(w) for w in all_ways(0, frozenset())]
    return min((w for w in widths if w <= slop), default=None)


def test_phrase_distance():
    rng = random.Random(2)
    for _ in range(1500):
        phrase = [rng.choice("abcd") for _ in range(rng.randrange(1, 5))]
        tokens = [rng.choice("abcdx") for _ in range(rng.randrange(0, 10))]
        assert lexical.phrase_distance(tokens, phrase, 3) == slop_by_exhaustion(tokens, phrase, 3), (tokens, phrase)


def test_phrases_and_matches(spark):
    texts = {1: "quick brown fox", 2: "brown quick fox", 3: "quick very brown red fox", 4: "quick qiuck browm", 5: "", 6: "fox", 7: "quick a b c d e brown fox"}
    docs = spark.createDataFrame([(i, t.split()) for i, t in texts.items()], "id int, tokens array<string>")
    asked = spark.createDataFrame([(1, ["quick", "brown", "fox"]), (2, []), (3, ["fox", "fox"]), (4, ["browm"])], "query_id int, tokens array<string>")
    assert sorted(map(tuple, lexical.phrases(docs, asked).collect())) == [(1, 1, 0), (1, 2, 2), (1, 3, 2), (4, 4, 0)]
    found = {(r["query_id"], r["id"]): r["matched"] for r in lexical.fuzzy_matches(docs, asked).collect()}
    assert {k: v for k, v in found.items() if k[0] == 1} == {(1, 1): 3, (1, 2): 3, (1, 3): 3, (1, 4): 2, (1, 6): 1, (1, 7): 3}
    assert {k for k in found if k[0] == 4} == {(4, i) for i in (1, 2, 3, 4, 7)}
    assert lexical.phrases(docs.limit(0), asked).count() == 0 == lexical.fuzzy_matches(docs, asked.limit(0)).count()
    weights = spark.createDataFrame([(1, "fox", 0.5)], "query_id int, term string, weight double")
    plain = {(r["query_id"], r["id"]): r["score"] for r in lexical.weighted_search({"content": docs}, asked, weights.limit(0)).collect()}
    both = {(r["query_id"], r["id"]): r["score"] for r in lexical.weighted_search({"title": docs, "content": docs}, asked, weights, {"title": 3.0}).collect()}
    assert set(plain) == set(both)
    for (q, i), score in plain.items():
        factor = 0.5 * 2.0 * (3 + 1) if q == 1 and "fox" in texts[i].split() else 1.0
        assert both[q, i] == pytest.approx(4 * score * factor)


def test_lattice(spark):
    """The best path of every run against all cuts; unknown characters stay single."""
    words = {"人工": 5, "智能": 6, "人工智能": 4, "能": 1, "工": 2, "智": 2, "能力": 3}
    total = sum(words.values())
    runs = ["".join(p) for p in permutations("人工智能", 4)] + ["人工智能能力", "新人工", "力" * 40]

    def score(cut):
        return sum(math.log(words[w] / total) if w in words else math.log(0.5 / total) if len(w) == 1 else -1e9 for w in cut)

    def cuts(run):
        return [[]] if not run else [[run[:k], *rest] for k in range(1, min(6, len(run)) + 1) for rest in cuts(run[k:])]

    table = spark.createDataFrame(list(words.items()), "word string, count int")
    found = {r["run"]: list(r["words"]) for r in lexical.cut_runs(spark.createDataFrame([(r,) for r in runs + runs[:2] + [""]], "run string"), table).collect()}
    assert set(found) == set(runs)
    for run in runs[:-1]:
        assert "".join(found[run]) == run and score(found[run]) == pytest.approx(max(map(score, cuts(run))))
    assert found["力" * 40] == ["力"] * 40
    texts = spark.createDataFrame([(1, "人工智能 Rocks v2.0!"), (2, ""), (3, None)], "id int, text string")
    assert {r["id"]: list(r["tokens"]) for r in lexical.lattice_tokens(texts, table).collect()} == {1: ["人工智能", " ", "rocks", " ", "v2.0", "!"]}
    assert len(lexical.cut_runs(spark.createDataFrame([("人工",)], "run string"), table.limit(0)).collect()[0]["words"]) == 2


def test_term_weights(spark):
    """The formula step by step: kinds, places, shares, lengths, thresholds."""
    tokens = ["data", " ", "the", " ", "engine", " ", "data", " ", "42", "!"]
    texts = spark.createDataFrame([(1, "".join(tokens)), (2, ""), (3, "a")], "id int, text string")
    cut = spark.createDataFrame([(1, tokens), (2, []), (3, ["a"])], "id int, tokens array<string>")
    n = len("".join(tokens))
    raw = {}
    for k, t in enumerate(tokens):
        if t.strip() and t != "the":
            raw[t] = raw.get(t, 0) + (1.2 if t == "42" else 0.8 if t == "!" else 1.0) * (1.2 if k < 3 or k > n / 3 else 1.0)
    total = sum(raw.values())
    for df in (None, {"data": 9, "engine": 1}):
        w = {t: x / total * (math.log(11 / (df.get(t, 0) + 1)) + 1 if df else 1) * (1 + 0.1 * (len(t) - 1)) for t, x in raw.items()}
        top = max(w.values())
        kept = {t: x / top for t, x in w.items() if x / top > 0.2 and len(t) > 1}
        want = {t: x / max(kept.values()) for t, x in kept.items()}
        freqs = spark.createDataFrame(list(df.items()), "term string, df int") if df else None
        rows = lexical.term_weights(texts, cut, ("the",), freqs, 10).collect()
        assert {r["term"]: r["weight"] for r in rows} == pytest.approx(want) and {r["id"] for r in rows} == {1}
