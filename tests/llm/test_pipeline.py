"""The pipeline, stage by stage, against brute force on each stage's own input."""

import random
from collections import Counter

import corpus_pipeline
from tests.llm.test_operators import SPACE, brute_counts, brute_hits, check_tokens, lower, windows_of

from tideglass.llm import quality_rules
from tideglass.llm._common import staged, table


def shingles(text):
    w = SPACE.findall(lower(text))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def test_stages(spark, sf_dir):
    docs, kept = table(spark, sf_dir, "documents"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, sf_dir))
        kept.append(docs)
        assert name == "token files" or docs.columns == columns
    texts = [{r["doc_id"]: r["text"] for r in d.collect()} for d in (table(spark, sf_dir, "documents"), *kept[:3])]

    judged = {r["doc_id"]: r["kept"] for r in quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).collect()}
    assert set(texts[1]) == {i for i, k in judged.items() if k}
    for t in texts[1].values():
        n = brute_counts(t)
        assert n[0] >= 50 and 100 * n[4] <= 50 * n[0]

    sets = {i: shingles(t) for i, t in texts[1].items()}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if like(a, b) >= 0.8:
                assert not (a in texts[2] and b in texts[2])
    for gone in set(ids) - set(texts[2]):
        assert max(like(gone, b) for b in ids if b != gone) >= 0.79

    windows = windows_of((r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect())
    assert set(texts[3]) == {i for i, t in texts[2].items() if not brute_hits(t, windows)[1]}

    mixed = Counter((r["doc_id"], r["text"]) for r in kept[3].collect())
    assert set(mixed.values()) <= {1, 2} and {i for i, _ in mixed} <= set(texts[3])
    sizes = {i: len(SPACE.findall(t)) for i, t in texts[3].items()}
    assert abs(sum(sizes[i] * n for (i, _), n in mixed.items()) - 1.5 * sum(sizes.values())) <= 20 * max(sizes.values())

    check_tokens(kept[4].orderBy("start").collect(), sorted((i, t) for (i, t), n in mixed.items() for _ in range(n)))


def test_stages_on_edge_rows(spark, sf_dir):
    """Nulls, repeated rows, equal ids and an empty table through all stages in sequence."""
    rng = random.Random(2)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8))) for _ in range(120)) + "."
    one, other = text(), text()
    rows = [(1, None, None, None), (2, "", "s", 0), (None, one, None, 5), (3, one, "s", 5), (3, other, None, 5), (3, other, None, 5), (4, "word " * 50_000, "t", 9), (5, "İ ﬁ 中文 <|endoftext|>", "t", 9)]
    edge = spark.createDataFrame([(i, t, "en", s, n) for i, t, s, n in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for docs in (edge, edge.where("false")):
        columns, sizes = docs.columns, []
        for name, stage in corpus_pipeline.STAGES:
            docs = staged(stage(spark, docs, sf_dir))
            sizes.append(docs.count())
            assert name == "token files" or docs.columns == columns
            if name == "near-duplicates" and sizes[0]:
                assert sorted(r["text"] for r in docs.collect()) == sorted([one, other])
        assert sizes[3] == sizes[4]
