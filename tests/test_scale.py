"""Work that follows the distinct texts, sets and groups of a table, not its pairs of rows."""

import re

from pyspark.sql import functions as F

from tideglass.operators import filters as X


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_all_terms_counts_no_pairs(spark):
    postings = spark.createDataFrame([(d, t) for d in range(40) for t in ("a", "b", f"x{d % 3}")] + [(99, None), (98, "a")], "doc_id int, term string")
    terms = spark.createDataFrame([(q, t) for q in range(10) for t in ("a", "x1", "a")] + [(20, "a"), (20, "missing"), (21, None), (21, "a"), (22, "b")], "query_id int, term string")
    found = X.all_terms(postings, terms)
    assert not re.search(r"Aggregate \[query_id#\d+L?, doc_id", optimized(found))
    rows = sorted(map(tuple, found.collect()))
    assert rows == sorted([(q, d) for q in range(10) for d in range(40) if d % 3 == 1] + [(22, d) for d in range(40)])


def test_entity_lookup_seeks_each_text_once(spark, monkeypatch):
    from tideglass.operators import matching as M

    sought, plain = [], M.contains_pairs
    monkeypatch.setattr(M, "contains_pairs", lambda texts, needles: sought.append(needles.count()) or plain(texts, needles))
    entities = spark.createDataFrame([(k, f"Red Bolt {k}", ["red"]) for k in range(30)], "id int, name string, aliases array<string>")
    queries = spark.createDataFrame([(q, "bolt ") for q in range(20)] + [(50, "red"), (51, " ")], "query_id int, query string")
    ranked = spark.createDataFrame([(q, i, n) for q in range(20) for n, i in enumerate((2, 0, q))], "query_id int, id int, rank int")
    rows = X.entity_lookup(entities, queries, ranked, 5).collect()
    assert sought == [2, 2]
    of = {q: [r["id"] for r in sorted(rows, key=lambda r: r["place"]) if r["query_id"] == q] for q in (0, 7, 50)}
    assert of == {0: [2, 0, 1, 3, 4], 7: [2, 0, 7, 1, 3], 50: [0, 1, 2, 3, 4]} and len(rows) == 105


def test_weighted_cosine_compares_sets(spark):
    from tideglass.operators import knowledge as K

    right = spark.createDataFrame([(k, t) for k in range(30) for t in ("a", f"x{k % 2}", "a")] + [(77, None), (78, "alone")], "id int, token string")
    found = K.weighted_cosine(right.where("id < 4"), right, K.idf(right, "id"))
    assert not re.search(r"Aggregate \[left_id", optimized(found))
    rows = {(r["left_id"], r["right_id"]): r["similarity"] for r in found.collect()}
    assert len(rows) == 120 and abs(rows[0, 28] - 1) < 1e-9 and 0 < rows[0, 1] == rows[2, 29] < 1


def test_weighted_cosine_spreads_pairs(spark, monkeypatch):
    """A large class and many small ones: tasks grow with the lists of ids, and no pair of ids is shuffled or in two of them."""
    from tideglass.operators import knowledge as K

    monkeypatch.setattr(K, "LIST", 8, raising=False)
    monkeypatch.setattr(K, "TOGETHER", 4, raising=False)
    rows = spark.createDataFrame([(k, t) for k in range(140) for t in (["a"] if k < 100 else ["a", f"x{k}"])], "id int, token string")
    found = K.weighted_cosine(rows, rows, K.idf(rows, "id"))
    assert 10 <= found.rdd.getNumPartitions() <= 14
    pairs = {(r["left_id"], r["right_id"]): r["similarity"] for r in found.collect()}
    assert len(pairs) == found.count() == 140**2 and abs(pairs[3, 99] - 1) < 1e-9 and pairs[0, 120] == pairs[139, 5] > pairs[120, 121] > 0


def test_idf_cosine_compares_all(spark, sf_dir):
    """Every part is on either side: as many pairs as share a token, each of them both ways."""
    from tideglass.plans import knowledge

    sets = {r["p_partkey"]: {*r["p_name"].split(" "), r["p_brand"], r["p_type"]} for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect()}
    rows = {(r["left_id"], r["right_id"]) for r in knowledge.idf_cosine(spark, sf_dir).collect()}
    assert rows == {(a, b) for a in sets for b in sets if a != b and sets[a] & sets[b]} and {a for a, _ in rows} == set(sets)


def test_near_copies_by_tiles(spark, monkeypatch):
    from tideglass.operators import clustering as C

    monkeypatch.setattr(C, "TILE", 7)
    monkeypatch.setattr(C, "STRIP", 3)
    vectors = [(k, "b" if k % 3 else "c", [float(k % 5), 1.0, 0.5] if k != 11 else [1.0]) for k in range(40)] + [(90, "b", None), (91, "b", [None, 1.0, 0.5]), (92, None, [0.0, 1.0, 0.5])]
    found = C.duplicate_pairs(spark.createDataFrame(vectors, "id bigint, block string, vector array<double>"))
    want = {(a, b) for a in range(40) for b in range(a) if 11 not in (a, b) and a % 5 == b % 5 and (a % 3 > 0) == (b % 3 > 0)}
    rows = [(r["b"], r["a"]) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and "Join" not in optimized(found).split("FlatMapGroups")[0]


def test_layers_by_tiles(spark, monkeypatch, tmp_path, sf_dir):
    from tideglass.operators import layers as L
    from tideglass.plans import channels

    every = lambda: sorted(map(tuple, channels.layered_search(spark, sf_dir).collect()), key=str)
    found, searched = every(), []
    monkeypatch.setattr(L, "TILE", 9)
    monkeypatch.setattr(L, "STRIP", 2)
    assert every() == found
    rows = spark.createDataFrame([(1, 2)], "request_id int, memory_id int")
    monkeypatch.setattr(L, "settled", lambda df: searched.append(1) or df)
    L.append_hits(rows, f"{tmp_path}/log", 1)
    assert searched == [1] and "Join" not in optimized(L._scored(spark.createDataFrame([(1, "t", "u", None, [1.0], 1, 0.5)], "request_id int, tenant_id string, user_id string, asked_agent string, asked array<double>, k int, least double"), channels.memories(spark, sf_dir))).split("CoGroup")[0]


def test_sizes_of_large_events(spark, tmp_path):
    from tideglass.plans import text

    spark.createDataFrame([(6_000_000,), (10,), (3,)], "event_id bigint").write.parquet(f"{tmp_path}/events.parquet")
    assert {r["event_id"]: r["size"] for r in text.readable_size(spark, str(tmp_path)).collect()} == {6_000_000: "201165676116.9 GB", 10: "1000 B", 3: "27 B"}


def test_sliding_counts_whole_seconds(spark, tmp_path):
    from datetime import datetime

    from tideglass.plans import streams

    rows = [(datetime(2024, 1, 1, 5, 59, 59, 700_000), "a", 1.0), (datetime(2024, 1, 1, 5, 59, 59, 400_000), "b", 1.0)]
    spark.createDataFrame(rows, "ts timestamp_ntz, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    found = {(r["event_type"], r["start"].hour) for r in streams.sliding(spark, str(tmp_path)).collect()}
    assert found == {("a", 0), ("a", 6), ("b", 18), ("b", 0)}


def test_parts_without_suppliers(spark, tmp_path):
    """Keys with a gap: the names of the last ones come into a part that has none of the suppliers' rows."""
    from tideglass.plans import workbooks

    spark.createDataFrame([(k, f"s{k}", 0, 1.0) for k in range(9) if k != 4] + [(53, "s53", 0, 1.0), (106, "s106", 0, 1.0), (159, "s159", 0, 1.0)], "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    rows = workbooks.workbook_parts(spark, str(tmp_path)).where("row > 1").collect()
    assert len(rows) == 12 and all(r["line"].count("|") == 2 for r in rows)


def test_assignment_within_values_seeks_no_components(spark, monkeypatch):
    from tideglass.operators import matching as M

    edges = spark.createDataFrame([(k, f"{k}o{o}", f"{k}i{i}", float((o * 7 + i * 3 + k) % 5)) for k in range(8) for o in range(3) for i in range(3)], "k int, owner string, item string, score double")
    whole = M.assign(edges.drop("k")).groupBy().sum("score").first()[0]
    assert M.assign(edges, most=5, within="k").count() >= 16  # each value is larger than `most`
    monkeypatch.setattr(M, "components", None)
    assert M.assign(edges, within="k").groupBy().sum("score").first()[0] == whole


def test_cosine_compares_slices(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from tideglass.operators import retrieval as R

    monkeypatch.setattr(R, "SLICE", 4)
    queries = type("Q", (), {"value": (np.array([1]), np.array([[1.0, 0.0]]))})
    vectors = [[float(k), 1.0] for k in range(10)] + [None, [1.0], [None, 1.0], [float("nan"), 1.0]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(14)), pa.array(vectors, pa.list_(pa.float32()))], ["id", "vector"])
    out = list(R._best(iter([batch]), queries, 2))
    assert [b.column(1).to_pylist() for b in out] == [[2, 3], [6, 7], [8, 9]]


def test_packed_sizes_are_those_of_packed_texts(spark):
    from tideglass.operators import retrieval as R

    rows = [(None if d % 5 == 0 else "ab"[d % 2], d, "t" * (d % 3), None if d % 7 == 0 else "x" * (d * 13 % 29)) for d in range(120)]
    docs = spark.createDataFrame(rows, "lang string, doc_id int, title string, text string")
    plain = R.pack_context(R.top_k(docs, ["lang"], ["doc_id"], 10**9), ["lang"], 300).select("lang", "rank", "used", "span_hash")
    found = R.pack_sizes(docs, ["lang"], ["doc_id"], 300)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    assert not re.search(r"windowspecdefinition\(lang", optimized(found))


def test_pieces_go_on_before_the_batch_ends(spark, monkeypatch):
    from tideglass.operators import chunking as C

    monkeypatch.setattr(C, "PIECES", 10)
    rows = spark.createDataFrame([(k, "ab cd ef") for k in range(20)] + [(50, None), (51, "")], "id int, text string").coalesce(1)
    out = C.explode_with(rows, "text", lambda t: t.split(), "chunk string")
    assert out.count() == 60 and [tuple(r) for r in out.where("id = 3").orderBy("chunk_idx").collect()] == [(3, 0, "ab"), (3, 1, "cd"), (3, 2, "ef")]


def test_neighbors_without_distinct(spark, monkeypatch):
    from tideglass.operators import graph as G

    pairs = [(f"s{k}", f"n{k % 3}") for k in range(12)] + [(f"c{k}", f"n{k % 3}") for k in range(20)] + [("s0", "c1"), ("s1", "s4"), ("n0", "r"), ("n1", "r"), ("s5", "s5")]
    edges = spark.createDataFrame([(a, b, f"{a}:{b}", "x") for a, b in pairs], "src string, dst string, id string, rel_type string")
    want = set()
    for seed in ("s0", "s1", "s5", "c2"):
        level, seen = {seed}, {seed}
        for hop in range(4):
            want |= {(seed, n, hop) for n in level}
            level = {y for a, b in pairs for x, y in ((a, b), (b, a)) if x in level} - seen
            seen |= level
    seeds = spark.createDataFrame([("s0",), ("s1",), ("s5",), ("c2",)], "node string")
    for few in (100, 2, 0):
        monkeypatch.setattr(G, "FEW", few)
        rows = [tuple(r) for r in G.neighbors(edges, seeds, 3).select("seed", "node", "hop").collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want


def test_bm25_by_products(spark, monkeypatch):
    """Blocks and slices of two, an id that occurs twice, null and empty texts; no row is made for a term of a pair."""
    import math

    from tideglass.operators import products as P
    from tideglass.operators import retrieval as R

    monkeypatch.setattr(P, "QUERIES", 2)
    monkeypatch.setattr(P, "SLICE", 2)
    texts = [(k, "ab"[k % 2], [f"w{(k * j) % 7}" for j in range(k % 6)]) for k in range(20)] + [(3, "b", ["w1", "w0", "w1"]), (50, "a", None)]
    queries = {q: [f"w{q}", f"w{(q * 2) % 7}", "w1", "nowhere"] for q in range(5)}
    chunks = spark.createDataFrame(texts, "chunk_id int, source string, tokens array<string>")
    asked = spark.createDataFrame(list(queries.items()), "query_id bigint, tokens array<string>")
    mean = sum(len(t) for *_, t in texts if t is not None) / 21
    postings = {}
    for i, _, t in texts:
        for w in t or ():
            postings[i, len(t), w] = postings.get((i, len(t), w), 0) + 1
    df = {w: sum(p[2] == w for p in postings) for *_, w in postings}
    want = {}
    for q, terms in queries.items():
        for (i, n, w), tf in postings.items():
            if w in terms:
                want[q, i] = want.get((q, i), 0) + terms.count(w) * math.log(1 + (22 - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean))
    every = R.bm25(chunks, asked)
    assert "Join Inner" not in optimized(every)
    found = {(r["query_id"], r["chunk_id"]): r["score"] for r in every.collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)
    few = {(r["query_id"], r["chunk_id"]) for r in R.bm25_best(chunks, asked, 1).collect()}
    assert few <= want.keys() and all(max((round(v, 6), -i) for (p, i), v in want.items() if p == q)[1] in {-i for p, i in few if p == q} for q in queries)


def test_fuzzy_by_products(spark, monkeypatch):
    from tideglass.operators import lexical as L
    from tideglass.operators import products as P

    docs = spark.createDataFrame([(k, [f"token{k % 3}", "word", f"x{k}", "word"][: k % 5]) for k in range(12)] + [(4, ["words"])], "id int, tokens array<string>")
    asked = spark.createDataFrame([(q, ["word", f"token{q}", "token9", "word"]) for q in range(5)] + [(9, [])], "query_id int, tokens array<string>")
    weights = spark.createDataFrame([(0, "token1", 0.5), (1, "x3", 0.25)], "query_id int, term string, weight double")
    run = lambda: [sorted((tuple(round(x, 9) for x in r) for r in df.collect())) for df in (L.fuzzy_matches(docs, asked), L.weighted_search({"text": docs}, asked, weights), L.phrases(docs, asked))]
    whole = run()
    monkeypatch.setattr(P, "QUERIES", 2)
    monkeypatch.setattr(P, "SLICE", 2)
    assert run() == whole and len(whole[0]) == len(whole[1]) > 40
    assert "Join Inner" not in optimized(L.fuzzy_matches(docs, asked)) and "Join Inner" not in optimized(L.phrases(docs, asked))


def test_calibration_makes_no_pairs(spark, monkeypatch):
    """200 items like the same 200 anchors: what is walked is items and anchors; small rounds give the walk's rows."""
    from tideglass.operators import matching as M

    machine = spark.createDataFrame([(k, "ADD", "none", "about #7") for k in range(200)], "item int, change_type string, anchor string, points string")
    gold = spark.createDataFrame([(k, "ADD", f"a{(k * 37) % 200}", "#7", "verified") for k in range(200)], "place int, change_type string, anchor string, field string, status string")
    plain, walked = M.first_come, []
    monkeypatch.setattr(M, "first_come", lambda *given: walked.extend(df.count() for df in given[:-1]) or plain(*given))
    assert sorted(map(tuple, M.calibration_pairs(machine, gold, 70).collect())) == [(k, f"a{(k * 37) % 200}") for k in range(200)]
    assert sum(walked) <= 600


def test_conflicts_repeat_no_expression(spark, sf_dir):
    from tideglass.plans import knowledge

    assert optimized(knowledge.conflict_resolve(spark, sf_dir)).count("CASE") < 12  # 21 when they were written out in each other


def test_upsert_relations_holds_keys_once(spark):
    """Stated, new, repeated and ended claims, keys with nulls, other columns: one aggregation, no join of distinct rows."""
    from tideglass.operators import graph as G

    edges = spark.createDataFrame([("a", "b", "r", "x", 1, None), ("a", "c", "r", "x", 2, 9), ("a", None, "r", "x", 3, None), ("d", "e", "r", "x", 4, None), ("d", "e", "r", "x", 5, None)], "src string, dst string, rel_type string, claim string, id int, invalid_at int")
    given = [("a", "b", "r", "x", 10), ("a", "b", "r", "y", 11), ("a", "c", "r", "x", 12), ("a", None, "r", "x", 13), ("a", None, "r", "x", 13), ("d", "e", "r", "x", 14), ("f", "g", "r", None, 15), ("f", "g", "r", None, 15)]
    incoming = spark.createDataFrame(given, "src string, dst string, rel_type string, claim string, id int").withColumn("note", F.concat(F.lit("n"), "id"))
    found = G.upsert_relations(edges, incoming)
    assert "Join" not in optimized(found) and found.columns == [*edges.columns, "note"]
    rows = {(r["src"], r["dst"], r["claim"], r["id"], r["note"]) for r in found.where("note is not null").collect()}
    assert rows == {("a", "b", "y", 11, "n11"), ("a", "c", "x", 12, "n12"), ("a", None, "x", 13, "n13"), ("f", "g", None, 15, "n15")} and found.count() == 9
