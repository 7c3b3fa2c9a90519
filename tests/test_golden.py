"""Golden values of single kernels."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tideglass.functions import text as T
from tideglass.operators import chunking, evaluation, graph, knowledge, memory, relational, retrieval
from tideglass.sources import files, sql_gate
from tideglass.streaming import streams


def values(spark, column, *rows):
    """column(F.col("x")) of one-column rows."""
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], "x string").select(column(F.col("x"))).collect()]


def test_rrf(spark):
    lists = spark.createDataFrame([(1, 1, "A"), (1, 2, "B"), (2, 1, "B"), (2, 2, "C")], "list_no int, pos int, id string")
    rows = retrieval.rrf(lists).orderBy("place").collect()
    assert [r["id"] for r in rows] == ["B", "A", "C"]
    assert rows[0]["score"] == pytest.approx(123 / 3782) and rows[1]["score"] == pytest.approx(1 / 61)


def test_rrf_repeats_keep_their_rank(spark):
    lists = spark.createDataFrame([(1, 1, "A"), (1, 2, "A"), (1, 3, "B")], "list_no int, pos int, id string")
    assert {r["id"]: r["best_rank"] for r in retrieval.rrf(lists).collect()} == {"A": 1, "B": 3}


def test_search_tokens(spark):
    assert values(spark, T.search_tokens, "HbA1c OGTT mmol/L", "二甲双胍") == [["hba1c", "ogtt", "mmol", "l"], ["二甲", "甲双", "双胍"]]


def test_paragraphs(spark):
    text = "abcd\n\nefgh"
    assert values(spark, lambda x: F.size(chunking.paragraph_chunks(x, 10)), text) == [1]
    assert values(spark, lambda x: F.size(chunking.paragraph_chunks(x, 6)), text) == [2]
    assert values(spark, lambda x: chunking.paragraph_chunks(x, 3), "abcdefgh", "", None) == [["abc", "def", "gh"], [], None]


def test_dreaming_score(spark):
    at = lambda *d: dt.datetime(*d)
    row = (1, 3, 2, 1, 4.2, 2, 2, 2, 2, 2, 1, at(2026, 7, 22), at(2026, 7, 22), at(2026, 7, 22))
    schema = "memory_id int, recall_count int, daily_count int, grounded_count int, total_score double, n_days int, n_queries int, span_days int, n_tags int, light_hits int, rem_hits int, last_recalled_at timestamp, last_light_at timestamp, last_rem_at timestamp"
    out = memory.dreaming_score(memory.dreaming_metrics(spark.createDataFrame([row], schema), F.lit("2026-07-23").cast("timestamp"))).first()
    assert out["signal"] == 6 and out["relevance"] == pytest.approx(0.7)
    assert out["consolidation"] == pytest.approx(0.36544353551179476)
    assert out["score"] == pytest.approx(0.7268086998271306)


def test_score_fusion_and_decay(spark):
    rows = spark.createDataFrame([(0.9, False), (1.0, True)], "s double, e boolean").select(memory.score_fusion(F.col("s"), F.col("e"))).collect()
    assert [r[0] for r in rows] == [0.9, 0.8]
    rows = spark.createDataFrame([(True, 14.0), (False, 14.0), (True, None)], "e boolean, age double").select(memory.temporal_decay(F.lit(1.0), F.col("age"), F.col("e"))).collect()
    assert [r[0] for r in rows] == [0.5, 1.0, 1.0]


def test_modularity_and_components(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f")], "src string, dst string")
    found = graph.components(edges)
    assert {r["node"]: r["component"] for r in found.collect()} == dict(a="a", b="a", c="a", d="d", e="d", f="d")
    members = found.withColumnRenamed("component", "community")
    assert graph.modularity(edges, members).first()[0] == pytest.approx(0.5)
    bridged = edges.union(spark.createDataFrame([("c", "d")], edges.schema))
    assert graph.modularity(bridged, members).first()[0] == pytest.approx(5 / 14)


def fact(i, value, lo, hi=None, **more):
    return {"fact_id": i, "key": "k", "value": value, "valid_at": lo, "invalid_at": hi, "source_id": "s", "source_group": None, "version": "1", "authority": 1, "suspect": False} | more


FACT = "fact_id string, key string, value string, valid_at int, invalid_at int, source_id string, source_group string, version string, authority int, suspect boolean"


def test_conflicts(spark):
    of = lambda *facts: sorted((r["left"]["fact_id"], r["right"]["fact_id"]) for r in knowledge.conflict_pairs(spark.createDataFrame(list(facts), FACT), ["key"]).collect())
    assert of(fact("a", "100", 1), fact("b", "200", 1), fact("c", "100", 1)) == [("a", "b"), ("b", "c")]
    assert of(fact("a", "1", 1, 5), fact("b", "2", 5)) == []  # touching
    assert of(fact("a", "1", 3, 3), fact("b", "2", 1)) == []  # empty


def test_update_plan(spark):
    rows = spark.createDataFrame([("a", "x", 1.0, 5, 2.0), ("b", "x", 1.0, 3, 3.0), ("c", "x", 1.0, 1, 10.0)], "id string, kind string, p_change double, impact int, cost double")
    plan = {r["id"]: r for r in knowledge.update_plan(rows).collect()}
    assert [k for k, r in plan.items() if r["selected"]] == ["a", "b"]
    assert plan["c"]["residual"] == 1.0 and plan["c"]["stop"] == "marginal_benefit_below_cost"


@pytest.mark.parametrize(("costs", "budgets", "want"), [([2, 2, 2], [0, 2, 3, 4, 6], [(0, 0), (1, 2), (1, 2), (2, 4), (3, 6)]), ([3, 3, 1], [4], [(1, 3)])])
def test_budget_curve(spark, costs, budgets, want):
    items = spark.createDataFrame(list(enumerate(costs)), "pos int, cost int")
    assert [(r["n_admitted"], r["spent"]) for r in knowledge.budget_curve(items, ["pos"], "cost", budgets).collect()] == want


@pytest.mark.parametrize(("n", "line"), [(18, None), (19, 19), (20, 20), (39, 38)])
def test_conformal(spark, n, line):
    assert knowledge.conformal_line(spark.range(1, n + 1).select(F.col("id").alias("s")), "s", 0.05).first()["line"] == line


def test_pass_k(spark):
    runs = spark.createDataFrame([("a", 1), ("a", 1), ("a", 0), ("b", 1), ("b", 1), ("b", 1)], "question_id string, pass int")
    row = evaluation.pass_k(runs).first()
    assert (row["accuracy"], row["pass2"], row["pass3"]) == (0.8333, 1.0, 0.5)


def test_final_number(spark):
    assert values(spark, T.final_number, "#### 1,234.5", "so the final answer is: 7 answer: -5", "work: 10, result 42", "none", None) == [1234.5, -5.0, 42.0, None, None]


def test_answers(spark):
    em = lambda p, g: spark.createDataFrame([(p, g)], "p string, g array<string>").select(T.exact_match(F.col("p"), F.col("g"))).first()[0]
    assert [em("The Cat!", ["cat"]), em("Paris", ["London", "Paris"]), em("Paris", ["London"]), em(None, None)] == [1.0, 1.0, 0.0, 1.0]
    f1 = lambda p, g: spark.createDataFrame([(p, g)], "p string, g string").select(T.f1(T.answer_tokens(F.col("p")), T.answer_tokens(F.col("g")))).first()[0]
    assert f1("the cats", "cat") == 1.0 and f1("red blue", "red green") == 0.5
    assert values(spark, lambda x: T.keyword_coverage(x, F.array(F.lit("alpha"), F.lit("gamma"))), "Alpha and beta") == [0.5]


def test_json():
    assert chunking.json_chunks('{"name":"alice","age":18}') == ['name: "alice"', "age: 18"]
    assert chunking._cut_json('{"a":1,"b":2}', 8) == ['{"a":1,', '"b":2}']
    assert chunking.json_chunks("[]") == []


def test_graph_upserts(spark):
    schema = "id string, pos int, props map<string,string>, aliases array<string>, valid_at timestamp"
    none = spark.createDataFrame([], "id string, props map<string,string>, aliases array<string>, valid_at timestamp")
    new = spark.createDataFrame([("a", 1, {"x": "1", "y": "1"}, ["n"], dt.datetime(2024, 1, 1)), ("a", 2, {"x": "2"}, ["n", "m"], dt.datetime(2025, 1, 1)), ("b", 1, None, None, None)], schema)
    once = graph.upsert_entities(none, new)
    twice = {r["id"]: r for r in graph.upsert_entities(once, new).collect()}
    assert twice["a"]["props"] == {"x": "2", "y": "1"} and twice["a"]["aliases"] == ["n", "m"] and twice["a"]["valid_at"].year == 2024
    assert len(twice) == 2 and twice["b"]["props"] == {}


def test_impact(spark):
    e = spark.createDataFrame([("e1", ["Drug:a"])], "id string, entity_refs array<string>")
    assert graph.impact(e, ["Drug:a"]).count() == 1 and graph.impact(e, ["Drug:zzz"]).count() == 0


def test_tags(spark):
    rows = spark.createDataFrame([(1, "c", "x"), (1, "d", "y"), (2, "c", "x"), (3, "c", "z")], "resource_id int, definition string, value string")
    assert [r[0] for r in relational.tag_division(rows, {"c": ["x", "z"], "d": ["y"]}).collect()] == [1]
    assert relational.tag_filter_all(rows, [("c", "x"), ("c", "z")]).count() == 0


def test_sql_gate(spark):
    assert sql_gate.run(spark, "SELECT id FROM range(10) WHERE id < :n", {"n": 3}).count() == 3
    for bad in ("DROP TABLE x", "SELECT 1; DELETE FROM x", "UPDATE x\nSET a = 1", "", "-- select\ninsert into t values (1)"):
        with pytest.raises(ValueError):
            sql_gate.run(spark, bad)
    assert sql_gate.reason_to_deny("SELECT 'drop table x' AS a") is None


def test_mmr(spark):
    pool = spark.createDataFrame([("q", 1, "a", 1.0, "x y z"), ("q", 2, "b", 0.9, "x y z"), ("q", 3, "c", 0.1, "u v w")], "key string, pos int, id string, score double, text string")
    assert [r["id"] for r in memory.mmr(pool, "key").orderBy("rank").collect()] == ["a", "c"]  # b is a copy of a


def test_visible_text():
    assert files.visible_text("<html><head><title>t</title></head><body><p>a &amp; b</p><script>x</script><p>c</p></body>") == "a & b\nc"
    assert files.visible_text(None) is None


def test_registry(spark, tmp_path):
    (tmp_path / "r.csv").write_text("asset_no,title\n1,x\n,y\n")
    rows = files.read_registry(spark, str(tmp_path / "r.csv"), ["asset_no", "title"]).orderBy("title").collect()
    assert [r["errors"] for r in rows] == [[], ["asset_no is empty"]]
    with pytest.raises(ValueError):
        files.read_registry(spark, str(tmp_path / "r.csv"), ["license"])


def test_documents_and_partitions(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# héllo")
    (tmp_path / "in" / "b.xlsx").write_bytes(b"PK")
    rows = {r["name"]: r for r in files.read_documents(spark, str(tmp_path / "in")).collect()}
    assert rows["a.md"]["text"] == "# héllo" and rows["b.xlsx"]["processor"] == "spreadsheet" and rows["b.xlsx"]["parse_error"] == "needs_external_parser"
    out = str(tmp_path / "out")
    for _ in range(2):
        files.replace_partitions(spark.createDataFrame([("t1", 1)], "tenant string, x int"), out, "tenant")
    files.replace_partitions(spark.createDataFrame([("t2", 2)], "tenant string, x int"), out, "tenant")
    assert spark.read.parquet(out).count() == 2


def test_streams(spark, tmp_path):
    schema = "event_id bigint, ts timestamp, k string, payload string"
    source = str(tmp_path / "in")
    base = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(i, base + dt.timedelta(seconds=i), "a", "xx") for i in range(5)] * 2, schema).write.parquet(source)
    stream = lambda: spark.readStream.schema(schema).parquet(source)

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(90)
        return spark.table(name).collect()

    assert len(run(streams.idempotent(stream(), ["event_id"], "ts", "1 hour"), "once", "append")) == 5
    assert run(streams.ring_buffer_stream(stream().dropDuplicates(["event_id"]), "k", 3, 100, "payload", "event_id"), "ring", "update")[-1]["ids"] == "2,3,4"


def test_order_does_not_matter(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    budget = lambda d: sorted(map(tuple, memory.token_budget(d.select("source", "doc_id", "n_chars"), "n_chars", ["doc_id"], 6000, ["source"]).collect()))
    assert budget(docs) == budget(docs.orderBy(F.rand(3)).repartition(7))
