"""Channels under restarts and repeated deliveries, capped logs, the router under any cut, layered search, canonical hashes."""

import hashlib
import json
import os
import random
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tideglass.functions import canonical
from tideglass.operators import layers
from tideglass.sources.files import replace_partitions
from tideglass.streaming import channels

EVENTS = "event_index bigint, chunk string"


@pytest.fixture
def folder():
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    os.mkdir(f"{path}/in")
    return path


def append(spark, folder, ids):
    spark.createDataFrame([(i, f"chunk {i}") for i in ids], EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/log")


def run(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def test_subscription_over_a_restart(spark, folder):
    """History, then live: a stop in the middle and a start anew lose and repeat nothing."""
    append(spark, folder, range(5))
    append(spark, folder, range(5, 9))
    subscribed = lambda: channels.deliver(channels.subscribe(spark, f"{folder}/log", EVENTS, 3), f"{folder}/out", f"{folder}/state")
    run(subscribed())
    got = lambda: sorted(r["event_index"] for r in spark.read.parquet(f"{folder}/out").collect())
    assert got() == list(range(3, 9))
    append(spark, folder, range(9, 12))
    run(subscribed())
    append(spark, folder, [12])
    run(subscribed())
    run(subscribed())
    assert got() == list(range(3, 13))


def test_delivery_that_fails_midway(spark, folder, monkeypatch):
    """A batch that was written but not committed is delivered again and replaced."""
    append(spark, folder, range(6))
    written = []

    def broken(rows, to, key):
        replace_partitions(rows, to, key)
        written.append(key)
        if len(written) == 1:
            raise RuntimeError("lost")

    monkeypatch.setattr(channels, "replace_partitions", broken)
    subscribed = lambda: channels.deliver(channels.subscribe(spark, f"{folder}/log", EVENTS), f"{folder}/out", f"{folder}/state")
    with pytest.raises(Exception, match="lost"):
        run(subscribed())
    run(subscribed())
    assert len(written) == 2 and sorted(r["event_index"] for r in spark.read.parquet(f"{folder}/out").collect()) == list(range(6))


def at(seconds):
    return datetime(2024, 1, 1) + timedelta(seconds=seconds)


def test_capped_stream(spark, folder):
    """Over batches: what is beyond the cap goes, and a key beyond its time to live."""
    schema = "key string, n bigint, ts timestamp"
    batches = [[("a", k, at(k)) for k in range(5)] + [("b", 1, at(2))], [("a", 9, at(60))], [("a", 10, at(200))], [("a", 11, at(201))]]
    seen = []
    stream = channels.capped_stream(spark.readStream.schema(schema).parquet(f"{folder}/in"), "key", "n", "ts", most=3, ttl_seconds=100)
    writer = lambda: stream.writeStream.outputMode("update").foreachBatch(lambda df, _: seen.extend(map(tuple, df.collect()))).option("checkpointLocation", f"{folder}/state")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        run(writer())
    of = lambda k: [(ids, gone) for key, ids, gone in seen if key == k]
    assert of("a")[0] == ("2,3,4", False) and ("3,4,9", False) in of("a") and of("a")[-1] == ("9,10,11", False)
    assert of("b") == [("1", False), ("", True)]


def test_capped(spark):
    rows = spark.createDataFrame([("a", k, at(k)) for k in range(5)] + [("b", 1, at(-500)), (None, 7, at(3))], "key string, n bigint, ts timestamp")
    found = channels.capped(rows, "key", "n", "ts", F.lit(at(90)), most=2, ttl_seconds=100).collect()
    assert sorted((r["key"] or "", r["n"]) for r in found) == [("", 7), ("a", 3), ("a", 4)]
    assert channels.capped(rows.limit(0), "key", "n", "ts", F.lit(at(90))).count() == 0


TEXTS = [
    "plain <think>deep <b> < /think></think>after Code: ```x = 1``` <think>more</think> end",
    "Codes and Code ```no``` 代码：\n\n ```y```",
    "<think>never closed </thin",
    "</think> stray <thi nk>",
    "Co<think>a</think>de:```z",
    "<<think>x</</think>y代",
    "",
]


def whole(text):
    router = channels.Router()
    return channels.joined(router.feed(text) + router.end())


def test_router_golden():
    assert whole(TEXTS[0]) == [("thinking", "plain "), ("deep_thinking", "deep <b> < /think>"), ("thinking", "after "), ("code", "Code: ```x = 1``` "), ("deep_thinking", "more"), ("code", " end")]
    assert whole(TEXTS[1]) == [("thinking", "Codes and Code ```no``` "), ("code", "代码：\n\n ```y```")]
    assert whole(TEXTS[2]) == [("deep_thinking", "never closed </thin")]
    assert whole(TEXTS[3]) == [("thinking", "</think> stray <thi nk>")]
    assert whole(TEXTS[4]) == [("deep_thinking", "a"), ("code", "Code:```z")]


def cuts(rng, text):
    at = sorted({0, len(text), *(rng.randrange(len(text) + 1) for _ in range(rng.randrange(0, 12)))})
    return [text[a:b] for a, b in zip(at, at[1:])] or [""]


def test_router_under_any_cut(spark, folder):
    """One piece, random pieces, single characters; batch and stream, over several batches: the same spans."""
    rng = random.Random(6)
    rows, want = [], {}
    for k, text in enumerate(TEXTS * 4):
        pieces = list(text) or [""] if k % 4 == 0 else cuts(rng, text)
        want[k] = whole(text)
        rows += [(k, n, p, n == len(pieces) - 1) for n, p in enumerate(pieces)]
    schema = "key int, n int, piece string, last boolean"
    df = spark.createDataFrame(rows, schema)

    def spans(found):
        out = {k: [] for k in want}
        for r in sorted(found, key=lambda r: (r["key"], r["place"])):
            out[r["key"]].append((r["kind"], r["text"]))
        return {k: channels.joined(v) for k, v in out.items()}

    assert spans(channels.route(df.repartition(5), "key", "n", "piece").collect()) == want
    assert channels.route(df.limit(0), "key", "n", "piece").count() == 0
    seen = []
    stream = channels.route_stream(spark.readStream.schema(schema).parquet(f"{folder}/in"), "key", "n", "piece", "last")
    for part in range(3):  # the first, second and third part of every text
        cut = df.where(F.col("n") < 4) if part == 0 else df.where("n between 4 and 9") if part == 1 else df.where("n > 9")
        cut.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        run(stream.writeStream.outputMode("append").foreachBatch(lambda d, _: seen.extend(d.collect())).option("checkpointLocation", f"{folder}/state"))
    assert spans(seen) == want


REQUEST = "request_id int, tenant_id string, user_id string, agent_id string, conversation_id string, query string, vector array<double>, layers array<string>, top_k int, threshold double"


@pytest.fixture
def store(spark):
    memories = [(k, "t", "u", ("x", "y")[k % 2], f"m{k}", "fact", "active", ["tag"], [1.0, 0.1 * k]) for k in range(8)] + [(90, "t", "other", "x", "hidden", "fact", "active", None, [1.0, 0.0]), (91, "q", "u", "x", "hidden", "fact", "active", None, [1.0, 0.0]), (92, "t", "u", "x", "zero", "fact", "active", None, [0.0, 0.0]), (93, "t", "u", "x", "none", "fact", "active", None, None)]
    long = [(1, "t", "tenant", "t", "tenant text", True), (2, "t", "user", "u", "user text", True), (3, "t", "user", "u", "old", False), (4, "t", "user", "w", "  ", True), (5, "q", "user", "u", "another tenant's", True)]
    return (
        spark.createDataFrame(long, "version_id int, tenant_id string, scope string, subject_id string, content string, active boolean"),
        spark.createDataFrame(memories, "memory_id int, tenant_id string, user_id string, agent_id string, content string, memory_type string, status string, concept_tags array<string>, vector array<double>"),
    )


def test_layered_search(spark, store):
    one = lambda *row: spark.createDataFrame([row], REQUEST)
    found = lambda r: [(x["layer"], x["content"]) for x in layers.layered_search(r, *store).orderBy("place").collect()]
    assert found(one(1, "t", "u", None, "c", "q", [1.0, 0.0], None, None, None)) == [("tenant", "tenant text"), ("user", "user text"), *(("agent", f"m{k}") for k in range(5))]
    assert found(one(1, "t", "u", "y", "c", "q", [1.0, 0.0], ["agent"], 3, 0.97)) == [("agent", "m1")]
    assert found(one(1, "t", "u", "y", "c", "q", None, [], None, None)) == [("tenant", "tenant text"), ("user", "user text")]
    assert found(one(1, "t", "w", None, "c", "q", [1.0, 0.0], ["user", "agent"], 500, 0.0)) == []
    assert len(found(one(1, "t", "u", None, "c", "q", [1.0, 0.0], ["agent"], 500, -1.0))) == 8


def test_hits_are_logged_once(spark, store, folder):
    """A stream of requests, one batch delivered twice."""
    rows = [(k, "t", "u", None, "c", f"query {k}", [1.0, 0.0], ["tenant", "agent"], 2, None, at(k)) for k in range(3)]
    spark.createDataFrame(rows, REQUEST + ", at timestamp").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(REQUEST + ", at timestamp").parquet(f"{folder}/in")
    for state in ("one", "two"):  # a lost checkpoint delivers batch 0 again
        run(layers.search_stream(stream, *store, f"{folder}/log", f"{folder}/{state}"))
    log = spark.read.parquet(f"{folder}/log").collect()
    assert sorted((r["request_id"], r["memory_id"]) for r in log) == [(k, m) for k in range(3) for m in (0, 1)]
    assert {r["query_hash"] for r in log} == {hashlib.sha256(f"query {k}".encode()).hexdigest() for k in range(3)} and {r["day"] for r in log} == {"2024-01-01"}


def test_canonical_json(spark):
    texts = ['{"b": 1, "a": {"d": [1, 2.50, {"z": null, "y": true}], "c": "é\\u4e2d"}}', "[]", '"x"', "{bad", None, "", '{"questions": [{"q": 1, "a": 2}]}', '{"questions": []}', '{"other": 1}']
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", canonical.canonical_json(F.col("t")).alias("j"), canonical.canonical_hash(F.col("t")).alias("h"), canonical.testset_hash(F.col("t")).alias("s")).orderBy("k").collect()
    assert rows[0]["j"] == '{"a": {"c": "é中", "d": [1, 2.5, {"y": true, "z": null}]}, "b": 1}'
    assert [r["j"] for r in rows[3:6]] == [None] * 3 and [r["h"] for r in rows[3:6]] == [None] * 3
    digest = lambda v: hashlib.sha256(json.dumps(v, ensure_ascii=False, sort_keys=True).encode()).hexdigest()[:16]
    assert rows[0]["h"] == digest(json.loads(texts[0])) and rows[6]["s"] == digest([{"a": 2, "q": 1}]) and rows[7]["s"] == rows[8]["s"] == digest([])
