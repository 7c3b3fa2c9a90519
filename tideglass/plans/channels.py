"""Channels, layered search and canonical hashes over events, conversations, embeddings and parts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tideglass.functions import canonical as C
from tideglass.operators import layers as L
from tideglass.operators.rounds import settled, shared_folder
from tideglass.plans._base import query, table
from tideglass.streaming import channels as S


@query("""SELECT p_partkey, substr(sha256('{"a": {"n": ' || p_size || ', "é": "' || p_brand || '"}, "z": ["' || p_name || '", null]}'), 1, 16) AS digest FROM part""")
def canonical_hash(spark, sf_dir):
    inner = F.struct(F.col("p_brand").alias("é"), F.col("p_size").alias("n"))
    text = F.concat(F.lit('{"z":['), F.lit('"'), F.col("p_name"), F.lit('" ,null], "a":'), F.to_json(inner), F.lit("}"))
    return table(spark, sf_dir, "part").select("p_partkey", C.canonical_hash(text).alias("digest"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n, max(ts) OVER (PARTITION BY user_id) AS last FROM events) SELECT user_id, event_id FROM r WHERE n <= 6 AND last > TIMESTAMP '2024-01-30'""")
def capped_log(spark, sf_dir):
    now = F.lit("2024-01-31").cast("timestamp_ntz")
    return S.capped(table(spark, sf_dir, "events"), "user_id", "event_id", "ts", now, most=6).select("user_id", "event_id")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id >= 300")
def subscribe_history(spark, sf_dir):
    """The events from an index on, as the stream of the log delivers them."""
    folder = f"{shared_folder(spark)}/subscription-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    log = f"{folder}/log"
    events.write.parquet(log)
    stream = S.subscribe(spark, log, events.schema, 300, "event_id")
    S.deliver(stream, f"{folder}/out", f"{folder}/checkpoint", ("event_id",)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(*events.columns)


@query("""WITH t AS (SELECT conv_id, 'deep_thinking' AS kind, turn, text FROM conversations WHERE turn % 2 = 0 UNION ALL SELECT conv_id, CASE WHEN turn >= 3 THEN 'code' ELSE 'thinking' END, turn, CASE WHEN turn = 3 THEN 'Code: ```' ELSE '' END || text FROM conversations WHERE turn % 2 = 1)
  SELECT conv_id, kind, sha256(string_agg(text, '' ORDER BY turn)) AS digest FROM t GROUP BY ALL""")
def token_router(spark, sf_dir):
    """Even turns within think tags, code from turn 3 on; tags and markers are cut into pieces."""
    turns = table(spark, sf_dir, "conversations")
    even = F.array(F.lit("<th"), F.concat(F.lit("ink>"), "text", F.lit("</thi")), F.lit("nk>"))
    odd = F.when(F.col("turn") == 3, F.array(F.lit("Co"), F.lit("de: `"), F.concat(F.lit("``"), "text"))).otherwise(F.array("text"))
    pieces = turns.select("conv_id", "turn", F.posexplode(F.when(F.col("turn") % 2 == 0, even).otherwise(odd)).alias("n", "piece")).withColumn("place", F.col("turn") * 4 + F.col("n"))
    spans = S.route(pieces, "conv_id", "place", "piece")
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda s: s["text"]), "")
    return spans.groupBy("conv_id", "kind").agg(F.sha2(whole, 256).alias("digest"))


_LAYERED = """WITH m AS (SELECT vec_id AS memory_id, 't' || label % 2 AS tenant_id, 'u' || label AS user_id, 'a' || vec_id % 3 AS agent_id, 'memory ' || vec_id AS content, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  q AS (SELECT memory_id AS request_id, tenant_id, user_id, CASE WHEN memory_id % 40 = 0 THEN agent_id END AS agent_id, v FROM m WHERE memory_id % 20 = 0),
  a AS (SELECT request_id, m.memory_id, content, round(list_cosine_similarity(q.v, m.v), 9) AS score FROM q JOIN m USING (tenant_id, user_id) WHERE q.agent_id IS NULL OR q.agent_id = m.agent_id),
  k AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC, memory_id) <= 5)"""


def memories(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("memory_id"), F.concat(F.lit("t"), F.col("label") % 2).alias("tenant_id"), F.concat(F.lit("u"), "label").alias("user_id"), F.concat(F.lit("a"), F.col("vec_id") % 3).alias("agent_id"), F.concat(F.lit("memory "), "vec_id").alias("content"),
                    F.lit("fact").alias("memory_type"), F.lit("active").alias("status"), F.array(F.lit("x")).alias("concept_tags"), F.col("embedding").alias("vector"))


def requests(spark, sf_dir):
    m = memories(spark, sf_dir).where("memory_id % 20 = 0")
    agent = F.when(F.col("memory_id") % 40 == 0, F.col("agent_id"))
    return m.select(F.col("memory_id").alias("request_id"), "tenant_id", "user_id", agent.alias("agent_id"), "vector", F.lit(None).cast("array<string>").alias("layers"), F.lit(None).cast("int").alias("top_k"), F.lit(None).cast("double").alias("threshold"), F.col("content").alias("query"), F.lit("c1").alias("conversation_id"))


def long_term(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    even = F.col("n_nationkey") % 2 == 0
    scope = F.when(even, "tenant").otherwise("user")
    tenant = F.concat(F.lit("t"), F.when(even, F.floor(F.col("n_nationkey") % 4 / 2)).otherwise(1))
    subject = F.when(even, tenant).otherwise(F.concat(F.lit("u"), "n_nationkey"))
    return n.select(F.col("n_nationkey").alias("version_id"), tenant.alias("tenant_id"), scope.alias("scope"), subject.alias("subject_id"), F.col("n_name").alias("content"), (F.col("n_nationkey") < 12).alias("active"))


_LONG = """lt AS (SELECT n_nationkey AS version_id, CASE WHEN n_nationkey % 2 = 0 THEN 't' || (n_nationkey % 4) // 2 ELSE 't1' END AS tenant_id, CASE WHEN n_nationkey % 2 = 0 THEN 'tenant' ELSE 'user' END AS scope,
  CASE WHEN n_nationkey % 2 = 0 THEN 't' || (n_nationkey % 4) // 2 ELSE 'u' || n_nationkey END AS subject_id, n_name AS content FROM nation WHERE n_nationkey < 12)"""


@query(f"""{_LAYERED}, {_LONG}, f AS (SELECT request_id, scope AS layer, NULL AS memory_id, 'long-term-version:' || version_id AS external_id, content, 1.0 AS score, CASE scope WHEN 'tenant' THEN 0 ELSE 1 END AS o FROM q JOIN lt ON lt.tenant_id = q.tenant_id AND subject_id = CASE scope WHEN 'tenant' THEN q.tenant_id ELSE q.user_id END
  UNION ALL SELECT request_id, 'agent', memory_id, NULL, content, score, 2 FROM k WHERE score >= 0.65) SELECT request_id, layer, memory_id, external_id, content, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY request_id ORDER BY o, score DESC, memory_id, external_id) AS INTEGER) AS place FROM f""")
def layered_search(spark, sf_dir):
    found = L.layered_search(requests(spark, sf_dir), long_term(spark, sf_dir), memories(spark, sf_dir))
    return found.select("request_id", "layer", "memory_id", "external_id", "content", F.round("score", 6).alias("score"), "place")


@query(f"{_LAYERED} SELECT request_id, memory_id, sha256('memory ' || request_id) AS query_hash, round(score, 6) AS retrieval_score, '2024-05-01' AS day FROM k WHERE score >= 0.65")
def hit_log(spark, sf_dir):
    """The log after the same batch was delivered twice."""
    asked = requests(spark, sf_dir)
    log = f"{shared_folder(spark)}/hits-{uuid.uuid4().hex}"
    rows = settled(L.hits(L.layered_search(asked, long_term(spark, sf_dir), memories(spark, sf_dir)), asked, F.lit("2024-05-01 10:00:00").cast("timestamp")))
    for _ in range(2):
        L.append_hits(rows, log, 7)
    return spark.read.parquet(log).select("request_id", "memory_id", "query_hash", F.round("retrieval_score", 6).alias("retrieval_score"), "day")
