"""Layered memory search: whole long-term texts of tenant and user, vector search among the agent's memories, and the log of hits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from tideglass.operators.rounds import settled
from tideglass.sources.files import replace_partitions

#: The layers in their order; hits returned without a request's own number, and at most; the least score.
FULL_CONTEXT, VECTOR = ("tenant", "user"), "agent"
TOP_K, MOST_K, THRESHOLD = 5, 100, 0.65
#: Vectors of one owner that are compared with as many others in one group, and so many of them at a time.
TILE, STRIP = 4096, 512


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of one length; null if either is zero, or the lengths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms)


def _scored(asked: DataFrame, memories: DataFrame) -> DataFrame:
    """The columns of both, and score, for the pairs of asked (request_id, tenant_id, user_id, asked_agent, asked, k, least) and memories that may be among a request's k best.

    Both are dealt out in tiles within tenant, user and length of vector; a pair of tiles is one group, a product of two matrices, and
    hands on each request's best k (with ties). A vector that is zero, or holds a null or no finite number, has no score.
    """
    owner = ["tenant_id", "user_id", "width"]
    whole = lambda v: F.transform(v, lambda x: x.cast("double"))
    fit = lambda v: (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull()) & F.col("tenant_id").isNotNull() & F.col("user_id").isNotNull()
    a = asked.where(fit("asked")).withColumn("width", F.size("asked")).withColumn("asked", whole("asked"))
    b = memories.where(fit("vector")).withColumn("width", F.size("vector")).withColumn("vector", whole("vector"))
    tiles = lambda rows, name: rows.groupBy(*owner).agg(F.ceil(F.count("*") / TILE).cast("int").alias(name))
    sizes = tiles(a, "a_tiles").join(tiles(b, "b_tiles"), owner)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    a = a.join(sizes, owner).withColumn("a_tile", deal("request_id", "a_tiles")).withColumn("b_tile", every("b_tiles")).drop("a_tiles", "b_tiles")
    b = b.join(sizes, owner).withColumn("b_tile", deal("memory_id", "b_tiles")).withColumn("a_tile", every("a_tiles")).drop("a_tiles", "b_tiles")
    payload = [c for c in memories.columns if c not in ("tenant_id", "user_id", "vector")]
    made = StructType([*asked.select("request_id", "k", "least").schema.fields, *memories.select(*payload).schema.fields, StructField("score", DoubleType())])
    kinds = to_arrow_schema(made)

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        q, r, scores = [], [], []
        if left.num_rows and right.num_rows:
            unit = lambda t, c: (lambda v: v / np.linalg.norm(v, axis=1)[:, None])(t[c].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1))
            with np.errstate(invalid="ignore", divide="ignore"):
                x, y = unit(left, "asked"), unit(right, "vector")
            wanted, agents, k = np.array(left["asked_agent"].to_pylist(), object), np.array(right["agent_id"].to_pylist(), object), left["k"].to_numpy()
            free = np.equal(wanted, None)
            for start in range(0, len(x), STRIP):
                at = slice(start, start + STRIP)
                score = np.where(free[at, None] | (wanted[at, None] == agents), x[at] @ y.T, -np.inf)
                score[np.isnan(score)] = -np.inf
                few = int(min(k[at].max(), score.shape[1]))
                if few < 1:
                    continue
                least = np.partition(score, -few, axis=1)[:, -few][:, None]
                i, j = np.nonzero((score >= least - 1e-8) & (score > -np.inf))
                q.append(i + start), r.append(j), scores.append(score[i, j])
        join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0, kind))
        q, r = join(q, np.int64), join(r, np.int64)
        columns = [left[c].take(q) for c in ("request_id", "k", "least")] + [right[c].take(r) for c in payload] + [join(scores, float)]
        return pa.table(columns, schema=kinds)

    return a.groupBy(*owner, "a_tile", "b_tile").cogroup(b.groupBy(*owner, "a_tile", "b_tile")).applyInArrow(best, made)


def layered_search(requests: DataFrame, long_term: DataFrame, memories: DataFrame) -> DataFrame:
    """(request_id, layer, memory_id, external_id, content, score, memory_type, status, concept_tags, place): what each layer gives each request.

    requests: request_id, tenant_id, user_id, agent_id, vector, layers (null or empty: all), top_k (null: TOP_K; MOST_K at
    most), threshold (null: THRESHOLD). long_term: version_id, tenant_id, scope, subject_id, content, active; the tenant's and the user's
    active, not blank text comes whole, with a score of 1. memories: memory_id, tenant_id, user_id, agent_id, content, memory_type, status,
    concept_tags, vector; only those of the request's tenant and user, and of its agent if it names one, are
    compared, by cosine. A request without a vector gets none of them. Layers come in their order, hits by score.
    """
    wants = lambda layer: F.col("layers").isNull() | (F.size("layers") <= 0) | F.array_contains("layers", layer)
    parts = []
    for order, layer in enumerate(FULL_CONTEXT):
        subject = F.col("tenant_id") if layer == "tenant" else F.col("user_id")
        asked = requests.where(wants(layer)).select("request_id", "tenant_id", subject.alias("subject_id"))
        texts = long_term.where(F.col("active") & (F.trim("content") != "") & (F.col("scope") == layer)).select("tenant_id", "subject_id", "version_id", "content")
        parts.append(
            asked.join(texts, ["tenant_id", "subject_id"]).select(
                "request_id", F.lit(layer).alias("layer"), F.lit(order).alias("__order"), F.lit(None).cast("bigint").alias("memory_id"), F.concat(F.lit("long-term-version:"), "version_id").alias("external_id"),
                "content", F.lit(1.0).alias("score"), F.lit("long_term").alias("memory_type"), F.lit("active").alias("status"), F.array().cast("array<string>").alias("concept_tags"),
            )
        )
    asked = requests.where(wants(VECTOR) & F.col("vector").isNotNull()).select(
        "request_id", "tenant_id", "user_id", F.col("agent_id").alias("asked_agent"), F.col("vector").alias("asked"), F.least(F.coalesce("top_k", F.lit(TOP_K)), F.lit(MOST_K)).alias("k"), F.coalesce("threshold", F.lit(THRESHOLD)).alias("least")
    )
    near = _scored(asked, memories).withColumn("score", F.round("score", 9))
    # the index returns its best k first, the threshold sifts these
    place = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("score"), "memory_id"))
    near = near.withColumn("__n", place).where((F.col("__n") <= MOST_K) & (F.col("__n") <= F.col("k")) & (F.col("score") >= F.col("least")))
    parts.append(near.select("request_id", F.lit(VECTOR).alias("layer"), F.lit(len(FULL_CONTEXT)).alias("__order"), F.col("memory_id").cast("bigint").alias("memory_id"), F.lit(None).cast("string").alias("external_id"), "content", "score", "memory_type", "status", "concept_tags"))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    own = Window.partitionBy("request_id").orderBy("__order", F.desc("score"), "memory_id", "external_id")
    return every.withColumn("place", F.row_number().over(own)).drop("__order")


def hits(found: DataFrame, requests: DataFrame, at: Column) -> DataFrame:
    """The hit log's rows: results with a memory_id, with what was asked, its SHA-256, and the day."""
    asked = requests.select("request_id", "tenant_id", "user_id", "agent_id", "conversation_id", F.col("query").alias("query_text"))
    rows = found.where("memory_id IS NOT NULL").select("request_id", "memory_id", F.col("score").alias("retrieval_score")).join(asked, "request_id")
    return rows.withColumns({"query_hash": F.sha2("query_text", 256), "source": F.lit("internal"), "occurred_at": at, "day": F.date_format(at, "yyyy-MM-dd"), "grounded": F.lit(False)})


def append_hits(rows: DataFrame, log: str, batch_id: int) -> None:
    """Appends hits to the log exactly once: a batch is a partition of its own, which a repeated delivery replaces; a hit of a request is held once."""
    once = rows.dropDuplicates(["request_id", "memory_id"]).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
    once = settled(once)  # the search isn't run again for the look at its first row
    if once.limit(1).count():
        replace_partitions(once, log, "batch_id")


def search_stream(requests: DataFrame, long_term: DataFrame, memories: DataFrame, log: str, checkpoint: str):
    """The writer of a stream of requests (with `at`): each batch is searched and its hits are logged; start() runs it."""

    def one(batch: DataFrame, batch_id: int) -> None:
        append_hits(hits(layered_search(batch, long_term, memories), batch.drop("at"), F.lit(None).cast("timestamp")).drop("occurred_at", "day").join(batch.select("request_id", F.col("at").alias("occurred_at"), F.date_format("at", "yyyy-MM-dd").alias("day")), "request_id"), log, batch_id)

    return requests.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
