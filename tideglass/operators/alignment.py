"""Entity alignment by vectors: the exact best match above a cosine threshold, and what to do with it."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Cosines above the first merge, from the second on they are adjudicated.
MERGE, ADJUDICATE = 0.80, 0.60
#: Pivots for each vector length; rows of a block that meets a block of queries in one task.
PIVOTS, BLOCK = 64, 2048
#: Angles are compared with this much room for rounding.
_ROOM = 1e-6


def _units(vectors: pd.Series) -> np.ndarray:
    rows = np.array(vectors.tolist(), float)
    return rows / np.linalg.norm(rows, axis=1)[:, None]


def _angles(batches: Iterator[pd.DataFrame], pivots: dict[int, np.ndarray], nearest: bool) -> Iterator[pd.DataFrame]:
    """Rows (id, vector) with the nearest pivot of their length and its angle, or, as a row each, with all of them."""
    for rows in batches:
        for size, some in rows.groupby(rows["vector"].map(len)):
            if size not in pivots:
                continue
            angle = np.arccos(np.clip(_units(some["vector"]) @ pivots[size].T, -1, 1))
            if nearest:
                at = angle.argmin(axis=1)
                yield some.assign(size=np.int32(size), pivot=at.astype(np.int32), angle=angle[np.arange(len(at)), at])
            else:
                n, m = angle.shape
                yield some.loc[some.index.repeat(m)].assign(size=np.int32(size), pivot=np.tile(np.arange(m, dtype=np.int32), n), angle=angle.ravel())


def _best(queries: pd.DataFrame, rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """The best row for each query of a block, if it reaches the threshold; ties by id."""
    if not len(queries) or not len(rows):
        return pd.DataFrame({"query_id": queries["query_id"][:0], "id": rows["id"][:0], "score": np.zeros(0)})
    rows = rows.sort_values("id")
    score = np.round(_units(queries["vector"]) @ _units(rows["vector"]).T, 9)
    score[queries["query_id"].to_numpy()[:, None] == rows["id"].to_numpy()[None]] = -2.0
    at = score.argmax(axis=1)
    best = score[np.arange(len(at)), at]
    keep = best >= threshold
    return pd.DataFrame({"query_id": queries["query_id"].to_numpy()[keep], "id": rows["id"].to_numpy()[at[keep]], "score": best[keep]})


def best_above(vectors: DataFrame, queries: DataFrame, threshold: float = ADJUDICATE, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(query_id, id, score): for each query (query_id, vector) the vector (id, vector) of highest cosine, if that reaches the threshold; ties by id. A query never meets its own id.

    Exact: vectors lie in the cell of their nearest pivot, and a query skips the cells whose angles to the pivot rule out
    an angle of arccos(threshold). A cell meets its queries in blocks of both, a task each. Vectors compare with those of
    their length; null and zero ones, and those with null entries, match nothing.
    """
    sound = lambda df, name: df.select(name, F.col("vector").cast("array<double>").alias("vector")).where(F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c)) & F.exists("vector", lambda c: c != 0))
    vectors, queries = sound(vectors, "id"), sound(queries, "query_id")
    chosen = vectors.select("vector", F.size("vector").alias("size"), F.row_number().over(Window.partitionBy(F.size("vector")).orderBy(F.xxhash64("vector"))).alias("n")).where(F.col("n") <= pivots)
    by: dict[int, list] = {}
    for r in chosen.collect():  # `pivots` vectors of each length
        by.setdefault(r["size"], []).append(r["vector"])
    matrix = {size: _units(pd.Series(rows)) for size, rows in by.items()}
    kinds = {"id": dict(vectors.dtypes)["id"], "query_id": dict(queries.dtypes)["query_id"]}
    cells = vectors.mapInPandas(partial(_angles, pivots=matrix, nearest=True), f"id {kinds['id']}, vector array<double>, size int, pivot int, angle double").checkpoint()
    rings = cells.groupBy("size", "pivot").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    near = queries.mapInPandas(partial(_angles, pivots=matrix, nearest=False), f"query_id {kinds['query_id']}, vector array<double>, size int, pivot int, angle double")
    reach = math.acos(threshold) + _ROOM
    near = near.join(F.broadcast(rings), ["size", "pivot"]).where((F.col("angle") - F.col("high") <= reach) & (F.col("low") - F.col("angle") <= reach)).drop("low", "high", "angle")
    near = near.checkpoint()
    sizes = near.groupBy("size", "pivot", "blocks").agg(F.ceil(F.count("*") / block).cast("int").alias("chunks"))
    number = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    asked = near.join(F.broadcast(sizes.select("size", "pivot", "chunks")), ["size", "pivot"]).withColumn("chunk", number("query_id", "chunks")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    held = cells.join(F.broadcast(sizes), ["size", "pivot"]).withColumn("block", number("id", "blocks")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    keys = ["size", "pivot", "block", "chunk"]
    pairs = asked.select(*keys, "query_id", "vector").groupBy(*keys).cogroup(held.select(*keys, "id", "vector").groupBy(*keys))
    found = pairs.applyInPandas(lambda q, v: _best(q, v, threshold), f"query_id {kinds['query_id']}, id {kinds['id']}, score double")
    best = found.groupBy("query_id").agg(F.min(F.struct((-F.col("score")).alias("loss"), "id", "score")).alias("b"))
    return best.select("query_id", "b.id", "b.score")


def align(entities: DataFrame, incoming: DataFrame, merge: float = MERGE, adjudicate: float = ADJUDICATE) -> DataFrame:
    """(query_id, id, score, decision) for every row of incoming (query_id, vector): merge with the best entity above `merge`, adjudicate from `adjudicate` on, else pending without an id."""
    best = best_above(entities, incoming, adjudicate)
    decision = F.when(F.col("score") > merge, "merge").when(F.col("score").isNotNull(), "adjudicate").otherwise("pending")
    return incoming.select("query_id").distinct().join(best, "query_id", "left").select("query_id", "id", "score", decision.alias("decision"))
