"""Token overlap and F1 against counters."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tideglass.functions import text as T


def test_overlap_is_that_of_counters(spark):
    rng = random.Random(1)
    words = ["a", "b", "cc", "é", "", "z z"]
    rows = [(k, rng.choices(words, k=rng.randrange(9)), rng.choices(words, k=rng.randrange(9))) for k in range(300)]
    df = spark.createDataFrame(rows, "id int, a array<string>, b array<string>")
    for r in df.select("*", T.overlap(F.col("a"), F.col("b")).alias("n"), T.f1(F.col("a"), F.col("b")).alias("f")).collect():
        common = sum((Counter(r["a"]) & Counter(r["b"])).values())
        assert r["n"] == common and abs(r["f"] - (2 * common / (len(r["a"]) + len(r["b"])) if r["a"] or r["b"] else 1.0)) < 1e-12


def test_overlap_of_nulls_and_long_texts(spark):
    df = spark.createDataFrame([(["x", None, None, "x"], [None, "x"]), ([None], [None])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(T.overlap(F.col("a"), F.col("b"))).collect()] == [1, 0]
    long = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda i: (i % 20_000).cast("string")).alias("a"), F.transform(F.sequence(F.lit(1), F.lit(40_000)), lambda i: (i % 30_000).cast("string")).alias("b"))
    assert long.select(T.overlap(F.col("a"), F.col("b"))).first()[0] == sum(min(3, 2 if k in range(1, 10_001) else 1) for k in range(20_000))
