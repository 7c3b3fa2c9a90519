"""Evaluation operators: pass^k, intervals, histograms, stability, integrity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pass_k(runs: DataFrame, question: str = "question_id", passed: str = "pass", ks: Sequence[int] = (2, 3)) -> DataFrame:
    """One row: mean accuracy of questions, and the share of questions with at least k passes."""
    by_question = runs.groupBy(question).agg(F.avg(passed).alias("acc"), F.sum(passed).alias("passes"))
    shares = [F.round(F.avg((F.col("passes") >= k).cast("double")), 4).alias(f"pass{k}") for k in ks]
    return by_question.agg(F.round(F.avg("acc"), 4).alias("accuracy"), *shares, F.count("*").alias("n_questions"))


def wilson(passed: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; null without trials."""
    n = F.when(n > 0, n.cast("double"))
    p, zz = passed / n, z * z
    centre, width = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.greatest(F.lit(0.0), centre - width), F.least(F.lit(1.0), centre + width)


def histogram(scores: DataFrame, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Counts in the buckets [0, .2), [.2, .4), [.4, .6), [.6, .8), [.8, 1.01), empty ones too."""
    edges = [0.0, 0.2, 0.4, 0.6, 0.8, 1.01]
    bucket = F.lit(None).cast("int")
    for k in range(5):
        bucket = F.when((F.col(score) >= edges[k]) & (F.col(score) < edges[k + 1]), k).otherwise(bucket)
    counts = scores.withColumn("bucket", bucket).where("bucket is not null").groupBy(*keys, "bucket").agg(F.count("*").alias("n"))
    domain = scores.select(*keys).distinct() if keys else scores.sparkSession.range(1).select()
    domain = domain.withColumn("bucket", F.explode(F.array(*map(F.lit, range(5)))))
    return domain.join(counts, [*keys, "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))


def evaluator_stats(cases: DataFrame, scores: str = "score") -> DataFrame:
    """Per evaluator of a map of scores: count, mean, least and most, and how many cases reach 0.5."""
    rows = cases.select(F.explode(scores).alias("evaluator", "value")).where("value is not null")
    return rows.groupBy("evaluator").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.sum((F.col("value") >= 0.5).cast("bigint")).alias("n_passed")
    )


def cross_table(rows: DataFrame, row: str, column: str, columns: Sequence) -> DataFrame:
    """Counts of each row value by the given column values, zeros included."""
    return rows.groupBy(row).agg(*(F.sum((F.col(column) == c).cast("bigint")).alias(f"n_{c}") for c in columns))


def nearest_quantile(rows: DataFrame, value: str, q: float, keys: Sequence[str] = ()) -> DataFrame:
    """The sorted value at index round(q * (n - 1)), halves to even."""
    window = Window.partitionBy(*keys)
    ranked = rows.withColumn("__n", F.row_number().over(window.orderBy(value))).withColumn("__all", F.count("*").over(window))
    return ranked.where(F.col("__n") == F.bround(F.lit(q) * (F.col("__all") - 1)) + 1).select(*keys, F.col(value).alias(f"q_{value}"))


def repeat_stability(runs: DataFrame, item: str, passed: str) -> DataFrame:
    """Attempts and passes of each item, and whether it always, never or sometimes passes."""
    out = runs.groupBy(item).agg(F.count("*").alias("attempts"), F.sum(F.col(passed).cast("bigint")).alias("passes"))
    return out.withColumn("kind", F.when(F.col("passes") == F.col("attempts"), "stable_pass").when(F.col("passes") == 0, "stable_fail").otherwise("unstable"))


def run_integrity(expected: DataFrame, results: DataFrame, item: str, score: str) -> DataFrame:
    """Counts of items that are missing, unexpected, repeated or without a score, and whether there are none."""
    want, got = expected.select(item).distinct(), results.groupBy(item).agg(F.count("*").alias("n"), F.sum(F.col(score).isNull().cast("int")).alias("no_score"))
    both = want.withColumn("want", F.lit(1)).join(got, item, "full")
    found = both.agg(
        F.coalesce(F.sum((F.col("want").isNotNull() & F.col("n").isNull()).cast("bigint")), F.lit(0)).alias("n_missing"),
        F.coalesce(F.sum((F.col("want").isNull()).cast("bigint")), F.lit(0)).alias("n_unexpected"),
        F.coalesce(F.sum((F.col("n") > 1).cast("bigint")), F.lit(0)).alias("n_duplicate"),
        F.coalesce(F.sum((F.col("no_score") > 0).cast("bigint")), F.lit(0)).alias("n_score_missing"),
    )
    return found.withColumn("complete", (F.col("n_missing") + F.col("n_unexpected") + F.col("n_duplicate") + F.col("n_score_missing")) == 0)


def turn_continuity(turns: DataFrame, session: str, turn: str) -> DataFrame:
    """Turns of each session that do not follow on the one before."""
    before = F.lag(turn).over(Window.partitionBy(session).orderBy(turn))
    return turns.withColumn("expected", before + 1).where(F.col("expected").isNotNull() & (F.col(turn) != F.col("expected"))).select(session, turn, "expected")


def min_max(score: Column, low: Column, high: Column) -> Column:
    """(score - low) / (high - low) within 0 and 1; 0 if the range is empty."""
    return F.when(high > low, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score - low) / (high - low)))).otherwise(0.0)


def value_distribution(rows: DataFrame, column: str) -> DataFrame:
    """Counts of each value and the whole percents of all rows."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("__total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("percent", F.floor(F.col("n") * 100 / F.col("__total")).cast("int")).drop("__total")  # one row


def cache_evidence(items: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """What providers say of their caches, of items (keys, status, available_calls, hit_calls, cached_tokens, input_tokens); only status "available" counts in sums."""
    total = lambda c: F.coalesce(F.sum(F.when(F.col("status") == "available", F.col(c))), F.lit(0)).alias(c)
    known = F.coalesce("status", F.lit("unsupported"))
    sums = items.groupBy(*keys).agg(F.count("*").alias("item_count"), *map(total, ("available_calls", "hit_calls", "cached_tokens", "input_tokens")), F.coalesce(F.bool_or(known == "unavailable"), F.lit(False)).alias("__off"))
    ratio = lambda a, b: F.when(F.col(b) != 0, F.round(F.col(a) / F.col(b), 4))
    status = F.when(F.col("available_calls") != 0, "available").when(F.col("__off"), "unavailable").otherwise("unsupported")
    return sums.select(*keys, status.alias("status"), "item_count", "available_calls", "hit_calls", ratio("hit_calls", "available_calls").alias("hit_rate"), "cached_tokens", "input_tokens", ratio("cached_tokens", "input_tokens").alias("cached_ratio"))


def budget_evidence(items: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """How often items (keys, over_soft, over_hard, compressed, peak_tokens) went beyond budgets, and their peaks; a null peak is 0."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    peak = F.coalesce("peak_tokens", F.lit(0))
    sums = items.groupBy(*keys).agg(F.count("*").alias("total_items"), n("over_soft").alias("over_soft"), n("over_hard").alias("over_hard"), n("compressed").alias("compressed"), F.max(peak).alias("max_peak"), F.sum(peak).alias("__sum"))
    whole = F.when(F.col("total_items") > 0, F.bround(F.col("__sum") / F.col("total_items")).cast("bigint"))
    avoided = F.when(F.col("total_items") > 0, F.round(1 - F.col("over_hard") / F.col("total_items"), 4))
    return sums.select(*keys, "total_items", "over_soft", "over_hard", "compressed", avoided.alias("overflow_avoidance"), F.coalesce("max_peak", F.lit(0)).alias("max_peak"), F.coalesce(whole, F.lit(0)).alias("avg_peak"))
