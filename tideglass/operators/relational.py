"""Relational operators: metrics, tag filters, anti- and semi-joins, paging, ordered merges."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def model_metrics(calls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: calls, error rate in percent, mean duration, mean duration of streaming calls, tokens. calls: is_error, duration, is_streaming, tokens."""
    error = F.sum(F.col("is_error").cast("int")) * 100.0 / F.nullif(F.count("*"), F.lit(0))
    return calls.groupBy(*keys).agg(
        F.count("*").alias("n_calls"),
        F.round(error, 4).alias("error_rate"),
        F.round(F.avg("duration"), 4).alias("avg_duration"),
        F.round(F.avg(F.when(F.col("is_streaming"), F.col("duration"))), 4).alias("avg_streaming_duration"),
        F.sum("tokens").cast("bigint").alias("total_tokens"),
    )


def tag_division(assignments: DataFrame, wanted: dict[str, Sequence[str]], resource: str = "resource_id") -> DataFrame:
    """Resources with, for every wanted definition, one of its values (values are OR-ed, definitions AND-ed)."""
    hit = reduce(lambda a, b: a | b, [(F.col("definition") == d) & F.col("value").isin(list(v)) for d, v in wanted.items()], F.lit(False))
    counted = assignments.where(hit).groupBy(resource).agg(F.countDistinct("definition").alias("n"))
    return counted.where(F.col("n") == len(wanted)).select(resource)


def tag_filter_all(assignments: DataFrame, predicates: Sequence[tuple[str, str]], resource: str = "resource_id") -> DataFrame:
    """Resources that meet every predicate, also two on one definition."""
    wanted = reduce(lambda a, b: a | b, [(F.col("definition") == d) & (F.col("value") == v) for d, v in predicates], F.lit(False))
    pairs = len(set(predicates))
    counted = assignments.where(wanted).groupBy(resource).agg(F.countDistinct("definition", "value").alias("n"))
    return counted.where(F.col("n") == pairs).select(resource)


def not_superseded(rows: DataFrame, key: str, successor_of: str) -> DataFrame:
    """Rows that no row names as what it replaces."""
    newer = rows.where(F.col(successor_of).isNotNull()).select(F.col(successor_of).alias("__old")).distinct()
    return rows.join(newer, F.col(key) == F.col("__old"), "left_anti")


def semi_all(rows: DataFrame, keys: Sequence[str], filters: Sequence[DataFrame]) -> DataFrame:
    """Rows whose keys lie in every one of the filters (each with the key columns)."""
    return reduce(lambda a, f: a.join(f.select(*keys).distinct(), list(keys), "left_semi"), filters, rows)


def with_counts(rows: DataFrame, used: DataFrame, key: str, used_key: str, name: str = "n_used") -> DataFrame:
    """rows with how many rows of used refer to them (0 if none); used is counted before it is joined."""
    counts = used.groupBy(F.col(used_key).alias("__k")).agg(F.count("*").alias(name))
    return rows.join(counts, F.col(key) == F.col("__k"), "left").drop("__k").withColumn(name, F.coalesce(name, F.lit(0)).cast("bigint"))


def having_several(rows: DataFrame, keys: Sequence[str], value: str, least: int = 2) -> DataFrame:
    """Keys with at least `least` distinct values, and how many."""
    return rows.groupBy(*keys).agg(F.countDistinct(value).cast("bigint").alias("n_values")).where(F.col("n_values") >= least)


def tag_stats(rows: DataFrame, tags: str) -> DataFrame:
    """How many rows hold each tag of an array column, most frequent first."""
    return rows.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")


def keyset_page(rows: DataFrame, key: str, before: int | None, size: int) -> DataFrame:
    """A page of rows by descending key before a cursor, with the cursor of the next page (null on the last one)."""
    left = rows if before is None else rows.where(F.col(key) < before)
    page = left.orderBy(F.desc(key)).limit(size + 1).withColumn("__n", F.row_number().over(Window.orderBy(F.desc(key))))
    more = F.max("__n").over(Window.partitionBy()) > size
    cursor = F.min(F.when(F.col("__n") <= size, F.col(key))).over(Window.partitionBy())
    return page.withColumn("next_cursor", F.when(more, cursor)).where(F.col("__n") <= size).drop("__n")


def offset_page(rows: DataFrame, order: Sequence[Column | str], page: int, size: int) -> DataFrame:
    """Page (from 1) of the ordered rows, with the number of all rows and pages."""
    total = rows.agg(F.count("*").alias("total"), F.ceil(F.count("*") / F.lit(size)).alias("pages"))
    return rows.orderBy(*order).offset((page - 1) * size).limit(size).crossJoin(F.broadcast(total))  # total is one row


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key: keep-first dedup by an explicit order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def max_per_group(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max(value).alias(f"max_{value}"))


def merge_ordered(first: DataFrame, second: DataFrame, order: Sequence[Column | str], offset: int, size: int) -> DataFrame:
    """A page of two lists merged by an order; `origin` says which list a row is of."""
    both = first.withColumn("origin", F.lit("first")).unionByName(second.withColumn("origin", F.lit("second")))
    return both.orderBy(*order).offset(offset).limit(size)


def current_view(rows: DataFrame, at: Column, start: str = "valid_at", end: str = "invalid_at") -> DataFrame:
    """Rows valid at a time: start <= at, and end null or later."""
    return rows.where((F.col(start) <= at) & (F.col(end).isNull() | (F.col(end) > at)))


def contains_text(column: str, needle: str) -> Column:
    """Case-insensitive containment with % and _ taken as they are."""
    escaped = needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return F.col(column).ilike(f"%{escaped}%")


def random_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in an order that only seed and key decide."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def paired_outcomes(first: DataFrame, second: DataFrame, key: str, passed: str) -> DataFrame:
    """How often two runs of the same items agree: both, only one, neither, or an item is missing from one."""
    a, b = first.select(key, F.col(passed).alias("a")), second.select(key, F.col(passed).alias("b"))
    kind = F.when(F.col("a").isNull() | F.col("b").isNull(), "missing").when(F.col("a") & F.col("b"), "both").when(F.col("a"), "first_only").when(F.col("b"), "second_only").otherwise("neither")
    return a.join(b, key, "full").groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"))
