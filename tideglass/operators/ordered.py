"""Global order without a single task: places and running sums over range partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a partition are numbered in the low bits of Spark's increasing ids, partitions in the high ones.
_ROW_BITS = 33


def in_order(rows: DataFrame, order: Sequence, sums: Sequence[str] = (), place: str = "place") -> DataFrame:
    """rows with their place (from 1) in this order and, for each of sums, `<name>_upto`: its sum up to and with the row.

    Rows are range-partitioned by the order and sorted within partitions; only one row a partition goes through
    an unpartitioned window, to give each partition the count and sums of those before. order should be total.
    """
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = sorted_rows.withColumn("__id", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("__id", _ROW_BITS)
    numbered = numbered.withColumn("__part", part).withColumn("__row", F.col("__id").bitwiseAND((1 << _ROW_BITS) - 1))
    before = Window.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    sizes = numbered.groupBy(F.col("__part").alias("__of")).agg(F.count("*").alias("__n"), *(F.sum(c).alias(f"__sum_{c}") for c in sums))
    none = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    starts = sizes.select("__of", none("__n").alias("__start"), *(none(f"__sum_{c}").alias(f"__{c}") for c in sums))
    out = numbered.join(starts, F.col("__part") == F.col("__of")).withColumn(place, F.col("__start") + F.col("__row") + 1)
    within = Window.partitionBy("__part").orderBy("__row").rowsBetween(Window.unboundedPreceding, 0)
    for c in sums:
        out = out.withColumn(f"{c}_upto", F.col(f"__{c}") + F.sum(c).over(within))
    return out.select(*rows.columns, place, *(f"{c}_upto" for c in sums))


def in_order_by(rows: DataFrame, keys: Sequence[str], order: Sequence, sums: Sequence[str] = (), place: str = "place") -> DataFrame:
    """in_order with places and sums that begin anew in each key (a null is one); a key may hold most rows."""
    out = in_order(rows, [*keys, *order], sums, place)
    first = out.groupBy(*(F.col(k).alias(f"__of_{k}") for k in keys)).agg(F.min(place).alias("__first"), *(F.min_by(F.col(f"{c}_upto") - F.coalesce(c, F.lit(0)), place).alias(f"__from_{c}") for c in sums))
    both = out.join(first, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys])
    return both.select(*rows.columns, (F.col(place) - F.col("__first") + 1).alias(place), *((F.col(f"{c}_upto") - F.col(f"__from_{c}")).alias(f"{c}_upto") for c in sums))
