"""Agents, buckets, indices and messages of a catalogue: lookups, counts, listings and checks of asked ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_current_version(drafts: DataFrame, versions: DataFrame) -> DataFrame:
    """drafts (agent_id, tenant_id, current_version_no, ...) with version_name and create_time of their current version, null if it is deleted or missing."""
    live = versions.where("delete_flag = 'N'").select("agent_id", "tenant_id", F.col("version_no").alias("current_version_no"), "version_name", "create_time")
    return drafts.join(live, ["agent_id", "tenant_id", "current_version_no"], "left")


def totals_of(rows: DataFrame, wanted: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """(key, name): the sum of value over all rows of each wanted key that has any, 0 where all are null."""
    return rows.join(wanted.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.coalesce(F.sum(value), F.lit(0)).alias(name))


def live_counts(rows: DataFrame, key: str, name: str = "n") -> DataFrame:
    """(key, name): how many rows with an id that are not deleted each key has."""
    return rows.where("delete_flag = 'N'").groupBy(key).agg(F.count("id").alias(name))


def enriched(hits: DataFrame, rows: DataFrame, hit_key: str, key: str, columns: Sequence[str]) -> DataFrame:
    """hits with columns of the row whose id their text key stands for; a key that is no number finds none. rows: one a key."""
    found = rows.select(F.col(key).cast("bigint").alias("__key"), *columns)
    return hits.withColumn("__key", F.trim(hit_key).try_cast("bigint")).join(found, "__key", "left").drop("__key")


def combined_facets(first: DataFrame, second: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(facet, value): the values of each column in either listing, once; nulls and blanks are none."""
    both = first.select(*columns).unionByName(second.select(*columns))
    values = both.select(F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns))).alias("f")).select("f.*")
    return values.where("trim(value) <> ''").distinct()


def subset_faults(wanted: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """(key, fault): asked ids that are asked twice (duplicate) or that no item has (unresolved); ids compare as texts."""
    asked = wanted.select(F.col(key).cast("string").alias(key)).groupBy(key).agg(F.count("*").alias("n"))
    known = items.select(F.col(key).cast("string").alias(key)).distinct().withColumn("known", F.lit(True))
    fault = F.when(F.col("n") > 1, "duplicate").when(F.col("known").isNull(), "unresolved")
    return asked.join(known, key, "left").select(key, fault.alias("fault")).where("fault IS NOT NULL")


def item_subset(items: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The items whose id is asked; raises if one is asked twice or not found (see `subset_faults`)."""
    faults = subset_faults(wanted, items, key).orderBy("fault", key).limit(11).collect()
    if faults:
        raise ValueError("ids asked twice or not found: " + ", ".join(f"{r[key]} ({r['fault']})" for r in faults[:10]) + (" and more" if len(faults) > 10 else ""))
    return items.join(wanted.select(F.col(key).cast("string").alias("__key")).distinct(), F.col(key).cast("string") == F.col("__key"), "left_semi")


def grouped_units(units: DataFrame, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(message_id, step_index, units): the units of each step of a message in order; a missing number is 0."""
    of = [F.coalesce(c, F.lit(0)).alias(c) for c in ("message_id", "step_index")]
    fields = [*order, *(c for c in columns if c not in order)]
    listed = F.array_sort(F.collect_list(F.struct(*fields)))
    return units.select(*of, *fields).groupBy("message_id", "step_index").agg(F.transform(listed, lambda u: F.struct(*(u[c].alias(c) for c in columns))).alias("units"))


def gated(evidence: DataFrame, keep: Column, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Evidence that the gate lets through, with its rank per key: what fails, or is null, takes no place."""
    return evidence.where(F.coalesce(keep, F.lit(False))).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
