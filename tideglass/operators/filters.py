"""Row filters of a multi-tenant store: isolation, soft deletion, optional conditions, validity, visibility, time ranges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideglass.operators.rounds import settled

#: Hours of the named ranges; what an unknown name means; the score that a hit needs; the state of a parsed asset.
RANGE_HOURS = {"24h": 24, "7d": 7 * 24, "30d": 30 * 24}
DEFAULT_RANGE = "24h"
LEAST_SCORE = 0.65
PARSED = "parsed"


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def isolated(rows: DataFrame, **owner) -> DataFrame:
    """Rows of exactly this owner (tenant_id=..., user_id=...)."""
    return rows.where(_all([F.col(c) == v for c, v in owner.items()]))


def not_deleted(rows: DataFrame, flag: str = "delete_flag") -> DataFrame:
    return rows.where(F.col(flag) == "N")


def optional(rows: DataFrame, wanted: Mapping[str, object], default: Mapping[str, object] | None = None) -> DataFrame:
    """Rows with the wanted values. None or "" asks for nothing; a column that wanted lacks takes its default; "" there means all."""
    wanted = {**(default or {}), **wanted}
    return rows.where(_all([F.col(c) == v for c, v in wanted.items() if v is not None and v != ""]))


def contains_pattern(column: str, pattern: str) -> Column:
    """Case-insensitive containment where % and _ of the pattern stay wildcards."""
    return F.col(column).ilike(f"%{pattern}%")


def json_contains(column: str, path: str, needle: str) -> Column:
    return F.get_json_object(column, path).ilike("%" + needle.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_") + "%")


def score_at_least(rows: DataFrame, score: str = "score", least: float = LEAST_SCORE) -> DataFrame:
    return rows.where(F.col(score) >= least)


def assets(hits: DataFrame, modality: str | None = None, doc_type: str | None = None, least_authority: int | None = None, superseded: bool = False) -> DataFrame:
    """Parsed assets of this kind with this authority level at least; those another version has replaced only on demand."""
    tests = [F.col("parse_status") == PARSED]
    tests += [F.col(c) == v for c, v in (("modality", modality), ("doc_type", doc_type)) if v is not None]
    tests += [F.col("authority_level") >= least_authority] if least_authority is not None else []
    tests += [] if superseded else [~F.col("superseded")]
    return hits.where(_all(tests))


def allowed(rows: DataFrame, lists: Mapping[str, DataFrame]) -> DataFrame:
    """Rows whose columns are in the allow lists (one-column tables); a missing list allows all."""
    for column, values in lists.items():
        rows = rows.join(values.select(F.col(values.columns[0]).alias("__allowed")), F.col(column) == F.col("__allowed"), "left_semi")
    return rows


def within_days(at: Column, now: Column, days: int) -> Column:
    return at >= now - F.make_dt_interval(F.lit(days))


def in_range(at: Column, now: Column, name: str | None) -> Column:
    """Inside the named range before now; an unknown name is 24h."""
    return at >= now - F.make_dt_interval(F.lit(0), F.lit(RANGE_HOURS.get(name or "", RANGE_HOURS[DEFAULT_RANGE])))


def fields(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """The allowed columns that rows has, in the order of names."""
    return rows.select(*(c for c in names if c in rows.columns))


def visible_to(rows: DataFrame, user: str, groups: Sequence[str], owner: str = "created_by", group_ids: str = "group_ids") -> DataFrame:
    """Rows that the user made, that name no group, or that share a group (comma-separated) with the user."""
    named = F.transform(F.split(F.coalesce(group_ids, F.lit("")), ","), lambda g: F.trim(g))
    return rows.where((F.col(owner) == user) | (F.trim(F.coalesce(group_ids, F.lit(""))) == "") | F.arrays_overlap(named, F.array(*map(F.lit, groups)).cast("array<string>")))


def valid_paths(steps: DataFrame, at: Column, path: str = "path_id") -> DataFrame:
    """(path): the paths of which every edge is valid at a time; steps: path, valid_at, invalid_at; a step without an edge has no valid_at."""
    valid = F.coalesce((F.col("valid_at") <= at) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > at)), F.lit(False))
    return steps.groupBy(path).agg(F.bool_and(valid).alias("__ok")).where("__ok").select(path)


def version_clock(explicit: Column, fact_cutoff: Column, created_at: Column, now: Column) -> tuple[Column, Column]:
    """(time, source): the most specific time that a version is pinned to."""
    source = F.when(explicit.isNotNull(), "explicit").when(fact_cutoff.isNotNull(), "fact_cutoff").when(created_at.isNotNull(), "version_created_at").otherwise("now")
    return F.coalesce(explicit, fact_cutoff, created_at, now), source


def all_terms(postings: DataFrame, terms: DataFrame, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """(query, doc): documents that hold every distinct term of a query; postings: doc, term; terms: query, term. A query with a null term finds nothing.

    Queries and documents with equal sets of (asked) terms are one class. Classes meet by the query's rarest term, and the whole
    sets decide, so that nothing is counted for each pair and only pairs that hold are expanded.
    """
    none = F.count_if(F.col("term").isNull()) == 0
    asked = settled(terms.select(query, "term").distinct().groupBy(query).agg(F.sort_array(F.collect_list("term")).alias("__asked"), none.alias("__ok")).where("__ok").drop("__ok"))
    every = asked.select(F.explode("__asked").alias("term")).distinct()
    held = settled(postings.select(doc, "term").join(every, "term", "left_semi").distinct().groupBy(doc).agg(F.sort_array(F.collect_list("term")).alias("__held")))
    want, have = asked.select("__asked").distinct(), held.select("__held").distinct()
    of_terms = have.select("__held", F.explode("__held").alias("term"))
    df = of_terms.groupBy("term").agg(F.count("*").alias("n"))
    rarest = want.select("__asked", F.explode("__asked").alias("term")).join(df, "term").groupBy("__asked").agg(F.min(F.struct("n", "term")).alias("least")).select("__asked", F.col("least.term").alias("term"))
    both = rarest.join(of_terms, "term").where(F.size(F.array_intersect("__asked", "__held")) == F.size("__asked")).select("__asked", "__held")
    return both.join(held, "__held").join(asked, "__asked").select(query, doc)


def ignited(lists: DataFrame, key: str, route: str, least: int = 2) -> DataFrame:
    """The rows of keys for which at least so many routes found something."""
    fired = lists.groupBy(key).agg(F.countDistinct(route).alias("__routes")).where(F.col("__routes") >= least).select(key)
    return lists.join(fired, key, "left_semi")


def top_by(rows: DataFrame, keys: Sequence[str], order: Sequence, n: int, place: str = "place") -> DataFrame:
    """The first n of each key in this order; 0 gives none."""
    return rows.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(place) <= n)


def source_top(units: DataFrame, excluded: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Promoted units (memory_id, promote, score, signal_count) that are not excluded (memory_id), the n best of each key."""
    left = units.where("promote").join(excluded.select("memory_id").distinct(), "memory_id", "left_anti")
    return top_by(left, keys, [F.desc("score"), F.desc("signal_count"), "memory_id"], n)


def entity_lookup(entities: DataFrame, queries: DataFrame, ranked: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, id, tier, place): ranked hits first (query_id, id, rank), then names that contain the query in any case, then aliases that contain it as it is.

    entities: id, name, aliases. Distinct texts of queries
    meet names and aliases by their rarest gram (see contains_pairs), and each hands on its first 2k alone.
    """
    from tideglass.operators.matching import contains_pairs

    asked = queries.select("query_id", F.trim("query").alias("q")).where("q <> ''")
    words = asked.select("q").distinct()
    named = contains_pairs(entities.select("id", F.lower("name").alias("text")), words.select(F.col("q").alias("needle_id"), F.lower("q").alias("needle")))
    other = entities.select("id", F.explode("aliases").alias("text")).distinct().select(F.struct("id", "text").alias("id"), "text")
    other = contains_pairs(other, words.select(F.col("q").alias("needle_id"), F.col("q").alias("needle"))).select("id.id", "needle_id")
    found = named.select(F.col("needle_id").alias("q"), "id", F.lit(2).alias("tier")).unionByName(other.select(F.col("needle_id").alias("q"), "id", F.lit(3).alias("tier")))
    # with fewer than k ranked ids, 2k of a text's finds leave k new ones; with more, none is needed
    found = top_by(found.groupBy("q", "id").agg(F.min("tier").alias("tier")), ["q"], ["tier", "id"], 2 * k).join(asked, "q").select("query_id", "id", "tier", F.lit(0).alias("rank"))
    every = ranked.select("query_id", "id", F.lit(1).alias("tier"), "rank").unionByName(found)
    best = every.groupBy("query_id", "id").agg(F.min(F.struct("tier", "rank")).alias("b")).select("query_id", "id", "b.*")
    return top_by(best, ["query_id"], ["tier", "rank", "id"], k).select("query_id", "id", "tier", "place")
