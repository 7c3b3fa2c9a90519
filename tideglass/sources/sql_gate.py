"""Queries from outside: only a single SELECT runs, with named parameters and a limit."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FIRST = r"(?is)^\s*(select|with|values|table|from)\b"
_WRITES = r"(?is)\b(insert|update|delete|merge|drop|create|alter|truncate|grant|revoke|refresh|cache|uncache|set|use|load|msck|analyze|call|exec|execute)\b"


def _bare(sql: str) -> str:
    """Without comments and quoted parts."""
    return re.sub(r"(?s)'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", " ", sql)


def reason_to_deny(sql: str) -> str | None:
    bare = _bare(sql).strip().rstrip(";")
    if not re.match(_FIRST, bare):
        return "not a query"
    if ";" in bare:
        return "several statements"
    if re.search(_WRITES, bare):
        return "changes data or settings"
    return None


def run(spark: SparkSession, sql: str, args: dict | None = None, max_rows: int = 100) -> DataFrame:
    """The first max_rows rows of a query (that limit is the feature); ValueError if it is not one."""
    if why := reason_to_deny(sql):
        raise ValueError(why)
    return spark.sql(sql, args=args or {}).limit(max_rows)


def gate(sql: Column) -> Column:
    """allow or deny of a column of statements, by the same patterns."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(sql, r"(?s)'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", " ")), ";$", "")
    return F.when(bare.rlike(_FIRST) & ~F.contains(bare, F.lit(";")) & ~bare.rlike(_WRITES), "allow").otherwise("deny")
