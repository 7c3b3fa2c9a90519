"""Canonical JSON: sorted keys, one spacing, characters as they are; and hashes of it."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: hex digits of a hash.
DIGITS = 16


def _dumped(text: str | None) -> str | None:
    try:
        return None if text is None else json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True)
    except ValueError:
        return None


def _canonical(texts: pd.Series) -> pd.Series:
    return texts.map(_dumped)


def canonical_json(text: Column) -> Column:
    """The JSON text with its objects' keys in order of code points, ", " and ": " between parts; null if it is none. Values nest without a bound, so this is a small helper for each row."""
    return F.pandas_udf(_canonical, "string")(text)


def canonical_hash(text: Column, digits: int = DIGITS) -> Column:
    """The first digits of the SHA-256 of the canonical text."""
    return F.substring(F.sha2(canonical_json(text), 256), 1, digits)


def testset_hash(text: Column) -> Column:
    """The hash of a test set (JSON): of its `questions`, of an empty list where it has none."""
    questions = F.get_json_object(text, "$.questions")
    nothing = questions.isNull() | questions.isin("", "{}", "0", "false", "null")
    return F.when(canonical_json(text).isNotNull(), canonical_hash(F.when(nothing, "[]").otherwise(questions)))
