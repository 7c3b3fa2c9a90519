"""Answer and term functions on small cases."""

import pytest
from pyspark.sql import functions as F

from tideglass.functions import answers as A


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def words(*items):
    return F.array(*map(F.lit, items)).cast("array<string>")


@pytest.mark.parametrize(
    ("answer", "index", "how"),
    [("The red car", 1, "exact"), ("it was the red car indeed", 1, "containment"), ("a very blue thing", 2, "fuzzy"), ("", -1, "none"), ("zzz", -1, "none"), ("red", 1, "containment")],
)
def test_choice(spark, answer, index, how):
    got = A.choice(F.lit(answer), words("green", "red car", "blue house", "red"))
    assert (value(spark, got[0]), value(spark, got[1])) == (index if answer != "red" else 3, how if answer != "red" else "exact")


@pytest.mark.parametrize(
    ("answer", "gold", "same"),
    [("$1,234.50", "1234.5", True), ("3/4", "0.75", True), ("12 km", "12", True), ("a, b", "A,B", True), ("a, b", "b, a", False), ("1, 2", "1.0,2", True), ("Sea gull.", "sea  gull", True), ("seagull", "sea gull", False), ("", "x", False), ("“it’s”", "\"it's\"", True), ("1/0", "1/0", True), ("50%", "50", True)],
)
def test_same_answer(spark, answer, gold, same):
    assert value(spark, A.same_answer(F.lit(answer), F.lit(gold))) is same


@pytest.mark.parametrize(
    ("text", "found"), [("so FINAL ANSWER: 1\nno, final answer: **42**", "42"), ("The answer is: `x y`", "x y"), (" plain ", "plain"), ("**FINAL ANSWER:** 7", "7"), (None, "")]
)
def test_final_answer(spark, text, found):
    assert value(spark, A.final_answer(F.lit(text).cast("string"))) == found


def test_answer_format(spark):
    of = lambda t: tuple(value(spark, c) for c in A.answer_format(F.lit(t)))
    assert of("FINAL ANSWER: 1") == (True, True) and of("1") == (True, False) and of("") == (False, False) and of("FINAL ANSWER: a\nb") == (True, False)


def test_keyword_score(spark):
    of = lambda e, s: tuple(value(spark, c) for c in A.keyword_score(F.lit("Alpha beta"), e, s))
    none = F.lit(None).cast("array<string>")
    assert of(words("ALPHA", "x"), none) == (0.5, False) and of(words("alpha"), words("y")) == (0.5, False) and of(none, words("beta", "z")) == (1.0, True) and of(none, none) == (1.0, True)


def test_terms(spark):
    assert value(spark, A.search_terms(F.lit("Ab ab 中文字 x_1"))) == ["ab", "x_1", "中", "中文", "文", "文字", "字"]
    assert value(spark, A.seed_terms(F.lit("X ab-1 一二三四五六七八 二"))) == ["ab-1", "一二三四五六七八", "一二三", "三四五", "五六七"]
    assert value(spark, A.concept_tags(F.lit("I Prefer\nstable  builds, 部署"))) == ["preference", "persistent", "build", "prefer", "stable", "builds", "部署"]


def test_codes(spark):
    parts = words("a/b", "ключ?", "3")
    coded = value(spark, A.resource_id(F.lit("a/b"), F.lit("ключ?"), F.lit("3")))
    assert not set(coded) & set("+/=") and value(spark, A.resource_parts(F.lit(coded))) == value(spark, parts)
    assert [value(spark, A.next_version(F.lit(v).cast("string"), F.lit(d))) for v, d in ((None, False), ("v1.2.3", False), ("v1.2.3", True), ("x", True))] == ["v1.0.0", "v1.3.0", "v2.0.0", "v1.0.0"]
    assert [value(spark, A.polarity(F.lit(c).cast("string"), F.lit(r), {"treats": "pos"})) for c, r in (("推荐但禁用", "x"), ("推荐", "x"), ("", " Treats"), (None, "x"))] == ["neg", "pos", "pos", "neutral"]
