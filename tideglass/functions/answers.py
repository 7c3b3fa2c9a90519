"""Answers and search terms as Column expressions: choice mapping, keyword checks, comparisons, final answers, seeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideglass.functions import text as T

#: Words and CJK runs of searches, how many seeds a question gives, what marks a final answer,
#: currency signs, units, and the longest concise answer.
SEARCH_WORD = r"([A-Za-z0-9_]+)"
SEED_WORD = r"([A-Za-z][A-Za-z0-9-]+)"
CJK_RUN = r"([\x{4E00}-\x{9FFF}]+)"
MOST_SEEDS = 12
FINAL_ANSWER = r"(?is)FINAL\s*ANSWER\s*:\s*"
STATED_FINAL = r"(?is)The\s*(?:final\s*)?answer\s+is\s*:?\s*"
CURRENCY = r"^[\$€£¥₹]"
UNITS = r"(?i)\b\s*(km|mi|miles?|hours?|hrs?|minutes?|mins?|seconds?|secs?|kg|lbs?|pounds?|grams?|g|mg|ml|oz|liters?|L|gal|km/h|mph|m/s|ft|cm|mm|m|°[CF]|%|percent)\s*[.,]?\s*$"
NO_RESPONSE = "(No response received)"
MOST_CONCISE = 300
#: Patterns of concept tags in English and Chinese, and of the words that become tags.
CONCEPTS = {
    "preference": (r"\b(prefer|preference|always use|likes?)\b", "(偏好|喜欢|习惯|总是使用)"),
    "persistent": (r"\b(always|persist|long[- ]term|stable)\b", "(长期|稳定|持续|固定)"),
    "build": (r"\b(build|compile|deploy|package)\b", "(构建|编译|部署|打包)"),
    "failure": (r"\b(error|failure|failed|exception|bug)\b", "(错误|失败|异常|故障)"),
    "transaction": (r"\b(transaction|commit|rollback|atomic)\b", "(事务|提交|回滚|原子)"),
    "routing": (r"\b(route|routing|gateway|proxy)\b", "(路由|网关|代理)"),
}
TAG_WORD = r"([\x{4E00}-\x{9FFF}]{2,8}|[a-z][a-z0-9_-]{2,})"
MOST_TAGS = 8
#: Words of claims that speak against or for something; against wins.
AGAINST = ("禁忌", "停用", "禁用", "不可", "不宜", "不应", "避免", "不推荐", "慎用", "禁止", "不得", "严禁", "不建议", "停药", "暂停")
FOR = ("首选", "推荐", "适用", "一线", "可作为", "可用", "应用", "获益", "有效", "建议", "采用", "治疗", "使用")


def search_terms(text: Column) -> Column:
    """Distinct lower-cased words, and characters and pairs of characters of CJK runs, in order."""
    words = F.transform(F.regexp_extract_all(text, F.lit(SEARCH_WORD), F.lit(1)), lambda w: F.lower(w))
    runs = F.regexp_extract_all(text, F.lit(CJK_RUN), F.lit(1))
    pieces = lambda run: F.flatten(F.transform(F.sequence(F.lit(1), F.length(run)), lambda i: F.when(i < F.length(run), F.array(F.substr(run, i, F.lit(1)), F.substr(run, i, F.lit(2)))).otherwise(F.array(F.substr(run, i, F.lit(1))))))
    return F.array_distinct(F.concat(words, F.flatten(F.transform(runs, pieces))))


def seed_terms(question: Column, most: int = MOST_SEEDS) -> Column:
    """Words, and CJK runs of two characters or more, those over six also as windows of three in steps of two; the first `most` distinct ones."""
    question = F.coalesce(question, F.lit(""))
    words = F.regexp_extract_all(question, F.lit(SEED_WORD), F.lit(1))
    runs = F.filter(F.regexp_extract_all(question, F.lit(CJK_RUN), F.lit(1)), lambda r: F.length(r) >= 2)
    windows = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 2, F.lit(2)), lambda i: F.substr(r, i, F.lit(3)))
    pieces = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) > 6, F.concat(F.array(r), windows(r))).otherwise(F.array(r))))
    return F.slice(F.array_distinct(F.concat(words, pieces)), 1, most)


def concept_tags(content: Column) -> Column:
    """Tags of concepts that the content speaks of, filled up with its words to eight."""
    flat = F.lower(F.trim(F.regexp_replace(content, r"\s+", " ")))
    found = F.array(*(F.when(reduce(lambda a, b: a | b, [flat.rlike(f"(?i){p}") for p in patterns]), tag) for tag, patterns in CONCEPTS.items()))
    words = F.regexp_extract_all(flat, F.lit(TAG_WORD), F.lit(1))
    return F.slice(F.array_distinct(F.concat(F.array_compact(found), words)), 1, MOST_TAGS)


def choice(answer: Column, options: Column) -> tuple[Column, Column]:
    """(index from 0, how): the option that the answer equals, else the longest that contains it or lies in it, else that of the highest token F1; -1 and none."""
    answer = T.squad_normalize(F.coalesce(answer, F.lit("")))
    normal = F.transform(options, lambda o: T.squad_normalize(o))
    rank = F.transform(
        normal,
        lambda o, i: F.struct(
            F.when((o != "") & (o == answer), 3).when((o != "") & (F.contains(answer, o) | F.contains(o, answer)), 2).otherwise(1).alias("tier"),
            F.when(o == answer, 0.0).when((o != "") & (F.contains(answer, o) | F.contains(o, answer)), F.length(o).cast("double")).otherwise(T.f1(_words(answer), _words(o))).alias("weight"),
            (-i).alias("at"),
        ),
    )
    best = F.array_max(rank)
    none = (answer == "") | (F.size(options) == 0) | ((best["tier"] == 1) & (best["weight"] <= 0))
    how = F.when(none, "none").when(best["tier"] == 3, "exact").when(best["tier"] == 2, "containment").otherwise("fuzzy")
    return F.when(none, -1).otherwise(-best["at"]), how


def _words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def keyword_score(text: Column, every: Column, some: Column) -> tuple[Column, Column]:
    """(score, passed): the mean of the share of `every` that the text contains and of whether it has one of `some`; a null list is no check."""
    found = lambda words: F.size(F.filter(words, lambda w: F.contains(F.lower(text), F.lower(w))))
    first = F.when(F.size(every) == 0, 1.0).otherwise(found(every) / F.size(every))
    second = F.when(found(some) > 0, 1.0).otherwise(0.0)
    score = F.when(every.isNull() & some.isNull(), 1.0).when(every.isNull(), second).when(some.isNull(), first).otherwise((first + second) / 2)
    passed = (every.isNull() | (found(every) == F.size(every))) & (some.isNull() | (found(some) > 0))
    return score, passed


def number(text: Column) -> Column:
    """The value of a number with currency, unit, thousands or as a fraction; null if it is none."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), CURRENCY, ""), UNITS, ""))
    bare = F.regexp_replace(bare, r"(\d),(\d{3})", "$1$2")
    fraction = F.when(bare.rlike(r"^\d+\s*/\s*\d+$"), F.split(bare, "/"))
    divided = F.try_divide(F.trim(fraction[0]).try_cast("double"), F.trim(fraction[1]).try_cast("double"))
    return F.when(fraction.isNotNull(), divided).otherwise(F.when(bare.rlike(r"(?i)^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"), bare.try_cast("double")))


def same_number(a: Column, b: Column) -> Column:
    x, y = number(a), number(b)
    return F.coalesce((x == y) | F.when(y == 0, F.abs(x) < 1e-9).otherwise(F.abs(x - y) / F.greatest(F.abs(y), F.lit(1e-9)) < 1e-9), F.lit(False))


def plain_answer(text: Column) -> Column:
    """Lower case, single spaces, straight quotes and dashes, no full stop at the end."""
    flat = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    flat = F.translate(flat, "‘’“”–—", "''\"\"--")
    return F.when(F.endswith(flat, F.lit(".")), F.rtrim(F.substring(flat, 1, 2**31 - 1).substr(F.lit(1), F.length(flat) - 1))).otherwise(flat)


def same_answer(answer: Column, gold: Column) -> Column:
    """Numbers by value, lists item by item where the sizes agree, all else as plain text."""
    answer, gold = F.trim(answer), F.trim(gold)
    items = lambda t: F.filter(F.transform(F.split(t, ","), lambda x: F.trim(x)), lambda x: x != "")
    a, g = items(answer), items(gold)
    numeric = F.forall(g, lambda x: number(x).isNotNull())
    each = F.forall(F.arrays_zip(a.alias("a"), g.alias("g")), lambda p: F.when(numeric, same_number(p["a"], p["g"])).otherwise(plain_answer(p["a"]) == plain_answer(p["g"])))
    return (
        F.when((answer == "") | (gold == ""), answer == gold)
        .when(number(answer).isNotNull() & number(gold).isNotNull(), same_number(answer, gold))
        .when(F.contains(gold, F.lit(",")) & (F.size(a) == F.size(g)), each)
        .otherwise(plain_answer(answer) == plain_answer(gold))
    )


def final_answer(text: Column) -> Column:
    """What follows the last FINAL ANSWER: (else the last "the answer is"), without emphasis or code marks; else the whole text."""
    text = F.trim(F.coalesce(text, F.lit("")))
    after = lambda mark: F.element_at(F.split(text, mark), -1)
    marks = r"^(?:`{1,3}|[_*]{1,3})\s*|\s*(?:`{1,3}|[_*]{1,3})$"
    clean = lambda t: F.trim(F.regexp_replace(F.trim(t), marks, ""))
    return F.when(text.rlike(FINAL_ANSWER), clean(after(FINAL_ANSWER))).when(text.rlike(STATED_FINAL), clean(after(STATED_FINAL))).otherwise(text)


def answer_format(text: Column) -> tuple[Column, Column]:
    """(present, valid): whether there is a final answer, and whether it is one line, short, and marked once."""
    found = final_answer(text)
    present = (found != "") & (found != NO_RESPONSE)
    return present, present & ~F.contains(found, F.lit("\n")) & (F.length(found) <= MOST_CONCISE) & (F.size(F.split(F.coalesce(text, F.lit("")), FINAL_ANSWER)) == 2)


def polarity(claim: Column, rel_type: Column, vocabulary: dict[str, str]) -> Column:
    """neg or pos by the words of the claim (neg wins), else by the relation's entry, else neutral."""
    claim = F.coalesce(claim, F.lit(""))
    any_of = lambda words: reduce(lambda a, b: a | b, [F.contains(claim, F.lit(w)) for w in words])
    known = F.create_map(*(F.lit(x) for pair in vocabulary.items() for x in pair))[F.lower(F.trim(F.coalesce(rel_type, F.lit(""))))] if vocabulary else F.lit(None)
    return F.when(any_of(AGAINST), "neg").when(any_of(FOR), "pos").otherwise(F.coalesce(known, F.lit("neutral")))


def score_level(rate: Column) -> Column:
    return F.when(rate >= 0.8, "excellent").when(rate >= 0.5, "good").otherwise("needs_improvement")


def quality_level(top: Column, total: Column) -> Column:
    return F.when(top >= total * 0.7, "high").when(top >= total * 0.4, "medium").otherwise("low")


def next_version(base: Column, deprecates: Column) -> Column:
    """The next major version if something is deprecated, else the next minor; v1.0.0 to begin with."""
    part = lambda k: F.regexp_extract(base, r"^v(\d+)\.(\d+)\.(\d+)", k).cast("int")
    known = F.coalesce(base.rlike(r"^v\d+\.\d+\.\d+"), F.lit(False))
    return F.when(~known, "v1.0.0").when(deprecates, F.concat(F.lit("v"), (part(1) + 1).cast("string"), F.lit(".0.0"))).otherwise(F.concat(F.lit("v"), part(1).cast("string"), F.lit("."), (part(2) + 1).cast("string"), F.lit(".0")))


def resource_id(*parts: Column) -> Column:
    """A url-safe id of a JSON list of strings, without padding."""
    return F.rtrim(F.translate(F.base64(F.to_json(F.array(*parts)).cast("binary")), "+/\r\n", "-_"), F.lit("="))


def resource_parts(coded: Column) -> Column:
    padded = F.rpad(F.translate(coded, "-_", "+/"), (F.ceil(F.length(coded) / 4) * 4).cast("int"), F.lit("="))
    return F.from_json(F.unbase64(padded).cast("string"), "array<string>")
