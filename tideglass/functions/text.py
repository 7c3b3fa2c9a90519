"""Text scalars as Column expressions: normalizers, token counts, answer comparison, extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation; articles; bounds of the CJK block; what marks headings, lists and tables;
#: numbers, and how answers state them; what separates tokens.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = r"\b(a|an|the)\b"
CJK = r"\x{4E00}-\x{9FFF}"
HEADING = r"(?m)^#+\s|第[一二三四五六七八九十百]+[章节篇]|^\s*[\d一二三四五六七八九十]+[、.．]\s"
LIST_OR_TABLE = r"(?m)^[-*•]|\|\s*-{2,}\s*\|"
NUMBER = r"-?[\d,]+(?:\.\d+)?"
MARKED_ANSWER = r"####\s*([\d,]+(?:\.\d+)?)"
STATED_ANSWER = rf"(?i)answer\s*(?:is|=|:)\s*({NUMBER})"
CONCLUDED_ANSWER = rf"(?i)(?:so|therefore|thus)\s*,?\s*(?:the\s+)?(?:final\s+)?answer\s*(?:is|=|:)?\s*({NUMBER})"
TOKEN_BREAKS = r"""[\s,.:;!?()\[\]{}«»"'…—–-]+"""


def squad_normalize(text: Column, lower_case: bool = True) -> Column:
    """Answers for comparison: lower case, no punctuation, no articles, single spaces."""
    out = F.lower(text) if lower_case else text
    out = F.translate(out, PUNCTUATION, "")
    out = F.regexp_replace(out, ARTICLES, " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def _singular(words: Column) -> Column:
    """Words without a plural s (those over three letters that end in s but not in ss)."""
    plural = lambda w: (F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss")
    return F.transform(words, lambda w: F.when(plural(w), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))


def answer_tokens(text: Column, lower_case: bool = False) -> Column:
    return _singular(F.filter(F.split(squad_normalize(text, lower_case), " "), lambda w: w != ""))


def exact_match(prediction: Column, gold: Column) -> Column:
    """1.0 if the normalized answer equals one of the gold answers (array); two nulls match."""
    any_equal = F.exists(gold, lambda g: squad_normalize(g) == squad_normalize(prediction))
    return F.when(prediction.isNull() & gold.isNull(), 1.0).when(prediction.isNull() | gold.isNull(), 0.0).otherwise(any_equal.cast("double"))


def overlap(a: Column, b: Column) -> Column:
    """Size of the common multiset of two token arrays: both are sorted as one, and each run of a token counts its lesser side. Nulls are common to none."""
    tagged = F.sort_array(F.concat(F.transform(a, lambda w: F.struct(w.alias("w"), F.lit(0).alias("of"))), F.transform(b, lambda w: F.struct(w.alias("w"), F.lit(1).alias("of")))))
    run = lambda w, n_a, n_b, common: F.struct(w.alias("w"), n_a.alias("n_a"), n_b.alias("n_b"), common.alias("common"))

    def step(acc: Column, x: Column) -> Column:
        same = F.coalesce(acc["w"] == x["w"], F.lit(False))
        n_a, n_b = F.when(same, acc["n_a"]).otherwise(0), F.when(same, acc["n_b"]).otherwise(0)
        ended = F.when(same, 0).otherwise(F.least(acc["n_a"], acc["n_b"]))
        return run(x["w"], n_a + 1 - x["of"], n_b + x["of"], acc["common"] + ended)

    start = run(F.lit(None).cast("string"), F.lit(0), F.lit(0), F.lit(0))
    return F.aggregate(tagged, start, step, lambda acc: acc["common"] + F.least(acc["n_a"], acc["n_b"]))


def f1(a: Column, b: Column) -> Column:
    """Token F1 of two token arrays; 1 if both are empty."""
    common = overlap(a, b).cast("double")
    size = F.size(a) + F.size(b)
    return F.when(size == 0, 1.0).otherwise(2.0 * common / size)


def keyword_coverage(text: Column, keywords: Column) -> Column:
    """Share of keywords (array) that the text contains, case-insensitively, to four places."""
    found = F.filter(keywords, lambda k: F.contains(F.lower(text), F.lower(k)))
    return F.when(F.size(keywords) == 0, 0.0).otherwise(F.round(F.size(found) / F.size(keywords), 4))


def final_number(text: Column) -> Column:
    """The number after "####", else after "answer is", "=" or ":" (or "so, the answer"), else the last one; null without any."""
    marked, stated, hence = (F.regexp_extract(text, pattern, 1) for pattern in (MARKED_ANSWER, STATED_ANSWER, CONCLUDED_ANSWER))
    every = F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1))
    last = F.when(F.size(every) > 0, F.element_at(every, -1))
    found = F.coalesce(*(F.nullif(x, F.lit("")) for x in (marked, stated, hence)), last)
    return F.replace(found, F.lit(","), F.lit("")).try_cast("double")


def tokens_regex(text: Column) -> Column:
    """Twice the pieces between white space and punctuation."""
    return F.size(F.filter(F.split(text, TOKEN_BREAKS), lambda w: w != "")) * 2


def tokens_mixed(text: Column) -> Column:
    """max(1, other characters div 4 + CJK characters / 1.1, rounded down)."""
    cjk = F.length(F.regexp_replace(text, f"[^{CJK}]", ""))
    return F.greatest(F.lit(1), (F.floor((F.length(text) - cjk) / 4) + F.floor(cjk / 1.1)).cast("int"))


def tokens_half(text: Column) -> Column:
    """CJK characters and half of the others."""
    cjk = F.length(F.regexp_replace(text, f"[^{CJK}]", ""))
    return (cjk + F.floor((F.length(text) - cjk) / 2)).cast("int")


def search_tokens(text: Column) -> Column:
    """Lower-cased ASCII words and numbers, then the two-character windows of CJK runs."""
    ascii_words = F.transform(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9]+)"), F.lit(1)), F.lower)
    runs = F.regexp_extract_all(text, F.lit(f"([{CJK}]+)"), F.lit(1))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2))))))
    return F.concat(ascii_words, pairs)


def parse_quality(text: Column) -> Column:
    """Quality of a parse from 0 to 1: length (0.1, 0.2, 0.4), headings, lists or tables, and words among its first 500 characters (0.2 each)."""
    text = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""))
    length = F.when(F.length(text) >= 800, 0.4).when(F.length(text) >= 200, 0.2).otherwise(0.1)
    heading = text.rlike(HEADING)
    listed = text.rlike(LIST_OR_TABLE)
    sample = F.substring(text, 1, 500)
    dense = (F.length(F.regexp_replace(sample, f"[^{CJK}]", "")) >= 20) | (F.regexp_count(sample, F.lit(r"[A-Za-z]{2,}")) >= 15)
    score = length + sum((m.cast("double") * 0.2 for m in (listed, dense)), heading.cast("double") * 0.2)
    return F.when(text == "", 0.0).otherwise(F.round(F.least(F.lit(1.0), score), 2))


def _name_words(name: Column) -> Column:
    bare = F.trim(F.regexp_replace(name, f"[{CJK}]", ""))
    return F.filter(F.split(bare, r"[\s_-]+"), lambda w: w != "")


def camel_case(name: Column) -> Column:
    """Name of a class: its words (CJK left out) with a capital each."""
    return F.array_join(F.transform(_name_words(name), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "")


def snake_case(name: Column) -> Column:
    """Name of a property: its words in lower case, joined by _."""
    return F.array_join(F.transform(_name_words(name), F.lower), "_")


def literals(text: Column) -> Column:
    """URLs, mail addresses and UUIDs that a summary must keep, in order of kind."""
    kinds = [r"(https?://[^\s<>\"]+)", r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})", r"([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})"]
    return F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit(k), F.lit(1)) for k in kinds)))


def citations_ok(text: Column, n: Column) -> Column:
    """Whether a text cites ([1] ...) at all, and only numbers from 1 to n."""
    cited = F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda x: x.cast("bigint"))
    return (F.size(cited) > 0) & F.forall(cited, lambda x: (x >= 1) & (x <= n))


def verdict(reply: Column) -> Column:
    """yes, no or unknown of a judge's reply."""
    first = F.lower(F.regexp_extract(reply, r"^\W*(\w+)", 1))
    return F.when(first.isin("yes", "correct", "true"), "yes").when(first.isin("no", "incorrect", "false"), "no").otherwise("unknown")


def readable_size(n: Column) -> Column:
    """Bytes as 12 B, 3.4 KB, 5.6 MB or 7.8 GB."""
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for power, unit in ((1, "KB"), (2, "MB")):
        out = out.when(n < 1024 ** (power + 1), F.concat(F.call_function("format_number", n / float(1024**power), F.lit("0.0")), F.lit(f" {unit}")))
    return out.otherwise(F.concat(F.call_function("format_number", n / float(1024**3), F.lit("0.0")), F.lit(" GB")))


def published_at(title: Column) -> tuple[Column, Column]:
    """(date, rule): an explicit date, else a year and month, else a year in a title."""
    day = F.regexp_extract(title, r"(\d{4}-\d{2}-\d{2})", 1)
    month = F.regexp_extract(title, r"(\d{4}-\d{2})", 1)
    year = F.regexp_extract(title, r"((?:19|20)\d{2})", 1)
    rule = F.when(day != "", "date").when(month != "", "month").when(year != "", "year").otherwise("none")
    text = F.when(day != "", day).when(month != "", F.concat(month, F.lit("-01"))).when(year != "", F.concat(year, F.lit("-01-01")))
    return F.try_to_date(text), rule


def timestamp_of(value: Column) -> Column:
    """Unix seconds (under 1e10) or milliseconds as digits, or an ISO time, as a UTC timestamp; else null."""
    digits = value.rlike(r"^\d{1,17}$")
    number = F.when(digits, value).cast("bigint")
    return F.when(digits, F.timestamp_millis(F.when(number < 10_000_000_000, number * 1000).otherwise(number))).otherwise(F.try_to_timestamp(value))


def retry_delay(attempt: Column) -> Column:
    """Seconds until a retry: 30 doubled each time, 900 at most."""
    return F.least(F.lit(900), (F.lit(30) * F.pow(F.lit(2), F.least(attempt, F.lit(10)) - 1)).cast("int"))


def task_state(process: Column, forward: Column) -> Column:
    """One state of a two-step task from the states (PENDING, STARTED, SUCCESS, FAILURE, null) of its steps."""
    by_process = F.when(process == "STARTED", "PROCESSING").when(process == "SUCCESS", "WAIT_FOR_FORWARDING").otherwise("WAIT_FOR_PROCESSING")
    by_forward = F.when(forward == "STARTED", "FORWARDING").when(forward == "SUCCESS", "COMPLETED").otherwise("WAIT_FOR_FORWARDING")
    return F.when(process == "FAILURE", "PROCESS_FAILED").when(forward == "FAILURE", "FORWARD_FAILED").when(F.coalesce(forward, F.lit("")) != "", by_forward).otherwise(by_process)
