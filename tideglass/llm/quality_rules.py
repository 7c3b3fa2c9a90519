"""Quality rules as a learned decision list, in DataFrame and SQL functions only.

`features` measures whole texts inside the JVM. `learn` grows and prunes rules by sequential covering:
each step reads one small histogram (feature, bin -> labelled rows of either kind) that Spark sums over
the labelled rows, takes the threshold condition of the highest information gain, and stops a rule when
it is pure; the rule is cut back to the prefix that does best on rows held aside, and what it covers is
taken out before the next one is grown. `verdict` turns the ordered rules into one CASE expression.

Defined results: a null text counts as an empty one (no words, base rules fail it); with no labelled
rows, or none of either kind, the list is empty and only the base rules reject; rows may repeat; labels
that contradict each other count as the lower quality; other columns stay as they are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideglass.llm._common import staged

_SPACE = r"[\x20\x09-\x0D]+"
#: The features that rules are made of.
FEATURES = ("n_words", "mean_word", "symbol_share", "upper_share", "mark_share", "digit_share", "repeat_share", "dup_line_share", "words_a_line")
#: Labelled rows that rules are learned from, about.
MAX_ROWS = 20_000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, the counts of BASE, the features of FEATURES) of every row.

    Words are runs of non-space. n_repeat_words counts the words that lie in a 3-word window which the
    text holds twice or more: windows are compared by 64-bit hashes; only texts with a repeated one
    order their (hash, place) pairs to find the places.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    only = lambda kept: F.length(F.regexp_replace(text, f"[^{kept}]+", ""))
    rows = docs.select(
        "doc_id",
        F.filter(F.split(text, _SPACE), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.length(F.regexp_replace(text, _SPACE, "")).cast("bigint").alias("word_chars"),
        only(r"#*$%&|<>").cast("bigint").alias("n_symbols"),
        only(r"A-ZÀ-Þ").alias("n_upper"),
        only(r"!?").alias("n_marks"),
        only(r"0-9").alias("n_digits"),
    )
    words = F.col("words")
    hashes = F.when(F.size("words") >= 3, F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    n_lines = F.size("lines")
    rows = rows.select(
        "doc_id", "word_chars", "n_symbols", "n_upper", "n_marks", "n_digits",
        F.size("words").cast("bigint").alias("n_words"),
        n_lines.alias("n_lines"),
        (n_lines - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        hashes.alias("hashes"),
    )
    twice = F.size(F.array_distinct("hashes")) < F.size("hashes")
    placed = F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("placed", F.when(twice, placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))).drop("hashes")
    all_placed = F.col("placed")
    same = lambda p, j: F.coalesce(F.get(all_placed, j)["h"] == p["h"], F.lit(False))
    again = F.filter("placed", lambda p, k: same(p, k + 1) | (F.when(k > 0, same(p, k - 1)).otherwise(F.lit(False))))
    rows = rows.withColumn("at", F.sort_array(F.transform(again, lambda p: p["i"]))).drop("placed")
    step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last"))
    covered = F.aggregate("at", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), step, lambda acc: acc["n"])
    rows = rows.withColumn("n_repeat_words", covered.cast("bigint")).drop("at")
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return rows.select(
        "doc_id", *BASE,
        share("word_chars", "n_words").alias("mean_word"),
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_upper", "word_chars").alias("upper_share"),
        share("n_marks", "word_chars").alias("mark_share"),
        share("n_digits", "word_chars").alias("digit_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_words", "n_lines").alias("words_a_line"),
    )


def base_failed() -> Column:
    """Fewer than 50 words, or over half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # value >= cut, else value < cut
    cut: float

    def column(self) -> Column:
        value = F.col(self.feature).cast("double")
        return value >= self.cut if self.above else value < self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.cut:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    covered: int = 0
    correct: int = 0

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


@dataclass
class DecisionList:
    """Ordered rules that reject; what none of them covers is kept."""

    rules: list[Rule] = field(default_factory=list)

    def fired(self) -> Column:
        """The text of the first rule that covers a row, else null."""
        out = None
        for r in self.rules:
            out = F.when(r.column(), F.lit(str(r))) if out is None else out.when(r.column(), F.lit(str(r)))
        return F.lit(None).cast("string") if out is None else out


def _grow(rows: DataFrame, cuts: dict[str, list[float]]) -> Condition | None:
    """The condition of the highest gain, from one histogram of the rows; None if none gains."""
    histogram = rows.select(F.posexplode("bins").alias("f", "bin"), "bad").groupBy("f", "bin").agg(F.sum("bad"), F.sum(1 - F.col("bad")))
    by: dict[int, dict[int, tuple[int, int]]] = {}
    for f, b, bad, good in histogram.collect():
        by.setdefault(f, {})[b] = (bad, good)
    best, condition = 1e-9, None
    for f, name in enumerate(FEATURES):
        hist = by.get(f, {})
        total = [sum(v[k] for v in hist.values()) for k in (0, 1)]
        if not total[0] or not total[1]:
            return None
        before = math.log2(total[0] / sum(total))
        low = [0, 0]
        for b, cut in enumerate(cuts[name]):  # rows in bins up to b are below cut b
            low = [low[k] + hist.get(b, (0, 0))[k] for k in (0, 1)]
            for above, (bad, good) in ((False, low), (True, [total[k] - low[k] for k in (0, 1)])):
                if bad and bad + good < sum(total):
                    gain = bad * (math.log2(bad / (bad + good)) - before)
                    if gain > best:
                        best, condition = gain, Condition(name, above, cut)
    return condition


def sample_labels(labels: DataFrame, max_rows: int) -> DataFrame:
    """(doc_id, quality) of about max_rows labelled documents, by a hash of doc_id."""
    labels = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    part = min(1.0, max_rows / max(1, labels.count()))
    return labels.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < part * 1_000_000)


def learn(measured: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_rules: int = 10, max_conditions: int = 3, precision: float = 0.9, min_covered: int = 8, n_cuts: int = 48) -> DecisionList:
    """A decision list for quality 0 from labels (doc_id, quality) and features.

    It is fitted to at most about max_rows labelled rows that pass the base rules, picked by a hash of doc_id.
    Two thirds of them grow the rules, one third prunes them; a rule stays if `precision` of the pruning
    rows that it covers, at least min_covered, are of quality 0; the first that doesn't ends the list.
    """
    labels = sample_labels(labels, max_rows)
    passed = measured.where(~base_failed())
    rows = passed.join(labels.withColumnRenamed("doc_id", "__id"), F.col("doc_id") == F.col("__id")).select("doc_id", *FEATURES, (F.col("quality") == 0).cast("int").alias("bad"))
    rows = staged(rows)
    points = [(k + 0.5) / n_cuts for k in range(n_cuts)]
    marks = rows.groupBy("bad").agg(*(F.percentile_approx(F.col(f).cast("double"), points, 10_000).alias(f) for f in FEATURES)).collect()
    if len(marks) < 2:
        return DecisionList()
    cuts = {f: sorted({float(v) for m in marks for v in m[f]}) for f in FEATURES}
    cuts = {f: [(a + b) / 2 for a, b in zip(v, v[1:])] or v for f, v in cuts.items()}
    bin_of = lambda f: F.size(F.filter(F.array(*map(F.lit, cuts[f])), lambda c: c <= F.col(f)))
    binned = [bin_of(f) for f in FEATURES]
    aside = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(3)) == 0
    rows = staged(rows.withColumn("bins", F.array(*binned)).withColumn("aside", aside))
    out = DecisionList()
    while len(out.rules) < max_rules:
        chosen: list[Condition] = []
        left = rows.where("not aside")
        while len(chosen) < max_conditions and (c := _grow(left, cuts)):
            chosen.append(c)
            left = left.where(c.column())
        if not chosen:
            break
        held, upto, tests = rows.where("aside"), F.lit(True), []
        for k, c in enumerate(chosen):
            upto = upto & c.column()
            tests += [F.sum(F.when(upto, 1).otherwise(0)).alias(f"n{k}"), F.sum(F.when(upto, F.col("bad")).otherwise(0)).alias(f"bad{k}")]
        seen = held.agg(*tests).first()
        worth = [((2 * (seen[f"bad{k}"] or 0) - (seen[f"n{k}"] or 0)) / max(1, seen[f"n{k}"] or 0), seen[f"bad{k}"] or 0, -k) for k in range(len(chosen))]
        k = -max(worth)[2]
        covered, correct = seen[f"n{k}"] or 0, seen[f"bad{k}"] or 0
        if covered < min_covered or correct < precision * covered:
            break
        rule = Rule(tuple(chosen[: k + 1]), covered, correct)
        out.rules.append(rule)
        rows = rows.where(~rule.column())
    return out


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, BASE counts, FEATURES, base_failed, rule, kept) of every row of docs; rule: the learned rule that rejects it."""
    measured = staged(features(docs))
    rules = learn(measured, labels, **options)
    out = measured.withColumn("base_failed", base_failed()).withColumn("rule", F.when(~F.col("base_failed"), rules.fired()))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def filter_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without the rows that are rejected, measured in one pass: no text is shuffled.

    The rules are learned first, from the features of the labelled sample alone (its ids are broadcast; max_rows
    bounds them). The column `order` has no use but to keep Spark from moving the filter below the measuring,
    where it would measure a text once for each time that the rules refer to it.
    """
    ids = sample_labels(labels, options.get("max_rows", MAX_ROWS)).select(F.col("doc_id").alias("__id"))
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("__id"), "left_semi")
    rules = learn(staged(features(chosen)), labels, **options)
    row = F.struct(*(docs[c] for c in docs.columns))
    measured = features(docs.select(row.alias("doc_id"), F.col("text"))).withColumn("order", F.monotonically_increasing_id())
    return measured.where((F.col("order") >= 0) & ~base_failed() & rules.fired().isNull()).select("doc_id.*")
