"""Versions of an ontology and of runs: proposals, operation logs, diffs, cards, merges, summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of a proposal's confidence, novelty and impact; mentions that make a pending entity a proposal; its confidence.
WEIGHTS = (0.5, 0.2, 0.3)
LEAST_MENTIONS, PENDING_CONFIDENCE = 3, 0.5


def proposal_score(confidence: Column, novelty: Column, impact: Column, weights: Sequence[float] = WEIGHTS) -> Column:
    return weights[0] * confidence + weights[1] * novelty + weights[2] * impact


def evidence_richness(documents: Column) -> Column:
    """1 if the array of documents names two or more, else 0.6."""
    return F.when(F.size(F.array_distinct(documents)) >= 2, 1.0).otherwise(0.6)


def pending_proposals(pending: DataFrame) -> DataFrame:
    """(name, confidence, impact) of entities (name, mention_count) mentioned often enough."""
    return pending.where(F.col("mention_count") >= LEAST_MENTIONS).select("name", F.lit(PENDING_CONFIDENCE).alias("confidence"), F.least(F.lit(1.0), F.col("mention_count") / 10).alias("impact"))


def auto_accepted(line: Column | float) -> Column:
    """Confident enough, not rejected, and with evidence of two documents (columns confidence, status, documents)."""
    return (F.col("confidence") >= line) & (F.coalesce("status", F.lit("pending")) != "rejected") & (evidence_richness(F.col("documents")) == 1.0)


def version_diff(versions: DataFrame, keys: Sequence[str], after: Column, upto: Column) -> DataFrame:
    """keys and ops: the operations of versions (keys, position, ops array) after one position up to another, in order."""
    chosen = versions.where((F.col("position") > after) & (F.col("position") <= upto))
    listed = F.array_sort(F.collect_list(F.struct("position", "ops")))
    return chosen.groupBy(*keys).agg(F.flatten(F.transform(listed, lambda v: v["ops"])).alias("ops"))


def fold_log(log: DataFrame, keys: Sequence[str], item: str, order: str, adds: Sequence[str], drops: Sequence[str], op: str = "op") -> DataFrame:
    """keys, item and its other columns as the operations leave them: the last one that is known adds or drops the item; unknown ones are ignored."""
    known = log.where(F.col(op).isin([*adds, *drops]))
    last = known.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, item).orderBy(F.desc(order)))).where("__n = 1").drop("__n")
    return last.where(F.col(op).isin(list(adds)))


def change_groups(changes: DataFrame, kind: str = "change_type", anchor: str = "anchor", tokens: str = "tokens", unchanged: str = "UNCHANGED") -> DataFrame:
    """(kind, topic, n, tokens): changes by kind and normalised anchor, with the distinct tokens of all, in order."""
    topic = F.lower(F.trim(F.regexp_replace(anchor, r"\s+", " ")))
    rows = changes.where(F.col(kind) != unchanged).select(F.col(kind), topic.alias("topic"), tokens)
    counts = rows.groupBy(kind, "topic").agg(F.count("*").alias("n"))
    every = rows.select(kind, "topic", F.explode(tokens).alias("t")).groupBy(kind, "topic").agg(F.sort_array(F.collect_set("t")).alias("tokens"))
    return counts.join(every, [kind, "topic"], "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))


def cards(runs: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    """keys, support, kept: how many runs each group has, and whether that is enough for a card."""
    return runs.groupBy(*keys).agg(F.count("*").alias("support")).withColumn("kept", F.col("support") >= least)


def relation_hint(steps: DataFrame, keys: Sequence[str], relation: str, n: int = 5) -> DataFrame:
    """keys, hint: the n most frequent relations, joined by arrows; ties by name."""
    counted = steps.groupBy(*keys, relation).agg(F.count("*").alias("__c"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__c"), relation))
    few = counted.withColumn("__n", place).where(F.col("__n") <= n)
    return few.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", relation))), lambda s: s[relation]), " -> ").alias("hint"))


def merge_partial(first: DataFrame, second: DataFrame, key: str, boundary: Column) -> DataFrame:
    """first below the boundary of the key and second from it on; a key in both is second's."""
    a, b = first.where(F.col(key) < boundary), second.where(F.col(key) >= boundary)
    return a.join(b.select(key), key, "left_anti").unionByName(b)


def next_number(rows: DataFrame, keys: Sequence[str], number: str = "version") -> DataFrame:
    return rows.groupBy(*keys).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next"))


def run_summary(results: DataFrame, types: Sequence[str], kind: str = "kind", value: str = "seconds") -> DataFrame:
    """(kind, n, n_judged, n_fault, accuracy, p95) for every type of the domain, also those without a result; results: kind, passed (null: not judged), fault, value."""
    q = F.percentile(value, 0.95)
    found = results.groupBy(kind).agg(
        F.count("*").alias("n"), F.count("passed").alias("n_judged"), F.sum(F.col("fault").cast("int")).alias("n_fault"),
        F.round(F.try_divide(F.sum(F.col("passed").cast("int")), F.count("passed")), 4).alias("accuracy"), F.round(q, 4).alias("p95"),
    )
    domain = results.sparkSession.createDataFrame([(t,) for t in types], f"{kind} string")
    return domain.join(found, kind, "left").na.fill(0, ["n", "n_judged", "n_fault"])


def reduction(rows: DataFrame, baseline: Column, changed: Column, keys: Sequence[str] = ()) -> DataFrame:
    """keys, baseline, changed, saved: sums, and the share saved (0 without a baseline)."""
    sums = rows.groupBy(*keys).agg(F.sum(baseline).alias("baseline"), F.sum(changed).alias("changed"))
    return sums.withColumn("saved", F.when(F.col("baseline") > 0, F.round(1 - F.col("changed") / F.col("baseline"), 4)).otherwise(0.0))


def running_mean(rows: DataFrame, keys: Sequence[str], order: Sequence, value: str) -> DataFrame:
    """rows with n_so_far and mean_so_far of each key."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("n_so_far", F.count(value).over(w)).withColumn("mean_so_far", F.avg(value).over(w))


def timeline(rounds: DataFrame, keys: Sequence[str], at: str, tie: str, n: int) -> DataFrame:
    """The newest n rounds of each key with their place."""
    return rounds.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(at), F.desc(tie)))).where(F.col("place") <= n)


def mark(cards: DataFrame, ids: DataFrame, key: str, flag: str, value: bool = True) -> DataFrame:
    """cards with the flag of those in ids set; the others keep theirs."""
    hit = ids.select(F.col(key).alias("__id")).distinct().withColumn("__hit", F.lit(True))
    out = cards.join(hit, F.col(key) == F.col("__id"), "left")
    return out.select(*(F.when(F.col("__hit"), F.lit(value)).otherwise(F.col(c)).alias(c) if c == flag else F.col(c) for c in cards.columns))


def first_pairs(units: DataFrame, keys: Sequence[str], order: str, first: str = "user_input", second: str = "final_answer", kind: str = "kind", content: str = "content") -> DataFrame:
    """keys, first, second: the first unit of either kind; null where one is missing."""
    of = lambda k: F.min_by(F.when(F.col(kind) == k, F.col(content)), F.when(F.col(kind) == k, F.col(order)))
    both = units.groupBy(*keys).agg(of(first).alias("__a"), of(second).alias("__b"))
    whole = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    return both.select(*keys, F.when(whole, F.struct(F.col("__a").alias(first), F.col("__b").alias(second))).alias("pair"))


def domain_counts(rows: DataFrame, column: str, domain: Mapping[str, int] | Sequence[str]) -> DataFrame:
    """(column, n) for every value of the domain."""
    every = rows.sparkSession.createDataFrame([(d,) for d in domain], f"{column} string")
    return every.join(rows.groupBy(column).agg(F.count("*").alias("n")), column, "left").na.fill(0, ["n"])


def permutation_p(observed: DataFrame, draws: DataFrame, keys: Sequence[str], value: str = "similarity") -> DataFrame:
    """observed with n_draws, n_ge and p = (draws at least as high + 1) / (draws + 1); draws: keys, value, drawn under the null."""
    both = observed.join(draws.select(*keys, F.col(value).alias("__drawn")), list(keys), "left")
    counted = both.groupBy(*observed.columns).agg(F.count("__drawn").alias("n_draws"), F.count_if(F.col("__drawn") >= F.col(value)).alias("n_ge"))
    return counted.withColumn("p", (F.col("n_ge") + 1) / (F.col("n_draws") + 1))


def ontology_shares(classes: DataFrame, seeds: DataFrame) -> DataFrame:
    """(cov, red, align): shares of classes that a seed term names, of second parents, and of classes with an anchor, to four places.

    classes: name, parent, also_parent, anchor; seeds: the words of the terms, in a column `word`.
    """
    named = classes.join(seeds.select(F.col("word").alias("name"), F.lit(1).alias("__seed")).distinct(), "name", "left")
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    share = lambda condition: F.coalesce(F.round(F.avg(condition.cast("double")), 4), F.lit(0.0))
    return named.agg(share(F.col("__seed").isNotNull()).alias("cov"), share(filled("parent") & filled("also_parent")).alias("red"), share(filled("anchor")).alias("align"))
