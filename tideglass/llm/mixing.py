"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words (`targets`: weights share a total, no source beyond a cap times its
size). Within a source a document's expected copies are proportional to a measure of it, with a cap;
their whole part is taken for certain, and the fraction is its inclusion probability p. Documents are
ranked by random odds over inclusion odds, u / (1 - u) / (p / (1 - p)), and taken in that order until
the source's words come nearest to its target: a sample of fixed size with unequal probabilities.

The order is never sorted as a whole: ranks fall into buckets, the buckets' words are summed, and only
the bucket in which a source's target lies is ordered. u is a hash of doc_id, so reruns agree.

Defined results: a null source is a source of its own; null and empty texts have size 0 and their
copies take no words; rows that repeat a doc_id share its draw; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideglass.llm._common import staged

BUCKETS = 1 << 14
#: A measure counts in steps of this part.
STEP = 8


def n_words(text: str = "text") -> Column:
    """Runs of non-space in a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, share: float, cap: float) -> DataFrame:
    """sizes (source, source_size, weight) with target: `share` of all sizes divided by weight, none over cap * source_size.

    The excess of capped sources is shared again by weight: target = min(cap * size, level * weight), and
    level is raised, a sum over sources each time, until no more sources are capped.
    """
    total = share * (sizes.agg(F.sum("source_size")).first()[0] or 0)
    most, level = F.col("source_size") * cap, None
    while True:
        full = F.lit(False) if level is None else most < F.lit(level) * F.col("weight")
        capped, open_weight = sizes.agg(F.coalesce(F.sum(F.when(full, most)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        new = level if not open_weight else (total - float(capped)) / float(open_weight)
        if new == level or level is not None and new < level:
            break
        level = new
    return sizes.withColumn("target", F.least(most.cast("double"), F.lit(float(level or 0.0)) * F.col("weight")))


def _drawn(docs: DataFrame, cap: float, seed: int) -> DataFrame:
    """docs (doc_id, size, measure, rate) with whole copies, the order q of the fraction and its bucket."""
    u = (F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    expected = F.least(F.lit(float(cap)), F.col("rate") * F.col("measure"))
    docs = docs.withColumn("whole", F.floor(expected)).withColumn("p", expected - F.floor(expected))
    docs = docs.withColumn("q", F.when((F.col("p") > 0), u / (1 - u) / (F.col("p") / (1 - F.col("p")))))
    return docs.withColumn("bucket", F.floor(F.col("q") / (1 + F.col("q")) * BUCKETS)).withColumn("place", F.struct("q", F.xxhash64(F.col("doc_id"), F.lit(seed + 1)).alias("tie"), "size"))


def _plan(sized: DataFrame, wanted: DataFrame, cap: float, seed: int) -> DataFrame:
    """One row a source: source, source_size, target, rate (copies for one unit of measure), crossing bucket and cutoff place."""
    steps = sized.where("size > 0").groupBy("source", "measure").agg(F.sum("size").alias("words"))
    steps = steps.join(wanted.select(F.col("source").alias("s"), "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    larger = Window.partitionBy("source").orderBy(F.desc("measure")).rowsBetween(Window.unboundedPreceding, -1)
    here_on = Window.partitionBy("source").orderBy(F.desc("measure")).rowsBetween(0, Window.unboundedFollowing)
    full = F.coalesce(F.sum("words").over(larger), F.lit(0)) * float(cap)
    rate = (F.col("target") - full) / F.sum(F.col("words") * F.col("measure")).over(here_on)
    rates = steps.withColumn("rate", rate).where(F.col("rate") * F.col("measure") <= cap + 1e-12).groupBy("source").agg(F.max_by("rate", "measure").alias("rate"))
    plan = wanted.select(F.col("source").alias("s"), "source_size", "target").join(rates, F.col("s").eqNullSafe(F.col("source")), "left")
    plan = staged(plan.select(F.col("s").alias("source"), "source_size", "target", F.coalesce("rate", F.lit(0.0)).alias("rate")))

    drawn = _drawn(sized.join(plan.select(F.col("source").alias("s"), "target", "rate"), F.col("source").eqNullSafe(F.col("s"))), cap, seed)
    certain = drawn.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("certain"))
    buckets = drawn.where("q is not null").groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    goal = plan.select("source", "target").alias("a").join(certain.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left")
    goal = goal.select(F.col("a.source").alias("s"), (F.col("target") - F.coalesce("certain", F.lit(0))).alias("rest"))
    crossing = (
        buckets.withColumn("through", F.sum("words").over(upto))
        .join(goal, F.col("source").eqNullSafe(F.col("s")))
        .where(F.col("through") > F.col("rest"))
        .groupBy("source")
        .agg(F.min_by(F.struct(F.col("bucket").alias("crossing"), (F.col("through") - F.col("words")).alias("before"), "rest"), "bucket").alias("c"))
        .select(F.col("source").alias("s"), "c.*")
    )
    inside = drawn.drop("s").join(crossing, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("crossing")))
    order = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("fits", F.col("before") + F.sum("size").over(order) - F.col("size") / 2.0 <= F.col("rest"))
    cutoff = inside.withColumn("fits", F.min("fits").over(order)).where("fits").groupBy("source").agg(F.max("place").alias("cutoff"))
    plan = plan.join(crossing.select("s", "crossing"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    return staged(plan.join(cutoff.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s"))


def mix(docs: DataFrame, weights: DataFrame, share: float = 1.5, cap: float = 2.0, measure: Column | None = None, seed: int = 17) -> DataFrame:
    """docs with size, source_size, target and copies: how often the mix takes the row.

    docs: doc_id, source, text, other columns as they are. weights: (source, weight), one row a source; a
    source that it lacks has weight 0. cap: of a source's target in times its size, and of a document's expected copies,
    so a whole cap is the most copies of it, and the next whole number for any other. measure: what expected copies go by within a source, of the
    column `size` (log2(size + 2) unless given).
    """
    measure = F.log2(F.col("size") + 2.0) if measure is None else measure
    measure = F.greatest(F.round(measure * STEP), F.lit(1.0)) / STEP
    cols = ["doc_id", F.col("source"), n_words().alias("size")]
    sized = staged(docs.select(*cols).withColumn("measure", measure))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_weight = weights.select(F.col("source").alias("s"), F.col("weight").cast("double").alias("weight"))
    sizes = staged(sizes.join(by_weight, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", F.coalesce("weight", F.lit(0.0)).alias("weight")))
    plan = _plan(sized, targets(sizes, share, cap), cap, seed)

    names = {c: f"__{c}" for c in ("source", "source_size", "target", "rate", "crossing", "cutoff")}
    plan = plan.select(*(F.col(c).alias(n) for c, n in names.items()))
    own = [docs[c] for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    rows = docs.select(*own, n_words().alias("size")).withColumn("__measure", measure)
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("__source")))
    kept = rows.select(F.struct(*own, "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target")).alias("row"), "doc_id", "size", F.col("__measure").alias("measure"), F.col("__rate").alias("rate"), "__crossing", "__cutoff")
    drawn = _drawn(kept, cap, seed)
    in_order = F.col("__crossing").isNull() | (F.col("bucket") < F.col("__crossing")) | ((F.col("bucket") == F.col("__crossing")) & F.coalesce(F.col("place") <= F.col("__cutoff"), F.lit(False)))
    copies = (F.col("whole") + F.when(F.col("q").isNotNull() & in_order, 1).otherwise(0)).cast("int")
    return drawn.select("row.*", F.coalesce(copies, F.lit(0)).alias("copies"))


def repeating_weights(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0)) -> DataFrame:
    """(source, weight): weights in turn for the sources by code point, null last. One row a source goes through the window."""
    sources = docs.groupBy("source").agg(F.count("*").alias("n")).select("source")
    turn = (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights)
    return sources.select("source", F.element_at(F.array(*map(F.lit, weights)), turn + 1).alias("weight"))
