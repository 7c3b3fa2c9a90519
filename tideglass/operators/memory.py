"""Memory retrieval and consolidation: normalize, fuse, decay, diversify, budget; hit statistics, scores, promotion."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the scores' formula.
WEIGHTS = {"frequency": 0.24, "relevance": 0.30, "diversity": 0.15, "recency": 0.15, "consolidation": 0.10, "conceptual": 0.06}
HALF_LIFE_DAYS, EXTERNAL_WEIGHT = 14.0, 0.8


def content_dedup(records: DataFrame, content: str, order: str, keys: Sequence[str] = ()) -> DataFrame:
    """The first record, by order, of each sha-256 of the content."""
    digest = F.sha2(F.col(content), 256)
    window = Window.partitionBy(*keys, digest).orderBy(order)
    return records.withColumn("__n", F.row_number().over(window)).where("__n = 1").drop("__n")


def score_fusion(score: Column, external: Column, fused: Column | None = None) -> Column:
    """The score, times 0.8 if it comes from outside; a score that was fused before stays."""
    own = score * F.when(external, EXTERNAL_WEIGHT).otherwise(1.0)
    return own if fused is None else F.coalesce(fused, own)


def temporal_decay(score: Column, age_days: Column, eligible: Column) -> Column:
    """The score halved every 14 days where it may decay and the age is known."""
    return F.when(eligible & age_days.isNotNull(), score * F.pow(F.lit(0.5), age_days / HALF_LIFE_DAYS)).otherwise(score)


def token_budget(records: DataFrame, tokens: str, order: Sequence, budget: int, keys: Sequence[str] = ()) -> DataFrame:
    """The longest prefix in order whose tokens fit the budget (it ends at the first overflow)."""
    running = F.sum(tokens).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return records.withColumn("used", running).where(F.col("used") <= budget)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty sets have 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def token_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def mmr(pool: DataFrame, key: str, k: int = 5, weight: float = 0.7, near: float = 0.92, most: int = 200) -> DataFrame:
    """Greedy marginal relevance per key: pool (key, pos, id, score, text) -> (key, rank, id, mmr).

    The pool is the `most` best records of a key (that bound is the feature). Records that are near
    copies of an earlier one are left out; the first pick takes weight * score, each next one the best
    weight * score + (1 - weight) * (1 - similarity to what is picked), ties by pos.
    """
    best = Window.partitionBy(key).orderBy(F.desc("score"), "pos")
    pool = pool.withColumn("__n", F.row_number().over(best)).where(F.col("__n") <= most).drop("__n")
    kinds = dict(pool.dtypes)

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        left = []
        sets = [frozenset((t or "").lower().split()) for t in rows["text"]]
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
        for i in range(len(rows)):
            if all(like(sets[i], sets[j]) < near for j in left):
                left.append(i)
        scores, ids, out, chosen = rows["score"].tolist(), rows["id"].tolist(), [], []
        while left and len(chosen) < k:
            value = lambda i: weight * scores[i] + ((1 - weight) * (1 - max(like(sets[i], sets[j]) for j in chosen)) if chosen else 0.0)
            top = max(left, key=lambda i: (value(i), -i))
            out.append((rows[key].iloc[0], len(out) + 1, ids[top], float(value(top))))
            chosen.append(top)
            left.remove(top)
        return pd.DataFrame(out, columns=[key, "rank", "id", "mmr"])

    return pool.groupBy(key).applyInPandas(lambda rows: pick(rows), f"{key} {kinds[key]}, rank int, id {kinds['id']}, mmr double")


def hit_stats(hits: DataFrame) -> DataFrame:
    """Per memory: hits, grounded hits, distinct days and queries, score sum, last time. Hits without a memory don't count."""
    return hits.where("memory_id is not null").groupBy("memory_id").agg(
        F.count("*").alias("recall_count"),
        F.sum(F.col("grounded").cast("bigint")).alias("grounded_count"),
        F.countDistinct("day").alias("n_days"),
        F.countDistinct("query_hash").alias("n_queries"),
        F.sum("score").alias("total_score"),
        F.datediff(F.max(F.to_date("day")), F.min(F.to_date("day"))).alias("span_days"),
        F.max("occurred_at").alias("last_recalled_at"),
    )


def _clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def age_days(at: Column, now: Column) -> Column:
    """Days between a time and now, from microseconds; not below zero."""
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    return F.greatest(F.lit(0.0), (micros(now) - micros(at)) / 86_400_000_000.0)


def _recency(at: Column, now: Column) -> Column:
    return F.when(at.isNull(), 0.0).otherwise(_clamp(F.exp(-F.log(F.lit(2.0)) * age_days(at, now) / HALF_LIFE_DAYS)))


def dreaming_metrics(stats: DataFrame, now: Column) -> DataFrame:
    """stats (see hit_stats) with the parts of a memory's score, each from 0 to 1.

    Columns that stats may lack count as 0 or null: daily_count, span_days (between the first and last day),
    n_tags, light_hits, rem_hits, last_light_at, last_rem_at.
    """
    of = lambda name, other: F.coalesce(F.col(name), F.lit(other)) if name in stats.columns else F.lit(other)
    when = lambda name: F.col(name) if name in stats.columns else F.lit(None).cast("timestamp")
    grown = lambda n, most: _clamp(F.log1p(n.cast("double")) / F.log1p(F.lit(float(most))))
    signal = F.col("recall_count") + of("daily_count", 0) + F.col("grounded_count")
    spread = F.greatest(_clamp(0.55 * grown(F.col("n_days") - 1, 4) + 0.45 * _clamp(of("span_days", 0) / 7)), _clamp(F.col("grounded_count") / 3))
    boost = 0.06 * grown(of("light_hits", 0), 6) * _recency(when("last_light_at"), now) + 0.09 * grown(of("rem_hits", 0), 6) * _recency(when("last_rem_at"), now)
    return stats.withColumns(
        {
            "signal": signal,
            "frequency": grown(signal, 10),
            "relevance": _clamp(F.col("total_score") / F.greatest(F.lit(1), signal)),
            "diversity": _clamp(F.greatest("n_days", "n_queries") / 5.0),
            "recency": _recency(F.col("last_recalled_at"), now),
            "consolidation": F.when(F.col("n_days") == 0, 0.0).when(F.col("n_days") == 1, 0.2).otherwise(spread),
            "conceptual": _clamp(of("n_tags", 0) / 6),
            "boost": _clamp(boost),
        }
    )


def dreaming_score(metrics: DataFrame) -> DataFrame:
    """The weighted sum of the parts and the boost, from 0 to 1."""
    parts = [F.col(name) * weight for name, weight in WEIGHTS.items()]
    return metrics.withColumn("score", _clamp(sum(parts[1:], parts[0]) + F.col("boost")))


def dreaming_select(scored: DataFrame, noise: Column, least_score: float = 0.72, least_recall: int = 3, least_diversity: int = 2) -> DataFrame:
    """Whether to promote, with the first reason against it: noise, score, recall, diversity."""
    reason = (
        F.when(noise, "noise").when(F.col("score") < least_score, "score_below_threshold").when(F.col("recall_count") < least_recall, "recall_below_threshold")
        .when(F.greatest("n_days", "n_queries") < least_diversity, "diversity_below_threshold")
    )
    return scored.withColumn("reason", reason).withColumn("promote", F.col("reason").isNull())


def fill_budget(rows: DataFrame, key: str, size: str, order: str, budget: int) -> DataFrame:
    """Per key, records in order as long as they fit the budget; a misfit is skipped and later ones may still fit.

    A greedy fold over the ordered sizes of a key, in one array.
    """
    listed = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, size))).alias("all"))
    step = lambda acc, x: F.when(acc["used"] + x[size] <= budget, F.struct((acc["used"] + x[size]).alias("used"), F.concat(acc["kept"], F.array(x[order])).alias("kept"))).otherwise(acc)
    kinds = dict(rows.dtypes)
    start = F.struct(F.lit(0).cast(kinds[size]).alias("used"), F.array().cast(f"array<{kinds[order]}>").alias("kept"))
    return listed.select(key, F.posexplode(F.aggregate("all", start, step, lambda acc: acc["kept"])).alias("place", order))


def recall_update(memories: DataFrame, hits: DataFrame) -> DataFrame:
    """memories (memory_id, days array, hashes array, recall_count) with new hits: values are appended once."""
    new = hits.groupBy("memory_id").agg(F.sort_array(F.collect_set("day")).alias("__days"), F.sort_array(F.collect_set("query_hash")).alias("__hashes"), F.count("*").alias("__n"))
    none = F.array().cast("array<string>")
    out = memories.join(new, "memory_id", "left")
    return out.select("memory_id", F.array_union("days", F.coalesce("__days", none)).alias("days"), F.array_union("hashes", F.coalesce("__hashes", none)).alias("hashes"), (F.col("recall_count") + F.coalesce("__n", F.lit(0))).alias("recall_count"))


def layer_of(layer: Column) -> Column:
    """tenant, user, or else agent."""
    return F.when(layer.isin("tenant", "user"), layer).otherwise("agent")


def retrieve(records: DataFrame, key: str, budget: int, k: int = 5) -> DataFrame:
    """(key, rank, id, mmr, tokens, used): the agent layer of each key, deduplicated, fused, decayed, diversified and cut to the budget.

    records: key, pos, id, score, text, layer, memory_type, external, age_days, tokens. Tenant and user layers
    are given as context in full and do not compete here.
    """
    agent = records.where(layer_of(F.col("layer")) == "agent")
    eligible = (F.col("memory_type") == "short_term") & ~F.col("external")
    scored = content_dedup(agent, "text", "pos", [key]).withColumn("score", temporal_decay(score_fusion(F.col("score"), F.col("external")), F.col("age_days"), eligible))
    picked = mmr(scored.select(key, "pos", "id", "score", "text"), key, k)
    return token_budget(picked.join(scored.select(key, "id", "tokens"), [key, "id"]), "tokens", ["rank"], budget, [key]).select(key, "rank", "id", "mmr", "tokens", "used")


def light_phase(memories: DataFrame, stats: DataFrame, now: Column) -> DataFrame:
    """memories with the counters of stats (see hit_stats) where there are any, which counts as a light hit at this time."""
    fresh = stats.select("memory_id", *(F.col(c).alias(f"__{c}") for c in ("recall_count", "grounded_count", "n_days", "last_recalled_at")))
    out = memories.join(fresh, "memory_id", "left")
    hit = F.col("__recall_count").isNotNull()
    take = lambda name, source: F.when(hit, F.col(f"__{source}")).otherwise(F.col(name)).alias(name)
    changed = {"recall_count": "recall_count", "grounded_count": "grounded_count", "daily_count": "n_days", "last_recalled_at": "last_recalled_at"}
    kept = [take(c, changed[c]) if c in changed else F.col(c) for c in memories.columns if c not in ("light_hits", "last_light_at")]
    return out.select(*kept, (F.col("light_hits") + hit.cast("int")).alias("light_hits"), F.when(hit, now).otherwise(F.col("last_light_at")).alias("last_light_at"))


def rem_phase(memories: DataFrame, now: Column, most_days: int, tags: Column, noise: Column) -> DataFrame:
    """Active short-term memories of agents no older than this: tagged, and hit once more unless they are noise; others stay as they are."""
    due = F.coalesce((F.col("status") == "active") & (F.col("memory_type") == "short_term") & (layer_of(F.col("layer")) == "agent"), F.lit(False))
    due = due & (F.col("created_at").isNull() | (F.col("created_at") >= now - F.make_dt_interval(F.lit(most_days))))
    hit = due & ~F.coalesce(noise, F.lit(False))
    return memories.withColumns({"concept_tags": F.when(due, tags).otherwise(F.col("concept_tags")), "rem_hits": F.col("rem_hits") + hit.cast("int"), "last_rem_at": F.when(hit, now).otherwise(F.col("last_rem_at"))})


def compacted(items: DataFrame, keys: Sequence[str], position: str, target: int, keep_recent: int = 2) -> DataFrame:
    """items with stage and compacted: which are replaced by their short form until a context fits the target.

    items: keys, position, is_action, compactable (boolean), tokens, compact_tokens. Old actions go first (all but the last
    keep_recent), then other compactable items, then recent actions; in a stage the largest saving first, ties by position.
    Items without a stage are never replaced. The total counts all items of a context, replaced ones by their short form.
    """
    from_last = F.row_number().over(Window.partitionBy(*keys, "is_action").orderBy(F.desc(position)))
    stage = F.when(F.col("is_action"), F.when(from_last > keep_recent, 0).otherwise(2)).when(F.col("compactable"), 1)
    staged = items.withColumn("stage", stage).withColumn("__change", F.when(F.col("stage").isNotNull(), F.col("tokens") - F.col("compact_tokens")).otherwise(0))
    order = Window.partitionBy(*keys).orderBy(F.col("stage").asc_nulls_last(), F.desc(F.greatest("__change", F.lit(0))), position)
    before = F.coalesce(F.sum("__change").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("tokens").over(Window.partitionBy(*keys))
    least = F.min("__left").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return staged.withColumn("__left", total - before).withColumn("compacted", F.col("stage").isNotNull() & (least > target)).drop("__change", "__left")
