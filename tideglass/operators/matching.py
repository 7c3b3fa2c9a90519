"""Matching: substring joins without nested loops, ordered one-to-one calibration, optimal assignment with capacities."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence
from functools import partial, reduce
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideglass.operators.graph import components
from tideglass.operators.rounds import settled

#: Length of the grams that substring joins look up.
GRAM = 3
#: Fewest items that a round of first_come walks.
LEAST_ROUND = 10


def contains_pairs(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """Distinct (id, needle_id): texts (id, text) that contain the needle of needles (needle_id, needle), which is not empty.

    Each needle is looked up by its rarest gram, an equi-join, and verified by `contains`. Needles shorter than a gram
    are looked up whole, by texts' grams of that length.
    """
    sought = needles.where("needle <> ''").select("needle_id", "needle").distinct()
    grams = lambda c, n: F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda k: F.substring(c, k, n if not isinstance(n, int) else F.lit(n)))
    sizes = [r[0] for r in sought.select(F.least(F.length("needle"), F.lit(GRAM))).distinct().collect()]  # at most GRAM numbers
    none = F.array().cast("array<string>")
    held = [F.when(F.length("text") >= n, grams(F.col("text"), n)).otherwise(none) for n in sizes]
    if not held:
        return texts.select("id").limit(0).crossJoin(sought.select("needle_id").limit(0))
    of_texts = texts.select("id", F.explode(F.array_distinct(F.concat(*held) if len(held) > 1 else held[0])).alias("gram"))
    least = F.least(F.length("needle"), F.lit(GRAM))
    of_needles = sought.select("needle_id", "needle", F.explode(F.array_distinct(grams(F.col("needle"), least))).alias("gram"))
    wanted = of_texts.join(of_needles.select("gram").distinct(), "gram", "left_semi")
    counts = wanted.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = of_needles.join(counts, "gram", "left").groupBy("needle_id", "needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least"))
    found = wanted.join(rarest.where("least.n > 0").select("needle_id", "needle", F.col("least.gram").alias("gram")), "gram").select("id", "needle_id", "needle")
    return found.join(texts.select("id", "text"), "id").where(F.contains("text", "needle")).select("id", "needle_id").distinct()


def _walk(_, items: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    """Items in order, each with the first free entry of its lists; a list's used entries are passed once."""
    lists, used, found = {}, set(), []
    for name, by, place, target in sorted(zip(entries["list"], entries["by"], entries["place"], entries["target"]), key=lambda r: r[:3]):
        lists.setdefault(name, deque()).append((by, place, target))
    for item, names in sorted(zip(items["item"], items["lists"]), key=itemgetter(0)):
        heads = []
        for name in names:
            left = lists.get(name, ())
            while left and left[0][2] in used:
                left.popleft()
            if left:
                heads.append(left[0])
        target = min(heads, key=lambda h: h[:2])[2] if heads else None
        if target is not None:
            used.add(target)
            found.append((item, target))
    return pd.DataFrame(found, columns=["item", "target"]).astype({"item": items["item"].dtype})


def first_come(items: DataFrame, entries: DataFrame, most: int = 100_000) -> DataFrame:
    """(item, target): items in ascending order take, one after another, the target they prefer among those still free in their lists.

    items: item, lists (names). entries: list, by, place, target (a string); the least (by, place) is preferred. A null target satisfies its item
    and is never used up. Items that like the same share lists, so no row is made for an item and a target. A round walks the next
    `most` items (LEAST_ROUND at least) in a task, with as many free entries of each of their lists; used targets, and items whose lists are empty, leave.
    """
    most = max(most, LEAST_ROUND)
    entries = settled(entries.groupBy("list", "by", "target").agg(F.min("place").alias("place")))
    items = settled(items)
    taken = items.select("item", F.lit(None).cast("string").alias("target")).limit(0)
    while True:
        free = entries.select("list").distinct()
        able = items.select("item", F.explode("lists").alias("list")).join(free, "list", "left_semi").groupBy("item").agg(F.collect_list("list").alias("lists"))
        able = settled(able)
        now = settled(able.orderBy("item").limit(most))
        last, n = now.agg(F.max("item"), F.count("*")).first()
        if not n:
            return taken
        asked = now.select(F.explode("lists").alias("list")).distinct()
        place = F.row_number().over(Window.partitionBy("list").orderBy("by", "place"))
        # each item uses up one target at most
        near = entries.join(asked, "list", "left_semi").withColumn("__n", place).where(F.col("__n") <= n).drop("__n")
        one = F.lit(0).alias("one")
        won = settled(now.groupBy(one).cogroup(near.groupBy(one)).applyInPandas(_walk, f"item {dict(items.dtypes)['item']}, target string"))
        taken = taken.unionByName(won)
        if n < most:
            return taken
        items = able.where(F.col("item") > F.lit(last))
        entries = settled(entries.join(won.select("target"), "target", "left_anti"))


def calibration_pairs(machine: DataFrame, gold: DataFrame, most: int = 100_000) -> DataFrame:
    """(item, anchor): the gold anchor that each machine item matches; an anchor is used up by its first item.

    machine: item (its order), change_type, anchor, points; UNCHANGED ones are left out. gold: place (its order), change_type,
    anchor, field, status; only verified and corrected rows count. An item takes the first row of its own type and anchor,
    else the first of its type whose field (or anchor, without a field) occurs in its anchor or points. An item whose
    first row has no anchor matches nothing.
    """
    real = machine.where("change_type <> 'UNCHANGED'").select("item", "change_type", F.coalesce("anchor", F.lit("")).alias("own"), F.concat_ws(" ", F.coalesce("anchor", F.lit("")), F.coalesce("points", F.lit(""))).alias("text"))
    rows = eligible(gold).select("place", "change_type", F.coalesce("anchor", F.lit("")).alias("anchor"), F.when(F.coalesce("field", F.lit("")) != "", F.col("field")).otherwise(F.coalesce("anchor", F.lit(""))).alias("label"))
    name = lambda by, label: F.to_json(F.struct(F.lit(by).alias("by"), "change_type", label.alias("label")))
    kinds = real.select("change_type", "own", "text").distinct()
    anchors = rows.select("change_type", F.trim("anchor").alias("label")).distinct()
    keyed = kinds.withColumn("label", F.trim("own")).join(anchors, ["change_type", "label"]).select("change_type", "own", "text", name(0, F.col("label")).alias("list"))
    labels = rows.select("change_type", "label").distinct().withColumn("needle_id", F.struct("change_type", "label"))
    near = contains_pairs(kinds.select(F.struct("change_type", "text").alias("id"), "text").distinct(), labels.select("needle_id", F.col("label").alias("needle")))
    near = near.where("id.change_type = needle_id.change_type").select("id.change_type", "id.text", "needle_id.label")
    named = kinds.join(near, ["change_type", "text"]).select("change_type", "own", "text", name(1, F.col("label")).alias("list"))
    of_kind = keyed.unionByName(named).groupBy("change_type", "own", "text").agg(F.collect_list("list").alias("lists"))
    items = real.join(of_kind, ["change_type", "own", "text"]).groupBy("item").agg(F.array_distinct(F.flatten(F.collect_list("lists"))).alias("lists"))
    entry = lambda by, label: rows.select(name(by, label).alias("list"), F.lit(by).alias("by"), "place", F.when(F.col("anchor") != "", F.col("anchor")).alias("target"))
    return first_come(items, entry(0, F.trim("anchor")).unionByName(entry(1, F.col("label"))), most).select("item", F.col("target").alias("anchor"))


def eligible(gold: DataFrame) -> DataFrame:
    return gold.where(F.lower("status").isin("verified", "corrected"))


def calibrate(machine: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: matched, gold_total, machine_total, unverified_excluded, precision and recall (null where nothing can be measured)."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    counts = one(calibration_pairs(machine, gold), "matched").crossJoin(one(eligible(gold), "gold_total")).crossJoin(one(machine.where("change_type <> 'UNCHANGED'"), "machine_total")).crossJoin(one(gold, "__all"))
    share = lambda c: F.when((F.col(c) > 0) & (F.col("gold_total") > 0), F.col("matched") / F.col(c))
    return counts.select("matched", "gold_total", "machine_total", (F.col("__all") - F.col("gold_total")).alias("unverified_excluded"), share("machine_total").alias("precision"), share("gold_total").alias("recall"))


# --- optimal assignment ---


def _best_assignment(edges: Sequence[tuple], capacity: int) -> list[tuple]:
    """(owner, item) of the largest total: augmenting paths of greatest gain until none gains. edges: (owner, item, score > 0), which sets the order of ties."""
    by: dict = {}
    for owner, item, score in edges:
        row = by.setdefault(owner, {})
        row[item] = max(score, row.get(item, score))
    held: dict = {}
    load = dict.fromkeys(by, 0)
    while True:
        gain_o = {o: 0.0 for o in by if load[o] < capacity}
        gain_i: dict = {}
        by_item, by_owner, waiting = {}, dict.fromkeys(gain_o), deque(gain_o)
        while waiting:
            owner = waiting.popleft()
            for item, score in by[owner].items():
                gain = gain_o[owner] + score
                if held.get(item) == owner or gain <= gain_i.get(item, -1e300) + 1e-12:
                    continue
                gain_i[item], by_item[item] = gain, owner
                if item in held:
                    holder = held[item]
                    left = gain - by[holder][item]
                    if left > gain_o.get(holder, -1e300) + 1e-12:
                        gain_o[holder], by_owner[holder] = left, item
                        waiting.append(holder)
        free = [i for i in gain_i if i not in held and gain_i[i] > 1e-12]
        if not free:
            return sorted((o, i) for i, o in held.items())
        item = max(free, key=gain_i.get)
        while item is not None:
            owner = by_item[item]
            item_before = by_owner[owner]
            held[item] = owner
            item = item_before
        load[owner] += 1  # the path began at this owner's free slot


def _assign_runs(frames: Iterator[pd.DataFrame], capacity: int) -> Iterator[pd.DataFrame]:
    """Components, each in rows that follow one another, solved one by one; a batch may end within one."""

    def solved(rows: list[tuple]) -> Iterator[tuple]:
        for _, run in groupby(rows, itemgetter(0)):
            edges = sorted(r[1:] for r in run)
            score = {e[:2]: e[2] for e in edges}
            yield from ((o, i, score[o, i]) for o, i in _best_assignment(edges, capacity))

    held, kinds = [], None
    for frame in frames:
        kinds = frame[["owner", "item", "score"]].dtypes
        held += zip(frame["component"], frame["owner"], frame["item"], frame["score"])
        last = next((k for k in range(len(held) - 1, 0, -1) if held[k - 1][0] != held[-1][0]), 0)
        yield pd.DataFrame(solved(held[:last]), columns=kinds.index).astype(kinds)
        held = held[last:]
    if held:
        yield pd.DataFrame(solved(held), columns=kinds.index).astype(kinds)


def auction(edges: DataFrame, capacity: int, epsilon: float) -> DataFrame:
    """(owner, item): a distributed auction over edges (owner, item, score); its total is within epsilon a slot of the largest.

    Each slot without an item bids for the item of highest score less price, by as much as that beats its second choice (going
    without is worth 0) and epsilon more; the highest bid for an item wins, and its holder bids again. Prices begin at 0
    and items never bid for stay there, so unequal sides and slots left open are right. Prices and holders are a table, written
    each round; ties go to the lesser ids.
    """
    edges = edges.checkpoint()
    slots = edges.select("owner").distinct().withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(capacity)))).checkpoint()
    held = edges.select("item", F.col("owner").alias("holder"), F.lit(0).alias("held_slot"), F.lit(0.0).alias("price")).limit(0).checkpoint()
    out = slots.limit(0)
    while True:
        idle = slots.join(held.select(F.col("holder").alias("owner"), F.col("held_slot").alias("slot")), ["owner", "slot"], "left_anti").join(out, ["owner", "slot"], "left_anti")
        # an owner's open slots see the same offers: their best two stand for all, so edges meet prices once an owner
        offers = edges.join(idle.select("owner").distinct(), "owner", "left_semi").join(held.select("item", "price", "holder"), "item", "left")
        offers = offers.where("holder IS NULL OR holder <> owner").withColumn("price", F.coalesce("price", F.lit(0.0))).withColumn("value", F.col("score") - F.col("price"))
        place = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("value"), "item"))
        few = offers.withColumn("place", place).where(F.col("place") <= capacity + 1)
        best = few.groupBy("owner").agg(F.sort_array(F.collect_list(F.struct("place", "item", "price", "value"))).alias("best"))
        # the k-th open slot bids for the k-th item, at the price that leaves it as well off as the next beyond them all
        numbered = idle.withColumn("k", F.row_number().over(Window.partitionBy("owner").orderBy("slot"))).withColumn("open", F.count("*").over(Window.partitionBy("owner")))
        bids = numbered.join(best, "owner", "left").withColumn("own", F.get("best", F.col("k") - 1)).withColumn("next", F.greatest(F.coalesce(F.get("best", F.col("open"))["value"], F.lit(0.0)), F.lit(0.0)))
        bids = settled(bids)
        retired = bids.where("own IS NULL OR own.value <= 0").select("owner", "slot")
        live = bids.where("own.value > 0").select("owner", "slot", F.col("own.item").alias("item"), (F.col("own.price") + F.col("own.value") - F.col("next") + epsilon).alias("bid"))
        if not live.limit(1).count():
            return held.select(F.col("holder").alias("owner"), "item")
        won = live.groupBy("item").agg(F.min(F.struct((-F.col("bid")).alias("least"), F.col("owner").alias("holder"), F.col("slot").alias("held_slot"), F.col("bid").alias("price"))).alias("w")).select("item", "w.holder", "w.held_slot", "w.price")
        out = settled(out.unionByName(retired))
        held = settled(held.join(won.select("item"), "item", "left_anti").unionByName(won))


def assign(edges: DataFrame, capacity: int = 1, epsilon: float = 1e-4, most: int = 2000, within: str | None = None) -> DataFrame:
    """(owner, item, score): at most capacity items for each owner, one owner for each item, of the largest total score. Scores that are not positive don't count.

    edges: owner, item, score. Connected components of up to `most` edges are solved exactly, in a task's memory one at a time;
    larger ones go to the distributed auction, whose total is within epsilon a slot of the largest. within: a column whose
    values share no owner and no item; components are sought only in values of more than `most` edges.
    """
    keys = [within] if within else []
    edges = edges.where("score > 0").groupBy("owner", "item", *keys).agg(F.max("score").cast("double").alias("score")).checkpoint()
    kinds = dict(edges.dtypes)
    solve = lambda rows: rows.select("component", "owner", "item", "score").repartition("component").sortWithinPartitions("component").mapInPandas(partial(_assign_runs, capacity=capacity), f"owner {kinds['owner']}, item {kinds['item']}, score double")
    found, rest = [], edges
    if within:
        sizes = edges.groupBy(within).agg(F.count("*").alias("__n"))
        wide = sizes.where(F.col("__n") > most).select(within)
        found, rest = [solve(edges.join(wide, within, "left_anti").withColumn("component", F.col(within)))], edges.join(wide, within, "left_semi").drop(within)
        if not rest.limit(1).count():
            return found[0]
        rest = rest.checkpoint()
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    component = components(rest.select(node("o", "owner").alias("src"), node("i", "item").alias("dst")))
    labelled = rest.withColumn("node", node("o", "owner")).join(component, "node").drop("node").checkpoint()
    wide = labelled.groupBy("component").agg(F.count("*").alias("__n")).where(F.col("__n") > most)
    found.append(solve(labelled.join(wide, "component", "left_anti")))
    large = labelled.join(wide, "component", "left_semi")
    if large.limit(1).count():
        found.append(auction(large.select("owner", "item", "score"), capacity, epsilon).join(rest, ["owner", "item"]).select("owner", "item", "score"))
    return reduce(DataFrame.unionByName, found)
