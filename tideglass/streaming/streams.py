"""Stream operators, each usable on a streaming or a plain DataFrame unless it says otherwise."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def per_minute(events: DataFrame, key: str, at: str = "ts", late: str | None = None) -> DataFrame:
    """Events of each key in tumbling minutes; late: watermark of a stream."""
    events = events.withWatermark(at, late) if late else events
    return events.groupBy(key, F.window(at, "1 minute").alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("minute"), "n")


def rate_limited(events: DataFrame, key: str, limit: int, at: str = "ts", order: str = "event_id") -> DataFrame:
    """events with allowed: whether an event is among the first `limit` of its key's minute. Batch only."""
    window = Window.partitionBy(key, F.date_trunc("minute", at)).orderBy(at, order)
    return events.withColumn("allowed", F.row_number().over(window) <= limit)


def windowed(events: DataFrame, key: str, size: str, slide: str, at: str = "ts", late: str | None = None) -> DataFrame:
    """Counts and sums of `value` in sliding windows."""
    events = events.withWatermark(at, late) if late else events
    return events.groupBy(key, F.window(at, size, slide).alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(key, F.col("w.start").alias("start"), "n", "total")


def sessions(events: DataFrame, key: str, gap: str, at: str = "ts", late: str | None = None) -> DataFrame:
    """Runs of events of a key without a pause of `gap`."""
    events = events.withWatermark(at, late) if late else events
    return events.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def idempotent(events: DataFrame, keys: list[str], at: str, ttl: str) -> DataFrame:
    """Streams only: the first event of each key, repeated ones dropped for at least ttl."""
    return events.withWatermark(at, ttl).dropDuplicatesWithinWatermark(keys)


def replay(events: DataFrame, key: str, after: int) -> DataFrame:
    """The events of a log after an id, in order of ids."""
    return events.where(F.col(key) > after).orderBy(key)


def ring_buffer(events: DataFrame, key: str, most: int, most_bytes: int, payload: str, order: str) -> DataFrame:
    """Batch: the newest events of each key that fit a number and a size; the newest one always stays."""
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    used = F.sum(F.octet_length(payload)).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    rows = events.withColumn("__n", F.row_number().over(newest)).withColumn("__used", used)
    return rows.where((F.col("__n") == 1) | ((F.col("__n") <= most) & (F.col("__used") <= most_bytes))).drop("__n", "__used")


def ring_buffer_stream(events: DataFrame, key: str, most: int, most_bytes: int, payload: str, order: str) -> DataFrame:
    """Streams: (key, ids) of what each key's buffer holds after a batch, in custom state."""
    kinds = dict(events.dtypes)

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, sizes = (list(x) for x in state.get) if state.exists else ([], [])
        for frame in frames:
            for row in frame.sort_values(order).itertuples(index=False):
                ids.append(int(getattr(row, order)))
                sizes.append(len((getattr(row, payload) or "").encode()))
                while len(ids) > 1 and (len(ids) > most or sum(sizes) > most_bytes):
                    ids.pop(0)
                    sizes.pop(0)
        state.update((ids, sizes))
        yield pd.DataFrame({key: [k[0]], "ids": [",".join(map(str, ids))]})

    return events.groupBy(key).applyInPandasWithState(update, f"{key} {kinds[key]}, ids string", "ids array<bigint>, sizes array<bigint>", "update", GroupStateTimeout.NoTimeout)


def tag_spans(chunks: DataFrame, key: str, order: str, text: str, tag: str = "think") -> DataFrame:
    """(key, kind, text): what lies inside and outside <tag> ... </tag> in the joined chunks of a key, in order. Batch form of an incremental parser."""
    joined = chunks.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda c: c[text]), "").alias("all"))
    parts = F.transform(F.split("all", f"<{tag}>"), lambda p, i: F.when(i == 0, F.array(F.struct(F.lit("text").alias("kind"), p.alias("text")))).otherwise(
        F.transform(F.split(p, f"</{tag}>", 2), lambda q, j: F.struct(F.when(j == 0, tag).otherwise("text").alias("kind"), q.alias("text")))))
    rows = joined.select(key, F.posexplode(F.filter(F.flatten(parts), lambda s: s["text"] != "")).alias("place", "s"))
    return rows.select(key, "place", "s.kind", "s.text")


def claim_leases(jobs: DataFrame, now, worker: str, n: int, seconds: int) -> DataFrame:
    """The n due jobs (pending, or leased with the lease over) in order of due_at, with a new lease."""
    due = jobs.where((F.col("due_at") <= now) & (F.col("lease_until").isNull() | (F.col("lease_until") <= now)))
    return due.orderBy("due_at", "job_id").limit(n).withColumns({"owner": F.lit(worker), "lease_until": now + F.make_dt_interval(secs=F.lit(seconds))})


def progress(steps: DataFrame, key: str) -> DataFrame:
    """Per key: processed steps, never more than the total."""
    return steps.groupBy(key).agg(F.least(F.sum("done"), F.max("total")).cast("bigint").alias("processed"), F.max("total").alias("total"))
