"""Channels: subscriptions with history, logs with a capped length and a time to live, and the router of think and code spans.

A channel's log is a folder of Parquet files of events (key, event_index, chunk, at) that only grows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tideglass.sources.files import replace_partitions

#: Events that a log keeps of a key, seconds that it keeps a key after its last event.
MAX_LENGTH, TTL_SECONDS = 10_000, 86_400
#: The tags of deep thinking, and what begins code.
THINK, END_THINK = "<think>", "</think>"
CODE = re.compile(r"(?:代码|Code)[：:]\s*```")
_CODE_BEGUN = re.compile(r"(?:代|C|Co|Cod|(?:代码|Code)(?:[：:]\s*`{0,2})?)\Z")


# --- subscriptions ---


def subscribe(spark: SparkSession, log: str, schema: T.StructType | str, start: int = 0, index: str = "event_index") -> DataFrame:
    """A stream of the log's events from an absolute index on: history first, then what is appended.

    Both are files of one folder, which the stream's checkpoint counts, so no event can fall between history and live, and
    a restart goes on where it stopped. An index older than the oldest event that is kept starts with that.
    """
    return spark.readStream.schema(schema).parquet(log).where(F.col(index) >= start)


def deliver(events: DataFrame, to: str, checkpoint: str, keys: tuple[str, ...] = ("event_index",)):
    """The writer that delivers a stream's events exactly once: each batch in the order of keys, as a partition that a repeated delivery replaces."""

    def one(batch: DataFrame, batch_id: int) -> None:
        if batch.limit(1).count():
            replace_partitions(batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).repartitionByRange(*keys).sortWithinPartitions(*keys), to, "batch_id")

    return events.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)


# --- capped logs ---


def capped(events: DataFrame, key: str, order: str, at: str, now: Column, most: int = MAX_LENGTH, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Batch: the newest `most` events of each key; none of a key whose last event is ttl_seconds old."""
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    rows = events.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= most)
    last = events.groupBy(F.col(key).alias("__key")).agg(F.max(at).alias("__last"))
    alive = last.where(F.col("__last") + F.make_dt_interval(secs=F.lit(ttl_seconds)) > now)
    return rows.join(alive, F.col(key).eqNullSafe(F.col("__key")), "left_semi").drop("__n")


def capped_stream(events: DataFrame, key: str, order: str, at: str, most: int = MAX_LENGTH, ttl_seconds: int = TTL_SECONDS, late: str = "0 seconds") -> DataFrame:
    """Streams: (key, ids, expired) of what each key's log holds after a batch; once the watermark passes its last event by ttl_seconds, the key goes, with a row that says so."""
    kinds = dict(events.dtypes)

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({key: [k[0]], "ids": [""], "expired": [True]})
            return
        ids, last = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        for frame in frames:
            ids += [int(x) for x in frame[order]]
            last = max(last, int(frame[at].max().timestamp() * 1000))
        ids = sorted(ids)[-most:]
        state.update((ids, last))
        state.setTimeoutTimestamp(max(last + ttl_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]], "ids": [",".join(map(str, ids))], "expired": [False]})

    rows = events.withWatermark(at, late).select(key, order, at)
    return rows.groupBy(key).applyInPandasWithState(update, f"{key} {kinds[key]}, ids string, expired boolean", "ids array<bigint>, last bigint", "update", GroupStateTimeout.EventTimeTimeout)


# --- think and code spans ---


class Router:
    """Cuts a text that comes in pieces into spans: deep_thinking within think tags; else thinking, and code from a code marker on.

    Only what may be the beginning of a tag or marker waits for the next piece, so any cut of a text gives the same
    spans. The tags themselves go; the code marker belongs to the code.
    """

    def __init__(self, within: bool = False, code: bool = False, waiting: str = "", normal: str = "") -> None:
        self.within, self.code, self.waiting, self.normal = within, code, waiting, normal

    def feed(self, piece: str) -> list[tuple[str, str]]:
        out: list[tuple[str, str]] = []
        text = self.waiting + piece
        while True:
            tag = END_THINK if self.within else THINK
            at = text.find(tag)
            if at < 0:
                break
            self._pass(text[:at], out)
            text, self.within = text[at + len(tag) :], not self.within
        kept = next((n for n in range(min(len(tag) - 1, len(text)), 0, -1) if text.endswith(tag[:n])), 0)
        self._pass(text[: len(text) - kept], out)
        self.waiting = text[len(text) - kept :]
        return out

    def _pass(self, text: str, out: list[tuple[str, str]]) -> None:
        if self.within or self.code:
            out += [("deep_thinking" if self.within else "code", text)] if text else []
            return
        text = self.normal + text
        if found := CODE.search(text):
            out += [(kind, t) for kind, t in (("thinking", text[: found.start()]), ("code", text[found.start() :])) if t]
            self.normal, self.code = "", True
            return
        begun = _CODE_BEGUN.search(text)
        end = begun.start() if begun else len(text)
        out += [("thinking", text[:end])] if end else []
        self.normal = text[end:]

    def end(self) -> list[tuple[str, str]]:
        """What still waits, at the end of the text."""
        out: list[tuple[str, str]] = []
        self._pass(self.waiting, out)
        out += [("thinking", self.normal)] if self.normal else []
        self.waiting = self.normal = ""
        return out


def joined(spans: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Neighbours of one kind as one span."""
    out: list[list[str]] = []
    for kind, text in spans:
        if out and out[-1][0] == kind:
            out[-1][1] += text
        else:
            out.append([kind, text])
    return [tuple(x) for x in out]


def _route(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Sorted pieces (key, text) to spans; what a task holds is a batch and the waiting end of one key."""
    own, router, place = None, None, 0

    def rows(spans: list[tuple[str, str]]) -> list[tuple]:
        nonlocal place
        found = [(own, place + n, kind, text) for n, (kind, text) in enumerate(joined(spans))]
        place += len(found)
        return found

    for batch in batches:
        out: list[tuple] = []
        for k, text in zip(batch[key], batch["text"]):
            if router is None or k != own:
                out += rows(router.end()) if router else []
                own, router, place = k, Router(), 0
            out += rows(router.feed(text or ""))
        yield pd.DataFrame(out, columns=[key, "place", "kind", "text"])
    if router:
        yield pd.DataFrame(rows(router.end()), columns=[key, "place", "kind", "text"])


def route(pieces: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Batch: (key, place, kind, text): the spans of each key's pieces in order; neighbours may be of one kind, joining them gives the same for any cut."""
    kinds = dict(pieces.dtypes)
    rows = pieces.where(F.col(key).isNotNull()).select(key, order, F.col(text).alias("text")).repartition(key).sortWithinPartitions(key, order).select(key, "text")
    return rows.mapInPandas(partial(_route, key=key), f"{key} {kinds[key]}, place bigint, kind string, text string")


def route_stream(pieces: DataFrame, key: str, order: str, text: str, last: str) -> DataFrame:
    """Streams: (key, place, kind, text) as pieces arrive, those of a batch in order; last: the column that is true for the last piece of a key. The state of a key is the waiting end of its text and two modes."""
    kinds = dict(pieces.dtypes)

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        within, code, waiting, normal, place = state.get if state.exists else (False, False, "", "", 0)
        router, spans, over = Router(within, code, waiting, normal), [], False
        batch = pd.concat(list(frames)).sort_values(order)
        for piece, end in zip(batch[text], batch[last]):
            spans += router.feed(piece or "")
            over = over or bool(end)
        spans = joined(spans + (router.end() if over else []))
        state.remove() if over and state.exists else None
        if not over:
            state.update((router.within, router.code, router.waiting, router.normal, place + len(spans)))
        yield pd.DataFrame([(k[0], place + n, kind, t) for n, (kind, t) in enumerate(spans)], columns=[key, "place", "kind", "text"])

    schema = f"{key} {kinds[key]}, place bigint, kind string, text string"
    return pieces.groupBy(key).applyInPandasWithState(update, schema, "within boolean, code boolean, waiting string, normal string, place bigint", "append", GroupStateTimeout.NoTimeout)
