"""Conversation repair: the cheapest edits that make role sequences legal, by a bidirectional tight-arc DAG.

A conversation is legal if its role initials read `(s?(ua)+)?`. A node of the DAG is (rows behind, state), the states
being: nothing kept yet, a system row, a user row, an assistant row. Arcs are the edits Keep, Rerole, Delete and
Insert with their costs. Forward and backward minimum costs together tell the tight arcs, those on some cheapest path;
a walk of the set of frontier states takes the least letter among the tight arcs at each step.

Slabs of rows are judged apart: each gives its min-plus matrix of costs from state to state. The matrices stream past
once backwards and once forwards for the costs at slab borders; then every slab is walked on its own for each state it
may be entered in, and the last pass, a stream of the texts, strings these walks together. So no conversation is held
in a task, however long: one text, one slab and its edit letters are. What is sequential by nature stays so: the
texts of a conversation pass one hash in order, and its audit is one value (2 GB at most, as Spark's strings).

Definitions. Rows of a conversation go by turn (nulls first), then role, then the digest of the text; rows equal in all
of these are interchangeable. Null roles and texts count as one space, null conv_ids are one conversation. Repeated
rows are duplicates. Conversations without rows come back with zeros if `ids` names them. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideglass.llm._common import staged

#: The costs of the edits, and what a truncated row costs that is not deleted.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: White space of the texts.
SPACE = " \t\n\x0b\x0c\r"
#: Sums of costs from here on stand for "no way".
_NEVER = 1 << 60
#: States: nothing kept, s, u, a. The state that a kept initial of u, a, s leads to from each state, and that of a row put to the one fitting role.
_KEPT = {(0, 0): 2, (1, 0): 2, (3, 0): 2, (2, 1): 3, (0, 2): 1}
_FIT = (2, 2, 3, 2)
_ROLE = {2: "user", 3: "assistant"}
#: Initials as numbers; others are 3. A row's code is initial + 4 * fault; faults: none, truncated, blank, duplicate.
_INITIAL = {"u": 0, "a": 1, "s": 2}
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
#: Rows of a slab, and copies of one row that are handled at once.
_SLAB_BITS, _COPIES = 10, 4096
#: Inserts that end a conversation from each state.
_TAIL = ("", "II", "I", "")


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the rows after damage by crc32(conv_id:turn) % 20; 0 drops, 1 empties, 2 takes `[.!?]` out, 3 repeats, 4 sets the role to user. Nulls in the hashed text, in roles and in texts are one space."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), or_space("role").alias("role"), or_space("text").alias("text"), kind.alias("__kind")).where("__kind <> 0")
    text = F.when(F.col("__kind") == 1, "").when(F.col("__kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("__kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("__kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("__copy")).drop("__copy")


def _normal(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without nulls in the last two, and the digest of the text."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), or_space("role").alias("role"), or_space("text").alias("text")).withColumn("digest", F.unhex(F.md5("text")))


def _state_of(text: Column) -> Column:
    """0 sound, 1 truncated, 2 blank."""
    end = F.rtrim(text, F.lit(SPACE))
    return F.when(end == "", 2).when(F.right(end, F.lit(1)).isin(".", "!", "?"), 0).otherwise(1)


def _edits(code: int) -> list[tuple[int, int, int, str]]:
    """Arcs (from, to, cost, letter) over a row of this code."""
    initial, fault = code % 4, code // 4
    arcs = [(s, s, DELETE, "D") for s in range(4)]
    if fault < 2:
        extra = TRUNCATED * fault
        arcs += [(s, t, KEEP + extra, "K") for (s, i), t in _KEPT.items() if i == initial]
        arcs += [(s, _FIT[s], REROLE + extra, "R") for s in range(4)]
    return arcs


_ARCS = [_edits(code) for code in range(16)]
_INSERTS = [(s, _FIT[s], INSERT, "I") for s in range(4)]


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The min-plus product of matrices."""
    return np.minimum((a[:, :, None] + b[None]).min(axis=1), _NEVER)


def _step_matrices() -> tuple[np.ndarray, np.ndarray]:
    """Costs of any inserts, and, for each code, of inserts and then one row."""
    one = np.full((4, 4), _NEVER)
    np.fill_diagonal(one, 0)
    for s, t, cost, _ in _INSERTS:
        one[s, t] = min(one[s, t], cost)
    closure = _times(_times(one, one), _times(one, one))
    steps = []
    for arcs in _ARCS:
        row = np.full((4, 4), _NEVER)
        for s, t, cost, _ in arcs:
            row[s, t] = min(row[s, t], cost)
        steps.append(_times(closure, row))
    return closure, np.array(steps)


_CLOSURE, _STEP = _step_matrices()
#: What is left to pay behind the last row, from each state.
_END = np.minimum(_CLOSURE[:, 0] + np.array([0, _NEVER, _NEVER, _NEVER]), _CLOSURE[:, 3])


def _walk(codes: bytes, entry: list[int], leave: list[int]) -> list[tuple[int, int, str]]:
    """(entry state, exit state, letters) of the cheapest path of least letters, for each state that a cheapest path may enter in.

    entry: costs so far by state; leave: costs to go behind the last row.
    """
    n = len(codes)
    back = [list(leave)]  # costs to go behind each row, from the last
    for code in reversed(codes):
        step, after = _STEP[code], back[-1]
        back.append(np.minimum((step + np.array(after)).min(axis=1), _NEVER).tolist())
    back.reverse()
    ahead = [list(entry)]  # costs so far in front of each row, inserts there included
    ahead[0] = np.minimum((np.array(entry)[:, None] + _CLOSURE).min(axis=0), _NEVER).tolist()
    front = np.array(entry)
    for code in codes:
        front = np.minimum((front[:, None] + _STEP[code]).min(axis=0), _NEVER)
        ahead.append(np.minimum((front[:, None] + _CLOSURE).min(axis=0), _NEVER).tolist())
    total = min(a + b for a, b in zip(entry, back[0]))

    def tight(i: int, s: int, cost: int, j: int, t: int) -> bool:
        return ahead[i][s] + cost + back[j][t] == total

    out = []
    for start in range(4):
        if entry[start] + back[0][start] != total:
            continue
        frontier, letters, i = {start}, [], 0
        while i < n:
            found: dict[str, set[int]] = {}
            for s in frontier:
                for a, t, cost, letter in _ARCS[codes[i]]:
                    if a == s and tight(i, s, cost, i + 1, t):
                        found.setdefault(letter, set()).add(t)
                t = _FIT[s]
                if tight(i, s, INSERT, i, t):
                    found.setdefault("I", set()).add(t)
            letter = min(found)
            frontier = found[letter]
            letters.append(letter)
            i += letter != "I"
        out.append((start, min(frontier), "".join(letters)))
    return out


_SEGMENT = "start bigint, turn bigint, role string, digest binary, codes binary, costs array<bigint>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, low bigint, high bigint, n_turns bigint, first_turn bigint, last_turn bigint"


def _segments(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows (slab, place, mark, conv_id, turn, role, digest, state, n) in order to one row for each conversation of a slab; a mark comes before the row that is the first of its role and text."""
    names = ["conv_id", *(x.split()[0] for x in _SEGMENT.split(", "))]
    types = [kind, pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int64()), *[pa.int64()] * 4, *[pa.string()] * 2, *[pa.int64()] * 5]
    done: list[tuple] = []
    open_: dict | None = None
    marked = None

    def close() -> None:
        if open_:
            o = open_
            done.append((o["conv_id"], o["start"], o["turn"], o["role"], o["digest"], bytes(o["codes"]), o["costs"].ravel().tolist(), *o["counts"], o["illegal"], o["first"], o["last"], o["low"], o["high"], o["n_turns"], o["first_turn"], o["last_turn"]))

    def flush() -> pa.RecordBatch:
        columns = list(zip(*done)) if done else [[] for _ in names]
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
        done.clear()
        return out

    for batch in batches:
        for slab, place, mark, conv_id, turn, role, digest, state, n in zip(*(c.to_pylist() for c in batch.columns)):
            if mark == 0:
                marked = place
                continue
            initial = role[:1]
            if not open_ or open_["slab"] != slab or open_["conv_id"] != conv_id:
                close()
                open_ = {"slab": slab, "conv_id": conv_id, "start": place, "turn": turn, "role": role, "digest": digest, "codes": bytearray(), "costs": None, "counts": [0, 0, 0], "illegal": -1, "first": initial, "last": None,
                         "low": None, "high": None, "n_turns": 0, "first_turn": turn, "last_turn": None}
            o = open_
            base = _INITIAL.get(initial, 3)
            if state == 2:
                codes = bytes([base + 8]) * n
                o["counts"][0] += n
            else:
                fresh = marked == place
                codes = bytes([base + 4 * state]) * fresh + bytes([base + 12]) * (n - fresh)
                o["counts"][1] += n - fresh
                o["counts"][2] += state * fresh
            o["codes"] += codes
            o["illegal"] += (o["last"], initial) not in _LEGAL if o["illegal"] >= 0 else 1
            o["illegal"] += n - 1  # of two equal rows
            o["last"] = initial
            if turn is not None:
                o["n_turns"] += o["last_turn"] != turn
                o["low"], o["high"] = turn if o["low"] is None else o["low"], turn
            o["last_turn"] = turn
            for code in codes:
                o["costs"] = _STEP[code] if o["costs"] is None else _times(o["costs"], _STEP[code])
        if len(done) >= 4096:
            yield flush()
    close()
    yield flush()


def _borders(batches: Iterator[pa.RecordBatch], forward: bool) -> Iterator[pa.RecordBatch]:
    """Segments of each conversation in order (forward) or the other way round, with the costs so far at their entry, or those to go at their exit."""
    own = vector = None
    for batch in batches:
        found = []
        for conv_id, costs in zip(batch.column(0).to_pylist(), batch.column("costs").to_pylist()):
            if vector is None or conv_id != own:
                own, vector = conv_id, np.array([0, _NEVER, _NEVER, _NEVER]) if forward else _END
            found.append(vector.tolist())
            matrix = np.array(costs).reshape(4, 4)
            vector = np.minimum((vector[:, None] + matrix).min(axis=0) if forward else (matrix + vector).min(axis=1), _NEVER)
        column = pa.array(found, pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "entry" if forward else "leave"])


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with their walks (entry state, exit state, letters) and the cost of the cheapest path through them."""
    kind = pa.list_(pa.struct([("entered", pa.int32()), ("left", pa.int32()), ("letters", pa.string())]))
    for batch in batches:
        known: dict[tuple, list] = {}
        found, totals = [], []
        for codes, costs, entry, leave in zip(*(batch.column(c).to_pylist() for c in ("codes", "costs", "entry", "leave"))):
            key = (codes, tuple(entry), tuple(leave))
            if key not in known:
                known[key] = [dict(zip(("entered", "left", "letters"), w)) for w in _walk(*key)]
            found.append(known[key])
            totals.append(int((np.array(entry)[:, None] + np.array(costs).reshape(4, 4) + np.array(leave)).min()))
        keep = [n for n in batch.schema.names if n not in ("codes", "costs", "entry", "leave")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(totals, pa.int64()), pa.array(found, kind)], [*keep, "cost", "walks"])


class _Conversation:
    """One conversation of the last pass: counts, the letters that wait, and where the roles stand."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.counts, self.cost, self.illegal = conv_id, [0, 0, 0], 0, 0
        self.low = self.high = self.last = self.last_turn = None
        self.n_turns, self.left, self.state, self.audit, self.waiting = 0, 0, 0, [], deque()
        self.hash, self.rows = hashlib.sha256(), 0

    def take(self, s: dict) -> None:
        if self.audit:
            self.illegal += (self.last, s["first"]) not in _LEGAL
            self.n_turns -= s["first_turn"] is not None and s["first_turn"] == self.last_turn
        self.last, self.last_turn, self.cost = s["last"], s["last_turn"], s["cost"]
        self.counts = [a + s[k] for a, k in zip(self.counts, ("blank", "duplicate", "truncated"))]
        self.illegal += s["illegal"]
        self.n_turns += s["n_turns"]
        if s["low"] is not None:
            self.low, self.high = s["low"] if self.low is None else self.low, s["high"]
        walk = next(w for w in s["walks"] if w["entered"] == self.left)
        self.left = walk["left"]
        self.audit.append(walk["letters"])
        self.waiting.extend(walk["letters"])

    def put(self, role: str, text: bytes) -> None:
        self.hash.update((b"\n" if self.rows else b"") + role.encode() + b":" + text)
        self.rows += 1

    def insert(self) -> tuple[str, str, bytes]:
        self.state = _FIT[self.state]
        self.put(_ROLE[self.state], b"")
        return "I", _ROLE[self.state], b""

    def edit(self, role: str, text: bytes) -> Iterator[tuple[str, str, bytes]]:
        """The repaired rows that this row brings: inserted ones, then itself unless deleted."""
        while (letter := self.waiting.popleft()) == "I":
            yield self.insert()
        if letter == "D":
            return
        self.state = _FIT[self.state] if letter == "R" else _KEPT[self.state, _INITIAL[role[:1]]]
        role = _ROLE[self.state] if letter == "R" else role
        self.put(role, text)
        yield letter, role, text

    def end(self) -> Iterator[tuple[str, str, bytes]]:
        tail = _TAIL[self.state]
        if self.audit:
            self.audit.append(tail)
            yield from (self.insert() for _ in tail)

    def digest(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.n_turns
        return (self.conv_id, gaps, *self.counts, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


_DIGEST = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_REPAIRED = "position bigint, edit string, role string, text string"


def _string(batches: Iterator[pa.RecordBatch], kind: pa.DataType, digests: bool) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, role, text, segment) in order, a conversation's marker first, segments before their texts, to digests or repaired rows."""
    if digests:
        types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        names = ["conv_id", *(x.split()[0] for x in _DIGEST.split(", "))]
    else:
        types = [kind, pa.int64(), pa.string(), pa.string(), pa.string()]
        names = ["conv_id", *(x.split()[0] for x in _REPAIRED.split(", "))]
    done: list[tuple] = []
    size = 0
    now: _Conversation | None = None

    def flush() -> pa.RecordBatch:
        columns = list(zip(*done)) if done else [[] for _ in names]
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
        done.clear()
        return out

    def put(rows: Iterator[tuple[str, str, bytes]]) -> None:
        nonlocal size
        for letter, role, text in rows:
            if not digests:
                done.append((now.conv_id, now.rows - 1, letter, role, text.decode()))
                size += len(text) + 64

    def close() -> None:
        nonlocal size
        if now:
            put(now.end())
            if digests:
                done.append(row := now.digest())
                size += len(row[-2]) + 200

    for batch in batches:
        for conv_id, role, text, segment in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
            if not now or now.conv_id != conv_id:
                close()
                now = _Conversation(conv_id)
            if segment.is_valid:
                now.take(segment.as_py())
            elif role is not None:
                put(now.edit(role, text.as_py()))
            if size > 1 << 24:
                yield flush()
                size = 0
    close()
    yield flush()


def _run(rows: DataFrame, ids: DataFrame, digests: bool) -> DataFrame:
    rows, kind = _normal(rows), rows.schema["conv_id"].dataType
    arrow = _arrow_type(kind)
    field = f"conv_id {kind.simpleString()}"
    state = _state_of(F.col("text"))
    # rows equal in all columns meet here, as a number, so that none of them can crowd a slab
    compact = rows.select("conv_id", "turn", "role", "digest", state.alias("state")).groupBy("conv_id", "turn", "role", "digest", "state").agg(F.count("*").alias("n"))
    compact = compact.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) DIV {_COPIES}"))))
    compact = compact.withColumn("n", F.least(F.col("n") - F.col("chunk") * _COPIES, F.lit(_COPIES)))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest"), F.asc("chunk")]
    placed = staged(compact.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    slab = F.shiftright("place", _SLAB_BITS).alias("slab")
    firsts = placed.groupBy("conv_id", "role", "digest").agg(F.min("place").alias("place")).select(slab, "place", F.lit(0).alias("mark"))
    dealt = placed.select(slab, "place", F.lit(1).alias("mark"), "conv_id", "turn", "role", "digest", "state", "n").unionByName(firsts, allowMissingColumns=True)
    dealt = dealt.repartition("slab").sortWithinPartitions("slab", "place", "mark")
    segments = staged(dealt.mapInArrow(lambda b: _segments(b, arrow), f"{field}, {_SEGMENT}"))
    back = segments.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("start")).mapInArrow(lambda b: _borders(b, False), f"{field}, {_SEGMENT}, leave array<bigint>")
    both = back.repartition("conv_id").sortWithinPartitions("conv_id", "start").mapInArrow(lambda b: _borders(b, True), f"{field}, {_SEGMENT}, leave array<bigint>, entry array<bigint>")
    kept = _SEGMENT.replace("codes binary, costs array<bigint>, ", "")
    walks = both.repartition("start").mapInArrow(_walks, f"{field}, {kept}, cost bigint, walks array<struct<entered: int, left: int, letters: string>>")
    segment = F.struct("blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "n_turns", "first_turn", "last_turn", "cost", "walks").alias("segment")
    heads = walks.select("conv_id", F.lit(1).alias("__lead"), "turn", "role", "digest", F.lit(0).alias("__kind"), "start", segment)
    texts = rows.select("conv_id", F.lit(1).alias("__lead"), "turn", "role", "digest", F.lit(1).alias("__kind"), F.col("text").cast("binary").alias("text"))
    marks = ids.select("conv_id").distinct().select("conv_id", F.lit(0).alias("__lead"))
    stream = heads.unionByName(texts, allowMissingColumns=True).unionByName(marks, allowMissingColumns=True)
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", "__lead", F.asc_nulls_first("turn"), "role", "digest", "__kind", "start")
    stream = stream.select("conv_id", F.when(F.col("__kind") == 1, F.col("role")).alias("role"), "text", "segment")
    return stream.mapInArrow(lambda b: _string(b, arrow, digests), f"{field}, {_DIGEST if digests else _REPAIRED}")


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def audit(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row for each conv_id of rows (conv_id, turn, role, text) and of ids: its faults, the least cost, the edit letters and the hash of the repaired conversation."""
    return _run(rows, rows if ids is None else ids, True)


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text): the repaired conversations, row by row; edit is K, R or I."""
    return _run(rows, rows, False)
