"""Splitters and chunkers: paragraphs, lines, CSV, JSON, Markdown, sentences."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from tideglass.operators.splitters import SPACES, plain_chunks

#: Characters of pieces that explode_with holds before it hands them on.
PIECES = 1_000_000


def paragraph_chunks(text: Column, size: int = 600) -> Column:
    """Paragraphs (between blank lines) packed to chunks of at most `size` characters, two counted for each join; longer ones are cut hard.

    A fold over the paragraphs, inside the JVM.
    """
    trimmed = F.filter(F.transform(F.split(text, r"\n\s*\n"), F.trim), lambda p: p != "")
    cut = F.flatten(F.transform(trimmed, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / size).cast("int")), lambda i: F.substring(p, i * size + 1, F.lit(size)))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, p: Column) -> Column:
        joined = F.concat(acc["open"], F.lit("\n\n"), p)
        return (
            F.when(acc["open"] == "", F.struct(acc["done"].alias("done"), p.alias("open")))
            .when(F.length(joined) <= size, F.struct(acc["done"].alias("done"), joined.alias("open")))
            .otherwise(F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), p.alias("open")))
        )

    return F.aggregate(cut, start, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def line_packs(text: Column, size: int) -> Column:
    """Lines (with their ends) packed greedily to at most `size` characters; a longer line stands alone."""
    lines = F.regexp_extract_all(text, F.lit(r"([^\n]*\n|[^\n]+$)"), F.lit(1))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, line: Column) -> Column:
        fits = (acc["open"] == "") | (F.length(acc["open"]) + F.length(line) <= size)
        return F.when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["open"], line).alias("open"))).otherwise(F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), line.alias("open")))

    return F.aggregate(lines, start, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def near_equal_parts(n: Column, parts: int) -> Column:
    """[(first, size)] of `parts` slices of n things, sizes apart by one at most; empty slices left out."""
    size = lambda i: F.floor(n / parts) + F.when(i < n % parts, 1).otherwise(0)
    first = lambda i: i * F.floor(n / parts) + F.least(i.cast("bigint"), n % parts)
    every = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.struct(first(i).alias("first"), size(i).alias("size")))
    return F.filter(every, lambda s: s["size"] > 0)


def _cut_json(text: str, most: int) -> list[str]:
    """text cut after the last comma of depth one, outside strings, that leaves at most `most` characters; from where there is none, as plain text.

    Depth counts from the place of the last cut, so that what follows the first cut of a flat object is plain.
    """
    parts, start = [], 0
    while len(text) - start > most:
        depth, quoted, escaped, cut = 0, False, False, 0
        for i in range(start, start + most):
            c = text[i]
            if escaped or c == "\\":
                escaped = not escaped
            elif c == '"':
                quoted = not quoted
            elif not quoted:
                depth += (c in "{[") - (c in "}]")
                if c == "," and depth == 1:
                    cut = i + 1
        if not cut:
            return parts + plain_chunks(text[start:], most)
        parts.append(text[start:cut])
        start = SPACES.match(text, cut).end()
    return [*parts, text[start:]] if start < len(text) else parts


def json_chunks(text: str, most: int = 1024) -> list[str]:
    """`key: value` of each key of an object, the items of an array, or a plain value, without spaces between tokens, each cut to at most `most` characters; what is no JSON as plain text."""
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return plain_chunks(text, most)
    dump = lambda v: json.dumps(v, ensure_ascii=False, separators=(",", ":"))
    rows = [f"{k}: {dump(v)}" for k, v in value.items()] if isinstance(value, dict) else map(dump, value) if isinstance(value, list) else [dump(value)]
    return [p for r in rows for p in _cut_json(r, most)]


def markdown_blocks(text: str) -> list[tuple[str, str, str]]:
    """(id, heading path, block) of the paragraphs and list items under each heading."""
    path: list[tuple[int, str]] = []
    out, held = [], []

    def flush() -> None:
        if held:
            block, at = "\n".join(held), " > ".join(t for _, t in path)
            out.append((hashlib.sha256(f"{at}\n{block}".encode()).hexdigest()[:16], at, block))
            held.clear()

    for line in text.split("\n"):
        heading = re.match(r"(#{1,6})\s+(.*)", line)
        if heading:
            flush()
            level = len(heading[1])
            path[:] = [p for p in path if p[0] < level] + [(level, heading[2].strip())]
        elif not line.strip():
            flush()
        else:
            if re.match(r"\s*([-*+]|\d+\.)\s", line):
                flush()
            held.append(line.strip())
    flush()
    return out


def cut_sentence(text: Column, most: int) -> Column:
    """text up to `most` characters: to the last sentence end in its second half, else to the last space beyond 60 %, else cut."""
    head = F.substring(text, 1, most)
    sentence, word = F.regexp_extract(head, r"(?s)^(.*[.!?。！？])", 1), F.regexp_extract(head, r"(?s)^(.*)\s", 1)
    return F.when(F.length(text) <= most, text).when(F.length(sentence) >= most * 0.5, sentence).when(F.length(word) >= most * 0.6, word).otherwise(head)


def explode_with(rows: DataFrame, column: str, split, schema: str) -> DataFrame:
    """Each row's text split by a Python function, in Arrow batches: (all other columns, chunk_idx, fields of schema). Pieces go on by about PIECES characters, so that a worker's memory doesn't follow its batch."""
    others = [c for c in rows.columns if c != column]
    made = StructType([*rows.select(*others).schema.fields, StructField("chunk_idx", IntegerType()), *StructType.fromDDL(schema).fields])
    kinds = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, pieces, size = [], [], 0
            for row, text in enumerate(batch.column(column)):
                for k, piece in enumerate(split(text.as_py() or "")):
                    at.append(row)
                    pieces.append((k, *(piece if isinstance(piece, tuple) else (piece,))))
                    size += sum(len(p) for p in pieces[-1] if isinstance(p, str))
                if at and (size > PIECES or row == batch.num_rows - 1):
                    whole = [batch.column(c).take(pa.array(at)) for c in others]
                    yield pa.RecordBatch.from_arrays(whole + [pa.array(values, kinds.field(len(whole) + k).type) for k, values in enumerate(zip(*pieces))], schema=kinds)
                    at, pieces, size = [], [], 0

    return rows.mapInArrow(run, made)
