"""Splitters by size of plain text, JSON arrays, Markdown and XML; whole documents, sections, sessions, chunks that represent a document."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Sequence
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: After which characters plain text may be cut; the size of a part where none is asked for;
#: how deep sections nest; the size that a chunk inside a document needs to represent it.
SAFE_END = re.compile(r"(?s).*[ !#$%&)*+,\-./:;=>?@\\\]^_`|}~]")
DEFAULT_SIZE = 5 * 1024 * 1024
DEEPEST = 3
LEAST_INNER = 500
SPACES = re.compile(r"\s*")


def part_size(n: Column, most: Column | None = None, parts: Column | None = None) -> Column:
    """Size of a part of n bytes: n over the number of parts, else `most`, else 5 MiB; one at least."""
    default = F.coalesce(F.nullif(most, F.lit(0)), F.lit(DEFAULT_SIZE)) if most is not None else F.lit(DEFAULT_SIZE)
    if parts is not None:
        default = F.when(parts.isNotNull(), F.ceil(n / F.greatest(F.lit(1), parts))).otherwise(default)
    return F.greatest(F.lit(1), default).cast("bigint")


def plain_chunks(text: str, most: int) -> list[str]:
    """text cut after the last space or closing punctuation within `most` characters, never behind a backslash that escapes; leading white space of what follows goes."""
    out, start = [], 0
    while len(text) - start > most:
        safe = SAFE_END.match(text, start, start + most)
        end = slash = safe.end() if safe else start + most
        while slash > start and text[slash - 1] == "\\":
            slash -= 1
        end = max(start + 1, end - (end - slash) % 2)
        out.append(text[start:end])
        start = SPACES.match(text, end).end()
    return [*out, text[start:]] if start < len(text) else out


def json_array_packs(text: str, most: int) -> list[str]:
    """The items of a JSON array in arrays of at most `most` bytes of items; a larger item stands alone. Other values have no items."""
    try:
        items = json.loads(text)
    except ValueError:
        return []
    packs, used = [], 0
    for item in items if isinstance(items, list) else []:
        item = json.dumps(item, ensure_ascii=False)
        size = len(item.encode())
        if not packs or used + size > most:
            packs.append([])
            used = 0
        packs[-1].append(item)
        used += size
    return [f"[{', '.join(pack)}]" for pack in packs]


def markdown_parts(text: str, most: int, level: int = 1, above: str = "") -> list[str]:
    """Parts of at most `most` bytes where headings allow it: cut at the highest headings first, then deeper; each part repeats the headings above it once."""
    if len((above + text).encode()) <= most or level > 6:
        return [above + text] if (above + text).strip() else []
    mark = "#" * level + " "
    out = []
    for piece in re.split(f"(?m)^(?={mark})", text):
        head, _, body = piece.partition("\n") if piece.startswith(mark) else ("", "", piece)
        if piece.strip():
            out += markdown_parts(body, most, level + 1, above + head + "\n" * bool(head))
    return out


def xml_parts(text: str, most: int) -> list[str]:
    """The children of the root in documents of at most `most` bytes under the same root, halved or finer until they fit; a larger child stands alone. A text that is no XML stays as it is, in one part."""
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError:
        return [text] if text.strip() else []
    out, waiting = [], [list(root)]
    while waiting:
        children = waiting.pop()
        part = ElementTree.Element(root.tag, root.attrib)
        part.extend(children)
        written = ElementTree.tostring(part, encoding="utf-8")
        if len(written) <= most or len(children) <= 1:
            out.append(written.decode())
            continue
        step = math.ceil(len(children) / min(math.ceil(len(written) / most), len(children)))
        waiting += reversed([children[i : i + step] for i in range(0, len(children), step)])
    return out


def whole_documents(elements: DataFrame, keys: Sequence[str], order: str, text: str = "text", language: str = "language") -> DataFrame:
    """(keys, content, language): one document of all elements with a text, in order, with the language of the first element."""
    listed = F.sort_array(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(order, text))))
    return elements.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda e: e[text]), "\n\n").alias("content"), F.min_by(language, order).alias("language"))


def section_parents(sections: DataFrame, keys: Sequence[str], number: str = "number") -> DataFrame:
    """sections with `parent`: the longest dotted prefix of the number that the same document has, among those of three dots at most; null at the top.

    Dots part a number: 10 is not below 1.
    """
    sections = sections.withColumn("__dots", F.split(number, r"\."))
    above = F.transform(F.filter(F.sequence(F.lit(0), F.size("__dots") - 1), lambda n: (n > 0) & (n <= DEEPEST)), lambda n: F.array_join(F.slice("__dots", 1, n), "."))
    asked = sections.select(*keys, number, F.explode(above).alias("parent"))
    held = sections.select(*keys, F.col(number).alias("parent")).distinct()
    found = asked.join(held, [*keys, "parent"], "left_semi").groupBy(*keys, number).agg(F.max_by("parent", F.length("parent")).alias("parent"))
    return sections.drop("__dots").join(found, [*keys, number], "left")


def flat_sessions(rows: DataFrame, keys: Sequence[str], groups: str) -> DataFrame:
    """(keys, session_idx, turns): groups of sessions of turns as one list of the sessions that have a turn, in order."""
    sessions = F.filter(F.flatten(F.filter(groups, lambda g: g.isNotNull())), lambda s: F.size(s) > 0)
    return rows.select(*keys, F.posexplode(sessions).alias("session_idx", "turns"))


def first_of_list(text: Column) -> Column:
    """The first item of a list written as text (['50'] gives 50); other texts without white space around."""
    bare = F.trim(text)
    quoted = F.regexp_extract(bare, r"""^\[\s*(['"])((?:\\.|(?!\1).)*)\1\s*(?:,.*)?\]$""", 2)
    number = F.regexp_extract(bare, r"^\[\s*(-?\d+(?:\.\d+)?)\s*(?:,.*)?\]$", 1)
    return F.coalesce(F.nullif(quoted, F.lit("")), F.nullif(number, F.lit("")), bare)


def representatives(chunks: DataFrame, keys: Sequence[str], order: str, text: str, words: Column, most: int = 3) -> DataFrame:
    """The chunks that stand for a document, with `why`: all of a short one; else the first, the densest long inner ones, and the last if there is room.

    Density: half the number of words (a Column) plus a thousandth of the length; ties by order.
    """
    chunks = chunks.withColumns({"__n": F.count("*").over(Window.partitionBy(*keys)), "__at": F.row_number().over(Window.partitionBy(*keys).orderBy(order))})
    inner = (F.col("__at") > 1) & (F.col("__at") < F.col("__n")) & (F.length(text) > LEAST_INNER)
    kind = F.when(F.col("__n") <= most, "all").when(F.col("__at") == 1, "first").when(inner, "dense").when(F.col("__at") == F.col("__n"), "last")
    density = F.when(inner, words * 0.5 + F.length(text) * 0.001)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.expr("CASE why WHEN 'first' THEN 1 WHEN 'dense' THEN 2 ELSE 3 END"), F.desc("__density"), order))
    kept = chunks.withColumns({"why": kind, "__density": density}).where("why IS NOT NULL").withColumn("__place", place)
    return kept.where((F.col("why") == "all") | (F.col("__place") <= most)).drop("__n", "__at", "__density", "__place")


def coherence(docs: DataFrame, cluster: str, kind: str, text: str, order: str, previews: int = 3, size: int = 100) -> DataFrame:
    """(cluster, n_docs, kinds, previews): how many documents, of which kinds, and how the first ones begin."""
    place = F.row_number().over(Window.partitionBy(cluster).orderBy(order))
    shown = F.when(F.col("__place") <= previews, F.struct("__place", F.substring(text, 1, size).alias("begin")))
    grouped = docs.withColumn("__place", place).groupBy(cluster)
    return grouped.agg(F.count("*").alias("n_docs"), F.array_sort(F.collect_set(kind)).alias("kinds"), F.transform(F.sort_array(F.collect_list(shown)), lambda s: s["begin"]).alias("previews"))
