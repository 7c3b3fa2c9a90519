"""Workbooks (.xlsx): their rows, chunks, evaluation cases, parts, and a writer.

A workbook is a zip of XML files. Spark reads the files as bytes; a task streams the rows of their sheets, of which it holds
one batch and the file's table of shared strings. All that follows (titles, remarks, tables, cases, parts) is DataFrame work
over rows written once to the shared folder, so that no file is parsed twice.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from functools import partial
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideglass.operators.rounds import settled

ROWS = "path string, sheet_no int, sheet string, row int, cells array<string>, error string"
#: Rows of a batch that a task gives back at a time.
_BATCH = 2_000
#: The number formats of a workbook that stand for dates and times.
_DATES = {14, 15, 16, 17, 18, 19, 20, 21, 22, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36, 45, 46, 47, 50, 51, 52, 53, 54, 55, 56, 57, 58}
#: What the columns of evaluation cases may be called, in lower case.
HEADERS = {
    "session_id": ("session_id", "sessionid", "会话id"),
    "turn_order": ("request_id", "requestid", "turn_order", "turnorder", "turn", "请求顺序"),
    "query": ("query", "问题"),
    "answer": ("answer", "reference_output", "referenceoutput", "expected_output", "expectedoutput", "答案"),
}
REMARK = "Remark before title"


def _elements(book: zipfile.ZipFile, name: str, *wanted: str):
    """Elements of a part of the workbook with one of these names, each forgotten after use."""
    with book.open(name) as f:
        inside = 0
        for event, e in ElementTree.iterparse(f, events=("start", "end")):
            found = e.tag.rpartition("}")[2] in wanted
            if event == "start":
                inside += found
                continue
            if found:
                yield e
            inside -= found
            if not inside:
                e.clear()


def _children(e, name: str):
    return (c for c in e.iter() if c.tag.rpartition("}")[2] == name)


def _text(e) -> str:
    """Text of a shared or inline string, without phonetic runs."""
    kind = e.tag.rpartition("}")[2]
    return "" if kind == "rPh" else (e.text or "") if kind == "t" else "".join(map(_text, e))


def _column(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def _letters(column: int) -> str:
    out = ""
    while column:
        column, k = divmod(column - 1, 26)
        out = chr(65 + k) + out
    return out


def _place(ref: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", ref).groups()
    return _column(letters), int(digits)


def _date_styles(book: zipfile.ZipFile) -> set[str]:
    """Numbers of the cell styles that show a number as a date or time."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    named = set(_DATES)
    for e in _elements(book, "xl/styles.xml", "numFmt"):
        code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.|_.', "", e.get("formatCode", ""))
        if re.search("[dmyhsDMYHS]", code):
            named.add(int(e.get("numFmtId")))
    for e in _elements(book, "xl/styles.xml", "cellXfs"):
        return {str(k) for k, x in enumerate(_children(e, "xf")) if int(x.get("numFmtId", 0)) in named}
    return set()


def _number(text: str, date: bool, epoch: dt.datetime) -> str:
    if not date:
        return str(float(text)) if re.search("[.eE]", text) else str(int(text))
    day = float(text)
    when = epoch + dt.timedelta(milliseconds=round(day * 86_400_000))
    return str(when.time() if 0 <= day < 1 else when)


def _cell(e, shared: list[str], dates: set[str], epoch: dt.datetime, formulas: bool) -> str | None:
    kind, value, formula = e.get("t", "n"), None, None
    for c in e:
        name = c.tag.rpartition("}")[2]
        if name == "v":
            value = c.text
        elif name == "is":
            value = _text(c)
        elif name == "f":
            formula = c.text
    if formula and formulas:
        return "=" + formula
    if value is None or value == "" and kind == "n":
        return None
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return str(value.strip() == "1")
    return _number(value.strip(), e.get("s") in dates, epoch) if kind == "n" else value


def _sheet_rows(book: zipfile.ZipFile, name: str, read) -> Iterator[tuple[int, list[str | None]]]:
    """(row, cells): of merged cells the first has the value; those below it in the same column get it too."""
    merged = sorted((_place(first), _place(last or first)) for e in _elements(book, name, "mergeCell") for first, _, last in [e.get("ref").partition(":")])
    merged.sort(key=lambda m: m[0][1])
    active, at = [], 0  # [from column, to column, last row, value]

    def row_of(number: int, cells: list[str | None]) -> list[str | None]:
        nonlocal at
        active[:] = [m for m in active if m[2] >= number]
        for left, right, _, value in active:
            cells += [None] * (right - len(cells))
            cells[left - 1 : right] = [value] * (right - left + 1)
        while at < len(merged) and merged[at][0][1] <= number:
            (left, top), (right, bottom) = merged[at]
            at += 1
            value = cells[left - 1] if top == number and left <= len(cells) else None
            cells += [None] * (right - len(cells))
            cells[left:right] = [None] * (right - left)
            active.append([left, right, bottom, value if left == right else None])
        return cells

    last = 0
    for e in _elements(book, name, "row"):
        number = int(e.get("r") or last + 1)
        for between in range(last + 1, number):
            if any(m[3] is not None and m[2] >= between for m in active):
                yield between, row_of(between, [])
        cells: list[str | None] = []
        for c in _children(e, "c"):
            column = _place(c.get("r"))[0] if c.get("r") else len(cells) + 1
            cells += [None] * (column - len(cells))
            cells[column - 1] = read(c)
        yield number, row_of(number, cells)
        last = number
    for number in range(last + 1, max((m[2] for m in active if m[3] is not None), default=0) + 1):
        yield number, row_of(number, [])


def _workbook(content: bytes, formulas: bool) -> Iterator[tuple[int, str, int, list[str | None]]]:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        targets = {e.get("Id"): e.get("Target") for e in _elements(book, "xl/_rels/workbook.xml.rels", "Relationship") if e.get("Type", "").endswith("/worksheet")}
        shared = [_text(e) for e in _elements(book, "xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in book.namelist() else []
        since_1904 = any(e.get("date1904") in ("1", "true") for e in _elements(book, "xl/workbook.xml", "workbookPr"))
        epoch = dt.datetime(1904, 1, 1) if since_1904 else dt.datetime(1899, 12, 30)
        read = partial(_cell, shared=shared, dates=_date_styles(book), epoch=epoch, formulas=formulas)
        sheets = [(e.get("name"), next((v for k, v in e.items() if k.endswith("}id")), None)) for e in _elements(book, "xl/workbook.xml", "sheet")]
        for k, (sheet, key) in enumerate((s, r) for s, r in sheets if r in targets):
            name = targets[key].lstrip("/")
            empty = True
            for row, cells in _sheet_rows(book, name if name.startswith("xl/") else "xl/" + name, read):
                empty = False
                yield k, sheet, row, cells
            if empty:
                yield k, sheet, 0, []


def _scan(frames: Iterator[pd.DataFrame], formulas: bool) -> Iterator[pd.DataFrame]:
    columns, out = [f.split()[0] for f in ROWS.split(", ")], []
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"]):
            try:
                for found in _workbook(content, formulas):
                    out.append((path, *found, None))
                    if len(out) == _BATCH:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
            except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError, AttributeError, TypeError, OverflowError) as e:
                out.append((path, None, None, None, None, f"{type(e).__name__}: {e}"))
    yield pd.DataFrame(out, columns=columns)


def rows_of(files: DataFrame, formulas: bool = True) -> DataFrame:
    """(path, sheet_no, sheet, row, cells, error) of workbooks (path, content).

    cells are texts as Python writes the values, null where empty. Merged cells are empty but for the first, except within
    one column, where all have its value. formulas: a formula's own text, else its last value. A sheet without cells has one
    row 0. A file that can't be read (null, no workbook, broken on the way) has a row with the error, besides the rows before it.
    """
    return files.select("path", "content").mapInPandas(partial(_scan, formulas=formulas), ROWS)


def read_workbooks(spark: SparkSession, folder: str, formulas: bool = True) -> DataFrame:
    """rows_of all .xlsx files below a folder."""
    return rows_of(spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(folder), formulas)


def _filled(cells: Column | str) -> Column:
    return F.filter(cells, lambda c: c.isNotNull())


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def chunks(rows: DataFrame) -> DataFrame:
    """(path, chunk_index, content): a table of the title and one row for each row below it, or one text for a sheet of one column.

    The title is the first row with most cells filled; what stands above it is a last column of its own. Of columns with
    one name the last has the value. Line breaks in cells are <br>. Rows with an error are left out.
    """
    rows = settled(rows.where("error IS NULL").withColumn("n", F.size(_filled("cells"))))
    key = ["path", "sheet_no", "sheet"]
    order = F.struct("n", -F.col("row"))
    sheets = rows.groupBy(*key).agg(F.max(F.size("cells")).alias("width"), F.max("n").alias("most"), F.max_by("cells", order).alias("title"), F.max_by("row", order).alias("begin"))
    above = rows.join(sheets.where("most > 1").select(*key, "begin"), key).where("row < begin AND n > 0")
    remark = above.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("row", F.array_join(_filled("cells"), ";").alias("line")))).alias("lines"))
    sheets = sheets.join(remark.select(*key, F.array_join(F.transform("lines", lambda r: F.concat(F.lit("<br>"), r["line"])), "").alias("remark")), key, "left")

    in_line = lambda cells: F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.replace(F.coalesce(F.get(cells, i), F.lit("")), F.lit("\n"), F.lit("<br>")))
    extra = lambda value: F.when(F.col("remark").isNotNull(), F.array(F.replace(value, F.lit("\n"), F.lit("<br>")))).otherwise(F.array().cast("array<string>"))
    tables = rows.where("n > 0").join(sheets.where("most > 1"), key).where("row > begin")
    tables = tables.withColumn("keys", F.concat(in_line(F.col("title")), extra(F.lit(REMARK)))).withColumn("values", F.concat(in_line(F.col("cells")), extra(F.col("remark"))))
    names = F.array_distinct("keys")
    backwards = F.reverse(F.col("keys"))
    last = F.transform(names, lambda k: F.element_at("values", (F.size("keys") - F.array_position(backwards, k) + 1).cast("int")))
    line = lambda parts: F.concat(F.lit("| "), F.array_join(parts, " | "), F.lit(" |"))
    sign = F.concat(F.lit("\n————"), F.col("sheet"))
    tables = tables.select(*key, "row", F.concat(line(names), F.lit("\n"), line(F.transform(names, lambda k: F.lit("---"))), F.lit("\n"), line(last), sign).alias("content"))

    single = rows.join(sheets.where("most < 2").select(*key), key).groupBy(*key)
    lines = F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("row", F.replace(F.get(_filled("cells"), 0), F.lit("\n"), F.lit("<br>")).alias("line")))))
    single = single.agg(lines.alias("lines")).select(*key, F.lit(0).alias("row"), F.concat(F.array_join(F.transform("lines", lambda r: F.concat(r["line"], F.lit("\n"))), ""), sign).alias("content"))
    index = F.row_number().over(Window.partitionBy("path").orderBy("sheet_no", "row")) - 1
    return tables.unionByName(single).select("path", index.alias("chunk_index"), "content")


def eval_cases(rows: DataFrame) -> DataFrame:
    """(path, order_no, session_id, turn_order, query, answer, error) of the first sheets' cases.

    The header is the first row with a known name (`HEADERS`, letter case and a closing * aside); of columns with one name the
    first counts; blank rows are passed over. Nothing is raised: a case without a query has the error "query is required", and a
    workbook without a header, a query column or cases, or one that can't be read, is a row with that error alone. Read
    with formulas=False.
    """
    rows = settled(rows.where("error IS NOT NULL OR sheet_no = 0"))
    known = F.create_map(*(F.lit(v) for field, names in HEADERS.items() for n in names for v in (n, field)))
    field = lambda c: F.get(F.array(F.try_element_at(known, _stripped(F.rtrim(F.lower(_stripped(c)), F.lit("*"))))), 0)
    first = rows.where("error IS NULL").withColumn("fields", F.transform("cells", lambda c: field(c)))
    header = first.where(F.size(_filled("fields")) > 0).groupBy("path").agg(F.min_by("fields", "row").alias("fields"), F.min("row").alias("begin"))
    cell = lambda name: F.nullif(_stripped(F.get("cells", F.nullif(F.array_position("fields", F.lit(name)), F.lit(0)).cast("int") - 1)), F.lit(""))
    cases = first.drop("fields").join(header, "path").where("row > begin").select("path", "row", *(cell(n).alias(n) for n in HEADERS))
    cases = cases.where(F.coalesce(*HEADERS).isNotNull())
    of = cases.select("path", F.row_number().over(Window.partitionBy("path").orderBy("row")).alias("order_no"), *HEADERS, F.when(F.col("query").isNull(), "query is required").alias("error"))

    books = rows.groupBy("path").agg(F.max("error").alias("broken"))
    counted = books.join(header.select("path", F.array_contains("fields", "query").alias("has_query"), F.lit(True).alias("has_header")), "path", "left").join(cases.groupBy("path").agg(F.count("*").alias("n")), "path", "left")
    error = F.when(F.col("broken").isNotNull(), F.col("broken")).when(F.col("has_header").isNull(), "no header row").when(~F.col("has_query"), "missing required column: query").when(F.col("n").isNull(), "no cases")
    bad = counted.withColumn("error", error).where("error IS NOT NULL")
    whole = of.join(bad.select("path"), "path", "left_anti").withColumn("order_no", F.col("order_no") - 1)
    return whole.unionByName(bad.select("path", "error"), allowMissingColumns=True)


def split_rows(rows: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """rows (without errors) with the column part: files (path, size) beyond `most` bytes are cut in ceil(size / most) parts.

    The rows of each sheet below the first one are dealt in equal slices, in order; each part of a sheet starts with that first
    row. Smaller files, and those without a size, are part 0 as they are. A sheet without rows below the first goes if its
    file is cut.
    """
    key = ["path", "sheet_no", "sheet"]
    groups = sizes.select("path", F.ceil(F.col("size") / most).cast("int").alias("groups"))
    rows = settled(rows.where("error IS NULL")).join(groups, "path", "left").withColumn("groups", F.coalesce("groups", F.lit(1)))
    whole = rows.where("groups <= 1").withColumn("part", F.lit(0))
    cut = rows.where("groups > 1")
    slices = cut.where("row > 1").groupBy(*key, "groups").agg((F.max("row") - 1).alias("n")).withColumn("slice", F.ceil(F.col("n") / F.col("groups")).cast("int"))
    data = cut.where("row > 1").join(slices.select(*key, "slice"), key).withColumn("part", F.floor((F.col("row") - 2) / F.col("slice")).cast("int")).withColumn("row", (F.col("row") - 2) % F.col("slice") + 2)
    parts = data.select(*key, "part").distinct()
    first = cut.where("row = 1").join(parts, key)
    columns = ["path", "part", "sheet_no", "sheet", "row", "cells"]
    return whole.select(columns).unionByName(data.select(columns)).unionByName(first.select(columns))


_NS = "http://schemas.openxmlformats.org/"
_UNFIT = re.compile("[^\\t\\n\\r\\x20-\\ud7ff\\ue000-\\ufffd\\U00010000-\\U0010ffff]")


def _written(ref: str, text: str) -> str:
    """A number where that reads back as the same text, else an inline string."""
    number = re.fullmatch(r"-?\d{1,15}(\.\d{1,15})?", text) and (str(float(text)) if "." in text else str(int(text))) == text
    if number:
        return f'<c r="{ref}"><v>{text}</v></c>'
    fit = escape(_UNFIT.sub("", text), {"\r": "&#13;"})
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{fit}</t></is></c>'


def _build(frame: pd.DataFrame) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:

        def put(name: str, text: str) -> None:
            book.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text, zipfile.ZIP_DEFLATED)

        sheets = list(frame.sort_values(["sheet_no", "row"]).groupby(["sheet_no", "sheet"], sort=True))
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(len(sheets)))
        put("[Content_Types].xml", f'<Types xmlns="{_NS}package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{parts}</Types>')
        put("_rels/.rels", f'<Relationships xmlns="{_NS}package/2006/relationships"><Relationship Id="r1" Type="{_NS}officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name={quoteattr(name)} sheetId="{k + 1}" r:id="r{k + 1}"/>' for k, ((_, name), _) in enumerate(sheets))
        put("xl/workbook.xml", f'<workbook xmlns="{_NS}spreadsheetml/2006/main" xmlns:r="{_NS}officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{k + 1}" Type="{_NS}officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{k + 1}.xml"/>' for k in range(len(sheets)))
        put("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_NS}package/2006/relationships">{links}</Relationships>')
        for k, (_, rows) in enumerate(sheets):
            lines = ("".join(_written(f"{_letters(i + 1)}{row}", c) for i, c in enumerate(cells) if c is not None) for row, cells in zip(rows["row"], rows["cells"]))
            body = "".join(f'<row r="{row}">{line}</row>' for row, line in zip(rows["row"], lines) if row)
            put(f"xl/worksheets/sheet{k + 1}.xml", f'<worksheet xmlns="{_NS}spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def to_workbooks(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, content): a workbook of the rows (keys, sheet_no, sheet, row, cells) of each key.

    A workbook is built by one task, so keys must be such that it is a file one would open: a sheet has 1,048,576 rows at
    most. Characters that XML has no place for are left out. What is read back are the same texts.
    """
    kinds = dict(rows.dtypes)

    def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, _build(frame))], columns=[*keys, "content"])

    return rows.groupBy(*keys).applyInPandas(build, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "content binary"]))
