"""Workbooks: hand-made files, the title and remark rules, cases, parts, and what is written is read back."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tideglass.sources import workbooks as W

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def made(*sheets, strings=(), props="", styles=None):
    """A workbook of (name, XML of the sheet)."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}">{props}<sheets>{"".join(f"""<sheet name="{n}" r:id="a{k}"/>""" for k, (n, _) in enumerate(sheets))}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships>{"".join(f"""<Relationship Id="a{k}" Type="{REL}/worksheet" Target="/xl/worksheets/s{k}.xml"/>""" for k in range(len(sheets)))}</Relationships>')
        if strings:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{"".join(f"<si>{s}</si>" for s in strings)}</sst>')
        if styles:
            z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}">{styles}</styleSheet>')
        for k, (_, xml) in enumerate(sheets):
            z.writestr(f"xl/worksheets/s{k}.xml", f'<worksheet xmlns="{MAIN}">{xml}</worksheet>')
    return out.getvalue()


def files(spark, *contents):
    return spark.createDataFrame([(f"f{k}", bytearray(c) if c is not None else None) for k, c in enumerate(contents)], "path string, content binary")


def sheet(*rows):
    """XML of rows of texts, from row 1; None: no cell."""
    cell = lambda r, c, v: f'<c r="{W._letters(c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' if v is not None else ""
    return "<sheetData>" + "".join(f'<row r="{r}">{"".join(cell(r, c, v) for c, v in enumerate(row, 1))}</row>' for r, row in enumerate(rows, 1)) + "</sheetData>"


def test_values(spark):
    """Shared strings, runs, numbers, truth values, errors, formulas, dates, gaps in rows and columns."""
    data = '<sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c><c r="AB2"><v>7</v></c></row><row r="5"><c><v>1.50</v></c><c t="b"><v>1</v></c><c t="e"><v>#N/A</v></c><c><f>A1+1</f><v>3</v></c><c s="1"><v>45292.5</v></c><c s="2"><v>0.25</v></c><c s="0"><v>1e3</v></c></row></sheetData>'
    styles = '<numFmts><numFmt numFmtId="170" formatCode="hh:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs>'
    book = made(("One", data), strings=["<t>plain</t>", "<r><t>two </t></r><r><t>runs</t></r><rPh><t>no</t></rPh>"], styles=styles)
    first, second = W.rows_of(files(spark, book)).orderBy("row").collect()
    assert (first["sheet"], first["row"], len(first["cells"])) == ("One", 2, 28)
    assert {k: c for k, c in enumerate(first["cells"]) if c is not None} == {0: "plain", 2: "two runs", 27: "7"}
    assert second["cells"] == ["1.5", "True", "#N/A", "=A1+1", "2024-01-01 12:00:00", "06:00:00", "1000.0"]
    assert W.rows_of(files(spark, book), formulas=False).where("row = 5").first()["cells"][3] == "3"


def test_merged_cells(spark):
    """Down a column all get the value, rows that are not there included; across, only the first has it."""
    data = sheet(["a", "b", "c"], ["x", "old", None], [None, "1", None]) + '<mergeCells><mergeCell ref="A2:A5"/><mergeCell ref="B2:C2"/><mergeCell ref="C3:C3"/></mergeCells>'
    rows = {r["row"]: r["cells"] for r in W.rows_of(files(spark, made(("s", data)))).collect()}
    assert [c for c in rows[2] if c] == ["x", "old"] and rows[3][:2] == ["x", "1"] and rows[4][0] == rows[5][0] == "x" and 6 not in rows
    wide = sheet(["a", "b"], ["left", "lost"]) + '<mergeCells><mergeCell ref="A2:B3"/></mergeCells>'
    assert {r["row"]: r["cells"] for r in W.rows_of(files(spark, made(("s", wide)))).collect()} == {1: ["a", "b"], 2: ["left", None]}


def test_chunks(spark):
    table = made(("Prices", sheet(["Note"], [None, "more"], ["name", "name", "n"], ["a\nb", "c"], [None], ["d", None, "3"])), ("List", sheet(["one"], [None], [None, "two"])), ("Empty", "<sheetData/>"))
    plain = made(("S", sheet(["k", "v"], ["1", "2"])))
    out = {(r["path"], r["chunk_index"]): r["content"] for r in W.chunks(W.rows_of(files(spark, table, plain, b"junk"))).collect()}
    head = "| name | n | Remark before title |\n| --- | --- | --- |\n"
    assert out == {
        ("f0", 0): head + "| c |  | <br>Note<br>more |\n————Prices",
        ("f0", 1): head + "|  | 3 | <br>Note<br>more |\n————Prices",
        ("f0", 2): "one\ntwo\n\n————List",
        ("f0", 3): "\n————Empty",
        ("f1", 0): "| k | v |\n| --- | --- |\n| 1 | 2 |\n————S",
    }


def test_broken_files_are_rows(spark):
    broken = made(("a", "<sheetData><row r='1'><c r='A1'><v>1</v></c></row>"))
    rows = W.rows_of(files(spark, None, b"", b"PK nothing", broken, made(("fine", sheet(["x", "y"]))))).collect()
    assert {r["path"] for r in rows if r["error"]} == {"f0", "f1", "f2", "f3"} and [r["cells"] for r in rows if r["path"] == "f4"] == [["x", "y"]]
    assert W.chunks(W.rows_of(files(spark, None))).count() == 0 and W.rows_of(files(spark)).count() == 0


def test_eval_cases(spark):
    good = made(("cases", sheet(["how to", "fill this"], [" 会话ID ", "Turn_Order", "QUERY *", "答案", "answer"], ["s1", "1", "1+1?", "2", "no"], [None], ["s1", "2", " ", "x"], [None, None, "q2"])), ("other", sheet(["query"], ["no"])))
    cases = W.eval_cases(W.rows_of(files(spark, good, made(("x", sheet(["a"]))), made(("x", sheet(["answer"], ["b"]))), made(("x", sheet(["query"]))), b"junk"), formulas=False)).collect()
    assert sorted((r["order_no"], r["session_id"], r["turn_order"], r["query"], r["answer"], r["error"]) for r in cases if r["path"] == "f0") == [
        (0, "s1", "1", "1+1?", "2", None), (1, "s1", "2", None, "x", "query is required"), (2, None, None, "q2", None, None),
    ]
    errors = {r["path"]: r["error"] for r in cases if r["path"] != "f0"}
    assert errors["f1"] == "no header row" and errors["f2"] == "missing required column: query" and errors["f3"] == "no cases" and "BadZipFile" in errors["f4"] and len(cases) == 7


@pytest.mark.parametrize("groups", [1, 2, 3, 7])
def test_parts(spark, groups):
    """Against slices of lists; every part of a sheet starts with its first row."""
    lists = {"A": [["h", "i"]] + [[str(k), "v"] for k in range(10)], "B": [["z"]] + [["1"], ["2"]], "C": [["alone"]]}
    book = made(*((n, sheet(*rows)) for n, rows in lists.items()))
    parts = W.split_rows(W.rows_of(files(spark, book)), spark.createDataFrame([("f0", groups * 100)], "path string, size long"), 100)
    read = W.rows_of(W.to_workbooks(parts, "path", "part").select(F.concat("path", F.lit("/"), "part").alias("path"), "content")).orderBy("row").collect()
    got = {}
    for r in read:
        got.setdefault((r["path"], r["sheet"]), []).append(r["cells"])
    want = {}
    for name, (head, *data) in lists.items():
        size = -(-len(data) // groups)
        for g in range(groups):
            if groups == 1 or data[g * size : (g + 1) * size]:
                want[f"f0/{g}", name] = [head, *data[g * size : (g + 1) * size]]
    assert got == want


def test_written_workbooks_are_read_back(spark, tmp_path):
    cells = [["007", "7", "-1.5", "1.50", "1e3", None, " a <b> & \"c\"\n中文 "], ["x\rz", "123456789012345678", "", "0", "-0", "0.1", "nul\x00"]]
    rows = spark.createDataFrame([("b", 1, "Second & last", 3, cells[0]), ("b", 0, "First", 1, cells[1]), ("b", 2, "none", 0, [])], "book string, sheet_no int, sheet string, row int, cells array<string>")
    content = W.to_workbooks(rows, "book").first()["content"]
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "b.xlsx").write_bytes(content)
    (tmp_path / "b.txt").write_bytes(b"other")
    back = {r["sheet"]: (r["row"], r["cells"]) for r in W.read_workbooks(spark, str(tmp_path)).collect()}
    cells[1][-1] = "nul"
    assert back == {"First": (1, cells[1]), "Second & last": (3, cells[0]), "none": (0, [])}
    assert W.to_workbooks(rows.where("false"), "book").count() == 0
