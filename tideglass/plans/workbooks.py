"""Workbooks that Spark makes of the tables and reads again."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideglass.plans._base import query, table
from tideglass.sources import workbooks as W

#: Keys of a book: a sheet stays far below what a spreadsheet opens, whatever share of rows one nation has.
BOOK = 5000


def _sheet(rows, path, name, row, *cells, no=0):
    return rows.select(path.alias("path"), F.lit(no).alias("sheet_no"), F.lit(name).alias("sheet"), row.cast("int").alias("row"), F.array(*(c.cast("string") for c in cells)).alias("cells"))


def supplier_books(spark, sf_dir):
    """A workbook for each nation and 5,000 keys: a remark, a title and a row for each supplier; a second sheet lists their names."""
    s = table(spark, sf_dir, "supplier").withColumn("path", F.concat_ws("-", "s_nationkey", F.floor(F.col("s_suppkey") / BOOK)))
    at = F.col("s_suppkey") % BOOK
    books = s.select("path", "s_nationkey").distinct()
    rows = (
        _sheet(s, F.col("path"), "suppliers", at + 3, F.col("s_suppkey"), F.col("s_name"), F.round(F.col("s_acctbal") * 100).cast("bigint"))
        .unionByName(_sheet(books, F.col("path"), "suppliers", F.lit(1), F.concat(F.lit("Suppliers of\nnation "), "s_nationkey")))
        .unionByName(_sheet(books, F.col("path"), "suppliers", F.lit(2), F.lit("key"), F.lit("name"), F.lit("cents")))
        .unionByName(_sheet(s, F.col("path"), "names", at + 1, F.col("s_name"), no=1))
    )
    return W.to_workbooks(rows, "path")


_BOOKS = f"WITH s AS (SELECT *, s_nationkey || '-' || (s_suppkey // {BOOK}) AS path FROM supplier)"


@query(f"""{_BOOKS}, c AS (SELECT path, 0 AS sheet_no, s_suppkey AS k, concat('| key | name | cents | Remark before title |', chr(10), '| --- | --- | --- | --- |', chr(10), '| ', s_suppkey, ' | ', s_name, ' | ', CAST(round(s_acctbal * 100) AS BIGINT), ' | <br>Suppliers of<br>nation ', s_nationkey, ' |', chr(10), '————suppliers') AS content FROM s
  UNION ALL SELECT path, 1, 0, string_agg(s_name || chr(10), '' ORDER BY s_suppkey) || chr(10) || '————names' FROM s GROUP BY path)
  SELECT path, row_number() OVER (PARTITION BY path ORDER BY sheet_no, k) - 1 AS chunk_index, content FROM c""")
def workbook_chunks(spark, sf_dir):
    return W.chunks(W.rows_of(supplier_books(spark, sf_dir)))


@query(f"""{_BOOKS}, n AS (SELECT path, count(*) AS size, max(s_suppkey % {BOOK}) + 2 AS n FROM s GROUP BY path), g AS (SELECT *, CAST(ceil(size / 3) AS BIGINT) AS groups FROM n),
  r AS (SELECT path, s_suppkey % {BOOK} + 3 AS row, concat_ws('|', s_suppkey, s_name, CAST(round(s_acctbal * 100) AS BIGINT)) AS line FROM s UNION ALL SELECT path, 2, 'key|name|cents' FROM n),
  d AS (SELECT r.path, row, line, groups, CAST(ceil(n / groups) AS BIGINT) AS slice FROM r JOIN g USING (path)),
  p AS (SELECT path, CASE WHEN groups = 1 THEN 0 ELSE (row - 2) // slice END AS part, CASE WHEN groups = 1 THEN row ELSE (row - 2) % slice + 2 END AS row, line FROM d)
  SELECT path || '/' || part AS path, row, line FROM p UNION ALL SELECT DISTINCT p.path || '/' || part, 1, concat('Suppliers of', chr(10), 'nation ', split_part(p.path, '-', 1)) FROM p""")
def workbook_parts(spark, sf_dir):
    """Books cut by their numbers of suppliers, three a part, written as workbooks again and read back; the sheet of suppliers, which a part may lack."""
    rows = W.rows_of(supplier_books(spark, sf_dir))
    sizes = rows.where("sheet_no = 0 AND row > 2").groupBy("path").agg(F.count("*").alias("size"))
    parts = W.to_workbooks(W.split_rows(rows, sizes, 3), "path", "part").select(F.concat_ws("/", "path", "part").alias("path"), "content")
    return W.rows_of(parts).where("sheet = 'suppliers'").select("path", "row", F.array_join("cells", "|").alias("line"))


@query(f"""SELECT 'book' || (item_id // {BOOK}) AS path, row_number() OVER (PARTITION BY item_id // {BOOK} ORDER BY item_id) - 1 AS order_no, 's' || (item_id // 2) AS session_id, CAST(item_id % 2 + 1 AS VARCHAR) AS turn_order,
  CASE WHEN item_id % 7 <> 0 THEN text END AS query, CAST(length(text) AS VARCHAR) AS answer, CASE WHEN item_id % 7 = 0 THEN 'query is required' END AS error FROM benchmark""")
def eval_workbook_cases(spark, sf_dir):
    """Benchmark items as cases of evaluation workbooks; every seventh has lost its query."""
    b = table(spark, sf_dir, "benchmark")
    path = F.concat(F.lit("book"), F.floor(F.col("item_id") / BOOK))
    name = "evaluation_cases"
    rows = (
        _sheet(b, path, name, F.col("item_id") % BOOK + 3, F.concat(F.lit("s"), F.floor(F.col("item_id") / 2)), F.col("item_id") % 2 + 1, F.when(F.col("item_id") % 7 != 0, F.col("text")), F.length("text"))
        .unionByName(_sheet(b.select(path.alias("path")).distinct(), F.col("path"), name, F.lit(1), F.lit("what to fill in")))
        .unionByName(_sheet(b.select(path.alias("path")).distinct(), F.col("path"), name, F.lit(2), F.lit("会话ID"), F.lit("请求顺序"), F.lit("Query *"), F.lit("答案")))
    )
    return W.eval_cases(W.rows_of(W.to_workbooks(rows, "path"), formulas=False))
