"""Chunking, ingest and gateway queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideglass.operators import chunking as C
from tideglass.plans._base import query, table
from tideglass.sources import files, sql_gate


@query()
def paragraph_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(C.paragraph_chunks(F.regexp_replace("text", "\n", "\n\n"), 600)).alias("chunk_idx", "chunk"))
    return docs.select("doc_id", "chunk_idx", F.length("chunk").alias("n_chars"), "chunk")


@query()
def line_packs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(C.line_packs(F.col("text"), 800)).alias("chunk_idx", "chunk"))


@query("""SELECT doc_id, CAST(i AS INTEGER) AS part, i * (n_chars // 7) + least(i, n_chars % 7) AS first, n_chars // 7 + CAST(i < n_chars % 7 AS INT) AS size FROM documents, range(7) t(i) WHERE n_chars // 7 + CAST(i < n_chars % 7 AS INT) > 0""")
def csv_split_plan(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(C.near_equal_parts(F.col("n_chars"), 7)).alias("part", "s")).select("doc_id", "part", "s.first", "s.size")


@query("SELECT event_id, CAST(0 AS INTEGER) AS chunk_idx, 'k: ' || json_extract_string(props, '$.k') AS chunk FROM events")
def json_chunks(spark, sf_dir):
    return C.explode_with(table(spark, sf_dir, "events").select("event_id", "props"), "props", C.json_chunks, "chunk string")


@query()
def markdown_blocks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("# "), "source", F.lit("\n"), F.regexp_replace("text", r"\n([A-Z])", "\n## $1")).alias("text"))
    return C.explode_with(docs, "text", C.markdown_blocks, "block_id string, path string, block string")


@query()
def html_text(spark, sf_dir):
    return files.html_text(table(spark, sf_dir, "pages").select("page_id", "html"))


@query("""SELECT page_id, CASE WHEN lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) IN ('xlsx', 'xls') THEN 'spreadsheet' WHEN lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) IN ('html', 'htm', 'txt', 'pdf') THEN 'generic' ELSE 'unsupported' END AS processor FROM pages""")
def processor_dispatch(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", files.processor_of(F.col("url")).alias("processor"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'allow' WHEN 4 THEN 'allow' ELSE 'deny' END AS verdict FROM part""")
def sql_gate_table(spark, sf_dir):
    statements = ["SELECT 'drop table x' AS a -- delete", "DROP TABLE part", "SELECT 1; SELECT 2", "UPDATE part\nSET p_size = 1", "WITH a AS (SELECT 1) SELECT * FROM a;"]
    picked = F.element_at(F.array(*map(F.lit, statements)), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", sql_gate.gate(picked).alias("verdict"))
