"""Readers of document folders, HTML pages, registries and question files; sinks that replace partitions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What each kind of processor takes.
SPREADSHEETS = ("xlsx", "xls")
DOCUMENTS = ("txt", "pdf", "docx", "doc", "html", "htm", "md", "rtf", "odt", "pptx", "ppt", "csv", "json", "epub", "xml")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def processor_of(path: Column) -> Column:
    """spreadsheet, generic or unsupported, by a file's extension."""
    ext = extension(path)
    return F.when(ext.isin(*SPREADSHEETS), "spreadsheet").when(ext.isin(*DOCUMENTS), "generic").otherwise("unsupported")


def read_documents(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, name, processor, size, text, parse_error) of files; text of plain kinds only, undecodable bytes replaced."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    plain = extension(F.col("path")).isin("txt", "md", "csv", "json", "html", "htm", "xml")
    text = F.when(plain, F.decode("content", "UTF-8"))
    error = F.when(F.col("length") == 0, "empty_text").when(~plain, "needs_external_parser")
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), processor_of(F.col("path")).alias("processor"), F.col("length").alias("size"), text.alias("text"), error.alias("parse_error"))


def read_registry(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """A CSV of assets with the column `errors`: which required fields a row lacks. Bad rows stay."""
    rows = spark.read.option("header", "true").option("mode", "PERMISSIVE").csv(path)
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"the registry lacks columns {missing}")
    errors = F.filter(F.array(*(F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(f"{c} is empty")) for c in required)), lambda e: e.isNotNull())
    return rows.withColumn("errors", errors)


class _Visible(HTMLParser):
    hidden = {"script", "style", "noscript", "template", "head"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.depth = [], 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.hidden

    def handle_endtag(self, tag):
        self.depth -= tag in self.hidden and self.depth > 0

    def handle_data(self, data):
        if not self.depth and data.strip():
            self.parts.append(" ".join(data.split()))


def visible_text(html: str | None) -> str | None:
    if html is None:
        return None
    parser = _Visible()
    parser.feed(html)
    parser.close()
    return "\n".join(parser.parts)


def html_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages with the column text: what a reader sees of the HTML, a line for each run of it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["text"] = [visible_text(h) for h in frame.pop(column)]
            yield frame

    kinds = [(c, k) for c, k in pages.dtypes if c != column]
    return pages.select(*(c for c, _ in kinds), column).mapInPandas(run, ", ".join([*(f"{c} {k}" for c, k in kinds), "text string"]))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(id, question, answers) of JSON lines that name them in different ways; a string such as "['50']" is unwrapped."""
    rows = spark.read.json(path)
    pick = lambda *names: F.coalesce(*(F.col(n).cast("string") for n in names if n in rows.columns), F.lit(None).cast("string"))
    answer = pick("answer", "answers", "gold", "target")
    inner = F.regexp_replace(F.regexp_replace(answer, r"^\s*\[", ""), r"\]\s*$", "")
    listed = F.transform(F.split(inner, r",\s*"), lambda a: F.regexp_replace(F.trim(a), r"^['\"]|['\"]$", ""))
    return rows.select(pick("id", "question_id", "qid").alias("id"), pick("question", "query", "input").alias("question"), F.when(answer.rlike(r"^\s*\["), listed).otherwise(F.array(answer)).alias("answers"))


def replace_partitions(rows: DataFrame, path: str, *keys: str) -> None:
    """Writes rows so that only the partitions they are of are replaced: running it twice changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def without_chunks(index: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows of an index whose key is not in gone: the delete of an index without row updates."""
    return index.join(gone.select(key).distinct(), key, "left_anti")


def upsert_chunks(index: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return without_chunks(index, new, key).unionByName(new)
