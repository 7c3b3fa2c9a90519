"""Classifiers on documents whose labels they have not seen, at 10,000 documents: floors below the figures of the README."""

import pytest
from pyspark.sql import functions as F

from tideglass.llm import ordinal_quality, queries

SF = "/root/testdata/sf0.1"


def concordance(lower, higher):
    """How often a document of the higher grade is put above one of the lower; ties count half."""
    return sum((a < b) + 0.5 * (a == b) for a in lower for b in higher) / len(lower) / len(higher)


def test_grades_are_ordered(spark):
    """Trained on four fifths of the grades, by op6's own rule; the last fifth is put in their order, and what is clean stays."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    graded = labels.select("doc_id", grade.alias("y"), (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out")).where("y IS NOT NULL")
    model = ordinal_quality.train(docs, graded.where("NOT held_out").select("doc_id", "y"))
    asked = graded.where("held_out")
    rows = ordinal_quality.score(docs.join(asked, "doc_id", "left_semi"), model).join(asked, "doc_id").collect()
    of = {y: [r for r in rows if r["y"] == y] for y in (0, 1, 2)}
    grades = {y: [r["expected_grade"] for r in of[y]] for y in of}
    assert concordance(grades[0], grades[1]) > 0.9 and concordance(grades[1], grades[2]) > 0.88 and concordance(grades[0], grades[2]) > 0.99
    kept = {y: sum(r["tails"][0] >= 0.5 for r in of[y]) / len(of[y]) for y in of}
    assert kept[2] > 0.99 and kept[1] > 0.9 and kept[0] < 0.35
    for r in rows:
        assert r["expected_grade"] == pytest.approx(sum(r["tails"]), abs=1e-6) and list(r["tails"]) == sorted(r["tails"], reverse=True)


def test_toxic_documents_are_found(spark):
    """op8 itself: of the documents held out, most toxic ones and hardly a clean one."""
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    rows = queries.op8_toxicity(spark, SF).where("held_out").join(labels, "doc_id").collect()
    toxic, clean = [r for r in rows if r["toxic"] == 1], [r for r in rows if r["toxic"] == 0]
    assert sum(r["predicted"] for r in toxic) > 0.65 * len(toxic) and sum(r["predicted"] for r in clean) < 0.01 * len(clean)
    assert concordance([r["score"] for r in clean], [r["score"] for r in toxic]) > 0.9
