"""One thin query for each operator: production parameters, whole tables, the digest columns of the contract."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.llm._common import shared_dir, table


def op6_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 of low quality, 1 good but toxic, 2 good and not toxic; kept if grade 1 or more is likelier than not."""
    from tideglass.llm import ordinal_quality

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    model = ordinal_quality.train(docs, labels.select("doc_id", grade.alias("y")))
    found = ordinal_quality.score(docs, model)
    tail = F.coalesce(F.get("tails", F.lit(0)), F.lit(0.0))
    return found.select("doc_id", "expected_grade", tail.alias("tail_probability"), (tail >= 0.5).alias("kept"))


def op7_sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideglass.llm import sentence_dedup

    return sentence_dedup.remove_repeated(table(spark, sf_dir, "documents"), min_words=20, least=2)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideglass.llm import toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~toxicity.held_out()).select("doc_id", F.col("toxic").alias("y")))
    found = toxicity.score(docs, model)
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("sentences").cast("bigint").alias("n_sentences"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segmenter counts the words of page titles and texts, never those of urls: a host name that is often seen would stay whole."""
    from tideglass.llm import url_filter

    pages = table(spark, sf_dir, "pages")
    judged = url_filter.judge(pages.select("page_id", "url"), pages.select(url_filter.page_text("html").alias("text")))
    return judged.select("page_id", "host", "path", "rule", "verdict", "odds")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideglass.llm import simhash

    linked = simhash.link_documents(table(spark, sf_dir, "documents"), shingle=3, n_words=1, bits=64, budget=2, limit=2)
    return linked.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideglass.llm import language_id

    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~language_id.held_out()))
    found = language_id.identify(docs.select("doc_id", "text"), model, reject=False)
    return found.select("doc_id", language_id.held_out().alias("held_out"), F.col("lang").alias("lang_pred"), "score", "entropy", "rejected")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideglass.llm import decontaminate

    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideglass.llm import quality_rules

    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality_rules.BASE, "base_failed", "kept", "rule")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideglass.llm import mixing

    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, mixing.repeating_weights(docs, (3.0, 1.0, 2.0)), share=1.5, cap=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tideglass.llm import token_files

    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.encode_documents(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.decode_documents(spark, folder)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideglass.llm import conversation_repair

    conversations = table(spark, sf_dir, "conversations")
    return conversation_repair.audit(conversation_repair.damage(conversations), conversations)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideglass.llm import whitening

    rows = whitening.whole(table(spark, sf_dir, "embeddings"))
    return whitening.whiten(rows, whitening.fit(rows, k=4))


def op13_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideglass.llm import lz_fingerprint

    return lz_fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_quality_rules": op3_quality_rules,
    "op4_mix_sources": op4_mix_sources,
    "op5_token_files": op5_token_files,
    "op6_ordinal_quality": op6_ordinal_quality,
    "op7_sentence_dedup": op7_sentence_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_url_filter": op9_url_filter,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_lz_fingerprint": op13_lz_fingerprint,
}

#: Words as op2 takes them.
_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: The other operators learn models or use hashes and tokenizers that SQL lacks; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_benchmark_decontamination": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
  bw AS (SELECT DISTINCT item_id, w[k:k + 9] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM b WHERE len(w) > 0)), sizes AS (SELECT DISTINCT len(win) AS n FROM bw),
  dw AS (SELECT doc_id, n, k, w[k:k + n - 1] AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)), hit AS (SELECT doc_id, k, n, item_id FROM dw JOIN bw USING (win)),
  p AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS place FROM hit) GROUP BY 1),
  i AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY 1)
  SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM d LEFT JOIN p USING (doc_id) LEFT JOIN i USING (doc_id)""",
}
