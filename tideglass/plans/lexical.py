"""Lexical queries: whole benchmark items ask whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideglass.functions import text as T
from tideglass.operators import lexical as L
from tideglass.plans._base import query, table

_TOKENS = "list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda w: lower(w))"
_BOTH = f"""d AS (SELECT doc_id AS id, {_TOKENS} AS t FROM documents), q AS (SELECT item_id AS query_id, {_TOKENS} AS t FROM benchmark), p AS (SELECT id, unnest(t) AS term, unnest(range(len(t))) AS pos FROM d),
  w AS (SELECT query_id, len(t) AS n, unnest(t) AS term, unnest(range(len(t))) AS q FROM q)"""
_FUZZY = """v AS (SELECT DISTINCT term FROM p), a AS (SELECT DISTINCT term AS asked, CASE WHEN len(term) <= 2 THEN 0 WHEN len(term) <= 5 THEN 1 ELSE 2 END AS k FROM w),
  z AS (SELECT asked, term, damerau_levenshtein(asked, term) AS distance, k FROM a JOIN v ON abs(len(asked) - len(term)) <= k WHERE damerau_levenshtein(asked, term) <= k)"""


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.search_tokens(F.col("text")).alias("tokens"))


def items(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), T.search_tokens(F.col("text")).alias("tokens"))


@query(f"""WITH {_BOTH}, h AS (SELECT query_id, id FROM (SELECT DISTINCT query_id, term FROM w) JOIN (SELECT DISTINCT id, term FROM p) USING (term) JOIN (SELECT query_id, len(list_distinct(t)) AS m FROM q) USING (query_id) GROUP BY query_id, id, m HAVING count(*) = m),
  o AS (SELECT query_id, id, n, q, pos, pos - q AS x FROM h JOIN w USING (query_id) JOIN p USING (id, term)), x AS (SELECT DISTINCT query_id, id, x FROM o),
  c AS (SELECT query_id, id, s FROM x JOIN o USING (query_id, id), unnest([0, 1, 2, 3]) AS u(s) WHERE o.x BETWEEN x.x AND x.x + s GROUP BY query_id, id, x.x, s, n HAVING count(DISTINCT q) = n AND count(DISTINCT pos) >= n)
  SELECT query_id, id, CAST(min(s) AS INTEGER) AS distance FROM c GROUP BY ALL""")
def phrase_slop(spark, sf_dir):
    return L.phrases(documents(spark, sf_dir), items(spark, sf_dir))


@query(f"WITH {_BOTH}, {_FUZZY} SELECT asked, term, CAST(distance AS INTEGER) AS distance FROM z")
def fuzzy_terms(spark, sf_dir):
    terms = lambda df: df.select(F.explode("tokens").alias("term"))
    return L.fuzzy_terms(terms(documents(spark, sf_dir)), terms(items(spark, sf_dir)))


_MATCHED = f"""WITH {_BOTH}, {_FUZZY}, tf AS (SELECT p.id, len(d.t) AS length, term, count(*) AS tf FROM p JOIN d USING (id) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), s AS (SELECT count(*) AS n_all, avg(len(t)) AS mean FROM d),
  b AS (SELECT id, asked, max(ln(1 + (n_all - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean)) * (1 - distance / least(len(asked), len(term)))) AS part FROM tf JOIN z USING (term) JOIN df USING (term), s GROUP BY ALL),
  k AS (SELECT query_id, n, term AS asked, count(*) AS times FROM w GROUP BY ALL),
  f AS (SELECT query_id, id, sum(times) AS matched, sum(part * times) AS score FROM b JOIN k USING (asked) GROUP BY query_id, id, n HAVING sum(times) >= greatest(n // 2, 1))"""


@query(f"{_MATCHED} SELECT query_id, id, CAST(matched AS BIGINT) AS matched, round(score, 5) AS score FROM f")
def fuzzy_matches(spark, sf_dir):
    return L.fuzzy_matches(documents(spark, sf_dir), items(spark, sf_dir)).withColumn("score", F.round("score", 5))


def weights(spark, sf_dir):
    """What each token of an item weighs, with the document frequencies of documents."""
    docs = documents(spark, sf_dir)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    df = docs.select("id", F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return L.term_weights(asked, asked.select("id", T.search_tokens(F.col("text")).alias("tokens")), doc_freqs=df, total_docs=docs.count())


_WEIGHTS = """g AS (SELECT query_id, term, sum(CASE WHEN regexp_full_match(term, '[0-9]+') THEN 1.2::DOUBLE ELSE 1 END * CASE WHEN q < 3 OR q > len(text) / 3 THEN 1.2::DOUBLE ELSE 1 END) AS w FROM w JOIN benchmark ON query_id = item_id GROUP BY ALL),
  u AS (SELECT query_id, term, w / sum(w) OVER (PARTITION BY query_id) * (ln(((SELECT count(*) FROM d) + 1)::DOUBLE / (coalesce(df, 0) + 1)) + 1) * (1 + 0.1::DOUBLE * (len(term) - 1)) AS w FROM g LEFT JOIN (SELECT term, count(DISTINCT id) AS df FROM p GROUP BY 1) USING (term)),
  y AS (SELECT query_id, term, w / max(w) OVER (PARTITION BY query_id) AS w FROM u QUALIFY w / max(w) OVER (PARTITION BY query_id) > 0.2 AND len(term) > 1), tw AS (SELECT query_id, term, w / max(w) OVER (PARTITION BY query_id) AS weight FROM y)"""


@query(f"WITH {_BOTH}, {_WEIGHTS} SELECT query_id AS id, term, round(weight, 6) AS weight FROM tw")
def term_weights(spark, sf_dir):
    return weights(spark, sf_dir).withColumn("weight", F.round("weight", 6))


@query(f"""{_MATCHED}, {_WEIGHTS}, h AS (SELECT query_id, id FROM (SELECT DISTINCT query_id, term FROM w) JOIN (SELECT DISTINCT id, term FROM p) USING (term) JOIN (SELECT query_id, len(list_distinct(t)) AS m FROM q) USING (query_id) GROUP BY query_id, id, m HAVING count(*) = m),
  o AS (SELECT query_id, id, n, q, pos, pos - q AS x FROM h JOIN w USING (query_id) JOIN p USING (id, term)), x AS (SELECT DISTINCT query_id, id, x FROM o),
  c AS (SELECT query_id, id, s FROM x JOIN o USING (query_id, id), unnest([0, 1, 2, 3]) AS u(s) WHERE o.x BETWEEN x.x AND x.x + s GROUP BY query_id, id, x.x, s, n HAVING count(DISTINCT q) = n AND count(DISTINCT pos) >= n),
  i AS (SELECT query_id, sum(ln(1 + (n_all - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) AS idf FROM w JOIN df USING (term), s GROUP BY 1),
  ph AS (SELECT query_id, id, idf * often * 2.5::DOUBLE / (often + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(t) / mean)) AS score FROM (SELECT query_id, id, 1 / (1 + min(s)::DOUBLE) AS often FROM c GROUP BY ALL) JOIN i USING (query_id) JOIN d USING (id), s),
  un AS (SELECT query_id, id, sum(score) AS score FROM (SELECT query_id, id, score FROM f UNION ALL SELECT query_id, id, score FROM ph) GROUP BY ALL), fa AS (SELECT query_id, id, sum(weight * 2) AS factor FROM tw JOIN tf USING (term) GROUP BY ALL)
  SELECT query_id, id, round(score * coalesce(factor, 1), 4) AS score FROM un LEFT JOIN fa USING (query_id, id)""")
def weighted_lexical(spark, sf_dir):
    found = L.weighted_search({"content": documents(spark, sf_dir)}, items(spark, sf_dir), weights(spark, sf_dir).withColumnRenamed("id", "query_id"))
    return found.withColumn("score", F.round("score", 4))
