"""Answer scoring over parts: what each function of `functions.answers` says about answers made of their columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideglass.functions import answers as A
from tideglass.plans._base import query, table


@query("""WITH p AS (SELECT p_partkey, p_name AS t, CASE WHEN p_size % 2 = 0 THEN [upper(string_split(p_name, ' ')[1])] ELSE [string_split(p_name, ' ')[1], p_brand] END AS w FROM part), f AS (SELECT *, len(list_filter(w, lambda x: contains(t, lower(x)))) AS n, contains(t, 'ring') OR contains(t, 'bolt') AS any_of FROM p)
  SELECT p_partkey, (n / len(w) + CAST(any_of AS INTEGER)) / 2 AS score, n = len(w) AND any_of AS passed FROM f""")
def keyword_check(spark, sf_dir):
    first = F.element_at(F.split("p_name", " "), 1)
    every = F.when(F.col("p_size") % 2 == 0, F.array(F.upper(first))).otherwise(F.array(first, F.col("p_brand")))
    score, passed = A.keyword_score(F.col("p_name"), every, F.array(F.lit("Ring"), F.lit("bolt")))
    return table(spark, sf_dir, "part").select("p_partkey", score.alias("score"), passed.alias("passed"))


@query("""WITH o AS (SELECT p_partkey, p_name AS a, CASE WHEN p_size % 3 = 0 THEN ['small', 'ring', 'red bolt', 'bolt', p_name] ELSE ['small', 'ring', 'red bolt', 'bolt', 'zzz'] END AS o FROM part),
  r AS (SELECT p_partkey, i - 1 AS i, CASE WHEN o[i] = a THEN 3 WHEN contains(a, o[i]) OR contains(o[i], a) THEN 2 ELSE 1 END AS tier, len(o[i]) AS w, a, o[i] AS x FROM (SELECT *, unnest(range(1, 6)) AS i FROM o)),
  s AS (SELECT *, CASE WHEN tier = 3 THEN 0 WHEN tier = 2 THEN w ELSE 2 * len(list_intersect(string_split(a, ' '), string_split(x, ' ')))::DOUBLE / (len(string_split(a, ' ')) + len(string_split(x, ' '))) END AS weight FROM r)
  SELECT p_partkey, CAST(CASE WHEN tier = 1 AND weight = 0 THEN -1 ELSE i END AS INTEGER) AS option, CASE WHEN tier = 1 AND weight = 0 THEN 'none' WHEN tier = 3 THEN 'exact' WHEN tier = 2 THEN 'containment' ELSE 'fuzzy' END AS how FROM s QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY tier DESC, weight DESC, i) = 1""")
def option_choice(spark, sf_dir):
    last = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise("zzz")
    at, how = A.choice(F.col("p_name"), F.array(F.lit("small"), F.lit("ring"), F.lit("red bolt"), F.lit("bolt"), last))
    return table(spark, sf_dir, "part").select("p_partkey", at.cast("int").alias("option"), how.alias("how"))


@query("""SELECT p_partkey, p_size % 2 = 0 AS same_number, p_size % 5 <> 0 AS same_list, TRUE AS same_text FROM part""")
def answer_comparison(spark, sf_dir):
    """Prices with a currency against bare ones (odd sizes: one more), lists of two numbers (every fifth: one missing), text in other spelling."""
    price = F.format_string("%.2f", "p_retailprice")
    gold = F.format_string("%.2f", F.col("p_retailprice") + F.col("p_size") % 2)
    two = F.concat(price, F.lit(" , "), F.col("p_size").cast("string"))
    listed = F.when(F.col("p_size") % 5 == 0, price).otherwise(F.concat(F.lit("$"), price, F.lit(", "), F.format_string("%.1f", F.col("p_size").cast("double"))))
    text = F.concat(F.lit("  "), F.upper("p_name"), F.lit("."))
    return table(spark, sf_dir, "part").select("p_partkey", A.same_answer(F.concat(F.lit("$"), price), gold).alias("same_number"), A.same_answer(listed, two).alias("same_list"), A.same_answer(text, F.col("p_name")).alias("same_text"))
