"""Queries of the text scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideglass.functions import text as T
from tideglass.operators.chunking import cut_sentence as cut
from tideglass.operators.relational import random_sample
from tideglass.plans._base import query, table

_NORM = r'''array_to_string(list_filter(regexp_split_to_array(translate({0}, '!"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~', ''), '\s+'), lambda w: w NOT IN ('a', 'an', 'the', '')), ' ')'''


def _norm(sql: str, lower: bool = True) -> str:
    return _NORM.format(f"lower({sql})" if lower else sql)


@query(f"SELECT doc_id, {_norm('text')} AS normalized FROM documents")
def squad_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.squad_normalize(F.col("text")).alias("normalized"))


_PAIRS = """WITH p AS (SELECT a.conv_id, a.turn, a.text AS prediction, b.text AS gold FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


def pairs(spark, sf_dir):
    """Consecutive turns as predictions and gold answers."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.col("text").alias("prediction")).join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("gold")), ["conv_id", "turn"])


@query(f"{_PAIRS} SELECT conv_id, turn, CAST({_norm('prediction')} = {_norm('gold')} AS DOUBLE) AS em FROM p")
def em_score(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn", T.exact_match(F.col("prediction"), F.array("gold")).alias("em"))


_TOKENS = "list_transform(list_filter(string_split({0}, ' '), lambda w: w <> ''), lambda w: CASE WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN w[1:-2] ELSE w END)"


@query(f"""{_PAIRS}, t AS (SELECT conv_id, turn, {_TOKENS.format(_norm('prediction', False))} AS a, {_TOKENS.format(_norm('gold', False))} AS b FROM p),
  ca AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(a) AS w FROM t) GROUP BY ALL),
  cb AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(b) AS w FROM t) GROUP BY ALL),
  o AS (SELECT conv_id, turn, sum(least(ca.n, cb.n)) AS common FROM ca JOIN cb USING (conv_id, turn, w) GROUP BY ALL)
  SELECT conv_id, turn, round(CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE coalesce(2.0 * common / (len(a) + len(b)), 0.0) END, 6)::DOUBLE AS f1 FROM t LEFT JOIN o USING (conv_id, turn)""")
def f1_score(spark, sf_dir):
    rows = pairs(spark, sf_dir).select("conv_id", "turn", T.answer_tokens(F.col("prediction")).alias("a"), T.answer_tokens(F.col("gold")).alias("b"))
    return rows.select("conv_id", "turn", F.round(T.f1(F.col("a"), F.col("b")), 6).alias("f1"))


@query("""SELECT doc_id, round((contains(lower(text), 'the ')::INT + contains(lower(text), 'tion')::INT + contains(lower(text), 'zzz')::INT) / 3.0::DOUBLE, 4) AS coverage FROM documents""")
def keyword_match(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.keyword_coverage(F.col("text"), F.array(*map(F.lit, ("the ", "TION", "zzz")))).alias("coverage"))


@query(r"""SELECT event_id, CAST(replace(coalesce(nullif(regexp_extract(t, '####\s*([\d,]+(?:\.\d+)?)', 1), ''), list_extract(regexp_extract_all(t, '-?[\d,]+(?:\.\d+)?'), -1)), ',', '') AS DOUBLE) AS answer
  FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'work ' || event_id || ' #### ' || CAST(value AS VARCHAR) || ' end 7' ELSE props || ' then 1,234' END AS t FROM events)""")
def numeric_answer(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("work "), F.col("event_id"), F.lit(" #### "), F.col("value").cast("string"), F.lit(" end 7"))).otherwise(F.concat("props", F.lit(" then 1,234")))
    return e.select("event_id", T.final_number(text).alias("answer"))


@query(r"""SELECT doc_id, 2 * CAST(len(list_filter(regexp_split_to_array(text, '[\s,.:;!?()\[\]{}«»"''…—–-]+'), lambda w: w <> '')) AS INTEGER) AS by_words, greatest(1, CAST(floor(length(text) / 4) AS INTEGER)) AS mixed,
  CAST(floor(length(text) / 2) AS INTEGER) AS half FROM documents""")
def token_counts(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.tokens_regex(text).alias("by_words"), T.tokens_mixed(text).alias("mixed"), T.tokens_half(text).alias("half"))


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS x FROM documents) SELECT doc_id, CASE WHEN x = '' THEN 0 ELSE round(least(1, CASE WHEN length(x) >= 800 THEN 0.4::DOUBLE WHEN length(x) >= 200 THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END
  + 0.2::DOUBLE * (regexp_matches(x, '(?m)^#+\s|^\s*\d+[.]\s')::INT + regexp_matches(x, '(?m)^[-*•]|\|\s*-{2,}\s*\|')::INT + (len(regexp_extract_all(substr(x, 1, 500), '[A-Za-z]{2,}')) >= 15)::INT)), 2) END AS quality FROM t""")
def parse_quality(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.parse_quality(F.col("text")).alias("quality"))


@query(r"""SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), '') AS camel, array_to_string(list_transform(string_split(p_name, ' '), lambda w: lower(w)), '_') AS snake FROM part""")
def identifier_case(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.camel_case(F.col("p_name")).alias("camel"), T.snake_case(F.col("p_name")).alias("snake"))


@query(r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(list_concat(regexp_extract_all(text, 'https?://[^\s<>"]+'), regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')),
  regexp_extract_all(text, '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}')))), ' ') AS found FROM documents""")
def literals(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(T.literals(F.col("text"))), " ").alias("found"))


@query(r"""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 'none' ELSE ['date', 'month', 'year'][o_orderkey % 4 + 1] END AS rule,
  CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderdate AS DATE) WHEN 1 THEN CAST(date_trunc('month', o_orderdate) AS DATE) WHEN 2 THEN CAST(date_trunc('year', o_orderdate) AS DATE) END AS published FROM orders""")
def published_at(spark, sf_dir):
    form = F.element_at(F.array(F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "yyyy-MM"), F.date_format("o_orderdate", "yyyy"), F.lit("?")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    day, rule = T.published_at(F.concat(F.lit("issue "), form))
    return table(spark, sf_dir, "orders").select("o_orderkey", rule.alias("rule"), day.alias("published"))


@query(r"""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '^\W*(?:yes|correct|true)\b', 'i') THEN 'yes' WHEN regexp_matches(text, '^\W*(?:no|incorrect|false)\b', 'i') THEN 'no' ELSE 'unknown' END AS verdict,
  len(regexp_extract_all(text, '\[(\d{1,9})\]')) > 0 AS cites FROM conversations""")
def judge_replies(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.verdict(F.col("text")).alias("verdict"), T.citations_ok(F.col("text"), F.lit(10**9)).alias("cites"))


@query("""SELECT n.n AS attempt, CAST(least(900, 30 * pow(2, n.n - 1)) AS INTEGER) AS delay FROM (SELECT DISTINCT l_linenumber AS n FROM lineitem) n""")
def retry_backoff(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("attempt")).distinct()
    return n.select("attempt", T.retry_delay(F.col("attempt")).alias("delay"))


@query(r"""WITH h AS (SELECT doc_id, text, text[1:200] AS head FROM documents), s AS (SELECT *, regexp_extract(head, '(?s)^(.*[.!?。！？])', 1) AS sentence, regexp_extract(head, '(?s)^(.*)\s', 1) AS words FROM h)
  SELECT doc_id, CASE WHEN length(text) <= 200 THEN text WHEN length(sentence) >= 100 THEN sentence WHEN length(words) >= 120 THEN words ELSE head END AS cut FROM s""")
def cut_sentence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", cut(F.col("text"), 200).alias("cut"))


@query("""WITH n AS (SELECT event_id, event_id * event_id * event_id AS n FROM events)
  SELECT event_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f', n / 1024.0::DOUBLE) || ' KB' WHEN n < 1073741824 THEN printf('%.1f', n / 1048576.0::DOUBLE) || ' MB' ELSE printf('%.1f', n / 1073741824.0::DOUBLE) || ' GB' END AS size FROM n""")
def readable_size(spark, sf_dir):
    n = F.col("event_id").cast("decimal(12,0)")  # a bigint overflows from event 2,097,152 on
    return table(spark, sf_dir, "events").select("event_id", T.readable_size(n * n * n).alias("size"))


@query("""WITH s AS (SELECT event_id, ['PENDING', 'STARTED', 'SUCCESS', 'FAILURE', NULL][event_id % 5 + 1] AS p, ['PENDING', 'STARTED', 'SUCCESS', 'FAILURE', NULL][(event_id // 5) % 5 + 1] AS f FROM events)
  SELECT event_id, CASE WHEN p = 'FAILURE' THEN 'PROCESS_FAILED' WHEN f = 'FAILURE' THEN 'FORWARD_FAILED' WHEN f = 'STARTED' THEN 'FORWARDING' WHEN f = 'SUCCESS' THEN 'COMPLETED' WHEN f = 'PENDING' THEN 'WAIT_FOR_FORWARDING'
    WHEN p = 'STARTED' THEN 'PROCESSING' WHEN p = 'SUCCESS' THEN 'WAIT_FOR_FORWARDING' ELSE 'WAIT_FOR_PROCESSING' END AS state FROM s""")
def task_state(spark, sf_dir):
    states = F.array(*map(F.lit, ("PENDING", "STARTED", "SUCCESS", "FAILURE", None)))
    at = lambda n: F.element_at(states, (n % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", T.task_state(at(F.col("event_id")), at(F.floor(F.col("event_id") / 5))).alias("state"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch_us(ts) // 1000000 * 1000 WHEN 3 THEN NULL ELSE epoch_us(ts) // 1000 END AS millis FROM events""")
def timestamp_of(spark, sf_dir):
    millis = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    kind = F.col("event_id") % 4
    written = F.when(kind == 0, F.floor(millis / 1000).cast("string")).when(kind == 1, millis.cast("string")).when(kind == 2, iso).otherwise("no time")
    return table(spark, sf_dir, "events").select("event_id", F.unix_millis(T.timestamp_of(written)).alias("millis"))


@query()
def sample_documents(spark, sf_dir):
    """A reproducible sample of 100 documents; its size is the feature."""
    return random_sample(table(spark, sf_dir, "documents"), "doc_id", 100, 7).select("doc_id", "source", "lang")
