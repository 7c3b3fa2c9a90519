"""Lexical search beyond BM25: sloppy phrases, fuzzy terms, minimum matches, weighted queries, term weights with a word lattice.

Tokens come as arrays in text order. An edit is an insertion, a deletion, a substitution or a swap of neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideglass.operators import products
from tideglass.operators.retrieval import B, K1
from tideglass.operators.rounds import settled

#: The slop of phrases, the share of tokens that must match, the factor of term weights.
SLOP, MINIMUM_MATCH, BOOST = 3, 0.5, 2.0
#: Fixed values of term weights: for numbers and for symbols (words count 1), at the ends of a text, for each further character; least weight and length of a term.
NUMBER_WEIGHT, SYMBOL_WEIGHT, END_WEIGHT, LENGTH_STEP, LEAST_WEIGHT, LEAST_LENGTH = 1.2, 0.8, 1.2, 0.1, 0.2, 2
#: Characters of a term that its deletions are made of; those behind only take part in the exact check.
PREFIX = 10
#: Longest word of a lattice.
LONGEST_WORD = 6


# --- fuzzy terms ---


def auto_distance(term: Column) -> Column:
    """Edits allowed: none up to two characters, one up to five, else two."""
    return F.when(F.length(term) <= 2, 0).when(F.length(term) <= 5, 1).otherwise(2)


def _without_one(word: Column) -> Column:
    """All ways to delete one character."""
    cut = lambda k: F.concat(F.substring(word, F.lit(1), k - 1), F.substring(word, k + 1, F.length(word)))
    return F.when(F.length(word) > 0, F.transform(F.sequence(F.lit(1), F.length(word)), cut)).otherwise(F.array().cast("array<string>"))


def _swapped(word: Column) -> Column:
    """All ways to swap two neighbours."""
    turn = lambda k: F.concat(F.substring(word, F.lit(1), k - 1), F.substring(word, k + 1, F.lit(1)), F.substring(word, k, F.lit(1)), F.substring(word, k + 2, F.length(word)))
    return F.when(F.length(word) > 1, F.transform(F.sequence(F.lit(1), F.length(word) - 1), turn)).otherwise(F.array().cast("array<string>"))


def _deletions(term: Column, edits: Column) -> Column:
    """The beginning of the term and what deleting up to so many of its characters leaves."""
    start = F.substring(term, 1, PREFIX)
    once = _without_one(start)
    twice = F.flatten(F.transform(once, _without_one))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.array(start), F.when(edits >= 1, once).otherwise(none), F.when(edits >= 2, twice).otherwise(none)))


def edits_upto_two(a: Column, b: Column) -> Column:
    """The number of edits between two words, 0 to 2; null if more."""
    plain = F.levenshtein(a, b)
    of_a, of_b = _swapped(a), _swapped(b)
    one = (plain == 1) | F.array_contains(of_a, b)
    two = (plain == 2) | F.exists(of_a, lambda s: F.levenshtein(s, b) <= 1) | F.exists(of_b, lambda s: F.levenshtein(a, s) <= 1) | F.arrays_overlap(of_a, of_b)
    return F.when(a == b, 0).when(one, 1).when(two, 2)


def fuzzy_terms(vocabulary: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, term, distance): every term of vocabulary (term) within the distance that each of asked (term) allows.

    Two words within k edits have a common form after at most k deletions in each, in their beginnings too: an
    equi-join on such forms finds all candidates, and the exact distance decides. What is shuffled follows the number of distinct terms.
    """
    width = int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a small vocabulary has many forms
    have = vocabulary.where("term <> ''").select("term").repartition(width, "term").distinct()
    want = asked.where("term <> ''").select(F.col("term").alias("asked")).distinct().withColumn("edits", auto_distance(F.col("asked")))
    most = F.when(F.length("term") >= 4, 2).when(F.length("term") >= 2, 1).otherwise(0)
    forms = have.select("term", F.explode(_deletions(F.col("term"), most)).alias("form"))
    found = want.select("asked", "edits", F.explode(_deletions(F.col("asked"), F.col("edits"))).alias("form")).join(forms, "form")
    pairs = found.where(F.abs(F.length("asked") - F.length("term")) <= F.col("edits")).select("asked", "edits", "term").distinct()
    pairs = pairs.where(F.levenshtein(F.col("asked"), F.col("term")) <= 2 * F.col("edits"))
    return pairs.withColumn("distance", edits_upto_two(F.col("asked"), F.col("term"))).where("distance <= edits").select("asked", "term", "distance")


# --- phrases ---


def phrase_distance(tokens: list[str], phrase: list[str], slop: int) -> int | None:
    """The least slop within which tokens hold the phrase: moves of terms, each at a place of its own; None beyond slop."""
    wanted, at = set(phrase), {}
    for k, t in enumerate(tokens):
        if t in wanted:
            at.setdefault(t, []).append(k)
    return _least_slop(at, phrase, slop)


def _least_slop(at: dict[str, list[int]], phrase: list[str], slop: int) -> int | None:
    """phrase_distance by the ascending places of terms."""
    places = [(at.get(t, []), q) for q, t in enumerate(phrase)]
    starts = sorted({p - q for ps, q in places for p in ps})
    for width in range(slop + 1):
        for x in starts:
            used = set()
            for ps, q in places:  # equal terms come in phrase order: the first free place is right
                free = next((p for p in ps if x + q <= p <= x + q + width and p not in used), None)
                if free is None:
                    break
                used.add(free)
            else:
                return width
    return None


def _phrases_found(s: products.Slice, block: products.Block, slop: int):
    r, q = np.nonzero(products.held(s, block) @ block.times == block.times.sum(axis=0))
    row, term, place = s.tokens
    number, found, lengths = {t: k for k, t in enumerate(block.terms.to_pylist())} if len(r) else {}, [], []
    for i, j in zip(r, q):
        phrase, own = block.tokens[j], slice(*np.searchsorted(row, [i, i + 1]))
        at = {t: place[own][term[own] == number[t]].tolist() for t in set(phrase)}
        found.append(_least_slop(at, phrase, slop))
        lengths.append(s.lengths[i])
    kept = np.array([d is not None for d in found], bool)
    return r[kept], q[kept], [("distance", pa.array([d for d in found if d is not None], pa.int32())), ("length", pa.array(np.array(lengths, np.int32)[kept], pa.int32()))]


def _phrases(docs: DataFrame, queries: DataFrame, slop: int) -> DataFrame:
    """phrases with the length of the document."""
    asked = F.transform(F.array_distinct("tokens"), lambda t: F.struct(t.alias("term"), F.lit(1).alias("times"), F.lit(None).cast("double").alias("weight")))
    whole = queries.where((F.size("tokens") > 0) & ~F.exists("tokens", lambda t: t.isNull())).select("query_id", F.size("tokens").alias("n"), "tokens", asked.alias("asked"))
    return products.pairs(products.each_alone(docs), whole, None, 0, partial(_phrases_found, slop=slop), "distance int, length int")


def phrases(docs: DataFrame, queries: DataFrame, slop: int = SLOP) -> DataFrame:
    """(query_id, id, distance): documents (id, tokens) that hold the tokens of a query (query_id, tokens) as a phrase of at most so much slop.

    Queries are a stated set, compared in blocks. Only documents with all terms of a query, found by a product of matrices, are
    measured, by the places of its terms alone. Queries without tokens find nothing.
    """
    return _phrases(docs, queries, slop).drop("length")


# --- matches and weighted queries ---


def _idf(df: Column) -> Column:
    return F.log(1 + (F.col("n_all") - df + 0.5) / (df + 0.5))


def fuzzy_matches(docs: DataFrame, queries: DataFrame, minimum: float = MINIMUM_MATCH) -> DataFrame:
    """(query_id, id, matched, score): documents in which at least this share (rounded down, at least one) of a query's tokens match a term within the allowed edits.

    A token's part of the score is its best term's BM25, times 1 - edits / the shorter length; a repeated token counts repeatedly.
    Queries are a stated set, compared in blocks.
    """
    rows, totals = products.texts(docs), _totals(docs)
    asked = products.asked_by(queries.withColumn("n", F.size("tokens")), ["query_id", "n"])
    return _fuzzy_matches(rows, totals, products.frequencies(rows), asked, minimum, False).drop("factor")


def _totals(docs: DataFrame) -> tuple:
    """How many documents there are, and their mean length."""
    return docs.agg(F.count("*"), F.avg(F.size("tokens"))).first()


def _fuzzy_found(s: products.Slice, block: products.Block, mean_length: float, minimum: float, every: bool):
    part = products.parts(s, block, mean_length, K1, B, best=True)
    matched = (part > 0) @ block.times
    enough = matched >= np.maximum(np.floor(block.sizes * minimum), 1)
    present, factor = np.zeros(enough.shape, bool), np.zeros(enough.shape)
    if not np.isnan(block.weights).all():
        own = products.held(s, block)
        present, factor = own @ ~np.isnan(block.weights) > 0, own @ np.nan_to_num(block.weights)
    r, q = np.nonzero(enough | present if every else enough)
    score = (part @ block.times)[r, q]
    return r, q, [("matched", pa.array(matched[r, q].astype(np.int64))), ("score", pa.array(score, mask=~enough[r, q])), ("factor", pa.array(factor[r, q], mask=~present[r, q]))]


def _fuzzy_matches(rows: DataFrame, totals: tuple, df: DataFrame, asked: DataFrame, minimum: float, every: bool) -> DataFrame:
    """(query_id, id, matched, score, factor): factor is the sum of the weights of the terms held, null if there is none. every: pairs too few tokens match in, for their factor; their score is null."""
    near = fuzzy_terms(df, asked.select(F.explode("asked").alias("a")).where("a.times > 0").select("a.term"))
    worth = 1 - F.col("distance") / F.least(F.length("asked"), F.length("term"))
    near = settled(near.join(df, "term").select("asked", "term", "df", worth.alias("worth")))
    find = partial(_fuzzy_found, mean_length=totals[1], minimum=minimum, every=every)
    return products.pairs(rows, asked, near, totals[0], find, "matched bigint, score double, factor double")


def weighted_search(fields: dict[str, DataFrame], queries: DataFrame, weights: DataFrame, field_weights: dict[str, float] | None = None, slop: int = SLOP, minimum: float = MINIMUM_MATCH, boost: float = BOOST) -> DataFrame:
    """(query_id, id, score): the weighted lexical query over fields (name: documents (id, tokens)).

    A document counts if in some field it holds the query as a phrase or matches enough of it (see fuzzy_matches). Phrases score as
    BM25 of a term with the sum of the terms' idf and a frequency of 1 / (1 + distance). Both are summed over fields by their weight, then
    multiplied by the sum of weight * field weight * boost over weights (query_id, term, weight) whose term a field holds, or by 1 if it holds none.
    """
    sized = queries.withColumn("n", F.size("tokens"))
    plain = products.asked_by(sized, ["query_id", "n"])
    given = weights.groupBy("query_id").agg(F.collect_list(F.struct("term", F.lit(0).cast("bigint").alias("times"), F.col("weight").cast("double").alias("weight"))).alias("given"))
    asked = settled(plain.join(given, "query_id", "left").select("query_id", "n", F.concat("asked", F.coalesce("given", F.filter("asked", lambda _: F.lit(False)))).alias("asked")))
    apart = len(fields) > 1 or minimum > 1  # else all that counts for a pair is in its one row, and phrases are among the matches
    parts = []
    for name, docs in fields.items():
        weight = (field_weights or {}).get(name, 1.0)
        rows, totals = products.texts(docs), _totals(docs)
        df = products.frequencies(rows)
        found = _fuzzy_matches(rows, totals, df, asked, minimum, apart).select("query_id", "id", (F.col("score") * weight).alias("score"), (F.col("factor") * weight * boost).alias("factor"))
        of_terms = queries.select("query_id", F.explode("tokens").alias("term")).join(df, "term").withColumn("n_all", F.lit(totals[0]))
        idf = of_terms.groupBy("query_id").agg(F.sum(_idf(F.col("df"))).alias("idf"))
        often = 1 / (1 + F.col("distance"))
        score = F.col("idf") * often * (K1 + 1) / (often + K1 * (1 - B + B * F.col("length") / F.lit(totals[1])))
        phrase = _phrases(docs, queries, slop).join(idf, "query_id").select("query_id", "id", (score * weight).alias("score"))
        if apart:
            parts += [found, phrase.withColumn("factor", F.lit(None).cast("double"))]
        else:
            phrase = settled(phrase.groupBy("query_id", "id").agg(F.sum("score").alias("phrase")))
            parts.append(found.join(phrase, ["query_id", "id"], "left").select("query_id", "id", (F.col("score") + F.coalesce("phrase", F.lit(0.0))).alias("score"), "factor"))
    every = reduce(DataFrame.unionByName, parts)
    if apart:
        every = every.groupBy("query_id", "id").agg(F.sum("score").alias("score"), F.sum("factor").alias("factor")).where("score IS NOT NULL")
    return every.select("query_id", "id", (F.col("score") * F.coalesce("factor", F.lit(1.0))).alias("score"))


# --- term weights ---


def _lattice(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs with the log shares of their known substrings to their best paths: the cheapest cut into words, longer words first among equals."""
    for rows in batches:
        found = []
        for run, known, unknown in zip(rows["run"], rows["known"], rows["unknown"]):
            share = {w["word"]: w["share"] for w in known}
            n = len(run)
            best = [(0.0, n)] * (n + 1)
            for i in range(n - 1, -1, -1):
                ways = [(share.get(run[i:j], unknown if j == i + 1 else None), j) for j in range(i + 1, min(n, i + LONGEST_WORD) + 1)]
                best[i] = max((s + best[j][0], j) for s, j in ways if s is not None)
            words, i = [], 0
            while i < n:
                words.append(run[i : best[i][1]])
                i = best[i][1]
            found.append(words)
        yield rows[["run"]].assign(words=found)


def cut_runs(runs: DataFrame, words: DataFrame) -> DataFrame:
    """(run, words): the distinct runs (run) cut into the words of greatest joint share of words (word, count).

    A character that is no word costs as much as a word seen half a time. Substrings up to LONGEST_WORD meet the words by an
    equi-join, so the dictionary is never collected; a run is cut in one row.
    """
    every = runs.where("run <> ''").select("run").distinct()
    counted = words.groupBy("word").agg(F.sum("count").alias("count"))
    total = counted.agg(F.coalesce(F.sum("count"), F.lit(1)).cast("double").alias("total"))
    ends = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), F.length("run") - i + 1)), lambda n: F.substring("run", i, n))
    pieces = every.select("run", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("run")), ends)))).alias("word"))
    known = pieces.join(counted, "word").crossJoin(F.broadcast(total)).groupBy("run").agg(F.collect_list(F.struct("word", F.log(F.col("count") / F.col("total")).alias("share"))).alias("known"))
    rows = every.join(known, "run", "left").crossJoin(F.broadcast(total)).select("run", F.coalesce("known", F.array().cast("array<struct<word:string,share:double>>")).alias("known"), F.log(0.5 / F.greatest("total", F.lit(1.0))).alias("unknown"))
    return rows.mapInPandas(_lattice, "run string, words array<string>")


#: Runs of CJK characters, of Latin letters and digits with what joins them, of white space, and single other characters.
PIECES = r"[\x{4E00}-\x{9FD5}]+|[A-Za-z0-9+#&._%-]+|\s+|."
_NUMBER, _CJK, _WORD = r"^[0-9]+(?:\.[0-9]+)?%?$", r"^[\x{4E00}-\x{9FD5}]", r"[A-Za-z0-9]"


def lattice_tokens(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(id, tokens): the lower-cased texts (id, text) in pieces, CJK runs cut into words (word, count)."""
    pieces = texts.select("id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(f"(?s){PIECES}"), F.lit(0))).alias("pos", "piece"))
    cut = cut_runs(pieces.where(F.col("piece").rlike(_CJK)).select(F.col("piece").alias("run")), words)
    whole = pieces.join(cut.withColumnRenamed("run", "piece"), "piece", "left").select("id", "pos", F.coalesce("words", F.array("piece")).alias("words"))
    return whole.groupBy("id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "words"))), lambda p: p["words"])).alias("tokens"))


def term_weights(texts: DataFrame, tokens: DataFrame, stop_words: tuple[str, ...] = (), doc_freqs: DataFrame | None = None, total_docs: int = 1) -> DataFrame:
    """(id, term, weight): what each term of a query text (id, text) weighs, 0 to 1; tokens: (id, tokens), as of lattice_tokens.

    Kind of token (numbers, symbols; words of any part of speech weigh 1) times its place, as a share of the text; with doc_freqs
    (term, df) times a smoothed inverse document frequency; more for longer terms; scaled to the largest. Terms of LEAST_WEIGHT or
    less, or of one character, go, and the rest is scaled again. A place is at an end if it is one of the first three or beyond a third of the text's length in characters.
    """
    placed = tokens.join(texts.select("id", F.length("text").alias("__length")), "id").select("id", "__length", F.posexplode("tokens").alias("pos", "term"))
    placed = placed.where((F.trim("term") != "") & ~F.col("term").rlike(r"^\s*$") & ~F.col("term").isin(list(stop_words)))
    kind = F.when(F.col("term").rlike(_NUMBER), NUMBER_WEIGHT).when(F.col("term").rlike(_CJK) | F.col("term").rlike(_WORD), 1.0).otherwise(SYMBOL_WEIGHT)
    at_end = F.when((F.col("pos") < 3) | (F.col("pos") > F.col("__length") / 3), END_WEIGHT).otherwise(1.0)
    sums = placed.groupBy("id", "term").agg(F.sum(kind * at_end).alias("w"))
    of = Window.partitionBy("id")
    weight = F.col("w") / F.sum("w").over(of)
    if doc_freqs is not None:
        sums = sums.join(doc_freqs.select("term", "df"), "term", "left")
        weight = weight * (F.log((total_docs + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1)
    out = sums.select("id", "term", (weight * (1 + LENGTH_STEP * (F.length("term") - 1))).alias("weight"))
    out = out.withColumn("weight", F.col("weight") / F.max("weight").over(of)).where((F.col("weight") > LEAST_WEIGHT) & (F.length("term") >= LEAST_LENGTH))
    return out.withColumn("weight", F.col("weight") / F.max("weight").over(of))
