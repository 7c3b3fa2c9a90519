"""URL filters: ordered rules, then segmented host and path words under naive Bayes.

`split_url` cuts host and path; `rule_of` finds the longest rule (host and its subdomains, path prefix).
For the rest, host names are cut into words by the most likely segmentation under a unigram model
(Viterbi), path tokens likewise, and a multinomial naive Bayes with add-one smoothing scores the words.
It learns from the rules' own verdicts; urls that no rule covers count as allowed there, as most are.
Each distinct run of letters is segmented once, with the counts of the words in it joined from the full
counts by hashes; the words' odds are joined likewise, so neither model has a bound or passes through the driver.

Defined results: a null url, or one without "://", has an empty host and path, no rule and no words, so
the more frequent class decides (allow on a tie or without any labelled url); rows may repeat.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideglass.llm._common import staged

#: (verdict, host, path prefix)
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: What an unknown word pays for each letter, as log probability.
_LETTER = 2.5
#: Of the hashes of windows: odd, so that it can be divided by modulo 2 ** 64.
_BASE = 6364136223846793005
#: Letters hashed at a time.
_PIECE = 500_000
_RUN = re.compile(r"[a-z]+|[0-9]+|[^\W\d_a-z]+")


def split_url(url: Column | str = "url") -> tuple[Column, Column]:
    """(host, path): between the first "://" and / ? # (A-Z lower-cased), and from there up to ? or #."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), upper, lower)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def page_text(html: Column | str = "html") -> Column:
    """Title and text of a page, without scripts, styles, comments, tags, entities, urls, addresses and dotted names."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^<>]*+>", " ")
    return F.regexp_replace(text, r"&#?\w+;|(?<!\S)\S*(?:://|@)\S*|(?<![\p{L}\p{N}_-])[\p{L}\p{N}_-]++\.[\p{L}\p{N}_.-]*[\p{L}\p{N}]", " ")


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (host and path together) that fits; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


class Segmenter:
    """Most likely words of a name without spaces."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        """total: of all words, where counts holds only those that a name may be cut into."""
        self.total = total or sum(counts.values()) or 1
        self.log_p = {w: math.log(n / self.total) for w, n in counts.items()}

    def __call__(self, name: str) -> list[str]:
        """By Viterbi; a word that is not known pays for itself and for each letter, however long it is, so an open one is carried along."""
        lengths = sorted(set(map(len, self.log_p)))
        opening, log_p = math.log(self.total + 1), self.log_p
        best, back, unknown, start = [0.0], [0], -math.inf, 0
        for end in range(1, len(name) + 1):
            if best[end - 1] - opening > unknown:
                unknown, start = best[end - 1] - opening, end - 1
            unknown -= _LETTER
            options = [(unknown, -start)]
            options += [(best[k] + log_p[name[k:end]], -k) for k in (end - n for n in lengths if n <= end) if name[k:end] in log_p]
            score, k = max(options)
            best.append(score)
            back.append(-k)
        words, end = [], len(name)
        while end:
            words.append(name[back[end] : end])
            end = back[end]
        return words[::-1]

    def tokens(self, text: str) -> list[str]:
        """Words of a host or path: letters are segmented, numbers are one token."""
        return [w for run in _RUN.findall(text.lower()) for w in (["0"] if run.isdigit() else self(run))]


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n): how often each lower-cased word of two letters or more occurs in (text)."""
    words = texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("word"))
    return words.where("length(word) > 1").groupBy("word").agg(F.count("*").alias("n"))


def _runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        found = [(part, "0" if run.isdigit() else run) for part in frame["part"] for run in _RUN.findall(part.lower())]
        yield pd.DataFrame(found, columns=["part", "run"])


def runs_of(parts: DataFrame) -> DataFrame:
    """(part, run): the runs of letters or digits of each row of parts; all numbers are the run "0"."""
    return parts.mapInPandas(_runs, "part string, run string")


def _pieces(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, text number of each letter, letters left from there on, running hash sums) of texts joined to some _PIECE letters.

    The letters i to j hash to (sums[j] - sums[i]) / _BASE ** i modulo 2 ** 64. A longer text makes a piece of its own.
    """
    first, held, size = 0, [], 0
    for k, text in enumerate([*texts, None]):
        if held and (text is None or size + len(text) > _PIECE):
            lengths = np.array([len(t) for t in held])
            ends = np.cumsum(lengths)
            letters = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * _powers(_BASE, size))])
            yield first, np.repeat(np.arange(len(held)), lengths), np.repeat(ends, lengths) - np.arange(size), sums
            first, held, size = k, [], 0
        if text is not None:
            held.append(text)
            size += len(text)


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[:1] = 1
    return np.cumprod(factors)


def _windows(frames: Iterator[pd.DataFrame], lengths: list[int]) -> Iterator[pd.DataFrame]:
    """(id, hash): the windows of these lengths of each run, equal ones of a run once."""
    for frame in frames:
        ids = frame["id"].to_numpy()
        for first, row, left, sums in _pieces(list(frame["run"])):
            inverse = _powers(pow(_BASE, -1, 2**64), len(row))
            for length in lengths:
                at = np.flatnonzero(left >= length)
                if not len(at):
                    break
                hashes = ((sums[at + length] - sums[at]) * inverse[at]).view(np.int64)
                yield pd.DataFrame({"id": ids[first + row[at]], "hash": hashes}).drop_duplicates()


def _hash_words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for first, row, left, sums in _pieces(list(frame["word"])):
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            hashes = (sums[starts + left[starts]] - sums[starts]) * _powers(pow(_BASE, -1, 2**64), len(row))[starts]
            words = frame.iloc[first + row[starts]]
            yield pd.DataFrame({"hash": hashes.view(np.int64), "word": words["word"], "n": words["n"]})


def _segment(frames: Iterator[pd.DataFrame], total: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        tokens = [Segmenter({w["word"]: w["n"] for w in known} if known is not None else {}, total)(run) for run, known in zip(frame["run"], frame["known"])]
        yield pd.DataFrame({"run": frame["run"], "tokens": tokens})


def segment(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """(run, tokens) of distinct runs (run), by the counts (word, n) of all words.

    The words that may be in a run are found by hashes of its windows of the lengths that words have (a list of
    numbers, the one thing that passes through the driver); the segmenter looks words up themselves, so that two with
    one hash do no harm. Memory grows with the longest run, not with its windows.
    """
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(1))).first()[0]
    lengths = sorted(r[0] for r in counts.select(F.length("word")).distinct().collect() if r[0])
    runs = staged(runs.withColumn("id", F.monotonically_increasing_id()))
    words = counts.where("word <> ''").mapInPandas(_hash_words, "hash long, word string, n long")
    windows = runs.select("id", "run").mapInPandas(partial(_windows, lengths=lengths), "id long, hash long")
    known = windows.join(words, "hash").groupBy("id").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    return runs.join(known, "id", "left").mapInPandas(partial(_segment, total=total), "run string, tokens array<string>")


def train_bayes(tokens: DataFrame, urls: DataFrame) -> tuple[DataFrame, float]:
    """((word, odds): log odds of block for each word, log prior odds).

    tokens: (verdict, word, n), n times this word in urls of this verdict; urls: (verdict, n).
    """
    seen = {r["verdict"]: r["n"] for r in urls.groupBy("verdict").agg(F.sum("n").alias("n")).collect()}
    prior = math.log((seen.get("block", 0) + 1) / (seen.get("allow", 0) + 1))
    of = lambda verdict: F.sum(F.when(F.col("verdict") == verdict, F.col("n")).otherwise(0)).alias(verdict)
    words = staged(tokens.groupBy("word").agg(of("block"), of("allow")))
    total = words.agg(F.sum("block"), F.sum("allow"), F.count("*")).first()
    base = math.log(((total[0] or 0) + total[2] + 1) / ((total[1] or 0) + total[2] + 1))
    return words.select("word", (F.log((F.col("block") + 1) / (F.col("allow") + 1)) - base).alias("odds")), prior


def _sum_odds() -> Column:
    """Exact in any order."""
    return F.sum(F.col("odds").cast("decimal(38,12)")).cast("double").alias("odds")


def judge(pages: DataFrame, texts: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, odds) of every row of pages (page_id, url).

    texts (text): where the segmenter's words are counted. odds: the log odds of block by naive Bayes.
    """
    host, path = split_url("url")
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = staged(urls.withColumn("rule", rule).withColumn("by_rule", verdict))
    # numbers are one token whatever they are, so that paths repeat and each is cut once
    urls = urls.withColumn("shape", F.regexp_replace("path", r"\d+", "0"))
    pairs = staged(urls.groupBy("host", "shape", F.coalesce("by_rule", F.lit("allow")).alias("verdict")).agg(F.count("*").alias("n")))
    parts = pairs.select(F.col("host").alias("part")).unionByName(pairs.select(F.col("shape").alias("part"))).distinct()
    runs = staged(runs_of(parts))
    cut = staged(segment(runs.select("run").distinct(), staged(count_words(texts))).select("run", F.explode("tokens").alias("word")))
    seen = pairs.select("verdict", F.col("host").alias("part"), "n").unionByName(pairs.select("verdict", F.col("shape").alias("part"), "n"))
    of_part = seen.groupBy("part", "verdict").agg(F.sum("n").alias("n"))
    of_run = of_part.join(runs, "part").groupBy("run", "verdict").agg(F.sum("n").alias("n"))
    odds, prior = train_bayes(of_run.join(cut, "run").select("verdict", "word", "n"), pairs)
    run_odds = cut.join(odds, "word").groupBy("run").agg(_sum_odds())
    scored = staged(runs.join(run_odds, "run").groupBy("part").agg(_sum_odds()))
    of = lambda name: scored.select(F.col("part").alias(name), F.col("odds").alias(f"{name}_odds"))
    urls = urls.join(of("host"), "host", "left").join(of("shape"), "shape", "left")
    total = F.coalesce("host_odds", F.lit(0.0)) + F.coalesce("shape_odds", F.lit(0.0)) + F.lit(prior)
    learned = F.when(total > 0, "block").otherwise("allow")
    return urls.select("page_id", "host", "path", "rule", F.coalesce("by_rule", learned).alias("verdict"), total.alias("odds"))
