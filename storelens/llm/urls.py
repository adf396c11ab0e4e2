"""URL filter: host rules, and naive Bayes over segmented host words and path tokens.

Concatenated names in hosts are split into words by unigram Viterbi.  Word counts come from the text
of all pages.  Only counts of words that are substrings of some host name are looked up, by a join,
so no dictionary is sent anywhere or cut short.  A multinomial naive Bayes model over host words and
path tokens learns from the rules: pages that a rule decides are its examples, with the rule's
verdict.  It decides the pages that no rule fits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import stored

#: (verdict, host, path): fits the host and its subdomains where the path starts so; the longest wins.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
PREFIX = 24  # letters by which longer words are looked up

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def segment(name: str, counts: dict[str, int], total: int) -> list[str]:
    """The split of ``name`` with the highest product of word probabilities.

    A word of n letters that was never counted has probability 10 / (total * 10**n); words may have any
    length.  Of equal products, that with the longest last word is taken, and so on to the front.
    """
    total, ten = max(total, 1), math.log(10)
    new = math.log(10 / total)
    longest = max(map(len, counts), default=0)
    best = [(0.0, 0)]
    begins, value = 0, 0.0  # where the best uncounted last word begins, and what it's worth at no length
    for end in range(1, len(name) + 1):
        found = (value + new - end * ten, begins)
        for begin in range(max(0, end - longest), end):
            n = counts.get(name[begin:end])
            if n:
                score = best[begin][0] + math.log(n / total)
                if score > found[0] or (score == found[0] and begin < found[1]):
                    found = (score, begin)
        best.append(found)
        if found[0] + end * ten > value:
            begins, value = end, found[0] + end * ten
    out, end = [], len(name)
    while end:
        out.append(name[best[end][1] : end])
        end = best[end][1]
    return out[::-1]


def word_counts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(word, n) of the lower-case a-z words outside of tags."""
    text = F.regexp_replace(F.coalesce(F.col(f"`{html_col}`"), F.lit("")), "<[^>]*>", " ")
    words = pages.select(F.explode(F.split(F.translate(text, _UPPER, _LOWER), "[^a-z]+")).alias("word"))
    return words.where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def names_of(host: Column) -> Column:
    """Runs of letters in a host, without its last label."""
    return F.regexp_extract_all(F.regexp_replace(host, r"\.?[^.]*$", ""), F.lit("[a-z]+"), 0)


def segmented_names(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words) of distinct ``names(name)``.

    Substrings of up to ``PREFIX`` letters are looked up as they are; longer words by their first
    ``PREFIX`` letters, then compared, so a name gives rows in proportion to its length.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    begin = names.select("name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("i"))
    longest = F.least(F.lit(PREFIX), F.length("name") - F.col("i") + 1)
    parts = begin.select("name", "i", F.explode(F.sequence(F.lit(1), longest)).alias("m"))
    parts = parts.select("name", F.expr("substring(name, i, m)").alias("word")).distinct()
    short = parts.join(counts, "word").select("name", "word", "n")
    long = counts.where(F.length("word") > PREFIX).select(F.substring("word", 1, PREFIX).alias("head"), "word", "n")
    heads = parts.where(F.length("word") == PREFIX).withColumnRenamed("word", "head")
    long = heads.join(long, "head").where("contains(name, word)").select("name", "word", "n")
    known = short.union(long).groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [segment(name, {k["word"]: k["n"] for k in known or ()}, total) for name, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], ["name", "words"])

    return names.join(known, "name", "left").select("name", "known").mapInArrow(split, "name string, words array<string>")


def bayes(examples: DataFrame) -> tuple[DataFrame, int, int]:
    """(token, odds), odds of an unseen token, prior odds; from (tokens, verdict, n).

    Odds are log(P(token | block) / P(token | allow)) with add-one smoothing over the tokens of the
    examples, in millionths, so that their sums don't depend on the order of addition.
    """
    of = lambda v: F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).alias(v)
    pages = [int(x or 0) + 1 for x in examples.agg(of("block"), of("allow")).first()]
    counted = stored(examples.select(F.explode("tokens").alias("token"), "verdict", "n").groupBy("token").agg(of("block"), of("allow")), "tokens")
    block, allow, size = (int(x or 0) for x in counted.agg(F.sum("block"), F.sum("allow"), F.count("*")).first())
    block, allow = block + size + 1, allow + size + 1  # one more for a token that no example has
    odds = F.round((F.log((F.col("block") + 1) / F.lit(float(block))) - F.log((F.col("allow") + 1) / F.lit(float(allow)))) * 1e6).cast("bigint")
    model = stored(counted.select("token", odds.alias("odds")), "model")
    return model, round(math.log(allow / block) * 1e6), round(math.log(pages[0] / pages[1]) * 1e6)


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, host_words, odds), a row for each row of ``pages``.

    A null URL, or one without ``://``, has an empty host and path, no rule and no tokens, and is
    allowed, as are even odds.  Odds and words are given for all, whether a rule decides or not.
    Repeated rows are judged alike; null ids stay null; URLs, names and words have any length; an empty
    table returns no rows; other columns aren't read.
    """
    url = F.col(f"`{url_col}`")
    rows = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    distinct = rows.groupBy("host", "path").agg(F.count("*").alias("n"))
    distinct = stored(distinct.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)), "urls")
    hosts = distinct.select("host").distinct().select("host", F.posexplode(names_of(F.col("host"))).alias("k", "name"))
    names = stored(segmented_names(hosts.select("name").distinct(), stored(word_counts(pages, html_col), "words")), "names")
    placed = hosts.join(names, "name").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("k", "words"))).alias("w"))
    words = stored(placed.select("host", F.flatten(F.transform("w", lambda x: x["words"])).alias("host_words")), "hosts")  # one host may have most pages
    path_tokens = F.regexp_extract_all(F.translate("path", _UPPER, _LOWER), F.lit("[a-z0-9]+"), 0)
    full = distinct.join(words, "host", "left").withColumn("host_words", F.coalesce("host_words", F.array().cast("array<string>")))
    full = stored(full.withColumn("tokens", F.concat("host_words", path_tokens)), "urls")

    model, unseen, prior = bayes(full.where("r IS NOT NULL").select("tokens", F.col("r.verdict").alias("verdict"), "n"))
    scored = full.select("host", "path", F.explode("tokens").alias("token")).join(model, "token", "left")
    scored = scored.groupBy("host", "path").agg(F.sum(F.coalesce("odds", F.lit(unseen))).alias("odds"))
    scored = full.join(scored, ["host", "path"], "left").select("host", "path", "r", F.array_join("host_words", " ").alias("host_words"), (F.coalesce("odds", F.lit(0)) + prior).alias("odds"))
    scored = stored(scored, "scored")  # written: many rows may have one URL, or none
    method = F.when(F.col("odds") > 0, "block").otherwise("allow")
    return rows.join(scored, ["host", "path"]).select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", method).alias("verdict"), "host_words", "odds")
