"""Quality rules as a short-circuit cascade, in DataFrame operations only.

A rule is a test on features of the text, each computed by built-in functions.  The cascade looks at
a bounded sample (``SAMPLE_ROWS`` rows, drawn at random while partitions are read until enough are
found).  For each row of it and each rule, it learns whether the rule rejects and what its features
cost, in steps that are counted (characters scanned, words hashed) and not timed, so reruns agree.
The order is greedy: the next rule is always the one with the most rejections per cost among the
rows that the rules before it let through.  One CASE expression then evaluates the rules in that
order; as CASE stops at the first test that holds, a text that an early rule rejects never pays for
the features of a later one.  The order changes what is spent, never the verdict, as a text is kept
when no rule rejects it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import SPACE_CLASS, SPACES, WORD_CLASS, let, words_of

WINDOW = 5
SAMPLE_ROWS, SAMPLE_FRACTION = 500, 0.2
SYMBOLS = "#*$%&|<>"
DOTS = rf"(\.\.\.|\x{{2026}}){SPACE_CLASS}*\z"


def word_chars(text: Column) -> Column:
    """Code points in words."""
    return F.length(F.translate(F.coalesce(text, F.lit("")), SPACES, "")).cast("long")


def n_symbols(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def lines_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(WORD_CLASS))


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(lines_of(text), lambda lines: F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def n_repeat_words(words: Column) -> Column:
    """Of the words of a text, those covered by a window of five that it holds twice or more.

    Windows are compared by a 64-bit hash within one text.  A text whose windows all differ, as most
    do, ends after one pass; else the windows are sorted by hash and the covered words counted.
    """

    def hashed(words: Column) -> Column:
        window = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))
        return F.when(F.size(words) < WINDOW, F.array().cast("array<bigint>")).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), window))

    def repeated(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(e: Column) -> Column:
            same = lambda s, j: F.coalesce(F.get(e, j)["h"] == s["h"], F.lit(False))
            twice = F.filter(e, lambda s, j: (F.when(j > 0, same(s, j - 1)).otherwise(False)) | same(s, j + 1))
            return F.sort_array(F.transform(twice, lambda s: s["i"]))

        return F.aggregate(
            let(placed, starts),
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n")),
            lambda a: a["n"],
        )

    return let(hashed(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(repeated(h))).cast("long")


def n_letters(text: Column) -> Column:
    """Code points that are letters or marks of letters."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{M}]", "")).cast("long")


def n_dot_lines(text: Column) -> Column:
    """Lines that end with an ellipsis."""
    return F.size(F.filter(lines_of(text), lambda x: x.rlike(DOTS))).cast("long")


@dataclass(frozen=True)
class Feature:
    """``value`` gets the text and its words, which are split once for all features; ``cost`` counts steps."""

    value: Callable[[Column, Column], Column]
    cost: Callable[[Column, Column], Column]


#: The steps for a character or a word are how often a feature's expression visits or builds one.
FEATURES: dict[str, Feature] = {
    "n_words": Feature(lambda text, words: F.size(words).cast("long"), lambda chars, words: F.lit(1)),
    "word_chars": Feature(lambda text, words: word_chars(text), lambda chars, words: 2 * chars),
    "n_symbols": Feature(lambda text, words: n_symbols(text), lambda chars, words: 2 * chars),
    "n_lines": Feature(lambda text, words: F.size(lines_of(text)).cast("long"), lambda chars, words: 2 * chars),
    "n_dup_lines": Feature(lambda text, words: n_dup_lines(text), lambda chars, words: 3 * chars),
    "n_repeat_words": Feature(lambda text, words: n_repeat_words(words), lambda chars, words: 4 * WINDOW * words),
    "n_letters": Feature(lambda text, words: n_letters(text), lambda chars, words: 4 * chars),
    "n_dot_lines": Feature(lambda text, words: n_dot_lines(text), lambda chars, words: 4 * chars),
}
#: What the query returns; the others are only computed where the cascade comes to their rules.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``reject`` gets a function from a feature's name to its column; ``needs`` names those features."""

    name: str
    needs: tuple[str, ...]
    reject: Callable[[Callable[[str], Column]], Column]


#: The first two are the base rules of the contract.
RULES = (
    Rule("too_short", ("n_words",), lambda f: f("n_words") < 10),
    Rule("repeats", ("n_words", "n_repeat_words"), lambda f: 100 * f("n_repeat_words") > 20 * f("n_words")),
    Rule("word_length", ("n_words", "word_chars"), lambda f: f("word_chars") > 20 * f("n_words")),
    Rule("symbols", ("n_words", "n_symbols"), lambda f: 10 * f("n_symbols") > 3 * f("n_words")),
    Rule("dup_lines", ("n_lines", "n_dup_lines"), lambda f: 2 * f("n_dup_lines") > f("n_lines")),
    Rule("few_letters", ("word_chars", "n_letters"), lambda f: 2 * f("n_letters") < f("word_chars")),
    Rule("cut_lines", ("n_lines", "n_dot_lines"), lambda f: 10 * f("n_dot_lines") > 3 * f("n_lines")),
)
BASE_RULES = ("too_short", "repeats")


def _on(text: Column, body: Callable[[Callable[[str], Column]], Column]) -> Column:
    """``body`` of a function from a feature's name to its column."""
    return let(words_of(text), lambda words: body(lambda name: FEATURES[name].value(text, words)))


def greedy(rejects: Sequence[Sequence[bool]], costs: Sequence[Sequence[float]]) -> list[int]:
    """The order of rules, given a row for each document and in it a number for each rule.

    Of equal rules the cheaper, then the first goes first; rules that reject nothing any more come last.
    """
    left, rows, out = list(range(len(rejects[0]) if rejects else 0)), list(range(len(rejects))), []
    while left:
        cost = {k: sum(costs[i][k] for i in rows) for k in left}
        best = min(left, key=lambda k: (-sum(rejects[i][k] for i in rows) / max(cost[k], 1e-9), cost[k], k))
        out.append(best)
        left.remove(best)
        rows = [i for i in rows if not rejects[i][best]]
    return out


def ordered(docs: DataFrame, text: Column, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS, have: Sequence[str] = ()) -> list[Rule]:
    """The rules by rejections per cost on a sample of at most ``sample_rows`` rows; features in ``have`` are free.

    ``limit`` under ``collect`` reads partitions until it has the rows, so a large table isn't
    scanned; a flag and a number for each rule come to the driver.
    """
    sample = docs.where(F.rand(7) < SAMPLE_FRACTION)
    chars = F.length(F.coalesce(text, F.lit(""))).cast("double")

    def steps(rule: Rule, words: Column) -> Column:
        total = F.lit(1.0)
        for name in rule.needs:
            if name not in have:
                total = total + FEATURES[name].cost(chars, words)
        return total

    def measured(words: Column) -> Column:
        feature = lambda name: FEATURES[name].value(text, words)
        size = F.size(words).cast("double")
        return F.struct(F.array(*(rule.reject(feature) for rule in rules)).alias("rejects"), F.array(*(steps(rule, size) for rule in rules)).alias("costs"))

    found = [r[0] for r in sample.select(let(words_of(text), measured)).limit(sample_rows).collect()]
    if not found:
        return list(rules)
    return [rules[k] for k in greedy([r["rejects"] for r in found], [r["costs"] for r in found])]


def first_failed(rules: Sequence[Rule], feature: Callable[[str], Column]) -> Column:
    """Name of the first rule, in the order given, that rejects; null if none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.reject(feature), F.lit(rule.name)).otherwise(out)
    return out


def cascade(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their columns as they are.

    A null or empty text has no words and fails ``too_short``.  Repeated rows are judged alike; an
    empty table gives an empty table; other columns, of any name, pass through untouched.
    """
    text = F.col(f"`{text_col}`")
    order = ordered(docs, text, rules, sample_rows)
    return docs.where(_on(text, lambda feature: first_failed(order, feature)).isNull())


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Each row's id, the ``REPORTED`` features, ``base_failed`` and ``kept``.

    The reported features are computed for every row, as they are asked for.  The base rules come
    first, as the contract wants their outcome apart; the others follow in the order of the cascade,
    those on reported features at next to no cost, and the features that only they need are computed
    for the texts that got so far.  Null and empty texts, repeated rows and an empty table are treated
    as in ``cascade``; null ids stay null; other columns aren't read.
    """
    text = F.col(f"`{text_col}`")
    later = [r for r in rules if r.name not in BASE_RULES]
    order = ordered(docs, text, later, sample_rows, REPORTED)
    cut = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), words_of(text).alias("words"))
    made = cut.select("doc_id", "text", "words", *(FEATURES[name].value(F.col("text"), F.col("words")).alias(name) for name in REPORTED))
    feature = lambda name: F.col(name) if name in REPORTED else FEATURES[name].value(F.col("text"), F.col("words"))
    base = first_failed([r for r in rules if r.name in BASE_RULES], feature).isNotNull()
    kept = F.when(base, F.lit(False)).otherwise(first_failed(order, feature).isNull())
    return made.select("doc_id", *REPORTED, base.alias("base_failed"), kept.alias("kept"))


#: SQL for DuckDB that gives what the query gives.
SQL = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{WORD_CLASS}+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD_CLASS}')) AS l
  FROM documents),
g AS (SELECT k, i, array_to_string(list_slice(w, i, i + 4), ' ') AS s
      FROM (SELECT k, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, s) AS n FROM g) WHERE n > 1),
c AS (SELECT k, count(DISTINCT i + j) AS n FROM r, (SELECT unnest(range(0, 5)) AS j) GROUP BY k),
f AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{SPACE_CLASS}', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(t, '[^\p{{L}}\p{{M}}]', '', 'g')) AS n_letters, len(list_filter(l, lambda x: regexp_matches(x, '{DOTS}'))) AS n_dot_lines
  FROM d LEFT JOIN c USING (k))
SELECT * EXCLUDE (n_letters, n_dot_lines), n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR word_chars > 20 * n_words
            OR 10 * n_symbols > 3 * n_words OR 2 * n_dup_lines > n_lines
            OR 2 * n_letters < word_chars OR 10 * n_dot_lines > 3 * n_lines) AS kept
FROM f
"""
