"""Infrastructure and database constructs in Terraform and SQL texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Points of each construct.
POINTS = {
    "terraform_resources": 8,
    "terraform_data_sources": 6,
    "terraform_modules": 10,
    "terraform_providers": 6,
    "terraform_dynamic_blocks": 4,
    "terraform_iterations": 3,
    "terraform_explicit_dependencies": 5,
    "terraform_conditionals": 3,
    "sql_tables": 8,
    "sql_foreign_references": 8,
    "sql_indexes": 4,
    "sql_views": 10,
    "sql_procedures": 24,
    "sql_functions": 24,
    "sql_triggers": 20,
    "sql_joins": 4,
    "sql_ctes": 5,
    "sql_unions": 3,
}
TERRAFORM = tuple(k for k in POINTS if k.startswith("terraform_"))
SQL = tuple(k for k in POINTS if k.startswith("sql_"))
# Words of SQL constructs; the first group counts only after "create" within four tokens.
CREATED = {"sql_tables": "table", "sql_indexes": "index", "sql_views": "view", "sql_procedures": "procedure", "sql_functions": "function", "sql_triggers": "trigger"}
PLAIN = {"sql_foreign_references": "references", "sql_joins": "join", "sql_unions": "union"}
# First words of Terraform blocks.
BLOCKS = {"terraform_resources": "resource", "terraform_data_sources": "data", "terraform_modules": "module", "terraform_providers": "provider", "terraform_dynamic_blocks": "dynamic"}

#: Comments and quoted text of SQL, closed or not; a doubled quote stays inside.
SQL_NOISE = r"""--[^\n]*|/(?=\*)(?:[\s\S]*?\*/|[\s\S]*)|'(?:''|[^'])*+'?|"(?:""|[^"])*+"?"""
SQL_BREAKS = r"[ \t\r\n(){};,.\[\]]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sql_tokens(text: Column) -> Column:
    """Lower-case tokens outside of comments and quotes."""
    clean = F.translate(F.regexp_replace(text, SQL_NOISE, " "), _UPPER, _LOWER)
    return F.filter(F.split(clean, SQL_BREAKS), lambda t: t != "")


def sql_hits(tokens: Column) -> Column:
    """The few tokens that count: array of struct(t, ddl, after).

    ``ddl`` tells whether "create" is among the four tokens before, ``after`` whether it's the one
    before.  One pass over the tokens; all counts are made from what it leaves.
    """
    words = (*CREATED.values(), *PLAIN.values(), "with")

    def marked(all_tokens: Column) -> Column:
        def hit(t: Column, i: Column) -> Column:
            recent = F.slice(all_tokens, F.greatest(i - 3, F.lit(1)), F.least(i, F.lit(4)))
            after = F.coalesce(F.get(all_tokens, i - 1) == "create", F.lit(False))
            return F.when(t.isin(*words), F.struct(t.alias("t"), F.array_contains(recent, "create").alias("ddl"), after.alias("after")))

        return F.filter(F.transform(all_tokens, hit), lambda h: h.isNotNull())

    return F.get(F.transform(F.array(tokens), marked), F.lit(0))


def sql_counts(hits: Column) -> dict[str, Column]:
    """Counts by construct, from ``sql_hits`` of a text."""

    def count(test) -> Column:
        return F.size(F.filter(hits, test)).cast("bigint")

    def created(word: str) -> Column:
        return count(lambda h: (h["t"] == word) & h["ddl"])

    def plain(word: str) -> Column:
        return count(lambda h: h["t"] == word)

    out = {name: created(word) for name, word in CREATED.items()} | {name: plain(word) for name, word in PLAIN.items()}
    out["sql_ctes"] = count(lambda h: (h["t"] == "with") & ~h["after"])
    return out


def _from(text: Column, start) -> Column:
    return F.substring(text, start, F.length(text) + 1)


def terraform_counts(text: Column) -> Column:
    """Array of the counts of ``TERRAFORM``, in that order.

    A fold over the lines carries whether a block comment is open.  In one, a line counts from its
    end mark on.  What follows the next start mark is dropped, and a comment stays open unless an end
    mark follows on that line.
    """
    starts_word = lambda line, word: line.rlike(f'^{word}($|[ \\t\\n\\x0b\\f\\r"{{])')
    assigns = lambda line, words: line.rlike(f"^({words})[ \\t]*=")

    def merge(state: Column, raw: Column) -> Column:
        end = F.instr(raw, "*/")
        seen = F.when(~state["open"], raw).when(end > 0, _from(raw, end + 2)).otherwise("")
        start = F.instr(seen, "/*")
        still = F.when(state["open"] & (end == 0), True).otherwise((start > 0) & (F.instr(_from(seen, start + 2), "*/") == 0))
        line = F.btrim(F.when(start > 0, F.left(seen, start - 1)).otherwise(seen), F.lit(" \t\r"))
        live = ~line.startswith("#") & ~line.startswith("//")
        flags = [starts_word(line, word) for word in BLOCKS.values()]
        flags += [assigns(line, "for_each|count"), assigns(line, "depends_on"), line.contains(" ? ")]
        counts = F.zip_with(state["n"], F.array(*((live & f).cast("bigint") for f in flags)), lambda x, y: x + y)
        return F.struct(still.alias("open"), counts.alias("n"))

    zero = F.struct(F.lit(False).alias("open"), F.array(*(F.lit(0).cast("bigint") for _ in TERRAFORM)).alias("n"))
    return F.aggregate(F.split(text, "\n", -1), zero, merge, lambda s: s["n"])


def points(counts) -> Column:
    """Weighted sum; ``counts`` maps a construct's name to its column."""
    out = F.lit(0).cast("bigint")
    for name, weight in POINTS.items():
        out = out + weight * counts(name)
    return out
