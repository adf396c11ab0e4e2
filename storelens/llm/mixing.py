"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every source has a share of all words by its weight, at most ``MAX_COPIES`` times its own words; what
is above is shared again among the others by weight.  A document of a source is wanted target /
source_size times: the whole part is taken for sure, the fraction is rounded.

Rounding is pivotal.  Two parties with fractions meet; words move from one to the other, in a
direction drawn so that both keep their expectation, until one of them is whole.  The words of the
pair stay the same, so a source's total stays at its target.  Documents are dealt into chunks of
about ``CHUNK`` by hash.  In a chunk each document, larger ones first, meets the bundle of those
after it; so what is undecided in the end is small.  A chunk has one undecided document left.  Those
meet in chunks of ``CHUNK`` again, and so on: a reduction tree whose depth is the logarithm of the
number of documents.  The last one of a source is drawn.  All draws come from hashes of the rows, so
reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelens.llm.common import WORD_CLASS, let, stored

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
CHUNK = 128
SPREAD = 4096
SEED = 17


def _uniform(*columns: Column) -> Column:
    """A number from 0 to below 1 that the columns determine."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") * F.lit(2.0**-53)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS + "+")), F.lit(0)).cast("bigint")


def targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target) of (source, size) rows; sources rank by code point, null last.

    With a level v, a source gets v times its weight or its cap, whichever is less.  Sources ordered
    by cap / weight are capped up to a point; v is what is left over the weights left at that point.
    The tables here have a row for each source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(w) for w in WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int"))
    per = per.select("source", "source_size", weight.alias("w"), rank.alias("k"))
    per = per.withColumn("cap", MAX_COPIES * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "k")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    every = Window.partitionBy()
    level = per.withColumn("v", (F.sum("source_size").over(every) - before) / rest).withColumn("k", F.row_number().over(order))
    first = F.min(F.when(F.col("v") * F.col("w") <= F.col("cap"), F.struct("k", "v"))).over(every)
    return level.select("source", "source_size", F.least(F.col("w") * first["v"], F.col("cap").cast("double")).alias("target"))


_ENTRY = "struct<mass:bigint,u:bigint,doc_id:bigint,size:bigint,n:bigint,x:double>"
_DONE = "array<struct<doc_id:bigint,size:bigint,n:bigint,up:int>>"
_STATE = f"struct<p:double,q:double,left:double,mass:double,shut:boolean,cur:{_ENTRY},done:{_DONE}>"


def _fold(entries: Column, level: int) -> Column:
    """Pivotal rounding of entries, larger ones first: struct(..., cur, done).

    An entry pairs with the bundle of all entries after it.  What the bundle gives or gets is spread
    over it evenly, so later probabilities are p * x + q; ``left`` is the mass that the undecided
    entries have, ``mass`` what they could have.  If the bundle becomes integral first, the entry
    stays as ``cur`` and the rest is decided (``shut``); else the last, smallest entry stays.
    """
    none = F.lit(None).cast(_ENTRY)

    def state(p, q, left, mass, shut, cur, done) -> Column:
        return F.struct(p.alias("p"), q.alias("q"), left.alias("left"), mass.alias("mass"), shut.alias("shut"), cur.alias("cur"), done.alias("done")).cast(_STATE)

    def staying(e: Column, x: Column) -> Column:
        return F.struct(e["mass"], e["u"], e["doc_id"], e["size"], e["n"], x).cast(_ENTRY)

    def meet(acc: Column, e: Column) -> Column:
        def put(up) -> Column:
            return F.concat(acc["done"], F.array(F.struct(e["doc_id"], e["size"], e["n"], up)).cast(_DONE))

        m = e["mass"].cast("double")
        x = F.least(F.greatest(acc["p"] * e["x"] + acc["q"], F.lit(0.0)), F.lit(1.0))
        has = x * m
        rest = F.greatest(acc["left"] - has, F.lit(0.0))  # what the bundle has
        bundle = acc["mass"] - m
        numbers = F.struct(has.alias("has"), (m - has).alias("room"), rest.alias("rest"), F.greatest(bundle - rest, F.lit(0.0)).alias("free"), bundle.alias("bundle"))

        def resolve(v: Column) -> Column:
            gain, loss = F.least(v["room"], v["rest"]), F.least(v["has"], v["free"])
            draw = _uniform(e["u"], F.lit(SEED + level))
            gains = F.when(gain + loss > 0, draw * (gain + loss) < loss).otherwise(v["has"] >= v["room"])
            f = F.when(v["rest"] > 0, (v["rest"] - v["room"]) / v["rest"]).otherwise(1.0)
            g = F.when(v["free"] > 0, (v["free"] - v["has"]) / v["free"]).otherwise(1.0)
            no, yes, zero, one = F.lit(False), F.lit(True), F.lit(0.0), F.lit(1.0)
            up = F.when(v["room"] <= v["rest"], state(f * acc["p"], f * acc["q"], v["rest"] - v["room"], v["bundle"], no, none, put(F.lit(1)))).otherwise(
                state(zero, zero, zero, v["bundle"], yes, staying(e, (v["has"] + v["rest"]) / m), acc["done"])
            )
            down = F.when(v["has"] <= v["free"], state(g * acc["p"], g * acc["q"] + 1 - g, v["rest"] + v["has"], v["bundle"], no, none, put(F.lit(0)))).otherwise(
                state(zero, one, v["bundle"], v["bundle"], yes, staying(e, (v["has"] - v["free"]) / m), acc["done"])
            )
            last = state(zero, zero, zero, zero, yes, staying(e, F.least(acc["left"] / m, one)), acc["done"])
            return F.when(v["bundle"] <= 0, last).when(gains, up).otherwise(down)

        decided = state(acc["p"], acc["q"], acc["left"], acc["mass"], acc["shut"], acc["cur"], put(acc["q"].cast("int")))
        return F.when(acc["shut"], decided).otherwise(let(numbers, resolve))

    def run(es: Column) -> Column:
        total = lambda f: F.aggregate(es, F.lit(0.0), lambda a, e: a + f(e))
        start = state(F.lit(1.0), F.lit(0.0), total(lambda e: e["mass"] * e["x"]), total(lambda e: e["mass"].cast("double")), F.lit(False), none, F.array().cast(_DONE))
        return F.aggregate(es, start, meet)

    return let(entries, run)


def decisions(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, source, size, n, source_size, target, whole, up) of (doc_id, source, size) rows.

    Of ``n`` rows that repeat id, source and size, ``up`` are taken ``whole`` + 1 times, the others
    ``whole`` times.  With a fraction x, floor(n * x) of them are up for sure; the rest, below one row,
    is the fraction of one entry that takes part in the rounding.
    """
    sized = stored(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")), "sized")
    total = sized.select("source", (F.col("size") * F.col("n")).alias("size"))
    goal = stored(targets(total), "targets")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = goal.withColumn("whole", F.floor(wanted).cast("int")).withColumn("part", wanted - F.floor(wanted))
    counts = sized.where("size > 0").groupBy("source").agg(F.ceil(F.count("*") / chunk).alias("chunks"))
    names = {c: F.col(c) for c in goal.columns if c != "source"}
    goal = goal.join(counts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select("source", *names, "chunks")
    goal = stored(goal, "goals")
    by = goal.withColumnRenamed("source", "s")
    known = sized.join(by, F.col("source").eqNullSafe(F.col("s"))).drop("s")

    rounded = (F.col("size") > 0) & (F.col("part") > 0)
    u = F.xxhash64("doc_id", "source", "size", F.lit(SEED))
    sure = F.floor(F.col("n") * F.col("part"))
    entry = F.struct(F.col("size").alias("mass"), u.alias("u"), "doc_id", "size", "n", (F.col("n") * F.col("part") - sure).alias("x"))
    now = known.where(rounded).select("source", F.pmod(F.xxhash64(u, F.lit(1)), "chunks").alias("chunk"), entry.alias("entry"))
    most = goal.agg(F.max("chunks")).first()[0] or 0
    decided = []
    level = 0
    while most:
        folded = now.groupBy("source", "chunk").agg(F.sort_array(F.collect_list("entry"), asc=False).alias("entries"))
        folded = stored(folded.select("source", "chunk", _fold(F.col("entries"), level).alias("r")), "rounds")
        decided.append(folded.select("source", F.explode("r.done").alias("d")).select("source", "d.*"))
        left = folded.where("r.cur IS NOT NULL").select("source", "chunk", F.col("r.cur").alias("entry"))
        if most == 1:
            last = F.col("entry")
            up = (_uniform(last["u"], F.lit(SEED - 1)) < last["x"]).cast("int")
            decided.append(left.select("source", last["doc_id"].alias("doc_id"), last["size"].alias("size"), last["n"].alias("n"), up.alias("up")))
            break
        now = left.withColumn("chunk", F.floor(F.col("chunk") / chunk))
        most = -(-most // chunk)
        level += 1

    columns = ("doc_id", "source", "size", "n", "source_size", "target", "whole")
    plain = known.where(~rounded).select(*columns, F.lit(0).cast("bigint").alias("up"))
    for part in decided:
        part = part.join(by, F.col("source").eqNullSafe(F.col("s")))
        plain = plain.union(part.select(*columns, (sure + F.col("up")).cast("bigint").alias("up")))
    return plain


def _repeated(rows: DataFrame, times: str) -> DataFrame:
    """Each row as often as its column ``times`` says; many copies of one row are spread over tasks."""
    one, many = F.lit(1).cast("bigint"), F.col(times)
    few = rows.where(many <= SPREAD).withColumn("__k", F.explode(F.sequence(one, many)))
    parts = rows.where(many > SPREAD).withColumn("__part", F.explode(F.sequence(one, F.ceil(many / SPREAD)))).repartition("doc_id", "__part")
    parts = parts.withColumn("__k", F.explode(F.sequence(one, F.least(F.lit(SPREAD).cast("bigint"), many - (F.col("__part") - 1) * SPREAD))))
    return few.union(parts.select(*few.columns))


def _rows(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), n_words(F.col(f"`{text_col}`")).alias("size"))


def mix_report(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, size, source_size, target, taken), a row for each row of ``docs``.

    Documents are taken whole; those of any length are counted whole.  Null texts and texts without
    words have size 0 and give nothing; a null source is a source of its own; null ids stay null; rows
    that repeat id, source and size are rounded one by one, and it's open which of them are taken more
    often; an empty table returns no rows.  Other columns aren't read.
    """
    made = decisions(_rows(docs, id_col, source_col, text_col))
    taken = F.array(F.struct(F.col("up").alias("m"), (F.col("whole") + 1).alias("c")), F.struct((F.col("n") - F.col("up")).alias("m"), F.col("whole").alias("c")))
    made = made.withColumn("t", F.explode(taken)).where("t.m > 0")
    made = _repeated(made.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("t.c")).alias("taken"), F.col("t.m").alias("m")), "m")
    return made.select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with their columns as they are.

    Nulls, texts without words, repeated rows and an empty table are treated as in ``mix_report``.
    """
    made = stored(decisions(_rows(docs, id_col, source_col, text_col)), "decisions")
    ident, source = F.col(f"`{id_col}`").cast("bigint"), F.col(f"`{source_col}`")
    names = {n: f"__{n}" for n in ("id", "source", "size", "copies", "n", "up")}
    made = made.select(*(F.col(c).alias(names[n]) for c, n in (("doc_id", "id"), ("source", "source"), ("size", "size"), ("whole", "copies"), ("n", "n"), ("up", "up"))))
    same = ident.eqNullSafe(F.col("__id")) & source.eqNullSafe(F.col("__source"))
    if not made.groupBy("__id", "__source").count().where("count > 1").isEmpty():  # else sizes needn't be counted again
        same &= n_words(F.col(f"`{text_col}`")) == F.col("__size")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    alike = (F.col("__up") == 0) | (F.col("__up") == F.col("__n"))  # as all single rows are
    copies = F.col("__copies") + F.when(F.col("__up") > 0, 1).otherwise(0)
    out = docs.join(made.where(alike).withColumn("__copies", copies).where("__copies > 0"), same)
    mixed_groups = made.where(~alike)
    if not mixed_groups.isEmpty():
        out = out.select(*columns, "__copies").union(_first_up(docs.join(mixed_groups, same)).where("__copies > 0").select(*columns, "__copies"))
    return out.select(*columns, F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy")).select(*columns)


def _first_up(rows: DataFrame) -> DataFrame:
    """``rows`` with one copy more for ``__up`` of each group's ``__n`` rows.

    Rows are numbered within parts of a group, of some ``SPREAD`` rows each; a part's share of ``__up``
    is what its rows take of it in the order of the parts, so a group of any size spreads over tasks.
    """
    group = ("__id", "__source", "__size")
    rows = rows.withColumn("__row", F.monotonically_increasing_id())
    rows = stored(rows.withColumn("__part", F.pmod(F.xxhash64("__row"), F.ceil(F.col("__n") / SPREAD))), "alike")
    parts = rows.groupBy(*group, "__part").agg(F.count("*").alias("__many"))
    before = F.coalesce(F.sum("__many").over(Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = stored(parts.select(*(F.col(c).alias(f"{c}_") for c in group), F.col("__part").alias("__part_"), before.alias("__before")), "parts")
    key = F.col("__part") == F.col("__part_")
    for c in group:
        key &= F.col(c).eqNullSafe(F.col(f"{c}_"))
    number = F.row_number().over(Window.partitionBy(*group, "__part").orderBy("__row"))
    numbered = rows.join(parts, key).withColumn("__number", number + F.col("__before"))
    return numbered.withColumn("__copies", F.col("__copies") + F.when(F.col("__number") <= F.col("__up"), 1).otherwise(0))
