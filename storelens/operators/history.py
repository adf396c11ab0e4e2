"""Operators on versions: growth, introduction and deletion, retaining refs, unique weights, changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storelens.functions.paths import basename, extension_of, is_lfs_candidate, shell_quote, short_ref_name
from storelens.plans.graph import MASK_BITS, mask_closure, pair_closure, reverse_closure
from storelens.storage import materialized


def growth_candidates(commits: DataFrame, files: DataFrame) -> DataFrame:
    """(commit, ts, blob): files that a commit has and its first parent hasn't at the same path.

    ``commits(commit, parent, ts)``, ``files(commit, path, blob)``.
    """
    own = commits.join(files, "commit").select("commit", "parent", "ts", "path", "blob")
    before = files.select(F.col("commit").alias("parent"), "path", "blob")
    return own.join(before, ["parent", "path", "blob"], "left_anti").select("commit", "ts", "blob")


def tree_growth(pairs: DataFrame, entries: DataFrame, max_depth: int = 512) -> DataFrame:
    """(blob, first): the first struct(ts, commit) that brings each blob, from trees compared in pairs.

    ``pairs(a, b, first)`` has each commit's root tree and its first parent's (null without one).
    Equal subtrees are never entered, and a pair of trees is compared once for all commits that have
    it, as what it brings is the same.
    """
    out = None
    old = entries.select(F.col("parent").alias("b"), "name", F.col("oid").alias("old_oid"), F.col("kind").alias("old_kind"))
    level = pairs.where(~F.col("a").eqNullSafe(F.col("b"))).groupBy("a", "b").agg(F.min("first").alias("first"))
    for _ in range(max_depth):
        own = level.join(entries, level["a"] == entries["parent"]).select("b", "name", "oid", "kind", "first")
        both = own.join(old, ["b", "name"], "left").where(F.col("old_oid").isNull() | (F.col("oid") != F.col("old_oid")))
        both = materialized(both, "growth")
        found = both.where("kind NOT IN ('tree', 'submodule')").groupBy(F.col("oid").alias("blob")).agg(F.min("first").alias("first"))
        out = found if out is None else out.union(found)
        below = F.when(F.col("old_kind") == "tree", F.col("old_oid"))
        level = both.where("kind = 'tree'").groupBy(F.col("oid").alias("a"), below.alias("b")).agg(F.min("first").alias("first"))
        if level.isEmpty():
            return out.groupBy("blob").agg(F.min("first").alias("first"))
    raise RuntimeError(f"deeper than {max_depth} levels")


def months_of(first: DataFrame, commits: DataFrame, sizes: DataFrame, month, last: int | None = None) -> DataFrame:
    """(month, introduced_bytes, cumulative_bytes) for all months with a commit, of ``first(blob, ts)``."""
    brought = first.join(sizes, "blob").groupBy(month(F.col("ts")).alias("month")).agg(F.sum("size").alias("introduced_bytes"))
    every = commits.select(month(F.col("ts")).alias("month")).distinct()
    out = every.join(brought, "month", "left").select("month", F.coalesce("introduced_bytes", F.lit(0)).cast("bigint").alias("introduced_bytes"))
    out = out.withColumn("cumulative_bytes", F.sum("introduced_bytes").over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)))
    return out.orderBy(F.desc("month")).limit(last) if last else out


def growth_by_month(commits: DataFrame, files: DataFrame, sizes: DataFrame, month, last: int | None = None) -> DataFrame:
    """(month, introduced_bytes, cumulative_bytes) for all months with a commit.

    A blob counts in the month of the first commit (by time, then id) that brought it.  ``month`` maps
    a time column to a month; ``last`` keeps the last months without changing totals.
    """
    first = growth_candidates(commits, files).groupBy("blob").agg(F.min(F.struct("ts", "commit")).alias("f"))
    return months_of(first.select("blob", F.col("f.ts").alias("ts")), commits, sizes, month, last)


def commit_contribution(commits: DataFrame, files: DataFrame, sizes: DataFrame, limit: int = 0) -> DataFrame:
    """(commit, blobs, introduced_bytes): what each commit was the first (by time, then id) to bring.

    Ordered by bytes, then id; ``limit`` 0 gives all commits that brought something.
    """
    first = growth_candidates(commits, files).groupBy("blob").agg(F.min(F.struct("ts", "commit")).alias("f"))
    out = first.select("blob", F.col("f.commit").alias("commit")).join(sizes, "blob").groupBy("commit").agg(F.count("*").alias("blobs"), F.sum("size").alias("introduced_bytes"))
    out = out.orderBy(F.desc("introduced_bytes"), "commit")
    return out.limit(limit) if limit else out


def introduced_deleted(presence: DataFrame, parents: DataFrame, at_head: DataFrame) -> DataFrame:
    """(object, introduced, deleted) by ``presence(object, commit, ts)`` and ``parents(commit, parent, ts)``.

    Introduced: the first commit (by time, then id) that has the object while no parent has it.
    Deleted: the first that hasn't while a parent has; null where ``at_head(object)`` holds.
    Only commits that touch the object's presence are visited: its holders and their children.
    """
    links = parents.where("parent IS NOT NULL").select("commit", "parent", F.col("ts").alias("child_ts"))
    holders = presence.select("object", "commit")
    parent_has = holders.withColumnRenamed("commit", "parent").join(links, "parent").groupBy("object", "commit").agg(F.first("child_ts").alias("child_ts"))
    both = presence.join(parent_has.withColumn("parent_has", F.lit(True)), ["object", "commit"], "full_outer")
    new = F.min(F.when(F.col("ts").isNotNull() & F.col("parent_has").isNull(), F.struct("ts", "commit")))
    gone = F.min(F.when(F.col("ts").isNull(), F.struct(F.col("child_ts").alias("ts"), "commit")))
    out = both.groupBy("object").agg(new.alias("i"), gone.alias("d"))
    kept = at_head.select("object").distinct().withColumn("kept", F.lit(True))
    return out.join(kept, "object", "left").select("object", F.col("i.commit").alias("introduced"), F.when(F.col("kept").isNull(), F.col("d.commit")).alias("deleted"))


def retained_by(targets: DataFrame, edges: DataFrame, refs: DataFrame) -> DataFrame:
    """Sorted names of the refs (not HEAD) that reach any of ``targets(node)``: one row."""
    reached = reverse_closure(targets, edges)
    named = refs.where(~F.col("is_head")).join(reached, refs["target"] == reached["node"], "left_semi")
    return named.agg(F.array_sort(F.collect_set("name")).alias("retained_by"))


def _weights(sole: DataFrame, sizes: DataFrame, tips: DataFrame, limit: int) -> DataFrame:
    weights = sole.join(sizes, "node").groupBy("tip").agg(F.sum("size").alias("w"))
    out = tips.join(weights, "tip", "left").select("name", F.coalesce("w", F.lit(0)).cast("bigint").alias("unique_bytes"))
    out = out.select(short_ref_name(F.col("name")).alias("name"), F.col("name").alias("full_name"), "unique_bytes").orderBy(F.desc("unique_bytes"), "full_name")
    return out.limit(limit) if limit else out


def unique_tips(refs: DataFrame) -> DataFrame:
    """(name, target, tip) of refs without HEAD, one for each target: the smallest name; tips number from 0."""
    own = refs.where(~F.col("is_head")).groupBy("target").agg(F.min("name").alias("name"))
    return own.withColumn("tip", F.row_number().over(Window.orderBy("name")) - 1)


def unique_weights(refs: DataFrame, edges: DataFrame, sizes: DataFrame, limit: int = 0, masks: bool | None = None) -> DataFrame:
    """(name, full_name, unique_bytes): bytes that only one ref keeps, for each ref.

    With ``masks`` a bit for each ref is carried, which holds up to 64 refs (more are an error); else
    the two outermost refs, which is enough to tell one from many, for any number of refs.  Without a
    choice, the number of refs with different targets decides.
    """
    tips = unique_tips(refs)
    if masks is not False:
        many = tips.count() > MASK_BITS
        if masks and many:
            raise ValueError(f"masks hold {MASK_BITS} refs")
        masks = not many
    if masks:
        seen = mask_closure(tips.select(F.col("tip").alias("bit"), F.col("target").alias("node")), edges)
        bit = F.expr("CAST(bit_count(mask - 1) AS INT)")
        sole = seen.where("bit_count(mask) = 1").select("node", F.when(F.col("mask") < 0, 63).otherwise(bit).alias("tip"))
    else:
        seen = pair_closure(tips.select("tip", F.col("target").alias("node")), edges)
        sole = seen.where("a = b").select("node", F.col("a").alias("tip"))
    return _weights(sole, sizes, tips.select("name", "tip"), limit)


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, old, new) of paths whose blob differs; null where a side hasn't the path."""
    old, new = before.select("path", F.col("blob").alias("old")), after.select("path", F.col("blob").alias("new"))
    return old.join(new, "path", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))


def changed_flag(before: DataFrame, after: DataFrame, path: str) -> DataFrame:
    """(path, base, to, changed): whether ``path`` has another blob; no row where neither side has it."""
    old = before.where(F.col("path") == path).select("path", F.col("blob").alias("base"))
    new = after.where(F.col("path") == path).select("path", F.col("blob").alias("to"))
    return old.join(new, "path", "full_outer").withColumn("changed", ~F.col("base").eqNullSafe(F.col("to")))


def multiset_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, added, removed) where the numbers of equal rows differ: multiset difference both ways."""
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    both = count(before, "n_before").join(count(after, "n_after"), keys, "full_outer")
    more = F.coalesce("n_after", F.lit(0)) - F.coalesce("n_before", F.lit(0))
    out = both.select(*keys, F.greatest(more, F.lit(0)).alias("added"), F.greatest(-more, F.lit(0)).alias("removed"))
    return out.where("added > 0 OR removed > 0")


# Remediation texts.
GC_COMMAND = "git reflog expire --expire=now --all && git gc --prune=now --aggressive"
CAVEAT = "Rewrites history: force-push afterwards and have collaborators re-clone. Never rewrite shared history casually."


def remediation(objects: DataFrame) -> DataFrame:
    """``objects(type, logical_bytes, path, reachable, reachable_from_head)`` with verdict, commands, caveat and LFS plan."""
    path, quoted = F.col("path"), shell_quote(F.col("path"))
    verdict = F.when(~F.col("reachable"), "gc").when(~F.col("reachable_from_head"), "history_rewrite").otherwise("none")
    rewrite = F.array(F.concat(F.lit("git filter-repo --invert-paths --path "), quoted), F.concat(F.lit("bfg --delete-files "), basename(path)))
    rewrites = (F.col("verdict") == "history_rewrite") & path.isNotNull()
    nothing = F.array().cast("array<string>")
    extension = extension_of(path)
    pattern = F.when(extension.isNotNull(), F.concat(F.lit("*."), extension)).otherwise(path)
    lfs = (F.col("verdict") == "none") & (F.col("type") == "blob") & is_lfs_candidate(F.col("logical_bytes"), path) & path.isNotNull()
    out = objects.withColumn("verdict", verdict)
    return out.withColumns(
        {
            "commands": F.when(F.col("verdict") == "gc", F.array(F.lit(GC_COMMAND))).when(rewrites, rewrite).otherwise(nothing),
            "caveat": F.when(rewrites, F.lit(CAVEAT)),
            "lfs_pattern": F.when(lfs, pattern),
            "lfs_command": F.when(lfs, F.concat(F.lit("git lfs migrate import --include="), shell_quote(pattern), F.lit(" --everything"))),
        }
    )
