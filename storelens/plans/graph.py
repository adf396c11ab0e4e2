"""Closures over edge tables, hierarchies and parent chains.

Rounds are written to the shared folder; the driver only learns whether a frontier is empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelens.storage import dropped, materialized


def closure(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct nodes that ``seeds(node)`` reach over ``edges(src, dst)``, seeds included.

    Semi-naive: only nodes found in the last round are expanded, each node once.  The edges are
    written once, so that a round reads them and not what they are made of.
    """
    edges = materialized(edges.select("src", "dst"), "edges")
    frontier = seen = materialized(seeds.select("node").where("node IS NOT NULL").distinct(), "frontier", counted=True)
    while frontier.n_rows:
        step = edges.join(frontier, edges["src"] == frontier["node"], "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = materialized(step.join(seen, "node", "left_anti"), "frontier", counted=True)
        seen = seen.union(frontier) if frontier.n_rows else seen
    dropped(edges)
    return seen


def reverse_closure(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct nodes that reach ``seeds(node)``, seeds included."""
    return closure(seeds, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def _spread(start: DataFrame, edges: DataFrame, values: dict[str, Callable[[str], Column]]) -> DataFrame:
    """(node, values...): what ``start(node, values...)`` brings to each node that it reaches.

    ``values`` names columns and the aggregates that combine them.  A round sends on only the nodes
    whose values changed; what a node had is looked up for the nodes that a round comes to, and only
    changed rows are written.
    """
    edges = materialized(edges.select("src", "dst"), "edges")
    combined = lambda df: df.groupBy("node").agg(*(f(c).alias(c) for c, f in values.items()))
    frontier = every = materialized(combined(start), "spread", counted=True)
    while frontier.n_rows:
        step = combined(edges.join(frontier, edges["src"] == frontier["node"]).select(F.col("dst").alias("node"), *values))
        step = materialized(step, "step")
        had = combined(every.join(step.select("node"), "node", "left_semi"))
        had = had.select(F.col("node").alias("old_node"), *(F.col(c).alias(f"old_{c}") for c in values))
        both = combined(step.unionByName(had.select(F.col("old_node").alias("node"), *(F.col(f"old_{c}").alias(c) for c in values))))
        same = F.col("old_node").isNotNull()
        for c in values:
            same &= F.col(c) == F.col(f"old_{c}")
        grown = both.join(had, F.col("node") == F.col("old_node"), "left").where(~same).select("node", *values)
        frontier = materialized(grown, "spread", counted=True)
        dropped(step)
        every = every.unionByName(frontier) if frontier.n_rows else every
    dropped(edges)
    return materialized(combined(every), "spread")


def pair_closure(tips: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, a, b): the smallest and the largest tip of ``tips(tip, node)`` that reach the node.

    They are equal where a single tip does.  A node has one row, whatever the number of tips, and is
    expanded again only when one of the two changed.
    """
    start = tips.where("node IS NOT NULL").select("node", F.col("tip").alias("a"), F.col("tip").alias("b"))
    return _spread(start, edges, {"a": F.min, "b": F.max})


MASK_BITS = 64


def mask_closure(tips: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, mask): bit i is set where tip number i of ``tips(bit, node)`` reaches the node; bits are 0 to 63."""
    bit = F.col("bit").cast("int")
    checked = F.when(bit.between(0, MASK_BITS - 1), bit).otherwise(F.raise_error(F.lit("a mask has 64 bits")).cast("int"))
    start = tips.where("node IS NOT NULL").select("node", F.call_function("shiftleft", F.lit(1).cast("bigint"), checked).alias("mask"))
    return _spread(start, edges, {"mask": F.bit_or})


def walk_path(roots: DataFrame, entries: DataFrame, path: str) -> DataFrame:
    """(root, oid, kind) at ``path`` below ``roots(root, parent)``: one entry of each folder on the way is looked up."""
    at = roots.select("root", F.col("parent").alias("oid"), F.lit("tree").alias("kind"))
    for name in path.split("/"):
        step = entries.where(F.col("name") == name).select("parent", F.col("oid").alias("next"), F.col("kind").alias("next_kind"))
        at = at.where("kind = 'tree'").join(step, F.col("oid") == F.col("parent")).select("root", F.col("next").alias("oid"), F.col("next_kind").alias("kind"))
    return at


def holders(commits: DataFrame, entries: DataFrame, path: str, blob: Column) -> DataFrame:
    """The rows of ``commits(tree, ...)`` that have ``blob`` at ``path``; distinct root trees are walked once."""
    roots = commits.select(F.col("tree").alias("root"), F.col("tree").alias("parent")).distinct()
    found = walk_path(roots, entries, path).where(F.col("oid") == blob).select(F.col("root").alias("tree")).distinct()
    return commits.join(found, "tree", "left_semi")


def flatten_hierarchy(roots: DataFrame, entries: DataFrame, max_depth: int = 512) -> DataFrame:
    """(root, path, oid, kind) of all leaves below ``roots(root)``; a column ``parent`` names another folder to start at.

    ``entries(parent, name, oid, kind)`` has the members of each folder; those of kind ``tree`` are
    folders themselves.  Distinct (folder, prefix) pairs are walked level by level, so a folder under
    two names gives its leaves under both.
    """
    start = "parent" if "parent" in roots.columns else "root"
    level = roots.select("root", F.col(start).alias("parent"), F.lit("").alias("prefix")).distinct()
    leaves = None
    for _ in range(max_depth):
        members = level.join(entries, "parent").select("root", F.concat("prefix", "name").alias("path"), "oid", "kind")
        members = materialized(members, "level")
        own = members.where("kind <> 'tree'")
        leaves = own if leaves is None else leaves.union(own)
        level = members.where("kind = 'tree'").select("root", F.col("oid").alias("parent"), F.concat("path", F.lit("/")).alias("prefix")).distinct()
        if level.isEmpty():
            return leaves
    raise RuntimeError(f"deeper than {max_depth} levels")


def chain_depth(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, depth) of ``links(node, parent)``: steps up to a node without a parent.

    Pointer doubling: each round doubles the length of the jumps, so a chain of n links takes log2(n)
    rounds.
    """
    now = links.select("node", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("depth"))
    now = materialized(now, "chain")
    for _ in range(max_rounds):
        above = now.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        now = now.join(above, "up", "left").select("node", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        now = materialized(now, "chain")
        if now.where("up IS NOT NULL").isEmpty():
            return now.select("node", "depth")
    raise RuntimeError("the chains have a cycle")


def chain_end(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, end) of ``links(node, parent)``: the node without a parent that each chain leads to.

    Pointer doubling, as in ``chain_depth``; a pointer goes as soon as the end is known, so no round
    joins many nodes with one end.
    """
    now = links.select("node", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), F.col("node")).alias("end"))
    now = materialized(now, "chain")
    for _ in range(max_rounds):
        above = now.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("end").alias("last"), F.lit(True).alias("known"))
        last = F.when(F.col("known"), F.col("last")).otherwise(F.col("up"))
        moved = now.where("up IS NOT NULL").join(above, "up", "left").select("node", F.col("next").alias("up"), last.alias("end"))
        now = materialized(now.where("up IS NULL").union(moved), "chain")
        if now.where("up IS NOT NULL").isEmpty():
            return now.select("node", "end")
    raise RuntimeError("the chains have a cycle")


def nth_ancestor(links: DataFrame, n: int) -> DataFrame:
    """(node, ancestor) after n steps of ``links(node, parent)``; null where the chain is shorter."""
    out = links.select("node", F.col("node").alias("ancestor"))
    for _ in range(n):
        step = links.select(F.col("node").alias("ancestor"), "parent")
        out = out.join(step, "ancestor", "left").select("node", F.col("parent").alias("ancestor"))
    return out


def span_to_next(entries: DataFrame, group: str, offset: str, end: str) -> DataFrame:
    """``entries`` with ``span``: the distance to the next offset of the group, for the last one to column ``end``."""
    after = F.lead(offset).over(Window.partitionBy(group).orderBy(offset))
    return entries.withColumn("span", F.coalesce(after, F.col(end)) - F.col(offset))
