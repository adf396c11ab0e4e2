"""Connected components of an edge table, by hooking to the smallest neighbour and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import dropped, stored


def stars(edges: DataFrame) -> DataFrame:
    """Fewer ``edges(u, v)`` with the same components: each u's neighbours all tied to their smallest.

    A u's neighbours are gathered, so u must have a bounded number of them; v may have any number.
    """
    near = edges.groupBy("u").agg(F.collect_set("v").alias("vs"))
    near = near.select(F.array_union(F.array("u"), "vs").alias("vs"))
    return near.select(F.explode("vs").alias("u"), F.array_min("vs").alias("v")).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges(u, v)``; the label is the component's smallest node.

    In a round each node hooks to the smallest of itself and its neighbours, then follows that node's
    own hook; the edges are carried over to the hooks and those within one go.  Rounds are written to
    the shared folder; the driver only learns whether edges are left.  The smallest node of a
    component always hooks to itself, so it's what all hooks lead to.
    """
    pair = (F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    left = stored(edges.where("u <> v").select(*pair).distinct(), "edges", counted=True)
    rounds = []
    while left.n_rows:
        both = left.select("u", "v").union(left.select("v", "u"))
        near = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("hook")), "hooks")
        jump = near.select(F.col("node").alias("hook"), F.col("hook").alias("jump"))
        hook = stored(near.join(jump, "hook").select("node", F.col("jump").alias("hook")), "hooks")
        rounds.append(hook)
        moved = left.join(hook.withColumnRenamed("node", "u"), "u").select(F.col("hook").alias("u"), "v")
        moved = moved.join(hook.withColumnRenamed("node", "v"), "v").select("u", F.col("hook").alias("v"))
        after = stored(moved.where("u <> v").select(*pair).distinct(), "edges", counted=True)
        dropped(near, left)
        left = after
    if not rounds:
        return left.select(F.col("u").alias("node"), F.col("v").alias("label"))
    labels = rounds[-1].withColumnRenamed("hook", "label")
    for hook in reversed(rounds[:-1]):
        end = labels.select(F.col("node").alias("hook"), "label")
        labels = hook.join(end, "hook", "left").select("node", F.coalesce("label", "hook").alias("label"))
    out = stored(labels, "labels")
    dropped(left, *rounds)
    return out
