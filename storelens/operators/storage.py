"""Operators on stored objects: statistics, largest, duplicates, packs, thresholds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storelens.functions.paths import is_lfs_candidate

TYPES = ("commit", "tree", "blob", "tag")
PATH_LIMIT = 32


def dedup_prefer_first(objects: DataFrame, key: str, *order: str) -> DataFrame:
    """One row for each key, the first in ``order``; the order must be total."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return objects.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def with_status(objects: DataFrame, head: DataFrame, key: str = "oid") -> DataFrame:
    """``objects`` with ``status``: current where the key is in ``head``, else historical."""
    marks = head.select(key).distinct().withColumn("_head", F.lit(True))
    joined = objects.join(marks, key, "left")
    return joined.withColumn("status", F.when(F.col("_head"), "current").otherwise("historical")).drop("_head")


def largest(objects: DataFrame, limit: int = 20, min_size: int = 0, status: str | None = None) -> DataFrame:
    """The largest objects, by size and then id.  ``limit`` 0 gives none."""
    found = objects.where(F.col("logical_bytes") >= min_size)
    if status:
        found = found.where(F.col("status") == status)
    return found.orderBy(F.desc("logical_bytes"), "oid").limit(limit).withColumn("lfs_candidate", is_lfs_candidate(F.col("logical_bytes"), F.col("path")))


def type_stats(objects: DataFrame, types=TYPES, type_col: str = "type", size_col: str = "logical_bytes") -> DataFrame:
    """(type, count, bytes) for all ``types``, with zeros where there is none."""
    frame = objects.sparkSession.createDataFrame([(t,) for t in types], "type string")
    found = objects.groupBy(F.col(type_col).alias("type")).agg(F.count("*").alias("n"), F.sum(size_col).alias("b"))
    return frame.join(found, "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("count"), F.coalesce("b", F.lit(0)).alias("bytes"))


def unreachable_stats(objects: DataFrame, reachable: DataFrame, key: str = "oid") -> DataFrame:
    """(count, logical_bytes, physical_bytes) of objects that aren't in ``reachable``."""
    lost = objects.join(reachable.select(key).distinct(), key, "left_anti")
    return lost.agg(F.count("*").alias("count"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("logical_bytes", "physical_bytes")))


def full_scan(objects: DataFrame, types=TYPES) -> DataFrame:
    """One row from one pass: counts and bytes by type, historical and unreachable bytes.

    ``objects`` has type, logical_bytes, status and reachable.
    """
    size = F.col("logical_bytes")
    when = lambda test: F.coalesce(F.sum(F.when(test, size)), F.lit(0))
    out = []
    for t in types:
        out += [F.count(F.when(F.col("type") == t, 1)).alias(f"{t}_count"), when(F.col("type") == t).alias(f"{t}_bytes")]
    out += [when(F.col("status") == "historical").alias("historical_bytes"), when(~F.col("reachable")).alias("unreachable_bytes"), F.count(F.when(~F.col("reachable"), 1)).alias("unreachable_count")]
    return objects.agg(*out)


def paths_of(blob_paths: DataFrame, limit: int = PATH_LIMIT) -> DataFrame:
    """(oid, path, paths, path_count, truncated): the smallest path, and the sorted distinct ones up to ``limit``.

    The count and the smallest come from a plain aggregate; the list is cut by rank, so a blob with
    any number of paths never gathers more than ``limit``.
    """
    distinct = blob_paths.select("oid", "path").distinct()
    counts = distinct.groupBy("oid").agg(F.count("*").alias("path_count"), F.min("path").alias("path"))
    rank = F.row_number().over(Window.partitionBy("oid").orderBy("path"))
    first = distinct.withColumn("r", rank).where(F.col("r") <= limit).groupBy("oid").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    return counts.join(first, "oid").select("oid", "path", "paths", "path_count", (F.col("path_count") > limit).alias("truncated"))


def duplicates(blob_paths: DataFrame, sizes: DataFrame, min_size: int = 0, limit: int = 20, path_limit: int = PATH_LIMIT) -> DataFrame:
    """(oid, size, paths, path_count, truncated, wasted_bytes): blobs at two paths or more.

    Ordered by waste, then id; ``limit`` 0 gives all.
    """
    few = blob_paths.select("oid", "path").distinct().groupBy("oid").agg(F.count("*").alias("n")).where("n > 1").select("oid")
    groups = paths_of(blob_paths.join(few, "oid", "left_semi"), path_limit).drop("path")
    out = groups.join(sizes.select("oid", F.col("logical_bytes").alias("size")), "oid").where(F.col("size") >= min_size)
    out = out.withColumn("wasted_bytes", F.col("size") * (F.col("path_count") - 1)).orderBy(F.desc("wasted_bytes"), "oid")
    out = out.limit(limit) if limit else out
    return out.select("oid", "size", "paths", "path_count", "truncated", "wasted_bytes")


def pack_stats(entries: DataFrame) -> DataFrame:
    """Per pack: objects, deltas, depths and delta bytes; from (pack, depth, logical, physical)."""
    delta = F.col("depth") > 0
    total = lambda c: F.coalesce(F.sum(F.when(delta, F.col(c))), F.lit(0))
    return entries.groupBy("pack").agg(
        F.count("*").alias("object_count"),
        F.count(F.when(delta, 1)).alias("delta_count"),
        F.coalesce(F.max(F.when(delta, F.col("depth"))), F.lit(0)).alias("max_delta_depth"),
        total("depth").alias("total_delta_depth"),
        total("logical").alias("delta_logical_bytes"),
        total("physical").alias("delta_physical_bytes"),
        F.coalesce(F.sum("physical"), F.lit(0)).alias("pack_bytes"),
    )


def mean_delta_depth(packs: DataFrame) -> DataFrame:
    return packs.withColumn("mean_delta_depth", F.when(F.col("delta_count") > 0, F.col("total_delta_depth") / F.col("delta_count")).otherwise(0.0))


def pack_hint():
    """Column: why a repack may help, from the totals of ``pack_summary``; null if it wouldn't.

    Fixed values: both texts.
    """
    many = (F.col("pack_count") >= 4) & ((F.col("smallest_bytes") * 4 < F.col("total_bytes")) | (F.col("pack_count") >= 8))
    poor = (F.col("total_delta_logical") > 0) & (F.col("total_delta_physical") * 2 > F.col("total_delta_logical"))
    consolidate = F.concat(F.col("pack_count").cast("string"), F.lit(" packfiles, smallest "), F.col("smallest_bytes").cast("string"), F.lit(" bytes — consider consolidating with `git repack -ad`"))
    share = F.expr("total_delta_physical * 100 div total_delta_logical").cast("string")
    deltas = F.concat(F.lit("delta chains store "), share, F.lit("% of their logical size — consider `git repack -ad --aggressive`"))
    return F.when(many, consolidate).when(poor, deltas)


def pack_summary(packs: DataFrame) -> DataFrame:
    """One row: totals, the smallest and largest pack (by size, then name) and the hint."""
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    small = F.min(F.struct(F.col("pack_bytes").alias("b"), F.col("pack").alias("p")))
    large = F.min(F.struct((-F.col("pack_bytes")).alias("b"), F.col("pack").alias("p")))
    out = packs.agg(
        F.count("*").alias("pack_count"), total("pack_bytes", "total_bytes"), total("delta_count", "total_delta_count"),
        total("delta_logical_bytes", "total_delta_logical"), total("delta_physical_bytes", "total_delta_physical"), small.alias("s"), large.alias("l"),
    )
    out = out.withColumns({"smallest": F.col("s.p"), "smallest_bytes": F.coalesce("s.b", F.lit(0)), "largest": F.col("l.p"), "largest_bytes": F.coalesce(-F.col("l.b"), F.lit(0))})
    return out.drop("s", "l").withColumn("repack_hint", pack_hint())


def check_thresholds(actuals: DataFrame, limits: dict[str, int]) -> DataFrame:
    """(name, actual, limit, ok) for each limit, of the columns of the one-row ``actuals``."""
    rows = [F.struct(F.lit(n).alias("name"), F.col(n).cast("bigint").alias("actual"), F.lit(m).cast("bigint").alias("limit")) for n, m in limits.items()]
    out = actuals.select(F.explode(F.array(*rows)).alias("t")).select("t.*")
    return out.withColumn("ok", F.col("actual") <= F.col("limit"))


def override_union(preferred: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """All preferred rows, and the others whose key isn't among them."""
    return preferred.unionByName(others.join(preferred.select(key).distinct(), key, "left_anti").select(*others.columns))


def by_extension(blobs: DataFrame) -> DataFrame:
    from storelens.functions.paths import extension_of

    return blobs.groupBy(F.lower(extension_of(F.col("path"))).alias("extension")).agg(F.count("*").alias("count"), F.sum("logical_bytes").alias("bytes"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
