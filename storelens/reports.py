"""The reports of the commands, as plain dictionaries in the order in which they're printed."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import functions as F

from storelens.functions import constructs
from storelens.functions.sizes import month_of
from storelens.operators import history, scoring, storage
from storelens.plans.relations import Store
from storelens.sources.repository import file_sizes


class TargetNotFound(Exception):
    """No object or path of that name."""


class AmbiguousTarget(Exception):
    """An id prefix that fits several objects."""


SHORT = ("blob", "tree", "commit", "tag")


def _types(store: Store) -> dict:
    rows = {r["type"]: r for r in storage.type_stats(store.objects).collect()}
    return {t: {"count": rows[t]["count"], "logical_bytes": rows[t]["bytes"]} for t in SHORT}


def _blobs(store: Store):
    """Blobs with path and status."""
    blobs = storage.with_status(store.objects.where("type = 'blob'"), store.head_files.select("oid"))
    return blobs.join(store.blob_paths.groupBy("oid").agg(F.min("path").alias("path")), "oid", "left")


def _entry(row) -> dict:
    return {"oid": bytes(row["oid"]).hex(), "logical_bytes": row["logical_bytes"], "path": row["path"], "status": row["status"], "lfs_candidate": row["lfs_candidate"]}


def objects(store: Store) -> dict:
    return {"objects": _types(store)}


def largest(store: Store, limit: int = 20, min_size: int = 0, status: str | None = None) -> dict:
    return {"blobs": [_entry(r) for r in storage.largest(_blobs(store), limit, min_size, status).collect()]}


def unreachable(store: Store) -> dict:
    row = storage.unreachable_stats(store.objects, store.reachable).first()
    return {"unreachable": {c: row[c] for c in ("count", "logical_bytes", "physical_bytes")}}


def repository(store: Store) -> dict:
    return {"path": store.repo.worktree, "git_dir": store.repo.git_dir}


def summary(store: Store) -> dict:
    repo = store.repo
    blobs = _blobs(store)
    old = blobs.where("status = 'historical'").agg(F.coalesce(F.sum("logical_bytes"), F.lit(0))).first()[0]
    inside = repo.git_dir.startswith(repo.common_dir)
    stored = store.copies.agg(F.coalesce(F.sum(F.when(F.col("storage") == "loose", F.col("physical_bytes"))), F.lit(0))).first()[0]
    from storelens.sources import odb

    packs = sum(file_size(stem + ".pack") for stem in odb.pack_stems(repo.objects_dir))
    return {
        "repository": repository(store),
        "weight": {
            "git_bytes": file_sizes(repo.common_dir) + (0 if inside else file_sizes(repo.git_dir)),
            "object_bytes": file_sizes(repo.objects_dir),
            "working_tree_bytes": file_sizes(repo.worktree, ".git") if repo.worktree else 0,
        },
        "objects": _types(store),
        "storage": {"pack_bytes": packs, "loose_bytes": stored},
        "largest_contributors": [_entry(r) for r in storage.largest(blobs, 4).collect()],
        "historical_bytes": old,
        "unreachable_bytes": unreachable(store)["unreachable"]["physical_bytes"],
    }


def file_size(path: str) -> int:
    import os

    return os.path.getsize(path)


def packs(store: Store) -> dict:
    from storelens.sources import odb

    rows = store._table("pack_entries").select("pack", F.col("delta_depth").alias("depth"), F.col("target_size").alias("logical"), F.col("physical_bytes").alias("physical"))
    sizes = store.spark.createDataFrame([(s.rpartition("/")[2], file_size(s + ".pack")) for s in odb.pack_stems(store.repo.objects_dir)], "pack string, pack_bytes bigint")
    stats = storage.mean_delta_depth(storage.pack_stats(rows).drop("pack_bytes").join(sizes, "pack"))
    total = storage.pack_summary(stats).first()
    end = lambda n: {"name": total[n], "bytes": total[f"{n}_bytes"]} if total[n] else None
    return {
        "packs": [
            {"name": r.pack, "objects": r.object_count, "pack_bytes": r.pack_bytes, "delta_count": r.delta_count, "max_delta_depth": r.max_delta_depth,
             "mean_delta_depth": round(r.mean_delta_depth, 2), "delta_logical_bytes": r.delta_logical_bytes, "delta_physical_bytes": r.delta_physical_bytes}
            for r in stats.orderBy("pack").collect()
        ],
        "summary": {
            "pack_count": total.pack_count, "total_bytes": total.total_bytes, "smallest_pack": end("smallest"), "largest_pack": end("largest"),
            "total_delta_count": total.total_delta_count, "total_delta_logical_bytes": total.total_delta_logical, "total_delta_physical_bytes": total.total_delta_physical,
            "delta_ratio": round(total.total_delta_physical / total.total_delta_logical, 2) if total.total_delta_logical else None, "repack_hint": total.repack_hint,
        },
    }


def refs(store: Store, limit: int = 20) -> dict:
    """Bytes that only one ref keeps; refs that lead to the same commit count once, by the smallest name."""
    first: dict[bytes, tuple[str, bytes]] = {}
    for r in sorted((r for r in store.refs if not r.is_head), key=lambda r: r.name):
        first.setdefault(store.peel(r.target) or r.target, (r.name, r.target))
    tips = list(first.values())
    if not tips:
        return {"refs": []}
    sizes = store.objects.select(F.col("oid").alias("node"), F.col("logical_bytes").alias("size"))
    names = store.spark.createDataFrame([(k, n) for k, (n, _) in enumerate(tips)], "tip int, name string")
    found = history._weights(store.sole_tips([t for _, t in tips]), sizes, names, limit)
    return {"refs": [{"name": r.name, "full_name": r.full_name, "unique_bytes": r.unique_bytes} for r in found.collect()]}


def dupes(store: Store, limit: int = 20, min_size: int = 0, status: str | None = None) -> dict:
    blobs = store.objects.where("type = 'blob'")
    if status == "current":
        paths = store.head_files.where("kind <> 'submodule'").select("oid", "path")
    else:
        paths = store.blob_paths
        if status == "historical":
            paths = paths.join(store.head_files.select("oid").distinct(), "oid", "left_anti")
    rows = storage.duplicates(paths, blobs.select("oid", "logical_bytes"), min_size, limit).collect()
    groups = [{"oid": bytes(r.oid).hex(), "size": r["size"], "paths": list(r.paths), "path_count": r.path_count, "truncated": r.truncated, "wasted_bytes": r.wasted_bytes} for r in rows]
    return {"dupes": groups, "total_wasted_bytes": sum(g["wasted_bytes"] for g in groups)}


def growth(store: Store, months: int | None = None) -> dict:
    commits = store.commits.join(store.frame(store.ancestors(x for r in store.refs for x in store.tag_chain(r.target))), "oid", "left_semi")
    before = commits.select(F.col("oid").alias("p"), F.col("tree").alias("b"))
    pairs = commits.withColumn("p", F.get("parents", F.lit(0))).join(before, "p", "left").select(F.col("tree").alias("a"), "b", F.struct("ts", F.col("oid").alias("commit")).alias("first"))
    if pairs.isEmpty():
        return {"buckets": [], "total_introduced_bytes": 0}
    first = history.tree_growth(pairs, store.entries).select("blob", F.col("first.ts").alias("ts"))
    sizes = store.objects.select(F.col("oid").alias("blob"), F.col("logical_bytes").alias("size"))
    rows = history.months_of(first, commits, sizes, month_of).orderBy("month").collect()
    buckets = [{"month": r.month, "introduced_bytes": r.introduced_bytes, "cumulative_bytes": r.cumulative_bytes} for r in rows]
    return {"buckets": buckets[-months:] if months else buckets, "total_introduced_bytes": buckets[-1]["cumulative_bytes"] if buckets else 0}


@dataclass(frozen=True)
class Target:
    oid: bytes
    path: str | None


def target(store: Store, text: str) -> Target:
    """An id prefix of at least four digits if it fits an object; else a path, its largest blob."""
    if re.fullmatch("[0-9a-fA-F]{4,64}", text):
        fits = store.objects.where(F.lower(F.hex("oid")).startswith(text.lower())).select("oid").limit(2).collect()
        if len(fits) > 1:
            raise AmbiguousTarget(text)
        if fits:
            oid = bytes(fits[0].oid)
            path = store.blob_paths.where(F.col("oid") == F.lit(bytearray(oid))).agg(F.min("path")).first()[0]
            return Target(oid, path)
    row = store.blob_paths.where(F.col("path") == text).join(store.objects, "oid").orderBy(F.desc("logical_bytes"), "oid").first()
    if row is None:
        raise TargetNotFound(text)
    return Target(bytes(row.oid), text)


def explain(store: Store, text: str) -> dict:
    found = target(store, text)
    is_it = F.col("oid") == F.lit(bytearray(found.oid))
    obj = store.objects.where(is_it).first()
    names = sorted({r.name for r in store.refs if not r.is_head})
    by_target: dict[bytes, list[str]] = {}
    for r in store.refs:
        if not r.is_head:
            by_target.setdefault(r.target, []).append(r.name)
    keeping = _keepers(store, found.oid, by_target) if names else []
    at_head = not store.head_files.where(is_it).isEmpty()
    from_head = at_head if obj.type == "blob" else store.head is not None and not store.reached_from([store.head]).where(is_it).isEmpty()
    reachable = not store.reachable.where(is_it).isEmpty()
    events = {"introduced": None, "deleted": None}
    if found.path:
        events = _events(store, found, at_head)
    facts = store.spark.createDataFrame([(obj.type, obj.logical_bytes, found.path, reachable, from_head)], "type string, logical_bytes bigint, path string, reachable boolean, reachable_from_head boolean")
    fix = history.remediation(facts).first()
    tools = {"gc": ["git"], "history_rewrite": ["git-filter-repo", "BFG Repo-Cleaner"]}.get(fix.verdict, [])
    return {
        "target": text, "oid": found.oid.hex(), "type": obj.type, "logical_bytes": obj.logical_bytes, "physical_bytes": obj.physical_bytes, "path": found.path, **events,
        "retained_by": keeping, "reachable": reachable, "reachable_from_head": from_head, "reclaimable_bytes": obj.physical_bytes,
        "remediation": {
            "verdict": fix.verdict, "commands": [{"tool": t, "command": c} for t, c in zip(tools, fix.commands, strict=False)], "caveat": fix.caveat,
            "lfs": {"pattern": fix.lfs_pattern, "command": fix.lfs_command} if fix.lfs_pattern else None,
        },
    }


def _keepers(store: Store, oid: bytes, by_target: dict[bytes, list[str]]) -> list[str]:
    """Refs that reach an object: its folders are found backwards in Spark, the commits above them on the driver."""
    from storelens.plans.graph import reverse_closure

    above = reverse_closure(store.frame([oid], "node"), store.tree_edges).withColumnRenamed("node", "oid")
    holding = {bytes(r.oid) for r in store.commits.join(above.withColumnRenamed("oid", "tree"), "tree", "left_semi").select("oid").toLocalIterator()}
    nodes = {bytes(r.oid) for r in above.join(store.frame(by_target), "oid", "left_semi").collect()} | {oid}
    children: dict[bytes, list[bytes]] = {}
    for c, ps in store.parents.items():
        for p in ps:
            children.setdefault(p, []).append(c)
    stack = list(holding | ({oid} & store.parents.keys()))
    reached = set(stack)
    while stack:
        for c in children.get(stack.pop(), ()):
            if c not in reached:
                reached.add(c)
                stack.append(c)
    keeps = lambda t: any(x in reached or x in nodes for x in store.tag_chain(t))
    return sorted(n for t, names in by_target.items() if keeps(t) for n in names)


def _events(store: Store, found: Target, at_head: bool) -> dict:
    has = store.holders(found.path, found.oid).select(F.lit(0).alias("object"), "commit", "ts")
    links = store.commits.select(F.col("oid").alias("commit"), "ts", F.explode("parents").alias("parent"))
    kept = store.spark.createDataFrame([(0,)] if at_head else [], "object int")
    row = history.introduced_deleted(has, links, kept).first()
    out = {}
    for name in ("introduced", "deleted"):
        commit = row[name] if row else None
        if commit is None:
            out[name] = None
            continue
        c = store.commits.where(F.col("oid") == F.lit(commit)).select(F.date_format(F.timestamp_seconds(F.greatest("ts", F.lit(0))), "yyyy-MM-dd").alias("d")).first()
        out[name] = {"commit": bytes(commit).hex()[:7], "date": c.d} | ({"author": store.commit(commit).get("author_ident")} if name == "introduced" else {})
    return out


class PathMissing(Exception):
    """A path that neither side has."""


def changed(store: Store, path: str, base: str = "HEAD~1", to: str = "HEAD") -> dict:
    sides = [(name, store.resolve(name)) for name in (base, to)]
    path = "/".join(p for p in path.split("/") if p not in ("", "."))
    found = [store.entry_at(commit, path) for _, commit in sides]
    if found == [None, None]:
        raise PathMissing(path)
    oids = [f[0].hex() if f else None for f in found]
    side = lambda k: {"ref": sides[k][0], "commit": sides[k][1].hex(), "tree": oids[k]}
    return {"path": path or ".", "changed": oids[0] != oids[1], "base": side(0), "to": side(1)}


def check(store: Store, limits: dict[str, int]) -> dict:
    """``limits`` by max-size, max-historical, max-unreachable, max-blob and max-growth."""
    s = summary(store)
    actual = {
        "max-size": s["weight"]["git_bytes"], "max-historical": s["historical_bytes"], "max-unreachable": s["unreachable_bytes"],
        "max-blob": s["largest_contributors"][0]["logical_bytes"] if s["largest_contributors"] else 0,
    }
    if "max-growth" in limits:
        buckets = growth(store)["buckets"]
        actual["max-growth"] = buckets[-1]["introduced_bytes"] if buckets else 0
    rows = [{"name": n, "limit": m, "actual": actual[n], "ok": actual[n] <= m} for n, m in limits.items()]
    return {"repository": s["repository"], "thresholds": rows, "ok": all(r["ok"] for r in rows)}


_POINTS = ("total_points", "size_points", "structural_points", "domain_points", "points_per_kloc", "structural_points_per_kloc", "domain_points_per_kloc", "source_files", "source_lines")
_DIMENSIONS = ("branch_lines", "internal_imports", "external_host_references", "dependency_manifests", "ui_components", "crypto_files", "algorithm_files")


def _snapshot(store: Store, commit: bytes):
    texts = store.texts_of(commit)
    mod = texts.where("path = 'go.mod'").select(scoring.go_module_prefix(F.col("text"))).first()
    row = scoring.complexity(texts, mod[0] if mod else None).first()
    return row.asDict() if row else dict.fromkeys((*_POINTS, *_DIMENSIONS, "terraform_files", "sql_files", "sql_migration_files", "excluded_files", "binary_files", *constructs.POINTS), 0)


def complexity(store: Store, rev: str = "HEAD", base: str | None = None) -> dict:
    commit = store.resolve(rev)
    row = _snapshot(store, commit)
    when = store.commits.where(F.col("oid") == F.lit(bytearray(commit))).first().committer_ts
    out = {"score_version": scoring.SNAPSHOT_VERSION, "revision": rev, "commit": commit.hex(), "committed_at_unix": when} | {n: row[n] for n in _POINTS}
    out["dimensions"] = {n: row[n] for n in _DIMENSIONS} | {
        "terraform": {"files": row["terraform_files"]} | {n: row[n] for n in constructs.TERRAFORM},
        "sql": {"files": row["sql_files"], "migration_files": row["sql_migration_files"]} | {n: row[n] for n in constructs.SQL},
    }
    out |= {"excluded_files": row["excluded_files"], "binary_files": row["binary_files"], "semantic_complexity": "unknown"}
    if base:
        other = store.resolve(base)
        points = _snapshot(store, other)["total_points"]
        out["comparison"] = {"base_revision": base, "base_commit": other.hex(), "base_points": points, "delta_points": row["total_points"] - points}
    return out


def pr(store: Store, base: str, to: str, **record: str) -> dict:
    sides = [store.resolve(base), store.resolve(to)]
    before, after = (store.texts_of(c) for c in sides)
    row = scoring.change_score(before, after).first().asDict()
    evidence = [r.asDict() for r in scoring.change_evidence(before, after).collect()]
    names = ("internal_imports", "external_integrations", "dependency_changes", "new_ui_components", "changed_shared_ui_components", "reused_ui_components", "crypto_signals", "algorithm_signals")
    dimensions = {("dependency_manifests_changed" if n == "dependency_changes" else n): row[n] for n in names}
    dimensions |= {"terraform": {n: row[n] for n in constructs.TERRAFORM}, "sql": {n: row[n] for n in constructs.SQL}}
    return (
        {"score_version": scoring.CHANGE_VERSION} | record | {"base": base, "to": to, "base_commit": sides[0].hex(), "to_commit": sides[1].hex()}
        | {n: row[n] for n in ("work_points", "complexity_points", "domain_points", "total_points")} | {"changed_files": row["files"]}
        | {n: row[n] for n in ("added_lines", "removed_lines", "added_branches", "excluded_files", "binary_files")}
        | {"dimensions": dimensions, "evidence": evidence, "semantic_complexity": "unknown"}
    )
