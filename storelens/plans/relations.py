"""The relations of one repository, as DataFrames.

Trees and blobs are walked in Spark, level by level.  The commit graph is as deep as the history is
long, so its ids and parents (some 60 bytes a commit) are walked on the driver, as one would read a
commit-graph file.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.operators.storage import dedup_prefer_first
from storelens.plans.graph import closure, flatten_hierarchy, holders, pair_closure
from storelens.sources.datasource import read_table
from storelens.sources.repository import BadRevision, Repository, parse_revision, read_refs, resolve_base
from storelens.storage import materialized


class Store:
    """Tables of a repository; each is read at most once."""

    def __init__(self, spark: SparkSession, repo: Repository):
        self.spark, self.repo = spark, repo
        self.refs = read_refs(repo)

    def _table(self, name: str, **options: str) -> DataFrame:
        return read_table(self.spark, self.repo.git_dir if self.repo.kind == "bare" else self.repo.worktree, name, **options)

    @cached_property
    def copies(self) -> DataFrame:
        """Every stored copy."""
        return materialized(self._table("objects"), "objects")

    @cached_property
    def objects(self) -> DataFrame:
        """Each object once, loose before packed and the first pack before others; ``physical_bytes`` of all copies."""
        total = self.copies.groupBy("oid").agg(F.sum("physical_bytes").alias("all_bytes"))
        first = dedup_prefer_first(self.copies, "oid", "storage", "pack", "pack_offset")
        return first.join(total, "oid").withColumn("physical_bytes", F.col("all_bytes")).drop("all_bytes")

    @cached_property
    def commits(self) -> DataFrame:
        """(oid, tree, parents, committer_ts, ts): those of the commit-graph from there, the others parsed."""
        columns = ("oid", "tree", "parents", "committer_ts")
        listed = self._table("commit_graph").select(*columns)
        parsed = self._table("commits", beyond="graph").select(*columns)
        rows = materialized(listed.unionByName(parsed).dropDuplicates(["oid"]), "commits")
        return rows.withColumn("ts", F.coalesce("committer_ts", F.lit(0)))

    def commit(self, oid: bytes) -> dict:
        """All fields of one commit, parsed from its payload."""
        row = self._table("commits", oid=bytes(oid).hex()).first()
        return row.asDict() if row else {}

    @cached_property
    def entries(self) -> DataFrame:
        """(parent, name, oid, kind) of tree entries."""
        rows = self._table("tree_entries").select(F.col("tree").alias("parent"), F.col("name").cast("string").alias("name"), "oid", "kind", "mode").distinct()
        return materialized(rows, "entries")

    @cached_property
    def tags(self) -> DataFrame:
        return materialized(self._table("tags").dropDuplicates(["oid"]), "tags")

    @cached_property
    def parents(self) -> dict[bytes, list[bytes]]:
        """Parents of every stored commit, on the driver."""
        return {bytes(r.oid): [bytes(p) for p in r.parents] for r in self.commits.select("oid", "parents").toLocalIterator()}

    @cached_property
    def tag_targets(self) -> dict[bytes, bytes]:
        return {bytes(r.oid): bytes(r.object) for r in self.tags.select("oid", "object").toLocalIterator()}

    def tag_chain(self, oid: bytes) -> list[bytes]:
        """``oid`` and what it leads to through annotated tags, at most 32."""
        out = [oid]
        while out[-1] in self.tag_targets and len(out) <= 32:
            out.append(self.tag_targets[out[-1]])
        return out

    def peel(self, oid: bytes) -> bytes | None:
        """The commit that ``oid`` leads to; None if it's another object."""
        end = self.tag_chain(oid)[-1]
        return end if end in self.parents else None

    @property
    def head(self) -> bytes | None:
        found = [r.target for r in self.refs if r.is_head]
        return self.peel(found[0]) if found else None

    def ancestors(self, tips) -> set[bytes]:
        """All commits that ``tips`` reach, themselves included."""
        seen, stack = set(), [t for t in tips if t in self.parents]
        while stack:
            c = stack.pop()
            if c not in seen:
                seen.add(c)
                stack += [p for p in self.parents[c] if p in self.parents]
        return seen

    def frame(self, ids, column: str = "oid") -> DataFrame:
        return self.spark.createDataFrame([(bytearray(i),) for i in ids], f"{column} binary")

    @cached_property
    def tree_edges(self) -> DataFrame:
        return self.entries.where("kind <> 'submodule'").select(F.col("parent").alias("src"), F.col("oid").alias("dst"))

    def reached_from(self, targets) -> DataFrame:
        """(oid) of every object that ``targets`` reach."""
        chains = {x for t in targets for x in self.tag_chain(t)}
        commits = self.frame(self.ancestors(chains))
        roots = self.commits.join(commits, "oid", "left_semi").select(F.col("tree").alias("node"))
        rest = self.frame([x for x in chains if x not in self.parents], "node")
        walked = closure(roots.union(rest), self.tree_edges).withColumnRenamed("node", "oid")
        return materialized(commits.union(walked).distinct(), "reached")

    @cached_property
    def reachable(self) -> DataFrame:
        return self.reached_from([r.target for r in self.refs])

    def files_of(self, commit: bytes) -> DataFrame:
        """(path, oid, kind) of one commit's files, links and submodules."""
        root = self.commits.where(F.col("oid") == F.lit(bytearray(commit))).select(F.lit(0).alias("root"), F.col("tree").alias("parent"))
        return flatten_hierarchy(root, self.entries).drop("root")

    @cached_property
    def head_files(self) -> DataFrame:
        if self.head is None:
            return self.spark.createDataFrame([], "path string, oid binary, kind string")
        return materialized(self.files_of(self.head), "head")

    @cached_property
    def blob_paths(self) -> DataFrame:
        """Distinct (oid, path) over the trees of all reachable commits."""
        commits = self.frame(self.ancestors(x for r in self.refs for x in self.tag_chain(r.target)))
        roots = self.commits.join(commits, "oid", "left_semi").select(F.lit(0).alias("root"), F.col("tree").alias("parent")).distinct()
        return materialized(flatten_hierarchy(roots, self.entries).where("kind <> 'submodule'").select("oid", "path").distinct(), "paths")

    def texts_of(self, commit: bytes) -> DataFrame:
        """(path, text) of a commit's files; bytes become code points of the same number."""
        files = self.files_of(commit).where("kind = 'blob'").select("path", "oid")
        payloads = self._table("payloads", types="blob").dropDuplicates(["oid"])
        return materialized(files.join(payloads, "oid").select("path", F.decode("payload", "ISO-8859-1").alias("text")), "texts")

    def sole_tips(self, tips: list[bytes]) -> DataFrame:
        """(node, tip): objects that a single one of ``tips`` reaches, by the tip's number."""
        low: dict[bytes, int] = {}
        high: dict[bytes, int] = {}
        for found, numbers in ((low, range(len(tips))), (high, range(len(tips) - 1, -1, -1))):
            for k in numbers:  # a commit belongs to the first tip that comes by, so each is visited once
                stack = [x for x in self.tag_chain(tips[k]) if x in self.parents]
                while stack:
                    c = stack.pop()
                    if c not in found:
                        found[c] = k
                        stack += [p for p in self.parents[c] if p in self.parents]
        rows = [(bytearray(c), k) for c in low for k in {low[c], high[c]}]
        owned = self.spark.createDataFrame(rows, "node binary, tip int")
        roots = owned.join(self.commits.select(F.col("oid").alias("node"), "tree"), "node").select("tip", F.col("tree").alias("node"))
        others = [(k, bytearray(x)) for k, t in enumerate(tips) for x in self.tag_chain(t) if x not in self.parents]
        rest = self.spark.createDataFrame(others, "tip int, node binary")
        trees = pair_closure(roots.union(rest), self.tree_edges)
        commits = owned.groupBy("node").agg(F.min("tip").alias("a"), F.max("tip").alias("b"))
        return trees.select("node", "a", "b").union(commits).where("a = b").select("node", F.col("a").alias("tip"))

    def resolve(self, text: str) -> bytes:
        """The commit that a revision names."""
        revision = parse_revision(text)
        commit = self.peel(resolve_base(revision.base, self.refs, self.repo.hash_bytes))
        for kind, n in revision.steps:
            if commit is None:
                raise BadRevision(text)
            if kind == "~":
                for _ in range(n):
                    commit = (self.parents.get(commit) or [None])[0]
            elif n:
                above = self.parents.get(commit, [])
                commit = above[n - 1] if n <= len(above) else None
        if commit is None or commit not in self.parents:
            raise BadRevision(text)
        return commit

    def entry_at(self, commit: bytes, path: str) -> tuple[bytes, str] | None:
        """(oid, kind) at a path of a commit; the root for an empty path or ``.``; None if absent."""
        oid, kind = bytes(self.commits.where(F.col("oid") == F.lit(bytearray(commit))).first().tree), "tree"
        for name in [p for p in path.split("/") if p not in ("", ".")]:
            if kind != "tree":
                return None
            row = self.entries.where((F.col("parent") == F.lit(bytearray(oid))) & (F.col("name") == name)).first()
            if row is None:
                return None
            oid, kind = bytes(row.oid), row.kind
        return oid, kind

    def holders(self, path: str, blob: bytes) -> DataFrame:
        """(commit, ts) of reachable commits that have ``blob`` at ``path``; distinct root trees are walked once."""
        commits = self.frame(self.ancestors(x for r in self.refs for x in self.tag_chain(r.target)))
        rows = self.commits.join(commits, "oid", "left_semi").select(F.col("oid").alias("commit"), "ts", "tree")
        return holders(rows, self.entries, path, F.lit(bytearray(blob))).select("commit", "ts")
