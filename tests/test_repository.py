"""Generated repositories, with Git's own plumbing as the oracle."""

import hashlib
import io
import json
import os
import subprocess

import pytest

from storelens import cli
from storelens.plans.relations import Store
from storelens.sources import odb
from storelens.sources.datasource import read_table
from storelens.sources.repository import BadRevision, NotARepository, discover, parse_revision, read_refs

ENV = os.environ | {"GIT_AUTHOR_NAME": "A U", "GIT_AUTHOR_EMAIL": "a@u", "GIT_COMMITTER_NAME": "A U", "GIT_COMMITTER_EMAIL": "a@u", "GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_NOSYSTEM": "1"}


def git(repo, *args, date=None, data=None):
    env = ENV | ({"GIT_AUTHOR_DATE": date, "GIT_COMMITTER_DATE": date} if date else {})
    return subprocess.run(["git", "-C", str(repo), *args], check=True, capture_output=True, text=True, env=env, input=data).stdout.strip()


def commit(repo, files, date, message="m"):
    for name, text in files.items():
        path = repo / name
        if text is None:
            path.unlink()
        else:
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text)
    git(repo, "add", "-A")
    git(repo, "commit", "-qm", message, date=date)


def build(r, algorithm):
    """Deltas, a deleted file, copies in two folders, a merge, a branch, tags, loose and dangling objects."""
    git(r, "init", "-q", "-b", "main", f"--object-format={algorithm}")
    text = "\n".join(map(str, range(4000)))
    commit(r, {"big.txt": text, "db/dump.sql": "create table t(a int);\n" * 3000, "a/x/f.txt": "same", "b/x/f.txt": "same"}, "2020-01-05T00:00:00Z")
    commit(r, {"big.txt": text.replace("77", "seventy"), "src/m.go": 'import "./x"\nif a {\n}\n'}, "2020-03-05T00:00:00Z")
    git(r, "tag", "-a", "v1", "-m", "one")
    git(r, "branch", "side")
    commit(r, {"db/dump.sql": None, "src/m.go": "if b {\n}\nfor c {\n}\n"}, "2020-03-09T00:00:00Z")
    git(r, "checkout", "-q", "side")
    commit(r, {"side.bin": "s" * 9000}, "2020-04-01T00:00:00Z")
    git(r, "checkout", "-q", "main")
    git(r, "merge", "-q", "--no-ff", "-m", "merge", "side", date="2021-02-01T00:00:00Z")
    git(r, "checkout", "-q", "-b", "only", "HEAD~1")
    commit(r, {"only.bin": "o" * 5000}, "2021-02-02T00:00:00Z")
    git(r, "checkout", "-q", "main")
    git(r, "gc", "-q")
    git(r, "commit-graph", "write", "--reachable")
    commit(r, {"late.txt": "late"}, "2021-03-01T00:00:00Z")
    git(r, "hash-object", "-w", "--stdin", data="nobody has this")
    git(r, "tag", "blobtag", git(r, "rev-parse", "HEAD:late.txt"))
    return r


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    return build(tmp_path_factory.mktemp("repo"), "sha1")


@pytest.fixture(scope="module", params=["sha1", "sha256"])
def either(request, repo, tmp_path_factory):
    return repo if request.param == "sha1" else build(tmp_path_factory.mktemp("wide"), "sha256")


def run(spark, repo, *args):
    out, err = io.StringIO(), io.StringIO()
    code = cli.main([*args, "--repo", str(repo), "--json"], spark, out, err)
    text = out.getvalue()
    return code, json.loads(text) if text.strip() else err.getvalue()


def test_objects_equal_plumbing(spark, either):
    repo = either
    want = {}
    for line in git(repo, "cat-file", "--batch-all-objects", "--batch-check=%(objectname) %(objecttype) %(objectsize) %(objectsize:disk)").splitlines():
        oid, kind, size, disk = line.split()
        want[oid] = (kind, int(size), int(disk))
    rows = read_table(spark, str(repo), "objects", range="7").collect()
    assert {r.oid.hex(): (r.type, r.logical_bytes, r.physical_bytes) for r in rows} == want
    for r in read_table(spark, str(repo), "payloads").collect():
        head = f"{r.type} {len(r.payload)}\0".encode()
        assert (hashlib.sha1 if len(r.oid) == 20 else hashlib.sha256)(head + r.payload).digest() == bytes(r.oid)
    one = next(iter(want))
    assert [r.oid.hex() for r in read_table(spark, str(repo), "objects", oid=one).collect()] == [one]
    assert {r.type for r in read_table(spark, str(repo), "objects", types="tag,commit").collect()} == {"tag", "commit"}


def test_commits_and_graph_agree(spark, either):
    repo = either
    parsed = {bytes(r.oid): (bytes(r.tree), [bytes(p) for p in r.parents], r.committer_ts) for r in read_table(spark, str(repo), "commits").collect()}
    graph = {bytes(r.oid): (bytes(r.tree), [bytes(p) for p in r.parents], r.committer_ts) for r in read_table(spark, str(repo), "commit_graph").collect()}
    assert graph and all(parsed[k] == v for k, v in graph.items()) and len(parsed) == len(graph) + 1
    beyond = [bytes(r.oid) for r in read_table(spark, str(repo), "commits", beyond="graph").collect()]
    assert set(beyond) == parsed.keys() - graph.keys()
    store = Store(spark, discover(str(repo)))
    assert {bytes(r.oid): (bytes(r.tree), [bytes(p) for p in r.parents], r.ts) for r in store.commits.collect()} == parsed


def test_paths_status_and_reachability(spark, repo):
    store = Store(spark, discover(str(repo)))
    paths = {(bytes(r.oid).hex(), r.path) for r in store.blob_paths.collect()}
    want = set()
    for c in git(repo, "rev-list", "--all").split():
        want |= {(line.split()[2], line.split("\t")[1]) for line in git(repo, "ls-tree", "-r", c).splitlines()}
    assert paths == want
    head = {(line.split()[2], line.split("\t")[1]) for line in git(repo, "ls-tree", "-r", "HEAD").splitlines()}
    assert {(bytes(r.oid).hex(), r.path) for r in store.head_files.collect()} == head
    reach = {line.split()[0] for line in git(repo, "rev-list", "--objects", "--all").splitlines()}
    mine = {bytes(r.oid).hex() for r in store.reachable.collect()}
    assert mine == reach | {git(repo, "rev-parse", "v1")}


def test_storage_commands(spark, repo):
    kinds = [line.split()[0] for line in git(repo, "cat-file", "--batch-all-objects", "--batch-check=%(objecttype)").splitlines()]
    _, got = run(spark, repo, "objects")
    assert {k: v["count"] for k, v in got["objects"].items()} == {k: kinds.count(k) for k in ("blob", "tree", "commit", "tag")}
    _, got = run(spark, repo, "largest", "--limit", "2")
    assert [b["path"] for b in got["blobs"]] == ["db/dump.sql", "big.txt"]
    _, got = run(spark, repo, "largest", "--historical", "--limit", "1")
    assert got["blobs"][0]["path"] == "db/dump.sql" and got["blobs"][0]["lfs_candidate"]
    assert run(spark, repo, "largest", "--limit", "0")[1] == {"blobs": []}
    _, got = run(spark, repo, "unreachable")
    assert got["unreachable"]["count"] == 1 and got["unreachable"]["logical_bytes"] == len("nobody has this")
    _, got = run(spark, repo, "dupes")
    assert [(d["paths"], d["wasted_bytes"]) for d in got["dupes"]] == [(["a/x/f.txt", "b/x/f.txt"], 4)]
    _, got = run(spark, repo, "packs")
    deltas = sum(len(x.split()) == 7 for x in git(repo, "verify-pack", "-v", *map(str, (repo / ".git/objects/pack").glob("*.idx"))).splitlines())
    assert got["summary"]["pack_count"] == 1 and got["packs"][0]["delta_count"] == deltas and got["summary"]["repack_hint"] is None


def test_history_commands(spark, repo):
    _, got = run(spark, repo, "growth")
    assert [b["month"] for b in got["buckets"]] == ["2020-01", "2020-03", "2020-04", "2021-02", "2021-03"]
    assert got["buckets"][2]["introduced_bytes"] == 9000 and got["buckets"][3]["introduced_bytes"] == 5000 and got["buckets"][4]["introduced_bytes"] == 4
    _, last = run(spark, repo, "growth", "--months", "2")
    assert last["buckets"] == got["buckets"][-2:] and last["total_introduced_bytes"] == got["total_introduced_bytes"]
    _, got = run(spark, repo, "refs", "--limit", "0")
    weight = {r["name"]: r["unique_bytes"] for r in got["refs"]}
    assert weight["only"] >= 5000 and weight["side"] == 0 and list(weight.values()) == sorted(weight.values(), reverse=True)
    code, got = run(spark, repo, "explain", "db/dump.sql")
    first, third = git(repo, "rev-list", "--reverse", "--first-parent", "main").split()[0], git(repo, "log", "--diff-filter=D", "--format=%H", "--", "db/dump.sql")
    assert code == 0 and first.startswith(got["introduced"]["commit"]) and third.startswith(got["deleted"]["commit"])
    assert got["introduced"]["author"] == "A U <a@u>" and got["remediation"]["verdict"] == "history_rewrite"
    assert got["retained_by"] == ["refs/heads/main", "refs/heads/only", "refs/heads/side", "refs/tags/v1"]
    assert run(spark, repo, "explain", "nowhere")[0] == 1
    assert run(spark, repo, "explain", git(repo, "hash-object", "--stdin", data="nobody has this")[:12])[1]["remediation"]["verdict"] == "gc"


def test_change_commands(spark, repo):
    code, got = run(spark, repo, "changed", "src", "--base", "v1", "--to", "main", "--exit-code")
    assert code == 1 and got["changed"] and got["base"]["tree"] == git(repo, "rev-parse", "v1^{commit}:src")
    assert run(spark, repo, "changed", "a", "--base", "main~2", "--exit-code")[0] == 0
    assert run(spark, repo, "changed", "nope")[0] == 1 and run(spark, repo, "changed", "a", "--base", "nope")[0] == 2
    code, got = run(spark, repo, "pr", "--base", "v1", "--to", "main~1^1", "--max-points", "1")
    assert code == 6 and (got["changed_files"], got["added_lines"], got["removed_lines"], got["added_branches"]) == (2, 3, 3002, 2)
    assert run(spark, repo, "check", "--max-blob", "1KB")[0] == 6 and run(spark, repo, "check", "--max-blob", "1GB", "--max-growth", "1GB")[0] == 0
    _, got = run(spark, repo, "complexity", "--base", "v1")
    assert got["source_files"] == 1 and got["dimensions"]["branch_lines"] == 2 and got["comparison"]["delta_points"] < 0
    _, got = run(spark, repo, "summary")
    assert got["historical_bytes"] > 60000 and len(got["largest_contributors"]) == 4 and got["weight"]["working_tree_bytes"] > 0


def test_batch(spark, repo, tmp_path):
    tsv = tmp_path / "in.tsv"
    tsv.write_text("pr_id\tmerged_at\tstage\tbase\tto\n# c\n\n7\t2020\tpre\tv1\tmain\r\n")
    out = io.StringIO()
    assert cli.main(["pr", "--input", str(tsv), "--json", "--repo", str(repo)], spark, out) == 0
    assert json.loads(out.getvalue())["pr_id"] == "7"
    tsv.write_text("7\t2020\tmid\tv1\tmain\n")
    assert cli.main(["pr", "--input", str(tsv), "--json", "--repo", str(repo)], spark, out, io.StringIO()) == 2


def test_discovery(repo, tmp_path):
    assert discover(str(repo / "src")).kind == "normal"
    bare, linked = tmp_path / "b.git", tmp_path / "w"
    git(repo, "clone", "-q", "--bare", str(repo), str(bare))
    git(repo, "worktree", "add", "-q", "--detach", str(linked), "HEAD~1")
    assert discover(str(bare)).kind == "bare" and discover(str(linked)).common_dir == str(repo / ".git")
    heads = {r.target.hex() for r in read_refs(discover(str(linked))) if r.is_head}
    assert heads == {git(repo, "rev-parse", "HEAD~1")}
    git(repo, "worktree", "remove", "--force", str(linked))
    with pytest.raises(NotARepository):
        discover(str(tmp_path))


def test_empty_repository(spark, tmp_path):
    git(tmp_path, "init", "-q")
    assert run(spark, tmp_path, "objects")[1]["objects"]["blob"] == {"count": 0, "logical_bytes": 0}
    assert run(spark, tmp_path, "growth")[1] == {"buckets": [], "total_introduced_bytes": 0}
    assert run(spark, tmp_path, "refs")[1] == {"refs": []}


def test_options():
    for argv in (["explain"], ["check"], ["largest", "--current", "--historical"], ["complexity", "--to", "x"], ["refs", "--max-points", "3"], ["pr", "--input", "f"], ["largest", "--min-size", "4Q"]):
        with pytest.raises(cli.Invalid):
            cli.parse(argv)
    assert cli.parse(["largest", "/r", "--min-size", "2KB"]).min_size == 2048


def test_revisions():
    assert parse_revision("main~2^1^").steps == (("~", 2), ("^", 1), ("^", 1))
    for bad in ("~1", "", "a" + "~1" * 33):
        with pytest.raises(BadRevision):
            parse_revision(bad)


def test_formats():
    assert odb.varint(b"\xac\x02", 0) == (300, 2)
    assert odb.apply_delta(b"hello world", bytes([11, 9, 0x91, 6, 5, 4]) + b"!abc") == b"world!abc"
    assert odb.parse_object_header(b"blob 12\0x") == ("blob", 12, 8)
    for bad in (b"blub 1\0", b"blob\0", b""):
        with pytest.raises(odb.Corrupt):
            odb.parse_object_header(bad)
    tree = b"100644 a b\0" + bytes(20) + b"40000 d\0" + b"\1" * 20 + b"160000 s\0" + b"\2" * 20 + b"120000 l\0" + b"\3" * 20
    assert [(e[1], e[2]) for e in odb.parse_tree(tree, 20)] == [("blob", b"a b"), ("tree", b"d"), ("submodule", b"s"), ("other", b"l")]
    with pytest.raises(odb.Unsupported):
        odb.PackIndex.read(b"\xfftOc\0\0\0\3" + bytes(1100), 20)
    c = odb.parse_commit(b"tree " + b"a" * 40 + b"\nparent " + b"b" * 40 + b"\nauthor X <x@y> 12 +0100\ncommitter Z <z@y> -3 +0000\n\nhi\n")
    assert c["author_ident"] == "X <x@y>" and c["author_ts"] == 12 and c["committer_ts"] == -3 and c["message"] == "hi\n"
