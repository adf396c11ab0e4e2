"""Column expressions and operators on small literal frames."""

import random
import re

import pytest
from pyspark.sql import functions as F

from storelens.functions import constructs, lines, paths, sizes
from storelens.operators import history, scoring, storage
from storelens.plans import graph


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in df.orderBy("k").select(expression(F.col("v"))).collect()]


def test_sizes(spark):
    texts = ["10", "1KB", "1.5 MB", "2GiB", "3t", "12X", "", "KB", "1..2", "7 kib", "5 b"]
    want = [10, 1024, 1572864, 2 << 30, 3 << 40, None, None, None, None, 7168, 5]
    assert column(spark, texts, sizes.parse_size) == want
    assert [sizes.parse_size_text(t) for t in texts] == want
    numbers = [0, 1023, 1024, 10240, 319488, 96573849, 2942054236, 1 << 50]
    text = ["0 B", "1023 B", "1.00 KB", "10.0 KB", "312 KB", "92.1 MB", "2.74 GB", "1.00 PB"]
    assert column(spark, numbers, sizes.format_size, "bigint") == text
    assert [sizes.format_size_text(n) for n in numbers] == text


def test_sizes_round_halves_to_even(spark):
    numbers = [115200, 543232, 106 * 1024 + 512, 1152, 1408, 10496, 10 * 1024 + 768, 2176 << 40, 1024**2 - 1, -5, None]
    text = ["112 KB", "530 KB", "106 KB", "1.12 KB", "1.38 KB", "10.2 KB", "10.8 KB", "2.12 PB", "1024 KB", "-5 B", None]
    assert column(spark, numbers, sizes.format_size, "bigint") == text
    r = random.Random(8)
    more = [n for n in numbers if n is not None] + [r.randrange(1 << r.randrange(1, 64)) for _ in range(2000)] + [r.randrange(8, 8192) << 10 * k - 3 for k in range(1, 6) for _ in range(200)]
    more += [round(v * 1024**5 / 1000) for v in range(1005, 1100, 10)] + [(1 << 63) - 1, 100 * 1024**5 - 1, 10 * 1024**5 - 1]
    assert column(spark, more, sizes.format_size, "bigint") == [sizes.format_size_text(n) for n in more]


def test_dates_and_ids(spark):
    assert column(spark, [0, -5, 1577836800, 1580515199], sizes.month_of, "bigint") == ["1970-01", "1970-01", "2020-01", "2020-01"]
    assert column(spark, [1583020800], sizes.date_of, "bigint") == ["2020-03-01"]
    assert column(spark, [b"\xab\xcd\xef\x01\x23"], sizes.oid_abbrev, "binary") == ["abcdef0"]
    assert column(spark, ["abc", "abcd", "ABCDEF", "xyzz"], sizes.is_hex_prefix) == [False, True, True, False]


def test_paths(spark):
    names = ["a/b.txt", ".bashrc", "x.", "no", "d.e/f", "A.TAR.GZ", "d/.x.y", ""]
    assert column(spark, names, paths.extension_of) == ["txt", None, None, None, None, "GZ", "y", None]
    assert column(spark, ["x.PNG", "dump.sql", "a.go", None], lambda p: paths.is_lfs_candidate(F.lit(10), p)) == [True, True, False, False]
    assert column(spark, [None, "a"], lambda p: paths.is_lfs_candidate(F.lit(5 << 20), p)) == [True, True]
    files = ["a.go", "x.tf", "y.sql", "a.GO", "vendor/a.go", "web/components/A.tsx", "A.tsx", "my-package.json", "a.min.js"]
    assert column(spark, files, paths.is_source) == [True, True, True, False, True, True, True, False, True]
    assert column(spark, files, paths.is_excluded) == [False] * 4 + [True] + [False] * 3 + [True]
    assert column(spark, files, paths.is_ui_component) == [False] * 5 + [True] + [False] * 3
    assert column(spark, files, paths.is_manifest) == [False] * 7 + [True, False]
    assert column(spark, ["refs/heads/a/b", "refs/tags/v1", "refs/notes/x", "HEAD"], paths.short_ref_name) == ["a/b", "v1", "refs/notes/x", "HEAD"]
    assert column(spark, ["it's", "a b"], paths.shell_quote) == ["'it'\\''s'", "'a b'"]


def test_lines(spark):
    texts = ["if x:", "\t else if y", "  for(;;)", "iffy", "matches", "match x", "x if y", ""]
    assert column(spark, texts, lines.is_branch) == [True, True, True, False, False, True, False, False]
    urls = ["see http://a.b/c https://d.e:80", "http://localhost/x", "https:///", "x http://h.i)", "none", "http://q"]
    assert column(spark, urls, lines.url_host) == ["d.e", None, None, "h.i", None, "q"]
    assert column(spark, ["a\0b", "ab", ""], lines.is_binary) == [True, False, False]


def tokens(text):
    """SQL tokens by a state machine."""
    out, state, i = [], "", 0
    clean = ""
    while i < len(text):
        two = text[i : i + 2]
        if not state:
            if two == "--":
                state, clean = "\n", clean + " "
            elif two == "/*":
                state, clean = "*/", clean + " "
            elif text[i] in "'\"":
                state, clean = text[i], clean + " "
            else:
                clean += text[i].lower()
        elif state == "\n":
            if text[i] == "\n":
                state, clean = "", clean + "\n"
        elif state == "*/":
            if two == "*/":
                state, i = "", i + 1
        elif two == state * 2:
            i += 1
        elif text[i] == state:
            state = ""
        i += 1
    out = [t for t in re.split(r"[ \t\r\n(){};,.\[\]]+", clean) if t]
    return out


def test_sql_tokens_against_a_state_machine(spark):
    r = random.Random(3)
    texts = ["".join(r.choice(["-", "/", "*", "'", '"', "\n", "A", "b", " ", "create", ";"]) for _ in range(r.randrange(25))) for _ in range(3000)]
    assert column(spark, texts, constructs.sql_tokens) == [tokens(t) for t in texts]


def terraform(text):
    """Terraform lines by a state machine."""
    n, inside = [0] * 8, False
    for raw in text.split("\n"):
        if inside:
            if "*/" not in raw:
                continue
            raw, inside = raw[raw.index("*/") + 2 :], False
        if "/*" in raw:
            k = raw.index("/*")
            inside, raw = "*/" not in raw[k + 2 :], raw[:k]
        line = raw.strip(" \t\r")
        if not line or line[0] == "#" or line.startswith("//"):
            continue
        for k, word in enumerate(("resource", "data", "module", "provider", "dynamic")):
            n[k] += line == word or (line.startswith(word) and line[len(word)] in ' \t\n\r\x0b\x0c"{')
        assigned = lambda w, line=line: line.startswith(w) and line[len(w) :].lstrip(" \t").startswith("=")
        n[5] += assigned("for_each") or assigned("count")
        n[6] += assigned("depends_on")
        n[7] += " ? " in line
    return n


def test_terraform_against_a_state_machine(spark):
    r = random.Random(4)
    parts = ["resource", "data ", 'module"', "provider{", "dynamic", "count =", "for_each=", "depends_on\t=", " ? ", "/*", "*/", "\n", "#", "//", " ", "\r", "x"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(2000)] + [""]
    assert column(spark, texts, constructs.terraform_counts) == [terraform(t) for t in texts]


def test_closures(spark):
    links = [("r", "a"), ("r", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("t", "d")]
    edges = spark.createDataFrame(links, "src string, dst string")
    seeds = lambda *n: spark.createDataFrame([(x,) for x in n], "node string")
    reached = lambda df: {r.node for r in df.collect()}
    assert reached(graph.closure(seeds("a"), edges)) == {"a", "c", "d"}
    assert reached(graph.closure(seeds("x", "zz"), edges)) == {"x", "y", "zz"}
    assert reached(graph.reverse_closure(seeds("d"), edges)) == {"d", "c", "a", "b", "r", "t"}
    refs = spark.createDataFrame([("refs/heads/m", "r", False), ("refs/tags/t", "t", False), ("HEAD", "r", True), ("refs/heads/z", "r", False)], "name string, target string, is_head boolean")
    sizes_ = spark.createDataFrame([(n, 10) for n in "rabcdxyt"], "node string, size bigint")
    want = [("m", "refs/heads/m", 40), ("t", "refs/tags/t", 10)]
    for masks in (True, False):
        assert [tuple(r) for r in history.unique_weights(refs, edges, sizes_, masks=masks).collect()] == want
    assert history.retained_by(seeds("d"), edges, refs).first()[0] == ["refs/heads/m", "refs/heads/z", "refs/tags/t"]


def test_many_masks(spark):
    edges = spark.createDataFrame([(f"t{k}", f"n{k // 2}") for k in range(64)], "src string, dst string")
    tips = spark.createDataFrame([(k, f"t{k}") for k in range(64)], "bit int, node string")
    masks = {r.node: r.mask & (2**64 - 1) for r in graph.mask_closure(tips, edges).collect()}
    assert masks["t63"] == 1 << 63 and masks["n31"] == 3 << 62
    refs = spark.createDataFrame([(f"refs/heads/{k:03}", f"t{k}", False) for k in range(65)], "name string, target string, is_head boolean")
    sizes_ = spark.createDataFrame([(f"t{k}", 1) for k in range(64)] + [(f"n{k}", 10) for k in range(32)], "node string, size bigint")
    got = history.unique_weights(refs, edges, sizes_).collect()  # more than a mask holds
    assert [r.unique_bytes for r in got] == [1] * 64 + [0]
    with pytest.raises(ValueError, match="64"):
        history.unique_weights(refs, edges, sizes_, masks=True)
    with pytest.raises(Exception, match="64 bits"):
        graph.mask_closure(spark.createDataFrame([(64, "t0")], "bit int, node string"), edges).collect()


def test_long_closure_and_paths(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(12)] + [(5, 5)], "src bigint, dst bigint")
    assert graph.closure(spark.createDataFrame([(0,)], "node bigint"), links).count() == 13
    entries = spark.createDataFrame([("r", "a", "t1", "tree"), ("r", "f", "b1", "blob"), ("t1", "x", "b2", "blob"), ("q", "a", "t1", "tree"), ("q", "f", "b3", "blob")], "parent string, name string, oid string, kind string")
    roots = spark.createDataFrame([("r", "r"), ("q", "q"), ("z", "z")], "root string, parent string")
    walked = lambda path: sorted(map(tuple, graph.walk_path(roots, entries, path).collect()))
    assert walked("a/x") == [("q", "b2", "blob"), ("r", "b2", "blob")] and walked("f/x") == [] and walked("a/y") == []
    versions = spark.createDataFrame([(1, "r"), (2, "q"), (3, "r"), (4, "z")], "commit bigint, tree string")
    held = lambda path, oid: sorted(r.commit for r in graph.holders(versions, entries, path, oid).collect())
    assert held("f", F.lit("b1")) == [1, 3] and held("a/x", F.lit("b2")) == [1, 2, 3]


def test_chains_and_hierarchies(spark):
    links = spark.createDataFrame([(k, k - 1 if k % 50 else None) for k in range(200)], "node bigint, parent bigint")
    assert {r.node: r.depth for r in graph.chain_depth(links).collect()} == {k: k % 50 for k in range(200)}
    assert {r.node: r.ancestor for r in graph.nth_ancestor(links, 2).collect()}[51] is None
    rows = [("R", "d1", "T", "tree"), ("R", "d2", "T", "tree"), ("T", "f", "B", "blob"), ("R", "s", "S", "submodule")]
    entries = spark.createDataFrame(rows, "parent string, name string, oid string, kind string")
    flat = graph.flatten_hierarchy(spark.createDataFrame([("R",)], "root string"), entries)
    assert sorted((r.path, r.oid) for r in flat.collect()) == [("d1/f", "B"), ("d2/f", "B"), ("s", "S")]


def test_introduced_and_deleted(spark):
    commits = spark.createDataFrame([(1, None, 10), (2, 1, 20), (3, 2, 30), (4, 3, 40), (5, 4, 50)], "commit bigint, parent bigint, ts bigint")
    has = spark.createDataFrame([("a", 2, 20), ("a", 3, 30), ("b", 1, 10), ("b", 5, 50), ("c", 5, 50)], "object string, commit bigint, ts bigint")
    head = spark.createDataFrame([("b",), ("c",)], "object string")
    got = {r.object: (r.introduced, r.deleted) for r in history.introduced_deleted(has, commits, head).collect()}
    assert got == {"a": (2, 4), "b": (1, None), "c": (5, None)}


@pytest.mark.parametrize(
    ("count", "smallest", "total", "logical", "physical", "hint"),
    [(1, 5, 5, 0, 0, None), (4, 1, 100, 0, 0, "4 packfiles"), (4, 30, 100, 0, 0, None), (8, 20, 100, 0, 0, "8 packfiles"), (1, 5, 5, 100, 51, "51%"), (1, 5, 5, 100, 50, None)],
)
def test_pack_hint(spark, count, smallest, total, logical, physical, hint):
    row = spark.createDataFrame([(count, smallest, total, logical, physical)], "pack_count bigint, smallest_bytes bigint, total_bytes bigint, total_delta_logical bigint, total_delta_physical bigint")
    got = row.select(storage.pack_hint()).first()[0]
    assert (got is None) if hint is None else hint in got


def test_remediation(spark):
    rows = [("blob", 10, "a'b.bin", False, False), ("blob", 10, "d/a'b.bin", True, False), ("blob", 10, None, True, False), ("blob", 6 << 20, "big", True, True), ("blob", 1, "x.png", True, True), ("tree", 9 << 20, "t.png", True, True)]
    df = spark.createDataFrame(rows, "type string, logical_bytes bigint, path string, reachable boolean, reachable_from_head boolean")
    got = [(r.verdict, list(r.commands), r.lfs_pattern) for r in history.remediation(df).collect()]
    assert got[0] == ("gc", [history.GC_COMMAND], None)
    assert got[1] == ("history_rewrite", ["git filter-repo --invert-paths --path 'd/a'\\''b.bin'", "bfg --delete-files a'b.bin"], None)
    assert got[2:] == [("history_rewrite", [], None), ("none", [], "big"), ("none", [], "*.png"), ("none", [], None)]


def test_complexity_and_change(spark):
    go = "package a\nimport \"example.com/m/x\"\nif x {\n\n}\nhttps://api.io/v1\nhmac"
    files = [("a.go", go), ("vendor/b.go", "if x"), ("go.mod", "module example.com/m"), ("bin.py", "a\0b"), ("m/migrations/1.sql", "create table t(a int); -- join"), ("notes.txt", "x"), ("i.tf", 'resource "a" "b" {')]
    df = spark.createDataFrame(files, "path string, text string")
    row = scoring.complexity(df, "example.com/m/").first()
    assert (row.source_files, row.source_lines, row.branch_lines, row.internal_imports, row.external_host_references) == (3, 8, 1, 1, 1)
    assert (row.crypto_files, row.dependency_manifests, row.excluded_files, row.binary_files, row.sql_tables, row.terraform_resources, row.sql_migration_files) == (1, 1, 3, 1, 1, 1, 1)
    assert row.structural_points == 4 + 9 + 6 + 12 + 4 + 10 and row.domain_points == 16
    assert row.total_points == row.size_points + row.structural_points + row.domain_points
    empty = df.limit(0)
    added, removed = scoring.change_score(empty, df).first(), scoring.change_score(df, empty).first()
    assert (added.files, added.added_lines, added.removed_lines, added.domain_points) == (7, 8, 0, 16)
    assert (removed.added_lines, removed.removed_lines, removed.domain_points) == (0, 8, 0)
    assert scoring.change_score(df, df).first().total_points == 0
    delta = scoring.complexity_delta(df, df).first()
    assert delta.delta_total_points == 0


def test_line_multisets(spark):
    before = spark.createDataFrame([("f.py", "a\nb\na\n\nif x")], "path string, text string")
    after = spark.createDataFrame([("f.py", "a\nif y\nb\nif y\nif x")], "path string, text string")
    row = scoring.change_score(before, after).first()
    assert (row.added_lines, row.removed_lines, row.added_branches, row.work_points) == (2, 1, 2, 2 + 1 + 8 + 3)


def test_duplicate_paths_are_capped(spark):
    rows = [("x", f"p{k:03}") for k in range(40)] + [("x", "p000"), ("y", "q"), ("z", "r"), ("z", "s")]
    df = spark.createDataFrame(rows, "oid string, path string")
    size = spark.createDataFrame([("x", 10), ("y", 10), ("z", 1000)], "oid string, logical_bytes bigint")
    got = storage.duplicates(df, size).collect()
    assert [(r.oid, r.path_count, len(r.paths), r.truncated, r.wasted_bytes) for r in got] == [("z", 2, 2, False, 1000), ("x", 40, 32, True, 390)]
