"""Queries over the star schema, one for each operator, and the DuckDB SQL with the same result.

The tables play the parts of an object store: documents are blobs, labelled ones are in the current
tree, region-nation-customer-orders-part is a graph whose tips are nations or customers, orders are
commits whose parent is the customer's order before, lineitems are their files, events are pack
entries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storelens.functions import constructs, lines, paths, sizes
from storelens.operators import history, scoring, storage
from storelens.plans import graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- blobs ---------------------------------------------------------------------------------------

PATH = "concat(source, '/', lang, '/', doc_id, '.txt')"
BLOBS_SQL = f"blobs AS (SELECT doc_id, sha1(coalesce(text, '')) AS oid, strlen(coalesce(text, ''))::BIGINT AS logical_bytes, {PATH} AS path, lang, source FROM documents)"


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stored copies: oid, logical_bytes, path."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.sha1(text.cast("binary")).alias("oid"), F.octet_length(text).cast("bigint").alias("logical_bytes"), F.expr(PATH).alias("path"), "lang", "source")


def with_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.with_status(blobs(spark, sf_dir), table(spark, sf_dir, "labels"), "doc_id")


def _largest(spark, sf_dir, **options) -> DataFrame:
    rows = with_status(spark, sf_dir).withColumn("sha", F.col("oid")).withColumn("oid", F.col("doc_id"))
    return storage.largest(rows, **options).select("doc_id", F.col("sha").alias("oid"), "logical_bytes", "path", "status", "lfs_candidate")


def _largest_sql(where: str = "true", limit: int = 20) -> str:
    return f"""WITH {BLOBS_SQL}, s AS (SELECT b.*, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'current' ELSE 'historical' END AS status FROM blobs b)
SELECT doc_id, oid, logical_bytes, path, status, logical_bytes >= 5242880 AS lfs_candidate FROM s WHERE {where} ORDER BY logical_bytes DESC, doc_id LIMIT {limit}"""


@query(_largest_sql())
def largest_topk(spark, sf_dir):
    return _largest(spark, sf_dir)


@query(_largest_sql("logical_bytes >= 4096", 50))
def largest_min_size(spark, sf_dir):
    return _largest(spark, sf_dir, min_size=4096, limit=50)


@query(_largest_sql("status = 'current'"))
def largest_current(spark, sf_dir):
    return _largest(spark, sf_dir, status="current")


@query(_largest_sql("status = 'historical'"))
def largest_historical(spark, sf_dir):
    return _largest(spark, sf_dir, status="historical")


@query(f"WITH {BLOBS_SQL} SELECT b.doc_id, CASE WHEN l.doc_id IS NULL THEN 'historical' ELSE 'current' END AS status FROM blobs b LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def status_flag(spark, sf_dir):
    return with_status(spark, sf_dir).select("doc_id", "status")


LANGS = ("de", "en", "es", "fr", "xx")


@query(
    f"WITH {BLOBS_SQL} SELECT t.type, count(b.oid) AS count, coalesce(sum(b.logical_bytes), 0)::BIGINT AS bytes "
    "FROM (VALUES ('de'), ('en'), ('es'), ('fr'), ('xx')) t(type) LEFT JOIN blobs b ON b.lang = t.type GROUP BY t.type"
)
def type_stats(spark, sf_dir):
    return storage.type_stats(blobs(spark, sf_dir), LANGS, "lang")


@query(f"WITH {BLOBS_SQL} SELECT count(DISTINCT oid) AS objects, count(*) AS copies FROM blobs")
def object_count_distinct(spark, sf_dir):
    return blobs(spark, sf_dir).agg(F.count_distinct("oid").alias("objects"), F.count("*").alias("copies"))


@query(f"WITH {BLOBS_SQL} SELECT oid, doc_id, path, logical_bytes FROM blobs QUALIFY row_number() OVER (PARTITION BY oid ORDER BY doc_id) = 1")
def dedup_prefer_first(spark, sf_dir):
    return storage.dedup_prefer_first(blobs(spark, sf_dir), "oid", "doc_id").select("oid", "doc_id", "path", "logical_bytes")


@query(f"WITH {BLOBS_SQL} SELECT doc_id, oid, logical_bytes FROM blobs WHERE oid = (SELECT sha1(coalesce(text, '')) FROM documents WHERE doc_id = 7)")
def point_lookup(spark, sf_dir):
    found = blobs(spark, sf_dir)
    wanted = found.where("doc_id = 7").select(F.col("oid").alias("wanted"))
    return found.join(wanted, F.col("oid") == F.col("wanted"), "left_semi").select("doc_id", "oid", "logical_bytes")


@query(
    f"WITH {BLOBS_SQL}, p AS (SELECT unnest(['ab', 'abc', 'abcd', '00', '7f3']) AS prefix), m AS (SELECT prefix, count(DISTINCT oid) AS matches FROM p LEFT JOIN blobs ON starts_with(oid, prefix) GROUP BY prefix) "
    "SELECT prefix, matches, CASE WHEN matches = 0 THEN 'none' WHEN matches = 1 THEN 'unique' ELSE 'ambiguous' END AS outcome FROM m"
)
def prefix_lookup(spark, sf_dir):
    prefixes = ("ab", "abc", "abcd", "00", "7f3")
    found = blobs(spark, sf_dir).select("oid").distinct()
    counts = found.agg(*(F.count(F.when(F.col("oid").startswith(p), 1)).alias(p) for p in prefixes))
    rows = counts.select(F.explode(F.array(*(F.struct(F.lit(p).alias("prefix"), F.col(p).alias("matches")) for p in prefixes))).alias("r")).select("r.*")
    return rows.withColumn("outcome", F.when(F.col("matches") == 0, "none").when(F.col("matches") == 1, "unique").otherwise("ambiguous"))


@query(
    "WITH a AS (SELECT s_suppkey AS key, s_name AS name FROM supplier), b AS (SELECT c_custkey AS key, c_name AS name FROM customer) "
    "SELECT * FROM a UNION ALL SELECT * FROM b WHERE key NOT IN (SELECT key FROM a)"
)
def override_union(spark, sf_dir):
    loose = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    packed = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    return storage.override_union(loose, packed, "key")


@query(f"WITH {BLOBS_SQL} SELECT sum(logical_bytes)::BIGINT AS total, coalesce(sum(logical_bytes) FILTER (source <> 'src0'), 0)::BIGINT AS without_src0 FROM blobs")
def sum_bytes_total(spark, sf_dir):
    return blobs(spark, sf_dir).agg(F.sum("logical_bytes").alias("total"), F.coalesce(F.sum(F.when(F.col("source") != "src0", F.col("logical_bytes"))), F.lit(0)).alias("without_src0"))


# paths of every kind, made from part keys
_KINDS = ("src/a.go", "vendor/x.py", "web/components/B.tsx", "package.json", "db/migrations/1.sql", "infra/main.tf", "img/Logo.PNG", ".bashrc", "bin/tool.", "x.min.js", "lib/b_generated.rs", "notes", "a.b/c", "my-package.json", "data.parquet")
MADE_SQL = "made AS (SELECT p_partkey AS id, concat('d', p_partkey % 50, '/', [" + ", ".join(f"'{k}'" for k in _KINDS) + f"][(p_partkey % {len(_KINDS)})::INT + 1]) AS path, (p_partkey * 9973 % 7000000)::BIGINT AS size FROM part)"


def made_paths(spark, sf_dir) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("p_partkey") % len(_KINDS) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("d"), (F.col("p_partkey") % 50).cast("string"), F.lit("/"), kind).alias("path"), (F.col("p_partkey") * 9973 % 7000000).cast("bigint").alias("size")
    )


_EXT_SQL = r"nullif(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+\.([^.]+)$', 1), '')"
_LFS_SQL = f"(size >= 5242880 OR coalesce(lower({_EXT_SQL}) IN (" + ", ".join(f"'{x}'" for x in paths.LFS_EXTENSIONS) + "), false))"


@query(f"WITH {MADE_SQL} SELECT id, {_EXT_SQL} AS extension FROM made")
def extension_of(spark, sf_dir):
    return made_paths(spark, sf_dir).select("id", paths.extension_of(F.col("path")).alias("extension"))


@query(f"WITH {MADE_SQL} SELECT id, {_LFS_SQL} AS lfs_candidate FROM made")
def lfs_candidate(spark, sf_dir):
    return made_paths(spark, sf_dir).select("id", paths.is_lfs_candidate(F.col("size"), F.col("path")).alias("lfs_candidate"))


def _sql_any(test: str, words) -> str:
    return "(" + " OR ".join(test.format(w.replace("'", "''")) for w in words) + ")"


_SOURCE_SQL = _sql_any("ends_with(path, '{}')", (*paths.SOURCE_SUFFIXES, ".tf", ".sql"))
_EXCLUDED_SQL = _sql_any("contains(path, '{}')", paths.EXCLUDED_PARTS)
_MANIFEST_SQL = _sql_any("ends_with(path, '{}')", paths.MANIFESTS)
_UI_SQL = f"({_sql_any("ends_with(path, '{}')", paths.UI_SUFFIXES)} AND {_sql_any("contains(path, '{}')", paths.UI_FOLDERS)})"


@query(f"WITH {MADE_SQL} SELECT id, {_SOURCE_SQL} AS source, {_EXCLUDED_SQL} AS excluded, {_MANIFEST_SQL} AS manifest, {_UI_SQL} AS ui_component, ends_with(path, '.tf') AS terraform, ends_with(path, '.sql') AS is_sql FROM made")
def path_classify(spark, sf_dir):
    p = F.col("path")
    return made_paths(spark, sf_dir).select(
        "id", paths.is_source(p).alias("source"), paths.is_excluded(p).alias("excluded"), paths.is_manifest(p).alias("manifest"), paths.is_ui_component(p).alias("ui_component"), paths.is_terraform(p).alias("terraform"), paths.is_sql(p).alias("is_sql")
    )


@query(f"WITH {MADE_SQL} SELECT lower({_EXT_SQL}) AS extension, count(*) AS count, sum(size)::BIGINT AS bytes FROM made GROUP BY 1")
def types_by_extension(spark, sf_dir):
    return storage.by_extension(made_paths(spark, sf_dir).withColumnRenamed("size", "logical_bytes"))


# --- lines ---------------------------------------------------------------------------------------

# code lines that the prose lacks, put before each document's text
_CODE = (
    "if (x) return;", "\t for (;;) {", "import a from './util'", "use crate::x; import y from crate::z", "see https://api.test.io/v1 and http://other.org", "http://localhost:80/",
    "const k = hmac(key)", "// quicksort", "", "   ", "while(true)", "url = 'http://b.example:8080/x'", "matching", "import { B } from 'components/B'", "#include <x> ../y",
)
_CODE_SQL = "[" + ", ".join("'" + c.replace("'", "''").replace("\t", "' || chr(9) || '") + "'" for c in _CODE) + "]"


def code_docs(spark, sf_dir) -> DataFrame:
    """Documents with some code lines before their text, and a path of many kinds."""
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("doc_id") % len(_KINDS) + 1).cast("int"))
    line = lambda k: F.element_at(F.array(*map(F.lit, _CODE)), ((F.col("doc_id") + k) % len(_CODE) + 1).cast("int"))
    text = F.concat_ws("\n", line(0), line(4), line(7), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.concat(F.lit("p/"), F.col("doc_id").cast("string"), F.lit("/"), kind).alias("path"), text.alias("text"))


CODE_SQL = (
    "code AS (SELECT doc_id, source, concat('p/', doc_id, '/', [" + ", ".join(f"'{k}'" for k in _KINDS) + f"][(doc_id % {len(_KINDS)})::INT + 1]) AS path, "
    f"concat_ws(chr(10), {_CODE_SQL}[(doc_id % {len(_CODE)})::INT + 1], {_CODE_SQL}[((doc_id + 4) % {len(_CODE)})::INT + 1], {_CODE_SQL}[((doc_id + 7) % {len(_CODE)})::INT + 1], coalesce(text, '')) AS text FROM documents)"
)
LINES_SQL = CODE_SQL + ", code_lines AS (SELECT doc_id, source, path, unnest(string_split(text, chr(10))) AS line FROM code)"
_BRANCH_SQL = "regexp_matches(line, '^[ \t]*(if |if\\(|else if|elif |for |for\\(|while |while\\(|case |catch |catch\\(|except |switch |switch\\(|match )')"
_IMPORT_SQL = _sql_any("contains(line, '{}')", lines.IMPORT_WORDS)
_LOCAL_SQL = f"({_IMPORT_SQL} AND {_sql_any("contains(line, '{}')", lines.LOCAL_SNAPSHOT)})"
_CHANGE_LOCAL_SQL = f"({_IMPORT_SQL} AND {_sql_any("contains(line, '{}')", lines.LOCAL_CHANGE)})"
_CRYPTO_SQL = _sql_any("contains(line, '{}')", lines.CRYPTO_WORDS)
_ALGORITHM_SQL = _sql_any("contains(line, '{}')", lines.ALGORITHM_WORDS)
_HOST = r"""([^/"'' \t:)}]*)"""
_HOST_SQL = f"nullif(nullif(CASE WHEN contains(line, 'https://') THEN regexp_extract(line, 'https://{_HOST}', 1) ELSE regexp_extract(line, 'http://{_HOST}', 1) END, ''), 'localhost')"
_FILLED_SQL = "regexp_matches(line, '[^ \t\r]')"


def _code_lines(spark, sf_dir) -> DataFrame:
    return code_docs(spark, sf_dir).select("doc_id", "path", F.explode(lines.lines_of(F.col("text"))).alias("line"))


@query(f"WITH {LINES_SQL} SELECT doc_id, count(*) AS n_lines, count(*) FILTER ({_BRANCH_SQL}) AS branch_lines, count(*) FILTER ({_FILLED_SQL}) AS filled_lines FROM code_lines GROUP BY doc_id")
def branch_lines(spark, sf_dir):
    line = F.col("line")
    return _code_lines(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count(F.when(lines.is_branch(line), 1)).alias("branch_lines"), F.count(F.when(~lines.is_blank(line), 1)).alias("filled_lines"))


@query(f"WITH {LINES_SQL} SELECT doc_id, bool_or({_CRYPTO_SQL}) AS crypto, bool_or({_ALGORITHM_SQL}) AS algorithm, count(*) FILTER ({_IMPORT_SQL}) AS import_lines FROM code_lines GROUP BY doc_id")
def keyword_flags(spark, sf_dir):
    line = F.col("line")
    return _code_lines(spark, sf_dir).groupBy("doc_id").agg(F.bool_or(lines.is_crypto(line)).alias("crypto"), F.bool_or(lines.is_algorithm(line)).alias("algorithm"), F.count(F.when(lines.is_import(line), 1)).alias("import_lines"))


@query(f"WITH {LINES_SQL}, pl AS (SELECT page_id, url AS line FROM pages) SELECT 'line' AS origin, {_HOST_SQL} AS host, count(*) AS n FROM code_lines GROUP BY 2 UNION ALL SELECT 'page', {_HOST_SQL}, count(*) FROM pl GROUP BY 2")
def url_host(spark, sf_dir):
    hosts = _code_lines(spark, sf_dir).groupBy(lines.url_host(F.col("line")).alias("host")).agg(F.count("*").alias("n"))
    urls = table(spark, sf_dir, "pages").groupBy(lines.url_host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))
    return hosts.select(F.lit("line").alias("origin"), "host", "n").union(urls.select(F.lit("page").alias("origin"), "host", "n"))


# a NUL takes the place of a letter: texts with that letter are binary
@query("SELECT doc_id, position(chr(113) IN coalesce(text, '')) > 0 AS is_binary FROM documents")
def binary_filter(spark, sf_dir):
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("q"), F.lit("\0"))
    return table(spark, sf_dir, "documents").select("doc_id", lines.is_binary(text).alias("is_binary"))


@query(r"SELECT n_nationkey, regexp_replace(concat(['refs/heads/', 'refs/tags/', 'refs/remotes/', 'refs/notes/'][n_nationkey % 4 + 1], n_name), '^refs/(heads|tags|remotes)/', '') AS short FROM nation")
def short_name(spark, sf_dir):
    prefix = F.element_at(F.array(*map(F.lit, ("refs/heads/", "refs/tags/", "refs/remotes/", "refs/notes/"))), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "nation").select("n_nationkey", paths.short_ref_name(F.concat(prefix, "n_name")).alias("short"))


@query(f"WITH {BLOBS_SQL} SELECT doc_id, oid AS hex, substr(oid, 1, 7) AS abbrev, regexp_matches(substr(oid, 1, 4), '^[0-9a-fA-F]{{4,64}}$') AS is_prefix FROM blobs")
def oid_codec(spark, sf_dir):
    binary = F.unhex("oid")
    return blobs(spark, sf_dir).select("doc_id", sizes.oid_hex(binary).alias("hex"), sizes.oid_abbrev(binary).alias("abbrev"), sizes.is_hex_prefix(F.substring("oid", 1, 4)).alias("is_prefix"))


_UNITS = ("", "B", "kb", "KiB", "M", "mb", " MiB", "G", "GB", "TiB", "XB", "K B")


@query(
    "WITH t AS (SELECT p_partkey, concat(p_size, '.5', [" + ", ".join(f"'{u}'" for u in _UNITS) + f"][(p_partkey % {len(_UNITS)})::INT + 1]) AS s, p_size + 0.5 AS v, upper(trim([" + ", ".join(f"'{u}'" for u in _UNITS) + f"][(p_partkey % {len(_UNITS)})::INT + 1])) AS u FROM part) "
    "SELECT p_partkey, floor(v * CASE WHEN u IN ('', 'B') THEN 1 WHEN u IN ('K', 'KB', 'KIB') THEN 1024 WHEN u IN ('M', 'MB', 'MIB') THEN 1048576 WHEN u IN ('G', 'GB', 'GIB') THEN 1073741824 WHEN u IN ('T', 'TB', 'TIB') THEN 1099511627776 END)::BIGINT AS bytes FROM t"
)
def parse_size(spark, sf_dir):
    unit = F.element_at(F.array(*map(F.lit, _UNITS)), (F.col("p_partkey") % len(_UNITS) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", sizes.parse_size(F.concat(F.col("p_size").cast("string"), F.lit(".5"), unit)).alias("bytes"))


_FORMAT_SQL = "CASE " + " ".join(
    f"WHEN b >= 1024 ** {k} THEN CASE WHEN b / 1024 ** {k} >= 100 THEN printf('%.0f {n}', b / 1024 ** {k}) WHEN b / 1024 ** {k} >= 10 THEN printf('%.1f {n}', b / 1024 ** {k}) ELSE printf('%.2f {n}', b / 1024 ** {k}) END"
    for k, n in reversed(list(enumerate(sizes.NAMES))) if k
) + " ELSE concat(b, ' B') END"


@query(f"WITH t AS (SELECT o_orderkey, (o_orderkey * o_orderkey * 7 % 900000000)::BIGINT AS b FROM orders) SELECT o_orderkey, {_FORMAT_SQL} AS text FROM t")
def format_size(spark, sf_dir):
    b = (F.col("o_orderkey") * F.col("o_orderkey") * 7 % 900000000).cast("bigint")
    return table(spark, sf_dir, "orders").select("o_orderkey", sizes.format_size(b).alias("text"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, strftime(min(o_orderdate), '%Y-%m-%d') AS first_day FROM orders GROUP BY 1")
def month_bucket(spark, sf_dir):
    seconds = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    return table(spark, sf_dir, "orders").groupBy(sizes.month_of(seconds).alias("month")).agg(F.count("*").alias("n"), sizes.date_of(F.min(seconds)).alias("first_day"))


# --- graph ---------------------------------------------------------------------------------------

EDGES_SQL = """edges AS (
  SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL
  SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL
  SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders UNION ALL
  SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem UNION ALL
  SELECT 'o' || l_orderkey, 's' || l_suppkey FROM lineitem),
nodes AS (
  SELECT 'r' || r_regionkey AS node, 1::BIGINT AS size FROM region UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation UNION ALL
  SELECT 'c' || c_custkey, 10 FROM customer UNION ALL SELECT 'o' || o_orderkey, 100 FROM orders UNION ALL
  SELECT 'p' || p_partkey, p_size FROM part UNION ALL SELECT 's' || s_suppkey, 5 FROM supplier)"""


def _key(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


_EDGES = (("nation", "r", "n_regionkey", "n", "n_nationkey"), ("customer", "n", "c_nationkey", "c", "c_custkey"), ("orders", "c", "o_custkey", "o", "o_orderkey"), ("lineitem", "o", "l_orderkey", "p", "l_partkey"), ("lineitem", "o", "l_orderkey", "s", "l_suppkey"))


def edges(spark, sf_dir) -> DataFrame:
    return storage.union_all([table(spark, sf_dir, t).select(_key(a, x).alias("src"), _key(b, y).alias("dst")) for t, a, x, b, y in _EDGES])


def nodes(spark, sf_dir) -> DataFrame:
    rows = (("region", "r", "r_regionkey", F.lit(1)), ("nation", "n", "n_nationkey", F.lit(1)), ("customer", "c", "c_custkey", F.lit(10)), ("orders", "o", "o_orderkey", F.lit(100)), ("part", "p", "p_partkey", F.col("p_size")), ("supplier", "s", "s_suppkey", F.lit(5)))
    return storage.union_all([table(spark, sf_dir, t).select(_key(p, k).alias("node"), s.cast("bigint").alias("size")) for t, p, k, s in rows])


_REACHED_SQL = "reached AS (SELECT unnest(['r0', 'r1']) AS node UNION SELECT dst FROM reached JOIN edges ON src = node)"


def _reached(spark, sf_dir) -> DataFrame:
    return graph.closure(spark.createDataFrame([("r0",), ("r1",)], "node string"), edges(spark, sf_dir))


@query(f"WITH RECURSIVE {EDGES_SQL}, {_REACHED_SQL} SELECT node FROM reached")
def reachability_closure(spark, sf_dir):
    return _reached(spark, sf_dir)


@query(f"WITH RECURSIVE {EDGES_SQL}, {_REACHED_SQL} SELECT count(*) AS count, coalesce(sum(size), 0)::BIGINT AS logical_bytes, coalesce(sum(size // 2), 0)::BIGINT AS physical_bytes FROM nodes WHERE node NOT IN (SELECT node FROM reached)")
def unreachable_stats(spark, sf_dir):
    stored = nodes(spark, sf_dir).select(F.col("node").alias("oid"), F.col("size").alias("logical_bytes"), F.expr("size div 2").alias("physical_bytes"))
    return storage.unreachable_stats(stored, _reached(spark, sf_dir).withColumnRenamed("node", "oid"))


_SCAN_SQL = f"""WITH {BLOBS_SQL}, s AS (SELECT *, doc_id IN (SELECT doc_id FROM labels) AS head, source <> 'src3' AS reachable FROM blobs)
SELECT {", ".join(f"count(*) FILTER (lang = '{t}') AS {t}_count, coalesce(sum(logical_bytes) FILTER (lang = '{t}'), 0)::BIGINT AS {t}_bytes" for t in LANGS)},
coalesce(sum(logical_bytes) FILTER (NOT head), 0)::BIGINT AS historical_bytes, coalesce(sum(logical_bytes) FILTER (NOT reachable), 0)::BIGINT AS unreachable_bytes, count(*) FILTER (NOT reachable) AS unreachable_count FROM s"""


def _scanned(spark, sf_dir) -> DataFrame:
    return with_status(spark, sf_dir).withColumn("type", F.col("lang")).withColumn("reachable", F.col("source") != "src3")


@query(_SCAN_SQL)
def full_scan(spark, sf_dir):
    return storage.full_scan(_scanned(spark, sf_dir), LANGS)


@query(f"WITH scan AS ({_SCAN_SQL}), top AS ({_largest_sql(limit=4)}) SELECT scan.*, (SELECT list(doc_id ORDER BY logical_bytes DESC, doc_id) FROM top) AS largest FROM scan")
def summary_report(spark, sf_dir):
    top = _largest(spark, sf_dir, limit=4).agg(F.sort_array(F.collect_list(F.struct((-F.col("logical_bytes")).alias("b"), "doc_id"))).alias("t"))
    return full_scan(spark, sf_dir).join(top.select(F.col("t.doc_id").alias("largest")))


@query("SELECT r_name AS root, concat(n_name, '/', c_name) AS path, c_custkey AS oid FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey")
def hierarchy_flatten(spark, sf_dir):
    tree = _hierarchy(spark, sf_dir)
    names = table(spark, sf_dir, "region").select(_key("r", "r_regionkey").alias("root"), "r_name")
    return tree.join(names, "root").select(F.col("r_name").alias("root"), "path", F.substring("oid", 2, 20).cast("bigint").alias("oid"))


def _folders(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Regions as roots; nations as folders and customers as files below them."""
    nation = table(spark, sf_dir, "nation").select(_key("r", "n_regionkey").alias("parent"), F.col("n_name").alias("name"), _key("n", "n_nationkey").alias("oid"), F.lit("tree").alias("kind"))
    customer = table(spark, sf_dir, "customer").select(_key("n", "c_nationkey").alias("parent"), F.col("c_name").alias("name"), _key("c", "c_custkey").alias("oid"), F.lit("blob").alias("kind"))
    return table(spark, sf_dir, "region").select(_key("r", "r_regionkey").alias("root")), nation.union(customer)


def _hierarchy(spark, sf_dir) -> DataFrame:
    return graph.flatten_hierarchy(*_folders(spark, sf_dir))


@query("SELECT concat(n_name, '/', c_name) AS path, 'c' || c_custkey AS oid FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 11")
def path_lookup(spark, sf_dir):
    """Customer 11 by its path, walked down from the roots."""
    wanted = table(spark, sf_dir, "customer").where("c_custkey = 11").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    path = wanted.select(F.concat("n_name", F.lit("/"), "c_name")).first()[0]
    roots, entries = _folders(spark, sf_dir)
    return graph.walk_path(roots.select("root", F.col("root").alias("parent")), entries, path).select(F.lit(path).alias("path"), "oid")


@query(f"WITH {BLOBS_SQL} SELECT oid, min(path) AS path FROM blobs GROUP BY oid")
def rep_path(spark, sf_dir):
    return storage.paths_of(blobs(spark, sf_dir)).select("oid", "path")


@query("WITH p AS (SELECT DISTINCT l_suppkey AS oid, concat('o', l_orderkey, '/', l_linenumber) AS path FROM lineitem) SELECT oid, min(path) AS path, list_sort(list(path))[1:32] AS paths, count(*) AS path_count, count(*) > 32 AS truncated FROM p GROUP BY oid")
def collect_paths_capped(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("oid"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string")).alias("path"))
    return storage.paths_of(found)


# --- chains --------------------------------------------------------------------------------------

COMMITS_SQL = "commits AS (SELECT o_orderkey AS node, o_orderdate AS ts, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent, o_custkey FROM orders)"


def commits(spark, sf_dir) -> DataFrame:
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_orderdate").alias("ts"), before.alias("parent"), "o_custkey")


@query("SELECT o_orderkey AS node, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS depth FROM orders")
def chain_depth(spark, sf_dir):
    return graph.chain_depth(commits(spark, sf_dir))


@query("SELECT o_orderkey AS node, lag(o_orderkey, 3) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS ancestor FROM orders")
def nth_ancestor(spark, sf_dir):
    return graph.nth_ancestor(commits(spark, sf_dir), 3)


@query("SELECT o_orderkey AS node, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS peeled FROM orders")
def peel_chain(spark, sf_dir):
    """The end of each chain: jumps double until none moves."""
    return graph.chain_end(commits(spark, sf_dir)).select("node", F.col("end").alias("peeled"))


# --- packs ---------------------------------------------------------------------------------------

ENTRIES_SQL = "entries AS (SELECT event_type AS pack, event_id, (event_id % 5)::INT AS depth, coalesce(abs(value)::BIGINT, 0) AS logical, coalesce(abs(value)::BIGINT // 3, 0) + 1 AS physical FROM (SELECT event_type, event_id, floor(value) AS value FROM events))"


def entries(spark, sf_dir) -> DataFrame:
    value = F.coalesce(F.abs(F.floor("value")).cast("bigint"), F.lit(0))
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("pack"), "event_id", (F.col("event_id") % 5).cast("int").alias("depth"), value.alias("logical"))
    return rows.withColumn("physical", F.expr("logical div 3") + 1)


@query("SELECT event_id, lead(event_id, 1, (SELECT max(event_id) + 20 FROM events)) OVER (PARTITION BY event_type ORDER BY event_id) - event_id AS span FROM events")
def lead_span(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "event_id")
    end = rows.agg((F.max("event_id") + 20).alias("end"))
    return graph.span_to_next(rows.join(end), "event_type", "event_id", "end").select("event_id", "span")


_STATS_SQL = """stats AS (SELECT pack, count(*) AS object_count, count(*) FILTER (depth > 0) AS delta_count, coalesce(max(depth) FILTER (depth > 0), 0) AS max_delta_depth,
  coalesce(sum(depth) FILTER (depth > 0), 0)::BIGINT AS total_delta_depth, coalesce(sum(logical) FILTER (depth > 0), 0)::BIGINT AS delta_logical_bytes,
  coalesce(sum(physical) FILTER (depth > 0), 0)::BIGINT AS delta_physical_bytes, sum(physical)::BIGINT AS pack_bytes FROM entries GROUP BY pack)"""


@query(f"WITH {ENTRIES_SQL}, {_STATS_SQL} SELECT *, CASE WHEN delta_count > 0 THEN total_delta_depth / delta_count ELSE 0.0 END AS mean_delta_depth FROM stats")
def pack_stats(spark, sf_dir):
    return storage.mean_delta_depth(storage.pack_stats(entries(spark, sf_dir)))


@query(
    f"""WITH {ENTRIES_SQL}, {_STATS_SQL}, t AS (SELECT count(*) AS pack_count, sum(pack_bytes)::BIGINT AS total_bytes, sum(delta_count)::BIGINT AS total_delta_count, sum(delta_logical_bytes)::BIGINT AS total_delta_logical, sum(delta_physical_bytes)::BIGINT AS total_delta_physical,
  (SELECT pack FROM stats ORDER BY pack_bytes, pack LIMIT 1) AS smallest, min(pack_bytes) AS smallest_bytes, (SELECT pack FROM stats ORDER BY pack_bytes DESC, pack LIMIT 1) AS largest, max(pack_bytes) AS largest_bytes FROM stats)
SELECT *, CASE WHEN pack_count >= 4 AND (smallest_bytes * 4 < total_bytes OR pack_count >= 8) THEN concat(pack_count, ' packfiles, smallest ', smallest_bytes, ' bytes — consider consolidating with `git repack -ad`')
  WHEN total_delta_logical > 0 AND total_delta_physical * 2 > total_delta_logical THEN concat('delta chains store ', total_delta_physical * 100 // total_delta_logical, '% of their logical size — consider `git repack -ad --aggressive`') END AS repack_hint FROM t"""
)
def pack_summary(spark, sf_dir):
    return storage.pack_summary(storage.pack_stats(entries(spark, sf_dir)))


# --- refs ----------------------------------------------------------------------------------------


def _refs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("refs/heads/"), "n_name").alias("name"), _key("n", "n_nationkey").alias("target"), F.lit(False).alias("is_head"))


@query(
    f"WITH RECURSIVE {EDGES_SQL}, up AS (SELECT 'p7' AS node UNION SELECT src FROM up JOIN edges ON dst = node) "
    "SELECT list_sort(list(DISTINCT concat('refs/heads/', n_name))) AS retained_by FROM nation WHERE 'n' || n_nationkey IN (SELECT node FROM up)"
)
def retained_by(spark, sf_dir):
    return history.retained_by(spark.createDataFrame([("p7",)], "node string"), edges(spark, sf_dir), _refs(spark, sf_dir))


def _weights_sql(tips: str, limit: str = "") -> str:
    return f"""WITH RECURSIVE {EDGES_SQL}, tips AS ({tips}), reach AS (SELECT tip, tip AS node FROM tips UNION SELECT reach.tip, dst FROM reach JOIN edges ON src = reach.node),
sole AS (SELECT node, min(tip) AS tip FROM reach GROUP BY node HAVING count(DISTINCT tip) = 1)
SELECT substr(name, 12) AS name, name AS full_name, coalesce(sum(size), 0)::BIGINT AS unique_bytes FROM tips LEFT JOIN sole USING (tip) LEFT JOIN nodes ON nodes.node = sole.node GROUP BY name ORDER BY unique_bytes DESC, full_name {limit}"""


@query(_weights_sql("SELECT 'n' || n_nationkey AS tip, concat('refs/heads/', n_name) AS name FROM nation"))
def unique_weight_mask(spark, sf_dir):
    return history.unique_weights(_refs(spark, sf_dir), edges(spark, sf_dir), nodes(spark, sf_dir), masks=True)


@query(_weights_sql("SELECT 'c' || c_custkey AS tip, concat('refs/heads/', c_custkey) AS name FROM customer"))
def unique_weight_many(spark, sf_dir):
    refs = table(spark, sf_dir, "customer").select(F.concat(F.lit("refs/heads/"), F.col("c_custkey").cast("string")).alias("name"), _key("c", "c_custkey").alias("target"), F.lit(False).alias("is_head"))
    return history.unique_weights(refs, edges(spark, sf_dir), nodes(spark, sf_dir))


# --- duplicates ----------------------------------------------------------------------------------


def _dupes(spark, sf_dir, status=None, limit=20) -> DataFrame:
    rows = with_status(spark, sf_dir)
    rows = rows.where(F.col("status") == status) if status else rows
    copies = rows.select("oid", "logical_bytes").dropDuplicates(["oid"])
    return storage.duplicates(rows, copies, limit=limit)


def _dupes_sql(where: str = "true", limit: str = "LIMIT 20") -> str:
    return f"""WITH {BLOBS_SQL}, b AS (SELECT * FROM blobs WHERE {where}), g AS (SELECT oid, max(logical_bytes) AS size, list_sort(list(DISTINCT path)) AS ps FROM b GROUP BY oid HAVING count(DISTINCT path) > 1)
SELECT oid, size, ps[1:32] AS paths, len(ps)::BIGINT AS path_count, len(ps) > 32 AS truncated, (size * (len(ps) - 1))::BIGINT AS wasted_bytes FROM g ORDER BY wasted_bytes DESC, oid {limit}"""


@query(_dupes_sql(limit=""))
def dupes_all(spark, sf_dir):
    return _dupes(spark, sf_dir, limit=0)


@query(_dupes_sql("doc_id IN (SELECT doc_id FROM labels)"))
def dupes_current(spark, sf_dir):
    return _dupes(spark, sf_dir, "current")


@query(_dupes_sql("doc_id NOT IN (SELECT doc_id FROM labels)"))
def dupes_historical(spark, sf_dir):
    return _dupes(spark, sf_dir, "historical")


# --- history -------------------------------------------------------------------------------------

FILES_SQL = "files AS (SELECT l_orderkey AS c, l_linenumber AS path, min(l_partkey * 10000 + l_suppkey) AS blob FROM lineitem GROUP BY 1, 2)"
CANDIDATES_SQL = f"{COMMITS_SQL}, {FILES_SQL}, cand AS (SELECT k.node AS c, k.ts, f.blob FROM commits k JOIN files f ON f.c = k.node WHERE NOT EXISTS (SELECT 1 FROM files g WHERE g.c = k.parent AND g.path = f.path AND g.blob = f.blob))"


def files(spark, sf_dir) -> DataFrame:
    blob = F.min(F.col("l_partkey") * 10000 + F.col("l_suppkey")).alias("blob")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("commit"), F.col("l_linenumber").alias("path")).agg(blob)


def _commits(spark, sf_dir) -> DataFrame:
    return commits(spark, sf_dir).select(F.col("node").alias("commit"), "parent", "ts")


@query(f"WITH {CANDIDATES_SQL} SELECT c AS commit, ts, blob FROM cand")
def growth_candidates(spark, sf_dir):
    return history.growth_candidates(_commits(spark, sf_dir), files(spark, sf_dir))


_GROWTH_SQL = f"""WITH {CANDIDATES_SQL}, first AS (SELECT blob, min(ts) AS ts FROM cand GROUP BY blob),
m AS (SELECT strftime(f.ts, '%Y-%m') AS month, sum(p_size) AS b FROM first f JOIN part ON p_partkey = blob // 10000 GROUP BY 1),
e AS (SELECT DISTINCT strftime(ts, '%Y-%m') AS month FROM commits),
o AS (SELECT month, coalesce(b, 0)::BIGINT AS introduced_bytes FROM e LEFT JOIN m USING (month))
SELECT month, introduced_bytes, (sum(introduced_bytes) OVER (ORDER BY month))::BIGINT AS cumulative_bytes FROM o"""


def _blob_sizes(spark, sf_dir, found: DataFrame) -> DataFrame:
    size = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("bigint").alias("size"))
    return found.select("blob").distinct().join(size, F.expr("blob div 10000") == F.col("p_partkey")).select("blob", "size")


def _growth(spark, sf_dir, last=None) -> DataFrame:
    found = files(spark, sf_dir)
    return history.growth_by_month(_commits(spark, sf_dir), found, _blob_sizes(spark, sf_dir, found), lambda ts: F.date_format(ts, "yyyy-MM"), last)


@query(f"WITH {CANDIDATES_SQL}, first AS (SELECT blob, arg_min(c, (ts, c)) AS c FROM cand GROUP BY blob) SELECT c AS commit, count(*) AS blobs, sum(p_size)::BIGINT AS introduced_bytes FROM first JOIN part ON p_partkey = blob // 10000 GROUP BY c")
def commit_contribution(spark, sf_dir):
    found = files(spark, sf_dir)
    return history.commit_contribution(_commits(spark, sf_dir), found, _blob_sizes(spark, sf_dir, found))


@query(_GROWTH_SQL)
def growth_by_month(spark, sf_dir):
    return _growth(spark, sf_dir)


@query(f"{_GROWTH_SQL} QUALIFY row_number() OVER (ORDER BY month DESC) <= 6")
def growth_last_n(spark, sf_dir):
    return _growth(spark, sf_dir, 6)


@query("SELECT o_orderkey AS commit, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1 AND l_partkey = 7) AS present FROM orders")
def presence_by_version(spark, sf_dir):
    """Which orders, as versions whose lines are their files, have part 7 on line 1."""
    versions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit"), F.col("o_orderkey").alias("tree"))
    entries = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").cast("string").alias("name"), F.col("l_partkey").alias("oid"), F.lit("blob").alias("kind"))
    have = graph.holders(versions, entries, "1", F.lit(7)).select("commit", F.lit(True).alias("present"))
    return versions.join(have, "commit", "left").select("commit", F.coalesce("present", F.lit(False)).alias("present"))


_PRESENCE_SQL = "SELECT DISTINCT l_partkey AS object, l_orderkey AS commit FROM lineitem"


@query(
    f"""WITH {COMMITS_SQL}, has AS ({_PRESENCE_SQL}), present AS (SELECT object, node AS commit, ts, parent FROM has JOIN commits ON node = has.commit),
i AS (SELECT p.object, arg_min(p.commit, (p.ts, p.commit)) AS introduced FROM present p WHERE NOT EXISTS (SELECT 1 FROM has h WHERE h.object = p.object AND h.commit = p.parent) GROUP BY 1),
d AS (SELECT h.object, arg_min(k.node, (k.ts, k.node)) AS deleted FROM has h JOIN commits k ON k.parent = h.commit WHERE NOT EXISTS (SELECT 1 FROM has g WHERE g.object = h.object AND g.commit = k.node) GROUP BY 1)
SELECT o.object, introduced, CASE WHEN o.object % 3 <> 0 THEN deleted END AS deleted FROM (SELECT DISTINCT object FROM has) o LEFT JOIN i USING (object) LEFT JOIN d USING (object)"""
)
def introduced_deleted(spark, sf_dir):
    has = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("object"), F.col("l_orderkey").alias("commit")).distinct()
    known = _commits(spark, sf_dir)
    return history.introduced_deleted(has.join(known.select("commit", "ts"), "commit"), known, has.where("object % 3 = 0").select("object"))


# snapshots: every lineitem has its own path on both sides; open ones move, accepted ones have another blob
_OLD_FILES = "SELECT concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate::DATE) AS path, l_partkey AS blob FROM lineitem"
_NEW_FILES = "SELECT concat(CASE WHEN l_linestatus = 'O' THEN 'm/' ELSE '' END, concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate::DATE)) AS path, CASE WHEN l_returnflag = 'A' THEN -l_suppkey ELSE l_partkey END AS blob FROM lineitem"


def _snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "lineitem")
    path = F.concat_ws("/", *(F.col(f"l_{c}").cast("string") for c in ("orderkey", "linenumber", "partkey", "suppkey")), F.col("l_shipdate").cast("date").cast("string"))
    moved = F.concat(F.when(F.col("l_linestatus") == "O", "m/").otherwise(""), path)
    blob = F.when(F.col("l_returnflag") == "A", -F.col("l_suppkey")).otherwise(F.col("l_partkey"))
    return rows.select(path.alias("path"), F.col("l_partkey").alias("blob")), rows.select(moved.alias("path"), blob.alias("blob"))


@query(f"SELECT coalesce(a.path, b.path) AS path, a.blob AS old, b.blob AS new FROM ({_OLD_FILES}) a FULL JOIN ({_NEW_FILES}) b ON a.path = b.path WHERE a.blob IS DISTINCT FROM b.blob")
def snapshot_diff(spark, sf_dir):
    return history.snapshot_diff(*_snapshots(spark, sf_dir))


@query(f"SELECT a.path, a.blob AS base, b.blob AS to, a.blob IS DISTINCT FROM b.blob AS changed FROM (SELECT * FROM ({_OLD_FILES}) WHERE path = (SELECT max(path) FROM ({_NEW_FILES}) WHERE blob < 0 AND path NOT LIKE 'm/%')) a LEFT JOIN ({_NEW_FILES}) b ON a.path = b.path")
def changed_flag(spark, sf_dir):
    """Whether one path changed: the last one of the accepted files that stayed in place."""
    old, new = _snapshots(spark, sf_dir)
    path = new.where("blob < 0 AND NOT startswith(path, 'm/')").agg(F.max("path")).first()[0]
    return history.changed_flag(old, new, path)


# --- scores --------------------------------------------------------------------------------------


def _half_lines(spark, sf_dir, half: int) -> DataFrame:
    """Lines of all documents with even ids, or with odd ones."""
    rows = table(spark, sf_dir, "documents").where(F.col("doc_id") % 2 == half)
    return rows.select(F.explode(lines.lines_of(F.coalesce("text", F.lit("")))).alias("line")).where("line <> ''")


_HALF_LINES_SQL = "SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents WHERE doc_id % 2 = {}"


@query(
    f"WITH a AS (SELECT line, count(*) AS n FROM ({_HALF_LINES_SQL.format(0)}) WHERE line <> '' GROUP BY 1), b AS (SELECT line, count(*) AS n FROM ({_HALF_LINES_SQL.format(1)}) WHERE line <> '' GROUP BY 1), "
    "j AS (SELECT coalesce(a.line, b.line) AS line, greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0) AS added, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) AS removed FROM a FULL JOIN b ON a.line = b.line) SELECT line, added, removed FROM j WHERE added > 0 OR removed > 0"
)
def multiset_diff(spark, sf_dir):
    return history.multiset_diff(_half_lines(spark, sf_dir, 0), _half_lines(spark, sf_dir, 1), ["line"])


# SQL and Terraform texts, put before each document's text
_SQL_TEXT = (
    "CREATE TABLE a (b int REFERENCES c); -- create view v", "create or replace view v as with x as (select 'it''s join' from t join u) select * from x union all select 1", "/* create table z */ CREATE UNIQUE INDEX i ON t(a);",
    "create function f() returns trigger; create trigger g", "CREATE TEMP PROCEDURE p; with y as (select 1) /*/ x */ select \"join\" from y", "with; create with; table",
)
_SQL_LIT = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in _SQL_TEXT) + "]"


def _sql_docs(spark, sf_dir) -> DataFrame:
    head = F.element_at(F.array(*map(F.lit, _SQL_TEXT)), (F.col("doc_id") % len(_SQL_TEXT) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("db/"), F.col("doc_id").cast("string"), F.lit(".sql")).alias("path"), F.concat_ws("\n", head, F.coalesce("text", F.lit(""))).alias("text"))


# DuckDB's regular expressions have no lookahead; the texts hold no unclosed comment or quote before prose
_TOKENS_SQL = (
    f"""docs AS (SELECT doc_id, concat_ws(chr(10), {_SQL_LIT}[(doc_id % {len(_SQL_TEXT)})::INT + 1], coalesce(text, '')) AS t FROM documents),
clean AS (SELECT doc_id, translate(regexp_replace(t, '--[^\\n]*|/\\*/[\\s\\S]*?\\*/|/\\*/|/\\*[\\s\\S]*?(\\*/|\\z)|''(''''|[^''])*''?|"(""|[^"])*"?', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM docs),"""
    """toks AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '[ \\t\\r\\n(){};,.\\[\\]]+'), lambda x: x <> '') AS w FROM clean),
tok AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS i FROM toks),
win AS (SELECT *, lag(t, 1) OVER o = 'create' AS c1, coalesce(lag(t, 1) OVER o = 'create', false) OR coalesce(lag(t, 2) OVER o = 'create', false) OR coalesce(lag(t, 3) OVER o = 'create', false) OR coalesce(lag(t, 4) OVER o = 'create', false) AS ddl FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY i))"""
).replace("/\\*/[\\s\\S]*?\\*/|/\\*/|", "/\\*/|")
_COUNTS_SQL = ", ".join(
    [f"count(*) FILTER (t = '{w}' AND ddl) AS {n}" for n, w in constructs.CREATED.items()] + [f"count(*) FILTER (t = '{w}') AS {n}" for n, w in constructs.PLAIN.items()] + ["count(*) FILTER (t = 'with' AND NOT coalesce(c1, false)) AS sql_ctes"]
)


@query(f"WITH {_TOKENS_SQL} SELECT doc_id, {_COUNTS_SQL} FROM win GROUP BY doc_id")
def sql_construct_counts(spark, sf_dir):
    return scoring.with_constructs(_sql_docs(spark, sf_dir)).select("doc_id", *constructs.SQL)


@query(f"WITH {_TOKENS_SQL}, n AS (SELECT doc_id, {_COUNTS_SQL} FROM win GROUP BY doc_id) SELECT doc_id, " + " + ".join(f"{constructs.POINTS[c]} * {c}" for c in constructs.SQL) + " AS points FROM n")
def domain_points(spark, sf_dir):
    return scoring.with_constructs(_sql_docs(spark, sf_dir)).select("doc_id", scoring.weighted(constructs.POINTS).alias("points"))


_TF_TEXT = (
    'resource "a" "b" {\n  count = 2\n  x = y ? 1 : 2\n}\n# resource "c" {',
    '/* resource "a" {\n*/ module "m" {\n  for_each = z /* c */ ? d\n  depends_on = [q]\n}',
    'data "x" "y" {} /* open\nresource "n" {\n*/\nprovider "p" {\n  dynamic "d" {\n//data "z"\n',
)


_FILE_SQL = f"""{LINES_SQL},
f AS (SELECT doc_id, path, source, {_EXCLUDED_SQL} AS ex, {_SOURCE_SQL} AS src, {_MANIFEST_SQL} AS man, {_UI_SQL} AS ui, ends_with(path, '.tf') AS tf, ends_with(path, '.sql') AS sq FROM code),
l AS (SELECT c.doc_id, c.line, NOT f.tf AND NOT f.sq AS plain FROM code_lines c JOIN f USING (doc_id) WHERE NOT ex AND src),
s AS (SELECT doc_id, count(*) FILTER ({_FILLED_SQL}) AS source_lines, count(*) FILTER ({_FILLED_SQL} AND {_BRANCH_SQL}) AS branch_lines,
  count(DISTINCT CASE WHEN plain AND {_LOCAL_SQL} THEN line END) AS internal_imports, count(DISTINCT CASE WHEN plain THEN {_HOST_SQL} END) AS external_host_references,
  coalesce(max((plain AND {_CRYPTO_SQL})::BIGINT), 0) AS crypto_files, coalesce(max((plain AND {_ALGORITHM_SQL})::BIGINT), 0) AS algorithm_files FROM l GROUP BY doc_id)"""


@query(f"WITH {_FILE_SQL} SELECT * FROM s")
def complexity_metrics(spark, sf_dir):
    path = F.col("path")
    wanted = code_docs(spark, sf_dir).where(~paths.is_excluded(path) & paths.is_source(path))
    return scoring.file_signals(wanted, keys=("doc_id", "path")).drop("path")


# Prose that follows code lines holds few SQL words; those of .sql paths are counted as in sql_construct_counts
_SCORE_SQL = f"""WITH {_FILE_SQL},
dtok AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(translate(regexp_replace(text, '--[^\\n]*|/\\*[\\s\\S]*?(\\*/|\\z)|''(''''|[^''])*''?|"(""|[^"])*"?', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\r\\n(){{}};,.\\[\\]]+'), lambda x: x <> '') AS w FROM code JOIN f USING (doc_id) WHERE sq AND NOT ex)),
dwin AS (SELECT *, lag(t, 1) OVER o = 'create' AS c1, coalesce(lag(t, 1) OVER o = 'create', false) OR coalesce(lag(t, 2) OVER o = 'create', false) OR coalesce(lag(t, 3) OVER o = 'create', false) OR coalesce(lag(t, 4) OVER o = 'create', false) AS ddl FROM dtok WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
dcnt AS (SELECT doc_id, {_COUNTS_SQL} FROM dwin GROUP BY doc_id),
t AS (SELECT source, count(*) FILTER (ex OR NOT src) AS excluded_files, count(*) FILTER (NOT ex AND man) AS dependency_manifests, count(*) FILTER (NOT ex AND src) AS source_files,
  count(*) FILTER (NOT ex AND src AND ui) AS ui_components, {", ".join(f"coalesce(sum({c}), 0)::BIGINT AS {c}" for c in ("source_lines", "branch_lines", "internal_imports", "external_host_references", "crypto_files", "algorithm_files"))},
  coalesce(sum({" + ".join(f"{constructs.POINTS[c]} * {c}" for c in constructs.SQL)}), 0)::BIGINT AS domain_points
  FROM f LEFT JOIN s USING (doc_id) LEFT JOIN dcnt USING (doc_id) GROUP BY source),
p AS (SELECT *, source_lines AS size_points, (4 * branch_lines + 3 * source_files + 6 * internal_imports + 12 * external_host_references + 4 * dependency_manifests + 6 * ui_components + 10 * crypto_files + 8 * algorithm_files)::BIGINT AS structural_points FROM t),
q AS (SELECT *, (size_points + structural_points + domain_points)::BIGINT AS total_points FROM p)"""
_SCORE_COLUMNS = ("source_files", "source_lines", "branch_lines", "internal_imports", "external_host_references", "dependency_manifests", "ui_components", "crypto_files", "algorithm_files", "excluded_files", "size_points", "structural_points", "domain_points", "total_points")


@query(f"{_SCORE_SQL} SELECT source, {', '.join(_SCORE_COLUMNS)}, CASE WHEN source_lines > 0 THEN (total_points * 1000 + source_lines // 2) // source_lines ELSE 0 END::BIGINT AS points_per_kloc FROM q")
def complexity_score(spark, sf_dir):
    return scoring.complexity_by(code_docs(spark, sf_dir), "source").select("source", *_SCORE_COLUMNS, "points_per_kloc")


@query(
    f"{_SCORE_SQL} SELECT b.total_points, b.size_points, b.structural_points, b.domain_points, ".replace("code AS (SELECT doc_id, source,", "code AS (SELECT doc_id, doc_id % 2 AS source,")
    + ", ".join(f"a.{n} AS base_{n}, b.{n} - a.{n} AS delta_{n}" for n in ("total_points", "size_points", "structural_points", "domain_points"))
    + " FROM q a, q b WHERE a.source = 0 AND b.source = 1"
)
def complexity_delta(spark, sf_dir):
    """All documents: those with even ids are the base, those with odd ones the other snapshot."""
    docs = code_docs(spark, sf_dir)
    return scoring.complexity_delta(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"))


# every document as a go.mod file: lines that name a module, or nearly, with the document's source, then its text
_GO_HEADS = ("module example.com/{}\ngo 1.20\n", "// x\n \tmodule  b/{} \r\n", "go 1.20 {}\n", "module \nmodule d{}\nmodule e\n", "xmodule {}\n")


@query(
    f"""WITH d AS (SELECT doc_id, concat(replace([{', '.join("'" + h + "'" for h in _GO_HEADS)}][(doc_id % {len(_GO_HEADS)})::INT + 1], '{{}}', coalesce(source, '')), coalesce(text, '')) AS t FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS i FROM d),
m AS (SELECT doc_id, i, trim(substr(x, 8), ' ' || chr(9) || chr(13)) AS name FROM (SELECT doc_id, i, ltrim(line, ' ' || chr(9) || chr(13)) AS x FROM l) WHERE starts_with(x, 'module '))
SELECT doc_id, (SELECT arg_min(concat(name, '/'), i) FROM m WHERE m.doc_id = d.doc_id AND name <> '') AS prefix FROM d"""
)
def complexity_go_prefix(spark, sf_dir):
    head = F.element_at(F.array(*map(F.lit, _GO_HEADS)), (F.col("doc_id") % len(_GO_HEADS) + 1).cast("int"))
    text = F.concat(F.replace(head, F.lit("{}"), F.coalesce("source", F.lit(""))), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", scoring.go_module_prefix(text).alias("prefix"))


# from the changed files on; ``a`` and ``b`` are the two sides
_CHANGE_SQL = f"""ch0 AS (SELECT coalesce(a.path, b.path) AS path, a.text AS old_text, b.text AS new_text, a.path IS NULL AS is_new FROM a FULL JOIN b ON a.path = b.path WHERE a.text IS DISTINCT FROM b.text),
ch AS (SELECT *, {_SOURCE_SQL} AND NOT {_EXCLUDED_SQL} AS scored, {_MANIFEST_SQL} AS man, {_UI_SQL} AS ui, ends_with(path, '.tf') OR ends_with(path, '.sql') AS dom FROM ch0),
ol AS (SELECT path, line, count(*) AS n FROM (SELECT path, unnest(string_split(coalesce(old_text, ''), chr(10))) AS line FROM ch WHERE scored) WHERE line <> '' GROUP BY ALL),
nl AS (SELECT path, line, count(*) AS n FROM (SELECT path, unnest(string_split(coalesce(new_text, ''), chr(10))) AS line FROM ch WHERE scored) WHERE line <> '' GROUP BY ALL),
df AS (SELECT coalesce(o.path, w.path) AS path, coalesce(o.line, w.line) AS line, greatest(coalesce(w.n, 0) - coalesce(o.n, 0), 0) AS added, greatest(coalesce(o.n, 0) - coalesce(w.n, 0), 0) AS removed FROM ol o FULL JOIN nl w ON o.path = w.path AND o.line = w.line),
ad AS (SELECT df.*, NOT dom AS plain FROM df JOIN ch USING (path)),
sg AS (SELECT coalesce(sum(added), 0)::BIGINT AS added_lines, coalesce(sum(removed), 0)::BIGINT AS removed_lines, coalesce(sum(added) FILTER ({_BRANCH_SQL}), 0)::BIGINT AS added_branches,
  count(DISTINCT CASE WHEN plain AND added > 0 AND {_CHANGE_LOCAL_SQL} THEN line END) AS internal_imports, coalesce(sum(added) FILTER (plain AND {_IMPORT_SQL} AND {_sql_any("contains(line, '{}')", paths.UI_FOLDERS)}), 0)::BIGINT AS reused_ui_components,
  count(DISTINCT CASE WHEN plain AND added > 0 THEN {_HOST_SQL} END) AS external_integrations, count(DISTINCT CASE WHEN plain AND added > 0 AND {_CRYPTO_SQL} THEN path END) AS crypto_signals,
  count(DISTINCT CASE WHEN plain AND added > 0 AND {_ALGORITHM_SQL} THEN path END) AS algorithm_signals FROM ad),
ct AS (SELECT count(*) AS files, count(*) FILTER (man) AS dependency_changes, count(*) FILTER (ui AND is_new) AS new_ui_components, count(*) FILTER (ui AND NOT is_new) AS changed_shared_ui_components, count(*) FILTER (NOT scored) AS excluded_files FROM ch)"""
_SIGNALS = ("files", "excluded_files", "added_lines", "removed_lines", "added_branches", "dependency_changes", "new_ui_components", "changed_shared_ui_components", "internal_imports", "reused_ui_components", "external_integrations", "crypto_signals", "algorithm_signals")


_WITHOUT_DOMAIN = " + ".join(f"{w} * {c}" for c, w in scoring.CHANGE_POINTS.items())


# a change: both sides hold every document under its own path; on the new side most texts are edited, some paths moved
_EDITS = ('import { B } from "./components/B";\nif (x) { verify(sha256(y)) }', 'fetch("https://api.example.org/v1")\nfor (;;) {}', 'import x from "../lib/x"\nwhile (a) { sort(b) }')
_SQL_EDIT = "create table a (b int references c);\nwith x as (select 1) select * from t join u union all select 2"
_TF_EDIT = 'resource "a" "b" {\n  count = 2\n  x = y ? 1 : 2\n}'
_quoted = lambda text: "'" + text.replace("'", "''") + "'"


def _whole_change(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = code_docs(spark, sf_dir)
    path, number = F.col("path"), F.col("doc_id")
    edit = F.element_at(F.array(*map(F.lit, _EDITS)), (number % len(_EDITS) + 1).cast("int"))
    edit = F.when(path.endswith(".sql"), _SQL_EDIT).when(path.endswith(".tf"), _TF_EDIT).otherwise(edit)
    moved = F.when(number % 7 == 0, F.concat(F.lit("m/"), path)).otherwise(path)
    new = docs.select(moved.alias("path"), F.when(number % 4 == 0, F.col("text")).otherwise(F.concat_ws("\n", edit, "text")).alias("text"))
    return docs.select("path", "text"), new


def _terraform_sql(texts: str) -> str:
    """CTEs from ``texts(k, t)`` to ``tfn(k, counts...)``; a line's comment state is that after the last line that fixes it."""
    opens = lambda x: f"(instr({x}, '/*') > 0 AND instr(substr({x}, instr({x}, '/*') + 2), '*/') = 0)"
    word = lambda w: f"""regexp_matches(x, '^{w}($|[ \\t\\n\\x0b\\f\\r"{{])')"""
    tests = [word(w) for w in constructs.BLOCKS.values()] + ["regexp_matches(x, '^(for_each|count)[ \\t]*=')", "regexp_matches(x, '^depends_on[ \\t]*=')", "contains(x, ' ? ')"]
    counts = ", ".join(f"count(*) FILTER (live AND {test}) AS {name}" for name, test in zip(constructs.TERRAFORM, tests, strict=True))
    return f"""tl AS (SELECT k, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS i FROM {texts}),
tg AS (SELECT *, {opens('line')} AS s0, instr(line, '*/') = 0 OR {opens("substr(line, instr(line, '*/') + 2)")} AS s1 FROM tl),
tb AS (SELECT *, coalesce(last_value(CASE WHEN s0 = s1 THEN s0 END IGNORE NULLS) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS was_open FROM tg),
tv AS (SELECT k, CASE WHEN NOT was_open THEN line WHEN instr(line, '*/') > 0 THEN substr(line, instr(line, '*/') + 2) ELSE '' END AS seen FROM tb),
tw AS (SELECT k, trim(CASE WHEN instr(seen, '/*') > 0 THEN left(seen, instr(seen, '/*') - 1) ELSE seen END, ' ' || chr(9) || chr(13)) AS x FROM tv),
tfn AS (SELECT k, {counts} FROM (SELECT *, NOT starts_with(x, '#') AND NOT starts_with(x, '//') AS live FROM tw) GROUP BY k)"""


_EDIT_SQL = f"CASE WHEN ends_with(path, '.sql') THEN {_quoted(_SQL_EDIT)} WHEN ends_with(path, '.tf') THEN {_quoted(_TF_EDIT)} ELSE [{', '.join(map(_quoted, _EDITS))}][(doc_id % {len(_EDITS)})::INT + 1] END"
_WHOLE_CHANGE_SQL = f"""WITH {CODE_SQL}, a AS (SELECT path, text FROM code),
b AS (SELECT CASE WHEN doc_id % 7 = 0 THEN concat('m/', path) ELSE path END AS path, CASE WHEN doc_id % 4 = 0 THEN text ELSE concat_ws(chr(10), {_EDIT_SQL}, text) END AS text FROM code),
{_CHANGE_SQL},
dx AS (SELECT concat(side, path) AS k, path, side, t FROM (SELECT path, 'o' AS side, coalesce(old_text, '') AS t FROM ch WHERE scored AND dom UNION ALL SELECT path, 'n', coalesce(new_text, '') FROM ch WHERE scored AND dom)),
tx AS (SELECT k, t FROM dx WHERE ends_with(path, '.tf')), {_terraform_sql('tx')},
dtok AS (SELECT k, unnest(w) AS t, unnest(range(len(w))) AS i FROM (SELECT k, list_filter(regexp_split_to_array(translate(regexp_replace(t, '--[^\\n]*|/\\*[\\s\\S]*?(\\*/|\\z)|''(''''|[^''])*''?|"(""|[^"])*"?', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\r\\n(){{}};,.\\[\\]]+'), lambda x: x <> '') AS w FROM dx WHERE ends_with(path, '.sql'))),
dwin AS (SELECT *, lag(t, 1) OVER o = 'create' AS c1, coalesce(lag(t, 1) OVER o = 'create', false) OR coalesce(lag(t, 2) OVER o = 'create', false) OR coalesce(lag(t, 3) OVER o = 'create', false) OR coalesce(lag(t, 4) OVER o = 'create', false) AS ddl FROM dtok WINDOW o AS (PARTITION BY k ORDER BY i)),
dcnt AS (SELECT k, {_COUNTS_SQL} FROM dwin GROUP BY k),
dall AS (SELECT path, side, {", ".join(f"coalesce({c}, 0) AS {c}" for c in constructs.POINTS)} FROM dx LEFT JOIN tfn USING (k) LEFT JOIN dcnt USING (k)),
gr AS (SELECT w.path, {", ".join(f"greatest(w.{c} - o.{c}, 0) AS {c}" for c in constructs.POINTS)} FROM dall w JOIN dall o ON w.path = o.path AND w.side = 'n' AND o.side = 'o'),
dp AS (SELECT path, {" + ".join(f"{w} * {c}" for c, w in constructs.POINTS.items())} AS points FROM gr)"""


@query(f"{_WHOLE_CHANGE_SQL} SELECT {', '.join(_SIGNALS)} FROM sg, ct")
def pr_signals(spark, sf_dir):
    return scoring.change_score(*_whole_change(spark, sf_dir)).select(*_SIGNALS)


@query(
    f"""{_WHOLE_CHANGE_SQL}, s AS (SELECT (added_lines + removed_lines + 4 * added_branches + 3 * (files - excluded_files))::BIGINT AS work_points, ({_WITHOUT_DOMAIN})::BIGINT AS plain_points, (SELECT coalesce(sum(points), 0) FROM dp)::BIGINT AS domain_points FROM sg, ct)
SELECT work_points, domain_points, plain_points + domain_points AS complexity_points, work_points + plain_points + domain_points AS total_points FROM s"""
)
def pr_score(spark, sf_dir):
    return scoring.change_score(*_whole_change(spark, sf_dir)).select("work_points", "domain_points", "complexity_points", "total_points")


_EVIDENCE_SQL = f"""{_WHOLE_CHANGE_SQL}, ev AS (
  SELECT 'dependency_manifest' AS dimension, path, '' AS line FROM ch WHERE man UNION ALL SELECT 'new_ui_component', path, '' FROM ch WHERE ui AND is_new UNION ALL SELECT 'shared_ui_component', path, '' FROM ch WHERE ui AND NOT is_new UNION ALL
  SELECT 'internal_import', min(path), line FROM ad WHERE plain AND added > 0 AND {_CHANGE_LOCAL_SQL} GROUP BY line UNION ALL
  SELECT 'ui_reuse', path, line FROM (SELECT path, line, unnest(range(added)) FROM ad WHERE plain AND {_IMPORT_SQL} AND {_sql_any("contains(line, '{}')", paths.UI_FOLDERS)}) UNION ALL
  SELECT 'external_endpoint', x.path, x.line FROM (SELECT min((path, line)) AS m FROM ad WHERE plain AND added > 0 AND {_HOST_SQL} IS NOT NULL GROUP BY {_HOST_SQL}), LATERAL (SELECT m[1] AS path, m[2] AS line) x UNION ALL
  SELECT 'crypto', path, min(line) FROM ad WHERE plain AND added > 0 AND {_CRYPTO_SQL} GROUP BY path UNION ALL SELECT 'algorithm', path, min(line) FROM ad WHERE plain AND added > 0 AND {_ALGORITHM_SQL} GROUP BY path UNION ALL
  SELECT CASE WHEN ends_with(path, '.tf') THEN 'terraform' ELSE 'sql' END, path, '' FROM dp WHERE points > 0)"""
_DETAIL_SQL = "CASE dimension " + " ".join(f"WHEN '{dimension}' THEN '{detail}'" for dimension, detail in scoring.EVIDENCE.items()) + " END AS detail"


@query(f"{_EVIDENCE_SQL} SELECT dimension, path, {_DETAIL_SQL} FROM (SELECT * FROM ev ORDER BY path, dimension, line LIMIT {scoring.EVIDENCE_LIMIT})")
def evidence_cap(spark, sf_dir):
    """The first ones, as many as a report lists."""
    return scoring.change_evidence(*_whole_change(spark, sf_dir))


@query(f"{_EVIDENCE_SQL} SELECT dimension, path, {_DETAIL_SQL} FROM ev")
def evidence_all(spark, sf_dir):
    return scoring.change_evidence(*_whole_change(spark, sf_dir), limit=None)


@query(f"WITH tx AS (SELECT doc_id AS k, concat_ws(chr(10), [{', '.join(map(_quoted, _TF_TEXT))}][(doc_id % {len(_TF_TEXT)})::INT + 1], coalesce(text, '')) AS t FROM documents), {_terraform_sql('tx')} SELECT k AS doc_id, {', '.join(constructs.TERRAFORM)} FROM tfn")
def terraform_counts(spark, sf_dir):
    head = F.element_at(F.array(*map(F.lit, _TF_TEXT)), (F.col("doc_id") % len(_TF_TEXT) + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".tf")).alias("path"), F.concat_ws("\n", head, F.coalesce("text", F.lit(""))).alias("text"))
    return scoring.with_constructs(docs).select("doc_id", *constructs.TERRAFORM)


# change records from all events: valid ones, and ones that are wrong in each way; line 1 is a header
_RECORD_SQL = """[concat('pr', event_id, chr(9), ts::DATE, chr(9), 'pre', chr(9), 'main', chr(9), event_type), concat('# ', event_type), '', concat(event_id, chr(9), 't', chr(9), event_type, chr(9), 'main', chr(9), 'dev'),
  concat(event_id, chr(9), 't', chr(9), 'post', chr(9), 'main'), concat(event_id, chr(9), 't', chr(9), 'post', chr(9), 'main', chr(9), 'dev', chr(9), 'x'), concat(chr(9), 't', chr(9), 'post', chr(9), 'main', chr(9), 'dev'), concat(' ', event_id, chr(9), 't', chr(9), 'post', chr(9), 'main', chr(9), 'dev', chr(13))][(event_id % 8)::INT + 1]"""


@query(
    f"""WITH r AS (SELECT event_id + 2 AS line_no, {_RECORD_SQL} AS line FROM events UNION ALL SELECT 1, concat_ws(chr(9), 'pr_id', 'merged_at', 'stage', 'base', 'to')),
t AS (SELECT line_no, string_split(trim(line, ' ' || chr(13)), chr(9)) AS c FROM r WHERE trim(line, ' ' || chr(13)) <> '' AND NOT starts_with(trim(line, ' ' || chr(13)), '#'))
SELECT line_no, c[1] AS pr_id, c[3] AS stage, CASE WHEN len(c) < 5 THEN 'needs five tab-separated columns' WHEN len(c) > 5 OR c[1] = '' OR c[2] = '' OR c[4] = '' OR c[5] = '' THEN 'invalid record' WHEN c[3] NOT IN ('pre', 'post') THEN 'stage must be pre or post' END AS problem
FROM t WHERE NOT (line_no = 1 AND c[1] = 'pr_id' AND len(c) = 5)"""
)
def tsv_batch_validate(spark, sf_dir):
    number, day = F.col("event_id").cast("string"), F.col("ts").cast("date").cast("string")
    row = lambda *parts: F.concat_ws("\t", *(F.lit(x) if isinstance(x, str) else x for x in parts))
    texts = [
        row(F.concat(F.lit("pr"), number), day, "pre", "main", F.col("event_type")), F.concat(F.lit("# "), "event_type"), F.lit(""), row(number, "t", F.col("event_type"), "main", "dev"),
        row(number, "t", "post", "main"), row(number, "t", "post", "main", "dev", "x"), row("", "t", "post", "main", "dev"), F.concat(F.lit(" "), row(number, "t", "post", "main", "dev"), F.lit("\r")),
    ]
    rows = table(spark, sf_dir, "events").select((F.col("event_id") + 2).alias("line_no"), F.element_at(F.array(*texts), (F.col("event_id") % len(texts) + 1).cast("int")).alias("line"))
    head = spark.createDataFrame([(1, "\t".join(scoring.RECORD_COLUMNS))], "line_no bigint, line string")
    return scoring.change_records(rows.union(head)).select("line_no", "pr_id", "stage", "problem")


# --- reports -------------------------------------------------------------------------------------

_FIX_SQL = f"""fix AS (SELECT doc_id, concat(path, CASE WHEN doc_id % 5 = 0 THEN '''s.sql' ELSE '' END) AS path, logical_bytes AS size, source <> 'src3' AS reachable, doc_id IN (SELECT doc_id FROM labels) AS head FROM blobs),
verdict AS (SELECT *, CASE WHEN NOT reachable THEN 'gc' WHEN NOT head THEN 'history_rewrite' ELSE 'none' END AS verdict, '''' || replace(path, '''', '''\\''''') || '''' AS quoted, regexp_extract(path, '[^/]*$') AS base, {_EXT_SQL} AS ext FROM fix)"""


@query(
    f"""WITH {BLOBS_SQL}, {_FIX_SQL} SELECT doc_id, verdict, CASE verdict WHEN 'gc' THEN '{history.GC_COMMAND}' WHEN 'history_rewrite' THEN 'git filter-repo --invert-paths --path ' || quoted || ' ; bfg --delete-files ' || base ELSE '' END AS commands,
CASE WHEN verdict = 'history_rewrite' THEN '{history.CAVEAT}' END AS caveat, CASE WHEN verdict = 'none' AND {_LFS_SQL} THEN '*.' || ext END AS lfs_pattern FROM verdict"""
)
def remediation(spark, sf_dir):
    rows = with_status(spark, sf_dir)
    path = F.when(F.col("doc_id") % 5 == 0, F.concat("path", F.lit("'s.sql"))).otherwise(F.col("path"))
    rows = rows.withColumns({"type": F.lit("blob"), "path": path, "reachable": F.col("source") != "src3", "reachable_from_head": F.col("status") == "current"})
    return history.remediation(rows).select("doc_id", "verdict", F.array_join("commands", " ; ").alias("commands"), "caveat", "lfs_pattern")


_LIMITS = {"historical_bytes": 10**6, "unreachable_bytes": 10**9, "unreachable_count": 10}


@query(f"WITH scan AS ({_SCAN_SQL}) " + " UNION ALL ".join(f"SELECT '{n}' AS name, {n}::BIGINT AS actual, {m}::BIGINT AS limit, {n} <= {m} AS ok FROM scan" for n, m in _LIMITS.items()))
def check_thresholds(spark, sf_dir):
    return storage.check_thresholds(full_scan(spark, sf_dir), _LIMITS)


@query(
    f"""WITH {BLOBS_SQL}, w AS (SELECT oid FROM blobs WHERE doc_id = 3), c AS (SELECT * FROM blobs WHERE oid = (SELECT oid FROM w)) SELECT oid, max(logical_bytes) AS logical_bytes, min(path) AS path, count(DISTINCT path) AS path_count, bool_or(doc_id IN (SELECT doc_id FROM labels)) AS at_head,
(SELECT list_sort(list(DISTINCT concat('refs/heads/', source))) FROM c) AS retained_by FROM c GROUP BY oid"""
)
def explain_report(spark, sf_dir):
    rows = with_status(spark, sf_dir)
    wanted = rows.where("doc_id = 3").select("oid").distinct()
    own = rows.join(wanted, "oid", "left_semi")
    links = rows.select(_key("s", "source").alias("src"), F.col("oid").alias("dst")).distinct()
    refs = rows.select(F.concat(F.lit("refs/heads/"), "source").alias("name"), _key("s", "source").alias("target"), F.lit(False).alias("is_head")).distinct()
    kept = history.retained_by(wanted.withColumnRenamed("oid", "node"), links, refs)
    facts = own.groupBy("oid").agg(F.max("logical_bytes").alias("logical_bytes"), F.min("path").alias("path"), F.count_distinct("path").alias("path_count"), F.bool_or(F.col("status") == "current").alias("at_head"))
    return facts.join(kept)
