"""Complexity of snapshots and of changes, from (path, text) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.functions import constructs, lines, paths
from storelens.operators.history import multiset_diff

SNAPSHOT_VERSION, CHANGE_VERSION = "complexity-2", "pr-2"
EVIDENCE_LIMIT = 64
# Points of each signal in a snapshot, and in a change.
SNAPSHOT_POINTS = {"branch_lines": 4, "source_files": 3, "internal_imports": 6, "external_host_references": 12, "dependency_manifests": 4, "ui_components": 6, "crypto_files": 10, "algorithm_files": 8}
CHANGE_POINTS = {"internal_imports": 6, "external_integrations": 12, "dependency_changes": 4, "new_ui_components": 6, "changed_shared_ui_components": 6, "crypto_signals": 10, "algorithm_signals": 8}


# What evidence of each dimension says.
EVIDENCE = {
    "dependency_manifest": "manifest changed; new dependency not confirmed",
    "new_ui_component": "new component file",
    "shared_ui_component": "component file changed; consumer reach unknown",
    "internal_import": "new relative import",
    "ui_reuse": "component import added",
    "external_endpoint": "new URL host (review whether partner integration)",
    "crypto": "keyword signal; reviewer confirmation required",
    "algorithm": "keyword signal; reviewer confirmation required",
    "terraform": "new observable infrastructure/database constructs",
    "sql": "new observable infrastructure/database constructs",
}


def go_module_prefix(go_mod: Column) -> Column:
    """``module/`` of the first module line of a go.mod text; null if there is none."""
    found = F.regexp_extract(go_mod, r"(?m)^[ \t\r]*module [ \t]*([^ \t\r\n](?:[^\r\n]*[^ \t\r\n])?)[ \t\r]*$", 1)
    return F.when(found != "", F.concat(found, F.lit("/")))


def weighted(points: dict[str, int]) -> Column:
    out = F.lit(0).cast("bigint")
    for name, weight in points.items():
        out = out + weight * F.col(name)
    return out


def _constructs(path: Column, text: Column) -> dict[str, Column]:
    """Counts of all constructs of a text; zero where its path asks for none."""
    zero = F.lit(0).cast("bigint")
    sql = constructs.sql_counts(F.col("_hits"))
    out = {name: F.when(paths.is_terraform(path), F.element_at("_terraform", k + 1)).otherwise(zero) for k, name in enumerate(constructs.TERRAFORM)}
    return out | {name: F.when(paths.is_sql(path), sql[name]).otherwise(zero) for name in constructs.SQL}


def with_constructs(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``files`` with a column for each construct's count."""
    p, t = F.col(path), F.coalesce(F.col(text), F.lit(""))
    made = files.withColumns({"_hits": F.when(paths.is_sql(p), constructs.sql_hits(constructs.sql_tokens(t))), "_terraform": F.when(paths.is_terraform(p), constructs.terraform_counts(t))})
    return made.withColumns(_constructs(p, t)).drop("_hits", "_terraform")


def file_signals(files: DataFrame, go_prefix: Column | None = None, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Per wanted file: lines, branches, distinct imports and hosts, keyword flags.

    ``files(keys..., text)``.  Lines with a character that isn't a blank count.  Terraform and SQL
    files have lines and branches only.
    """
    path = F.col("path")
    plain = ~(paths.is_terraform(path) | paths.is_sql(path))
    rows = files.select(*keys, plain.alias("plain"), F.explode(lines.lines_of(F.col("text"))).alias("line"))
    line, plain = F.col("line"), F.col("plain")
    filled = ~lines.is_blank(line)
    local = lines.is_import(line) & paths.contains_any(line, lines.LOCAL_SNAPSHOT)
    if go_prefix is not None:
        local = local | (path.endswith(".go") & F.coalesce(line.contains(go_prefix), F.lit(False)))
    return rows.groupBy(*keys).agg(
        F.count(F.when(filled, 1)).alias("source_lines"),
        F.count(F.when(filled & lines.is_branch(line), 1)).alias("branch_lines"),
        F.count_distinct(F.when(filled & plain & local, line)).alias("internal_imports"),
        F.count_distinct(F.when(filled & plain, lines.url_host(line))).alias("external_host_references"),
        F.coalesce(F.max((plain & lines.is_crypto(line)).cast("bigint")), F.lit(0)).alias("crypto_files"),
        F.coalesce(F.max((plain & lines.is_algorithm(line)).cast("bigint")), F.lit(0)).alias("algorithm_files"),
    )


def complexity(files: DataFrame, go_prefix: str | None = None) -> DataFrame:
    """One row: all counts and scores of a snapshot ``files(path, text)``."""
    return complexity_by(files.withColumn("_all", F.lit(0)), "_all", go_prefix).drop("_all")


def complexity_by(files: DataFrame, snapshot: str, go_prefix: str | None = None) -> DataFrame:
    """The same for each value of the column ``snapshot``, in one plan."""
    path = F.col("path")
    one = lambda test: F.sum(F.when(test, 1).otherwise(0)).cast("bigint")
    marked = files.select(snapshot, "path", "text", paths.is_excluded(path).alias("_excluded"), paths.is_source(path).alias("_source"), F.coalesce(lines.is_binary(F.col("text")), F.lit(False)).alias("_binary"))
    scored = ~F.col("_excluded") & F.col("_source")
    text_file = scored & ~F.col("_binary")
    totals = marked.groupBy(snapshot).agg(
        one(F.col("_excluded") | ~F.col("_source")).alias("excluded_files"),
        one(~F.col("_excluded") & paths.is_manifest(path)).alias("dependency_manifests"),
        one(scored & F.col("_binary")).alias("binary_files"),
        one(text_file).alias("source_files"),
        one(text_file & paths.is_terraform(path)).alias("terraform_files"),
        one(text_file & paths.is_sql(path)).alias("sql_files"),
        one(text_file & paths.is_sql(path) & path.contains("migration")).alias("sql_migration_files"),
        one(text_file & paths.is_ui_component(path)).alias("ui_components"),
    )
    wanted = marked.where(text_file).select(snapshot, "path", F.coalesce("text", F.lit("")).alias("text"))
    prefix = F.lit(go_prefix) if go_prefix else None
    signals = file_signals(wanted, prefix, (snapshot, "path"))
    sums = signals.groupBy(snapshot).agg(*(F.sum(c).alias(c) for c in signals.columns if c not in (snapshot, "path")))
    counted = with_constructs(wanted).groupBy(snapshot).agg(*(F.sum(c).alias(c) for c in constructs.POINTS))
    out = totals.join(sums, snapshot, "left").join(counted, snapshot, "left")
    return scores(out.na.fill(0))


def scores(counts: DataFrame) -> DataFrame:
    """``counts`` with points and points per thousand lines, rounded half up."""
    out = counts.withColumns({"size_points": F.col("source_lines"), "structural_points": weighted(SNAPSHOT_POINTS), "domain_points": weighted(constructs.POINTS)})
    out = out.withColumn("total_points", F.col("size_points") + F.col("structural_points") + F.col("domain_points"))
    for name, points in (("points_per_kloc", "total_points"), ("structural_points_per_kloc", "structural_points"), ("domain_points_per_kloc", "domain_points")):
        rounded = F.expr(f"({points} * 1000 + source_lines div 2) div source_lines")
        out = out.withColumn(name, F.when(F.col("source_lines") > 0, rounded).otherwise(0).cast("bigint"))
    return out


def complexity_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: the scores of both snapshots and their signed differences."""
    names = ("total_points", "size_points", "structural_points", "domain_points")
    a = complexity(before).select(*(F.col(n).alias(f"base_{n}") for n in names))
    b = complexity(after).select(*names)
    out = b.join(a)  # one row each
    return out.withColumns({f"delta_{n}": F.col(n) - F.col(f"base_{n}") for n in names})


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, old_text, new_text, is_new) of files whose text differs, added and removed ones included."""
    old = before.select("path", F.col("text").alias("old_text"), F.lit(True).alias("was"))
    new = after.select("path", F.col("text").alias("new_text"), F.lit(True).alias("has"))
    both = old.join(new, "path", "full_outer").where(~(F.col("was").eqNullSafe(F.col("has")) & F.col("old_text").eqNullSafe(F.col("new_text"))))
    return both.select("path", "old_text", "new_text", F.col("was").isNull().alias("is_new"))


def added_lines(files: DataFrame) -> DataFrame:
    """(path, line, added, removed) of changed text files: line multisets of both sides compared."""
    side = lambda c: files.select("path", F.explode(lines.lines_of(F.coalesce(c, F.lit("")))).alias("line")).where("line <> ''")
    return multiset_diff(side("old_text"), side("new_text"), ["path", "line"])


def _text_files(files: DataFrame) -> DataFrame:
    path = F.col("path")
    binary = lines.is_binary(F.coalesce("old_text", F.lit(""))) | lines.is_binary(F.coalesce("new_text", F.lit("")))
    return files.withColumns({"scored": paths.is_source(path) & ~paths.is_excluded(path), "binary": binary})


def change_evidence(before: DataFrame, after: DataFrame, limit: int | None = EVIDENCE_LIMIT) -> DataFrame:
    """(dimension, path, detail) of what a change's score rests on, by path, dimension and line."""
    files = _text_files(changed_files(before, after))
    path = F.col("path")
    domain = paths.is_terraform(path) | paths.is_sql(path)
    own = files.where("scored AND NOT binary")
    added = added_lines(own).where("added > 0").where(~domain)
    line = F.col("line")
    first_of = lambda df, key: df.groupBy(key).agg(F.min(F.struct("path", "line")).alias("f")).select(F.col("f.path").alias("path"), F.col("f.line").alias("line"))
    parts = [
        (files.where(paths.is_manifest(path)), "dependency_manifest"),
        (files.where(paths.is_ui_component(path) & F.col("is_new")), "new_ui_component"),
        (files.where(paths.is_ui_component(path) & ~F.col("is_new")), "shared_ui_component"),
        (first_of(added.where(lines.is_import(line) & paths.contains_any(line, lines.LOCAL_CHANGE)), "line"), "internal_import"),
        (added.where(lines.is_import(line) & paths.contains_any(line, paths.UI_FOLDERS)).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "added"))), "ui_reuse"),
        (first_of(added.withColumn("host", lines.url_host(line)).where("host IS NOT NULL"), "host"), "external_endpoint"),
        (added.where(lines.is_crypto(line)).groupBy("path").agg(F.min("line").alias("line")), "crypto"),
        (added.where(lines.is_algorithm(line)).groupBy("path").agg(F.min("line").alias("line")), "algorithm"),
    ]
    grown = _added_constructs(own.where(domain)).where(weighted(constructs.POINTS) > 0)
    named = [(grown.where(paths.is_terraform(path)), "terraform"), (grown.where(paths.is_sql(path)), "sql")]
    out = None
    for df, dimension in parts + named:
        where = F.col("line") if "line" in df.columns else F.lit("")
        rows = df.select(F.lit(dimension).alias("dimension"), "path", F.lit(EVIDENCE[dimension]).alias("detail"), where.alias("line"))
        out = rows if out is None else out.unionAll(rows)
    out = out.orderBy("path", "dimension", "line")
    return (out.limit(limit) if limit is not None else out).select("dimension", "path", "detail")


def _added_constructs(files: DataFrame) -> DataFrame:
    """(path, constructs...) more in the new text than in the old, never below zero."""
    side = lambda c: with_constructs(files.select("path", F.coalesce(c, F.lit("")).alias("text"))).drop("text")
    old = side("old_text").select("path", *(F.col(c).alias(f"old_{c}") for c in constructs.POINTS))
    new = side("new_text")
    return new.join(old, "path").select("path", *(F.greatest(F.col(c) - F.col(f"old_{c}"), F.lit(0)).alias(c) for c in constructs.POINTS))


def change_score(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: all counts and scores of the change from one snapshot to another."""
    files = _text_files(changed_files(before, after))
    path = F.col("path")
    domain = paths.is_terraform(path) | paths.is_sql(path)
    one = lambda test: F.coalesce(F.sum(F.when(test, 1).otherwise(0)), F.lit(0)).cast("bigint")
    counts = files.agg(
        F.count("*").alias("files"),
        one(paths.is_manifest(path)).alias("dependency_changes"),
        one(paths.is_ui_component(path) & F.col("is_new")).alias("new_ui_components"),
        one(paths.is_ui_component(path) & ~F.col("is_new")).alias("changed_shared_ui_components"),
        one(~F.col("scored")).alias("excluded_files"),
        one(F.col("scored") & F.col("binary")).alias("binary_files"),
    )
    own = files.where("scored AND NOT binary")
    diff = added_lines(own)
    line, plain, is_added = F.col("line"), ~domain, F.col("added") > 0
    amount = lambda test, c: F.coalesce(F.sum(F.when(test, F.col(c))), F.lit(0)).cast("bigint")
    imports = lines.is_import(line)
    signals = diff.agg(
        amount(F.lit(True), "added").alias("added_lines"),
        amount(F.lit(True), "removed").alias("removed_lines"),
        amount(lines.is_branch(line), "added").alias("added_branches"),
        F.count_distinct(F.when(plain & is_added & imports & paths.contains_any(line, lines.LOCAL_CHANGE), line)).alias("internal_imports"),
        amount(plain & imports & paths.contains_any(line, paths.UI_FOLDERS), "added").alias("reused_ui_components"),
        F.count_distinct(F.when(plain & is_added, lines.url_host(line))).alias("external_integrations"),
        F.count_distinct(F.when(plain & is_added & lines.is_crypto(line), path)).alias("crypto_signals"),
        F.count_distinct(F.when(plain & is_added & lines.is_algorithm(line), path)).alias("algorithm_signals"),
    )
    grown = _added_constructs(own.where(domain)).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in constructs.POINTS))
    out = counts.join(signals).join(grown)  # one row each
    work = F.col("added_lines") + F.col("removed_lines") + 4 * F.col("added_branches") + 3 * (F.col("files") - F.col("excluded_files") - F.col("binary_files"))
    out = out.withColumns({"work_points": work, "domain_points": weighted(constructs.POINTS)})
    out = out.withColumn("complexity_points", weighted(CHANGE_POINTS) + F.col("domain_points"))
    return out.withColumn("total_points", F.col("work_points") + F.col("complexity_points"))


RECORD_COLUMNS = ("pr_id", "merged_at", "stage", "base", "to")


def change_records(text_lines: DataFrame) -> DataFrame:
    """Parse ``text_lines(line_no, line)`` of change records: five columns between tabs.

    Blank lines and comments go; a header may be on line 1.  ``problem`` is null for a valid record.
    """
    trimmed = F.btrim("line", F.lit("\r "))
    rows = text_lines.select("line_no", trimmed.alias("line")).where("line <> '' AND NOT startswith(line, '#')")
    parts = rows.select("line_no", F.split("line", "\t", -1).alias("c"))
    parts = parts.where(~((F.col("line_no") == 1) & (F.get("c", F.lit(0)) == "pr_id") & (F.size("c") == 5)))
    part = lambda k: F.get("c", F.lit(k))
    empty = F.lit(False)
    for k in (0, 1, 3, 4):
        empty = empty | (part(k) == "")
    problem = F.when(F.size("c") < 5, "needs five tab-separated columns").when((F.size("c") > 5) | empty, "invalid record").when(~part(2).isin("pre", "post"), "stage must be pre or post")
    return parts.select("line_no", *(part(k).alias(n) for k, n in enumerate(RECORD_COLUMNS)), problem.alias("problem"))
