"""Path and object classifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of source files (besides .tf and .sql).
SOURCE_SUFFIXES = (".zig", ".go", ".py", ".js", ".jsx", ".ts", ".tsx", ".vue", ".svelte", ".java", ".kt", ".swift", ".rs", ".c", ".cc", ".cpp", ".h", ".hpp", ".cs", ".rb", ".php", ".sh")
# Parts of paths that are left out.
EXCLUDED_PARTS = ("vendor/", "node_modules/", "dist/", "build/", "generated/", ".gen.", "_generated.", ".min.")
# Suffixes of dependency manifests.
MANIFESTS = ("package.json", "go.mod", "Cargo.toml", "pyproject.toml", "requirements.txt", "Gemfile", "build.zig.zon", "Package.swift")
# Component files and their folders.
UI_SUFFIXES = (".tsx", ".jsx", ".vue", ".svelte")
UI_FOLDERS = ("components/", "Components/")
# Large-file candidates, by size and by extension.
LFS_BYTES = 5 * 1024 * 1024
LFS_EXTENSIONS = (
    "png", "jpg", "jpeg", "gif", "bmp", "ico", "webp", "tiff",
    "pdf", "psd", "ai",
    "zip", "gz", "tgz", "bz2", "xz", "7z", "rar", "tar",
    "mp4", "mov", "avi", "mkv", "webm", "mp3", "wav", "flac", "ogg",
    "so", "dll", "dylib", "exe", "o", "a", "class", "jar",
    "pyc", "pyo", "whl", "wasm",
    "woff", "woff2", "ttf", "otf", "eot",
    "parquet", "h5", "onnx", "pkl", "sql",
)


def any_of(tests) -> Column:
    """Disjunction; false for no tests."""
    out = F.lit(False)
    for test in tests:
        out = out | test
    return out


def contains_any(column: Column, words) -> Column:
    return any_of(column.contains(w) for w in words)


def ends_with_any(column: Column, suffixes) -> Column:
    return any_of(column.endswith(s) for s in suffixes)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension_of(path: Column) -> Column:
    """What follows the last dot of the last component; null for dotfiles, trailing dots and no dot."""
    found = F.regexp_extract(basename(path), r"(?s)^.+\.([^.]+)$", 1)
    return F.when(found != "", found)


def is_lfs_candidate(size: Column, path: Column) -> Column:
    by_name = F.coalesce(F.lower(extension_of(path)).isin(*LFS_EXTENSIONS), F.lit(False))
    return F.coalesce(size >= LFS_BYTES, F.lit(False)) | by_name


def is_terraform(path: Column) -> Column:
    return path.endswith(".tf")


def is_sql(path: Column) -> Column:
    return path.endswith(".sql")


def is_source(path: Column) -> Column:
    return is_terraform(path) | is_sql(path) | ends_with_any(path, SOURCE_SUFFIXES)


def is_excluded(path: Column) -> Column:
    return contains_any(path, EXCLUDED_PARTS)


def is_manifest(path: Column) -> Column:
    return ends_with_any(path, MANIFESTS)


def is_ui_component(path: Column) -> Column:
    return ends_with_any(path, UI_SUFFIXES) & contains_any(path, UI_FOLDERS)


def short_ref_name(name: Column) -> Column:
    return F.regexp_replace(name, "^refs/(heads|tags|remotes)/", "")


def shell_quote(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'"))
