"""Command line: ``python -m storelens.cli COMMAND ...``."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from storelens import reports
from storelens.functions.sizes import parse_size_text
from storelens.operators.scoring import change_records
from storelens.plans.relations import Store
from storelens.session import local_session
from storelens.sinks.progress import Progress
from storelens.sinks.text import as_json, as_text
from storelens.sources.odb import Corrupt, Unsupported
from storelens.sources.repository import BadRevision, NotARepository, discover

OK, GENERAL, INVALID, NOT_FOUND, UNSUPPORTED, CORRUPT, THRESHOLD = range(7)
COMMANDS = ("summary", "largest", "objects", "packs", "unreachable", "refs", "dupes", "growth", "explain", "changed", "check", "pr", "complexity")
LIMITS = ("max-size", "max-historical", "max-unreachable", "max-blob", "max-growth")
MAX_INPUT = 32 << 20


class Invalid(Exception):
    """Options that don't go together, or don't parse."""


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise Invalid(message)


def _size(text: str) -> int:
    size = parse_size_text(text)
    if size is None:
        raise argparse.ArgumentTypeError(f"bad size {text}")
    return size


def parse(argv: list[str]) -> argparse.Namespace:
    p = _Parser(prog="storelens")
    p.add_argument("words", nargs="*")
    p.add_argument("--repo")
    p.add_argument("--json", action="store_true")
    p.add_argument("--limit", type=int, default=20)
    p.add_argument("--min-size", type=_size, default=0)
    p.add_argument("--current", action="store_true")
    p.add_argument("--historical", action="store_true")
    p.add_argument("--months", type=int)
    for name in ("--base", "--to", "--rev", "--input"):
        p.add_argument(name)
    p.add_argument("--exit-code", action="store_true")
    p.add_argument("--max-points", type=int)
    p.add_argument("--threads", type=int)
    for name in ("--no-color", "--quiet", "--verbose"):
        p.add_argument(name, action="store_true")
    for name in LIMITS:
        p.add_argument(f"--{name}", type=_size)
    o = p.parse_args(argv)
    words = list(o.words)
    o.command = words.pop(0) if words and words[0] in COMMANDS else "summary"
    o.target = words.pop(0) if o.command in ("explain", "changed") and words else None
    o.path = words.pop(0) if words else o.repo or "."
    o.limits = {n: v for n in LIMITS if (v := getattr(o, n.replace("-", "_"))) is not None}
    wrong = (
        words
        or (o.command in ("explain", "changed") and o.target is None)
        or (o.command == "check" and not o.limits)
        or (o.current and o.historical)
        or (o.max_points is not None and o.command != "pr")
        or (o.rev and o.command != "complexity")
        or (o.to and o.command == "complexity")
        or (o.input and (o.command != "pr" or not o.json or o.base or o.to))
        or o.limit < 0
    )
    if wrong:
        raise Invalid("options that don't go together")
    return o


def _default_base(store: Store) -> str:
    names = {r.name for r in store.refs}
    return "origin/main" if "refs/remotes/origin/main" in names else "main"


def run(o: argparse.Namespace, spark: SparkSession, out, progress: Progress | None = None) -> int:
    progress = progress or Progress(quiet=True)
    with progress.phase("open"):
        store = Store(spark, discover(o.path))
    with progress.phase(o.command):
        return _report(o, store, out)


def _report(o: argparse.Namespace, store: Store, out) -> int:
    show = lambda report, compact=False: print(as_json(report, compact) if o.json else as_text(report), file=out)
    status = "current" if o.current else "historical" if o.historical else None
    if o.command == "pr" and o.input:
        return _batch(o, store, out)
    if o.command == "pr":
        report = reports.pr(store, o.base or _default_base(store), o.to or "HEAD")
        show(report, True)
        return THRESHOLD if o.max_points is not None and report["total_points"] > o.max_points else OK
    if o.command == "complexity":
        show(reports.complexity(store, o.rev or "HEAD", o.base), True)
    elif o.command == "changed":
        report = reports.changed(store, o.target, o.base or "HEAD~1", o.to or "HEAD")
        show(report)
        return GENERAL if o.exit_code and report["changed"] else OK
    elif o.command == "check":
        report = reports.check(store, o.limits)
        show(report)
        return OK if report["ok"] else THRESHOLD
    elif o.command == "explain":
        show(reports.explain(store, o.target))
    elif o.command in ("largest", "dupes"):
        show(getattr(reports, o.command)(store, o.limit, o.min_size, status))
    elif o.command == "refs":
        show(reports.refs(store, o.limit))
    elif o.command == "growth":
        show(reports.growth(store, o.months))
    else:
        show(getattr(reports, o.command)(store))
    return OK


def _batch(o: argparse.Namespace, store: Store, out) -> int:
    raw = Path(o.input).read_bytes()
    if len(raw) > MAX_INPUT:
        raise Invalid("the input is too large")
    lines = enumerate(raw.decode(errors="replace").split("\n"), 1)
    rows = change_records(store.spark.createDataFrame(list(lines), "line_no bigint, line string")).orderBy("line_no").collect()
    over = False
    for r in rows:
        if r.problem:
            raise Invalid(f"line {r.line_no}: {r.problem}")
        report = reports.pr(store, r.base, r.to, pr_id=r.pr_id, merged_at=r.merged_at, stage=r.stage)
        print(as_json(report, True), file=out)
        over |= o.max_points is not None and report["total_points"] > o.max_points
    return THRESHOLD if over else OK


def _cause(error: BaseException) -> int:
    """Exit code of an error, also of one that a Python worker reports as text."""
    text = f"{type(error).__name__} {error}"
    for kinds, names, code in (((Corrupt,), ("odb.Corrupt",), CORRUPT), ((Unsupported,), ("odb.Unsupported",), UNSUPPORTED)):
        if isinstance(error, kinds) or any(n in text for n in names):
            return code
    return GENERAL


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None, err=None) -> int:
    out, err = out or sys.stdout, err or sys.stderr
    try:
        o = parse(sys.argv[1:] if argv is None else argv)
        with Progress(err, o.quiet, o.verbose) as progress:
            with progress.phase("session"):
                spark = spark or local_session(o.threads or "*")
            return run(o, spark, out, progress)
    except (Invalid, BadRevision, reports.AmbiguousTarget) as e:
        print(f"error: {type(e).__name__}: {e}", file=err)
        return INVALID
    except NotARepository as e:
        print(f"error: not a repository: {e}", file=err)
        return NOT_FOUND
    except (reports.TargetNotFound, reports.PathMissing) as e:
        print(f"error: not found: {e}", file=err)
        return GENERAL
    except Exception as e:  # noqa: BLE001
        print(f"error: {str(e)[:500]}", file=err)
        return _cause(e)


if __name__ == "__main__":
    sys.exit(main())
