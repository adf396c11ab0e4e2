"""Reports as JSON and as aligned text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.functions.sizes import format_size_text

_BYTES = ("bytes", "size", "limit", "actual")


def as_json(report: dict, compact: bool = False) -> str:
    return json.dumps(report, ensure_ascii=False, separators=(",", ":")) if compact else json.dumps(report, ensure_ascii=False, indent=2)


def json_rows(rows: DataFrame) -> DataFrame:
    """(json): one flat JSON object for each row, nulls included, as the scorer gives for any files."""
    return rows.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), {"ignoreNullFields": "false"}).alias("json"))


def _cell(name: str, value) -> str:
    if value is None:
        return "-"
    if isinstance(value, bool):
        return "yes" if value else "no"
    if isinstance(value, int) and (name.endswith("_bytes") or name in _BYTES):
        return format_size_text(value)
    if isinstance(value, list):
        return ", ".join(map(str, value))
    return str(value)


def _table(rows: list[dict]) -> list[str]:
    names = list(rows[0])
    cells = [[_cell(n, r[n]) for n in names] for r in rows]
    widths = [max(len(n), *(len(c[k]) for c in cells)) for k, n in enumerate(names)]
    return ["  ".join(x.ljust(w) for x, w in zip(line, widths, strict=True)).rstrip() for line in [names, *cells]]


def as_text(report: dict, indent: str = "") -> str:
    """Scalars as aligned lines, lists of records as tables, nested records indented."""
    out = []
    plain = {k: v for k, v in report.items() if not isinstance(v, dict) and not (isinstance(v, list) and v and isinstance(v[0], dict))}
    width = max(map(len, plain), default=0)
    for name, value in report.items():
        if name in plain:
            out.append(f"{indent}{name.ljust(width)}  {_cell(name, value)}")
        elif isinstance(value, dict):
            out += [f"{indent}{name}", as_text(value, indent + "  ")]
        else:
            out += [f"{indent}{name}", *(f"{indent}  {line}" for line in _table(value))]
    return "\n".join(out)
