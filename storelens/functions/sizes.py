"""Sizes, dates and object ids."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units, all base 2.
UNITS = {"": 0, "B": 0, "K": 1, "KB": 1, "KIB": 1, "M": 2, "MB": 2, "MIB": 2, "G": 3, "GB": 3, "GIB": 3, "T": 4, "TB": 4, "TIB": 4}
NAMES = ("B", "KB", "MB", "GB", "TB", "PB")


def parse_size(text: Column) -> Column:
    """Bytes of ``10MB`` and the like, units base 2 in either case; null if malformed."""
    number = F.regexp_extract(text, r"^([0-9.]+)", 1)
    unit = F.upper(F.btrim(F.regexp_replace(text, r"^[0-9.]+", ""), F.lit(" \t")))
    power = reduce(lambda out, u: F.when(unit == u, F.lit(1024.0 ** UNITS[u])).otherwise(out), UNITS, F.lit(None).cast("double"))
    valid = number.rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)$")
    return F.when(valid, F.floor(number.try_cast("double") * power)).cast("bigint")


def parse_size_text(text: str) -> int | None:
    """The same for one string, on the driver."""
    found = re.fullmatch(r"([0-9]+\.?[0-9]*|\.[0-9]+)[ \t]*([A-Za-z]*)[ \t]*", text)
    if not found or found[2].upper() not in UNITS:
        return None
    return int(float(found[1]) * 1024 ** UNITS[found[2].upper()])


def _rounded(whole: Column, bits: int, digits: int) -> Column:
    """``whole / 2**bits`` (1 or more) with ``digits`` decimals, halves to even; in integers, as Java's format rounds halves up."""
    scaled = whole * F.lit(10**digits).cast("bigint")
    floor, rest, half = F.shiftright(scaled, bits), scaled.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")), F.lit(1 << (bits - 1))
    figures = (floor + F.when((rest > half) | (rest == half) & (floor % 2 == 1), 1).otherwise(0)).cast("string")
    return figures if not digits else F.concat_ws(".", F.left(figures, F.length(figures) - digits), F.right(figures, F.lit(digits)))


def format_size(size: Column) -> Column:
    """Three significant figures and a base-2 unit, halves to even; whole bytes below 1024."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    whole = size.cast("double").cast("bigint")  # the nearest double, as in format_size_text
    for power, name in enumerate(NAMES[1:], 1):
        figures = F.when(whole >= 100 * 1024**power, _rounded(whole, 10 * power, 0)).when(whole >= 10 * 1024**power, _rounded(whole, 10 * power, 1)).otherwise(_rounded(whole, 10 * power, 2))
        out = F.when(whole >= 1024**power, F.concat(figures, F.lit(f" {name}"))).otherwise(out)
    return out


def format_size_text(size: int) -> str:
    value, unit = float(size), 0
    while value >= 1024 and unit + 1 < len(NAMES):
        value, unit = value / 1024, unit + 1
    if not unit:
        return f"{size} B"
    return f"{value:.{0 if value >= 100 else 1 if value >= 10 else 2}f} {NAMES[unit]}"


def month_of(seconds: Column) -> Column:
    """``YYYY-MM`` in UTC (the session's time zone) of seconds since 1970; earlier times count as 1970-01."""
    return F.date_format(F.timestamp_seconds(F.greatest(seconds, F.lit(0))), "yyyy-MM")


def date_of(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(F.greatest(seconds, F.lit(0))), "yyyy-MM-dd")


def oid_hex(oid: Column) -> Column:
    return F.lower(F.hex(oid))


def oid_abbrev(oid: Column) -> Column:
    return F.substring(oid_hex(oid), 1, 7)


def is_hex_prefix(text: Column) -> Column:
    return text.rlike("^[0-9a-fA-F]{4,64}$")
