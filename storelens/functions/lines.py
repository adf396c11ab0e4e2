"""Signals of single text lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storelens.functions.paths import contains_any

# What a branch line starts with, after spaces and tabs.
BRANCH_STARTS = ("if ", "if(", "else if", "elif ", "for ", "for(", "while ", "while(", "case ", "catch ", "catch(", "except ", "switch ", "switch(", "match ")
# What an import line contains, and what marks it as local.
IMPORT_WORDS = ("import ", "from ", "require(", "@import(", "#include ")
LOCAL_SNAPSHOT = ("./", "../", "@/", "crate::", "self::", "super::")
LOCAL_CHANGE = ("./", "../", "@/")
# Keyword signals.
CRYPTO_WORDS = ("crypto", "Crypto", "cipher", "Cipher", "encrypt", "decrypt", "signature", "hmac", "HMAC")
ALGORITHM_WORDS = ("algorithm", "Algorithm", "state machine", "binarySearch", "dijkstra", "quicksort", "dynamic programming")


def lines_of(text: Column) -> Column:
    """All lines, empty ones included."""
    return F.split(text, "\n", -1)


def is_blank(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r")) == ""


def is_branch(line: Column) -> Column:
    starts = "|".join(s.replace("(", r"\(") for s in BRANCH_STARTS)
    return line.rlike(f"^[ \t]*(?:{starts})")


def is_import(line: Column) -> Column:
    return contains_any(line, IMPORT_WORDS)


def is_crypto(line: Column) -> Column:
    return contains_any(line, CRYPTO_WORDS)


def is_algorithm(line: Column) -> Column:
    return contains_any(line, ALGORITHM_WORDS)


def url_host(line: Column) -> Column:
    """Host of the first https URL, else of the first http URL; null if empty or localhost."""
    host = r"([^/\"' \t:)}]*)"
    https, http = F.regexp_extract(line, "https://" + host, 1), F.regexp_extract(line, "http://" + host, 1)
    found = F.when(line.contains("https://"), https).otherwise(http)
    return F.when((found != "") & (found != "localhost"), found)


def is_binary(text: Column) -> Column:
    """Whether a NUL character occurs."""
    return text.contains("\0")
