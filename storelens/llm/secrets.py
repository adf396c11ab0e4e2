"""Secret scan: fixed patterns, and a battery of randomness tests with false-discovery control.

Base spans come from three patterns.  Beyond them, every run of at least ``MIN_RUN`` encoding
characters is a candidate; one that fits no alphabet, as in ``KEY=value`` or ``dir/x-y``, is cut into
its maximal pieces that do (these may overlap).  Its encoding is the smallest alphabet that fits.  The
battery asks two questions about a candidate in its alphabet.

* Is it random?  Three tests answer, each with a p-value: chi-squared uniformity, runs about the middle
  of the alphabet, lag-1 serial correlation.  Three times the least (at most 1) is the candidate's.
* Is it ordinary text?  The same chi-squared statistic answers, by its other tail: the chance that it's
  as small in text whose characters coincide with probability ``ORDINARY``.  (The statistic is a
  multiple of the number of equal pairs of characters, less a constant, and that number is about
  Poisson.)  A short candidate can't differ much from text, so this p-value is large for it.

Each question is put to all candidates of all documents at once, with step-up control of the share of
false discoveries (Benjamini-Hochberg) at ``FDR``, where p-values are divided by weights that grow with
the length and average 1.  Candidates found to be not random go; of the others, those found to be not
ordinary are spans.  Thresholds come from histograms of the p-values, of at most ``BINS`` counts.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import slices, stored, text_buffer

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
MIN_VALUE, MIN_ACCESS, MIN_HEX, MIN_RUN = 6, 20, 24, 20
FDR, ORDINARY = 0.01, {10: 0.12, 16: 0.1, 32: 0.0667, 62: 0.0667, 64: 0.0667}
BINS, BINS_PER_E = 4096, 8
FULL_WEIGHT = 64

_IS_HEX = np.zeros(256, bool)
_IS_HEX[[*b"0123456789abcdef"]] = True
_IS_CODE = np.zeros(256, bool)
_IS_CODE[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = [_DIGITS, _DIGITS + "abcdef", _DIGITS + "ABCDEF", _UPPER + "234567", _UPPER + _LOWER + _DIGITS, _UPPER + _LOWER + _DIGITS + "+/", _UPPER + _LOWER + _DIGITS + "-_"]

#: The two largest alphabets, which hold the others
_FITS = [re.compile(rb"[A-Za-z0-9+/]+"), re.compile(rb"[A-Za-z0-9_-]+")]


def runs_of(data: np.ndarray, offsets: np.ndarray, member: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of member bytes within a text, of at least ``least`` bytes."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = member[data]
    change = np.zeros(len(data) + 1, bool)
    change[0] = inside[0]
    change[1:] = inside[1:] != inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    change[edges] |= inside[edges]  # a run ends with its text
    at = np.flatnonzero(change)
    begin = at[inside[at]]
    nxt = np.append(at[1:], len(data))
    end = nxt[inside[at]]
    long = end - begin >= least
    return begin[long], end[long]


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi_squared(x: np.ndarray, size: int) -> float:
    """Chance of as uneven counts; the statistic is made normal by its cube root."""
    n, k = len(x), size - 1
    stat = size / n * float((np.bincount(x, minlength=size).astype(float) ** 2).sum()) - n
    return _normal_tail(((stat / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k)))


def runs_test(x: np.ndarray, size: int) -> float:
    """Two-sided chance of as odd a number of runs above and below the middle."""
    high = x >= size // 2
    n, a = len(x), int(high.sum())
    b = n - a
    if not a or not b:
        return 2.0 ** (1 - n)
    runs = 1 + int((high[1:] != high[:-1]).sum())
    mean = 1 + 2 * a * b / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    return 1.0 if var <= 0 else min(1.0, 2 * _normal_tail(abs(runs - mean) / math.sqrt(var)))


def serial_test(x: np.ndarray) -> float:
    """Two-sided chance of as strong a correlation of neighbours."""
    y = x - x.mean()
    var = float((y * y).sum())
    if not var:
        return 0.0
    n = len(x)
    r = float((y[1:] * y[:-1]).sum()) / var
    return min(1.0, 2 * _normal_tail(abs(r + 1 / n) * math.sqrt(n)))


def coincidence(x: np.ndarray, size: int) -> float:
    """Natural log of the chance that ordinary text has as few equal pairs (Poisson)."""
    n = len(x)
    counts = np.bincount(x)
    pairs = int((counts * (counts - 1) // 2).sum())
    mean = ORDINARY[size] * n * (n - 1) / 2
    term, total = -mean, []
    for k in range(pairs + 1):
        if k:
            term += math.log(mean / k)
        total.append(term)
    top = max(total)
    return min(0.0, top + math.log(sum(math.exp(t - top) for t in total)))


def battery(token: str) -> tuple[float, float] | None:
    """Natural logs of the p-values of "ordinary text" and of "random"; None if it's no candidate."""
    token = token.rstrip("=")
    if len(token) < MIN_RUN:
        return None
    for alphabet in ALPHABETS:
        if not set(token) - set(alphabet):
            x = np.array([alphabet.index(c) for c in token])
            size = len(alphabet)
            least = min(chi_squared(x, size), runs_test(x, size), serial_test(x))
            return coincidence(x, size), min(0.0, math.log(max(3 * least, 1e-300)))
    return None


def level(n: Column, logp: Column, mean: float) -> Column:
    """Histogram bin of a p-value divided by its candidate's weight; higher bins are smaller values."""
    weight = F.least(n, F.lit(FULL_WEIGHT)).cast("double") / F.lit(mean or 1.0)
    return F.least(F.lit(BINS - 1), F.floor(F.greatest(F.lit(0.0), F.log(weight) - logp) * BINS_PER_E)).cast("int")


def step_up(counts: dict[int, int], fdr: float) -> int:
    """The lowest bin whose upper ends are discoveries, of a histogram of all tests; ``BINS`` if there's none."""
    total, cut, above = sum(counts.values()), BINS, 0
    for b in range(BINS - 1, -1, -1):
        above += counts.get(b, 0)
        if counts.get(b) and math.exp(-b / BINS_PER_E) * total <= fdr * above:
            cut = b
    return cut


def pieces(run: bytes) -> list[tuple[int, int]]:
    """Where to test a run: all of it if it fits an alphabet, else its maximal pieces that do.

    Padding at the end of the run belongs to the last piece.
    """
    body = len(run.rstrip(b"="))
    if any(p.fullmatch(run, 0, body) for p in _FITS):
        return [(0, len(run))]
    found = (m.span() for p in _FITS for m in p.finditer(run, 0, body))
    out: list[tuple[int, int]] = []
    for start, end in sorted({s for s in found if s[1] - s[0] >= MIN_RUN}, key=lambda s: (s[0], -s[1])):
        if not out or end > out[-1][1]:  # not within the one before
            out.append((start, end))
    return [(start, len(run) if end == body else end) for start, end in out]


def base_spans(raw: bytes, hex_runs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes, unsorted."""
    out = [(a, 2, b) for a, b in hex_runs]
    low = raw.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(raw) if len(m[2]) >= MIN_VALUE]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(raw) if len(m[0]) >= MIN_ACCESS]
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


SCAN_SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, base array<struct<a:int,k:int,b:int>>, found array<struct<a:int,b:int,n:int,ordinary:double,random:double>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string())]
        + [("base", pa.list_(pa.struct([(n, pa.int32()) for n in "akb"]))), ("found", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int32()), ("ordinary", pa.float64()), ("random", pa.float64())])))]
    )
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        ids = batch.column(0).to_pylist()
        for i, j in slices(offsets):
            part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            points = np.zeros(len(part) + 1, np.int64)  # code points before each byte
            np.cumsum((part & 0xC0) != 0x80, out=points[1:])
            own: list[list[list[tuple[int, int]]]] = []
            for member, least in ((_IS_HEX, MIN_HEX), (_IS_CODE, MIN_RUN)):
                lists: list[list[tuple[int, int]]] = [[] for _ in range(j - i)]
                begin, end = runs_of(part, off, member, least)
                text = np.searchsorted(off, begin, "right") - 1
                for t, a, b in zip(text.tolist(), begin.tolist(), end.tolist(), strict=True):
                    lists[t].append((a - int(off[t]), b - int(off[t])))
                own.append(lists)
            out = []
            for t in range(j - i):
                start = int(off[t])
                raw = part[start : off[t + 1]].tobytes()
                cp = lambda x, start=start: int(points[start + x] - points[start])
                base = base_spans(raw, own[0][t])
                spans = [(cp(a), k, cp(b)) for a, k, b in base]
                found = []
                for a, b in ((a + x, a + y) for a, b in own[1][t] for x, y in pieces(raw[a:b])):
                    tested = battery(raw[a:b].decode("ascii"))
                    if tested and not any(x <= a and b <= y for x, _, y in base):
                        found.append({"a": cp(a), "b": cp(b), "n": b - a, "ordinary": tested[0], "random": tested[1]})
                out.append(
                    {
                        "doc_id": ids[i + t],
                        **{f"n_{KINDS[k]}": sum(s[1] == k for s in spans) for k in range(3)},
                        "base_sha256": hashlib.sha256(joined(spans).encode()).hexdigest(),
                        "base": [dict(zip("akb", s, strict=True)) for s in sorted(spans)],
                        "found": found,
                    }
                )
            yield pa.RecordBatch.from_pylist(out, schema)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, n_random, spans), a row for each row of ``docs``.

    Null and empty texts have no spans; a text of any length is scanned whole; null ids stay null;
    repeated rows are scanned and counted alike; an empty table returns no rows; other columns aren't
    read.  Of equal p-values all or none are discoveries.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    scan = stored(rows.mapInArrow(_scan, SCAN_SCHEMA), "secrets")
    tests = scan.select(F.explode("found").alias("t")).select("t.*")
    size = F.least("n", F.lit(FULL_WEIGHT))

    def question(asked: DataFrame, name: str) -> Callable:
        """Whether a candidate is a discovery among those asked."""
        mean = float(asked.agg(F.avg(size)).first()[0] or 1.0)
        cut = step_up(dict(asked.groupBy(level(F.col("n"), F.col(name), mean)).count().collect()), fdr)
        return lambda t: level(t["n"], t[name], mean) >= cut

    patterned = question(tests, "random")
    apart = question(tests.where(~patterned(tests)), "ordinary")
    chosen = F.filter("found", lambda t: ~patterned(t) & apart(t))
    added = F.transform(chosen, lambda t: F.struct(t["a"].alias("a"), F.lit(3).alias("k"), t["b"].alias("b")))
    every = F.array_sort(F.concat("base", added))
    kind = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    spans = F.array_join(F.transform(every, lambda s: F.concat_ws(":", kind(s["k"]), s["a"].cast("string"), s["b"].cast("string"))), ",")
    return scan.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.size(chosen).cast("bigint").alias("n_random"), spans.alias("spans"))
