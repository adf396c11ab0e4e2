"""N-gram Jaccard join: MinHash bands find groups, Bayesian pruning thins pairs, sets decide.

Documents are sets of hashes of five consecutive words.  Equal sets become one entry, which a 128-bit
key of the set names.  Entries that
agree on a band of ``ROWS`` MinHash values are tied together, and the connected groups of those ties
are the only places where a pair can be.  A group is dealt into blocks of bounded size, and each pair
of blocks is one unit of work; so a group of any size spreads over many tasks, and no row is ever
made for a pair.  Within a unit, MinHash values are compared sixteen at a time for all pairs at once.
After each step a pair goes if the posterior probability that its similarity reaches the threshold
(uniform prior, binomial likelihood) is under ``TOLERANCE``.  Surviving pairs are verified exactly
with their sets.  A pair at the threshold is missed by all bands with a probability of 5e-7.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import WORD_CLASS, dropped, grouped, slices, stored, text_buffer
from storelens.llm.components import components, stars
from storelens.llm.rowfilter import RowFilter
from storelens.llm.textvec import Words, mix

SHINGLE = 5
THRESHOLD = (4, 5)  # similarity of at least 4/5
ROWS, BANDS = 6, 48
STEP, TOLERANCE = 16, 1e-9
BLOCK_DOCS, BLOCK_BYTES = 512, 8 << 20

_rng = np.random.Generator(np.random.PCG64(90210))
_MUL = _rng.integers(0, 2**31, ROWS * BANDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 2**32, ROWS * BANDS, dtype=np.uint32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one text after the other, and where each starts.

    A text of one to four words has one shingle of all its words; one without words has none.
    """
    words = Words(data, offsets)
    n = len(offsets) - 1
    if not len(words.starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    at, hashes = words.runs(SHINGLE, shorter=True)
    text = words.text[at]
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    hashes, text = hashes[new], text[new]
    return hashes, np.searchsorted(text, np.arange(n + 1))


def signatures(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash values, one row for each nonempty set (in order)."""
    starts = first[:-1][np.diff(first) > 0]
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), ROWS * BANDS), np.uint32)
    if len(starts):
        for k in range(ROWS * BANDS):
            out[:, k] = np.minimum.reduceat(x * _MUL[k] + _ADD[k], starts)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band; different bands have different keys."""
    rows = sig.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        key = mix(key ^ rows[:, :, r]) if r == 0 else mix(key * np.uint64(31) ^ rows[:, :, r])
    return key.view(np.int64)


SKETCH_SCHEMA = "doc_id bigint, text_key binary, set_key binary, bands array<bigint>"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffer(batch.column(2))
        for i, j in slices(offsets):
            hashes, first = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            full = np.flatnonzero(np.diff(first))
            keys = [None] * (j - i)
            raw = memoryview(np.ascontiguousarray(hashes)).cast("B")
            for d in full:
                keys[d] = hashlib.blake2b(raw[first[d] * 8 : first[d + 1] * 8], digest_size=16).digest()
            bands = band_keys(signatures(hashes, first))
            ends = np.zeros(j - i + 1, np.int32)
            ends[1:] = np.cumsum(np.where(np.diff(first) > 0, BANDS, 0))
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(keys, pa.binary()), lists], ["doc_id", "text_key", "set_key", "bands"])


@lru_cache
def least_matches(threshold: float, tolerance: float, n: int) -> int:
    """Fewest matches among ``n`` values that leave a pair a chance of at least ``tolerance``.

    With a uniform prior, similarity given m matches of n is Beta(m + 1, n - m + 1), and the chance
    that it reaches t is the chance of at most m successes in n + 1 trials of t.
    """
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n + 1


def _survivors(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mask of pairs of signature rows that the posterior doesn't rule out."""
    t = THRESHOLD[0] / THRESHOLD[1]
    matches = np.zeros((len(a), len(b)), np.uint16)
    n = 0
    while n < a.shape[1]:
        for k in range(n, min(n + STEP, a.shape[1])):
            matches += a[:, k][:, None] == b[:, k][None, :]
        n = min(n + STEP, a.shape[1])
        alive = matches >= least_matches(t, TOLERANCE, n)
        i, j = np.nonzero(alive)
        if len(i) * 8 < alive.size:
            break
    else:
        return alive
    out = np.zeros(alive.shape, bool)
    count = matches[i, j].astype(np.int32)
    while n < a.shape[1] and len(i):
        for lo in range(0, len(i), 1 << 16):
            s = slice(lo, lo + (1 << 16))
            count[s] += (a[i[s], n : n + STEP] == b[j[s], n : n + STEP]).sum(1)
        n = min(n + STEP, a.shape[1])
        keep = count >= least_matches(t, TOLERANCE, n)
        i, j, count = i[keep], j[keep], count[keep]
    out[i, j] = True
    return out


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs in ``alive`` (0 elsewhere)."""
    out = np.zeros(alive.shape, np.int32)
    i, j = np.nonzero(alive)
    if len(i) <= 64 or len(i) * 50 < alive.size:
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            out[x, y] = len(np.intersect1d(sets[left[x]], sets[right[y]], assume_unique=True))
        return out
    # many pairs: a product of incidence matrices over the shingles that both sides have
    rows, cols = np.unique(i), np.unique(j)
    flat_l, flat_r = np.concatenate([sets[left[x]] for x in rows]), np.concatenate([sets[right[y]] for y in cols])
    common = np.intersect1d(flat_l, flat_r)
    size_l, size_r = [len(sets[left[x]]) for x in rows], [len(sets[right[y]]) for y in cols]
    row_l, row_r = np.repeat(np.arange(len(rows)), size_l), np.repeat(np.arange(len(cols)), size_r)
    col_l, col_r = np.searchsorted(common, flat_l), np.searchsorted(common, flat_r)
    ok_l = (col_l < len(common)) & (common[np.minimum(col_l, len(common) - 1)] == flat_l) if len(common) else np.zeros(len(flat_l), bool)
    ok_r = (col_r < len(common)) & (common[np.minimum(col_r, len(common) - 1)] == flat_r) if len(common) else np.zeros(len(flat_r), bool)
    row_l, col_l, row_r, col_r = row_l[ok_l], col_l[ok_l], row_r[ok_r], col_r[ok_r]
    total = np.zeros((len(rows), len(cols)), np.float32)
    width = 4096
    for lo in range(0, len(common), width):
        m = [np.zeros((n, width), np.float32) for n in (len(rows), len(cols))]
        for matrix, r, c in zip(m, (row_l, row_r), (col_l, col_r), strict=True):
            here = (c >= lo) & (c < lo + width)
            matrix[r[here], c[here] - lo] = 1
        total += m[0] @ m[1].T
    out[np.ix_(rows, cols)] = total.astype(np.int32)
    return np.where(alive, out, 0)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component, of ``n`` nodes and the links i-j."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            return root


def links_in_unit(copies: np.ndarray, block: np.ndarray, data: np.ndarray, offsets: np.ndarray, one_block: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the entries of one unit: those with a link, a root within the unit, and their links.

    A unit holds one block (all its pairs) or two (the pairs across).  Links count copies.
    """
    sets: list[np.ndarray] = []
    sigs = []
    for i, j in slices(offsets):
        hashes, first = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        sets += [hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        sigs.append(signatures(hashes, first).astype(np.uint16))
    sig = np.concatenate(sigs)
    size = np.array([len(s) for s in sets])
    low = block.min()
    left = np.flatnonzero(block == low)
    right = left if one_block else np.flatnonzero(block != low)
    alive = _survivors(sig[left], sig[right])
    if one_block:
        alive = np.triu(alive, 1)
    both = _shared(sets, left, right, alive)
    a, b = THRESHOLD
    linked = alive & ((a + b) * both >= a * (size[left][:, None] + size[right][None, :]))
    x, y = np.nonzero(linked)
    u, v = left[x], right[y]
    count = np.bincount(u, copies[v], len(sets)) + np.bincount(v, copies[u], len(sets))
    hit = np.flatnonzero(count)
    return hit, _roots(len(sets), u, v)[hit], count[hit].astype(np.int64)


LINK_SCHEMA = "u binary, v binary, links bigint"


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by unit."""
    for t in grouped(batches, ("gid", "lo", "hi")):
        copies, block = (t.column(n).to_numpy() for n in ("copies", "block"))
        data, offsets = text_buffer(t.column("text"))
        one = t.column("lo")[0].as_py() == t.column("hi")[0].as_py()
        u, v, n = links_in_unit(copies, block, data, offsets, one)
        keys = t.column("entry").combine_chunks()
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(u)), keys.take(pa.array(v)), pa.array(n)], ["u", "v", "links"])


def _sketched(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows with an id as (doc_id, text_key, text), and their sketch; equal texts have equal keys."""
    text = F.col(f"`{text_col}`")
    known = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("text_key"), text.alias("text")).where("doc_id IS NOT NULL")
    return known, stored(known.mapInArrow(_sketch, SKETCH_SCHEMA), "sketch")


def _classed(known: DataFrame, sketch: DataFrame, block_docs: int, block_bytes: int) -> DataFrame:
    """(set_key, class, first, n_links) of each entry; ``first`` is its first row's (doc_id, text_key)."""
    spark = known.sparkSession
    full = sketch.where("set_key IS NOT NULL")
    entries = stored(full.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.count("*").alias("copies")), "entries")

    # ties: entries that share a band, each to the smallest of the band
    keyed = full.select("set_key", F.struct("doc_id", "text_key").alias("first"), "bands")
    banded = keyed.join(entries.select("set_key", "first"), ["set_key", "first"], "left_semi").dropDuplicates(["set_key", "first"])
    banded = stored(banded.select("set_key", F.explode("bands").alias("band")), "bands")
    shared = banded.groupBy("band").agg(F.min("set_key").alias("v"), F.max("set_key").alias("top")).where("v < top").select("band", "v")
    ties = banded.join(shared, "band").where("set_key <> v").select(F.col("set_key").alias("u"), "v").distinct()
    tied = components(stars(ties))
    dropped(banded)
    groups = tied.select(F.col("node").alias("set_key"), F.xxhash64("label").alias("gid"))

    # units: pairs of blocks of a group; an entry is compared by the text of its first row
    members = groups.join(entries, "set_key").select("set_key", "gid", "copies", F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key"))
    members = stored(members, "members", counted=True)
    dropped(tied)
    near = known.where(RowFilter(members, ["doc_id", "text_key"], members.n_rows).may_hold(F.col("doc_id"), F.col("text_key")))  # few texts are shuffled
    texts = near.join(members, ["doc_id", "text_key"]).groupBy("set_key").agg(*(F.first(c).alias(c) for c in ("gid", "copies", "text")))
    texts = stored(texts, "texts")
    dropped(members)
    sizes = texts.groupBy("gid").agg(F.greatest(F.ceil(F.count("*") / block_docs), F.ceil(F.sum(F.octet_length("text")) / block_bytes)).cast("int").alias("blocks"))
    dealt = texts.join(sizes, "gid").withColumn("block", F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = dealt.select("gid", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", F.col("set_key").alias("entry"), "copies", "text")
    # a fixed number: work grows with the pairs, so small partitions aren't to be put together by their bytes
    units = units.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "gid", "lo", "hi").sortWithinPartitions("gid", "lo", "hi")
    found = stored(units.mapInArrow(_units, LINK_SCHEMA), "links")

    dropped(texts)
    linked = components(stars(found.select("u", "v")))
    classes = linked.select(F.col("node").alias("set_key"), F.col("label").alias("class"))
    links = found.groupBy(F.col("u").alias("set_key")).agg(F.sum("links").alias("links"))
    out = entries.join(classes, "set_key", "left").join(links, "set_key", "left")
    out = out.select("set_key", F.coalesce("class", "set_key").alias("class"), "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = stored(out, "classes")
    dropped(entries, found, linked)
    return out


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_docs: int = BLOCK_DOCS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, class_id, n_links): each row's class and its number of near duplicates.

    A link joins two rows whose sets of five-word shingles have a Jaccard similarity of 0.8 or more,
    copies included; classes are the connected components, named by their smallest id.  Null, empty
    and blank texts have no shingles: each is its own class without links.  Rows with a null id take no
    part and return with a null class.  Rows that repeat an id are documents of their own, whether
    their texts are equal or differ.  Texts of any length are compared whole.  An empty table returns
    no rows.  Other columns are not read.
    """
    known, sketch = _sketched(docs, id_col, text_col)
    classed = _classed(known, sketch, block_docs, block_bytes)
    names = classed.groupBy("class").agg(F.min("first.doc_id").alias("class_id"))
    named = stored(classed.join(names, "class").select("set_key", "class_id", "n_links"), "named")
    dropped(classed)
    keyed = sketch.where("set_key IS NOT NULL").select("doc_id", "set_key").join(named, "set_key").select("doc_id", "class_id", "n_links")
    blank = sketch.where("set_key IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    nameless = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id")).where("doc_id IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    return keyed.union(blank).union(nameless)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_docs: int = BLOCK_DOCS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row of each class: that with the smallest id, of equal ids that with the smallest text key.

    Rows with a null id and rows without words are no copies of anything and stay, all of them.
    Columns pass through untouched; of rows that are equal in id and text, any one stays.
    """
    known, sketch = _sketched(docs, id_col, text_col)
    classed = _classed(known, sketch, block_docs, block_bytes)
    first = classed.groupBy("class").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("__first_id"), F.col("first.text_key").alias("__first_key"))
    # rows that go, or are there more than once; the texts of all others stay where they are
    rows = sketch.where("set_key IS NOT NULL").groupBy("doc_id", "text_key").agg(F.count("*").alias("n"))
    doubtful = rows.join(first, (F.col("doc_id") == F.col("__first_id")) & (F.col("text_key") == F.col("__first_key")), "left").where("n > 1 OR __first_id IS NULL")
    doubtful = stored(doubtful.select("doc_id", "text_key"), "doubtful", counted=True)
    doubt = RowFilter(doubtful, ["doc_id", "text_key"], doubtful.n_rows)
    dropped(doubtful)
    key = "__key"
    while key in docs.columns:
        key += "_"
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    alone = ident.isNull() | text.isNull() | ~text.rlike(WORD_CLASS)
    keyed = docs.where(~alone).withColumn(key, F.unhex(F.md5(F.encode(text, "UTF-8"))))
    doubted = doubt.may_hold(ident.cast("bigint"), F.col(key))
    kept = keyed.where(doubted).join(first, (ident.cast("bigint") == F.col("__first_id")) & (F.col(key) == F.col("__first_key")), "left_semi")
    return kept.dropDuplicates([id_col, key]).union(keyed.where(~doubted)).drop(key).union(docs.where(alone))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(n - 3, 2))) AS i FROM d WHERE n > 0)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT u, v FROM p JOIN c x ON x.doc_id = u JOIN c y ON y.doc_id = v WHERE 9 * m >= 4 * (x.n + y.n)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.v FROM r JOIN e ON r.b = e.u)
SELECT doc_id, (SELECT min(b) FROM r WHERE a = doc_id) AS class_id, (SELECT count(*) FROM e WHERE u = doc_id)::BIGINT AS n_links
FROM documents
"""
