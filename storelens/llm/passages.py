"""Repeated-phrase automata: find, remove and locate passages that recur word for word.

A window is ``WINDOW`` consecutive words; it recurs when its word sequence starts anywhere else.

1. Anchors.  Of every window's ``WINDOW - GRAM + 1`` short runs of ``GRAM`` words, the one with the
   smallest hash is its anchor.  Equal windows have equal anchors, so a window can recur only if its
   anchor's hash occurs at two places.  Anchors are about a fourteenth of all positions.
2. Confirmation.  Windows whose anchor recurs are counted by a 96-bit hash.
3. Automata.  Each recurring window goes to the first place that holds it; ``SHARD_WINDOWS`` places of
   a text are one shard, whose windows are compiled into an Aho-Corasick automaton over words.  The
   part of each text that may hold windows of a shard is streamed through the shard's automaton,
   which gives every occurrence, by words and not by hashes; nothing else removes a word.  Parts for a
   shard are dealt into blocks of bounded number, each with the shard's patterns, so a passage in many
   texts isn't one task, and neither a long text nor a common passage makes a large automaton.

Texts with equal words are streamed once; every window of a text that occurs twice recurs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import CHUNK_BYTES, dropped, grouped, slices, stored, text_buffer
from storelens.llm.textvec import OTHER_BASE, Words

WINDOW, GRAM = 35, 8
SHARD_WINDOWS = 4096
BLOCK_TEXTS = 256
_TOP = np.uint64(2**64 - 1)


def _words(raw: np.ndarray) -> list[bytes]:
    return raw.tobytes().split()


def _sha(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def _slide(x: np.ndarray, width: int, best, pad) -> np.ndarray:
    """best of x[i], ..., x[i + width - 1]."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        moved = np.full_like(out, pad)
        moved[:-step or None] = out[step:]
        out = best(out, moved)
        have += step
    return out


def anchors(words: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the short run at each word; smallest hash in each window, 0 where none starts; mask of anchors."""
    n = len(words.starts)
    x = np.full(n, _TOP)
    at, hashes = words.runs(gram)
    x[at] = hashes
    least = _slide(x, window - gram + 1, np.minimum, _TOP)
    least[np.arange(n) + window > words.first[1:][words.text]] = 0
    top = _slide(least[::-1], window - gram + 1, np.maximum, 0)[::-1]
    return x, least, (top == x) & (top > 0)


SCAN_SCHEMA = "doc_id bigint, hid bigint, text_key binary, n_words bigint, sha binary, anchors array<bigint>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffer(batch.column(3))
        for i, j in slices(offsets):
            raw, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            shas = [_sha(_words(raw[a:b])) for a, b in zip(off[:-1], off[1:], strict=True)]
            words = Words(raw, off)
            x, _, chosen = anchors(words)
            ends = np.zeros(j - i + 1, np.int32)
            ends[1:] = np.cumsum(np.bincount(words.text[chosen], minlength=j - i))
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(x[chosen].view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(3)), pa.array(words.counts, pa.int64()), pa.array(shas, pa.binary()), lists], ["doc_id", "hid", "text_key", "n_words", "sha", "anchors"])


WINDOW_SCHEMA = "h bigint, g int, tid bigint, i int, many boolean"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows whose anchor recurs, of (tid, many, text, anchors) rows."""
    for batch in batches:
        tids = batch.column(0).to_numpy()
        many = batch.column(1).to_numpy(zero_copy_only=False)
        data, offsets = text_buffer(batch.column(2))
        for i, j in slices(offsets):
            words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            _, least, _ = anchors(words)
            known = np.unique(batch.column(3).slice(i, j - i).flatten().to_numpy().view(np.uint64))
            at, h = words.runs(WINDOW)
            _, g = words.runs(WINDOW, base=OTHER_BASE)
            here = np.isin(least[at], known)
            at = at[here]
            text = words.text[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[here].view(np.int64)), pa.array((g[here] >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(tids[i:j][text]), pa.array((at - words.first[text]).astype(np.int32)), pa.array(many[i:j][text])],
                ["h", "g", "tid", "i", "many"],
            )


class Automaton:
    """An Aho-Corasick automaton over words: finds every occurrence of equally long phrases."""

    def __init__(self, words: list[bytes], starts: list[int], window: int = WINDOW):
        self.window = window
        self.number: dict[bytes, int] = {}
        ids = tuple(self.number.setdefault(w, len(self.number) + 1) for w in words)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
        for i in starts:
            self.machine.add_word(ids[i : i + window])
        self.machine.make_automaton()

    def covered(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Word ranges that occurrences cover, merged."""
        get = self.number.get
        out: list[tuple[int, int]] = []
        for end, _ in self.machine.iter(tuple([get(w, 0) for w in words])):
            start = end - self.window + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], end + 1)
            else:
                out.append((start, end + 1))
        return out


DEALT_SCHEMA = "shard bigint, part int, block int, kind int, tid bigint, low int, text string, at array<int>"


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of (tid, text, parts) rows for their shards; a shard's own text gives its patterns (kind 0)."""
    schema = pa.schema([("shard", pa.int64()), ("part", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()), ("tid", pa.int64()), ("low", pa.int32()), ("text", pa.string()), ("at", pa.list_(pa.int32()))])
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        for k, tid in enumerate(batch.column(0).to_pylist()):
            words = _words(data[offsets[k] : offsets[k + 1]])
            out, size = [], 0
            for p in batch.column(2)[k].as_py():
                low = p["low"]
                text = b" ".join(words[low : p["high"] + WINDOW]).decode("utf-8", "surrogateescape")
                out.append((p["shard"], p["part"], p["block"], 1, tid, low, text, None))
                size += len(text)
                if tid == p["shard"]:
                    at = [x - low for x in p["at"]]
                    out += [(tid, p["part"], b, 0, tid, low, text, at) for b in range(p["blocks"])]
                if size > CHUNK_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


FOUND_SCHEMA = "tid bigint, starts array<int>, ends array<int>"


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shard, part, block, kind): first the shard's patterns (kind 0), then parts of texts."""
    for t in grouped(batches, ("shard", "part", "block")):
        data, offsets = text_buffer(t.column("text"))
        kinds = t.column("kind").to_pylist()
        texts = [_words(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        machine = Automaton(texts[0], t.column("at")[0].as_py())
        rows = [(tid, low, machine.covered(w)) for tid, low, w, kind in zip(t.column("tid").to_pylist(), t.column("low").to_pylist(), texts, kinds, strict=True) if kind]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([[r[1] + x for x, _ in r[2]] for r in rows], pa.list_(pa.int32())), pa.array([[r[1] + x for _, x in r[2]] for r in rows], pa.list_(pa.int32()))],
            ["tid", "starts", "ends"],
        )


CUT_SCHEMA = "tid bigint, n_removed bigint, kept binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of (tid, text, spans) rows."""
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        out = []
        for k, (tid, spans) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            words = _words(data[offsets[k] : offsets[k + 1]])
            gone = np.zeros(len(words), bool)
            for s in spans:
                gone[s["a"] : s["b"]] = True
            out.append((tid, int(gone.sum()), _sha([w for w, g in zip(words, gone.tolist(), strict=True) if not g])))
        yield pa.RecordBatch.from_pylist([dict(zip(("tid", "n_removed", "kept"), r, strict=True)) for r in out], pa.schema([("tid", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())]))


def located(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_texts: int = BLOCK_TEXTS, shard_windows: int = SHARD_WINDOWS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The scan of all rows; distinct texts; texts that may hold recurring windows; the word spans these cover.

    A text is named by ``tid``, a number that its place in the written table of distinct texts gives
    it; texts are distinct by the SHA-256 of their words.
    """
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.xxhash64("text")).alias("hid"), F.unhex(F.md5(F.encode("text", "UTF-8"))).alias("text_key"), "text")
    scan = rows.mapInArrow(_scan, SCAN_SCHEMA).withColumn("row", F.monotonically_increasing_id())
    scan = stored(scan, "scan")
    texts = scan.where(F.col("n_words") >= WINDOW).groupBy("sha").agg(F.min("row").alias("row"), F.count("*").alias("copies"))
    texts = stored(texts.withColumn("tid", F.monotonically_increasing_id()), "texts")

    one = scan.select("row", "hid", "text_key", "anchors").join(texts.select("row", "tid", (F.col("copies") > 1).alias("many")), "row")
    one = stored(one, "one")
    placed = one.select("tid", "many", F.explode("anchors").alias("anchor"))
    # written before it's joined: a join of two shuffles can split a hot key, one with an aggregate can't
    twice = placed.groupBy("anchor").agg(F.count("*").alias("n"), F.max("many").alias("many")).where("n > 1 OR many").select("anchor")
    twice = stored(twice, "twice")
    wanted = placed.join(twice, "anchor").groupBy("tid").agg(F.collect_set("anchor").alias("anchors"))
    wanted = stored(wanted.join(one.select("tid", "many", "hid", "text_key"), "tid"), "wanted")
    dropped(one, twice)
    chosen = wanted.join(rows.select("hid", "text_key", "text"), ["hid", "text_key"]).select("tid", "many", "text", "anchors")
    if not scan.groupBy("hid", "text_key").count().where("count > 1").isEmpty():  # rows that repeat whole
        chosen = chosen.groupBy("tid").agg(*(F.first(c).alias(c) for c in ("many", "text", "anchors")))
    chosen = stored(chosen, "chosen")

    dropped(wanted)
    windows = stored(chosen.mapInArrow(_windows, WINDOW_SCHEMA), "windows")
    place = F.struct("tid", "i")
    confirmed = windows.groupBy("h", "g").agg(F.min(place).alias("p"), F.max(place).alias("q"), F.max("many").alias("many")).where("p <> q OR many")
    confirmed = confirmed.select("h", "g", F.col("p.tid").alias("shard"), F.floor(F.col("p.i") / shard_windows).cast("int").alias("part"), F.col("p.i").alias("first"))
    confirmed = stored(confirmed, "confirmed")

    patterns = confirmed.groupBy("shard", "part").agg(F.sort_array(F.collect_set("first")).alias("at"))
    members = windows.join(confirmed, ["h", "g"]).groupBy("shard", "part", "tid").agg(F.min("i").alias("low"), F.max("i").alias("high"))
    members = stored(members, "members")
    dropped(windows)
    blocks = members.groupBy("shard", "part").agg(F.ceil(F.count("*") / block_texts).cast("int").alias("blocks"))
    blocks = stored(blocks.join(patterns, ["shard", "part"]), "blocks")
    own = F.when(F.col("shard") == F.col("tid"), F.col("at")).alias("at")  # patterns go with their own text
    parts = members.join(blocks, ["shard", "part"]).select("tid", F.struct("shard", "part", F.pmod(F.xxhash64("tid"), "blocks").cast("int").alias("block"), "blocks", "low", "high", own).alias("p"))
    parts = parts.groupBy("tid").agg(F.collect_list("p").alias("parts")).join(chosen.select("tid", "text"), "tid").select("tid", "text", "parts")
    dealt = parts.mapInArrow(_deal, DEALT_SCHEMA).repartition("shard", "part", "block").sortWithinPartitions("shard", "part", "block", "kind")
    found = dealt.mapInArrow(_locate, FOUND_SCHEMA)
    spans = found.select("tid", F.explode(F.arrays_zip(F.col("starts").alias("a"), F.col("ends").alias("b"))).alias("span"))
    spans = stored(spans.groupBy("tid").agg(F.collect_list("span").alias("spans")), "spans")
    dropped(confirmed, members, blocks)
    return scan, texts, chosen, spans


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row, repeated windows taken out.

    A null or blank text has no words; a text of fewer than 35 words has no window and stays whole;
    one of any length is searched whole.  Repeated rows are copies, whatever their ids; rows that
    repeat an id with other texts are documents of their own; null ids stay null; an empty table gives
    no rows.  Other columns are not read.
    """
    scan, texts, chosen, spans = located(docs, id_col, text_col)
    cut = chosen.select("tid", "text").join(spans, "tid").mapInArrow(_cut, CUT_SCHEMA)
    cut = stored(cut.join(texts.select("tid", "sha"), "tid").select(F.col("sha").alias("s"), "n_removed", "kept"), "cut")
    dropped(texts, chosen, spans)
    made = scan.join(cut, F.col("sha") == F.col("s"), "left")
    return made.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"), F.lower(F.hex(F.coalesce("kept", "sha"))).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT k, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS s
      FROM (SELECT k, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY s) AS n FROM g) WHERE n > 1),
c AS (SELECT DISTINCT k, i + j AS p FROM r, (SELECT unnest(range(0, 35)) AS j)),
e AS (SELECT k, list(p) AS gone FROM c GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(list_filter(w, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)), ' '), '')) AS kept_sha256
FROM d LEFT JOIN e USING (k)
"""
