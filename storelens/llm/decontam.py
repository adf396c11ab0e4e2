"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts are compared lower-cased, with one space between words.  A benchmark item is cut into passages
of ``PASSAGE_WORDS`` and of ``PART_WORDS`` words that start at every word (a shorter item is one
passage), so a leak of ``PART_WORDS`` words counts wherever it begins, and one of more than twice as
many with any one word replaced.  A passage
of m characters has an edit budget k = ``EDIT_SHARE`` * m.  If a region of a
document is within k edits of a passage, the two share at least m + 1 - q - k * q q-grams, and the
diagonals (position in the document less position in the passage) of these differ by at most k.  So
shared q-grams are counted in bands of 2 * (k + 1) diagonals that overlap by half; every such region
has one band that holds them all.  Bands that meet the bound are verified by an alignment within the
band (passage whole, document free at both ends); the filter loses nothing.

Items of up to 2 * ``PART_WORDS`` words are also sought whole with any one word replaced: the first
or the second half is then as it was, and one automaton finds these.  An item of fewer than
``MIN_CHARS`` characters is sought word for word.

The benchmark is a query set: it's read in blocks of at most ``BLOCK_BYTES`` of text, each block is
sent to the tasks, and all documents are streamed against it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.textvec import mix, powers

Q = 12
EDIT_SHARE = 0.06
PASSAGE_WORDS = 25
PART_WORDS = 12
MIN_CHARS = 24
BLOCK_BYTES = 1 << 21
CHUNK_CHARS = 1 << 20
_BASE = 0x5851F42D4C957F2D
_FILTER_BITS = 22


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def spots_of(whole: str) -> list[list[tuple[int, int]]]:
    """Where the passages of a normalised item lie, of either number of words, in ascending order.

    Of passages with one text, the first counts.  An item of fewer than ``MIN_CHARS`` characters has
    none: it's sought word for word.
    """
    words = whole.split(" ")
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))  # of a word and the space after it
    out, seen = [], set()
    for n in (PASSAGE_WORDS, PART_WORDS):
        own = []
        for k in range(max(1, len(words) - n + 1)):
            begin, end = ends[k], ends[min(k + n, len(words))] - 1
            text = whole[begin:end]
            if text not in seen and (len(text) >= MIN_CHARS or len(words) > PART_WORDS):
                seen.add(text)
                own.append((begin, end))
        out.append(own)
    return out


def passages_of(text: str | None) -> list[str]:
    """Passages of an item."""
    whole = normal(text)
    return [whole[a:b] for own in spots_of(whole) for a, b in own]


def word_edits(a: str, b: str) -> int:
    """Edit distance of two words."""
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def budget(m: int) -> int:
    """Edits allowed in a passage of m characters; the lemma's bound stays positive."""
    return min(int(EDIT_SHARE * m), (m - Q) // Q)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(x: np.ndarray) -> np.ndarray:
    """Hash of the q characters from each position; there are len(x) - Q + 1."""
    power, inverse = powers(_BASE, len(x) + 1)
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * power[: len(x)], out=sums[1:])
    return mix((sums[Q:] - sums[:-Q]) * inverse[: len(x) + 1 - Q])


def align(passage: np.ndarray, region: np.ndarray, width: int) -> tuple[int, int, int]:
    """Least edit distance of the whole passage to a part of the region, and where the part lies.

    Only diagonals 0 to width - 1 are visited.  Of equal distances the first end is taken.
    """
    m = len(passage)
    far = np.int32(1 << 20)
    y = np.full(m + width, 0xFFFFFFFF, np.uint32)
    y[: min(len(region), m + width)] = region[: m + width]
    beyond = np.arange(m + 1)[:, None] + np.arange(width)[None, :] > len(region)  # ends past the region
    steps = np.arange(width, dtype=np.int32)
    rows = np.zeros((m + 1, width + 1), np.int32)
    rows[:, width] = far
    rows[0, :width][beyond[0]] = far
    for i in range(1, m + 1):
        before = rows[i - 1]
        now = np.minimum(before[:width] + (y[i - 1 : i - 1 + width] != passage[i - 1]), before[1:] + 1)
        now[beyond[i]] = far
        rows[i, :width] = np.minimum.accumulate(now - steps) + steps
        rows[i, :width][beyond[i]] = far
    d = int(np.argmin(rows[m, :width]))
    best, end, i = int(rows[m, d]), m + d, m
    if best >= far:
        return best, 0, 0
    while i:
        here = rows[i, d]
        if here == rows[i - 1, d] + int(y[i - 1 + d] != passage[i - 1]):
            i -= 1
        elif here == rows[i - 1, d + 1] + 1:
            i, d = i - 1, d + 1
        else:
            d -= 1
    return best, d, end


def exact(passage: np.ndarray, region: np.ndarray) -> int:
    """Where the passage first stands in the region as it is, or -1."""
    raw, sought = region.tobytes(), passage.tobytes()
    at = raw.find(sought)
    while at >= 0 and at % 4:
        at = raw.find(sought, at + 1)
    return at // 4 if at >= 0 else -1


class Benchmark:
    """Q-gram index of some items, small enough to send to every task.

    A gram is held once for its place in the item, with the ranges of passages that cover it.
    """

    def __init__(self, items: list[tuple[int, str]]):
        self.items, texts, whole_of, begins, ends = [], [], [], [], []
        covering = []  # for each gram of each item: first and last passage of either kind
        halves: dict[str, list[tuple[int, int, list[str], list[str]]]] = {}
        for key, text in items:
            whole = normal(text)
            x = codes(whole)
            own = np.arange(max(0, len(x) - Q + 1))
            ranges = []
            for spots in spots_of(whole):
                a, b = (np.array([s[e] for s in spots], np.int64) for e in (0, 1))
                ranges += [len(self.items) + np.searchsorted(b, own + Q), len(self.items) + np.searchsorted(a, own, "right")]
                self.items += [key] * len(spots)
                whole_of += [len(texts)] * len(spots)
                begins += a.tolist()
                ends += b.tolist()
            covering.append(np.array(ranges, np.int32).reshape(4, -1))
            words = whole.split(" ")
            if whole and len(words) <= 2 * PART_WORDS:
                self.items.append(key)
                whole_of.append(len(texts))
                begins.append(0)
                ends.append(0)
                cut = (len(words) + 1) // 2 if len(whole) >= MIN_CHARS and len(words) > 1 else len(words)
                for first, here, other in ((1, words[:cut], words[cut:]), (0, words[cut:], words[:cut])):
                    if here:
                        halves.setdefault(f" {' '.join(here)} ", []).append((len(self.items) - 1, first, here, other))
            texts.append(x)
        self.halves = ahocorasick.Automaton() if halves else None
        for pattern, uses in halves.items():
            self.halves.add_word(pattern, (len(pattern), uses))
        if halves:
            self.halves.make_automaton()
        self.text, self.begin = np.concatenate([np.zeros(0, np.uint32), *texts]), np.array(begins, np.int64)
        offset = np.cumsum([0, *map(len, texts)])
        self.place = offset[np.array(whole_of, np.int64)] + self.begin  # of each passage in all texts
        self.size = np.array(ends, np.int64) - self.begin
        self.k = np.array([max(0, budget(m)) for m in self.size], np.int64)
        self.bound = self.size + 1 - Q - self.k * Q
        grams = [gram_hashes(x) if len(x) >= Q else np.zeros(0, np.uint64) for x in texts]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        at = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.grams, first = np.unique(flat[order], return_index=True)
        self.first = np.append(first, len(flat))
        self.at = at[order].astype(np.int32)
        self.covering = (np.concatenate(covering, 1) if covering else np.zeros((4, 0), np.int32))[:, order]
        self.seen = np.zeros(1 << _FILTER_BITS, bool)
        self.seen[(self.grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def code(self, p: int) -> np.ndarray:
        """Code points of a passage."""
        return self.text[self.place[p] : self.place[p] + self.size[p]]

    def bands(self, x: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, passage, band) of the bands that meet the bound; texts lie end to end in x."""
        none = np.zeros(0, np.int64)
        if len(x) < Q or not len(self.grams):
            return none, none, none
        h = gram_hashes(x)
        pos = np.flatnonzero(self.seen[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        found = np.searchsorted(self.grams, h[pos])
        ok = (found < len(self.grams)) & (self.grams[np.minimum(found, len(self.grams) - 1)] == h[pos])
        pos, found = pos[ok], found[ok]
        text = np.searchsorted(edges, pos, "right") - 1
        ok = pos + Q <= edges[text + 1]  # not across two texts
        pos, found, text = pos[ok], found[ok], text[ok]
        many = self.first[found + 1] - self.first[found]
        src = np.repeat(np.arange(len(pos)), many)
        posting = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + self.first[found][src]
        owners, sources, postings = [], [], []
        for low, high in (self.covering[:2, posting], self.covering[2:, posting]):  # to the passages that cover the gram
            many = np.maximum(high - low, 0)
            which = np.repeat(np.arange(len(posting)), many)
            owners.append(np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + low[which])
            sources.append(src[which])
            postings.append(posting[which])
        owner, src, posting = np.concatenate(owners), np.concatenate(sources), np.concatenate(postings)
        diagonal = pos[src] - (self.at[posting] - self.begin[owner])
        step = self.k[owner] + 1
        shift = int(self.size.max())
        high = (diagonal + shift) // step + 1  # bands high and high - 1 hold the diagonal; shifted to be positive
        span = len(x) + 2 * shift + 4
        pair = text[src] * len(self.size) + owner
        out_pair, out_band = [], []
        key, count = np.unique(np.concatenate([pair * span + high, pair * span + high - 1]), return_counts=True)
        out_pair, out_band = key // span, key % span
        full = count >= self.bound[out_pair % len(self.size)]
        out_pair, out_band = out_pair[full], out_band[full]
        return out_pair // len(self.size), out_pair % len(self.size), out_band

    def replaced(self, x: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item's entry, start, end, distance) of whole short items with at most one word replaced."""
        for t in range(len(edges) - 1 if self.halves else 0):
            text = f" {x[edges[t] : edges[t + 1]].tobytes().decode('utf-32-le', 'surrogatepass')} "
            seen = set()
            for last, (size, uses) in self.halves.iter(text):
                begin, end = last - size + 1, last + 1  # with the space on either side
                for p, first, _, other in uses:
                    n = len(other)
                    if not n:
                        near = []
                    else:
                        near = text[end:].split(" ", n)[:n] if first else text[:begin].rsplit(" ", n)[-n:]
                    wrong = [(a, b) for a, b in zip(near, other, strict=False) if a != b]
                    if len(near) < n or len(wrong) > 1:
                        continue
                    more = sum(map(len, near)) + n
                    spot = (begin, end - 2 + more) if first else (begin - more, end - 2)
                    if (p, spot) not in seen:
                        seen.add((p, spot))
                        yield t, p, max(0, spot[0]), min(spot[1], len(text) - 2), sum(word_edits(a, b) for a, b in wrong)

    def regions(self, x: np.ndarray, edges: np.ndarray, one: bool = False) -> list[tuple[int, int, int, int, int]]:
        """(text, passage, start, end, distance) of the regions within budget, one for overlapping ones.

        With ``one`` a text's search ends with its first region.
        """
        best: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        found = set()
        for t, p, start, end, distance in self.replaced(x, edges):
            best.setdefault((t, p), []).append((distance, start, end))
            found.add(t)
        shift = int(self.size.max()) if len(self.size) else 0
        for t, p, band in zip(*(a.tolist() for a in self.bands(x, edges)), strict=True):
            if one and t in found:
                continue
            k, m = int(self.k[p]), int(self.size[p])
            low = (band - 1) * (k + 1) - shift  # first diagonal of the band
            start, stop = int(edges[t]), int(edges[t + 1])
            begin = max(start, low - k)
            width = low + 2 * (k + 1) + k - begin
            if width < 1:
                continue
            region = x[begin : min(stop, begin + m + width)]
            a = exact(self.code(p), region)
            distance, a, b = (0, a, a + m) if a >= 0 else align(self.code(p), region, width)
            if distance > k:
                continue
            found.add(t)
            spot = (distance, begin - start + a, begin - start + b)
            kept = best.setdefault((t, p), [])
            clash = [s for s in kept if s[1] < spot[2] and spot[1] < s[2]]
            if not clash or spot < min(clash):
                best[t, p] = [s for s in kept if s not in clash] + [spot]
        return [(t, p, s[1], s[2], s[0]) for (t, p), spots in best.items() for s in sorted(spots, key=lambda s: s[1])]


def _chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, code points of some texts end to end, where each starts)."""
    begin, parts, total = 0, [], 0
    for i in range(len(column)):
        parts.append(codes(normal(column[i].as_py())))
        total += len(parts[-1])
        if total >= CHUNK_CHARS or i + 1 == len(column):
            yield begin, np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            begin, parts, total = i + 1, [], 0


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of about ``block_bytes``, read one at a time."""
    rows = benchmark.select(F.col(f"`{id_col}`").cast("bigint"), F.col(f"`{text_col}`")).where(F.col(f"`{text_col}`").isNotNull())
    block, size = [], 0
    for key, text in rows.toLocalIterator():
        block.append((key, text))
        size += len(text.encode("utf-8", "replace"))
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


REGION_SCHEMA = "doc_id bigint, item_id bigint, passage int, start int, end int, distance int"


def leaked_regions(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, passage, start, end, distance): regions of documents near to a benchmark passage.

    Start and end count characters of the normalised text.  Null and blank texts and an empty
    benchmark give no rows; null ids stay null; repeated rows give repeated rows.
    """
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    out = docs.sparkSession.createDataFrame([], REGION_SCHEMA)
    for block in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(Benchmark(block))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            number = np.zeros(len(index.items), int)  # of each passage within its item
            for p in range(1, len(index.items)):
                number[p] = number[p - 1] + 1 if index.items[p] == index.items[p - 1] else 0
            for batch in batches:
                for begin, x, edges in _chunks(batch.column(1)):
                    rows = index.regions(x, edges)
                    col = list(zip(*rows, strict=True)) if rows else [()] * 5
                    ids = batch.column(0).take(pa.array([begin + t for t in col[0]], pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array([index.items[p] for p in col[1]], pa.int64()), pa.array([int(number[p]) for p in col[1]], pa.int32()), *(pa.array(c, pa.int32()) for c in col[2:])],
                        ["doc_id", "item_id", "passage", "start", "end", "distance"],
                    )

        out = out.union(texts.mapInArrow(scan, REGION_SCHEMA))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_regions, distance): items that leaked into documents, and the nearest region's edits.

    Null and blank texts, null items and an empty benchmark or table give no rows; a text of any length
    is searched whole; rows that repeat an id are counted together; null ids stay null; items that
    repeat an id are one item; columns other than ids and texts aren't read.
    """
    return leaked_regions(docs, benchmark).groupBy("doc_id", "item_id").agg(F.count("*").alias("n_regions"), F.min("distance").alias("distance"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no benchmark passage is found, with their columns as they are.

    Null and blank texts stay; repeated rows are judged alike; with an empty benchmark all rows stay.
    """
    out = docs
    column = docs.columns.index(text_col)
    for block in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(Benchmark(block))

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for begin, x, edges in _chunks(batch.column(column)):
                    for t, *_ in shared.value.regions(x, edges, one=True):
                        clean[begin + t] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(keep, docs.schema)
    return out
