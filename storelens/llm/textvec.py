"""Vectorised words, word hashes and n-word hashes over the byte buffer of an Arrow column.

A hash of a byte range is a difference of prefix sums of ``table[byte] * BASE**position``, brought
back to position 0 by the inverse power and mixed.  So each text is hashed in a few passes over the
buffer, without a Python loop over words, and equal ranges have equal 64-bit hashes.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, WORD_BASE, OTHER_BASE = (int(x) * 8 + 5 for x in _rng.integers(1, 2**60, 3, dtype=np.uint64))
PART, KEPT = 1 << 20, 1 << 22
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n; base is odd."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        out = []
        for b in (base % 2**64, pow(base, -1, 2**64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            out.append(np.cumprod(steps, dtype=np.uint64))
        have = (out[0], out[1])
        if size <= KEPT:
            _powers[base] = have
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; ranges are in order and apart.

    A hash doesn't depend on the position, so a long buffer is hashed in parts of about ``PART`` bytes.
    """
    out, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + PART)))
        begin, end = int(starts[i]), int(ends[j - 1])
        power, inverse = powers(_BASE, end - begin + 1)
        sums = np.zeros(end - begin + 1, np.uint64)
        np.cumsum(_BYTE[data[begin:end]] * power[: end - begin], out=sums[1:])
        a = starts[i:j] - begin
        out[i:j] = mix((sums[ends[i:j] - begin] - sums[a]) * inverse[a])
        i = j
    return out


class Words:
    """The words of some texts: byte ranges, the text each is in, and the first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self._hashes = data, offsets, None
        inside = ~IS_SPACE[data]
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        edges = offsets[1:-1]
        edges = edges[edges < len(data)]
        before[edges] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        after[edges[edges > 0] - 1] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)  # of each text, and the number of words
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(len(offsets) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return hash_ranges(self.data, self.starts, self.ends)

    def runs(self, length: int, shorter: bool = False, base: int = WORD_BASE) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each run of ``length`` consecutive words within a text.

        With ``shorter``, a text of fewer words (but one) has one run of them all.
        """
        if self._hashes is None:
            self._hashes = self.hashes()
        hashes = self._hashes
        n = len(hashes)
        power, inverse = powers(base, n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * power[:n], out=sums[1:])
        at = np.arange(n)
        last = self.first[1:][self.text]
        whole = at + length <= last
        if shorter:
            whole |= at == self.first[:-1][self.text]
        at = at[whole]
        end = np.minimum(at + length, last[whole])
        return at, mix((sums[end] - sums[at]) * inverse[at])
