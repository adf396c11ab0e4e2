"""Byte-level BPE ids of whole texts, by the tokenizers library, one call for each distinct piece.

A piece is a run of white space with what follows it up to the next run; the first piece of a text
may have no white space.  A byte-level BPE's pattern never takes white space after anything else, so
it has a token boundary wherever a piece begins, and looks no further ahead than the white space: the
ids of a text are those of its pieces, one after another.  Pieces begin at ASCII white space after a
character that is surely none, so other white space never begins one and the argument stays exact.

Pieces are found, hashed and looked up for a whole buffer of texts at once.  A hash only proposes an
entry; its bytes are compared, and a piece that differs goes to the library itself.
"""

from __future__ import annotations

import os

import numpy as np

from storelens.llm.textvec import hash_ranges

CACHED_PIECES, CACHED_LENGTH = 2_500_000, 48
SLOTS, SHIFT, PROBES = 1 << 22, np.uint64(42), 16
JOINED = 100
PART = 1 << 15  # pieces that are put together at a time

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_IS_SOLID = np.zeros(256, bool)
_IS_SOLID[0x21:0x7F] = True
_IS_SOLID[0x80:] = True
#: How white space beyond ASCII ends in UTF-8: U+0085, U+00A0, U+1680, U+2000-200A, 2028, 2029, 202F, 205F, 3000.
_SPACE_ENDS = np.zeros(256, bool)
_SPACE_ENDS[[0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F]] = True
_SPACE_HEADS = {0xE19A, 0xE280, 0xE281, 0xE380}


def starts_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin; every text that isn't empty begins one."""
    space = _IS_SPACE[data]
    cut = np.zeros(len(data), bool)
    cut[1:] = space[1:] & _IS_SOLID[data[:-1]]
    doubtful = np.flatnonzero(cut[1:] & _SPACE_ENDS[data[:-1]]) + 1
    two = data[np.maximum(doubtful - 2, 0)].astype(np.int64)
    three = data[np.maximum(doubtful - 3, 0)].astype(np.int64) << 8 | two
    cut[doubtful[(two == 0xC2) | np.isin(three, list(_SPACE_HEADS))]] = False
    begins = offsets[:-1][np.diff(offsets) > 0]
    cut[begins] = True
    return np.flatnonzero(cut)


def spread(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (length[0] numbers), then first[1], ..."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + length, length)


class PieceTokenizer:
    """Encodes buffers of texts; keeps the ids of short pieces it has seen.

    The memory is bounded: beyond ``CACHED_PIECES`` pieces it starts anew.  With ``literal`` the text
    of a special token is encoded like any other; without, it gives the token's id, as the library does.
    """

    def __init__(self, path: str, literal: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        vocabulary = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes that an id stands for
        for token, i in vocabulary.items():
            self.width[i] = len(token)
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            self.width[i] = len(token.content.encode())
        self._forget()

    def _forget(self) -> None:
        self.table = np.full(SLOTS + PROBES, -1, np.int32)  # open addressing: entry numbers
        self.entries = 0
        # for each entry its hash, and where its bytes and ids begin; they end where the next one's begin.  Memory
        # that isn't written takes none, so there is room for many entries from the start
        self.keys = np.empty(CACHED_PIECES, np.uint64)
        self.at_bytes, self.at_ids = np.zeros(CACHED_PIECES + 1, np.uint32), np.zeros(CACHED_PIECES + 1, np.uint32)
        self.bytes = np.empty(16 * CACHED_PIECES, np.uint8)
        self.ids = np.empty(8 * CACHED_PIECES, np.uint16 if len(self.width) <= 1 << 16 else np.uint32)

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        """Write ``values`` at ``at`` of an array, which is made longer if need be."""
        room = getattr(self, name)
        if at + len(values) > len(room):
            longer = np.empty(max(at + len(values), len(room) + len(room) // 4), room.dtype)
            longer[:at] = room[:at]
            setattr(self, name, room := longer)
        room[at : at + len(values)] = values

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Entry number of each key, -1 for an unknown one."""
        out = np.full(len(keys), -1, np.int64)
        if not self.entries:
            return out
        left, slot = np.arange(len(keys)), (keys >> SHIFT).astype(np.int64)
        for _ in range(PROBES):
            entry = self.table[slot]
            hit = self.keys[entry] == keys[left]
            hit &= entry >= 0
            out[left[hit]] = entry[hit]
            go = ~hit & (entry >= 0)
            left, slot = left[go], slot[go] + 1
            if not len(left):
                break
        return out

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """A free slot of each of the new, distinct keys, which is marked; -1 where there is none near."""
        left, slot = np.arange(len(keys)), (keys >> SHIFT).astype(np.int64)
        placed = np.full(len(keys), -1, np.int64)
        for _ in range(PROBES):
            free = self.table[slot] < 0
            self.table[slot[free]] = -2 - left[free]  # of several for one slot, one stays
            won = self.table[slot] == -2 - left
            placed[left[won]] = slot[won]
            left, slot = left[~won], slot[~won] + 1
        return placed

    def _library(self, pieces: list[bytes]) -> list[list[int]]:
        texts = [p.decode("utf-8", "replace") for p in pieces]
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, pieces: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of ids of each piece).

        Pieces between which the library would cut anyway are joined, as a call costs more than a piece;
        the ids are dealt out by the bytes that each stands for.
        """
        if not pieces:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        ends = np.cumsum(size)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        last = raw[ends - 1]
        apart = np.ones(len(pieces), bool)  # whether a piece begins a call
        apart[1:] = ~(_IS_SPACE[raw[ends[:-1]]] & _IS_SOLID[last[:-1]] & ~_SPACE_ENDS[last[:-1]])
        apart[::JOINED] = True
        first = np.flatnonzero(apart)
        cuts = [0, *ends[first[1:] - 1].tolist(), len(raw)]
        whole = raw.tobytes()
        made = self._library([whole[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        ids = np.fromiter((i for x in made for i in x), np.uint32)
        sums = np.cumsum(self.width[ids])
        spot = np.searchsorted(sums, ends)
        if len(sums) and sums[-1] == len(raw) and (sums[spot] == ends).all():
            return ids, np.diff(np.concatenate([[0], spot + 1]))
        made = self._library(pieces)
        return np.fromiter((i for x in made for i in x), np.uint32), np.fromiter(map(len, made), np.int64, len(made))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of ids of each text)."""
        starts = starts_of(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        length = np.diff(np.append(starts, len(data)))
        hashes = hash_ranges(data, starts, starts + length)
        which = self._find(hashes)
        unknown = np.flatnonzero(which < 0)
        keys, example, number = np.unique(hashes[unknown], return_index=True, return_inverse=True)

        # new entries: first those that stay, then the others, which go when the texts are encoded
        size = length[unknown[example]]
        short = np.flatnonzero(size <= CACHED_LENGTH)
        full = self.entries + len(short) > CACHED_PIECES
        slot = np.full(len(keys), -1, np.int64)
        if not full:
            slot[short] = self._slots(keys[short])
        order = np.argsort(slot < 0, kind="stable")
        stay = np.count_nonzero(slot >= 0)
        rank = np.empty(len(keys), np.int64)
        rank[order] = self.entries + np.arange(len(keys))
        which[unknown] = rank[number]
        self.table[slot[order[:stay]]] = rank[order[:stay]]

        raw = data.tobytes()
        begin, size = starts[unknown[example[order]]], size[order]
        made, many = self._new([raw[a : a + n] for a, n in zip(begin.tolist(), size.tolist(), strict=True)], size)
        for name, values, n in (("bytes", data[spread(begin, size)], size), ("ids", made, many)):
            at = int(getattr(self, f"at_{name}")[self.entries])
            self._put(name, at, values)
            self._put(f"at_{name}", self.entries + 1, at + np.cumsum(n))
        self._put("keys", self.entries, keys[order])

        # pieces lie end to end, so do the bytes of their entries
        count, same, out = np.empty(len(starts), np.int64), True, []
        for i in range(0, len(starts), PART):
            entry, size = which[i : i + PART], length[i : i + PART]
            first, n = self.at_ids[entry].astype(np.int64), self.at_ids[entry + 1].astype(np.int64)
            n -= first
            first_byte = self.at_bytes[entry].astype(np.int64)
            same = (self.at_bytes[entry + 1] - first_byte == size).all() and (self.bytes[spread(first_byte, size)] == data[starts[i] : starts[i] + size.sum()]).all()
            if not same:
                break
            count[i : i + PART] = n
            out.append(self.ids[spread(first, n)].astype(np.uint32))
        if not same:  # two pieces with one hash in this buffer or the memory: the library encodes the texts anew
            whole = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            made = self._library(whole)
            self._forget()
            return np.fromiter((i for x in made for i in x), np.uint32), np.fromiter(map(len, made), np.int64, len(made))
        sums = np.concatenate([[0], np.cumsum(count)])
        per_text = np.diff(sums[np.searchsorted(starts, offsets)])
        self.entries += stay
        if full or len(self.bytes) > 32 * CACHED_PIECES:
            self._forget()
        return np.concatenate(out), per_text
