"""Reading a Git object database: loose files, pack indexes, packs, commit-graphs.

By the formats' public descriptions (gitformat-pack, gitformat-commit-graph).
"""

from __future__ import annotations

import hashlib
import mmap
import os
import re
import struct
import zlib
from collections import OrderedDict
from dataclasses import dataclass

import numpy as np

TYPES = {1: "commit", 2: "tree", 3: "blob", 4: "tag", 6: "ofs_delta", 7: "ref_delta"}
CACHE_BYTES = 64 << 20
MAX_DEPTH = 4096


class Corrupt(Exception):
    """A file that isn't what its format asks for."""


class Unsupported(Exception):
    """A version or feature that isn't read."""


# --- object contents -----------------------------------------------------------------------------


def parse_object_header(raw: bytes) -> tuple[str, int, int]:
    """(type, size, length of the header) of an inflated loose object."""
    end = raw.find(b"\0")
    m = re.fullmatch(rb"(commit|tree|blob|tag) ([0-9]+)", raw[:end]) if end > 0 else None
    if not m:
        raise Corrupt("bad object header")
    return m[1].decode(), int(m[2]), end + 1


def _signature(line: bytes) -> tuple[str, int | None]:
    ident, close, rest = line.rpartition(b">")
    m = re.match(rb" *(-?[0-9]+)", rest)
    return (ident + close or line).decode(errors="replace"), int(m[1]) if m else None


def parse_commit(raw: bytes) -> dict:
    head, _, message = raw.partition(b"\n\n")
    out: dict = {"tree": None, "parents": [], "author_ident": None, "author_ts": None, "committer_ts": None, "message": message.decode(errors="replace")}
    for line in head.split(b"\n"):
        key, _, value = line.partition(b" ")
        if key == b"tree" and out["tree"] is None:
            out["tree"] = bytes.fromhex(value.decode())
        elif key == b"parent":
            out["parents"].append(bytes.fromhex(value.decode()))
        elif key == b"author":
            out["author_ident"], out["author_ts"] = _signature(value)
        elif key == b"committer":
            out["committer_ts"] = _signature(value)[1]
    if out["tree"] is None:
        raise Corrupt("a commit without a tree")
    return out


def parse_tag(raw: bytes) -> dict:
    head = dict(line.partition(b" ")[::2] for line in reversed(raw.partition(b"\n\n")[0].split(b"\n")))
    if b"object" not in head:
        raise Corrupt("a tag without an object")
    text = lambda k: head[k].decode(errors="replace") if k in head else None
    return {"object": bytes.fromhex(head[b"object"].decode()), "object_type": text(b"type"), "name": text(b"tag"), "tagger": _signature(head[b"tagger"])[0] if b"tagger" in head else None}


def entry_kind(mode: int) -> str:
    return {0o040000: "tree", 0o100000: "blob", 0o160000: "submodule"}.get(mode & 0o170000, "other")


def parse_tree(raw: bytes, width: int) -> list[tuple[int, str, bytes, bytes]]:
    """(mode, kind, name, oid) of each entry, in order."""
    out, at = [], 0
    while at < len(raw):
        space, end = raw.find(b" ", at), raw.find(b"\0", at)
        if not at < space < end or end + 1 + width > len(raw):
            raise Corrupt("bad tree entry")
        mode = int(raw[at:space], 8)
        out.append((mode, entry_kind(mode), raw[space + 1 : end], raw[end + 1 : end + 1 + width]))
        at = end + 1 + width
    return out


# --- deltas --------------------------------------------------------------------------------------


def varint(data: bytes, at: int) -> tuple[int, int]:
    """(value, next position), seven bits a byte, low ones first."""
    value = shift = 0
    while True:
        if at >= len(data):
            raise Corrupt("a number ends early")
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if not b & 128:
            return value, at


def apply_delta(base: bytes, delta: bytes) -> bytes:
    size, at = varint(delta, 0)
    wanted, at = varint(delta, at)
    if size != len(base):
        raise Corrupt("a delta for another base")
    out = bytearray()
    while at < len(delta):
        op = delta[at]
        at += 1
        if op & 128:
            numbers = []
            for bits, width in ((op & 15, 4), (op >> 4 & 7, 3)):
                value = 0
                for k in range(width):
                    if bits >> k & 1:
                        value |= delta[at] << 8 * k
                        at += 1
                numbers.append(value)
            start, length = numbers[0], numbers[1] or 0x10000
            if start + length > len(base):
                raise Corrupt("a copy beyond the base")
            out += base[start : start + length]
        elif op:
            out += delta[at : at + op]
            at += op
        else:
            raise Corrupt("a reserved delta instruction")
    if len(out) != wanted:
        raise Corrupt("a delta of another size")
    return bytes(out)


# --- packs ---------------------------------------------------------------------------------------


def mapped(path: str) -> mmap.mmap:
    with open(path, "rb") as f:
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)


@dataclass(frozen=True)
class PackIndex:
    """Version 2 index: ids (n x width bytes) in order and the offset of each."""

    oids: np.ndarray
    offsets: np.ndarray

    @classmethod
    def read(cls, data, width: int) -> PackIndex:
        if len(data) < 8 or data[:4] != b"\xfftOc":
            raise Unsupported("not a version 2 pack index")
        if struct.unpack(">I", data[4:8])[0] != 2:
            raise Unsupported("pack index version")
        fanout = np.frombuffer(data, ">u4", 256, 8)
        n = int(fanout[255])
        if (np.diff(fanout.astype(np.int64)) < 0).any() or len(data) < 1032 + n * (width + 8) + 2 * width:
            raise Corrupt("bad pack index")
        oids = np.frombuffer(data, np.uint8, n * width, 1032).reshape(n, width)
        small = np.frombuffer(data, ">u4", n, 1032 + n * (width + 4)).astype(np.int64)
        large = small >> 31 == 1
        if large.any():
            table = 1032 + n * (width + 8)
            count = (len(data) - 2 * width - table) // 8
            wide = np.frombuffer(data, ">u8", count, table).astype(np.int64)
            at = small[large] & 0x7FFFFFFF
            if (at >= count).any():
                raise Corrupt("an offset beyond the index")
            small[large] = wide[at]
        return cls(oids, small)

    def find(self, oid: bytes) -> int | None:
        lo, hi = 0, len(self.oids)
        while lo < hi:
            mid = (lo + hi) // 2
            if self.oids[mid].tobytes() < oid:
                lo = mid + 1
            else:
                hi = mid
        return int(self.offsets[lo]) if lo < len(self.oids) and self.oids[lo].tobytes() == oid else None


@dataclass(frozen=True)
class Entry:
    kind: int
    size: int
    data: int  # where the compressed bytes begin
    base: int | None  # offset of the delta's base


class Pack:
    """A pack with its index; keeps recent bases within ``CACHE_BYTES``."""

    def __init__(self, stem: str, width: int):
        self.width, self.data = width, mapped(stem + ".pack")
        self.index = PackIndex.read(mapped(stem + ".idx"), width)
        if self.data[:4] != b"PACK" or struct.unpack(">I", self.data[4:8])[0] not in (2, 3):
            raise Unsupported("not a version 2 or 3 pack")
        if struct.unpack(">I", self.data[8:12])[0] != len(self.index.oids):
            raise Corrupt("the index doesn't fit its pack")
        self.known: dict[int, tuple[str, int, int]] = {}
        self.payloads: OrderedDict[int, bytes] = OrderedDict()
        self.cached = 0

    def entry(self, offset: int) -> Entry:
        data, at = self.data, offset
        b = data[at]
        kind, size, shift = b >> 4 & 7, b & 15, 4
        while b & 128:
            at += 1
            b = data[at]
            size |= (b & 127) << shift
            shift += 7
        at += 1
        base = None
        if kind == 6:
            b = data[at]
            back = b & 127
            while b & 128:
                at += 1
                b = data[at]
                back = (back + 1 << 7) | (b & 127)
            at += 1
            base = offset - back
            if not 0 < base < offset:
                raise Corrupt("a delta base out of the pack")
        elif kind == 7:
            base = self.index.find(data[at : at + self.width])
            if base is None:
                raise Unsupported("a delta whose base is in another pack")
            at += self.width
        elif kind not in TYPES:
            raise Corrupt("an unknown object type")
        return Entry(kind, size, at, base)

    def _inflate(self, entry: Entry, most: int = 0) -> bytes:
        machine = zlib.decompressobj()
        try:
            if most:
                return machine.decompress(self.data[entry.data : entry.data + 256], most)
            out, at = bytearray(), entry.data
            while not machine.eof:
                block = self.data[at : at + (1 << 16)]
                if not block:
                    raise Corrupt("the pack ends within an object")
                out += machine.decompress(block)
                at += len(block)
        except zlib.error as e:
            raise Corrupt(str(e)) from e
        if len(out) != entry.size:
            raise Corrupt("an object of another size")
        return bytes(out)

    def info(self, offset: int) -> tuple[str, int, int]:
        """(type, size, delta depth); each header is read once, payloads aren't inflated."""
        chain, at = [], offset
        while at not in self.known:
            e = self.entry(at)
            if e.base is None:
                self.known[at] = (TYPES[e.kind], e.size, 0)
                break
            head = self._inflate(e, 32)
            chain.append((at, varint(head, varint(head, 0)[1])[0]))
            if len(chain) > MAX_DEPTH:
                raise Corrupt("too long a delta chain")
            at = e.base
        for here, size in reversed(chain):
            kind, _, depth = self.known[at]
            self.known[here] = (kind, size, depth + 1)
            at = here
        return self.known[offset]

    def payload(self, offset: int) -> tuple[str, bytes]:
        chain, at = [], offset
        while at not in self.payloads:
            e = self.entry(at)
            chain.append((at, e))
            if e.base is None or len(chain) > MAX_DEPTH:
                break
            at = e.base
        raw = self.payloads[at] if at in self.payloads else b""
        for here, e in reversed(chain):
            raw = self._inflate(e) if e.base is None else apply_delta(raw, self._inflate(e))
            self.payloads[here] = raw
            self.cached += len(raw)
        while self.cached > CACHE_BYTES and len(self.payloads) > 1:
            self.cached -= len(self.payloads.popitem(last=False)[1])
        return self.info(offset)[0], raw

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """(positions in the index by offset, bytes up to the next entry or the trailer)."""
        order = np.argsort(self.index.offsets, kind="stable")
        ends = np.append(self.index.offsets[order][1:], len(self.data) - self.width)
        return order, ends - self.index.offsets[order]


def pack_stems(objects_dir: str) -> list[str]:
    """Packs that have both files, by name."""
    folder = os.path.join(objects_dir, "pack")
    names = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    return [os.path.join(folder, n[:-4]) for n in sorted(names) if n.endswith(".idx") and n[:-4] + ".pack" in names]


# --- loose objects -------------------------------------------------------------------------------


def loose_files(objects_dir: str, fan: str, width: int) -> list[tuple[bytes, str, int]]:
    """(oid, path, size of the file) below one fan-out folder."""
    folder = os.path.join(objects_dir, fan)
    if not os.path.isdir(folder):
        return []
    out = []
    for name in sorted(os.listdir(folder)):
        if re.fullmatch(rf"[0-9a-f]{{{2 * width - 2}}}", name):
            path = os.path.join(folder, name)
            out.append((bytes.fromhex(fan + name), path, os.path.getsize(path)))
    return out


def loose_header(path: str) -> tuple[str, int]:
    with open(path, "rb") as f:
        try:
            kind, size, _ = parse_object_header(zlib.decompressobj().decompress(f.read(256), 64))
        except zlib.error as e:
            raise Corrupt(str(e)) from e
    return kind, size


def loose_payload(path: str) -> tuple[str, bytes]:
    with open(path, "rb") as f:
        try:
            raw = zlib.decompress(f.read())
        except zlib.error as e:
            raise Corrupt(str(e)) from e
    kind, size, start = parse_object_header(raw)
    if len(raw) - start != size:
        raise Corrupt("a loose object of another size")
    return kind, raw[start:]


# --- commit-graph --------------------------------------------------------------------------------


def commit_graph(path: str, width: int) -> list[tuple[bytes, bytes, list[bytes], int]] | None:
    """(oid, tree, parents, time) of each commit of a version 1 file; None if it can't be trusted."""
    try:
        data = open(path, "rb").read()  # noqa: SIM115
    except OSError:
        return None
    body, trailer = data[:-width], data[-width:]
    if len(data) < 8 + 48 + width or data[:4] != b"CGPH" or data[4] != 1 or data[5] != (1 if width == 20 else 2) or data[7]:
        return None
    if (hashlib.sha1 if width == 20 else hashlib.sha256)(body).digest() != trailer:
        return None
    heads = [struct.unpack_from(">4sQ", data, 8 + 12 * k) for k in range(data[6])]
    if len({name for name, _ in heads}) != len(heads):
        return None
    stops = sorted([o for _, o in heads] + [len(body)])
    chunk = {name: body[o : next((s for s in stops if s > o), len(body))] for name, o in heads}
    if not {b"OIDF", b"OIDL", b"CDAT"} <= chunk.keys() or len(chunk[b"OIDF"]) != 1024:
        return None
    n = struct.unpack_from(">I", chunk[b"OIDF"], 1020)[0]
    if len(chunk[b"OIDL"]) != n * width or len(chunk[b"CDAT"]) != n * (width + 16):
        return None
    edges = np.frombuffer(chunk.get(b"EDGE", b""), ">u4")
    oid = lambda k: chunk[b"OIDL"][k * width : (k + 1) * width]
    none, out = 0x70000000, []
    for k in range(n):
        row = chunk[b"CDAT"][k * (width + 16) : (k + 1) * (width + 16)]
        first, second, high, low = struct.unpack_from(">IIII", row, width)
        parents = [] if first == none else [first]
        if second & 0x80000000:
            at = second & 0x7FFFFFFF
            while at < len(edges):
                parents.append(int(edges[at]) & 0x7FFFFFFF)
                if int(edges[at]) & 0x80000000:
                    break
                at += 1
            else:
                return None
        elif second != none:
            parents.append(second)
        if any(p >= n for p in parents):
            return None
        out.append((oid(k), row[:width], [oid(p) for p in parents], (high & 3) << 32 | low))
    return out


class GraphIds:
    """The ids of a commit-graph, for lookup; empty where the file can't be trusted."""

    def __init__(self, path: str, width: int):
        rows = commit_graph(path, width) or []
        self.raw = b"".join(sorted(r[0] for r in rows))
        self.width = width
        ids = np.frombuffer(self.raw, np.uint8).reshape(-1, width)
        self.heads = np.ascontiguousarray(ids[:, :8]).view(">u8").ravel()

    def __contains__(self, oid: bytes) -> bool:
        k = int(np.searchsorted(self.heads, np.frombuffer(oid[:8], ">u8")[0]))
        while k < len(self.heads) and self.raw[k * self.width : k * self.width + 8] == oid[:8]:
            if self.raw[k * self.width : (k + 1) * self.width] == oid:
                return True
            k += 1
        return False
