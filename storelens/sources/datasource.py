"""Spark data source ``odb``: the tables of a Git object database.

``spark.read.format("odb").option("path", repository).option("table", name).load()``, with the tables
of ``SCHEMAS``.  Option ``types`` narrows ``objects`` and ``payloads`` to some object types and ``oid``
to one object, and ``beyond`` = ``graph`` skips what the commit-graph lists, before anything is inflated.  A task reads one range of a pack in the order of its
offsets, so that delta bases stay near, or some fan-out folders of loose files.  The repository must be
at the same path on all executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from storelens.session import shipped
from storelens.sources import odb
from storelens.sources.repository import discover

SCHEMAS = {
    "objects": "oid binary, type string, logical_bytes bigint, physical_bytes bigint, storage string, pack string, pack_offset bigint, delta_depth int",
    "payloads": "oid binary, type string, payload binary",
    "commits": "oid binary, tree binary, parents array<binary>, author_ident string, author_ts bigint, committer_ts bigint, message string",
    "tree_entries": "tree binary, ord int, mode int, kind string, name binary, oid binary",
    "tags": "oid binary, object binary, object_type string, name string, tagger string",
    "pack_entries": "pack string, offset bigint, oid binary, raw_type string, raw_size bigint, base_offset bigint, target_size bigint, physical_bytes bigint, delta_depth int",
    "commit_graph": "oid binary, tree binary, parents array<binary>, committer_ts bigint",
}
_ARROW = {
    "objects": [("oid", pa.binary()), ("type", pa.string()), ("logical_bytes", pa.int64()), ("physical_bytes", pa.int64()), ("storage", pa.string()), ("pack", pa.string()), ("pack_offset", pa.int64()), ("delta_depth", pa.int32())],
    "payloads": [("oid", pa.binary()), ("type", pa.string()), ("payload", pa.binary())],
    "commits": [("oid", pa.binary()), ("tree", pa.binary()), ("parents", pa.list_(pa.binary())), ("author_ident", pa.string()), ("author_ts", pa.int64()), ("committer_ts", pa.int64()), ("message", pa.string())],
    "tree_entries": [("tree", pa.binary()), ("ord", pa.int32()), ("mode", pa.int32()), ("kind", pa.string()), ("name", pa.binary()), ("oid", pa.binary())],
    "tags": [("oid", pa.binary()), ("object", pa.binary()), ("object_type", pa.string()), ("name", pa.string()), ("tagger", pa.string())],
    "pack_entries": [("pack", pa.string()), ("offset", pa.int64()), ("oid", pa.binary()), ("raw_type", pa.string()), ("raw_size", pa.int64()), ("base_offset", pa.int64()), ("target_size", pa.int64()), ("physical_bytes", pa.int64()), ("delta_depth", pa.int32())],
    "commit_graph": [("oid", pa.binary()), ("tree", pa.binary()), ("parents", pa.list_(pa.binary())), ("committer_ts", pa.int64())],
}
_PARSED = {"commits": ("commit",), "tree_entries": ("tree",), "tags": ("tag",)}
RANGE = 50_000
FANS = 16
ROWS, BYTES = 5_000, 8 << 20


@dataclass
class Part(InputPartition):
    stem: str | None = None
    begin: int = 0
    end: int = 0
    fans: tuple[str, ...] = ()
    graph: str | None = None


class OdbReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.repo = discover(options["path"])
        self.table = options.get("table", "objects")
        if self.table not in SCHEMAS:
            raise ValueError(f"no table {self.table}")
        asked = options.get("types")
        self.types = _PARSED.get(self.table) or (tuple(asked.split(",")) if asked else None)
        self.oid = bytes.fromhex(options["oid"]) if options.get("oid") else None
        self.beyond_graph = options.get("beyond") == "graph"
        self.range = int(options.get("range", RANGE))

    def partitions(self) -> list[Part]:
        objects, width = self.repo.objects_dir, self.repo.hash_bytes
        if self.table == "commit_graph":
            return [Part(graph=f"{objects}/info/commit-graph")]
        out = []
        for stem in odb.pack_stems(objects):
            n = len(odb.PackIndex.read(odb.mapped(stem + ".idx"), width).oids)
            out += [Part(stem=stem, begin=b, end=min(n, b + self.range)) for b in range(0, n, self.range)]
        if self.table != "pack_entries":
            fans = [f"{k:02x}" for k in range(256)] if self.oid is None else [self.oid[:1].hex()]
            out += [Part(fans=tuple(fans[k : k + FANS])) for k in range(0, len(fans), FANS)]
        return out or [Part()]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(_ARROW[self.table])
        rows, size = [], 0
        for row in self._rows(part):
            rows.append(row)
            size += sum(len(x) for x in row if isinstance(x, (bytes, str)))
            if len(rows) >= ROWS or size >= BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def _rows(self, part: Part) -> Iterator[tuple]:
        width = self.repo.hash_bytes
        listed = odb.GraphIds(f"{self.repo.objects_dir}/info/commit-graph", width) if self.beyond_graph else ()
        if part.graph:
            yield from odb.commit_graph(part.graph, width) or ()
        if part.stem:
            pack, name = odb.Pack(part.stem, width), part.stem.rpartition("/")[2]
            order, spans = pack.spans()
            for k, span in zip(order[part.begin : part.end].tolist(), spans[part.begin : part.end].tolist(), strict=True):
                oid, offset = pack.index.oids[k].tobytes(), int(pack.index.offsets[k])
                if self.oid not in (None, oid) or oid in listed:
                    continue
                kind, size, depth = pack.info(offset)
                if self.table == "pack_entries":
                    e = pack.entry(offset)
                    yield name, offset, oid, odb.TYPES[e.kind], e.size, e.base, size, span, depth
                elif self.types is None or kind in self.types:
                    if self.table == "objects":
                        yield oid, kind, size, span, "pack", name, offset, depth
                    else:
                        yield from self._parsed(oid, *pack.payload(offset))
        for fan in part.fans:
            for oid, path, size in odb.loose_files(self.repo.objects_dir, fan, width):
                if self.oid not in (None, oid) or oid in listed:
                    continue
                kind, logical = odb.loose_header(path)
                if self.types is None or kind in self.types:
                    if self.table == "objects":
                        yield oid, kind, logical, size, "loose", None, None, 0
                    else:
                        yield from self._parsed(oid, *odb.loose_payload(path))

    def _parsed(self, oid: bytes, kind: str, raw: bytes) -> Iterator[tuple]:
        if self.table == "payloads":
            yield oid, kind, raw
        elif self.table == "commits":
            c = odb.parse_commit(raw)
            yield oid, c["tree"], c["parents"], c["author_ident"], c["author_ts"], c["committer_ts"], c["message"]
        elif self.table == "tree_entries":
            for k, (mode, entry, name, target) in enumerate(odb.parse_tree(raw, self.repo.hash_bytes)):
                yield oid, k, mode, entry, name, target
        else:
            t = odb.parse_tag(raw)
            yield oid, t["object"], t["object_type"], t["name"], t["tagger"]


class OdbDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "odb"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "objects")]

    def reader(self, schema) -> OdbReader:
        return OdbReader(dict(self.options))


def read_table(spark: SparkSession, path: str, table: str, **options: str):
    shipped(spark).dataSource.register(OdbDataSource)
    reader = spark.read.format("odb").option("path", path).option("table", table)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()
