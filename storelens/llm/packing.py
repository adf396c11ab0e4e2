"""Token-id files: tokenise documents, write their ids in coded blocks, read them back.

Documents are dealt into shards by ranges of their id, so shards, and segments within a shard, are in
ascending order of the id (nulls first).  A segment is one row of the file table: the ids and lengths
of its documents and the blocks that hold its token ids (``idcoder``).  Spark
writes the table, so a lost executor or a second attempt leaves no half-written shard, and the place
can be any store that Spark can write.  Segments end at a document's end; they have about
``SEGMENT_IDS`` ids, more only where one document has more.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storelens.llm.common import slices, stored, text_buffer
from storelens.llm.idcoder import decoded, encoded, registered
from storelens.llm.pieces import PieceTokenizer

SEGMENT_IDS = 1 << 20
TEXT_BYTES = 2 << 20
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_open: dict[str, PieceTokenizer] = {}


def _tokenizer(path: str) -> PieceTokenizer:
    """One for each Python worker."""
    if path not in _open:
        _open[path] = PieceTokenizer(path)
    return _open[path]


SEGMENT_SCHEMA = "shard int, segment int, n_ids bigint, doc_ids array<bigint>, lengths array<bigint>, ids binary"


def write_segments(docs: DataFrame, tokenizer: str, end_id: int = 0, segment_ids: int = SEGMENT_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The file table of ``docs``: each document's token ids and ``end_id``, in order of the id.

    A null or empty text has the end id alone; null ids come first; rows that repeat an id follow one
    another, by the first 64 characters of their texts, and may lie in several shards, as any number of
    them may be equal; a text of any length is encoded whole.  An empty table gives no segments.  Other
    columns aren't read.
    """

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tokenizer(tokenizer)
        shard = TaskContext.get().partitionId()
        segment, total = 0, 0
        keys: list[pa.Array] = []
        lengths: list[np.ndarray] = []
        parts: list[np.ndarray] = []

        def row() -> pa.RecordBatch:
            column = pa.concat_arrays(keys)
            size = np.concatenate(lengths)
            ends = pa.array([0, len(column)], pa.int32())
            ids = np.concatenate(parts).astype("<u4").tobytes()
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([int(size.sum())], pa.int64()), pa.ListArray.from_arrays(ends, column), pa.ListArray.from_arrays(ends, pa.array(size, pa.int64())), pa.array([ids], pa.binary())],
                ["shard", "segment", "n_ids", "doc_ids", "lengths", "ids"],
            )

        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for i, j in slices(offsets, TEXT_BYTES):
                ids, count = encoder.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ids = np.insert(ids, np.cumsum(count), end_id)
                count = count + 1
                ends = np.concatenate([[0], np.cumsum(count)])
                begin = 0
                while begin < j - i:  # as many documents as the segment has room for, one at least
                    room = ends[begin] + segment_ids - total
                    end = int(np.searchsorted(ends, room, "right")) - 1
                    if end <= begin and parts:
                        yield row()
                        segment, total, keys, lengths, parts = segment + 1, 0, [], [], []
                        continue
                    end = max(end, begin + 1)
                    keys.append(batch.column(0).slice(i + begin, end - begin))
                    lengths.append(count[begin:end])
                    parts.append(ids[ends[begin] : ends[end]])
                    total += int(ends[end] - ends[begin])
                    begin = end
        if parts:
            yield row()

    registered(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 64).asc_nulls_first()]
    rows = rows.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order)
    segments = rows.mapInArrow(code, SEGMENT_SCHEMA)
    return stored(segments.select("shard", "segment", "n_ids", "doc_ids", "lengths", encoded(F.col("ids")).alias("blocks")), "token-ids")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            shard, segment, n_ids = (batch.column(c)[k].as_py() for c in range(3))
            keys, lengths = batch.column(3)[k].values, batch.column(4)[k].values
            raw = memoryview(batch.column(5)[k].as_buffer())
            ends = 4 * np.cumsum(lengths.to_numpy())
            if len(raw) != 4 * n_ids or ends[-1] != len(raw):
                raise ValueError("a segment's lengths don't fit its ids")
            begins = ends - 4 * lengths.to_numpy()
            crcs = [zlib.crc32(raw[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
            n = len(crcs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * n, pa.int32()), pa.array([segment] * n, pa.int32()), keys, pa.array(begins // 4), lengths, pa.array(crcs, pa.int64())],
                ["shard", "segment", "doc_id", "begin", "n_tokens", "ids_crc32"],
            )


READ_SCHEMA = "shard int, segment int, doc_id bigint, begin bigint, n_tokens bigint, ids_crc32 bigint"


def read_segments(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the decoded blocks.

    ``start`` counts the ids of all documents before: those of the shards before (a row each), and
    those of the shard's segments before.
    """
    registered(files.sparkSession)
    above = lambda order: F.coalesce(F.sum("n_ids").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n_ids")).select("shard", above(Window.orderBy("shard")).alias("earlier"))
    segments = files.select("shard", "segment", above(Window.partitionBy("shard").orderBy("segment")).alias("within"))
    before = segments.join(shards, "shard").select("shard", "segment", (F.col("earlier") + F.col("within")).alias("before"))
    ids = files.select("shard", "segment", "n_ids", "doc_ids", "lengths", decoded(F.col("blocks")).alias("ids")).mapInArrow(_read, READ_SCHEMA)
    return ids.join(before, ["shard", "segment"]).select("doc_id", (F.col("before") + F.col("begin")).cast("bigint").alias("start"), "n_tokens", "ids_crc32")


def packed(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token-id files of ``docs`` and report what they hold, a row for each row of ``docs``.

    Nulls, empty and long texts, repeated rows and an empty table are treated as in ``write_segments``.
    """
    return read_segments(write_segments(docs, tokenizer or tokenizer_path(), id_col=id_col, text_col=text_col))
