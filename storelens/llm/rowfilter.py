"""A Bloom filter of a table's keys, to leave rows out of a shuffle before an exact join.

Each key sets two bits of an array that has sixteen for each; so about one in seventy other rows
passes too.  The array goes to the executors by a broadcast.  Beyond ``MOST_BITS`` it grows no more:
then more rows pass, and the join that follows decides on them as on all others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_EACH, MOST_BITS = 16, 1 << 28


def _hashes(keys: list[Column]) -> list[Column]:
    """Two hashes of a row's keys; equal keys of equal types have equal ones."""
    return [F.xxhash64(*keys), F.xxhash64(F.lit(1), *keys)]


class RowFilter:
    """Filter of the ``keys`` columns of ``table``, which has ``n_rows`` rows."""

    def __init__(self, table: DataFrame, keys: list[str], n_rows: int):
        bits = min(max(64, -(-n_rows * BITS_EACH // 64) * 64), MOST_BITS)
        at = table.select(F.explode(F.array(*(F.pmod(h, F.lit(bits).cast("bigint")) for h in _hashes([F.col(k) for k in keys])))).alias("at"))
        mask = F.expr("shiftleft(1L, CAST(at & 63 AS INT))")
        words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(mask).alias("mask")).toArrow()
        held = np.zeros(bits // 64, np.int64)
        held[words.column("word").to_numpy()] = words.column("mask").to_numpy()
        self.held = table.sparkSession.sparkContext.broadcast(held)

    def may_hold(self, *keys: Column) -> Column:
        """False only for rows whose ``keys`` the table doesn't have."""
        shared = self.held

        @F.arrow_udf("boolean")
        def held(one: pa.Array, two: pa.Array) -> pa.Array:
            words, out = shared.value, True
            for h in (one, two):
                at = np.mod(h.to_numpy(zero_copy_only=False), 64 * len(words))
                out &= (words[at >> 6] >> (at & 63)) & 1 == 1
            return pa.array(out)

        return held(*_hashes(list(keys)))
