"""Chat formatting: repair the roles of conversations at minimum cost, then render them.

A legal conversation is empty, or an optional system turn, then user and assistant turns that
alternate, from a user to an assistant.  Each row keeps its role or is relabelled (``RELABEL``); it
opens a turn, or is merged into the open one of the same role (``MERGE``); empty turns may be put in
before it, and at the end (``INSERT`` each).  The cheapest repair is a shortest path over the states
of a four-state automaton: nothing yet, system, user, assistant; of equal costs, the one whose states
are smallest from the end backwards.

A conversation of any length is repaired in parallel.  Rows are sorted by range partitions, so a
long conversation lies in many of them, and cut into segments of at most ``SEGMENT`` rows.  The cost
of crossing a segment from any state to any other is a 4 x 4 matrix.  A pass over the matrices gives
the costs of reaching each segment's start; each segment then knows, for every end state, its best
start state; a pass back over these four numbers fixes all end states; and each segment picks its
own path.  The passes in between stream one small row for a segment with a constant state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import stored

ROLES = ("system", "user", "assistant")
MERGE, RELABEL, INSERT = 1, 2, 3
SEGMENT = 1024
NEVER = 1 << 40
NO_ID = -(1 << 63)

#: Turns to put in between state s and a new turn of role t (states and roles count 1, 2, 3); absent: impossible.
_BETWEEN = {(0, 1): (), (0, 2): (), (0, 3): (2,), (1, 2): (), (1, 3): (2,), (2, 2): (3,), (2, 3): (), (3, 2): (), (3, 3): (2,)}
#: Turns to put in after the last row.
_AFTER = ((), (2, 3), (3,), ())
END = tuple(INSERT * len(x) for x in _AFTER)


def step(s: int, t: int, code: int) -> tuple[int, bool, tuple[int, ...]]:
    """(cost, merged, turns put in) of giving role t to a row with role ``code`` (0: unknown) in state s."""
    cost = 0 if code == t else RELABEL
    ways = [(cost + MERGE, 0, True, ())] if s == t else []
    if (s, t) in _BETWEEN:
        ways.append((cost + INSERT * len(_BETWEEN[s, t]), 1, False, _BETWEEN[s, t]))
    if not ways:
        return NEVER, False, ()
    best = min(ways)
    return best[0], best[2], best[3]


_STEPS = {(s, t, c): step(s, t, c) for s in range(4) for t in range(1, 4) for c in range(4)}


def forward(codes: list[int], start: list[int]) -> tuple[list[list[int]], list[list[int]]]:
    """Costs after each row, and the best state before it, for each state; ``start`` are the costs before."""
    costs, came = [start], []
    for code in codes:
        before, now, back = costs[-1], [NEVER] * 4, [0] * 4
        for t in (1, 2, 3):
            for s in range(4):
                c = before[s] + _STEPS[s, t, code][0]
                if c < now[t]:
                    now[t], back[t] = c, s
        costs.append(now)
        came.append(back)
    return costs, came


def crossing(codes: list[int]) -> list[int]:
    """The 16 costs of crossing rows from a state to a state."""
    out = []
    for s in range(4):
        out += forward(codes, [0 if x == s else NEVER for x in range(4)])[0][-1]
    return out


def last_state(costs: list[int]) -> int:
    return min(range(4), key=lambda s: (costs[s] + END[s], s))


def walk(came: list[list[int]], end: int) -> list[int]:
    """States before each row and after the last, back from the end state."""
    states = [end]
    for back in reversed(came):
        states.append(back[states[-1]])
    return states[::-1]


def repair(codes: list[int]) -> tuple[int, list[int]]:
    """(cost, states) of one conversation, in one piece."""
    costs, came = forward(codes, [0, NEVER, NEVER, NEVER])
    end = last_state(costs[-1])
    return costs[-1][end] + END[end], walk(came, end)


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [crossing(r["codes"]) for r in batch.to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], ["cid", "segment", "matrix"])


def _reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs at the start and end of each segment; rows sorted by conversation and segment."""
    cid, costs = None, []
    for batch in batches:
        before, after = [], []
        for c, matrix in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if c != cid:
                cid, costs = c, [0, NEVER, NEVER, NEVER]
            before.append(costs)
            costs = [min(min(costs[s] + matrix[4 * s + t] for s in range(4)), NEVER) for t in range(4)]
            after.append(costs)
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(before, kind), pa.array(after, kind)], ["cid", "segment", "before", "after"])


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each end state the state at the segment's start."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            _, came = forward(r["codes"], r["before"])
            out.append([walk(came, end)[0] for end in range(4)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32())), batch.column(4)], ["cid", "segment", "starts", "after"])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """End state of each segment; rows sorted by conversation, segments from last to first."""
    cid, state = None, 0
    for batch in batches:
        ends, final = [], []
        for c, starts, after in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
            final.append(c != cid)
            if c != cid:
                cid, state = c, last_state(after)
            ends.append(state)
            state = starts[state]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ends, pa.int32()), pa.array(final)], ["cid", "segment", "end", "final"])


_OPEN, _CLOSE = "<|{}|>\n", "<|end|>\n"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each row of the conversation: its role, what was done, and what goes around its text."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            _, came = forward(r["codes"], r["before"])
            states = walk(came, r["end"])
            last = len(states) - 2
            for k, (s, t) in enumerate(zip(states[:-1], states[1:], strict=True)):
                cost, merged, between = _STEPS[s, t, r["codes"][k]]
                after = _AFTER[t] if r["final"] and k == last else ()
                empty = [_OPEN.format(ROLES[x - 1]) + _CLOSE for x in (*between, *after)]
                if merged:
                    prefix = "\n\n"
                else:
                    prefix = (_CLOSE if s else "") + "".join(empty[: len(between)]) + _OPEN.format(ROLES[t - 1])
                suffix = (_CLOSE + "".join(empty[len(between) :])) if r["final"] and k == last else ""
                out.append((r["rids"][k], ROLES[t - 1], merged, r["codes"][k] != t, len(empty), cost + INSERT * len(after), prefix, suffix))
        kinds = (pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.int32(), pa.int64(), pa.string(), pa.string())
        columns = zip(*out, strict=True) if out else [()] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["rid", "new_role", "merged", "relabelled", "n_inserted", "cost", "prefix", "suffix"])


def formatted(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """(conv_id, turn, role, position, new_role, merged, relabelled, n_inserted, cost, rendered), a row for each row.

    ``rendered`` of a conversation's rows, one after another by ``position``, is the conversation in
    full; nothing of unbounded length is put together.  Rows go by turn (null first), then role and
    text.  Roles are compared trimmed and lower-cased; null or unknown ones must be relabelled.  A null
    text is empty.  Rows with a null conversation are one conversation.  A ``<|`` in a text is written
    ``< |``, so that no text can pose as a marker.  An empty table returns no rows.
    """
    rows = turns.select(*(F.col(f"`{c}`").alias(n) for c, n in ((conv_col, "conv_id"), (turn_col, "turn"), (role_col, "role"), (text_col, "text"))))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "tie")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    rows = stored(rows.withColumn("rid", F.monotonically_increasing_id()), "turns")  # in order over all partitions

    cid = F.coalesce(F.col("conv_id").cast("bigint"), F.lit(NO_ID).cast("bigint"))
    role = F.lower(F.trim("role"))
    code = F.coalesce(*(F.when(role == r, F.lit(k + 1)) for k, r in enumerate(ROLES)), F.lit(0))
    cut = F.col("rid") - F.pmod(F.col("rid").bitwiseAND(F.lit((1 << 33) - 1)), F.lit(segment))
    coded = rows.select(cid.alias("cid"), cut.alias("segment"), F.struct("rid", code.alias("code")).alias("r"))
    segments = coded.groupBy("cid", "segment").agg(F.sort_array(F.collect_list("r")).alias("r"))
    segments = stored(segments.select("cid", "segment", F.col("r.code").alias("codes"), F.col("r.rid").alias("rids")), "segments")

    crossed = segments.select("cid", "segment", "codes").mapInArrow(_cross, "cid bigint, segment bigint, matrix array<bigint>")
    reached = crossed.repartition("cid").sortWithinPartitions("cid", "segment").mapInArrow(_reach, "cid bigint, segment bigint, before array<bigint>, after array<bigint>")
    known = stored(segments.join(reached, ["cid", "segment"]), "segments")
    starts = known.select("cid", "segment", "codes", "before", "after").mapInArrow(_starts, "cid bigint, segment bigint, starts array<int>, after array<bigint>")
    ends = starts.repartition("cid").sortWithinPartitions(F.col("cid"), F.col("segment").desc()).mapInArrow(_ends, "cid bigint, segment bigint, end int, final boolean")
    done = known.join(ends, ["cid", "segment"]).select("rids", "codes", "before", "end", "final")
    done = done.mapInArrow(_pieces, "rid bigint, new_role string, merged boolean, relabelled boolean, n_inserted int, cost bigint, prefix string, suffix string")
    safe = F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |"))
    return rows.join(done, "rid").select(
        "conv_id", "turn", "role", F.col("rid").alias("position"), "new_role", "merged", "relabelled", "n_inserted", "cost", F.concat("prefix", safe, "suffix").alias("rendered")
    )
