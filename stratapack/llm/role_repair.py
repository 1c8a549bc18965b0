"""Minimum-cost role repair of conversations, and rendering of the repaired sequence.

A legal conversation is an optional system turn, then user and assistant turns in
alternation, from a user turn to an assistant turn. Each given turn may be kept, relabelled,
merged into the turn before it, and preceded (or, at the end, followed) by empty turns; the
costs are COSTS. Dynamic programming over the automaton's four states finds a cheapest
repair; of equal ones, the first in the order keep, merge, insert, relabel, by state.

A conversation may be of any length, so it is not gathered. Turns are dealt to ranges of
(conv_id, turn, role, text hash) of about equal row count, as many as keep a range near RANGE_BYTES, and written once. A
range repairs the conversations that lie inside it. For the one at each of its ends
it first gives a 4 x 4 matrix of least costs from state to state; such matrices of one
conversation, at most two rows a range, are combined (minimum, plus) on the driver, which tells
each range the states in which it enters and leaves them, and how many turns came before. A row's rendered piece depends
only on its state, so the pieces by position are the rendered conversation.

Cases: a null role, or one the automaton doesn't know, must be relabelled at its own lower
cost. A null text is empty. Rows without a conv_id are one conversation. Equal turn
numbers are ordered by role, then by a hash of the text; repeated rows are repeated turns.
An empty table gives an empty result. Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapack.llm.common import staged, table
from stratapack.session import ship

START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ("", "system", "user", "assistant")
#: Which states may follow each.
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
COSTS = {"merge": 1, "insert": 2, "relabel": 3, "unknown": 1}
OPEN, CLOSE, JOINT = "<|im_start|>{}\n", "<|im_end|>\n", "\n"
NEVER = 1 << 40
#: Bytes of text that a range holds, about.
RANGE_BYTES = 64 << 20
_PIECES = "conv_id long, turn long, role string, position long, action string, n_inserted int, out_role string, cost int, rendered string"


@lru_cache(maxsize=1)
def bridges() -> dict[tuple[int, int], tuple[int, ...]]:
    """Shortest run of empty turns from a state to another, by breadth."""
    found = {}
    for a in range(4):
        found[a, a] = ()
        edge = [a]
        while edge:
            here, edge = edge, []
            for q in here:
                for b in LEGAL[q]:
                    if (a, b) not in found:
                        found[a, b] = (*found[a, q], b)
                        edge.append(b)
    return found


@lru_cache(maxsize=64)
def moves(state: int, role: int) -> tuple[tuple[int, int, str, tuple[int, ...]], ...]:
    """(next state, cost, action, inserted) of each way to take a turn; the cheapest for each next state."""
    out = []
    for target in (SYSTEM, USER, ASSISTANT):
        label = 0 if target == role else COSTS["unknown"] if not role else COSTS["relabel"]
        ways = []
        if target in LEGAL[state]:
            ways.append((label, 0, "keep", ()))
        if target == state:
            ways.append((label + COSTS["merge"], 1, "merge", ()))
        for middle in (USER, ASSISTANT):
            path = bridges().get((state, middle))
            if path and target in LEGAL[middle]:
                ways.append((label + COSTS["insert"] * len(path), 2, "keep", path))
        if ways:
            cost, _, action, inserted = min(ways)
            if label:
                action = "relabel" if action == "keep" else "merge+relabel"
            out.append((target, cost, action, inserted))
    return tuple(out)


def ending(state: int) -> tuple[int, ...]:
    """Empty turns that bring a conversation to its legal end."""
    return () if state == ASSISTANT else bridges()[state, ASSISTANT]


def role_number(role: str | None) -> int:
    return NAMES.index(role) if role in NAMES[1:] else START


def costs_between(roles: list[int]) -> list[list[int]]:
    """Least cost from each state to each over the turns."""
    out = []
    for start in range(4):
        best = [NEVER] * 4
        best[start] = 0
        for role in roles:
            after = [NEVER] * 4
            for q in range(4):
                if best[q] < NEVER:
                    for target, cost, _, _ in moves(q, role):
                        after[target] = min(after[target], best[q] + cost)
            best = after
        out.append(best)
    return out


def repair(roles: list[int], enter: int = START, leave: int | None = None) -> list[tuple[int, int, int, str, tuple[int, ...]]]:
    """(state before, state after, cost, action, inserted) of each turn, cheapest from enter to leave (None: to a legal end)."""
    best, back = [NEVER] * 4, []
    best[enter] = 0
    for role in roles:
        after, how = [NEVER] * 4, [None] * 4
        for q in range(4):
            if best[q] < NEVER:
                for target, cost, action, inserted in moves(q, role):
                    if best[q] + cost < after[target]:
                        after[target], how[target] = best[q] + cost, (q, target, cost, action, inserted)
        best = after
        back.append(how)
    if leave is None:
        leave = min(range(4), key=lambda q: (best[q] + COSTS["insert"] * len(ending(q)), q))
    out, state = [], leave
    for how in reversed(back):
        out.append(how[state])
        state = how[state][0]
    return out[::-1]


def _empty(states: tuple[int, ...]) -> str:
    return "".join(OPEN.format(NAMES[q]) + CLOSE for q in states)


def piece(before: int, after: int, action: str, inserted: tuple[int, ...], text: str, last: bool) -> str:
    """What a turn adds to the rendered conversation."""
    if action.startswith("merge"):
        out = JOINT + text
    else:
        out = (CLOSE if before != START else "") + _empty(inserted) + OPEN.format(NAMES[after]) + text
    return out + CLOSE + _empty(ending(after)) if last else out


def stitched(fragments: list[dict]) -> dict[tuple[int, int], tuple[int, int, bool, int]]:
    """(range, first seq) -> states of entering and leaving, whether the conversation ends there, and its turns before, for those in several ranges."""
    by: dict[object, list[dict]] = {}
    for f in sorted(fragments, key=lambda f: (f["part"], f["seq"])):
        by.setdefault(f["conv_id"], []).append(f)
    out = {}
    for parts in by.values():
        if len(parts) < 2:
            continue
        best, back = [0, NEVER, NEVER, NEVER], []
        for f in parts:
            matrix = [f["costs"][4 * a : 4 * a + 4] for a in range(4)]
            through = [min((best[a] + matrix[a][b], a) for a in range(4)) for b in range(4)]
            back.append([a for _, a in through])
            best = [min(c, NEVER) for c, _ in through]
        leave = min(range(4), key=lambda q: (best[q] + COSTS["insert"] * len(ending(q)), q))
        before = sum(f["turns"] for f in parts)
        for k in range(len(parts) - 1, -1, -1):
            enter = back[k][leave]
            before -= parts[k]["turns"]
            out[parts[k]["part"], parts[k]["seq"]] = (enter, leave, k == len(parts) - 1, before)
            leave = enter
    return out


def _runs(ids: list) -> list[tuple[int, int]]:
    """Spans of equal neighbours."""
    cuts = [0, *(k for k in range(1, len(ids)) if ids[k] != ids[k - 1]), len(ids)]
    return list(zip(cuts, cuts[1:], strict=False)) if ids else []


def repaired_turns(turns: DataFrame, ranges: int | None = None) -> DataFrame:
    """conv_id, turn, role, position (in the conversation, from 0), action, n_inserted, out_role, cost, rendered: one row per row of turns."""
    spark = turns.sparkSession
    ship(spark)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if not ranges:
        held = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // RANGE_BYTES))
    keys = ["conv_id", "turn", "role", F.xxhash64("text")]
    dealt = rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    dealt = staged(dealt.withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()), "turns")

    def ends(group: pa.Table) -> pa.Table:
        group = group.sort_by("seq")
        ids, roles, seq = (group[c].to_pylist() for c in ("conv_id", "role", "seq"))
        spans = _runs(ids)
        spans = spans if len(spans) == 1 else [spans[0], spans[-1]]
        out = [(group["part"][0].as_py(), seq[a], ids[a], b - a, [c for row in costs_between([role_number(r) for r in roles[a:b]]) for c in row]) for a, b in spans]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("part", "seq", "conv_id", "turns", "costs"), zip(*out, strict=True), kinds, strict=True)})

    # At most two rows of sixteen numbers for each range, whatever the ranges hold.
    fragments = dealt.select("part", "seq", "conv_id", "role").groupBy("part").applyInArrow(ends, "part int, seq long, conv_id long, turns long, costs array<long>")
    known = stitched([r.asDict() for r in fragments.collect()])

    def render(group: pa.Table) -> pa.Table:
        group = group.sort_by("seq")
        part = group["part"][0].as_py()
        ids, turn, roles, seq, texts = (group[c].to_pylist() for c in ("conv_id", "turn", "role", "seq", "text"))
        out = []
        for a, b in _runs(ids):
            enter, leave, last, earlier = known.get((part, seq[a]), (START, None, True, 0))
            for k, (before, after, cost, action, inserted) in zip(range(a, b), repair([role_number(r) for r in roles[a:b]], enter, leave), strict=True):
                end = last and k == b - 1
                tail = ending(after) if end else ()
                out.append((ids[k], turn[k], roles[k], earlier + k - a, action, len(inserted) + len(tail), NAMES[after], cost + COSTS["insert"] * len(tail), piece(before, after, action, inserted, texts[k], end)))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string()]
        names = [c.split()[0] for c in _PIECES.split(", ")]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, zip(*out, strict=True), kinds, strict=True)})

    return dealt.groupBy("part").applyInArrow(render, _PIECES)


def rendered(pieces: DataFrame) -> DataFrame:
    """conv_id, text: whole conversations, for those that fit a row."""
    parts = F.array_sort(F.collect_list(F.struct("position", "rendered")))
    return pieces.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["rendered"]), "").alias("text"))


def op5_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's repair and piece; a conversation's pieces by position are its rendered text."""
    return repaired_turns(table(spark, sf_dir, "conversations"))
