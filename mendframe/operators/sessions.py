"""The editing session: step order, undo history and where results go."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendframe.functions.blocked import blocked_row_number
from mendframe.functions.scans import at_corner, block_scan, corners

COMMITS = ("add", "toggle", "remove", "clear")
SESSION_BLOCK = 4096


def step_log(steps: DataFrame) -> DataFrame:
    """Adds `position`: byte edits first, in order of arrival, then all other steps.

    `steps`: session_id, step_no, kind. Each of the two runs is numbered in
    blocks, and the second starts after the count of the first.
    """
    flagged = steps.withColumn("_late", (F.col("kind") != "bytes").cast("int"))
    numbered = blocked_row_number(
        flagged, ["session_id", "_late"], ["step_no"], F.expr(f"step_no div {SESSION_BLOCK}"), "_i"
    )
    early = flagged.where("_late = 0").groupBy("session_id").agg(F.count(F.lit(1)).alias("_bytes"))
    return numbered.join(early, "session_id", "left").select(
        *steps.columns, F.expr("_i + CASE WHEN _late = 1 THEN coalesce(_bytes, 0) ELSE 0 END").alias("position")
    )


def check_moves(log: DataFrame, moves: DataFrame) -> DataFrame:
    """Adds `refused` to moves (session_id, move_no, from_pos, to_pos): a move between byte edits and other steps, or out of the list."""
    kinds = log.select("session_id", "position", (F.col("kind") == "bytes").alias("_b"))
    at = lambda c, name: kinds.select("session_id", F.col("position").alias(c), F.col("_b").alias(name))
    return (
        moves.join(at("from_pos", "_f"), ["session_id", "from_pos"], "left")
        .join(at("to_pos", "_t"), ["session_id", "to_pos"], "left")
        .select(*moves.columns, F.expr("coalesce(_f <> _t OR from_pos = to_pos, true)").alias("refused"))
    )


COMMIT, UNDO, REDO = 1, 2, 3


def _history_function(codes: np.ndarray) -> list[int]:
    """A block of events as a function of (index, top), the last state's index and that of the last state there is.

    Up to the first commit the top stays: the index is shifted, then held between what
    a start at the bottom and one at the top come to, both functions of the top. From
    the first commit on all depends on the index it makes.
    """
    codes = codes[codes > 0]
    cut = np.nonzero(codes == COMMIT)[0]
    head, tail = (codes[: cut[0]], codes[cut[0] + 1 :]) if len(cut) else (codes, codes[:0])

    def pieces(run: np.ndarray):
        at = [*(np.nonzero(np.diff(run, prepend=-1))[0] if len(run) else ()), len(run)]
        return [(int(run[a]), int(b - a)) for a, b in pairwise(at)]

    top = np.arange(len(head) + 1)
    bottom, upper, shift = np.zeros_like(top), top.copy(), 0
    for code, k in pieces(head):
        if code == UNDO:
            bottom, upper, shift = np.maximum(bottom - k, 0), np.maximum(upper - k, 0), shift - k
        else:
            bottom, upper, shift = np.minimum(bottom + k, top), np.minimum(upper + k, top), shift + k
    out = [shift, *corners(bottom), *corners(upper), len(cut)]
    if len(cut):
        index = np.arange(int((tail == UNDO).sum()) + 1)
        last = index
        for code, k in pieces(tail):
            if code == COMMIT:
                index = last = index + k
            else:
                index = np.maximum(index - k, 0) if code == UNDO else np.minimum(index + k, last)
        out += [*corners(index), *corners(last)]
    return out


def _history_advance(state: tuple[int, ...], f: list[int]) -> tuple[int, ...]:
    index, top = state
    at = 1

    def part() -> list[int]:
        nonlocal at
        size = 2 * int(f[at]) + 1
        at += size
        return f[at - size : at]

    bottom, upper = part(), part()
    index = max(at_corner(bottom, top, 0), min(at_corner(upper, top, 1), index + int(f[0])))
    commits = int(f[at])
    at += 1
    if commits:
        made = index + 1
        index, top = at_corner(part(), made, 1), at_corner(part(), made, 1)
    return index, top


def _history_run(codes: np.ndarray, state: tuple[int, ...]) -> list[np.ndarray]:
    i, t = state
    index, top = np.empty(len(codes), np.int64), np.empty(len(codes), np.int64)
    for k, code in enumerate(codes.tolist()):
        if code == COMMIT:
            i = t = i + 1
        elif code == UNDO:
            i = max(i - 1, 0)
        elif code == REDO:
            i = min(i + 1, t)
        index[k], top[k] = i, t
    return [index, top + 1]


def session_history(events: DataFrame, block: int = SESSION_BLOCK) -> DataFrame:
    """session_id, seq, index, depth: the undo position and history length after each event.

    `events`: session_id, seq (0-based, in order), action. A committing action
    drops what could be redone and appends a state; undo and redo move within
    bounds. Sessions start with one state.

    One session may be very long: a block of its events is a function of the
    position and length it starts from, and blocks are chained by these, so
    three passes do for any session.
    """
    commits = ", ".join(f"'{a}'" for a in COMMITS)
    code = f"CASE WHEN action IN ({commits}) THEN {COMMIT} WHEN action = 'undo' THEN {UNDO} WHEN action = 'redo' THEN {REDO} ELSE 0 END"
    coded = events.select("session_id", F.col("seq").cast("bigint").alias("seq"), F.expr(code).alias("code"))
    return block_scan(
        coded, ["session_id"], "seq", "code", block, (0, 0), _history_function, _history_advance, _history_run, ["index", "depth"]
    )


def history_pool(states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pool, refs): distinct steps numbered by first use, and each state as a list of those numbers.

    `states`: session_id, state_no, pos, step. Consecutive states share almost
    all their steps, so the pool is far smaller than the states.
    """
    first = states.groupBy("session_id", "step").agg(F.min(F.struct("state_no", "pos")).alias("_f"))
    pool = blocked_row_number(
        first.select("session_id", "step", F.col("_f.state_no").alias("_s"), F.col("_f.pos").alias("_p")),
        ["session_id"], ["_s", "_p"], F.expr(f"_s div {SESSION_BLOCK}"), "ref",
    ).select("session_id", "ref", "step")
    refs = (
        states.join(pool, ["session_id", "step"])
        .groupBy("session_id", "state_no")
        .agg(F.expr("transform(array_sort(collect_list(struct(pos, ref))), r -> r.ref)").alias("refs"))
    )
    return pool, refs


def export_target(projects: DataFrame) -> DataFrame:
    """Adds `target`: the explicit output, else the last export, else a name beside the source; never the source."""
    return projects.withColumn(
        "target",
        F.expr("coalesce(nullif(output, ''), nullif(export_path, ''), concat(source_path, '.repaired.jpg'))"),
    )
