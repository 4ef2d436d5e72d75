"""Replaying a repair recipe and reporting where each MCU came from.

A recipe is compiled once per image to ranges of positions that show a range of
the original; the original's data is then joined once, no matter how many steps
there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendframe.functions.blocked import blocked_row_number
from mendframe.functions.lineage import shuffle_partitions
from mendframe.functions.sizes import Size

# Flags of a traced MCU.
MOVED, DC, PASTED, NO_DATA, REENCODED = 1, 2, 4, 0x40, 0x80

RECIPE_BLOCK = 1024


def recipes(steps: DataFrame, block: int = RECIPE_BLOCK) -> DataFrame:
    """image_id, block, ops, auto_color: enabled coefficient steps in list order, in blocks of `block` steps.

    `steps`: image_id, step_no, kind (ops, bytes, autoColor), enabled, op, row,
    col, h, w, a, b and, where there are mask scopes, mask: one byte per MCU,
    00 outside. Byte steps act on the file before anything is decoded and are
    not part of this list. h = 0 makes the scope a run of w MCUs (0 = to
    the end). Step numbers may have any gaps: blocks count steps.
    """
    if "mask" not in steps.columns:
        steps = steps.withColumn("mask", F.lit(None).cast("binary"))
    numbered = blocked_row_number(
        steps.where("enabled"), ["image_id"], ["step_no"], F.expr(f"step_no div {16 * block}"), "_place"
    )
    return numbered.groupBy("image_id", F.expr(f"_place div {block}").alias("block")).agg(
        F.expr("array_sort(collect_list(CASE WHEN kind = 'ops' THEN struct(step_no, op, row, col, h, w, a, b, mask) END))").alias("ops"),
        F.expr("bool_or(kind = 'autoColor')").alias("auto_color"),
    )


class Pieces:
    """What a picture shows, as ranges of positions: rows (start, source at start, paste step or -1, flags, d0, d1, d2).

    Inside a range the source grows with the position; for pasted ranges it
    counts the places of the clip.
    """

    def __init__(self, total: int):
        self.total = total
        self.rows = np.array([[0, 0, -1, 0, 0, 0, 0]] if total else [], np.int64).reshape(-1, 7)
        self.merge_at = 1024

    def cut(self, lo: int, hi: int) -> np.ndarray:
        """The ranges of [lo, hi), as a copy."""
        lo, hi = max(lo, 0), min(hi, self.total)
        if lo >= hi:
            return self.rows[:0].copy()
        first = np.searchsorted(self.rows[:, 0], lo, side="right") - 1
        out = self.rows[first : np.searchsorted(self.rows[:, 0], hi)].copy()
        out[0, 1] += lo - out[0, 0]
        out[0, 0] = lo
        return out

    def show(self, lo: np.ndarray, hi: np.ndarray, shift: int, change) -> None:
        """Each of the ascending ranges [lo, hi) shows what lies `shift` on, after `change` of its rows."""
        lo, hi = np.maximum(lo, max(0, -shift)), np.minimum(hi, self.total - max(0, shift))
        lo, hi = lo[lo < hi], hi[lo < hi]
        if not len(lo):
            return
        self.rows = self._few(lo, hi, shift, change) if len(lo) <= 32 else self._many(lo, hi, shift, change)
        if len(self.rows) > self.merge_at:
            self.merge()
            self.merge_at = 2 * len(self.rows) + 1024

    def _few(self, lo: np.ndarray, hi: np.ndarray, shift: int, change) -> np.ndarray:
        parts, at = [], 0
        for x, y in zip(lo.tolist(), hi.tolist(), strict=True):
            there = self.cut(x + shift, y + shift)
            there[:, 0] -= shift
            change(there)
            parts += [self.cut(at, x), there]
            at = y
        return np.concatenate([*parts, self.cut(at, self.total)])

    def _many(self, lo: np.ndarray, hi: np.ndarray, shift: int, change) -> np.ndarray:
        old = self.rows[:, 0]

        def inside(at: np.ndarray) -> np.ndarray:
            k = np.searchsorted(lo, at, side="right") - 1
            return (k >= 0) & (at < hi[np.maximum(k, 0)])

        come = old - shift
        starts = np.unique(np.concatenate([old[~inside(old)], come[inside(come)], lo, hi[hi < self.total]]))
        of_range = inside(starts)
        look = starts + np.where(of_range, shift, 0)
        row = np.searchsorted(old, look, side="right") - 1
        new = self.rows[row]
        new[:, 1] += look - new[:, 0]
        new[:, 0] = starts
        there = new[of_range]
        change(there)
        new[of_range] = there
        return new

    def merge(self) -> None:
        """Ranges that go on from the one before are one with it."""
        r = self.rows
        if len(r):
            on = (np.diff(r[:, 0]) == np.diff(r[:, 1])) & (r[1:, 2:] == r[:-1, 2:]).all(axis=1)
            self.rows = r[np.r_[True, ~on]]

    def lengths(self) -> np.ndarray:
        return np.diff(np.append(self.rows[:, 0], self.total))


def _scope(o, start: int, width: int, units: int, total: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending ranges of the positions an operation's scope covers, those left out whose column + b lies outside."""
    mask, h, w = o["mask"], o["h"] or 0, o["w"] or 0
    left, right = max(0, -b), min(width, width - b)
    if mask is not None:
        lit = np.frombuffer(mask, np.uint8) != 0
        col = np.arange(len(lit)) % width
        edge = np.flatnonzero(np.diff(np.r_[0, lit & (col >= left) & (col < right), 0].astype(np.int8)))
        return edge[::2] * units, edge[1::2] * units
    if h > 0:
        lo, hi = start, start + ((h - 1) * width + w) * units
        left, right = max(left, o["col"]), min(right, o["col"] + w)
    else:
        lo, hi = start, start + w * units if w > 0 else total
    if (left, right) == (0, width):
        return np.array([lo]), np.array([hi])
    line = width * units
    row = np.arange(max(lo, 0) // line, -(-min(hi, total) // line)) * line
    x, y = np.maximum(lo, row + left * units), np.minimum(hi, row + right * units)
    return x[x < y], y[x < y]


def apply_operation(pieces: Pieces, o, width: int, units: int = 1) -> None:
    """One step of a recipe on the ranges of a picture."""
    op, a, b, total = o["op"], o["a"] or 0, o["b"] or 0, pieces.total
    single = op in ("unitInsert", "unitDelete")
    if single and units == 1:
        raise ValueError(f"operation on single blocks needs a grid of blocks: {op}")
    at = (o["row"] * width + o["col"]) * units + (b if single else 0)
    n = a * (1 if single else units)

    def moved(rows):
        rows[:, 3] |= MOVED

    def lifted(rows):
        rows[:, 3] |= DC
        if 0 <= a <= 2:
            rows[:, 4 + a] += b

    def pasted(rows):
        start = rows[0, 0]
        rows[:] = [0, 0, o["step_no"], PASTED, 0, 0, 0]
        rows[:, 0] = start
        rows[:, 1] = start - at

    if op in ("insert", "unitInsert"):
        pieces.show(np.array([at + n]), np.array([total]), -n, moved)
    elif op in ("delete", "unitDelete"):
        pieces.show(np.array([at]), np.array([total]), n, moved)
    elif op == "paste":
        lo, hi = max(at, 0), min(at + n, total)
        if lo < hi:
            one = pieces.cut(lo, lo + 1)
            pasted(one)
            pieces.rows = np.concatenate([pieces.cut(0, lo), one, pieces.cut(hi, total)])
    elif op == "cdelta":
        pieces.show(*_scope(o, at, width, units, total, 0), 0, lifted)
    elif op == "copy":
        pieces.show(*_scope(o, at, width, units, total, b), (a * width + b) * units, moved)
    else:
        raise ValueError(f"unknown operation: {op}")


#: No range that a row holds is longer, so that spreading it to positions stays small.
LONGEST = 1 << 16

#: Ranges of finished pictures are handed on once there are so many.
RANGES = 1 << 14


def compiled(sizes: DataFrame, recipe: DataFrame, units: int = 1) -> DataFrame:
    """Each picture's recipe as ranges: image_id, lo, hi, src, step, flags, d0, d1, d2.

    `sizes`: image_id, total, wide. A recipe streams by, in blocks of steps, and
    only the picture's ranges are held, of which there are never more than
    positions; pictures without a recipe are one range. The work lies in the steps, not
    in their few bytes, so the number of tasks is fixed and not left to the size of the shuffle.
    """
    schema = T.StructType([sizes.schema["image_id"]])
    ordered = (
        sizes.join(recipe.select("image_id", "block", "ops"), "image_id", "left")
        .select(F.to_json(F.struct("image_id")).alias("key"), "total", "wide", "block", "ops")
        .repartition(shuffle_partitions(sizes.sparkSession), "key")
        .sortWithinPartitions("key", "block")
    )
    names = ("key", "lo", "hi", "src", "step", "flags", "d0", "d1", "d2")

    def rows_of(key: str, pieces: Pieces) -> list[np.ndarray]:
        pieces.merge()
        r, n = pieces.rows, pieces.lengths()
        parts = -(-n // LONGEST)
        row = np.repeat(np.arange(len(r)), parts)
        skip = (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * LONGEST
        lo = r[row, 0] + skip
        hi = np.minimum(lo + LONGEST, (r[:, 0] + n)[row])
        return [np.full(len(row), key, object), lo, hi, r[row, 1] + skip, *r[row, 2:].T]

    types = pa.schema([(c, pa.string() if c == "key" else pa.int32() if c == "flags" else pa.int64()) for c in names])

    def frame(done: list[list[np.ndarray]]) -> pa.RecordBatch:
        columns = (np.concatenate(parts) for parts in zip(*done, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.types, strict=True)], schema=types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = pieces = None
        done, held = [], 0
        for batch in batches:
            # Only the steps of one block become Python objects at a time; a batch holds thousands of blocks.
            keys, totals, wides = (batch.column(c).to_pylist() for c in ("key", "total", "wide"))
            for key, total, wide, ops in zip(keys, totals, wides, batch.column("ops"), strict=True):
                if key != now:
                    if pieces is not None:
                        done.append(rows_of(now, pieces))
                        held += len(done[-1][0])
                        if held >= RANGES:
                            yield frame(done)
                            done, held = [], 0
                    now, pieces = key, Pieces(int(total))
                for o in ops.as_py() or ():
                    apply_operation(pieces, o, int(wide), units)
        if pieces is not None:
            yield frame([*done, rows_of(now, pieces)])

    found = ordered.mapInArrow(
        run, "key string, lo bigint, hi bigint, src bigint, step bigint, flags int, d0 bigint, d1 bigint, d2 bigint"
    )
    return found.select(F.from_json("key", schema)["image_id"].alias("image_id"), *[c for c in found.columns if c != "key"])


def trace(grid: DataFrame, recipe: DataFrame, width: Size, units: int = 1) -> DataFrame:
    """image_id, m, src, flags, d0, d1, d2, paste_step, paste_i: every position of the pictures in `grid`.

    `src` is the original position shown at m, NULL for pasted content (then
    paste_step and paste_i say which); d0..d2 are the DC offsets added on the
    way. `grid`: image_id, total, and `width`, if it is a column, in any number of rows a picture; a picture's
    positions are 0 to total - 1. With `units` blocks per MCU the positions m
    and total count blocks, and unit operations (a blocks at block b of the MCU
    at row, col) can be traced; without, they are an error, as is any unknown
    operation.

    A recipe is compiled once per picture to ranges, and these are spread to
    positions; no step is looked at again for a position. Ranges are dealt by
    picture and place, so one large picture is many tasks.
    """
    wide = F.expr(f"cast({width} as bigint)")
    sizes = grid.groupBy("image_id").agg(F.max("total").cast("bigint").alias("total"), F.max(wide).alias("wide"))
    ranges = compiled(sizes, recipe, units).repartition(shuffle_partitions(grid.sparkSession), "image_id", "lo")
    spread = ranges.select("*", F.explode(F.expr("sequence(lo, hi - 1)")).alias("m"))
    live = "step < 0"
    return spread.select(
        "image_id",
        "m",
        F.expr(f"CASE WHEN {live} THEN src + (m - lo) END").alias("src"),
        "flags",
        "d0",
        "d1",
        "d2",
        F.expr(f"CASE WHEN NOT ({live}) THEN step END").alias("paste_step"),
        F.expr(f"CASE WHEN NOT ({live}) THEN src + (m - lo) END").alias("paste_i"),
    )


def replay(
    base: DataFrame, recipe: DataFrame, width: Size, clips: DataFrame | None = None, channels=("y", "cb", "cr"), traced: DataFrame | None = None
) -> DataFrame:
    """image_id, m, src, flags and the channels of the repaired picture.

    `base`: image_id, m, the channels (DC values) and, without `traced`, total, and `width`, if it
    is a column; `clips`: image_id, paste_step, paste_i and the channels, what
    each paste step writes. `traced` may hold the trace, where it is at hand.
    """
    traced = trace(base, recipe, width) if traced is None else traced
    source = base.select("image_id", F.col("m").alias("src"), *[F.col(c).alias(f"_{c}") for c in channels])
    out = traced.join(source, ["image_id", "src"], "left")
    if clips is not None:
        pasted = clips.select("image_id", "paste_step", "paste_i", *[F.col(c).alias(f"_p_{c}") for c in channels])
        out = out.join(pasted, ["image_id", "paste_step", "paste_i"], "left")
        value = lambda c: F.coalesce(f"_{c}", f"_p_{c}")
    else:
        value = lambda c: F.col(f"_{c}")
    return out.select("image_id", "m", "src", "flags", *[(value(c) + F.col(f"d{i}")).alias(c) for i, c in enumerate(channels)])


def provenance(traced: DataFrame, empty: DataFrame, recipe: DataFrame) -> DataFrame:
    """image_id, m, flags with NO_DATA where the source MCU held nothing and REENCODED after an automatic correction.

    `empty`: image_id, m of original MCUs whose coefficients are all zero.
    """
    hollow = empty.select("image_id", F.col("m").alias("src"), F.lit(NO_DATA).alias("_e"))
    auto = recipe.where("auto_color").select("image_id").distinct().withColumn("_r", F.lit(REENCODED))
    return (
        traced.join(hollow, ["image_id", "src"], "left")
        .join(auto, "image_id", "left")
        .select("image_id", "m", F.expr("flags | coalesce(_e, 0) | coalesce(_r, 0)").alias("flags"))
    )


def provenance_counts(prov: DataFrame) -> DataFrame:
    """image_id, total, untouched, moved, dc, pasted, no_data, reencoded; flags may overlap."""
    has = lambda bit: F.count_if(F.col("flags").bitwiseAND(bit) != 0)
    return prov.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("flags") == 0).alias("untouched"),
        has(MOVED).alias("moved"),
        has(DC).alias("dc"),
        has(PASTED).alias("pasted"),
        has(NO_DATA).alias("no_data"),
        has(REENCODED).alias("reencoded"),
    )


def overlay_class() -> str:
    """SQL: the one class shown for an MCU; missing data beats pasted, moved, DC, re-encoded."""
    return (
        f"CASE WHEN flags & {NO_DATA} <> 0 THEN 'no_data' WHEN flags & {PASTED} <> 0 THEN 'pasted' "
        f"WHEN flags & {MOVED} <> 0 THEN 'moved' WHEN flags & {DC} <> 0 THEN 'dc' "
        f"WHEN flags & {REENCODED} <> 0 THEN 'reencoded' ELSE 'untouched' END"
    )
