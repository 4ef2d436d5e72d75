"""Edits of coefficients, MCU positions and bytes.

Moving MCUs is a map from each position to the position it shows. Tails the
format leaves open follow one rule here: an insert keeps the first n MCUs at
the seam where they were (so they appear twice) and drops what runs past the
end; a delete keeps the content of the last n positions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendframe.functions.blocked import BLOCK, blocked_row_number
from mendframe.functions.bytes import cut, u8
from mendframe.functions.once import once
from mendframe.functions.scans import Follower, block_scan
from mendframe.functions.sizes import Size

STEP_LIMIT = 2047
AC_LIMIT = 1023
COEF_LIMIT = 32767


def cdelta(blocks: DataFrame, comp: int, delta: int, scope: Column) -> DataFrame:
    """Adds `delta` to the DC of one component's blocks in scope; stored values are never clipped."""
    moved = F.expr(f"transform(coef, (x, i) -> CASE WHEN i = 0 THEN x + {delta} ELSE x END)")
    return blocks.withColumn("coef", F.when(scope & (F.col("comp") == comp), moved).otherwise(F.col("coef")))


def show_from(mcus: DataFrame, source: Column, payload: list[str], key: str = "image_id", pos: str = "m") -> DataFrame:
    """Each position shows the payload of position `source`; its own where that one does not exist.

    One equi-join on (key, position): a long image spreads over all tasks.
    """
    asked = mcus.withColumn("_src", source)
    content = mcus.select(key, F.col(pos).alias("_src"), *[F.col(c).alias(f"_n_{c}") for c in payload], F.lit(True).alias("_hit"))
    joined = asked.join(content, [key, "_src"], "left")
    return joined.select(
        *[
            F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in payload else F.col(c)
            for c in mcus.columns
        ]
    )


def copy_blocks(mcus: DataFrame, d_row: int, d_col: int, scope: Column, width: Size, payload: list[str]) -> DataFrame:
    """MCUs in scope take what lies (d_row, d_col) away; a source outside the grid leaves them as they are.

    `width` is a number, or a column of `mcus`.
    """
    if d_row == 0 and d_col == 0:
        raise ValueError("a copy needs an offset")
    wide = F.expr(f"cast({width} as bigint)")
    inside = (F.col("col") + d_col >= 0) & (F.col("col") + d_col < wide) & (F.col("row") + d_row >= 0)
    return show_from(mcus, F.when(scope & inside, F.col("m") + d_row * wide + d_col).otherwise(F.col("m")), payload)


def insert_source(n: int | str, at: int | str, pos: str = "m") -> Column:
    return F.expr(f"CASE WHEN {pos} >= {at} + {n} THEN {pos} - {n} ELSE {pos} END")


def delete_source(n: int | str, at: int | str, pos: str = "m") -> Column:
    return F.expr(f"CASE WHEN {pos} >= {at} THEN {pos} + {n} ELSE {pos} END")


def insert_mcus(mcus: DataFrame, n: int, at: int | str, payload: list[str]) -> DataFrame:
    return show_from(mcus, insert_source(n, at), payload)


def delete_mcus(mcus: DataFrame, n: int, at: int | str, payload: list[str]) -> DataFrame:
    return show_from(mcus, delete_source(n, at), payload)


def insert_units(blocks: DataFrame, n: int, at: int, payload: list[str]) -> DataFrame:
    """As `insert_mcus`, on single blocks (unit = m * blocks per MCU + unit within it)."""
    return show_from(blocks, insert_source(n, at, "unit"), payload, pos="unit")


def delete_units(blocks: DataFrame, n: int, at: int, payload: list[str]) -> DataFrame:
    return show_from(blocks, delete_source(n, at, "unit"), payload, pos="unit")


def paste(mcus: DataFrame, at: int | str, clip: DataFrame, payload: list[str]) -> DataFrame:
    """Overwrites in scan order from `at` with the clip (image_id, i, payload), stopping at the end."""
    put = clip.select("image_id", F.expr(f"i + {at}").alias("m"), *[F.col(c).alias(f"_n_{c}") for c in payload], F.lit(True).alias("_hit"))
    joined = mcus.join(put, ["image_id", "m"], "left")
    return joined.select(
        *[
            F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in payload else F.col(c)
            for c in mcus.columns
        ]
    )


def paste_insert(mcus: DataFrame, n: int, at: int, clip: DataFrame, payload: list[str]) -> DataFrame:
    return paste(insert_mcus(mcus, n, at, payload), at, clip, payload)


def fill_scope(mcus: DataFrame, scope: Column, fill: DataFrame, payload: list[str]) -> DataFrame:
    """The i-th MCU in scope, in scan order, takes the i-th payload (image_id, i, payload)."""
    numbered = blocked_row_number(
        mcus.where(scope).select("image_id", "m"), ["image_id"], ["m"], F.expr(f"m div {BLOCK}"), "i"
    )
    put = numbered.join(fill, ["image_id", "i"]).select("image_id", "m", *[F.col(c).alias(f"_n_{c}") for c in payload], F.lit(True).alias("_hit"))
    joined = mcus.join(put, ["image_id", "m"], "left")
    return joined.select(
        *[
            F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in payload else F.col(c)
            for c in mcus.columns
        ]
    )


def read_mcus(mcus: DataFrame, at: int | str, n: int | str) -> DataFrame:
    """A run in scan order as a clip: `i` counts from 0; it ends where the image does."""
    return mcus.where(F.expr(f"m >= {at} AND m < {at} + {n}")).withColumn("i", F.expr(f"m - {at}"))


def requantize(clip: DataFrame, q_src: str = "q_src", q_dst: str = "q_dst") -> DataFrame:
    """Coefficients moved from one quantization to another, half away from zero, within 16 bits."""
    scaled = (
        f"transform(coef, (c, i) -> CASE WHEN c = 0 OR get({q_dst}, i) = 0 THEN c ELSE "
        f"cast(least({COEF_LIMIT}, greatest({-COEF_LIMIT}, round(cast(c as double) * get({q_src}, i) / get({q_dst}, i)))) as bigint) END)"
    )
    return clip.withColumn("coef", F.expr(scaled))


def clip_fits(clips: DataFrame, frames: DataFrame) -> DataFrame:
    """clip_id, file_id, fits: same component count, blocks per MCU and sampling. Candidates meet by component count and blocks."""
    mine = frames.select(
        "file_id", "components", "h_samp", "v_samp",
        F.expr("aggregate(zip_with(h_samp, v_samp, (h, v) -> h * v), 0, (a, b) -> a + b)").alias("blocks"),
    )
    theirs = clips.select("clip_id", "target_id", F.col("components").alias("_nc"), F.col("h_samp").alias("_h"), F.col("v_samp").alias("_v"), F.col("blocks").alias("_b"))
    return theirs.join(mine, F.col("target_id") == F.col("file_id")).select(
        "clip_id", "file_id", F.expr("_nc = components AND _b = blocks AND _h = h_samp AND _v = v_samp").alias("fits")
    )


def same_quant(clip_quant: DataFrame, quant: DataFrame) -> DataFrame:
    """clip_id, same: every component's table equal."""
    return (
        clip_quant.withColumnRenamed("q", "_q")
        .join(quant, ["image_id", "comp"])
        .groupBy("clip_id")
        .agg(F.expr("bool_and(_q = q)").alias("same"))
    )


def _follower(values: np.ndarray) -> list[int]:
    f = Follower(STEP_LIMIT)
    for x in values.tolist():
        f.take(x)
    return f.description()


def _followed(values: np.ndarray, state: tuple[int, ...]) -> list[np.ndarray]:
    p, out = state[0], np.empty(len(values), np.int64)
    for k, x in enumerate(values.tolist()):
        p = min(p + STEP_LIMIT, max(p - STEP_LIMIT, x))
        out[k] = p
    return [out]


def output_dc(blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """image_id, comp, unit, out_dc: DC values as they are written, each within 2047 of the one before.

    The first one counts from 0. Every value depends on the one written before
    it: a block of the sequence is a monotone function of that value, linear
    in pieces, so three passes do for any data, steps beyond the limit in
    every block included.
    """
    values = blocks.select("image_id", "comp", "unit", F.expr("get(coef, 0)").alias("dc"))
    return block_scan(
        values, ["image_id", "comp"], "unit", "dc", block, (0,),
        _follower, lambda state, f: (Follower.value(f, state[0]),), _followed, ["out_dc"],
    )


def clamp_ac(blocks: DataFrame) -> DataFrame:
    """Adds `out_coef`: AC values within 1023; the DC is left to `output_dc`."""
    return blocks.withColumn(
        "out_coef",
        F.expr(f"transform(coef, (x, i) -> CASE WHEN i = 0 THEN x ELSE least({AC_LIMIT}, greatest({-AC_LIMIT}, x)) END)"),
    )


def changed_rows(before: DataFrame, after: DataFrame, payload: list[str]) -> DataFrame:
    """image_id, row: MCU rows that differ, widened by one each way; every row where the grids differ.

    Both inputs: image_id, m, row and the payload compared.
    """
    b = before.select("image_id", "m", "row", F.struct(*payload).alias("_b"))
    a = after.select("image_id", "m", F.col("row").alias("_row"), F.struct(*payload).alias("_a"))
    both = b.join(a, ["image_id", "m"], "full_outer")
    last = before.groupBy("image_id").agg(F.max("row").alias("_last"))
    marks = both.select(
        "image_id", "row", (~F.col("_b").eqNullSafe(F.col("_a"))).alias("_diff"),
        (F.col("row").isNull() | F.col("_row").isNull() | (F.col("row") != F.col("_row"))).alias("_geo"),
    )
    geo = marks.groupBy("image_id").agg(F.expr("bool_or(_geo)").alias("_all"))
    spread = (
        marks.where("_diff AND row IS NOT NULL")
        .select("image_id", F.explode(F.expr("array(row - 1, row, row + 1)")).alias("row"))
        .distinct()
    )
    whole = geo.where("_all").join(last, "image_id").select("image_id", F.explode(F.expr("sequence(0L, _last)")).alias("row"))
    return (
        spread.join(last, "image_id").where("row BETWEEN 0 AND _last").select("image_id", "row").unionByName(whole).distinct()
    )


def apply_byte_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """file_id, content, error: each file after its ordered edits.

    Files without edits come back as they are.

    `edits`: file_id, edit_no, kind, offset, bit, count, data. Offsets refer to
    the result of the edit before. deleteBytes, insertBytes, flipBit and
    truncate are byte operations; an edit outside the file stops the list with
    `error` set and the content as it was before that edit.
    """
    listed = edits.groupBy("file_id").agg(
        F.expr("array_sort(collect_list(struct(edit_no, kind, offset, bit, count, data)))").alias("_e")
    )
    b, n = "s.b", "length(s.b)"
    flipped = f"unhex(lpad(hex({u8(b, 'e.offset')} ^ shiftright(128, cast(e.bit as int))), 2, '0'))"
    step = f"""CASE
      WHEN s.error IS NOT NULL THEN s
      WHEN (e.kind = 'deleteBytes' AND (e.offset < 0 OR e.count < 0 OR e.offset + e.count > {n}))
        OR (e.kind = 'insertBytes' AND (e.offset < 0 OR e.offset > {n}))
        OR (e.kind = 'flipBit' AND (e.offset < 0 OR e.offset >= {n}))
        OR (e.kind = 'truncate' AND (e.offset < 2 OR e.offset > {n}))
        THEN named_struct('b', s.b, 'error', concat('edit ', e.edit_no, ' is outside the file'))
      WHEN e.kind NOT IN ('deleteBytes', 'insertBytes', 'flipBit', 'truncate')
        THEN named_struct('b', s.b, 'error', concat('edit ', e.edit_no, ' needs the bit stream'))
      ELSE named_struct('b', CASE e.kind
        WHEN 'deleteBytes' THEN concat({cut(b, '0', 'e.offset')}, {cut(b, 'e.offset + e.count', f'{n} - e.offset - e.count')})
        WHEN 'insertBytes' THEN concat({cut(b, '0', 'e.offset')}, e.data, {cut(b, 'e.offset', f'{n} - e.offset')})
        WHEN 'flipBit' THEN concat({cut(b, '0', 'e.offset')}, {flipped}, {cut(b, 'e.offset + 1', f'{n} - e.offset - 1')})
        ELSE concat({cut(b, '0', 'e.offset')}, X'FFD9') END, 'error', cast(null as string)) END"""
    fold = f"aggregate(_e, named_struct('b', content, 'error', cast(null as string)), (s, e) -> {step})"
    return (
        files.join(listed, "file_id", "left")
        .withColumn("_r", once(f"CASE WHEN _e IS NULL THEN named_struct('b', content, 'error', cast(null as string)) ELSE {fold} END"))
        .select("file_id", F.col("_r.b").alias("content"), F.col("_r.error").alias("error"))
    )
