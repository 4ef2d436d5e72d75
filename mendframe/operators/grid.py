"""Damage on the MCU grid: scores, shifts, offsets, selections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendframe.functions.blocked import BLOCK, carried
from mendframe.functions.dct import EDGES, edge_expr
from mendframe.functions.lineage import materialize, shuffle_partitions
from mendframe.functions.once import once
from mendframe.functions.sizes import Size, size_columns
from mendframe.functions.stats import upper_median

THRESHOLD = 0.5


def edge_samples(blocks: DataFrame, quant: DataFrame) -> DataFrame:
    """Adds top, bottom, left, right: 8 samples along each edge of each block."""
    df = blocks.join(quant, ["image_id", "comp"]).withColumn(
        "_dq", once("zip_with(coef, q, (c, k) -> cast(c * k as double))")
    )
    return df.select("*", *[F.expr(edge_expr(e, "_dq")).alias(e) for e in EDGES]).drop("_dq")


def _step(order: str, along: str, cols: list[str]) -> list[Column]:
    """Absolute difference to the previous pixel along `order`, NULL at a gap."""
    w = Window.partitionBy("image_id", along).orderBy(order)
    prev = lambda c: F.when(F.lag(order).over(w) == F.col(order) - 1, F.lag(c).over(w))
    return [F.abs(F.col(c) - prev(c)).alias(f"_d{order}_{c}") for c in cols]


def damage_score(
    pixels: DataFrame, width: Size, height: Size, mcu_w: Size, mcu_h: Size, mcus: DataFrame | None = None,
    traced: DataFrame | None = None,
) -> DataFrame:
    """image_id, m, score: how badly each MCU meets the ones above and to the left of it.

    The step across the top and left edges (luma plus half the chroma) is
    compared with the steps inside the MCU. MCUs the map calls anomalous score
    1; with a trace (`traced`: image_id, m, src) the map is looked up at the MCU
    that m shows, and pasted ones are not looked up. Sizes are numbers, or columns of `pixels`. Neighbours come from windows
    over single pixel rows and columns, so a large picture is spread over its
    rows.
    """
    chans = ["c0", "c1", "c2"]
    df = pixels.select("*", *_step("x", "y", chans)).select("*", *_step("y", "x", chans))
    cols = f"(({width} + {mcu_w} - 1) div {mcu_w})"
    df = df.select(
        "*",
        F.expr(f"y div {mcu_h}").alias("_r"),
        F.expr(f"x div {mcu_w}").alias("_c"),
        F.expr(f"y % {mcu_h}").alias("_y"),
        F.expr(f"x % {mcu_w}").alias("_x"),
    ).withColumn("_h", F.expr(f"least({mcu_h}, {height} - _r * {mcu_h})")).withColumn(
        "_w", F.expr(f"least({mcu_w}, {width} - _c * {mcu_w})")
    )
    in_y = "_y > 0 AND (_y - 1) % greatest(1, _h div 4) = 0"
    in_x = "_x > 0 AND (_x - 1) % greatest(1, _w div 4) = 0"
    pick = lambda cond, v: F.sum(F.expr(f"CASE WHEN {cond} THEN {v} END"))
    cnt = lambda cond, v: F.count(F.expr(f"CASE WHEN {cond} THEN {v} END"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    per = df.groupBy("image_id", F.expr(f"_r * {cols} + _c").alias("m")).agg(
        (zero(pick(in_y, "_dy_c0")) + zero(pick(in_x, "_dx_c0"))).alias("_inner"),
        (cnt(in_y, "_dy_c0") + cnt(in_x, "_dx_c0")).alias("_inner_n"),
        (zero(pick("_y = 0", "_dy_c0")) + zero(pick("_x = 0", "_dx_c0"))).alias("_seam"),
        (zero(pick("_y = 0", "_dy_c1 + _dy_c2")) + zero(pick("_x = 0", "_dx_c1 + _dx_c2"))).alias("_chroma"),
        (cnt("_y = 0", "_dy_c0") + cnt("_x = 0", "_dx_c0")).alias("_seam_n"),
    )
    ratio = "(_seam / _seam_n + 0.5D * _chroma / _seam_n) / (CASE WHEN _inner_n > 0 THEN _inner / _inner_n ELSE 0 END + 4)"
    scored = per.select(
        "image_id",
        "m",
        F.expr(f"CASE WHEN _seam_n > 0 THEN least(1D, greatest(0D, ({ratio} - 2) / 6)) ELSE 0D END").alias("score"),
    )
    if mcus is None:
        return scored
    bad = mcus.where("anomalies <> 0").select("image_id", "m", F.lit(True).alias("_bad"))
    if traced is not None:
        bad = traced.select("image_id", "m", "src").join(bad.withColumnRenamed("m", "src"), ["image_id", "src"]).drop("src")
    return scored.join(bad, ["image_id", "m"], "left").select(
        "image_id", "m", F.when(F.col("_bad"), F.lit(1.0)).otherwise(F.col("score")).alias("score")
    )


def damage_mask(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scores.where(F.col("score") >= threshold)


def next_damaged(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Adds `next_m`: the next damaged MCU after each one, wrapping to the first; NULL if none."""
    hit = F.when(F.col("score") >= threshold, F.col("m"))
    block = F.expr(f"m div {BLOCK}")
    ahead = carried(scores, ["image_id"], ["m"], block, hit, "min", "_ahead", backwards=True, inclusive=False)
    first = scores.groupBy("image_id").agg(F.min(hit).alias("_first"))
    return ahead.join(first, "image_id", "left").select(
        *scores.columns, F.coalesce("_ahead", "_first").alias("next_m")
    )


def _align_sums(start: int, width: int, most: int, m: np.ndarray, chans: np.ndarray) -> np.ndarray:
    """shift, n and the summed and squared differences of each channel, a column for each shift of one start."""
    low = start - max(width, most)
    values = np.full((len(chans), width + most + max(width, most)), np.nan)
    values[:, m - low] = chans
    seen = np.zeros(values.shape[1], bool)
    seen[m - low] = True
    row = np.arange(start, start + width) - low
    row = row[seen[row] & seen[row - width]]
    above, out = values[:, row - width][:, None, :], []
    # Shifts are tried in lots, so that a wide row at many shifts stays small.
    lot = max(1, (1 << 18) // width)
    for first in range(-most, most + 1, lot):
        shifts = np.arange(first, min(first + lot, most + 1))
        shown = row[None, :] - shifts[:, None]
        diff, n = values[:, shown] - above, seen[shown].sum(axis=1)
        known = ~np.isnan(diff)
        diff = np.where(known, diff, 0)
        of = lambda d: np.where(known.any(axis=2), d.sum(axis=2), np.nan)  # noqa: B023
        out.append(np.vstack([shifts, n, of(diff), of(diff * diff)])[:, n > 0])
    return np.concatenate(out, axis=1)


def auto_align(mcus: DataFrame, starts: DataFrame, width: Size, max_shift: Size) -> DataFrame:
    """image_id, shift, offset_y, offset_cb, offset_cr, cost, rank: which shift re-aligns the stream.

    At shift k, position p of the row that begins at `start` shows p - k and
    is compared with p - width. The cost is the spread of the difference, so
    a plain offset costs nothing; it is reported instead. `width` is a number or
    a column of `starts`, `max_shift` likewise. Only the MCUs that a start can reach shuffle, once,
    to that start; all its shifts are compared there with arrays, and only sums leave it.
    """
    chans = ["y", "cb", "cr"]
    begin = starts.select("image_id", "start", F.expr(f"cast({width} as bigint)").alias("_w"), F.expr(f"cast({max_shift} as bigint)").alias("_most"))
    begin = begin.where("start >= _w")
    bounds = begin.agg(F.expr("min(start - greatest(_w, _most))").alias("_lo"), F.expr("max(start + _w + _most)").alias("_hi"))
    # DC values are whole and small: their sums are exact as doubles.
    met = (
        mcus.select("image_id", "m", *chans)
        .join(F.broadcast(bounds), F.expr("m BETWEEN _lo AND _hi"))
        .drop("_lo", "_hi")
        .repartition(shuffle_partitions(mcus.sparkSession), "image_id")
        .join(begin, "image_id")
        .where("m BETWEEN start - greatest(_w, _most) AND start + _w + _most - 1")
        .groupBy("image_id", "start", "_w", "_most")
        .agg(F.collect_list("m").alias("m"), *[F.expr(f"collect_list(coalesce(cast({c} as double), double('NaN')))").alias(c) for c in chans])
    )
    names = ["shift", "n", *[f"{k}{c}" for k in ("_s", "_q") for c in chans]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                lot = batch.iloc[at : at + 256]
                per = [
                    _align_sums(int(start), int(w), int(most), np.asarray(m), np.array(values))
                    for start, w, most, m, *values in zip(*[lot[c] for c in ("start", "_w", "_most", "m", *chans)], strict=True)
                ]
                out = pd.DataFrame(dict(zip(names, np.concatenate(per, axis=1), strict=True))).astype({"shift": np.int64, "n": np.int64})
                out.insert(0, "image_id", np.repeat(lot["image_id"].to_numpy(), [p.shape[1] for p in per]))
                yield out

    types = {"shift": "bigint", "n": "bigint"}
    schema = f"image_id {mcus.schema['image_id'].dataType.simpleString()}, " + ", ".join(f"{c} {types.get(c, 'double')}" for c in names)
    sums = met.mapInPandas(run, schema).groupBy("image_id", "shift").agg(*[F.sum(c).alias(c) for c in names[1:]]).where("n >= 8")
    sd = lambda c: f"sqrt(greatest(0D, _q{c} / n - (_s{c} / n) * (_s{c} / n)))"
    w = Window.partitionBy("image_id").orderBy(F.round("cost", 9), F.abs("shift"), "shift")
    return (
        sums.withColumn("cost", F.expr(f"{sd('y')} + 0.5D * {sd('cb')} + 0.5D * {sd('cr')}"))
        .withColumn("rank", F.row_number().over(w))
        .select("image_id", "shift", *[F.expr(f"_s{c} / n").alias(f"offset_{c}") for c in chans], "cost", "rank")
    )


def estimate_dc(edges: DataFrame, mask: DataFrame, quant: DataFrame) -> DataFrame:
    """image_id, comp, shift, cdelta, boundary, confidence: the offset a selection needs to meet its surroundings.

    `edges`: image_id, m, comp, brow, bcol and the edge samples; `mask`:
    image_id, m. Differences are taken where only one side of a block edge is
    selected; their upper median per channel is the shift. Confidence falls
    with the spread of luma. Where `edges` has brows and bcols, the rows and
    columns of blocks that hold picture, blocks beyond them are padding and are
    not compared.
    """
    if {"brows", "bcols"} <= set(edges.columns):
        edges = edges.where("brow < brows AND bcol < bcols")
    key = ["image_id", "comp", "brow", "bcol"]
    inside = edges.join(mask.select("image_id", "m"), ["image_id", "m"], "left_semi")
    outside = edges.join(mask.select("image_id", "m"), ["image_id", "m"], "left_anti")
    above = outside.select("image_id", "comp", (F.col("brow") + 1).alias("brow"), "bcol", F.col("bottom").alias("_out"))
    left = outside.select("image_id", "comp", "brow", (F.col("bcol") + 1).alias("bcol"), F.col("right").alias("_out"))
    diff = lambda side, there: inside.join(there, key).select(
        "image_id", "comp", F.explode(F.expr(f"zip_with(_out, {side}, (o, i) -> round(o - i, 6))")).alias("d")
    )
    # The edges of the selection only: small next to the blocks, and needed three times.
    diffs = materialize(diff("top", above).unionByName(diff("left", left)))
    shift = upper_median(diffs, ["image_id", "comp"], "d", "shift")
    luma = diffs.where("comp = 0").join(
        shift.where("comp = 0").select("image_id", F.col("shift").alias("_s0")), "image_id"
    )
    spread = upper_median(
        luma.select("image_id", F.expr("round(abs(d - _s0), 6)").alias("dev")), ["image_id"], "dev", "_spread"
    ).select("image_id", "_spread")
    enough = shift.where("comp = 0 AND n >= 8").select("image_id", F.col("n").alias("boundary"))
    q00 = quant.select("image_id", "comp", F.expr("get(q, 0)").alias("_q"))
    return (
        shift.join(enough, "image_id")
        .join(spread, "image_id")
        .join(q00, ["image_id", "comp"])
        .select(
            "image_id",
            "comp",
            "shift",
            F.expr("cast(least(2047, greatest(-2047, round(shift * 8 / greatest(1, _q)))) as bigint)").alias("cdelta"),
            "boundary",
            F.expr("least(1D, greatest(0D, 1 - _spread / 24))").alias("confidence"),
        )
    )


def row_continuity(pixels: DataFrame, height: Size, mcu_h: Size, rows: Size) -> DataFrame:
    """image_id, cost: the step across MCU row borders over the step just below them; 1e9 when there is none.

    Sizes are numbers, or columns of `pixels`.
    """
    w = Window.partitionBy("image_id", "x").orderBy("y")
    border = F.expr(f"y % {mcu_h} = 0 AND y > 0 AND y < {rows} * {mcu_h}")
    up = F.when(F.lag("y").over(w) == F.col("y") - 1, F.abs(F.col("c0") - F.lag("c0").over(w)))
    down = F.when(F.lead("y").over(w) == F.col("y") + 1, F.abs(F.lead("c0").over(w) - F.col("c0")))
    near = pixels.where(F.expr(f"y <= {rows} * {mcu_h}"))
    df = near.select("image_id", up.alias("_u"), down.alias("_d"), border.alias("_border"))
    border = F.col("_border")
    sums = df.groupBy("image_id").agg(
        F.avg(F.when(border, F.col("_u"))).alias("_seam"), F.avg(F.when(border, F.col("_d"))).alias("_inner")
    )
    return sums.select("image_id", F.expr("coalesce(_seam / (_inner + 1), 1e9)").alias("cost"))


def scope_mask(
    kind: str, width: str = "width", row: str = "r0", col: str = "c0", count: str = "n", h: str = "h", w: str = "w",
    restart_interval: str = "restart_interval",
) -> Column:
    """Predicate on (m, row, col): is the MCU in scope?

    Kinds: run (from (r0, c0), `n` MCUs, 0 = to the end), rect, whole, restart
    (to the next restart marker). The arguments are column or SQL
    expressions, so each image can have its own scope. A mask scope is a
    semi-join instead.
    """
    start = f"({row} * {width} + {col})"
    tests = {
        "whole": "true",
        "run": f"m >= {start} AND ({count} <= 0 OR m < {start} + {count})",
        "rect": f"row >= {row} AND row < {row} + {h} AND col >= {col} AND col < {col} + {w}",
        "restart": f"m >= {start} AND ({restart_interval} <= 0 OR m < ({start} div nullif({restart_interval}, 0) + 1) * {restart_interval})",
    }
    return F.expr(tests[kind])


def selection_runs(mask: DataFrame, *sizes: Size) -> DataFrame:
    """image_id, row, c0, c1: maximal horizontal runs of selected MCUs, and the columns that `sizes` mention."""
    w = Window.partitionBy("image_id", "row").orderBy("col")
    carry = size_columns(mask, *sizes)
    return (
        mask.select("image_id", "row", "col", *carry, (F.col("col") - F.row_number().over(w)).alias("_g"))
        .groupBy("image_id", "row", "_g", *carry)
        .agg(F.min("col").alias("c0"), F.max("col").alias("c1"))
        .drop("_g")
    )


def selection_rects(mask: DataFrame, mcu_w: Size, mcu_h: Size, width: Size, height: Size) -> DataFrame:
    """image_id, x, y, w, h: the selection as pixel rectangles, one per run, clipped to the picture.

    Sizes are numbers, or columns of `mask`.
    """
    return (
        selection_runs(mask, mcu_w, mcu_h, width, height)
        .select(
            "image_id",
            F.expr(f"c0 * {mcu_w}").alias("x"),
            F.expr(f"row * {mcu_h}").alias("y"),
            F.expr(f"least((c1 + 1) * {mcu_w}, {width}) - c0 * {mcu_w}").alias("w"),
            F.expr(f"least((row + 1) * {mcu_h}, {height}) - row * {mcu_h}").alias("h"),
        )
        .where("w > 0 AND h > 0")
    )


def _touching(above: list[tuple], below: list[tuple]) -> list[tuple[int, int]]:
    """Pairs of places of runs (c0, c1) of two neighbouring rows, both in order, that touch at a side or corner."""
    pairs, i, j = [], 0, 0
    while i < len(above) and j < len(below):
        if above[i][0] <= below[j][1] + 1 and below[j][0] <= above[i][1] + 1:
            pairs.append((i, j))
        if above[i][1] <= below[j][1]:
            i += 1
        else:
            j += 1
    return pairs


def _label_band(runs: pd.DataFrame) -> pd.DataFrame:
    """The smallest id of the part of one band of rows that each run belongs to."""
    runs = runs.sort_values(["row", "c0"], ignore_index=True)
    root = list(range(len(runs)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    cells = list(zip(runs["c0"].tolist(), runs["c1"].tolist(), strict=True))
    starts = runs.index[~runs["row"].duplicated()].tolist() + [len(runs)]
    rows = runs["row"].tolist()
    for k in range(len(starts) - 2):
        lo, mid, hi = starts[k : k + 3]
        if rows[mid] == rows[lo] + 1:
            for i, j in _touching(cells[lo:mid], cells[mid:hi]):
                x, y = find(lo + i), find(mid + j)
                root[max(x, y)] = min(x, y)
    ids = runs["id"].to_numpy()
    return pd.DataFrame({"image_id": runs["image_id"], "id": ids, "label": ids[[find(i) for i in range(len(runs))]]})


def regions(mask: DataFrame, width: Size, band: int = 256) -> DataFrame:
    """image_id, first_m, r0, c0, r1, c1, mcus: 8-connected parts of the selection.

    Runs are joined inside bands of `band` MCU rows, each in one task. Only
    where parts of two bands touch, which takes a picture of more than one
    band, labels spread over the touching parts: every round takes the smallest
    label of the neighbours and then the label of that label, so the rounds
    grow with the logarithm of the number of bands. `width` is a number, or a
    column of `mask`.
    """
    nodes = selection_runs(mask, width).withColumn("id", F.expr(f"cast(row * ({width}) + c0 as bigint)"))
    nodes = materialize(nodes.select("image_id", "row", "c0", "c1", "id", F.expr(f"row div {band}").alias("band")))
    local = materialize(
        nodes.groupBy("image_id", "band").applyInPandas(_label_band, f"image_id {nodes.schema['image_id'].dataType.simpleString()}, id bigint, label bigint")
    )
    named = nodes.join(local, ["image_id", "id"])
    upper = named.where(f"row % {band} = {band - 1}").select(
        "image_id", (F.col("row") + 1).alias("row"), F.col("c0").alias("_a0"), F.col("c1").alias("_a1"), F.col("label").alias("other")
    )
    down = (
        named.where(f"row % {band} = 0")
        .join(upper, ["image_id", "row"])
        .where("_a0 <= c1 + 1 AND c0 <= _a1 + 1")
        .select("image_id", F.col("label").alias("id"), "other")
        .distinct()
    )
    links = materialize(down.unionByName(down.select("image_id", F.col("other").alias("id"), F.col("id").alias("other"))))
    parts_of = links.select("image_id", "id").distinct().withColumn("label", F.col("id"))
    while not links.isEmpty():
        near = (
            links.join(parts_of.select("image_id", F.col("id").alias("other"), "label"), ["image_id", "other"])
            .groupBy("image_id", "id")
            .agg(F.min("label").alias("_near"))
        )
        low = parts_of.join(near, ["image_id", "id"]).select(
            "image_id", "id", F.col("label").alias("_old"), F.least("label", "_near").alias("label")
        )
        jump = low.select("image_id", F.col("id").alias("label"), F.col("label").alias("_to"))
        step = materialize(
            low.join(jump, ["image_id", "label"]).select("image_id", "id", F.least("label", "_to").alias("label"), "_old")
        )
        parts_of = step.select("image_id", "id", "label")
        if step.where("label <> _old").isEmpty():
            break
    merged = parts_of.select("image_id", F.col("id").alias("label"), F.col("label").alias("_into"))
    labels = local.join(merged, ["image_id", "label"], "left").select(
        "image_id", "id", F.coalesce("_into", "label").alias("label")
    )
    parts = (
        nodes.join(labels, ["image_id", "id"])
        .groupBy("image_id", "label")
        .agg(
            F.min("row").alias("r0"),
            F.min("c0").alias("c0"),
            F.max("row").alias("r1"),
            F.max("c1").alias("c1"),
            F.sum(F.col("c1") - F.col("c0") + 1).alias("mcus"),
        )
    )
    return parts.select("image_id", F.col("label").alias("first_m"), "r0", "c0", "r1", "c1", "mcus")


def selection_bounds(mask: DataFrame) -> DataFrame:
    return mask.groupBy("image_id").agg(
        F.min("row").alias("top"),
        F.min("col").alias("left"),
        F.max("row").alias("bottom"),
        F.max("col").alias("right"),
        F.count(F.lit(1)).alias("mcus"),
    )


def fringe(max_h: int, max_v: int) -> int:
    """How far past the selected MCUs damage shows, in pixels."""
    return max(2, max_h, max_v)


def dilate(mask: DataFrame, by: int, width: Size, height: Size) -> DataFrame:
    """image_id, x, y: the mask grown by `by` pixels each way, first across, then down.

    Sizes are numbers, or columns of `mask`.
    """
    grown = lambda c, n: F.explode(F.expr(f"sequence(greatest({c} - {by}, 0), least({c} + {by}, cast({n} as bigint) - 1))"))
    carry = size_columns(mask, height)
    across = mask.select("image_id", "y", *carry, grown("x", width).alias("x")).distinct()
    return across.select("image_id", "x", grown("y", height).alias("y")).distinct()


def combine_masks(kept: DataFrame, run: DataFrame, subtract: bool = False) -> DataFrame:
    """image_id, m: the kept selection with a run added or taken away."""
    kept, run = kept.select("image_id", "m"), run.select("image_id", "m")
    if subtract:
        return kept.distinct().join(run, ["image_id", "m"], "left_anti")
    return kept.unionByName(run).distinct()


def mask_counts(mask: DataFrame) -> DataFrame:
    """image_id, selected, runs: a run starts where the MCU before is not selected."""
    before = mask.select("image_id", (F.col("m") + 1).alias("m"))
    starts = mask.join(before, ["image_id", "m"], "left_anti").groupBy("image_id").agg(F.count(F.lit(1)).alias("runs"))
    total = mask.groupBy("image_id").agg(F.count(F.lit(1)).alias("selected"))
    return total.join(starts, "image_id").select("image_id", "selected", "runs")
