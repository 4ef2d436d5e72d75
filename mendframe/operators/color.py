"""Measuring and correcting colour; patches taken from a reference picture."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendframe.functions.sizes import Size, size_columns

CDELTA_LIMIT = 2047
CLIPPED_SHARE = 0.01
LARGE_DELTA = 60
ASPECT_TOLERANCE = 0.01
TILE = 64
CHANNELS = ["c0", "c1", "c2"]


def measure(pixels: DataFrame, rects: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, samples, mean_c0..2, clipped_c0..2 over rectangles (image_id, rect_id, x, y, w, h).

    Rectangles are cut along fixed tiles, so pixels find theirs by an
    equi-join on the tile, spread over the picture, and then by a range test.
    Grouping by image alone weighs each rectangle by its area.
    """
    by = by or ["image_id", "rect_id"]
    span = lambda lo, n: f"sequence({lo} div {TILE}, ({lo} + {n} - 1) div {TILE})"
    tiled = (
        rects.where("w > 0 AND h > 0")
        .withColumn("_tx", F.explode(F.expr(span("x", "w"))))
        .withColumn("_ty", F.explode(F.expr(span("y", "h"))))
        .select(
            "image_id", "rect_id", "_tx", "_ty",
            F.col("x").alias("_x0"), F.col("y").alias("_y0"), (F.col("x") + F.col("w")).alias("_x1"), (F.col("y") + F.col("h")).alias("_y1"),
        )
    )
    px = pixels.withColumn("_tx", F.expr(f"x div {TILE}")).withColumn("_ty", F.expr(f"y div {TILE}"))
    hit = px.join(tiled, ["image_id", "_tx", "_ty"]).where("x >= _x0 AND x < _x1 AND y >= _y0 AND y < _y1")
    return hit.groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"),
        *[F.avg(c).alias(f"mean_{c}") for c in CHANNELS],
        *[F.avg(F.when(F.col(c).isin(0, 255), 1.0).otherwise(0.0)).alias(f"clipped_{c}") for c in CHANNELS],
    )


def match_color(pairs: DataFrame) -> DataFrame:
    """Adds cdelta and pixel_shift to rows with mean_ref, mean_target and q (DC step).

    The delta is what brings the target's mean to the reference's, in
    quantized units; the shift is what that delta moves in sample levels.
    """
    step = "greatest(q, 1)"
    return pairs.withColumn(
        "cdelta",
        F.expr(
            f"cast(least({CDELTA_LIMIT}, greatest({-CDELTA_LIMIT}, round((mean_ref - mean_target) * 8 / {step}))) as bigint)"
        ),
    ).withColumn("pixel_shift", F.expr(f"cdelta * {step} / 8D"))


def _clamped(expr: str) -> str:
    return f"cast(round(least(255D, greatest(0D, {expr}))) as bigint)"


def rgb_to_ycbcr(pixels: DataFrame, r="c0", g="c1", b="c2") -> DataFrame:
    """JFIF full range, rounded and clamped; columns y_, cb, cr replace nothing."""
    return pixels.select(
        "*",
        F.expr(_clamped(f"0.299D * {r} + 0.587D * {g} + 0.114D * {b}")).alias("luma"),
        F.expr(_clamped(f"128D - 0.168736D * {r} - 0.331264D * {g} + 0.5D * {b}")).alias("cb"),
        F.expr(_clamped(f"128D + 0.5D * {r} - 0.418688D * {g} - 0.081312D * {b}")).alias("cr"),
    )


def ycbcr_to_rgb(pixels: DataFrame, y="c0", cb="c1", cr="c2") -> DataFrame:
    return pixels.select(
        "*",
        F.expr(_clamped(f"{y} + 1.402D * ({cr} - 128)")).alias("red"),
        F.expr(_clamped(f"{y} - 0.344136D * ({cb} - 128) - 0.714136D * ({cr} - 128)")).alias("green"),
        F.expr(_clamped(f"{y} + 1.772D * ({cb} - 128)")).alias("blue"),
    )


def is_monochrome(pixels: DataFrame, cb="c1", cr="c2", tolerance: int = 1) -> DataFrame:
    return pixels.groupBy("image_id").agg(
        F.expr(f"bool_and(abs({cb} - 128) <= {tolerance} AND abs({cr} - 128) <= {tolerance})").alias("monochrome")
    )


def corresponding_rect(rects: DataFrame, min_edge: int = 2) -> DataFrame:
    """Adds rx, ry, rw, rh: the rectangle (x, y, w, h) of a picture (sw, sh) in a reference of size (pw, ph)."""
    sx, sy = "(pw / sw)", "(ph / sh)"
    df = rects.select(
        "*",
        F.expr(f"least(greatest({min_edge}, cast(round(w * {sx}) as bigint)), pw)").alias("rw"),
        F.expr(f"least(greatest({min_edge}, cast(round(h * {sy}) as bigint)), ph)").alias("rh"),
        F.expr(f"cast(round((x + w / 2D) * {sx}) as bigint)").alias("_cx"),
        F.expr(f"cast(round((y + h / 2D) * {sy}) as bigint)").alias("_cy"),
    )
    return (
        df.withColumn("rx", F.expr("least(greatest(_cx - rw div 2, 0), pw - rw)"))
        .withColumn("ry", F.expr("least(greatest(_cy - rh div 2, 0), ph - rh)"))
        .drop("_cx", "_cy")
    )


def histogram(pixels: DataFrame) -> DataFrame:
    """image_id, channel, value, n. Counts combine before the shuffle: 768 rows per image and task."""
    return (
        pixels.select("image_id", F.expr("stack(3, 0, c0, 1, c1, 2, c2) AS (channel, value)"))
        .groupBy("image_id", "channel", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def level_bounds(pixels: DataFrame, clip: float = 0.05) -> DataFrame:
    """image_id, channel, lo, hi: interpolated percentiles `clip` and 100 - `clip`, from the histogram."""
    lo, hi = clip / 100, (100 - clip) / 100
    return histogram(pixels).groupBy("image_id", "channel").agg(
        F.expr(f"percentile(value, {lo!r}D, n)").alias("lo"), F.expr(f"percentile(value, {hi!r}D, n)").alias("hi")
    )


def auto_levels(pixels: DataFrame, clip: float = 0.05) -> DataFrame:
    """Stretches each channel of each image to 0..255; a flat channel stays as it is.

    The bounds are three rows per image; they come back as one row.
    """
    bounds = level_bounds(pixels, clip).groupBy("image_id").agg(
        *[F.max(F.when(F.col("channel") == i, F.col(b))).alias(f"_{b}{i}") for i in range(3) for b in ("lo", "hi")]
    )
    stretched = lambda i: (
        f"CASE WHEN _hi{i} <= _lo{i} THEN c{i} ELSE {_clamped(f'(c{i} - _lo{i}) * (255D / (_hi{i} - _lo{i}))')} END"
    )
    kept = [c for c in pixels.columns if c not in CHANNELS]
    return pixels.join(bounds, "image_id").select(
        *kept, *[F.expr(stretched(i)).alias(f"c{i}") for i in range(3)]
    )


def midtone_contrast(pixels: DataFrame, strength: float = 0.4) -> DataFrame:
    """Pushes midtones away from 127; the ends of the range stay."""
    pushed = lambda c: (
        f"{c} + (CASE WHEN {c} < 127 THEN {c} ELSE 255 - {c} END) / 127D * (({c} - 127) / 2D) * {strength!r}D"
    )
    kept = [c for c in pixels.columns if c not in CHANNELS]
    return pixels.select(*kept, *[F.expr(_clamped(pushed(c))).alias(c) for c in CHANNELS])


def auto_correct(pixels: DataFrame) -> DataFrame:
    return midtone_contrast(auto_levels(pixels))


def match_warnings(stats: DataFrame) -> DataFrame:
    """Adds `warnings`, codes of what makes a colour match unsafe.

    `stats`: ref_mean, ref_clipped, target_mean, target_clipped (arrays of
    three) and monochrome.
    """
    clipped = lambda side: (
        f"array_join(filter(transform({side}_clipped, (v, i) -> CASE WHEN v > {CLIPPED_SHARE} "
        f"THEN element_at(array('Y', 'Cb', 'Cr'), i + 1) END), c -> c IS NOT NULL), '+')"
    )
    coded = lambda side: f"CASE WHEN {clipped(side)} <> '' THEN concat('{side}_clipped:', {clipped(side)}) END"
    large = f"exists(zip_with(ref_mean, target_mean, (a, b) -> abs(a - b)), d -> d > {LARGE_DELTA})"
    return stats.withColumn(
        "warnings",
        F.expr(
            f"filter(array({coded('ref')}, {coded('target')}, CASE WHEN monochrome THEN 'grayscale_reference' END, "
            f"CASE WHEN {large} THEN 'large_difference' END), w -> w IS NOT NULL)"
        ),
    )


def aspect_changed(sizes: DataFrame) -> DataFrame:
    """Adds `aspect_changed`: width/height against ref_width/ref_height, beyond 1 %."""
    return sizes.withColumn(
        "aspect_changed",
        F.expr(
            f"(ref_width <> width OR ref_height <> height) AND abs(ref_width / ref_height - width / height) / (width / height) > {ASPECT_TOLERANCE}D"
        ),
    )


def patch_pixels(reference: DataFrame, rects: DataFrame, mcu_w: Size, mcu_h: Size, width: Size, height: Size) -> DataFrame:
    """image_id, rect_id, x, y, c0, c1, c2: reference pixels for MCU rectangles read at an MCU offset.

    `rects`: image_id, rect_id, row, col, rows, cols, d_row, d_col (in MCUs).
    Sizes are numbers, or columns of `rects`.
    Reads past the reference repeat its edge. Coordinates of the patch start
    at 0; each output pixel looks up one reference pixel by an equi-join. The
    few rects become many pixels, which Spark does not foresee; it would
    broadcast them, so both sides are held to a sort-merge join.
    """
    grid = (
        rects.withColumn("x", F.explode(F.expr(f"sequence(0L, cast(cols * {mcu_w} as bigint) - 1L)")))
        .withColumn("y", F.explode(F.expr(f"sequence(0L, cast(rows * {mcu_h} as bigint) - 1L)")))
        .select(
            "image_id", "rect_id", "x", "y",
            F.expr(f"least(greatest((col + d_col) * {mcu_w} + x, 0), cast({width} as bigint) - 1)").alias("_sx"),
            F.expr(f"least(greatest((row + d_row) * {mcu_h} + y, 0), cast({height} as bigint) - 1)").alias("_sy"),
        )
    )
    source = reference.select("image_id", F.col("x").alias("_sx"), F.col("y").alias("_sy"), *CHANNELS)
    return grid.join(source.hint("merge"), ["image_id", "_sx", "_sy"]).select("image_id", "rect_id", "x", "y", *CHANNELS)


def pad_edges(pixels: DataFrame, width: Size, height: Size, padded_width: Size, padded_height: Size) -> DataFrame:
    """The picture grown to whole MCUs by repeating its last column and row.

    Each edge pixel emits its own copies: no join and no shuffle. Sizes are
    numbers, or columns of `pixels`.
    """
    grow = lambda c, n, m: F.explode(F.expr(f"CASE WHEN {c} = {n} - 1 THEN sequence({c}, cast({m} as bigint) - 1L) ELSE array({c}) END"))
    carry = size_columns(pixels, height, padded_height)
    return (
        pixels.select("image_id", grow("x", width, padded_width).alias("x"), "y", *carry, *CHANNELS)
        .select("image_id", "x", grow("y", height, padded_height).alias("y"), *CHANNELS)
    )
