"""Colour, reference-patch and seam operators over pixels derived from `embeddings`."""

from __future__ import annotations

from pyspark.sql import functions as F

from mendframe.operators import color as c
from mendframe.operators import fill as fl
from mendframe.plans.registry import query
from mendframe.sources import fixtures as fx

PX = f"px AS MATERIALIZED ({fx.pixels_sql()})"
_CL = "CAST(round(least(255, greatest(0, {}))) AS BIGINT)"

RECTS_SQL = """rc AS (SELECT image_id, k AS rect_id, k * 9 + image_id % 5 AS x, k * 13 AS y, 20 + k AS w, 12 + image_id % 3 AS h
    FROM (SELECT DISTINCT image_id FROM px), (SELECT unnest([0, 1, 2]) AS k))"""


def _images(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.expr("vec_id div 64").alias("image_id")).distinct()


def _rects(spark, sf_dir):
    return _images(spark, sf_dir).withColumn("rect_id", F.explode(F.expr("array(0L, 1L, 2L)"))).select(
        "image_id",
        "rect_id",
        F.expr("rect_id * 9 + image_id % 5").alias("x"),
        F.expr("rect_id * 13").alias("y"),
        F.expr("20 + rect_id").alias("w"),
        F.expr("12 + image_id % 3").alias("h"),
    )


_MEASURE = """count(*) AS samples, avg(c0) AS mean_c0, avg(c1) AS mean_c1, avg(c2) AS mean_c2,
    avg(CASE WHEN c0 IN (0, 255) THEN 1.0 ELSE 0 END) AS clipped_c0, avg(CASE WHEN c1 IN (0, 255) THEN 1.0 ELSE 0 END) AS clipped_c1,
    avg(CASE WHEN c2 IN (0, 255) THEN 1.0 ELSE 0 END) AS clipped_c2
    FROM rc JOIN px ON px.image_id = rc.image_id AND px.x >= rc.x AND px.x < rc.x + w AND px.y >= rc.y AND px.y < rc.y + h"""
_STATS = "samples:i, mean_c0:d, mean_c1:d, mean_c2:d, clipped_c0:d, clipped_c1:d, clipped_c2:d"


@query(
    "g13_measure",
    "image_id:i, rect_id:i, " + _STATS,
    f"WITH {PX}, {RECTS_SQL} --- SELECT rc.image_id, rect_id, {_MEASURE} GROUP BY ALL",
)
def g13_measure(spark, sf_dir):
    return c.measure(fx.pixels(spark, sf_dir), _rects(spark, sf_dir))


@query(
    "g13_measure_selection",
    "image_id:i, " + _STATS,
    f"WITH {PX}, {RECTS_SQL} --- SELECT rc.image_id, {_MEASURE} GROUP BY ALL",
)
def g13_measure_selection(spark, sf_dir):
    return c.measure(fx.pixels(spark, sf_dir), _rects(spark, sf_dir), by=["image_id"])


@query(
    "g14_match_color",
    "image_id:i, comp:i, cdelta:i, pixel_shift:d",
    f"""WITH {PX}, {RECTS_SQL}, ms AS (SELECT rc.image_id, rect_id, {_MEASURE} GROUP BY ALL),
    pr AS (SELECT a.image_id, k AS comp, CASE k WHEN 0 THEN a.mean_c0 WHEN 1 THEN a.mean_c1 ELSE a.mean_c2 END AS mr,
             CASE k WHEN 0 THEN b.mean_c0 WHEN 1 THEN b.mean_c1 ELSE b.mean_c2 END AS mt, 1 + k + a.image_id % 4 AS q
           FROM ms a JOIN ms b ON a.image_id = b.image_id AND a.rect_id = 0 AND b.rect_id = 1, (SELECT unnest([0, 1, 2]) AS k)),
    cd AS (SELECT *, least(2047, greatest(-2047, round((mr - mt) * 8 / q))) AS cdelta FROM pr)
    --- SELECT image_id, comp, cdelta, cdelta * q / 8.0 AS pixel_shift FROM cd""",
)
def g14_match_color(spark, sf_dir):
    stats = c.measure(fx.pixels(spark, sf_dir), _rects(spark, sf_dir).where("rect_id < 2"))
    pairs = (
        stats.groupBy("image_id")
        .pivot("rect_id", [0, 1])
        .agg(*[F.first(f"mean_c{i}").alias(f"m{i}") for i in range(3)])
        .selectExpr("image_id", "stack(3, 0, `0_m0`, `1_m0`, 1, `0_m1`, `1_m1`, 2, `0_m2`, `1_m2`) AS (comp, mean_ref, mean_target)")
        .where("mean_ref IS NOT NULL AND mean_target IS NOT NULL")
        .withColumn("q", F.expr("1 + comp + image_id % 4"))
    )
    return c.match_color(pairs)


@query(
    "g15_rgb_to_ycbcr",
    "image_id:i, x:i, y:i, luma:i, cb:i, cr:i",
    f"""WITH {PX} --- SELECT *, {_CL.format('0.299::DOUBLE * c0 + 0.587::DOUBLE * c1 + 0.114::DOUBLE * c2')} AS luma,
      {_CL.format('128 - 0.168736::DOUBLE * c0 - 0.331264::DOUBLE * c1 + 0.5::DOUBLE * c2')} AS cb,
      {_CL.format('128 + 0.5::DOUBLE * c0 - 0.418688::DOUBLE * c1 - 0.081312::DOUBLE * c2')} AS cr FROM px""",
)
def g15_rgb_to_ycbcr(spark, sf_dir):
    return c.rgb_to_ycbcr(fx.pixels(spark, sf_dir))


@query(
    "g15_ycbcr_to_rgb",
    "image_id:i, x:i, y:i, red:i, green:i, blue:i",
    f"""WITH {PX} --- SELECT *, {_CL.format('c0 + 1.402::DOUBLE * (c2 - 128)')} AS red,
      {_CL.format('c0 - 0.344136::DOUBLE * (c1 - 128) - 0.714136::DOUBLE * (c2 - 128)')} AS green,
      {_CL.format('c0 + 1.772::DOUBLE * (c1 - 128)')} AS blue FROM px""",
)
def g15_ycbcr_to_rgb(spark, sf_dir):
    return c.ycbcr_to_rgb(fx.pixels(spark, sf_dir))


_FLAT = "CASE WHEN image_id % 2 = 0 THEN 128 + {0} % 2 ELSE {0} END"


@query(
    "g16_is_monochrome",
    "image_id:i, monochrome:b",
    f"""WITH {PX} --- SELECT image_id, bool_and(abs({_FLAT.format('c1')} - 128) <= 1 AND abs({_FLAT.format('c2')} - 128) <= 1) AS monochrome
      FROM px GROUP BY image_id""",
)
def g16_is_monochrome(spark, sf_dir):
    px = fx.pixels(spark, sf_dir)
    gray = px.withColumn("c1", F.expr(_FLAT.format("c1"))).withColumn("c2", F.expr(_FLAT.format("c2")))
    return c.is_monochrome(gray)


_SIZES = "60 + image_id % 9 AS sw, 48 AS sh, 100 + image_id % 13 * 7 AS pw, 64 + image_id % 5 * 9 AS ph"


@query(
    "g17_corresponding_rect",
    "image_id:i, rect_id:i, rx:i, ry:i, rw:i, rh:i",
    f"""WITH {PX}, {RECTS_SQL}, s AS (SELECT *, {_SIZES} FROM rc),
    a AS (SELECT *, least(greatest(2, round(w * (pw / sw))), pw) AS rw, least(greatest(2, round(h * (ph / sh))), ph) AS rh,
            round((x + w / 2.0) * (pw / sw)) AS cx, round((y + h / 2.0) * (ph / sh)) AS cy FROM s)
    --- SELECT image_id, rect_id, rw, rh, least(greatest(cx - CAST(rw AS BIGINT) // 2, 0), pw - rw) AS rx, least(greatest(cy - CAST(rh AS BIGINT) // 2, 0), ph - rh) AS ry FROM a""",
)
def g17_corresponding_rect(spark, sf_dir):
    return c.corresponding_rect(_rects(spark, sf_dir).selectExpr("*", *_SIZES.split(", ")))


HIST = """hs AS (SELECT image_id, 0 AS channel, c0 AS value, count(*) AS n FROM px GROUP BY ALL UNION ALL
    SELECT image_id, 1, c1, count(*) FROM px GROUP BY ALL UNION ALL SELECT image_id, 2, c2, count(*) FROM px GROUP BY ALL)"""


@query("g18_histogram", "image_id:i, channel:i, value:i, n:i", f"WITH {PX}, {HIST} --- SELECT * FROM hs")
def g18_histogram(spark, sf_dir):
    return c.histogram(fx.pixels(spark, sf_dir))


def _levels(i: int) -> str:
    lv = f"(c{i} - lo{i}) * (255::DOUBLE / (hi{i} - lo{i}))"
    return f"CASE WHEN hi{i} <= lo{i} THEN c{i} ELSE {_CL.format(lv)} END"


LEVELS = (
    "bd AS (SELECT image_id, "
    + ", ".join(f"quantile_cont(c{i}, 0.0005) AS lo{i}, quantile_cont(c{i}, 0.9995) AS hi{i}" for i in range(3))
    + " FROM px GROUP BY image_id), lv AS (SELECT image_id, x, y, "
    + ", ".join(f"{_levels(i)} AS c{i}" for i in range(3))
    + " FROM px JOIN bd USING (image_id))"
)


def _mid(i: int) -> str:
    return _CL.format(f"c{i} + (CASE WHEN c{i} < 127 THEN c{i} ELSE 255 - c{i} END) / 127::DOUBLE * ((c{i} - 127) / 2::DOUBLE) * 0.4::DOUBLE")


_MIDS = ", ".join(f"{_mid(i)} AS c{i}" for i in range(3))
_PIX = "image_id:i, x:i, y:i, c0:i, c1:i, c2:i"


@query("g19_auto_levels", _PIX, f"WITH {PX}, {LEVELS} --- SELECT * FROM lv")
def g19_auto_levels(spark, sf_dir):
    return c.auto_levels(fx.pixels(spark, sf_dir))


@query("g20_midtone_contrast", _PIX, f"WITH {PX} --- SELECT image_id, x, y, {_MIDS} FROM px")
def g20_midtone_contrast(spark, sf_dir):
    return c.midtone_contrast(fx.pixels(spark, sf_dir))


@query("g21_auto_correct", _PIX, f"WITH {PX}, {LEVELS} --- SELECT image_id, x, y, {_MIDS} FROM lv")
def g21_auto_correct(spark, sf_dir):
    return c.auto_correct(fx.pixels(spark, sf_dir))


@query(
    "g22_patch_pixels",
    "image_id:i, rect_id:i, x:i, y:i, c0:i, c1:i, c2:i",
    f"""WITH {PX}, pr AS (SELECT image_id, k AS rect_id, 1 + k AS r, k AS cc, 2 AS rows, 3 AS cols, k - 2 AS dr, image_id % 3 AS dc
          FROM (SELECT DISTINCT image_id FROM px), (SELECT unnest([0, 1, 2]) AS k)),
    gd AS (SELECT *, x, y, least(greatest((cc + dc) * 16 + x, 0), 63) AS sx, least(greatest((r + dr) * 16 + y, 0), 63) AS sy
           FROM pr, (SELECT unnest(range(48)) AS x), (SELECT unnest(range(32)) AS y))
    --- SELECT gd.image_id, rect_id, gd.x, gd.y, c0, c1, c2 FROM gd JOIN px ON px.image_id = gd.image_id AND px.x = sx AND px.y = sy""",
)
def g22_patch_pixels(spark, sf_dir):
    rects = _images(spark, sf_dir).withColumn("rect_id", F.explode(F.expr("array(0L, 1L, 2L)"))).selectExpr(
        "image_id", "rect_id", "1 + rect_id AS row", "rect_id AS col", "2L AS rows", "3L AS cols", "rect_id - 2 AS d_row", "image_id % 3 AS d_col"
    )
    return c.patch_pixels(fx.pixels(spark, sf_dir), rects, 16, 16, 64, 64)


@query(
    "g23_pad_edges",
    _PIX,
    f"""WITH {PX}, gd AS (SELECT image_id, x, y FROM (SELECT DISTINCT image_id FROM px), (SELECT unnest(range(80)) AS x), (SELECT unnest(range(72)) AS y))
    --- SELECT gd.image_id, gd.x, gd.y, c0, c1, c2 FROM gd JOIN px ON px.image_id = gd.image_id AND px.x = least(gd.x, 63) AND px.y = least(gd.y, 63)""",
)
def g23_pad_edges(spark, sf_dir):
    return c.pad_edges(fx.pixels(spark, sf_dir), 64, 64, 80, 72)


@query(
    "g24_aspect_changed",
    "p_partkey:i, aspect_changed:b",
    """SELECT p_partkey, (rw <> w OR rh <> h) AND abs(rw / rh - w / h) / (w / h) > 0.01 AS aspect_changed
      FROM (SELECT p_partkey, 600 + p_partkey % 7 AS w, 400 AS h, 1200 + p_partkey % 31 AS rw, 800 AS rh FROM part)""",
)
def g24_aspect_changed(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(
        "p_partkey", "600 + p_partkey % 7 AS width", "400 AS height", "1200 + p_partkey % 31 AS ref_width", "800 AS ref_height"
    )
    return c.aspect_changed(part)


# A redrawn picture: moved by (2, -1) and tinted; the hole is a 16 x 16 square.
_REDRAWN = "least(255, greatest(0, cast(round(0.9{d} * {c}) as bigint) + 12))"
_HOLE = "x BETWEEN 20 AND 35 AND y BETWEEN 24 + image_id % 3 AND 39"


def _redraw(spark, sf_dir):
    px = fx.pixels(spark, sf_dir)
    moved = px.selectExpr(
        "image_id", "x + 2 AS x", "y - 1 AS y", *[f"{_REDRAWN.format(d='D', c=f'c{i}')} AS c{i}" for i in range(3)]
    ).where("x BETWEEN 0 AND 63 AND y BETWEEN 0 AND 63")
    return px, moved, px.where(_HOLE).select("image_id", "x", "y")


_REDRAW_SQL = (
    f"{PX}, an AS MATERIALIZED (SELECT image_id, x + 2 AS x, y - 1 AS y, "
    + ", ".join(f"{_REDRAWN.format(d='::DOUBLE', c=f'c{i}')} AS c{i}" for i in range(3))
    + f" FROM px WHERE x + 2 BETWEEN 0 AND 63 AND y - 1 BETWEEN 0 AND 63), ho AS (SELECT image_id, x, y FROM px WHERE {_HOLE})"
)
_L = "(c0 * 77 + c1 * 150 + c2 * 29) // 256"


def _costs(name: str, here: str, there: str, shifts: str) -> str:
    return f"""{name} AS (SELECT h.image_id, s.dx, s.dy, CASE WHEN count(*) < 16 THEN 1.7976931348623157E308 ELSE
        sum((h.v - a.v) * (h.v - a.v)) / count(*) - (sum(h.v - a.v) / count(*)) * (sum(h.v - a.v) / count(*)) END AS cost
      FROM {here} h JOIN {shifts} s ON s.image_id = h.image_id JOIN {there} a ON a.image_id = h.image_id AND a.x = h.x + s.dx AND a.y = h.y + s.dy
      GROUP BY h.image_id, s.dx, s.dy)"""


def _scan(costs: str, sx: str, sy: str, factor: float, join: str = "") -> str:
    return f"""(SELECT image_id, list_reduce(list_prepend(struct_pack(dy := any_value({sy}), dx := any_value({sx}), cost := coalesce(max(cost) FILTER (dx = {sx} AND dy = {sy}), 1.7976931348623157E308)),
        list(struct_pack(dy := dy, dx := dx, cost := cost) ORDER BY dy, dx)), lambda s, t: CASE WHEN t.cost < s.cost * {factor} THEN t ELSE s END) AS b FROM {costs} {join} GROUP BY image_id)"""


FIT_SQL = f"""{_REDRAW_SQL},
    hb AS (SELECT image_id, min(x) - 64 AS x0, max(x) + 64 AS x1, min(y) - 64 AS y0, max(y) + 64 AS y1 FROM ho GROUP BY image_id),
    jd0 AS (SELECT px.* FROM px JOIN hb USING (image_id) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1
           AND NOT EXISTS (SELECT 1 FROM ho WHERE ho.image_id = px.image_id AND ho.x = px.x AND ho.y = px.y)),
    jd AS MATERIALIZED (SELECT * FROM jd0 WHERE image_id IN (SELECT image_id FROM jd0 GROUP BY image_id HAVING count(*) >= 64)),
    hh AS MATERIALIZED (SELECT image_id, x // 2 AS x, y // 2 AS y, sum({_L}) // 4 AS v FROM jd GROUP BY image_id, x // 2, y // 2 HAVING count(*) = 4),
    ha AS MATERIALIZED (SELECT image_id, x // 2 AS x, y // 2 AS y, sum({_L}) // 4 AS v FROM an GROUP BY image_id, x // 2, y // 2 HAVING count(*) = 4),
    s1 AS (SELECT image_id, dx, dy FROM (SELECT image_id FROM hh GROUP BY image_id HAVING count(*) >= 64),
           (SELECT unnest(range(-6, 7)) AS dx), (SELECT unnest(range(-6, 7)) AS dy)),
    {_costs('c1', 'hh', 'ha', 's1')},
    ctr AS MATERIALIZED (SELECT i.image_id, coalesce(2 * b.dx, 0) AS sx, coalesce(2 * b.dy, 0) AS sy
           FROM (SELECT DISTINCT image_id FROM jd) i LEFT JOIN {_scan('c1', '0', '0', 0.98)} USING (image_id)),
    s2 AS (SELECT image_id, sx + a AS dx, sy + b AS dy FROM ctr, (SELECT unnest(range(-1, 2)) AS a), (SELECT unnest(range(-1, 2)) AS b)),
    fl AS (SELECT image_id, x, y, {_L} AS v FROM jd), fa AS (SELECT image_id, x, y, {_L} AS v FROM an),
    {_costs('c2', 'fl', 'fa', 's2')},
    dr AS MATERIALIZED (SELECT image_id, b.dx AS dx, b.dy AS dy FROM {_scan('c2', 'sx', 'sy', 1.0, 'JOIN ctr USING (image_id)')}),
    se AS MATERIALIZED (SELECT j.*, a.c0 AS a0, a.c1 AS a1, a.c2 AS a2 FROM jd j JOIN dr USING (image_id)
           JOIN an a ON a.image_id = j.image_id AND a.x = least(greatest(j.x + dx, 0), 63) AND a.y = least(greatest(j.y + dy, 0), 63)),
    gn0 AS (SELECT image_id, {', '.join(f'avg(a{i}) AS ma{i}, avg(c{i}) AS mo{i}, sum(a{i} * a{i}) / count(*) - (sum(a{i}) / count(*)) * (sum(a{i}) / count(*)) AS va{i}, sum(a{i} * c{i}) / count(*) - (sum(a{i}) / count(*)) * (sum(c{i}) / count(*)) AS co{i}' for i in range(3))}
           FROM se GROUP BY image_id),
    gn1 AS (SELECT *, {', '.join(f'least(2, greatest(0.5, CASE WHEN va{i} > 4 THEN co{i} / va{i} ELSE 1 END)) AS gain{i}' for i in range(3))} FROM gn0),
    gn AS MATERIALIZED (SELECT *, {', '.join(f'mo{i} - gain{i} * ma{i} AS offset{i}' for i in range(3))} FROM gn1),
    rs AS (SELECT image_id, avg({' + '.join(f'abs(c{i} - least(255, greatest(0, round(gain{i} * a{i} + offset{i}))))' for i in range(3))}) / 3 AS residual
           FROM se JOIN gn USING (image_id) GROUP BY image_id)"""


@query(
    "g25_register_grids",
    "image_id:i, dx:i, dy:i, gain0:d, gain1:d, gain2:d, offset0:d, offset1:d, offset2:d, residual:d",
    f"WITH {FIT_SQL} --- SELECT * FROM dr JOIN gn USING (image_id) JOIN rs USING (image_id)",
)
def g25_register_grids(spark, sf_dir):
    original, answer, mask = _redraw(spark, sf_dir)
    fit, _ = fl.register_grids(original, answer, mask, 64, 64)
    return fit


def _pyramid() -> str:
    sizes = [64, 32, 16, 8, 4, 2, 1]
    ctes = [
        "v0 AS MATERIALIZED (SELECT p.image_id, p.x, p.y, "
        + ", ".join(f"CASE WHEN h.x IS NULL THEN CAST(p.c{i} - a.c{i} AS DOUBLE) ELSE 0 END AS v{i}" for i in range(3))
        + ", CASE WHEN h.x IS NULL THEN 1.0::DOUBLE ELSE 0 END AS wt FROM px p JOIN an a USING (image_id, x, y) "
        "LEFT JOIN ho h ON h.image_id = p.image_id AND h.x = p.x AND h.y = p.y)"
    ]
    for k in range(1, 7):
        ctes.append(
            f"v{k} AS MATERIALIZED (SELECT image_id, x // 2 AS x, y // 2 AS y, "
            + ", ".join(f"CASE WHEN sum(wt) > 0 THEN sum(v{i} * wt) / sum(wt) ELSE 0 END AS v{i}" for i in range(3))
            + f", least(1, sum(wt)) AS wt FROM v{k - 1} GROUP BY image_id, x // 2, y // 2)"
        )
    ctes.append("f6 AS (SELECT * FROM v6)")
    for k in range(5, -1, -1):
        n = sizes[k + 1]
        pos = lambda a: f"least(greatest(({a} + 0.5::DOUBLE) / 2 - 0.5::DOUBLE, 0), {n - 1})"
        ctes.append(f"q{k} AS (SELECT *, {pos('x')} AS fx, {pos('y')} AS fy FROM v{k} WHERE wt < 1)")
        ctes.append(
            f"b{k} AS (SELECT q.image_id, q.x, q.y, "
            + ", ".join(f"sum(p * u.v{i}) AS b{i}" for i in range(3))
            + f""" FROM (SELECT *, least(CAST(floor(fx) AS BIGINT) + i, {n - 1}) AS cx, least(CAST(floor(fy) AS BIGINT) + j, {n - 1}) AS cy,
                 (CASE WHEN i = 0 THEN 1 - (fx - floor(fx)) ELSE fx - floor(fx) END) * (CASE WHEN j = 0 THEN 1 - (fy - floor(fy)) ELSE fy - floor(fy) END) AS p
               FROM q{k}, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)) q
               JOIN f{k + 1} u ON u.image_id = q.image_id AND u.x = q.cx AND u.y = q.cy GROUP BY q.image_id, q.x, q.y)"""
        )
        ctes.append(
            f"f{k} AS MATERIALIZED (SELECT image_id, x, y, v0, v1, v2 FROM v{k} WHERE wt >= 1 UNION ALL SELECT v.image_id, v.x, v.y, "
            + ", ".join(f"v.v{i} * wt + b{i} * (1 - wt)" for i in range(3))
            + f" FROM v{k} v JOIN b{k} b ON b.image_id = v.image_id AND b.x = v.x AND b.y = v.y WHERE wt < 1)"
        )
    return ", ".join(ctes)


@query(
    "g26_fill_differences",
    _PIX,
    f"WITH {_REDRAW_SQL}, {_pyramid()}, kn AS (SELECT image_id, max(wt) > 0 AS known FROM v0 GROUP BY image_id) --- SELECT a.image_id, a.x, a.y, "
    + ", ".join(
        f"CASE WHEN h.x IS NOT NULL AND known THEN least(255, greatest(0, round(a.c{i} + v{i}))) ELSE a.c{i} END AS c{i}" for i in range(3)
    )
    + " FROM an a JOIN f0 USING (image_id, x, y) JOIN kn USING (image_id) LEFT JOIN ho h ON h.image_id = a.image_id AND h.x = a.x AND h.y = a.y",
)
def g26_fill_differences(spark, sf_dir):
    original, answer, mask = _redraw(spark, sf_dir)
    return fl.fill_differences(original, answer, mask, 64, 64)


_WARN = "CASE WHEN {s}_c0 > 0.01 THEN 'Y' END, CASE WHEN {s}_c1 > 0.01 THEN 'Cb' END, CASE WHEN {s}_c2 > 0.01 THEN 'Cr' END"


def _clip_sql(alias: str, label: str) -> str:
    lst = _WARN.format(s=f"{alias}.clipped")
    joined = f"array_to_string(list_filter([{lst}], lambda z: z IS NOT NULL), '+')"
    return f"CASE WHEN {joined} <> '' THEN '{label}_clipped:' || {joined} END"


@query(
    "g28_match_warnings",
    "image_id:i, warnings:s",
    f"""WITH px0 AS ({fx.pixels_sql()}), px AS MATERIALIZED (SELECT image_id, x, y, CASE WHEN c0 < 100 THEN 0 ELSE c0 END AS c0, c1,
          CASE WHEN image_id % 2 = 0 AND c2 > 150 THEN 255 ELSE c2 END AS c2 FROM px0), {RECTS_SQL}, ms AS (SELECT rc.image_id, rect_id, {_MEASURE} GROUP BY ALL)
    --- SELECT a.image_id, array_to_string(list_filter([{_clip_sql('a', 'ref')}, {_clip_sql('b', 'target')},
        CASE WHEN a.image_id % 3 = 0 THEN 'grayscale_reference' END,
        CASE WHEN greatest(abs(a.mean_c0 - b.mean_c0), abs(a.mean_c1 - b.mean_c1 - 50), abs(a.mean_c2 - b.mean_c2)) > 60 THEN 'large_difference' END],
        lambda z: z IS NOT NULL), ',') AS warnings
      FROM ms a JOIN ms b ON a.image_id = b.image_id AND a.rect_id = 0 AND b.rect_id = 1""",
)
def g28_match_warnings(spark, sf_dir):
    px = fx.pixels(spark, sf_dir).withColumn("c0", F.expr("CASE WHEN c0 < 100 THEN 0L ELSE c0 END")).withColumn(
        "c2", F.expr("CASE WHEN image_id % 2 = 0 AND c2 > 150 THEN 255L ELSE c2 END")
    )
    m = c.measure(px, _rects(spark, sf_dir).where("rect_id < 2"))
    packed = m.select(
        "image_id",
        "rect_id",
        F.array("mean_c0", "mean_c1", "mean_c2").alias("mean"),
        F.array("clipped_c0", "clipped_c1", "clipped_c2").alias("clipped"),
    )
    ref = packed.where("rect_id = 0").select("image_id", F.col("mean").alias("ref_mean"), F.col("clipped").alias("ref_clipped"))
    target = packed.where("rect_id = 1").select(
        "image_id",
        F.expr("array(mean[0], mean[1] + 50, mean[2])").alias("target_mean"),
        F.col("clipped").alias("target_clipped"),
    )
    stats = ref.join(target, "image_id").withColumn("monochrome", F.expr("image_id % 3 = 0"))
    return c.match_warnings(stats).withColumn("warnings", F.array_join("warnings", ","))
