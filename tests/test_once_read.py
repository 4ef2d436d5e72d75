"""What is read, joined or tried once instead of several times."""

from __future__ import annotations

import contextlib
import io

import pytest

from __spark_entry__ import queries
from conftest import SF
from mendframe.operators import grid as g
from mendframe.operators import replay as rp


def _plan(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_exif_and_frame_come_from_one_walk(spark):
    """Bytes are scanned for markers once, and nothing meets by file."""
    plan = _plan(queries()["b24_exif_size_mismatch"](spark, SF))
    assert plan.count("ArrowEvalPython") == 1 and "Join" not in plan


def test_shifts_are_compared_where_the_mcus_lie(spark):
    """No row is made for a position at a shift, and only MCUs that a start can reach meet it; starts of one picture add up."""
    plan = _plan(queries()["g5_auto_align"](spark, SF))
    assert "Generate" not in plan
    mcus = spark.range(3 * 400).selectExpr("id div 400 AS image_id", "id % 400 AS m", "id * 37 % 101 AS y", "id * 11 % 13 AS cb", "id % 5 AS cr").where("m % 29 <> 3")
    starts = spark.createDataFrame([(0, 20), (0, 60), (1, 390), (2, 7)], "image_id long, start long")
    got = {(r.image_id, r["shift"]): r for r in g.auto_align(mcus, starts, 16, 30).collect()}
    at = {(r.image_id, r.m): (r.y, r.cb, r.cr) for r in mcus.collect()}
    want = {}
    for image, start in [(0, 20), (0, 60), (1, 390)]:
        for k in range(-30, 31):
            for p in range(start, start + 16):
                if all((image, q) in at for q in (p, p - 16, p - k)):
                    want.setdefault((image, k), []).append([a - b for a, b in zip(at[image, p - k], at[image, p - 16], strict=True)])
    want = {key: d for key, d in want.items() if len(d) >= 8}
    assert set(got) == set(want)
    for key, d in want.items():
        mean = [sum(c) / len(d) for c in zip(*d, strict=True)]
        spread = [(sum(x * x for x in c) / len(d) - m * m) ** 0.5 for c, m in zip(zip(*d, strict=True), mean, strict=True)]
        r = got[key]
        assert [r.offset_y, r.offset_cb, r.offset_cr] == pytest.approx(mean)
        assert r.cost == pytest.approx(spread[0] + 0.5 * spread[1] + 0.5 * spread[2])


def test_only_one_block_of_steps_becomes_objects(spark):
    """A batch of recipes reaches Python as Arrow; its steps are never a table of objects."""
    sizes = spark.range(50).selectExpr("id AS image_id", "100L AS total", "10L AS wide")
    recipe = sizes.selectExpr(
        "image_id", "0L AS block",
        "array(named_struct('step_no', 1L, 'op', 'insert', 'row', 0, 'col', 3, 'h', 0, 'w', 0, 'a', image_id % 7, 'b', 0L, 'mask', cast(null as binary))) AS ops",
    )
    got = rp.compiled(sizes, recipe.where("image_id <> 3"))
    assert "MapInArrow" in _plan(got) and "MapInPandas" not in _plan(got)
    last = {r.image_id: (r.lo, r.hi, r.src, r.flags) for r in got.orderBy("image_id", "lo").collect()}
    assert last == {i: (3 + i % 7, 100, 3, rp.MOVED) if i != 3 else (0, 100, 0, 0) for i in range(50)}


def test_splice_points_do_not_read_the_frame_header(spark):
    """Nothing of the frame but what a candidate needs is computed, and no file is made text or turned round to miss a footer."""
    plan = _plan(queries()["d2_splice_points"](spark, SF))
    assert "mcus_x" not in plan and "reverse(" not in plan
    assert plan.count("ArrowEvalPython") == 1
