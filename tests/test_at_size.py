"""Steps whose cost must not grow faster than their input."""

from __future__ import annotations

import contextlib
import io
import re

import pytest

from __spark_entry__ import queries
from conftest import SF
from mendframe.operators import color
from mendframe.operators import donors as dn
from mendframe.operators import fill as fl
from mendframe.operators import mcu_stream as ms
from mendframe.operators import replay as rp
from mendframe.operators.markers import find_markers, with_markers
from mendframe.plans.batch import batch_apply
from mendframe.sources import files as sf
from mendframe.streaming import triage_stream as ts


def _plan(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_stream_works_off_a_full_folder_in_batches(spark, tmp_path):
    """No batch holds more files than asked for, and every file is in one."""
    (tmp_path / "in").mkdir()
    for i in range(23):
        (tmp_path / "in" / f"{i}.jpg").write_bytes(b"\xff\xd8" + bytes([i]))
    rows = str(tmp_path / "rows")
    ts.triage_stream(spark, str(tmp_path / "in"), rows, str(tmp_path / "state"), batch_files=5).awaitTermination()
    sizes = [r["count"] for r in spark.read.parquet(rows).groupBy("batch").count().collect()]
    assert max(sizes) <= 5 and sum(sizes) == 23
    assert sum(r.n_contents for r in ts.running_counts(spark, rows).collect()) == 23


def test_patches_are_not_broadcast(spark):
    """Each rect becomes thousands of pixels; the driver holds neither them nor the picture."""
    pixels = spark.range(64).selectExpr("1L AS image_id", "id % 8 AS x", "id div 8 AS y", "id AS c0", "id + 1 AS c1", "id + 2 AS c2")
    rects = spark.range(2).selectExpr("1L AS image_id", "id AS rect_id", "id AS row", "0L AS col", "1L AS rows", "2L AS cols", "0L AS d_row", "1L AS d_col")
    got = color.patch_pixels(pixels, rects, 4, 4, 8, 8)
    assert "Broadcast" not in _plan(got)
    want = {(k, x, y): 8 * min(4 * k + y, 7) + min(4 + x, 7) for k in range(2) for x in range(8) for y in range(4)}
    assert {(r.rect_id, r.x, r.y): r.c0 for r in got.collect()} == want


def test_candidates_are_not_repeated_for_each_distinct_count(spark):
    """Candidates are hundreds of thousands a file; none is copied or shuffled to be counted."""
    assert "Expand" not in _plan(queries()["m3_resync_candidates"](spark, SF))


ROWS = [
    "e2_copy_blocks",
    "e3_insert_mcus",
    "e4_delete_mcus",
    "e6_paste",
    "e6_paste_insert",
    "e7_fill_scope",
    "m4_expected_dc",
]


@pytest.mark.parametrize("name", ROWS)
def test_a_row_per_mcu(spark, name):
    """Every MCU is a row of the result; no digest stands for them."""
    got = queries()[name](spark, SF)
    assert "m" in got.columns and got.count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()


def test_metrics_of_runs_shuffle_nothing(spark):
    """A trial that lies in one array is measured where it lies, as from its rows."""
    trials = spark.range(4000).selectExpr(
        "id % 5 AS file_id", "id div 400 AS cand_id", "(id div 5) % 80 AS k", "CASE WHEN (id * 7) % 211 = 0 THEN 2L ELSE 0L END AS anomalies", "id % 13 AS bits",
        "array(id % 17, id % 19) AS dc", "array(CASE WHEN id % 3 > 0 THEN id % 7 END, 5L) AS expected", "array(3, 5) AS q00",
        "100 - (id div 5) % 80 AS remaining", "id % 97 = 0 AS at_restart",
    )
    runs = spark.createDataFrame(ms.trial_runs(trials).collect(), ms.trial_runs(trials).schema)
    for window in (48, 400):
        assert "Exchange" not in _plan(ms.run_metrics(runs, window))
        got, want = (sorted(map(tuple, df.collect())) for df in (ms.run_metrics(runs, window), ms.trial_metrics(trials, window)))
        assert got == want and len(got) == 50


def test_drift_makes_no_row_for_a_pixel_at_a_shift(spark):
    """Costs over several tiles, with holes, equal brute force; pixels meet by tile, not by place."""
    here = {(x, y): (x * 7 + y * 13) % 251 for x in range(150) for y in range(70) if (x * y) % 11 != 3}
    there = {(x, y): (x * 5 + y * y) % 241 for x in range(150) for y in range(70) if (x + y) % 7 != 2}
    table = lambda px: spark.createDataFrame([(4, x, y, v) for (x, y), v in px.items()], "image_id long, x long, y long, v long")
    center = spark.createDataFrame([(4, 6, -4)], "image_id long, _sx long, _sy long")
    got = fl._drift_costs(table(here), table(there), center, 2)
    assert not re.search(r"hashpartitioning\(image_id#\d+L?, (x|y|dx|dy)#", _plan(got))
    want = {}
    for dx in range(4, 9):
        for dy in range(-6, -1):
            d = [v - there[x + dx, y + dy] for (x, y), v in here.items() if (x + dx, y + dy) in there]
            want[dx, dy] = sum(e * e for e in d) / len(d) - (sum(d) / len(d)) ** 2
    costs = {(r.dx, r.dy): r.cost for r in got.collect()}
    assert costs.keys() == want.keys() and all(abs(costs[k] - want[k]) < 1e-6 for k in want)


def test_tasks_are_not_merged_by_the_bytes_of_their_shuffle(spark, tmp_path):
    """Names of pieces and steps of recipes are few bytes and much work."""
    (tmp_path / "a.img").write_bytes(bytes(300))
    steps = spark.createDataFrame(
        [(1, 0, "ops", True, "insert", 0, 1, 0, 0, 2, 0)],
        "image_id long, step_no long, kind string, enabled boolean, op string, row long, col long, h long, w long, a long, b long",
    )
    grid = spark.range(20).selectExpr("1L AS image_id", "id AS m", "20L AS total")
    traced = rp.trace(grid, rp.recipes(steps), 16)
    for df, shuffles in ((sf.read_chunks(spark, str(tmp_path), 100, 4), 1), (traced, 2)):
        assert _plan(df).count("REPARTITION_BY_NUM") == shuffles
    assert [r.src for r in traced.orderBy("m").collect()] == [0, 1, 2, *range(1, 18)]


def test_chunks_bring_the_markers_of_their_bytes(spark, tmp_path):
    """Found while a batch is read, in batches far smaller than the file."""
    (tmp_path / "a.img").write_bytes(bytes([0, 255, 216, 255, 255, 218, 0, 9, 255]) * 50)
    pieces = sf.plan_chunks(spark, str(tmp_path), 100)
    got = sf.load_chunks(pieces, 7, batch_bytes=150, markers=True)
    assert "ArrowEvalPython" not in _plan(with_markers(got))
    again = got.withColumn("again", find_markers("content")).collect()
    assert len(again) == 5 and all(r.markers == r.again for r in again) and sum(len(r.content) for r in again) == 450 + 4 * 7


def test_stored_recipes_are_parsed_once(spark):
    """The batch numbers its steps, for which it reads them twice."""
    n = spark.sparkContext.accumulator(0)
    schema = "image_id long, step_no long, kind string, enabled boolean, op string, row long, col long, h long, w long, a long, b long"

    def counted(batches):
        for b in batches:
            n.add(len(b))
            yield b

    steps = spark.createDataFrame([(1, k, "ops", True, "insert", 0, 1, 0, 0, 2, 0) for k in range(3)], schema).mapInPandas(counted, schema)
    base = spark.range(20).selectExpr("1L AS image_id", "id AS m", "20L AS total", "id AS y", "id AS cb", "id AS cr")
    projects = spark.createDataFrame([(1, "a.jpg", "b.jpg", "")], "image_id long, source_path string, output string, export_path string")
    batch_apply(projects, steps, base, 16)
    assert n.value == 3


def test_widths_make_no_row_for_an_mcu_at_a_width(spark):
    """A stream of several blocks, with a gap, equals brute force; MCUs meet by block, not by place."""
    n, widths = 9500, [7, 16, 250]
    mcu = {m: (m * 37 % 101, m * 53 % 97, m % 11) for m in range(n) if m not in (4100, 8190)}
    edges = spark.createDataFrame([(3, m, *v, n) for m, v in mcu.items()], "image_id long, m long, top long, bottom long, inner long, total long")
    got = dn.detect_width(edges, widths)
    assert not re.search(r"hashpartitioning\(image_id#\d+L?, (above|m)#", _plan(got))
    rows = {r.width: (r.rows, r.cost) for r in got.collect()}
    assert rows.keys() == set(widths)
    for w in widths:
        pairs = [(mcu[m], mcu[m - w]) for m in mcu if w <= m < w * (n // w) and m - w in mcu]
        seam = sum(abs(a[0] - b[1]) for a, b in pairs) / len(pairs)
        assert rows[w][0] == n // w and abs(rows[w][1] - seam / (sum(a[2] for a, _ in pairs) / len(pairs) + 1)) < 1e-9


def test_small_files_do_not_make_a_task_each(spark, tmp_path):
    """A folder of any number of files is read by a fixed number of tasks, and every file is in one of them."""
    for i in range(1200):
        (tmp_path / f"{i}.jpg").write_bytes(b"\xff\xd8" + str(i).encode() * (1 + 9 * (i % 5 == 0)))
    got = sf.scan_files(spark, str(tmp_path), max_bytes=20)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert got.rdd.getNumPartitions() <= 2 * tasks
    want = {i: b"\xff\xd8" + str(i).encode() * (1 + 9 * (i % 5 == 0)) for i in range(1200)}
    rows = {int(r.path.rpartition("/")[2][:-4]): r for r in got.collect()}
    assert {i: r.size for i, r in rows.items()} == {i: len(c) for i, c in want.items()}
    assert {i: r.content and bytes(r.content) for i, r in rows.items()} == {i: c if len(c) <= 20 else None for i, c in want.items()}
