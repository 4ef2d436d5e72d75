"""Files, pictures and steps that earlier limits would have dropped."""

import json
from base64 import b64encode

import pytest
from pyspark.sql import functions as F
from test_planted import jpeg, table

from mendframe.operators import carve as cv
from mendframe.operators import donors as dn
from mendframe.operators import edits as ed
from mendframe.operators import fill as fl
from mendframe.operators import grid as g
from mendframe.operators import replay as rp
from mendframe.operators.triage import triage
from mendframe.sources import files as sf
from mendframe.sources import projects as pj
from mendframe.sources import sinks

NAMES = ["a b.jpg", "c#d.jpg", "e%20f.jpg", "\u00fc+.jpg", "x?y.jpg"]


def test_names_that_need_care(spark, tmp_path):
    folder = tmp_path / "DCIM 100#"
    folder.mkdir()
    for i, n in enumerate(NAMES):
        (folder / n).write_bytes(jpeg(8 + i, 8))
    read = {r.path.rpartition("/")[2]: bytes(r.content) for r in sf.scan_files(spark, str(tmp_path)).collect()}
    assert read == {n: jpeg(8 + i, 8) for i, n in enumerate(NAMES)}
    chunks = sf.read_chunks(spark, str(tmp_path), chunk=16, overlap=4).collect()
    for i, n in enumerate(NAMES):
        own = sorted((c.start, bytes(c.content)) for c in chunks if c.path.endswith("/" + n))
        assert b"".join(c[:16] for _, c in own) == jpeg(8 + i, 8)


def test_bounded_batches(spark, tmp_path):
    data = bytes(range(256)) * 40
    (tmp_path / "a.img").write_bytes(data)
    pieces = sf.plan_chunks(spark, str(tmp_path), 100)
    got = sorted((r.start, bytes(r.content)) for r in sf.load_chunks(pieces.coalesce(1), batch_bytes=1000).collect())
    assert b"".join(c for _, c in got) == data


def test_disk_image_of_some_gib(spark, tmp_path):
    """Pictures at both ends of a sparse image, a truncated one before the empty stretch."""
    first, last = jpeg(64, 48, b"a" * 3000), jpeg(32, 24, b"b" * 2000)
    size = (2 << 30) + (300 << 20)
    with open(tmp_path / "disk.img", "wb") as f:
        f.write(b"\x00" * 512 + first + b"\x00" * 100 + jpeg(16, 16, b"c" * 900, tail=b""))
        f.seek(size)
        f.write(last + b"\x00" * 64)
    asked = []

    def load(pieces):
        asked.append(pieces.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0])
        return sf.load_chunks(pieces)

    chunks = sf.read_chunks(spark, str(tmp_path), chunk=64 << 20)
    found = cv.carve(chunks, load=load, reach=1 << 16).orderBy("off").collect()
    # The open walk goes on at the next marker, which is the last picture's SOI and ends it.
    assert [(r.off, r.length, r.width) for r in found] == [(512, len(first), 64), (size, len(last), 32)]
    assert sum(asked) < 1 << 20


def test_more_than_a_thousand_pictures(spark):
    one = jpeg(8, 8)
    blob = b"".join(one + bytes([i % 251]) for i in range(1500))
    got = cv.carve(cv.whole_blobs(table(spark, [blob])), key="file_id").collect()
    assert sorted(r.off for r in got) == [i * (len(one) + 1) for i in range(1500)]
    assert sorted(r["rank"] for r in got) == list(range(1, 1501))


def test_unread_file_is_not_judged(spark):
    files = table(spark, [jpeg(8, 8), jpeg(8, 8)]).withColumn("content", F.when(F.col("file_id") == 0, F.col("content")))
    got = {r.file_id: (r.verdict, r.readable) for r in triage(files).collect()}
    assert got == {0: ("healthy", 1.0), 1: ("not read", None)}


def test_files_without_edits_stay(spark):
    files = table(spark, [b"abc", b"defg"])
    edits = spark.createDataFrame(
        [(0, 0, "deleteBytes", 1, 0, 1, bytearray())], "file_id long, edit_no int, kind string, offset long, bit int, count long, data binary"
    )
    assert {r.file_id: bytes(r.content) for r in ed.apply_byte_edits(files, edits).collect()} == {0: b"ac", 1: b"defg"}


def test_equal_base_names_do_not_meet(spark, tmp_path):
    parts = spark.createDataFrame([("d1/a.img", 1, 0, 8, 8, bytearray(b"x")), ("d2/a.img", 1, 0, 8, 8, bytearray(b"y"))],
                                  "path string, rank int, off long, width int, height int, content binary").withColumn("base", F.lit("a"))
    sinks.write_parts(parts, str(tmp_path))
    assert sorted(p.read_bytes() for p in tmp_path.rglob("*.jpg")) == [b"x", b"y"]
    assert not list(tmp_path.rglob("*.part"))


def test_one_folder_with_most_files(spark):
    blobs = [jpeg(16, 16, b"s" * 50, nc=3)] * 60 + [b"junk"] * 540
    files = table(spark, blobs).withColumn("path", F.expr("format_string('hot/%04d.jpg', 599 - file_id)"))
    got = dn.suggest_siblings(files).collect()
    usable = sorted(f"hot/{599 - i:04d}.jpg" for i in range(60))
    want = {i: usable[1] if f"hot/{599 - i:04d}.jpg" == usable[0] else usable[0] for i in range(600)}
    assert {r.file_id: r.donor_path for r in got} == want


def test_small_hole_gets_the_answer_as_it_is(spark):
    px = spark.range(16).selectExpr("0L AS image_id", "id % 4 AS x", "id div 4 AS y", "id AS c0", "id AS c1", "id AS c2")
    answer = px.withColumn("c0", F.col("c0") + 3)
    fit, registered = fl.register_grids(px, answer, px.where("x = 1").select("image_id", "x", "y"))
    row = fit.first()
    assert (row.dx, row.gain0, row.offset0, row.residual) == (0, 1.0, 0.0, None)
    assert {(r.x, r.y): r.c0 for r in registered.collect()} == {(r.x, r.y): r.c0 for r in answer.collect()}


def test_each_picture_has_its_own_width(spark):
    mask = spark.createDataFrame([(1, 0, 4, 5), (1, 1, 0, 5), (2, 0, 4, 9), (2, 1, 5, 9)], "image_id long, row long, col long, wide int")
    got = {(r.image_id, r.first_m): r.mcus for r in g.regions(mask, "wide").collect()}
    assert got == {(1, 4): 1, (1, 5): 1, (2, 4): 2}
    grown = g.dilate(spark.createDataFrame([(1, 0, 0, 2, 2), (2, 3, 3, 9, 9)], "image_id long, x long, y long, wide int, high int"), 1, "wide", "high")
    assert grown.groupBy("image_id").count().orderBy("image_id").collect() == [(1, 4), (2, 9)]


def test_map_is_read_where_the_picture_comes_from(spark):
    px = spark.range(64).selectExpr("0L AS image_id", "id % 16 AS x", "id div 16 AS y", "100L AS c0", "128L AS c1", "128L AS c2")
    mcus = spark.createDataFrame([(0, 0, 1), (0, 1, 0), (0, 2, 0), (0, 3, 2)], "image_id long, m long, anomalies int")
    traced = spark.createDataFrame([(0, 0, 1), (0, 1, 0), (0, 2, 3), (0, 3, None)], "image_id long, m long, src long")
    score = lambda t: {r.m: r.score for r in g.damage_score(px, 16, 4, 4, 4, mcus, t).collect()}
    assert score(None) == {0: 1.0, 1: 0.0, 2: 0.0, 3: 1.0}
    assert score(traced) == {0: 0.0, 1: 1.0, 2: 1.0, 3: 0.0}


def test_padding_blocks_do_not_count(spark):
    side = lambda v: [float(v)] * 8
    rows = []
    for r in range(3):
        for c in range(3):
            inside = c == 1
            # The last column is padding with wild values.
            v = 90 if c == 2 else (10 if inside else 20)
            rows.append((0, r * 3 + c, 0, r, c, side(v), side(v), side(v), side(v), 3, 2))
    edges = spark.createDataFrame(
        rows, "image_id long, m long, comp int, brow long, bcol long, top array<double>, bottom array<double>, left array<double>, right array<double>, brows int, bcols int"
    )
    mask = spark.createDataFrame([(0, 1), (0, 4), (0, 7), (0, 2)], "image_id long, m long")
    quant = spark.createDataFrame([(0, 0, [8] * 64)], "image_id long, comp int, q array<int>")
    assert [(r.shift, r.boundary) for r in g.estimate_dc(edges, mask, quant).collect()] == [(10.0, 24)]


def test_regions_over_several_bands(spark):
    """A snake through all rows, beside single dots, whatever the height of a band."""
    rows = [(1, r, c) for r in range(0, 40, 2) for c in range(10)] + [(1, r, 9 if r % 4 == 1 else 0) for r in range(1, 40, 2)]
    rows += [(1, r, 12) for r in range(0, 40, 3)]
    mask = spark.createDataFrame(rows, "image_id long, row long, col long")
    want = [(0, 0, 39, 9, 220)] + [(r, 12, r, 12, 1) for r in range(0, 40, 3)]
    for band in (1, 3, 256):
        got = sorted((r.r0, r.c0, r.r1, r.c1, r.mcus) for r in g.regions(mask, 14, band).collect())
        assert got == sorted(want)


def _project(steps):
    return json.dumps({"app": "mendframe", "formatVersion": 2, "source": "a.jpg", "steps": steps})


def test_project_becomes_recipe_edits_and_clips(spark):
    coefs = b64encode(b"".join((v & 0xFFFF).to_bytes(2, "little") for v in range(-64, 64))).decode()
    steps = [
        {"kind": "ops", "ops": [{"type": "cdelta", "a": 0, "b": 5, "scope": {"kind": "mask", "rows": 2, "cols": 3, "mask": b64encode(bytes([0, 1, 0, 0, 0, 1])).decode()}},
                                {"type": "insert", "a": 1, "scope": {"kind": "run", "row": 0, "col": 2}}]},
        {"kind": "bytes", "edits": [{"kind": "insertBytes", "offset": 1, "data": b64encode(b"\x07").decode()}]},
        {"kind": "bytes", "enabled": False, "edits": [{"kind": "deleteBytes", "offset": 0, "count": 1}]},
        {"kind": "autoColor"},
        {"kind": "ops", "ops": [{"type": "paste", "a": 1, "coefs": coefs, "scope": {"kind": "run", "row": 1, "col": 0}}]},
    ]
    raw = spark.createDataFrame([("p/1.proj", _project(steps))], "path string, value string")
    projects = pj.project_rows(pj.parse_projects(raw))
    operations = pj.project_operations(projects)
    assert [(r.step_no, r.kind, r.op, r.w) for r in operations.orderBy("step_no").collect()] == [
        (0, "ops", "cdelta", 0), (1, "ops", "insert", 0), (2, "autoColor", None, 0), (3, "ops", "paste", 0)
    ]
    grid = spark.range(6).selectExpr("'p/1.proj' AS image_id", "id AS m", "6L AS total", "3 AS wide")
    traced = rp.trace(grid, rp.recipes(operations.withColumnRenamed("path", "image_id")), "wide").orderBy("m").collect()
    # The insert shows 2, 3, 4 one on; the paste covers 3; brighter are the originals 1 and 5.
    assert [r.src for r in traced] == [0, 1, 2, None, 3, 4]
    assert [r.d0 for r in traced] == [0, 5, 0, 0, 0, 0]
    clips = pj.project_clips(projects, 2).orderBy("unit").collect()
    assert [(r.paste_step, r.paste_i, r.unit, r.coef[0], r.coef[63]) for r in clips] == [(3, 0, 0, -64, -1), (3, 0, 1, 0, 63)]
    edits = pj.project_edits(projects).withColumn("file_id", F.lit(0).cast("long"))
    assert bytes(ed.apply_byte_edits(table(spark, [b"ab"]), edits).first().content) == b"a\x07b"


@pytest.mark.parametrize("op", ["unitInsert", "fly"])
def test_operations_that_cannot_be_traced_are_an_error(spark, op):
    steps = spark.createDataFrame(
        [(0, 7, "ops", True, op, 0, 4, 0, 0, 2, 0)],
        "image_id long, step_no long, kind string, enabled boolean, op string, row long, col long, h long, w long, a long, b long",
    )
    grid = spark.range(16).selectExpr("0L AS image_id", "id AS m", "16L AS total")
    with pytest.raises(Exception, match="operation"):
        rp.trace(grid, rp.recipes(steps), 4).collect()


def test_one_set_of_tables_for_nearly_all(spark):
    """Nine files of ten share their tables."""
    rows = [(i, "DQT", 0, bytearray(b"std" if i % 10 else b"own%d" % i)) for i in range(400)]
    own = spark.createDataFrame(rows, "file_id long, kind string, slot int, bytes binary")
    donor = spark.createDataFrame([(100 + k, "DQT", 0, bytearray(b"std")) for k in range(30)], "donor_id long, kind string, slot int, bytes binary")
    got = dn.table_donors(own, donor, k=3).collect()
    assert {(r.file_id, r.donor_id, r["rank"]) for r in got} == {(i, 100 + k, k + 1) for i in range(400) if i % 10 for k in range(3)}
