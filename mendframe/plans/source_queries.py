"""Sources, sinks, wide reports, projects and the stream."""

from __future__ import annotations

import os
import uuid
from functools import partial

from pyspark.sql import functions as F

from mendframe.operators import carve as cv
from mendframe.operators import triage as tg
from mendframe.plans import duck
from mendframe.plans.batch import batch_apply
from mendframe.plans.content_queries import CAMERA_CTE, EMBEDDED_CTE, EXIF_CTE, _greedy, _pictures, _SOI3
from mendframe.plans.edit_queries import _COUNTS, _PROV_SQL, YCC, _base, _steps
from mendframe.plans.registry import query
from mendframe.plans.structure_queries import TABLES_SQL, _SAMPLING
from mendframe.plans.triage_queries import _TRIAGE_ROWS
from mendframe.session import ensure_checkpoint_dir
from mendframe.sources import files as sf
from mendframe.sources import fixtures as fx
from mendframe.sources import projects as pj
from mendframe.sources import sinks
from mendframe.streaming import triage_stream as ts


def _shared_folder(spark, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    root = spark.sparkContext.getCheckpointDir()
    if root.startswith("file:"):
        root = "/" + root[5:].lstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def _written(spark, sf_dir: str, name: str) -> str:
    """The derived files as real files of a shared folder."""
    folder = _shared_folder(spark, name)
    sinks.write_files(fx.files(spark, sf_dir).select(F.col("path").alias("name"), "content"), folder)
    return folder


_NAMED = r"regexp_matches(regexp_extract(path, '[^/]*$'), '(?i)\.jpe?g(\.|$)')"


@query(
    "s1_scan_files",
    "name:s, size:i, read:b, sha:s",
    "WITH " + duck.FILES
    + f" --- SELECT path AS name, n AS size, n <= 4000 AS read, CASE WHEN n <= 4000 THEN sha256(unhex(hx)) END AS sha FROM files WHERE {_NAMED}",
)
def s1_scan_files(spark, sf_dir):
    folder = _written(spark, sf_dir, "scan")
    return sf.scan_files(spark, folder, max_bytes=4000).select(
        F.regexp_extract("path", "([^/]*/[^/]*)$", 1).alias("name"),
        "size",
        F.col("content").isNotNull().alias("read"),
        F.sha2("content", 256).alias("sha"),
    )


_with_markers = partial(sf.load_chunks, markers=True)


# Disk images: fifty files end to end.
def _images_sql(files: int) -> str:
    return f"""docs AS (SELECT * FROM ({fx.files_sql(fx.DUCK)})),
    files AS MATERIALIZED (SELECT *, length(hx) // 2 AS n FROM (SELECT file_id // {files} AS file_id, string_agg(hx, '' ORDER BY file_id) AS hx FROM docs GROUP BY file_id // {files}))"""


_IMAGES = _images_sql(50)


def _images(spark, sf_dir: str, files: int = 50) -> str:
    """Disk images in a folder whose name needs care."""
    folder = _shared_folder(spark, "images")
    parts = fx.files(spark, sf_dir).groupBy(F.expr(f"file_id div {files}").alias("image_id")).agg(
        # Joined at once: a fold would copy what it has for each file.
        F.expr("unhex(array_join(transform(array_sort(collect_list(struct(file_id, content))), x -> hex(x.content)), ''))").alias("content")
    )
    sinks.write_files(parts.select(F.format_string("scan %%20 #1+\u00e4/%06d.img", "image_id").alias("name"), "content"), folder)
    return folder


_IMAGE_ID = "cast(regexp_extract(path, '([0-9]+)[.]img$', 1) as bigint)"


@query(
    "s2_read_chunks",
    "file_id:i, start:i, length:i, sha:s",
    f"""WITH {_IMAGES}, c AS (SELECT *, unnest(range(0, n, 20000)) AS start FROM files)
    --- SELECT file_id, start, least(20000, n - start) AS length, sha256(unhex(substr(hx, 2 * start + 1, 2 * (least(20000, n - start) + 64)))) AS sha FROM c""",
)
def s2_read_chunks(spark, sf_dir):
    chunks = sf.read_chunks(spark, _images(spark, sf_dir), chunk=20000, overlap=64)
    return chunks.select(F.expr(_IMAGE_ID).alias("file_id"), "start", "length", F.sha2("content", 256).alias("sha"))


@query(
    "b17_carve_images",
    "file_id:i, off:i, length:i, width:i, height:i, rank:i",
    "WITH RECURSIVE " + _IMAGES + "," + duck.markers_cte() + ","
    + _pictures("cand", f"SELECT file_id, mk.off AS start, n FROM mk JOIN files USING (file_id) WHERE {_SOI3} "
                        "AND mk.seg_len BETWEEN 65472 AND 65534")
    + ", big AS (SELECT * FROM cand_ok WHERE stop - start >= 1024),"
    + _greedy("kept", "big")
    + """ --- SELECT file_id, start AS off, stop - start AS length, width, height,
        row_number() OVER (PARTITION BY file_id ORDER BY stop - start DESC, start) AS rank
      FROM (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY start) <= 1000)""",
)
def b17_carve_images(spark, sf_dir):
    # Chunks much smaller than the pictures, so that most walks are continued.
    chunks = sf.read_chunks(spark, _images(spark, sf_dir), chunk=16384, overlap=1024, markers=True)
    found = cv.carve(chunks, load=_with_markers, reach=2048, min_length=1024, max_count=1000)
    return found.withColumn("file_id", F.expr(_IMAGE_ID))


@query(
    "b17_carve_images_all",
    "file_id:i, off:i, length:i, width:i, height:i, rank:i",
    "WITH RECURSIVE " + _images_sql(2000) + "," + duck.markers_cte() + ","
    + _pictures("cand", f"SELECT file_id, mk.off AS start, n FROM mk JOIN files USING (file_id) WHERE {_SOI3} "
                        "AND mk.seg_len BETWEEN 65472 AND 65534")
    + ", big AS (SELECT * FROM cand_ok)," + _greedy("kept", "big")
    + """ --- SELECT file_id, start AS off, stop - start AS length, width, height,
        row_number() OVER (PARTITION BY file_id ORDER BY stop - start DESC, start) AS rank FROM kept""",
)
def b17_carve_images_all(spark, sf_dir):
    # Every picture of images that hold two thousand files each.
    chunks = sf.read_chunks(spark, _images(spark, sf_dir, 2000), chunk=65536, overlap=1024, markers=True)
    return cv.carve(chunks, load=_with_markers, reach=2048).withColumn("file_id", F.expr(_IMAGE_ID))


_TG = duck.TRIAGE + f", mc AS ({fx.mcus_sql()})" + _TRIAGE_ROWS.replace("{where}", "false")


@query(
    "s3_triage_rows",
    "path:s, verdict:s, width:i, height:i, mcus:i, decode_errors:i, first_error:i, readable:s, bytes:i, details:s",
    _TG + " --- SELECT *, size AS bytes, summary AS details FROM (SELECT * REPLACE (coalesce(first_error, -1) AS first_error, printf('%.3f', readable) AS readable) FROM triage)",
)
def s3_triage_rows(spark, sf_dir):
    return sinks.triage_rows(tg.triage(fx.files(spark, sf_dir)), wide=True)


# Project files as text, one per document: a quarter of them damaged in some way.
_PROJECT_TEXT = """concat('{"app":"', CASE WHEN doc_id % 16 = 15 THEN 'other' ELSE 'mendframe' END, '","formatVersion":', CASE WHEN doc_id % 16 = 14 THEN '3' ELSE '2' END,
    ',"source":"', CASE WHEN doc_id % 16 = 13 THEN '' WHEN doc_id % 2 = 0 THEN concat('../', source, '/./', doc_id, '.jpg') ELSE concat('/abs/', source, '//', doc_id, '.jpg') END,
    '","sourceBytes":', n_chars, CASE WHEN doc_id % 3 = 0 THEN ',"sourceSha256":"ab12"' ELSE '' END, ',"salvageMode":"', CASE WHEN doc_id % 5 = 0 THEN 'readThrough' ELSE 'truncate' END, '"',
    CASE WHEN doc_id % 4 = 1 THEN concat(',"donor":{"source":"', CASE WHEN doc_id % 32 = 1 THEN '' ELSE 'd.jpg' END, '","spliceOffset":', doc_id, CASE WHEN doc_id % 8 = 5 THEN ',"keepOwnTables":true' ELSE '' END, '}') ELSE '' END,
    CASE WHEN doc_id % 6 = 0 THEN ',"export":"out/x.jpg"' ELSE '' END,
    ',"steps":[{"kind":"', CASE WHEN doc_id % 16 = 12 THEN 'mystery' ELSE 'ops' END, '","description":"shift","ops":[{"type":"', CASE WHEN doc_id % 16 = 11 THEN 'fly' ELSE 'insert' END,
    '","a":3,"b":0,"scope":{"kind":"run","row":1,"col":2,"count":0}}]}',
    CASE WHEN doc_id % 7 = 0 THEN ',{"kind":"bytes","enabled":false,"edits":[{"kind":"flipBit","offset":12,"bit":3}]}' ELSE '' END,
    CASE WHEN doc_id % 9 = 0 THEN ',{"kind":"autoColor","enabled":true}' ELSE '' END, ']}')"""


@query(
    "s4_read_projects",
    "path:s, source_path:s, source_bytes:i, source_sha256:s, salvage_mode:s, donor_path:s, splice_offset:i, keep_own_tables:b, "
    "renumber_restarts:b, restart_interval:i, export_path:s, n_steps:i",
    """SELECT source || '/' || doc_id || '.proj' AS path,
        CASE WHEN doc_id % 2 = 0 THEN source || '/' || doc_id || '.jpg' ELSE '/abs/' || source || '/' || doc_id || '.jpg' END AS source_path,
        n_chars AS source_bytes, CASE WHEN doc_id % 3 = 0 THEN 'ab12' END AS source_sha256, CASE WHEN doc_id % 5 = 0 THEN 'readThrough' ELSE 'truncate' END AS salvage_mode,
        CASE WHEN doc_id % 4 = 1 THEN source || '/d.jpg' END AS donor_path, CASE WHEN doc_id % 4 = 1 THEN doc_id END AS splice_offset,
        doc_id % 8 = 5 AS keep_own_tables, doc_id % 8 = 5 AS renumber_restarts, -1 AS restart_interval,
        CASE WHEN doc_id % 6 = 0 THEN source || '/out/x.jpg' END AS export_path,
        1 + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END AS n_steps
      FROM documents WHERE doc_id % 16 < 11 AND doc_id % 32 <> 1""",
)
def s4_read_projects(spark, sf_dir):
    return pj.project_rows(_parsed(spark, sf_dir)).withColumn("n_steps", F.size("steps"))


def _parsed(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    raw = docs.select(F.expr("concat(source, '/', doc_id, '.proj')").alias("path"), F.expr(_PROJECT_TEXT).alias("value"))
    return pj.parse_projects(raw)


@query(
    "s4_project_errors",
    "path:s, error:s",
    """SELECT source || '/' || doc_id || '.proj' AS path, CASE WHEN doc_id % 16 = 15 THEN 'not a project of this kind' WHEN doc_id % 16 = 14 THEN 'written by a newer version'
        WHEN doc_id % 16 = 13 THEN 'no source' WHEN doc_id % 32 = 1 THEN 'donor without a source'
        WHEN doc_id % 16 = 12 THEN 'step 1: unknown step kind' ELSE 'step 1: unknown operation' END AS error
      FROM documents WHERE doc_id % 16 >= 11 OR doc_id % 32 = 1""",
)
def s4_project_errors(spark, sf_dir):
    return _parsed(spark, sf_dir).where("error IS NOT NULL").select("path", "error")


@query(
    "s4_project_steps",
    "path:s, step_no:i, kind:s, enabled:b, description:s, n_ops:i, n_edits:i",
    """WITH d AS (SELECT *, source || '/' || doc_id || '.proj' AS path FROM documents WHERE doc_id % 16 < 11 AND doc_id % 32 <> 1) ---
      SELECT path, 0 AS step_no, 'ops' AS kind, true AS enabled, 'shift' AS description, 1 AS n_ops, 0 AS n_edits FROM d
      UNION ALL SELECT path, 1, 'bytes', false, '', 0, 1 FROM d WHERE doc_id % 7 = 0
      UNION ALL SELECT path, CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END, 'autoColor', true, '', 0, 0 FROM d WHERE doc_id % 9 = 0""",
)
def s4_project_steps(spark, sf_dir):
    return pj.project_steps(pj.project_rows(_parsed(spark, sf_dir)))


@query(
    "s5_resolve_paths",
    "file_id:i, resolved:s",
    """SELECT doc_id AS file_id, CASE doc_id % 4 WHEN 0 THEN '/p/' || source || '/a/' || doc_id || '.jpg' WHEN 1 THEN '/p/' || doc_id || '.jpg'
      WHEN 2 THEN '/x/' || doc_id || '.jpg' ELSE '/' || doc_id || '.jpg' END AS resolved FROM documents""",
)
def s5_resolve_paths(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("file_id"),
        F.expr("concat('/p/', source, '/x.proj')").alias("project_path"),
        F.expr(
            "CASE doc_id % 4 WHEN 0 THEN concat('./a//', doc_id, '.jpg') WHEN 1 THEN concat('b/../../', doc_id, '.jpg') "
            "WHEN 2 THEN concat('/x/y/../', doc_id, '.jpg') ELSE concat('../../../', doc_id, '.jpg') END"
        ).alias("stored"),
    )
    return pj.resolve_paths(docs)


@query(
    "s5_resolve_uris",
    "file_id:i, resolved:s",
    """SELECT doc_id AS file_id, CASE doc_id % 5 WHEN 0 THEN 'hdfs://nn:8020/p/' || source || '/a b#1%20+ä/' || doc_id || '.jpg'
      WHEN 1 THEN 's3a://bucket/p/' || doc_id || '.jpg' WHEN 2 THEN '/x/' || doc_id || '.jpg' WHEN 3 THEN 's3a://other/k//' || doc_id || '.jpg'
      ELSE 'file:/' || doc_id || '.jpg' END AS resolved FROM documents""",
)
def s5_resolve_uris(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("file_id"),
        F.expr(
            "concat(CASE doc_id % 5 WHEN 0 THEN 'hdfs://nn:8020' WHEN 1 THEN 's3a://bucket' WHEN 2 THEN 'hdfs://nn' WHEN 3 THEN '' ELSE 'file:' END, "
            "'/p/', source, '/x y.proj')"
        ).alias("project_path"),
        F.expr(
            "CASE doc_id % 5 WHEN 0 THEN concat('./a b#1%20+ä//', doc_id, '.jpg') WHEN 1 THEN concat('b/../../', doc_id, '.jpg') "
            "WHEN 2 THEN concat('/x/y/../', doc_id, '.jpg') WHEN 3 THEN concat('s3a://other/k//', doc_id, '.jpg') "
            "ELSE concat('../../../../', doc_id, '.jpg') END"
        ).alias("stored"),
    )
    return pj.resolve_paths(docs)


@query(
    "s6_part_names",
    "file_id:i, name:s, sha:s",
    "WITH RECURSIVE " + duck.MARKERS + ","
    + _pictures("cand", f"SELECT file_id, mk.off AS start, n FROM mk JOIN files USING (file_id) WHERE {_SOI3} "
                        "AND mk.seg_len BETWEEN 65472 AND 65534")
    + ", big AS (SELECT * FROM cand_ok WHERE stop - start >= 1024),"
    + _greedy("kept", "big")
    + """ --- SELECT k.file_id, printf('doc%d_%04d_%dx%d.jpg', k.file_id, row_number() OVER (PARTITION BY k.file_id ORDER BY stop - start DESC, start), width, height) AS name,
        sha256(unhex(substr(f.hx, 2 * start + 1, 2 * (stop - start)))) AS sha FROM kept k JOIN files f ON f.file_id = k.file_id""",
)
def s6_part_names(spark, sf_dir):
    files = fx.files(spark, sf_dir)
    parts = cv.carve(cv.whole_blobs(files), key="file_id", min_length=1024)
    named = sinks.part_names(parts.withColumn("base", F.concat(F.lit("doc"), "file_id")))
    # Bytes are cut where the file is read; only then do they meet their names.
    cuts = named.groupBy("file_id").agg(F.collect_list(F.struct("name", "off", "length")).alias("p"))
    return (
        files.select("file_id", "content")
        .join(cuts, "file_id")
        .select("file_id", F.explode(F.expr("transform(p, x -> named_struct('name', x.name, 'b', substring(content, cast(x.off as int) + 1, cast(x.length as int))))")).alias("x"))
        .select("file_id", "x.name", F.sha2("x.b", 256).alias("sha"))
    )


_PCT = lambda c: f"{c} || chr(9) || printf('%.1f', 100.0 * {c} / greatest(1, total))"


@query(
    "s7_report_text",
    "image_id:i, text:s",
    _PROV_SQL
    + f""", pc AS (SELECT image_id, {_COUNTS} FROM pv GROUP BY image_id)
    --- SELECT image_id, concat_ws(chr(10), 'created' || chr(9) || '2024-01-01',
        'file' || chr(9) || 'img/' || image_id || '.jpg' || chr(9) || (1000 + image_id) || chr(9) || '00ff',
        CASE WHEN image_id % 3 = 0 THEN 'donor' || chr(9) || 'donor.jpg' || chr(9) || image_id * 10 END,
        CASE WHEN image_id % 5 = 0 THEN 'salvage' || chr(9) || 'truncate' || chr(9) || image_id || chr(9) || 7 END,
        CASE WHEN image_id % 4 = 0 THEN 'behind' || chr(9) || 'a video' END,
        'step' || chr(9) || 'on' || chr(9) || 'ops' || chr(9) || 'shift', 'step' || chr(9) || 'off' || chr(9) || 'bytes' || chr(9) || 'cut',
        {", ".join(f"'mcus' || chr(9) || '{c}' || chr(9) || {_PCT(c)}" for c in ('untouched', 'moved', 'dc', 'pasted', 'no_data', 'reencoded'))},
        'result' || chr(9) || 'out/' || image_id || '.jpg' || chr(9) || (900 + image_id) || chr(9) || 'aa' || chr(9) || '64x48') AS text FROM pc""",
)
def s7_report_text(spark, sf_dir):
    from mendframe.plans.edit_queries import e15_provenance_counts

    counts = e15_provenance_counts(spark, sf_dir)
    reports = counts.selectExpr(
        "*",
        "'2024-01-01' AS created",
        "concat('img/', image_id, '.jpg') AS path",
        "1000 + image_id AS size",
        "'00ff' AS sha256",
        "CASE WHEN image_id % 3 = 0 THEN 'donor.jpg' END AS donor_path",
        "image_id * 10 AS splice_offset",
        "CASE WHEN image_id % 4 = 0 THEN 'a video' END AS trailer",
        "CASE WHEN image_id % 5 = 0 THEN named_struct('mode', 'truncate', 'at', image_id, 'dropped', 7) END AS salvage",
        "array(named_struct('kind', 'ops', 'enabled', true, 'description', 'shift'), named_struct('kind', 'bytes', 'enabled', false, 'description', 'cut')) AS steps",
        "concat('out/', image_id, '.jpg') AS out_path",
        "900 + image_id AS out_bytes",
        "'aa' AS out_sha256",
        "64 AS width",
        "48 AS height",
    )
    return sinks.build_report(reports)


@query(
    "s8_file_identity",
    "file_id:i, sha256:s, size:i",
    "WITH " + duck.FILES + " --- SELECT file_id, sha256(unhex(hx)) AS sha256, n AS size FROM files",
)
def s8_file_identity(spark, sf_dir):
    return sf.file_identity(fx.files(spark, sf_dir))


@query(
    "s8_source_mismatch",
    "project_id:i, path:s, state:s",
    "WITH " + duck.FILES
    + """ --- SELECT file_id AS project_id, CASE WHEN file_id % 6 = 5 THEN 'gone/' || path ELSE path END AS path, CASE WHEN file_id % 6 = 5 THEN 'missing'
        WHEN file_id % 6 IN (1, 3) THEN 'changed' ELSE 'same' END AS state FROM files""",
)
def s8_source_mismatch(spark, sf_dir):
    files = fx.files(spark, sf_dir)
    projects = sf.file_identity(files).select(
        F.col("file_id").alias("project_id"),
        F.expr("CASE WHEN file_id % 6 = 5 THEN concat('gone/', path) ELSE path END").alias("path"),
        F.expr("CASE file_id % 6 WHEN 0 THEN sha256 WHEN 1 THEN 'beef' END").alias("source_sha256"),
        F.expr("size + CASE WHEN file_id % 6 = 3 THEN 1 ELSE 0 END").alias("source_bytes"),
    )
    return sf.source_mismatch(projects, files)


@query(
    "s9_carry_times",
    "source_path:s, out_path:s, mtime:s",
    "WITH " + duck.FILES
    + " --- SELECT path AS source_path, path || '.repaired.jpg' AS out_path, strftime(TIMESTAMP '2024-01-01' + to_minutes(file_id), '%Y-%m-%d %H:%M:%S') AS mtime FROM files",
)
def s9_carry_times(spark, sf_dir):
    files = fx.files(spark, sf_dir)
    out = files.select(F.col("path").alias("source_path"), F.concat("path", F.lit(".repaired.jpg")).alias("out_path"))
    return sf.carry_times(out, files)


@query(
    "b21_file_info",
    "file_id:i, verdict:s, sampling:s, mcu_grid:s, progressive:b, scans:i, restart_interval:i, dc_quant:s, camera:s, structure:s, embedded:s",
    _TG + "," + EXIF_CTE + "," + CAMERA_CTE + "," + EMBEDDED_CTE + "," + TABLES_SQL
    + f""", em AS (SELECT file_id, string_agg(printf('%s %dx%d at %d', origin, width, height, start), '|' ORDER BY start) AS embedded FROM emb GROUP BY file_id),
    dq0 AS (SELECT s.file_id, c, {duck.num('data_off + 8 + 3 * c')} % 4 AS slot FROM (SELECT *, unnest(range(least(nc, 3))) AS c FROM sof) s),
    dq AS (SELECT file_id, string_agg(CAST(coalesce(TRY_CAST('0x' || CASE WHEN length(bytes) > 130 THEN substr(bytes, 3, 4) ELSE substr(bytes, 3, 2) END AS BIGINT), 0) AS VARCHAR), ',' ORDER BY c) AS dc_quant
           FROM dq0 LEFT JOIN tbl USING (file_id, slot) WHERE kind = 'DQT' OR kind IS NULL GROUP BY file_id)
    --- SELECT t.file_id, t.verdict, CASE WHEN g.rd THEN {_SAMPLING} END AS sampling, CASE WHEN g.rd THEN f.mcus_x || 'x' || f.mcus_y END AS mcu_grid,
        CASE WHEN g.rd THEN f.progressive END AS progressive, CASE WHEN g.rd THEN f.scan_count END AS scans, CASE WHEN g.rd THEN f.restart_interval END AS restart_interval,
        CASE WHEN g.rd THEN dq.dc_quant END AS dc_quant, c.camera, g.problem AS structure, coalesce(em.embedded, '') AS embedded
      FROM triage t JOIN tg g USING (file_id) LEFT JOIN frames f USING (file_id) LEFT JOIN dq USING (file_id) JOIN camera c USING (file_id) LEFT JOIN em USING (file_id)""",
)
def b21_file_info(spark, sf_dir):
    info = tg.file_info(fx.files(spark, sf_dir))
    by_offset = "array_sort(embedded, (a, b) -> cast(regexp_extract(a, '[0-9]+$', 0) as int) - cast(regexp_extract(b, '[0-9]+$', 0) as int))"
    return info.withColumn("embedded", F.expr(f"array_join({by_offset}, '|')"))


_BATCH_SQL = (
    _PROV_SQL
    + f""", pc AS (SELECT image_id, {_COUNTS} FROM pv GROUP BY image_id),
    rp AS (SELECT t.image_id, sum(b.y + d0) AS sum_y, sum(b.cb + d1) AS sum_cb, sum(b.cr + d2) AS sum_cr FROM tre t LEFT JOIN mc b ON b.image_id = t.image_id AND b.m = t.src GROUP BY t.image_id)
    --- SELECT image_id, CASE WHEN image_id % 2 = 0 THEN 'out/' || image_id || '.jpg' ELSE 'img/' || image_id || '.jpg.repaired.jpg' END AS target, untouched, moved, sum_y, sum_cb, sum_cr
      FROM pc JOIN rp USING (image_id)"""
)
_BATCH = "image_id:i, target:s, untouched:i, moved:i, sum_y:i, sum_cb:i, sum_cr:i"


@query("e22_batch_apply", _BATCH, _BATCH_SQL)
def e22_batch_apply(spark, sf_dir):
    base, steps = _base(spark, sf_dir), _steps(spark, sf_dir)
    projects = base.select("image_id").distinct().selectExpr(
        "image_id",
        "concat('img/', image_id, '.jpg') AS source_path",
        "CASE WHEN image_id % 2 = 0 THEN concat('out/', image_id, '.jpg') END AS output",
        "'' AS export_path",
    )
    pictures, reports = batch_apply(projects, steps, base, fx.MCU_WIDTH, empty=base.where("cb = 0 AND cr = 0"))
    sums = pictures.groupBy("image_id").agg(*[F.sum(c).alias(f"sum_{c}") for c in YCC])
    return reports.join(sums, "image_id")


_STORED = """to_json(named_struct('app', 'mendframe', 'formatVersion', 2, 'source', concat(image_id, '.jpg'), 'steps', transform(array_sort(collect_list(
    struct(step_no, kind, enabled, op, row, col, h, w, a, b))), s -> named_struct('kind', s.kind, 'enabled', s.enabled,
        'ops', CASE WHEN s.kind = 'ops' THEN array(named_struct('type', s.op, 'a', s.a, 'b', s.b, 'coefs', CASE WHEN s.op = 'paste' THEN 'AAA=' END,
            'scope', named_struct('kind', CASE WHEN s.h > 0 THEN 'rect' ELSE 'run' END, 'row', s.row, 'col', s.col,
                'height', s.h, 'width', s.w, 'count', s.w))) END,
        'edits', CASE WHEN s.kind = 'bytes' THEN array(named_struct('kind', 'flipBit', 'offset', 9, 'bit', 1)) END))))"""


@query("e22_batch_from_json", _BATCH, _BATCH_SQL)
def e22_batch_from_json(spark, sf_dir):
    # The recipes as stored projects, parsed and fed to the batch; every picture's width is a column.
    raw = _steps(spark, sf_dir).groupBy("image_id").agg(F.expr(_STORED).alias("value"))
    parsed = pj.parse_projects(raw.select(F.concat(F.lit("p/"), "image_id", F.lit(".proj")).alias("path"), "value"))
    image = F.expr("cast(regexp_extract(path, '([0-9]+)[.]proj$', 1) as bigint)").alias("image_id")
    steps = pj.project_operations(pj.project_rows(parsed)).select(image, "*")
    base = _base(spark, sf_dir).withColumn("wide", F.lit(fx.MCU_WIDTH))
    projects = base.select("image_id").distinct().selectExpr(
        "image_id",
        "concat('img/', image_id, '.jpg') AS source_path",
        "CASE WHEN image_id % 2 = 0 THEN concat('out/', image_id, '.jpg') END AS output",
        "'' AS export_path",
    )
    pictures, reports = batch_apply(projects, steps, base, "wide", empty=base.where("cb = 0 AND cr = 0"))
    sums = pictures.groupBy("image_id").agg(*[F.sum(c).alias(f"sum_{c}") for c in YCC])
    return reports.join(sums, "image_id")


_STREAM_SQL = (
    _TG
    + f""", seen AS (SELECT t.verdict, f.hx FROM triage t JOIN files f USING (file_id) WHERE {_NAMED.replace('path', 't.path')})
      --- SELECT verdict, count(*) AS n, count(DISTINCT hx) AS n_contents FROM seen GROUP BY verdict"""
)


@query(
    "t1_triage_stream",
    "verdict:s, n:i, n_contents:i",
    _STREAM_SQL,
)
def t1_triage_stream(spark, sf_dir):
    folder, rows = _written(spark, sf_dir, "arriving"), _shared_folder(spark, "rows")
    stream = ts.triage_stream(spark, folder, rows, _shared_folder(spark, "state"))
    stream.awaitTermination()
    return ts.running_counts(spark, rows)


def _backdated(rows):
    """Gives files of the shared folder the times of old photographs."""
    for r in rows:
        os.utime(r.target, (r.time, r.time))


@query("t1_triage_stream_old_files", "verdict:s, n:i, n_contents:i", _STREAM_SQL)
def t1_triage_stream_old_files(spark, sf_dir):
    # Two batches; the files of the second are up to thirty years older than those of the first.
    folder, rows, state = (_shared_folder(spark, n) for n in ("arriving", "rows", "state"))
    every = fx.files(spark, sf_dir).select(F.col("path").alias("name"), "content", (F.col("file_id") % 2).alias("half"), "file_id")
    for half in (0, 1):
        part = every.where(F.col("half") == half)
        sinks.write_files(part, folder)
        if half:
            part.select(
                F.concat(F.lit(folder + "/"), "name").alias("target"), F.expr("cast(700000000 + file_id * 86400 as bigint)").alias("time")
            ).foreachPartition(_backdated)
        ts.triage_stream(spark, folder, rows, state).awaitTermination()
    return ts.running_counts(spark, rows)
