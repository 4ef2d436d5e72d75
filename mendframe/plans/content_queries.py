"""Exif, embedded pictures and carving over the JPEG files derived from `documents`."""

from __future__ import annotations

from pyspark.sql import functions as F

from mendframe.operators import carve as cv
from mendframe.operators import exif as ex
from mendframe.plans import duck
from mendframe.plans.registry import query
from mendframe.plans.triage_queries import MPF_CTE
from mendframe.sources import fixtures as fx

_E = duck.either
EXIF_CTE = f"""
    ex0 AS (SELECT s.file_id, f.hx, data_off + 6 AS tiff, data_length - 6 AS size, {duck.h('data_off + 6', 2)} = '4949' AS little
            FROM segs s JOIN files f USING (file_id) WHERE marker = 225 AND data_length >= 14
              AND {duck.h('data_off', 6)} = '457869660000'
              AND NOT EXISTS (SELECT 1 FROM segs k WHERE k.file_id = s.file_id AND k.marker = 218 AND k.off < s.off)
            QUALIFY row_number() OVER (PARTITION BY s.file_id ORDER BY seg_no) = 1),
    ex1 AS (SELECT *, {_E('tiff + 4', 4)} AS ifd0 FROM ex0 WHERE {duck.h('tiff', 2)} IN ('4949', '4D4D')),
    ex2 AS (SELECT *, {_E('tiff + ifd0', 2)} AS n0 FROM ex1 WHERE ifd0 + 2 <= size),
    ex3 AS (SELECT *, CASE WHEN ifd0 + 6 + 12 * n0 <= size THEN {_E('tiff + ifd0 + 2 + 12 * n0', 4)} END AS ifd1 FROM ex2),
    ifds AS (SELECT file_id, hx, tiff, size, little, 'IFD0' AS ifd, ifd0 AS pos FROM ex3
             UNION ALL SELECT file_id, hx, tiff, size, little, 'IFD1', ifd1 FROM ex3 WHERE ifd1 > 0),
    rows_a AS (SELECT *, unnest(range({_E('tiff + pos', 2)})) AS i FROM ifds WHERE pos + 2 <= size),
    rows_b AS (SELECT *, pos + 2 + 12 * i AS e FROM rows_a WHERE pos + 14 + 12 * i <= size),
    subs AS (SELECT file_id, hx, tiff, size, little, 'Exif' AS ifd, {_E('tiff + e + 8', 4)} AS pos FROM rows_b
             WHERE ifd = 'IFD0' AND {_E('tiff + e', 2)} = 34665
             QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY i) = 1),
    rows_c AS (SELECT *, unnest(range({_E('tiff + pos', 2)})) AS i FROM subs WHERE pos + 2 <= size),
    rows_d AS (SELECT *, pos + 2 + 12 * i AS e FROM rows_c WHERE pos + 14 + 12 * i <= size),
    exif_e AS MATERIALIZED (
      SELECT file_id, hx, tiff, size, ifd, e, i, {_E('tiff + e', 2)} AS tag, {_E('tiff + e + 2', 2)} AS type,
             {_E('tiff + e + 4', 4)} AS count,
             CASE WHEN {_E('tiff + e + 2', 2)} = 3 AND {_E('tiff + e + 4', 4)} = 1 THEN {_E('tiff + e + 8', 2)}
                  ELSE {_E('tiff + e + 8', 4)} END AS value
      FROM (SELECT * FROM rows_b UNION ALL SELECT * FROM rows_d))"""
EXIF = duck.FRAMES + "," + EXIF_CTE
CAMERA_CTE = """
    cam0 AS (SELECT file_id, tag, substr(hx, 2 * (tiff + value) + 1, 2 * count) AS b FROM exif_e
             WHERE ifd = 'IFD0' AND tag IN (271, 272) AND type = 2 AND count > 4 AND value + count <= size),
    cam1 AS (SELECT file_id, tag, trim(replace(decode(unhex(b)), chr(0), '')) AS v FROM cam0),
    cam AS MATERIALIZED (SELECT file_id, coalesce(max(v) FILTER (tag = 271), '') AS make, coalesce(max(v) FILTER (tag = 272), '') AS model
            FROM cam1 GROUP BY file_id),
    camera AS MATERIALIZED (SELECT file_id, coalesce(CASE WHEN make = '' OR starts_with(lower(model), lower(make)) THEN model
               ELSE make || ' ' || model END, '') AS camera FROM files LEFT JOIN cam USING (file_id))"""


@query(
    "b22_exif_entries",
    "file_id:i, ifd:s, tag:i, type:i, count:i, value:i",
    EXIF + " --- SELECT * FROM exif_e",
)
def b22_exif_entries(spark, sf_dir):
    return ex.exif_entries(fx.files(spark, sf_dir))


@query("b23_camera_model", "file_id:i, camera:s", EXIF + "," + CAMERA_CTE + " --- SELECT * FROM camera")
def b23_camera_model(spark, sf_dir):
    return ex.camera_model(fx.files(spark, sf_dir))


@query(
    "b23_orientation",
    "file_id:i, orientation:i",
    EXIF
    + """ --- SELECT file_id, CASE WHEN value BETWEEN 1 AND 8 THEN value ELSE 1 END AS orientation
      FROM files LEFT JOIN (SELECT file_id, value FROM exif_e WHERE ifd = 'IFD0' AND tag = 274) USING (file_id)""",
)
def b23_orientation(spark, sf_dir):
    return ex.orientation(fx.files(spark, sf_dir))


@query(
    "b23_thumbnail_ref",
    "file_id:i, off:i, length:i, sha:s",
    EXIF
    + """ --- SELECT o.file_id, o.tiff + o.value AS off, l.value AS length,
        sha256(unhex(substr(o.hx, 2 * (o.tiff + o.value) + 1, 2 * l.value))) AS sha
      FROM exif_e o JOIN exif_e l ON o.file_id = l.file_id AND o.ifd = 'IFD1' AND l.ifd = 'IFD1' AND o.tag = 513 AND l.tag = 514
      WHERE l.value >= 4 AND o.value + l.value <= o.size""",
)
def b23_thumbnail_ref(spark, sf_dir):
    return ex.thumbnail_ref(fx.files(spark, sf_dir)).withColumn("sha", F.sha2("thumbnail", 256))


@query(
    "b24_exif_size_mismatch",
    "file_id:i, exif_width:i, exif_height:i, width:i, height:i",
    EXIF
    + """, nm AS (SELECT file_id, max(value) FILTER (tag = 40962) AS exif_width, max(value) FILTER (tag = 40963) AS exif_height
         FROM exif_e WHERE ifd = 'Exif' GROUP BY file_id)
    --- SELECT file_id, exif_width, exif_height, width, height FROM nm JOIN frames USING (file_id)
      WHERE exif_width <> width OR exif_height <> height""",
)
def b24_exif_size_mismatch(spark, sf_dir):
    return ex.exif_size_mismatch(fx.files(spark, sf_dir))


def _pictures(name: str, starts: str) -> str:
    """Complete pictures among `starts` (file_id, start, n)."""
    return (
        duck.chase_cte(starts, name=name)
        + f""",
    {name}_sof AS (SELECT c.file_id, c.start, TRY_CAST('0x' || head[13:16] AS BIGINT) AS width, TRY_CAST('0x' || head[9:12] AS BIGINT) AS height
        FROM {name} c JOIN mk ON mk.file_id = c.file_id AND mk.off = c.off WHERE c.status = 'seg' AND {duck.is_sof('c.code')} AND c.seg_len >= 8
        QUALIFY row_number() OVER (PARTITION BY c.file_id, c.start ORDER BY c.step) = 1),
    {name}_ok AS MATERIALIZED (SELECT e.file_id, e.start, e.off + 2 AS stop, width, height FROM {name} e
        JOIN {name}_sof s ON s.file_id = e.file_id AND s.start = e.start
        WHERE e.status = 'eoi' AND e.n_scans > 0 AND width > 0 AND height > 0)"""
    )


def _greedy(name: str, source: str) -> str:
    """Keeps pictures in offset order that do not begin inside a kept one."""
    return f"""
    {name}_o AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY start) AS rn FROM {source}),
    {name}_g AS (SELECT file_id, start, stop, width, height, rn, stop AS until, true AS kept FROM {name}_o WHERE rn = 1
      UNION ALL
      SELECT o.file_id, o.start, o.stop, o.width, o.height, o.rn,
             CASE WHEN o.start >= g.until THEN o.stop ELSE g.until END, o.start >= g.until
      FROM {name}_g g JOIN {name}_o o ON o.file_id = g.file_id AND o.rn = g.rn + 1),
    {name} AS (SELECT * FROM {name}_g WHERE kept)"""


# The two bytes after FF D8 stand where a segment has its length.
_SOI3 = "mk.code = 216 AND mk.off + 3 < files.n AND mk.seg_len >= 65280"


@query(
    "b17_carve",
    "file_id:i, off:i, length:i, width:i, height:i, rank:i",
    "WITH RECURSIVE " + duck.MARKERS + ","
    + _pictures("cand", f"SELECT file_id, mk.off AS start, n FROM mk JOIN files USING (file_id) WHERE {_SOI3} "
                        "AND mk.seg_len BETWEEN 65472 AND 65534")
    + ", big AS (SELECT * FROM cand_ok WHERE stop - start >= 1024),"
    + _greedy("kept", "big")
    + """ --- SELECT file_id, start AS off, stop - start AS length, width, height,
        row_number() OVER (PARTITION BY file_id ORDER BY stop - start DESC, start) AS rank
      FROM (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY start) <= 1000)""",
)
def b17_carve(spark, sf_dir):
    return cv.carve(cv.whole_blobs(fx.files(spark, sf_dir)), key="file_id", min_length=1024, max_count=1000)


EMBEDDED_CTE = (
    MPF_CTE
    + ","
    + _pictures(
        "mpi",
        "SELECT file_id, header + offset_ AS start, header + offset_ + size AS n FROM mpe JOIN files USING (file_id) "
        "WHERE entry >= 1 AND header + offset_ > 0 AND header + offset_ < files.n AND size > 0 "
        "AND header + offset_ + size <= files.n",
    )
    + ","
    + _pictures("soi", f"SELECT file_id, mk.off AS start, n FROM mk JOIN files USING (file_id) WHERE {_SOI3} AND mk.off > 0")
    + ", rest AS (SELECT * FROM soi_ok s WHERE NOT EXISTS (SELECT 1 FROM mpi_ok m WHERE m.file_id = s.file_id AND m.start = s.start)),"
    + _greedy("free", "rest")
    + """,
    emb AS MATERIALIZED (
      SELECT m.file_id, m.start, m.stop, m.width, m.height, 'MPF image ' || (e.entry + 1) AS origin
      FROM mpi_ok m JOIN mpe e ON e.file_id = m.file_id AND e.header + e.offset_ = m.start AND e.entry >= 1
      UNION ALL
      SELECT k.file_id, k.start, k.stop, k.width, k.height,
        CASE WHEN st.image_end <= k.start THEN 'JPEG after the image'
             WHEN s.marker = 225 THEN 'Exif thumbnail'
             WHEN s.marker IS NOT NULL THEN 'preview in APP' || (s.marker - 224) || ' segment' ELSE 'embedded JPEG' END
      FROM free k JOIN status st USING (file_id)
      LEFT JOIN segs s ON s.file_id = k.file_id AND k.start > s.off AND k.start < s.off + s.length)"""
)


@query(
    "b18_embedded",
    "file_id:i, off:i, length:i, width:i, height:i, origin:s",
    duck.WALK + "," + EMBEDDED_CTE + " --- SELECT *, start AS off, stop - start AS length FROM emb",
)
def b18_embedded(spark, sf_dir):
    return cv.embedded(fx.files(spark, sf_dir))
