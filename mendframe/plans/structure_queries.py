"""Marker and structure operators over the JPEG files derived from `documents`."""

from __future__ import annotations

from pyspark.sql import functions as F

from mendframe.operators import structure as op
from mendframe.operators.markers import marker_scan
from mendframe.plans import duck
from mendframe.plans.registry import query
from mendframe.sources import fixtures as fx


@query(
    "b1_marker_scan",
    "file_id:i, off:i, code:i, seg_len:i",
    f"WITH {duck.MARKERS} --- SELECT * FROM mk WHERE code >= 0",
)
def b1_marker_scan(spark, sf_dir):
    return marker_scan(fx.files(spark, sf_dir))


@query(
    "b1_marker_scan_pages",
    "page_id:i, off:i, code:i",
    f"""WITH src AS (SELECT page_id, hex(html) || 'FFD8FF' || hex(url) || 'FF' AS hx FROM pages),
    {duck.markers_cte('src', 'page_id')} --- SELECT * FROM mk WHERE code >= 0""",
)
def b1_marker_scan_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        "page_id",
        F.expr("concat(encode(html, 'UTF-8'), X'FFD8FF', encode(url, 'UTF-8'), X'FF')").alias("content"),
    )
    return marker_scan(pages, key="page_id")


@query(
    "b2_segment_walk",
    "file_id:i, seg_no:i, marker:i, off:i, length:i, data_off:i, data_length:i",
    duck.WALK + " --- SELECT * FROM segs",
)
def b2_segment_walk(spark, sf_dir):
    return op.segment_walk(fx.files(spark, sf_dir))


@query(
    "b2_walk_status",
    "file_id:i, segments:i, image_end:i, problem:s, problem_at:i",
    duck.WALK + " --- SELECT * FROM status",
)
def b2_walk_status(spark, sf_dir):
    return op.walk_status(fx.files(spark, sf_dir))


_SCANS = duck.WALK + f""",
    sc1 AS (SELECT *, CASE WHEN plen >= 1 THEN {duck.num('sos_off + 4')} ELSE 0 END AS n_raw FROM scan_rows),
    sc2 AS (SELECT *, least(n_raw, 4) AS n_comp, 1 + 2 * n_raw + 2 < plen AS has_tail,
              list_transform(range(least(n_raw, 4)), lambda i: CASE WHEN 1 + 2 * i < plen
                 THEN TRY_CAST('0x' || substr(hx, 2 * (sos_off + 5 + 2 * i) + 1, 2) AS BIGINT) ELSE 0 END) AS ids,
              {duck.num('sos_off + 5 + 2 * n_raw')} AS t0, {duck.num('sos_off + 6 + 2 * n_raw')} AS t1,
              {duck.num('sos_off + 7 + 2 * n_raw')} AS t2 FROM sc1),
    sc3 AS (SELECT *, array_to_string(ids, ',') AS component_ids, CASE WHEN has_tail THEN t0 ELSE 0 END AS ss,
              CASE WHEN has_tail THEN t1 ELSE 63 END AS se, CASE WHEN has_tail THEN t2 // 16 ELSE 0 END AS ah,
              CASE WHEN has_tail THEN t2 % 16 ELSE 0 END AS al FROM sc2)"""


@query(
    "b3_scans",
    "file_id:i, scan_no:i, sos_off:i, data_start:i, data_end:i, n_comp:i, component_ids:s, ss:i, se:i, "
    "ah:i, al:i, restart_markers:i, first_illegal:i",
    _SCANS + " --- SELECT * FROM sc3",
)
def b3_scans(spark, sf_dir):
    rows = op.scans(fx.files(spark, sf_dir))
    return rows.withColumn("component_ids", F.expr("array_join(component_ids, ',')"))


@query(
    "b4_describe_scan",
    "file_id:i, scan_no:i, description:s",
    _SCANS
    + """ --- SELECT file_id, scan_no,
      CASE WHEN ss = 0 AND se = 63 THEN 'full' WHEN ss = 0 THEN 'DC' ELSE 'AC ' || ss || '-' || se END || ', ' ||
      CASE WHEN n_comp >= 3 THEN 'all components' ELSE array_to_string(list_transform(ids, lambda c:
        CASE c WHEN 1 THEN 'Y' WHEN 2 THEN 'Cb' WHEN 3 THEN 'Cr' ELSE '#' || c END), ', ') END ||
      CASE WHEN ah > 0 THEN ', refining bit ' || al WHEN al > 0 THEN ', first pass at bit ' || al ELSE '' END
      AS description FROM sc3""",
)
def b4_describe_scan(spark, sf_dir):
    return op.describe_scan(op.scans(fx.files(spark, sf_dir)))


@query(
    "b5_frame_info",
    "file_id:i, frame_marker:i, width:i, height:i, components:i, mcu_w:i, mcu_h:i, mcus_x:i, mcus_y:i, "
    "restart_interval:i, progressive:b, scan_count:i, readable:b",
    duck.FRAMES + " --- SELECT * FROM frames",
)
def b5_frame_info(spark, sf_dir):
    return op.frame_info(fx.files(spark, sf_dir))


_SAMPLING = """CASE WHEN components = 1 THEN 'grayscale' WHEN components <> 3 THEN components || ' components'
      WHEN h_samp[2:3] <> [1, 1] OR v_samp[2:3] <> [1, 1] THEN
        h_samp[1] || 'x' || v_samp[1] || ', ' || h_samp[2] || 'x' || v_samp[2] || ', ' || h_samp[3] || 'x' || v_samp[3]
      ELSE CASE h_samp[1] || 'x' || v_samp[1] WHEN '1x1' THEN '4:4:4' WHEN '2x1' THEN '4:2:2' WHEN '2x2' THEN '4:2:0'
        WHEN '1x2' THEN '4:4:0' WHEN '4x1' THEN '4:1:1' ELSE h_samp[1] || 'x' || v_samp[1] END END"""


@query(
    "b6_sampling_name",
    "file_id:i, sampling:s",
    duck.FRAMES + f" --- SELECT file_id, {_SAMPLING} AS sampling FROM frames",
)
def b6_sampling_name(spark, sf_dir):
    return op.sampling_name(op.frame_info(fx.files(spark, sf_dir)))


@query(
    "b7_unit_name",
    "file_id:i, unit:i, unit_name:s",
    duck.FRAMES
    + """, per AS (SELECT s.file_id, s.c, s.hs * s.vs AS k, f.components,
        sum(s.hs * s.vs) OVER (PARTITION BY s.file_id ORDER BY s.c) - s.hs * s.vs AS base
      FROM samp s JOIN frames f USING (file_id) WHERE f.components BETWEEN 1 AND 4)
    --- SELECT file_id, base + i AS unit,
        (CASE WHEN c = 0 THEN 'Y' WHEN components <> 3 THEN 'C' WHEN c = 1 THEN 'Cb' ELSE 'Cr' END)
        || CASE WHEN k > 1 THEN CAST(i + 1 AS VARCHAR) ELSE '' END AS unit_name
      FROM (SELECT *, unnest(range(k)) AS i FROM per)""",
)
def b7_unit_name(spark, sf_dir):
    return op.unit_name(op.frame_info(fx.files(spark, sf_dir)))


@query(
    "b8_find_segment",
    "file_id:i, off:i, length:i, data_off:i, data_length:i",
    duck.WALK
    + f""" --- SELECT s.* FROM segs s JOIN files f USING (file_id)
      WHERE marker = 226 AND data_length >= 4 AND {duck.h('data_off', 4)} = '4D504600'
      QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY seg_no) = 1""",
)
def b8_find_segment(spark, sf_dir):
    return op.find_segment(fx.files(spark, sf_dir), 0xE2, b"MPF\0")


TABLES_SQL = f"""
    tb0 AS (SELECT file_id, seg_no, marker, data_off, data_length, hx FROM segs JOIN files USING (file_id)
            WHERE marker IN (196, 219)),
    tb AS (
      SELECT file_id, seg_no, marker, data_off, data_length, hx, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS id,
             CAST(0 AS BIGINT) AS size, true AS ok FROM tb0
      UNION ALL
      SELECT file_id, seg_no, marker, data_off, data_length, hx, i + size, id, size,
             CASE WHEN marker = 219 THEN id % 16 <= 3 ELSE id % 16 <= 3 AND id < 32 AND size - 17 <= 256 END
             AND i + size <= data_length
      FROM (
        SELECT file_id, seg_no, marker, data_off, data_length, hx, i, {duck.num('data_off + i')} AS id,
          CASE WHEN marker = 219 THEN 1 + CASE WHEN {duck.num('data_off + i')} >= 16 THEN 128 ELSE 64 END
               ELSE 17 + list_sum([{', '.join(duck.num(f'data_off + i + {l}') for l in range(1, 17))}]) END AS size
        FROM tb WHERE ok AND i < data_length AND (marker = 219 OR i + 17 <= data_length))),
    tbl AS MATERIALIZED (
      SELECT file_id, CASE WHEN marker = 219 THEN 'DQT' ELSE 'DHT' END AS kind,
             CASE WHEN marker = 219 THEN id % 16 ELSE id END AS slot,
             substr(hx, 2 * CAST(data_off + i - size AS BIGINT) + 1, 2 * CAST(size AS BIGINT)) AS bytes
      FROM tb WHERE ok AND id IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY file_id, marker, slot ORDER BY seg_no DESC, i DESC) = 1)"""


@query(
    "b9_tables",
    "file_id:i, kind:s, slot:i, bytes:s",
    duck.WALK + ", " + TABLES_SQL + " --- SELECT * FROM tbl",
)
def b9_tables(spark, sf_dir):
    return op.tables(fx.files(spark, sf_dir)).withColumn("bytes", F.hex("bytes"))


@query(
    "b25_restart_audit",
    "file_id:i, restarts:i, out_of_order:i, missing:i",
    duck.FRAMES
    + """, rst AS (SELECT s.file_id, mk.off, mk.code - 208 AS num,
          lag(mk.code - 208, 1, -1) OVER (PARTITION BY s.file_id ORDER BY mk.off) AS prev
        FROM scan0 s JOIN mk ON mk.file_id = s.file_id AND mk.off >= s.data_start AND mk.off < s.data_end
        WHERE s.scan_no = 0 AND mk.code BETWEEN 208 AND 215)
    --- SELECT s.file_id, count(r.off) AS restarts,
          count(*) FILTER (WHERE (num - prev + 8) % 8 <> 1) AS out_of_order,
          coalesce(sum((num - prev + 7) % 8), 0) AS missing
        FROM scan0 s JOIN dri d ON d.file_id = s.file_id AND d.restart_interval > 0
        LEFT JOIN rst r ON r.file_id = s.file_id WHERE s.scan_no = 0 GROUP BY s.file_id""",
)
def b25_restart_audit(spark, sf_dir):
    return op.restart_audit(fx.files(spark, sf_dir))


@query(
    "b26_renumber_restarts",
    "file_id:i, off:i, old:i, new:i",
    duck.WALK
    + """ --- SELECT s.file_id, mk.off, mk.code - 208 AS old,
          (mk.code - first_value(mk.code) OVER (PARTITION BY s.file_id ORDER BY mk.off) + 8) % 8 AS new
        FROM scan0 s JOIN mk ON mk.file_id = s.file_id AND mk.off >= s.data_start
        WHERE s.scan_no = 0 AND mk.code BETWEEN 208 AND 215""",
)
def b26_renumber_restarts(spark, sf_dir):
    return op.renumber_restarts(fx.files(spark, sf_dir))


@query(
    "b26_renumbered_content",
    "file_id:i, sha:s",
    duck.WALK
    + """, mv AS (SELECT s.file_id, mk.off + 1 AS pos, 208 + (mk.code - first_value(mk.code) OVER (PARTITION BY s.file_id ORDER BY mk.off) + 8) % 8 AS new
        FROM scan0 s JOIN mk ON mk.file_id = s.file_id AND mk.off >= s.data_start WHERE s.scan_no = 0 AND mk.code BETWEEN 208 AND 215),
      bt AS (SELECT f.file_id, f.hx, unnest(range(f.n)) AS i FROM files f JOIN scan0 s ON s.file_id = f.file_id AND s.scan_no = 0)
    --- SELECT b.file_id, sha256(unhex(string_agg(coalesce(hex(mv.new), substr(b.hx, 2 * b.i + 1, 2)), '' ORDER BY b.i))) AS sha
        FROM bt b LEFT JOIN mv ON mv.file_id = b.file_id AND mv.pos = b.i GROUP BY b.file_id""",
)
def b26_renumbered_content(spark, sf_dir):
    return op.renumbered_content(fx.files(spark, sf_dir)).withColumn("sha", F.sha2("content", 256))


_NAME = """CASE WHEN marker = 216 THEN 'SOI' WHEN marker = 217 THEN 'EOI' WHEN marker = 218 THEN 'SOS'
      WHEN marker = 219 THEN 'DQT' WHEN marker = 196 THEN 'DHT' WHEN marker = 221 THEN 'DRI' WHEN marker = 254 THEN 'COM'
      WHEN marker = 192 THEN 'SOF0 (baseline)' WHEN marker = 193 THEN 'SOF1 (extended)'
      WHEN marker = 194 THEN 'SOF2 (progressive)' WHEN marker BETWEEN 224 AND 239 THEN 'APP' || (marker - 224)
      WHEN marker BETWEEN 208 AND 215 THEN 'RST' || (marker - 208)
      WHEN marker BETWEEN 192 AND 207 THEN 'SOF' || (marker - 192) ELSE 'FF' || lpad(hex(marker), 2, '0') END"""


@query(
    "b27_segment_inventory",
    "file_id:i, seg_no:i, name:s, off:i, length:i, signature:s",
    duck.WALK
    + f""" --- SELECT file_id, seg_no, {_NAME} AS name, off, length,
          CASE WHEN marker BETWEEN 224 AND 239 THEN trim(array_to_string(list_transform(range(least(data_length, 12)),
            lambda i: CASE WHEN substr(hx, 2 * (data_off + i) + 1, 2) = '00' THEN ' '
              ELSE chr(CAST('0x' || substr(hx, 2 * (data_off + i) + 1, 2) AS INT)) END), '')) ELSE '' END AS signature
        FROM segs JOIN files USING (file_id)""",
)
def b27_segment_inventory(spark, sf_dir):
    return op.segment_inventory(fx.files(spark, sf_dir))
