"""Donor and splice operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from mendframe.functions.lineage import materialize
from mendframe.operators import donors as dn
from mendframe.operators.structure import last_tables_expr, tables, tables_expr
from mendframe.plans import duck
from mendframe.plans.registry import query
from mendframe.plans.structure_queries import TABLES_SQL
from mendframe.sources import fixtures as fx

LAYOUT_CTE = f"""
    first_scan AS (SELECT file_id, sos_off, data_start FROM scan0 WHERE scan_no = 0),
    early_dri AS (SELECT s.file_id, arg_max({duck.num('data_off', 2)}, seg_no) AS ri FROM segs s JOIN files USING (file_id)
        LEFT JOIN first_scan fs ON fs.file_id = s.file_id
        WHERE marker = 221 AND data_length >= 2 AND (fs.sos_off IS NULL OR s.off < fs.sos_off) GROUP BY s.file_id),
    layouts AS MATERIALIZED (
      SELECT f.file_id, coalesce(fr.width, 0) AS width, coalesce(fr.height, 0) AS height, coalesce(fr.components, 0) AS components,
        coalesce(fr.progressive, false) AS progressive, coalesce(d.ri, 0) AS restart_interval,
        CASE WHEN NOT short THEN fs.data_start END AS entropy_start,
        CASE WHEN short THEN 'short_frame_header' WHEN fs.sos_off IS NOT NULL THEN NULL
             WHEN st.image_end IS NOT NULL THEN 'no_scan' ELSE st.problem END AS problem
      FROM (SELECT *, EXISTS (SELECT 1 FROM segs s LEFT JOIN first_scan x ON x.file_id = s.file_id WHERE s.file_id = files.file_id
              AND {duck.is_sof('s.marker')} AND s.data_length < 6 AND (x.sos_off IS NULL OR s.off < x.sos_off)) AS short FROM files) f
      JOIN status st USING (file_id) LEFT JOIN frames fr USING (file_id) LEFT JOIN first_scan fs ON fs.file_id = f.file_id
      LEFT JOIN early_dri d ON d.file_id = f.file_id),
    donor_rows AS MATERIALIZED (SELECT *, CASE WHEN problem IS NOT NULL OR entropy_start IS NULL THEN coalesce(problem, 'no_usable_header')
        WHEN progressive THEN 'progressive' WHEN components <> 3 THEN components || '_components' END AS donor_problem FROM layouts)"""
BOUNDARY_CTE = """
    ends AS (SELECT f.file_id, coalesce(ft.off, sig.e, f.n) AS image_bytes FROM files f
        LEFT JOIN footer ft USING (file_id) LEFT JOIN sig USING (file_id)),
    ill0 AS (SELECT l.file_id, l.entropy_start, l.restart_interval, l.problem, image_bytes, max(mk.off) AS last_ff
      FROM layouts l JOIN ends e ON e.file_id = l.file_id
      LEFT JOIN mk ON mk.file_id = l.file_id AND mk.off <= image_bytes - 2 AND mk.code > 0 AND mk.code <> 217
        AND mk.code NOT BETWEEN 208 AND 215
      GROUP BY ALL),
    ill AS MATERIALIZED (SELECT *, CASE WHEN entropy_start IS NULL OR last_ff >= entropy_start THEN last_ff END AS illegal FROM ill0)"""
SIG_CTE = f"""
    sig AS (SELECT file_id, min(off) + 2 AS e FROM mk JOIN files USING (file_id)
            WHERE code = 217 AND ({duck.h('off + 2', 3)} = 'FFD8FF' OR {duck.h('off + 6', 4)} = '66747970') GROUP BY file_id)"""
LAYOUTS = duck.FRAMES + "," + LAYOUT_CTE
BOUNDARY = duck.FRAMES + "," + duck.FOOTER_CTE + "," + SIG_CTE + "," + LAYOUT_CTE + "," + BOUNDARY_CTE


@query(
    "d1_damage_boundary",
    "file_id:i, illegal:i, boundary:i",
    BOUNDARY + " --- SELECT file_id, illegal, coalesce(illegal + 2, 0) AS boundary FROM ill",
)
def d1_damage_boundary(spark, sf_dir):
    return dn.damage_boundary(fx.files(spark, sf_dir))


@query(
    "d2_splice_points",
    "file_id:i, seq:i, off:i, reason:s, unavailable:s",
    BOUNDARY
    + """, rs AS (SELECT i.file_id, mk.off, row_number() OVER (PARTITION BY i.file_id ORDER BY mk.off) AS rn
           FROM ill i JOIN mk ON mk.file_id = i.file_id AND mk.code BETWEEN 208 AND 215 AND mk.off >= coalesce(i.illegal + 2, 0)),
    near AS (SELECT r.* FROM rs r JOIN ill i USING (file_id) WHERE rn <= 3 AND r.off < image_bytes),
    far AS (SELECT i.file_id, min(mk.off) AS off FROM ill i JOIN mk ON mk.file_id = i.file_id AND mk.code BETWEEN 208 AND 215
              AND mk.off >= 1024 GROUP BY i.file_id),
    c AS (
      SELECT file_id, 0 AS pri, 0 AS off, 'start' AS reason, NULL AS unavailable FROM ill
      UNION ALL SELECT file_id, 10, CASE WHEN entropy_start > 0 THEN entropy_start END, 'own_scan_header',
             CASE WHEN entropy_start IS NULL THEN coalesce(problem, 'no_scan_header') END FROM ill
      UNION ALL SELECT file_id, 20 + rn, off + 2, CASE WHEN rn = 1 THEN 'restart' ELSE 'next_restart' END, NULL FROM near
      UNION ALL SELECT file_id, 20, NULL, 'restart', 'none_past_damage' FROM ill WHERE file_id NOT IN (SELECT file_id FROM near)
      UNION ALL SELECT file_id, 30, illegal + 2, 'past_illegal_pair', CASE WHEN illegal IS NULL THEN 'no_illegal_pair' END FROM ill
      UNION ALL SELECT file_id, 40, far.off + 2, 'restart_after_prefix', NULL FROM far JOIN ill i USING (file_id)
             WHERE 1024 < image_bytes AND far.off < image_bytes
      UNION ALL SELECT file_id, 50, 1024, 'encrypted_prefix', NULL FROM ill WHERE 1024 < image_bytes),
    u AS (SELECT c.* FROM c JOIN files f USING (file_id) WHERE c.off IS NULL OR c.off < f.n
          QUALIFY c.off IS NULL OR row_number() OVER (PARTITION BY c.file_id, c.off ORDER BY pri) = 1)
    --- SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY pri) - 1 AS seq FROM u
        QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY pri) <= 12""",
)
def d2_splice_points(spark, sf_dir):
    return dn.splice_points(fx.files(spark, sf_dir), restart_interval=4, prefix=1024)


@query(
    "d3_donor_problem",
    "file_id:i, width:i, height:i, components:i, restart_interval:i, entropy_start:i, donor_problem:s",
    LAYOUTS + " --- SELECT * FROM donor_rows",
)
def d3_donor_problem(spark, sf_dir):
    return dn.donor_problem(dn.layouts(fx.files(spark, sf_dir)))


@query(
    "d4_rank_donors",
    "file_id:i, donor_id:i, problem:s, decoded:i, anomalies:i, score:d, rank:i",
    f"""WITH t AS (SELECT image_id AS file_id, part_id % 7 AS donor_id, m, anomalies FROM ({fx.mcus_sql()})),
    c AS (SELECT *, min(CASE WHEN anomalies = 32 AND m > 100 THEN m END) OVER (PARTITION BY file_id, donor_id) AS cut,
            CASE WHEN anomalies = 32 AND m <= 100 THEN 1 ELSE anomalies END AS an FROM t),
    g AS (SELECT file_id, donor_id, CASE WHEN donor_id = 3 THEN 'progressive' END AS problem,
            count(*) FILTER (WHERE cut IS NULL OR m < cut) AS decoded,
            count(*) FILTER (WHERE (cut IS NULL OR m < cut) AND an <> 0) AS anomalies FROM c GROUP BY ALL),
    s AS (SELECT *, CASE WHEN problem IS NOT NULL OR decoded = 0 THEN 0 ELSE (1 - anomalies / decoded) * least(1, decoded / 200) END AS score FROM g)
    --- SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY problem IS NOT NULL, round(score, 9) DESC, donor_id) AS rank FROM s""",
)
def d4_rank_donors(spark, sf_dir):
    trials = fx.mcus(spark, sf_dir).select(
        F.col("image_id").alias("file_id"),
        F.expr("part_id % 7").alias("donor_id"),
        "m",
        F.expr("CASE WHEN anomalies = 32 AND m <= 100 THEN 1L ELSE anomalies END").alias("anomalies"),
    )
    donors = trials.select("donor_id").distinct().withColumn(
        "problem", F.expr("CASE WHEN donor_id = 3 THEN 'progressive' END")
    )
    return dn.rank_donors(trials, donors)


_SIBLINGS = (
    LAYOUTS
    + """, fl AS (SELECT f.file_id, f.path, regexp_replace(f.path, '/[^/]*$', '') AS folder, d.donor_problem IS NULL AS usable
           FROM files f JOIN donor_rows d USING (file_id)),
    pr AS (SELECT a.file_id, b.path, b.usable, row_number() OVER (PARTITION BY a.file_id ORDER BY b.path) AS pos
           FROM fl a JOIN fl b ON a.folder = b.folder AND a.path <> b.path AND regexp_matches(lower(b.path), '\\.jpe?g$'))"""
)


@query(
    "d5_suggest_siblings",
    "file_id:i, donor_path:s",
    _SIBLINGS
    + """ --- SELECT file_id, path AS donor_path FROM pr WHERE usable
        QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY pos) = 1""",
)
def d5_suggest_siblings(spark, sf_dir):
    return dn.suggest_siblings(fx.files(spark, sf_dir))


@query(
    "d5_suggest_siblings_tried",
    "file_id:i, donor_path:s, position:i",
    _SIBLINGS
    + """ --- SELECT file_id, path AS donor_path, pos AS position FROM pr WHERE usable AND pos <= 12
        QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY pos) = 1""",
)
def d5_suggest_siblings_tried(spark, sf_dir):
    return dn.suggest_siblings(fx.files(spark, sf_dir), tried=12)


@query(
    "d6_detect_width",
    "image_id:i, width:i, rows:i, cost:d, rank:i",
    f"""WITH mc AS MATERIALIZED (SELECT image_id, m, y AS top, y + cb - cr AS bottom, cr AS inner_, count(*) OVER (PARTITION BY image_id) AS total
          FROM ({fx.mcus_sql()})),
    w AS (SELECT unnest(range(8, 65, 4) || [17]) AS width),
    p AS (SELECT a.image_id, w.width, a.total // w.width AS rows, abs(a.top - b.bottom) AS seam, a.inner_
          FROM w JOIN mc a ON a.m >= w.width AND a.m < w.width * (a.total // w.width) AND a.total // w.width >= 3
          JOIN mc b ON b.image_id = a.image_id AND b.m = a.m - w.width),
    g AS (SELECT image_id, width, max(rows) AS rows, avg(seam) / (avg(inner_) + 1) AS cost FROM p GROUP BY ALL)
    --- SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round(cost, 9), width) AS rank FROM g""",
)
def d6_detect_width(spark, sf_dir):
    mc = fx.mcus(spark, sf_dir)
    total = mc.groupBy("image_id").agg(F.count(F.lit(1)).alias("total"))
    edges = mc.join(total, "image_id").select(
        "image_id", "m", F.col("y").alias("top"), F.expr("y + cb - cr").alias("bottom"), F.col("cr").alias("inner"), "total"
    )
    return dn.detect_width(edges, dn.candidate_widths(8, 64, 4, donor=(16, 17)))


_OVERLAY = (
    duck.FRAMES + "," + TABLES_SQL
    + """, own AS (SELECT * FROM tbl WHERE (file_id + slot) % 2 = 0),
    donor AS (SELECT file_id + 1 AS file_id, kind, slot, bytes FROM tbl)"""
)


@query(
    "d7_overlay_tables",
    "file_id:i, kind:s, slot:i, bytes:s, kept_own:b, label:s",
    _OVERLAY
    + """ --- SELECT file_id, kind, slot, coalesce(o.bytes, d.bytes) AS bytes, o.bytes IS NOT NULL AS kept_own,
        CASE WHEN kind = 'DQT' THEN 'DQT ' || slot ELSE 'DHT ' || CASE WHEN slot >= 16 THEN 'AC' ELSE 'DC' END || (slot % 16) END AS label
      FROM own o FULL JOIN donor d USING (file_id, kind, slot)""",
)
def d7_overlay_tables(spark, sf_dir):
    t = tables(fx.files(spark, sf_dir))
    # Every other slot counts as lost; the donor is the file before.
    own = t.where("(file_id + slot) % 2 = 0")
    donor = t.withColumn("file_id", F.col("file_id") + 1)
    out = dn.overlay_tables(own, donor)
    return out.withColumn("label", F.expr(dn.table_label())).withColumn("bytes", F.hex("bytes"))


@query(
    "d8_drop_identity",
    "file_id:i, seg_no:i, marker:i, off:i, length:i",
    duck.WALK
    + f""" --- SELECT s.* FROM segs s JOIN files f USING (file_id) WHERE marker <> 254 AND (marker NOT BETWEEN 224 AND 239
        OR (marker = 224 AND {duck.h('data_off', 5)} IN ('4A46494600', '4A46585800'))
        OR (marker = 226 AND {duck.h('data_off', 12)} = '4943435F50524F46494C4500')
        OR (marker = 238 AND {duck.h('data_off', 5)} = '41646F6265'))""",
)
def d8_drop_identity(spark, sf_dir):
    return dn.drop_identity(fx.files(spark, sf_dir))


_LIMIT = "CASE WHEN file_id % 4 = 0 THEN 100 ELSE 100000 END"


@query(
    "d9_own_exif",
    "file_id:i, off:i, sha:s",
    "WITH " + duck.MARKERS
    + f""", x AS (SELECT mk.file_id, mk.off, mk.seg_len, f.hx, least(f.n, {_LIMIT.replace('file_id', 'f.file_id')}) AS lim
           FROM mk JOIN files f USING (file_id) WHERE code = 225)
    --- SELECT file_id, off, sha256(unhex(substr(hx, 2 * off + 1, 2 * (2 + seg_len)))) AS sha FROM x
      WHERE off + 12 < lim AND seg_len >= 14 AND off + 2 + seg_len <= lim AND {duck.h('off + 4', 6)} = '457869660000'
        AND {duck.h('off + 10', 4)} IN ('49492A00', '4D4D002A') QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY off) = 1""",
)
def d9_own_exif(spark, sf_dir):
    return dn.own_exif(fx.files(spark, sf_dir), F.expr(_LIMIT)).withColumn("sha", F.sha2("segment", 256))


def _seg_hex(code, body):
    return f"CASE WHEN {body} <> '' THEN 'FF{code}' || lpad(hex(CAST(length({body}) // 2 + 2 AS BIGINT)), 4, '0') || {body} ELSE '' END"


_IDENT = f"""(marker = 254 OR (marker BETWEEN 224 AND 239
        AND NOT (marker = 224 AND {duck.h('data_off', 5)} IN ('4A46494600', '4A46585800'))
        AND NOT (marker = 226 AND {duck.h('data_off', 12)} = '4943435F50524F46494C4500')
        AND NOT (marker = 238 AND {duck.h('data_off', 5)} = '41646F6265')))"""


@query(
    "d10_splice",
    "file_id:i, donor_id:i, offset:i, header_size:i, carried_exif:b, kept_own:s, sha:s",
    BOUNDARY + "," + TABLES_SQL
    + f""", pt AS (SELECT i.file_id, d.file_id AS donor_id, coalesce(i.illegal + 2, i.entropy_start, 0) AS offset_
           FROM ill i JOIN donor_rows d ON d.file_id = i.file_id - 1 AND d.donor_problem IS NULL),
    ps AS (SELECT p.*, f.hx, f.n, coalesce(ft.off, f.n) AS fend FROM pt p JOIN files f USING (file_id) LEFT JOIN footer ft USING (file_id)
           WHERE offset_ >= 0 AND offset_ < coalesce(ft.off, f.n)),
    hdr AS (SELECT s.*, f.hx FROM segs s JOIN files f USING (file_id) LEFT JOIN first_scan fs USING (file_id)
            WHERE fs.sos_off IS NULL OR s.off <= fs.sos_off),
    pieces AS (SELECT file_id, seg_no, off, length, marker, {_IDENT} AS ident, substr(hx, 2 * off + 1, 2 * length) AS b,
            CASE WHEN {duck.is_sof('marker')} THEN (SELECT list(substr(hx, 2 * (data_off + 6 + 3 * i) + 1, 2)) FROM range({duck.num('data_off + 5')}) r(i))
                 WHEN marker = 218 THEN (SELECT list(substr(hx, 2 * (data_off + 1 + 2 * i) + 1, 2)) FROM range({duck.num('data_off')}) r(i)) END AS ids FROM hdr),
    parts AS (SELECT p.file_id AS pf, side, list(b ORDER BY seg_no) FILTER (marker BETWEEN 224 AND 239 AND NOT ident) AS apps,
            arg_min(b, seg_no) FILTER ({duck.is_sof('marker')}) AS sof, arg_min(ids, seg_no) FILTER ({duck.is_sof('marker')}) AS sof_ids,
            arg_min(b, seg_no) FILTER (marker = 218) AS sos, arg_min(ids, seg_no) FILTER (marker = 218) AS sos_ids,
            arg_max(b, seg_no) FILTER (marker = 221) AS dri
          FROM (SELECT ps.file_id, 'donor' AS side, x.seg_no, x.marker, x.ident, x.b, x.ids FROM ps JOIN pieces x ON x.file_id = ps.donor_id
                UNION ALL SELECT ps.file_id, 'own', x.seg_no, x.marker, x.ident, x.b, x.ids FROM ps JOIN pieces x ON x.file_id = ps.file_id AND x.off + x.length <= ps.offset_) p
          GROUP BY ALL),
    tb2 AS (SELECT file_id, seg_no, CASE WHEN marker = 219 THEN 'DQT' ELSE 'DHT' END AS kind, data_off + data_length AS seg_end, i,
             CASE WHEN marker = 219 THEN id % 16 ELSE id END AS slot,
             substr(hx, 2 * CAST(data_off + i - size AS BIGINT) + 1, 2 * CAST(size AS BIGINT)) AS bytes
           FROM tb WHERE ok AND id IS NOT NULL),
    ts AS (SELECT ps.file_id, 'donor' AS side, kind, slot, arg_max(bytes, t.seg_no * 100000 + i) AS bytes FROM ps JOIN tb2 t ON t.file_id = ps.donor_id
             JOIN segs s ON s.file_id = t.file_id AND s.seg_no = t.seg_no JOIN first_scan fs ON fs.file_id = t.file_id AND s.off < fs.sos_off GROUP BY ALL
           UNION ALL SELECT ps.file_id, 'own', kind, slot, arg_max(bytes, t.seg_no * 100000 + i) FROM ps JOIN tb2 t ON t.file_id = ps.file_id AND t.seg_end <= ps.offset_
             JOIN segs s ON s.file_id = t.file_id AND s.seg_no = t.seg_no LEFT JOIN first_scan fs ON fs.file_id = t.file_id
             WHERE fs.sos_off IS NULL OR s.off < fs.sos_off GROUP BY ALL),
    tm AS (SELECT file_id, kind, slot, coalesce(max(bytes) FILTER (side = 'own'), max(bytes)) AS bytes, bool_or(side = 'own') AS mine FROM ts GROUP BY ALL),
    tj AS (SELECT file_id, coalesce(string_agg(bytes, '' ORDER BY slot) FILTER (kind = 'DQT'), '') AS q, coalesce(string_agg(bytes, '' ORDER BY slot) FILTER (kind = 'DHT'), '') AS h,
             list(CASE WHEN kind = 'DQT' THEN 'DQT ' || slot ELSE 'DHT ' || CASE WHEN slot >= 16 THEN 'AC' ELSE 'DC' END || (slot % 16) END) FILTER (mine) AS kept
           FROM tm GROUP BY ALL),
    exf AS (SELECT ps.file_id, arg_min(substr(ps.hx, 2 * m.off + 1, 2 * (2 + m.seg_len)), m.off) AS exif FROM ps JOIN mk m ON m.file_id = ps.file_id
            WHERE m.code = 225 AND m.off + 12 < offset_ AND m.seg_len >= 14 AND m.off + 2 + m.seg_len <= offset_
              AND substr(ps.hx, 2 * (m.off + 4) + 1, 12) = '457869660000' AND substr(ps.hx, 2 * (m.off + 10) + 1, 8) IN ('49492A00', '4D4D002A') GROUP BY ALL),
    al AS (SELECT ps.*, o.dri AS odri, coalesce(o.sof IS NOT NULL AND o.sos IS NOT NULL AND len(o.sof_ids) = 3 AND len(list_filter(o.sos_ids, lambda z: NOT list_contains(o.sof_ids, z))) = 0, false) AS pair,
             o.sof AS osof, o.sos AS osos, d.sof AS dsof, d.sos AS dsos, d.dri AS ddri, d.apps, tj.q, tj.h, tj.kept, coalesce(e.exif, '') AS exif
           FROM ps JOIN parts d ON d.pf = ps.file_id AND d.side = 'donor' LEFT JOIN parts o ON o.pf = ps.file_id AND o.side = 'own'
           LEFT JOIN tj ON tj.file_id = ps.file_id LEFT JOIN exf e ON e.file_id = ps.file_id),
    hd AS (SELECT *, 'FFD8' || exif || coalesce(array_to_string(apps, ''), '') || {_seg_hex('DB', 'q')} || CASE WHEN pair THEN osof ELSE dsof END ||
             {_seg_hex('C4', 'h')} || coalesce(odri, ddri, '') || CASE WHEN pair THEN osos ELSE dsos END AS header,
             substr(hx, 2 * offset_ + 1, 2 * (fend - offset_)) AS raw FROM al),
    rn AS (SELECT hd.file_id, m.off - offset_ AS o, m.code - 208 AS c, first_value(m.code - 208) OVER (PARTITION BY hd.file_id ORDER BY m.off) AS c0
           FROM hd JOIN mk m ON m.file_id = hd.file_id AND m.code BETWEEN 208 AND 215 AND m.off >= offset_ AND m.off + 1 < fend),
    rp AS (SELECT file_id, list(struct_pack(o := o, c := (c - c0 + 8) % 8) ORDER BY o) AS fix FROM rn GROUP BY file_id),
    dt AS (SELECT hd.*, coalesce(list_reduce(list_prepend(raw, list_transform(fix, lambda f: lpad(CAST(f.o AS VARCHAR), 9, '0') || f.c)),
             lambda b, f: substr(b, 1, 2 * CAST(substr(f, 1, 9) AS BIGINT) + 2) || 'D' || substr(f, 10, 1) || substr(b, 2 * CAST(substr(f, 1, 9) AS BIGINT) + 5)), raw) AS dat
           FROM hd LEFT JOIN rp USING (file_id))
    --- SELECT file_id, donor_id, offset_ AS "offset", length(header) // 2 AS header_size, exif <> '' AS carried_exif,
        array_to_string(list_sort(list_concat(coalesce(kept, []), CASE WHEN pair THEN ['SOF', 'SOS'] ELSE [] END, CASE WHEN odri IS NOT NULL THEN ['DRI'] ELSE [] END)), ',') AS kept_own,
        sha256(unhex(header || dat || CASE WHEN dat LIKE '%FFD9' THEN '' ELSE 'FFD9' END)) AS sha FROM dt""",
)
def d10_splice(spark, sf_dir):
    files = fx.files(spark, sf_dir)
    headers = dn.donor_headers(files)
    points = dn.with_boundary(files).select(
        "file_id",
        F.expr("file_id - 1").alias("donor_id"),
        F.expr("cast(coalesce(illegal + 2, layout.entropy_start, 0) as bigint)").alias("offset"),
    )
    out = dn.splice(files, headers, points)
    return out.withColumn("kept_own", F.array_join("kept_own", ",")).withColumn("sha", F.sha2("content", 256))


@query(
    "d11_table_donors",
    "file_id:i, donor_id:i, matches:i, rank:i",
    LAYOUTS + "," + TABLES_SQL
    + """, pairs AS (SELECT o.file_id, d.file_id AS donor_id, count(*) AS matches FROM tbl o
           JOIN tbl d ON d.kind = o.kind AND d.slot = o.slot AND d.bytes = o.bytes
           JOIN donor_rows r ON r.file_id = d.file_id AND r.donor_problem IS NULL GROUP BY ALL)
    --- SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY matches DESC, donor_id) AS rank FROM pairs
        QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY matches DESC, donor_id) <= 5""",
)
def d11_table_donors(spark, sf_dir):
    # One pass over the bytes; the tables of a file are a few hundred bytes.
    rows = dn.with_layout(fx.files(spark, sf_dir)).select(
        "file_id", "layout.*", F.expr(tables_expr("walk.segs")).alias("ts")
    )
    own = materialize(
        dn.donor_problem(rows)
        .select("file_id", "donor_problem", F.explode(F.expr(last_tables_expr("ts"))).alias("t"))
        .select("file_id", "donor_problem", "t.*")
    )
    donor = own.where("donor_problem IS NULL").select(F.col("file_id").alias("donor_id"), "kind", "slot", "bytes")
    return dn.table_donors(own, donor)
