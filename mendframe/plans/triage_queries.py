"""Salvage, trailers and triage over the JPEG files derived from `documents`."""

from __future__ import annotations

from pyspark.sql import functions as F

from mendframe.operators import salvage as sal
from mendframe.operators import trailer as tr
from mendframe.operators import triage as tg
from mendframe.plans import duck
from mendframe.plans.registry import query
from mendframe.sources import fixtures as fx


def _sha(df, col="content"):
    return df.withColumn("sha", F.sha2(col, 256))


@query(
    "b10_salvage_truncate",
    "file_id:i, damage_at:i, dropped_bytes:i, scan_start:i, trailer_at:i, sha:s",
    duck.SALVAGE
    + """ --- SELECT f.file_id, cut AS damage_at, coalesce(f.n - cut, 0) AS dropped_bytes, scan_start,
      CASE WHEN clean_end < f.n THEN clean_end END AS trailer_at,
      sha256(unhex(CASE WHEN cut IS NOT NULL THEN substr(f.hx, 1, 2 * cut) || 'FFD9'
        WHEN clean_end IS NOT NULL THEN substr(f.hx, 1, 2 * clean_end) ELSE f.hx END)) AS sha
      FROM files f LEFT JOIN salvage s USING (file_id)""",
)
def b10_salvage_truncate(spark, sf_dir):
    return _sha(sal.salvage_truncate(fx.files(spark, sf_dir)))


@query(
    "b11_salvage_read_through",
    "file_id:i, damage_at:i, defused:i, sha:s",
    duck.SALVAGE
    + """, t AS (SELECT *, regexp_replace(substr(hx, 2 * cut + 1), '(..)', '\\1 ', 'g') AS tail,
           CASE WHEN restart_interval > 0 THEN 'FF (0[1-9A-F]|[1-9A-C][0-9A-F]|D[89A-F]|[EF][0-9A-F]) '
                ELSE 'FF (0[1-9A-F]|[1-9A-F][0-9A-F]) ' END AS pair
         FROM salvage WHERE cut IS NOT NULL)
    --- SELECT file_id, cut AS damage_at, len(regexp_extract_all(tail, pair)) AS defused,
        sha256(unhex(substr(substr(hx, 1, 2 * cut) || replace(regexp_replace(tail, pair, 'FF 00 ', 'g'), ' ', ''),
                            1, length(hx) - 4) || 'FFD9')) AS sha
      FROM t""",
)
def b11_salvage_read_through(spark, sf_dir):
    return _sha(sal.salvage_read_through(fx.files(spark, sf_dir)))


@query(
    "b12_loss_report",
    "file_id:i, at:i, damaged:i, lost_fraction:d, loss_class:s",
    duck.SALVAGE
    + """ --- SELECT file_id, cut AS "at", n - cut AS damaged,
        CASE WHEN scan_start IS NULL OR n - scan_start <= 0 THEN 0 ELSE (n - cut) / (n - scan_start) END AS lost_fraction,
        CASE WHEN n = cut THEN 'missing_eoi' ELSE 'data_lost' END AS loss_class
      FROM salvage WHERE cut IS NOT NULL""",
)
def b12_loss_report(spark, sf_dir):
    return sal.loss_report(fx.files(spark, sf_dir))


@query(
    "b13_ransom_footer",
    "file_id:i, off:i, length:i, personal_id:s, offline:b",
    "WITH " + duck.MARKERS + "," + duck.FOOTER_CTE
    + " --- SELECT file_id, off, n - off AS length, personal_id, offline FROM footer JOIN files USING (file_id)",
)
def b13_ransom_footer(spark, sf_dir):
    return tr.ransom_footer(fx.files(spark, sf_dir))


@query(
    "b14_trailer",
    "file_id:i, kind:s, off:i, length:i, keep_on_export:b",
    duck.TRAILER + " --- SELECT file_id, kind, off, n - off AS length, kind <> 'stop_djvu' AS keep_on_export FROM trailer",
)
def b14_trailer(spark, sf_dir):
    return tr.trailer(fx.files(spark, sf_dir))


MPF_CTE = f"""
    mp0 AS (SELECT s.file_id, f.hx, data_off + 4 AS header, data_off + data_length AS pend, {duck.h('data_off + 4', 2)} = '4949' AS little
            FROM segs s JOIN files f USING (file_id) WHERE marker = 226 AND data_length >= 4 AND {duck.h('data_off', 4)} = '4D504600'
            QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY seg_no) = 1),
    mp1 AS (SELECT *, header + {duck.either('header + 4', 4)} AS ifd FROM mp0),
    mp2 AS (SELECT *, unnest(range({duck.either('ifd', 2)})) AS i FROM mp1),
    mp3 AS (SELECT *, {duck.either('ifd + 2 + 12 * i + 4', 4)} AS bytes, header + {duck.either('ifd + 2 + 12 * i + 8', 4)} AS entries
            FROM mp2 WHERE ifd + 14 + 12 * i <= pend AND {duck.either('ifd + 2 + 12 * i', 2)} = 45058),
    mp AS (SELECT file_id, hx, header, little, entries, unnest(range(bytes // 16)) AS entry FROM mp3
           WHERE bytes % 16 = 0 AND entries + bytes <= pend),
    mpe AS MATERIALIZED (SELECT file_id, entry, header, little, {duck.either('entries + 16 * entry + 4', 4)} AS size,
           {duck.either('entries + 16 * entry + 8', 4)} AS offset_ FROM mp)"""


@query(
    "b15_mpf_entries",
    "file_id:i, entry:i, header:i, little:b, size:i, offset:i",
    duck.WALK + "," + MPF_CTE + " --- SELECT *, offset_ AS \"offset\" FROM mpe",
)
def b15_mpf_entries(spark, sf_dir):
    return tr.mpf_entries(fx.files(spark, sf_dir))


@query(
    "b16_mpf_rebase",
    "file_id:i, entry:i, size:i, offset:i, valid:b",
    duck.TRAILER + "," + MPF_CTE
    + """, ns AS (SELECT t.file_id, t.off AS old_trailer, t.off - 40 AS new_trailer,
          CASE WHEN t.file_id % 3 = 0 THEN 3 ELSE 2 END AS new_count FROM trailer t),
    r AS (SELECT file_id, entry, CASE WHEN entry = 0 OR offset_ = 0 THEN new_trailer ELSE size END AS size,
          CASE WHEN entry = 0 OR offset_ = 0 THEN offset_ ELSE offset_ - old_trailer + new_trailer + 18 END AS offset_,
          entry = 0 OR offset_ = 0 OR offset_ - old_trailer + new_trailer + 18 BETWEEN 1 AND 4294967295 AS ok, new_count
        FROM mpe JOIN ns USING (file_id))
    --- SELECT file_id, entry, size, offset_ AS "offset",
        bool_and(ok) OVER (PARTITION BY file_id) AND count(*) OVER (PARTITION BY file_id) = new_count AS valid FROM r""",
)
def b16_mpf_rebase(spark, sf_dir):
    files = fx.files(spark, sf_dir)
    entries = tr.mpf_entries(files)
    # The main picture shrinks by 40 bytes and its MP segment moves 18 bytes forward.
    sizes = tr.with_mp_index(tr.with_trailer(files)).where("mp IS NOT NULL AND trailer IS NOT NULL").select(
        "file_id",
        F.expr("mp.header - 18").alias("new_header"),
        F.expr("CASE WHEN file_id % 3 = 0 THEN 3 ELSE 2 END").alias("new_count"),
        F.expr("trailer.off").alias("old_trailer"),
        F.expr("trailer.off - 40").alias("new_trailer"),
    )
    return tr.mpf_rebase(entries, sizes)


_TRIAGE_ROWS = """,
    maps AS (SELECT image_id AS file_id, count(*) AS map_mcus, count(*) FILTER (WHERE anomalies = 32) AS truncated,
               count(*) FILTER (WHERE anomalies NOT IN (0, 32)) AS decode_errors,
               min(m) FILTER (WHERE anomalies NOT IN (0, 32)) AS first_error
             FROM (SELECT * FROM mc WHERE {where}) GROUP BY image_id),
    tg AS (SELECT f.file_id, f.path, f.n AS size, ft.file_id IS NOT NULL AS is_foot, ft.personal_id, ft.offline, st.problem, st.problem_at,
             fr.width, fr.height, fr.mcus_x * fr.mcus_y AS grid, t.kind, t.n - t.off AS t_len, s.cut, m.map_mcus,
             coalesce(m.truncated, 0) AS truncated, coalesce(m.decode_errors, 0) AS decode_errors, m.first_error,
             coalesce(fr.readable AND (SELECT min(data_start) FROM scan0 c WHERE c.file_id = f.file_id) <= coalesce(t.off, f.n), false) AS rd,
             f.hx LIKE 'FFD8%' OR EXISTS (SELECT 1 FROM mk WHERE mk.file_id = f.file_id AND mk.code IN (196, 218)) AS any_mk
           FROM files f JOIN status st USING (file_id) LEFT JOIN footer ft ON ft.file_id = f.file_id
           LEFT JOIN frames fr ON fr.file_id = f.file_id LEFT JOIN trailer t ON t.file_id = f.file_id
           LEFT JOIN salvage s ON s.file_id = f.file_id LEFT JOIN maps m ON m.file_id = f.file_id),
    tg1 AS (SELECT *, CASE WHEN is_foot THEN 'ransomware-encrypted header'
        WHEN NOT rd THEN CASE WHEN problem IS NULL OR any_mk THEN 'header damaged' ELSE 'not a JPEG' END
        WHEN decode_errors > 0 THEN 'decode errors' WHEN truncated > 0 OR cut IS NOT NULL THEN 'truncated'
        WHEN kind <> 'unknown' THEN 'healthy, data after image' ELSE 'healthy' END AS verdict,
        CASE WHEN is_foot OR NOT rd THEN 0 WHEN map_mcus IS NOT NULL THEN 1 - truncated / map_mcus
             WHEN cut IS NOT NULL THEN 0.5 ELSE 1 END AS readable FROM tg),
    triage AS MATERIALIZED (SELECT file_id, path, size, verdict, coalesce(width, 0) AS width, coalesce(height, 0) AS height,
        CASE WHEN rd AND NOT is_foot THEN grid ELSE 0 END AS mcus,
        CASE WHEN rd AND NOT is_foot THEN decode_errors ELSE 0 END AS decode_errors,
        CASE WHEN rd AND NOT is_foot THEN first_error END AS first_error, readable,
        CASE WHEN is_foot THEN 'footer of a file encrypter, victim ' || coalesce(personal_id, 'unnamed') ||
               CASE WHEN offline THEN '; key is a shared one' ELSE '' END
             WHEN NOT rd THEN CASE WHEN problem IS NULL THEN 'no usable frame or scan header' ELSE problem || coalesce(' at ' || problem_at, '') END
             WHEN decode_errors > 0 THEN 'bad MCUs: ' || decode_errors || ', from ' || first_error
             WHEN verdict = 'truncated' THEN 'data for ' || CAST(floor(readable * 100) AS INT) || ' percent'
             WHEN verdict = 'healthy, data after image' THEN CASE kind
               WHEN 'mpf' THEN 'MPF pictures: ' || t_len || ' bytes'
               WHEN 'motion_photo' THEN 'video: ' || t_len || ' bytes'
               WHEN 'embedded_jpeg' THEN 'second JPEG: ' || t_len || ' bytes' END
             ELSE '' END AS summary FROM tg1)"""


def triage_sql(with_map: bool) -> str:
    return (
        duck.TRIAGE
        + f", mc AS ({fx.mcus_sql()})"
        + _TRIAGE_ROWS.replace("{where}", "true" if with_map else "false")
    )


_COLS = "file_id:i, path:s, size:i, verdict:s, width:i, height:i, mcus:i, decode_errors:i, first_error:i, readable:d, summary:s"


@query("b19_triage", _COLS, triage_sql(False) + " --- SELECT * FROM triage")
def b19_triage(spark, sf_dir):
    return tg.triage(fx.files(spark, sf_dir))


@query(
    "b19_triage_unread",
    "file_id:i, verdict:s, mcus:i, readable:d, summary:s",
    triage_sql(False)
    + """ --- SELECT file_id, CASE WHEN size > 4000 THEN 'not read' ELSE verdict END AS verdict, CASE WHEN size > 4000 THEN 0 ELSE mcus END AS mcus,
        CASE WHEN size <= 4000 THEN readable END AS readable, CASE WHEN size > 4000 THEN 'content was not loaded' ELSE summary END AS summary FROM triage""",
)
def b19_triage_unread(spark, sf_dir):
    files = fx.files(spark, sf_dir)
    return tg.triage(files.withColumn("content", F.when(F.col("size") <= 4000, F.col("content"))))


@query("b19_triage_with_map", _COLS, triage_sql(True) + " --- SELECT * FROM triage")
def b19_triage_with_map(spark, sf_dir):
    maps = fx.mcus(spark, sf_dir).withColumnRenamed("image_id", "file_id")
    return tg.triage(fx.files(spark, sf_dir), maps)


@query(
    "b20_triage_counts",
    "verdict:s, n:i",
    triage_sql(False) + " --- SELECT verdict, count(*) AS n FROM triage GROUP BY verdict",
)
def b20_triage_counts(spark, sf_dir):
    return tg.triage_counts(tg.triage(fx.files(spark, sf_dir)))


@query(
    "b20_triage_counts_by_folder",
    "folder:s, verdict:s, n:i",
    triage_sql(False)
    + """ --- SELECT folder, verdict, count(*) AS n FROM (SELECT *, regexp_replace(path, '/[^/]*$', '') AS folder FROM triage)
      GROUP BY ROLLUP (folder, verdict)""",
)
def b20_triage_counts_by_folder(spark, sf_dir):
    return tg.triage_counts(tg.triage(fx.files(spark, sf_dir)), by_folder=True)


@query(
    "e18_keep_scans",
    "file_id:i, scans:i, sha:s",
    duck.WALK
    + """ --- SELECT s.file_id, n_scans AS scans, sha256(unhex(substr(f.hx, 1, 2 * sos_off) || 'FFD9')) AS sha
      FROM scan0 s JOIN files f USING (file_id) WHERE scan_no = 1""",
)
def e18_keep_scans(spark, sf_dir):
    return _sha(sal.keep_scans(fx.files(spark, sf_dir), 1))
