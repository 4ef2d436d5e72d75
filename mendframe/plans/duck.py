"""SQL building blocks of the oracle queries (DuckDB).

They restate the rules set by set: markers come from splitting a hex dump,
and a walk is a recursive join, unlike the folds the Spark side uses.
"""

from __future__ import annotations

from mendframe.sources import fixtures as fx


def h(off: str, n: int = 1) -> str:
    """n bytes of `hx` at 0-based offset, as hex."""
    return f"substr(hx, 2 * ({off}) + 1, {2 * n})"


def num(off: str, n: int = 1) -> str:
    """Big-endian integer of n bytes of `hx`."""
    return f"TRY_CAST('0x' || {h(off, n)} AS BIGINT)"


def le(off: str, n: int) -> str:
    parts = " || ".join(h(f"({off}) + {i}", 1) for i in reversed(range(n)))
    return f"TRY_CAST('0x' || {parts} AS BIGINT)"


def either(off: str, n: int, little: str = "little") -> str:
    return f"(CASE WHEN {little} THEN {le(off, n)} ELSE {num(off, n)} END)"


def is_sof(c: str) -> str:
    return f"({c} BETWEEN 192 AND 207 AND {c} NOT IN (196, 200, 204))"


FOLLOWS = (
    "((code BETWEEN 192 AND 207 AND code <> 200) OR code BETWEEN 224 AND 239 "
    "OR code BETWEEN 217 AND 223 OR code = 254)"
)

FILES = f"files AS MATERIALIZED (SELECT *, length(hx) // 2 AS n FROM ({fx.files_sql(fx.DUCK)}))"


def markers_cte(src: str = "files", key: str = "file_id", out: str = "mk", hx: str = "hx") -> str:
    """off, code, seg_len, fill per marker of `src`; a trailing FF has code -1. head: the eight bytes after the FF.

    The pieces between FFs give the head: its own piece and, where that is short, the next ones.
    """
    return f"""
    {out}_p AS (
      SELECT {key}, unnest(p) AS piece, generate_subscripts(p, 1) AS j, len(p) AS k
      FROM (SELECT {key}, string_split(regexp_replace({hx}, '(..)', '\\1 ', 'g'), 'FF ') AS p FROM {src})),
    {out}_o AS (
      SELECT {key}, j, k,
             sum(length(piece) // 3) OVER w + j - 1 AS off,
             lead(piece[:24]) OVER w AS nxt,
             string_agg(piece[:24], 'FF ') OVER (PARTITION BY {key} ORDER BY j ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING) AS after,
             max(CASE WHEN piece <> '' OR j = 1 THEN j ELSE 0 END) OVER w AS run
      FROM {out}_p WINDOW w AS (PARTITION BY {key} ORDER BY j)),
    {out} AS MATERIALIZED (
      SELECT {key}, off, code,
             CASE WHEN length(head) >= 6 THEN TRY_CAST('0x' || head[3:6] AS INT) END AS seg_len, fill, head
      FROM (SELECT {key}, CAST(off AS BIGINT) AS off,
                   CASE WHEN nxt = '' THEN -1 ELSE TRY_CAST('0x' || nxt[:2] AS INT) END AS code,
                   replace(coalesce(after, ''), ' ', '')[:16] AS head, j - run AS fill
            FROM {out}_o WHERE j < k AND (nxt <> '' OR j = k - 1)) AS m)"""


MARKERS = FILES + ", " + markers_cte()

# succ: for every marker, where the walk lands after it.
# chase: the walk itself, from the starts given.


def chase_cte(starts: str, limit: str = "n", name: str = "chase") -> str:
    return f"""
    {name}_succ AS MATERIALIZED (
      SELECT a.file_id, a.off, a.code, a.want, b.off AS land
      FROM (SELECT file_id, off, code, off + 2 + CASE WHEN code = 1 OR code BETWEEN 208 AND 216 THEN 0
              ELSE coalesce(seg_len, 0) END AS want FROM mk WHERE code <> 218) a
      LEFT JOIN mk b ON a.file_id = b.file_id AND b.off - b.fill <= a.want AND a.want <= b.off
      UNION ALL
      SELECT a.file_id, a.off, 218, a.want, b.off
      FROM (SELECT file_id, off, off + 2 + coalesce(seg_len, 0) AS want FROM mk WHERE code = 218) a
      ASOF LEFT JOIN (SELECT * FROM mk WHERE code <> 0 AND code NOT BETWEEN 208 AND 215) b
        ON a.file_id = b.file_id AND b.off >= a.want),
    {name} AS (
      SELECT file_id, start, 0 AS step, start AS off, 216 AS code, 2 AS seg_len, CAST(0 AS BIGINT) AS fill, 0 AS n_scans,
             start AS want, n, 'seg' AS status, start AS pos_
      FROM ({starts})
      UNION ALL
      SELECT file_id, start, step + 1, off, code, seg_len, fill,
             n_scans + CASE WHEN status = 'seg' AND code = 218 THEN 1 ELSE 0 END, want, n, status,
             CASE status WHEN 'not_a_marker' THEN want WHEN 'ends_in_padding' THEN want
                         WHEN 'ends_before_eoi' THEN n WHEN 'ends_in_data' THEN n ELSE off END
      FROM (
        SELECT c.file_id, c.start, c.step, m.off, m.code, m.seg_len, m.fill, c.n_scans, s.want, c.n,
          CASE
            WHEN m.off IS NULL OR m.off >= c.n THEN CASE WHEN c.code = 218 THEN 'ends_in_data'
                 WHEN s.want >= c.n THEN 'ends_before_eoi' ELSE 'not_a_marker' END
            WHEN m.code = -1 OR m.off + 1 >= c.n THEN 'ends_in_padding'
            WHEN m.code = 217 THEN 'eoi'
            WHEN m.code = 1 OR m.code BETWEEN 208 AND 215 THEN 'seg'
            WHEN c.n_scans > 0 AND NOT {FOLLOWS.replace('code', 'm.code')} THEN 'illegal_pair'
            WHEN m.off + 3 >= c.n THEN 'mid_segment'
            WHEN m.seg_len < 2 OR m.off + 2 + m.seg_len > c.n THEN 'length_past_end'
            ELSE 'seg' END AS status
        FROM {name} c
        JOIN {name}_succ s ON s.file_id = c.file_id AND s.off = c.off
        LEFT JOIN mk m ON m.file_id = c.file_id AND m.off = s.land
        WHERE c.status = 'seg') )"""


# Walk of whole files from byte 0, and the tables derived from it.
_WALK = (
    chase_cte("SELECT file_id, CAST(0 AS BIGINT) AS start, n FROM files WHERE n >= 4 AND hx LIKE 'FFD8%'")
    + """,
    segs AS MATERIALIZED (
      SELECT file_id, step AS seg_no, code AS marker, off,
             CASE WHEN code = 1 OR code BETWEEN 208 AND 217 THEN 2 ELSE seg_len + 2 END AS length,
             CASE WHEN code = 1 OR code BETWEEN 208 AND 217 THEN NULL ELSE off + 4 END AS data_off,
             CASE WHEN code = 1 OR code BETWEEN 208 AND 217 THEN 0 ELSE seg_len - 2 END AS data_length
      FROM chase WHERE status IN ('seg', 'eoi')),
    last_row AS MATERIALIZED (SELECT * FROM chase QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY step DESC) = 1),
    status AS MATERIALIZED (
      SELECT f.file_id, f.n, coalesce((SELECT count(*) FROM segs s WHERE s.file_id = f.file_id), 0) AS segments,
             CASE WHEN l.status = 'eoi' THEN l.off + 2 END AS image_end,
             CASE WHEN l.status IS NULL THEN 'no_soi' WHEN l.status <> 'eoi' THEN l.status END AS problem,
             CASE WHEN l.status <> 'eoi' THEN l.pos_ END AS problem_at
      FROM files f LEFT JOIN last_row l USING (file_id)),
    scan0 AS MATERIALIZED (
      SELECT c.file_id, row_number() OVER (PARTITION BY c.file_id ORDER BY c.step) - 1 AS scan_no,
             count(*) OVER (PARTITION BY c.file_id) AS n_scans,
             c.off AS sos_off, c.off + 2 + c.seg_len AS data_start, c.seg_len - 2 AS plen,
             CASE WHEN e.off IS NULL THEN e.n ELSE greatest(e.off - e.fill, e.want) END AS data_end
      FROM chase c JOIN chase e ON e.file_id = c.file_id AND e.step = c.step + 1
      WHERE c.status = 'seg' AND c.code = 218),
    scan_rows AS MATERIALIZED (
      SELECT s.*, f.hx, st.problem, st.problem_at,
        (SELECT count(*) FROM mk WHERE mk.file_id = s.file_id AND mk.code BETWEEN 208 AND 215
           AND mk.off >= s.data_start AND mk.off < s.data_end) AS restart_markers,
        CASE WHEN st.problem = 'illegal_pair' AND scan_no = n_scans - 1 THEN st.problem_at END AS first_illegal
      FROM scan0 s JOIN files f USING (file_id) JOIN status st USING (file_id))"""
)
WALK = "WITH RECURSIVE " + MARKERS + ", " + _WALK

_FRAME = f""",
    sof AS (SELECT s.*, f.hx, {num('data_off + 5')} AS nc, {num('data_off + 3', 2)} AS width,
                   {num('data_off + 1', 2)} AS height
            FROM segs s JOIN files f USING (file_id) WHERE {is_sof('marker')} AND data_length >= 6
            QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY seg_no) = 1),
    samp AS (SELECT file_id, c, {num('data_off + 7 + 3 * c')} // 16 AS hs, {num('data_off + 7 + 3 * c')} % 16 AS vs
             FROM (SELECT *, unnest(range(nc)) AS c FROM sof) WHERE 6 + 3 * c + 2 < data_length),
    samp_agg AS (SELECT file_id, count(*) AS n_samp, list(hs ORDER BY c) AS h_samp, list(vs ORDER BY c) AS v_samp,
                        max(hs) AS hmax, max(vs) AS vmax FROM samp GROUP BY file_id),
    dri AS (SELECT file_id, arg_max(v, seg_no) AS restart_interval FROM (
              SELECT file_id, seg_no, {num('data_off', 2)} AS v FROM segs JOIN files USING (file_id)
              WHERE marker = 221 AND data_length >= 2) GROUP BY file_id),
    frames AS MATERIALIZED (
      SELECT sof.file_id, marker AS frame_marker, off, width, height, nc AS components, h_samp, v_samp,
        CASE WHEN nc = 1 THEN 8 ELSE 8 * hmax END AS mcu_w, CASE WHEN nc = 1 THEN 8 ELSE 8 * vmax END AS mcu_h,
        CAST(ceil(width / nullif(1.0 * mcu_w, 0)) AS BIGINT) AS mcus_x,
        CAST(ceil(height / nullif(1.0 * mcu_h, 0)) AS BIGINT) AS mcus_y,
        coalesce(dri.restart_interval, 0) AS restart_interval, marker IN (194, 198, 202) AS progressive,
        coalesce((SELECT count(*) FROM scan0 s WHERE s.file_id = sof.file_id), 0) AS scan_count,
        width > 0 AND height > 0 AND nc BETWEEN 1 AND 4 AND n_samp = nc
          AND list_min(h_samp) >= 1 AND list_max(h_samp) <= 4 AND list_min(v_samp) >= 1 AND list_max(v_samp) <= 4
          AND (SELECT count(*) FROM scan0 s WHERE s.file_id = sof.file_id) > 0 AS readable
      FROM sof LEFT JOIN samp_agg USING (file_id) LEFT JOIN dri USING (file_id))"""
FRAMES = WALK + _FRAME


# Salvage: the same chase under the stricter rules, over the first `limit` bytes of each file.
def salvage_cte(limits: str, name: str = "salvage") -> str:
    return f"""
    {name}_succ AS MATERIALIZED (
      SELECT a.file_id, a.off, a.code, a.want, b.off AS land
      FROM (SELECT file_id, off, code, off + 2 + CASE WHEN code = 216 THEN 0 ELSE coalesce(seg_len, 0) END AS want
            FROM mk WHERE code <> 218) a
      LEFT JOIN mk b ON a.file_id = b.file_id AND b.off - b.fill <= a.want AND a.want <= b.off
      UNION ALL
      SELECT a.file_id, a.off, 218, a.want, b.off
      FROM (SELECT file_id, off, off + 2 + coalesce(seg_len, 0) AS want FROM mk WHERE code = 218) a
      ASOF LEFT JOIN (SELECT * FROM mk WHERE code <> 0 AND code NOT BETWEEN 208 AND 215) b
        ON a.file_id = b.file_id AND b.off >= a.want),
    {name}_chase AS (
      SELECT file_id, 0 AS step, CAST(0 AS BIGINT) AS off, 216 AS code, 2 AS seg_len, n, 'seg' AS status, CAST(0 AS BIGINT) AS pos_
      FROM ({limits})
      UNION ALL
      SELECT c.file_id, c.step + 1, m.off, m.code, m.seg_len, c.n,
        CASE WHEN m.off IS NULL OR m.off + 1 >= c.n OR m.code = -1 THEN 'cut'
             WHEN NOT {FOLLOWS.replace('code', 'm.code')} THEN 'cut'
             WHEN m.code = 217 THEN 'clean'
             WHEN m.off + 3 >= c.n OR m.seg_len < 2 OR m.off + 2 + m.seg_len > c.n THEN 'cut'
             ELSE 'seg' END,
        CASE WHEN c.code = 218 THEN CASE WHEN m.off IS NULL OR m.off >= c.n THEN c.n
             ELSE greatest(m.off - m.fill, s.want) END ELSE s.want END
      FROM {name}_chase c JOIN {name}_succ s ON s.file_id = c.file_id AND s.off = c.off
      LEFT JOIN mk m ON m.file_id = c.file_id AND m.off = s.land
      WHERE c.status = 'seg'),
    {name} AS MATERIALIZED (
      SELECT f.file_id, f.hx, l.n, max(CASE WHEN status = 'cut' THEN pos_ END) AS cut,
             max(CASE WHEN status = 'clean' THEN off + 2 END) AS clean_end,
             min(CASE WHEN status = 'seg' AND code = 218 THEN off + 2 + seg_len END) AS scan_start,
             coalesce(arg_max(CASE WHEN status = 'seg' AND code = 221 AND seg_len >= 4 THEN {num('off + 4', 2)} END, step)
               FILTER (WHERE status = 'seg' AND code = 221 AND seg_len >= 4), 0) AS restart_interval
      FROM files f JOIN ({limits}) l USING (file_id) LEFT JOIN {name}_chase c ON c.file_id = f.file_id
      GROUP BY f.file_id, f.hx, l.n)"""


WHOLE = "SELECT file_id, n FROM files WHERE n >= 4 AND hx LIKE 'FFD8%'"
SALVAGE = "WITH RECURSIVE " + MARKERS + ", " + salvage_cte(WHOLE)

# Ransomware footer and trailer.
FOOTER_CTE = f"""
    ft0 AS (SELECT file_id, hx, n, n - length(hx[-8192:]) // 2 AS base, hx[-8192:] AS t FROM files),
    ft1 AS (SELECT *, length(t) - 76 - (instr(reverse(t), reverse('{fx.GUID_HEX}')) - 1) AS p
            FROM ft0 WHERE contains(t, '{fx.GUID_HEX}')),
    ft2 AS (SELECT *, base + p // 2 AS pos_ FROM ft1),
    ft3 AS (SELECT *, regexp_extract(array_to_string(list_transform(range(greatest(pos_ - 64, 0), pos_), lambda i:
              CASE WHEN CAST('0x' || substr(hx, 2 * i + 1, 2) AS INT) BETWEEN 32 AND 126
                   THEN chr(CAST('0x' || substr(hx, 2 * i + 1, 2) AS INT)) ELSE '~' END), ''), '[0-9A-Za-z]*$') AS id FROM ft2),
    ft4 AS (SELECT *, pos_ - length(id) AS id_start FROM ft3),
    footer AS MATERIALIZED (
      SELECT f.file_id, coalesce(max(m.off) + 2, any_value(id_start)) AS off,
             any_value(CASE WHEN length(id) >= 16 THEN id END) AS personal_id,
             any_value(length(id) >= 16 AND id LIKE '%t1') AS offline
      FROM ft4 f LEFT JOIN mk m ON m.file_id = f.file_id AND m.code = 217
        AND m.off BETWEEN greatest(id_start - 1024, 0) AND id_start - 2
      GROUP BY f.file_id)"""
TRAILER_CTE = f"""
    sig AS (SELECT file_id, min(off) + 2 AS e FROM mk JOIN files USING (file_id)
            WHERE code = 217 AND ({h('off + 2', 3)} = 'FFD8FF' OR {h('off + 6', 4)} = '66747970') GROUP BY file_id),
    tr0 AS (SELECT f.file_id, f.hx, f.n, st.image_end, ft.off AS foot, coalesce(st.image_end, sig.e) AS e,
              ft.off IS NOT NULL AND (st.image_end IS NULL OR ft.off >= st.image_end - 2) AS is_footer
            FROM files f JOIN status st USING (file_id) LEFT JOIN footer ft USING (file_id) LEFT JOIN sig USING (file_id)),
    tr1 AS (SELECT *, substr(hx, 2 * e + 1) AS rest FROM tr0 WHERE is_footer OR e < n),
    trailer AS MATERIALIZED (
      SELECT file_id, CASE WHEN is_footer THEN 'stop_djvu'
          WHEN length(rest) <= 8192 AND regexp_full_match(rest, '(00|FF)*') THEN 'unknown'
          WHEN EXISTS (SELECT 1 FROM segs s WHERE s.file_id = tr1.file_id AND marker = 226 AND data_length >= 4
                 AND off + length <= e AND {h('data_off', 4)} = '4D504600') THEN 'mpf'
          WHEN n - e >= 12 AND {h('e + 4', 4)} = '66747970' THEN 'motion_photo'
          WHEN n - e >= 3 AND rest LIKE 'FFD8FF%' THEN 'embedded_jpeg'
          WHEN regexp_matches(rest[:131078], '^(..)*?66747970') THEN 'motion_photo'
          ELSE 'unknown' END AS kind,
        CASE WHEN is_footer THEN CASE WHEN image_end < foot THEN image_end ELSE foot END ELSE e END AS off, n
      FROM tr1)"""
TRAILER = FRAMES + ", " + FOOTER_CTE + ", " + TRAILER_CTE
TRIAGE = (
    TRAILER
    + ", "
    + salvage_cte(
        "SELECT f.file_id, coalesce(t.off, f.n) AS n FROM files f LEFT JOIN trailer t USING (file_id) "
        "WHERE coalesce(t.off, f.n) >= 4 AND f.hx LIKE 'FFD8%'"
    )
)
