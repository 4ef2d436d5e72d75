"""Repairing a file with the header of another one: where to cut, whom to borrow from, what to keep."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendframe.functions import names
from mendframe.functions.blocked import BLOCK, with_halo
from mendframe.functions.bytes import be16, cut, u8
from mendframe.functions.names import TRUNCATED
from mendframe.functions.once import once
from mendframe.operators.markers import with_markers
from mendframe.operators.structure import last_tables_expr, renumber_expr, tables_expr, with_frame, with_walk
from mendframe.operators.trailer import with_footer

# What STOP/Djvu encrypts, and limits of the searches.
ENCRYPTED_PREFIX = 150 * 1024
FULL_SCORE_MCUS = 200

#: Over how many tasks the files of one folder, or of one set of tables, are spread in a join.
SPREAD = 16


def with_layout(files: DataFrame, sizes: bool = True) -> DataFrame:
    """Adds `layout`: what a file's front matter says, up to its first scan header.

    Without `sizes`, the frame header is not read, and width, height, components and progressive are left out.
    """
    if "layout" in files.columns:
        return files
    df = with_frame(files) if sizes else with_walk(files)
    frame = """'width', coalesce(frame.width, 0), 'height', coalesce(frame.height, 0),
                'components', coalesce(frame.components, 0), 'progressive', coalesce(frame.progressive, false),"""
    dri = "filter(walk.segs, g -> g.marker = 221 AND g.data_length >= 2 AND (_sos IS NULL OR g.off < _sos))"
    return (
        df.withColumn("_sos", once("get(walk.scans, 0).sos_off"))
        .withColumn("_short", once(f"exists(walk.segs, g -> {names.is_sof('g.marker')} AND g.data_length < 6 "
                                   "AND (_sos IS NULL OR g.off < _sos))"))
        .withColumn(
            "layout",
            once(
                f"""named_struct({frame if sizes else ''}
                'restart_interval', coalesce({be16('content', f'try_element_at({dri}, -1).data_off')}, 0),
                'entropy_start', CASE WHEN NOT _short THEN get(walk.scans, 0).data_start END,
                'problem', CASE WHEN _short THEN 'short_frame_header' WHEN _sos IS NOT NULL THEN NULL
                  WHEN walk.image_end IS NOT NULL THEN 'no_scan' ELSE walk.problem END)"""
            ),
        )
        .drop("_sos", "_short")
    )


def layouts(files: DataFrame) -> DataFrame:
    return with_layout(files).select("file_id", "layout.*")


def donor_problem(rows: DataFrame) -> DataFrame:
    """Adds `donor_problem` to layouts: NULL for a usable donor."""
    return rows.withColumn(
        "donor_problem",
        F.expr(
            "CASE WHEN problem IS NOT NULL OR entropy_start IS NULL THEN coalesce(problem, 'no_usable_header') "
            "WHEN progressive THEN 'progressive' WHEN components <> 3 THEN concat(components, '_components') END"
        ),
    )


def with_boundary(files: DataFrame) -> DataFrame:
    """Adds `image_bytes` (where the file's own bytes end) and `illegal` (offset of the last
    FF pair scan data cannot contain, outside the file's own header)."""
    if "illegal" in files.columns:
        return files
    df = with_footer(with_layout(files))
    n = "length(content)"
    signature = (
        f"get(filter(markers, x -> x.code = 217 AND ((x.off + 4 < {n} AND {cut('content', 'x.off + 2', 3)} = X'FFD8FF') "
        f"OR (x.off + 10 <= {n} AND {cut('content', 'x.off + 6', 4)} = X'66747970'))), 0).off + 2"
    )
    df = df.withColumn("image_bytes", once(f"cast(coalesce(footer.off, {signature}, {n}) as bigint)"))
    last = (
        f"try_element_at(filter(markers, x -> x.off <= image_bytes - 2 AND x.code > 0 AND x.code <> 217 "
        f"AND NOT {names.is_rst('x.code')}), -1).off"
    )
    return df.withColumn("_i", once(last)).withColumn(
        "illegal", once("CASE WHEN layout.entropy_start IS NULL OR _i >= layout.entropy_start THEN _i END")
    ).drop("_i")


def damage_boundary(files: DataFrame) -> DataFrame:
    """file_id, illegal, boundary: the first byte that may be undamaged (0 when nothing shows damage)."""
    return with_boundary(with_layout(files, sizes=False)).select(
        "file_id", "illegal", F.expr("coalesce(illegal + 2, 0)").alias("boundary")
    )


def near_restarts_expr() -> str:
    """SQL: the first three restart markers past the damage that are the file's own."""
    past = f"filter(markers, x -> {names.is_rst('x.code')} AND x.off >= coalesce(illegal + 2, 0))"
    return f"filter(slice({past}, 1, 3), x -> x.off < image_bytes)"


def splice_points_expr(restart_interval: str, prefix: int, near: str = "_near") -> str:
    """SQL: all candidates; `near` holds what `near_restarts_expr` finds."""
    rst = lambda lo: f"filter(markers, x -> {names.is_rst('x.code')} AND x.off >= {lo})"
    item = lambda off, reason, missing="cast(null as string)": (
        f"named_struct('off', cast({off} as bigint), 'reason', '{reason}', 'unavailable', {missing})"
    )
    none = "cast(null as bigint)"
    expected = f"({restart_interval} > 0 OR layout.restart_interval > 0)"
    far = f"filter(slice({rst(prefix)}, 1, 1), x -> x.off < image_bytes)"
    missing_restart = item(
        none, "restart", f"CASE WHEN {expected} THEN 'none_past_damage' ELSE 'no_restart_markers' END"
    )
    parts = [
        f"array({item('0', 'start')})",
        f"""array(CASE WHEN layout.entropy_start > 0 THEN {item('layout.entropy_start', 'own_scan_header')}
             ELSE {item(none, 'own_scan_header', "coalesce(layout.problem, 'no_scan_header')")} END)""",
        f"""CASE WHEN {expected} AND size({near}) > 0 THEN transform({near}, (x, i) -> named_struct('off', x.off + 2,
             'reason', CASE WHEN i = 0 THEN 'restart' ELSE 'next_restart' END, 'unavailable', cast(null as string)))
             ELSE array({missing_restart}) END""",
        f"""array(CASE WHEN illegal IS NOT NULL THEN {item('illegal + 2', 'past_illegal_pair')}
             ELSE {item(none, 'past_illegal_pair', "'no_illegal_pair'")} END)""",
        f"""CASE WHEN {prefix} < image_bytes AND {restart_interval} > 0 THEN transform({far}, x -> named_struct('off', x.off + 2,
             'reason', 'restart_after_prefix', 'unavailable', cast(null as string))) ELSE array() END""",
        f"""CASE WHEN {prefix} < image_bytes THEN array({item(str(prefix), 'encrypted_prefix')}) ELSE array() END""",
    ]
    return f"concat({', '.join(parts)})"


def splice_points(
    files: DataFrame, restart_interval: int = 0, prefix: int = ENCRYPTED_PREFIX, limit: int | None = None
) -> DataFrame:
    """file_id, seq, off, reason, unavailable: where the surviving data may begin, best guess first.

    Candidates the file does not have are listed with the reason; a byte
    offset appears once. The list is built inside the file's row.
    """
    listed = splice_points_expr(str(restart_interval), prefix)
    unique = "filter(_c, (t, i) -> t.off IS NULL OR (t.off < _n AND array_position(_c.off, t.off) = i + 1))"
    return (
        with_boundary(with_layout(files, sizes=False).withColumn("_n", F.length("content")))
        .withColumn("_near", once(near_restarts_expr()))
        .withColumn("_c", once(listed))
        .select("file_id", F.posexplode(F.expr(unique if limit is None else f"slice({unique}, 1, {limit})")).alias("seq", "t"))
        .select("file_id", "seq", "t.*")
    )


def rank_donors(trials: DataFrame, donors: DataFrame, limit: int | None = None) -> DataFrame:
    """file_id, donor_id, problem, decoded, anomalies, score, rank.

    `trials`: file_id, donor_id, m, anomalies, the decoded sample of each
    donor's header on each file; `donors`: donor_id, problem. Only MCUs before
    the first one that is merely out of data count. The cut is one row per
    trial, so it meets the MCUs by an equi-join, and both steps combine on the
    map side.
    """
    key = ["file_id", "donor_id"]
    first_cut = trials.where(F.col("anomalies") == TRUNCATED).groupBy(*key).agg(F.min("m").alias("cut"))
    scored = (
        trials.join(first_cut, key, "left")
        .groupBy(*key)
        .agg(
            F.count_if(F.col("cut").isNull() | (F.col("m") < F.col("cut"))).alias("decoded"),
            F.count_if((F.col("cut").isNull() | (F.col("m") < F.col("cut"))) & (F.col("anomalies") != 0)).alias(
                "anomalies"
            ),
        )
        .join(donors, "donor_id", "left")
        .withColumn(
            "score",
            F.expr(
                f"CASE WHEN problem IS NOT NULL OR decoded = 0 THEN 0D "
                f"ELSE (1 - anomalies / decoded) * least(1, decoded / {FULL_SCORE_MCUS}) END"
            ),
        )
    )
    w = Window.partitionBy("file_id").orderBy(
        F.col("problem").isNotNull(), F.round("score", 9).desc(), "donor_id"
    )
    ranked = scored.withColumn("rank", F.row_number().over(w))
    if limit is not None:
        ranked = ranked.where(F.col("rank") <= limit)
    return ranked.select(*key, "problem", "decoded", "anomalies", "score", "rank")


def suggest_siblings(
    files: DataFrame, tried: int | None = None, max_bytes: int | None = None
) -> DataFrame:
    """file_id, donor_path, position: the first usable donor in name order in each file's own folder.

    The folder's two lowest usable paths serve every file in it, because only
    one of them can be the file itself: each folder is reduced to those two by an
    aggregate that combines before its shuffle, and files meet them spread over
    `SPREAD` copies, so a folder of any size is many tasks. With `tried`, a
    donor must be among the first so many JPEGs other than the file, and
    position is its place among them. With `max_bytes`, larger files give no
    header.
    """
    named = with_layout(files).select(
        "file_id",
        "path",
        "size",
        F.regexp_replace("path", "/[^/]*$", "").alias("folder"),
        "layout",
    )
    facts = donor_problem(named.select("file_id", "path", "size", "folder", "layout.*")).select(
        "file_id", "path", "size", "folder", F.col("donor_problem").isNull().alias("usable")
    )
    eligible = facts.where("lower(path) RLIKE '\\\\.jpe?g$'")
    if max_bytes is not None:
        eligible = eligible.where(F.col("size") <= max_bytes)
    if tried is None:
        eligible = eligible.where("usable")
    most = 2 if tried is None else tried + 1
    # Only the lowest paths of a folder leave a task.
    low = eligible.groupBy("folder", F.spark_partition_id().alias("_task")).agg(
        F.expr(f"slice(array_sort(collect_list(struct(path, usable))), 1, {most})").alias("list")
    )
    short = low.groupBy("folder").agg(F.expr(f"slice(array_sort(flatten(collect_list(list))), 1, {most})").alias("list"))
    copies = short.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    own = facts.select("file_id", "path", "folder").withColumn("_copy", F.pmod(F.xxhash64("path"), F.lit(SPREAD)).cast("int"))
    return (
        own.join(copies, ["folder", "_copy"])
        .select("file_id", F.expr("filter(list, c -> c.path <> path)").alias("c"))
        .select("file_id", F.expr("c" if tried is None else f"slice(c, 1, {tried})").alias("c"))
        .select(
            "file_id",
            F.expr("get(filter(c, d -> d.usable), 0).path").alias("donor_path"),
            F.expr("coalesce(array_position(transform(c, d -> d.usable), true), 0)").alias("position"),
        )
        .where("donor_path IS NOT NULL")
    )


def candidate_widths(min_w: int, max_w: int, step: int, donor: tuple[int, int] = ()) -> list[int]:
    """Widths worth trying: multiples of the MCU width, the donor's own width and its height."""
    widths = set(range(max(step, min_w - min_w % step), max_w + 1, step)) | set(donor)
    return sorted(w for w in widths if 0 < w <= 65535)


def _block_steps(key: tuple, near: pa.Table, widths: list[int], max_rows: int | None, min_rows: int) -> pa.Table:
    """rows, _seam, _inner, _n of a block's own MCUs at each width, against those that lie above them."""
    place, own = near["m"].to_numpy(), near["_own"].to_numpy()
    low = place.min()
    bottom = np.full(place.max() - low + 1, np.nan)
    held = np.zeros(len(bottom), bool)
    bottom[place - low], held[place - low] = near["bottom"].to_numpy(), True
    m, top, inner, total = place[own], *(near[c].to_numpy()[own] for c in ("top", "inner", "total"))
    known = lambda v: np.nan if np.isnan(v).all() else np.nansum(v)
    out = []
    for w in widths:
        rows = total // w if max_rows is None else np.minimum(max_rows, total // w)
        above = m - w - low
        at = np.flatnonzero((m >= w) & (m < w * rows) & (rows >= min_rows) & (above >= 0))
        at = at[held[above[at]]]
        if len(at):
            out.append((w, rows[at].max(), known(np.abs(top[at] - bottom[above[at]])), known(inner[at]), len(at)))
    of = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
    columns = [pa.array([r[k] for r in out], t, from_pandas=True) for k, t in enumerate(of)]
    return pa.table([pa.array([key[0].as_py()] * len(out), key[0].type), *columns], ["image_id", "width", "rows", "_seam", "_inner", "_n"])


def detect_width(edges: DataFrame, widths: list[int], max_rows: int | None = None, min_rows: int = 3) -> DataFrame:
    """image_id, width, rows, cost, rank: how smoothly the MCU rows continue at each width (in MCUs).

    `edges`: image_id, m, top, bottom, inner: mean edge samples and inner
    contrast of each MCU, and `total` MCUs. The stream is the same at every
    width; only which MCU lies above changes. The cost is the mean step across
    row borders over the mean inner contrast plus one, over all rows or the
    first `max_rows`. Each block of the stream, with the MCUs before it that any
    width reaches, is tried at all widths where it lies; only sums leave it.
    """
    near = edges if max_rows is None else edges.where(F.col("m") < max(widths) * max_rows)
    number = lambda c, t: F.col(c).cast(t).alias(c)
    near = near.where("image_id IS NOT NULL AND m IS NOT NULL AND total IS NOT NULL").select(
        "image_id", number("m", "bigint"), number("total", "bigint"), *[number(c, "double") for c in ("top", "bottom", "inner")]
    )
    of_type = near.schema["image_id"].dataType.simpleString()
    sums = (
        with_halo(near, ["image_id"], "m", max(widths), block=max(BLOCK, 4 * max(widths)))
        .groupBy("image_id", "_block")
        .applyInArrow(
            lambda key, block: _block_steps(key, block, widths, max_rows, min_rows),
            f"image_id {of_type}, width bigint, rows bigint, _seam double, _inner double, _n bigint",
        )
    )
    cost = (
        sums.groupBy("image_id", "width")
        .agg(F.max("rows").alias("rows"), *[F.sum(c).alias(c) for c in ("_seam", "_inner", "_n")])
        .withColumn("cost", F.expr("(_seam / _n) / (_inner / _n + 1)"))
    )
    w = Window.partitionBy("image_id").orderBy(F.round("cost", 9), "width")
    return cost.withColumn("rank", F.row_number().over(w)).select("image_id", "width", "rows", "cost", "rank")


def overlay_tables(own: DataFrame, donor: DataFrame) -> DataFrame:
    """file_id, kind, slot, bytes, kept_own: the file's own tables where it has them, else the donor's."""
    key = ["file_id", "kind", "slot"]
    return own.withColumnRenamed("bytes", "_own").join(
        donor.withColumnRenamed("bytes", "_donor"), key, "full_outer"
    ).select(*key, F.coalesce("_own", "_donor").alias("bytes"), F.col("_own").isNotNull().alias("kept_own"))


def table_label(kind: str = "kind", slot: str = "slot") -> str:
    """SQL: 'DQT 0', 'DHT AC1'."""
    return (
        f"CASE WHEN {kind} = 'DQT' THEN concat('DQT ', {slot}) ELSE concat('DHT ', "
        f"CASE WHEN {slot} >= 16 THEN 'AC' ELSE 'DC' END, {slot} & 15) END"
    )


def is_identity(g: str = "g", blob: str = "content") -> str:
    """SQL: a segment that describes the photograph rather than how to decode it."""
    sig = lambda hx: f"{g}.data_length >= {len(hx) // 2} AND {cut(blob, f'{g}.data_off', len(hx) // 2)} = X'{hx}'"
    return f"""({g}.marker = 254 OR ({g}.marker BETWEEN 224 AND 239
        AND NOT ({g}.marker = 224 AND ({sig('4A46494600')} OR {sig('4A46585800')}))
        AND NOT ({g}.marker = 226 AND {sig('4943435F50524F46494C4500')})
        AND NOT ({g}.marker = 238 AND {sig('41646F6265')})))"""


def drop_identity(files: DataFrame) -> DataFrame:
    """file_id, seg_no, marker, off, length of the header segments a donor may pass on."""
    keep = f"filter(transform(walk.segs, (g, i) -> named_struct('seg_no', i, 'g', g)), s -> NOT {is_identity('s.g')})"
    return (
        with_walk(files)
        .select("file_id", F.explode(once(keep)).alias("s"))
        .select("file_id", "s.seg_no", "s.g.marker", "s.g.off", "s.g.length")
    )


def own_exif_expr(limit: str, blob: str = "content", markers: str = "markers") -> str:
    """SQL: marker of the first believable Exif segment that lies before `limit`, or NULL."""
    n = f"least({limit}, length({blob}))"
    return (
        f"get(filter({markers}, x -> x.code = 225 AND x.off + 12 < {n} AND x.seg_len >= 14 AND x.off + 2 + x.seg_len <= {n} "
        f"AND {cut(blob, 'x.off + 4', 6)} = X'457869660000' "
        f"AND {cut(blob, 'x.off + 10', 4)} IN (X'49492A00', X'4D4D002A')), 0)"
    )


def own_exif(files: DataFrame, limit: Column | int) -> DataFrame:
    """file_id, off, segment: the file's own Exif in front of a splice offset, if it survived."""
    df = with_markers(files).withColumn("_limit", limit if isinstance(limit, Column) else F.lit(limit))
    df = df.withColumn("_x", once(own_exif_expr("_limit"))).where("_x IS NOT NULL")
    return df.select("file_id", "_x.off", F.expr(cut("content", "_x.off", "2 + _x.seg_len")).alias("segment"))


def _header_parts(df: DataFrame, limit: str, with_apps: bool, name: str) -> DataFrame:
    """Adds `name`: tables and header segments before `limit`, up to the first scan header."""
    inside = f"filter(walk.segs, g -> g.off + g.length <= {limit} AND (get(walk.scans, 0) IS NULL OR g.off <= get(walk.scans, 0).sos_off))"
    df = df.withColumn("_in", once(inside))
    whole = lambda g: cut("content", f"{g}.off", f"{g}.length")
    df = df.withColumn("_sof", once(f"get(filter(_in, g -> {names.is_sof('g.marker')}), 0)"))
    df = df.withColumn("_sos", once("get(filter(_in, g -> g.marker = 218), 0)"))
    df = df.withColumn("_dri", once("try_element_at(filter(_in, g -> g.marker = 221), -1)"))
    ids = lambda g, base, step: (
        f"CASE WHEN {u8('content', f'{g}.data_off + {base}')} > 0 THEN transform(filter(sequence(0, {u8('content', f'{g}.data_off + {base}')} - 1), "
        f"i -> {base + 1} + {step} * i < {g}.data_length), i -> {u8('content', f'{g}.data_off + {base + 1} + {step} * i')}) "
        f"ELSE cast(array() as array<int>) END"
    )
    apps = (
        f"aggregate(filter(_in, g -> g.marker BETWEEN 224 AND 239 AND NOT {is_identity()}), X'', (a, g) -> concat(a, {whole('g')}))"
        if with_apps
        else "X''"
    )
    return df.withColumn(
        name,
        once(
            f"named_struct('apps', {apps}, 'tables', {tables_expr('_in')}, 'sof', {whole('_sof')}, 'sos', {whole('_sos')}, "
            f"'dri', {whole('_dri')}, 'sof_ids', {ids('_sof', 5, 3)}, 'sos_ids', {ids('_sos', 0, 2)})"
        ),
    ).drop("_in", "_sof", "_sos", "_dri")


def donor_headers(donors: DataFrame) -> DataFrame:
    """donor_id, header: what a splice takes from each usable donor, a few KiB per row."""
    df = with_layout(donors)
    usable = "layout.problem IS NULL AND layout.entropy_start IS NOT NULL AND NOT layout.progressive AND layout.components = 3"
    df = df.where(usable)
    return _header_parts(df, "length(content)", True, "header").select(
        F.col("file_id").alias("donor_id"), "header"
    )


def splice(
    files: DataFrame,
    headers: DataFrame,
    points: DataFrame,
    keep_own_tables: bool = True,
    renumber: bool = True,
    width: int = 0,
    height: int = 0,
    restart_interval: int = -1,
) -> DataFrame:
    """file_id, donor_id, offset, header_size, carried_exif, kept_own, content.

    `headers` from `donor_headers`, `points`: file_id, donor_id, offset. The
    result is SOI, the file's own Exif, the donor's neutral APPn, tables (own
    slot by slot where they survive before the offset), frame, restart
    interval and scan headers, and the file's bytes from the offset to its end
    or ransomware footer, closed with an EOI. Points that leave no data are
    dropped. File bytes meet their points once, by file_id.
    """
    df = with_footer(with_frame(files)).join(points, "file_id").join(headers, "donor_id")
    df = df.withColumn("_end", once("cast(coalesce(footer.off, length(content)) as bigint)")).where(
        "offset >= 0 AND offset < _end"
    )
    df = _header_parts(df, "offset", False, "_own")
    own_t = "_own.tables" if keep_own_tables else "slice(_own.tables, 1, 0)"
    own = lambda f: f"_own.{f}" if keep_own_tables else "cast(null as binary)"
    df = df.withColumn("_o", once(last_tables_expr(own_t))).withColumn("_d", once(last_tables_expr("header.tables")))
    merged = "array_sort(concat(_o, filter(_d, t -> NOT exists(_o, u -> u.kind = t.kind AND u.slot = t.slot))))"
    df = df.withColumn("_t", once(merged))
    pair = (
        f"{own('sof')} IS NOT NULL AND {own('sos')} IS NOT NULL AND size(_own.sof_ids) = 3 "
        "AND size(array_except(_own.sos_ids, _own.sof_ids)) = 0"
    )
    df = df.withColumn("_pair", once(f"coalesce({pair}, false)"))
    sof = f"CASE WHEN _pair THEN {own('sof')} ELSE header.sof END"
    be = lambda v: f"X'{v:04X}'"
    if height > 0:
        sof = f"concat(substring({sof}, 1, 5), {be(height)}, substring({sof}, 8, 65535))"
    if width > 0:
        sof = f"concat(substring({sof}, 1, 7), {be(width)}, substring({sof}, 10, 65535))"
    dri = f"coalesce({own('dri')}, header.dri, X'')"
    if restart_interval >= 0:
        dri = f"X'FFDD0004{restart_interval:04X}'" if restart_interval > 0 else "X''"
    packed = lambda kind: f"aggregate(filter(_t, t -> t.kind = '{kind}'), X'', (a, t) -> concat(a, t.bytes))"
    df = df.withColumn("_q", once(packed("DQT"))).withColumn("_h", once(packed("DHT")))
    seg = lambda code, body: (
        f"CASE WHEN length({body}) > 0 THEN concat(X'FF{code}', unhex(lpad(hex(length({body}) + 2), 4, '0')), {body}) ELSE X'' END"
    )
    df = df.withColumn("_x", once(own_exif_expr("offset")))
    exif = f"coalesce({cut('content', '_x.off', '2 + _x.seg_len')}, X'')"
    df = df.withColumn(
        "_header",
        once(
            f"concat(X'FFD8', {exif}, header.apps, {seg('DB', '_q')}, {sof}, {seg('C4', '_h')}, {dri}, "
            f"CASE WHEN _pair THEN {own('sos')} ELSE header.sos END)"
        ),
    )
    data = cut("content", "offset", "_end - offset")
    if renumber:
        # Offsets inside the cut data: the markers move with it.
        moved = (
            "transform(filter(markers, x -> x.off >= offset AND x.off + 1 < _end), "
            "x -> named_struct('off', x.off - offset, 'code', x.code))"
        )
        df = df.withColumn("_data", once(data)).withColumn("_mk", once(moved))
        df = df.withColumn("_data", once(renumber_expr("_data", "_mk", "0")))
    else:
        df = df.withColumn("_data", once(data))
    kept = f"""concat(transform(_o, t -> {table_label('t.kind', 't.slot')}),
        CASE WHEN _pair THEN array('SOF', 'SOS') ELSE array() END,
        CASE WHEN {own('dri')} IS NOT NULL THEN array('DRI') ELSE array() END)"""
    return df.select(
        "file_id",
        "donor_id",
        "offset",
        F.expr("length(_header)").alias("header_size"),
        F.expr("_x IS NOT NULL").alias("carried_exif"),
        F.expr(f"array_sort({kept})").alias("kept_own"),
        F.expr(
            "concat(_header, _data, CASE WHEN substring(_data, -2, 2) = X'FFD9' THEN X'' ELSE X'FFD9' END)"
        ).alias("content"),
    )


def table_donors(own: DataFrame, donor: DataFrame, k: int = 5) -> DataFrame:
    """file_id, donor_id, matches, rank: donors sharing the most surviving tables, lowest id first on ties.

    `own`: file_id, kind, slot, bytes; `donor`: donor_id, kind, slot, bytes.
    Standard tables are shared by nearly every camera, so matching files with
    donors, or even their sets of tables, would pair everything with
    everything. Instead every combination of a set's tables (usually six
    tables, so 63) becomes a key that keeps its k lowest donor ids, and a file
    looks up its own combinations: at most k rows each. That is exact: donors
    listed before D under the tables D shares with a file share at least
    those tables and have lower ids, so each of them beats D.
    """
    digest = F.expr("md5(concat(encode(concat(kind, ':', slot, ':'), 'UTF-8'), bytes))")
    subsets = (
        "transform(filter(aggregate(tables, array(named_struct('t', '', 'n', 0)), (a, t) -> concat(a, transform(a, "
        "x -> named_struct('t', concat(x.t, t), 'n', x.n + 1)))), x -> x.n > 0), x -> named_struct('key', md5(x.t), 'n', x.n))"
    )

    def sets(df: DataFrame, key: str) -> DataFrame:
        # At most 4 DQT and 8 DHT slots per file.
        return df.groupBy(key).agg(F.sort_array(F.collect_set(digest)).alias("tables")).withColumn(
            "set_id", F.md5(F.concat_ws(",", "tables"))
        )

    def keys(df: DataFrame, name: str) -> DataFrame:
        """Combinations of each distinct set."""
        return (
            df.groupBy("set_id")
            .agg(F.first("tables").alias("tables"))
            .select(F.col("set_id").alias(name), F.explode(once(subsets)).alias("s"))
            .select(name, "s.key", F.col("s.n").alias("matches"))
        )

    def lowest(df: DataFrame, by: str) -> DataFrame:
        # Limited to k rows per group before the shuffle.
        w = Window.partitionBy(by).orderBy("donor_id")
        return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")

    files, donors = sets(own, "file_id"), sets(donor, "donor_id")
    members = lowest(donors.select(F.col("set_id").alias("donor_set"), "donor_id"), "donor_set")
    listed = lowest(keys(donors, "donor_set").join(members, "donor_set").select("key", "donor_id"), "key")
    best = Window.partitionBy("file_set").orderBy(F.col("matches").desc(), "donor_id")
    answer = (
        keys(files, "file_set")
        .join(listed, "key")
        .groupBy("file_set", "donor_id")
        .agg(F.max("matches").alias("matches"))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
    )
    # Nearly every camera has the same set of tables: its files are spread over copies of the short answer.
    copies = answer.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    spread = files.select(
        "file_id", F.col("set_id").alias("file_set"), F.pmod(F.xxhash64("file_id"), F.lit(SPREAD)).cast("int").alias("_copy")
    )
    return spread.join(copies, ["file_set", "_copy"]).select("file_id", "donor_id", "matches", "rank")
