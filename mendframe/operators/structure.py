"""Marker segments, scans and frame headers.

Walking a JPEG is a pointer chase. It is written as an `aggregate` fold over
the marker array of the row itself, so a file never leaves its partition: all
operators here are projections of the scan, with no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendframe.functions import names
from mendframe.functions.bytes import be16, cut, latin1, u8
from mendframe.functions.once import once
from mendframe.operators.markers import with_markers

_SEG = "struct<marker:int,off:bigint,length:bigint,data_off:bigint,data_length:bigint>"
_SCAN = "struct<sos_off:bigint,data_start:bigint,data_end:bigint,restart_markers:bigint>"


def _seg(marker, off, length, data_off="cast(null as bigint)", data_length="0L") -> str:
    return (
        f"named_struct('marker', {marker}, 'off', {off}, 'length', {length}, "
        f"'data_off', {data_off}, 'data_length', {data_length})"
    )


# Walk: from the SOI until the EOI or the first thing that is not a JPEG.
_WALK_FIELDS = ["want", "in_scan", "n_scans", "rst", "sos", "image_end", "problem", "problem_at", "segs", "scans"]


def _walk_state(**over: str) -> str:
    return "named_struct(" + ", ".join(f"'{f}', {over.get(f, 's.' + f)}" for f in _WALK_FIELDS) + ")"


def walk_expr(blob: str = "content", markers: str = "markers", n: str = "length(content)") -> str:
    """SQL: walk of the first `n` bytes, as a struct (see `_WALK_FIELDS`)."""
    closed = (
        "CASE WHEN s.in_scan THEN concat(s.scans, array(named_struct('sos_off', s.sos, "
        "'data_start', s.want, 'data_end', greatest(x.off - x.fill, s.want), 'restart_markers', s.rst))) "
        "ELSE s.scans END"
    )

    def stop(problem: str, at: str, **over: str) -> str:
        return _walk_state(problem=f"'{problem}'", problem_at=at, scans=closed, in_scan="false", **over)

    start = (
        "named_struct('want', 2L, 'in_scan', false, 'n_scans', 0, 'rst', 0L, 'sos', 0L, "
        "'image_end', cast(null as bigint), "
        f"'problem', CASE WHEN {n} < 4 OR {cut(blob, '0', 2)} <> X'FFD8' THEN 'no_soi' END, "
        "'problem_at', cast(null as bigint), "
        f"'segs', CASE WHEN {n} < 4 OR {cut(blob, '0', 2)} <> X'FFD8' THEN cast(array() as array<{_SEG}>) "
        f"ELSE array({_seg('216', '0L', '2L')}) END, "
        f"'scans', cast(array() as array<{_SCAN}>))"
    )
    step = f"""CASE
      WHEN s.problem IS NOT NULL OR s.image_end IS NOT NULL OR x.off < s.want OR x.off >= {n} THEN s
      WHEN s.in_scan AND x.code = 0 THEN s
      WHEN s.in_scan AND {names.is_rst('x.code')} AND x.off + 1 < {n} THEN {_walk_state(rst='s.rst + 1L')}
      WHEN NOT s.in_scan AND x.off - x.fill > s.want THEN {stop('not_a_marker', 's.want')}
      WHEN x.off + 1 >= {n} OR x.code < 0 THEN {stop('ends_in_padding', 's.want')}
      WHEN x.code = 217 THEN {_walk_state(image_end='x.off + 2', scans=closed, in_scan='false',
                                          segs=f"concat(s.segs, array({_seg('217', 'x.off', '2L')}))")}
      WHEN {names.is_standalone('x.code')} THEN {_walk_state(want='x.off + 2', scans=closed, in_scan='false',
                                          segs=f"concat(s.segs, array({_seg('x.code', 'x.off', '2L')}))")}
      WHEN s.n_scans > 0 AND NOT {names.may_follow_scan('x.code')} THEN {stop('illegal_pair', 'x.off')}
      WHEN x.off + 3 >= {n} THEN {stop('mid_segment', 'x.off')}
      WHEN x.seg_len < 2 OR x.off + 2 + x.seg_len > {n} THEN {stop('length_past_end', 'x.off')}
      ELSE {_walk_state(want='x.off + 2 + x.seg_len', scans=closed, rst='0L', sos='x.off',
                        in_scan='x.code = 218', n_scans='s.n_scans + CASE WHEN x.code = 218 THEN 1 ELSE 0 END',
                        segs="concat(s.segs, array(" + _seg('x.code', 'x.off', 'cast(x.seg_len + 2 as bigint)',
                                                             'x.off + 4', 'cast(x.seg_len - 2 as bigint)') + "))")}
      END"""
    finish = f"""CASE
      WHEN s.problem IS NOT NULL OR s.image_end IS NOT NULL THEN s
      WHEN s.in_scan THEN {_walk_state(problem="'ends_in_data'", problem_at=f"cast({n} as bigint)", in_scan="false",
          scans="concat(s.scans, array(named_struct('sos_off', s.sos, 'data_start', s.want, "
                f"'data_end', cast({n} as bigint), 'restart_markers', s.rst)))")}
      WHEN s.want >= {n} THEN {_walk_state(problem="'ends_before_eoi'", problem_at=f"cast({n} as bigint)")}
      ELSE {_walk_state(problem="'not_a_marker'", problem_at='s.want')} END"""
    return f"aggregate({markers}, {start}, (s, x) -> {step}, s -> {finish})"


def with_walk(files: DataFrame) -> DataFrame:
    """Adds `markers` and `walk` (segs, scans, image_end, problem, problem_at)."""
    if "walk" in files.columns:
        return files
    return with_markers(files).withColumn("walk", once(walk_expr()))


def segment_walk(files: DataFrame) -> DataFrame:
    """file_id, seg_no, marker, off, length, data_off, data_length."""
    return with_walk(files).select("file_id", F.posexplode("walk.segs").alias("seg_no", "g")).select(
        "file_id", "seg_no", "g.marker", "g.off", "g.length", "g.data_off", "g.data_length"
    )


def walk_status(files: DataFrame) -> DataFrame:
    """file_id, segments, image_end, problem, problem_at: how the walk of each file ended."""
    return with_walk(files).select(
        "file_id", F.size("walk.segs").alias("segments"), "walk.image_end", "walk.problem", "walk.problem_at"
    )


def scans(files: DataFrame) -> DataFrame:
    """One row per scan, with its header fields and where its data lies."""
    payload = "sc.sos_off + 4"
    # The scan's payload runs from the SOS header to the start of its data.
    plen = "(sc.data_start - sc.sos_off - 4)"
    n_raw = u8("content", payload)
    tail = f"({payload} + 1 + 2 * n_raw)"
    has_tail = f"(1 + 2 * n_raw + 2 < {plen})"
    return (
        with_walk(files)
        .select("file_id", "content", "walk", F.posexplode("walk.scans").alias("scan_no", "sc"))
        .withColumn("n_raw", F.expr(f"CASE WHEN {plen} >= 1 THEN {n_raw} ELSE 0 END"))
        .withColumn("n_comp", F.expr("least(n_raw, 4)"))
        .select(
            "file_id",
            "scan_no",
            "sc.sos_off",
            "sc.data_start",
            "sc.data_end",
            "n_comp",
            F.expr(
                "transform(CASE WHEN n_comp > 0 THEN sequence(0, n_comp - 1) ELSE cast(array() as array<int>) END, "
                f"i -> CASE WHEN 1 + 2 * i < {plen} THEN {u8('content', f'{payload} + 1 + 2 * i')} ELSE 0 END)"
            ).alias("component_ids"),
            F.expr(f"CASE WHEN {has_tail} THEN {u8('content', tail)} ELSE 0 END").alias("ss"),
            F.expr(f"CASE WHEN {has_tail} THEN {u8('content', f'{tail} + 1')} ELSE 63 END").alias("se"),
            F.expr(f"CASE WHEN {has_tail} THEN shiftright({u8('content', f'{tail} + 2')}, 4) ELSE 0 END").alias("ah"),
            F.expr(f"CASE WHEN {has_tail} THEN {u8('content', f'{tail} + 2')} & 15 ELSE 0 END").alias("al"),
            "sc.restart_markers",
            F.expr(
                "CASE WHEN walk.problem = 'illegal_pair' AND scan_no = size(walk.scans) - 1 "
                "THEN walk.problem_at END"
            ).alias("first_illegal"),
        )
    )


def describe_scan(scan_rows: DataFrame) -> DataFrame:
    """Adds `description`, such as 'DC, all components, first pass at bit 1'."""
    band = "CASE WHEN ss = 0 AND se = 63 THEN 'full' WHEN ss = 0 THEN 'DC' ELSE concat('AC ', ss, '-', se) END"
    comps = (
        "CASE WHEN n_comp >= 3 THEN 'all components' ELSE array_join(transform(component_ids, c -> "
        "CASE c WHEN 1 THEN 'Y' WHEN 2 THEN 'Cb' WHEN 3 THEN 'Cr' ELSE concat('#', c) END), ', ') END"
    )
    tail = (
        "CASE WHEN ah > 0 THEN concat(', refining bit ', al) "
        "WHEN al > 0 THEN concat(', first pass at bit ', al) ELSE '' END"
    )
    return scan_rows.withColumn("description", F.expr(f"concat({band}, ', ', {comps}, {tail})"))


def frame_expr(walk: str = "walk") -> str:
    """SQL: the SOFn segment that describes the picture, or NULL."""
    return f"get(filter({walk}.segs, g -> {names.is_sof('g.marker')} AND g.data_length >= 6), 0)"


def restart_interval_expr(walk: str = "walk", blob: str = "content") -> str:
    return (
        f"coalesce({be16(blob, f'try_element_at(filter({walk}.segs, g -> g.marker = 221 AND g.data_length >= 2), -1).data_off')}, 0)"
    )


def with_frame(files: DataFrame) -> DataFrame:
    """Adds `frame`: header fields of the picture as a struct, NULL without a frame header.

    The MCU is 8 times the largest sampling factors, except that a
    single-component scan is not interleaved and has one block per MCU.
    """
    df = with_walk(files)
    if "frame" in df.columns:
        return df
    p = "_sof.data_off"
    df = df.withColumn("_sof", F.expr(frame_expr()))
    df = df.withColumn("_nc", F.expr(f"{u8('content', f'{p} + 5')}")).withColumn(
        "_samp",
        F.expr(
            "CASE WHEN _nc > 0 THEN transform(filter(sequence(0, _nc - 1), i -> 6 + 3 * i + 2 < _sof.data_length), "
            f"i -> {u8('content', f'{p} + 7 + 3 * i')}) END"
        ),
    )
    df = df.withColumn(
        "_hv",
        F.expr(
            "named_struct('h', transform(_samp, v -> cast(shiftright(v, 4) as int)), 'v', transform(_samp, v -> v & 15))"
        ),
    ).withColumn(
        "_unit",
        F.expr(
            "named_struct('mw', CASE WHEN _nc = 1 THEN 8 ELSE 8 * array_max(_hv.h) END, "
            "'mh', CASE WHEN _nc = 1 THEN 8 ELSE 8 * array_max(_hv.v) END, "
            f"'w', {be16('content', f'{p} + 3')}, 'h', {be16('content', f'{p} + 1')})"
        ),
    )
    return df.withColumn(
        "frame",
        once(
            "CASE WHEN _sof IS NOT NULL THEN named_struct('frame_marker', _sof.marker, 'off', _sof.off, "
            "'width', _unit.w, 'height', _unit.h, 'components', _nc, "
            "'h_samp', _hv.h, 'v_samp', _hv.v, 'mcu_w', _unit.mw, 'mcu_h', _unit.mh, "
            "'mcus_x', cast(ceil(_unit.w / nullif(_unit.mw, 0)) as int), "
            "'mcus_y', cast(ceil(_unit.h / nullif(_unit.mh, 0)) as int), "
            f"'restart_interval', {restart_interval_expr()}, "
            "'progressive', _sof.marker IN (194, 198, 202), 'scan_count', size(walk.scans), "
            # What a decoder needs before it can start: a sane frame and a scan.
            "'readable', _unit.w > 0 AND _unit.h > 0 AND _nc BETWEEN 1 AND 4 AND size(_hv.h) = _nc "
            "AND forall(_hv.h, k -> k BETWEEN 1 AND 4) AND forall(_hv.v, k -> k BETWEEN 1 AND 4) "
            "AND size(walk.scans) > 0) END"
        ),
    ).drop("_sof", "_nc", "_samp", "_hv", "_unit")


def frame_info(files: DataFrame) -> DataFrame:
    """file_id and the frame columns; files without a frame header are left out."""
    return with_frame(files).where("frame IS NOT NULL").select("file_id", "frame.*")


def sampling_name(frames: DataFrame) -> DataFrame:
    """Adds `sampling`: grayscale, 4:2:0, 2x2 and so on."""
    simple = "get(h_samp, 1) = 1 AND get(h_samp, 2) = 1 AND get(v_samp, 1) = 1 AND get(v_samp, 2) = 1"
    return frames.withColumn(
        "sampling",
        F.expr(
            f"""CASE WHEN components = 1 THEN 'grayscale'
            WHEN components <> 3 THEN concat(components, ' components')
            WHEN NOT ({simple}) THEN array_join(zip_with(h_samp, v_samp, (h, v) -> concat(h, 'x', v)), ', ')
            WHEN get(h_samp, 0) = 1 AND get(v_samp, 0) = 1 THEN '4:4:4' WHEN get(h_samp, 0) = 2 AND get(v_samp, 0) = 1 THEN '4:2:2'
            WHEN get(h_samp, 0) = 2 AND get(v_samp, 0) = 2 THEN '4:2:0' WHEN get(h_samp, 0) = 1 AND get(v_samp, 0) = 2 THEN '4:4:0'
            WHEN get(h_samp, 0) = 4 AND get(v_samp, 0) = 1 THEN '4:1:1'
            ELSE concat(get(h_samp, 0), 'x', get(v_samp, 0)) END"""
        ),
    )


def unit_name(frames: DataFrame) -> DataFrame:
    """file_id, unit, unit_name: what each block of an MCU belongs to ('Y2', 'Cb')."""
    per = "transform(sequence(0, components - 1), c -> get(h_samp, c) * get(v_samp, c))"
    label = (
        "CASE WHEN c = 0 THEN 'Y' WHEN components <> 3 THEN 'C' WHEN c = 1 THEN 'Cb' ELSE 'Cr' END"
    )
    return (
        frames.where("components BETWEEN 1 AND 4 AND size(h_samp) = components")
        .select("file_id", "components", F.posexplode(F.expr(per)).alias("c", "n"), F.expr(per).alias("_per"))
        .select(
            "file_id",
            "c",
            "n",
            F.expr("aggregate(slice(_per, 1, c), 0, (a, b) -> a + b)").alias("base"),
            F.expr(label).alias("label"),
            F.explode(F.expr("CASE WHEN n > 0 THEN sequence(0, n - 1) END")).alias("k"),
        )
        .select(
            "file_id",
            F.expr("base + k").alias("unit"),
            F.expr("CASE WHEN n > 1 THEN concat(label, k + 1) ELSE label END").alias("unit_name"),
        )
    )


def find_segment_expr(marker: int, signature_hex: str = "", walk: str = "walk", blob: str = "content") -> str:
    """SQL: first segment with this marker whose payload starts with the signature."""
    test = f"g.marker = {marker}"
    if signature_hex:
        n = len(signature_hex) // 2
        test += f" AND g.data_length >= {n} AND {cut(blob, 'g.data_off', n)} = X'{signature_hex}'"
    return f"get(filter({walk}.segs, g -> {test}), 0)"


def find_segment(files: DataFrame, marker: int, signature: bytes = b"") -> DataFrame:
    """file_id, off, length, data_off, data_length of the first match per file."""
    expr = find_segment_expr(marker, signature.hex().upper())
    return (
        with_walk(files)
        .select("file_id", F.expr(expr).alias("g"))
        .where("g IS NOT NULL")
        .select("file_id", "g.off", "g.length", "g.data_off", "g.data_length")
    )


_TABLE = "struct<kind:string,slot:int,bytes:binary>"


def tables_expr(segs: str, blob: str = "content") -> str:
    """SQL: tables of the DQT and DHT segments in `segs`, in file order.

    A segment may hold several tables back to back; reading it stops at the
    first one that does not fit. A DQT table takes 65 bytes or 129, a DHT
    table 17 plus the sum of its 16 counts, so a payload holds at most one
    table per 17 bytes.
    """
    at = "g.data_off + t.i"
    first = u8(blob, at)
    # One hex string per DHT header is enough for its 16 counts.
    counts = (
        "aggregate(sequence(0, 15), 0, (a, j) -> a + cast(conv(substring(hx, 2 * j + 1, 2), 16, 10) as int))"
    )
    # `let` by a one-element transform: Spark SQL has no inline binding.
    dqt = f"""get(transform(array({first}), b -> named_struct('id', b & 15, 'size', 1 + CASE WHEN b >= 16 THEN 128 ELSE 64 END,
        'ok', (b & 15) <= 3)), 0)"""
    dht = f"""get(transform(array({first}), b -> get(transform(array(hex({cut(blob, at + ' + 1', 16)})), hx ->
        get(transform(array({counts}), n -> named_struct('id', b, 'size', 17 + n,
        'ok', (b & 15) <= 3 AND b < 32 AND n <= 256)), 0)), 0)), 0)"""
    take = f"""get(transform(array(CASE WHEN g.marker = 219 THEN {dqt} ELSE {dht} END), h ->
        CASE WHEN h.ok AND t.i + h.size <= g.data_length
        THEN named_struct('i', cast(t.i + h.size as bigint), 'done', false, 'out', concat(t.out, array(named_struct(
              'kind', CASE WHEN g.marker = 219 THEN 'DQT' ELSE 'DHT' END, 'slot', cast(h.id as int),
              'bytes', {cut(blob, at, 'h.size')}))))
        ELSE named_struct('i', t.i, 'done', true, 'out', t.out) END), 0)"""
    inner = f"""aggregate(sequence(1L, 1 + g.data_length div 17),
        named_struct('i', 0L, 'done', false, 'out', cast(array() as array<{_TABLE}>)),
        (t, k) -> CASE WHEN t.done OR t.i >= g.data_length OR (g.marker = 196 AND t.i + 17 > g.data_length)
                  THEN t ELSE {take} END, t -> t.out)"""
    return f"flatten(transform(filter({segs}, g -> g.marker IN (196, 219)), g -> {inner}))"


def last_tables_expr(ts: str) -> str:
    """SQL: of several definitions of a slot the last one, within the row."""
    return f"filter({ts}, (t, i) -> NOT exists(slice({ts}, i + 2, size({ts})), u -> u.kind = t.kind AND u.slot = t.slot))"


def tables(files: DataFrame) -> DataFrame:
    """file_id, kind, slot, bytes: quantization and Huffman tables; the last definition of a slot wins."""
    listed = with_walk(files).select("file_id", F.expr(tables_expr("walk.segs")).alias("ts"))
    return listed.select("file_id", F.explode(F.expr(last_tables_expr("ts"))).alias("t")).select("file_id", "t.*")


def segment_inventory(files: DataFrame) -> DataFrame:
    """file_id, seg_no, name, off, length, signature (first 12 payload bytes of an APPn)."""
    sig = latin1(cut("content", "g.data_off", "least(g.data_length, 12)"))
    return with_walk(files).select(
        "file_id", "content", F.posexplode("walk.segs").alias("seg_no", "g")
    ).select(
        "file_id",
        "seg_no",
        F.expr(names.marker_name("g.marker")).alias("name"),
        "g.off",
        "g.length",
        F.expr(
            f"CASE WHEN g.marker BETWEEN 224 AND 239 AND g.data_off IS NOT NULL "
            f"THEN trim(translate({sig}, chr(0), ' ')) ELSE '' END"
        ).alias("signature"),
    )


def restart_expr(markers: str = "markers", start: str = "0", end: str = "length(content)") -> str:
    """SQL: restart markers with offsets in [start, end), in order."""
    return f"filter({markers}, x -> {names.is_rst('x.code')} AND x.off >= {start} AND x.off < {end})"


def restart_audit(files: DataFrame) -> DataFrame:
    """file_id, restarts, out_of_order, missing, for files that declare restarts.

    The k-th restart of the first scan should carry the number after its
    predecessor's, modulo 8, starting at 0; a jump counts the numbers it skips.
    """
    df = with_walk(files).withColumn("_ri", F.expr(restart_interval_expr())).where(
        "_ri > 0 AND size(walk.scans) > 0"
    )
    df = df.select(
        "file_id",
        F.expr(f"transform({restart_expr('markers', 'get(walk.scans, 0).data_start', 'get(walk.scans, 0).data_end')}, x -> x.code - 208)").alias("nums"),
    ).withColumn(
        "gaps",
        F.expr("transform(nums, (n, i) -> pmod(n - CASE WHEN i = 0 THEN -1 ELSE get(nums, i - 1) END, 8))"),
    )
    return df.select(
        "file_id",
        F.size("nums").alias("restarts"),
        F.expr("size(filter(gaps, g -> g <> 1))").alias("out_of_order"),
        F.expr("aggregate(gaps, 0, (a, g) -> a + pmod(g - 1, 8))").alias("missing"),
    )


def renumber_restarts(files: DataFrame) -> DataFrame:
    """file_id, off, old, new for each restart marker of the scan data, first one becoming RST0.

    Gaps between numbers are kept. `renumbered_content` applies the result.
    """
    df = with_walk(files).where("size(walk.scans) > 0")
    rst = restart_expr("markers", "get(walk.scans, 0).data_start", "length(content)")
    return (
        df.select("file_id", F.expr(rst).alias("r"))
        .select("file_id", "r", F.expr("get(r, 0).code").alias("first"))
        .select("file_id", "first", F.explode("r").alias("x"))
        .select(
            "file_id",
            "x.off",
            F.expr("x.code - 208").alias("old"),
            F.expr("pmod(x.code - first, 8)").alias("new"),
        )
    )


def renumbered_content(files: DataFrame) -> DataFrame:
    """file_id, content: files with a scan, their restart markers renumbered as `renumber_restarts` says."""
    df = with_walk(files).where("size(walk.scans) > 0")
    return df.select("file_id", once(renumber_expr("content", "markers", "get(walk.scans, 0).data_start")).alias("content"))


def renumber_expr(blob: str, markers: str, start: str) -> str:
    """SQL: `blob` with its restart markers from `start` on renumbered from RST0.

    Bytes are reassembled from the pieces between changed markers.
    """
    rst = restart_expr(markers, start, f"length({blob})")
    return f"""get(transform(array({rst}), r -> aggregate(
        filter(r, x -> pmod(x.code - get(r, 0).code, 8) <> x.code - 208),
        named_struct('at', 0L, 'parts', cast(array() as array<binary>)),
        (a, x) -> named_struct('at', x.off + 2, 'parts', concat(a.parts, array(
            {cut(blob, 'a.at', 'x.off + 1 - a.at')},
            unhex(hex(208 + pmod(x.code - get(r, 0).code, 8)))))),
        a -> aggregate(concat(a.parts, array({cut(blob, 'a.at', f'length({blob}) - a.at')})),
                       X'', (b, p) -> concat(b, p)))), 0)"""
