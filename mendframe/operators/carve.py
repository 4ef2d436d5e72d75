"""Pictures inside other files: disk images, RAW files, thumbnails, appended JPEGs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendframe.functions import names
from mendframe.functions.blocked import blocked_row_number, carried
from mendframe.functions.bytes import be16, cut, u32
from mendframe.functions.lineage import materialize, shuffle_partitions
from mendframe.functions.once import once
from mendframe.operators.markers import with_markers
from mendframe.operators.trailer import with_mp_index

_FIELDS = ["want", "in_scan", "has_scan", "w", "h", "status", "stop", "resume"]
_BLOCK_BYTES = 1 << 30


def picture_expr(start: str, avail: str, n: str, blob: str = "content", markers: str = "markers") -> str:
    """SQL: the picture that begins where the state `start` says, walked to its EOI.

    `avail` bytes of the blob are at hand out of `n`. Result: status 1 with
    `stop` past the EOI, status 2 for no picture, or status 0 with `resume`,
    the offset from which more bytes are needed.
    """

    def st(**over):
        return "named_struct(" + ", ".join(f"'{f}', {over.get(f, 's.' + f)}" for f in _FIELDS) + ")"

    sof = f"s.w IS NULL AND {names.is_sof('x.code')} AND x.seg_len >= 8"
    fail = st(status="2")
    step = f"""CASE
      WHEN s.status <> 0 OR s.resume IS NOT NULL OR x.off < s.want OR x.off >= {n} THEN s
      WHEN s.in_scan AND (x.code = 0 OR {names.is_rst('x.code')}) AND x.off + 1 < {n} THEN s
      WHEN x.off + 10 > {avail} AND {avail} < {n} THEN {st(resume='x.off')}
      WHEN NOT s.in_scan AND x.off - x.fill > s.want THEN {fail}
      WHEN x.code < 0 OR x.off + 1 >= {n} THEN {fail}
      WHEN x.code = 217 THEN {st(status='1', stop='x.off + 2')}
      WHEN {names.is_standalone('x.code')} THEN {st(want='x.off + 2', in_scan='false')}
      WHEN s.has_scan AND NOT {names.may_follow_scan('x.code')} THEN {fail}
      WHEN x.off + 3 >= {n} OR x.seg_len < 2 OR x.off + 2 + x.seg_len > {n} THEN {fail}
      ELSE {st(want='x.off + 2 + x.seg_len', in_scan='x.code = 218', has_scan='s.has_scan OR x.code = 218',
               w=f"CASE WHEN {sof} THEN {be16(blob, 'x.off + 7')} ELSE s.w END",
               h=f"CASE WHEN {sof} THEN {be16(blob, 'x.off + 5')} ELSE s.h END")} END"""
    finish = f"""CASE
      WHEN s.status <> 0 OR s.resume IS NOT NULL THEN s
      WHEN {avail} >= {n} OR (NOT s.in_scan AND s.want < {avail}) THEN {fail}
      ELSE {st(resume=f'greatest(s.want, cast({avail} as bigint))')} END"""
    return f"aggregate({markers}, {start}, (s, x) -> {step}, s -> {finish})"


def _state(want: str, in_scan="false", has_scan="false", w="cast(null as int)", h="cast(null as int)") -> str:
    return (
        f"named_struct('want', cast({want} as bigint), 'in_scan', {in_scan}, 'has_scan', {has_scan}, 'w', {w}, 'h', {h}, "
        "'status', 0, 'stop', cast(null as bigint), 'resume', cast(null as bigint))"
    )


def _complete(walk: str, at: str) -> str:
    return f"{walk}.status = 1 AND {walk}.w > 0 AND {walk}.h > 0 AND {walk}.has_scan"


def _opened_walks() -> str:
    """SQL: off and p, the walk as far as the chunk's bytes go, of every FF D8 FF m (m >= C0) that a chunk owns.

    The walks run inside the row, so the bytes are never copied or shuffled.
    """
    opening = (
        f"x.code = 216 AND x.off < length AND x.off + 3 < total - start "
        f"AND hex({cut('content', 'x.off + 2', 1)}) = 'FF' AND hex({cut('content', 'x.off + 3', 1)}) BETWEEN 'C0' AND 'FE'"
    )
    avail, n = "length(content)", "(total - start)"
    walk = picture_expr(_state("b.off + 2"), avail, n, markers="slice(markers, b.i + 2, size(markers))")
    return (
        f"transform(filter(transform(markers, (x, i) -> CASE WHEN {opening} THEN named_struct('off', x.off, 'i', i) END), "
        f"b -> b IS NOT NULL), b -> named_struct('off', start + b.off, 'p', {walk}))"
    )


def _scan_stops() -> str:
    """SQL: where an FF starts a marker that is neither stuffing nor a restart, in the bytes a chunk owns.

    Few places: entropy-coded data holds almost only the others.
    """
    held = f"filter(markers, x -> x.code <> 0 AND NOT {names.is_rst('x.code')} AND x.off < length)"
    return f"transform({held}, x -> start + x.off)"


def scan_chunks(chunks: DataFrame, key: str) -> DataFrame:
    """key, total, base, f, stop: of one scan of the bytes, a row per opened walk (f) and per place where scan data can end (stop)."""
    rows = (
        "concat(transform(w, f -> named_struct('f', f, 'stop', cast(null as bigint))), "
        "transform(o, stop -> named_struct('f', get(w, -1), 'stop', stop)))"
    )
    return (
        with_markers(chunks)
        .select(key, "total", "start", once(_opened_walks()).alias("w"), once(_scan_stops()).alias("o"))
        .select(key, "total", F.col("start").alias("base"), F.explode(F.expr(rows)).alias("r"))
        .select(key, "total", "base", "r.f", "r.stop")
    )


def candidates(scanned: DataFrame, key: str) -> DataFrame:
    """The opened walks of `scan_chunks`."""
    return scanned.where("f IS NOT NULL").select(key, "total", "f.off", "base", "f.p.*")


def resume(open_walks: DataFrame, load: Callable[[DataFrame], DataFrame], key: str, length: int) -> DataFrame:
    """Continues walks that ran out of bytes: reads `length` more bytes for each, and only those."""
    wanted = open_walks.select(
        key, "total", "off", "in_scan", "has_scan", "w", "h", (F.col("base") + F.col("resume")).alias("start")
    ).withColumn("length", F.lit(length).cast("bigint"))
    walk = picture_expr(
        _state("0", "in_scan", "has_scan", "w", "h"), "length(content)", "(total - start)"
    )
    return (
        with_markers(load(wanted))
        .select(key, "total", "off", F.col("start").alias("base"), once(walk).alias("p"))
        .select(key, "total", "off", "base", "p.*")
    )


def carve(
    chunks: DataFrame,
    key: str = "path",
    load: Callable[[DataFrame], DataFrame] | None = None,
    min_length: int = 0,
    max_count: int | None = None,
    reach: int = 1 << 20,
) -> DataFrame:
    """key, off, length, width, height, rank: every complete JPEG, not counting nested ones.

    `chunks`: key, start, length, total, content, where content holds the
    owned `length` bytes and some overlap. A picture that runs past its
    chunk's bytes is continued by `load`, `reach` bytes at a time, until none
    is left open; without `load` each chunk must be a whole blob. Inside scan
    data a walk goes on at the next marker that can end it, looked up in a table
    of such markers that the same scan of the bytes gives, so the bytes between, or the rest of a blob behind a
    truncated picture, are not read again. Pictures below `min_length` bytes are
    dropped; with `max_count`, the first so many of a blob in offset order are
    kept. They are ranked largest first.
    """
    scanned = scan_chunks(chunks, key)
    if load is None:
        walks = candidates(scanned, key)
    else:
        done, parts = [], shuffle_partitions(chunks.sparkSession)
        scanned = materialize(scanned)
        walks, stops = candidates(scanned, key), scanned.where("stop IS NOT NULL").select(key, "stop")
        while True:
            done.append(walks.where("status <> 0"))
            pending = walks.where("status = 0")
            if pending.isEmpty():
                break
            # Only open walks travel; their number falls with every round. They are few bytes, but not little work.
            walks = materialize(resume(at_next_stop(pending, stops, key).repartition(parts, key, "off"), load, key, reach))
        walks = done[0]
        for part in done[1:]:
            walks = walks.unionByName(part)
    found = walks.where(_complete("p", "off").replace("p.", "")).select(
        key,
        "off",
        (F.col("base") + F.col("stop")).alias("end"),
        F.col("w").alias("width"),
        F.col("h").alias("height"),
    ).where(F.col("end") - F.col("off") >= min_length)
    # One row per picture, needed several times below: the bytes are scanned once.
    outer = not_nested(materialize(found), key)
    sized = materialize(outer.withColumn("length", F.col("end") - F.col("off")))
    if max_count is not None:
        numbered = blocked_row_number(sized, [key], ["off"], F.expr(f"off div {_BLOCK_BYTES}"), "_n")
        sized = numbered.where(F.col("_n") < max_count)
    sized = sized.withColumn("_smaller", -F.col("length"))
    ranked = blocked_row_number(sized, [key], ["_smaller", "off"], F.expr("-(length div 16384)"), "_rank")
    return ranked.select(key, "off", "length", "width", "height", (F.col("_rank") + 1).alias("rank"))


def at_next_stop(pending: DataFrame, stops: DataFrame, key: str) -> DataFrame:
    """Open walks moved to where they go on: those inside scan data to the next stop, or dropped without one."""
    cols = pending.columns
    at = F.col("base") + F.col("resume")
    waiting = pending.where("in_scan").select(key, at.alias("pos"), F.struct(*cols).alias("walk"))
    both = waiting.withColumn("stop", F.lit(None).cast("bigint")).unionByName(
        stops.select(key, F.col("stop").alias("pos"), F.lit(None).cast(waiting.schema["walk"].dataType).alias("walk"), "stop")
    )
    seen = carried(both, [key], ["pos"], F.expr(f"pos div {_BLOCK_BYTES}"), F.col("stop"), "min", "next", backwards=True)
    # Equal places: a stop right where the walk waits is its next one.
    same = stops.select(key, F.col("stop").alias("_here"))
    moved = (
        seen.where("walk IS NOT NULL")
        .join(same, (seen[key] == same[key]) & (F.col("pos") == F.col("_here")), "left")
        .select("walk", F.coalesce("_here", "next").alias("go"))
        .where("go IS NOT NULL")
        .select("walk.*", "go")
        .withColumn("resume", F.col("go") - F.col("base"))
        .select(*cols)
    )
    return pending.where("NOT in_scan").unionByName(moved)


def not_nested(found: DataFrame, key: str) -> DataFrame:
    """Drops intervals that begin inside an earlier kept one.

    Intervals that touch form an island; an island is decided on its own, so
    only the few pictures of one island ever meet in a group.
    """
    block = F.expr(f"off div {_BLOCK_BYTES}")
    reach = carried(found, [key], ["off"], block, F.col("end"), "max", "_reach", inclusive=False)
    opens = F.when(F.col("_reach").isNull() | (F.col("off") >= F.col("_reach")), F.col("off"))
    islands = carried(reach, [key], ["off"], block, opens, "max", "_island")
    # Most islands are one picture: only the others are grouped.
    keep = """aggregate(array_sort(collect_list(struct(off, end, width, height))),
        named_struct('until', -1L, 'kept', cast(array() as array<struct<off:bigint,end:bigint,width:int,height:int>>)),
        (s, x) -> CASE WHEN x.off < s.until THEN s
                  ELSE named_struct('until', x.end, 'kept', concat(s.kept, array(x))) END, s -> s.kept)"""
    return (
        islands.groupBy(key, "_island").agg(F.expr(keep).alias("k")).select(key, F.explode("k").alias("k")).select(key, "k.*")
    )


def whole_blobs(files: DataFrame) -> DataFrame:
    """Files as chunks of one piece each, for `carve`."""
    return files.select(
        "file_id", F.lit(0).cast("bigint").alias("start"), F.expr("cast(length(content) as bigint)").alias("length"),
        F.expr("cast(length(content) as bigint)").alias("total"), "content",
    )


def with_embedded(files: DataFrame) -> DataFrame:
    """Adds `embedded`, an array of off, length, width, height, origin: other complete JPEGs inside each file.

    Pictures named by the MP index come first; then every other SOI past the
    first byte that walks to an EOI, skipping what lies inside one already
    taken. All of it happens inside the file's row.
    """
    df = with_mp_index(with_markers(files))
    size, off = "i.size", "(mp.header + i.offset)"
    n = "length(content)"
    entry = "mp.entries + 16 * k"
    listed = (
        f"transform(CASE WHEN mp.count > 1 THEN sequence(1, mp.count - 1) ELSE cast(array() as array<int>) END, k -> "
        f"named_struct('k', k, 'size', {u32('content', entry + ' + 4', 'mp.little')}, "
        f"'offset', {u32('content', entry + ' + 8', 'mp.little')}))"
    )
    from_index = picture_expr(_state(f"{off} + 2"), f"({off} + {size})", f"({off} + {size})",
                              markers=f"filter(markers, y -> y.off >= {off} AND y.off < {off} + {size})")
    mpf = f"""transform(filter({listed}, i -> {off} > 0 AND {off} < {n} AND {size} > 0 AND {off} + {size} <= {n}
             AND {cut('content', off, 2)} = X'FFD8'), i -> named_struct('off', {off}, 'k', i.k, 'p', {from_index}))"""
    other = picture_expr(_state("b.off + 2"), n, n, markers="slice(markers, b.i + 2, size(markers))")
    soi = f"x.code = 216 AND x.off > 0 AND x.off + 3 < {n} AND {cut('content', 'x.off + 2', 1)} = X'FF'"
    found = f"""transform(filter(transform(markers, (x, i) -> CASE WHEN {soi} THEN named_struct('off', x.off, 'i', i) END),
             b -> b IS NOT NULL), b -> named_struct('off', b.off, 'k', -1, 'p', {other}))"""
    good = lambda c: f"filter({c}, t -> t.p.status = 1 AND t.p.w > 0 AND t.p.h > 0 AND t.p.has_scan)"
    df = df.withColumn("_mpf", once(good(mpf))).withColumn("_all", once(good(found)))
    item = "struct<off:bigint,k:int,p:struct<want:bigint,in_scan:boolean,has_scan:boolean,w:int,h:int,status:int,stop:bigint,resume:bigint>>"
    greedy = f"""aggregate(filter(_all, t -> NOT exists(_mpf, u -> u.off = t.off)),
        named_struct('until', 0L, 'kept', cast(array() as array<{item}>)),
        (s, x) -> CASE WHEN x.off < s.until THEN s ELSE named_struct('until', x.p.stop, 'kept', concat(s.kept, array(x))) END,
        s -> s.kept)"""
    inside = "get(filter(walk.segs, g -> e.off > g.off AND e.off < g.off + g.length), 0)"
    origin = f"""CASE WHEN e.k >= 0 THEN concat('MPF image ', e.k + 1)
        WHEN walk.image_end IS NOT NULL AND e.off >= walk.image_end THEN 'JPEG after the image'
        WHEN {inside}.marker = 225 THEN 'Exif thumbnail'
        WHEN {inside} IS NOT NULL THEN concat('preview in APP', {inside}.marker - 224, ' segment')
        ELSE 'embedded JPEG' END"""
    df = df.withColumn("_found", once(f"concat(_mpf, {greedy})"))
    return df.withColumn(
        "embedded",
        once(
            f"transform(_found, e -> named_struct('off', e.off, 'length', e.p.stop - e.off, 'width', e.p.w, "
            f"'height', e.p.h, 'origin', {origin}))"
        ),
    ).drop("_mpf", "_all", "_found", "mp")


def embedded(files: DataFrame) -> DataFrame:
    """file_id, off, length, width, height, origin."""
    return with_embedded(files).select("file_id", F.explode("embedded").alias("e")).select("file_id", "e.*")
