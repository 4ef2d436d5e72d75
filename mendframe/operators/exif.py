"""Exif: entries as rows, and the few facts the other operators ask for.

An Exif block lives inside one APP1 segment (64 KiB at most), so everything
is read inside the file's row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendframe.functions.bytes import cut, latin1, u16, u32
from mendframe.functions.once import once
from mendframe.operators.structure import with_frame, with_walk

_ENTRY = "struct<ifd:string,at:bigint,tag:int,type:int,count:bigint,value:bigint>"


def with_exif(files: DataFrame) -> DataFrame:
    """Adds `exif` (tiff, size, little) and `exif_rows` (ifd, at, tag, type, count, value).

    The header is read segment by segment up to the first scan; the first
    Exif APP1 decides. `value` is the 4-byte field as a number, or the short
    in it when the type is SHORT and the count 1.
    """
    if "exif_rows" in files.columns:
        return files
    df = with_walk(files)
    seg = (
        f"get(filter(walk.segs, g -> g.marker = 225 AND g.data_length >= 14 "
        f"AND {cut('content', 'g.data_off', 6)} = X'457869660000' "
        "AND NOT exists(walk.segs, k -> k.marker = 218 AND k.off < g.off)), 0)"
    )
    df = df.withColumn("_g", once(seg))
    df = df.withColumn(
        "exif",
        once(
            f"""CASE WHEN {cut('content', '_g.data_off + 6', 2)} IN (X'4949', X'4D4D') THEN named_struct(
            'tiff', _g.data_off + 6, 'size', _g.data_length - 6,
            'little', {cut('content', '_g.data_off + 6', 2)} = X'4949') END"""
        ),
    )
    t, little = "exif.tiff", "exif.little"

    def rows(ifd: str, label: str) -> str:
        """Entries of the IFD at TIFF offset `ifd`, up to the first one out of bounds."""
        e = f"{ifd} + 2 + 12 * i"
        n = u16("content", f"{t} + {ifd}", little)
        value = (
            f"CASE WHEN {u16('content', f'{t} + {e} + 2', little)} = 3 AND {u32('content', f'{t} + {e} + 4', little)} = 1 "
            f"THEN cast({u16('content', f'{t} + {e} + 8', little)} as bigint) ELSE {u32('content', f'{t} + {e} + 8', little)} END"
        )
        return (
            f"CASE WHEN {ifd} > 0 AND {ifd} + 2 <= exif.size AND {n} > 0 THEN transform(filter(sequence(0, {n} - 1), "
            f"i -> {e} + 12 <= exif.size), i -> named_struct('ifd', '{label}', 'at', cast({e} as bigint), "
            f"'tag', {u16('content', f'{t} + {e}', little)}, 'type', {u16('content', f'{t} + {e} + 2', little)}, "
            f"'count', {u32('content', f'{t} + {e} + 4', little)}, 'value', {value})) "
            f"ELSE cast(array() as array<{_ENTRY}>) END"
        )

    df = df.withColumn("_ifd0", once(f"CASE WHEN exif.size >= 8 THEN {u32('content', f'{t} + 4', little)} END"))
    df = df.withColumn("_n0", once(f"CASE WHEN _ifd0 + 2 <= exif.size THEN {u16('content', f'{t} + _ifd0', little)} END"))
    df = df.withColumn(
        "_ifd1",
        once(
            f"CASE WHEN _ifd0 + 2 + 12 * _n0 + 4 <= exif.size THEN {u32('content', f'{t} + _ifd0 + 2 + 12 * _n0', little)} END"
        ),
    )
    df = df.withColumn("_r0", once(rows("_ifd0", "IFD0"))).withColumn("_r1", once(rows("_ifd1", "IFD1")))
    df = df.withColumn(
        "_sub", once("get(filter(_r0, r -> r.tag = 34665 AND r.count = 1 AND r.type IN (3, 4)), 0).value")
    )
    df = df.withColumn("_r2", once(rows("_sub", "Exif")))
    return df.withColumn("exif_rows", once("concat(_r0, _r2, _r1)")).drop(
        "_g", "_ifd0", "_n0", "_ifd1", "_r0", "_r1", "_r2", "_sub"
    )


def exif_entries(files: DataFrame) -> DataFrame:
    """file_id, ifd, tag, type, count, value."""
    return (
        with_exif(files)
        .select("file_id", F.explode("exif_rows").alias("r"))
        .select("file_id", "r.ifd", "r.tag", "r.type", "r.count", "r.value")
    )


def _first(ifd: str, tag: int) -> str:
    return f"get(filter(exif_rows, r -> r.ifd = '{ifd}' AND r.tag = {tag}), 0)"


def _scalar(ifd: str, tag: int) -> str:
    r = _first(ifd, tag)
    return f"CASE WHEN {r}.count = 1 AND {r}.type IN (3, 4) THEN {r}.value END"


def _ascii(tag: int) -> str:
    r = _first("IFD0", tag)
    at = f"CASE WHEN {r}.count <= 4 THEN {r}.at + 8 ELSE {r}.value END"
    text = latin1(cut("content", f"exif.tiff + ({at})", f"{r}.count"))
    return (
        f"coalesce(CASE WHEN {r}.type = 2 AND ({at}) + {r}.count <= exif.size "
        f"THEN replace(trim(rtrim({text})), chr(0), '') END, '')"
    )


def with_camera(files: DataFrame) -> DataFrame:
    """Adds `camera`: make and model, or the model alone when it starts with the make."""
    df = with_exif(files).withColumn("_make", once(f"rtrim({_ascii(271)})")).withColumn(
        "_model", once(f"rtrim({_ascii(272)})")
    )
    return df.withColumn(
        "camera",
        once(
            "CASE WHEN _make = '' OR startswith(lower(_model), lower(_make)) THEN _model "
            "ELSE concat(_make, ' ', _model) END"
        ),
    ).drop("_make", "_model")


def camera_model(files: DataFrame) -> DataFrame:
    """file_id, camera; empty without Exif."""
    return with_camera(files).select("file_id", "camera")


def orientation(files: DataFrame) -> DataFrame:
    """file_id, orientation: 1 to 8, 1 when absent or out of range."""
    v = _scalar("IFD0", 274)
    return with_exif(files).select(
        "file_id", F.expr(f"CASE WHEN {v} BETWEEN 1 AND 8 THEN cast({v} as int) ELSE 1 END").alias("orientation")
    )


def thumbnail_ref(files: DataFrame) -> DataFrame:
    """file_id, off, length, thumbnail of the Exif thumbnail, where IFD1 names one inside the block."""
    return (
        with_exif(files)
        .withColumn("_o", once(_scalar("IFD1", 0x201)))
        .withColumn("_l", once(_scalar("IFD1", 0x202)))
        .where("_l >= 4 AND _o + _l <= exif.size")
        .select(
            "file_id",
            F.expr("exif.tiff + _o").alias("off"),
            F.col("_l").alias("length"),
            F.expr(cut("content", "exif.tiff + _o", "_l")).alias("thumbnail"),
        )
    )


def exif_size_mismatch(files: DataFrame) -> DataFrame:
    """file_id, exif_width, exif_height, width, height where Exif and frame header disagree.

    Both are read from one walk of the file, inside its row.
    """
    named = lambda tag: once(
        f"array_max(transform(filter(exif_rows, r -> r.ifd = 'Exif' AND r.tag = {tag} AND r.count = 1 AND r.type IN (3, 4)), r -> r.value))"
    )
    return (
        with_frame(with_exif(files))
        .select("file_id", named(0xA002).alias("exif_width"), named(0xA003).alias("exif_height"), "frame.width", "frame.height")
        .where("exif_width <> width OR exif_height <> height")
    )
