"""The byte scan: where every FF of a file is and what follows it.

This is the one kernel that leaves the JVM. It looks at a whole Arrow batch of
blobs as a single byte buffer, so there is no loop over rows or bytes. Only
`content` crosses to Python; markers come back as an array in the same row,
so no file operator needs a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARKERS_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("off", T.LongType()),
            T.StructField("code", T.IntegerType()),
            T.StructField("seg_len", T.IntegerType()),
            T.StructField("fill", T.IntegerType()),
        ]
    )
)


def _find_markers(blobs: pa.Array) -> pa.Array:
    blobs = blobs.cast(pa.large_binary()).fill_null(b"")
    if isinstance(blobs, pa.ChunkedArray):
        blobs = blobs.combine_chunks()
    n_rows = len(blobs)
    _, offset_buf, data_buf = blobs.buffers()
    offs = np.frombuffer(offset_buf, np.int64)[blobs.offset : blobs.offset + n_rows + 1]
    first = offs[0] if n_rows else 0
    size = int(offs[-1] - first) if n_rows else 0
    data = (
        np.frombuffer(data_buf, np.uint8)[first : first + size]
        if size
        else np.empty(0, np.uint8)
    )
    offs = offs - first

    ff = np.flatnonzero(data == 0xFF)
    row = np.searchsorted(offs, ff, side="right") - 1
    end = offs[row + 1] if len(ff) else ff
    at_end = ff + 1 >= end
    nxt = np.where(at_end, -1, data[np.minimum(ff + 1, max(size - 1, 0))].astype(np.int32)) if size else ff
    # A run of FFs is fill; the marker is its last FF.
    starts = np.ones(len(ff), bool)
    starts[1:] = (ff[1:] != ff[:-1] + 1) | (row[1:] != row[:-1])
    run_start = np.maximum.accumulate(np.where(starts, np.arange(len(ff)), 0)) if len(ff) else ff
    fill = np.arange(len(ff)) - run_start
    keep = nxt != 0xFF
    ff, row, end, nxt, fill = ff[keep], row[keep], end[keep], nxt[keep], fill[keep]
    has_len = ff + 3 < end
    hi = data[np.minimum(ff + 2, max(size - 1, 0))].astype(np.int32) if size else ff
    lo = data[np.minimum(ff + 3, max(size - 1, 0))].astype(np.int32) if size else ff

    counts = np.bincount(row, minlength=n_rows) if len(row) else np.zeros(n_rows, np.int64)
    list_offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    values = pa.StructArray.from_arrays(
        [
            pa.array(ff - offs[row] if len(row) else ff, pa.int64()),
            pa.array(nxt, pa.int32()),
            pa.array((hi << 8) | lo, pa.int32(), mask=~has_len),
            pa.array(fill, pa.int32()),
        ],
        names=["off", "code", "seg_len", "fill"],
    )
    return pa.ListArray.from_arrays(pa.array(list_offsets), values)


@F.arrow_udf(MARKERS_TYPE)
def find_markers(blobs: pa.Array) -> pa.Array:
    """Per blob: off, code, seg_len, fill of each marker, in offset order.

    `off` is the last FF before a non-FF byte and `fill` the number of FFs in
    front of it. An FF that ends the blob is reported with code -1.
    """
    return _find_markers(blobs)


# Declared nondeterministic so that filters on markers do not rescan the bytes.
find_markers = find_markers.asNondeterministic()


def with_markers(files: DataFrame) -> DataFrame:
    """Adds `markers`, the array the structure operators fold over."""
    if "markers" in files.columns:
        return files
    return files.withColumn("markers", find_markers("content"))


def marker_scan(files: DataFrame, key: str = "file_id") -> DataFrame:
    """file_id, off, code, seg_len: every FF followed by another byte."""
    return (
        with_markers(files)
        .select(key, F.explode("markers").alias("mk"))
        .where("mk.code >= 0")
        .select(key, "mk.off", "mk.code", "mk.seg_len", "mk.fill")
    )


def marker_scan_chunks(chunks: DataFrame) -> DataFrame:
    """Markers of overlapping chunks (`read_chunks`), at absolute offsets.

    A chunk row carries `start`, its owned `length` and some bytes more; a
    marker belongs to the chunk that owns its FF, so nothing is reported twice
    and no marker is cut by a border. `fill` is dropped: a run of FFs may
    begin in the previous chunk, so it is recomputed by whoever needs it.
    """
    return (
        chunks.withColumn("markers", find_markers("content"))
        .withColumn("mk", F.explode("markers"))
        .where("mk.off < length AND mk.code >= 0")
        .select(
            "path",
            (F.col("start") + F.col("mk.off")).alias("off"),
            "mk.code",
            "mk.seg_len",
        )
    )
