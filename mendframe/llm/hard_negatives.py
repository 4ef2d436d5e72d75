"""Hard negatives: exact scores of anchors with all rows, by Strassen products of integer tiles.

Anchors and rows lie in tiles. A cell's scores are one product of 64-bit
integer matrices, multiplied by Strassen's recursion: halves are padded with
zeros to one size, seven products take the place of eight, and sums wrap at 64
bits, which is exact as the scores themselves fit. A cell keeps small heaps:
the best rows of the anchor's label, then, once the positives are known, the
best rows of other labels within the window below each positive. Heaps of
the same anchor merge into one of the same size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendframe.llm.common import id_in, id_out, saved
from mendframe.llm.vector_tiles import matrix, packed, quantised, usable

#: Sides up to this are multiplied directly.
LEAF = 32


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b for int64 matrices, modulo 2**64."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    h, i, j = (-(-x // 2) for x in (m, k, n))
    if (m, k, n) != (2 * h, 2 * i, 2 * j):
        a = np.pad(a, ((0, 2 * h - m), (0, 2 * i - k)))
        b = np.pad(b, ((0, 2 * i - k), (0, 2 * j - n)))
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * h, 2 * j), np.int64)
    out[:h, :j] = p1 + p4 - p5 + p7
    out[:h, j:] = p3 + p5
    out[h:, :j] = p2 + p4
    out[h:, j:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def best(scores: np.ndarray, ids: np.ndarray, uids: np.ndarray, among: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """The first n places of `among` as a heap's entries (-score, id, uid), in order."""
    if not len(among) or not n:
        return []
    s = scores[among]
    if len(among) > n:
        # Ties at the edge stay until their ids have decided.
        among = among[s >= np.partition(s, len(s) - n)[len(s) - n]]
    entries = zip((-scores[among]).tolist(), ids[among].tolist(), uids[among].tolist(), strict=True)
    return heapq.nsmallest(n, entries)


def merged(x: list, y: list, n: int) -> list:
    """Two heaps of the first n entries as one."""
    return [e for e, _ in zip(heapq.merge(x, y), range(n), strict=False)]


def _cells(batches: Iterator[pd.DataFrame], visit, out: list[str], n: int) -> Iterator[pd.DataFrame]:
    """Visits all cells of a task; heaps of one key are merged as long as their anchor tile is at hand."""
    heaps: dict[tuple, list] = {}
    tile = None

    def frame() -> pd.DataFrame:
        return pd.DataFrame([(*key, *e) for key, heap in heaps.items() for e in heap], columns=out)

    for batch in batches:
        for r in batch.itertuples(index=False):
            if tile is not None and r.at != tile:
                yield frame()
                heaps.clear()
            tile = r.at
            na, nc = len(r.a_uid), len(r.uid)
            a, b = matrix(r.a_slices[0], na).astype(np.int64), matrix(r.slices[0], nc).astype(np.int64)
            scores = strassen(a, np.ascontiguousarray(b.T))
            labels, ids, uids = (np.asarray(x, np.int64) for x in (r.label, r.vec_id, r.uid))
            for key, heap in visit(r, scores, labels, ids, uids):
                heaps[key] = merged(heaps[key], heap, n) if key in heaps else heap
    if heaps:
        yield frame()


def _positives(n: int):
    def visit(r, scores, labels, ids, uids):
        for i, (anchor, label) in enumerate(zip(r.a_uid, r.a_label, strict=True)):
            heap = best(scores[i], ids, uids, np.nonzero((labels == label) & (uids != anchor))[0], n)
            if heap:
                yield (anchor,), heap

    def run(batches):
        return _cells(batches, visit, ["a_uid", "s", "vec_id", "uid"], n)

    return run


def _negatives(n: int, low: int, high: int):
    def visit(r, scores, labels, ids, uids):
        label_of = dict(zip(r.a_uid, r.a_label, strict=True))
        row_of = {u: i for i, u in enumerate(r.a_uid)}
        apart = {}
        for p in r.positives:
            anchor, top = p["a_uid"], p["score"]
            i = row_of[anchor]
            if anchor not in apart:
                apart[anchor] = np.nonzero(labels != label_of[anchor])[0]
            other = apart[anchor]
            s = scores[i][other]
            # high * negative in low * positive .. high * positive, in whole numbers.
            heap = best(scores[i], ids, uids, other[(s >= -(-low * top // high)) & (s <= top)], n)
            if heap:
                yield (anchor, p["uid"]), heap

    def run(batches):
        return _cells(batches, visit, ["a_uid", "p_uid", "s", "vec_id", "uid"], n)

    return run


def hard_negatives(
    vectors: DataFrame,
    anchors: Column | None = None,
    positives: int = 5,
    negatives: int = 5,
    window: tuple[int, int] = (80, 100),
    scale: int = 256,
    anchor_tile: int = 128,
    tile: int = 2048,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `vectors`: vec_id, embedding, label. Components become floor(`scale` * x);
    a row's score is its inner product with the anchor; higher scores come
    first, ties by smaller vec_id. Anchors are the rows where `anchors` is true
    (default: vec_id divisible by 100). An anchor's positives are the first
    `positives` other rows of its label; for each, the first `negatives` rows of
    other labels are returned whose score is between `window[0]` / `window[1]` of the
    positive's and the positive's own. Where that is empty, as with
    negative scores, nothing is.

    Rows with a NULL label, and vectors that are NULL, empty, hold NULL or
    non-finite components, or components of such a size that scores could
    pass 64 bits, take no part; vectors of different length have no score. Rows
    without vec_id are no anchors, and first among ties. Repeated rows are rows of
    their own. An empty table gives an empty result; other columns are ignored.
    """
    asks = (F.col("vec_id") % 100 == 0) if anchors is None else anchors
    rows = vectors.withColumn("__asks", F.coalesce(asks & F.col("vec_id").isNotNull(), F.lit(False))).select(
        id_in("vec_id"), F.col("label").cast("bigint").alias("label"), "__asks",
        F.when(usable("embedding", scale), quantised("embedding", scale)).alias("values"),
    )
    rows = saved(
        rows.where("values IS NOT NULL AND label IS NOT NULL").withColumn("uid", F.monotonically_increasing_id()), "negatives-rows"
    )
    asked = packed(rows.where("__asks").select("uid", "label", "values"), anchor_tile, "negatives-anchors")
    given = packed(rows.select("uid", "vec_id", "label", "values"), tile, "negatives-tiles").withColumnRenamed("tile", "ct")
    asked = asked.select(
        F.col("tile").alias("at"), F.col("dim").alias("a_dim"), F.col("uid").alias("a_uid"), F.col("label").alias("a_label"),
        F.col("slices").alias("a_slices"),
    )
    # The stated anchors against all rows, tile by tile: only the numbers of tiles are paired here.
    pairs = asked.select("at", F.col("a_dim").alias("dim")).join(given.select("ct", "dim"), "dim").select("at", "ct")
    side = ["a_uid", "a_label", "a_slices", "uid", "vec_id", "label", "slices"]
    cells = pairs.join(asked, "at").join(given, "ct")

    def first(df: DataFrame, key: list[str], n: int) -> DataFrame:
        order = Window.partitionBy(*key).orderBy("s", "vec_id", "uid")
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)

    near = cells.select("at", *side).sortWithinPartitions("at").mapInPandas(
        _positives(positives), "a_uid bigint, s bigint, vec_id bigint, uid bigint"
    )
    near = saved(first(near, ["a_uid"], positives), "negatives-positives")
    places = asked.select("at", F.explode("a_uid").alias("a_uid"))
    known = places.join(near, "a_uid").groupBy("at").agg(
        F.collect_list(F.struct("a_uid", "uid", (-F.col("s")).alias("score"))).alias("positives")
    )
    hard = cells.join(known, "at").select("at", *side, "positives").sortWithinPartitions("at").mapInPandas(
        _negatives(negatives, *window), "a_uid bigint, p_uid bigint, s bigint, vec_id bigint, uid bigint"
    )
    hard = first(hard, ["a_uid", "p_uid"], negatives).select(
        "a_uid", "p_uid", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), (-F.col("s")).alias("negative_score")
    )
    names = rows.where("__asks").select(F.col("uid").alias("a_uid"), F.col("vec_id").alias("anchor_id"))
    of = near.select(
        "a_uid", F.col("uid").alias("p_uid"), F.col("vec_id").alias("positive_id"), (-F.col("s")).alias("positive_score")
    )
    return hard.join(of, ["a_uid", "p_uid"]).join(names, "a_uid").select(
        "anchor_id", id_out("positive_id"), "rank", id_out("negative_id"), "positive_score", "negative_score"
    )
