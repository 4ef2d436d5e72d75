"""Exact top-k search by inner product: three phases with a uniform threshold.

A score is the sum of the scores of a few slices of the components. The slices
of the rows lie in tiles, and the score lists of a slice are made apart from
those of the others.

1. Each slice gathers, for each query, its best rows. Rows on any of these
   lists get their whole score; the k-th best of them is a safe cutoff.
2. The cutoff goes out to all slices. Each collects every row with at least
   cutoff / slices: a row that no slice collects scores below the cutoff.
3. What was collected by some slices is bounded by what the others did not
   collect; rows still in question get their remaining scores exactly.

Equal vectors are one node that carries its k + 1 smallest ids, so copies
neither multiply the work nor let a cutoff admit all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mendframe.llm.common import id_in, id_out, saved
from mendframe.llm.vector_tiles import PLACES, matrix, packed, products, quantised, usable, whole

#: Below every score.
NONE = -(2**62)


def _lists(k: int):
    """Phase 1: the k best rows of a cell for each query by the slice alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                nq, nc = len(r.q_node), len(r.node)
                p = products(matrix(r.q_part, nq), matrix(r.part, nc))
                best = np.argpartition(-p, min(k, nc) - 1, axis=1)[:, : min(k, nc)]
                yield pd.DataFrame(
                    {
                        "qt": r.qt,
                        "ct": r.ct,
                        "slice": r.slice,
                        "q": np.repeat(np.arange(nq), best.shape[1]),
                        "c": best.ravel(),
                        "score": np.take_along_axis(p, best, axis=1).ravel(),
                    }
                )

    return run


def _exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole scores of the pairs listed for a cell."""
    for batch in batches:
        for r in batch.itertuples(index=False):
            code = np.asarray(r.codes, np.int64)
            q, c = code // PLACES, code % PLACES
            score = _pairs(whole(r.q_slices, len(r.q_node)), whole(r.slices, len(r.node)), q, c)
            yield pd.DataFrame({"qt": r.qt, "q": q, "score": score, "copies": np.asarray(r.copies)[c]})


def _pairs(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i), np.int64)
    for lo in range(0, len(i), 1 << 14):
        at = slice(lo, lo + (1 << 14))
        out[at] = np.einsum("ij,ij->i", a[i[at]].astype(np.int64), b[j[at]].astype(np.int64))
    return out


def _cuts(raw, n: int) -> np.ndarray:
    cut = np.full(n, NONE, np.int64)
    for entry in raw if raw is not None else ():
        cut[entry["q"]] = entry["cut"]
    return cut


def _collect(slices: int):
    """Phase 2: every row of a cell with its slice's share of the cutoff."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                nq = len(r.q_node)
                p = products(matrix(r.q_part, nq), matrix(r.part, len(r.node)))
                share = -(-_cuts(r.cuts, nq) // slices)
                q, c = np.nonzero(p >= share[:, None])
                if len(q):
                    out.append((r.qt, r.ct, r.slice, (q * PLACES + c).astype(np.int32), p[q, c]))
            yield pd.DataFrame(out, columns=["qt", "ct", "slice", "codes", "scores"])

    return run


def _resolve(slices: int, k: int):
    """Phase 3: a cell's k best nodes for each query among what was collected there."""

    def cell(r) -> pd.DataFrame:
        nq, nc = len(r.q_node), len(r.node)
        copies, first = np.asarray(r.copies, np.int64), np.asarray(r.first_id, np.int64)
        a = [matrix(s, nq) for s in r.q_slices]
        b = [matrix(s, nc) for s in r.slices]
        cut = _cuts(r.cuts, nq)
        code = np.unique(np.concatenate([np.asarray(e["codes"], np.int64) for e in r.collected]))
        known = np.zeros((slices, len(code)), bool)
        total = np.zeros(len(code), np.int64)
        for e in r.collected:
            at = np.searchsorted(code, np.asarray(e["codes"], np.int64))
            known[e["slice"], at] = True
            total[at] += np.asarray(e["scores"], np.int64)
        q, c = code // PLACES, code % PLACES
        # Rows that every slice collected raise the cutoff, others are bounded by what was not collected.
        settled = np.nonzero(known.all(axis=0))[0]
        order = settled[np.lexsort((-total[settled], q[settled]))]
        starts = np.searchsorted(q[order], np.arange(nq))
        upto = np.cumsum(copies[c[order]])
        for i in range(nq):
            lo, hi = starts[i], starts[i + 1] if i + 1 < nq else len(order)
            if hi > lo:
                at = lo + np.searchsorted(upto[lo:hi] - (upto[lo - 1] if lo else 0), k)
                if at < hi:
                    cut[i] = max(cut[i], total[order[at]])
        rest = -(-_cuts(r.cuts, nq) // slices) - 1
        bound = total + (slices - known.sum(axis=0)) * rest[q]
        live = bound >= cut[q]
        q, c, total, known = q[live], c[live], total[live], known[:, live]
        for s in range(slices):
            gap = np.nonzero(~known[s])[0]
            total[gap] += _pairs(a[s], b[s], q[gap], c[gap])
        reached = total >= cut[q]
        q, c, total = q[reached], c[reached], total[reached]
        order = np.lexsort((first[c], -total, q))
        q, c, total = q[order], c[order], total[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < k
        q, c, total = q[keep], c[keep], total[keep]
        return pd.DataFrame(
            {"q_node": np.asarray(r.q_node)[q], "node": np.asarray(r.node)[c], "first_id": first[c], "score": total}
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                yield cell(r)

    return run


def _ranked(df: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    """The first rows of each group; Spark limits each task's groups before it moves them."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= most)


def exact_top_k(
    vectors: DataFrame,
    k: int = 20,
    every: int = 20,
    scale: int = 64,
    slices: int = 2,
    depth: int = 10,
    query_tile: int = 256,
    tile: int = 2048,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each query, exactly.

    `vectors`: vec_id, embedding. Components become floor(`scale` * x), scores
    are inner products. Queries are the rows with a vec_id divisible by
    `every`; candidates all rows but the query's own, ties to the smaller
    vec_id. `depth` * (k + 1) rows of each slice's list count for the cutoff.

    Vectors that are NULL, empty, hold NULL or non-finite components, or
    components of such a size that scores could pass 64 bits, take no part;
    vectors of different length have no score. Rows without vec_id are
    candidates, first among ties, and no queries. Repeated rows are rows of
    their own: each is a query and a candidate for the others. Fewer than k
    candidates are all returned; an empty table gives an empty result; other
    columns are ignored.
    """
    more = k + 1  # a query's own row may be among them
    rows = vectors.select(id_in("vec_id"), F.when(usable("embedding", scale), quantised("embedding", scale)).alias("values"))
    rows = saved(
        rows.where("values IS NOT NULL").select(
            F.monotonically_increasing_id().alias("uid"), "vec_id", "values",
            F.sha2(F.array_join("values", ","), 256).alias("fp"),
            (F.col("vec_id").isNotNull() & (F.col("vec_id") % every == 0) & (F.col("vec_id") != -(2**63))).alias("asks"),
        ),
        "topk-rows",
    )
    members = _ranked(rows.select("fp", "vec_id", "uid"), ["fp"], [F.col("vec_id"), F.col("uid")], more)
    members = members.groupBy("fp").agg(F.sort_array(F.collect_list(F.struct("vec_id", "uid"))).alias("members"))
    one = rows.groupBy("fp").agg(F.first("values").alias("values"), F.bool_or("asks").alias("asks"))
    nodes = saved(
        members.join(one, "fp").withColumn("node", F.monotonically_increasing_id()), "topk-nodes"
    )
    narrow = ["node", F.size("members").cast("bigint").alias("copies"), F.col("members")[0]["vec_id"].alias("first_id"), "values"]
    asked = packed(nodes.where("asks").select("node", "values"), query_tile, "topk-queries", slices)
    given = packed(nodes.select(*narrow), tile, "topk-tiles", slices)
    queries = asked.select(F.col("tile").alias("qt"), F.col("dim").alias("q_dim"), F.col("node").alias("q_node"), F.col("slices").alias("q_slices"))
    tiles = given.withColumnRenamed("tile", "ct")
    # The stated queries against all rows, tile by tile: only the numbers of tiles are paired here.
    cells = queries.select("qt", F.col("q_dim").alias("dim")).join(tiles.select("ct", "dim"), "dim").select("qt", "ct")
    by_slice = (
        cells.join(queries.select("qt", "q_node", F.posexplode("q_slices").alias("slice", "q_part")), "qt")
        .join(tiles.select("ct", "node", F.posexplode("slices").alias("slice", "part")), ["ct", "slice"])
    )
    gathered = by_slice.mapInPandas(_lists(more), "qt bigint, ct bigint, slice int, q int, c int, score bigint")
    best = _ranked(gathered, ["qt", "q", "slice"], [F.col("score").desc()], depth * more)
    listed = best.groupBy("qt", "ct").agg(F.collect_set((F.col("q") * PLACES + F.col("c")).cast("int")).alias("codes"))
    scored = listed.join(queries, "qt").join(tiles, "ct").select("qt", "codes", "q_node", "q_slices", "node", "copies", "slices")
    scored = scored.mapInPandas(_exact, "qt bigint, q int, score bigint, copies bigint")
    down = Window.partitionBy("qt", "q").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    cut = scored.withColumn("upto", F.sum("copies").over(down)).where(F.col("upto") >= more)
    cut = cut.groupBy("qt", "q").agg(F.max("score").alias("cut"))
    cuts = saved(cut.groupBy("qt").agg(F.collect_list(F.struct("q", "cut")).alias("cuts")), "topk-cuts")
    collected = (
        by_slice.join(cuts, "qt", "left")
        .select("qt", "ct", "slice", "q_node", "q_part", "node", "part", "cuts")
        .mapInPandas(_collect(slices), "qt bigint, ct bigint, slice int, codes array<int>, scores array<bigint>")
    )
    in_cell = collected.groupBy("qt", "ct").agg(F.collect_list(F.struct("slice", "codes", "scores")).alias("collected"))
    resolved = (
        in_cell.join(queries, "qt").join(tiles, "ct").join(cuts, "qt", "left")
        .select("collected", "cuts", "q_node", "q_slices", "node", "copies", "first_id", "slices")
        .mapInPandas(_resolve(slices, more), "q_node bigint, node bigint, first_id bigint, score bigint")
    )
    top = _ranked(resolved, ["q_node"], [F.col("score").desc(), F.col("first_id"), F.col("node")], more)
    found = (
        top.join(nodes.select("node", "members"), "node")
        .select("q_node", "score", F.explode("members").alias("m"))
        .select("q_node", "score", F.col("m.vec_id").alias("vec_id"), F.col("m.uid").alias("uid"))
    )
    found = _ranked(found, ["q_node"], [F.col("score").desc(), F.col("vec_id"), F.col("uid")], more)
    lists = found.groupBy("q_node").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "uid"))).alias("list"))
    return _for_rows(rows, nodes, lists, k)


def _for_rows(rows: DataFrame, nodes: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """Each query row takes its node's list without itself.

    Rows of one much repeated query are dealt over copies of its list. A node is hot
    from a thousandth of all queries on, so there are at most a thousand such nodes.
    """
    asking = rows.where("asks").select("fp", "vec_id", "uid")
    counts = asking.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    spread = counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all"))))  # one row
    hot = spread.where("n > 1000 AND 1000 * n > all").select("fp", F.lit(64).alias("copies"))
    hot = F.broadcast(hot)
    dealt = asking.join(hot, "fp", "left").withColumn("deal", F.coalesce(F.pmod(F.xxhash64("uid"), "copies"), F.lit(0)).cast("int"))
    named = nodes.where("asks").select("fp", F.col("node").alias("q_node")).join(lists, "q_node").drop("q_node")
    copied = named.join(hot, "fp", "left").withColumn("deal", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)))
    joined = dealt.drop("copies").join(copied.drop("copies"), ["fp", "deal"])
    others = F.slice(F.filter("list", lambda e: e["uid"] != F.col("uid")), 1, k)
    return joined.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("at", "e")).select(
        "query_id",
        (F.col("at") + 1).cast("int").alias("rank"),
        F.col("e.vec_id").alias("vec_id"),
        (-F.col("e.s")).alias("score"),
    ).withColumn("vec_id", id_out("vec_id"))
