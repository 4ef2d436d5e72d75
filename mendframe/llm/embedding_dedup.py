"""Embedding near-duplicates by Euclidean p-stable hashing.

Unit vectors at cosine c lie sqrt(2 - 2c) apart. A table hashes a vector to
floor((G x + u) / width) for a few Gaussian directions G; close vectors share
all of a table's values far more often than others. Vectors that share a
bucket are compared by exact cosine in double precision, in blocks of a fixed
size, so a large bucket is many tasks and none of its pairs is left out. A pair
is reported by the first table in which it meets.

Equal vectors are one node with a count, so groups of copies stay small.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import erf, exp, log, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendframe.functions.lineage import materialize
from mendframe.llm.common import components, saved


def meeting_chance(distance: float, width: float) -> float:
    """Chance that two points this far apart share one quantised projection."""
    r = width / distance
    return erf(r / sqrt(2)) - 2 / (sqrt(2 * pi) * r) * (1 - exp(-r * r / 2))


def tables_for(cosine: float, width: float, per_table: int, miss: float) -> int:
    """Tables after which a pair exactly at `cosine` has met but for a chance of `miss`."""
    p = meeting_chance(sqrt(2 - 2 * cosine), width) ** per_table
    return int(np.ceil(log(miss) / log(1 - p)))


def _hashes(width: float, per_table: int, n_tables: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drawn: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            out: list[np.ndarray | None] = []
            for v in batch["embedding"]:
                x = np.array([np.nan if c is None else c for c in v] if v is not None else [], np.float64)
                norm = float(np.linalg.norm(x)) if len(x) else 0.0
                if not np.isfinite(norm) or norm == 0.0:
                    out.append(None)
                    continue
                if len(x) not in drawn:
                    rng = np.random.default_rng(len(x))
                    drawn[len(x)] = (
                        rng.standard_normal((n_tables * per_table, len(x))),
                        rng.uniform(0, width, n_tables * per_table),
                    )
                g, u = drawn[len(x)]
                cells = np.floor((g @ (x / norm) + u) / width).astype(np.int64).reshape(n_tables, per_table)
                h = np.zeros(n_tables, np.uint64)
                for k in range(per_table):
                    h = (h ^ cells[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(31)
                out.append((h >> np.uint64(32)).astype(np.uint32).view(np.int32))
            yield pd.DataFrame({"node": batch["node"], "buckets": out})

    return run


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest position that each of n positions reaches over the links (i, j)."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _compare(cosine: float):
    """Links inside blocks: how many each node has, and a node it is joined to.

    Rows come sorted by block. Counts of blocks add up, because each pair is
    taken in the first table that holds both; a group of n near copies gives
    n rows and not its pairs.
    """

    def block(unit, node, copies, side, buckets, across: bool):
        near = np.triu(unit @ unit.T >= cosine, 1)
        if across:
            near &= side[:, None] != side[None, :]
        i, j = np.nonzero(near)
        new = np.empty(len(i), bool)
        for lo in range(0, len(i), 1 << 15):
            p, q = i[lo : lo + (1 << 15)], j[lo : lo + (1 << 15)]
            new[lo : lo + (1 << 15)] = ~(buckets[p] == buckets[q]).any(axis=1)
        i, j = i[new], j[new]
        count = np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
        held = count > 0
        return node[held], node[_roots(len(node), i, j)][held], count[held].astype(np.int64)

    def links(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        node, copies, side, table, p, q = (rows[c].to_numpy() for c in ("node", "copies", "side", "tbl", "p", "q"))
        buckets = np.stack(rows["buckets"].to_numpy())
        found = []
        for lo, hi in zip(starts, [*starts[1:], len(rows)], strict=True):
            if hi - lo > 1:
                x = np.stack(rows["embedding"].iloc[lo:hi].to_numpy()).astype(np.float64)
                x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
                of = slice(lo, hi)
                found.append(block(x, node[of], copies[of], side[of], buckets[of, : table[lo]], p[lo] != q[lo]))
        if not found:
            return pd.DataFrame({"node": [], "other": [], "n": []}, dtype="int64")
        return pd.DataFrame(dict(zip(("node", "other", "n"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        keys = ["label", "dim", "tbl", "cell", "p", "q"]
        for batch in batches:
            if kept is not None:
                batch = pd.concat([kept, batch], ignore_index=True)
            if not len(batch):
                continue
            k = batch[keys].to_numpy()
            starts = np.nonzero(np.r_[True, (k[1:] != k[:-1]).any(axis=1)])[0]
            kept = batch.iloc[starts[-1] :]
            if len(starts) > 1:
                yield links(batch.iloc[: starts[-1]], starts[:-1])
        if kept is not None:
            yield links(kept, np.array([0]))

    return run


def near_vectors(
    vectors: DataFrame,
    cosine: float = 0.93,
    width: float = 2.0,
    per_table: int = 14,
    miss: float = 1e-3,
    block: int = 1024,
) -> DataFrame:
    """One row per row of `vectors` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors are linked when their labels are equal and not NULL and their
    cosine is at least `cosine`. n_links counts the other rows linked
    directly; component_id is the smallest vec_id reachable. `miss` bounds the
    chance that a pair exactly at the threshold is missed; nearer pairs are
    missed less. More rows want a larger `per_table`, which grows with their
    logarithm.

    Vectors that are NULL, empty, zero or hold NULL or non-finite components,
    and those without a label, have no links and are their own component.
    Vectors of different length have no cosine. Repeated rows are linked with
    each other. An empty table gives an empty result; other columns are ignored.
    """
    n_tables = tables_for(cosine, width, per_table, miss)
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", "label"
    ).withColumn("fp", F.sha2(F.to_json(F.struct("label", "embedding")), 256))
    usable = F.col("label").isNotNull() & F.coalesce(
        (F.size("embedding") > 0)
        & F.exists("embedding", lambda c: c != 0)
        & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))),
        F.lit(False),
    )
    rows = rows.withColumn("fp", F.when(usable, F.col("fp")))
    ids = (
        rows.where(F.col("fp").isNotNull())
        .groupBy("fp")
        .agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    )
    vector = rows.where(F.col("fp").isNotNull()).select("fp", "embedding", "label").dropDuplicates(["fp"])
    nodes = saved(ids.join(vector, "fp").withColumn("node", F.monotonically_increasing_id()), "vectors")
    hashed = nodes.select("node", "embedding").mapInPandas(
        _hashes(width, per_table, n_tables), "node bigint, buckets array<int>"
    )
    placed = nodes.join(hashed.where(F.col("buckets").isNotNull()), "node").select(
        "node", "embedding", "label", "copies", "buckets", F.size("embedding").alias("dim")
    )
    placed = saved(placed, "vector-buckets")
    narrow = placed.select("node", "label", "dim", F.posexplode("buckets").alias("tbl", "cell"))
    bucket = ["label", "dim", "tbl", "cell"]
    shared = narrow.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / block).cast("int")
    member = narrow.join(shared, bucket).select(
        "node", *bucket, parts.alias("parts"), F.pmod(F.xxhash64("node", "tbl"), parts).cast("int").alias("part"),
    )
    # Block (p, q), p <= q, holds part p as side 0 and part q as side 1.
    pairs = member.select(
        "node", *bucket, "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    ).select(
        "node",
        *bucket,
        F.least("part", "other").alias("p"),
        F.greatest("part", "other").alias("q"),
        (F.col("part") > F.col("other")).cast("int").alias("side"),
    )
    found = (
        pairs.join(placed.select("node", "embedding", "copies", "buckets"), "node")
        .repartition(*bucket, "p", "q")
        .sortWithinPartitions(*bucket, "p", "q")
        .mapInPandas(_compare(cosine), "node bigint, other bigint, n bigint")
    )
    links = materialize(found)
    roots = components(links, "node", "other")
    beside = links.groupBy("node").agg(F.sum("n").alias("beside"))
    named = nodes.select("node", "fp", "first_id", "copies").join(roots, "node", "left")
    lowest = named.where("root IS NOT NULL").groupBy("root").agg(F.min("first_id").alias("lowest"))
    of_node = (
        named.join(lowest, "root", "left")
        .join(beside, "node", "left")
        .select(
            "fp",
            (F.col("copies") - 1 + F.coalesce("beside", F.lit(0))).alias("n_links"),
            F.coalesce("lowest", "first_id").alias("component"),
        )
    )
    return rows.select("vec_id", "fp").join(of_node, "fp", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce("component", "vec_id").eqNullSafe(F.col("vec_id")).alias("kept"),
    )
