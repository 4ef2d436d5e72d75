"""MinHash near-duplicates by an inverted join over signature coordinates.

Every distinct shingle set gets a signature of `coords` minima. A pair of
similarity s agrees in each coordinate with probability s, so pairs at or
above the wanted similarity agree in at least `matches` coordinates but for a
chance below 1e-7 (`match_threshold`). Sets are posted under their coordinate-value
pairs; a pair with `matches` agreements must meet in one of any
`coords - matches + 1` postings, so each set is posted only under the rarest ones
(prefix), values held by one set are never posted, and lists that are common
to many sets are skipped. Collisions are then counted over whole signatures,
and survivors are confirmed on the full shingle sets.

Large groups of copies never become all their pairs: equal sets are one node,
and each posting list is first compared with its most central set, the one
whose coordinates most others hold, which is what copies were made from. Of the
sets that this leaves outside a list's largest component, those go on that have
enough shingles in common with any other component to be similar to one of the
list's sizes at all: an exact bound. They are compared with all sets whose lists
have the same centre, in blocks of a fixed size that bring signatures and full
sets together in one task, so only links leave it and no pairs travel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendframe.functions.lineage import materialize
from mendframe.llm.common import NO_ID, components, id_in, id_out, saved

COORDS = 64
_MIX = 0x9E3779B97F4A7C15


def match_threshold(percent: int, coords: int = COORDS, miss: float = 1e-7) -> int:
    """Largest number of agreeing coordinates that all but `miss` of the pairs at `percent` reach."""
    s, below = percent / 100, 0.0
    for t in range(coords + 1):
        below += comb(coords, t) * s**t * (1 - s) ** (coords - t)
        if below > miss:
            return max(1, t)
    return coords


def shingle_hashes(text: str | None, size: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the `size`-word shingles; A-Z lower-cased.

    Fewer words than `size`: the whole sequence as one. No words: empty.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    new = {w for w in tokens if w not in known}
    if len(known) + len(new) > 400_000:
        known.clear()
        new = set(tokens)
    for w in new:
        known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
    h = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out ^ h[i : len(h) - n + 1 + i]) * np.uint64(_MIX)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _signatures(size: int, coords: int):
    rng = np.random.default_rng(20)
    mul = rng.integers(0, 2**63, coords, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, coords, dtype=np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, int] = {}
        for batch in batches:
            sets = [shingle_hashes(t, size, known) for t in batch["text"]]
            sig: list[np.ndarray | None] = [None] * len(sets)
            full = [i for i, s in enumerate(sets) if len(s)]
            for lo in range(0, len(full), 64):
                part = full[lo : lo + 64]
                flat = np.concatenate([sets[i] for i in part])
                starts = np.cumsum([0] + [len(sets[i]) for i in part[:-1]])
                rows = np.empty((coords, len(part)), np.uint64)
                for k in range(coords):
                    v = flat * mul[k]
                    v += add[k]
                    rows[k] = np.minimum.reduceat(v, starts)
                rows >>= np.uint64(32)
                for i, column in zip(part, rows.T.astype(np.uint32).view(np.int32), strict=True):
                    sig[i] = column
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "n_shingles": [len(s) for s in sets],
                    "fp": [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets],
                    "sig": sig,
                }
                | ({"mark": batch["mark"]} if "mark" in batch else {})
            )

    return run


def _sets(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, int] = {}
        for batch in batches:
            held = [shingle_hashes(t, size, known) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "fp": [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in held],
                    "grams": [s.view(np.int64) for s in held],
                }
            )

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                both = np.sort(np.concatenate([x, y]))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.loc[np.array(keep, bool), ["a", "b"]]

    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, coords: int = COORDS, marks: bool = False) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept.

    With `marks` also mark, the text's hash, and group_no, which tells components apart
    whatever their ids, and is NULL for rows that stand alone.

    A document's set holds its distinct `words`-word shingles; documents are
    linked when 100 * intersection >= `percent` * union. component_id is the
    smallest doc_id reachable over links, kept says whether it is the row's own.

    NULL or wordless texts have an empty set and are linked with nothing. Rows
    with equal sets are one node, so repeated rows and any number of copies
    cost one row each. NULL doc_ids never become a component's id while
    another is there. An empty table gives an empty result. Further columns
    of `docs` are ignored.
    """
    mark = [F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("mark")] if marks else []
    docs = docs.select(id_in("doc_id"), F.col("text").cast("string").alias("text"), *mark)
    need = match_threshold(percent, coords)
    rows = saved(
        docs.mapInPandas(
            _signatures(words, coords), "doc_id bigint, n_shingles bigint, fp binary, sig array<int>" + (", mark string" if marks else "")
        ),
        "minhash-signatures",
    ).withColumn("doc_id", id_out("doc_id"))
    full = rows.where(F.col("fp").isNotNull())
    ids = full.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    sigs = full.select("fp", "sig", "n_shingles").dropDuplicates(["fp"])
    nodes = saved(
        sigs.join(ids, "fp").withColumn("node", F.monotonically_increasing_id()), "minhash-nodes"
    )
    post = saved(_postings(nodes, coords, need), "minhash-postings")
    grams = saved(_grams(post, nodes, docs, words), "minhash-sets")
    linked = materialize(_verified(_star(post, percent), nodes, grams, percent, need))
    roots = materialize(components(linked))
    more = materialize(_remaining(post, roots, nodes, grams, percent, need))
    if not more.isEmpty():
        roots = components(linked.unionByName(more))
    group = nodes.join(roots, "node").groupBy("root").agg(F.min("first_id").alias("lowest"))
    of_node = (
        nodes.join(roots, "node", "left")
        .join(group, "root", "left")
        .where(F.col("root").isNotNull() | (F.col("copies") > 1))
        .select("fp", F.coalesce("lowest", "first_id").alias("component"), F.coalesce("root", "node").alias("group_no"))
    )
    return rows.join(of_node, "fp", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce("component", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept"),
        *(["mark", "group_no"] if marks else []),
    )


def _postings(nodes: DataFrame, coords: int, need: int) -> DataFrame:
    """(key, node, n, central): each set under its rarest `coords - need + 1` coordinates, less those nobody shares.

    n is the size of the set, central how many sets hold its coordinates, in
    sum. Sets that share fewer than `need` coordinates with anyone are left out.
    """
    every = nodes.select("node", "n_shingles", F.posexplode("sig").alias("c", "v")).select(
        "node", "n_shingles", (F.shiftleft(F.col("c").cast("bigint"), 32) + F.col("v")).alias("key")
    )
    shared = every.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    listed = (
        every.join(shared, "key")
        .groupBy("node", F.col("n_shingles").alias("n"))
        .agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("own"), F.sum("df").alias("central"))
        .where(F.size("own") >= need)
    )
    # The coordinates that nobody shares come first in the order of rarity.
    take = F.lit(coords - need + 1) - (F.lit(coords) - F.size("own"))
    return listed.select(
        "node", "n", "central", F.explode(F.slice("own", F.lit(1), F.greatest(take, F.lit(0)))).alias("p")
    ).select(F.col("p.key").alias("key"), "node", "n", "central")


def _sized(x: str, y: str, percent: int) -> Column:
    """Sets of these sizes can be similar at all."""
    return (100 * F.col(x) >= percent * F.col(y)) & (100 * F.col(y) >= percent * F.col(x))


def _hubs(post: DataFrame) -> DataFrame:
    """(key, hub, hub_n): each list's most central set."""
    hub = post.groupBy("key").agg(F.max(F.struct("central", F.col("node").alias("hub"), F.col("n").alias("hub_n"))).alias("h"))
    return hub.select("key", "h.hub", "h.hub_n")


def _star(post: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each list's most central set with its others."""
    return (
        post.join(_hubs(post), "key")
        .where(F.col("node") != F.col("hub"))
        .where(_sized("hub_n", "n", percent))
        .select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))
        .distinct()
    )


def _remaining(
    post: DataFrame, roots: DataFrame, nodes: DataFrame, grams: DataFrame, percent: int, need: int, block: int = 512
) -> DataFrame:
    """Links (a, b) between sets that share a list but no component.

    A set shares at most `s` shingles with any set of another component, those
    that one in the open lists holds; with a set of y shingles it can be similar
    only if (100 + percent) * s >= percent * (n + y), and y is at least the
    list's smallest. Sets that pass are compared with all those that have a
    list with the same centre, block against block.
    """
    placed = post.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least"))
    main = sizes.groupBy("key").agg(
        F.max(F.struct("k", "root")).alias("most"), F.count(F.lit(1)).alias("parts"), F.min("least").alias("least")
    )
    open_lists = main.where("parts > 1").select("key", F.col("most.root").alias("main"), "least").join(_hubs(post), "key")
    placed = materialize(placed.join(open_lists, "key").select("hub", "node", "n", "root", "main", "least").distinct())
    few = placed.where("root <> main").select("hub", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("root").alias("rx"), "least")
    members = placed.select("node", "root").distinct()
    held = grams.join(members, "node").select("root", F.explode("grams").alias("g"))
    apart = held.groupBy("g").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("g")
    own = grams.join(few.select(F.col("x").alias("node")).distinct(), "node").select("node", F.explode("grams").alias("g"))
    shared = own.join(apart, "g", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("s"))
    y = F.greatest(F.col("least").cast("double"), F.col("nx") * percent / 100.0)
    able = few.join(shared.withColumnRenamed("node", "x"), "x").where((100 + percent) * F.col("s") >= percent * (F.col("nx") + y) - 1e-6)
    able = materialize(able.select("hub", F.col("x").alias("node"), F.col("rx").alias("root")).distinct())

    many = able.groupBy("hub").agg(F.count(F.lit(1)).alias("kx"))
    around = placed.select("hub", "node", "root").distinct().join(many, "hub")
    total = around.groupBy("hub").agg(F.count(F.lit(1)).alias("ky"))
    parts = lambda c: F.ceil(F.col(c) / F.lit(block)).cast("int")
    part = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    spread = lambda n, name: F.explode(F.sequence(F.lit(0), n - 1)).alias(name)
    left = (
        able.join(many.join(total, "hub"), "hub")
        .withColumn("p", part(parts("kx")))
        .select("hub", "node", "root", "p", spread(parts("ky"), "q"), F.lit(0).alias("side"))
    )
    right = around.join(total, "hub").withColumn("q", part(parts("ky"))).select(
        "hub", "node", "root", spread(parts("kx"), "p"), "q", F.lit(1).alias("side")
    )
    full = grams.join(nodes.select("node", "sig"), "node")
    return (
        left.unionByName(right, allowMissingColumns=False)
        .join(full, "node")
        .repartition("hub", "p", "q")
        .sortWithinPartitions("hub", "p", "q")
        .mapInPandas(_blocks(percent, need), "a bigint, b bigint")
        .distinct()
    )


def _blocks(percent: int, need: int):
    def links(rows: pd.DataFrame) -> list[tuple[int, int]]:
        out = []
        one, two = rows[rows["side"] == 0], rows[rows["side"] == 1]
        if not len(one) or not len(two):
            return out
        sx, sy = np.stack(one["sig"].to_numpy()), np.stack(two["sig"].to_numpy())
        nx, ny = (r["grams"].map(len).to_numpy() for r in (one, two))
        for i, (node, root, x) in enumerate(zip(one["node"], one["root"], one["grams"], strict=True)):
            near = (sy == sx[i]).sum(axis=1) >= need
            near &= (two["root"] != root).to_numpy() & (100 * nx[i] >= percent * ny) & (100 * ny >= percent * nx[i])
            for j in np.nonzero(near)[0]:
                both = np.sort(np.concatenate([x, two["grams"].iat[j]]))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                if 100 * common >= percent * (nx[i] + ny[j] - common):
                    other = int(two["node"].iat[j])
                    out.append((min(node, other), max(node, other)))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for batch in batches:
            batch = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
            if not len(batch):
                continue
            k = batch[["hub", "p", "q"]].to_numpy()
            starts = [0, *(np.nonzero((k[1:] != k[:-1]).any(axis=1))[0] + 1), len(batch)]
            kept = batch.iloc[starts[-2] :]
            found = [x for lo, hi in zip(starts[:-2], starts[1:-1], strict=True) for x in links(batch.iloc[lo:hi])]
            yield pd.DataFrame(found, columns=["a", "b"]).astype("int64")
        if kept is not None:
            yield pd.DataFrame(links(kept), columns=["a", "b"]).astype("int64")

    return run


def _grams(post: DataFrame, nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(node, grams): the full sets of all posted nodes, made once from their texts."""
    wanted = materialize(post.select("node").distinct().join(nodes.select("node", "fp", "first_id"), "node"))
    ids = wanted.select(F.coalesce("first_id", F.lit(NO_ID)).alias("wanted_id")).distinct()
    return (
        docs.join(ids, docs["doc_id"] == ids["wanted_id"], "left_semi")
        .select("text")
        .mapInPandas(_sets(words), "fp binary, grams array<bigint>")
        .dropDuplicates(["fp"])
        .join(wanted.select("node", "fp"), "fp")
        .select("node", "grams")
    )


def _verified(pairs: DataFrame, nodes: DataFrame, grams: DataFrame, percent: int, need: int) -> DataFrame:
    """The pairs whose signatures collide often enough and whose full sets are similar enough."""
    sig = nodes.select(F.col("node"), "sig")
    counted = (
        pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a")
        .join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
        .where(F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda same: same)) >= need)
        .select("a", "b")
    )
    return (
        materialize(counted)
        .join(grams.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a")
        .join(grams.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
        .select("a", "b", "x", "y")
        .mapInPandas(_confirm(percent), "a bigint, b bigint")
    )
