"""Mixing sources to target weights by hierarchical budgets; DataFrame operations only.

Sources form a tree, by default domain, language, source. A token budget goes down
from the root: at each node the children share it by weight, none gets more
than its subtree can give, and what one lacks goes to its siblings first. Only
when a whole subtree falls short does the level above, where the subtree is one
of the siblings, share the rest. A leaf gives its documents in seeded
epochs, each in an order of its own, until its budget is reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mendframe.functions.blocked import carried
from mendframe.functions.lineage import materialize
from mendframe.llm.common import word_count

LEVELS = ("domain", "lang", "source")

#: Target weights (level, name, weight) that the query and the pipeline mix to: fixed values.
TARGETS = [
    ("domain", "src-0", 3),
    ("domain", "src-1", 2),
    ("lang", "en", 4),
    ("lang", "de", 2),
    *[("source", f"src{i}", 1 + i % 3) for i in range(20)],
]


def target_weights(spark: SparkSession, targets: list[tuple[str, str, int]] = TARGETS) -> DataFrame:
    """(level, name, weight) of a short list."""
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{a}', '{b}', {w}L)" for a, b, w in targets) + " AS t(level, name, weight)")


def domain_of(source: Column) -> Column:
    """A source's domain where none is given: its name without digits at the end, with their last one's parity."""
    digit = F.coalesce(F.regexp_extract(source, "([0-9])$", 1).try_cast("int"), F.lit(0))
    return F.concat(F.regexp_replace(F.coalesce(source, F.lit("")), "[0-9]+$", ""), F.lit("-"), F.pmod(digit, F.lit(2)).cast("string"))


def budgets(leaves: DataFrame, total: int, levels: tuple[str, ...], epochs: int, weights: DataFrame | None = None) -> DataFrame:
    """`leaves` (the levels, tokens) with each leaf's `budget`.

    `weights` (level, name, weight) gives integer weights of nodes by their level
    and name. Nodes that it does not list, and those whose weight is NULL, weigh 1; of repeated
    entries the largest counts. A node of weight 0 is left out with all its leaves,
    so its siblings share what it could have given; a weight below 0 stops the job.

    The share of a node is found in closed form: children in order of capacity per
    weight are filled up as long as their share by weight of what is left exceeds their capacity.
    Shares are rounded down, so up to one token per node stays unused.
    """
    one = F.lit(1).cast("bigint")
    for level in levels:
        if weights is None:
            leaves = leaves.withColumn(f"w_{level}", one)
            continue
        own = weights.where(F.col("level") == level).groupBy(F.col("name").alias("__name")).agg(F.max(F.coalesce(F.col("weight").cast("bigint"), one)).alias("w"))
        leaves = leaves.join(own, leaves[level] == own["__name"], "left").drop("__name").withColumnRenamed("w", f"w_{level}")
        leaves = leaves.withColumn(f"w_{level}", F.coalesce(f"w_{level}", one))
    if weights is not None:
        least = F.least(*[f"w_{x}" for x in levels])
        leaves = leaves.where(F.when(least < 0, F.raise_error(F.lit("a weight is below 0")).cast("boolean")).otherwise(least > 0))
    leaves = leaves.withColumn("cap", F.col("tokens") * epochs)
    parent = leaves.groupBy().agg(F.least(F.lit(total).cast("bigint"), F.coalesce(F.sum("cap"), F.lit(0))).alias("budget"))
    for depth in range(1, len(levels) + 1):
        keys = list(levels[:depth])
        node = leaves.groupBy(*keys).agg(F.sum("cap").alias("cap"), F.max(f"w_{keys[-1]}").alias("w"))
        node = node.join(parent, keys[:-1]) if keys[:-1] else node.crossJoin(F.broadcast(parent))
        by = Window.partitionBy(*keys[:-1]) if keys[:-1] else Window.partitionBy(F.lit(0))
        order = by.orderBy((F.col("cap").cast("double") / F.col("w")).asc_nulls_last(), keys[-1])
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        ahead = order.rowsBetween(0, Window.unboundedFollowing)
        node = node.withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("among", F.sum("w").over(ahead))
        # The first child that its share does not fill, and all behind it, share what is left by weight.
        fills = F.col("left").cast("decimal(20,0)") * F.col("w").cast("decimal(18,0)") >= F.col("cap").cast("decimal(20,0)") * F.col("among").cast("decimal(18,0)")
        node = node.withColumn("open", F.max(F.when(fills, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        rest = by.orderBy("open").rangeBetween(0, 0)
        first = F.when(F.col("open") == 1, F.max("left").over(rest))
        among = F.when(F.col("open") == 1, F.max("among").over(rest))
        share = F.floor(first.cast("decimal(20,0)") * F.col("w").cast("decimal(17,0)") / among.cast("decimal(17,0)"))
        node = node.withColumn(
            "given", F.when(F.col("open") == 0, F.col("cap")).otherwise(F.least(share.cast("bigint"), F.col("cap")))
        )
        parent = node.select(*keys, F.col("given").cast("bigint").alias("budget"))
    return leaves.join(parent, list(levels)).select(*levels, "tokens", "budget")


def mix(
    docs: DataFrame,
    total: int | None = None,
    epochs: int = 4,
    seed: int = 20,
    weights: DataFrame | None = None,
    tokens: Column | None = None,
    levels: tuple[str, ...] = LEVELS,
) -> DataFrame:
    """Selected documents: `levels`, doc_id, mark, epoch, n_tokens, n_taken.

    One row per document and epoch that reaches into the leaf's budget; n_taken is
    below n_tokens for the one that the budget cuts. `total` defaults to
    the tokens there are; `weights` as for `budgets`. Levels missing among the columns: domain is derived
    from source. A leaf whose budget is k times its tokens gives every document
    in k epochs, and a seeded prefix of one more; only that epoch is put in
    order, in blocks of the leading hash digits, so a leaf of any size is many
    tasks.

    NULL levels are a level's value of their own ('?'). Documents without
    tokens are never selected. Repeated rows count and are selected each, under one
    place in the order. mark is a hash of the text. An empty table gives an
    empty result; other columns are ignored.
    """
    if "domain" in levels and "domain" not in docs.columns:
        docs = docs.withColumn("domain", domain_of(F.col("source")))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.md5(F.coalesce("text", F.lit(""))).alias("mark"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("?")).alias(c) for c in levels],
        (word_count(F.col("text")) if tokens is None else tokens.cast("bigint")).alias("n_tokens"),
    ).where("n_tokens > 0")
    rows = materialize(rows)
    leaves = materialize(rows.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens")))
    if total is None:
        total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    plan = materialize(budgets(leaves, total, levels, epochs, weights)).select(
        *levels,
        F.expr("budget div tokens").cast("int").alias("full"),
        (F.col("budget") % F.col("tokens")).alias("rest"),
    )
    placed = rows.join(plan, list(levels))
    out = ["doc_id", "mark", *levels, "epoch", "n_tokens", "n_taken"]
    whole = (
        placed.where("full > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("full"))))
        .withColumn("n_taken", F.col("n_tokens"))
    )
    key = F.md5(F.concat_ws("/", F.lit(str(seed)), (F.col("full") + 1).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "mark"))
    partial = placed.where("rest > 0").withColumn("order", key)
    # Repeated rows share a place: number them inside it.
    twin = Window.partitionBy(*levels, "order").orderBy("n_tokens")
    partial = partial.withColumn("twin", F.row_number().over(twin))
    upto = carried(partial, list(levels), ["order", "twin"], F.substring("order", 1, 3), F.col("n_tokens"), "sum", "upto")
    last = (
        upto.withColumn("n_taken", F.least("n_tokens", F.col("rest") - (F.col("upto") - F.col("n_tokens"))))
        .where("n_taken > 0")
        .withColumn("epoch", F.col("full") + 1)
    )
    return whole.select(*out).unionByName(last.select(*out))
