"""Ordered computations over one long key, without one long task.

A window partitioned by image or source puts a hot key into a single task.
These helpers cut the order of each key into blocks, work inside
(key, block), and carry only one summary row per block across block borders.
The rows themselves shuffle once, on (key, block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def blocked_row_number(
    df: DataFrame, keys: list[str], order: list[str], block: Column, name: str
) -> DataFrame:
    """Adds the 0-based position of each row within its key.

    `block` must be non-decreasing along `order`.
    """
    cols = df.columns
    tagged = df.withColumn("_block", block)
    by_block = [*keys, "_block"]
    offsets = (
        tagged.groupBy(*by_block)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_before",
            F.sum("_n").over(
                Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .select(*by_block, F.coalesce("_before", F.lit(0)).alias("_before"))
    )
    local = tagged.withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*by_block).orderBy(*order))
    )
    return local.join(offsets, by_block).select(
        *cols, (F.col("_before") + F.col("_rn") - 1).alias(name)
    )


def with_halo(
    df: DataFrame, keys: list[str], pos: str, before: int, after: int = 0, block: int = BLOCK
) -> DataFrame:
    """Copies rows near a block border into the neighbouring block.

    Adds `_block` and `_own`. A window over (keys, _block) then sees every row
    within `before` positions back and `after` ahead of each row with
    `_own`; drop the others afterwards. `before` and `after` may exceed one
    block. The copies are (before + after) / block of the rows.
    """
    p, b = F.col(pos), F.lit(block)
    first = F.floor((p - after) / b)
    last = F.floor((p + before) / b)
    home = F.floor(p / b)
    return (
        df.withColumn("_block", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
        .withColumn("_own", F.col("_block") == home)
    )


def halo_window(keys: list[str], pos: str) -> Window:
    return Window.partitionBy(*keys, "_block").orderBy(pos)


def at_offset(col: str, keys: list[str], pos: str, offset: int) -> Column:
    """The value at position pos + offset (NULL where no such row), inside a halo block."""
    return F.first(col).over(halo_window(keys, pos).rangeBetween(offset, offset))


def carried(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    block: Column,
    value: Column,
    how: str,
    name: str,
    backwards: bool = False,
    inclusive: bool = True,
) -> DataFrame:
    """Running max, min or sum of `value` up to the row (or from it, `backwards`).

    NULLs are skipped. `block` must be monotone along `order`. Only one row
    per (key, block) crosses block borders.
    """
    agg = {"max": F.max, "min": F.min, "sum": F.sum}[how]
    combine = {
        "max": lambda a, b: F.greatest(a, b),
        "min": lambda a, b: F.least(a, b),
        "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    }[how]
    cols = df.columns
    tagged = df.withColumn("__block", block).withColumn("__v", value)
    by_block = [*keys, "__block"]
    way = (lambda c: F.col(c).desc()) if backwards else (lambda c: F.col(c).asc())
    first = Window.unboundedPreceding
    inside = (
        Window.partitionBy(*by_block).orderBy(*[way(c) for c in order]).rowsBetween(first, 0 if inclusive else -1)
    )
    across = Window.partitionBy(*keys).orderBy(way("__block")).rowsBetween(first, -1)
    summary = (
        tagged.groupBy(*by_block)
        .agg(agg("__v").alias("__s"))
        .withColumn("__carry", agg("__s").over(across))
        .select(*by_block, "__carry")
    )
    return (
        tagged.withColumn("__in", agg("__v").over(inside))
        .join(summary, by_block)
        .select(*cols, combine(F.col("__in"), F.col("__carry")).alias(name))
    )
