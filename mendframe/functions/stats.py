"""Exact statistics over groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendframe.functions.blocked import carried


def upper_median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """keys, n, `name`: the element at n div 2 of the sorted values.

    Equal values are counted before anything is ordered, and the running count
    is blocked by the integer part of the value, so a group of any size is
    never collected or sorted in one place.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    total = counts.groupBy(*keys).agg(F.sum("_n").alias("n"))
    upto = carried(counts, keys, ["_v"], F.floor(F.col("_v")), F.col("_n"), "sum", "_upto")
    return (
        upto.join(total, keys)
        .where(F.expr("_upto > n div 2"))
        .groupBy(*keys)
        .agg(F.first("n").alias("n"), F.min("_v").alias(name))
    )
