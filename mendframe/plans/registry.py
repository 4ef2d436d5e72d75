"""Registry of runnable queries.

A query is declared once with its output columns; the same declaration
projects both the Spark result and the SQL twin, so names, order and types
agree. Column kinds: i bigint, d double rounded to 6 places, s string,
b boolean as 0/1 bigint.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    name: str
    columns: tuple[tuple[str, str], ...]
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(spark, sf_dir).select(*[_shape(n, k) for n, k in self.columns])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        body = self.sql.strip()
        ctes, _, final = body.rpartition("---")
        outer = ", ".join(_shape_sql(n, k) for n, k in self.columns)
        head = f"{ctes.strip()}\n" if ctes.strip() else ""
        return f"{head}SELECT {outer} FROM (\n{final.strip()}\n) AS result"


QUERIES: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None):
    """Registers the decorated function. In `sql`, `---` separates the WITH list
    from the final SELECT, so that the final SELECT can be wrapped."""
    pairs = tuple(tuple(c.strip().split(":")) for c in columns.split(","))

    def register(fn):
        QUERIES[name] = Query(name, pairs, fn, sql)
        return fn

    return register


def _shape(name: str, kind: str):
    c = F.col(f"`{name}`")
    if kind == "i":
        return c.cast("bigint").alias(name)
    if kind == "b":
        return c.cast("boolean").cast("bigint").alias(name)
    if kind == "d":
        return (F.round(c.cast("double"), 6) + F.lit(0.0)).alias(name)
    return c.cast("string").alias(name)


def _shape_sql(name: str, kind: str) -> str:
    if kind == "i":
        return f'CAST("{name}" AS BIGINT) AS "{name}"'
    if kind == "b":
        return f'CAST(CAST("{name}" AS BOOLEAN) AS BIGINT) AS "{name}"'
    if kind == "d":
        return f'round(CAST("{name}" AS DOUBLE), 6) + 0.0 AS "{name}"'
    return f'CAST("{name}" AS VARCHAR) AS "{name}"'
