"""Sequential state over one long key by composition: no rounds, no long task.

A block of a key's rows is described as a function of the state it starts
from. The functions, one row per block, are applied one after the other as they
stream by, which gives every block's start; then all blocks run side by side.
So any data takes the same three passes.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendframe.functions.lineage import materialize

State = tuple[int, ...]


def block_scan(
    rows: DataFrame,
    keys: list[str],
    pos: str,
    value: str,
    block: int,
    initial: State,
    describe: Callable[[np.ndarray], list[int]],
    advance: Callable[[State, list[int]], State],
    run: Callable[[np.ndarray, State], list[np.ndarray]],
    names: list[str],
) -> DataFrame:
    """`keys`, `pos` and the columns `names`: what `run` gives for each row, in order of the bigint `pos`.

    `describe` turns a block's values (bigint) into a list of numbers, `advance`
    takes a state through such a description, `run` takes the values and a
    state to one array per name.
    """
    # Keys pass through Python as one string, so that any type and NULL do.
    parts = materialize(
        rows.select(F.to_json(F.struct(*keys)).alias("key"), F.col(pos).alias("pos"), F.col(value).cast("bigint").alias("value"))
        .groupBy("key", F.expr(f"pos div {block}").alias("b"))
        .agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("v"))
        .select("key", "b", F.col("v.pos").alias("at"), F.col("v.value").alias("values"))
    )

    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "b": batch["b"], "f": [describe(v) for v in batch["values"]]})

    def starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = initial
        for batch in batches:
            out = []
            for first, f in zip(batch["first"], batch["f"], strict=True):
                if first:
                    state = initial
                out.append(list(state))
                state = advance(state, f)
            yield pd.DataFrame({"key": batch["key"], "b": batch["b"], "state": out})

    def emitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [run(v, tuple(int(x) for x in s)) for v, s in zip(batch["values"], batch["state"], strict=True)]
            columns = dict(zip(names, map(list, zip(*found, strict=True)), strict=True)) if found else {n: [] for n in names}
            yield pd.DataFrame({"key": batch["key"], "at": batch["at"]} | columns)

    functions = parts.select("key", "b", "values").mapInPandas(described, "key string, b bigint, f array<bigint>")
    in_order = Window.partitionBy("key").orderBy("b")
    begun = functions.withColumn("first", F.row_number().over(in_order) == 1).mapInPandas(
        starts, "key string, b bigint, state array<bigint>"
    )
    arrays = ", ".join(f"{n} array<bigint>" for n in names)
    done = parts.join(begun, ["key", "b"]).select("key", "at", "values", "state").mapInPandas(
        emitted, f"key string, at array<bigint>, {arrays}"
    )
    schema = T.StructType([rows.schema[k] for k in keys])
    flat = done.select(F.from_json("key", schema).alias("k"), F.explode(F.arrays_zip(F.col("at").alias(pos), *names)).alias("r"))
    return flat.select(*[F.col(f"k.{k}").alias(k) for k in keys], F.col(f"r.{pos}").alias(pos), *[F.col(f"r.{n}").alias(n) for n in names])


def corners(y: np.ndarray) -> list[int]:
    """A function on 0, 1, 2, ... that is linear between few points, as [count, x..., y...]."""
    bend = np.nonzero(np.diff(y, n=2))[0] + 1
    x = np.unique(np.r_[0, bend, len(y) - 1])
    return [len(x), *x.tolist(), *y[x].tolist()]


def at_corner(f: list[int], x: int, slope: int) -> int:
    """Its value at x; behind its last point it goes on with `slope`."""
    n = int(f[0])
    xs, ys = f[1 : n + 1], f[n + 1 : 2 * n + 1]
    k = bisect_right(xs, x) - 1
    if k == n - 1:
        return int(ys[k]) + slope * (x - int(xs[k]))
    return int(ys[k]) + (x - int(xs[k])) * (int(ys[k + 1]) - int(ys[k])) // (int(xs[k + 1]) - int(xs[k]))


class Follower:
    """p -> min(p + limit, max(p - limit, x)), one x after the other, as a function of the first p.

    Non-decreasing, in pieces of slope 0 and 1, with slope 1 at both ends: kept as
    its corners. A new x makes all values within the limit one, so corners
    vanish about as often as they come.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.xs: list[int] = []
        self.ys: list[int] = []
        self.shift = 0  # while there are no corners

    def _meets(self, y: int, k: int) -> int:
        """Where the piece before corner k takes the value y (of slope 1, or a corner's)."""
        if k == 0:
            return self.xs[0] - (self.ys[0] - y)
        if k == len(self.xs):
            return self.xs[-1] + (y - self.ys[-1])
        return self.xs[k - 1] + (y - self.ys[k - 1]) if self.ys[k] > self.ys[k - 1] else self.xs[k - 1]

    def take(self, x: int) -> None:
        low, high = x - self.limit, x + self.limit
        if not self.xs:
            self.xs, self.ys = [low - self.shift, high - self.shift], [x, x]
            return
        i, j = bisect_left(self.ys, low), bisect_right(self.ys, high)
        first, last = self._meets(low, i), self._meets(high, j)
        self.xs[i:j] = [first, last]
        self.ys = [y + self.limit for y in self.ys[:i]] + [x, x] + [y - self.limit for y in self.ys[j:]]
        # Corners in the middle of a straight line go.
        if i > 0 and self.xs[i] - self.xs[i - 1] == self.ys[i] - self.ys[i - 1] == 0:
            del self.xs[i - 1], self.ys[i - 1]

    def description(self) -> list[int]:
        return [len(self.xs), *self.xs, *self.ys]

    @staticmethod
    def value(f: list[int], p: int) -> int:
        n = int(f[0])
        if not n:
            return p
        xs, ys = f[1 : n + 1], f[n + 1 : 2 * n + 1]
        if p <= xs[0]:
            return int(ys[0]) - (int(xs[0]) - p)
        if p >= xs[n - 1]:
            return int(ys[n - 1]) + (p - int(xs[n - 1]))
        k = bisect_right(xs, p) - 1
        return int(ys[k]) + (p - int(xs[k]) if ys[k + 1] > ys[k] else 0)
