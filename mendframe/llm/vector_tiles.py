"""Vectors of integers packed into tiles, for products of a query set with all rows in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendframe.llm.common import saved

#: A place in a tile is below this; (place of the query, place of the row) is one code.
PLACES = 1 << 12


def usable(vector: str, scale: int) -> Column:
    """Neither NULL nor empty, no NULL or non-finite component, and scores of such vectors fit 64 bits."""
    sizes = F.transform(F.col(vector), lambda c: F.abs(c.cast("double") * scale))
    finite = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != float("inf")))
    most = F.array_max(sizes) + 1
    fits = (most < 2.0**31) & (most * most * F.size(vector) < 2.0**62)
    return F.coalesce((F.size(vector) > 0) & finite & fits, F.lit(False))


def quantised(vector: str, scale: int) -> Column:
    return F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * scale).cast("int"))


def packed(rows: DataFrame, tile: int, name: str, parts: int = 1) -> DataFrame:
    """Rows (values array<int> and bigint columns) as tiles of at most `tile` rows, written to the shared folder.

    Columns: tile (unique), dim (components of its vectors), an array per
    column of `rows`, and `slices`: the matrix of every `parts`-th component,
    one of each start, as little-endian 32-bit integers.
    """
    if tile > PLACES:
        raise ValueError(f"a tile holds at most {PLACES} rows")
    columns = [c for c in rows.columns if c != "values"]
    wanted = max(1, -(-rows.count() // tile))
    schema = "tile bigint, dim int, " + "".join(f"{c} array<bigint>, " for c in columns) + "slices array<binary>"

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        base, made, held = TaskContext.get().partitionId() << 32, 0, {}

        def frame(dim: int, pieces: list[pd.DataFrame]) -> pd.DataFrame:
            piece = pd.concat(pieces, ignore_index=True)
            x = np.stack(piece["values"].to_numpy()).astype("<i4")
            row = {"tile": base + made, "dim": dim} | {c: piece[c].to_numpy(np.int64) for c in columns}
            return pd.DataFrame([row | {"slices": [np.ascontiguousarray(x[:, s::parts]).tobytes() for s in range(parts)]}])

        for batch in batches:
            for dim, piece in batch.groupby(batch["values"].map(len)):
                if dim in held:
                    piece = pd.concat([held.pop(dim), piece])
                for lo in range(0, len(piece) - tile + 1, tile):
                    yield frame(dim, [piece.iloc[lo : lo + tile]])
                    made += 1
                if len(piece) % tile:
                    held[dim] = piece.iloc[len(piece) - len(piece) % tile :]
        for dim, piece in held.items():
            yield frame(dim, [piece])
            made += 1

    return saved(rows.repartition(wanted).mapInPandas(pack, schema), name)


def matrix(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<i4").reshape(n, -1)


def whole(slices: list[bytes], n: int) -> np.ndarray:
    """The matrix of all components, from its slices."""
    parts = [matrix(s, n) for s in slices]
    out = np.empty((n, sum(p.shape[1] for p in parts)), np.int32)
    for s, p in enumerate(parts):
        out[:, s :: len(parts)] = p
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices: by doubles where those are exact."""
    most = a.shape[1] * float(np.abs(a.astype(np.int64)).max(initial=0)) * float(np.abs(b.astype(np.int64)).max(initial=0))
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T
