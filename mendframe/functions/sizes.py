"""The size of each picture.

Operators on grids and pixels take sizes as numbers, which then hold for all
pictures, or as SQL over columns of the table they size, so that every picture has
its own. `with_sizes` puts the columns there.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A size: a number for all pictures, or SQL over columns of the table.
Size = int | str


def with_sizes(df: DataFrame, frames: DataFrame, *columns: str, key: str = "image_id") -> DataFrame:
    """Adds `columns` of `frames` (one row per picture) to every row of `df`."""
    return df.join(frames.select(key, *columns), key)


def size_columns(df: DataFrame, *sizes: Size) -> list[str]:
    """The columns of `df` that the sizes mention, to be carried along."""
    named = {w for s in sizes if isinstance(s, str) for w in re.findall("[A-Za-z_][A-Za-z0-9_]*", s)}
    return [c for c in df.columns if c in named and c != "image_id"]


def pixel_sizes(pixels: DataFrame) -> DataFrame:
    """image_id, _width, _height of complete pixel tables."""
    return pixels.groupBy("image_id").agg((F.max("x") + 1).alias("_width"), (F.max("y") + 1).alias("_height"))
