"""Keeping an expensive column computed once.

Catalyst copies a deterministic expression into every filter and projection it
pushes past its definition. For a fold over a file's markers that means walking
the file again for each mention, and nested definitions multiply. Guarding the
expression with a predicate that is always true but not deterministic keeps it
where it is defined; unused columns are still pruned.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(expr: str) -> Column:
    return F.expr(f"CASE WHEN spark_partition_id() >= 0 THEN {expr} END")
