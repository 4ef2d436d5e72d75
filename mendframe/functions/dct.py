"""The 8-point cosine basis used to read samples along a block edge."""

from __future__ import annotations

import math

EDGES = ["top", "bottom", "left", "right"]


def basis(k: int, n: int) -> float:
    return (math.sqrt(0.5) if k == 0 else 1.0) / 2.0 * math.cos((2 * n + 1) * k * math.pi / 16.0)


def _literal(values: list[float]) -> str:
    return "array(" + ", ".join(f"{v!r}D" for v in values) + ")"


def edge_expr(edge: str, dq: str) -> str:
    """SQL: the 8 samples along an edge of a dequantized block `dq` (64 values, natural order).

    The block is folded onto the edge first (one row or column of cosines),
    then transformed back along it.
    """
    fixed = 0 if edge in ("top", "left") else 7
    at = "b * 8 + a" if edge in ("top", "bottom") else "a * 8 + b"
    fold = _literal([basis(b, fixed) for b in range(8)])
    table = _literal([basis(a, n) for n in range(8) for a in range(8)])
    folded = f"transform(sequence(0, 7), a -> aggregate(sequence(0, 7), 0D, (s, b) -> s + get({fold}, b) * get({dq}, {at})))"
    return (
        f"get(transform(array({folded}), g -> transform(sequence(0, 7), n -> "
        f"aggregate(sequence(0, 7), 0D, (s, a) -> s + get({table}, n * 8 + a) * get(g, a)))), 0)"
    )
