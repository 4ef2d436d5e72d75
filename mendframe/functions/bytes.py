"""SQL fragments that read integers and signatures out of a binary column.

Offsets are 0-based, as they are everywhere in the package; Spark's
`substring` is 1-based. A read past the end yields NULL.
"""

from __future__ import annotations


def cut(blob: str, off: str, length: str | int) -> str:
    """`length` bytes from 0-based `off`."""
    return f"substring({blob}, cast({off} as int) + 1, cast({length} as int))"


def u8(blob: str, off: str) -> str:
    return f"cast(conv(hex({cut(blob, off, 1)}), 16, 10) as int)"


def be16(blob: str, off: str) -> str:
    return f"cast(conv(hex({cut(blob, off, 2)}), 16, 10) as int)"


def be32(blob: str, off: str) -> str:
    return f"cast(conv(hex({cut(blob, off, 4)}), 16, 10) as bigint)"


def u16(blob: str, off: str, little: str) -> str:
    """A 16-bit value in the byte order given by the boolean expression `little`."""
    return (
        f"(CASE WHEN {little} THEN {u8(blob, off)} + 256 * {u8(blob, f'({off}) + 1')} "
        f"ELSE {be16(blob, off)} END)"
    )


def u32(blob: str, off: str, little: str) -> str:
    swapped = "concat(" + ", ".join(cut(blob, f"({off}) + {i}", 1) for i in (3, 2, 1, 0)) + ")"
    return (
        f"(CASE WHEN {little} THEN cast(conv(hex({swapped}), 16, 10) as bigint) "
        f"ELSE {be32(blob, off)} END)"
    )


def latin1(blob: str) -> str:
    """Bytes as text, one character per byte."""
    return f"decode({blob}, 'ISO-8859-1')"
