"""Recipes compiled to ranges against a picture edited position by position."""

from __future__ import annotations

import random

import numpy as np
import pytest

from mendframe.operators import replay as rp


def plain(total, width, steps, units=1):
    """Columns source, paste step, flags, d0, d1, d2 of every position."""
    now = np.array([[p, -1, 0, 0, 0, 0] for p in range(total)], np.int64).reshape(-1, 6)
    p = np.arange(total)
    for o in steps:
        op, a, b = o["op"], o["a"], o["b"]
        single = op.startswith("unit")
        at = (o["row"] * width + o["col"]) * units + (b if single else 0)
        n = a * (1 if single else units)
        was, source, hit = now.copy(), p.copy(), np.zeros(total, bool)
        if op in ("insert", "unitInsert"):
            hit = p >= at + n
            source = p - n
        elif op in ("delete", "unitDelete"):
            hit = (p >= at) & (p + n < total)
            source = p + n
        elif op == "paste":
            on = (p >= at) & (p < at + n)
            now[on] = 0
            now[on, 0], now[on, 1], now[on, 2] = p[on] - at, o["step_no"], rp.PASTED
            continue
        else:
            col = p // units % width
            if o["mask"] is not None:
                lit = np.frombuffer(o["mask"], np.uint8)
                hit = (p // units < len(lit)) & (np.append(lit, 0)[np.minimum(p // units, len(lit))] != 0)
            elif o["h"] > 0:
                hit = (p >= at) & (p < at + ((o["h"] - 1) * width + o["w"]) * units) & (col >= o["col"]) & (col < o["col"] + o["w"])
            else:
                hit = (p >= at) & ((p < at + o["w"] * units) | (o["w"] == 0))
            if op == "copy":
                source = p + (a * width + b) * units
                hit &= (col + b >= 0) & (col + b < width) & (source >= 0) & (source < total)
        now[hit] = was[source[hit]]
        now[hit, 2] |= rp.DC if op == "cdelta" else rp.MOVED
        if op == "cdelta":
            now[hit, 3 + a] += b
    return now


def random_steps(r, n, width, rows, units):
    ops = ["insert", "delete", "paste", "cdelta", "copy"] + (["unitInsert", "unitDelete"] if units > 1 else [])
    for k in range(n):
        op = r.choice(ops)
        mask = bytes(r.choice((0, 0, 1)) for _ in range(r.randrange(width * rows))) if op in ("cdelta", "copy") and r.random() < (0.2 if rows < 9 else 0.01) else None
        a = r.randrange(3) if op == "cdelta" else r.randrange(-3, 4) if op == "copy" else r.randrange(1, 9)
        b = r.randrange(-9, 9) if op == "cdelta" else r.randrange(-3, 4) if op == "copy" else r.randrange(units)
        yield {
            "step_no": k * 3, "op": op, "row": r.randrange(rows + 1), "col": r.randrange(width), "h": r.choice((0, 1, 3)),
            "w": r.randrange(0, width + 3), "a": a, "b": b, "mask": mask,
        }


def spread(pieces):
    pieces.merge()
    out = np.repeat(pieces.rows, pieces.lengths(), axis=0)
    out[:, 1] += np.arange(pieces.total) - out[:, 0]
    return out[:, 1:]


def test_ranges_of_random_recipes():
    r = random.Random(11)
    for _ in range(300):
        width, rows, units = r.randrange(1, 9), r.randrange(1, 9), r.choice((1, 1, 3))
        total = width * rows * units
        steps = list(random_steps(r, r.randrange(25), width, rows, units))
        pieces = rp.Pieces(total)
        for o in steps:
            rp.apply_operation(pieces, o, width, units)
        assert (spread(pieces) == plain(total, width, steps, units)).all(), steps


@pytest.mark.parametrize("block, rows", [(7, 9), (1024, 150)])
def test_long_recipes_and_pictures_without_one(spark, block, rows):
    """10,000 steps on one large picture, one short recipe, one picture without steps, one without positions."""
    r = random.Random(block)
    width = 200
    total = width * rows
    many, few = list(random_steps(r, 10_000, width, rows, 1)), list(random_steps(r, 5, 6, 4, 1))
    rows_of = [(i, o["step_no"], "ops", True, *[o[c] for c in ("op", "row", "col", "h", "w", "a", "b", "mask")]) for i, s in (("big", many), (None, few)) for o in s]
    steps = spark.createDataFrame(
        rows_of,
        "image_id string, step_no bigint, kind string, enabled boolean, op string, row bigint, col bigint, h bigint, w bigint, a bigint, b bigint, mask binary",
    )
    grid = spark.createDataFrame([("big", total, width), ("bare", 10, 5), ("none", 0, 5)], "image_id string, total bigint, wide int")
    got = rp.trace(grid, rp.recipes(steps, block), "wide").toPandas().sort_values(["image_id", "m"])
    big = got[got.image_id == "big"]
    want = plain(total, width, many)
    assert (big.m == np.arange(total)).all()
    live = want[:, 1] < 0
    assert (big.src.fillna(-1) == np.where(live, want[:, 0], -1)).all()
    assert (big.paste_step.fillna(-1) == want[:, 1]).all() and (big.paste_i.fillna(-1) == np.where(live, -1, want[:, 0])).all()
    assert (big[["flags", "d0", "d1", "d2"]].to_numpy() == want[:, 2:]).all()
    assert got[got.image_id == "bare"].src.tolist() == list(range(10)) and not (got.image_id == "none").any()
