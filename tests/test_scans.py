"""Sequential state by composition against plain runs, with blocks of any size and hot keys."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from mendframe.functions.scans import Follower
from mendframe.operators import edits, sessions


def plain_history(actions):
    i = t = 0
    for a in actions:
        if a in sessions.COMMITS:
            i = t = i + 1
        elif a == "undo":
            i = max(i - 1, 0)
        elif a == "redo":
            i = min(i + 1, t)
        yield i, t + 1


def plain_dc(values):
    p = 0
    for x in values:
        p = min(p + 2047, max(p - 2047, x))
        yield p


def test_history_functions():
    r = random.Random(3)
    for _ in range(1500):
        weights = r.choice([(1, 1, 1, 1), (0, 1, 9, 9), (0, 8, 9, 1), (0, 1, 20, 5), (1, 0, 5, 5)])
        codes = np.array(r.choices((0, 1, 2, 3), weights, k=r.randrange(60)), np.int64)
        f = sessions._history_function(codes)
        for _ in range(6):
            top = r.randrange(40)
            index = r.randrange(top + 1)
            run = sessions._history_run(codes, (index, top))
            want = (int(run[0][-1]), int(run[1][-1]) - 1) if len(codes) else (index, top)
            assert sessions._history_advance((index, top), f) == want


def test_dc_functions():
    r = random.Random(5)
    for _ in range(1500):
        size = r.choice((100, 3000, 6000, 40000))
        values = [r.randrange(-size, size) for _ in range(r.randrange(60))]
        f = Follower(edits.STEP_LIMIT)
        for x in values:
            f.take(x)
        for p in (*[r.randrange(-60000, 60000) for _ in range(8)], 0):
            run = edits._followed(np.array(values, np.int64), (p,))[0]
            assert Follower.value(f.description(), p) == (int(run[-1]) if values else p)


@pytest.mark.parametrize("block", [4, 64, 4096])
def test_session_history(spark, block):
    r = random.Random(block)
    sessions_of = {
        "hot": ["undo", "undo", "undo", "add"] * 256,
        "deep": ["add"] * 300 + ["undo"] * 400 + ["redo"] * 500 + ["undo"] * 3 + ["toggle", "redo", "undo"],
        "any": r.choices(("add", "undo", "redo", "look", "remove"), (1, 4, 4, 1, 1), k=900),
        None: ["redo", "undo", "clear"],
    }
    rows = [(s, k, a) for s, actions in sessions_of.items() for k, a in enumerate(actions)]
    r.shuffle(rows)
    got = sessions.session_history(spark.createDataFrame(rows, "session_id string, seq bigint, action string"), block=block)
    want = Counter((s, k, *it) for s, actions in sessions_of.items() for k, it in enumerate(plain_history(actions)))
    assert Counter(tuple(x) for x in got.select("session_id", "seq", "index", "depth").collect()) == want


@pytest.mark.parametrize("block", [3, 4096])
def test_output_dc(spark, block):
    """Steps beyond the limit in every block, which no guess of a carry survives."""
    r = random.Random(block)
    series = {
        (1, 0): [(-1) ** k * 30000 for k in range(500)],
        (1, 1): [k * 5000 for k in range(300)],
        (2, 0): [r.randrange(-32768, 32768) for _ in range(700)],
        (2, 2): [r.randrange(-900, 900) for _ in range(200)],
    }
    rows = [(i, c, u, [x, 1]) for (i, c), v in series.items() for u, x in enumerate(v)]
    got = edits.output_dc(spark.createDataFrame(rows, "image_id bigint, comp int, unit bigint, coef array<bigint>"), block=block)
    want = Counter((i, c, u, p) for (i, c), v in series.items() for u, p in enumerate(plain_dc(v)))
    assert Counter(tuple(x) for x in got.select("image_id", "comp", "unit", "out_dc").collect()) == want


def test_empty(spark):
    none = spark.createDataFrame([], "session_id string, seq bigint, action string")
    assert not sessions.session_history(none).count()
