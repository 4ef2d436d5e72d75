"""Top-k search, hard negatives and periodic runs against plain Python over the same rows."""

from __future__ import annotations

import hashlib
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from corpus import documents, prose

from mendframe.llm import hard_negatives, periodic_runs, topk_search, vector_tiles

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id bigint, embedding array<float>, label int, uid bigint, node int, fp string, score int, values string"


def vectors():
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v], i % 4) for i, v in enumerate(rng.standard_normal((160, 12)).astype(np.float32))]
    # A third are copies of two vectors, some with the same id too; some more lie close to them.
    rows += [(400 + i, rows[20 + i % 2][1], i % 4) for i in range(80)]
    near = np.asarray(rows[20][1]) + rng.standard_normal((40, 12)) * 0.02
    rows += [(600 + i, [float(x) for x in v], i % 3) for i, v in enumerate(near.astype(np.float32))]
    rows += [rows[20], rows[40], rows[200], (-100, rows[5][1], 2), (0, rows[7][1], 1), (None, rows[20][1], 1), (None, rows[9][1], 0)]
    rows += [(700, None, 1), (720, [], 1), (740, [NAN] + [1.0] * 11, 1), (760, [INF] * 12, 1), (780, [None] * 12, 1), (800, rows[3][1], None)]
    rows += [(820, [0.0] * 12, 1), (840, [1.0] * 5, 1), (860, [2.0] * 5, 1), (900, [3e38] * 12, 1), (880, [-0.5] * 12, 2)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", 3, "v") for r in rows], VECTORS)


def whole_numbers(rows, scale):
    for vec_id, v, label in rows:
        x = [NAN if c is None else float(c) for c in v or []]
        ok = x and all(np.isfinite(x)) and max(map(abs, x)) < 1e6
        yield vec_id, ([int(np.floor(c * scale)) for c in x] if ok else None), label


def first(entries, n):
    """By score, then id with None first; repeated rows tie."""
    return sorted(entries, key=lambda e: (-e[0], e[1] is not None, e[1] or 0))[:n]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("k, slices, depth, tile", [(20, 2, 10, 2048), (7, 3, 1, 16), (3, 1, 2, 32), (400, 2, 1, 64)])
def test_top_k(spark, k, slices, depth, tile):
    rows = list(whole_numbers(vectors(), 64))
    want = Counter()
    for i, (q, a, _) in enumerate(rows):
        if q is None or q % 20 or a is None:
            continue
        scores = [(dot(a, b), c) for j, (c, b, _) in enumerate(rows) if j != i and b is not None and len(a) == len(b)]
        want.update((q, r, c, s) for r, (s, c) in enumerate(first(scores, k), 1))
    got = topk_search.exact_top_k(
        frame(spark, vectors()), k=k, slices=slices, depth=depth, query_tile=min(tile, 8), tile=tile
    )
    assert Counter(tuple(r) for r in got.collect()) == want


def test_top_k_of_nothing(spark):
    none = frame(spark, vectors()).limit(0)
    assert not topk_search.exact_top_k(none).count()
    assert not topk_search.exact_top_k(frame(spark, [(20, None, 1), (1, [1.0], 1)])).count()


def test_strassen():
    rng = np.random.default_rng(0)
    for m, k, n, leaf in ((1, 1, 1, 1), (5, 7, 3, 1), (64, 64, 64, 8), (33, 12, 130, 4), (100, 64, 257, 16), (3, 200, 2, 1)):
        a, b = rng.integers(-1000, 1000, (m, k)), rng.integers(-1000, 1000, (k, n))
        assert (hard_negatives.strassen(a, b, leaf) == a @ b).all()
    big = np.full((4, 4), 2**29)
    assert (hard_negatives.strassen(big, -big, 1) == np.full((4, 4), -(2**60))).all()


def test_products_are_exact_beyond_doubles():
    a = np.array([[2**27 + 1, 3], [1, -7]], np.int32)
    assert vector_tiles.products(a, a).tolist() == [[(2**27 + 1) ** 2 + 9, 2**27 + 1 - 21], [2**27 + 1 - 21, 50]]


@pytest.mark.parametrize("tile", [16, 2048])
def test_hard_negatives(spark, tile):
    rows = list(whole_numbers(vectors(), 256))
    want = Counter()
    for i, (q, a, label) in enumerate(rows):
        if q is None or q % 20 or a is None or label is None:
            continue
        scores = [(dot(a, b), c, n) for j, (c, b, n) in enumerate(rows) if j != i and b is not None and n is not None and len(a) == len(b)]
        for top, p, _ in first([s for s in scores if s[2] == label], 5):
            hard = [s for s in scores if s[2] != label and 80 * top <= 100 * s[0] <= 100 * top]
            want.update((q, p, r, c, top, s) for r, (s, c, _) in enumerate(first(hard, 5), 1))
    from pyspark.sql import functions as F

    got = hard_negatives.hard_negatives(frame(spark, vectors()), F.col("vec_id") % 20 == 0, anchor_tile=min(tile, 8), tile=tile)
    assert want
    assert Counter(tuple(r) for r in got.collect()) == want
    assert not hard_negatives.hard_negatives(frame(spark, vectors()).limit(0)).count()


def brute_runs(words):
    out = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                out.setdefault((i, j + q), q)
            i = j + 1 if j == i else j
    return sorted((a, b - a, q) for (a, b), q in out.items())


def by_start(found):
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_of_random_sequences():
    r = random.Random(4)
    for _ in range(1500):
        n, letters = r.randrange(1, 120), r.choice((1, 2, 3, 9))
        s = [r.randrange(letters) for _ in range(n)]
        a, p = r.randrange(n), r.randrange(1, n + 1)
        s = [s[i] if i < a else s[a + (i - a) % p] for i in range(n)] + s[: r.randrange(n)]
        got = [tuple(x) for x in periodic_runs.runs(np.array(s), len(s)).tolist()]
        assert got == by_start(brute_runs(s)), s


def test_range_successor():
    rng = np.random.default_rng(2)
    values = rng.permutation(300)
    tree = periodic_runs.WaveletTree(values)
    lo = rng.integers(0, 300, 500)
    hi = np.minimum(300, lo + rng.integers(1, 90, 500))
    x = rng.integers(0, 400, 500)
    inside = [np.sort(values[a:b]) for a, b in zip(lo, hi, strict=True)]
    below = tree.below(lo, hi, x)
    assert below.tolist() == [int((v < c).sum()) for v, c in zip(inside, x, strict=True)]
    some = np.nonzero(below < hi - lo)[0]
    assert tree.at(lo[some], hi[some], below[some]).tolist() == [int(inside[i][below[i]]) for i in some]


def periodic_texts():
    r = random.Random(8)
    texts = [prose(i, 40 + 9 * i, 50) for i in range(30)]
    texts += ["a " * 5000, "a b\t" * 40, " ".join(["x"] * 11), " ".join(["x"] * 12), "one", "", None, " \n\t", prose(5, 9000, 3)]
    unit = prose(9, 700)
    texts += [unit + " " + unit, unit + "\n" + unit + " " + unit[:200], "é\x00 ß " * 9 + "end", "a\x85b\xa0c " * 13]
    texts += [" ".join(r.choice("ab") for _ in range(400)), texts[3], texts[3]]
    return texts


def test_find_runs(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(periodic_texts())] + [(None, "z " * 20, None, None, None), (3, "y w " * 20, "en", "s", 1)]
    docs = documents(spark, rows, extra=True).withColumnRenamed("mark", "runs").withColumnRenamed("key", "n_words")
    planted = periodic_runs.with_planted_tails(docs)
    got = periodic_runs.digest(periodic_runs.find_runs(planted))
    want = Counter()
    changed = 0
    for doc_id, text, *_ in rows:
        w = re.findall("[^ \t\n\x0b\x0c\r]+", text or "")
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
            changed += 1
        found = by_start(brute_runs(w)) if len(set(w)) > 1 or len(w) < 12 else [(0, len(w), 1)]
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        top = min(((-n, s, q) for s, n, q in found), default=None)
        of_top = (None,) * 4 if top is None else (top[1], -top[0], top[2], 1000 * -top[0] // top[2])
        want[(doc_id, len(found), *of_top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())] += 1
    assert changed > 2
    assert Counter(tuple(r) for r in got.collect()) == want
    none = periodic_runs.find_runs(docs.limit(0))
    assert not periodic_runs.digest(none).count()


def test_batches_hold_many_and_long_documents(spark, monkeypatch):
    """However documents are put together, each has its own runs."""
    texts = [t for t in periodic_texts() if t is not None and len(t) < 4000]
    docs = [t.split() for t in texts]
    for size in (1, 7, len(docs)):
        got = []
        for i in range(0, len(docs), size):
            got += [[tuple(x) for x in r.tolist()] for r in periodic_runs._together(docs[i : i + size], 12)[0]]
        assert got == [by_start(brute_runs(d)) for d in docs]
