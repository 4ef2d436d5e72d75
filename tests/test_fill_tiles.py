"""The fill in tiles: pictures of several tiles and odd sizes against levels of whole pictures, and no row kept for a pixel."""

import numpy as np

from mendframe.operators import fill as fl

SIZES = {1: (150, 70), 2: (24, 9), 3: (64, 64), 4: (200, 131), 5: (65, 1)}


def _whole(o, c, hole):
    """The answer filled with levels of the whole picture."""
    levels = [(np.where(hole, 0, o - c), (~hole).astype(float))]
    while max(levels[-1][1].shape) > 1:
        v, w = levels[-1]
        h, n = (-(-s // 2) for s in w.shape)
        pad = lambda a, h=h, n=n: np.pad(a, [(0, 0)] * (a.ndim - 2) + [(0, 2 * h - a.shape[-2]), (0, 2 * n - a.shape[-1])])
        four = lambda a, h=h, n=n: pad(a).reshape(*a.shape[:-2], h, 2, n, 2).sum(axis=(-3, -1))
        total = four(w)
        levels.append((np.where(total > 0, four(v * w) / np.maximum(total, 1), 0), np.minimum(total, 1)))
    above = levels[-1][0]
    for v, w in levels[-2::-1]:
        read = np.zeros(v.shape)
        (y, ys), (x, xs) = (
            (at - np.floor(at), (np.floor(at).astype(int), np.minimum(np.floor(at).astype(int) + 1, n - 1)))
            for n, at in ((n, np.clip((np.arange(s) + 0.5) / 2 - 0.5, 0, n - 1)) for s, n in zip(w.shape, above.shape[1:], strict=True))
        )
        for j in range(2):
            for i in range(2):
                part = np.outer(y if j else 1 - y, x if i else 1 - x)
                read += part * above[:, ys[j][:, None], xs[i][None, :]]
        above = v * w + read * (1 - w)
    filled = np.clip(np.floor(c + above + 0.5), 0, 255)
    return np.where(hole & (~hole).any(), filled, c)


def test_tiles_equal_whole_pictures_and_keep_no_row_for_a_pixel(spark, monkeypatch):
    rng = np.random.default_rng(1)
    original, answer, holes, want = [], [], [], {}
    for image, (width, height) in SIZES.items():
        o, c = rng.integers(0, 256, (2, 3, height, width))
        hole = np.zeros((height, width), bool)
        # More than a tile in picture 4, everything in picture 5, scattered pixels elsewhere.
        if image == 4:
            hole[30:131, 20:150] = True
        elif image == 5:
            hole[:] = True
        else:
            hole = rng.random((height, width)) < 0.4
        done = _whole(o, c, hole)
        for y, x in np.ndindex(height, width):
            original.append((image, x, y, *map(int, o[:, y, x])))
            answer.append((image, x, y, *map(int, c[:, y, x])))
            want[image, x, y] = tuple(done[:, y, x])
            if hole[y, x]:
                holes.append((image, x, y))
    pixels = "image_id bigint, x bigint, y bigint, c0 bigint, c1 bigint, c2 bigint"
    kept, keep = [], fl.materialize

    def counted(df):
        kept.append(keep(df))
        return kept[-1]

    monkeypatch.setattr(fl, "materialize", counted)
    got = fl.fill_differences(
        spark.createDataFrame(original, pixels), spark.createDataFrame(answer, pixels), spark.createDataFrame(holes, "image_id bigint, x bigint, y bigint")
    ).collect()
    assert len(got) == len(want) and len({r[:3] for r in map(tuple, got)}) == len(want)
    # Means in another order may turn a half the other way.
    off = [abs(r[f"c{i}"] - want[r["image_id"], r["x"], r["y"]][i]) for r in got for i in range(3)]
    assert max(off) <= 1 and sum(off) <= len(off) / 10_000
    assert max(df.count() for df in kept) * 50 < len(want)


def test_a_picture_cut_short_equals_its_sql(spark, tmp_path):
    """The last picture's vectors end within the hole: its size still is that of the others, and there is nothing where it ends."""
    import duckdb
    from __spark_entry__ import _queries
    from compare import compare

    rng = np.random.default_rng(3)
    vectors = [(i, [float(v) for v in rng.normal(0, 0.1, 64)]) for i in range(64 + 30)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    rows, _, difference = compare(spark, con, _queries()["g26_fill_differences"], str(tmp_path))
    assert rows > 64 * 48 and not difference
