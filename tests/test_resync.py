"""Seam costs and the ranking of candidates against plain Python."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from mendframe.operators import mcu_stream as ms


def test_seam_cost(spark):
    r = random.Random(2)
    width = {1: 5, 2: 7}
    side = lambda: [float(r.randrange(256)) for _ in range(8)]
    around = {(f, m): (side(), side()) for f in width for m in range(20)}
    trials = {(f, c, k): (m0 + k, side(), side(), side()) for f in width for c, m0 in enumerate((0, 1, 4, 5, 9, 13, 40)) for k in (0, 1, 2)}
    del trials[(2, 3, 1)]
    rows = [(f, c, k, m, width[f], t, left, right) for (f, c, k), (m, t, left, right) in trials.items()]
    blocks = spark.createDataFrame(rows, "file_id int, cand_id int, k int, m bigint, wide int, top array<double>, left array<double>, right array<double>")
    beside = spark.createDataFrame([(f, m, *v) for (f, m), v in around.items()], "file_id int, m bigint, bottom array<double>, right array<double>")
    step = lambda a, b: sum(abs(x - y) for x, y in zip(a, b, strict=True)) / 8
    want = {}
    for (f, c, k), (m, top, left, right) in trials.items():
        if k or (f, c, 1) not in trials:
            continue
        w, (m1, top1, left1, _) = width[f], trials[(f, c, 1)]
        cost = step(around[f, m - 1][1], left) if m % w and (f, m - 1) in around else 0
        cost += step(around[f, m - w][0], top) if (f, m - w) in around else 0
        cost += step(right, left1) if m1 % w else 0
        want[f, c] = cost + (step(around[f, m1 - w][0], top1) if (f, m1 - w) in around else 0)
    got = {(x.file_id, x.cand_id): x.edge_cost for x in ms.seam_cost(blocks, beside, "wide").collect()}
    assert got == want and (2, 3) not in got


def test_rank_keeps_the_best_and_lets_edges_decide(spark):
    """Of 300 candidates a file 128 are looked up again; with equal steps the smaller seam comes first."""
    r = random.Random(7)
    rows = [(f, c, (c - 3) * 8, r.choice((2, 30, 48)), r.random() < 0.1, r.choice((0.0, 1.5)), r.randrange(900) / 8, 0) for f in (1, 2) for c in range(300)]
    schema = "file_id int, cand_id int, delta_bits int, clean int, reached_end boolean, dc_step double, edge_cost double, excess_bits int"
    metrics = spark.createDataFrame(rows, schema)
    got = ms.rank_resync(metrics, metrics).collect()
    for f in (1, 2):
        passed = [x for x in rows if x[0] == f and (x[3] >= 4 or x[2] == 0)]
        score = lambda x: int((4 * x[5] + x[6]) * 10)
        short = sorted(passed, key=lambda x: (not (x[4] or x[3] >= 43), score(x), x[1]))[:128]
        final = sorted(enumerate(short), key=lambda e: (not (e[1][4] or e[1][3] >= 360), 0 if e[1][4] else -e[1][3], score(e[1]), abs(e[1][2]), e[0]))
        assert [(x.cand_id, x.score) for x in sorted((x for x in got if x.file_id == f), key=lambda x: x.rank)] == [(x[1], score(x)) for _, x in final]
        assert len(passed) > 128


def test_ranking_reads_whole_pictures(spark, tmp_path):
    """A picture of several blocks: each fourth MCU is a candidate, and a trial goes on up to the window; equal to the SQL."""
    import duckdb
    from compare import TABLES, compare
    from conftest import SF

    from __spark_entry__ import _queries

    for t in ("lineitem", "embeddings"):
        table = spark.read.parquet(f"{SF}/{t}.parquet")
        if t == "lineitem":
            # One picture of more than 4,096 MCUs.
            table = table.withColumn("l_suppkey", F.expr("CASE WHEN l_suppkey <> 1 THEN 10L ELSE l_suppkey END"))
        table.write.parquet(f"{tmp_path}/{t}.parquet")
    own = duckdb.connect()
    for t in TABLES:
        at = f"{tmp_path}/{t}.parquet/*.parquet" if t in ("lineitem", "embeddings") else f"{SF}/{t}.parquet"
        own.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}')")
    query = _queries()["m6_rank_resync"]
    found = query.run(spark, str(tmp_path)).where("file_id = 10").agg(F.max("cand_id").alias("cand"), F.max("clean").alias("clean")).first()
    assert found.cand > 1024 and found.clean > 60
    rows, _, difference = compare(spark, own, query, str(tmp_path))
    assert rows > 128 and not difference


def test_folded_candidates_are_the_rows(spark):
    """Candidates that never become rows are those that do, at a start on a byte too, with and without a failure, and of all limits."""
    points = spark.createDataFrame([(1, 803, 950), (2, 160, None), (3, 17, 20)], "file_id long, start long, fail_end long")

    def fold(ids, deltas, at):
        # Nothing is summed: each candidate as text.
        return {"all": [" ".join(f"{i},{d},{p[0]}" for i, d in zip(line, deltas, strict=True)) for line, p in zip(ids, at, strict=True)]}

    for limits in ({"max_bits": 3, "max_bytes": 5}, {"max_bits": 20, "max_bytes": 2, "max_reach_bits": 64}, {"max_bits": 2, "max_bytes": 3, "max_positions": 4}, {"max_bits": 1, "max_bytes": 40, "max_reach_bits": None, "max_positions": None}):
        rows = ms.resync_candidates(points, **limits).collect()
        want = sorted((r.file_id, r.cand_id, r.delta_bits, r.bit_pos) for r in rows)
        got = ms.folded_candidates(points, fold, "all string", **limits).collect()
        assert sorted((r.file_id, *map(int, c.split(","))) for r in got for c in r["all"].split()) == want
        assert all(f",{r.bit_pos}" in r["all"] for r in got)


def test_counting_candidates_makes_no_row_of_them(spark):
    """They are laid out in the task that tries them; only what is known of a place leaves it."""
    import contextlib
    import io

    from conftest import SF

    from __spark_entry__ import queries

    with contextlib.redirect_stdout(io.StringIO()) as plan:
        queries()["m3_resync_candidates"](spark, SF).explain()
    assert "16384" not in plan.getvalue() and "cand_id" not in plan.getvalue()
