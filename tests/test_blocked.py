"""Blocked windows against plain ones, with blocks far smaller than a key."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from mendframe.functions.blocked import at_offset, blocked_row_number, carried, with_halo
from mendframe.functions.stats import upper_median


def rows(spark):
    # Key 0 holds most rows; every seventh position is missing.
    return spark.range(500).where("id % 7 <> 3").selectExpr(
        "CASE WHEN id % 10 = 0 THEN 1L ELSE 0L END AS k", "id AS p", "(id * 37) % 101 AS v"
    )


def test_carried_equals_one_window(spark):
    df = rows(spark).withColumn("v", F.expr("CASE WHEN v % 4 > 0 THEN v END"))
    up = Window.partitionBy("k").orderBy("p")
    for how, agg in (("max", F.max), ("min", F.min), ("sum", F.sum)):
        for back in (False, True):
            for incl in (False, True):
                w = (Window.partitionBy("k").orderBy(F.col("p").desc()) if back else up).rowsBetween(
                    Window.unboundedPreceding, 0 if incl else -1
                )
                want = df.select("k", "p", agg("v").over(w).alias("r"))
                got = carried(df, ["k"], ["p"], F.expr("p div 16"), F.col("v"), how, "r", back, incl).select("k", "p", "r")
                if how == "sum":
                    want = want.fillna(0, ["r"])
                assert sorted(map(str, want.collect())) == sorted(map(str, got.collect())), (how, back, incl)


def test_row_number_and_halo(spark):
    df = rows(spark)
    w = Window.partitionBy("k").orderBy("p")
    want = df.select("k", "p", (F.row_number().over(w) - 1).alias("n"))
    got = blocked_row_number(df, ["k"], ["p"], F.expr("p div 16"), "n").select("k", "p", "n")
    assert sorted(map(tuple, want.collect())) == sorted(map(tuple, got.collect()))
    near = with_halo(df, ["k"], "p", before=20, after=3, block=8)
    out = near.select("k", "p", "_own", at_offset("v", ["k"], "p", -20).alias("back"), at_offset("v", ["k"], "p", 3).alias("ahead"))
    vals = {(r.k, r.p): r.v for r in df.collect()}
    seen = out.where("_own").collect()
    assert len(seen) == len(vals)
    for r in seen:
        assert r.back == vals.get((r.k, r.p - 20)) and r.ahead == vals.get((r.k, r.p + 3))


def test_upper_median(spark):
    got = {r.k: (r.n, r.median) for r in upper_median(rows(spark), ["k"], "v").collect()}
    for k in (0, 1):
        vals = sorted(r.v for r in rows(spark).where(f"k = {k}").collect())
        assert got[k] == (len(vals), vals[len(vals) // 2])
