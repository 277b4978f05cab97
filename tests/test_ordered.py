"""Ordered building blocks against brute force, with chunks small enough to cross borders."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kilohour.functions.ordered import exact_quantiles, keep_last, levels_for, most_rows, side_by_side, walk, with_lookback


def _rows(seed, hot=0.5):
    pick = random.Random(seed)
    seen = {}
    for _ in range(300):
        key = "hot" if pick.random() < hot else pick.choice("abc")
        seen[(key, pick.randrange(0, 2000))] = float(pick.randrange(0, 4))
    return [(k, t, v) for (k, t), v in seen.items()]


@pytest.mark.parametrize("size", [7, 64, 5000])
def test_walk_matches_brute_force(spark, size):
    rows = _rows(size)
    df = spark.createDataFrame(rows, "k string, t int, v double")
    out = walk(
        df, keys=["k"], order=["t"], chunk=F.floor(F.col("t") / size), carry=["v"],
        breaks=lambda p, c: c("t") - p("t") > 5, row="n", first="head",
    ).collect()
    got = {(r["k"], r["t"]): (r["_prev"]["t"] if r["_prev"] else None, r["_island"], r["n"], r["head"]["t"]) for r in out}
    want = {}
    for key in {r[0] for r in rows}:
        times = sorted(t for k, t, _ in rows if k == key)
        island = 0
        for i, t in enumerate(times):
            prev = times[i - 1] if i else None
            island += prev is None or t - prev > 5
            want[(key, t)] = (prev, island, i + 1, times[0])
    assert got == want


@pytest.mark.parametrize("fan", [2, 3, 10])
def test_walk_over_three_levels(spark, fan, tmp_path):
    """The same numbers whether summaries meet in one task or in groups of at most ``fan``, three levels deep."""
    df = spark.createDataFrame(_rows(fan), "k string, t int, v double")
    args = dict(keys=["k"], order=["t"], chunk=F.floor(F.col("t") / 10), carry=["v"], breaks=lambda p, c: c("t") - p("t") > 5, row="n", first="head")
    want = {(r["k"], r["t"]): r for r in walk(df, levels=1, **args).collect()}
    got = {(r["k"], r["t"]): r for r in walk(df, levels=3, fan=fan, **args).collect()}
    assert got == want
    whole = dict(keys=[], order=["k", "t"], row="n", breaks=lambda p, c: p("k") != c("k"))
    chunked = df.withColumn("c", F.floor(F.col("t") / 10))
    flat = {(r["k"], r["t"]): (r["n"], r["_island"]) for r in walk(chunked, chunk=["k", "c"], levels=1, **whole).collect()}
    assert {(r["k"], r["t"]): (r["n"], r["_island"]) for r in walk(chunked, chunk=["k", "c"], levels=3, fan=fan, **whole).collect()} == flat
    assert sorted(n for n, _ in flat.values()) == list(range(1, len(flat) + 1))


def test_walk_bounds_what_a_task_sees(spark, tmp_path):
    """A window of the plan covers a chunk or at most ``fan`` summaries, and levels follow from the size of the table."""
    path = str(tmp_path / "t")
    spark.range(20_000).selectExpr("'hot' AS k", "id AS t").write.parquet(path)
    stored = spark.read.parquet(path)
    assert most_rows(stored) >= 10_000 and levels_for(most_rows(stored), 25, 25) >= 3 and levels_for(20, 25, 25) == 1
    out = walk(stored, keys=["k"], order=["t"], chunk=F.floor(F.col("t") / 10), row="n", fan=25)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_w_up" in plan and out.where("n <> t + 1").count() == 0 and out.count() == 20_000


def test_walk_reads_its_source_once(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame(_rows(1), "k string, t int, v double").write.parquet(path)
    out = walk(spark.read.parquet(path), keys=["k"], order=["t"], chunk=F.floor(F.col("t") / 50), breaks=lambda p, c: c("t") > p("t") + 3)
    small = out.select("k", "_island")
    small.collect()
    plan = small._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan


def test_lookback_copies_cover_the_frame(spark):
    df = spark.range(100).withColumnRenamed("id", "n")
    out = with_lookback(df, index=F.col("n"), chunk_rows=10, lookback=4).toPandas()
    assert sorted(out[out["_own"]]["n"]) == list(range(100))
    for chunk, part in out.groupby("_chunk"):
        own = part[part["_own"]]["n"]
        if chunk > 0 and len(own):
            assert set(range(own.min() - 4, own.min())) <= set(part["n"])


def test_keep_last_prefers_the_newest(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), ("b", 1, "w")], "k string, seq int, v string")
    assert sorted((r["k"], r["v"]) for r in keep_last(df, ["k"], ["seq"]).collect()) == [("a", "y"), ("b", "w")]


def test_quantiles_equal_numpy_under_ties_and_skew(spark):
    pick = random.Random(3)
    rows = [("hot", float(pick.randrange(0, 50))) for _ in range(700)] + [("b", pick.random()) for _ in range(31)]
    probabilities = {"min": 0.0, "p25": 0.25, "p995": 0.995, "max": 1.0}
    df = spark.createDataFrame(rows, "k string, v double")
    for r in exact_quantiles(df, keys=["k"], value="v", probabilities=probabilities).collect():
        data = [v for k, v in rows if k == r["k"]]
        assert [r[n] for n in probabilities] == pytest.approx([np.quantile(data, p) for p in probabilities.values()])
    whole = exact_quantiles(df, keys=[], value="v", probabilities=probabilities).first()
    assert whole["p995"] == pytest.approx(np.quantile([v for _, v in rows], 0.995))


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_quantiles_by_refinement(spark, rounds):
    """Hot keys, long ties, single rows, nulls and NaN, however often the borders are refined."""
    pick = random.Random(rounds)
    rows = [("hot", pick.choice([7.0, pick.gauss(0, 1)])) for _ in range(3000)] + [("one", 4.5)] + [("tie", 2.0)] * 50 + [("n", None), ("hot", float("nan"))]
    rows += [("few", float(i)) for i in range(5)]
    probabilities = {"min": 0.0, "p1": 0.01, "p50": 0.5, "p501": 0.501, "p999": 0.999, "max": 1.0}
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r for r in exact_quantiles(df, keys=["k"], value="v", probabilities=probabilities, splits=4, rounds=rounds).collect()}
    assert set(got) == {"hot", "one", "tie", "few"}
    for k, r in got.items():
        data = [v for key, v in rows if key == k and v == v]
        assert [r[n] for n in probabilities] == pytest.approx([np.quantile(data, p) for p in probabilities.values()])
    whole = exact_quantiles(df, keys=[], value="v", probabilities=probabilities, splits=4, rounds=rounds).first()
    assert whole["p501"] == pytest.approx(np.quantile([v for _, v in rows if v is not None and v == v], 0.501))
    assert exact_quantiles(df.limit(0), keys=["k"], value="v", probabilities=probabilities).count() == 0


def test_quantiles_of_many_distinct_values_rank_a_few_of_them(spark):
    """Ten million distinct values in one group; the one ranking window sees the rows of a few slots only."""
    n = 10_000_000
    df = spark.range(n).select(F.lit("hot").alias("k"), ((F.col("id") * 7919) % n).cast("double").alias("v"))
    out = exact_quantiles(df, keys=["k"], value="v", probabilities={"p50": 0.5, "p99": 0.99, "max": 1.0}, rounds=3).first()
    assert (out["p50"], out["p99"], out["max"]) == (pytest.approx((n - 1) / 2), pytest.approx(0.99 * (n - 1)), n - 1)


def test_side_by_side_has_one_row(spark):
    row = side_by_side(spark.range(1).selectExpr("1 a"), spark.range(1).selectExpr("'x' b")).collect()
    assert [tuple(r) for r in row] == [(1, "x")]
