"""Structures that keep one long gap, stretch or interval from ending up in one task."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kilohour.functions.intervals import cover, holders, meet
from kilohour.operators import reads, windows
from kilohour.operators import rules as rule_module
from kilohour.operators.rules import Rules
from kilohour.operators.runs import Fall, composed, summarise
from kilohour.series import SeriesSpec

FALL = Fall(100.0, 100.0, 0.3)


def fold(values):
    """Runs (start, last, rows, first, anchor) of a stretch, row by row; the first row is only the first one's prior."""
    runs, run, prior = [], None, values[0]
    for t, v in enumerate(values[1:], 1):
        if run and FALL.low(run[4], v):
            run = (run[0], t, run[2] + 1, *run[3:])
        else:
            if run:
                runs.append(run)
            starts = prior is not None and prior >= FALL.expected and FALL.low(prior, v)
            run = (t, t, 1, v, prior) if starts else None
        prior = v
    return runs + ([run] if run else []), run


def series(pick, n):
    level, out = 500.0, []
    for _ in range(n):
        level = pick.choice([level, level * 0.5, level + 40, 500.0, 900.0, 130.0])
        out.append(None if pick.random() < 0.02 else round(min(level, 2000.0), 3))
    return out


def test_part_summaries_compose_to_the_fold():
    pick = random.Random(7)
    for _ in range(300):
        values = series(pick, pick.randint(2, 60))
        cuts = sorted({1, len(values), *(pick.randint(1, len(values)) for _ in range(6))})
        parts = [summarise(list(range(a, b)), values[a:b], values[a - 1], FALL) for a, b in zip(cuts, cuts[1:])]
        _, run = fold(values)
        want = None if run is None else (run[0], run[3], run[4], run[2])
        left = parts[0]
        for part in parts[1:]:
            left = composed(left, part, FALL)
        right = parts[-1]
        for part in reversed(parts[:-1]):
            right = composed(part, right, FALL)
        assert left == right and left.none == want
        for anchor in (120.0, 300.0, 777.0, 1e6):
            entry, step = (-5, 1.0, anchor, 3), (-5, 1.0, anchor, 3)
            for part in parts:
                step = part.after(step, FALL)
            assert left.after(entry, FALL) == step


def solar_runs(spark, frame, chunk_rows):
    rules = Rules("solar_generation_mw", F.lit("2040-01-01").cast("timestamp"), chunk_rows=chunk_rows)
    out = rules.solar_collapses(rules.unique_rows(frame)).select("region", "timestamp_utc", "expected_value", "observed_value", F.get_json_object("metadata_json", "$.duration_hours").cast("int").alias("n"))
    return sorted((r["region"], int((r["timestamp_utc"] - pd.Timestamp("2024-01-01")).total_seconds() // 3600), r["expected_value"], r["observed_value"], r["n"]) for r in out.collect())


@pytest.mark.parametrize("levels", [1, 3])
def test_a_long_daylight_stretch_is_folded_in_parts(spark, monkeypatch, levels):
    """100,000 daylight rows in chunks of 100: the same runs as one fold, on one level of summaries and on three."""
    pick, n = random.Random(11), 100_000
    values = series(pick, n)
    for start in (9_950, 40_000, 70_000):  # runs across many chunks
        values[start] = 1500.0
        values[start + 1 : start + 5000] = [pick.uniform(0, 900) for _ in range(4999)]
    monkeypatch.setattr(rule_module, "levels_for", lambda *a: levels)
    monkeypatch.setattr(rule_module, "PARTS", 10)
    rows = pd.DataFrame({"region": "A", "t": range(n), "solar_generation_mw": pd.array(values, "Float64")})
    frame = spark.createDataFrame(rows).select(
        "region", F.timestamp_seconds(F.col("t") * 3600 + int(pd.Timestamp("2024-01-01").timestamp())).alias("timestamp_utc"),
        F.col("solar_generation_mw"), F.lit(500.0).alias("shortwave_radiation_wm2"),
    )
    want = sorted(("A", r[0], r[4], r[3], r[2]) for r in fold(values)[0] if r[2] >= 2)
    assert max(w[4] for w in want) > 4000
    assert solar_runs(spark, frame, 100) == want


def hours_of_a(spark, hours):
    start = int(pd.Timestamp("1900-01-01").timestamp())
    rows = spark.createDataFrame([("A", h, 100.0) for h in hours], "region string, h long, demand_mw double")
    return rows.select("region", F.timestamp_seconds(F.col("h") * 3600 + start).alias("timestamp_utc"), "demand_mw")


def missing(spark, hours):
    rules = Rules("demand_mw", F.lit("2040-01-01").cast("timestamp"))
    events = rules.row_rules(rules.linked_rows(rules.unique_rows(hours_of_a(spark, hours))))
    start = int(pd.Timestamp("1900-01-01").timestamp())
    return events.where("anomaly_type = 'missing_timestamp'").withColumn("h", ((F.unix_seconds("timestamp_utc") - start) / 3600).cast("long"))


def test_a_gap_of_a_million_hours_is_many_rows(spark):
    got = missing(spark, [0, 1, 2, 1_000_003, 1_000_004, 1_000_010]).groupBy("severity").agg(F.count("*"), F.count_distinct("h"), F.min("h"), F.max("h")).collect()
    assert [tuple(r) for r in got] == [("critical", 1_000_005, 1_000_005, 3, 1_000_009)]


@pytest.mark.parametrize("last", [5, 6, 7, 11, 12, 13, 20, 30, 31])
def test_blocks_of_a_gap_lose_and_repeat_nothing(spark, monkeypatch, last):
    monkeypatch.setattr(rule_module, "BLOCK", 3)
    assert sorted(r["h"] for r in missing(spark, [0, 1, 2, last]).collect()) == list(range(3, last))


def test_covers_are_disjoint_and_short(spark):
    pick = random.Random(5)
    spans = [(a, a + pick.choice([0, 1, 2, 3, 7, 8, 100, 5000])) for a in [*range(-9, 9), *(pick.randint(-10_000, 10_000) for _ in range(60))]] + [(5, 4), (-(2**30), 2**33)]
    df = spark.createDataFrame(spans, "low long, high long").withColumn("c", cover(F.col("low"), F.col("high")))
    for r in df.collect():
        pieces = [(p["range"] << p["level"], (p["range"] + 1 << p["level"]) - 1) for p in r["c"]]
        pieces.sort()
        assert len(pieces) <= 2 * 34
        if r["low"] <= r["high"]:
            assert pieces[0][0] == r["low"] and pieces[-1][1] == r["high"]
            assert all(b[0] == a[1] + 1 for a, b in zip(pieces, pieces[1:]))
        else:
            assert not pieces
    tops = spark.range(1).select(cover(F.lit(0).cast("long"), F.lit(1000).cast("long"), 4).alias("c"), holders(F.lit(-3).cast("long"), 4).alias("h")).first()
    assert len(tops["c"]) > 60 and [h["range"] for h in tops["h"]] == [-3, -2, -1, -1, -1]


def test_points_meet_the_intervals_that_hold_them(spark):
    pick = random.Random(6)
    points = [(i, pick.randint(-500, 500)) for i in range(200)] + [(900, None)]
    spans = [(i, a, a + pick.choice([0, 3, 40, 600])) for i, a in enumerate(pick.randint(-600, 500) for _ in range(50))] + [(800, None, 4), (801, 9, 3)]
    p = spark.createDataFrame(points, "p long, x long")
    s = spark.createDataFrame(spans, "s long, a long, b long")
    got = [(r["p"], r["s"]) for r in meet(p, s, point=F.col("x"), low=F.col("a"), high=F.col("b"), salt=["s"]).collect()]
    want = [(i, j) for i, x in points for j, a, b in spans if None not in (x, a, b) and a <= x <= b]
    assert sorted(got) == sorted(want)
    assert meet(p, s, point=F.col("x"), low=F.col("a"), high=F.col("b")).columns == ["p", "x", "s", "a", "b"]


def test_audit_names_a_gap_of_ten_years(spark):
    spec = SeriesSpec(chunk_rows=500)
    start = int(pd.Timestamp("2010-01-01").timestamp())
    hours = [*range(0, 60), *range(60 + 87_600, 60 + 87_600 + 30)]
    frame = spark.createDataFrame([("A", h) for h in hours], "region string, h long").select("region", F.timestamp_seconds(F.col("h") * 3600 + start).alias("timestamp_utc"))
    audit = windows.window_audit(frame, horizon=6, windows=2, step_size=6, required_history=20, spec=spec)
    rows = audit.select(((F.unix_seconds("origin") - start) / 3600).cast("int").alias("h"), "accepted", "reason").collect()
    accepted = sorted(r["h"] for r in rows if r["accepted"])
    assert accepted == [53, 87_660 + 23]
    inside = [r for r in rows if 100 < r["h"] < 87_000]
    assert len(inside) >= 2 * 86_000 and {r["reason"] for r in inside} == {"A:insufficient_contiguous_history:20_missing_hours", "A:incomplete_forecast_horizon:6_missing_hours"}


def test_deep_pages_read_two_ranges_at_most(spark):
    pick = random.Random(9)
    rows = [(i, pick.choice([None, 1.0, 1.0, 2.5, float(pick.randint(0, 40))])) for i in range(997)]
    df = spark.createDataFrame(rows, "id long, v double").repartition(5)
    order = [F.desc_nulls_last("v"), "id"]
    listing = reads.page_directory(df, order, rows_per_part=100)
    assert listing.total == 997 and sum(n > 0 for n in listing.counts) >= 8
    want = [r["id"] for r in df.orderBy(*order).collect()]
    for limit, offset in ((10, 0), (30, 400), (7, 990), (20, 995), (5, 997), (5, 2000), (0, 3), (997, 0)):
        page = listing.page(spark, limit=limit, offset=offset)
        assert [r["id"] for r in page.collect()] == want[offset : offset + limit], (limit, offset)
    last = listing.page(spark, limit=20, offset=970)
    assert len(listing.touched(20, 970)[0]) <= 2
    assert len({f.rsplit("_part=", 1)[1].split("/")[0] for f in last.inputFiles()}) <= len(listing.counts)
    assert "PartitionFilters: [" in last._jdf.queryExecution().toString() and tuple(listing.info(spark, limit=20, offset=990).first()) == (20, 990, 997, 7, False)
    empty = reads.page_directory(df.limit(0), order)
    assert empty.total == 0 and empty.page(spark, limit=5).count() == 0
    with pytest.raises(ValueError):
        reads.page_directory(df.withColumn("_part", F.lit(1)), order)
    with pytest.raises(ValueError):
        listing.page(spark, limit=-1)


def test_a_listing_of_many_ranges_is_written_by_few_tasks(spark, monkeypatch):
    """300 ranges in five files: tasks, files and what the driver gets follow the files; each page reads its rows only."""
    monkeypatch.setattr(reads, "FILE_ROWS", 600)
    df = spark.range(3_000).select(((F.col("id") * 7919) % 3_000).alias("id"), (F.col("id") % 7).alias("v")).repartition(3)
    order = [F.desc("v"), "id"]
    listing = reads.page_directory(df, order, rows_per_part=10)
    assert len(listing.counts) >= 300 and max(listing.counts) <= 10 and sum(listing.counts) == 3_000
    assert len(spark.read.parquet(listing.path).inputFiles()) <= 5
    want = [r["id"] for r in df.orderBy(*order).collect()]
    for limit, offset in ((10, 0), (7, 1_234), (25, 595), (3, 2_998), (3_000, 0)):
        page = listing.page(spark, limit=limit, offset=offset)
        assert [r["id"] for r in page.collect()] == want[offset : offset + limit], (limit, offset)
    assert "PushedFilters: [IsNotNull(_at), GreaterThanOrEqual(_at" in listing.page(spark, limit=5, offset=777)._jdf.queryExecution().toString()
    found, start = {}, 0
    for part, n in enumerate(listing.counts):
        found |= dict.fromkeys(range(start, start + n), part)
        start += n
    for limit, offset in ((1, 0), (9, 4), (40, 1_111), (9, 2_995), (5, 3_000)):
        parts, skip = listing.touched(limit, offset)
        assert parts == sorted({found[i] for i in range(offset, offset + limit) if i in found})
        assert skip == (offset - sum(listing.counts[: parts[0]]) if parts else 0)
