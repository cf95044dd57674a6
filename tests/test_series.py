"""Golden values of bars, labels, ratios and studies, and window forms against plain loops."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marketweave.functions import numeric, timegrid
from marketweave.operators import bars as B
from marketweave.operators import depth as D
from marketweave.operators import research as R

START = dt.datetime(2026, 8, 20)
MINUTE = dt.timedelta(minutes=1)


def minutes(spark, rows, schema):
    return spark.createDataFrame([("ETHUSDT", START + MINUTE * r[0], *r[1:]) for r in rows], f"symbol string, ts timestamp_ntz, {schema}")


def by_minute(df, column):
    return {(r["ts"] - START) // MINUTE: r[column] for r in df.collect()}


def test_future_return_needs_all_minutes_closed(spark):
    whole = [(i, 100.0 + i, True) for i in range(8)]
    label = by_minute(B.future_return(minutes(spark, whole, "close double, closed boolean"), "1 MINUTE"), "future_return")
    assert label[0] == pytest.approx(0.05) and [label[i] is None for i in range(8)] == [False] * 3 + [True] * 5
    gap = [r for r in whole if r[0] != 3]
    assert by_minute(B.future_return(minutes(spark, gap, "close double, closed boolean"), "1 MINUTE"), "future_return")[0] is None
    open_ = [(i, c, i != 3) for i, c, _ in whole]
    assert by_minute(B.future_return(minutes(spark, open_, "close double, closed boolean"), "1 MINUTE"), "future_return")[0] is None


def _ratio(spark, rows):
    df = minutes(spark, rows, "volume double, closed boolean")
    return by_minute(B.prior_median_ratio(df, "volume", F.col("closed") & (F.col("volume") >= 0), "1 MINUTE", "r"), "r")


def test_prior_median_ratio_golden(spark):
    rows = [(i, float(i + 1), True) for i in range(61)]
    got = _ratio(spark, rows)
    assert got[59] is None and got[60] == 2.0
    assert _ratio(spark, [(i + (i == 60), v, c) for i, v, c in rows])[61] is None
    assert _ratio(spark, [(i, v, i != 30) for i, v, c in rows])[60] is None
    assert _ratio(spark, [(i, 0.0, True) for i in range(60)] + [(60, 5.0, True)])[60] is None


def test_prior_median_ratio_equals_a_loop(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([0.0, 1.0, 2.5, 7.0]), rng.random() > 0.003) for i in range(1500) if rng.random() > 0.004]
    want, prior, last = {}, [], None
    for i, v, ok in rows:
        if last is not None and i != last + 1:
            prior = []
        ordered = sorted(prior)
        median = (ordered[29] + ordered[30]) / 2 if len(prior) == 60 else 0
        want[i] = v / median if ok and median > 0 else None
        prior = (prior + [v])[-60:] if ok else []
        last = i
    assert _ratio(spark, rows) == want and sum(x is not None for x in want.values()) > 300


def test_mismatch_and_depth(spark):
    row = spark.range(1).select(
        B.flow_price_mismatch(B.imbalance(F.lit(600.0), F.lit(400.0)), F.lit(100.0), F.lit(99.0)).alias("up"),
        B.flow_price_mismatch(B.imbalance(F.lit(400.0), F.lit(600.0)), F.lit(100.0), F.lit(101.0)).alias("down"),
        B.flow_price_mismatch(B.imbalance(F.lit(600.0), F.lit(400.0)), F.lit(100.0), F.lit(101.0)).alias("same"),
        R.depth_drop(F.lit(500.0), F.lit(500.0), F.lit(250.0), F.lit(250.0), F.lit(60), F.lit(1.0)).alias("drop"),
        R.depth_drop(F.lit(500.0), F.lit(500.0), F.lit(250.0), F.lit(250.0), F.lit(60), F.lit(0.799999)).alias("thin"),
        R.top5_imbalance(F.lit(0.3), F.lit(47), F.lit(60), F.lit(1.0)).alias("few"),
        R.top5_imbalance(F.lit(0.3), F.lit(48), F.lit(60), F.lit(1.0)).alias("enough"),
    ).first()
    assert row["up"] == pytest.approx(0.002) and row["down"] == pytest.approx(-0.002) and row["same"] is None
    assert row["drop"] == 0.5 and row["thin"] is None and row["few"] is None and row["enough"] == 0.3


def test_study_splits_and_purges(spark):
    obs = spark.createDataFrame([("S", "m", START + MINUTE * i, float(i), 0.01) for i in range(100)], "symbol string, metric string, ts timestamp_ntz, x double, y double")
    parts = {r["part"]: r["n"] for r in R.split(obs, "5 MINUTE").groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert parts == {"discovery": 65, None: 5, "validation": 30}
    study = R.decile_study(obs, "5 MINUTE").collect()
    assert len(study) == 20
    assert {r["bucket"]: r["count"] for r in study if r["part"] == "validation" and r["count"]} == {10: 30}


def test_study_equals_a_loop(spark):
    rng = random.Random(6)
    data = [(i, rng.choice([1.0, 2.0, 3.0, rng.random() * 5]), rng.uniform(-1, 1)) for i in range(900)]
    obs = spark.createDataFrame([("S", "m", START + MINUTE * i, x, y) for i, x, y in data], "symbol string, metric string, ts timestamp_ntz, x double, y double")
    turn = int(900 * 0.7)
    early, late = [d for d in data[:turn] if d[0] + 5 < data[turn][0]], data[turn:]
    ordered = sorted(x for _, x, _ in early)
    cuts = [ordered[-(-len(ordered) * k // 10) - 1] for k in range(1, 10)]
    for r in R.decile_study(obs, "5 MINUTE").collect():
        rows = [y for _, x, y in (early if r["part"] == "discovery" else late) if sum(x >= c for c in cuts) + 1 == r["bucket"]]
        assert r["count"] == len(rows)
        assert (r["mean_return"] is None) == (not rows)
        assert not rows or (r["mean_return"] == pytest.approx(sum(rows) / len(rows)) and r["up_share"] == pytest.approx(sum(y > 0 for y in rows) / len(rows)))


def test_depth_levels(spark):
    df = spark.createDataFrame([([[str(100 - i), "1"] for i in range(20)], [[str(101 + i), "1"] for i in range(20)], [["1", "-1"]])], "b array<array<string>>, a array<array<string>>, bad array<array<string>>")
    books = df.select(D.levels(F.col("b"), True).alias("bids"), D.levels(F.col("a"), False).alias("asks"), D.levels(F.col("bad"), True).alias("bad"))
    r = D.features(books).first()
    assert (r["bid_depth_5"], r["ask_depth_5"], r["bid_depth_10"], r["ask_depth_10"], r["bid_depth_20"], r["ask_depth_20"]) == (490, 515, 955, 1055, 1810, 2210)
    assert (r["mid"], r["spread"], r["bad"]) == (100.5, 1, None)


def test_book_minutes_drop_repeats(spark):
    rows = [("E", START + dt.timedelta(seconds=s), k, b, a, sp, im) for k, (s, b, a, sp, im) in enumerate([(1, 100.0, 200.0, 1.0, 0.6), (2, 300.0, 400.0, 3.0, -0.2), (2, 9.0, 9.0, 9.0, 0.9), (1, 9.0, 9.0, 9.0, 0.9)])]
    r = D.minutes(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, arrival long, bid double, ask double, spread_bps double, imbalance double")).first()
    assert (r["bid_open"], r["bid_close"], r["bid_mean"], r["ask_mean"], r["spread_mean"], r["spread_p95"], r["samples"]) == (100, 300, 200, 300, 2, 3, 2)
    assert r["imbalance_mean"] == pytest.approx(0.2) and r["coverage"] == pytest.approx(2 / 60)


def test_numbers(spark):
    df = spark.createDataFrame([("(2.5)",), ("-",), ("",), ("0.0",), ("$1,000.5",), ("x",)], "raw string")
    assert [r["v"] for r in df.select(numeric.flow_value(F.col("raw")).alias("v")).collect()] == [-2.5e6, None, None, 0.0, 1000.5e6, None]
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert flat.agg(numeric.correlation("a", "b").alias("c")).first()["c"] is None
    for n in (1, 7, 20, 129):
        got = spark.range(1, n + 1).agg(numeric.nearest_rank("id", 0.95).alias("p")).first()["p"]
        assert got == -(-95 * n // 100)
    exact = spark.createDataFrame([(Decimal(1), Decimal(3)), (Decimal(2), Decimal(3)), (Decimal(1), Decimal(0))], "a decimal(38,18), b decimal(38,18)")
    assert [r["q"] for r in exact.select(numeric.exact_ratio("a", "b").alias("q")).collect()] == [Decimal("0.333333333333333333"), Decimal("0.666666666666666667"), None]


def test_times(spark):
    df = spark.createDataFrame([("1785495600",), ("1785495600000",), ("Fri, 31 Jul 2026 11:00:00 GMT",), ("2026-07-31T11:00:00Z",), ("2026-07-31 19:00:00+08:00",), ("nonsense",)], "t string")
    got = [r["w"] for r in df.select(timegrid.parse_when(F.col("t")).cast("timestamp_ntz").alias("w")).collect()]
    assert got == [dt.datetime(2026, 7, 31, 11)] * 5 + [None]
    day = spark.sql("SELECT TIMESTAMP'2026-01-01 17:00:00' AS t").select(timegrid.local_date(F.col("t")).alias("d")).first()["d"]
    assert day == dt.date(2026, 1, 2)


def test_gaps(spark):
    rows = [(i, 1.0) for i in (0, 1, 4, 5, 9)]
    df = minutes(spark, rows, "close double")
    got = sorted(((r["start"] - START) // MINUTE, (r["stop"] - START) // MINUTE, r["count"]) for r in B.ranges(B.missing(df, "1 MINUTE"), "1 MINUTE").collect())
    assert got == [(2, 4, 2), (6, 9, 3)]
    assert B.dense(df, "1 MINUTE", limit=4).count() == 4
