"""Joins, funds, options, upserts and audits on small rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marketweave.operators import funds as U
from marketweave.operators import joins as J
from marketweave.operators import merge as M
from marketweave.operators import options as O
from marketweave.operators import quality as Q

DAY = dt.date(2026, 8, 1)


def days(n):
    return DAY + dt.timedelta(days=n)


def test_asof_equals_a_loop(spark):
    rng = random.Random(2)
    left = [(i, rng.choice("ab"), rng.randrange(100)) for i in range(200)]
    right = [(rng.choice("abc"), t, float(t)) for t in rng.sample(range(100), 30)]
    got = J.asof(spark.createDataFrame(left, "id long, k string, t long"), spark.createDataFrame(right, "k string, u long, v double"), ["k"], "t", "u", ["v"])
    for r in got.collect():
        known = [v for k, u, v in right if k == r["k"] and u <= r["t"]]
        assert r["v"] == (max(known) if known else None)
    assert got.count() == 200


def test_interval_and_band_pairs(spark):
    at = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    points = spark.createDataFrame([("a", at(s)) for s in (0, 1, 299, 300, 301, 900)], "k string, ts timestamp_ntz")
    spans = spark.createDataFrame([("a", at(0), at(300), 1), ("a", at(290), at(301), 2), ("b", at(0), at(300), 3)], "k string, start timestamp_ntz, stop timestamp_ntz, id int")
    got = sorted(((r["ts"] - at(0)).seconds, r["id"]) for r in J.interval(points, spans, "k", "ts", "start", "stop", 300).collect())
    assert got == [(1, 1), (299, 1), (299, 2), (300, 1), (300, 2), (301, 2)]
    rows = [("a", days(d), i) for i, d in enumerate((0, 3, 14, 15, 40, 40))]
    pairs = {(r["left"], r["right"]) for r in J.band_pairs(spark.createDataFrame(rows, "k string, day date, id long"), "k", "day", "id", 14).collect()}
    assert pairs == {(a, b) for _, d, a in rows for _, e, b in rows if 0 <= (e - d).days <= 14 and (e > d or (e == d and a < b))}


def test_pages(spark):
    df = spark.createDataFrame([(i, i // 2) for i in range(10)], "id long, ts long")
    page = J.before(df, F.lit(4), 5).collect()
    assert [(r["ts"], r["id"], r["has_more"]) for r in page] == [(1, 3, True), (2, 4, True), (2, 5, True), (3, 6, True), (3, 7, True)]
    assert not J.before(df, F.lit(1), 5).first()["has_more"]


def test_changes_and_sums(spark):
    rows = [("k", days(d), v) for d, v in ((-30, 70.0), (-7, 90.0), (-1, 99.0), (0, 100.0))]
    last = U.changes(spark.createDataFrame(rows, "key string, day date, value double")).where(F.col("day") == DAY).first()
    assert (last["change_30"], last["change_7"], last["change_1"]) == (30, 10, 1)
    rows = [("k", days(d), float(d)) for d in range(1, 6)] + [("n", days(0), None)]
    got = {(r["key"], r["day"]): r["sum_5"] for r in U.cumulative(spark.createDataFrame(rows, "key string, day date, value double")).collect()}
    assert got["k", days(5)] == 15 and got["n", days(0)] is None


def test_rank_changes(spark):
    rows = [("x", days(0), 100.0, 2), ("x", days(1), 125.0, 1), ("y", days(1), 90.0, 2), ("z", days(0), 5.0, 3)]
    got = {r["name"]: r for r in U.rank_changes(spark.createDataFrame(rows, "name string, day date, value double, rank int"), "day", large=20).collect()}
    assert (got["x"]["change"], got["x"]["rank_change"], got["x"]["large_change"], got["x"]["newly_entered"]) == (25, 1, True, False)
    assert got["y"]["newly_entered"] and "z" not in got


def test_options(spark):
    rows = [(e, s, side, 110.0) for e in (days(30), days(60)) for s in (1900.0, 2100.0) for side in ("call", "put")]
    chain = spark.createDataFrame(rows, "expiry date, strike double, side string, oi double")
    assert O.totals(chain.withColumn("all", F.lit(1)), ["all"]).first()["total_oi"] == 880
    points = spark.createDataFrame([(1, 1900.0, 50.0), (1, 2100.0, 62.0), (1, 2100.0, None)], "k int, strike double, iv double")
    at = spark.createDataFrame([(1, 2000.0)], "k int, x double")
    assert O.interpolate(points, at, ["k"]).first()["y"] == 56.0
    for x, y in ((1.0, 50.0), (1900.0, 50.0), (9999.0, 62.0)):
        assert O.interpolate(points, spark.createDataFrame([(1, x)], "k int, x double"), ["k"]).first()["y"] == y
    peak = O.peak(spark.createDataFrame([(1, 10.0, 5.0), (1, 20.0, 9.0), (1, 30.0, 9.0)], "k int, strike double, oi double"), ["k"]).first()
    assert peak["strike"] == 20.0
    many = spark.createDataFrame([(1, 70 + i * 0.6, 1.0) for i in range(100)], "k int, strike double, iv double")
    thin = O.skew(many, spark.createDataFrame([(1, 100.0)], "k int, x double"), ["k"])
    assert thin.count() == 20 and thin.agg(F.min("moneyness")).first()[0] == pytest.approx(70)


def test_merge_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 2.0), (3, "c", 3.0)], "id long, name string, v double")
    new = spark.createDataFrame([(1, "a", None), (2, "b", 5.0), (4, "d", 4.0)], "id long, name string, v double")
    merged = M.merge(old, new, ["id"], ["name", "v"])
    assert {r["id"]: r["action"] for r in merged.collect()} == {1: "skipped", 2: "updated", 3: "kept", 4: "inserted"}
    assert M.counts(merged).first().asDict() == {"inserted": 1, "updated": 1, "skipped": 1}
    again = M.merge(merged.drop("action"), new, ["id"], ["name", "v"])
    assert M.counts(again).first().asDict() == {"inserted": 0, "updated": 0, "skipped": 3}
    twice = new.withColumn("n", F.lit(1)).unionByName(new.withColumns({"v": F.lit(9.0), "n": F.lit(2)}))
    last = M.merge(old, twice, ["id"], ["name", "v"], order="n")
    assert {r["id"]: r["v"] for r in last.collect()} == {1: 9.0, 2: 9.0, 3: 3.0, 4: 9.0}
    assert [r["id"] for r in M.unknown(new, old, "id").collect()] == [4]


def test_audit_counts_every_issue(spark):
    at = lambda m: dt.datetime(2026, 1, 1) + dt.timedelta(minutes=m)
    fine = (10.0, 12.0, 9.0, 11.0, 5.0, 1.0)
    rows = [("S", at(0), *fine), ("S", at(1), *fine), ("S", at(1), *fine), ("S", at(5), 10.0, 8.0, 9.0, 11.0, -1.0, 1.0)]
    schema = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, buy double"
    r = Q.audit(spark.createDataFrame(rows, schema), "1 MINUTE", 60).first()
    assert (r["expected"], r["actual"], r["missing"], r["duplicate"], r["invalid"], r["misaligned"], r["passed"]) == (6, 4, 3, 1, 1, 0, False)
    broken = spark.createDataFrame(rows[3:], schema).select(Q.broken(Q.ohlc_rules()).alias("b")).first()["b"]
    assert broken == ["high_below_low", "high_below_open", "high_below_close"]


def test_slots_order_and_caps(spark):
    at = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    df = spark.createDataFrame([(1, at(0)), (2, at(59)), (3, at(60)), (4, at(8 * 3600 + 5))], "id long, ts timestamp_ntz")
    got = {r["id"]: r["slot"] for r in Q.slots(df, "ts", "8 hours", "1 MINUTE").collect()}
    assert got == {1: at(0), 2: at(0), 3: None, 4: at(8 * 3600)}
    moved = df.withColumn("k", F.lit(1)).withColumn("ts", F.when(F.col("id") == 3, at(1)).otherwise(F.col("ts")))
    assert [r["id"] for r in Q.out_of_order(moved, ["k"], "id", "ts").collect()] == [3]
    issues = spark.createDataFrame([("b", at(i), i) for i in range(5)] + [("a", at(9), 9)], "category string, ts timestamp_ntz, id long")
    assert sorted(r["id"] for r in Q.capped(issues, ["a", "b"], 3).collect()) == [0, 1, 9]


def test_health(spark):
    now = F.lit("2026-01-10 00:00:00").cast("timestamp")
    rows = [(None, "passed"), ("2026-01-09 12:00:00", "passed"), ("2026-01-09 12:00:00", "warning"), ("2026-01-08 00:00:00", "passed"), ("2026-01-01 00:00:00", "passed"), ("2026-01-09 12:00:00", "failed")]
    df = spark.createDataFrame(rows, "run string, state string").withColumn("run", F.col("run").cast("timestamp"))
    assert [r["h"] for r in df.select(Q.health(F.col("run"), F.col("state"), F.col("run"), now).alias("h")).collect()] == ["never_run", "healthy", "degraded", "degraded", "broken", "broken"]


def test_proportional_and_trusted(spark):
    items = spark.createDataFrame([(i,) for i in range(4)], "id long")
    assert sorted(r["share"] for r in U.proportional(10, items, "id").collect()) == [2, 2, 3, 3]
    kids = spark.createDataFrame([("a", 1), ("a", None), ("b", 2), ("b", 5)], "k string, v int")
    assert {r["k"]: r["v"] for r in Q.trusted_start(kids, ["k"], "v").collect()} == {"a": None, "b": 2}
