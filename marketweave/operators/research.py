"""Decile studies of a metric against its forward return, and their verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketweave.functions.numeric import correlation
from marketweave.operators.ranks import nearest_ranks
from marketweave.session import cut

MIN_COVERAGE = 0.80


def depth_drop(bid_open: Column, ask_open: Column, bid_close: Column, ask_close: Column, samples: Column, coverage: Column) -> Column:
    """Share of depth lost in a bar of enough samples."""
    opened, closed = bid_open + ask_open, bid_close + ask_close
    return F.when((samples >= 2) & (coverage >= MIN_COVERAGE) & (opened > 0), (opened - closed) / opened)


def top5_imbalance(mean: Column, own_samples: Column, samples: Column, coverage: Column) -> Column:
    """Mean imbalance of the five best levels, where they were seen often enough and it is a share."""
    own = coverage * own_samples / samples
    return F.when((samples >= 2) & (own_samples >= 2) & (coverage >= MIN_COVERAGE) & (own >= MIN_COVERAGE) & mean.between(-1, 1), mean)


def observations(features: DataFrame, metrics: list[str], label: str) -> DataFrame:
    """(symbol, metric, ts, x, y), one row per metric and bar that has both values."""
    long = features.select("symbol", "ts", F.col(label).alias("y"), *metrics).unpivot(["symbol", "ts", "y"], metrics, "metric", "x")
    return long.where("x IS NOT NULL AND y IS NOT NULL").select("symbol", "metric", "ts", "x", "y")


def split(obs: DataFrame, purge: str, share: float = 0.7) -> DataFrame:
    """obs with part: the first share of each metric's rows is discovery, the rest validation.

    Discovery rows whose label reaches into validation are purged: they get no part. The turn is found by counts per
    day; only the rows of the day on which it falls are ranked. Rows of one metric at one time fall on one side.
    """
    keys = ["symbol", "metric"]
    days = obs.groupBy(*keys, F.to_date("ts").alias("day")).agg(F.count("*").alias("rows"))
    done = F.sum("rows").over(Window.partitionBy(*keys).orderBy("day"))
    whole = F.sum("rows").over(Window.partitionBy(*keys))
    days = days.withColumns({"done": done, "cut": F.floor(whole * F.lit(share))})
    turning = days.where((F.col("done") > F.col("cut")) & (F.col("done") - F.col("rows") <= F.col("cut"))).select(*keys, "day", (F.col("cut") - F.col("done") + F.col("rows")).alias("left"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("ts"))
    on_day = obs.withColumn("day", F.to_date("ts")).join(turning, [*keys, "day"]).withColumn("rank", rank)
    turn = on_day.where(F.col("rank") == F.col("left") + 1).select(*keys, F.col("ts").alias("turn"))
    part = F.when(F.col("ts") >= F.col("turn"), "validation").when(F.col("turn").isNull() | (F.col("ts") + F.expr(f"INTERVAL {purge}") < F.col("turn")), "discovery")
    return obs.join(turn, keys, "left").withColumn("part", part).drop("turn")


def decile_study(obs: DataFrame, purge: str) -> DataFrame:
    """(symbol, metric, bucket 1..10, part, count, mean_return, up_share): all 20 groups of each metric.

    Cut points are nearest ranks of discovery; a value on a cut point is in the bucket above it.
    """
    # observations are read several times from here on; behind them stand windows
    parts = cut(split(cut(obs), purge).where("part IS NOT NULL"))
    ranks = nearest_ranks(parts.where("part = 'discovery'"), ["symbol", "metric"], "x", [k / 10 for k in range(1, 10)])
    at = lambda k: F.max(F.when(F.round(F.col("share") * 10) == k, F.col("value"))).alias(f"c{k}")
    cuts = ranks.groupBy("symbol", "metric").agg(*[at(k) for k in range(1, 10)])
    bucket = sum(((F.col("x") >= F.col(f"c{k}")).cast("int") for k in range(2, 10)), (F.col("x") >= F.col("c1")).cast("int")) + 1
    placed = parts.join(cuts, ["symbol", "metric"]).withColumn("bucket", bucket)
    found = placed.groupBy("symbol", "metric", "bucket", "part").agg(F.count("*").alias("count"), F.avg("y").alias("mean_return"), F.avg(F.when(F.col("y") > 0, F.expr("1D")).otherwise(F.expr("0D"))).alias("up_share"))
    groups = cuts.select("symbol", "metric", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("bucket")).withColumn("part", F.explode(F.array(F.lit("discovery"), F.lit("validation"))))
    return groups.join(found, ["symbol", "metric", "bucket", "part"], "left").withColumn("count", F.coalesce("count", F.lit(0)))


def readiness(n: Column) -> Column:
    return F.when(n < 1_000, "collecting").when(n < 10_000, "preliminary").when(n < 30_000, "usable").otherwise("robust")


def verdict(study: DataFrame, spans: DataFrame) -> DataFrame:
    """A level per metric, from its groups and spans (symbol, metric, samples, days)."""
    pairs = study.groupBy("symbol", "metric", "bucket").agg(F.max(F.when(F.col("part") == "discovery", F.col("mean_return"))).alias("d"), F.max(F.when(F.col("part") == "validation", F.col("mean_return"))).alias("v"))
    pairs = pairs.withColumn("i", F.col("bucket").cast("double")).where("d IS NOT NULL AND v IS NOT NULL")
    shape = pairs.groupBy("symbol", "metric").agg(F.count("*").alias("pairs"), correlation("d", "v").alias("agreement"), correlation("i", "d").alias("trend_d"), correlation("i", "v").alias("trend_v"))
    both = spans.join(shape, ["symbol", "metric"], "left").withColumn("pairs", F.coalesce("pairs", F.lit(0)))
    trends = (F.col("trend_d") * F.col("trend_v") > 0) & (F.abs("trend_d") >= 0.45) & (F.abs("trend_v") >= 0.45)
    stable = F.coalesce((F.col("agreement") >= 0.60) & trends, F.lit(False))
    level = F.when((F.col("samples") < 1_000) | (F.col("pairs") < 8), "insufficient").when(stable & (F.col("samples") >= 10_000) & (F.col("days") >= 7), "candidate").when(stable, "watch").otherwise("rejected")
    return both.withColumns({"level": level, "readiness": readiness(F.col("samples"))})
