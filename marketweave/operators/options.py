"""Option chains: totals, open interest, implied volatility, skew."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketweave.functions.numeric import ratio
from marketweave.operators.joins import latest


def totals(chain: DataFrame, keys: list[str]) -> DataFrame:
    """Total, call and put open interest and put/call ratio of (keys, side, oi)."""
    side = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("oi"))), F.lit(0.0))
    out = chain.groupBy(*keys).agg(F.coalesce(F.sum("oi"), F.lit(0.0)).alias("total_oi"), side("call").alias("call_oi"), side("put").alias("put_oi"))
    return out.withColumn("put_call", ratio(F.col("put_oi"), F.col("call_oi")))


def by_strike(chain: DataFrame, keys: list[str]) -> DataFrame:
    """Call and put open interest per strike, without strikes that have none."""
    return totals(chain, [*keys, "strike"]).where("call_oi <> 0 OR put_oi <> 0").select(*keys, "strike", "call_oi", "put_oi", (F.col("call_oi") + F.col("put_oi")).alias("oi"))


def peak(strikes: DataFrame, keys: list[str]) -> DataFrame:
    """The strike of most open interest, the lowest of equals."""
    return latest(strikes, keys, [F.col("oi").desc(), F.col("strike")])


def interpolate(points: DataFrame, at: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x, y): linear interpolation of mean iv over strikes at x, flat outside.

    points: (keys, strike, iv); at: (keys, x).
    """
    mean = points.where("iv IS NOT NULL").groupBy(*keys, "strike").agg(F.avg("iv").alias("iv"))
    near = mean.join(at, keys)
    point = F.struct("strike", "iv")
    below = F.max_by(point, F.when(F.col("strike") < F.col("x"), F.col("strike")))
    above = F.min_by(point, F.when(F.col("strike") >= F.col("x"), F.col("strike")))
    both = near.groupBy(*keys, "x").agg(below.alias("b"), above.alias("a"))
    line = F.col("b.iv") + (F.col("a.iv") - F.col("b.iv")) * (F.col("x") - F.col("b.strike")) / (F.col("a.strike") - F.col("b.strike"))
    return both.select(*keys, "x", F.when(F.col("b").isNull(), F.col("a.iv")).when(F.col("a").isNull(), F.col("b.iv")).otherwise(line).alias("y"))


def nearest(expiries: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """For each target day the expiry at least distance, the earlier of equals. Few rows on both sides."""
    near = expiries.join(targets, keys).withColumn("distance", F.abs(F.datediff("expiry", "target")))
    return latest(near, [*keys, "target"], [F.col("distance"), F.col("expiry")])


def skew(points: DataFrame, spot: DataFrame, keys: list[str], low: float = 70.0, high: float = 130.0, most: int = 20) -> DataFrame:
    """(keys, moneyness, iv): mean iv per strike within the band, thinned evenly to `most` points."""
    near = points.where("iv IS NOT NULL").groupBy(*keys, "strike").agg(F.avg("iv").alias("iv")).join(spot, keys)
    near = near.withColumn("moneyness", F.try_divide("strike", "x") * 100).where(F.col("moneyness").between(low, high))
    w = Window.partitionBy(*keys)
    ranked = near.withColumns({"i": F.row_number().over(w.orderBy("strike")) - 1, "n": F.count("*").over(w)})
    # the points of even steps from the first to the last
    step = (F.col("n") - 1) / F.lit(float(most - 1))
    kept = (F.col("n") <= most) | F.exists(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.floor(k * step + F.lit(0.5)) == F.col("i"))
    return ranked.where(kept).select(*keys, "moneyness", "iv")
