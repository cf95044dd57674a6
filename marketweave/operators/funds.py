"""Fund flows, supplies and balances over dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketweave.operators.joins import asof


def changes(daily: DataFrame, lags: tuple[int, ...] = (1, 7, 30), keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """Each row's value against the latest one at or before so many days ago: change_1, change_7, ..."""
    out = daily
    for n in lags:
        right = daily.select(*keys, F.col("day").alias("__day"), F.col("value").alias(f"value_{n}"))
        out = asof(out.withColumn("__target", F.date_sub("day", n)), right, list(keys), "__target", "__day", [f"value_{n}"]).drop("__target")
        out = out.withColumn(f"change_{n}", F.col("value") - F.col(f"value_{n}")).drop(f"value_{n}")
    return out


def cumulative(daily: DataFrame, windows: tuple[int, ...] = (5, 20), keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """Sums of the last n rows of each key; nulls are skipped, all null gives null."""
    w = Window.partitionBy(*keys).orderBy("day")
    return daily.withColumns({f"sum_{n}": F.sum("value").over(w.rowsBetween(-(n - 1), 0)) for n in windows})


def rank_changes(balances: DataFrame, day: str, large: float = 10_000.0) -> DataFrame:
    """The latest snapshot of (name, day, value, rank) against the one before it and the one about a week before.

    Only the last eight snapshot days are read.
    """
    days = balances.select(day).distinct().orderBy(F.col(day).desc()).limit(8)
    numbered = days.withColumn("n", F.row_number().over(Window.orderBy(F.col(day).desc())))  # eight rows
    recent = balances.join(F.broadcast(numbered), day)
    now = recent.where("n = 1")
    previous = recent.where("n = 2").select("name", F.col("value").alias("previous"), F.col("rank").alias("previous_rank"))
    week = recent.where("n = 8").select("name", F.col("value").alias("week_ago"))
    out = now.join(previous, "name", "left").join(week, "name", "left")
    change = F.col("value") - F.col("previous")
    return out.select("name", "value", "rank", change.alias("change"), (F.col("value") - F.col("week_ago")).alias("change_week"), (F.col("previous_rank") - F.col("rank")).alias("rank_change"), F.col("previous").isNull().alias("newly_entered"), F.coalesce(F.abs(change) >= large, F.lit(False)).alias("large_change"))


def contributions(flows: DataFrame) -> DataFrame:
    """flows (name, value) with class in, out, zero or missing and the size to order by."""
    kind = F.when(F.col("value").isNull(), "missing").when(F.col("value") > 0, "in").when(F.col("value") < 0, "out").otherwise("zero")
    return flows.withColumns({"class": kind, "size": F.abs("value")})


def proportional(total: int, items: DataFrame, order: str) -> DataFrame:
    """items with share: total split into whole numbers, the remainder to the first rows."""
    n = items.count()
    if not n:
        return items.withColumn("share", F.lit(0).cast("bigint"))
    first = items.orderBy(order).limit(total % n).select(order).withColumn("__more", F.lit(1))
    return items.join(first, order, "left").withColumn("share", (F.lit(total // n) + F.coalesce("__more", F.lit(0))).cast("bigint")).drop("__more")
