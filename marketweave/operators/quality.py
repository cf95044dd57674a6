"""Audits of series: rules, duplicates, order, slots, and issue lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketweave.functions.timegrid import aligned
from marketweave.operators.bars import missing


def broken(rules: dict[str, Column]) -> Column:
    """Names of the rules whose condition holds, in order; a null condition doesn't hold."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))


def ohlc_rules(o: str = "open", h: str = "high", lo: str = "low", c: str = "close") -> dict[str, Column]:
    o, h, lo, c = map(F.col, (o, h, lo, c))
    return {
        "open_not_positive": o <= 0,
        "high_not_positive": h <= 0,
        "low_not_positive": lo <= 0,
        "close_not_positive": c <= 0,
        "high_below_low": h < lo,
        "high_below_open": h < o,
        "high_below_close": h < c,
        "low_above_open": lo > o,
        "low_above_close": lo > c,
    }


def negative_rules(columns: list[str]) -> dict[str, Column]:
    return {f"{c}_negative": F.col(c) < 0 for c in columns}


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one row, and how many."""
    return df.groupBy(*keys).agg(F.count("*").alias("count")).where("count > 1")


def out_of_order(df: DataFrame, keys: list[str], arrival: str, value: str) -> DataFrame:
    """Rows whose value is below the one that arrived before."""
    w = Window.partitionBy(*keys).orderBy(arrival)
    return df.withColumn("previous", F.lag(value).over(w)).where(F.col(value) < F.col("previous"))


def audit(df: DataFrame, step: str, seconds: int) -> DataFrame:
    """One row per symbol: expected, actual, missing, duplicate, misaligned and rule-breaking bars."""
    distinct = df.select("symbol", "ts").distinct()
    gone = missing(distinct, step).groupBy("symbol").agg(F.count("*").alias("missing"))
    rules = ohlc_rules() | negative_rules(["volume", "buy"])
    found = df.withColumn("broken", broken(rules)).groupBy("symbol").agg(
        F.count("*").alias("actual"),
        (F.count("*") - F.count_distinct("ts")).alias("duplicate"),
        F.count_if(~aligned(F.col("ts"), seconds)).alias("misaligned"),
        F.count_if(F.size("broken") > 0).alias("invalid"),
    )
    counted = found.join(gone, "symbol", "left").withColumn("missing", F.coalesce("missing", F.lit(0)))
    passed = reduce(lambda a, b: a & b, (F.col(c) == 0 for c in ("missing", "duplicate", "misaligned", "invalid")))
    return counted.withColumns({"expected": F.col("actual") - F.col("duplicate") + F.col("missing"), "passed": passed})


def slots(df: DataFrame, ts: str, every: str, tolerance: str) -> DataFrame:
    """df with slot, the grid instant at most the tolerance before ts, or null."""
    start = F.window(ts, every).getField("start")
    return df.withColumn("slot", F.when(F.col(ts) < start + F.expr(f"INTERVAL {tolerance}"), start))


def capped(issues: DataFrame, order: list[str], most: int = 200) -> DataFrame:
    """The first `most` issues over all categories, categories in the given order, then by time.

    Every task keeps its own first `most` rows, so the ordering sees few.
    """
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("category"))
    return issues.withColumn("__rank", rank).orderBy("__rank", "ts", "id").limit(most).drop("__rank")


def trusted_start(children: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The least value of each group, null if one is null."""
    return children.groupBy(*keys).agg(F.when(F.count("*") == F.count(value), F.min(value)).alias(value))


def health(run: Column, inspection: Column, reference: Column, now: Column) -> Column:
    """never_run, broken (failed, or older than 72 hours), degraded (warning, or older than 36) or healthy."""
    age = now.cast("timestamp").cast("double") - F.coalesce(reference, run).cast("timestamp").cast("double")
    return F.when(run.isNull(), "never_run").when((inspection == "failed") | (age > 72 * 3600), "broken").when((age > 36 * 3600) | (inspection == "warning"), "degraded").otherwise("healthy")


def scale_top(values: Column) -> Column:
    """The end of a scale for values of either sign: 1.15 times the greatest, 0.01 at least (an aggregate)."""
    return F.greatest(F.max(F.abs(values)) * 1.15, F.lit(0.01))
