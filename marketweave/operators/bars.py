"""Bars from trades, and sequence operators over bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketweave.functions.numeric import nearest_rank, ratio
from marketweave.functions.timegrid import floor_to, grid
from marketweave.operators.chunks import chunk_of, with_halo


def bars(trades: DataFrame, step: str) -> DataFrame:
    """(symbol, ts, open, high, low, close, volume, buy, trades, p95) from (symbol, ts, seq, price, buy).

    One shuffle of partial aggregates; open and close are by (ts, seq).
    """
    order = F.struct("ts", "seq")
    named = trades.select("symbol", floor_to("ts", step).alias("bar"), order.alias("at"), "price", "buy")
    return named.groupBy("symbol", F.col("bar").alias("ts")).agg(
        F.min_by("price", "at").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "at").alias("close"),
        F.sum("price").alias("volume"),
        F.sum("buy").alias("buy"),
        F.count("*").alias("trades"),
        nearest_rank("price", 0.95).alias("p95"),
    )


def imbalance(buy: Column, sell: Column) -> Column:
    """(buy - sell) / (buy + sell); null where the total isn't positive."""
    return F.when(buy + sell > 0, (buy - sell) / (buy + sell))


def flow_price_mismatch(flow: Column, open_: Column, close: Column) -> Column:
    """Imbalance times the size of the bar's return, where the two have opposite signs."""
    change = F.when((open_ > 0) & (close > 0), close / open_ - 1)
    return F.when(flow * change < 0, flow * F.abs(change))


def candle(df: DataFrame) -> DataFrame:
    """change and amplitude of each bar, as shares of its open."""
    return df.withColumns({"change": ratio(F.col("close") - F.col("open"), F.col("open")), "amplitude": ratio(F.col("high") - F.col("low"), F.col("open"))})


def _by_time(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("ts")


def future_return(df: DataFrame, step: str, ahead: int = 5, name: str = "future_return") -> DataFrame:
    """close[t + ahead] / close[t] - 1, where all bars t..t+ahead exist without a gap and are closed."""
    w = _by_time("symbol", "__chunk")
    whole = F.col("closed")
    for k in range(1, ahead + 1):
        whole = whole & (F.lead("ts", k).over(w) == F.col("ts") + F.expr(f"INTERVAL {step}") * k) & F.lead("closed", k).over(w)
    later = F.lead("close", ahead).over(w)
    near = with_halo(df, step, after=ahead)
    return near.withColumn(name, F.when(whole & (F.col("close") > 0), later / F.col("close") - 1)).where("__own").drop("__chunk", "__own")


def prior_median_ratio(df: DataFrame, value: str, valid: Column, step: str, name: str, lookback: int = 60) -> DataFrame:
    """value over the median of the `lookback` values before it.

    The history ends at a gap and after an invalid bar; it must be full, and its median positive.
    """
    w = _by_time("symbol", "__chunk")
    ok = F.coalesce(valid, F.lit(False))
    marked = with_halo(df, step, before=lookback).withColumn("__ok", ok)
    new = F.lag("ts").over(w).isNull() | (F.col("ts") != F.lag("ts").over(w) + F.expr(f"INTERVAL {step}")) | ~F.lag("__ok").over(w)
    marked = marked.withColumn("__new", new.cast("int"))
    marked = marked.withColumn("__island", F.sum("__new").over(w))
    inside = Window.partitionBy("symbol", "__chunk", "__island").orderBy("ts")
    before = inside.rowsBetween(-lookback, -1)
    marked = marked.withColumns({"__place": F.row_number().over(inside), "__median": F.expr(f"percentile({value}, 0.5D)").over(before)})
    full = F.col("__ok") & (F.col("__place") > lookback) & (F.col("__median") > 0)
    return marked.withColumn(name, F.when(full, F.col(value) / F.col("__median"))).where("__own").drop("__ok", "__new", "__island", "__place", "__median", "__chunk", "__own")


def missing(df: DataFrame, step: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Expected instants between the first and last of each key that have no row."""
    bounds = df.groupBy(*keys).agg(F.min("ts").alias("start"), F.max("ts").alias("stop"))
    return grid(bounds, "start", "stop", step).join(df.select(*keys, "ts"), [*keys, "ts"], "left_anti")


def ranges(times: DataFrame, step: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Runs of consecutive instants: (keys, start, stop exclusive, count)."""
    one = F.expr(f"INTERVAL {step}")
    rank = F.row_number().over(_by_time(*keys, "__chunk"))
    island = times.withColumn("__chunk", chunk_of("ts")).withColumn("island", F.col("ts") - one * rank)
    parts = island.groupBy(*keys, "__chunk", "island").agg(F.min("ts").alias("start"), (F.max("ts") + one).alias("stop"), F.count("*").alias("count"))
    # runs that go on into the next chunk are joined: by key, over a row per run and chunk
    order = Window.partitionBy(*keys).orderBy("start")
    first = F.coalesce(F.col("start") != F.lag("stop").over(order), F.lit(True)).cast("int")
    joined = parts.withColumn("__first", first).withColumn("__run", F.sum("__first").over(order))
    return joined.groupBy(*keys, "__run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("count").alias("count")).drop("__run")


def dense(df: DataFrame, step: str, keys: tuple[str, ...] = ("symbol",), limit: int = 10_080) -> DataFrame:
    """The latest `limit` grid slots of each key, with nulls and missing = true where no row is."""
    bounds = df.groupBy(*keys).agg(F.min("ts").alias("first"), F.max("ts").alias("stop"))
    bounds = bounds.select(*keys, F.greatest("first", F.col("stop") - F.expr(f"INTERVAL {step}") * (limit - 1)).alias("start"), "stop")
    return grid(bounds, "start", "stop", step).join(df.withColumn("__here", F.lit(True)), [*keys, "ts"], "left").withColumn("missing", F.col("__here").isNull()).drop("__here")


def trailing_mean(dense_df: DataFrame, columns: list[str], name: str, slots: int = 60, keys: tuple[str, ...] = ("symbol",), step: str = "1 MINUTE") -> DataFrame:
    """Mean of the non-null values of one or more columns over the last `slots` slots of a dense grid of that step."""
    w = _by_time(*keys, "__chunk").rowsBetween(-(slots - 1), 0)
    total = sum((F.coalesce(F.sum(c).over(w), F.lit(0.0)) for c in columns[1:]), F.coalesce(F.sum(columns[0]).over(w), F.lit(0.0)))
    count = sum((F.count(c).over(w) for c in columns[1:]), F.count(columns[0]).over(w))
    near = with_halo(dense_df, step, before=slots - 1)
    return near.withColumn(name, F.when(count > 0, total / count)).where("__own").drop("__chunk", "__own")


def range_summary(df: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """First open, last close, highest, lowest of the bars of each key."""
    return df.groupBy(*keys).agg(F.min_by("open", "ts").alias("open"), F.max_by("close", "ts").alias("close"), F.max("high").alias("high"), F.min("low").alias("low"), F.count("*").alias("bars"))
