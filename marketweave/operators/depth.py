"""Order-book depth: levels, imbalance, samples per minute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketweave.functions.numeric import nearest_rank, ratio
from marketweave.operators.chunks import chunk_of, seconds_of

LEVELS = "array<struct<price: double, quantity: double>>"


def levels(raw: Column, descending: bool, most: int = 20) -> Column:
    """The first `most` [price, quantity] texts as sorted levels; null where one isn't valid."""
    cut = F.slice(raw, 1, most)
    parsed = F.transform(cut, lambda x: F.struct(F.get(x, 0).try_cast("double").alias("price"), F.get(x, 1).try_cast("double").alias("quantity")))
    fine = F.forall(parsed, lambda x: F.coalesce((x["price"] > 0) & (x["quantity"] >= 0), F.lit(False)))
    ordered = F.array_sort(parsed)
    return F.when(fine & (F.size(parsed) > 0), F.reverse(ordered) if descending else ordered)


def quote_depth(side: Column, n: int) -> Column:
    """Sum of price times quantity over the n best levels."""
    return F.aggregate(F.slice(side, 1, n), F.lit(0.0), lambda acc, x: acc + x["price"] * x["quantity"])


def features(books: DataFrame) -> DataFrame:
    """Mid, spread and depths of books (.., bids, asks as arrays of levels, best first)."""
    best_bid, best_ask = F.get("bids", 0)["price"], F.get("asks", 0)["price"]
    mid = (best_bid + best_ask) / 2
    out = books.withColumns({"mid": mid, "spread": best_ask - best_bid, "spread_bps": ratio(best_ask - best_bid, mid) * 10_000})
    for n in (5, 10, 20):
        bid, ask = quote_depth(F.col("bids"), n), quote_depth(F.col("asks"), n)
        out = out.withColumns({f"bid_depth_{n}": bid, f"ask_depth_{n}": ask, f"imbalance_{n}": ratio(bid - ask, bid + ask)})
    return out


def minutes(samples: DataFrame, expected: int = 60) -> DataFrame:
    """One row per symbol and minute from (symbol, ts, arrival, bid, ask, spread_bps, imbalance).

    A sample that isn't later than all that came before it in its minute is dropped.
    """
    minute = F.date_trunc("minute", "ts")
    earlier = Window.partitionBy("symbol", "minute").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    kept = samples.withColumn("minute", minute).withColumn("__last", F.max("ts").over(earlier)).where("__last IS NULL OR ts > __last")
    return kept.groupBy("symbol", "minute").agg(
        F.min_by("bid", "ts").alias("bid_open"),
        F.max_by("bid", "ts").alias("bid_close"),
        F.min_by("ask", "ts").alias("ask_open"),
        F.max_by("ask", "ts").alias("ask_close"),
        F.avg("bid").alias("bid_mean"),
        F.avg("ask").alias("ask_mean"),
        F.avg("spread_bps").alias("spread_mean"),
        nearest_rank("spread_bps", 0.95).alias("spread_p95"),
        F.avg("imbalance").alias("imbalance_mean"),
        F.count("*").alias("samples"),
        F.least(F.expr("1D"), F.count("*") / expected).alias("coverage"),
    )


def sample_and_hold(updates: DataFrame, step: str = "1 second", max_age: str | None = None) -> DataFrame:
    """(symbol, ts, value, seen): the latest update at or before each slot between the first and last.

    Slots follow each other by `step` from the second of a symbol's first update. Each update is held until the
    next one, or for `max_age`, so it answers its own slots. The next update is found in a chunk of a day;
    for the last one of a chunk it is the first of a later chunk, from a table of a row per symbol and chunk.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = updates.select("symbol", at.alias("at"), F.col("value").cast("double").alias("value"), chunk_of("ts").alias("chunk"))
    every, second = seconds_of(step) * 1_000_000, 1_000_000
    chunks = rows.groupBy("symbol", "chunk").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    whole, on = Window.partitionBy("symbol"), Window.partitionBy("symbol").orderBy("chunk")
    ends = {"later": F.lead("first").over(on), "origin": F.floor(F.min("first").over(whole) / second) * second, "end": F.floor(F.max("last").over(whole) / second) * second}
    following = F.lead("at").over(Window.partitionBy("symbol", "chunk").orderBy("at", "value"))
    placed = rows.withColumn("next", following).join(chunks.withColumns(ends).drop("first", "last"), ["symbol", "chunk"])
    slot = lambda micros: F.floor((micros - F.col("origin")) / every)
    last = F.least(slot(F.coalesce("next", "later") - 1), slot(F.col("end")))
    if max_age:
        last = F.least(last, slot(F.col("at") + seconds_of(max_age) * 1_000_000))
    spans = placed.select("symbol", "at", "value", "origin", (slot(F.col("at") - 1) + 1).alias("from"), last.alias("to")).where("from <= to")
    time = lambda micros: F.timestamp_micros(micros).cast("timestamp_ntz")
    slots = spans.withColumn("k", F.explode(F.sequence("from", "to")))
    return slots.select("symbol", time(F.col("origin") + F.col("k") * every).alias("ts"), "value", time(F.col("at")).alias("seen"))
