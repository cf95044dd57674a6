"""Histories in chunks of time, so that no task sorts the whole history of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds of a chunk at least; one holds at least HALOS times what windows look beyond it.
DAY, HALOS = 86_400, 8
_UNITS = {"SECOND": 1, "MINUTE": 60, "HOUR": 3_600, "DAY": 86_400}


def seconds_of(step: str) -> int:
    """Seconds of a step such as '5 MINUTES'."""
    number, unit = step.split()
    return int(number) * _UNITS[unit.upper().rstrip("S")]


def chunk_of(ts: str | Column, width: int = DAY) -> Column:
    at = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(at.cast("timestamp")) / (width * 1_000_000))


def with_halo(df: DataFrame, step: str, before: int = 0, after: int = 0, ts: str = "ts") -> DataFrame:
    """df with __chunk and __own: each row in the chunk that holds it (own), and in the next or the one before as far as their windows reach.

    A window by key and __chunk that looks at rows up to `before` steps back and `after` steps ahead sees, for own rows, what
    one by key alone would; the other rows are dropped after it (`where("__own")`).
    """
    one = seconds_of(step)
    width = max(DAY, HALOS * one * max(before, after))
    at = F.unix_micros(F.col(ts).cast("timestamp")) - chunk_of(ts, width) * (width * 1_000_000)
    later = F.when(at >= (width - before * one) * 1_000_000, F.struct((chunk_of(ts, width) + 1).alias("c"), F.lit(False).alias("o"))) if before else F.lit(None)
    sooner = F.when(at <= after * one * 1_000_000, F.struct((chunk_of(ts, width) - 1).alias("c"), F.lit(False).alias("o"))) if after else F.lit(None)
    own = F.struct(chunk_of(ts, width).alias("c"), F.lit(True).alias("o"))
    places = F.array_compact(F.array(*[x for x, used in ((own, True), (later, before), (sooner, after)) if used]))
    return df.withColumn("__x", F.explode(places)).withColumns({"__chunk": F.col("__x.c"), "__own": F.col("__x.o")}).drop("__x")
