"""As-of, interval, band, semi and anti joins, latest rows and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketweave.operators.chunks import DAY, chunk_of


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, values: list[str], width: int = DAY) -> DataFrame:
    """left with `values` of the latest row of right at or before its time, by key.

    Both sides are merged in time order by key and chunk of `width` seconds, and the last right row is carried
    forward. What comes from before a chunk is a row that stands first in it, taken from a table of a row per key and
    chunk. No pair of rows is made, a hot key is spread over its chunks, and each side is shuffled once.
    """
    carried = F.struct(F.col(right_ts).alias("__at"), *values)
    kind = right.select(carried.alias("x")).schema["x"].dataType
    a = left.select(*keys, chunk_of(left_ts, width).alias("__chunk"), F.col(left_ts).alias("__ts"), F.lit(2).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(kind).alias("__value"))
    none, no_time = F.lit(None).cast(a.schema["__row"].dataType), F.lit(None).cast(a.schema["__ts"].dataType)
    b = right.select(*keys, chunk_of(right_ts, width).alias("__chunk"), F.col(right_ts).alias("__ts"), F.lit(1).alias("__side"), none.alias("__row"), carried.alias("__value"))
    last = b.where("__chunk IS NOT NULL").groupBy(*keys, "__chunk").agg(F.max_by("__value", "__ts").alias("__value")).withColumn("__asked", F.lit(False))
    asked = a.select(*keys, "__chunk").distinct().select(*keys, "__chunk", F.lit(None).cast(kind).alias("__value"), F.lit(True).alias("__asked"))
    past = Window.partitionBy(*keys).orderBy("__chunk").rangeBetween(Window.unboundedPreceding, -1)
    before = last.unionByName(asked).withColumn("__value", F.last("__value", ignorenulls=True).over(past)).where("__asked AND __chunk IS NOT NULL AND __value IS NOT NULL")
    first = before.select(*keys, "__chunk", no_time.alias("__ts"), F.lit(0).alias("__side"), none.alias("__row"), "__value")
    w = Window.partitionBy(*keys, "__chunk").orderBy("__ts", "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = a.unionByName(b).unionByName(first).withColumn("__value", F.last("__value", ignorenulls=True).over(w)).where("__side = 2")
    return found.select("__row.*", *[F.col(f"__value.{v}").alias(v) for v in values])


def interval(points: DataFrame, spans: DataFrame, key: str, ts: str, start: str, stop: str, width: int) -> DataFrame:
    """Inner join of points with the spans (start, stop] that hold them; spans are at most `width` seconds long.

    An equi join on time buckets of that width: a span is in two buckets at most.
    """
    bucket = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / (width * 1_000_000))
    near = F.explode(F.array_distinct(F.array(bucket(F.col(start)), bucket(F.col(stop)))))
    return points.withColumn("__b", bucket(F.col(ts))).join(spans.withColumn("__b", near), [key, "__b"]).where((F.col(ts) > F.col(start)) & (F.col(ts) <= F.col(stop))).drop("__b")


def band_pairs(df: DataFrame, key: str, day: str, id_: str, days: int, tiles: int = 1) -> DataFrame:
    """Pairs (left, right) of a key at most `days` apart, left earlier or, on one day, of lower id.

    An equi join on buckets of `days` days: each row meets its own and the next bucket. The pairs of
    a bucket are dealt over `tiles` x `tiles` join keys by hash of the ids, for keys with many rows.
    """
    bucket = F.floor(F.datediff(F.col(day), F.lit("1970-01-01").cast("date")) / days)
    a = df.select(key, F.col(day).alias("left_day"), F.col(id_).alias("left"), F.explode(F.array(bucket, bucket + 1)).alias("__b"))
    b = df.select(key, F.col(day).alias("right_day"), F.col(id_).alias("right"), bucket.alias("__b"))
    tile, every = lambda side: F.pmod(F.xxhash64(side), F.lit(tiles)), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    if tiles > 1:
        a = a.withColumn("__l", tile("left").cast("int")).withColumn("__r", every)
        b = b.withColumn("__r", tile("right").cast("int")).withColumn("__l", every)
    gap = F.datediff("right_day", "left_day")
    return a.join(b, [key, "__b", *(["__l", "__r"] if tiles > 1 else [])]).where(gap.between(0, days) & ((gap > 0) | (F.col("left") < F.col("right")))).drop("__b", "__l", "__r")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def top(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key, with their rank."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def before(df: DataFrame, cursor: Column, n: int, ts: str = "ts", tie: str = "id") -> DataFrame:
    """The n rows before a cursor, oldest first, with has_more: whether others lie before them."""
    page = df.where(F.col(ts) < cursor).orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(n + 1)
    w = Window.orderBy(F.col(ts).desc(), F.col(tie).desc())  # n + 1 rows
    ranked = page.withColumns({"__n": F.row_number().over(w), "__all": F.count("*").over(Window.partitionBy(F.lit(1)))})
    return ranked.where(F.col("__n") <= n).withColumn("has_more", F.col("__all") > n).drop("__n", "__all").orderBy(ts, tie)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames hold the same rows, as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
