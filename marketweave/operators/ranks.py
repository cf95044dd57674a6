"""Exact nearest ranks of groups of any size, by counts of value ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketweave.session import cut

#: Edges by which an interval is cut, rows of an interval that are ranked together at most, and intervals that all tasks get.
EDGES, RANKED, SENT = 64, 100_000, 10_000


def nearest_ranks(df: DataFrame, keys: list[str], column: str, shares: list[float], ranked: int = RANKED, edges: int = EDGES) -> DataFrame:
    """(keys.., share, value): the value at rank ceil(share * n) of the non-null doubles of each group, at least the first.

    An interval of values that holds the rank asked for is cut at approximate quantiles of its rows: into these values, each a range of its
    own, and what lies between them. Exact counts per range tell in which one the rank lies, and its own least and greatest value are
    the next interval. One of one value answers, and one of at most `ranked` rows is ranked. So each round leaves about an
    `edges`-th of the rows, however they are spread, and no task sorts a group: it holds counts of ranges or the rows of one interval.
    """
    rows = cut(df.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("v")))
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    told = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    todo = cut(groups.select(*keys, told, "n", "lo", "hi").withColumn("rank", F.greatest(F.ceil(F.col("share") * F.col("n")), F.lit(1)).cast("long")))
    done: DataFrame | None = None
    interval = [*keys, "lo", "hi"]

    def sent(those: DataFrame) -> DataFrame:
        """The intervals, sent to all tasks where they are few: else a join would deal all rows of a group to one task."""
        return F.broadcast(those) if many <= SENT else those

    # intervals of a group are few, and several shares may lie in one
    inside = lambda those: rows.join(sent(those.select(*interval).distinct()), keys).where(F.col("v").between(F.col("lo"), F.col("hi")))
    while True:
        many = todo.count()
        single = todo.where("lo = hi").select(*keys, "share", F.col("lo").alias("value"))
        little = todo.where((F.col("lo") < F.col("hi")) & (F.col("n") <= ranked))
        placed = inside(little).withColumn("rank", F.row_number().over(Window.partitionBy(*interval).orderBy("v")).cast("long"))
        found = single.unionByName(little.join(placed, [*interval, "rank"]).select(*keys, "share", F.col("v").alias("value")))
        done = cut(found if done is None else done.unionByName(found))
        large = cut(todo.where((F.col("lo") < F.col("hi")) & (F.col("n") > ranked)))
        if large.isEmpty():
            return done
        rough = inside(large).groupBy(*interval).agg(F.array_distinct(F.percentile_approx("v", [k / edges for k in range(1, edges)], 100 * edges)).alias("edges"))
        below = F.size(F.filter("edges", lambda e: e < F.col("v")))
        ranged = inside(large).join(sent(rough), interval).withColumn("range", 2 * below + F.array_contains("edges", F.col("v")).cast("int"))
        counts = ranged.groupBy(*interval, "range").agg(F.count("*").alias("k"), F.min("v").alias("first"), F.max("v").alias("last"))
        upto = F.sum("k").over(Window.partitionBy(*interval).orderBy("range"))
        within = large.join(counts.withColumn("upto", upto), interval).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("k") < F.col("rank")))
        todo = cut(within.select(*keys, "share", F.col("k").alias("n"), F.col("first").alias("lo"), F.col("last").alias("hi"), (F.col("rank") - F.col("upto") + F.col("k")).alias("rank")))
