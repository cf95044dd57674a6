"""What the operators share: lineage cuts, checked broadcasts and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketweave.session import checkpoint_folder, saved

#: ASCII white space parts words; everything else belongs to one.
WORD = r"[^\x20\x09-\x0D]+"

#: A join side is broadcast only when a count has shown that it has at most so many (narrow) rows.
BROADCAST_ROWS = 20_000


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the session's shared checkpoint folder and reads it from there from now on."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count shows at most `limit` rows, else df for a shuffled join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of the undirected edges (u, v): rows (node, root), root the least node.

    Alternates large-star and small-star rounds: every node hands its neighbours its least
    neighbour, until all edges point at their component's least node. A node's neighbours are
    never gathered: a round only takes minima (pre-aggregated) and joins on node ids, which
    adaptive execution splits when a hub has many edges. Isolated nodes have no row.
    """
    pair = lambda a, b: [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]
    now = cut(edges.where("u <> v").select(*pair("u", "v")).distinct())
    seen = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if state == seen or not state.n:
            break
        seen = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(joined.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
