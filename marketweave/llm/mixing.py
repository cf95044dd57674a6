"""Mixing sources to target weights, in DataFrame operations only.

Sizes are summed per source, repetition rates derived from the targets, and every document is
emitted floor(rate) times plus one more time with probability rate - floor(rate), drawn from a
hash of its id, so that reruns agree.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a
source without words has target 0 and rate 0; repeated rows with one id draw alike; rows of null id
draw by their texts, where docs has them; an empty table gives an empty result; further columns are kept (those
of `copies` that are named as its results are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketweave.llm.common import WORD, cut, small, text_of

WEIGHTS = (3, 1, 2)


def word_count(text: str | Column = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Target per source from (source, source_size), one row per source.

    All sources share `share` times the total by weight; a target stops at `cap` times its
    source's size and the excess goes to the others by weight, again and again until none is
    above. Each round is one aggregate over the sources.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    # one row per source: pre-aggregated, so the ordering sees sources, not documents
    ranked = cut(sizes.select("source", "source_size", F.element_at(kinds, (F.row_number().over(order) - 1) % len(weights) + 1).alias("weight"), (F.col("source_size") * F.lit(float(cap))).alias("most")))
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first().n * share
    level = 0.0
    while True:
        free = F.col("most") > F.col("weight") * F.lit(level)
        row = ranked.agg(F.coalesce(F.sum(F.when(~free, F.col("most"))), F.lit(0.0)).alias("capped"), F.coalesce(F.sum(F.when(free, F.col("weight"))), F.lit(0.0)).alias("weight")).first()
        new = (total - row.capped) / row.weight if row.weight else level
        if new <= level:
            break
        level = new
    return ranked.select("source", "source_size", F.least("most", F.col("weight") * F.lit(level)).alias("target"))


def rates(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target, rate), one row per source."""
    sized = docs.select("source", word_count().alias("n")).groupBy("source").agg(F.sum("n").alias("source_size"))
    return targets(sized, share, cap, weights).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))


def copies(docs: DataFrame, per_source: DataFrame, seed: int = 7) -> DataFrame:
    """docs with source_size, target and copies, the number of times the mix takes each document.

    The words taken of a source have a standard deviation of sqrt(sum of size^2 * f * (1 - f)), f the fraction of its rate.
    """
    rate = F.col("__rate")
    unnamed = F.concat(F.lit("text:"), F.coalesce(F.md5("text"), F.lit(""))) if "text" in docs.columns else F.lit("")
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), unnamed))
    draw = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    side = per_source.select(F.col("source").alias("__source"), F.col("source_size").alias("__size"), F.col("target").alias("__target"), F.col("rate").alias("__rate"))
    joined = docs.join(small(side), docs["source"].eqNullSafe(side["__source"]))
    return joined.select(*[docs[c] for c in docs.columns if c not in ("source_size", "target", "copies")], F.col("__size").alias("source_size"), F.col("__target").alias("target"), (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).alias("copies"))


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 7) -> DataFrame:
    """The mixed corpus: the columns of docs, each document repeated as its source's rate asks."""
    rows = docs.select("doc_id", "source", "text", F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    taken = copies(rows, rates(docs, share, cap, weights), seed).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
