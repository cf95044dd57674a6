"""Idempotent upserts: pure functions from the old and the new rows to the merged ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge(old: DataFrame, new: DataFrame, keys: list[str], compared: list[str], order: str | None = None) -> DataFrame:
    """All rows after the upsert, with action: inserted, updated, skipped or kept.

    A new row whose compared columns equal the old row's is skipped and the old row stays. Of new
    rows with one key the last by `order` counts.
    """
    if order:
        rest = [c for c in new.columns if c not in keys]
        new = new.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*keys, "__r.*")
    columns = [c for c in old.columns if c not in keys]
    a = old.select(*keys, F.struct(*columns).alias("o"))
    b = new.select(*keys, F.struct(*columns).alias("n"))
    same = reduce(lambda x, y: x & y, (F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in compared))
    action = F.when(F.col("n").isNull(), "kept").when(F.col("o").isNull(), "inserted").when(same, "skipped").otherwise("updated")
    both = a.join(b, keys, "full_outer").withColumn("action", action)
    take = F.when(F.col("action").isin("inserted", "updated"), F.col("n")).otherwise(F.col("o"))
    return both.select(*keys, take.alias("r"), "action").select(*keys, "r.*", "action")


def counts(merged: DataFrame) -> DataFrame:
    """One row: inserted, updated, skipped."""
    return merged.agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("inserted", "updated", "skipped")])


def deactivate_missing(merged: DataFrame, batch: DataFrame, keys: list[str], state: str) -> DataFrame:
    """Rows that the batch lacks become inactive, with state 'expired'."""
    seen = batch.select(*keys).distinct().withColumn("__seen", F.lit(True))
    marked = merged.join(seen, keys, "left")
    gone = F.col("__seen").isNull()
    return marked.withColumns({"is_active": F.when(gone, F.lit(False)).otherwise(F.col("is_active")), state: F.when(gone, F.lit("expired")).otherwise(F.col(state))}).drop("__seen")


def unknown(facts: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Facts whose key the dimension lacks: a load must stop where there are any."""
    return facts.join(dimension.select(key).distinct(), key, "left_anti")


def membership(old: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, first_seen, last_seen) after further sightings (keys, at)."""
    more = seen.select(*keys, F.col("at").alias("first_seen"), F.col("at").alias("last_seen"))
    return old.select(*keys, "first_seen", "last_seen").unionByName(more).groupBy(*keys).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
