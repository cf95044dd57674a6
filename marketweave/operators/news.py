"""News: identity, title rules, retention, eligibility, run status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ordered title rules as (id, pattern, conclusion); the first that matches decides.
EXCHANGE_RULES = [
    ("binance_marketing_quiz_v2", r"\b(?:quiz|word of the day|wotd|learn\s*(?:&|and)\s*earn)\b", "irrelevant"),
    ("binance_marketing_referral_v2", r"\b(?:referral\s+(?:campaign|program|promotion)|refer\s+(?:friends?|users?).{0,35}\bearn)\b", "irrelevant"),
    ("binance_marketing_competition_v2", r"\b(?:trading\s+(?:competition|tournament)|trade.{0,30}\bwin\b)\b", "irrelevant"),
    ("binance_marketing_rewards_v2", r"\b(?:giveaway|lucky\s+draw|complete\s+(?:the\s+)?tasks?.{0,40}(?:reward|prize)|share\s+.{0,25}\brewards?\b)\b", "irrelevant"),
]
ASSET_RULES = [
    ("eth_spot_etf_approved_v1", r"\b(?:approve[ds]?|approval)\b.{0,60}\b(?:spot\s+)?(?:ethereum|ether|eth)\b.{0,25}\betf\b|\b(?:spot\s+)?(?:ethereum|ether|eth)\b.{0,25}\betf\b.{0,60}\b(?:approve[ds]?|approval)\b", "bullish"),
    ("eth_spot_etf_rejected_v1", r"\b(?:reject(?:ed|s|ion)?|deny|denied)\b.{0,60}\b(?:spot\s+)?(?:ethereum|ether|eth)\b.{0,25}\betf\b|\b(?:spot\s+)?(?:ethereum|ether|eth)\b.{0,25}\betf\b.{0,60}\b(?:reject(?:ed|s|ion)?|deny|denied)\b", "bearish"),
]
OFFICIAL_RULE = ("official_macro_release_unclear_v1", "unclear")


def title_rule(title: Column, exchange: Column, official: Column) -> Column:
    """(rule, conclusion) of the first rule that a title meets, or null."""
    flat = F.trim(F.regexp_replace(title, r"\s+", " "))
    answer = lambda name, conclusion: F.struct(F.lit(name).alias("rule"), F.lit(conclusion).alias("conclusion"))
    rules = [F.when(official, answer(*OFFICIAL_RULE))]
    rules += [F.when(exchange & flat.rlike(f"(?i){p}"), answer(n, c)) for n, p, c in EXCHANGE_RULES]
    rules += [F.when(flat.rlike(f"(?i){p}"), answer(n, c)) for n, p, c in ASSET_RULES]
    return F.coalesce(*rules)


def dedup(items: DataFrame, source: str, tiers: list[str], order: str) -> DataFrame:
    """The first item of each source by `order`, by each identity tier in turn; a null identity never matches.

    First ones are taken in each task before they are shuffled, so that a body that thousands share is a row a task.
    """
    for tier in tiers:
        alone = items.where(F.col(tier).isNull())
        first = items.where(F.col(tier).isNotNull()).groupBy(source, tier).agg(F.min_by(F.struct(*items.columns), order).alias("__first"))
        items = first.select("__first.*").unionByName(alone)
    return items


def retained(results: DataFrame, referenced: DataFrame, now: Column, days: int = 3) -> DataFrame:
    """Rows that stay: all but irrelevant ones and unclear ones of general sources over `days` old, unless referenced."""
    old = F.col("published") < now - F.make_interval(days=F.lit(days))
    gone = (F.col("conclusion") == "irrelevant") | ((F.col("conclusion") == "unclear") & old & ~F.col("official"))
    doomed = results.where(F.coalesce(gone, F.lit(False))).select("id").join(referenced.select("id"), "id", "left_anti")
    return results.join(doomed, "id", "left_anti")


def eligible(published: Column, start: Column, end: Column, first_run: Column) -> Column:
    """Within [start, end), or before end in a first run."""
    return (published < end) & ((published >= start) | first_run)


def window_start(activated: Column, watermark: Column, overlap_days: int = 3) -> Column:
    return F.greatest(activated, watermark - F.make_interval(days=F.lit(overlap_days)))


def run_status(succeeded: Column, failed: Column) -> Column:
    return F.when(failed == 0, "success").when(succeeded > 0, "partial").otherwise("failed")
