"""Collection runs as tables: inputs, pages of feeds, status, diagnostics, claims and ranges that are inspected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def input_faults(symbol: Column, start: Column, end: Column, step: Column, closed: Column, symbols: list[str]) -> Column:
    """Why a range can't be inspected: names of all rules that it breaks. step: seconds of the interval, null if unknown; closed: end of the last closed candle."""
    off = lambda c: F.coalesce(F.pmod(F.unix_seconds(c.cast("timestamp")), step) != 0, F.lit(False))
    rules = {
        "symbol": ~symbol.isin(symbols),
        "interval": step.isNull(),
        "range": start >= end,
        "alignment": off(start) | off(end),
        "open": end > closed,
    }
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))


def inspection_state(faults: Column, issues: Column) -> Column:
    """(status, quality) of an inspection: failed and pending on faulty inputs, else success with issues or passed."""
    fine = F.size(faults) == 0
    return F.struct(F.when(fine, "success").otherwise("failed").alias("status"), F.when(~fine, "pending").when(issues > 0, "issues").otherwise("passed").alias("quality"))


def run_status(error: Column, persisted: Column) -> Column:
    """success without an error; with one, partial if rows were kept before it."""
    return F.when(~error, "success").when(persisted > 0, "partial").otherwise("failed")


def finished(created: Column, updated: Column, failed: Column) -> Column:
    """Status of a run that goes on after failures: failed only where nothing was created or updated."""
    return run_status(failed > 0, created + updated)


def feed_pages(pages: DataFrame, run: str, cap: int) -> DataFrame:
    """Per run of pages (run, page, digest, parsed, invalid, earliest, boundary): pages read, why it stopped, and sums over what was read.

    A run stops on a page without entries, on one whose digest came before (loop, not taken), on one whose
    earliest entry is before the boundary, or after `cap` pages. One without entries on its first page has failed.
    """
    before = F.row_number().over(Window.partitionBy(run, "digest").orderBy("page")) > 1
    reason = F.when((F.col("parsed") == 0) & (F.col("page") == 1), "no_entries").when(F.col("parsed") == 0, "completed").when(before, "page_loop")
    reason = F.coalesce(reason, F.when(F.col("earliest") < F.col("boundary"), "reached_boundary").when(F.col("page") >= cap, "page_cap"))
    told = pages.withColumn("reason", reason)
    stop = told.where(F.col("reason").isNotNull()).groupBy(run).agg(F.min(F.struct("page", "reason")).alias("stop"))
    joined = told.join(stop, run, "left").where(F.col("stop").isNull() | (F.col("page") <= F.col("stop.page")))
    taken = ~F.coalesce(F.col("reason") == "page_loop", F.lit(False))
    return joined.groupBy(run).agg(
        F.count("*").alias("pages"),
        F.coalesce(F.max("stop.reason"), F.lit("request_failed")).alias("reason"),
        F.sum(F.when(taken, F.col("parsed")).otherwise(0)).alias("parsed"),
        F.sum(F.when(taken, F.col("invalid")).otherwise(0)).alias("invalid"),
    ).withColumn("complete", F.col("reason").isin("completed", "reached_boundary"))


def diagnostics_sum(diagnostics: DataFrame, run: str, error: str) -> DataFrame:
    """Counts of runs from their diagnostics (run, requests, candidates, inserted, updated, duplicates, invalid, error) and their status."""
    names = {"requests": "requests", "candidates": "received", "inserted": "inserted", "updated": "updated", "duplicates": "skipped"}
    sums = diagnostics.groupBy(run).agg(*[F.sum(c).alias(name) for c, name in names.items()], F.sum("invalid").alias("invalid"), F.bool_or(error).alias("failed_once"))
    status = run_status(F.col("failed_once"), F.col("inserted") + F.col("updated"))
    return sums.withColumn("status", status).withColumn("failed", F.col("invalid") + (F.col("status") != "success").cast("long")).drop("invalid", "failed_once")


def latest_diagnostics(answers: DataFrame, source: str, at: str, content: str) -> DataFrame:
    """Per source the time and SHA-256 of its last answer (the greater digest of answers at one time)."""
    last = F.max(F.struct(F.col(at).alias("at"), F.sha2(F.col(content), 256).alias("digest"))).alias("x")
    return answers.groupBy(source).agg(last).select(source, F.col("x.at").alias("retrieved"), F.col("x.digest").alias("digest"))


def claims(schedules: DataFrame, now: Column, next_run: Column) -> DataFrame:
    """The enabled schedules (id, enabled, due) that are due, with the run that a claim creates and the next time."""
    return schedules.where(F.col("enabled") & (F.col("due") <= now)).select("id", F.col("due").alias("claimed_for"), now.alias("last_run"), next_run.alias("next_run"))


def admitted(requests: DataFrame, kind: str, key: str, order: list[str]) -> DataFrame:
    """Of requests (kind, key, running, ..): one per key, the first; and new ones only of kinds of which none is running.

    outcome: repeated (its key came before), busy (one of its kind runs) or created; one at most is created for each kind.
    """
    by_key = Window.partitionBy(key).orderBy(*order)
    by_kind = Window.partitionBy(kind, "first").orderBy(*order)
    busy = requests.where("running").select(F.col(kind).alias("__kind")).distinct()
    placed = requests.where("not running").withColumn("first", F.row_number().over(by_key) == 1).withColumn("turn", F.row_number().over(by_kind))
    joined = placed.join(busy, placed[kind] == busy["__kind"], "left")
    outcome = F.when(~F.col("first"), "repeated").when(F.col("__kind").isNotNull() | (F.col("turn") > 1), "busy").otherwise("created")
    return joined.withColumn("outcome", outcome).drop("first", "turn", "__kind")


def closed_children(runs: DataFrame, children: DataFrame) -> DataFrame:
    """Counts of runs (run, failed) after their pending children (run, status) were closed with them: success, failures and open ones."""
    told = children.join(runs, "run")
    status = F.when(F.col("failed") & (F.col("status") == "pending"), "failed").otherwise(F.col("status"))
    count = lambda name: F.count_if(status == name)
    return told.groupBy("run").agg(count("success").alias("successes"), count("failed").alias("failures"), count("pending").alias("open"))


def inspected_ranges(ranges: DataFrame, rows: DataFrame, key: str, step: int) -> DataFrame:
    """Collected ranges (key, start, end, period_ends) with the range that is inspected and what it should and does hold.

    Where rows are stamped with the ends of their periods, the range goes on by one step. Rows (key, ts) are counted
    per step before they meet the ranges: a range is a difference of two running sums.
    """
    last = F.when(F.col("period_ends"), F.col("end") + F.expr(f"INTERVAL {step} SECONDS")).otherwise(F.col("end"))
    wide = ranges.withColumn("last", last).withColumn("expected", ((F.unix_seconds(F.col("last").cast("timestamp")) - F.unix_seconds(F.col("start").cast("timestamp"))) / step).cast("long"))
    slot = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / step)
    per_step = rows.groupBy(key, slot(F.col("ts")).alias("slot")).agg(F.lit(1).alias("held"))
    slots = wide.select(key, "start", "last", F.explode(F.sequence(slot(F.col("start")), slot(F.col("last")) - 1)).alias("slot"))
    held = slots.join(per_step, [key, "slot"]).groupBy(key, "start", "last").agg(F.count("*").alias("actual"))
    joined = wide.join(held, [key, "start", "last"], "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return joined.withColumn("missing", F.col("expected") - F.col("actual"))


def run_bounds(start: Column, stop: Column, now: Column) -> tuple[Column, Column]:
    """The whole minutes of a run: one that hasn't stopped ends now."""
    minute = lambda c: F.date_trunc("minute", c)
    return minute(start), minute(F.coalesce(stop, now)) + F.expr("INTERVAL 1 MINUTE")


def linked_range(day: Column, latest: Column) -> tuple[Column, Column]:
    """The days that are shown around a day: from the day before to two days after its beginning, or one if it is the latest."""
    return F.date_sub(day, 1), F.date_add(day, F.when(day == latest, 1).otherwise(2))
