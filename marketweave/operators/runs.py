"""Runs: status, usage, recovery, schedules, watermarks, fingerprints and inspections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def roll_up(steps: DataFrame, run: str) -> DataFrame:
    """(run, status, steps, used) of steps (run, status, prompt, completion, total): all, some or none succeeded."""
    done = F.col("status") == "success"
    status = F.when(F.bool_and(done), "success").when(F.bool_or(done), "partial").otherwise("failed")
    used = F.coalesce(F.sum(F.coalesce("total", F.coalesce("prompt", F.lit(0)) + F.coalesce("completion", F.lit(0)))), F.lit(0))
    return steps.groupBy(run).agg(status.alias("status"), F.count("*").alias("steps"), used.alias("used"))


def answer_class(status: Column) -> Column:
    """fatal, retry or ok, by HTTP status."""
    return F.when(status.between(200, 299), "ok").when((status == 429) | (status >= 500), "retry").otherwise("fatal")


def recover_stale(runs: DataFrame, now: Column, minutes: int = 15) -> DataFrame:
    """Running runs without a sign of life for so long are failed."""
    idle = now.cast("timestamp").cast("double") - F.coalesce("heartbeat", "started").cast("timestamp").cast("double")
    stale = (F.col("status") == "running") & (idle > minutes * 60)
    return runs.withColumn("status", F.when(stale, F.lit("failed")).otherwise(F.col("status")))


def next_daily(after: Column, seconds: Column, zone: str = "Asia/Shanghai") -> Column:
    """The next UTC instant at which a zone's clock shows so many seconds after midnight."""
    return next_interval(after, seconds, F.lit(24), zone)


def next_interval(after: Column, seconds: Column, hours: Column, zone: str = "Asia/Shanghai") -> Column:
    """The next instant on the grid of `hours` hours that passes through that time of day."""
    local = F.from_utc_timestamp(after.cast("timestamp"), zone)
    at = F.date_trunc("day", local).cast("double") + seconds
    step = hours * 3600
    later = F.when(at > local.cast("double"), at).otherwise(at + (F.floor((local.cast("double") - at) / step) + 1) * step)
    return F.to_utc_timestamp(F.timestamp_seconds(later), zone)


def utc_range(now: Column, days: int) -> tuple[Column, Column]:
    """The `days` whole UTC days before today."""
    if not 1 <= days <= 30:
        raise ValueError("days must be from 1 to 30")
    end = F.date_trunc("day", now)
    return end - F.make_interval(days=F.lit(days)), end


def advance(watermark: Column, quality: Column, complete: Column, end: Column) -> Column:
    """The trusted watermark after a run: moved only by passed or warned runs of full coverage."""
    return F.when(quality.isin("passed", "warning") & complete, F.greatest(watermark, end)).otherwise(watermark)


def inspect_pages(pages: DataFrame, run: str) -> DataFrame:
    """Quality of collection runs from their pages (run, http, parsed, invalid, retries, complete, last).

    failed without answers, rows or coverage; warning after retries or invalid rows; else passed.
    """
    sums = pages.groupBy(run).agg(
        F.bool_and(F.coalesce(F.col("http").between(200, 299), F.lit(False))).alias("available"),
        (F.sum("parsed") > 0).alias("parsed_any"),
        F.max_by("complete", "last").alias("covered"),
        F.sum("parsed").alias("parsed"),
        F.sum("invalid").alias("invalid"),
        F.sum("retries").alias("retries"),
    )
    fine = F.col("available") & F.col("parsed_any") & F.col("covered")
    quality = F.when(~fine, "failed").when((F.col("retries") > 0) | (F.col("invalid") > 0), "warning").otherwise("passed")
    reasons = F.array_compact(F.array(F.when(~F.col("available"), F.lit("unavailable")), F.when(~F.col("parsed_any"), F.lit("unparsed")), F.when(~F.col("covered"), F.lit("uncovered")), F.when(F.col("invalid") > 0, F.lit("invalid_rows")), F.when(F.col("retries") > 0, F.lit("retried"))))
    return sums.withColumns({"quality": quality, "reasons": reasons, "issues": F.when(quality == "passed", 0).otherwise(F.greatest(F.size(reasons), F.lit(1)))})


def fund_audit(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Missing days, negative values and repeated days of daily series (keys, day, value)."""
    stats = daily.groupBy(*keys).agg(F.count("*").alias("actual"), F.count_distinct("day").alias("days"), (F.datediff(F.max("day"), F.min("day")) + 1).alias("expected"), F.count_if(F.col("value") < 0).alias("invalid"))
    out = stats.withColumns({"missing": F.col("expected") - F.col("days"), "duplicate": F.col("actual") - F.col("days")})
    return out.withColumn("quality", F.when((F.col("missing") + F.col("duplicate") + F.col("invalid")) > 0, "issues").otherwise("passed"))


def fingerprint(df: DataFrame) -> DataFrame:
    """Rows and a hash of all rows in any order: two tables with equal fingerprints hold the same rows."""
    whole = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    # sums of hash parts don't depend on order and count repeated rows
    part = lambda i: F.sum(F.conv(F.substring(whole, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)"))
    return df.agg(F.count("*").alias("rows"), F.concat_ws("-", *[F.coalesce(part(i), F.lit(0)).cast("string") for i in range(4)]).alias("fingerprint"))


def snapshot_faults(inputs: DataFrame, members: DataFrame, events: DataFrame) -> DataFrame:
    """(fault, id) where an input isn't in exactly one event or an event's size is wrong.

    inputs: id; members: id, event_id; events: event_id, size.
    """
    times = members.groupBy("id").agg(F.count("*").alias("n"))
    absent = inputs.join(members, "id", "left_anti").select(F.lit("absent").alias("fault"), "id")
    foreign = members.join(inputs, "id", "left_anti").select(F.lit("foreign").alias("fault"), "id").distinct()
    repeated = times.where("n > 1").select(F.lit("repeated").alias("fault"), "id")
    sizes = members.groupBy("event_id").agg(F.count("*").alias("n"))
    wrong = events.join(sizes, "event_id", "left").where(F.coalesce("n", F.lit(0)) != F.col("size")).select(F.lit("size").alias("fault"), F.col("event_id").alias("id"))
    return absent.unionByName(foreign).unionByName(repeated).unionByName(wrong)


def selection(records: DataFrame, results: DataFrame, mode: str) -> DataFrame:
    """Records to work on: incremental takes those without a result, retry those whose latest failed."""
    last = results.groupBy("id").agg(F.max_by("status", "at").alias("status"))
    if mode == "incremental":
        return records.join(last, "id", "left_anti")
    if mode == "retry":
        return records.join(last.where("status <> 'success'"), "id", "left_semi")
    raise ValueError(f"unknown mode {mode}")
