"""Time: floors, alignment, epochs, local dates and expected grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def floor_to(ts: str | Column, step: str) -> Column:
    """Start of the step (such as '5 minutes') that holds ts, on the UTC grid."""
    return F.window(ts, step).getField("start")


def aligned(ts: Column, seconds: int) -> Column:
    return F.unix_micros(ts.cast("timestamp")) % (seconds * 1_000_000) == 0


def from_millis(value: Column) -> Column:
    return F.timestamp_millis(value)


def rounded_millis(micros: Column) -> Column:
    """Whole milliseconds of microseconds, a half rounded away from zero."""
    return F.round(micros.cast("decimal(19,0)") * F.lit("0.001").cast("decimal(3,3)")).cast("long")


def local_date(ts: Column, zone: str = "Asia/Shanghai") -> Column:
    """The date of a UTC instant on the wall clock of a zone."""
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), zone))


def local_day_bounds(day: Column, zone: str = "Asia/Shanghai") -> tuple[Column, Column]:
    """UTC instants at which a local day begins and the next one does."""
    return F.to_utc_timestamp(day.cast("timestamp"), zone), F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), zone)


def parse_when(text: Column) -> Column:
    """Instant of a text: epoch seconds or milliseconds, RFC 2822, or ISO 8601 (UTC where it names no zone)."""
    digits = F.when(text.rlike(r"^[0-9]{1,16}$"), text.try_cast("bigint"))
    epoch = F.when(digits > 10_000_000_000, F.timestamp_millis(digits)).otherwise(F.timestamp_seconds(digits))
    bare = F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3},\s*", ""), r"\b(GMT|UTC|UT)$", "+0000")
    mail = F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.coalesce(epoch, mail, F.try_to_timestamp(text))


def grid(bounds: DataFrame, start: str, stop: str, step: str, name: str = "ts") -> DataFrame:
    """One row per expected instant in [start, stop] of each row of bounds."""
    keys = [c for c in bounds.columns if c not in (start, stop)]
    return bounds.select(*keys, F.explode(F.expr(f"sequence({start}, {stop}, INTERVAL {step})")).alias(name))
