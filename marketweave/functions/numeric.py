"""Numbers: safe ratios, half-even rounding, exact sums, means and ratios, correlation and nearest ranks."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal, localcontext

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, null where the denominator is zero or null."""
    return F.try_divide(numerator, denominator)


def signed_change(now: Column, before: Column) -> Column:
    """Change against the size of the earlier value; null without one."""
    return F.try_divide(now - before, F.abs(before))


def half_even(value: Column, places: int) -> Column:
    return F.bround(value, places)


def correlation(left: str, right: str) -> Column:
    """Pearson correlation of a group; null with fewer than two pairs or a constant side."""
    return F.try_divide(F.covar_pop(left, right), F.stddev_pop(left) * F.stddev_pop(right))


def nearest_rank(column: str, share: float) -> Column:
    """The value at rank ceil(share * n)."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {column})")


def compact(value: Column) -> Column:
    """Text such as 1.5K, 2.0M or 3.1B."""
    size = F.abs(value)
    text = lambda scale, unit: F.concat(F.format_string("%.1f", value / scale), F.lit(unit))
    return F.when(size >= 1e9, text(1e9, "B")).when(size >= 1e6, text(1e6, "M")).when(size >= 1e3, text(1e3, "K")).otherwise(F.format_string("%.1f", value))


def flow_value(raw: Column) -> Column:
    """A flow in millions as text, in units: (x) is negative; dashes and blanks are null."""
    bare = F.trim(F.regexp_replace(raw, r"[,$*\s]", ""))
    inner = F.regexp_extract(bare, r"^\((.*)\)$", 1)
    number = F.when(inner != "", -F.expr("1D") * inner.try_cast("double")).otherwise(bare.try_cast("double"))
    return F.when(bare.isin("", "-", "–", "—"), None).otherwise(number * 1e6)


def _typed(value: Column, precision: int, scale: int = 0) -> Column:
    return value.cast(DecimalType(precision, scale))


def _divided(number: Column, by: Column) -> tuple[Column, Column]:
    """Whole quotient, rounded down, and remainder of whole decimals; by > 0 has at most 19 digits, the quotient 28.

    A decimal division rounds at its last place, so the quotient may be one too high or low: the remainder tells.
    """
    near = _typed(F.floor(number / by), 28)
    rest = _typed(number - _typed(near * by, 38), 38)
    step = F.when(rest < 0, -1).when(rest >= by, 1).otherwise(0)
    return _typed(near + step, 28), _typed(rest - step * by, 38)


def exact_sum(value: Column) -> Column:
    """Aggregate: the exact sum of decimals of 18 places, as whole units, units of the 18th place, and the number of values.

    The two limbs are sums of their own, so no sum overflows before 10^10 rows of the largest values; both combine before a shuffle.
    """
    fixed = _typed(value, 38, 18)
    below = fixed % _typed(F.lit(1), 1)
    # in two steps: Spark keeps 38 digits of a product, its last places not among them
    nano = _typed(F.lit(10**9), 10)
    small = _typed(_typed((below + (below < 0).cast("int").cast("decimal(1,0)")) * nano, 20, 9) * nano, 19)
    return F.struct(F.sum(_typed(F.floor(fixed), 28)).alias("whole"), F.sum(_typed(small, 28)).alias("small"), F.count(fixed).alias("n"))


def exact_mean(total: Column) -> Column:
    """The mean of an exact_sum, rounded half-even to 18 places; null without values. For means below 10^18.

    One division, all digits kept until then.
    """
    n = _typed(total["n"], 19)
    whole, rest = _divided(_typed(total["whole"], 38), n)
    small, left = _divided(_typed(rest * _typed(F.lit(10**18), 19) + total["small"], 38), n)
    twice = _typed(left * 2, 38)
    up = (twice > n) | ((twice == n) & (small % 2 == 1))
    small = _typed(small + up.cast("int"), 28)
    nano = F.lit(Decimal(1).scaleb(-9)).cast(DecimalType(9, 9))
    places = _typed(_typed(_typed(small, 19) * nano, 20, 9) * nano, 20, 18)
    return F.when(total["n"] > 0, _typed(_typed(whole, 36, 18) + places, 38, 18))


@F.pandas_udf(DecimalType(38, 18))
def exact_ratio(numerator: pd.Series, denominator: pd.Series) -> pd.Series:
    """Quotient of decimals at 60 digits, rounded half-even to 18 places; null on a zero denominator. For a row per group."""
    unit = Decimal(1).scaleb(-18)
    out = []
    with localcontext() as context:
        context.prec = 60
        for a, b in zip(numerator, denominator, strict=True):
            out.append(None if a is None or b is None or b == 0 else (Decimal(a) / Decimal(b)).quantize(unit, rounding=ROUND_HALF_EVEN))
    return pd.Series(out, dtype=object)
