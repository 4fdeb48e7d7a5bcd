"""Number and time rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    """Double, or null where the value is no finite number."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def decisecond(t: Column) -> Column:
    """Integer tenth-of-a-second key, rounding half to even."""
    return F.rint(t * 10).cast("long")


def round_decisecond(t: Column) -> Column:
    """Time rounded half to even at one decimal."""
    return F.rint(t * 10) / 10


def round_even(c: Column, digits: int) -> Column:
    """Rounded half to even as SQL's ``round_even`` and numpy do: the scaled double decides, not (as in ``bround``) its decimal digits."""
    scale = F.lit(10.0**digits)
    return F.rint(c * scale) / scale


def clock_seconds(c: Column) -> Column:
    """Seconds of ``[N days ]H:M:S[.f]``, else null."""
    form = r"^\s*(?:(-?\d+)\s+days?,?\s+)?(\d+):(\d{1,2}):(\d{1,2}(?:\.\d+)?)\s*$"
    part = lambda i: F.regexp_extract(c, form, i).try_cast("double")
    days = F.coalesce(part(1), F.lit(0.0))
    return days * 86400 + part(2) * 3600 + part(3) * 60 + part(4)


def datetime_seconds(c: Column) -> Column:
    """Epoch seconds of a date-time text, else null."""
    return F.unix_micros(F.try_to_timestamp(c)) / F.lit(1e6)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero (plain division by zero is an error)."""
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def clip(c: Column, lower: float | None = None, upper: float | None = None) -> Column:
    """Clamp to the bounds; null stays null."""
    out = c
    if lower is not None:
        out = F.greatest(out, F.lit(float(lower)))
    if upper is not None:
        out = F.least(out, F.lit(float(upper)))
    return F.when(c.isNotNull(), out)
