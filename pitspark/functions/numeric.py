"""Numeric column helpers: text to number without NaN, guarded division, rounding."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def null_double() -> Column:
    return F.lit(None).cast("double")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """NULL for NaN and infinities."""
    c = col(c)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), null_double()).otherwise(c)


def num(c: Column | str) -> Column:
    """Dirty text to double; anything that is not a finite number becomes NULL."""
    return finite(F.trim(col(c).cast("string")).try_cast("double"))


def ratio(a: Column | str, b: Column | str) -> Column:
    """``a / b`` where ``b`` is positive, else NULL."""
    a, b = col(a), col(b)
    return F.when(b > 0, a / b)


def half_even(c: Column | str, digits: int = 0) -> Column:
    return F.bround(col(c), digits)


def clamp(c: Column | str, low: float, high: float) -> Column:
    """Value kept inside [low, high]; NULL stays NULL (``least`` and ``greatest`` alone would skip it)."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c)))


def interp_share(x: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Linear interpolation of y at x between two points; ``y0`` when they coincide."""
    return F.when(x1 == x0, y0).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))


def parse_diameter_mm(c: Column | str, reject_non_positive: bool = False) -> Column:
    """Bit diameter text to millimetres: ``10 5/8`` is inches, a number under 50 is inches, else mm."""
    text = F.regexp_replace(F.trim(col(c).cast("string")), "[\"']", "")
    whole = F.regexp_extract(text, r"^([0-9.]+)\s+[0-9.]+/[0-9.]+$", 1).try_cast("double")
    top = F.regexp_extract(text, r"(?:^|\s)([0-9.]+)/[0-9.]+$", 1).try_cast("double")
    bottom = F.regexp_extract(text, r"/([0-9.]+)$", 1).try_cast("double")
    fraction = F.when(bottom != 0, top / bottom)
    has_space = text.rlike(r"\s")
    plain = finite(text.try_cast("double"))
    plain_ok = plain > 0 if reject_non_positive else plain.isNotNull()
    lone_fraction = null_double() if reject_non_positive else fraction * 25.4
    return (
        F.when(text.contains("/"), F.when(has_space, (whole + fraction) * 25.4).otherwise(lone_fraction))
        .when(plain_ok & (plain < 50), plain * 25.4)
        .when(plain_ok, plain)
    )
