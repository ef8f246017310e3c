"""Compliance status words as column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CUMPLE, FUERA, NO_CUMPLE, PASSING, RAMP, Band
from .numeric import col


def band_limit(deviation: Column, band: Band) -> Column:
    return F.when(deviation < 0, F.lit(band.neg)).otherwise(F.lit(band.pos))


def within_band(deviation: Column | str, band: Band) -> Column:
    d = col(deviation)
    return F.abs(d) <= band_limit(d, band)


def tripartite(deviation: Column | str, band: Band) -> Column:
    """CUMPLE inside the band, FUERA up to 1.5 times it, NO CUMPLE beyond; NULL stays NULL."""
    d = col(deviation)
    limit = band_limit(d, band)
    return (
        F.when(d.isNull(), F.lit(None).cast("string"))
        .when(F.abs(d) <= limit, CUMPLE)
        .when(F.abs(d) <= limit * 1.5, FUERA)
        .otherwise(NO_CUMPLE)
    )


def delta_status(delta: Column | str, tolerance: float) -> Column:
    """CUMPLE / FUERA / NULL by one symmetric tolerance."""
    d = F.abs(col(delta))
    return F.when(d <= tolerance, CUMPLE).when(d <= 1.5 * tolerance, FUERA)


def credit(status: Column) -> Column:
    return F.when(status == CUMPLE, 1.0).when(status == FUERA, 0.5).otherwise(0.0)


def is_passing(status: Column | str) -> Column:
    return F.coalesce(col(status).isin(*PASSING), F.lit(False))


def is_ramp_width(width: Column | str) -> Column:
    return col(width).between(RAMP.min_width, RAMP.max_width)


def status_rank(status: Column | str) -> Column:
    """3 for NO CUMPLE, 2 for FUERA, 1 for CUMPLE, else 0."""
    s = col(status)
    return F.when(s == NO_CUMPLE, 3).when(s == FUERA, 2).when(s == CUMPLE, 1).otherwise(0)
