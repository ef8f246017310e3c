"""Drillability: rate, class and 0-100 index."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DRILL_HARDNESS as H
from .numeric import col, ratio

SOFT, MEDIUM, HARD, VERY_HARD = "roca suave", "roca media", "roca dura", "roca muy dura"


def penetration_rate(depth="depth_m", minutes="duration_min") -> Column:
    return ratio(depth, minutes)


def class_by_duration(c: Column | str) -> Column:
    c = col(c)
    return (
        F.when(c < H.duration_soft, SOFT).when(c < H.duration_medium, MEDIUM).when(c < H.duration_hard, HARD)
        .when(c.isNotNull(), VERY_HARD)
    )


def class_by_rate(c: Column | str) -> Column:
    c = col(c)
    return (
        F.when(c > H.rate_soft, SOFT).when(c > H.rate_medium, MEDIUM).when(c > H.rate_hard, HARD)
        .when(c.isNotNull(), VERY_HARD)
    )


def _ramp(c: Column, low: float, high: float, start: float) -> Column:
    return start + 25.0 * ((c - low) / (high - low))


def index_by_duration(c: Column | str) -> Column:
    """Piecewise linear: 0 at no time, 25 / 50 / 75 at the class limits, 100 past saturation."""
    c = col(c)
    return (
        F.when(c <= 0, 0.0)
        .when(c <= H.duration_soft, _ramp(c, 0.0, H.duration_soft, 0.0))
        .when(c <= H.duration_medium, _ramp(c, H.duration_soft, H.duration_medium, 25.0))
        .when(c <= H.duration_hard, _ramp(c, H.duration_medium, H.duration_hard, 50.0))
        .when(c <= H.duration_saturation, _ramp(c, H.duration_hard, H.duration_saturation, 75.0))
        .when(c.isNotNull(), 100.0)
    )


def index_by_rate(c: Column | str) -> Column:
    c = col(c)
    return (
        F.when(c > H.rate_saturation, 0.0)
        .when(c > H.rate_soft, 25.0 * (H.rate_saturation - c) / (H.rate_saturation - H.rate_soft))
        .when(c > H.rate_medium, 25.0 + 25.0 * (H.rate_soft - c) / (H.rate_soft - H.rate_medium))
        .when(c > H.rate_hard, 50.0 + 25.0 * (H.rate_medium - c) / (H.rate_medium - H.rate_hard))
        .when(c.isNotNull(), 75.0 + 25.0 * (H.rate_hard - c) / H.rate_hard)
    )


def rig_zscore(rate: Column, mean: Column, std: Column) -> Column:
    """0 when the rig has no spread or the rate is missing."""
    return F.coalesce(F.when(std > 1e-9, (rate - mean) / std), F.lit(0.0))
