"""Angles, directions and hole vectors as column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import clamp, col

INCLINATIONS = ("FROM_VERTICAL", "DIP_FROM_HORIZONTAL")
SIGN_POLICIES = ("ABSOLUTE_VALUE", "NEGATIVE_IS_DOWNWARD_DIP", "SOURCE_DEFINED")
SOURCE_RULES = ("negative_is_downward_dip", "positive_only", "absolute_value")
AZIMUTHS = (
    "CLOCKWISE_FROM_NORTH",
    "COUNTERCLOCKWISE_FROM_NORTH",
    "CLOCKWISE_FROM_EAST",
    "COUNTERCLOCKWISE_FROM_EAST",
)


def normalize_inclination(
    c: Column | str,
    convention: str = "FROM_VERTICAL",
    sign_policy: str = "ABSOLUTE_VALUE",
    source_rule: str | None = None,
) -> Column:
    """Degrees from vertical. The sign policy acts first, then the convention; above 90 becomes NULL."""
    if convention not in INCLINATIONS:
        raise ValueError(f"unknown inclination convention: {convention}")
    if sign_policy not in SIGN_POLICIES:
        raise ValueError(f"unknown sign policy: {sign_policy}")
    if sign_policy == "NEGATIVE_IS_DOWNWARD_DIP" and convention == "FROM_VERTICAL":
        raise ValueError("a downward-dip sign has no meaning for angles from vertical")
    value = col(c).cast("double")
    if sign_policy == "SOURCE_DEFINED":
        if source_rule not in SOURCE_RULES:
            raise ValueError("SOURCE_DEFINED needs an explicit source rule")
        if source_rule == "positive_only":
            value = F.when(value >= 0, value)
    magnitude = F.abs(value)
    if convention == "DIP_FROM_HORIZONTAL":
        magnitude = F.lit(90.0) - magnitude
    return F.when(magnitude <= 90.0, magnitude)


def orientation_sign(c: Column | str) -> Column:
    return F.coalesce(F.signum(col(c).cast("double")), F.lit(0.0)).cast("int")


def normalize_azimuth(c: Column | str, convention: str = "CLOCKWISE_FROM_NORTH") -> Column:
    """Degrees clockwise from north, in [0, 360)."""
    value = col(c).cast("double")
    turned = {
        "CLOCKWISE_FROM_NORTH": value,
        "COUNTERCLOCKWISE_FROM_NORTH": F.lit(360.0) - value,
        "CLOCKWISE_FROM_EAST": F.lit(90.0) + value,
        "COUNTERCLOCKWISE_FROM_EAST": F.lit(90.0) - value,
    }
    if convention not in turned:
        raise ValueError(f"unknown azimuth convention: {convention}")
    return F.pmod(turned[convention], F.lit(360.0))


def hole_vector(incl: Column | str, az: Column | str) -> tuple[Column, Column, Column]:
    """Unit vector from collar to toe (east, north, up)."""
    i, a = F.radians(col(incl)), F.radians(col(az))
    return F.sin(i) * F.sin(a), F.sin(i) * F.cos(a), -F.cos(i)


def toe(x, y, z, incl, az, length) -> tuple[Column, Column, Column]:
    vx, vy, vz = hole_vector(incl, az)
    length = col(length)
    return col(x) + length * vx, col(y) + length * vy, col(z) + length * vz


def direction(azimuth: Column | str) -> tuple[Column, Column]:
    a = F.radians(col(azimuth))
    return F.sin(a), F.cos(a)


def wrapped_delta(actual: Column | str, design: Column | str) -> Column:
    """Signed azimuth difference in [-180, 180)."""
    return F.pmod(col(actual) - col(design) + 180.0, F.lit(360.0)) - 180.0


def steepness(dz: Column, dx: Column) -> Column:
    """Absolute slope of a segment in degrees."""
    return F.abs(F.degrees(F.atan2(dz, dx)))


def axis_angle(incl_a, az_a, incl_b, az_b) -> Column:
    """Angle in degrees between two hole axes."""
    ax, ay, az_ = hole_vector(incl_a, az_a)
    bx, by, bz = hole_vector(incl_b, az_b)
    dot = ax * bx + ay * by + az_ * bz
    return F.degrees(F.acos(clamp(dot, -1.0, 1.0)))
