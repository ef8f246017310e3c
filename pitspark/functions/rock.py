"""Rock-mass strength and slope safety expressions."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import STABILITY
from .numeric import clamp, col

# Confinement steps, as shares of intact strength, of the envelope fit.
CONFINEMENT = (0.001, 0.01, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8, 1.0)


def gsi_from_rmr(rmr: Column | str) -> Column:
    return clamp(col(rmr) - 5.0, 0.0, 100.0)


def strength_from_gsi(gsi: Column | str, ucs_mpa: Column | str, mi: float = 25.0) -> tuple[Column, Column]:
    """(cohesion kPa, friction degrees) by a straight-line fit of the failure envelope."""
    gsi, ucs = col(gsi), col(ucs_mpa)
    mb = F.exp((gsi - 100.0) / 28.0) * mi
    s = F.exp((gsi - 100.0) / 9.0)
    # In units of intact strength: x fixed, y = x + sqrt(mb x + s); the fit is then scaled back.
    xs = CONFINEMENT
    n, sx, sxx = float(len(xs)), sum(xs), sum(x * x for x in xs)
    def add(t: Column, x: Column) -> Column:
        y = x + F.sqrt(mb * x + s)
        return F.struct((t["sy"] + y).alias("sy"), (t["sxy"] + x * y).alias("sxy"))

    start = F.struct(F.lit(0.0).alias("sy"), F.lit(0.0).alias("sxy"))
    sums = F.aggregate(F.array(*[F.lit(x) for x in xs]), start, add)
    sy, sxy = sums["sy"], sums["sxy"]
    slope = (n * sxy - sx * sy) / (n * sxx - sx * sx)
    intercept = (sy - slope * sx) / n * (ucs * 1000.0)
    usable = (gsi > 0) & (ucs > 0)
    angle = F.when(slope > 0, F.atan(slope)).otherwise(math.radians(30.0))
    phi = F.degrees(clamp(angle, math.radians(15.0), math.radians(60.0)))
    known = gsi.isNotNull() & ucs.isNotNull()
    cohesion = F.when(usable, F.greatest(F.lit(0.0), intercept)).when(known, 0.0)
    return cohesion, F.when(usable, phi).when(known, 30.0)


def safety_proxy(face_angle: Column | str) -> Column:
    """Safety factor from the face angle alone."""
    a = col(face_angle)
    return F.when(a >= 90.0, 0.0).otherwise(F.tan(F.radians(F.lit(STABILITY.typical_friction_deg))) / F.tan(F.radians(a)))


def planar_safety(face_angle, height, cohesion_kpa, friction_deg, pore_ratio=0.0) -> Column:
    psi, h = F.radians(col(face_angle)), col(height)
    product = F.sin(psi) * F.cos(psi)
    pore = F.lit(pore_ratio) if isinstance(pore_ratio, float) else col(pore_ratio)
    cohesive = F.when(product > 0, col(cohesion_kpa) / (STABILITY.unit_weight_kn_m3 * h * product)).otherwise(0.0)
    frictional = F.tan(F.radians(col(friction_deg))) / F.tan(psi) * (1.0 - pore)
    return F.when((col(face_angle) >= 90.0) | (h <= 0), 0.0).otherwise(cohesive + frictional)
