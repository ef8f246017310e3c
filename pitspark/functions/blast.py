"""Hole-level blast metrics; every function maps columns to one column and blocks on missing inputs."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import BLAST
from . import explosives
from .geometry import axis_angle, normalize_inclination
from .numeric import col, ratio


def stemming_ratio(taco="taco_m", burden="burden") -> Column:
    return ratio(taco, burden)


def subdrill(z_collar="z_collar", z_toe="z_toe", bench_height="bench_height_m") -> Column:
    return (col(z_collar) - col(bench_height)) - col(z_toe)


def subdrilling_ratio(burden="burden", **kw) -> Column:
    return ratio(subdrill(**kw), burden)


def spacing_burden_ratio(spacing="spacing", burden="burden") -> Column:
    return ratio(spacing, burden)


def kg_per_meter(kg="kg", length="len") -> Column:
    return ratio(kg, length)


def charge_column(length="len", taco="taco_m") -> Column:
    """Hole length above which no explosive sits removed; never negative, NULL when either is."""
    open_part = col(length) - col(taco)
    return F.when(open_part < 0, 0.0).otherwise(open_part)


def hole_fill_fraction(kg="kg", length="len", diam_mm="diam_mm", product="product") -> Column:
    area = math.pi / 4.0 * F.pow(col(diam_mm) / 1000.0, F.lit(2.0))
    return ratio(kg_per_meter(kg, length), area * (explosives.density(product) * 1000.0))


def equivalent_charge_diameter(kg="kg", length="len", product="product") -> Column:
    linear = kg_per_meter(kg, length)
    rho = explosives.density(product) * 1000.0
    return F.when((linear > 0) & (rho > 0), F.sqrt(4.0 * linear / (math.pi * rho)))


def coupling_ratio(kg="kg", length="len", diam_mm="diam_mm", product="product") -> Column:
    return ratio(equivalent_charge_diameter(kg, length, product), col(diam_mm) / 1000.0)


def collar_deviation(incl="incl", az="az", incl_design="incl_design", az_design="az_design", design_convention="FROM_VERTICAL") -> Column:
    return axis_angle(incl, az, normalize_inclination(incl_design, design_convention), az_design)


def broken_volume(burden="burden", spacing="spacing", bench_height="bench_height_m") -> Column:
    h = F.when(col(bench_height) > 0, col(bench_height))
    return col(burden) * col(spacing) * h


def kuznetsov_x50(kg="kg", product="product", rock_factor: float = BLAST.kuznetsov_rock_factor, **kw) -> Column:
    volume, q = broken_volume(**kw), col(kg)
    rws = explosives.energy(product) / BLAST.anfo_energy
    return F.when(
        (volume > 0) & (q > 0) & (rws > 0),
        rock_factor * F.pow(volume / q, F.lit(0.8)) * F.pow(q, F.lit(1.0 / 6.0)) * F.pow(rws, F.lit(-0.633)),
    )


def ispu(ucs_mpa: Column, energy_mj: Column | str = "energy_mj", density: float = BLAST.rock_density_tm3, **kw) -> Column:
    volume, e = broken_volume(**kw), col(energy_mj)
    return F.when((volume > 0) & (e > 0), volume * density * ucs_mpa / e)


def bottom_column_ratio(bottom="bottom_kg", column="column_kg") -> Column:
    return ratio(bottom, column)
