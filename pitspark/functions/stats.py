"""Tail probabilities of Student t and F as column expressions, by the regularised incomplete beta function.

The continued fraction runs a fixed number of steps as one ``aggregate``, so it stays inside the JVM and works
for any number of model rows.
"""
from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos coefficients (g = 7) of the log-gamma series.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
           12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
TINY = 1e-300


def log_gamma(x: Column) -> Column:
    """Natural log of gamma for x > 0.5 (small arguments are shifted up by one)."""
    z = x
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:]):
        series = series + c / (z + float(i))
    t = z + 6.5
    return 0.5 * math.log(2 * math.pi) + (z - 0.5) * F.log(t) - t + F.log(series)


def _fraction(x: Column, a: Column, b: Column, steps: int = 100) -> Column:
    """Continued fraction of the incomplete beta (modified Lentz form)."""
    guard = lambda v: F.when(F.abs(v) < TINY, TINY).otherwise(v)
    start_d = 1.0 / guard(1.0 - (a + b) * x / (a + 1.0))
    start = F.struct(F.lit(1.0).alias("c"), start_d.alias("d"), start_d.alias("h"))

    def half(s: Column, term: Column) -> Column:
        d = 1.0 / guard(1.0 + term * s["d"])
        c = guard(1.0 + term / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

    def step(s: Column, m: Column) -> Column:
        k = (m + 1).cast("int")
        j = F.floor(k / 2).cast("double")
        even = j * (b - j) * x / ((a + 2 * j - 1) * (a + 2 * j))
        odd = -(a + j) * (a + b + j) * x / ((a + 2 * j) * (a + 2 * j + 1))
        return half(s, F.when(k % 2 == 0, even).otherwise(odd))

    return F.aggregate(F.sequence(F.lit(1), F.lit(2 * steps)), start, step, lambda s: s["h"])


def incomplete_beta(x: Column, a: Column, b: Column) -> Column:
    """Regularised incomplete beta I_x(a, b)."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1.0 - x))
    near = front * _fraction(x, a, b) / a
    far = 1.0 - front * _fraction(1.0 - x, b, a) / b
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < (a + 1.0) / (a + b + 2.0), near).otherwise(far)


def t_two_sided(t: Column, dof: Column) -> Column:
    """Two-sided tail of Student t."""
    dof = dof.cast("double")
    return incomplete_beta(dof / (dof + t * t), dof / 2.0, F.lit(0.5))


def f_upper(f: Column, k: Column, dof: Column) -> Column:
    """Upper tail of the F distribution."""
    k, dof = k.cast("double"), dof.cast("double")
    return incomplete_beta(dof / (dof + k * f), dof / 2.0, k / 2.0)


def t_quantile(p: float, dof: Column, steps: int = 14) -> Column:
    """Upper quantile of Student t; ``p`` above 0.5.

    Newton steps on the two-sided tail, which falls and is convex beyond the start (the normal quantile), so the
    iterates climb to the root from below.
    """
    tail = 2.0 * (1.0 - p)
    half = dof.cast("double") / 2.0
    scale = F.exp(log_gamma(half + 0.5) - log_gamma(half)) / F.sqrt(2.0 * math.pi * half)

    def step(t: Column, _: Column) -> Column:
        density = scale * F.pow(1.0 + t * t / (2.0 * half), -(half + 0.5))
        return t + (t_two_sided(t, dof) - tail) / (2.0 * density)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(NormalDist().inv_cdf(p)), step)
