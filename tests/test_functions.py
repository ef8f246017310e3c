import math

import pytest
from pyspark.sql import functions as F

from pitspark.config import TOLERANCES, Band
from pitspark.functions import blast, explosives, geometry, hardness, numeric, rock, stats, status


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression("v")).collect()]


def test_numbers_from_dirty_text(spark):
    assert column(spark, ["1.5", " 2 ", "N/A", None, "NaN", "Infinity", ""], "string", numeric.num) == [1.5, 2.0, None, None, None, None, None]


def test_diameters(spark):
    got = column(spark, ['10 5/8"', "7/8", "270", "9", "x", "1/0", "-3"], "string", numeric.parse_diameter_mm)
    assert got == [pytest.approx(269.875), pytest.approx(22.225), 270.0, pytest.approx(228.6), None, None, pytest.approx(-76.2)]
    strict = column(spark, ["-3", "0", "6 1/2"], "string", lambda c: numeric.parse_diameter_mm(c, True))
    assert strict == [None, None, pytest.approx(165.1)]


def test_inclination_conventions(spark):
    assert column(spark, [10.0, -10.0, 95.0, None], "double", geometry.normalize_inclination) == [10.0, 10.0, None, None]
    dip = lambda c: geometry.normalize_inclination(c, "DIP_FROM_HORIZONTAL", "NEGATIVE_IS_DOWNWARD_DIP")
    assert column(spark, [-80.0, 90.0], "double", dip) == [10.0, 0.0]
    rule = lambda c: geometry.normalize_inclination(c, "FROM_VERTICAL", "SOURCE_DEFINED", "positive_only")
    assert column(spark, [-5.0, 5.0], "double", rule) == [None, 5.0]
    with pytest.raises(ValueError):
        geometry.normalize_inclination("v", "FROM_VERTICAL", "NEGATIVE_IS_DOWNWARD_DIP")
    with pytest.raises(ValueError):
        geometry.normalize_inclination("v", "FROM_VERTICAL", "SOURCE_DEFINED")


def test_azimuths_and_wrap(spark):
    assert column(spark, [-10.0, 370.0], "double", geometry.normalize_azimuth) == [350.0, 10.0]
    assert column(spark, [30.0], "double", lambda c: geometry.normalize_azimuth(c, "COUNTERCLOCKWISE_FROM_EAST")) == [60.0]
    assert column(spark, [359.0], "double", lambda c: geometry.wrapped_delta(F.lit(1.0), c)) == [2.0]


def test_known_toe(spark):
    x, y, z = geometry.toe(F.lit(1000.0), F.lit(2000.0), F.lit(1015.0), F.lit(10.0), F.lit(90.0), F.lit(16.0))
    row = spark.range(1).select(x, y, z).first()
    assert row[0] == pytest.approx(1000 + 16 * math.sin(math.radians(10)))
    assert row[2] == pytest.approx(1015 - 16 * math.cos(math.radians(10)))


def test_tripartite_boundaries(spark):
    got = column(spark, [1.0, 1.01, 1.5, 1.51, -1.0, -1.01, -1.51], "double", lambda c: status.tripartite(c, Band(1.0, 1.0)))
    f = "FUERA DE TOLERANCIA"
    assert got == ["CUMPLE", f, f, "NO CUMPLE", "CUMPLE", f, "NO CUMPLE"]
    assert TOLERANCES.bench_height == Band(1.0, 1.5)


def test_explosive_names(spark):
    names = ["anfo", "Pirex-930 XL", "ENALINE 20", "super Heavy ANFO", "Emuline 8000", "TNT", None, "Pirex-970"]
    assert column(spark, names, "string", explosives.product_name) == ["ANFO", "Pirex-930", "Enaline", "Heavy ANFO", "Bulk Emulsion", None, None, "Pirex-970"]
    assert column(spark, names, "string", explosives.status) == [
        "VALIDATED", "FAMILY_MATCH", "FAMILY_MATCH", "UNVALIDATED_REFERENCE", "UNVALIDATED_REFERENCE", "UNKNOWN", "MISSING", "UNVALIDATED_REFERENCE"]


def test_charge_column_blocks_on_missing(spark):
    row = spark.sql("SELECT 10D AS len, CAST(NULL AS DOUBLE) AS taco_m").select(blast.charge_column()).first()
    assert row[0] is None
    assert spark.sql("SELECT 3D AS len, 5D AS taco_m").select(blast.charge_column()).first()[0] == 0.0


def test_hardness_scale(spark):
    assert column(spark, [15.9, 16.0, 24.0, 40.0, None], "double", hardness.class_by_duration) == ["roca suave", "roca media", "roca dura", "roca muy dura", None]
    assert column(spark, [0.0, 16.0, 24.0, 40.0, 60.0, 99.0], "double", hardness.index_by_duration) == [0.0, 25.0, 50.0, 75.0, 100.0, 100.0]
    assert column(spark, [2.5, 1.0, 0.7, 0.4, 0.0], "double", hardness.index_by_rate) == [0.0, 25.0, 50.0, pytest.approx(75.0), 100.0]


def test_tails_against_known_quantiles(spark):
    df = spark.createDataFrame([(2.228138852, 10.0), (12.70620474, 1.0), (2.042272456, 30.0)], "t double, n double")
    for p, q, t in df.select(stats.t_two_sided(F.col("t"), F.col("n")), stats.t_quantile(0.975, F.col("n")), "t").collect():
        assert p == pytest.approx(0.05, abs=1e-8) and q == pytest.approx(t, abs=1e-6)
    # F(3, 20) upper 5 % point
    assert spark.range(1).select(stats.f_upper(F.lit(3.098391), F.lit(3), F.lit(20))).first()[0] == pytest.approx(0.05, abs=1e-6)


def test_rock_strength_guards(spark):
    c, phi = rock.strength_from_gsi("g", F.lit(100.0))
    rows = spark.createDataFrame([(0.0,), (60.0,)], "g double").select(c, phi).collect()
    assert tuple(rows[0]) == (0.0, 30.0)
    # the same straight-line fit done by hand
    mb, s = math.exp(-40 / 28) * 25, math.exp(-40 / 9)
    xs = [1e5 * v for v in rock.CONFINEMENT]
    ys = [x + 1e5 * math.sqrt(mb * x / 1e5 + s) for x in xs]
    n, sx, sy = len(xs), sum(xs), sum(ys)
    m = (n * sum(x * y for x, y in zip(xs, ys)) - sx * sy) / (n * sum(x * x for x in xs) - sx * sx)
    assert rows[1][0] == pytest.approx(max(0.0, (sy - m * sx) / n)) and rows[1][1] == pytest.approx(min(60.0, math.degrees(math.atan(m))))
