"""Registered queries on holes: metrics, powder factors, projection, correlation tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import blast, explosives, geometry, numeric
from ..functions.status import is_ramp_width
from ..operators import powder_factor as pf_ops
from ..operators.compliance import compare
from ..operators.projection import holes_behind_bench, holes_on_profile, pattern_sections, project_holes
from ..operators.spatial import exact_quantiles
from . import bridge, correlation
from .registry import (COMPS_SQL, DENSITY_SQL, ENERGY_SQL, PF_SQL, projected_sql, query, r, rs, tidy)

H, S = bridge.HOLES_SQL, bridge.SECTIONS_SQL
RADIUS = 15.0


def factors(spark, d):
    return pf_ops.powder_factors(bridge.holes(spark, d), estimate_spacing=False)


def projected(spark, d, tolerance: float = RADIUS, cutoff: bool = False):
    return project_holes(factors(spark, d), bridge.sections(spark, d), tolerance, ["pit"], cutoff)


def comparisons(spark, d):
    return compare(bridge.design_benches(spark, d), bridge.topo_benches(spark, d))


def section_table(spark, d):
    return correlation.section_correlation(projected(spark, d), bridge.sections(spark, d), comparisons(spark, d))


# --- geometry of holes ------------------------------------------------------------------------------------------

@query("hole_toes", f"WITH {H} SELECT hole_id, {rs('x_toe, y_toe, z_toe')} FROM holes")
def _(spark, d):
    return tidy(bridge.holes(spark, d).select("hole_id", "x_toe", "y_toe", "z_toe"))


@query("inclination_normalized", f"""WITH {H} SELECT hole_id, {r('CASE WHEN abs(v) <= 90 THEN abs(v) END', 'from_vertical')},
    {r('CASE WHEN 90 - abs(v) <= 90 THEN 90 - abs(v) END', 'from_dip')}, {r('CASE WHEN v >= 0 AND v <= 90 THEN v END', 'positive_only')},
    CAST(sign(v) AS INTEGER) AS orientation FROM (SELECT hole_id, incl * 12 - 20 AS v FROM holes)""")
def _(spark, d):
    h = bridge.holes(spark, d).select("hole_id", (F.col("incl") * 12 - 20).alias("v"))
    return tidy(h.select(
        "hole_id", geometry.normalize_inclination("v").alias("from_vertical"),
        geometry.normalize_inclination("v", "DIP_FROM_HORIZONTAL", "NEGATIVE_IS_DOWNWARD_DIP").alias("from_dip"),
        geometry.normalize_inclination("v", "FROM_VERTICAL", "SOURCE_DEFINED", "positive_only").alias("positive_only"),
        geometry.orientation_sign("v").alias("orientation")))


@query("azimuth_normalized", f"""WITH {H} SELECT hole_id, {r('((v % 360) + 360) % 360', 'cw_north')},
    {r('(((360 - v) % 360) + 360) % 360', 'ccw_north')}, {r('(((90 + v) % 360) + 360) % 360', 'cw_east')},
    {r('(((90 - v) % 360) + 360) % 360', 'ccw_east')} FROM (SELECT hole_id, az * 2 - 100 AS v FROM holes)""")
def _(spark, d):
    h = bridge.holes(spark, d).select("hole_id", (F.col("az") * 2 - 100).alias("v"))
    names = dict(zip(geometry.AZIMUTHS, ("cw_north", "ccw_north", "cw_east", "ccw_east")))
    return tidy(h.select("hole_id", *[geometry.normalize_azimuth("v", c).alias(n) for c, n in names.items()]))


@query("hole_unit_vectors", f"""WITH {H} SELECT hole_id, {r('sin(radians(incl)) * sin(radians(az))', 'vx')},
    {r('sin(radians(incl)) * cos(radians(az))', 'vy')}, {r('-cos(radians(incl))', 'vz')} FROM holes""")
def _(spark, d):
    vx, vy, vz = geometry.hole_vector("incl", "az")
    return tidy(bridge.holes(spark, d).select("hole_id", vx.alias("vx"), vy.alias("vy"), vz.alias("vz")))


@query("section_directions", f"WITH {S} SELECT section, {r('sin(radians(azimuth))', 'dx')}, {r('cos(radians(azimuth))', 'dy')} FROM sections")
def _(spark, d):
    dx, dy = geometry.direction("azimuth")
    return tidy(bridge.sections(spark, d).select("section", dx.alias("dx"), dy.alias("dy")))


# --- row metrics ------------------------------------------------------------------------------------------------

def _metric(name: str, column: str, sql: str, expression, digits: int = 6):
    @query(name, f"WITH {PF_SQL} SELECT hole_id, {r(sql, column, digits)} FROM pf")
    def _(spark, d):
        return tidy(factors(spark, d).select("hole_id", expression().alias(column)), digits)


_DIV = "CASE WHEN {b} > 0 THEN {a} / {b} END"
_SUB = "((z_collar - bench_height_m) - z_toe)"
_VOL = "(burden * spacing * bench_height_m)"
_DC = f"sqrt(4 * (kg / len) / (pi() * ({DENSITY_SQL} * 1000)))"
_UNIT = lambda i, a, k: {"x": f"sin(radians({i})) * sin(radians({a}))", "y": f"sin(radians({i})) * cos(radians({a}))", "z": f"cos(radians({i}))"}[k]
_DOT = " + ".join(f"{_UNIT('incl', 'az', k)} * {_UNIT('incl_design', 'az_design', k)}" for k in "xyz")
_metric("stemming_ratio", "stemming_ratio", _DIV.format(a="taco_m", b="burden"), blast.stemming_ratio)
_metric("subdrilling_ratio", "subdrilling_ratio", _DIV.format(a=_SUB, b="burden"), blast.subdrilling_ratio)
_metric("spacing_burden_ratio", "spacing_burden_ratio", _DIV.format(a="spacing", b="burden"), blast.spacing_burden_ratio)
_metric("kg_per_meter", "kg_per_meter", _DIV.format(a="kg", b="len"), blast.kg_per_meter, 12)
_metric("charge_column_height", "altura_carga_m", "greatest(len - taco_m, 0)", blast.charge_column)
_metric("hole_fill_fraction", "hole_fill_fraction",
        f"(kg / len) / (pi() / 4 * power(diam_mm / 1000, 2) * ({DENSITY_SQL} * 1000))", blast.hole_fill_fraction)
_metric("equivalent_charge_diameter", "equivalent_charge_diameter_m", _DC, blast.equivalent_charge_diameter)
_metric("coupling_ratio", "coupling_ratio", f"{_DC} / (diam_mm / 1000)", blast.coupling_ratio)
_metric("collar_deviation", "collar_deviation_deg", f"degrees(acos(greatest(-1, least(1, {_DOT}))))", blast.collar_deviation)
_metric("kuznetsov_x50", "kuznetsov_x50_cm",
        f"11 * power({_VOL} / kg, 0.8) * power(kg, 1.0 / 6) * power({ENERGY_SQL} / 3.72::DOUBLE, -0.633)", blast.kuznetsov_x50)
_metric("powder_utilization_index", "ispu", f"CASE WHEN energy_mj > 0 THEN {_VOL} * 2.7 * 90 / energy_mj END", lambda: blast.ispu(F.lit(90.0)))
_metric("bottom_column_ratio", "bottom_column_ratio", _DIV.format(a="bottom_kg", b="column_kg"), blast.bottom_column_ratio)
_metric("subdrill_series", "pasadura_m", _SUB, blast.subdrill)


@query("enriched_holes", f"""WITH {PF_SQL} SELECT hole_id, {r(_DIV.format(a='taco_m', b='burden'), 'stemming_ratio', 12)},
    {r(_DIV.format(a='spacing', b='burden'), 'spacing_burden_ratio', 12)}, {r('kg / len', 'kg_per_meter', 12)},
    {r(_DC + ' / (diam_mm / 1000)', 'coupling_ratio', 12)}, {r('energy_mj', digits=10)},
    CASE WHEN product IS NULL THEN 'MISSING' WHEN product = 'X-900' THEN 'UNKNOWN' WHEN product = 'ANFO' THEN 'VALIDATED'
      WHEN product = 'pirex-950 plus' THEN 'FAMILY_MATCH' ELSE 'UNVALIDATED_REFERENCE' END AS explosive_status FROM pf""")
def _(spark, d):
    return tidy(pf_ops.enrich(factors(spark, d), ucs_mpa=90.0).select(
        "hole_id", "stemming_ratio", "spacing_burden_ratio", "kg_per_meter", "coupling_ratio", "energy_mj", "explosive_status"), 12, energy_mj=10)


@query("explosive_resolution", f"""WITH {H} SELECT hole_id,
    CASE product WHEN 'pirex-950 plus' THEN 'Pirex-950' WHEN 'Emuline 8000' THEN 'Bulk Emulsion' WHEN 'X-900' THEN NULL ELSE product END AS product_name,
    {r(ENERGY_SQL, 'energy_mj_kg')}, {r(DENSITY_SQL, 'density_g_cm3')} FROM holes""")
def _(spark, d):
    h = bridge.holes(spark, d).select("hole_id", explosives.product_name("product").alias("product_name"))
    dim = explosives.product_dimension(spark).withColumnRenamed("product", "product_name")
    return tidy(h.join(F.broadcast(dim), "product_name", "left").select("hole_id", "product_name", "energy_mj_kg", "density_g_cm3"))


_STATUS = ("CASE WHEN product IS NULL THEN 'MISSING' WHEN product = 'X-900' THEN 'UNKNOWN' WHEN product = 'ANFO' THEN 'VALIDATED' "
           "WHEN product = 'pirex-950 plus' THEN 'FAMILY_MATCH' ELSE 'UNVALIDATED_REFERENCE' END")


@query("explosive_provenance", f"""WITH {H} SELECT hole_id, {_STATUS} AS explosive_status,
    {r(f"CASE WHEN product = 'ANFO' THEN 1 ELSE {ENERGY_SQL} / 3.72::DOUBLE END", 'explosive_rws')},
    {_STATUS} IN ('UNVALIDATED_REFERENCE', 'FAMILY_MATCH') AS explosive_rws_is_estimated,
    {_STATUS} <> 'VALIDATED' AS explosive_assumption_flag FROM holes""")
def _(spark, d):
    p = explosives.provenance("product")
    return tidy(bridge.holes(spark, d).select("hole_id", *[p[k].alias(k) for k in (
        "explosive_status", "explosive_rws", "explosive_rws_is_estimated", "explosive_assumption_flag")]))


@query("explosive_counts", f"WITH {H} SELECT product, {_STATUS} AS explosive_status, count(*) AS pozos FROM holes GROUP BY ALL")
def _(spark, d):
    return bridge.holes(spark, d).groupBy("product", explosives.status("product").alias("explosive_status")).agg(
        F.count(F.lit(1)).alias("pozos"))


@query("diameter_parsing", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    {r('CASE l_linenumber WHEN 1 THEN 10.625 * 25.4 WHEN 2 THEN 6.5 * 25.4 WHEN 3 THEN 270 WHEN 4 THEN 9 * 25.4 WHEN 5 THEN 0.875 * 25.4 END', 'diam_mm')}
    FROM lineitem""")
def _(spark, d):
    text = F.expr("""CASE l_linenumber WHEN 1 THEN '10 5/8"' WHEN 2 THEN '6 1/2' WHEN 3 THEN '270' WHEN 4 THEN ' 9 '
        WHEN 5 THEN '7/8' WHEN 6 THEN 'abc' END""")
    return tidy(bridge.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", numeric.parse_diameter_mm(text).alias("diam_mm")))


@query("bench_height_provenance", f"""WITH {H} SELECT bench_height_status, bench_height_assumption_flag, bench_height_user_confirmed,
    count(*) AS n, {r('sum(h)', 'height_sum')} FROM (SELECT CASE WHEN h0 IS NULL THEN 'MISSING' WHEN h0 > 0 THEN 'PROVIDED' ELSE 'INVALID' END AS bench_height_status,
    h0 IS NULL AS bench_height_assumption_flag, coalesce(h0 > 0, false) AS bench_height_user_confirmed, CASE WHEN h0 > 0 THEN h0 END AS h
    FROM (SELECT CASE fase WHEN 'F-7' THEN NULL WHEN 'F-6' THEN -1 ELSE 15 END AS h0 FROM holes)) GROUP BY ALL""")
def _(spark, d):
    h = bridge.holes(spark, d).withColumn("bench_height_m", F.expr("CASE fase WHEN 'F-7' THEN NULL WHEN 'F-6' THEN -1.0D ELSE 15.0D END"))
    return tidy(pf_ops.resolve_bench_height(h).groupBy(
        "bench_height_status", "bench_height_assumption_flag", "bench_height_user_confirmed").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bench_height_m").alias("height_sum")))


@query("powder_factors", f"""WITH {PF_SQL} SELECT hole_id, {rs('pf_vol_kgm3, pf_area_kgm2, energy_mj', 9)},
    {rs('pf_g_per_ton, pf_g_per_ton_net, height_real_m, height_net_m')} FROM pf""")
def _(spark, d):
    return tidy(factors(spark, d).select("hole_id", "pf_vol_kgm3", "pf_area_kgm2", "pf_g_per_ton", "pf_g_per_ton_net",
                                         "energy_mj", "height_real_m", "height_net_m"),
                pf_vol_kgm3=9, pf_area_kgm2=9, energy_mj=9)


# nearest four collars of the same pattern inside one pit; only patterns without a declared burden need them
@query("pattern_spacing_estimate", f"""WITH {H}, need AS (SELECT * FROM holes WHERE burden IS NULL),
    pairs AS (SELECT a.hole_id, a.pit, a.malla, a.x, a.y, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS dd,
      row_number() OVER (PARTITION BY a.hole_id ORDER BY sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2))) AS rn
      FROM need a JOIN need b ON a.pit = b.pit AND a.malla = b.malla AND a.hole_id <> b.hole_id)
    SELECT hole_id, {r('median(dd)', 'burden_est_m')} FROM pairs WHERE rn <= 4 GROUP BY hole_id""")
def _(spark, d):
    h = bridge.holes(spark, d)
    out = pf_ops.fill_burden_spacing(h, ["pit", "malla"])
    return tidy(out.where("burden IS NULL AND burden_est_m IS NOT NULL").select("hole_id", "burden_est_m"))


@query("subdrill_statistics", f"""WITH {H} SELECT pit, count(*) AS total, {r(f'avg({_SUB})', 'mean')},
    count(*) FILTER ({_SUB} BETWEEN 0.5 AND 1.5) AS optimal_count,
    {r(f'count(*) FILTER ({_SUB} BETWEEN 0.5 AND 1.5) * 100.0 / count(*)', 'optimal_pct')} FROM holes GROUP BY pit""")
def _(spark, d):
    sub = blast.subdrill()
    ok = F.count_if(sub.between(0.5, 1.5))
    return tidy(bridge.holes(spark, d).groupBy("pit").agg(
        F.count(F.lit(1)).alias("total"), F.avg(sub).alias("mean"), ok.alias("optimal_count"),
        (ok * 100.0 / F.count(F.lit(1))).alias("optimal_pct")))


@query("polygon_areas", f"""WITH {S} SELECT section, {r('abs(origin_x * (origin_y + 10) + 10 * length) / 2', 'area_m2')} FROM sections""")
def _(spark, d):
    from ..operators.influence import polygon_area

    # triangle (0,0), (x, -10), (length, y): its shoelace area has a closed form
    ring = F.expr("array(named_struct('x', 0.0D, 'y', 0.0D), named_struct('x', origin_x, 'y', -10.0D), "
                  "named_struct('x', length, 'y', origin_y + 10))")
    return tidy(bridge.sections(spark, d).select("section", polygon_area(ring).alias("area_m2")))


@query("hole_filters", f"""WITH {H} SELECT hole_id, malla, fase, {rs('len, kg')} FROM holes
    WHERE malla IN ('M-1', 'M-2', 'M-3', 'M-5', 'M-8') AND fase IN ('F-1', 'F-2', 'F-3') AND len BETWEEN 12 AND 18 AND kg BETWEEN 20 AND 200""")
def _(spark, d):
    from ..operators.holes import filter_holes

    h = filter_holes(bridge.holes(spark, d), malla=("M-1", "M-2", "M-3", "M-5", "M-8"), fase=("F-1", "F-2", "F-3"),
                     length=(12.0, 18.0), kg=(20.0, 200.0))
    return tidy(h.select("hole_id", "malla", "fase", "len", "kg"))


@query("ramp_widths", f"WITH {bridge.BENCHES_SQL} SELECT section, bench_number, berm_width * 2 BETWEEN 15 AND 42 AS is_ramp FROM topo")
def _(spark, d):
    return bridge.topo_benches(spark, d).select("section", "bench_number", is_ramp_width(F.col("berm_width") * 2).alias("is_ramp"))


# --- projection and correlation ---------------------------------------------------------------------------------

@query("hole_projection", f"""WITH {PF_SQL}, {S}, {projected_sql(15)} SELECT section, hole_id,
    {rs('dist_along, dist_along_toe, dist_perp, dist_perp_toe')}, closest_point FROM proj""")
def _(spark, d):
    return tidy(projected(spark, d).select("section", "hole_id", "dist_along", "dist_along_toe", "dist_perp", "dist_perp_toe", "closest_point"))


@query("hole_projection_cutoff", f"""WITH {PF_SQL}, {S}, {projected_sql(10)} SELECT section, hole_id, {r('dist_along')}
    FROM proj WHERE fecha <= survey_date - INTERVAL 7 DAY""")
def _(spark, d):
    return tidy(projected(spark, d, 10.0, True).select("section", "hole_id", "dist_along"))


@query("pattern_section_map", f"WITH {PF_SQL}, {S}, {projected_sql(15)} SELECT DISTINCT malla, section FROM proj")
def _(spark, d):
    return pattern_sections(projected(spark, d))


@query("holes_on_profile", f"""WITH {PF_SQL}, {S}, {projected_sql(15)}, near AS (SELECT a.section, a.hole_id,
    min(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2))) AS nn FROM proj a JOIN proj b ON a.section = b.section AND a.hole_id <> b.hole_id GROUP BY ALL)
    SELECT p.section, p.hole_id, round_even(dist_along, 3) + 0 AS distance, round_even(z_collar, 3) AS elevation,
    round_even(coalesce(burden, 0), 3) AS burden, round_even(coalesce(spacing, nn, 0), 3) AS spacing,
    dist_perp <= 15.000000001 AS is_within_tolerance FROM proj p LEFT JOIN near n ON p.section = n.section AND p.hole_id = n.hole_id""")
def _(spark, d):
    return holes_on_profile(projected(spark, d), RADIUS)


_PFAGG = ("avg(pf_vol_kgm3) AS pf_vol_avg, avg(pf_area_kgm2) AS pf_area_avg, avg(pf_g_per_ton) AS pf_g_per_ton_avg, "
          "avg(pf_g_per_ton_net) AS pf_g_per_ton_net_avg, sum(energy_mj) AS energy_total_mj, sum(kg) AS kg_total, "
          "count(*) AS n_wells, count(pf_vol_kgm3) AS n_pf_valid, sum(pf_vol_kgm3 * kg) / sum(CASE WHEN pf_vol_kgm3 IS NOT NULL THEN kg END) AS pf_vol_weighted, "
          "sum(pf_g_per_ton * kg) / sum(CASE WHEN pf_g_per_ton IS NOT NULL THEN kg END) AS pf_g_per_ton_weighted")


@query("powder_factor_by_section", f"""WITH {PF_SQL}, {S}, {projected_sql(15)}, g AS (SELECT section, {_PFAGG} FROM proj GROUP BY section)
    SELECT section, n_wells, n_pf_valid, {rs('pf_vol_avg, pf_area_avg, pf_g_per_ton_avg, pf_g_per_ton_net_avg, pf_vol_weighted, pf_g_per_ton_weighted')},
    {r('kg_total')}, {r('coalesce(energy_total_mj, 0)', 'energy_total_mj', 8)} FROM g""")
def _(spark, d):
    g = correlation.powder_factor_by_group(projected(spark, d), ["section"])
    return tidy(g.select("section", "n_wells", "n_pf_valid", "pf_vol_avg", "pf_area_avg", "pf_g_per_ton_avg", "pf_g_per_ton_net_avg",
                         "pf_vol_weighted", "pf_g_per_ton_weighted", "kg_total", "energy_total_mj"), energy_total_mj=8)


@query("powder_factor_by_pattern", f"""WITH {PF_SQL}, g AS (SELECT malla, {_PFAGG} FROM pf GROUP BY malla)
    SELECT malla, n_wells, n_pf_valid, {rs('pf_vol_avg, pf_vol_weighted, pf_g_per_ton_weighted')}, {r('kg_total', digits=3)} FROM g""")
def _(spark, d):
    g = correlation.powder_factor_by_group(factors(spark, d), ["malla"])
    return tidy(g.select("malla", "n_wells", "n_pf_valid", "pf_vol_avg", "pf_vol_weighted", "pf_g_per_ton_weighted", "kg_total"), kg_total=3)


_DEV = ("dev AS (SELECT section, avg(CASE WHEN delta_crest > 0 THEN delta_crest END) AS avg_over, avg(CASE WHEN delta_crest < 0 THEN delta_crest END) AS avg_under, "
        "count(*) FILTER (delta_crest > 0) AS n_over, count(*) FILTER (delta_crest < 0) AS n_under, avg(abs(delta_crest)) AS mad FROM comps GROUP BY section)")


@query("signed_deviations", f"""WITH {COMPS_SQL}, {_DEV} SELECT section, {r('coalesce(avg_over, 0)', 'avg_over')}, {r('coalesce(avg_under, 0)', 'avg_under')},
    n_over, n_under, {r('coalesce(mad, 0)', 'mean_abs_deviation')} FROM dev""")
def _(spark, d):
    return tidy(correlation.signed_deviations(comparisons(spark, d)))


CORR_SQL = f"""{PF_SQL}, {S}, {projected_sql(15)}, g AS (SELECT section, {_PFAGG} FROM proj GROUP BY section), {COMPS_SQL}, {_DEV},
  corr AS (SELECT s.section, s.sector, coalesce(n_wells, 0) AS num_wells, coalesce(kg_total, 0) AS total_kg, coalesce(mad, 0) AS mean_abs_deviation,
  coalesce(avg_over, 0) AS avg_over_break, coalesce(avg_under, 0) AS avg_under_break, coalesce(n_over, 0) AS n_over, coalesce(n_under, 0) AS n_under,
  coalesce(pf_vol_avg, 0) AS pf_vol_avg_kgm3, coalesce(pf_area_avg, 0) AS pf_area_avg_kgm2, coalesce(pf_g_per_ton_avg, 0) AS pf_g_per_ton_avg,
  coalesce(pf_g_per_ton_net_avg, 0) AS pf_g_per_ton_net_avg, 0.0::DOUBLE AS pf_g_per_ton_inf_avg, coalesce(energy_total_mj, 0) AS energy_total_mj,
  coalesce(n_pf_valid, 0) AS n_pf_valid, 2.7::DOUBLE AS rock_density_used
  FROM sections s LEFT JOIN g ON s.section = g.section LEFT JOIN dev ON s.section = dev.section)"""


@query("section_correlation", f"""WITH {CORR_SQL} SELECT section, sector, num_wells, {r('total_kg')}, {rs('mean_abs_deviation, avg_over_break, avg_under_break')},
    n_over, n_under, {rs('pf_vol_avg_kgm3, pf_area_avg_kgm2, pf_g_per_ton_avg, pf_g_per_ton_net_avg, pf_g_per_ton_inf_avg')}, {r('energy_total_mj', digits=8)},
    n_pf_valid, rock_density_used FROM corr""")
def _(spark, d):
    return tidy(section_table(spark, d), energy_total_mj=8)


@query("section_correlation_by_density", f"""WITH {CORR_SQL} SELECT section, {r("CASE sector WHEN 'ASIA' THEN 2.5 WHEN 'EUROPE' THEN 2.9 ELSE 2.7 END", 'rock_density_used')},
    {r("pf_g_per_ton_avg * 2.7 / CASE sector WHEN 'ASIA' THEN 2.5 WHEN 'EUROPE' THEN 2.9 ELSE 2.7 END", 'pf_g_per_ton_avg')} FROM corr""")
def _(spark, d):
    t = correlation.section_correlation(projected(spark, d), bridge.sections(spark, d), comparisons(spark, d),
                                        sector_density={"ASIA": 2.5, "EUROPE": 2.9})
    return tidy(t.select("section", "rock_density_used", "pf_g_per_ton_avg"))


_SIGNED = ", ".join(f"coalesce(avg(CASE WHEN delta_{c} {o} 0 THEN delta_{c} END), 0) AS avg_dev_{c}_{n}"
                    for c in ("crest", "toe") for o, n in ((">", "over"), ("<", "under")))


# means of two-decimal deviations: at 11 places no mean of up to 1024 values lies half-way between two roundings
_MEANS = {f"avg_dev_{c}_{s}": 11 for c in ("crest", "toe") for s in ("over", "under")}


@query("level_correlation", f"""WITH {PF_SQL}, {S}, {projected_sql(15)}, {COMPS_SQL}, lv AS (SELECT level, {_SIGNED} FROM comps GROUP BY level),
    per AS (SELECT level, section, count(*) AS n, sum(kg) AS kg, avg(pf_vol_kgm3) AS v, avg(pf_area_kgm2) AS a, sum(energy_mj) AS e
      FROM lv JOIN proj ON abs(z_collar - CAST(level AS DOUBLE)) <= 15 GROUP BY level, section),
    bl AS (SELECT level, sum(n) AS n, sum(kg) AS kg, avg(v) AS v, avg(a) AS a, sum(e) AS e FROM per GROUP BY level)
    SELECT lv.level, CAST(coalesce(n, 0) AS BIGINT) AS num_pozos, {r('coalesce(kg, 0)', 'total_kg', 2)}, {rs('avg_dev_crest_over, avg_dev_crest_under, avg_dev_toe_over, avg_dev_toe_under', 11)},
    {r('v', 'pf_vol_avg_kgm3')}, {r('a', 'pf_area_avg_kgm2')}, {r('coalesce(e, 0)', 'energy_total_mj', 2)} FROM lv LEFT JOIN bl ON lv.level = bl.level""")
def _(spark, d):
    return tidy(correlation.level_correlation(projected(spark, d), comparisons(spark, d)), total_kg=2, energy_total_mj=2, **_MEANS)


_CREDIT = "CASE WHEN abs({c}) <= 1 THEN 1.0 WHEN abs({c}) <= 1.5 THEN 0.5 ELSE 0 END"
ROW_CREDIT = (f"(40.0::DOUBLE * {_CREDIT.format(c='delta_crest')} + 30.0::DOUBLE * {_CREDIT.format(c='delta_toe')} + "
              "30.0::DOUBLE * CASE berm_status WHEN 'CUMPLE' THEN 1.0 WHEN 'FUERA DE TOLERANCIA' THEN 0.5 ELSE 0 END)")


@query("pattern_correlation", f"""WITH {CORR_SQL}, base AS (SELECT malla, count(*) AS num_pozos, sum(kg) AS total_kg FROM pf GROUP BY malla),
    per AS (SELECT malla, section, avg(pf_vol_kgm3) AS v, coalesce(sum(energy_mj), 0) AS e FROM proj GROUP BY malla, section),
    bl AS (SELECT malla, avg(v) AS v, sum(e) AS e FROM per GROUP BY malla),
    fan AS (SELECT malla, {_SIGNED}, CAST(round_even(avg({ROW_CREDIT}), 0) AS INTEGER) AS score_pct FROM per JOIN comps ON per.section = comps.section GROUP BY malla),
    ov AS (SELECT malla, avg(avg_over_break) AS o FROM per JOIN corr ON per.section = corr.section GROUP BY malla)
    SELECT base.malla, num_pozos, {r('total_kg', digits=3)}, {', '.join(r(f'coalesce({c}, 0)', c, 11) for c in ('avg_dev_crest_over', 'avg_dev_crest_under', 'avg_dev_toe_over', 'avg_dev_toe_under'))},
    {r('coalesce(o, 0)', 'avg_overbreak')}, {r('v', 'pf_vol_avg_kgm3')}, {r('coalesce(e, 0)', 'energy_total_mj', 2)}, coalesce(score_pct, 0) AS score_pct
    FROM base LEFT JOIN bl USING (malla) LEFT JOIN fan USING (malla) LEFT JOIN ov USING (malla)""")
def _(spark, d):
    p, c = projected(spark, d), comparisons(spark, d)
    t = correlation.section_correlation(p, bridge.sections(spark, d), c)
    return tidy(correlation.pattern_correlation(factors(spark, d), p, c, t), total_kg=3, energy_total_mj=2, **_MEANS)


@query("monthly_trend", f"""WITH {PF_SQL}, m AS (SELECT strftime(fecha, '%Y-%m') AS mes, avg(pf_vol_kgm3) AS pf, avg({_SUB}) AS dm, count(*) AS n FROM pf GROUP BY 1),
    i AS (SELECT *, row_number() OVER (ORDER BY mes) - 1 AS i FROM m), f AS (SELECT regr_slope(pf, i) AS a, regr_intercept(pf, i) AS b FROM i)
    SELECT mes, {r('pf', 'pf_promedio')}, {r('dm', 'damage_promedio')}, n AS n_pozos, {r('a', 'trend_slope', 9)}, {r('b', 'trend_intercept')} FROM i, f""")
def _(spark, d):
    h = factors(spark, d).withColumn("pasadura_m", blast.subdrill())
    return tidy(correlation.monthly_trend(h, "pasadura_m"), trend_slope=9)


@query("powder_factor_outliers", f"""WITH {PF_SQL}, q AS (SELECT quantile_cont(pf_vol_kgm3, 0.25) AS q1, quantile_cont(pf_vol_kgm3, 0.75) AS q3 FROM pf)
    SELECT hole_id, {r('pf_vol_kgm3')} FROM pf, q WHERE pf_vol_kgm3 < q1 - 0.8 * (q3 - q1) OR pf_vol_kgm3 > q3 + 0.8 * (q3 - q1)""")
def _(spark, d):
    return tidy(correlation.outliers_iqr(factors(spark, d), k=0.8).select("hole_id", "pf_vol_kgm3"))


@query("powder_factor_quartiles", f"""WITH {PF_SQL} SELECT {r('quantile_cont(pf_vol_kgm3, 0.25)', 'q1')}, {r('quantile_cont(pf_vol_kgm3, 0.5)', 'q2')},
    {r('quantile_cont(pf_vol_kgm3, 0.75)', 'q3')} FROM pf""")
def _(spark, d):
    q = exact_quantiles(factors(spark, d), "pf_vol_kgm3", [0.25, 0.5, 0.75])
    return spark.range(1).select(*[F.round(F.lit(v), 6).alias(n) for v, n in zip(q, ("q1", "q2", "q3"))])


@query("campaign_split", f"""WITH {H} SELECT CASE WHEN fecha <= DATE '1998-06-30' THEN 'before' WHEN fecha > DATE '1998-06-30' THEN 'after' END AS cohort,
    count(*) AS n, {r('avg(kg)', 'kg_avg')} FROM holes GROUP BY 1""")
def _(spark, d):
    h = correlation.campaign_cohort(bridge.holes(spark, d), "1998-06-30")
    return tidy(h.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), F.avg("kg").alias("kg_avg")))


@query("blast_trend_metadata", f"""WITH {CORR_SQL}, pos AS (SELECT * FROM corr WHERE pf_vol_avg_kgm3 > 0),
    q AS (SELECT quantile_cont(pf_vol_avg_kgm3, 0.25) AS q1, quantile_cont(pf_vol_avg_kgm3, 0.75) AS q3 FROM pos)
    SELECT round_even(avg(pf_vol_avg_kgm3), 3) AS pf_promedio, round_even(stddev_pop(pf_vol_avg_kgm3), 3) AS pf_desviacion,
    (SELECT CAST(sum(num_wells) AS BIGINT) FROM corr) AS n_pozos_total, (SELECT {r('avg(spacing / burden)', 'v')} FROM holes) AS sb_ratio,
    (SELECT count(*) FROM pos, q WHERE pf_vol_avg_kgm3 < q1 - 1.5 * (q3 - q1) OR pf_vol_avg_kgm3 > q3 + 1.5 * (q3 - q1)) AS n_outliers FROM pos""")
def _(spark, d):
    return tidy(correlation.trend_metadata(section_table(spark, d), bridge.holes(spark, d)))


@query("signed_correlations", f"""WITH {CORR_SQL} SELECT {r('coalesce(corr(avg_over_break, pf_vol_avg_kgm3) FILTER (avg_over_break > 0), 0)', 'r_over')},
    {r('coalesce(corr(avg_under_break, pf_vol_avg_kgm3) FILTER (avg_under_break < 0), 0)', 'r_under')} FROM corr""")
def _(spark, d):
    return tidy(correlation.signed_correlations(section_table(spark, d), "pf_vol_avg_kgm3"))


@query("deviation_scatter", f"""WITH {CORR_SQL}, p AS (SELECT section, 'over' AS side, pf_vol_avg_kgm3 AS x, avg_over_break AS y FROM corr WHERE avg_over_break > 0
    UNION ALL SELECT section, 'under', pf_vol_avg_kgm3, avg_under_break FROM corr WHERE avg_under_break < 0),
    f AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM p WHERE side = 'over')
    SELECT section, side, {rs('x, y')}, {r('a', 'trend_slope')}, {r('b', 'trend_intercept')} FROM p, f""")
def _(spark, d):
    return tidy(correlation.deviation_scatter(section_table(spark, d), "pf_vol_avg_kgm3"))


_HB = f"""hb AS (SELECT t.section, t.bench_number, t.bench_height AS bh, p.* EXCLUDE (section) FROM topo t JOIN proj p ON t.section = p.section
    AND z_toe BETWEEN least(crest_elevation, toe_elevation) - 2 AND greatest(crest_elevation, toe_elevation) + 2
    AND dist_along BETWEEN least(crest_distance, toe_distance) - 2 AND greatest(crest_distance, toe_distance) + 2),
    hba AS (SELECT section, bench_number, count(*) AS n, avg(pf_vol_kgm3) AS pf_avg, avg(taco_m / burden) AS st, avg(burden) AS b, avg(spacing) AS sp,
      avg((z_collar - bh) - z_toe) AS sub, sum(kg) AS kg, avg(kg / len) AS kgm FROM hb GROUP BY ALL)"""
BEHIND_SQL = f"{PF_SQL}, {S}, {projected_sql(10)}, {bridge.BENCHES_SQL}, {_HB}"


@query("holes_behind_bench", f"""WITH {BEHIND_SQL} SELECT t.section, t.bench_number, coalesce(n, 0) AS n_holes, {', '.join(r(f'coalesce({a}, 0)', b) for a, b in
    (('pf_avg', 'pf_avg'), ('st', 'stemming_ratio_avg'), ('b', 'burden_avg'), ('sp', 'spacing_avg'), ('sub', 'subdrill_avg'), ('kg', 'kg_total'), ('kgm', 'kg_per_meter_avg')))}
    FROM topo t LEFT JOIN hba USING (section, bench_number)""")
def _(spark, d):
    p = pf_ops.enrich(projected(spark, d, 10.0))
    return tidy(holes_behind_bench(bridge.topo_benches(spark, d), p, list_holes=False))
