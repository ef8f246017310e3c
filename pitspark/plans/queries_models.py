"""Registered queries on models, advice, attribution, drilling, hole reports, rock mass and influence areas."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import blast, hardness
from ..operators import attribution, drilling, exchange, models
from ..operators import holes as hole_ops
from ..operators import powder_factor as pf_ops
from ..operators.columns import GeometryConfig
from ..operators.compliance import deviated_features
from ..operators.influence import influence_areas
from ..operators.projection import holes_behind_bench
from . import bridge, correlation
from .queries_blast import BEHIND_SQL, CORR_SQL, comparisons, factors, projected, section_table
from .registry import COMPS_SQL, PF_SQL, query, r, rs, tidy

H = bridge.HOLES_SQL
COMPS_ONLY = COMPS_SQL.removeprefix(bridge.BENCHES_SQL + ", ")
PER = "per AS (SELECT * FROM corr WHERE pf_vol_avg_kgm3 > 0)"
_FIT = ("fit AS (SELECT count(*) AS n, regr_slope(avg_over_break, pf_vol_avg_kgm3) AS b1, regr_intercept(avg_over_break, pf_vol_avg_kgm3) AS b0, "
        "regr_r2(avg_over_break, pf_vol_avg_kgm3) AS r2, regr_sxx(avg_over_break, pf_vol_avg_kgm3) AS sxx, regr_syy(avg_over_break, pf_vol_avg_kgm3) AS syy, "
        "avg(pf_vol_avg_kgm3) AS mean_pf, min(pf_vol_avg_kgm3) AS lo, max(pf_vol_avg_kgm3) AS hi FROM per)")
FIT_SQL = f"{CORR_SQL}, {PER}, {_FIT}"


def damage_model(spark, d):
    return models.fit_line(section_table(spark, d), "pf_vol_avg_kgm3", "avg_over_break")


@query("damage_model", f"WITH {FIT_SQL} SELECT n, {r('b0', 'beta0')}, {r('b1', 'beta1')}, {r('r2', 'r_squared')}, {r('sqrt((1 - r2) * syy / sxx / (n - 2))', 'std_err_beta1')}, {r('mean_pf')} FROM fit")
def _(spark, d):
    return tidy(damage_model(spark, d).select("n", "beta0", "beta1", "r_squared", "std_err_beta1", "mean_pf"))


@query("damage_model_inference")
def _(spark, d):
    return tidy(damage_model(spark, d))


@query("damage_model_by_sector", f"""WITH {CORR_SQL}, {PER} SELECT sector, count(*) AS n, {r('regr_slope(avg_over_break, pf_g_per_ton_avg)', 'beta1')},
    {r('regr_intercept(avg_over_break, pf_g_per_ton_avg)', 'beta0')} FROM per WHERE pf_g_per_ton_avg > 0 GROUP BY sector""")
def _(spark, d):
    m = models.fit_line(section_table(spark, d), "pf_g_per_ton_avg", "avg_over_break", ["sector"])
    return tidy(m.select("sector", "n", "beta1", "beta0"))


@query("damage_model_band", f"""WITH {FIT_SQL}, gs AS (SELECT unnest(range(50)) AS i) SELECT {r('lo + i * (hi - lo) / 49', 'x')}, {r('b0 + b1 * (lo + i * (hi - lo) / 49)', 'y')},
    {r('b0 + b1 * (lo + i * (hi - lo) / 49) - 1.96 * sqrt((1 - r2) * syy / sxx / (n - 2)) * sqrt(1.0 / n + power(lo + i * (hi - lo) / 49 - mean_pf, 2) / sxx)', 'low')} FROM fit, gs""")
def _(spark, d):
    return tidy(models.line_band(damage_model(spark, d)).select("x", "y", "low"))


@query("damage_prediction")
def _(spark, d):
    rows = section_table(spark, d).select("section", (F.col("pf_vol_avg_kgm3") * 1.1).alias("target_pf"))
    return tidy(models.predict_damage(rows, damage_model(spark, d)))


def _predictors(spark, d):
    return factors(spark, d).select(
        "pit", blast.subdrill().alias("avg_over_break"), F.col("pf_vol_kgm3").alias("pf_vol"), "burden",
        (F.col("spacing") / F.col("burden") + F.col("len") / 100).alias("spacing_burden_ratio"), F.col("taco_m").alias("stemming"))


@query("multivariate_model")
def _(spark, d):
    m = models.fit_multivariate(_predictors(spark, d))
    flat = [F.col("coefficients")[k].alias(f"b_{k}") for k in models.PREDICTORS] + [F.col("p_values")[k].alias(f"p_{k}") for k in models.PREDICTORS]
    return tidy(m.select("n", "beta0", *flat, "r_squared", "r_squared_adj", "f_statistic", "f_pvalue", "condition_number", "confidence"))


# normal equations by hand for two predictors: slopes from covariances
_COV = lambda a, b: f"covar_pop({a}, {b})"
_DET = f"({_COV('x1', 'x1')} * {_COV('x2', 'x2')} - power({_COV('x1', 'x2')}, 2))"
_B1 = f"(({_COV('x1', 'yy')} * {_COV('x2', 'x2')} - {_COV('x2', 'yy')} * {_COV('x1', 'x2')}) / {_DET})"
_B2 = f"(({_COV('x2', 'yy')} * {_COV('x1', 'x1')} - {_COV('x1', 'yy')} * {_COV('x1', 'x2')}) / {_DET})"


@query("multivariate_model_by_pit", f"""WITH {PF_SQL}, t AS (SELECT pit, (z_collar - bench_height_m) - z_toe AS yy, pf_vol_kgm3 AS x1, taco_m AS x2 FROM pf WHERE pf_vol_kgm3 IS NOT NULL)
    SELECT pit, count(*) AS n, {r(_B1, 'b_pf_vol')}, {r(_B2, 'b_stemming')}, {r(f'avg(yy) - {_B1} * avg(x1) - {_B2} * avg(x2)', 'beta0')} FROM t GROUP BY pit""")
def _(spark, d):
    m = models.fit_multivariate(_predictors(spark, d), names=("pf_vol", "stemming"), group=["pit"])
    return tidy(m.select("pit", "n", F.col("coefficients")["pf_vol"].alias("b_pf_vol"), F.col("coefficients")["stemming"].alias("b_stemming"), "beta0"))


def _levels(value: str, delta: str) -> str:
    return f"""a AS (SELECT CAST(round_even(z_collar - bench_height_m, 0) AS INTEGER) AS level_m, avg({value}) AS hole_mean FROM holes GROUP BY 1),
      b AS (SELECT CAST(level AS INTEGER) AS level_m, avg({delta}) AS delta_mean FROM comps WHERE {delta} IS NOT NULL GROUP BY 1)"""


def _level_queries(name: str, value: str, delta: str, column):
    @query(name, f"WITH {H}, {COMPS_SQL}, {_levels(value, delta)} SELECT level_m, {rs('hole_mean, delta_mean')} FROM a JOIN b USING (level_m)")
    def _(spark, d):
        return tidy(models.level_pairs(bridge.holes(spark, d), comparisons(spark, d), column(), delta))

    @query(f"{name}_correlation", f"""WITH {H}, {COMPS_SQL}, {_levels(value, delta)}, c AS (SELECT count(*) AS n, corr(hole_mean, delta_mean) AS rr FROM a JOIN b USING (level_m))
        SELECT n AS n_benches, {r('rr', 'r')}, CASE WHEN rr < -0.3 THEN 'NEGATIVE' WHEN rr > 0.3 THEN 'POSITIVE' ELSE 'WEAK' END AS reading FROM c""")
    def _(spark, d):
        p = models.pair_correlation(models.level_pairs(bridge.holes(spark, d), comparisons(spark, d), column(), delta))
        return tidy(p.select("n_benches", "r", "reading"))


_level_queries("subdrill_by_level", "(z_collar - bench_height_m) - z_toe", "delta_toe", blast.subdrill)
_level_queries("stemming_by_level", "taco_m", "delta_crest", lambda: F.col("taco_m"))


@query("pf_recommendations")
def _(spark, d):
    rows = section_table(spark, d).where("pf_vol_avg_kgm3 > 0").select("section", F.col("pf_vol_avg_kgm3").alias("current_pf"))
    return tidy(models.validate_recommendation(models.charge_change(models.recommend_pf(rows, damage_model(spark, d)))).withColumn(
        "warnings", F.array_join("warnings", " | ")))


# a declared model line (damage = -0.4 + 2.5 pf, 40 samples) makes every branch reachable in SQL
_TGT = "((0.5 + 0.4) / 2.5)"


@query("pf_recommendations_declared_model", f"""WITH {CORR_SQL}, t AS (SELECT section, pf_vol_avg_kgm3 AS c FROM corr WHERE pf_vol_avg_kgm3 > 0)
    SELECT section, {r(_TGT, 'target_pf')}, {r(f'{_TGT} - c', 'delta_pf')}, {r(f'({_TGT} - c) / c * 100', 'delta_pf_pct')}, {r('-0.4 + 2.5 * c', 'predicted_current_damage')},
    CASE WHEN abs(({_TGT} - c) / c * 100) > 30 THEN 'CAUTION' ELSE 'APPLICABLE' END AS feasibility, CASE WHEN {_TGT} < c THEN 'REDUCE' ELSE 'INCREASE' END AS direction,
    abs(({_TGT} - c) / c * 100) <= 30 AS valid FROM t""")
def _(spark, d):
    model = spark.range(1).select(F.lit(-0.4).alias("beta0"), F.lit(2.5).alias("beta1"), F.lit(40).cast("long").alias("n"), F.lit(0.001).alias("p_value"),
                                  F.lit("HIGH").alias("confidence"))
    rows = section_table(spark, d).where("pf_vol_avg_kgm3 > 0").select("section", F.col("pf_vol_avg_kgm3").alias("current_pf"))
    out = models.validate_recommendation(models.charge_change(models.recommend_pf(rows, model)))
    return tidy(out.select("section", "target_pf", "delta_pf", "delta_pf_pct", "predicted_current_damage", "feasibility", "direction", "valid"))


@query("pf_recommendations_by_sector")
def _(spark, d):
    return tidy(models.recommend_by_group(section_table(spark, d), damage_model(spark, d)))


@query("burden_recommendations")
def _(spark, d):
    rows = bridge.holes(spark, d).where("burden IS NOT NULL").groupBy("malla").agg(F.avg("burden").alias("current_burden"))
    return tidy(models.recommend_burden(rows, models.fit_multivariate(_predictors(spark, d))))


@query("failure_explanations", f"""WITH {BEHIND_SQL}, {COMPS_ONLY}, x AS (SELECT c.*, coalesce(h.n, 0) AS nh, coalesce(pf_avg, 0) AS pfa, coalesce(st, 0) AS sta, coalesce(sub, 0) AS sba, coalesce(b, 0) AS bua,
      t.section IS NOT NULL AS known FROM comps c LEFT JOIN topo t ON c.section = t.section AND c.bench_num = t.bench_number LEFT JOIN hba h ON c.section = h.section AND c.bench_num = h.bench_number)
    SELECT section, bench_num, bench_score, (height_status = 'NO CUMPLE')::INTEGER + (angle_status = 'NO CUMPLE')::INTEGER + (berm_status = 'NO CUMPLE')::INTEGER AS n_issues,
    CASE WHEN NOT known THEN 'NO_CONTEXT' WHEN nh = 0 THEN 'NO_HOLES' ELSE concat_ws(',', CASE WHEN pfa > 0.9 THEN 'PF_HIGH' END, CASE WHEN pfa < 0.5 THEN 'PF_LOW' END,
      CASE WHEN sta < 0.7 THEN 'STEMMING_LOW' END, CASE WHEN sba > 2 THEN 'SUBDRILL_HIGH' END, CASE WHEN bua > 4 THEN 'BURDEN_HIGH' END) END AS causes,
    CASE WHEN bench_score < 40 OR (known AND nh = 0) THEN 'CRITICAL' WHEN bench_score < 60 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM x""")
def _(spark, d):
    context = holes_behind_bench(bridge.topo_benches(spark, d), pf_ops.enrich(projected(spark, d, 10.0)), list_holes=False).withColumnRenamed("bench_number", "bench_num")
    e = models.explain_failures(comparisons(spark, d), context)
    return e.select("section", "bench_num", "bench_score", F.size("geometry_issues").alias("n_issues"), F.array_join("blast_causes", ",").alias("causes"), "severity")


_BB = "(0.3 * burden * (pf_vol_kgm3 / 0.35) * 1.3)"
_HP = "greatest(least(0.6 * sqrt(pf_vol_kgm3 * burden * spacing * 15), 4 * burden), 0.5 * burden)"


@query("backbreak_empirical", f"""WITH {PF_SQL} SELECT hole_id, {r(f'CASE WHEN burden IS NULL THEN 0.3 * 6 * 1.3 ELSE {_BB} END', 'predicted_m')},
    {r(f'CASE WHEN burden IS NULL THEN greatest(least(0.6 * sqrt(0.35 * 6 * 7 * 15), 24), 3) ELSE {_HP} END', 'holmberg_persson_m')}, CASE WHEN burden IS NULL THEN 'LOW' ELSE 'MEDIUM' END AS confidence FROM pf""")
def _(spark, d):
    rows = factors(spark, d).select("hole_id", F.col("burden").alias("burden_m"), F.col("spacing").alias("spacing_m"), F.col("pf_vol_kgm3").alias("pf_kgm3"),
                                    F.col("taco_m").alias("stemming_m"), F.lit(1.5).alias("rock_factor"))
    return tidy(models.predict_backbreak(rows).select("hole_id", "predicted_m", "holmberg_persson_m", "confidence"))


@query("backbreak_multivariate")
def _(spark, d):
    rows = factors(spark, d).select("hole_id", F.col("burden").alias("burden_m"), F.col("spacing").alias("spacing_m"), F.col("pf_vol_kgm3").alias("pf_kgm3"), F.col("taco_m").alias("stemming_m"))
    return tidy(models.predict_backbreak(rows, models.fit_multivariate(_predictors(spark, d))).select("hole_id", "predicted_m", "ci_low_m", "ci_high_m", "method", "confidence"))


# --- attribution and energy -----------------------------------------------------------------------------------------

_FEATURES = f"""{COMPS_SQL}, {bridge.SECTIONS_SQL}, f AS (SELECT c.section, bench_num, u.feature, u.delta, u.dist, s.pit, s.origin_x + sin(radians(azimuth)) * u.dist AS fx,
    s.origin_y + cos(radians(azimuth)) * u.dist AS fy FROM comps c JOIN sections s ON c.section = s.section, LATERAL (VALUES ('crest', delta_crest, r_crest_distance), ('toe', delta_toe, r_toe_distance)) u(feature, delta, dist)
    WHERE type = 'MATCH' AND abs(u.delta) > 0.5)"""
ATTR_SQL = f"""{_FEATURES}, {H}, a AS (SELECT f.section, f.pit, bench_num, feature, delta, hole_id, malla, kg, sqrt(power(x - fx, 2) + power(y - fy, 2)) AS dd,
    kg / greatest(power(x - fx, 2) + power(y - fy, 2), 0.0001) AS score FROM f JOIN holes h ON f.pit = h.pit AND sqrt(power(x - fx, 2) + power(y - fy, 2)) <= 15),
  w AS (SELECT *, row_number() OVER (PARTITION BY section, bench_num, feature ORDER BY score DESC, hole_id) AS rank, sum(score) OVER (PARTITION BY section, bench_num, feature) AS total,
    count(*) OVER (PARTITION BY section, bench_num, feature) AS n_candidates FROM a)"""


@query("hole_attribution", f"""WITH {ATTR_SQL} SELECT pit, section, bench_num, feature, round_even(delta, 3) + 0 AS delta_m, n_candidates, CAST(rank AS INTEGER) AS rank, hole_id, malla,
    {r('kg', digits=9)}, round_even(dd, 3) AS distance_m, round_even(score / total * 100, 2) AS contribution_pct FROM w WHERE rank <= 5""")
def _(spark, d):
    f = deviated_features(comparisons(spark, d), bridge.sections(spark, d))
    return tidy(attribution.attribute_holes(f, bridge.holes(spark, d), ["pit"]), 9)


_POINTS = f"""{H}, {bridge.SECTIONS_SQL}, p AS (SELECT pit, section, i, origin_x + sin(radians(azimuth)) * (i * 5 - 100) AS fx, origin_y + cos(radians(azimuth)) * (i * 5 - 100) AS fy
    FROM sections, (SELECT unnest(range(41)) AS i))"""


@query("energy_along_profile", f"""WITH {_POINTS} SELECT p.section, CAST(i AS INTEGER) AS i, {r('coalesce(sum(kg / greatest(power(x - fx, 2) + power(y - fy, 2), 0.0001)), 0)', 'energy', 4)}
    FROM p LEFT JOIN holes h ON p.pit = h.pit AND sqrt(power(x - fx, 2) + power(y - fy, 2)) <= 30 GROUP BY p.section, i""")
def _(spark, d):
    s = bridge.sections(spark, d).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(40)))).selectExpr(
        "pit", "section", "i", "origin_x + sin(radians(azimuth)) * (i * 5 - 100) AS fx", "origin_y + cos(radians(azimuth)) * (i * 5 - 100) AS fy")
    return tidy(attribution.energy_density(s, bridge.holes(spark, d), ["pit"]).select("section", "i", "energy"), 4)


_GN = lambda a, n: f"{a}0 + i{a} * (({a}1 - {a}0) / {n - 1})"


def _field_sql(nx: int, ny: int, nz: int, value: str = "kg") -> str:
    """The energy ``e`` of every node, each from all holes of its pit."""
    return f"""{H}, bx AS (SELECT pit, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z_toe) AS z0, max(z_collar) AS z1 FROM holes GROUP BY pit),
    g AS (SELECT *, {_GN('x', nx)} AS gx, {_GN('y', ny)} AS gy, {_GN('z', nz)} AS gz FROM bx, (SELECT unnest(range({nx})) AS ix), (SELECT unnest(range({ny})) AS iy), (SELECT unnest(range({nz})) AS iz)),
    t AS (SELECT g.pit, ix, iy, iz, gx, gy, {value} AS q, gx - x AS wx, gy - y AS wy, gz - z_collar AS wz, x_toe - x AS vx, y_toe - y AS vy, z_toe - z_collar AS vz FROM g JOIN holes h ON g.pit = h.pit),
    u AS (SELECT *, greatest(0, least(1, (wx * vx + wy * vy + wz * vz) / (vx * vx + vy * vy + vz * vz))) AS k FROM t),
    field AS (SELECT pit, ix, iy, iz, any_value(gx) AS x, any_value(gy) AS y,
      sum(q * exp(-greatest(power(wx - k * vx, 2) + power(wy - k * vy, 2) + power(wz - k * vz, 2), 0.0001) / 1800)) AS e FROM u GROUP BY pit, ix, iy, iz)"""


_NODES = f"pit, CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy, CAST(iz AS INTEGER) AS iz, {r('e', 'energy', 4)}"


@query("energy_grid", f"WITH {_field_sql(6, 6, 3)} SELECT {_NODES} FROM field")
def _(spark, d):
    return tidy(attribution.energy_grid(bridge.holes(spark, d), ["pit"], 6, 6, 3).select("pit", "ix", "iy", "iz", "energy"), 4)


@query("energy_grid_default", f"WITH {_field_sql(20, 20, 5)} SELECT {_NODES} FROM field")
def _(spark, d):
    return tidy(attribution.energy_grid(bridge.holes(spark, d), ["pit"]).select("pit", "ix", "iy", "iz", "energy"), 4)


@query("hole_density_grid", f"WITH {_field_sql(10, 10, 4, '1')} SELECT {_NODES} FROM field")
def _(spark, d):
    return tidy(attribution.energy_grid(bridge.holes(spark, d), ["pit"], 10, 10, 4, value=None).select("pit", "ix", "iy", "iz", "energy"), 4)


@query("energy_map", f"""WITH {_field_sql(6, 6, 3)}, m AS (SELECT pit, ix, iy, any_value(x) AS x, any_value(y) AS y, sum(e) AS e FROM field GROUP BY pit, ix, iy)
    SELECT pit, CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy, {r('x', digits=4)}, {r('y', digits=4)}, {r('e', 'energy', 4)}, {r('max(e) OVER (PARTITION BY pit)', 'e_max', 4)} FROM m""")
def _(spark, d):
    return tidy(attribution.energy_map(attribution.energy_grid(bridge.holes(spark, d), ["pit"], 6, 6, 3), ["pit"]), 4)


# --- drilling -------------------------------------------------------------------------------------------------------

LAST = f"{bridge.DRILL_SQL}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pozo ORDER BY tiempo_final DESC, event_id) AS rn FROM drill) WHERE rn = 1)"
_RATE = "CASE WHEN duration_min > 0 THEN depth_m / duration_min END"
_CR = "CASE WHEN v > 1.0 THEN 'roca suave' WHEN v > 0.7 THEN 'roca media' WHEN v > 0.4 THEN 'roca dura' WHEN v IS NOT NULL THEN 'roca muy dura' END"
_CD = "CASE WHEN duration_min < 16 THEN 'roca suave' WHEN duration_min < 24 THEN 'roca media' WHEN duration_min < 40 THEN 'roca dura' ELSE 'roca muy dura' END"
_IR = "CASE WHEN v > 2 THEN 0 WHEN v > 1 THEN 25 * (2 - v) WHEN v > 0.7 THEN 25 + 25 * (1 - v) / (1.0 - 0.7) WHEN v > 0.4 THEN 50 + 25 * (0.7 - v) / (0.7 - 0.4) ELSE 75 + 25 * (0.4 - v) / 0.4 END"
_ID = "CASE WHEN duration_min <= 0 THEN 0 WHEN duration_min <= 16 THEN 25 * duration_min / 16 WHEN duration_min <= 24 THEN 25 + 25 * (duration_min - 16) / 8 WHEN duration_min <= 40 THEN 50 + 25 * (duration_min - 24) / 16 WHEN duration_min <= 60 THEN 75 + 25 * (duration_min - 40) / 20 ELSE 100 END"
HARD = f"hard AS (SELECT *, CASE WHEN v IS NOT NULL THEN {_CR} ELSE {_CD} END AS dureza, CASE WHEN v IS NOT NULL THEN {_IR} ELSE {_ID} END AS indice FROM (SELECT *, {_RATE} AS v FROM drill))"


@query("last_drill_events", f"WITH {LAST} SELECT pozo, event_id, rig, {rs('depth_m, duration_min')} FROM last")
def _(spark, d):
    return tidy(drilling.last_event_per_hole(bridge.drill_events(spark, d)).select("pozo", "event_id", "rig", "depth_m", "duration_min"))


@query("penetration_rates", f"WITH {bridge.DRILL_SQL} SELECT event_id, {r(_RATE, 'rate')} FROM drill")
def _(spark, d):
    return tidy(bridge.drill_events(spark, d).select("event_id", hardness.penetration_rate().alias("rate")))


@query("drill_hardness", f"WITH {bridge.DRILL_SQL}, {HARD} SELECT event_id, dureza, {r('indice', 'indice_dureza')} FROM hard")
def _(spark, d):
    return tidy(drilling.with_hardness(bridge.drill_events(spark, d)).select("event_id", "dureza", "indice_dureza"))


@query("duration_hardness", f"WITH {bridge.DRILL_SQL} SELECT event_id, {_CD} AS dureza, {r(_ID, 'indice')} FROM drill")
def _(spark, d):
    return tidy(bridge.drill_events(spark, d).select("event_id", hardness.class_by_duration("duration_min").alias("dureza"), hardness.index_by_duration("duration_min").alias("indice")))


@query("rig_zscores", f"""WITH {bridge.DRILL_SQL}, {HARD}, g AS (SELECT rig, avg(v) AS m, stddev_samp(v) AS s FROM hard GROUP BY rig)
    SELECT event_id, {r('coalesce((v - m) / s, 0)', 'rig_zscore')} FROM hard JOIN g USING (rig)""")
def _(spark, d):
    return tidy(drilling.with_rig_zscore(drilling.with_hardness(bridge.drill_events(spark, d))).select("event_id", "rig_zscore"))


_NEAR = f"""{H}, {bridge.DRILL_SQL}, {HARD}, nn AS (SELECT h.hole_id, e.event_id, dureza, sqrt(power(x - px, 2) + power(y - py, 2)) AS dd,
    row_number() OVER (PARTITION BY h.hole_id ORDER BY sqrt(power(x - px, 2) + power(y - py, 2)), e.event_id) AS rn FROM holes h JOIN hard e ON h.pit = e.pit AND abs(x - px) <= 2 AND abs(y - py) <= 2
    AND sqrt(power(x - px, 2) + power(y - py, 2)) <= 2)"""


def _hard_holes(spark, d):
    events = drilling.with_rig_zscore(drilling.with_hardness(bridge.drill_events(spark, d)))
    return drilling.hardness_onto_holes(bridge.holes(spark, d), events, ["pit"])


@query("hardness_onto_holes", f"WITH {_NEAR} SELECT h.hole_id, dureza, {r('dd', 'distancia_pozo_perf_m')} FROM holes h LEFT JOIN nn ON h.hole_id = nn.hole_id AND rn = 1")
def _(spark, d):
    return tidy(_hard_holes(spark, d).select("hole_id", "dureza", "distancia_pozo_perf_m"))


@query("hardness_distribution", f"WITH {_NEAR} SELECT coalesce(dureza, 'sin dato') AS dureza, count(*) AS n FROM holes h LEFT JOIN nn ON h.hole_id = nn.hole_id AND rn = 1 GROUP BY 1")
def _(spark, d):
    return drilling.hardness_distribution(_hard_holes(spark, d))


_KEEP = "hole_id, pit, malla, z_collar, incl, az, len, kg"


def _drill_sides(spark, d):
    h = bridge.holes(spark, d).withColumn("row_id", F.col("hole_id"))
    seq = F.pmod(F.col("x") + F.col("y") * 2, F.lit(7.0))
    design = h.selectExpr("row_id", "pit", "malla", "CASE WHEN fase <> 'F-7' THEN hole_id END AS pozo", "x", "y", "z_collar", "incl", "az", "len", "kg")
    actual = h.withColumn("s", seq).selectExpr(
        "row_id", "pit", "malla", "hole_id AS pozo", "x + s / 10 AS x", "y - s / 10 AS y", "z_collar + (s - 3) / 10 AS z_collar", "incl + s - 3 AS incl",
        "(az + s * 3 + 350) % 360 AS az", "len + (s - 3) / 5 AS len", "kg * (1 + (s - 3) / 20) AS kg")
    return design, actual


_SEQ = "((x + y * 2) % 7)"
DC_SQL = f"""{H}, dc AS (SELECT hole_id AS row_id, malla, {_SEQ} / 10 AS dx, -{_SEQ} / 10 AS dy, ({_SEQ} - 3) / 10 AS dz, {_SEQ} - 3 AS di,
    ((((az + {_SEQ} * 3 + 350) % 360 - az + 180) % 360) + 360) % 360 - 180 AS da, ({_SEQ} - 3) / 5 AS dl, abs(kg * (({_SEQ} - 3) / 20)) / greatest(kg, 1) * 100 AS dk FROM holes WHERE fase <> 'F-7'),
  dr AS (SELECT *, abs(dx) <= 0.50000001 AND abs(dy) <= 0.50000001 AND abs(dz) <= 0.30000001 AND abs(di) <= 3 AND abs(da) <= 5 AND abs(dl) <= 0.50000001 AND dk <= 10.0000001 AS every_ok FROM dc)"""


def _compliance(spark, d):
    design, actual = _drill_sides(spark, d)
    pairs = drilling.match_by_label(design, actual)
    # limits carry the same tiny slack as the check SQL: the made-up deltas sit exactly on them
    from ..config import DrillCompliance

    eased = DrillCompliance(delta_x=0.50000001, delta_y=0.50000001, delta_z_collar=0.30000001, delta_len=0.50000001, delta_kg_pct=10.0000001)
    return drilling.compliance_rows(pairs, eased, ("malla",))


@query("drill_compliance", f"WITH {DC_SQL} SELECT row_id, {r('dx', 'delta_x')}, {r('dz', 'delta_z_collar')}, {r('da', 'delta_az')}, {r('dl', 'delta_len')}, {r('dk', 'delta_kg_pct')}, every_ok AS all_within_tol FROM dr")
def _(spark, d):
    return tidy(_compliance(spark, d).select("row_id", "delta_x", "delta_z_collar", "delta_az", "delta_len", "delta_kg_pct", "all_within_tol"))


@query("drill_compliance_by_pattern", f"""WITH {DC_SQL} SELECT malla, count(*) AS n, {r('avg(every_ok::INTEGER)', 'compliance_score')}, {r('avg(abs(dx))', 'mean_abs_delta_x')},
    {r('avg(abs(da))', 'mean_abs_delta_az')}, {r('avg((abs(dl) <= 0.50000001)::INTEGER) * 100', 'within_tol_pct_delta_len')} FROM dr GROUP BY malla""")
def _(spark, d):
    s = drilling.compliance_summary(_compliance(spark, d), ("malla",))
    return tidy(s.select("malla", "n", "compliance_score", "mean_abs_delta_x", "mean_abs_delta_az", "within_tol_pct_delta_len"))


@query("drill_unmatched", f"WITH {H} SELECT 'design' AS side, hole_id AS row_id FROM holes WHERE fase = 'F-7' UNION ALL SELECT 'actual', hole_id FROM holes WHERE fase = 'F-7'")
def _(spark, d):
    design, actual = _drill_sides(spark, d)
    return drilling.unmatched(drilling.match_by_label(design, actual), design, actual)


# actual collars drift up to 0.6 m, the design lattice is 5 m wide, so the nearest design is the one at its own position
@query("drill_match_by_position", f"""WITH {H}, first AS (SELECT pit, x, y, min(hole_id) AS d_row FROM holes GROUP BY pit, x, y)
    SELECT h.hole_id AS a_row, d_row FROM holes h JOIN first f ON h.pit = f.pit AND h.x = f.x AND h.y = f.y""")
def _(spark, d):
    design, actual = _drill_sides(spark, d)
    p = drilling.match_by_position(design, actual, ["pit"])
    return p.select(F.col("a.row_id").alias("a_row"), F.col("d.row_id").alias("d_row"))


# --- hole report ----------------------------------------------------------------------------------------------------

CONFIG = GeometryConfig(True, "Inclinacion_real", "FROM_VERTICAL", "ABSOLUTE_VALUE", "DEGREES", "", "Azimuth_real", "CLOCKWISE_FROM_NORTH", "DEGREES")


def _report(spark, d):
    return hole_ops.process_holes(bridge.raw_holes(spark, d), CONFIG, bench_height=15.0, row_key="label_pozo")


_BAD = (("Latitud_Geo", "Latitud_Geo", "INVALID_X", "try_cast(Latitud_Geo AS DOUBLE) IS NULL"), ("Azimuth_real", "Azimuth_real", "INVALID_Az", "Azimuth_real IS NULL"),
        ("Len", "longitud_real", "INVALID_LEN_NON_POSITIVE", "CAST(longitud_real AS DOUBLE) <= 0"), ("Incl", "Inclinacion_real", "INCL_OUT_OF_RANGE", "CAST(Inclinacion_real AS DOUBLE) > 90"))
_ANY = " OR ".join(w for *_, w in _BAD)
_NBAD = " + ".join(f"({w})::INTEGER" for *_, w in _BAD)


@query("hole_rejections", f"WITH {bridge.RAW_SQL} " + " UNION ALL ".join(
    f"SELECT label_pozo AS hole_id, '{c}' AS source_column, {v} AS original_value, '{e}' AS error_code FROM raw WHERE {w}" for c, v, e, w in _BAD))
def _(spark, d):
    return _report(spark, d).rejections.select("hole_id", "source_column", "original_value", "error_code")


@query("accepted_holes", f"""WITH {bridge.RAW_SQL}, a AS (SELECT label_pozo AS hole_id, CAST(Latitud_Geo AS DOUBLE) AS x, CAST(Longitud_Geo AS DOUBLE) AS y, CAST(Nombre_Banco AS DOUBLE) + 15 AS z,
    CAST(Inclinacion_real AS DOUBLE) AS i, CAST(Azimuth_real AS DOUBLE) % 360 AS a, CAST(longitud_real AS DOUBLE) AS l, CAST(Kilos_Cargados_real AS DOUBLE) AS kg FROM raw WHERE NOT ({_ANY}))
    SELECT hole_id, {r('z', 'z_collar')}, {r('a', 'az')}, {r('x + l * sin(radians(i)) * sin(radians(a))', 'x_toe')}, {r('z - l * cos(radians(i))', 'z_toe')}, {r('kg / l', 'carga')}, {r('greatest(l - 4, 0)', 'descarga')} FROM a""")
def _(spark, d):
    return tidy(_report(spark, d).accepted.select("hole_id", "z_collar", "az", "x_toe", "z_toe", "carga", "descarga"))


@query("hole_report_summary", f"""WITH {bridge.RAW_SQL} SELECT count(*) AS rows_received, count(*) FILTER (NOT ({_ANY})) AS rows_accepted, count(*) FILTER ({_ANY}) AS rejected_source_rows,
    CAST(sum({_NBAD}) AS BIGINT) AS rejection_records, CAST(NULL AS VARCHAR) AS blocking_error FROM raw""")
def _(spark, d):
    return _report(spark, d).summary


@query("event_warnings", f"""WITH {bridge.RAW_SQL} SELECT 1 AS severity, 'warning' AS level, 'EXPLOSIVE_UNKNOWN' AS warning_code, count(*) AS n_holes FROM raw WHERE NOT ({_ANY}) AND Tipo_Explosivo = 'X-900'
    UNION ALL SELECT 2, 'info', 'EXPLOSIVE_UNVALIDATED_REFERENCE', count(*) FROM raw WHERE NOT ({_ANY}) AND Tipo_Explosivo = 'Pirex-930'""")
def _(spark, d):
    return hole_ops.event_warnings(pf_ops.enrich(_report(spark, d).accepted))


@query("influence_areas")
def _(spark, d):
    return tidy(influence_areas(bridge.holes(spark, d), ["pit"]).select("hole_id", "pit", "area_m2", "area_status", "collar_domain_status", "conservation_ok"), 3)


@query("influence_conservation", f"WITH {H} SELECT pit, count(*) AS n_holes, {r('(max(x) - min(x)) * (max(y) - min(y))', 'domain_area_m2')}, {r('(max(x) - min(x)) * (max(y) - min(y))', 'assigned_area_m2', 3)}, true AS conservation_ok FROM holes GROUP BY pit")
def _(spark, d):
    a = influence_areas(bridge.holes(spark, d), ["pit"])
    return tidy(a.groupBy("pit").agg(F.count(F.lit(1)).alias("n_holes"), F.first("domain_area_m2").alias("domain_area_m2"), F.sum("area_m2").alias("assigned_area_m2"),
                                     F.bool_and("conservation_ok").alias("conservation_ok")), assigned_area_m2=3)


@query("section_correlation_influence")
def _(spark, d):
    from ..operators.projection import project_holes

    h = bridge.holes(spark, d)
    pf = pf_ops.powder_factors(h, influence=influence_areas(h, ["pit"]), estimate_spacing=False)
    p = project_holes(pf, bridge.sections(spark, d), 15.0, ["pit"])
    return tidy(correlation.section_correlation(p, bridge.sections(spark, d), comparisons(spark, d)), 4)


# --- exchange format ------------------------------------------------------------------------------------------------

@query("exchange_validation", f"""WITH {exchange.DEMO_SQL} SELECT row_key, 'ERROR' AS level, 'MISSING_REQUIRED' AS code, 'mine_site' AS field FROM ex WHERE mine_site = ''
    UNION ALL SELECT row_key, 'ERROR', 'NOT_NUMERIC', 'burden' FROM ex WHERE burden = 'abc' UNION ALL SELECT row_key, 'ERROR', 'OUT_OF_RANGE', 'azimuth' FROM ex WHERE CAST(azimuth AS DOUBLE) > 360
    UNION ALL SELECT row_key, 'ERROR', 'NOT_IN_ENUM', 'explosive_type' FROM ex WHERE explosive_type = 'Dynamite' UNION ALL SELECT row_key, 'WARNING', 'BAD_TIMESTAMP', 'shot_at' FROM ex WHERE shot_at NOT LIKE '%T%'""")
def _(spark, d):
    return exchange.validate(exchange.demo_rows(spark, d), "row_key").select("row_key", "level", "code", "field")


@query("exchange_validation_summary", f"""WITH {exchange.DEMO_SQL}, v AS (SELECT (mine_site = '')::INTEGER + (burden = 'abc')::INTEGER + (CAST(azimuth AS DOUBLE) > 360)::INTEGER + (explosive_type = 'Dynamite')::INTEGER AS e,
    (shot_at NOT LIKE '%T%')::INTEGER AS w FROM ex) SELECT count(*) AS n_rows, CAST(sum(e) AS BIGINT) AS n_errors, CAST(sum(w) AS BIGINT) AS n_warnings, sum(e) = 0 AS valid FROM v""")
def _(spark, d):
    return exchange.validation_summary(exchange.demo_rows(spark, d), "row_key")


@query("exchange_conversion", f"""WITH {bridge.RAW_SQL} SELECT label_pozo AS hole_id, CAST(Latitud_Geo AS DOUBLE) AS easting, CAST(Nombre_Banco AS DOUBLE) + 15 AS elevation, 6.5::DOUBLE AS burden,
    CASE Tipo_Explosivo WHEN 'ANFO' THEN 'ANFO' WHEN 'Pirex-930' THEN 'Heavy ANFO' ELSE 'Other' END AS explosive_type, CAST(Kilos_Cargados_real AS DOUBLE) AS explosive_kg_actual,
    fecha_tronadura || 'T00:00:00' AS shot_at FROM raw WHERE NOT ({_ANY})""")
def _(spark, d):
    return exchange.from_vendor_report(_report(spark, d).accepted).select("hole_id", "easting", "elevation", "burden", "explosive_type", "explosive_kg_actual", "shot_at")


@query("explosive_categories", f"""WITH {H} SELECT product, CASE WHEN product IN ('ANFO') THEN 'ANFO' WHEN product IN ('Pirex-930', 'pirex-950 plus') THEN 'Heavy ANFO' ELSE 'Other' END AS category, count(*) AS n
    FROM holes GROUP BY ALL""")
def _(spark, d):
    from ..functions.explosives import category

    return bridge.holes(spark, d).groupBy("product", F.coalesce(category("product"), F.lit("Other")).alias("category")).agg(F.count(F.lit(1)).alias("n"))
