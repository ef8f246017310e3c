"""Registered queries on bench comparisons: matching, compliance rows, report tables, stability and alerts."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rock
from ..functions.status import is_passing, tripartite
from ..config import TOLERANCES
from ..operators import compliance as ops
from ..operators import stability
from ..operators.matching import match_benches, reconciliation_gaps
from . import bridge, reports
from .queries_blast import CORR_SQL, ROW_CREDIT, comparisons, section_table
from .registry import COMPS_SQL, comps_sql, query, r, rs, tidy

B, C = bridge.BENCHES_SQL, COMPS_SQL
ROW = ("sector, section, bench_num, type, level, height_design, height_real, height_dev, height_status, angle_design, angle_real, angle_dev, "
       "angle_status, berm_design, berm_real, berm_min, berm_status, spill_width, effective_berm, delta_crest, delta_toe, berm_score, angle_score, "
       "height_score, bench_score, section_score, section_status")
_ROW_SQL = ", ".join(f"{c} + 0 AS {c}" if c in ("height_dev", "angle_dev", "delta_crest", "delta_toe", "spill_width") else c for c in ROW.split(", "))


@query("bench_matching", f"""WITH {B}, d AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY bench_number) AS pos FROM design),
    t AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY bench_number) AS pos FROM topo)
    SELECT d.section, CAST(d.pos AS INTEGER) AS design_pos, CAST(t.pos AS INTEGER) AS topo_pos,
    {r('sqrt(1.5 * power((d.crest_elevation + d.toe_elevation - t.crest_elevation - t.toe_elevation) / 2, 2) + power((d.crest_distance + d.toe_distance - t.crest_distance - t.toe_distance) / 2, 2))', 'cost')}
    FROM d JOIN t ON d.section = t.section AND abs((d.crest_elevation + d.toe_elevation - t.crest_elevation - t.toe_elevation) / 2) < 8""")
def _(spark, d):
    return tidy(match_benches(bridge.design_benches(spark, d), bridge.topo_benches(spark, d)))


@query("comparison_rows", f"WITH {C} SELECT {_ROW_SQL} FROM comps")
def _(spark, d):
    return comparisons(spark, d).select(*ROW.split(", "))


@query("reconciliation_gaps", f"""WITH {B}, p AS (SELECT d.section, least(d.crest_distance, d.toe_distance) AS d0, greatest(d.crest_distance, d.toe_distance) AS d1,
    least(t.crest_distance, t.toe_distance) AS t0, greatest(t.crest_distance, t.toe_distance) AS t1, d.bench_height AS hd, t.bench_height AS ht,
    t.section IS NULL AS gone FROM design d LEFT JOIN topo t ON d.section = t.section AND d.bench_number = t.bench_number)
    SELECT section, {r('CASE WHEN gone THEN d0 ELSE least(d0, t0) END', 'd_start')}, {r('CASE WHEN gone THEN d1 ELSE greatest(d1, t1) END', 'd_end')},
    {r('hd', 'expected_bench_height')}, {r('coalesce(ht, 0)', 'actual_height')}, {r('coalesce(ht, 0) - hd', 'delta_h')},
    CASE WHEN gone THEN 'missing_crest' WHEN ht > hd THEN 'overbreak' ELSE 'extra_material' END AS location,
    CASE WHEN gone OR abs(ht - hd) > 3 THEN 'severe' WHEN abs(ht - hd) > 2.25 THEN 'moderate' ELSE 'minor' END AS severity
    FROM p WHERE gone OR abs(ht - hd) > 1.5""")
def _(spark, d):
    return tidy(reconciliation_gaps(bridge.design_benches(spark, d), bridge.topo_benches(spark, d)))


# --- low benches: several as-built benches within the match threshold, sections of one name in every pit --------

_LOW_KEYS = ("pit", "section")
# from the last design bench on: for each first as-built bench taken so far the best pairing, as counts, cost and partners
_ALIGNED = bridge.LOW_BENCHES_SQL + """,
    dn AS (SELECT *, (crest_elevation + toe_elevation) / 2 AS mz, (crest_distance + toe_distance) / 2 AS mx,
      row_number() OVER (PARTITION BY pit, section ORDER BY bench_number) AS pos, count(*) OVER (PARTITION BY pit, section) AS n FROM design),
    tn AS (SELECT *, (crest_elevation + toe_elevation) / 2 AS mz, (crest_distance + toe_distance) / 2 AS mx,
      row_number() OVER (PARTITION BY pit, section ORDER BY bench_number) AS pos FROM topo),
    cand AS (SELECT d.pit, d.section, d.pos AS i, t.pos AS j, sqrt(1.5 * ((d.mz - t.mz) * (d.mz - t.mz)) + (d.mx - t.mx) * (d.mx - t.mx)) AS c, abs(d.mz - t.mz) AS gap
      FROM dn d JOIN tn t ON d.pit = t.pit AND d.section = t.section WHERE abs(d.mz - t.mz) < 8),
    best(pit, section, i, j, pairs, cost, taken) AS (
      SELECT DISTINCT pit, section, n + 1, 100000::BIGINT, 0, 0.0::DOUBLE, []::BIGINT[] FROM dn
      UNION ALL
      SELECT pit, section, i, j, pairs, cost, taken FROM (
        SELECT b.pit, b.section, b.i - 1 AS i, o.j, o.pairs, o.cost, o.taken FROM best b, LATERAL (
          SELECT b.j AS j, b.pairs AS pairs, b.cost AS cost, list_prepend(100000::BIGINT, b.taken) AS taken
          UNION ALL SELECT c.j, b.pairs + 1, c.c + b.cost, list_prepend(c.j, b.taken) FROM cand c
            WHERE c.pit = b.pit AND c.section = b.section AND c.i = b.i - 1 AND c.j < b.j) o WHERE b.i > 1)
      QUALIFY row_number() OVER (PARTITION BY pit, section, j ORDER BY pairs DESC, cost, taken) = 1),
    aligned AS (SELECT pit, section, taken FROM best WHERE i = 1 QUALIFY row_number() OVER (PARTITION BY pit, section ORDER BY pairs DESC, cost, taken) = 1),
    paired AS (SELECT a.pit, a.section, a.i, a.j, c.c AS cost FROM (SELECT pit, section, unnest(range(1, len(taken) + 1)) AS i, unnest(taken) AS j FROM aligned) a
      JOIN cand c ON c.pit = a.pit AND c.section = a.section AND c.i = a.i AND c.j = a.j WHERE c.c < 8)"""
_LOW_JOIN = ("(SELECT d.*, p.j FROM dn d LEFT JOIN paired p ON p.pit = d.pit AND p.section = d.section AND p.i = d.pos) d "
             "FULL JOIN tn t ON t.pit = d.pit AND t.section = d.section AND t.pos = d.j")


def _low(spark, d):
    return bridge.low_design_benches(spark, d), bridge.low_topo_benches(spark, d)


@query("bench_matching_low", f"""WITH RECURSIVE {_ALIGNED} SELECT pit, section, CAST(i AS INTEGER) AS design_pos, CAST(j AS INTEGER) AS topo_pos, {r('cost')} FROM paired""")
def _(spark, d):
    return tidy(match_benches(*_low(spark, d), keys=_LOW_KEYS))


@query("comparison_rows_low", f"WITH RECURSIVE {comps_sql('pit, section', _ALIGNED, _LOW_JOIN)} SELECT pit, {_ROW_SQL} FROM comps")
def _(spark, d):
    return ops.compare(*_low(spark, d), keys=_LOW_KEYS).select("pit", *ROW.split(", "))


@query("worst_status_low", f"""WITH RECURSIVE {comps_sql('pit, section', _ALIGNED, _LOW_JOIN)}, w AS (SELECT pit, section, greatest({', '.join(
    "max(CASE " + p + "_status WHEN 'NO CUMPLE' THEN 3 WHEN 'FUERA DE TOLERANCIA' THEN 2 WHEN 'CUMPLE' THEN 1 ELSE 0 END)" for p in ('height', 'angle', 'berm'))}) AS k FROM comps GROUP BY pit, section)
    SELECT pit, section, CASE k WHEN 3 THEN 'NO CUMPLE' WHEN 2 THEN 'FUERA DE TOLERANCIA' WHEN 1 THEN 'CUMPLE' END AS worst_status FROM w""")
def _(spark, d):
    return ops.worst_status(ops.compare(*_low(spark, d), keys=_LOW_KEYS), _LOW_KEYS)


# design benches in order, each with the list of as-built benches claimed so far
@query("reconciliation_gaps_low", f"""WITH RECURSIVE {_ALIGNED},
    claim(pit, section, i, claimed, mine) AS (
      SELECT DISTINCT pit, section, 0::BIGINT, []::BIGINT[], NULL::BIGINT FROM dn
      UNION ALL
      SELECT k.pit, k.section, k.i + 1, CASE WHEN o.j IS NULL THEN k.claimed ELSE list_append(k.claimed, o.j) END, o.j
      FROM claim k JOIN dn d ON d.pit = k.pit AND d.section = k.section AND d.pos = k.i + 1,
        LATERAL (SELECT arg_min(c.j, c.gap * 1000000 + c.j / 1000.0) AS j FROM cand c WHERE c.pit = k.pit AND c.section = k.section AND c.i = k.i + 1 AND NOT list_contains(k.claimed, c.j)) o),
    p AS (SELECT k.pit, k.section, least(d.crest_distance, d.toe_distance, t.crest_distance, t.toe_distance) AS d0, greatest(d.crest_distance, d.toe_distance, t.crest_distance, t.toe_distance) AS d1,
      d.bench_height AS hd, t.bench_height AS ht, t.section IS NULL AS gone FROM claim k JOIN dn d ON d.pit = k.pit AND d.section = k.section AND d.pos = k.i
      LEFT JOIN tn t ON t.pit = k.pit AND t.section = k.section AND t.pos = k.mine)
    SELECT pit, section, {r('d0', 'd_start')}, {r('d1', 'd_end')}, {r('hd', 'expected_bench_height')}, {r('coalesce(ht, 0)', 'actual_height')}, {r('coalesce(ht, 0) - hd', 'delta_h')},
    CASE WHEN gone THEN 'missing_crest' WHEN ht > hd THEN 'overbreak' ELSE 'extra_material' END AS location,
    CASE WHEN gone OR abs(ht - hd) > 3 THEN 'severe' WHEN abs(ht - hd) > 2.25 THEN 'moderate' ELSE 'minor' END AS severity
    FROM p WHERE gone OR abs(ht - hd) > 1.5""")
def _(spark, d):
    return tidy(reconciliation_gaps(*_low(spark, d), keys=_LOW_KEYS))


@query("tripartite_status", f"""WITH {B} SELECT section, bench_number, CASE WHEN abs(v) <= CASE WHEN v < 0 THEN 3 ELSE 2 END THEN 'CUMPLE'
    WHEN abs(v) <= 1.5 * CASE WHEN v < 0 THEN 3 ELSE 2 END THEN 'FUERA DE TOLERANCIA' ELSE 'NO CUMPLE' END AS status FROM (SELECT *, face_angle - 70 AS v FROM topo)""")
def _(spark, d):
    return bridge.topo_benches(spark, d).select("section", "bench_number", tripartite(F.col("face_angle") - 70, TOLERANCES.inter_ramp_angle).alias("status"))


@query("passing_statuses", f"WITH {C} SELECT section, bench_num, level, berm_status IN ('CUMPLE', 'RAMPA OK') AS passing FROM comps")
def _(spark, d):
    return comparisons(spark, d).select("section", "bench_num", "level", is_passing("berm_status").alias("passing"))


_ACH = f"""count(*) AS n_total, count(*) FILTER (abs(delta_crest) <= 1) AS n_passing_crest, count(*) FILTER (abs(delta_toe) <= 1) AS n_passing_toe,
    count(*) FILTER (berm_status = 'CUMPLE') AS n_passing_berm, CAST(round_even(count(*) FILTER (abs(delta_crest) <= 1) * 100.0::DOUBLE / count(*), 0) AS INTEGER) AS crest_pct,
    CAST(round_even(count(*) FILTER (abs(delta_toe) <= 1) * 100.0::DOUBLE / count(*), 0) AS INTEGER) AS toe_pct,
    CAST(round_even(count(*) FILTER (berm_status = 'CUMPLE') * 100.0::DOUBLE / count(*), 0) AS INTEGER) AS berm_pct,
    CAST(round_even(avg({ROW_CREDIT}), 0) AS INTEGER) AS score_0_100"""


@query("achievement_score", f"WITH {C} SELECT {_ACH} FROM comps")
def _(spark, d):
    return ops.achievement_score(comparisons(spark, d))


@query("achievement_score_by_sector", f"WITH {C} SELECT sector, {_ACH} FROM comps GROUP BY sector")
def _(spark, d):
    return ops.achievement_score(comparisons(spark, d), ["sector"])


_RANK = "max(CASE {p}_status WHEN 'NO CUMPLE' THEN 3 WHEN 'FUERA DE TOLERANCIA' THEN 2 WHEN 'CUMPLE' THEN 1 ELSE 0 END)"


@query("worst_status", f"""WITH {C}, w AS (SELECT section, greatest({', '.join(_RANK.format(p=p) for p in ('height', 'angle', 'berm'))}) AS k FROM comps GROUP BY section)
    SELECT section, CASE k WHEN 3 THEN 'NO CUMPLE' WHEN 2 THEN 'FUERA DE TOLERANCIA' WHEN 1 THEN 'CUMPLE' END AS worst_status FROM w""")
def _(spark, d):
    return ops.worst_status(comparisons(spark, d))


@query("comparison_filters", f"WITH {C} SELECT section, bench_num, level, sector FROM comps WHERE sector IN ('ASIA', 'EUROPE') AND bench_num IN (1, 2, 999) AND level IN ('3985', '3970', '3986')")
def _(spark, d):
    return ops.filter_comparisons(comparisons(spark, d), sector=("ASIA", "EUROPE"), bench=(1, 2, 999), level=("3985", "3970", "3986")).select(
        "section", "bench_num", "level", "sector")


@query("bench_filters", f"WITH {B} SELECT section, bench_number, 0.0::DOUBLE AS spill_width, round_even(berm_width, 2) AS berm_width FROM topo WHERE bench_number IN (2, 4)")
def _(spark, d):
    return ops.filter_benches(bridge.topo_benches(spark, d), (2, 4), show_spill=False).select(
        "section", "bench_number", "spill_width", F.bround("berm_width", 2).alias("berm_width"))


@query("deviated_features", f"""WITH {C}, {bridge.SECTIONS_SQL}, f AS (SELECT section, bench_num, 'crest' AS feature, delta_crest AS delta, r_crest_distance AS dist FROM comps WHERE type = 'MATCH'
    UNION ALL SELECT section, bench_num, 'toe', delta_toe, r_toe_distance FROM comps WHERE type = 'MATCH')
    SELECT s.pit, f.section, bench_num, feature, round_even(delta, 3) + 0 AS delta_m, {r('dist', 'distance_m')}, {r('origin_x + sin(radians(azimuth)) * dist', 'fx')},
    {r('origin_y + cos(radians(azimuth)) * dist', 'fy')} FROM f JOIN sections s ON f.section = s.section WHERE abs(delta) > 0.5""")
def _(spark, d):
    f = ops.deviated_features(comparisons(spark, d), bridge.sections(spark, d))
    return tidy(f)


# every fourth part moves its crest and toe
_EDIT = "crest_distance + 0.5 AS crest_distance, toe_distance + 0.25 AS toe_distance, toe_elevation - 1 AS toe_elevation"


@query("edited_benches", f"""WITH {B}, e AS (SELECT section, bench_number, CASE WHEN bench_number % 4 = 1 THEN crest_distance + 0.5 ELSE crest_distance END AS cd,
    CASE WHEN bench_number % 4 = 1 THEN toe_distance + 0.25 ELSE toe_distance END AS td, CASE WHEN bench_number % 4 = 1 THEN toe_elevation - 1 ELSE toe_elevation END AS te,
    crest_elevation AS ce, bench_height AS h, face_angle AS a, berm_width AS b, bench_number % 4 = 1 AS hit FROM topo),
    w AS (SELECT *, abs(cd - lag(td) OVER (PARTITION BY section ORDER BY bench_number)) AS gap, max(hit::INTEGER) OVER (PARTITION BY section) AS touched FROM e)
    SELECT section, bench_number, {r('CASE WHEN hit THEN abs(ce - te) ELSE h END', 'bench_height')},
    {r('CASE WHEN NOT hit THEN a WHEN abs(td - cd) > 0.01 THEN abs(degrees(atan2(ce - te, abs(td - cd)))) ELSE 90 END', 'face_angle')},
    {r('CASE WHEN touched = 1 AND gap IS NOT NULL THEN gap ELSE b END', 'berm_width')} FROM w""")
def _(spark, d):
    topo = bridge.topo_benches(spark, d)
    edits = topo.where("bench_number % 4 = 1").selectExpr("section", "bench_number", *_EDIT.split(", "))
    return tidy(ops.apply_edits(topo, edits).select("section", "bench_number", "bench_height", "face_angle", "berm_width"))


# --- report tables ------------------------------------------------------------------------------------------------

def _long(where: str = "") -> str:
    return "l AS (" + " UNION ALL ".join(f"SELECT *, '{p}' AS parameter, {p}_status AS status, {p}_real AS real_value FROM comps {where}" for p in ("height", "angle", "berm")) + ")"


_OK = "count(*) FILTER (status = 'CUMPLE')"
_NOK = "count(*) FILTER (status IN ('NO CUMPLE', 'FUERA DE TOLERANCIA'))"


@query("workbook_summary", f"WITH {C}, {_long(chr(32) + 'WHERE type = ' + chr(39) + 'MATCH' + chr(39))} SELECT parameter, {_OK} AS n_ok, {_NOK} AS n_fail, count(*) AS total, {r(f'{_OK} * 100.0 / count(*)', 'pct')} FROM l GROUP BY parameter")
def _(spark, d):
    return tidy(reports.workbook_summary(comparisons(spark, d)))


@query("dashboard_compliance", f"""WITH {C}, {_long()} SELECT parameter, {_OK} AS n_ok, {_NOK} AS n_fail, {r(f'{_OK} * 100.0 / count(*)', 'pct')} FROM l GROUP BY parameter
    UNION ALL SELECT 'all', {_OK}, {_NOK}, {r(f'{_OK} * 100.0 / count(*)', 'pct')} FROM l""")
def _(spark, d):
    return tidy(reports.dashboard(comparisons(spark, d)))


_PS = lambda p: f"count(*) FILTER ({p}_status IN ('CUMPLE', 'RAMPA OK'))"


@query("sector_summary", f"""WITH {C} SELECT sector, CAST(grouping(sector) AS TINYINT) AS is_total, count(*) AS n_benches,
    {r('(' + ' + '.join(_PS(p) for p in ('height', 'angle', 'berm')) + ') * 100.0 / (count(*) * 3)', 'pct_global')},
    {', '.join(r(_PS(p) + ' * 100.0 / count(*)', f'pct_{p}') for p in ('height', 'angle', 'berm'))} FROM comps GROUP BY ROLLUP (sector)""")
def _(spark, d):
    return tidy(reports.sector_summary(comparisons(spark, d)))


@query("bench_sheet", f"""WITH {C} SELECT sector, section, bench_num, level, height_design, height_real, height_dev + 0 AS height_dev, height_status, angle_design, angle_real,
    angle_dev + 0 AS angle_dev, angle_status, berm_design, berm_real, berm_min, berm_status, delta_crest + 0 AS delta_crest, delta_toe + 0 AS delta_toe,
    round_even(r_floor_elevation, 1) AS floor_elevation, round_even(r_bench_height, 1) AS total_height, round_even(abs(r_crest_elevation - r_toe_elevation), 1) AS toe_height FROM comps""")
def _(spark, d):
    return reports.bench_sheet(comparisons(spark, d))


@query("global_kpi", f"""WITH {C}, s AS (SELECT section, avg(bench_score) AS s FROM comps WHERE type = 'MATCH' GROUP BY section)
    SELECT {r('avg(s)', 'global_score')}, count(*) FILTER (s >= 70) AS n_pass, count(*) FILTER (s < 70) AS n_fail FROM s""")
def _(spark, d):
    return tidy(reports.global_kpi(comparisons(spark, d)))


@query("parameter_breakdown", f"""WITH {C}, {_long()} SELECT parameter, count(*) AS total, {_OK} AS n_ok, count(*) - {_OK} AS n_fail, {r(f'{_OK} * 100.0 / count(*)', 'pct')},
    {r('coalesce(avg(real_value), 0)', 'avg_real')} FROM l WHERE status <> '-' GROUP BY parameter""")
def _(spark, d):
    return tidy(reports.parameter_breakdown(comparisons(spark, d)))


@query("sector_compliance", f"""WITH {C}, {_long()} SELECT sector, {_OK} AS n_ok, count(*) - {_OK} AS n_fail, count(*) AS total, round_even({_OK} * 100.0::DOUBLE / count(*), 1) AS pct
    FROM l WHERE status <> '-' GROUP BY sector""")
def _(spark, d):
    return reports.sector_compliance(comparisons(spark, d))


def _histogram(name: str, column: str, positive: bool = False):
    test = f"{column} > 0" if positive else f"{column} IS NOT NULL"

    @query(name, f"""WITH {C}, e AS (SELECT min({column}) AS lo, max({column}) AS hi FROM comps WHERE {test}),
        b AS (SELECT CAST(least(floor(({column} - lo) / (hi - lo) * 15), 14) AS INTEGER) AS bin, lo, hi FROM comps, e WHERE {test})
        SELECT bin, count(*) AS n, {r('any_value(lo) + bin * (any_value(hi) - any_value(lo)) / 15', 'bin_start')} FROM b GROUP BY bin""")
    def _(spark, d):
        return tidy(reports.deviation_histogram(comparisons(spark, d), column, positive_only=positive))


_histogram("height_deviation_histogram", "height_dev")
_histogram("angle_deviation_histogram", "angle_dev")
_histogram("berm_width_histogram", "berm_real", True)


@query("global_score", f"WITH {C} SELECT section_score AS score, section_status AS status FROM comps WHERE type = 'MATCH' ORDER BY section, CAST(level AS DOUBLE) DESC, bench_num LIMIT 1")
def _(spark, d):
    return reports.global_score(comparisons(spark, d))


@query("depth_metrics", f"""WITH {C} SELECT {r('min(r_floor_elevation)', 'cota_piso')}, {r('max(r_crest_elevation)', 'cota_cresta')},
    {r('max(r_crest_elevation) - min(r_floor_elevation)', 'profundidad')}, count(r_floor_elevation) AS n_floors, count(r_crest_elevation) AS n_crests FROM comps""")
def _(spark, d):
    return tidy(reports.depth_metrics(comparisons(spark, d)))


@query("top_height_deviations", f"""WITH {C} SELECT section, bench_num, level, height_design, height_real, {r('height_real - height_design', 'delta')},
    {r('abs(height_real - height_design)', 'abs_delta')}, height_status FROM comps WHERE height_design IS NOT NULL AND height_real IS NOT NULL
    ORDER BY round(abs(height_real - height_design), 6) DESC, section, bench_num LIMIT 5""")
def _(spark, d):
    return tidy(reports.top_height_deviations(comparisons(spark, d)))


@query("compliance_breakdown", f"""WITH {C}, {_long(chr(32) + 'WHERE type = ' + chr(39) + 'MATCH' + chr(39))} SELECT parameter, {_OK} AS n_ok, {_NOK} AS n_fail, {_OK} + {_NOK} AS total,
    {r(f'{_OK} * 100.0 / ({_OK} + {_NOK})', 'pct')}, {r('avg(real_value)', 'avg_real')} FROM l GROUP BY parameter""")
def _(spark, d):
    return tidy(reports.compliance_breakdown(comparisons(spark, d)))


_FAILS = " + ".join(f"count(*) FILTER ({p}_status IN ('NO CUMPLE', 'FUERA DE TOLERANCIA'))" for p in ("height", "angle", "berm"))


@query("verdict", f"""WITH {C}, a AS (SELECT count(*) AS n_total, count(*) FILTER (type = 'MATCH') AS n_match, avg(bench_score) AS s, {_FAILS} AS n_fails FROM comps)
    SELECT n_total, n_match, {r('s', 'avg_score')}, n_fails, CASE WHEN n_match * 100.0 / n_total >= 90 AND s >= 70 AND n_fails = 0 THEN 'BUENA'
    WHEN n_match * 100.0 / n_total >= 70 AND s >= 50 THEN 'REGULAR' ELSE 'MALA' END AS verdict FROM a""")
def _(spark, d):
    return tidy(reports.verdict(comparisons(spark, d)))


_TAG = "CASE type WHEN 'EXTRA' THEN 'EXTRA (sin diseño)' WHEN 'MISSING' THEN 'FALTA (cota ' || level || ')' ELSE CAST(bench_num AS VARCHAR) END"


@query("floor_extensions", f"""WITH {C} SELECT section, {_TAG} AS bench, {r('r_toe_elevation', 'toe_elevation')}, {r('r_floor_elevation', 'floor_elevation')}, {r('r_toe_elevation - r_floor_elevation', 'extension_m')}
    FROM comps WHERE r_floor_elevation > 0 AND r_floor_elevation < r_toe_elevation""")
def _(spark, d):
    return tidy(reports.floor_extensions(comparisons(spark, d)))


@query("top_signed_deltas", f"""WITH {C} SELECT section, {_TAG} AS bench, height_design, height_real, coalesce(height_dev, 0) + 0 AS height_dev, coalesce(angle_dev, 0) + 0 AS angle_dev,
    delta_crest + 0 AS delta_crest, delta_toe + 0 AS delta_toe FROM comps ORDER BY abs(coalesce(height_dev, 0)) DESC, section, bench LIMIT 5""")
def _(spark, d):
    return reports.top_signed_deltas(comparisons(spark, d))


_N = "count(*)"
_FSR = "(tan(radians(35)) / tan(radians(max(r_face_angle))))"
HEALTH_SQL = f"""hl0 AS (SELECT section, CASE WHEN max(r_face_angle) >= 90 THEN 0 WHEN {_FSR} >= 2 THEN 100 WHEN {_FSR} >= 1 THEN 50 + 50 * ({_FSR} - 1) ELSE 50 * {_FSR} END AS fs,
    greatest(0, least(100, avg(r_catch_bench_ratio) * 100)) AS berm, greatest(0, least(100, 100 - 100 * avg(r_overhang_m) / 1.5)) AS overhang,
    100.0 * (1 - count(*) FILTER (r_wedge_risk) / {_N}) AS wedge, 100.0 * (1 - count(*) FILTER (r_toppling_risk) / {_N}) AS toppling,
    greatest(0, least(100, 100 - 100 * CASE WHEN count(*) FILTER (NOT r_is_ramp) >= 2 THEN stddev_pop(CASE WHEN NOT r_is_ramp THEN r_face_angle END) ELSE 0 END / 30)) AS anisotropy,
    count(*) FILTER (r_overhang_m >= 1.5) AS n_critical FROM comps WHERE r_bench_number IS NOT NULL GROUP BY section),
  hl AS (SELECT *, greatest(0, least(100, 0.3 * fs + 0.2 * berm + 0.2 * overhang + 0.15 * wedge + 0.1 * toppling + 0.05 * anisotropy)) AS score FROM hl0)"""
_CLASS = "CASE WHEN score >= 90 THEN 'GREEN' WHEN score >= 75 THEN 'YELLOW' WHEN score >= 50 THEN 'ORANGE' ELSE 'RED' END"


@query("section_health", f"WITH {C}, {HEALTH_SQL} SELECT section, {rs('fs, berm, overhang, wedge, toppling, anisotropy')}, n_critical, {r('score', 'health_score')}, {_CLASS} AS health_category FROM hl")
def _(spark, d):
    return tidy(stability.section_health(bridge.topo_benches(spark, d)).drop("recommended_action"))


@query("stability_table", f"""WITH {C}, {HEALTH_SQL} SELECT section, '(sección)' AS bench, 'Health Score' AS metric, {r('score', 'value')}, {_CLASS} AS severity FROM hl
    UNION ALL SELECT section, '(críticos)', 'Bancos críticos (overhang)', n_critical, 'CRITICAL' FROM hl WHERE n_critical > 0
    UNION ALL SELECT section, CAST(r_bench_number AS VARCHAR), 'Overhang', round(r_overhang_m, 6), CASE WHEN r_overhang_m >= 1.5 THEN 'CRITICAL' ELSE 'WARNING' END FROM comps WHERE r_overhang_m >= 0.5
    UNION ALL SELECT section, CAST(r_bench_number AS VARCHAR), 'Wedge risk', NULL, 'WARNING' FROM comps WHERE r_wedge_risk
    UNION ALL SELECT section, CAST(r_bench_number AS VARCHAR), 'Toppling risk', NULL, 'WARNING' FROM comps WHERE r_toppling_risk
    UNION ALL SELECT section, CAST(r_bench_number AS VARCHAR), 'Ángulo de cara inconsistente', NULL, 'WARNING' FROM comps WHERE r_face_angle_inconsistent
    UNION ALL SELECT section, CAST(r_bench_number AS VARCHAR), 'Catch bench', round(r_catch_bench_ratio, 6), 'WARNING' FROM comps WHERE NOT r_catch_bench_adequate AND r_catch_bench_ratio > 0""")
def _(spark, d):
    return tidy(reports.stability_table(comparisons(spark, d)).drop("action"))


@query("safety_flags", f"""WITH {C}, f AS (SELECT section, {_TAG} AS bench, 0 AS rank, 'Overhang' AS flag, r_overhang_m AS value, 'CRITICAL' AS severity FROM comps WHERE r_overhang_m >= 1.5
    UNION ALL SELECT section, {_TAG}, 1, 'Overhang', r_overhang_m, 'WARNING' FROM comps WHERE r_overhang_m >= 0.5 AND r_overhang_m < 1.5
    UNION ALL SELECT section, {_TAG}, 1, 'Wedge', NULL, 'WARNING' FROM comps WHERE r_wedge_risk UNION ALL SELECT section, {_TAG}, 1, 'Toppling', NULL, 'WARNING' FROM comps WHERE r_toppling_risk
    UNION ALL SELECT section, {_TAG}, 1, 'Ángulo inconsistente', NULL, 'WARNING' FROM comps WHERE r_face_angle_inconsistent
    UNION ALL SELECT section, {_TAG}, 1, 'Cara muy steep', r_face_angle, 'WARNING' FROM comps WHERE r_face_angle >= 80 AND r_overhang_m < 0.5 AND NOT r_wedge_risk AND NOT r_toppling_risk)
    SELECT section, bench, rank, flag, {r('value')}, severity FROM f""")
def _(spark, d):
    return tidy(reports.safety_flags(comparisons(spark, d)))


_SIG = " UNION ALL ".join(
    f"SELECT section, {_TAG} AS bench, {k} AS rank, '{s}' AS signal, CAST({v} AS DOUBLE) AS value FROM comps WHERE {w}" for k, s, v, w in (
        (0, "OVERHANG_CRITICAL", "r_overhang_m", "r_overhang_m >= 1.5"), (2, "OVERHANG_WARNING", "r_overhang_m", "r_overhang_m >= 0.5 AND r_overhang_m < 1.5"),
        (2, "WEDGE", "NULL", "r_wedge_risk"), (2, "TOPPLING", "NULL", "r_toppling_risk"), (1, "BERM_NO_CUMPLE", "NULL", "berm_status = 'NO CUMPLE'"),
        (1, "ANGLE_NO_CUMPLE", "NULL", "angle_status = 'NO CUMPLE'"), (1, "HEIGHT_NO_CUMPLE", "NULL", "height_status = 'NO CUMPLE'"),
        (2, "DELTA_CREST", "delta_crest", "abs(delta_crest) > 0.3"), (2, "DELTA_TOE", "delta_toe", "abs(delta_toe) > 0.3"),
        (2, "SPILL", "spill_width", "spill_width > 0.5"), (2, "EFFECTIVE_BERM", "effective_berm", "berm_min > effective_berm")))


@query("action_signals", f"WITH {C}, s AS ({_SIG}) SELECT section, bench, rank, signal, {r('value')} FROM s")
def _(spark, d):
    return tidy(reports.action_signals(comparisons(spark, d)))


@query("action_list", f"WITH {C}, s AS ({_SIG}) SELECT section, bench, rank, signal, {r('value')} FROM s ORDER BY rank, section, bench, signal LIMIT 10")
def _(spark, d):
    return tidy(reports.action_list(comparisons(spark, d)))


@query("sorted_comparisons", f"WITH {C} SELECT section, bench_num, level, type FROM comps ORDER BY CAST(level AS DOUBLE) DESC, section")
def _(spark, d):
    return reports.sorted_table(comparisons(spark, d)).select("section", "bench_num", "level", "type")


@query("filter_values", f"""WITH {C} SELECT DISTINCT 'sector' AS field, sector AS value FROM comps UNION ALL SELECT DISTINCT 'level', level FROM comps
    UNION ALL SELECT DISTINCT 'section', section FROM comps UNION ALL SELECT DISTINCT 'bench_num', CAST(bench_num AS VARCHAR) FROM comps""")
def _(spark, d):
    return reports.filter_values(comparisons(spark, d))


@query("unified_bench_table", f"""WITH {CORR_SQL} SELECT c.section, bench_num AS banco_num, level AS nivel, type AS tipo, bench_score, section_score, height_status AS estado_altura,
    round_even(r_crest_elevation, 1) AS cota_crest_real, round_even(r_berm_width, 2) AS berm_width_real, r_is_ramp AS is_ramp, 1.5::DOUBLE AS tol_altura_pos, 6.0::DOUBLE AS berma_minima,
    num_wells AS n_pozos, nullif(round_even(total_kg, 0), 0) AS kg_total, nullif(round_even(pf_vol_avg_kgm3, 3), 0) AS pf_vol_kgm3
    FROM comps c LEFT JOIN corr k ON c.section = k.section""")
def _(spark, d):
    t = reports.unified_table(comparisons(spark, d), section_table(spark, d))
    return t.select("section", "banco_num", "nivel", "tipo", "bench_score", "section_score", "estado_altura", "cota_crest_real", "berm_width_real", "is_ramp",
                    "tol_altura_pos", "berma_minima", "n_pozos", "kg_total", "pf_vol_kgm3")


@query("blast_sheet", f"""WITH {bridge.HOLES_SQL} SELECT hole_id, {rs('x_toe, y_toe, z_toe')}, {r('(z_collar - bench_height_m) - z_toe', 'pasadura_m')}, {r('kg', digits=9)} FROM holes""")
def _(spark, d):
    return tidy(reports.hole_sheet(bridge.holes(spark, d)).select("hole_id", "x_toe", "y_toe", "z_toe", "pasadura_m", "kg"), kg=9)


# --- stability ------------------------------------------------------------------------------------------------------

@query("bench_stability", f"WITH {B} SELECT section, bench_number, CASE WHEN overhang_m >= 1.5 THEN 'CRITICAL' WHEN overhang_m >= 0.5 THEN 'WARNING' ELSE 'OK' END AS overhang_severity FROM topo")
def _(spark, d):
    return stability.assess(bridge.topo_benches(spark, d)).select("section", "bench_number", "overhang_severity")


@query("section_stability", f"""WITH {B} SELECT section, count(*) AS n_benches_total, count(*) FILTER (overhang_m >= 0.5 AND overhang_m < 1.5) AS n_overhangs_warning,
    count(*) FILTER (overhang_m >= 1.5) AS n_overhangs_critical, count(*) FILTER (catch_bench_adequate) AS n_catch_bench_adequate, count(*) FILTER (wedge_risk) AS n_wedge_risk,
    count(*) FILTER (toppling_risk) AS n_toppling_risk, count(*) FILTER (face_angle_inconsistent) AS n_face_angle_inconsistent,
    {r('CASE WHEN count(*) FILTER (NOT is_ramp) >= 2 THEN stddev_pop(CASE WHEN NOT is_ramp THEN face_angle END) ELSE 0 END', 'anisotropy_dispersion_deg')},
    coalesce(string_agg(CASE WHEN overhang_m >= 1.5 THEN CAST(bench_number AS VARCHAR) END, ',' ORDER BY bench_number), '') AS critical_benches FROM topo GROUP BY section""")
def _(spark, d):
    s = stability.section_stability(bridge.topo_benches(spark, d))
    return tidy(s.withColumn("critical_benches", F.array_join("critical_bench_numbers", ",")).drop("critical_bench_numbers"))


@query("safety_proxy", f"WITH {B} SELECT section, bench_number, {r('CASE WHEN face_angle >= 90 THEN 0 ELSE tan(radians(35)) / tan(radians(face_angle)) END', 'fs')} FROM topo")
def _(spark, d):
    return tidy(bridge.topo_benches(spark, d).select("section", "bench_number", rock.safety_proxy("face_angle").alias("fs")))


@query("planar_safety", f"""WITH {B} SELECT section, bench_number, {r('150 / (27 * bench_height * sin(radians(face_angle)) * cos(radians(face_angle))) + tan(radians(38)) / tan(radians(face_angle)) * 0.8', 'fs')} FROM topo""")
def _(spark, d):
    return tidy(bridge.topo_benches(spark, d).select("section", "bench_number", rock.planar_safety(
        "face_angle", "bench_height", F.lit(150.0), F.lit(38.0), 0.2).alias("fs")))


@query("bench_alerts", f"""WITH {B} SELECT section, bench_number, 'RED' AS level, 'OVERHANG_CRITICAL' AS code, round(overhang_m, 6) + 0 AS metric_value FROM topo WHERE overhang_m >= 1.5
    UNION ALL SELECT section, bench_number, 'YELLOW', 'OVERHANG_WARNING', round(overhang_m, 6) FROM topo WHERE overhang_m >= 0.5 AND overhang_m < 1.5
    UNION ALL SELECT section, bench_number, 'ORANGE', 'CATCH_BENCH_INADEQUATE', round(catch_bench_ratio, 6) FROM topo WHERE NOT catch_bench_adequate
    UNION ALL SELECT section, bench_number, 'ORANGE', 'TOPPLING_RISK', round(face_angle, 6) FROM topo WHERE toppling_risk
    UNION ALL SELECT section, bench_number, 'YELLOW', 'WEDGE_RISK', 0 FROM topo WHERE wedge_risk
    UNION ALL SELECT section, bench_number, 'YELLOW', 'ANGLE_INCONSISTENT', round(face_angle, 6) FROM topo WHERE face_angle_inconsistent""")
def _(spark, d):
    return tidy(stability.bench_alerts(bridge.topo_benches(spark, d)).drop("action"))


_LEVEL = ("max(greatest(CASE WHEN overhang_m >= 1.5 THEN 3 WHEN overhang_m >= 0.5 THEN 1 ELSE 0 END, CASE WHEN NOT catch_bench_adequate OR toppling_risk THEN 2 ELSE 0 END, "
          "CASE WHEN wedge_risk OR face_angle_inconsistent THEN 1 ELSE 0 END))")


@query("section_alert_level", f"""WITH {B} SELECT section, CASE {_LEVEL} WHEN 3 THEN 'RED' WHEN 2 THEN 'ORANGE' WHEN 1 THEN 'YELLOW' ELSE 'GREEN' END AS overall_level,
    CAST(sum((overhang_m >= 0.5)::INTEGER + (NOT catch_bench_adequate)::INTEGER + toppling_risk::INTEGER + wedge_risk::INTEGER + face_angle_inconsistent::INTEGER) AS BIGINT) AS n_alerts
    FROM topo GROUP BY section""")
def _(spark, d):
    t = bridge.topo_benches(spark, d)
    return stability.section_alert_level(t, stability.bench_alerts(t))


# --- rock mass ------------------------------------------------------------------------------------------------------

@query("gsi_from_rmr", f"WITH {bridge.ROCK_SQL} SELECT rock_id, {r('greatest(0, least(100, rmr - 5))', 'gsi')} FROM rock")
def _(spark, d):
    return tidy(bridge.rock_mass(spark, d).select("rock_id", rock.gsi_from_rmr("rmr").alias("gsi")))


_XS = rock.CONFINEMENT
_Y = [f"({x} + sqrt(exp((g - 100) / 28) * 25 * {x} + exp((g - 100) / 9)))" for x in _XS]
_SX, _SXX = sum(_XS), sum(x * x for x in _XS)
_SLOPE = f"((9 * ({' + '.join(f'{y} * {x}' for x, y in zip(_XS, _Y))}) - {_SX}::DOUBLE * ({' + '.join(_Y)})) / {9 * _SXX - _SX ** 2}::DOUBLE)"


@query("rock_strength", f"""WITH {bridge.ROCK_SQL}, s AS (SELECT *, CAST(greatest(0, least(100, rmr - 5)) AS DOUBLE) AS g FROM rock WHERE ucs_mpa IS NOT NULL), f AS (SELECT *, {_SLOPE} AS m,
    ({' + '.join(_Y)}) AS sy FROM s) SELECT rock_id, {r(f'greatest(0, (sy - m * {_SX}::DOUBLE) / 9 * ucs_mpa * 1000)', 'cohesion_kpa', 4)},
    {r('degrees(least(radians(60), greatest(radians(15), CASE WHEN m > 0 THEN atan(m) ELSE radians(30) END)))', 'friction_deg')} FROM f""")
def _(spark, d):
    c, phi = rock.strength_from_gsi(rock.gsi_from_rmr("rmr"), "ucs_mpa")
    return tidy(bridge.rock_mass(spark, d).where("ucs_mpa IS NOT NULL").select("rock_id", c.alias("cohesion_kpa"), phi.alias("friction_deg")), cohesion_kpa=4)


@query("rock_mass_lookup", f"""WITH {C}, {bridge.ROCK_SQL}, q AS (SELECT section, bench_num, level, sector, CAST(level AS DOUBLE) AS lv FROM comps),
    m AS (SELECT q.section, q.bench_num, q.level, rock.rock_id, rock.rmr, row_number() OVER (PARTITION BY q.section, q.bench_num, q.level ORDER BY abs(rock.level - lv), rock.rock_id) AS rn
      FROM q JOIN rock ON q.sector = rock.sector AND abs(rock.level - lv) <= 5)
    SELECT q.section, q.bench_num, q.level AS level_text, rock_id, {r('rmr', 'rock_rmr')} FROM q LEFT JOIN m ON q.section = m.section AND q.bench_num = m.bench_num AND q.level = m.level AND rn = 1""")
def _(spark, d):
    q = comparisons(spark, d).select("section", "bench_num", F.col("level").alias("level_text"), "sector", F.col("level").cast("double").alias("level"))
    return tidy(stability.rock_mass_lookup(q, bridge.rock_mass(spark, d)).select("section", "bench_num", "level_text", "rock_id", "rock_rmr"))


_T = "tan(radians({d}))"
_FS = f"(a * {_T} + (a + b) / {_T})"
_HALF = "greatest(5, least(89, {f}(turn * 2) / 2))::DOUBLE"


@query("suggested_face_angles", f"""WITH {bridge.ROCK_SQL}, s AS (SELECT rock_id, sector, rmr, 10.0::DOUBLE + rock_id % 11 AS height_m, CAST(greatest(0, least(100, rmr - 5)) AS DOUBLE) AS g FROM rock),
    f AS (SELECT *, {_SLOPE} AS m, ({' + '.join(_Y)}) AS sy FROM s),
    k AS (SELECT *, CASE WHEN g > 0 THEN greatest(0, (sy - m * {_SX}::DOUBLE) / 9 * 100 * 1000) * 0.001 ELSE 0 END / (27.0 * height_m) AS a,
      tan(CASE WHEN g > 0 THEN greatest(radians(15), least(radians(60), CASE WHEN m > 0 THEN atan(m) ELSE radians(30) END)) ELSE radians(30) END) AS b FROM f),
    t AS (SELECT *, CASE WHEN a > 0 THEN degrees(atan(sqrt((a + b) / a))) ELSE 90 END AS turn FROM k),
    l AS (SELECT *, CASE WHEN {_FS.format(d=_HALF.format(f='floor'))} <= {_FS.format(d=_HALF.format(f='ceil'))} THEN {_HALF.format(f='floor')} ELSE {_HALF.format(f='ceil')} END AS low FROM t)
    SELECT rock_id, sector, rmr, height_m, {r(f"CASE WHEN {_FS.format(d='5.0::DOUBLE')} < 1.3 THEN 30 WHEN {_FS.format(d='low')} >= 1.3 THEN low ELSE degrees(atan(2 * (a + b) / (1.3 + sqrt(greatest(1.69 - 4 * a * (a + b), 0))))) END", 'suggested_angle_deg')} FROM l""")
def _(spark, d):
    rows = bridge.rock_mass(spark, d).select("rock_id", "sector", "rmr", (F.lit(10.0) + F.col("rock_id") % 11).alias("height_m"))
    return tidy(stability.suggest_face_angle(rows))
