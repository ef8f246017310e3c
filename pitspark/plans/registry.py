"""Registry of named queries and the SQL used to check them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bridge

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Comparison rows in SQL. The bridge spaces levels 15 m apart, so the only unblocked pairs share a bench number.
_ST = ("CASE WHEN {d} IS NULL THEN NULL WHEN abs({d}) <= CASE WHEN {d} < 0 THEN {n} ELSE {p} END THEN 'CUMPLE' "
       "WHEN abs({d}) <= 1.5 * CASE WHEN {d} < 0 THEN {n} ELSE {p} END THEN 'FUERA DE TOLERANCIA' ELSE 'NO CUMPLE' END")
_KIND = "CASE WHEN d.section IS NULL THEN 'EXTRA' WHEN t.section IS NULL THEN 'MISSING' ELSE 'MATCH' END"


def _pick(match: str, missing: str, extra: str) -> str:
    return f"CASE WHEN d.section IS NULL THEN {extra} WHEN t.section IS NULL THEN {missing} ELSE {match} END"


def comps_sql(keys: str = "section", benches: str = bridge.BENCHES_SQL,
              joined: str = "design d FULL JOIN topo t ON d.section = t.section AND d.bench_number = t.bench_number") -> str:
    """The table ``comps`` of comparison rows; ``joined`` is the full join of the paired benches ``d`` and ``t``."""
    key_list = ", ".join(f"coalesce(d.{k}, t.{k}) AS {k}" for k in keys.split(", "))
    return benches + f""", comps0 AS (
SELECT coalesce(d.sector, t.sector) AS sector, {key_list},
  CASE WHEN d.section IS NULL THEN 999 ELSE d.bench_number END AS bench_num, {_KIND} AS type,
  CAST(CAST(round_even(coalesce(d.toe_elevation, t.toe_elevation), 0) AS INTEGER) AS VARCHAR) AS level,
  round_even(d.bench_height, 2) AS height_design, round_even(t.bench_height, 2) AS height_real,
  round_even(t.bench_height - d.bench_height, 2) AS height_dev,
  {_pick(_ST.format(d='(t.bench_height - d.bench_height)', n=1.0, p=1.5), "'NO CONSTRUIDO'", "'EXTRA'")} AS height_status,
  round_even(d.face_angle, 1) AS angle_design, round_even(t.face_angle, 1) AS angle_real,
  round_even(t.face_angle - d.face_angle, 1) AS angle_dev,
  {_pick(_ST.format(d='(t.face_angle - d.face_angle)', n=5.0, p=5.0), "'-'", "'-'")} AS angle_status,
  round_even(d.berm_width, 2) AS berm_design, round_even(t.berm_width, 2) AS berm_real,
  CASE WHEN d.section IS NOT NULL AND t.section IS NOT NULL THEN 6.0::DOUBLE END AS berm_min,
  {_pick("CASE WHEN round_even(t.berm_width, 2) >= 6 THEN 'CUMPLE' ELSE 'NO CUMPLE' END", "'FALTA BANCO'", "'BANCO ADICIONAL'")} AS berm_status,
  round_even(t.spill_width, 2) AS spill_width, round_even(t.effective_berm_width, 2) AS effective_berm,
  round_even((t.crest_distance - d.crest_distance) * CASE WHEN d.crest_distance >= d.toe_distance THEN 1 ELSE -1 END, 2) AS delta_crest,
  round_even((t.toe_distance - d.toe_distance) * CASE WHEN d.crest_distance >= d.toe_distance THEN 1 ELSE -1 END, 2) AS delta_toe,
  t.bench_number AS r_bench_number, t.crest_elevation AS r_crest_elevation, t.toe_elevation AS r_toe_elevation,
  t.crest_distance AS r_crest_distance, t.toe_distance AS r_toe_distance, t.bench_height AS r_bench_height,
  t.face_angle AS r_face_angle, t.berm_width AS r_berm_width, t.effective_berm_width AS r_effective_berm_width,
  t.floor_elevation AS r_floor_elevation, t.overhang_m AS r_overhang_m, t.wedge_risk AS r_wedge_risk,
  t.toppling_risk AS r_toppling_risk, t.face_angle_inconsistent AS r_face_angle_inconsistent,
  t.catch_bench_adequate AS r_catch_bench_adequate, t.catch_bench_ratio AS r_catch_bench_ratio, t.is_ramp AS r_is_ramp,
  CASE WHEN d.section IS NOT NULL AND t.section IS NOT NULL AND round_even(t.berm_width, 2) >= 6 THEN 60 ELSE 0 END AS berm_score,
  CASE WHEN d.section IS NOT NULL AND t.section IS NOT NULL AND abs(t.face_angle - d.face_angle) <= 5 THEN 10 ELSE 0 END AS angle_score,
  CASE WHEN d.section IS NOT NULL AND t.section IS NOT NULL AND abs(t.bench_height - d.bench_height) <= CASE WHEN t.bench_height < d.bench_height THEN 1.0 ELSE 1.5 END THEN 30 ELSE 0 END AS height_score
FROM {joined}),
comps1 AS (SELECT *, berm_score + angle_score + height_score AS bench_score FROM comps0),
comps AS (SELECT *, coalesce(round_even(avg(CASE WHEN type = 'MATCH' THEN bench_score END) OVER (PARTITION BY {keys}), 1), 0) AS section_score,
  CASE WHEN coalesce(round_even(avg(CASE WHEN type = 'MATCH' THEN bench_score END) OVER (PARTITION BY {keys}), 1), 0) >= 70 THEN 'CUMPLE' ELSE 'NO CUMPLE' END AS section_status
  FROM comps1)"""


COMPS_SQL = comps_sql()

ENERGY_SQL = ("CASE product WHEN 'ANFO' THEN 3.72::DOUBLE WHEN 'Heavy ANFO' THEN 3.4::DOUBLE WHEN 'Pirex-930' THEN 3.05::DOUBLE "
              "WHEN 'pirex-950 plus' THEN 3.15::DOUBLE WHEN 'Emuline 8000' THEN 3.05::DOUBLE END")
DENSITY_SQL = ("CASE product WHEN 'ANFO' THEN 0.8::DOUBLE WHEN 'Heavy ANFO' THEN 1.05::DOUBLE WHEN 'Pirex-930' THEN 1.2::DOUBLE "
               "WHEN 'pirex-950 plus' THEN 1.23::DOUBLE WHEN 'Emuline 8000' THEN 1.15::DOUBLE END")
_HR = "(len * cos(radians(incl)))"
_SUB = "((z_collar - bench_height_m) - z_toe)"
_HN = f"({_HR} - CASE WHEN {_SUB} >= 0 THEN {_SUB} ELSE 0 END)"
PF_SQL = bridge.HOLES_SQL + f""", pf AS (SELECT *, {_HR} AS height_real_m, CASE WHEN {_HN} > 0 THEN {_HN} END AS height_net_m,
  CASE WHEN burden * spacing * bench_height_m > 0 THEN kg / (burden * spacing * bench_height_m) END AS pf_vol_kgm3,
  CASE WHEN burden * spacing > 0 THEN kg / (burden * spacing) END AS pf_area_kgm2,
  CASE WHEN burden * spacing * {_HR} * 2.7 > 0 THEN kg * 1000 / (burden * spacing * {_HR} * 2.7) END AS pf_g_per_ton,
  CASE WHEN {_HN} > 0 AND burden * spacing > 0 THEN kg * 1000 / (burden * spacing * {_HN} * 2.7) END AS pf_g_per_ton_net,
  kg * {ENERGY_SQL} AS energy_mj FROM holes)"""


def projected_sql(tolerance: float) -> str:
    """Holes on sections; needs the ``pf`` and ``sections`` tables."""
    dx, dy = "sin(radians(azimuth))", "cos(radians(azimuth))"
    return f"""proj0 AS (SELECT p.*, s.section, s.sector, s.origin_x, s.origin_y, s.azimuth, s.length, s.survey_date,
  (x - origin_x) * {dx} + (y - origin_y) * {dy} AS dist_along,
  (x_toe - origin_x) * {dx} + (y_toe - origin_y) * {dy} AS dist_along_toe,
  abs((x - origin_x) * {dy} + (y - origin_y) * -{dx}) AS dist_perp,
  abs((x_toe - origin_x) * {dy} + (y_toe - origin_y) * -{dx}) AS dist_perp_toe
  FROM pf p JOIN sections s ON p.pit = s.pit),
proj AS (SELECT *, CASE WHEN dist_perp <= dist_perp_toe THEN 'collar' ELSE 'toe' END AS closest_point FROM proj0
  WHERE (dist_perp <= {tolerance} + 0.000001 OR dist_perp_toe <= {tolerance} + 0.000001 OR (dist_perp + dist_perp_toe) / 2 <= {tolerance} + 0.000001)
  AND dist_along BETWEEN -length / 2 AND length / 2)"""


def query(name: str, sql: str | None = None):
    """Register a query, with its check SQL where plain SQL can express it."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = " ".join(sql.split())
        return fn

    return register


def tidy(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double so that summation order cannot show."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        out.append(F.round(c, special.get(name, digits)).alias(name) if kind == "double" else c)
    return df.select(*out)


def r(expression: str, name: str | None = None, digits: int = 6) -> str:
    """Rounded SQL output column; adding zero turns -0.0 into 0.0."""
    return f"round(CAST({expression} AS DOUBLE), {digits}) + 0 AS {name or expression}"


def rs(names: str, digits: int = 6) -> str:
    return ", ".join(r(n.strip(), digits=digits) for n in names.split(","))



