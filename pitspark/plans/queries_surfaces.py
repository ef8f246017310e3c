"""Registered queries on surfaces and profiles."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import deviations, profiles, surfaces
from ..operators.compliance import compare
from ..session import cut_lineage
from . import bridge, correlation
from .queries_blast import comparisons, projected
from .registry import query, r, tidy

T = bridge.SURFACE_SQL


def _tri(spark, d):
    return bridge.surface_triangles(spark, d)


def _profiles(spark, d, packed=False):
    return surfaces.profiles(_tri(spark, d), bridge.surface_sections(spark, d), packed=packed)


@query("surface_bounds", f"""WITH {T} SELECT surface_id, kind, {r('min(least(x0, x1, x2))', 'xmin')}, {r('max(greatest(x0, x1, x2))', 'xmax')}, {r('min(least(z0, z1, z2))', 'zmin')},
    {r('max(greatest(z0, z1, z2))', 'zmax')}, count(*) AS n_faces FROM tri GROUP BY surface_id, kind""")
def _(spark, d):
    return tidy(surfaces.bounds(_tri(spark, d)).select("surface_id", "kind", "xmin", "xmax", "zmin", "zmax", "n_faces"))


_S = lambda n: f"((x{n} - origin_x) * cos(radians(azimuth)) - (y{n} - origin_y) * sin(radians(azimuth)))"


def _cross(i: int, j: int) -> str:
    t = f"(s{i} / (s{i} - s{j}))"
    return (f"SELECT surface_id, kind, section, sector, length, (x{i} + {t} * (x{j} - x{i}) - origin_x) * sin(radians(azimuth)) + (y{i} + {t} * (y{j} - y{i}) - origin_y) * cos(radians(azimuth)) AS d, "
            f"z{i} + {t} * (z{j} - z{i}) AS z FROM s WHERE (s{i} >= 0) <> (s{j} >= 0)")


CUT_SQL = f"""{T}, s AS (SELECT t.*, c.section, c.sector, c.origin_x, c.origin_y, c.azimuth, c.length, {', '.join(f'{_S(n)} AS s{n}' for n in range(3))} FROM tri t JOIN cuts c ON t.surface_id = c.surface_id),
  pts AS (SELECT * FROM ({_cross(0, 1)} UNION ALL {_cross(1, 2)} UNION ALL {_cross(2, 0)}) WHERE d BETWEEN -length / 2 AND length / 2)"""


@query("surface_cuts", f"WITH {CUT_SQL} SELECT surface_id, kind, section, count(*) AS n_points, {r('min(d)', 'd_min')}, {r('max(d)', 'd_max')}, {r('avg(z)', 'z_avg')} FROM pts GROUP BY ALL")
def _(spark, d):
    p = surfaces.cut_points(_tri(spark, d), bridge.surface_sections(spark, d))
    return tidy(p.groupBy("surface_id", "kind", "section").agg(F.count(F.lit(1)).alias("n_points"), F.min("d").alias("d_min"), F.max("d").alias("d_max"), F.avg("z").alias("z_avg")))


@query("merged_profile_points", f"""WITH {CUT_SQL} SELECT surface_id, kind, section, round_even(d, 3) + 0 AS d, {r('avg(z)', 'z', 4)} FROM pts GROUP BY surface_id, kind, section, round_even(d, 3)""")
def _(spark, d):
    p = surfaces.merge_points(surfaces.cut_points(_tri(spark, d), bridge.surface_sections(spark, d)))
    return p.select("surface_id", "kind", "section", "d", F.round("z", 4).alias("z"))


# the same profiles by as-of joins: nearest vertex to the left, then a straight line to the next one
RESAMPLED_SQL = f"""{CUT_SQL}, m0 AS (SELECT surface_id, kind, section, round_even(d, 3) AS d, avg(z) AS z FROM pts GROUP BY surface_id, kind, section, round_even(d, 3)),
  m AS (SELECT *, lead(d) OVER w AS d1, lead(z) OVER w AS z1 FROM m0 WINDOW w AS (PARTITION BY surface_id, kind, section ORDER BY d)),
  st AS (SELECT surface_id, kind, section, min(d) AS lo, max(d) AS hi, CAST(greatest(count(*), ceil((max(d) - min(d)) / 0.1::DOUBLE) + 1) AS BIGINT) AS n FROM m0 GROUP BY ALL),
  nd AS (SELECT surface_id, kind, section, i, lo + i * ((hi - lo) / (n - 1)) AS at_d FROM (SELECT *, unnest(range(n)) AS i FROM st)),
  rp AS (SELECT nd.surface_id, nd.kind, nd.section, i, at_d AS d, coalesce(m.z + (m.z1 - m.z) * (at_d - m.d) / (m.d1 - m.d), m.z) AS z FROM nd ASOF JOIN m
    ON nd.surface_id = m.surface_id AND nd.kind = m.kind AND nd.section = m.section AND nd.at_d >= m.d)"""


@query("resampled_profiles", f"""WITH {RESAMPLED_SQL} SELECT surface_id, kind, section, count(*) AS n_nodes, {r('min(d)', 'd_min')}, {r('max(d)', 'd_max')}, {r('avg(z)', 'z_avg', 4)},
    CAST(max(i) AS INTEGER) AS last_idx FROM rp GROUP BY surface_id, kind, section""")
def _(spark, d):
    return tidy(_profiles(spark, d).groupBy("surface_id", "kind", "section").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.min("d").alias("d_min"), F.max("d").alias("d_max"), F.avg("z").alias("z_avg"), F.max("idx").alias("last_idx")), z_avg=4)


_CUBE = lambda n: "[" + ", ".join(f"CAST(floor(({c}{n} - {c}lo) / s) AS BIGINT)" for c in "xyz") + "]"


@query("thinned_surfaces", f"""WITH {T}, b AS (SELECT surface_id, kind, {', '.join(f'min(least({c}0, {c}1, {c}2)) AS {c}lo, max(greatest({c}0, {c}1, {c}2)) AS {c}hi' for c in 'xyz')} FROM tri GROUP BY ALL),
    w AS (SELECT *, power((xhi - xlo) * (yhi - ylo) * (zhi - zlo) / 500, 1.0::DOUBLE / 3) AS s FROM b),
    k AS (SELECT surface_id, kind, {_CUBE(0)} AS k0, {_CUBE(1)} AS k1, {_CUBE(2)} AS k2 FROM tri JOIN w USING (surface_id, kind))
    SELECT surface_id, kind, count(DISTINCT list_sort([k0, k1, k2])) AS n_faces FROM k WHERE k0 <> k1 AND k1 <> k2 AND k0 <> k2 GROUP BY ALL""")
def _(spark, d):
    t = surfaces.thin(_tri(spark, d), 400)
    return t.groupBy("surface_id", "kind").agg(F.count(F.lit(1)).alias("n_faces"))


_AZ = lambda c: f"covar_pop({c[0]}, {c[1]})"
_DET = f"({_AZ('xx')} * {_AZ('yy')} - power({_AZ('xy')}, 2))"
_GA = f"(({_AZ('xz')} * {_AZ('yy')} - {_AZ('yz')} * {_AZ('xy')}) / {_DET})"
_GB = f"(({_AZ('yz')} * {_AZ('xx')} - {_AZ('xz')} * {_AZ('xy')}) / {_DET})"


# the walls fall due east, so the direction is rounded away from its wrap
@query("local_azimuths", f"""WITH {T}, v AS (SELECT surface_id, x0 AS x, y0 AS y, z0 AS z FROM tri WHERE kind = 'design' UNION SELECT surface_id, x1, y1, z1 FROM tri WHERE kind = 'design'
    UNION SELECT surface_id, x2, y2, z2 FROM tri WHERE kind = 'design') SELECT c.surface_id, c.section AS point_id, {r('any_value(origin_x)', 'px')}, {r('any_value(origin_y)', 'py')},
    {r(f'(degrees(atan2(-{_GA}, -{_GB})) + 360) % 360', 'azimuth')} FROM cuts c JOIN v ON c.surface_id = v.surface_id AND power(x - origin_x, 2) + power(y - origin_y, 2) < 2500 GROUP BY c.surface_id, c.section""")
def _(spark, d):
    p = bridge.surface_sections(spark, d).select("surface_id", F.col("section").alias("point_id"), F.col("origin_x").alias("px"), F.col("origin_y").alias("py"))
    return tidy(surfaces.local_azimuth(p, _tri(spark, d)))


@query("sections_along_line", f"""WITH {bridge.SECTIONS_SQL}, k AS (SELECT unnest(range(5)) AS i) SELECT s.section AS line_id, 'S-0' || (i + 1) AS section, {r('origin_x + i / 4.0::DOUBLE * 80', 'origin_x')},
    {r('origin_y + i / 4.0::DOUBLE * 60', 'origin_y')}, {r('degrees(atan2(80, 60)) + 90', 'azimuth')} FROM sections s, k""")
def _(spark, d):
    lines = bridge.sections(spark, d).selectExpr("section AS line_id", "origin_x AS x0", "origin_y AS y0", "origin_x + 80 AS x1", "origin_y + 60 AS y1", "sector")
    return tidy(surfaces.sections_along_line(lines, 5).select("line_id", "section", "origin_x", "origin_y", "azimuth"))


# polyline: 100 m east, then 50 m north; stations every 20 m from 10 m on
@query("perpendicular_sections", f"""WITH {bridge.SECTIONS_SQL}, k AS (SELECT unnest(range(8)) AS i), p AS (SELECT *, 10 + 20 * i AS pp FROM sections, k WHERE 10 + 20 * i < 150)
    SELECT section AS line_id, 'S-0' || (i + 1) AS section, {r('origin_x + least(pp, 100)', 'origin_x')}, {r('origin_y + greatest(pp - 100, 0)', 'origin_y')}, {r('CASE WHEN pp < 100 THEN 180 ELSE 90 END', 'azimuth')} FROM p""")
def _(spark, d):
    corner = lambda n, x, y: f"named_struct('pos', {n}, 'x', origin_x + {x}, 'y', origin_y + {y})"
    pts = bridge.sections(spark, d).selectExpr("section AS line_id", "sector", f"explode(array({corner(0, 0, 0)}, {corner(1, 100, 0)}, {corner(2, 100, 50)})) AS p").select("line_id", "sector", "p.*")
    return tidy(surfaces.perpendicular_sections(pts, 20.0).select("line_id", "section", "origin_x", "origin_y", "azimuth"))


def _lines(triangles):
    e = surfaces.breakline_edges(triangles)
    return surfaces.chain(e, ["surface_id", "kind", "line_kind"]).groupBy("surface_id", "kind", "line_kind", "polyline").agg(
        F.count(F.lit(1)).alias("n_edges")).groupBy("surface_id", "kind", "line_kind").agg(F.count(F.lit(1)).alias("n_polylines"), F.sum("n_edges").alias("n_edges"))


# design walls fold along whole grid columns: even ones are crests, odd ones toes, the two border columns do not fold
@query("breaklines", """SELECT concat('pit-', o_orderkey // 1000) AS surface_id, 'design' AS kind, CASE WHEN (o_orderkey % 1000) % 40 % 2 = 0 THEN 'crest' ELSE 'toe' END AS line_kind,
    count(DISTINCT (o_orderkey % 1000) % 40) AS n_polylines, count(*) AS n_edges FROM orders WHERE (o_orderkey % 1000) % 40 BETWEEN 1 AND 38 AND (o_orderkey % 1000) // 40 < 24 GROUP BY ALL""")
def _(spark, d):
    return _lines(_tri(spark, d).where("kind = 'design'"))


@query("breaklines_as_built", """SELECT concat('pit-', o_orderkey // 1000) AS surface_id, 'topo' AS kind, CASE WHEN (o_orderkey % 1000) % 40 % 2 = 0 THEN 'crest' ELSE 'toe' END AS line_kind,
    count(DISTINCT (o_orderkey % 1000) % 40) AS n_polylines, count(*) AS n_edges FROM orders WHERE (o_orderkey % 1000) % 40 BETWEEN 1 AND 38 AND (o_orderkey % 1000) // 40 < 24 GROUP BY ALL""")
def _(spark, d):
    return _lines(_tri(spark, d).where("kind = 'topo'"))


# the wall folds along whole grid columns, in the as-built surface too; lines run from the first row of vertices on
@query("breakline_points", f"""WITH c AS (SELECT o_orderkey // 1000 AS pit, (o_orderkey % 1000) % 40 AS i, (o_orderkey % 1000) // 40 AS j FROM orders
      WHERE (o_orderkey % 1000) % 40 BETWEEN 1 AND 38 AND (o_orderkey % 1000) // 40 < 24),
    v AS (SELECT pit, i, j FROM c UNION SELECT pit, i, j + 1 FROM c), k AS (SELECT *, pit * 1000 + j * 40 + i AS key, unnest(['design', 'topo']) AS kind FROM v)
    SELECT concat('pit-', pit) AS surface_id, kind, CASE WHEN i % 2 = 0 THEN 'crest' ELSE 'toe' END AS line_kind, CAST(row_number() OVER (PARTITION BY pit, kind, i ORDER BY j) - 1 AS BIGINT) AS pos,
    {r('(i // 2) * 14.5 + (i % 2) * 5.5', 'x')}, {r('j * 12', 'y')}, {r("4000.0 - 15 * ((i + 1) // 2) + CASE WHEN kind = 'topo' THEN ((key * 7) % 11 - 5) / 10.0::DOUBLE ELSE 0 END", 'z')} FROM k""")
def _(spark, d):
    keys = ["surface_id", "kind", "line_kind"]
    lines = surfaces.ordered_polylines(surfaces.breakline_edges(_tri(spark, d)), keys)
    return tidy(surfaces.polyline_points(lines, keys).select(*keys, "pos", "point.x", "point.y", "point.z"))


@query("contour_points")
def _(spark, d):
    keys = ["surface_id", "kind", "elevation"]
    lines = surfaces.ordered_polylines(surfaces.contour_segments(_tri(spark, d), 10.0), keys)
    return tidy(surfaces.polyline_points(lines, keys).select(*keys, "closed", "pos", "point.x", "point.y"))


# a facet with one corner exactly on the level and the others below touches it in a point, which is no segment
@query("contour_segments", f"""WITH {T}, lv0 AS (SELECT CAST(3600 + 10 * unnest(range(60)) AS DOUBLE) AS lv), e AS (SELECT surface_id, lv, (z0 >= lv)::INTEGER + (z1 >= lv)::INTEGER + (z2 >= lv)::INTEGER AS na,
    greatest(z0, z1, z2) AS top FROM tri JOIN lv0 ON lv >= least(z0, z1, z2) AND lv <= greatest(z0, z1, z2) WHERE kind = 'topo')
    SELECT surface_id, lv AS elevation, count(*) AS n_segments FROM e WHERE na = 2 OR (na = 1 AND top > lv) GROUP BY surface_id, lv""")
def _(spark, d):
    s = surfaces.contour_segments(_tri(spark, d).where("kind = 'topo'"), 10.0)
    return s.groupBy("surface_id", "elevation").agg(F.count(F.lit(1)).alias("n_segments"))


@query("contour_lines")
def _(spark, d):
    s = surfaces.contour_segments(_tri(spark, d), 15.0)
    return surfaces.chain(s, ["surface_id", "kind", "elevation"]).groupBy("surface_id", "kind", "elevation").agg(
        F.countDistinct("polyline").alias("n_lines"), F.count(F.lit(1)).alias("n_segments"))


# the design wall in closed form: a 5.5 m wide face and a 9 m berm per bench
_WALL = "CASE WHEN x - 14.5 * floor(x / 14.5) <= 5.5 THEN 4000 - 15 * floor(x / 14.5) - 15 * (x - 14.5 * floor(x / 14.5)) / 5.5 ELSE 3985 - 15 * floor(x / 14.5) END"


@query("height_grid", f"""WITH p AS (SELECT DISTINCT concat('pit-', o_orderkey // 1000) AS surface_id FROM orders), g AS (SELECT surface_id, CAST(ix AS BIGINT) AS ix, CAST(iy AS BIGINT) AS iy, ix * 5.0::DOUBLE AS x
    FROM p, (SELECT unnest(range(57)) AS ix), (SELECT unnest(range(58)) AS iy)) SELECT surface_id, ix, iy, {r(_WALL, 'z')} FROM g""")
def _(spark, d):
    return tidy(surfaces.height_grid(_tri(spark, d).where("kind = 'design'"), 5.0).select("surface_id", "ix", "iy", "z"))


# the as-built surface by its rule: the cell of a node, the half of the cell, the plane through the half's corners
_VERTEX = "(4000.0::DOUBLE - 15 * (({i} + 1) // 2) + (((pit * 1000 + ({j}) * 40 + {i}) * 7) % 11 - 5) / 10.0::DOUBLE)"


@query("height_grid_as_built", f"""WITH p AS (SELECT DISTINCT o_orderkey // 1000 AS pit FROM orders), g AS (SELECT pit, ix, iy, ix * 5.0::DOUBLE AS x, iy * 5.0::DOUBLE AS y FROM p, (SELECT unnest(range(57)) AS ix), (SELECT unnest(range(58)) AS iy)),
    c AS (SELECT *, CAST(2 * floor(x / 14.5) + CASE WHEN x - 14.5 * floor(x / 14.5) > 5.5 THEN 1 ELSE 0 END AS BIGINT) AS i, least(CAST(floor(y / 12) AS BIGINT), 23) AS j FROM g),
    u AS (SELECT *, (x - ((i // 2) * 14.5 + (i % 2) * 5.5)) / CASE WHEN i % 2 = 0 THEN 5.5 ELSE 9 END AS u, (y - 12 * j) / 12 AS v,
      {_VERTEX.format(i='i', j='j')} AS za, {_VERTEX.format(i='(i + 1)', j='j')} AS zb, {_VERTEX.format(i='i', j='j + 1')} AS zc, {_VERTEX.format(i='(i + 1)', j='j + 1')} AS zd FROM c)
    SELECT concat('pit-', pit) AS surface_id, CAST(ix AS BIGINT) AS ix, CAST(iy AS BIGINT) AS iy,
    {r('CASE WHEN u + v <= 1 THEN za + u * (zb - za) + v * (zc - za) ELSE zd + (1 - u) * (zc - zd) + (1 - v) * (zb - zd) END', 'z')} FROM u JOIN orders ON o_orderkey = pit * 1000 + j * 40 + i""")
def _(spark, d):
    return tidy(surfaces.height_grid(_tri(spark, d).where("kind = 'topo'"), 5.0).select("surface_id", "ix", "iy", "z"))


# --- benches from profiles ------------------------------------------------------------------------------------------

@query("extracted_benches")
def _(spark, d):
    b, _ = profiles.extract_benches(_profiles(spark, d, packed=True))
    return tidy(b, 4)


# The design wall in closed form, from the same resampled points: crest and toe are the first points at or past the wall's
# corners, the face angle is the mean over the steep pieces between them by length, the floor the mean of the lowest tenth
# of the points up to the next crest, and the berm runs from the toe, carried on along the face to the floor before it.
_FACES_SQL = f"""WITH {RESAMPLED_SQL}, q AS (SELECT surface_id, section, i, d, z, lead(d) OVER w - d AS dd, lead(z) OVER w - z AS dz FROM rp WHERE kind = 'design' WINDOW w AS (PARTITION BY surface_id, section ORDER BY i)),
    a AS (SELECT *, sqrt(dd * dd + dz * dz) AS len, abs(degrees(atan2(dz, dd))) AS angle FROM q),
    ms AS (SELECT unnest(range(1, 20)) AS m), e AS (SELECT surface_id, section, m, min(i) FILTER (d >= 14.5 * m - 142 - 1e-9) AS ci, min(i) FILTER (d >= 14.5 * m - 136.5 - 1e-9) AS ti FROM q, ms GROUP BY ALL),
    f AS (SELECT e.*, c.d AS cd, c.z AS cz, t.d AS td, t.z AS tz, lead(ci) OVER (PARTITION BY e.surface_id, e.section ORDER BY m) AS nci FROM e JOIN q c ON c.surface_id = e.surface_id AND c.section = e.section AND c.i = e.ci
      JOIN q t ON t.surface_id = e.surface_id AND t.section = e.section AND t.i = e.ti),
    g AS (SELECT f.surface_id, f.section, m, any_value(cd) AS cd, any_value(cz) AS cz, any_value(td) AS td, any_value(tz) AS tz, sum(len * angle) / sum(len) AS angle
      FROM f JOIN a ON a.surface_id = f.surface_id AND a.section = f.section AND a.i >= ci AND a.i < ti AND a.angle > 30 GROUP BY f.surface_id, f.section, m),
    low AS (SELECT f.surface_id, f.section, m, z, row_number() OVER w AS rn, count(*) OVER (PARTITION BY f.surface_id, f.section, m) AS n FROM f JOIN q ON q.surface_id = f.surface_id AND q.section = f.section AND q.i BETWEEN ti AND nci
      WINDOW w AS (PARTITION BY f.surface_id, f.section, m ORDER BY z)),
    fl AS (SELECT surface_id, section, m, avg(z) AS floor FROM low WHERE rn <= greatest(3, n // 10) GROUP BY ALL),
    h AS (SELECT g.*, fl.floor, lag(td + (tz - floor) / tan(radians(angle))) OVER (PARTITION BY g.surface_id, g.section ORDER BY g.m) AS reach FROM g JOIN fl USING (surface_id, section, m))
    SELECT surface_id, section, CAST(m + 1 AS INTEGER) AS bench_number, {r('cd', 'crest_distance', 4)}, {r('cz', 'crest_elevation', 4)}, {r('td', 'toe_distance', 4)}, {r('tz', 'toe_elevation', 4)}, {r('cz - floor', 'bench_height', 4)},
    {r('angle', 'face_angle', 4)}, {r('floor', 'floor_elevation', 4)}, {r('cd - reach', 'berm_width', 4)}, {r('cd - reach', 'effective_berm_width', 4)}, 0.0::DOUBLE AS spill_width, 4 AS n_detection_methods_agreeing, false AS is_ramp
    FROM h WHERE m BETWEEN 2 AND 18"""


@query("design_wall_benches", _FACES_SQL)
def _(spark, d):
    """Benches of the design surfaces that lie, with the berm before them, wholly inside their section."""
    b, _ = profiles.extract_benches(_profiles(spark, d, packed=True).where("kind = 'design'"))
    return tidy(b.where("bench_number BETWEEN 3 AND 19").select(
        "surface_id", "section", "bench_number", "crest_distance", "crest_elevation", "toe_distance", "toe_elevation", "bench_height", "face_angle",
        "floor_elevation", "berm_width", "effective_berm_width", "spill_width", "n_detection_methods_agreeing", "is_ramp"), 4)


@query("section_parameters")
def _(spark, d):
    _, p = profiles.extract_benches(_profiles(spark, d, packed=True))
    return tidy(p, 4)


@query("interramp_table")
def _(spark, d):
    from .reports import interramp_table

    _, p = profiles.extract_benches(_profiles(spark, d, packed=True))
    return interramp_table(p)


@query("reconciled_profiles")
def _(spark, d):
    b, p = profiles.extract_benches(_profiles(spark, d, packed=True))
    line = profiles.reconciled_points(b, points=None, floors=p)
    return tidy(profiles.reconciled_with_hazards(line, b), 4)


@query("surface_reconciliation")
def _(spark, d):
    """Surfaces to comparison rows, end to end."""
    b, _ = profiles.extract_benches(_profiles(spark, d, packed=True))
    b = cut_lineage(b)
    side = lambda kind: b.where(F.col("kind") == kind).drop("kind")
    return tidy(compare(side("design"), side("topo"), keys=("surface_id", "section")).drop("bench_real"), 4)


def _grid_side(kind: str) -> str:
    return (f"s_{kind} AS (SELECT g.surface_id, g.section, k, coalesce(q.z + (q.z1 - q.z) * (g.at_d - q.d) / (q.d1 - q.d), q.z) AS z FROM gr g ASOF JOIN (SELECT *, lead(d) OVER w AS d1, lead(z) OVER w AS z1 "
            f"FROM rp WHERE kind = '{kind}' WINDOW w AS (PARTITION BY surface_id, section ORDER BY d)) q ON g.surface_id = q.surface_id AND g.section = q.section AND g.at_d >= q.d)")


@query("profile_areas", f"""WITH {RESAMPLED_SQL}, sp AS (SELECT surface_id, section, max(lo) AS lo, min(hi) AS hi FROM st GROUP BY surface_id, section),
    gr AS (SELECT surface_id, section, k, lo + k * 0.1::DOUBLE AS at_d FROM (SELECT *, unnest(range(CAST(ceil((hi - lo) / 0.1::DOUBLE) AS BIGINT))) AS k FROM sp)), {_grid_side('design')}, {_grid_side('topo')}
    SELECT d.surface_id, d.section, 'Sector ' || (CAST(replace(d.section, 'P-', '') AS BIGINT) % 4) AS sector, {r('sum(greatest(d.z - t.z, 0)) * 0.1', 'area_topo_below', 3)}, {r('sum(greatest(t.z - d.z, 0)) * 0.1', 'area_topo_above', 3)}
    FROM s_design d JOIN s_topo t ON d.surface_id = t.surface_id AND d.section = t.section AND d.k = t.k GROUP BY d.surface_id, d.section""")
def _(spark, d):
    return tidy(deviations.profile_areas(_profiles(spark, d)), 3)


@query("section_areas_table")
def _(spark, d):
    # profile sections carry their own names; blast sections join by number
    areas = deviations.profile_areas(_profiles(spark, d)).withColumn("section", F.regexp_replace("section", "^P-", "S-"))
    t = correlation.section_correlation(projected(spark, d), bridge.sections(spark, d), comparisons(spark, d))
    return tidy(correlation.section_areas(t, areas), 4)


@query("sector_deviations")
def _(spark, d):
    return tidy(deviations.sector_deviations(_profiles(spark, d, packed=True)), 4)


@query("nearest_point_deviation")
def _(spark, d):
    n = deviations.nearest_point_deviation(_profiles(spark, d, packed=True))
    return tidy(n.groupBy("surface_id", "section", "light").agg(F.count(F.lit(1)).alias("n"), F.avg("deviation_m").alias("deviation_avg_m"), F.max("deviation_m").alias("deviation_max_m")))
