import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitspark.operators import compliance, deviations, profiles, surfaces
from pitspark.operators.matching import align, match_benches, nearest_free, pair_cost, reconciliation_gaps

KEYS = ["kind", "section"]
FACE = 15 / math.tan(math.radians(70))


def wall(kind, rising=False, n=4, noise=None):
    """Planar staircase: 9 m berm, then a 15 m face at 70 degrees, n times, then 9 m of floor."""
    d, z, pts = 0.0, 4000.0, [(0.0, 4000.0)]
    for _ in range(n):
        d += 9
        pts.append((d, z))
        d, z = d + FACE, z - 15
        pts.append((d, z))
    pts.append((d + 9, z))
    x = np.linspace(0, d + 9, 1 + int((d + 9) / 0.1))
    y = np.interp(x, *np.array(pts).T)
    if rising:
        y = y[::-1]
    if noise is not None:
        y = y + noise
    return [(kind, "S", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]


SCHEMA = "kind string, section string, idx int, d double, z double"


@pytest.mark.parametrize("rising", [False, True])
def test_staircase_wall(spark, rising):
    pts = spark.createDataFrame(wall("design", rising), SCHEMA)
    b, p = profiles.extract_benches(pts, KEYS)
    rows = b.orderBy("bench_number").collect()
    assert len(rows) == 4
    for r in rows:
        assert r["bench_height"] == pytest.approx(15, abs=0.3)
        assert r["face_angle"] == pytest.approx(70, abs=1.0)
        assert r["detection_method"] == "consensus"
        assert r["spill_width"] < 0.2 and not r["is_ramp"]
    assert [r["berm_width"] for r in rows[1:]] == pytest.approx([9] * 3, abs=0.3)
    assert rows[0]["berm_width"] == pytest.approx(9, abs=0.3)
    one = p.first()
    # angles run from the first bench's crest to the last bench's toe in distance order, on rising walls too
    rise, run = (30, 27 + 2 * FACE + 0) if rising else (60, 27 + 4 * FACE)
    assert one["n_benches"] == 4 and one["overall_angle"] == pytest.approx(math.degrees(math.atan2(rise, run)), abs=0.7)


def test_flat_and_short_profiles(spark):
    flat = [("design", "F", i, i * 0.1, 10.0) for i in range(100)] + [("design", "T", 0, 0.0, 1.0), ("design", "T", 1, 5.0, 2.0)]
    b, p = profiles.extract_benches(spark.createDataFrame(flat, SCHEMA), KEYS)
    assert b.count() == 0 and p.count() == 2


def test_spill_pile_moves_the_toe(spark):
    x = [0, 10, 14, 20, 30]
    z = [100, 100, 88, 83, 83]  # solid at 71.6 degrees, then a pile at 39.8: the pile is no face
    pile = [(0, 100), (10, 100), (13, 90), (16, 87.2), (26, 87.2)]  # pile at 43 degrees stays in the face run
    grid = np.arange(0, 26.0001, 0.1)
    y = np.interp(grid, *np.array(pile, float).T)
    pts = spark.createDataFrame([("topo", "S", i, float(a), float(b)) for i, (a, b) in enumerate(zip(grid, y))], SCHEMA)
    b, _ = profiles.extract_benches(pts, KEYS)
    r = b.first()
    assert r["toe_distance"] == pytest.approx(10 + 12.8 / (10 / 3), abs=0.15) and r["spill_width"] == pytest.approx(16 - r["toe_distance"], abs=0.01)
    assert r["face_angle"] == pytest.approx(math.degrees(math.atan2(10, 3)), abs=0.6)
    poly = profiles.spill_polygons(b, pts, KEYS).orderBy("point_no").collect()
    assert (poly[0]["d"], poly[-1]["d"]) == (r["spill_start_distance"], r["spill_start_distance"]) and len(poly) > 20
    assert len(x) == len(z)


def test_distributed_simplification_equals_plain(spark):
    rng = np.random.default_rng(1)
    z = np.cumsum(rng.normal(0, 0.3, 900))
    pts = spark.createDataFrame([("design", "S", i, i * 0.1, float(v)) for i, v in enumerate(z)], SCHEMA)
    get = lambda piece: sorted(r["idx"] for r in profiles.simplify(pts, KEYS, 0.4, piece).collect())
    want = list(np.flatnonzero(profiles.kept_vertices(np.arange(900) * 0.1, z, 0.4)))
    assert get(100_000) == want and get(40) == want


def test_smoothing_weights_keep_cubics():
    for n, m in profiles.smoothing_weights().items():
        t = np.arange(n)
        cubic = 2 * t**3 - t + 5
        assert np.allclose(m @ cubic, cubic)
    assert np.allclose(profiles.smoothing_weights()[5][2] * 35, [-3, 12, 17, 12, -3])


def test_sub_bench_split(spark):
    face = [("f", 0.0, 30.0), ("f", 10.0, 15.0), ("f", 12.0, 14.0), ("f", 14.0, 16.0), ("f", 30.0, 0.0), ("f", 31.0, 1.5)]
    parts = profiles.split_wide_faces(spark.createDataFrame(face, "section string, d double, z double"), ["section"])
    sizes = {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()}
    assert sizes == {0: 3, 1: 3, 2: 2}
    assert profiles.benches_from_parts(parts, ["section"]).count() == 3


def test_wedge_turn(spark):
    sharp = [("a", i, float(x), float(z)) for i, (x, z) in enumerate([(0, 10), (1, 5), (2, 0)])] + [("b", i, float(x), float(z)) for i, (x, z) in enumerate([(0, 0), (5, 0), (5.1, 9)])]
    got = {r["section"]: r["wedge_risk"] for r in profiles.wedge_in_face(spark.createDataFrame(sharp, "section string, idx int, d double, z double"), ["section"]).collect()}
    assert got == {"a": True, "b": False}


def test_reconciled_round_trip(spark):
    pts = spark.createDataFrame(wall("design"), SCHEMA)
    b, p = profiles.extract_benches(pts, KEYS)
    line = profiles.reconciled_points(b, KEYS, pts, p)
    kinds = [r["segment_type"] for r in line.orderBy("point_no").collect()]
    assert kinds[0] == "crest" and kinds.count("toe") == 4 and "face" in kinds
    back = profiles.from_records(profiles.to_records(line, KEYS), KEYS)
    assert back.count() == line.count() and back.exceptAll(line.select(back.columns)).count() == 0
    s = profiles.reconciled_summary(line, b, KEYS).first()
    assert s["n_benches"] == 4 and s["n_consensus_benches"] == 4
    legacy = profiles.legacy_reconciled_points(b, KEYS, p).orderBy("point_no").collect()
    assert len(legacy) >= 8


def best_alignment(design, topo, limit):
    """All pairings without crossing: most pairs, least cost, earliest partners."""
    def ways(i, j):
        if i == len(design):
            return [(0, 0.0, ())]
        found = [(n, c, (99, *w)) for n, c, w in ways(i + 1, j)]
        for k in range(j, len(topo)):
            if abs(design[i][0] - topo[k][0]) < limit:
                own = pair_cost(design[i][0] - topo[k][0], design[i][1] - topo[k][1])
                found += [(n - 1, own + c, (k, *w)) for n, c, w in ways(i + 1, k + 1)]
        return [min(found)]

    _, _, taken = min(ways(0, 0))
    return [k if k < 99 and pair_cost(design[i][0] - topo[k][0], design[i][1] - topo[k][1]) < limit else -1 for i, k in enumerate(taken)]


@pytest.mark.parametrize("seed", range(25))
def test_alignment_is_the_best_without_crossing(seed):
    rng = np.random.default_rng(seed)
    for _ in range(40):
        n, m = rng.integers(0, 8, 2)
        make = lambda k: [(float(z), float(x)) for z, x in zip(rng.integers(0, 25, k) * rng.choice([1, 0.5]), rng.integers(0, 12, k))]
        d, t = make(n), make(m)
        got = align(d, t, 8)
        assert got == best_alignment(d, t, 8)
        used = [j for j in got if j >= 0]
        assert used == sorted(set(used))


def test_alignment_of_close_and_equal_benches():
    assert align([(100.0, 0.0), (96.0, 4.0)], [(98.0, 2.0)], 8) == [0, -1]  # equally far: the first one
    assert align([(100.0, 0.0), (96.0, 4.0), (92.0, 8.0)], [(96.5, 4.0), (92.5, 8.0)], 8) == [-1, 0, 1]
    assert align([(100.0, 0.0)], [(100.0, 9.0)], 8) == [-1]  # same level, too far along
    assert align([], [(1.0, 1.0)], 8) == [] and align([(1.0, 1.0)], [], 8) == [-1]
    assert align([(float("nan"), 0.0), (5.0, 0.0)], [(5.0, 0.0)], 8) == [-1, 0]
    long = [(-4.0 * i, 3.0 * i) for i in range(300)]
    assert align(long, long, 8) == list(range(300))


def test_nearest_free_benches_in_design_order():
    assert nearest_free([100.0, 96.0, 92.0], [97.0, 93.0], 8) == [0, 1, -1]
    assert nearest_free([100.0, 99.0], [99.5], 8) == [0, -1]
    assert nearest_free([100.0], [92.0], 8) == [-1] and nearest_free([float("nan")], [1.0], 8) == [-1]


BENCH = "pit int, section string, bench_number int, crest_elevation double, toe_elevation double, crest_distance double, toe_distance double, bench_height double"


def close_benches(spark, seed=11, sections=12):
    rng = np.random.default_rng(seed)
    rows = {"d": [], "t": []}
    for s in range(sections):
        for side in rows:
            for k in range(rng.integers(0 if s == 0 else 2, 9)):
                z, x = float(4000 - rng.integers(3, 7) * k + rng.normal(0, 2)), float(3 * k + rng.normal(0, 2))
                rows[side].append((s // 4, f"S{s % 4}", k + 1, z + 2, z - 2, x - 1, x + 1, float(rng.uniform(1, 9))))
    return rows, [spark.createDataFrame(rows[k], BENCH) for k in ("d", "t")]


def test_sections_of_one_name_in_several_pits_stay_apart(spark):
    rows, (design, topo) = close_benches(spark)
    keys = ("pit", "section")
    got = {}
    for r in match_benches(design, topo, keys=keys).collect():
        got.setdefault((r["pit"], r["section"]), {})[r["design_pos"] - 1] = (r["topo_pos"] - 1, r["cost"])
    gaps = {}
    for r in reconciliation_gaps(design, topo, keys=keys).collect():
        gaps.setdefault((r["pit"], r["section"]), []).append((r["location"], round(r["delta_h"], 9)))
    for key in {r[:2] for k in rows for r in rows[k]}:
        d, t = ([r for r in rows[k] if r[:2] == key] for k in ("d", "t"))
        mid = lambda b: ((b[3] + b[4]) / 2, (b[5] + b[6]) / 2)
        want = best_alignment([mid(b) for b in d], [mid(b) for b in t], 8)
        assert got.get(key, {}) == {i: (j, pair_cost(mid(d[i])[0] - mid(t[j])[0], mid(d[i])[1] - mid(t[j])[1])) for i, j in enumerate(want) if j >= 0}
        free, expected = list(range(len(t))), []
        for b in d:
            near = sorted((abs(mid(t[j])[0] - mid(b)[0]), j) for j in free)
            if not near or near[0][0] >= 8:
                expected.append(("missing_crest", round(-b[7], 9)))
                continue
            free.remove(near[0][1])
            delta = t[near[0][1]][7] - b[7]
            if abs(delta) > 1.5:
                expected.append(("overbreak" if delta > 0 else "extra_material", round(delta, 9)))
        assert sorted(gaps.get(key, [])) == sorted(expected)


def test_polylines_in_drawing_order(spark):
    rng = np.random.default_rng(2)
    point = lambda x, y: (float(x), float(y))
    line = [point(3 * i, (i * 7) % 5) for i in range(41)]
    ring = [point(100 + 9 * math.cos(0.3 * i), 9 * math.sin(0.3 * i)) for i in range(20)]
    small = [point(200, 0), point(201, 0), point(200, 1)]
    star = [[point(300, 0), point(300 + 5 * math.cos(a), 5 * math.sin(a)), point(300 + 9 * math.cos(a), 9 * math.sin(a))] for a in (0.1, 2.1, 4.1)]
    wanted, pieces = [], []
    for key, shape, closed in (("A", line, False), ("A", ring, True), ("B", ring, True), ("B", small, True), *[("A", s, False) for s in star], ("B", line[:2], False)):
        path = shape + shape[:1] if closed else shape
        pieces += [(key, *((p, q) if rng.random() < 0.5 else (q, p))) for p, q in zip(path, path[1:])]
        if closed:
            at = shape.index(min(shape))
            turned = shape[at:] + shape[:at]
            turned = turned if turned[1] < turned[-1] else turned[:1] + turned[:0:-1]
            wanted.append((key, True, turned + turned[:1]))
        else:
            wanted.append((key, False, shape if shape[0] < shape[-1] else shape[::-1]))
    pieces += [pieces[0], (pieces[1][0], pieces[1][2], pieces[1][1]), ("A", point(5, 5), point(5, 5))]
    df = spark.createDataFrame(pieces, "k string, a struct<x:double,y:double>, b struct<x:double,y:double>").repartition(5)
    lines = surfaces.ordered_polylines(df, ["k"])
    got = {}
    for r in surfaces.polyline_points(lines, ["k"]).orderBy("polyline", "pos").collect():
        got.setdefault((r["k"], r["closed"], r["polyline"]), []).append(tuple(r["point"]))
    assert sorted((k, c, p) for (k, c, _), p in got.items()) == sorted(wanted)
    assert surfaces.ordered_polylines(df.limit(0), ["k"]).count() == 0


def test_every_bench_of_close_sections_appears_once(spark):
    rows, (design, topo) = close_benches(spark, 5)
    add = lambda df: df.withColumns({"face_angle": F.lit(70.0), "berm_width": F.lit(9.0), "sector": F.lit("N")})
    out = compliance.compare(add(design), add(topo), keys=("pit", "section")).collect()
    kinds = {k: sum(r["type"] == k for r in out) for k in ("MATCH", "MISSING", "EXTRA")}
    assert kinds["MATCH"] + kinds["MISSING"] == len(rows["d"]) and kinds["MATCH"] + kinds["EXTRA"] == len(rows["t"])
    assert all(kinds.values()) and {r["bench_num"] for r in out if r["type"] == "EXTRA"} == {999}
    for key in {(r["pit"], r["section"]) for r in out}:
        scores = {r["section_score"] for r in out if (r["pit"], r["section"]) == key}
        match = [r["bench_score"] for r in out if (r["pit"], r["section"]) == key and r["type"] == "MATCH"]
        assert scores == {round(sum(match) / len(match), 1) if match else 0.0}


def test_comparison_is_one_shuffle_and_one_python_node(spark, folder):
    from pitspark.plans import bridge

    plan = compliance.compare(bridge.design_benches(spark, folder), bridge.topo_benches(spark, folder))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1 and plan.count("ArrowEvalPython") == 1


def test_comparison_invariants(spark, folder):
    from pitspark.plans import bridge

    d, t = bridge.design_benches(spark, folder), bridge.topo_benches(spark, folder)
    c = compliance.compare(d, t)
    n = {r["type"]: r["count"] for r in c.groupBy("type").count().collect()}
    assert n["MATCH"] + n["MISSING"] == d.count() and n["MATCH"] + n["EXTRA"] == t.count()
    assert c.where("type = 'MATCH' AND bench_score <> berm_score + angle_score + height_score").count() == 0


def test_edit_recomputes_geometry(spark):
    schema = "section string, bench_number int, crest_elevation double, crest_distance double, toe_elevation double, toe_distance double, bench_height double, face_angle double, berm_width double"
    b = spark.createDataFrame([("S", 1, 100.0, 0.0, 85.0, 5.0, 15.0, 71.6, 0.0), ("S", 2, 85.0, 14.0, 70.0, 19.0, 15.0, 71.6, 9.0), ("T", 1, 9.0, 0.0, 0.0, 1.0, 9.0, 80.0, 3.0)], schema)
    e = spark.createDataFrame([("S", 1, 0.0, 84.0, 0.0)], "section string, bench_number int, crest_distance double, toe_elevation double, toe_distance double")
    got = {(r["section"], r["bench_number"]): r for r in compliance.apply_edits(b, e).collect()}
    assert got["S", 1]["bench_height"] == 16.0 and got["S", 1]["face_angle"] == 90.0
    assert got["S", 2]["berm_width"] == 14.0 and got["T", 1]["berm_width"] == 3.0


def test_sector_deviations_and_areas(spark):
    keys = ["section"]
    design = wall("design")
    topo = [("topo", s, i, d, z + 0.5) for _, s, i, d, z in design]
    pts = spark.createDataFrame(design + topo, SCHEMA)
    length = design[-1][3]
    a = deviations.profile_areas(pts, keys).first()
    assert a["area_topo_above"] == pytest.approx(0.5 * length, abs=0.1) and a["area_topo_below"] == 0
    rows = deviations.sector_deviations(pts, keys).collect()
    assert sum(r["net_area_m2"] for r in rows) == pytest.approx(0.5 * length, abs=0.6)
    assert {r["classification"] for r in rows} == {"overbreak"} and all(r["mean_delta_h"] == pytest.approx(0.5, abs=1e-6) for r in rows)
    far = deviations.nearest_point_deviation(pts, keys)
    assert far.agg(F.max("deviation_m")).first()[0] <= 0.5 + 1e-9 and far.count() == len(topo)


def cone(spark, n=60):
    """Cone pit as triangles, regenerated by Spark."""
    step = 500 / (n - 1)
    w = FACE

    def height(x, y):
        r = F.sqrt((x - 250) ** 2 + (y - 250) ** 2)
        z = F.lit(3900.0)
        for i in range(4):
            outer = 200 - i * (9 + w)
            top = 3900 - 15 * i
            z = F.when(r <= outer - w, top - 15.0).when(r <= outer, top - 15 * (outer - r) / w).otherwise(z) if i == 0 else F.when(
                r <= outer - w, top - 15.0).when(r <= outer, top - 15 * (outer - r) / w).otherwise(z)
        return z

    cells = spark.range(n - 1).withColumnRenamed("id", "i").crossJoin(spark.range(n - 1).withColumnRenamed("id", "j"))
    pt = lambda a, b: F.struct(((F.col("i") + a) * step).alias("x"), ((F.col("j") + b) * step).alias("y"), height((F.col("i") + a) * step, (F.col("j") + b) * step).alias("z"))
    tri = F.array(F.struct(F.lit(0).alias("h"), pt(0, 0).alias("v0"), pt(1, 0).alias("v1"), pt(0, 1).alias("v2")),
                  F.struct(F.lit(1).alias("h"), pt(1, 0).alias("v0"), pt(1, 1).alias("v1"), pt(0, 1).alias("v2")))
    return cells.select(((F.col("i") * n + F.col("j")) * 2).alias("k"), F.explode(tri).alias("t")).select(
        F.lit("pit").alias("surface_id"), F.lit("design").alias("kind"), (F.col("k") + F.col("t.h")).alias("tri_id"), "t.v0", "t.v1", "t.v2")


def test_cone_pit_surface(spark):
    tri = cone(spark)
    b = surfaces.bounds(tri).first()
    assert b["n_faces"] == 2 * 59 * 59 and b["n_vertices"] == 3600 and b["zmax"] == 3900
    sec = spark.createDataFrame([("pit", "S-01", "A", 100.0, 250.0, 90.0, 300.0, None, None)],
                                "surface_id string, section string, sector string, origin_x double, origin_y double, azimuth double, length double, length_up double, length_down double")
    prof = surfaces.profiles(tri, sec)
    ds = [r["d"] for r in prof.orderBy("idx").collect()]
    assert ds[0] == pytest.approx(-100, abs=9) and max(np.diff(ds)) <= 0.1 + 1e-9
    benches, _ = profiles.extract_benches(prof)
    assert benches.count() >= 1
    az = surfaces.local_azimuth(spark.createDataFrame([("pit", "p", 80.0, 250.0), ("pit", "far", 9e4, 9e4)], "surface_id string, point_id string, px double, py double"), tri)
    got = {r["point_id"]: r["azimuth"] for r in az.collect()}
    assert got["p"] == pytest.approx(90, abs=8) and got["far"] == 0.0
    assert surfaces.thin(tri, 800).count() < 2 * 59 * 59
    lines = surfaces.chain(surfaces.contour_segments(tri, 15.0).where("elevation = 3870"), ["surface_id", "kind", "elevation"])
    assert lines.select("polyline").distinct().count() == 1  # a single closed ring
    g = surfaces.height_grid(tri, 25.0)
    assert g.count() == 441 and g.where("ix = 10 AND iy = 10").first()["z"] == pytest.approx(3840)


def test_breaklines_of_a_step(spark):
    # two level plates joined by a slope: a convex fold on top, a concave one below
    def quad(k, a, b, c, d):
        p = lambda q: dict(x=float(q[0]), y=float(q[1]), z=float(q[2]))
        return [("s", "design", 2 * k, p(a), p(b), p(d)), ("s", "design", 2 * k + 1, p(b), p(c), p(d))]
    rows = quad(0, (0, 0, 10), (5, 0, 10), (5, 5, 10), (0, 5, 10)) + quad(1, (5, 0, 10), (8, 0, 0), (8, 5, 0), (5, 5, 10)) + quad(2, (8, 0, 0), (20, 0, 0), (20, 5, 0), (8, 5, 0))
    tri = spark.createDataFrame(rows, "surface_id string, kind string, tri_id long, v0 struct<x:double,y:double,z:double>, v1 struct<x:double,y:double,z:double>, v2 struct<x:double,y:double,z:double>")
    got = {(r["line_kind"], r["a"]["x"]) for r in surfaces.breakline_edges(tri).collect()}
    assert got == {("crest", 5.0), ("toe", 8.0)}


def test_as_built_grid_equals_brute_force(spark, folder):
    import __spark_entry__ as entry
    from pitspark.plans import bridge

    tri = bridge.surface_triangles(spark, folder).where("kind = 'topo'")
    got = {(r["surface_id"], r["ix"], r["iy"]): r["z"] for r in entry.queries()["height_grid_as_built"](spark, folder).collect()}
    want = {}
    for f in sorted(tri.collect(), key=lambda f: f["tri_id"]):
        (x0, y0, z0), (x1, y1, z1), (x2, y2, z2) = ((f[v]["x"], f[v]["y"], f[v]["z"]) for v in ("v0", "v1", "v2"))
        det = (x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0)
        for ix in range(int(min(x0, x1, x2) // 5), int(max(x0, x1, x2) // 5) + 1):
            for iy in range(int(min(y0, y1, y2) // 5), int(max(y0, y1, y2) // 5) + 1):
                a = ((5 * ix - x0) * (y2 - y0) - (x2 - x0) * (5 * iy - y0)) / det if det else -1
                b = ((x1 - x0) * (5 * iy - y0) - (5 * ix - x0) * (y1 - y0)) / det if det else -1
                if min(a, b, 1 - a - b) >= -1e-9:
                    want.setdefault((f["surface_id"], ix, iy), z0 + a * (z1 - z0) + b * (z2 - z0))
    assert got.keys() == want.keys() and len(got) > 1000
    assert all(got[k] == pytest.approx(z, abs=0.01) for k, z in want.items())
