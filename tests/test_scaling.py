"""What grows with the tables must neither pass through the driver nor be copied with all its columns."""
import math
import re
import tracemalloc

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from pitspark.operators import attribution, deviations, drilling, influence, models, profiles, projection, spatial, surfaces
from pitspark.plans import bridge, correlation, queries_blast, queries_models
from pitspark.sources.meshes import StlReader

V = "struct<x:double,y:double,z:double>"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def wall(spark):
    """Two facets that share an edge, cut by one section."""
    p = [(0.0, 0.0, 0.0), (10.0, 0.0, 0.0), (0.0, 10.0, 10.0), (10.0, 10.0, 10.0), (0.0, 20.0, 0.0)]
    tri = [("s", "design", 0, p[0], p[1], p[2]), ("s", "design", 1, p[1], p[3], p[2]), ("s", "design", 2, p[2], p[3], p[4])]
    return spark.createDataFrame(tri, f"surface_id string, kind string, tri_id long, v0 {V}, v1 {V}, v2 {V}")


def test_facets_and_sections_meet_without_broadcast(spark):
    cut = spark.createDataFrame([("s", "A", "N", 5.0, 5.0, 0.0, 60.0, None, None)],
                                "surface_id string, section string, sector string, origin_x double, origin_y double, azimuth double, length double, length_up double, length_down double")
    points = surfaces.cut_points(wall(spark), cut)
    assert "Broadcast" not in plan(points)
    assert {(round(r["d"], 6), round(r["z"], 6)) for r in points.collect()} == {(-5.0, 0.0), (0.0, 5.0), (5.0, 10.0), (10.0, 5.0)}


def test_polylines_are_put_in_order_without_broadcast(spark):
    lines = surfaces.ordered_polylines(surfaces.breakline_edges(wall(spark)), ["surface_id", "kind", "line_kind"])
    assert "Broadcast" not in plan(lines)
    assert [(r["line_kind"], r["pos"], r["a"]["x"], r["b"]["x"]) for r in lines.collect()] == [("crest", 0, 0.0, 10.0)]


def test_a_facet_without_area_makes_no_fold(spark):
    flat = spark.createDataFrame([("s", "design", 3, (0.0, 10.0, 10.0), (10.0, 10.0, 10.0), (5.0, 10.0, 10.0))], wall(spark).schema)
    assert surfaces.breakline_edges(wall(spark).unionByName(flat)).count() == 1


def test_facets_of_the_grid(spark, tmp_path):
    spark.createDataFrame([(41,), (1042,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    rows = {(r["surface_id"], r["kind"], r["tri_id"]): r for r in bridge.surface_triangles(spark, str(tmp_path)).collect()}
    assert set(rows) == {(f"pit-{k // 1000}", kind, 2 * k + half) for k in (41, 1042) for kind in ("design", "topo") for half in (0, 1)}

    def vertex(k, topo):
        i, j = k % 1000 % 40, k % 1000 // 40
        return (i // 2 * 14.5 + i % 2 * 5.5, j * 12.0, 4000.0 - 15 * ((i + 1) // 2) + (((k * 7) % 11 - 5) / 10.0 if topo else 0.0))

    for (_, kind, t), r in rows.items():
        keys = (t // 2, t // 2 + 1, t // 2 + 40) if t % 2 == 0 else (t // 2 + 1, t // 2 + 41, t // 2 + 40)
        assert [tuple(r[v]) for v in ("v0", "v1", "v2")] == [vertex(k, kind == "topo") for k in keys]


def test_holes_meet_designs_by_place_and_number_only(spark, monkeypatch):
    seen, plain = [], spatial.radius_join
    monkeypatch.setattr(spatial, "radius_join", lambda left, right, *a, **k: seen.append(set(right.columns)) or plain(left, right, *a, **k))
    design = spark.createDataFrame([(1, "b", 0.0, 0.0, 7.0), (1, "a", 0.0, 0.0, 8.0), (1, "c", 1.0, 0.0, 9.0)], "pit int, row_id string, x double, y double, kg double")
    actual = spark.createDataFrame([(1, "p", 0.5, 0.0), (1, "q", 0.9, 0.0), (1, "r", 90.0, 0.0), (2, "s", 0.0, 0.0)], "pit int, row_id string, x double, y double")
    pairs = drilling.match_by_position(design, actual, ["pit"])
    assert seen == [{"pit", "px", "py", "_id"}]
    assert {(r["a"]["row_id"], r["d"]["row_id"], r["d"]["kg"]) for r in pairs.collect()} == {("p", "a", 8.0), ("q", "c", 9.0)}


def test_cells_of_two_radii_lose_no_pair(spark):
    at = [(1, 3.0 * i + 0.25 * k, 2.0 * k - 7.0) for i in range(-4, 5) for k in range(8)]
    left, right = spark.createDataFrame(at, "g int, x double, y double"), spark.createDataFrame(at, "g int, px double, py double")
    joined = spatial.radius_join(left, right, 3.0, ["g"])
    assert "Broadcast" not in plan(joined)
    want = sorted((a, b, c, d) for _, a, b in at for _, c, d in at if math.hypot(a - c, b - d) <= 3.0)
    assert sorted((r["x"], r["y"], r["px"], r["py"]) for r in joined.collect()) == want


def test_a_task_reads_many_short_files(tmp_path):
    for k in range(300):
        (tmp_path / f"{k:03}.txt").write_text("solid s\nfacet normal 0 0 0\nouter loop\nvertex 0 0 0\nvertex 1 0 0\nvertex 0 1 %d\nendloop\nendfacet\nendsolid s\n" % k)
    source = StlReader({"path": str(tmp_path), "endings": ".txt", "rangebytes": str(1 << 20)})
    tasks = source.partitions()
    assert len(tasks) <= 64 and sum(len(t.ranges) for t in tasks) == 300
    heights = [z for t in tasks for batch in source.read(t) for z in batch.column("v2").field("z").to_pylist()]
    assert heights == [float(k) for k in range(300)]


def peak_mb(work) -> float:
    tracemalloc.start()
    work()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / 1e6


def test_energy_terms_are_few_at_once():
    rng = np.random.default_rng(4)
    nodes, ends, q = rng.uniform(0, 200, (1500, 3)), rng.uniform(0, 200, (400, 6)), rng.uniform(1, 9, 400)
    sums = np.zeros(len(nodes))
    assert peak_mb(lambda: attribution.add_energy(sums, nodes, ends, q, 30.0)) < 3
    v, w = ends[:, 3:] - ends[:, :3], nodes[:, None, :] - ends[None, :, :3]
    gap = w - np.clip((w * v).sum(2) / (v * v).sum(1), 0, 1)[:, :, None] * v
    assert sums == pytest.approx((q * np.exp(-np.maximum((gap * gap).sum(2), 1e-4) / 1800)).sum(1), rel=1e-12)


def test_a_site_looks_only_into_the_points_around_it():
    rng = np.random.default_rng(5)
    lattice = np.unique(rng.integers(0, 60, (1800, 2)) * 5.0, axis=0)
    cluster = np.vstack([rng.normal(50, 0.5, (900, 2)), rng.uniform(0, 300, (200, 2)), [[0, 0], [300, 300]]])
    for pts in (lattice, cluster):
        (x0, y0), (x1, y1) = pts.min(0), pts.max(0)
        ring = [(x0, y0, -1), (x1, y0, -1), (x1, y1, -1), (x0, y1, -1)]
        cells, reach = influence.cells_among(pts[:, 0], pts[:, 1], ring, pts)
        assert cells.areas().sum() == pytest.approx((x1 - x0) * (y1 - y0))
        for i in range(0, len(pts), 23):
            cell, far = influence._cell(*pts[i], ring, pts)
            assert cells.areas()[i] == pytest.approx(influence._shoelace(cell)) and reach[i] == pytest.approx(far)
    assert peak_mb(lambda: influence.cells_among(lattice[:, 0], lattice[:, 1], [(0, 0, -1), (295, 0, -1), (295, 295, -1), (0, 295, -1)], lattice)) < 12


def test_a_tile_sees_half_a_tile_around_it(spark, monkeypatch):
    def count(event):
        return lambda pdf: pd.DataFrame([{"event": "E", "x": 0.0, "y": 0.0, "area": float(len(pdf)), "touches": bool(pdf.own.any()), "reach": 0.0, "sure": True}])

    monkeypatch.setattr(influence, "_tile_cells", count)
    box = [(0.0, 0.0), (63.0, 0.0), (63.0, 63.0), (0.0, 63.0)]
    sites = spark.createDataFrame([("E", float(i % 64), float(i // 64), box) for i in range(4096)], "event string, x double, y double, ring array<struct<x:double,y:double>>")
    tiles = influence.site_cells(sites, ["event"], 256, 512).collect()
    assert all(t["touches"] for t in tiles) and 4096 < sum(t["area"] for t in tiles) < 4.2 * 4096


def longest_method(spark, df) -> int:
    """Bytes of the longest generated method; the JVM compiles none of 8,000 or more."""
    text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
    return max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text))


@pytest.fixture
def whole_plans(spark):
    """Plans with their generated code, which adaptive plans do not show before they run."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", before)


def test_holes_on_sections_in_code_that_is_compiled(spark, folder, whole_plans):
    assert 0 < longest_method(spark, queries_blast.section_table(spark, folder)) < 8000
    assert 0 < longest_method(spark, queries_blast.projected(spark, folder)) < 8000


def test_model_sums_in_code_that_is_compiled(spark, folder, whole_plans):
    assert 0 < longest_method(spark, models.fit_multivariate(queries_models._predictors(spark, folder))) < 8000


def test_holes_without_a_place_meet_no_section(spark):
    h = "hole_id string, pit int, x double, y double, x_toe double, y_toe double"
    holes = spark.createDataFrame([("near", 1, 3.0, 9.0, None, None), ("far toe", 1, 3.0, 9.0, 900.0, 9.0), ("no x", 1, None, 0.0, 0.0, 0.0), ("no y", 1, 0.0, None, 0.0, 0.0)], h)
    cut = spark.createDataFrame([("A", 1, 0.0, 0.0, 0.0, 100.0)], "section string, pit int, origin_x double, origin_y double, azimuth double, length double")
    assert {r["hole_id"] for r in projection.project_holes(holes, cut, 10.0, ["pit"]).collect()} == {"near", "far toe"}


def test_the_section_table_is_worked_out_once(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    table = spark.range(100).selectExpr("id AS num_wells", "1.0D + id % 7 AS pf_vol_avg_kgm3").repartition(2).mapInArrow(count, "num_wells long, pf_vol_avg_kgm3 double")
    holes = spark.createDataFrame([(4.0, 5.0)], "burden double, spacing double")
    row = correlation.trend_metadata(table, holes).first()
    assert (row["n_pozos_total"], row["n_outliers"], row["sb_ratio"]) == (4950, 0, 1.25)
    assert reads.value == 100


def test_links_of_segments_are_numbers(spark, monkeypatch):
    seen, plain = [], surfaces.components
    monkeypatch.setattr(surfaces, "components", lambda edges, *a: seen.append(dict(edges.dtypes)) or plain(edges, *a))
    p = lambda x: (float(x), 0.0, 0.0)
    rows = [("s", p(0), p(1)), ("s", p(1), p(2)), ("s", p(3), p(4)), ("t", p(1), p(2)), (None, p(2), p(3)), (None, p(1), p(2))]
    lines = surfaces.chain(spark.createDataFrame(rows, f"surface_id string, a {V}, b {V}"), ["surface_id"])
    groups = {}
    for r in lines.collect():
        groups.setdefault(r["polyline"], set()).add((r["surface_id"], r["a"]["x"]))
    assert sorted(map(len, groups.values())) == [1, 1, 2, 2]
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in ({("s", 0.0), ("s", 1.0)}, {("s", 3.0)}, {("t", 1.0)}, {(None, 2.0), (None, 1.0)})}
    assert all(t == "bigint" for d in seen for t in d.values())


def test_components_are_found_without_broadcast(spark):
    got = spatial.components(spark.createDataFrame([(i, i + 1) for i in range(9)] + [(20, 21)], "u long, v long"), "u", "v")
    assert "Broadcast" not in plan(got)
    assert {r["node"]: r["component"] for r in got.collect()} == {**{i: 0 for i in range(10)}, 20: 20, 21: 20}


def test_small_groups_are_compared_at_once(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(g, float(a), float(b)) for g in range(6) for a, b in rng.integers(0, 40, (5 + 4 * g, 2)) * 25]
    rows += rows[:3]
    sites = spark.createDataFrame(rows, "g int, x double, y double")
    cuts, plain = [], spatial.cut_lineage
    monkeypatch.setattr(spatial, "cut_lineage", lambda df: cuts.append(1) or plain(df))
    want = {(g, x, y): sorted(math.hypot(x - a, y - b) for j, (h, a, b) in enumerate(rows) if h == g and j != i)[:4] for i, (g, x, y) in enumerate(rows)}
    for few, most in ((64, 1), (12, 99), (0, 99)):
        cuts.clear()
        got = {(r["g"], r["x"], r["y"]): r["distances"] for r in spatial.k_nearest(sites, 4, ["g"], few=few).collect()}
        assert len(cuts) <= most and got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k]) for k in want)


def bench_points(spark):
    """A design and an as-built profile of one section: three faces of 15 m, the as-built one half a metre lower."""
    face = lambda d: 15.0 * min(max(d, 0.0), 5.0) / 5.0
    rows = [("s", kind, "A", "N", i, i * 0.5, 4000.0 - drop - sum(face(i * 0.5 - 10.0 - 15.0 * k) for k in range(3)))
            for kind, drop in (("design", 0.0), ("topo", 0.5)) for i in range(121)]
    return spark.createDataFrame(rows, "surface_id string, kind string, section string, sector string, idx int, d double, z double")


def test_profiles_and_their_grid_meet_without_broadcast(spark):
    areas, parts = deviations.profile_areas(bench_points(spark)), deviations.sector_deviations(bench_points(spark))
    assert "Broadcast" not in plan(areas) and "Broadcast" not in plan(parts)
    row = areas.first()
    assert row["area_topo_above"] == 0 and math.isclose(row["area_topo_below"], 30.0, rel_tol=1e-9)
    assert math.isclose(sum(r["net_area_m2"] for r in parts.collect()), -30.0, rel_tol=0.02)


def test_nearest_points_meet_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(spatial, "cut_lineage", lambda df: df)
    near = deviations.nearest_point_deviation(bench_points(spark))
    assert "Broadcast" not in plan(near)
    assert near.count() == 121 and near.where("deviation_m <= 0.5").count() == 121


def test_benches_and_points_meet_without_broadcast(spark, monkeypatch):
    plans, plain = [], profiles.cut_lineage
    monkeypatch.setattr(profiles, "cut_lineage", lambda df: plans.append(plan(df)) or plain(df))
    benches, params = profiles.extract_benches(bench_points(spark))
    line = profiles.reconciled_with_hazards(profiles.reconciled_points(benches, floors=params), benches)
    assert len(plans) == 5 and not any("Broadcast" in p for p in [*plans, plan(line)])
    assert [(r["kind"], r["n_benches"]) for r in params.orderBy("kind").collect()] == [("design", 3), ("topo", 3)]


def test_merged_points_meet_their_count_without_broadcast(spark):
    merged = surfaces.merge_points(bench_points(spark).unionByName(bench_points(spark).where("idx = 0").withColumn("section", F.concat("section", "kind"))))
    assert "Broadcast" not in plan(merged)
    assert {(r["section"], r["count"]) for r in merged.groupBy("section").count().collect()} == {("A", 242)}


def noisy_wall(spark, step=0.25):
    """Two profiles of uneven faces, and one without a section."""
    rng = np.random.default_rng(9)
    rows = []
    for kind in ("design", "topo"):
        d = np.arange(0, 120, step)
        z = 4000 - 15 * np.floor(d / 14.5) - 15 * np.clip((d % 14.5) / 5.5, 0, 1) + (rng.normal(0, 0.12, len(d)) if kind == "topo" else 0)
        rows += [("s", kind, "A", "N", i, float(a), float(b)) for i, (a, b) in enumerate(zip(d, z))]
    rows += [("s", "topo", None, "N", i, float(i), 4000.0 - 20.0 * (i > 3)) for i in range(9)]
    return spark.createDataFrame(rows, "surface_id string, kind string, section string, sector string, idx int, d double, z double")


def test_long_and_short_profiles_give_the_same_benches(spark):
    points = noisy_wall(spark)
    found = [profiles.extract_benches(points, piece=piece) for piece in (100_000, 60)]
    one, other = ([r.asDict() for r in b.orderBy("kind", "bench_number").collect()] for b, _ in found)
    assert len(one) == len(other) > 12 and {r["section"] for r in one} == {"A"}
    assert all(a[c] == pytest.approx(b[c]) for a, b in zip(one, other) for c in a)
    assert found[0][1].count() == found[1][1].count() == 3


def test_points_of_packed_profiles_are_neither_shuffled_nor_sorted_nor_written(spark, monkeypatch):
    plans, rows, plain = [], [], profiles.cut_lineage

    def cut(df):
        plans.append(plan(df))
        out = plain(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(profiles, "cut_lineage", cut)
    crossings = noisy_wall(spark, 5.5).drop("idx")
    benches, params = profiles.extract_benches(surfaces.stretches(crossings, profiles.KEYS))
    assert max(rows) < 200 < 2000 < surfaces.resample(crossings, profiles.KEYS).count()
    # points are made in the functions, only section parameters make rows of them, which their aggregate uses at once
    assert [p.count("Generate explode(sequence") for p in plans] == [0, 0, 0, 1, 0]
    above = plans[3][:plans[3].index("Generate explode(sequence")].splitlines()[-4:]
    assert any("HashAggregate" in line or "SortAggregate" in line for line in above) and not any("Exchange" in line for line in above)
    again, whole = profiles.extract_benches(surfaces.resample(crossings, profiles.KEYS))
    assert benches.exceptAll(again).count() == again.exceptAll(benches).count() == 0 < benches.count()
    assert params.exceptAll(whole).count() == 0 and params.count() == whole.count() == 3


def test_nodes_are_the_same_in_a_task(spark):
    crossings = noisy_wall(spark, 5.5).drop("idx").where("section IS NOT NULL AND kind = 'topo'")
    packed = surfaces.stretches(crossings, profiles.KEYS)
    idx, d, z = surfaces.nodes_of(packed.toArrow())
    want = surfaces.node_rows(packed, profiles.KEYS).toArrow()
    assert list(zip(idx, d, z)) == list(zip(*(want.column(c).to_pylist() for c in ("idx", "d", "z"))))


def test_sections_are_worked_out_whole_or_by_joins(spark):
    crossings = noisy_wall(spark, 5.5).drop("idx").unionByName(noisy_wall(spark, 5.5).drop("idx").where("kind = 'topo' AND section = 'A'").withColumn("section", F.lit("B")))
    packed, points = surfaces.stretches(crossings, profiles.KEYS), surfaces.resample(crossings, profiles.KEYS)
    for job, order in ((deviations.sector_deviations, "sector_id"), (deviations.nearest_point_deviation, "idx")):
        whole, rows, joined = job(packed), job(points), job(points, piece=500)
        assert plan(whole).count("Generate") == 0 and "InArrow" in plan(whole)
        found = [[r.asDict() for r in df.orderBy("section", order).collect()] for df in (whole, rows, joined)]
        assert len(found[0]) == len(found[1]) == len(found[2]) > 10 and {r["section"] for r in found[0]} == {"A"}
        assert all(a[c] == pytest.approx(b[c]) for other in found[1:] for a, b in zip(found[0], other) for c in a)


def test_nearest_gaps_equal_all_pairs():
    rng = np.random.default_rng(12)
    for n, m in ((40, 1), (300, 200), (1, 50)):
        qd, qz, d, z = (rng.normal(0, 9, k).round(1) for k in (n, n, m, m))
        order = np.argsort(d)
        got = deviations.nearest_gaps(qd, qz, d[order], z[order])
        assert got == pytest.approx(np.hypot(qd[:, None] - d, qz[:, None] - z).min(1))


def test_lines_and_folds_of_a_group_in_one_call(spark, tmp_path, monkeypatch):
    keys = (0, 1, 2, 3, 40, 41, 42, 43, 80, 81, 82, 83, 120, 121, 123)
    spark.createDataFrame([(k,) for k in (*keys, *(1000 + k for k in keys), 1000)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    triangles = bridge.surface_triangles(spark, str(tmp_path))
    plain = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    edges, joined = (surfaces.breakline_edges(triangles, piece=p).withColumn("angle_deg", F.round("angle_deg", 6)) for p in (100, 10))
    assert plan(edges).count("Exchange") == 1 and plain(edges) == plain(joined.select(edges.columns)) and edges.count() > 20
    on = ["surface_id", "kind", "elevation"]
    pieces = surfaces.contour_segments(triangles, 10.0)
    cuts, cut = [], surfaces.cut_lineage
    monkeypatch.setattr(surfaces, "cut_lineage", lambda df: cuts.append(1) or cut(df))
    found = []
    for p in (100, 3):
        lines = surfaces.polyline_points(surfaces.ordered_polylines(pieces, on, p), on)
        found.append(plain(lines.groupBy(*on, "polyline", "closed").agg(F.array_sort(F.collect_list(F.struct("pos", "point"))).alias("path")).drop("polyline")))
        assert (len(cuts) > 0) == (p == 3)
    assert found[0] == found[1] and len(found[0]) > 20


def test_small_rings_and_loops_in_order():
    order = lambda *pairs, number=range(9): surfaces.drawing_order(*np.array(pairs).T, list(number))
    assert order((0, 2), (0, 1), (1, 2), (5, 7), (5, 6), (9, 10)) == [
        (0, 0, 6, 5, False, False), (0, 1, 5, 7, False, True), (1, 0, 9, 10, False, True), (2, 0, 0, 1, True, False), (2, 1, 1, 2, True, False), (2, 2, 2, 0, True, True)]
    # a loop at the junction 2 ends with its later segment
    loop = [(0, 2), (2, 3), (3, 4), (2, 4)]
    assert [r[2:4] for r in order(*loop)] == [(0, 2), (2, 3), (3, 4), (4, 2)]
    assert [r[1:4] for r in order(*loop, number=(0, 3, 2, 1))] == [(0, 0, 2), (0, 2, 4), (1, 4, 3), (2, 3, 2)]


def test_holes_of_a_place_are_shuffled_once_for_attribution(spark):
    holes = spark.createDataFrame([(1, 0.0, 0.0, f"h{i}", "M", float(i % 7)) for i in range(12)] + [(1, 3.0, 4.0, "k", "N", 50.0), (1, 90.0, 0.0, "far", "N", 9.0), (1, None, 0.0, "none", "N", 9.0)],
                                  "pit int, x double, y double, hole_id string, malla string, kg double")
    features = spark.createDataFrame([(1, "A", 1, "crest", 0.7, 0.0, 1.0), (1, None, 1, "crest", 0.7, 0.0, 1.0), (1, "B", 1, "toe", 0.7, None, 1.0)],
                                     "pit int, section string, bench_num int, feature string, delta_m double, fx double, fy double")
    top = attribution.attribute_holes(features, holes, ["pit"])
    assert plan(top).count("Exchange hashpartitioning") == 4  # by place, by cell (both sides), by feature
    rows = top.orderBy("rank").collect()
    total = sum(i % 7 for i in range(12)) + 50.0 / 18.0
    assert [r["hole_id"] for r in rows] == ["h6", "h5", "h11", "h4", "h10"]
    assert {r["n_candidates"] for r in rows} == {13} and rows[0]["contribution_pct"] == pytest.approx(6 / total * 100, abs=0.01)


def test_designs_travel_by_number_until_they_are_wanted(spark):
    design = spark.createDataFrame([(1, "b", 0.0, 0.0, 7.0), (1, "a", 0.0, 0.0, 8.0), (1, "a", 0.0, 0.0, 8.0)], "pit int, row_id string, x double, y double, kg double")
    actual = spark.createDataFrame([(1, "p", 0.5, 0.0), (1, "p", 0.5, 0.0)], "pit int, row_id string, x double, y double")
    pairs = drilling.match_by_position(design, actual, ["pit"])
    assert [(r["a"]["row_id"], r["d"]["row_id"], r["d"]["kg"]) for r in pairs.collect()] == [("p", "a", 8.0)] * 2
    assert "first(kg" in plan(pairs) and "first(kg" not in plan(pairs.select("a.row_id", F.col("d.row_id").alias("d")))
