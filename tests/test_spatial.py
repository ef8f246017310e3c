import numpy as np
import pytest
from pyspark.sql import functions as F

from pitspark.operators import spatial
from pitspark.operators.projection import project_holes


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(7)
    pts = rng.uniform(0, 100, (120, 2))
    pts[40:70] = pts[40]          # a third of the rows stacked on one spot
    pts[70:80] = rng.uniform(900, 1000, (10, 2))  # far outliers
    return pts


def frame(spark, pts, names=("x", "y")):
    return spark.createDataFrame([(0, i, float(a), float(b)) for i, (a, b) in enumerate(pts)], f"g int, id int, {names[0]} double, {names[1]} double")


def test_radius_join_equals_all_pairs(spark, cloud):
    left, right = frame(spark, cloud), frame(spark, cloud[::3], ("px", "py")).withColumnRenamed("id", "rid")
    got = {(r["id"], r["rid"]) for r in spatial.radius_join(left, right, 15.0, ["g"]).collect()}
    want = {(i, j) for i, a in enumerate(cloud) for j, b in enumerate(cloud[::3]) if np.hypot(*(a - b)) <= 15}
    assert got == want


def test_nearest_within_ties_and_reach(spark, cloud):
    right = frame(spark, cloud[::2] + 1, ("px", "py")).withColumnRenamed("id", "rid")
    got = {(r["x"], r["y"]): (r["rid"], r["distance"]) for r in spatial.nearest_within(frame(spark, cloud), right, 8.0, ["g"], "x", "rid").collect()}
    sites = cloud[::2] + 1
    for x, y in {tuple(p) for p in cloud}:
        d = np.hypot(sites[:, 0] - x, sites[:, 1] - y)
        if d.min() <= 8:
            assert got[(x, y)] == (int(np.argmin(d)), pytest.approx(d.min()))
        else:
            assert (x, y) not in got


def test_k_nearest_equals_brute_force(spark, cloud):
    got = {(r["x"], r["y"]): r["distances"] for r in spatial.k_nearest(frame(spark, cloud), 4, ["g"], spacing=5.0).collect()}
    for i, p in enumerate(cloud):
        d = np.sort(np.delete(np.hypot(*(cloud - p).T), i))[:4]
        assert got[tuple(p)] == pytest.approx(list(d))


def test_k_nearest_small_groups(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 0.0), (1, 3.0, 4.0)], "g int, x double, y double")
    got = {(r["g"], r["x"]): r["distances"] for r in spatial.k_nearest(df, 4, ["g"]).collect()}
    assert got.get((0, 0.0), []) == [] and got[(1, 0.0)] == [5.0] and got[(1, 3.0)] == [5.0]


def test_nearest_distance_any_range(spark, cloud):
    q = frame(spark, cloud, ("qx", "qy"))
    s = frame(spark, cloud[::5] + 3, ("sx", "sy"))
    got = {(r["qx"], r["qy"]): r["distance"] for r in spatial.nearest_distance(q, s, ["g"]).collect()}
    sites = cloud[::5] + 3
    assert len(got) == len({tuple(p) for p in cloud})
    for x, y in got:
        assert got[(x, y)] == pytest.approx(np.hypot(sites[:, 0] - x, sites[:, 1] - y).min())


@pytest.mark.parametrize("small", [5, 100_000])
def test_exact_quantiles(spark, small):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(0, 1, 300), np.full(200, 0.25), rng.exponential(1e6, 30)])
    df = spark.createDataFrame([(float(a),) for a in v], "v double").union(spark.sql("SELECT CAST(NULL AS DOUBLE)"))
    got = spatial.exact_quantiles(df, "v", [0.0, 0.1, 0.25, 0.5, 0.9, 1.0], buckets=16, small=small)
    assert got == pytest.approx(list(np.quantile(v, [0.0, 0.1, 0.25, 0.5, 0.9, 1.0])))


def test_interval_join(spark):
    pts = spark.createDataFrame([(0, float(i)) for i in range(50)], "g int, at double")
    spans = spark.createDataFrame([(0, "a", 3.0, 7.0), (0, "b", 7.0, 31.5)], "g int, n string, lo double, hi double")
    got = sorted((r["n"], r["at"]) for r in spatial.interval_join(pts, spans, ["g"], "at", "lo", "hi", 4.0).collect())
    assert got == sorted([("a", float(i)) for i in range(3, 8)] + [("b", float(i)) for i in range(7, 32)])


def test_components_of_chains_and_rings(spark):
    edges = [(f"a{i:03d}", f"a{i + 1:03d}") for i in range(60)] + [("b0", "b1"), ("b1", "b2"), ("b2", "b0"), ("c", "c")]
    df = spark.createDataFrame(edges, "u string, v string")
    got = {r["node"]: r["component"] for r in spatial.components(df, "u", "v").collect()}
    assert {got[f"a{i:03d}"] for i in range(61)} == {"a000"} and {got[k] for k in ("b0", "b1", "b2")} == {"b0"} and got["c"] == "c"


def test_projection_equals_brute_force_with_long_holes(spark):
    rng = np.random.default_rng(5)
    holes = [(0, i, *map(float, rng.uniform(-150, 150, 2))) for i in range(300)]
    off = rng.uniform(-1, 1, (300, 2)) * np.where(rng.uniform(size=300) < 0.1, 120, 10)[:, None]
    rows = [(g, i, x, y, x + float(a), y + float(b)) for (g, i, x, y), (a, b) in zip(holes, off)]
    secs = [(0, f"S{k}", float(k * 20 - 60), float(10 * k), 37.0 * k, 150.0) for k in range(6)]
    h = spark.createDataFrame(rows, "pit int, hole_id int, x double, y double, x_toe double, y_toe double")
    s = spark.createDataFrame(secs, "pit int, section string, origin_x double, origin_y double, azimuth double, length double")
    got = {(r["section"], r["hole_id"]) for r in project_holes(h, s, 10.0, ["pit"]).collect()}
    want = set()
    for _, name, ox, oy, az, length in secs:
        dx, dy = np.sin(np.radians(az)), np.cos(np.radians(az))
        for _, i, x, y, tx, ty in rows:
            p, q = abs((x - ox) * dy - (y - oy) * dx), abs((tx - ox) * dy - (ty - oy) * dx)
            if min(p, q, (p + q) / 2) <= 10 + 1e-6 and abs((x - ox) * dx + (y - oy) * dy) <= length / 2:
                want.add((name, i))
    assert got == want


def test_quantiles_leave_out_non_finite_values(spark):
    from pitspark.operators.spatial import exact_quantiles

    rows = [(float(i),) for i in range(51)] + [(float("inf"),), (float("-inf"),), (float("nan"),), (None,)]
    assert exact_quantiles(spark.createDataFrame(rows, "v double"), "v", [0.0, 0.5, 1.0], small=10) == [0.0, 25.0, 50.0]


@pytest.mark.parametrize("ring", [[(0, 0), (100, 0), (100, 100), (0, 100)], [(0, 0), (100, 0), (100, 100), (60, 100), (50, 20), (40, 100), (0, 100)]])
def test_cells_of_many_sites_equal_those_of_each_alone(ring):
    from pitspark.operators import influence

    rng = np.random.default_rng(len(ring))
    corners = [(float(x), float(y), -1) for x, y in ring]
    sites = rng.uniform(-10, 110, (300, 2))
    sites[:60] = np.round(sites[:60] / 10) * 10  # a lattice, with equal distances and some repeated sites
    sites = np.concatenate([sites, rng.normal(50, 0.5, (60, 2))])
    cells, reach = influence.cells_among(sites[:, 0], sites[:, 1], corners, sites)
    for i, (x, y) in enumerate(sites):
        cell, far = influence._cell(x, y, list(corners), sites)
        assert cells.areas()[i] == pytest.approx(influence._shoelace(cell) if cell else 0.0, rel=1e-9, abs=1e-9)
        assert reach[i] == pytest.approx(far, rel=1e-12) and cells.touches()[i] == any(p[2] < 0 for p in cell)
