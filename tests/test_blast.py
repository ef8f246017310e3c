import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitspark.operators import attribution, columns, drilling, exchange, influence, models, stability
from pitspark.operators.holes import event_warnings, process_holes
from pitspark.operators.powder_factor import enrich, fill_burden_spacing, powder_factors, resolve_bench_height

CONFIG = columns.GeometryConfig(True, "Inclinacion_real", "FROM_VERTICAL", "ABSOLUTE_VALUE", "DEGREES", "", "Azimuth_real", "CLOCKWISE_FROM_NORTH", "DEGREES")
RAW = "label_pozo string, Latitud_Geo string, Longitud_Geo string, Nombre_Banco string, Inclinacion_real string, Azimuth_real string, longitud_real string, Kilos_Cargados_real string, Nombre_Rajo string"


def raw(spark):
    return spark.createDataFrame([
        ("H1", "1000", "2000", "4000", "15", "90", "12", "250", "R"), ("H2", "abc", "2000", "4000", "15", None, "12", "250", "R"),
        ("H3", "1000", "2000", "4000", "95", "90", "12", "250", "R"), ("H4", "1000", "2000", "4000", "-5", "450", "0", "250", "R"),
        ("H5", "1000", "2000", "4000", "x", "90", "12", None, "R")], RAW)


def test_hole_report(spark):
    r = process_holes(raw(spark), CONFIG, bench_height=15.0, row_key="label_pozo")
    assert [h["hole_id"] for h in r.accepted.collect()] == ["H1"]
    h = r.accepted.first()
    assert h["z_collar"] == 4015 and h["x_toe"] == pytest.approx(1000 + 12 * math.sin(math.radians(15))) and h["extras"] == {"Nombre_Rajo": "R"}
    codes = {(x["hole_id"], x["error_code"]) for x in r.rejections.collect()}
    assert codes == {("H2", "INVALID_X"), ("H2", "INVALID_Az"), ("H3", "INCL_OUT_OF_RANGE"), ("H4", "INVALID_LEN_NON_POSITIVE"), ("H5", "INVALID_Incl")}
    s = r.summary.first()
    assert (s["rows_received"], s["rows_accepted"], s["rejected_source_rows"], s["rejection_records"], s["blocking_error"]) == (5, 1, 4, 5, None)
    assert exchange.from_vendor_report(r.accepted).first()["mine_site"] == "R"


def test_hole_report_blocks_without_height_or_confirmation(spark):
    h = process_holes(raw(spark), CONFIG, row_key="label_pozo").accepted.first()
    assert h["z_collar"] == 4000 and h["z_toe"] is None and h["z_collar_semantic"] == "bench_elevation_untransformed"
    with pytest.raises(columns.GeometryError) as e:
        process_holes(raw(spark), columns.GeometryConfig())
    assert e.value.error_code == "GEOMETRY_NOT_CONFIRMED"
    with pytest.raises(columns.GeometryError) as e:
        process_holes(raw(spark).drop("Azimuth_real"), CONFIG)
    assert e.value.error_code == "AZIMUTH_SOURCE_COLUMN_NOT_FOUND"
    with pytest.raises(ValueError):
        columns.elevation_meaning("Z")


def test_event_warnings_order(spark):
    df = spark.createDataFrame([(None, "UNKNOWN", False), (None, "ANFO", True)], "pf_vol_kgm3 double, explosive_status string, conservation_ok boolean")
    got = [(r["level"], r["warning_code"]) for r in event_warnings(df).collect()]
    assert got == [("error", "VORONOI_CONSERVATION_FAILED"), ("warning", "BLOCKED_PF_VOL_KGM3"), ("warning", "EXPLOSIVE_UNKNOWN")]


def test_auto_map():
    m = columns.auto_map(["Easting", "northing", "Elevatoin", "Dip", "Azimuth (deg)", "Length", "Burden", "Stemming"])
    assert m.columns["X"] == "Easting" and m.columns["Y"] == "northing" and m.columns["Z_collar"] == "Elevatoin"
    assert m.confidence["Z_collar"][0] == "fuzzy" and m.columns["Az"] == "Azimuth (deg)" and m.columns["Esp"] is None and not m.missing_required
    assert columns.validate_mapping({"X": "a", "Y": "a"}) and not columns.validate_mapping(m.columns)
    assert {(f.code, f.field, f.source) for f in columns.validate_mapping({**m.columns, "Len": None, "Esp": "Burden"})} == {
        ("REQUIRED_FIELD_UNMAPPED", "Len", None), ("COLUMN_USED_AGAIN", "Esp", "Burden")}
    best = columns.auto_map(["Azimut", "Azimuth", "azimuth ", "Lengthh", "Length x"])
    assert best.columns["Az"] == "Azimut" and best.columns["Len"] == "Lengthh" and "Lengthh" not in best.missing_required and "X" in best.missing_required
    assert columns.find_column(["LATITUD_GEO"], ["Latitud_Geo"]) == "LATITUD_GEO"


def test_apply_mapping_keeps_bad_rows(spark):
    df = spark.createDataFrame([("1", "q")], "e string, n string")
    m = {f: None for f in columns.VENDOR_ALIASES}
    m.update(X="e", Y="n", Z_collar="z", Incl="i", Az="a", Len="l")
    assert columns.apply_mapping(df, m).first().asDict() == {"X": 1.0, "Y": None}
    assert columns.field_schema(spark).count() == 20


def test_bench_height_provenance(spark):
    df = spark.createDataFrame([(1, 10.0), (2, -1.0), (3, None)], "id int, bench_height_m double")
    got = [(r["bench_height_m"], r["bench_height_status"]) for r in resolve_bench_height(df).orderBy("id").collect()]
    assert got == [(10.0, "PROVIDED"), (None, "INVALID"), (None, "MISSING")]
    bare = df.drop("bench_height_m")
    assert resolve_bench_height(bare, value=12.0, source="derived_from_surfaces").first()["bench_height_status"] == "DERIVED"
    assert resolve_bench_height(bare, allow_assumption=True).first()["bench_height_status"] == "EXPLICIT_ASSUMPTION"
    assert resolve_bench_height(bare).first()["bench_height_m"] is None


HOLE = "hole_id string, malla string, x double, y double, z_collar double, z_toe double, incl double, az double, len double, kg double, burden double, spacing double, taco_m double, product string, bench_height_m double"


def holes(spark, rows):
    return spark.createDataFrame(rows, HOLE)


def test_powder_factor_family(spark):
    h = holes(spark, [("A", "M", 0.0, 0.0, 1000.0, 984.0, 0.0, 0.0, 16.0, 300.0, 5.0, 6.0, 4.0, "ANFO", 15.0), ("B", "M", 5.0, 0.0, 1000.0, 984.0, 0.0, 0.0, 16.0, 300.0, None, 6.0, 4.0, "TNT", None)])
    a, b = powder_factors(h).orderBy("hole_id").collect()
    assert a["pf_vol_kgm3"] == pytest.approx(300 / 450) and a["pf_g_per_ton"] == pytest.approx(3e5 / (30 * 16 * 2.7)) and a["height_net_m"] == 15.0
    assert a["energy_mj"] == pytest.approx(1116) and b["energy_mj"] is None and b["pf_vol_kgm3"] is None and b["height_net_m"] is None
    e = enrich(powder_factors(h), ucs_mpa=90.0).orderBy("hole_id").first()
    assert e["stemming_ratio"] == 0.8 and e["altura_carga_m"] == 12.0 and e["ispu"] == pytest.approx(450 * 2.7 * 90 / 1116)


def test_spacing_fallback_only_for_bare_patterns(spark):
    rows = [(f"A{i}", "bare", 5.0 * (i % 3), 5.0 * (i // 3), 0.0, 0.0, 0.0, 0.0, 1.0, 1.0, None, None, None, None, None) for i in range(9)]
    rows += [("B1", "full", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 4.0, 5.0, None, None, None), ("B2", "full", 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0, None, None, None, None, None)]
    got = {r["hole_id"]: r["burden_est_m"] for r in fill_burden_spacing(holes(spark, rows)).collect()}
    assert got["A4"] == 5.0 and got["B1"] == 4.0 and got["B2"] is None
    assert got["A0"] == pytest.approx(np.median([5, 5, 5 * math.sqrt(2), 10]))


def site_frame(spark, pts, event="E"):
    return spark.createDataFrame([(f"h{i}", event, None if a is None else float(a), None if b is None else float(b)) for i, (a, b) in enumerate(pts)], "hole_id string, event string, x double, y double")


def ring(*pts):
    return [dict(x=float(x), y=float(y)) for x, y in pts]


RING = "event string, ring array<struct<x:double,y:double>>"


def test_influence_conserves_the_polygon(spark):
    pts = [(100 + 2.5 + 5 * i, 200 + 2.5 + 5 * j) for i in range(3) for j in range(3)]
    poly = spark.createDataFrame([("E", ring((100, 200), (115, 200), (115, 215), (100, 215)))], RING)
    rows = influence.influence_areas(site_frame(spark, pts), ["event"], poly).collect()
    assert sum(r["area_m2"] for r in rows) == pytest.approx(225) and all(r["area_m2"] == pytest.approx(25) for r in rows)
    assert {r["area_status"] for r in rows} == {"clipped_to_blast_polygon"} and rows[0]["conservation_ok"]


def test_influence_special_collars(spark):
    pts = [(1, 1), (9, 1), (9, 9), (1, 9), (1, 1), (50, 50), (None, 3), (0, 5)]
    poly = spark.createDataFrame([("E", ring((0, 0), (10, 0), (10, 10), (0, 10)))], RING)
    got = {r["hole_id"]: r for r in influence.influence_areas(site_frame(spark, pts), ["event"], poly).collect()}
    assert got["h0"]["area_m2"] == pytest.approx(got["h4"]["area_m2"]) and got["h0"]["collar_domain_status"] == "DUPLICATE_INSIDE"
    assert got["h5"]["area_status"] == "outside_domain" and got["h5"]["area_m2"] == 0 and got["h6"]["area_status"] == "invalid_coordinates"
    assert got["h7"]["collar_domain_status"] == "BOUNDARY" and sum(r["area_m2"] for r in got.values()) == pytest.approx(100)


@pytest.mark.parametrize("shape,code", [(ring((0, 0), (1, 1)), "DOMAIN_TOO_FEW_VERTICES"), (ring((0, 0), (9, 9), (9, 0), (0, 9)), "DOMAIN_SELF_INTERSECTING_OR_INVALID"),
                                        (ring((0, 0), (5, 5), (9, 9)), "DOMAIN_DEGENERATE_AREA_ZERO")])
def test_broken_polygon_blocks_event(spark, shape, code):
    pts = [(1, 1), (2, 1), (2, 2), (1, 2)]
    rows = influence.influence_areas(site_frame(spark, pts), ["event"], spark.createDataFrame([("E", shape)], RING)).collect()
    # a bow-tie has zero signed area as well
    assert {r["domain_error_code"] for r in rows} <= {code, "DOMAIN_DEGENERATE_AREA_ZERO"} and {r["area_m2"] for r in rows} == {0.0}


def test_influence_few_sites(spark):
    rows = influence.influence_areas(site_frame(spark, [(0, 0), (1, 0), (0, 1)]), ["event"]).collect()
    assert all(r["area_m2"] is None and r["area_status"] == "invalid" for r in rows)


@pytest.mark.parametrize("tile,most", [(48, 512), (4, 6)])
def test_cells_equal_nearest_site_sampling(spark, tile, most):
    rng = np.random.default_rng(2)
    pts = np.vstack([rng.uniform(0, 100, (40, 2)), rng.normal(20, 1.5, (60, 2)), [[0, 0], [100, 100]]])
    box = ring((pts[:, 0].min(), pts[:, 1].min()), (pts[:, 0].max(), pts[:, 1].min()), (pts[:, 0].max(), pts[:, 1].max()), (pts[:, 0].min(), pts[:, 1].max()))
    sites = spark.createDataFrame([("E", float(x), float(y), box) for x, y in pts], "event string, x double, y double, ring array<struct<x:double,y:double>>")
    got = {(r["x"], r["y"]): r["area"] for r in influence.site_cells(sites, ["event"], tile, most).collect()}
    # every site against every other one, by the same half-plane rule
    for x, y in pts:
        cell, _ = influence._cell(x, y, influence._start(box), pts)
        assert got[(x, y)] == pytest.approx(influence._shoelace(cell))
    width = pts[:, 0].max() - pts[:, 0].min(), pts[:, 1].max() - pts[:, 1].min()
    assert sum(got.values()) == pytest.approx(width[0] * width[1])


def test_pattern_polygons_overlap(spark):
    pts = [(1, 1), (4, 1), (4, 4), (1, 4)] + [(11, 1), (14, 1), (14, 4), (11, 4)]
    h = site_frame(spark, pts).withColumn("malla", F.when(F.col("x") < 10, "A").otherwise("B"))
    schema = "event string, malla string, ring array<struct<x:double,y:double>>"
    apart = spark.createDataFrame([("E", "A", ring((0, 0), (10, 0), (10, 5), (0, 5))), ("E", "B", ring((10, 0), (20, 0), (20, 5), (10, 5)))], schema)
    ok = influence.pattern_influence(h, ["event"], apart).collect()
    assert sum(r["area_m2"] for r in ok) == pytest.approx(100) and all(r["conservation_ok"] for r in ok)
    clash = spark.createDataFrame([("E", "A", ring((0, 0), (12, 0), (12, 5), (0, 5))), ("E", "B", ring((10, 0), (20, 0), (20, 5), (10, 5)))], schema)
    assert influence.polygon_overlaps(clash, ["event"]).first()["overlap_m2"] == pytest.approx(10)
    assert not any(r["conservation_ok"] for r in influence.pattern_influence(h, ["event"], clash).collect())


def test_attribution_ranks_by_charge_over_distance(spark):
    h = spark.createDataFrame([("H1", 10.0, 10.0, 200.0, "M"), ("H2", 2.0, 0.0, 100.0, "M"), ("H3", 6.0, 0.0, 300.0, "M"), ("H4", 8.0, 0.0, 150.0, "M")], "hole_id string, x double, y double, kg double, malla string").withColumn("pit", F.lit(0))
    f = spark.createDataFrame([(0, "S", 1, "crest", 1.0, 0.0, 0.0)], "pit int, section string, bench_num int, feature string, delta_m double, fx double, fy double")
    rows = attribution.attribute_holes(f, h, ["pit"], top_n=3).orderBy("rank").collect()
    assert [r["hole_id"] for r in rows] == ["H2", "H3", "H4"] and rows[0]["n_candidates"] == 4
    assert rows[0]["contribution_pct"] == pytest.approx(25 / (25 + 300 / 36 + 150 / 64 + 1) * 100, abs=0.01)
    assert attribution.nest_attribution(attribution.attribute_holes(f, h, ["pit"]), ["pit"]).first()["top_holes"][0]["hole_id"] == "H2"


def test_energy_grid_equals_the_plain_sum(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [("A", *map(float, rng.uniform(0, 3000, 2)), 100.0, *map(float, rng.uniform(0, 3000, 2)), 85.0, float(rng.uniform(1, 9))) for _ in range(60)]
    rows += [("A", 5.0, 5.0, 100.0, 5.0, 5.0, 100.0, 3.0)] * 4 + [("B", 7.0, 8.0, 90.0, 7.0, 8.0, 80.0, None), ("B", 7.0, 8.0, 90.0, 7.0, 8.0, 80.0, 2.0), ("A", 1.0, 1.0, 1.0, None, 1.0, 1.0, 5.0)]
    holes = spark.createDataFrame(rows, "pit string, x double, y double, z_collar double, x_toe double, y_toe double, z_toe double, kg double").repartition(5)
    monkeypatch.setattr(attribution, "TILE", 7)
    monkeypatch.setattr(attribution, "TERMS", 50)
    for shape in ((5, 4, 3), (2, 2, 2), (11, 3, 2)):
        got = {(r["pit"], r["ix"], r["iy"], r["iz"]): (r["x"], r["y"], r["z"], r["energy"]) for r in attribution.energy_grid(holes, ["pit"], *shape, radius=12.0).collect()}
        assert len(got) == 2 * shape[0] * shape[1] * shape[2]
        for pit in "AB":
            h = np.array([r[1:] for r in rows if r[0] == pit and r[4] is not None], float)
            h[np.isnan(h[:, 6]), 6] = 0.0
            low, high = np.r_[h[:, :2].min(0), h[:, 5].min()], np.r_[h[:, :2].max(0), h[:, 2].max()]
            flat = high - low < 1e-9
            low, high = np.where(flat, low - 12.0, low), np.where(flat, high + 12.0, high)
            for (p, *at), (x, y, z, e) in got.items():
                if p != pit:
                    continue
                spot = low + np.array(at) * (high - low) / (np.array(shape) - 1)
                assert np.allclose(spot, (x, y, z))
                v, w = h[:, 3:6] - h[:, :3], spot - h[:, :3]
                t = np.clip((w * v).sum(1) / np.where((v * v).sum(1) == 0, 1e-6, (v * v).sum(1)), 0, 1)
                d2 = np.maximum(((w - t[:, None] * v) ** 2).sum(1), 1e-4)
                assert e == pytest.approx(float((h[:, 6] * np.exp(-d2 / 288)).sum()), rel=1e-9, abs=1e-300)
    assert attribution.energy_grid(holes.limit(0), ["pit"]).count() == 0


def test_energy_density_zero_far_away(spark):
    h = spark.createDataFrame([("H1", 0.0, 0.0, 100.0, "M", 0)], "hole_id string, x double, y double, kg double, malla string, pit int")
    p = spark.createDataFrame([(0, 10.0, 0.0), (0, 500.0, 0.0), (0, 0.0, 0.0)], "pit int, fx double, fy double")
    got = {r["fx"]: r["energy"] for r in attribution.energy_density(p, h, ["pit"]).collect()}
    assert got == {10.0: pytest.approx(1.0), 500.0: 0.0, 0.0: pytest.approx(1e6)}


def test_drill_compliance_wraps_azimuth(spark):
    schema = "row_id string, pozo string, x double, y double, z_collar double, incl double, az double, len double, kg double"
    d = spark.createDataFrame([("d1", "H-1", 100.0, 200.0, 1015.0, 10.0, 359.0, 16.0, 100.0), ("d2", "H-1", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), ("d3", "H-9", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)], schema)
    a = spark.createDataFrame([("a1", "H-1", 100.4, 200.0, 1015.0, 10.0, 1.0, 16.0, 105.0), ("a2", "H-7", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, None)], schema)
    p = drilling.match_by_label(d, a)
    r = drilling.compliance_rows(p).first()
    assert r["delta_az"] == 2.0 and r["delta_kg_pct"] == 5.0 and r["all_within_tol"]
    assert {(x["side"], x["row_id"]) for x in drilling.unmatched(p, d, a).collect()} == {("design", "d2"), ("design", "d3"), ("actual", "a2")}
    assert drilling.compliance_summary(drilling.compliance_rows(p)).first()["compliance_score"] == 1.0


def test_last_event_and_hardness(spark):
    ev = spark.sql("""SELECT * FROM VALUES (1L, 'H-1', TIMESTAMP_NTZ'2026-01-01 08:20:00', 20D, 17D), (2L, 'H-1', TIMESTAMP_NTZ'2026-01-01 12:00:00', 60D, 18D), (3L, 'H-1', TIMESTAMP_NTZ'2026-01-01 09:00:00', 5D, 9D)
        AS t(event_id, pozo, tiempo_final, duration_min, depth_m)""").withColumn("rig", F.lit("R1"))
    got = drilling.with_hardness(drilling.last_event_per_hole(ev)).first()
    assert (got["duration_min"], got["depth_m"], got["tasa_penetracion"], got["dureza"]) == (60.0, 18.0, 0.3, "roca muy dura")
    assert drilling.with_rig_zscore(drilling.with_hardness(ev)).where("rig_zscore <> 0").count() == 3


def test_multivariate_recovers_coefficients(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 4))
    y = 0.3 + x @ [1.2, -0.5, 0.1, 0.2] + rng.normal(0, 0.05, 40)
    df = spark.createDataFrame([tuple(map(float, (*r, v))) for r, v in zip(x, y)], "pf_vol double, burden double, spacing_burden_ratio double, stemming double, avg_over_break double")
    m = models.fit_multivariate(df).first()
    a = np.column_stack([np.ones(40), x])
    beta, *_ = np.linalg.lstsq(a, y, rcond=None)
    s2 = ((y - a @ beta) ** 2).sum() / 35
    se = np.sqrt(np.diag(np.linalg.inv(a.T @ a)) * s2)
    for k, name in enumerate(models.PREDICTORS, 1):
        assert m["coefficients"][name] == pytest.approx(beta[k]) and m["std_errors"][name] == pytest.approx(se[k])
    assert m["confidence"] == "HIGH" and m["f_pvalue"] < 1e-10
    low = models.fit_multivariate(df.limit(5)).first()
    assert low["confidence"] == "INSUFFICIENT" and low["coefficients"] == {}
    same = models.fit_multivariate(df.withColumn("burden", F.col("pf_vol") * 2)).first()
    assert same["confidence"] == "CAUTION" and same["collinearity_warning"]


def test_line_fit_and_advice(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(0.2, 0.6, 30)
    y = -0.2 + 2 * x + rng.normal(0, 0.02, 30)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(float("nan"), 1.0), (-1.0, 1.0)], "x double, y double")
    m = models.fit_line(df, "x", "y")
    r = m.first()
    slope, icept = np.polyfit(x, y, 1)
    sxx = ((x - x.mean()) ** 2).sum()
    se = np.sqrt(((y - icept - slope * x) ** 2).sum() / 28 / sxx)
    assert r["n"] == 30 and r["beta1"] == pytest.approx(slope) and r["std_err_beta1"] == pytest.approx(se) and r["confidence"] == "HIGH"
    assert r["ci_beta1_high"] == pytest.approx(slope + 2.048407 * se, rel=1e-6)
    rec = models.recommend_pf(spark.createDataFrame([(0.40,), (0.9,)], "current_pf double"), m).orderBy("current_pf").collect()
    assert rec[0]["target_pf"] == pytest.approx((0.5 - icept) / slope) and rec[0]["feasibility"] == "APPLICABLE" and rec[0]["message"].startswith("Reducir PF de 0.40")
    assert rec[1]["feasibility"] == "CAUTION"
    none = models.recommend_pf(spark.createDataFrame([(0.4,)], "current_pf double"), models.fit_line(df.limit(3), "x", "y")).first()
    assert none["feasibility"] == "INSUFFICIENT_DATA" and none["target_pf"] == 0.4


def test_backbreak_substitutes_missing_inputs(spark):
    df = spark.createDataFrame([(1, 6.0, 7.0, 0.35, 6.0), (2, None, 7.0, 0.35, -1.0), (3, None, None, None, None)], "id int, burden_m double, spacing_m double, pf_kgm3 double, stemming_m double")
    a, b, c = models.predict_backbreak(df).orderBy("id").collect()
    assert a["predicted_m"] == pytest.approx(1.8) and a["confidence"] == "MEDIUM" and a["notes"] == []
    assert b["confidence"] == "LOW" and b["notes"] == ["substituted:burden_m", "substituted:stemming_m"] and c["confidence"] == "INSUFFICIENT" and c["predicted_m"] == 0


def test_face_angle_solver(spark):
    df = spark.createDataFrame([(1, 15.0, 20.0, 35.0), (2, 15.0, 0.0, 3.0), (3, 1.0, 5000.0, 45.0), (4, 15.0, None, 35.0)], "id int, height_m double, cohesion_kpa double, friction_deg double")
    got = {r["id"]: r["suggested_angle_deg"] for r in stability.suggest_face_angle(df).collect()}
    fs = lambda a: 20 / (27 * 15 * math.sin(math.radians(a)) * math.cos(math.radians(a))) + math.tan(math.radians(35)) / math.tan(math.radians(a))
    assert fs(got[1]) >= 1.3 > fs(got[1] + 0.05) and got[2] == 30.0 and 44 <= got[3] <= 60 and got[4] is None
    with pytest.raises(ValueError):
        stability.suggest_face_angle(df, fs_target=0.9)


def test_rock_lookup_takes_closest_level(spark):
    table = spark.createDataFrame([(1, "A", 100.0, 50.0), (2, "A", 103.0, 60.0), (3, "B", 100.0, 70.0)], "rock_id int, sector string, level double, rmr double")
    q = spark.createDataFrame([(1, "A", 102.0), (2, "A", 97.5), (3, "A", 94.9), (4, "C", 100.0)], "q int, sector string, level double")
    got = {r["q"]: r["rock_rmr"] for r in stability.rock_mass_lookup(q, table).collect()}
    assert got == {1: 60.0, 2: 50.0, 3: None, 4: None}


def test_section_health_empty_section_is_red(spark):
    b = spark.createDataFrame([("S", 1, 70.0, False, 1.0, 0.0, False, False, 9.0)], "section string, bench_number int, face_angle double, is_ramp boolean, catch_bench_ratio double, overhang_m double, wedge_risk boolean, toppling_risk boolean, berm_width double")
    got = {r["section"]: r for r in stability.section_health(b, spark.createDataFrame([("S",), ("T",)], "section string")).collect()}
    assert got["T"]["health_category"] == "RED" and got["T"]["health_score"] == 0
    fs = math.tan(math.radians(35)) / math.tan(math.radians(70))
    assert got["S"]["health_score"] == pytest.approx(0.3 * 50 * fs + 70)


def test_exchange_formats():
    assert exchange.detect_format(["BHID", "XCOLLAR", "YCOLLAR", "ZCOLLAR", "DIP"]) == "datamine"
    assert exchange.detect_format(["HoleID", "XCOLLAR"]) == "surpac" and exchange.detect_format(["a"]) == "unknown"
    assert exchange.detect_format(exchange.REQUIRED) == "exchange" and len(exchange.FIELDS) >= 30


def test_exchange_validation(spark):
    good = {f: "1" for f in exchange.REQUIRED} | {"explosive_type": "ANFO", "shot_at": "2026-01-01T10:00:00-03:00"}
    bad = good | {"dip": "120", "explosive_type": "X", "shot_at": "2026-01-01", "hole_id": "", "burden": "q"}
    df = spark.createDataFrame([(*good.values(), "g"), (*bad.values(), "b")], ", ".join(f"{f} string" for f in good) + ", row_key string")
    got = {(r["row_key"], r["code"], r["field"]) for r in exchange.validate(df, "row_key").collect()}
    assert got == {("b", "OUT_OF_RANGE", "dip"), ("b", "NOT_IN_ENUM", "explosive_type"), ("b", "BAD_TIMESTAMP", "shot_at"), ("b", "MISSING_REQUIRED", "hole_id"), ("b", "NOT_NUMERIC", "burden")}
    assert exchange.validation_summary(df, "row_key").first().asDict() == {"n_rows": 2, "n_errors": 4, "n_warnings": 1, "valid": False}
    collar = exchange.from_collar_table(spark.createDataFrame([("h", 1.0, 2.0)], "BHID string, XCOLLAR double, LENGTH double"), "datamine").first()
    assert collar["hole_id"] == "h" and collar["hole_length_actual"] == 2.0
    assert set(exchange.union_files(df.select("row_key"), df.select("hole_id")).columns) == {"row_key", "hole_id"}


def test_rows_meet_the_model_of_their_group(spark):
    rows = [(g, 0.1 * i, slope * 0.1 * i + (i % 2) * 0.01) for g, slope in (("A", 2.0), ("B", 5.0), (None, 1.0)) for i in range(1, 13)]
    fitted = models.fit_line(spark.createDataFrame(rows, "sector string, x double, y double"), "x", "y", ["sector"])
    asked = spark.createDataFrame([("A", 1.0), ("B", 1.0), (None, 1.0), ("C", 1.0)], "sector string, target_pf double")
    got = {r["sector"]: r["predicted_damage"] for r in models.predict_damage(asked, fitted, group=["sector"]).collect()}
    assert {k: round(v) for k, v in got.items()} == {"A": 2, "B": 5, None: 1, "C": 0}
    with pytest.raises(Exception, match="more than one model row"):
        models.predict_damage(asked, fitted.drop("sector")).collect()
