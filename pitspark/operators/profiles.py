"""Benches from profiles: simplify, classify runs, build faces, vote, floors, berms, hazards, angles, reconciled lines.

A profile is the set of rows sharing the profile keys, with idx, d (distance) and z (elevation), or packed
(``surfaces.stretches``). What needs its points runs in Python, one profile at a time: the polyline simplification and what
the points say of each bench. So points of packed profiles are made and used in the same task, never shuffled, sorted or
written; everything else is joins, windows and aggregates over the few kept vertices and the benches. Profiles longer than
``PIECE`` points go through joins and windows instead.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DETECTION, RAMP, Detection
from ..functions.geometry import steepness
from ..functions.numeric import clamp
from ..session import cut_lineage
from .spatial import interval_join
from .surfaces import PIECE, by_length, is_packed, node_rows, nodes_of

KEYS = ["surface_id", "kind", "section", "sector"]


def kept_vertices(d: np.ndarray, z: np.ndarray, tolerance: float) -> np.ndarray:
    """Mask of the points a polyline keeps when every dropped point is within ``tolerance`` of its chord."""
    keep = np.zeros(len(d), bool)
    keep[[0, -1]] = True
    todo = [(0, len(d) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        dx, dz = d[b] - d[a], z[b] - z[a]
        px, pz = d[a + 1:b] - d[a], z[a + 1:b] - z[a]
        chord = math.hypot(dx, dz)
        off = np.hypot(px, pz) if chord == 0 else np.abs(dx * pz - dz * px) / chord
        k = int(np.argmax(off))
        if off[k] > tolerance:
            k += a + 1
            keep[k] = True
            todo += [(a, k), (k, b)]
    return keep


def simplify(points: DataFrame, keys: list[str], tolerance: float = DETECTION.simplify_epsilon, piece: int = PIECE) -> DataFrame:
    """Simplified vertices of every profile (keys, idx, d, z); profiles without a full key keep their last point only."""
    return _simplified(*by_length(points, keys, piece), keys, tolerance, piece)


def _simplified(short: DataFrame, long: DataFrame | None, keys: list[str], tolerance: float, piece: int) -> DataFrame:
    def whole(profile: pa.Table) -> pa.Table:
        idx, d, z = nodes_of(profile)
        order = np.argsort(idx, kind="stable")
        order = order[~np.isnan(idx[order])]
        idx, d, z = idx[order], d[order], z[order]
        # of points with the last number one is kept
        at = np.append(np.flatnonzero(idx < idx[-1]), len(idx) - 1) if len(idx) else order
        if any(profile.column(k)[0].as_py() is None for k in keys):
            at = at[-1:]
        elif len(at):
            at = at[kept_vertices(d[at], z[at], tolerance)]
        own = profile.select(keys).take(np.zeros(len(at), int))
        for name, kind, values in (("idx", pa.int64(), idx), ("d", pa.float64(), d), ("z", pa.float64(), z)):
            own = own.append_column(name, pa.array(values[at], from_pandas=True).cast(kind))
        return own

    types, kind = dict(short.dtypes), dict(node_rows(short, keys).dtypes)["idx"]
    out = short.groupBy(*keys).applyInArrow(whole, ", ".join(f"`{c}` {types[c]}" for c in keys) + ", idx long, d double, z double")
    out = out.withColumn("idx", F.col("idx").cast(kind))
    return out if long is None else out.unionByName(_simplify_long(long, keys, tolerance, piece))


def _simplify_long(points: DataFrame, keys: list[str], tolerance: float, piece: int) -> DataFrame:
    """Both sides of a split point simplify independently. Pieces longer than ``piece`` points are therefore split by
    distributed rounds first, each finding the farthest point of every long piece by one aggregate; then all pieces
    go through the same rule in parallel tasks.
    """
    end = points.groupBy(*keys).agg(F.max_by(F.struct("idx", "d", "z"), "idx").alias("hi"), F.min_by(F.struct("idx", "d", "z"), "idx").alias("lo"),
                                    F.count(F.lit(1)).alias("_n"))
    tail = end.select(*keys, "hi.idx", "hi.d", "hi.z")
    work = points.join(end.hint("merge"), keys).where(F.col("idx") < F.col("hi.idx"))
    part = [*keys, F.col("lo.idx")]
    longest = end.agg(F.max("_n")).first()[0] or 0
    while longest > piece:
        size = work.groupBy(*part).agg(F.count(F.lit(1)).alias("_c"))
        size = size.withColumnRenamed("lo.idx", "idx").toDF(*keys, "_lo", "_c")
        work = work.withColumn("_lo", F.col("lo.idx")).join(size.hint("merge"), [*keys, "_lo"])
        dx, dz = F.col("hi.d") - F.col("lo.d"), F.col("hi.z") - F.col("lo.z")
        px, pz = F.col("d") - F.col("lo.d"), F.col("z") - F.col("lo.z")
        chord = F.sqrt(dx * dx + dz * dz)
        off = F.when(chord == 0, F.sqrt(px * px + pz * pz)).otherwise(F.abs(dx * pz - dz * px) / chord)
        far = work.where((F.col("_c") > piece) & (F.col("idx") > F.col("lo.idx"))).groupBy(*keys, "_lo").agg(
            F.max_by(F.struct("idx", "d", "z"), F.struct(off, -F.col("idx"))).alias("_cut"), F.max(off).alias("_off"))
        work = work.join(far.hint("merge"), [*keys, "_lo"], "left")
        cut = F.coalesce(F.col("_off") > tolerance, F.lit(False))
        work = work.where(F.col("_off").isNull() | cut | (F.col("idx") == F.col("lo.idx"))).withColumns({
            "lo": F.when(cut & (F.col("idx") >= F.col("_cut.idx")), F.col("_cut")).otherwise(F.col("lo")),
            "hi": F.when(cut & (F.col("idx") < F.col("_cut.idx")), F.col("_cut")).otherwise(F.col("hi"))}).drop("_lo", "_c", "_cut", "_off")
        work = cut_lineage(work)
        longest = work.groupBy(*part).agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0]

    flat = work.select(*keys, F.col("lo.idx").alias("lo_idx"), "idx", "d", "z", F.col("hi.d").alias("hi_d"), F.col("hi.z").alias("hi_z"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        mask = kept_vertices(np.append(pdf.d.to_numpy(), pdf.hi_d.iloc[0]), np.append(pdf.z.to_numpy(), pdf.hi_z.iloc[0]), tolerance)
        return pdf.loc[mask[:-1], [*keys, "idx", "d", "z"]]

    types = dict(points.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in [*keys, "idx", "d", "z"])
    return flat.groupBy(*keys, "lo_idx").applyInPandas(run, schema).unionByName(tail)


def segments(vertices: DataFrame, keys: list[str], cfg: Detection = DETECTION) -> DataFrame:
    """Vertex pairs with length, slope, class (1 face, 2 berm, 0 between) and run number of equal classes."""
    w = Window.partitionBy(*keys).orderBy("idx")
    s = vertices.withColumns({"vno": F.row_number().over(w), "d1": F.lead("d").over(w), "z1": F.lead("z").over(w)}).where("d1 IS NOT NULL")
    dx, dz = F.col("d1") - F.col("d"), F.col("z1") - F.col("z")
    s = s.withColumn("len", F.sqrt(dx * dx + dz * dz)).withColumn("angle", F.when(F.col("len") > 1e-4, steepness(dz, dx)).otherwise(0.0))
    s = s.withColumn("seg_class", F.when(F.col("angle") >= cfg.face_threshold, 1).when(F.col("angle") <= cfg.berm_threshold, 2).otherwise(0))
    step = (F.lag("seg_class").over(w) != F.col("seg_class")).cast("int")
    return s.withColumn("_new", F.coalesce(step, F.lit(0))).withColumn("run", F.sum("_new").over(w)).drop("_new")


def faces(segs: DataFrame, keys: list[str], cfg: Detection = DETECTION, angle_scope: str = "face", crest_first: bool = True) -> DataFrame:
    """One bench per face run: crest, toe (projected through a spill pile), height, angle, spill."""
    if angle_scope not in ("face", "profile"):
        raise ValueError("angle_scope is 'face' or 'profile'")
    run = [*keys, "run"]
    face = segs.where("seg_class = 1")
    w = Window.partitionBy(*run)
    ends = face.withColumns({
        "_first_z": F.min_by("z", "vno").over(w), "_last_z": F.max_by("z1", "vno").over(w), "_n": F.count(F.lit(1)).over(w)})
    ends = ends.where(F.abs(F.col("_first_z") - F.col("_last_z")) >= cfg.min_bench_height)
    # order the pieces from crest to toe
    up = (F.col("_first_z") < F.col("_last_z")) & F.lit(crest_first)
    ends = ends.withColumn("_pos0", F.when(up, -F.col("vno")).otherwise(F.col("vno")))
    o = Window.partitionBy(*run).orderBy("_pos0")
    pt = lambda d, z: F.struct(F.col(d).alias("d"), F.col(z).alias("z"))
    ends = ends.withColumns({
        "pos": F.row_number().over(o) - 1, "start": F.when(up, pt("d1", "z1")).otherwise(pt("d", "z")), "end": F.when(up, pt("d", "z")).otherwise(pt("d1", "z1")),
        "_solid": F.max("angle").over(o.rowsBetween(Window.unboundedPreceding, -1))})
    pile = (F.col("angle") < cfg.spill_angle_pile) & F.coalesce(F.col("_solid") > cfg.spill_angle_solid, F.lit(False))
    ends = ends.withColumn("spill_idx", F.max(F.when(~pile, F.col("pos") + 1)).over(w))
    within = F.col("pos") <= F.col("spill_idx")
    last = F.col("pos") == F.col("_n") - 1
    # points of the solid part: starts up to the spill index, and the final end when nothing spilled
    solid = ends.withColumn("_pts", F.array_compact(F.array(F.when(within, F.col("start")), F.when(last & (F.col("spill_idx") == F.col("_n")), F.col("end")))))
    spill_pt = F.coalesce(F.max(F.when(F.col("pos") == F.col("spill_idx"), F.col("start"))), F.max(F.when(last, F.col("end"))))
    steep = F.col("angle") > cfg.face_threshold - cfg.face_threshold_margin
    base = ends.groupBy(*run).agg(
        F.max("_n").alias("n_seg"), F.max(F.when(F.col("pos") == 0, F.col("start"))).alias("head"), F.max(F.when(last, F.col("end"))).alias("foot"),
        spill_pt.alias("spill_pt"),
        F.greatest(F.max(F.struct(F.col("z").alias("z"), (-F.col("vno")).alias("o"), F.col("d").alias("d"))),
                   F.max(F.struct(F.col("z1").alias("z"), (-F.col("vno") - 1).alias("o"), F.col("d1").alias("d")))).alias("crest"),
        F.least(F.min(F.struct(F.col("z").alias("z"), F.col("vno").alias("o"), F.col("d").alias("d"))),
                F.min(F.struct(F.col("z1").alias("z"), (F.col("vno") + 1).alias("o"), F.col("d1").alias("d")))).alias("toe"),
        F.sum(F.when(steep, F.col("len"))).alias("sl"), F.sum(F.when(steep, F.col("len") * F.col("angle"))).alias("sa"),
        F.sum("len").alias("al"), F.sum(F.col("len") * F.col("angle")).alias("aa"))
    fit = solid.select(*run, F.explode("_pts").alias("p")).groupBy(*run).agg(
        F.regr_slope("p.d", "p.z").alias("slope"), F.regr_intercept("p.d", "p.z").alias("icept"), F.var_pop("p.z").alias("vz"))
    out = base.join(fit.hint("merge"), run)
    if angle_scope == "profile":
        whole = segs.groupBy(*keys).agg(F.sum(F.when(steep, F.col("len"))).alias("sl"), F.sum(F.when(steep, F.col("len") * F.col("angle"))).alias("sa"),
                                        F.sum("len").alias("al"), F.sum(F.col("len") * F.col("angle")).alias("aa"))
        out = out.drop("sl", "sa", "al", "aa").join(whole.hint("merge"), keys)
    weighted = F.when(F.col("sl") > 0.1, F.col("sa") / F.col("sl")).otherwise(F.col("aa") / F.col("al"))
    dx = F.abs(F.col("head.d") - F.col("foot.d"))
    plain = F.when(dx > 1e-3, F.degrees(F.atan2(F.col("head.z") - F.col("foot.z"), dx))).otherwise(cfg.face_threshold)
    projected = (F.col("n_seg") >= 2) & (F.col("vz") > 1e-4)
    x = F.greatest(F.least(F.col("head.d"), F.col("foot.d")), F.least(F.greatest(F.col("head.d"), F.col("foot.d")), F.col("slope") * F.col("foot.z") + F.col("icept")))
    lean = F.when(F.abs("slope") > 1e-4, F.degrees(F.atan2(F.lit(1.0), F.abs("slope")))).otherwise(90.0)
    out = out.withColumns({"_x": F.when(projected, x).otherwise(F.col("foot.d")), "_lean": F.when(projected, lean).otherwise(plain), "_flat": weighted,
                           "_sp": F.when(projected, F.col("spill_pt")).otherwise(F.col("foot"))})
    moved = F.abs(F.col("_x") - F.col("toe.d")) > 1e-3
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("run"))
    return out.select(
        *keys, number.alias("bench_number"), F.col("crest.z").alias("crest_elevation"), F.col("crest.d").alias("crest_distance"),
        F.col("toe.z").alias("toe_elevation"), F.when(moved, F.col("_x")).otherwise(F.col("toe.d")).alias("toe_distance"),
        (F.col("crest.z") - F.col("toe.z")).alias("bench_height"), F.when(moved, F.col("_lean")).otherwise(F.col("_flat")).alias("face_angle"),
        F.when(moved, F.abs(F.col("toe.d") - F.col("_x"))).otherwise(0.0).alias("spill_width"), F.col("_sp.d").alias("spill_start_distance"),
        F.col("_sp.z").alias("spill_start_elevation"), F.col("toe.d").alias("_toe_seen"))


def smoothing_weights(order: int = 3) -> dict[int, np.ndarray]:
    """Projection matrices of a cubic fit over 5, 7, 9 and 11 points: row i gives the smoothed value at position i."""
    out = {}
    for n in range(DETECTION.smoothing_min_window, DETECTION.smoothing_max_window + 1, 2):
        a = np.vander(np.arange(n) - (n - 1) / 2, order + 1)
        out[n] = a @ np.linalg.pinv(a)
    return out


WEIGHTS = smoothing_weights()


def votes(points: DataFrame, benches: DataFrame, keys: list[str], cfg: Detection = DETECTION) -> DataFrame:
    """How many of four methods call a face span a bench, and its point count."""
    w = Window.partitionBy(*keys).orderBy("idx")
    whole = Window.partitionBy(*keys)
    nxt, prv = (lambda c: F.lead(c).over(w)), (lambda c: F.lag(c).over(w))
    out_a = F.atan2(nxt("z") - F.col("z"), nxt("d") - F.col("d"))
    in_a = F.atan2(F.col("z") - prv("z"), F.col("d") - prv("d"))
    seen = points.withColumns({"_n": F.count(F.lit(1)).over(whole), "_i": F.row_number().over(w) - 1, "curv": F.degrees(F.abs(out_a - in_a)),
                               "_in": F.signum(F.col("z") - prv("z")), "_out": F.signum(nxt("z") - F.col("z"))})
    k = cfg.extrema_window
    mid = (F.col("_i") >= k) & (F.col("_i") < F.col("_n") - k) & (F.col("_n") >= 2 * k + 1)
    seen = seen.select(*keys, "idx", "d", "z", "_n", "_i", F.coalesce(F.col("curv"), F.lit(0.0)).alias("curv"),
                       F.coalesce(mid & (F.col("_in") >= 0) & (F.col("_out") < 0), F.lit(False)).alias("is_crest"),
                       F.coalesce(mid & (F.col("_in") < 0) & (F.col("_out") >= 0), F.lit(False)).alias("is_toe"))
    lo, hi = F.least("crest_distance", "_toe_seen"), F.greatest("crest_distance", "_toe_seen")
    spans = benches.select(*keys, "bench_number", lo.alias("_lo"), hi.alias("_hi")).withColumn("_zone", F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-6)) * 0.4 + 2.0)
    spans = spans.withColumns({"_from": F.col("_lo") - F.col("_zone"), "_to": F.col("_hi") + F.col("_zone")})
    near = interval_join(seen, spans, keys, "d", "_from", "_to", 25.0)
    sharp = F.col("curv") > cfg.curvature_threshold
    band = (F.col("d") >= F.col("_lo")) & (F.col("d") <= F.col("_hi"))
    span_mask = F.col("d").between(F.col("_lo") - 0.1, F.col("_hi") + 0.1)
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    pick = F.struct("_i", "d")
    agg = near.groupBy(*keys, "bench_number").agg(
        any_(sharp & (F.col("d") <= F.col("_lo") + F.col("_zone"))).alias("_left"), any_(sharp & (F.col("d") >= F.col("_hi") - F.col("_zone"))).alias("_right"),
        any_("is_crest").alias("_crest"), any_("is_toe").alias("_toe"), F.count_if(span_mask).alias("source_points"), F.count_if(band).alias("_nb"),
        F.min(F.when(band, pick)).alias("_a"), F.max(F.when(band, pick)).alias("_b"), F.first("_n").alias("_n"))
    # smoothed height at both ends of the band: the window that covers each end, weighted
    raw = F.least(F.greatest(F.floor(F.col("_n") / 30), F.lit(cfg.smoothing_min_window)), F.lit(cfg.smoothing_max_window)).cast("int")
    odd = raw + (raw + 1) % 2
    size = F.when(odd >= F.col("_n"), F.when(F.col("_n") % 2 == 1, F.col("_n")).otherwise(F.col("_n") - 1)).otherwise(odd).cast("int")
    size = F.when(size >= cfg.smoothing_min_window, size).otherwise(1)
    needs = agg.where("_nb >= 2").withColumn("_size", size).select(
        *keys, "bench_number", "_size", "_n", F.explode(F.array(F.struct(F.lit(0).alias("e"), F.col("_a._i").alias("i")), F.struct(F.lit(1).alias("e"), F.col("_b._i").alias("i")))).alias("q"))
    start = F.greatest(F.lit(0), F.least(F.col("q.i") - F.floor(F.col("_size") / 2), F.col("_n") - F.col("_size"))).cast("int")
    needs = needs.withColumn("_s", start).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_size") - 1))).withColumn("_i", F.col("_s") + F.col("_j"))
    table = F.array(*[F.lit(float(v)) for m in smoothing_weights().values() for v in m.ravel()])
    offset = F.lit(0)
    total = 0
    for n in smoothing_weights():
        offset = F.when(F.col("_size") == n, total).otherwise(offset)
        total += n * n
    weight = F.when(F.col("_size") == 1, 1.0).otherwise(F.element_at(table, (offset + (F.col("q.i") - F.col("_s")) * F.col("_size") + F.col("_j") + 1).cast("int")))
    smooth = needs.join(seen.select(*keys, "_i", "z").hint("merge"), [*keys, "_i"]).groupBy(*keys, "bench_number").agg(
        F.sum(F.when(F.col("q.e") == 1, weight * F.col("z")).otherwise(-weight * F.col("z"))).alias("_rise"))
    out = agg.join(smooth.hint("merge"), [*keys, "bench_number"], "left")
    dist = F.abs(F.col("_b.d") - F.col("_a.d"))
    slope = F.when(dist > 1e-6, F.abs(F.degrees(F.atan2(F.col("_rise"), dist))))
    n = (F.lit(1) + (F.col("_left") & F.col("_right")).cast("int") + (F.col("_crest") & F.col("_toe")).cast("int")
         + F.coalesce(slope >= cfg.face_threshold - cfg.face_threshold_margin, F.lit(False)).cast("int"))
    return out.select(*keys, "bench_number", F.col("source_points").cast("int").alias("source_points"), n.cast("int").alias("n_detection_methods_agreeing"))


def verdicts(counted: DataFrame, cfg: Detection = DETECTION) -> DataFrame:
    """``counted`` (source_points, n_detection_methods_agreeing) with method name and confidence, null where nothing was counted."""
    seen, agreed = F.col("n_detection_methods_agreeing").isNotNull(), F.col("n_detection_methods_agreeing") >= cfg.consensus_quorum
    density = F.least(F.lit(1.0), F.col("source_points") / float(cfg.confidence_density_floor))
    return counted.withColumns({
        "detection_method": F.when(agreed, "consensus").when(seen, "disputed"),
        "confidence_score": F.when(agreed, F.least(F.lit(1.0), F.col("n_detection_methods_agreeing") / 4.0 * density)).when(seen, 0.5)})


def local_floors(points: DataFrame, benches: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of the lowest tenth (at least three) of the profile between a toe and the next crest."""
    w = Window.partitionBy(*keys).orderBy("bench_number")
    reach = points.groupBy(*keys).agg(F.max("d").alias("_dmax"))
    b = benches.withColumn("_next", F.lead("crest_distance").over(w)).join(reach.hint("merge"), keys)
    nxt = F.coalesce("_next", F.when(F.col("toe_distance") <= F.col("_dmax"), F.col("_dmax")).otherwise(F.col("toe_distance")))
    spans = b.select(*keys, "bench_number", F.least("toe_distance", nxt).alias("_lo"), F.greatest("toe_distance", nxt).alias("_hi"))
    near = interval_join(points.select(*keys, "d", "z"), spans, keys, "d", "_lo", "_hi", 25.0)
    one = [*keys, "bench_number"]
    size = near.groupBy(*one).agg(F.count(F.lit(1)).alias("_c"))
    rank = F.row_number().over(Window.partitionBy(*one).orderBy("z"))
    low = near.join(size.hint("merge"), one).withColumn("_r", rank).where(F.col("_r") <= F.greatest(F.lit(3), F.floor(F.col("_c") / 10)))
    return low.groupBy(*one).agg(F.avg("z").alias("floor_elevation"))


def extended_toe(b: str = ""):
    """Toe distance after the face is prolonged at its own angle down to the local floor."""
    c = lambda n: F.col(f"{b}{n}")
    a = F.radians(c("face_angle"))
    ahead = F.when(c("toe_distance") >= c("crest_distance"), 1.0).otherwise(-1.0)
    deep = (c("floor_elevation") > 0) & (c("floor_elevation") < c("toe_elevation")) & (a > 0.01)
    return F.when(deep, c("toe_distance") + (c("toe_elevation") - c("floor_elevation")) / F.tan(a) * ahead).otherwise(c("toe_distance"))


def berms(benches: DataFrame, keys: list[str], max_berm: float = DETECTION.max_berm_width, cfg: Detection = DETECTION) -> DataFrame:
    """Berm in front of every lower bench, ramp flags and group breaks."""
    w = Window.partitionBy(*keys).orderBy("bench_number")
    b = benches.withColumn("_right", F.greatest(extended_toe(), F.col("crest_distance")))
    prev = lambda c: F.lag(c).over(w)
    left = F.least("toe_distance", "crest_distance")
    b = b.withColumns({"_w": F.abs(left - prev("_right")), "_ps": prev("spill_width"), "_pz": prev("toe_elevation")})
    drop = F.abs(F.col("crest_elevation") - F.col("_pz"))
    gentle = (F.col("_w") >= cfg.ramp_narrow_min_width) & (steepness(F.col("crest_elevation") - F.col("_pz"), F.col("_w")) < cfg.ramp_max_slope_deg)
    ramp = F.col("_w").between(RAMP.min_width, RAMP.max_width) | ((drop > cfg.ramp_min_descent_m) & gentle)
    no = F.lit(False)
    return b.withColumns({
        "berm_width": F.coalesce("_w", F.lit(0.0)), "effective_berm_width": F.coalesce(F.greatest(F.col("_w") - F.col("_ps"), F.lit(0.0)), F.lit(0.0)),
        "is_ramp": F.when(F.col("_w").isNotNull(), ramp).otherwise(no), "group_break": F.coalesce(F.col("_w") >= max_berm, no)}).drop("_right", "_w", "_ps", "_pz")


def edge_widths(points: DataFrame, benches: DataFrame, keys: list[str], cfg: Detection = DETECTION) -> DataFrame:
    """Width of the flat ground before the first bench and after it (keys, _lead, _trail), 0 where it is not flat."""
    first = benches.where("bench_number = 1").select(*keys, F.least("toe_distance", "crest_distance").alias("_x"), F.col("toe_distance").alias("_t"))
    side = points.join(first.hint("merge"), keys)

    def flat(test, name: str) -> list:
        p = F.struct("d", "z")
        return [F.count_if(test).alias(f"{name}_n"), F.min_by(p, F.when(test, F.col("d"))).alias(f"{name}_a"), F.max_by(p, F.when(test, F.col("d"))).alias(f"{name}_b")]

    agg = side.groupBy(*keys).agg(*flat(F.col("d") < F.col("_x") - 0.1, "lead"), *flat(F.col("d") > F.col("_t") + 0.1, "trail"))
    run = lambda k: F.abs(F.col(f"{k}_b.d") - F.col(f"{k}_a.d"))
    width = lambda k: F.when((F.col(f"{k}_n") >= 2) & (steepness(F.col(f"{k}_b.z") - F.col(f"{k}_a.z"), run(k)) <= cfg.berm_threshold), run(k)).otherwise(0.0)
    return agg.select(*keys, width("lead").alias("_lead"), width("trail").alias("_trail"))


def edge_berms(benches: DataFrame, keys: list[str]) -> DataFrame:
    """Flat ground before the first bench, and after the only one, counted as its berm (widths _lead and _trail)."""
    out = benches.withColumn("_nb", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    is_first = F.col("bench_number") == 1
    lead = F.when(is_first & (F.col("_lead") > 0), F.col("_lead"))
    trail = F.when(is_first & (F.col("_nb") == 1) & F.coalesce(F.col("_lead") <= 0, F.lit(True)) & (F.col("berm_width") <= 0) & (F.col("_trail") > 0), F.col("_trail"))
    extra = F.coalesce(lead, trail)
    return out.withColumns({"berm_width": F.coalesce(extra, F.col("berm_width")),
                            "is_ramp": F.col("is_ramp") | F.coalesce(extra.between(RAMP.min_width, RAMP.max_width), F.lit(False))}).drop("_nb", "_lead", "_trail")


FACTS = "source_points int, n_detection_methods_agreeing int, floor_elevation double, _lead double, _trail double"


class Seen:
    """One profile's points (idx, d, z) and what they say of its benches; the same rules as ``votes``, ``local_floors`` and ``edge_widths``."""

    def __init__(self, idx: np.ndarray, d: np.ndarray, z: np.ndarray, cfg: Detection):
        order = np.argsort(idx, kind="stable")
        self.d, self.z, self.n, self.cfg = d[order], z[order], len(d), cfg
        self.by_d = np.argsort(self.d, kind="stable")  # missing distances come last
        self.sorted_d = self.d[self.by_d]
        self.known = int(np.searchsorted(self.sorted_d, np.inf, "right"))
        dd, dz = np.diff(self.d), np.diff(self.z)
        slope = np.arctan2(dz, dd)
        self.curv = np.zeros(self.n)
        self.curv[1:-1] = np.nan_to_num(np.degrees(np.abs(slope[1:] - slope[:-1])), nan=0.0)
        k, sign = cfg.extrema_window, np.sign(dz)
        self.crest, self.toe = np.zeros(self.n, bool), np.zeros(self.n, bool)
        if self.n >= 2 * k + 1:
            mid = slice(k, self.n - k)
            into, out = sign[k - 1:self.n - k - 1], sign[k:self.n - k]
            self.crest[mid], self.toe[mid] = (into >= 0) & (out < 0), (into < 0) & (out >= 0)

    def between(self, low: float, high: float) -> np.ndarray:
        """Positions of the points with ``low <= d <= high``."""
        a, b = np.searchsorted(self.sorted_d[:self.known], low, "left"), np.searchsorted(self.sorted_d[:self.known], high, "right")
        return self.by_d[a:b]

    def votes(self, crest_distance: float, toe_seen: float) -> tuple[int | None, int | None]:
        cfg, lo, hi = self.cfg, min(crest_distance, toe_seen), max(crest_distance, toe_seen)
        zone = max(hi - lo, 1e-6) * 0.4 + 2.0
        near = self.between(lo - zone, hi + zone)
        if not len(near):
            return None, None
        turns = self.d[near[self.curv[near] > cfg.curvature_threshold]]
        both = bool((turns <= lo + zone).any() and (turns >= hi - zone).any())
        shaped = bool(self.crest[near].any() and self.toe[near].any())
        band, steep = self.between(lo, hi), False
        if len(band) >= 2:
            i, j = int(band.min()), int(band.max())
            run = abs(self.d[j] - self.d[i])
            steep = run > 1e-6 and abs(math.degrees(math.atan2(self.smooth(j) - self.smooth(i), run))) >= cfg.face_threshold - cfg.face_threshold_margin
        return len(self.between(lo - 0.1, hi + 0.1)), 1 + both + shaped + bool(steep)

    def smooth(self, i: int) -> float:
        """Smoothed height at position ``i``: the window that covers it, weighted."""
        cfg, n = self.cfg, self.n
        odd = min(max(n // 30, cfg.smoothing_min_window), cfg.smoothing_max_window)
        odd += (odd + 1) % 2
        size = odd if odd < n else n - 1 + n % 2
        if size < cfg.smoothing_min_window:
            return self.z[i]
        start = max(0, min(i - size // 2, n - size))
        return float(np.nansum(WEIGHTS[size][i - start] * self.z[start:start + size]))

    def floor(self, toe_distance: float, next_crest: float | None) -> float | None:
        """Mean of the lowest tenth (at least three) of the heights between a toe and the next crest or the profile's end."""
        if next_crest is None:
            last = self.sorted_d[self.known - 1] if self.known else math.nan
            next_crest = last if toe_distance <= last else toe_distance
        z = self.z[self.between(min(toe_distance, next_crest), max(toe_distance, next_crest))]
        if not len(z):
            return None
        missing = np.isnan(z)
        most = max(3, len(z) // 10) - int(missing.sum())  # missing heights count as the lowest
        z = z[~missing]
        most = min(most, len(z))
        return float(np.partition(z, most - 1)[:most].mean()) if most > 0 else None

    def flat(self, where: slice) -> float:
        """Run between the outermost of some points by distance, 0 where it is not flat."""
        some = self.by_d[where]
        if len(some) < 2:
            return 0.0
        run, rise = abs(self.d[some[-1]] - self.d[some[0]]), self.z[some[-1]] - self.z[some[0]]
        return float(run) if abs(math.degrees(math.atan2(rise, run))) <= self.cfg.berm_threshold else 0.0

    def edges(self, crest_distance: float, toe_distance: float) -> tuple[float, float]:
        """Flat ground before the first bench and after it."""
        d = self.sorted_d[:self.known]
        return (self.flat(slice(0, int(np.searchsorted(d, min(toe_distance, crest_distance) - 0.1, "left")))),
                self.flat(slice(int(np.searchsorted(d, toe_distance + 0.1, "right")), self.known)))


def bench_facts(short: DataFrame, long: DataFrame | None, benches: DataFrame, keys: list[str], cfg: Detection = DETECTION) -> DataFrame:
    """What a profile's points say of each bench: point count and votes, local floor, flat ground at its sides.

    Points and benches of a profile of up to ``PIECE`` points meet in one call, long profiles by joins (``by_length``).
    """
    one = [*keys, "bench_number"]

    def facts(points: pa.Table, own: pa.Table) -> pa.Table:
        own = own.sort_by("bench_number") if len(points) else own.slice(0, 0)
        rows = []
        if len(own):
            seen = Seen(*nodes_of(points), cfg)
            crest, toe, toe_seen = (own.column(c).to_pylist() for c in ("crest_distance", "toe_distance", "_toe_seen"))
            for i, number in enumerate(own.column("bench_number").to_pylist()):
                edges = seen.edges(crest[i], toe[i]) if number == 1 else (None, None)
                rows.append((*seen.votes(crest[i], toe_seen[i]), seen.floor(toe[i], crest[i + 1] if i + 1 < len(own) else None), *edges))
        types = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
        names = [f.split()[0] for f in FACTS.split(", ")]
        out = own.select(one)
        for k, (name, kind) in enumerate(zip(names, types)):
            out = out.append_column(name, pa.array([r[k] for r in rows], kind))
        return out

    types = dict(benches.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in one) + ", " + FACTS
    own = benches.select(*one, "crest_distance", "toe_distance", "_toe_seen")
    out = short.groupBy(*keys).cogroup(own.groupBy(*keys)).applyInArrow(facts, schema)
    if long is None:
        return out
    joined = benches.select(*one).join(long.select(*keys).distinct().hint("merge"), keys, "left_semi")
    joined = joined.join(votes(long, benches, keys, cfg).hint("merge"), one, "left").join(local_floors(long, benches, keys).hint("merge"), one, "left")
    return out.unionByName(joined.join(edge_widths(long, benches, keys, cfg).hint("merge"), keys, "left"))


def hazards(benches: DataFrame, keys: list[str], berm_design_min: float | None = None) -> DataFrame:
    """Overhang and rock bridge to the next bench, catch-bench ratio, ramp segment flag."""
    w = Window.partitionBy(*keys).orderBy("bench_number")
    nxt = lambda c: F.lead(c).over(w)
    over = F.col("crest_distance") - nxt("toe_distance")
    high = F.col("toe_elevation") - nxt("crest_elevation")
    live = ~F.col("is_ramp")
    pos = lambda c: F.when(c > 0, c).otherwise(0.0)
    zero = lambda c: F.coalesce(F.when(live, c), F.lit(0.0))
    enough = F.lit(False) if berm_design_min is None else F.col("effective_berm_width") >= berm_design_min
    return benches.withColumns({
        "overhang_m": zero(over), "rock_bridge_height_m": zero(high), "rock_bridge_thickness_m": zero(F.least(pos(-over), pos(high))),
        "catch_bench_ratio": F.col("effective_berm_width") / F.greatest(F.col("berm_width"), F.lit(1e-3)), "catch_bench_adequate": enough,
        "ramp_segment": F.col("is_ramp")})


def wedge_in_face(points: DataFrame, keys: list[str]) -> DataFrame:
    """Whether explicit face points (keys, idx, d, z) turn by less than 60 degrees between neighbouring pieces."""
    w = Window.partitionBy(*keys).orderBy("idx")
    v = points.withColumns({"ax": F.lead("d").over(w) - F.col("d"), "az": F.lead("z").over(w) - F.col("z"),
                            "bx": F.lead("d", 2).over(w) - F.lead("d").over(w), "bz": F.lead("z", 2).over(w) - F.lead("z").over(w)})
    size = F.sqrt(F.col("ax") ** 2 + F.col("az") ** 2) * F.sqrt(F.col("bx") ** 2 + F.col("bz") ** 2)
    cos = (F.col("ax") * F.col("bx") + F.col("az") * F.col("bz")) / size
    turn = F.when(size == 0, 0.0).otherwise(F.degrees(F.acos(clamp(cos, -1.0, 1.0))))
    return v.groupBy(*keys).agg(F.coalesce(F.bool_or(turn < 60.0), F.lit(False)).alias("wedge_risk"))


def section_parameters(benches: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """Inter-ramp and overall angle, floor and highest crest per profile; profiles without benches keep a row."""
    end = lambda f, c: f(F.col(c), F.col("bench_number"))
    agg = benches.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_benches"), end(F.min_by, "crest_elevation").alias("_tz"), end(F.min_by, "crest_distance").alias("_td"),
        end(F.max_by, "toe_elevation").alias("_bz"), end(F.max_by, "toe_distance").alias("_bd"), F.first("face_angle").alias("_a"),
        F.coalesce(F.sum(F.when(F.col("is_ramp"), F.col("berm_width"))), F.lit(0.0)).alias("_ramp"))
    dz, dx = F.abs(F.col("_tz") - F.col("_bz")), F.abs(F.col("_td") - F.col("_bd"))
    free = F.greatest(dx - F.col("_ramp"), dx * 0.05)
    many, single = F.col("n_benches") >= 2, F.col("n_benches") == 1
    whole = points.groupBy(*keys).agg(F.min("z").alias("floor_elevation"), F.max("z").alias("crest_elevation_max"))
    return whole.join(agg.hint("merge"), keys, "left").select(
        *keys, F.coalesce("n_benches", F.lit(0)).alias("n_benches"),
        F.when(many & (free > 1e-3), F.degrees(F.atan2(dz, free))).when(single, F.col("_a")).otherwise(0.0).alias("inter_ramp_angle"),
        F.when(many & (dx > 1e-3), F.degrees(F.atan2(dz, dx))).when(single, F.col("_a")).otherwise(0.0).alias("overall_angle"),
        "floor_elevation", "crest_elevation_max")


def extract_benches(points: DataFrame, keys: list[str] | None = None, cfg: Detection = DETECTION, angle_scope: str = "face",
                    crest_first: bool = True, berm_design_min: float | None = None, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """(benches, section parameters) of all profiles.

    ``angle_scope='profile'`` with ``crest_first=False`` gives the plain behaviour of averaging the angle over the
    whole profile and taking face points in distance order. ``points``, rows or packed, is worked out in each of four
    passes and never written. Tables of vertices and benches meet by sorted shuffles: what is made of a few facets is not in
    the size estimate, by which a join chooses to broadcast.
    """
    keys = keys or KEYS
    points = points if is_packed(points) else node_rows(points, keys)
    short, long = by_length(points, keys, piece)
    segs = segments(cut_lineage(_simplified(short, long, keys, cfg.simplify_epsilon, piece)), keys, cfg)
    b = cut_lineage(faces(segs, keys, cfg, angle_scope, crest_first))
    w = Window.partitionBy(*keys).orderBy("bench_number")
    upper, a, h = F.lag("face_angle").over(w), F.col("face_angle"), F.col("bench_height")
    release = F.coalesce(upper > 75, F.lit(False)) & (a > 65) & (h > 12)
    facts = bench_facts(short, long, b, keys, cfg)
    b = b.withColumns({"wedge_risk": (a > 65) & (h > 12), "toppling_risk": (a > 80) | ((a > 75) & (h > 15)) | release})
    b = verdicts(b.join(facts.hint("merge"), [*keys, "bench_number"], "left"), cfg).drop("_toe_seen")
    last = ["floor_elevation", "_lead", "_trail"]
    b = b.select(*[c for c in b.columns if c not in last], *last)
    b = b.withColumn("floor_elevation", F.coalesce("floor_elevation", "toe_elevation"))
    b = b.withColumn("bench_height", F.when(F.col("floor_elevation") < F.col("toe_elevation"), F.abs(F.col("crest_elevation") - F.col("floor_elevation"))).otherwise(h))
    b = hazards(edge_berms(berms(b, keys, cfg.max_berm_width, cfg), keys), keys, berm_design_min)
    # benches feed several tables downstream: worked out once
    b = cut_lineage(b)
    params = section_parameters(b, node_rows(points, keys), keys)
    free = F.when(~F.col("is_ramp"), a)
    spread = b.groupBy(*keys).agg(F.when(F.count(free) >= 2, F.stddev_pop(free)).otherwise(0.0).alias("anisotropy_dispersion_deg"))
    params = cut_lineage(params)
    b = b.join(spread.hint("merge"), keys).join(params.select(*keys, "inter_ramp_angle").hint("merge"), keys)
    b = b.withColumn("face_angle_inconsistent", F.abs(a - F.col("inter_ramp_angle")) > 8.0).drop("inter_ramp_angle")
    return cut_lineage(b), params


def split_wide_faces(points: DataFrame, keys: list[str], max_width: float = DETECTION.max_single_bench_width,
                     prominence: float = DETECTION.sub_bench_min_prominence) -> DataFrame:
    """Face points (keys, d, z) with the number of the sub-bench they belong to.

    Faces wider than ``max_width`` split at dips whose lesser side rises at least ``prominence`` above them; a split
    point closes one sub-bench and opens the next.
    """
    w = Window.partitionBy(*keys).orderBy("d")
    whole = Window.partitionBy(*keys)
    p = points.withColumns({
        "_wide": (F.max("d").over(whole) - F.min("d").over(whole) > max_width) & (F.count(F.lit(1)).over(whole) >= 4),
        "_l": F.max("z").over(w.rowsBetween(Window.unboundedPreceding, -1)), "_r": F.max("z").over(w.rowsBetween(1, Window.unboundedFollowing)),
        "_p": F.lag("z").over(w), "_q": F.lead("z").over(w)})
    dip = F.col("_wide") & (F.col("z") <= F.col("_p")) & (F.col("z") <= F.col("_q")) & (F.least(F.col("_l") - F.col("z"), F.col("_r") - F.col("z")) >= prominence)
    p = p.withColumn("_dip", F.coalesce(dip, F.lit(False)).cast("int")).withColumn("_before", F.sum("_dip").over(w) - F.col("_dip"))
    part = F.when(F.col("_dip") == 1, F.array(F.col("_before"), F.col("_before") + 1)).otherwise(F.array(F.col("_before")))
    return p.withColumn("part", F.explode(part)).select(*keys, "d", "z", "part")


def benches_from_parts(parts: DataFrame, keys: list[str], cfg: Detection = DETECTION) -> DataFrame:
    """Crest, toe, height and angle of every sub-bench."""
    agg = parts.groupBy(*keys, "part").agg(F.max(F.struct("z", (-F.col("d")).alias("o"))).alias("c"), F.min(F.struct("z", "d")).alias("t"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    dx, dz = F.abs(-F.col("c.o") - F.col("t.d")), F.abs(F.col("c.z") - F.col("t.z"))
    return agg.select(*keys, (F.col("part") + 1).cast("int").alias("bench_number"), F.col("c.z").alias("crest_elevation"), (-F.col("c.o")).alias("crest_distance"),
                      F.col("t.z").alias("toe_elevation"), F.col("t.d").alias("toe_distance"), dz.alias("bench_height"),
                      F.when(dx > 1e-3, F.degrees(F.atan2(dz, dx))).otherwise(cfg.face_threshold).alias("face_angle"))


def _down(from_z, to_z, angle, ahead):
    return (from_z - to_z) / F.tan(F.radians(angle)) * ahead


def reconciled_points(benches: DataFrame, keys: list[str] | None = None, points: DataFrame | None = None, floors: DataFrame | None = None) -> DataFrame:
    """Idealised profile: crest or ramp, face, toe, berm corner and pit floor points in drawing order.

    ``points`` adds the profile points strictly inside each face (its midpoint when there are none); ``floors``
    (keys, floor_elevation) prolongs the last face down to the pit floor.
    """
    keys = keys or KEYS
    w = Window.partitionBy(*keys).orderBy("bench_number")
    b = benches.withColumns({"_nz": F.lead("crest_elevation").over(w), "_last": F.lead("bench_number").over(w).isNull()})
    if floors is not None:
        b = b.join(floors.select(*keys, F.col("floor_elevation").alias("_floor")).hint("merge"), keys, "left")
    else:
        b = b.withColumn("_floor", F.lit(None).cast("double"))
    ahead = F.when(F.col("toe_distance") >= F.col("crest_distance"), 1.0).otherwise(-1.0)
    leans = F.radians("face_angle") > 0.01
    target = F.when(F.col("floor_elevation") > 0, F.greatest("_nz", "floor_elevation")).otherwise(F.col("_nz"))
    step = F.when(leans & (F.col("toe_elevation") > target), _down(F.col("toe_elevation"), target, F.col("face_angle"), ahead)).otherwise(0.0)
    fall = F.when(leans, _down(F.col("toe_elevation"), F.col("_floor"), F.col("face_angle"), ahead)).otherwise(0.0)
    point = lambda test, rank, name, d, z: F.when(test, F.struct(F.lit(rank).alias("rank"), name.alias("segment_type"), d.alias("distance_m"), z.alias("elevation_m")))
    true = F.lit(True)
    made = F.array_compact(F.array(
        point(true, 0, F.when(F.col("is_ramp"), "ramp").otherwise("crest"), F.col("crest_distance"), F.col("crest_elevation")),
        point(true, 2, F.lit("toe"), F.col("toe_distance"), F.col("toe_elevation")),
        point(~F.col("is_ramp") & (F.col("_nz") >= F.col("toe_elevation")), 3, F.lit("berm_top"), F.col("toe_distance") + step, target),
        point(F.col("_last") & (F.col("toe_elevation") > F.col("_floor")), 4, F.lit("floor"), F.col("toe_distance") + fall, F.col("_floor"))))
    out = b.select(*keys, "bench_number", F.explode(made).alias("p")).select(*keys, "bench_number", "p.*")
    if points is not None:
        spans = benches.select(*keys, "bench_number", F.least("crest_distance", "toe_distance").alias("_lo"), F.greatest("crest_distance", "toe_distance").alias("_hi"))
        inner = interval_join(points.select(*keys, "d", "z"), spans, keys, "d", "_lo", "_hi", 25.0).where("d > _lo AND d < _hi")
        face = inner.select(*keys, "bench_number", F.lit(1).alias("rank"), F.lit("face").alias("segment_type"), F.col("d").alias("distance_m"), F.col("z").alias("elevation_m"))
        none = benches.join(inner.select(*keys, "bench_number").distinct().hint("merge"), [*keys, "bench_number"], "left_anti").select(
            *keys, "bench_number", F.lit(1).alias("rank"), F.lit("face").alias("segment_type"), ((F.col("crest_distance") + F.col("toe_distance")) / 2).alias("distance_m"),
            ((F.col("crest_elevation") + F.col("toe_elevation")) / 2).alias("elevation_m"))
        out = out.unionByName(face).unionByName(none)
    order = Window.partitionBy(*keys).orderBy("bench_number", "rank", "distance_m")
    return out.withColumn("point_no", F.row_number().over(order)).withColumn("is_ramp", F.col("segment_type") == "ramp").drop("rank")


def legacy_reconciled_points(benches: DataFrame, keys: list[str] | None = None, floors: DataFrame | None = None) -> DataFrame:
    """Crest and toe points by distance, each toe followed by its extension to the local floor, then the pit floor."""
    keys = keys or KEYS
    ahead = F.when(F.col("toe_distance") >= F.col("crest_distance"), 1.0).otherwise(-1.0)
    leans = F.radians("face_angle") > 0.01
    deep = (F.col("floor_elevation") > 0) & (F.col("floor_elevation") < F.col("toe_elevation")) & leans
    p = lambda test, at, rank, d, z: F.when(test, F.struct(at.alias("at"), F.lit(rank).alias("rank"), d.alias("distance_m"), z.alias("elevation_m")))
    true = F.lit(True)
    b = benches
    if floors is not None:
        w = Window.partitionBy(*keys)
        b = b.join(floors.select(*keys, F.col("floor_elevation").alias("_floor")).hint("merge"), keys, "left").withColumn("_last", F.max("bench_number").over(w) == F.col("bench_number"))
    else:
        b = b.withColumns({"_floor": F.lit(None).cast("double"), "_last": F.lit(False)})
    fall = F.when(leans, _down(F.col("toe_elevation"), F.col("_floor"), F.col("face_angle"), ahead)).otherwise(0.0)
    made = F.array_compact(F.array(
        p(true, F.col("crest_distance"), 0, F.col("crest_distance"), F.col("crest_elevation")),
        p(true, F.col("toe_distance"), 1, F.col("toe_distance"), F.col("toe_elevation")),
        p(deep, F.col("toe_distance"), 2, F.col("toe_distance") + _down(F.col("toe_elevation"), F.col("floor_elevation"), F.col("face_angle"), ahead), F.col("floor_elevation")),
        p(F.col("_last") & (F.col("toe_elevation") > F.col("_floor")), F.lit(float("inf")), 3, F.col("toe_distance") + fall, F.col("_floor"))))
    out = b.select(*keys, F.explode(made).alias("p")).select(*keys, "p.*")
    return out.withColumn("point_no", F.row_number().over(Window.partitionBy(*keys).orderBy("at", "rank"))).drop("at", "rank")


def reconciled_summary(reconciled: DataFrame, benches: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts, height range and hazard totals per reconciled profile."""
    keys = keys or KEYS
    line = reconciled.groupBy(*keys).agg(F.countDistinct("bench_number").alias("n_benches"), F.count_if("is_ramp").alias("n_ramps"),
                                         F.min("elevation_m").alias("height_low_m"), F.max("elevation_m").alias("height_high_m"))
    agg = benches.groupBy(*keys).agg(
        F.count_if(F.col("overhang_m") > 0).alias("n_overhangs"), F.count_if("wedge_risk").alias("n_wedge_risks"), F.count_if("toppling_risk").alias("n_toppling_risks"),
        F.count_if(F.col("n_detection_methods_agreeing") >= 2).alias("n_consensus_benches"), F.sum("berm_width").alias("total_berm_width_m"),
        F.avg("face_angle").alias("avg_face_angle_deg"), F.max("overhang_m").alias("max_overhang_m"))
    return line.join(agg.hint("merge"), keys)


def reconciled_with_hazards(reconciled: DataFrame, benches: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Reconciled points with the hazard flags of their bench."""
    keys = keys or KEYS
    out = reconciled.join(benches.select(*keys, "bench_number", "overhang_m", "wedge_risk", "toppling_risk").hint("merge"), [*keys, "bench_number"], "left")
    return out.na.fill(False, ["wedge_risk", "toppling_risk"])


POINT_SCHEMA = "array<struct<point_no:int,bench_number:int,segment_type:string,distance_m:double,elevation_m:double,is_ramp:boolean>>"


def to_records(reconciled: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One JSON document of ordered points per profile; a profile's points are bounded by its length."""
    keys = keys or KEYS
    fields = F.struct("point_no", "bench_number", "segment_type", "distance_m", "elevation_m", "is_ramp")
    return reconciled.groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_list(fields))).alias("points_json"))


def from_records(records: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or KEYS
    return records.select(*keys, F.explode(F.from_json("points_json", POINT_SCHEMA)).alias("p")).select(*keys, "p.*")


def spill_polygons(benches: DataFrame, points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Outline of the spill pile between projected toe and observed ground, as ordered points."""
    keys = keys or KEYS
    s = benches.where("spill_width > 0.05 AND spill_start_elevation > 0")
    out_x = F.when(F.col("toe_distance") > F.col("crest_distance"), F.col("toe_distance") + F.col("spill_width")).otherwise(F.col("toe_distance") - F.col("spill_width"))
    s = s.withColumn("_seen", out_x).withColumns({"_lo": F.least("spill_start_distance", "_seen") - 0.01, "_hi": F.greatest("spill_start_distance", "_seen") + 0.01})
    one = [*keys, "bench_number"]
    ground = interval_join(points.select(*keys, "d", "z"), s.select(*one, "_lo", "_hi", "_seen", "spill_start_distance"), keys, "d", "_lo", "_hi", 25.0)
    back = F.when(F.col("_seen") > F.col("spill_start_distance"), -F.col("d")).otherwise(F.col("d"))
    top = ground.select(*one, F.lit(3).alias("rank"), back.alias("at"), "d", "z")
    corner = lambda rank, d, z: F.struct(F.lit(rank).alias("rank"), F.lit(0.0).alias("at"), d.alias("d"), z.alias("z"))
    start = (F.col("spill_start_distance"), F.col("spill_start_elevation"))
    rim = s.select(*one, F.explode(F.array(corner(0, *start), corner(1, F.col("toe_distance"), F.col("toe_elevation")), corner(2, F.col("_seen"), F.col("toe_elevation")),
                                          corner(4, *start))).alias("c")).select(*one, "c.*")
    rim = rim.join(ground.select(*one).distinct().hint("merge"), one, "left_semi")
    return top.unionByName(rim).withColumn("point_no", F.row_number().over(Window.partitionBy(*one).orderBy("rank", "at"))).drop("rank", "at")
