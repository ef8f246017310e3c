"""Design against as-built profiles: common grid, areas, sector deviations, nearest-point deviation.

Sector and nearest-point deviations work out a section of up to ``PIECE`` points in one call, so points of packed profiles
(``surfaces.stretches``) are neither shuffled nor written; longer sections go through joins and windows.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SECTOR_DEVIATION, TOLERANCES
from .spatial import interval_join, nearest_distance
from .surfaces import PIECE, by_length, node_rows, nodes_of

KEYS = ["surface_id", "section", "sector"]


def overlap(points: DataFrame, keys: list[str]) -> DataFrame:
    """Common distance range of both kinds per section."""
    of = lambda f, kind: f(F.when(F.col("kind") == kind, F.col("d")))
    n = lambda kind: F.count_if(F.col("kind") == kind)
    span = points.groupBy(*keys).agg(
        F.greatest(of(F.min, "design"), of(F.min, "topo")).alias("lo"), F.least(of(F.max, "design"), of(F.max, "topo")).alias("hi"),
        n("design").alias("_nd"), n("topo").alias("_nt"))
    return span.where("_nd >= 2 AND _nt >= 2 AND hi > lo").select(*keys, "lo", "hi")


def on_grid(points: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """Both kinds on the nodes of ``grid`` (keys, lo, w, n): node i at lo + i * w, columns z_design and z_topo.

    Neighbouring profile points make the nodes between them, so interpolation needs no search; the two kinds then
    meet by one aggregate over the node number. Points go to their section's grid by a sorted shuffle, which the windows
    and the aggregate use again: nodes are not in the size estimate, by which a join chooses to broadcast.
    """
    order = Window.partitionBy(*keys, "kind").orderBy("d")
    p = points.join(grid.hint("merge"), keys)
    p = p.withColumns({"_d1": F.lead("d").over(order), "_z1": F.lead("z").over(order)}).where("_d1 > d")
    top = F.max("_d1").over(Window.partitionBy(*keys, "kind"))
    p = p.withColumn("_top", top)
    first = F.greatest(F.ceil((F.col("d") - F.col("lo")) / F.col("w") - 1e-9), F.lit(0))
    open_end = F.ceil((F.col("_d1") - F.col("lo")) / F.col("w") - 1e-9) - 1
    last = F.least(F.when(F.col("_d1") == F.col("_top"), F.floor((F.col("_d1") - F.col("lo")) / F.col("w") + 1e-9)).otherwise(open_end), F.col("n") - 1)
    p = p.withColumn("i", F.explode(F.when(last >= first, F.sequence(first, last))))
    at = F.col("lo") + F.col("i") * F.col("w")
    z = F.col("z") + (F.col("_z1") - F.col("z")) * (at - F.col("d")) / (F.col("_d1") - F.col("d"))
    both = p.select(*keys, "i", at.alias("d"), "w", "kind", z.alias("z")).groupBy(*keys, "i").agg(
        F.first("d").alias("d"), F.first("w").alias("w"), F.max(F.when(F.col("kind") == "design", F.col("z"))).alias("z_design"),
        F.max(F.when(F.col("kind") == "topo", F.col("z"))).alias("z_topo"))
    return both.where("z_design IS NOT NULL AND z_topo IS NOT NULL")


def profile_areas(points: DataFrame, keys: list[str] | None = None, step: float = 0.1) -> DataFrame:
    """Areas between as-built and design by sign, as step sums over the overlap."""
    keys = keys or KEYS
    grid = overlap(points, keys).select(*keys, "lo", F.lit(step).alias("w"), F.ceil((F.col("hi") - F.col("lo")) / step).alias("n"))
    gap = F.col("z_topo") - F.col("z_design")
    return on_grid(points, grid, keys).groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(gap < 0, -gap)) * step, F.lit(0.0)).alias("area_topo_below"),
        F.coalesce(F.sum(F.when(gap > 0, gap)) * step, F.lit(0.0)).alias("area_topo_above"))


def design_breaks(points: DataFrame, keys: list[str]) -> DataFrame:
    """Distances where the design profile turns; level ground counts as rising."""
    w = Window.partitionBy(*keys).orderBy("d")
    up = lambda a, b: F.when(b - a < 0, -1).otherwise(1)
    d = points.where("kind = 'design'").withColumns({"_p": F.lag("z").over(w), "_q": F.lead("z").over(w)})
    return d.where("_p IS NOT NULL AND _q IS NOT NULL").where(up(F.col("_p"), F.col("z")) != up(F.col("z"), F.col("_q"))).select(*keys, F.col("d").alias("at")).distinct()


def sector_class(above: Column, below: Column, width: Column, tolerance: float) -> Column:
    over, under = above > tolerance * width, below > tolerance * width
    return F.when(over & under, "mixed").when(over, "overbreak").when(under, "underbreak").otherwise("compliant")


def _full(rows: pa.Table, keys: list[str]) -> bool:
    """Whether a group has rows and no key of it is missing: groups without a full key take part in nothing."""
    return len(rows) > 0 and all(rows.column(k)[0].is_valid for k in keys)


def _of_kind(rows: pa.Table, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """idx, d and z of one kind's points by distance, missing distances last."""
    idx, d, z = nodes_of(rows.filter(pc.equal(rows.column("kind"), kind)))
    order = np.argsort(d, kind="stable")
    return idx[order], d[order], z[order]


def _rows(group: pa.Table, keys: list[str], names: list[str], columns: list) -> pa.Table:
    """The group's keys beside columns of numbers, missing ones null."""
    columns = [np.asarray(c, float) for c in columns]
    out = group.select(keys).take(np.zeros(len(columns[0]), int))
    for name, values in zip(names, columns):
        out = out.append_column(name, pa.array(values, pa.float64(), from_pandas=True))
    return out


def _ddl(df: DataFrame, keys: list[str], names: list[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join([f"`{k}` {types[k]}" for k in keys] + [f"{n} double" for n in names])


STRETCH = ["_start", "_end", "_d0", "_d1", "area_above_m2", "area_below_m2", "net_area_m2", "mean_delta_h", "max_delta_h", "centroid_d", "centroid_delta_h"]


def heights_on(d: np.ndarray, z: np.ndarray, lo: float, w: float, n: int) -> np.ndarray:
    """Heights of one profile on the nodes lo + i * w, NaN where it has none; the rule of ``on_grid``."""
    out = np.full(n, np.nan)
    d0, d1, z0, z1 = d[:-1], d[1:], z[:-1], z[1:]
    some = d1 > d0
    d0, d1, z0, z1 = d0[some], d1[some], z0[some], z1[some]
    if not len(d0):
        return out
    first = np.maximum(np.ceil((d0 - lo) / w - 1e-9), 0)
    last = np.where(d1 == d1.max(), np.floor((d1 - lo) / w + 1e-9), np.ceil((d1 - lo) / w - 1e-9) - 1)
    count = np.maximum(np.minimum(last, n - 1) - first + 1, 0).astype(int)
    at = np.repeat(np.arange(len(d0)), count)
    i = first[at].astype(int) + np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    np.fmax.at(out, i, z0[at] + (z1[at] - z0[at]) * (lo + i * w - d0[at]) / (d1[at] - d0[at]))
    return out


def stretch_rows(design: tuple, topo: tuple, step: float) -> list[tuple]:
    """The columns STRETCH of one section from its two profiles (d and z by distance); the rule of ``_stretches_long``."""
    if len(design[0]) < 2 or len(topo[0]) < 2:
        return []
    lo, hi = max(np.nanmin(s[0]) for s in (design, topo)), min(np.nanmax(s[0]) for s in (design, topo))
    if not hi > lo:
        return []
    n = max(2, int(np.ceil((hi - lo) / step)) + 1)
    w = (hi - lo) / (n - 1)
    delta = heights_on(*topo, lo, w, n) - heights_on(*design, lo, w, n)
    i = np.flatnonzero(~np.isnan(delta))
    at, known = lo + i * w, delta[i]
    d, z = design
    falls = np.diff(z) < 0
    breaks = d[1:-1][(falls[1:] != falls[:-1]) & ~np.isnan(z[:-2]) & ~np.isnan(z[2:])]
    edges = np.unique(np.concatenate([breaks[(breaks > lo) & (breaks < hi)], [lo, hi]]))
    out = []
    for start, end in zip(edges[:-1], edges[1:]):
        a, b = np.searchsorted(at, start - 1e-9, "left"), np.searchsorted(at, end + 1e-9, "right")
        if b - a < 2:
            continue
        x, v, size = at[a:b], known[a:b], np.abs(known[a:b])
        trapezoid = lambda c: w * (c.sum() - (c[0] + c[-1]) / 2)
        s = size.sum()
        centroid = (x * size).sum() / s if s > 1e-9 else (start + end) / 2
        share = (centroid - x[0]) / w
        left = max(0, min(int(np.floor(share)), i[b - 1] - i[a] - 1))
        k, t = i[a] + left, max(0.0, min(1.0, share - left))
        if not np.isnan(delta[k] + delta[k + 1]):
            out.append((start, end, x[0], x[-1], trapezoid(np.maximum(v, 0.0)), trapezoid(np.maximum(-v, 0.0)), trapezoid(v), v.mean(), size.max(), centroid,
                        delta[k] + t * (delta[k + 1] - delta[k])))
    return out


def sector_deviations(points: DataFrame, keys: list[str] | None = None, tolerance: float = SECTOR_DEVIATION.tolerance_m,
                      step: float = SECTOR_DEVIATION.grid_resolution_m, piece: int = PIECE) -> DataFrame:
    """Signed areas, extremes, centroid and class per stretch between design crests and toes."""
    keys = keys or KEYS
    short, long = by_length(points, keys, piece, span=step)

    def section(rows: pa.Table) -> pa.Table:
        found = stretch_rows(*(_of_kind(rows, kind)[1:] for kind in ("design", "topo")), step) if _full(rows, keys) else []
        return _rows(rows, keys, STRETCH, list(zip(*found)) or [[]] * len(STRETCH))

    out = short.groupBy(*keys).applyInArrow(section, _ddl(points, keys, STRETCH))
    out = out if long is None else out.unionByName(_stretches_long(long, keys, step))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("_start"))
    return out.select(
        *keys, number.alias("sector_id"), F.col("_start").alias("d_start"), F.col("_end").alias("d_end"), "area_above_m2", "area_below_m2", "net_area_m2",
        sector_class(F.col("area_above_m2"), F.col("area_below_m2"), F.col("_d1") - F.col("_d0"), tolerance).alias("classification"),
        "mean_delta_h", "max_delta_h", "centroid_d", "centroid_delta_h")


def _stretches_long(points: DataFrame, keys: list[str], step: float) -> DataFrame:
    span = overlap(points, keys)
    n = F.greatest(F.lit(2), F.ceil((F.col("hi") - F.col("lo")) / step) + 1)
    grid = span.withColumn("n", n).withColumn("w", (F.col("hi") - F.col("lo")) / (F.col("n") - 1)).select(*keys, "lo", "w", "n")
    nodes = on_grid(points, grid, keys).withColumn("delta", F.col("z_topo") - F.col("z_design"))
    cuts = design_breaks(points, keys).join(span.hint("merge"), keys).where("at > lo AND at < hi").select(*keys, "at")
    ends = span.select(*keys, F.explode(F.array("lo", "hi")).alias("at"))
    w = Window.partitionBy(*keys).orderBy("at")
    spans = cuts.unionByName(ends).distinct().withColumn("_end", F.lead("at").over(w)).where("_end IS NOT NULL").select(*keys, F.col("at").alias("_start"), "_end")
    eps = 1e-9
    inside = interval_join(nodes, spans.withColumns({"_lo": F.col("_start") - eps, "_hi": F.col("_end") + eps}), keys, "d", "_lo", "_hi", 25.0)
    pos, neg, size = F.greatest("delta", F.lit(0.0)), F.greatest(-F.col("delta"), F.lit(0.0)), F.abs("delta")
    part = [*keys, "_start", "_end"]

    def trapezoid(c: Column) -> Column:
        return F.first("w") * (F.sum(c) - (F.min_by(c, "i") + F.max_by(c, "i")) / 2)

    agg = inside.groupBy(*part).agg(
        F.min("d").alias("_d0"), F.max("d").alias("_d1"), F.min("i").alias("_i0"), F.max("i").alias("_i1"), F.first("w").alias("_w"),
        trapezoid(pos).alias("area_above_m2"), trapezoid(neg).alias("area_below_m2"), trapezoid(F.col("delta")).alias("net_area_m2"),
        F.avg("delta").alias("mean_delta_h"), F.max(size).alias("max_delta_h"), F.sum(size).alias("_s"), F.sum(F.col("d") * size).alias("_sd")).where("_d1 > _d0")
    agg = agg.withColumn("centroid_d", F.when(F.col("_s") > 1e-9, F.col("_sd") / F.col("_s")).otherwise((F.col("_start") + F.col("_end")) / 2))
    share = (F.col("centroid_d") - F.col("_d0")) / F.col("_w")
    left = F.greatest(F.lit(0), F.least(F.floor(share), F.col("_i1") - F.col("_i0") - 1))
    agg = agg.withColumns({"_k": F.col("_i0") + left, "_t": F.greatest(F.lit(0.0), F.least(F.lit(1.0), share - left))})
    side = lambda name: nodes.select(*keys, F.col("i").alias("_k"), F.col("delta").alias(name))
    out = agg.join(side("_a").hint("merge"), [*keys, "_k"]).withColumn("_k", F.col("_k") + 1).join(side("_b").hint("merge"), [*keys, "_k"])
    return out.select(*keys, *STRETCH[:-1], (F.col("_a") + F.col("_t") * (F.col("_b") - F.col("_a"))).alias("centroid_delta_h"))


def nearest_gaps(qd: np.ndarray, qz: np.ndarray, d: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Distance from every query point to the nearest of the points (d, z), which are sorted by d.

    From the place of a query the search goes on to both sides, until points are farther away by d alone than the best one.
    """
    place = np.searchsorted(d, qd)
    best = np.full(len(qd), np.inf)
    for way in (-1, 1):
        at, open_ = place - 1 if way < 0 else place.copy(), np.arange(len(qd))
        while len(open_):
            open_ = open_[(at[open_] >= 0) & (at[open_] < len(d))]
            k = at[open_]
            dx = qd[open_] - d[k]
            dz = qz[open_] - z[k]
            near = dx * dx < best[open_]
            open_ = open_[near]
            best[open_] = np.minimum(best[open_], (dx * dx + dz * dz)[near])
            at[open_] += way
    return np.sqrt(best)


def nearest_point_deviation(points: DataFrame, keys: list[str] | None = None, tolerance: float = TOLERANCES.bench_height.pos, piece: int = PIECE) -> DataFrame:
    """Distance of every as-built profile point to the nearest design point, with its traffic light."""
    keys = keys or KEYS
    short, long = by_length(points, keys, piece)
    names = ["idx", "d", "z", "deviation_m"]

    def section(rows: pa.Table) -> pa.Table:
        (_, d, z), (idx, qd, qz) = (_of_kind(rows, kind) for kind in ("design", "topo"))
        some, asked = ~np.isnan(d + z), ~np.isnan(qd + qz)
        if not _full(rows, keys) or not some.any():
            return _rows(rows, keys, names, [[]] * 4)
        idx, qd, qz = idx[asked], qd[asked], qz[asked]
        return _rows(rows, keys, names, [idx, qd, qz, nearest_gaps(qd, qz, d[some], z[some])])

    out = short.groupBy(*keys).applyInArrow(section, _ddl(points, keys, names))
    out = out.withColumn("idx", F.col("idx").cast(dict(node_rows(points, keys).dtypes)["idx"]))
    out = out if long is None else out.unionByName(_nearest_long(long, keys))
    distance = F.col("deviation_m")
    light = F.when(distance <= tolerance, "OK").when(distance <= 1.5 * tolerance, "ALERTA").otherwise("NO CUMPLE")
    return out.withColumn("light", light)


def _nearest_long(points: DataFrame, keys: list[str]) -> DataFrame:
    topo = points.where("kind = 'topo'").select(*keys, "idx", F.col("d").alias("qx"), F.col("z").alias("qy"))
    design = points.where("kind = 'design'").select(*keys, F.col("d").alias("sx"), F.col("z").alias("sy"))
    near = nearest_distance(topo, design, keys)
    return topo.join(near.hint("merge"), [*keys, "qx", "qy"]).select(*keys, "idx", F.col("qx").alias("d"), F.col("qy").alias("z"), F.col("distance").alias("deviation_m"))
