"""Triangulated surfaces: cuts by sections, bounds, thinning, breaklines, contours, height grid, section layout.

A surface is one row per facet: surface_id, kind, tri_id and the corners v0, v1, v2 as (x, y, z) structs.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DETECTION
from ..functions.geometry import direction
from ..functions.numeric import clamp
from ..session import cut_lineage, written
from .spatial import cell, components

SURFACE = ["surface_id", "kind"]
CORNERS = ("v0", "v1", "v2")
PIECE = 100_000  # points of a profile, facets of a surface or segments of a level that one call holds at once


def vertices(triangles: DataFrame) -> DataFrame:
    """Distinct vertices of every surface."""
    return triangles.select(*SURFACE, F.explode(F.array(*CORNERS)).alias("v")).select(*SURFACE, "v.x", "v.y", "v.z").distinct()


def bounds(triangles: DataFrame) -> DataFrame:
    """Box, counts and area-weighted centroid per surface."""
    edge = lambda a, b: [F.col(f"{b}.{c}") - F.col(f"{a}.{c}") for c in "xyz"]
    u, v = edge("v0", "v1"), edge("v0", "v2")
    cross = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    area = F.sqrt(sum(c * c for c in cross)) / 2
    mid = lambda c: (F.col(f"v0.{c}") + F.col(f"v1.{c}") + F.col(f"v2.{c}")) / 3
    low = lambda c: F.min(F.least(*[F.col(f"{k}.{c}") for k in CORNERS]))
    high = lambda c: F.max(F.greatest(*[F.col(f"{k}.{c}") for k in CORNERS]))
    box = [f(c).alias(f"{c}{n}") for c in "xyz" for n, f in (("min", low), ("max", high))]
    faces = triangles.groupBy(*SURFACE).agg(*box, F.count(F.lit(1)).alias("n_faces"), F.sum(area).alias("_a"),
                                            *[F.sum(mid(c) * area).alias(f"_c{c}") for c in "xyz"])
    count = vertices(triangles).groupBy(*SURFACE).agg(F.count(F.lit(1)).alias("n_vertices"))
    out = faces.join(count, SURFACE)
    return out.select(*SURFACE, *[f"{c}{n}" for c in "xyz" for n in ("min", "max")], "n_faces", "n_vertices",
                      *[F.when(F.col("_a") > 0, F.col(f"_c{c}") / F.col("_a")).alias(f"center_{c}") for c in "xyz"])


def thin(triangles: DataFrame, target_faces: int) -> DataFrame:
    """Vertex clustering: one mean vertex per cube, facets that collapse or repeat are dropped."""
    box = triangles.groupBy(*SURFACE).agg(*[f(F.least(*[F.col(f"{k}.{c}") for k in CORNERS]) if f is F.min else F.greatest(*[F.col(f"{k}.{c}") for k in CORNERS])).alias(f"_{c}{n}")
                                            for c in "xyz" for n, f in (("0", F.min), ("1", F.max))])
    volume = F.lit(1.0)
    for c in "xyz":
        volume = volume * (F.col(f"_{c}1") - F.col(f"_{c}0"))
    want = max(target_faces // 2, 500)
    sized = box.withColumn("_s", F.when(volume > 0, F.pow(volume / want, F.lit(1.0 / 3.0))).otherwise(1.0))
    cube = lambda v: F.struct(*[F.floor((F.col(f"{v}.{c}") - F.col(f"_{c}0")) / F.col("_s")).alias(c) for c in "xyz"])
    tri = triangles.join(sized, SURFACE).select(*SURFACE, "tri_id", *CORNERS, *[cube(v).alias(f"k{i}") for i, v in enumerate(CORNERS)])
    spots = tri.select(*SURFACE, F.explode(F.array(*[F.struct(F.col(v).alias("v"), F.col(f"k{i}").alias("k")) for i, v in enumerate(CORNERS)])).alias("e")).select(
        *SURFACE, F.col("e.k").alias("k"), F.col("e.v").alias("v")).distinct()
    mean = spots.groupBy(*SURFACE, "k").agg(F.struct(*[F.avg(f"v.{c}").alias(c) for c in "xyz"]).alias("v"))
    keep = tri.where("k0 <> k1 AND k1 <> k2 AND k0 <> k2").withColumn("_set", F.array_sort(F.array("k0", "k1", "k2")))
    once = keep.groupBy(*SURFACE, "_set").agg(F.min_by(F.struct("tri_id", "k0", "k1", "k2"), "tri_id").alias("t")).select(*SURFACE, "t.*")
    for i in range(3):
        once = once.join(mean.select(*SURFACE, F.col("k").alias(f"k{i}"), F.col("v").alias(f"v{i}")), [*SURFACE, f"k{i}"])
    return once.select(*SURFACE, "tri_id", *CORNERS)


def _half_lengths() -> tuple[Column, Column]:
    both = F.col("length_up").isNotNull() & F.col("length_down").isNotNull()
    return F.when(both, -F.col("length_down")).otherwise(-F.col("length") / 2), F.when(both, F.col("length_up")).otherwise(F.col("length") / 2)


def cut_points(triangles: DataFrame, sections: DataFrame, cell_size: float = 50.0) -> DataFrame:
    """Raw crossings of facets with vertical section planes: surface, kind, section, sector, d, z.

    Facets and sections meet by plan cell. A facet counts a corner on the plane as above it, so every crossing
    line yields exactly two points and no vertex is lost or doubled. A facet wider than one cell is listed under
    all cells of its box.
    """
    x = lambda c, f: f(*[F.col(f"{v}.{c}") for v in CORNERS])
    span = lambda c: F.sequence(cell(x(c, F.least), cell_size), cell(x(c, F.greatest), cell_size))
    tri = triangles.withColumn("_cx", F.explode(span("x"))).withColumn("_cy", F.explode(span("y")))
    dx, dy = direction("azimuth")
    low, high = _half_lengths()
    steps = F.greatest(F.ceil((high - low) / cell_size), F.lit(1)).cast("int")
    # stations one cell apart with their neighbours cover every cell the line passes
    at = lambda i, o, d: F.floor((F.col(o) + (low + i * (high - low) / steps) * d) / cell_size)
    spots = F.transform(F.sequence(F.lit(0), steps), lambda i: F.struct(at(i, "origin_x", dx).alias("cx"), at(i, "origin_y", dy).alias("cy")))
    ring = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    cells = F.array_distinct(F.flatten(F.transform(spots, lambda s: F.transform(ring, lambda o: F.struct((s["cx"] + o["a"]).alias("cx"), (s["cy"] + o["b"]).alias("cy"))))))
    sec = sections.withColumn("_c", F.explode(cells)).withColumn("_cx", F.col("_c.cx")).withColumn("_cy", F.col("_c.cy")).drop("_c")
    side = lambda v: (F.col(f"{v}.x") - F.col("origin_x")) * dy - (F.col(f"{v}.y") - F.col("origin_y")) * dx
    # sizes are estimated before the cells are listed, so neither side may be sent to the driver on their account
    pairs = tri.join(sec.hint("merge"), ["surface_id", "_cx", "_cy"]).withColumns({f"_s{i}": side(v) for i, v in enumerate(CORNERS)})
    above = [F.col(f"_s{i}") >= 0 for i in range(3)]
    pairs = pairs.where((above[0] != above[1]) | (above[1] != above[2]))
    # a facet and a section can share several cells: the pair is kept once
    pairs = pairs.dropDuplicates([*SURFACE, "tri_id", "section"])

    def crossing(i: int, j: int) -> Column:
        t = F.col(f"_s{i}") / (F.col(f"_s{i}") - F.col(f"_s{j}"))
        p = {c: F.col(f"v{i}.{c}") + t * (F.col(f"v{j}.{c}") - F.col(f"v{i}.{c}")) for c in "xyz"}
        d = (p["x"] - F.col("origin_x")) * dx + (p["y"] - F.col("origin_y")) * dy
        return F.when(above[i] != above[j], F.struct(d.alias("d"), p["z"].alias("z")))

    hits = F.array_compact(F.array(crossing(0, 1), crossing(1, 2), crossing(2, 0)))
    return pairs.select(*SURFACE, "section", "sector", low.alias("_low"), high.alias("_high"), F.explode(hits).alias("p")).select(
        *SURFACE, "section", "sector", "p.d", "p.z", "_low", "_high").where(F.col("d").between(F.col("_low"), F.col("_high"))).drop("_low", "_high")


def merge_points(points: DataFrame) -> DataFrame:
    """Mean height per distance rounded to the millimetre; profiles under two points vanish."""
    merged = points.groupBy(*SURFACE, "section", "sector", F.bround("d", 3).alias("d")).agg(F.avg("z").alias("z"))
    size = points.groupBy(*SURFACE, "section").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2").select(*SURFACE, "section")
    return merged.join(size.hint("merge"), [*SURFACE, "section"], "left_semi")


def stretches(points: DataFrame, keys: list[str], step: float = DETECTION.profile_resolution) -> DataFrame:
    """Resampled profiles, packed: a row per pair of neighbouring points (d, z, d1, z1) with the grid nodes that fall between
    them, node i of ``first`` to ``last`` at lo + i * w. ``node_rows`` and ``nodes_of`` make the nodes."""
    order = Window.partitionBy(*keys).orderBy("d")
    whole = Window.partitionBy(*keys)
    df = points.withColumns({"d1": F.lead("d").over(order), "z1": F.lead("z").over(order), "lo": F.min("d").over(whole),
                             "_hi": F.max("d").over(whole), "_n": F.count(F.lit(1)).over(whole)})
    n = F.greatest(F.col("_n"), F.ceil((F.col("_hi") - F.col("lo")) / step) + 1)
    df = df.withColumn("_nodes", n).where("_n >= 2 AND d1 IS NOT NULL").withColumn("w", (F.col("_hi") - F.col("lo")) / (F.col("_nodes") - 1))
    first = F.ceil((F.col("d") - F.col("lo")) / F.col("w") - 1e-9)
    last = F.when(F.col("d1") == F.col("_hi"), F.col("_nodes") - 1).otherwise(F.ceil((F.col("d1") - F.col("lo")) / F.col("w") - 1e-9) - 1)
    return df.select(*keys, "d", "z", "d1", "z1", "lo", "w", first.alias("first"), last.alias("last")).where(F.col("last") >= F.col("first"))


def is_packed(points: DataFrame) -> bool:
    return {"first", "last", "d1"} <= set(points.columns)


def node_rows(points: DataFrame, keys: list[str]) -> DataFrame:
    """Profile points as rows (idx, d, z), from packed ones or those that are rows already."""
    if not is_packed(points):
        return points.select(*keys, "idx", "d", "z")
    out = points.withColumn("idx", F.explode(F.sequence("first", "last"))).withColumn("_at", F.col("lo") + F.col("idx") * F.col("w"))
    z = F.col("z") + (F.col("z1") - F.col("z")) * (F.col("_at") - F.col("d")) / (F.col("d1") - F.col("d"))
    return out.select(*keys, F.col("idx").cast("int").alias("idx"), F.col("_at").alias("d"), z.alias("z"))


def nodes_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """idx, d and z of the same points in a task (missing ones NaN), by the same formula as ``node_rows``; idx is NaN-free where packed."""
    column = lambda c: rows.column(c).to_numpy()
    if "first" not in rows.column_names:
        return column("idx"), column("d").astype(float), column("z").astype(float)
    first, count = column("first"), column("last") - column("first") + 1
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    d, z, d1, z1, lo, w, idx = (np.repeat(v, count) for v in (*(column(c).astype(float) for c in ("d", "z", "d1", "z1", "lo", "w")), first))
    idx = idx + place
    at = lo + idx * w
    return idx, at, z + (z1 - z) * (at - d) / (d1 - d)


def by_length(points: DataFrame, keys: list[str], piece: int = PIECE, span: float | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Profiles of up to ``piece`` points, and the points of the longer ones as rows (None where there are none).

    ``keys`` may stand for several profiles; with ``span`` the steps of that length between a group's ends count as well.
    """
    packed = is_packed(points)
    count = F.sum(F.col("last") - F.col("first") + 1) if packed else F.count(F.lit(1))
    if span is not None:
        count = F.greatest(count, F.ceil((F.max("d1" if packed else "d") - F.min("d")) / span))
    short, long = by_size(points, keys, piece, count)
    kinds = ["kind"] if "kind" in points.columns and "kind" not in keys else []
    return short, None if long is None else node_rows(long, [*keys, *kinds])


def by_size(df: DataFrame, keys: list[str], piece: int = PIECE, size: Column | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the groups of up to ``piece`` rows, and those of the larger ones (None where there are none); ``size``: what counts instead of rows."""
    sizes = df.groupBy(*keys).agg((F.count(F.lit(1)) if size is None else size).alias("_n"))
    if (sizes.agg(F.max("_n")).first()[0] or 0) <= piece:
        return df, None
    large = sizes.where(F.col("_n") > piece).select(*[F.col(k).alias(f"_{k}") for k in keys]).hint("merge")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return df.join(large, same, "left_anti"), df.join(large, same, "left_semi")


def resample(points: DataFrame, keys: list[str], step: float = DETECTION.profile_resolution) -> DataFrame:
    """Evenly spaced profile points (idx, d, z): at least as many as given and no wider apart than ``step``.

    Every pair of neighbouring points makes the grid nodes that fall between them, so no node is searched for.
    """
    return node_rows(stretches(points, keys, step), keys)


def profiles(triangles: DataFrame, sections: DataFrame, step: float = DETECTION.profile_resolution, packed: bool = False) -> DataFrame:
    """Resampled profiles of all surfaces and kinds along all sections, as rows or packed (``stretches``).

    Packed ones are for jobs that use a profile's points in the task that makes them; the merged crossings, from which
    they come, are then written once, as such jobs pass over them several times.
    """
    merged, keys = merge_points(cut_points(triangles, sections)), [*SURFACE, "section", "sector"]
    return stretches(written(merged, "crossings"), keys, step) if packed else resample(merged, keys, step)


def local_azimuth(points: DataFrame, triangles: DataFrame, radius: float = 50.0, at_least: int = 10) -> DataFrame:
    """Steepest-descent azimuth of the design surface around points (surface_id, point_id, px, py).

    A plane is fitted to the vertices within ``radius``, or within three times that when they are too few; 0 where
    there are still too few or the plane is flat.
    """
    from .spatial import radius_join

    v = vertices(triangles.where("kind = 'design'")).select("surface_id", "x", "y", "z")

    def fit(p: DataFrame, r: float) -> DataFrame:
        near = radius_join(v, p, r, ["surface_id"], "inner", ("x", "y"), ("px", "py"), "_d").where(F.col("_d") < r)
        return near.groupBy("surface_id", "point_id").agg(
            F.count(F.lit(1)).alias("n"), F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"),
            F.covar_pop("x", "z").alias("xz"), F.covar_pop("y", "z").alias("yz")).where(F.col("n") >= at_least)

    first = fit(points, radius)
    rest = points.join(first.select("surface_id", "point_id"), ["surface_id", "point_id"], "left_anti")
    sums = first.unionByName(fit(rest, 3 * radius))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    a = F.when(det != 0, (F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")) / det)
    b = F.when(det != 0, (F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy")) / det)
    flat = (F.abs(a) < 1e-6) & (F.abs(b) < 1e-6)
    angle = F.when(~flat, F.pmod(F.degrees(F.atan2(-a, -b)), F.lit(360.0)))
    found = sums.select("surface_id", "point_id", angle.alias("azimuth"))
    return points.join(found, ["surface_id", "point_id"], "left").withColumn("azimuth", F.coalesce("azimuth", F.lit(0.0)))


def sections_along_line(lines: DataFrame, n: int, azimuth: float | None = None, length: float = 200.0) -> DataFrame:
    """``n`` sections spread evenly along start-end lines (line_id, x0, y0, x1, y1, sector)."""
    t = F.col("_i") / F.lit(float(n - 1)) if n > 1 else F.lit(0.5)
    turn = F.pmod(F.pmod(F.degrees(F.atan2(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))), F.lit(360.0)) + 90.0, F.lit(360.0))
    return lines.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(
        "line_id", F.format_string("S-%02d", F.col("_i") + 1).alias("section"), (F.col("x0") + t * (F.col("x1") - F.col("x0"))).alias("origin_x"),
        (F.col("y0") + t * (F.col("y1") - F.col("y0"))).alias("origin_y"), (F.lit(float(azimuth)) if azimuth is not None else turn).alias("azimuth"),
        F.lit(float(length)).alias("length"), "sector")


def perpendicular_sections(points: DataFrame, spacing: float = 20.0, length: float = 200.0) -> DataFrame:
    """Sections across polylines (line_id, pos, x, y, sector) every ``spacing`` metres, the first at half a spacing.

    Each polyline segment makes the stations that fall on it; a line shorter than the spacing gets its midpoint.
    """
    order = Window.partitionBy("line_id").orderBy("pos")
    seg = points.withColumns({"_x1": F.lead("x").over(order), "_y1": F.lead("y").over(order)}).where("_x1 IS NOT NULL")
    seg = seg.withColumn("_len", F.sqrt(F.pow(F.col("_x1") - F.col("x"), 2) + F.pow(F.col("_y1") - F.col("y"), 2))).where("_len > 0")
    seg = seg.withColumns({"_end": F.sum("_len").over(order), "_total": F.sum("_len").over(Window.partitionBy("line_id"))}).where("_total >= 0.000001")
    seg = seg.withColumn("_start", F.col("_end") - F.col("_len"))
    first = F.greatest(F.ceil((F.col("_start") - spacing / 2) / spacing - 1e-12), F.lit(0))
    last = F.ceil((F.col("_end") - spacing / 2) / spacing - 1e-12) - 1
    middle = F.col("_total") / 2
    here = (middle >= F.col("_start")) & (middle < F.col("_end"))
    number = F.when(F.col("_total") < spacing, F.when(here, F.array(F.lit(0).cast("long")))).when(last >= first, F.sequence(first, last))
    out = seg.withColumn("_k", F.explode(number)).withColumn("_at", F.when(F.col("_total") < spacing, middle).otherwise(spacing / 2 + F.col("_k") * spacing))
    t = (F.col("_at") - F.col("_start")) / F.col("_len")
    turn = F.pmod(F.pmod(F.degrees(F.atan2(F.col("_x1") - F.col("x"), F.col("_y1") - F.col("y"))), F.lit(360.0)) + 90.0, F.lit(360.0))
    return out.select("line_id", F.format_string("S-%02d", F.col("_k") + 1).alias("section"), (F.col("x") + t * (F.col("_x1") - F.col("x"))).alias("origin_x"),
                      (F.col("y") + t * (F.col("_y1") - F.col("y"))).alias("origin_y"), turn.alias("azimuth"), F.lit(float(length)).alias("length"), "sector")


def _sub(a: str, b: str) -> list[Column]:
    return [F.col(f"{a}.{c}") - F.col(f"{b}.{c}") for c in "xyz"]


def numbered_points(*columns: pa.Array) -> tuple[list[np.ndarray], pa.Array]:
    """Points (structs of coordinates) of several columns by number, equal ones alike and in the order of the points, and the points by number."""
    points = pa.concat_arrays(columns)
    code = np.zeros(len(points), np.int64)
    for k in range(points.type.num_fields):
        c = points.field(k)
        known = c.is_valid().to_numpy(zero_copy_only=False)
        values, place = np.unique(c.to_numpy(zero_copy_only=False) + 0.0, return_inverse=True)
        code = np.unique(code * (len(values) + 1) + np.where(known, place + 1, 0), return_inverse=True)[1]
    _, first = np.unique(code, return_index=True)
    return np.split(code, np.cumsum([len(c) for c in columns])[:-1]), points.take(pa.array(first))


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _coordinates(points: pa.Array) -> np.ndarray:
    return np.stack([points.field(k).to_numpy(zero_copy_only=False) for k in range(points.type.num_fields)])


def _folds(corners: pa.Table, min_angle: float) -> tuple:
    """Numbers of the ends (a, b), angles, whether crest, and the points of one surface's folds; the rule of ``_edges_long``."""
    corner, points = numbered_points(*(_whole(corners.column(v)) for v in CORNERS))
    xyz = _coordinates(points)
    v0, v1, v2 = (xyz[:, c] for c in corner)
    u, w = v1 - v0, v2 - v0
    n = np.stack([u[1] * w[2] - u[2] * w[1], u[2] * w[0] - u[0] * w[2], u[0] * w[1] - u[1] * w[0]])
    size = np.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    ids = corners.column("tri_id").to_numpy()
    some = np.flatnonzero((size > 0) & ~np.isnan(ids.astype(float)))  # facets without a normal or a number are left out
    n = n[:, some] / size[some]
    p, q, o = (np.concatenate([corner[(i + k) % 3][some] for i in range(3)]) for k in range(3))
    facet = np.tile(np.arange(len(some)), 3)
    a, b = np.minimum(p, q), np.maximum(p, q)
    edge = a * np.int64(len(points) + 1) + b
    order = np.lexsort((ids[some][facet], edge))
    at, count = np.unique(edge[order], return_index=True, return_counts=True)[1:]
    at = at[count == 2]
    f, g = order[at], order[at + 1]
    nf, ng = n[:, facet[f]], n[:, facet[g]]
    dot = nf[0] * ng[0] + nf[1] * ng[1] + nf[2] * ng[2]
    angle = np.degrees(np.arccos(np.clip(dot, -1.0, 1.0)))
    gap = xyz[:, o[g]] - xyz[:, a[f]]
    drop = gap[0] * nf[0] + gap[1] * nf[1] + gap[2] * nf[2]
    sharp = angle >= min_angle
    return a[f][sharp], b[f][sharp], angle[sharp], drop[sharp] < 0, points


def breakline_edges(triangles: DataFrame, min_angle: float = 20.0, piece: int = PIECE) -> DataFrame:
    """Shared edges whose facets turn by at least ``min_angle``: crest where the fold is convex, toe where concave.

    A surface of up to ``piece`` facets is worked out in one call, so each facet is moved once instead of once per edge.
    """
    short, long = by_size(triangles, SURFACE, piece)

    def folds(surface: pa.Table) -> pa.Table:
        a, b, angle, crest, points = _folds(surface, min_angle)
        out = surface.select(SURFACE).take(np.zeros(len(a), int))
        for name, values in (("a", points.take(pa.array(a))), ("b", points.take(pa.array(b))), ("angle_deg", pa.array(angle)),
                             ("line_kind", pa.array(np.where(crest, "crest", "toe").tolist(), pa.string()))):
            out = out.append_column(name, values)
        return out

    types = dict(triangles.dtypes)
    ddl = ", ".join([*[f"{k} {types[k]}" for k in SURFACE], f"a {types['v0']}, b {types['v0']}, angle_deg double, line_kind string"])
    out = short.select(*SURFACE, "tri_id", *CORNERS).groupBy(*SURFACE).applyInArrow(folds, ddl)
    return out if long is None else out.unionByName(_edges_long(long, min_angle))


def _edges_long(triangles: DataFrame, min_angle: float) -> DataFrame:
    # an edge's row is made before its ends are put in order: the code for all three at once is too long for the JVM to compile
    sides = triangles.select(*SURFACE, "tri_id", *CORNERS, F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("_i"))
    at = lambda k: F.get(F.array(*CORNERS), (F.col("_i") + k) % 3)
    u, w = _sub("v1", "v0"), _sub("v2", "v0")
    n = [u[1] * w[2] - u[2] * w[1], u[2] * w[0] - u[0] * w[2], u[0] * w[1] - u[1] * w[0]]
    size = F.sqrt(F.col("_n")[0] * F.col("_n")[0] + F.col("_n")[1] * F.col("_n")[1] + F.col("_n")[2] * F.col("_n")[2])
    pt = lambda v: F.struct(*[v[c].alias(c) for c in "xyz"])
    half = sides.select(*SURFACE, "tri_id", F.array(*n).alias("_n"), pt(at(0)).alias("p"), pt(at(1)).alias("q"), pt(at(2)).alias("o"))
    half = half.withColumn("_l", size).select(*SURFACE, "tri_id", F.struct(*[F.when(F.col("_l") > 0, F.col("_n")[i] / F.col("_l")).alias(c) for i, c in enumerate("xyz")]).alias("n"),
                                              F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "o")
    # one aggregate per edge instead of a self-join: the first two facets in id order, those without a normal left out
    number = F.when(F.col("n.x").isNotNull(), F.col("tri_id"))
    both = half.groupBy(*SURFACE, "a", "b").agg(F.min_by(F.struct("n", "o"), number).alias("f"), F.max_by(F.struct("n", "o"), number).alias("g"),
                                                F.count(number).alias("c")).where("c = 2")
    dot = sum(F.col(f"f.n.{k}") * F.col(f"g.n.{k}") for k in "xyz")
    angle = F.degrees(F.acos(clamp(dot, -1.0, 1.0)))
    drop = sum((F.col(f"g.o.{k}") - F.col(f"a.{k}")) * F.col(f"f.n.{k}") for k in "xyz")
    return both.select(*SURFACE, "a", "b", angle.alias("angle_deg"), F.when(drop < 0, "crest").otherwise("toe").alias("line_kind")).where(F.col("angle_deg") >= min_angle)


def chain(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Segments (keys, a, b) with the number of the polyline they belong to: connected segments of one key share it.

    Segments are worked out and numbered once; at every point each is linked to the first one there, so the rounds that
    follow move pairs of numbers only. ``polyline`` is a number of no further meaning.
    """
    numbered = cut_lineage(segments.withColumn("_seg", F.monotonically_increasing_id()))
    ends = numbered.select(*keys, "_seg", F.explode(F.array("a", "b")).alias("_p"))
    links = cut_lineage(ends.select("_seg", F.min("_seg").over(Window.partitionBy(*keys, "_p")).alias("_first")))
    part = components(links, "_seg", "_first", "polyline")
    return numbered.join(part.hint("merge"), F.col("_seg") == F.col("node")).drop("_seg", "node")


def _ranked(arcs: DataFrame) -> DataFrame:
    """List ranking by pointer doubling of arcs (id, next, start, end): each round doubles the arcs that a row has seen ahead.

    Result: id, last (the arc its chain ends with; null on a ring), ahead (arcs after it), stop (the chain's last point), low
    (the smallest (start, end) seen, on a ring that of the whole ring). Rounds: the logarithm of the longest chain. It is
    done when no arc newly sees its chain's end (one just out of sight would have) and no smallest arc changes.
    """
    rows = cut_lineage(arcs.select("id", F.coalesce("next", "id").alias("to"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("ahead"),
                                   F.col("next").isNull().alias("done"), F.col("end").alias("stop"), F.struct("start", "end").alias("low")))
    while True:
        seen = rows.select(*[F.col(c).alias(f"_{c}") for c in ("id", "to", "ahead", "done", "stop", "low")])
        jumped = rows.join(seen.hint("merge"), F.col("to") == F.col("_id"))
        moved = ~F.col("done") & (F.col("_done") | (F.col("_low") < F.col("low")))
        rows = cut_lineage(jumped.select(
            "id", F.when(F.col("done"), F.col("to")).otherwise(F.col("_to")).alias("to"), F.when(F.col("done"), F.col("ahead")).otherwise(F.col("ahead") + F.col("_ahead")).alias("ahead"),
            (F.col("done") | F.col("_done")).alias("done"), F.when(F.col("done"), F.col("stop")).otherwise(F.col("_stop")).alias("stop"), F.least("low", "_low").alias("low"), moved.alias("moved")))
        if rows.where("moved").isEmpty():
            return rows.select("id", F.when(F.col("done"), F.col("to")).alias("last"), "ahead", "stop", "low")


def drawing_order(low: np.ndarray, high: np.ndarray, number: np.ndarray) -> list[tuple[int, int, int, int, bool, bool]]:
    """Rows (line, pos, a, b, closed, is_last) of the distinct segments between numbered points; the rule of ``ordered_polylines``."""
    start, end, seg = np.concatenate([low, high]), np.concatenate([high, low]), np.tile(np.arange(len(low)), 2)
    order = np.lexsort((end, start))
    spots, at = np.unique(start[order], return_index=True)
    leaving = dict(zip(spots.tolist(), np.split(order, at[1:]))) if len(spots) else {}
    leaving = {p: [(int(end[k]), int(seg[k])) for k in arcs] for p, arcs in leaving.items()}
    seen, rows, line = [False] * len(low), [], 0

    def walk(p: int, q: int, s: int, stop: int | None) -> None:
        nonlocal line
        pos, began, first, home = 0, len(rows), s, p
        while True:
            seen[s] = True
            go_on = len(leaving[q]) == 2 and q != stop
            rows.append((line, pos, p, q, stop is not None, not go_on))
            if not go_on:
                if stop is None and q == home and number[first] > number[s]:  # from a junction back to it
                    rows[began:] = [(line, k, b, a, False, k == pos) for k, (_, _, a, b, _, _) in enumerate(reversed(rows[began:]))]
                line += 1
                return
            (r, t), (r2, t2) = leaving[q]
            p, q, s, pos = q, *((r2, t2) if t == s else (r, t)), pos + 1

    for closed in (False, True):  # points come in order: a line starts at the smaller one of its ends, a ring at its smallest point
        for p, arcs in leaving.items():
            if closed or len(arcs) != 2:
                for q, s in arcs:
                    if not seen[s]:
                        walk(p, q, s, p if closed else None)
    return rows


def ordered_polylines(segments: DataFrame, keys: list[str], piece: int = PIECE) -> DataFrame:
    """Segments (keys, a, b) in drawing order: keys, polyline, pos (from 0), a, b, closed, is_last.

    Lines end where a point has one or more than two segments; a ring starts at its smallest point towards the smaller
    neighbour, an open line at the smaller one of its ends; one that comes back to the junction it began in ends with the
    segment written later. Repeated segments count once. ``polyline`` tells the lines of a key apart and has no further
    meaning. Segments are written once; those of a key are put in order in one call, where they are more than ``piece`` by
    list ranking.
    """
    # places in the order of writing give every segment a number
    single = segments.select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    segments = written(single.withColumn("seg", F.monotonically_increasing_id()), "segments")
    short, long = by_size(segments, keys, piece)

    def lines(group: pa.Table) -> pa.Table:
        (a, b), points = numbered_points(_whole(group.column("a")), _whole(group.column("b")))
        line, pos, start, end, closed, last = list(zip(*drawing_order(a, b, group.column("seg").to_numpy()))) or [()] * 6
        out = group.select(keys).take(np.zeros(len(line), int))
        for name, values in (("polyline", pa.array(line, pa.int64())), ("pos", pa.array(pos, pa.int64())), ("a", points.take(pa.array(start, pa.int64()))),
                             ("b", points.take(pa.array(end, pa.int64()))), ("closed", pa.array(closed, pa.bool_())), ("is_last", pa.array(last, pa.bool_()))):
            out = out.append_column(name, values)
        return out

    types = dict(segments.dtypes)
    ddl = ", ".join([*[f"`{k}` {types[k]}" for k in keys], f"polyline long, pos long, a {types['a']}, b {types['b']}, closed boolean, is_last boolean"])
    out = short.groupBy(*keys).applyInArrow(lines, ddl)
    return out if long is None else out.unionByName(_lines_long(long, keys))


def _lines_long(single: DataFrame, keys: list[str]) -> DataFrame:
    """The same by list ranking; arcs and what is known of them are as many as the segments: such tables meet by sorted shuffles."""
    way = lambda i, u, v: F.struct((F.col("seg") * 2 + i).alias("id"), F.col(u).alias("start"), F.col(v).alias("end"))
    arcs = single.select(*keys, "seg", F.explode(F.array(way(0, "a", "b"), way(1, "b", "a"))).alias("w")).select(*keys, "seg", "w.*")
    # two arcs leave a point in the middle of a line; who comes in against the one goes on with the other
    leaving = arcs.groupBy(*keys, "start").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("i"), F.max("id").alias("j")).where("n = 2")
    turn = lambda c, d: F.struct(F.col(c).bitwiseXOR(F.lit(1)).alias("came"), F.col(d).alias("next"))
    onward = leaving.select(F.explode(F.array(turn("i", "j"), turn("j", "i"))).alias("t")).select("t.*")
    linked = cut_lineage(arcs.join(onward.hint("merge"), F.col("id") == F.col("came"), "left").select("id", "next", "start", "end"))
    ranked = _ranked(linked)
    # of the two directions of an open line the one that ends at the larger point, of a ring's the one with the smaller low
    half = ranked.withColumn("seg", F.shiftright("id", 1))
    chosen = cut_lineage(half.groupBy("seg").agg(
        F.max(F.when(F.col("last").isNotNull(), F.struct("stop", F.struct("last", "ahead", "id").alias("r")))).alias("o"), F.min(F.when(F.col("last").isNull(), F.struct("low", "id"))).alias("c")))
    opened = chosen.where("o IS NOT NULL").select("o.r.id", F.col("o.r.last").alias("polyline"), F.col("o.r.ahead").alias("ahead"), F.lit(False).alias("closed"))
    ring = chosen.where("o IS NULL").select("c.id", "c.low").join(linked.hint("merge"), "id")
    if not ring.isEmpty():
        first = ring.where((F.col("start") == F.col("low.start")) & (F.col("end") == F.col("low.end"))).select(F.col("id").alias("_first"))
        cut = ring.join(first.hint("merge"), F.col("next") == F.col("_first"), "left").select("id", F.when(F.col("_first").isNull(), F.col("next")).alias("next"), "start", "end")
        opened = opened.unionByName(_ranked(cut).select("id", F.col("last").alias("polyline"), "ahead", F.lit(True).alias("closed")))
    sizes = opened.groupBy("polyline").agg(F.max("ahead").alias("most"))
    placed = opened.join(sizes.hint("merge"), "polyline").select("id", "polyline", (F.col("most") - F.col("ahead")).alias("pos"), "closed", (F.col("ahead") == 0).alias("is_last"))
    directed = arcs.select(*keys, "id", F.col("start").alias("a"), F.col("end").alias("b"))
    return directed.join(placed.hint("merge"), "id").select(*keys, "polyline", "pos", "a", "b", "closed", "is_last")


def polyline_points(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Points of ordered polylines: keys, polyline, closed, pos, point; the last point of a ring is its first one again."""
    point = lambda pos, p: F.struct(pos.alias("pos"), F.col(p).alias("point"))
    ends = F.array_compact(F.array(point(F.col("pos"), "a"), F.when(F.col("is_last"), point(F.col("pos") + 1, "b"))))
    return lines.select(*keys, "polyline", "closed", F.explode(ends).alias("p")).select(*keys, "polyline", "closed", "p.pos", "p.point")


def contour_segments(triangles: DataFrame, interval: float = 15.0) -> DataFrame:
    """Contour pieces per facet and level; a corner on a level counts as above it."""
    z = lambda f: f(*[F.col(f"{v}.z") for v in CORNERS])
    levels = F.sequence(F.floor(z(F.least) / interval).cast("long"), F.floor(z(F.greatest) / interval).cast("long"))
    tri = triangles.withColumn("_k", F.explode(levels)).withColumn("elevation", F.col("_k") * F.lit(float(interval)))
    above = [F.col(f"{v}.z") >= F.col("elevation") for v in CORNERS]

    def crossing(i: int, j: int) -> Column:
        # both facets of an edge must compute the same point, so the edge is walked from its smaller corner
        p, q = F.least(f"v{i}", f"v{j}"), F.greatest(f"v{i}", f"v{j}")
        t = (F.col("elevation") - p["z"]) / (q["z"] - p["z"])
        return F.when(above[i] != above[j], F.struct((p["x"] + t * (q["x"] - p["x"])).alias("x"), (p["y"] + t * (q["y"] - p["y"])).alias("y")))

    hits = F.array_compact(F.array(crossing(0, 1), crossing(1, 2), crossing(2, 0)))
    cut = tri.where((above[0] != above[1]) | (above[1] != above[2])).withColumn("_h", hits)
    return cut.select(*SURFACE, "elevation", F.least(F.get("_h", 0), F.get("_h", 1)).alias("a"), F.greatest(F.get("_h", 0), F.get("_h", 1)).alias("b")).where("a <> b")


def height_grid(triangles: DataFrame, step: float = 5.0) -> DataFrame:
    """Heights on a plan grid, linear inside the facets: every facet makes the nodes it covers."""
    c = lambda v, k: F.col(f"{v}.{k}")
    span = lambda k: F.sequence(F.ceil(F.least(*[c(v, k) for v in CORNERS]) / step), F.floor(F.greatest(*[c(v, k) for v in CORNERS]) / step))
    ok = lambda k: F.ceil(F.least(*[c(v, k) for v in CORNERS]) / step) <= F.floor(F.greatest(*[c(v, k) for v in CORNERS]) / step)
    nodes = triangles.where(ok("x") & ok("y")).withColumn("ix", F.explode(span("x"))).withColumn("iy", F.explode(span("y")))
    x, y = F.col("ix") * step, F.col("iy") * step
    det = (c("v1", "y") - c("v2", "y")) * (c("v0", "x") - c("v2", "x")) + (c("v2", "x") - c("v1", "x")) * (c("v0", "y") - c("v2", "y"))
    l0 = ((c("v1", "y") - c("v2", "y")) * (x - c("v2", "x")) + (c("v2", "x") - c("v1", "x")) * (y - c("v2", "y"))) / det
    l1 = ((c("v2", "y") - c("v0", "y")) * (x - c("v2", "x")) + (c("v0", "x") - c("v2", "x")) * (y - c("v2", "y"))) / det
    l2 = 1.0 - l0 - l1
    inside = (l0 >= -1e-9) & (l1 >= -1e-9) & (l2 >= -1e-9)
    z = l0 * c("v0", "z") + l1 * c("v1", "z") + l2 * c("v2", "z")
    # nodes on a shared edge are made by both facets; the smallest facet id speaks
    return nodes.where(det != 0).where(inside).groupBy(*SURFACE, "ix", "iy").agg(F.min_by(z, "tri_id").alias("z")).select(
        *SURFACE, "ix", "iy", (F.col("ix") * step).alias("x"), (F.col("iy") * step).alias("y"), "z")
