"""Which holes explain a deviated crest or toe; energy density along a profile; energy field on a grid."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import BLAST
from .spatial import radius_join


def _by_position(holes: DataFrame, on: list[str]) -> DataFrame:
    return holes.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(
        *on, "x", "y", "hole_id", "malla", F.coalesce("kg", F.lit(0.0)).alias("kg"))


def attribute_holes(features: DataFrame, holes: DataFrame, on: list[str], tolerance: float = 15.0, top_n: int = 5) -> DataFrame:
    """Top holes per feature by kg / d², with their share of all candidates within ``tolerance``.

    Stacked holes are reduced first: their kg sum and their ``top_n`` heaviest are all a feature can need from one
    position, so the pair join works on positions. Equal scores keep hole order.
    """
    h = _by_position(holes, on)
    spot = [*on, "x", "y"]
    # one shuffle by position serves order, sum and count; the first hole there speaks for all of the position
    here = Window.partitionBy(*spot)
    ranked = h.withColumns({"_r": F.row_number().over(here.orderBy(F.desc("kg"), "hole_id")), "kg_sum": F.sum("kg").over(here), "n_here": F.count(F.lit(1)).over(here)})
    for_all = lambda c: F.when(F.col("_r") == 1, F.col(c)).alias(c)
    sites = ranked.where(F.col("_r") <= top_n).select(*spot, "hole_id", "malla", "kg", for_all("kg_sum"), for_all("n_here"))
    key = [*on, "section", "bench_num", "feature"]
    wanted = features.where(F.col("fx").isNotNull()).dropna(subset=key).select(*key, "delta_m", "fx", "fy")
    # sites first: they are many, the features visit the cells around them
    pairs = radius_join(sites, wanted, tolerance, on, "inner", ("x", "y"), ("fx", "fy"), "d")
    floor = F.greatest(F.col("d") * F.col("d"), F.lit(BLAST.distance_floor_m2))
    # and one by feature serves total and rank
    each = Window.partitionBy(*key)
    top = pairs.select(*key, "delta_m", "d", "hole_id", "malla", "kg", "n_here", (F.col("kg") / floor).alias("score"), (F.col("kg_sum") / floor).alias("_share"))
    top = top.withColumns({"_total": F.sum("_share").over(each), "n_candidates": F.sum("n_here").over(each),
                           "rank": F.row_number().over(each.orderBy(F.desc("score"), "hole_id"))}).where(F.col("rank") <= top_n)
    share = F.when(F.col("_total") > 0, F.col("score") / F.col("_total") * 100.0).otherwise(0.0)
    return top.select(
        *key, "delta_m", "n_candidates", "rank", "hole_id", "malla", "kg", F.bround("d", 3).alias("distance_m"),
        F.bround(share, 2).alias("contribution_pct"))


def nest_attribution(rows: DataFrame, on: list[str]) -> DataFrame:
    """One row per feature with its ranked holes as an array."""
    return rows.groupBy(*on, "section", "bench_num", "feature", "delta_m", "n_candidates").agg(F.array_sort(F.collect_list(
        F.struct("rank", "hole_id", "malla", "kg", "distance_m", "contribution_pct"))).alias("top_holes"))


def energy_density(points: DataFrame, holes: DataFrame, on: list[str], radius: float = 30.0) -> DataFrame:
    """Sum of kg / d² of the holes within ``radius`` of every point; 0 where there are none."""
    sites = _by_position(holes, on).groupBy(*on, "x", "y").agg(F.sum("kg").alias("kg_sum"))
    spots = points.select(*on, "fx", "fy").distinct()
    pairs = radius_join(sites, spots, radius, on, "inner", ("x", "y"), ("fx", "fy"), "d")
    floor = F.greatest(F.col("d") * F.col("d"), F.lit(BLAST.distance_floor_m2))
    found = pairs.groupBy(*on, "fx", "fy").agg(F.sum(F.col("kg_sum") / floor).alias("energy"))
    return points.join(found, [*on, "fx", "fy"], "left").withColumn("energy", F.coalesce("energy", F.lit(0.0)))


ENDS = ("x", "y", "z_collar", "x_toe", "y_toe", "z_toe")
BOX = ("x0", "x1", "y0", "y1", "z0", "z1")
#: Beyond this share of d² / (2 r²) the gaussian is 0.0 in double precision.
VANISHES = 746.0
TILE = 1024  # nodes worked out together
TERMS = 16_384  # hole and node terms held at once
KEPT_NODES = 4_000_000  # partial sums held by a task


def _tiles(nodes: np.ndarray) -> list[tuple[slice, np.ndarray, np.ndarray]]:
    """Runs of nodes with their lowest and highest corner."""
    cuts = [slice(at, at + TILE) for at in range(0, len(nodes), TILE)]
    return [(c, nodes[c].min(0), nodes[c].max(0)) for c in cuts]


def add_energy(sums: np.ndarray, nodes: np.ndarray, ends: np.ndarray, q: np.ndarray, radius: float) -> None:
    """Adds the holes' terms (collar and toe in a row of ``ends``) to the nodes' sums; terms that are exactly 0 are passed over
    by whole tiles. Terms are worked out coordinate by coordinate, so few of them at once that they stay in the processor's cache."""
    collar, axis = ends[:, :3], ends[:, 3:] - ends[:, :3]
    length2 = (axis * axis).sum(1)
    length2[length2 == 0] = 1e-6
    low, high = np.minimum(ends[:, :3], ends[:, 3:]), np.maximum(ends[:, :3], ends[:, 3:])
    for cut, first, last in _tiles(nodes):
        apart = np.maximum(0.0, np.maximum(low - last, first - high))
        near = np.flatnonzero((apart * apart).sum(1) <= VANISHES * 2.0 * radius * radius)
        if not len(near):
            continue
        node = np.ascontiguousarray(nodes[cut].T)
        step = max(1, TERMS // node.shape[1])
        w = np.empty((3, min(step, len(near)), node.shape[1]))
        t, d2, part = (np.empty(w.shape[1:]) for _ in range(3))
        for at in range(0, len(near), step):
            some = near[at:at + step]
            n = len(some)
            c, v = collar[some], axis[some]
            tn, dn, pn = t[:n], d2[:n], part[:n]
            for i in range(3):
                np.subtract(node[i], c[:, i, None], out=w[i, :n])
                np.multiply(w[i, :n], v[:, i, None], out=pn if i else tn)
                if i:
                    tn += pn
            tn /= length2[some][:, None]
            np.clip(tn, 0.0, 1.0, out=tn)
            for i in range(3):
                np.multiply(tn, v[:, i, None], out=pn)
                np.subtract(w[i, :n], pn, out=pn)
                np.multiply(pn, pn, out=pn if i else dn)
                if i:
                    dn += pn
            np.maximum(dn, 1e-4, out=dn)
            dn /= -(2.0 * radius * radius)
            np.exp(dn, out=dn)
            sums[cut] += q[some] @ dn


def energy_grid(holes: DataFrame, on: list[str], nx: int = 20, ny: int = 20, nz: int = 5, radius: float = 30.0,
                value: str | None = "kg") -> DataFrame:
    """Gaussian energy field of collar-to-toe segments on a regular grid per group.

    The grid has nx x ny x nz nodes, two each way at least. Holes stay where they are: every task sums the terms of its own
    holes node by node and gives one row per node of the groups it met, which are added up afterwards. Holes without all
    six coordinates count for nothing.
    """
    nx, ny, nz = max(2, nx), max(2, ny), max(2, nz)
    radius = float(radius) if radius > 0 else 30.0
    weight = F.coalesce(F.col(value), F.lit(0.0)) if value else F.lit(1.0)
    h = holes.select(*on, *[F.col(c).cast("double").alias(c) for c in ENDS], weight.cast("double").alias("q")).dropna(subset=[*ENDS, *on])
    box = h.groupBy(*on).agg(*[f(c).alias(n) for n, f, c in (
        ("x0", F.min, "x"), ("x1", F.max, "x"), ("y0", F.min, "y"), ("y1", F.max, "y"), ("z0", F.min, "z_toe"), ("z1", F.max, "z_collar"))])
    for a in "xyz":
        flat = F.col(f"{a}1") - F.col(f"{a}0") < 1e-9
        box = box.withColumn("_flat", flat).withColumn(f"{a}0", F.when(F.col("_flat"), F.col(f"{a}0") - radius).otherwise(F.col(f"{a}0"))).withColumn(
            f"{a}1", F.when(F.col("_flat"), F.col(f"{a}1") + radius).otherwise(F.col(f"{a}1"))).drop("_flat")

    def steps(low: float, high: float, n: int) -> np.ndarray:
        return low + np.arange(n) * ((high - low) / (n - 1))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

        def out() -> Iterator[pd.DataFrame]:
            for key, (_, energy) in sums.items():
                yield pd.DataFrame({**{k: [v] * len(energy) for k, v in zip(on, key)}, "node": np.arange(len(energy)), "energy": energy})
            sums.clear()

        for pdf in batches:
            for key, part in pdf.groupby(on, sort=False):
                if key not in sums:
                    x0, x1, y0, y1, z0, z1 = part[list(BOX)].iloc[0]
                    axes = np.meshgrid(steps(x0, x1, nx), steps(y0, y1, ny), steps(z0, z1, nz), indexing="ij")
                    nodes = np.stack([a.ravel() for a in axes], axis=1)
                    sums[key] = (nodes, np.zeros(len(nodes)))
                nodes, energy = sums[key]
                add_energy(energy, nodes, part[list(ENDS)].to_numpy(float), part["q"].to_numpy(float), radius)
            if len(sums) * nx * ny * nz > KEPT_NODES:
                yield from out()
        yield from out()

    kinds = {f.name: f.dataType.simpleString() for f in h.schema.fields}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in on) + ", node int, energy double"
    summed = h.join(box, on).mapInPandas(partial, schema).groupBy(*on, "node").agg(F.sum("energy").alias("energy"))
    place = {"ix": F.floor(F.col("node") / (ny * nz)), "iy": F.floor(F.col("node") / nz) % ny, "iz": F.col("node") % nz}
    out = summed.withColumns({k: v.cast("int") for k, v in place.items()}).join(box, on)
    spot = lambda a, n: (F.col(f"{a}0") + F.col(f"i{a}") * ((F.col(f"{a}1") - F.col(f"{a}0")) / (n - 1))).alias(a)
    return out.select(*on, "ix", "iy", "iz", spot("x", nx), spot("y", ny), spot("z", nz), "energy")


def energy_map(grid: DataFrame, on: list[str]) -> DataFrame:
    """Column sums of the field in plan view, with the share of the strongest column."""
    plan = grid.groupBy(*on, "ix", "iy").agg(F.first("x").alias("x"), F.first("y").alias("y"), F.sum("energy").alias("energy"))
    top = plan.groupBy(*on).agg(F.max("energy").alias("e_max"))
    return plan.join(top, on).withColumn("e_max", F.when(F.col("e_max") > 0, F.col("e_max")).otherwise(1.0))
