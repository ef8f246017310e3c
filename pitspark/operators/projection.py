"""Holes on sections: projection, pattern map, holes behind a bench, spacing on a profile."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import BLAST
from ..functions.geometry import direction
from .spatial import cell

EPS = 1e-6


LEVELS = 3  # offset doubles per level; the level after the last one has a single cell per group


def _covering_cells(reach: float, level: int):
    """Cells of size twice ``reach`` a collar within ``reach`` of the section line can fall in.

    Stations along the line, at most one cell apart, each with the cells around it, cover the whole strip.
    """
    size = 2.0 * reach
    half = F.col("length") / 2
    dx, dy = direction("azimuth")
    steps = F.greatest(F.ceil(F.col("length") / size), F.lit(1)).cast("int")
    at = lambda i, o, d: F.floor((F.col(o) + (-half + i * F.col("length") / steps) * d) / size)
    spots = F.transform(F.sequence(F.lit(0), steps), lambda i: F.struct(
        at(i, "origin_x", dx).alias("cx"), at(i, "origin_y", dy).alias("cy")))
    offsets = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    return F.array_distinct(F.flatten(F.transform(spots, lambda s: F.transform(offsets, lambda o: F.struct(
        F.lit(level).alias("level"), (s["cx"] + o["a"]).alias("cx"), (s["cy"] + o["b"]).alias("cy"))))))


def project_holes(holes: DataFrame, sections: DataFrame, tolerance: float = 10.0, on: list[str] | None = None,
                  cutoff: bool = False, max_offset: float = 20.0) -> DataFrame:
    """Holes near section lines with their along and across distances.

    A hole is kept when its collar, its toe or the mean of both distances is within ``tolerance`` of the line and
    its collar lies within half the section length. ``cutoff`` keeps only holes blasted at least the buffer of
    days before the section's survey date. Collars meet sections by grid cell; a hole whose toe is further than
    ``max_offset`` from its collar uses coarser cells of its own level, so the result never depends on it.
    """
    on = list(on or [])
    if cutoff:
        sections = sections.withColumn("_cut", F.date_sub("survey_date", BLAST.temporal_buffer_days))
    covers = [F.array(F.struct(F.lit(LEVELS).alias("level"), F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy")))]
    level, size = F.lit(LEVELS), F.lit(1.0)
    for lv in reversed(range(LEVELS)):
        span = max_offset * 2.0 ** lv
        level = F.when(F.col("_offset") <= span, lv).otherwise(level)
        size = F.when(F.col("_level") == lv, 2.0 * (tolerance + span)).otherwise(size)
        covers.append(_covering_cells(tolerance + span, lv))
    # every step is a column of its own and none can be null: a test for null keys would repeat all of it, and code that long
    # the JVM does not compile
    offset = F.sqrt(F.pow(F.col("x_toe") - F.col("x"), 2) + F.pow(F.col("y_toe") - F.col("y"), 2))
    at = lambda c: F.when(F.col("_level") == LEVELS, 0).otherwise(F.coalesce(F.floor(F.col(c) / F.col("_size")), F.lit(0))).cast("long")
    placed = holes.where("x IS NOT NULL AND y IS NOT NULL").withColumn("_offset", F.coalesce(offset, F.lit(0.0))).withColumn("_level", level).withColumn("_size", size)
    placed = placed.withColumns({"_cx": at("x"), "_cy": at("y")}).drop("_offset", "_size")
    spread = sections.withColumn("_cell", F.explode(F.concat(*covers))).withColumns(
        {"_level": F.col("_cell.level"), "_cx": F.col("_cell.cx"), "_cy": F.col("_cell.cy")}).drop("_cell")
    joined = placed.join(spread, [*on, "_level", "_cx", "_cy"])
    dx, dy = direction("azimuth")
    along = lambda px, py: (F.col(px) - F.col("origin_x")) * dx + (F.col(py) - F.col("origin_y")) * dy
    across = lambda px, py: F.abs((F.col(px) - F.col("origin_x")) * dy + (F.col(py) - F.col("origin_y")) * -dx)
    out = joined.drop("_cx", "_cy", "_level").withColumns({
        "dist_along": along("x", "y"), "dist_along_toe": along("x_toe", "y_toe"),
        "dist_perp": across("x", "y"), "dist_perp_toe": across("x_toe", "y_toe")})
    limit = tolerance + EPS
    near = (F.col("dist_perp") <= limit) | (F.col("dist_perp_toe") <= limit) | (
        (F.col("dist_perp") + F.col("dist_perp_toe")) / 2 <= limit)
    out = out.where(near & F.col("dist_along").between(-F.col("length") / 2, F.col("length") / 2))
    if cutoff:
        out = out.where(F.col("fecha").isNotNull() & (F.col("fecha") <= F.col("_cut"))).drop("_cut")
    return out.withColumn(
        "closest_point", F.when(F.col("dist_perp") <= F.col("dist_perp_toe"), "collar").otherwise("toe"))


def pattern_sections(projected: DataFrame) -> DataFrame:
    """Which pattern projects into which section."""
    return projected.where(F.col("malla").isNotNull()).select("malla", "section").distinct()


def holes_on_profile(projected: DataFrame, tolerance: float) -> DataFrame:
    """One display row per projected hole; spacing falls back to the nearest projected collar.

    The fallback looks at the distinct collars of each section only, through the exact nearest-neighbour search.
    """
    from .spatial import k_nearest

    lacking = projected.where(F.col("spacing").isNull()).select("section").distinct()
    near = k_nearest(projected.join(lacking, "section"), 1, ["section"]).select(
        "section", "x", "y", F.element_at("distances", 1).alias("_near"))
    return projected.join(near, ["section", "x", "y"], "left").select(
        "section", "hole_id",
        F.bround("dist_along", 3).alias("distance"),
        F.bround(F.coalesce("z_collar", F.lit(0.0)), 3).alias("elevation"),
        F.bround(F.coalesce("burden", F.lit(0.0)), 3).alias("burden"),
        F.bround(F.coalesce("spacing", "_near", F.lit(0.0)), 3).alias("spacing"),
        (F.col("dist_perp") <= tolerance + 1e-9).alias("is_within_tolerance"))


def holes_behind_bench(benches: DataFrame, projected: DataFrame, tolerance_z: float = 2.0, list_holes: bool = True) -> DataFrame:
    """Average blast figures of the projected holes whose toe lies behind an as-built bench.

    A bench without holes keeps a row of zeros. ``projected`` carries ``pf_vol_kgm3``, ``stemming_ratio`` and
    ``kg_per_meter``.
    """
    b = benches.select(
        "section", "bench_number", "bench_height",
        (F.least("crest_elevation", "toe_elevation") - tolerance_z).alias("_z0"),
        (F.greatest("crest_elevation", "toe_elevation") + tolerance_z).alias("_z1"),
        (F.least("crest_distance", "toe_distance") - tolerance_z).alias("_d0"),
        (F.greatest("crest_distance", "toe_distance") + tolerance_z).alias("_d1"),
        F.abs(F.col("crest_elevation") - F.col("toe_elevation")).alias("_rise"))
    b = b.withColumn("_h", F.when(F.col("bench_height") > 0, F.col("bench_height")).otherwise(F.col("_rise")))
    width = 25.0
    # buckets on distance within the section bound the candidates; the height test is exact
    left = b.withColumn("_b", F.explode(F.sequence(cell("_d0", width), cell("_d1", width))))
    right = projected.withColumn("_b", cell("dist_along", width))
    hit = left.join(right, ["section", "_b"]).where(
        F.col("z_toe").between(F.col("_z0"), F.col("_z1")) & F.col("dist_along").between(F.col("_d0"), F.col("_d1")))
    sub = F.when(F.col("_h") > 0, (F.col("z_collar") - F.col("_h")) - F.col("z_toe"))
    sums = [
        F.count(F.lit(1)).alias("n_holes"),
        F.avg("pf_vol_kgm3").alias("pf_avg"), F.avg("stemming_ratio").alias("stemming_ratio_avg"),
        F.avg("burden").alias("burden_avg"), F.avg("spacing").alias("spacing_avg"), F.avg(sub).alias("subdrill_avg"),
        F.sum("kg").alias("kg_total"), F.avg("kg_per_meter").alias("kg_per_meter_avg")]
    if list_holes:
        sums.append(F.array_sort(F.collect_list(F.struct(
            "hole_id", F.col("pf_vol_kgm3").alias("pf"), "stemming_ratio", "burden", "spacing", sub.alias("subdrill"),
            "kg_per_meter", "x", "y", "z_collar", "z_toe"))).alias("holes"))
    agg = hit.groupBy("section", "bench_number").agg(*sums)
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in agg.columns if c.endswith("_avg") or c == "kg_total"}
    zero["n_holes"] = F.coalesce("n_holes", F.lit(0).cast("long"))
    return b.select("section", "bench_number").join(agg, ["section", "bench_number"], "left").withColumns(zero)
