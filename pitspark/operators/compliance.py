"""Comparison rows of design and as-built benches, scores and statuses."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import (BANCO_ADICIONAL, CUMPLE, DETECTION, EXTRA, FALTA_BANCO, FUERA, NO_CONSTRUIDO, NO_CUMPLE, SCORING,
                      TOLERANCES, Scoring, Tolerances)
from ..functions.geometry import direction
from ..functions.status import credit, delta_status, status_rank, tripartite, within_band
from .matching import SECTION_KEYS, paired_sections

BENCH_FIELDS = ("bench_number", "crest_elevation", "crest_distance", "toe_elevation", "toe_distance", "bench_height",
                "face_angle", "berm_width")


def compare(design: DataFrame, topo: DataFrame, tolerances: Tolerances = TOLERANCES, scoring: Scoring = SCORING,
            threshold: float = DETECTION.match_threshold, keys: Sequence[str] = SECTION_KEYS) -> DataFrame:
    """MATCH, MISSING and EXTRA rows of every section with deviations, statuses and scores.

    ``keys`` tell sections apart (project, pit, survey, section as needed). As-built bench fields travel along as the
    struct ``bench_real``. The section's mean score comes from its row of arrays, so benches are shuffled once.
    """
    sections = paired_sections(design, topo, keys, threshold)
    no_d, no_t = (F.lit(None).cast(sections.schema[s].dataType.elementType) for s in ("d", "t"))
    built = F.transform("d", lambda b, i: F.struct(b.alias("d"), F.when(F.get("pairs", i) >= 0, F.get("t", F.get("pairs", i))).otherwise(no_t).alias("t")))
    extra = F.filter(F.transform("t", lambda b, j: F.struct(F.when(F.array_contains("pairs", j), no_d).alias("d"), F.when(~F.array_contains("pairs", j), b).alias("t"))),
                     lambda r: r["t"].isNotNull())
    total = lambda s, r: s + F.when(r["t"].isNull(), 0).otherwise(sum(bench_scores(r["d"]["bench"], r["t"]["bench"], tolerances, scoring).values()))
    mean = F.aggregate("built", F.lit(0), total) / F.nullif(F.size(F.filter("built", lambda r: r["t"].isNotNull())), F.lit(0))
    rows = sections.select(*keys, built.alias("built"), extra.alias("extra")).select(
        *keys, F.bround(F.coalesce(mean, F.lit(0.0)), 1).alias("section_score"), F.explode(F.concat("built", "extra")).alias("r"))
    return comparison_rows(rows.select(*keys, "section_score", F.col("r.d.bench").alias("d"), F.col("r.t.bench").alias("t")), tolerances, scoring, keys)


def bench_scores(d: Column, t: Column, tolerances: Tolerances, scoring: Scoring) -> dict[str, Column]:
    """Points of a matched pair per parameter."""
    points = lambda test, n: F.when(test, n).otherwise(0)
    return {"berm_score": points(F.bround(t["berm_width"], 2) >= tolerances.berm_min, scoring.berm),
            "angle_score": points(within_band(t["face_angle"] - d["face_angle"], tolerances.face_angle), scoring.angle),
            "height_score": points(within_band(t["bench_height"] - d["bench_height"], tolerances.bench_height), scoring.height)}


def comparison_rows(full: DataFrame, tolerances: Tolerances, scoring: Scoring, keys: Sequence[str] = SECTION_KEYS) -> DataFrame:
    """Columns of the comparison from rows of keys, section_score and the bench structs ``d`` and ``t``, one of which may be null."""
    both = F.col("d").isNotNull() & F.col("t").isNotNull()
    kind = F.when(both, "MATCH").when(F.col("t").isNull(), "MISSING").otherwise("EXTRA")
    h = F.col("t.bench_height") - F.col("d.bench_height")
    a = F.col("t.face_angle") - F.col("d.face_angle")
    berm = F.bround("t.berm_width", 2)
    wall = F.when(F.col("d.crest_distance") >= F.col("d.toe_distance"), 1.0).otherwise(-1.0)
    berm_ok = berm >= tolerances.berm_min
    by_kind = lambda match, missing, extra: F.when(both, match).when(F.col("t").isNull(), missing).otherwise(extra)
    toe = F.coalesce("d.toe_elevation", "t.toe_elevation")
    score = {k: F.when(both, v).otherwise(0) for k, v in bench_scores(F.col("d"), F.col("t"), tolerances, scoring).items()}
    has = lambda c: c in full.select("t.*").columns
    sides = [F.col(f"{s}.sector") for s in ("d", "t") if "sector" in full.select(f"{s}.*").columns]
    sector = F.coalesce(*sides) if sides else F.lit(None).cast("string")
    real = F.col("t").dropFields("sector") if sides and "sector" in full.select("t.*").columns else F.col("t")
    rows = full.select(
        sector.alias("sector"), *keys,
        F.when(F.col("d").isNull(), 999).otherwise(F.col("d.bench_number")).cast("int").alias("bench_num"),
        kind.alias("type"), F.bround(toe, 0).cast("int").cast("string").alias("level"),
        F.bround("d.bench_height", 2).alias("height_design"), F.bround("t.bench_height", 2).alias("height_real"),
        F.bround(h, 2).alias("height_dev"),
        by_kind(tripartite(h, tolerances.bench_height), NO_CONSTRUIDO, EXTRA).alias("height_status"),
        F.bround("d.face_angle", 1).alias("angle_design"), F.bround("t.face_angle", 1).alias("angle_real"),
        F.bround(a, 1).alias("angle_dev"),
        by_kind(tripartite(a, tolerances.face_angle), "-", "-").alias("angle_status"),
        F.bround("d.berm_width", 2).alias("berm_design"), berm.alias("berm_real"),
        F.when(both, F.lit(tolerances.berm_min)).alias("berm_min"),
        by_kind(F.when(berm_ok, CUMPLE).otherwise(NO_CUMPLE), FALTA_BANCO, BANCO_ADICIONAL).alias("berm_status"),
        (F.bround("t.spill_width", 2) if has("spill_width") else F.lit(None).cast("double")).alias("spill_width"),
        (F.bround("t.effective_berm_width", 2) if has("effective_berm_width") else F.lit(None).cast("double")).alias("effective_berm"),
        F.bround((F.col("t.crest_distance") - F.col("d.crest_distance")) * wall, 2).alias("delta_crest"),
        F.bround((F.col("t.toe_distance") - F.col("d.toe_distance")) * wall, 2).alias("delta_toe"),
        real.alias("bench_real"), *[v.alias(k) for k, v in score.items()], sum(score.values()).alias("bench_score"), "section_score")
    return rows.withColumn("section_status", F.when(F.col("section_score") >= scoring.pass_mark, CUMPLE).otherwise(NO_CUMPLE))


def achievement_terms(crest_tol: float = TOLERANCES.crest_toe.pos, toe_tol: float = TOLERANCES.crest_toe.pos) -> list[Column]:
    """Aggregates behind the design-achievement score: strict counts, and points of partial credit, which are whole or half
    and so add up exactly in any order."""
    crest, toe, berm = delta_status("delta_crest", crest_tol), delta_status("delta_toe", toe_tol), F.col("berm_status")
    row = 40 * credit(crest) + 30 * credit(toe) + 30 * credit(berm)
    return [F.count(F.lit(1)).alias("n_total"), F.sum(row).alias("points"),
            F.count_if(crest == CUMPLE).alias("n_passing_crest"), F.count_if(toe == CUMPLE).alias("n_passing_toe"),
            F.count_if(berm == CUMPLE).alias("n_passing_berm")]


def achievement_score(comparisons: DataFrame, group: list[str] | None = None, **tolerances) -> DataFrame:
    """Weighted 0-100 achievement with partial credit, and strict percentages per item."""
    agg = comparisons.groupBy(*(group or [])).agg(*achievement_terms(**tolerances))
    pct = lambda c: F.when(F.col("n_total") > 0, F.bround(F.col(c) / F.col("n_total") * 100.0, 0)).otherwise(0.0).cast("int")
    return agg.select(*(group or []), "n_total", "n_passing_crest", "n_passing_toe", "n_passing_berm",
                      pct("n_passing_crest").alias("crest_pct"), pct("n_passing_toe").alias("toe_pct"),
                      pct("n_passing_berm").alias("berm_pct"),
                      F.coalesce(F.when(F.col("n_total") > 0, F.bround(F.col("points") / F.col("n_total"), 0)),
                                 F.lit(0.0)).cast("int").alias("score_0_100"))


def worst_status(comparisons: DataFrame, keys: Sequence[str] = SECTION_KEYS) -> DataFrame:
    """Worst of the three statuses per section."""
    rank = F.greatest(*[status_rank(f"{p}_status") for p in ("height", "angle", "berm")])
    top = comparisons.groupBy(*keys).agg(F.max(rank).alias("r"))
    return top.select(*keys, F.when(F.col("r") == 3, NO_CUMPLE).when(F.col("r") == 2, FUERA).when(F.col("r") == 1, CUMPLE).alias("worst_status"))


def deviated_features(comparisons: DataFrame, sections: DataFrame, min_delta: float = 0.5, keys: Sequence[str] = SECTION_KEYS) -> DataFrame:
    """Crest and toe points of MATCH rows that deviate more than ``min_delta``, with world coordinates."""
    one = lambda name: F.struct(F.lit(name).alias("feature"), F.col(f"delta_{name}").alias("delta"),
                                F.col(f"bench_real.{name}_distance").alias("distance_m"))
    rows = comparisons.where((F.col("type") == "MATCH") & F.col("bench_real").isNotNull()).select(
        *keys, "bench_num", F.explode(F.array(one("crest"), one("toe"))).alias("f")).select(*keys, "bench_num", "f.*")
    dx, dy = direction("azimuth")
    return rows.where(F.abs("delta") > min_delta).join(sections, list(keys)).select(
        *[c for c in ("pit",) if c in sections.columns and c not in keys], *keys, "bench_num", "feature",
        F.bround("delta", 3).alias("delta_m"), "distance_m",
        (F.col("origin_x") + dx * F.col("distance_m")).alias("fx"), (F.col("origin_y") + dy * F.col("distance_m")).alias("fy"))


def filter_comparisons(comparisons: DataFrame, sector=(), level=(), section=(), bench=()) -> DataFrame:
    """Rows that pass every given value list; an empty list filters nothing."""
    for name, values in (("sector", sector), ("level", level), ("section", section), ("bench_num", bench)):
        if values:
            comparisons = comparisons.where(F.col(name).isin(*values))
    return comparisons


SPILL_FIELDS = ("spill_width", "spill_start_distance", "spill_start_elevation")


def filter_benches(benches: DataFrame, numbers=(), show_spill: bool = True) -> DataFrame:
    """Benches with a chosen number; spill figures become zero when hidden."""
    if numbers:
        benches = benches.where(F.col("bench_number").isin(*numbers))
    if not show_spill:
        benches = benches.withColumns({c: F.lit(0.0) for c in SPILL_FIELDS if c in benches.columns})
    return benches


def apply_edits(benches: DataFrame, edits: DataFrame, keys: Sequence[str] = SECTION_KEYS) -> DataFrame:
    """Benches after user edits of crest and toe; derived geometry of edited sections is recomputed.

    ``edits`` has the keys, bench_number and any of the four crest/toe columns; NULL keeps the old value. The berm
    lies in front of the lower bench, as in the extraction.
    """
    moved = ("crest_distance", "crest_elevation", "toe_distance", "toe_elevation")
    new = edits.select(*keys, "bench_number", F.lit(True).alias("_edited"), *[
        (F.col(c) if c in edits.columns else F.lit(None).cast("double")).alias(f"_{c}") for c in moved])
    out = benches.join(new, [*keys, "bench_number"], "left").withColumns({c: F.coalesce(f"_{c}", c) for c in moved})
    dx, dz = F.abs(F.col("toe_distance") - F.col("crest_distance")), F.col("crest_elevation") - F.col("toe_elevation")
    edited = F.coalesce("_edited", F.lit(False))
    angle = F.when(dx > 0.01, F.abs(F.degrees(F.atan2(dz, dx)))).otherwise(90.0)
    out = out.withColumns({"bench_height": F.when(edited, F.abs(dz)).otherwise(F.col("bench_height")),
                           "face_angle": F.when(edited, angle).otherwise(F.col("face_angle"))})
    w = Window.partitionBy(*keys).orderBy("bench_number")
    gap = F.abs(F.col("crest_distance") - F.lag("toe_distance").over(w))
    touched = F.max(edited.cast("int")).over(Window.partitionBy(*keys)) == 1
    out = out.withColumn("berm_width", F.when(touched & gap.isNotNull(), gap).otherwise(F.col("berm_width")))
    return out.select(*benches.columns)
