"""Blast against geotechnics: section, level and pattern tables, trends and outliers."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import BLAST
from ..operators.compliance import achievement_terms
from ..operators.matching import SECTION_KEYS
from ..operators.spatial import exact_quantiles
from ..session import cut_lineage

PF_COLUMNS = ("pf_vol_kgm3", "pf_g_per_ton", "pf_g_per_ton_net", "pf_g_per_ton_inf")


def powder_factor_by_group(projected: DataFrame, group: list[str]) -> DataFrame:
    """Mean and kg-weighted mean powder factors, energy, kg and counts per group, in one aggregate."""
    kg = F.coalesce("kg", F.lit(0.0))
    sums = [
        F.count(F.lit(1)).alias("n_wells"), F.sum(kg).alias("kg_total"), F.count("pf_vol_kgm3").alias("n_pf_valid"),
        F.coalesce(F.sum("energy_mj"), F.lit(0.0)).alias("energy_total_mj"), F.avg("pf_area_kgm2").alias("pf_area_avg")]
    for name in PF_COLUMNS:
        short = name.replace("_kgm3", "")
        weight = F.sum(F.when(F.col(name).isNotNull(), kg))
        sums.append(F.avg(name).alias(f"{short}_avg"))
        sums.append(F.when(weight > 0, F.sum(F.col(name) * kg) / weight).alias(f"{short}_weighted"))
    return projected.groupBy(*group).agg(*sums)


def signed_deviations(comparisons: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Mean and count of positive and negative crest deviations per section (or other ``group``).

    Sections without any crest deviation fall back to the toe, then to absolute height, then absolute angle
    deviations, which all count as positive.
    """
    group = list(group or SECTION_KEYS)
    plus = lambda c: F.avg(F.when(F.col(c) > 0, F.col(c)))
    minus = lambda c: F.avg(F.when(F.col(c) < 0, F.col(c)))
    n_plus = lambda c: F.count_if(F.col(c) > 0)
    n_minus = lambda c: F.count_if(F.col(c) < 0)
    stats = comparisons.groupBy(*group).agg(
        F.count("delta_crest").alias("nc"), F.count("delta_toe").alias("nt"),
        F.count("height_dev").alias("nh"), F.count("angle_dev").alias("na"),
        *[f(c).alias(f"{n}_{c}") for c in ("delta_crest", "delta_toe")
          for n, f in (("p", plus), ("m", minus), ("np", n_plus), ("nm", n_minus))],
        F.avg(F.abs("height_dev")).alias("h"), F.avg(F.abs("angle_dev")).alias("a"),
        F.avg(F.abs("delta_crest")).alias("mean_abs_deviation"))
    pick = lambda c, t, h, a: F.when(F.col("nc") > 0, c).when(F.col("nt") > 0, t).when(F.col("nh") > 0, h).when(F.col("na") > 0, a)
    zero, none = F.lit(0.0), F.lit(0).cast("long")
    return stats.select(
        *group,
        F.coalesce(pick(F.col("p_delta_crest"), F.col("p_delta_toe"), F.col("h"), F.col("a")), zero).alias("avg_over"),
        F.coalesce(pick(F.col("m_delta_crest"), F.col("m_delta_toe"), zero, zero), zero).alias("avg_under"),
        F.coalesce(pick(F.col("np_delta_crest"), F.col("np_delta_toe"), F.col("nh"), F.col("na")), none).alias("n_over"),
        F.coalesce(pick(F.col("nm_delta_crest"), F.col("nm_delta_toe"), none, none), none).alias("n_under"),
        F.coalesce("mean_abs_deviation", zero).alias("mean_abs_deviation"))


def section_correlation(projected: DataFrame, sections: DataFrame, comparisons: DataFrame,
                        rock_density: float = BLAST.rock_density_tm3, sector_density: dict[str, float] | None = None,
                        keys: Sequence[str] = SECTION_KEYS) -> DataFrame:
    """One row per section: hole counts, kg, powder factors and signed deviations; every section is kept.

    ``keys`` tell sections apart and stand in all three tables.

    ``sector_density`` overrides the rock density of its sectors; the mass-based factors scale with it.
    """
    rho = F.lit(float(rock_density))
    for sector, value in (sector_density or {}).items():
        rho = F.when(F.col("sector") == sector, F.lit(float(value))).otherwise(rho)
    keys = list(keys)
    pf = powder_factor_by_group(projected, keys)
    dev = signed_deviations(comparisons, keys)
    base = sections.select(*keys, "sector").withColumn("rock_density_used", rho)
    joined = base.join(pf, keys, "left").join(dev, keys, "left")
    scale = F.lit(float(rock_density)) / F.col("rock_density_used")
    zero = lambda c: F.coalesce(c if not isinstance(c, str) else F.col(c), F.lit(0.0))
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return joined.select(
        *keys, "sector", count("n_wells").alias("num_wells"), zero("kg_total").alias("total_kg"),
        zero("mean_abs_deviation").alias("mean_abs_deviation"),
        zero("avg_over").alias("avg_over_break"), zero("avg_under").alias("avg_under_break"),
        count("n_over").alias("n_over"), count("n_under").alias("n_under"),
        zero("pf_vol_avg").alias("pf_vol_avg_kgm3"), zero("pf_area_avg").alias("pf_area_avg_kgm2"),
        zero(F.col("pf_g_per_ton_avg") * scale).alias("pf_g_per_ton_avg"),
        zero(F.col("pf_g_per_ton_net_avg") * scale).alias("pf_g_per_ton_net_avg"),
        zero(F.col("pf_g_per_ton_inf_avg") * scale).alias("pf_g_per_ton_inf_avg"),
        zero("energy_total_mj").alias("energy_total_mj"), count("n_pf_valid").alias("n_pf_valid"),
        "rock_density_used")


def _signed_means(df: DataFrame, group: list[str]) -> DataFrame:
    zero = F.lit(0.0)
    out = []
    for c, name in (("delta_crest", "crest"), ("delta_toe", "toe")):
        out.append(F.coalesce(F.avg(F.when(F.col(c) > 0, F.col(c))), zero).alias(f"avg_dev_{name}_over"))
        out.append(F.coalesce(F.avg(F.when(F.col(c) < 0, F.col(c))), zero).alias(f"avg_dev_{name}_under"))
    return df.groupBy(*group).agg(*out)


def level_correlation(projected: DataFrame, comparisons: DataFrame, reach: float = BLAST.correlation_radius_m,
                      keys: Sequence[str] = SECTION_KEYS) -> DataFrame:
    """Per bench level: projected holes with collars near the level, and crest and toe deviations.

    Powder factors are the mean of the section means, as in the section table. Holes are reduced to one row per
    (collar elevation, section) before they meet the levels.
    """
    levels = comparisons.select("level", F.col("level").try_cast("double").alias("_z")).distinct()
    kg = F.coalesce("kg", F.lit(0.0))
    pre = projected.groupBy(*keys, "z_collar").agg(
        F.count(F.lit(1)).alias("n"), F.sum(kg).alias("kg"), F.sum("pf_vol_kgm3").alias("v"), F.count("pf_vol_kgm3").alias("nv"),
        F.sum("pf_area_kgm2").alias("a"), F.count("pf_area_kgm2").alias("na"), F.sum("energy_mj").alias("e"))
    bucket = lambda c: F.floor(F.col(c) / reach)
    near = (
        levels.where("_z IS NOT NULL").withColumn("_b", F.explode(F.array(bucket("_z") - 1, bucket("_z"), bucket("_z") + 1)))
        .join(pre.withColumn("_b", bucket("z_collar")), "_b").where(F.abs(F.col("z_collar") - F.col("_z")) <= reach))
    per_section = near.groupBy("level", *keys).agg(
        F.sum("n").alias("n"), F.sum("kg").alias("kg"), F.sum("e").alias("e"),
        (F.sum("v") / F.nullif(F.sum("nv"), F.lit(0))).alias("v"), (F.sum("a") / F.nullif(F.sum("na"), F.lit(0))).alias("a"))
    blast = per_section.groupBy("level").agg(
        F.sum("n").alias("num_pozos"), F.sum("kg").alias("total_kg"), F.avg("v").alias("pf_vol_avg_kgm3"),
        F.avg("a").alias("pf_area_avg_kgm2"), F.sum("e").alias("energy_total_mj"))
    return _signed_means(comparisons, ["level"]).join(blast, "level", "left").select(
        "level", F.coalesce("num_pozos", F.lit(0)).cast("long").alias("num_pozos"),
        F.coalesce("total_kg", F.lit(0.0)).alias("total_kg"),
        "avg_dev_crest_over", "avg_dev_crest_under", "avg_dev_toe_over", "avg_dev_toe_under",
        "pf_vol_avg_kgm3", "pf_area_avg_kgm2", F.coalesce("energy_total_mj", F.lit(0.0)).alias("energy_total_mj"))


def pattern_correlation(holes: DataFrame, projected: DataFrame, comparisons: DataFrame, section_table: DataFrame,
                        keys: Sequence[str] = SECTION_KEYS) -> DataFrame:
    """Per blast pattern: kg, powder factor, deviations of the sections it projects into, achievement score."""
    keys, kg = list(keys), F.coalesce("kg", F.lit(0.0))
    base = holes.where("malla IS NOT NULL").groupBy("malla").agg(F.count(F.lit(1)).alias("num_pozos"), F.sum(kg).alias("total_kg"))
    per = projected.where("malla IS NOT NULL").groupBy("malla", *keys).agg(
        F.avg("pf_vol_kgm3").alias("v"), F.coalesce(F.sum("energy_mj"), F.lit(0.0)).alias("e"))
    blast = per.groupBy("malla").agg(F.avg("v").alias("pf_vol_avg_kgm3"), F.sum("e").alias("energy_total_mj"))
    links = per.select("malla", *keys)
    # comparisons shrink to one row of sums per section before they fan out to patterns
    signed = lambda c, test: F.when(test, F.col(c))
    sums = comparisons.groupBy(*keys).agg(
        *[f(signed(c, F.col(c) > 0 if s == "over" else F.col(c) < 0)).alias(f"{n}_{c}_{s}")
          for c in ("delta_crest", "delta_toe") for s in ("over", "under") for n, f in (("s", F.sum), ("n", F.count))],
        *achievement_terms())
    fanned = links.join(sums, keys).groupBy("malla").agg(
        *[F.coalesce(F.sum(f"s_{c}_{s}") / F.nullif(F.sum(f"n_{c}_{s}"), F.lit(0)), F.lit(0.0)).alias(
            f"avg_dev_{c.removeprefix('delta_')}_{s}") for c in ("delta_crest", "delta_toe") for s in ("over", "under")],
        F.bround(F.sum("points") / F.sum("n_total"), 0).cast("int").alias("score_pct"))
    over = links.join(section_table.select(*keys, "avg_over_break"), keys).groupBy("malla").agg(
        F.avg("avg_over_break").alias("avg_overbreak"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return base.join(blast, "malla", "left").join(fanned, "malla", "left").join(over, "malla", "left").select(
        "malla", "num_pozos", "total_kg", zero("avg_dev_crest_over"), zero("avg_dev_crest_under"),
        zero("avg_dev_toe_over"), zero("avg_dev_toe_under"), zero("avg_overbreak"), "pf_vol_avg_kgm3",
        zero("energy_total_mj"), F.coalesce("score_pct", F.lit(0)).alias("score_pct"))


def section_areas(section_table: DataFrame, areas: DataFrame, keys: Sequence[str] = SECTION_KEYS) -> DataFrame:
    """Section table with the areas between design and as-built profiles; only sections with both profiles."""
    return section_table.join(areas.select(*keys, "area_topo_below", "area_topo_above"), list(keys))


def monthly_trend(holes: DataFrame, damage: str | None = None) -> DataFrame:
    """Monthly mean powder factor, damage and hole count, with one line fitted on the month number.

    The fit needs at least three months and a powder factor in every month.
    """
    month = holes.where("fecha IS NOT NULL").groupBy(F.date_format("fecha", "yyyy-MM").alias("mes")).agg(
        F.avg("pf_vol_kgm3").alias("pf_promedio"),
        (F.avg(damage) if damage else F.lit(None).cast("double")).alias("damage_promedio"),
        F.count(F.lit(1)).alias("n_pozos"))
    # one row per calendar month is left here, so a single window is small whatever the input size
    numbered = month.withColumn("_i", F.row_number().over(Window.orderBy("mes")) - 1)
    fit = numbered.agg(
        F.when((F.count(F.lit(1)) >= 3) & (F.count("pf_promedio") == F.count(F.lit(1))),
               F.struct(F.regr_slope("pf_promedio", "_i").alias("a"), F.regr_intercept("pf_promedio", "_i").alias("b"))).alias("_fit"))
    return numbered.join(F.broadcast(fit)).select(
        "mes", "pf_promedio", "damage_promedio", "n_pozos",
        F.col("_fit.a").alias("trend_slope"), F.col("_fit.b").alias("trend_intercept"))


def outliers_iqr(df: DataFrame, value: str = "pf_vol_kgm3", k: float = 1.5) -> DataFrame:
    """Rows outside the quartile fences; none when under four values or when the quartiles coincide."""
    n = df.agg(F.count(value)).first()[0]
    if n < 4:
        return df.where(F.lit(False))
    q1, q3 = exact_quantiles(df, value, [0.25, 0.75])
    spread = q3 - q1
    if spread == 0:
        return df.where(F.lit(False))
    return df.where((F.col(value) < q1 - k * spread) | (F.col(value) > q3 + k * spread))


def campaign_cohort(holes: DataFrame, start) -> DataFrame:
    """Cohort column: before (up to the start date), after, NULL without a date."""
    day = F.to_date(F.lit(start))
    return holes.withColumn("cohort", F.when(F.col("fecha") <= day, "before").when(F.col("fecha") > day, "after"))


def trend_metadata(section_table: DataFrame, holes: DataFrame) -> DataFrame:
    """One row: mean and population deviation of the positive section factors, outliers, spacing ratio.

    The quartiles read the section table many times, so it is worked out once.
    """
    section_table = cut_lineage(section_table.select("num_wells", "pf_vol_avg_kgm3"))
    positive = section_table.where("pf_vol_avg_kgm3 > 0")
    outside = outliers_iqr(positive, "pf_vol_avg_kgm3")
    stats = positive.agg(F.bround(F.avg("pf_vol_avg_kgm3"), 3).alias("pf_promedio"),
                         F.bround(F.stddev_pop("pf_vol_avg_kgm3"), 3).alias("pf_desviacion"))
    count = section_table.agg(F.sum("num_wells").alias("n_pozos_total"))
    sb = holes.agg(F.avg(F.when(F.col("burden") > 0, F.col("spacing") / F.col("burden"))).alias("sb_ratio"))
    n_out = outside.agg(F.count(F.lit(1)).alias("n_outliers"))
    return stats.join(count).join(sb).join(n_out)


def signed_correlations(section_table: DataFrame, x: str) -> DataFrame:
    """Pearson r of over and under break against ``x``; 0 where it is undefined."""
    base = F.coalesce(F.col(x), F.lit(0.0))

    def r(y: str, test) -> F.Column:
        a, b = F.when(test, base), F.when(test, F.col(y))
        spread = (F.var_pop(a) > 0) & (F.var_pop(b) > 0)
        return F.coalesce(F.when(spread & (F.count(a) > 1), F.corr(a, b)), F.lit(0.0))

    return section_table.agg(
        r("avg_over_break", F.col("avg_over_break") > 0).alias("r_over"),
        r("avg_under_break", F.col("avg_under_break") < 0).alias("r_under"))


def deviation_scatter(section_table: DataFrame, x: str) -> DataFrame:
    """Scatter rows with the side of the deviation and the trend line of the positive side."""
    over = F.col("avg_over_break") > 0
    sides = section_table.select("section", F.coalesce(F.col(x), F.lit(0.0)).alias("x"), F.explode(F.array_compact(F.array(
        F.when(over, F.struct(F.lit("over").alias("side"), F.col("avg_over_break").alias("y"))),
        F.when(F.col("avg_under_break") < 0, F.struct(F.lit("under").alias("side"), F.col("avg_under_break").alias("y")))))).alias("p"))
    points = sides.select("section", "x", "p.side", "p.y")
    fit = points.where("side = 'over'").agg(
        F.when((F.count(F.lit(1)) > 1) & (F.var_pop("x") > 0),
               F.struct(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))).alias("f"))
    return points.join(F.broadcast(fit)).select(
        "section", "side", "x", "y", F.col("f.slope").alias("trend_slope"), F.col("f.intercept").alias("trend_intercept"))
