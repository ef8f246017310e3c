"""Bench height provenance, burden and spacing fallback, and the powder factor family."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BLAST
from ..functions import blast, explosives
from ..functions.numeric import null_double, ratio
from .spatial import k_nearest

MSG_INVALID = "Altura de banco inválida (≤0): indicadores dependientes bloqueados"
MSG_MISSING = "Altura de banco ausente: indicadores dependientes bloqueados (sin supuesto silencioso)"
MSG_ASSUMED = "Supuesto explícito autorizado: altura de banco de configuración visible"


def resolve_bench_height(holes: DataFrame, column: str | None = "bench_height_m", value: float | None = None,
                         source: str = "event_provided", allow_assumption: bool = False) -> DataFrame:
    """Bench height with its provenance: column, else argument, else an authorised assumption, else blocked."""
    if column and column in holes.columns:
        raw = F.col(column)
        height = F.when(raw > 0, raw)
        status = F.when(raw.isNull(), "MISSING").when(raw > 0, "PROVIDED").otherwise("INVALID")
        origin, assumed = F.lit("data_column"), raw.isNull()
    elif value is not None:
        ok = value == value and value > 0
        height = F.lit(float(value)) if ok else null_double()
        good = "DERIVED" if source == "derived_from_surfaces" else "PROVIDED"
        status = F.lit(good if ok else ("MISSING" if value != value else "INVALID"))
        origin, assumed = F.lit(source), F.lit(not ok)
    elif allow_assumption:
        height, status = F.lit(BLAST.default_bench_height), F.lit("EXPLICIT_ASSUMPTION")
        origin, assumed = F.lit("default_assumption_config"), F.lit(True)
    else:
        height, status, origin, assumed = null_double(), F.lit("MISSING"), F.lit(""), F.lit(True)
    message = (F.when(status == "INVALID", MSG_INVALID).when(status == "MISSING", MSG_MISSING)
               .when(status == "EXPLICIT_ASSUMPTION", MSG_ASSUMED).otherwise(F.lit("")))
    return holes.withColumns({
        "bench_height_m": height, "bench_height_status": status, "bench_height_source": origin,
        "bench_height_assumption_flag": assumed, "bench_height_user_confirmed": ~status.isin("MISSING", "INVALID"),
        "bench_height_validation_message": message})


def pattern_spacing(holes: DataFrame, k: int = 4, group: list[str] | None = None) -> DataFrame:
    """Median distance to the k nearest collars of the same pattern, one row per distinct position."""
    group = group or ["malla"]
    near = k_nearest(holes.where(F.col("x").isNotNull() & F.col("y").isNotNull()), k, group)
    n = F.size("distances")
    middle = F.floor((n + 1) / 2).cast("int")
    median = F.when(n % 2 == 1, F.element_at("distances", F.greatest(middle, F.lit(1)))).otherwise(
        (F.element_at("distances", F.greatest(middle, F.lit(1))) + F.element_at("distances", middle + 1)) / 2)
    return near.where(n > 0).select(*group, "x", "y", median.alias("spacing_est_m"))


def fill_burden_spacing(holes: DataFrame, group: list[str] | None = None) -> DataFrame:
    """``burden_est_m`` and ``esp_est_m``: declared values, or the neighbour estimate where a whole pattern has none.

    Only holes of those patterns enter the neighbour search.
    """
    group = group or ["malla"]
    lack = holes.groupBy(*group).agg(
        (F.count("burden") == 0).alias("_no_burden"), (F.count("spacing") == 0).alias("_no_spacing"))
    need = lack.where("_no_burden OR _no_spacing")
    marked = holes.join(need, group, "left")
    candidates = holes.join(need.select(*group), group, "left_semi")
    estimate = pattern_spacing(candidates.select(*group, "x", "y"), group=group)
    keys = [*group, "x", "y"]
    out = marked.join(estimate, keys, "left")
    return out.withColumns({
        "burden_est_m": F.when(F.coalesce("_no_burden", F.lit(False)), F.col("spacing_est_m")).otherwise(F.col("burden")),
        "esp_est_m": F.when(F.coalesce("_no_spacing", F.lit(False)), F.col("spacing_est_m")).otherwise(F.col("spacing")),
    }).drop("_no_burden", "_no_spacing", "spacing_est_m")


def powder_factors(holes: DataFrame, rock_density=BLAST.rock_density_tm3, influence: DataFrame | None = None,
                   height_fallback: float | None = None, estimate_spacing: bool = True, hole_key: str = "hole_id") -> DataFrame:
    """Powder factors per hole: volume, area, g/t over the real, net and influence geometry, and energy.

    ``influence`` (hole key, area_m2, area_status, collar_inside_domain, conservation_ok) comes from the influence
    area job; collars outside their domain lose all five factors, a failed conservation check blocks the influence
    one. ``height_fallback`` is only used when the caller authorises that assumption by passing it.
    """
    if estimate_spacing:
        out = fill_burden_spacing(holes)
    else:
        out = holes.withColumns({"burden_est_m": F.col("burden"), "esp_est_m": F.col("spacing")})
    if influence is not None:
        out = out.join(influence.select(
            hole_key, F.col("area_m2").alias("area_influence_m2"), "area_status", "collar_inside_domain",
            "conservation_ok"), hole_key, "left")
    else:
        out = out.withColumns({"area_influence_m2": null_double(), "collar_inside_domain": F.lit(True),
                               "conservation_ok": F.lit(True)})
    rho = F.lit(float(rock_density)) if isinstance(rock_density, (int, float)) else rock_density
    footprint = F.col("burden_est_m") * F.col("esp_est_m")
    known = (F.col("len") > 0) & (F.col("incl") >= 0)
    real = F.when(known, F.col("len") * F.cos(F.radians("incl")))
    if height_fallback is not None and height_fallback > 0:
        real = F.coalesce(real, F.lit(float(height_fallback)))
    out = out.withColumn("height_real_m", real)
    extra = blast.subdrill()
    net = F.col("height_real_m") - F.when(extra >= 0, extra).otherwise(0.0)
    out = out.withColumn("height_net_m", F.when(F.col("bench_height_m").isNotNull() & (net > 0), net))
    grams = F.col("kg") * 1000.0
    inside = F.coalesce("collar_inside_domain", F.lit(True))
    keep = lambda c: F.when(inside, c)
    return out.withColumns({
        "pf_vol_kgm3": keep(ratio("kg", footprint * F.col("bench_height_m"))),
        "pf_area_kgm2": keep(ratio("kg", footprint)),
        "pf_g_per_ton": keep(ratio(grams, footprint * F.col("height_real_m") * rho)),
        "pf_g_per_ton_net": keep(ratio(grams, footprint * F.col("height_net_m") * rho)),
        "pf_g_per_ton_inf": F.when(inside & F.coalesce("conservation_ok", F.lit(False)),
                                   ratio(grams, F.col("area_influence_m2") * F.col("height_real_m") * rho)),
        "energy_mj": F.col("kg") * explosives.energy("product"),
    })


def enrich(holes: DataFrame, ucs_mpa: float | None = None) -> DataFrame:
    """All derived ratios the present columns allow."""
    have = set(holes.columns)
    wanted = {
        "stemming_ratio": ({"burden", "taco_m"}, blast.stemming_ratio()),
        "subdrilling_ratio": ({"burden", "z_collar", "z_toe", "bench_height_m"}, blast.subdrilling_ratio()),
        "spacing_burden_ratio": ({"burden", "spacing"}, blast.spacing_burden_ratio()),
        "kg_per_meter": ({"kg", "len"}, blast.kg_per_meter()),
        "hole_fill_fraction": ({"kg", "len", "diam_mm", "product"}, blast.hole_fill_fraction()),
        "equivalent_charge_diameter_m": ({"kg", "len", "product"}, blast.equivalent_charge_diameter()),
        "coupling_ratio": ({"kg", "len", "diam_mm", "product"}, blast.coupling_ratio()),
        "collar_deviation_deg": ({"incl", "az", "incl_design", "az_design"}, blast.collar_deviation()),
        "kuznetsov_x50_cm": ({"kg", "product", "burden", "spacing", "bench_height_m"}, blast.kuznetsov_x50()),
        "bottom_column_ratio": ({"bottom_kg", "column_kg"}, blast.bottom_column_ratio()),
        "altura_carga_m": ({"len", "taco_m"}, blast.charge_column()),
    }
    if ucs_mpa is not None:
        wanted["ispu"] = ({"burden", "spacing", "bench_height_m", "energy_mj"}, blast.ispu(F.lit(float(ucs_mpa))))
    add = {name: expr for name, (need, expr) in wanted.items() if need <= have}
    if "product" in have:
        add.update(explosives.provenance("product"))
    return holes.withColumns(add)
