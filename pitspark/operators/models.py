"""Damage models and advice: fits as aggregates, predictions and recommendations as columns."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ADVISOR, BACKBREAK, NO_CUMPLE
from ..functions import stats
from ..functions.numeric import clamp, finite, ratio
from ..session import cut_lineage

APPLICABLE, CAUTION, INSUFFICIENT = "APPLICABLE", "CAUTION", "INSUFFICIENT_DATA"


def confidence_grade(n: Column, p: Column) -> Column:
    return (F.when((n >= 15) & (p < 0.05), "HIGH").when((n >= 8) & (p < 0.10), "MEDIUM")
            .when((n >= 5) & (p < 0.05), "LOW").otherwise("INSUFFICIENT"))


def fit_line(rows: DataFrame, x: str, y: str, group: list[str] | None = None, min_samples: int = 5) -> DataFrame:
    """Straight line of damage on powder factor, one model row per group, from one mergeable aggregate."""
    group = group or []
    a, b = finite(x), finite(y)
    used = rows.select(*group, a.alias("_x"), b.alias("_y")).where("_x > 0 AND _y IS NOT NULL")
    agg = used.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("_y", "_x").alias("b1"), F.regr_intercept("_y", "_x").alias("b0"),
        F.corr("_x", "_y").alias("r"), F.regr_sxx("_y", "_x").alias("sxx"), F.regr_syy("_y", "_x").alias("syy"),
        F.avg("_x").alias("mean_pf"), F.min("_x").alias("pf_min"), F.max("_x").alias("pf_max"))
    enough = (F.col("n") >= min_samples) & (F.col("sxx") > 0)
    dof = F.greatest(F.col("n") - 2, F.lit(1))
    r = F.coalesce("r", F.lit(0.0))
    error = F.sqrt(F.greatest(1.0 - r * r, F.lit(0.0)) * F.col("syy") / F.col("sxx") / dof)
    t = r * F.sqrt(dof / ((1.0 - r + 1e-20) * (1.0 + r + 1e-20)))
    out = agg.withColumns({"std_err": error, "p": stats.t_two_sided(t, dof), "tq": stats.t_quantile(0.975, dof.cast("double"))})
    zero = lambda c: F.when(enough, c).otherwise(0.0)
    grade = F.when(enough, confidence_grade(F.col("n"), F.col("p"))).otherwise("INSUFFICIENT")
    return out.select(
        *group, "n", zero(F.col("b0")).alias("beta0"), zero(F.col("b1")).alias("beta1"), zero(r * r).alias("r_squared"),
        F.when(enough, F.col("p")).alias("p_value"), zero(F.col("std_err")).alias("std_err_beta1"),
        zero(F.col("b1") - F.col("tq") * F.col("std_err")).alias("ci_beta1_low"),
        zero(F.col("b1") + F.col("tq") * F.col("std_err")).alias("ci_beta1_high"), zero(F.col("mean_pf")).alias("mean_pf"),
        "pf_min", "pf_max", zero(F.col("sxx")).alias("sxx"), grade.alias("confidence"),
        F.coalesce(F.when(enough, F.col("p") < 0.05), F.lit(False)).alias("is_significant"))


def line_band(model: DataFrame, points: int = 50) -> DataFrame:
    """The fitted line with its 95 % band at evenly spaced powder factors."""
    step = (F.col("pf_max") - F.col("pf_min")) / (points - 1)
    grid = model.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("pf_min") + F.col("_i") * step)
    half = F.when(F.col("sxx") > 0, 1.96 * F.col("std_err_beta1") * F.sqrt(1.0 / F.col("n") + F.pow(F.col("x") - F.col("mean_pf"), 2) / F.col("sxx")))
    y = F.col("beta0") + F.col("beta1") * F.col("x")
    return grid.select("x", y.alias("y"), (y - half).alias("low"), (y + half).alias("high"))


FEW_MODELS = 100_000


def with_model(rows: DataFrame, model: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Rows with the fields of their model row as the struct ``m``.

    ``group`` names the columns the model was fitted by: its rows are joined on them, rows of a group without a model get a
    null. Without a group the one model row goes to all rows (to none where there is no model). Several model rows for the
    same rows are an error. Model rows are written once and counted; up to ``FEW_MODELS`` go to every task, so that rows of
    one group are not brought together.
    """
    group = list(group)
    single = lambda found: F.when(F.size(found) > 1, F.raise_error(F.lit("more than one model row for the same rows"))).otherwise(F.get(found, F.lit(0))).alias("m")
    fields = F.collect_list(F.struct(*model.columns)).alias("_found")
    if not group:
        one = model.limit(2).agg(fields).where("size(_found) > 0")
        return rows.join(F.broadcast(one.select(single(F.col("_found")))))
    for name, df in (("rows", rows), ("model", model)):
        if lacking := [k for k in group if k not in df.columns]:
            raise ValueError(f"the {name} lack the group columns {lacking}")
    per_group = cut_lineage(model.groupBy(*[F.col(k).alias(f"_model_{k}") for k in group]).agg(fields))
    few = per_group.count() <= FEW_MODELS
    named = per_group.select(*[f"_model_{k}" for k in group], single(F.col("_found")))
    on = [F.col(k).eqNullSafe(F.col(f"_model_{k}")) for k in group]
    return rows.join(F.broadcast(named) if few else named, on, "left").drop(*[f"_model_{k}" for k in group])


def predict_damage(rows: DataFrame, model: DataFrame, pf: str = "target_pf", group: Sequence[str] = ()) -> DataFrame:
    """Predicted damage and its uncertainty; 0 for a model without confidence, null without a model."""
    known = F.col("m.confidence") != "INSUFFICIENT"
    return with_model(rows, model, group).withColumns({
        "predicted_damage": F.when(known, F.col("m.beta0") + F.col("m.beta1") * F.col(pf)).otherwise(0.0),
        "uncertainty_m": F.when(known, F.col("m.std_err_beta1") * F.abs(F.col(pf) - F.col("m.mean_pf"))).otherwise(0.0)}).drop("m")


PREDICTORS = ("pf_vol", "burden", "spacing_burden_ratio", "stemming")
COLLINEAR = 20.0
COLLINEAR_TEXT = "Posible colinealidad entre predictores (tipicamente PF-burden)."


def _solve(pdf: pd.DataFrame, names: tuple[str, ...], keys: list[str], min_samples: int) -> pd.DataFrame:
    """Coefficients from means and covariances of one group."""
    s = pdf.iloc[0]
    n = int(s["n"])
    mean = np.array([s[f"m_{k}"] for k in names], float)
    full = np.array([[s[f"c_{min(i, j)}_{max(i, j)}"] for j in range(len(names))] for i in range(len(names))], float)
    cross = np.array([s[f"cy_{i}"] for i in range(len(names))], float)
    use = [i for i in range(len(names)) if n and full[i, i] > 1e-12]
    row = {k: s[k] for k in keys}
    row.update(n=n, features_used=[names[i] for i in use])
    if len(use) < 2 or n < min_samples:
        row.update(beta0=0.0, coefficients={}, std_errors={}, t_stats={}, feature_means={}, r_squared=0.0, r_squared_adj=0.0,
                   f_statistic=None, dof=0, condition_number=None, rank_deficient=False, fitted=False)
        return pd.DataFrame([row])
    c, cy, mu = full[np.ix_(use, use)], cross[use], mean[use]
    k = len(use)
    rank_deficient = bool(np.linalg.matrix_rank(c) < k)
    inverse = np.linalg.pinv(c) if rank_deficient else np.linalg.inv(c)
    beta = inverse @ cy
    dof = max(n - k - 1, 1)
    sst = n * float(s["vy"])
    sse = max(sst - n * float(beta @ cy), 0.0)
    se = np.sqrt(np.maximum(np.diag(inverse) / n * sse / dof, 0.0))
    t = np.divide(beta, se, out=np.zeros(k), where=se > 0)
    r2 = 1.0 - sse / sst if sst > 0 else 0.0
    d = np.sqrt(np.diag(c))
    spread = np.linalg.eigvalsh(c / np.outer(d, d))
    condition = float(np.sqrt(spread[-1] / spread[0])) if spread[0] > 0 else float("inf")
    label = lambda v: {names[i]: float(x) for i, x in zip(use, v)}
    row.update(beta0=float(s["my"] - beta @ mu), coefficients=label(beta), std_errors=label(se), t_stats=label(t), feature_means=label(mu),
               r_squared=r2, r_squared_adj=1.0 - (1.0 - r2) * (n - 1) / dof, f_statistic=((sst - sse) / k) / (sse / dof) if sse > 0 else None,
               dof=dof, condition_number=condition, rank_deficient=rank_deficient, fitted=True)
    return pd.DataFrame([row])


def fit_multivariate(rows: DataFrame, damage: str = "avg_over_break", names: tuple[str, ...] = PREDICTORS, group: list[str] | None = None,
                     min_samples: int = 12) -> DataFrame:
    """Least squares on up to four predictors, one model row per group.

    The data meet one aggregate of means and covariances; only those few numbers per group reach the solver.
    """
    keys = group or ["_all"]
    used = F.struct(finite(damage).alias("_y"), *[finite(k).alias(k) for k in names])
    # the values are worked out before the test for nulls, which would repeat them all: code that long the JVM does not compile
    clean = rows.select(*(group or [F.lit(1).alias("_all")]), F.explode(F.array(used)).alias("_used")).select(*keys, "_used.*").dropna(subset=["_y", *names])
    sums = [F.count(F.lit(1)).alias("n"), F.avg("_y").alias("my"), F.var_pop("_y").alias("vy")]
    sums += [F.avg(k).alias(f"m_{k}") for k in names]
    sums += [F.covar_pop(k, "_y").alias(f"cy_{i}") for i, k in enumerate(names)]
    sums += [F.covar_pop(a, b).alias(f"c_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    agg = clean.groupBy(*keys).agg(*sums)
    types = dict(agg.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + (
        ", n long, features_used array<string>, beta0 double, coefficients map<string,double>, std_errors map<string,double>, "
        "t_stats map<string,double>, feature_means map<string,double>, r_squared double, r_squared_adj double, f_statistic double, "
        "dof int, condition_number double, rank_deficient boolean, fitted boolean")
    columns = [c.split()[0] for c in schema.replace("map<string,double>", "m").split(", ")]
    fit = agg.groupBy(*keys).applyInPandas(lambda pdf: _solve(pdf, names, keys, min_samples)[columns], schema)
    collinear = F.col("rank_deficient") | (F.col("condition_number") >= COLLINEAR) | F.isnan("condition_number")
    f_p = stats.f_upper(F.col("f_statistic"), F.size("coefficients"), F.col("dof"))
    out = fit.withColumn("f_pvalue", F.when(F.col("fitted") & F.col("f_statistic").isNotNull(), f_p))
    base = F.when(F.col("fitted"), confidence_grade(F.col("n"), F.col("f_pvalue"))).otherwise("INSUFFICIENT")
    return out.withColumns({
        "p_values": F.transform_values("t_stats", lambda _, t: stats.t_two_sided(t, F.col("dof"))),
        "beta1": F.coalesce(F.col("coefficients")["pf_vol"], F.when(F.size("features_used") > 0, F.col("coefficients")[F.element_at("features_used", 1)]), F.lit(0.0)),
        "confidence": F.when((base != "INSUFFICIENT") & collinear, CAUTION).otherwise(base),
        "collinearity_warning": F.when(F.col("fitted") & collinear, COLLINEAR_TEXT).otherwise(""),
        "is_significant": F.coalesce(F.col("f_pvalue") < 0.05, F.lit(False))}).drop("rank_deficient", "fitted", *([] if group else ["_all"]))


def level_pairs(holes: DataFrame, comparisons: DataFrame, hole_value: Column, delta: str) -> DataFrame:
    """Per bench level: mean of a hole value (by collar elevation less bench height) and mean deviation."""
    floor = F.bround(F.col("z_collar") - F.col("bench_height_m"), 0)
    left = holes.groupBy(floor.cast("int").alias("level_m")).agg(F.avg(hole_value).alias("hole_mean")).where("level_m IS NOT NULL")
    level = F.bround(F.col("level").try_cast("double"), 0).cast("int")
    right = comparisons.where(F.col(delta).isNotNull()).groupBy(level.alias("level_m")).agg(F.avg(delta).alias("delta_mean"))
    return left.join(right, "level_m")


def pair_correlation(pairs: DataFrame) -> DataFrame:
    """Pearson r of the level means with its p-value and reading."""
    agg = pairs.agg(F.count(F.lit(1)).alias("n_benches"), F.corr("hole_mean", "delta_mean").alias("_r"),
                    F.var_pop("hole_mean").alias("_a"), F.var_pop("delta_mean").alias("_b"))
    ok = (F.col("n_benches") >= 2) & (F.col("_a") > 0) & (F.col("_b") > 0)
    r = F.when(ok, F.col("_r")).otherwise(0.0)
    dof = F.greatest(F.col("n_benches") - 2, F.lit(1))
    t = r * F.sqrt(dof / ((1.0 - r + 1e-20) * (1.0 + r + 1e-20)))
    p = F.when(ok, F.when(F.col("n_benches") == 2, 1.0).otherwise(stats.t_two_sided(t, dof)))
    reading = F.when(F.col("n_benches") < 2, "INSUFFICIENT").when(r < -0.3, "NEGATIVE").when(r > 0.3, "POSITIVE").otherwise("WEAK")
    return agg.select("n_benches", r.alias("r"), p.alias("p_value"), reading.alias("reading"))


def feasibility(pct: Column, target: Column, optimum: Column) -> Column:
    upper = optimum * ADVISOR.pf_upper_factor
    return (F.when(target.isNull(), INSUFFICIENT).when(target < 0, CAUTION).when((upper > 0) & (target > upper), CAUTION)
            .when(F.abs(pct) > ADVISOR.max_change_pct, CAUTION).otherwise(APPLICABLE))


def recommend_pf(rows: DataFrame, model: DataFrame, current: str = "current_pf", target_m: float = ADVISOR.target_overbreak_m,
                 group: Sequence[str] = ()) -> DataFrame:
    """Powder factor that would bring the damage to the target, change, feasibility and message."""
    m = lambda f: F.col(f"m.{f}")
    cur = F.col(current)
    signal = (m("confidence") != "INSUFFICIENT") & (m("n") >= ADVISOR.min_samples) & (F.abs(m("beta1")) > 1e-9)
    wanted = F.when(signal, (target_m - m("beta0")) / m("beta1"))
    out = with_model(rows, model, group).withColumns({"_want": wanted, "predicted_current_damage": m("beta0") + m("beta1") * cur})
    out = out.withColumn("target_pf", F.coalesce("_want", cur)).withColumn("delta_pf", F.col("target_pf") - cur)
    pct = F.coalesce(F.when(F.abs(cur) >= 1e-9, F.col("delta_pf") / cur * 100.0), F.lit(0.0))
    out = out.withColumn("delta_pf_pct", pct)
    out = out.withColumn("feasibility", feasibility(F.col("delta_pf_pct"), F.col("_want"), F.lit(ADVISOR.pf_optimal)))
    grade = F.when(signal, m("confidence")).otherwise("INSUFFICIENT")
    p = F.coalesce(F.format_string("%.3f", m("p_value")), F.lit("n/a"))
    upper = ADVISOR.pf_optimal * ADVISOR.pf_upper_factor
    big = F.abs("delta_pf_pct") > ADVISOR.max_change_pct
    verb = F.when(F.col("delta_pf") < 0, "Reducir").when(F.col("delta_pf") > 0, "Aumentar").otherwise("Mantener")
    aim = F.when(F.col("delta_pf") < 0, "acotar sobre-excavacion").when(F.col("delta_pf") > 0, "elevar el dano").otherwise("mantener el dano")
    message = (
        F.when(F.col("feasibility") == INSUFFICIENT, F.format_string(
            "Modelo sin confianza estadistica suficiente (n=%d, p=%s); no se puede emitir recomendacion cuantitativa.", m("n"), p))
        .when((F.col("feasibility") == CAUTION) & big, F.format_string(
            f"Delta PF requerido (%+.0f%%) excede el {ADVISOR.max_change_pct:.0f}%% permitido; revisar patron de carga o subdividir la voladura.", "delta_pf_pct"))
        .when((F.col("feasibility") == CAUTION) & (F.col("target_pf") < 0), F.format_string(
            "PF objetivo (%.2f kg/m3) resulta fisicamente imposible (negativo); revisar beta1 y beta0 del modelo antes de recomendar.", "target_pf"))
        .when(F.col("feasibility") == CAUTION, F.format_string(
            f"PF objetivo (%.2f kg/m3) supera {ADVISOR.pf_upper_factor:g}x el optimo de diseno ({upper:.2f} kg/m3); revisar patron de carga antes de aplicar.", "target_pf"))
        .otherwise(F.format_string(
            f"%s PF de %.2f a %.2f kg/m3 (%+.0f%%) proyecta %s de %.2f m al objetivo de {target_m:.2f} m (modelo p=%s, n=%d, confianza %s).",
            verb, cur, "target_pf", "delta_pf_pct", aim, "predicted_current_damage", p, m("n"), grade)))
    return out.withColumns({"predicted_target_damage": F.lit(float(target_m)), "confidence": grade, "message": message}).drop("_want", "m")


def charge_change(recommended: DataFrame) -> DataFrame:
    """Percentage change of the charge and its direction."""
    pct = F.col("delta_pf_pct")
    return recommended.withColumns({
        "delta_pct": F.when(F.abs(pct) < 1e-6, 0.0).otherwise(pct),
        "direction": F.when(F.abs(pct) < 1e-6, "NONE").when(pct < 0, "REDUCE").otherwise("INCREASE")})


def recommend_by_group(section_table: DataFrame, model: DataFrame, group: str = "sector", pf: str = "pf_vol_avg_kgm3",
                       target_m: float = ADVISOR.target_overbreak_m, model_per_group: bool = False) -> DataFrame:
    """One recommendation per group from its mean powder factor; the design optimum where it has none.

    ``model_per_group``: the model has a row per value of ``group``."""
    means = section_table.groupBy(F.col(group).alias("group_value")).agg(
        F.count(pf).alias("n_wells"), F.coalesce(F.avg(pf), F.lit(ADVISOR.pf_optimal)).alias("current_pf"))
    if model_per_group:
        model = model.withColumnRenamed(group, "group_value")
    return recommend_pf(means, model, "current_pf", target_m, ["group_value"] if model_per_group else ()).withColumnRenamed("predicted_current_damage", "current_damage_pred")


def validate_recommendation(recommended: DataFrame, max_pct: float = ADVISOR.max_change_pct, min_pf: float = ADVISOR.pf_min_operational,
                            max_pf: float = ADVISOR.pf_max_operational) -> DataFrame:
    """Operational limits: warnings, validity and the feasibility they leave."""
    pct, pf = F.col("delta_pf_pct"), F.col("target_pf")
    change = F.abs(pct) > max_pct
    low, high = (pf > 0) & (pf < min_pf), (pf > 0) & (pf > max_pf)
    texts = F.array_compact(F.array(
        F.when(change, F.format_string(f"Cambio propuesto %+.1f%% excede el maximo operativo permitido ({max_pct:.0f}%%).", pct)),
        F.when(low, F.format_string(f"PF objetivo %.3f kg/m3 esta por debajo del minimo operativo ({min_pf:.2f}).", pf)),
        F.when(high, F.format_string(f"PF objetivo %.3f kg/m3 excede el maximo operativo ({max_pf:.2f}); explosivo o burden insuficientes.", pf))))
    return recommended.withColumn("warnings", texts).withColumns({
        "valid": F.size("warnings") == 0,
        "adjusted_feasibility": F.when(low | high, CAUTION).when(change & (F.col("feasibility") == APPLICABLE), CAUTION).otherwise(F.col("feasibility"))})


def recommend_burden(rows: DataFrame, model: DataFrame, current: str = "current_burden", target_m: float = ADVISOR.target_overbreak_m,
                     min_samples: int = 12, min_features: int = 3, group: Sequence[str] = ()) -> DataFrame:
    """Burden that would bring the damage to the target with the other predictors at their means.

    Needs a model with enough samples and features; a target outside half to twice the burden asks for caution.
    """
    m = lambda f: F.col(f"m.{f}")
    cur = F.col(current)
    others = F.aggregate(F.map_entries(m("coefficients")), F.lit(0.0), lambda s, e: s + F.when(
        e["key"] == "burden", 0.0).otherwise(e["value"] * F.coalesce(m("feature_means")[e["key"]], F.lit(0.0))))
    slope = F.coalesce(m("coefficients")["burden"], F.lit(0.0))
    qualifies = (m("n") >= min_samples) & (F.size(m("features_used")) >= min_features) & (m("confidence") != "INSUFFICIENT")
    signal = qualifies & (F.abs(slope) > 1e-9)
    out = with_model(rows, model, group).withColumns({
        "_want": F.when(signal, (target_m - m("beta0") - others) / slope),
        "predicted_current_damage": F.when(qualifies, m("beta0") + others + slope * cur).otherwise(0.0)})
    out = out.withColumn("target_burden", F.coalesce("_want", cur)).withColumn("delta_burden", F.col("target_burden") - cur)
    out = out.withColumn("delta_burden_pct", F.coalesce(F.when(F.abs(cur) >= 1e-9, F.col("delta_burden") / cur * 100.0), F.lit(0.0)))
    outside = (cur > 0) & ((F.col("_want") < 0.5 * cur) | (F.col("_want") > 2.0 * cur))
    grade = F.when(outside, CAUTION).otherwise(feasibility(F.col("delta_burden_pct"), F.col("_want"), cur * (2.0 / ADVISOR.pf_upper_factor)))
    return out.withColumns({"feasibility": grade, "predicted_target_damage": F.lit(float(target_m)),
                            "confidence": F.when(signal, m("confidence")).otherwise("INSUFFICIENT")}).drop("_want", "m")


def explain_failures(comparisons: DataFrame, context: DataFrame | None) -> DataFrame:
    """Why a bench fails: geometry issues, blast causes, advice and severity.

    ``context`` is the table of holes behind each bench (section, bench_num, averages, n_holes).
    """
    rows = comparisons
    if context is not None:
        rows = rows.join(context.withColumn("_known", F.lit(True)), ["section", "bench_num"], "left")
    else:
        for c in ("pf_avg", "stemming_ratio_avg", "subdrill_avg", "burden_avg"):
            rows = rows.withColumn(c, F.lit(None).cast("double"))
        rows = rows.withColumns({"n_holes": F.lit(None).cast("long"), "_known": F.lit(None).cast("boolean")})
    bad = lambda c: F.col(c) == NO_CUMPLE
    two = lambda c: F.coalesce(F.format_string("%.2f", c), F.lit("?"))
    geometry = F.array_compact(F.array(
        F.when(bad("height_status"), F.format_string("Altura real %sm vs diseno %sm (Δ %+.1fm)", two("height_real"), two("height_design"), F.coalesce("height_dev", F.lit(0.0)))),
        F.when(bad("angle_status"), F.format_string("Angulo real %s° vs diseno %s° (Δ %+.1f°)", two("angle_real"), two("angle_design"), F.coalesce("angle_dev", F.lit(0.0)))),
        F.when(bad("berm_status"), F.format_string("Berma real %sm vs minimo %sm", two("berm_real"), two("berm_min")))))
    known, holes = F.coalesce("_known", F.lit(False)), F.col("n_holes") > 0
    tests = (
        ("PF_HIGH", F.col("pf_avg") > 0.9, "Reducir PF a 0.7-0.8 kg/m3 disminuyendo carga de columna"),
        ("PF_LOW", F.col("pf_avg") < 0.5, "Aumentar PF a 0.6-0.8 kg/m3 ajustando burden o carga de fondo"),
        ("STEMMING_LOW", F.col("stemming_ratio_avg") < 0.7, "Aumentar taco a >=70% de la altura del banco"),
        ("SUBDRILL_HIGH", F.col("subdrill_avg") > 2.0, "Controlar pasadura a <=1.5m"),
        ("BURDEN_HIGH", F.col("burden_avg") > 4.0, "Reducir burden o ajustar spacing para mejorar fragmentacion"))
    causes = F.when(~known, F.array(F.lit("NO_CONTEXT"))).when(~holes, F.array(F.lit("NO_HOLES"))).otherwise(
        F.array_compact(F.array(*[F.when(t, code) for code, t, _ in tests])))
    advice = F.when(known & holes, F.array_compact(F.array(*[F.when(t, text) for _, t, text in tests]))).otherwise(F.array().cast("array<string>"))
    out = rows.withColumns({"geometry_issues": geometry, "blast_causes": causes, "_advice": advice})
    issue = F.size("geometry_issues") > 0
    out = out.withColumn("recommendations", F.when(issue, F.concat(
        F.when(F.size("_advice") == 0, F.array(F.lit("Revisar diseno geometrico del banco contra el perfil replanteado"))).otherwise(F.col("_advice")),
        F.array(F.lit("Verificar replanteo topografico y marcacion de limites de banco")))).otherwise(F.col("_advice")))
    score, none = F.col("bench_score"), F.coalesce(F.col("n_holes") == 0, F.lit(False))
    severity = F.when(score.isNull(), F.when(F.coalesce("n_holes", F.lit(0)) == 0, "CRITICAL").otherwise("HIGH")).when(
        (score < 40) | none, "CRITICAL").when(score < 60, "HIGH").otherwise("MEDIUM")
    return out.select("section", "bench_num", "bench_score", "geometry_issues", "blast_causes", "recommendations", severity.alias("severity"))


def predict_backbreak(designs: DataFrame, model: DataFrame | None = None, alpha: float = 0.05, b=BACKBREAK, group: Sequence[str] = ()) -> DataFrame:
    """Back-break per design row: the multivariate model with its interval, else the empirical rule.

    Reads burden_m, spacing_m, pf_kgm3, stemming_m and, where present, rock_factor and bench_height_m. Broken inputs
    are replaced by the defaults and named in ``notes``.
    """
    have = set(designs.columns)
    raw = lambda c: finite(F.col(c).cast("double")) if c in have else F.lit(None).cast("double")
    ok = lambda c: F.coalesce(raw(c) >= 0, F.lit(False))
    defaults = {"burden_m": b.burden_m, "spacing_m": b.spacing_m, "pf_kgm3": b.pf_optimal, "stemming_m": b.stemming_m}
    value = {c: F.when(ok(c), raw(c)).otherwise(v) for c, v in defaults.items()}
    rf0 = F.coalesce(raw("rock_factor"), F.lit(1.0))
    height = F.when(raw("bench_height_m") > 0, raw("bench_height_m")).otherwise(b.bench_height_m)
    swapped = [F.when(~ok(c), f"substituted:{c}") for c in defaults]
    if "rock_factor" in have:
        swapped.append(F.when(raw("rock_factor").isNull(), "substituted:rock_factor"))
    clamped = F.when((rf0 < b.rock_factor_min) | (rf0 > b.rock_factor_max), "clamped:rock_factor")
    df = designs.withColumns({**{f"_{c}": v for c, v in value.items()}, "_rf": clamp(rf0, b.rock_factor_min, b.rock_factor_max),
                              "_h": height, "_swapped": F.array_compact(F.array(*swapped)), "_clamp": clamped,
                              "_none": raw("burden_m").isNull() & raw("spacing_m").isNull() & raw("pf_kgm3").isNull() & raw("stemming_m").isNull()})
    burden, spacing, pf, stem = (F.col(f"_{c}") for c in defaults)
    share = F.when(pf > 0, pf / b.pf_optimal).otherwise(1.0)
    emp = F.greatest(b.empirical_k * burden * share * F.col("_rf"), F.lit(0.0))
    hp = F.greatest(F.least(b.hp_constant * F.sqrt(pf * burden * spacing * F.col("_h")), b.clamp_high_b * burden), b.clamp_low_b * burden)
    any_swap = F.size("_swapped") > 0
    empirical = F.struct(
        F.when(F.col("_none"), 0.0).otherwise(emp).alias("predicted_m"),
        F.when(F.col("_none"), 0.0).otherwise(F.greatest(emp * (1 - b.ci_band), F.lit(0.0))).alias("ci_low_m"),
        F.when(F.col("_none"), 0.0).otherwise(emp * (1 + b.ci_band)).alias("ci_high_m"), F.lit("empirical_fallback").alias("method"),
        F.when(F.col("_none"), "INSUFFICIENT").when(any_swap, "LOW").otherwise("MEDIUM").alias("confidence"))
    result = empirical
    if model is not None:
        # the quantile belongs to the model row: worked out once, not per design
        df = with_model(df, model.withColumn("tq", stats.t_quantile(1 - alpha / 2, F.greatest("dof", F.lit(1)).cast("double"))), group)
        m = lambda f: F.col(f"m.{f}")
        feature = {"pf_vol": pf, "burden": burden, "spacing_burden_ratio": F.coalesce(ratio(spacing, burden), F.lit(1.0)), "stemming": stem}
        shape, error = m("beta0"), F.lit(0.0)
        for k, x in feature.items():
            shape = shape + F.coalesce(m("coefficients")[k] * x, F.lit(0.0))
            error = error + F.coalesce(F.pow(m("std_errors")[k] * x, 2), F.lit(0.0))
        mean_se2 = F.aggregate(F.map_values(m("std_errors")), F.lit(0.0), lambda s, v: s + v * v) / F.greatest(F.size(m("std_errors")), F.lit(1))
        half = m("tq") * F.sqrt(error + mean_se2 * F.greatest(m("n"), F.lit(1)))
        in_range = F.lit(True)
        for k, x in feature.items():
            mean = m("feature_means")[k]
            in_range = in_range & F.coalesce((mean <= 0) | (x / mean).between(0.5, 2.0), F.lit(True))
        grade = F.when(any_swap, "LOW").when((m("confidence") == "HIGH") & ~in_range, "MEDIUM").otherwise(m("confidence"))
        point = F.greatest(shape, F.lit(0.0))
        fitted = F.struct(point.alias("predicted_m"), F.least(shape - half, point).alias("ci_low_m"), F.greatest(shape + half, point).alias("ci_high_m"),
                          F.lit("multivariate").alias("method"), grade.alias("confidence"))
        usable = (m("confidence") != "INSUFFICIENT") & (F.size(m("coefficients")) > 0)
        result = F.when(usable, fitted).otherwise(empirical)
    out = df.withColumn("_r", result)
    drop = [c for c in out.columns if c.startswith("_") or c == "m"]
    fallback = F.when(F.lit(model is not None) & (F.col("_r.method") != "multivariate"), "multivariate_not_available, using empirical_fallback")
    return out.withColumns({
        "predicted_m": F.col("_r.predicted_m"), "ci_low_m": F.col("_r.ci_low_m"), "ci_high_m": F.col("_r.ci_high_m"),
        "method": F.col("_r.method"), "confidence": F.col("_r.confidence"), "holmberg_persson_m": hp,
        "notes": F.concat(F.col("_swapped"), F.array_compact(F.array(F.col("_clamp"), fallback)))}).drop(*drop)
