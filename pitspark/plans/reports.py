"""Report tables over comparison rows. The five compliance percentages differ on purpose in what they divide by."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CUMPLE, FUERA, NO_CUMPLE, TOLERANCES, Tolerances
from ..functions.status import is_passing
from ..operators.matching import SECTION_KEYS
from ..operators.stability import assess, section_health

PARAMETERS = ("height", "angle", "berm")


def long_statuses(comparisons: DataFrame) -> DataFrame:
    """One row per comparison and parameter, with status and real value."""
    cells = F.array(*[F.struct(F.lit(p).alias("parameter"), F.col(f"{p}_status").alias("status"), F.col(f"{p}_real").alias("real")) for p in PARAMETERS])
    return comparisons.select("*", F.explode(cells).alias("_p")).select("*", "_p.*").drop("_p")


def _pct(part: Column, whole: Column) -> Column:
    return F.coalesce(F.when(whole > 0, part / whole * 100.0), F.lit(0.0))


def workbook_summary(comparisons: DataFrame) -> DataFrame:
    """Pass rate per parameter over MATCH rows."""
    rows = long_statuses(comparisons.where("type = 'MATCH'"))
    n = F.count(F.lit(1))
    return rows.groupBy("parameter").agg(
        F.count_if(F.col("status") == CUMPLE).alias("n_ok"), F.count_if(F.col("status").isin(FUERA, NO_CUMPLE)).alias("n_fail"),
        n.alias("total"), _pct(F.count_if(F.col("status") == CUMPLE), n).alias("pct"))


def dashboard(comparisons: DataFrame) -> DataFrame:
    """Pass rate per parameter over all rows, plus the overall rate over the three statuses of every row."""
    ok = lambda p: F.count_if(F.col(f"{p}_status") == CUMPLE)
    bad = lambda p: F.count_if(F.col(f"{p}_status").isin(FUERA, NO_CUMPLE))
    n = F.count(F.lit(1))
    agg = comparisons.agg(n.alias("n"), *[ok(p).alias(f"ok_{p}") for p in PARAMETERS], *[bad(p).alias(f"bad_{p}") for p in PARAMETERS])
    cell = lambda name, good, fail, total: F.struct(F.lit(name).alias("parameter"), good.alias("n_ok"), fail.alias("n_fail"), _pct(good, total).alias("pct"))
    total = lambda prefix: sum(F.col(f"{prefix}_{p}") for p in PARAMETERS)
    cells = [cell(p, F.col(f"ok_{p}"), F.col(f"bad_{p}"), F.col("n")) for p in PARAMETERS]
    cells.append(cell("all", total("ok"), total("bad"), F.col("n") * 3))
    return agg.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def sector_summary(comparisons: DataFrame) -> DataFrame:
    """Passing shares per sector and, from the same pass, over all sectors (sector NULL)."""
    n = F.count(F.lit(1))
    ok = {p: F.count_if(is_passing(f"{p}_status")) for p in PARAMETERS}
    return comparisons.rollup("sector").agg(
        F.grouping("sector").alias("is_total"), n.alias("n_benches"), _pct(ok["height"] + ok["angle"] + ok["berm"], n * 3).alias("pct_global"),
        *[_pct(v, n).alias(f"pct_{p}") for p, v in ok.items()])


def bench_sheet(comparisons: DataFrame) -> DataFrame:
    b = lambda f: F.col(f"bench_real.{f}")
    return comparisons.select(
        "sector", "section", "bench_num", "level", "height_design", "height_real", "height_dev", "height_status", "angle_design",
        "angle_real", "angle_dev", "angle_status", "berm_design", "berm_real", "berm_min", "berm_status", "delta_crest", "delta_toe",
        F.bround(b("floor_elevation"), 1).alias("floor_elevation"), F.bround(b("bench_height"), 1).alias("total_height"),
        F.bround(F.abs(b("crest_elevation") - b("toe_elevation")), 1).alias("toe_height"))


def interramp_table(section_params: DataFrame, keys: Sequence[str] = SECTION_KEYS) -> DataFrame:
    """Inter-ramp and overall angles of design and as-built side by side, joined on the section."""
    side = lambda kind, name: section_params.where(F.col("kind") == kind).select(
        *keys, *(["sector"] if kind == "design" else []),
        F.bround("inter_ramp_angle", 1).alias(f"inter_ramp_{name}"), F.bround("overall_angle", 1).alias(f"overall_{name}"))
    return side("design", "design").join(side("topo", "real"), list(keys))


def hole_sheet(holes: DataFrame) -> DataFrame:
    return holes.select("hole_id", "x", "y", "z_collar", "x_toe", "y_toe", "z_toe", "len", "incl", "az", F.coalesce("kg", F.lit(0.0)).alias("kg"),
                        ((F.col("z_collar") - F.col("bench_height_m")) - F.col("z_toe")).alias("pasadura_m"))


def global_kpi(comparisons: DataFrame, keys: Sequence[str] = SECTION_KEYS) -> DataFrame:
    """Mean of the section means of bench scores, and how many sections reach 70."""
    per = comparisons.where("type = 'MATCH'").groupBy(*keys).agg(F.avg("bench_score").alias("s"))
    return per.agg(F.coalesce(F.avg("s"), F.lit(0.0)).alias("global_score"), F.count_if(F.col("s") >= 70).alias("n_pass"),
                   F.count_if(F.col("s") < 70).alias("n_fail"))


def parameter_breakdown(comparisons: DataFrame) -> DataFrame:
    """Pass rate and mean real value per parameter over rows with an evaluated status."""
    rows = long_statuses(comparisons).where("status IS NOT NULL AND status <> '-'")
    ok, n = F.count_if(F.col("status") == CUMPLE), F.count(F.lit(1))
    return rows.groupBy("parameter").agg(n.alias("total"), ok.alias("n_ok"), (n - ok).alias("n_fail"), _pct(ok, n).alias("pct"),
                                         F.coalesce(F.avg("real"), F.lit(0.0)).alias("avg_real"))


def sector_compliance(comparisons: DataFrame) -> DataFrame:
    rows = long_statuses(comparisons).where("status IS NOT NULL AND status <> '-'")
    ok, n = F.count_if(F.col("status") == CUMPLE), F.count(F.lit(1))
    return rows.groupBy(F.coalesce("sector", F.lit("Sin Sector")).alias("sector")).agg(
        ok.alias("n_ok"), (n - ok).alias("n_fail"), n.alias("total"), F.bround(_pct(ok, n), 1).alias("pct"))


def deviation_histogram(comparisons: DataFrame, value: str, bins: int = 15, positive_only: bool = False) -> DataFrame:
    """Counts in equal-width bins between the extremes; the top edge belongs to the last bin."""
    rows = comparisons.where(F.col(value).isNotNull())
    if positive_only:
        rows = rows.where(F.col(value) > 0)
    ends = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    share = F.when(F.col("hi") > F.col("lo"), (F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    placed = rows.select(value).join(F.broadcast(ends)).withColumn("bin", F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int"))
    return placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), (F.first("lo") + F.col("bin") * (F.first("hi") - F.first("lo")) / bins).alias("bin_start"))


def global_score(comparisons: DataFrame) -> DataFrame:
    """Score of the first MATCH section in row order; without MATCH rows 0 and SIN DATOS."""
    first = F.min_by(F.when(F.col("type") == "MATCH", F.struct("section_score", "section_status")),
                     F.when(F.col("type") == "MATCH", F.struct("section", -F.col("level").try_cast("double"), "bench_num")))
    return comparisons.agg(first.alias("f")).select(
        F.coalesce("f.section_score", F.lit(0.0)).alias("score"), F.coalesce("f.section_status", F.lit("SIN DATOS")).alias("status"))


def depth_metrics(comparisons: DataFrame) -> DataFrame:
    floor = F.when(F.col("bench_real.floor_elevation") > 0, F.col("bench_real.floor_elevation"))
    crest = F.col("bench_real.crest_elevation")
    a = comparisons.agg(F.min(floor).alias("f"), F.max(crest).alias("c"), F.count(floor).alias("n_floors"), F.count(crest).alias("n_crests"))
    both = (F.col("n_floors") > 0) & (F.col("n_crests") > 0)
    return a.select(F.when(both, F.col("f")).alias("cota_piso"), F.when(both, F.col("c")).alias("cota_cresta"),
                    F.when(both, F.col("c") - F.col("f")).alias("profundidad"), "n_floors", "n_crests")


def top_height_deviations(comparisons: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` largest absolute height deviations."""
    rows = comparisons.where("height_design IS NOT NULL AND height_real IS NOT NULL").withColumn("delta", F.col("height_real") - F.col("height_design"))
    return rows.select("section", "bench_num", "level", "height_design", "height_real", "delta", F.abs("delta").alias("abs_delta"), "height_status").orderBy(
        F.desc(F.round("abs_delta", 6)), "section", "bench_num").limit(n)


def compliance_breakdown(comparisons: DataFrame) -> DataFrame:
    """Binary pass rate per parameter over MATCH rows that carry one of the three statuses."""
    rows = long_statuses(comparisons.where("type = 'MATCH'"))
    ok, bad = F.count_if(F.col("status") == CUMPLE), F.count_if(F.col("status").isin(NO_CUMPLE, FUERA))
    return rows.groupBy("parameter").agg(ok.alias("n_ok"), bad.alias("n_fail"), (ok + bad).alias("total"), _pct(ok, ok + bad).alias("pct"), F.avg("real").alias("avg_real"))


def verdict(comparisons: DataFrame) -> DataFrame:
    """BUENA, REGULAR or MALA from the match share, mean score and number of failed statuses."""
    fails = sum(F.count_if(F.col(f"{p}_status").isin(NO_CUMPLE, FUERA)) for p in PARAMETERS)
    a = comparisons.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("type") == "MATCH").alias("n_match"),
                        F.avg("bench_score").alias("avg_score"), fails.alias("n_fails"))
    pct = F.col("n_match") / F.col("n_total") * 100.0
    score = F.col("avg_score")
    word = (F.when(F.col("n_total") == 0, "Sin datos suficientes")
            .when((pct >= 90) & (score.isNull() | (score >= 70)) & (F.col("n_fails") == 0), "BUENA")
            .when((pct >= 70) & (score.isNull() | (score >= 50)), "REGULAR").otherwise("MALA"))
    return a.withColumn("verdict", word)


def bench_tag(row_type: str = "type") -> Column:
    """Bench number as readers see it: extra and missing benches are named as such."""
    return (F.when(F.col(row_type) == "EXTRA", "EXTRA (sin diseño)")
            .when(F.col(row_type) == "MISSING", F.concat(F.lit("FALTA (cota "), F.coalesce("level", F.lit("?")), F.lit(")")))
            .otherwise(F.coalesce(F.col("bench_num").cast("string"), F.lit("?"))))


def floor_extensions(comparisons: DataFrame) -> DataFrame:
    """Benches whose floor lies below their toe, deepest first."""
    b = lambda f: F.col(f"bench_real.{f}")
    return comparisons.where((b("floor_elevation") > 0) & (b("floor_elevation") < b("toe_elevation"))).select(
        "section", bench_tag().alias("bench"), b("toe_elevation").alias("toe_elevation"), b("floor_elevation").alias("floor_elevation"),
        (b("toe_elevation") - b("floor_elevation")).alias("extension_m")).orderBy(F.desc(F.round("extension_m", 6)), "section", "bench")


def top_signed_deltas(comparisons: DataFrame, n: int = 5) -> DataFrame:
    return comparisons.select(
        "section", bench_tag().alias("bench"), "height_design", "height_real", F.coalesce("height_dev", F.lit(0.0)).alias("height_dev"),
        F.coalesce("angle_dev", F.lit(0.0)).alias("angle_dev"), "delta_crest", "delta_toe").orderBy(
        F.desc(F.abs("height_dev")), "section", "bench").limit(n)


def real_benches(comparisons: DataFrame) -> DataFrame:
    return comparisons.where("bench_real IS NOT NULL").select("section", "bench_real.*")


ACTION_OVERHANG = {"CRITICAL": "Detener trabajo; pre-corte y berma de captura ampliada", "WARNING": "Restringir acceso; monitorear y reevaluar"}


def stability_table(comparisons: DataFrame) -> DataFrame:
    """Health row per section, critical count per section, and one row per flag of a bench."""
    benches = assess(real_benches(comparisons))
    health = section_health(benches)
    head = health.select("section", F.lit("(sección)").alias("bench"), F.lit("Health Score").alias("metric"), F.col("health_score").alias("value"),
                         F.col("health_category").alias("severity"), F.col("recommended_action").alias("action"))
    critical = health.where("n_critical > 0").select(
        "section", F.lit("(críticos)").alias("bench"), F.lit("Bancos críticos (overhang)").alias("metric"), F.col("n_critical").cast("double").alias("value"),
        F.lit("CRITICAL").alias("severity"), F.lit(ACTION_OVERHANG["CRITICAL"]).alias("action"))
    s = F.col("overhang_severity")
    flag = lambda test, metric, value, severity, action: F.when(test, F.struct(
        F.lit(metric).alias("metric"), value.cast("double").alias("value"), severity.alias("severity"), action.alias("action")))
    warn, none = F.lit("WARNING"), F.lit(None)
    flags = F.array_compact(F.array(
        flag(s != "OK", "Overhang", F.col("overhang_m"), s, F.when(s == "CRITICAL", ACTION_OVERHANG["CRITICAL"]).otherwise(ACTION_OVERHANG["WARNING"])),
        flag(F.col("wedge_risk"), "Wedge risk", none, warn, F.lit("Mapear discontinuidades y reanalizar")),
        flag(F.col("toppling_risk"), "Toppling risk", none, warn, F.lit("Evaluar anclajes / geomembrana")),
        flag(F.col("face_angle_inconsistent"), "Ángulo de cara inconsistente", none, warn, F.lit("Re-medir cara de banco")),
        flag(~F.col("catch_bench_adequate") & (F.col("catch_bench_ratio") > 0), "Catch bench", F.col("catch_bench_ratio"), warn, F.lit("Ampliar berma de captura"))))
    rows = benches.select("section", F.col("bench_number").cast("string").alias("bench"), F.explode(flags).alias("f")).select("section", "bench", "f.*")
    return head.unionByName(critical).unionByName(rows)


def safety_flags(comparisons: DataFrame) -> DataFrame:
    """Flagged benches, critical first."""
    b = lambda f: F.col(f"bench_real.{f}")
    o = b("overhang_m")
    critical, warning = o >= 1.5, (o >= 0.5) & (o < 1.5)
    flag = lambda test, rank, name, value, severity: F.when(test, F.struct(
        F.lit(rank).alias("rank"), F.lit(name).alias("flag"), value.cast("double").alias("value"), F.lit(severity).alias("severity")))
    none = F.lit(None)
    steep = (b("face_angle") >= 80) & (o < 0.5) & ~b("wedge_risk") & ~b("toppling_risk")
    flags = F.array_compact(F.array(
        flag(critical, 0, "Overhang", o, "CRITICAL"), flag(warning, 1, "Overhang", o, "WARNING"), flag(b("wedge_risk"), 1, "Wedge", none, "WARNING"),
        flag(b("toppling_risk"), 1, "Toppling", none, "WARNING"), flag(b("face_angle_inconsistent"), 1, "Ángulo inconsistente", none, "WARNING"),
        flag(steep, 1, "Cara muy steep", b("face_angle"), "WARNING")))
    return comparisons.where("bench_real IS NOT NULL").select("section", bench_tag().alias("bench"), F.explode(flags).alias("f")).select(
        "section", "bench", "f.*").orderBy("rank", "section", "bench")


def action_signals(comparisons: DataFrame, mean_pf: float | None = None) -> DataFrame:
    """Every action signal with its severity rank (0 critical, 1 high, 2 medium)."""
    b = lambda f: F.col(f"bench_real.{f}")
    o = b("overhang_m")
    sig = lambda test, rank, code, value: F.when(test, F.struct(F.lit(rank).alias("rank"), F.lit(code).alias("signal"), value.cast("double").alias("value")))
    none = F.lit(None)
    made = [sig(o >= 1.5, 0, "OVERHANG_CRITICAL", o), sig((o >= 0.5) & (o < 1.5), 2, "OVERHANG_WARNING", o), sig(b("wedge_risk"), 2, "WEDGE", none),
            sig(b("toppling_risk"), 2, "TOPPLING", none)]
    made += [sig(F.col(f"{p}_status") == NO_CUMPLE, 1, f"{p.upper()}_NO_CUMPLE", none) for p in ("berm", "angle", "height")]
    made += [sig(F.abs(c) > 0.3, 2, c.upper(), F.col(c)) for c in ("delta_crest", "delta_toe")]
    made += [sig(F.col("spill_width") > 0.5, 2, "SPILL", F.col("spill_width")), sig(F.col("berm_min") > F.col("effective_berm"), 2, "EFFECTIVE_BERM", F.col("effective_berm"))]
    rows = comparisons.select("section", "bench_num", "type", "level", F.explode(F.array_compact(F.array(*made))).alias("s")).select(
        "section", bench_tag().alias("bench"), "s.*")
    if mean_pf is not None and mean_pf > 0.6:
        over = comparisons.where("delta_crest > 0.3").orderBy("section", "bench_num").limit(1).select(
            "section", bench_tag().alias("bench"), F.lit(1).alias("rank"), F.lit("REDUCE_BURDEN").alias("signal"), F.col("delta_crest").alias("value"))
        rows = rows.unionByName(over)
    return rows


def action_list(comparisons: DataFrame, mean_pf: float | None = None, n: int = 10) -> DataFrame:
    """The ten most urgent signals."""
    return action_signals(comparisons, mean_pf).orderBy("rank", "section", "bench", "signal").limit(n)


def sorted_table(comparisons: DataFrame, by_level: bool = True) -> DataFrame:
    """Comparison table in reading order; a level that is no number sorts last."""
    level = F.coalesce(F.col("level").try_cast("double"), F.lit(-9999.0))
    order = [level.desc(), F.col("section")] if by_level else [F.col("section"), level.desc()]
    return comparisons.orderBy(*order)


def filter_values(comparisons: DataFrame) -> DataFrame:
    """Distinct values of every filter column, from one pass."""
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in ("sector", "level", "section", "bench_num")])
    return comparisons.select(F.explode(cells).alias("c")).select("c.*").where("value IS NOT NULL").distinct()


def unified_table(comparisons: DataFrame, section_table: DataFrame, tolerances: Tolerances = TOLERANCES, project: dict[str, str] | None = None,
                  keys: Sequence[str] = SECTION_KEYS) -> DataFrame:
    """One wide row per compared bench with geometry, status, tolerances and the blast figures of its section."""
    project = project or {}
    b = lambda f, n: F.bround(F.col(f"bench_real.{f}"), n)
    blast = section_table.select(
        *keys, F.col("num_wells").alias("n_pozos"), F.nullif(F.bround("pf_vol_avg_kgm3", 3), F.lit(0.0)).alias("pf_vol_kgm3"),
        F.nullif(F.bround("pf_g_per_ton_avg", 1), F.lit(0.0)).alias("pf_g_ton"), F.nullif(F.bround("total_kg", 0), F.lit(0.0)).alias("kg_total"),
        F.nullif(F.bround("avg_over_break", 2), F.lit(0.0)).alias("over_break_m"), F.nullif(F.bround("avg_under_break", 2), F.lit(0.0)).alias("under_break_m"))
    wide = comparisons.select(
        F.lit(project.get("project", "N/A")).alias("proyecto"), F.lit(project.get("operation", "N/A")).alias("operacion"), *keys, "sector",
        F.col("bench_num").alias("banco_num"), F.col("level").alias("nivel"), F.col("type").alias("tipo"),
        F.col("height_design").alias("altura_design_m"), F.col("angle_design").alias("angulo_design_deg"), F.col("berm_design").alias("berma_design_m"),
        F.col("height_real").alias("altura_real_m"), F.col("angle_real").alias("angulo_real_deg"), F.col("berm_real").alias("berma_real_m"),
        F.col("height_dev").alias("delta_altura_m"), F.col("angle_dev").alias("delta_angulo_deg"), F.col("delta_crest").alias("delta_crest_m"),
        F.col("delta_toe").alias("delta_toe_m"), F.col("height_status").alias("estado_altura"), F.col("angle_status").alias("estado_angulo"),
        F.col("berm_status").alias("estado_berma"), "bench_score", "section_score", b("crest_elevation", 1).alias("cota_crest_real"),
        b("toe_elevation", 1).alias("cota_toe_real"), b("floor_elevation", 1).alias("cota_piso"), b("berm_width", 2).alias("berm_width_real"),
        b("effective_berm_width", 2).alias("effective_berm"), F.col("bench_real.is_ramp").alias("is_ramp"),
        F.lit(tolerances.bench_height.pos).alias("tol_altura_pos"), F.lit(tolerances.bench_height.neg).alias("tol_altura_neg"),
        F.lit(tolerances.face_angle.pos).alias("tol_angulo_pos"), F.lit(tolerances.face_angle.neg).alias("tol_angulo_neg"),
        F.lit(tolerances.berm_min).alias("berma_minima"))
    return wide.join(blast, list(keys), "left")
