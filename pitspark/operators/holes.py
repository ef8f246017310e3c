"""Hole report job: map, type, normalise, reject, accept, summarise, warn."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import blast
from ..functions.geometry import normalize_azimuth, normalize_inclination, orientation_sign, toe
from ..functions.numeric import null_double, num
from . import columns as names

AFFECTED = "toe, PF, geometría dependiente"
NUMERIC = ("X", "Y", "Z_collar", "Incl", "Az", "Len", "Burden", "Esp", "Diam_mm", "Taco_m", "Retardo_ms", "Carga_Fondo_kg",
           "Carga_Columna_kg", "Longitud_Carga_m", "Az_Diseno", "Incl_Diseno")
WHOLE = ("Secuencia", "Fila")
TEXT = ("Tipo_Explosivo", "Tipo_Pozo")
SHORT = {"X": "x", "Y": "y", "Z_collar": "z_collar", "Incl": "incl", "Az": "az", "Len": "len", "Burden": "burden", "Esp": "spacing",
         "Diam_mm": "diam_mm", "Taco_m": "taco_m", "Retardo_ms": "retardo_ms", "Carga_Fondo_kg": "bottom_kg",
         "Carga_Columna_kg": "column_kg", "Longitud_Carga_m": "longitud_carga_m", "Az_Diseno": "az_design",
         "Incl_Diseno": "incl_design", "Secuencia": "secuencia", "Fila": "fila", "Tipo_Explosivo": "product", "Tipo_Pozo": "tipo_pozo"}


@dataclass(frozen=True)
class HoleReport:
    """``annotated`` has every received row with its list of errors; the other tables derive from it."""

    annotated: DataFrame

    @property
    def accepted(self) -> DataFrame:
        return self.annotated.where(F.size("errors") == 0).drop("errors")

    @property
    def rejections(self) -> DataFrame:
        """One row per row, column and error."""
        e = self.annotated.select("hole_id", "source_row", F.explode("errors").alias("e"))
        return e.select("hole_id", "source_row", "e.*", F.lit(AFFECTED).alias("affected_calculations"),
                        F.lit("Corrija el dato original y reprocese.").alias("recommended_action"),
                        F.lit("rejected").alias("row_processing_status"))

    @property
    def summary(self) -> DataFrame:
        bad = F.size("errors") > 0
        return self.annotated.agg(
            F.count(F.lit(1)).alias("rows_received"), F.count_if(~bad).alias("rows_accepted"),
            F.count_if(bad).alias("rejected_source_rows"),
            F.coalesce(F.sum(F.size("errors")), F.lit(0)).cast("long").alias("rejection_records")).withColumn(
            "blocking_error", F.when(F.col("rows_accepted") == 0, "NO_ACCEPTED_ROWS"))


def process_holes(raw: DataFrame, config: names.GeometryConfig, column_map: dict[str, str | None] | None = None,
                  bench_height: float | None = None, elevation: str | None = None, row_key: str | None = None) -> HoleReport:
    """Typed, normalised holes with their rejection records, in one narrow pass.

    ``row_key`` names a column that identifies a source row. Columns outside the canonical set travel in ``extras``.
    """
    config.validate(raw.columns)
    resolved = dict(column_map) if column_map else names.resolve_aliases(raw.columns)
    resolved["Incl"], resolved["Az"] = config.inclination_column, config.azimuth_column
    raw_col = lambda c: F.col(f"`{c}`")
    source = {f: s for f, s in resolved.items() if s}
    text = {f: raw_col(s).cast("string") for f, s in source.items()}
    kg = names.first_present(raw.columns, names.KG_COLUMNS)
    pattern = names.first_present(raw.columns, names.PATTERN_COLUMNS)
    key = raw_col(row_key).cast("string") if row_key else F.monotonically_increasing_id().cast("string")
    labels = [raw_col(c).cast("string") for c in names.HOLE_ID_COLUMNS if c in raw.columns]
    used = {*source.values(), kg, pattern, row_key, "fecha_tronadura", "bench_height_m", *names.DROPPED_COLUMNS, *names.HOLE_ID_COLUMNS}
    extras = [c for c in raw.columns if c not in used]

    out = [key.alias("source_row"), F.coalesce(*labels, key).alias("hole_id")]
    out += [(num(text[f]) if f in text else null_double()).alias(SHORT[f]) for f in NUMERIC]
    out += [(num(text[f]).try_cast("bigint") if f in text else F.lit(None).cast("bigint")).alias(SHORT[f]) for f in WHOLE]
    out += [(text[f] if f in text else F.lit(None).cast("string")).alias(SHORT[f]) for f in TEXT]
    out += [(num(raw_col(kg)) if kg else null_double()).alias("kg"),
            (raw_col(pattern).cast("string") if pattern else F.lit(None).cast("string")).alias("malla"),
            (raw_col("fecha_tronadura").cast("string").try_cast("date") if "fecha_tronadura" in raw.columns
             else F.lit(None).cast("date")).alias("fecha"),
            (num(raw_col("bench_height_m")) if "bench_height_m" in raw.columns else null_double()).alias("bench_height_m"),
            (F.create_map(*[x for c in extras for x in (F.lit(c), raw_col(c).cast("string"))]) if extras
             else F.create_map().cast("map<string,string>")).alias("extras"),
            F.struct(*[text[f].alias(f) for f in names.REQUIRED]).alias("_text")]
    df = raw.select(*out)

    to_degrees = lambda c, unit: F.degrees(c) if unit == "RADIANS" else F.col(c)
    incl_raw, az_raw = to_degrees("incl", config.inclination_unit), to_degrees("az", config.azimuth_unit)
    df = df.withColumns({
        "incl_original": F.col("incl"), "az_original": F.col("az"), "banco_original": F.col("z_collar"),
        "incl_orientation": orientation_sign("incl"),
        "incl": normalize_inclination(incl_raw, config.inclination_convention, config.inclination_sign, config.inclination_rule or None),
        "az": normalize_azimuth(az_raw, config.azimuth_convention)})

    meaning = names.elevation_meaning(source.get("Z_collar"), elevation)
    blocked = False
    if meaning == "bench_elevation":
        if bench_height is not None and bench_height > 0:
            df = df.withColumn("bench_height_m", F.lit(float(bench_height)))
            provenance = ("PROVIDED", "event_provided")
        elif "bench_height_m" in raw.columns:
            provenance = ("PROVIDED", "data_column")
        else:
            blocked, provenance = True, ("MISSING", "")
        if not blocked:
            df = df.withColumn("z_collar", F.col("z_collar") + F.col("bench_height_m"))
        semantic = "bench_elevation_untransformed" if blocked else "bench_elevation_plus_height"
        df = df.withColumns({"bench_height_status": F.lit(provenance[0]), "bench_height_source": F.lit(provenance[1])})
    else:
        semantic = "collar_elevation"
        df = df.withColumns({"bench_height_status": F.when(F.col("bench_height_m") > 0, "PROVIDED").otherwise("MISSING"),
                             "bench_height_source": F.lit("data_column" if "bench_height_m" in raw.columns else "")})

    steep = F.abs("incl_original") > 90.0
    problem = lambda test, column, original, code: F.when(test, F.struct(
        F.lit(column).alias("source_column"), original.alias("original_value"), F.lit(code).alias("error_code")))
    checks = []
    for f in names.REQUIRED:
        bad = F.col(SHORT[f]).isNull()
        if f == "Incl":
            bad = bad & ~F.coalesce(steep, F.lit(False))
        checks.append(problem(bad, source.get(f, f), F.col(f"_text.{f}"), f"INVALID_{f}"))
    checks.append(problem(F.col("len") <= 0, "Len", F.col("_text.Len"), "INVALID_LEN_NON_POSITIVE"))
    checks.append(problem(steep, "Incl", F.col("_text.Incl"), "INCL_OUT_OF_RANGE"))
    tx, ty, tz = toe("x", "y", "z_collar", "incl", "az", "len")
    usable = (F.col("len") > 0) & F.lit(not blocked)
    df = df.withColumn("errors", F.array_compact(F.array(*checks))).withColumns({
        "z_collar_semantic": F.lit(semantic), "x_toe": F.when(usable, tx), "y_toe": F.when(usable, ty), "z_toe": F.when(usable, tz),
        "carga": F.coalesce(blast.kg_per_meter(), F.lit(0.0)), "descarga": F.coalesce(blast.charge_column(), F.lit(0.0))})
    return HoleReport(df.drop("_text"))


SEVERITY = {"error": 0, "warning": 1, "info": 2}


def event_warnings(accepted: DataFrame) -> DataFrame:
    """Data-quality warnings of an event as rows, worst first; one aggregate over the holes."""
    have = set(accepted.columns)
    tests = []
    if "bench_height_status" in have:
        st = F.first("bench_height_status", ignorenulls=True)
        tests += [(st == s, f"BENCH_HEIGHT_{s}", "info" if s == "EXPLICIT_ASSUMPTION" else "warning", F.count(F.lit(1)))
                  for s in ("MISSING", "INVALID", "EXPLICIT_ASSUMPTION")]
    if "incl_original" in have:
        n = F.count_if(F.abs("incl_original") > 90)
        tests.append((n > 0, "INCLINATION_OUT_OF_RANGE", "warning", n))
    if "conservation_ok" in have:
        n = F.count_if(~F.col("conservation_ok"))
        tests.append((n > 0, "VORONOI_CONSERVATION_FAILED", "error", n))
    if "explosive_status" in have:
        for s, level in (("UNKNOWN", "warning"), ("UNVALIDATED_REFERENCE", "info")):
            n = F.count_if(F.col("explosive_status") == s)
            tests.append((n > 0, f"EXPLOSIVE_{s}", level, n))
    for c in ("pf_vol_kgm3", "pf_g_per_ton_inf"):
        if c in have:
            tests.append(((F.count(c) == 0) & (F.count(F.lit(1)) > 0), f"BLOCKED_{c.upper()}", "warning", F.count(F.lit(1))))
    made = [F.when(t, F.struct(F.lit(SEVERITY[lv]).alias("severity"), F.lit(lv).alias("level"), F.lit(code).alias("warning_code"),
                               n.cast("long").alias("n_holes"))) for t, code, lv, n in tests]
    return accepted.agg(F.array_compact(F.array(*made)).alias("w")).select(F.explode("w").alias("w")).select("w.*").orderBy(
        "severity", "warning_code")


def spatial_diagnostics(holes: DataFrame, event: list[str]) -> DataFrame:
    """First known value of the event-level influence columns."""
    wanted = ("area_m2", "area_status", "collar_domain_status", "domain_area_m2", "conservation_ok", "area_residual_m2",
              "area_residual_pct", "domain_error_code")
    return holes.groupBy(*event).agg(*[F.first(c, ignorenulls=True).alias(c) for c in wanted if c in holes.columns])


def filter_holes(holes: DataFrame, malla=(), polygon=(), bench=(), fase=(), length=None, kg=None) -> DataFrame:
    """Holes in every given value list and range; a missing charge counts as 0 kg."""
    for name, values in (("malla", malla), ("holes_polygon", polygon), ("banco_original", bench), ("fase", fase)):
        if values:
            holes = holes.where(F.col(name).cast("string").isin(*map(str, values)))
    if length:
        holes = holes.where(F.col("len").between(*length))
    if kg:
        holes = holes.where(F.coalesce("kg", F.lit(0.0)).between(*kg))
    return holes
