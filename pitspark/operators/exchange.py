"""Open hole-exchange format: validation, vendor detection, conversion, union of files."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import explosives
from ..functions.numeric import num, parse_diameter_mm

# Fields of the format.
REQUIRED = ("hole_id", "blast_id", "sequence", "easting", "northing", "elevation", "dip", "azimuth", "hole_length_actual", "diameter_mm",
            "burden", "spacing", "explosive_type", "explosive_kg_actual", "stemming_length_m", "mine_site", "bench_id", "shot_at")
NUMERIC = ("sequence", "easting", "northing", "elevation", "dip", "azimuth", "hole_length_planned", "hole_length_actual", "diameter_mm", "burden",
           "spacing", "subdrill", "explosive_kg_actual", "explosive_kg_planned", "explosive_density_g_cc", "emulsion_kg", "anfo_kg", "bulk_kg",
           "stemming_length_m", "rock_mass_rating", "density_rock_t_m3", "delay_ms", "bottom_hole_x", "bottom_hole_y", "bottom_hole_z", "decoupling_ratio")
OPTIONAL_TEXT = ("operator", "initiation_system", "comment", "anomaly_flag")
RANGES = {"dip": (-90.0, 90.0), "azimuth": (0.0, 360.0), "explosive_density_g_cc": (0.0, 2.0), "density_rock_t_m3": (1.5, 4.0), "rock_mass_rating": (0.0, 100.0)}
ENUMS = {
    "explosive_type": ("ANFO", "Heavy ANFO", "Emulsion", "Bulk emulsion", "ANFO + Emulsion", "Other"),
    "initiation_system": ("Nonel", "Electronic", "Detonating cord", "Other"),
    "anomaly_flag": ("loaded", "misfire", "cutoff", "wet_hole", "bootleg", "refilled", "empty"),
}
TIMESTAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([+-]\d{2}:\d{2}|Z)$"
FIELDS = tuple(dict.fromkeys(REQUIRED + NUMERIC + OPTIONAL_TEXT))

# Header names that give a format away, tried in order.
MARKERS = (
    ("exchange", ("hole_id", "blast_id", "sequence", "easting", "northing", "elevation", "explosive_kg_actual", "stemming_length_m")),
    ("enaex", ("Kilos_Cargados_real", "Longitud_Geo", "Latitud_Geo", "Inclinacion_real", "Azimuth_real", "longitud_real", "stemming_real", "Nombre_Malla_Original")),
    ("datamine", ("BHID", "XCOLLAR", "YCOLLAR", "ZCOLLAR")),
    ("surpac", ("HoleID", "XCOLLAR")),
)
# Plain renames of two vendor collar tables.
VENDOR_FIELDS = {
    "datamine": {"hole_id": "BHID", "easting": "XCOLLAR", "northing": "YCOLLAR", "elevation": "ZCOLLAR", "dip": "DIP", "azimuth": "BRG",
                 "hole_length_planned": "LENGTH", "hole_length_actual": "LENGTH", "mine_site": "PROJECT", "bench_id": "BENCH", "rock_mass_rating": "RMR",
                 "density_rock_t_m3": "DENSITY", "delay_ms": "AT", "bottom_hole_x": "XEND", "bottom_hole_y": "YEND", "bottom_hole_z": "ZEND"},
    "surpac": {"hole_id": "hole_id", "easting": "XCOLLAR", "northing": "YCOLLAR", "elevation": "ZCOLLAR", "dip": "DIP", "azimuth": "BRG",
               "hole_length_planned": "LENGTH", "hole_length_actual": "LENGTH", "mine_site": "project", "bench_id": "bench", "rock_mass_rating": "RMR",
               "density_rock_t_m3": "density"},
}


def detect_format(columns: Sequence[str]) -> str:
    have = set(columns)
    return next((name for name, marks in MARKERS if set(marks) <= have), "unknown")


def validate(rows: DataFrame, row_key: str) -> DataFrame:
    """One row per finding: level, code, field and value."""
    have = set(rows.columns)
    text = lambda f: F.col(f).cast("string")
    filled = lambda f: F.col(f).isNotNull() & (text(f) != "")
    find = lambda test, level, code, field: F.when(test, F.struct(
        F.lit(level).alias("level"), F.lit(code).alias("code"), F.lit(field).alias("field"),
        (text(field) if field in have else F.lit(None).cast("string")).alias("value")))
    made = [find(~filled(f) if f in have else F.lit(True), "ERROR", "MISSING_REQUIRED", f) for f in REQUIRED]
    for f in NUMERIC:
        if f in have:
            made.append(find(filled(f) & num(f).isNull(), "ERROR", "NOT_NUMERIC", f))
            if f in RANGES:
                made.append(find(filled(f) & ~num(f).between(*RANGES[f]), "ERROR", "OUT_OF_RANGE", f))
    for f, allowed in ENUMS.items():
        if f in have:
            made.append(find(filled(f) & ~text(f).isin(*allowed), "ERROR", "NOT_IN_ENUM", f))
    if "shot_at" in have:
        made.append(find(filled("shot_at") & ~text("shot_at").rlike(TIMESTAMP), "WARNING", "BAD_TIMESTAMP", "shot_at"))
    return rows.select(row_key, F.explode(F.array_compact(F.array(*made))).alias("f")).select(row_key, "f.*")


def validation_summary(rows: DataFrame, row_key: str) -> DataFrame:
    """Row count, finding counts and the overall verdict."""
    found = validate(rows, row_key).agg(F.count_if(F.col("level") == "ERROR").alias("n_errors"), F.count_if(F.col("level") == "WARNING").alias("n_warnings"))
    return rows.agg(F.count(F.lit(1)).alias("n_rows")).join(found).withColumn("valid", F.col("n_errors") == 0)


def from_vendor_report(accepted: DataFrame) -> DataFrame:
    """Exchange rows from an accepted hole report; burden and spacing are the format's fixed 6.5 and 7.5 m."""
    extra = lambda c: F.col("extras")[c]
    shot = F.coalesce(F.concat(F.col("fecha").cast("string"), F.lit("T00:00:00")), F.lit(""))
    pit = extra("Nombre_Rajo")
    delay = F.when(F.col("secuencia").isNotNull() | F.col("retardo_ms").isNotNull(),
                   F.coalesce(F.col("secuencia") * 1000.0, F.lit(0.0)) + F.coalesce("retardo_ms", F.lit(0.0)))
    diameter = F.coalesce(parse_diameter_mm(extra("diametro"), True), parse_diameter_mm("diam_mm", True))
    whole = F.bround("banco_original", 0)
    bench = F.when(F.col("banco_original") == whole, whole.cast("long").cast("string")).otherwise(F.col("banco_original").cast("string"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return accepted.select(
        "hole_id", F.when(pit.isNotNull() & (shot != ""), F.concat_ws("_", pit, F.substring(shot, 1, 10))).otherwise("unknown").alias("blast_id"),
        F.coalesce("secuencia", F.lit(0)).cast("long").alias("sequence"), F.col("x").alias("easting"), F.col("y").alias("northing"),
        F.col("z_collar").alias("elevation"), zero("incl").alias("dip"), zero("az").alias("azimuth"), F.col("len").alias("hole_length_actual"),
        diameter.alias("diameter_mm"), F.lit(6.5).alias("burden"), F.lit(7.5).alias("spacing"),
        F.coalesce(explosives.category("product"), F.lit("Other")).alias("explosive_type"), zero("kg").alias("explosive_kg_actual"),
        zero("taco_m").alias("stemming_length_m"), F.coalesce(pit, F.lit("")).alias("mine_site"), F.coalesce(bench, F.lit("")).alias("bench_id"),
        shot.alias("shot_at"), delay.alias("delay_ms"), explosives.density("product").alias("explosive_density_g_cc"))


def from_collar_table(rows: DataFrame, vendor: str) -> DataFrame:
    """Exchange columns of a vendor collar table, by its field mapping."""
    have = set(rows.columns)
    return rows.select(*[(F.col(f"`{s}`")).alias(f) for f, s in VENDOR_FIELDS[vendor].items() if s in have])


def union_files(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of several files under the union of their columns."""
    for o in others:
        first = first.unionByName(o, allowMissingColumns=True)
    return first


_DEMO = (
    ("row_key", "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_shipdate AS DATE) AS STRING))"),
    ("hole_id", "concat('H-', l_orderkey)"), ("blast_id", "concat('B-', l_suppkey)"), ("sequence", "CAST(l_linenumber AS STRING)"),
    ("easting", "CAST(l_orderkey * 5 AS STRING)"), ("northing", "CAST(l_partkey * 5 AS STRING)"), ("elevation", "'4000'"), ("dip", "'5'"),
    ("azimuth", "CAST((l_partkey * 37) % 400 AS STRING)"), ("hole_length_actual", "CAST(CAST(l_quantity AS INT) AS STRING)"), ("diameter_mm", "'250'"),
    ("burden", "CASE WHEN l_suppkey % 20 = 0 THEN 'abc' ELSE '6' END"), ("spacing", "'7'"),
    ("explosive_type", "CASE WHEN l_linenumber = 5 THEN 'Dynamite' ELSE 'ANFO' END"), ("explosive_kg_actual", "CAST(CAST(l_extendedprice AS INT) AS STRING)"),
    ("stemming_length_m", "'5'"), ("mine_site", "CASE WHEN l_partkey % 30 = 0 THEN '' ELSE 'Pit' END"), ("bench_id", "'4000'"),
    ("shot_at", "CASE WHEN l_linenumber = 2 THEN CAST(CAST(l_shipdate AS DATE) AS STRING) ELSE concat(CAST(CAST(l_shipdate AS DATE) AS STRING), 'T12:00:00Z') END"),
)
DEMO_SQL = "ex AS (SELECT " + ", ".join(f"{f} AS {n}" for n, f in _DEMO) + " FROM lineitem)"


def demo_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Exchange rows from order lines, with some cells broken."""
    return spark.read.parquet(f"{folder}/lineitem.parquet").selectExpr(*[f"{f} AS {n}" for n, f in _DEMO])
