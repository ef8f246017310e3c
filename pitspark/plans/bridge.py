"""Domain tables derived from the given star-schema tables.

Every pit takes a fixed number of orders, so its density of holes, sections and benches stays the same when the
tables grow: more data means more pits, not fuller ones. Each table has a Spark form here and a SQL twin in
``sql`` used only to check results.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Column name, Spark SQL formula, DuckDB formula (None: the same text works).
_HOLES = (
    ("hole_id", "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, date_format(l_shipdate, 'yyyy-MM-dd'))",
     "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d'))"),
    ("pit", "l_orderkey div 1000", "l_orderkey // 1000"),
    ("malla", "concat('M-', l_suppkey)", None),
    ("x", "(l_orderkey % 200) * 5.0D", "(l_orderkey % 200) * 5.0::DOUBLE"),
    ("y", "(l_partkey % 200) * 5.0D", "(l_partkey % 200) * 5.0::DOUBLE"),
    ("z_collar", "4000.0D - 15.0D * (l_linenumber % 7)", "4000.0::DOUBLE - 15.0::DOUBLE * (l_linenumber % 7)"),
    ("incl", "l_discount * 100", None),
    ("az", "CAST((l_partkey * 37) % 360 AS DOUBLE)", None),
    ("len", "10 + l_quantity / 5", None),
    ("kg", "l_extendedprice / 400", None),
    ("burden", "CASE WHEN l_suppkey % 7 <> 3 THEN 4 + l_tax * 25 END", None),
    ("spacing", "CASE WHEN l_suppkey % 7 <> 3 THEN (4 + l_tax * 25) * 1.15D END",
     "CASE WHEN l_suppkey % 7 <> 3 THEN (4 + l_tax * 25) * 1.15::DOUBLE END"),
    ("taco_m", "3 + l_discount * 20", None),
    ("diam_mm", "CAST(165 + 15 * (l_linenumber % 8) AS DOUBLE)", None),
    ("product", "CASE concat(l_returnflag, l_linestatus) WHEN 'AF' THEN 'ANFO' WHEN 'AO' THEN 'Heavy ANFO' "
     "WHEN 'NF' THEN 'Pirex-930' WHEN 'NO' THEN 'pirex-950 plus' WHEN 'RF' THEN 'Emuline 8000' "
     "ELSE CASE WHEN l_linenumber % 2 = 1 THEN 'X-900' END END", None),
    ("fecha", "CAST(l_shipdate AS DATE)", None),
    ("az_design", "CAST((l_partkey * 37 + 4) % 360 AS DOUBLE)", None),
    ("incl_design", "l_discount * 100 + 1", None),
    ("bottom_kg", "20 + l_quantity", None),
    ("column_kg", "CASE WHEN l_linenumber <> 4 THEN l_extendedprice / 800 END", None),
    ("bench_height_m", "15.0D", "15.0::DOUBLE"),
    ("fase", "concat('F-', l_linenumber)", None),
)


def holes(spark: SparkSession, folder: str) -> DataFrame:
    """Blast holes from order lines, with toe coordinates."""
    base = table(spark, folder, "lineitem").selectExpr(*[f"{f} AS {n}" for n, f, _ in _HOLES])
    from ..functions.geometry import toe

    tx, ty, tz = toe("x", "y", "z_collar", "incl", "az", "len")
    return base.select("*", tx.alias("x_toe"), ty.alias("y_toe"), tz.alias("z_toe"))


HOLES_SQL = (
    "holes0 AS (SELECT " + ", ".join(f"{d or f} AS {n}" for n, f, d in _HOLES) + " FROM lineitem), "
    "holes AS (SELECT *, x + len * (sin(radians(incl)) * sin(radians(az))) AS x_toe, "
    "y + len * (sin(radians(incl)) * cos(radians(az))) AS y_toe, "
    "z_collar + len * (-cos(radians(incl))) AS z_toe FROM holes0)"
)


def raw_holes(spark: SparkSession, folder: str) -> DataFrame:
    """A dirty hole report: every column text, some cells broken."""
    return table(spark, folder, "lineitem").selectExpr(*[f"{d} AS {n}" for n, d in _RAW])


_RAW = (
    ("label_pozo", "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_shipdate AS DATE) AS STRING))"),
    ("Latitud_Geo", "CASE WHEN l_suppkey % 10 = 0 AND l_linenumber = 7 THEN 'N/A' ELSE CAST((l_orderkey % 200) * 5 AS STRING) END"),
    ("Longitud_Geo", "CAST((l_partkey % 200) * 5 AS STRING)"),
    ("Nombre_Banco", "CAST(3985 - 15 * (l_linenumber % 7) AS STRING)"),
    ("Inclinacion_real", "CASE WHEN l_tax >= 0.08 AND l_linenumber = 3 THEN '95' ELSE CAST(CAST(round(l_discount * 100, 0) AS INT) AS STRING) END"),
    ("Azimuth_real", "CASE WHEN l_partkey % 50 <> 0 THEN CAST((l_partkey * 37) % 720 AS STRING) END"),
    ("longitud_real", "CASE WHEN l_quantity <= 1 THEN '0' ELSE CAST(CAST(l_quantity AS INT) + 10 AS STRING) END"),
    ("Kilos_Cargados_real", "CAST(CAST(floor(l_extendedprice / 400) AS INT) AS STRING)"),
    ("Burden", "CASE WHEN l_suppkey % 7 <> 3 THEN '5' END"),
    ("Esp", "CASE WHEN l_suppkey % 7 <> 3 THEN '6' END"),
    ("Taco", "'4'"),
    ("Tipo_Explosivo", "CASE l_returnflag WHEN 'A' THEN 'ANFO' WHEN 'N' THEN 'Pirex-930' ELSE 'X-900' END"),
    ("Nombre_Malla_Original", "concat('M-', l_suppkey)"),
    ("fecha_tronadura", "CAST(CAST(l_shipdate AS DATE) AS STRING)"),
)
RAW_SQL = "raw AS (SELECT " + ", ".join(f"{d} AS {n}" for n, d in _RAW) + " FROM lineitem)"


_SECTION = (
    ("section", "concat('S-', k)", None),
    ("pit", "k div 25", "k // 25"),
    ("origin_x", "100.0D + 200 * (k % 5)", "100.0::DOUBLE + 200 * (k % 5)"),
    ("origin_y", "100.0D + 200 * ((k % 25) div 5)", "100.0::DOUBLE + 200 * ((k % 25) // 5)"),
    ("azimuth", "(k % 25) * 72 / 5.0D", "(k % 25) * 72 / 5.0::DOUBLE"),
    ("length", "200.0D", "200.0::DOUBLE"),
    ("sector", "r_name", None),
    ("survey_date", "DATE'2000-01-01'", None),
)


def sections(spark: SparkSession, folder: str) -> DataFrame:
    """Section lines: one per 40 orders, 25 per pit; the sector comes from nation and region."""
    k = table(spark, folder, "orders").selectExpr("o_orderkey div 40 AS k").distinct()
    place = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    return k.join(place, F.expr("k % 25 = n_nationkey")).selectExpr(*[f"{f} AS {n}" for n, f, _ in _SECTION])


SECTIONS_SQL = (
    "sections AS (SELECT " + ", ".join(f"{d or f} AS {n}" for n, f, d in _SECTION)
    + " FROM (SELECT DISTINCT o_orderkey // 40 AS k FROM orders) JOIN nation ON k % 25 = n_nationkey"
    " JOIN region ON n_regionkey = r_regionkey)"
)

# Design and as-built benches: eight per section, one part each.
_DESIGN = (
    ("section", "concat('S-', p_partkey div 8)", "concat('S-', p_partkey // 8)"),
    ("sector", "r_name", None),
    ("bench_number", "CAST(p_partkey % 8 + 1 AS INT)", None),
    ("crest_elevation", "4000.0D - 15 * (p_partkey % 8)", "4000.0::DOUBLE - 15 * (p_partkey % 8)"),
    ("crest_distance", "(p_partkey % 8) * 14.5D", "(p_partkey % 8) * 14.5::DOUBLE"),
    ("toe_elevation", "3985.0D - 15 * (p_partkey % 8)", "3985.0::DOUBLE - 15 * (p_partkey % 8)"),
    ("toe_distance", "(p_partkey % 8) * 14.5D + 5.5D", "(p_partkey % 8) * 14.5::DOUBLE + 5.5::DOUBLE"),
    ("bench_height", "15.0D", "15.0::DOUBLE"),
    ("face_angle", "70.0D", "70.0::DOUBLE"),
    ("berm_width", "9.0D", "9.0::DOUBLE"),
)
_TOPO = (
    ("section", "concat('S-', p_partkey div 8)", "concat('S-', p_partkey // 8)"),
    ("sector", "r_name", None),
    ("bench_number", "CAST(p_partkey % 8 + 1 AS INT)", None),
    ("crest_elevation", "4000.0D - 15 * (p_partkey % 8) + ((p_partkey * 11) % 21 - 10) / 10.0D",
     "4000.0::DOUBLE - 15 * (p_partkey % 8) + ((p_partkey * 11) % 21 - 10) / 10.0::DOUBLE"),
    ("crest_distance", "(p_partkey % 8) * 14.5D + ((p_partkey * 17) % 41 - 20) / 10.0D",
     "(p_partkey % 8) * 14.5::DOUBLE + ((p_partkey * 17) % 41 - 20) / 10.0::DOUBLE"),
    ("toe_elevation", "3985.0D - 15 * (p_partkey % 8) + ((p_partkey * 23) % 31 - 15) / 10.0D",
     "3985.0::DOUBLE - 15 * (p_partkey % 8) + ((p_partkey * 23) % 31 - 15) / 10.0::DOUBLE"),
    ("toe_distance", "(p_partkey % 8) * 14.5D + 5.5D + ((p_partkey * 19) % 37 - 18) / 10.0D",
     "(p_partkey % 8) * 14.5::DOUBLE + 5.5::DOUBLE + ((p_partkey * 19) % 37 - 18) / 10.0::DOUBLE"),
    ("bench_height", "15.0D + ((p_partkey * 37) % 61 - 30) / 10.0D", "15.0::DOUBLE + ((p_partkey * 37) % 61 - 30) / 10.0::DOUBLE"),
    ("face_angle", "70.0D + ((p_partkey * 53) % 261 - 130) / 10.0D", "70.0::DOUBLE + ((p_partkey * 53) % 261 - 130) / 10.0::DOUBLE"),
    ("berm_width", "9.0D + ((p_partkey * 29) % 101 - 60) / 10.0D", "9.0::DOUBLE + ((p_partkey * 29) % 101 - 60) / 10.0::DOUBLE"),
    ("spill_width", "((p_partkey * 7) % 13) / 10.0D", "((p_partkey * 7) % 13) / 10.0::DOUBLE"),
    ("effective_berm_width", "8.0D + ((p_partkey * 29) % 101 - 60) / 10.0D", "8.0::DOUBLE + ((p_partkey * 29) % 101 - 60) / 10.0::DOUBLE"),
    ("floor_elevation", "3984.5D - 15 * (p_partkey % 8)", "3984.5::DOUBLE - 15 * (p_partkey % 8)"),
    ("overhang_m", "((p_partkey * 31) % 41 - 20) / 10.0D", "((p_partkey * 31) % 41 - 20) / 10.0::DOUBLE"),
    ("rock_bridge_thickness_m", "((p_partkey * 3) % 7) / 10.0D", "((p_partkey * 3) % 7) / 10.0::DOUBLE"),
    ("rock_bridge_height_m", "((p_partkey * 5) % 9) / 10.0D", "((p_partkey * 5) % 9) / 10.0::DOUBLE"),
    ("catch_bench_adequate", "p_partkey % 3 <> 0", None),
    ("catch_bench_ratio", "((p_partkey * 13) % 21) / 20.0D", "((p_partkey * 13) % 21) / 20.0::DOUBLE"),
    ("wedge_risk", "p_partkey % 11 = 0", None),
    ("toppling_risk", "p_partkey % 13 = 0", None),
    ("face_angle_inconsistent", "p_partkey % 17 = 0", None),
    ("is_ramp", "p_partkey % 8 = 5", None),
    ("n_detection_methods_agreeing", "CAST(p_partkey % 4 + 1 AS INT)", None),
)
# A share of parts has no as-built bench, another share no design bench.
_HAS_DESIGN, _HAS_TOPO = "p_size < 49", "p_size > 2"


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    place = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    return table(spark, folder, "part").join(place, F.expr("(p_partkey div 8) % 25 = n_nationkey"))


def design_benches(spark: SparkSession, folder: str) -> DataFrame:
    return _parts(spark, folder).where(_HAS_DESIGN).selectExpr(*[f"{f} AS {n}" for n, f, _ in _DESIGN])


def topo_benches(spark: SparkSession, folder: str) -> DataFrame:
    return _parts(spark, folder).where(_HAS_TOPO).selectExpr(*[f"{f} AS {n}" for n, f, _ in _TOPO])


_PARTS_SQL = "part JOIN nation ON (p_partkey // 8) % 25 = n_nationkey JOIN region ON n_regionkey = r_regionkey"
BENCHES_SQL = (
    "design AS (SELECT " + ", ".join(f"{d or f} AS {n}" for n, f, d in _DESIGN) + f" FROM {_PARTS_SQL} WHERE {_HAS_DESIGN}), "
    "topo AS (SELECT " + ", ".join(f"{d or f} AS {n}" for n, f, d in _TOPO) + f" FROM {_PARTS_SQL} WHERE {_HAS_TOPO})"
)

# Low benches 4.5 m apart with as-built ones up to half a bench off, in sections that go by the same name in every pit.
_LOW = {
    "pit": ("p_partkey div 200", "p_partkey // 200"),
    "section": ("concat('C-', (p_partkey div 8) % 25)", "concat('C-', (p_partkey // 8) % 25)"),
    "crest_elevation": ("4000.0D - 4.5D * (p_partkey % 8)", "4000.0::DOUBLE - 4.5::DOUBLE * (p_partkey % 8)"),
    "toe_elevation": ("3995.5D - 4.5D * (p_partkey % 8)", "3995.5::DOUBLE - 4.5::DOUBLE * (p_partkey % 8)"),
    "crest_distance": ("(p_partkey % 8) * 3.25D", "(p_partkey % 8) * 3.25::DOUBLE"),
    "toe_distance": ("(p_partkey % 8) * 3.25D + 1.5D", "(p_partkey % 8) * 3.25::DOUBLE + 1.5::DOUBLE"),
}
_LOW_OFF = {
    "crest_elevation": (" + ((p_partkey * 11) % 53 - 26) / 8.0D", " + ((p_partkey * 11) % 53 - 26) / 8.0::DOUBLE"),
    "toe_elevation": (" + ((p_partkey * 23) % 47 - 23) / 8.0D", " + ((p_partkey * 23) % 47 - 23) / 8.0::DOUBLE"),
    "crest_distance": (" + ((p_partkey * 17) % 61 - 30) / 16.0D", " + ((p_partkey * 17) % 61 - 30) / 16.0::DOUBLE"),
    "toe_distance": (" + ((p_partkey * 19) % 59 - 29) / 16.0D", " + ((p_partkey * 19) % 59 - 29) / 16.0::DOUBLE"),
}


def _low(columns: tuple, off: dict) -> list[tuple[str, str, str]]:
    """The bench columns with low benches in place of the usual geometry, and the pit in front."""
    joined = lambda n: tuple(a + b for a, b in zip(_LOW[n], off.get(n, ("", ""))))
    return [("pit", *_LOW["pit"])] + [(n, *joined(n)) if n in _LOW else (n, f, d or f) for n, f, d in columns]


_LOW_DESIGN, _LOW_TOPO = _low(_DESIGN, {}), _low(_TOPO, _LOW_OFF)
_HAS_LOW_DESIGN, _HAS_LOW_TOPO = "p_size % 6 <> 0", "p_size % 5 <> 0"


def low_design_benches(spark: SparkSession, folder: str) -> DataFrame:
    return _parts(spark, folder).where(_HAS_LOW_DESIGN).selectExpr(*[f"{f} AS {n}" for n, f, _ in _LOW_DESIGN])


def low_topo_benches(spark: SparkSession, folder: str) -> DataFrame:
    return _parts(spark, folder).where(_HAS_LOW_TOPO).selectExpr(*[f"{f} AS {n}" for n, f, _ in _LOW_TOPO])


LOW_BENCHES_SQL = (
    "design AS (SELECT " + ", ".join(f"{d} AS {n}" for n, _, d in _LOW_DESIGN) + f" FROM {_PARTS_SQL} WHERE {_HAS_LOW_DESIGN}), "
    "topo AS (SELECT " + ", ".join(f"{d} AS {n}" for n, _, d in _LOW_TOPO) + f" FROM {_PARTS_SQL} WHERE {_HAS_LOW_TOPO})"
)

_DRILL = (
    ("event_id", "event_id", None),
    ("pit", "event_id div 1000", "event_id // 1000"),
    ("pozo", "concat('P-', user_id)", None),
    ("rig", "event_type", None),
    ("tiempo_final", "CAST(ts AS TIMESTAMP_NTZ)", "ts"),
    ("duration_min", "CAST(value % 60 AS DOUBLE)", None),
    ("depth_m", "CASE WHEN user_id % 9 <> 0 THEN 10 + value % 10 END", None),
    ("px", "((event_id * 7) % 200) * 5.0D + 1", "((event_id * 7) % 200) * 5.0::DOUBLE + 1"),
    ("py", "((event_id * 3 + user_id) % 200) * 5.0D + 1", "((event_id * 3 + user_id) % 200) * 5.0::DOUBLE + 1"),
)


def drill_events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(*[f"{f} AS {n}" for n, f, _ in _DRILL])


DRILL_SQL = "drill AS (SELECT " + ", ".join(f"{d or f} AS {n}" for n, f, d in _DRILL) + " FROM events)"

_ROCK = (
    ("rock_id", "s_suppkey", None),
    ("sector", "r_name", None),
    ("level", "3880.0D + (s_suppkey % 9) * 15 + (s_suppkey % 4)", "3880.0::DOUBLE + (s_suppkey % 9) * 15 + (s_suppkey % 4)"),
    ("rmr", "20.0D + s_suppkey % 70", "20.0::DOUBLE + s_suppkey % 70"),
    ("ucs_mpa", "CASE WHEN s_suppkey % 6 <> 0 THEN 40.0D + s_suppkey % 90 END",
     "CASE WHEN s_suppkey % 6 <> 0 THEN 40.0::DOUBLE + s_suppkey % 90 END"),
    ("lithology", "s_name", None),
)


def rock_mass(spark: SparkSession, folder: str) -> DataFrame:
    place = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    return table(spark, folder, "supplier").join(place, F.expr("s_nationkey = n_nationkey")).selectExpr(
        *[f"{f} AS {n}" for n, f, _ in _ROCK])


ROCK_SQL = (
    "rock AS (SELECT " + ", ".join(f"{d or f} AS {n}" for n, f, d in _ROCK)
    + " FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
)

# Surface: one grid vertex per order. Columns run down a wall of 20 benches, rows along it.
GRID_COLUMNS, GRID_ROWS = 40, 25
_VX = "(({i}) div 2) * 14.5D + (({i}) % 2) * 5.5D"
_VZ = "4000.0D - 15 * ((({i}) + 1) div 2)"


def _corner(key: str) -> str:
    """The grid vertex with the number in the column ``key``, moved up or down on the as-built surface."""
    i, j = f"(({key} % 1000) % {GRID_COLUMNS})", f"(({key} % 1000) div {GRID_COLUMNS})"
    z = _VZ.format(i=i)
    return f"named_struct('x', {_VX.format(i=i)}, 'y', {j} * 12.0D, 'z', CASE WHEN kind = 'topo' THEN {z} + (({key} * 7) % 11 - 5) / 10.0D ELSE {z} END)"


def surface_triangles(spark: SparkSession, folder: str) -> DataFrame:
    """Design and as-built facets, two per grid cell and kind.

    A row is made per facet before its corners are worked out: the code for the corners of all facets of a cell at once
    is too long for the JVM to compile."""
    orders = table(spark, folder, "orders").selectExpr("o_orderkey AS k").where(
        f"(k % 1000) % {GRID_COLUMNS} < {GRID_COLUMNS - 1} AND (k % 1000) div {GRID_COLUMNS} < {GRID_ROWS - 1}")
    faces = [f"named_struct('kind', '{kind}', 'half', {half})" for kind in ("design", "topo") for half in (0, 1)]
    rows = orders.selectExpr("k", f"explode(array({', '.join(faces)})) AS f").selectExpr(
        "k", "f.kind AS kind", "f.half AS half", "k + f.half AS a", f"k + 1 + f.half * {GRID_COLUMNS} AS b", f"k + {GRID_COLUMNS} AS c")
    return rows.selectExpr("concat('pit-', k div 1000) AS surface_id", "kind", "k * 2 + half AS tri_id",
                           *[f"{_corner(key)} AS v{n}" for n, key in enumerate("abc")])


def surface_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Four west-east sections per pit across the wall."""
    return table(spark, folder, "orders").selectExpr("o_orderkey div 250 AS k").distinct().selectExpr(
        "concat('pit-', k div 4) AS surface_id", "concat('P-', k) AS section",
        "concat('Sector ', k % 4) AS sector", "142.0D AS origin_x", "41.0D + 72 * (k % 4) AS origin_y",
        "90.0D AS azimuth", "280.0D AS length",
        "CAST(NULL AS DOUBLE) AS length_up", "CAST(NULL AS DOUBLE) AS length_down")



def _surface_sql() -> str:
    parts = []
    for kind, topo in (("design", 0), ("topo", 1)):
        for half, keys in ((0, ("k", "k + 1", f"k + {GRID_COLUMNS}")), (1, ("k + 1", f"k + {GRID_COLUMNS + 1}", f"k + {GRID_COLUMNS}"))):
            cols = []
            for n, key in enumerate(keys):
                i, j = f"((({key}) % 1000) % {GRID_COLUMNS})", f"((({key}) % 1000) // {GRID_COLUMNS})"
                jitter = f" + ((({key}) * 7) % 11 - 5) / 10.0::DOUBLE" if topo else ""
                cols.append(f"({i} // 2) * 14.5::DOUBLE + ({i} % 2) * 5.5::DOUBLE AS x{n}, {j} * 12.0::DOUBLE AS y{n}, "
                            f"4000.0::DOUBLE - 15 * (({i} + 1) // 2){jitter} AS z{n}")
            parts.append(
                f"SELECT concat('pit-', k // 1000) AS surface_id, '{kind}' AS kind, k * 2 + {half} AS tri_id, {', '.join(cols)} "
                f"FROM (SELECT o_orderkey AS k FROM orders WHERE (o_orderkey % 1000) % {GRID_COLUMNS} < {GRID_COLUMNS - 1} "
                f"AND (o_orderkey % 1000) // {GRID_COLUMNS} < {GRID_ROWS - 1})")
    return ("tri AS (" + " UNION ALL ".join(parts) + "), "
            "cuts AS (SELECT concat('pit-', k // 4) AS surface_id, concat('P-', k) AS section, "
            "concat('Sector ', k % 4) AS sector, 142.0::DOUBLE AS origin_x, "
            "41.0::DOUBLE + 72 * (k % 4) AS origin_y, 90.0::DOUBLE AS azimuth, 280.0::DOUBLE AS length "
            "FROM (SELECT DISTINCT o_orderkey // 250 AS k FROM orders))")


SURFACE_SQL = _surface_sql()
