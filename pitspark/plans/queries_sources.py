"""Registered queries on files: the given tables are written in a file format and read back by its reader."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import columns, exchange, holes as hole_ops
from ..session import scratch
from ..sources import mesh_writers, readers, writers
from . import bridge
from .registry import query, r, tidy

TEXT = (".txt",)


def _of_path(name: str, kind: str = "string"):
    """Value of a ``name=value`` folder in the column ``path``."""
    return F.regexp_extract("path", rf"{name}=([^/]+)/", 1).cast(kind).alias(name)


def _surface_columns(triangles: DataFrame) -> DataFrame:
    """Facets with their place among those of their surface."""
    named = triangles.select(_of_path("surface_id"), _of_path("kind"), "tri_id", *[F.col(f"v{k}.{c}").alias(f"{c}{k}") for k in range(3) for c in "xyz"])
    place = F.row_number().over(Window.partitionBy("surface_id", "kind").orderBy("tri_id"))
    return tidy(named.withColumn("place", place).drop("tri_id"))


_SURFACE_FILES_SQL = f"""WITH {bridge.SURFACE_SQL} SELECT surface_id, kind, CAST(row_number() OVER (PARTITION BY surface_id, kind ORDER BY tri_id) AS INTEGER) AS place,
    {', '.join(r(f'{c}{k}') for k in range(3) for c in 'xyz')} FROM tri"""


@query("stl_files", _SURFACE_FILES_SQL)
def _(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "stl")
    mesh_writers.write_stl_text(bridge.surface_triangles(spark, d), path)
    return _surface_columns(readers.read_stl(spark, path, TEXT, rangeBytes=1 << 20)[0])


@query("stl_rejected_files", f"""WITH {bridge.SURFACE_SQL}, f AS (SELECT surface_id, kind, bool_or(tri_id % 500 = 0) AS broken FROM tri GROUP BY ALL)
    SELECT surface_id, kind, 'BROKEN_FACETS' AS problem FROM f WHERE broken""")
def _(spark, d):
    path = scratch(spark, "stl")
    spoiled = F.when(F.col("tri_id") % 500 == 0, F.lit(None).cast("double")).otherwise(F.col("v1.x"))  # a vertex line that lacks a number
    triangles = bridge.surface_triangles(spark, d).withColumn("v1", F.col("v1").withField("x", spoiled))
    mesh_writers.write_stl_text(triangles, path)
    return readers.read_stl(spark, path, TEXT, rangeBytes=1 << 20)[1].select(_of_path("surface_id"), _of_path("kind"), "problem")


@query("dxf_faces", _SURFACE_FILES_SQL)
def _(spark, d):
    path = scratch(spark, "dxf")
    mesh_writers.write_dxf_faces(bridge.surface_triangles(spark, d), path)
    return _surface_columns(readers.read_dxf_faces(spark, path, TEXT, rangeBytes=1 << 20))


_LINES_SQL = f"""WITH {bridge.SECTIONS_SQL}, p AS (SELECT pit, origin_x AS x, origin_y AS y, CAST(row_number() OVER (PARTITION BY pit ORDER BY CAST(substr(section, 3) AS BIGINT)) - 1 AS INTEGER) AS pos,
    CAST(row_number() OVER (PARTITION BY pit ORDER BY CAST(substr(section, 3) AS BIGINT) DESC) - 1 AS INTEGER) AS back FROM sections)"""


def _pit_lines(spark, d) -> DataFrame:
    """Per pit the section origins in order as a polyline of its own entity, and in reverse order as one with vertices."""
    points = F.sort_array(F.collect_list(F.struct(F.substring("section", 3, 20).cast("long").alias("k"), F.col("origin_x").alias("x"), F.col("origin_y").alias("y"))))
    lines = bridge.sections(spark, d).groupBy("pit").agg(points.alias("points"))
    kinds = F.array(F.struct(F.lit(1).alias("line"), F.lit(False).alias("light"), F.reverse("points").alias("points")),
                    F.struct(F.lit(2).alias("line"), F.lit(True).alias("light"), F.col("points")))
    return lines.select("pit", F.explode(kinds).alias("l")).select("pit", "l.*")


@query("dxf_polylines", f"""{_LINES_SQL} SELECT pit, 'LWPOLYLINE' AS kind, pos, {r('x')}, {r('y')} FROM p UNION ALL SELECT pit, 'POLYLINE', back, {r('x')}, {r('y')} FROM p""")
def _(spark, d):
    path = scratch(spark, "dxf")
    mesh_writers.write_dxf_polylines(_pit_lines(spark, d), path)
    found = readers.read_dxf_polylines(spark, path, TEXT)
    return tidy(found.select(_of_path("pit", "long"), "kind", F.col("pos").cast("int").alias("pos"), "x", "y"))


@query("dxf_first_polyline", f"{_LINES_SQL} SELECT pit, pos, {r('x')}, {r('y')} FROM p")
def _(spark, d):
    path = scratch(spark, "dxf")
    mesh_writers.write_dxf_polylines(_pit_lines(spark, d), path)
    return tidy(readers.read_dxf_polyline(spark, path, TEXT).select(_of_path("pit", "long"), F.col("pos").cast("int").alias("pos"), "x", "y"))


def _line_files(spark, d, header: bool) -> str:
    path = scratch(spark, "lines")
    points = bridge.sections(spark, d).withColumn("k", F.substring("section", 3, 20).cast("long"))
    ordered = points.repartition("pit").sortWithinPartitions("pit", "k").select("pit", F.col("origin_x").alias("Este"), F.col("origin_y").alias("Norte"), F.col("sector").alias("Sector"))
    ordered.write.partitionBy("pit").csv(path, header=header)
    return path


@query("polyline_files", f"{_LINES_SQL} SELECT pit, pos, {r('x')}, {r('y')} FROM p")
def _(spark, d):
    found = readers.read_polyline_csv(spark, _line_files(spark, d, True))
    return tidy(found.select(_of_path("pit", "long"), F.col("pos").cast("int").alias("pos"), "x", "y"))


@query("reference_line_files", f"{_LINES_SQL} SELECT pit, pos, {r('x')}, {r('y')} FROM p")
def _(spark, d):
    found = readers.read_reference_lines(spark, _line_files(spark, d, False))
    return tidy(found.select(_of_path("pit", "long"), F.col("pos").cast("int").alias("pos"), "x", "y"))


# day-first timestamps, headers with accents and blanks, every 50th depth not a number
@query("drilling_log_file", f"""WITH {bridge.DRILL_SQL}, s AS (SELECT *, date_trunc('second', tiempo_final) AS t1, CAST(floor(duration_min) AS BIGINT) AS whole FROM drill)
    SELECT pozo, t1 - to_minutes(whole) AS tiempo_inicial, t1 AS tiempo_final, {r('CASE WHEN event_id % 50 <> 0 THEN depth_m END', 'depth_m')},
    {r('px')}, {r('py')}, rig, {r('whole', 'duration_min')} FROM s""")
def _(spark, d):
    path = scratch(spark, "drilling")
    end = F.date_trunc("second", F.col("tiempo_final").cast("timestamp"))
    begin = F.timestamp_seconds(F.unix_timestamp(end) - F.floor("duration_min") * 60)
    shown = lambda t: F.date_format(t, "dd/MM/yyyy HH:mm:ss")
    bridge.drill_events(spark, d).select(
        F.col("pozo").alias("Pozo"), shown(begin).alias("Tiempo Inicial"), shown(end).alias("Tiempo Final"),
        F.when(F.col("event_id") % 50 == 0, "s/d").otherwise(F.col("depth_m").cast("string")).alias("Prof. por Operador"),
        F.col("py").alias("Coord. Norte [m]"), F.col("px").alias("Coord. Este [m]"), F.col("rig").alias("Equipo")).write.csv(path, header=True)
    return tidy(readers.read_drilling_csv(spark, path).drop("event_id"))


@query("rock_mass_file", f"""WITH {bridge.ROCK_SQL} SELECT sector, {r('level')}, {r('rmr')}, {r('ucs_mpa')}, lithology FROM rock WHERE rock_id % 7 <> 0""")
def _(spark, d):
    path = scratch(spark, "rock")
    bridge.rock_mass(spark, d).select(
        F.col("sector").alias(" Sector"), F.col("level").alias("LEVEL"), F.when(F.col("rock_id") % 7 == 0, "n/a").otherwise(F.col("rmr").cast("string")).alias("Rmr"),
        "ucs_mpa", F.col("lithology").alias("Lithology")).write.csv(path, header=True)
    return tidy(readers.read_rock_mass_csv(spark, path))


# two exchange files with different columns, written and read under the union of them
@query("exchange_files", f"""WITH {exchange.DEMO_SQL} SELECT row_key, hole_id, burden, spacing, NULL::VARCHAR AS azimuth, 'unknown' AS format FROM ex
    UNION ALL SELECT row_key, hole_id, NULL, NULL, azimuth, 'unknown' FROM ex""")
def _(spark, d):
    path, rows = scratch(spark, "exchange"), exchange.demo_rows(spark, d)
    one, other = rows.select("row_key", "hole_id", "burden", "spacing"), rows.select("row_key", "hole_id", "azimuth")
    writers.write_exchange_csv(exchange.union_files(one, other), path)
    found = readers.read_exchange_csv(spark, path)
    return found.withColumn("format", F.lit(exchange.detect_format(found.columns)))


# the raw hole report under headers that only the automatic mapping knows
_HEADERS = {"Latitud_Geo": "latitud.geo", "Longitud_Geo": "LONGITUD GEO", "Nombre_Banco": "Nombre  Bancos", "Inclinacion_real": "Inclinacion (real)",
            "Azimuth_real": "Azimuth-real", "longitud_real": "Longitud_real", "Burden": "BURDEN", "Esp": "esp", "Taco": "Taco #", "Tipo_Explosivo": "Tipo Explosivos"}


@query("mapped_hole_report", f"""WITH {bridge.RAW_SQL} SELECT label_pozo, TRY_CAST(Latitud_Geo AS DOUBLE) AS X, CAST(Longitud_Geo AS DOUBLE) AS Y, CAST(Nombre_Banco AS DOUBLE) AS Z_collar,
    CAST(Inclinacion_real AS DOUBLE) AS Incl, CAST(Azimuth_real AS DOUBLE) AS Az, CAST(longitud_real AS DOUBLE) AS Len, CAST(Burden AS DOUBLE) AS Burden, CAST(Esp AS DOUBLE) AS Esp,
    CAST(Taco AS DOUBLE) AS Taco_m, Tipo_Explosivo, 8 AS n_exact, 2 AS n_fuzzy FROM raw""")
def _(spark, d):
    raw = bridge.raw_holes(spark, d).select("label_pozo", *[F.col(c).alias(h) for c, h in _HEADERS.items()])
    found = columns.auto_map(c for c in raw.columns if c != "label_pozo")
    how = [kind for kind, _ in found.confidence.values()]
    mapped = columns.apply_mapping(raw, found.columns)
    return mapped.withColumns({"n_exact": F.lit(how.count("exact")), "n_fuzzy": F.lit(how.count("fuzzy"))})


@query("collar_table_import", f"""WITH {bridge.HOLES_SQL} SELECT hole_id, x AS easting, y AS northing, z_collar AS elevation, incl AS dip, az AS azimuth, len AS hole_length_planned,
    len AS hole_length_actual, malla AS mine_site, 'surpac' AS format FROM holes""")
def _(spark, d):
    table = bridge.holes(spark, d).select("hole_id", F.col("x").alias("XCOLLAR"), F.col("y").alias("YCOLLAR"), F.col("z_collar").alias("ZCOLLAR"), F.col("incl").alias("DIP"),
                                          F.col("az").alias("BRG"), F.col("len").alias("LENGTH"), F.col("malla").alias("project"))
    return exchange.from_collar_table(table, "surpac").withColumn("format", F.lit("surpac"))


# holes of a pattern in which only some rows carry the event's influence figures
@query("spatial_diagnostics", f"""WITH {bridge.HOLES_SQL} SELECT malla, max(CASE WHEN CAST(substr(malla, 3) AS BIGINT) % 3 <> 0 AND fase = 'F-2' THEN 100.0::DOUBLE + CAST(substr(malla, 3) AS BIGINT) END) AS domain_area_m2,
    max(CASE WHEN fase = 'F-3' THEN CAST(substr(malla, 3) AS BIGINT) % 2 = 0 END) AS conservation_ok FROM holes GROUP BY malla""")
def _(spark, d):
    number = F.substring("malla", 3, 20).cast("long")
    rows = bridge.holes(spark, d).select("malla", F.when((number % 3 != 0) & (F.col("fase") == "F-2"), 100.0 + number).alias("domain_area_m2"),
                                         F.when(F.col("fase") == "F-3", number % 2 == 0).alias("conservation_ok"))
    return hole_ops.spatial_diagnostics(rows, ["malla"])
