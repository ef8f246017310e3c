"""Registered queries that run a stream over the given tables to its end and return the table it kept."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch
from ..sources import writers
from ..streaming import jobs
from . import bridge
from .queries_blast import comparisons, factors
from .queries_models import CONFIG, LAST, _ANY, _BAD
from .registry import COMPS_SQL as C, PF_SQL, query, r, rs, tidy

B = bridge.BENCHES_SQL


def _source(spark, d: str, name: str):
    file = f"{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(f"{d}/{file}").schema).option("pathGlobFilter", file).parquet(d)


@query("stream_last_drill_events", f"WITH {LAST} SELECT pozo, event_id, rig, {rs('depth_m, duration_min')} FROM last")
def _(spark, d):
    events = _source(spark, d, "events").selectExpr(*[f"{f} AS {n}" for n, f, _ in bridge._DRILL])
    out = scratch(spark, "last-events")
    jobs.upsert_last_events(events, f"{out}/table", f"{out}/checkpoint").awaitTermination()
    return tidy(jobs.current_last_events(spark, f"{out}/table").select("pozo", "event_id", "rig", "depth_m", "duration_min"))


def _trend(spark, d: str):
    """What the stream emitted, and the holes it read."""
    out = scratch(spark, "trend")
    holes = factors(spark, d).select(F.col("fecha").cast("timestamp").alias("blast_time"), "pf_vol_kgm3")
    holes.write.parquet(f"{out}/holes")
    stream = jobs.powder_factor_trend(spark.readStream.schema(holes.schema).parquet(f"{out}/holes"))
    q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{out}/table").option("checkpointLocation", f"{out}/checkpoint")
    q.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/table"), spark.read.schema(holes.schema).parquet(f"{out}/holes")


# windows of 30 days counted from the epoch, those that the finished stream left open among them
_TREND_SQL = f"""WITH {PF_SQL} SELECT CAST(DATE '1970-01-01' + CAST(k * 30 AS INTEGER) AS DATE) AS period_start, {r('avg(pf_vol_kgm3)', 'pf_promedio')}, count(*) AS n_pozos
    FROM (SELECT CAST(floor((fecha - DATE '1970-01-01') / 30) AS BIGINT) AS k, pf_vol_kgm3 FROM pf WHERE fecha IS NOT NULL) GROUP BY k"""


@query("stream_powder_factor_trend", _TREND_SQL)
def _(spark, d):
    emitted, holes = _trend(spark, d)
    return tidy(jobs.whole_trend(holes, emitted).select(F.to_date("period_start").alias("period_start"), "pf_promedio", "n_pozos"))


@query("stream_powder_factor_trend_whole", _TREND_SQL)
def _(spark, d):
    emitted, holes = _trend(spark, d)
    return tidy(jobs.whole_trend(holes, emitted).select(F.to_date("period_start").alias("period_start"), "pf_promedio", "n_pozos"))


@query("stream_hole_validation", f"""WITH {bridge.RAW_SQL} SELECT 'accepted' AS sink, 'OK' AS error_code, count(*) AS n FROM raw WHERE NOT ({_ANY})
    """ + " ".join(f"UNION ALL SELECT 'rejected', '{e}', count(*) FROM raw WHERE {w}" for *_, e, w in _BAD))
def _(spark, d):
    out = scratch(spark, "validation")
    raw = _source(spark, d, "lineitem").selectExpr(*[f"{f} AS {n}" for n, f in bridge._RAW])
    jobs.validate_stream(raw, CONFIG, f"{out}/accepted", f"{out}/rejected", f"{out}/checkpoint", 15.0, "label_pozo").awaitTermination()
    a = spark.read.parquet(f"{out}/accepted").select(F.lit("accepted").alias("sink"), F.lit("OK").alias("error_code"))
    b = spark.read.parquet(f"{out}/rejected").select(F.lit("rejected").alias("sink"), "error_code")
    return a.unionByName(b).groupBy("sink", "error_code").agg(F.count(F.lit(1)).alias("n"))


# sections stored twice: all of them, then those of two sectors again with other rows
@query("stored_results", f"""WITH {C} SELECT section, bench_num, level, bench_score, CASE WHEN sector IN ('ASIA', 'EUROPE') THEN 2 ELSE 1 END AS survey FROM comps
    WHERE sector NOT IN ('ASIA', 'EUROPE') OR type = 'MATCH'""")
def _(spark, d):
    path = scratch(spark, "results")
    rows = comparisons(spark, d).select("section", "sector", "bench_num", "level", "type", "bench_score")
    writers.save_results(rows.withColumn("survey", F.lit(1)), path)
    writers.save_results(rows.where("sector IN ('ASIA', 'EUROPE') AND type = 'MATCH'").withColumn("survey", F.lit(2)), path)
    stored = writers.read_results(spark, path)
    # a section none of whose benches matched keeps its first rows
    return stored.where("survey = 2 OR sector NOT IN ('ASIA', 'EUROPE')").select("section", "bench_num", "level", "bench_score", "survey")


@query("stored_extractions", f"""WITH {B} SELECT section, 'design' AS kind, bench_number, 2 AS pass FROM design WHERE CAST(substr(section, 3) AS BIGINT) % 3 = 0
    UNION ALL SELECT section, 'design', bench_number, 1 FROM design WHERE CAST(substr(section, 3) AS BIGINT) % 3 <> 0 UNION ALL SELECT section, 'topo', bench_number, 1 FROM topo""")
def _(spark, d):
    path = scratch(spark, "extractions")
    side = lambda df, kind, n: df.select("section", F.lit(kind).alias("kind"), "bench_number", F.lit(n).alias("pass"))
    design, topo = bridge.design_benches(spark, d), bridge.topo_benches(spark, d)
    writers.save_extraction(side(design, "design", 1).unionByName(side(topo, "topo", 1)), path)
    writers.save_extraction(side(design.where("CAST(substring(section, 3) AS BIGINT) % 3 = 0"), "design", 2), path)
    return writers.read_results(spark, path, keys=("section", "kind"))
