import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tools.check import TABLES, canon

FAST = ["hole_toes", "section_correlation", "comparison_rows", "powder_factor_by_section", "holes_behind_bench", "hole_attribution",
        "hole_rejections", "drill_hardness", "surface_cuts", "level_correlation", "comparison_rows_low", "reconciliation_gaps_low", "pf_recommendations_declared_model",
        "suggested_face_angles", "dxf_polylines", "mapped_hole_report", "stored_results"]


def test_every_check_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 120


def test_flagship_schema(spark):
    assert entry.entry(spark).columns[:3] == ["section", "sector", "num_wells"]


@pytest.mark.parametrize("name", FAST)
def test_query_equals_its_sql(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    cur = con.execute(entry.oracle_sql()[name])
    names = sorted(d[0] for d in cur.description)
    at = [[d[0] for d in cur.description].index(n) for n in names]
    want = sorted((tuple(canon(r[i]) for i in at) for r in cur.fetchall()), key=str)
    df = entry.queries()[name](spark, folder)
    assert sorted(df.columns) == names
    got = sorted((tuple(canon(r[n]) for n in names) for r in df.collect()), key=str)
    assert got == want


def test_result_does_not_depend_on_partitioning(spark, folder):
    from pitspark.operators.compliance import compare
    from pitspark.plans import bridge

    d, t = bridge.design_benches(spark, folder), bridge.topo_benches(spark, folder)
    cols = ["section", "bench_num", "level", "bench_score", "section_score", "delta_crest"]
    a = compare(d, t).select(cols)
    b = compare(d.repartition(7).orderBy(F.rand(1)), t.repartition(5)).select(cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
