import json
import struct

import pytest
from pyspark.sql import functions as F

from pitspark.operators.holes import process_holes
from pitspark.sources import readers, writers
from pitspark.sources.store import KeyedStore
from pitspark.streaming import jobs
from test_blast import CONFIG, RAW, raw


def binary_stl(facets):
    out = b"made by a test".ljust(80, b" ") + struct.pack("<I", len(facets))
    for f in facets:
        out += struct.pack("<12fH", 0, 0, 1, *[c for v in f for c in v], 0)
    return out


FACETS = [((0, 0, 0), (1, 0, 0), (0, 1, 2)), ((1, 0, 0), (1, 1, 5), (0, 1, 2))]


def test_stl_files(spark, tmp_path):
    (tmp_path / "a.stl").write_bytes(binary_stl(FACETS))
    text = "solid s\n" + "".join("facet normal 0 0 1\nouter loop\n" + "".join(f"vertex {x} {y} {z}\n" for x, y, z in f) + "endloop\nendfacet\n" for f in FACETS) + "endsolid s\n"
    (tmp_path / "b.STL").write_text(text)
    (tmp_path / "c.stl").write_bytes(b"not a mesh")
    (tmp_path / "d.stl").write_bytes(binary_stl(FACETS)[:-20])
    tri, bad = readers.read_stl(spark, str(tmp_path))
    rows = tri.orderBy("path", "tri_id").collect()
    assert len(rows) == 4 and [tuple(rows[i][f"v{k}"]) for i in (0, 2) for k in range(3)] == [tuple(map(float, v)) for v in FACETS[0]] * 2
    assert {(r["path"].split("/")[-1], r["problem"]) for r in bad.collect()} == {("c.stl", "NOT_STL"), ("d.stl", "TRUNCATED")}


def dxf(*entities):
    body = "0\nSECTION\n2\nENTITIES\n"
    for kind, pairs in entities:
        body += f"0\n{kind}\n" + "".join(f"{c}\n{v}\n" for c, v in pairs)
    return body + "0\nENDSEC\n0\nEOF\n"


def face(*pts):
    return ("3DFACE", [(10 * axis + 10 + k, p[axis]) for k, p in enumerate(pts) for axis in range(3)])


def test_dxf_faces_and_polylines(spark, tmp_path):
    (tmp_path / "m.dxf").write_text(dxf(face((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)), face((0, 0, 0), (1, 0, 0), (1, 1, 1), (1, 1, 1))))
    tri = readers.read_dxf_faces(spark, str(tmp_path))
    assert tri.count() == 3 and readers.weld(tri).count() == 3
    lines = tmp_path / "l"
    lines.mkdir()
    (lines / "p.dxf").write_text(dxf(("POLYLINE", []), ("VERTEX", [(10, 1), (20, 2)]), ("VERTEX", [(10, 3), (20, 4)]), ("SEQEND", []), ("LWPOLYLINE", [(10, 7), (20, 8), (10, 9), (20, 9.5)])))
    assert [(r["x"], r["y"]) for r in readers.read_dxf_polyline(spark, str(lines)).orderBy("pos").collect()] == [(7.0, 8.0), (9.0, 9.5)]


def many_facets(n):
    return [((i, i * 0.5, 0), (i + 1, 0, i), (0, 1, 2 + i)) for i in range(n)]


@pytest.mark.parametrize("size", [61, 97, 1000])
def test_ranges_of_a_file_give_every_record_once(spark, tmp_path, size):
    facets, small = many_facets(37), {"rangeBytes": size, "pieceBytes": 23 if size < 90 else 64}
    want = sorted(tuple(float(c) for v in f for c in v) for f in facets)
    flat = lambda r: tuple(c for k in range(3) for c in r[f"v{k}"])
    (tmp_path / "b.stl").write_bytes(binary_stl(facets))
    text = "solid endfacets\n" + "".join("  facet normal 0 0 1\r\n outer loop\n" + "".join(f"\tvertex {x} {y}  {z}\n" for x, y, z in f) + "endloop\n endfacet\n" for f in facets) + "endsolid s\n"
    (tmp_path / "t.stl").write_text(text)
    tri, bad = readers.read_stl(spark, str(tmp_path), **small)
    assert tri.rdd.getNumPartitions() > 4 and bad.count() == 0
    for name in ("b.stl", "t.stl"):
        rows = tri.where(F.col("path").endswith(name)).orderBy("tri_id").collect()
        assert sorted(map(flat, rows)) == want and len({r["tri_id"] for r in rows}) == 37
        assert [flat(r) for r in rows] == [tuple(float(c) for v in f for c in v) for f in facets]
    quads = [face(f[0], f[1], f[2], (9, 9, i)) for i, f in enumerate(facets)]
    blocks = "0\nSECTION\n2\nBLOCKS\n0\n3DFACE\n10\n1\n0\nENDSEC\n"
    lines = [("LWPOLYLINE", [p for k in range(9) for p in ((10, k), (20, -k))]), ("POLYLINE", [(70, 0)]), *[("VERTEX", [(10, k), (20, 0)]) for k in range(12)], ("SEQEND", [(8, 0)]),
             ("VERTEX", [(10, 77), (20, 77)]), ("POLYLINE", []), ("VERTEX", [(10, 5), (20, 6)]), ("SEQEND", [])]
    (tmp_path / "m.dxf").write_text(blocks + dxf(*quads[:20], *lines, *quads[20:]).replace("\n", "\r\n"), newline="")
    got = readers.read_dxf_faces(spark, str(tmp_path), **small).orderBy("tri_id").collect()
    assert len(got) == 74 and [flat(r) for r in got[::2]] == [tuple(float(c) for v in f for c in v) for f in facets]
    found = {}
    for r in readers.read_dxf_polylines(spark, str(tmp_path), **small).orderBy("polyline", "pos").collect():
        found.setdefault((r["kind"], r["polyline"]), []).append((r["pos"], r["x"], r["y"]))
    assert list(found.values()) == [[(k, float(k), float(-k)) for k in range(9)], [(k, float(k), 0.0) for k in range(12)], [(0, 5.0, 6.0)]]


def test_bad_mesh_files_are_reported(spark, tmp_path):
    (tmp_path / "empty.stl").write_bytes(b"")
    (tmp_path / "none.stl").write_bytes(b" " * 80 + bytes(4))
    (tmp_path / "half.stl").write_text("solid x\nfacet normal 0 0 1\nvertex 1 2 3\nvertex 1 2 nope\nvertex 1 2 3\nendfacet\nfacet\nvertex 0 0 0\nvertex 1 0 0\nvertex 0 1 0\nendfacet\n")
    tri, bad = readers.read_stl(spark, str(tmp_path))
    assert tri.count() == 1 and {(r["path"].split("/")[-1], r["problem"]) for r in bad.collect()} == {("empty.stl", "EMPTY"), ("none.stl", "NO_FACETS"), ("half.stl", "BROKEN_FACETS")}
    only, none = readers.read_stl(spark, str(tmp_path / "half.stl"))
    assert only.count() == 1 and none.count() == 1
    assert readers.read_dxf_faces(spark, str(tmp_path)).count() == 0


def test_polyline_files_keep_apart_and_in_order(spark, tmp_path):
    for name, n in (("a", 3000), ("b", 5)):
        (tmp_path / f"{name}.csv").write_text("id,label,from,to\n" + "".join(f"{i},L{i},{i * 2},{-i}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = readers.read_polyline_csv(spark, str(tmp_path)).collect()
        lines = readers.read_reference_lines(spark, str(tmp_path / "b.csv")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {}
    for r in sorted(rows, key=lambda r: (r["path"], r["pos"])):
        got.setdefault(r["path"].split("/")[-1], []).append((r["pos"], r["x"], r["y"]))
    assert got == {f"{name}.csv": [(i, float(i), float(i * 2)) for i in range(n)] for name, n in (("a", 3000), ("b", 5))}
    assert lines == []


def test_csv_readers(spark, tmp_path):
    (tmp_path / "d.csv").write_text("Pozo,Tiempo Inicial,Tiempo Final,Prof. por Operador,Coord. Norte [m],Coord. Este [m],Equipo\nH-1,02/01/2026 08:00,02/01/2026 08:20,17,5,4,R1\nH-2,bad,02/01/2026 09:00,x,1,2,R1\n")
    r = readers.read_drilling_csv(spark, str(tmp_path / "d.csv")).orderBy("pozo").collect()
    assert (r[0]["duration_min"], r[0]["depth_m"], r[0]["px"], r[0]["py"]) == (20.0, 17.0, 4.0, 5.0) and r[0]["tiempo_final"].month == 1
    assert r[1]["duration_min"] is None and r[1]["depth_m"] is None
    (tmp_path / "e.csv").write_text("foo,bar\n1,2\n")
    assert readers.read_drilling_csv(spark, str(tmp_path / "e.csv")).count() == 0
    (tmp_path / "r.csv").write_text(" Sector ,LEVEL,rmr,lithology\nA,100,55,and\nA,x,55,and\n")
    assert [tuple(x) for x in readers.read_rock_mass_csv(spark, str(tmp_path / "r.csv")).collect()] == [("A", 100.0, 55.0, "and")]
    with pytest.raises(ValueError):
        readers.read_rock_mass_csv(spark, str(tmp_path / "e.csv"))
    (tmp_path / "p.csv").write_text("Este,Norte\n1,2\n3,\n5,6\n")
    assert [(x["x"], x["y"]) for x in readers.read_polyline_csv(spark, str(tmp_path / "p.csv")).collect()] == [(1.0, 2.0), (5.0, 6.0)]
    (tmp_path / "q.csv").write_text("x,1\n7,8\n")
    assert [(x["x"], x["y"]) for x in readers.read_reference_lines(spark, str(tmp_path / "q.csv")).collect()] == [(7.0, 8.0)]
    assert readers.read_exchange_csv(spark, str(tmp_path / "e.csv")).count() == 1


def test_sections_json(spark, tmp_path):
    doc = {"sections": [{"name": "S-01", "origin": [1000, 2000], "azimuth": 0, "length": 200, "sector": "Norte"}, {"name": "S-02", "origin": [1, 2], "azimuth": 90, "length_up": 30, "length_down": 50}]}
    (tmp_path / "s.json").write_text(json.dumps(doc, indent=1))
    a, b = readers.read_sections_json(spark, str(tmp_path / "s.json")).orderBy("section").collect()
    assert (a["origin_x"], a["length"], a["sector"]) == (1000.0, 200.0, "Norte") and b["length"] == 80.0


def test_results_replace_only_their_section(spark, tmp_path):
    path = str(tmp_path / "res")
    make = lambda *r: spark.createDataFrame(list(r), "section string, bench_num int")
    writers.save_results(make(("A", 1), ("A", 2), ("B", 1)), path)
    writers.save_results(make(("A", 9)), path)
    assert {(r["section"], r["bench_num"]) for r in writers.read_results(spark, path).collect()} == {("A", 9), ("B", 1)}
    one = writers.read_results(spark, path, "B")
    assert one.count() == 1 and len(one.inputFiles()) < len(writers.read_results(spark, path).inputFiles())
    writers.save_extraction(make(("A", 1)).withColumn("kind", F.lit("topo")), str(tmp_path / "ext"))


def test_diagnostics_bundle(spark, tmp_path):
    r = process_holes(raw(spark), CONFIG, bench_height=15.0, row_key="label_pozo")
    names = writers.write_diagnostics(r, str(tmp_path / "diag"), config={"version": "2.0"})
    assert names == ["accepted", "rejections", "summary", "configuration"] and spark.read.parquet(str(tmp_path / "diag/rejections")).count() == 5
    writers.write_rejections(r, str(tmp_path / "rej"), {"version": "2.0"})
    assert spark.read.csv(str(tmp_path / "rej/rejected_rows"), header=True).count() == 5
    writers.write_exchange_csv(r.rejections, str(tmp_path / "ex"))


EVENTS = "event_id long, pozo string, tiempo_final timestamp, depth_m double"


def test_last_event_stream_takes_late_redrills(spark, tmp_path):
    src, table, ckpt = (str(tmp_path / n) for n in ("src", "table", "ck"))
    put = lambda n, rows: spark.createDataFrame(rows, "event_id long, pozo string, t string, depth_m double").selectExpr(
        "event_id", "pozo", "CAST(t AS TIMESTAMP) AS tiempo_final", "depth_m").write.mode("append").parquet(src)
    stream = lambda: spark.readStream.schema(EVENTS).parquet(src)
    put(1, [(1, "A", "2026-01-01 10:00:00", 1.0), (2, "B", "2026-01-01 10:00:00", 2.0)])
    jobs.upsert_last_events(stream(), table, ckpt).awaitTermination()
    put(2, [(3, "A", "2026-01-05 10:00:00", 3.0), (4, "B", "2025-12-01 10:00:00", 9.0), (5, "C", "2026-01-01 00:00:00", 5.0)])
    jobs.upsert_last_events(stream(), table, ckpt).awaitTermination()
    assert {(r["pozo"], r["event_id"]) for r in jobs.current_last_events(spark, table).collect()} == {("A", 3), ("B", 2), ("C", 5)}
    # the second batch wrote the holes it changed, not the table
    assert {(r["pozo"], r["event_id"]) for r in spark.read.parquet(f"{table}/batch=1").collect()} == {("A", 3), ("C", 5)}


def test_last_event_state_survives_a_replay_and_expiry(spark, tmp_path):
    src, table, ckpt = (str(tmp_path / n) for n in ("src", "table", "ck"))
    put = lambda rows: spark.createDataFrame(rows, "event_id long, pozo string, t string, depth_m double").selectExpr(
        "event_id", "pozo", "CAST(t AS TIMESTAMP) AS tiempo_final", "depth_m").coalesce(1).write.mode("append").parquet(src)
    run = lambda **more: jobs.upsert_last_events(spark.readStream.schema(EVENTS).parquet(src), table, ckpt, **more).awaitTermination()
    rows = lambda n: {(r["pozo"], r["event_id"]) for r in spark.read.parquet(f"{table}/batch={n}").collect()}
    put([(1, "A", "2026-01-01 10:00:00", 1.0), (2, "A", "2026-01-01 10:00:00", 2.0), (3, None, "2026-01-01 10:00:00", 2.0), (4, "B", None, 2.0)])
    run(keep_days=1e-5)  # state goes after a second
    put([(5, "A", "2026-01-03 10:00:00", 3.0)])
    run(keep_days=1e-5)
    assert rows(0) == {("A", 1)} and rows(1) == {("A", 5)}
    # a batch whose end was not recorded runs again and writes the same
    import pathlib
    import shutil

    (pathlib.Path(ckpt) / "commits" / "1").unlink()
    crc = pathlib.Path(ckpt) / "commits" / ".1.crc"
    if crc.exists():
        crc.unlink()
    shutil.rmtree(pathlib.Path(table) / "batch=1")
    run(keep_days=1e-5)
    assert rows(1) == {("A", 5)}
    import time

    time.sleep(1.5)
    put([(6, "A", "2025-06-01 10:00:00", 9.0)])  # older, but the state is gone: the change is kept, the table is right
    run(keep_days=1e-5)
    assert rows(2) == {("A", 6)}
    assert {(r["pozo"], r["event_id"]) for r in jobs.current_last_events(spark, table).collect()} == {("A", 5)}
    assert jobs.compact_last_events(spark, table, str(tmp_path / "compact")) == 1


def test_store_keeps_everything_when_a_write_fails(spark, tmp_path):
    path = str(tmp_path / "store")
    make = lambda rows, schema="project string, section string, n int": spark.createDataFrame(rows, schema)
    store = KeyedStore(spark, path, ["project", "section"], buckets=4)
    with pytest.raises(FileNotFoundError):
        store.read()
    assert store.replace(make([("p", f"S{i}", k) for i in range(20) for k in range(3)] + [(None, "S0", 7)])) == 1
    content = lambda df: sorted(map(str, ((r["project"], r["section"], r["n"]) for r in df.collect())))
    first = content(store.read())

    def stop():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        store.replace(make([("p", "S1", 100)]), before_commit=stop)
    assert content(store.read()) == first and store.manifest()["number"] == 1
    # somebody else commits between the files and the manifest
    other = KeyedStore(spark, path, ["project", "section"])
    with pytest.raises(RuntimeError, match="somebody else"):
        store.replace(make([("p", "S1", 100)]), before_commit=lambda: other.replace(make([("p", "S2", 200), (None, "S0", 8)])))
    want = [r for r in first if "'S2'" not in r and "None" not in r] + ["('p', 'S2', 200)", "(None, 'S0', 8)"]
    assert content(store.read()) == sorted(want) and content(store.read(number=1)) == first
    assert store.replace(make([("p", "S3", 1, "new")], "project string, section string, n int, note string")) == 3
    assert [(r["n"], r["note"]) for r in store.read(project="p", section="S3").collect()] == [(1, "new")]
    assert {r["note"] for r in store.read(project="p", section="S4").collect()} == {None} and content(store.read(project=None, section="S0")) == ["(None, 'S0', 8)"]
    assert store.replace(make([("p", "S5", 5)])) == 4 and {r["note"] for r in store.read(project="p", section="S3").collect()} == {"new"}
    before = content(store.read())
    assert store.vacuum(keep=1) > 0 and content(store.read()) == before and store.manifest(1) is None
    assert len(store.read().inputFiles()) <= 4


def test_trend_stream_drops_late_rows(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = [("2026-01-05", 0.3), ("2026-01-06", 0.5), ("2026-03-20", 0.4), ("2026-06-20", 0.4)]
    spark.createDataFrame(rows, "t string, pf_vol_kgm3 double").selectExpr("CAST(t AS TIMESTAMP) AS blast_time", "pf_vol_kgm3").coalesce(1).write.parquet(src)
    out = jobs.powder_factor_trend(spark.readStream.schema("blast_time timestamp, pf_vol_kgm3 double").parquet(src))
    q = out.writeStream.format("memory").queryName("trend").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["n_pozos"]: r["pf_promedio"] for r in spark.table("trend").collect()}
    assert got[2] == pytest.approx(0.4) and spark.table("trend").count() == 2  # the newest window still waits for its watermark


def test_whole_trend_adds_the_open_windows(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    rows = [("2026-01-05", 0.3), ("2026-01-06", 0.5), ("2026-03-20", 0.4), ("2026-06-20", 0.7), ("2026-06-21", 0.9), (None, 0.1)]
    spark.createDataFrame(rows, "t string, pf_vol_kgm3 double").selectExpr("CAST(t AS TIMESTAMP) AS blast_time", "pf_vol_kgm3").coalesce(1).write.parquet(src)
    stream = jobs.powder_factor_trend(spark.readStream.schema("blast_time timestamp, pf_vol_kgm3 double").parquet(src))
    stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    got = jobs.whole_trend(spark.read.parquet(src), spark.read.schema(stream.schema).parquet(out)).orderBy("period_start").collect()
    assert [(r["n_pozos"], pytest.approx(r["pf_promedio"])) for r in got] == [(2, 0.4), (1, 0.4), (2, 0.8)]


def test_validation_stream_has_two_sinks(spark, tmp_path):
    src = str(tmp_path / "src")
    raw(spark).write.parquet(src)
    acc, rej = str(tmp_path / "acc"), str(tmp_path / "rej")
    jobs.validate_stream(spark.readStream.schema(RAW).parquet(src), CONFIG, acc, rej, str(tmp_path / "ck"), 15.0, "label_pozo").awaitTermination()
    assert spark.read.parquet(acc).count() == 1 and spark.read.parquet(rej).count() == 5


def test_changelog_plan_is_streaming(spark, tmp_path):
    spark.createDataFrame([(1, "A", 1.0)], "event_id long, pozo string, depth_m double").withColumn("tiempo_final", F.current_timestamp()).write.parquet(str(tmp_path / "s"))
    assert jobs.last_events_changelog(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "s"))).isStreaming
