import math
import uuid

import pytest
from pyspark.sql import functions as F

from gridloom.plans.more import uuid5
from gridloom.sources import drawings, sinks
from gridloom.sources.dxf import Drawing, DxfSource, Matrix, bulged, curve
from gridloom.streaming import drops


def dxf(*parts):
    return "\n".join(str(x) for p in parts for x in p) + "\n"


HEAD = (0, "SECTION", 2, "HEADER", 9, "$INSUNITS", 70, 5, 0, "ENDSEC")
BLOCKS = (0, "SECTION", 2, "BLOCKS", 0, "BLOCK", 2, "door", 10, 1.0, 20, 0.0, 0, "LINE", 8, "kapı", 10, 1.0, 20, 0.0, 11, 2.0, 21, 0.0, 0, "INSERT", 2, "door", 10, 0, 20, 0, 0, "ENDBLK", 0, "ENDSEC")
BODY = (
    0, "SECTION", 2, "ENTITIES",
    0, "LINE", 8, "duvar", 10, 0, 20, 0, 11, 10, 21, 0,
    0, "LWPOLYLINE", 8, "duvar", 90, 3, 70, 1, 10, 0, 20, 0, 10, 5, 20, 0, 10, 5, 20, 5,
    0, "TEXT", 8, "yazı", 10, 1, 20, 2, 40, 3, 1, "SALON",
    0, "CIRCLE", 8, "x", 10, 0, 20, 0, 40, 1,
    0, "INSERT", 2, "door", 10, 100, 20, 50, 50, 90,
    0, "POLYLINE", 8, "p", 70, 0, 0, "VERTEX", 10, 1, 20, 1, 0, "VERTEX", 10, 2, 20, 3, 0, "SEQEND",
)
TAIL = (0, "ENDSEC", 0, "EOF")


@pytest.fixture()
def rows(spark, tmp_path):
    (tmp_path / "a.dxf").write_text(dxf(HEAD, BLOCKS, BODY, TAIL))
    (tmp_path / "b.dxf").write_text(dxf(HEAD, BODY[:16])[:-9])
    (tmp_path / "c.dxf").write_text("")
    spark.dataSource.register(DxfSource)
    return spark.read.format("dxf").load(str(tmp_path))


def test_entities(rows):
    a = rows.where("source_file = 'a.dxf'").orderBy("entity_ord").collect()
    assert [r.type for r in a] == ["LINE", "LWPOLYLINE", "TEXT", "LWPOLYLINE", "LINE", "IGNORED", "LWPOLYLINE"]
    assert (a[5].source_entity_type, a[5].block_name, a[5].ancestry) == ("INSERT", "door", ["door"])  # a block inside itself
    assert a[0].end.x == 100 and a[0].scale_to_mm == 10 and not a[0].is_corrupt
    assert a[1].closed and len(a[1].vertices) == 3 and (a[2].text, a[2].height) == ("SALON", 30)
    assert a[3].closed and a[3].source_entity_type == "CIRCLE"
    assert (round(a[4].start.x), round(a[4].start.y), round(a[4].end.x), round(a[4].end.y)) == (1000, 500, 1000, 510)
    assert a[4].ancestry == ["door"] and a[4].layer == "kapı"
    assert [(v.x, v.y) for v in a[6].vertices] == [(10, 10), (20, 30)]


def test_cut_and_empty_files(rows):
    b = rows.where("source_file <> 'a.dxf'").collect()
    assert all(r.is_corrupt for r in b) and {r.source_file for r in b} <= {"b.dxf"}


def test_chord_error():
    for r in (1.0, 50.0, 4000.0):
        pts = curve(0, 0, r, 10, 280, 0.05)
        for (x0, y0), (x1, y1) in zip(pts, pts[1:]):
            assert r - ((x0 + x1) ** 2 + (y0 + y1) ** 2) ** 0.5 / 2 <= 0.05 + 1e-9 or r <= 0.05
    half = bulged(0, 0, 2, 0, 1.0, 0.01)
    assert half[-1] == (2, 0) and min(y for _, y in half) == pytest.approx(-1, abs=0.01)
    assert drawings.arc_parts(90) == 12 and drawings.arc_parts(1) == 8


def test_curves_arrays_and_what_cannot_be_read():
    near = lambda got, want: len(got) == len(want) and all(math.dist(a, b) < 1e-6 for a, b in zip(got, want))
    door = (0, "SECTION", 2, "BLOCKS", 0, "BLOCK", 2, "d", 10, 0, 20, 0, 0, "LINE", 8, "a", 10, 0, 20, 0, 11, 1, 21, 0, 0, "LWPOLYLINE", 8, "b", 10, "oops", 20, 0, 0, "LINE", 8, "c", 10, 0, 20, 0, 11, 0, 21, 1, 0, "ENDBLK", 0, "ENDSEC")
    body = (
        0, "SECTION", 2, "ENTITIES",
        0, "INSERT", 2, "d", 10, 100, 20, 0, 41, 2, 50, 90, 70, 3, 71, 2, 44, 10, 45, 20,
        0, "ELLIPSE", 8, "e", 10, 1, 20, 2, 11, 0, 21, 40, 40, 0.5, 41, 0, 42, math.tau,
        0, "SPLINE", 8, "s", 70, 0, 71, 2, *(x for k in (0, 0, 0, 1, 1, 1) for x in (40, k)), 41, 1, 41, math.sqrt(0.5), 41, 1, 10, 10, 20, 0, 10, 10, 20, 10, 10, 0, 20, 10,
        0, "SPLINE", 8, "f", 70, 0, 71, 3, 11, 0, 21, 0, 11, 5, 21, 5, 11, 10, 21, 0,
        0, "HATCH", 8, "h", 10, 0, 20, 0, 91, 2, 92, 2, 72, 0, 73, 1, 93, 3, 10, 0, 20, 0, 10, 4, 20, 0, 10, 4, 20, 4, 97, 0,
        92, 1, 93, 2, 72, 1, 10, -10, 20, 0, 11, 10, 21, 0, 72, 2, 10, 0, 20, 0, 40, 10, 50, 0, 51, 180, 73, 1, 97, 0, 75, 0, 76, 1, 98, 1, 10, 3, 20, 3,
        0, "POINT", 8, "p", 10, 0, 20, 0,
    )
    d = Drawing(dxf(door, body, TAIL).splitlines())
    got = [e for r in d.entities for e in d.flat(r, Matrix(), "default", (), 16, 0.05)]
    lines = [e for e in got if e["type"] == "LINE"]
    starts = [(100 - 20 * r, 10 * c) for r in range(2) for c in range(3)]
    assert near([(e["start"]["x"], e["start"]["y"]) for e in lines if e["layer"] == "a"], starts)
    assert near([(e["end"]["x"], e["end"]["y"]) for e in lines if e["layer"] == "c"], [(x - 1, y) for x, y in starts])
    assert [e["type"] for e in got if e["layer"] in "bp"] == ["UNREADABLE"] * 6 + ["IGNORED"]
    curves = [(e, [(v["x"], v["y"]) for v in e["vertices"]]) for e in got if e["type"] == "LWPOLYLINE"]
    (oval, o), (_, s), (_, f), (_, h0), (_, h1) = curves
    assert oval["closed"] and all(abs(((x - 1) / 20) ** 2 + ((y - 2) / 40) ** 2 - 1) < 1e-9 for x, y in o)
    mid = lambda p: [((a + c) / 2, (b + e) / 2) for (a, b), (c, e) in zip(p, p[1:])]
    assert near([s[0], s[-1]], [(10, 0), (0, 10)]) and all(abs(math.hypot(*p) - 10) < 1e-9 for p in s) and all(10 - math.hypot(*p) < 0.05 for p in mid(s))
    assert any(math.dist(p, (5, 5)) < 1e-9 for p in f) and near([f[0], f[-1]], [(0, 0), (10, 0)]) and len(f) > 4
    assert near(h0, [(0, 0), (4, 0), (4, 4)]) and near(h1[:2], [(-10, 0), (10, 0)]) and all(abs(math.hypot(*p) - 10) < 1e-9 and p[1] >= -1e-9 for p in h1)


def test_generators(spark):
    s = drawings.synthetic(spark, 500, 3)
    assert {r["kind"]: r["count"] for r in s.groupBy("kind").count().collect()} == {"line": 300, "tiny": 100, "point": 100}
    assert s.collect() == drawings.synthetic(spark, 500, 3).collect()
    assert s.where("kind = 'point' AND (x0 <> x1 OR y0 <> y1)").count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", [1, 2]), (1, "a", None)], "n int, k string, v array<int>")
    sinks.write_json(df, f"{tmp_path}/j")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/j").collect()) == ['{"k":"a","n":1}', '{"k":"b","n":2,"v":[1,2]}']
    sinks.write_csv(df, f"{tmp_path}/c")
    assert spark.read.csv(f"{tmp_path}/c", header=True).count() == 2
    sinks.write_xml(df, f"{tmp_path}/x")
    assert spark.read.option("rowTag", "row").schema("n int, k string").xml(f"{tmp_path}/x").orderBy("n").collect()[0].k == "a"
    sinks.write_parquet(df, f"{tmp_path}/p", "k")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 2


def test_uuid5(spark):
    names = ["", "a", "duvar_1", "çatı", "x" * 5000]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", uuid5(F.col("n")).alias("u")).collect()
    assert {r.n: r.u for r in got} == {n: str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names}


def test_drops(spark, tmp_path):
    src = f"{tmp_path}/in"
    df = spark.createDataFrame([("p", 1, "2025-01-01 10:00:00"), ("p", 1, "2025-01-01 11:00:00"), ("q", 2, "2025-01-02 09:00:00")], "project_id string, k int, loaded_at string").withColumn("loaded_at", F.to_timestamp_ntz("loaded_at"))
    df.write.parquet(src)
    stream = drops.arrivals(spark, src, df.schema)
    q = drops.each_batch(stream, lambda b: b.groupBy("project_id").count(), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(60)
    assert {r.project_id: r["count"] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"p": 2, "q": 1}
    for plan, name, want in ((drops.counted(stream), "counted", 2), (drops.once_each(stream, "k"), "once", 2)):
        q = plan.writeStream.format("memory").queryName(name).outputMode("complete" if name == "counted" else "append").trigger(availableNow=True).start()
        q.awaitTermination(60)
        assert spark.table(name).count() == want
