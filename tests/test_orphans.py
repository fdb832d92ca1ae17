import datetime as dt

from gridloom.operators import orphans

T = [dt.datetime(2025, 1, d) for d in range(1, 29)]
WALL = "uuid string, project_id string, loaded_at timestamp, deleted_at timestamp, target_key string"
SPACE = "uuid string, project_id string, related_walls array<string>, neighbors array<string>, related_doors array<string>, loaded_at timestamp, deleted_at timestamp, period string"
OPEN = "uuid string, project_id string, category string, parent_wall string, loaded_at timestamp, deleted_at timestamp"


def found(spark, walls, spaces, openings, **kw):
    tables = spark.createDataFrame([(*w, "z") for w in walls], WALL), spark.createDataFrame([(*s, "z") for s in spaces], SPACE), spark.createDataFrame(openings, OPEN)
    df = orphans.model_orphans(*tables, **kw).cache()
    want = {(r["field_name"], r["period"]): r["count"] for r in df.groupBy("field_name", "period").count().collect()}
    assert {(r["field_name"], r["period"]): r["n_orphans"] for r in orphans.orphan_report(*tables, **kw).collect()} == want
    return sorted(((r["field_name"], r["owner_uuid"], r["target_key"]) for r in df.collect()), key=str)


WALLS = [("w1", "p", T[0], None), ("w1", "p", T[9], None), ("w2", "p", T[0], T[5]), ("w3", "p", T[20], None), ("w4", "q", T[0], None)]


def test_cases(spark):
    spaces = [
        ("s1", "p", [" W1 ", "w2", "w3", "w4", None, "", "w1", "nope"], ["s2", "s9"], None, T[5], None),
        ("s1", "p", ["w1"], [], [], T[25], None),
        ("s2", "p", None, [], ["d1", "x1"], T[4], T[6]),
    ]
    openings = [("d1", "p", "DOOR", None, T[0], None), ("x1", "p", "WINDOW", "w2", T[3], None), ("x2", "p", "WINDOW", "  ", T[3], None), ("x3", "p", "WINDOW", "w9", T[3], None)]
    want = [
        ("neighbors", "s1", "s9"),
        ("parent_wall", "x3", "w9"),
        ("related_doors", "s2", "x1"),
        ("related_walls", "s1", "nope"),
        ("related_walls", "s1", "w2"),  # deleted at the very time of the owner's load
        ("related_walls", "s1", "w3"),  # loaded later
        ("related_walls", "s1", "w4"),  # of another project
    ]
    assert found(spark, WALLS, spaces, openings) == want
    assert found(spark, WALLS, spaces, openings, heavy_rows=1) == want  # all keys heavy


def test_heavy_key_and_nulls(spark):
    spaces = [(f"s{i}", "p", ["gone", "w1"], [], [], T[10], None) for i in range(60)] + [(None, None, ["w1"], None, None, None, None)]
    got = found(spark, WALLS, spaces, [], heavy_rows=30)
    assert len([g for g in got if g[2] == "gone"]) == 60
    assert ("related_walls", None, "w1") in got  # a null project has no walls


def test_empty(spark):
    assert found(spark, [], [], []) == []
    report = orphans.orphan_report(spark.createDataFrame([], WALL), spark.createDataFrame([], SPACE), spark.createDataFrame([], OPEN))
    assert report.collect() == []


def test_counts_over_months(spark):
    at = [dt.datetime(2025, m, d) for m in range(1, 7) for d in (3, 20)]
    walls = [("w1", "p", at[2], at[7]), ("w2", "p", at[3], None)]
    spaces = [(f"s{i}", "p", ["w1", "w2", "w9"], [], [], t, None) for i, t in enumerate(at)] + [("sn", "p", ["w1", "w9"], [], [], None, None)]
    got = found(spark, walls, spaces, [])
    assert len([g for g in got if g[2] == "w1"]) == 2 + 5 and len([g for g in got if g[2] == "w2"]) == 3 and len([g for g in got if g[2] == "w9"]) == 13
    assert found(spark, walls, spaces, [], heavy_rows=1) == got


def test_a_third_of_all_references_names_one_key(spark):
    from pyspark.sql import functions as F

    i = F.col("id")
    refs = spark.range(150_000).select(F.lit("related_walls").alias("field_name"), F.lit("wall").alias("target_kind"), F.lit("p").alias("project_id"), F.concat(F.lit("s"), i).alias("owner_uuid"), F.when(i % 3 == 0, "hot").otherwise(F.concat(F.lit("w"), i % 5000)).alias("target_key"), F.lit(T[8]).alias("owner_load"))
    facts = spark.range(2500).select(F.lit("wall").alias("target_kind"), F.lit("p").alias("project_id"), F.concat(F.lit("w"), F.col("id")).alias("target_key"), F.lit(T[0]).alias("target_load"), F.lit(None).cast("timestamp").alias("deleted_at"))
    scratch = orphans.Scratch(spark, "test")
    got = orphans.orphan_references(refs, facts, scratch)
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString()
    n = got.count()
    assert n == refs.join(facts, "target_key", "left_anti").count()
    assert orphans.orphan_counts(refs, facts, scratch).first()["n_orphans"] == n
