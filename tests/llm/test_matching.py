import random

import pytest

from gridloom.llm import components, copies

NODE = "project_id string, node_id long, g string"
EDGE = "project_id string, from_id long, to_id long, component string, v int"


def groups(spark, nodes, edges):
    df = components.connected_groups(spark.createDataFrame([(*n, "x") for n in nodes], NODE), spark.createDataFrame([(*e, "x", 0) for e in edges], EDGE))
    return {(r.project_id, r.node_id): r.group_node_id for r in df.collect()}


def searched(nodes, edges):
    parent = {n: n for n in nodes}
    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for p, a, b in edges:
        if (p, a) in parent and (p, b) in parent:
            lo, hi = sorted([root((p, a)), root((p, b))], key=lambda x: x[1])
            parent[hi] = lo
    return {n: root(n)[1] for n in nodes}


def test_chain_hub_and_random(spark):
    rng = random.Random(1)
    order = list(range(400))
    rng.shuffle(order)
    nodes = [("p", i) for i in range(400)] + [("q", i) for i in range(300)] + [("r", i) for i in range(250)]
    edges = [("p", a, b) for a, b in zip(order, order[1:])] + [("q", 299, i) for i in range(0, 299, 2)] + [("r", rng.randrange(250), rng.randrange(250)) for _ in range(120)]
    assert groups(spark, nodes, edges) == searched(nodes, edges)


def test_defined_cases(spark):
    nodes = [("p", 5), ("p", 5), ("p", 3), ("p", None), (None, 7), (None, 8), ("q", 3)]
    edges = [("p", 5, 3), ("p", 3, 5), ("p", 5, 5), ("p", None, 3), ("p", 3, 99), (None, 7, 8), ("q", 3, 5), (None, None, None)]
    assert groups(spark, nodes, edges) == {("p", 5): 3, ("p", 3): 3, (None, 7): 7, (None, 8): 7, ("q", 3): 3}
    assert groups(spark, [], edges) == {}
    assert groups(spark, [("p", 1)], []) == {("p", 1): 1}


CAD = "row_id long, project_id string, entity_type string, layer string, start_pt string, end_pt string, h string, key string, n long"


def sets(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], CAD)
    return sorted(tuple(r) for r in copies.copies(df, **kw).collect())


A, B = "(1.5, -2.0, 0.0)", "[3 4]"
SAME = [
    (1, "p", "LINE", "Dış Duvar-1", A, B),
    (2, "p", "LINE", "DIŞ  DUVAR 1", "x: 1,5; y: -2,0; z: 0,0", '{"y": 4.0, "x": 3}'),
    (3, "p", "LINE", "dişduvar.1", "Z=0 Y=-2 X=1.50", "3; 4"),
    (4, "p", "LINE", "DİŞ_DUVAR(1)", " 1.5 -2.00 0 ", "3.0,4.0"),
]
OTHER = [
    (5, "p", "LINE", "DIŞ DUVAR 2", A, B),
    (6, "p", "ARC", "DIŞ DUVAR 1", A, B),
    (7, "q", "LINE", "DIŞ DUVAR 1", A, B),
    (8, "p", "LINE", "DIŞ DUVAR 1", "(1.5, 2.0, 0.0)", B),
    (9, "p", "LINE", "DIŞ DUVAR 1", A, "[3 4 0]"),
    (10, "p", "LINE", "DIŞ DUVAR 1", B, A),
    (11, "p", "LINE", None, A, B),
    (12, "p", "LINE", None, A, B),
    (13, "p", "LINE", "DIŞ DUVAR 1", A, None),
    (14, "p", "LINE", "DIŞ DUVAR 1", "(15, -2.0, 0.0)", B),
]


@pytest.mark.parametrize("heavy", [1, 3, 1000])
def test_ways_of_writing(spark, heavy):
    assert sets(spark, SAME + OTHER, heavy_rows=heavy) == [(1, 2), (1, 3), (1, 4)]


def test_copies_edges(spark):
    assert sets(spark, []) == []
    assert sets(spark, [SAME[0], SAME[0], SAME[1]]) == [(1, 2)]  # a repeated row is no copy
    long = "k" * 100_000
    assert sets(spark, [(1, None, None, long, "", ""), (2, None, None, long.upper() + " ", "", ""), (3, None, None, "", "?", "?"), (4, None, None, "--", "?", "?")]) == [(1, 2), (3, 4)]
    assert sets(spark, [(1, "p", "L", "a", "1e3 2", "1 2"), (2, "p", "L", "A", "1000, 2", "1;2")]) == [(1, 2)]


def test_collapsed(spark):
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in SAME + OTHER], CAD)
    got = {r.row_id: r.n_copies for r in copies.collapsed(df).collect()}
    assert got == {1: 4, **{r[0]: 1 for r in OTHER}}


def test_cheap_class_never_parts_copies(spark):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    def point(x, y, z):
        d = rng.choice([0, 1, 2, 3, 4])
        nums = [f"{v:.1f}" if rng.random() < 0.5 else repr(v) for v in (x, y, z)]
        return [f"({nums[0]}, {nums[1]}, {nums[2]})", f"[{nums[0]} {nums[1]} {nums[2]}]", f"z={nums[2]} X={nums[0]} y={nums[1]}", "; ".join(f"{k}: {n.replace('.', ',')}" for k, n in zip("xyz", nums)), f'{{"y":{nums[1]},"x":{nums[0]},"z":{nums[2]}}}'][d]
    rows = []
    for i in range(300):
        xyz = [round(rng.uniform(-9, 9), 1) for _ in range(3)]
        rows += [(i, point(*xyz)) for _ in range(3)]
    df = spark.createDataFrame(rows, "i int, p string").select("i", copies.point_key(F.col("p")).alias("k"), copies.cheap_class([], F.lit("a"), [F.col("p")]).alias("h"))
    per = df.groupBy("i").agg(F.count_distinct("k").alias("k"), F.count_distinct("h").alias("h"))
    assert per.where("k <> 1 OR h <> 1").count() == 0
