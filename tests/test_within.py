"""g15_ablation on odd tables, against its SQL and against all pairs."""

import datetime as dt
import math
import random

import duckdb

from gridloom.operators import graph, topology
from gridloom.plans import graphs
from tests.compare import same

NODE = "project_id string, node_id bigint, x_mm double, y_mm double, degree bigint, node_type string, loaded_at timestamp"
T = dt.datetime(2025, 1, 1)
TOLERANCES = (1000, 2000, 3000)


def ablation(spark, folder, rows):
    """The query and its SQL over nodes (project_id, node_id, x, y)."""
    spark.createDataFrame([(*r, 1, "n", T) for r in rows], NODE).write.parquet(f"{folder}/geometry_nodes.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW geometry_nodes AS SELECT * FROM '{folder}/geometry_nodes.parquet/*.parquet'")
    same(graphs.ablation(spark, str(folder)), con, graphs.ORACLES["g15_ablation"])


def clump(rng, x, y, width, n):
    return [(round(x + rng.random() * width, 3), round(y + rng.random() * width, 3)) for _ in range(n)]


def test_odd_nodes(spark, tmp_path):
    inf, nan = math.inf, math.nan
    places = {
        "odd": [(0.0, 0.0), (-0.0, 500.0), (nan, 0.0), (nan, 0.0), (0.0, nan), (inf, 0.0), (inf, 0.0), (0.0, -inf), (None, 0.0), (0.0, None), (9e15, 1.0), (9e15 + 900, 1.0), (9e15 + 4000, 1.0), (1e300, 1e300), (1e300, 1e300)],
        "same": [(7.5, 7.5)] * 40,
        # exactly the tolerance apart in doubles, though x + 3000 is rounded to less than the other
        "edge": [(x, 1e5 * k) for k, a in enumerate((0.1, 8.001, 35.774, 1095.301)) for x in (a, a + 3000.0)] + [(math.nextafter(3000.0 + 5, 0), -9e4), (5.0, -9e4), (math.nextafter(3000.0 + 5, 9e9), -2e5), (5.0, -2e5)],
        None: [(0.0, 0.0), (1.0, 1.0), (nan, 1.0)],
        "p|q": [(0.0, 0.0), (600.0, 800.0), (600.0, 2800.001), (-600.0, -3200.0)],
    }
    ablation(spark, tmp_path, [(p, i, x, y) for p, xy in places.items() for i, (x, y) in enumerate(xy)])


def test_rounded_edge(spark, tmp_path):
    """Nodes whose distance is 3000 in doubles, while the one lies beyond the other plus 3000."""
    rng, rows = random.Random(3), []
    while len(rows) < 40:
        a = rng.uniform(-3000, 3000)
        b = math.nextafter(a + 3000.0, math.inf)
        if b - a <= 3000.0:
            rows += [("e", len(rows), a, 1e5 * len(rows)), ("e", len(rows) + 1, b, 1e5 * len(rows))]
    ablation(spark, tmp_path, rows)


def components_of(points, tolerance):
    up = list(range(len(points)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (ax, ay) in enumerate(points):
        for j, (bx, by) in enumerate(points[:i]):
            if math.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by)) <= tolerance:
                up[root(i)] = root(j)
    return sum(up[i] == i for i in range(len(points)))


def test_clumps_against_all_pairs(spark):
    """Clumps with gaps just under and over each tolerance: cells stay open for several looks."""
    rng, all_ = random.Random(5), {}
    for gap in (999.9, 1000.0, 1000.001, 2999.999, 3000.001):
        left = clump(rng, 0.0, 0.0, 300.0, 60)
        x, y = max(left)
        right = [(x + gap + 0.1 * i * i, y + 50 * math.sin(i)) for i in range(60)]
        all_[str(gap)] = [*left, (x + gap, y), *right[1:], *clump(rng, -8000.0, -8000.0, 9000.0, 60)]
    all_["apart"] = [*clump(rng, 0.0, 0.0, 300.0, 60), *clump(rng, 1250.0, 0.0, 300.0, 60), *clump(rng, 0.0, 3290.0, 300.0, 60)]
    want = {t: sum(components_of(points, t) for points in all_.values()) for t in TOLERANCES}
    df = spark.createDataFrame([(k, *p) for k, points in all_.items() for p in points], "project_id string, x double, y double")
    assert {r["tolerance"]: r["n_components"] for r in topology.count_within(df, TOLERANCES).collect()} == want


def test_no_nodes(spark, tmp_path):
    ablation(spark, tmp_path, [("p", 1, None, 0.0)])


def test_crowded_project(spark, tmp_path, monkeypatch):
    """Links don't grow as the square of the nodes of a crowded project."""
    seen = []

    def spy(nodes, pairs, keys, *label):
        seen.append(pairs.count())
        return graph.components(nodes, pairs, keys, *label)

    monkeypatch.setattr(graphs, "components", spy)
    monkeypatch.setattr(topology, "components", spy)
    rng = random.Random(7)
    ablation(spark, tmp_path, [("p", i, *p) for i, p in enumerate(clump(rng, 0.0, 0.0, 2500.0, 300))])
    assert seen and max(seen) <= 10 * 300
