import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridloom.functions import arrays, scalar
from gridloom.operators import graph, matching, spatial, topology

SEG = "project_id string, uuid string, x0 double, y0 double, x1 double, y1 double"


def segs(spark, *rows, project="p"):
    return spark.createDataFrame([(project, f"s{i:03}", *map(float, r)) for i, r in enumerate(rows)], SEG)


def built(spark, *rows):
    nodes, edges = topology.graph_of(topology.planar_parts(segs(spark, *rows)))
    return nodes, edges


SQUARE = [(10, 0, 10, 10), (0, 10, 10, 10), (0, 0, 10, 0), (0, 10, 0, 0)]


def test_square(spark):
    nodes, edges = built(spark, *SQUARE)
    assert [(r.id, r.x, r.y, r.degree) for r in nodes.orderBy("id").collect()] == [(0, 0, 0, 2), (1, 0, 10, 2), (2, 10, 0, 2), (3, 10, 10, 2)]
    assert [(r.a, r.b, r.length) for r in edges.orderBy("id").collect()] == [(0, 1, 10), (0, 2, 10), (1, 3, 10), (2, 3, 10)]
    assert [(r.area, r.n_edges) for r in topology.faces(nodes, edges).collect()] == [(100, 4)]


def test_square_with_duplicate_and_point(spark):
    nodes, edges = built(spark, *SQUARE, (10, 0, 0, 0), (5, 5, 5, 5))
    assert edges.count() == 4 and topology.faces(nodes, edges).count() == 1


def test_crossing(spark):
    nodes, edges = built(spark, (0, 5, 10, 5), (5, 0, 5, 10))
    assert nodes.count() == 5 and edges.count() == 4
    assert nodes.where("degree = 4").select("id", "x", "y").collect() == [(2, 5.0, 5.0)]


def test_two_rooms_and_a_tail(spark):
    nodes, edges = built(spark, *SQUARE, (10, 0, 20, 0), (20, 0, 20, 10), (20, 10, 10, 10), (20, 10, 30, 10))
    assert sorted(r.area for r in topology.faces(nodes, edges).collect()) == [100, 100]


def test_squares_joined_by_a_bridge(spark):
    nodes, edges = built(spark, *SQUARE, (30, 0, 40, 0), (40, 0, 40, 10), (40, 10, 30, 10), (30, 10, 30, 0), (10, 0, 30, 0))
    assert [(r.area, r.n_edges) for r in topology.faces(nodes, edges).collect()] == [(100, 4), (100, 4)]


def test_grid_of_lines(spark):
    lines = [(0, i * 10, 200, i * 10) for i in range(21)] + [(i * 10, 0, i * 10, 200) for i in range(21)]
    nodes, edges = built(spark, *lines)
    assert (nodes.count(), edges.count(), topology.faces(nodes, edges).count()) == (441, 840, 400)


@pytest.mark.parametrize("off,snaps", [(0.0625, 1), (0.125, 0), (0.1875, 0)])
def test_t_snap_is_strict(spark, off, snaps):
    moved, splits = topology.snap_t_junctions(segs(spark, (0, 0, 10, 0), (5, off, 5, 5)), 0.125)
    assert splits.count() == snaps
    nodes, edges = topology.graph_of(topology.planar_parts(moved, splits))
    assert edges.count() == (3 if snaps else 2)


def test_t_snap(spark):
    moved, splits = topology.snap_t_junctions(segs(spark, (0, 0, 10, 0), (5, 0.8, 5, 5)), 5.0)
    nodes, edges = topology.graph_of(topology.planar_parts(moved, splits))
    assert sorted((r.x, r.y, r.degree) for r in nodes.collect()) == [(0, 0, 1), (5, 0, 3), (5, 5, 1), (10, 0, 1)]
    assert sorted(r.length for r in edges.collect()) == [5, 5, 5]


def test_order_and_direction_do_not_matter(spark):
    base = [(0, 0, 10, 0), (4, -3, 4, 7), (2, 2, 8, 2)]
    seen = set()
    for order in itertools.permutations(base):
        flipped = [(r[2], r[3], r[0], r[1]) if i % 2 else r for i, r in enumerate(order)]
        nodes, edges = built(spark, *flipped)
        seen.add((tuple(sorted(map(tuple, nodes.collect()))), tuple(sorted(map(tuple, edges.collect())))))
    assert len(seen) == 1


def test_far_coordinates(spark):
    off = 2.0e7
    nodes, edges = built(spark, *[tuple(v + off for v in r) for r in SQUARE])
    assert [r.area for r in topology.faces(nodes, edges).collect()] == [100.0]


def test_merge_collinear(spark):
    one = lambda *r: [tuple(x)[2:] for x in topology.merge_collinear(segs(spark, *r), 5.0).collect()]
    assert one((0, 0, 5, 0), (4, 0, 10, 0)) == [(2, 0, 0, 10, 0)]
    assert one((0, 0, 10, 0), (0, 0, 10, 0), (10, 0, 0, 0)) == [(3, 0, 0, 10, 0)]
    assert len(one((0, 0, 10, 0), (10, 0, 10, 9))) == 2


def test_leaders_are_those_of_the_sequential_rule(spark):
    rng = random.Random(3)
    pts = [(i, rng.random() * 20, rng.random() * 20) for i in range(150)]
    leaders, want = [], {}
    for i, x, y in pts:
        near = [(math.dist((x, y), (a, b)), a, b, j) for j, a, b in leaders if math.dist((x, y), (a, b)) < 2]
        if near:
            want[i] = min(near)[3]
        else:
            leaders.append((i, x, y))
            want[i] = i
    df = spark.createDataFrame([("p", *p) for p in pts], "project_id string, pid long, x double, y double")
    assert {r.pid: r.leader for r in topology.snap_to_leaders(df, 2.0).collect()} == want


def test_box_join_finds_each_pair_once(spark):
    rng = random.Random(5)
    def boxes(n, big):
        out = []
        for i in range(n):
            x, y, s = rng.uniform(-50, 50), rng.uniform(-50, 50), rng.choice([0.0, 0.1, 1, 10, big])
            out.append((f"p{i % 2}", i, x, y, x + s, y + rng.random() * s))
        return out
    a, b = boxes(120, 100), boxes(90, 1000)
    schema = "project_id string, k int, min_x double, min_y double, max_x double, max_y double"
    got = spatial.box_join(spark.createDataFrame(a, schema), spark.createDataFrame(b + [("p0", None, None, 0.0, 0.0, 0.0)], schema), ["project_id"], 1.0, 0.5)
    pairs = [(r.project_id, r.k, r.r_k) for r in got.collect()]
    want = {(p, i, j) for p, i, *u in a for q_, j, *v in b if p == q_ and u[0] - 0.5 <= v[2] and u[2] + 0.5 >= v[0] and u[1] - 0.5 <= v[3] and u[3] + 0.5 >= v[1]}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    assert spatial.box_join(spark.createDataFrame([], schema), spark.createDataFrame(b, schema), ["project_id"], 1.0).count() == 0


def test_nearest_goes_as_far_as_it_must(spark):
    pts = spark.createDataFrame([("p", 1, 0.0, 0.0), ("p", 2, 1e6, 0.0), ("q", 3, 0.0, 0.0)], "project_id string, i int, x double, y double")
    tgt = spatial.point_box(spark.createDataFrame([("p", "a", 3.0, 4.0), ("p", "b", 3.0, -4.0)], "project_id string, t string, x double, y double"), "x", "y")
    got = spatial.nearest(pts, tgt, ["project_id"], ["i"], F.col("r_t"), ["r_t"], 1.0)
    assert sorted((r.i, r.r_t, round(r.distance)) for r in got.collect()) == [(1, "a", 5), (2, "a", 999997)]


def test_components_match_a_search(spark):
    rng = random.Random(7)
    pairs = [("p", i, i + 1) for i in range(300)] + [("q", rng.randrange(200), rng.randrange(200)) for _ in range(120)]
    nodes = [("p", i) for i in range(301)] + [("q", i) for i in range(200)]
    got = graph.components(spark.createDataFrame(nodes, "s string, n long"), spark.createDataFrame(pairs, "s string, a long, b long"), ["s", "n"])
    parent = {x: x for x in nodes}
    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for s, a, b in pairs:
        lo, hi = sorted([root((s, a)), root((s, b))])
        parent[hi] = lo
    assert {(r.s, r.n): r.component for r in got.collect()} == {x: root(x)[1] for x in nodes}


def test_prune_takes_long_chains_whole(spark):
    rng = random.Random(11)
    path = [("long", i, i + 1) for i in range(5000)]
    ring = [("ring", i, (i + 1) % 300) for i in range(300)] + [("ring", 1000 + i, 1001 + i) for i in range(2000)] + [("ring", 3000, 7)]
    comb = [("comb", i, i + 1) for i in range(400)] + [("comb", i, 1000 + i) for i in range(401)]
    some = sorted({("some", min(e), max(e)) for e in ((rng.randrange(150), rng.randrange(150)) for _ in range(170)) if e[0] != e[1]})
    rows = path + ring + comb + some
    left = set(rows)
    while True:
        k = Counter(x for s, a, b in left for x in ((s, a), (s, b)))
        rest = {(s, a, b) for s, a, b in left if k[s, a] > 1 and k[s, b] > 1}
        if rest == left:
            break
        left = rest
    got = graph.prune(spark.createDataFrame(rows, "project_id string, a long, b long"))
    assert sorted(map(tuple, got.collect())) == sorted(left) and {s for s, *_ in left} == {"ring", "some"}


@pytest.mark.parametrize("block", [50_000, 100])
def test_leaders_of_long_chains(spark, block, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", block)
    rng = random.Random(13)
    n = 5000 if block > 100 else 700
    pairs = [("p", i, j) for i in range(n) for j in range(i + 1, min(n, i + rng.choice((2, 2, 2, 4))))]
    before, leads = {}, set()
    for _, a, b in pairs:
        before.setdefault(b, []).append(a)
    for i in range(n):
        if not leads.intersection(before.get(i, ())):
            leads.add(i)
    got = graph.first_leaders(spark.createDataFrame([("p", i) for i in range(n)], "project_id string, pid long"), spark.createDataFrame(pairs, "project_id string, a long, b long"), ["project_id", "pid"])
    assert {r.pid for r in got.where("is_leader").collect()} == leads and got.count() == n


def test_greedy_matches(spark):
    pairs = [("p", "a", "x", 1.0), ("p", "a", "y", 2.0), ("p", "b", "x", 0.5), ("p", "c", "y", 2.0)]
    got = matching.greedy_matches(spark.createDataFrame(pairs, "project_id string, l string, r string, gap double"), ["project_id"], "l", "r", ["gap"])
    assert sorted((r.l, r.r) for r in got.collect()) == [("a", "y"), ("b", "x")]


def test_point_and_ring_expressions(spark):
    df = spark.createDataFrame([([[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0]],)], "p array<array<double>>").withColumn("v", arrays.xy(F.col("p")))
    lit = lambda x: F.lit(float(x))
    r = df.select(
        arrays.signed_area(F.col("v")).alias("area"), arrays.perimeter(F.col("v")).alias("per"),
        arrays.contains(F.col("v"), lit(5), lit(5)).alias("inside"), arrays.contains(F.col("v"), lit(15), lit(5)).alias("outside"),
        scalar.to_segment(lit(5), lit(5), lit(0), lit(0), lit(10), lit(0)).alias("d"), scalar.to_segment(lit(3), lit(4), lit(0), lit(0), lit(0), lit(0)).alias("d0"),
        scalar.between_angle(lit(1), lit(0), lit(0), lit(0)).alias("none"), scalar.sweep(lit(350), lit(20)).alias("sweep"),
        arrays.canonical_ring(F.col("v")).alias("a"), arrays.canonical_ring(F.reverse(F.concat(F.slice("v", 3, 2), F.slice("v", 1, 2)))).alias("b"),
    ).first()
    assert (r.area, r.per, r.inside, r.outside, r.d, r.d0, r.none, r.sweep) == (100, 40, True, False, 5, 5, None, 30)
    assert r.a == r.b


def test_dbscan_noise_and_border(spark):
    pts = [("p", i, float(x), 0.0) for i, x in enumerate([0, 1, 2, 3, 10, 4.9])]
    got = topology.dbscan(spark.createDataFrame(pts, "project_id string, pid long, x double, y double"), 2.0, 4)
    assert {r.pid: r.label for r in got.collect()} == {0: 1, 1: 1, 2: 1, 3: 1, 4: -1, 5: 1}


def box(x, y, n):
    return [(x, y, x + n, y), (x + n, y, x + n, y + n), (x + n, y + n, x, y + n), (x, y + n, x, y)]


def test_holes(spark):
    # a square in a square, one in that, and two beside each other that share a side
    walls = box(0, 0, 100) + box(10, 10, 50) + box(20, 20, 10) + box(200, 0, 10) + box(210, 0, 10)
    got = topology.faces(*built(spark, *walls)).collect()
    assert sorted((f.area, f.n_holes) for f in got) == [(100, 0), (100, 0), (100, 0), (2400, 1), (7500, 1)]


def test_ranks_in_two_levels(spark):
    from gridloom.operators.ranks import quantiles, ranked

    rows = [("hot" if i % 3 else None, (i * 7919) % 1000, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, v long, i long").repartition(7)
    got = {r.i: r.ord for r in ranked(df, ["k"], ["v", "i"]).collect()}
    for k in ("hot", None):
        own = sorted((v, i) for a, v, i in rows if a == k)
        assert [got[i] for _, i in own] == list(range(1, len(own) + 1))
    q = {r.k: (r.a, r.b) for r in quantiles(df, ["k"], "v", [("a", 0.5), ("b", 0.95)]).where("k IS NOT NULL").collect()}
    values = sorted(v for a, v, _ in rows if a == "hot")
    at = lambda f: values[int((len(values) - 1) * f)] + (values[min(len(values) - 1, int((len(values) - 1) * f) + 1)] - values[int((len(values) - 1) * f)]) * ((len(values) - 1) * f % 1)
    assert q["hot"] == pytest.approx((at(0.5), at(0.95)))
