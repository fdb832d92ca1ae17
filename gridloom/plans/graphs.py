"""Components, clusters, snapping, noding, faces, health and validation, composites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import scalar
from gridloom.functions.scalar import q
from gridloom.operators import topology
from gridloom.operators.graph import components, first_leaders, prune
from gridloom.operators.orphans import reference_key
from gridloom.operators.ranks import ranked
from gridloom.operators.spatial import box_join, point_box
from gridloom.plans.aggregates import _DEG, degrees
from gridloom.plans.base import AUDIT, EDGES, NODES, OPENINGS, SIDES, SPACES, WALLS, audit, edges, leaders_sql, nodes, openings, spaces, mean_, sq, sq_angle, sum_, walls, with_
from gridloom.plans.joins import _BRIDGE, _DANGLING, bridge, dangling
from gridloom.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return keep


C = F.col
SEG = ("x0", "y0", "x1", "y1")


def count():
    return F.count(F.lit(1))


def recursive(name: str, nodes_sql: str, pairs_sql: str, scope: str = "project_id") -> str:
    """Components in SQL: every node with the least it reaches."""
    return f"""{name}_n AS ({nodes_sql}), {name}_p AS ({pairs_sql}), {name}_b AS (SELECT {scope}, a, b FROM {name}_p UNION SELECT {scope}, b, a FROM {name}_p),
 {name}_r AS (SELECT {scope}, n AS a, n AS b FROM {name}_n UNION SELECT r.{scope}, r.a, x.b FROM {name}_r r JOIN {name}_b x ON x.{scope} = r.{scope} AND x.a = r.b),
 {name} AS (SELECT {scope}, a AS n, min(b) AS component FROM {name}_r GROUP BY ALL)"""


def graph_components(spark, d) -> DataFrame:
    e = edges(spark, d).select("project_id", C("from_id").alias("a"), C("to_id").alias("b"))
    return components(nodes(spark, d), e, ["project_id", "node_id"])


_CC = recursive("cc", "SELECT project_id, node_id AS n FROM nodes", "SELECT project_id, from_id AS a, to_id AS b FROM edges")


@query("g10_components", "WITH RECURSIVE " + ", ".join([NODES, EDGES, _CC]) + " SELECT project_id, n AS node_id, component FROM cc")
def g10(spark, d):
    return graph_components(spark, d)


@query("g11_open_context", "WITH RECURSIVE " + ", ".join([NODES, EDGES, _CC, _DEG]) + " SELECT cc.project_id, component, count(*) AS n_nodes, count(*) FILTER (degree = 1) AS n_dangling, count(*) FILTER (degree = 0) AS n_isolated FROM cc JOIN deg ON deg.project_id = cc.project_id AND deg.node_id = cc.n GROUP BY ALL")
def open_context(spark, d):
    """Size, open ends and isolated nodes of each component."""
    j = graph_components(spark, d).join(degrees(spark, d), ["project_id", "node_id"])
    return j.groupBy("project_id", "component").agg(count().alias("n_nodes"), F.count_if(C("degree") == 1).alias("n_dangling"), F.count_if(C("degree") == 0).alias("n_isolated"))


@query("a20_component_metrics", "WITH RECURSIVE " + ", ".join([NODES, EDGES, _CC]) + f" SELECT cc.project_id, component, count(DISTINCT n) AS n_nodes, {sq('min(x)', 3)} AS min_x, {sq('max(y)', 3)} AS max_y, coalesce(max(l), 0) AS total_len FROM cc JOIN nodes ON nodes.project_id = cc.project_id AND node_id = n LEFT JOIN (SELECT e.project_id, component AS k, {sum_('len_mm', 3)} AS l FROM edges e JOIN cc ON cc.project_id = e.project_id AND cc.n = from_id GROUP BY ALL) t ON t.project_id = cc.project_id AND t.k = component GROUP BY ALL")
def component_metrics(spark, d):
    from gridloom.session import Scratch

    cc = Scratch(spark, "metrics").save(graph_components(spark, d))
    n = cc.join(nodes(spark, d), ["project_id", "node_id"]).groupBy("project_id", "component").agg(count().alias("n_nodes"), q(F.min("x"), 3).alias("min_x"), q(F.max("y"), 3).alias("max_y"))
    l = edges(spark, d).join(cc.withColumnRenamed("node_id", "from_id"), ["project_id", "from_id"]).groupBy("project_id", "component").agg(scalar.exact_sum(C("len_mm"), 3).alias("total_len"))
    return n.join(l, ["project_id", "component"], "left").na.fill(0.0, ["total_len"])


@query("o08_components_by_size", "WITH RECURSIVE " + ", ".join([NODES, EDGES, _CC]) + ", s AS (SELECT project_id, component, count(*) AS n FROM cc GROUP BY ALL) SELECT project_id, component, n, row_number() OVER (PARTITION BY project_id ORDER BY n DESC, component) AS rank FROM s")
def components_by_size(spark, d):
    s = graph_components(spark, d).groupBy("project_id", "component").agg(count().alias("n"))
    return ranked(s.withColumn("k", -C("n")), ["project_id"], ["k", "component"], "rank").drop("k")


@query("g12_gap_retry", with_(NODES, EDGES, _DANGLING, "p AS (SELECT a.project_id, a.node_id AS a, b.node_id AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS gap FROM dangling a JOIN dangling b ON a.project_id = b.project_id AND a.node_id < b.node_id AND abs(a.x - b.x) <= 4000 AND abs(a.y - b.y) <= 4000)", "t AS (SELECT project_id, CASE WHEN count(*) FILTER (gap <= 1000) > 0 THEN 1000 WHEN count(*) FILTER (gap <= 2000) > 0 THEN 2000 ELSE 4000 END AS threshold FROM p WHERE gap > 10 AND gap <= 4000 GROUP BY project_id)") + " SELECT p.project_id, threshold, a, b FROM p JOIN t ON t.project_id = p.project_id WHERE gap > 10 AND gap <= threshold")
def gap_retry(spark, d):
    """Gaps closed at the first of three thresholds that closes any in the project: all
    thresholds in one pass."""
    n = point_box(dangling(spark, d).select("project_id", "node_id", "x", "y"), "x", "y")
    p = box_join(n, n, ["project_id"], 5000.0, 4000.0).where("node_id < r_node_id").withColumn("gap", scalar.dist(C("x"), C("y"), C("r_x"), C("r_y"))).where("gap > 10 AND gap <= 4000")
    p = p.join(p.groupBy("project_id").agg(F.min("gap").alias("least")), "project_id")
    t = F.when(C("least") <= 1000, 1000).when(C("least") <= 2000, 2000).otherwise(4000)
    return p.withColumn("threshold", t).where("gap <= threshold").select("project_id", "threshold", C("node_id").alias("a"), C("r_node_id").alias("b"))


_PTS = "pts AS (SELECT project_id, node_id AS pid, x, y FROM nodes WHERE x IS NOT NULL AND y IS NOT NULL), near AS (SELECT a.project_id, a.pid AS a, b.pid AS b FROM pts a JOIN pts b ON a.project_id = b.project_id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 3000), core AS (SELECT project_id, a AS n FROM near GROUP BY ALL HAVING count(*) >= 4)"
_DB = recursive("cl", "SELECT project_id, n FROM core", "SELECT near.project_id, a, b FROM near JOIN core c ON c.project_id = near.project_id AND c.n = a JOIN core e ON e.project_id = near.project_id AND e.n = b")


@query("g13_dbscan", "WITH RECURSIVE " + ", ".join([NODES, _PTS, _DB]) + " SELECT p.project_id, p.pid, coalesce(max(o.component), min(c.component), -1) AS label FROM pts p LEFT JOIN cl o ON o.project_id = p.project_id AND o.n = p.pid LEFT JOIN near ON near.project_id = p.project_id AND near.a = p.pid LEFT JOIN cl c ON c.project_id = near.project_id AND c.n = near.b GROUP BY ALL")
def dbscan(spark, d):
    pts = nodes(spark, d).dropna(subset=["x", "y"]).select("project_id", C("node_id").alias("pid"), "x", "y")
    return topology.dbscan(pts, 3000.0, 4)


_VAR = "v AS (SELECT t.tol || '|' || project_id AS project_id, node_id AS n, x, y FROM nodes, (VALUES (1000), (2000), (3000)) t(tol) WHERE x IS NOT NULL AND y IS NOT NULL)"
_VARCC = recursive("vc", "SELECT project_id, n FROM v", "SELECT a.project_id, a.n AS a, b.n AS b FROM v a JOIN v b ON a.project_id = b.project_id AND a.n < b.n AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= split_part(a.project_id, '|', 1)::DOUBLE")


@query("g15_ablation", "WITH RECURSIVE " + ", ".join([NODES, _VAR, _VARCC]) + " SELECT split_part(project_id, '|', 1)::INT AS tolerance, count(DISTINCT (project_id, component)) AS n_components FROM vc GROUP BY ALL")
def ablation(spark, d):
    """Components of nodes linked within each of three tolerances, all in one run with the variant in the key."""
    return topology.count_within(nodes(spark, d).where("x IS NOT NULL AND y IS NOT NULL"), (1000, 2000, 3000))


_LABELS = "lb AS (SELECT project_id, source_id AS n, (min_x + max_x) / 2 AS x, (min_y + max_y) / 2 AS y FROM audit WHERE audit_role = 'room_label')"
_LINK = recursive("lk", "SELECT project_id, n FROM lb", "SELECT a.project_id, a.n AS a, b.n AS b FROM lb a JOIN lb b ON a.project_id = b.project_id AND a.n < b.n AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 4000")


@query("g17_single_linkage", "WITH RECURSIVE " + ", ".join([AUDIT, _LABELS, _LINK]) + f" SELECT lk.project_id, component AS cluster, count(*) AS n, {sq(mean_('x', 3), 2)} AS mean_x, {sq('min(y)', 3)} AS min_y FROM lk JOIN lb ON lb.project_id = lk.project_id AND lb.n = lk.n GROUP BY ALL")
def single_linkage(spark, d):
    """Clusters of room labels at most 4000 apart, with their middle and bounds."""
    from gridloom.plans.joins import labels

    l = labels(spark, d)
    box = point_box(l, "x", "y")
    p = box_join(box, box, ["project_id"], 5000.0, 4000.0).where((C("source_id") < C("r_source_id")) & (scalar.dist(C("x"), C("y"), C("r_x"), C("r_y")) <= 4000))
    cc = components(l, p.select("project_id", C("source_id").alias("a"), C("r_source_id").alias("b")), ["project_id", "source_id"], "cluster")
    return l.join(cc, ["project_id", "source_id"]).groupBy("project_id", "cluster").agg(count().alias("n"), q(scalar.exact_mean(C("x"), 3), 2).alias("mean_x"), q(F.min("y"), 3).alias("min_y"))


def placed(n: DataFrame) -> DataFrame:
    """project_id, pid, x, y: nodes numbered by place."""
    return ranked(n.select("project_id", "x", "y", "node_id"), ["project_id"], ["x", "y", "node_id"], "pid").select("project_id", "pid", "x", "y")


def _led(tolerance: float) -> str:
    rows = "SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY x, y, node_id) AS pid, x, y FROM nodes WHERE x IS NOT NULL AND y IS NOT NULL"
    return f"WITH RECURSIVE {NODES}, " + leaders_sql("ld", rows, f"sqrt((l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y)) < {tolerance}")


@query("g01_snapped_points", _led(1500) + " SELECT project_id, pid, leader FROM ld")
def snapped_points(spark, d):
    """Nodes snapped to the nearest earlier leader within 1500."""
    n = nodes(spark, d).dropna(subset=["x", "y"])
    return topology.snap_to_leaders(placed(n), 1500.0)


@query("g03_seed_centroids", _led(1500) + f" SELECT ld.project_id, leader AS seed, count(*) AS n, {sq(mean_('x', 3), 3)} AS x, {sq(mean_('y', 3), 3)} AS y FROM ld JOIN ld_r r ON r.project_id = ld.project_id AND r.pid = ld.pid GROUP BY ALL")
def seed_centroids(spark, d):
    """Seeds as leaders; members go to the first seed near them; mean points."""
    from gridloom.session import Scratch

    n = nodes(spark, d).dropna(subset=["x", "y"])
    p = Scratch(spark, "seeds").save(placed(n))
    lead = topology.snap_to_leaders(p, 1500.0)
    return lead.join(p, ["project_id", "pid"]).groupBy("project_id", C("leader").alias("seed")).agg(count().alias("n"), q(scalar.exact_mean(C("x"), 3), 3).alias("x"), q(scalar.exact_mean(C("y"), 3), 3).alias("y"))


_GAP = "least(" + ", ".join(f"sqrt((a.x{i} - b.x{j}) * (a.x{i} - b.x{j}) + (a.y{i} - b.y{j}) * (a.y{i} - b.y{j}))" for i in (0, 1) for j in (0, 1)) + ")"
_TURN = f"abs({sq_angle('a.x0', 'a.y0', 'a.x1', 'a.y1')} - {sq_angle('b.x0', 'b.y0', 'b.x1', 'b.y1')})"
_CHAIN = recursive("ch", "SELECT DISTINCT project_id, uuid AS n FROM walls", f"SELECT a.project_id, a.uuid AS a, b.uuid AS b FROM walls a JOIN walls b ON a.project_id = b.project_id AND a.wall_type IS NOT DISTINCT FROM b.wall_type AND a.uuid < b.uuid AND {_GAP} < 5 AND least({_TURN}, 180 - {_TURN}) < 2.5")


@query("g04_merged_walls", "WITH RECURSIVE " + ", ".join([WALLS, _CHAIN]) + """, e AS (SELECT ch.project_id, component AS chain, ch.n, x, y, x * dx + y * dy AS s FROM ch
 JOIN (SELECT project_id, uuid, x0 AS x, y0 AS y FROM walls UNION ALL SELECT project_id, uuid, x1, y1 FROM walls) w ON w.project_id = ch.project_id AND w.uuid = ch.n
 JOIN (SELECT project_id, uuid, x1 - x0 AS dx, y1 - y0 AS dy FROM walls) f ON f.project_id = ch.project_id AND f.uuid = component)
 SELECT project_id, chain, count(DISTINCT n)::INT AS n, arg_min(x, (s, x, y)) AS x0, arg_min(y, (s, x, y)) AS y0, arg_max(x, (s, x, y)) AS x1, arg_max(y, (s, x, y)) AS y1 FROM e GROUP BY ALL""")
def merged_walls(spark, d):
    """Collinear touching walls of one type as one wall each."""
    return topology.merge_collinear(walls(spark, d), 5.0, ("wall_type",))


@query("g05_interval_union", with_(WALLS, "h AS (SELECT project_id, y0 AS y, least(x0, x1) AS a, greatest(x0, x1) AS b FROM walls WHERE y0 = y1)", "m AS (SELECT *, max(b) OVER (PARTITION BY project_id, y ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM h)", "g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY project_id, y ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM m)") + " SELECT project_id, y, min(a) AS a, max(b) AS b, count(*) AS n FROM g GROUP BY project_id, y, k")
def interval_union(spark, d):
    """Horizontal walls at one height as unions of intervals."""
    h = walls(spark, d).where("y0 = y1").select("project_id", C("y0").alias("y"), F.least("x0", "x1").alias("a"), F.greatest("x0", "x1").alias("b"))
    w = Window.partitionBy("project_id", "y").orderBy("a", "b")
    m = h.withColumn("reach", F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    g = m.withColumn("k", F.sum(F.when(C("reach").isNull() | (C("a") > C("reach")), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("project_id", "y", "k").agg(F.min("a").alias("a"), F.max("b").alias("b"), count().alias("n")).drop("k")


@query("g06_t_snaps")
def t_snaps(spark, d):
    """Spurs that begin 3 beside a wall, snapped onto it, with the cuts that walls get."""
    mx, my = (C("x0") + C("x1")) / 2, (C("y0") + C("y1")) / 2
    spurs = openings(spark, d).select("project_id", "uuid", (mx + 3).alias("x0"), (my + 3).alias("y0"), (mx + 803).alias("x1"), (my + 803).alias("y1"))
    moved, splits = topology.snap_t_junctions(walls(spark, d).select("project_id", "uuid", *SEG).unionByName(spurs), 5.0)
    return splits.select("project_id", "uuid", q(C("x"), 3).alias("x"), q(C("y"), 3).alias("y"))


@query("g07_planar_parts", with_(WALLS, "c AS (SELECT DISTINCT w.project_id, w.uuid, w.x0, w.y0, v.x, v.y FROM walls w JOIN (SELECT project_id, x0 AS x, y0 AS y FROM walls UNION SELECT project_id, x1, y1 FROM walls) v ON v.project_id = w.project_id AND v.x BETWEEN least(w.x0, w.x1) AND greatest(w.x0, w.x1) AND v.y BETWEEN least(w.y0, w.y1) AND greatest(w.y0, w.y1) WHERE w.x0 = w.x1 OR w.y0 = w.y1)", "o AS (SELECT project_id, x, y, lead(x) OVER (PARTITION BY project_id, uuid ORDER BY abs(x - x0) + abs(y - y0)) AS nx, lead(y) OVER (PARTITION BY project_id, uuid ORDER BY abs(x - x0) + abs(y - y0)) AS ny FROM c)") + " SELECT DISTINCT project_id, least(x, nx) AS x0, CASE WHEN x <= nx AND NOT (x = nx AND y > ny) THEN y ELSE ny END AS y0, greatest(x, nx) AS x1, CASE WHEN x <= nx AND NOT (x = nx AND y > ny) THEN ny ELSE y END AS y1 FROM o WHERE nx IS NOT NULL AND (x <> nx OR y <> ny)")
def planar_parts(spark, d):
    return topology.planar_parts(walls(spark, d))


@query("g08_graph_nodes", with_(WALLS, "e AS (SELECT DISTINCT project_id, CASE WHEN (x0, y0) <= (x1, y1) THEN (x0, y0, x1, y1) ELSE (x1, y1, x0, y0) END AS k FROM walls)", "n AS (SELECT project_id, k[1] AS x, k[2] AS y FROM e UNION ALL SELECT project_id, k[3], k[4] FROM e)") + " SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY x, y) - 1 AS id, x, y, count(*) AS degree FROM n GROUP BY project_id, x, y")
def graph_nodes(spark, d):
    return topology.graph_of(topology.planar_parts(walls(spark, d)))[0]


def _faces(spark, d) -> DataFrame:
    return topology.faces(*topology.graph_of(topology.planar_parts(walls(spark, d))))


@query("g09_faces", with_(SPACES, SIDES) + f" SELECT project_id, {sq('(max(x0) - min(x0)) * (max(y0) - min(y0))', 1)} AS area, min(x0) AS min_x, min(y0) AS min_y FROM sides GROUP BY project_id, uuid")
def faces(spark, d):
    """Faces of the walls' planar graph; in these drawings they are the spaces."""
    return _faces(spark, d).select("project_id", q(C("area"), 1).alias("area"), "min_x", "min_y")


@query("g09_pruned_edges")
def pruned_edges(spark, d):
    """Edges on no dangling chain."""
    e = edges(spark, d).where("from_id <> to_id").select("project_id", F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b")).distinct()
    return prune(e)


# Validation


@query("v06_typed_references", with_(OPENINGS, SPACES, WALLS, "reg AS (SELECT project_id, uuid, 'wall' AS kind FROM walls UNION ALL SELECT project_id, uuid, lower(category) FROM openings UNION ALL SELECT project_id, uuid, 'space' FROM spaces)", "refs AS (SELECT DISTINCT project_id, uuid, 'wall' AS want, lower(trim(r)) AS r FROM (SELECT project_id, uuid, unnest(related_walls) AS r FROM core_spaces) UNION SELECT DISTINCT project_id, uuid, 'door', lower(trim(r)) FROM (SELECT project_id, uuid, unnest(related_doors) AS r FROM core_spaces) UNION SELECT DISTINCT project_id, uuid, 'window', lower(trim(r)) FROM (SELECT project_id, uuid, unnest(related_windows) AS r FROM core_spaces))") + " SELECT want, CASE WHEN g.uuid IS NULL THEN 'orphan' WHEN g.kind <> want THEN 'wrong_kind' ELSE 'ok' END AS result, count(*) AS n FROM refs LEFT JOIN reg g ON g.project_id = refs.project_id AND g.uuid = r WHERE r <> '' GROUP BY ALL")
def typed_references(spark, d):
    """References by kind: found, missing, or of another kind."""
    s = table(spark, d, "core_spaces")
    lists = F.array(*[F.struct(F.lit(w).alias("want"), C(f).alias("l")) for w, f in (("wall", "related_walls"), ("door", "related_doors"), ("window", "related_windows"))])
    refs = s.select("project_id", "uuid", F.explode(lists).alias("x")).select("project_id", "uuid", "x.want", F.explode("x.l").alias("r")).select("project_id", "uuid", "want", reference_key(C("r")).alias("r")).where("r IS NOT NULL").distinct()
    one = lambda df, kind: df.select("project_id", C("uuid").alias("r"), kind.alias("kind"))
    reg = one(walls(spark, d), F.lit("wall")).unionByName(one(openings(spark, d), F.lower("category"))).unionByName(one(spaces(spark, d), F.lit("space")))
    result = F.when(C("kind").isNull(), "orphan").when(C("kind") != C("want"), "wrong_kind").otherwise("ok")
    return refs.join(reg, ["project_id", "r"], "left").groupBy("want", result.alias("result")).agg(count().alias("n"))


@query("v07_degenerate", with_(WALLS, SPACES) + " SELECT (SELECT count(*) FROM walls WHERE x0 = x1 AND y0 = y1) AS degenerate_walls, (SELECT count(*) FROM spaces WHERE polygon IS NULL OR len(polygon) < 3) AS open_polygons")
def degenerate(spark, d):
    w = walls(spark, d).agg(F.count_if((C("x0") == C("x1")) & (C("y0") == C("y1"))).alias("degenerate_walls"))
    s = spaces(spark, d).agg(F.count_if(C("v").isNull() | (F.size("v") < 3)).alias("open_polygons"))
    return w.crossJoin(F.broadcast(s))  # one row each


@query("v08_unbound", with_(SPACES, OPENINGS, WALLS, _BRIDGE) + " SELECT 'space' AS kind, uuid FROM spaces s WHERE NOT EXISTS (SELECT 1 FROM bridge b WHERE b.project_id = s.project_id AND b.space_uuid = s.uuid) UNION ALL SELECT lower(category), uuid FROM openings o WHERE NOT EXISTS (SELECT 1 FROM walls w WHERE w.project_id = o.project_id AND w.uuid = lower(trim(o.parent_wall)))")
def unbound(spark, d):
    """Spaces without a wall and openings whose wall isn't there."""
    s = spaces(spark, d).select("project_id", "uuid").join(bridge(spark, d).select("project_id", C("space_uuid").alias("uuid")), ["project_id", "uuid"], "left_anti")
    o = openings(spark, d).select("project_id", "uuid", "category", reference_key(C("parent_wall")).alias("w"))
    o = o.join(walls(spark, d).select("project_id", C("uuid").alias("w")), ["project_id", "w"], "left_anti")
    return s.select(F.lit("space").alias("kind"), "uuid").unionByName(o.select(F.lower("category").alias("kind"), "uuid"))


@query("v09_grades", with_(NODES, EDGES, _DEG, "r AS (SELECT project_id, avg((declared = degree)::INT::DOUBLE) AS r FROM deg WHERE declared IS NOT NULL GROUP BY project_id)") + f" SELECT project_id, {sq('r', 6)} AS rate, CASE WHEN r >= 0.995 THEN 'A' WHEN r >= 0.99 THEN 'B' WHEN r >= 0.985 THEN 'C' ELSE 'F' END AS grade FROM r")
def grades(spark, d):
    r = degrees(spark, d).where("declared IS NOT NULL").groupBy("project_id").agg(F.avg((C("declared") == C("degree")).cast("double")).alias("r"))
    return r.select("project_id", q(C("r"), 6).alias("rate"), F.when(C("r") >= 0.995, "A").when(C("r") >= 0.99, "B").when(C("r") >= 0.985, "C").otherwise("F").alias("grade"))


# Composites


_STRUCT = "st AS (SELECT project_id, source_id AS n, min_x, min_y, max_x, max_y FROM audit WHERE audit_role = 'structural')"
_REG = recursive("rg", "SELECT project_id, n FROM st", "SELECT a.project_id, a.n AS a, b.n AS b FROM st a JOIN st b ON a.project_id = b.project_id AND a.n < b.n AND a.min_x - 500 <= b.max_x AND a.max_x + 500 >= b.min_x AND a.min_y - 500 <= b.max_y AND a.max_y + 500 >= b.min_y")


def regions(spark, d) -> DataFrame:
    """project_id, region, n, box of groups of structural entities that come within 500 of each other."""
    from gridloom.session import Scratch

    st = Scratch(spark, "regions").save(audit(spark, d).where("audit_role = 'structural'").select("project_id", "source_id", "min_x", "min_y", "max_x", "max_y"))
    p = box_join(st, st, ["project_id"], 5000.0, 500.0).where("source_id < r_source_id")
    cc = components(st, p.select("project_id", C("source_id").alias("a"), C("r_source_id").alias("b")), ["project_id", "source_id"], "region")
    return st.join(cc, ["project_id", "source_id"]).groupBy("project_id", "region").agg(count().alias("n"), F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"))


@query("c02_regions", "WITH RECURSIVE " + ", ".join([AUDIT, _STRUCT, _REG]) + " SELECT rg.project_id, component AS region, count(*) AS n, min(min_x) AS min_x, min(min_y) AS min_y, max(max_x) AS max_x, max(max_y) AS max_y FROM rg JOIN st ON st.project_id = rg.project_id AND st.n = rg.n GROUP BY ALL")
def c02(spark, d):
    return regions(spark, d)


_RECT = """SELECT project_id, source_id, row_number() OVER (PARTITION BY project_id ORDER BY min_x, min_y, max_x, max_y, source_id) AS pid, (min_x + max_x) / 2 AS x, (min_y + max_y) / 2 AS y, max_x - min_x AS w, max_y - min_y AS h
 FROM audit WHERE audit_role = 'structural' AND is_closed AND entity_type IN ('LWPOLYLINE', 'POLYLINE') AND max_x - min_x >= 500 AND max_y - min_y >= 500"""


@query("c04_frame_groups", f"WITH RECURSIVE {AUDIT}, " + leaders_sql("fr", _RECT, "abs(l.x - r.x) <= 1 AND abs(l.y - r.y) <= 1 AND abs(l.w - r.w) <= 50 AND abs(l.h - r.h) <= 50") + """, g AS (SELECT f.project_id, first_leader AS first, count(*) AS n, arg_min(source_id, (-(w * h), r.pid)) AS outer_id FROM fr f JOIN fr_r r ON r.project_id = f.project_id AND r.pid = f.pid GROUP BY ALL)
 SELECT g.project_id, r.source_id AS first_id, n, outer_id, n >= 3 AS is_frame FROM g JOIN fr_r r ON r.project_id = g.project_id AND r.pid = g.first""")
def frame_groups(spark, d):
    """Closed outlines of at least 500 in groups about one centre (to 1) and of one size (to 50), as
    against the first of each group in the order of their boxes; three make a frame, whose outline is
    the largest."""
    from gridloom.session import Scratch

    w, h = C("max_x") - C("min_x"), C("max_y") - C("min_y")
    box = ["min_x", "min_y", "max_x", "max_y"]
    f = audit(spark, d).where((C("audit_role") == "structural") & C("is_closed") & C("entity_type").isin("LWPOLYLINE", "POLYLINE") & (w >= 500) & (h >= 500))
    f = ranked(f.select("project_id", "source_id", *box), ["project_id"], [*box, "source_id"], "pid")
    f = Scratch(spark, "frames").save(f.select("project_id", "source_id", "pid", ((C("min_x") + C("max_x")) / 2).alias("x"), ((C("min_y") + C("max_y")) / 2).alias("y"), w.alias("w"), h.alias("h")))
    at = point_box(f, "x", "y")
    near = box_join(at, at, ["project_id"], 1000.0, 1.0).where((C("r_pid") < C("pid")) & (F.abs(C("w") - C("r_w")) <= 50) & (F.abs(C("h") - C("r_h")) <= 50))
    near = near.select("project_id", C("r_pid").alias("a"), C("pid").alias("b"))
    lead = first_leaders(f, near, ["project_id", "pid"])
    first = near.join(lead.where("is_leader").select("project_id", C("pid").alias("a")), ["project_id", "a"], "left_semi").groupBy("project_id", C("b").alias("pid")).agg(F.min("a").alias("first"))
    of = lead.join(first, ["project_id", "pid"], "left").select("project_id", "pid", F.when(C("is_leader"), C("pid")).otherwise(C("first")).alias("first"))
    g = f.join(of, ["project_id", "pid"]).groupBy("project_id", "first").agg(count().alias("n"), F.min_by("source_id", F.struct(-(C("w") * C("h")), "pid")).alias("outer_id"))
    named = f.select("project_id", C("pid").alias("first"), C("source_id").alias("first_id"))
    return g.join(named, ["project_id", "first"]).select("project_id", "first_id", "n", "outer_id", (C("n") >= 3).alias("is_frame"))


@query("c08_opening_intervals", with_(WALLS, OPENINGS, "p AS (SELECT o.uuid, w.uuid AS wall, sqrt((w.x1 - w.x0) * (w.x1 - w.x0) + (w.y1 - w.y0) * (w.y1 - w.y0)) AS len, ((o.x0 - w.x0) * (w.x1 - w.x0) + (o.y0 - w.y0) * (w.y1 - w.y0)) / ((w.x1 - w.x0) * (w.x1 - w.x0) + (w.y1 - w.y0) * (w.y1 - w.y0)) AS t0, ((o.x1 - w.x0) * (w.x1 - w.x0) + (o.y1 - w.y0) * (w.y1 - w.y0)) / ((w.x1 - w.x0) * (w.x1 - w.x0) + (w.y1 - w.y0) * (w.y1 - w.y0)) AS t1 FROM openings o JOIN walls w ON w.project_id = o.project_id AND w.uuid = lower(trim(o.parent_wall)))", "c AS (SELECT uuid, wall, greatest(0, least(1, least(t0, t1))) * len AS a, greatest(0, least(1, greatest(t0, t1))) * len AS b FROM p)") + f" SELECT uuid, wall, {sq('a', 3)} AS from_mm, {sq('b', 3)} AS to_mm FROM c WHERE b - a > 0.1")
def opening_intervals(spark, d):
    """The part of its wall that each opening takes."""
    w = walls(spark, d).select("project_id", C("uuid").alias("wall"), *[C(c).alias(f"w_{c}") for c in SEG])
    o = openings(spark, d).withColumn("wall", reference_key(C("parent_wall"))).join(w, ["project_id", "wall"])
    wall = [C(f"w_{c}") for c in SEG]
    clamp = lambda t: F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    o = o.withColumns({"t0": scalar.along(C("x0"), C("y0"), *wall), "t1": scalar.along(C("x1"), C("y1"), *wall), "len": scalar.dist(*wall)})
    o = o.withColumns({"a": clamp(F.least("t0", "t1")) * C("len"), "b": clamp(F.greatest("t0", "t1")) * C("len")}).where("b - a > 0.1")
    return o.select("uuid", "wall", q(C("a"), 3).alias("from_mm"), q(C("b"), 3).alias("to_mm"))


@query("c09_model", with_(SPACES, _BRIDGE) + " SELECT s.project_id, s.uuid, coalesce((SELECT list_sort(list(wall_uuid)) FROM bridge b WHERE b.project_id = s.project_id AND b.space_uuid = s.uuid), []) AS related_walls FROM spaces s")
def model(spark, d):
    """Spaces with their walls as sorted lists; a list holds one space's walls."""
    b = bridge(spark, d).groupBy("project_id", C("space_uuid").alias("uuid")).agg(F.sort_array(F.collect_set("wall_uuid")).alias("w"))
    s = spaces(spark, d).select("project_id", "uuid").join(b, ["project_id", "uuid"], "left")
    return s.select("project_id", "uuid", F.coalesce("w", F.expr("CAST(array() AS array<string>)")).alias("related_walls"))


@query("c10_open_end_kinds", with_(NODES, EDGES, _DANGLING, "x AS (SELECT e.*, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM edges e JOIN nodes a ON a.project_id = e.project_id AND a.node_id = from_id JOIN nodes b ON b.project_id = e.project_id AND b.node_id = to_id)", "k AS (SELECT g.project_id, g.node_id, (SELECT count(*) FROM dangling o WHERE o.project_id = g.project_id AND o.node_id <> g.node_id AND sqrt((o.x - g.x) * (o.x - g.x) + (o.y - g.y) * (o.y - g.y)) < 1500) AS ends, (SELECT count(*) FROM nodes o WHERE o.project_id = g.project_id AND o.node_id <> g.node_id AND sqrt((o.x - g.x) * (o.x - g.x) + (o.y - g.y) * (o.y - g.y)) < 1500) AS any_node FROM dangling g)") + " SELECT project_id, node_id, CASE WHEN ends > 0 THEN 'endpoint' WHEN any_node > 0 THEN 'junction' ELSE 'unresolved' END AS kind FROM k")
def open_end_kinds(spark, d):
    """What an open end could be joined to within 1500: another end, a junction, nothing."""
    g = dangling(spark, d).select("project_id", "node_id", "x", "y")
    n = nodes(spark, d).dropna(subset=["x", "y"]).select("project_id", "node_id", "x", "y")
    n = n.join(g.select("project_id", "node_id", F.lit(True).alias("open")), ["project_id", "node_id"], "left")
    p = box_join(point_box(g, "x", "y"), point_box(n, "x", "y"), ["project_id"], 5000.0, 1500.0)
    p = p.where((C("node_id") != C("r_node_id")) & (scalar.dist(C("x"), C("y"), C("r_x"), C("r_y")) < 1500))
    k = p.groupBy("project_id", "node_id").agg(F.count_if(F.coalesce("r_open", F.lit(False))).alias("ends"), count().alias("any_node"))
    kind = F.when(C("ends") > 0, "endpoint").when(C("any_node") > 0, "junction").otherwise("unresolved")
    return g.join(k, ["project_id", "node_id"], "left").select("project_id", "node_id", kind.alias("kind"))
