"""Spatial and relational joins on the drawing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import arrays, scalar
from gridloom.functions.scalar import q
from gridloom.operators import matching
from gridloom.operators.orphans import reference_key
from gridloom.operators.spatial import best, box_join, nearest, point_box, with_box
from gridloom.plans.base import AUDIT, EDGES, NODES, OPENINGS, SIDES, SPACES, WALLS, audit, edges, nodes, openings, space_sides, spaces, sq, walls, with_
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
#: Cells of about a room.
CELL = 5_000.0
_LEN = "sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))"
_WB = "wb AS (SELECT project_id, uuid, x0, y0, x1, y1, least(x0, x1) AS ax, least(y0, y1) AS ay, greatest(x0, x1) AS bx, greatest(y0, y1) AS b_y FROM walls)"


def _mid(df: DataFrame) -> DataFrame:
    return df.withColumns({"x": (C("x0") + C("x1")) / 2, "y": (C("y0") + C("y1")) / 2})


@query("j01_box_pairs", with_(WALLS, _WB) + " SELECT a.uuid AS a, b.uuid AS b FROM wb a JOIN wb b ON a.project_id = b.project_id AND a.uuid < b.uuid AND a.ax - 100 <= b.bx AND a.bx + 100 >= b.ax AND a.ay - 100 <= b.b_y AND a.b_y + 100 >= b.ay")
def box_pairs(spark, d):
    """Walls whose boxes come within 100 of each other."""
    w = with_box(walls(spark, d).select("project_id", "uuid", *SEG))
    return box_join(w, w, ["project_id"], CELL, 100.0).where("uuid < r_uuid").select(C("uuid").alias("a"), C("r_uuid").alias("b"))


_T = "((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))"


def _sql_nearest(points: str, tol: float, own: str, cond: str) -> str:
    return with_(WALLS, points, f"pr AS (SELECT p.project_id, pid, px, py, w.uuid AS wall, x0, y0, x1, y1, {_T} AS t FROM pts p JOIN walls w ON p.project_id = w.project_id AND {own} AND px >= least(x0, x1) - {tol} AND px <= greatest(x0, x1) + {tol} AND py >= least(y0, y1) - {tol} AND py <= greatest(y0, y1) + {tol} WHERE (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) >= 1e-10)", "f AS (SELECT *, x0 + t * (x1 - x0) AS fx, y0 + t * (y1 - y0) AS fy FROM pr)", "dd AS (SELECT *, sqrt((px - fx) * (px - fx) + (py - fy) * (py - fy)) AS d FROM f)", f"rk AS (SELECT *, row_number() OVER (PARTITION BY project_id, pid ORDER BY d, fx, fy, wall) AS n FROM dd WHERE {cond})")


@query("j03_projected", _sql_nearest(OPENINGS + ", pts AS (SELECT project_id, uuid AS pid, (x0 + x1) / 2 + 7 AS px, (y0 + y1) / 2 + 3 AS py FROM openings)", 50, "true", "t > 0.001 AND t < 0.999 AND d > 1e-4 AND d < 50") + f" SELECT pid, wall AS wall_uuid, {sq('t', 6)} AS t, {sq('d', 4)} AS d FROM rk WHERE n = 1")
def projected(spark, d):
    """Points beside openings, projected onto the wall whose inside they meet first."""
    p = _mid(openings(spark, d)).select("project_id", C("uuid").alias("pid"), (C("x") + 7).alias("x"), (C("y") + 3).alias("y"))
    got = matching.project_nearest(p, walls(spark, d), 50.0, CELL)
    return got.select("pid", "wall_uuid", q(C("t"), 6).alias("t"), q(C("d"), 4).alias("d"))


_CROSS = "cr AS (SELECT a.project_id, a.uuid AS a, b.uuid AS b, a.x0, a.y0, a.x1, a.y1, (a.x1 - a.x0) * (b.y1 - b.y0) - (a.y1 - a.y0) * (b.x1 - b.x0) AS det, ((b.x0 - a.x0) * (b.y1 - b.y0) - (b.y0 - a.y0) * (b.x1 - b.x0)) AS tn, ((b.x0 - a.x0) * (a.y1 - a.y0) - (b.y0 - a.y0) * (a.x1 - a.x0)) AS un FROM walls a JOIN walls b ON a.project_id = b.project_id AND a.uuid < b.uuid AND least(a.x0, a.x1) <= greatest(b.x0, b.x1) AND greatest(a.x0, a.x1) >= least(b.x0, b.x1) AND least(a.y0, a.y1) <= greatest(b.y0, b.y1) AND greatest(a.y0, a.y1) >= least(b.y0, b.y1))"


@query("j05_crossings", with_(WALLS, _CROSS) + f" SELECT a, b, {sq('x0 + tn / det * (x1 - x0)', 3)} AS x, {sq('y0 + tn / det * (y1 - y0)', 3)} AS y FROM cr WHERE det <> 0 AND tn / det BETWEEN 0 AND 1 AND un / det BETWEEN 0 AND 1")
def crossing_points(spark, d):
    got = matching.crossings(walls(spark, d), CELL)
    return got.select("a", "b", q(C("x"), 3).alias("x"), q(C("y"), 3).alias("y"))


@query("j06_edge_faces", with_(SPACES, SIDES, "k AS (SELECT project_id, uuid, least(x0, x1) AS ax, least(y0, y1) AS ay, greatest(x0, x1) AS bx, greatest(y0, y1) AS b_y FROM sides)") + " SELECT project_id, ax, ay, bx, b_y, count(DISTINCT uuid) AS n_faces, min(uuid) AS first_face FROM k GROUP BY ALL")
def edge_faces(spark, d):
    """The faces on each side, by the side's undirected coordinates."""
    k = with_box(space_sides(spark, d)).select("project_id", "uuid", C("min_x").alias("ax"), C("min_y").alias("ay"), C("max_x").alias("bx"), C("max_y").alias("b_y")).distinct()
    return k.groupBy("project_id", "ax", "ay", "bx", "b_y").agg(F.count(F.lit(1)).alias("n_faces"), F.min("uuid").alias("first_face"))


@query("j07_edge_ends", with_(NODES, EDGES) + " SELECT e.project_id, edge_id, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM edges e JOIN nodes a ON a.project_id = e.project_id AND a.node_id = from_id JOIN nodes b ON b.project_id = e.project_id AND b.node_id = to_id")
def edge_ends(spark, d):
    n = nodes(spark, d)
    a = n.select("project_id", C("node_id").alias("from_id"), C("x").alias("x0"), C("y").alias("y0"))
    b = n.select("project_id", C("node_id").alias("to_id"), C("x").alias("x1"), C("y").alias("y1"))
    return edges(spark, d).join(a, ["project_id", "from_id"]).join(b, ["project_id", "to_id"]).select("project_id", "edge_id", *SEG)


def _pt(px: str, py: str, s: str) -> str:
    """Distance of a point from a segment of alias s, in SQL."""
    x0, y0, x1, y1 = (f"{s}.{c}" for c in SEG)
    t = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN ({x1} - {x0}) * ({x1} - {x0}) + ({y1} - {y0}) * ({y1} - {y0}) < 1e-10 THEN 0.0::DOUBLE ELSE (({px} - {x0}) * ({x1} - {x0}) + ({py} - {y0}) * ({y1} - {y0})) / (({x1} - {x0}) * ({x1} - {x0}) + ({y1} - {y0}) * ({y1} - {y0})) END))"
    fx, fy = f"({px} - ({x0} + {t} * ({x1} - {x0})))", f"({py} - ({y0} + {t} * ({y1} - {y0})))"
    return f"sqrt({fx} * {fx} + {fy} * {fy})"


_FLAGS = with_(WALLS, OPENINGS, f"""c AS (SELECT o.project_id, o.uuid, w.uuid AS wall,
 (o.x1 - o.x0) * (w.y1 - w.y0) - (o.y1 - o.y0) * (w.x1 - w.x0) AS det,
 (w.x0 - o.x0) * (w.y1 - w.y0) - (w.y0 - o.y0) * (w.x1 - w.x0) AS tn, (w.x0 - o.x0) * (o.y1 - o.y0) - (w.y0 - o.y0) * (o.x1 - o.x0) AS un,
 least({_pt('o.x0', 'o.y0', 'w')}, {_pt('o.x1', 'o.y1', 'w')}, {_pt('w.x0', 'w.y0', 'o')}, {_pt('w.x1', 'w.y1', 'o')}) AS ends,
 abs((o.x1 - o.x0) * (w.x1 - w.x0) + (o.y1 - o.y0) * (w.y1 - w.y0)) / (sqrt((o.x1 - o.x0) * (o.x1 - o.x0) + (o.y1 - o.y0) * (o.y1 - o.y0)) * sqrt((w.x1 - w.x0) * (w.x1 - w.x0) + (w.y1 - w.y0) * (w.y1 - w.y0))) AS c
 FROM openings o JOIN walls w ON o.project_id = w.project_id AND least(o.x0, o.x1) - 50 <= greatest(w.x0, w.x1) AND greatest(o.x0, o.x1) + 50 >= least(w.x0, w.x1) AND least(o.y0, o.y1) - 50 <= greatest(w.y0, w.y1) AND greatest(o.y0, o.y1) + 50 >= least(w.y0, w.y1))""",
 "g AS (SELECT project_id, uuid, min((CASE WHEN det <> 0 AND tn / nullif(det, 0) BETWEEN 0 AND 1 AND un / nullif(det, 0) BETWEEN 0 AND 1 THEN 0.0::DOUBLE ELSE ends END, wall)) AS b, bool_or(c > cos(radians(15))) AS parallel, bool_or(c < cos(radians(75))) AS perpendicular FROM c GROUP BY ALL)")


@query("j08_nearest_flags", _FLAGS + f" SELECT o.uuid, g.b[2] AS wall_uuid, {sq('g.b[1]', 3)} AS distance, parallel, perpendicular FROM openings o LEFT JOIN g ON g.project_id = o.project_id AND g.uuid = o.uuid")
def nearest_flags(spark, d):
    got = matching.nearest_flags(openings(spark, d), walls(spark, d), 50.0, CELL)
    return got.select("uuid", "wall_uuid", q(C("distance"), 3).alias("distance"), "parallel", "perpendicular")


_HINT = "coalesce(contains(lower(o.layer), 'kapı') OR contains(lower(o.layer), 'kapi') OR contains(lower(o.layer), 'door'), false) AS dl, coalesce(contains(lower(o.layer), 'pencere') OR contains(lower(o.layer), 'window'), false) AS wl"
_RULES = "r AS (SELECT *, CASE WHEN near AND sized AND per THEN ('Door', 0.85::DOUBLE) WHEN near AND sized AND par AND wl THEN ('Window', 0.9) WHEN near AND sized AND par AND dl THEN ('Door', 0.9) WHEN near AND sized THEN ('Unknown', 0.5) WHEN near AND len > 400 AND par THEN ('Unknown', 0.6) WHEN near AND len > 400 THEN ('Unknown', 0.5) ELSE ('Unknown', 1.0) END AS k FROM f)"


@query("fn23_element_kinds", _FLAGS + f", f AS (SELECT o.uuid, o.width / 4 AS len, {_HINT}, coalesce(g.b[1] < 50, false) AS near, o.width / 4 BETWEEN 40 AND 400 AS sized, coalesce(parallel, false) AS par, coalesce(perpendicular, false) AS per FROM openings o LEFT JOIN g ON g.project_id = o.project_id AND g.uuid = o.uuid), " + _RULES + " SELECT uuid, CASE WHEN k[1] = 'Unknown' AND dl THEN 'Door' WHEN k[1] = 'Unknown' AND wl THEN 'Window' ELSE k[1] END AS kind, CASE WHEN k[1] = 'Unknown' AND (dl OR wl) THEN 0.6 ELSE k[2] END::DOUBLE AS confidence FROM r")
def element_kinds(spark, d):
    """Kinds of elements by the ordered rules on distance, direction, size and layer."""
    o = openings(spark, d)
    flags = matching.nearest_flags(o, walls(spark, d), 50.0, CELL).join(o.select("project_id", "uuid", "layer", "width"), ["project_id", "uuid"])
    low = F.lower("layer")
    got = matching.element_rules(flags, F.coalesce(scalar.has_any(low, ("kapı", "kapi", "door")), F.lit(False)), F.coalesce(scalar.has_any(low, ("pencere", "window")), F.lit(False)), C("width") / 4, F.lit(False))
    return got.select("uuid", "kind", "confidence")


@query("j09_space_walls", with_(WALLS, SPACES, SIDES, f"c AS (SELECT s.project_id, s.uuid, s.pos, w.uuid AS wall, {_pt('((s.x0 + s.x1) / 2)', '((s.y0 + s.y1) / 2)', 'w')} AS d FROM sides s JOIN walls w ON s.project_id = w.project_id AND (s.x0 + s.x1) / 2 BETWEEN least(w.x0, w.x1) - 150 AND greatest(w.x0, w.x1) + 150 AND (s.y0 + s.y1) / 2 BETWEEN least(w.y0, w.y1) - 150 AND greatest(w.y0, w.y1) + 150)", "r AS (SELECT *, row_number() OVER (PARTITION BY project_id, uuid, pos ORDER BY d, wall) AS n FROM c WHERE d < 150)") + " SELECT DISTINCT project_id, uuid AS space_uuid, wall AS wall_uuid FROM r WHERE n = 1")
def space_walls(spark, d):
    """The walls that bound each space: nearest to the middle of one of its sides."""
    s = point_box(_mid(space_sides(spark, d)), "x", "y")
    pairs = box_join(s, with_box(walls(spark, d).select("project_id", "uuid", *SEG)), ["project_id"], CELL, 150.0)
    pairs = pairs.withColumn("d", scalar.to_segment(C("x"), C("y"), *matching.cols(matching.B))).where("d < 150")
    got = best(pairs, ["project_id", "uuid", "pos"], [C("d"), C("r_uuid")], ["r_uuid"])
    return got.select("project_id", C("uuid").alias("space_uuid"), C("r_uuid").alias("wall_uuid")).distinct()


_DANGLING = "deg AS (SELECT project_id, n, count(*) AS k FROM (SELECT project_id, from_id AS n FROM edges UNION ALL SELECT project_id, to_id FROM edges) GROUP BY ALL), dangling AS (SELECT nodes.* FROM nodes JOIN deg ON deg.project_id = nodes.project_id AND deg.n = node_id WHERE k = 1)"


def dangling(spark, d) -> DataFrame:
    """Nodes with one edge end."""
    e = edges(spark, d)
    deg = e.select("project_id", C("from_id").alias("node_id")).unionAll(e.select("project_id", "to_id")).groupBy("project_id", "node_id").agg(F.count(F.lit(1)).alias("k"))
    return nodes(spark, d).join(deg.where("k = 1").select("project_id", "node_id"), ["project_id", "node_id"])


@query("j10_gap_pairs", with_(NODES, EDGES, _DANGLING) + f" SELECT a.project_id, a.node_id AS a, b.node_id AS b, {sq('sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))', 3)} AS gap FROM dangling a JOIN dangling b ON a.project_id = b.project_id AND a.node_id < b.node_id WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) > 10 AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 4000")
def gap_pairs(spark, d):
    """Open ends that a gap of more than 10 and at most 4000 parts."""
    n = point_box(dangling(spark, d).select("project_id", "node_id", "x", "y"), "x", "y")
    gap = scalar.dist(C("x"), C("y"), C("r_x"), C("r_y"))
    pairs = box_join(n, n, ["project_id"], CELL, 4000.0).where("node_id < r_node_id").withColumn("gap", gap)
    return pairs.where("gap > 10 AND gap <= 4000").select("project_id", C("node_id").alias("a"), C("r_node_id").alias("b"), q(C("gap"), 3).alias("gap"))


@query("j11_walls_by_ends", with_(WALLS, SPACES, SIDES) + " SELECT s.project_id, s.uuid AS space_uuid, s.pos, min(w.uuid) AS wall_uuid FROM sides s JOIN walls w ON s.project_id = w.project_id AND ((abs(s.x0 - w.x0) < 1 AND abs(s.y0 - w.y0) < 1 AND abs(s.x1 - w.x1) < 1 AND abs(s.y1 - w.y1) < 1) OR (abs(s.x0 - w.x1) < 1 AND abs(s.y0 - w.y1) < 1 AND abs(s.x1 - w.x0) < 1 AND abs(s.y1 - w.y0) < 1)) GROUP BY ALL")
def walls_by_ends(spark, d):
    """The wall with the same ends as a side, in either sense, to within 1."""
    pairs = box_join(with_box(space_sides(spark, d)), with_box(walls(spark, d).select("project_id", "uuid", *SEG)), ["project_id"], CELL, 1.0)
    near = lambda a, b: F.abs(C(a) - C(b)) < 1
    same = near("x0", "r_x0") & near("y0", "r_y0") & near("x1", "r_x1") & near("y1", "r_y1")
    turned = near("x0", "r_x1") & near("y0", "r_y1") & near("x1", "r_x0") & near("y1", "r_y0")
    return pairs.where(same | turned).groupBy("project_id", C("uuid").alias("space_uuid"), "pos").agg(F.min("r_uuid").alias("wall_uuid"))


@query("j12_references", with_(WALLS, OPENINGS, "k AS (SELECT project_id, uuid AS r, uuid, wall_id FROM walls UNION ALL SELECT project_id, wall_id::VARCHAR, uuid, wall_id FROM walls)", "l AS (SELECT project_id, r, arg_max(uuid, (wall_id, uuid)) AS uuid FROM k GROUP BY ALL)") + " SELECT o.uuid, l.uuid AS wall_uuid FROM openings o JOIN l ON l.project_id = o.project_id AND l.r = lower(trim(o.parent_wall))")
def references(spark, d):
    """Parent walls by any of a wall's keys, uuid or number as text; the last writer wins."""
    w = walls(spark, d)
    keys = F.explode(F.array(C("uuid"), C("wall_id").cast("string")))
    known = w.select("project_id", keys.alias("key"), "uuid", "wall_id").groupBy("project_id", "key").agg(F.max_by("uuid", F.struct("wall_id", "uuid")).alias("wall_uuid"))
    o = openings(spark, d).select("project_id", "uuid", reference_key(C("parent_wall")).alias("key"))
    return o.join(known, ["project_id", "key"]).select("uuid", "wall_uuid")


_J13 = with_(WALLS, OPENINGS, f"n AS (SELECT o.project_id, o.uuid, w.uuid AS wall, row_number() OVER (PARTITION BY o.project_id, o.uuid ORDER BY {_pt('((o.x0 + o.x1) / 2)', '((o.y0 + o.y1) / 2)', 'w')}, w.uuid) AS n FROM openings o JOIN walls w ON o.project_id = w.project_id AND {_pt('((o.x0 + o.x1) / 2)', '((o.y0 + o.y1) / 2)', 'w')} < 10)")


@query("j13_parent_walls", _J13 + " SELECT o.uuid, coalesce(w.uuid, n.wall, o.parent_wall) AS parent_wall, CASE WHEN w.uuid IS NOT NULL THEN 'key' WHEN n.wall IS NOT NULL THEN 'nearest' WHEN o.parent_wall IS NOT NULL THEN 'kept' ELSE 'none' END AS how FROM openings o LEFT JOIN walls w ON w.project_id = o.project_id AND w.uuid = lower(trim(o.parent_wall)) LEFT JOIN n ON n.project_id = o.project_id AND n.uuid = o.uuid AND n.n = 1")
def parent_walls(spark, d):
    """Parent by key, else the nearest wall within 10 of the middle, else the reference as it stands."""
    o, w = openings(spark, d), walls(spark, d)
    p = _mid(o).select("project_id", C("uuid").alias("pid"), "x", "y")
    pairs = box_join(point_box(p, "x", "y"), with_box(w.select("project_id", "uuid", *SEG)), ["project_id"], CELL, 10.0)
    pairs = pairs.withColumn("d", scalar.to_segment(C("x"), C("y"), *matching.cols(matching.B))).where("d < 10")
    near = best(pairs, ["project_id", "pid"], [C("d"), C("r_uuid")], ["r_uuid"]).select("project_id", C("pid").alias("uuid"), C("r_uuid").alias("near"))
    known = w.select("project_id", C("uuid").alias("key"), C("uuid").alias("found"))
    got = o.withColumn("key", reference_key(C("parent_wall"))).join(known, ["project_id", "key"], "left").join(near, ["project_id", "uuid"], "left")
    how = F.when(C("found").isNotNull(), "key").when(C("near").isNotNull(), "nearest").when(C("parent_wall").isNotNull(), "kept").otherwise("none")
    return got.select("uuid", F.coalesce("found", "near", "parent_wall").alias("parent_wall"), how.alias("how"))


_BRIDGE = "bridge AS (SELECT DISTINCT project_id, uuid AS space_uuid, lower(trim(w)) AS wall_uuid FROM (SELECT project_id, uuid, unnest(related_walls) AS w FROM core_spaces) WHERE trim(coalesce(w, '')) <> '')"


def bridge(spark, d) -> DataFrame:
    """Each space with each wall that it names."""
    s = table(spark, d, "core_spaces").select("project_id", C("uuid").alias("space_uuid"), F.explode("related_walls").alias("w"))
    return s.select("project_id", "space_uuid", reference_key(C("w")).alias("wall_uuid")).where("wall_uuid IS NOT NULL").distinct()


@query("j15_linked_spaces", with_(WALLS, SPACES, SIDES, _BRIDGE, "own AS (SELECT b.* FROM bridge b JOIN walls w ON w.project_id = b.project_id AND w.uuid = b.wall_uuid)", "geo AS (SELECT DISTINCT s.project_id, s.uuid AS space_uuid, w.uuid AS wall_uuid FROM sides s JOIN walls w ON s.project_id = w.project_id AND least(s.x0, s.x1) = least(w.x0, w.x1) AND least(s.y0, s.y1) = least(w.y0, w.y1) AND greatest(s.x0, s.x1) = greatest(w.x0, w.x1) AND greatest(s.y0, s.y1) = greatest(w.y0, w.y1))") + " SELECT *, 'named' AS how FROM own UNION ALL SELECT *, 'sides' FROM geo g WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.project_id = g.project_id AND o.space_uuid = g.space_uuid)")
def linked_spaces(spark, d):
    """Walls that a space names and that exist; for spaces without one, those along its sides."""
    w = walls(spark, d)
    own = bridge(spark, d).join(w.select("project_id", C("uuid").alias("wall_uuid")), ["project_id", "wall_uuid"]).select("project_id", "space_uuid", "wall_uuid")
    box = ["min_x", "min_y", "max_x", "max_y"]
    geo = with_box(space_sides(spark, d)).select("project_id", C("uuid").alias("space_uuid"), *box).join(with_box(w).select("project_id", C("uuid").alias("wall_uuid"), *box), ["project_id", *box])
    geo = geo.select("project_id", "space_uuid", "wall_uuid").distinct().join(own.select("project_id", "space_uuid").distinct(), ["project_id", "space_uuid"], "left_anti")
    return own.withColumn("how", F.lit("named")).unionByName(geo.withColumn("how", F.lit("sides")))


@query("j16_neighbours", with_(_BRIDGE, "two AS (SELECT project_id, wall_uuid, min(space_uuid) AS a, max(space_uuid) AS b FROM bridge GROUP BY ALL HAVING count(*) = 2)") + " SELECT DISTINCT project_id, a AS space_uuid, b AS neighbor FROM two UNION SELECT project_id, b, a FROM two")
def shared_neighbours(spark, d):
    """Spaces that alone share a wall, both ways."""
    two = bridge(spark, d).groupBy("project_id", "wall_uuid").agg(F.count(F.lit(1)).alias("n"), F.min("space_uuid").alias("a"), F.max("space_uuid").alias("b")).where("n = 2")
    return two.select("project_id", C("a").alias("space_uuid"), C("b").alias("neighbor")).union(two.select("project_id", "b", "a")).distinct()


@query("j17_opening_spaces", with_(OPENINGS, _BRIDGE) + " SELECT o.uuid, b.space_uuid FROM openings o JOIN bridge b ON b.project_id = o.project_id AND b.wall_uuid = lower(trim(o.parent_wall))")
def opening_spaces(spark, d):
    o = openings(spark, d).select("project_id", "uuid", reference_key(C("parent_wall")).alias("wall_uuid"))
    return o.join(bridge(spark, d), ["project_id", "wall_uuid"]).select("uuid", "space_uuid")


@query("j19_sides_by_key", with_(WALLS, SPACES, SIDES) + " SELECT s.uuid AS space_uuid, s.pos, count(w.uuid) AS n_walls FROM sides s LEFT JOIN walls w ON s.project_id = w.project_id AND (CASE WHEN (s.x0, s.y0) <= (s.x1, s.y1) THEN (s.x0, s.y0, s.x1, s.y1) ELSE (s.x1, s.y1, s.x0, s.y0) END) = (CASE WHEN (w.x0, w.y0) <= (w.x1, w.y1) THEN (w.x0, w.y0, w.x1, w.y1) ELSE (w.x1, w.y1, w.x0, w.y0) END) GROUP BY ALL")
def sides_by_key(spark, d):
    """Sides and walls by a key that is the same in either sense."""
    p, r = F.struct(q(C("x0"), 3).alias("x"), q(C("y0"), 3).alias("y")), F.struct(q(C("x1"), 3).alias("x"), q(C("y1"), 3).alias("y"))
    s = space_sides(spark, d).select("project_id", C("uuid").alias("space_uuid"), "pos", F.least(p, r).alias("a"), F.greatest(p, r).alias("b"))
    w = walls(spark, d).select("project_id", "uuid", F.least(p, r).alias("a"), F.greatest(p, r).alias("b"))
    return s.join(w, ["project_id", "a", "b"], "left").groupBy("space_uuid", "pos").agg(F.count("uuid").alias("n_walls"))


@query("j20_nearest_middles", with_(WALLS, OPENINGS, "r AS (SELECT o.uuid, w.uuid AS wall, sqrt(((o.x0 + o.x1) / 2 - (w.x0 + w.x1) / 2) * ((o.x0 + o.x1) / 2 - (w.x0 + w.x1) / 2) + ((o.y0 + o.y1) / 2 - (w.y0 + w.y1) / 2) * ((o.y0 + o.y1) / 2 - (w.y0 + w.y1) / 2)) AS d FROM openings o JOIN walls w USING (project_id))", "k AS (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY d, wall) AS n FROM r)") + f" SELECT uuid, wall AS wall_uuid, {sq('d', 3)} AS d FROM k WHERE n = 1")
def nearest_middles(spark, d):
    """The wall whose middle lies nearest to an opening's, however far."""
    p = _mid(openings(spark, d)).select("project_id", "uuid", "x", "y")
    t = point_box(_mid(walls(spark, d)).select("project_id", C("uuid").alias("wall_uuid"), "x", "y"), "x", "y")
    got = nearest(p, t, ["project_id"], ["uuid"], C("r_wall_uuid"), ["r_wall_uuid"], 2_000.0)
    return got.select("uuid", C("r_wall_uuid").alias("wall_uuid"), q(C("distance"), 3).alias("d"))


_LABEL = "labels AS (SELECT project_id, source_id, (min_x + max_x) / 2 AS x, (min_y + max_y) / 2 AS y FROM audit WHERE audit_role = 'room_label')"


@query("j21_nearest_walls", with_(WALLS, AUDIT, _LABEL, f"c AS (SELECT l.project_id, l.source_id, w.uuid AS wall, {_pt('l.x', 'l.y', 'w')} AS d FROM labels l JOIN walls w ON l.project_id = w.project_id AND l.x BETWEEN least(w.x0, w.x1) - 5000 AND greatest(w.x0, w.x1) + 5000 AND l.y BETWEEN least(w.y0, w.y1) - 5000 AND greatest(w.y0, w.y1) + 5000)", "k AS (SELECT *, row_number() OVER (PARTITION BY project_id, source_id ORDER BY d, wall) AS n FROM c WHERE d <= 5000)") + f" SELECT project_id, source_id, wall AS wall_uuid, {sq('d', 3)} AS d FROM k WHERE n = 1")
def nearest_walls(spark, d):
    """The wall nearest to each room label, at most 5000 away."""
    p = point_box(labels(spark, d), "x", "y")
    pairs = box_join(p, with_box(walls(spark, d).select("project_id", "uuid", *SEG)), ["project_id"], CELL, 5000.0)
    pairs = pairs.withColumn("d", scalar.to_segment(C("x"), C("y"), *matching.cols(matching.B))).where("d <= 5000")
    return best(pairs, ["project_id", "source_id"], [C("d"), C("r_uuid")], ["r_uuid", "d"]).select("project_id", "source_id", C("r_uuid").alias("wall_uuid"), q(C("d"), 3).alias("d"))


def labels(spark, d) -> DataFrame:
    a = audit(spark, d).where("audit_role = 'room_label'")
    return a.select("project_id", "source_id", ((C("min_x") + C("max_x")) / 2).alias("x"), ((C("min_y") + C("max_y")) / 2).alias("y"))


@query("j22_label_spaces", with_(AUDIT, SPACES, SIDES, _LABEL, "b AS (SELECT project_id, uuid, min(x0) AS ax, min(y0) AS ay, max(x0) AS bx, max(y0) AS b_y FROM sides GROUP BY ALL)", "c AS (SELECT l.project_id, l.source_id, b.uuid, sum(CASE WHEN (s.y0 > l.y) <> (s.y1 > l.y) AND l.x < (s.x1 - s.x0) * (l.y - s.y0) / nullif(s.y1 - s.y0, 0) + s.x0 THEN 1 ELSE 0 END) AS k FROM labels l JOIN b ON l.project_id = b.project_id AND l.x BETWEEN ax AND bx AND l.y BETWEEN ay AND b_y JOIN sides s ON s.project_id = b.project_id AND s.uuid = b.uuid GROUP BY ALL)") + " SELECT project_id, source_id, min(uuid) AS space_uuid FROM c WHERE k % 2 = 1 GROUP BY ALL")
def label_spaces(spark, d):
    """The first space that holds a room label."""
    s = spaces(spark, d).select("project_id", "uuid", "v", arrays.bounds(C("v")).alias("b")).select("project_id", "uuid", "v", "b.*")
    pairs = box_join(point_box(labels(spark, d), "x", "y"), s, ["project_id"], CELL)
    return pairs.where(arrays.contains(C("r_v"), C("x"), C("y"))).groupBy("project_id", "source_id").agg(F.min("r_uuid").alias("space_uuid"))


@query("j23_paired_walls", with_(WALLS, "m AS (SELECT *, (x0 + x1) / 2 AS mx, (y0 + y1) / 2 AS my FROM walls)", "p AS (SELECT a.uuid, b.uuid AS other, sqrt((a.mx - b.mx) * (a.mx - b.mx) + (a.my - b.my) * (a.my - b.my)) AS d FROM m a JOIN m b ON a.project_id = b.project_id AND a.uuid <> b.uuid AND least(abs(a.angle - b.angle), 180 - abs(a.angle - b.angle)) <= 5 AND abs(a.mx - b.mx) <= 4000 AND abs(a.my - b.my) <= 4000)", "k AS (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY d, other) AS n FROM p WHERE d > 50 AND d < 4000)") + f" SELECT uuid, other, {sq('d', 3)} AS d FROM k WHERE n = 1")
def paired_walls(spark, d):
    """The nearest other wall of the same direction."""
    m = point_box(_mid(walls(spark, d)).select("project_id", "uuid", "angle", "x", "y"), "x", "y")
    pairs = box_join(m, m, ["project_id"], CELL, 4000.0).where((C("uuid") != C("r_uuid")) & (scalar.folded(C("angle"), C("r_angle")) <= 5))
    pairs = pairs.withColumn("d", scalar.dist(C("x"), C("y"), C("r_x"), C("r_y"))).where("d > 50 AND d < 4000")
    return best(pairs, ["uuid"], [C("d"), C("r_uuid")], ["r_uuid", "d"]).select("uuid", C("r_uuid").alias("other"), q(C("d"), 3).alias("d"))


@query("j24_greedy_matches")
def greedy(spark, d):
    """Sides of spaces matched one to one with walls by their ends (in the better direction, to 100
    in sum): sides in order, each with its first free wall."""
    s = with_box(space_sides(spark, d)).withColumn("side", F.concat_ws("#", "uuid", "pos")).drop("uuid")
    pairs = box_join(s, with_box(walls(spark, d).select("project_id", "uuid", *SEG)), ["project_id"], CELL, 100.0)
    gap = lambda a, b: scalar.dist(C(f"x{a}"), C(f"y{a}"), C(f"r_x{b}"), C(f"r_y{b}"))
    pairs = pairs.withColumn("gap", F.least(gap(0, 0) + gap(1, 1), gap(0, 1) + gap(1, 0))).where("gap <= 100").withColumnRenamed("r_uuid", "wall_uuid")
    return matching.greedy_matches(pairs, ["project_id"], "side", "wall_uuid", [])


@query("j25_best_area_ratio", with_(SPACES, SIDES, "a AS (SELECT project_id, uuid, area_raw, (max(x0) - min(x0)) * (max(y0) - min(y0)) AS area FROM sides JOIN spaces USING (project_id, uuid) GROUP BY ALL)", "t AS (SELECT a.uuid, max(least(a.area, b.area_raw) / greatest(a.area, b.area_raw)) AS r FROM a JOIN a b USING (project_id) WHERE b.area_raw > 0 AND a.area > 0 GROUP BY ALL)") + f" SELECT uuid, {sq('r', 6)} AS area_ratio_best FROM t")
def best_area_ratio(spark, d):
    """The best ratio of a space's area to any given area of its project. The nearest
    smaller and the nearest larger decide, so one ordered pass finds it, in place of all pairs."""
    s = spaces(spark, d).withColumn("b", arrays.bounds(C("v")))
    area = (C("b.max_x") - C("b.min_x")) * (C("b.max_y") - C("b.min_y"))
    mine = s.select("project_id", "uuid", area.alias("a")).where("a > 0")
    given = s.where("area_raw > 0").select("project_id", F.lit(None).cast("string").alias("uuid"), C("area_raw").alias("a"))
    both = mine.withColumn("g", F.lit(None).cast("double")).unionByName(given.withColumn("g", C("a")))
    w = Window.partitionBy("project_id").orderBy("a", C("g").isNull())
    low = F.last("g", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    high = F.first("g", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    got = both.withColumns({"low": low, "high": high}).where("uuid IS NOT NULL")
    return got.select("uuid", q(F.greatest(C("low") / C("a"), C("a") / C("high")), 6).alias("area_ratio_best")).where("area_ratio_best IS NOT NULL")


_FRAMES = "frames AS (SELECT project_id, uuid, min(x0) AS ax, min(y0) AS ay, max(x0) AS bx, max(y0) AS b_y FROM sides GROUP BY ALL)"


@query("j26_ownership", with_(AUDIT, SPACES, SIDES, _FRAMES, "o AS (SELECT a.project_id, a.source_id, count(*) FILTER (a.min_x >= ax - 0.5 AND a.min_y >= ay - 0.5 AND a.max_x <= bx + 0.5 AND a.max_y <= b_y + 0.5) AS held, count(uuid) AS met FROM audit a LEFT JOIN frames f ON a.project_id = f.project_id AND a.min_x <= bx + 0.5 AND a.max_x >= ax - 0.5 AND a.min_y <= b_y + 0.5 AND a.max_y >= ay - 0.5 GROUP BY ALL)") + " SELECT project_id, source_id, CASE WHEN held = 1 THEN 'once' WHEN held > 1 THEN 'multiple' WHEN met > 0 THEN 'crossing' ELSE 'unassigned' END AS ownership FROM o")
def ownership(spark, d):
    """Whether an entity lies in one frame, in several, across a border, or in none."""
    a = audit(spark, d).select("project_id", "source_id", "min_x", "min_y", "max_x", "max_y")
    f = spaces(spark, d).select("project_id", "uuid", arrays.bounds(C("v")).alias("b")).select("project_id", "uuid", "b.*")
    pairs = box_join(a, f, ["project_id"], CELL, 0.5)
    held = scalar.box_contains([C(f"r_{c}") for c in ("min_x", "min_y", "max_x", "max_y")], [C(c) for c in ("min_x", "min_y", "max_x", "max_y")])
    n = pairs.groupBy("project_id", "source_id").agg(F.count_if(held).alias("held"), F.count(F.lit(1)).alias("met"))
    kind = F.when(C("held") == 1, "once").when(C("held") > 1, "multiple").when(C("met") > 0, "crossing").otherwise("unassigned")
    return a.join(n, ["project_id", "source_id"], "left").select("project_id", "source_id", kind.alias("ownership"))


@query("j27_titles_in_frames", with_(AUDIT, SPACES, SIDES, _FRAMES, "t AS (SELECT project_id, source_id, (min_x + max_x) / 2 AS x, (min_y + max_y) / 2 AS y FROM audit WHERE audit_role = 'title')") + " SELECT f.uuid, count(t.source_id) AS n_titles FROM frames f LEFT JOIN t ON t.project_id = f.project_id AND x BETWEEN ax AND bx AND y BETWEEN ay AND b_y GROUP BY ALL")
def titles_in_frames(spark, d):
    a = audit(spark, d).where("audit_role = 'title'").select("project_id", "source_id", ((C("min_x") + C("max_x")) / 2).alias("x"), ((C("min_y") + C("max_y")) / 2).alias("y"))
    f = spaces(spark, d).select("project_id", "uuid", arrays.bounds(C("v")).alias("b")).select("project_id", "uuid", "b.*")
    n = box_join(point_box(a, "x", "y"), f, ["project_id"], CELL).groupBy(C("r_uuid").alias("uuid")).agg(F.count(F.lit(1)).alias("n"))
    return f.select("uuid").join(n, "uuid", "left").select("uuid", F.coalesce("n", F.lit(0)).alias("n_titles"))


@query("j28_nearest_region", with_(AUDIT, SPACES, SIDES, _FRAMES, "n AS (SELECT project_id, source_id, (min_x + max_x) / 2 AS x, (min_y + max_y) / 2 AS y FROM audit WHERE audit_role = 'annotation')", "c AS (SELECT n.project_id, source_id, uuid, sqrt(greatest(ax - x, 0, x - bx) * greatest(ax - x, 0, x - bx) + greatest(ay - y, 0, y - b_y) * greatest(ay - y, 0, y - b_y)) AS d FROM n JOIN frames f ON f.project_id = n.project_id AND x BETWEEN ax - 3000 AND bx + 3000 AND y BETWEEN ay - 3000 AND b_y + 3000)", "k AS (SELECT *, row_number() OVER (PARTITION BY project_id, source_id ORDER BY d, uuid) AS r FROM c WHERE d <= 3000)") + f" SELECT project_id, source_id, uuid, {sq('d', 3)} AS d FROM k WHERE r = 1")
def nearest_region(spark, d):
    """The region nearest to each annotation, at most 3000 away."""
    a = audit(spark, d).where("audit_role = 'annotation'").select("project_id", "source_id", ((C("min_x") + C("max_x")) / 2).alias("x"), ((C("min_y") + C("max_y")) / 2).alias("y"))
    f = spaces(spark, d).select("project_id", "uuid", arrays.bounds(C("v")).alias("b")).select("project_id", "uuid", "b.*")
    zero = F.lit(0.0)
    gx, gy = F.greatest(C("r_min_x") - C("x"), zero, C("x") - C("r_max_x")), F.greatest(C("r_min_y") - C("y"), zero, C("y") - C("r_max_y"))
    pairs = box_join(point_box(a, "x", "y"), f, ["project_id"], CELL, 3000.0).withColumn("d", F.sqrt(gx * gx + gy * gy)).where("d <= 3000")
    return best(pairs, ["project_id", "source_id"], [C("d"), C("r_uuid")], ["r_uuid", "d"]).select("project_id", "source_id", C("r_uuid").alias("uuid"), q(C("d"), 3).alias("d"))


_BOXES = "boxes AS (SELECT project_id, source_id, is_closed, min_x, min_y, max_x, max_y FROM audit WHERE audit_role = 'structural')"


@query("j29_nested_once", with_(AUDIT, _BOXES) + " SELECT o.project_id, o.source_id, min(i.source_id) AS inner_id FROM boxes o JOIN boxes i ON i.project_id = o.project_id AND i.source_id <> o.source_id AND i.is_closed AND NOT o.is_closed AND i.min_x >= o.min_x AND i.min_y >= o.min_y AND i.max_x <= o.max_x AND i.max_y <= o.max_y GROUP BY ALL HAVING count(*) = 1")
def nested_once(spark, d):
    """Open outlines that hold exactly one closed one."""
    b = audit(spark, d).where("audit_role = 'structural'").select("project_id", "source_id", "is_closed", "min_x", "min_y", "max_x", "max_y")
    pairs = box_join(b.where(~C("is_closed")), b.where("is_closed"), ["project_id"], CELL)
    inside = scalar.box_contains([C(c) for c in ("min_x", "min_y", "max_x", "max_y")], [C(f"r_{c}") for c in ("min_x", "min_y", "max_x", "max_y")], 0.0)
    got = pairs.where(inside & (C("source_id") != C("r_source_id"))).groupBy("project_id", "source_id").agg(F.count(F.lit(1)).alias("n"), F.min("r_source_id").alias("inner_id"))
    return got.where("n = 1").drop("n")


@query("j30_equal_multisets", with_(OPENINGS, "g AS (SELECT project_id, category, list_sort(list(width)) AS m FROM openings GROUP BY ALL)") + " SELECT a.project_id, a.m = b.m AS exact, len(a.m) = len(b.m) AS same_count FROM g a JOIN g b USING (project_id) WHERE a.category = 'DOOR' AND b.category = 'WINDOW'")
def equal_multisets(spark, d):
    """Whether a project's doors and windows have the same widths, as multisets: counted
    per width and compared, so that no group is gathered."""
    o = openings(spark, d).groupBy("project_id", "width").agg(F.count_if(C("category") == "DOOR").alias("a"), F.count_if(C("category") == "WINDOW").alias("b"))
    g = o.groupBy("project_id").agg(F.bool_and(C("a") == C("b")).alias("exact"), F.sum("a").alias("na"), F.sum("b").alias("nb"))
    return g.where("na > 0 AND nb > 0").select("project_id", "exact", (C("na") == C("nb")).alias("same_count"))


@query("j31_open_ends", with_(NODES, EDGES, _DANGLING, "c AS (SELECT a.project_id, a.node_id, b.node_id AS other, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM dangling a JOIN dangling b ON a.project_id = b.project_id AND a.node_id <> b.node_id)", "k AS (SELECT *, row_number() OVER (PARTITION BY project_id, node_id ORDER BY d, other) AS n, count(*) FILTER (d < 2000) OVER (PARTITION BY project_id, node_id) AS near FROM c)") + f" SELECT project_id, node_id, other AS nearest_end, {sq('d', 3)} AS d, near AS n_near FROM k WHERE n = 1")
def open_ends(spark, d):
    """For each open end the nearest other one, and how many lie within 2000."""
    n = dangling(spark, d).select("project_id", "node_id", "x", "y")
    n = n.join(n.groupBy("project_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("project_id"), "project_id", "left_semi")
    t = point_box(n.select("project_id", C("node_id").alias("other"), "x", "y"), "x", "y")
    # an end is its own nearest point: its box is taken out by distance order on (own last)
    own = F.when(C("node_id") == C("r_other"), F.lit(1e300)).otherwise(scalar.dist(C("x"), C("y"), C("r_x"), C("r_y")))
    got = nearest(n, t, ["project_id"], ["project_id", "node_id"], C("r_other"), ["r_other"], 2_000.0, distance=own)
    pairs = box_join(point_box(n, "x", "y"), t, ["project_id"], CELL, 2000.0).where((C("node_id") != C("r_other")) & (scalar.dist(C("x"), C("y"), C("r_x"), C("r_y")) < 2000))
    near = pairs.groupBy("project_id", "node_id").agg(F.count(F.lit(1)).alias("k"))
    return got.join(near, ["project_id", "node_id"], "left").select("project_id", "node_id", C("r_other").alias("nearest_end"), q(C("distance"), 3).alias("d"), F.coalesce("k", F.lit(0)).alias("n_near"))


@query("j35_missed_t", with_(WALLS, SPACES, SIDES, "p AS (SELECT project_id, uuid, x0 AS px, y0 AS py FROM walls)", f"h AS (SELECT DISTINCT p.project_id, p.uuid FROM p JOIN walls w ON p.project_id = w.project_id AND p.uuid <> w.uuid AND {_pt('p.px', 'p.py', 'w')} > 0 AND {_pt('p.px', 'p.py', 'w')} < 500)") + " SELECT project_id, uuid FROM h")
def missed_t(spark, d):
    """Walls whose first end comes within 500 of another wall without meeting it."""
    p = point_box(walls(spark, d).select("project_id", "uuid", C("x0").alias("x"), C("y0").alias("y")), "x", "y")
    pairs = box_join(p, with_box(walls(spark, d).select("project_id", "uuid", *SEG)), ["project_id"], CELL, 500.0).where("uuid <> r_uuid")
    gap = scalar.to_segment(C("x"), C("y"), *matching.cols(matching.B))
    return pairs.where((gap > 0) & (gap < 500)).select("project_id", "uuid").distinct()


@query("j37_reciprocal", "WITH b AS (SELECT DISTINCT project_id, uuid AS a, lower(trim(n)) AS b FROM (SELECT project_id, uuid, unnest(neighbors) AS n FROM core_spaces) WHERE trim(coalesce(n, '')) <> '') SELECT x.project_id, x.a AS space_uuid, x.b AS neighbor FROM b x WHERE EXISTS (SELECT 1 FROM core_spaces s WHERE s.project_id = x.project_id AND s.uuid = x.b) AND NOT EXISTS (SELECT 1 FROM b y WHERE y.project_id = x.project_id AND y.a = x.b AND y.b = x.a)")
def reciprocal(spark, d):
    """Neighbours that exist but don't name each other."""
    s = table(spark, d, "core_spaces").select("project_id", C("uuid").alias("a"), F.explode("neighbors").alias("n"))
    b = s.select("project_id", "a", reference_key(C("n")).alias("b")).where("b IS NOT NULL").distinct()
    known = table(spark, d, "core_spaces").select("project_id", C("uuid").alias("b")).distinct()
    back = b.select("project_id", C("b").alias("a"), C("a").alias("b"))
    return b.join(known, ["project_id", "b"], "left_semi").join(back, ["project_id", "a", "b"], "left_anti").select("project_id", C("a").alias("space_uuid"), C("b").alias("neighbor"))


@query("j38_texts_near", with_(AUDIT, SPACES, SIDES, _FRAMES) + " SELECT f.uuid, count(*) AS n_texts FROM frames f JOIN audit a ON a.project_id = f.project_id AND a.text IS NOT NULL AND a.min_x BETWEEN ax - 500 AND bx + 500 AND a.min_y BETWEEN ay - 500 AND b_y + 500 GROUP BY ALL")
def texts_near(spark, d):
    t = point_box(audit(spark, d).where("text IS NOT NULL").select("project_id", "source_id", C("min_x").alias("x"), C("min_y").alias("y")), "x", "y")
    f = spaces(spark, d).select("project_id", "uuid", arrays.bounds(C("v")).alias("b")).select("project_id", "uuid", "b.*")
    return box_join(t, f, ["project_id"], CELL, 500.0).groupBy(C("r_uuid").alias("uuid")).agg(F.count(F.lit(1)).alias("n_texts"))


@query("j39_semi", with_(OPENINGS) + " SELECT DISTINCT uuid FROM core_walls WHERE uuid IN (SELECT lower(trim(parent_wall)) FROM openings WHERE parent_wall IS NOT NULL)")
def semi(spark, d):
    o = openings(spark, d).select(reference_key(C("parent_wall")).alias("uuid"))
    return table(spark, d, "core_walls").select("uuid").join(o, "uuid", "left_semi").distinct()


@query("flt09_labels_in_spaces", with_(AUDIT, SPACES, SIDES, _FRAMES, _LABEL) + " SELECT DISTINCT l.project_id, l.source_id FROM labels l SEMI JOIN frames f ON f.project_id = l.project_id AND x BETWEEN ax AND bx AND y BETWEEN ay AND b_y")
def labels_in_spaces(spark, d):
    f = spaces(spark, d).select("project_id", "uuid", arrays.bounds(C("v")).alias("b")).select("project_id", "uuid", "b.*")
    return box_join(point_box(labels(spark, d), "x", "y"), f, ["project_id"], CELL).select("project_id", "source_id").distinct()
