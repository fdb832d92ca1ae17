"""Row-wise queries: scaling, segments, measures, classes, and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import arrays, scalar
from gridloom.functions.scalar import q
from gridloom.operators.ranks import quantiles
from gridloom.plans.base import AUDIT, MATCH_KEY, OPENINGS, SIDES, SPACES, WALLS, audit, edges, openings, space_sides, spaces, sq, sq_angle, walls, with_, NODES, EDGES
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


@query("proj01_unit_scale", "SELECT row_id, CASE row_id % 8 WHEN 1 THEN 25.4::DOUBLE WHEN 2 THEN 304.8::DOUBLE WHEN 4 THEN 1.0::DOUBLE WHEN 5 THEN 10.0::DOUBLE WHEN 6 THEN 1000.0::DOUBLE ELSE 1.0::DOUBLE END AS scale, thickness * CASE row_id % 8 WHEN 1 THEN 25.4::DOUBLE WHEN 2 THEN 304.8::DOUBLE WHEN 5 THEN 10.0::DOUBLE WHEN 6 THEN 1000.0::DOUBLE ELSE 1.0::DOUBLE END AS thickness_mm FROM cad_entities")
def unit_scale(spark: SparkSession, d: str) -> DataFrame:
    """Lengths in millimetres, by a unit code (here the row number's remainder)."""
    units = spark.createDataFrame(list(scalar.UNIT_MM.items()), "code long, mm double")
    rows = table(spark, d, "cad_entities").select("row_id", "thickness", (C("row_id") % 8).alias("code"))
    scale = F.coalesce("mm", F.lit(1.0))
    return rows.join(F.broadcast(units), "code", "left").select("row_id", scale.alias("scale"), (C("thickness") * scale).alias("thickness_mm"))


@query("proj02_vertex_segments", with_(SPACES, SIDES) + " SELECT project_id, uuid, pos, x0, y0, x1, y1 FROM sides")
def vertex_segments(spark, d):
    return space_sides(spark, d)


@query("proj03_endpoints", with_(WALLS) + " SELECT project_id, uuid, 0 AS k, x0 AS x, y0 AS y FROM walls UNION ALL SELECT project_id, uuid, 1, x1, y1 FROM walls")
def endpoints(spark, d):
    ends = F.array(F.struct(F.lit(0).alias("k"), C("x0").alias("x"), C("y0").alias("y")), F.struct(F.lit(1).alias("k"), C("x1").alias("x"), C("y1").alias("y")))
    return walls(spark, d).select("project_id", "uuid", F.explode(ends).alias("e")).select("project_id", "uuid", "e.*")


@query("proj04_centres", with_(SPACES, SIDES) + f" SELECT uuid, {sq('(min(x0) + max(x0)) / 2', 3)} AS box_x, {sq('(min(y0) + max(y0)) / 2', 3)} AS box_y, {sq('sum(x0) / count(*)', 3)} AS mean_x, {sq('sum(y0) / count(*)', 3)} AS mean_y FROM sides GROUP BY uuid, project_id")
def centres(spark, d):
    s = spaces(spark, d).select("uuid", arrays.bounds(C("v")).alias("b"), arrays.mean_point(C("v")).alias("m"))
    return s.select("uuid", q((C("b.min_x") + C("b.max_x")) / 2, 3).alias("box_x"), q((C("b.min_y") + C("b.max_y")) / 2, 3).alias("box_y"), q(C("m.x"), 3).alias("mean_x"), q(C("m.y"), 3).alias("mean_y"))


@query("proj05_bbox", with_(SPACES, SIDES) + " SELECT project_id, uuid, min(x0) AS min_x, min(y0) AS min_y, max(x0) AS max_x, max(y0) AS max_y FROM sides GROUP BY ALL")
def bbox(spark, d):
    return spaces(spark, d).select("project_id", "uuid", arrays.bounds(C("v")).alias("b")).select("project_id", "uuid", "b.*")


@query("proj06_translate", with_(WALLS, "o AS (SELECT project_id, min(least(x0, x1)) AS ox, min(least(y0, y1)) AS oy FROM walls GROUP BY project_id)") + " SELECT project_id, uuid, x0 - ox AS x0, y0 - oy AS y0, x1 - ox AS x1, y1 - oy AS y1 FROM walls JOIN o USING (project_id)")
def translate(spark, d):
    w = walls(spark, d)
    o = w.groupBy("project_id").agg(F.min(F.least("x0", "x1")).alias("ox"), F.min(F.least("y0", "y1")).alias("oy"))
    return w.join(o, "project_id").select("project_id", "uuid", *[(C(c) - C("ox" if c[0] == "x" else "oy")).alias(c) for c in SEG])


@query("proj07_length", with_(WALLS) + f" SELECT uuid, {sq('sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))', 4)} AS length FROM walls")
def length(spark, d):
    return walls(spark, d).select("uuid", q(scalar.dist(*map(C, SEG)), 4).alias("length"))


@query("proj08_angle180", f"SELECT from_id, to_id, a.project_id, edge_id, {sq(sq_angle('a.x_mm', 'a.y_mm', 'b.x_mm', 'b.y_mm'), 5)} AS angle FROM (SELECT DISTINCT project_id, edge_id, from_id, to_id FROM geometry_edges) e JOIN (SELECT project_id, node_id, min(x_mm) AS x_mm, min(y_mm) AS y_mm FROM geometry_nodes GROUP BY ALL) a ON a.project_id = e.project_id AND a.node_id = from_id JOIN (SELECT project_id, node_id, min(x_mm) AS x_mm, min(y_mm) AS y_mm FROM geometry_nodes GROUP BY ALL) b ON b.project_id = e.project_id AND b.node_id = to_id")
def angle180(spark, d):
    n = table(spark, d, "geometry_nodes").groupBy("project_id", "node_id").agg(F.min("x_mm").alias("x"), F.min("y_mm").alias("y"))
    e = table(spark, d, "geometry_edges").select("project_id", "edge_id", "from_id", "to_id").distinct()
    a = n.select("project_id", C("node_id").alias("from_id"), C("x").alias("x0"), C("y").alias("y0"))
    b = n.select("project_id", C("node_id").alias("to_id"), C("x").alias("x1"), C("y").alias("y1"))
    return e.join(a, ["project_id", "from_id"]).join(b, ["project_id", "to_id"]).select("from_id", "to_id", "project_id", "edge_id", q(scalar.angle180(*map(C, SEG)), 5).alias("angle"))


@query("proj09_axis", with_(WALLS) + f" SELECT uuid, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, {sq('sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))', 3)} AS length, {sq(sq_angle('x0', 'y0', 'x1', 'y1'), 5)} AS angle FROM walls")
def axis(spark, d):
    return walls(spark, d).select("uuid", ((C("x0") + C("x1")) / 2).alias("cx"), ((C("y0") + C("y1")) / 2).alias("cy"), q(scalar.dist(*map(C, SEG)), 3).alias("length"), q(scalar.angle180(*map(C, SEG)), 5).alias("angle"))


@query("proj10_drawing_units", with_(OPENINGS) + " SELECT uuid, width / 32.0::DOUBLE AS width_units FROM openings")
def drawing_units(spark, d):
    return openings(spark, d).select("uuid", (C("width") / F.lit(32.0)).alias("width_units"))


_FEATURES = with_(AUDIT) + f""" SELECT source_id, project_id, entity_type,
 CASE WHEN entity_type = 'LINE' THEN {sq('len_mm', 3)} WHEN entity_type IN ('LWPOLYLINE', 'ARC', 'CIRCLE') THEN {sq('greatest(max_x - min_x, max_y - min_y)', 3)} END AS size,
 CASE WHEN max_x - min_x >= max_y - min_y THEN 'horizontal' ELSE 'vertical' END AS orientation,
 CASE WHEN entity_type IN ('ARC', 'CIRCLE') THEN {sq('greatest(max_x - min_x, max_y - min_y) / 2', 3)} END AS radius
 FROM audit WHERE entity_type IN ('LINE', 'LWPOLYLINE', 'ARC', 'CIRCLE')"""


@query("proj11_door_features", _FEATURES)
def door_features(spark, d):
    """Size, orientation and radius of the entities that may be doors."""
    kind, w, h = C("entity_type"), C("max_x") - C("min_x"), C("max_y") - C("min_y")
    rows = audit(spark, d).where(kind.isin("LINE", "LWPOLYLINE", "ARC", "CIRCLE"))
    size = F.when(kind == "LINE", q(C("len_mm"), 3)).otherwise(q(F.greatest(w, h), 3))
    return rows.select("source_id", "project_id", "entity_type", size.alias("size"), F.when(w >= h, "horizontal").otherwise("vertical").alias("orientation"), F.when(kind.isin("ARC", "CIRCLE"), q(F.greatest(w, h) / 2, 3)).alias("radius"))


@query("proj12_window_features", with_(OPENINGS) + f""" SELECT uuid, {sq('(CASE WHEN width BETWEEN 600 AND 2400 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) * (CASE WHEN abs(x1 - x0) < 1e-6 OR abs(y1 - y0) < 1e-6 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END) * (CASE WHEN category = $$WINDOW$$ THEN 0.9::DOUBLE ELSE 0.4::DOUBLE END)', 4)} AS confidence FROM openings""")
def window_features(spark, d):
    """A confidence from the factors of size, shape and kind."""
    size = F.when(C("width").between(600, 2400), 1.0).otherwise(0.5)
    shape = F.when((F.abs(C("x1") - C("x0")) < 1e-6) | (F.abs(C("y1") - C("y0")) < 1e-6), 1.0).otherwise(0.7)
    return openings(spark, d).select("uuid", q(size * shape * F.when(C("category") == "WINDOW", 0.9).otherwise(0.4), 4).alias("confidence"))


@query("proj13_sweep", "SELECT project_id, edge_id, CASE WHEN s > 180 THEN 360 - s ELSE s END AS sweep FROM (SELECT project_id, edge_id, floor(abs((angle * 2 % 360) - (len_mm % 360)) * 1e3 + CAST(0.5 AS DOUBLE)) / 1e3 AS s FROM geometry_edges)")
def sweep(spark, d):
    raw = q(F.abs(F.pmod(C("angle") * 2, F.lit(360.0)) - F.pmod(C("len_mm"), F.lit(360.0))), 3)
    return table(spark, d, "geometry_edges").select("project_id", "edge_id", raw.alias("s")).select("project_id", "edge_id", F.when(C("s") > 180, 360 - C("s")).otherwise(C("s")).alias("sweep"))


@query("proj14_wall_bodies", with_(WALLS) + f" SELECT uuid, thickness > 200 AS is_exterior, {sq('sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) * thickness * 2800', 0)} AS volume FROM walls")
def wall_bodies(spark, d):
    """Extruded walls: whether exterior, and volume."""
    return walls(spark, d).select("uuid", (C("thickness") > 200).alias("is_exterior"), q(scalar.dist(*map(C, SEG)) * C("thickness") * 2800.0, 0).alias("volume"))


@query("proj16_longest_side", with_(SPACES, SIDES, "r AS (SELECT *, row_number() OVER (PARTITION BY project_id, uuid ORDER BY (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) DESC, pos) AS n FROM sides)") + " SELECT uuid, pos, x0, y0, x1, y1 FROM r WHERE n = 1")
def longest_side(spark, d):
    return spaces(spark, d).select("uuid", arrays.longest_side(C("v"), True).alias("s")).select("uuid", "s.*")


_REASON = "CASE WHEN entity_type NOT IN ('LINE', 'LWPOLYLINE', 'POLYLINE') THEN 'type' WHEN render_points IS NULL OR len(render_points) < 2 THEN 'points' WHEN layer IS NULL OR layer = '' THEN 'layer' ELSE 'accepted' END"


@query("proj18_reject_reasons", with_(AUDIT) + f" SELECT {_REASON} AS reason, count(*) AS n FROM audit GROUP BY ALL")
def reject_reasons(spark, d):
    """Which audited entities can be taken as geometry, and why others can't."""
    reason = F.when(~C("entity_type").isin("LINE", "LWPOLYLINE", "POLYLINE"), "type").when(C("render_points").isNull() | (F.size("render_points") < 2), "points").when(C("layer").isNull() | (C("layer") == ""), "layer").otherwise("accepted")
    return audit(spark, d).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("proj19_ortho", with_(NODES, EDGES) + " SELECT project_id, edge_id, CASE WHEN abs(angle - 90 * floor(angle / 90 + CAST(0.5 AS DOUBLE))) <= 10 THEN 90 * floor(angle / 90 + CAST(0.5 AS DOUBLE)) ELSE angle END AS angle, floor(len_mm + CAST(0.5 AS DOUBLE)) AS len FROM edges")
def ortho(spark, d):
    """Directions within ten degrees of an axis snapped to it, lengths to whole units."""
    near = F.lit(90.0) * F.floor(C("angle") / 90.0 + 0.5)
    return edges(spark, d).select("project_id", "edge_id", F.when(F.abs(C("angle") - near) <= 10, near).otherwise(C("angle")).alias("angle"), F.floor(C("len_mm") + 0.5).cast("double").alias("len"))


# Filters


def _like(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


@query("flt01_wall_layers", f"SELECT row_id, layer FROM cad_entities WHERE {_like('lower(layer)', scalar.WALL_WORDS)} AND NOT {_like('lower(layer)', scalar.NO_WALL_WORDS)}")
def wall_layers(spark, d):
    return table(spark, d, "cad_entities").where(scalar.is_wall_layer(C("layer"))).select("row_id", "layer")


@query("flt02_collapsed_rings", with_(SPACES, SIDES) + " SELECT uuid, count(*)::INT AS n_kept FROM sides WHERE (x0 - x1) * (x0 - x1) + (y0 - y1) * (y0 - y1) > 1e-4 GROUP BY uuid, project_id")
def collapsed_rings(spark, d):
    """Vertices left after those near the last kept one are dropped."""
    return spaces(spark, d).select("uuid", F.size(arrays.without_near(C("v"))).alias("n_kept"))


@query("flt03_short_edges", with_(NODES, EDGES) + " SELECT project_id, edge_id FROM edges WHERE len_mm >= 500 AND from_id <> to_id")
def short_edges(spark, d):
    return edges(spark, d).where((C("len_mm") >= 500) & (C("from_id") != C("to_id"))).select("project_id", "edge_id")


@query("flt04_area_bands", with_(SPACES) + " SELECT CASE WHEN area_raw < 50 THEN 'sliver' WHEN area_raw < 5000 THEN 'column' WHEN area_raw < 1e7 THEN 'small' ELSE 'space' END AS band, count(*) AS n FROM spaces WHERE area_raw IS NOT NULL GROUP BY ALL")
def area_bands(spark, d):
    a = C("area_raw")
    band = F.when(a < 50, "sliver").when(a < 5000, "column").when(a < 1e7, "small").otherwise("space")
    return spaces(spark, d).where(a.isNotNull()).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("flt05_short_walls", with_(WALLS) + " SELECT uuid FROM walls WHERE sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) < 3000")
def short_walls(spark, d):
    return walls(spark, d).where(scalar.dist(*map(C, SEG)) < 3000).select("uuid")


@query("flt06_categories", with_(OPENINGS) + " SELECT uuid, category FROM openings WHERE category IN ('DOOR', 'WINDOW', 'WALL')")
def categories(spark, d):
    return openings(spark, d).where(C("category").isin("DOOR", "WINDOW", "WALL")).select("uuid", "category")


@query("flt08_door_widths", with_(OPENINGS) + " SELECT uuid FROM openings WHERE category = 'DOOR' AND width BETWEEN 50 AND 1500")
def door_widths(spark, d):
    return openings(spark, d).where((C("category") == "DOOR") & C("width").between(50, 1500)).select("uuid")


@query("flt10_small_regions", with_(WALLS) + " SELECT project_id, count(*) AS n FROM walls GROUP BY project_id HAVING count(*) >= 20 AND max(greatest(x0, x1)) - min(least(x0, x1)) >= 10 AND max(greatest(y0, y1)) - min(least(y0, y1)) >= 10")
def small_regions(spark, d):
    g = walls(spark, d).groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), (F.max(F.greatest("x0", "x1")) - F.min(F.least("x0", "x1"))).alias("w"), (F.max(F.greatest("y0", "y1")) - F.min(F.least("y0", "y1"))).alias("h"))
    return g.where("n >= 20 AND w >= 10 AND h >= 10").select("project_id", "n")


@query("flt11_bridge_context", with_(AUDIT) + " SELECT project_id, source_id, greatest(max_x - min_x, max_y - min_y) > 4000 AND (is_closed OR greatest(max_x - min_x, max_y - min_y) / greatest(least(max_x - min_x, max_y - min_y), 1e-9) >= 20) AS is_bridge FROM audit WHERE audit_role = 'structural'")
def bridge_context(spark, d):
    """Structural entities too large to connect others."""
    w, h = C("max_x") - C("min_x"), C("max_y") - C("min_y")
    span = F.greatest(w, h)
    return audit(spark, d).where("audit_role = 'structural'").select("project_id", "source_id", ((span > 4000) & (C("is_closed") | (span / F.greatest(F.least(w, h), F.lit(1e-9)) >= 20))).alias("is_bridge"))


@query("flt12_edge_shape", "SELECT project_id, edge_id FROM geometry_edges WHERE from_id IS NOT NULL AND to_id IS NOT NULL AND from_id <> to_id")
def edge_shape(spark, d):
    return table(spark, d, "geometry_edges").where("from_id IS NOT NULL AND to_id IS NOT NULL AND from_id <> to_id").select("project_id", "edge_id")


@query("flt13_median_split", with_(OPENINGS, "m AS (SELECT project_id, quantile_cont((x0 + x1) / 2, 0.5) AS mid FROM openings GROUP BY project_id)") + " SELECT uuid, CASE WHEN (x0 + x1) / 2 < mid THEN 'left' ELSE 'right' END AS side FROM openings JOIN m USING (project_id)")
def median_split(spark, d):
    o = openings(spark, d).withColumn("cx", (C("x0") + C("x1")) / 2)
    m = quantiles(o, ["project_id"], "cx", [("mid", 0.5)])
    return o.join(m, "project_id").select("uuid", F.when(C("cx") < C("mid"), "left").otherwise("right").alias("side"))


@query("flt14_rule_counts", with_(OPENINGS, SPACES) + " SELECT 'small_space' AS rule, count(*) FILTER (area_raw < 1e7) AS n, CASE WHEN count(*) FILTER (area_raw < 1e7) = 0 THEN 'pass' ELSE 'fail' END AS status FROM spaces UNION ALL SELECT 'narrow_door', count(*) FILTER (category = 'DOOR' AND width < 800), CASE WHEN count(*) FILTER (category = 'DOOR' AND width < 800) = 0 THEN 'pass' ELSE 'fail' END FROM openings")
def rule_counts(spark, d):
    def rule(df: DataFrame, name: str, hit) -> DataFrame:
        n = F.count_if(hit)
        return df.agg(n.alias("n")).select(F.lit(name).alias("rule"), "n", F.when(C("n") == 0, "pass").otherwise("fail").alias("status"))
    return rule(spaces(spark, d), "small_space", C("area_raw") < 1e7).unionByName(rule(openings(spark, d), "narrow_door", (C("category") == "DOOR") & (C("width") < 800)))


@query("flt15_entity_types", "SELECT row_id FROM cad_entities WHERE entity_type IN ('LINE', 'ARC') AND entity_type NOT IN ('HATCH', 'DIMENSION')")
def entity_types(spark, d):
    return table(spark, d, "cad_entities").where(C("entity_type").isin("LINE", "ARC") & ~C("entity_type").isin("HATCH", "DIMENSION")).select("row_id")


# Scalars


@query("fn02_segment_projection", with_(WALLS, OPENINGS, "p AS (SELECT o.uuid, w.uuid AS wall, (o.x0 + o.x1) / 2 AS px, (o.y0 + o.y1) / 2 AS py, w.x0, w.y0, w.x1, w.y1 FROM openings o JOIN walls w ON w.project_id = o.project_id AND w.uuid = lower(trim(o.parent_wall)))", "t AS (SELECT *, CASE WHEN (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) < 1e-10 THEN 0.0::DOUBLE ELSE ((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) END AS t FROM p)") + f" SELECT uuid, wall, {sq('t', 6)} AS t, {sq('sqrt((px - x0 - t * (x1 - x0)) * (px - x0 - t * (x1 - x0)) + (py - y0 - t * (y1 - y0)) * (py - y0 - t * (y1 - y0)))', 4)} AS d FROM t")
def segment_projection(spark, d):
    """Where the middle of an opening lies along its wall."""
    w = walls(spark, d).select("project_id", C("uuid").alias("wall"), *SEG)
    o = openings(spark, d).select("project_id", "uuid", F.lower(F.trim("parent_wall")).alias("wall"), ((C("x0") + C("x1")) / 2).alias("px"), ((C("y0") + C("y1")) / 2).alias("py"))
    j = o.join(w, ["project_id", "wall"]).withColumn("t", scalar.along(C("px"), C("py"), *map(C, SEG)))
    foot = scalar.dist(C("px"), C("py"), C("x0") + C("t") * (C("x1") - C("x0")), C("y0") + C("t") * (C("y1") - C("y0")))
    return j.select("uuid", "wall", q(C("t"), 6).alias("t"), q(foot, 4).alias("d"))


@query("fn06_node_types", with_(NODES, EDGES, "h AS (SELECT project_id, from_id AS n, to_id AS o FROM edges WHERE from_id <> to_id UNION SELECT project_id, to_id, from_id FROM edges WHERE from_id <> to_id)", "g AS (SELECT h.project_id, h.n, count(*) AS deg, min(o) AS a, max(o) AS b FROM h GROUP BY ALL)", "v AS (SELECT nodes.project_id, nodes.node_id, coalesce(deg, 0) AS deg, p.x - nodes.x AS ax, p.y - nodes.y AS ay, r.x - nodes.x AS ux, r.y - nodes.y AS uy FROM nodes LEFT JOIN g ON g.project_id = nodes.project_id AND g.n = nodes.node_id LEFT JOIN nodes p ON p.project_id = g.project_id AND p.node_id = g.a LEFT JOIN nodes r ON r.project_id = g.project_id AND r.node_id = g.b)") + " SELECT project_id, node_id, deg AS degree, CASE deg WHEN 0 THEN 'end' WHEN 1 THEN 'end' WHEN 2 THEN CASE WHEN floor(degrees(acos(greatest(-1, least(1, (ax * ux + ay * uy) / (sqrt(ax * ax + ay * ay) * sqrt(ux * ux + uy * uy)))))) * 1e6 + CAST(0.5 AS DOUBLE)) / 1e6 > 165 THEN 'straight' ELSE 'L_corner' END WHEN 3 THEN 'T' ELSE 'X' END AS kind FROM v")
def node_types(spark, d):
    """Degree over distinct neighbours, and kind, of every node."""
    from gridloom.operators.graph import neighbours

    n = nodes_(spark, d)
    g = neighbours(edges(spark, d)).groupBy("project_id", "node_id").agg(F.count(F.lit(1)).alias("deg"), F.min("other").alias("a"), F.max("other").alias("b"))
    at = lambda k: n.select("project_id", C("node_id").alias(k), C("x").alias(f"{k}x"), C("y").alias(f"{k}y"))
    v = n.join(g, ["project_id", "node_id"], "left").join(at("a"), ["project_id", "a"], "left").join(at("b"), ["project_id", "b"], "left")
    opening = q(scalar.between_angle(C("ax") - C("x"), C("ay") - C("y"), C("bx") - C("x"), C("by") - C("y")), 6)
    degree = F.coalesce("deg", F.lit(0))
    return v.select("project_id", "node_id", degree.alias("degree"), scalar.node_type(degree, opening).alias("kind"))


def nodes_(spark, d):
    from gridloom.plans.base import nodes

    return nodes(spark, d)


#: DuckDB's lower() turns the dotted capital I into a plain i; the JVM's keeps the dot.
_LOWER = "lower(replace(layer, 'İ', 'i\u0307'))"


def _ladder(col: str, steps, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {_like(col, w)} THEN '{n}'" for n, w in steps) + f" ELSE {other} END"


@query("fn14_layer_classes", f"SELECT {_ladder(_LOWER.replace('layer', 'trim(layer)'), scalar.LAYER_CLASSES, chr(39) + 'OTHER' + chr(39))} AS class, count(*) AS n FROM cad_entities WHERE layer IS NOT NULL GROUP BY ALL")
def layer_classes(spark, d):
    return table(spark, d, "cad_entities").where("layer IS NOT NULL").groupBy(scalar.layer_class(C("layer")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("fn15_drawing_kinds", "SELECT " + _ladder(_LOWER, (("Roof Plan", scalar.ROOF_WORDS), ("Elevation", scalar.ELEVATION_WORDS), ("Section", scalar.SECTION_WORDS), ("Detail", scalar.DETAIL_WORDS), ("Floor Plan", scalar.FLOOR_WORDS)), "NULL") + " AS kind, count(*) AS n FROM cad_entities WHERE layer IS NOT NULL GROUP BY ALL")
def drawing_kinds(spark, d):
    return table(spark, d, "cad_entities").where("layer IS NOT NULL").groupBy(scalar.drawing_kind(C("layer")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("fn17_match_keys", f"SELECT row_id, {MATCH_KEY} AS key FROM audit_entities WHERE text IS NOT NULL")
def match_keys(spark, d):
    return table(spark, d, "audit_entities").where("text IS NOT NULL").select("row_id", scalar.match_key(C("text")).alias("key"))


@query("fn19_scales", "SELECT row_id, regexp_extract(text, '1\\s*[:/-]\\s*([0-9]+)', 1)::DECIMAL(38,0) AS scale, CASE WHEN regexp_extract(text, '1\\s*[:/-]\\s*([0-9]+)', 1)::DECIMAL(38,0) >= 200 THEN 'site_plan' ELSE 'detail' END AS kind FROM audit_entities WHERE regexp_matches(text, '1\\s*[:/-]\\s*([0-9]+)')")
def scales(spark, d):
    n = F.regexp_extract("text", r"1\s*[:/-]\s*([0-9]+)", 1)
    rows = table(spark, d, "audit_entities").where(F.rlike("text", F.lit(r"1\s*[:/-]\s*([0-9]+)"))).select("row_id", n.cast("decimal(38,0)").alias("scale"))
    return rows.withColumn("kind", F.when(C("scale") >= 200, "site_plan").otherwise("detail"))


@query("fn26_row_hash", "SELECT row_id, sha256(concat_ws('|', project_id, entity_type, coalesce(layer, ''), coalesce(start_pt, ''), coalesce(end_pt, ''))) AS fingerprint FROM cad_entities")
def row_hash(spark, d):
    """A fingerprint of each entity's fields."""
    parts = [C("project_id"), C("entity_type"), *[F.coalesce(c, F.lit("")) for c in ("layer", "start_pt", "end_pt")]]
    return table(spark, d, "cad_entities").select("row_id", F.sha2(F.concat_ws("|", *parts), 256).alias("fingerprint"))


@query("fn29_short_ids", "SELECT project_id, 'region-' || substr(sha256(project_id || '|' || count(*)), 1, 16) AS region_id FROM cad_entities GROUP BY project_id")
def short_ids(spark, d):
    g = table(spark, d, "cad_entities").groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("project_id", F.concat(F.lit("region-"), F.substring(F.sha2(F.concat_ws("|", "project_id", C("n").cast("string")), 256), 1, 16)).alias("region_id"))


@query("fn31_tolerances", with_(WALLS, "e AS (SELECT project_id, greatest(max(greatest(x0, x1)) - min(least(x0, x1)), max(greatest(y0, y1)) - min(least(y0, y1))) AS extent FROM walls GROUP BY project_id)", "f AS (SELECT project_id, greatest(0.1::DOUBLE, least(10::DOUBLE, extent / 50000)) AS f FROM e)") + f" SELECT project_id, {sq('10 * f', 3)} AS merge_mm, {sq('5 * f', 3)} AS snap_mm, {sq('20 * f', 3)} AS t_snap_mm, {sq('400 * f', 3)} AS gap_mm, unit, CASE WHEN mm >= 1000 THEN 4 WHEN mm <= 1 THEN 2 ELSE 3 END AS decimals FROM f, (VALUES (1, 25.4), (2, 304.8), (4, 1.0), (5, 10.0), (6, 1000.0)) t(unit, mm)")
def tolerances(spark, d):
    """Tolerances that follow the drawing's extent (0.1 to 10 times those of one of 50 m), and the
    decimals kept in each of the known units."""
    e = walls(spark, d).groupBy("project_id").agg(F.greatest(F.max(F.greatest("x0", "x1")) - F.min(F.least("x0", "x1")), F.max(F.greatest("y0", "y1")) - F.min(F.least("y0", "y1"))).alias("extent"))
    f = F.greatest(F.lit(0.1), F.least(F.lit(10.0), C("extent") / 50_000.0))
    by = {"merge_mm": 10, "snap_mm": 5, "t_snap_mm": 20, "gap_mm": 400}
    units = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.lit(mm).alias("mm")) for u, mm in scalar.UNIT_MM.items()])).alias("u")
    rows = e.withColumn("f", f).select("project_id", *[q(C("f") * float(k), 3).alias(n) for n, k in by.items()], units)
    return rows.select("project_id", *by, "u.unit", F.when(C("u.mm") >= 1000, 4).when(C("u.mm") <= 1, 2).otherwise(3).alias("decimals"))
