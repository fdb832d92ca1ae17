"""Sources as queries, identifiers, titles, and the remaining joins, orders and composites."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import arrays, scalar
from gridloom.functions.scalar import q
from gridloom.operators import matching, topology
from gridloom.operators.graph import components
from gridloom.operators.ranks import ranked
from gridloom.operators.spatial import box_join, nearest, point_box, with_box
from gridloom.plans.base import AUDIT, EDGES, MATCH_KEY, NODES, OPENINGS, SIDES, SPACES, WALLS, audit, nodes, openings, space_sides, spaces, sq, sum_, walls, with_
from gridloom.plans.graphs import _CC, _STRUCT, _REG, _faces, _led, graph_components, placed, recursive, regions
from gridloom.plans.joins import _BRIDGE, _pt, bridge
from gridloom.session import Scratch, table
from gridloom.sources import drawings

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


# Sources


@query("s06_arc_points", with_(OPENINGS, "k AS (SELECT uuid, x0, y0, width, unnest(range(0, 13)) AS k FROM openings WHERE category = 'DOOR')") + f" SELECT uuid, k::INT AS k, {sq('x0 + width * cos(k * pi() / 24)', 2)} AS x, {sq('y0 + width * sin(k * pi() / 24)', 2)} AS y FROM k")
def arc_points(spark, d):
    """Quarter swings of doors as twelve chords."""
    o = openings(spark, d).where("category = 'DOOR'").select("uuid", F.explode(drawings.arc(C("x0"), C("y0"), C("width"), F.lit(0.0), F.lit(90.0), 12)).alias("p"))
    return o.select("uuid", "p.k", q(C("p.x"), 2).alias("x"), q(C("p.y"), 2).alias("y"))


@query("s07_chosen_blocks", "WITH b AS (SELECT project_id, block_name, count(*) + 100000 * max((contains(lower(block_name), '1') OR contains(lower(block_name), 'plan'))::INT) AS score FROM cad_entities WHERE block_name IS NOT NULL GROUP BY ALL) SELECT project_id, arg_min(block_name, (-score, block_name)) AS block_name, max(score) AS score FROM b GROUP BY project_id")
def chosen_blocks(spark, d):
    """The block that stands for an empty drawing: its size, with a lead for keywords."""
    key = scalar.has_any(F.lower("block_name"), ("1", "plan")).cast("int")
    b = table(spark, d, "cad_entities").where("block_name IS NOT NULL").groupBy("project_id", "block_name").agg((count() + F.max(key) * 100_000).alias("score"))
    return b.groupBy("project_id").agg(F.min_by("block_name", F.struct(-C("score"), "block_name")).alias("block_name"), F.max("score").alias("score"))


@query("s09_layer_report", "SELECT layer, count(*) AS n, count(DISTINCT entity_type) AS n_types, min(row_id) AS first_row FROM cad_entities WHERE entity_type IN ('LINE', 'ARC', 'DOOR', 'WINDOW', 'COLUMN') GROUP BY layer")
def layer_report(spark, d):
    rows = table(spark, d, "cad_entities").where(C("entity_type").isin("LINE", "ARC", "DOOR", "WINDOW", "COLUMN"))
    return rows.groupBy("layer").agg(count().alias("n"), F.count_distinct("entity_type").alias("n_types"), F.min("row_id").alias("first_row"))


@query("s11_block_names", "SELECT DISTINCT unnest(regexp_extract_all(block_name, '[a-z]+_[0-9]+')) AS name FROM cad_entities WHERE block_name IS NOT NULL")
def block_names(spark, d):
    return table(spark, d, "cad_entities").select(F.explode(F.regexp_extract_all("block_name", F.lit("[a-z]+_[0-9]+"), F.lit(0))).alias("name")).distinct()


@query("s12_json_handoff", with_(WALLS) + " SELECT uuid, x0, y0, x1, y1, thickness FROM walls")
def json_handoff(spark, d):
    """Walls through JSON text and back, with a fixed schema."""
    w = walls(spark, d).select(F.to_json(F.struct("uuid", *SEG, "thickness")).alias("j"))
    return w.select(F.from_json("j", "uuid string, x0 double, y0 double, x1 double, y1 double, thickness double").alias("r")).select("r.*")


@query("s14_canonical_json", with_(WALLS) + " SELECT uuid, '{\"thickness\":' || CAST(thickness AS BIGINT) || ',\"uuid\":\"' || uuid || '\"}' AS doc FROM walls")
def canonical_json(spark, d):
    """One JSON text per wall with sorted keys."""
    return walls(spark, d).select("uuid", F.to_json(F.struct(C("thickness").cast("long").alias("thickness"), "uuid")).alias("doc"))


@query("s20_settings", "SELECT * FROM (VALUES ('min_segment_length_mm', 1.0::DOUBLE), ('min_wall_area_mm2', 50.0::DOUBLE), ('snap_tolerance_mm', 5.0::DOUBLE)) t(name, value)")
def settings(spark, d):
    return drawings.settings(spark)


@query("s21_generated", "SELECT i AS drawing, 4 + i % 3 + 1 AS n_walls FROM range(0, 100) t(i)")
def generated(spark, d):
    """Walls in each drawing of the made-up reference set."""
    return drawings.reference_set(spark, 100).groupBy("drawing").agg(count().alias("n_walls"))


#: Tables of the drawings, whose files are inputs.
INPUTS = ("audit_entities", "bim_model", "cad_entities", "core_openings", "core_spaces", "core_walls", "geometry_edges", "geometry_nodes")


@query("s23_input_hashes", " UNION ALL ".join(f"SELECT '{t}' AS tab, count(*) AS n_rows FROM {t}" for t in INPUTS))
def input_hashes(spark, d):
    """Rows read from each input table while its files stay as they are: names, lengths and
    times of all files are hashed before and after, and a change raises. No file's content is
    gathered in one cell."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def seal(name: str) -> str:
        at = jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
        files = at.getFileSystem(conf).listFiles(at, True)
        seen = []
        while files.hasNext():
            f = files.next()
            seen.append(f"{f.getPath().getName()}|{f.getLen()}|{f.getModificationTime()}")
        return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()
    before = {t: seal(t) for t in INPUTS}
    counted = reduce(DataFrame.unionByName, [table(spark, d, t).agg(count().alias("n_rows")).select(F.lit(t).alias("tab"), "n_rows") for t in INPUTS])
    got = Scratch(spark, "inputs").save(counted)
    changed = [t for t in INPUTS if seal(t) != before[t]]
    if changed:
        raise RuntimeError(f"changed while being read: {', '.join(changed)}")
    return got


# Identifiers and texts


@query("fn12_ring_validity", with_(SPACES, SIDES, "n AS (SELECT project_id, uuid, count(*) AS k FROM sides GROUP BY ALL)", "b AS (SELECT DISTINCT a.project_id, a.uuid FROM sides a JOIN sides b ON a.project_id = b.project_id AND a.uuid = b.uuid AND b.pos > a.pos + 1 JOIN n ON n.project_id = a.project_id AND n.uuid = a.uuid WHERE NOT (a.pos = 0 AND b.pos = n.k - 1) AND ((a.x1 - a.x0) * (b.y0 - a.y0) - (a.y1 - a.y0) * (b.x0 - a.x0)) * ((a.x1 - a.x0) * (b.y1 - a.y0) - (a.y1 - a.y0) * (b.x1 - a.x0)) <= 0 AND ((b.x1 - b.x0) * (a.y0 - b.y0) - (b.y1 - b.y0) * (a.x0 - b.x0)) * ((b.x1 - b.x0) * (a.y1 - b.y0) - (b.y1 - b.y0) * (a.x1 - b.x0)) <= 0)") + " SELECT s.uuid, NOT EXISTS (SELECT 1 FROM b WHERE b.project_id = s.project_id AND b.uuid = s.uuid) AS is_valid FROM spaces s")
def ring_validity(spark, d):
    """Whether a ring's sides meet only at neighbours."""
    v = spaces(spark, d).select("uuid", arrays.sides(C("v"), True).alias("s"))
    def meets(a: Column, b: Column) -> Column:
        side = lambda o, p, r: (o["x1"] - o["x0"]) * (r - o["y0"]) - (o["y1"] - o["y0"]) * (p - o["x0"])
        return (side(a, b["x0"], b["y0"]) * side(a, b["x1"], b["y1"]) <= 0) & (side(b, a["x0"], a["y0"]) * side(b, a["x1"], a["y1"]) <= 0)
    n = F.size("s")
    apart = lambda a, b: (b["pos"] > a["pos"] + 1) & ~((a["pos"] == 0) & (b["pos"] == n - 1))
    return v.select("uuid", (~F.exists("s", lambda a: F.exists("s", lambda b: apart(a, b) & meets(a, b)))).alias("is_valid"))


def uuid5(name: Column, space: str = "6ba7b810-9dad-11d1-80b4-00c04fd430c8") -> Column:
    """The name-based UUID of version 5 under a namespace, by SHA-1."""
    h = F.sha1(F.concat(F.unhex(F.lit(space.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


@query("fn27_uuid5", "WITH h AS (SELECT row_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(concat_ws('_', entity_type, row_id))) AS h FROM cad_entities) SELECT row_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ((position(substr(h, 17, 1) IN '0123456789abcdef') - 1) % 4 + 1)::INT, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM h")
def uuids(spark, d):
    """Name-based ids of entities; checked against a library in the tests."""
    return table(spark, d, "cad_entities").select("row_id", uuid5(F.concat_ws("_", C("entity_type"), C("row_id").cast("string"))).alias("uuid"))


# Kinds of titles, by words in their match key, first match first.
TITLES = (("site", ("VAZIYET", "SITE LAYOUT", "LAGEPLAN", "IMPLANTACAO")), ("section", ("KESIT", "SECTION", "SCHNITT", "CORTE", "REZ ")), ("elevation", ("CEPHE", "GORUNUS", "ELEVATION", "ANSICHT", "ALCADO", "POHLED")), ("roof", ("CATI", "ROOF", "COBERTURA")), ("floor", ("KAT PLANI", "FLOOR PLAN", "LEVEL", "GRUNDRISS", "PLANTA", "PUDORYS", "GRUNNMYND")))
_TKEY = MATCH_KEY


@query("fn18_title_kinds", with_(AUDIT, f"k AS (SELECT project_id, source_id, {_TKEY} AS k FROM audit WHERE audit_role = 'title' AND text IS NOT NULL)") + " SELECT project_id, source_id, CASE " + " ".join("WHEN " + " OR ".join(f"contains(k, '{w}')" for w in words) + f" THEN '{name}'" for name, words in TITLES) + " END AS kind FROM k")
def title_kinds(spark, d):
    k = audit(spark, d).where("audit_role = 'title' AND text IS NOT NULL").withColumn("k", scalar.match_key(C("text")))
    return k.select("project_id", "source_id", scalar.ladder(C("k"), TITLES, None).alias("kind"))


@query("fn21_text_weights", with_(AUDIT) + f" SELECT project_id, source_id, {sq('greatest(0.3::DOUBLE, 1 - least(min_x, 50000) / 50000) * least(2.0::DOUBLE, (max_y - min_y) / 100)', 5)} AS weight FROM audit WHERE text IS NOT NULL AND min_x IS NOT NULL")
def text_weights(spark, d):
    """Weight of a text by its nearness to the corner and its height."""
    near = F.greatest(F.lit(0.3), F.lit(1.0) - F.least(C("min_x"), F.lit(50_000.0)) / 50_000.0)
    size = F.least(F.lit(2.0), (C("max_y") - C("min_y")) / 100.0)
    return audit(spark, d).where("text IS NOT NULL AND min_x IS NOT NULL").select("project_id", "source_id", q(near * size, 5).alias("weight"))


_SWEPT = "sw AS (SELECT project_id, source_id, entity_type, len_mm, greatest(max_x - min_x, max_y - min_y) AS r FROM audit WHERE entity_type IN ('ARC', 'LINE', 'LWPOLYLINE'))"


@query("fn22_door_types", with_(AUDIT, _SWEPT) + " SELECT project_id, source_id, CASE WHEN entity_type = 'ARC' AND r > 0 AND degrees(len_mm / r) BETWEEN 170 AND 190 THEN 'Double' ELSE 'Single' END AS kind FROM sw")
def door_types(spark, d):
    """Double for arcs that turn through 170 to 190 degrees, Single for all others. The tables have
    no angles: an arc's sweep is its length over its radius, taken as its box's longer side."""
    kind = C("entity_type")
    r = F.greatest(C("max_x") - C("min_x"), C("max_y") - C("min_y"))
    rows = audit(spark, d).where(kind.isin("ARC", "LINE", "LWPOLYLINE"))
    double = (kind == "ARC") & (r > 0) & F.degrees(C("len_mm") / F.nullif(r, F.lit(0.0))).between(170, 190)
    return rows.select("project_id", "source_id", F.when(double, "Double").otherwise("Single").alias("kind"))


@query("fn28_fingerprints", with_(AUDIT) + " SELECT project_id, source_id, sha256(concat_ws('|', entity_type, coalesce(layer, ''), printf('%.4f', min_x), printf('%.4f', min_y), printf('%.4f', max_x), printf('%.4f', max_y))) AS fingerprint FROM audit WHERE min_x IS NOT NULL")
def fingerprints(spark, d):
    f4 = lambda c: F.format_string("%.4f", C(c))
    parts = [C("entity_type"), F.coalesce("layer", F.lit("")), f4("min_x"), f4("min_y"), f4("max_x"), f4("max_y")]
    return audit(spark, d).where("min_x IS NOT NULL").select("project_id", "source_id", F.sha2(F.concat_ws("|", *parts), 256).alias("fingerprint"))


# Joins


@query("j18_by_ordinal", with_(SPACES, OPENINGS, "s AS (SELECT project_id, uuid, row_number() OVER (PARTITION BY project_id ORDER BY uuid) AS i FROM spaces)", "o AS (SELECT project_id, uuid, row_number() OVER (PARTITION BY project_id ORDER BY uuid) AS i FROM openings)") + " SELECT o.uuid AS opening, s.uuid AS space FROM o JOIN s USING (project_id, i)")
def by_ordinal(spark, d):
    """Elements matched by their place in the model."""
    s = ranked(spaces(spark, d).select("project_id", C("uuid").alias("space")), ["project_id"], ["space"], "i")
    o = ranked(openings(spark, d).select("project_id", C("uuid").alias("opening")), ["project_id"], ["opening"], "i")
    return o.join(s, ["project_id", "i"]).select("opening", "space")


@query("j32_provenance", with_(WALLS, SPACES, SIDES, f"h AS (SELECT s.project_id, s.uuid, s.pos, w.uuid AS wall FROM sides s JOIN walls w ON s.project_id = w.project_id AND {_pt('s.x0', 's.y0', 'w')} <= 0.01 AND {_pt('s.x1', 's.y1', 'w')} <= 0.01)") + " SELECT uuid, pos, CASE WHEN count(*) = 1 THEN min(wall) ELSE 'UNKNOWN' END AS wall_uuid FROM h GROUP BY project_id, uuid, pos")
def provenance(spark, d):
    """The one wall on which both ends of a side lie."""
    pairs = box_join(with_box(space_sides(spark, d)), with_box(walls(spark, d).select("project_id", "uuid", *SEG)), ["project_id"], 5000.0, 0.01)
    wall = matching.cols(matching.B)
    on = (scalar.to_segment(C("x0"), C("y0"), *wall) <= 0.01) & (scalar.to_segment(C("x1"), C("y1"), *wall) <= 0.01)
    g = pairs.where(on).groupBy("project_id", "uuid", "pos").agg(count().alias("n"), F.min("r_uuid").alias("w"))
    return g.select("uuid", "pos", F.when(C("n") == 1, C("w")).otherwise("UNKNOWN").alias("wall_uuid"))


@query("j33_nearest_component", "WITH RECURSIVE " + ", ".join([NODES, EDGES, _CC]) + f", p AS (SELECT cc.project_id, component AS k, n, x, y FROM cc JOIN nodes ON nodes.project_id = cc.project_id AND node_id = n WHERE x IS NOT NULL AND y IS NOT NULL), m AS (SELECT a.project_id, a.k, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d FROM p a JOIN p b ON a.project_id = b.project_id AND a.k <> b.k GROUP BY ALL) SELECT project_id, k AS component, {sq('d', 3)} AS distance FROM m")
def nearest_component(spark, d):
    """How far each component is from the next one: the nearest node of another component,
    looked for outward from every node."""
    cc = Scratch(spark, "component").save(graph_components(spark, d).join(nodes(spark, d).dropna(subset=["x", "y"]), ["project_id", "node_id"]).select("project_id", "node_id", "component", "x", "y"))
    several = cc.groupBy("project_id").agg(F.count_distinct("component").alias("k")).where("k > 1").select("project_id")
    p = cc.join(several, "project_id", "left_semi")
    other = F.when(C("component") == C("r_component"), F.lit(1e300)).otherwise(scalar.dist(C("x"), C("y"), C("r_x"), C("r_y")))
    got = nearest(p, point_box(p.select("project_id", "component", "x", "y"), "x", "y"), ["project_id"], ["project_id", "component"], C("r_component"), [], 1_000.0, distance=other)
    return got.select("project_id", "component", q(C("distance"), 3).alias("distance"))


@query("j34_complete_spaces", with_(WALLS, _BRIDGE) + " SELECT b.project_id, b.space_uuid FROM bridge b LEFT JOIN walls w ON w.project_id = b.project_id AND w.uuid = b.wall_uuid GROUP BY ALL HAVING count(*) = count(w.uuid)")
def complete_spaces(spark, d):
    """Spaces of which every named wall exists (relational division)."""
    w = walls(spark, d).select("project_id", C("uuid").alias("wall_uuid"), F.lit(1).alias("there"))
    g = bridge(spark, d).join(w, ["project_id", "wall_uuid"], "left").groupBy("project_id", "space_uuid").agg(count().alias("n"), F.count("there").alias("k"))
    return g.where("n = k").select("project_id", "space_uuid")


# Orders


@query("o06_element_order", with_(WALLS, OPENINGS, "e AS (SELECT project_id, 'Wall' AS kind, uuid, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM walls UNION ALL SELECT project_id, CASE category WHEN 'DOOR' THEN 'Door' ELSE 'Window' END, uuid, (x0 + x1) / 2, (y0 + y1) / 2 FROM openings)") + f" SELECT uuid, row_number() OVER (PARTITION BY project_id ORDER BY kind, {sq('cx', 3)}, {sq('cy', 3)}, uuid) AS ord FROM e")
def element_order(spark, d):
    mid = lambda df, kind: df.select("project_id", kind.alias("kind"), "uuid", q((C("x0") + C("x1")) / 2, 3).alias("cx"), q((C("y0") + C("y1")) / 2, 3).alias("cy"))
    e = mid(walls(spark, d), F.lit("Wall")).unionByName(mid(openings(spark, d), F.when(C("category") == "DOOR", "Door").otherwise("Window")))
    return ranked(e, ["project_id"], ["kind", "cx", "cy", "uuid"]).select("uuid", "ord")


@query("o12_region_order", "WITH RECURSIVE " + ", ".join([AUDIT, _STRUCT, _REG]) + ", b AS (SELECT rg.project_id, component AS region, min(min_x) AS min_x, min(min_y) AS min_y FROM rg JOIN st ON st.project_id = rg.project_id AND st.n = rg.n GROUP BY ALL) SELECT project_id, region, row_number() OVER (PARTITION BY project_id ORDER BY min_x, min_y, region) AS ord FROM b")
def region_order(spark, d):
    r = Scratch(spark, "regions").save(regions(spark, d).select("project_id", "region", "min_x", "min_y"))
    return ranked(r, ["project_id"], ["min_x", "min_y", "region"]).select("project_id", "region", "ord")


@query("o02_wall_entity_order", "SELECT row_id, row_number() OVER (PARTITION BY project_id ORDER BY layer, coalesce(block_name, ''), entity_type, coalesce(start_pt, ''), coalesce(end_pt, ''), row_id) AS ord FROM cad_entities WHERE (" + " OR ".join(f"contains(lower(layer), '{w}')" for w in scalar.WALL_WORDS) + ") AND NOT (" + " OR ".join(f"contains(lower(layer), '{w}')" for w in scalar.NO_WALL_WORDS) + ")")
def wall_entity_order(spark, d):
    """Entities on wall layers in their canonical order."""
    e = lambda c: F.coalesce(c, F.lit("")).alias(c)
    rows = table(spark, d, "cad_entities").where(scalar.is_wall_layer(C("layer"))).select("project_id", "row_id", "layer", e("block_name"), "entity_type", e("start_pt"), e("end_pt"))
    return ranked(rows, ["project_id"], ["layer", "block_name", "entity_type", "start_pt", "end_pt", "row_id"]).select("row_id", "ord")


_SER = "'{\"angle\": ' || coalesce(printf('%.4f', angle), 'null') || ', \"from\": \"' || least(from_id::VARCHAR, to_id::VARCHAR) || '\", \"id\": ' || edge_id || ', \"length\": ' || coalesce(printf('%.4f', len_mm), 'null') || ', \"to\": \"' || greatest(from_id::VARCHAR, to_id::VARCHAR) || '\"}'"


@query("x08_least_serialised", f"SELECT project_id, least(from_id::VARCHAR, to_id::VARCHAR) AS a, greatest(from_id::VARCHAR, to_id::VARCHAR) AS b, arg_min(edge_id, {_SER}) AS edge_id, count(*) AS n FROM geometry_edges WHERE from_id IS NOT NULL AND to_id IS NOT NULL AND from_id <> to_id AND edge_id IS NOT NULL GROUP BY ALL")
def least_serialised(spark, d):
    """Of the edges between two nodes, in either direction, the one whose text with sorted keys comes first."""
    e = table(spark, d, "geometry_edges").where("from_id IS NOT NULL AND to_id IS NOT NULL AND from_id <> to_id AND edge_id IS NOT NULL")
    f, t = C("from_id").cast("string"), C("to_id").cast("string")
    num = lambda c: F.when(C(c).isNull(), "null").otherwise(F.format_string("%.4f", C(c)))
    text = F.concat(F.lit('{"angle": '), num("angle"), F.lit(', "from": "'), C("a"), F.lit('", "id": '), C("edge_id").cast("string"), F.lit(', "length": '), num("len_mm"), F.lit(', "to": "'), C("b"), F.lit('"}'))
    return e.withColumns({"a": F.least(f, t), "b": F.greatest(f, t)}).groupBy("project_id", "a", "b").agg(F.min_by("edge_id", text).alias("edge_id"), count().alias("n"))


_ENDS = "en AS (SELECT project_id, x, y, count(*) AS k FROM (SELECT project_id, x0 AS x, y0 AS y FROM walls UNION ALL SELECT project_id, x1, y1 FROM walls) GROUP BY ALL)"
_WKEY = "CASE WHEN (x0, y0) <= (x1, y1) THEN (x0, y0, x1, y1) ELSE (x1, y1, x0, y0) END"


@query("fn24_wall_kinds", with_(WALLS, SPACES, SIDES, _ENDS, f"fc AS (SELECT project_id, {_WKEY} AS k, count(DISTINCT uuid) AS n FROM sides GROUP BY ALL)", f"wl AS (SELECT *, {_WKEY} AS k FROM walls)") + """ SELECT w.project_id, w.uuid, CASE WHEN coalesce(fc.n, 0) = 1 THEN 'External Wall' WHEN fc.n >= 2 THEN 'Internal Wall' ELSE 'Wall segment' END AS sub_type,
 CASE WHEN a.k >= 2 AND b.k >= 2 THEN 'Continuous' ELSE 'Dangling' END AS continuity, CASE WHEN coalesce(fc.n, 0) = 1 THEN 0.9 WHEN fc.n >= 2 THEN 0.95 ELSE 0.7 END::DOUBLE AS confidence
 FROM wl w LEFT JOIN fc ON fc.project_id = w.project_id AND fc.k = w.k JOIN en a ON a.project_id = w.project_id AND a.x = w.x0 AND a.y = w.y0 JOIN en b ON b.project_id = w.project_id AND b.x = w.x1 AND b.y = w.y1""")
def wall_kinds(spark, d):
    """A wall's sub-type and confidence by how many spaces it bounds, its continuity by the walls at its ends."""
    w = walls(spark, d).select("project_id", "uuid", *SEG)
    p, r = F.struct(C("x0").alias("x"), C("y0").alias("y")), F.struct(C("x1").alias("x"), C("y1").alias("y"))
    key = [F.least(p, r).alias("a"), F.greatest(p, r).alias("b")]
    n = space_sides(spark, d).select("project_id", "uuid", *key).groupBy("project_id", "a", "b").agg(F.count_distinct("uuid").alias("n"))
    ends = w.select("project_id", F.explode(F.array(p, r)).alias("p")).groupBy("project_id", "p").agg(count().alias("k"))
    at = lambda c: ends.select("project_id", C("p").alias(c), C("k").alias(f"k{c}"))
    w = w.select("project_id", "uuid", *key).join(n, ["project_id", "a", "b"], "left").join(at("a"), ["project_id", "a"]).join(at("b"), ["project_id", "b"])
    n = F.coalesce("n", F.lit(0))
    return w.select("project_id", "uuid", F.when(n == 1, "External Wall").when(n >= 2, "Internal Wall").otherwise("Wall segment").alias("sub_type"), F.when((C("ka") >= 2) & (C("kb") >= 2), "Continuous").otherwise("Dangling").alias("continuity"), F.when(n == 1, 0.9).when(n >= 2, 0.95).otherwise(0.7).alias("confidence"))


#: Fields of a model file that change from run to run without its content changing.
VOLATILE = ("record_id", "revision", "generated_at", "received_at")


@query("fn30_stable_hashes", "SELECT record_id, sha256(concat_ws('|', coalesce(project_id, ''), coalesce(walls, ''), coalesce(spaces, ''))) AS seal, count(*) OVER (PARTITION BY sha256(concat_ws('|', coalesce(project_id, ''), coalesce(walls, ''), coalesce(spaces, '')))) AS n_same FROM bim_model")
def stable_hashes(spark, d):
    """Hashes of model files without their volatile fields, and how many files share each."""
    m = table(spark, d, "bim_model")
    kept = [F.coalesce(c, F.lit("")) for c in m.columns if c not in VOLATILE]
    h = m.select("record_id", F.sha2(F.concat_ws("|", *kept), 256).alias("seal"))
    return h.join(h.groupBy("seal").agg(count().alias("n_same")), "seal").select("record_id", "seal", "n_same")


# Composites


_LAYERCC = recursive("lc", "SELECT DISTINCT project_id || '|' || wall_type AS project_id, uuid AS n FROM walls", "SELECT a.project_id || '|' || a.wall_type AS project_id, a.uuid AS a, b.uuid AS b FROM walls a JOIN walls b ON a.project_id = b.project_id AND a.wall_type = b.wall_type AND a.uuid < b.uuid AND ((a.x0 = b.x0 AND a.y0 = b.y0) OR (a.x0 = b.x1 AND a.y0 = b.y1) OR (a.x1 = b.x0 AND a.y1 = b.y0) OR (a.x1 = b.x1 AND a.y1 = b.y1))")


@query("g14_per_view_components", "WITH RECURSIVE " + ", ".join([WALLS, _LAYERCC]) + " SELECT split_part(project_id, '|', 1) AS project_id, split_part(project_id, '|', 2) AS wall_type, count(DISTINCT component) AS n FROM lc GROUP BY ALL")
def per_view_components(spark, d):
    """Connected walls of each type by themselves: the same operator with the view in its key."""
    w = walls(spark, d)
    ends = w.select("project_id", "wall_type", "uuid", F.explode(F.array(F.struct(C("x0").alias("x"), C("y0").alias("y")), F.struct(C("x1").alias("x"), C("y1").alias("y")))).alias("p"))
    hub = ends.groupBy("project_id", "wall_type", "p").agg(F.min("uuid").alias("a"))
    pairs = ends.join(hub, ["project_id", "wall_type", "p"]).select("project_id", "wall_type", "a", C("uuid").alias("b"))
    cc = components(w, pairs, ["project_id", "wall_type", "uuid"])
    return cc.groupBy("project_id", "wall_type").agg(F.count_distinct("component").alias("n"))


@query("a23_run_summary", with_(SPACES, WALLS) + f", p AS (SELECT w.project_id, w.n AS nw, coalesce(s.n, 0) AS ns FROM (SELECT project_id, count(*) AS n FROM walls GROUP BY ALL) w LEFT JOIN (SELECT project_id, count(*) AS n FROM spaces GROUP BY ALL) s USING (project_id)) SELECT count(*) AS n_projects, count(*) FILTER (ns > 0) AS n_ok, {sq('avg((ns > 0)::INT::DOUBLE)', 6)} AS rate, {sq('avg(nw::DOUBLE)', 4)} AS mean_walls FROM p")
def run_summary(spark, d):
    w = walls(spark, d).groupBy("project_id").agg(count().alias("nw"))
    s = spaces(spark, d).groupBy("project_id").agg(count().alias("ns"))
    p = w.join(s, "project_id", "left").withColumn("ok", F.coalesce("ns", F.lit(0)) > 0)
    return p.agg(count().alias("n_projects"), F.count_if("ok").alias("n_ok"), q(F.avg(C("ok").cast("double")), 6).alias("rate"), q(F.avg(C("nw").cast("double")), 4).alias("mean_walls"))


@query("c06_rooms", with_(SPACES, SIDES) + f" SELECT project_id, count(*) AS n_rooms, {sq(sum_('a', 1), 0)} AS area FROM (SELECT project_id, uuid, (max(x0) - min(x0)) * (max(y0) - min(y0)) AS a FROM sides GROUP BY ALL) WHERE a >= 5000 GROUP BY project_id")
def rooms(spark, d):
    """Rooms found from walls alone, without small faces."""
    return _faces(spark, d).where("area >= 5000").groupBy("project_id").agg(count().alias("n_rooms"), q(scalar.exact_sum(C("area"), 1), 0).alias("area"))


@query("c07_openings_in_rooms", with_(OPENINGS, SPACES, SIDES, "b AS (SELECT project_id, uuid, min(x0) AS ax, min(y0) AS ay, max(x0) AS bx, max(y0) AS b_y FROM sides GROUP BY ALL)") + " SELECT o.uuid, o.category, min(b.uuid) AS room FROM openings o LEFT JOIN b ON b.project_id = o.project_id AND (o.x0 + o.x1) / 2 BETWEEN ax - 10 AND bx + 10 AND (o.y0 + o.y1) / 2 BETWEEN ay - 10 AND b_y + 10 GROUP BY ALL")
def openings_in_rooms(spark, d):
    o = openings(spark, d).withColumns({"x": (C("x0") + C("x1")) / 2, "y": (C("y0") + C("y1")) / 2}).select("project_id", "uuid", "category", "x", "y")
    b = spaces(spark, d).select("project_id", "uuid", arrays.bounds(C("v")).alias("b")).select("project_id", "uuid", "b.*")
    hit = box_join(point_box(o, "x", "y"), b, ["project_id"], 5000.0, 10.0).groupBy("project_id", "uuid").agg(F.min("r_uuid").alias("room"))
    return o.join(hit, ["project_id", "uuid"], "left").select("uuid", "category", "room")


@query("v10_content_hashes", "SELECT project_id, count(*) AS n, bit_xor(('0x' || substr(md5(uuid || '|' || wall_id), 1, 15))::BIGINT) AS seal FROM (SELECT DISTINCT project_id, uuid, wall_id FROM core_walls) GROUP BY project_id")
def content_hashes(spark, d):
    """A seal of each project's walls that is the same in any order."""
    w = table(spark, d, "core_walls").select("project_id", "uuid", "wall_id").distinct()
    h = F.conv(F.substring(F.md5(F.concat_ws("|", "uuid", C("wall_id").cast("string"))), 1, 15), 16, 10).cast("long")
    return w.groupBy("project_id").agg(count().alias("n"), F.bit_xor(h).alias("seal"))


@query("fn16_exact_texts", "SELECT row_id, trim(regexp_replace(nfc_normalize(text), '[ \\t\\n\\r]+', ' ', 'g'), ' ') AS text FROM audit_entities WHERE text IS NOT NULL")
def exact_texts(spark, d):
    from gridloom.functions.text import exact_text

    return table(spark, d, "audit_entities").where("text IS NOT NULL").select("row_id", exact_text(C("text")).alias("text"))


# Labels of levels.
LEVELS = {"ground": "Ground Floor", "floor": "Typical Floor", "roof": "Roof Plan"}


@query("fn20_level_labels", "SELECT * FROM (VALUES ('ground', 'Ground Floor'), ('floor', 'Typical Floor'), ('roof', 'Roof Plan')) t(level, label)")
def level_labels(spark, d):
    names = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])
    return spark.createDataFrame([(k,) for k in LEVELS], "level string").select("level", names[C("level")].alias("label"))


@query("s10_segmentation_scan", with_(AUDIT) + " SELECT project_id, source_id, entity_type, CASE WHEN entity_type IN ('TEXT', 'MTEXT') THEN 'text' ELSE 'geometry' END AS part, max_x - min_x AS width, max_y - min_y AS height FROM audit WHERE entity_type <> 'INSERT'")
def segmentation_scan(spark, d):
    part = F.when(C("entity_type").isin("TEXT", "MTEXT"), "text").otherwise("geometry")
    return audit(spark, d).where("entity_type <> 'INSERT'").select("project_id", "source_id", "entity_type", part.alias("part"), (C("max_x") - C("min_x")).alias("width"), (C("max_y") - C("min_y")).alias("height"))


@query("s22_synthetic", "SELECT kind, n FROM (VALUES ('line', 6000::BIGINT), ('tiny', 2000::BIGINT), ('point', 2000::BIGINT)) t(kind, n)")
def synthetic(spark, d):
    return drawings.synthetic(spark, 10_000).groupBy("kind").agg(count().alias("n"))


@query("g02_leader_counts", _led(2000) + " SELECT project_id, count(DISTINCT leader) AS n_leaders, count(*) AS n_points FROM ld GROUP BY project_id")
def leader_counts(spark, d):
    """Points left when each one near an earlier leader joins it."""
    n = nodes(spark, d).dropna(subset=["x", "y"])
    return topology.snap_to_leaders(placed(n), 2000.0).groupBy("project_id").agg(F.count_distinct("leader").alias("n_leaders"), count().alias("n_points"))


_TALL = "tall AS (SELECT project_id, uuid, x0 + 300 AS x, greatest(y0, y1) + 7 AS top FROM openings WHERE x0 = x1), flat AS (SELECT project_id, uuid, least(x0, x1) AS a, greatest(x0, x1) AS b, y0 AS y FROM walls WHERE y0 = y1)"


@query("g16_axis_extend", with_(WALLS, OPENINGS, _TALL, "k AS (SELECT t.uuid, t.x, f.uuid AS wall, f.y, row_number() OVER (PARTITION BY t.project_id, t.uuid ORDER BY abs(t.top - f.y), f.uuid) AS n FROM tall t JOIN flat f ON f.project_id = t.project_id AND t.x BETWEEN a AND b AND abs(t.top - f.y) > 0 AND abs(t.top - f.y) <= 20)") + " SELECT uuid, wall, y AS new_top FROM k WHERE n = 1")
def axis_extend(spark, d):
    """Upright segments whose top ends within 20 of a level wall, extended or cut to it."""
    t = openings(spark, d).where("x0 = x1").select("project_id", "uuid", (C("x0") + 300).alias("x"), (F.greatest("y0", "y1") + 7).alias("y"))
    f = with_box(walls(spark, d).where("y0 = y1").select("project_id", "uuid", *SEG))
    p = box_join(point_box(t, "x", "y"), f, ["project_id"], 5000.0, 20.0).withColumn("gap", F.abs(C("y") - C("r_y0")))
    p = p.where((C("gap") > 0) & (C("gap") <= 20) & C("x").between(C("r_min_x"), C("r_max_x")))
    from gridloom.operators.spatial import best

    return best(p, ["project_id", "uuid"], [C("gap"), C("r_uuid")], ["r_uuid", "r_y0"]).select("uuid", C("r_uuid").alias("wall"), C("r_y0").alias("new_top"))


@query("c01_sheet_parts", with_(WALLS, "c AS (SELECT project_id, uuid, greatest(y0, y1) AS hi, least(y0, y1) AS lo FROM walls)", "g AS (SELECT *, max(hi) OVER (PARTITION BY project_id ORDER BY lo, hi, uuid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c)", "p AS (SELECT *, sum(CASE WHEN lo > reach + 2000 THEN 1 ELSE 0 END) OVER (PARTITION BY project_id ORDER BY lo, hi, uuid ROWS UNBOUNDED PRECEDING) AS part FROM g)") + " SELECT project_id, part::INT AS part, count(*) AS n, min(lo) AS lo, max(hi) AS hi FROM p GROUP BY ALL")
def sheet_parts(spark, d):
    """A sheet cut into parts at empty bands of more than 2000. Walls that begin within one band
    of 2000 are never parted, so that bands are cut, of which a sheet has few."""
    w = Window.partitionBy("project_id").orderBy("lo")
    c = walls(spark, d).select("project_id", F.least("y0", "y1").alias("lo"), F.greatest("y0", "y1").alias("hi"))
    c = c.groupBy("project_id", F.floor(C("lo") / 2000)).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), count().alias("k")).select("project_id", "lo", "hi", "k")
    g = c.withColumn("reach", F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    p = g.withColumn("part", F.sum(F.when(C("lo") > C("reach") + 2000, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return p.groupBy("project_id", "part").agg(F.sum("k").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


@query("c03_title_catalog", with_(AUDIT, f"k AS (SELECT project_id, {_TKEY} AS k FROM audit WHERE audit_role = 'title' AND text IS NOT NULL)", "c AS (SELECT project_id, CASE " + " ".join("WHEN " + " OR ".join(f"contains(k, '{w}')" for w in words) + f" THEN '{name}'" for name, words in TITLES) + " END AS kind FROM k)", "x AS (SELECT k.kind, p.project_id, count(c.kind) AS n FROM (VALUES " + ", ".join(f"('{n}')" for n, _ in TITLES) + ") k(kind) CROSS JOIN (SELECT DISTINCT project_id FROM c) p LEFT JOIN c ON c.project_id = p.project_id AND c.kind = k.kind GROUP BY ALL)") + " SELECT project_id, count(*) FILTER (n = 0) AS n_missing, count(*) FILTER (n > 1) AS n_double, CASE WHEN count(*) FILTER (n <> 1) = 0 THEN 'ok' ELSE 'title_catalog_mismatch' END AS state FROM x GROUP BY project_id")
def title_catalog(spark, d):
    """Whether a project has each kind of title once."""
    k = audit(spark, d).where("audit_role = 'title' AND text IS NOT NULL").select("project_id", scalar.ladder(scalar.match_key(C("text")), TITLES, None).alias("kind"))
    names = [n for n, _ in TITLES]
    g = k.groupBy("project_id").agg(*[F.count_if(C("kind") == n).alias(f"k_{n}") for n in names])
    total = lambda f: sum((f(C(f"k_{n}")).cast("long") for n in names[1:]), f(C(f"k_{names[0]}")).cast("long"))
    g = g.withColumns({"n_missing": total(lambda c: c == 0), "n_double": total(lambda c: c > 1)})
    return g.select("project_id", "n_missing", "n_double", F.when((C("n_missing") == 0) & (C("n_double") == 0), "ok").otherwise("title_catalog_mismatch").alias("state"))


@query("c05_separators", with_(WALLS, "e AS (SELECT project_id, min(least(x0, x1)) AS a, max(greatest(x0, x1)) AS b, (min(least(y0, y1)) + max(greatest(y0, y1))) / 2 AS mid FROM walls GROUP BY project_id)", "k AS (SELECT w.project_id, w.uuid, row_number() OVER (PARTITION BY w.project_id ORDER BY abs(w.y0 - mid), w.uuid) AS n FROM walls w JOIN e USING (project_id) WHERE w.y0 = w.y1 AND abs(w.x1 - w.x0) >= 0.2::DOUBLE * (b - a))") + " SELECT project_id, uuid FROM k WHERE n = 1")
def separators(spark, d):
    """The level wall of some width that lies nearest to the middle of its sheet."""
    w = walls(spark, d)
    e = w.groupBy("project_id").agg(F.min(F.least("x0", "x1")).alias("a"), F.max(F.greatest("x0", "x1")).alias("b"), ((F.min(F.least("y0", "y1")) + F.max(F.greatest("y0", "y1"))) / 2).alias("mid"))
    k = w.where("y0 = y1").join(e, "project_id").where(F.abs(C("x1") - C("x0")) >= F.lit(0.2) * (C("b") - C("a")))
    return k.groupBy("project_id").agg(F.min_by("uuid", F.struct(F.abs(C("y0") - C("mid")), "uuid")).alias("uuid"))
