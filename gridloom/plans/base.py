"""Drawing tables as the operators take them, and the same as SQL for the comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import arrays
from gridloom.session import table


def walls(spark: SparkSession, d: str) -> DataFrame:
    """Each wall once, with the ends of its axis."""
    p = lambda i, k: F.get(F.get("points", F.lit(i)), F.lit(k))
    return table(spark, d, "core_walls").select("project_id", "uuid", "wall_id", "wall_type", "thickness", "angle", p(0, 0).alias("x0"), p(0, 1).alias("y0"), p(1, 0).alias("x1"), p(1, 1).alias("y1"), "created_at", "deleted_at").distinct()


WALLS = "walls AS (SELECT DISTINCT project_id, uuid, wall_id, wall_type, thickness, angle, points[1][1] AS x0, points[1][2] AS y0, points[2][1] AS x1, points[2][2] AS y1, created_at, deleted_at FROM core_walls)"


def openings(spark: SparkSession, d: str) -> DataFrame:
    p = lambda i, k: F.get(F.get("points", F.lit(i)), F.lit(k))
    return table(spark, d, "core_openings").select("project_id", "uuid", "category", "layer", "width", "parent_wall", p(0, 0).alias("x0"), p(0, 1).alias("y0"), p(1, 0).alias("x1"), p(1, 1).alias("y1")).distinct()


OPENINGS = "openings AS (SELECT DISTINCT project_id, uuid, category, layer, width, parent_wall, points[1][1] AS x0, points[1][2] AS y0, points[2][1] AS x1, points[2][2] AS y1 FROM core_openings)"


def spaces(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "core_spaces").select("project_id", "uuid", "area_raw", "polygon").distinct().withColumn("v", arrays.xy(F.col("polygon"))).drop("polygon")


SPACES = "spaces AS (SELECT DISTINCT project_id, uuid, area_raw, polygon FROM core_spaces)"
#: One row for each side of each space, closing side included.
SIDES = "sides AS (SELECT project_id, uuid, (i - 1)::INT AS pos, polygon[i][1] AS x0, polygon[i][2] AS y0, polygon[i % len(polygon) + 1][1] AS x1, polygon[i % len(polygon) + 1][2] AS y1 FROM (SELECT *, unnest(range(1, len(polygon) + 1)) AS i FROM spaces))"


def space_sides(spark: SparkSession, d: str) -> DataFrame:
    one = spaces(spark, d).select("project_id", "uuid", F.explode(arrays.sides(F.col("v"), True)).alias("s"))
    return one.select("project_id", "uuid", "s.*")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Each node once; of repeated deliveries the first."""
    w = Window.partitionBy("project_id", "node_id").orderBy("loaded_at", "x_mm", "y_mm", "degree", "node_type")
    rows = table(spark, d, "geometry_nodes").where("node_id IS NOT NULL")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("project_id", "node_id", F.col("x_mm").alias("x"), F.col("y_mm").alias("y"), "degree", "node_type")


NODES = "nodes AS (SELECT project_id, node_id, x_mm AS x, y_mm AS y, degree, node_type FROM (SELECT *, row_number() OVER (PARTITION BY project_id, node_id ORDER BY loaded_at, x_mm, y_mm, degree NULLS FIRST, node_type NULLS FIRST) AS n FROM geometry_nodes WHERE node_id IS NOT NULL) WHERE n = 1)"


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of which both ends are nodes, self loops included."""
    n = nodes(spark, d).select("project_id", "node_id")
    e = table(spark, d, "geometry_edges").select("project_id", "edge_id", "from_id", "to_id", "len_mm", "angle")
    e = e.join(n.withColumnRenamed("node_id", "from_id"), ["project_id", "from_id"], "left_semi")
    return e.join(n.withColumnRenamed("node_id", "to_id"), ["project_id", "to_id"], "left_semi").select("project_id", "edge_id", "from_id", "to_id", "len_mm", "angle")


EDGES = "edges AS (SELECT e.project_id, edge_id, from_id, to_id, len_mm, angle FROM geometry_edges e SEMI JOIN nodes a ON a.project_id = e.project_id AND a.node_id = from_id SEMI JOIN nodes b ON b.project_id = e.project_id AND b.node_id = to_id)"


def audit(spark: SparkSession, d: str) -> DataFrame:
    """Each audited entity once per source, the first delivery."""
    w = Window.partitionBy("project_id", "source_id").orderBy("loaded_at", "row_id")
    rows = table(spark, d, "audit_entities").withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return rows.drop("_n", "loaded_at", "codepage")


AUDIT = "audit AS (SELECT * EXCLUDE (n, loaded_at, codepage) FROM (SELECT *, row_number() OVER (PARTITION BY project_id, source_id ORDER BY loaded_at, row_id) AS n FROM audit_entities) WHERE n = 1)"


def sq(expr: str, n: int) -> str:
    """q() in SQL."""
    return f"(floor(({expr}) * 1e{n} + CAST(0.5 AS DOUBLE)) / 1e{n})"


_WIDE = "".join(chr(c) for c in range(0xFF10, 0xFF5B))
_PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF10, 0xFF5B)).replace("'", "''")
#: match_key() of the column text in SQL. DuckDB takes accents off; compatibility forms are written out.
MATCH_KEY = f"translate(replace(text, 'ß', 'ss'), 'ıİ²³¹ºª{_WIDE}', 'iI231oa{_PLAIN}')"
for _old, _new in (("½", "1/2"), ("¼", "1/4"), ("¾", "3/4"), ("™", "TM"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("№", "No"), ("ĳ", "ij")):
    MATCH_KEY = f"replace({MATCH_KEY}, '{_old}', '{_new}')"
MATCH_KEY = f"trim(regexp_replace(upper(strip_accents({MATCH_KEY})), '[^A-Z0-9?]+', ' ', 'g'))"


def sum_(expr: str, n: int) -> str:
    """exact_sum() in SQL."""
    return f"(sum(floor(({expr}) * 1e{n} + CAST(0.5 AS DOUBLE))::DECIMAL(20,0))::DOUBLE / 1e{n})"


def mean_(expr: str, n: int) -> str:
    """exact_mean() in SQL."""
    return f"({sum_(expr, n)} / count({expr}))"


def spread_(expr: str, n: int) -> str:
    """exact_spread() in SQL."""
    u = f"floor(({expr}) * 1e{n} + CAST(0.5 AS DOUBLE))::HUGEINT"
    return f"(sqrt(greatest(0::DOUBLE, sum({u} * {u})::DOUBLE / count({expr}) - (sum({u})::DOUBLE / count({expr})) * (sum({u})::DOUBLE / count({expr})))) / 1e{n})"


def sq_angle(x0: str, y0: str, x1: str, y1: str) -> str:
    """angle180() in SQL."""
    a = f"degrees(atan2(({y1}) - ({y0}), ({x1}) - ({x0})))"
    b = f"(CASE WHEN {a} < 0 THEN {a} + 180 ELSE {a} END)"
    return f"(CASE WHEN {b} >= 180 THEN {b} - 180 ELSE {b} END)"


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts)


def leaders_sql(name: str, rows: str, near: str) -> str:
    """The sequential rule in recursive SQL: rows (project_id, pid from 1, x, y, ...) in order, each
    a leader unless an earlier one is near (`near` is over l and r). Gives {name}(project_id, pid, leader)
    with the nearest earlier leader, by distance, then place, then number."""
    return f"""{name}_r AS ({rows}),
 {name}_s AS (SELECT DISTINCT project_id, 0::BIGINT AS pid, []::BIGINT[] AS led FROM {name}_r
  UNION ALL SELECT s.project_id, r.pid, CASE WHEN EXISTS (SELECT 1 FROM {name}_r l WHERE l.project_id = r.project_id AND list_contains(s.led, l.pid) AND {near}) THEN s.led ELSE list_append(s.led, r.pid) END
  FROM {name}_s s JOIN {name}_r r ON r.project_id = s.project_id AND r.pid = s.pid + 1),
 {name}_l AS (SELECT project_id, unnest(arg_max(led, pid)) AS pid FROM {name}_s GROUP BY project_id),
 {name}_m AS (SELECT r.project_id, r.pid, arg_min(l.pid, (sqrt((l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y)), l.x, l.y, l.pid)) AS m, min(l.pid) AS earliest FROM {name}_r r JOIN {name}_l k ON k.project_id = r.project_id AND k.pid < r.pid JOIN {name}_r l ON l.project_id = k.project_id AND l.pid = k.pid WHERE {near} GROUP BY ALL),
 {name} AS (SELECT r.project_id, r.pid, CASE WHEN k.pid IS NOT NULL THEN r.pid ELSE m.m END AS leader, CASE WHEN k.pid IS NOT NULL THEN r.pid ELSE m.earliest END AS first_leader FROM {name}_r r LEFT JOIN {name}_l k ON k.project_id = r.project_id AND k.pid = r.pid LEFT JOIN {name}_m m ON m.project_id = r.project_id AND m.pid = r.pid)"""
