"""Health of graphs and loops: one table of diagnostics per project, from which
checks, status and the first failure follow.

Nodes and edges are geometry_nodes and geometry_edges, loops are the spaces: a loop's
boundary is its ring (closed by its first point), its edges are the walls that it names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalar import q
from gridloom.operators.orphans import reference_key
from gridloom.plans.base import EDGES, NODES, SIDES, SPACES, WALLS, edges, nodes, space_sides, walls, with_
from gridloom.plans.graphs import _CC, graph_components
from gridloom.session import Scratch, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
C = F.col
#: Loops of at most this area are tiny.
MIN_AREA = 1.0

# Diagnostic codes in their order, and whether each is critical.
CODES = {
    "ZERO_NODES": True,
    "ZERO_EDGES": True,
    "ZERO_LOOPS": False,
    "INVALID_NODE_IDS": True,
    "INVALID_EDGE_IDS": True,
    "INVALID_EDGE_ENDPOINTS": True,
    "INVALID_EDGE_REFERENCES": True,
    "INVALID_NODE_COORDINATES": True,
    "DEGREE_METADATA_MISMATCH": False,
    "DISCONNECTED_COMPONENTS": False,
    "DANGLING_NODES": False,
    "ISOLATED_NODES": False,
    "SELF_LOOP_EDGES": True,
    "OPEN_LOOPS": False,
    "TINY_LOOPS": False,
    "INVALID_LOOP_AREAS": False,
    "INVALID_LOOP_EDGE_REFERENCES": False,
    "MISSING_LOOP_EDGE_REFERENCES": False,
    "INSUFFICIENT_UNIQUE_LOOP_EDGES": False,
    "DUPLICATE_UNDIRECTED_EDGES": False,
    "FACE_EDGE_INCONSISTENCY": False,
}
# Checks and the code that each fails with.
CHECKS = {
    "has_nodes": "ZERO_NODES",
    "has_edges": "ZERO_EDGES",
    "has_loops": "ZERO_LOOPS",
    "non_empty_nodes": "ZERO_NODES",
    "non_empty_edges": "ZERO_EDGES",
    "non_empty_loops": "ZERO_LOOPS",
    "node_id_integrity": "INVALID_NODE_IDS",
    "edge_id_integrity": "INVALID_EDGE_IDS",
    "edge_endpoint_integrity": "INVALID_EDGE_ENDPOINTS",
    "node_coordinate_integrity": "INVALID_NODE_COORDINATES",
    "node_reference_integrity": "INVALID_EDGE_REFERENCES",
    "degree_metadata_consistency": "DEGREE_METADATA_MISMATCH",
    "single_connected_component": "DISCONNECTED_COMPONENTS",
    "no_dangling_nodes": "DANGLING_NODES",
    "no_isolated_nodes": "ISOLATED_NODES",
    "no_self_loop_edges": "SELF_LOOP_EDGES",
    "all_loops_closed": "OPEN_LOOPS",
    "closed_loops": "OPEN_LOOPS",
    "loop_area_integrity": "INVALID_LOOP_AREAS",
    "no_tiny_loops": "TINY_LOOPS",
    "no_tiny_sliver_faces": "TINY_LOOPS",
    "loop_edge_id_integrity": "INVALID_LOOP_EDGE_REFERENCES",
    "loop_edge_reference_integrity": "MISSING_LOOP_EDGE_REFERENCES",
    "sufficient_unique_loop_edges": "INSUFFICIENT_UNIQUE_LOOP_EDGES",
    "face_edge_consistency": "FACE_EDGE_INCONSISTENCY",
    "no_duplicate_undirected_edges": "DUPLICATE_UNDIRECTED_EDGES",
}
# Codes in the order in which a validator that stops at the first failure meets them.
FIRST = (
    "ZERO_NODES ZERO_EDGES ZERO_LOOPS INVALID_NODE_IDS INVALID_NODE_COORDINATES INVALID_EDGE_ENDPOINTS INVALID_EDGE_REFERENCES DEGREE_METADATA_MISMATCH DANGLING_NODES SELF_LOOP_EDGES "
    "DUPLICATE_UNDIRECTED_EDGES DISCONNECTED_COMPONENTS INVALID_EDGE_IDS INVALID_LOOP_EDGE_REFERENCES INVALID_LOOP_AREAS OPEN_LOOPS TINY_LOOPS INSUFFICIENT_UNIQUE_LOOP_EDGES MISSING_LOOP_EDGE_REFERENCES FACE_EDGE_INCONSISTENCY"
).split()


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f
    return keep


def _loop_edges(spark, d) -> DataFrame:
    """project_id, uuid of each loop with its ring's size, area, and what is wrong with it:
    invalid_list, missing, unique (edges named), differs (ring and named edges aren't one set)."""
    s = table(spark, d, "core_spaces").select("project_id", "uuid", "area_raw", "polygon", "related_walls").distinct()
    ref = F.transform("related_walls", reference_key)
    s = s.select("project_id", "uuid", "area_raw", F.coalesce(F.size("polygon"), F.lit(0)).alias("n_points"), F.coalesce(F.exists(ref, lambda r: r.isNull()), F.lit(False)).alias("invalid_list"), F.array_distinct(ref).alias("refs"))
    s = Scratch(spark, "loops").save(s)
    known = walls(spark, d).select("project_id", C("uuid").alias("edge")).distinct()
    named = s.select("project_id", "uuid", F.explode("refs").alias("edge")).where("edge IS NOT NULL")
    lost = named.join(known, ["project_id", "edge"], "left_anti").groupBy("project_id", "uuid").agg(F.count(F.lit(1)).alias("missing"))
    a, b = F.struct(q(C("x0"), 3).alias("x"), q(C("y0"), 3).alias("y")), F.struct(q(C("x1"), 3).alias("x"), q(C("y1"), 3).alias("y"))
    ends = [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    by_ends = walls(spark, d).select("project_id", *ends, "uuid").groupBy("project_id", "a", "b").agg(F.max("uuid").alias("edge"))
    ring = space_sides(spark, d).select("project_id", "uuid", *ends).join(by_ends, ["project_id", "a", "b"], "left").select("project_id", "uuid", "edge").distinct()
    tag = lambda df, n: df.select("project_id", "uuid", "edge", F.lit(n == "r").alias("r"), F.lit(n == "n").alias("n"))
    both = tag(ring, "r").unionByName(tag(named, "n")).groupBy("project_id", "uuid", "edge").agg(F.bool_or("r").alias("r"), F.bool_or("n").alias("n"))
    odd = both.groupBy("project_id", "uuid").agg(F.bool_or((C("r") != C("n")) | C("edge").isNull()).alias("differs"))
    out = s.join(lost, ["project_id", "uuid"], "left").join(odd, ["project_id", "uuid"], "left")
    unique = F.coalesce(F.size("refs"), F.lit(0))
    return out.select("project_id", "uuid", "area_raw", "n_points", "invalid_list", (F.coalesce("missing", F.lit(0)) > 0).alias("missing"), unique.alias("unique"), C("refs").isNotNull().alias("has_list"), F.coalesce("differs", F.lit(True)).alias("differs"))


def _cascade() -> dict[str, Column]:
    """What counts against a loop; a failed step hides those after it."""
    sound = ~C("invalid_list")
    few = sound & (C("unique") < 3)
    lost = sound & C("has_list") & C("missing")
    return {
        "INVALID_LOOP_EDGE_REFERENCES": C("has_list") & C("invalid_list"),
        "MISSING_LOOP_EDGE_REFERENCES": lost,
        "INSUFFICIENT_UNIQUE_LOOP_EDGES": few,
        "FACE_EDGE_INCONSISTENCY": sound & ~few & ~lost & C("has_list") & (C("differs") | (C("n_points") < 2)),
    }


def diagnostics(spark, d) -> DataFrame:
    """project_id, code, severity, n: each of the 21 codes for each project that any of the
    tables names; n is how many nodes, edges, loops, pairs or components it holds for."""
    n, e = nodes(spark, d), table(spark, d, "geometry_edges").select("project_id", "edge_id", "from_id", "to_id")
    scratch = Scratch(spark, "health")
    per: list[DataFrame] = []
    p = ["project_id"]
    all_nodes = table(spark, d, "geometry_nodes").groupBy(*p).agg(F.count(F.lit(1)).alias("nodes"), F.count_if(C("node_id").isNull()).alias("INVALID_NODE_IDS"))
    bad = lambda c: C(c).isNull() | F.isnan(c)
    coords = n.groupBy(*p).agg(F.count_if(bad("x") | bad("y")).alias("INVALID_NODE_COORDINATES"))
    known = n.select("project_id", "node_id")
    seen = e.join(known.select("project_id", C("node_id").alias("from_id"), F.lit(1).alias("a")), ["project_id", "from_id"], "left").join(known.select("project_id", C("node_id").alias("to_id"), F.lit(1).alias("b")), ["project_id", "to_id"], "left")
    both = C("from_id").isNotNull() & C("to_id").isNotNull()
    seen = scratch.save(seen.withColumn("ok", both & C("edge_id").isNotNull() & C("a").isNotNull() & C("b").isNotNull()), "edges")
    ends = seen.groupBy(*p).agg(
        F.count(F.lit(1)).alias("edges"), F.count_if(C("edge_id").isNull()).alias("INVALID_EDGE_IDS"), F.count_if(~both).alias("INVALID_EDGE_ENDPOINTS"),
        F.count_if(both & (C("a").isNull() | C("b").isNull())).alias("INVALID_EDGE_REFERENCES"), F.count_if(C("ok") & (C("from_id") == C("to_id"))).alias("SELF_LOOP_EDGES"))
    ok = seen.where("ok")
    twice = ok.groupBy("project_id", F.least("from_id", "to_id"), F.greatest("from_id", "to_id")).agg(F.count(F.lit(1)).alias("k")).groupBy(*p).agg(F.count_if(C("k") > 1).alias("DUPLICATE_UNDIRECTED_EDGES"))
    deg = ok.select("project_id", F.explode(F.array("from_id", "to_id")).alias("node_id")).groupBy("project_id", "node_id").agg(F.count(F.lit(1)).alias("k"))
    k = F.coalesce("k", F.lit(0))
    degree = n.join(deg, ["project_id", "node_id"], "left").groupBy(*p).agg(F.count_if(~C("degree").eqNullSafe(k)).alias("DEGREE_METADATA_MISMATCH"), F.count_if(k == 1).alias("DANGLING_NODES"), F.count_if(k == 0).alias("ISOLATED_NODES"))
    parts = graph_components(spark, d).groupBy(*p).agg(F.count_distinct("component").alias("k")).select("project_id", F.when(C("k") > 1, C("k")).otherwise(0).alias("DISCONNECTED_COMPONENTS"))
    l = _loop_edges(spark, d)
    loops = l.groupBy(*p).agg(F.count(F.lit(1)).alias("loops"), F.count_if(C("n_points") < 3).alias("OPEN_LOOPS"), F.count_if(C("area_raw") <= MIN_AREA).alias("TINY_LOOPS"), F.count_if(bad("area_raw")).alias("INVALID_LOOP_AREAS"), *[F.count_if(c).alias(name) for name, c in _cascade().items()])
    per = [all_nodes, coords, ends, twice, degree, parts, loops]
    wide = reduce(lambda a, b: a.join(b, "project_id", "full"), per)
    wide = wide.na.fill(0)
    zero = lambda c: (C(c) == 0).cast("long")
    wide = wide.withColumns({"ZERO_NODES": zero("nodes"), "ZERO_EDGES": zero("edges"), "ZERO_LOOPS": zero("loops")})
    empty = (C("nodes") == 0) & (C("edges") == 0)
    severity = lambda code: F.lit("CRITICAL") if CODES[code] else F.when(empty, "CRITICAL").otherwise("WARNING") if code == "ZERO_LOOPS" else F.lit("WARNING")
    rows = F.array(*[F.struct(F.lit(c).alias("code"), severity(c).alias("severity"), C(c).cast("long").alias("n")) for c in CODES])
    return wide.select("project_id", F.explode(rows).alias("r")).select("project_id", "r.*")


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x).lower() for x in r) + ")" for r in rows)


_LOOPS = f"""ls AS (SELECT DISTINCT project_id, uuid, area_raw, polygon, related_walls FROM core_spaces),
 li AS (SELECT project_id, uuid, area_raw, coalesce(len(polygon), 0) AS n_points, related_walls IS NOT NULL AS has_list,
  coalesce(len(list_filter(related_walls, lambda r: r IS NULL OR trim(r) = '')) > 0, false) AS invalid_list, coalesce(len(list_distinct(list_transform(related_walls, lambda r: lower(trim(r))))), 0) AS k, related_walls FROM ls),
 nm AS (SELECT DISTINCT project_id, uuid, lower(trim(r)) AS edge FROM (SELECT project_id, uuid, unnest(related_walls) AS r FROM li) WHERE trim(coalesce(r, '')) <> ''),
 wk AS (SELECT project_id, CASE WHEN (x0, y0) <= (x1, y1) THEN (x0, y0, x1, y1) ELSE (x1, y1, x0, y0) END AS k, max(uuid) AS edge FROM walls GROUP BY ALL),
 rg AS (SELECT DISTINCT s.project_id, s.uuid, w.edge FROM sides s LEFT JOIN wk w ON w.project_id = s.project_id AND w.k = CASE WHEN (x0, y0) <= (x1, y1) THEN (x0, y0, x1, y1) ELSE (x1, y1, x0, y0) END),
 df AS (SELECT coalesce(r.project_id, n.project_id) AS project_id, coalesce(r.uuid, n.uuid) AS uuid, bool_or(r.edge IS NULL OR n.edge IS NULL) AS differs FROM rg r FULL JOIN nm n ON r.project_id = n.project_id AND r.uuid = n.uuid AND r.edge = n.edge GROUP BY ALL),
 ms AS (SELECT DISTINCT project_id, uuid FROM nm WHERE NOT EXISTS (SELECT 1 FROM walls w WHERE w.project_id = nm.project_id AND w.uuid = nm.edge)),
 lp AS (SELECT li.*, has_list AND invalid_list AS c1, NOT invalid_list AND has_list AND ms.uuid IS NOT NULL AS c2, NOT invalid_list AND k < 3 AS c3, coalesce(differs, true) OR n_points < 2 AS df
  FROM li LEFT JOIN ms ON ms.project_id = li.project_id AND ms.uuid = li.uuid LEFT JOIN df ON df.project_id = li.project_id AND df.uuid = li.uuid)"""
_DIAG = f"""WITH RECURSIVE {NODES}, {EDGES}, {_CC}, {WALLS}, {SPACES}, {SIDES}, {_LOOPS},
 se AS (SELECT e.project_id, edge_id, from_id, to_id, a.node_id IS NOT NULL AS a, b.node_id IS NOT NULL AS b FROM geometry_edges e LEFT JOIN nodes a ON a.project_id = e.project_id AND a.node_id = from_id LEFT JOIN nodes b ON b.project_id = e.project_id AND b.node_id = to_id),
 oe AS (SELECT * FROM se WHERE edge_id IS NOT NULL AND a AND b),
 dg AS (SELECT nodes.project_id, nodes.node_id, degree, count(n) AS k FROM nodes LEFT JOIN (SELECT project_id, from_id AS n FROM oe UNION ALL SELECT project_id, to_id FROM oe) x ON x.project_id = nodes.project_id AND x.n = nodes.node_id GROUP BY ALL),
 pr AS (SELECT project_id FROM geometry_nodes UNION SELECT project_id FROM geometry_edges UNION SELECT project_id FROM core_spaces),
 found AS (
  SELECT project_id, 'ZERO_NODES' AS code, 1 AS n FROM pr WHERE project_id NOT IN (SELECT project_id FROM geometry_nodes)
  UNION ALL SELECT project_id, 'ZERO_EDGES', 1 FROM pr WHERE project_id NOT IN (SELECT project_id FROM geometry_edges)
  UNION ALL SELECT project_id, 'ZERO_LOOPS', 1 FROM pr WHERE project_id NOT IN (SELECT project_id FROM core_spaces)
  UNION ALL SELECT project_id, 'INVALID_NODE_IDS', 1 FROM geometry_nodes WHERE node_id IS NULL
  UNION ALL SELECT project_id, 'INVALID_EDGE_IDS', 1 FROM se WHERE edge_id IS NULL
  UNION ALL SELECT project_id, 'INVALID_EDGE_ENDPOINTS', 1 FROM se WHERE from_id IS NULL OR to_id IS NULL
  UNION ALL SELECT project_id, 'INVALID_EDGE_REFERENCES', 1 FROM se WHERE from_id IS NOT NULL AND to_id IS NOT NULL AND NOT (a AND b)
  UNION ALL SELECT project_id, 'INVALID_NODE_COORDINATES', 1 FROM nodes WHERE x IS NULL OR y IS NULL
  UNION ALL SELECT project_id, 'DEGREE_METADATA_MISMATCH', 1 FROM dg WHERE degree IS DISTINCT FROM k
  UNION ALL SELECT project_id, 'DISCONNECTED_COMPONENTS', count(DISTINCT component) FROM cc GROUP BY ALL HAVING count(DISTINCT component) > 1
  UNION ALL SELECT project_id, 'DANGLING_NODES', 1 FROM dg WHERE k = 1
  UNION ALL SELECT project_id, 'ISOLATED_NODES', 1 FROM dg WHERE k = 0
  UNION ALL SELECT project_id, 'SELF_LOOP_EDGES', 1 FROM oe WHERE from_id = to_id
  UNION ALL SELECT project_id, 'OPEN_LOOPS', 1 FROM lp WHERE n_points < 3
  UNION ALL SELECT project_id, 'TINY_LOOPS', 1 FROM lp WHERE area_raw <= {MIN_AREA}
  UNION ALL SELECT project_id, 'INVALID_LOOP_AREAS', 1 FROM lp WHERE area_raw IS NULL
  UNION ALL SELECT project_id, 'INVALID_LOOP_EDGE_REFERENCES', 1 FROM lp WHERE c1
  UNION ALL SELECT project_id, 'MISSING_LOOP_EDGE_REFERENCES', 1 FROM lp WHERE c2
  UNION ALL SELECT project_id, 'INSUFFICIENT_UNIQUE_LOOP_EDGES', 1 FROM lp WHERE c3
  UNION ALL SELECT project_id, 'DUPLICATE_UNDIRECTED_EDGES', 1 FROM (SELECT project_id, least(from_id, to_id) AS a, greatest(from_id, to_id) AS b FROM oe GROUP BY ALL HAVING count(*) > 1)
  UNION ALL SELECT project_id, 'FACE_EDGE_INCONSISTENCY', 1 FROM lp WHERE NOT invalid_list AND NOT c2 AND NOT c3 AND has_list AND df),
 codes(code, critical) AS (VALUES {_values(CODES.items())}),
 dz AS (SELECT pr.project_id, codes.code, CASE WHEN critical OR (codes.code = 'ZERO_LOOPS' AND pr.project_id NOT IN (SELECT project_id FROM geometry_nodes) AND pr.project_id NOT IN (SELECT project_id FROM geometry_edges)) THEN 'CRITICAL' ELSE 'WARNING' END AS severity, coalesce(sum(f.n), 0)::BIGINT AS n
  FROM pr CROSS JOIN codes LEFT JOIN found f ON f.project_id = pr.project_id AND f.code = codes.code GROUP BY ALL),
 checks(chk, code) AS (VALUES {_values(CHECKS.items())}),
 ck AS (SELECT project_id, chk, n = 0 AS passed FROM dz JOIN checks USING (code))"""


@query("v01_violations", _DIAG + " SELECT project_id, code, severity, n FROM dz")
def violations(spark, d):
    return diagnostics(spark, d)


def _checks(spark, d) -> DataFrame:
    """project_id, chk, passed of the 26 checks."""
    named = F.create_map(*[F.lit(x) for code in CODES for x in (code, F.array(*[F.lit(k) for k, c in CHECKS.items() if c == code]))])
    return diagnostics(spark, d).select("project_id", F.explode(named[C("code")]).alias("chk"), (C("n") == 0).alias("passed"))


@query("v01_checks", _DIAG + " SELECT project_id, chk, passed FROM ck")
def checks(spark, d):
    return _checks(spark, d)


@query("v01_health_status", _DIAG + """ SELECT project_id, CASE WHEN count(*) FILTER (n > 0 AND critical) > 0 THEN 'CRITICAL' WHEN count(*) FILTER (n > 0) > 0 THEN 'WARNING' ELSE 'HEALTHY' END AS status,
 count(*) FILTER (n > 0) AS n_codes FROM dz JOIN codes USING (code) GROUP BY project_id""")
def health_status(spark, d):
    """CRITICAL where the graph can't be read or joined, WARNING for all else that fails."""
    grave = C("code").isin(*[c for c, x in CODES.items() if x]) & (C("n") > 0)
    g = diagnostics(spark, d).groupBy("project_id").agg(F.bool_or(grave).alias("grave"), F.count_if(C("n") > 0).alias("n_codes"))
    return g.select("project_id", F.when(C("grave"), "CRITICAL").when(C("n_codes") > 0, "WARNING").otherwise("HEALTHY").alias("status"), "n_codes")


@query("a07_failed_checks", _DIAG + """ SELECT c.project_id, c.failed, z.codes FROM (SELECT project_id, list_sort(list(chk)) AS failed FROM ck WHERE NOT passed GROUP BY project_id) c
 JOIN (SELECT project_id, list_sort(list(code)) AS codes FROM dz WHERE n > 0 GROUP BY project_id) z USING (project_id)""")
def failed_checks(spark, d):
    """Failed checks and codes of each project; at most 26 and 21."""
    named = F.create_map(*[F.lit(x) for code in CODES for x in (code, F.array(*[F.lit(k) for k, c in CHECKS.items() if c == code]))])
    g = diagnostics(spark, d).where("n > 0").groupBy("project_id").agg(F.sort_array(F.collect_list("code")).alias("codes"))
    return g.select("project_id", F.sort_array(F.flatten(F.transform("codes", lambda c: named[c]))).alias("failed"), "codes")


@query("v03_first_failure", _DIAG + f" SELECT project_id, arg_min(code, list_position([{', '.join(repr(c) for c in FIRST)}], code)) AS code FROM dz WHERE n > 0 AND code <> 'ISOLATED_NODES' GROUP BY project_id")
def first_failure(spark, d):
    """What a validator that stops at the first failure would name; an isolated node fails as a component of its own."""
    order = F.array(*[F.lit(c) for c in FIRST])
    return diagnostics(spark, d).where((C("n") > 0) & C("code").isin(*FIRST)).groupBy("project_id").agg(F.min_by("code", F.array_position(order, C("code"))).alias("code"))


@query("v02_loop_checks", f"WITH {WALLS}, {SPACES}, {SIDES}, {_LOOPS} SELECT project_id, uuid, CASE WHEN c1 THEN 'invalid_list' WHEN c2 THEN 'missing_reference' WHEN c3 THEN 'insufficient_edges' WHEN has_list AND NOT invalid_list AND df THEN 'face_edge_mismatch' ELSE 'ok' END AS result, n_points < 3 AS is_open, coalesce(area_raw <= {MIN_AREA}, false) AS is_tiny FROM lp")
def loop_checks(spark, d):
    """Checks of each loop in order; a failed one hides those after it."""
    steps = list(zip(_cascade().values(), ("invalid_list", "missing_reference", "insufficient_edges", "face_edge_mismatch")))
    result = F.when(steps[0][0], steps[0][1])
    for cond, name in steps[1:]:
        result = result.when(cond, name)
    return _loop_edges(spark, d).select("project_id", "uuid", result.otherwise("ok").alias("result"), (C("n_points") < 3).alias("is_open"), F.coalesce(C("area_raw") <= MIN_AREA, F.lit(False)).alias("is_tiny"))
