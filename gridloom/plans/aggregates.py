"""Counts, reports, histograms, ordered windows, top lists, and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import arrays, scalar
from gridloom.functions.scalar import q
from gridloom.operators.graph import neighbours
from gridloom.operators.ranks import quantiles, ranked
from gridloom.plans.base import AUDIT, EDGES, MATCH_KEY, NODES, OPENINGS, SIDES, SPACES, WALLS, audit, edges, nodes, mean_, openings, spaces, spread_, sq, sum_, walls, with_
from gridloom.session import Scratch, table

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


def count():
    return F.count(F.lit(1))


SEG = ("x0", "y0", "x1", "y1")
_LEN = "sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))"


@query("a01_extent", with_(WALLS) + " SELECT project_id, coalesce(min(least(x0, x1)), 0.0) AS min_x, coalesce(min(least(y0, y1)), 0.0) AS min_y, coalesce(max(greatest(x0, x1)), 0.0) AS max_x, coalesce(max(greatest(y0, y1)), 0.0) AS max_y FROM walls GROUP BY project_id")
def extent(spark, d):
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return walls(spark, d).groupBy("project_id").agg(z(F.min(F.least("x0", "x1"))).alias("min_x"), z(F.min(F.least("y0", "y1"))).alias("min_y"), z(F.max(F.greatest("x0", "x1"))).alias("max_x"), z(F.max(F.greatest("y0", "y1"))).alias("max_y"))


_DEG = "deg AS (SELECT nodes.project_id, nodes.node_id, degree AS declared, count(n) AS degree FROM nodes LEFT JOIN (SELECT project_id, from_id AS n FROM edges UNION ALL SELECT project_id, to_id FROM edges) e ON e.project_id = nodes.project_id AND e.n = nodes.node_id GROUP BY ALL)"


def degrees(spark, d) -> DataFrame:
    """Edge ends at each node (a self loop counts twice); 0 for isolated nodes."""
    e = edges(spark, d)
    ends = e.select("project_id", F.explode(F.array("from_id", "to_id")).alias("node_id"))
    deg = ends.groupBy("project_id", "node_id").agg(count().alias("k"))
    return nodes(spark, d).join(deg, ["project_id", "node_id"], "left").select("project_id", "node_id", C("degree").alias("declared"), F.coalesce("k", F.lit(0)).alias("degree"))


@query("a02_degree", with_(NODES, EDGES, _DEG) + " SELECT project_id, node_id, degree FROM deg")
def degree(spark, d):
    return degrees(spark, d).select("project_id", "node_id", "degree")


@query("a03_duplicate_pairs", with_(NODES, EDGES) + " SELECT project_id, least(from_id, to_id) AS a, greatest(from_id, to_id) AS b, count(*) AS n FROM edges GROUP BY ALL HAVING count(*) > 1")
def duplicate_pairs(spark, d):
    return edges(spark, d).groupBy("project_id", F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b")).agg(count().alias("n")).where("n > 1")


@query("a04_degree_histogram", with_(NODES, EDGES, _DEG) + " SELECT project_id, degree, count(*) AS n FROM deg GROUP BY ALL")
def degree_histogram(spark, d):
    return degrees(spark, d).groupBy("project_id", "degree").agg(count().alias("n"))


@query("a05_type_pivot", "SELECT project_id, count(*) FILTER (entity_type = 'LINE') AS LINE, count(*) FILTER (entity_type = 'ARC') AS ARC, count(*) FILTER (entity_type = 'DOOR') AS DOOR, count(*) FILTER (entity_type = 'WINDOW') AS \"WINDOW\", count(*) FILTER (entity_type = 'COLUMN') AS \"COLUMN\" FROM cad_entities GROUP BY project_id")
def type_pivot(spark, d):
    kinds = ["LINE", "ARC", "DOOR", "WINDOW", "COLUMN"]
    return table(spark, d, "cad_entities").groupBy("project_id").pivot("entity_type", kinds).agg(count()).na.fill(0, kinds)


@query("a06_stage_metrics", with_(WALLS, SPACES, "w AS (SELECT project_id, count(*) AS n_walls, " + sum_(_LEN, 3) + " AS len, list_sort(list(DISTINCT wall_type)) AS wall_types FROM walls GROUP BY project_id)", "s AS (SELECT project_id, count(*) AS n_spaces, " + sum_("area_raw", 3) + " AS area FROM spaces GROUP BY project_id)") + " SELECT project_id, n_walls, len AS wall_length, wall_types, n_spaces, area FROM w JOIN s USING (project_id)")
def stage_metrics(spark, d):
    w = walls(spark, d).groupBy("project_id").agg(count().alias("n_walls"), scalar.exact_sum(scalar.dist(*map(C, SEG)), 3).alias("wall_length"), F.sort_array(F.collect_set("wall_type")).alias("wall_types"))
    s = spaces(spark, d).groupBy("project_id").agg(count().alias("n_spaces"), scalar.exact_sum(C("area_raw"), 3).alias("area"))
    return w.join(s, "project_id")


_MEASURED = "m AS (SELECT s.project_id, s.uuid, abs(sum((x0 - ox) * (y1 - oy) - (x1 - ox) * (y0 - oy))) / 2 AS area, sum(" + _LEN + ") AS perimeter FROM sides s JOIN (SELECT project_id, uuid, polygon[1][1] AS ox, polygon[1][2] AS oy FROM spaces) o ON o.project_id = s.project_id AND o.uuid = s.uuid GROUP BY ALL)"


@query("a08_room_report", with_(SPACES, SIDES, _MEASURED) + f" SELECT project_id, count(*) AS n, arg_max(uuid, (area, uuid)) AS largest, arg_min(uuid, (area, uuid)) AS smallest, {sq(mean_('area', 2), 1)} AS mean_area, {sq(spread_('area', 2), 0)} AS std_area FROM m GROUP BY project_id")
def room_report(spark, d):
    """Rooms per project with the largest and smallest, mean and spread of areas."""
    m = spaces(spark, d).select("project_id", "uuid", F.abs(arrays.signed_area(C("v"))).alias("area"))
    return m.groupBy("project_id").agg(count().alias("n"), F.max_by("uuid", F.struct("area", "uuid")).alias("largest"), F.min_by("uuid", F.struct("area", "uuid")).alias("smallest"), q(scalar.exact_mean(C("area"), 2), 1).alias("mean_area"), q(scalar.exact_spread(C("area"), 2), 0).alias("std_area"))


@query("a09_opening_report", with_(OPENINGS) + f" SELECT category, count(*) AS n, {sq(mean_('width', 3), 3)} AS mean_width, min(width) AS min_width, max(width) AS max_width, {sq(spread_('width', 3), 2)} AS std_width, count(*) FILTER (parent_wall IS NULL) AS n_free FROM openings GROUP BY category")
def opening_report(spark, d):
    return openings(spark, d).groupBy("category").agg(count().alias("n"), q(scalar.exact_mean(C("width"), 3), 3).alias("mean_width"), F.min("width").alias("min_width"), F.max("width").alias("max_width"), q(scalar.exact_spread(C("width"), 3), 2).alias("std_width"), F.count_if(C("parent_wall").isNull()).alias("n_free"))


@query("a11_wall_report", with_(WALLS) + f" SELECT project_id, count(*) AS n, {sq(mean_(_LEN, 3), 3)} AS mean_length, {sq('max(' + _LEN + ')', 3)} AS max_length, {sq('min(' + _LEN + ')', 3)} AS min_length FROM walls GROUP BY project_id")
def wall_report(spark, d):
    n = scalar.dist(*map(C, SEG))
    return walls(spark, d).groupBy("project_id").agg(count().alias("n"), q(scalar.exact_mean(n, 3), 3).alias("mean_length"), q(F.max(n), 3).alias("max_length"), q(F.min(n), 3).alias("min_length"))


_MATCHED = "t AS (SELECT count(*) FILTER (declared = degree) AS tp, count(*) FILTER (declared <> degree) AS fp, count(*) FILTER (declared IS NULL) AS fn FROM deg)"


@query("a12_f1", with_(NODES, EDGES, _DEG, _MATCHED) + f" SELECT {sq('tp / greatest(1, tp + fp)', 6)} AS prec, {sq('tp / greatest(1, tp + fn)', 6)} AS rec, {sq('2.0 * tp / greatest(1, 2 * tp + fp + fn)', 6)} AS f1 FROM t")
def f1(spark, d):
    """Precision, recall and F1 of the declared degrees."""
    tp, fp, fn = (C(c).cast("double") for c in ("tp", "fp", "fn"))
    t = degrees(spark, d).agg(F.count_if(C("declared") == C("degree")).alias("tp"), F.count_if(C("declared") != C("degree")).alias("fp"), F.count_if(C("declared").isNull()).alias("fn"))
    one = F.lit(1.0)
    return t.select(q(tp / F.greatest(one, tp + fp), 6).alias("prec"), q(tp / F.greatest(one, tp + fn), 6).alias("rec"), q(tp * 2 / F.greatest(one, tp * 2 + fp + fn), 6).alias("f1"))


@query("a13_rates", with_(OPENINGS, SPACES) + f" SELECT (SELECT {sq('avg((parent_wall IS NOT NULL)::INT::DOUBLE)', 6)} FROM openings) AS opening_has_association_rate, (SELECT {sq('avg((len(polygon) >= 3)::INT::DOUBLE)', 6)} FROM spaces) AS closure_rate")
def rates(spark, d):
    o = openings(spark, d).agg(q(F.avg(C("parent_wall").isNotNull().cast("double")), 6).alias("opening_has_association_rate"))
    s = spaces(spark, d).agg(q(F.avg((F.size("v") >= 3).cast("double")), 6).alias("closure_rate"))
    return o.crossJoin(F.broadcast(s))  # one row each


_LENS = "l AS (SELECT project_id, len_mm AS n, greatest(max_x - min_x, max_y - min_y) AS span FROM audit WHERE audit_role = 'structural' AND len_mm > 1e-6)"


@query("a14_robust_thresholds", with_(AUDIT, _LENS, "m AS (SELECT project_id, quantile_cont(n, 0.5) AS med, quantile_cont(span, 0.95) AS p95 FROM l GROUP BY project_id)", "a AS (SELECT project_id, quantile_cont(abs(n - med), 0.5) AS mad FROM l JOIN m USING (project_id) GROUP BY project_id)") + f" SELECT project_id, {sq('med', 3)} AS median_mm, {sq('mad', 3)} AS mad_mm, {sq('p95', 3)} AS span_p95, {sq('greatest(100, least(500, med * 0.2::DOUBLE))', 3)} AS proximity, {sq('greatest(750, least(3000, med * 1.5::DOUBLE))', 3)} AS attachment FROM m JOIN a USING (project_id)")
def robust_thresholds(spark, d):
    """Median, median deviation and 95th percentile per project, and the bounded distances made of them."""
    l = audit(spark, d).where("audit_role = 'structural' AND len_mm > 1e-6").select("project_id", C("len_mm").alias("n"), F.greatest(C("max_x") - C("min_x"), C("max_y") - C("min_y")).alias("span"))
    m = quantiles(l, ["project_id"], "n", [("med", 0.5)]).join(quantiles(l, ["project_id"], "span", [("p95", 0.95)]), "project_id")
    m = Scratch(spark, "medians").save(m)
    a = quantiles(l.join(m, "project_id").select("project_id", F.abs(C("n") - C("med")).alias("off")), ["project_id"], "off", [("mad", 0.5)])
    clamp = lambda x, lo, hi: F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x))
    return m.join(a, "project_id").select("project_id", q(C("med"), 3).alias("median_mm"), q(C("mad"), 3).alias("mad_mm"), q(C("p95"), 3).alias("span_p95"), q(clamp(C("med") * 0.2, 100, 500), 3).alias("proximity"), q(clamp(C("med") * 1.5, 750, 3000), 3).alias("attachment"))


@query("a16_polygon_measures", with_(SPACES, SIDES, _MEASURED) + f" SELECT uuid, {sq('area', 2)} AS area, {sq('perimeter', 3)} AS perimeter, {sq('4 * pi() * area / nullif(perimeter * perimeter, 0)', 6)} AS circularity FROM m")
def polygon_measures(spark, d):
    """Area, perimeter and circularity."""
    m = spaces(spark, d).select("uuid", F.abs(arrays.signed_area(C("v"))).alias("a"), arrays.perimeter(C("v")).alias("p"))
    return m.select("uuid", q(C("a"), 2).alias("area"), q(C("p"), 3).alias("perimeter"), q(F.lit(4.0) * F.pi() * C("a") / F.nullif(C("p") * C("p"), F.lit(0.0)), 6).alias("circularity"))


def _has(words) -> str:
    return "(" + " OR ".join(f"contains(l, '{w}')" for w in words) + ")"


@query("a17_region_kinds", f"WITH e AS (SELECT project_id, lower(replace(layer, 'İ', 'i\u0307')) AS l FROM cad_entities), g AS (SELECT project_id, count(*) AS n, count(*) FILTER ({_has(scalar.FLOOR_WORDS)}) AS f, count(*) FILTER ({_has(scalar.ELEVATION_WORDS)}) AS e, count(*) FILTER ({_has(scalar.SECTION_WORDS)}) AS s, count(*) FILTER ({_has(scalar.ROOF_WORDS)}) AS r FROM e GROUP BY project_id) SELECT project_id, CASE WHEN f / n > 0.15 THEN 'Floor Plan' WHEN e > n * 0.2 THEN 'Elevation' WHEN s > n * 0.2 THEN 'Section' WHEN r > n * 0.2 THEN 'Roof Plan' ELSE 'Other' END AS kind FROM g")
def region_kinds(spark, d):
    """The kind of drawing that a project's layers speak for."""
    low = F.lower("layer")
    hit = lambda w: F.count_if(scalar.has_any(low, w))
    g = table(spark, d, "cad_entities").groupBy("project_id").agg(count().alias("n"), hit(scalar.FLOOR_WORDS).alias("f"), hit(scalar.ELEVATION_WORDS).alias("e"), hit(scalar.SECTION_WORDS).alias("s"), hit(scalar.ROOF_WORDS).alias("r"))
    kind = F.when(C("f") / C("n") > 0.15, "Floor Plan").when(C("e") > C("n") * 0.2, "Elevation").when(C("s") > C("n") * 0.2, "Section").when(C("r") > C("n") * 0.2, "Roof Plan").otherwise("Other")
    return g.select("project_id", kind.alias("kind"))


# Terms in texts that speak for a kind of drawing, with their weight and order.
TERMS = (
    ("floor_plan", "MUTFAK", 1.0), ("floor_plan", "SALON", 1.0), ("floor_plan", "BANYO", 1.0), ("floor_plan", "Y ODASI", 1.0), ("floor_plan", "HOL", 1.0), ("floor_plan", "KAT PLANI", 1.0), ("floor_plan", "ZEMIN KAT", 1.0),
    ("section", "KESIT", 1.0), ("section", "KES?T", 1.0), ("section", "A A", 1.0), ("section", "B B", 1.0),
    ("elevation", "GORUNUS", 1.0), ("elevation", "G?R?N??", 1.0), ("elevation", "CEPHE", 1.0), ("elevation", "ON GOR", 1.0), ("elevation", "ARKA GOR", 1.0), ("elevation", "YAN GOR", 1.0),
    ("roof_plan", "CATI", 1.0), ("roof_plan", "C?ATI", 1.0), ("roof_plan", "ROOF", 1.0),
    ("site_plan", "VAZIYET", 1.0), ("site_plan", "SITE PLAN", 1.0), ("site_plan", "PARSEL", 1.0),
)
_KEY = MATCH_KEY
_TERM_ROWS = "terms(kind, term) AS (VALUES " + ", ".join(f"('{k}', '{t}')" for k, t, _ in TERMS) + ")"
_SCORES = f"tx AS (SELECT DISTINCT project_id, {_KEY} AS k FROM audit WHERE text IS NOT NULL), sc AS (SELECT project_id, kind, count(DISTINCT term) AS score FROM tx JOIN terms ON contains(k, term) GROUP BY ALL)"


def kind_scores(spark, d) -> DataFrame:
    """project_id, kind, score: distinct terms met. The terms are a small fixed table."""
    terms = spark.createDataFrame([(k, t) for k, t, _ in TERMS], "kind string, term string")
    tx = audit(spark, d).where("text IS NOT NULL").select("project_id", scalar.match_key(C("text")).alias("k")).distinct()
    return tx.join(F.broadcast(terms), F.contains("k", C("term"))).groupBy("project_id", "kind").agg(F.count_distinct("term").alias("score"))


@query("a18_best_kind", with_(AUDIT, _TERM_ROWS, _SCORES) + " SELECT project_id, arg_max(kind, (score, kind)) AS kind, max(score) AS score FROM sc GROUP BY project_id")
def best_kind(spark, d):
    return kind_scores(spark, d).groupBy("project_id").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"), F.max("score").alias("score"))


@query("a19_kind_margin", with_(AUDIT, _TERM_ROWS, _SCORES, "r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, kind) AS n, count(*) OVER (PARTITION BY project_id) AS strong FROM sc)") + " SELECT project_id, max(kind) FILTER (n = 1) AS kind, max(score) FILTER (n = 1) - coalesce(max(score) FILTER (n = 2), 0) AS margin, CASE WHEN max(strong) >= 2 THEN 'ambiguous' ELSE 'candidate' END AS status FROM r GROUP BY project_id")
def kind_margin(spark, d):
    """The best kind, its lead over the second, and whether more than one has evidence (W7)."""
    w = Window.partitionBy("project_id")
    r = kind_scores(spark, d).withColumns({"n": F.row_number().over(w.orderBy(F.desc("score"), "kind")), "strong": count().over(w)})
    first, second = F.max(F.when(C("n") == 1, C("score"))), F.max(F.when(C("n") == 2, C("score")))
    return r.groupBy("project_id").agg(F.max(F.when(C("n") == 1, C("kind"))).alias("kind"), (first - F.coalesce(second, F.lit(0))).alias("margin"), F.when(F.max("strong") >= 2, "ambiguous").otherwise("candidate").alias("status"))


@query("a21_distributions", with_(WALLS, OPENINGS) + " SELECT 'wall_type' AS field, wall_type AS value, count(*) AS n FROM walls GROUP BY ALL UNION ALL SELECT 'category', category, count(*) FROM openings GROUP BY ALL UNION ALL SELECT 'status', status, count(*) FROM cad_entities GROUP BY ALL")
def distributions(spark, d):
    def of(df: DataFrame, field: str) -> DataFrame:
        return df.groupBy(C(field).alias("value")).agg(count().alias("n")).select(F.lit(field).alias("field"), "value", "n")
    return of(walls(spark, d), "wall_type").unionByName(of(openings(spark, d), "category")).unionByName(of(table(spark, d, "cad_entities"), "status"))


@query("a22_tolerance_bands", with_(NODES, EDGES) + f", n AS (SELECT project_id, node_id, x, y FROM nodes) SELECT band::DOUBLE AS band, count(*) AS n_short FROM edges, (VALUES (2500), (4000), (5000), (6000), (7500), (10000)) t(band) WHERE len_mm < band GROUP BY ALL")
def tolerance_bands(spark, d):
    """Edges shorter than each of six tolerances: one pass that counts all bands."""
    bands = [2500.0, 4000.0, 5000.0, 6000.0, 7500.0, 10000.0]
    one = edges(spark, d).agg(*[F.count_if(C("len_mm") < b).alias(f"b{i}") for i, b in enumerate(bands)])
    rows = F.array(*[F.struct(F.lit(b).alias("band"), C(f"b{i}").alias("n_short")) for i, b in enumerate(bands)])
    return one.select(F.explode(rows).alias("r")).select("r.*").where("n_short > 0")


@query("a24_inverted_index", "SELECT entity_type, project_id, entity_ord // 4096 AS chunk, list_sort(list(entity_ord)) AS ords FROM cad_entities GROUP BY ALL")
def inverted_index(spark, d):
    """Ordinals of each type in each project, as arrays of one block of 4096 ordinals each: an
    array is bounded, and so is what a task gathers."""
    rows = table(spark, d, "cad_entities").select("entity_type", "project_id", F.floor(C("entity_ord") / 4096).alias("chunk"), "entity_ord")
    return rows.groupBy("entity_type", "project_id", "chunk").agg(F.sort_array(F.collect_list("entity_ord")).alias("ords"))


@query("a25_short_gaps", with_(NODES) + f" SELECT count(*) AS n, {sq('min(d)', 3)} AS min_d, {sq('max(d)', 3)} AS max_d, {sq(mean_('d', 3), 3)} AS mean_d FROM (SELECT sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM nodes a JOIN nodes b ON a.project_id = b.project_id AND a.node_id < b.node_id AND abs(a.x - b.x) <= 500 AND abs(a.y - b.y) <= 500) WHERE d < 500")
def short_gaps(spark, d):
    from gridloom.operators.spatial import box_join, point_box

    n = point_box(nodes(spark, d).select("project_id", "node_id", "x", "y"), "x", "y")
    pairs = box_join(n, n, ["project_id"], 2000.0, 500.0).where("node_id < r_node_id").select(scalar.dist(C("x"), C("y"), C("r_x"), C("r_y")).alias("d")).where("d < 500")
    return pairs.agg(count().alias("n"), q(F.min("d"), 3).alias("min_d"), q(F.max("d"), 3).alias("max_d"), q(scalar.exact_mean(C("d"), 3), 3).alias("mean_d"))


@query("a26_scale_estimate", with_(WALLS) + f" SELECT project_id, {sq('3000 / ' + mean_(_LEN, 3), 6)} AS scale FROM walls GROUP BY project_id")
def scale_estimate(spark, d):
    return walls(spark, d).groupBy("project_id").agg(q(F.lit(3000.0) / scalar.exact_mean(scalar.dist(*map(C, SEG)), 3), 6).alias("scale"))


@query("a27_role_summary", with_(AUDIT) + f" SELECT coalesce(audit_role, 'unknown') AS role, count(*) AS n, {sq(mean_('len_mm', 3), 3)} AS mean_len, count(DISTINCT project_id) AS n_projects FROM audit GROUP BY ALL")
def role_summary(spark, d):
    return audit(spark, d).groupBy(F.coalesce("audit_role", F.lit("unknown")).alias("role")).agg(count().alias("n"), q(scalar.exact_mean(C("len_mm"), 3), 3).alias("mean_len"), F.count_distinct("project_id").alias("n_projects"))


@query("a28_single_points", with_(WALLS) + " SELECT project_id, x, y FROM (SELECT project_id, x0 AS x, y0 AS y FROM walls UNION ALL SELECT project_id, x1, y1 FROM walls) GROUP BY ALL HAVING count(*) = 1")
def single_points(spark, d):
    """Ends that only one wall has."""
    w = walls(spark, d)
    ends = w.select("project_id", C("x0").alias("x"), C("y0").alias("y")).unionAll(w.select("project_id", "x1", "y1"))
    return ends.groupBy("project_id", "x", "y").agg(count().alias("n")).where("n = 1").drop("n")


@query("a29_uuid_checks", "SELECT 'walls' AS tab, count(*) AS n_rows, count(DISTINCT uuid) AS n_uuids, count(*) - count(uuid) AS n_missing FROM core_walls UNION ALL SELECT 'spaces', count(*), count(DISTINCT uuid), count(*) - count(uuid) FROM core_spaces UNION ALL SELECT 'openings', count(*), count(DISTINCT uuid), count(*) - count(uuid) FROM core_openings")
def uuid_checks(spark, d):
    def of(name: str) -> DataFrame:
        return table(spark, d, f"core_{name}").agg(count().alias("n_rows"), F.count_distinct("uuid").alias("n_uuids"), F.count_if(C("uuid").isNull()).alias("n_missing")).select(F.lit(name).alias("tab"), "n_rows", "n_uuids", "n_missing")
    return of("walls").unionByName(of("spaces")).unionByName(of("openings"))


# Windows




@query("w03_split_pairs", with_(WALLS, "pts AS (SELECT w.project_id, w.uuid, v.x, v.y, CASE WHEN (w.x1 - w.x0) * (w.x1 - w.x0) + (w.y1 - w.y0) * (w.y1 - w.y0) = 0 THEN 0::DOUBLE ELSE ((v.x - w.x0) * (w.x1 - w.x0) + (v.y - w.y0) * (w.y1 - w.y0)) / ((w.x1 - w.x0) * (w.x1 - w.x0) + (w.y1 - w.y0) * (w.y1 - w.y0)) END AS t FROM walls w JOIN (SELECT DISTINCT project_id, x, y FROM (SELECT project_id, x0 AS x, y0 AS y FROM walls UNION ALL SELECT project_id, x1, y1 FROM walls)) v ON v.project_id = w.project_id AND v.x BETWEEN least(w.x0, w.x1) AND greatest(w.x0, w.x1) AND v.y BETWEEN least(w.y0, w.y1) AND greatest(w.y0, w.y1))", "o AS (SELECT *, lead(x) OVER (PARTITION BY project_id, uuid ORDER BY t, x, y) AS nx, lead(y) OVER (PARTITION BY project_id, uuid ORDER BY t, x, y) AS ny FROM pts)") + " SELECT uuid, x AS x0, y AS y0, nx AS x1, ny AS y1 FROM o WHERE nx IS NOT NULL")
def split_pairs(spark, d):
    """Walls cut at the ends of others that lie on them (in their boxes; axes are straight)."""
    from gridloom.operators.spatial import box_join, point_box, with_box

    w = walls(spark, d).select("project_id", "uuid", *SEG)
    ends = w.select("project_id", C("x0").alias("x"), C("y0").alias("y")).unionAll(w.select("project_id", "x1", "y1")).distinct()
    pairs = box_join(point_box(ends, "x", "y"), with_box(w), ["project_id"], 5000.0)
    t = scalar.along(C("x"), C("y"), C("r_x0"), C("r_y0"), C("r_x1"), C("r_y1"))
    win = Window.partitionBy("project_id", "r_uuid").orderBy("t", "x", "y")
    cut = pairs.withColumn("t", t).withColumns({"nx": F.lead("x").over(win), "ny": F.lead("y").over(win)}).where("nx IS NOT NULL")
    return cut.select(C("r_uuid").alias("uuid"), C("x").alias("x0"), C("y").alias("y0"), C("nx").alias("x1"), C("ny").alias("y1"))


@query("w04_density_gaps", with_(NODES, "b AS (SELECT project_id, floor(x / 2000)::BIGINT AS bin, count(*) AS n FROM nodes GROUP BY ALL)", "r AS (SELECT project_id, unnest(range(min(bin), max(bin) + 1)) AS bin FROM b GROUP BY project_id)", "f AS (SELECT r.project_id, r.bin, coalesce(n, 0) AS n FROM r LEFT JOIN b USING (project_id, bin))", "s AS (SELECT *, sum(n) OVER (PARTITION BY project_id ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS smooth, avg(n) OVER (PARTITION BY project_id) AS mean, max(bin) OVER (PARTITION BY project_id) AS last FROM f)", "g AS (SELECT *, bin - row_number() OVER (PARTITION BY project_id ORDER BY bin) AS island FROM s WHERE smooth < 0.2::DOUBLE * mean)", "i AS (SELECT project_id, min(bin) AS a, max(bin) AS b, max(last) AS last FROM g GROUP BY project_id, island)") + " SELECT project_id, ((a + b + 1) / 2) * 2000.0 AS split_at FROM i WHERE b - a + 1 >= 3 AND b < last")
def density_gaps(spark, d):
    """Where a drawing can be split: runs of three or more bins of 2000 whose smoothed
    count stays under a fifth of the mean; a run that is open at the end doesn't count."""
    b = nodes(spark, d).where("x IS NOT NULL").groupBy("project_id", F.floor(C("x") / 2000).alias("bin")).agg(count().alias("n"))
    r = b.groupBy("project_id").agg(F.min("bin").alias("a"), F.max("bin").alias("z")).select("project_id", F.explode(F.sequence("a", "z")).alias("bin"))
    w = Window.partitionBy("project_id")
    f = r.join(b, ["project_id", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    s = f.withColumns({"smooth": F.sum("n").over(w.orderBy("bin").rowsBetween(-2, 2)) / 5, "mean": F.avg("n").over(w), "last": F.max("bin").over(w)})
    g = s.where(C("smooth") < F.lit(0.2) * C("mean")).withColumn("island", C("bin") - F.row_number().over(w.orderBy("bin")))
    i = g.groupBy("project_id", "island").agg(F.min("bin").alias("a"), F.max("bin").alias("b"), F.max("last").alias("last"))
    return i.where("b - a + 1 >= 3 AND b < last").select("project_id", ((C("a") + C("b") + 1) / 2 * 2000.0).alias("split_at"))


@query("w05_split_intervals", with_(WALLS, "m AS (SELECT project_id, min(x0) AS lo, max(x0) AS hi FROM walls GROUP BY project_id)") + " SELECT w.uuid, CASE WHEN w.x0 < lo + (hi - lo) / 3 THEN 0 WHEN w.x0 < lo + (hi - lo) * 2 / 3 THEN 1 WHEN w.x0 < hi THEN 2 END AS part FROM walls w JOIN m USING (project_id)")
def split_intervals(spark, d):
    """Half-open thirds of a project's width; an item at the far edge belongs to none."""
    w = walls(spark, d)
    m = w.groupBy("project_id").agg(F.min("x0").alias("lo"), F.max("x0").alias("hi"))
    x, lo, hi = C("x0"), C("lo"), C("hi")
    part = F.when(x < lo + (hi - lo) / 3, 0).when(x < lo + (hi - lo) * 2 / 3, 1).when(x < hi, 2)
    return w.join(m, "project_id").select("uuid", part.alias("part"))


@query("w06_relative_position", with_(SPACES, SIDES, "c AS (SELECT project_id, uuid, min(y0) AS y FROM sides GROUP BY ALL)", "r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY y, uuid) - 1 AS i, count(*) OVER (PARTITION BY project_id) AS n FROM c)") + f" SELECT uuid, {sq('i / greatest(n - 1, 1)', 6)} AS ratio, CASE WHEN i = 0 THEN 'ground' WHEN i = n - 1 THEN 'roof' ELSE 'floor' END AS level FROM r")
def relative_position(spark, d):
    c = spaces(spark, d).select("project_id", "uuid", arrays.bounds(C("v"))["min_y"].alias("y"))
    r = ranked(c, ["project_id"], ["y", "uuid"], "i").withColumn("i", C("i") - 1).join(c.groupBy("project_id").agg(count().alias("n")), "project_id")
    return r.select("uuid", q(C("i") / F.greatest(C("n") - 1, F.lit(1)), 6).alias("ratio"), F.when(C("i") == 0, "ground").when(C("i") == C("n") - 1, "roof").otherwise("floor").alias("level"))


@query("w08_canonical_ids", with_(NODES) + " SELECT project_id, node_id, row_number() OVER (PARTITION BY project_id ORDER BY x NULLS FIRST, y NULLS FIRST, node_id) - 1 AS new_id FROM nodes")
def canonical_ids(spark, d):
    """Node numbers by place."""
    return ranked(nodes(spark, d), ["project_id"], ["x", "y", "node_id"], "new_id").select("project_id", "node_id", (C("new_id") - 1).alias("new_id"))


@query("w09_edge_fans", with_(NODES, EDGES, "h AS (SELECT project_id, from_id AS n, to_id AS o FROM edges WHERE from_id <> to_id UNION SELECT project_id, to_id, from_id FROM edges WHERE from_id <> to_id)", f"a AS (SELECT h.*, {sq('degrees(atan2(q.y - p.y, q.x - p.x))', 6)} AS a FROM h JOIN nodes p ON p.project_id = h.project_id AND p.node_id = n JOIN nodes q ON q.project_id = h.project_id AND q.node_id = o)") + " SELECT project_id, n AS node_id, o AS other, coalesce(lead(o) OVER w, first_value(o) OVER w) AS next_other FROM a WINDOW w AS (PARTITION BY project_id, n ORDER BY a, o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def edge_fans(spark, d):
    """The next edge around each node, by angle."""
    n = nodes(spark, d)
    h = neighbours(edges(spark, d)).join(n.select("project_id", "node_id", C("x").alias("px"), C("y").alias("py")), ["project_id", "node_id"]).join(n.select("project_id", C("node_id").alias("other"), C("x").alias("qx"), C("y").alias("qy")), ["project_id", "other"])
    h = h.withColumn("a", q(F.degrees(F.atan2(C("qy") - C("py"), C("qx") - C("px"))), 6))
    w = Window.partitionBy("project_id", "node_id").orderBy("a", "other")
    return h.select("project_id", "node_id", "other", F.coalesce(F.lead("other").over(w), F.first("other").over(w)).alias("next_other"))


_TURNED = "list_concat({v}[list_position({v}, list_min({v})):], {v}[:list_position({v}, list_min({v})) - 1])"


@query("w10_canonical_rings", with_(SPACES, "v AS (SELECT project_id, uuid, list_transform(polygon, lambda p: {'x': p[1], 'y': p[2]}) AS v FROM spaces)", "o AS (SELECT project_id, uuid, CASE WHEN len(v) > 1 AND v[1] = v[len(v)] THEN v[:len(v) - 1] ELSE v END AS v, list_reverse(CASE WHEN len(v) > 1 AND v[1] = v[len(v)] THEN v[:len(v) - 1] ELSE v END) AS w FROM v)") + f" SELECT project_id, uuid, list_transform(CASE WHEN len(v) > 0 THEN least({_TURNED.format(v='v')}, {_TURNED.format(v='w')}) ELSE v END, lambda p: [p.x, p.y]) AS ring FROM o")
def canonical_rings(spark, d):
    """Rings that are equal for every start and sense."""
    return spaces(spark, d).select("project_id", "uuid", F.transform(arrays.canonical_ring(C("v")), lambda p: F.array(p["x"], p["y"])).alias("ring"))


# Order and top lists


@query("o01_entity_order", "SELECT row_id, row_number() OVER (PARTITION BY project_id ORDER BY entity_type, coalesce(layer, ''), coalesce(start_pt, ''), coalesce(end_pt, ''), row_id) AS ord FROM cad_entities")
def entity_order(spark, d):
    e = lambda c: F.coalesce(c, F.lit(""))
    rows = table(spark, d, "cad_entities").select("project_id", "row_id", "entity_type", *[e(c).alias(c) for c in ("layer", "start_pt", "end_pt")])
    return ranked(rows, ["project_id"], ["entity_type", "layer", "start_pt", "end_pt", "row_id"]).select("row_id", "ord")


@query("o04_wall_order", with_(WALLS) + " SELECT uuid, row_number() OVER (PARTITION BY project_id ORDER BY least(x0, x1), least(y0, y1), greatest(x0, x1), greatest(y0, y1), uuid) AS ord FROM walls")
def wall_order(spark, d):
    w = walls(spark, d).select("project_id", "uuid", F.least("x0", "x1").alias("a"), F.least("y0", "y1").alias("b"), F.greatest("x0", "x1").alias("c"), F.greatest("y0", "y1").alias("e"))
    return ranked(w, ["project_id"], ["a", "b", "c", "e", "uuid"]).select("uuid", "ord")


@query("o07_largest_first", with_(SPACES, "r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY area_raw DESC, uuid) AS n FROM spaces WHERE area_raw IS NOT NULL)") + " SELECT project_id, uuid, area_raw FROM r WHERE n = 1")
def largest_first(spark, d):
    """The largest space of each project, by a partly aggregated maximum."""
    b = spaces(spark, d).where("area_raw IS NOT NULL").groupBy("project_id").agg(F.min(F.struct((-C("area_raw")).alias("k"), "uuid", "area_raw")).alias("b"))
    return b.select("project_id", "b.uuid", "b.area_raw")


@query("o09_top_layers", "SELECT layer, n FROM (SELECT layer, count(*) AS n FROM cad_entities WHERE layer IS NOT NULL GROUP BY layer) ORDER BY n DESC, layer LIMIT 20")
def top_layers(spark, d):
    """The twenty most common layers."""
    g = table(spark, d, "cad_entities").where("layer IS NOT NULL").groupBy("layer").agg(count().alias("n"))
    return g.orderBy(F.desc("n"), "layer").limit(20)


@query("o10_largest_project", "SELECT project_id, count(*) AS n FROM cad_entities GROUP BY project_id ORDER BY n DESC, project_id LIMIT 1")
def largest_project(spark, d):
    return table(spark, d, "cad_entities").groupBy("project_id").agg(count().alias("n")).orderBy(F.desc("n"), "project_id").limit(1)


# Sets


@query("x01_undirected_distinct", with_(NODES, EDGES) + " SELECT DISTINCT project_id, least(from_id, to_id) AS a, greatest(from_id, to_id) AS b FROM edges")
def undirected_distinct(spark, d):
    return edges(spark, d).select("project_id", F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b")).distinct()


@query("x02_first_of_pair", with_(NODES, EDGES) + " SELECT project_id, least(from_id, to_id) AS a, greatest(from_id, to_id) AS b, arg_min(edge_id, (len_mm, edge_id)) AS edge_id FROM edges WHERE from_id <> to_id GROUP BY ALL")
def first_of_pair(spark, d):
    """One edge for each pair of nodes: the shortest, then the least id."""
    g = edges(spark, d).where("from_id <> to_id").groupBy("project_id", F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b"))
    return g.agg(F.min_by("edge_id", F.struct("len_mm", "edge_id")).alias("edge_id"))


@query("x03_manifest_diff", "WITH a AS (SELECT project_id, count(*) AS n FROM core_walls GROUP BY ALL), b AS (SELECT project_id, count(*) AS n FROM core_spaces GROUP BY ALL) SELECT coalesce(a.project_id, b.project_id) AS project_id, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'missing' WHEN a.n = b.n THEN 'same' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.project_id = b.project_id")
def manifest_diff(spark, d):
    a = table(spark, d, "core_walls").groupBy("project_id").agg(count().alias("a"))
    b = table(spark, d, "core_spaces").groupBy("project_id").agg(count().alias("b"))
    change = F.when(C("a").isNull(), "added").when(C("b").isNull(), "missing").when(C("a") == C("b"), "same").otherwise("changed")
    return a.join(b, "project_id", "full").select("project_id", change.alias("change"))


@query("x04_model_union", with_(WALLS, OPENINGS, SPACES) + " SELECT project_id, 'wall' AS kind, uuid FROM walls UNION ALL SELECT project_id, lower(category), uuid FROM openings UNION ALL SELECT project_id, 'space', uuid FROM spaces")
def model_union(spark, d):
    """All elements of a model in one table."""
    one = lambda df, kind: df.select("project_id", kind.alias("kind"), "uuid")
    return one(walls(spark, d), F.lit("wall")).unionByName(one(openings(spark, d), F.lower("category"))).unionByName(one(spaces(spark, d), F.lit("space")))
