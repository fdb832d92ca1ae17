"""From wall segments to a planar graph: snapping, noding, nodes and edges, faces.

Segments have project_id, uuid, x0, y0, x1, y1."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalar import along, crossing, dist, folded, angle180, q, to_segment
from gridloom.operators.graph import components, first_leaders, min_over_cycle
from gridloom.operators.matching import A, B, cols, project_nearest
from gridloom.operators.ranks import ranked
from gridloom.operators.spatial import BOX, best, box_join, point_box, with_box
from gridloom.session import Scratch

C = F.col
SEG = ("x0", "y0", "x1", "y1")


def _ends(segs: DataFrame) -> DataFrame:
    """project_id, uuid, k, x, y: both ends of each segment."""
    ends = F.array(F.struct(F.lit(0).alias("k"), C("x0").alias("x"), C("y0").alias("y")), F.struct(F.lit(1).alias("k"), C("x1").alias("x"), C("y1").alias("y")))
    return segs.select("project_id", "uuid", F.explode(ends).alias("e")).select("project_id", "uuid", "e.*")


def snap_to_leaders(points: DataFrame, tolerance: float) -> DataFrame:
    """project_id, pid, leader: points (pid in their order, x, y) to the nearest earlier
    leader nearer than the tolerance; a point with none leads itself."""
    box = point_box(points, "x", "y")
    near = box_join(box, box, ["project_id"], max(tolerance, 1.0) * 4, tolerance)
    near = near.withColumn("d", dist(C("x"), C("y"), C("r_x"), C("r_y"))).where((C("d") < tolerance) & (C("pid") > C("r_pid")))
    lead = first_leaders(points, near.select("project_id", C("r_pid").alias("a"), C("pid").alias("b")), ["project_id", "pid"])
    to = near.join(lead.where("is_leader").select("project_id", C("pid").alias("r_pid")), ["project_id", "r_pid"], "left_semi")
    to = best(to, ["project_id", "pid"], [C("d"), C("r_x"), C("r_y"), C("r_pid")], ["r_pid"])
    got = lead.join(to, ["project_id", "pid"], "left")
    return got.select("project_id", "pid", F.when(C("is_leader"), C("pid")).otherwise(C("r_pid")).alias("leader"))


def merge_collinear(segs: DataFrame, tolerance: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Chains of touching segments of one direction as one segment each: project_id, chain
    (least uuid), n, x0, y0, x1, y1. Two segments touch if two of their ends lie nearer than
    the tolerance, and are collinear if their directions differ by less than 2.5 degrees.

    Growing one segment at a time to a fixed point never leaves its chain, so chains are
    components; their ends are the extreme points along their first direction."""
    keys = ["project_id", *by]
    s = with_box(segs.select(*keys, "uuid", *SEG))
    pairs = box_join(s, s, keys, max(tolerance * 4, 1000.0), tolerance).where("uuid < r_uuid")
    gaps = [dist(C(f"x{i}"), C(f"y{i}"), C(f"r_x{j}"), C(f"r_y{j}")) for i in (0, 1) for j in (0, 1)]
    turn = folded(angle180(*cols(A)), angle180(*cols(B)))
    pairs = pairs.where((F.least(*gaps) < tolerance) & (turn < 2.5))
    chain = components(segs.select("project_id", "uuid"), pairs.select("project_id", C("uuid").alias("a"), C("r_uuid").alias("b")), ["project_id", "uuid"], "chain")
    rows = segs.select(*keys, "uuid", *SEG).join(chain, ["project_id", "uuid"])
    first = rows.where(C("uuid") == C("chain")).select("project_id", "chain", (C("x1") - C("x0")).alias("dx"), (C("y1") - C("y0")).alias("dy"))
    ends = rows.select("project_id", "chain", "uuid", F.explode(F.array(F.struct(C("x0").alias("x"), C("y0").alias("y")), F.struct(C("x1").alias("x"), C("y1").alias("y")))).alias("p"))
    ends = ends.join(first, ["project_id", "chain"]).withColumn("s", F.struct((C("p.x") * C("dx") + C("p.y") * C("dy")).alias("s"), C("p.x").alias("x"), C("p.y").alias("y")))
    got = ends.groupBy("project_id", "chain").agg(F.min("s").alias("a"), F.max("s").alias("b"), (F.count(F.lit(1)) / 2).cast("int").alias("n"))
    return got.select("project_id", "chain", "n", C("a.x").alias("x0"), C("a.y").alias("y0"), C("b.x").alias("x1"), C("b.y").alias("y1"))


def snap_t_junctions(segs: DataFrame, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """(segments with snapped ends, splits): an end that projects inside another segment
    nearer than the tolerance moves onto it. All moves are applied at once, to targets as they
    stand after their own ends moved. splits: project_id, uuid (the target), x, y."""
    scratch = Scratch(segs.sparkSession, "snap")
    ends = _ends(segs).withColumn("pid", F.struct("uuid", "k"))
    hits = scratch.save(project_nearest(ends.select("project_id", "pid", C("uuid").alias("own"), "x", "y"), segs, tolerance, max(tolerance * 4, 1000.0), own="own").select("project_id", C("pid.uuid").alias("uuid"), C("pid.k").alias("k"), "wall_uuid", "fx", "fy"), "hits")
    def moved(src: DataFrame, h: DataFrame) -> DataFrame:
        out = src
        for k in (0, 1):
            one = h.where(C("k") == k).select("project_id", "uuid", C("fx").alias(f"_fx{k}"), C("fy").alias(f"_fy{k}"))
            out = out.join(one, ["project_id", "uuid"], "left").withColumns({f"x{k}": F.coalesce(f"_fx{k}", f"x{k}"), f"y{k}": F.coalesce(f"_fy{k}", f"y{k}")}).drop(f"_fx{k}", f"_fy{k}")
        return out
    first = moved(segs.select("project_id", "uuid", *SEG), hits)
    target = first.select("project_id", C("uuid").alias("wall_uuid"), *[C(c).alias(f"t_{c}") for c in SEG])
    t = along(C("fx"), C("fy"), C("t_x0"), C("t_y0"), C("t_x1"), C("t_y1"))
    again = hits.join(target, ["project_id", "wall_uuid"]).withColumn("t", t)
    again = again.select("project_id", "uuid", "k", "wall_uuid", "t", (C("t_x0") + C("t") * (C("t_x1") - C("t_x0"))).alias("fx"), (C("t_y0") + C("t") * (C("t_y1") - C("t_y0"))).alias("fy"))
    again = scratch.save(again, "again")
    return moved(first, again.select("project_id", "uuid", "k", "fx", "fy")), again.where("t > 0 AND t < 1").select("project_id", C("wall_uuid").alias("uuid"), C("fx").alias("x"), C("fy").alias("y"))


def planar_parts(segs: DataFrame, splits: DataFrame | None = None, cell: float = 5_000.0, touch: float = 1e-6) -> DataFrame:
    """Segments cut wherever they cross, touch or overlap, as distinct undirected parts
    with ends at three decimals: project_id, x0, y0, x1, y1.

    Overlaps are cut at the ends of the other segment and become equal parts, which are
    one. Parts without length go."""
    s = with_box(segs.select("project_id", "uuid", *SEG))
    pairs = box_join(s, s, ["project_id"], cell, touch).where("uuid <> r_uuid")
    t, u, _ = crossing(cols(A), cols(B))
    crossed = pairs.withColumns({"t": t, "u": u}).where(C("t").between(0, 1) & C("u").between(0, 1))
    cut = crossed.select("project_id", "uuid", (C("x0") + C("t") * (C("x1") - C("x0"))).alias("x"), (C("y0") + C("t") * (C("y1") - C("y0"))).alias("y"))
    for k in (0, 1):
        on = pairs.where(to_segment(C(f"r_x{k}"), C(f"r_y{k}"), *cols(A)) <= touch)
        cut = cut.unionByName(on.select("project_id", "uuid", C(f"r_x{k}").alias("x"), C(f"r_y{k}").alias("y")))
    cut = cut.unionByName(_ends(segs).select("project_id", "uuid", "x", "y"))
    if splits is not None:
        cut = cut.unionByName(splits.select("project_id", "uuid", "x", "y"))
    cut = cut.select("project_id", "uuid", q(C("x"), 3).alias("x"), q(C("y"), 3).alias("y")).distinct()
    placed = cut.join(segs.select("project_id", "uuid", *SEG), ["project_id", "uuid"]).withColumn("t", along(C("x"), C("y"), *cols(A)))
    w = Window.partitionBy("project_id", "uuid").orderBy("t", "x", "y")
    part = placed.withColumns({"nx": F.lead("x").over(w), "ny": F.lead("y").over(w)}).where("nx IS NOT NULL AND (nx <> x OR ny <> y)")
    a, b = F.struct(C("x").alias("x"), C("y").alias("y")), F.struct(C("nx").alias("x"), C("ny").alias("y"))
    both = part.select("project_id", F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    return both.select("project_id", C("a.x").alias("x0"), C("a.y").alias("y0"), C("b.x").alias("x1"), C("b.y").alias("y1"))


def graph_of(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: project_id, id, x, y, degree; edges: project_id, id, a, b, length) with ids by place."""
    scratch = Scratch(parts.sparkSession, "graph")
    parts = scratch.save(parts, "parts")
    ends = parts.select("project_id", C("x0").alias("x"), C("y0").alias("y")).unionAll(parts.select("project_id", "x1", "y1"))
    deg = ends.groupBy("project_id", "x", "y").agg(F.count(F.lit(1)).alias("degree"))
    nodes = ranked(deg, ["project_id"], ["x", "y"], "id").select("project_id", (C("id") - 1).alias("id"), "x", "y", "degree")
    nodes = scratch.save(nodes, "nodes")
    at = lambda k, n: nodes.select("project_id", C("x").alias(f"x{k}"), C("y").alias(f"y{k}"), C("id").alias(n))
    e = parts.join(at(0, "a"), ["project_id", "x0", "y0"]).join(at(1, "b"), ["project_id", "x1", "y1"])
    return nodes, ranked(e, ["project_id"], ["a", "b"], "id").select("project_id", (C("id") - 1).alias("id"), "a", "b", q(dist(*cols(SEG)), 3).alias("length"))


def _rings(half: DataFrame) -> DataFrame:
    """half-edges (project_id, a, b, ax, ay, bx, by) with the ring that each lies on."""
    out = half.withColumn("turn", F.atan2(C("by") - C("ay"), C("bx") - C("ax")))
    w = Window.partitionBy("project_id", "a").orderBy("turn", "b")
    fan = out.withColumn("before", F.coalesce(F.lag("b").over(w), F.last("b").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    # after a -> b the ring goes on with the edge that comes before b -> a around b
    follow = fan.select("project_id", C("a").alias("b"), C("b").alias("a"), C("before").alias("c"))
    half2 = half.join(follow, ["project_id", "a", "b"])
    id_ = lambda x, y: F.struct(C(x).alias("p"), C(y).alias("q"))
    nxt = half2.select("project_id", id_("a", "b").alias("h"), id_("b", "c").alias("f"))
    ring = min_over_cycle(nxt, "project_id", "h", "f")
    return half2.withColumn("h", id_("a", "b")).join(ring, ["project_id", "h"]).drop("h", "c")


def faces(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Bounded faces of a planar graph: project_id, ring, area (of the outer ring less its
    holes), n_edges, min_x, min_y, n_holes. Dangling edges and bridges belong to none.

    Half-edges follow each other by angle around nodes, and rings get their least half-edge by
    pointer doubling. An edge with one ring on both sides is a bridge or dangles; without those
    no edge is one, so that rings are found twice at most. Rings that run counter-clockwise
    are faces. A ring that runs clockwise is the outline of its component: it is a hole of the
    smallest face of another component that holds its lowest corner. Areas are taken from the
    project's corner, so that far coordinates keep their digits."""
    scratch = Scratch(nodes.sparkSession, "faces")
    e = edges.select("project_id", "a", "b")
    at = lambda k: nodes.select("project_id", C("id").alias(k), C("x").alias(f"{k}x"), C("y").alias(f"{k}y"))
    both = e.union(e.select("project_id", C("b"), C("a")))
    half = scratch.save(both.join(at("a"), ["project_id", "a"]).join(at("b"), ["project_id", "b"]), "half")

    def sides(half: DataFrame) -> tuple[DataFrame, int]:
        rung = scratch.save(_rings(half), "rings")
        back = rung.select("project_id", C("a").alias("b"), C("b").alias("a"), C("ring").alias("other"))
        marked = rung.join(back, ["project_id", "a", "b"]).withColumn("is_bridge", C("ring") == C("other")).drop("other")
        kept, seen = scratch.save_with(marked, "kept", bridges=F.count_if("is_bridge"))
        return kept, seen["bridges"] or 0
    kept, bridges = sides(half)
    if bridges:
        kept, bridges = sides(scratch.save(kept.where(~C("is_bridge")).drop("ring", "is_bridge"), "half"))
        if bridges:
            raise RuntimeError("an edge of a ring lies on one side only: the graph isn't planar")
    corner = nodes.groupBy("project_id").agg(F.min("x").alias("ox"), F.min("y").alias("oy"))
    cross = (C("ax") - C("ox")) * (C("by") - C("oy")) - (C("bx") - C("ox")) * (C("ay") - C("oy"))
    first = F.min(F.struct(C("ax").alias("x"), C("ay").alias("y"))).alias("first")
    got = kept.join(corner, "project_id").groupBy("project_id", "ring").agg((F.sum(cross) / 2).alias("area"), F.count(F.lit(1)).alias("n_edges"), F.min("ax").alias("min_x"), F.min("ay").alias("min_y"), F.max("ax").alias("max_x"), F.max("ay").alias("max_y"), first)
    got = scratch.save(got, "found")
    inner = got.where("area > 0").select("project_id", "ring", "area", "n_edges", "min_x", "min_y", "max_x", "max_y")
    holes = _holes(scratch, inner, got.where("area < 0"), kept)
    lost = holes.groupBy("project_id", "ring").agg(F.sum("hole").alias("hole"), F.count(F.lit(1)).alias("n_holes"))
    out = inner.join(lost, ["project_id", "ring"], "left")
    return out.select("project_id", "ring", (C("area") - F.coalesce("hole", F.lit(0.0))).alias("area"), "n_edges", "min_x", "min_y", F.coalesce("n_holes", F.lit(0)).alias("n_holes"))


def _holes(scratch: Scratch, inner: DataFrame, outlines: DataFrame, kept: DataFrame) -> DataFrame:
    """project_id, ring (of the face), hole (area of the outline in it).

    Candidates are faces whose box holds the outline's box; a ray to the right of the outline's
    first corner counts the sides of a candidate that it meets. A component's own faces touch its
    outline: they end at the corner or begin there, and a face whose box begins at the outline's
    corner or has it as a vertex holds nothing of it."""
    o = outlines.select("project_id", C("ring").alias("outline"), (-C("area")).alias("hole"), C("first.x").alias("px"), C("first.y").alias("py"), "min_x", "min_y", "max_x", "max_y")
    f = inner.select("project_id", "ring", "area", "min_x", "min_y", "max_x", "max_y")
    pairs = box_join(point_box(o.select("project_id", "outline", "hole", "px", "py", C("max_x").alias("ox"), C("max_y").alias("oy"), C("min_y").alias("o_min_y")), "px", "py"), f, ["project_id"], 5_000.0)
    inside = (C("r_min_x") < C("px")) & (C("r_max_x") > C("ox")) & (C("r_min_y") < C("o_min_y")) & (C("r_max_y") > C("oy"))
    pairs = scratch.save(pairs.where(inside).select("project_id", "outline", "hole", "px", "py", C("r_ring").alias("ring"), C("r_area").alias("area")), "nested")
    sides = kept.join(pairs.select("project_id", "ring").distinct(), ["project_id", "ring"], "left_semi").select("project_id", "ring", "ax", "ay", "bx", "by")
    meets = ((C("ay") > C("py")) != (C("by") > C("py"))) & (C("px") < (C("bx") - C("ax")) * (C("py") - C("ay")) / F.nullif(C("by") - C("ay"), F.lit(0.0)) + C("ax"))
    hit = pairs.join(sides, ["project_id", "ring"]).groupBy("project_id", "outline", "hole", "ring", "area").agg(F.count_if(meets).alias("k")).where("k % 2 = 1")
    return best(hit, ["project_id", "outline"], [C("area"), C("ring")], ["ring", "hole"]).select("project_id", "ring", "hole")


def dbscan(points: DataFrame, eps: float, least: int) -> DataFrame:
    """project_id, pid, label: density clusters of points (pid, x, y). Core points have
    `least` points or more within eps, themselves included; a border point joins the cluster
    of its least-labelled core neighbour; noise is -1. Labels are the least core pid."""
    scratch = Scratch(points.sparkSession, "dbscan")
    box = point_box(points, "x", "y")
    near = box_join(box, box, ["project_id"], eps * 4, eps).where(dist(C("x"), C("y"), C("r_x"), C("r_y")) <= eps)
    near = scratch.save(near.select("project_id", "pid", "r_pid"), "near")
    core = scratch.save(near.groupBy("project_id", "pid").agg(F.count(F.lit(1)).alias("n")).where(C("n") >= least).select("project_id", "pid"), "core")
    links = near.join(core, ["project_id", "pid"], "left_semi").join(core.withColumnRenamed("pid", "r_pid"), ["project_id", "r_pid"], "left_semi")
    label = components(core, links.select("project_id", C("pid").alias("a"), C("r_pid").alias("b")), ["project_id", "pid"], "label")
    reach = near.join(label.withColumnRenamed("pid", "r_pid"), ["project_id", "r_pid"]).groupBy("project_id", "pid").agg(F.min("label").alias("reached"))
    got = points.select("project_id", "pid").join(label, ["project_id", "pid"], "left").join(reach, ["project_id", "pid"], "left")
    return got.select("project_id", "pid", F.coalesce("label", "reached", F.lit(-1)).alias("label"))


#: Each look into open pairs of cells has this many times narrower parts.
FINER = 4
#: Farther out than this, doubles are too coarse for cells.
OUTER = 1e15


def _parts(points: DataFrame, keys: list[str], side: float) -> DataFrame:
    """keys, the box of their points, and px, py: the point nearest to the middle of the cell (cx, cy)."""
    inner = F.min(F.struct(dist(C("x"), C("y"), (C("cx") + 0.5) * side, (C("cy") + 0.5) * side).alias("d"), "x", "y"))
    got = points.groupBy(*keys).agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"), inner.alias("p"))
    return got.select(*keys, "min_x", "min_y", "max_x", "max_y", C("p.x").alias("px"), C("p.y").alias("py"))


def _bounds() -> tuple[Column, Column]:
    """Of the least distance between the points of two parts (the second's columns with r_)."""
    gap = [F.greatest(F.lit(0.0), C(f"r_min_{k}") - C(f"max_{k}"), C(f"min_{k}") - C(f"r_max_{k}")) for k in "xy"]
    return F.sqrt(gap[0] * gap[0] + gap[1] * gap[1]), dist(C("px"), C("py"), C("r_px"), C("r_py"))


def count_within(points: DataFrame, tolerances: tuple[int, ...]) -> DataFrame:
    """tolerance, n_components: components of the points (project_id, x, y; no nulls in x, y) of
    each project, two being linked if not farther apart than the tolerance. A point with a coordinate
    that is infinite or no number is alone. Points of no project are alone too, under a null tolerance.

    Pairs of points aren't listed: a crowded project has as many as the square of its points.
    Points of one cell, 0.7 of the least tolerance wide, are linked anyway, and of two cells it only
    matters whether their nearest points are. The distance of their boxes and that of one point
    of each bound it, and for cells of one point each are it. Pairs of cells that this leaves open and that
    other links haven't joined are looked at in narrower parts, until none is left. Rounding
    never turns bounds round, so counts are those of all pairs."""
    scratch = Scratch(points.sparkSession, "within")
    side, far = 0.7 * min(tolerances), float(max(tolerances))
    tol = F.explode(F.array(*[F.lit(t) for t in tolerances])).alias("tolerance")
    finite = (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    outer = F.greatest(F.abs("x"), F.abs("y")) > OUTER
    at = {f"c{k}": F.when(finite, F.when(outer, C(k)).otherwise(F.floor(C(k) / side).cast("double"))) for k in "xy"}
    pts = scratch.save(points.select("project_id", "x", "y").withColumns(at), "points")
    own = pts.where("project_id IS NOT NULL AND cx IS NOT NULL")
    cells = _parts(own, ["project_id", "cx", "cy"], side)
    cells = scratch.save(cells.withColumn("cell", F.monotonically_increasing_id()), "cells")

    lo, hi = _bounds()
    pairs = box_join(cells, cells, ["project_id"], far * 4, far * 1.001).where("cell < r_cell").withColumns({"lo": lo, "hi": hi}).where(C("lo") <= far)
    # (ax, ay), (bx, by): the parts in question
    pairs = scratch.save(pairs.select(C("cell").alias("a"), C("r_cell").alias("b"), C("cx").alias("ax"), C("cy").alias("ay"), C("r_cx").alias("bx"), C("r_cy").alias("by"), "lo", "hi"), "pairs").select("*", tol).where("lo <= tolerance")
    links = pairs.where("hi <= tolerance").select("tolerance", "a", "b")
    label = components(links.select("tolerance", F.explode(F.array("a", "b")).alias("n")), links, ["tolerance", "n"])
    merged = [label.where("n <> component")]
    # la, lb: the components of the two cells so far
    rest = pairs.where("hi > tolerance").join(label.toDF("tolerance", "a", "la"), ["tolerance", "a"], "left").join(label.toDF("tolerance", "b", "lb"), ["tolerance", "b"], "left")
    rest = rest.withColumns({"la": F.coalesce("la", "a"), "lb": F.coalesce("lb", "b")}).where("la <> lb").drop("lo", "hi")
    found: list[DataFrame] = []
    while True:
        rest, seen = scratch.save_with(rest, "open", n=F.count(F.lit(1)))
        if not seen["n"]:
            break
        side /= FINER
        inside = cells.join(rest.select(F.explode(F.array("a", "b")).alias("cell")).distinct(), "cell", "left_semi").select("project_id", "cx", "cy", "cell")
        inside = own.join(inside, ["project_id", "cx", "cy"]).select("cell", "x", "y", *[F.floor(C(k) / side).cast("double").alias(f"c{k}") for k in "xy"])
        parts = scratch.save(_parts(inside, ["cell", "cx", "cy"], side), "parts")
        up = [C("cell"), F.floor(C("cx") / FINER).cast("double"), F.floor(C("cy") / FINER).cast("double")]
        one = parts.select(*[c.alias(k) for c, k in zip(up, ("a", "ax", "ay"))], C("cx").alias("nax"), C("cy").alias("nay"), *BOX, "px", "py")
        two = parts.select(*[c.alias(k) for c, k in zip(up, ("b", "bx", "by"))], C("cx").alias("nbx"), C("cy").alias("nby"), *[C(c).alias(f"r_{c}") for c in (*BOX, "px", "py")])
        finer = rest.join(one, ["a", "ax", "ay"]).join(two, ["b", "bx", "by"]).withColumns({"lo": lo, "hi": hi}).where("lo <= tolerance")
        finer = scratch.save(finer.select("tolerance", "a", "b", C("nax").alias("ax"), C("nay").alias("ay"), C("nbx").alias("bx"), C("nby").alias("by"), "la", "lb", "hi"), "finer")
        found.append(finer.where("hi <= tolerance").select("tolerance", "la", "lb").distinct())
        rest = finer.where("hi > tolerance").drop("hi").join(found[-1], ["tolerance", "la", "lb"], "left_anti")
    if found:
        links = reduce(DataFrame.unionAll, found).toDF("tolerance", "a", "b")
        merged.append(components(links.select("tolerance", F.explode(F.array("a", "b")).alias("n")), links, ["tolerance", "n"]).where("n <> component"))
    all_ = cells.select(tol).unionAll(pts.where("project_id IS NOT NULL AND cx IS NULL").select(tol)).unionAll(pts.where("project_id IS NULL").select(F.lit(None).cast("int"))).withColumn("k", F.lit(1))
    for m in merged:
        all_ = all_.unionAll(m.select("tolerance", F.lit(-1)))
    return all_.groupBy("tolerance").agg(F.sum("k").alias("n_components"))
