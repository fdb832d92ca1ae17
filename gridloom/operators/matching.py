"""Which opening, text or space belongs to which wall, box or region."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalar import along, between_angle, crossing, dist, to_segment
from gridloom.operators.spatial import best, box_join, point_box, with_box

C = F.col
A = ("x0", "y0", "x1", "y1")
B = ("r_x0", "r_y0", "r_x1", "r_y1")


def cols(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]


def segment_gap(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Distance of two segments: 0 where they cross, else the least of the four ends'."""
    t, u, _ = crossing(a, b)
    meet = F.coalesce(t.between(0, 1) & u.between(0, 1), F.lit(False))
    ends = F.least(to_segment(a[0], a[1], *b), to_segment(a[2], a[3], *b), to_segment(b[0], b[1], *a), to_segment(b[2], b[3], *a))
    return F.when(meet, 0.0).otherwise(ends)


def nearest_flags(items: DataFrame, walls: DataFrame, reach: float, cell: float) -> DataFrame:
    """For each item segment (project_id, uuid): the nearest wall within `reach` on both
    axes, its distance, and whether any such wall is parallel or perpendicular to it.
    Equal distances take the wall with the least uuid. Items without a wall come out with nulls."""
    pairs = box_join(with_box(items), with_box(walls), ["project_id"], cell, reach)
    d = segment_gap(cols(A), cols(B))
    angle = between_angle(C("x1") - C("x0"), C("y1") - C("y0"), C("r_x1") - C("r_x0"), C("r_y1") - C("r_y0"))
    got = pairs.groupBy("project_id", "uuid").agg(
        F.min(F.struct(d.alias("d"), C("r_uuid").alias("w"))).alias("b"),
        F.bool_or(F.coalesce((angle < 15) | (angle > 165), F.lit(False))).alias("parallel"),
        F.bool_or(F.coalesce((angle > 75) & (angle < 105), F.lit(False))).alias("perpendicular"),
    )
    near = got.select("project_id", "uuid", C("b.w").alias("wall_uuid"), C("b.d").alias("distance"), "parallel", "perpendicular")
    return items.select("project_id", "uuid", *A).join(near, ["project_id", "uuid"], "left")


def element_rules(flags: DataFrame, door_layer: Column, window_layer: Column, length: Column, curved: Column) -> DataFrame:
    """The kind of each element with confidence: geometry first, then the layer."""
    near = F.coalesce(C("distance") < 50.0, F.lit(False))
    sized = length.between(40, 400)
    par, per = F.coalesce("parallel", F.lit(False)), F.coalesce("perpendicular", F.lit(False))
    def pick(*steps: tuple[Column, str, float], other: tuple[str, float]) -> Column:
        out = F.lit(None)
        first = True
        for cond, kind, conf in steps:
            value = F.struct(F.lit(kind).alias("kind"), F.lit(conf).alias("confidence"))
            out = F.when(cond, value) if first else out.when(cond, value)
            first = False
        return out.otherwise(F.struct(F.lit(other[0]).alias("kind"), F.lit(other[1]).alias("confidence")))
    rule = pick(
        (near & sized & per, "Door", 0.85),
        (near & sized & par & window_layer, "Window", 0.9),
        (near & sized & par & door_layer, "Door", 0.9),
        (near & sized & par, "Unknown", 0.5),
        (near & sized & curved & door_layer, "Door", 0.8),
        (near & sized & curved & window_layer, "Window", 0.8),
        (near & sized & curved, "Unknown", 0.45),
        (near & sized, "Unknown", 0.5),
        (near & (length > 400) & par, "Unknown", 0.6),
        (near & (length > 400), "Unknown", 0.5),
        other=("Unknown", 1.0),
    )
    ruled = flags.withColumn("_r", rule)
    unknown = C("_r.kind") == "Unknown"
    kind = F.when(unknown & door_layer, "Door").when(unknown & window_layer, "Window").otherwise(C("_r.kind"))
    conf = F.when(unknown & (door_layer | window_layer), 0.6).otherwise(C("_r.confidence"))
    return ruled.withColumns({"kind": kind, "confidence": conf}).drop("_r")


def project_nearest(points: DataFrame, walls: DataFrame, tolerance: float, cell: float, own: str | None = None, inner: bool = True) -> DataFrame:
    """For each point (project_id, pid, x, y) the wall segment onto whose inside it
    projects within the tolerance: the least (distance, foot x, foot y, uuid). `own` names a
    column of the points with the segment that doesn't count."""
    pairs = box_join(point_box(points, "x", "y"), with_box(walls), ["project_id"], cell, tolerance)
    if own:
        pairs = pairs.where(C(own) != C("r_uuid"))
    t = along(C("x"), C("y"), *cols(B))
    pairs = pairs.withColumn("t", t)
    fx, fy = C("r_x0") + C("t") * (C("r_x1") - C("r_x0")), C("r_y0") + C("t") * (C("r_y1") - C("r_y0"))
    pairs = pairs.withColumns({"fx": fx, "fy": fy}).withColumn("d", dist(C("x"), C("y"), C("fx"), C("fy")))
    ok = (C("t") > 0.001) & (C("t") < 0.999) & (C("d") > 1e-4) & (C("d") < tolerance) if inner else C("d") < tolerance
    return best(pairs.where(ok), ["project_id", "pid"], [C("d"), C("fx"), C("fy"), C("r_uuid")], ["r_uuid", "t", "d", "fx", "fy"]).withColumnRenamed("r_uuid", "wall_uuid")


def crossings(walls: DataFrame, cell: float) -> DataFrame:
    """project_id, a, b, x, y: where two segments cross or touch; collinear overlaps have no
    single point and don't count. a < b."""
    side = with_box(walls.select("project_id", "uuid", *A))
    pairs = box_join(side, side, ["project_id"], cell).where(C("uuid") < C("r_uuid"))
    t, u, _ = crossing(cols(A), cols(B))
    pairs = pairs.withColumns({"t": t, "u": u}).where(C("t").between(0, 1) & C("u").between(0, 1))
    return pairs.select("project_id", C("uuid").alias("a"), C("r_uuid").alias("b"), (C("x0") + C("t") * (C("x1") - C("x0"))).alias("x"), (C("y0") + C("t") * (C("y1") - C("y0"))).alias("y"))


def greedy_matches(candidates: DataFrame, keys: Sequence[str], left: str, right: str, order: Sequence[str]) -> DataFrame:
    """One-to-one matches taken greedily: left items in order, each with its first free
    candidate. Equal to repeatedly taking all pairs that are the first of both their
    items among those left, when an item's order is that of its pairs; done in rounds until one
    takes no pair. The first pair of all is taken in every round, so this ends for any input."""
    from gridloom.session import Scratch

    scratch = Scratch(candidates.sparkSession, "greedy")
    key = F.struct(*[F.col(o) for o in order], F.col(left), F.col(right))
    rest = scratch.save(candidates.select(*keys, left, right, *[o for o in order if o not in (left, right)]).withColumn("_k", key), "pairs")
    taken = None
    n = 0
    while True:
        step, seen = scratch.save_with(_mutual(rest, keys, left, right), "step", n=F.count(F.lit(1)))
        if not seen["n"]:
            break
        taken = step if taken is None else taken.unionByName(step)
        n += 1
        if n % 50 == 0:  # one table for many, so that the plan stays small
            taken = scratch.save(taken, "taken")
        free = rest.join(step.select(*keys, left), [*keys, left], "left_anti").join(step.select(*keys, right), [*keys, right], "left_anti")
        new = scratch.save(free, "pairs")
        scratch.drop(rest)
        rest = new
    return taken if taken is not None else rest.select(*keys, left, right)


def _mutual(rest: DataFrame, keys: Sequence[str], left: str, right: str) -> DataFrame:
    """Pairs that come first for both their items."""
    l = rest.groupBy(*keys, left).agg(F.min("_k").alias("_kl"))
    r = rest.groupBy(*keys, right).agg(F.min("_k").alias("_kr"))
    both = rest.join(l, [*keys, left]).join(r, [*keys, right])
    return both.where((F.col("_k") == F.col("_kl")) & (F.col("_k") == F.col("_kr"))).select(*keys, left, right)
