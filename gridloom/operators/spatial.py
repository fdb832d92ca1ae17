"""Joins of boxes, points and segments through a grid of several cell sizes.

Catalyst has no range join: a bare condition on boxes becomes a nested loop. Here each
row falls into at most four cells of the level that suits its size, and of the coarser
levels in use, and pairs meet by an equi-join on (keys, level, cell). A pair is kept
only in the cell of its lowest common corner, so that no distinct is needed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalar import box_meets, dist
from gridloom.session import Scratch

#: Each level's cells are this much wider than those below.
STEP = 4.0
MAX_LEVEL = 20
BOX = ("min_x", "min_y", "max_x", "max_y")


def _level(cell: float, a: Sequence[Column]) -> Column:
    size = F.greatest(a[2] - a[0], a[3] - a[1], F.lit(cell))
    return F.least(F.lit(MAX_LEVEL), F.ceil(F.log(size / F.lit(cell)) / F.log(F.lit(STEP)) - F.lit(1e-9)).cast("int"))


def _cells(df: DataFrame, box: Sequence[str], cell: float, levels: list[int]) -> DataFrame:
    """Rows by level and cell. `_own` is the row's own level."""
    own = _level(cell, [F.col(c) for c in box])
    up = F.filter(F.array(*[F.lit(k) for k in levels]), lambda k: k >= F.col("_own"))
    out = df.withColumn("_own", own).withColumn("_level", F.explode(up))
    width = F.lit(cell) * F.pow(F.lit(STEP), F.col("_level"))
    at = [F.floor(F.col(c) / width) for c in box]
    return out.withColumn("_cx", F.explode(F.sequence(at[0], at[2]))).withColumn("_cy", F.explode(F.sequence(at[1], at[3])))


def box_join(left: DataFrame, right: DataFrame, keys: Sequence[str], cell: float, slack: float = 0.0, left_box: Sequence[str] = BOX, right_box: Sequence[str] = BOX) -> DataFrame:
    """All pairs of rows with equal keys whose closed boxes come within `slack` of each
    other on both axes. Columns of the right side come back with the prefix r_.

    Rows with a null in a box or key pair with nothing. A hot cell may be split by AQE as a
    skewed join key; its pairs are the result."""
    l = left.dropna(subset=[*keys, *left_box])
    r = right.dropna(subset=[*keys, *right_box])
    r = r.select(*[F.col(c).alias(f"r_{c}") for c in r.columns])
    rb = [f"r_{c}" for c in right_box]
    l = l.withColumns({f"_l{i}": F.col(c) + F.lit(-slack if i < 2 else slack) for i, c in enumerate(left_box)})
    lb = [f"_l{i}" for i in range(4)]
    found = l.select(_level(cell, [F.col(c) for c in lb]).alias("k")).distinct().union(r.select(_level(cell, [F.col(c) for c in rb]).alias("k")).distinct()).distinct()
    levels = sorted(x[0] for x in found.collect())  # MAX_LEVEL + 1 numbers at most
    if not levels:
        levels = [0]
    lc = _cells(l, lb, cell, levels).withColumnRenamed("_own", "_lown")
    rc = _cells(r, rb, cell, levels).withColumnRenamed("_own", "_rown")
    on = (F.col("_level") == F.col("r__level")) & (F.col("_cx") == F.col("r__cx")) & (F.col("_cy") == F.col("r__cy"))
    for c in ("_level", "_cx", "_cy"):
        rc = rc.withColumnRenamed(c, f"r_{c}")
    for k in keys:
        on = on & (F.col(k) == F.col(f"r_{k}"))
    pairs = lc.join(rc, on).where(F.col("_level") == F.greatest("_lown", "_rown"))
    width = F.lit(cell) * F.pow(F.lit(STEP), F.col("_level"))
    here = (F.col("_cx") == F.floor(F.greatest(F.col(lb[0]), F.col(rb[0])) / width)) & (F.col("_cy") == F.floor(F.greatest(F.col(lb[1]), F.col(rb[1])) / width))
    meets = box_meets([F.col(c) for c in lb], [F.col(c) for c in rb])
    return pairs.where(here & meets).drop("_level", "_cx", "_cy", "_lown", "_rown", "r__level", "r__cx", "r__cy", *lb, *[f"r_{k}" for k in keys])


def with_box(df: DataFrame, x0: str = "x0", y0: str = "y0", x1: str = "x1", y1: str = "y1") -> DataFrame:
    """Adds the box of a segment."""
    return df.withColumns({"min_x": F.least(x0, x1), "min_y": F.least(y0, y1), "max_x": F.greatest(x0, x1), "max_y": F.greatest(y0, y1)})


def point_box(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.withColumns({"min_x": F.col(x), "min_y": F.col(y), "max_x": F.col(x), "max_y": F.col(y)})


def best(pairs: DataFrame, ids: Sequence[str], order: Sequence[Column], take: Sequence[str]) -> DataFrame:
    """The `take` columns of the pair that comes first for each id. Partly aggregated, no sort."""
    value = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(t) for t in take])
    got = pairs.groupBy(*ids).agg(F.min(value).alias("_b"))
    return got.select(*ids, *[F.col(f"_b.{t}").alias(t) for t in take])


def nearest(points: DataFrame, targets: DataFrame, keys: Sequence[str], ids: Sequence[str], order: Column, take: Sequence[str], start: float, distance: Column | None = None, growth: float = 4.0) -> DataFrame:
    """For each point (columns x, y) the target box with the least distance, however
    far. `distance` is over a pair's columns (r_... for the target); it can't be less than the
    distance of the boxes on one axis. By default the targets are points r_x, r_y.

    The search goes outward: points without an answer within the radius go on with a
    larger one, until none is left or the radius passes the extent of all; so no step pairs all
    points with all targets."""
    scratch = Scratch(points.sparkSession, "nearest")
    d = distance if distance is not None else dist(F.col("x"), F.col("y"), F.col("r_x"), F.col("r_y"))
    targets = scratch.save(targets.dropna(subset=[*keys, *BOX]), "targets")
    has = targets.select(*keys).distinct()
    left = scratch.save(point_box(points.dropna(subset=["x", "y", *keys]), "x", "y").join(has, list(keys), "left_semi"), "points")
    ends = left.select(*BOX).unionAll(targets.select(*BOX)).agg(F.min("min_x"), F.min("min_y"), F.max("max_x"), F.max("max_y")).first()
    extent = max(ends[2] - ends[0], ends[3] - ends[1]) * 1.5 if ends[0] is not None else 0.0
    radius, found, last = start, None, False
    while not last and not left.isEmpty():
        last = radius > extent
        pairs = box_join(left, targets, keys, radius, radius).withColumn("_d", d).where(F.col("_d") <= radius)
        step = scratch.save(best(pairs, ids, [F.col("_d"), order], ["_d", *take]), "step")
        found = step if found is None else found.unionByName(step)
        rest = scratch.save(left.join(step.select(*ids), list(ids), "left_anti"), "rest")
        scratch.drop(left)
        left, radius = rest, radius * growth
    if found is None:
        pairs = box_join(left, targets, keys, start, start).withColumn("_d", d)
        found = best(pairs, ids, [F.col("_d"), order], ["_d", *take]).limit(0)
    return found.withColumnRenamed("_d", "distance")
