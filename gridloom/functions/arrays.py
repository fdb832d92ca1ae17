"""Vertex lists (arrays of [x, y] or of structs with x and y) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def xy(points: Column) -> Column:
    """[[x, y, ...], ...] as structs; points with fewer than two numbers are left out."""
    good = F.filter(points, lambda p: F.size(p) >= 2)
    return F.transform(good, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))


def sides(v: Column, closed: bool) -> Column:
    """Consecutive pairs (pos, x0, y0, x1, y1), with the closing one if closed; fewer
    than two vertices have none."""
    n = F.size(v)
    last = n - 1 if closed else n - 2
    pair = lambda i: F.struct(i.alias("pos"), F.get(v, i)["x"].alias("x0"), F.get(v, i)["y"].alias("y0"), F.get(v, (i + 1) % n)["x"].alias("x1"), F.get(v, (i + 1) % n)["y"].alias("y1"))
    return F.when(n >= 2, F.transform(F.sequence(F.lit(0), last), pair)).otherwise(F.expr("CAST(array() AS array<struct<pos:int,x0:double,y0:double,x1:double,y1:double>>)"))


def bounds(v: Column) -> Column:
    xs, ys = F.transform(v, lambda p: p["x"]), F.transform(v, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


def mean_point(v: Column) -> Column:
    n = F.size(v)
    total = lambda f: F.aggregate(v, F.lit(0.0), lambda a, p: a + p[f])
    return F.struct((total("x") / F.when(n > 0, n)).alias("x"), (total("y") / F.when(n > 0, n)).alias("y"))


def signed_area(v: Column) -> Column:
    """Shoelace, relative to the first vertex, so that far coordinates keep their digits."""
    ox, oy = F.get(v, F.lit(0))["x"], F.get(v, F.lit(0))["y"]
    return F.aggregate(sides(v, True), F.lit(0.0), lambda a, s: a + (s["x0"] - ox) * (s["y1"] - oy) - (s["x1"] - ox) * (s["y0"] - oy)) / 2.0


def perimeter(v: Column) -> Column:
    def one(a: Column, s: Column) -> Column:
        dx, dy = s["x1"] - s["x0"], s["y1"] - s["y0"]
        return a + F.sqrt(dx * dx + dy * dy)
    return F.aggregate(sides(v, True), F.lit(0.0), one)


def path_length(v: Column) -> Column:
    def one(a: Column, s: Column) -> Column:
        dx, dy = s["x1"] - s["x0"], s["y1"] - s["y0"]
        return a + F.sqrt(dx * dx + dy * dy)
    return F.aggregate(sides(v, False), F.lit(0.0), one)


def longest_side(v: Column, closed: bool = False) -> Column:
    """The longest side, the first of equals."""
    keyed = F.transform(sides(v, closed), lambda s: F.struct(((s["x1"] - s["x0"]) * (s["x1"] - s["x0"]) + (s["y1"] - s["y0"]) * (s["y1"] - s["y0"])).alias("n"), (-s["pos"]).alias("k"), s.alias("s")))
    return F.array_max(keyed)["s"]


def contains(v: Column, px: Column, py: Column) -> Column:
    """Whether a ring holds a point, by the parity of crossings of a ray to the right."""
    def flips(s: Column) -> Column:
        straddles = (s["y0"] > py) != (s["y1"] > py)
        x = (s["x1"] - s["x0"]) * (py - s["y0"]) / F.when(s["y1"] != s["y0"], s["y1"] - s["y0"]) + s["x0"]
        return F.when(straddles & (px < x), 1).otherwise(0)
    return F.aggregate(sides(v, True), F.lit(0), lambda a, s: a + flips(s)) % 2 == 1


def without_near(v: Column, least: float = 1e-2) -> Column:
    """The vertices that lie further than `least` from the last one kept."""
    def step(kept: Column, p: Column) -> Column:
        last = F.element_at(kept, -1)
        far = (p["x"] - last["x"]) * (p["x"] - last["x"]) + (p["y"] - last["y"]) * (p["y"] - last["y"]) > least * least
        return F.when((F.size(kept) == 0) | far, F.concat(kept, F.array(p))).otherwise(kept)
    first = F.slice(v, 1, 1)
    return F.when(F.size(v) == 0, v).otherwise(F.aggregate(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(1))), first, step))


def _from_least(v: Column) -> Column:
    at = F.array_position(v, F.array_min(v)).cast("int")
    return F.concat(F.slice(v, at, F.size(v)), F.slice(v, 1, at - 1))


def canonical_ring(v: Column) -> Column:
    """The ring from its least vertex on, in the sense that comes first in order; the
    same for every rotation and either sense. A repeated closing vertex goes."""
    n = F.size(v)
    open_ring = F.when((n > 1) & (F.get(v, F.lit(0)) == F.element_at(v, -1)), F.slice(v, 1, n - 1)).otherwise(v)
    return F.when(n > 0, F.least(_from_least(open_ring), _from_least(F.reverse(open_ring)))).otherwise(v)
