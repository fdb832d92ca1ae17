"""Plane geometry, angles and layer classes as column expressions.

Rounding never uses round(), of which engines disagree; q(x, n) is
floor(x * 10^n + 0.5) / 10^n everywhere."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def q(x: Column, digits: int) -> Column:
    scale = F.lit(float(10**digits))
    return F.floor(x * scale + F.lit(0.5)) / scale


def exact_sum(x: Column, digits: int) -> Column:
    """Sum of the values in whole units of 10^-digits, so that the order of addition doesn't
    matter."""
    scale = F.lit(float(10**digits))
    return F.sum(F.floor(x * scale + F.lit(0.5)).cast("decimal(20,0)")).cast("double") / scale


def exact_mean(x: Column, digits: int) -> Column:
    return exact_sum(x, digits) / F.count(x)


def exact_spread(x: Column, digits: int) -> Column:
    """Standard deviation of the whole, from exact sums of units and of their squares."""
    scale = F.lit(float(10**digits))
    unit = F.floor(x * scale + F.lit(0.5)).cast("decimal(18,0)")
    n, s, s2 = F.count(x).cast("double"), F.sum(unit).cast("double"), F.sum((unit * unit).cast("decimal(38,0)")).cast("double")
    return F.sqrt(F.greatest(F.lit(0.0), s2 / n - (s / n) * (s / n))) / scale


def dist(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    dx, dy = x1 - x0, y1 - y0
    return F.sqrt(dx * dx + dy * dy)


def angle180(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Direction in [0, 180) degrees, without regard to sense."""
    a = F.degrees(F.atan2(y1 - y0, x1 - x0))
    a = F.when(a < 0, a + 180.0).otherwise(a)
    return F.when(a >= 180.0, a - 180.0).otherwise(a)


def folded(a: Column, b: Column) -> Column:
    """Difference of two directions, at most 90."""
    d = F.abs(a - b)
    return F.least(d, 180.0 - d)


def between_angle(dx0: Column, dy0: Column, dx1: Column, dy1: Column) -> Column:
    """Angle of two vectors in degrees, from 0 to 180; null where one has no length."""
    n = F.sqrt(dx0 * dx0 + dy0 * dy0) * F.sqrt(dx1 * dx1 + dy1 * dy1)
    cos = (dx0 * dx1 + dy0 * dy1) / F.when(n > 0, n)
    return F.when(n > 0, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))))


def along(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Where the foot of a point lies on a line through two points: 0 at the first, 1 at
    the second; 0 where they coincide."""
    dx, dy = x1 - x0, y1 - y0
    n = dx * dx + dy * dy
    return F.when(n < 1e-10, 0.0).otherwise(((px - x0) * dx + (py - y0) * dy) / F.when(n >= 1e-10, n))


def to_segment(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance of a point from a segment."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along(px, py, x0, y0, x1, y1)))
    return dist(px, py, x0 + t * (x1 - x0), y0 + t * (y1 - y0))


def box_gap(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Distance of two boxes (min x, min y, max x, max y); 0 where they meet."""
    zero = F.lit(0.0)
    gx = F.greatest(zero, a[0] - b[2], b[0] - a[2])
    gy = F.greatest(zero, a[1] - b[3], b[1] - a[3])
    return F.sqrt(gx * gx + gy * gy)


def box_contains(outer: Sequence[Column], inner: Sequence[Column], slack: float = 0.5) -> Column:
    return (inner[0] >= outer[0] - slack) & (inner[1] >= outer[1] - slack) & (inner[2] <= outer[2] + slack) & (inner[3] <= outer[3] + slack)


def box_meets(a: Sequence[Column], b: Sequence[Column], slack: float = 0.0) -> Column:
    """Closed boxes: touching counts."""
    return (a[0] <= b[2] + slack) & (a[2] >= b[0] - slack) & (a[1] <= b[3] + slack) & (a[3] >= b[1] - slack)


def crossing(a: Sequence[Column], b: Sequence[Column]) -> tuple[Column, Column, Column]:
    """(t, u, determinant) of the crossing of two segments (x0, y0, x1, y1); t and u are
    null where they are parallel."""
    ax, ay, bx, by = a[2] - a[0], a[3] - a[1], b[2] - b[0], b[3] - b[1]
    det = ax * by - ay * bx
    safe = F.when(det != 0, det)
    cx, cy = b[0] - a[0], b[1] - a[1]
    return (cx * by - cy * bx) / safe, (cx * ay - cy * ax) / safe, det


def sweep(start: Column, end: Column) -> Column:
    """The angle that an arc turns through, at most 180."""
    d = F.abs(F.pmod(end, F.lit(360.0)) - F.pmod(start, F.lit(360.0)))
    return F.when(d > 180, 360.0 - d).otherwise(d)


def node_type(degree: Column, opening: Column) -> Column:
    """Kind of a graph node from its degree, and for two edges the angle between them."""
    return F.when(degree <= 1, "end").when(degree == 2, F.when(opening > 165, "straight").otherwise("L_corner")).when(degree == 3, "T").otherwise("X")


def has_any(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def ladder(text: Column, steps: Sequence[tuple[str, Sequence[str]]], other: str | None) -> Column:
    """The first name of which a word occurs in the text."""
    out: Column | None = None
    for name, words in steps:
        hit = has_any(text, words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(F.lit(other))


# Words in a layer's name that give its class, first match first.
LAYER_CLASSES = (
    ("WALL", ("duvar",)),
    ("DOOR", ("kapı", "kapi")),
    ("WINDOW", ("pencere",)),
    ("COLUMN", ("kolon",)),
    ("STAIR", ("merdiven",)),
    ("HATCH", ("tarama", "hatch")),
    ("TEXT", ("yaz",)),
    ("DIMENSION", ("olcu", "ölçü", "kot")),
    ("AXIS", ("aks",)),
    ("FURNITURE", ("tefr",)),
)
# Words that make a layer a wall layer, and words that unmake it.
WALL_WORDS = ("walls", "duvar", "duvarlar")
NO_WALL_WORDS = ("kolon", "column", "pencere", "window", "aks", "axis", "kapı", "door", "kt")
# Words in layers that speak for a kind of drawing.
FLOOR_WORDS = ("duvar", "wall", "kapi", "kapı", "door", "pencere", "window", "kolon", "column", "merdiven", "stair", "stairs")
ROOF_WORDS = ("çatı", "cati", "roof")
ELEVATION_WORDS = ("görünüş", "gorunus", "görünü", "gorunu", "elevation", "cephe", "gor", "gör")
SECTION_WORDS = ("kesit", "section")
DETAIL_WORDS = ("detay", "detail", "node", "junction", "connection", "ayrıntı", "ayrinti")
# Millimetres in one drawing unit, by unit code; 1 for all others.
UNIT_MM = {1: 25.4, 2: 304.8, 4: 1.0, 5: 10.0, 6: 1000.0}


def clean_layer(layer: Column) -> Column:
    return F.lower(F.trim(layer))


def layer_class(layer: Column) -> Column:
    return ladder(clean_layer(layer), LAYER_CLASSES, "OTHER")


def is_wall_layer(layer: Column) -> Column:
    low = F.lower(layer)
    return has_any(low, WALL_WORDS) & ~has_any(low, NO_WALL_WORDS)


def drawing_kind(layer: Column) -> Column:
    low = F.lower(layer)
    return ladder(low, (("Roof Plan", ROOF_WORDS), ("Elevation", ELEVATION_WORDS), ("Section", SECTION_WORDS), ("Detail", DETAIL_WORDS), ("Floor Plan", FLOOR_WORDS)), None)


def match_key(text: Column) -> Column:
    """Upper-case letters and digits without accents, in words; compatibility forms as plain ones."""
    from gridloom.functions.text import plain_upper

    return F.trim(F.regexp_replace(plain_upper(text), "[^A-Z0-9?]+", " "))
