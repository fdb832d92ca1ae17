"""Drawing exchange files (ASCII group codes) as a Spark data source.

spark.dataSource.register(DxfSource); spark.read.format("dxf").load("folder/*.dxf")

Each file is one partition; a file is read as a stream of (code, value) pairs and its
entities are yielded one by one. Reading is lenient: a file that ends early gives what it
holds, with `is_corrupt` set; nothing is written beside it. Options: `sagitta` (chord error of
sampled curves, 0.05), `depth` (levels of nested blocks, 16), `block` (read this block only)."""

from __future__ import annotations

import glob
import math
import os
from collections.abc import Iterable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridloom.functions.scalar import UNIT_MM

POINT = "struct<x:double,y:double,z:double>"
SCHEMA = (
    f"source_file string, entity_ord bigint, type string, layer string, block_name string, start {POINT}, end {POINT}, vertices array<{POINT}>, "
    f"closed boolean, position {POINT}, height double, text string, source_entity_type string, ancestry array<string>, scale_to_mm double, is_corrupt boolean"
)
Pair = tuple[int, str]


def pairs(lines: Iterable[str]) -> Iterator[Pair]:
    """Group codes with their values; a line that is no code ends the file's sense and is passed over."""
    it = iter(lines)
    for code in it:
        value = next(it, None)
        if value is None:
            return
        try:
            yield int(code.strip()), value.rstrip("\r\n")
        except ValueError:
            continue


def records(stream: Iterable[Pair]) -> Iterator[list[Pair]]:
    """Runs of pairs that begin with a code 0."""
    now: list[Pair] = []
    for p in stream:
        if p[0] == 0 and now:
            yield now
            now = []
        now.append(p)
    if now:
        yield now


class Matrix:
    """A plane transform x' = a x + c y + e, y' = b x + d y + f."""

    __slots__ = ("m",)

    def __init__(self, a=1.0, b=0.0, c=0.0, d=1.0, e=0.0, f=0.0):
        self.m = (a, b, c, d, e, f)

    def at(self, x: float, y: float) -> tuple[float, float]:
        a, b, c, d, e, f = self.m
        return a * x + c * y + e, b * x + d * y + f

    def of(self, o: Matrix) -> Matrix:
        """This transform after the other."""
        a, b, c, d, e, f = self.m
        p, q, r, s, t, u = o.m
        return Matrix(a * p + c * q, b * p + d * q, a * r + c * s, b * r + d * s, a * t + c * u + e, b * t + d * u + f)


def _num(rec: list[Pair], code: int, default: float = 0.0) -> float:
    for c, v in rec:
        if c == code:
            try:
                return float(v)
            except ValueError:
                return default
    return default


def _str(rec: list[Pair], code: int, default: str | None = None) -> str | None:
    return next((v for c, v in rec if c == code), default)


def curve(cx: float, cy: float, r: float, start: float, end: float, sagitta: float) -> list[tuple[float, float]]:
    """Points of an arc (degrees, counter-clockwise) of which no chord strays further than the sagitta."""
    sweep = (end - start) % 360 or 360.0
    step = 2 * math.degrees(math.acos(max(-1.0, 1 - sagitta / r))) if r > sagitta else 90.0
    n = max(2, math.ceil(sweep / max(step, 1e-3)))
    return [(cx + r * math.cos(math.radians(start + sweep * k / n)), cy + r * math.sin(math.radians(start + sweep * k / n))) for k in range(n + 1)]


def bulged(x0: float, y0: float, x1: float, y1: float, bulge: float, sagitta: float) -> list[tuple[float, float]]:
    """The points after the first of a polyline's side that is an arc; bulge is the
    tangent of a quarter of its angle."""
    chord = math.hypot(x1 - x0, y1 - y0)
    if not bulge or not chord:
        return [(x1, y1)]
    angle = 4 * math.atan(bulge)
    r = chord / (2 * math.sin(abs(angle) / 2))
    h = r * math.cos(abs(angle) / 2) * (1 if bulge > 0 else -1)
    cx, cy = (x0 + x1) / 2 - h * (y1 - y0) / chord, (y0 + y1) / 2 + h * (x1 - x0) / chord
    a0 = math.degrees(math.atan2(y0 - cy, x0 - cx))
    turn = math.degrees(angle)
    n = max(2, math.ceil(abs(turn) / max(2 * math.degrees(math.acos(max(-1.0, 1 - sagitta / r))) if r > sagitta else 90.0, 1e-3)))
    out = [(cx + r * math.cos(math.radians(a0 + turn * k / n)), cy + r * math.sin(math.radians(a0 + turn * k / n))) for k in range(1, n)]
    return [*out, (x1, y1)]


def ellipse(cx: float, cy: float, mx: float, my: float, ratio: float, start: float, end: float, sagitta: float, turn: int = 1) -> list[tuple[float, float]]:
    """Points of an elliptic arc from one parameter (radians) to another; turn -1 runs clockwise.
    An ellipse is a circle of its long half axis, narrowed, so that circle's steps keep the chord error."""
    r = max(math.hypot(mx, my), math.hypot(mx, my) * abs(ratio))
    sweep = (end - start) % math.tau or math.tau
    step = 2 * math.acos(max(-1.0, 1 - sagitta / r)) if r > sagitta else math.pi / 2
    n = max(4, math.ceil(sweep / max(step, 1e-5)))
    out = []
    for k in range(n + 1):
        c, s = math.cos(start + sweep * k / n), math.sin(turn * (start + sweep * k / n)) * ratio
        out.append((cx + mx * c - my * s, cy + my * c + mx * s))
    return out


def _flatten(at, a: float, b: float, sagitta: float) -> list[tuple[float, float]]:
    """Points after the first of the curve at(t) for t in a..b, halved until the curve at the quarters
    lies within the sagitta of the chord."""
    out = []
    todo = [(a, b, at(a), at(b), 0)]
    while todo:
        a, b, p, q, level = todo.pop()
        dx, dy = q[0] - p[0], q[1] - p[1]
        long = math.hypot(dx, dy)
        def off(t: float) -> float:
            x, y = at(t)
            u = max(0.0, min(1.0, ((x - p[0]) * dx + (y - p[1]) * dy) / (long * long))) if long else 0.0
            return math.hypot(x - p[0] - u * dx, y - p[1] - u * dy)
        if level < 16 and (level < 2 or max(off(a + (b - a) * k / 4) for k in (1, 2, 3)) > sagitta):
            m = (a + b) / 2
            r = at(m)
            todo += [(m, b, r, q, level + 1), (a, m, p, r, level + 1)]
        else:
            out.append(q)
    return out


def spline(degree: int, knots: list[float], control: list[tuple[float, float]], weights: list[float], fit: list[tuple[float, float]], sagitta: float) -> list[tuple[float, float]]:
    """Points of a B-spline by de Boor's rule, weighted where weights are given. Without control
    points, the natural cubic by chord length through the fit points."""
    if not control:
        return _through(fit, sagitta)
    n = len(control)
    if degree < 1 or n <= degree or len(knots) != n + degree + 1:
        raise ValueError("knots and control points don't match")
    w = weights if len(weights) == n else [1.0] * n
    def at(t: float, k: int) -> tuple[float, float]:
        d = [(control[j][0] * w[j], control[j][1] * w[j], w[j]) for j in range(k - degree, k + 1)]
        for r in range(1, degree + 1):
            for j in range(degree, r - 1, -1):
                lo, hi = knots[j + k - degree], knots[j + 1 + k - r]
                f = (t - lo) / (hi - lo) if hi > lo else 0.0
                d[j] = tuple((1 - f) * x + f * y for x, y in zip(d[j - 1], d[j]))
        return d[degree][0] / d[degree][2], d[degree][1] / d[degree][2]
    out: list[tuple[float, float]] = []
    for k in range(degree, n):
        if knots[k + 1] > knots[k]:
            out = out or [at(knots[k], k)]
            out += _flatten(lambda t, k=k: at(t, k), knots[k], knots[k + 1], sagitta)
    return out


def _through(fit: list[tuple[float, float]], sagitta: float) -> list[tuple[float, float]]:
    p = [q for i, q in enumerate(fit) if not i or q != fit[i - 1]]
    if len(p) < 2:
        raise ValueError("no control or fit points")
    h = [math.dist(a, b) for a, b in zip(p, p[1:])]
    second = [[0.0] * len(p), [0.0] * len(p)]
    for c in (0, 1):  # second derivatives, nought at both ends
        up, rhs = [0.0] * len(p), [0.0] * len(p)
        for i in range(1, len(p) - 1):
            v = 6 * ((p[i + 1][c] - p[i][c]) / h[i] - (p[i][c] - p[i - 1][c]) / h[i - 1])
            m = 2 * (h[i - 1] + h[i]) - h[i - 1] * up[i - 1]
            up[i], rhs[i] = h[i] / m, (v - h[i - 1] * rhs[i - 1]) / m
        for i in range(len(p) - 2, 0, -1):
            second[c][i] = rhs[i] - up[i] * second[c][i + 1]
    out = [p[0]]
    for i, g in enumerate(h):
        def at(t: float, i=i, g=g) -> tuple[float, float]:
            u = g - t
            return tuple((second[c][i] * u**3 + second[c][i + 1] * t**3) / (6 * g) + (p[i][c] / g - second[c][i] * g / 6) * u + (p[i + 1][c] / g - second[c][i + 1] * g / 6) * t for c in (0, 1))
        out += _flatten(at, 0.0, g, sagitta)
    return out


def _points(rec: list[Pair], x: int, y: int) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for c, v in rec:
        if c == x:
            out.append((float(v), 0.0))
        elif c == y and out:
            out[-1] = out[-1][0], float(v)
    return out


def _all(rec: list[Pair], code: int) -> list[float]:
    return [float(v) for c, v in rec if c == code]


def _cut(rec: list[Pair], code: int) -> list[list[Pair]]:
    """The runs that begin with a code; what comes before the first goes."""
    at = [i for i, p in enumerate(rec) if p[0] == code]
    return [rec[i:j] for i, j in zip(at, [*at[1:], len(rec)])]


def _edge(e: list[Pair], sagitta: float) -> list[tuple[float, float]]:
    """The points of one edge of a hatch's boundary."""
    kind, turn = int(_num(e, 72)), 1 if _num(e, 73, 1.0) else -1
    x, y, start, end = _num(e, 10), _num(e, 20), math.radians(_num(e, 50)), math.radians(_num(e, 51, 360.0))
    if kind == 1:
        return [(x, y), (_num(e, 11), _num(e, 21))]
    if kind == 2:
        return ellipse(x, y, _num(e, 40), 0.0, 1.0, start, end, sagitta, turn)
    if kind == 3:  # angles are seen from the middle, parameters are those of the circle
        ratio = _num(e, 40, 1.0)
        def param(a: float) -> float:
            t = math.atan2(math.sin(a) / ratio, math.cos(a))
            return t + math.tau * round((a - t) / math.tau)
        return ellipse(x, y, _num(e, 11), _num(e, 21), ratio, param(start), param(end), sagitta, turn)
    if kind == 4:
        return spline(int(_num(e, 94)), _all(e, 40), _points(e, 10, 20), _all(e, 42), _points(e, 11, 21), sagitta)
    raise ValueError(f"no edge of kind {kind}")


def hatch_rings(rec: list[Pair], sagitta: float) -> list[list[tuple[float, float]]]:
    """The boundary paths of a hatch, each as a closed ring."""
    at = next((i for i, p in enumerate(rec) if p[0] == 91), len(rec))
    end = next((i for i in range(at, len(rec)) if rec[i][0] == 75), len(rec))
    rings = []
    for path in _cut(rec[at:end], 92):
        ring: list[tuple[float, float]] = []
        if int(_num(path, 92)) & 2:
            own: list[list[float]] = []
            for c, v in path:
                if c == 10:
                    own.append([float(v), 0.0, 0.0])
                elif c in (20, 42) and own:
                    own[-1][1 if c == 20 else 2] = float(v)
            ring = [(q[0], q[1]) for q in own[:1]]
            for a, b in zip(own, [*own[1:], *own[:1]]):
                ring += bulged(a[0], a[1], b[0], b[1], a[2], sagitta)
        else:
            for e in _cut(path, 72):
                pts = _edge(e, sagitta)
                if ring and math.dist(ring[-1], pts[-1]) < math.dist(ring[-1], pts[0]):
                    pts.reverse()
                ring += pts[1:] if ring and math.dist(ring[-1], pts[0]) < 1e-9 else pts
        if len(ring) > 1 and math.dist(ring[0], ring[-1]) < 1e-9:
            ring.pop()
        if ring:
            rings.append(ring)
    return rings


class Drawing:
    """The blocks and entities of one file."""

    def __init__(self, lines: Iterable[str]):
        self.scale, self.blocks, self.entities, self.ended = 1.0, {}, [], False
        section, block, last = None, None, None
        for rec in records(pairs(lines)):
            kind = rec[0][1].strip() if rec[0][0] == 0 else ""
            if kind == "SECTION":
                section = _str(rec, 2)
                if section == "HEADER":
                    for (c, v), (_, w) in zip(rec, rec[1:]):
                        if c == 9 and v.strip() == "$INSUNITS":
                            self.scale = UNIT_MM.get(int(float(w)), 1.0)
            elif kind == "ENDSEC":
                section = None
            elif kind == "EOF":
                self.ended = True
            elif section == "BLOCKS" and kind == "BLOCK":
                block = _str(rec, 2, "")
                self.blocks[block] = ((_num(rec, 10), _num(rec, 20)), [])
            elif section == "BLOCKS" and kind == "ENDBLK":
                block = None
            else:
                into = self.entities if section == "ENTITIES" else self.blocks[block][1] if section == "BLOCKS" and block is not None else None
                if into is not None:
                    if kind == "VERTEX" and last is not None:
                        last.append((-1, ""))
                        last.extend(p for p in rec if p[0] in (10, 20, 42))
                    elif kind not in ("SEQEND", "ATTRIB"):
                        into.append(rec)
                        last = rec if kind == "POLYLINE" else None

    def flat(self, rec: list[Pair], m: Matrix, block: str, chain: tuple[str, ...], depth: int, sagitta: float) -> Iterator[dict]:
        """The plain entities of one record, nested blocks expanded to `depth` levels; a
        block inside itself isn't followed. A record that can't be read gives a row of type
        UNREADABLE, one of a kind that isn't known a row of type IGNORED, both without a shape."""
        try:
            if rec[0][1].strip() == "INSERT":
                yield from self.inserted(rec, m, chain, depth, sagitta)
            else:
                yield from list(self.plain(rec, m, block, chain, sagitta))
        except (ValueError, OverflowError, ZeroDivisionError):
            yield {"type": "UNREADABLE", "layer": _str(rec, 8, "0"), "block_name": block, "ancestry": list(chain), "source_entity_type": rec[0][1].strip()}

    def inserted(self, rec: list[Pair], m: Matrix, chain: tuple[str, ...], depth: int, sagitta: float) -> Iterator[dict]:
        """What a block's insert shows, once for each of its rows and columns; a row of type IGNORED
        for one that isn't followed: an unknown block, one inside itself, or one below `depth` levels."""
        name = _str(rec, 2, "")
        if name in self.blocks and name not in chain and len(chain) < depth:
            (bx, by), inner = self.blocks[name]
            sx, sy, turn = _num(rec, 41, 1.0), _num(rec, 42, 1.0), math.radians(_num(rec, 50))
            cos, sin = math.cos(turn), math.sin(turn)
            n_cols, n_rows = max(1, int(_num(rec, 70, 1.0))), max(1, int(_num(rec, 71, 1.0)))
            for row in range(n_rows):
                for col in range(n_cols):
                    dx, dy = col * _num(rec, 44), row * _num(rec, 45)
                    place = Matrix(cos * sx, sin * sx, -sin * sy, cos * sy, _num(rec, 10) + cos * dx - sin * dy, _num(rec, 20) + sin * dx + cos * dy).of(Matrix(e=-bx, f=-by))
                    for r in inner:
                        yield from self.flat(r, m.of(place), name, (*chain, name), depth, sagitta)
        else:
            yield {"type": "IGNORED", "layer": _str(rec, 8, "0"), "block_name": name, "ancestry": list(chain), "source_entity_type": "INSERT"}

    def plain(self, rec: list[Pair], m: Matrix, block: str, chain: tuple[str, ...], sagitta: float) -> Iterator[dict]:
        kind = rec[0][1].strip()
        k = self.scale
        def pt(x: float, y: float, z: float = 0.0) -> dict:
            x, y = m.at(x, y)
            return {"x": x * k, "y": y * k, "z": z * k}
        out = {"type": kind, "layer": _str(rec, 8, "0"), "block_name": block, "ancestry": list(chain), "source_entity_type": kind}
        if kind == "LINE":
            yield out | {"start": pt(_num(rec, 10), _num(rec, 20), _num(rec, 30)), "end": pt(_num(rec, 11), _num(rec, 21), _num(rec, 31))}
        elif kind in ("TEXT", "MTEXT"):
            text = "".join(v for c, v in rec if c == 3) + (_str(rec, 1, "") or "")
            yield out | {"position": pt(_num(rec, 10), _num(rec, 20), _num(rec, 30)), "height": _num(rec, 40) * k, "text": text}
        elif kind in ("LWPOLYLINE", "POLYLINE"):
            own: list[list[float]] = []
            body = rec[rec.index((-1, "")) :] if (-1, "") in rec else rec if kind == "LWPOLYLINE" else []
            for c, v in body:
                if c == 10:
                    own.append([float(v), 0.0, 0.0])
                elif c in (20, 42) and own:
                    own[-1][1 if c == 20 else 2] = float(v)
            closed = bool(int(_num(rec, 70)) & 1)
            path = [(p[0], p[1]) for p in own[:1]]
            for a, b in zip(own, own[1:]):
                path += bulged(a[0], a[1], b[0], b[1], a[2], sagitta)
            if closed and len(own) > 1 and own[-1][2]:
                path += bulged(own[-1][0], own[-1][1], own[0][0], own[0][1], own[-1][2], sagitta)[:-1]
            yield out | {"type": "LWPOLYLINE", "vertices": [pt(*p) for p in path], "closed": closed}
        elif kind in ("ARC", "CIRCLE"):
            path = curve(_num(rec, 10), _num(rec, 20), _num(rec, 40), _num(rec, 50), _num(rec, 51, 360.0) if kind == "ARC" else _num(rec, 50) + 360.0, sagitta)
            yield out | {"type": "LWPOLYLINE", "vertices": [pt(*p) for p in path], "closed": kind == "CIRCLE"}
        elif kind == "ELLIPSE":
            start, end = _num(rec, 41), _num(rec, 42, math.tau)
            path = ellipse(_num(rec, 10), _num(rec, 20), _num(rec, 11), _num(rec, 21), _num(rec, 40, 1.0), start, end, sagitta)
            yield out | {"type": "LWPOLYLINE", "vertices": [pt(*p) for p in path], "closed": abs(end - start - math.tau) < 1e-9}
        elif kind == "SPLINE":
            path = spline(int(_num(rec, 71, 3.0)), _all(rec, 40), _points(rec, 10, 20), _all(rec, 41), _points(rec, 11, 21), sagitta)
            yield out | {"type": "LWPOLYLINE", "vertices": [pt(*p) for p in path], "closed": bool(int(_num(rec, 70)) & 1)}
        elif kind == "HATCH":
            for ring in hatch_rings(rec, sagitta):
                yield out | {"type": "LWPOLYLINE", "vertices": [pt(*p) for p in ring], "closed": True}
        else:
            yield out | {"type": "IGNORED"}


class DxfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path") or options.get("paths", "").strip('[]"')
        self.sagitta, self.depth, self.block = float(options.get("sagitta", 0.05)), int(options.get("depth", 16)), options.get("block")

    def partitions(self) -> list[InputPartition]:
        path = self.path.removeprefix("file://")
        files = sorted(glob.glob(os.path.join(path, "*.dxf")) if os.path.isdir(path) else glob.glob(path))
        return [InputPartition(f) for f in files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, encoding="utf-8", errors="replace") as f:
            d = Drawing(f)
        names = [c.split(" ")[0] for c in SCHEMA.replace(POINT, "point").split(", ")]
        base = {"source_file": os.path.basename(partition.value), "scale_to_mm": d.scale, "is_corrupt": not d.ended}
        roots = d.blocks[self.block][1] if self.block in d.blocks else [] if self.block else d.entities
        n = 0
        point = lambda p: None if p is None else (p["x"], p["y"], p["z"])
        for rec in roots:
            for e in d.flat(rec, Matrix(), self.block or "default", (), self.depth, self.sagitta):
                row = base | e | {"entity_ord": n}
                n += 1
                row["vertices"] = [point(p) for p in e["vertices"]] if "vertices" in e else None
                for k in ("start", "end", "position"):
                    row[k] = point(e.get(k))
                yield tuple(row.get(c) for c in names)


class DxfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dxf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DxfReader:
        return DxfReader(self.options)
