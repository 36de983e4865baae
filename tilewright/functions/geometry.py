"""Planar geometry: measures as columns over ARRAY<DOUBLE> of x,y,x,y,.., and clipping in Python.

Vertices are stored as 32-bit floats in tiles; arithmetic is in doubles.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value stands once in the plan and is computed once a row, however often use has it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def once(measure: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A measure whose path is computed once a row. Filters are pushed down with the path's own expression in the
    measure's place for it, where it would otherwise be computed again for each vertex."""

    @wraps(measure)
    def of(p: Column) -> Column:
        return let(p, measure)

    return of


def n_points(p: Column) -> Column:
    return F.floor(F.size(p) / 2).cast("int")


def _xy(p: Column, i: Column) -> tuple[Column, Column]:
    return F.get(p, i * 2).cast("double"), F.get(p, i * 2 + 1).cast("double")


def _each(p: Column, last: int = 1) -> Column:
    """0 .. n - last, empty if there is none."""
    n = n_points(p)
    return F.when(n >= last, F.sequence(F.lit(0), n - last)).otherwise(F.array().cast("array<int>"))


def bounds(p: Column) -> Column:
    """STRUCT<minx,miny,maxx,maxy>; infinite the other way round for no points, so that nothing is lost by culling."""
    xs, ys = F.filter(p, lambda _, i: i % 2 == 0), F.filter(p, lambda _, i: i % 2 == 1)
    inf = F.lit(float("inf"))
    value = lambda c, other: F.coalesce(c.cast("double"), other)
    return F.struct(
        value(F.array_min(xs), -inf).alias("minx"), value(F.array_min(ys), -inf).alias("miny"),
        value(F.array_max(xs), inf).alias("maxx"), value(F.array_max(ys), inf).alias("maxy"),
    )


@once
def ring_area(p: Column) -> Column:
    """Signed area of the closed ring; positive for rings that run clockwise on a screen (y down)."""
    n = n_points(p)

    def term(i: Column) -> Column:
        (x1, y1), (x2, y2) = _xy(p, i), _xy(p, (i + 1) % n)
        return (x1 - x2) * (y1 + y2)

    return F.aggregate(F.transform(_each(p), term), F.lit(0.0), lambda a, v: a + v) / 2


@once
def segment_lengths(p: Column) -> Column:
    def one(i: Column) -> Column:
        (x1, y1), (x2, y2) = _xy(p, i), _xy(p, i + 1)
        return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))

    return F.transform(_each(p, 2), one)


def line_length(p: Column) -> Column:
    return total(segment_lengths(p))


def cumulative(p: Column) -> Column:
    """Distance along the path at each vertex, each kept as a 32-bit float as it is added up."""
    zero = F.struct(F.lit(0.0).cast("float").alias("at"), F.array(F.lit(0.0).cast("float")).alias("all"))

    def step(a: Column, s: Column) -> Column:
        at = (a["at"].cast("double") + s).cast("float")
        return F.struct(at.alias("at"), F.concat(a["all"], F.array(at)).alias("all"))

    return F.aggregate(segment_lengths(p), zero, step, lambda a: a["all"])


def total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0.0), lambda a, v: a + v)


def distances(lengths: Column) -> Column:
    """Distance along a path at each vertex, from its segments' lengths, in doubles."""
    zero = F.struct(F.lit(0.0).alias("at"), F.array(F.lit(0.0)).alias("all"))
    return F.aggregate(lengths, zero, lambda a, s: F.struct((a["at"] + s).alias("at"), F.concat(a["all"], F.array(a["at"] + s)).alias("all")), lambda a: a["all"])


@once
def midpoint(p: Column) -> Column:
    """STRUCT<x,y> half way along; the first vertex of a path without length."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("done"), F.lit(-1).alias("at"), F.lit(0.0).alias("left"))

    def of(lengths: Column, half: Column) -> Column:
        def step(a: Column, s: Column) -> Column:
            here = (a["at"] < 0) & (s > 0) & (a["done"] + s >= half)
            return F.struct(
                (a["i"] + 1).alias("i"), (a["done"] + s).alias("done"), F.when(here, a["i"]).otherwise(a["at"]).alias("at"),
                F.when(here, (half - a["done"]) / s).otherwise(a["left"]).alias("left"),
            )

        def end(a: Column) -> Column:
            i = F.greatest(a["at"], F.lit(0))
            (x1, y1), (x2, y2) = _xy(p, i), _xy(p, i + 1)
            found = a["at"] >= 0
            return F.struct(F.when(found, x1 + (x2 - x1) * a["left"]).otherwise(x1).alias("x"), F.when(found, y1 + (y2 - y1) * a["left"]).otherwise(y1).alias("y"))

        return F.aggregate(lengths, start, step, end)

    return let(segment_lengths(p), lambda lengths: let(total(lengths) / 2, lambda half: of(lengths, half)))


@once
def centroid(p: Column) -> Column:
    """STRUCT<x,y>: the ring's centre of area; the first vertex if the ring has next to no area."""
    n = n_points(p)
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("a", "x", "y")])

    def step(s: Column, i: Column) -> Column:
        (x1, y1), (x2, y2) = _xy(p, i), _xy(p, (i + 1) % n)
        c = x1 * y2 - x2 * y1
        return F.struct((s["a"] + c).alias("a"), (s["x"] + (x1 + x2) * c).alias("x"), (s["y"] + (y1 + y2) * c).alias("y"))

    x0, y0 = _xy(p, F.lit(0))

    def end(s: Column) -> Column:
        flat = F.abs(s["a"]) < 1e-7
        return F.struct(F.when(flat, x0).otherwise(s["x"] / (s["a"] * 3)).alias("x"), F.when(flat, y0).otherwise(s["y"] / (s["a"] * 3)).alias("y"))

    return F.aggregate(_each(p), zero, step, end)


def segment_at(distances: Column, d: Column) -> Column:
    """Number of the segment that holds distance d: the last vertex not beyond it, but never the last vertex."""
    inner = F.slice(distances, 2, F.greatest(F.size(distances) - 2, F.lit(0)))
    return F.size(F.filter(inner, lambda c: c <= d))


def point_at(p: Column, distances: Column, d: Column) -> Column:
    """STRUCT<x,y,angle> at distance d along a path with these cumulative distances."""

    def on(i: Column) -> Column:
        (x1, y1), (x2, y2) = _xy(p, i), _xy(p, i + 1)
        a, b = F.get(distances, i).cast("double"), F.get(distances, i + 1).cast("double")
        t = F.when(b > a, (d - a) / (b - a)).otherwise(0.0)
        return F.struct((x1 + (x2 - x1) * t).alias("x"), (y1 + (y2 - y1) * t).alias("y"), F.atan2(y2 - y1, x2 - x1).alias("angle"))

    return let(segment_at(distances, d), on)


def anchor_distances(length: Column, spacing: Column) -> Column:
    """Where labels stand along a line: half a spacing from its start, then one each spacing; one in the middle of a
    line shorter than that or with no usable spacing; none on a line under one pixel."""
    none = F.array().cast("array<double>")
    single = spacing.isNull() | F.isnan(spacing) | (spacing <= 0) | (spacing == float("inf")) | (length < spacing)
    last = F.ceil((length - spacing / 2) / spacing).cast("int") - 1
    many = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: spacing / 2 + k * spacing)
    return F.when(length < 1, none).when(single, F.array(length / 2)).otherwise(F.filter(many, lambda v: v < length))


def segment_window(x1: Column, y1: Column, x2: Column, y2: Column, rect: tuple[float, float, float, float]) -> Column:
    """STRUCT<t0,t1>: the part of a segment inside a closed rectangle, null if none (Liang and Barsky)."""
    t0, t1, ok = F.lit(0.0), F.lit(1.0), F.lit(True)
    l, t, r, b = (F.lit(float(v)) for v in rect)
    for d, q in ((x1 - x2, x1 - l), (x2 - x1, r - x1), (y1 - y2, y1 - t), (y2 - y1, b - y1)):
        at = F.when(d != 0, q / d)
        t0 = F.when(d < 0, F.greatest(t0, at)).otherwise(t0)
        t1 = F.when(d > 0, F.least(t1, at)).otherwise(t1)
        ok = ok & ~((d == 0) & (q < 0))
    return F.when(ok & (t0 <= t1), F.struct(t0.alias("t0"), t1.alias("t1")))


def rotated_size(w: Column, h: Column, angle: Column) -> tuple[Column, Column]:
    """Sides of the upright box around a box turned by angle."""
    c, s = F.abs(F.cos(angle)), F.abs(F.sin(angle))
    return w * c + h * s, w * s + h * c


#: Each anchor's place of the box's corner: shares of width and height to the left of and above the point.
ANCHORS = {
    "center": (0.5, 0.5), "left": (0.0, 0.5), "right": (1.0, 0.5), "top": (0.5, 0.0), "bottom": (0.5, 1.0),
    "top-left": (0.0, 0.0), "top-right": (1.0, 0.0), "bottom-left": (0.0, 1.0), "bottom-right": (1.0, 1.0),
}


def radial_shift(anchor: str, radius: float) -> tuple[float, float]:
    """A label moved radius away from its point, to the side that its anchor faces."""
    fx, fy = ANCHORS.get(anchor, (0.5, 0.5))
    sx, sy = 1 - 2 * fx, 1 - 2 * fy
    k = math.sqrt(0.5) if sx and sy else 1.0
    return sx * radius * k, sy * radius * k


def fold_angle(a: float) -> float:
    """Into (-pi, pi]."""
    a = math.fmod(a, 2 * math.pi)
    return a - 2 * math.pi if a > math.pi else a + 2 * math.pi if a <= -math.pi else a


def upright(angle: Column) -> Column:
    """The angle turned by half a circle where text would stand on its head."""
    pi = math.pi
    folded = F.pmod(angle + pi, F.lit(2 * pi)) - pi
    return F.when((folded > pi / 2) | (folded <= -pi / 2), F.pmod(folded + 2 * pi, F.lit(2 * pi)) - pi).otherwise(folded)


# -- clipping ---------------------------------------------------------------------------------------------------


def _window(ax: float, ay: float, bx: float, by: float, rect: tuple[float, float, float, float]) -> tuple[float, float] | None:
    lo, hi = 0.0, 1.0
    for d, room in ((ax - bx, ax - rect[0]), (bx - ax, rect[2] - ax), (ay - by, ay - rect[1]), (by - ay, rect[3] - ay)):
        if d == 0:
            if room < 0:
                return None
        elif d < 0:
            lo = max(lo, room / d)
        else:
            hi = min(hi, room / d)
    return (lo, hi) if lo <= hi else None


def clip_line(points: list[float], rect: tuple[float, float, float, float], close: bool = False) -> list[tuple[list[float], float, bool]]:
    """The runs of a polyline inside a rectangle: (points, distance along the whole line where the run starts,
    whether it is a whole closed ring).

    With close the last vertex joins the first, and a run over that seam is one run: its start
    distance is that of its first part less the ring's length, so it is below 0 there.
    """
    xy = list(zip(points[::2], points[1::2]))
    if len(xy) < 2:
        return []
    if close and xy[0] != xy[-1]:
        xy.append(xy[0])
    runs: list[tuple[list[float], float, bool]] = []
    now: list[float] | None = None
    started, travelled = 0.0, 0.0
    whole = True
    for (ax, ay), (bx, by) in zip(xy, xy[1:]):
        length = math.hypot(bx - ax, by - ay)
        w = _window(ax, ay, bx, by, rect)
        if w is None or (w[0] == w[1] and length > 0):
            whole = False
            if now is not None:
                runs.append((now, started, False))
                now = None
        else:
            s, e = w
            if now is None or s > 0:
                if now is not None:
                    runs.append((now, started, False))
                now, started = [ax + (bx - ax) * s, ay + (by - ay) * s], travelled + length * s
            now += [bx, by] if e == 1 else [ax + (bx - ax) * e, ay + (by - ay) * e]
            whole &= s == 0 and e == 1
            if e < 1:
                runs.append((now, started, False))
                now = None
        travelled += length
    if now is not None:
        runs.append((now, started, False))
    if close and whole and runs:
        return [(points, 0.0, True)]
    if close and len(runs) > 1 and runs[0][1] == 0 and tuple(runs[0][0][:2]) == xy[0] and tuple(runs[-1][0][-2:]) == xy[0]:
        tail, start, _ = runs.pop()
        head = runs.pop(0)
        runs.insert(0, (tail + head[0][2:], start - travelled, False))
    return [r for r in runs if len(r[0]) >= 4]


def clip_ring(points: list[float], rect: tuple[float, float, float, float]) -> list[float] | None:
    """The part of a ring inside a rectangle, in the same winding; None if under three vertices are left."""
    ring = list(zip(points[::2], points[1::2]))
    for axis, bound, keep in ((0, rect[0], 1), (0, rect[2], -1), (1, rect[1], 1), (1, rect[3], -1)):
        out: list[tuple[float, float]] = []
        for a, b in zip(ring[-1:] + ring[:-1], ring):
            in_a, in_b = keep * (a[axis] - bound) >= 0, keep * (b[axis] - bound) >= 0
            if in_a != in_b:
                t = (bound - a[axis]) / (b[axis] - a[axis])
                cross = (bound, a[1] + (b[1] - a[1]) * t) if axis == 0 else (a[0] + (b[0] - a[0]) * t, bound)
                out.append(cross)
            if in_b:
                out.append(b)
        ring = out
        if len(ring) < 3:
            return None
    return [v for p in ring for v in p]
