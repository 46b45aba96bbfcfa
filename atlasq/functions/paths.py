"""Paths measured along their length: positions, angles and pieces at distances, as column expressions.

measured() gives each path of a geometry as {x, y, at}: its points without repeats, and the length run
through at each. What follows works on such structs in the JVM, by binary search in `at`.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import batches as B
from . import codecs as C

_LIST = pa.list_(pa.float64())
PATH = T.StructType([T.StructField(n, T.ArrayType(T.DoubleType(), False), False) for n in ("x", "y", "at")])
#: Halvings that find a place among as many points as an array holds.
_HALVINGS = 31


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.float64()))


@F.arrow_udf(T.ArrayType(PATH, False))
def measured(geom: pa.Array) -> pa.Array:
    """The paths of a geometry (a polygon's rings are paths); null for null and for what can't be read."""
    b = B.Batch(geom)
    xy, count, row = [b.xy], [b.count], [b.path_row]
    known = b.kind > 0
    for r in b.rest.tolist():
        g = B.readable(C.from_wkb, geom[r].as_py())
        if g is not None:
            known[r] = True
            own = [a for a in g.arrays if len(a)]
            xy += own
            count.append(np.array([len(a) for a in own], np.int64))
            row.append(np.full(len(own), r, np.int64))
    points, size, of = np.concatenate(xy) if xy else np.zeros((0, 2)), np.concatenate(count), np.concatenate(row)
    first = np.zeros(len(points), bool)
    starts = np.cumsum(size) - size
    first[starts[size > 0]] = True
    path = np.repeat(np.arange(len(size)), size)
    step = np.zeros(len(points))
    if len(points) > 1:
        step[1:] = np.hypot(*np.diff(points, axis=0).T)
    step[first] = 0
    keep = first | (step > 0)
    points, path, step, first = points[keep], path[keep], step[keep], first[keep]
    run = np.cumsum(step)
    at = run - np.repeat(run[first], np.bincount(path, minlength=len(size))[np.unique(path)] if len(path) else 0)
    # paths in the order of rows; a path keeps its place within its row
    kept = np.bincount(path, minlength=len(size))
    order = np.argsort(of, kind="stable")
    order = order[kept[order] > 0]
    begin = np.cumsum(kept) - kept
    take = B.ragged(begin[order], kept[order])
    inner = np.append(0, np.cumsum(kept[order]))
    structs = pa.StructArray.from_arrays([_lists(v[take], inner) for v in (points[:, 0], points[:, 1], at)], fields=[pa.field(n, _LIST, False) for n in ("x", "y", "at")])
    outer = np.append(0, np.cumsum(np.bincount(of[order], minlength=b.n)))
    return pa.ListArray.from_arrays(pa.array(outer, pa.int32()), structs, mask=pa.array(~known))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def length(p: Column) -> Column:
    return F.element_at(p["at"], -1)


def segment(p: Column, d: Column) -> Column:
    """The segment (from 0) in which a distance along the path ends; null before the start and from the end on."""
    n = F.size(p["at"])

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
        below = F.get(p["at"], mid) <= d
        done = s["high"] - s["low"] <= 1
        return F.struct(F.when(~done & below, mid).otherwise(s["low"]).alias("low"), F.when(done | below, s["high"]).otherwise(mid).alias("high"))

    steps = F.sequence(F.lit(1), F.least(F.lit(_HALVINGS), F.ceil(F.log2(n.cast("double"))).cast("int") + 1))
    found = F.aggregate(steps, F.struct(F.lit(0).alias("low"), (n - 1).alias("high")), halve, lambda s: s["low"])
    return F.when((n > 1) & (d >= 0) & (d < length(p)), found)


def _at(p: Column, i: Column, d: Column) -> Column:
    """The point at a distance that ends in segment i."""
    share = (d - F.get(p["at"], i)) / (F.get(p["at"], i + 1) - F.get(p["at"], i))
    one = lambda c: F.get(p[c], i) + (F.get(p[c], i + 1) - F.get(p[c], i)) * share
    return F.struct(one("x").alias("x"), one("y").alias("y"))


def position(p: Column, d: Column) -> Column:
    """{x, y} at a distance along the path; null outside it."""
    return _let(segment(p, d), lambda i: F.when(i.isNotNull(), _at(p, i, d)))


def _direction(p: Column, i: Column) -> Column:
    return F.atan2(F.get(p["y"], i + 1) - F.get(p["y"], i), F.get(p["x"], i + 1) - F.get(p["x"], i))


def angle(p: Column, d: Column, width: Column | float = 0.0) -> Column:
    """The direction of the way from a distance to width farther along (or back, if negative).

    Within one segment it is the segment's, turned around for a way back; so it is where the way would leave the path.
    """
    w = F.lit(float(width)) if isinstance(width, (int, float)) else width
    turn = F.when(w >= 0, F.lit(0.0)).otherwise(F.lit(math.pi))

    def from_segment(i: Column) -> Column:
        inside = (d + w >= F.get(p["at"], i)) & (d + w <= F.get(p["at"], i + 1))
        way = _let(position(p, d + w), lambda q: F.when(q.isNotNull(), _let(_at(p, i, d), lambda o: F.atan2(q["y"] - o["y"], q["x"] - o["x"]))))
        return F.when(inside, _direction(p, i) + turn).otherwise(F.coalesce(way, _direction(p, i) + turn))

    return _let(segment(p, d), lambda i: F.when(i.isNotNull(), from_segment(i)))


def closest(p: Column, x: Column, y: Column) -> Column:
    """The distance along the path at which it comes nearest to a point; the first of several."""

    def of(i: Column) -> Column:
        ax, ay = F.get(p["x"], i), F.get(p["y"], i)
        dx, dy = F.get(p["x"], i + 1) - ax, F.get(p["y"], i + 1) - ay
        t = F.least(F.greatest(((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy), F.lit(0.0)), F.lit(1.0))
        return _let(t, lambda t: F.struct((F.pow(x - ax - dx * t, 2) + F.pow(y - ay - dy * t, 2)).alias("d"), (F.get(p["at"], i) + (F.get(p["at"], i + 1) - F.get(p["at"], i)) * t).alias("at")))

    n = F.size(p["at"])
    return F.when(n > 1, F.array_min(F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), of))["at"]).when(n == 1, F.lit(0.0))


def to_distance(p: Column, d: Column, r: Column) -> Column:
    """The distance along the path of the first later point that is r away, in a straight line, from the one at d; null if there is none."""
    n = F.size(p["at"])

    def from_segment(i: Column) -> Column:
        def away(c: Column) -> Column:
            later = F.filter(F.sequence(F.lit(1), n - 1), lambda j: (j > i + 1) & (F.hypot(F.get(p["x"], j) - c["x"], F.get(p["y"], j) - c["y"]) >= r))

            def cut(j: Column) -> Column:
                ax, ay = F.get(p["x"], j - 1), F.get(p["y"], j - 1)
                dx, dy = F.get(p["x"], j) - ax, F.get(p["y"], j) - ay
                a, b, e = dx * dx + dy * dy, 2 * (dx * (ax - c["x"]) + dy * (ay - c["y"])), F.pow(ax - c["x"], 2) + F.pow(ay - c["y"], 2) - r * r
                t = (-b + F.sqrt(F.greatest(b * b - 4 * a * e, F.lit(0.0)))) / (2 * a)
                return F.get(p["at"], j - 1) + t * F.sqrt(a)

            return _let(F.get(later, F.lit(0)), lambda j: F.when(j.isNotNull(), cut(j)))

        return F.when(d + r < F.get(p["at"], i + 1), d + r).otherwise(_let(_at(p, i, d), away))

    return F.when(n > 1, _let(segment(p, d), lambda i: F.when(i.isNotNull(), from_segment(i))))


def beside(p: Column, q: Column, d: Column, region: Column | float = 0.0) -> Column:
    """The distance along a parallel path q that goes with distance d along p, so that a region of this width is centred alike on both."""
    half = (F.lit(float(region)) if isinstance(region, (int, float)) else region) / 2
    return F.least(F.greatest((d + half) * length(q) / length(p) - half, F.lit(0.0)), length(q))


def piece(p: Column, start: Column, end: Column) -> Column:
    """{x, y} arrays of the points of the path from one distance to another, within it."""
    last = length(p)

    def point(d: Column) -> Column:
        inner = position(p, d)
        tail = F.struct(F.element_at(p["x"], -1).alias("x"), F.element_at(p["y"], -1).alias("y"))
        return F.when(d >= last, tail).otherwise(inner)

    inner = F.filter(F.sequence(F.lit(0), F.size(p["at"]) - 1), lambda i: (F.get(p["at"], i) > start) & (F.get(p["at"], i) < end))
    middle = F.transform(inner, lambda i: F.struct(F.get(p["x"], i).alias("x"), F.get(p["y"], i).alias("y")))
    whole = F.concat(F.array(point(start)), middle, F.array(point(end)))
    return _let(whole, lambda w: F.struct(F.transform(w, lambda v: v["x"]).alias("x"), F.transform(w, lambda v: v["y"]).alias("y")))


def dashes(p: Column, pattern: tuple[float, ...], begin: float = 0.0) -> Column:
    """The dashes of a path as {start, end, x, y}: pattern gives dash, gap, dash, gap, ... (an odd one is taken twice), and begin how far into it the path starts.

    A pattern without length, or a path without one, gives none.
    """
    own = tuple(float(v) for v in (pattern if len(pattern) % 2 == 0 else pattern * 2))
    total = sum(own)
    if total <= 0 or any(v < 0 for v in own):
        return F.array().cast("array<struct<start:double,end:double,x:array<double>,y:array<double>>>")
    edges = np.cumsum((0.0, *own))
    marks = F.array(*(F.struct(F.lit(float(edges[k])).alias("a"), F.lit(float(edges[k + 1])).alias("b")) for k in range(0, len(own), 2)))
    rounds = F.sequence(F.lit(0), F.floor((length(p) + begin % total) / total).cast("int"))
    each = F.flatten(F.transform(rounds, lambda k: F.transform(marks, lambda m: F.struct(F.greatest(m["a"] + k * total - begin % total, F.lit(0.0)).alias("start"), F.least(m["b"] + k * total - begin % total, length(p)).alias("end")))))
    kept = F.filter(each, lambda m: m["start"] < m["end"])
    return F.transform(kept, lambda m: _let(piece(p, m["start"], m["end"]), lambda w: F.struct(m["start"].alias("start"), m["end"].alias("end"), w["x"].alias("x"), w["y"].alias("y"))))


@F.arrow_udf(T.BinaryType())
def line_wkb(x: pa.Array, y: pa.Array) -> pa.Array:
    """Lines of coordinate arrays as WKB."""
    out = []
    for k in range(len(x)):
        own, other = x[k].values, y[k].values
        out.append(None if own is None or other is None else C.to_wkb(C.Geometry("LineString", np.stack([np.asarray(own), np.asarray(other)], 1))))
    return pa.array(out, pa.binary())


def sharpest_turn(p: Column, start: Column, end: Column) -> Column:
    """The largest change of direction at a point of the path between two distances, in radians."""

    def turn(i: Column) -> Column:
        d = F.abs(_direction(p, i) - _direction(p, i - 1))
        return F.when(d > math.pi, 2 * math.pi - d).otherwise(d)

    inner = F.filter(F.sequence(F.lit(0), F.size(p["at"]) - 1), lambda i: (i > 0) & (i < F.size(p["at"]) - 1) & (F.get(p["at"], i) > start) & (F.get(p["at"], i) < end))
    return F.coalesce(F.array_max(F.transform(inner, turn)), F.lit(0.0))
