"""Geometry as columns: codecs and functions over WKB, and expressions over points and point arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import batches as B
from . import codecs as C
from . import shapes as S

ENVELOPE = "minx double, miny double, maxx double, maxy double"
XY = "x double, y double"


_TYPES = {"binary": T.BinaryType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "int": T.IntegerType()}


def _struct(fields: str) -> T.StructType:
    """A struct type from "name type, ..." without a session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (x.split() for x in fields.split(","))])


def _scalar(kind: str, f):
    """A pandas UDF by rows, null for null and where f gives none."""

    def safe(*args):
        return None if any(a is None or a is pd.NA for a in args) else f(*args)

    if kind.count(" ") == 0:

        @F.pandas_udf(_TYPES[kind])
        def run(*cols: pd.Series) -> pd.Series:
            return pd.Series([safe(*row) for row in zip(*cols)], dtype=object)

        return run
    names = _struct(kind).names

    @F.pandas_udf(_struct(kind))
    def rows(*cols: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([safe(*row) or (None,) * len(names) for row in zip(*cols)], columns=names, dtype=object)

    return rows


def _wkb(f):
    """f of a WKB column's geometries; those that can't be read are null."""

    def run(raw, *a):
        g = B.readable(C.from_wkb, bytes(raw))
        return None if g is None else f(g, *a)

    return run


def _read(decode):
    """WKB of what decode reads; null where it can't."""

    def run(x):
        g = B.readable(decode, bytes(x) if isinstance(x, (bytes, bytearray)) else x)
        return None if g is None else C.to_wkb(g)

    return run


_ARROW = {"double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def _batch(kind: str, together, alone):
    """An Arrow UDF over whole batches: together(batch) gives arrays for the rows that are decoded together, alone(geometry) the others' values.

    A column named as a struct's fields is null where the fields are not-a-number.
    """
    fields = [x.split() for x in kind.split(",")] if " " in kind else None

    @F.arrow_udf(_struct(kind) if fields else _TYPES[kind])
    def run(geom: pa.Array) -> pa.Array:
        b = B.Batch(geom)
        told, more = together(b), b.row_function(alone)
        known = b.kind > 0
        known[list(more)] = True
        if not fields:
            values = told if isinstance(told, list) else told.tolist()
            for i, v in more.items():
                values[i] = v
            return pa.array([v if k else None for v, k in zip(values, known.tolist())], _ARROW[kind])
        columns = [told[n] for n, _ in fields]
        missing = ~known | np.isnan(columns[0])
        for i, v in more.items():
            missing[i] = v is None
            for c, x in zip(columns, v or ()):
                c[i] = x
        return pa.StructArray.from_arrays([pa.array(c, _ARROW[t], mask=missing) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])

    return run


_wkt = _read(C.from_wkt)


@F.arrow_udf(T.BinaryType())
def from_wkt(text: pa.Array) -> pa.Array:
    """WKB of texts, whole batches of usual spellings at once; null for what can't be read."""
    return B.from_wkt(text, lambda t: C.plain_wkt(t) or _wkt(t))


from_geojson = _scalar("binary", _read(C.from_geojson))
from_twkb = _scalar("binary", _read(C.from_twkb))
_wkt_of, _json_of = _wkb(C.to_wkt), _wkb(C.to_geojson)
to_wkt = _scalar("string", lambda raw: C.point_text(raw, "POINT({} {})") or _wkt_of(raw))
to_geojson = _scalar("string", lambda raw: C.point_text(raw, '{{"type":"Point","coordinates":[{},{}]}}', C.plain_number) or _json_of(raw))
to_svg_path = _scalar("string", _wkb(C.to_svg_path))
normalized_wkb = _scalar("binary", _wkb(C.to_wkb))
big_endian_wkb = _scalar("binary", _wkb(lambda g: C.to_wkb(g, ">")))
envelope = _batch(ENVELOPE, B.envelope, S.envelope)
centroid = _batch(XY, B.centroid, S.centroid)
interior = _scalar(XY, _wkb(S.interior))
polylabel = _scalar(XY, _wkb(S.polylabel))
middle_point = _scalar(XY, _wkb(S.middle_point))
area = _batch("double", B.area, S.area)
path_length = _batch("double", B.path_length, S.path_length)
closest_point = _scalar("x double, y double, distance double", _wkb(S.closest_point))
is_valid = _batch("boolean", lambda b: [r is None for r in B.invalid_reason(b)], lambda g: S.invalid_reason(g) is None)
invalid_reason = _batch("string", B.invalid_reason, S.invalid_reason)
is_simple = _batch("boolean", B.is_simple, S.is_simple)
is_empty = _batch("boolean", lambda b: b.empty, lambda g: g.empty)
without_empty = _scalar("binary", _wkb(lambda g: C.to_wkb(S.without_empty(g))))
correct = _scalar("binary", _wkb(lambda g: C.to_wkb(S.corrected(g))))
simplify = _scalar("binary", _wkb(lambda g, how, tol: C.to_wkb(S.simplified(g, how, tol))))
smooth = _scalar("binary", _wkb(lambda g, amount: C.to_wkb(g.mapped(lambda a: S.smoothed(a, amount)))))
offset = _scalar("binary", _wkb(lambda g, by: C.to_wkb(g.mapped(lambda a: S.offset_line(a, by)))))
_outline = _wkb(lambda g, width, join, cap, limit: C.to_wkb(S.outline(g, width, join, cap, limit)))
extend = _scalar("binary", _wkb(lambda g, by: C.to_wkb(g.mapped(lambda a: S.extended(a, by)))))
clip = _scalar("binary", _wkb(lambda g, x0, y0, x1, y1: C.to_wkb(S.clipped(g, (x0, y0, x1, y1)))))


@F.arrow_udf(T.BinaryType())
def affine(geom: pa.Array, a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array, e: pa.Array, f: pa.Array) -> pa.Array:
    """x, y to a x + c y + e, b x + d y + f, for all points of a batch at once; null where a number is."""
    batch = B.Batch(geom)
    m = np.stack([np.asarray(v.cast(pa.float64()).fill_null(np.nan)) for v in (a, b, c, d, e, f)])
    own = m[:, batch.point_row]
    with np.errstate(invalid="ignore"):
        xy = np.stack([own[0] * batch.xy[:, 0] + own[2] * batch.xy[:, 1] + own[4], own[1] * batch.xy[:, 0] + own[3] * batch.xy[:, 1] + own[5]], 1)
    numbers = [v.tolist() for v in m.T]
    more = batch.row_function(lambda g, n: C.to_wkb(S.converted(g, transform=tuple(n))), numbers)
    out = B.moved(batch, xy, lambda g: b"")
    bad = np.isnan(m).any(0)
    if not more and not bad.any():
        return out
    return pa.array([None if bad[i] else more.get(i) if i in more else v for i, v in enumerate(out.to_pylist())], pa.binary())


@F.arrow_udf(T.BinaryType())
def outline(geom: pa.Array, width: pa.Array, join: pa.Array, cap: pa.Array, limit: pa.Array) -> pa.Array:
    """The strokes of a geometry's lines and rings as polygons, open lines of a batch at once; null where anything is."""
    batch = B.Batch(geom)
    joins, caps = join.to_pylist(), cap.to_pylist()
    w, most = (np.asarray(v.cast(pa.float64()).fill_null(np.nan)) for v in (width, limit))
    rows, told = B.outline(batch, w, joins, caps, most)
    left = np.asarray(geom.is_valid())
    left[rows] = False
    given = [np.asarray(v.is_valid()) for v in (width, join, cap, limit)]
    more = {i: _outline(geom[i].as_py(), float(w[i]), joins[i], caps[i], float(most[i])) for i in np.flatnonzero(left & np.all(given, axis=0)).tolist()}
    return B.merged(batch.n, rows, told, more)


hit = _scalar("boolean", _wkb(S.hit))
point_at_length = _scalar("x double, y double, angle double", _wkb(lambda g, d: S.at_length(g.arrays[0], d)))
grid_points = _scalar("binary", _wkb(lambda g, dx, dy, alternating: C.to_wkb(C.Geometry("MultiPoint", S.grid_points(g, dx, dy, alternating)))))


@F.pandas_udf(T.ArrayType(_struct("x double, y double, angle double")))
def marker_positions(geom: pd.Series, placement: pd.Series, spacing: pd.Series) -> pd.Series:
    return pd.Series([[{"x": x, "y": y, "angle": a} for x, y, a in S.marker_positions(C.from_wkb(bytes(g)), p, s)] if g is not None else None for g, p, s in zip(geom, placement, spacing)])


@F.pandas_udf(T.ArrayType(_struct("path int, pos int, x double, y double, cmd int")))
def vertices(geom: pd.Series) -> pd.Series:
    """The command stream: 1 moves, 2 draws a line, 95 closes a ring."""

    def stream(raw) -> list | None:
        if raw is None:
            return None
        out = []
        for k, s in enumerate(C.from_wkb(bytes(raw)).singles()):
            for a in s.parts if s.kind == "Polygon" else [s.parts]:
                closed = s.kind == "Polygon" and len(a) > 1
                for i, (x, y) in enumerate(a.tolist()):
                    cmd = 1 if i == 0 else 95 if closed and i == len(a) - 1 else 2
                    out.append({"path": k, "pos": len(out), "x": x, "y": y, "cmd": cmd})
        return out

    return pd.Series([stream(g) for g in geom])


def reproject(source: str, target: str):
    """A UDF of WKB between two planes: the built-in pair for all points of a batch at once, others point by point."""
    from .projection import LONLAT, MAX_LATITUDE, MERCATOR, RADIUS, known, project_point

    one, other = known(source), known(target)

    def together(xy: np.ndarray) -> np.ndarray:
        if one == other:
            return xy
        if (one, other) == (LONLAT, MERCATOR):
            lon, lat = np.clip(xy[:, 0], -180.0, 180.0), np.clip(xy[:, 1], -MAX_LATITUDE, MAX_LATITUDE)
            return np.stack([np.radians(lon) * RADIUS, np.log(np.tan(np.radians(lat + 90) / 2)) * RADIUS], 1)
        if (one, other) == (MERCATOR, LONLAT):
            x, y = (np.clip(xy[:, k] / RADIUS, -np.pi, np.pi) for k in (0, 1))
            return np.stack([np.degrees(x), np.degrees(2 * np.arctan(np.exp(y)) - np.pi / 2)], 1)
        return np.array([project_point(x, y, source, target) for x, y in xy.tolist()]).reshape(-1, 2)

    @F.arrow_udf(T.BinaryType())
    def run(geom: pa.Array) -> pa.Array:
        batch = B.Batch(geom)
        return B.moved(batch, together(batch.xy), lambda g: C.to_wkb(g.mapped(lambda a: C.points(together(np.asarray(a, float).reshape(-1, 2)).tolist()))))

    return run


# --- expressions ---------------------------------------------------------------


def point_wkt(x: Column, y: Column) -> Column:
    return F.concat(F.lit("POINT("), x.cast("string"), F.lit(" "), y.cast("string"), F.lit(")"))


def line_wkt(pts: Column) -> Column:
    """WKT of an array of points {x, y}."""
    return F.concat(F.lit("LINESTRING("), F.array_join(F.transform(pts, lambda p: F.concat(p["x"].cast("string"), F.lit(" "), p["y"].cast("string"))), ","), F.lit(")"))


def points_envelope(pts: Column) -> Column:
    at = lambda c: F.transform(pts, lambda p: p[c])
    return F.struct(F.array_min(at("x")).alias("minx"), F.array_min(at("y")).alias("miny"), F.array_max(at("x")).alias("maxx"), F.array_max(at("y")).alias("maxy"))


def _pairs(pts: Column) -> Column:
    """Neighbouring points {a, b}."""
    return F.zip_with(F.slice(pts, 1, F.greatest(F.size(pts) - 1, F.lit(0))), F.slice(pts, 2, F.greatest(F.size(pts) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def points_length(pts: Column) -> Column:
    return F.aggregate(_pairs(pts), F.lit(0.0), lambda s, p: s + F.sqrt(F.pow(p["b"]["x"] - p["a"]["x"], 2) + F.pow(p["b"]["y"] - p["a"]["y"], 2)))


def ring_area(pts: Column) -> Column:
    """Signed area of a closed ring, positive counter-clockwise."""
    return F.aggregate(_pairs(pts), F.lit(0.0), lambda s, p: s + (p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"])) / 2


def ring_clockwise(pts: Column) -> Column:
    return ring_area(pts) < 0


def ring_centroid(pts: Column) -> Column:
    cross = lambda p: p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"]
    cx = F.aggregate(_pairs(pts), F.lit(0.0), lambda s, p: s + (p["a"]["x"] + p["b"]["x"]) * cross(p))
    cy = F.aggregate(_pairs(pts), F.lit(0.0), lambda s, p: s + (p["a"]["y"] + p["b"]["y"]) * cross(p))
    area = ring_area(pts) * 6
    return F.struct(F.try_divide(cx, area).alias("x"), F.try_divide(cy, area).alias("y"))


def ring_contains(pts: Column, x: Column, y: Column) -> Column:
    """Whether a closed ring holds a point, by crossings."""
    crossing = lambda p: (((p["a"]["y"] <= y) & (y < p["b"]["y"])) | ((p["b"]["y"] <= y) & (y < p["a"]["y"]))) & (x < F.try_divide((p["b"]["x"] - p["a"]["x"]) * (y - p["a"]["y"]), p["b"]["y"] - p["a"]["y"]) + p["a"]["x"])
    return F.size(F.filter(_pairs(pts), crossing)) % 2 == 1


def segment_distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = F.when(n == 0, F.lit(0.0)).otherwise(F.least(F.greatest(F.try_divide((x - ax) * dx + (y - ay) * dy, n), F.lit(0.0)), F.lit(1.0)))
    return F.sqrt(F.pow(x - ax - t * dx, 2) + F.pow(y - ay - t * dy, 2))


def line_distance(pts: Column, x: Column, y: Column) -> Column:
    return F.array_min(F.transform(_pairs(pts), lambda p: segment_distance(x, y, p["a"]["x"], p["a"]["y"], p["b"]["x"], p["b"]["y"])))


def moved_points(pts: Column, m: tuple[Column, ...]) -> Column:
    """Points after (sx, shy, shx, sy, tx, ty)."""
    return F.transform(pts, lambda p: F.struct((p["x"] * m[0] + p["y"] * m[2] + m[4]).alias("x"), (p["x"] * m[1] + p["y"] * m[3] + m[5]).alias("y")))


def projected_points(pts: Column, source: str, target: str) -> Column:
    from .projection import project

    def one(p: Column) -> Column:
        x, y = project(p["x"], p["y"], source, target)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(pts, one)


def simple_kind(kind: Column) -> Column:
    """0 to 4 from a WKB kind: multi kinds count as their single ones."""
    return F.when(kind.isin(1, 4), 1).when(kind.isin(2, 5), 2).when(kind.isin(3, 6), 3).when(kind == 7, 4).otherwise(0)


def wkb_kind(geom: Column) -> Column:
    """The kind number of WKB in either byte order, without Python."""
    h = F.hex(F.substring(geom, 1, 5))
    little = F.concat(*[F.substring(h, i, 2) for i in (9, 7, 5, 3)])
    code = F.conv(F.when(F.substring(h, 1, 2) == "01", little).otherwise(F.substring(h, 3, 8)), 16, 10).cast("long")
    return (code.bitwiseAND(0x0FFFFFFF) % 1000).cast("int")
