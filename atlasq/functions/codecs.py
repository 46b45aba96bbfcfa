"""Geometry codecs: WKB, TWKB, WKT, GeoJSON, SVG paths. Two dimensions; further ordinates are read and dropped."""

from __future__ import annotations

import json
import re
import struct
from dataclasses import dataclass
from typing import Any

import numpy as np

#: What decoders raise for what they can't read.
UNREADABLE = (ValueError, KeyError, IndexError, TypeError, OverflowError, struct.error)
KINDS = ("Unknown", "Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection")


@dataclass(frozen=True)
class Geometry:
    """kind is a name of KINDS; parts holds an array of points (Point, LineString, MultiPoint), a list of arrays
    (Polygon: rings; MultiLineString), a list of lists of rings (MultiPolygon) or a list of geometries."""

    kind: str
    parts: Any

    @property
    def simple_kind(self) -> int:
        """0 unknown, 1 point, 2 line string, 3 polygon, 4 collection; a multi kind counts as its single one."""
        return {"Point": 1, "MultiPoint": 1, "LineString": 2, "MultiLineString": 2, "Polygon": 3, "MultiPolygon": 3, "GeometryCollection": 4}.get(self.kind, 0)

    @property
    def arrays(self) -> list[np.ndarray]:
        """All point arrays, in order."""
        if self.kind in ("Point", "LineString", "MultiPoint"):
            return [self.parts]
        if self.kind in ("Polygon", "MultiLineString"):
            return list(self.parts)
        if self.kind == "MultiPolygon":
            return [r for p in self.parts for r in p]
        return [a for g in self.parts for a in g.arrays]

    @property
    def empty(self) -> bool:
        return not any(len(a) for a in self.arrays)

    def singles(self) -> list[Geometry]:
        """Single geometries that this one is made of."""
        if self.kind == "MultiPoint":
            return [Geometry("Point", p[None, :]) for p in self.parts]
        if self.kind == "MultiLineString":
            return [Geometry("LineString", p) for p in self.parts]
        if self.kind == "MultiPolygon":
            return [Geometry("Polygon", p) for p in self.parts]
        if self.kind == "GeometryCollection":
            return [s for g in self.parts for s in g.singles()]
        return [self]

    def mapped(self, f) -> Geometry:
        """The same shape with f applied to each array of points."""
        if self.kind in ("Point", "LineString", "MultiPoint"):
            return Geometry(self.kind, f(self.parts))
        if self.kind in ("Polygon", "MultiLineString"):
            return Geometry(self.kind, [f(a) for a in self.parts])
        if self.kind == "MultiPolygon":
            return Geometry(self.kind, [[f(a) for a in p] for p in self.parts])
        return Geometry(self.kind, [g.mapped(f) for g in self.parts])


def points(xy: Any) -> np.ndarray:
    a = np.asarray(xy, np.float64)
    return a.reshape(-1, 2) if a.size else np.zeros((0, 2))


class _Reader:
    def __init__(self, raw: bytes) -> None:
        self.raw, self.at = raw, 0

    def number(self, form: str) -> Any:
        x = struct.unpack_from(form, self.raw, self.at)[0]
        self.at += struct.calcsize(form)
        return x

    def array(self, order: str, n: int, width: int) -> np.ndarray:
        if n * width * 8 > len(self.raw) - self.at:
            raise ValueError("the geometry is cut off")
        a = np.frombuffer(self.raw, f"{order}f8", n * width, self.at).astype(np.float64).reshape(n, width)[:, :2]
        self.at += n * width * 8
        return a

    def varint(self) -> int:
        x = shift = 0
        while True:
            b = self.raw[self.at]
            self.at += 1
            x |= (b & 0x7F) << shift
            if b < 0x80:
                return x
            shift += 7

    def zigzag(self) -> int:
        x = self.varint()
        return (x >> 1) ^ -(x & 1)


def from_wkb(raw: bytes) -> Geometry:
    """OGC and extended WKB of either byte order, and the blobs of a SpatiaLite column."""
    if len(raw) > 44 and raw[0] == 0 and raw[38] == 0x7C and raw[-1] == 0xFE:
        return _from_spatialite(raw)
    r = _Reader(raw)
    return _wkb(r)


def _wkb(r: _Reader, order: str | None = None) -> Geometry:
    order = order or ("<" if r.number("B") == 1 else ">")
    code = r.number(f"{order}I")
    width = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
    if code & 0x20000000:
        r.number(f"{order}I")
    code &= 0x0FFFFFFF
    width += {0: 0, 1: 1, 2: 1, 3: 2}.get(code // 1000, 0)
    kind = code % 1000
    if not 1 <= kind <= 7:
        raise ValueError(f"no geometry kind {code}")
    name = KINDS[kind]
    if kind == 1:
        p = r.array(order, 1, width)
        return Geometry(name, p[~np.isnan(p).any(1)])
    n = r.number(f"{order}I")
    if kind == 2:
        return Geometry(name, r.array(order, n, width))
    if kind == 3:
        return Geometry(name, [r.array(order, r.number(f"{order}I"), width) for _ in range(n)])
    parts = [_wkb(r) for _ in range(n)]
    if kind == 4:
        return Geometry(name, points(np.concatenate([p.parts for p in parts])) if parts else points([]))
    return Geometry(name, [p.parts for p in parts] if kind < 7 else parts)


def _from_spatialite(raw: bytes) -> Geometry:
    order = "<" if raw[1] == 1 else ">"
    r = _Reader(raw)
    r.at = 39

    def entity(inner: bool = False) -> Geometry:
        if inner:
            r.at += 1
        code = r.number(f"{order}I")
        kind, width = code % 1000, {0: 2, 1: 3, 2: 3, 3: 4}[code // 1000 % 10]
        if kind == 1:
            return Geometry("Point", r.array(order, 1, width))
        n = r.number(f"{order}I")
        if kind == 2:
            return Geometry("LineString", r.array(order, n, width))
        if kind == 3:
            return Geometry("Polygon", [r.array(order, r.number(f"{order}I"), width) for _ in range(n)])
        parts = [entity(True) for _ in range(n)]
        if kind == 4:
            return Geometry("MultiPoint", np.concatenate([p.parts for p in parts]) if parts else points([]))
        return Geometry(KINDS[kind], [p.parts for p in parts] if kind < 7 else parts)

    return entity()


def to_wkb(g: Geometry, order: str = "<") -> bytes:
    head = lambda kind: struct.pack(f"{order}BI", 1 if order == "<" else 0, kind)
    run = lambda a: struct.pack(f"{order}I", len(a)) + a.astype(f"{order}f8").tobytes()
    kind = KINDS.index(g.kind)
    if kind == 1:
        return head(1) + (g.parts[0] if len(g.parts) else np.array([np.nan, np.nan])).astype(f"{order}f8").tobytes()
    if kind == 2:
        return head(2) + run(g.parts)
    if kind == 3:
        return head(3) + struct.pack(f"{order}I", len(g.parts)) + b"".join(map(run, g.parts))
    inner = g.parts if kind == 7 else g.singles()
    return head(kind) + struct.pack(f"{order}I", len(inner)) + b"".join(to_wkb(x, order) for x in inner)


def from_twkb(raw: bytes) -> Geometry:
    return _twkb(_Reader(raw))


def _twkb(r: _Reader) -> Geometry:
    first, flags = r.number("B"), r.number("B")
    kind, precision = first & 15, first >> 4
    factor = 10.0 ** ((precision >> 1) ^ -(precision & 1))
    width = 2
    if flags & 8:
        more = r.number("B")
        width += (more & 1) + (more >> 1 & 1)
    if flags & 2:
        r.varint()
    if flags & 1:
        for _ in range(2 * width):
            r.zigzag()
    last = [0] * width

    def run(n: int) -> np.ndarray:
        out = np.empty((n, 2))
        for i in range(n):
            for k in range(width):
                last[k] += r.zigzag()
            out[i] = last[0] / factor, last[1] / factor
        return out

    if not 1 <= kind <= 7:
        raise ValueError(f"no geometry kind {kind}")
    if flags & 16:
        return Geometry(KINDS[kind], points([]) if kind in (1, 2, 4) else [])
    if kind == 1:
        return Geometry("Point", run(1))
    n = r.varint()
    if kind == 2:
        return Geometry("LineString", run(n))
    if kind == 3:
        return Geometry("Polygon", [run(r.varint()) for _ in range(n)])
    if flags & 4:
        for _ in range(n):
            r.zigzag()
    if kind == 4:
        return Geometry("MultiPoint", run(n))
    if kind == 5:
        return Geometry("MultiLineString", [run(r.varint()) for _ in range(n)])
    if kind == 6:
        return Geometry("MultiPolygon", [[run(r.varint()) for _ in range(r.varint())] for _ in range(n)])
    return Geometry("GeometryCollection", [_twkb(r) for _ in range(n)])


_WORDS = {k.upper(): k for k in KINDS[1:]}
_PIECE = re.compile(r"\s*([A-Za-z]+|[(),]|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)")


def from_wkt(text: str) -> Geometry:
    pieces, at = [], 0
    while at < len(text.rstrip()):
        m = _PIECE.match(text, at)
        if not m:
            raise ValueError(f"not WKT: {text[:60]!r}")
        pieces.append(m[1])
        at = m.end()
    i = 0

    def next_is(sign: str) -> bool:
        nonlocal i
        if i < len(pieces) and pieces[i] == sign:
            i += 1
            return True
        return False

    def need(sign: str) -> None:
        if not next_is(sign):
            raise ValueError(f"expected {sign} in {text[:60]!r}")

    def position() -> list[float]:
        nonlocal i
        own = []
        while i < len(pieces) and pieces[i] not in "(),":
            own.append(float(pieces[i]))
            i += 1
        if not 2 <= len(own) <= 4:
            raise ValueError(f"not a position in {text[:60]!r}")
        return own[:2]

    def listed(item) -> list:
        if i < len(pieces) and pieces[i].upper() == "EMPTY":
            next_is(pieces[i])
            return []
        need("(")
        out = [item()]
        while next_is(","):
            out.append(item())
        need(")")
        return out

    def run() -> np.ndarray:
        return points(listed(position))

    def bracketed() -> list[float]:
        if next_is("("):
            p = position()
            need(")")
            return p
        return position()

    def geometry() -> Geometry:
        nonlocal i
        name = pieces[i].upper() if i < len(pieces) else ""
        if name not in _WORDS:
            raise ValueError(f"not WKT: {text[:60]!r}")
        i += 1
        while i < len(pieces) and pieces[i].upper() in ("Z", "M", "ZM"):
            i += 1
        kind = _WORDS[name]
        if kind in ("Point", "LineString"):
            g = Geometry(kind, run())
            if kind == "Point" and len(g.parts) > 1:
                raise ValueError(f"not a point: {text[:60]!r}")
            return g
        if kind == "MultiPoint":
            return Geometry(kind, points(listed(bracketed)))
        if kind in ("Polygon", "MultiLineString"):
            return Geometry(kind, listed(run))
        if kind == "MultiPolygon":
            return Geometry(kind, listed(lambda: listed(run)))
        return Geometry(kind, listed(geometry))

    out = geometry()
    if i != len(pieces):
        raise ValueError(f"text after the geometry in {text[:60]!r}")
    return out


_PLAIN = re.compile(r"\s*(POINT|LINESTRING|POLYGON)\s*(\([-+0-9.eE ,()]*\))\s*")


def plain_wkt(text: str) -> bytes | None:
    """WKB of a point, line or polygon in its usual spelling; none for any other text, which from_wkt() may read."""
    m = _PLAIN.fullmatch(text)
    if not m:
        return None
    body = m[2][1:-1].strip()
    try:
        if m[1] == "POINT":
            x, y = body.split()
            return struct.pack("<BIdd", 1, 1, float(x), float(y))
        if m[1] == "POLYGON":
            if not (body.startswith("(") and body.endswith(")")):
                return None
            rings = body[1:-1].split("),(")
        else:
            rings = [body]
        out = [struct.pack("<BI", 1, 2) if m[1] == "LINESTRING" else struct.pack("<BII", 1, 3, len(rings))]
        for ring in rings:
            pairs = [p.split() for p in ring.split(",")]
            xy = np.array([float(v) for p in pairs for v in p], "<f8")
            if any(len(p) != 2 for p in pairs):
                return None
            out += [struct.pack("<I", len(pairs)), xy.tobytes()]
        return b"".join(out)
    except ValueError:
        return None


def plain_number(x: float) -> int | float:
    return int(x) if x == int(x) and abs(x) < 1e15 else float(x)


def point_text(raw: bytes, form: str, shown=None) -> str | None:
    """A point's two numbers, shown as in WKT or by another rule, put into form without building a geometry; none for any other WKB."""
    shown = shown or _shown
    if len(raw) != 21 or raw[:5] != b"\1\1\0\0\0":
        return None
    x, y = struct.unpack_from("<dd", raw, 5)
    return form.format(shown(x), shown(y)) if x - x == 0 and y - y == 0 else None


def _shown(x: float) -> str:
    return f"{x:.16g}" if x != int(x) or abs(x) >= 1e16 else str(int(x))


def to_wkt(g: Geometry) -> str:
    run = lambda a: "(" + ",".join(f"{_shown(x)} {_shown(y)}" for x, y in a) + ")"
    name = g.kind.upper()
    if g.kind != "GeometryCollection" and g.empty or not len(g.parts):
        return f"{name} EMPTY"
    if g.kind in ("Point", "LineString", "MultiPoint"):
        return name + run(g.parts)
    if g.kind in ("Polygon", "MultiLineString"):
        return name + "(" + ",".join(map(run, g.parts)) + ")"
    if g.kind == "MultiPolygon":
        return name + "(" + ",".join("(" + ",".join(map(run, p)) + ")" for p in g.parts) + ")"
    return name + "(" + ",".join(map(to_wkt, g.parts)) + ")"


def from_geojson(x: str | dict) -> Geometry:
    d = json.loads(x) if isinstance(x, str) else x
    kind = d.get("type")
    if kind == "GeometryCollection":
        return Geometry(kind, [from_geojson(g) for g in d["geometries"]])
    if kind not in KINDS:
        raise ValueError(f"no geometry kind {kind!r}")
    c = d["coordinates"]
    run = lambda a: points([p[:2] for p in a])
    if kind == "Point":
        return Geometry(kind, points([c[:2]] if c else []))
    if kind in ("LineString", "MultiPoint"):
        return Geometry(kind, run(c))
    if kind in ("Polygon", "MultiLineString"):
        return Geometry(kind, [run(a) for a in c])
    return Geometry(kind, [[run(a) for a in p] for p in c])


def geojson_dict(g: Geometry) -> dict:
    run = lambda a: [[plain_number(x), plain_number(y)] for x, y in a.tolist()]
    if g.kind == "GeometryCollection":
        return {"type": g.kind, "geometries": [geojson_dict(x) for x in g.parts]}
    if g.kind == "Point":
        return {"type": g.kind, "coordinates": run(g.parts)[0] if len(g.parts) else []}
    if g.kind in ("LineString", "MultiPoint"):
        return {"type": g.kind, "coordinates": run(g.parts)}
    if g.kind in ("Polygon", "MultiLineString"):
        return {"type": g.kind, "coordinates": [run(a) for a in g.parts]}
    return {"type": g.kind, "coordinates": [[run(a) for a in p] for p in g.parts]}


def to_geojson(g: Geometry) -> str:
    return json.dumps(geojson_dict(g), separators=(",", ":"))


def to_svg_path(g: Geometry) -> str:
    out = []
    for s in g.singles():
        rings = s.parts if s.kind == "Polygon" else [s.parts]
        for a in rings:
            if not len(a):
                continue
            own = a[:-1] if s.kind == "Polygon" and len(a) > 1 and (a[0] == a[-1]).all() else a
            out.append("M" + "L".join(f"{_shown(x)} {_shown(y)}" for x, y in own) + ("Z" if s.kind == "Polygon" else ""))
    return " ".join(out)
