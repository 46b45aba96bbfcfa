"""Records of shapefiles and of the tables beside them."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from ..functions import codecs as C


def shape_at(raw: bytes, body: int) -> C.Geometry | None:
    """The geometry whose kind stands at body; none for a null shape. Points, multipoints, lines and polygons, with or without Z and M; other kinds are refused."""
    kind = struct.unpack_from("<i", raw, body)[0]
    plain = kind % 10
    if kind == 0:
        return None
    if kind == 31 or plain not in (1, 3, 5, 8):
        raise ValueError(f"no shape kind {kind}")
    if plain == 1:
        return C.Geometry("Point", np.frombuffer(raw, "<f8", 2, body + 4).reshape(1, 2).copy())
    if plain == 8:
        n = struct.unpack_from("<i", raw, body + 36)[0]
        return C.Geometry("MultiPoint", np.frombuffer(raw, "<f8", 2 * n, body + 40).reshape(-1, 2).copy())
    parts, n = struct.unpack_from("<ii", raw, body + 36)
    starts = [*struct.unpack_from(f"<{parts}i", raw, body + 44), n]
    xy = np.frombuffer(raw, "<f8", 2 * n, body + 44 + 4 * parts).reshape(-1, 2)
    rings = [xy[a:b].copy() for a, b in zip(starts[:-1], starts[1:])]
    if plain == 3:
        return C.Geometry("LineString", rings[0]) if parts == 1 else C.Geometry("MultiLineString", rings)
    from ..functions.shapes import is_clockwise

    polygons: list[list] = []
    for ring in rings:
        if not polygons or is_clockwise(ring):
            polygons.append([ring])
        else:
            polygons[-1].append(ring)
    return C.Geometry("Polygon", polygons[0]) if len(polygons) == 1 else C.Geometry("MultiPolygon", polygons)


@dataclass(frozen=True)
class Column:
    name: str
    letter: str
    width: int
    decimals: int

    @property
    def kind(self) -> str:
        return {"C": "string", "D": "string", "L": "boolean"}.get(self.letter, "double" if self.decimals > 0 else "bigint")


@dataclass(frozen=True)
class Layout:
    """A table's number of records, bytes before them and of each, and columns."""

    count: int
    head: int
    size: int
    columns: tuple[Column, ...]


def dbf_layout(raw: bytes, encoding: str = "utf-8") -> Layout:
    count, head, size = struct.unpack_from("<IHH", raw, 4)
    columns, at = [], 32
    while raw[at] != 0x0D:
        columns.append(Column(raw[at : at + 11].split(b"\0")[0].decode(encoding, "replace"), chr(raw[at + 11]), raw[at + 16], raw[at + 17]))
        at += 32
    return Layout(count, head, size, tuple(columns))


def cells(raw: bytes, at: int, layout: Layout, encoding: str = "utf-8") -> dict:
    """The cells of a record. Numbers that start with a star are absent; only 1, t, T, y, Y are true."""
    row: dict = {}
    at += 1
    for c in layout.columns:
        text = raw[at : at + c.width].decode(encoding, "replace").strip(" \0")
        at += c.width
        if c.letter in "CD":
            row[c.name] = text
        elif c.letter == "L":
            row[c.name] = text[:1] in ("1", "t", "T", "y", "Y") and text != ""
        elif c.letter in "NOF" and text[:1] != "*":
            try:
                row[c.name] = float(text) if c.decimals > 0 else int(float(text))
            except ValueError:
                row[c.name] = None
    return row
