"""Geobuf, shapefiles, SQLite tables, vector tiles and raster blobs, each decoded where Spark reads the bytes."""

from __future__ import annotations

import gzip
import json
import sqlite3
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs as C
from ..functions.boxes import Extent
from ..functions.projection import CIRCUMFERENCE
from ..plans.processor import SpatialTable
from .json_tables import _finish, place
from .shape_records import cells, dbf_layout, shape_at

_ROWS = "_n long, geom binary, props map<string,string>"


def _as_rows(files: DataFrame, decode) -> DataFrame:
    """Features (geometry, properties) of each file's bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for n, content in zip(frame["_n"], frame["content"]):
                rows = [(place(n, i), C.to_wkb(g) if g is not None else None, {k: json.dumps(v, ensure_ascii=False) for k, v in p.items()}) for i, (g, p) in enumerate(decode(bytes(content)))]
                if rows:
                    yield pd.DataFrame(rows, columns=["_n", "geom", "props"])

    return files.select("content").withColumn("_n", F.monotonically_increasing_id()).mapInPandas(run, _ROWS).where("geom is not null")


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


# --- protocol buffers -------------------------------------------------------------


def fields(raw: bytes) -> Iterator[tuple[int, int, object]]:
    """Field number, wire type and value of a message."""
    r = C._Reader(raw)
    while r.at < len(raw):
        tag = r.varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, kind, r.varint()
        elif kind == 1:
            yield tag >> 3, kind, r.number("<d")
        elif kind == 2:
            n = r.varint()
            yield tag >> 3, kind, raw[r.at : r.at + n]
            r.at += n
        elif kind == 5:
            yield tag >> 3, kind, r.number("<f")
        else:
            raise ValueError(f"no wire type {kind}")


def packed(raw: bytes, zigzag: bool = False) -> list[int]:
    r, out = C._Reader(raw), []
    while r.at < len(raw):
        out.append(r.zigzag() if zigzag else r.varint())
    return out


def geobuf_features(raw: bytes) -> list[tuple[C.Geometry, dict]]:
    keys: list[str] = []
    dims, precision, body = 2, 6, None
    for n, _, v in fields(raw):
        if n == 1:
            keys.append(v.decode())
        elif n == 2:
            dims = v
        elif n == 3:
            precision = v
        elif n in (4, 5, 6):
            body = n, v
    factor = 10.0**precision
    # fixed values: geometry kinds by number
    names = ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon", "GeometryCollection")

    def shape(raw: bytes) -> C.Geometry:
        kind, lengths, coords, inner = "Point", [], [], []
        for n, _, v in fields(raw):
            if n == 1:
                kind = names[v]
            elif n == 2:
                lengths = packed(v)
            elif n == 3:
                coords = packed(v, True)
            elif n == 4:
                inner.append(shape(v))
        c = np.array(coords, float).reshape(-1, dims)[:, :2]
        run = lambda a, n, closed=False: _closed(np.cumsum(a[:n], axis=0) / factor) if closed else np.cumsum(a[:n], axis=0) / factor
        if kind == "Point":
            return C.Geometry(kind, c / factor)
        if kind in ("MultiPoint", "LineString"):
            return C.Geometry(kind, run(c, len(c)))
        if kind in ("MultiLineString", "Polygon"):
            out, at = [], 0
            for n in lengths or [len(c)]:
                out.append(run(c[at:], n, kind == "Polygon"))
                at += n
            return C.Geometry(kind, out)
        if kind == "MultiPolygon":
            if not lengths:
                return C.Geometry(kind, [[run(c, len(c), True)]])
            out, at, i = [], 0, 1
            for _ in range(lengths[0]):
                rings = []
                for n in lengths[i + 1 : i + 1 + lengths[i]]:
                    rings.append(run(c[at:], n, True))
                    at += n
                i += 1 + lengths[i]
                out.append(rings)
            return C.Geometry(kind, out)
        return C.Geometry(kind, inner)

    def value(raw: bytes) -> object:
        for n, _, v in fields(raw):
            return v.decode() if n == 1 else v if n in (2, 3) else -v if n == 4 else bool(v) if n == 5 else json.loads(v)
        return None

    def feature(raw: bytes) -> tuple[C.Geometry, dict]:
        g, vals, props = None, [], []
        for n, _, v in fields(raw):
            if n == 1:
                g = shape(v)
            elif n == 13:
                vals.append(value(v))
            elif n == 14:
                props = packed(v)
        return g, {keys[k]: vals[i] for k, i in zip(props[::2], props[1::2])}

    if body is None:
        return []
    if body[0] == 4:
        return [feature(v) for n, _, v in fields(body[1]) if n == 1]
    return [feature(body[1])] if body[0] == 5 else [(shape(body[1]), {})]


def _closed(a: np.ndarray) -> np.ndarray:
    return np.concatenate([a, a[:1]]) if len(a) and (a[0] != a[-1]).any() else a


def geobuf(spark: SparkSession, path: str) -> SpatialTable:
    return _finish(_as_rows(files(spark, path), geobuf_features))


# --- shapefiles -------------------------------------------------------------


def shp_geometries(raw: bytes) -> list[C.Geometry | None]:
    if struct.unpack_from(">i", raw)[0] != 9994:
        raise ValueError("not a shapefile")
    out: list[C.Geometry | None] = []
    at = 100
    while at + 8 <= len(raw):
        out.append(shape_at(raw, at + 8))
        at += 8 + 2 * struct.unpack_from(">i", raw, at + 4)[0]
    return out


def dbf_records(raw: bytes, encoding: str = "utf-8") -> tuple[list[tuple[str, str, int]], list[dict]]:
    """Fields (name, type, decimals) and records."""
    layout = dbf_layout(raw, encoding)
    rows = [cells(raw, layout.head + i * layout.size, layout, encoding) for i in range(layout.count)]
    return [(c.name, c.letter, c.decimals) for c in layout.columns], rows


def shapefile(spark: SparkSession, stem: str, encoding: str = "utf-8", row_limit: int = 0) -> SpatialTable:
    """stem.shp with stem.dbf."""
    shp = files(spark, f"{stem}.shp").select(F.col("content").alias("shp"), F.regexp_replace("path", r"\.shp$", "").alias("stem"))
    dbf = files(spark, f"{stem}.dbf").select(F.col("content").alias("dbf"), F.regexp_replace("path", r"\.dbf$", "").alias("stem"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for n, a, b in zip(frame["_n"], frame["shp"], frame["dbf"]):
                rows = []
                for i, (g, p) in enumerate(zip(shp_geometries(bytes(a)), dbf_records(bytes(b), encoding)[1])):
                    if g is not None:
                        rows.append((place(n, i), C.to_wkb(g), {k: json.dumps(v, ensure_ascii=False) for k, v in p.items()}))
                if rows:
                    yield pd.DataFrame(rows, columns=["_n", "geom", "props"])

    rows = shp.join(dbf, "stem").withColumn("_n", F.monotonically_increasing_id()).mapInPandas(run, _ROWS)
    if row_limit > 0:
        rows = rows.orderBy("_n").limit(row_limit)
    return _finish(rows)


# --- SQLite -------------------------------------------------------------


def _geometry(raw: object, form: str) -> C.Geometry | None:
    if raw is None:
        return None
    if isinstance(raw, str):
        return C.from_wkt(raw)
    return C.from_twkb(raw) if form == "twkb" else C.from_wkb(raw)


def sqlite(spark: SparkSession, path: str, table: str, geometry_field: str = "geometry", key_field: str | None = None, wkb_format: str = "auto", row_limit: int = 0, row_offset: int = 0, fields: str = "*", box: Extent | None = None) -> SpatialTable:
    """A table or a subquery of a SQLite file; the file's bytes are opened where they are read.

    Where a box is given and the table has an index of boxes (an R-tree named idx_table_geometry), only rows whose
    boxes meet it are decoded; ids then count these rows.
    """
    index = f"idx_{table}_{geometry_field}"
    near = ""
    if box is not None:
        near = f" WHERE {key_field or 'rowid'} IN (SELECT pkid FROM {index} WHERE xmax >= {box.minx!r} AND xmin <= {box.maxx!r} AND ymax >= {box.miny!r} AND ymin <= {box.maxy!r})"
    tail = (f" LIMIT {row_limit}" if row_limit > 0 else " LIMIT -1" if row_offset else "") + (f" OFFSET {row_offset}" if row_offset else "")

    def decode(raw: bytes) -> list[tuple[C.Geometry | None, dict]]:
        con = sqlite3.connect(":memory:")
        con.deserialize(raw)
        indexed = near and con.execute("SELECT count(*) FROM sqlite_master WHERE name = ?", (index,)).fetchone()[0]
        cursor = con.execute(f"SELECT {fields} FROM {table}" + (near if indexed else "") + tail)
        names = [c[0] for c in cursor.description]
        if geometry_field not in names:
            raise ValueError(f"no column {geometry_field}; there are {names}")
        out = []
        for row in cursor:
            d = dict(zip(names, row))
            g = _geometry(d.pop(geometry_field), wkb_format)
            if key_field:
                d.pop(key_field, None)
            out.append((g, {k: v for k, v in d.items() if not isinstance(v, bytes)}))
        con.close()
        return out

    return _finish(_as_rows(files(spark, path), decode))


# --- vector tiles -------------------------------------------------------------


def mvt_features(raw: bytes, z: int, x: int, y: int, layer: str | None = None) -> list[tuple[str, int, C.Geometry, dict]]:
    """Features of a tile in mercator units: layer, id, geometry, properties."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    size = CIRCUMFERENCE / (1 << z)
    ox, oy = x * size - CIRCUMFERENCE / 2, CIRCUMFERENCE / 2 - y * size
    out = []
    for n, _, body in fields(raw):
        if n != 3:
            continue
        name, keys, vals, feats, extent = "", [], [], [], 4096
        for k, _, v in fields(body):
            if k == 1:
                name = v.decode()
            elif k == 2:
                feats.append(v)
            elif k == 3:
                keys.append(v.decode())
            elif k == 4:
                own = next(iter(fields(v)), None)
                vals.append(None if own is None else own[2].decode() if own[0] == 1 else bool(own[2]) if own[0] == 7 else (own[2] >> 1) ^ -(own[2] & 1) if own[0] == 6 else own[2] - (1 << 64) if own[0] == 4 and own[2] >> 63 else own[2])
            elif k == 5:
                extent = v
        if layer is not None and name != layer:
            continue
        for f in feats:
            fid, kind, tags, commands = 0, 0, [], []
            for k, _, v in fields(f):
                if k == 1:
                    fid = v
                elif k == 2:
                    tags = packed(v)
                elif k == 3:
                    kind = v
                elif k == 4:
                    commands = packed(v)
            paths: list[list] = []
            i = cx = cy = 0
            while i < len(commands):
                op, count = commands[i] & 7, commands[i] >> 3
                i += 1
                for _ in range(count):
                    if op == 7:
                        paths[-1].append(paths[-1][0])
                        continue
                    dx, dy = ((c >> 1) ^ -(c & 1) for c in commands[i : i + 2])
                    i += 2
                    cx, cy = cx + dx, cy + dy
                    p = (ox + cx * size / extent, oy - cy * size / extent)
                    if op == 1:
                        paths.append([p])
                    else:
                        paths[-1].append(p)
            arrays = [C.points(p) for p in paths]
            props = {keys[a]: vals[b] for a, b in zip(tags[::2], tags[1::2])}
            if kind == 1:
                a = np.concatenate(arrays) if arrays else C.points([])
                g = C.Geometry("Point" if len(a) == 1 else "MultiPoint", a)
            elif kind == 2:
                g = C.Geometry("LineString", arrays[0]) if len(arrays) == 1 else C.Geometry("MultiLineString", arrays)
            elif kind == 3:
                from ..functions.shapes import signed_area

                polygons: list[list] = []
                for a in arrays:
                    # rows grow downwards in a tile, so its outer rings turn clockwise in the plane
                    if not polygons or signed_area(a) < 0:
                        polygons.append([a])
                    else:
                        polygons[-1].append(a)
                g = C.Geometry("Polygon", polygons[0]) if len(polygons) == 1 else C.Geometry("MultiPolygon", polygons)
            else:
                continue
            out.append((name, fid, g, props))
    return out


def pmtiles_entries(raw: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """Zoom, column, row and bytes of the tiles of a version 3 archive."""
    if raw[:7] != b"PMTiles" or raw[7] != 3:
        raise ValueError("not a version 3 archive")
    root, root_n, _, _, leaves, _, data, _ = struct.unpack_from("<8Q", raw, 8)
    inner = raw[97]
    unpack = lambda b: gzip.decompress(b) if inner == 2 else b

    def directory(b: bytes) -> Iterator[tuple[int, int, int, int]]:
        r = C._Reader(unpack(b))
        n = r.varint()
        ids, last = [], 0
        for _ in range(n):
            last += r.varint()
            ids.append(last)
        runs = [r.varint() for _ in range(n)]
        sizes = [r.varint() for _ in range(n)]
        offsets: list[int] = []
        for i in range(n):
            v = r.varint()
            offsets.append(offsets[-1] + sizes[i - 1] if v == 0 and i else v - 1)
        for t, k, s, o in zip(ids, runs, sizes, offsets):
            if k == 0:
                yield from directory(raw[leaves + o : leaves + o + s])
            else:
                for j in range(k):
                    yield t + j, o, s, 0

    for tile, offset, size, _ in directory(raw[root : root + root_n]):
        z, x, y = tile_of_id(tile)
        yield z, x, y, raw[data + offset : data + offset + size]


def tile_of_id(tile: int) -> tuple[int, int, int]:
    """Tiles are numbered along a Hilbert curve, level after level."""
    z, below = 0, 0
    while below + (1 << 2 * z) <= tile:
        below += 1 << 2 * z
        z += 1
    t, x, y, s = tile - below, 0, 0, 1
    while s < 1 << z:
        rx = 1 & (t >> 1)
        ry = 1 & (t ^ rx)
        if not ry:
            if rx:
                x, y = s - 1 - x, s - 1 - y
            x, y = y, x
        x, y = x + s * rx, y + s * ry
        t >>= 2
        s <<= 1
    return z, x, y


def tiles(spark: SparkSession, path: str, zoom: int, span: tuple[int, int, int, int], layer: str | None = None) -> DataFrame:
    """layer, id, geom, props and the tile of the features of an .mbtiles or .pmtiles archive at a zoom, for a range of tiles (first and last column and row)."""
    x0, x1, y0, y1 = span
    pm = path.endswith(".pmtiles")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                raw = bytes(content)
                if pm:
                    found = [t for t in pmtiles_entries(raw) if t[0] == zoom and x0 <= t[1] <= x1 and y0 <= t[2] <= y1]
                else:
                    con = sqlite3.connect(":memory:")
                    con.deserialize(raw)
                    top = (1 << zoom) - 1
                    found = [(zoom, x, top - r, b) for x, r, b in con.execute("SELECT tile_column, tile_row, tile_data FROM tiles WHERE zoom_level = ? AND tile_column BETWEEN ? AND ? AND tile_row BETWEEN ? AND ?", (zoom, x0, x1, top - y1, top - y0))]
                    con.close()
                rows = [(x, y, name, fid, C.to_wkb(g), {k: json.dumps(v) for k, v in p.items()}) for z, x, y, b in found for name, fid, g, p in mvt_features(b, z, x, y, layer)]
                if rows:
                    yield pd.DataFrame(rows, columns=["tx", "ty", "layer", "id", "geom", "props"])

    return files(spark, path).select("content").mapInPandas(run, "tx int, ty int, layer string, id long, geom binary, props map<string,string>")


# --- rasters -------------------------------------------------------------

#: Pixel kinds of raster blobs by number.
RASTER_PIXELS = {0: "u1", 1: "u1", 2: "u1", 3: "i1", 4: "u1", 5: "i2", 6: "u2", 7: "i4", 8: "u4", 10: "f4", 11: "f8"}


def raster_bands(raw: bytes) -> tuple[dict, list[tuple[np.ndarray, float | None]]]:
    """Header and bands (pixels, nodata) of a raster blob."""
    order = "<" if raw[0] == 1 else ">"
    version, n = struct.unpack_from(f"{order}HH", raw, 1)
    sx, sy, ox, oy, kx, ky = struct.unpack_from(f"{order}6d", raw, 5)
    srid, width, height = struct.unpack_from(f"{order}iHH", raw, 53)
    at, bands = 61, []
    for _ in range(n):
        flags = raw[at]
        kind = RASTER_PIXELS.get(flags & 15)
        if kind is None or flags & 128:
            raise ValueError("bands of this kind or outside the blob aren't read")
        t = np.dtype(order + kind)
        nodata = np.frombuffer(raw, t, 1, at + 1)[0]
        at += 1 + t.itemsize
        bands.append((np.frombuffer(raw, t, width * height, at).reshape(height, width), float(nodata) if flags & 64 else None))
        at += width * height * t.itemsize
    return {"version": version, "scale_x": sx, "scale_y": sy, "x": ox, "y": oy, "skew_x": kx, "skew_y": ky, "srid": srid, "width": width, "height": height}, bands


def raster_pixels(df: DataFrame, column: str = "raster", band: int = 1) -> DataFrame:
    """Pixels x, y, value of raster blobs with their other columns' id; nodata is null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for fid, raw in zip(frame["id"], frame[column]):
                _, bands = raster_bands(bytes(raw))
                a, nodata = bands[band - 1]
                y, x = np.mgrid[0 : a.shape[0], 0 : a.shape[1]]
                v = a.astype(float).ravel()
                yield pd.DataFrame({"id": fid, "x": x.ravel(), "y": y.ravel(), "value": [None if nodata is not None and q == nodata else q for q in v]})

    return df.select(F.col("id").cast("long").alias("id"), column).mapInPandas(run, "id long, x int, y int, value double")


def ascii_grid(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """Header and pixels (x, y, value) of an ASCII grid; rows are read and split in parallel."""
    lines = spark.read.text(path).withColumn("_n", F.monotonically_increasing_id())
    head = {}
    for r in lines.orderBy("_n").limit(6).collect():
        parts = r["value"].split()
        if len(parts) == 2 and not parts[0].lstrip("-")[:1].isdigit():
            head[parts[0].lower()] = float(parts[1])
    from ..operators.ordering import numbered

    rows = numbered(lines.where(F.regexp_like("value", F.lit(r"^\s*[-0-9.]"))), [("_n", True)], "_row")
    cells = rows.select((F.col("_row") - 1).cast("int").alias("y"), F.posexplode(F.split(F.trim("value"), r"\s+")).alias("x", "v"))
    value = F.col("v").try_cast("double")
    return head, cells.select("x", "y", F.when(value != head.get("nodata_value", float("nan")), value).alias("value"))


def pixel_at(df: DataFrame, head: dict, x: float, y: float) -> DataFrame:
    """The pixel that holds a point as one row (id 1, value); none where it has no data."""
    size = head["cellsize"]
    px = int((x - head["xllcorner"]) // size)
    py = int(head["nrows"] - 1 - (y - head["yllcorner"]) // size)
    return df.where((F.col("x") == px) & (F.col("y") == py) & F.col("value").isNotNull()).select(F.lit(1).cast("long").alias("id"), "value")
