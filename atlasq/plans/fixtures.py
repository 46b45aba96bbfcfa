"""Writers of the small files that the source queries read back: whole small tables in each format."""

from __future__ import annotations

import gzip
import json
import sqlite3
import struct

import numpy as np

from ..functions import codecs as C

#: (key, name, x, y)
Row = tuple[int, str, float, float]


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def zigzag(*values: int) -> bytes:
    return b"".join(varint(v << 1 if v >= 0 else (-v << 1) - 1) for v in values)


def message(number: int, body: bytes) -> bytes:
    return varint(number << 3 | 2) + varint(len(body)) + body


def number(field: int, value: int) -> bytes:
    return varint(field << 3) + varint(value)


def csv_text(rows: list[Row], separator: str = ",") -> str:
    return "\n".join([separator.join(("lon", "lat", "name", "key")), *(separator.join((str(x), str(y), f'"{n}"', str(k))) for k, n, x, y in rows)]) + "\n"


def geojson_text(rows: list[Row]) -> str:
    features = [{"type": "Feature", "properties": {"key": k, "name": n}, "geometry": {"type": "LineString", "coordinates": [[x, y], [x + 1, y + 2]]}} for k, n, x, y in rows]
    return json.dumps({"type": "FeatureCollection", "features": features})


def topojson_text(rows: list[Row]) -> str:
    """Lines of two arcs, the second one backwards."""
    arcs = [a for _, _, x, y in rows for a in ([[int(x), int(y)], [1, 1]], [[int(x) + 3, int(y) + 1], [-2, 0]])]
    shapes = [{"type": "LineString", "arcs": [2 * i, ~(2 * i + 1)], "properties": {"key": k, "name": n}} for i, (k, n, _, _) in enumerate(rows)]
    return json.dumps({"type": "Topology", "transform": {"scale": [1, 1], "translate": [0, 0]}, "arcs": arcs, "objects": {"o": {"type": "GeometryCollection", "geometries": shapes}}})


def geobuf_bytes(rows: list[Row]) -> bytes:
    features = []
    for k, n, x, y in rows:
        shape = number(1, 0) + message(3, zigzag(int(x), int(y)))
        features.append(message(1, message(1, shape) + message(13, number(3, k)) + message(13, message(1, n.encode())) + message(14, b"".join(map(varint, (0, 0, 1, 1))))))
    return message(1, b"key") + message(1, b"name") + number(3, 0) + message(4, b"".join(features))


def shape_bytes(rows: list[Row]) -> bytes:
    body = b"".join(struct.pack(">ii", i + 1, 10) + struct.pack("<idd", 1, x, y) for i, (_, _, x, y) in enumerate(rows))
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<ii8d", 1000, 1, *[0.0] * 8) + body


def line_files(rows: list[Row]) -> tuple[bytes, bytes, bytes]:
    """.shp, .shx and .dbf of lines from (x, y) to (x + 1, y + 2)."""
    body, places, at = [], [], 100
    for i, (_, _, x, y) in enumerate(rows):
        record = struct.pack("<i4d3i4d", 3, x, y, x + 1, y + 2, 1, 2, 0, x, y, x + 1, y + 2)
        body.append(struct.pack(">ii", i + 1, len(record) // 2) + record)
        places.append(struct.pack(">ii", at // 2, len(record) // 2))
        at += 8 + len(record)
    head = lambda n: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, n // 2) + struct.pack("<ii8d", 1000, 3, *[0.0] * 8)
    return head(at) + b"".join(body), head(100 + 8 * len(rows)) + b"".join(places), dbf_bytes(rows)


def dbf_bytes(rows: list[Row]) -> bytes:
    columns = [("KEY", "N", 12, 0), ("NAME", "C", 30, 0), ("SHARE", "N", 10, 3), ("EVEN", "L", 1, 0)]
    head = b"".join(n.encode().ljust(11, b"\0") + t.encode() + b"\0" * 4 + bytes([w, d]) + b"\0" * 14 for n, t, w, d in columns)
    cells = [b" " + str(k).encode().rjust(12) + n.encode().ljust(30) + f"{k / 8:.3f}".encode().rjust(10) + (b"T" if k % 2 == 0 else b"F") for k, n, _, _ in rows]
    return struct.pack("<BBBBIHH20x", 3, 1, 1, 1, len(rows), 32 + len(head) + 1, 54) + head + b"\r" + b"".join(cells)


def _database(statements: list[tuple[str, list[tuple]]]) -> bytes:
    con = sqlite3.connect(":memory:")
    for sql, rows in statements:
        con.executemany(sql, rows) if rows else con.execute(sql)
    con.commit()
    raw = con.serialize()
    con.close()
    return raw


def sqlite_bytes(rows: list[Row]) -> bytes:
    cells = [(k, n, k / 4, C.to_wkb(C.Geometry("Point", C.points([(x, y)])))) for k, n, x, y in rows]
    return _database([("CREATE TABLE places (id INTEGER, name TEXT, share REAL, geometry BLOB)", []), ("INSERT INTO places VALUES (?,?,?,?)", cells)])


def tile_bytes(rows: list[Row]) -> bytes:
    """A vector tile of the whole world with a point for each row; y grows downwards from the northern edge."""
    features, values = [], []
    for i, (k, n, x, y) in enumerate(rows):
        values.append(message(4, message(1, n.encode())))
        features.append(message(2, number(1, k) + message(2, varint(0) + varint(i)) + number(3, 1) + message(4, varint(9) + zigzag(int(x), int(y)))))
    return message(3, message(1, b"places") + b"".join(features) + message(3, b"name") + b"".join(values) + number(5, 4096) + number(15, 2))


def mbtiles_bytes(rows: list[Row]) -> bytes:
    return _database([("CREATE TABLE tiles (zoom_level INTEGER, tile_column INTEGER, tile_row INTEGER, tile_data BLOB)", []), ("INSERT INTO tiles VALUES (?,?,?,?)", [(0, 0, 0, gzip.compress(tile_bytes(rows)))])])


def pmtiles_bytes(rows: list[Row]) -> bytes:
    tile = gzip.compress(tile_bytes(rows))
    directory = varint(1) + varint(0) + varint(1) + varint(len(tile)) + varint(1)
    head = b"PMTiles\x03" + struct.pack("<8Q", 127, len(directory), 0, 0, 0, 0, 127 + len(directory), len(tile))
    return head.ljust(97, b"\0") + b"\x01\x02\x01" + b"\0" * 27 + directory + tile


def mbtiles_of(zoom: int, tiles: dict[tuple[int, int], bytes]) -> bytes:
    """An archive of a level's tiles by column and row (rows counted from the south in the file)."""
    cells = [(zoom, x, (1 << zoom) - 1 - y, gzip.compress(b, mtime=0)) for (x, y), b in sorted(tiles.items())]
    return _database([("CREATE TABLE tiles (zoom_level INTEGER, tile_column INTEGER, tile_row INTEGER, tile_data BLOB)", []), ("INSERT INTO tiles VALUES (?,?,?,?)", cells)])


def directory_bytes(entries: list[tuple[int, int, int, int]]) -> bytes:
    """A packed directory of (tile number, run, offset, size)."""
    ids = [e[0] for e in entries]
    steps = [b - a for a, b in zip([0, *ids], ids)]
    return gzip.compress(b"".join(map(varint, [len(entries), *steps, *(e[1] for e in entries), *(e[3] for e in entries), *(e[2] + 1 for e in entries)])))


def archive_bytes(tiles: dict[int, bytes], leaf: int = 4) -> bytes:
    """A version 3 archive of tiles by number, with leaf directories of so many tiles each; equal neighbours are runs."""
    entries: list[tuple[int, int, int, int]] = []
    data = b""
    for tile in sorted(tiles):
        body = gzip.compress(tiles[tile], mtime=0)
        if entries and entries[-1][0] + entries[-1][1] == tile and data[entries[-1][2] :] == body:
            entries[-1] = (entries[-1][0], entries[-1][1] + 1, *entries[-1][2:])
        else:
            entries.append((tile, 1, len(data), len(body)))
            data += body
    leaves, root = b"", []
    for i in range(0, len(entries), leaf):
        own = directory_bytes(entries[i : i + leaf])
        root.append((entries[i][0], 0, len(leaves), len(own)))
        leaves += own
    top = directory_bytes(root)
    at = 127 + len(top)
    head = b"PMTiles\x03" + struct.pack("<8Q", 127, len(top), 0, 0, at, len(leaves), at + len(leaves), len(data))
    return head.ljust(97, b"\0") + b"\x02\x02\x01" + bytes([0, 30]) + b"\0" * 25 + top + leaves + data


def tile_of_points(name: str, points: list[tuple[int, str, int, int]]) -> bytes:
    """A vector tile with a point (id, name, column and row in 4096 steps) for each row."""
    features = [message(2, number(1, k) + message(2, varint(0) + varint(i)) + number(3, 1) + message(4, varint(9) + zigzag(px, py))) for i, (k, _, px, py) in enumerate(points)]
    values = [message(4, message(1, n.encode())) for _, n, _, _ in points]
    return message(3, message(1, name.encode()) + b"".join(features) + message(3, b"name") + b"".join(values) + number(5, 4096) + number(15, 2))


def raster_blob(a: np.ndarray, nodata: int) -> bytes:
    """One band of bytes."""
    head = b"\x01" + struct.pack("<HH6diHH", 0, 1, 1.0, -1.0, 0.0, 0.0, 0.0, 0.0, 4326, a.shape[1], a.shape[0])
    return head + bytes([4 | 64, nodata]) + a.astype(np.uint8).tobytes()
