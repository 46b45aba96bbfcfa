import gzip
import json
import os
import sqlite3
import struct

import numpy as np
import pytest

from atlasq.functions import codecs as C
from atlasq.functions.boxes import Extent
from atlasq.plans import processor, spec, tokens
from atlasq.sources import binary_tables as B
from atlasq.sources import delimited as D
from atlasq.sources import json_tables as J
from atlasq.sources import registry as R


@pytest.mark.parametrize("head,sep,quote", [("a,b\n1,2\n", ",", '"'), ("a\tb\n", "\t", '"'), ("a|b|c\n", "|", '"'), ("a;b\n1;2", ";", '"'), ("x,'y'\n1,'a'\n", ",", "'")])
def test_sniff(head, sep, quote):
    assert D.sniff(head) == D.Dialect(sep, quote)


@pytest.mark.parametrize("cell,kind", [("", "string"), ("12", "bigint"), ("012", "string"), ("0.5", "double"), ("1e3", "double"), ("true", "boolean"), ("null", "string"), ("123456789012345678901", "string"), ("-7", "bigint"), ("x", "string"), ("0", "bigint")])
def test_cell_kinds(spark, cell, kind):
    assert D.cell_kind(cell) == kind
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(cell,)], "c string").select(D.typed(F.col("c"))["kind"].alias("k")).first().k == kind


def test_csv(spark, tmp_path):
    t = D.read(spark, inline='wkt,Name\n"POINT (120.15 48.47)","Winthrop, WA"\n"POINT (1 2)",Québec\n')
    assert [(r.id, r.Name, r.minx) for r in t.df.orderBy("id").collect()] == [(1, "Winthrop, WA", 120.15), (2, "Québec", 1.0)]
    text = "lon;lat;name;n;ok\n1;2;a;5;true\n\n;;;;\n3;x;bad;6;false\n4;5;b;07;maybe\n6;7\n"
    t = D.read(spark, inline=text)
    rows = t.df.orderBy("id").collect()
    assert [(r.id, r.x, r.name, r.n, r.ok) for r in rows] == [(1, 1.0, "a", 5, True), (2, 4.0, "b", 7, None)]
    assert t.query(spec.SpatialQuery(Extent(3, 3, 9, 9), names=("name",))).count() == 1
    with pytest.raises(KeyError):
        t.query(spec.SpatialQuery(Extent(0, 0, 1, 1), names=("gone",)))
    with pytest.raises(ValueError):
        D.read(spark, inline=text, options=D.Options(strict=True))
    with pytest.raises(ValueError):
        D.read(spark, inline="a,b\n1,2\n")
    p = tmp_path / "x.csv"
    p.write_text("x,y,label\n1,2,a\n3,4,b\n5,6,c\n")
    assert R.create(spark, {"type": "csv", "file": str(p), "row_limit": "3"}).df.count() == 2


GEOJSON = json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": "Zürich", "n": 1, "d": 1.5, "o": {"a": [1]}, "nil": None, "b": True}, "geometry": {"type": "Point", "coordinates": [1, 2]}}, {"type": "Feature", "properties": {"name": "x"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 0]]]}}]})


def test_geojson(spark):
    t = J.geojson(spark, inline=GEOJSON)
    a, b = t.df.orderBy("id").collect()
    assert (a.id, a.name, a.n, a.d, a.o, a.nil, a.b, a.geom_type) == (1, "Zürich", 1, 1.5, '{"a":[1]}', None, True, 1)
    assert (b.id, b.name, b.n, b.maxx, b.geom_type) == (2, "x", None, 4.0, 3)
    line = json.loads(J.to_geojson_lines(t, ["name", "n"]).orderBy("value").first().value)
    assert line == {"type": "Feature", "id": 1, "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"name": "Zürich", "n": 1}}
    assert J.geojson(spark, inline='{"type":"Point","coordinates":[5,6]}').df.first().minx == 5.0
    boxes = J.bounding_boxes(spark.createDataFrame([('{"geometry":{"type":"LineString","coordinates":[[1,2],[3.5,-4]]}}',)], "value string")).first()
    assert (boxes.minx, boxes.miny, boxes.maxx, boxes.maxy) == (1.0, -4.0, 3.5, 2.0)


def test_topojson(spark):
    topo = {"type": "Topology", "transform": {"scale": [2, 2], "translate": [10, 10]}, "arcs": [[[0, 0], [1, 0], [0, 1]], [[1, 1], [-1, 0], [0, -1]]], "objects": {"o": {"type": "GeometryCollection", "geometries": [{"type": "Polygon", "arcs": [[0, 1]], "properties": {"k": 1}}, {"type": "LineString", "arcs": [-1]}, {"type": "Point", "coordinates": [3, 4]}]}}}
    rows = J.topojson(spark, inline=json.dumps(topo)).df.orderBy("id").collect()
    assert [C.to_wkt(C.from_wkb(bytes(r.geom))) for r in rows] == ["POLYGON((10 10,12 10,12 12,10 12,10 10))", "LINESTRING(12 12,12 10,10 10)", "POINT(16 18)"] and rows[0].k == 1


def varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def field(number, body):
    return varint(number << 3 | 2) + varint(len(body)) + body


def zig(values):
    return b"".join(varint(v << 1 if v >= 0 else (-v << 1) - 1) for v in values)


def test_geobuf(spark, tmp_path):
    geom = varint(8) + varint(4) + field(3, zig([0, 0, 10, 0, 0, 10]))
    feat = field(1, geom) + field(13, field(1, b"hi")) + field(14, varint(0) + varint(0))
    raw = field(1, b"name") + varint(3 << 3) + varint(0) + field(4, field(1, feat))
    (tmp_path / "a.pbf").write_bytes(raw)
    r = B.geobuf(spark, str(tmp_path / "a.pbf")).df.first()
    assert C.to_wkt(C.from_wkb(bytes(r.geom))) == "POLYGON((0 0,10 0,10 10,0 0))" and r.name == "hi"


def test_shapefile(spark, tmp_path):
    def record(n, body):
        return struct.pack(">ii", n, len(body) // 2) + body

    ring = np.array([[0, 0], [0, 2], [2, 2], [2, 0], [0, 0]], "<f8")
    poly = struct.pack("<i4dii", 5, 0, 0, 2, 2, 1, 5) + struct.pack("<i", 0) + ring.tobytes()
    body = record(1, struct.pack("<idd", 1, 3, 4)) + record(2, poly) + record(3, struct.pack("<i", 0))
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<ii8d", 1000, 5, *[0] * 8)
    (tmp_path / "s.shp").write_bytes(head + body)
    cols = [("NAME", "C", 5, 0), ("N", "N", 4, 0), ("D", "N", 6, 2), ("L", "L", 1, 0)]
    fields = b"".join(n.encode().ljust(11, b"\0") + t.encode() + b"\0" * 4 + bytes([w, d]) + b"\0" * 14 for n, t, w, d in cols)
    rows = b"".join(b" " + a.encode().ljust(5) + b.rjust(4) + c.rjust(6) + d for a, b, c, d in [("one", b"7", b"1.50", b"T"), ("two", b"****", b"2.25", b"?"), ("x", b"1", b"0.00", b"F")])
    dbf = struct.pack("<BBBBIHH20x", 3, 1, 1, 1, 3, 32 + len(fields) + 1, 17) + fields + b"\r" + rows
    (tmp_path / "s.dbf").write_bytes(dbf)
    a, b = B.shapefile(spark, str(tmp_path / "s")).df.orderBy("id").collect()
    assert (a.NAME, a.N, a.D, a.L, a.geom_type) == ("one", 7, 1.5, True, 1) and (b.NAME, b.N, b.L, b.geom_type) == ("two", None, False, 3)
    with pytest.raises(ValueError):
        B.shp_geometries(b"\0" * 100)


def test_sqlite_and_tiles(spark, tmp_path):
    path = str(tmp_path / "d.sqlite")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE p (id INTEGER, name TEXT, geometry BLOB)")
    con.executemany("INSERT INTO p VALUES (?,?,?)", [(i, f"n{i}", C.to_wkb(C.from_wkt(f"POINT({i} {i})"))) for i in range(5)])
    con.commit()
    con.close()
    t = R.create(spark, {"type": "sqlite", "file": path, "table": "p", "key_field": "id", "row_limit": "3", "row_offset": "1"})
    assert [r.name for r in t.df.orderBy("id").collect()] == ["n1", "n2", "n3"]
    layer = field(1, b"pts") + field(2, varint(1 << 3) + varint(9) + varint(3 << 3) + varint(1) + field(2, varint(0) + varint(0)) + field(4, varint(9) + zig([2048, 2048]))) + field(3, b"k") + field(4, field(1, b"v")) + varint(5 << 3) + varint(4096) + varint(15 << 3) + varint(2)
    tile = field(3, layer)
    mb = str(tmp_path / "t.mbtiles")
    con = sqlite3.connect(mb)
    con.execute("CREATE TABLE tiles (zoom_level INTEGER, tile_column INTEGER, tile_row INTEGER, tile_data BLOB)")
    con.execute("INSERT INTO tiles VALUES (0, 0, 0, ?)", (gzip.compress(tile),))
    con.commit()
    con.close()
    r = B.tiles(spark, mb, 0, (0, 0, 0, 0)).first()
    assert (r.layer, r.id, r.props) == ("pts", 9, {"k": '"v"'}) and C.from_wkb(bytes(r.geom)).parts[0] == pytest.approx([0, 0])
    directory = varint(1) + varint(0) + varint(1) + varint(len(tile)) + varint(1)
    head = b"PMTiles\x03" + struct.pack("<8Q", 127, len(directory), 0, 0, 0, 0, 127 + len(directory), len(tile))
    raw = head.ljust(97, b"\0") + b"\x01\x01\x01" + b"\0" * 27
    (tmp_path / "t.pmtiles").write_bytes(raw + directory + tile)
    assert B.tiles(spark, str(tmp_path / "t.pmtiles"), 0, (0, 0, 0, 0)).first().id == 9
    assert sorted(B.tile_of_id(i) for i in range(1, 5)) == [(1, 0, 0), (1, 0, 1), (1, 1, 0), (1, 1, 1)] and B.tile_of_id(1) == (1, 0, 0)


def test_sqlite_box_uses_the_index(spark, tmp_path):
    path = str(tmp_path / "r.sqlite")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE p (id INTEGER PRIMARY KEY, name TEXT, geometry BLOB)")
    con.execute("CREATE VIRTUAL TABLE idx_p_geometry USING rtree(pkid, xmin, xmax, ymin, ymax)")
    for i in range(20):
        con.execute("INSERT INTO p VALUES (?,?,?)", (i, f"n{i}", C.to_wkb(C.from_wkt(f"POINT({i} {i})"))))
        con.execute("INSERT INTO idx_p_geometry VALUES (?,?,?,?,?)", (i, i, i, i, i))
    con.execute("CREATE TABLE bare AS SELECT * FROM p")
    con.commit()
    con.close()
    box = Extent(3.0, 3.0, 5.5, 9.0)
    assert sorted(r.name for r in B.sqlite(spark, path, "p", key_field="id", box=box).df.collect()) == ["n3", "n4", "n5"]
    assert B.sqlite(spark, path, "bare", key_field="id", box=box).df.count() == 20


def test_raster_table_sql():
    q = spec.SpatialQuery(Extent(0, 0, 10, 10), (0.5, 0.25), 1000.0, ("a", "id"))
    plain = R.raster_table_sql("tiles", q)
    assert plain.startswith('SELECT ST_AsBinary("rast") AS geom,"a","id" FROM tiles WHERE "rast" && ST_SetSRID(')
    full = R.raster_table_sql("tiles", q, key_field="id", band=2, prescale=True, clip=True, row_limit=7)
    assert full.startswith('SELECT ST_AsBinary(ST_Band(ST_Resize(ST_Clip("rast", ST_Expand(') and full.count('"id"') == 1 and full.endswith(" LIMIT 7")
    assert 'least(1.0, abs(ST_ScaleX("rast"))::float8/2' in full
    # a pixel is 2 wide: of copies with pixels of 1, 1.5 and 4 the second is the coarsest that is finer
    copies = [R.Overview("o", "t4", "r4", 4.0), R.Overview("o", "t1", "r1", 1.0), R.Overview("o", "t15", "r15", 1.5)]
    assert ' FROM o.t15 WHERE "r15" && ' in R.raster_table_sql("public.tiles", q, overviews=copies)
    assert ' FROM o.t4 ' in R.raster_table_sql("public.tiles", q, overviews=copies[:1])


def test_rasters(spark, tmp_path):
    band = bytes([4 | 64, 255]) + bytes([1, 2, 255, 4])
    raw = b"\x01" + struct.pack("<HH6diHH", 0, 1, 1, -1, 0, 0, 0, 0, 4326, 2, 2) + band
    rows = B.raster_pixels(spark.createDataFrame([(1, bytearray(raw))], "id long, raster binary")).orderBy("y", "x").collect()
    assert [r.value for r in rows] == [1.0, 2.0, None, 4.0]
    (tmp_path / "g.asc").write_text("ncols 2\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 10\nNODATA_value -9\n1 2\n3 -9\n")
    head, px = B.ascii_grid(spark, str(tmp_path / "g.asc"))
    assert B.pixel_at(px, head, 15, 15).first().value == 2.0 and B.pixel_at(px, head, 15, 5).count() == 0


def test_png(spark, tmp_path):
    """Our own files, and ones of every row filter and colour type, written out by hand."""
    import zlib

    from pyspark.sql import functions as F

    from atlasq.sources import images as I

    rng = np.random.default_rng(7)
    a = rng.integers(0, 256, (13, 9, 4)).astype(np.uint8)
    assert (I.decode(I.encode(a)) == a).all()

    def png(width, height, depth, colour, rows, more=b""):
        head = struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)
        return I.SIGNATURE + I._chunk(b"IHDR", head) + more + I._chunk(b"IDAT", zlib.compress(b"".join(rows))) + I._chunk(b"IEND", b"")

    rows, above = [], np.zeros((9, 4), int)
    for y in range(13):
        own, kind = a[y].astype(int), y % 5
        left = np.concatenate([np.zeros((1, 4), int), own[:-1]])
        corner = np.concatenate([np.zeros((1, 4), int), above[:-1]])
        paeth = np.array([[min((abs(int(l) + int(u) - int(c) - v), k, v) for k, v in enumerate((int(l), int(u), int(c))))[2] for l, u, c in zip(*t)] for t in zip(left, above, corner)])
        guess = [0, left, above, (left + above) // 2, paeth][kind]
        rows.append(bytes([kind]) + ((own - guess) & 255).astype(np.uint8).tobytes())
        above = own
    assert (I.decode(png(9, 13, 8, 6, rows)) == a).all()
    assert I.decode(png(3, 1, 8, 0, [b"\0\x05\x06\xff"]))[0].tolist() == [[5, 5, 5, 255], [6, 6, 6, 255], [255, 255, 255, 255]]
    assert I.decode(png(3, 1, 1, 0, [b"\0\xa0"]))[0, :, 0].tolist() == [255, 0, 255]
    assert I.decode(png(2, 1, 16, 2, [b"\0" + bytes([1, 9, 2, 9, 3, 9, 4, 9, 5, 9, 6, 9])]))[0].tolist() == [[1, 2, 3, 255], [4, 5, 6, 255]]
    palette = I._chunk(b"PLTE", bytes([1, 2, 3, 4, 5, 6])) + I._chunk(b"tRNS", bytes([7]))
    assert I.decode(png(2, 1, 4, 3, [b"\0\x01"], palette))[0].tolist() == [[1, 2, 3, 7], [4, 5, 6, 255]]
    with pytest.raises(ValueError):
        I.decode(b"GIF89a")
    (tmp_path / "a.png").write_bytes(I.encode(a))
    view, px = I.read(spark, str(tmp_path / "a.png"), Extent(0.0, 0.0, 90.0, 130.0))
    assert (view.width, view.height) == (9, 13) and view.forward(45.0, 65.0) == (4.5, 6.5)
    assert px.count() == 117 and px.where((F.col("x") == 8) & (F.col("y") == 12)).first()[2:] == tuple(int(v) for v in a[12, 8])


def test_properties_of_all_features_are_kept(spark):
    """A property that only the last feature has is a column; types come from the first value."""
    features = [{"type": "Feature", "properties": {"n": None if i < 8 else i, **({"late": True} if i == 19 else {})}, "geometry": {"type": "Point", "coordinates": [i, i]}} for i in range(20)]
    t = J.geojson(spark, inline=json.dumps({"type": "FeatureCollection", "features": features})).df
    assert dict(t.dtypes)["n"] == "bigint" and dict(t.dtypes)["late"] == "boolean"
    assert [(r.id, r.n, r.late) for r in t.where("id in (8, 9, 20)").orderBy("id").collect()] == [(8, None, None), (9, 8, None), (20, 19, True)]


def test_many_csv_files_are_numbered_by_name(spark, tmp_path):
    for name, lines in (("b.csv", ["3,3,c"]), ("a.csv", ["1,1,a", "2,2,b"]), ("c.csv", [f"{i},{i},x{i}" for i in range(4, 60)])):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    t = D.read(spark, path=str(tmp_path), options=D.Options(headers="x,y,name"))
    assert [(r.id, int(r.x)) for r in t.df.orderBy("id").collect()] == [(i, i) for i in range(1, 60)]


def test_memory_and_registry(spark):
    t = R.memory(spark, [(1, "POINT(1 2)", {}), (2, "LINESTRING(-10 0,0 20)", {})], "")
    assert tuple(t.extent().first()) == (-10.0, 0.0, 1.0, 20.0) and t.at_point(1, 2, 0.1).count() == 1 and t.at_point(0, 2, 1).count() == 2
    with pytest.raises(ValueError):
        R.create(spark, {})
    with pytest.raises(ValueError):
        R.create(spark, {"type": "nothing"})


def test_sql_texts(spark):
    q = spec.SpatialQuery(Extent(0, 0, 10, 10), (2.0, 2.0), 1000.0, ("a", 'b"c'), variables={"v": "it's"})
    assert R.postgis_sql("t", q, key_field="gid").startswith('SELECT ST_AsBinary("geom") AS geom,"gid","a","b""c" FROM t WHERE "geom" && ST_SetSRID(')
    assert "WHERE" not in R.postgis_sql("(select * from t where geom && !bbox!) as d", q)[60:].split(") as d")[1]
    assert "ST_Simplify(ST_SnapToGrid(" in R.postgis_sql("t", q, simplify=True) and R.postgis_sql("t", q, row_limit=5).endswith(" LIMIT 5")
    assert tokens.fill("!scale_denominator! !pixel_width! !@v! !@gone! !what!", q) == "1000.0D 0.5D 'it''s' NULL NULL"
    for text, want in (("table", "table"), ("(select * FROM table1, table2) AS data", "table1"), ("( SELECT * from table1,table2 ) as x", "table1"), ('(select * from "s"."t") as d', '"s"."t"')):
        assert tokens.table_from_sql(text) == want
