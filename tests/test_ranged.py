"""Files read by ranges: partitions, bytes read, and rows equal to a whole read."""

import gzip

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThanOrEqual

from atlasq.functions.boxes import Box, Extent
from atlasq.plans import fixtures
from atlasq.plans.spec import SpatialQuery
from atlasq.sources import binary_tables, ranged, registry


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """Two shapefiles with 1,000 lines each, indexed."""
    rng = np.random.default_rng(4)
    folder = tmp_path_factory.mktemp("lines")
    rows = [(i, f"n{i}", float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(-180, 178, 2000), rng.uniform(-90, 88, 2000)))]
    for k in range(2):
        for ending, data in zip((".shp", ".shx", ".dbf"), fixtures.line_files(rows[1000 * k : 1000 * k + 1000])):
            (folder / f"part{k}{ending}").write_bytes(data)
    assert {r.records for r in ranged.write_indexes(spark, str(folder)).collect()} == {1000}
    return str(folder), rows


def _filters(x0, y0, x1, y1):
    return [LessThanOrEqual(("minx",), x1), GreaterThanOrEqual(("maxx",), x0), LessThanOrEqual(("miny",), y1), GreaterThanOrEqual(("maxy",), y0)]


def test_shapefile_in_several_partitions(spark, lines):
    folder, rows = lines
    whole = ranged.shapefiles(spark, folder, split_bytes=10_000).df
    assert whole.rdd.getNumPartitions() > 10
    found = sorted((r.KEY, r.NAME, r.minx, r.maxy, r.EVEN, r.id) for r in whole.collect())
    assert found == [(k, n, x, y + 2, k % 2 == 0, k % 1000 + 1) for k, n, x, y in rows]
    plain = binary_tables.shapefile(spark, f"{folder}/part1").df
    assert sorted(tuple(r) for r in plain.select("KEY", "geom", "SHARE").collect()) == sorted(tuple(r) for r in whole.where("KEY >= 1000").select("KEY", "geom", "SHARE").collect())


@pytest.mark.parametrize("box", [(-20.0, -10.0, 15.0, 20.0), (0.0, 0.0, 0.5, 0.5), (-180.0, -90.0, 180.0, 90.0), (500.0, 0.0, 501.0, 1.0)])
def test_box_reaches_the_index(spark, lines, box):
    folder, rows = lines
    want = sorted(k for k, _, x, y in rows if x <= box[2] and x + 1 >= box[0] and y <= box[3] and y + 2 >= box[1])
    table = registry.create(spark, {"type": "shapes", "file": folder})
    found = table.query(SpatialQuery(Extent(*box), names=("KEY",)))
    assert sorted(r.KEY for r in found.collect()) == want
    # counted: what tasks read of the records
    schema = table.df.schema
    reader = ranged.ShapeReader({"path": folder}, schema)
    assert len(list(reader.pushFilters(_filters(*box)))) == 4 and reader.box == box
    files, got = [], []
    for part in reader.partitions():
        shp, dbf = ranged.Ranged(f"{part.stem}.shp"), ranged.Ranged(f"{part.stem}.dbf")
        files.append(shp)
        got += [k for b in reader.read_from(part, shp, dbf) for k in b.column("KEY").to_pylist()]
    assert sorted(got) == want
    size = sum(ranged.Ranged(f"{folder}/part{k}.shp").size for k in range(2))
    read = sum(f.read_bytes for f in files)
    if len(want) < 100:
        assert read < size / 3 and reader.looked < 2 * 2 * ranged.Ranged(f"{folder}/part0.index").size
    assert read <= 2.2 * size


def test_scan_without_an_index_and_with_look_in_tasks(spark, lines, tmp_path, monkeypatch):
    folder, rows = lines
    for ending in (".shp", ".shx", ".dbf"):
        (tmp_path / f"a{ending}").write_bytes(open(f"{folder}/part0{ending}", "rb").read())
    where = Box.columns().intersects(Extent(-60.0, -30.0, 60.0, 30.0))
    plain = ranged.shapefiles(spark, str(tmp_path)).df.where(where).select("KEY")
    with_index = ranged.shapefiles(spark, f"{folder}/part0").df.where(where).select("KEY")
    assert sorted(r.KEY for r in plain.collect()) == sorted(r.KEY for r in with_index.collect()) and with_index.count() > 50
    schema = ranged.shapefiles(spark, folder).df.schema
    reader = ranged.ShapeReader({"path": folder}, schema)
    reader.pushFilters(_filters(-60, -30, 60, 30))
    monkeypatch.setattr(ranged, "LOOKED_INTO", 1)
    late = reader.partitions()
    assert all(p.look for p in late)
    monkeypatch.setattr(ranged, "LOOKED_INTO", 64)
    keys = lambda parts: sorted(k for p in parts for b in reader.read(p) for k in b.column("KEY").to_pylist())
    assert keys(late) == keys(reader.partitions())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(-50, 50), st.floats(-50, 50), st.floats(0, 9), st.floats(0, 9)), max_size=60), st.tuples(st.floats(-60, 60), st.floats(-60, 60), st.floats(0, 40), st.floats(0, 40)))
def test_index(tmp_path_factory, found, asked):
    """An index finds every box that meets the asked one, and none that is farther off than single precision tells."""
    boxes = np.array([(x, y, x + w, y + h) for x, y, w, h in found]).reshape(-1, 4)
    box = (asked[0], asked[1], asked[0] + asked[2], asked[1] + asked[3])
    path = tmp_path_factory.mktemp("i") / "x.index"
    path.write_bytes(ranged.index_bytes(np.arange(len(boxes)) * 10, boxes))
    hits = set(ranged.index_hits(ranged.Ranged(str(path)), box).tolist())
    meets = lambda b, d: b[0] <= box[2] + d and b[2] >= box[0] - d and b[1] <= box[3] + d and b[3] >= box[1] - d
    assert {10 * i for i, b in enumerate(boxes) if meets(b, 0)} <= hits <= {10 * i for i, b in enumerate(boxes) if meets(b, 1e-4)}


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 12), st.data())
def test_tile_numbers(z, data):
    last = (1 << z) - 1
    x, y = data.draw(st.integers(0, last)), data.draw(st.integers(0, last))
    assert binary_tables.tile_of_id(ranged.id_of_tile(z, x, y)) == (z, x, y)
    x1, y1 = data.draw(st.integers(x, min(last, x + 30))), data.draw(st.integers(y, min(last, y + 30)))
    ranges = ranged.id_ranges(z, (x, x1, y, y1))
    assert all(ranged._meets(ranges, t, t + 1) for t in (ranged.id_of_tile(z, i, j) for i in range(x, x1 + 1) for j in range(y, y1 + 1)))
    assert all(a < b for a, b in ranges) and all(b < c for (_, b), (c, _) in zip(ranges, ranges[1:]))
    if sum(b - a for a, b in ranges) < 5000:
        inside = sum(1 for a, b in ranges for t in range(a, b) for _, i, j in [binary_tables.tile_of_id(t)] if x <= i <= x1 and y <= j <= y1)
        assert inside == (x1 - x + 1) * (y1 - y + 1)


def test_tile_number_column(spark):
    df = spark.range(64).select((F.col("id") % 8).cast("int").alias("x"), F.floor(F.col("id") / 8).cast("int").alias("y"))
    assert all(r.n == ranged.id_of_tile(3, r.x, r.y) for r in df.withColumn("n", ranged.tile_number(F.col("x"), F.col("y"), 3)).collect())


def test_archive_reads_only_what_is_asked(spark, tmp_path):
    tiles = {ranged.id_of_tile(5, x, y): fixtures.tile_of_points("l", [(x * 32 + y, f"{x}/{y}", 10, 20)]) for x in range(32) for y in range(32)}
    tiles |= {ranged.id_of_tile(2, x, y): b"sea" for x in range(4) for y in range(4)}
    raw = fixtures.archive_bytes(tiles, 16)
    (tmp_path / "a.pmtiles").write_bytes(raw)
    # the whole-archive reader agrees
    assert {(z, x, y) for z, x, y, _ in binary_tables.pmtiles_entries(raw)} == {binary_tables.tile_of_id(t) for t in tiles}
    every = ranged.archive_tiles(spark, str(tmp_path))
    assert every.count() == len(tiles) and every.rdd.getNumPartitions() > 32
    assert {gzip.decompress(r.tile) for r in every.where("z = 2").collect()} == {b"sea"} and every.where("z = 2").count() == 16
    some = every.where("z = 5 and x between 3 and 4 and y = 7")
    assert sorted((r.x, r.y) for r in some.collect()) == [(3, 7), (4, 7)]
    reader = ranged.TileReader({"path": str(tmp_path)})
    reader.pushFilters([EqualTo(("z",), 5), GreaterThanOrEqual(("x",), 3), LessThanOrEqual(("x",), 4), EqualTo(("y",), 7)])
    parts = reader.partitions()
    files = [ranged.Ranged(p.path) for p in parts]
    got = [t for p, f in zip(parts, files) for b in reader.read_from(p, f) for t in zip(*(b.column(c).to_pylist() for c in "zxy"))]
    assert sorted(got) == [(5, 3, 7), (5, 4, 7)] and len(parts) <= 2
    # counted: the head, at most two leaf directories and two tiles, of 1,040
    assert sum(f.read_bytes for f in files) < 2 * ranged.BLOCK + 2000 < len(raw) / 3
    assert ranged.archive_directory(spark, str(tmp_path)).agg(F.sum("run")).first()[0] == len(tiles)
    table = ranged.archive_table(spark, str(tmp_path), 5, "l", Extent(0.0, 0.0, 1e6, 1e6))
    assert 0 < table.count() <= 4 and set(table.columns) > {"minx", "geom_type", "layer"}
