"""Queries over files that tasks write, one for each partition of a table, and that are read back by ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, projection
from ..functions.boxes import Extent
from ..sources import binary_tables, ranged, registry, scratch
from . import fixtures
from .catalog import _C, _MERC, _PX, customers, pixels, query
from .spec import SpatialQuery

#: Level of the tiles that archives hold.
ZOOM = 4


def _written(df: DataFrame, write) -> str:
    """Let each task write its rows with write(rows, path stem); returns the folder."""
    folder = scratch.folder(df.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        rows = pd.concat(list(frames) or [pd.DataFrame()])
        if len(rows):
            write(rows, f"{folder}/part{TaskContext.get().partitionId():05d}")
        yield pd.DataFrame({"n": [int(len(rows) > 0)]})

    df.mapInPandas(run, "n long").agg(F.sum("n")).first()
    return folder


def _lines(rows: pd.DataFrame, stem: str) -> None:
    found = [(int(k), str(n), float(x), float(y)) for k, n, x, y in zip(rows["c_custkey"], rows["c_name"], rows["x"], rows["y"])]
    for ending, data in zip((".shp", ".shx", ".dbf"), fixtures.line_files(found)):
        ranged.Ranged(stem + ending).write(data)


def line_folder(spark: SparkSession, sf: str) -> str:
    """A folder of shapefiles with a line for each customer, a file for each of the tasks, indexed."""
    folder = _written(customers(spark, sf).select("c_custkey", "c_name", "x", "y").repartition(4, "c_custkey"), _lines)
    ranged.write_indexes(spark, folder).count()
    return folder


@query(f"SELECT c_custkey::BIGINT AS key, c_name AS name, round(c_custkey / 8e0, 3) AS share, x AS minx, y + 2 AS maxy, 2::INTEGER AS geom_type FROM {_C}")
def source_shape_files(spark, sf):
    """Every record of many files, each cut into ranges of bytes."""
    df = ranged.shapefiles(spark, line_folder(spark, sf), split_bytes=4096).df
    return df.select(F.col("KEY").alias("key"), F.col("NAME").alias("name"), F.round("SHARE", 3).alias("share"), "minx", "maxy", "geom_type")


@query(f"SELECT c_custkey::BIGINT AS key, x AS minx, y AS miny FROM {_C} WHERE x <= 90 AND x + 1 >= -80 AND y <= 50 AND y + 2 >= -40")
def source_shape_box(spark, sf):
    """The records that an index finds for a box."""
    found = ranged.shapefiles(spark, line_folder(spark, sf)).query(SpatialQuery(Extent(-80.0, -40.0, 90.0, 50.0), names=("KEY",)))
    return found.select(F.col("KEY").alias("key"), "minx", "miny")


def _addressed(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with their mercator tile and their place in it."""
    df = customers(spark, sf)
    mx, my = projection.to_mercator(F.col("x"), F.col("y"))
    tx, ty = projection.tile_of(mx, my, ZOOM)
    size = projection.CIRCUMFERENCE / (1 << ZOOM)
    px = F.floor((mx + projection.CIRCUMFERENCE / 2 - tx * size) / size * 4096).cast("int")
    py = F.floor((F.lit(projection.CIRCUMFERENCE / 2) - my - ty * size) / size * 4096).cast("int")
    return df.select("c_custkey", "c_name", tx.alias("tx"), ty.alias("ty"), px.alias("px"), py.alias("py"))


def _archive(rows: pd.DataFrame, stem: str) -> None:
    own = {ranged.id_of_tile(ZOOM, int(x), int(y)): fixtures.tile_of_points("places", list(zip(g["c_custkey"].astype(int), g["c_name"], g["px"].astype(int), g["py"].astype(int)))) for (x, y), g in rows.groupby(["tx", "ty"])}
    ranged.Ranged(f"{stem}.pmtiles").write(fixtures.archive_bytes(own))


def archive_folder(spark: SparkSession, sf: str) -> str:
    """A folder of tile archives with leaf directories; a tile lies in one archive."""
    return _written(_addressed(spark, sf).repartition(4, "tx", "ty"), _archive)


_TILES = f"(SELECT *, least(greatest(trunc((mx + 20037508.342789244e0) * 16e0 / 40075016.68557849e0)::INTEGER, 0), 15) AS tx, least(greatest(trunc((20037508.342789244e0 - my) * 16e0 / 40075016.68557849e0)::INTEGER, 0), 15) AS ty FROM (SELECT *, {_MERC} FROM {_C}))"


@query(f"SELECT c_custkey::BIGINT AS id, c_name AS name, tx, ty FROM {_TILES} WHERE tx BETWEEN 3 AND 9 AND ty BETWEEN 2 AND 11")
def source_tile_ranges(spark, sf):
    """Features of the tiles within columns and rows: only their directories and bytes are read."""
    wanted = ranged.archive_tiles(spark, archive_folder(spark, sf)).where(f"z = {ZOOM} and x between 3 and 9 and y between 2 and 11")
    return ranged.tile_features(wanted, "places").select("id", F.get_json_object(F.concat(F.lit("{\"v\":"), F.col("props")["name"], F.lit("}")), "$.v").alias("name"), "tx", "ty")


@query(f"SELECT tx AS x, ty AS y, count(*) AS customers, 1::BIGINT AS entries FROM {_TILES} GROUP BY tx, ty")
def source_tile_directory(spark, sf):
    """The directories as a table, without reading a tile, joined with the customers of each tile by its number."""
    found = ranged.archive_directory(spark, archive_folder(spark, sf))
    each = found.select(F.explode(F.expr("sequence(tile_id, tile_id + run - 1)")).alias("tile_id")).groupBy("tile_id").agg(F.count("*").alias("entries"))
    number = ranged.tile_number(F.col("tx"), F.col("ty"), ZOOM)
    counted = _addressed(spark, sf).groupBy("tx", "ty").agg(F.count("*").alias("customers")).withColumn("tile_id", number)
    return counted.join(each, "tile_id").select(F.col("tx").alias("x"), F.col("ty").alias("y"), "customers", "entries")


def _places(rows: pd.DataFrame) -> list[fixtures.Row]:
    return [(int(k), str(n), float(x), float(y)) for k, n, x, y in zip(rows["c_custkey"], rows["c_name"], rows["x"], rows["y"])]


def _files(spark: SparkSession, sf: str, ending: str, encode) -> str:
    """A folder of files that four tasks write, each with its part of the customers."""

    def write(rows: pd.DataFrame, stem: str) -> None:
        ranged.Ranged(stem + ending).write(encode(_places(rows)))

    return _written(customers(spark, sf).select("c_custkey", "c_name", "x", "y").repartition(4, "c_custkey"), write)


@query(f"SELECT c_custkey::BIGINT AS key, c_name AS name, x AS minx, y AS miny, x + 1 AS maxx, y + 2 AS maxy, 2 AS geom_type FROM {_C}")
def source_geojson_files(spark, sf):
    folder = _files(spark, sf, ".geojson", lambda rows: fixtures.geojson_text(rows).encode())
    return registry.create(spark, {"type": "geojson", "file": folder}).df.select("key", "name", "minx", "miny", "maxx", "maxy", "geom_type")


@query(f"SELECT c_custkey::BIGINT AS key, c_name AS name, 'LINESTRING(' || x::INTEGER || ' ' || y::INTEGER || ',' || (x + 1)::INTEGER || ' ' || (y + 1)::INTEGER || ',' || (x + 3)::INTEGER || ' ' || (y + 1)::INTEGER || ')' AS wkt FROM {_C}")
def source_topojson_files(spark, sf):
    folder = _files(spark, sf, ".topojson", lambda rows: fixtures.topojson_text(rows).encode())
    return registry.create(spark, {"type": "topojson", "file": folder}).df.select("key", "name", geometry.to_wkt("geom").alias("wkt"))


@query(f"SELECT c_custkey::BIGINT AS key, c_name AS name, x, y FROM {_C}")
def source_geobuf_files(spark, sf):
    folder = _files(spark, sf, ".pbf", fixtures.geobuf_bytes)
    return registry.create(spark, {"type": "geobuf", "file": folder}).df.select("key", "name", F.col("minx").alias("x"), F.col("maxy").alias("y"))


@query(f"SELECT c_name AS name, c_custkey / 4e0 AS share, x, y FROM {_C}")
def source_sqlite_files(spark, sf):
    folder = _files(spark, sf, ".sqlite", fixtures.sqlite_bytes)
    return registry.create(spark, {"type": "sqlite", "file": folder, "table": "places", "key_field": "id"}).df.select("name", "share", F.col("minx").alias("x"), F.col("maxy").alias("y"))


@query(f"SELECT c_custkey::BIGINT AS id, c_name AS name, tx, ty FROM {_TILES} WHERE tx BETWEEN 2 AND 12 AND ty BETWEEN 0 AND 9")
def source_mbtiles_files(spark, sf):
    def write(rows: pd.DataFrame, stem: str) -> None:
        own = {(int(x), int(y)): fixtures.tile_of_points("places", list(zip(g["c_custkey"].astype(int), g["c_name"], g["px"].astype(int), g["py"].astype(int)))) for (x, y), g in rows.groupby(["tx", "ty"])}
        ranged.Ranged(f"{stem}.mbtiles").write(fixtures.mbtiles_of(ZOOM, own))

    folder = _written(_addressed(spark, sf).repartition(4, "tx", "ty"), write)
    found = binary_tables.tiles(spark, folder, ZOOM, (2, 12, 0, 9))
    return found.select("id", F.get_json_object(F.concat(F.lit("{\"v\":"), F.col("props")["name"], F.lit("}")), "$.v").alias("name"), "tx", "ty")


@query(f"SELECT (x // 8 + y // 8 * 8)::BIGINT AS id, (x % 8)::INTEGER AS x, (y % 8)::INTEGER AS y, CASE WHEN value <> 7 THEN value END AS value FROM {_PX}")
def source_raster_blobs(spark, sf):
    """A raster cut into 64 blobs of 8 by 8 pixels, one for each group of a table, and decoded in parallel. Values of 7 are missing, as are pixels that the table lacks."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        a = np.full((8, 8), 7)
        a[frame["y"] % 8, frame["x"] % 8] = frame["value"]
        return pd.DataFrame({"id": [int(frame["x"].iloc[0] // 8 + frame["y"].iloc[0] // 8 * 8)], "raster": [fixtures.raster_blob(a, 7)]})

    px = pixels(spark, sf)
    blobs = px.groupBy(F.floor(F.col("x") / 8), F.floor(F.col("y") / 8)).applyInPandas(pack, "id long, raster binary")
    # the blobs are full squares: pixels that the table lacks are told apart by it
    there = px.select((F.floor(F.col("x") / 8) + F.floor(F.col("y") / 8) * 8).cast("long").alias("id"), (F.col("x") % 8).alias("x"), (F.col("y") % 8).alias("y"))
    return binary_tables.raster_pixels(blobs).join(there, ["id", "x", "y"])
