"""Sources by name, memory tables and database scans."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.boxes import Extent
from ..functions.projection import MERCATOR
from ..plans import tokens
from ..plans.processor import SpatialTable
from ..plans.spec import MapSpec, SpatialQuery
from . import binary_tables, delimited, json_tables, ranged

_SOURCES: dict[str, Callable[[SparkSession, Mapping[str, str]], SpatialTable]] = {}


def register(name: str, make: Callable[[SparkSession, Mapping[str, str]], SpatialTable]) -> None:
    _SOURCES[name] = make


def names() -> list[str]:
    return sorted(_SOURCES)


def create(spark: SparkSession, parameters: Mapping[str, str]) -> SpatialTable:
    """A table from its parameters; type names the source."""
    if "type" not in parameters:
        raise ValueError("a source needs a type")
    if parameters["type"] not in _SOURCES:
        raise ValueError(f"no source {parameters['type']!r}; there are {', '.join(names())}")
    return _SOURCES[parameters["type"]](spark, parameters)


def tables_of(spark: SparkSession, spec: MapSpec) -> dict[str, SpatialTable]:
    """The tables of all layers that name a source."""
    out: dict[str, SpatialTable] = {}

    def walk(layers) -> None:
        for layer in layers:
            if layer.datasource:
                t = create(spark, layer.datasource)
                out[layer.name] = SpatialTable(t.df, layer.srs)
            walk(layer.layers)

    walk(spec.layers)
    return out


def _file(p: Mapping[str, str]) -> str | None:
    f = p.get("file")
    return None if f is None else f"{p['base'].rstrip('/')}/{f}" if p.get("base") else f


def _flag(p: Mapping[str, str], key: str) -> bool:
    return str(p.get(key, "false")).lower() in ("true", "yes", "1", "on")


def _delimited(spark, p):
    o = delimited.Options(p.get("separator"), p.get("quote"), p.get("headers"), _flag(p, "strict"), int(p.get("row_limit", 0)), p.get("encoding", "utf-8"))
    return delimited.read(spark, _file(p), p.get("inline"), o)


register("csv", _delimited)
register("geojson", lambda s, p: json_tables.geojson(s, _file(p), p.get("inline")))
register("topojson", lambda s, p: json_tables.topojson(s, _file(p), p.get("inline")))
register("geobuf", lambda s, p: binary_tables.geobuf(s, _file(p)))
register("shape", lambda s, p: binary_tables.shapefile(s, _file(p).removesuffix(".shp"), p.get("encoding", "utf-8"), int(p.get("row_limit", 0))))
# shapefiles with their .shx, read by ranges and, with an .index, by box: a folder, a stem or a list
register("shapes", lambda s, p: ranged.shapefiles(s, _file(p), p.get("encoding", "utf-8"), int(p.get("split_bytes", ranged.SPLIT_BYTES))))
register("sqlite", lambda s, p: binary_tables.sqlite(s, _file(p), p["table"], p.get("geometry_field", "geometry"), p.get("key_field"), p.get("wkb_format", "auto"), int(p.get("row_limit", 0)), int(p.get("row_offset", 0)), p.get("fields", "*")))
register("pmtiles", lambda s, p: SpatialTable(ranged.archive_table(s, _file(p), int(p["zoom"]), p.get("layer")), MERCATOR))
register("parquet", lambda s, p: SpatialTable(s.read.parquet(_file(p))))
register("view", lambda s, p: SpatialTable(s.table(p["table"])))


def memory(spark: SparkSession, features: Iterable[tuple[int, str, Mapping[str, object]]], schema: str) -> SpatialTable:
    """A table from (id, WKT, attributes); schema declares the attributes."""
    from ..functions import codecs as C
    from ..functions import shapes as S

    rows = []
    fields = [f.strip().split()[0] for f in schema.split(",") if f.strip()]
    for fid, wkt, own in features:
        g = C.from_wkt(wkt)
        e = S.envelope(g) or (None,) * 4
        rows.append((fid, bytearray(C.to_wkb(g)), *e, g.simple_kind, *(own.get(f) for f in fields)))
    ddl = "id long, geom binary, minx double, miny double, maxx double, maxy double, geom_type int" + (", " + schema if schema else "")
    return SpatialTable(spark.createDataFrame(rows, ddl))


def postgis_sql(table: str, q: SpatialQuery, geometry_field: str = "geom", key_field: str | None = None, srid: int = 4326, row_limit: int = 0, simplify: bool = False, clip: bool = False, simplify_dp_ratio: float = 1 / 20, simplify_snap_ratio: float = 1 / 40, intersect_min_scale: float = 0.0, intersect_max_scale: float = 0.0) -> str:
    """The SQL that a PostGIS table is read by: columns pruned, box pushed down, geometry reduced to the pixel size at the server."""
    e = q.extent
    env = f"ST_SetSRID('BOX3D({tokens.shown(e.minx)} {tokens.shown(e.miny)},{tokens.shown(e.maxx)} {tokens.shown(e.maxy)})'::box3d, {srid})"
    quoted = lambda n: '"' + n.replace('"', '""') + '"'
    geom = quoted(geometry_field)
    px = min(1 / q.resolution[0], 1 / q.resolution[1])
    if simplify:
        geom = f"ST_SnapToGrid({geom},{tokens.shown(px * simplify_snap_ratio)})"
        if clip:
            geom = f"ST_ClipByBox2D({geom},{env})"
        geom = f"ST_Simplify({geom},{tokens.shown(px * simplify_dp_ratio)})"
    columns = [f"ST_AsBinary({geom}) AS geom", *(quoted(n) for n in [key_field, *(q.names or ())] if n)]
    text = tokens.fill(table.replace("!bbox!", env), q)
    where = ""
    if "!bbox!" not in table:
        if intersect_max_scale > 0 and q.scale_denominator >= intersect_max_scale:
            where = ""
        elif intersect_min_scale > 0 and q.scale_denominator <= intersect_min_scale:
            where = f" WHERE ST_Intersects({quoted(geometry_field)},{env})"
        else:
            where = f" WHERE {quoted(geometry_field)} && {env}"
    return f"SELECT {','.join(columns)} FROM {text}{where}" + (f" LIMIT {row_limit}" if row_limit > 0 else "")


@dataclass(frozen=True)
class Overview:
    """A coarser copy of a raster table: where it is, and its pixels' size in the plane."""

    schema: str
    table: str
    column: str
    scale: float


def raster_table_sql(
    table: str, q: SpatialQuery, raster_field: str = "rast", schema: str = "public", key_field: str | None = None, srid: int = 4326, band: int = 0, prescale: bool = False, clip: bool = False, overviews: Iterable[Overview] = (), row_limit: int = 0,
) -> str:
    """The SQL that a table of raster tiles is read by: the coarsest copy that is still finer than a pixel, and tiles clipped
    to the box, resized to the pixels and cut to one band at the server. Its binary column is read by binary_tables.raster_pixels()."""
    quoted = lambda n: '"' + n.replace('"', '""') + '"'
    px = min(1 / q.resolution[0], 1 / q.resolution[1])
    column, text = raster_field, table
    copies = sorted(overviews, key=lambda o: o.scale)
    if copies:
        # without one that is fine enough the finest copy is taken
        best = max((o for o in copies if o.scale < px), key=lambda o: o.scale, default=copies[0])
        name = tokens.table_from_sql(table)
        bare = name.rsplit(".", 1)[-1].strip('"')
        for old, new in ((bare, best.table), (schema, best.schema), (raster_field, best.column)):
            text = text.replace(old, new) if old else text
        column = best.column
    e, own = q.extent, quoted(column)
    env = f"ST_SetSRID('BOX3D({tokens.shown(e.minx)} {tokens.shown(e.miny)},{tokens.shown(e.maxx)} {tokens.shown(e.maxy)})'::box3d, {srid})"
    value = own
    if clip:
        value = f"ST_Clip({value}, ST_Expand({env}, greatest(abs(ST_ScaleX({own})), abs(ST_ScaleY({own})))))"
    if prescale:
        share = lambda axis: f"least(1.0, abs(ST_Scale{axis}({own}))::float8/{tokens.shown(px)})"
        value = f"ST_Resize({value}, {share('X')}, {share('Y')})"
    if band:
        value = f"ST_Band({value}, {band})"
    names = [n for n in [key_field, *(q.names or ())] if n]
    where = "" if "!bbox!" in text else f" WHERE {own} && {env}"
    columns = ",".join([f"ST_AsBinary({value}) AS geom", *map(quoted, dict.fromkeys(names))])
    return f"SELECT {columns} FROM {tokens.fill(text.replace('!bbox!', env), q)}{where}" + (f" LIMIT {row_limit}" if row_limit > 0 else "")


def raster_table(spark: SparkSession, url: str, table: str, q: SpatialQuery, band: int = 1, properties: Mapping[str, str] | None = None, **more) -> DataFrame:
    """Pixels of the tiles that raster_table_sql() reads through JDBC (the driver's jar must be there)."""
    df = spark.read.format("jdbc").options(url=url, query=raster_table_sql(table, q, **more), **(properties or {})).load()
    key = more.get("key_field")
    rows = df.select((F.col(key) if key else F.monotonically_increasing_id()).alias("id"), F.col("geom").alias("raster"))
    return binary_tables.raster_pixels(rows, band=band)


def postgis(spark: SparkSession, url: str, table: str, q: SpatialQuery, fetch_size: int = 10_000, properties: Mapping[str, str] | None = None, **more) -> DataFrame:
    """The rows of postgis_sql() through JDBC (the driver's jar must be there), with boxes."""
    df = spark.read.format("jdbc").options(url=url, query=postgis_sql(table, q, **more), fetchsize=str(fetch_size), **(properties or {})).load()
    e = G.envelope("geom")
    return df.withColumn("_e", e).select(*df.columns, *[F.col(f"_e.{c}").alias(c) for c in ("minx", "miny", "maxx", "maxy")])


def extent_sql(table: str, geometry_field: str = "geom", estimate: bool = False) -> str:
    name = tokens.table_from_sql(table)
    if estimate:
        return f"SELECT ST_XMin(ext),ST_YMin(ext),ST_XMax(ext),ST_YMax(ext) FROM (SELECT ST_EstimatedExtent('{name}','{geometry_field}') AS ext) AS tmp"
    return f"SELECT ST_XMin(ext),ST_YMin(ext),ST_XMax(ext),ST_YMax(ext) FROM (SELECT ST_Extent({geometry_field}) AS ext FROM {name}) AS tmp"


#: Attribute types by the database's type numbers.
POSTGRES_TYPES = {16: "boolean", 20: "bigint", 21: "bigint", 23: "bigint", 700: "double", 701: "double", 1700: "double", 25: "string", 705: "string", 1042: "string", 1043: "string"}


def declared_extent(text: str | None) -> Extent | None:
    return Extent.parse(text) if text else None
