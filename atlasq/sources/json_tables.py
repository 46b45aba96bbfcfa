"""GeoJSON and TopoJSON."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codecs as C
from ..functions import geometry as G
from ..operators.ordering import numbered
from ..plans.processor import SpatialTable
from . import scratch


def _texts(spark: SparkSession, path: str | None, inline: str | None) -> DataFrame:
    if (path is None) == (inline is None):
        raise ValueError("give a path or an inline text")
    return spark.createDataFrame([(inline,)], "value string") if inline is not None else spark.read.text(path, wholetext=True)


def place(row: int, i: int) -> int:
    """A key that orders a file's features and the files: row is a monotonically increasing id."""
    row = int(row)
    return ((row >> 33) * 1024 + (row & (1 << 33) - 1) << 31) + i


def _kind(x: object) -> T.DataType:
    if isinstance(x, bool):
        return T.BooleanType()
    return T.LongType() if isinstance(x, int) else T.DoubleType() if isinstance(x, float) else T.StringType()


def _value(text: str) -> object:
    try:
        return json.loads(text)
    except ValueError:
        return text


def _finish(rows: DataFrame) -> SpatialTable:
    """From _n, geom, props (map of JSON texts) to a table, decoded once.

    Columns are all properties of any feature, in name order; a column's type is that of its first value in file order.
    """
    rows = scratch.written(rows)
    each = rows.select("_n", F.explode("props").alias("k", "v"))
    # as many rows as properties
    told = each.groupBy("k").agg(F.min_by("v", F.when(F.col("v") != "null", F.col("_n"))).alias("v")).collect()
    kinds = {r["k"]: T.StringType() if r["v"] is None else _kind(_value(r["v"])) for r in told}
    e = G.envelope("geom")
    out = numbered(rows, [("_n", True)], "id").withColumn("_e", e)
    columns = []
    for k in sorted(kinds):
        raw = F.col("props")[k]
        text = F.when(raw.startswith('"'), F.from_json(F.concat(F.lit('{"v":'), raw, F.lit("}")), "v string")["v"]).otherwise(F.when(raw != "null", raw))
        columns.append((text if isinstance(kinds[k], T.StringType) else text.try_cast(kinds[k])).alias(k))
    return SpatialTable(out.select("id", "geom", *[F.col(f"_e.{c}").alias(c) for c in ("minx", "miny", "maxx", "maxy")], G.simple_kind(G.wkb_kind(F.col("geom"))).alias("geom_type"), *columns))


def geojson(spark: SparkSession, path: str | None = None, inline: str | None = None) -> SpatialTable:
    """A FeatureCollection, a Feature or a bare geometry; ids from 1 in file order. Nested values stay JSON text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for n, text in zip(frame["_n"], frame["value"]):
                d = json.loads(text)
                if not isinstance(d, dict) or "type" not in d:
                    raise ValueError("not GeoJSON")
                features = d["features"] if d["type"] == "FeatureCollection" else [d if d["type"] == "Feature" else {"geometry": d, "properties": {}}]
                out = []
                for i, f in enumerate(features):
                    geom = C.to_wkb(C.from_geojson(f["geometry"])) if f.get("geometry") else None
                    props = {k: json.dumps(v, ensure_ascii=False, separators=(",", ":")) for k, v in (f.get("properties") or {}).items()}
                    out.append((place(n, i), geom, props))
                if out:
                    yield pd.DataFrame(out, columns=["_n", "geom", "props"])

    texts = _texts(spark, path, inline).withColumn("_n", F.monotonically_increasing_id())
    rows = texts.mapInPandas(run, "_n long, geom binary, props map<string,string>").where("geom is not null")
    return _finish(rows)


def bounding_boxes(features: DataFrame, column: str = "value") -> DataFrame:
    """Boxes of features given as JSON lines, by expressions: all numbers pairs of their coordinates, no feature built."""
    pairs = F.regexp_extract_all(F.get_json_object(column, "$.geometry.coordinates"), F.lit(r"\[\s*(-?[0-9.eE+-]+)\s*,\s*-?[0-9.eE+-]+"), F.lit(1))
    ys = F.regexp_extract_all(F.get_json_object(column, "$.geometry.coordinates"), F.lit(r"\[\s*-?[0-9.eE+-]+\s*,\s*(-?[0-9.eE+-]+)"), F.lit(1))
    d = lambda c: F.transform(c, lambda x: x.cast("double"))
    return features.withColumns({"minx": F.array_min(d(pairs)), "miny": F.array_min(d(ys)), "maxx": F.array_max(d(pairs)), "maxy": F.array_max(d(ys))})


def to_geojson_lines(table: SpatialTable, properties: list[str] | None = None) -> DataFrame:
    """Features as one JSON text each."""
    core = {"id", "geom", "minx", "miny", "maxx", "maxy", "geom_type"}
    names = properties if properties is not None else [c for c in table.df.columns if c not in core]
    props = F.to_json(F.struct(*names), {"ignoreNullFields": "false"}) if names else F.lit("{}")
    return table.df.select(F.concat(F.lit('{"type":"Feature","id":'), F.col("id").cast("string"), F.lit(',"geometry":'), F.coalesce(G.to_geojson("geom"), F.lit("null")), F.lit(',"properties":'), props, F.lit("}")).alias("value"))


def topo_features(d: dict) -> list[tuple[C.Geometry, dict]]:
    """Features of a topology: arcs are running sums of quantised steps, reversed for negative indexes, joined at their ends."""
    scale, move = d.get("transform", {}).get("scale"), d.get("transform", {}).get("translate")
    arcs = []
    for a in d["arcs"]:
        p = np.array([q[:2] for q in a], float).reshape(-1, 2)
        if scale:
            p = np.cumsum(p, axis=0) * scale + move
        arcs.append(p)

    def line(indexes: list[int]) -> np.ndarray:
        out: list[np.ndarray] = []
        for k, i in enumerate(indexes):
            p = arcs[i] if i >= 0 else arcs[~i][::-1]
            out.append(p[1:] if k else p)
        return np.concatenate(out) if out else C.points([])

    def point(c: list) -> list[float]:
        return [c[0] * scale[0] + move[0], c[1] * scale[1] + move[1]] if scale else c[:2]

    def shape(o: dict) -> C.Geometry | None:
        t = o.get("type")
        if t == "Point":
            return C.Geometry(t, C.points([point(o["coordinates"])]))
        if t == "MultiPoint":
            return C.Geometry(t, C.points([point(c) for c in o["coordinates"]]))
        if t == "LineString":
            return C.Geometry(t, line(o["arcs"]))
        if t in ("MultiLineString", "Polygon"):
            return C.Geometry(t, [line(a) for a in o["arcs"]])
        if t == "MultiPolygon":
            return C.Geometry(t, [[line(a) for a in p] for p in o["arcs"]])
        if t == "GeometryCollection":
            return C.Geometry(t, [g for x in o["geometries"] if (g := shape(x))])
        return None

    out = []
    for o in d["objects"].values():
        for x in o["geometries"] if o.get("type") == "GeometryCollection" else [o]:
            g = shape(x)
            if g is not None:
                out.append((g, x.get("properties") or {}))
    return out


def topojson(spark: SparkSession, path: str | None = None, inline: str | None = None) -> SpatialTable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for n, text in zip(frame["_n"], frame["value"]):
                rows = [(place(n, i), C.to_wkb(g), {k: json.dumps(v, ensure_ascii=False, separators=(",", ":")) for k, v in p.items()}) for i, (g, p) in enumerate(topo_features(json.loads(text)))]
                if rows:
                    yield pd.DataFrame(rows, columns=["_n", "geom", "props"])

    texts = _texts(spark, path, inline).withColumn("_n", F.monotonically_increasing_id())
    return _finish(texts.mapInPandas(run, "_n long, geom binary, props map<string,string>"))
