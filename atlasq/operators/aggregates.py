"""Aggregates of spatial tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G


def extent(df: DataFrame, *by: str, prefix: str = "") -> DataFrame:
    return df.groupBy(*by).agg(*[(F.min if c.startswith("min") else F.max)(prefix + c).alias(c) for c in ("minx", "miny", "maxx", "maxy")])


def geometry_kind(df: DataFrame, column: str = "geom_type", sample: int = 5, order: str = "id") -> DataFrame:
    """The kind of the first rows: 4 (collection) where they differ, 0 where there is none."""
    return df.orderBy(order).limit(sample).agg(F.when(F.count_distinct(column) > 1, F.lit(4)).otherwise(F.coalesce(F.max(column), F.lit(0))).cast("int").alias("geom_type"))


def attribute_names(df: DataFrame, column: str, sample: int = 5, order: str = "id") -> DataFrame:
    """Names of a map column's keys over the first rows, sorted."""
    return df.orderBy(order).limit(sample).select(F.explode(F.map_keys(column)).alias("name")).distinct().orderBy("name")


def descriptor(df: DataFrame) -> list[tuple[str, str, bool]]:
    """Name, type and whether it is the key, for each attribute: what a source advertises."""
    kinds = {T.LongType: "Integer", T.IntegerType: "Integer", T.ShortType: "Integer", T.ByteType: "Integer", T.FloatType: "Float", T.DoubleType: "Double", T.DecimalType: "Double", T.BooleanType: "Boolean", T.StringType: "String"}
    return [(f.name, "Geometry" if f.name == "geom" else kinds.get(type(f.dataType), "Object"), f.name == "id") for f in df.schema.fields if f.name not in ("minx", "miny", "maxx", "maxy")]


def any_match(condition: Column, name: str = "painted") -> Column:
    return F.coalesce(F.bool_or(condition), F.lit(False)).alias(name)


def differing_pixels(a: DataFrame, b: DataFrame, threshold: float = 0.0, by: tuple[str, ...] = ("x", "y"), value: str = "value") -> DataFrame:
    """Pixels whose values differ by more than the threshold; a pixel that one image lacks differs."""
    other = b.select(*by, F.col(value).alias("_other"))
    both = a.select(*by, F.col(value).alias("_own")).join(other, list(by), "full_outer")
    return both.agg(F.count_if(F.coalesce(F.abs(F.col("_own") - F.col("_other")) > threshold, F.lit(True))).alias("n_different"))


def is_solid(df: DataFrame, value: str = "value") -> DataFrame:
    return df.agg((F.coalesce(F.min(value) == F.max(value), F.lit(True)) & (F.count_if(F.col(value).isNull()) == 0)).alias("solid"))


def lengths(df: DataFrame, points: str = "pts") -> DataFrame:
    return df.withColumn("length", G.points_length(F.col(points)))
