"""Symbolizer properties row by row: constants, defaults and expressions as columns of their kinds."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expression as X
from ..operators import raster
from .spec import ENUMERATIONS, Symbolizer

#: Kind and default of each property; without a default a property is null where it isn't given.
PROPERTIES: dict[str, tuple[str, Any]] = {
    "gamma": ("double", 1.0), "gamma-method": ("enum", "power"), "opacity": ("double", 1.0), "alignment": ("enum", "global"), "offset": ("double", 0.0), "comp-op": ("enum", "src-over"), "clip": ("bool", False),
    "fill": ("color", (128, 128, 128, 255)), "fill-opacity": ("double", 1.0), "stroke": ("color", (0, 0, 0, 255)), "stroke-width": ("double", 1.0), "stroke-opacity": ("double", 1.0),
    "stroke-linejoin": ("enum", "miter"), "stroke-linecap": ("enum", "butt"), "stroke-gamma": ("double", 1.0), "stroke-gamma-method": ("enum", "power"), "stroke-dashoffset": ("double", 0.0), "stroke-dasharray": ("dash", None), "stroke-miterlimit": ("double", 4.0),
    "geometry-transform": ("transform", None), "line-rasterizer": ("enum", "full"), "transform": ("transform", None), "spacing": ("double", 100.0), "spacing-offset": ("double", None), "max-error": ("double", 0.2),
    "allow-overlap": ("bool", False), "ignore-placement": ("bool", False), "width": ("double", 0.0), "height": ("double", 0.0), "file": ("path", ""), "shield-dx": ("double", 0.0), "shield-dy": ("double", 0.0), "unlock-image": ("bool", False),
    "scaling": ("enum", "near"), "filter-factor": ("double", 1.0), "mesh-size": ("double", 0.0), "premultiplied": ("bool", False), "smooth": ("double", 0.0), "smooth-algorithm": ("enum", "basic"), "simplify-algorithm": ("enum", "radial-distance"), "simplify": ("double", 0.0),
    "halo-rasterizer": ("enum", "full"), "halo-transform": ("transform", None), "multi-policy": ("enum", "each"), "direction": ("enum", "right"), "avoid-edges": ("bool", False), "line-pattern": ("enum", "warp"), "extend": ("double", 0.0),
    "largest-box-only": ("bool", False), "minimum-path-length": ("double", 0.0), "repeat-key": ("string", None), "name": ("string", None), "size": ("double", 10.0), "character-spacing": ("double", 0.0), "line-spacing": ("double", 0.0), "halo-radius": ("double", 0.0), "halo-fill": ("color", (255, 255, 255, 255)),
}
TRANSFORM = ("a", "b", "c", "d", "e", "f")


def color(value: tuple[int, int, int, int]) -> Column:
    return F.struct(*[F.lit(int(v)).alias(c) for v, c in zip(value, "rgba")])


def color_of(text: Column, default: tuple[int, int, int, int]) -> Column:
    """A colour from a text column: names, and # with three, four, six or eight hexadecimal digits; anything else is the default."""
    t = F.lower(F.trim(text))
    digits = F.when(F.length(t) <= 5, F.regexp_replace(t, "([0-9a-f])", "$1$1")).otherwise(t)
    byte = lambda i: F.conv(F.substring(digits, i, 2), 16, 10).cast("int")
    alpha = F.when(F.length(digits) == 9, byte(8)).otherwise(255)
    by_hex = F.struct(byte(2).alias("r"), byte(4).alias("g"), byte(6).alias("b"), alpha.alias("a"))
    names = F.create_map(*[x for n, v in raster.NAMED.items() for x in (F.lit(n), color(v))])
    return F.when(t.rlike("^#([0-9a-f]{3,4}|[0-9a-f]{6}|[0-9a-f]{8})$"), by_hex).otherwise(F.coalesce(F.try_element_at(names, t), color(default)))


def dashes(text: str) -> list[tuple[float, float]]:
    """Dash and gap lengths in pairs; an odd list is followed by itself, as every second length is a gap."""
    lengths = [float(x) for x in text.replace(",", " ").split()]
    if any(x < 0 for x in lengths):
        raise ValueError(f"a dash can't be negative: {text!r}")
    if len(lengths) % 2:
        lengths *= 2
    return list(zip(lengths[::2], lengths[1::2]))


def _constant(kind: str, value: Any) -> Column | None:
    """A value that is the same for all rows; none if it is an expression."""
    if kind == "color" and not isinstance(value, str):
        return color(value)
    if isinstance(value, str):
        if kind == "color":
            try:
                return color(raster.parse_color(value))
            except ValueError:
                return None
        if kind == "dash":
            return F.array(*[F.struct(F.lit(a).alias("dash"), F.lit(b).alias("gap")) for a, b in dashes(value)])
        if kind == "bool" and value.strip().lower() in ("true", "yes", "on", "1", "false", "no", "off", "0"):
            return F.lit(value.strip().lower() in ("true", "yes", "on", "1"))
        if kind == "double":
            try:
                return F.lit(float(value))
            except ValueError:
                return None
        return None
    return F.lit(bool(value)) if kind == "bool" else F.lit(float(value)) if kind == "double" else F.lit(value)


def property_column(symbolizer: Symbolizer, key: str, df: DataFrame, variables: Mapping[str, Any] | None = None) -> Column:
    """The value of a property for each row of df.

    A constant is a literal; an expression is evaluated on the row, and where it gives nothing of
    the property's kind the default stands, as it does where the property isn't given. Names of choices may be
    expressions, of which only allowed names count.
    """
    kind, default = PROPERTIES[key]
    value = symbolizer.properties.get(key)
    variables = variables or {}
    types = {"double": "double", "bool": "boolean", "string": "string", "enum": "string", "path": "string"}
    if kind == "transform":
        columns = [F.lit(v) for v in (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)] if value is None else X.transform_columns(str(value), df)
        return F.struct(*[c.cast("double").alias(n) for c, n in zip(columns, TRANSFORM)])
    fallback = color(default) if kind == "color" else F.lit(None).cast("array<struct<dash:double,gap:double>>") if kind == "dash" else F.lit(default).cast(types[kind])
    if value is None:
        return fallback
    if kind == "path":
        return X.path_column(str(value), df)
    constant = _constant(kind, value)
    if constant is not None:
        return constant
    if kind == "enum":
        allowed = ENUMERATIONS.get(f"{key}:{symbolizer.kind}") or ENUMERATIONS.get(key)
        if not value.startswith("["):
            return F.lit(value)
        found = X.column(value, df, variables).cast("string")
        return F.when(found.isin(*allowed), found).otherwise(fallback) if allowed else F.coalesce(found, fallback)
    found = X.column(str(value), df, variables)
    if kind == "color":
        return color_of(found.cast("string"), default)
    if kind == "string":
        return found.cast("string")
    return F.coalesce(found.cast("string").try_cast(types[kind]), fallback)


def with_properties(df: DataFrame, symbolizer: Symbolizer, keys: list[str], variables: Mapping[str, Any] | None = None) -> DataFrame:
    """df with a column for each property, - in its name being _."""
    return df.withColumns({k.replace("-", "_"): property_column(symbolizer, k, df, variables) for k in keys})
