"""From a map to DataFrames: extents, scans, rule routing, point queries."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expression as X
from ..functions.boxes import Box, Extent
from ..functions.projection import LONLAT, View, known, project_extent, project_point, scale_denominator
from ..operators import ordering
from ..operators.ordering import group_runs, sort_by
from .spec import Layer, MapSpec, Rule, SpatialQuery, Style, needed_columns

#: Columns that each spatial table has beside its attributes.
CORE = ("id", "geom", "minx", "miny", "maxx", "maxy", "geom_type")


@dataclass(frozen=True)
class SpatialTable:
    """A DataFrame with id and the flat box columns (geom, geom_type where it has geometry)."""

    df: DataFrame
    srs: str = LONLAT

    def query(self, q: SpatialQuery) -> DataFrame:
        """Rows whose box meets the query's, with the core columns and the asked ones; a missing name is an error."""
        keep = [c for c in CORE if c in self.df.columns]
        asked = [n for n in (self.df.columns if q.names is None else q.names) if n not in keep]
        missing = [n for n in asked if n not in self.df.columns]
        if missing:
            raise KeyError(f"no columns {missing}; there are {self.df.columns}")
        return self.df.where(Box.columns().intersects(q.extent)).select(*keep, *[F.col(f"`{n}`") for n in asked])

    def at_point(self, x: float, y: float, tolerance: float = 0.0) -> DataFrame:
        """Rows whose box meets the point's padded one."""
        return self.df.where(Box.columns().intersects(Extent(x, y, x, y).pad(tolerance)))

    def extent(self) -> DataFrame:
        return self.df.agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))


def matched_rules(df: DataFrame, rules: list[Rule], mode: str = "all", variables: Mapping[str, object] | None = None) -> Column:
    """The positions of the rules that apply to a row, in order.

    `if` rules that hold come first; then the `else` rules if none held; then the `also` rules if one
    did. In mode first only the first `if` rule that holds counts and `also` rules never do.
    """
    ifs = [(i, X.predicate(r.filter, df, variables)) for i, r in enumerate(rules) if r.kind == "if"]
    ifs = [(i, F.coalesce(c, F.lit(False))) for i, c in ifs]
    none = F.array().cast("array<int>")
    fixed = lambda kind: F.array(*[F.lit(i) for i, r in enumerate(rules) if r.kind == kind]).cast("array<int>")
    if mode == "first":
        first = F.coalesce(*[F.when(c, F.lit(i)) for i, c in ifs]) if ifs else F.lit(None).cast("int")
        return F.when(first.isNotNull(), F.array(first)).otherwise(fixed("else"))
    held = F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, c in ifs])) if ifs else none
    return F.when(F.size(held) > 0, F.concat(held, fixed("also"))).otherwise(fixed("else"))


def route(df: DataFrame, style: Style, denominator: float, variables: Mapping[str, object] | None = None) -> DataFrame:
    """One row for each row of df and rule that applies: rule_no, rule_name. One scan, whatever the number of rules."""
    rules = style.active_rules(denominator)
    if not rules:
        return df.where("false").withColumns({"rule_no": F.lit(0), "rule_name": F.lit("")})
    names = F.array(*[F.lit(r.name) for r in rules])
    if style.filter_mode == "first" and not any(r.kind == "else" for r in rules[:-1]):
        # at most one rule: no row is multiplied
        one = matched_rules(df, rules, "first", variables)
        return df.withColumn("rule_no", F.get(one, F.lit(0))).where("rule_no is not null").withColumn("rule_name", F.get(names, F.col("rule_no")))
    return df.withColumn("rule_no", F.explode(matched_rules(df, rules, style.filter_mode, variables))).withColumn("rule_name", F.get(names, F.col("rule_no")))


def layer_query(spec: MapSpec, layer: Layer, view: View, denominator: float) -> SpatialQuery | None:
    """The query of a layer, or None where nothing of it can show."""
    if not layer.visible(denominator):
        return None
    styles = [s for s in map(spec.style, layer.styles) if s and s.active_rules(denominator)]
    if not styles:
        return None
    scale = view.extent.width / view.width
    pad = scale * (spec.buffer_size if layer.buffer_size is None else layer.buffer_size)
    buffered = view.extent.pad(pad)
    if spec.maximum_extent:
        buffered = buffered.clip(spec.maximum_extent)
    if not buffered.valid:
        return None
    box = project_extent(buffered, spec.srs, layer.srs)
    plain = project_extent(view.extent, spec.srs, layer.srs)
    if layer.maximum_extent:
        if not box.intersects(layer.maximum_extent):
            return None
    names = set().union(*(needed_columns(s.active_rules(denominator), (layer.group_by, layer.sort_by.split(" ")[0])) for s in styles)) - {"geom_type"}
    return SpatialQuery(box, (view.width / plain.width, view.height / plain.height), denominator, tuple(sorted(names)), plain, 1.0, spec.variables)


def run_map(spec: MapSpec, tables: Mapping[str, SpatialTable], processor: Callable[[DataFrame, Layer, Style], DataFrame] | None = None) -> DataFrame:
    """All rows that a map draws, with what orders them: layer_no, style_no, feature_no, rule_no.

    tables has a table for each layer name. Layers and rules outside the scale are left out of the plan.
    A layer's table is scanned once for all its styles where nothing else is asked; processor, if given,
    maps each styled DataFrame and stands for drawing.
    """
    view = spec.view()
    denominator = scale_denominator(view.extent.width / view.width, known(spec.srs) == LONLAT)
    parts: list[DataFrame] = []
    number = 0

    def walk(layers: tuple[Layer, ...]) -> None:
        nonlocal number
        for layer in layers:
            q = layer_query(spec, layer, view, denominator)
            if q is not None and layer.name in tables:
                parts.extend(_layer(layer, number, tables[layer.name].query(q)))
            number += 1
            walk(layer.layers)

    def _layer(layer: Layer, layer_no: int, df: DataFrame) -> list[DataFrame]:
        out = []
        styles = [s for s in map(spec.style, layer.styles) if s and s.active_rules(denominator)]
        if layer.sort_by:
            df = sort_by(df, layer.sort_by, number="feature_no")
            styles = styles[:]
        elif layer.group_by:
            df = group_runs(df, layer.group_by, "id")
            df = df.withColumn("feature_no", F.col("id"))
        else:
            df = df.withColumn("feature_no", F.col("id"))
        for k, style in enumerate(styles):
            routed = route(df, style, denominator, spec.variables).withColumns({"layer_no": F.lit(layer_no), "layer": F.lit(layer.name), "style_no": F.lit(k), "style": F.lit(style.name)})
            out.append(processor(routed, layer, style) if processor else routed)
        return out

    walk(spec.layers)
    if not parts:
        raise ValueError("nothing of this map shows at its scale")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def draw_order(df: DataFrame) -> DataFrame:
    return df.orderBy("layer_no", "style_no", "feature_no", "rule_no")


def combined_extent(spec: MapSpec, tables: Mapping[str, SpatialTable]) -> Extent:
    """The box of all active layers in the map's plane, within the maximum extent; an error if there is none."""
    out: Extent | None = None
    for layer in spec.layers:
        if layer.active and layer.name in tables:
            r = tables[layer.name].extent().first()
            if r["minx"] is not None:
                e = project_extent(Extent(*r), layer.srs, spec.srs)
                out = e if out is None else out.union(e)
    if out is not None and spec.maximum_extent:
        out = out.clip(spec.maximum_extent)
        if not out.valid:
            out = spec.maximum_extent
    if out is None:
        out = spec.maximum_extent
    if out is None:
        raise ValueError("no layer has an extent")
    return out


def query_point(spec: MapSpec, tables: Mapping[str, SpatialTable], layer_no: int, x: float, y: float) -> DataFrame:
    """Rows of a layer that a point of the map's plane hits, within three pixels."""
    from ..operators.hits import hit_test

    view = spec.view()
    if not view.extent.contains(x, y):
        raise ValueError("the point lies outside the map")
    if not 0 <= layer_no < len(spec.layers):
        raise IndexError(f"no layer {layer_no}")
    layer = spec.layers[layer_no]
    px, py = project_point(x, y, spec.srs, layer.srs)
    own = project_extent(view.extent, spec.srs, layer.srs)
    tolerance = own.width / view.width * 3
    return hit_test(tables[layer.name].at_point(px, py, tolerance), px, py, tolerance)


def query_map_point(spec: MapSpec, tables: Mapping[str, SpatialTable], layer_no: int, px: float, py: float) -> DataFrame:
    """The same for a pixel."""
    return query_point(spec, tables, layer_no, *spec.view().backward(px, py))


def numbered(df: DataFrame, order: str, name: str = "id") -> DataFrame:
    """Sequential ids from 1 in file order, counted by ranges of it."""
    return ordering.numbered(df, [(order, True)], name)
