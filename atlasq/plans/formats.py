"""Texts in formats, and lists of alternative placements, compiled to columns.

A format tree holds texts in formats in formats; a text takes the properties of the formats around it, the
innermost that gives one. It compiles to one array column of runs, {text, properties...}, evaluated by row.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expression as X
from ..functions import values as V
from ..operators.ordering import free_names
from .properties import PROPERTIES, property_column
from .spec import Symbolizer

#: Properties of texts' formats and of layouts, in the order of their columns.
FORMATS = ("face-name", "size", "character-spacing", "line-spacing", "text-opacity", "halo-radius", "fill", "halo-fill", "text-transform")
LAYOUTS = ("dx", "dy", "horizontal-alignment", "vertical-alignment", "justify-alignment", "wrap-width", "orientation", "rotate-displacement")


@dataclass(frozen=True)
class Node:
    """A text (an expression), or a Format or Layout with properties and nodes in it."""

    kind: str
    text: str | None = None
    properties: Mapping[str, Any] = field(default_factory=dict)
    children: tuple[Node, ...] = ()


@dataclass(frozen=True)
class Placement:
    """An alternative: properties and a format tree; none keeps the tree of the one before."""

    properties: Mapping[str, Any] = field(default_factory=dict)
    tree: Node | None = None


def _tree(element: ET.Element) -> Node | None:
    nodes: list[Node] = []

    def text(raw: str | None) -> None:
        if raw and raw.strip():
            nodes.append(Node("text", raw.strip()))

    text(element.text)
    for child in element:
        if child.tag in ("Format", "ExpressionFormat", "Layout"):
            inner = _tree(child)
            nodes.append(Node("Layout" if child.tag == "Layout" else "Format", None, dict(child.attrib), (inner,) if inner else ()))
        elif child.tag != "Placement":
            raise ValueError(f"no element {child.tag!r} in a text")
        text(child.tail)
    return nodes[0] if len(nodes) == 1 else Node("list", children=tuple(nodes)) if nodes else None


def load(xml: str) -> list[Placement]:
    """The placements of a text symbolizer: itself, then each Placement in it, which keeps what the one before has and it doesn't give."""
    root = ET.fromstring(xml)
    out = [Placement(dict(root.attrib), _tree(root))]
    for child in root:
        if child.tag == "Placement":
            before = out[-1] if len(out) > 1 else out[0]
            out.append(Placement({**before.properties, **child.attrib}, _tree(child) or before.tree))
    return out


#: Numbers that a text symbolizer's own table doesn't have, with their defaults.
_NUMBERS = {"dx": 0.0, "dy": 0.0, "wrap-width": 0.0, "text-opacity": 1.0}


def _value(key: str, raw: Any, df: DataFrame, variables: Mapping[str, Any] | None) -> Column:
    """A property's value by row; names are taken as they are."""
    if key in PROPERTIES:
        return property_column(Symbolizer("text", {} if raw is None else {key: raw}), key, df, variables)
    if key in _NUMBERS:
        default = F.lit(_NUMBERS[key])
        return default if raw is None else F.coalesce(X.column(str(raw), df, variables).cast("string").try_cast("double"), default)
    return F.lit(raw).cast("string")


def runs(df: DataFrame, placement: Placement, variables: Mapping[str, Any] | None = None) -> Column:
    """The runs of a placement for each row: {text, and each of FORMATS and LAYOUTS as far as any node gives it}; texts that are null are empty."""
    keys = [k for k in (*FORMATS, *LAYOUTS) if k in _given(placement)]
    found: list[Column] = []

    def walk(node: Node, own: dict[str, Column]) -> None:
        here = own | {k: _value(k, v, df, variables) for k, v in node.properties.items() if k in (*FORMATS, *LAYOUTS)}
        if node.kind == "text":
            shown = F.coalesce(V.text(X.value(X.parse(node.text), df.schema, variables)), F.lit(""))
            how = here.get("text-transform")
            if how is not None:
                shown = F.when(how == "uppercase", F.upper(shown)).when(how == "lowercase", F.lower(shown)).when(how == "capitalize", F.initcap(shown)).when(how == "reverse", F.reverse(shown)).otherwise(shown)
            found.append(F.struct(shown.alias("text"), *(here.get(k, F.lit(None)).alias(k.replace("-", "_")) for k in keys)))
        for child in node.children:
            walk(child, here)

    if placement.tree is not None:
        walk(Node("Format", properties=placement.properties, children=(placement.tree,)), {})
    return F.array(*found)


def _given(placement: Placement) -> set[str]:
    out = set(placement.properties)
    todo = [placement.tree] if placement.tree else []
    while todo:
        node = todo.pop()
        out |= set(node.properties)
        todo += node.children
    return out


def content(own_runs: Column) -> Column:
    """The whole text of runs."""
    return F.array_join(F.transform(own_runs, lambda r: r["text"]), "")


def alternatives(df: DataFrame, placements: list[Placement], keys: tuple[str, ...], variables: Mapping[str, Any] | None = None) -> DataFrame:
    """A row for each row and placement, in their order: option (from 0), label (the whole text), and each of keys with its value there."""
    def one(k: int, p: Placement) -> Column:
        return F.struct(F.lit(k).alias("option"), content(runs(df, p, variables)).alias("label"), *(_value(key, p.properties.get(key), df, variables).alias(key.replace("-", "_")) for key in keys))

    (column,) = free_names("_alternatives", df)
    return df.withColumn(column, F.explode(F.array(*(one(k, p) for k, p in enumerate(placements))))).select(*df.columns, f"{column}.*")


def chosen(df: DataFrame, placements: list[Placement], keys: tuple[str, ...], fits, variables: Mapping[str, Any] | None = None) -> DataFrame:
    """df with option, label and keys of the first placement that fits: fits(label, {key: value}) is a condition on the row. Rows for which none does have nulls."""
    picked: list[Column] = []
    for k, p in enumerate(placements):
        values = {key: _value(key, p.properties.get(key), df, variables) for key in keys}
        label = content(runs(df, p, variables))
        picked.append(F.when(fits(label, values), F.struct(F.lit(k).alias("option"), label.alias("label"), *(v.alias(n.replace("-", "_")) for n, v in values.items()))))
    choice = reduce(lambda a, b: F.coalesce(a, b), picked)
    (name,) = free_names("_chosen", df)
    return df.withColumn(name, choice).select(*df.columns, f"{name}.*")
