"""Maps, layers, styles and rules as plain data, with their XML and JSON forms."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field
from typing import Any

from ..functions import expression as X
from ..functions.boxes import Extent
from ..functions.projection import LONLAT, SIZE_RANGE, View, fixed_aspect

SYMBOLIZERS = ("point", "line", "line-pattern", "polygon", "polygon-pattern", "raster", "shield", "text", "building", "markers", "group", "debug", "dot")
#: Defaults of symbolizer properties that queries use.
DEFAULTS: dict[str, Any] = {"opacity": 1.0, "placement": None, "allow-overlap": False, "ignore-placement": False, "simplify-algorithm": "radial-distance", "simplify": 0.0, "smooth": 0.0, "offset": 0.0, "clip": False, "spacing": 100.0, "max-error": 0.2, "multi-policy": "each", "comp-op": "src-over", "scaling": "near", "minimum-distance": 0.0, "margin": 0.0, "repeat-distance": 0.0, "height": 0.0, "start": 0, "num": 0}
ENUMERATIONS = {
    "placement:markers": ("point", "interior", "line", "vertex-first", "vertex-last", "angled-point", "polylabel"),
    "placement:text": ("point", "line", "vertex", "interior", "polylabel", "grid", "alternating-grid"),
    "placement:point": ("centroid", "interior"),
    "multi-policy": ("each", "whole", "largest"),
    "simplify-algorithm": ("radial-distance", "douglas-peucker", "visvalingam-whyatt", "zhao-saalfeld"),
    "text-transform": ("none", "uppercase", "lowercase", "capitalize", "reverse"),
    "filter-mode": ("all", "first"),
}


@dataclass(frozen=True)
class Symbolizer:
    kind: str
    properties: Mapping[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.kind not in SYMBOLIZERS:
            raise ValueError(f"no symbolizer {self.kind}")
        for key, x in self.properties.items():
            allowed = ENUMERATIONS.get(f"{key}:{'text' if self.kind == 'shield' else self.kind}") or ENUMERATIONS.get(key)
            if allowed and isinstance(x, str) and not x.startswith("[") and x not in allowed:
                raise ValueError(f"{key} can't be {x!r}")

    def get(self, key: str) -> Any:
        return self.properties.get(key, DEFAULTS.get(key))


@dataclass(frozen=True)
class Rule:
    name: str = ""
    filter: str = "true"
    min_scale: float = 0.0
    max_scale: float = float("inf")
    kind: str = "if"  # if, else, also
    symbolizers: tuple[Symbolizer, ...] = ()

    def active(self, denominator: float) -> bool:
        from ..functions.projection import in_scale_range

        return bool(self.symbolizers) and in_scale_range(denominator, self.min_scale, self.max_scale)


@dataclass(frozen=True)
class Style:
    name: str
    rules: tuple[Rule, ...] = ()
    filter_mode: str = "all"

    def active_rules(self, denominator: float) -> list[Rule]:
        return [r for r in self.rules if r.active(denominator)]


@dataclass(frozen=True)
class Layer:
    name: str
    styles: tuple[str, ...] = ()
    datasource: Mapping[str, Any] = field(default_factory=dict)
    srs: str = LONLAT
    min_scale: float = 0.0
    max_scale: float = float("inf")
    active: bool = True
    queryable: bool = False
    group_by: str = ""
    sort_by: str = ""
    buffer_size: int | None = None
    maximum_extent: Extent | None = None
    layers: tuple[Layer, ...] = ()

    def visible(self, denominator: float) -> bool:
        from ..functions.projection import in_scale_range

        return self.active and in_scale_range(denominator, self.min_scale, self.max_scale)


@dataclass(frozen=True)
class MapSpec:
    width: int = 400
    height: int = 400
    srs: str = LONLAT
    extent: Extent | None = None
    buffer_size: int = 0
    maximum_extent: Extent | None = None
    aspect_mode: str = "GROW_BBOX"
    styles: tuple[Style, ...] = ()
    layers: tuple[Layer, ...] = ()
    variables: Mapping[str, Any] = field(default_factory=dict)

    def view(self) -> View:
        low, high = SIZE_RANGE
        if not (low <= self.width <= high and low <= self.height <= high):
            raise ValueError(f"a map is {low} to {high} pixels wide and high")
        if self.extent is None:
            raise ValueError("the map has no extent; see zoom_all")
        return fixed_aspect(View(self.width, self.height, self.extent), self.aspect_mode)

    def style(self, name: str) -> Style | None:
        return next((s for s in self.styles if s.name == name), None)


@dataclass(frozen=True)
class SpatialQuery:
    """What a layer asks its table: a box, pixels per unit, scale, columns and variables."""

    extent: Extent
    resolution: tuple[float, float] = (1.0, 1.0)
    scale_denominator: float = 1.0
    names: tuple[str, ...] | None = None
    unbuffered: Extent | None = None
    filter_factor: float = 1.0
    variables: Mapping[str, Any] = field(default_factory=dict)


def needed_columns(rules: list[Rule], extra: tuple[str, ...] = ()) -> set[str]:
    """Columns that filters and symbolizer properties read, arguments of functions included."""
    names: set[str] = {n for n in extra if n}
    for rule in rules:
        names |= X.attributes(X.parse(rule.filter))
        for s in rule.symbolizers:
            for key, x in s.properties.items():
                if isinstance(x, str) and "[" in x:
                    if key == "file":
                        names |= set(X._PATH_PART.findall(x))
                    elif key.endswith("transform") and key != "text-transform":
                        for _, args in X.transform_steps(x):
                            names |= set().union(*map(X.attributes, args))
                    elif s.kind == "group" and "%" in x:
                        start, num = int(s.get("start")), int(s.get("num"))
                        for i in range(start, start + num):
                            names |= X.attributes(X.parse(x.replace("%", str(i))))
                    else:
                        names |= X.attributes(X.parse(x))
    return names


def _number(x: str | None, default: float) -> float:
    return default if x is None else float(x)


def _flag(x: str | None, default: bool) -> bool:
    if x is None:
        return default
    low = x.strip().lower()
    if low in ("true", "yes", "1", "on"):
        return True
    if low in ("false", "no", "0", "off"):
        return False
    raise ValueError(f"not a boolean: {x!r}")


def _typed(x: str) -> Any:
    for kind in (int, float):
        try:
            return kind(x)
        except ValueError:
            pass
    return {"true": True, "false": False}.get(x.strip().lower(), x)


def load_map(text: str, strict: bool = False) -> MapSpec:
    """A map from its XML form. strict refuses elements and attributes without a meaning here."""
    root = ET.fromstring(text)
    if root.tag != "Map":
        raise ValueError("the root isn't Map")
    kinds = {"".join(p.capitalize() for p in k.split("-")) + "Symbolizer": k for k in SYMBOLIZERS}
    shared = {d.get("name"): {p.get("name"): (p.text or "").strip() for p in d.findall("Parameter")} for d in root.findall("Datasource")}

    def rule(e: ET.Element) -> Rule:
        symbols, kind, condition, low, high = [], "if", "true", 0.0, float("inf")
        for c in e:
            body = (c.text or "").strip()
            if c.tag == "Filter":
                condition = body or "true"
                X.parse(condition)
            elif c.tag in ("ElseFilter", "AlsoFilter"):
                kind = c.tag[:4].lower()
            elif c.tag == "MinScaleDenominator":
                low = float(body)
            elif c.tag == "MaxScaleDenominator":
                high = float(body)
            elif c.tag in kinds:
                own: dict[str, Any] = {k: _typed(v) for k, v in c.attrib.items()}
                if body:
                    own["name"] = body
                symbols.append(Symbolizer(kinds[c.tag], own))
            elif strict:
                raise ValueError(f"unknown element {c.tag}")
        return Rule(e.get("name", ""), condition, low, high, kind, tuple(symbols))

    def layer(e: ET.Element) -> Layer:
        source: dict[str, Any] = {}
        for d in e.findall("Datasource"):
            source |= shared.get(d.get("base"), {})
            source |= {p.get("name"): (p.text or "").strip() for p in d.findall("Parameter")}
        own = e.get("buffer-size")
        return Layer(
            e.get("name", "Unnamed"), tuple((s.text or "").strip() for s in e.findall("StyleName")), source, e.get("srs", root.get("srs", LONLAT)), _number(e.get("minimum-scale-denominator"), 0.0), _number(e.get("maximum-scale-denominator"), float("inf")),
            _flag(e.get("status"), True), _flag(e.get("queryable"), False), e.get("group-by", ""), e.get("sort-by", ""), None if own is None else int(own), Extent.parse(e.get("maximum-extent")) if e.get("maximum-extent") else None, tuple(map(layer, e.findall("Layer"))),
        )

    styles = tuple(Style(s.get("name"), tuple(map(rule, s.findall("Rule"))), s.get("filter-mode", "all")) for s in root.findall("Style"))
    if strict and len({s.name for s in styles}) < len(styles):
        raise ValueError("two styles have one name")
    if strict:
        for e in root:
            if e.tag not in ("Style", "Layer", "Datasource", "Parameters", "FontSet", "FileSource"):
                raise ValueError(f"unknown element {e.tag}")
    box = root.get("maximum-extent")
    variables = {p.get("name"): _typed((p.text or "").strip()) for ps in root.findall("Parameters") for p in ps.findall("Parameter")}
    return MapSpec(int(root.get("width", 400)), int(root.get("height", 400)), root.get("srs", LONLAT), Extent.parse(root.get("extent")) if root.get("extent") else None, int(root.get("buffer-size", 0)), Extent.parse(box) if box else None, root.get("aspect-mode", "GROW_BBOX"), styles, tuple(map(layer, root.findall("Layer"))), variables)


def save_map(spec: MapSpec) -> str:
    """The XML form, from which load_map() makes an equal map."""
    box = lambda e: ",".join(repr(float(v)) for v in (e.minx, e.miny, e.maxx, e.maxy))
    root = ET.Element("Map", {"width": str(spec.width), "height": str(spec.height), "srs": spec.srs, "buffer-size": str(spec.buffer_size), "aspect-mode": spec.aspect_mode})
    if spec.extent:
        root.set("extent", box(spec.extent))
    if spec.maximum_extent:
        root.set("maximum-extent", box(spec.maximum_extent))
    if spec.variables:
        ps = ET.SubElement(root, "Parameters")
        for k, v in spec.variables.items():
            ET.SubElement(ps, "Parameter", {"name": k}).text = str(v)
    for s in spec.styles:
        e = ET.SubElement(root, "Style", {"name": s.name, "filter-mode": s.filter_mode})
        for r in s.rules:
            x = ET.SubElement(e, "Rule", {"name": r.name} if r.name else {})
            if r.kind != "if":
                ET.SubElement(x, f"{r.kind.capitalize()}Filter")
            elif r.filter != "true":
                ET.SubElement(x, "Filter").text = r.filter
            if r.min_scale:
                ET.SubElement(x, "MinScaleDenominator").text = repr(r.min_scale)
            if r.max_scale != float("inf"):
                ET.SubElement(x, "MaxScaleDenominator").text = repr(r.max_scale)
            for y in r.symbolizers:
                own = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in y.properties.items()}
                body = own.pop("name", None) if y.kind in ("text", "shield") else None
                z = ET.SubElement(x, "".join(p.capitalize() for p in y.kind.split("-")) + "Symbolizer", own)
                z.text = body

    def layer(parent: ET.Element, la: Layer) -> None:
        e = ET.SubElement(parent, "Layer", {"name": la.name, "srs": la.srs, "status": str(la.active).lower(), "queryable": str(la.queryable).lower()})
        for key, x, default in (("group-by", la.group_by, ""), ("sort-by", la.sort_by, ""), ("minimum-scale-denominator", la.min_scale, 0.0), ("maximum-scale-denominator", la.max_scale, float("inf")), ("buffer-size", la.buffer_size, None)):
            if x != default:
                e.set(key, str(x))
        if la.maximum_extent:
            e.set("maximum-extent", box(la.maximum_extent))
        for s in la.styles:
            ET.SubElement(e, "StyleName").text = s
        if la.datasource:
            d = ET.SubElement(e, "Datasource")
            for k, v in la.datasource.items():
                ET.SubElement(d, "Parameter", {"name": k}).text = str(v)
        for inner in la.layers:
            layer(e, inner)

    for la in spec.layers:
        layer(root, la)
    return ET.tostring(root, encoding="unicode")


def to_json(spec: MapSpec) -> str:
    return json.dumps(asdict(spec), default=str)


def from_json(text: str) -> MapSpec:
    d = json.loads(text)
    extent = lambda x: Extent(**x) if x else None

    def layer(x: dict) -> Layer:
        return Layer(**{**x, "styles": tuple(x["styles"]), "maximum_extent": extent(x["maximum_extent"]), "layers": tuple(map(layer, x["layers"]))})

    styles = tuple(Style(s["name"], tuple(Rule(**{**r, "symbolizers": tuple(Symbolizer(**y) for y in r["symbolizers"])}) for r in s["rules"]), s["filter_mode"]) for s in d["styles"])
    return MapSpec(**{**d, "extent": extent(d["extent"]), "maximum_extent": extent(d["maximum_extent"]), "styles": styles, "layers": tuple(map(layer, d["layers"]))})
