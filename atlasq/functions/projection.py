"""Reprojection, map scale, viewports and tile addresses."""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import crs
from .boxes import Box, Extent

#: Fixed values of the web-mercator plane.
RADIUS = 6378137.0
CIRCUMFERENCE = RADIUS * 2 * math.pi
MAX_LATITUDE = 85.0511287798065923778
LONLAT, MERCATOR = "epsg:4326", "epsg:3857"
#: Scale denominators above which zoom levels 0, 1, 2, ... are taken.
SCALES = (279541132.014, 139770566.007, 69885283.0036, 34942641.5018, 17471320.7509, 8735660.37545, 4367830.18772, 2183915.09386, 1091957.54693, 545978.773466, 272989.386733, 136494.693366, 68247.3466832, 34123.6733416, 17061.8366708, 8530.9183354, 4265.4591677, 2132.72958385, 1066.36479192, 533.182395962, 266.59119798, 133.29559899, 66.6477994952)
BOUNDARY_POINTS = 20


def known(srs: str) -> str:
    """The code of one of the two planes that are built in, or the text of one that crs.plane() knows; anything else is refused."""
    low = srs.strip().lower().removeprefix("+init=")
    if low in (LONLAT, "+proj=longlat +ellps=wgs84 +datum=wgs84 +no_defs", "wgs84"):
        return LONLAT
    if low in (MERCATOR, "epsg:900913", "+proj=merc +a=6378137 +b=6378137 +lat_ts=0.0 +lon_0=0.0 +x_0=0.0 +y_0=0.0 +k=1.0 +units=m +nadgrids=@null +wktext +no_defs +over"):
        return MERCATOR
    if _plane(srs) is not None:
        return srs
    raise NotImplementedError(f"only {LONLAT}, {MERCATOR}, transverse Mercator and conformal conic planes are built in, not {srs!r}")


@functools.cache
def _plane(srs: str) -> crs.Plane | None:
    return crs.plane(srs)


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    lon = F.least(F.greatest(lon, F.lit(-180.0)), F.lit(180.0))
    lat = F.least(F.greatest(lat, F.lit(-MAX_LATITUDE)), F.lit(MAX_LATITUDE))
    return F.radians(lon) * RADIUS, F.log(F.tan(F.radians(lat + 90.0) / 2)) * RADIUS


def to_lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    rx = F.least(F.greatest(x / RADIUS, F.lit(-math.pi)), F.lit(math.pi))
    ry = F.least(F.greatest(y / RADIUS, F.lit(-math.pi)), F.lit(math.pi))
    return F.degrees(rx), F.degrees(F.atan(F.exp(ry)) * 2 - math.pi / 2)


def project(x: Column, y: Column, source: str, target: str) -> tuple[Column, Column]:
    """A point from one plane to another, by longitude and latitude where neither has these."""
    a, b = known(source), known(target)
    if a == b:
        return x, y
    if a != LONLAT:
        x, y = to_lonlat(x, y) if a == MERCATOR else _plane(a).backward(x, y)
    return (x, y) if b == LONLAT else to_mercator(x, y) if b == MERCATOR else _plane(b).forward(x, y)


def project_point(x: float, y: float, source: str, target: str) -> tuple[float, float]:
    a, b = known(source), known(target)
    if a == b:
        return x, y
    if a == MERCATOR:
        x, y = (min(max(v / RADIUS, -math.pi), math.pi) for v in (x, y))
        x, y = math.degrees(x), math.degrees(2 * math.atan(math.exp(y)) - math.pi / 2)
    elif a != LONLAT:
        x, y = _plane(a).backward(x, y)
    if b == LONLAT:
        return x, y
    if b == MERCATOR:
        x, y = min(max(x, -180.0), 180.0), min(max(y, -MAX_LATITUDE), MAX_LATITUDE)
        return math.radians(x) * RADIUS, math.log(math.tan(math.radians(y + 90) / 2)) * RADIUS
    return _plane(b).forward(x, y)


def _by_corners(source: str, target: str) -> bool:
    return {known(source), known(target)} <= {LONLAT, MERCATOR}


def project_box(box: Box, source: str, target: str, points: int = BOUNDARY_POINTS) -> Box:
    """The built-in pair goes by corners; other planes bend sides, so points along them are projected, and the extremes taken."""
    if _by_corners(source, target):
        x0, y0 = project(box.minx, box.miny, source, target)
        x1, y1 = project(box.maxx, box.maxy, source, target)
        return Box.normalized(x0, y0, x1, y1)
    unit = [(F.lit(p[0]), F.lit(p[1])) for p in boundary(Extent(0.0, 0.0, 1.0, 1.0), points)]
    ring = [project(box.minx + (box.maxx - box.minx) * u, box.miny + (box.maxy - box.miny) * v, source, target) for u, v in unit]
    xs, ys = zip(*ring)
    return Box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def project_extent(e: Extent, source: str, target: str) -> Extent:
    if not _by_corners(source, target):
        return project_boundary(e, source, target, through=lambda x, y: project_point(x, y, source, target))
    return Extent.of(*project_point(e.minx, e.miny, source, target), *project_point(e.maxx, e.maxy, source, target))


def boundary(e: Extent, points: int = BOUNDARY_POINTS) -> list[tuple[float, float]]:
    """Points along a box's sides, counter-clockwise from its lower left corner."""
    side = max(1, points // 4)
    xs = [e.minx + e.width * i / side for i in range(side + 1)]
    ys = [e.miny + e.height * i / side for i in range(side + 1)]
    return [(x, e.miny) for x in xs[:-1]] + [(e.maxx, y) for y in ys[:-1]] + [(x, e.maxy) for x in xs[:0:-1]] + [(e.minx, y) for y in ys[:0:-1]]


def project_boundary(e: Extent, source: str, target: str, points: int = BOUNDARY_POINTS, through=None) -> Extent:
    """The box around a box's projected boundary. The built-in pair goes by corners; through is another projection's function.

    Where the projected ring turns the other way round it spans the antimeridian, and x widens to the whole world.
    """
    if through is None:
        return project_extent(e, source, target)
    ring = [through(x, y) for x, y in boundary(e, points)]
    out = Extent(min(p[0] for p in ring), min(p[1] for p in ring), max(p[0] for p in ring), max(p[1] for p in ring))
    turn = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))
    return Extent(-180.0, out.miny, 180.0, out.maxy) if turn < 0 else out


def scale_denominator(scale: float, geographic: bool) -> float:
    """Of map units per pixel, for pixels of 0.28 mm."""
    return scale / 0.00028 * (CIRCUMFERENCE / 360 if geographic else 1)


def in_scale_range(denominator: float, least: float = 0.0, most: float = float("inf")) -> bool:
    return denominator >= least - 1e-6 and denominator < most + 1e-6


@dataclass(frozen=True)
class View:
    """World to pixels and back; pixel rows grow downwards."""

    width: int
    height: int
    extent: Extent

    @property
    def sx(self) -> float:
        return self.width / self.extent.width if self.extent.width > 0 else 1.0

    @property
    def sy(self) -> float:
        return self.height / self.extent.height if self.extent.height > 0 else 1.0

    def forward(self, x, y):
        return (x - self.extent.minx) * self.sx, (self.extent.maxy - y) * self.sy

    def backward(self, px, py):
        return self.extent.minx + px / self.sx, self.extent.maxy - py / self.sy


ASPECT = ("GROW_BBOX", "GROW_CANVAS", "SHRINK_BBOX", "SHRINK_CANVAS", "ADJUST_BBOX_WIDTH", "ADJUST_BBOX_HEIGHT", "ADJUST_CANVAS_WIDTH", "ADJUST_CANVAS_HEIGHT", "RESPECT")
SIZE_RANGE = (16, 16384)


def fixed_aspect(view: View, mode: str = "GROW_BBOX") -> View:
    """The view with its box or its size changed until both have the same ratio of width to height."""
    if mode not in ASPECT:
        raise ValueError(f"no aspect mode {mode}")
    e, size, shape = view.extent, view.width / view.height, view.extent.width / view.extent.height if view.extent.height else 0.0
    if mode == "RESPECT" or not shape or size == shape:
        return view
    if mode == "ADJUST_BBOX_HEIGHT" or mode == "GROW_BBOX" and size <= shape or mode == "SHRINK_BBOX" and size > shape:
        return replace(view, extent=e.resized(height=e.width / size))
    if mode in ("ADJUST_BBOX_WIDTH", "GROW_BBOX", "SHRINK_BBOX"):
        return replace(view, extent=e.resized(width=e.height * size))
    if mode == "ADJUST_CANVAS_HEIGHT" or mode == "GROW_CANVAS" and size > shape or mode == "SHRINK_CANVAS" and size <= shape:
        return replace(view, height=int(view.width / shape + 0.5))
    return replace(view, width=int(view.height * shape + 0.5))


def zoomed(view: View, factor: float, mode: str = "GROW_BBOX") -> View:
    return fixed_aspect(replace(view, extent=view.extent.resized(view.extent.width * factor, view.extent.height * factor)), mode)


def panned(view: View, px: float, py: float) -> View:
    x, y = view.backward(px, py)
    return replace(view, extent=view.extent.centered(x, y))


def zoom_of_scale(denominator: float, most: int) -> int:
    """The first level whose scale lies below the denominator, most at the highest; the lowest level isn't a bound."""
    for zoom, scale in enumerate(SCALES[:22]):
        if denominator > math.ceil(scale):
            return min(zoom, most)
    return most


def tile_of(x: Column, y: Column, zoom: int | Column) -> tuple[Column, Column]:
    """Mercator point to tile column and row (row 0 in the north)."""
    z = F.lit(zoom) if isinstance(zoom, int) else zoom
    n = F.pow(F.lit(2.0), z)
    tx = ((x + CIRCUMFERENCE / 2) * n / CIRCUMFERENCE).cast("int")
    ty = ((F.lit(CIRCUMFERENCE / 2) - y) * n / CIRCUMFERENCE).cast("int")
    last = (n - 1).cast("int")
    return F.least(F.greatest(tx, F.lit(0)), last), F.least(F.greatest(ty, F.lit(0)), last)


def tile_range(e: Extent, zoom: int) -> tuple[int, int, int, int]:
    """First and last tile column, first and last tile row of a mercator box."""
    n, half = 1 << zoom, CIRCUMFERENCE / 2
    clamp = lambda v: min(max(int(v), 0), n - 1)
    return clamp((e.minx + half) * n / CIRCUMFERENCE), clamp((e.maxx + half) * n / CIRCUMFERENCE), clamp((half - e.maxy) * n / CIRCUMFERENCE), clamp((half - e.miny) * n / CIRCUMFERENCE)


def tile_box(tx: Column, ty: Column, zoom: int | Column) -> Box:
    n = F.pow(F.lit(2.0), F.lit(zoom) if isinstance(zoom, int) else zoom)
    size = F.lit(CIRCUMFERENCE) / n
    half = CIRCUMFERENCE / 2
    return Box(tx * size - half, F.lit(half) - (ty + 1) * size, (tx + 1) * size - half, F.lit(half) - ty * size)


def tms_row(ty: Column, zoom: Column) -> Column:
    """Rows counted from the south."""
    return (F.pow(F.lit(2), zoom) - 1 - ty).cast("int")
