"""Axis-aligned boxes: of columns for rows, of numbers for planning."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Extent:
    """A closed box of numbers. Invalid (reversed) boxes are allowed and tell that there is nothing."""

    minx: float
    miny: float
    maxx: float
    maxy: float

    @staticmethod
    def nothing() -> Extent:
        big = 1.7976931348623157e308
        return Extent(big, big, -big, -big)

    @staticmethod
    def of(x0: float, y0: float, x1: float, y1: float) -> Extent:
        return Extent(min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1))

    @staticmethod
    def parse(text: str) -> Extent:
        """Four numbers divided by blanks or commas."""
        parts = [p for p in re.split(r"[\s,]+", text.strip()) if p]
        if len(parts) != 4:
            raise ValueError(f"not a box: {text!r}")
        return Extent(*map(float, parts))

    def __str__(self) -> str:
        return f"box({self.minx:.16g},{self.miny:.16g},{self.maxx:.16g},{self.maxy:.16g})"

    @property
    def valid(self) -> bool:
        return self.minx <= self.maxx and self.miny <= self.maxy

    @property
    def width(self) -> float:
        return self.maxx - self.minx

    @property
    def height(self) -> float:
        return self.maxy - self.miny

    @property
    def area(self) -> float:
        return self.width * self.height

    @property
    def center(self) -> tuple[float, float]:
        return (self.minx + self.maxx) / 2, (self.miny + self.maxy) / 2

    def intersects(self, o: Extent) -> bool:
        return not (o.minx > self.maxx or o.maxx < self.minx or o.miny > self.maxy or o.maxy < self.miny)

    def contains(self, x: float, y: float) -> bool:
        return self.minx <= x <= self.maxx and self.miny <= y <= self.maxy

    def contains_box(self, o: Extent) -> bool:
        return o.minx >= self.minx and o.maxx <= self.maxx and o.miny >= self.miny and o.maxy <= self.maxy

    def intersect(self, o: Extent) -> Extent:
        return self.clip(o) if self.intersects(o) else Extent.nothing()

    def clip(self, o: Extent) -> Extent:
        return Extent(max(self.minx, o.minx), max(self.miny, o.miny), min(self.maxx, o.maxx), min(self.maxy, o.maxy))

    def union(self, o: Extent) -> Extent:
        return Extent(min(self.minx, o.minx), min(self.miny, o.miny), max(self.maxx, o.maxx), max(self.maxy, o.maxy))

    def pad(self, by: float) -> Extent:
        return Extent(self.minx - by, self.miny - by, self.maxx + by, self.maxy + by)

    def resized(self, width: float | None = None, height: float | None = None) -> Extent:
        x, y = self.center
        w, h = (self.width if width is None else width) / 2, (self.height if height is None else height) / 2
        return Extent(x - w, y - h, x + w, y + h)

    def centered(self, x: float, y: float) -> Extent:
        w, h = self.width / 2, self.height / 2
        return Extent(x - w, y - h, x + w, y + h)

    def moved(self, dx: float, dy: float) -> Extent:
        return Extent(self.minx + dx, self.miny + dy, self.maxx + dx, self.maxy + dy)

    def scaled(self, by: float) -> Extent:
        return self.resized(self.width * by, self.height * by)

    def transformed(self, m: tuple[float, float, float, float, float, float]) -> Extent:
        """The box around the corners after (sx, shy, shx, sy, tx, ty)."""
        at = [(x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5]) for x in (self.minx, self.maxx) for y in (self.miny, self.maxy)]
        return Extent(min(p[0] for p in at), min(p[1] for p in at), max(p[0] for p in at), max(p[1] for p in at))


@dataclass(frozen=True)
class Box:
    """A box of columns, minx, miny, maxx, maxy by default; comparisons on flat columns prune row groups."""

    minx: Column
    miny: Column
    maxx: Column
    maxy: Column

    @staticmethod
    def columns(prefix: str = "") -> Box:
        return Box(*(F.col(f"{prefix}{c}") for c in ("minx", "miny", "maxx", "maxy")))

    @staticmethod
    def fixed(e: Extent) -> Box:
        return Box(F.lit(float(e.minx)), F.lit(float(e.miny)), F.lit(float(e.maxx)), F.lit(float(e.maxy)))

    @staticmethod
    def point(x: Column, y: Column) -> Box:
        return Box(x, y, x, y)

    @staticmethod
    def around(x: Column, y: Column, by: Column | float) -> Box:
        return Box(x - by, y - by, x + by, y + by)

    @staticmethod
    def normalized(x0: Column, y0: Column, x1: Column, y1: Column) -> Box:
        return Box(F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1))

    @staticmethod
    def parse(text: Column) -> Box:
        parts = F.split(F.trim(F.regexp_replace(text, ",", " ")), r"\s+")
        return Box(*(parts[i].try_cast("double") for i in range(4)))

    def text(self) -> Column:
        return F.concat(F.lit("box("), F.concat_ws(",", *(c.cast("string") for c in self.parts())), F.lit(")"))

    def parts(self) -> tuple[Column, Column, Column, Column]:
        return self.minx, self.miny, self.maxx, self.maxy

    def struct(self) -> Column:
        return F.struct(*(c.alias(n) for c, n in zip(self.parts(), ("minx", "miny", "maxx", "maxy"))))

    def intersects(self, o: Box | Extent) -> Column:
        o = Box.fixed(o) if isinstance(o, Extent) else o
        return (self.minx <= o.maxx) & (self.maxx >= o.minx) & (self.miny <= o.maxy) & (self.maxy >= o.miny)

    def contains(self, x: Column, y: Column) -> Column:
        return (self.minx <= x) & (self.maxx >= x) & (self.miny <= y) & (self.maxy >= y)

    def contains_box(self, o: Box) -> Column:
        return (self.minx <= o.minx) & (self.maxx >= o.maxx) & (self.miny <= o.miny) & (self.maxy >= o.maxy)

    def clip(self, o: Box) -> Box:
        """Component-wise; the result of disjoint boxes is reversed."""
        return Box(F.greatest(self.minx, o.minx), F.greatest(self.miny, o.miny), F.least(self.maxx, o.maxx), F.least(self.maxy, o.maxy))

    def intersect(self, o: Box) -> Box:
        """Null components where the boxes are disjoint."""
        meets, inner = self.intersects(o), self.clip(o)
        return Box(*(F.when(meets, c) for c in inner.parts()))

    def union(self, o: Box) -> Box:
        return Box(F.least(self.minx, o.minx), F.least(self.miny, o.miny), F.greatest(self.maxx, o.maxx), F.greatest(self.maxy, o.maxy))

    def pad(self, by: Column | float) -> Box:
        return Box(self.minx - by, self.miny - by, self.maxx + by, self.maxy + by)

    def width(self) -> Column:
        return self.maxx - self.minx

    def height(self) -> Column:
        return self.maxy - self.miny

    def area(self) -> Column:
        return self.width() * self.height()

    def center(self) -> tuple[Column, Column]:
        return (self.minx + self.maxx) / 2, (self.miny + self.maxy) / 2

    def resized(self, width: Column | float, height: Column | float) -> Box:
        x, y = self.center()
        return Box(x - width / 2, y - height / 2, x + width / 2, y + height / 2)

    def centered(self, x: Column, y: Column) -> Box:
        return Box(x - self.width() / 2, y - self.height() / 2, x + self.width() / 2, y + self.height() / 2)

    def moved(self, dx: Column | float, dy: Column | float) -> Box:
        return Box(self.minx + dx, self.miny + dy, self.maxx + dx, self.maxy + dy)

    def scaled(self, by: Column | float) -> Box:
        return self.resized(self.width() * by, self.height() * by)

    def valid(self) -> Column:
        return (self.minx <= self.maxx) & (self.miny <= self.maxy)

    def transformed(self, m: tuple[Column, ...]) -> Box:
        xs = [x * m[0] + y * m[2] + m[4] for x in (self.minx, self.maxx) for y in (self.miny, self.maxy)]
        ys = [x * m[1] + y * m[3] + m[5] for x in (self.minx, self.maxx) for y in (self.miny, self.maxy)]
        return Box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))
