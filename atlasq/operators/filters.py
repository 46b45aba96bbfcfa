"""Chains of image filters from their text form, compiled to one plan over a table of pixels (x, y, r, g, b, a)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import raster

#: Filters without arguments by what they do.
CONVOLUTIONS = ("blur", "emboss", "sharpen", "edge-detect", "sobel")
GRADIENTS = ("x-gradient", "y-gradient")
PLAIN = (*CONVOLUTIONS, *GRADIENTS, "gray", "invert", "color-blind-protanope", "color-blind-deuteranope", "color-blind-tritanope")


@dataclass(frozen=True)
class Filter:
    name: str
    arguments: tuple = ()


_CALL = re.compile(r"\s*,*\s*([a-z][a-z-]*)\s*(\()?")


def _inner(text: str, at: int) -> tuple[str, int]:
    """What stands between brackets, the first of which was just read, and the place after them."""
    depth, start = 1, at
    while at < len(text):
        depth += (text[at] == "(") - (text[at] == ")")
        at += 1
        if not depth:
            return text[start : at - 1], at
    raise ValueError(f"a bracket isn't closed: {text!r}")


def _split(text: str) -> list[str]:
    """At commas outside brackets."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[last:i])
            last = i + 1
    return [x.strip() for x in (*out, text[last:])] if text.strip() else []


def _stop(text: str) -> tuple[tuple[int, int, int, int], float]:
    """A colour and, after it, an offset or a percentage (1 at most)."""
    m = re.fullmatch(r"(.*?\)|\S+)(?:\s+([0-9.+-]+)\s*(%)?)?", text)
    if not m:
        raise ValueError(f"not a colour stop: {text!r}")
    offset = float(m[2]) if m[2] else 0.0
    return raster.parse_color(m[1]), min(abs(offset / 100), 1.0) if m[3] else offset


def parse(text: str) -> list[Filter]:
    """Filters in their order, with or without commas between them. Unknown names, and arguments that a filter doesn't have, are errors."""
    out, at = [], 0
    while at < len(text) and text[at:].strip(" \t\r\n,"):
        m = _CALL.match(text, at)
        if not m:
            raise ValueError(f"not a filter: {text[at:]!r}")
        name, at = m[1], m.end()
        inner = ""
        if m[2]:
            inner, at = _inner(text, at)
        own = _split(inner)
        if name in PLAIN:
            if own:
                raise ValueError(f"{name} has no arguments")
            out.append(Filter(name))
        elif name == "agg-stack-blur":
            if len(own) > 2 or any(not re.fullmatch(r"\d{1,3}", v) for v in own):
                raise ValueError(f"{name} has at most two radii: {inner!r}")
            radii = [int(v) for v in own] or [1]
            out.append(Filter(name, (radii[0], radii[-1])))
        elif name == "scale-hsla":
            if len(own) != 8:
                raise ValueError(f"{name} has eight arguments: {inner!r}")
            out.append(Filter(name, tuple(map(float, own))))
        elif name == "colorize-alpha":
            if not own:
                raise ValueError(f"{name} needs a colour")
            out.append(Filter(name, tuple(map(_stop, own))))
        elif name == "color-to-alpha":
            if len(own) > 1:
                raise ValueError(f"{name} has one colour: {inner!r}")
            out.append(Filter(name, (raster.parse_color(own[0]) if own else (0, 0, 0, 255),)))
        else:
            raise ValueError(f"no filter {name!r}")
    return out


def shown(filters: list[Filter]) -> str:
    """The text form; parse() of it gives the same filters."""
    number = lambda v: repr(v) if isinstance(v, int) else f"{v:g}"
    hexed = lambda c: "#" + "".join(f"{v:02x}" for v in c)
    out = []
    for f in filters:
        if f.name == "colorize-alpha":
            own = ",".join(hexed(c) + (f" {number(o)}" if o else "") for c, o in f.arguments)
        elif f.name == "color-to-alpha":
            own = hexed(f.arguments[0])
        else:
            own = ",".join(map(number, f.arguments))
        out.append(f.name + (f"({own})" if own else ""))
    return ",".join(out)


def ramp(stops: tuple[tuple[tuple[int, int, int, int], float], ...]) -> list[tuple[int, ...]]:
    """256 colours between stops. Stops without an offset lie at equal distances; outside them the first and the last colour hold."""
    step = 1 / (len(stops) - 1)
    placed = sorted(((o if o else k * step), c) for k, (c, o) in enumerate(stops))
    placed = [p for k, p in enumerate(placed) if not k or p[0] != placed[k - 1][0]]
    out: list[tuple[int, ...]] = [placed[0][1]] * min(256, int(placed[0][0] * 256 + 0.5))
    for (a, c), (b, d) in zip(placed, placed[1:]):
        start, end = int(a * 256 + 0.5), int(b * 256 + 0.5)
        n = end - start + 1
        # in whole numbers, 14 bits behind the point, cut towards zero
        rise = [int(((y - x) << 14) / n) for x, y in zip(c, d)]
        out += [tuple(x + (r * k >> 14) for x, r in zip(c, rise)) for k in range(min(end, 256) - start)]
    return (out + [placed[-1][1]] * 256)[:256]


def colorize_alpha(df: DataFrame, stops: tuple[tuple[tuple[int, int, int, int], float], ...]) -> DataFrame:
    """Each pixel takes the colour of its alpha, which shrinks by the colour's own; the result is premultiplied. Pixels without alpha stay."""
    if len(stops) == 1:
        own = {c: F.lit(v) for c, v in zip("rgba", stops[0][0])}
    else:
        table = ramp(stops)
        own = {c: F.get(F.array(*(F.lit(int(t[k])) for t in table)), F.col("a")) for k, c in enumerate("rgba")}
    times = lambda v, a: F.shiftright(v * a + 255, 8).cast("int")
    alpha = times(own["a"], F.col("a"))
    return df.withColumns({c: F.when(F.col("a") > 0, alpha if c == "a" else times(own[c], alpha)).otherwise(F.col(c)) for c in "rgba"})


def apply(df: DataFrame, filters: str | list[Filter], size: tuple[int, int], premultiplied: bool = False) -> DataFrame:
    """df through the filters, as premultiplied pixels. size is the raster's, premultiplied tells what df holds.

    Convolutions and colour shifts work on straight pixels, all else on premultiplied ones; pixels are turned over only where
    a filter asks for the other kind. Convolutions leave alpha as it is, gradients make pixels opaque.
    """
    own = parse(filters) if isinstance(filters, str) else filters
    df = df.select("x", "y", *raster.RGBA)
    for f in own:
        straight = f.name in CONVOLUTIONS or f.name in ("scale-hsla", "color-to-alpha")
        if straight and premultiplied:
            df = raster.demultiply(df)
        elif not straight and not premultiplied and f.name != "colorize-alpha" and not f.name.startswith("color-blind"):
            df = raster.premultiply(df)
        if f.name in (*CONVOLUTIONS, *GRADIENTS):
            for c in "rgb":
                df = raster.convolve_pixels(df, f.name, c)
            if f.name in GRADIENTS:
                df = df.withColumn("a", F.lit(255))
        elif f.name == "agg-stack-blur":
            parts = [raster.stack_blur_pixels(df, size, *f.arguments, value=c) for c in raster.RGBA]
            joined = parts[0]
            for p in parts[1:]:
                joined = joined.join(p, ["x", "y"])
            df = joined.select("x", "y", *(F.col(c).cast("int").alias(c) for c in raster.RGBA))
        elif f.name == "gray":
            df = raster.gray(df, True)
        elif f.name == "invert":
            df = raster.invert(df, True)
        elif f.name == "scale-hsla":
            v = f.arguments
            df = raster.scale_hsla(df, v[0:2], v[2:4], v[4:6], v[6:8])
        elif f.name == "color-to-alpha":
            df = raster.color_to_alpha(df, f.arguments[0][:3])
        elif f.name == "colorize-alpha":
            df = colorize_alpha(df, f.arguments)
        else:
            df = raster.color_blind(df, f.name.removeprefix("color-blind-"), premultiplied)
        premultiplied = not straight
    return df if premultiplied else raster.premultiply(df)
