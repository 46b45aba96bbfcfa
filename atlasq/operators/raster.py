"""Rasters as tables of pixels (x, y, value or r, g, b, a) and as numpy tiles."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.projection import View, project
from ..sources import scratch
from .ordering import free_names

MODES = ("inherit", "linear", "discrete", "exact", "linear-rgba", "linear-bgra")
#: numpy types of the pixel kinds.
PIXELS = {"rgba8": "u4", "gray8": "u1", "gray8s": "i1", "gray16": "u2", "gray16s": "i2", "gray32": "u4", "gray32s": "i4", "gray32f": "f4", "gray64": "u8", "gray64s": "i8", "gray64f": "f8"}


@dataclass(frozen=True)
class Stop:
    value: float
    color: tuple[int, int, int, int]
    mode: str = "inherit"


@dataclass(frozen=True)
class Colorizer:
    stops: tuple[Stop, ...]
    default_mode: str = "linear"
    default_color: tuple[int, int, int, int] = (0, 0, 0, 0)
    epsilon: float = 1.1920928955078125e-07

    def __post_init__(self) -> None:
        if any(a.value >= b.value for a, b in zip(self.stops, self.stops[1:])):
            raise ValueError("stops must increase")

    def columns(self, value: Column, nodata: Column | None = None) -> dict[str, Column]:
        """r, g, b, a of a value in single precision; a null value or nodata is transparent black."""
        v = value.cast("float")
        stops = self.stops
        mode = lambda s: self.default_mode if s.mode == "inherit" else s.mode

        def channel(k: int) -> Column:
            if not stops:
                return F.lit(self.default_color[k])
            f = lambda x: F.lit(x).cast("float")
            near = lambda x: F.abs(v - f(x)) < f(self.epsilon)

            def piece(s: Stop, nxt: Stop | None) -> Column:
                m, c = mode(s), F.lit(s.color[k])
                if m == "exact":
                    return F.when(near(s.value), c).otherwise(F.lit(self.default_color[k]))
                if m == "discrete" or nxt is None:
                    return c
                if m in ("linear-rgba", "linear-bgra"):
                    # channels as digits of one number
                    order = (0, 1, 2, 3) if m == "linear-rgba" else (2, 1, 0, 3)
                    word = lambda t: sum(t.color[ch] << 8 * i for i, ch in enumerate(order))
                    share = (v.cast("double") - s.value) / (nxt.value - s.value)
                    mixed = (F.lit(float(word(s))) + share * (word(nxt) - word(s))).cast("long")
                    return F.shiftright(mixed, 8 * order.index(k)).bitwiseAND(F.lit(255).cast("long")).cast("int")
                share = (v - f(s.value)) / f(nxt.value - s.value)
                step = f(nxt.color[k] - s.color[k])
                return F.floor(f(s.color[k]) + share * step).cast("int")

            out = F.lit(self.default_color[k])
            for i, s in enumerate(stops):
                nxt = stops[i + 1] if i + 1 < len(stops) else None
                out = F.when(v >= f(s.value), piece(s, nxt)).otherwise(out)
            return out

        gone = value.isNull() if nodata is None else value.isNull() | (value == nodata)
        return {n: F.when(gone, F.lit(0)).otherwise(channel(k)) for k, n in enumerate("rgba")}


def nested_case(df: DataFrame, colorizer: Colorizer, value: str = "value", nodata: float | None = None) -> DataFrame:
    return df.withColumns(colorizer.columns(F.col(value), None if nodata is None else F.lit(nodata)))


# --- colours -------------------------------------------------------------------

#: The named colours of style sheets.
NAMED = {
    "transparent": (0, 0, 0, 0),
    "aliceblue": (240, 248, 255, 255), "antiquewhite": (250, 235, 215, 255), "aqua": (0, 255, 255, 255), "aquamarine": (127, 255, 212, 255), "azure": (240, 255, 255, 255), "beige": (245, 245, 220, 255), "bisque": (255, 228, 196, 255),
    "black": (0, 0, 0, 255), "blanchedalmond": (255, 235, 205, 255), "blue": (0, 0, 255, 255), "blueviolet": (138, 43, 226, 255), "brown": (165, 42, 42, 255), "burlywood": (222, 184, 135, 255), "cadetblue": (95, 158, 160, 255),
    "chartreuse": (127, 255, 0, 255), "chocolate": (210, 105, 30, 255), "coral": (255, 127, 80, 255), "cornflowerblue": (100, 149, 237, 255), "cornsilk": (255, 248, 220, 255), "crimson": (220, 20, 60, 255), "cyan": (0, 255, 255, 255),
    "darkblue": (0, 0, 139, 255), "darkcyan": (0, 139, 139, 255), "darkgoldenrod": (184, 134, 11, 255), "darkgray": (169, 169, 169, 255), "darkgreen": (0, 100, 0, 255), "darkgrey": (169, 169, 169, 255), "darkkhaki": (189, 183, 107, 255),
    "darkmagenta": (139, 0, 139, 255), "darkolivegreen": (85, 107, 47, 255), "darkorange": (255, 140, 0, 255), "darkorchid": (153, 50, 204, 255), "darkred": (139, 0, 0, 255), "darksalmon": (233, 150, 122, 255),
    "darkseagreen": (143, 188, 143, 255), "darkslateblue": (72, 61, 139, 255), "darkslategray": (47, 79, 79, 255), "darkslategrey": (47, 79, 79, 255), "darkturquoise": (0, 206, 209, 255), "darkviolet": (148, 0, 211, 255),
    "deeppink": (255, 20, 147, 255), "deepskyblue": (0, 191, 255, 255), "dimgray": (105, 105, 105, 255), "dimgrey": (105, 105, 105, 255), "dodgerblue": (30, 144, 255, 255), "firebrick": (178, 34, 34, 255), "floralwhite": (255, 250, 240, 255),
    "forestgreen": (34, 139, 34, 255), "fuchsia": (255, 0, 255, 255), "gainsboro": (220, 220, 220, 255), "ghostwhite": (248, 248, 255, 255), "gold": (255, 215, 0, 255), "goldenrod": (218, 165, 32, 255), "gray": (128, 128, 128, 255),
    "grey": (128, 128, 128, 255), "green": (0, 128, 0, 255), "greenyellow": (173, 255, 47, 255), "honeydew": (240, 255, 240, 255), "hotpink": (255, 105, 180, 255), "indianred": (205, 92, 92, 255), "indigo": (75, 0, 130, 255),
    "ivory": (255, 255, 240, 255), "khaki": (240, 230, 140, 255), "lavender": (230, 230, 250, 255), "lavenderblush": (255, 240, 245, 255), "lawngreen": (124, 252, 0, 255), "lemonchiffon": (255, 250, 205, 255),
    "lightblue": (173, 216, 230, 255), "lightcoral": (240, 128, 128, 255), "lightcyan": (224, 255, 255, 255), "lightgoldenrodyellow": (250, 250, 210, 255), "lightgray": (211, 211, 211, 255), "lightgreen": (144, 238, 144, 255),
    "lightgrey": (211, 211, 211, 255), "lightpink": (255, 182, 193, 255), "lightsalmon": (255, 160, 122, 255), "lightseagreen": (32, 178, 170, 255), "lightskyblue": (135, 206, 250, 255), "lightslategray": (119, 136, 153, 255),
    "lightslategrey": (119, 136, 153, 255), "lightsteelblue": (176, 196, 222, 255), "lightyellow": (255, 255, 224, 255), "lime": (0, 255, 0, 255), "limegreen": (50, 205, 50, 255), "linen": (250, 240, 230, 255), "magenta": (255, 0, 255, 255),
    "maroon": (128, 0, 0, 255), "mediumaquamarine": (102, 205, 170, 255), "mediumblue": (0, 0, 205, 255), "mediumorchid": (186, 85, 211, 255), "mediumpurple": (147, 112, 219, 255), "mediumseagreen": (60, 179, 113, 255),
    "mediumslateblue": (123, 104, 238, 255), "mediumspringgreen": (0, 250, 154, 255), "mediumturquoise": (72, 209, 204, 255), "mediumvioletred": (199, 21, 133, 255), "midnightblue": (25, 25, 112, 255), "mintcream": (245, 255, 250, 255),
    "mistyrose": (255, 228, 225, 255), "moccasin": (255, 228, 181, 255), "navajowhite": (255, 222, 173, 255), "navy": (0, 0, 128, 255), "oldlace": (253, 245, 230, 255), "olive": (128, 128, 0, 255), "olivedrab": (107, 142, 35, 255),
    "orange": (255, 165, 0, 255), "orangered": (255, 69, 0, 255), "orchid": (218, 112, 214, 255), "palegoldenrod": (238, 232, 170, 255), "palegreen": (152, 251, 152, 255), "paleturquoise": (175, 238, 238, 255),
    "palevioletred": (219, 112, 147, 255), "papayawhip": (255, 239, 213, 255), "peachpuff": (255, 218, 185, 255), "peru": (205, 133, 63, 255), "pink": (255, 192, 203, 255), "plum": (221, 160, 221, 255), "powderblue": (176, 224, 230, 255),
    "purple": (128, 0, 128, 255), "rebeccapurple": (102, 51, 153, 255), "red": (255, 0, 0, 255), "rosybrown": (188, 143, 143, 255), "royalblue": (65, 105, 225, 255), "saddlebrown": (139, 69, 19, 255), "salmon": (250, 128, 114, 255),
    "sandybrown": (244, 164, 96, 255), "seagreen": (46, 139, 87, 255), "seashell": (255, 245, 238, 255), "sienna": (160, 82, 45, 255), "silver": (192, 192, 192, 255), "skyblue": (135, 206, 235, 255), "slateblue": (106, 90, 205, 255),
    "slategray": (112, 128, 144, 255), "slategrey": (112, 128, 144, 255), "snow": (255, 250, 250, 255), "springgreen": (0, 255, 127, 255), "steelblue": (70, 130, 180, 255), "tan": (210, 180, 140, 255), "teal": (0, 128, 128, 255),
    "thistle": (216, 191, 216, 255), "tomato": (255, 99, 71, 255), "turquoise": (64, 224, 208, 255), "violet": (238, 130, 238, 255), "wheat": (245, 222, 179, 255), "white": (255, 255, 255, 255), "whitesmoke": (245, 245, 245, 255),
    "yellow": (255, 255, 0, 255), "yellowgreen": (154, 205, 50, 255),
}


def parse_color(text: str) -> tuple[int, int, int, int]:
    t = text.strip().lower()
    if t in NAMED:
        return NAMED[t]
    if m := re.fullmatch(r"#([0-9a-f]{3,4}|[0-9a-f]{6}|[0-9a-f]{8})", t):
        h = m[1] if len(m[1]) > 4 else "".join(c * 2 for c in m[1])
        h = h if len(h) == 8 else h + "ff"
        return tuple(int(h[i : i + 2], 16) for i in (0, 2, 4, 6))
    if m := re.fullmatch(r"(rgba?|hsla?)\(([^)]*)\)", t):
        parts = [p.strip() for p in m[2].split(",")]
        if len(parts) != (4 if m[1].endswith("a") else 3):
            raise ValueError(f"not a colour: {text!r}")
        alpha = round(255 * min(max(float(parts[3]), 0), 1)) if len(parts) == 4 else 255
        if m[1].startswith("rgb"):
            byte = lambda p: min(max(round(float(p[:-1]) * 2.55) if p.endswith("%") else int(float(p)), 0), 255)
            return (*map(byte, parts[:3]), alpha)
        import colorsys

        hue, sat, lum = float(parts[0]) % 360 / 360, float(parts[1].rstrip("%")) / 100, float(parts[2].rstrip("%")) / 100
        return (*(round(255 * c) for c in colorsys.hls_to_rgb(hue, lum, sat)), alpha)
    raise ValueError(f"not a colour: {text!r}")


# --- pixel expressions ----------------------------------------------------------

RGBA = ("r", "g", "b", "a")


def premultiply(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.expr(f"({c} * a + 127) div 255").cast("int") for c in "rgb"})


def demultiply(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.expr(f"CASE WHEN a = 0 THEN 0 ELSE least(({c} * 255) div a, 255) END").cast("int") for c in "rgb"})


def opacity(df: DataFrame, by: float) -> DataFrame:
    return df.withColumn("a", F.floor(F.col("a") * float(by)).cast("int"))


def set_alpha(df: DataFrame, by: float) -> DataFrame:
    return opacity(df, by)


def gray_to_alpha(df: DataFrame) -> DataFrame:
    luma = F.ceil(F.col("r") * 0.3 + F.col("g") * 0.59 + F.col("b") * 0.11).cast("int")
    return df.withColumns({"a": luma, "r": F.lit(255), "g": F.lit(255), "b": F.lit(255)})


def color_to_alpha_exact(df: DataFrame, color: tuple[int, int, int]) -> DataFrame:
    same = (F.col("r") == color[0]) & (F.col("g") == color[1]) & (F.col("b") == color[2])
    return df.withColumn("a", F.when(same, 0).otherwise(F.col("a")))


def _ready(df: DataFrame, premultiplied: bool) -> DataFrame:
    return df if premultiplied else premultiply(df)


def gray(df: DataFrame, premultiplied: bool = False) -> DataFrame:
    """Luminance in whole numbers of premultiplied pixels; straight ones are premultiplied first. The result is premultiplied."""
    luma = F.shiftright(4915 * F.col("r") + 9667 * F.col("g") + 1802 * F.col("b") + 8192, 14).cast("int")
    return _ready(df, premultiplied).withColumns({c: luma for c in "rgb"})


def invert(df: DataFrame, premultiplied: bool = False) -> DataFrame:
    """Alpha less each channel of premultiplied pixels; straight ones are premultiplied first. The result is premultiplied."""
    return _ready(df, premultiplied).withColumns({c: F.col("a") - F.col(c) for c in "rgb"})


def color_to_alpha(df: DataFrame, color: tuple[int, int, int]) -> DataFrame:
    """The colour becomes transparency: alpha is the largest share by which a channel differs from it."""
    def share(c: str, k: int) -> Column:
        x, base = F.col(c) / 255.0, color[k] / 255.0
        up = (x - base) / (1 - base) if base < 1 else F.lit(0.0)
        down = (base - x) / base if base > 0 else F.lit(0.0)
        return F.when(x > base, up).when(x < base, down).otherwise(F.lit(0.0))

    shares = [share(c, k) for k, c in enumerate("rgb")]
    a = F.greatest(*shares)
    out = {c: F.when(a == 0, F.lit(0)).otherwise(F.floor(F.least(F.greatest((F.col(c) / 255.0 - color[k] / 255.0) / a + color[k] / 255.0, F.lit(0.0)), F.lit(1.0)) * 255 + 0.5)).cast("int") for k, c in enumerate("rgb")}
    return df.withColumns({**out, "a": F.floor(F.col("a") * a + 0.5).cast("int")})


def rgb_to_hsl(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    r, g, b = r / 255.0, g / 255.0, b / 255.0
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d, lum = top - low, (top + low) / 2
    sat = F.when(d == 0, F.lit(0.0)).otherwise(F.try_divide(d, F.when(lum < 0.5, top + low).otherwise(2.0 - top - low)))
    hue = F.when(d == 0, F.lit(0.0)).when(top == r, F.try_divide(g - b, d) / 6 + F.when(g < b, 1.0).otherwise(0.0)).when(top == g, F.try_divide(b - r, d) / 6 + 1 / 3).otherwise(F.try_divide(r - g, d) / 6 + 2 / 3)
    return hue, sat, lum


def hsl_to_rgb(h: Column, s: Column, lum: Column) -> tuple[Column, Column, Column]:
    q = F.when(lum < 0.5, lum * (1 + s)).otherwise(lum + s - lum * s)
    p = 2 * lum - q

    def one(t: Column) -> Column:
        t = F.when(t < 0, t + 1).when(t > 1, t - 1).otherwise(t)
        return F.when(t * 6 < 1, p + (q - p) * 6 * t).when(t * 2 < 1, q).when(t * 3 < 2, p + (q - p) * (2 / 3 - t) * 6).otherwise(p)

    byte = lambda c: F.floor(c * 255 + 0.5).cast("int")
    return tuple(byte(F.when(s == 0, lum).otherwise(one(h + k))) for k in (1 / 3, 0.0, -1 / 3))


def scale_hsla(df: DataFrame, h: tuple[float, float] = (0, 1), s: tuple[float, float] = (0, 1), lum: tuple[float, float] = (0, 1), a: tuple[float, float] = (0, 1)) -> DataFrame:
    """Hue, saturation, lightness and alpha mapped from 0 .. 1 to the given ranges."""
    x = rgb_to_hsl(F.col("r"), F.col("g"), F.col("b"))
    y = [F.least(F.greatest(F.lit(float(r[0])) + c * (r[1] - r[0]), F.lit(0.0)), F.lit(1.0)) for c, r in zip(x, (h, s, lum))]
    alpha = F.floor(F.least(F.greatest((a[0] + F.col("a") / 255.0 * (a[1] - a[0])), F.lit(0.0)), F.lit(1.0)) * 255 + 0.5).cast("int")
    return df.withColumns({**dict(zip("rgb", hsl_to_rgb(*y))), "a": alpha})


#: A kind's confusion point, and slope and intercept of the line on which its colours are told apart, in chromaticities.
CONFUSION = {"protanope": (0.7465, 0.2535, 1.273463, -0.073894), "deuteranope": (1.4, -0.4, 0.968437, 0.003331), "tritanope": (0.1748, 0.0, 0.062921, 0.292119)}
#: From linear channels to X, Y, Z and back, the neutral chromaticity, gamma, and the smallest difference that counts.
_TO_XYZ = ((0.412424, 0.357579, 0.180464), (0.212656, 0.715158, 0.0721856), (0.0193324, 0.119193, 0.950444))
_FROM_XYZ = ((3.24071, -1.53726, -0.498571), (-0.969258, 1.87599, 0.0415557), (0.0556352, -0.203996, 1.05707))
_NEUTRAL, GAMMA, EPSILON = (0.312713, 0.329016, 0.358271), 2.2, 2.220446049250313e-16


def color_blind(df: DataFrame, kind: str, premultiplied: bool = False) -> DataFrame:
    """Colours as seen without one kind of cones; the result is premultiplied.

    A colour moves along the line through its chromaticity and the kind's confusion point to where that
    meets the kind's own line, at the same luminance; what falls out of the channels' range then goes towards
    neutral grey. Pixels without alpha are black. Those whose line has no slope, or the own line's, keep their straight channels, as do black ones.
    """
    px, py, own_slope, own_cut = CONFUSION[kind]
    before = demultiply(df) if premultiplied else df.withColumns({c: F.when(F.col("a") == 0, 0).otherwise(F.col(c)) for c in "rgb"})
    d = lambda v: F.lit(float(v))
    linear = [F.pow(F.col(c).cast("double"), d(GAMMA)) for c in "rgb"]
    x, y, z = (linear[0] * d(m[0]) + linear[1] * d(m[1]) + linear[2] * d(m[2]) for m in _TO_XYZ)
    tx, ty, lum, run, slope, mx, my, gx, gz, step, keep = free_names("_tx _ty _lum _run _slope _mx _my _gx _gz _step _keep", before)
    out = before.withColumns({tx: F.try_divide(x, x + y + z), ty: F.try_divide(y, x + y + z), lum: y})
    out = out.withColumn(run, F.col(tx) - d(px))
    out = out.withColumn(slope, F.when(F.abs(F.col(run)) >= EPSILON, (F.col(ty) - d(py)) / F.col(run)))
    moved = F.coalesce(F.abs(F.col(slope) - d(own_slope)) >= EPSILON, F.lit(False))
    cut = F.col(ty) - F.col(tx) * F.col(slope)
    sx = F.try_divide(d(own_cut) - cut, F.col(slope) - d(own_slope))
    out = out.withColumn(mx, sx).withColumn(my, F.col(slope) * F.col(mx) + cut)
    nx, nz = F.try_divide(F.col(mx) * F.col(lum), F.col(my)), F.try_divide((d(1) - (F.col(mx) + F.col(my))) * F.col(lum), F.col(my))
    out = out.withColumns({keep: ~moved, gx: nx, gz: nz})
    off_x, off_z = d(_NEUTRAL[0]) * F.col(lum) / d(_NEUTRAL[1]) - F.col(gx), d(_NEUTRAL[2]) * F.col(lum) / d(_NEUTRAL[1]) - F.col(gz)
    plain = [F.col(gx) * d(m[0]) + F.col(lum) * d(m[1]) + F.col(gz) * d(m[2]) for m in _FROM_XYZ]
    off = [off_x * d(m[0]) + off_z * d(m[2]) for m in _FROM_XYZ]
    fits = [F.try_divide(F.when(v < 0, d(0)).otherwise(d(1)) - v, o) for v, o in zip(plain, off)]
    out = out.withColumn(step, F.greatest(*(F.when((f > 1) | (f < 0) | f.isNull(), d(0)).otherwise(f) for f in fits)))
    final = {}
    for c, v, o in zip("rgb", plain, off):
        value = v + F.col(step) * o
        byte = F.least(F.when(value > 0, F.pow(value, d(1 / GAMMA))).otherwise(d(0)), d(255)).cast("int")
        final[c] = F.when(F.col(keep) | F.col(c).isNull(), F.col(c)).otherwise(F.shiftright(F.coalesce(byte, F.lit(0)) * F.col("a") + 255, 8)).cast("int")
    return out.select(*(final[c].alias(c) if c in final else F.col(f"`{c}`") for c in before.columns))


def cast_pixels(df: DataFrame, kind: str, value: str = "value") -> DataFrame:
    """Values clamped into another pixel kind; what it can't hold becomes its nearest value."""
    t = np.dtype(PIXELS[kind])
    if t.kind == "f":
        return df.withColumn(value, F.col(value).cast("float" if t.itemsize == 4 else "double"))
    low, high = np.iinfo(t).min, min(np.iinfo(t).max, (1 << 63) - 1)
    return df.withColumn(value, F.least(F.greatest(F.col(value).cast("double"), F.lit(float(low))), F.lit(float(high))).cast("long"))


# --- compositing ----------------------------------------------------------------

_SEPARABLE = {
    "multiply": lambda s, d: s * d,
    "screen": lambda s, d: s + d - s * d,
    "overlay": lambda s, d: F.when(d <= 0.5, 2 * s * d).otherwise(1 - 2 * (1 - s) * (1 - d)),
    "darken": lambda s, d: F.least(s, d),
    "lighten": lambda s, d: F.greatest(s, d),
    "color-dodge": lambda s, d: F.when(d == 0, F.lit(0.0)).when(s >= 1, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.try_divide(d, 1 - s))),
    "color-burn": lambda s, d: F.when(d >= 1, F.lit(1.0)).when(s <= 0, F.lit(0.0)).otherwise(1 - F.least(F.lit(1.0), F.try_divide(1 - d, s))),
    "hard-light": lambda s, d: F.when(s <= 0.5, 2 * s * d).otherwise(1 - 2 * (1 - s) * (1 - d)),
    "soft-light": lambda s, d: F.when(s <= 0.5, d - (1 - 2 * s) * d * (1 - d)).otherwise(d + (2 * s - 1) * (F.when(d <= 0.25, ((16 * d - 12) * d + 4) * d).otherwise(F.sqrt(d)) - d)),
    "difference": lambda s, d: F.abs(s - d),
    "exclusion": lambda s, d: s + d - 2 * s * d,
    "linear-dodge": lambda s, d: F.least(F.lit(1.0), s + d),
    "linear-burn": lambda s, d: F.greatest(F.lit(0.0), s + d - 1),
    "grain-merge": lambda s, d: F.least(F.greatest(d + s - 0.5, F.lit(0.0)), F.lit(1.0)),
    "grain-extract": lambda s, d: F.least(F.greatest(d - s + 0.5, F.lit(0.0)), F.lit(1.0)),
    "contrast": lambda s, d: F.least(F.greatest((d - 0.5) * (2 * s) + 0.5, F.lit(0.0)), F.lit(1.0)),
    "divide": lambda s, d: F.when(s == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.try_divide(d, s))),
}
#: Shares of source and destination, from their alphas.
_PORTER_DUFF = {
    "clear": lambda sa, da: (0.0, 0.0), "src": lambda sa, da: (1.0, 0.0), "dst": lambda sa, da: (0.0, 1.0), "src-over": lambda sa, da: (1.0, 1 - sa), "dst-over": lambda sa, da: (1 - da, 1.0), "src-in": lambda sa, da: (da, 0.0), "dst-in": lambda sa, da: (0.0, sa),
    "src-out": lambda sa, da: (1 - da, 0.0), "dst-out": lambda sa, da: (0.0, 1 - sa), "src-atop": lambda sa, da: (da, 1 - sa), "dst-atop": lambda sa, da: (1 - da, sa), "xor": lambda sa, da: (1 - da, 1 - sa),
}
_HSL = ("hue", "saturation", "color", "value")
BLEND_MODES = (*_PORTER_DUFF, "plus", "minus", *_SEPARABLE, "invert", "invert-rgb", *_HSL)


def composite(src: DataFrame, dst: DataFrame, mode: str = "src-over", opacity: float = 1.0, dx: int = 0, dy: int = 0) -> DataFrame:
    """src drawn over dst at an offset; both have straight (not premultiplied) x, y, r, g, b, a. Pixels that dst lacks are not drawn."""
    if mode not in BLEND_MODES:
        raise ValueError(f"no blend mode {mode}")
    over = src.select((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), *[F.col(c).alias(f"s{c}") for c in RGBA])
    both = dst.join(over, ["x", "y"], "left")
    sa = F.coalesce(F.col("sa"), F.lit(0)) / 255.0 * float(opacity)
    da = F.col("a") / 255.0
    s = [F.coalesce(F.col(f"s{c}"), F.lit(0)) / 255.0 for c in "rgb"]
    d = [F.col(c) / 255.0 for c in "rgb"]
    if mode in _PORTER_DUFF:
        fs, fd = (x if isinstance(x, Column) else F.lit(x) for x in _PORTER_DUFF[mode](sa, da))
        alpha = sa * fs + da * fd
        color = [sa * fs * x + da * fd * y for x, y in zip(s, d)]
    elif mode == "plus":
        alpha = F.least(F.lit(1.0), sa + da)
        color = [F.least(alpha, sa * x + da * y) for x, y in zip(s, d)]
    elif mode == "minus":
        alpha = sa + da - sa * da
        color = [F.greatest(F.lit(0.0), da * y - sa * x) for x, y in zip(s, d)]
    elif mode in ("invert", "invert-rgb"):
        alpha = sa + da - sa * da
        color = [(da * (1 - y)) * sa * (x if mode == "invert-rgb" else 1) + da * y * (1 - sa) for x, y in zip(s, d)]
    else:
        if mode in _SEPARABLE:
            mixed = [_SEPARABLE[mode](x, y) for x, y in zip(s, d)]
        else:
            hs, ss, ls = rgb_to_hsl(*(x * 255 for x in s))
            hd, sd, ld = rgb_to_hsl(*(y * 255 for y in d))
            pick = {"hue": (hs, sd, ld), "saturation": (hd, ss, ld), "color": (hs, ss, ld), "value": (hd, sd, ls)}[mode]
            mixed = [c / 255.0 for c in hsl_to_rgb(*pick)]
        alpha = sa + da - sa * da
        color = [sa * da * m + sa * (1 - da) * x + da * (1 - sa) * y for m, x, y in zip(mixed, s, d)]
    byte = lambda c: F.floor(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) * 255 + 0.5).cast("int")
    return both.select("x", "y", *[F.when(alpha == 0, F.lit(0)).otherwise(byte(F.try_divide(c, alpha))).alias(n) for c, n in zip(color, "rgb")], byte(alpha).alias("a"))


# --- scaling, filters and tiles ---------------------------------------------------


def nearest_scale(df: DataFrame, width: int, height: int, new_width: int, new_height: int) -> DataFrame:
    """Every new pixel takes the old one under its centre: old pixels are spread to the new ones they cover, without a join."""
    def span(c: str, n: int, m: int) -> Column:
        first = F.ceil(F.col(c) * m / n - 0.5)
        last = F.ceil((F.col(c) + 1) * m / n - 0.5) - 1
        return F.when(last >= first, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>"))

    others = [c for c in df.columns if c not in ("x", "y")]
    return df.withColumn("_x", F.explode(span("x", width, new_width))).withColumn("_y", F.explode(span("y", height, new_height))).select(F.col("_x").alias("x"), F.col("_y").alias("y"), *others)


def block_mean(df: DataFrame, k: int, value: str = "value") -> DataFrame:
    """An overview: means of k by k pixels."""
    return df.groupBy(F.expr(f"x div {int(k)}").cast("int").alias("x"), F.expr(f"y div {int(k)}").cast("int").alias("y")).agg(F.avg(value).alias(value))


def _sinc(x: np.ndarray) -> np.ndarray:
    return np.sinc(x)


def _bessel(x: np.ndarray) -> np.ndarray:
    t = np.linspace(0, np.pi, 129)
    j1 = lambda z: np.trapezoid(np.cos(t - z[..., None] * np.sin(t)), t) / np.pi
    return np.where(x == 0, np.pi / 4, j1(np.pi * x) / (2 * np.where(x == 0, 1, x)))


def _i0(x: np.ndarray) -> np.ndarray:
    return np.i0(x)


def _cubic(b: float, c: float):
    def f(x: np.ndarray) -> np.ndarray:
        x = np.abs(x)
        near = ((12 - 9 * b - 6 * c) * x**3 + (-18 + 12 * b + 6 * c) * x**2 + 6 - 2 * b) / 6
        far = ((-b - 6 * c) * x**3 + (6 * b + 30 * c) * x**2 + (-12 * b - 48 * c) * x + 8 * b + 24 * c) / 6
        return np.where(x < 1, near, np.where(x < 2, far, 0))

    return f


def _spline16(x: np.ndarray) -> np.ndarray:
    near = ((x - 9 / 5) * x - 1 / 5) * x + 1
    y = x - 1
    return np.where(x < 1, near, ((-1 / 3 * y + 4 / 5) * y - 7 / 15) * y)


def _spline36(x: np.ndarray) -> np.ndarray:
    y, z = x - 1, x - 2
    return np.where(x < 1, ((13 / 11 * x - 453 / 209) * x - 3 / 209) * x + 1, np.where(x < 2, ((-6 / 11 * y + 270 / 209) * y - 156 / 209) * y, ((1 / 11 * z - 45 / 209) * z + 26 / 209) * z))


#: Radius and weight (of a distance not below 0) of each kernel.
KERNELS = {
    "bilinear": (1, lambda x: 1 - x), "bicubic": (2, lambda x: (np.maximum(x + 2, 0) ** 3 - 4 * np.maximum(x + 1, 0) ** 3 + 6 * np.maximum(x, 0) ** 3 - 4 * np.maximum(x - 1, 0) ** 3) / 6), "spline16": (2, _spline16), "spline36": (3, _spline36),
    "hanning": (1, lambda x: 0.5 + 0.5 * np.cos(np.pi * x)), "hamming": (1, lambda x: 0.54 + 0.46 * np.cos(np.pi * x)), "hermite": (1, lambda x: (2 * x - 3) * x * x + 1), "kaiser": (1, lambda x: _i0(6.33 * np.sqrt(np.maximum(1 - x * x, 0))) / _i0(np.array(6.33))),
    "quadric": (1.5, lambda x: np.where(x < 0.5, 0.75 - x * x, 0.5 * (x - 1.5) ** 2)), "catrom": (2, _cubic(0, 0.5)), "gaussian": (2, lambda x: np.exp(-2 * x * x) * np.sqrt(2 / np.pi)), "bessel": (3.2383, _bessel), "mitchell": (2, _cubic(1 / 3, 1 / 3)),
    "sinc": (4, _sinc), "lanczos": (4, lambda x: _sinc(x) * _sinc(x / 4)), "blackman": (4, lambda x: _sinc(x) * (0.42 + 0.5 * np.cos(np.pi * x / 4) + 0.08 * np.cos(np.pi * x / 2))),
}


def kernel_weights(kind: str, size: int, new_size: int) -> np.ndarray:
    """Rows of weights over old pixels for each new one."""
    if kind == "near":
        out = np.zeros((new_size, size))
        out[np.arange(new_size), np.clip(np.floor((np.arange(new_size) + 0.5) * size / new_size).astype(int), 0, size - 1)] = 1
        return out
    radius, f = KERNELS[kind]
    stretch = max(1.0, size / new_size)
    centre = (np.arange(new_size) + 0.5) * size / new_size - 0.5
    d = np.abs(np.arange(size)[None, :] - centre[:, None]) / stretch
    w = np.where(d < radius, f(np.minimum(d, radius)), 0.0)
    return w / np.where(w.sum(1) == 0, 1, w.sum(1))[:, None]


def scale_array(a: np.ndarray, width: int, height: int, kind: str = "bilinear") -> np.ndarray:
    """A tile (rows, columns[, channels]) in another size; where pixel values are integers the result is rounded and clamped."""
    wy, wx = kernel_weights(kind, a.shape[0], height), kernel_weights(kind, a.shape[1], width)
    out = np.einsum("ij,jk...->ik...", wy, np.einsum("kj,ij...->ik...", wx, a.astype(np.float64)))
    if a.dtype.kind in "ui":
        limits = np.iinfo(a.dtype)
        out = np.clip(np.floor(out + 0.5), limits.min, limits.max).astype(a.dtype)
    return out


def _weight_rows(new: np.ndarray, size: int, new_size: int, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of new and old places with their weights, for some new places. A kernel's add up to one, a blur's are whole numbers, so that their sums are exact."""
    if kind == "near":
        return new, np.clip(np.floor((new + 0.5) * size / new_size).astype(np.int64), 0, size - 1), np.ones(len(new))
    if kind.startswith("stack:"):
        r = int(kind[6:])
        offset = np.arange(-r, r + 1)
        old = np.clip(new[:, None] + offset, 0, size - 1)
        return np.repeat(new, len(offset)), old.ravel(), np.tile((r + 1 - np.abs(offset)).astype(float), len(new))
    radius, f = KERNELS[kind]
    stretch = max(1.0, size / new_size)
    centre = (new + 0.5) * size / new_size - 0.5
    wide = int(np.ceil(radius * stretch))
    old = np.floor(centre).astype(np.int64)[:, None] + np.arange(-wide, wide + 2)
    d = np.abs(old - centre[:, None]) / stretch
    w = np.where((d < radius) & (old >= 0) & (old < size), f(np.minimum(d, radius)), 0.0)
    w = w / np.where(w.sum(1) == 0, 1, w.sum(1))[:, None]
    row, col = np.nonzero(w)
    return new[row], old[row, col], w[row, col]


def weight_table(spark: SparkSession, size: int, new_size: int, kind: str) -> DataFrame:
    """new, old, weight: a row for each old place that counts for a new one. A side of any length is worked out in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = _weight_rows(batch.column("id").to_numpy(), size, new_size, kind)
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.float64())], ["new", "old", "weight"])

    return spark.range(new_size).mapInArrow(run, "new int, old int, weight double")


def _resampled(df: DataFrame, across: DataFrame, down: DataFrame, value: str, whole: bool) -> DataFrame:
    """Two passes of sums over joined weights, along rows and then along columns. Missing pixels don't count: the rest's weights make up for them."""
    told = df.where(F.col(value).isNotNull()).select("x", "y", F.col(value).cast("double").alias("v"), F.lit(1.0).alias("w"))
    for axis, table in (("x", across), ("y", down)):
        keep = "y" if axis == "x" else "x"
        both = told.join(table.select(F.col("old").alias(axis), "new", "weight"), axis)
        told = both.groupBy(F.col("new").alias(axis), keep).agg(F.sum(F.col("v") * F.col("weight")).alias("v"), F.sum(F.col("w") * F.col("weight")).alias("w"))
    out = F.col("v") / F.col("w")
    return told.where(F.abs("w") > 1e-9).select("x", "y", (F.floor(out + 0.5) if whole else out).alias(value))


def scale_pixels(df: DataFrame, size: tuple[int, int], new_size: tuple[int, int], kind: str = "bilinear", value: str = "value", low: float | None = None, high: float | None = None) -> DataFrame:
    """x, y and value of a raster in another size, by any kernel; with low and high values are whole numbers within them.

    A pixel table stays a table: the old pixels of each row are joined with the sparse weights of the new
    columns and summed, then the same down the columns, so no task holds the raster, or a row of it.
    """
    if kind != "near" and kind not in KERNELS:
        raise ValueError(f"no kernel {kind!r}; there are near, {', '.join(sorted(KERNELS))}")
    spark = df.sparkSession
    out = _resampled(df, weight_table(spark, size[0], new_size[0], kind), weight_table(spark, size[1], new_size[1], kind), value, low is not None)
    if low is None or high is None:
        return out
    return out.withColumn(value, F.least(F.greatest(F.col(value).cast("double"), F.lit(float(low))), F.lit(float(high))))


def stack_blur_pixels(df: DataFrame, size: tuple[int, int], rx: int, ry: int, value: str = "value", whole: bool = True) -> DataFrame:
    """The same of stack_blur(): weights that fall off evenly from the centre, the border's pixels repeated."""
    spark = df.sparkSession
    return _resampled(df, weight_table(spark, size[0], size[0], f"stack:{max(rx, 0)}"), weight_table(spark, size[1], size[1], f"stack:{max(ry, 0)}"), value, whole)


#: The nine weights of each filter, row by row.
FILTERS = {
    "blur": (0.1111,) * 9,
    "emboss": (-2, -1, 0, -1, 1, 1, 0, 1, 2),
    "sharpen": (0, -1, 0, -1, 5, -1, 0, -1, 0),
    "edge-detect": (0, 1, 0, 1, -4, 1, 0, 1, 0),
}


def convolve(a: np.ndarray, kind: str) -> np.ndarray:
    """A 3 by 3 filter of a tile in single precision; bytes are cut to 0 .. 255, dropping what is behind the point.

    Beyond the first and last column the border repeats its pixels, beyond the first and last row it mirrors the inner row.
    Gradients are half the difference of both sides around 128 and repeat the border's pixels on all sides.
    """
    rest = [(0, 0)] * (a.ndim - 2)
    if kind in ("x-gradient", "y-gradient"):
        axis = 1 if kind == "x-gradient" else 0
        p = np.pad(a.astype(np.float32), [(1, 1) if k == axis else (0, 0) for k in range(a.ndim)], mode="edge")
        n = a.shape[axis]
        out = 128 + np.trunc((np.take(p, np.arange(n), axis) - np.take(p, np.arange(2, n + 2), axis)) / 2)
    else:
        p = np.pad(a.astype(np.float32), [(0, 0), (1, 1), *rest], mode="edge")
        p = np.pad(p, [(1, 1), (0, 0), *rest], mode="reflect" if a.shape[0] > 1 else "edge")
        near = [p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(3) for j in range(3)]
        if kind == "sobel":
            x, y = (near[2] + 2 * near[5] + near[8]) - (near[0] + 2 * near[3] + near[6]), (near[0] + 2 * near[1] + near[2]) - (near[6] + 2 * near[7] + near[8])
            out = np.sqrt(x.astype(np.float64) ** 2 + y.astype(np.float64) ** 2).astype(np.float32)
        else:
            out = sum(np.float32(w) * v for w, v in zip(FILTERS[kind], near))
    if a.dtype.kind in "ui":
        limits = np.iinfo(a.dtype)
        out = np.trunc(np.clip(out, limits.min, limits.max)).astype(a.dtype)
    return out


def stack_blur(a: np.ndarray, rx: int, ry: int) -> np.ndarray:
    """Weights fall off evenly from the centre to nothing beyond the radius, along rows, then columns."""
    out = a.astype(np.float64)
    for axis, r in ((1, rx), (0, ry)):
        if r > 0:
            w = np.array([r + 1 - abs(i) for i in range(-r, r + 1)], float)
            p = np.pad(out, [(r, r) if k == axis else (0, 0) for k in range(a.ndim)], mode="edge")
            out = sum(x * np.take(p, np.arange(i, i + a.shape[axis]), axis) for i, x in enumerate(w / w.sum()))
    return np.floor(out + 0.5).astype(a.dtype) if a.dtype.kind in "ui" else out


def convolve_pixels(df: DataFrame, kind: str, value: str = "value") -> DataFrame:
    """The same of a pixel table (x, y, value), for bytes: rows look at their left and right, then at the rows above and below.

    Each pass deals pixels to tasks by row, or by column, so nothing is multiplied. A missing neighbour counts as beyond the border.
    """
    v = F.col(value).cast("float")
    row = Window.partitionBy("y").orderBy("x")
    at = lambda by, w, step, what: F.when((F.lag if step < 0 else F.lead)(by, 1).over(w) == F.col(by) + step, (F.lag if step < 0 else F.lead)(what, 1).over(w))
    df = df.withColumn("_v", v)
    wide = df.withColumn("_r", F.array(F.coalesce(at("x", row, -1, "_v"), "_v"), F.col("_v"), F.coalesce(at("x", row, 1, "_v"), "_v")))
    column = Window.partitionBy("x").orderBy("y")
    wide = wide.withColumns({"_up": at("y", column, -1, "_r"), "_down": at("y", column, 1, "_r")})
    one = lambda c: F.lit(float(c)).cast("float")
    if kind in ("x-gradient", "y-gradient"):
        a, b = (F.col("_r")[0], F.col("_r")[2]) if kind == "x-gradient" else (F.coalesce("_up", "_r")[1], F.coalesce("_down", "_r")[1])
        d = (a - b) / 2
        out = F.lit(128.0) + F.when(d < 0, F.ceil(d)).otherwise(F.floor(d))
    else:
        up, down = F.coalesce("_up", "_down", "_r"), F.coalesce("_down", "_up", "_r")
        near = [r[i] for r in (up, F.col("_r"), down) for i in range(3)]
        if kind == "sobel":
            x, y = (near[2] + one(2) * near[5] + near[8]) - (near[0] + one(2) * near[3] + near[6]), (near[0] + one(2) * near[1] + near[2]) - (near[6] + one(2) * near[7] + near[8])
            out = F.sqrt(x.cast("double") * x + y.cast("double") * y).cast("float")
        else:
            out = reduce(lambda s, t: s + t, [one(w) * p for w, p in zip(FILTERS[kind], near)])
    cut = F.floor(F.greatest(F.least(out, one(255)), one(0))).cast("int")
    return wide.withColumn(value, cut).drop("_v", "_r", "_up", "_down")


def warp(df: DataFrame, source: View, source_srs: str, target: View, target_srs: str, value: str = "value") -> DataFrame:
    """Pixels of a raster in another plane: every target pixel's centre is projected back and takes the nearest source pixel."""
    grid = df.sparkSession.range(target.width * target.height).select((F.col("id") % target.width).cast("int").alias("x"), F.floor(F.col("id") / target.width).cast("int").alias("y"))
    wx, wy = target.backward(F.col("x") + 0.5, F.col("y") + 0.5)
    sx, sy = source.forward(*project(wx, wy, target_srs, source_srs))
    grid = grid.withColumns({"sx": F.floor(sx).cast("int"), "sy": F.floor(sy).cast("int")}).where(f"sx between 0 and {source.width - 1} and sy between 0 and {source.height - 1}")
    pixels = df.select(F.col("x").alias("sx"), F.col("y").alias("sy"), value)
    return grid.join(pixels, ["sx", "sy"]).select("x", "y", value)


def quantize(df: DataFrame, palette: list[tuple[int, int, int, int]]) -> DataFrame:
    """The nearest palette colour (first among equals) of each pixel; a palette has 256 colours at most."""
    if not 0 < len(palette) <= 256:
        raise ValueError("a palette has 1 to 256 colours")
    table = F.array(*[F.struct(*[F.lit(int(v)).alias(c) for v, c in zip(p, RGBA)], F.lit(i).alias("i")) for i, p in enumerate(palette)])
    d = lambda p: sum((F.col(c) - p[c]) * (F.col(c) - p[c]) for c in RGBA)
    best = F.array_min(F.transform(table, lambda p: F.struct(d(p).alias("d"), p["i"].alias("i"))))
    return df.withColumn("palette_index", best["i"])


#: Fixed values of the colour tree: its levels, and the level from which a node may be merged before deeper ones.
TREE_LEVELS, TREE_TOP = 6, 2


def tree_code(r: Column, g: Column, b: Column) -> Column:
    """The way of a colour down a tree of eight branches a level: the channels' bits from the highest on, three for each level."""
    out = F.lit(0)
    for level in range(TREE_LEVELS):
        bit = lambda c: F.shiftright(c.cast("int"), 7 - level).bitwiseAND(F.lit(1))
        out = out * 8 + bit(r) * 4 + bit(g) * 2 + bit(b)
    return out.cast("int")


def tree_nodes(df: DataFrame) -> DataFrame:
    """level, code, n, r, g, b, cost of all nodes of the pixels' colour tree: sums are taken by prefix, level by level from the leaves up.

    A node's cost is what its pixels would lose by one colour: its children's costs and, for each, its squared distance to the
    node's mean times its pixels. There are at most 8 ** TREE_LEVELS leaves, however many pixels.
    """
    level = df.groupBy(tree_code(F.col("r"), F.col("g"), F.col("b")).alias("code")).agg(F.count("*").alias("n"), *(F.sum(F.col(c).cast("long")).alias(c) for c in "rgb")).withColumn("cost", F.lit(0.0))
    level = scratch.written(level)
    out = level.withColumn("level", F.lit(TREE_LEVELS))
    for k in range(TREE_LEVELS - 1, -1, -1):
        up = level.withColumn("above", F.shiftright("code", 3))
        sums = up.groupBy("above").agg(F.sum("n").alias("m"), *(F.sum(c).alias(f"m{c}") for c in "rgb"))
        # a child's mean is cut to a whole number
        away = sum((F.floor(F.col(c) / F.col("n")) - F.col(f"m{c}") / F.col("m")) * (F.floor(F.col(c) / F.col("n")) - F.col(f"m{c}") / F.col("m")) for c in "rgb")
        cost = up.join(sums, "above").groupBy("above").agg(F.first("m").alias("n"), *(F.first(f"m{c}").alias(c) for c in "rgb"), F.sum(F.col("cost") + away * F.col("n")).alias("cost"))
        # a level has a bounded number of rows and is read twice above
        level = scratch.written(cost.withColumnRenamed("above", "code"))
        out = out.unionByName(level.withColumn("level", F.lit(k)))
    return out


@dataclass(frozen=True)
class ColorTree:
    """A palette, and for each level the nodes (code to palette index) whose pixels take one colour."""

    palette: tuple[tuple[int, int, int], ...]
    ends: tuple[dict[int, int], ...]

    def index(self, r: Column, g: Column, b: Column) -> Column:
        """The palette index of a colour that the tree was made of; null for a way that the tree doesn't have."""
        code = tree_code(r, g, b)
        found = []
        for level, own in enumerate(self.ends):
            if own:
                table = F.create_map(*(F.lit(v) for pair in sorted(own.items()) for v in pair))
                found.append(F.try_element_at(table, F.shiftright(code, 3 * (TREE_LEVELS - level))))
        return F.coalesce(*found) if found else F.lit(None).cast("int")


def octree_palette(df: DataFrame, most: int = 256) -> ColorTree:
    """A palette of at most so many colours for the pixels of a table (r, g, b).

    The tree's sums come from the table by prefix; then nodes are merged, cheapest first on the deepest level that has any
    left to merge, or one level or more above it where a node without grandchildren costs less. Merging takes place on
    the driver, over nodes whose number has a bound that doesn't depend on the pixels.
    """
    nodes = {(r["level"], r["code"]): r for r in tree_nodes(df).collect()}
    return merged_tree({k: (r["n"], r["r"], r["g"], r["b"], r["cost"]) for k, r in nodes.items()}, most)


def merged_tree(nodes: dict[tuple[int, int], tuple], most: int) -> ColorTree:
    """The merging of a tree's nodes ((level, code) to n, r, g, b, cost) down to so many colours."""
    children: dict[tuple[int, int], list[tuple[int, int]]] = {k: [] for k in nodes}
    for level, code in sorted(nodes):
        if level:
            children[level - 1, code >> 3].append((level, code))
    open_nodes = [sorted(((nodes[k][4], k) for k in nodes if k[0] == level), reverse=True) for level in range(TREE_LEVELS)]
    leaves = {k for k in nodes if k[0] == TREE_LEVELS}
    deepest = TREE_LEVELS
    while len(leaves) > max(most, 1):
        while deepest and not open_nodes[deepest - 1]:
            deepest -= 1
        if not deepest:
            break
        pick = deepest - 1
        best = int(open_nodes[pick][-1][0])
        for level in range(deepest - 1, TREE_TOP - 1, -1):
            if open_nodes[level]:
                cost, node = open_nodes[level][-1]
                if cost < best and not any(children[c] for c in children[node]):
                    best, pick = int(cost), level
        _, node = open_nodes[pick].pop()
        leaves -= set(children[node])
        leaves.add(node)
        children[node] = []
    palette, ends = [], [{} for _ in range(TREE_LEVELS + 1)]

    def walk(node: tuple[int, int]) -> None:
        if node in leaves:
            n, *sums, _ = nodes[node]
            ends[node[0]][node[1]] = len(palette)
            palette.append(tuple(min(255, int(np.float32(s) / np.float32(n))) for s in sums))
        for child in children[node]:
            walk(child)

    if (0, 0) in nodes:
        walk((0, 0))
    return ColorTree(tuple(palette), tuple(ends))


#: Fixed values of the tree with alpha: alphas below and above which a colour counts as clear or opaque, and the share of a node's mean error below which it isn't unfolded.
CLEAR, OPAQUE, UNFOLD = 5, 250, 15.0


def _hex_code(level: int) -> Column:
    """The way of a pixel down a tree of sixteen branches a level, alpha first."""
    out = F.lit(0)
    for k in range(level):
        bit = lambda c: F.shiftright(F.col(c).cast("int"), 7 - k).bitwiseAND(F.lit(1))
        out = out * 16 + bit("a") * 8 + bit("r") * 4 + bit("g") * 2 + bit("b")
    return out.cast("int")


def hextree_nodes(df: DataFrame, gamma: float = 2.0) -> list[DataFrame]:
    """A written table for each level, the root's first: code, n, r, g, b, a (sums; channels by their gamma), cost, children.

    A node's cost is a thousandth of its pixels, its children's costs, and each child's squared distance to
    the node's mean times its alphas' share of full ones. Clear pixels don't take part.
    """
    curve = F.array(*(F.lit(255 * (i / 255) ** (1 / gamma)) for i in range(256)))
    pixels = df.where(F.col("a") >= CLEAR).groupBy("r", "g", "b", "a").agg(F.count("*").alias("n"))
    leaf = pixels.groupBy(_hex_code(TREE_LEVELS).alias("code")).agg(F.sum("n").alias("n"), *(F.sum(F.get(curve, F.col(c).cast("int")) * F.col("n")).alias(c) for c in "rgb"), F.sum(F.col("a").cast("double") * F.col("n")).alias("a"))
    level = scratch.written(leaf.withColumns({"cost": F.col("n") / 1000.0, "children": F.lit(0).cast("long")}))
    out = [level]
    for _ in range(TREE_LEVELS):
        up = level.withColumn("above", F.shiftright("code", 4))
        sums = up.groupBy("above").agg(F.sum("n").alias("m"), *(F.sum(c).alias(f"m{c}") for c in RGBA))
        away = sum(F.pow(F.col(c) / F.col("n") - F.col(f"m{c}") / F.col("m"), 2) for c in RGBA)
        merged = up.join(sums, "above").groupBy("above").agg(F.first("m").alias("n"), *(F.first(f"m{c}").alias(c) for c in RGBA), (F.first("m") / 1000.0 + F.sum(F.col("cost") + away * F.col("a") / 255)).alias("cost"), F.count("*").alias("children"))
        level = scratch.written(merged.withColumnRenamed("above", "code"))
        out.insert(0, level)
    return out


def hextree_palette(df: DataFrame, most: int = 256, gamma: float = 2.0) -> list[tuple[int, int, int, int]]:
    """A palette with alpha of at most so many colours: from one colour for all, the node with the highest cost is unfolded into its children while there is room.

    Only nodes that are looked at reach the driver, children by children: at most 16 for each colour. A node is left
    whose error is small for its pixels, or that has more children than there is room for; after 16 of these in a row the palette is
    done. If any pixel is clear, one colour is clear black. Colours with alpha come first, then by their channels' sum.
    """
    levels = hextree_nodes(df, gamma)
    holes = df.where(F.col("a") < CLEAR).limit(1).count()
    room = most - (1 if holes else 0)
    row = lambda level, r: (r["cost"], level, r["code"], r["n"], r["r"], r["g"], r["b"], r["a"], r["children"])
    heap = [row(0, r) for r in levels[0].collect()]
    done: list[tuple] = []
    known: dict[tuple[int, int], list[tuple]] = {}
    tries, colors = 0, len(heap)

    def below(node: tuple) -> list[tuple]:
        level = node[1]
        if (level, node[2]) not in known:
            # the children of all nodes of the level that may come next, in one job
            asked = [h[2] for h in (node, *heap) if h[1] == level and (level, h[2]) not in known]
            known.update({(level, c): [] for c in asked})
            for r in levels[level + 1].where(F.shiftright("code", 4).isin(asked)).collect():
                known[level, r["code"] >> 4].append(row(level + 1, r))
        return known[level, node[2]]

    while heap and colors < room and tries < 16:
        node = max(heap, key=lambda h: (h[0], -h[1], -h[2]))
        heap.remove(node)
        cost, _, _, n, *_, children = node
        if children + colors - 1 > room:
            tries += 1
            done.append(node)
            continue
        tries = 0
        if children and (cost / n + 1) * np.log(float(n)) > UNFOLD:
            own = below(node)
            heap += own
            colors += len(own) - 1
        else:
            done.append(node)
    palette = [(0, 0, 0, 0)] if holes else []
    for _, _, _, n, r, g, b, a, _ in heap + done:
        alpha = int(np.float32(a) / np.float32(n))
        channel = lambda v: int(255 * (v / n / 255) ** gamma + 0.5)
        palette.append((channel(r), channel(g), channel(b), 255 if alpha > OPAQUE else 0 if alpha < CLEAR else alpha))
    return sorted(palette, key=lambda p: (p[3] == 255, sum(p), p[3], p))


def raster_layer(df: DataFrame, size: tuple[int, int], new_size: tuple[int, int], colorizer: Colorizer, nodata: float | None = None, value: str = "value") -> DataFrame:
    """Scale, colour, premultiply: the pixels that a raster layer composites."""
    return premultiply(nested_case(nearest_scale(df, *size, *new_size), colorizer, value, nodata))


def pixel_window(view: View, size: tuple[int, int], extent) -> tuple[int, int, int, int]:
    """The source window (x, y, width, height) that covers a box with a margin of one pixel, inside the raster."""
    x0, y0 = view.forward(extent.minx, extent.maxy)
    x1, y1 = view.forward(extent.maxx, extent.miny)
    left, top = max(0, int(np.floor(x0 + 0.5)) - 1), max(0, int(np.floor(y0 + 0.5)) - 1)
    right, bottom = min(size[0], int(np.floor(x1 + 0.5)) + 1), min(size[1], int(np.floor(y1 + 0.5)) + 1)
    return left, top, max(0, right - left), max(0, bottom - top)


def overview_level(width: int, wanted: int, levels: list[int]) -> int:
    """The coarsest overview factor that still has as many pixels as are wanted."""
    fits = [k for k in levels if width // k >= wanted]
    return max(fits, default=1)
