"""Queries that scale and blur rasters as tables of pixels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filters, raster
from .catalog import _PRE, _PX, _rgba_sql, pixels, query, rgba

#: Kernels whose weights SQL can give: radius and weight of a distance d below it. The other two, kaiser and bessel, are tested against arrays.
_SINC = "CASE WHEN {0} = 0 THEN 1 ELSE sin(pi() * {0}) / (pi() * {0}) END"
_WEIGHTS = {
    "bilinear": (1, "1 - d"),
    "bicubic": (2, "(pow(greatest(d + 2, 0), 3) - 4 * pow(greatest(d + 1, 0), 3) + 6 * pow(greatest(d, 0), 3) - 4 * pow(greatest(d - 1, 0), 3)) / 6"),
    "spline16": (2, "CASE WHEN d < 1 THEN ((d - 9e0 / 5) * d - 1e0 / 5) * d + 1 ELSE ((-1e0 / 3 * (d - 1) + 4e0 / 5) * (d - 1) - 7e0 / 15) * (d - 1) END"),
    "spline36": (3, "CASE WHEN d < 1 THEN ((13e0 / 11 * d - 453e0 / 209) * d - 3e0 / 209) * d + 1 WHEN d < 2 THEN ((-6e0 / 11 * (d - 1) + 270e0 / 209) * (d - 1) - 156e0 / 209) * (d - 1) ELSE ((1e0 / 11 * (d - 2) - 45e0 / 209) * (d - 2) + 26e0 / 209) * (d - 2) END"),
    "hanning": (1, "0.5e0 + 0.5e0 * cos(pi() * d)"),
    "hamming": (1, "0.54e0 + 0.46e0 * cos(pi() * d)"),
    "hermite": (1, "(2 * d - 3) * d * d + 1"),
    "quadric": (1.5, "CASE WHEN d < 0.5e0 THEN 0.75e0 - d * d ELSE 0.5e0 * pow(d - 1.5e0, 2) END"),
    "catrom": (2, "CASE WHEN d < 1 THEN (9 * d * d * d - 15 * d * d + 6) / 6 ELSE (-3 * d * d * d + 15 * d * d - 24 * d + 12) / 6 END"),
    "mitchell": (2, "CASE WHEN d < 1 THEN (7 * d * d * d - 12 * d * d + 16e0 / 3) / 6 ELSE (-7e0 / 3 * d * d * d + 12 * d * d - 20 * d + 32e0 / 3) / 6 END"),
    "gaussian": (2, "exp(-2 * d * d) * sqrt(2 / pi())"),
    "sinc": (4, _SINC.format("d")),
    "lanczos": (4, f"({_SINC.format('d')}) * ({_SINC.format('(d / 4)')})"),
    "blackman": (4, f"({_SINC.format('d')}) * (0.42e0 + 0.5e0 * cos(pi() * d / 4) + 0.08e0 * cos(pi() * d / 2))"),
}
#: New width and height of the raster of 64 by 64.
SIZE = (40, 96)


def _side(n: int, radius: float, weight: str) -> str:
    stretch = f"{max(1.0, 64 / n)!r}::DOUBLE"
    return f"""(SELECT i, o, w / sum(w) OVER (PARTITION BY i) AS w FROM (SELECT i, o, {weight} AS w FROM (SELECT i, o, abs(o - ((i + 0.5e0) * 64 / {n} - 0.5e0)) / {stretch} AS d
        FROM (SELECT unnest(range({n}))::INTEGER AS i), (SELECT unnest(range(64))::INTEGER AS o)) WHERE d < {radius}))"""


def _scaled_sql(kind: str) -> str:
    radius, weight = _WEIGHTS[kind]
    return f"""SELECT '{kind}' AS kind, x, y, round(sum(v * w) / sum(u * w), 4) AS value FROM (SELECT a.i AS x, p.y AS o, sum(p.value * a.w) AS v, sum(a.w) AS u FROM {_PX} p JOIN {_side(SIZE[0], radius, weight)} a ON p.x = a.o GROUP BY 1, 2)
        JOIN (SELECT i AS y, o, w FROM {_side(SIZE[1], radius, weight)}) USING (o) GROUP BY x, y HAVING abs(sum(u * w)) > 1e-9"""


@query(" UNION ALL ".join(map(_scaled_sql, _WEIGHTS)))
def raster_scale_kernels(spark, sf):
    """A raster made narrower and taller by fourteen kernels."""
    px = pixels(spark, sf)
    parts = [raster.scale_pixels(px, (64, 64), SIZE, kind).select(F.lit(kind).alias("kind"), "x", "y", F.round("value", 4).alias("value")) for kind in _WEIGHTS]
    return reduce(DataFrame.unionByName, parts)


@query(f"""SELECT x, y, floor(sum(value * wx * wy) / sum(wx * wy) + 0.5e0)::BIGINT AS value FROM (SELECT c.x, c.y, i, j, (3 - abs(i)) AS wx, (4 - abs(j)) AS wy FROM (SELECT unnest(range(4096)) // 64 AS y, unnest(range(4096)) % 64 AS x) c,
    (SELECT unnest(range(-2, 3)) AS i), (SELECT unnest(range(-3, 4)) AS j)) n JOIN {_PX} p ON p.x = least(greatest(n.x + i, 0), 63) AND p.y = least(greatest(n.y + j, 0), 63) GROUP BY n.x, n.y""".replace("SELECT x, y, floor", "SELECT n.x::INTEGER AS x, n.y::INTEGER AS y, floor"))
def raster_stack_blur(spark, sf):
    """Radii of two columns and three rows."""
    return raster.stack_blur_pixels(pixels(spark, sf), (64, 64), 2, 3)


_CODE = " + ".join(f"(((r >> {7 - k} & 1) * 4 + (g >> {7 - k} & 1) * 2 + (b >> {7 - k} & 1)) << {3 * (5 - k)})" for k in range(6))


@query(" UNION ALL ".join(f"SELECT {k} AS level, ((c >> {3 * (6 - k)}))::INTEGER AS code, count(*) AS n, sum(r)::BIGINT AS r, sum(g)::BIGINT AS g, sum(b)::BIGINT AS b FROM (SELECT *, {_CODE} AS c FROM {_rgba_sql()}) GROUP BY 2" for k in range(7)))
def raster_color_tree(spark, sf):
    """The sums of a raster's colour tree by level and prefix."""
    return raster.tree_nodes(rgba(spark, sf)).select("level", "code", "n", "r", "g", "b")


@query()
def raster_octree(spark, sf):
    """A raster in 64 colours of its tree; merging has no SQL, a test compares with a tree built pixel by pixel."""
    px = rgba(spark, sf)
    tree = raster.octree_palette(px, 64)
    colors = F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip("rgb", p))) for p in tree.palette)) if tree.palette else F.lit(None).cast("array<struct<r:int,g:int,b:int>>")
    out = px.select("x", "y", tree.index(F.col("r"), F.col("g"), F.col("b")).alias("palette_index"))
    return out.select("x", "y", "palette_index", F.get(colors, "palette_index").alias("p")).select("x", "y", "palette_index", "p.r", "p.g", "p.b")


@query(f"""SELECT x, y, v AS r, w AS a FROM (SELECT x, y, ((4915 * (a - r) + 9667 * (a - g) + 1802 * (a - b) + 8192) >> 14)::INTEGER AS v, a::INTEGER AS w FROM {_PRE})""")
def raster_filter_chain(spark, sf):
    """Two filters of one text: inverted, then gray."""
    return filters.apply(rgba(spark, sf), "invert() gray", (64, 64)).select("x", "y", "r", "a")


_STOPS = "colorize-alpha(#ff0000, #00ff0080 50%, blue)"


@query(f"""SELECT x, y, CASE WHEN a > 0 THEN (c[2] * ((c[5] * a + 255) >> 8) + 255) >> 8 ELSE r END::INTEGER AS r, CASE WHEN a > 0 THEN (c[3] * ((c[5] * a + 255) >> 8) + 255) >> 8 ELSE g END::INTEGER AS g, CASE WHEN a > 0 THEN (c[5] * a + 255) >> 8 ELSE 0 END::INTEGER AS a
    FROM {_rgba_sql()} JOIN (SELECT unnest({[[k, *c] for k, c in enumerate(filters.ramp(filters.parse(_STOPS)[0].arguments))]}) AS c) ON c[1] = a""")
def raster_colorize_alpha(spark, sf):
    return filters.apply(rgba(spark, sf), _STOPS, (64, 64)).select("x", "y", "r", "g", "a")


@query()
def raster_hextree(spark, sf):
    """A raster in 32 colours with alpha; a test compares the palette with a tree that holds its pixels."""
    px = rgba(spark, sf)
    palette = raster.hextree_palette(px, 32)
    return raster.quantize(px, palette or [(0, 0, 0, 0)]).select("x", "y", "palette_index")
