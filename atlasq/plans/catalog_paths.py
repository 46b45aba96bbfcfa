"""Queries along paths: positions, pieces, outlines and labels on lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, paths
from ..operators import labels
from . import formats
from .catalog import _BENT, _C, bent, bent_lines, customers, query, spread

#: Where a distance along a line that goes a right and then b up ends: columns px, py for a distance column d.
_ON = "x + least({d}, a) AS {n}x, y + greatest({d} - a, 0) AS {n}y"


@query(f"""SELECT id, (a + b)::DOUBLE AS length, CASE WHEN d < a + b THEN x + least(d, a) END AS px, CASE WHEN d < a + b THEN y + greatest(d - a, 0) END AS py,
    round(CASE WHEN d >= a + b THEN NULL WHEN d >= a THEN pi() / 2 WHEN d + 1.5e0 <= a THEN 0 WHEN d + 1.5e0 >= a + b THEN 0 ELSE atan2(d + 1.5e0 - a, a - d) END, 9) AS way,
    CASE WHEN b / 2e0 < 0 THEN 0 ELSE a + b / 2e0 END AS near, round(CASE WHEN 0.5e0 + r < a THEN 0.5e0 + r WHEN (a - 0.5e0) * (a - 0.5e0) + b * b >= r * r THEN a + sqrt(r * r - (a - 0.5e0) * (a - 0.5e0)) END, 9) AS away
    FROM (SELECT *, (c_custkey % 11)::DOUBLE AS d, 0.5e0 + c_custkey % 4 AS r FROM {_BENT})""")
def path_positions(spark, sf):
    """Positions, directions, the nearest place and the first place at a distance, along bent lines."""
    p, d, r = F.col("p"), F.expr("cast(c_custkey % 11 as double)"), F.expr("0.5D + c_custkey % 4")
    df = bent_lines(spark, sf).withColumn("p", F.element_at(paths.measured("geom"), 1))
    at = paths.position(p, d)
    near = paths.closest(p, F.col("x") + F.col("a") + 1, F.col("y") + F.col("b") / 2)
    return df.select("id", paths.length(p).alias("length"), at["x"].alias("px"), at["y"].alias("py"), F.round(paths.angle(p, d, 1.5), 9).alias("way"), near.alias("near"), F.round(paths.to_distance(p, F.lit(0.5), r), 9).alias("away"))


@query(f"""SELECT id, round(least(greatest((d + 1) * (a + b - 2 * s) / (a + b) - 1, 0), a + b - 2 * s), 9) AS seek FROM (SELECT *, c_custkey % 5 AS d, 0.25e0 AS s FROM {_BENT})""")
def path_beside(spark, sf):
    """Distances along a parallel on the inner side of the bend, which is shorter by twice its distance."""
    df = bent_lines(spark, sf).withColumn("q", F.element_at(paths.measured(geometry.offset("geom", F.lit(0.25))), 1)).withColumn("p", F.element_at(paths.measured("geom"), 1))
    return df.select("id", F.round(paths.beside(F.col("p"), F.col("q"), F.expr("cast(c_custkey % 5 as double)"), 2.0), 9).alias("seek"))


@query(f"""SELECT id, k AS dash, round(s, 9) AS start, round(e, 9) AS end, x + least(s, a) AS x0, y + greatest(s - a, 0) AS y0, x + least(e, a) AS x1, y + greatest(e - a, 0) AS y1, 2 + (s < a AND e > a)::INTEGER AS points
    FROM (SELECT *, greatest(k * 2.5e0 - 0.5e0, 0) AS s, least(k * 2.5e0 + 1e0, a + b) AS e FROM {_BENT}, (SELECT unnest(range(9))::INTEGER AS k)) WHERE s < e""")
def line_dashes(spark, sf):
    """Dashes of 1.5 with gaps of 1, half a unit into the pattern: their places, ends and points."""
    df = bent_lines(spark, sf).withColumn("p", F.element_at(paths.measured("geom"), 1)).select("id", F.posexplode(paths.dashes(F.col("p"), (1.5, 1.0), 0.5)).alias("dash", "m"))
    at = lambda c, k: F.element_at(F.col(f"m.{c}"), k)
    return df.select("id", "dash", F.round("m.start", 9).alias("start"), F.round("m.end", 9).alias("end"), at("x", 1).alias("x0"), at("y", 1).alias("y0"), at("x", -1).alias("x1"), at("y", -1).alias("y1"), F.size("m.x").alias("points"))


@query(f"SELECT id, round(0.5e0 * (a + b), 6) AS mitred, round(0.5e0 * (a + b) - 0.03125e0, 6) AS bevelled, round(0.5e0 * (a + b + 0.5e0), 6) AS squared, x - 0.25e0 AS minx, x + a + 0.25e0 AS maxx, y + b + 0.25e0 AS maxy FROM {_BENT}")
def line_strokes(spark, sf):
    """Outlines of lines half a unit wide: areas by join and cap, and how far square ends reach."""
    drawn = lambda join, cap: geometry.outline("geom", F.lit(0.5), F.lit(join), F.lit(cap), F.lit(4.0))
    df = bent(spread(customers(spark, sf))).select("id", drawn("miter", "butt").alias("mitred"), drawn("bevel", "butt").alias("bevelled"), drawn("miter", "square").alias("squared"))
    area = lambda c: F.round(geometry.area(c), 6).alias(c)
    e = geometry.envelope("squared")
    return df.select("id", area("mitred"), area("bevelled"), area("squared"), e["minx"].alias("minx"), e["maxx"].alias("maxx"), e["maxy"].alias("maxy"))


@query(f"""SELECT id, k AS place, round((x0 + x1) / 2, 9) AS lx, round((y0 + y1) / 2, 9) AS ly, round(atan2(y1 - y0, x1 - x0), 9) AS angle FROM (
    SELECT *, x + least(s, a) AS x0, y + greatest(s - a, 0) AS y0, x + least(s + 2, a) AS x1, y + greatest(s + 2 - a, 0) AS y1 FROM (
    SELECT *, (k + 0.5e0) * (a + b) / n - 1 AS s FROM (SELECT *, greatest(1, (a + b) // 4)::INTEGER AS n FROM {_BENT}), (SELECT unnest(range(5))::INTEGER AS k) WHERE k < n AND a + b >= 2)) WHERE s >= 0 AND s + 2 <= a + b""")
def labels_on_lines(spark, sf):
    """Places of labels two units long along bent lines, two units apart."""
    found = labels.line_labels(bent_lines(spark, sf).select("id", "geom"), 2.0, 0.5, 2.0)
    return found.select("id", "place", F.round("x", 9).alias("lx"), F.round("y", 9).alias("ly"), F.round("angle", 9).alias("angle"))


TEXT = """<TextSymbolizer size="12" dx="0" fill="black">[c_name]<Format size="8" fill="[c_mktsegment]" text-transform="lowercase">' ' + [c_mktsegment]</Format>
    <Placement size="9" dx="5"/><Placement dx="-5">[c_custkey]</Placement></TextSymbolizer>"""


@query(f"SELECT id, i::INTEGER AS run, CASE i WHEN 0 THEN c_name ELSE ' ' || lower(c_mktsegment) END AS text, CASE i WHEN 0 THEN 12e0 ELSE 8e0 END AS size, CASE i WHEN 0 THEN 0 ELSE 128 END::INTEGER AS red FROM {_C}, (SELECT unnest([0, 1]) AS i)")
def text_runs(spark, sf):
    """A text in two formats; a fill that isn't a colour's name gives the default."""
    df = customers(spark, sf)
    own = formats.runs(df, formats.load(TEXT)[0])
    return df.select("id", F.posexplode(own).alias("run", "r")).select("id", "run", "r.text", "r.size", F.col("r.fill.r").alias("red"))


@query(f"""SELECT id, o::INTEGER AS option, CASE o WHEN 2 THEN c_custkey::VARCHAR ELSE c_name || ' ' || lower(c_mktsegment) END AS label, CASE o WHEN 0 THEN 12e0 ELSE 9e0 END AS size, CASE o WHEN 0 THEN 0e0 WHEN 1 THEN 5e0 ELSE -5e0 END AS dx FROM (
    SELECT *, CASE WHEN length(c_name || ' ' || c_mktsegment) * 12 <= room THEN 0 WHEN length(c_name || ' ' || c_mktsegment) * 9 <= room THEN 1 ELSE 2 END AS o FROM (SELECT *, 240 + c_custkey % 100 AS room FROM {_C}))""")
def text_placements(spark, sf):
    """The first of three placements whose text fits into a row's room; each keeps what the one before has and it doesn't give."""
    df = customers(spark, sf)
    fits = lambda label, own: F.char_length(label) * own["size"] <= F.expr("240 + c_custkey % 100")
    found = formats.chosen(df, [*formats.load(TEXT)], ("size", "dx"), lambda label, own: fits(label, own) | (label == F.col("c_custkey").cast("string")))
    return found.select("id", "option", "label", "size", "dx")
