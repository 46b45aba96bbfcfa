"""All registered queries and the SQL that gives the same rows.

The driver's tables hold no geometry, so points, boxes and pixels are derived from keys by the same
integer arithmetic in both languages. Queries named ext_ use what Spark itself brings (joins,
aggregates, windows, streams); the others are this engine's own operators.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import boxes, expression, geometry, projection, values
from ..functions.boxes import Box, Extent
from ..operators import aggregates, grid, hits, labels, ordering, raster
from ..sources import binary_tables, delimited, images, json_tables, registry, scratch
from . import fixtures, processor, properties, spec, tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, where its files give fewer: small files may hold rows that take long."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def customers(spark: SparkSession, sf: str) -> DataFrame:
    """Points from c_custkey."""
    df = table(spark, sf, "customer").withColumns({"id": F.col("c_custkey"), "x": F.expr("cast((c_custkey * 37) % 360 - 180 as double)"), "y": F.expr("cast((c_custkey * 17) % 170 - 85 as double)")})
    return df.withColumns({"minx": F.col("x"), "maxx": F.col("x"), "miny": F.col("y"), "maxy": F.col("y"), "geom_type": F.lit(1)})


def suppliers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").withColumns({"ox": F.expr("cast((s_suppkey * 53) % 360 - 180 as double)"), "oy": F.expr("cast((s_suppkey * 29) % 170 - 85 as double)")})


def parts(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes from p_partkey, of half size p_size / 10."""
    x, y = F.expr("cast((p_partkey * 37) % 360 - 180 as double)"), F.expr("cast((p_partkey * 17) % 170 - 85 as double)")
    b = Box.around(x, y, F.expr("p_size / 10e0"))
    return table(spark, sf, "part").withColumns(dict(zip(("minx", "miny", "maxx", "maxy"), b.parts())) | {"id": F.col("p_partkey")})


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """A raster of 64 by 64 mean quantities."""
    return table(spark, sf, "lineitem").groupBy(F.expr("cast(l_orderkey % 64 as int)").alias("x"), F.expr("cast(l_partkey % 64 as int)").alias("y")).agg(F.expr("cast(sum(cast(l_quantity as bigint)) % 256 as double)").alias("value"))


def rgba(spark: SparkSession, sf: str, seed: int = 0) -> DataFrame:
    return pixels(spark, sf).select("x", "y", *[(F.expr(f"cast(value as bigint) * {k + seed * 2 + 3} + x * {k + 1} + y * {seed + 1}") % 256).cast("int").alias(c) for k, c in enumerate("rgba")])


_C = "(SELECT *, c_custkey AS id, ((c_custkey * 37) % 360 - 180)::DOUBLE AS x, ((c_custkey * 17) % 170 - 85)::DOUBLE AS y FROM customer)"
_S = "(SELECT *, ((s_suppkey * 53) % 360 - 180)::DOUBLE AS ox, ((s_suppkey * 29) % 170 - 85)::DOUBLE AS oy FROM supplier)"
_PC = "(SELECT *, p_partkey AS id, ((p_partkey * 37) % 360 - 180)::DOUBLE AS cx, ((p_partkey * 17) % 170 - 85)::DOUBLE AS cy, p_size / 10e0 AS h FROM part)"
_P = f"(SELECT *, cx - h AS minx, cy - h AS miny, cx + h AS maxx, cy + h AS maxy FROM {_PC})"
_PX = "(SELECT (l_orderkey % 64)::INTEGER AS x, (l_partkey % 64)::INTEGER AS y, (sum(l_quantity::BIGINT) % 256)::DOUBLE AS value FROM lineitem GROUP BY 1, 2)"


def _rgba_sql(seed: int = 0) -> str:
    return f"(SELECT x, y, {', '.join(f'((value::BIGINT * {k + seed * 2 + 3} + x * {k + 1} + y * {seed + 1}) % 256)::INTEGER AS {c}' for k, c in enumerate('rgba'))} FROM {_PX})"


_MERC = "radians(least(greatest(x, -180e0), 180e0)) * 6378137e0 AS mx, ln(tan(radians(least(greatest(y, -85.05112877980659e0), 85.05112877980659e0) + 90e0) / 2)) * 6378137e0 AS my"

WORLD = projection.View(256, 256, Extent(-180.0, -90.0, 180.0, 90.0))
DEMO = spec.MapSpec(
    256, 256, projection.LONLAT, Extent(-90.0, -60.0, 90.0, 60.0), 0, None, "RESPECT",
    (
        spec.Style("customers", (
            spec.Rule("rich", "[c_acctbal] > 5000 and [c_mktsegment] = 'BUILDING'", symbolizers=(spec.Symbolizer("point"),)),
            spec.Rule("debt", "[c_acctbal] < 0", symbolizers=(spec.Symbolizer("point"),)),
            spec.Rule("rest", kind="else", symbolizers=(spec.Symbolizer("dot"),)),
            spec.Rule("halo", kind="also", symbolizers=(spec.Symbolizer("markers"),)),
            spec.Rule("too-small", max_scale=10.0, symbolizers=(spec.Symbolizer("point"),)),
        )),
    ),
    (spec.Layer("customers", ("customers",)),),
)
_VIEW = "x >= -90 AND x <= 90 AND y >= -60 AND y <= 60"


@query(f"""SELECT c_custkey, CASE WHEN c_acctbal > 5000 AND c_mktsegment = 'BUILDING' THEN 'rich' WHEN c_acctbal < 0 THEN 'debt' ELSE 'rest' END AS rule_name,
    round((mx + 10018754e0) / 20037508e0 * 512e0, 6) AS px, round((10018754e0 - my) / 20037508e0 * 512e0, 6) AS py
    FROM (SELECT *, {_MERC} FROM {_C}) WHERE mx BETWEEN -10018754e0 AND 10018754e0 AND my BETWEEN -10018754e0 AND 10018754e0""")
def map_viewport_customers(spark, sf):
    """Flagship: project to web mercator, cut to the viewport, route through rules (first match), give pixels."""
    view = projection.View(512, 512, Extent(-10018754.0, -10018754.0, 10018754.0, 10018754.0))
    df = customers(spark, sf)
    mx, my = projection.to_mercator(F.col("x"), F.col("y"))
    df = df.withColumns({"mx": mx, "my": my}).where(Box.point(F.col("mx"), F.col("my")).intersects(view.extent))
    rules = tuple(r for r in DEMO.styles[0].rules if r.name in ("rich", "debt", "rest"))
    routed = processor.route(df, spec.Style("s", rules, "first"), 1e6)
    px, py = view.forward(F.col("mx"), F.col("my"))
    return routed.select("c_custkey", "rule_name", F.round(px, 6).alias("px"), F.round(py, 6).alias("py"))


@query(f"""SELECT id, rule_name, 0 AS layer_no, 0 AS style_no FROM (SELECT *, unnest(CASE WHEN c_acctbal > 5000 AND c_mktsegment = 'BUILDING' THEN ['rich', 'halo'] WHEN c_acctbal < 0 THEN ['debt', 'halo'] ELSE ['rest'] END) AS rule_name FROM {_C} WHERE {_VIEW})""")
def map_all_rules(spark, sf):
    """Entry A: a map with if, else, also rules, one of them outside the scale."""
    out = processor.run_map(DEMO, {"customers": processor.SpatialTable(customers(spark, sf))})
    return out.select("id", "rule_name", "layer_no", "style_no")


@query(f"SELECT id, CASE WHEN c_acctbal > 5000 AND c_mktsegment = 'BUILDING' THEN 'rich' WHEN c_acctbal < 0 THEN 'debt' ELSE 'rest' END AS rule_name FROM {_C}")
def rules_first_match(spark, sf):
    style = spec.Style("s", DEMO.styles[0].rules, "first")
    return processor.route(customers(spark, sf), style, 1e6).select("id", "rule_name")


@query("""SELECT c_custkey, c_acctbal + c_nationkey AS e_add, c_nationkey // 3 AS e_int_div, c_nationkey % 7 AS e_mod, CASE WHEN c_nationkey = 0 THEN NULL ELSE c_acctbal / c_nationkey END AS e_div,
    (CASE WHEN c_acctbal < 0 THEN ceil(c_acctbal) ELSE ceil(c_acctbal) END IS NOT NULL) AS e_num, length(c_name) + 0 AS e_len, (c_acctbal > 100 OR c_nationkey < 5) AND c_mktsegment <> 'BUILDING' AS e_bool,
    regexp_matches(c_name, '^Customer.*1$') AS e_match, regexp_replace(c_name, '0+', '_', 'g') AS e_replace, c_mktsegment || '/' || c_nationkey AS e_concat,
    least(c_acctbal, 0e0) AS e_min, greatest(c_acctbal, 0e0) AS e_max, abs(c_acctbal) AS e_abs, round(pow(c_nationkey, 2), 6) AS e_pow FROM customer""")
def expression_values(spark, sf):
    """The expression language over customers."""
    df = table(spark, sf, "customer")
    e = {
        "e_add": "[c_acctbal] + [c_nationkey]", "e_int_div": "[c_nationkey] / 3", "e_mod": "[c_nationkey] % 7", "e_div": "[c_acctbal] / [c_nationkey]", "e_num": "[c_acctbal] != null", "e_len": "length([c_name])",
        "e_bool": "[c_acctbal] > 100 or [c_nationkey] < 5 and [c_mktsegment] != 'BUILDING'", "e_match": "[c_name].match('^Customer.*1$')", "e_replace": "[c_name].replace('0+', '_')", "e_concat": "[c_mktsegment] + '/' + [c_nationkey]",
        "e_min": "min([c_acctbal], 0)", "e_max": "max([c_acctbal], 0)", "e_abs": "abs([c_acctbal])", "e_pow": "pow([c_nationkey], 2)",
    }
    return df.select("c_custkey", *[expression.column(t, df).alias(n) for n, t in e.items()])


@query("""SELECT l_orderkey, l_linenumber, l_quantity <= 10 AND l_discount > 0.05 AS both, NOT (l_returnflag = 'A') AS not_a, CASE WHEN l_quantity = 0 THEN FALSE ELSE TRUE END AS truth,
    (floor(l_extendedprice - 20000) + 0.5e0) AS half, CASE WHEN floor(l_extendedprice - 20000) < 0 THEN floor(l_extendedprice - 20000)::BIGINT + 1 ELSE floor(l_extendedprice - 20000)::BIGINT END AS as_int FROM lineitem""")
def expression_conversions(spark, sf):
    df = table(spark, sf, "lineitem")
    half = F.floor(F.col("l_extendedprice") - 20000).cast("double") + 0.5
    c = lambda t: expression.column(t, df)
    return df.select("l_orderkey", "l_linenumber", c("[l_quantity] <= 10 and [l_discount] > 0.05").alias("both"), c("not [l_returnflag] = 'A'").alias("not_a"), c("bool([l_quantity])").alias("truth"), half.alias("half"), c("int([l_extendedprice] - 20000)").alias("as_int"))


@query("SELECT c_custkey, CASE WHEN c_acctbal > 3000 AND c_mktsegment = 'MACHINERY' THEN 1 ELSE 1 END AS one FROM customer WHERE c_acctbal > 3000 AND c_mktsegment = 'MACHINERY'")
def filter_pushdown(spark, sf):
    df = table(spark, sf, "customer")
    return expression.where(df, "[c_acctbal] > @least and [c_mktsegment] = 'MACHINERY'", {"least": 3000}).select("c_custkey", F.lit(1).alias("one"))


@query("SELECT n_nationkey, 'icons/' || n_name || '_' || n_regionkey || '.png' AS path FROM nation")
def path_expression(spark, sf):
    df = table(spark, sf, "nation")
    return df.select("n_nationkey", expression.path_column("icons/[n_name]_[n_regionkey].png", df).alias("path"))


@query("SELECT p_partkey, round(10 + 2 * (cos(radians(p_size)) * 3 - sin(radians(p_size)) * 4), 6) AS x, round(20 + 2 * (sin(radians(p_size)) * 3 + cos(radians(p_size)) * 4), 6) AS y FROM part")
def transform_expression(spark, sf):
    """translate, scale and rotate with an attribute, applied to the point (3, 4)."""
    df = table(spark, sf, "part")
    m = expression.transform_columns("translate(10, 20), scale(2), rotate([p_size])", df)
    return df.select("p_partkey", F.round(m[0] * 3 + m[2] * 4 + m[4], 6).alias("x"), F.round(m[1] * 3 + m[3] * 4 + m[5], 6).alias("y"))


@query("SELECT n_nationkey, upper(n_name) AS up, lower(n_name) AS low, reverse(n_name) AS back FROM nation")
def text_transforms(spark, sf):
    t = expression.TEXT_TRANSFORMS
    return table(spark, sf, "nation").select("n_nationkey", t["uppercase"](F.col("n_name")).alias("up"), t["lowercase"](F.col("n_name")).alias("low"), t["reverse"](F.col("n_name")).alias("back"))


# --- boxes and extents ---------------------------------------------------------------


@query(f"SELECT id, minx, miny, maxx, maxy FROM {_P} WHERE minx <= 40 AND maxx >= -40 AND miny <= 30 AND maxy >= -30")
def bbox_scan(spark, sf):
    q = spec.SpatialQuery(Extent(-40.0, -30.0, 40.0, 30.0), names=())
    return processor.SpatialTable(parts(spark, sf)).query(q).select("id", "minx", "miny", "maxx", "maxy")


@query(f"SELECT id FROM {_P} WHERE minx <= 12.5 AND maxx >= 7.5 AND miny <= 7.5 AND maxy >= 2.5")
def bbox_at_point(spark, sf):
    return processor.SpatialTable(parts(spark, sf)).at_point(10.0, 5.0, 2.5).select("id")


@query(f"""SELECT id, minx <= 0 AND maxx >= 0 AND miny <= 0 AND maxy >= 0 AS has_origin, (maxx - minx) * (maxy - miny) AS area, CASE WHEN minx <= 20 AND maxx >= -20 AND miny <= 20 AND maxy >= -20 THEN greatest(minx, -20e0) END AS inner_minx,
    greatest(miny, -20e0) AS clip_miny, least(minx, -20e0) AS union_minx, (minx + maxx) / 2 AS center_x, minx - 1.5e0 AS padded, (minx + maxx) / 2 - (maxx - minx) * 2 / 2 AS doubled, minx + 3e0 AS moved FROM {_P}""")
def box_functions(spark, sf):
    b, o = Box.columns(), Box.fixed(Extent(-20.0, -20.0, 20.0, 20.0))
    return parts(spark, sf).select("id", b.contains(F.lit(0.0), F.lit(0.0)).alias("has_origin"), b.area().alias("area"), b.intersect(o).minx.alias("inner_minx"), b.clip(o).miny.alias("clip_miny"), b.union(o).minx.alias("union_minx"), b.center()[0].alias("center_x"), b.pad(1.5).minx.alias("padded"), b.scaled(2).minx.alias("doubled"), b.moved(3.0, 0.0).minx.alias("moved"))


@query("SELECT p_partkey, (p_size + 1)::DOUBLE AS w, -p_size::DOUBLE AS minx FROM part")
def box_parse(spark, sf):
    b = Box.parse(F.expr("concat(-p_size, ', ', -1, ' ', 1, ',', 5)"))
    return table(spark, sf, "part").select("p_partkey", b.width().alias("w"), b.minx.alias("minx"))


@query(f"SELECT min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy FROM {_P}")
def extent_aggregate(spark, sf):
    return aggregates.extent(parts(spark, sf))


@query(f"SELECT p_brand, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy FROM {_P} GROUP BY p_brand")
def extent_by_group(spark, sf):
    return aggregates.extent(parts(spark, sf), "p_brand")


@query(f"SELECT CASE WHEN count(DISTINCT k) > 1 THEN 4 ELSE max(k) END AS geom_type FROM (SELECT CASE WHEN p_size % 2 = 0 THEN 1 ELSE 3 END AS k FROM part ORDER BY p_partkey LIMIT 5)")
def geometry_kind_summary(spark, sf):
    df = parts(spark, sf).withColumn("geom_type", F.expr("CASE WHEN p_size % 2 = 0 THEN 1 ELSE 3 END"))
    return aggregates.geometry_kind(df)


@query("SELECT c_nationkey, coalesce(bool_or(c_acctbal > 9000), FALSE) AS painted FROM customer GROUP BY 1")
def painted(spark, sf):
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(aggregates.any_match(F.col("c_acctbal") > 9000))


# --- projection and tiles ---------------------------------------------------------------


@query(f"SELECT id, round(mx, 4) + 0e0 AS mx, round(my, 4) + 0e0 AS my FROM (SELECT *, {_MERC} FROM {_C})")
def project_forward(spark, sf):
    mx, my = projection.project(F.col("x"), F.col("y"), "epsg:4326", "epsg:3857")
    return customers(spark, sf).select("id", F.round(mx, 4).alias("mx"), F.round(my, 4).alias("my"))


@query(f"SELECT id, round(degrees(x * 100000e0 / 6378137e0), 6) AS lon, round(degrees(atan(exp(y * 100000e0 / 6378137e0)) * 2 - pi() / 2), 6) AS lat FROM {_C}")
def project_backward(spark, sf):
    lon, lat = projection.to_lonlat(F.col("x") * 100000.0, F.col("y") * 100000.0)
    return customers(spark, sf).select("id", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query(f"""SELECT tx, ty, count(*) AS n FROM (SELECT least(greatest(trunc((mx + 20037508.342789244e0) * 16e0 / 40075016.68557849e0)::INTEGER, 0), 15) AS tx, least(greatest(trunc((20037508.342789244e0 - my) * 16e0 / 40075016.68557849e0)::INTEGER, 0), 15) AS ty
    FROM (SELECT *, {_MERC} FROM {_C})) GROUP BY 1, 2""")
def tile_counts(spark, sf):
    mx, my = projection.to_mercator(F.col("x"), F.col("y"))
    tx, ty = projection.tile_of(mx, my, 4)
    return customers(spark, sf).select(tx.alias("tx"), ty.alias("ty")).groupBy("tx", "ty").agg(F.count("*").alias("n"))


@query(f"SELECT id, round((x + 180) * 256 / 360, 6) AS px, round((90 - y) * 256 / 180, 6) AS py FROM {_C}")
def world_to_pixel(spark, sf):
    px, py = WORLD.forward(F.col("x"), F.col("y"))
    return customers(spark, sf).select("id", F.round(px, 6).alias("px"), F.round(py, 6).alias("py"))


# --- order, runs, limits ---------------------------------------------------------------

_RUNS = "(SELECT *, sum(new) OVER (ORDER BY o_orderkey) AS run_id FROM (SELECT *, CASE WHEN o_orderstatus IS NOT DISTINCT FROM lag(o_orderstatus) OVER (ORDER BY o_orderkey) AND row_number() OVER (ORDER BY o_orderkey) > 1 THEN 0 ELSE 1 END AS new FROM orders))"


@query(f"SELECT run_id::BIGINT AS run_id, min(o_orderstatus) AS o_orderstatus, min(o_orderkey) AS first, max(o_orderkey) AS last, count(*) AS n FROM {_RUNS} GROUP BY run_id")
def group_by_runs(spark, sf):
    return ordering.runs(table(spark, sf, "orders"), "o_orderstatus", "o_orderkey")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS feature_no FROM orders")
def sort_by_attribute(spark, sf):
    return ordering.sort_by(table(spark, sf, "orders"), "o_totalprice DESC", tie="o_orderkey", number="feature_no").select("o_orderkey", "feature_no")


@query("SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS feature_no FROM orders")
def sort_keeps_columns(spark, sf):
    """Places beside all other columns."""
    return ordering.sort_by(table(spark, sf, "orders"), "o_totalprice DESC", tie="o_orderkey", number="feature_no")


@query(f"SELECT * EXCLUDE (new, run_id), run_id::BIGINT AS run_id FROM {_RUNS}")
def group_runs_keep_columns(spark, sf):
    return ordering.group_runs(table(spark, sf, "orders"), "o_orderstatus", "o_orderkey")


@query("SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (ORDER BY o_custkey DESC, o_orderkey) AS id FROM orders")
def sequential_ids(spark, sf):
    df = ordering.numbered(table(spark, sf, "orders"), [("o_custkey", False), ("o_orderkey", True)], "id")
    return df.select("o_orderkey", "o_custkey", "o_totalprice", "id")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 50")
def row_limit(spark, sf):
    return ordering.first_rows(table(spark, sf, "customer"), 50, "c_custkey").select("c_custkey", "c_name")


@query(f"SELECT p_brand, max_by(p_partkey, {{'a': h, 'k': -p_partkey}}) AS part, max(h * 2 * h * 2) AS area FROM {_PC} GROUP BY p_brand")
def largest_part(spark, sf):
    df = parts(spark, sf)
    area = F.struct((F.col("p_size") / F.lit(10.0)).alias("a"), (-F.col("p_partkey")).alias("k"))
    h = F.col("p_size") / F.lit(10.0)
    return df.groupBy("p_brand").agg(F.max_by("p_partkey", area).alias("part"), F.max(h * 2 * h * 2).alias("area"))


# --- joins ---------------------------------------------------------------


@query(f"SELECT c.id AS id, p.id AS part FROM {_C} c JOIN {_P} p ON p.minx <= c.x AND p.maxx >= c.x AND p.miny <= c.y AND p.maxy >= c.y")
def join_points_in_boxes(spark, sf):
    b = parts(spark, sf).select(F.col("id").alias("part"), "minx", "miny", "maxx", "maxy")
    return hits.join_points(customers(spark, sf).select("id", "x", "y"), b, 6.0).select("id", "part")


@query(f"SELECT a.id AS a, b.id AS b FROM {_P} a JOIN {_P} b ON a.id < b.id AND a.minx <= b.maxx AND a.maxx >= b.minx AND a.miny <= b.maxy AND a.maxy >= b.miny")
def join_boxes(spark, sf):
    """The whole part table with itself."""
    return hits.self_join_boxes(parts(spark, sf), 6.0, "id", "a", "b")


@query(f"SELECT c.c_custkey, s.s_suppkey, round(sqrt((c.x - s.ox) * (c.x - s.ox) + (c.y - s.oy) * (c.y - s.oy)), 6) AS distance FROM {_C} c JOIN {_S} s ON (c.x - s.ox) * (c.x - s.ox) + (c.y - s.oy) * (c.y - s.oy) <= 25")
def join_near_points(spark, sf):
    return hits.join_near(customers(spark, sf), suppliers(spark, sf), 5.0).select("c_custkey", "s_suppkey", F.round("distance", 6).alias("distance"))


@query(f"SELECT p.id AS id FROM {_P} p WHERE EXISTS (SELECT 1 FROM {_S} s WHERE p.minx <= s.ox + 1 AND p.maxx >= s.ox - 1 AND p.miny <= s.oy + 1 AND p.maxy >= s.oy - 1)")
def semi_join_index(spark, sf):
    right = Box.around(F.col("ox"), F.col("oy"), 1.0)
    s = suppliers(spark, sf).select(*[c.alias(f"r_{n}") for c, n in zip(right.parts(), ("minx", "miny", "maxx", "maxy"))])
    left = parts(spark, sf).select("id", *[F.col(c).alias(f"l_{c}") for c in ("minx", "miny", "maxx", "maxy")])
    return hits.join_boxes(left, s, 6.0, "left_semi").select("id")


@query(f"SELECT id FROM {_C} WHERE sqrt((x - 20) * (x - 20) + (y - 10) * (y - 10)) <= 30")
def point_query(spark, sf):
    return hits.hit_test(customers(spark, sf), 20.0, 10.0, 30.0).select("id")


@query(f"SELECT id, c_name FROM {_C} WHERE x >= -90 AND x <= 90 AND y >= -60 AND y <= 60 AND sqrt((x - 4.921875e0) * (x - 4.921875e0) + y * y) <= 2.109375e0")
def map_point_query(spark, sf):
    """Entry B: the pixel (135, 128) within three pixels."""
    return processor.query_map_point(DEMO, {"customers": processor.SpatialTable(customers(spark, sf))}, 0, 135.0, 128.0).select("id", "c_name")


@query(f"SELECT id, c_name, c_acctbal FROM {_C} WHERE x BETWEEN -50 AND 50 AND y BETWEEN -20 AND 20 AND c_acctbal > 100 AND c_mktsegment = 'AUTOMOBILE' AND 50000 > 1000")
def sql_tokens(spark, sf):
    """Entry C: SQL text with tokens, columns pruned and the box applied."""
    customers(spark, sf).createOrReplaceTempView("atlasq_customers")
    q = spec.SpatialQuery(Extent(-50.0, -20.0, 50.0, 20.0), (10.0, 10.0), 50000.0, ("c_name", "c_acctbal"), variables={"segment": "AUTOMOBILE"})
    text = "(SELECT * FROM atlasq_customers WHERE minx >= !bbox!.minx AND maxx <= !bbox!.maxx AND miny >= !bbox!.miny AND maxy <= !bbox!.maxy AND c_acctbal > !pixel_width! * 1000 AND c_mktsegment = !@segment! AND !scale_denominator! > 1000 AND !nothing! IS NULL) AS data"
    return tokens.scan(spark, text, q).select("id", "c_name", "c_acctbal")


# --- geometry ---------------------------------------------------------------

_LINE = "[{'x': x, 'y': y}, {'x': x + 3, 'y': y + 4}, {'x': x + 3, 'y': y + 10}]"


def _line() -> F.Column:
    p = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    return F.array(p(0, 0), p(3, 4), p(3, 10))


def _ring() -> F.Column:
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return F.array(p("minx", "miny"), p("maxx", "miny"), p("maxx", "maxy"), p("minx", "maxy"), p("minx", "miny"))


@query(f"SELECT id, 11e0 AS length, x AS minx, y + 10 AS maxy, sqrt((least(greatest(0 - x, 0), 0)) * 0) + 0e0 AS zero FROM {_C}")
def line_measures(spark, sf):
    df = customers(spark, sf).withColumn("pts", _line())
    e = geometry.points_envelope(F.col("pts"))
    return df.select("id", geometry.points_length(F.col("pts")).alias("length"), e["minx"].alias("minx"), e["maxy"].alias("maxy"), geometry.line_distance(F.col("pts"), F.col("x"), F.col("y")).alias("zero"))


@query(f"SELECT id, round((maxx - minx) * (maxy - miny), 6) AS area, FALSE AS clockwise, round(cx, 6) AS x, round(cy, 6) AS y, minx <= 1 AND 1 < maxx AND miny <= 1 AND 1 < maxy AS inside FROM {_P}")
def ring_measures(spark, sf):
    df = parts(spark, sf).withColumn("pts", _ring())
    c = geometry.ring_centroid(F.col("pts"))
    return df.select("id", F.round(geometry.ring_area(F.col("pts")), 6).alias("area"), geometry.ring_clockwise(F.col("pts")).alias("clockwise"), F.round(c["x"], 6).alias("x"), F.round(c["y"], 6).alias("y"), geometry.ring_contains(F.col("pts"), F.lit(1.0), F.lit(1.0)).alias("inside"))


def _int_wkt(df: DataFrame) -> F.Column:
    return F.concat(F.lit("POINT("), F.col("x").cast("int").cast("string"), F.lit(" "), F.col("y").cast("int").cast("string"), F.lit(")"))


@query(f"SELECT id, 'POINT(' || x::INTEGER || ' ' || y::INTEGER || ')' AS wkt, '{{\"type\":\"Point\",\"coordinates\":[' || x::INTEGER || ',' || y::INTEGER || ']}}' AS json, 1 AS kind FROM {_C}")
def codec_round_trip(spark, sf):
    df = customers(spark, sf)
    df = df.withColumn("geom", geometry.from_wkt(_int_wkt(df)))
    return df.select("id", geometry.to_wkt("geom").alias("wkt"), geometry.to_geojson("geom").alias("json"), geometry.wkb_kind(F.col("geom")).alias("kind"))


def box_geometry(df: DataFrame) -> DataFrame:
    n = lambda c: F.col(c).cast("string")
    text = F.concat(F.lit("POLYGON(("), F.concat_ws(",", F.concat_ws(" ", n("minx"), n("miny")), F.concat_ws(" ", n("minx"), n("maxy")), F.concat_ws(" ", n("maxx"), n("maxy")), F.concat_ws(" ", n("maxx"), n("miny")), F.concat_ws(" ", n("minx"), n("miny"))), F.lit("))"))
    return df.withColumn("geom", geometry.from_wkt(text))


@query(f"SELECT id, round(minx, 6) AS minx, round(maxy, 6) AS maxy, round(cx, 6) AS x, round(cy, 6) AS y, TRUE AS valid, TRUE AS simple, round(8 * h, 6) AS length FROM {_P} WHERE h > 0")
def polygon_functions(spark, sf):
    df = box_geometry(parts(spark, sf).where("p_size > 0"))
    e, c = geometry.envelope("geom"), geometry.centroid("geom")
    return df.select("id", F.round(e["minx"], 6).alias("minx"), F.round(e["maxy"], 6).alias("maxy"), F.round(c["x"], 6).alias("x"), F.round(c["y"], 6).alias("y"), geometry.is_valid("geom").alias("valid"), geometry.is_simple("geom").alias("simple"), F.round(geometry.path_length("geom"), 6).alias("length"))


@query(f"SELECT id, round(sqrt(pow(greatest(greatest(minx - 1, 1 - maxx), 0), 2) + pow(greatest(greatest(miny - 1, 1 - maxy), 0), 2)), 6) AS distance, minx <= 1 AND 1 < maxx AND miny <= 1 AND 1 < maxy AS hit FROM {_P} WHERE h > 0")
def closest_and_hit(spark, sf):
    df = box_geometry(parts(spark, sf).where("p_size > 0"))
    one = F.lit(1.0)
    return df.select("id", F.round(geometry.closest_point("geom", one, one)["distance"], 6).alias("distance"), geometry.hit("geom", one, one, F.lit(0.0)).alias("hit"))


@query(f"SELECT id, round(cx, 3) AS x, round(cy, 3) AS y FROM {_P} WHERE h > 0")
def interior_points(spark, sf):
    df = box_geometry(parts(spark, sf).where("p_size > 0"))
    p = geometry.interior("geom")
    return df.select("id", F.round(p["x"], 3).alias("x"), F.round(p["y"], 3).alias("y"))


@query(f"SELECT id, round(greatest(minx, -10e0), 6) AS minx, round(least(maxx, 10e0), 6) AS maxx FROM {_P} WHERE h > 0 AND minx < 10 AND maxx > -10 AND miny < 10 AND maxy > -10")
def clip_polygons(spark, sf):
    df = box_geometry(parts(spark, sf).where("p_size > 0 and minx < 10 and maxx > -10 and miny < 10 and maxy > -10"))
    c = geometry.clip("geom", F.lit(-10.0), F.lit(-10.0), F.lit(10.0), F.lit(10.0))
    e = geometry.envelope(c)
    return df.select("id", F.round(e["minx"], 6).alias("minx"), F.round(e["maxx"], 6).alias("maxx"))


@query(f"SELECT id, 'LINESTRING(' || x::INTEGER || ' ' || y::INTEGER || ',' || (x + 10)::INTEGER || ' ' || y::INTEGER || ')' AS wkt FROM {_C}")
def simplify_lines(spark, sf):
    df = customers(spark, sf)
    at = lambda dx, dy: F.concat_ws(" ", (F.col("x").cast("int") + dx).cast("string"), (F.col("y") + dy).cast("string"))
    text = F.concat(F.lit("LINESTRING("), F.concat_ws(",", at(0, 0.0), at(3, 0.25), at(6, -0.25), at(10, 0.0)), F.lit(")"))
    return df.select("id", geometry.to_wkt(geometry.simplify(geometry.from_wkt(text), F.lit("douglas-peucker"), F.lit(0.5))).alias("wkt"))


@query(f"""SELECT id, 'LINESTRING(0 0,' || CASE WHEN m BETWEEN -3 AND 2 THEN '' ELSE '10 ' || m || ',' END || '20 0)' AS wkt FROM (SELECT id, c_custkey % 9 - 4 AS m FROM {_C})""")
def simplify_by_strips(spark, sf):
    """A middle point within the tolerance, 3, of the way to the last one goes (the strip's lower border belongs to it, its upper one doesn't)."""
    df = customers(spark, sf).withColumn("m", F.expr("cast(c_custkey % 9 - 4 as string)"))
    text = F.concat(F.lit("LINESTRING(0 0,10 "), "m", F.lit(",20 0)"))
    return df.select("id", geometry.to_wkt(geometry.simplify(geometry.from_wkt(text), F.lit("zhao-saalfeld"), F.lit(3.0))).alias("wkt"))


_TRI = "(SELECT *, c_custkey % 7 + 1 AS ax, c_custkey % 5 AS ay, c_custkey % 3 AS bx, c_custkey % 4 + 2 AS by2 FROM " + _C + ")"


def _wkt(name: str, *points: tuple[str, str]) -> F.Column:
    """WKT of points given as SQL numbers."""
    at = [F.concat_ws(" ", F.expr(f"cast({x} as string)"), F.expr(f"cast({y} as string)")) for x, y in points]
    head, tail = ("((", "))") if name == "POLYGON" else ("(", ")")
    return F.concat(F.lit(name + head), F.concat_ws(",", *at), F.lit(tail))


def triangles(spark: SparkSession, sf: str) -> DataFrame:
    """Triangles whose shape and direction change from row to row; some are flat."""
    df = customers(spark, sf).withColumns({"ax": F.expr("c_custkey % 7 + 1"), "ay": F.expr("c_custkey % 5"), "bx": F.expr("c_custkey % 3"), "by2": F.expr("c_custkey % 4 + 2")})
    return df.withColumn("geom", geometry.from_wkt(_wkt("POLYGON", ("x", "y"), ("x + ax", "y + ay"), ("x + bx", "y + by2"), ("x", "y"))))


@query(f"""SELECT id, (x + least(0, ax, bx))::DOUBLE AS minx, (y + greatest(0, ay, by2))::DOUBLE AS maxy, ax * by2 - ay * bx < 0 AS valid,
    round(CASE WHEN ax * by2 = ay * bx THEN NULL ELSE x + (ax + bx) / 3e0 END, 6) AS cx, round(CASE WHEN ax * by2 = ay * bx THEN NULL ELSE y + (ay + by2) / 3e0 END, 6) AS cy,
    round(sqrt(ax * ax + ay * ay) + sqrt((bx - ax) * (bx - ax) + (by2 - ay) * (by2 - ay)) + sqrt(bx * bx + by2 * by2), 6) AS length FROM {_TRI}""")
def triangle_functions(spark, sf):
    df = triangles(spark, sf)
    e, c = geometry.envelope("geom"), geometry.centroid("geom")
    flat = F.expr("ax * by2 = ay * bx")
    centre = lambda n: F.round(F.when(~flat, c[n]), 6)
    return df.select("id", e["minx"].alias("minx"), e["maxy"].alias("maxy"), geometry.is_valid("geom").alias("valid"), centre("x").alias("cx"), centre("y").alias("cy"), F.round(geometry.path_length("geom"), 6).alias("length"))


@query(f"SELECT id, ax * by2 <> ay * bx AS valid FROM {_TRI}")
def corrected_triangles(spark, sf):
    """Rings turned the right way: only flat ones stay invalid."""
    return triangles(spark, sf).select("id", geometry.is_valid(geometry.correct("geom")).alias("valid"))


@query("SELECT o_orderkey, q >= r AS valid, q <> r AS simple, CASE WHEN q < r THEN 'a ring crosses itself' END AS reason FROM (SELECT o_orderkey, o_orderkey % 5 AS q, o_custkey % 7 AS r FROM orders)")
def crossing_rings(spark, sf):
    """Quadrilaterals whose last side crosses their second one, or ends in a repeated point, as the keys have it."""
    df = table(spark, sf, "orders").selectExpr("o_orderkey", "o_orderkey % 5 as q", "o_custkey % 7 as r")
    df = df.withColumn("geom", geometry.from_wkt(_wkt("POLYGON", ("0", "0"), ("0", "4"), ("4", "q"), ("4", "r"), ("0", "0"))))
    return df.select("o_orderkey", geometry.is_valid("geom").alias("valid"), geometry.is_simple("geom").alias("simple"), geometry.invalid_reason("geom").alias("reason"))


def _square(x: str, y: str, side: int, outer: bool = True) -> F.Column:
    """The text of a square ring, clockwise if it is an outer one."""
    across, up = [(f"{x} + {side}", y)], [(x, f"{y} + {side}")]
    middle = [(f"{x} + {side}", f"{y} + {side}")]
    way = [(x, y), *((up + middle + across) if outer else (across + middle + up)), (x, y)]
    at = [F.concat_ws(" ", F.expr(f"cast({a} as string)"), F.expr(f"cast({b} as string)")) for a, b in way]
    return F.concat(F.lit("("), F.concat_ws(",", *at), F.lit(")"))


@query("""SELECT o_orderkey, p > 0 AND p < 7 AND q > 0 AND q < 7 AS valid FROM (SELECT o_orderkey, o_orderkey % 17 - 5 AS p, o_custkey % 16 - 5 AS q FROM orders)""")
def holes_in_rings(spark, sf):
    """A square with a square hole that lies inside, outside, across, or shares a piece of its border, as the keys have it."""
    df = spread(table(spark, sf, "orders").selectExpr("o_orderkey", "cast(o_orderkey % 17 - 5 as int) as p", "cast(o_custkey % 16 - 5 as int) as q"))
    text = F.concat(F.lit("POLYGON("), _square("0", "0", 10), F.lit(","), _square("p", "q", 3, False), F.lit(")"))
    return df.select("o_orderkey", geometry.is_valid(geometry.from_wkt(text)).alias("valid"))


@query("""SELECT o_orderkey, CASE WHEN p = 4 AND q = 4 THEN 'two rings share a piece' WHEN abs(p - 4) < 4 AND abs(q - 4) < 4 AND (p = 4 OR q = 4) THEN 'two rings share a piece' WHEN abs(p - 4) = 4 AND abs(q - 4) < 4 OR abs(q - 4) = 4 AND abs(p - 4) < 4 THEN 'two rings share a piece'
    WHEN abs(p - 4) < 4 AND abs(q - 4) < 4 THEN 'two parts overlap' END AS reason FROM (SELECT o_orderkey, o_orderkey % 11 AS p, o_custkey % 13 AS q FROM orders)""")
def parts_of_areas(spark, sf):
    """Two squares of a multipolygon: apart, touching in a corner (valid), sharing a piece of their borders or overlapping."""
    df = spread(table(spark, sf, "orders").selectExpr("o_orderkey", "cast(o_orderkey % 11 as int) as p", "cast(o_custkey % 13 as int) as q"))
    text = F.concat(F.lit("MULTIPOLYGON(("), _square("4", "4", 4), F.lit("),("), _square("p", "q", 4), F.lit("))"))
    return df.select("o_orderkey", geometry.invalid_reason(geometry.from_wkt(text)).alias("reason"))


@query("SELECT o_orderkey, q > 0 AND 5 * r + 9 > 6 * q AS simple FROM (SELECT o_orderkey, o_orderkey % 5 AS q, o_custkey % 7 + 1 AS r FROM orders)")
def crossing_lines(spark, sf):
    """Lines of three segments, the last of which crosses the first one or passes it by; some begin with a repeated point."""
    df = table(spark, sf, "orders").selectExpr("o_orderkey", "o_orderkey % 5 as q", "o_custkey % 7 + 1 as r")
    df = df.withColumn("geom", geometry.from_wkt(_wkt("LINESTRING", ("0", "0"), ("q", "0"), ("9", "5"), ("r", "-1"))))
    return df.select("o_orderkey", geometry.is_simple("geom").alias("simple"))


def bent_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that go a right and then b up."""
    return bent(customers(spark, sf))


def bent(df: DataFrame) -> DataFrame:
    """The lines of customers."""
    df = df.withColumns({"a": F.expr("c_custkey % 9 + 1"), "b": F.expr("c_custkey % 6 + 1")})
    return df.withColumn("geom", geometry.from_wkt(_wkt("LINESTRING", ("x", "y"), ("x + a", "y"), ("x + a", "y + b"))))


_BENT = "(SELECT *, c_custkey % 9 + 1 AS a, c_custkey % 6 + 1 AS b FROM " + _C + ")"


@query(f"""SELECT id, (a + b)::DOUBLE AS length, x + least((a + b) / 2e0, a) AS mx, y + greatest((a + b) / 2e0 - a, 0) AS my, x + least(1.5e0, a) AS px, y + greatest(1.5e0 - a, 0) AS py,
    round((a * (x + a / 2e0) + b * (x + a)) / (a + b), 6) AS cx, 1 AS moves, 2 AS draws FROM {_BENT}""")
def line_functions(spark, sf):
    df = bent_lines(spark, sf)
    m, p, c, v = geometry.middle_point("geom"), geometry.point_at_length("geom", F.lit(1.5)), geometry.centroid("geom"), geometry.vertices("geom")
    of = lambda k: F.size(F.filter(v, lambda x: x["cmd"] == k))
    return df.select("id", geometry.path_length("geom").alias("length"), m["x"].alias("mx"), m["y"].alias("my"), p["x"].alias("px"), p["y"].alias("py"), F.round(c["x"], 6).alias("cx"), of(1).alias("moves"), of(2).alias("draws"))


@query(f"SELECT id, (2 * x + 3)::DOUBLE AS minx, (2 * (x + a) + 3)::DOUBLE AS maxx, (0 - y - b)::DOUBLE AS miny, (0 - y)::DOUBLE AS maxy FROM {_BENT}")
def affine_lines(spark, sf):
    moved = geometry.affine("geom", *map(F.lit, (2.0, 0.0, 0.0, -1.0, 3.0, 0.0)))
    e = geometry.envelope(moved)
    return bent_lines(spark, sf).select("id", *[e[c].alias(c) for c in ("minx", "maxx", "miny", "maxy")])


@query(f"SELECT id, round(mx, 4) + 0 AS mx, round(my, 4) + 0 AS my FROM (SELECT *, {_MERC} FROM {_C})")
def reprojected_wkb(spark, sf):
    df = customers(spark, sf)
    c = geometry.centroid(geometry.reproject("epsg:4326", "epsg:3857")(geometry.from_wkt(_int_wkt(df))))
    return df.select("id", (F.round(c["x"], 4) + 0).alias("mx"), (F.round(c["y"], 4) + 0).alias("my"))


@query(f"SELECT id, 'M' || x::INTEGER || ' ' || y::INTEGER || 'L' || (x + a)::INTEGER || ' ' || y::INTEGER || 'L' || (x + a)::INTEGER || ' ' || (y + b)::INTEGER AS path, 'LINESTRING(' || x::INTEGER || ' ' || y::INTEGER || ',' || (x + a)::INTEGER || ' ' || y::INTEGER || ',' || (x + a)::INTEGER || ' ' || (y + b)::INTEGER || ')' AS wkt, 2 AS kind FROM {_BENT}")
def line_codecs(spark, sf):
    """SVG paths, and lines through WKB of both byte orders and GeoJSON."""
    df = bent_lines(spark, sf)
    through = geometry.from_geojson(geometry.to_geojson(geometry.big_endian_wkb("geom")))
    return df.select("id", geometry.to_svg_path("geom").alias("path"), geometry.to_wkt(through).alias("wkt"), geometry.wkb_kind(geometry.big_endian_wkb("geom")).alias("kind"))


@query(f"SELECT id, least(sqrt(pow(greatest(x, -x - a, 0), 2) + y * y), sqrt(pow(x + a, 2) + pow(greatest(y, -y - b, 0), 2))) < 20 AS near, round(least(sqrt(pow(greatest(x, -x - a, 0), 2) + y * y), sqrt(pow(x + a, 2) + pow(greatest(y, -y - b, 0), 2))), 6) AS distance FROM {_BENT}")
def line_hits(spark, sf):
    """Lines nearer than 20 to the origin, and how near."""
    at = F.lit(0.0)
    return bent_lines(spark, sf).select("id", geometry.hit("geom", at, at, F.lit(20.0)).alias("near"), F.round(geometry.closest_point("geom", at, at)["distance"], 6).alias("distance"))


# --- labels, groups, grids ---------------------------------------------------------------


@query(f"SELECT px, py, max(id) AS feature FROM (SELECT id, floor((x + 180) * 256e0 / 360e0)::INTEGER AS px, floor((90 - y) * 256e0 / 180e0)::INTEGER AS py FROM {_C}) WHERE px BETWEEN 0 AND 255 AND py BETWEEN 0 AND 255 GROUP BY px, py")
def grid_points(spark, sf):
    return grid.point_grid(customers(spark, sf), WORLD)


@query(f"SELECT id, c_name AS key, c_mktsegment FROM customer JOIN (SELECT max(id) AS id FROM (SELECT id, floor((x + 180) * 256e0 / 360e0)::INTEGER AS px, floor((90 - y) * 256e0 / 180e0)::INTEGER AS py FROM {_C}) WHERE px BETWEEN 0 AND 255 AND py BETWEEN 0 AND 255 GROUP BY px, py) ON c_custkey = id")
def grid_keys(spark, sf):
    c = customers(spark, sf)
    return grid.key_dictionary(grid.point_grid(c, WORLD), c, "c_name", ("c_mktsegment",)).select("id", "key", "c_mktsegment")


@query("""SELECT l_orderkey, l_linenumber, i AS sub_id, v, CASE WHEN v > 1000 THEN 'big' ELSE 'small' END AS rule_name, l_returnflag || i AS repeat_key FROM (
    SELECT *, unnest([1, 2, 3])::BIGINT AS i FROM lineitem) t, LATERAL (SELECT CASE i WHEN 1 THEN l_quantity WHEN 2 THEN l_extendedprice ELSE l_tax END AS v) WHERE v > 0.01""")
def group_unpivot(spark, sf):
    df = table(spark, sf, "lineitem").withColumns({"v1": F.col("l_quantity"), "v2": F.col("l_extendedprice"), "v3": F.col("l_tax")})
    rules = [(spec.Rule("a", "[v] > 1000"), "big"), (spec.Rule("b", "[v] > 0.01"), "small")]
    out = labels.unpivot_group(df, {"v": "v%", "n": "%"}, 1, 3, rules, "[l_returnflag] + [sub_id]")
    return out.select("l_orderkey", "l_linenumber", "sub_id", "v", "rule_name", "repeat_key")


def _greedy_sql(group: str, columns: str) -> str:
    """Boxes of each group taken one after the other: a list of the placed ones is carried from row to row."""
    far = lambda d: f"c.x0 <= p.x1 + {d} AND c.x1 >= p.x0 - {d} AND c.y0 <= p.y1 + {d} AND c.y1 >= p.y0 - {d}"
    ok = f"len(list_filter(r.done, lambda p: ({far('0.5e0')}) OR (c.t = p.t AND {far('4e0')}))) = 0"
    return f"""WITH RECURSIVE b AS (SELECT id, c_mktsegment AS t, x - 2 AS x0, y - 2 AS y0, x + 2 AS x1, y + 2 AS y1, c_acctbal, {group} AS tile FROM {_C}),
        c AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY -c_acctbal, id) AS k FROM b),
        r AS (SELECT DISTINCT tile, 0::BIGINT AS k, 0::BIGINT AS id, false AS ok, []::STRUCT(x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, t VARCHAR)[] AS done FROM c
            UNION ALL SELECT r.tile, c.k, c.id, {ok}, CASE WHEN {ok} THEN list_append(r.done, {{'x0': c.x0, 'y0': c.y0, 'x1': c.x1, 'y1': c.y1, 't': c.t}}) ELSE r.done END FROM r JOIN c ON c.tile = r.tile AND c.k = r.k + 1)
        SELECT {columns}, ok AS placed FROM r WHERE k > 0"""


@query(_greedy_sql("floor(x / 30)::BIGINT || '/' || floor(y / 30)::BIGINT", "id, tile"))
def label_collision(spark, sf):
    """Greedy placement of customers' labels by tile, the richest first."""
    df = customers(spark, sf).withColumn("tile", F.concat_ws("/", F.floor(F.col("x") / 30), F.floor(F.col("y") / 30)))
    b = Box.around(F.col("x"), F.col("y"), 2.0)
    df = df.select("id", "tile", "c_mktsegment", (-F.col("c_acctbal")).alias("rank"), *[c.alias(n) for c, n in zip(b.parts(), ("minx", "miny", "maxx", "maxy"))])
    return labels.place_labels(df, "tile", ["rank", "id"], (-180.0, -90.0, 180.0, 90.0), 0.5, 4.0, "c_mktsegment").select("id", "tile", "placed")


@query(_greedy_sql("'all'", "id"))
def label_collision_everywhere(spark, sf):
    """The same over one map, tile borders or not; tests compare with boxes placed one by one."""
    b = Box.around(F.col("x"), F.col("y"), 2.0)
    df = customers(spark, sf).select("id", "c_mktsegment", (-F.col("c_acctbal")).alias("rank"), *[c.alias(n) for c, n in zip(b.parts(), ("minx", "miny", "maxx", "maxy"))])
    return labels.place_labels_everywhere(df, [("rank", True), ("id", True)], 9.0, 0.5, 4.0, "c_mktsegment").select("id", "placed")


@query(f"SELECT id, x + 5e0 AS x, y AS y, 0e0 AS angle FROM {_C}")
def marker_placement(spark, sf):
    df = customers(spark, sf)
    text = F.concat(F.lit("LINESTRING("), F.col("x").cast("string"), F.lit(" "), F.col("y").cast("string"), F.lit(","), (F.col("x") + 10).cast("string"), F.lit(" "), F.col("y").cast("string"), F.lit(")"))
    lines = df.select("id", geometry.from_wkt(text).alias("geom"))
    return labels.markers(lines, "line", 10.0).select("id", "x", "y", "angle")


@query("SELECT p_partkey, s AS size, d AS direction, ((i - 1) * 2 + j - 1)::INTEGER AS option FROM part, (SELECT unnest([12, 10, 8]) AS s, unnest([1, 2, 3]) AS i), (SELECT unnest(['N', 'S']) AS d, unnest([1, 2]) AS j)")
def label_alternatives(spark, sf):
    return labels.text_alternatives(table(spark, sf, "part").select("p_partkey"), [12, 10, 8], ["N", "S"]).select("p_partkey", "size", "direction", "option")


# --- rasters ---------------------------------------------------------------

COLORS = raster.Colorizer((raster.Stop(20, (0, 0, 255, 255), "discrete"), raster.Stop(100, (0, 255, 0, 255), "linear"), raster.Stop(200, (255, 0, 0, 255), "exact")), "linear", (9, 9, 9, 9))


@query(f"""SELECT x, y, CASE WHEN value = 7 THEN 0 WHEN value < 20 THEN 9 WHEN value < 100 THEN 0 WHEN value < 200 THEN floor(0::FLOAT + (value::FLOAT - 100::FLOAT) / 100::FLOAT * 255::FLOAT)::INTEGER WHEN value = 200 THEN 255 ELSE 9 END AS r,
    CASE WHEN value = 7 THEN 0 WHEN value < 20 THEN 9 WHEN value < 100 THEN 255 WHEN value < 200 THEN 0 WHEN value = 200 THEN 0 ELSE 9 END AS b FROM {_PX}""")
def raster_colorizer(spark, sf):
    return raster.nested_case(pixels(spark, sf), COLORS, "value", 7.0).select("x", "y", "r", "b")


@query(f"SELECT (x * 2 + i)::INTEGER AS x, (y * 2 + j)::INTEGER AS y, value FROM {_PX}, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)")
def raster_scale_nearest(spark, sf):
    return raster.nearest_scale(pixels(spark, sf), 64, 64, 128, 128).select("x", "y", "value")


@query(f"SELECT (x // 4)::INTEGER AS x, (y // 4)::INTEGER AS y, round(avg(value), 6) AS value FROM {_PX} GROUP BY 1, 2")
def raster_overview(spark, sf):
    return raster.block_mean(pixels(spark, sf), 4).select("x", "y", F.round("value", 6).alias("value"))


@query(f"SELECT x, y, (r * a + 127) // 255 AS r, CASE WHEN a = 0 THEN 0 ELSE least((((g * a + 127) // 255) * 255) // a, 255) END AS g, a FROM {_rgba_sql()}")
def raster_premultiply(spark, sf):
    p = raster.premultiply(rgba(spark, sf))
    return p.select("x", "y", "r", F.expr("CASE WHEN a = 0 THEN 0 ELSE least((g * 255) div a, 255) END").cast("int").alias("g"), "a")


@query(f"""SELECT x, y, CASE WHEN al = 0 THEN 0 ELSE floor(least(greatest(cr / al, 0), 1) * 255 + 0.5e0)::INTEGER END AS r, floor(al * 255 + 0.5e0)::INTEGER AS a FROM (
    SELECT d.x, d.y, s.a / 255e0 + d.a / 255e0 * (1 - s.a / 255e0) AS al, s.a / 255e0 * (s.r / 255e0) + d.a / 255e0 * (1 - s.a / 255e0) * (d.r / 255e0) AS cr FROM {_rgba_sql()} d JOIN {_rgba_sql(1)} s ON d.x = s.x AND d.y = s.y)""")
def raster_composite(spark, sf):
    return raster.composite(rgba(spark, sf, 1), rgba(spark, sf)).select("x", "y", "r", "a")


@query(f"""SELECT x, y, CASE WHEN al = 0 THEN 0 ELSE floor(least(greatest(cr / al, 0), 1) * 255 + 0.5e0)::INTEGER END AS r, floor(al * 255 + 0.5e0)::INTEGER AS a FROM (
    SELECT x, y, sa + da - sa * da AS al, sa * da * (sr * dr) + sa * (1 - da) * sr + da * (1 - sa) * dr AS cr FROM (SELECT d.x, d.y, s.a / 255e0 AS sa, d.a / 255e0 AS da, s.r / 255e0 AS sr, d.r / 255e0 AS dr FROM {_rgba_sql()} d JOIN {_rgba_sql(1)} s ON d.x = s.x AND d.y = s.y))""")
def raster_multiply(spark, sf):
    return raster.composite(rgba(spark, sf, 1), rgba(spark, sf), "multiply").select("x", "y", "r", "a")


def _near_sql(mirror: bool = True) -> str:
    """Pixels with their eight neighbours p0 .. p8, row by row, as the filters see them at the borders."""
    def near(f: str, by: str, across: str, n: str) -> str:
        window = f"OVER (PARTITION BY {across} ORDER BY {by})"
        return f"CASE WHEN {f}({by}) {window} = {by} {'-' if f == 'lag' else '+'} 1 THEN {f}({n}) {window} END"

    wide = f"(SELECT x, y, coalesce({near('lag', 'x', 'y', 'v')}, v) AS l, v AS c, coalesce({near('lead', 'x', 'y', 'v')}, v) AS r FROM (SELECT x, y, value::FLOAT AS v FROM {_PX}))"
    side = lambda n, *fs: "coalesce(" + ", ".join([*(near(f, "y", "x", n) for f in (fs if mirror else fs[:1])), n]) + ")"
    up, down = (lambda n: side(n, "lag", "lead")), (lambda n: side(n, "lead", "lag"))
    return f"(SELECT x, y, {', '.join(f'{up(n)} AS p{i}, {n} AS p{i + 3}, {down(n)} AS p{i + 6}' for i, n in enumerate('lcr'))} FROM {wide})"


def _filter_sql(kind: str) -> str:
    total = " + ".join(f"{w}::FLOAT * p{i}" for i, w in enumerate(raster.FILTERS[kind]))
    return f"SELECT x, y, floor(greatest(least({total}, 255::FLOAT), 0::FLOAT))::INTEGER AS value FROM {_near_sql()}"


@query(_filter_sql("blur"))
def raster_blur(spark, sf):
    return raster.convolve_pixels(pixels(spark, sf), "blur").select("x", "y", "value")


@query(_filter_sql("sharpen"))
def raster_sharpen(spark, sf):
    return raster.convolve_pixels(pixels(spark, sf), "sharpen").select("x", "y", "value")


@query(_filter_sql("emboss"))
def raster_emboss(spark, sf):
    return raster.convolve_pixels(pixels(spark, sf), "emboss").select("x", "y", "value")


@query(_filter_sql("edge-detect"))
def raster_edges(spark, sf):
    return raster.convolve_pixels(pixels(spark, sf), "edge-detect").select("x", "y", "value")


@query(f"SELECT x, y, floor(least(sqrt(pow(((p2 + 2 * p5 + p8) - (p0 + 2 * p3 + p6))::DOUBLE, 2) + pow(((p0 + 2 * p1 + p2) - (p6 + 2 * p7 + p8))::DOUBLE, 2)), 255))::INTEGER AS value FROM {_near_sql()}")
def raster_sobel(spark, sf):
    return raster.convolve_pixels(pixels(spark, sf), "sobel").select("x", "y", "value")


@query(f"SELECT x, y, (128 + trunc((p3 - p5) / 2))::INTEGER AS value FROM {_near_sql(False)}")
def raster_x_gradient(spark, sf):
    return raster.convolve_pixels(pixels(spark, sf), "x-gradient").select("x", "y", "value")


@query(f"SELECT x, y, (128 + trunc((p1 - p7) / 2))::INTEGER AS value FROM {_near_sql(False)}")
def raster_y_gradient(spark, sf):
    return raster.convolve_pixels(pixels(spark, sf), "y-gradient").select("x", "y", "value")


_PRE = f"(SELECT x, y, a, {', '.join(f'(({c} * a + 127) // 255)::INTEGER AS {c}' for c in 'rgb')} FROM {_rgba_sql()})"


@query(f"SELECT x, y, a - r AS r, ((4915 * r + 9667 * g + 1802 * b + 8192) >> 14)::INTEGER AS luma FROM {_PRE}")
def raster_invert_gray(spark, sf):
    """Pixels with channels above their alpha too: filters premultiply first."""
    df = rgba(spark, sf)
    luma = raster.gray(df).select("x", "y", F.col("r").alias("luma"))
    return raster.invert(df).select("x", "y", "r").join(luma, ["x", "y"])


@query(f"SELECT x, y, (arg_min(i, dd * 10 + i))::INTEGER AS palette_index FROM (SELECT p.x, p.y, c.i, (p.r - c.r) * (p.r - c.r) + (p.g - c.r) * (p.g - c.r) + (p.b - c.r) * (p.b - c.r) + (p.a - 255) * (p.a - 255) AS dd FROM {_rgba_sql()} p, (SELECT unnest([0, 128, 255]) AS r, unnest([0, 1, 2]) AS i) c) GROUP BY x, y")
def raster_palette(spark, sf):
    return raster.quantize(rgba(spark, sf), [(0, 0, 0, 255), (128, 128, 128, 255), (255, 255, 255, 255)]).select("x", "y", "palette_index")


@query(f"SELECT count(*) FILTER (WHERE abs(p.r - q.r) > 16) AS n_different FROM {_rgba_sql()} p JOIN {_rgba_sql(1)} q ON p.x = q.x AND p.y = q.y")
def raster_compare(spark, sf):
    return aggregates.differing_pixels(rgba(spark, sf), rgba(spark, sf, 1), 16, value="r")


@query(f"SELECT min(value) = max(value) AS solid FROM {_PX}")
def raster_is_solid(spark, sf):
    return aggregates.is_solid(pixels(spark, sf))


@query(f"SELECT p.x, p.y, CASE WHEN p.a = 0 THEN 0 ELSE p.a // 2 END AS a, (p.r = 255 AND p.g = 255 AND p.b = 255) AS white FROM {_rgba_sql()} p")
def raster_opacity(spark, sf):
    df = raster.opacity(rgba(spark, sf), 0.5)
    return df.select("x", "y", "a", ((F.col("r") == 255) & (F.col("g") == 255) & (F.col("b") == 255)).alias("white"))


@query(f"SELECT x, y, least(greatest(value - 100, -128e0), 127e0)::BIGINT AS value FROM {_PX}")
def raster_cast(spark, sf):
    return raster.cast_pixels(pixels(spark, sf).withColumn("value", F.col("value") - 100), "gray8s")


@query(f"SELECT x, y, value FROM {_PX} WHERE x BETWEEN 8 AND 15 AND y BETWEEN 4 AND 7")
def raster_view(spark, sf):
    df = pixels(spark, sf).withColumnsRenamed({"x": "px", "y": "py"})
    return grid.view_part(df, 8, 4, 8, 4).withColumnsRenamed({"px": "x", "py": "y"})


@query(f"""SELECT t.x, t.y, p.value FROM (SELECT x, y, floor((degrees(wx / 6378137e0) + 180) * 64 / 360)::INTEGER AS sx, floor((90 - degrees(2 * atan(exp(wy / 6378137e0)) - pi() / 2)) * 64 / 180)::INTEGER AS sy FROM (
    SELECT i % 64 AS x, i // 64 AS y, -2e7 + (i % 64 + 0.5e0) * 4e7 / 64 AS wx, 2e7 - (i // 64 + 0.5e0) * 4e7 / 64 AS wy FROM (SELECT unnest(range(4096))::INTEGER AS i))) t JOIN {_PX} p ON p.x = t.sx AND p.y = t.sy""")
def raster_warp(spark, sf):
    """Longitudes and latitudes to the mercator plane, nearest pixels."""
    source = projection.View(64, 64, Extent(-180.0, -90.0, 180.0, 90.0))
    target = projection.View(64, 64, Extent(-2e7, -2e7, 2e7, 2e7))
    return raster.warp(pixels(spark, sf), source, projection.LONLAT, target, projection.MERCATOR)


def _blind_sql(kind: str) -> str:
    px, py, slope, cut = (f"{v!r}::DOUBLE" for v in raster.CONFUSION[kind])
    back = {c: [f"{v!r}::DOUBLE" for v in m] for c, m in zip("rgb", raster._FROM_XYZ)}
    to = [" + ".join(f"l{c} * {v!r}::DOUBLE" for c, v in zip("rgb", m)) for m in raster._TO_XYZ]
    nx, ny, nz = (f"{v!r}::DOUBLE" for v in raster._NEUTRAL)
    plain = ", ".join(f"gx * {m[0]} + lum * {m[1]} + gz * {m[2]} AS v{c}, ({nx} * lum / {ny} - gx) * {m[0]} + ({nz} * lum / {ny} - gz) * {m[2]} AS off_{c}" for c, m in back.items())
    fit = ", ".join(f"CASE WHEN off_{c} = 0 THEN NULL ELSE (CASE WHEN v{c} < 0 THEN 0e0 ELSE 1e0 END - v{c}) / off_{c} END AS f{c}" for c in "rgb")
    step = ", ".join(f"CASE WHEN f{c} BETWEEN 0 AND 1 THEN f{c} ELSE 0e0 END" for c in "rgb")
    out = ", ".join(f"CASE WHEN moved THEN ((coalesce(floor(least(CASE WHEN v{c} + step * off_{c} > 0 THEN pow(v{c} + step * off_{c}, 1e0 / 2.2e0) ELSE 0e0 END, 255e0))::INTEGER, 0) * a + 255) >> 8)::INTEGER ELSE {c} END AS {c}" for c in "rgb")
    return f"""(SELECT x, y, {out} FROM (SELECT *, greatest({step}) AS step FROM (SELECT *, {fit} FROM (SELECT *, {plain} FROM (
        SELECT *, mx * lum / my AS gx, (1e0 - (mx + my)) * lum / my AS gz, abs(slope - {slope}) >= 2.220446049250313e-16 IS TRUE AS moved FROM (SELECT *, slope * mx + cut AS my FROM (
        SELECT *, ({cut} - cut) / (slope - {slope}) AS mx FROM (SELECT *, ty - tx * slope AS cut FROM (SELECT *, CASE WHEN abs(tx - {px}) >= 2.220446049250313e-16 THEN (ty - {py}) / (tx - {px}) END AS slope FROM (
        SELECT *, CASE WHEN cx + lum + cz > 0 THEN cx / (cx + lum + cz) END AS tx, CASE WHEN cx + lum + cz > 0 THEN lum / (cx + lum + cz) END AS ty FROM (SELECT *, {to[0]} AS cx, {to[1]} AS lum, {to[2]} AS cz FROM (
        SELECT *, pow(r::DOUBLE, 2.2e0) AS lr, pow(g::DOUBLE, 2.2e0) AS lg, pow(b::DOUBLE, 2.2e0) AS lb FROM (SELECT x, y, a, {", ".join(f"CASE WHEN a = 0 THEN 0 ELSE {c} END AS {c}" for c in "rgb")} FROM {_rgba_sql()})))))))))))))"""


@query(f"SELECT x, y, r, g, b FROM {_blind_sql('deuteranope')}")
def raster_color_blind(spark, sf):
    return raster.color_blind(rgba(spark, sf), "deuteranope").select("x", "y", "r", "g", "b")


@query(f"SELECT 'protanope' AS kind, * FROM {_blind_sql('protanope')} UNION ALL SELECT 'tritanope', * FROM {_blind_sql('tritanope')}")
def raster_color_blind_kinds(spark, sf):
    one, other = (raster.color_blind(rgba(spark, sf), k).select(F.lit(k).alias("kind"), "x", "y", "r", "g", "b") for k in ("protanope", "tritanope"))
    return one.unionByName(other)


# --- sources ---------------------------------------------------------------

_N = "(SELECT n_nationkey AS k, n_name AS name, ((n_nationkey * 37) % 360 - 180)::DOUBLE AS x, ((n_nationkey * 17) % 170 - 85)::DOUBLE AS y, row_number() OVER (ORDER BY n_nationkey) AS id FROM nation)"


def places(spark: SparkSession, sf: str) -> list[fixtures.Row]:
    """All of nation (25 rows at any scale), for files that hold a whole small table."""
    return [(r["n_nationkey"], r["n_name"], float(r["n_nationkey"] * 37 % 360 - 180), float(r["n_nationkey"] * 17 % 170 - 85)) for r in table(spark, sf, "nation").orderBy("n_nationkey").collect()]


def _stored(spark: SparkSession, name: str, data: bytes) -> str:
    return scratch.put(spark, f"{scratch.folder(spark)}/{name}", data)


@query(f"SELECT id, x, y, name, k::BIGINT AS key FROM {_N}")
def source_csv(spark, sf):
    return registry.create(spark, {"type": "csv", "inline": fixtures.csv_text(places(spark, sf))}).df.select("id", "x", "y", "name", "key")


@query(f"SELECT id, x, y, name, k::BIGINT AS key FROM {_N}")
def source_csv_sniffed(spark, sf):
    """Bars as separators, found by themselves."""
    path = _stored(spark, "places.txt", fixtures.csv_text(places(spark, sf), "|").encode())
    return registry.create(spark, {"type": "csv", "file": path}).df.select("id", "x", "y", "name", "key")


@query(f"SELECT row_number() OVER (ORDER BY c_custkey) AS id, x, y, c_name AS name, c_custkey AS key FROM {_C}")
def source_csv_files(spark, sf):
    """All customers from many files, numbered in the order of files and lines."""
    df = customers(spark, sf)
    folder = scratch.folder(spark)
    df.orderBy("c_custkey").select(F.concat_ws(";", "x", "y", "c_name", "c_custkey").alias("value")).write.text(folder)
    return registry.create(spark, {"type": "csv", "file": folder, "headers": "lon;lat;name;key", "separator": ";"}).df.select("id", "x", "y", "name", "key")


@query(f"SELECT id, name, k::BIGINT AS key, x AS minx, y AS miny, x + 1 AS maxx, y + 2 AS maxy, 2 AS geom_type FROM {_N}")
def source_geojson(spark, sf):
    return registry.create(spark, {"type": "geojson", "inline": fixtures.geojson_text(places(spark, sf))}).df.select("id", "name", "key", "minx", "miny", "maxx", "maxy", "geom_type")


@query(f"SELECT id, name, 'LINESTRING(' || x::INTEGER || ' ' || y::INTEGER || ',' || (x + 1)::INTEGER || ' ' || (y + 1)::INTEGER || ',' || (x + 3)::INTEGER || ' ' || (y + 1)::INTEGER || ')' AS wkt FROM {_N}")
def source_topojson(spark, sf):
    return registry.create(spark, {"type": "topojson", "inline": fixtures.topojson_text(places(spark, sf))}).df.select("id", "name", geometry.to_wkt("geom").alias("wkt"))


@query(f"SELECT id, name, k::BIGINT AS key, x, y FROM {_N}")
def source_geobuf(spark, sf):
    path = _stored(spark, "places.pbf", fixtures.geobuf_bytes(places(spark, sf)))
    return registry.create(spark, {"type": "geobuf", "file": path}).df.select("id", "name", "key", F.col("minx").alias("x"), F.col("maxy").alias("y"))


@query(f"SELECT id, name AS NAME, k::BIGINT AS KEY, k / 8e0 AS SHARE, k % 2 = 0 AS EVEN, x, y, 1 AS geom_type FROM {_N}")
def source_shape(spark, sf):
    folder, rows = scratch.folder(spark), places(spark, sf)
    scratch.put(spark, f"{folder}/places.shp", fixtures.shape_bytes(rows))
    scratch.put(spark, f"{folder}/places.dbf", fixtures.dbf_bytes(rows))
    return registry.create(spark, {"type": "shape", "file": f"{folder}/places.shp"}).df.select("id", "NAME", "KEY", F.round("SHARE", 3).alias("SHARE"), "EVEN", F.col("minx").alias("x"), F.col("maxy").alias("y"), "geom_type")


@query(f"SELECT id, name, k / 4e0 AS share, x, y FROM {_N}")
def source_sqlite(spark, sf):
    path = _stored(spark, "places.sqlite", fixtures.sqlite_bytes(places(spark, sf)))
    return registry.create(spark, {"type": "sqlite", "file": path, "table": "places", "key_field": "id"}).df.select("id", "name", "share", F.col("minx").alias("x"), F.col("maxy").alias("y"))


@query(f"SELECT row_number() OVER (ORDER BY id) AS id, name FROM (SELECT * FROM {_N} ORDER BY id LIMIT 7 OFFSET 3)")
def source_sqlite_subquery(spark, sf):
    """A subquery with a limit and an offset, as the source has them."""
    path = _stored(spark, "places.sqlite", fixtures.sqlite_bytes(places(spark, sf)))
    return registry.create(spark, {"type": "sqlite", "file": path, "table": "(SELECT * FROM places ORDER BY id)", "key_field": "id", "row_limit": "7", "row_offset": "3"}).df.select("id", "name")


_TILE = f"SELECT k::BIGINT AS id, 'places' AS layer, '\"' || name || '\"' AS name, round(x * {projection.CIRCUMFERENCE!r}::DOUBLE / 4096 - {projection.CIRCUMFERENCE!r}::DOUBLE / 2, 3) AS x, round({projection.CIRCUMFERENCE!r}::DOUBLE / 2 - y * {projection.CIRCUMFERENCE!r}::DOUBLE / 4096, 3) AS y FROM {_N}"


def _tile_rows(df: DataFrame) -> DataFrame:
    e = geometry.envelope("geom")
    return df.select("id", "layer", F.col("props")["name"].alias("name"), F.round(e["minx"], 3).alias("x"), F.round(e["miny"], 3).alias("y"))


@query(_TILE)
def source_mbtiles(spark, sf):
    return _tile_rows(binary_tables.tiles(spark, _stored(spark, "places.mbtiles", fixtures.mbtiles_bytes(places(spark, sf))), 0, (0, 0, 0, 0)))


@query(_TILE)
def source_pmtiles(spark, sf):
    return _tile_rows(binary_tables.tiles(spark, _stored(spark, "places.pmtiles", fixtures.pmtiles_bytes(places(spark, sf))), 0, (0, 0, 0, 0)))


@query("SELECT 1::BIGINT AS id, (n_nationkey % 5)::INTEGER AS x, (n_nationkey // 5)::INTEGER AS y, CASE WHEN n_nationkey <> 7 THEN n_nationkey::DOUBLE END AS value FROM nation")
def source_raster_blob(spark, sf):
    a = np.array([k for k, *_ in places(spark, sf)]).reshape(5, 5)
    return binary_tables.raster_pixels(spark.createDataFrame([(1, bytearray(fixtures.raster_blob(a, 7)))], "id long, raster binary"))


@query("SELECT (n_nationkey % 5)::INTEGER AS x, (n_nationkey // 5)::INTEGER AS y, CASE WHEN n_nationkey <> 7 THEN n_nationkey * 1.5e0 END AS value FROM nation")
def source_ascii_grid(spark, sf):
    keys = [k for k, *_ in places(spark, sf)]
    lines = [" ".join(str(k * 1.5) if k != 7 else "-9" for k in keys[i : i + 5]) for i in range(0, 25, 5)]
    text = "\n".join(["ncols 5", "nrows 5", "xllcorner 0", "yllcorner 0", "cellsize 10", "NODATA_value -9", *lines]) + "\n"
    return binary_tables.ascii_grid(spark, _stored(spark, "grid.asc", text.encode()))[1]


@query(f"SELECT k::BIGINT AS id, name, x AS minx, x + 2 AS maxx, 2 AS geom_type FROM {_N}")
def source_memory(spark, sf):
    rows = [(k, f"LINESTRING({x} {y},{x + 2} {y})", {"name": n}) for k, n, x, y in places(spark, sf)]
    return registry.memory(spark, rows, "name string").df.select("id", "name", "minx", "maxx", "geom_type")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000")
def source_parquet(spark, sf):
    t = registry.create(spark, {"type": "parquet", "file": f"{sf.rstrip('/')}/orders.parquet"})
    return expression.where(t.df, "[o_totalprice] > 1000").select("o_orderkey", "o_totalprice")


_FULL = f"(SELECT g.x, g.y, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b, coalesce(a, 0) AS a FROM (SELECT (i % 64)::INTEGER AS x, (i // 64)::INTEGER AS y FROM (SELECT unnest(range(4096)) AS i)) g LEFT JOIN {_rgba_sql()} p ON p.x = g.x AND p.y = g.y)"


@query(f"SELECT x, y, r, g, b, a FROM {_FULL}")
def raster_png(spark, sf):
    """Pixels written as PNG tiles of 16 by 16 and read back from them; where there is none, the tiles are clear."""
    return images.pixels(images.to_png(rgba(spark, sf), 16))


@query(f"SELECT x - 8 AS x, y - 4 AS y, r, g, b, a FROM {_FULL} WHERE x BETWEEN 8 AND 23 AND y BETWEEN 4 AND 35")
def raster_png_window(spark, sf):
    """A part of one image that holds all pixels."""
    part = images.pixels(images.to_png(rgba(spark, sf), 64).select("content"), window=(8, 4, 16, 32))
    return part.select((F.col("x") - 8).alias("x"), (F.col("y") - 4).alias("y"), *"rgba")


@query("""SELECT c_custkey, c_custkey % 7 * 0.5e0 AS width, 1e0 AS height, c_acctbal > 0 AS allow_overlap, FALSE AS clip, 1e0 AS opacity, CASE WHEN c_custkey % 3 = 0 THEN 'each' WHEN c_custkey % 3 = 1 THEN 'whole' ELSE 'each' END AS multi_policy,
    255 AS fill_r, 136 AS fill_g, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 17 * (c_custkey % 3 + 7) END AS stroke_r, 'icons/' || c_mktsegment || '.svg' AS file, 1 + c_custkey % 7 * 0.5e0 AS a, 10e0 AS e FROM customer""")
def symbolizer_properties(spark, sf):
    """Constants, expressions and defaults of a symbolizer's properties, row by row."""
    df = table(spark, sf, "customer").withColumns({
        "w": F.expr("c_custkey % 7 * 0.5e0"), "how": F.expr("case c_custkey % 3 when 0 then 'each' when 1 then 'whole' else 'nonsense' end"), "ink": F.expr("case c_custkey % 3 when 0 then 'black' else concat('#', c_custkey % 3 + 7, '00') end"),
    })
    s = spec.Symbolizer("markers", {"width": "[w]", "height": 1, "allow-overlap": "[c_acctbal] > 0", "multi-policy": "[how]", "fill": "#f80", "stroke": "[ink]", "file": "icons/[c_mktsegment].svg", "transform": "translate(10, 0) scale(1 + [w], 1)"})
    keys = ["width", "height", "allow-overlap", "clip", "opacity", "multi-policy", "fill", "stroke", "file", "transform"]
    out = properties.with_properties(df, s, keys)
    return out.select("c_custkey", "width", "height", "allow_overlap", "clip", "opacity", "multi_policy", F.col("fill.r").alias("fill_r"), F.col("fill.g").alias("fill_g"), F.col("stroke.r").alias("stroke_r"), "file", F.col("transform.a").alias("a"), F.col("transform.e").alias("e"))


@query(f"SELECT id, x AS minx, y AS miny, x + a AS maxx, y + b AS maxy FROM {_BENT}")
def geojson_line_boxes(spark, sf):
    """Boxes of features given as JSON lines, without building geometry."""
    lines = json_tables.to_geojson_lines(processor.SpatialTable(bent_lines(spark, sf)), [])
    return json_tables.bounding_boxes(lines).select(F.get_json_object("value", "$.id").cast("bigint").alias("id"), "minx", "miny", "maxx", "maxy")


@query("SELECT c_custkey AS id, cell, CASE cell WHEN '007' THEN 'string' WHEN '5' THEN 'bigint' WHEN '0.25' THEN 'double' WHEN 'true' THEN 'boolean' ELSE 'string' END AS kind FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '007' WHEN 1 THEN '5' WHEN 2 THEN '0.25' WHEN 3 THEN 'true' ELSE '' END AS cell FROM customer)")
def csv_cell_kinds(spark, sf):
    df = table(spark, sf, "customer").withColumn("cell", F.expr("CASE c_custkey % 5 WHEN 0 THEN '007' WHEN 1 THEN '5' WHEN 2 THEN '0.25' WHEN 3 THEN 'true' ELSE '' END"))
    return df.select(F.col("c_custkey").alias("id"), "cell", delimited.typed(F.col("cell"))["kind"].alias("kind"))


@query(f"SELECT id, '{{\"type\":\"Feature\",\"id\":' || id || ',\"geometry\":{{\"type\":\"Point\",\"coordinates\":[' || x::INTEGER || ',' || y::INTEGER || ']}},\"properties\":{{\"c_mktsegment\":\"' || c_mktsegment || '\"}}}}' AS value FROM {_C}")
def sink_geojson(spark, sf):
    df = customers(spark, sf)
    df = df.withColumn("geom", geometry.from_wkt(_int_wkt(df)))
    return json_tables.to_geojson_lines(processor.SpatialTable(df), ["c_mktsegment"]).select(F.get_json_object("value", "$.id").cast("bigint").alias("id"), "value")


# --- parts and policies ---------------------------------------------------------------


@query("SELECT l_orderkey AS id, max_by(l_linenumber, {'a': l_extendedprice, 'n': -l_linenumber}) AS part_no FROM lineitem GROUP BY 1")
def multi_policy_largest(spark, sf):
    df = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("part_no"), F.col("l_extendedprice").alias("area"))
    return labels.multi_policy(df, "largest").select("id", "part_no")


@query(f"SELECT c.id AS id, min_by(s.s_suppkey, {{'d': (c.x - s.ox) * (c.x - s.ox) + (c.y - s.oy) * (c.y - s.oy), 'k': s.s_suppkey}}) AS nearest FROM {_C} c JOIN {_S} s ON (c.x - s.ox) * (c.x - s.ox) + (c.y - s.oy) * (c.y - s.oy) <= 400 GROUP BY 1")
def nearest_neighbour(spark, sf):
    near = hits.nearest_within(customers(spark, sf).select("id", "x", "y"), suppliers(spark, sf), 20.0, "s_suppkey")
    return ordering.nearest(near, ["id"], F.col("nearest"), F.struct("apart", "nearest")).select("id", F.col("part").alias("nearest"))


@query("SELECT n_nationkey, round(-20037508.342789244e0 + n_nationkey % 8 * 40075016.68557849e0 / 8, 3) AS minx, round(20037508.342789244e0 - (n_nationkey % 8) * 40075016.68557849e0 / 8, 3) AS maxy, 7 - n_nationkey % 8 AS tms FROM nation")
def tile_boxes(spark, sf):
    df = table(spark, sf, "nation").withColumn("t", F.col("n_nationkey") % 8)
    b = projection.tile_box(F.col("t"), F.col("t"), 3)
    return df.select("n_nationkey", F.round(b.minx, 3).alias("minx"), F.round(b.maxy, 3).alias("maxy"), projection.tms_row(F.col("t"), F.lit(3)).alias("tms"))


# --- extensions: what Spark brings ---------------------------------------------------------------


@query("SELECT r_name, n_name, sum(o_totalprice)::DECIMAL(38, 2)::VARCHAR AS total, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def ext_star_join(spark, sf):
    t = lambda n: table(spark, sf, n)
    j = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.sum(F.col("o_totalprice").cast("decimal(28,6)")).cast("decimal(38,2)").cast("string").alias("total"), F.count("*").alias("n"))


@query("SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS start, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def ext_event_hours(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", F.window("ts", "1 hour")["start"].alias("start")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS rank FROM events")
def ext_event_rank(spark, sf):
    return table(spark, sf, "events").select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("rank"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, grouping_id(l_returnflag, l_linestatus)::BIGINT AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def ext_cube(spark, sf):
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
