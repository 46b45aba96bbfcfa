import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlasq.functions import boxes, projection
from atlasq.functions.boxes import Extent
from atlasq.operators import hits, labels, ordering, raster
from atlasq.plans import catalog, processor, registered, spec
from atlasq.sources import registry, scratch

XML = """<Map width="256" height="256" srs="epsg:4326" extent="-10,-10,10,10" aspect-mode="RESPECT">
<Style name="s" filter-mode="all"><Rule name="a"><Filter>[n] &gt; 1</Filter><PointSymbolizer allow-overlap="true"/></Rule><Rule name="b"><ElseFilter/><DotSymbolizer/></Rule>
<Rule name="c"><MaxScaleDenominator>10</MaxScaleDenominator><PointSymbolizer/></Rule></Style>
<Layer name="l" queryable="true" sort-by="n DESC"><StyleName>s</StyleName><Datasource><Parameter name="type">csv</Parameter><Parameter name="inline">x,y,n
1,1,1
2,2,2
50,50,3
3,3,5</Parameter></Datasource></Layer></Map>"""


def test_map_xml_and_run(spark):
    m = spec.load_map(XML, strict=True)
    assert spec.load_map(spec.save_map(m)) == m and spec.from_json(spec.to_json(m)).styles == m.styles
    tables = registry.tables_of(spark, m)
    rows = processor.draw_order(processor.run_map(m, tables)).select("id", "rule_name", "feature_no").collect()
    assert [tuple(r) for r in rows] == [(4, "a", 1), (2, "a", 2), (1, "b", 3)]
    assert processor.combined_extent(m, tables) == Extent(1, 1, 50, 50)
    assert [r.id for r in processor.query_point(m, tables, 0, 2.1, 2.0).collect()] == [2]
    with pytest.raises(ValueError):
        processor.query_point(m, tables, 0, 99, 0)
    with pytest.raises(IndexError):
        processor.query_point(m, tables, 5, 0, 0)
    with pytest.raises(ValueError):
        spec.load_map("<Map><Wrong/></Map>", strict=True)


def test_names_are_pruned():
    rule = spec.Rule("r", "[a] = 1 and length([b]) > 2", symbolizers=(spec.Symbolizer("text", {"name": "[c] + [d]", "file": "x/[e].png"}),))
    assert spec.needed_columns([rule], ("g",)) == {"a", "b", "c", "d", "e", "g"}
    with pytest.raises(ValueError):
        spec.Symbolizer("markers", {"placement": "nowhere"})


def test_projection():
    assert projection.project_point(*projection.project_point(7.5, 47.5, "epsg:4326", "epsg:3857"), "epsg:3857", "epsg:4326") == pytest.approx((7.5, 47.5))
    v = projection.View(200, 100, Extent(0, 0, 10, 10))
    assert v.forward(5, 5) == (100, 50) and v.backward(100, 50) == (5, 5)
    grown = projection.fixed_aspect(v)
    assert grown.extent == Extent(-5, 0, 15, 10)
    assert projection.fixed_aspect(v, "SHRINK_BBOX").extent == Extent(0, 2.5, 10, 7.5)
    assert projection.fixed_aspect(v, "ADJUST_CANVAS_HEIGHT").height == 200
    assert projection.zoomed(grown, 0.5).extent == Extent(0, 2.5, 10, 7.5) and projection.panned(grown, 0, 0).extent.center == (-5, 10)
    assert projection.tile_range(Extent(-1, -1, 1, 1), 1) == (0, 1, 0, 1)
    assert projection.zoom_of_scale(6e8, 22) == 0 and projection.zoom_of_scale(3e8, 22) == 0 and projection.zoom_of_scale(1.5e8, 22) == 1 and projection.zoom_of_scale(1000.0, 22) == 19 and projection.zoom_of_scale(1.0, 14) == 14 and projection.zoom_of_scale(100.0, 22) == 22
    with pytest.raises(NotImplementedError):
        projection.known("epsg:2056")
    assert projection.scale_denominator(1.0, False) == pytest.approx(1 / 0.00028)


def test_extents():
    a = Extent(0, 0, 2, 2)
    assert a.intersects(Extent(2, 2, 3, 3)) and not a.intersect(Extent(5, 5, 6, 6)).valid and a.clip(Extent(1, 1, 5, 5)) == Extent(1, 1, 2, 2)
    assert Extent.parse("1 2, 3,4") == Extent(1, 2, 3, 4) and a.resized(width=4) == Extent(-1, 0, 3, 2) and a.union(Extent(-1, 0, 0, 5)) == Extent(-1, 0, 2, 5)
    assert a.transformed((1, 0, 0, 1, 5, 0)) == Extent(5, 0, 7, 2)


def test_runs_over_partitions(spark):
    rows = [(i, k) for i, k in enumerate([None, None, "a", "a", "b", "a", "a", None, "c"] * 7)]
    got = [tuple(r) for r in ordering.runs(spark.createDataFrame(rows, "id int, k string").repartition(3), "k", "id").orderBy("run_id").select("run_id", "k", "n").collect()]
    want, last = [], object()
    for _, k in rows:
        if want and k == last:
            want[-1][2] += 1
        else:
            want.append([len(want) + 1, k, 1])
        last = k
    assert got == [tuple(w) for w in want]


def test_places_with_other_columns(spark):
    """Places and runs are those of one sort, whatever columns stay, over more rows than a task's, with ties and nulls."""
    from pyspark.sql import Window

    spark.conf.set("spark.sql.shuffle.partitions", "130")
    try:
        df = spark.range(20_000).selectExpr("id", "if(id % 11 = 0, null, (id * 7919) % 101) as v", "cast(id % 3 as string) as k", "repeat('x', cast(id % 7 as int)) as more")
        for text, order in (("v DESC", F.col("v").desc_nulls_last()), ("v", F.col("v").asc_nulls_last())):
            got = ordering.sort_by(df, text, number="place").withColumn("want", F.row_number().over(Window.orderBy(order, "id")))
            assert got.count() == 20_000 and got.where("place <> want").count() == 0 and got.columns == [*df.columns, "place", "want"]
        part = ordering.ranged(df, [("v", True), ("id", True)]).groupBy("_part").count()
        assert part.count() > 100 and part.agg(F.max("count")).first()[0] < 1000
        w = Window.orderBy("id")
        want = df.withColumn("new", F.when(F.lag("v").over(w).eqNullSafe(F.col("v")) & (F.col("id") > 0), 0).otherwise(1)).withColumn("want", F.sum("new").over(w))
        runs = ordering.group_runs(df, "v", "id").join(want.select("id", "want"), "id")
        assert runs.where("run_id <> want").count() == 0 and runs.count() == 20_000
        assert ordering.numbered(df.limit(0), [("id", True)], "n").count() == 0 and ordering.group_runs(df.limit(0), "v", "id").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_filters_against_tiles(spark):
    import numpy as np

    a = np.random.default_rng(4).integers(0, 256, (9, 7)).astype(np.uint8)
    df = spark.createDataFrame([(x, y, float(a[y, x])) for y in range(9) for x in range(7)], "x int, y int, value double")
    for kind in (*raster.FILTERS, "sobel", "x-gradient", "y-gradient"):
        got = {(r.x, r.y): r.value for r in raster.convolve_pixels(df, kind).collect()}
        want = raster.convolve(a, kind)
        assert got == {(x, y): int(want[y, x]) for y in range(9) for x in range(7)}, kind
    # the row beyond the first one is the second one, the column beyond the first is the first
    b = np.array([[1, 2], [3, 4], [5, 6]], np.uint8)
    near = [3, 3, 4, 1, 1, 2, 3, 3, 4]
    assert raster.convolve(b, "sharpen")[0, 0] == max(0, sum(w * v for w, v in zip(raster.FILTERS["sharpen"], near)))


def test_collisions(spark):
    rows = [("t", i, float(x), 0.0, float(x) + 1, 1.0, "n") for i, x in enumerate([0, 0.5, 3, 10, 4.5])]
    df = spark.createDataFrame(rows, "tile string, id int, minx double, miny double, maxx double, maxy double, name string")
    got = {r.id: r.placed for r in labels.place_labels(df, "tile", ["id"], (0, 0, 100, 100)).collect()}
    assert got == {0: True, 1: False, 2: True, 3: True, 4: True}
    got = {r.id: r.placed for r in labels.place_labels(df, "tile", ["id"], (0, 0, 100, 100), 0.0, 3.0, "name").collect()}
    assert got == {0: True, 1: False, 2: False, 3: True, 4: True}


def test_box_join_matches_nested_loop(spark):
    a = spark.range(300).select(*[F.expr(f"(id * {k} % 97) + {d}").cast("double").alias(f"a_{n}") for n, k, d in (("minx", 13, 0), ("miny", 29, 0), ("maxx", 13, 4), ("maxy", 29, 6))], F.col("id").alias("a"))
    b = spark.range(300).select(*[F.expr(f"(id * {k} % 89) + {d}").cast("double").alias(f"b_{n}") for n, k, d in (("minx", 17, 0), ("miny", 31, 0), ("maxx", 17, 5), ("maxy", 31, 3))], F.col("id").alias("b"))
    want = {(r.a, r.b) for r in a.join(b, boxes.Box.columns("a_").intersects(boxes.Box.columns("b_"))).collect()}
    got = [(r.a, r.b) for r in hits.join_boxes(a, b, 7.0, "inner", "a_", "b_").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_colours_and_kernels():
    import numpy as np

    assert raster.parse_color("#f80") == (255, 136, 0, 255) and raster.parse_color("rgba(1,2,3,0.5)") == (1, 2, 3, 128) and raster.parse_color("hsl(120,100%,50%)") == (0, 255, 0, 255)
    for kind in ("near", *raster.KERNELS):
        assert np.allclose(raster.kernel_weights(kind, 16, 8).sum(1), 1), kind
        assert (raster.scale_array(np.full((8, 8), 9, np.uint8), 16, 4, kind) == 9).all()
    # 9 * 0.1111 * 7 is a little less than 7, and what is behind the point goes
    assert (raster.convolve(np.full((5, 5), 7, np.uint8), "blur") == 6).all() and (raster.convolve(np.full((5, 5), 7, np.uint8), "sobel") == 0).all()
    assert (raster.stack_blur(np.full((6, 6), 5, np.uint8), 2, 2) == 5).all()
    with pytest.raises(ValueError):
        raster.Colorizer((raster.Stop(2, (0, 0, 0, 0)), raster.Stop(1, (0, 0, 0, 0))))


def test_labels_everywhere_are_those_placed_one_by_one(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    rows = [(i, float(v), float(x), float(y), float(x + w), float(y + 1), t) for i, (v, x, y, w, t) in enumerate(zip(rng.integers(0, 40, 250), rng.uniform(-30, 30, 250), rng.uniform(-30, 30, 250), rng.uniform(1, 5, 250), map(str, rng.integers(0, 9, 250))))]
    df = spark.createDataFrame(rows, "id int, v double, minx double, miny double, maxx double, maxy double, t string")
    got = {r.id: r.placed for r in labels.place_labels_everywhere(df, [("v", False), ("id", True)], 6.0, 0.3, 7.0, "t").collect()}
    found = labels.Detector((-99.0, -99.0, 99.0, 99.0))
    want = {}
    for i, v, *box, t in sorted(rows, key=lambda r: (-r[1], r[0])):
        want[i] = found.free(tuple(box), 0.3, t, 7.0)
        if want[i]:
            found.place(tuple(box), t)
    assert got == want and 0 < sum(want.values()) < 250
    assert labels.place_labels_everywhere(df.limit(0), [("id", True)], 6.0).count() == 0


def test_symbolizer_properties(spark):
    from atlasq.plans import properties

    df = spark.createDataFrame([("#0f08", 3.5, True, "red"), ("nothing", None, None, None)], "c string, w double, b boolean, n string")
    s = spec.Symbolizer("line", {"stroke": "[c]", "stroke-width": "[w] * 2", "clip": "[b]", "fill": "[n]", "stroke-dasharray": "4, 2, 1", "opacity": "0.5"})
    a, b = properties.with_properties(df, s, ["stroke", "stroke-width", "clip", "fill", "stroke-dasharray", "opacity", "stroke-linecap", "transform"]).collect()
    assert tuple(a.stroke) == (0, 255, 0, 136) and a.stroke_width == 7.0 and a.clip and tuple(a.fill) == (255, 0, 0, 255)
    assert tuple(b.stroke) == (0, 0, 0, 255) and b.clip is False and tuple(b.fill) == (128, 128, 128, 255)
    assert [tuple(x) for x in a.stroke_dasharray] == [(4, 2), (1, 4), (2, 1)] and a.opacity == 0.5 and a.stroke_linecap == "butt" and tuple(a.transform) == (1, 0, 0, 1, 0, 0)
    with pytest.raises(ValueError):
        properties.dashes("4,-1")


def test_every_blend_mode(spark):
    a = spark.createDataFrame([(0, 0, 200, 100, 50, 128)], "x int, y int, r int, g int, b int, a int")
    b = spark.createDataFrame([(0, 0, 10, 250, 90, 255), (1, 0, 1, 2, 3, 255)], "x int, y int, r int, g int, b int, a int")
    for mode in raster.BLEND_MODES:
        rows = raster.composite(a, b, mode).collect()
        assert len(rows) == 2 and all(0 <= v <= 255 for r in rows for v in r[2:]), mode


def test_streaming(spark, sf, tmp_path):
    from atlasq.streaming import windows

    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    s = windows.tile_windows(windows.stream(spark, str(tmp_path / "in"), events.schema), "ts", "value", "value", 3)
    q = s.writeStream.format("memory").queryName("tiles_by_hour").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("tiles_by_hour").agg(F.sum("n")).first()[0] == events.where("value is not null").count()


@pytest.mark.parametrize("name", sorted(registered.ORACLES))
def test_against_sql(spark, sf, name):
    import os

    import duckdb

    got = catalog.QUERIES[name](spark, sf).toPandas()
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{sf}/{f}')")
    want = con.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    rows = lambda d: sorted(map(tuple, d[sorted(d.columns)].map(str).values))
    assert rows(got) == rows(want)


def test_whole_part_table_is_joined(spark):
    """Every overlapping pair, whatever the brands."""
    import numpy as np

    from atlasq.plans import catalog

    sf = "/root/testdata/sf0.01"
    rows = catalog.parts(spark, sf).select("id", "minx", "miny", "maxx", "maxy").collect()
    i, x, y, z, w = (np.array(c) for c in zip(*rows))
    a, b = np.nonzero((i[:, None] < i) & (x[:, None] <= z) & (z[:, None] >= x) & (y[:, None] <= w) & (w[:, None] >= y))
    got = [(r.a, r.b) for r in catalog.QUERIES["join_boxes"](spark, sf).collect()]
    assert len(got) == len(a) > 0 and set(got) == set(zip(i[a].tolist(), i[b].tolist()))


def test_callers_columns_stay(spark):
    """Every operator keeps callers' columns that are called as its own inner ones, with their values."""
    from atlasq.operators import hits, labels, ordering

    own = "_part _p _new _inside _base _before _rank _of _group _borders".split()
    rows = [(i, i // 3, f"v{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "k long, g long, v string").withColumns({c: F.lit(c) for c in own})
    for out in (ordering.group_runs(df, "g", "k"), ordering.numbered(df, [("k", True)], "place")):
        found = out.orderBy("k").collect()
        assert set(df.columns) < set(out.columns) and all(r[c] == c for r in found for c in own) and [r.v for r in found] == [v for _, _, v in rows]
    assert [r.run_id for r in ordering.group_runs(df, "g", "k").orderBy("k").collect()] == [i // 3 + 1 for i in range(40)]
    boxes = spark.createDataFrame([(i, float(i), 0.0, i + 1.5, 1.0) for i in range(9)], "i long, minx double, miny double, maxx double, maxy double")
    names = "_cell _rcell _row _cx _cy _z _place _i _j _first _won _text".split()
    marked = boxes.withColumns({c: F.concat(F.lit(c), F.col("i")) for c in names})
    left, right = (marked.select(*(F.col(c).alias(f"{p}{c}") if c in boxes.columns else c for c in (marked.columns if p == "l_" else boxes.columns))) for p in ("l_", "r_"))
    pairs = hits.join_boxes(left, right, 2.0)
    assert {c for c in names} < set(pairs.columns) and sorted((r.l_i, r.r_i) for r in pairs.collect()) == [(i, j) for i in range(9) for j in range(9) if abs(i - j) <= 1]
    assert hits.join_boxes(left, right, 2.0, "left_semi").columns == left.columns
    points = spark.createDataFrame([(0.5, 0.5)], "x double, y double").withColumns({c: F.lit(c) for c in names})
    assert [r.i for r in hits.join_points(points, boxes, 2.0).collect()] == [0] and set(names) < set(hits.join_points(points, boxes, 2.0).columns)
    others = spark.createDataFrame([(1.0, 0.5)], "ox double, oy double")
    assert set(names) < set(hits.join_near(points, others, 1.0).columns) and hits.join_near(points, others, 1.0).count() == 1
    placed = labels.place_labels_everywhere(marked, [("i", True)], 2.0)
    assert placed.columns == [*marked.columns, "placed"] and sorted(r.i for r in placed.where("placed").collect()) == [0, 2, 4, 6, 8] and all(r[c] == f"{c}{r.i}" for r in placed.collect() for c in names)


def test_colour_filters_premultiply(spark):
    from atlasq.operators import raster

    df = spark.createDataFrame([(200, 100, 0, 100), (10, 20, 30, 255), (7, 7, 7, 0)], "r int, g int, b int, a int")
    half = [(78, 39, 0, 100), (10, 20, 30, 255), (0, 0, 0, 0)]
    assert [tuple(r) for r in raster.invert(df).collect()] == [(a - r, a - g, a - b, a) for r, g, b, a in half]
    assert [r.g for r in raster.gray(df).collect()] == [(4915 * r + 9667 * g + 1802 * b + 8192) >> 14 for r, g, b, _ in half]
    assert [tuple(r) for r in raster.invert(raster.premultiply(df), True).collect()] == [tuple(r) for r in raster.invert(df).collect()]
    seen = [tuple(r) for r in raster.color_blind(df, "protanope").collect()]
    assert seen[2] == (0, 0, 0, 0) and all(c <= 100 for c in seen[0]) and seen[0][0] != 200


@pytest.mark.parametrize("n, rounds", [(60, 3), (900, 4)])
def test_chain_of_labels(spark, monkeypatch, n, rounds):
    """A street of labels, each meeting the next: every second one is placed, in a few rounds."""
    from atlasq.operators import labels

    writes, plain = [], labels.scratch.written
    monkeypatch.setattr(labels.scratch, "written", lambda df: writes.append(1) or plain(df))
    chain = spark.range(n).selectExpr("id", "id * 1.0D as minx", "0.0D as miny", "id + 1.5D as maxx", "1.0D as maxy")
    placed = labels.place_labels_everywhere(chain, [("id", True)], 2.0).where("placed").collect()
    assert sorted(r.id for r in placed) == list(range(0, n, 2))
    # one for the order, two for the crowded places, three a round
    assert len(writes) <= 3 + 3 * rounds


def test_labels_everywhere_by_force(spark):
    from atlasq.operators import labels

    rng = np.random.default_rng(11)
    rows = [(i, float(x), float(y), float(x + w), float(y + h), "abc"[i % 3] if i % 7 else None) for i, (x, y, w, h) in enumerate(zip(*(rng.uniform(0, 60, 700), rng.uniform(0, 60, 700), rng.uniform(0.1, 5, 700), rng.uniform(0.1, 2, 700))))]
    rows += [(700 + i, 5.0, 5.0, 6.0, 6.0, "a") for i in range(200)]
    df = spark.createDataFrame(rows, "i long, minx double, miny double, maxx double, maxy double, t string")
    for margin, repeat in ((0.0, 0.0), (0.3, 4.0)):
        done, want = [], set()
        for i, x0, y0, x1, y1, t in rows:
            gap = lambda o, d: x0 <= o[3] + d and x1 >= o[1] - d and y0 <= o[4] + d and y1 >= o[2] - d
            if not any(gap(o, repeat if repeat > margin and t is not None and t == o[5] else margin) for o in done):
                done.append((i, x0, y0, x1, y1, t))
                want.add(i)
        found = labels.place_labels_everywhere(df, [("i", True)], 1.0, margin, repeat, "t")
        assert {r.i for r in found.where("placed").collect()} == want and found.count() == len(rows)


def test_scaling_pixel_tables(spark):
    """Pixel tables scaled by every kernel equal whole tiles; blurs do too, and missing pixels leave the rest's means."""
    from atlasq.operators import raster

    rng = np.random.default_rng(2)
    a = rng.integers(0, 256, (11, 17)).astype(np.float64)
    df = spark.createDataFrame([(x, y, float(a[y, x])) for y in range(11) for x in range(17)], "x int, y int, value double")

    def table(out, h, w):
        b = np.full((h, w), np.nan)
        for r in out.collect():
            b[r.y, r.x] = r.value
        return b

    for kind in raster.KERNELS:
        for w, h in ((7, 23), (40, 5)) if kind in ("kaiser", "bessel", "lanczos") else ((7, 23),):
            assert np.allclose(table(raster.scale_pixels(df, (17, 11), (w, h), kind), h, w), raster.scale_array(a, w, h, kind)), kind
    near = raster.scale_pixels(df, (17, 11), (34, 11), "near")
    assert np.array_equal(table(near, 11, 34), np.repeat(a, 2, axis=1))
    cut = table(raster.scale_pixels(df, (17, 11), (30, 30), "lanczos", low=0, high=255), 30, 30)
    assert cut.min() >= 0 and cut.max() <= 255 and np.array_equal(cut, np.round(cut))
    assert np.abs(table(raster.stack_blur_pixels(df, (17, 11), 3, 2), 11, 17) - raster.stack_blur(a, 3, 2)).max() <= 0.5
    assert np.array_equal(table(raster.stack_blur_pixels(df, (17, 11), 0, 0), 11, 17), a)
    flat = df.where("(x + y) % 3 > 0").withColumn("value", F.lit(7.0))
    assert np.allclose(table(raster.scale_pixels(flat, (17, 11), (9, 9), "bilinear"), 9, 9), 7)
    with pytest.raises(ValueError):
        raster.scale_pixels(df, (17, 11), (9, 9), "odd")


def octree_by_force(pixels, most):
    """Palette of a tree of nodes that pixels are put into one by one; the cheapest mergeable node is searched anew each time."""

    class Node:
        def __init__(self, way):
            self.way, self.n, self.sums, self.kids = way, 0, [0, 0, 0], {}

        def cost(self):
            mean = [s / self.n for s in self.sums]
            return sum(k.cost() + sum((k.sums[c] // k.n - mean[c]) ** 2 for c in range(3)) * k.n for k in self.kids.values())

    root = Node(())
    every = [root]
    for p in pixels:
        at = root
        for level in range(7):
            at.n += 1
            at.sums = [a + b for a, b in zip(at.sums, p)]
            if level < 6:
                step = sum((p[c] >> (7 - level) & 1) << (2 - c) for c in range(3))
                if step not in at.kids:
                    at.kids[step] = Node((*at.way, step))
                    every.append(at.kids[step])
                at = at.kids[step]
    costs = {n.way: n.cost() for n in every}
    todo = {n.way: n for n in every if len(n.way) < 6}
    colors = sum(len(n.way) == 6 for n in every)
    while colors > most:
        level = max(len(w) for w in todo)
        pick = min((costs[w], w) for w in todo if len(w) == level)
        best = int(pick[0])
        for above in range(level, 1, -1):
            own = [(costs[w], w) for w in todo if len(w) == above]
            if own and min(own)[0] < best and not any(k.kids for k in todo[min(own)[1]].kids.values()):
                pick, best = min(own), int(min(own)[0])
        node = todo.pop(pick[1])
        colors -= len(node.kids) - 1
        node.kids = {}
    out = []

    def walk(n):
        if not n.kids:
            out.append((n.way, tuple(int(np.float32(s) / np.float32(n.n)) for s in n.sums)))
        for k in sorted(n.kids):
            walk(n.kids[k])

    walk(root)
    return out


@pytest.mark.parametrize("most", [1, 5, 40, 256])
def test_octree_palette(spark, most):
    from atlasq.operators import raster

    rng = np.random.default_rng(6)
    pixels = [tuple(map(int, p)) for p in np.concatenate([rng.integers(0, 256, (150, 3)), rng.normal((200, 60, 30), 12, (150, 3)).clip(0, 255).astype(int), np.tile((9, 9, 9), (60, 1))])]
    df = spark.createDataFrame(pixels, "r int, g int, b int")
    want = octree_by_force(pixels, most)
    tree = raster.octree_palette(df, most)
    assert list(tree.palette) == [c for _, c in want] and len(tree.palette) <= most
    for r in df.withColumn("i", tree.index(F.col("r"), F.col("g"), F.col("b"))).collect():
        way = tuple(sum((v >> (7 - level) & 1) << (2 - c) for c, v in enumerate((r.r, r.g, r.b))) for level in range(6))
        assert want[r.i][0] == way[: len(want[r.i][0])]
    assert raster.octree_palette(df.limit(0), most).palette == ()


def hextree_by_force(pixels, most, gamma=2.0):
    """The same palette from a tree of nodes that hold their pixels."""
    seen = [p for p in pixels if p[3] >= 5]
    curve = [255 * (i / 255) ** (1 / gamma) for i in range(256)]
    way = lambda p, level: tuple(sum((p[c] >> (7 - k) & 1) << s for c, s in ((3, 3), (0, 2), (1, 1), (2, 0))) for k in range(level))
    own = {(): seen}
    for level in range(1, 7):
        for p in seen:
            own.setdefault(way(p, level), []).append(p)
    kids = {w: sorted({v for v in own if len(v) == len(w) + 1 and v[: len(w)] == w}) for w in own}
    mean = lambda w: [sum(curve[p[c]] for p in own[w]) / len(own[w]) for c in range(3)] + [sum(p[3] for p in own[w]) / len(own[w])]
    means = {w: mean(w) for w in own}
    cost = {}
    for w in sorted(own, key=len, reverse=True):
        cost[w] = len(own[w]) / 1000 + sum(cost[k] + sum((x - y) ** 2 for x, y in zip(means[k], means[w])) * sum(p[3] for p in own[k]) / 255 for k in kids[w])
    holes = len(seen) < len(pixels)
    room, open_, out, tries, colors = most - holes, [()] if seen else [], [], 0, 1 if seen else 0
    while open_ and colors < room and tries < 16:
        w = max(open_, key=lambda v: cost[v])
        open_.remove(w)
        if len(kids[w]) + colors - 1 > room:
            tries += 1
            out.append(w)
            continue
        tries = 0
        if kids[w] and (cost[w] / len(own[w]) + 1) * np.log(len(own[w])) > 15:
            open_ += kids[w]
            colors += len(kids[w]) - 1
        else:
            out.append(w)
    palette = [(0, 0, 0, 0)] if holes else []
    for w in open_ + out:
        alpha = int(np.float32(sum(p[3] for p in own[w])) / np.float32(len(own[w])))
        palette.append((*(int(255 * (m / 255) ** gamma + 0.5) for m in means[w][:3]), 255 if alpha > 250 else alpha))
    return sorted(palette, key=lambda p: (p[3] == 255, sum(p), p[3], p))


@pytest.mark.parametrize("most", [2, 16, 100])
def test_hextree_palette(spark, most):
    from atlasq.operators import raster

    rng = np.random.default_rng(9)
    pixels = [tuple(map(int, p)) for p in np.concatenate([rng.integers(0, 256, (120, 4)), np.column_stack([rng.normal((200, 60, 30), 12, (200, 3)).clip(0, 255).astype(int), np.full(200, 255)]), np.tile((9, 9, 9, 0), (5, 1))])]
    df = spark.createDataFrame(pixels, "r int, g int, b int, a int")
    found = raster.hextree_palette(df, most)
    assert found == hextree_by_force(pixels, most) and len(found) <= most
    assert raster.hextree_palette(df.limit(0), most) == [] and raster.hextree_palette(df.where("a = 0"), most) == [(0, 0, 0, 0)]


def test_joins_of_equal_places(spark, monkeypatch):
    """Equal boxes are joined as one and come apart again: every pair is there once, whatever the keys, nulls and the number of arrays."""
    rows = [(i if i % 11 else None, i // 3, float(i % 4), float(i % 3)) for i in range(60)] + [(99, 1, None, 0.0), (5, 2, 0.0, 0.0), (5, 2, 0.0, 0.0)]
    df = scratch.written(spark.createDataFrame(rows, "id long, v long, x double, y double"))
    whole = df.withColumns({"minx": F.col("x") - 1, "miny": F.col("y") - 0.25, "maxx": F.col("x") + 1, "maxy": F.col("y") + 0.25})
    met = lambda a, b: None not in (a[2], b[2]) and abs(a[2] - b[2]) <= 2 and abs(a[3] - b[3]) <= 0.5
    count = lambda found: sorted(map(str, found))
    for size in (8 << 20, 1):
        monkeypatch.setattr(hits, "ARRAY_BYTES", size)
        groups = hits.grouped(whole.select("id", "minx", "miny", "maxx", "maxy"), ["minx", "miny", "maxx", "maxy"], "rows")
        assert (groups.count() == 12) == (size > 1) and groups.agg(F.sum(F.size("rows"))).first()[0] == 62
        got = hits.self_join_boxes(whole, 1.5, "id", "a", "b").collect()
        assert count(map(tuple, got)) == count((a[0], b[0]) for a in rows for b in rows if None not in (a[0], b[0]) and a[0] < b[0] and met(a, b))
        left, right = (whole.select(*(F.col(c).alias(f"{p}_{c}") for c in cols)) for p, cols in (("l", ("minx", "miny", "maxx", "maxy", "id", "v")), ("r", ("minx", "v", "miny", "maxx", "maxy", "id"))))
        both = hits.join_boxes(left, right, 1.5)
        assert both.columns == left.columns + right.columns
        assert count((r.l_id, r.l_v, r.r_id, r.r_v) for r in both.collect()) == count((*a[:2], *b[:2]) for a in rows for b in rows if met(a, b))
        alike = hits.join_boxes(left.withColumnsRenamed({"l_id": "id", "l_v": "v"}), right.withColumnsRenamed({"r_id": "id", "r_v": "v"}), 1.5)
        assert alike.columns == [c.removeprefix("l_") if c in ("l_id", "l_v") else c for c in left.columns] + [c.removeprefix("r_") if c in ("r_id", "r_v") else c for c in right.columns]
        assert count(map(tuple, alike.collect())) == count(map(tuple, both.collect()))
        assert hits.join_points(df.select("id", "x", "y"), whole.select("id", "minx", "miny", "maxx", "maxy"), 1.5).columns == ["id", "x", "y", "id", "minx", "miny", "maxx", "maxy"]
        boxes_only = right.select("r_minx", "r_miny", "r_maxx", "r_maxy")
        assert hits.join_boxes(left, boxes_only, 1.5).count() == both.count()
        held = hits.join_points(df.select("id", "x", "y"), whole.select(F.col("id").alias("box"), "minx", "miny", "maxx", "maxy"), 1.5)
        assert count((r.id, r.box) for r in held.collect()) == count((a[0], b[0]) for a in rows for b in rows if None not in (a[2], b[2]) and abs(a[2] - b[2]) <= 1 and abs(a[3] - b[3]) <= 0.25)


def test_equal_boxes_are_compared_once(spark):
    """What comes out of the join by cells grows with different boxes of one side, not with the copies of both."""
    df = spark.range(3000).select("id", *(F.lit(v).alias(n) for n, v in (("minx", 0.0), ("miny", 0.0), ("maxx", 1.0), ("maxy", 1.0))))
    joined = hits.self_join_boxes(df, 6.0, "id", "a", "b")
    assert joined.count() == 3000 * 2999 // 2
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(keys") < plan.index("Join Inner") < plan.index("collect_list")


def test_points_meet_equal_boxes_once(spark):
    """A point meets a box's copies as one."""
    boxes_ = spark.range(1000).select(F.col("id").alias("box"), *(F.lit(v).alias(n) for n, v in (("minx", 0.0), ("miny", 0.0), ("maxx", 1.0), ("maxy", 1.0))))
    held = hits.join_points(spark.range(2000).select("id", F.lit(0.5).alias("x"), F.lit(1.0).alias("y")), boxes_, 6.0).select("id", "box")
    assert held.count() == 2_000_000 and held.distinct().count() == 2_000_000
    plan = held._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(_rows") < plan.index("Join Inner") < plan.index("collect_list")


def test_nearest_within(spark, monkeypatch):
    """The nearest by distance and key, of equal places too, in one search or from small distances on."""
    own = [(i, float(i * 7 % 50), float(i * 3 % 40)) for i in range(150)] + [(i, 3.0, 4.0) for i in range(200, 240)] + [(900, None, 1.0), (901, 400.0, 400.0), (902, 60.0, 0.0)]
    other = [(i, float(i * 11 % 50), float(i * 13 % 20)) for i in range(100)] + [(i, 0.0, 0.0) for i in range(300, 340)] + [(7000, 75.0, 0.0), (7001, 45.0, 0.0), (7002, None, 0.0)]
    points, others = spark.createDataFrame(own, "id long, x double, y double"), spark.createDataFrame(other, "k long, ox double, oy double")
    want = {}
    for i, x, y in own:
        near = [((x - ox) ** 2 + (y - oy) ** 2, k) for k, ox, oy in other if None not in (x, ox) and (x - ox) ** 2 + (y - oy) ** 2 <= 225]
        if near:
            want[i] = (min(near)[1], math.sqrt(min(near)[0]))
    assert 902 in want and 901 not in want and len(want) < len(own)
    looked = []
    plain = hits.join_near
    monkeypatch.setattr(hits, "join_near", lambda p, o, d, *more: (looked.append(d), plain(p, o, d, *more))[1])
    for pairs, most in ((50_000_000, 32), (0, 1)):
        monkeypatch.setattr(hits, "PAIRS", pairs)
        monkeypatch.setattr(hits, "PAIRS_PER_POINT", most)
        found = hits.nearest_within(points, others, 15.0, "k")
        assert found.columns == ["id", "x", "y", "nearest", "apart"] and {r.id: (r.nearest, r.apart) for r in found.collect()} == want and found.count() == len(want)
    assert looked[0] == 15.0 and looked[1] < 15.0 and looked[-1] == 15.0


def test_copies_and_crowds_of_labels(spark, monkeypatch):
    """Copies of a label take no part but for the first, and crowds are thinned again and again; the placed ones are those placed one by one."""
    rng = np.random.default_rng(12)
    spots = [(float(x), float(y), float(x + w), float(y + 1), t) for x, y, w, t in zip(rng.uniform(0, 25, 60), rng.uniform(0, 25, 60), rng.uniform(1, 4, 60), ["a", "b", None] * 20)]
    # turned over: such a box meets none of its copies
    spots += [(3.0, 40.0, 1.0, 41.0, "a"), (3.0, 44.0, 1.0, 45.0, None)]
    rows = [(i, *spots[s]) for i, s in enumerate(rng.integers(0, len(spots), 1500).tolist())]
    df = spark.createDataFrame(rows, "i long, minx double, miny double, maxx double, maxy double, t string")
    seen, plain = [], labels._first_of_cells
    monkeypatch.setattr(labels, "_first_of_cells", lambda b, *more: seen.append(b.count()) or plain(b, *more))
    for margin, repeat, crowd in ((0.0, 0.0, 100_000), (0.3, 4.0, 1)):
        monkeypatch.setattr(labels, "CROWDED", crowd)
        own = [r for r in rows if r[1] < r[3]] if crowd > 1 else rows[:400]
        done, want = [], set()
        for i, x0, y0, x1, y1, t in own:
            gap = lambda o, d: x0 <= o[3] + d and x1 >= o[1] - d and y0 <= o[4] + d and y1 >= o[2] - d
            if not any(gap(o, repeat if repeat > margin and t is not None and t == o[5] else margin) for o in done):
                done.append((i, x0, y0, x1, y1, t))
                want.add(i)
        seen.clear()
        found = labels.place_labels_everywhere(df.where("minx < maxx") if crowd > 1 else df.where("i < 400"), [("i", True)], 4.0, margin, repeat, "t")
        assert {r.i for r in found.where("placed").collect()} == want and found.count() == len(own)
        assert seen[0] <= 60 if crowd > 1 else len(seen) > 1
