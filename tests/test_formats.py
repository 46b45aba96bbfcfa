"""Filter chains and text formats: parsing, chains against single steps, alternatives by row."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from atlasq.operators import filters, raster
from atlasq.plans import formats

SIDE = 9


@pytest.fixture(scope="module")
def pixels(spark):
    return spark.createDataFrame([(x, y, (x * 31 + y * 7) % 256, (x * y * 5) % 256, (200 - x * 9) % 256, (x * 40 + y * 3) % 256) for x in range(SIDE) for y in range(SIDE)], "x int, y int, r int, g int, b int, a int")


def rows(df):
    return sorted(tuple(r) for r in df.select("x", "y", "r", "g", "b", "a").collect())


def test_filter_texts():
    p = lambda t: [(f.name, f.arguments) for f in filters.parse(t)]
    assert p("") == p(" , ") == [] and p("blur") == p("blur()") == [("blur", ())] and p("gray,invert") == p("gray invert()") == [("gray", ()), ("invert", ())]
    assert p("agg-stack-blur") == [("agg-stack-blur", (1, 1))] and p("agg-stack-blur(4)") == [("agg-stack-blur", (4, 4))] and p("agg-stack-blur(4,2)") == [("agg-stack-blur", (4, 2))]
    assert p("scale-hsla(0,1,0,0.5,0,1,0,1)") == [("scale-hsla", (0, 1, 0, 0.5, 0, 1, 0, 1))]
    assert p("colorize-alpha(rgba(1,2,3,0.5), #fff 50%, red 0.75, blue 250%)") == [("colorize-alpha", (((1, 2, 3, 128), 0.0), ((255, 255, 255, 255), 0.5), ((255, 0, 0, 255), 0.75), ((0, 0, 255, 255), 1.0)))]
    assert p("color-to-alpha(white)") == [("color-to-alpha", ((255, 255, 255, 255),))]
    for wrong in ("soften", "blur(2)", "scale-hsla(1)", "agg-stack-blur(1,2,3)", "agg-stack-blur(-1)", "gray(", "colorize-alpha()", "color-to-alpha(red,blue)", "7"):
        with pytest.raises(ValueError):
            filters.parse(wrong)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([filters.Filter(n) for n in filters.PLAIN]) | st.builds(lambda a, b: filters.Filter("agg-stack-blur", (a, b)), st.integers(0, 99), st.integers(0, 99)) | st.builds(lambda c: filters.Filter("color-to-alpha", (c,)), st.tuples(*[st.integers(0, 255)] * 4))))
def test_filter_texts_there_and_back(chain):
    assert filters.parse(filters.shown(chain)) == chain


def test_chain_equals_its_steps(pixels):
    pre = raster.premultiply(pixels)
    one = lambda df, name, ready: rows(filters.apply(df, name, (SIDE, SIDE), ready))
    assert one(pixels, "", False) == rows(pre) and one(pre, "", True) == rows(pre)
    assert one(pixels, "gray", False) == rows(raster.gray(pixels)) and one(pixels, "invert,invert", False) == rows(pre)
    assert one(pixels, "invert gray", False) == rows(raster.gray(raster.invert(pixels), True))
    blurred = filters.apply(pixels, "agg-stack-blur(2,1)", (SIDE, SIDE))
    assert {(r.x, r.y): r.g for r in blurred.collect()} == {(r.x, r.y): r.g for r in raster.stack_blur_pixels(pre, (SIDE, SIDE), 2, 1, "g").collect()}
    assert one(pixels, "agg-stack-blur(2,1),sharpen,gray", False) == one(filters.apply(blurred, "sharpen", (SIDE, SIDE), True), "gray", True)
    straight = pixels
    for c in "rgb":
        straight = raster.convolve_pixels(straight, "emboss", c)
    assert one(pixels, "emboss", False) == rows(raster.premultiply(straight))
    edges = filters.apply(pixels, "x-gradient", (SIDE, SIDE)).collect()
    assert {r.a for r in edges} == {255}
    assert one(pixels, "color-blind-protanope gray", False) == rows(raster.gray(raster.color_blind(pixels, "protanope"), True))


def test_colorize_alpha(pixels):
    one = filters.apply(pixels, "colorize-alpha(#80402080)", (SIDE, SIDE)).collect()
    before = {(r.x, r.y): r for r in pixels.collect()}
    for r in one:
        a = before[r.x, r.y].a
        if a:
            alpha = (128 * a + 255) >> 8
            assert (r.r, r.g, r.b, r.a) == ((128 * alpha + 255) >> 8, (64 * alpha + 255) >> 8, (32 * alpha + 255) >> 8, alpha)
    ramp = filters.ramp((((0, 0, 0, 255), 0.0), ((255, 100, 0, 255), 0.0)))
    assert len(ramp) == 256 and ramp[0] == (0, 0, 0, 255) and 250 <= ramp[255][0] <= 255 and all(a[0] <= b[0] for a, b in zip(ramp, ramp[1:]))
    late = filters.ramp((((9, 9, 9, 9), 0.25), ((90, 90, 90, 90), 0.5)))
    assert set(late[:64]) == {(9, 9, 9, 9)} and set(late[130:]) == {(90, 90, 90, 90)}


XML = """<TextSymbolizer size="[s]" fill="red">[n]<Format fill="#00f" size="7"><Layout dx="3">'-' + [k]<Format text-transform="uppercase">[n]</Format></Layout></Format> 'end'
  <Placement size="5"/><Placement dx="2">[k]</Placement></TextSymbolizer>"""


def test_format_trees(spark):
    df = spark.createDataFrame([(1, "ab", 11.0), (2, None, None)], "k int, n string, s double")
    own = formats.load(XML)
    assert [p.properties.get("size") for p in own] == ["[s]", "5", "5"] and own[1].tree == own[0].tree and own[2].properties["dx"] == "2"
    found = {r.k: r.t for r in df.select("k", formats.runs(df, own[0]).alias("t")).collect()}
    assert [(r.text, r.size, r.fill.b, r.dx) for r in found[1]] == [("ab", 11, 0, None), ("-1", 7, 255, 3), ("AB", 7, 255, 3), ("end", 11, 0, None)]
    # null texts are empty, a size that isn't a number is the default
    assert [(r.text, r.size) for r in found[2]] == [("", 10), ("-2", 7), ("", 7), ("end", 10)]
    every = formats.alternatives(df.withColumn("_alternatives", F.lit("own")), own, ("size", "dx")).orderBy("k", "option").collect()
    assert [(r.k, r.option, r.label, r.size, r.dx) for r in every][:3] == [(1, 0, "ab-1ABend", 11, 0), (1, 1, "ab-1ABend", 5, 0), (1, 2, "1", 5, 2)] and every[0]["_alternatives"] == "own"
    fits = formats.chosen(df, own, ("size",), lambda label, p: F.char_length(label) * p["size"] < F.col("k") * 30).orderBy("k").collect()
    assert [(r.k, r.option, r.label) for r in fits] == [(1, 2, "1"), (2, 0, "-2end")]
    assert formats.chosen(df, own, ("size",), lambda label, p: F.lit(False)).where("option is null").count() == 2
    with pytest.raises(ValueError):
        formats.load("<TextSymbolizer>[n]<Odd/></TextSymbolizer>")
