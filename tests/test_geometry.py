import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from atlasq.functions import codecs as C
from atlasq.functions import geometry as G
from atlasq.functions import shapes as S

WKT = [
    "POINT(7 -3)", "LINESTRING(0 0,5 1,6 8)", "POLYGON((0 0,1 6,7 7,8 1,0 0))", "POLYGON((0 0,0 9,9 9,9 0,0 0),(2 2,5 3,4 6,2 2))", "MULTIPOINT(1 5,2 6,3 7)",
    "MULTILINESTRING((0 0,4 4),(5 5,6 5,6 9))", "MULTIPOLYGON(((0 0,0 2,2 2,0 0)),((5 5,5 9,9 9,5 5),(6 7,7 8,6 8,6 7)))", "GEOMETRYCOLLECTION(POINT(8 9),LINESTRING(1 1,2 4),POLYGON((0 0,0 1,1 1,0 0)))",
    "POINT EMPTY", "LINESTRING EMPTY", "POLYGON EMPTY",
]


@pytest.mark.parametrize("text", WKT)
def test_codecs_round_trip(text):
    g = C.from_wkt(text)
    assert C.to_wkt(g) == text
    for order in "<>":
        assert C.to_wkt(C.from_wkb(C.to_wkb(g, order))) == text
    if "EMPTY" not in text:
        assert C.to_wkt(C.from_geojson(C.to_geojson(g))) == text


def test_known_bytes():
    # fixed values: bytes that the formats' standards prescribe
    assert C.to_wkb(C.from_wkt("POINT(1 2)")).hex() == "0101000000" + "000000000000f03f" + "0000000000000040"
    assert C.to_wkt(C.from_twkb(bytes.fromhex("01000e05"))) == "POINT(7 -3)"
    assert C.to_wkt(C.from_wkb(bytes.fromhex("01e9030000" + np.array([1.0, 2.0, 3.0]).tobytes().hex()))) == "POINT(1 2)"
    assert C.to_wkt(C.from_wkt("MULTIPOINT((1 2),(3 4))")) == "MULTIPOINT(1 2,3 4)"
    assert C.to_svg_path(C.from_wkt("POLYGON((0 0,1 0,1 1,0 0))")).startswith("M0 0L1 0")
    for bad in ("POINT(1)", "LINE(1 2)", "POINT(1 2) x", "POLYGON((1 2)"):
        with pytest.raises(ValueError):
            C.from_wkt(bad)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(-1e6, 1e6), st.floats(-1e6, 1e6)), min_size=2, max_size=30), st.floats(0.0, 1e4))
def test_simplifiers_keep_ends(pts, tolerance):
    a = np.array(pts)
    for f in S.SIMPLIFIERS.values():
        out = f(a, tolerance)
        assert (out[0] == a[0]).all() and (out[-1] == a[-1]).all() and len(out) <= len(a)


def test_douglas_peucker():
    a = C.from_wkt("LINESTRING(0 0,1 0.2,2 0,3 6,4 0.1,8 0)").parts
    assert C.to_wkt(C.Geometry("LineString", S.douglas_peucker(a, 1))) == "LINESTRING(0 0,2 0,3 6,4 0.1,8 0)"
    assert len(S.douglas_peucker(a, 7)) == 2 and len(S.douglas_peucker(a, 0)) == 6


def test_hits():
    line = C.from_wkt("LINESTRING(0 0,1 1,2 2)")
    assert S.hit(C.from_wkt("POINT(0 0)"), 0, 0, 0) and S.hit(line, 1, 1, 0.001) and not S.hit(line, 1, 1, 0)
    square = C.from_wkt("POLYGON((0 0,-10 0,-10 10,0 10,0 0))")
    assert S.hit(square, -5, 5, 0) and not S.hit(square, 5, 5, 100)
    hole = C.from_wkt("POLYGON((0 0,-10 0,-10 10,0 10,0 0),(-7 7,-7 3,-3 3,-3 7,-7 7))")
    assert not S.hit(hole, -5, 5, 0) and S.hit(hole, -1, 1, 0)


def test_measures():
    square = C.from_wkt("POLYGON((0 0,0 10,10 10,10 0,0 0))")
    assert S.centroid(square) == (5, 5) and S.is_clockwise(square.parts[0]) and S.invalid_reason(square) is None
    assert S.polylabel(square) == pytest.approx((5, 5)) and S.interior(square) == pytest.approx((5, 5))
    assert S.closest_point(square, 20, 5) == (10, 5, 10) and S.closest_point(square, 1, 1) == (1, 1, 0)
    assert S.invalid_reason(C.from_wkt("POLYGON((0 0,10 10,10 0,0 10,0 0))")) == "a ring crosses itself"
    assert S.invalid_reason(C.from_wkt("POLYGON((0 0,1 1,0 0))")) and not S.is_simple(C.from_wkt("LINESTRING(0 0,2 2,2 0,0 2)")) and S.is_simple(C.from_wkt("LINESTRING(0 0,1 0,1 1,0 0)"))
    assert C.to_wkt(S.corrected(C.from_wkt("POLYGON((0 0,10 0,10 10,0 10))"))).count(",") == 4
    assert S.middle_point(C.from_wkt("LINESTRING(0 0,10 0)")) == (5, 0) and S.centroid(C.from_wkt("POINT EMPTY")) is None


def test_converters():
    a = C.from_wkt("LINESTRING(0 0,10 0)").parts
    assert np.allclose(S.offset_line(a, 2), [[0, 2], [10, 2]]) and np.allclose(S.extended(a, 1), [[-1, 0], [11, 0]])
    assert C.to_wkt(S.clipped(C.from_wkt("LINESTRING(-5 5,15 5)"), (0, 0, 10, 10))) == "LINESTRING(0 5,10 5)"
    ring = S.clipped(C.from_wkt("POLYGON((-5 -5,5 -5,5 5,-5 5,-5 -5))"), (0, 0, 10, 10))
    assert abs(S.signed_area(ring.parts[0])) == 25
    moved = S.converted(C.from_wkt("LINESTRING(0 0,1 1)"), transform=(2, 0, 0, 2, 1, 1))
    assert C.to_wkt(moved) == "LINESTRING(1 1,3 3)"
    assert len(S.smoothed(np.array([[0, 0], [1, 1], [2, 0.0]]), 1.0)) > 3
    walls, roof = S.extrusion(C.from_wkt("POLYGON((0 0,1 0,1 1,0 0))"), 5)
    assert len(walls) == 3 and roof[0][0, 1] == 5
    grid = S.grid_points(C.from_wkt("POLYGON((0 0,10 0,10 10,0 10,0 0))"), 4, 4)
    assert tuple(grid[0]) == (5, 5) and len(grid) == 9
    assert [p[:2] for p in S.marker_positions(C.from_wkt("LINESTRING(0 0,100 0)"), "line", 50)] == [(25, 0), (75, 0)]
    assert S.marker_positions(C.from_wkt("LINESTRING(0 0,0 1)"), "vertex-last")[0][2] == pytest.approx(math.pi / 2)


def test_batches_equal_rows():
    """What is worked out for whole batches is what the row functions give, over all kinds, empty ones and unreadable bytes."""
    import pyarrow as pa

    from atlasq.functions import batches as B

    rng = np.random.default_rng(0)
    shown = lambda a: ",".join(f"{x} {y}" for x, y in a)
    texts = [t for t in WKT]
    for _ in range(300):
        pts = rng.integers(0, 6, (rng.integers(1, 9), 2))
        texts += [f"LINESTRING({shown(pts)})", f"POLYGON(({shown([*pts, pts[0]])}))", f"POLYGON((0 0,0 9,9 9,9 0,0 0),({shown([*pts, pts[0]])}))", f"POINT({pts[0][0]} {pts[0][1]})"]
    raws = [C.to_wkb(C.from_wkt(t)) for t in texts] + [C.to_wkb(C.from_wkt(WKT[3]), ">"), None, b"", b"\1\2\0\0\0\xff\xff\0\0", b"\1\3\0\0\0\1\0\0\0\7\0\0\0abc"]
    assert all(C.plain_wkt(t) in (None, C.to_wkb(C.from_wkt(t))) for t in texts)
    b = B.Batch(pa.array(raws, pa.binary()))
    for told, alone in ((B.envelope(b), S.envelope), (B.centroid(b), S.centroid), (B.path_length(b), S.path_length), (B.invalid_reason(b), S.invalid_reason), (B.is_simple(b), S.is_simple), (b.empty, lambda g: g.empty)):
        more = b.row_function(alone)
        for i, raw in enumerate(raws):
            g = None if raw is None else B.readable(C.from_wkb, raw)
            if g is None:
                assert b.kind[i] == 0 and i not in more
                continue
            got = more[i] if b.kind[i] == 0 else tuple(float(told[n][i]) for n in told) if isinstance(told, dict) else told[i]
            want = alone(g)
            if want is None or isinstance(want, str):
                assert got == want or isinstance(got, tuple) and math.isnan(got[0]), (texts[i], got, want)
            else:
                assert got == pytest.approx(want), (texts[i], got, want)


def _squares(rng, polygons: int, holes: int) -> list[list[np.ndarray]]:
    """Rings on a small grid, so that many touch, cross, share a piece or lie in each other; the first of each polygon is clockwise."""
    out = []
    for _ in range(polygons):
        rings = []
        for k in range(1 + holes):
            (x, y), side = rng.integers(0, 9, 2), int(rng.integers(1, 12 if k == 0 else 4))
            turned = np.array([(x - side, y), (x, y + side), (x + side, y), (x, y - side), (x - side, y)], float)
            ring = turned if rng.random() < 0.4 else np.array([(x, y), (x, y + side), (x + side, y + side), (x + side, y), (x, y)], float)
            rings.append(ring if k == 0 else ring[::-1])
        out.append(rings)
    return out


def test_holes_of_whole_batches(monkeypatch):
    """Polygons with holes are tested together: no Arrangement is made but where rings touch without another fault."""
    import pyarrow as pa

    from atlasq.functions import batches as B

    rng = np.random.default_rng(1)
    shapes = [C.Geometry("Polygon", _squares(rng, 1, int(rng.integers(0, 4)))[0]) for _ in range(800)]
    wide = np.linspace(0, 2 * math.pi, 150)[::-1]
    ring = np.stack([50 * np.cos(wide), 50 * np.sin(wide)], 1)
    ring[-1] = ring[0]
    shapes += [C.Geometry("Polygon", [ring, *_squares(rng, 1, 1)[0][1:]]), C.Geometry("Polygon", [_squares(rng, 1, 0)[0][0], np.zeros((0, 2))])]
    b = B.Batch(pa.array([C.to_wkb(g) for g in shapes], pa.binary()))
    want = [S.invalid_reason(g) for g in shapes]
    assert len(set(want)) > 6 and B.invalid_reason(b) == want
    hole = lambda p, q: [[(0, 0), (0, 10), (10, 10), (10, 0), (0, 0)], [(p, q), (p + 3, q), (p + 3, q + 3), (p, q + 3), (p, q)]]
    shapes = [C.Geometry("Polygon", [C.points(r) for r in hole(p, q)]) for p in range(-5, 12) for q in range(-5, 11)]
    want = [S.invalid_reason(g) for g in shapes]

    def none(*_):
        raise AssertionError("a row by itself")

    monkeypatch.setattr(S, "invalid_reason", none)
    touching = {(p, q) for p in (-3, 10) for q in (-3, 10)}
    keep = [i for i, (p, q) in enumerate((p, q) for p in range(-5, 12) for q in range(-5, 11)) if (p, q) not in touching]
    b = B.Batch(pa.array([C.to_wkb(shapes[i]) for i in keep], pa.binary()))
    assert B.invalid_reason(b) == [want[i] for i in keep]


def test_texts_of_whole_batches():
    """Usual spellings are read together, others by themselves, with the same bytes."""
    import pyarrow as pa

    from atlasq.functions import batches as B

    rng = np.random.default_rng(2)
    run = lambda: "(" + ",".join(f"{x:.3g} {y}" for x, y in rng.normal(0, 100, (rng.integers(1, 6), 2))) + ")"
    many = lambda f: "(" + ", ".join(f() for _ in range(rng.integers(1, 4))) + ")"
    texts = [t for _ in range(60) for t in (f"POINT({rng.integers(9)} -3)", "LINESTRING " + run(), "POLYGON" + many(run), "MULTIPOLYGON" + many(lambda: many(run)))]
    alone: list[str] = []

    def row(text: str) -> bytes | None:
        alone.append(text)
        g = B.readable(C.from_wkt, text)
        return None if g is None else C.to_wkb(g)

    assert B.from_wkt(pa.array(texts), row).to_pylist() == [C.to_wkb(C.from_wkt(t)) for t in texts] and not alone
    odd = ["", "POINT(1 2", "POINT(1 2 3)", "POINT(1 2,3 4)", "POLYGON((0 0,1 1)", "POLYGON((0 0),)", "POLYGON(0 0,1 1)", "LINESTRING(1 2,3)", "LINESTRING(1e400 +3)", "LINESTRING(1-2 3)", "MULTIPOLYGON(((1 2)),(1 2))", "POINT EMPTY", "point(1 2)", "LINESTRING(.5 7.)", "LINESTRING(1  2)", "POINT(1 2)(3 4)"]
    mixed = [v for pair in zip(odd, texts) for v in (*pair, None)]
    told = B.from_wkt(pa.array(["cut off", *mixed]).slice(1), row).to_pylist()
    assert told == [None if t is None else row(t) for t in mixed]
    assert B.from_wkt(pa.array([], pa.string()), row).to_pylist() == []


def test_parts_of_whole_batches(monkeypatch):
    """Multipolygons are decoded and tested together, whatever their parts and holes."""
    import pyarrow as pa

    from atlasq.functions import batches as B

    rng = np.random.default_rng(3)
    shapes = [C.Geometry("MultiPolygon", [p for _ in range(rng.integers(0, 4)) for p in _squares(rng, 1, int(rng.integers(0, 2)))]) for _ in range(800)]
    shapes += [C.Geometry("MultiPolygon", [[], _squares(rng, 1, 0)[0]])]
    raws = [C.to_wkb(g) for g in shapes]
    b = B.Batch(pa.array([*raws, raws[5][:-3], C.to_wkb(shapes[5], ">"), None], pa.binary()))
    assert (b.kind[: len(shapes)] == 6).all() and not b.kind[len(shapes) :].any() and b.rest.tolist() == [len(shapes), len(shapes) + 1]
    want = [S.invalid_reason(g) for g in shapes]
    assert len(set(want)) > 5 and B.invalid_reason(b)[: len(shapes)] == want
    for told, alone in ((B.area(b), S.area), (B.path_length(b), S.path_length), (B.is_simple(b), S.is_simple), (B.envelope(b), S.envelope), (B.centroid(b), S.centroid)):
        for i, g in enumerate(shapes):
            got, own = tuple(told[n][i] for n in told) if isinstance(told, dict) else told[i], alone(g)
            assert math.isnan(got[0]) if own is None else got == pytest.approx(own), C.to_wkt(g)
    pair = lambda p, q: C.Geometry("MultiPolygon", [[C.points([(x, y), (x, y + 4), (x + 4, y + 4), (x + 4, y), (x, y)])] for x, y in ((4, 4), (p, q))])
    shapes = [pair(p, q) for p in range(11) for q in range(13)]
    want = [S.invalid_reason(g) for g in shapes]
    monkeypatch.setattr(S, "invalid_reason", None)
    assert B.invalid_reason(B.Batch(pa.array([C.to_wkb(g) for g in shapes], pa.binary()))) == want


def test_inner_points():
    """A long tongue draws the farthest point off, the centroid holds the other one back."""
    key = C.from_wkt("POLYGON((0 0,0 6,6 6,6 4,20 4,20 2,6 2,6 0,0 0))")
    assert S.polylabel(key) == pytest.approx((3, 3), abs=0.3)
    x, y = S.interior(key)
    cx, cy = S.centroid(key)
    value = lambda x, y: S.ring_distances(key.parts, np.array([x]), np.array([y]))[0] * (1 - math.hypot(x - cx, y - cy) / 20)
    grid = max(value(u, v) for u in np.linspace(0.1, 19.9, 67) for v in np.linspace(0.1, 5.9, 29))
    assert value(x, y) >= grid - 0.2 and 3 <= x < 6


def test_columns(spark):
    df = spark.createDataFrame([("POLYGON((0 0,0 2,2 2,2 0,0 0))",), ("nonsense",), (None,)], "wkt string").withColumn("geom", G.from_wkt("wkt"))
    rows = df.select(G.to_wkt("geom").alias("w"), G.wkb_kind(F.col("geom")).alias("k"), G.wkb_kind(G.big_endian_wkb("geom")).alias("b"), G.centroid("geom")["x"].alias("x"), F.size(G.vertices("geom")).alias("n")).collect()
    assert (rows[0].w, rows[0].k, rows[0].b, rows[0].x, rows[0].n) == ("POLYGON((0 0,0 2,2 2,2 0,0 0))", 3, 3, 1.0, 5) and rows[1].w is None and rows[2].w is None
    back = df.limit(1).select(G.to_wkt(G.reproject("epsg:3857", "epsg:4326")(G.reproject("epsg:4326", "epsg:3857")("geom"))).alias("w")).first().w
    assert S.centroid(C.from_wkt(back)) == pytest.approx((1, 1))


def _square_ring(x, y, side):
    return f"({x} {y},{x} {y + side},{x + side} {y + side},{x + side} {y},{x} {y})"


def _reason(*polygons):
    """polygons as lists of ring texts; rings are turned the right way first."""
    return S.invalid_reason(S.corrected(C.from_wkt("MULTIPOLYGON(" + ",".join("(" + ",".join(p) + ")" for p in polygons) + ")")))


def test_validity_between_rings():
    q = _square_ring
    assert _reason([q(0, 0, 10), q(2, 2, 3), q(6, 6, 2)]) is None
    assert _reason([q(0, 0, 10), q(8, 2, 4)]) == "a hole crosses its ring" and _reason([q(0, 0, 10), q(20, 2, 4)]) == "a hole lies outside its ring"
    assert _reason([q(0, 0, 10), q(1, 1, 8), q(3, 3, 2)]) == "a hole lies inside another" and _reason([q(0, 0, 10), q(1, 1, 4), q(3, 3, 4)]) == "two holes cross"
    assert _reason([q(0, 0, 10), q(0, 2, 4)]) == "two rings share a piece" and _reason([q(0, 0, 10), q(2, 2, 2), q(4, 4, 2)]) is None
    assert _reason([q(0, 0, 10), "(0 5,2 4,2 6,0 5)"]) is None and _reason([q(0, 0, 10), "(0 5,5 4,10 5,5 6,0 5)"]) == "holes cut the inside in two"
    assert _reason([q(0, 0, 9)], [q(5, 5, 9)]) == "two parts overlap" and _reason([q(0, 0, 9)], [q(3, 3, 2)]) == "two parts overlap"
    assert _reason([q(0, 0, 9)], [q(9, 9, 9)]) is None and _reason([q(0, 0, 9), q(1, 1, 7)], [q(2, 2, 2)]) is None
    assert _reason([q(0, 0, 9)], [q(9, 0, 9)]) == "two rings share a piece" and _reason([q(0, 0, 9), q(1, 1, 7)], [q(2, 2, 2)], [q(3, 3, 2)]) == "two parts overlap"
    around = "(" + ",".join(f"{50 + 40 * math.cos(t / 200 * math.pi):.6f} {50 + 40 * math.sin(t / 200 * math.pi):.6f}" for t in range(400))
    assert _reason([around + "," + around[1:].split(",")[0] + ")", *(q(30 + 4 * i, 40, 2) for i in range(8))]) is None


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9), st.integers(1, 5)), min_size=2, max_size=4))
def test_validity_of_squares(squares):
    """Squares as parts of one area: any two share no border piece and no inside."""
    lap = lambda a, b, m, n: min(a + m, b + n) - max(a, b)

    def fine(s, t):
        x, y = lap(s[0], t[0], s[2], t[2]), lap(s[1], t[1], s[2], t[2])
        return x < 0 or y < 0 or x == y == 0

    want = all(fine(s, t) for i, s in enumerate(squares) for t in squares[i + 1 :])
    assert (_reason(*[[_square_ring(*s)] for s in squares]) is None) == want


def test_strips():
    """A line keeps a point when those since the last kept one don't all fit into the strip of twice the tolerance to the next."""
    rng = np.random.default_rng(7)
    for _ in range(100):
        a = np.cumsum(rng.normal(size=(25, 2)) * (1, 0.4) + (0.6, 0), axis=0)
        kept = [0]
        for i in range(2, len(a)):
            d = a[i] - a[kept[-1]]
            n = np.hypot(*d)
            w = a[kept[-1] + 1 : i] - a[kept[-1]]
            along, across = w @ d / n, (w[:, 0] * d[1] - w[:, 1] * d[0]) / n
            if not ((along > 0) & (along < n) & (abs(across) < 0.9)).all():
                kept.append(i - 1)
        assert (S.sleeve(a, 0.9) == a[[*kept, len(a) - 1]]).all()
    ring = np.array([(0, 0), (0, 9), (5, 9), (9, 9), (9, 0), (4, 0), (0, 0)], float)
    assert S.sleeve(ring, 0.5, True).tolist() == [[0, 0], [0, 9], [9, 9], [9, 0], [4, 0], [0, 0]]


def _degrees(d, m=0.0, s=0.0):
    return d + m / 60 + s / 3600


#: Control points published by mapping authorities: plane, longitude, latitude, x, y, and the digits that are given.
CONTROL = [
    ("+proj=tmerc +lat_0=49 +lon_0=-2 +k=0.9996012717 +x_0=400000 +y_0=-100000 +ellps=airy", _degrees(1, 43, 4.5177), _degrees(52, 39, 27.2531), 651409.903, 313177.270, 1e-3),
    ("+proj=lcc +lat_1=49.5 +lat_0=49.5 +lon_0=2.337229166666667 +k_0=0.999877341 +x_0=600000 +y_0=200000 +a=6378249.2 +b=6356515", math.degrees(0.145512099), math.degrees(0.872664626), 1029705.083, 272723.849, 1e-3),
    ("+proj=lcc +lat_0=27.833333333333333 +lon_0=-99 +lat_1=28.383333333333333 +lat_2=30.283333333333333 +x_0=609601.2192024384 +ellps=clrk66 +units=us-ft", -96.0, 28.5, 2963503.91, 254759.80, 5e-3),
    ("epsg:32638", 44.4, 33.3, 444140.54, 3684706.36, 1e-2),
]


@pytest.mark.parametrize("srs, lon, lat, x, y, digits", CONTROL)
def test_control_points(spark, srs, lon, lat, x, y, digits):
    from atlasq.functions import projection

    assert projection.project_point(lon, lat, projection.LONLAT, srs) == pytest.approx((x, y), abs=digits)
    assert projection.project_point(*projection.project_point(lon, lat, projection.LONLAT, srs), srs, projection.LONLAT) == pytest.approx((lon, lat), abs=1e-11)
    df = spark.createDataFrame([(lon, lat)], "lon double, lat double")
    px, py = projection.project(F.col("lon"), F.col("lat"), projection.LONLAT, srs)
    qx, qy = projection.project(px, py, srs, projection.LONLAT)
    row = df.select(px.alias("px"), py.alias("py"), qx.alias("qx"), qy.alias("qy")).first()
    assert (row.px, row.py) == pytest.approx((x, y), abs=digits) and (row.qx, row.qy) == pytest.approx((lon, lat), abs=1e-11)


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(["epsg:32601", "epsg:32760", "epsg:25832", "epsg:2154", "epsg:3034", "+proj=lcc +lat_1=-20 +lat_2=-35 +lat_0=-28 +lon_0=130 +ellps=GRS80"]), st.floats(-3, 3), st.floats(-80, 84))
def test_planes_there_and_back(srs, off, lat):
    from atlasq.functions import crs

    p = crs.plane(srs)
    lon = (p.lon + off + 180) % 360 - 180
    back = p.backward(*p.forward(lon, lat))
    assert back[1] == pytest.approx(lat, abs=1e-9) and math.cos(math.radians(back[0] - lon)) == pytest.approx(1, abs=1e-15)
    # scale along the meridian and the parallel is the same: both planes are conformal
    h = 1e-4
    x, y = p.forward(lon, lat)
    along = math.dist(p.forward(lon, lat + h), (x, y)) / (p.a * (1 - p.e**2) / (1 - (p.e * math.sin(math.radians(lat))) ** 2) ** 1.5)
    across = math.dist(p.forward(lon + h, lat), (x, y)) / (p.a * math.cos(math.radians(lat)) / math.sqrt(1 - (p.e * math.sin(math.radians(lat))) ** 2))
    assert along == pytest.approx(across, rel=1e-4)


def test_unknown_planes():
    from atlasq.functions import projection
    from atlasq.functions.boxes import Extent

    for srs in ("epsg:9999", "+proj=aea +lat_1=1", "epsg:32661"):
        with pytest.raises(NotImplementedError):
            projection.known(srs)
    box = projection.project_extent(Extent(0.0, 45.0, 6.0, 50.0), projection.LONLAT, "epsg:2154")
    # the sides bend: the lowest point of the southern one lies on the central meridian
    assert box.miny == pytest.approx(projection.project_point(3.0, 45.0, projection.LONLAT, "epsg:2154")[1], abs=500) and box.miny < projection.project_point(0.0, 45.0, projection.LONLAT, "epsg:2154")[1]
