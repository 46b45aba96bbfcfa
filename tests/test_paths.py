"""Paths as columns against plain walks along them; dashes, strokes, labels on lines."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlasq.functions import codecs as C
from atlasq.functions import geometry as G
from atlasq.functions import paths as P
from atlasq.functions import shapes as S
from atlasq.operators import labels


def walk(a, d):
    """(segment, point) at a distance; none outside."""
    run = 0.0
    for i, (p, q) in enumerate(zip(a[:-1], a[1:])):
        n = math.dist(p, q)
        if run <= d < run + n:
            t = (d - run) / n
            return i, (p[0] + (q[0] - p[0]) * t, p[1] + (q[1] - p[1]) * t)
        run += n
    return None


@pytest.fixture(scope="module")
def wavy(spark):
    rng = np.random.default_rng(8)
    rows = [(k, np.cumsum(rng.normal(size=(rng.integers(2, 40), 2)), axis=0), float(rng.uniform(-1, 30)), float(rng.uniform(-4, 4)), float(rng.uniform(0.1, 5))) for k in range(120)]
    table = [(k, bytearray(C.to_wkb(C.Geometry("LineString", a))), d, w, r) for k, a, d, w, r in rows]
    return rows, spark.createDataFrame(table, "k long, geom binary, d double, w double, r double").withColumn("p", F.element_at(P.measured("geom"), 1))


def test_positions_and_directions(wavy):
    rows, df = wavy
    p, d, w, r = (F.col(c) for c in "pdwr")
    found = df.select("k", P.length(p).alias("length"), P.position(p, d).alias("at"), P.angle(p, d, w).alias("angle"), P.closest(p, d, w).alias("near"), P.to_distance(p, d, r).alias("away"), P.piece(p, F.lit(0.4), P.length(p) * 0.9).alias("piece")).collect()
    for row, (_, a, d, w, r) in zip(sorted(found, key=lambda x: x.k), rows):
        run = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(a, axis=0).T))])
        assert row.length == pytest.approx(run[-1])
        here, there = walk(a, d), walk(a, d + w)
        if here is None:
            assert row["at"] is None and row.angle is None and row.away is None
            continue
        i, c = here
        assert tuple(row["at"]) == pytest.approx(c)
        own = math.atan2(*(a[i + 1] - a[i])[::-1]) + (math.pi if w < 0 else 0)
        inside = run[i] <= d + w <= run[i + 1]
        want = own if inside or there is None else math.atan2(there[1][1] - c[1], there[1][0] - c[0])
        assert math.cos(row.angle - want) == pytest.approx(1)
        dense = np.concatenate([a[j] + (a[j + 1] - a[j]) * np.linspace(0, 1, 400)[:, None] for j in range(len(a) - 1)])
        seen = walk(a, min(row.near, run[-1] * (1 - 1e-12)))[1]
        assert math.dist(seen, (d, w)) <= np.hypot(*(dense - (d, w)).T).min() + 1e-9
        later = [j for j in range(i + 2, len(a)) if math.dist(a[j], c) >= r]
        if d + r < run[i + 1]:
            assert row.away == pytest.approx(d + r)
        elif later:
            assert run[later[0] - 1] - 1e-9 <= row.away <= run[later[0]] + 1e-9 and math.dist(walk(a, min(row.away, run[-1] * (1 - 1e-12)))[1], c) == pytest.approx(r)
        else:
            assert row.away is None
        xs = list(zip(row.piece.x, row.piece.y))
        assert sum(math.dist(u, v) for u, v in zip(xs, xs[1:])) == pytest.approx(run[-1] * 0.9 - 0.4) or run[-1] * 0.9 <= 0.4


def test_measured_paths(spark):
    shapes = ["LINESTRING(0 0,0 0,3 4,3 4,3 5)", "POLYGON((0 0,0 4,4 4,4 0,0 0),(1 1,2 1,2 2,1 1))", "MULTILINESTRING((0 0,1 0),(5 5,5 7))", "POINT(1 2)", "LINESTRING EMPTY", None, "MULTIPOLYGON(((0 0,0 1,1 1,0 0)),((5 5,5 6,6 6,5 5)))", "LINESTRING(2 2,2 2)"]
    rows = [(i, bytearray(C.to_wkb(C.from_wkt(t))) if t else None) for i, t in enumerate(shapes)] + [(99, bytearray(b"no"))]
    found = {r.i: r.m for r in spark.createDataFrame(rows, "i int, g binary").select("i", P.measured("g").alias("m")).collect()}
    assert [list(p["at"]) for p in found[0]] == [[0, 5, 6]] and [len(p["x"]) for p in found[1]] == [5, 4] and [list(p["at"]) for p in found[2]] == [[0, 1], [0, 2]]
    assert [list(p["at"]) for p in found[3]] == [[0]] and found[4] == [] and found[5] is None and found[99] is None and [p["x"][0] for p in found[6]] == [0, 5] and [list(p["at"]) for p in found[7]] == [[0]]


@pytest.mark.parametrize("pattern, begin", [((1.5, 1.0), 0.0), ((2.0,), 0.7), ((0.3, 0.2, 1.1, 0.6), 5.0), ((0.0, 1.0), 0.0), ((9.0, 90.0), 0.0)])
def test_dashes(wavy, pattern, begin):
    rows, df = wavy
    found = {r.k: r.m for r in df.select("k", P.dashes(F.col("p"), pattern, begin).alias("m")).collect()}
    own = pattern if len(pattern) % 2 == 0 else pattern * 2
    for k, a, *_ in rows:
        total, want, at, i = float(np.hypot(*np.diff(a, axis=0).T).sum()), [], -begin, 0
        while at < total:
            if i % 2 == 0 and at + own[i % len(own)] > 0 and max(at, 0.0) < min(at + own[i % len(own)], total):
                want.append((max(at, 0.0), min(at + own[i % len(own)], total)))
            at += own[i % len(own)]
            i += 1
        assert [(m["start"], m["end"]) for m in found[k]] == [pytest.approx(w) for w in want]
        for m in found[k]:
            line = list(zip(m["x"], m["y"]))
            assert sum(math.dist(u, v) for u, v in zip(line, line[1:])) == pytest.approx(m["end"] - m["start"])
    lines = df.select(F.explode(P.dashes(F.col("p"), (1.5, 1.0))).alias("m")).select(P.line_wkb("m.x", "m.y").alias("g"), "m.start", "m.end")
    assert all(r.n == pytest.approx(r.end - r.start) for r in lines.select(G.path_length("g").alias("n"), "start", "end").collect())


def test_strokes():
    line = C.points([(0, 0), (10, 0), (10, 6)])
    area = lambda **k: abs(S.signed_area(S.stroked(line, 2.0, **k)[0]))
    assert area() == pytest.approx(32) and area(join="bevel") == pytest.approx(31.5) and area(cap="square") == pytest.approx(36)
    assert area(join="round") == pytest.approx(31 + math.pi / 4, abs=0.01) and area(cap="round") == pytest.approx(32 + math.pi, abs=0.05)
    sharp = C.points([(0, 0), (10, 0), (0, 1)])
    reach = lambda limit: S.stroked(sharp, 2.0, limit=limit)[0][:, 0].max()
    assert reach(4.0) < 14.1 < reach(30.0) and reach(1.0) < reach(2.0)
    square = C.points([(0, 0), (0, 10), (10, 10), (10, 0), (0, 0)])
    outer, inner = sorted((abs(S.signed_area(r)) for r in S.stroked(square, 2.0, ring=True)), reverse=True)
    assert outer == pytest.approx(144) and inner == pytest.approx(64)
    assert S.stroked(C.points([(1, 1), (1, 1)]), 2.0) == [] and abs(S.signed_area(S.stroked(C.points([(1, 1)]), 2.0, cap="square")[0])) == pytest.approx(4)
    ring = S.outline(C.from_wkt("POLYGON((0 0,0 10,10 10,10 0,0 0))"), 2.0)
    assert S.area(ring) == pytest.approx(80) and S.invalid_reason(ring) is None and S.invalid_reason(S.outline(C.Geometry("LineString", line), 1.0, "round", "round")) is None
    with pytest.raises(ValueError):
        S.stroked(line, 1.0, join="odd")


def test_area(spark):
    shapes = {"POLYGON((0 0,0 4,4 4,4 0,0 0),(1 1,2 1,2 2,1 2,1 1))": 15, "MULTIPOLYGON(((0 0,0 1,1 1,0 0)),((5 5,5 7,7 7,5 5)))": 2.5, "LINESTRING(0 0,1 1)": 0, "POINT(1 1)": 0}
    found = spark.createDataFrame([(t, bytearray(C.to_wkb(C.from_wkt(t)))) for t in shapes], "t string, g binary").select("t", G.area("g").alias("a")).collect()
    assert {r.t: r.a for r in found} == shapes


def test_line_labels(spark):
    rows = [(1, "LINESTRING(0 0,20 0)"), (2, "LINESTRING(20 5,0 5)"), (3, "LINESTRING(0 0,1 0)"), (4, "LINESTRING(0 50,10 50,10 60)"), (5, "MULTILINESTRING((0 90,9 90),(0 95,3 95))")]
    df = spark.createDataFrame(rows, "k int, t string").withColumn("geom", G.from_wkt("t")).withColumns({"_path": F.lit("own"), "_start": F.lit("own")})
    found = labels.line_labels(df, 4.0, 1.0, 6.0, shifts=(0.0, 1.0, -1.0), most_turn=1.0).orderBy("k", "path", "place", "shift").collect()
    at = lambda k, s=0.0: [(r.place, round(r.x, 6), round(r.y, 6), round(r.angle, 6)) for r in found if r.k == k and r.shift == s]
    assert at(1) == [(0, 5, 0, 0), (1, 15, 0, 0)] and at(2) == [(0, 15, 5, 0), (1, 5, 5, 0)] and at(3) == [] and all(r["_path"] == "own" and r["_start"] == "own" for r in found)
    # the bend lies in the second place's text only when it is moved back
    assert at(4) == [(0, 5, 50, 0), (1, 10, 55, round(math.pi / 2, 6))] and at(5) == [(0, 4.5, 90, 0)]
    box = next(r for r in found if r.k == 4 and r.place == 1 and r.shift == 0)
    assert (box.minx, box.maxx, box.miny, box.maxy) == pytest.approx((9.5, 10.5, 53, 57))
    every = labels.line_labels(df.where("k in (1, 2)"), 4.0, 12.0, 6.0, shifts=(0.0, 5.0)).withColumn("m", F.lit(1)).withColumn("rank", F.expr("k * 10 + place * 2 + shift / 100"))
    every = every.withColumn("candidate_of", F.concat_ws("/", "k", "candidate_of"))
    placed = labels.place_labels(every, "m", ["rank"], (-100.0, -100.0, 100.0, 100.0)).where("placed").collect()
    # the first line has its places; the second one, too near for them, only the gap between, by a shift
    assert {(r.k, r.place) for r in placed if r.k == 1} == {(1, 0), (1, 1)} and [(r.place, r["shift"], round(r.x, 6)) for r in placed if r.k == 2] == [(0, 5.0, 10.0)]


def test_maps_of_whole_batches(spark):
    """Affine maps and reprojection of rows decoded together and of all others; nulls and what can't be read stay null."""
    from atlasq.functions import projection

    shapes = ["POINT(1 2)", "POINT EMPTY", "LINESTRING(0 0,10 20,-30 40)", "POLYGON((0 0,0 4,4 4,4 0,0 0),(1 1,2 1,2 2,1 1))", "MULTIPOINT(1 1,2 2)", "MULTIPOLYGON(((0 0,0 1,1 1,0 0)),((5 5,5 7,7 7,5 5)))", "GEOMETRYCOLLECTION(POINT(3 3),LINESTRING(0 0,1 1))", "LINESTRING EMPTY", None]
    rows = [(i, bytearray(C.to_wkb(C.from_wkt(t))) if t else None, t) for i, t in enumerate(shapes)] + [(98, bytearray(b"no"), None), (99, bytearray(C.to_wkb(C.from_wkt("POINT(7 8)"), ">")), "POINT(7 8)")]
    df = spark.createDataFrame(rows, "i int, g binary, t string").coalesce(1)
    number = [F.lit(v) for v in (2.0, 1.0, 0.0, -1.0, 3.0, 0.0)]
    found = {r.i: r for r in df.select("i", "t", G.affine("g", *number).alias("a"), G.reproject(projection.LONLAT, projection.MERCATOR)("g").alias("m")).collect()}
    for i, r in found.items():
        if r.t is None:
            assert r.a is None and r.m is None
            continue
        g = C.from_wkt(r.t)
        assert C.to_wkt(C.from_wkb(bytes(r.a))) == C.to_wkt(S.converted(g, transform=(2.0, 1.0, 0.0, -1.0, 3.0, 0.0)))
        want = [projection.project_point(x, y, projection.LONLAT, projection.MERCATOR) for a in g.arrays for x, y in a.tolist() if x == x]
        got = [tuple(p) for a in C.from_wkb(bytes(r.m)).arrays for p in a.tolist() if p[0] == p[0]]
        assert got == [pytest.approx(w, abs=1e-6) for w in want]
    back = df.where("i = 3").select(G.reproject(projection.MERCATOR, projection.LONLAT)(G.reproject(projection.LONLAT, projection.MERCATOR)("g")).alias("w")).first().w
    assert np.allclose(np.concatenate(C.from_wkb(bytes(back)).arrays), np.concatenate(C.from_wkt(shapes[3]).arrays))
    zone = df.where("i = 2").select(G.reproject(projection.LONLAT, "epsg:32631")("g").alias("w")).first().w
    assert C.from_wkb(bytes(zone)).parts[0].tolist() == pytest.approx(projection.project_point(0, 0, projection.LONLAT, "epsg:32631"))
    assert df.select(G.affine("g", F.lit(None).cast("double"), *number[1:]).alias("a")).where("a is not null").count() == 0


def test_outlines_of_whole_batches():
    """Strokes of open lines are worked out together; round ones, rings and dots go by themselves."""
    import pyarrow as pa

    from atlasq.functions import batches as B

    rng = np.random.default_rng(4)
    lines, drawn = [], []
    for k in range(1500):
        a = rng.integers(0, 4, (rng.integers(1, 8), 2)).astype(float) if k % 2 else rng.random((rng.integers(2, 8), 2))
        lines.append(np.concatenate([a, a[:1]]) if k % 10 == 0 else a)
        drawn.append((float(rng.choice([0.2, 1.0, 3.0])), str(rng.choice(["miter", "bevel", "miter-revert"])), str(rng.choice(["butt", "square"])), float(rng.choice([1.0, 2.0, 8.0]))))
    b = B.Batch(pa.array([C.to_wkb(C.Geometry("LineString", a)) for a in lines], pa.binary()))
    width, join, cap, limit = (list(v) for v in zip(*drawn))
    rows, told = B.outline(b, np.array(width), join, cap, np.array(limit))
    assert rows.tolist() == [i for i, a in enumerate(lines) if len(np.unique(a, axis=0)) > 1]
    for i, raw in zip(rows.tolist(), told.to_pylist()):
        got, want = C.from_wkb(raw).arrays, S.outline(C.Geometry("LineString", lines[i]), *drawn[i]).arrays
        assert [x.shape for x in got] == [x.shape for x in want] and np.allclose(np.concatenate(got), np.concatenate(want), atol=1e-9), (lines[i], drawn[i])
    assert not len(B.outline(b, np.array(width), ["round"] * len(lines), cap, np.array(limit))[0])


def test_outline_column(spark):
    rows = [("LINESTRING(0 0,4 0,4 3)", 1.0, "miter"), ("LINESTRING(0 0,4 0,4 3)", 1.0, "round"), ("POLYGON((0 0,0 9,9 9,9 0,0 0))", 1.0, "bevel"), ("MULTILINESTRING((0 0,1 0),(5 5,6 6))", 1.0, "miter"), ("LINESTRING(1 1,1 1)", 1.0, "miter"), (None, 1.0, "miter"), ("LINESTRING(0 0,1 0)", None, "miter")]
    df = spark.createDataFrame(rows, "t string, w double, j string").coalesce(1).withColumn("g", G.from_wkt("t"))
    got = [r.o for r in df.select(G.outline("g", "w", "j", F.lit("square"), F.lit(4.0)).alias("o")).collect()]
    for (t, w, j), o in zip(rows, got):
        want = None if t is None or w is None else C.to_wkt(S.outline(C.from_wkt(t), w, j, "square", 4.0))
        assert (None if o is None else C.to_wkt(C.from_wkb(bytes(o)))) == want
