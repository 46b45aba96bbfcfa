"""Hit tests and box joins."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.boxes import Box
from ..sources import scratch
from .ordering import free_names

#: Sides up to this many bytes (by Catalyst's own estimate) may be broadcast by join_boxes().
BROADCAST_BYTES = 32 << 20
#: Bytes of a table (by the same estimate) for each array that rows with one place go to, and tasks of a join for each core.
ARRAY_BYTES, TASKS_PER_CORE = 8 << 20, 4
#: Arrays for each place of a table whose size Catalyst doesn't know, and the estimate from which on that is so.
ARRAYS, UNKNOWN_BYTES = 64, 1 << 50
#: Pairs of points, in all and for each point, that nearest_within() looks at before it tries a smaller distance.
PAIRS, PAIRS_PER_POINT = 50_000_000, 32


def hit_test(df: DataFrame, x: float, y: float, tolerance: float) -> DataFrame:
    """Rows of a spatial table that a point hits. Tables of points (x, y without geom) stay in expressions."""
    if "geom" not in df.columns:
        d = F.sqrt(F.pow(F.col("x") - x, 2) + F.pow(F.col("y") - y, 2))
        return df.where(d <= tolerance)
    near = Box.columns().intersects(Box.around(F.lit(float(x)), F.lit(float(y)), tolerance))
    return df.where(near).where(G.hit("geom", F.lit(float(x)), F.lit(float(y)), F.lit(float(tolerance))))


def cells(box: Box, size: float) -> Column:
    """The grid cells that a box meets, as {cx, cy}. A box over very many cells costs as many rows: choose size by the boxes."""
    at = lambda c: F.floor(c / size).cast("long")
    xs, ys = F.sequence(at(box.minx), at(box.maxx)), F.sequence(at(box.miny), at(box.maxy))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def grouped(df: DataFrame, by: list[str], rows: str) -> DataFrame:
    """by, and an array of all rows that share it: structs of their other columns, or the values of the only one. Rows without one of by are left out.

    Equal places are then joined once, not once for each pair of copies. Copies beyond what a task should hold at once
    come in several arrays: as many as Catalyst's estimate of the table asks for at ARRAY_BYTES each, or ARRAYS where it has none.
    """
    names = [c for c in df.columns if c not in by]
    others = [F.col(f"`{c}`") for c in names] or [F.lit(True).alias("none")]
    size = estimated_bytes(df)
    arrays = 1 + size // ARRAY_BYTES if size < UNKNOWN_BYTES else ARRAYS
    (share,) = free_names("_share", df, rows)
    dealt = df.where(reduce(lambda u, v: u & v, [F.col(f"`{c}`").isNotNull() for c in by])).withColumn(share, F.pmod(F.monotonically_increasing_id(), F.lit(arrays)))
    out = dealt.groupBy(*(f"`{c}`" for c in by), share).agg(F.collect_list(F.struct(*others)).alias(rows)).drop(share)
    return out.withColumn(rows, F.col(rows)[names[0]]) if len(names) == 1 else out


def _tasks(df: DataFrame) -> int:
    """Tasks of a join whose sides are small for what they give; a fixed number isn't joined to fewer tasks by bytes."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_PER_CORE * spark.sparkContext.defaultParallelism)


def _in_cells(left: DataFrame, right: DataFrame, left_cells: Column, right_cells: Column, condition: Callable[[Column, Column], Column]) -> DataFrame:
    """left joined with right where they share a cell {cx, cy} and the condition on that cell holds. Sides that are small in bytes aren't broadcast: they may give very many pairs."""
    cx, cy, rx, ry, cell = free_names("_cx _cy _rcx _rcy _cell", left, right)
    n = _tasks(left)
    dealt = lambda df, own, x, y: df.withColumn(cell, F.explode(own)).withColumns({x: F.col(f"{cell}.cx"), y: F.col(f"{cell}.cy")}).drop(cell).repartition(n, x, y)
    lc, rc = dealt(left, left_cells, cx, cy), dealt(right, right_cells, rx, ry)
    return lc.join(rc.hint("merge"), (F.col(cx) == F.col(rx)) & (F.col(cy) == F.col(ry)) & condition(F.col(cx), F.col(cy))).drop(cx, cy, rx, ry)


def _unfolded(pairs: DataFrame, left: DataFrame, right: DataFrame, by: list[str], rows: str) -> DataFrame:
    """Rows of left with groups of right, by these columns, as rows of both: all columns of left, then all of right, alike names or not."""
    kept, own = [F.col(f"`{c}`") for c in left.columns], [F.col(f"`{c}`") for c in by]
    others = [c for c in right.columns if c not in by]
    value = lambda c: F.col(f"`{c}`") if c in by else (F.col(rows) if len(others) == 1 else F.col(rows)[c]).alias(c)
    return pairs.select(*kept, *own, F.explode(rows).alias(rows)).select(*kept, *map(value, right.columns))


def _sides(prefix: str) -> list[str]:
    return [f"{prefix}{c}" for c in ("minx", "miny", "maxx", "maxy")]


def _meet_once(a: Box, b: Box, size: float) -> Callable[[Column, Column], Column]:
    """Whether two boxes meet, in the cell of the lower left corner of what they share."""
    first = lambda u, v: F.floor(F.greatest(u, v) / size).cast("long")
    return lambda cx, cy: a.intersects(b) & (cx == first(a.minx, b.minx)) & (cy == first(a.miny, b.miny))


def join_boxes(left: DataFrame, right: DataFrame, size: float, how: str = "inner", left_prefix: str = "l_", right_prefix: str = "r_") -> DataFrame:
    """Pairs of rows whose boxes meet (closed), each once. Both sides have minx, miny, maxx, maxy under their prefixes.

    Boxes are dealt to grid cells of a size, cells are joined by equality (which partitions, spills and
    is split where a cell is hot), and a pair counts in the cell of the lower left corner of what the
    two boxes share, so that it comes out once without a distinct. Rows of right with equal boxes are joined as one and
    come apart at the end. how may be left_semi or left_anti.
    """
    a, b = Box.columns(left_prefix), Box.columns(right_prefix)
    if how in ("left_semi", "left_anti"):
        if estimated_bytes(right) <= BROADCAST_BYTES:
            return left.join(F.broadcast(right), a.intersects(b), how)
        (row,) = free_names("_row", left, right)
        keyed = left.withColumn(row, F.monotonically_increasing_id())
        found = join_boxes(keyed, right, size, "inner", left_prefix, right_prefix).select(row).distinct()
        return keyed.join(found, row, how).drop(row)
    (rows,) = free_names("_rows", left, right)
    groups = grouped(right, _sides(right_prefix), rows)
    return _unfolded(_in_cells(left, groups, cells(a, size), cells(b, size), _meet_once(a, b, size)), left, right, _sides(right_prefix), rows)


def self_join_boxes(df: DataFrame, size: float, key: str, first: str, second: str) -> DataFrame:
    """first and second: the keys of pairs of rows of one table whose boxes meet, the smaller key first."""
    left = df.select(F.col(key).alias("l_key"), *(F.col(c).alias(f"l_{c}") for c in _sides("")))
    right = df.select(F.col(key).alias("r_key"), *(F.col(c).alias(f"r_{c}") for c in _sides(""))).where(F.col("r_key").isNotNull())
    groups = grouped(right, _sides("r_"), "keys").withColumn("most", F.array_max("keys"))
    a, b = Box.columns("l_"), Box.columns("r_")
    meet = _meet_once(a, b, size)
    pairs = _in_cells(left, groups, cells(a, size), cells(b, size), lambda cx, cy: (F.col("l_key") < F.col("most")) & meet(cx, cy))
    return pairs.select(F.col("l_key").alias(first), F.explode("keys").alias(second)).where(F.col(first) < F.col(second))


def join_points(points: DataFrame, boxes: DataFrame, size: float, x: str = "x", y: str = "y", prefix: str = "") -> DataFrame:
    """Points and the boxes that hold them. A point lies in one cell, so only boxes are multiplied; equal boxes are joined as one and come apart at the end."""
    b = Box.columns(prefix)
    (rows,) = free_names("_rows", points, boxes)
    own = F.array(F.struct(F.floor(F.col(x) / size).cast("long").alias("cx"), F.floor(F.col(y) / size).cast("long").alias("cy")))
    pairs = _in_cells(points, grouped(boxes, _sides(prefix), rows), own, cells(b, size), lambda cx, cy: b.contains(F.col(x), F.col(y)))
    return _unfolded(pairs, points, boxes, _sides(prefix), rows)


def join_near(points: DataFrame, others: DataFrame, distance: float, x: str = "x", y: str = "y", ox: str = "ox", oy: str = "oy") -> DataFrame:
    """Pairs of points within a distance: each of the others is dealt to the cells its circle's box meets."""
    box = Box.around(F.col(ox), F.col(oy), distance)
    cx, cy, cell = free_names("_cx _cy _cell", points, others)
    dealt = others.withColumn(cell, F.explode(cells(box, distance)))
    keyed = points.withColumns({cx: F.floor(F.col(x) / distance).cast("long"), cy: F.floor(F.col(y) / distance).cast("long")})
    d = F.sqrt(F.pow(F.col(x) - F.col(ox), 2) + F.pow(F.col(y) - F.col(oy), 2))
    return keyed.join(dealt, (F.col(cx) == F.col(f"{cell}.cx")) & (F.col(cy) == F.col(f"{cell}.cy"))).where(d <= distance).withColumn("distance", d).drop(cx, cy, cell)


def _candidates(points: DataFrame, others: DataFrame, distance: float) -> tuple[int, int]:
    """How many pairs join_near() looks at (others in the nine cells around a point's), and how many points there are."""
    at = lambda c: F.floor(F.col(c) / distance).cast("long")
    own = points.groupBy(at("x").alias("cx"), at("y").alias("cy")).agg(F.count("*").alias("n"))
    around = F.explode(F.array(*(F.struct((at("ox") + i).alias("cx"), (at("oy") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    met = others.select(around.alias("c")).groupBy("c.cx", "c.cy").agg(F.count("*").alias("m"))
    found = own.join(met, ["cx", "cy"], "left").agg(F.sum(F.col("n") * F.coalesce("m", F.lit(0))), F.sum("n")).first()
    return found[0] or 0, found[1] or 0


def nearest_within(points: DataFrame, others: DataFrame, distance: float, key: str, x: str = "x", y: str = "y", ox: str = "ox", oy: str = "oy") -> DataFrame:
    """points with nearest, the key of the nearest of the others within a distance, and apart, how far it is; equally near ones go by key. Points without one are left out.

    Equal points, and equal others, are looked at once. Where the distance holds very many others, a smaller one is
    tried first: who has a neighbour within that needs no farther one, and only the rest goes on to larger distances.
    """
    spots = points.select(F.col(x).alias("x"), F.col(y).alias("y")).where("x is not null and y is not null").distinct()
    kept = others.where(F.col(ox).isNotNull() & F.col(oy).isNotNull()).groupBy(F.col(ox).alias("ox"), F.col(oy).alias("oy")).agg(F.min(key).alias("key"))
    found, least, left = [], distance / 4096, spots
    while True:
        within = distance
        while within / 2 >= least:
            pairs, n = _candidates(left, kept, within)
            if pairs <= max(PAIRS, PAIRS_PER_POINT * n):
                break
            within /= 2
        apart = F.struct((F.pow(F.col("x") - F.col("ox"), 2) + F.pow(F.col("y") - F.col("oy"), 2)).alias("apart"), F.col("key").alias("nearest"))
        near = join_near(left, kept, within).groupBy("x", "y").agg(F.min(apart).alias("best"))
        if within == distance:
            found.append(near)
            break
        found.append(scratch.written(near))
        left, least = scratch.written(left.join(found[-1], ["x", "y"], "left_anti")), 2 * within
    px, py, best = free_names("_px _py _best", points)
    every = reduce(DataFrame.unionByName, found).select(F.col("x").alias(px), F.col("y").alias(py), F.col("best").alias(best))
    joined = points.join(every, (F.col(x) == F.col(px)) & (F.col(y) == F.col(py)))
    return joined.withColumns({"nearest": F.col(best)["nearest"], "apart": F.sqrt(F.col(best)["apart"])}).drop(px, py, best)


def morton(box: Box, extent_width: float = 360.0, bits: int = 16) -> Column:
    """A Z-order key of a box's centre: the bits of its two scaled coordinates in turn."""
    x, y = box.center()
    top = (1 << bits) - 1
    scaled = [F.least(F.greatest(F.floor((c / extent_width + 0.5) * top), F.lit(0)), F.lit(top)).cast("long") for c in (x, y)]
    out = F.lit(0).cast("long")
    for i in range(bits):
        for k, c in enumerate(scaled):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(c, i).bitwiseAND(F.lit(1).cast("long")), 2 * i + k))
    return out


def write_clustered(df: DataFrame, path: str, partitions: int | None = None, extent_width: float = 360.0) -> None:
    """Write a spatial table so that row groups hold near boxes: range partitions and rows in Z-order."""
    key = morton(Box.columns(), extent_width)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (z,) = free_names("_z", df)
    df.withColumn(z, key).repartitionByRange(n, z).sortWithinPartitions(z).drop(z).write.parquet(path)


def cell_size(width: float, rows: int, per_cell: int = 64) -> float:
    """A cell size at which so many evenly spread rows share a cell."""
    return width / max(1.0, math.sqrt(max(rows, 1) / per_cell))
