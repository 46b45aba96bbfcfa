"""Label and marker placement, and symbols that spread over numbered columns."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..functions import paths as P
from ..plans.spec import Rule
from ..sources import scratch
from .ordering import free_names, numbered


class Detector:
    """Boxes placed so far, in a hash of cells, with the texts of labels."""

    def __init__(self, extent: tuple[float, float, float, float], cell: float | None = None) -> None:
        self.extent = extent
        self.cell = cell or max(extent[2] - extent[0], extent[3] - extent[1], 1e-9) / 32
        self.cells: dict[tuple[int, int], list[tuple]] = {}

    def _span(self, b: tuple) -> Iterator[tuple[int, int]]:
        for i in range(int(np.floor(b[0] / self.cell)), int(np.floor(b[2] / self.cell)) + 1):
            for j in range(int(np.floor(b[1] / self.cell)), int(np.floor(b[3] / self.cell)) + 1):
                yield i, j

    def _near(self, b: tuple) -> Iterator[tuple]:
        for c in self._span(b):
            yield from self.cells.get(c, ())

    @staticmethod
    def _meet(a: tuple, b: tuple) -> bool:
        return a[0] <= b[2] and a[2] >= b[0] and a[1] <= b[3] and a[3] >= b[1]

    def free(self, box: tuple, margin: float = 0.0, text: str | None = None, repeat: float = 0.0) -> bool:
        """Whether no placed box meets the one padded by margin, and (where repeat is larger) none with the same text the one padded by repeat."""
        wide = tuple(v + d for v, d in zip(box, (-margin, -margin, margin, margin)))
        if repeat <= margin:
            return not any(self._meet(wide, o) for o in self._near(wide))
        far = tuple(v + d for v, d in zip(box, (-repeat, -repeat, repeat, repeat)))
        return not any(self._meet(wide, o) or (o[4] == text and self._meet(far, o)) for o in self._near(far))

    def place(self, box: tuple, text: str | None = None) -> None:
        if self._meet(box, self.extent):
            for c in self._span(box):
                self.cells.setdefault(c, []).append((*box, text))


def place_labels(df: DataFrame, by: str, order: list[str], extent: tuple[float, float, float, float], margin: float = 0.0, repeat: float = 0.0, text: str | None = None, allow_overlap: bool = False, ignore_placement: bool = False) -> DataFrame:
    """df with a column placed: boxes (minx .. maxy) are accepted in order unless they meet accepted ones of their group.

    by names the group, a map or a tile: labels of different groups never meet, so groups run side by
    side, and all candidates of a group are in one task; see place_labels_everywhere() for more than that. Alternatives: rows that share a column candidate_of
    are tried in order until one is placed.
    """
    has_alternatives = "candidate_of" in df.columns
    schema = T.StructType([*df.schema.fields, T.StructField("placed", T.BooleanType())])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable")
        found = Detector(extent)
        done: set = set()
        placed = []
        texts = frame[text] if text else [None] * len(frame)
        alternatives = frame["candidate_of"] if has_alternatives else [None] * len(frame)
        for x0, y0, x1, y1, t, c in zip(frame["minx"], frame["miny"], frame["maxx"], frame["maxy"], texts, alternatives):
            box = (x0, y0, x1, y1)
            ok = not (has_alternatives and c in done) and (allow_overlap or found.free(box, margin, t, repeat))
            if ok:
                done.add(c)
                if not ignore_placement:
                    found.place(box, t)
            placed.append(ok)
        return frame.assign(placed=placed)

    return df.groupBy(by).applyInPandas(run, schema)


#: What a round finds for a box: barred by a placed one, waiting for an earlier one, free in a tile, or placed at once as no other tile has it.
BARRED, WAITING, FREE, PLACED = range(4)
#: Sides of the first round's tiles in reaches, growth from round to round, and undecided boxes up to which a tile grows.
TILE, GROWTH, MOST_IN_TILE = 16, 4, 1_000_000
#: Undecided boxes from which on the firsts of cells are placed again before tiles are taken, as long as that leaves at most this share of them.
CROWDED, THINNED = 100_000, 0.7


def _tiles(boxes: DataFrame, size: float, pad: float) -> DataFrame:
    """boxes with the tiles (i, j) that they touch, and whether it is only one."""
    span = lambda low, high: F.sequence(F.floor((F.col(low) - pad) / size), F.floor((F.col(high) + pad) / size))
    both = boxes.withColumns({"i": span("minx", "maxx"), "j": span("miny", "maxy")})
    return both.withColumn("alone", (F.size("i") == 1) & (F.size("j") == 1)).withColumn("i", F.explode("i")).withColumn("j", F.explode("j"))


def _solver(reach: float, margin: float, repeat: float):
    """Boxes sorted by tile and place: each is compared with the placed and the waiting ones before it; barred ones are dropped at once."""
    pad = max(margin, repeat) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, cells = None, {}
        for batch in batches:
            keys, states = [], []
            for k, x0, y0, x1, y1, t, fixed, alone, i, j in zip(*(batch.column(c).to_pylist() for c in ("k", "minx", "miny", "maxx", "maxy", "t", "fixed", "alone", "i", "j"))):
                if (i, j) != tile:
                    tile, cells = (i, j), {}
                spots = [(cx, cy) for cx in range(math.floor((x0 - pad) / reach), math.floor((x1 + pad) / reach) + 1) for cy in range(math.floor((y0 - pad) / reach), math.floor((y1 + pad) / reach) + 1)]
                state = PLACED if alone else FREE
                for spot in spots if not fixed else ():
                    for u0, v0, u1, v1, other, sure in cells.get(spot, ()):
                        d = repeat if repeat > margin and t is not None and t == other else margin
                        if x0 <= u1 + d and x1 >= u0 - d and y0 <= v1 + d and y1 >= v0 - d:
                            state = BARRED if sure else min(state, WAITING)
                            if sure:
                                break
                    if state == BARRED:
                        break
                if not fixed:
                    keys.append(k)
                    states.append(state)
                if state != BARRED:
                    for spot in spots:
                        cells.setdefault(spot, []).append((x0, y0, x1, y1, t, fixed or state == PLACED))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(states, pa.int32())], ["k", "state"])

    return run


def _first_of_cells(boxes: DataFrame, reach: float, margin: float, repeat: float) -> tuple[DataFrame, DataFrame]:
    """Boxes that are the first of every cell they touch, and those left when what these bar is gone. Sums over cells only, so crowded places thin out without a task seeing them whole."""
    pad = max(margin, repeat) / 2
    cells = _tiles(boxes, reach, pad)
    first = cells.groupBy("i", "j").agg(F.min("k").alias("first"))
    won = cells.join(first, ["i", "j"]).groupBy("k").agg(F.min((F.col("first") == F.col("k")).cast("int")).alias("won")).where("won = 1").select("k")
    new = scratch.written(boxes.join(won, "k"))
    meets = lambda d: (F.col("minx") <= F.col("n_maxx") + d) & (F.col("maxx") >= F.col("n_minx") - d) & (F.col("miny") <= F.col("n_maxy") + d) & (F.col("maxy") >= F.col("n_miny") - d)
    near = _tiles(new, reach, pad).select("i", "j", *(F.col(c).alias(f"n_{c}") for c in ("k", "minx", "miny", "maxx", "maxy", "t")))
    bars = meets(margin) if repeat <= margin else meets(margin) | (F.col("t") == F.col("n_t")) & meets(repeat)
    barred = cells.join(near, ["i", "j"]).where(bars).select("k").distinct()
    return new.select("k"), scratch.written(boxes.join(barred, "k", "left_anti").join(won, "k", "left_anti"))


def _firsts_of_copies(boxes: DataFrame, margin: float) -> DataFrame:
    """The first of each set of equal boxes with equal texts. If it is placed it bars the others; if an earlier box bars it, that one bars them too."""
    box = ["minx", "miny", "maxx", "maxy", "t"]
    # a box that is turned over by more than the margin doesn't meet its copies
    apart = F.when((F.col("minx") <= F.col("maxx") + margin) & (F.col("miny") <= F.col("maxy") + margin), F.lit(-1)).otherwise(F.col("k"))
    return boxes.groupBy(*box, apart.alias("apart")).agg(F.min("k").alias("k")).select("k", *box, F.lit(False).alias("fixed"))


def place_labels_everywhere(df: DataFrame, order: list[tuple[str, bool]], reach: float, margin: float = 0.0, repeat: float = 0.0, text: str | None = None) -> DataFrame:
    """df with a column placed, as place_labels() over one group of all rows gives it, without any task seeing all of them.

    order is a total one (columns, ascending or not); reach is about the size of a box. Of equal boxes with equal texts only
    the first can be placed, so the others take no further part. Then boxes that come first in all their cells are placed and
    what they bar goes, again and again while many are left. Then, in rounds, each tile takes its undecided
    boxes in order: one that meets a placed box is barred, one that meets an earlier undecided one waits, one
    that lies in this tile alone is placed, and one that all its tiles find free is placed after the round. Only chains
    of boxes over borders of tiles are left for the next round, whose tiles are GROWTH times as wide, up to MOST_IN_TILE
    undecided boxes: a chain of n boxes is settled in about log(n) rounds, beyond that limit in n / MOST_IN_TILE more.
    A tile's task holds the placed and the waiting boxes of the tile.
    """
    (key,) = free_names("_place", df, "placed")
    ranked = scratch.written(numbered(df, order, key))
    boxes = ranked.select(F.col(key).alias("k"), *(F.col(c).cast("double").alias(c) for c in ("minx", "miny", "maxx", "maxy")), (F.col(text).cast("string") if text else F.lit(None).cast("string")).alias("t"), F.lit(False).alias("fixed"))
    won, open_boxes = _first_of_cells(_firsts_of_copies(boxes, margin), reach, margin, repeat)
    placed, size, pad = [won], TILE * reach, max(margin, repeat) / 2
    left = open_boxes.count()
    while left > CROWDED:
        won, open_boxes = _first_of_cells(open_boxes, reach, margin, repeat)
        placed.append(won)
        before, left = left, open_boxes.count()
        if left > THINNED * before:
            break
    fixed = None
    while open_boxes.limit(1).count():
        if fixed is not None:
            most = _tiles(open_boxes, size * GROWTH, pad).groupBy("i", "j").count().agg(F.max("count")).first()[0]
            size = size * GROWTH if most <= MOST_IN_TILE else size
        dealt = _tiles(open_boxes if fixed is None else open_boxes.unionByName(fixed), size, pad)
        told = dealt.repartition("i", "j").sortWithinPartitions("i", "j", "k").mapInArrow(_solver(reach, margin, repeat), "k long, state int")
        states = scratch.written(told.groupBy("k").agg(F.min("state").alias("state")))
        new = states.where(F.col("state") >= FREE).select("k")
        placed.append(new)
        # boxes of one tile alone have barred what they meet already
        fixed = scratch.written(open_boxes.join(states.where(F.col("state") == FREE).select("k"), "k").withColumn("fixed", F.lit(True)))
        open_boxes = scratch.written(open_boxes.join(states.where(F.col("state") == WAITING).select("k"), "k"))
    every = reduce(DataFrame.unionByName, placed)
    return ranked.join(every.select(F.col("k").alias(key), F.lit(True).alias("placed")), key, "left").drop(key).withColumn("placed", F.coalesce("placed", F.lit(False)))


def markers(df: DataFrame, placement: str, spacing: float = 100.0) -> DataFrame:
    """A row for each marker position on geom: x, y, angle."""
    at = F.explode(G.marker_positions("geom", F.lit(placement), F.lit(float(spacing))))
    return df.withColumn("_m", at).select(*df.columns, F.col("_m.x").alias("x"), F.col("_m.y").alias("y"), F.col("_m.angle").alias("angle"))


def line_labels(df: DataFrame, width: float, height: float, spacing: float = 0.0, least_length: float = 0.0, shifts: tuple[float, ...] = (0.0,), most_turn: float = math.pi, geom: str = "geom") -> DataFrame:
    """Candidates for labels along lines: a row for each place and shift, with path, place, shift, x, y, angle and the box of the turned text.

    A path that is shorter than the text or least_length has none. Its length is parted evenly by as many
    labels as spacing and text leave room for (at least one), each in the middle of its part; shifts move it along
    in their order. The text lies on the way between its two ends, read from left to right; a way that turns by more
    than most_turn at a point is left out. candidate_of numbers the places, so that place_labels() takes the first free shift.
    """
    paths, path = free_names("_paths _path", df, "path", "place", "shift", "x", "y", "angle", "minx", "miny", "maxx", "maxy", "candidate_of")
    own = df.withColumn(paths, P.measured(geom))
    own = own.select(*df.columns, F.posexplode(paths).alias("path", path))
    p = F.col(path)
    total = P.length(p)
    own = own.where((total > 0.001) & (total >= width) & (total >= least_length))
    n = F.greatest(F.floor(total / (spacing + width)) if spacing > 0 else F.lit(1), F.lit(1)).cast("int")
    own = own.withColumn("place", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("shift", F.explode(F.array(*(F.lit(float(s)) for s in shifts))))
    start = (F.col("place") + 0.5) * total / n + F.col("shift") - width / 2
    (begin,) = free_names("_start", own)
    own = own.withColumn(begin, start)
    at = F.col(begin)
    # the very end belongs to the path here
    end = F.least(at + width, total * (1 - 1e-12))
    own = own.where((at >= 0) & (at + width <= total * (1 + 1e-12)) & (P.sharpest_turn(p, at, end) <= most_turn))
    a, b = free_names("_from _to", own)
    own = own.withColumns({a: P.position(p, at), b: P.position(p, end)})
    way = F.atan2(F.col(f"{b}.y") - F.col(f"{a}.y"), F.col(f"{b}.x") - F.col(f"{a}.x"))
    upright = F.when(way > math.pi / 2, way - math.pi).when(way <= -math.pi / 2, way + math.pi).otherwise(way)
    own = own.withColumns({"x": (F.col(f"{a}.x") + F.col(f"{b}.x")) / 2, "y": (F.col(f"{a}.y") + F.col(f"{b}.y")) / 2, "angle": upright})
    half_x = F.abs(F.cos("angle")) * (width / 2) + F.abs(F.sin("angle")) * (height / 2)
    half_y = F.abs(F.sin("angle")) * (width / 2) + F.abs(F.cos("angle")) * (height / 2)
    box = {"minx": F.col("x") - half_x, "miny": F.col("y") - half_y, "maxx": F.col("x") + half_x, "maxy": F.col("y") + half_y, "candidate_of": F.concat_ws("/", "path", "place")}
    made = ["path", "place", "shift", "x", "y", "angle", *box]
    return own.withColumns(box).select(*(c for c in df.columns if c not in made), *made)


def multi_policy(parts: DataFrame, policy: str, by: str = "id", area: str = "area") -> DataFrame:
    """Rows of parts: each keeps all, whole keeps one row per feature (the first), largest the one with the largest area."""
    if policy == "each":
        return parts
    if policy not in ("whole", "largest"):
        raise ValueError(f"no policy {policy}")
    others = [c for c in parts.columns if c != by]
    pick = F.max_by(F.struct(*others), F.struct(F.col(area), -F.col("part_no"))) if policy == "largest" else F.min_by(F.struct(*others), "part_no")
    return parts.groupBy(by).agg(pick.alias("_p")).select(by, "_p.*")


def text_alternatives(df: DataFrame, sizes: list[int], directions: list[str]) -> DataFrame:
    """The simple alternatives of a label: each size (the given one first) with each direction, numbered."""
    options = [(i * len(directions) + j, s, d) for i, s in enumerate(sizes) for j, d in enumerate(directions)]
    col = F.array(*[F.struct(F.lit(n).alias("option"), F.lit(s).alias("size"), F.lit(d).alias("direction")) for n, s, d in options])
    return df.withColumn("_o", F.explode(col)).select(*df.columns, "_o.option", "_o.size", "_o.direction")


def unpivot_group(df: DataFrame, columns: dict[str, str], start: int, num: int, rules: list[tuple[Rule, str]] | None = None, repeat_key: str | None = None) -> DataFrame:
    """Sub-features of numbered columns: for each index from start, names with % replaced by it; % alone is the index.

    columns maps new names to patterns. Each sub-feature (sub_id is its index) takes the first rule that
    holds for it (rule_name); without one it is left out. repeat_key is an expression kept as text.
    """
    from ..functions import expression as X
    from ..functions import values as V

    have = set(df.columns)

    def at(pattern: str, i: int) -> Column:
        if pattern == "%":
            return F.lit(i).cast("long")
        name = pattern.replace("%", str(i))
        return F.col(f"`{name}`") if name in have else F.lit(None)

    subs = F.array(*[F.struct(F.lit(i).cast("long").alias("sub_id"), *[at(p, i).alias(n) for n, p in columns.items()]) for i in range(start, start + num)])
    out = df.withColumn("_s", F.explode(subs)).select(*[c for c in df.columns if c not in columns and c != "sub_id"], "_s.*")
    if rules:
        cond = F.coalesce(*[F.when(X.predicate(r.filter, out), F.lit(name)) for r, name in rules])
        out = out.withColumn("rule_name", cond).where("rule_name is not null")
    if repeat_key:
        out = out.withColumn("repeat_key", V.text(X.value(X.parse(repeat_key), out.schema)))
    return out
