"""Feature grids: which feature shows at each pixel, and the dictionary of those that do."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codecs as C
from ..functions.projection import View


def point_grid(df: DataFrame, view: View, order: str = "id", key: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    """px, py, feature: the last point drawn at each pixel."""
    fx, fy = view.forward(F.col(x), F.col(y))
    at = df.withColumns({"px": F.floor(fx).cast("int"), "py": F.floor(fy).cast("int")}).where(f"px >= 0 and py >= 0 and px < {view.width} and py < {view.height}")
    return at.groupBy("px", "py").agg(F.max_by(key, order).alias("feature"))


def shape_grid(df: DataFrame, view: View, order: str = "id") -> DataFrame:
    """The same for polygons (even-odd, a pixel counts by its centre), lines and points in geom."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for fid, o, raw in zip(frame["id"], frame["_order"], frame["geom"]):
                cells = pixels(C.from_wkb(bytes(raw)), view)
                if len(cells):
                    yield pd.DataFrame({"px": cells[:, 0], "py": cells[:, 1], "id": fid, "_order": o})

    burnt = df.where("geom is not null").select(F.col("id").cast("long").alias("id"), F.col(order).cast("long").alias("_order"), "geom").mapInPandas(run, "px int, py int, id long, _order long")
    return burnt.groupBy("px", "py").agg(F.max_by("id", "_order").alias("feature"))


def pixels(g: C.Geometry, view: View) -> np.ndarray:
    """Pixels of a geometry as rows (px, py)."""
    found: list[np.ndarray] = []
    for s in g.singles():
        if s.kind == "Polygon":
            rings = [np.stack(view.forward(r[:, 0], r[:, 1]), 1) for r in s.parts if len(r)]
            if not rings:
                continue
            low, high = np.min([r[:, 1].min() for r in rings]), np.max([r[:, 1].max() for r in rings])
            for py in range(max(0, int(np.floor(low))), min(view.height - 1, int(np.floor(high))) + 1):
                yc, xs = py + 0.5, []
                for r in rings:
                    a, b = r, np.roll(r, -1, axis=0)
                    cross = (a[:, 1] <= yc) != (b[:, 1] <= yc)
                    xs += (a[cross, 0] + (yc - a[cross, 1]) * (b[cross, 0] - a[cross, 0]) / (b[cross, 1] - a[cross, 1])).tolist()
                xs.sort()
                for u, v in zip(xs[::2], xs[1::2]):
                    px = np.arange(max(0, int(np.ceil(u - 0.5))), min(view.width - 1, int(np.ceil(v - 0.5)) - 1) + 1)
                    found.append(np.stack([px, np.full(len(px), py)], 1))
        else:
            for a in s.arrays:
                p = np.stack(view.forward(a[:, 0], a[:, 1]), 1)
                if len(p) > 1:
                    steps = [np.linspace(u, v, int(np.ceil(np.abs(v - u).max())) + 1) for u, v in zip(p[:-1], p[1:])]
                    p = np.concatenate(steps)
                q = np.floor(p).astype(int)
                found.append(q[(q[:, 0] >= 0) & (q[:, 1] >= 0) & (q[:, 0] < view.width) & (q[:, 1] < view.height)])
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), int)


def key_dictionary(grid: DataFrame, features: DataFrame, key: str = "id", fields: tuple[str, ...] = ()) -> DataFrame:
    """Features that show, once each, with their key (blank ones left out) and fields."""
    shown = grid.select(F.col("feature").alias("id")).distinct()
    found = features.select("id", F.col(key).cast("string").alias("key"), *[F.col(f) for f in fields if f not in ("id", "key")]).where("key is not null and key <> ''")
    return found.join(shown, "id", "left_semi").dropDuplicates(["id"])


def view_part(grid: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    return grid.where(F.col("px").between(x, x + width - 1) & F.col("py").between(y, y + height - 1))
