"""Files read by byte ranges: Python data sources whose partitions are ranges and that take boxes and tile addresses as filters.

A scan plans its partitions from file sizes, indexes and directories, and tasks read their own ranges only.
Paths are local ones (a folder that driver and executors share) or URIs that pyarrow's file systems open.
"""

from __future__ import annotations

import gzip
import json
import struct
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..functions import codecs as C
from ..functions import geometry as G
from ..functions import shapes as S
from ..functions.boxes import Extent
from ..functions.projection import tile_range
from ..plans.processor import SpatialTable
from .binary_tables import mvt_features, tile_of_id
from .shape_records import cells, dbf_layout, shape_at

#: Bytes of records that a partition reads at most, gap between records that is read over, and files up to which the driver looks into indexes.
SPLIT_BYTES, GAP, LOOKED_INTO = 32 << 20, 1024, 64
#: Bytes fetched at a time while an index or a directory is walked.
BLOCK = 8192
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return pafs.LocalFileSystem(), path


def listed(path: str, ending: str) -> list[str]:
    """The files of an ending below a folder, or those that a comma-separated list names, with or without the ending; in name order."""
    out: list[str] = []
    for one in path.split(","):
        fs, at = _place(one.strip())
        info = fs.get_file_info(at)
        if info.type == pafs.FileType.Directory:
            head = one.strip().rstrip("/")
            out += [f"{head}/{f.path[len(at.rstrip('/')) + 1:]}" for f in fs.get_file_info(pafs.FileSelector(at, recursive=True)) if f.path.endswith(ending)]
        else:
            out.append(one.strip() if one.strip().endswith(ending) else one.strip() + ending)
    return sorted(out)


class Ranged:
    """A file whose byte ranges are read one by one and counted."""

    def __init__(self, path: str) -> None:
        self.fs, self.at = _place(path)
        self.read_bytes = 0
        self._file = None
        self._blocks: dict[int, bytes] = {}

    def exists(self) -> bool:
        return self.fs.get_file_info(self.at).type == pafs.FileType.File

    @property
    def size(self) -> int:
        return self.fs.get_file_info(self.at).size

    def read(self, at: int, n: int) -> bytes:
        if self._file is None:
            self._file = self.fs.open_input_file(self.at)
        self._file.seek(at)
        out = self._file.read(n)
        self.read_bytes += len(out)
        return out

    def walk(self, at: int, n: int) -> bytes:
        """A small range, fetched by whole blocks."""
        out = b""
        for k in range(at // BLOCK, (at + n - 1) // BLOCK + 1):
            if k not in self._blocks:
                self._blocks[k] = self.read(k * BLOCK, BLOCK)
            out += self._blocks[k]
        return out[at % BLOCK : at % BLOCK + n]

    def write(self, data: bytes) -> None:
        self.fs.create_dir(self.at.rsplit("/", 1)[0], recursive=True)
        with self.fs.open_output_stream(self.at) as out:
            out.write(data)


# --- indexes of shapefiles --------------------------------------------------------

#: Fixed values of the index format: bytes of its head, which holds a name that ends in -index, of a node's box and of an entry.
HEAD, NODE_BOX, ENTRY = 16, 16, 32
_ENTRIES = np.dtype([("offset", "<u8"), ("start", "<i4"), ("end", "<i4"), ("box", "<f4", 4)])
#: Levels of an index tree, and how far a quarter reaches over its parent's width and height.
DEPTH, RATIO = 8, 0.55


def index_bytes(offsets: np.ndarray, boxes: np.ndarray) -> bytes:
    """An index over records: a tree of quarters that overlap; a record lies in the deepest node that holds its box. Boxes are rounded outwards to single precision."""
    own = np.zeros(len(offsets), _ENTRIES)
    own["offset"], own["start"], own["end"] = offsets, -1, -1
    single = boxes.astype(np.float32)
    low, high = single[:, :2], single[:, 2:]
    own["box"] = np.concatenate([np.where(low > boxes[:, :2], np.nextafter(low, np.float32(-np.inf)), low), np.where(high < boxes[:, 2:], np.nextafter(high, np.float32(np.inf)), high)], axis=1)

    def node(extent: np.ndarray, rows: np.ndarray, depth: int) -> bytes:
        x0, y0, x1, y1 = extent.astype(float)
        w, h = (x1 - x0) * RATIO, (y1 - y0) * RATIO
        below = []
        if depth < DEPTH:
            for cx, cy in ((x0, y0), (x1 - w, y0), (x0, y1 - h), (x1 - w, y1 - h)):
                quarter = np.array([cx, cy, cx + w, cy + h], np.float32)
                b = own["box"][rows]
                inside = (b[:, 0] >= quarter[0]) & (b[:, 1] >= quarter[1]) & (b[:, 2] <= quarter[2]) & (b[:, 3] <= quarter[3])
                if inside.any():
                    below.append(node(quarter, rows[inside], depth + 1))
                    rows = rows[~inside]
        rest = b"".join(below)
        return struct.pack("<i", len(rest)) + extent.astype("<f4").tobytes() + struct.pack("<i", len(rows)) + own[rows].tobytes() + struct.pack("<i", len(below)) + rest

    extent = np.concatenate([own["box"][:, :2].min(0), own["box"][:, 2:].max(0)]) if len(own) else np.zeros(4, np.float32)
    return b"atlasq-index".ljust(HEAD, b"\0") + node(extent, np.arange(len(own)), 1)


def index_hits(file: Ranged, box: tuple[float, float, float, float]) -> np.ndarray:
    """Offsets of the records whose boxes meet a box, in file order. Nodes away from it are leapt over."""
    if file.walk(6, 6) != b"-index":
        raise ValueError(f"not an index: {file.at}")
    meets = lambda b: b[0] <= box[2] and b[2] >= box[0] and b[1] <= box[3] and b[3] >= box[1]
    out: list[np.ndarray] = []

    def node(at: int) -> int:
        below, count = struct.unpack("<i", file.walk(at, 4))[0], struct.unpack("<i", file.walk(at + 4 + NODE_BOX, 4))[0]
        entries = at + 8 + NODE_BOX
        end = entries + count * ENTRY + 4 + below
        if meets(struct.unpack("<4f", file.walk(at + 4, NODE_BOX))):
            if count:
                own = np.frombuffer(file.walk(entries, count * ENTRY), _ENTRIES)
                b = own["box"]
                out.append(own["offset"][(b[:, 0] <= box[2]) & (b[:, 2] >= box[0]) & (b[:, 1] <= box[3]) & (b[:, 3] >= box[1])])
            children = struct.unpack("<i", file.walk(entries + count * ENTRY, 4))[0]
            child = entries + count * ENTRY + 4
            for _ in range(children):
                child = node(child)
        return end

    node(HEAD)
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def write_indexes(spark: SparkSession, path: str) -> DataFrame:
    """Write an index beside each shapefile of a folder or list, one task a file (the format holds 4 GB at most); returns path and records."""
    stems = [p[: -len(".shp")] for p in listed(path, ".shp")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, counts = [], []
            for stem in batch.column("stem").to_pylist():
                shp, places = Ranged(f"{stem}.shp"), _record_places(Ranged(f"{stem}.shx"), 0, None)
                kept, boxes = [], []
                for at, n in places.tolist():
                    g = shape_at(shp.read(at, n), 8)
                    e = S.envelope(g) if g is not None else None
                    if e:
                        kept.append(at)
                        boxes.append(e)
                Ranged(f"{stem}.index").write(index_bytes(np.array(kept, np.uint64), np.array(boxes).reshape(-1, 4)))
                names.append(stem)
                counts.append(len(kept))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["stem", "records"])

    return spark.createDataFrame([(s,) for s in stems], "stem string").repartition(max(1, len(stems)), "stem").mapInArrow(run, "stem string, records long")


def _record_places(shx: Ranged, first: int, last: int | None) -> np.ndarray:
    """Offset and whole length of records first .. last - 1."""
    n = (shx.size - 100) // 8
    last = n if last is None else min(last, n)
    raw = np.frombuffer(shx.read(100 + 8 * first, 8 * max(0, last - first)), ">u4").reshape(-1, 2).astype(np.int64) * 2
    return raw + (0, 8)


# --- shapefiles --------------------------------------------------------------------


@dataclass
class _Records(InputPartition):
    """Records of a shapefile: numbers first .. last - 1, or those at offsets; offsets is None where a task looks into the index itself."""

    stem: str
    first: int = 0
    last: int | None = None
    offsets: tuple[int, ...] | None = None
    look: bool = False


def box_of(filters: Iterable[Filter]) -> tuple[float, float, float, float] | None:
    """The box that comparisons of the flat box columns with numbers tell; none if a side is open."""
    low, high = {}, {}
    for f in filters:
        name = getattr(f, "attribute", ("",))[0]
        if isinstance(f, (LessThan, LessThanOrEqual)) and name in ("minx", "miny"):
            high[name[-1]] = min(high.get(name[-1], np.inf), float(f.value))
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and name in ("maxx", "maxy"):
            low[name[-1]] = max(low.get(name[-1], -np.inf), float(f.value))
        elif isinstance(f, EqualTo) and name in ("minx", "miny", "maxx", "maxy"):
            side = high if name.startswith("min") else low
            side[name[-1]] = float(f.value)
    return (low["x"], low["y"], high["x"], high["y"]) if len(low) == len(high) == 2 else None


class ShapeReader(DataSourceReader):
    def __init__(self, options: dict, schema) -> None:
        self.path, self.encoding, self.split = options["path"], options.get("encoding", "utf-8"), int(options.get("splitbytes", SPLIT_BYTES))
        self.names = [f.name for f in schema.fields]
        self.arrow = pa.schema([(f.name, _ARROW[f.dataType.simpleString()]) for f in schema.fields])
        self.box: tuple[float, float, float, float] | None = None
        self.looked = 0

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        self.box = box_of(filters)
        return filters  # a box is wider than what it was made from, and single precision wider still

    def partitions(self) -> list[InputPartition]:
        """Ranges of records by size; with a box and an index, runs of the records that it finds."""
        stems = [p[: -len(".shp")] for p in listed(self.path, ".shp")]
        out: list[InputPartition] = []
        for stem in stems:
            index = Ranged(f"{stem}.index")
            if self.box is not None and index.exists():
                if len(stems) > LOOKED_INTO:
                    out.append(_Records(stem, look=True))
                    continue
                hits = index_hits(index, self.box).tolist()
                self.looked += index.read_bytes
                size, total = Ranged(f"{stem}.shp").size, (Ranged(f"{stem}.shx").size - 100) // 8
                each = max(1, int(self.split * total / max(1, size)))
                out += [_Records(stem, offsets=tuple(hits[i : i + each])) for i in range(0, len(hits), each)]
                continue
            total, size = (Ranged(f"{stem}.shx").size - 100) // 8, Ranged(f"{stem}.shp").size
            parts = max(1, -(-size // self.split))
            out += [_Records(stem, total * k // parts, total * (k + 1) // parts) for k in range(parts)]
        return out

    def read(self, part: _Records | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # a scan without partitions is asked once
            return
        yield from self.read_from(part, Ranged(f"{part.stem}.shp"), Ranged(f"{part.stem}.dbf"))

    def read_from(self, part: _Records, shp: Ranged, dbf: Ranged) -> Iterator[pa.RecordBatch]:
        offsets = part.offsets
        if part.look:
            offsets = tuple(index_hits(Ranged(f"{part.stem}.index"), self.box).tolist())
        if offsets is None:
            places = _record_places(Ranged(f"{part.stem}.shx"), part.first, part.last)
            runs = _runs([(int(a), int(n)) for a, n in places])
        else:
            # an entry has no length: a record's head tells it, and near records are read in one go
            runs = _runs([(o, None) for o in offsets], lambda at: 8 + 2 * struct.unpack(">i", shp.read(at + 4, 4))[0])
        for at, size, own in runs:
            raw = shp.read(at, size)
            found = [(struct.unpack_from(">i", raw, o - at)[0], shape_at(raw, o - at + 8)) for o in own]
            yield from self._rows([(k, g) for k, g in found if g is not None], dbf)

    def _rows(self, found: list[tuple[int, C.Geometry]], dbf: Ranged) -> Iterator[pa.RecordBatch]:
        rows = []
        for k, g in found:
            e = S.envelope(g)
            if e is not None and (self.box is None or (e[0] <= self.box[2] and e[2] >= self.box[0] and e[1] <= self.box[3] and e[3] >= self.box[1])):
                rows.append((k, g, e))
        if not rows:
            return
        layout = dbf_layout(dbf.walk(0, dbf_head(dbf)), self.encoding)
        first, last = min(k for k, _, _ in rows) - 1, max(k for k, _, _ in rows) - 1
        raw = dbf.read(layout.head + first * layout.size, (last - first + 1) * layout.size)
        columns: dict[str, list] = {n: [] for n in self.names}
        for k, g, e in rows:
            own = cells(raw, (k - 1 - first) * layout.size, layout, self.encoding)
            core = {"id": k, "geom": C.to_wkb(g), "minx": e[0], "miny": e[1], "maxx": e[2], "maxy": e[3], "geom_type": g.simple_kind}
            for n in self.names:
                columns[n].append(core[n] if n in core else own.get(n))
        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in self.arrow], schema=self.arrow)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
CORE = "id long, geom binary, minx double, miny double, maxx double, maxy double, geom_type int"


def dbf_head(dbf: Ranged) -> int:
    return struct.unpack("<H", dbf.walk(8, 2))[0]


def _runs(places: list[tuple[int, int | None]], length=None) -> Iterator[tuple[int, int, list[int]]]:
    """Ranges (start, bytes, offsets of their records) of near records, bounded in size."""
    start, end, own = None, 0, []
    for at, n in places:
        n = n if n is not None else length(at)
        if own and (at - end > GAP or at + n - start > SPLIT_BYTES):
            yield start, end - start, own
            own = []
        if not own:
            start = at
        own.append(at)
        end = at + n
    if own:
        yield start, end - start, own


class ShapeSource(DataSource):
    """Shapefiles with their .shx, .dbf and, if there, .index: path, encoding, splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "atlasq_shape"

    def schema(self) -> str:
        first = listed(self.options["path"], ".shp")[0]
        dbf = Ranged(first[: -len(".shp")] + ".dbf")
        layout = dbf_layout(dbf.walk(0, dbf_head(dbf)), self.options.get("encoding", "utf-8"))
        taken = {c.split()[0] for c in CORE.split(", ")}
        own = [f"`{c.name}` {c.kind}" for c in layout.columns if c.name.lower() not in taken]
        return ", ".join([CORE, *own])

    def reader(self, schema) -> ShapeReader:
        return ShapeReader({k.lower(): v for k, v in self.options.items()}, schema)


def shapefiles(spark: SparkSession, path: str, encoding: str = "utf-8", split_bytes: int = SPLIT_BYTES) -> SpatialTable:
    """A table over all shapefiles of a folder or list; ids are record numbers in their file. A box in where() or query() reaches the scan."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(ShapeSource)
    return SpatialTable(spark.read.format("atlasq_shape").options(path=path, encoding=encoding, splitBytes=str(split_bytes)).load())


# --- tile archives -------------------------------------------------------------------


def id_of_tile(z: int, x: int, y: int) -> int:
    """The number of a tile along the Hilbert curve, after all tiles of lower levels."""
    out = ((1 << 2 * z) - 1) // 3
    for k in range(z - 1, -1, -1):
        s = 1 << k
        rx, ry = x >> k & 1, y >> k & 1
        out += s * s * (3 * rx ^ ry)
        x, y = x & (s - 1), y & (s - 1)
        if not ry:
            if rx:
                x, y = s - 1 - x, s - 1 - y
            x, y = y, x
    return out


def tile_number(x: Column, y: Column, z: int) -> Column:
    """The same number as a column, bit by bit from the highest one."""
    one = F.lit(1).cast("long")

    def step(state: Column, k: Column) -> Column:
        s = F.pow(F.lit(2), k).cast("long")
        bx, by = state["x"].bitwiseAND(s), state["y"].bitwiseAND(s)
        rx, ry = F.when(bx > 0, one).otherwise(one - one), F.when(by > 0, one).otherwise(one - one)
        low_x, low_y = state["x"].bitwiseAND(s - 1), state["y"].bitwiseAND(s - 1)
        flip = (by == 0) & (bx > 0)
        fx, fy = F.when(flip, s - 1 - low_x).otherwise(low_x), F.when(flip, s - 1 - low_y).otherwise(low_y)
        turned = by == 0
        return F.struct(F.when(turned, fy).otherwise(fx).alias("x"), F.when(turned, fx).otherwise(fy).alias("y"), (state["d"] + (rx * 3).bitwiseXOR(ry) * s * s).alias("d"))

    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(((1 << 2 * z) - 1) // 3).cast("long").alias("d"))
    if not z:
        return start["d"]
    return F.aggregate(F.sequence(F.lit(z - 1), F.lit(0), F.lit(-1)), start, step, lambda state: state["d"])


#: Ranges of tile numbers that a box of tiles is cut to at most; more are joined over the smallest gaps.
MOST_RANGES = 512


def id_ranges(z: int, span: tuple[int, int, int, int]) -> list[tuple[int, int]]:
    """Ranges of tile numbers (first, end) that hold all tiles of a level within columns and rows: squares of the curve, cut finer at the border only."""
    x0, x1, y0, y1 = span
    out: list[tuple[int, int]] = []
    todo = [(0, 0, 0)]
    base = ((1 << 2 * z) - 1) // 3
    while todo:
        level, x, y = todo.pop()
        side = 1 << (z - level)
        ax, bx, ay, by = x * side, (x + 1) * side - 1, y * side, (y + 1) * side - 1
        if bx < x0 or ax > x1 or by < y0 or ay > y1:
            continue
        if x0 <= ax and bx <= x1 and y0 <= ay and by <= y1 or len(todo) + len(out) > 4 * MOST_RANGES:
            own = id_of_tile(level, x, y) - ((1 << 2 * level) - 1) // 3
            out.append((base + own * side * side, base + (own + 1) * side * side))
        else:
            todo += [(level + 1, 2 * x + i, 2 * y + j) for i in (0, 1) for j in (0, 1)]
    out.sort()
    merged: list[list[int]] = []
    for a, b in out:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    while len(merged) > MOST_RANGES:
        k = min(range(1, len(merged)), key=lambda i: merged[i][0] - merged[i - 1][1])
        merged[k - 1 : k + 1] = [[merged[k - 1][0], merged[k][1]]]
    return [(a, b) for a, b in merged]


@dataclass(frozen=True)
class Archive:
    """Places in an archive: root directory, leaf directories, tiles; how directories are packed; levels."""

    root: tuple[int, int]
    leaves: int
    data: int
    packed: int
    levels: tuple[int, int]


def archive_head(file: Ranged) -> Archive:
    raw = file.walk(0, 127)
    if raw[:7] != b"PMTiles" or raw[7] != 3:
        raise ValueError(f"not a version 3 archive: {file.at}")
    root, root_n, _, _, leaves, _, data, _ = struct.unpack_from("<8Q", raw, 8)
    return Archive((root, root_n), leaves, data, raw[97], (raw[100], raw[101]))


def entries(raw: bytes, packed: int) -> list[tuple[int, int, int, int]]:
    """Rows of a directory: first tile number, run, offset, size; a run of 0 is a leaf directory."""
    r = C._Reader(gzip.decompress(raw) if packed == 2 else raw)
    n = r.varint()
    ids = np.cumsum([r.varint() for _ in range(n)]).tolist() if n else []
    runs, sizes = [r.varint() for _ in range(n)], [r.varint() for _ in range(n)]
    offsets: list[int] = []
    for i in range(n):
        v = r.varint()
        offsets.append(offsets[-1] + sizes[i - 1] if v == 0 and i else v - 1)
    return list(zip(ids, runs, offsets, sizes))


@dataclass
class _Directories(InputPartition):
    """Rows of a root directory whose tiles a task reads, leaves included."""

    path: str
    rows: tuple[tuple[int, int, int, int], ...] = field(default_factory=tuple)


def _span(filters: Iterable[Filter]) -> dict[str, tuple[int, int]]:
    """Bounds (low, high) of z, x and y."""
    out: dict[str, list[int]] = {c: [0, 1 << 40] for c in "zxy"}
    for f in filters:
        name = getattr(f, "attribute", ("",))[0]
        if name not in out:
            continue
        if isinstance(f, EqualTo):
            out[name] = [max(out[name][0], int(f.value)), min(out[name][1], int(f.value))]
        elif isinstance(f, In):
            out[name] = [max(out[name][0], min(map(int, f.value))), min(out[name][1], max(map(int, f.value)))]
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            out[name][0] = max(out[name][0], int(f.value))
        elif isinstance(f, (LessThan, LessThanOrEqual)):
            out[name][1] = min(out[name][1], int(f.value))
    return {k: (a, b) for k, (a, b) in out.items()}


class TileReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.per_task = options["path"], int(options.get("directories", 1))
        self.span = _span(())

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        self.span = _span(filters)
        return filters

    def _wanted(self, levels: tuple[int, int]) -> list[tuple[int, int]]:
        out = []
        for z in range(max(levels[0], self.span["z"][0]), min(levels[1], self.span["z"][1]) + 1):
            last = (1 << z) - 1
            x, y = ((max(0, self.span[c][0]), min(last, self.span[c][1])) for c in "xy")
            if x[0] <= x[1] and y[0] <= y[1]:
                out += id_ranges(z, (*x, *y))
        return sorted(out)

    def partitions(self) -> list[InputPartition]:
        """Rows of the root directories whose tile numbers meet the wanted ranges, a leaf directory (or as many as asked) for each task."""
        out: list[InputPartition] = []
        for path in listed(self.path, ".pmtiles"):
            file = Ranged(path)
            head = archive_head(file)
            wanted = self._wanted(head.levels)
            rows = entries(file.walk(*head.root), head.packed)
            ends = [*(r[0] for r in rows[1:]), 1 << 62]
            kept = [r for r, end in zip(rows, ends) if _meets(wanted, r[0], end if r[1] == 0 else r[0] + r[1])]
            leaves, own = [r for r in kept if r[1] == 0], [r for r in kept if r[1]]
            out += [_Directories(path, tuple(leaves[i : i + self.per_task])) for i in range(0, len(leaves), self.per_task)]
            out += [_Directories(path, tuple(own))] if own else []
        return out

    def read(self, part: _Directories | None) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        yield from self.read_from(part, Ranged(part.path))

    def read_from(self, part: _Directories, file: Ranged) -> Iterator[pa.RecordBatch]:
        head = archive_head(file)
        wanted = self._wanted(head.levels)
        todo = list(part.rows)
        while todo:
            batch: list[tuple[int, int, int, int, int]] = []
            first, run, offset, size = todo.pop(0)
            if run == 0:
                todo = [r for r in entries(file.read(head.leaves + offset, size), head.packed) if r[1] == 0 or _meets(wanted, r[0], r[0] + r[1])] + todo
                continue
            for tile in range(first, first + run):
                if not _meets(wanted, tile, tile + 1):
                    continue
                z, x, y = tile_of_id(tile)
                if all(self.span[c][0] <= v <= self.span[c][1] for c, v in zip("zxy", (z, x, y))):
                    batch.append((z, x, y, tile, size))
            if batch:
                data = file.read(head.data + offset, size)
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(batch)), *(pa.array([b[i] for b in batch], pa.int64() if i > 2 else pa.int32()) for i in range(4)), pa.array([data] * len(batch), pa.binary())], names=[c.split()[0] for c in TILE.split(", ")])


TILE = "path string, z int, x int, y int, tile_id long, tile binary"


def _meets(ranges: list[tuple[int, int]], first: int, end: int) -> bool:
    """Whether first .. end - 1 meets one of the sorted, parted ranges."""
    k = bisect_right(ranges, (end - 1, 1 << 62)) - 1
    return k >= 0 and ranges[k][1] > first


class TileSource(DataSource):
    """Tiles of version 3 archives: path, directories (leaf directories for each task)."""

    @classmethod
    def name(cls) -> str:
        return "atlasq_pmtiles"

    def schema(self) -> str:
        return TILE

    def reader(self, schema) -> TileReader:
        return TileReader({k.lower(): v for k, v in self.options.items()})


def archive_tiles(spark: SparkSession, path: str, directories: int = 1) -> DataFrame:
    """A row for each tile of all archives of a folder or list: path, z, x, y, tile_id, tile. Conditions on z, x and y reach the directories, so only their ranges are read."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(TileSource)
    return spark.read.format("atlasq_pmtiles").options(path=path, directories=str(directories)).load()


def tile_features(tiles: DataFrame, layer: str | None = None) -> DataFrame:
    """layer, id, geom, props and the tile of the features of vector tiles (rows with z, x, y, tile)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(x, y, name, fid, C.to_wkb(g), {k: json.dumps(v) for k, v in p.items()}) for z, x, y, b in zip(frame["z"], frame["x"], frame["y"], frame["tile"]) for name, fid, g, p in mvt_features(bytes(b), int(z), int(x), int(y), layer)]
            if rows:
                yield pd.DataFrame(rows, columns=["tx", "ty", "layer", "id", "geom", "props"])

    return tiles.select("z", "x", "y", "tile").mapInPandas(run, "tx int, ty int, layer string, id long, geom binary, props map<string,string>")


def archive_table(spark: SparkSession, path: str, zoom: int, layer: str | None = None, within: Extent | None = None) -> DataFrame:
    """Features of the tiles of a level, those that a mercator box meets if one is given, with flat boxes; ids are those in their tiles."""
    tiles = archive_tiles(spark, path).where(F.col("z") == zoom)
    if within is not None:
        x0, x1, y0, y1 = tile_range(within, zoom)
        tiles = tiles.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
    found = tile_features(tiles, layer)
    out = found.withColumn("_e", G.envelope("geom"))
    return out.select("id", "geom", *(F.col(f"_e.{c}").alias(c) for c in ("minx", "miny", "maxx", "maxy")), G.simple_kind(G.wkb_kind(F.col("geom"))).alias("geom_type"), "layer", "tx", "ty", "props")


def archive_directory(spark: SparkSession, path: str) -> DataFrame:
    """The directories of archives as rows (path, tile_id, run, offset, size), without any tile: leaf directories are read by tasks."""
    rows = []
    for one in listed(path, ".pmtiles"):
        file = Ranged(one)
        head = archive_head(file)
        rows += [(one, *r) for r in entries(file.walk(*head.root), head.packed)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                todo = [(r["tile_id"], r["run"], r["offset"], r["size"])]
                file = Ranged(r["path"])
                head = archive_head(file)
                found = []
                while todo:
                    row = todo.pop(0)
                    if row[1]:
                        found.append(row)
                    else:
                        todo = entries(file.read(head.leaves + row[2], row[3]), head.packed) + todo
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * len(found)), *(pa.array([f[i] for f in found], pa.int64()) for i in range(4))], names=["path", "tile_id", "run", "offset", "size"])

    schema = "path string, tile_id long, run long, offset long, size long"
    dealt = spark.createDataFrame(rows, schema).repartition(max(1, min(len(rows), 200)), F.col("tile_id"))
    return dealt.mapInArrow(run, schema)
