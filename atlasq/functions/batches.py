"""Geometry functions over whole batches of WKB: decoded once into ragged arrays, then worked out for all rows at a time.

Points, lines, polygons and multipolygons in little-endian two-dimensional WKB (what this package writes) are decoded
together; everything else goes through the row functions of shapes.py, which give the same results.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import codecs as C
from . import shapes as S

#: Rings with at most so many points are tested for crossings together with all rings of as many points.
TOGETHER = 64
#: Pairs of segments tested at once, and segments up to which an area's rings are tested against each other together with other areas'.
PAIRS, SEGMENTS = 1 << 20, 128


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of the ranges start .. start + length - 1."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


class Batch:
    """kind of each row (1 to 3 or 6; 0 for null and for what isn't decoded together), all points, and where paths and rows begin in them.

    A path that is a ring has the number of its polygon in the row, and shell tells whether it is that one's first ring.
    """

    def __init__(self, column: pa.Array) -> None:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        n = len(column)
        self.column, self.n = column, n
        large = pa.types.is_large_binary(column.type)
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        self.raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        valid = ~np.asarray(column.is_null())
        start, size = at[:-1], np.diff(at)
        kind = np.zeros(n, np.int64)
        big = np.flatnonzero(valid & (size >= 9))
        head = self.raw[start[big]] == 1
        code = self._number(start[big] + 1)
        good = head & ((code >= 1) & (code <= 3) | (code == 6))
        kind[big[good]] = code[good]
        # paths: row, place of the first point, number of points
        rows, places, counts = [], [], []
        one = np.flatnonzero(kind == 1)
        kind[one[size[one] != 21]] = 0
        one = np.flatnonzero(kind == 1)
        rows.append(one), places.append(start[one] + 5), counts.append(np.ones(len(one), np.int64))
        two = np.flatnonzero(kind == 2)
        m = self._number(start[two] + 5)
        kind[two[size[two] != 9 + 16 * m]] = 0
        keep = kind[two] == 2
        rows.append(two[keep]), places.append(start[two[keep]] + 9), counts.append(m[keep])
        polygon, shell = [np.zeros(len(r), np.int64) for r in rows], [np.zeros(len(r), bool) for r in rows]
        for r, p, c, g, first in self._rings(kind, start, size):
            keep = kind[r] > 0
            rows.append(r[keep]), places.append(p[keep]), counts.append(c[keep])
            polygon.append(g[keep]), shell.append(first[keep])
        row, place, count = (np.concatenate(x) for x in (rows, places, counts))
        order = np.lexsort((place, row))
        self.kind, self.path_row, place, self.count = kind, row[order], place[order], count[order]
        self.polygon, self.shell = (np.concatenate(x)[order] for x in (polygon, shell))
        self.path_at = np.cumsum(np.append(0, self.count))
        take = ragged(place, self.count * 16)
        self.take = take
        self.xy = self.raw[take].view("<f8").reshape(-1, 2) if len(take) else np.zeros((0, 2))
        # an empty point is written as not-a-number
        self.none = np.zeros(n, bool)
        if len(one):
            paths = np.searchsorted(self.path_row, np.flatnonzero(kind == 1))
            at_point = self.path_at[paths]
            self.none[self.path_row[paths]] = np.isnan(self.xy[at_point]).any(1)
        self.point_row = np.repeat(self.path_row, self.count)
        self.points = np.bincount(self.point_row, minlength=n)
        self.empty = (self.points == 0) | self.none
        self.rest = np.flatnonzero(valid & (kind == 0))

    def _rings(self, kind: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """The rings of polygons and multipolygons, one of each row at a time: row, place, points, polygon and whether it is the first ring. Rows cut off get kind 0."""
        own = np.flatnonzero((kind == 3) | (kind == 6))
        many = kind[own] == 6
        place, end = start[own] + 9, start[own] + size[own]
        told = self._number(start[own] + 5)
        polygons, rings = np.where(many, told, 0), np.where(many, 0, told)
        polygon, fresh = np.where(many, -1, 0), np.ones(len(own), bool)
        on = np.arange(len(own))
        out = []
        while True:
            on = on[(kind[own[on]] > 0) & ((rings[on] > 0) | (polygons[on] > 0))]
            if not len(on):
                return out
            head = on[rings[on] == 0]
            short = place[head] + 9 > end[head]
            kind[own[head[short]]] = 0
            head = head[~short]
            wrong = (self.raw[place[head]] != 1) | (self._number(place[head] + 1) != 3)
            kind[own[head[wrong]]] = 0
            head = head[~wrong]
            rings[head] = self._number(place[head] + 5)
            polygons[head] -= 1
            polygon[head] += 1
            fresh[head] = True
            place[head] += 9
            now = on[(kind[own[on]] > 0) & (rings[on] > 0)]
            short = place[now] + 4 > end[now]
            kind[own[now[short]]] = 0
            now = now[~short]
            m = self._number(place[now])
            over = place[now] + 4 + 16 * m > end[now]
            kind[own[now[over]]] = 0
            now, m = now[~over], m[~over]
            out.append((own[now], place[now] + 4, m, polygon[now], fresh[now]))
            place[now] += 4 + 16 * m
            rings[now] -= 1
            fresh[now] = False

    def _number(self, at: np.ndarray) -> np.ndarray:
        return self.raw[at[:, None] + np.arange(4)].copy().view("<u4").ravel().astype(np.int64) if len(at) else np.zeros(0, np.int64)

    def reduce(self, f: np.ufunc, values: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """f over the values of each row; rows tells each value's row, ascending. Rows without any are not-a-number."""
        out = np.full(self.n, np.nan)
        if len(values):
            first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
            out[rows[first]] = f.reduceat(values, first)
        return out

    def segments(self) -> np.ndarray:
        """Places of the points that start a segment of their path."""
        inside = np.ones(len(self.xy), bool)
        inside[self.path_at[1:][self.count > 0] - 1] = False
        return np.flatnonzero(inside)

    def row_function(self, f: Callable, *more: list) -> dict[int, object]:
        """f of the rows that weren't decoded together; what can't be read has none."""
        out = {}
        for i in self.rest.tolist():
            g = readable(C.from_wkb, self.column[i].as_py())
            if g is not None:
                out[i] = f(g, *(m[i] for m in more))
        return out


def moved(b: Batch, xy: np.ndarray, alone: Callable) -> pa.Array:
    """The batch's geometries with other points, written into a copy of its bytes; alone gives the bytes of those that weren't decoded together."""
    raw = b.raw.copy()
    raw[b.take] = np.ascontiguousarray(xy, "<f8").view(np.uint8).ravel()
    column = b.column
    buffers = column.buffers()
    out = pa.Array.from_buffers(column.type, len(column), [buffers[0], buffers[1], pa.py_buffer(raw)], column.null_count, column.offset)
    unread = (b.kind == 0) & np.asarray(column.is_valid())
    if not unread.any():
        return out
    more = b.row_function(alone)
    values = out.to_pylist()
    for i in np.flatnonzero(unread).tolist():
        values[i] = more.get(i)
    return pa.array(values, pa.binary())


def wkb(kind: np.ndarray, path_row: np.ndarray, fresh: np.ndarray, count: np.ndarray, xy: np.ndarray) -> pa.Array:
    """WKB of rows of kinds 1 to 3 or 6 from their paths: each one's row (ascending), number of points, and whether it begins a polygon of a multipolygon. A point has one path of one point."""
    row_kind = kind[path_row]
    many = row_kind == 6
    fresh = fresh & many
    head = np.where(kind == 1, 5, 9)
    own = 16 * count + np.where(row_kind >= 3, 4, 0) + np.where(fresh, 9, 0)
    size = head + np.bincount(path_row, weights=own, minlength=len(kind)).astype(np.int64)
    offsets = np.append(0, np.cumsum(size))
    raw = np.zeros(int(offsets[-1]), np.uint8)

    def number(at: np.ndarray, values: np.ndarray) -> None:
        raw[at[:, None] + np.arange(4)] = np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4)

    start = offsets[:-1]
    raw[start] = 1
    number(start + 1, kind)
    paths = np.bincount(path_row, minlength=len(kind))
    points = np.bincount(path_row, weights=count, minlength=len(kind)).astype(np.int64)
    polygons = np.bincount(path_row[fresh], minlength=len(kind))
    listed = np.flatnonzero(kind > 1)
    number(start[listed] + 5, np.select([kind == 2, kind == 3], [points, paths], polygons)[listed])
    place = np.cumsum(own) - own + np.cumsum(head)[path_row]
    begin = np.flatnonzero(fresh)
    raw[place[begin]] = 1
    number(place[begin] + 1, np.full(len(begin), 3))
    # a polygon's rings reach to the next path that begins a polygon or belongs to another row
    edge = np.flatnonzero(np.append(fresh[1:] | (path_row[1:] != path_row[:-1]), True)) if len(path_row) else np.zeros(0, np.int64)
    number(place[begin] + 5, edge[np.searchsorted(edge, begin)] - begin + 1)
    place = place + np.where(fresh, 9, 0)
    ring = np.flatnonzero(row_kind >= 3)
    number(place[ring], count[ring])
    raw[ragged(place + np.where(row_kind >= 3, 4, 0), 16 * count)] = np.ascontiguousarray(xy, "<f8").view(np.uint8).ravel()
    return pa.Array.from_buffers(pa.binary(), len(kind), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)])


def merged(n: int, rows: np.ndarray, told: pa.Array, more: dict[int, object]) -> pa.Array:
    """n values: told at the given rows, more's at its keys, null at all others."""
    if len(rows) == n:
        return told
    keys = [i for i, v in more.items() if v is not None]
    at = np.full(n, -1)
    at[rows] = np.arange(len(rows))
    at[keys] = len(rows) + np.arange(len(keys))
    every = pa.concat_arrays([told, pa.array([more[i] for i in keys], told.type)])
    return every.take(pa.array(at, mask=at < 0))


#: Bytes of WKT: other, of a number, blank, comma, opening and closing.
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(b"0123456789+-.eE")] = 1
_CLASS[list(b" ")], _CLASS[list(b",")], _CLASS[list(b"(")], _CLASS[list(b")")] = 2, 3, 4, 5
_DIGIT, _BLANK, _COMMA, _OPEN, _CLOSE = range(1, 6)
#: Names of the kinds read together, and how deep their positions lie in brackets.
_NAMED = ((b"POINT", 1, 1), (b"LINESTRING", 2, 1), (b"POLYGON", 3, 2), (b"MULTIPOLYGON", 6, 3))
_NUMBER = r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"


def from_wkt(column: pa.Array, alone: Callable) -> pa.Array:
    """WKB of a batch of texts: points, lines, polygons and multipolygons in their usual spelling together, all others by alone(text), which gives none for what it can't read."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    valid = np.asarray(column.is_valid())
    edges = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    start, size = edges[:-1], np.diff(edges)
    kind, depth, skip = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for name, k, d in _NAMED:
        ask = np.flatnonzero(valid & (kind == 0) & (size > len(name) + 4))
        own = ask[(raw[start[ask][:, None] + np.arange(len(name))] == np.frombuffer(name, np.uint8)).all(1)] if len(ask) else ask
        kind[own], depth[own], skip[own] = k, d, len(name)
    rows = np.flatnonzero(kind)
    while len(rows):
        told = _read_together(raw, start[rows] + skip[rows], size[rows] - skip[rows], kind[rows], depth[rows])
        if isinstance(told, pa.Array):
            break
        rows = rows[told]
    else:
        told = pa.array([], pa.binary())
    left = valid.copy()
    left[rows] = False
    return merged(n, rows, told, {i: alone(column[i].as_py()) for i in np.flatnonzero(left).tolist()})


def _read_together(raw: np.ndarray, start: np.ndarray, size: np.ndarray, kind: np.ndarray, depth: np.ndarray) -> pa.Array | np.ndarray:
    """WKB of texts without their names if all are as expected, else which ones are."""
    n = len(start)
    char = raw[ragged(start, size)]
    row = np.repeat(np.arange(n), size)
    own = _CLASS[char]
    # blanks beside brackets and commas say nothing
    blank = own == _BLANK
    if blank.any():
        near = np.append(own, _CLOSE)
        first = np.append(True, row[1:] != row[:-1])
        last = np.append(row[1:] != row[:-1], True)
        keep = ~(blank & (first | last | (near[np.arange(-1, len(own) - 1)] >= _COMMA) | (near[1:] >= _COMMA)))
        char, row, own = char[keep], row[keep], own[keep]
    first, last = np.append(True, row[1:] != row[:-1]), np.append(row[1:] != row[:-1], True)
    before, after = np.append(_CLOSE, own[:-1]), np.append(own[1:], _CLOSE)
    before[first], after[last] = 0, 0
    level = np.cumsum((own == _OPEN).astype(np.int64) - (own == _CLOSE))
    begin = np.flatnonzero(first)
    present = row[begin]
    base = np.zeros(n, np.int64)
    base[present] = level[begin] - (own[begin] == _OPEN) + (own[begin] == _CLOSE)
    level -= base[row]
    deep = level == depth[row]
    ok = np.select(
        [own == _DIGIT, own == _BLANK, own == _COMMA, own == _OPEN, own == _CLOSE],
        [
            deep & (before > 0),
            (before == _DIGIT) & (after == _DIGIT),
            (level > 0) & np.where(deep, (before == _DIGIT) & (after == _DIGIT), (before == _CLOSE) & (after == _OPEN)),
            (level <= depth[row]) & np.where(deep, after == _DIGIT, after == _OPEN) & (first | (before == _OPEN) | (before == _COMMA)),
            (level >= 0) & ((before == _DIGIT) | (before == _CLOSE)) & ((level == 0) == last),
        ],
        False,
    )
    ok &= (~first | (own == _OPEN)) & (~last | (own == _CLOSE) & (level == 0))
    good = np.zeros(n, bool)
    good[present] = True
    good[row[~ok]] = False
    # a position is a number, a blank and a number
    token = np.flatnonzero((own == _DIGIT) & (before != _DIGIT))
    ends = np.flatnonzero((own == _DIGIT) & (after != _DIGIT))
    across, up = before[token] != _BLANK, before[token] == _BLANK
    pair = np.where(across, after[ends] == _BLANK, up & (after[ends] != _BLANK))
    good[row[token[~pair]]] = False
    digits = own == _DIGIT
    text = pa.Array.from_buffers(pa.large_string(), len(token), [None, pa.py_buffer(np.append(0, np.cumsum(ends - token + 1))), pa.py_buffer(np.ascontiguousarray(char[digits]))])
    lone = good & (kind == 1)
    if lone.any():
        good[np.flatnonzero(lone)[np.bincount(row[token], minlength=n)[lone] != 2]] = False
    if not good.all():
        return good
    try:
        xy = np.asarray(text.cast(pa.float64())).reshape(-1, 2)
    except pa.ArrowInvalid:
        plain = np.asarray(pc.match_substring_regex(text, _NUMBER))
        good[row[token[~plain]]] = False
        return good if not good.all() else np.zeros(n, bool)
    path = np.flatnonzero((own == _OPEN) & deep)
    count = np.diff(np.append(np.searchsorted(token[across], path), len(xy)))
    fresh = own[path - 1] == _OPEN
    return wkb(kind, row[path], fresh & ~first[path], count, xy)


def outline(b: Batch, width: np.ndarray, join: list, cap: list, limit: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The rows whose strokes are worked out together, and these: open lines with mitred or bevelled joins and butt or square caps."""
    told = np.array([j in ("miter", "miter-revert", "bevel") and c in ("butt", "square") for j, c in zip(join, cap)], bool)
    finite = np.bincount(b.point_row, weights=~np.isfinite(b.xy).all(1), minlength=b.n) == 0
    fits = (b.kind == 2) & told & finite & (width > 0) & np.isfinite(width) & np.isfinite(limit)
    path = np.flatnonzero(fits[b.path_row] & (b.count > 0))
    count, row = b.count[path], b.path_row[path]
    xy, of = b.xy[ragged(b.path_at[path], count)], np.repeat(np.arange(len(path)), count)
    moves = np.append(True, (of[1:] != of[:-1]) | (np.diff(xy, axis=0) != 0).any(1)) if len(xy) else np.zeros(0, bool)
    xy, of = xy[moves], of[moves]
    count = np.bincount(of, minlength=len(path))
    long = count > 1
    xy, row, count = xy[long[of]], row[long], count[long]
    if not len(row):
        return row, pa.array([], pa.binary())
    # each path there and back: two sides, each at the left of its way
    at = np.cumsum(count) - count
    twice = np.repeat(count, 2)
    begin, step = np.stack([at, at + count - 1], 1).ravel(), np.tile([1, -1], len(row))
    line = np.repeat(np.arange(len(row)), 2 * count)
    side = np.cumsum(twice) - twice
    within = np.arange(int(twice.sum())) - np.repeat(side, twice)
    p = xy[np.repeat(begin, twice) + within * np.repeat(step, twice)]
    first, last = within == 0, within == np.repeat(twice, twice) - 1
    by, far_limit = (width[row] / 2)[line], limit[row][line]
    d = np.zeros_like(p)
    d[:-1] = np.diff(p, axis=0)
    d[last] = 0
    size = np.hypot(d[:, 0], d[:, 1])
    with np.errstate(divide="ignore", invalid="ignore"):
        # at a point, the segments before and after it; at the end of a side the one before counts as both
        u = d / size[:, None]
        u[last] = u[np.flatnonzero(last) - 1]
        size[last] = size[np.flatnonzero(last) - 1]
        v = np.roll(u, 1, axis=0)
        v[first] = u[first]
        size_before = np.roll(size, 1)
        normal = np.stack([-u[:, 1], u[:, 0]], 1) * by[:, None]
        normal_before = np.stack([-v[:, 1], v[:, 0]], 1) * by[:, None]
        cross, dot = v[:, 0] * u[:, 1] - v[:, 1] * u[:, 0], (v * u).sum(1)
        meet = p + (normal_before + normal) / np.maximum(1 + dot, 1e-12)[:, None]
        reach = by * cross / np.maximum(1 + dot, 1e-12)
        away = meet - p
        far = np.hypot(away[:, 0], away[:, 1])
        axis = away / far[:, None]
        edge = far_limit * by

        def toward(q: np.ndarray) -> np.ndarray:
            on = ((q - p) * axis).sum(1)
            return q + (meet - q) * np.clip((edge - on) / np.maximum(far - on, 1e-12), 0.0, 1.0)[:, None]

        bevelled = np.array([j == "bevel" for j in join], bool)[row][line]
        squared = np.array([c == "square" for c in cap], bool)[row][line]
        ahead, behind = p + normal, p + normal_before
        straight = (cross == 0) & (dot > 0)
        inner = ~straight & (cross > 0)
        close = inner & (reach <= np.minimum(size_before, size))
        bevel = ~straight & ~inner & (bevelled | (dot <= -1 + 1e-12))
        mitre = ~straight & ~inner & ~bevel & (far <= edge)
        cut = ~straight & ~inner & ~bevel & ~mitre
        cases = [last, first | straight, close | mitre, inner, bevel, cut]
        # up to three points of the outline for each point of a side
        rim = np.zeros((len(p), 3, 2))
        pick = lambda *of: np.select([c[:, None] for c in cases], of, 0.0)
        tip = p + normal + u * by[:, None]
        tail = p - normal + u * by[:, None]
        rim[:, 0] = pick(ahead, ahead, meet, behind, behind, toward(behind))
        rim[:, 1] = pick(tip, 0.0, 0.0, p, ahead, toward(ahead))
        rim[:, 2] = pick(tail, 0.0, 0.0, ahead, 0.0, 0.0)
    used = np.select(cases, [np.where(squared, 3, 1), 1, 1, 3, 2, 2])
    ring = np.bincount(line, weights=used, minlength=len(row)).astype(np.int64)
    rim = rim[np.arange(3) < used[:, None]]
    # closed, and clockwise
    begin = np.cumsum(ring) - ring
    after = np.arange(1, len(rim) + 1)
    after[begin + ring - 1] = begin
    o = rim - np.repeat(rim[begin], ring, axis=0)
    area = np.bincount(np.repeat(np.arange(len(row)), ring), weights=o[:, 0] * o[after, 1] - o[after, 0] * o[:, 1], minlength=len(row))
    place = np.arange(int(ring.sum()) + len(row)) - np.repeat(np.cumsum(ring + 1) - ring - 1, ring + 1)
    full = np.repeat(ring, ring + 1)
    place = np.where(np.repeat(area > 0, ring + 1), full - place, place) % full
    rim = rim[np.repeat(begin, ring + 1) + place]
    return row, wkb(np.full(len(row), 6), np.arange(len(row)), np.ones(len(row), bool), ring + 1, rim)


def readable(f: Callable, x: object) -> object:
    """f(x), or nothing where x can't be read."""
    try:
        return f(x)
    except C.UNREADABLE:
        return None


def envelope(b: Batch) -> dict[str, np.ndarray]:
    use = ~b.none[b.point_row]
    xy, rows = b.xy[use], b.point_row[use]
    return {n: b.reduce(f, xy[:, k], rows) for n, f, k in (("minx", np.minimum, 0), ("miny", np.minimum, 1), ("maxx", np.maximum, 0), ("maxy", np.maximum, 1))}


def path_length(b: Batch) -> np.ndarray:
    a = b.segments()
    d = np.hypot(*(b.xy[a + 1] - b.xy[a]).T)
    out = np.zeros(b.n)
    np.add.at(out, b.point_row[a], d)
    return out


def ring_sums(b: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Twice the signed area of each path's ring, and its moments about the path's first point."""
    n = len(b.count)
    twice, mx, my = np.zeros(n), np.zeros(n), np.zeros(n)
    if len(b.xy):
        of = np.repeat(np.arange(n), b.count)
        o = b.xy[np.repeat(b.path_at[:-1], b.count)]
        p = b.xy - o
        after = np.arange(1, len(p) + 1)
        after[b.path_at[1:][b.count > 0] - 1] = b.path_at[:-1][b.count > 0]
        q = p[after]
        cross = p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]
        twice = np.bincount(of, weights=cross, minlength=n)
        mx, my = (np.bincount(of, weights=(p[:, k] + q[:, k]) * cross, minlength=n) for k in (0, 1))
    return twice, mx, my


def centroid(b: Batch) -> dict[str, np.ndarray]:
    """By area, else by length, else the mean."""
    x, y = np.full(b.n, np.nan), np.full(b.n, np.nan)
    for out, k in ((x, 0), (y, 1)):
        total = np.bincount(b.point_row, weights=b.xy[:, k], minlength=b.n)
        some = ~b.empty & (b.kind > 0)
        out[some] = total[some] / b.points[some]
    a = b.segments()
    d = np.hypot(*(b.xy[a + 1] - b.xy[a]).T)
    mid = (b.xy[a + 1] + b.xy[a]) / 2
    rows = b.point_row[a]
    w = np.bincount(rows, weights=d, minlength=b.n)
    long = (w > 0) & (b.kind > 1)
    for out, k in ((x, 0), (y, 1)):
        out[long] = np.bincount(rows, weights=mid[:, k] * d, minlength=b.n)[long] / w[long]
    twice, mx, my = ring_sums(b)
    sign = np.where(b.shell, 1.0, -1.0)
    at = b.path_at[:-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        full = (twice != 0) & (b.kind[b.path_row] >= 3)
        size = np.where(full, sign * np.abs(twice) / 2, 0.0)
        centre = [np.where(full, b.xy[np.minimum(at, max(len(b.xy) - 1, 0)), k] + m / (3 * twice), 0.0) if len(b.xy) else np.zeros(0) for k, m in ((0, mx), (1, my))]
    total = np.bincount(b.path_row, weights=size, minlength=b.n)
    area = total != 0
    for out, c in ((x, centre[0]), (y, centre[1])):
        out[area] = np.bincount(b.path_row, weights=c * size, minlength=b.n)[area] / total[area]
    return {"x": x, "y": y}


def crossings(rings: np.ndarray, closed: np.ndarray) -> np.ndarray:
    """For paths of equally many points (paths, points, 2): whether two segments of one meet other than as neighbours at their shared end."""
    out = np.zeros(len(rings), bool)
    n = rings.shape[1] - 1
    if n < 2:
        return out
    i, j = np.triu_indices(n, 1)
    step = max(1, PAIRS // len(i))
    for k in range(0, len(rings), step):
        p, q = rings[k : k + step, :-1], rings[k : k + step, 1:]
        d1, d2, w = q[:, i] - p[:, i], q[:, j] - p[:, j], p[:, j] - p[:, i]
        den = d1[..., 0] * d2[..., 1] - d1[..., 1] * d2[..., 0]
        cross = w[..., 0] * d1[..., 1] - w[..., 1] * d1[..., 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = (w[..., 0] * d2[..., 1] - w[..., 1] * d2[..., 0]) / den, cross / den
        after, around = (j == i + 1)[None, :], ((i == 0) & (j == n - 1))[None, :] & closed[k : k + step, None]
        meet = (den != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        at_end = (after & (t == 1) & (u == 0)) | (around & (t == 0) & (u == 1))
        n1 = (d1**2).sum(-1)
        flat = (den == 0) & (cross == 0) & (n1 > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            a, c = (w * d1).sum(-1) / n1, ((w + d2) * d1).sum(-1) / n1
            over = np.minimum(1, np.maximum(a, c)) - np.maximum(0, np.minimum(a, c))
        shared = flat & ((over > 1e-12) | (~(after | around) & (over >= 0)))
        out[k : k + step] = ((meet & ~at_end) | shared).any(1)
    return out


def _by_size(b: Batch, paths: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The given paths by their numbers of points: paths and their points (paths, points, 2)."""
    out = []
    for m in np.unique(b.count[paths]).tolist():
        own = paths[b.count[paths] == m]
        out.append((own, b.xy[(b.path_at[own][:, None] + np.arange(m))]))
    return out


def area(b: Batch) -> np.ndarray:
    """Outer rings less holes of polygons, 0 for all else."""
    twice, _, _ = ring_sums(b)
    own = np.where(b.kind[b.path_row] >= 3, np.abs(twice) / 2, 0.0)
    return np.bincount(b.path_row, weights=np.where(b.shell, own, -own), minlength=b.n)


#: What may be wrong with a ring by itself, in the order in which it is looked for; a ring whose fault is LATER goes through the row function.
RING_FAULTS = ("a ring has fewer than four points", "a ring isn't closed", "", "a ring crosses itself", "a ring has the wrong direction")
SHORT, OPEN, LATER, CROSSED, TURNED = range(1, 6)


def invalid_reason(b: Batch) -> list[str | None]:
    """As shapes.invalid_reason() says; areas with long rings, repeated points, very many segments or rings that touch without another fault go through it."""
    out: list[str | None] = [None] * b.n
    finite = np.ones(b.n, bool)
    finite[np.unique(b.point_row[~np.isfinite(b.xy).all(1) & ~b.none[b.point_row]])] = False
    twice, _, _ = ring_sums(b)
    paths = np.arange(len(b.count))
    fault = np.zeros(len(b.count), np.int64)
    for own, pts in _by_size(b, paths[b.kind[b.path_row] > 1]):
        rows, m = b.path_row[own], pts.shape[1]
        line = b.kind[rows] == 2
        with np.errstate(invalid="ignore"):
            still = (np.diff(pts, axis=1) == 0).all(2).any(1) if m > 1 else np.zeros(len(own), bool)
            moves = (pts != pts[:, :1]).any(2).any(1) if m else np.zeros(len(own), bool)
            shut = (pts[:, 0] == pts[:, -1]).all(1) if m else np.zeros(len(own), bool)
        ask = ~line & finite[rows] & (m >= 4) & (m <= TOGETHER) & shut & ~still
        crosses = np.zeros(len(own), bool)
        crosses[ask] = crossings(pts[ask], np.ones(int(ask.sum()), bool))
        for r in rows[line & ~moves].tolist() if m else ():
            out[r] = "a line has fewer than two different points"
        turned = (twice[own] > 0) == b.shell[own]
        told = np.select([np.full(len(own), m < 4), ~shut, still | (m > TOGETHER), crosses, turned], [SHORT, OPEN, LATER, CROSSED, TURNED], 0)
        fault[own] = np.where(line, 0, told)
    wrong = np.flatnonzero((fault > 0) & finite[b.path_row])
    rows, at = np.unique(b.path_row[wrong], return_index=True)
    slow: list[int] = []
    for r, f in zip(rows.tolist(), fault[wrong[at]].tolist()):
        if f == LATER:
            slow.append(r)
        else:
            out[r] = RING_FAULTS[f - 1]
    area = finite & (b.kind >= 3) & (np.bincount(b.path_row, minlength=b.n) > 1)
    area[rows] = False
    segments = np.bincount(b.path_row, weights=b.count - 1, minlength=b.n).astype(np.int64)
    slow += np.flatnonzero(area & (segments > SEGMENTS)).tolist()
    asked = np.flatnonzero(area & (segments <= SEGMENTS))
    block = np.cumsum(segments[asked] ** 2) // PAIRS
    for own in np.split(asked, np.flatnonzero(np.diff(block)) + 1) if len(asked) else ():
        told, left = _area_faults(b, own)
        for r, f in zip(own.tolist(), told.tolist()):
            out[r] = AREA_FAULTS[f]
        slow += own[left].tolist()
    for r in np.flatnonzero(~finite).tolist():
        out[r] = "a coordinate isn't finite"
    for r in slow:
        out[r] = S.invalid_reason(C.from_wkb(b.column[r].as_py()))
    return out


#: What may be wrong between the rings of an area.
AREA_FAULTS = (None, "two rings share a piece", "a hole lies outside its ring", "a hole crosses its ring", "a hole lies inside another", "two holes cross", "two parts overlap")


def _area_faults(b: Batch, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The fault between the rings of each of the given rows (in AREA_FAULTS), and the rows whose touching rings may part their area.

    As shapes.Arrangement goes about it, for the segments of all rows at once: pairs of segments of a row's different rings are cut at each
    other, and the pieces of a ring that touches another one, or else its first point, tell on which side of that one it lies.
    """
    first = np.searchsorted(b.path_row, rows)
    of = np.searchsorted(b.path_row, rows, side="right") - first
    path = ragged(first, of)
    ring_row, count, poly, shell = np.repeat(np.arange(len(rows)), of), b.count[path], b.polygon[path], b.shell[path]
    n = len(path)
    ring_at = np.cumsum(of) - of
    xy = b.xy[ragged(b.path_at[path], count)]
    at = np.cumsum(count) - count
    row_points = np.add.reduceat(count, ring_at)
    row_at = np.cumsum(row_points) - row_points
    extent = np.maximum.reduceat(xy, row_at, axis=0) - np.minimum.reduceat(xy, row_at, axis=0)
    near = S.SAME * np.maximum(1e-300, extent.max(1))
    owner = np.repeat(np.arange(n), count - 1)
    begin = ragged(at, count - 1)
    p, q = xy[begin], xy[begin + 1]
    size = np.bincount(ring_row[owner], minlength=len(rows))
    left = np.repeat(np.cumsum(size), size) - np.arange(len(owner)) - 1
    i = np.repeat(np.arange(len(owner)), left)
    j = ragged(np.arange(len(owner)) + 1, left)
    low, high = np.minimum(p, q), np.maximum(p, q)
    keep = np.flatnonzero((owner[i] != owner[j]) & (low[i] <= high[j]).all(1) & (low[j] <= high[i]).all(1))
    i, j = i[keep], j[keep]
    turn = low[j, 0] < low[i, 0]
    i, j = np.where(turn, j, i), np.where(turn, i, j)
    d1, d2, w = q[i] - p[i], q[j] - p[j], p[j] - p[i]
    den = d1[:, 0] * d2[:, 1] - d1[:, 1] * d2[:, 0]
    along = w[:, 0] * d1[:, 1] - w[:, 1] * d1[:, 0]
    n1, n2 = (d1**2).sum(1), (d2**2).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = (w[:, 0] * d2[:, 1] - w[:, 1] * d2[:, 0]) / den, along / den
        e, f = (w * d1).sum(1) / n1, ((w + d2) * d1).sum(1) / n1
        e, f = np.maximum(np.minimum(e, f), 0.0), np.minimum(np.maximum(e, f), 1.0)
        met = (den != 0) & (t >= -S.SAME) & (t <= 1 + S.SAME) & (u >= -S.SAME) & (u <= 1 + S.SAME)
        line = (den == 0) & (along == 0) & (f >= e)
        shared = line & (f - e > S.SAME)
        line &= ~shared
        t, u = np.where(line, e, t), np.where(line, ((e[:, None] * d1 - w) * d2).sum(1) / n2, u)
    overlap = np.zeros(len(rows), bool)
    overlap[ring_row[owner[i[shared]]]] = True
    met |= line
    i, j, t, u = i[met], j[met], t[met], u[met]
    touching = np.unique(np.minimum(owner[i], owner[j]) * n + np.maximum(owner[i], owner[j]))
    # the pieces' middles, ring by ring
    every = np.arange(len(owner))
    cut_of = np.concatenate([every, every, i, j])
    cut = np.clip(np.concatenate([np.zeros(len(every)), np.ones(len(every)), t, u]), 0.0, 1.0)
    order = np.lexsort((cut, cut_of))
    cut_of, cut = cut_of[order], cut[order]
    piece = np.flatnonzero((cut_of[1:] == cut_of[:-1]) & (np.diff(cut) > 4 * S.SAME))
    k = cut_of[piece]
    middles = p[k] + ((cut[piece] + cut[piece + 1]) / 2)[:, None] * (q[k] - p[k])
    pieces = np.bincount(owner[k], minlength=n)
    piece_at = np.cumsum(pieces) - pieces
    # pairs of a row's rings, and which of them has to be on which side of the other
    rest = np.repeat(np.cumsum(of), of) - np.arange(n) - 1
    a, c = np.repeat(np.arange(n), rest), ragged(np.arange(n) + 1, rest)
    same = poly[a] == poly[c]
    touch = np.isin(a * n + c, touching)
    inner = same & shell[a]
    holes = same & ~shell[a]
    parts = ~same & shell[a] & shell[c]
    # holes that may hold another part
    outer_a, outer_c = ~same & shell[a] & ~shell[c], ~same & ~shell[a] & shell[c]
    there, back = holes | parts | outer_a, inner | holes | parts | outer_c
    one, other, mark = np.concatenate([a[there], c[back]]), np.concatenate([c[there], a[back]]), np.concatenate([touch[there], touch[back]])
    spots = np.concatenate([middles, xy])
    inside, on, outside = _sides(spots, np.where(mark, piece_at[one], len(middles) + at[one]), np.where(mark, pieces[one], 1), xy, at[other], count[other], near[ring_row[one]])
    within, without = inside & ~on & ~outside, outside & ~on & ~inside
    half = int(there.sum())
    ways = {}
    for name, flags in (("within", within), ("without", without)):
        to, fro = np.zeros(len(a), bool), np.zeros(len(a), bool)
        to[there], fro[back] = flags[:half], flags[half:]
        ways[name] = to, fro
    (to_in, fro_in), (to_out, fro_out) = ways["within"], ways["without"]
    # a part may lie inside another one's ring if it lies inside a hole of it
    polygon = np.cumsum(shell) - 1
    held = np.unique(np.concatenate([(a * n + polygon[c])[outer_a & to_in], (c * n + polygon[a])[outer_c & fro_in]]))
    apart = (to_out | to_in & np.isin(a * n + polygon[c], held)) & (fro_out | fro_in & np.isin(c * n + polygon[a], held))
    fault = np.select([inner & fro_out, inner & ~fro_in, holes & (to_in | fro_in), holes & ~(to_out & fro_out), parts & ~apart], [2, 3, 4, 5, 6], 0)
    # the first fault counts: polygon by polygon, its holes, pairs of holes and whether its inside is cut in two, then pairs of parts
    row, last = ring_row[a], 1 << 20
    local = np.arange(n) - ring_at[ring_row]
    key = np.where(same, poly[a] * 4 + holes, last * 4) << 32 | np.where(inner, local[c], local[a]) << 16 | np.where(inner, 0, local[c])
    found = np.flatnonzero(fault > 0)
    told, least = np.zeros(len(rows), np.int64), np.full(len(rows), np.iinfo(np.int64).max)
    found = found[np.lexsort((key[found], row[found]))]
    own, pick = np.unique(row[found], return_index=True)
    told[own], least[own] = fault[found[pick]], key[found[pick]]
    parted = np.full(len(rows), np.iinfo(np.int64).max)
    np.minimum.at(parted, row[same & touch], (poly[a] * 4 + 2)[same & touch] << 32)
    told[overlap] = 1
    return told, (parted < least) & ~overlap


def _sides(spots: np.ndarray, start: np.ndarray, number: np.ndarray, xy: np.ndarray, at: np.ndarray, count: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether some of the spots start .. start + number - 1 lie inside, on and outside of the ring of count points from at on, for each asked."""
    asked = np.repeat(np.arange(len(start)), number)
    point = spots[ragged(start, number)]
    out = np.zeros((3, len(start)), bool)
    block = np.cumsum(count[asked]) // PAIRS
    for own in np.split(np.arange(len(asked)), np.flatnonzero(np.diff(block)) + 1) if len(asked) else ():
        q, m = asked[own], count[asked[own]]
        ends = np.cumsum(m)
        k = ragged(at[q], m)
        after = k + 1
        after[ends - 1] = at[q]
        u, d = xy[k], xy[after] - xy[k]
        w = np.repeat(point[own], m, axis=0) - u
        size = (d**2).sum(1)
        t = np.where(size > 0, np.clip((w * d).sum(1) / np.where(size > 0, size, 1), 0, 1), 0)
        far = np.sqrt(np.minimum.reduceat(((w - t[:, None] * d) ** 2).sum(1), ends - m))
        y = np.repeat(point[own, 1], m)
        with np.errstate(divide="ignore", invalid="ignore"):
            passes = ((u[:, 1] > y) != (xy[after, 1] > y)) & (np.repeat(point[own, 0], m) < d[:, 0] * w[:, 1] / d[:, 1] + u[:, 0])
        odd = np.add.reduceat(passes.astype(np.int64), ends - m) % 2 == 1
        touch = far <= near[q]
        for side, hit in enumerate((odd & ~touch, touch, ~odd & ~touch)):
            out[side, q[hit]] = True
    return out[0], out[1], out[2]


def is_simple(b: Batch) -> np.ndarray:
    out = np.ones(b.n, bool)
    paths = np.arange(len(b.count))
    for own, pts in _by_size(b, paths[(b.kind[b.path_row] > 1) & (b.count > 1)]):
        rows = b.path_row[own]
        still = (np.diff(pts, axis=1) == 0).all(2).any(1)
        bad = still.copy()
        ask = np.flatnonzero((b.kind[rows] == 2) & ~still)
        if pts.shape[1] <= TOGETHER:
            bad[ask] = crossings(pts[ask], (pts[ask, 0] == pts[ask, -1]).all(1))
        else:
            for k in ask.tolist():
                bad[k] = not S.is_simple(C.Geometry("LineString", pts[k]))
        out[rows[bad]] = False
    return out
