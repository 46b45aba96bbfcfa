"""Algorithms on single geometries, in numpy; see geometry.py for their columns."""

from __future__ import annotations

import heapq
import math

import numpy as np

from .codecs import Geometry, points


def envelope(g: Geometry) -> tuple[float, float, float, float] | None:
    own = [a for a in g.arrays if len(a)]
    if not own:
        return None
    a = np.concatenate(own)
    return float(a[:, 0].min()), float(a[:, 1].min()), float(a[:, 0].max()), float(a[:, 1].max())


def signed_area(ring: np.ndarray) -> float:
    """Positive where the ring turns counter-clockwise."""
    if len(ring) < 3:
        return 0.0
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return float(np.sum(x * np.roll(y, -1) - np.roll(x, -1) * y) / 2)


def area(g: Geometry) -> float:
    """Of all polygons: outer rings less holes, whatever their directions."""
    total = 0.0
    for s in g.singles():
        if s.kind == "Polygon":
            total += sum(abs(signed_area(r)) * (1 if k == 0 else -1) for k, r in enumerate(s.parts))
    return total


def is_clockwise(ring: np.ndarray) -> bool:
    return signed_area(ring) < 0


def ring_centroid(ring: np.ndarray) -> tuple[float, float, float]:
    """Centre and signed area."""
    o = ring[0]
    x, y = ring[:, 0] - o[0], ring[:, 1] - o[1]
    nx, ny = np.roll(x, -1), np.roll(y, -1)
    cross = x * ny - nx * y
    a = cross.sum() / 2
    if a == 0:
        return float(ring[:, 0].mean()), float(ring[:, 1].mean()), 0.0
    return float(o[0] + ((x + nx) * cross).sum() / (6 * a)), float(o[1] + ((y + ny) * cross).sum() / (6 * a)), float(a)


def centroid(g: Geometry) -> tuple[float, float] | None:
    """By area, else by length, else the mean; none for an empty geometry or a collection."""
    if g.empty or g.kind == "GeometryCollection":
        return None
    if g.kind in ("Point", "MultiPoint"):
        return tuple(g.parts.mean(0).tolist())
    if g.kind in ("Polygon", "MultiPolygon"):
        total = np.zeros(3)
        for p in [g.parts] if g.kind == "Polygon" else g.parts:
            for k, ring in enumerate(p):
                if len(ring):
                    cx, cy, a = ring_centroid(ring)
                    w = abs(a) if k == 0 else -abs(a)
                    total += (cx * w, cy * w, w)
        if total[2]:
            return float(total[0] / total[2]), float(total[1] / total[2])
    total = np.zeros(3)
    for a in g.arrays:
        if len(a) > 1:
            d = np.hypot(*np.diff(a, axis=0).T)
            mid = (a[1:] + a[:-1]) / 2
            total += ((mid[:, 0] * d).sum(), (mid[:, 1] * d).sum(), d.sum())
    if total[2]:
        return float(total[0] / total[2]), float(total[1] / total[2])
    return tuple(np.concatenate(g.arrays).mean(0).tolist())


def path_length(g: Geometry) -> float:
    return float(sum(np.hypot(*np.diff(a, axis=0).T).sum() for a in g.arrays if len(a) > 1))


def at_length(a: np.ndarray, d: float) -> tuple[float, float, float]:
    """The point at a distance along a line, and the line's direction there."""
    seg = np.hypot(*np.diff(a, axis=0).T)
    run = np.concatenate([[0], np.cumsum(seg)])
    i = int(np.clip(np.searchsorted(run, d, side="right") - 1, 0, max(len(seg) - 1, 0)))
    if not len(seg):
        return float(a[0, 0]), float(a[0, 1]), 0.0
    t = (d - run[i]) / seg[i] if seg[i] else 0.0
    p = a[i] + (a[i + 1] - a[i]) * t
    return float(p[0]), float(p[1]), math.atan2(a[i + 1, 1] - a[i, 1], a[i + 1, 0] - a[i, 0])


def middle_point(g: Geometry) -> tuple[float, float] | None:
    own = [a for a in g.arrays if len(a)]
    if not own:
        return None
    a = own[0]
    return at_length(a, np.hypot(*np.diff(a, axis=0).T).sum() / 2)[:2] if len(a) > 1 else (float(a[0, 0]), float(a[0, 1]))


def segment_distances(a: np.ndarray, b: np.ndarray, x: float, y: float) -> tuple[np.ndarray, np.ndarray]:
    """Distances of a point to segments, and the nearest points on them."""
    d = b - a
    n = (d * d).sum(1)
    t = np.clip(((x - a[:, 0]) * d[:, 0] + (y - a[:, 1]) * d[:, 1]) / np.where(n > 0, n, 1), 0, 1)
    p = a + d * np.where(n > 0, t, 0)[:, None]
    return np.hypot(p[:, 0] - x, p[:, 1] - y), p


def in_ring(ring: np.ndarray, x: float, y: float) -> bool:
    a, b = ring, np.roll(ring, -1, axis=0)
    cross = ((a[:, 1] <= y) & (y < b[:, 1])) | ((b[:, 1] <= y) & (y < a[:, 1]))
    if not cross.any():
        return False
    a, b = a[cross], b[cross]
    return bool(np.sum(x < (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]) % 2)


def in_rings(rings: list[np.ndarray], x: float, y: float) -> bool:
    return bool(sum(in_ring(r, x, y) for r in rings if len(r)) % 2)


def hit(g: Geometry, x: float, y: float, tolerance: float) -> bool:
    """Points within the tolerance, lines nearer than it, polygons that hold the point; a polygon with a ring of fewer than four points never does."""
    if g.kind in ("Point", "MultiPoint"):
        return bool(len(g.parts) and (np.hypot(g.parts[:, 0] - x, g.parts[:, 1] - y) <= tolerance).any())
    if g.kind == "LineString":
        a = g.parts
        if len(a) == 1:
            return bool(np.hypot(a[0, 0] - x, a[0, 1] - y) < tolerance)
        return bool(len(a) > 1 and segment_distances(a[:-1], a[1:], x, y)[0].min() < tolerance)
    if g.kind == "Polygon":
        return bool(g.parts) and all(len(r) >= 4 for r in g.parts) and in_rings(g.parts, x, y)
    return any(hit(s, x, y, tolerance) for s in g.singles())


def closest_point(g: Geometry, x: float, y: float) -> tuple[float, float, float] | None:
    best: tuple[float, float, float] | None = None
    for s in g.singles():
        if s.empty:
            continue
        if s.kind == "Polygon" and in_rings(s.parts, x, y):
            return x, y, 0.0
        for a in s.arrays:
            if not len(a):
                continue
            d, p = segment_distances(a[:-1], a[1:], x, y) if len(a) > 1 else (np.hypot(a[:, 0] - x, a[:, 1] - y), a)
            i = int(d.argmin())
            if best is None or d[i] < best[2]:
                best = float(p[i, 0]), float(p[i, 1]), float(d[i])
    return best


def ring_distances(rings: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of points to a polygon's border, negative outside."""
    a = np.concatenate([r for r in rings if len(r)])
    b = np.concatenate([np.roll(r, -1, axis=0) for r in rings if len(r)])
    d = b - a
    n = (d * d).sum(1)
    wx, wy = x[:, None] - a[:, 0], y[:, None] - a[:, 1]
    t = np.where(n > 0, np.clip((wx * d[:, 0] + wy * d[:, 1]) / np.where(n > 0, n, 1), 0, 1), 0)
    near = np.sqrt(((wx - t * d[:, 0]) ** 2 + (wy - t * d[:, 1]) ** 2).min(1))
    passes = (a[:, 1] > y[:, None]) != (b[:, 1] > y[:, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        passes &= x[:, None] < d[:, 0] * wy / d[:, 1] + a[:, 0]
    return np.where(passes.sum(1) % 2 == 1, near, -near)


def _deepest(rings: list[np.ndarray], precision: float, fitness, start: tuple[float, float] | None) -> tuple[float, float]:
    """The point with the highest fitness(x, y, distance to the border), to within precision, by halving cells best first.

    A cell's promise is the fitness of its centre, were it farther from the border by as much as half the cell's diagonal.
    """
    ring = rings[0]
    low, high = ring.min(0), ring.max(0)
    size = high - low
    side = float(min(size))
    if side <= 0:
        return tuple(low.tolist())
    queue: list[tuple[float, int, float, float, float, float]] = []
    best, place, number = -math.inf, tuple(((low + high) / 2).tolist()), 0

    def add(xs: np.ndarray, ys: np.ndarray, h: float) -> None:
        nonlocal number
        for x, y, d in zip(xs.tolist(), ys.tolist(), ring_distances(rings, xs, ys).tolist()):
            heapq.heappush(queue, (-fitness(x, y, d + h * math.sqrt(2)), number, x, y, h, fitness(x, y, d)))
            number += 1

    grid = np.stack(np.meshgrid(*[low[k] + side / 2 + side * np.arange(math.ceil(size[k] / side)) for k in (0, 1)], indexing="ij"), -1).reshape(-1, 2)
    add(grid[:, 0], grid[:, 1], side / 2)
    if start is not None:
        place = start
        best = fitness(*start, float(ring_distances(rings, np.array([start[0]]), np.array([start[1]]))[0]))
    corners = np.array([(-1, -1), (1, -1), (-1, 1), (1, 1)])
    while queue:
        promise, _, x, y, h, f = heapq.heappop(queue)
        if f > best:
            best, place = f, (x, y)
        if -promise - best > precision:
            add(x + corners[:, 0] * h / 2, y + corners[:, 1] * h / 2, h / 2)
    return place


def polylabel(g: Geometry, share: float = 0.01) -> tuple[float, float] | None:
    """The point of a polygon farthest from its border, to within a share of its larger side."""
    if g.kind != "Polygon" or g.empty or len(g.parts[0]) < 3:
        return None
    side = float((g.parts[0].max(0) - g.parts[0].min(0)).max())
    return _deepest(g.parts, side * share, lambda x, y, d: d, centroid(g))


def interior(g: Geometry, scale: float = 1.0) -> tuple[float, float] | None:
    """A point well inside a polygon: its distance to the border counts less the farther it is from the centroid."""
    if g.kind != "Polygon" or g.empty or len(g.parts[0]) < 3:
        return None
    side = float((g.parts[0].max(0) - g.parts[0].min(0)).max())
    cx, cy = centroid(g)
    return _deepest(g.parts, side * 0.01 * scale, lambda x, y, d: d if d <= 0 else d * (1 - math.hypot(x - cx, y - cy) / side), (cx, cy))


def _crosses(p: np.ndarray, q: np.ndarray, closed: bool) -> bool:
    """Whether two of a path's segments meet other than as neighbours at their shared end. Segments are taken in
    blocks against all later ones, so a long path needs little memory."""
    n = len(p)
    block = max(1, 20_000 // max(n, 1))
    for at in range(0, n - 1, block):
        i, j = np.nonzero(np.arange(at, min(at + block, n - 1))[:, None] < np.arange(n)[None, :])
        i = i + at
        d1, d2, w = q[i] - p[i], q[j] - p[j], p[j] - p[i]
        den = d1[:, 0] * d2[:, 1] - d1[:, 1] * d2[:, 0]
        cross = w[:, 0] * d1[:, 1] - w[:, 1] * d1[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = (w[:, 0] * d2[:, 1] - w[:, 1] * d2[:, 0]) / den, cross / den
        after, around = j == i + 1, (i == 0) & (j == n - 1) & closed
        meet = (den != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        at_end = (after & (t == 1) & (u == 0)) | (around & (t == 0) & (u == 1))
        if (meet & ~at_end).any():
            return True
        flat = np.flatnonzero((den == 0) & (cross == 0))
        if len(flat):
            n1 = (d1[flat] ** 2).sum(1)
            ok = n1 > 0
            flat, n1 = flat[ok], n1[ok]
            a, b = (w[flat] * d1[flat]).sum(1) / n1, ((w[flat] + d2[flat]) * d1[flat]).sum(1) / n1
            over = np.minimum(1, np.maximum(a, b)) - np.maximum(0, np.minimum(a, b))
            if (over > 1e-12).any() or (~(after | around)[flat] & (over >= 0)).any():
                return True
    return False


#: Pairs of segments looked at together, and the share of a shape's size within which places are one.
PAIRS, SAME = 200_000, 1e-12


def _near_pairs(a: np.ndarray, b: np.ndarray, owner: np.ndarray):
    """Pairs of segments of different owners whose boxes meet, in blocks: segments are swept in the order of their left ends."""
    left, right = np.minimum(a[:, 0], b[:, 0]), np.maximum(a[:, 0], b[:, 0])
    low, high = np.minimum(a[:, 1], b[:, 1]), np.maximum(a[:, 1], b[:, 1])
    order = np.argsort(left, kind="stable")
    ends = np.searchsorted(left[order], right[order], side="right")
    width = ends - np.arange(len(order)) - 1
    done = 0
    run = np.cumsum(width)
    while done < len(order):
        stop = max(done + 1, int(np.searchsorted(run, (run[done - 1] if done else 0) + PAIRS, side="right")))
        i = np.repeat(np.arange(done, stop), width[done:stop])
        if len(i):
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(width[done:stop]) - width[done:stop], width[done:stop])
            i, j = order[i], order[j]
            keep = (owner[i] != owner[j]) & (low[i] <= high[j]) & (low[j] <= high[i])
            if keep.any():
                yield i[keep], j[keep]
        done = stop


def _beside(p: np.ndarray, ring: np.ndarray, near: float) -> np.ndarray:
    """1 for points inside a ring, 0 on it, -1 outside."""
    out = np.empty(len(p), int)
    step = max(1, PAIRS // max(1, len(ring)))
    for at in range(0, len(p), step):
        d = ring_distances([ring], p[at : at + step, 0], p[at : at + step, 1])
        out[at : at + step] = np.where(np.abs(d) <= near, 0, np.sign(d))
    return out


class Arrangement:
    """How the rings of an area lie to each other: where they meet, and on which side of another each piece of a ring is."""

    def __init__(self, rings: list[np.ndarray]) -> None:
        self.rings = rings
        every = np.concatenate(rings)
        self.near = SAME * max(1e-300, float((every.max(0) - every.min(0)).max()))
        self.a = np.concatenate([r[:-1] for r in rings])
        self.b = np.concatenate([r[1:] for r in rings])
        self.owner = np.repeat(np.arange(len(rings)), [len(r) - 1 for r in rings])
        self.overlap = False
        cuts: dict[int, list[float]] = {}
        self.touches: dict[tuple[int, int], list[tuple[float, float]]] = {}
        for i, j in _near_pairs(self.a, self.b, self.owner):
            d1, d2, w = self.b[i] - self.a[i], self.b[j] - self.a[j], self.a[j] - self.a[i]
            den = d1[:, 0] * d2[:, 1] - d1[:, 1] * d2[:, 0]
            with np.errstate(divide="ignore", invalid="ignore"):
                t, u = (w[:, 0] * d2[:, 1] - w[:, 1] * d2[:, 0]) / den, (w[:, 0] * d1[:, 1] - w[:, 1] * d1[:, 0]) / den
            for k in np.flatnonzero((den != 0) & (t >= -SAME) & (t <= 1 + SAME) & (u >= -SAME) & (u <= 1 + SAME)).tolist():
                self._meet(cuts, i[k], j[k], float(t[k]), float(u[k]))
            line = np.flatnonzero((den == 0) & (w[:, 0] * d1[:, 1] - w[:, 1] * d1[:, 0] == 0))
            for k in line.tolist():
                n = float((d1[k] ** 2).sum())
                e, f = sorted((float((w[k] * d1[k]).sum()) / n, float(((w[k] + d2[k]) * d1[k]).sum()) / n)) if n else (2.0, 2.0)
                e, f = max(e, 0.0), min(f, 1.0)
                if f - e > SAME:
                    self.overlap = True
                elif f >= e:
                    n2 = float((d2[k] ** 2).sum())
                    self._meet(cuts, i[k], j[k], e, float(((e * d1[k] - w[k]) * d2[k]).sum()) / n2 if n2 else 0.0)
        self.cuts = cuts

    def _meet(self, cuts: dict, i: int, j: int, t: float, u: float) -> None:
        cuts.setdefault(int(i), []).append(t)
        cuts.setdefault(int(j), []).append(u)
        p = self.a[i] + t * (self.b[i] - self.a[i])
        pair = tuple(sorted((int(self.owner[i]), int(self.owner[j]))))
        known = self.touches.setdefault(pair, [])
        if not any(abs(x - p[0]) <= self.near * 4 and abs(y - p[1]) <= self.near * 4 for x, y in known):
            known.append((float(p[0]), float(p[1])))

    def sides(self, one: int, other: int) -> set[int]:
        """On which sides of another ring pieces of a ring lie (1 inside, 0 on it, -1 outside). Without a meeting its first point tells."""
        if tuple(sorted((one, other))) not in self.touches:
            return set(_beside(self.rings[one][:1], self.rings[other], self.near).tolist())
        mids = []
        for k in np.flatnonzero(self.owner == one).tolist():
            ts = sorted({0.0, 1.0, *(min(max(t, 0.0), 1.0) for t in self.cuts.get(k, ()))})
            mids += [self.a[k] + (s + t) / 2 * (self.b[k] - self.a[k]) for s, t in zip(ts, ts[1:]) if t - s > 4 * SAME]
        return set(_beside(np.array(mids), self.rings[other], self.near).tolist())

    def parted(self, own: list[int]) -> bool:
        """Whether touching rings enclose a part of the area: their touches form a cycle."""
        up: dict = {}

        def top(x):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        edges = set()
        for (i, j), places in self.touches.items():
            if i in own and j in own:
                for x, y in places:
                    at = (round(x / (self.near * 16)), round(y / (self.near * 16)))
                    edges |= {(i, at), (j, at)}
        for ring, at in sorted(edges):
            a, b = top(ring), top(at)
            if a == b:
                return True
            up[a] = b
        return False


def _area_fault(polygons: list[list[np.ndarray]]) -> str | None:
    """What is wrong between the rings of polygons, each of which is in order by itself."""
    rings = [r for p in polygons for r in p]
    if len(rings) < 2:
        return None
    found = Arrangement(rings)
    if found.overlap:
        return "two rings share a piece"
    first = 0
    for p in polygons:
        own = list(range(first, first + len(p)))
        for k in own[1:]:
            sides = found.sides(k, first)
            if sides == {-1}:
                return "a hole lies outside its ring"
            if sides != {1}:
                return "a hole crosses its ring"
        for n, k in enumerate(own[1:]):
            for m in own[1 + n + 1 :]:
                one, other = found.sides(k, m), found.sides(m, k)
                if one == {1} or other == {1}:
                    return "a hole lies inside another"
                if one != {-1} or other != {-1}:
                    return "two holes cross"
        if found.parted(own):
            return "holes cut the inside in two"
        first += len(p)
    starts = np.cumsum([0, *(len(p) for p in polygons)]).tolist()
    for i, p in enumerate(polygons):
        for j in range(i + 1, len(polygons)):
            a, b = starts[i], starts[j]
            if not _apart(found, a, b, starts[j], starts[j + 1]) or not _apart(found, b, a, starts[i], starts[i + 1]):
                return "two parts overlap"
    return None


def _apart(found: Arrangement, shell: int, other: int, start: int, end: int) -> bool:
    """Whether a part's outer ring keeps out of the inside of another part, whose rings are start .. end - 1."""
    sides = found.sides(shell, other)
    if sides == {-1}:
        return True
    return sides == {1} and any(found.sides(shell, hole) == {1} for hole in range(start + 1, end))


def invalid_reason(g: Geometry) -> str | None:
    """Why a geometry isn't valid; none if it is. An empty one and points are valid.

    Rings are tested by themselves, then, by a sweep over the segments of all rings, against each other: holes lie inside their
    ring, none in another, and they don't cut the inside in two; parts may touch in points, and lie in others' holes.
    """
    for a in g.arrays:
        if len(a) and not np.isfinite(a).all():
            return "a coordinate isn't finite"
    if g.kind == "GeometryCollection":
        return next((r for r in map(invalid_reason, g.parts) if r), None)
    polygons = []
    for s in g.singles():
        if s.kind == "LineString" and len(s.parts) and len(np.unique(s.parts, axis=0)) < 2:
            return "a line has fewer than two different points"
        if s.kind == "Polygon":
            own_rings = []
            for k, ring in enumerate(s.parts):
                if len(ring) < 4:
                    return "a ring has fewer than four points"
                if (ring[0] != ring[-1]).any():
                    return "a ring isn't closed"
                own = ring[np.concatenate([[True], (np.diff(ring, axis=0) != 0).any(1)])]
                if len(own) < 4:
                    return "a ring has too few different points"
                if _crosses(own[:-1], own[1:], True):
                    return "a ring crosses itself"
                if (signed_area(ring) > 0) == (k == 0):
                    return "a ring has the wrong direction"
                own_rings.append(own)
            if own_rings:
                polygons.append(own_rings)
    return _area_fault(polygons)


def is_simple(g: Geometry) -> bool:
    if g.kind == "MultiPoint":
        return len(np.unique(g.parts, axis=0)) == len(g.parts)
    for s in g.singles():
        if s.kind == "LineString" and len(s.parts) > 1:
            a = s.parts
            if (np.diff(a, axis=0) == 0).all(1).any():
                return False
            if _crosses(a[:-1], a[1:], bool((a[0] == a[-1]).all())):
                return False
        if s.kind == "Polygon" and any(len(r) > 1 and (np.diff(r, axis=0) == 0).all(1).any() for r in s.parts):
            return False
    return True


def corrected(g: Geometry) -> Geometry:
    """Polygon rings closed; outer ones clockwise, holes the other way. Others as they are."""

    def ring(a: np.ndarray, outer: bool) -> np.ndarray:
        if len(a) and (a[0] != a[-1]).any():
            a = np.concatenate([a, a[:1]])
        return a[::-1] if (signed_area(a) > 0) == outer and signed_area(a) else a

    fix = lambda p: [ring(a, k == 0) for k, a in enumerate(p)]
    if g.kind == "Polygon":
        return Geometry(g.kind, fix(g.parts))
    if g.kind == "MultiPolygon":
        return Geometry(g.kind, [fix(p) for p in g.parts])
    if g.kind == "GeometryCollection":
        return Geometry(g.kind, [corrected(x) for x in g.parts])
    return g


def without_empty(g: Geometry) -> Geometry:
    if g.kind in ("MultiLineString",):
        return Geometry(g.kind, [a for a in g.parts if len(a)])
    if g.kind == "Polygon":
        return Geometry(g.kind, [a for a in g.parts if len(a)])
    if g.kind == "MultiPolygon":
        return Geometry(g.kind, [q for p in g.parts if (q := [a for a in p if len(a)])])
    if g.kind == "GeometryCollection":
        return Geometry(g.kind, [without_empty(x) for x in g.parts if not x.empty])
    return g


# --- simplification -----------------------------------------------------------


def radial_distance(a: np.ndarray, tolerance: float) -> np.ndarray:
    """Points farther than the tolerance from the last one kept; the ends stay."""
    if len(a) < 3:
        return a
    keep, last = [0], a[0]
    for i in range(1, len(a) - 1):
        if (a[i] - last) @ (a[i] - last) > tolerance * tolerance:
            keep.append(i)
            last = a[i]
    return a[[*keep, len(a) - 1]]


def douglas_peucker(a: np.ndarray, tolerance: float) -> np.ndarray:
    if len(a) < 3:
        return a
    keep = np.zeros(len(a), bool)
    keep[[0, -1]] = True
    todo = [(0, len(a) - 1)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        p = a[i + 1 : j]
        base = np.repeat(a[i][None], len(p), 0)
        d = a[j] - a[i]
        n = d @ d
        t = np.clip(((p - base) @ d) / n, 0, 1) if n else np.zeros(len(p))
        q = base + t[:, None] * d
        far = ((p - q) ** 2).sum(1)
        k = int(far.argmax())
        if far[k] > tolerance * tolerance:
            keep[i + 1 + k] = True
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return a[keep]


def visvalingam(a: np.ndarray, tolerance: float) -> np.ndarray:
    """The point whose triangle with its neighbours is smallest goes first, while that is below the tolerance."""
    n = len(a)
    if n < 3:
        return a
    area = lambda i, j, k: abs((a[j, 0] - a[i, 0]) * (a[k, 1] - a[i, 1]) - (a[k, 0] - a[i, 0]) * (a[j, 1] - a[i, 1])) / 2
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    weight = [math.inf, *(area(i - 1, i, i + 1) for i in range(1, n - 1)), math.inf]
    queue = [(weight[i], i) for i in range(1, n - 1)]
    heapq.heapify(queue)
    gone = [False] * n
    while queue:
        w, i = heapq.heappop(queue)
        if gone[i] or w != weight[i]:
            continue
        if w >= tolerance:
            break
        gone[i] = True
        p, q = before[i], after[i]
        after[p], before[q] = q, p
        for j in (p, q):
            if 0 < j < n - 1:
                weight[j] = max(w, area(before[j], j, after[j]))
                heapq.heappush(queue, (weight[j], j))
    return a[[i for i in range(n) if not gone[i]]]


def _in_strip(p: np.ndarray, a: np.ndarray, b: np.ndarray, tolerance: float) -> bool:
    """Whether all points lie in the rectangle around the way from a to b, tolerance to either side (by the crossings of a level ray, so that its borders count once)."""
    angle = math.atan2(b[1] - a[1], b[0] - a[0])
    side = np.array([tolerance * math.sin(angle), -tolerance * math.cos(angle)])
    corner = np.array([a + side, a - side, b - side, b + side])
    inside = np.zeros(len(p), bool)
    for u, v in zip(corner, np.roll(corner, -1, axis=0)):
        cross = (v[1] <= p[:, 1]) != (u[1] <= p[:, 1])
        if cross.any():
            inside ^= cross & (p[:, 0] < (u[0] - v[0]) * (p[:, 1] - v[1]) / (u[1] - v[1]) + v[0])
    return bool(inside.all())


def sleeve(a: np.ndarray, tolerance: float, ring: bool = False) -> np.ndarray:
    """A point stays when the points since the last kept one don't all lie within the tolerance of the way to the next. A ring keeps the point before its end."""
    if len(a) < 3:
        return a
    n = len(a) - (ring and bool((a[0] == a[-1]).all()))
    out, start = [0], 0
    for i in range(2, n):
        if not _in_strip(a[start + 1 : i], a[start], a[i], tolerance):
            start = i - 1
            out.append(start)
    return a[sorted({*out, n - 1, len(a) - 1})]


SIMPLIFIERS = {"radial-distance": radial_distance, "douglas-peucker": douglas_peucker, "visvalingam-whyatt": visvalingam, "zhao-saalfeld": sleeve}


def simplified(g: Geometry, algorithm: str, tolerance: float) -> Geometry:
    if algorithm not in SIMPLIFIERS:
        raise ValueError(f"no algorithm {algorithm}")
    if g.kind == "GeometryCollection":
        return Geometry(g.kind, [simplified(p, algorithm, tolerance) for p in g.parts])
    if g.kind in ("Point", "MultiPoint") or tolerance <= 0:
        return g
    if algorithm == "zhao-saalfeld":
        return g.mapped(lambda a: sleeve(a, tolerance, g.kind in ("Polygon", "MultiPolygon")))
    return g.mapped(lambda a: SIMPLIFIERS[algorithm](a, tolerance))


# --- converters ---------------------------------------------------------------


def smoothed(a: np.ndarray, amount: float, steps: int = 8) -> np.ndarray:
    """Curves through the points, whose handles are the share amount of the neighbouring sides."""
    if len(a) < 3 or amount <= 0:
        return a
    closed = bool((a[0] == a[-1]).all())
    p = a[:-1] if closed else a
    n = len(p)
    side = lambda i, j: math.hypot(*(p[j] - p[i]))
    t = np.linspace(0, 1, steps + 1)[1:, None]
    out = [p[:1]]
    for i in range(n if closed else n - 1):
        i0, i1, i2, i3 = ((i - 1) % n, i, (i + 1) % n, (i + 2) % n) if closed else (max(i - 1, 0), i, i + 1, min(i + 2, n - 1))
        m = [(p[i0] + p[i1]) / 2, (p[i1] + p[i2]) / 2, (p[i2] + p[i3]) / 2]
        l0, l1, l2 = side(i0, i1), side(i1, i2), side(i2, i3)
        k1, k2 = l0 / (l0 + l1 or 1), l1 / (l1 + l2 or 1)
        c1 = p[i1] + (m[1] - (m[0] + (m[1] - m[0]) * k1)) * amount
        c2 = p[i2] + (m[1] - (m[1] + (m[2] - m[1]) * k2)) * amount
        out.append((1 - t) ** 3 * p[i1] + 3 * (1 - t) ** 2 * t * c1 + 3 * (1 - t) * t**2 * c2 + t**3 * p[i2])
    return np.concatenate(out)


def offset_line(a: np.ndarray, by: float, join_limit: float = 4.0) -> np.ndarray:
    """The parallel curve: left of the direction for positive distances. Inner corners meet, outer ones are rounded by arcs."""
    own = a[np.concatenate([[True], (np.diff(a, axis=0) != 0).any(1)])] if len(a) else a
    if len(own) < 2 or by == 0:
        return a
    d = np.diff(own, axis=0)
    u = d / np.hypot(*d.T)[:, None]
    normal = np.stack([-u[:, 1], u[:, 0]], 1) * by
    out = [own[0] + normal[0]]
    for i in range(1, len(own) - 1):
        turn = u[i - 1, 0] * u[i, 1] - u[i - 1, 1] * u[i, 0]
        cos = float(np.clip(u[i - 1] @ u[i], -1, 1))
        if turn * by > 0 and cos > -0.99:
            b = normal[i - 1] + normal[i]
            length = min(1 / max((1 + cos) / 2, 1e-9), join_limit)
            out.append(own[i] + b / 2 * length)
        elif abs(turn) < 1e-12 and cos > 0:
            out.append(own[i] + normal[i])
        else:
            angle = math.acos(cos)
            steps = max(1, math.ceil(angle / (math.pi / 8)))
            start = math.atan2(normal[i - 1, 1], normal[i - 1, 0])
            way = -1 if by > 0 else 1
            for k in range(steps + 1):
                w = start + way * angle * k / steps
                out.append(own[i] + abs(by) * np.array([math.cos(w), math.sin(w)]))
    out.append(own[-1] + normal[-1])
    return np.array(out)


def _arc(centre: np.ndarray, start: np.ndarray, end: np.ndarray, way: int, radius: float) -> list[np.ndarray]:
    """Points of an arc from start to end around centre, way 1 counter-clockwise; ends included."""
    a, b = (math.atan2(*(p - centre)[::-1]) for p in (start, end))
    turn = (b - a) * way % (2 * math.pi)
    steps = max(1, math.ceil(turn / (math.pi / 16)))
    return [start, *(centre + radius * np.array([math.cos(a + way * turn * k / steps), math.sin(a + way * turn * k / steps)]) for k in range(1, steps)), end]


def _side(a: np.ndarray, u: np.ndarray, by: float, join: str, limit: float, closed: bool) -> list[np.ndarray]:
    """The parallel of a path at its left: corners meet on the inner side, and are joined on the outer one."""
    normal = np.stack([-u[:, 1], u[:, 0]], 1) * by
    n = len(u)
    lengths = np.hypot(*np.diff(a, axis=0).T)
    out: list[np.ndarray] = [] if closed else [a[0] + normal[0]]
    for i in range(0 if closed else 1, n):
        p, before, after = a[i], normal[i - 1], normal[i]
        cross, dot = u[i - 1, 0] * u[i, 1] - u[i - 1, 1] * u[i, 0], float(u[i - 1] @ u[i])
        meet = p + (before + after) / max(1 + dot, 1e-12)
        if cross == 0 and dot > 0:
            out.append(p + after)
        elif cross > 0:
            # the inner side of a left turn
            reach = by * cross / max(1 + dot, 1e-12)
            out += [meet] if reach <= min(lengths[i - 1], lengths[i]) else [p + before, p, p + after]
        elif join == "round":
            out += _arc(p, p + before, p + after, -1, by)
        elif join == "bevel" or dot <= -1 + 1e-12:
            out += [p + before, p + after]
        else:
            far = math.hypot(*(meet - p))
            if far <= limit * by:
                out.append(meet)
            else:
                # a mitre beyond the limit is cut off at it, across its axis
                axis = (meet - p) / far
                edge = limit * by
                toward = lambda q: q + (meet - q) * max(0.0, min(1.0, (edge - float((q - p) @ axis)) / max(far - float((q - p) @ axis), 1e-12)))
                out += [toward(p + before), toward(p + after)]
    if not closed:
        out.append(a[-1] + normal[-1])
    return out


def stroked(a: np.ndarray, width: float, join: str = "miter", cap: str = "butt", limit: float = 4.0, ring: bool = False) -> list[np.ndarray]:
    """The outline of a line of a width as closed rings: one for an open path, an outer and an inner one for a ring.

    join is miter, round or bevel, cap is butt, square or round; mitres longer than limit half widths are cut off. A line
    without length is a dot: nothing with butt ends, a square or a disc otherwise.
    """
    if join not in ("miter", "miter-revert", "round", "bevel") or cap not in ("butt", "square", "round"):
        raise ValueError(f"no join {join} or cap {cap}")
    own = a[np.concatenate([[True], (np.diff(a, axis=0) != 0).any(1)])] if len(a) else a
    by = width / 2
    if not len(own) or by <= 0:
        return []
    if len(own) == 1:
        if cap == "butt":
            return []
        c = own[0]
        if cap == "square":
            return [c + by * np.array([(-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)], float)]
        return [np.array(_arc(c, c + (by, 0), c - (by, 0), 1, by) + _arc(c, c - (by, 0), c + (by, 0), 1, by)[1:])]
    shut = lambda r: np.array([*r, r[0]])
    closed = ring and len(own) > 3 and bool((own[0] == own[-1]).all())
    unit = lambda p: np.diff(p, axis=0) / np.hypot(*np.diff(p, axis=0).T)[:, None]
    back = own[::-1]
    u, v = unit(own), unit(back)
    left, right = _side(own, u, by, join, limit, closed), _side(back, v, by, join, limit, closed)
    if closed:
        return [shut(left), shut(right)]
    ends = []
    for end, d, side in ((own[-1], u[-1], left), (own[0], v[-1], right)):
        n = np.array([-d[1], d[0]]) * by
        ends.append([end + n + d * by, end - n + d * by] if cap == "square" else _arc(end, end + n, end - n, -1, by)[1:-1] if cap == "round" else [])
    return [shut([*left, *ends[0], *right, *ends[1]])]


def outline(g: Geometry, width: float, join: str = "miter", cap: str = "butt", limit: float = 4.0) -> Geometry:
    """The strokes of all lines, and of all rings, of a geometry, each a polygon; of a ring the wider outline is the outer one."""
    polygons = []
    for s in g.singles():
        for a in s.arrays if s.kind != "Point" else ():
            rings = sorted(stroked(a, width, join, cap, limit, s.kind == "Polygon"), key=lambda r: -abs(signed_area(r)))
            if rings:
                polygons.append(rings)
    return corrected(Geometry("MultiPolygon", polygons))


def extended(a: np.ndarray, by: float) -> np.ndarray:
    """Both ends moved outwards along their segments."""
    if len(a) < 2 or by == 0:
        return a
    out = a.copy()
    for end, inner in ((0, 1), (-1, -2)):
        d = a[end] - a[inner]
        n = math.hypot(*d)
        if n:
            out[end] = a[end] + d / n * by
    return out


def clipped_line(a: np.ndarray, box: tuple[float, float, float, float]) -> list[np.ndarray]:
    """The parts of a line inside a box."""
    out: list[list] = []
    for p, q in zip(a[:-1], a[1:]):
        t0, t1 = 0.0, 1.0
        d = q - p
        for k, (low, high) in enumerate(((box[0], box[2]), (box[1], box[3]))):
            if d[k] == 0:
                if not low <= p[k] <= high:
                    t0, t1 = 1.0, 0.0
                continue
            u, v = (low - p[k]) / d[k], (high - p[k]) / d[k]
            t0, t1 = max(t0, min(u, v)), min(t1, max(u, v))
        if t0 > t1 or (t0 == t1 and len(a) > 2):
            continue
        s, e = p + d * t0, p + d * t1
        if out and np.array_equal(out[-1][-1], s):
            out[-1].append(e)
        else:
            out.append([s, e])
    return [np.array(x) for x in out]


def clipped_ring(a: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """A ring cut at a box's four sides, one after another."""
    own = a[:-1] if len(a) > 1 and (a[0] == a[-1]).all() else a
    for k, bound, sign in ((0, box[0], 1), (0, box[2], -1), (1, box[1], 1), (1, box[3], -1)):
        out = []
        for i in range(len(own)):
            p, q = own[i - 1], own[i]
            ip, iq = (p[k] - bound) * sign >= 0, (q[k] - bound) * sign >= 0
            if ip != iq:
                out.append(p + (q - p) * ((bound - p[k]) / (q[k] - p[k])))
            if iq:
                out.append(q)
        own = np.array(out).reshape(-1, 2)
        if not len(own):
            return own
    return np.concatenate([own, own[:1]])


def clipped(g: Geometry, box: tuple[float, float, float, float]) -> Geometry:
    if g.kind in ("Point", "MultiPoint"):
        a = g.parts
        return Geometry(g.kind, a[(a[:, 0] >= box[0]) & (a[:, 0] <= box[2]) & (a[:, 1] >= box[1]) & (a[:, 1] <= box[3])])
    if g.kind in ("LineString", "MultiLineString"):
        parts = [x for a in g.arrays if len(a) > 1 for x in clipped_line(a, box)]
        return Geometry("LineString", parts[0]) if len(parts) == 1 else Geometry("MultiLineString", parts)
    if g.kind == "Polygon":
        return Geometry(g.kind, [r for a in g.parts if len(a) and len(r := clipped_ring(a, box))])
    if g.kind == "MultiPolygon":
        return Geometry(g.kind, [p for s in g.singles() if len(p := clipped(s, box).parts)])
    return Geometry(g.kind, [c for x in g.parts if not (c := clipped(x, box)).empty])


def converted(g: Geometry, clip: tuple | None = None, transform: tuple | None = None, simplify: tuple | None = None, smooth: float = 0.0, offset: float = 0.0) -> Geometry:
    """The converters in their order: clip, transform, simplify, smooth, offset (lines)."""
    if clip is not None:
        g = clipped(g, clip)
    if transform is not None:
        m = np.array([[transform[0], transform[1]], [transform[2], transform[3]]])
        g = g.mapped(lambda a: a @ m + np.array(transform[4:6]) if len(a) else a)
    if simplify is not None:
        g = simplified(g, *simplify)
    if smooth and g.kind not in ("Point", "MultiPoint"):
        g = g.mapped(lambda a: smoothed(a, smooth))
    if offset and g.kind in ("LineString", "MultiLineString"):
        g = g.mapped(lambda a: offset_line(a, offset))
    return g


def grid_points(g: Geometry, dx: float, dy: float, alternating: bool = False) -> np.ndarray:
    """Points of a regular grid inside a polygon, from the middle of its box outwards; alternating shifts every second row by half a step."""
    if g.kind not in ("Polygon", "MultiPolygon") or g.empty:
        return points([])
    low = envelope(g)
    cx, cy = (low[0] + low[2]) / 2, (low[1] + low[3]) / 2
    nx, ny = int((low[2] - low[0]) / 2 // dx) + 1, int((low[3] - low[1]) / 2 // dy) + 1
    out = []
    for j in range(-ny, ny + 1):
        for i in range(-nx, nx + 1):
            x, y = cx + i * dx + (dx / 2 if alternating and j % 2 else 0), cy + j * dy
            if any(in_rings(s.parts, x, y) for s in g.singles()):
                out.append((max(abs(i), abs(j)), math.atan2(j, i), x, y))
    return points([(x, y) for _, _, x, y in sorted(out)])


def extrusion(g: Geometry, height: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A building's walls (a quadrilateral for each side, those farther back first) and its roof rings."""
    walls = []
    for a in g.arrays:
        for p, q in zip(a[:-1], a[1:]):
            walls.append(np.array([p, q, q + [0, height], p + [0, height], p]))
    walls.sort(key=lambda w: -(w[0, 1] + w[1, 1]))
    return walls, [a + [0, height] for a in g.arrays]


def marker_positions(g: Geometry, placement: str, spacing: float = 100.0, max_error: float = 0.2) -> list[tuple[float, float, float]]:
    """Positions and angles of markers on a geometry."""
    out: list[tuple[float, float, float]] = []
    for s in g.singles():
        if s.empty:
            continue
        a = s.arrays[0]
        if s.kind == "Point":
            out.append((float(a[0, 0]), float(a[0, 1]), 0.0))
        elif placement == "vertex-first":
            out.append((*map(float, a[0]), math.atan2(*(a[1] - a[0])[::-1]) if len(a) > 1 else 0.0))
        elif placement == "vertex-last":
            out.append((*map(float, a[-1]), math.atan2(*(a[-1] - a[-2])[::-1]) if len(a) > 1 else 0.0))
        elif placement == "line":
            for line in s.arrays:
                total = path_length(Geometry("LineString", line))
                if total <= 0:
                    continue
                n = max(1, math.floor(total / max(spacing, 1e-9) + 0.5)) if spacing >= 1 else 1
                step = total / n
                out += [at_length(line, step * (k + 0.5)) for k in range(n)]
        elif placement == "interior" and s.kind == "Polygon":
            p = interior(s)
            out += [(*p, 0.0)] if p else []
        elif placement == "polylabel" and s.kind == "Polygon":
            p = polylabel(s)
            out += [(*p, 0.0)] if p else []
        elif placement == "angled-point" and s.kind == "LineString":
            out.append(at_length(a, path_length(s) / 2))
        elif s.kind == "LineString":
            out.append((*middle_point(s), 0.0))
        else:
            p = centroid(s)
            out += [(*p, 0.0)] if p else []
    return out
