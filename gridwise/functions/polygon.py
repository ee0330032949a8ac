"""Polygons as column expressions: arrays of closed rings of (x, y), the outer ring first and its holes after it."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from gridwise.functions import geo

POLYGON = "array<array<struct<x: double, y: double>>>"
RING = "array<struct<x: double, y: double>>"
_RING = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))


def edges(rings: Column) -> Column:
    """All sides (a, b) of all rings."""
    return F.flatten(F.transform(rings, geo._pairs))


def box(rings: Column) -> dict[str, Column]:
    """xmin, ymin, xmax, ymax of the outer ring; null for none."""
    edge = lambda f, c: f(F.transform(F.get(rings, F.lit(0)), lambda p: p[c]))
    return {"xmin": edge(F.array_min, "x"), "ymin": edge(F.array_min, "y"), "xmax": edge(F.array_max, "x"), "ymax": edge(F.array_max, "y")}


def area(rings: Column) -> Column:
    """Area of the outer ring less its holes'; 0 for a null or empty polygon."""
    total = F.aggregate(F.transform(rings, geo.ring_area), F.lit(0.0), lambda s, a: s + a)
    return F.coalesce(F.when(F.size(rings) > 0, 2 * geo.ring_area(rings[0]) - total), F.lit(0.0))


def contains(rings: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside and in no hole: a ray to the right crosses the sides an odd number of times."""
    n = F.aggregate(
        edges(rings),
        F.lit(0),
        lambda s, p: s + F.when(((p["a"]["y"] > y) != (p["b"]["y"] > y)) & (x < (p["b"]["x"] - p["a"]["x"]) * (y - p["a"]["y"]) / F.nullif(p["b"]["y"] - p["a"]["y"], F.lit(0.0)) + p["a"]["x"]), 1).otherwise(0),
    )
    return F.coalesce((n % 2) == 1, F.lit(False))


def _side(a: Column, b: Column, c: Column) -> Column:
    return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])


def segments_touch(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether the segments a-b and c-d share a point."""
    boxes = (F.least(a["x"], b["x"]) <= F.greatest(c["x"], d["x"])) & (F.least(c["x"], d["x"]) <= F.greatest(a["x"], b["x"])) & (F.least(a["y"], b["y"]) <= F.greatest(c["y"], d["y"])) & (F.least(c["y"], d["y"]) <= F.greatest(a["y"], b["y"]))
    return boxes & (_side(a, b, c) * _side(a, b, d) <= 0) & (_side(c, d, a) * _side(c, d, b) <= 0)


def intersect(p: Column, q: Column) -> Column:
    """Whether two polygons share a point: sides touch, or one lies in the other."""
    touch = F.exists(edges(p), lambda e: F.exists(edges(q), lambda f: segments_touch(e["a"], e["b"], f["a"], f["b"])))
    return touch | contains(q, p[0][0]["x"], p[0][0]["y"]) | contains(p, q[0][0]["x"], q[0][0]["y"])


def interior_point(rings: Column) -> Column:
    """(x, y) inside the polygon: the middle of the widest stretch inside at half the polygon's height; null for none.

    The height is moved off the corners by a small odd share, so that no side is met at its end.
    """
    b = box(rings)
    y = b["ymin"] + (b["ymax"] - b["ymin"]) * 0.5000123
    cross = F.transform(F.filter(edges(rings), lambda e: (e["a"]["y"] > y) != (e["b"]["y"] > y)), lambda e: e["a"]["x"] + (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]))
    xs = F.array_sort(cross)
    inside = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(xs) / 2).cast("int") - 1, F.lit(0))), lambda i: F.struct((F.get(xs, 2 * i + 1) - F.get(xs, 2 * i)).alias("w"), ((F.get(xs, 2 * i + 1) + F.get(xs, 2 * i)) / 2).alias("x")))
    return F.when(F.size(xs) >= 2, F.struct(F.array_max(inside)["x"].alias("x"), y.alias("y")))


def segment_in_box(x0: Column, y0: Column, x1: Column, y1: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Whether a segment shares a point with a box: their boxes meet, and the box's corners are not all on one side of the segment."""
    dx, dy = x1 - x0, y1 - y0
    sides = [dx * (cy - y0) - dy * (cx - x0) for cx in (xmin, xmax) for cy in (ymin, ymax)]
    meet = (F.least(x0, x1) <= xmax) & (F.greatest(x0, x1) >= xmin) & (F.least(y0, y1) <= ymax) & (F.greatest(y0, y1) >= ymin)
    return meet & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)


def _points(ring: list[dict] | None) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in ring or []], float).reshape(-1, 2)


#: Pairs of sides that shared_area looks at together.
AT_ONCE = 1 << 20


def _flat_sides(polygons: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, (x0, y0, x1, y1), sign) of all sides of an Arrow array of polygons.

    sign says whether what lies below a side adds to the polygon's area or takes from it: the outer ring is run
    counter-clockwise and holes the other way, whatever way they were given.
    """
    counts = pc.fill_null(pc.list_value_length(polygons), 0).to_numpy(zero_copy_only=False)
    rings = polygons.flatten()
    sizes = pc.fill_null(pc.list_value_length(rings), 0).to_numpy(zero_copy_only=False)
    points = rings.flatten()
    xy = np.stack([points.field(c).to_numpy(zero_copy_only=False) for c in "xy"])
    row, ring = np.repeat(np.arange(len(counts)), counts), np.repeat(np.arange(len(sizes)), sizes)
    outer = np.append(True, row[1:] != row[:-1])[: len(row)]
    same = ring[1:] == ring[:-1]
    ring, ends = ring[:-1][same], np.concatenate([xy[:, :-1], xy[:, 1:]])[:, same]
    turned = np.bincount(ring, ends[0] * ends[3] - ends[2] * ends[1], len(sizes))
    return row[ring], ends, np.where((turned > 0) == outer, 1, -1)[ring] * np.sign(ends[0] - ends[2])


def side_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, low, x0, y0, x1, y1, sign) from polygons (id, rings): sides that aren't upright, with the polygon's lowest y and the sign of _flat_sides. Polygons with a null corner, whose area is 0, have none."""
    for b in batches:
        row, ends, sign = _flat_sides(b["rings"])
        low = np.full(b.num_rows, np.inf)
        np.minimum.at(low, row, np.minimum(ends[1], ends[3]))
        whole = np.ones(b.num_rows, bool)
        whole[row[np.isnan(ends).any(0)]] = False
        kept = np.flatnonzero((sign != 0) & whole[row])
        columns = [b["id"].take(pa.array(row[kept])), *(pa.array(c[kept]) for c in (low[row], *ends, sign))]
        yield pa.RecordBatch.from_arrays(columns, ["id", "low", "x0", "y0", "x1", "y1", "sign"])


def _least_below(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Area below the lower one of two sides (x0, y0, x1, y1), where both have an x."""
    lo = np.maximum(np.minimum(a[0], a[2]), np.minimum(b[0], b[2]))
    hi = np.minimum(np.maximum(a[0], a[2]), np.maximum(b[0], b[2]))
    at = lambda s, x: s[1] + (s[3] - s[1]) * ((x - s[0]) / np.where(s[2] == s[0], 1.0, s[2] - s[0]))
    a0, a1, b0, b1 = at(a, lo), at(a, hi), at(b, lo), at(b, hi)
    d0, d1 = a0 - b0, a1 - b1
    # What the first side is above the second: a trapezoid, a triangle or nothing.
    mixed, most = d0 * d1 < 0, np.maximum(d0, d1)
    above = np.where(mixed, most * most / (2 * np.where(mixed, np.abs(d0) + np.abs(d1), 1.0)), np.maximum(d0 + d1, 0.0) / 2)
    return np.where(hi > lo, (hi - lo) * ((a0 + a1) / 2 - above), 0.0)


def shared_areas(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Area that each two polygons share, whatever their form, with holes on both sides.

    A polygon is the signed sum of what lies below its sides, and what two such regions share lies below the lower one
    of two sides; so the area is a sum over pairs of sides, and no shape has to be worked out. Null polygons share none.
    """
    n, out = len(left), np.zeros(len(left))
    (ra, a, sa), (rb, b, sb) = _flat_sides(left), _flat_sides(right)
    # Heights count from the lowest point of a row, and places from its first.
    base, origin = np.full(n, np.inf), np.full(n, np.inf)
    for r, s in ((ra, a), (rb, b)):
        np.minimum.at(base, r, np.minimum(s[1], s[3]))
        np.minimum.at(origin, r, np.minimum(s[0], s[2]))
    for r, s in ((ra, a), (rb, b)):
        s -= np.stack([origin[r], base[r], origin[r], base[r]])
    na, nb = np.bincount(ra, minlength=n), np.bincount(rb, minlength=n)
    fa, fb, pairs = np.cumsum(na) - na, np.cumsum(nb) - nb, na * nb
    upto, first = np.cumsum(pairs), 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + AT_ONCE, "right")))
        row = np.repeat(np.arange(first, last), pairs[first:last])
        k = np.arange(len(row)) - np.repeat(upto[first:last] - pairs[first:last] - (upto[first - 1] if first else 0), pairs[first:last])
        i, j = fa[row] + k // np.maximum(nb[row], 1), fb[row] + k % np.maximum(nb[row], 1)
        near = (np.maximum(a[0, i], a[2, i]) > np.minimum(b[0, j], b[2, j])) & (np.maximum(b[0, j], b[2, j]) > np.minimum(a[0, i], a[2, i]))
        row, i, j = row[near], i[near], j[near]
        out += np.bincount(row, sa[i] * sb[j] * _least_below(a[:, i], b[:, j]), n)
        first = last
    return out


#: Pairs of pieces that a cell's sums take at once; so few stay in a core's cache.
PAIRED = 1 << 14


def _pieces(sides: np.ndarray, high: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(side, (x0, x1, c, m), side, (x0, x1)): what of sides lies in a box from (0, 0) to (high, high), as y = c + m * x, and where in the box's width sides are above it."""
    x0, y0, x1, y1 = np.where(sides[0] <= sides[2], sides, sides[[2, 3, 0, 1]])
    lo, hi = np.maximum(x0, 0.0), np.minimum(x1, high)
    hi = np.maximum(lo, hi)
    m = (y1 - y0) / np.where(x1 == x0, 1.0, x1 - x0)
    bottom, top = (np.clip(x0 + (y - y0) / np.where(m == 0, 1.0, m), lo, hi) for y in (0.0, high))
    level = np.where((y0 > 0) & (y0 < high), hi, lo)
    start, end = np.where(m == 0, lo, np.minimum(bottom, top)), np.where(m == 0, level, np.maximum(bottom, top))
    over0, over1 = np.where(m > 0, top, lo), np.where(m < 0, top, np.where((m > 0) | (y0 >= high), hi, lo))
    inside, above = np.flatnonzero(end > start), np.flatnonzero(over1 > over0)
    return inside, np.stack([start, end, y0 - m * x0, m])[:, inside], above, np.stack([over0, over1])[:, above]


def _below(x0: np.ndarray, x1: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Area below pieces (x0, x1, c, m) from x0 to x1."""
    lo = np.maximum(x0, piece[0])
    width = np.maximum(np.minimum(x1, piece[1]) - lo, 0.0)
    return (piece[2] + piece[3] * (lo + width / 2)) * width


def _below_both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Area below the lower one of two pieces, where both have an x: half of what lies below both, less half of what lies between them."""
    lo = np.maximum(a[0], b[0])
    width = np.maximum(np.minimum(a[1], b[1]) - lo, 0.0)
    turn = a[3] - b[3]
    d0 = a[2] - b[2] + turn * lo
    d1 = d0 + turn * width
    # Pieces that cross have two triangles between them.
    cross = np.maximum(-d0 * d1, 0.0) / np.where(turn == 0, 1.0, 2 * np.abs(turn))
    return ((a[2] + b[2] + (a[3] + b[3]) * (lo + width / 2)) / 2 - (np.abs(d0) + np.abs(d1)) / 4) * width + cross


def shared_below(own: np.ndarray, others: np.ndarray, high: float) -> np.ndarray:
    """For each of the sides (x0, y0, x1, y1, sign) the signed area that lies below it and below others, summed over these, in the box from (0, 0) to (high, high).

    sign is as in shared_areas. The sum over a polygon's sides is what it shares with all the others' polygons there. A
    side above the box counts as the box's upper edge; of others those are put together, and what they cover twice with
    opposite signs is gone.
    """
    side, a, over, top = _pieces(own[:4], high)
    at, b, above, tops = _pieces(others[:4], high)
    # From each end of such a stretch on to the right.
    ends, turn = np.unique(tops, return_inverse=True)
    times = np.bincount(turn.ravel(), np.concatenate([others[4, above], -others[4, above]]), len(ends))
    ends, times, weight, out = ends[times != 0], times[times != 0], others[4, at], np.zeros(own.shape[1])
    n = max(1, PAIRED // max(len(at), len(ends), 1))
    for k in range(0, len(side), n):
        p = a[:, k : k + n, None]
        each = _below_both(p, b[:, None]) @ weight + _below(ends, high, p) @ times
        out += np.bincount(side[k : k + n], own[4, side[k : k + n]] * each, len(out))
    for k in range(0, len(over), n):
        x0, x1 = top[:, k : k + n, None]
        each = _below(x0, x1, b[:, None]) @ weight + high * (np.maximum(x1 - np.maximum(x0, ends), 0.0) @ times)
        out += np.bincount(over[k : k + n], own[4, over[k : k + n]] * each, len(out))
    return out


def shared_by_cell(batches: Iterable[pa.RecordBatch], size: float) -> Iterator[pa.RecordBatch]:
    """(id, shared) from sides (cx, cy, part, block, own, id, x0, y0, x1, y1, sign), sorted by the first four: what a cell's own sides share below them with its others, summed by id in each cell."""

    def done(t: pa.Table) -> pa.RecordBatch:
        key = np.stack([t[c].to_numpy() for c in ("cx", "cy", "part", "block")])
        own, sides = t["own"].to_numpy(), np.stack([t[c].to_numpy() for c in ("x0", "y0", "x1", "y1", "sign")])
        sides[:4] -= np.stack([key[0], key[1], key[0], key[1]]) * size
        first = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(0)))
        shared = np.zeros(len(own))
        for lo, hi in zip(first, np.append(first[1:], len(own)), strict=True):
            mine = own[lo:hi]
            if mine.any() and not mine.all():
                shared[lo:hi][mine] = shared_below(sides[:, lo:hi][:, mine], sides[:, lo:hi][:, ~mine], size)
        rows = t.select(["id"]).append_column("shared", pa.array(shared)).filter(pa.array(own)).combine_chunks()
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in rows.columns], ["id", "shared"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        key = [b[c].to_numpy() for c in ("cx", "cy", "part", "block")]
        # The last group may go on in the next batch.
        new = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in key])) + 1
        last = int(new[-1]) if len(new) else 0
        if held and b.num_rows and any(h != k[0] for h, k in zip((held[-1][c][-1].as_py() for c in ("cx", "cy", "part", "block")), key, strict=True)):
            yield done(pa.Table.from_batches(held))
            held = []
        if last:
            yield done(pa.Table.from_batches([*held, b.slice(0, last)]))
            held = []
        held += [b.slice(last)] if b.num_rows else []
    if held:
        yield done(pa.Table.from_batches(held))


def distances(polygons: pa.Array, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """From points to polygons, row by row: 0 inside, NaN without sides. A point inside has an odd number of sides to its right."""
    row, (x0, y0, x1, y1), _ = _flat_sides(polygons)
    px, py, dx, dy = x[row], y[row], x1 - x0, y1 - y0
    span = dx * dx + dy * dy
    t = np.clip(((px - x0) * dx + (py - y0) * dy) / np.where(span == 0, 1.0, span), 0.0, 1.0)
    t = np.where(span == 0, 0.0, t)
    out = np.full(len(x), np.inf)
    np.minimum.at(out, row, np.sqrt((px - (x0 + t * dx)) ** 2 + (py - (y0 + t * dy)) ** 2))
    right = ((y0 > py) != (y1 > py)) & (px < dx * (py - y0) / np.where(dy == 0, 1.0, dy) + x0)
    out[np.bincount(row[right], minlength=len(x)) % 2 == 1] = 0.0
    return np.where(np.isinf(out), np.nan, out)


def distance(rings: Column, x: Column, y: Column) -> Column:
    """From a point to a polygon; 0 inside, null without a polygon or a point."""

    @F.arrow_udf("double")
    def run(polygons: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(distances(polygons, x.to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False)), pa.float64(), from_pandas=True)

    # A condition on it is then checked after it, and not by working it out once more.
    return run.asNondeterministic()(rings, x.cast("double"), y.cast("double"))


def shared_area(p: Column, q: Column) -> Column:
    """Area that two polygons share, as in shared_areas; never below 0."""

    @F.arrow_udf("double")
    def shared(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array(np.maximum(shared_areas(left, right), 0.0), pa.float64())

    return shared(p, q)


def hull_of(points: np.ndarray) -> np.ndarray:
    """Convex hull of points, counter-clockwise and closed."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return np.concatenate([pts, pts[:1]])

    def half(seq: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    ring = half(pts) + half(pts[::-1])
    return np.array([*ring, ring[0]])


def thinned(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """A line or ring with the fewest of its points such that each dropped one lies within tolerance of what is left (Douglas and Peucker)."""
    keep = np.zeros(len(ring), bool)
    keep[[0, -1]] = True
    stack = [(0, len(ring) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        p, d = ring[a + 1 : b] - ring[a], ring[b] - ring[a]
        n = math.hypot(*d)
        off = np.abs(p[:, 0] * d[1] - p[:, 1] * d[0]) / n if n else np.hypot(p[:, 0], p[:, 1])
        k = int(off.argmax())
        if off[k] > tolerance:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return ring[keep]


def _rings(fn, ring: Column) -> Column:
    @F.arrow_udf(RING)
    def run(rings: pa.Array) -> pa.Array:
        return pa.array([None if r is None else [{"x": x, "y": y} for x, y in fn(_points(r)).tolist()] if r else [] for r in rings.to_pylist()], _RING)

    return run(ring)


def hull(points: Column) -> Column:
    """Convex hull of an array of (x, y) as a closed ring."""
    return _rings(hull_of, points)


def simplify(ring: Column, tolerance: float, places: int | None = None) -> Column:
    """A ring without points that stray no more than tolerance; coordinates rounded to so many places."""
    return _rings(lambda r: thinned(r, tolerance) if places is None else np.round(thinned(r, tolerance), places), ring)


def box_ring(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(corner(xmin, ymin), corner(xmax, ymin), corner(xmax, ymax), corner(xmin, ymax), corner(xmin, ymin))


def geodesic_area(rings: Column) -> Column:
    """Square metres of a polygon in degrees: its area on the equal-area grid."""
    return area(F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(geo.equal_area_x(p["x"]).alias("x"), geo.equal_area_y(p["y"]).alias("y")))))
