"""What polygons of one cell have to do with each other, over Arrow batches that are sorted by cell."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gridwise.functions import polygon

#: Pairs of boxes or of sides that are looked at together, and rows of whole cells that are.
AT_ONCE, ROWS = 1 << 19, 8_000
#: So many polygons of a cell are linked by all their pairs.
FEW = 64
EDGES = ("xmin", "ymin", "xmax", "ymax")


class Sides:
    """All sides of an Arrow array of polygons, with where each polygon's begin, how many there are, and its first corner."""

    def __init__(self, rings: pa.Array) -> None:
        row, self.ends, _ = polygon._flat_sides(rings)
        self.n = np.bincount(row, minlength=len(rings))
        self.first = np.cumsum(self.n) - self.n
        self.low, self.high = (f(self.ends[:2], self.ends[2:]) for f in (np.minimum, np.maximum))
        corner = pc.list_element(pc.list_element(rings, 0), 0) if len(rings) else pa.array([], polygon._RING.value_type)
        self.corner = np.stack([pc.struct_field(corner, c).to_numpy(zero_copy_only=False).astype(float) for c in "xy"])

    def part(self, lo: int, hi: int) -> Sides:
        """The polygons from lo to hi; sides stay where they are."""
        out = Sides.__new__(Sides)
        out.__dict__.update(self.__dict__, n=self.n[lo:hi], first=self.first[lo:hi], corner=self.corner[:, lo:hi])
        return out

    def of(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in i, side) for all sides of each of the polygons i."""
        at = np.repeat(np.arange(len(i)), self.n[i])
        return at, _runs(self.first[i], self.n[i])


def _runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... so many numbers from each."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first, n)


def _chunks(work: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches (from, to) with AT_ONCE of work each, or one row."""
    upto, first = np.cumsum(work), 0
    while first < len(work):
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + AT_ONCE, "right")))
        yield first, last
        first = last


def holds(p: Sides, i: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether each of the polygons i holds its point, as polygon.contains."""
    out = np.zeros(len(i), bool)
    for lo, hi in _chunks(p.n[i]):
        at, s = p.of(i[lo:hi])
        x0, y0, x1, y1 = p.ends[:, s]
        px, py = x[lo:hi][at], y[lo:hi][at]
        dy = y1 - y0
        hit = ((y0 > py) != (y1 > py)) & (px < (x1 - x0) * (py - y0) / np.where(dy == 0, 1.0, dy) + x0)
        out[lo:hi] = np.bincount(at[hit], minlength=hi - lo) % 2 == 1
    return out


def _side_pairs(p: Sides, i: np.ndarray, q: Sides, j: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place in i and j, ends of a side of i, ends of a side of j), of those whose boxes are no farther apart than reach."""
    for lo, hi in _chunks(p.n[i] * q.n[j]):
        a, b, m = i[lo:hi], j[lo:hi], q.n[j[lo:hi]]
        n = p.n[a] * m
        at, k = np.repeat(np.arange(lo, hi), n), _runs(np.zeros(len(n), int), n)
        own = k // np.maximum(m, 1)[at - lo]
        s, t = p.first[a][at - lo] + own, q.first[b][at - lo] + k - own * m[at - lo]
        for c in (0, 1):
            near = (p.low[c, s] - reach <= q.high[c, t]) & (q.low[c, t] - reach <= p.high[c, s])
            at, s, t = at[near], s[near], t[near]
        yield at, p.ends[:, s], q.ends[:, t]


def _turn(a: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (a[2] - a[0]) * (y - a[1]) - (a[3] - a[1]) * (x - a[0])


def _touch(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sides share a point, whose boxes do; as polygon.segments_touch."""
    return (_turn(a, b[0], b[1]) * _turn(a, b[2], b[3]) <= 0) & (_turn(b, a[0], a[1]) * _turn(b, a[2], a[3]) <= 0)


def touching(p: Sides, i: np.ndarray, q: Sides, j: np.ndarray) -> np.ndarray:
    """Whether each two of the polygons i and j share a point, as polygon.intersect."""
    out = holds(p, i, *q.corner[:, j])
    rest = np.flatnonzero(~out)
    out[rest] = holds(q, j[rest], *p.corner[:, i[rest]])
    rest = rest[~out[rest]]
    for at, a, b in _side_pairs(p, i[rest], q, j[rest], 0.0):
        out[rest[at[_touch(a, b)]]] = True
    return out


def _to_side(x: np.ndarray, y: np.ndarray, s: np.ndarray) -> np.ndarray:
    dx, dy = s[2] - s[0], s[3] - s[1]
    span = dx * dx + dy * dy
    t = np.where(span == 0, 0.0, np.clip(((x - s[0]) * dx + (y - s[1]) * dy) / np.where(span == 0, 1.0, span), 0.0, 1.0))
    px, py = x - (s[0] + t * dx), y - (s[1] + t * dy)
    return np.sqrt(px * px + py * py)


def apart(p: Sides, i: np.ndarray, q: Sides, j: np.ndarray, reach: float) -> np.ndarray:
    """Distance of each two of the polygons i and j where that is no more than reach, else infinite; 0 if they share a point."""
    out = np.where(touching(p, i, q, j), 0.0, np.inf)
    rest = np.flatnonzero(out > 0)
    for at, a, b in _side_pairs(p, i[rest], q, j[rest], reach):
        if len(at):
            d = np.minimum(np.minimum(_to_side(a[0], a[1], b), _to_side(a[2], a[3], b)), np.minimum(_to_side(b[0], b[1], a), _to_side(b[2], b[3], a)))
            head = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            out[rest[at[head]]] = np.minimum.reduceat(d, head)
    return np.where(out <= reach, out, np.inf)


def any_hit(test: Callable[[np.ndarray, np.ndarray], np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Those of i (sorted) for which the test of some pair (i, j) is true. Few pairs of each are looked at first, and more only without a hit."""
    found, most = [], 2
    while len(i):
        own, first = np.unique(i, return_index=True)
        place = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
        now = place < most
        hit = np.unique(i[now][test(i[now], j[now])])
        found.append(hit)
        left = ~now & ~np.isin(i, hit)
        i, j, most = i[left], j[left], most * 4
    return np.concatenate(found) if found else np.zeros(0, int)


def whole(batches: Iterable[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, number of the cell) of some whole cells at a time, from rows sorted by key."""

    def starts(t: pa.Table) -> np.ndarray:
        k = [t[c].to_numpy() for c in key]
        return np.logical_or.reduce([np.append(True, c[1:] != c[:-1]) for c in k])

    held: list[pa.RecordBatch] = []
    for b in batches:
        held += [b] if b.num_rows else []
        if sum(h.num_rows for h in held) < ROWS:
            continue
        t = pa.Table.from_batches(held)
        new = starts(t)
        last = int(np.flatnonzero(new)[-1])
        if last:
            yield t.slice(0, last).combine_chunks(), np.cumsum(new[:last])
        held = t.slice(last).to_batches()
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, np.cumsum(starts(t))


class Met:
    """Own and other rows of some whole cells (cx, cy, part, block, own, left_id, right_id, xmin, ymin, xmax, ymax, rings)."""

    def __init__(self, t: pa.Table, cell: np.ndarray, size: float, margin: float) -> None:
        own = t["own"].to_numpy()
        self.size, self.margin = size, margin
        self.left, self.right = (t.filter(pa.array(m)).combine_chunks() for m in (own, ~own))
        self.cell, other = cell[own], cell[~own]
        self.first = np.searchsorted(other, self.cell)
        self.n = np.searchsorted(other, self.cell, "right") - self.first
        box = lambda s: np.stack([s[c].to_numpy() for c in EDGES])
        self.a, self.b = box(self.left), box(self.right)
        self.a += np.array([[-margin], [-margin], [margin], [margin]])
        self.at = np.stack([self.left[c].to_numpy() for c in ("cx", "cy")]) if self.left.num_rows else np.zeros((2, 0))

    def rings(self, side: str) -> pa.Array:
        rings = getattr(self, side)["rings"]
        return rings.combine_chunks() if rings.num_chunks != 1 else rings.chunk(0)

    def sides(self) -> tuple[Sides, Sides]:
        return Sides(self.rings("left")), Sides(self.rings("right"))

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs whose boxes meet, in the one cell that holds the lower corner of what these share; sorted by the own row."""
        for lo, hi in _chunks(self.n):
            n = self.n[lo:hi]
            i, j = np.repeat(np.arange(lo, hi), n), _runs(self.first[lo:hi], n)
            for c in (0, 1):
                low = np.maximum(self.a[c, i], self.b[c, j])
                met = (low <= self.b[c + 2, j]) & (low <= self.a[c + 2, i]) & (np.floor(low / self.size) == self.at[c, i])
                i, j = i[met], j[met]
            yield i, j

    def ids(self, i: np.ndarray, j: np.ndarray | None = None) -> list[pa.Array]:
        take = lambda t, c, k: t[c].combine_chunks().take(pa.array(k))
        return [take(self.left, "left_id", i), *([] if j is None else [take(self.right, "right_id", j)])]


def _met(batches: Iterable[pa.RecordBatch], size: float, margin: float) -> Iterator[Met]:
    for t, cell in whole(batches, ("cx", "cy", "part", "block")):
        m = Met(t, cell, size, margin)
        if m.left.num_rows and m.right.num_rows:
            yield m


def _batch(columns: list, names: list[str]) -> pa.RecordBatch:
    plain = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    return pa.RecordBatch.from_arrays(plain, names)


def crossing_pairs(batches: Iterable[pa.RecordBatch], size: float) -> Iterator[pa.RecordBatch]:
    """(left_id, right_id) of polygons that share a point."""
    for m in _met(batches, size, 0.0):
        p, q = m.sides()
        for i, j in m.pairs():
            hit = touching(p, i, q, j)
            yield _batch(m.ids(i[hit], j[hit]), ["left_id", "right_id"])


def crossing_ids(batches: Iterable[pa.RecordBatch], size: float) -> Iterator[pa.RecordBatch]:
    """(left_id) of polygons that share a point with any other one here."""
    for m in _met(batches, size, 0.0):
        p, q = m.sides()
        for i, j in m.pairs():
            yield _batch(m.ids(any_hit(lambda a, b: touching(p, a, q, b), i, j)), ["left_id"])  # noqa: B023


def distant_pairs(batches: Iterable[pa.RecordBatch], size: float, reach: float) -> Iterator[pa.RecordBatch]:
    """(left_id, right_id, dist) of polygons no farther apart than reach."""
    for m in _met(batches, size, reach):
        p, q = m.sides()
        for i, j in m.pairs():
            d = apart(p, i, q, j, reach)
            hit = np.isfinite(d)
            yield _batch([*m.ids(i[hit], j[hit]), pa.array(d[hit])], ["left_id", "right_id", "dist"])


def sharing_pairs(batches: Iterable[pa.RecordBatch], size: float) -> Iterator[pa.RecordBatch]:
    """(left_id, right_id, overlap) of polygons that share area."""
    for m in _met(batches, size, 0.0):
        left, right = m.rings("left"), m.rings("right")
        for i, j in m.pairs():
            area = polygon.shared_areas(left.take(pa.array(i)), right.take(pa.array(j)))
            hit = area > 0
            yield _batch([*m.ids(i[hit], j[hit]), pa.array(area[hit])], ["left_id", "right_id", "overlap"])


def pairs_with_rings(batches: Iterable[pa.RecordBatch], size: float, margin: float) -> Iterator[pa.RecordBatch]:
    """(left_id, right_id, left_rings, right_rings) of polygons whose boxes are no farther apart than margin."""
    for m in _met(batches, size, margin):
        left, right = m.rings("left"), m.rings("right")
        for i, j in m.pairs():
            for lo in range(0, len(i), ROWS):
                a, b = i[lo : lo + ROWS], j[lo : lo + ROWS]
                yield _batch([*m.ids(a, b), left.take(pa.array(a)), right.take(pa.array(b))], ["left_id", "right_id", "left_rings", "right_rings"])


def near_ids(batches: Iterable[pa.RecordBatch], size: float, reach: float) -> Iterator[pa.RecordBatch]:
    """(left_id) of polygons that have one of the others here, which are points (rings null), within reach."""
    for m in _met(batches, size, reach):
        p, rings = Sides(m.rings("left")), m.rings("left")

        def test(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            at = m.b[:2, b]  # noqa: B023
            out = holds(p, a, *at)  # noqa: B023
            rest = np.flatnonzero(~out)
            # A polygon without sides has no distance.
            out[rest] = polygon.distances(rings.take(pa.array(a[rest])), *at[:, rest]) <= reach  # noqa: B023
            return out

        for i, j in m.pairs():
            yield _batch(m.ids(any_hit(test, i, j)), ["left_id"])


def held_pairs(batches: Iterable[pa.RecordBatch], size: float) -> Iterator[pa.RecordBatch]:
    """(left_id, right_id) of polygons and the points (rings null) that they hold."""
    for m in _met(batches, size, 0.0):
        p = Sides(m.rings("left"))
        for i, j in m.pairs():
            hit = holds(p, i, *m.b[:2, j])
            yield _batch(m.ids(i[hit], j[hit]), ["left_id", "right_id"])


def held_counts(batches: Iterable[pa.RecordBatch], size: float) -> Iterator[pa.RecordBatch]:
    """(left_id, n, first) of polygons: how many points of a cell they hold, and the smallest id of these."""
    for b in held_pairs(batches, size):
        n = pa.Table.from_batches([b]).group_by("left_id").aggregate([("right_id", "count"), ("right_id", "min")]).combine_chunks()
        yield _batch([n["left_id"], n["right_id_count"], n["right_id_min"]], ["left_id", "n", "first"])


def open_sides(batches: Iterable[pa.RecordBatch], fine: float, many: int, beside: float) -> Iterator[pa.RecordBatch]:
    """(group, part, k, x0, y0, x1, y1, cx, cy) from polygons (name, cx, cy, block, group, part, rings), sorted by the first four: sides beside each small cell that they touch and that no polygon of the group covers wholly.

    A cell is many small ones of length fine wide. A small cell is covered if no side comes nearer than beside and its
    middle is inside.
    """
    for t, cell in whole(batches, ("name", "cx", "cy", "block")):
        p = Sides(t["rings"].combine_chunks() if t["rings"].num_chunks != 1 else t["rings"].chunk(0))
        row = np.repeat(np.arange(t.num_rows), p.n)
        wx, wy = (t[c].to_numpy() * many for c in ("cx", "cy"))
        (x0, y0, x1, y1), (xl, yl), (xh, yh) = p.ends, p.low, p.high
        at = lambda s, y: x0[s] + (x1[s] - x0[s]) * ((y - y0[s]) / np.where(y1[s] == y0[s], 1.0, y1[s] - y0[s]))  # noqa: B023, E731
        lo, hi = np.maximum(np.floor((yl - beside) / fine), wy[row]), np.minimum(np.floor((yh + beside) / fine), wy[row] + many - 1)
        n = np.where((x0 != x1) | (y0 != y1), np.maximum(hi - lo + 1, 0), 0).astype(int)
        side, cy = np.repeat(np.arange(len(row)), n), _runs(lo.astype(int), n)
        ends = np.stack([at(side, np.clip(y, yl[side], yh[side])) for y in (cy * fine - beside, (cy + 1) * fine + beside)])
        flat = y0[side] == y1[side]
        a, b = np.where(flat, xl[side], ends.min(0)) - beside, np.where(flat, xh[side], ends.max(0)) + beside
        inside = lambda c, r: np.clip(c, wx[r] - 1, wx[r] + many)  # noqa: B023, E731
        a, b = np.maximum(inside(np.floor(a / fine), row[side]), wx[row[side]]).astype(int), np.minimum(inside(np.floor(b / fine), row[side]), wx[row[side]] + many - 1).astype(int)
        m = np.maximum(b - a + 1, 0)
        s, x, y = np.repeat(side, m), _runs(a, m), np.repeat(cy, m)
        local = lambda r, x, y: (y - wy[r]) * many + x - wx[r]  # noqa: B023, E731
        touched = np.zeros(t.num_rows * many * many, bool)
        touched[row[s] * (many * many) + local(row[s], x, y)] = True
        # From each odd crossing of a row's middle line to the next one.
        mid = (cy + 0.5) * fine
        over = (y0[side] > mid) != (y1[side] > mid)
        r, v, u = row[side[over]], cy[over], at(side[over], mid[over])
        order = np.lexsort((u, v, r))
        r, v, u = r[order], v[order], u[order]
        head = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (v[1:] != v[:-1])))[: len(r)]
        size = np.diff(np.append(head, len(r)))
        place, even = np.arange(len(r)) - np.repeat(head, size), np.repeat(size % 2 == 0, size)
        start = np.flatnonzero((place % 2 == 0) & even)
        r, v = r[start], v[start]
        a, b = np.maximum(inside(np.ceil(u[start] / fine - 0.5), r), wx[r]).astype(int), np.minimum(inside(np.floor(u[start + 1] / fine - 0.5), r), wx[r] + many - 1).astype(int)
        m = np.maximum(b - a + 1, 0)
        r, v, u = np.repeat(r, m), np.repeat(v, m), _runs(a, m)
        full = ~touched[r * (many * many) + local(r, u, v)]
        g = cell - 1
        covered = np.zeros((int(g[-1]) + 1) * many * many, bool)
        covered[g[r[full]] * (many * many) + local(r[full], u[full], v[full])] = True
        kept = ~covered[g[row[s]] * (many * many) + local(row[s], x, y)]
        s, x, y = s[kept], x[kept], y[kept]
        take = pa.array(row[s])
        yield _batch([t["group"].take(take), t["part"].take(take), pa.array((s - p.first[row[s]]).astype("int32")), *(pa.array(e[s]) for e in p.ends), pa.array(x), pa.array(y)], ["group", "part", "k", "x0", "y0", "x1", "y1", "cx", "cy"])


def _links(p: Sides, box: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between polygons of one cell that join all that share points there, also through others; at most one for each polygon.

    From a polygon on, those that it touches are taken out and followed in turn, so where many lie on each other, most are
    gone after few steps.
    """
    todo = np.arange(box.shape[1])
    while len(todo):
        root, line, todo = todo[0], todo[:1], todo[1:]
        while len(line) and len(todo):
            n = max(1, min(len(line), AT_ONCE // len(todo)))
            now, line = line[:n], line[n:]
            meet = np.logical_and.reduce([(box[c][todo][:, None] <= box[c + 2][now]) & (box[c][now] <= box[c + 2][todo][:, None]) for c in (0, 1)])
            k, m = np.nonzero(meet)
            hit = any_hit(lambda a, b: touching(p, todo[a], p, now[b]), k, m)  # noqa: B023
            if len(hit):
                new = todo[hit]
                yield np.full(len(new), root), new
                line, todo = np.append(line, new), np.delete(todo, hit)


def linked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) from polygons (cx, cy, part, id, xmin, ymin, xmax, ymax, rings), sorted by the first three: links that join the polygons of a cell that share points."""
    for t, cell in whole(batches, ("cx", "cy", "part")):
        p, ids = Sides(t["rings"].combine_chunks() if t["rings"].num_chunks != 1 else t["rings"].chunk(0)), t["id"].combine_chunks()
        box = np.stack([t[c].to_numpy() for c in EDGES])
        first = np.searchsorted(cell, np.unique(cell))
        n = np.diff(np.append(first, len(cell)))
        few = n <= FEW
        # Each row of a small cell with those after it.
        after = np.where(np.repeat(few, n), np.repeat(first + n, n) - np.arange(len(cell)) - 1, 0)
        for lo, hi in _chunks(after):
            i, j = np.repeat(np.arange(lo, hi), after[lo:hi]), _runs(np.arange(lo, hi) + 1, after[lo:hi])
            for c in (0, 1):
                met = (box[c, i] <= box[c + 2, j]) & (box[c, j] <= box[c + 2, i])
                i, j = i[met], j[met]
            hit = touching(p, i, p, j)
            yield _batch([ids.take(pa.array(i[hit])), ids.take(pa.array(j[hit]))], ["a", "b"])
        for lo, m in zip(first[~few], n[~few], strict=True):
            own = p.part(lo, lo + m)
            for a, b in _links(own, box[:, lo : lo + m]):
                yield _batch([ids.take(pa.array(lo + a)), ids.take(pa.array(lo + b))], ["a", "b"])


def _codes(*columns: np.ndarray) -> np.ndarray:
    """A number for each row, equal for equal rows."""
    order = np.lexsort(columns)
    new = np.logical_or.reduce([np.append(True, c[order][1:] != c[order][:-1]) for c in columns])[: len(order)]
    out = np.empty(len(order), int)
    out[order] = np.cumsum(new) - 1
    return out


def _cut(p: Sides, i: np.ndarray, q: Sides, j: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, whether of j, (x0, y0, x1, y1)): sides of each two of the polygons i and j in pieces, ended wherever the other's sides cross or touch them; as overlay.cut."""
    (ra, s), (rb, t) = p.of(i), q.of(j)
    ends = np.concatenate([p.ends[:, s], q.ends[:, t]], axis=1)
    # Number of a polygon's first side among all of these.
    fa, fb = np.cumsum(p.n[i]) - p.n[i], np.cumsum(q.n[j]) - q.n[j] + len(s)
    keys, xs, ys = [np.arange(ends.shape[1])] * 2, [ends[0], ends[2]], [ends[1], ends[3]]
    for lo, hi in _chunks(p.n[i] * q.n[j]):
        n, m = p.n[i[lo:hi]] * q.n[j[lo:hi]], q.n[j[lo:hi]]
        at, k = np.repeat(np.arange(lo, hi), n), _runs(np.zeros(len(n), int), n)
        u, v = fa[at] + k // m[at - lo], fb[at] + k % m[at - lo]
        a, b = ends[:, u], ends[:, v]
        near = np.logical_and.reduce([(np.minimum(a[c], a[c + 2]) <= np.maximum(b[c], b[c + 2])) & (np.minimum(b[c], b[c + 2]) <= np.maximum(a[c], a[c + 2])) for c in (0, 1)])
        u, v, a, b = u[near], v[near], a[:, near], b[:, near]
        tip = np.zeros(len(u), bool)
        for own, x, y in ((u, b[0], b[1]), (u, b[2], b[3]), (v, a[0], a[1]), (v, a[2], a[3])):
            on = _to_side(x, y, a if own is u else b) <= 10.0**-places / 2
            keys, xs, ys, tip = [*keys, own[on]], [*xs, x[on]], [*ys, y[on]], tip | on
        rx, ry, sx, sy, dx, dy = a[2] - a[0], a[3] - a[1], b[2] - b[0], b[3] - b[1], b[0] - a[0], b[1] - a[1]
        turn = rx * sy - ry * sx
        safe = np.where(turn == 0, 1.0, turn)
        f, g = (dx * sy - dy * sx) / safe, (dx * ry - dy * rx) / safe
        cross = ~tip & (turn != 0) & (f > 0) & (f < 1) & (g > 0) & (g < 1)
        x, y = np.round((a[0] + f * rx)[cross], places), np.round((a[1] + f * ry)[cross], places)
        keys, xs, ys = [*keys, u[cross], v[cross]], [*xs, x, x], [*ys, y, y]
    key, x, y = np.concatenate(keys), np.concatenate(xs), np.concatenate(ys)
    along = (x - ends[0, key]) * (ends[2] - ends[0])[key] + (y - ends[1, key]) * (ends[3] - ends[1])[key]
    order = np.lexsort((y, x, along, key))
    key, x, y = key[order], x[order], y[order]
    piece = (key[1:] == key[:-1]) & ((x[1:] != x[:-1]) | (y[1:] != y[:-1]))
    own = key[:-1][piece]
    return np.concatenate([ra, rb])[own], own >= len(s), np.stack([x[:-1], y[:-1], x[1:], y[1:]])[:, piece]


def _rings_of(pair: np.ndarray, e: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pair of each ring, twice its signed area, its number of corners, all corners (x, y)) of directed pieces with the inside on their left; as overlay.rings."""
    # In the order of pairs, so rings are too.
    one = np.unique(_codes(*e, pair), return_index=True)[1]
    pair, e = pair[one], e[:, one]
    n = len(pair)
    point = _codes(np.tile(pair, 2), np.append(e[0], e[2]), np.append(e[1], e[3]))
    start, end = point[:n], point[n:]
    order = np.argsort(start, kind="stable")
    first, last = (np.searchsorted(start[order], end, side) for side in ("left", "right"))
    own, then = np.repeat(np.arange(n), last - first), order[_runs(first, last - first)]
    sweep = np.mod(np.arctan2(e[1] - e[3], e[0] - e[2])[own] - np.arctan2(e[3] - e[1], e[2] - e[0])[then], 2 * np.pi)
    sweep = np.where((sweep < 1e-9) | (sweep > 2 * np.pi - 1e-9), 2 * np.pi, sweep)
    best = np.lexsort((sweep, own))
    best = best[np.append(True, own[best][1:] != own[best][:-1])[: len(best)]]
    # The last place stands for an open end; each step knows the least among the next 2**k and how far that is.
    way = np.full(n + 1, n)
    way[own[best]] = then[best]
    least, off, step = np.arange(n + 1), np.zeros(n + 1, int), 1
    least[n] = n + 1
    while step < 2 * n:
        nearer = least[way] < least
        least, off, way, step = np.where(nearer, least[way], least), np.where(nearer, off[way] + step, off), way[way], step * 2
        if step > 64 and (least[way] >= least).all():
            break
    closed = np.flatnonzero(way[:n] != n)
    count = np.bincount(least[closed], minlength=n)
    order = closed[np.lexsort(((count[least[closed]] - off[closed]) % np.maximum(count[least[closed]], 1), least[closed]))]
    ring = least[order]
    for final in (False, True):
        head = np.flatnonzero(np.append(True, ring[1:] != ring[:-1]))[: len(ring)]
        m = np.diff(np.append(head, len(ring)))
        after, before = np.arange(1, len(ring) + 1), np.arange(-1, len(ring) - 1)
        after[head + m - 1], before[head] = head, head + m - 1
        x, y = e[0, order], e[1, order]
        if final:
            turned = np.add.reduceat(x * y[after] - x[after] * y, head) if len(head) else np.zeros(0)
            return pair[order[head]], turned, m, np.stack([x, y])
        bend = np.abs((x - x[before]) * (y[after] - y) - (y - y[before]) * (x[after] - x)) > 10.0**-places * (np.abs(x[after] - x[before]) + np.abs(y[after] - y[before]))
        left = np.add.reduceat(bend, head, dtype=int) if len(head) else np.zeros(0, int)
        kept = bend & np.repeat(left >= 3, m)
        order, ring = order[kept], ring[kept]


def _inside_of(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """A point inside a ring: as polygon.interior_point."""
    at = y.min() + (y.max() - y.min()) * 0.5000123
    u, v = np.append(x[1:], x[0]), np.append(y[1:], y[0])
    over = (y > at) != (v > at)
    xs = np.sort(x[over] + (u[over] - x[over]) * (at - y[over]) / (v[over] - y[over]))
    k = int(np.argmax(xs[1::2] - xs[::2]))
    return (xs[2 * k] + xs[2 * k + 1]) / 2, at


def _polygons(n: int, pair: np.ndarray, turned: np.ndarray, m: np.ndarray, xy: np.ndarray) -> pa.Array:
    """For each of n pairs its polygons, of rings in the pairs' order: each hole with the smallest outer ring around it."""
    first = np.cumsum(m) - m
    outer = np.flatnonzero(turned > 0)
    lo, hi = np.searchsorted(pair[outer], pair), np.searchsorted(pair[outer], pair, "right")
    home = np.where(turned > 0, np.arange(len(pair)), -1)
    single = (turned < 0) & (hi - lo == 1)
    home[single] = outer[lo[single]]
    corners = lambda r: xy[:, first[r] : first[r] + m[r]]
    for h in np.flatnonzero((turned < 0) & (hi - lo > 1)):
        px, py = _inside_of(*corners(h))
        for o in outer[lo[h] : hi[h]][np.argsort(turned[outer[lo[h] : hi[h]]], kind="stable")]:
            x, y = corners(o)
            u, v = np.append(x[1:], x[0]), np.append(y[1:], y[0])
            over = (y > py) != (v > py)
            if (px < x[over] + (u[over] - x[over]) * (py - y[over]) / (v[over] - y[over])).sum() % 2:
                home[h] = o
                break
    order = np.flatnonzero(home >= 0)
    order = order[np.lexsort((order, turned[order] < 0, home[order]))]
    # A ring ends where it begins.
    at = _runs(first[order], m[order] + 1)
    at[np.cumsum(m[order] + 1) - 1] = first[order]
    points = pa.StructArray.from_arrays([pa.array(xy[0, at]), pa.array(xy[1, at])], ["x", "y"])
    ends = lambda sizes: pa.array(np.append(0, np.cumsum(sizes)).astype("int32"))
    rings = pa.ListArray.from_arrays(ends(m[order] + 1), points)
    made = pa.ListArray.from_arrays(ends(np.bincount(home[order], minlength=len(pair))[outer] if len(pair) else []), rings)
    return pa.ListArray.from_arrays(ends(np.bincount(pair[outer], minlength=n)), made)


def overlaid_pairs(batches: Iterable[pa.RecordBatch], size: float, places: int, beside: float) -> Iterator[pa.RecordBatch]:
    """(left_id, right_id, shared, rest) of polygons whose boxes meet and that share area: what they share and what is left of the left one, as arrays of polygons. Rings have the inside on their left."""
    for m in _met(batches, size, 0.0):
        p, q = m.sides()
        for first, second in m.pairs():
            for lo in range(0, len(first), ROWS):
                i, j = first[lo : lo + ROWS], second[lo : lo + ROWS]
                pair, other, e = _cut(p, i, q, j, places)
                long = np.hypot(e[2] - e[0], e[3] - e[1])
                at = lambda k, way: ((e[0, k] + e[2, k]) / 2 - way * beside * (e[3, k] - e[1, k]) / long[k], (e[1, k] + e[3, k]) / 2 + way * beside * (e[2, k] - e[0, k]) / long[k])  # noqa: B023, E731
                a, b = np.flatnonzero(~other), np.flatnonzero(other)
                in_a, in_b, out_b = holds(q, j[pair[a]], *at(a, 1)), holds(p, i[pair[b]], *at(b, 1)), holds(p, i[pair[b]], *at(b, -1))
                k = np.append(a[in_a], b[in_b])
                shared = _rings_of(pair[k], e[:, k], places)
                k, back = a[~in_a], b[out_b]
                rest = _rings_of(np.append(pair[k], pair[back]), np.concatenate([e[:, k], e[[2, 3, 0, 1]][:, back]], axis=1), places)
                made = [_polygons(len(i), *r) for r in (shared, rest)]
                hit = np.flatnonzero(pc.list_value_length(made[0]).to_numpy() > 0)
                yield _batch([*m.ids(i[hit], j[hit]), *(c.take(pa.array(hit)) for c in made)], ["left_id", "right_id", "shared", "rest"])
