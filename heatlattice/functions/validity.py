"""Whether polygons are valid: simple closed rings, holes inside their shell and beside each other, connected interiors.

Shapes are tested many at a time. In those of few sides all pairs are compared; the sides of others are cut into pieces no
longer than twice the mean side and dealt to a grid of that width, so only sides that come close are compared; work grows
with the sides and the pairs that come close. Turns are taken in floating point with an
error bound and, where that leaves a doubt, in exact fractions.
"""

from __future__ import annotations

from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sides of a shape whose pairs are all compared, and pairs of a portion of shapes.
FEW, PORTION = 48, 1 << 18


def turn(p: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Sign of the turn from p over q to r, exact; rows of (x, y)."""
    a, b = (q[:, 0] - p[:, 0]) * (r[:, 1] - p[:, 1]), (q[:, 1] - p[:, 1]) * (r[:, 0] - p[:, 0])
    out = np.sign(a - b)
    equal = (r == p).all(axis=1) | (r == q).all(axis=1) | (p == q).all(axis=1)
    out[equal] = 0
    # Differences are zero only where coordinates are equal; a product with one is zero, and the sign is the other's.
    level = (q == p) | (r == p)[:, ::-1]
    for i in np.flatnonzero((np.abs(a - b) <= 1e-15 * (np.abs(a) + np.abs(b))) & ~equal & ~level.all(axis=1)):
        (px, py), (qx, qy), (rx, ry) = ([Fraction(float(v)) for v in z[i]] for z in (p, q, r))
        exact = (qx - px) * (ry - py) - (qy - py) * (rx - px)
        out[i] = (exact > 0) - (exact < 0)
    return out


def close_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of segments from a to b (rows of x, y) that share a cell of the grid and whose boxes meet."""
    size = np.hypot(*(b - a).T)
    width = max(2 * float(size.mean()), 1e-300)
    parts = np.maximum(1, np.ceil(size / width)).astype(np.int64)
    of = np.repeat(np.arange(len(a)), parts)
    k = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    at = lambda t: a[of] + (b - a)[of] * (t / parts[of])[:, None]
    p, q = at(k), at(k + 1)
    base, pad = np.minimum(a, b).min(axis=0), 1e-9 * width + 4 * np.spacing(np.abs(np.concatenate([a, b])).max())
    low, high = (np.floor((f(p, q) + s * pad - base) / width).astype(np.int64) for f, s in ((np.minimum, -1), (np.maximum, 1)))
    cells, owner = [], []
    for dx in range(int((high - low)[:, 0].max()) + 1):
        for dy in range(int((high - low)[:, 1].max()) + 1):
            on = (low[:, 0] + dx <= high[:, 0]) & (low[:, 1] + dy <= high[:, 1])
            cells.append(np.stack([low[on, 0] + dx, low[on, 1] + dy], 1))
            owner.append(of[on])
    cells, owner = np.concatenate(cells), np.concatenate(owner)
    order = np.lexsort((owner, cells[:, 1], cells[:, 0]))
    cells, owner = cells[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], (cells[1:] != cells[:-1]).any(axis=1)]))
    ends = np.repeat(np.append(first[1:], len(owner)), np.diff(np.append(first, len(owner))))
    more = ends - np.arange(len(owner)) - 1
    left, right = [], []
    # A bounded number of pairs at a time.
    upto = np.cumsum(more)
    start = 0
    while start < len(owner):
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + (1 << 20), "right")))
        m = more[start:stop]
        i = np.repeat(np.arange(start, stop), m)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m)
        u, v = np.minimum(owner[i], owner[j]), np.maximum(owner[i], owner[j])
        on = (u != v) & (np.minimum(a, b)[u] <= np.maximum(a, b)[v]).all(axis=1) & (np.minimum(a, b)[v] <= np.maximum(a, b)[u]).all(axis=1)
        left.append(u[on])
        right.append(v[on])
        start = stop
    pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _inside(ring: np.ndarray, p: np.ndarray) -> int:
    """1 inside, 0 on the border, -1 outside; ring closed."""
    a, b = ring[:-1], ring[1:]
    row = np.broadcast_to(p, a.shape)
    side = turn(a, b, row)
    if ((side == 0) & (np.minimum(a, b) <= p).all(axis=1) & (p <= np.maximum(a, b)).all(axis=1)).any():
        return 0
    up, down = (a[:, 1] <= p[1]) & (b[:, 1] > p[1]), (a[:, 1] > p[1]) & (b[:, 1] <= p[1])
    return 1 if int((up & (side > 0)).sum()) != int((down & (side < 0)).sum()) else -1


def _place(inner: np.ndarray, outer: np.ndarray) -> int:
    """Where the first point of inner that is not on outer's border lies; rings do not cross. 0: all of them are on it."""
    for p in inner[:-1]:
        where = _inside(outer, p)
        if where:
            return where
    return 0


def pairs_within(a: np.ndarray, b: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of segments of one shape whose boxes may meet; shapes follow each other and have so many sides."""
    start = np.cumsum(sides) - sides
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in np.unique(sides[sides <= FEW]).tolist():
        i, j = np.triu_indices(n, 1)
        at = start[sides == n][:, None]
        left.append((at + i).ravel())
        right.append((at + j).ravel())
    for k in np.flatnonzero(sides > FEW):
        u, v = close_pairs(a[start[k] : start[k] + sides[k]], b[start[k] : start[k] + sides[k]])
        left.append(start[k] + u)
        right.append(start[k] + v)
    u, v = np.concatenate(left), np.concatenate(right)
    low, high = np.minimum(a, b), np.maximum(a, b)
    on = (low[u] <= high[v]).all(axis=1) & (low[v] <= high[u]).all(axis=1)
    return u[on], v[on]


def _rings(polygons: list[list[np.ndarray]]) -> str | list[tuple[int, int, np.ndarray]]:
    """The rings (polygon, place in it, points without repetition), or what is wrong with one of them."""
    out = []
    for k, polygon in enumerate(polygons):
        for h, ring in enumerate(polygon):
            if len(ring) < 4 or not np.isfinite(ring).all():
                return "too few points" if np.isfinite(ring).all() else "not a number"
            if (ring[0] != ring[-1]).any():
                return "not closed"
            moved = (ring[1:] != ring[:-1]).any(axis=1)
            kept = ring if moved.all() else ring[np.append(True, moved)]
            if len(kept) < 4:
                return "too few points"
            out.append((k, h, kept))
    return out


def problems(shapes: list[list[list[np.ndarray]] | None]) -> list[str | None]:
    """What makes each of the shapes invalid, or None; a shape is a list of polygons, these are lists of rings, the shell
    first, and rings are rows of x, y."""
    out: list[str | None] = [None] * len(shapes)
    portion: list[tuple[int, list[tuple[int, int, np.ndarray]]]] = []
    pairs = 0
    for i, polygons in enumerate(shapes):
        rings = _rings(polygons) if polygons else []
        if isinstance(rings, str):
            out[i] = rings
        elif rings:
            portion.append((i, rings))
            pairs += min(FEW, sum(len(r) for _, _, r in rings)) ** 2 // 2
        if portion and (pairs > PORTION or i == len(shapes) - 1):
            for (k, _), reason in zip(portion, _tested([r for _, r in portion]), strict=True):
                out[k] = reason
            portion, pairs = [], 0
    if portion:
        for (k, _), reason in zip(portion, _tested([r for _, r in portion]), strict=True):
            out[k] = reason
    return out


def problem(polygons: list[list[np.ndarray]]) -> str | None:
    return problems([polygons])[0]


def _tested(shapes: list[list[tuple[int, int, np.ndarray]]]) -> list[str | None]:
    """What makes each shape of closed rings invalid, or None."""
    rings = [r for shape in shapes for _, _, r in shape]
    a, b = np.concatenate([r[:-1] for r in rings]), np.concatenate([r[1:] for r in rings])
    n = np.array([len(r) - 1 for r in rings])
    ring = np.repeat(np.arange(len(rings)), n)
    first = np.cumsum(n) - n
    own = np.repeat(np.arange(len(shapes)), [len(shape) for shape in shapes])  # the shape of each ring
    u, v = pairs_within(a, b, np.bincount(own, n, len(shapes)).astype(np.int64))
    s = np.stack([turn(a[u], b[u], a[v]), turn(a[u], b[u], b[v]), turn(a[v], b[v], a[u]), turn(a[v], b[v], b[u])])
    out: list[str | None] = [None] * len(shapes)

    def mark(pairs: np.ndarray, reason: str) -> None:
        for k in np.unique(own[ring[u[pairs]]]).tolist():
            out[k] = out[k] or reason

    mark((s[0] * s[1] < 0) & (s[2] * s[3] < 0), "crossing")
    # What is left touches in an end point, or lies on one line.
    within = lambda p, k: (np.minimum(a[k], b[k]) <= p).all(axis=1) & (p <= np.maximum(a[k], b[k])).all(axis=1)
    hits = [(s[0] == 0) & within(a[v], u), (s[1] == 0) & within(b[v], u), (s[2] == 0) & within(a[u], v), (s[3] == 0) & within(b[u], v)]
    spots = [a[v], b[v], a[u], b[u]]
    touch = np.any(hits, axis=0)
    line = np.flatnonzero((s == 0).all(axis=0) & touch)
    if len(line):
        ends = np.stack([np.where(h[line, None], p[line], np.nan) for h, p in zip(hits, spots, strict=True)])
        low, high = (f(ends, axis=0) for f in (np.nanmin, np.nanmax))
        mark(line[(low < high).any(axis=1)], "overlapping sides")  # more than one point is shared
    same = ring[u] == ring[v]
    next_to = same & ((v - u == 1) | ((u == first[ring[u]]) & (v == (first + n - 1)[ring[u]])))
    mark(touch & same & ~next_to, "ring touches itself")
    # Points in which rings of a shape touch each other.
    meet: dict[int, list] = defaultdict(list)
    for h, p in zip(hits, spots, strict=True):
        for i in np.flatnonzero(h & ~same).tolist():
            meet[int(own[ring[u[i]]])].append((int(ring[u[i]]), int(ring[v[i]]), tuple(p[i].tolist())))
    before = 0
    for k, shape in enumerate(shapes):
        if out[k] is None and len(shape) > 1:
            out[k] = _nested(shape, [(i - before, j - before, p) for i, j, p in meet[k]])
        before += len(shape)
    return out


def _nested(shape: list[tuple[int, int, np.ndarray]], touching: list[tuple[int, int, tuple]]) -> str | None:
    """What is wrong with how the rings of a shape lie to each other; they may touch in the given points alone."""
    shells, rings = [(k, h) for k, h, _ in shape], [r for _, _, r in shape]
    # Rings may touch in points; a ring of touching rings cuts the interior in two.
    meet = defaultdict(set)
    for i, j, p in touching:
        if shells[i][0] == shells[j][0]:
            meet[shells[i][0], p].update((i, j))
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for (k, point), met in meet.items():
        for r in met:
            one, other = root((k, point)), root((k, (r,)))
            if one == other:
                return "interior is not connected"
            parent[one] = other
    at = {shell: i for i, shell in enumerate(shells)}
    boxes = [(r.min(axis=0), r.max(axis=0)) for r in rings]
    over = lambda i, j: (boxes[i][0] <= boxes[j][1]).all() and (boxes[j][0] <= boxes[i][1]).all()
    holes = defaultdict(list)
    for (k, h), i in at.items():
        if h:
            if _place(rings[i], rings[at[k, 0]]) != 1:
                return "hole outside its shell"
            if any(over(i, j) and 1 in (_place(rings[i], rings[j]), _place(rings[j], rings[i])) for j in holes[k]):
                return "nested holes"
            holes[k].append(i)
    done: list[int] = []
    for k in sorted({k for k, _ in shells}):
        i = at[k, 0]
        for j in done:
            if over(i, j):
                for one, other in ((i, j), (j, i)):
                    if _place(rings[one], rings[other]) >= 0 and not any(_place(rings[one], rings[h]) >= 0 for h in holes[shells[other][0]]):
                        return "overlapping polygons"
        done.append(i)
    return None


def _rows(shapes: pa.Array):
    """Lists of lists of rings of an array<array<array<struct<x, y>>>>; None for null."""
    for row in shapes:
        if not row.is_valid:
            yield None
            continue
        polygons = []
        for polygon in row.values or []:
            rings = []
            for ring in polygon.values if polygon.is_valid else []:
                v = ring.values
                rings.append(np.stack([v.field("x").to_numpy(zero_copy_only=False), v.field("y").to_numpy(zero_copy_only=False)], 1) if v is not None and len(v) else np.zeros((0, 2)))
            polygons.append(rings)
        yield polygons


def invalid_reason(polygons: Column) -> Column:
    """Why polygons (as of `geo.wkt_polygons`) are not valid; null for valid ones, for no polygon at all, and for null."""

    def reasons(shapes: pa.Array) -> pa.Array:
        return pa.array(problems(list(_rows(shapes))), pa.string())

    return F.arrow_udf(reasons, "string")(polygons)
