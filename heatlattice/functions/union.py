"""The union of geohash cells as one (multi)polygon."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import BASE32

#: Cells of twelve letters on either axis.
GRID = 1 << 30


def cell_box(code: str) -> tuple[float, float, float, float]:
    """(west, south, east, north) of a geohash cell."""
    low, size, axis = [-180.0, -90.0], [360.0, 180.0], 0
    if not code:
        raise ValueError("an empty geohash")
    for letter in code.lower():
        number = BASE32.find(letter)
        if number < 0:
            raise ValueError(f"not a geohash: {code}")
        for bit in (16, 8, 4, 2, 1):
            size[axis] /= 2
            if number & bit:
                low[axis] += size[axis]
            axis = 1 - axis
    return low[0], low[1], low[0] + size[0], low[1] + size[1]


def geohash_to_polygon(code: str) -> str:
    """A cell as POLYGON, counter-clockwise from its south-west corner."""
    w, s, e, n = cell_box(code)
    return _wkt([[[(w, s), (e, s), (e, n), (w, n), (w, s)]]])


def _wkt(polygons: list[list[list[tuple[float, float]]]]) -> str:
    ring = lambda r: "(" + ", ".join(f"{x!r} {y!r}" for x, y in r) + ")"
    bodies = ["(" + ", ".join(map(ring, rings)) + ")" for rings in polygons]
    if not bodies:
        return "POLYGON EMPTY"
    return f"POLYGON {bodies[0]}" if len(bodies) == 1 else f"MULTIPOLYGON ({', '.join(bodies)})"


def _box(code: str) -> tuple[int, int, int, int]:
    """(west, south, east, north) in units of a twelve-letter cell."""
    w, s, e, n = cell_box(code)
    return tuple(round((v + shift) / span * GRID) for v, shift, span in ((w, 180.0, 360.0), (s, 90.0, 180.0), (e, 180.0, 360.0), (n, 90.0, 180.0)))


def _border(boxes: list[tuple[int, int, int, int, int]]) -> dict[tuple[int, int], dict[int, tuple[int, int]]]:
    """Where border edges lead, by start and direction (0 east, then counter-clockwise), filled on their left; boxes
    (w, s, e, n, k) fill where k is 1 and only mark their corners where it is 0."""
    turns: dict[tuple[bool, int], dict[int, list[int]]] = defaultdict(lambda: defaultdict(lambda: [0, 0]))
    for w, s, e, n, k in boxes:
        for upright, line, low, high, side in ((True, e, s, n, 0), (True, w, s, n, 1), (False, n, w, e, 0), (False, s, w, e, 1)):
            turns[upright, line][low][side] += k
            turns[upright, line][high][side] -= k
    onward: dict[tuple[int, int], dict[int, tuple[int, int]]] = defaultdict(dict)
    for (upright, line), at in turns.items():
        before = behind = 0
        marks = sorted(at)
        for low, high in zip(marks, marks[1:], strict=False):
            before, behind = before + at[low][0], behind + at[low][1]
            if before != behind:
                a, b = (low, high) if (before > 0) == upright else (high, low)
                way = (1 if before > 0 else 3) if upright else (2 if before > 0 else 0)
                start, end = ((line, a), (line, b)) if upright else ((a, line), (b, line))
                onward[start][way] = end
    return onward


def _cycles(onward, turned: set[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Rings of points: on to the left where there is a choice, to the right at the points in turned."""
    left, out = {(p, d) for p, ways in onward.items() for d in ways}, []
    for p, d in sorted(left, key=lambda v: (v[0][1], v[0][0], v[1])):
        ring = []
        while (p, d) in left:
            left.remove((p, d))
            ring.append(p)
            p, ways = onward[p][d], onward[onward[p][d]]
            d = next(iter(ways)) if len(ways) == 1 else (d + (3 if p in turned else 1)) % 4
        if ring:
            out.append(ring)
    return out


def geohashes_to_polygon(codes: Iterable[str | None]) -> str:
    """The union of cells of up to twelve letters as WKT: POLYGON, MULTIPOLYGON, or POLYGON EMPTY for no cell. Corners of
    cells on the border stay vertices, so neighbours still share them; no ring passes a point twice. For the cells of
    whole tables, see `operators.dissolve`."""
    cells = {c.lower() for c in codes if c is not None}
    onward = _border([(*_box(c), int(not any(c[:k] in cells for k in range(1, len(c))))) for c in sorted(cells)])
    if not onward:
        return _wkt([])
    counts = [Counter(ring) for ring in _cycles(onward, set())]
    rings = _cycles(onward, {p for c in counts for p, n in c.items() if n > 1})
    area = [sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, [*r[1:], r[0]], strict=True)) for r in rings]
    walls = [(a[0], b[1], a[1], k) for k, r in enumerate(rings) for a, b in zip(r, [*r[1:], r[0]], strict=True) if a[0] == b[0] and b[1] < a[1]]
    held = {k: [r] for k, r in enumerate(rings) if area[k] > 0}
    for k, ring in enumerate(rings):
        # The first border west of a hole is that of its polygon, or of another of its holes.
        at = k
        while area[at] < 0:
            x, y = min(rings[at], key=lambda p: (p[1], p[0]))
            at = max((wx, j) for wx, low, high, j in walls if wx < x and low <= y < high)[1]
        if at != k:
            held[at].append(ring)
    real = lambda r: [(x * 360.0 / GRID - 180.0, y * 180.0 / GRID - 90.0) for x, y in [*r, r[0]]]
    return _wkt([list(map(real, rings)) for rings in held.values()])


def union_wkt(codes: Column) -> Column:
    """The union of each row's array of codes; null for a null array."""
    each = lambda c: None if c is None else geohashes_to_polygon(c)
    return F.pandas_udf(lambda rows: rows.map(each), "string")(codes)
