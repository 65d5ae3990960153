import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from heatlattice.functions import geo, union, validity
from heatlattice.operators import dissolve, overlay, trend, weights


def parts(cells):
    """Sets of squares that touch along a side."""
    cells, out = set(cells), []
    while cells:
        todo = [cells.pop()]
        found = set(todo)
        while todo:
            i, j = todo.pop()
            for q in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                if q in cells:
                    cells.remove(q)
                    found.add(q)
                    todo.append(q)
        out.append(found)
    return out


def raster(codes):
    """Polygons, holes and area of the union of cells of at most six letters, on a grid."""
    boxes = [union._box(c.lower()) for c in codes]
    dx, dy = min(b[2] - b[0] for b in boxes), min(b[3] - b[1] for b in boxes)
    x0, y0 = min(b[0] for b in boxes) // dx, min(b[1] for b in boxes) // dy
    filled = {(i - x0, j - y0) for w, s, e, n in boxes for i in range(w // dx, e // dx) for j in range(s // dy, n // dy)}
    field = {(i, j) for i in range(-1, max(i for i, _ in filled) + 2) for j in range(-1, max(j for _, j in filled) + 2)}
    found = parts(filled)
    return len(found), sum(len(parts(field - p)) - 1 for p in found), len(filled) * dx * dy * 360.0 / 2**30 * 180.0 / 2**30


def cell_sets():
    rng = random.Random(1)
    out = {"side": ["9q8yy", "9q8yz"], "corner": ["9q8yy", "9q8zp"], "hole": ["9q8y" + c for c in geo.BASE32 if c != "s"], "mixed": ["9q8y", "9q8yy", "9q8yyb", "9q8z"], "world": list(geo.BASE32)}
    for i in range(4):
        base = "9q8y"[: rng.choice([3, 4])]
        codes = [base + a + b for a in geo.BASE32 for b in geo.BASE32 if rng.random() < 0.55]
        out[f"random {i}"] = codes + [base + rng.choice(geo.BASE32) for _ in range(i)] + [c + rng.choice(geo.BASE32) for c in codes[:40]]
    return out


def shapes_of(text):
    """Polygons of a WKT as (shell, holes), each ring from its smallest point on."""
    out = set()
    for polygon in re.findall(r"\(\((?:[^()]|\)\s*,\s*\()*\)\)", text):
        rings = [[tuple(map(float, p.split())) for p in r.split(",")][:-1] for r in re.findall(r"\(([^()]+)\)", polygon)]
        turned = [tuple(r[r.index(min(r)) :] + r[: r.index(min(r))]) for r in rings]
        out.add((turned[0], frozenset(turned[1:])))
    return out


def test_unions_over_a_table(spark):
    sets = cell_sets()
    rows = [(g, c) for g, codes in sets.items() for c in codes]
    # A null group is a group; null codes and repeated ones do not count; a deep code beside a coarse one costs nothing.
    rows += [(None, "9q"), ("side", None), ("side", "9Q8YY"), ("only null", None), ("deep", "9"), ("deep", "9q8yyyyyyyyy"), ("deep", "drt000000000")]
    codes = spark.createDataFrame(rows, "grp string, ring string")
    figures = {r["grp"]: r for r in dissolve.union_figures(codes, "grp", "ring").collect()}
    assert figures.keys() == sets.keys() | {None, "deep"}
    for name, own in sets.items():
        polygons, holes, area = raster(own)
        assert (figures[name]["polygons"], figures[name]["rings"]) == (polygons, polygons + holes)
        assert figures[name]["area"] == pytest.approx(area)
    texts = {r["grp"]: r["geometry"] for r in dissolve.union_polygons(codes, "grp", "ring").collect()}
    for name, own in (*sets.items(), ("deep", ["9", "drt000000000"]), (None, ["9q"])):
        assert shapes_of(texts[name]) == shapes_of(union.geohashes_to_polygon(own))
    valid = spark.createDataFrame([(t,) for t in texts.values()], "t string").select(validity.invalid_reason(geo.wkt_polygons(F.col("t"))).alias("why"))
    assert not [r for r in valid.collect() if r["why"]]
    assert dissolve.union_figures(codes.limit(0), "grp", "ring").count() == 0
    with pytest.raises(Exception, match="not a geohash"):
        dissolve.union_figures(spark.createDataFrame([("a", "9q8yyyyyyyyyy")], "g string, c string"), "g", "c").collect()


def ring(*points):
    return np.array([*points, points[0]], float)


def square(x, y, w=1, h=1):
    return ring((x, y), (x + w, y), (x + w, y + h), (x, y + h))


CASES = {
    None: [[[square(0, 0)]], [[square(0, 0, 4, 4), square(1, 1)]], [[square(0, 0)], [square(1, 1)]], [[square(0, 0, 4, 4), ring((0, 2), (1, 1), (1, 3))]], [[square(0, 0, 9, 9), square(1, 1, 5, 5)], [square(2, 2, 3, 3)]], [[square(0, 0, 9, 9), square(1, 1), square(2, 2)]], []],
    "crossing": [[[ring((0, 0), (4, 4), (4, 0), (0, 2))]], [[square(0, 0, 4, 4), square(3, 3, 3, 3)]], [[square(0, 0, 2, 2)], [square(1, 1, 2, 2)]]],
    "overlapping sides": [[[square(0, 0)], [square(1, 0)]], [[square(0, 0, 4, 4), square(0, 1)]], [[ring((0, 0), (2, 0), (1, 0), (1, 1))]], [[square(0, 0)], [square(0, 0)]]],
    "ring touches itself": [[[ring((0, 0), (4, 0), (4, 4), (2, 0), (0, 4))]], [[ring((0, 0), (2, 2), (4, 0), (4, 4), (2, 2), (0, 4))]]],
    "interior is not connected": [[[square(0, 0, 4, 4), ring((0, 2), (2, 1), (4, 2), (2, 3))]], [[square(0, 0, 9, 9), ring((0, 3), (3, 2), (5, 3), (3, 4)), ring((5, 3), (7, 2), (9, 3), (7, 4))]]],
    "hole outside its shell": [[[square(0, 0), square(3, 3)]], [[square(1, 1), square(0, 0, 3, 3)]]],
    "nested holes": [[[square(0, 0, 9, 9), square(1, 1, 5, 5), square(2, 2)]]],
    "overlapping polygons": [[[square(0, 0, 9, 9)], [square(2, 2)]], [[square(2, 2)], [square(0, 0, 9, 9)]]],
    "not closed": [[[square(0, 0)[:-1]]]],
    "too few points": [[[square(0, 0)[:3]]], [[np.array([[0.0, 0], [0, 0], [1, 1], [0, 0]])]]],
    "not a number": [[[ring((0, 0), (float("nan"), 1), (1, 1))]]],
}


@pytest.mark.parametrize("reason", CASES)
def test_validity(reason):
    assert [validity.problem(shape) for shape in CASES[reason]] == [reason] * len(CASES[reason])


def simple(points):
    """Whether a closed ring is simple, by all pairs of sides in fractions."""
    r = [tuple(map(Fraction, p)) for p in points.tolist()]
    sign = lambda v: (v > 0) - (v < 0)
    turn = lambda p, q, s: sign((q[0] - p[0]) * (s[1] - p[1]) - (q[1] - p[1]) * (s[0] - p[0]))
    on = lambda p, a, b: turn(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])
    n = len(r) - 1
    for i in range(n):
        for j in range(i + 1, n):
            a, b, c, d = r[i], r[i + 1], r[j], r[j + 1]
            if turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0:
                return False
            shared = {p for p in (a, b) if on(p, c, d)} | {p for p in (c, d) if on(p, a, b)}
            if len(shared) > 1 or (shared and not (j == i + 1 or (i == 0 and j == n - 1))):
                return False
    return True


def test_simple_rings_against_all_pairs():
    rng, seen = np.random.default_rng(0), [0, 0]
    for k in range(400):
        n = int(rng.integers(4, 9))
        points = rng.integers(0, 6, (n, 2)).astype(float)
        if k % 2:
            angle = 2 * np.pi * np.sort(rng.random(n))
            points = np.round(np.stack([np.cos(angle), np.sin(angle)], 1) * rng.integers(3, 9, (n, 1)))
        points = points[np.append(True, (points[1:] != points[:-1]).any(axis=1))]
        if len(points) < 3 or (points[0] == points[-1]).all():
            continue
        closed = np.concatenate([points, points[:1]])
        ok = simple(closed)
        seen[ok] += 1
        assert (validity.problem([[closed]]) is None) == ok, closed.tolist()
    assert min(seen) > 50


def test_a_long_ring_is_tested_in_seconds():
    angle = np.linspace(0, 2 * np.pi, 60_001)
    radius = 1 + 0.1 * np.sin(angle * 3000)
    long = np.stack([radius * np.cos(angle), radius * np.sin(angle)], 1)
    long[-1] = long[0]
    assert validity.problem([[long]]) is None
    long[30_000] = [0.0, 2.0]
    assert validity.problem([[long]]) == "crossing"


def test_counted_trend(spark):
    rng = np.random.default_rng(3)
    series = [[], [1.0], [2.0, 2.0], [None, float("nan"), 3.0], None]
    for n in (3, 7, 50, 130):
        series += [rng.integers(0, 9, n).astype(float).tolist(), rng.random(n).tolist(), (np.round(rng.random(n) * 5) * 5e-11).tolist()]
    for x in series:
        x = np.array([v for v in x or [] if v is not None and v == v])
        if len(x):
            s = sum(0 if abs(b - a) <= 1e-10 else 1 if b > a else -1 for i, a in enumerate(x) for b in x[i + 1 :])
            t = [int((np.abs(x - v) < 1e-10).sum()) for v in set(x.tolist())]
            assert trend._counts(x) == (s, pytest.approx(sum(k * (k - 1) * (2 * k + 5) for k in t)), len(set(x.tolist())))
    df = spark.createDataFrame([(x,) for x in series], "x array<double>")
    for short, long in df.select(trend.mann_kendall(F.col("x")), trend.mann_kendall_long(F.col("x"))).where("x is not null").collect():
        assert tuple(long) == pytest.approx(tuple(short), abs=1e-9)


def test_vertices_within_a_distance(spark):
    rng = random.Random(6)
    within = 0.1
    points = [(rng.choice([0.0, 0.1, 0.2, 0.30000000000000004, -0.1, 5e5]) + rng.choice([0, 1e-17, 0.05, 0.1, 0.0999999]), rng.choice([0.0, 0.1, 1.0])) for _ in range(120)]
    want = {(*a, *b) for a in points for b in points if (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 <= within * within}
    got = weights.near_vertices(spark.createDataFrame([*points, (None, 1.0), points[0]], "vx double, vy double"), within)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    shapes = spark.createDataFrame([("a", "POINT (0 0)"), ("b", "POINT (0.05 0)"), ("c", "POINT (0.12 0)"), ("d", None)], "region string, geometry string")
    edges = {tuple(r) for r in weights.queen_edges_within(shapes, within).collect()}
    assert edges == {("a", "a"), ("b", "b"), ("c", "c"), ("d", "d"), ("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")}
    with pytest.raises(ValueError):
        weights.near_vertices(got, 0.0)
    with pytest.raises(Exception, match="too large"):
        weights.near_vertices(spark.createDataFrame([(1.0, 1.0)], "vx double, vy double"), 1e-20).collect()


@pytest.mark.parametrize("bits", [3, 18])
def test_sharded_draws_equal_those_of_the_vector(spark, monkeypatch, bits):
    from heatlattice.operators import permute
    from heatlattice.plans import ehsa

    monkeypatch.setattr(permute, "SHARD_BITS", bits)
    monkeypatch.setattr(permute, "PORTION", 300)
    rng = random.Random(bits)
    # Values whose sums depend on their order, cells that are missing, and neighbourhoods of many sizes.
    rows = [(f"r{i:02}", t, rng.random() * 10 ** rng.randint(-3, 3)) for i in range(14) for t in range(5) if rng.random() < 0.85]
    edges = {(f"r{i:02}", f"r{i:02}") for i in range(14)} | {(f"r{i:02}", f"r{j:02}") for i in range(14) for j in range(14) if rng.random() < 0.3}
    observations, near = spark.createDataFrame(rows, "region string, t int, x double"), spark.createDataFrame(sorted(edges), "region string, neighbor string")
    both = [sorted((r["region"], r["t"], r["upper"], r["lower"], r["p_sim"]) for r in ehsa.gi_star_spacetime(observations, near, 1, 19, 5, policy, backend).collect()) for policy in ("keyed", "positional") for backend in ("numpy", "sharded")]
    assert both[0] == both[1] and both[2] == both[3] and len(both[0]) == len(rows)
    assert ehsa.gi_star_spacetime(observations.limit(0), near, 1, 19, 5, "keyed", "sharded").count() == 0


def union_area(polygons):
    """The area that polygons (lists of rings) cover, by exact slabs between all ends and crossings of their sides."""
    per = [[(Fraction(a), Fraction(b), Fraction(c), Fraction(d)) for r in rings for (a, b), (c, d) in zip(r, r[1:] + r[:1], strict=True) if a != c] for rings in polygons]
    every = [s for own in per for s in own]
    xs = {x for a, _, c, _ in every for x in (a, c)} | {Fraction(a) for rings in polygons for r in rings for a, _ in r}
    for k, (a, b, c, d) in enumerate(every):
        for e, f, g, h in every[:k]:
            p, q = (d - b) / (c - a), (h - f) / (g - e)
            if p != q and max(min(a, c), min(e, g)) < (x := (f - q * e - b + p * a) / (p - q)) < min(max(a, c), max(e, g)):
                xs.add(x)
    xs, total = sorted(xs), Fraction(0)
    for lo, hi in zip(xs, xs[1:], strict=False):
        mid, spans = (lo + hi) / 2, []
        for own in per:
            ys = sorted(b + (d - b) * (mid - a) / (c - a) for a, b, c, d in own if min(a, c) < mid < max(a, c))
            spans += zip(ys[::2], ys[1::2], strict=True)
        end = None
        for low, high in sorted(spans):
            low = low if end is None else max(low, end)
            if high > low:
                total += (high - low) * (hi - lo)
                end = high
    return float(total)


def wkt(rings):
    return "POLYGON (" + ", ".join("(" + ", ".join(f"{x} {y}" for x, y in [*r, r[0]]) + ")" for r in rings) + ")"


def test_union_of_polygons(spark):
    rng = random.Random(3)
    sets = {
        "apart": [[[(0, 0), (1, 0), (1, 1), (0, 1)]], [[(3, 0), (4, 0), (4, 1), (3, 1)]]],
        "side": [[[(0, 0), (1, 0), (1, 1), (0, 1)]], [[(1, 0), (2, 0), (2, 1), (1, 1)]]],
        "corner": [[[(0, 0), (1, 0), (1, 1), (0, 1)]], [[(1, 1), (2, 1), (2, 2), (1, 2)]]],
        "inside": [[[(0, 0), (9, 0), (9, 9), (0, 9)]], [[(2, 2), (2, 3), (3, 3)]]],
        "cross": [[[(0, 4), (9, 4), (9, 5), (0, 5)]], [[(4, 0), (5, 0), (5, 9), (4, 9)]]],
        "frame": [[[(0, 0), (9, 0), (9, 1), (0, 1)]], [[(0, 8), (9, 8), (9, 9), (0, 9)]], [[(0, 0), (1, 0), (1, 9), (0, 9)]], [[(8, 0), (9, 0), (9, 9), (8, 9)]], [[(3, 3), (6, 3), (6, 6), (3, 6)], [(4, 4), (4, 5), (5, 5), (5, 4)]]],
        "pinched": [[[(0, 0), (6, 0), (6, 6), (0, 6)], [(1, 1), (1, 3), (3, 3), (3, 1)], [(3, 3), (3, 5), (5, 5), (5, 3)]]],
        "pinched shell": [[[(0, 0), (6, 0), (6, 6), (0, 6)], [(2, 0), (1, 2), (3, 2)]]],
        "filled": [[[(0, 0), (6, 0), (6, 6), (0, 6)], [(1, 1), (1, 3), (3, 3), (3, 1)]], [[(1, 1), (3, 1), (3, 3), (1, 3)]]],
    }
    for i in range(3):
        sets[f"random {i}"] = [[[(rng.randint(0, 40) / 4 + dx, rng.randint(0, 40) / 4 + dy) for dx, dy in ((0, 0), (rng.randint(1, 9) / 3, 0.25), (0.5, rng.randint(1, 9) / 3))]] for _ in range(25)]
        sets[f"random {i}"] += [[[(0, i), (11, 5 + i / 7), (11, 5.1)]]]
    rows = [(g, wkt(p)) for g, ps in sets.items() for p in ps]
    rows += [rows[0], ("apart", None), ("apart", "POLYGON EMPTY"), ("apart", "POINT (0 0)"), ("apart", "LINESTRING (0 0, 5 5, 5 0)"), ("apart", "POLYGON ((7 7, 8 8, 7 7))"), ("nothing", None), (None, rows[0][1])]
    frame = spark.createDataFrame(rows, "grp string, ring string")
    got = {r["grp"]: r for r in overlay.union_figures(frame, "grp", "ring").collect()}
    assert got.keys() == sets.keys() | {None}
    for g, polygons in sets.items():
        assert got[g]["area"] == pytest.approx(union_area(polygons), abs=1e-4), g
    shape = {"apart": (2, 2), "side": (1, 1), "corner": (2, 2), "inside": (1, 1), "cross": (1, 1), "frame": (2, 4), "pinched": (1, 3), "pinched shell": (1, 2), "filled": (1, 1), None: (1, 1)}
    assert {g: (got[g]["polygons"], got[g]["rings"]) for g in shape} == shape
    texts = overlay.union_polygons(frame, "grp", "ring")
    checked = texts.select("grp", "geometry", validity.invalid_reason(geo.wkt_polygons(F.col("geometry"))).alias("why")).collect()
    assert not [r for r in checked if r["why"]]
    assert shapes_of(next(r["geometry"] for r in checked if r["grp"] == "inside")) == {(((0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0)), frozenset())}
    assert overlay.union_figures(frame.limit(0), "grp", "ring").count() == 0
    for text, why in (("POLYGON ((0 0, 1e9 0, 1 1))", "too large"), ("POLYGON ((0 0, x 0, 1 1))", "not a WKT")):
        with pytest.raises(Exception, match=why):
            overlay.sides(spark.createDataFrame([("a", text)], "g string, p string"), "g", "p").collect()
