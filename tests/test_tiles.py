import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from heatlattice.sources import export, tiles

SCHEMA = "region string, classification string, tau double, p_value double, geometry string"


def frame(spark, shapes, label=lambda k: "new hotspot"):
    return spark.createDataFrame([(str(k), label(k), 0.5, 0.01, g) for k, g in enumerate(shapes)], SCHEMA)


def wkt(ring):
    return "POLYGON ((" + ", ".join(f"{x!r} {y!r}" for x, y in [*ring, ring[0]]) + "))"


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)) / 2


def mesh(n, seed):
    """n x n crooked cells whose sides have a corner in between that both neighbours have."""
    rng = random.Random(seed)
    jitter = lambda i, j: (i + rng.uniform(-0.2, 0.2) if 0 < i < n else float(i), j + rng.uniform(-0.2, 0.2) if 0 < j < n else float(j))
    at = {(i, j): jitter(i, j) for i in range(n + 1) for j in range(n + 1)}
    mid = lambda a, b: tuple((p + q) / 2 + 0.03 * (a[0] + b[0] - a[1]) % 0.05 if 0 < a[0] < n and 0 < b[1] < n else (p + q) / 2 for p, q in zip(at[a], at[b], strict=True))
    middles = {}
    for a in at:
        for b in ((a[0] + 1, a[1]), (a[0], a[1] + 1)):
            if b in at:
                middles[a, b] = middles[b, a] = mid(a, b)
    out = []
    for i in range(n):
        for j in range(n):
            corners = [(i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1)]
            out.append([p for a, b in zip(corners, [*corners[1:], corners[0]], strict=True) for p in (at[a], middles[a, b])])
    return out


def test_outline_drops_only_what_the_shape_does_not_need(spark):
    rings = {
        "repeats": [(0, 0), (0, 0), (4, 0), (4, 0), (4, 4), (0, 4), (0, 0)],
        "line": [(0, 0), (1, 0), (2, 0), (4, 0), (4, 2), (4, 4), (0, 4), (0, 0)],
        "point": [(3, 3), (3, 3), (3, 3)],
        "none": [],
    }
    rows = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in r]) for k, r in rings.items()], "k string, r array<struct<x:bigint,y:bigint>>")
    got = {r.k: [(p.x, p.y) for p in r.o] for r in rows.select("k", tiles.outline(F.col("r")).alias("o")).collect()}
    square = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
    assert got == {"repeats": square, "line": square, "point": [(3, 3)], "none": []}


def test_neighbours_share_their_outlines(spark, tmp_path):
    n = 20
    cells = mesh(n, 3)
    figures = tiles.write_tiles(frame(spark, map(wkt, cells)), str(tmp_path / "t"))
    assert (figures["regions"], figures["placeless"], figures["levels"]) == (n * n, 0, 1)
    rows = tiles.read_tiles(spark, str(tmp_path / "t")).collect()
    over = {r.r: r.g for r in rows if r.level == 0 and r.kind == "over"}
    assert set(over) == {str(k) for k in range(n * n)} and all(r.kind == "own" for r in rows if r.level == 1)
    # Every side of an outline but the map's border is another outline's, turned: neither gaps nor overlaps.
    corners = {(x, y) for g in over.values() for x, y in g[0]}
    sides = {}
    for g in over.values():
        ring = [tuple(p) for p in g[0]]
        assert len(g) == 1 and ring[0] == ring[-1] and area(ring[:-1]) > 0
        for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
            cut = sorted((abs(x - ax) + abs(y - ay), (x, y)) for x, y in corners if (x - ax) * (by - ay) == (y - ay) * (bx - ax) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by))
            for (_, p), (_, q) in zip(cut, cut[1:], strict=False):
                sides[p, q] = sides.get((p, q), 0) + 1
    border = {(p, q) for p, q in sides if (q, p) not in sides}
    assert all(m == 1 for m in sides.values()) and all(p[0] == q[0] in (0, 1024) or p[1] == q[1] in (0, 1024) for p, q in border)
    assert sum(area([tuple(p) for p in g[0][:-1]]) for g in over.values()) == 1024 * 1024
    # At home shapes are whole: to one step of the grid, in each tile that they touch.
    for r in rows:
        if r.level == 1:
            want = cells[int(r.r)]
            got = [((x + (r.x << 27)) / 2**28 * n, (y + (r.y << 27)) / 2**28 * n) for x, y in r.g[0][:-1]]
            assert all(min(abs(a - x) + abs(b - y) for a, b in want) < 1e-6 for x, y in got)


def test_small_regions_are_dots_with_their_number(spark, tmp_path):
    rng = random.Random(5)
    points = [(rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(3000)] + [(0.0, 0.0), (100.0, 100.0)]
    label = lambda k: ("new hotspot", "new coldspot", None)[k % 3]
    figures = tiles.write_tiles(frame(spark, (f"POINT ({x!r} {y!r})" for x, y in points), label), str(tmp_path / "t"))
    assert figures["levels"] == 2
    rows = tiles.read_tiles(spark, str(tmp_path / "t")).collect()
    for level in (0, 1):
        want = {}
        for k, (x, y) in enumerate(points):
            cell = tuple(min(int(v / 100 * 64 * 2**level), 64 * 2**level - 1) for v in (x, y))
            want[*cell, label(k) or "no pattern detected"] = want.get((*cell, label(k) or "no pattern detected"), 0) + 1
        assert {(r.x * 64 + r.d[0], r.y * 64 + r.d[1], r.l): r.n for r in rows if r.level == level} == want
    assert sorted(int(r.r) for r in rows if r.kind == "own") == list(range(3002)) and {r.level for r in rows if r.kind == "own"} == {2}


def test_a_hot_place_is_dealt_to_files(spark, tmp_path):
    rows = spark.range(2000).selectExpr("0 level", "0 x", "0 y", "'own' kind", "xxhash64(id) key", "concat('{\"r\":\"', id, '\"}') text").unionByName(spark.sql("select 1 level, 0 x, 1 y, 'over' kind, 1L key, '{\"n\":3}' text"))
    files = {r.name: r.body for r in tiles.files(rows, 1000).collect()}
    made = [json.loads(re.fullmatch(r"(?s)tile\((.*)\);\n", b)[1]) for b in files.values()]
    hot = [m for m in made if m["name"].startswith("0/0/0.own.")]
    assert len(hot) > 20 and {m["parts"] for m in hot} == {max(m["parts"] for m in hot)} and max(len(m["rows"]) for m in hot) < 200
    assert sorted(int(r["r"]) for m in hot for r in m["rows"]) == list(range(2000))
    assert "0/0/0.own.0" in files and json.loads(files["1/0/1.over.0"][5:-3]) == {"name": "1/0/1.over.0", "parts": 1, "rows": [{"n": 3}]}
    # The first part is there even where no row falls to it.
    lone = tiles.files(spark.sql("select 0 level, 0 x, 0 y, 'own' kind, 1L key, repeat('x', 25) text"), 10).collect()
    assert {r.name: r.body.count("x") for r in lone} == {"0/0/0.own.0": 0, "0/0/0.own.1": 25}


def test_defined_cases(spark, tmp_path):
    square = "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0), (0.5 0.5, 1 0.5, 1 1, 0.5 1, 0.5 0.5))"
    df = frame(spark, [None, square, square, "MULTIPOLYGON (((3 0, 4 0, 4 1, 3 0)), ((3 3, 4 3, 4 4, 3 3)))", "POLYGON EMPTY", "POINT (1 1)"]).unionByName(frame(spark, [None, square]).where("region = 1"))
    figures = tiles.write_tiles(df.withColumn("r", F.lit("clash")).withColumn("level", F.lit(7)), str(tmp_path / "t"))
    assert (figures["regions"], figures["placeless"], figures["levels"], figures["span"]) == (5, 2, 0, 4.0)
    rows = tiles.read_tiles(spark, str(tmp_path / "t"))
    got = sorted((r.r, [len(ring) for ring in r.g]) for r in rows.collect())
    assert got == [("1", [5, 5]), ("1", [5, 5]), ("2", [5, 5]), ("3", [4, 4]), ("5", [1])]
    for name, empty in (("none", df.limit(0)), ("placeless", df.where("geometry is null"))):
        figures = tiles.write_tiles(empty, str(tmp_path / name))
        assert (figures["regions"], figures["files"], figures["levels"]) == (0, 0, 0)


def test_saved_maps_of_many_regions_have_tiles(spark, tmp_path):
    df = frame(spark, map(wkt, mesh(3, 1)), lambda k: "</script><b>" if k == 4 else "new hotspot")
    page = open(export.save_visualization(str(tmp_path / "m.html"), df, most=5)).read()
    about = json.loads(re.search(r"const about=(\{.*?\}),colours", page)[1])
    assert about["regions"] == 9 and about["folder"] == "m.tiles" and about["grid"] == tiles.GRID
    assert os.path.exists(tmp_path / "m.tiles" / "0" / "0" / "0.own.0.js") and not [f for _, _, names in os.walk(tmp_path) for f in names if f.endswith(".part")]
    assert sorted(int(r.r) for r in tiles.read_tiles(spark, str(tmp_path / "m.tiles")).collect()) == list(range(9))
    assert "folder" not in open(export.save_visualization(str(tmp_path / "n.html"), df)).read()
    assert tiles.page("</title><script>", about, "</script>").count("</script>") == 1
    with pytest.raises(ValueError, match="html"):
        tiles.write_tiled_map(df, str(tmp_path / "m.txt"))
