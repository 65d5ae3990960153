"""The union of geohash cells by group, as rows: edges, rings and polygons of any number of cells and mix of precisions.

Cells are boxes on the integer grid of twelve-letter codes, so all is exact. A cell below another one of its group covers
nothing (a join with its prefixes finds that); its corners still count as vertices. What is left overlaps nowhere, so on
each grid line running sums tell where one side alone is filled: the border. A long line is summed in stretches whose
totals are summed first. Border edges have the filled side on their left, and each knows the next one, as a turn to the
left is taken where two corners meet. Rings are found by pointer jumping: in each round every edge looks twice as far
ahead, until all know the smallest edge of their ring, and then how far away its end is. A ring that passes a point twice
is cut into two there. Holes look west: the first border they meet is that of their polygon or of another of its holes;
the meeting is a running last value over the dyadic stretches of each column of rows.

Defined cases: null codes are left out, a group of nothing else has no row; upper case counts as lower; what is no
geohash of one to twelve letters raises; repeated codes count once; a null group is a group; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import BASE32
from ..storage import discard, staged

BITS = 30
#: Grid steps of a stretch of a line, as a power of two.
STRETCH = 18
EAST, NORTH, WEST, SOUTH = range(4)


def grid_box(code: Column) -> Column:
    """struct<w, s, e, n> of a geohash of up to twelve letters, in units of the finest cell."""
    letters = F.split(F.lower(code), "")
    bit = lambda d, k: F.shiftright(d, k).bitwiseAND(F.lit(1))
    three = lambda d: bit(d, 4) * 4 + bit(d, 2) * 2 + bit(d, 0)
    two = lambda d: bit(d, 3) * 2 + bit(d, 1)

    def add(a, letter):
        d = F.instr(F.lit(BASE32), letter) - 1
        x = F.when(a["even"], a["x"] * 8 + three(d)).otherwise(a["x"] * 4 + two(d))
        y = F.when(a["even"], a["y"] * 4 + two(d)).otherwise(a["y"] * 8 + three(d))
        return F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), (~a["even"]).alias("even"))

    n = F.length(code) * 5
    dx, dy = F.pow(F.lit(2.0), BITS - F.ceil(n / 2)).cast("long"), F.pow(F.lit(2.0), BITS - F.floor(n / 2)).cast("long")
    zero = F.lit(0).cast("long")
    box = F.aggregate(letters, F.struct(zero.alias("x"), zero.alias("y"), F.lit(True).alias("even")), add, lambda a: F.struct((a["x"] * dx).alias("w"), (a["y"] * dy).alias("s"), ((a["x"] + 1) * dx).alias("e"), ((a["y"] + 1) * dy).alias("n")))
    return F.when(code.isNull(), None).when(code.rlike(f"(?i)^[{BASE32}]{{1,12}}$"), box).otherwise(F.raise_error(F.concat(F.lit("not a geohash of one to twelve letters: "), code)))


def degrees(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a grid point; exact."""
    return x * F.lit(360.0 / 2**BITS) - 180.0, y * F.lit(180.0 / 2**BITS) - 90.0


def topmost_cells(codes: DataFrame, group: str, code: str) -> DataFrame:
    """(grp, code, covered): the distinct cells, and whether another cell of the group has all of it."""
    cells = codes.where(F.col(code).isNotNull()).select(F.col(group).alias("grp"), F.lower(code).alias("code")).distinct()
    above = cells.where(F.length("code") > 1).select("grp", "code", F.explode(F.transform(F.sequence(F.lit(1), F.length("code") - 1), lambda k: F.substring("code", F.lit(1), k))).alias("up"))
    holders = cells.select(F.col("grp").alias("g"), F.col("code").alias("up"))
    below = above.join(holders, F.col("grp").eqNullSafe(F.col("g")) & (above["up"] == holders["up"]), "left_semi").select(F.col("grp").alias("g"), F.col("code").alias("c")).distinct()
    return cells.join(below, F.col("grp").eqNullSafe(F.col("g")) & (F.col("code") == F.col("c")), "left").select("grp", "code", F.col("c").isNotNull().alias("covered"))


def border(cells: DataFrame) -> DataFrame:
    """(grp, x1, y1, x2, y2, dir): the edges of the union of cells (grp, code, covered), filled on their left."""
    box = grid_box(F.col("code"))
    boxes = cells.select("grp", F.when(F.col("covered"), 0).otherwise(1).alias("k"), box.alias("b")).select("grp", "k", "b.*")
    k, none = F.col("k"), F.lit(0)
    # Along each line, what begins (k) and ends (-k) before it (west of it, or south) and behind it.
    event = lambda upright, line, at, before, behind: F.struct(F.lit(upright).alias("upright"), F.col(line).alias("line"), F.col(at).alias("at"), before.alias("before"), behind.alias("behind"))
    events = [e for line, ends, upright, b, a in (("e", "sn", True, k, none), ("w", "sn", True, none, k), ("n", "we", False, k, none), ("s", "we", False, none, k)) for e in (event(upright, line, ends[0], b, a), event(upright, line, ends[1], -b, -a))]
    turns = boxes.select("grp", F.explode(F.array(*events)).alias("v")).select("grp", "v.*")
    turns = turns.groupBy("grp", "upright", "line", "at").agg(F.sum("before").alias("before"), F.sum("behind").alias("behind")).withColumn("stretch", F.shiftright("at", STRETCH))
    turns = staged(turns, "turns")
    line = ["grp", "upright", "line"]
    along = Window.partitionBy(*line).orderBy("stretch")
    past = along.rowsBetween(Window.unboundedPreceding, -1)
    totals = turns.groupBy(*line, "stretch").agg(F.sum("before").alias("b"), F.sum("behind").alias("a"), F.min("at").alias("first"))
    totals = totals.select(*(F.col(c).alias("_" + c) for c in (*line, "stretch")), F.coalesce(F.sum("b").over(past), none).alias("b0"), F.coalesce(F.sum("a").over(past), none).alias("a0"), F.lead("first").over(along).alias("beyond"))
    same = F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("upright") == F.col("_upright")) & (F.col("line") == F.col("_line")) & (F.col("stretch") == F.col("_stretch"))
    here = Window.partitionBy(*line, "stretch").orderBy("at")
    sums = turns.join(totals, same).select(
        *line, "at", F.coalesce(F.lead("at").over(here), "beyond").alias("to"), (F.col("b0") + F.sum("before").over(here)).alias("before"), (F.col("a0") + F.sum("behind").over(here)).alias("behind")
    )
    sides = sums.where("to is not null and before <> behind").withColumn("left", F.col("before") > 0)
    up, left = F.col("upright"), F.col("left")
    pick = lambda a, b, c, d: F.when(up & left, a).when(up, b).when(left, c).otherwise(d)
    ln, at, to = F.col("line"), F.col("at"), F.col("to")
    return sides.select("grp", pick(ln, ln, to, at).alias("x1"), pick(at, to, ln, ln).alias("y1"), pick(ln, ln, at, to).alias("x2"), pick(to, at, ln, ln).alias("y2"), pick(*map(F.lit, (NORTH, SOUTH, WEST, EAST))).alias("dir"))


def _number(x: Column, y: Column, direction: Column) -> Column:
    """An edge by its start and direction; in order of y, then x."""
    return (y - (1 << BITS)) * (1 << 33) + x * 4 + direction


def _jump(state: DataFrame, other: list[Column], here: list[Column]) -> DataFrame:
    """state (grp, id, to, ...) with each edge's `other` columns read from the edge it points to."""
    on = state.select(F.col("grp").alias("g"), F.col("id").alias("i"), *other)
    return state.join(on, F.col("grp").eqNullSafe(F.col("g")) & (F.col("to") == F.col("i")), "left").select("grp", "id", *here)


def _labels(links: DataFrame) -> DataFrame:
    """(grp, id, ring): for links (grp, id, next) that form cycles, the smallest id of each edge's cycle."""
    state = staged(links.select("grp", "id", F.col("next").alias("to"), F.least("id", "next").alias("ring")), "labels")
    while True:
        moved = _jump(state, [F.col("to").alias("further"), F.col("ring").alias("its")], [F.col("further").alias("to"), F.least("ring", "its").alias("ring"), (F.col("its") < F.col("ring")).alias("moved")])
        before, state = state, staged(moved, "labels")
        discard(before)
        if not state.where("moved").limit(1).count():
            return state.select("grp", "id", "ring")


def _places(links: DataFrame) -> DataFrame:
    """(grp, id, left): for links (grp, id, next, ring), how many edges follow up to the end of the ring, which starts at edge `ring`."""
    to = F.when(F.col("next") != F.col("ring"), F.col("next"))
    state = staged(links.select("grp", "id", to.alias("to"), F.when(to.isNull(), 0).otherwise(1).cast("long").alias("left")), "places")
    while state.where("to is not null").limit(1).count():
        moved = _jump(state, [F.col("to").alias("further"), F.col("left").alias("more")], [F.col("further").alias("to"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")])
        before, state = state, staged(moved, "places")
        discard(before)
    return state.select("grp", "id", "left")


def rings(edges: DataFrame) -> DataFrame:
    """(grp, ring, place, x1, y1, x2, y2, dir) for border edges; place counts from 0 at the ring's lowest, then westmost point."""
    d = F.col("dir")
    outs = edges.groupBy(F.col("grp").alias("g"), F.col("x1").alias("x"), F.col("y1").alias("y")).agg(F.collect_set("dir").alias("ways"))
    known = edges.join(outs, F.col("grp").eqNullSafe(F.col("g")) & (F.col("x2") == F.col("x")) & (F.col("y2") == F.col("y")))
    meeting = F.size("ways") > 1
    known = known.select("grp", "x1", "y1", "x2", "y2", "dir", meeting.alias("meeting"), F.when(meeting, (d + 1) % 4).otherwise(F.col("ways")[0]).alias("turn"))
    known = known.withColumn("id", _number(F.col("x1"), F.col("y1"), d)).withColumn("next", _number(F.col("x2"), F.col("y2"), F.col("turn")))
    known = staged(known, "known")
    same_edge = lambda a, b: a["grp"].eqNullSafe(b["grp"]) & (a["id"] == b["id"])
    ring_of = _labels(known)
    both = known.join(ring_of, same_edge(known, ring_of)).select(known["*"], "ring")
    # A ring that comes to a meeting of corners twice turns right there instead: that cuts it in two.
    twice = both.where("meeting").groupBy(F.col("grp").alias("g"), F.col("x2").alias("x"), F.col("y2").alias("y")).agg(F.min("ring").alias("low"), F.max("ring").alias("high")).where("low = high").drop("low", "high")
    twice = staged(twice, "twice")
    if twice.limit(1).count():
        cut = both.join(twice, F.col("grp").eqNullSafe(F.col("g")) & (F.col("x2") == F.col("x")) & (F.col("y2") == F.col("y")), "left")
        right = _number(F.col("x2"), F.col("y2"), (d + 3) % 4)
        known = staged(cut.select("grp", "id", "x1", "y1", "x2", "y2", "dir", F.when(F.col("x").isNotNull(), right).otherwise(F.col("next")).alias("next")), "known")
        ring_of = _labels(known)
        both = known.join(ring_of, same_edge(known, ring_of)).select(known["*"], "ring")
    both = staged(both, "ringed")
    left = _places(both).select(F.col("grp").alias("g"), F.col("id").alias("i"), "left")
    length = Window.partitionBy("grp", "ring")
    return both.join(left, F.col("grp").eqNullSafe(F.col("g")) & (F.col("id") == F.col("i"))).select("grp", "ring", (F.max("left").over(length) - F.col("left")).alias("place"), "x1", "y1", "x2", "y2", "dir")


def ring_figures(ringed: DataFrame) -> DataFrame:
    """(grp, ring, edges, area2, x, y): twice the area in grid units, negative for holes, and the ring's first point."""
    big = lambda c: F.col(c).cast("decimal(19,0)")
    return ringed.groupBy("grp", "ring").agg(F.count("*").alias("edges"), F.sum(big("x1") * big("y2") - big("x2") * big("y1")).alias("area2"), F.min(F.when(F.col("place") == 0, F.col("x1"))).alias("x"), F.min(F.when(F.col("place") == 0, F.col("y1"))).alias("y"))


def _stretches(low: Column, high: Column) -> Column:
    """The fewest dyadic stretches (level, number) that make up [low, high)."""

    def step(a, k):
        odd_low, odd_high = a["l"] % 2 == 1, a["h"] % 2 == 1
        on = a["l"] < a["h"]
        node = lambda n: F.struct(k.cast("int").alias("level"), n.alias("node"))
        found = F.filter(F.array(F.when(on & odd_low, node(a["l"])), F.when(on & odd_high, node(a["h"] - 1))), lambda v: v.isNotNull())
        return F.struct(F.floor((a["l"] + 1) / 2).alias("l"), F.floor(a["h"] / 2).alias("h"), F.concat(a["out"], found).alias("out"))

    start = F.struct(low.cast("long").alias("l"), high.cast("long").alias("h"), F.array().cast("array<struct<level:int,node:bigint>>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS)), start, step, lambda a: a["out"])


def polygon_of_rings(ringed: DataFrame, figures: DataFrame) -> DataFrame:
    """(grp, ring, outer): the outer ring of each ring's polygon, which is itself for outer ones."""
    holes = figures.where("area2 < 0")
    walls = ringed.where(F.col("dir") == SOUTH).select("grp", F.explode(_stretches(F.col("y2"), F.col("y1"))).alias("v"), F.col("x1").alias("x"), F.lit(1).alias("wall"), F.col("ring").alias("met"), F.lit(None).cast("long").alias("hole"))
    above = F.transform(F.sequence(F.lit(0), F.lit(BITS)), lambda k: F.struct(k.cast("int").alias("level"), F.floor(F.col("y") / F.pow(F.lit(2.0), k)).alias("node")))
    asks = holes.select("grp", F.explode(above).alias("v"), "x", F.lit(0).alias("wall"), F.lit(None).cast("long").alias("met"), F.col("ring").alias("hole"))
    west = Window.partitionBy("grp", "v").orderBy("x", "wall")
    seen = walls.unionByName(asks).select("grp", "hole", F.last(F.when(F.col("wall") == 1, F.struct("x", "met")), True).over(west).alias("hit"))
    hit = seen.where("hole is not null").groupBy("grp", "hole").agg(F.max("hit")["met"].alias("to"))
    state = staged(figures.where("area2 > 0").select("grp", F.col("ring").alias("id"), F.col("ring").alias("to")).unionByName(hit.select("grp", F.col("hole").alias("id"), "to")), "holders")
    while True:
        moved = _jump(state, [F.col("to").alias("further")], [F.col("further").alias("to"), (F.col("further") != F.col("to")).alias("moved")])
        before, state = state, staged(moved, "holders")
        discard(before)
        if not state.where("moved").limit(1).count():
            return state.select("grp", F.col("id").alias("ring"), F.col("to").alias("outer"))


def union_rings(codes: DataFrame, group: str, code: str) -> tuple[DataFrame, DataFrame]:
    """The union of the cells of each group as rows: edges (grp, ring, place, x1, y1, ...), and rings (grp, ring, outer, edges, area2, x, y)."""
    ringed = staged(rings(staged(border(topmost_cells(codes, group, code)), "border")), "rings")
    figures = staged(ring_figures(ringed), "figures")
    outer = polygon_of_rings(ringed, figures).select(F.col("grp").alias("g"), F.col("ring").alias("r"), "outer")
    return ringed, figures.join(outer, F.col("grp").eqNullSafe(F.col("g")) & (F.col("ring") == F.col("r"))).drop("g", "r")


def union_figures(codes: DataFrame, group: str, code: str) -> DataFrame:
    """(grp, polygons, rings, edges, area) of the union of each group's cells; area in square degrees."""
    _, figures = union_rings(codes, group, code)
    unit = F.lit(360.0 / 2**BITS * 180.0 / 2**BITS / 2)
    return figures.groupBy("grp").agg(F.count_if(F.col("area2") > 0).alias("polygons"), F.count("*").alias("rings"), F.sum("edges").alias("edges"), (F.sum("area2").cast("double") * unit).alias("area"))


def polygons_text(ringed: DataFrame, figures: DataFrame, lon: Column, lat: Column) -> DataFrame:
    """(grp, geometry) of edges and rings as `union_rings` has them; lon and lat are those of an edge's start."""
    points = ringed.groupBy("grp", "ring").agg(F.array_sort(F.collect_list(F.struct("place", F.concat_ws(" ", lon.cast("string"), lat.cast("string")).alias("p"))))["p"].alias("p"))
    text = points.select(F.col("grp").alias("g"), F.col("ring").alias("r"), F.concat(F.lit("("), F.array_join("p", ", "), F.lit(", "), F.col("p")[0], F.lit(")")).alias("text"))
    told = figures.join(text, F.col("grp").eqNullSafe(F.col("g")) & (F.col("ring") == F.col("r")))
    whole = told.groupBy("grp", "outer").agg(F.array_sort(F.collect_list(F.struct((F.col("ring") != F.col("outer")).alias("inner"), "ring", "text")))["text"].alias("parts"))
    whole = whole.select("grp", "outer", F.concat(F.lit("("), F.array_join("parts", ", "), F.lit(")")).alias("text"))
    parts = F.array_sort(F.collect_list(F.struct("outer", "text")))["text"]
    return whole.groupBy("grp").agg(parts.alias("p")).select("grp", F.when(F.size("p") == 1, F.concat(F.lit("POLYGON "), F.col("p")[0])).otherwise(F.concat(F.lit("MULTIPOLYGON ("), F.array_join("p", ", "), F.lit(")"))).alias("geometry"))


def union_polygons(codes: DataFrame, group: str, code: str) -> DataFrame:
    """(grp, geometry): the union as POLYGON or MULTIPOLYGON text. A group's text is one value, whatever its length."""
    ringed, figures = union_rings(codes, group, code)
    return polygons_text(ringed, figures, *degrees(F.col("x1"), F.col("y1")))
