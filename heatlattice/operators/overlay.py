"""The union of polygons by group, as rows: overlaps merge, shared sides vanish, holes and touching corners are kept.

Coordinates go to an integer grid (`step`, a power of two by default), where all tests are exact. Sides that polygons
share cancel in one aggregation. What is left is noded by snap rounding: ends and crossings of sides are hot pixels, and
a side is led through every hot pixel that it meets. Sides and pixels meet in tiles as large as the side, so that a side
lies in four tiles at most, whatever its length. How many polygons cover the land west of a side is a sum over the sides
that a ray to the west meets; those are found by the dyadic stretches of their height, and stretches are summed in blocks
that are opened only where the ray begins inside. Sides that are covered on one side alone are the border. Border edges
have the filled side on their left and are strung to rings by pointer jumping.

Defined cases: null and empty geometries, points and lines have no area and give nothing, nor do rings that the grid
flattens; what is no geometry raises, as do coordinates of 2**28 steps or more; repeated polygons count once; a null group
is a group; an empty table gives none. A polygon that crosses itself covers what it winds around counter-clockwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import wkt_polygons, wkt_problem
from ..storage import discard, staged
from .dissolve import _labels, _places, _stretches, polygons_text, ring_figures

STEP = 2.0**-20
LIMIT = 28
#: Blocks that the width of all sides is cut into.
BLOCKS = 256
#: Tiles come in widths of 4**k steps.
LEVELS = range(0, LIMIT + 3, 2)
SIDE = ["grp", "x1", "y1", "x2", "y2"]
_C = F.col


def _cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def _same(a: str, b: str, *pairs: tuple[str, str]) -> Column:
    """Equal groups (nulls, too) and equal columns."""
    out = _C(f"{a}.grp").eqNullSafe(_C(f"{b}.grp"))
    for x, y in pairs:
        out &= _C(f"{a}.{x}") == _C(f"{b}.{y}")
    return out


def _upward(rows: DataFrame, m: Column) -> DataFrame:
    """Directed sides as (grp, x1, y1, x2, y2, m), each upward or eastward, m counting those that go this way less the others."""
    up = (_C("y1") < _C("y2")) | ((_C("y1") == _C("y2")) & (_C("x1") < _C("x2")))
    turned = [F.when(up, _C(a)).otherwise(_C(b)).alias(a) for a, b in zip(SIDE[1:], ("x2", "y2", "x1", "y1"), strict=True)]
    real = rows.where((_C("x1") != _C("x2")) | (_C("y1") != _C("y2")))
    return real.select("grp", *turned, F.when(up, m).otherwise(-m).alias("m")).groupBy(*SIDE).agg(F.sum("m").alias("m")).where("m <> 0")


def sides(polygons: DataFrame, group: str, geometry: str, step: float = STEP) -> DataFrame:
    """(grp, x1, y1, x2, y2, m) of the polygons' sides on the grid; shells count counter-clockwise, holes clockwise."""
    text = _C("_text")
    area = text.rlike(r"(?i)^\s*(MULTI)?POLYGON")
    shape = F.when(wkt_problem(text).isNotNull(), F.raise_error(wkt_problem(text))).when(area, wkt_polygons(text))
    # Repeated polygons cover what one does; without them more sides cancel, and no text is read twice.
    once = polygons.select(_C(group).alias("grp"), _C(geometry).alias("_text")).distinct()
    ringed = once.select("grp", F.explode(shape).alias("p")).select("grp", F.posexplode("p").alias("k", "ring"))
    on = lambda v: F.when(F.abs(v / step) < 2.0**LIMIT, F.round(v / step).cast("long")).otherwise(F.raise_error(F.lit("coordinates too large for this grid")))
    gridded = ringed.select("grp", "k", F.transform("ring", lambda v: F.struct(on(v["x"]).alias("x"), on(v["y"]).alias("y"))).alias("r"))
    following = F.concat(F.slice("r", F.lit(2), F.size("r")), F.slice("r", F.lit(1), F.lit(1)))
    both = gridded.where(F.size("r") > 2).select("grp", "k", F.zip_with("r", following, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))).alias("s"))
    big = lambda v: v.cast("decimal(19,0)")
    turn = F.aggregate("s", F.lit(0).cast("decimal(38,0)"), lambda a, s: (a + big(s["x1"]) * big(s["y2"]) - big(s["x2"]) * big(s["y1"])).cast("decimal(38,0)"))
    sign = F.when((turn >= 0) == (_C("k") == 0), 1).otherwise(-1).cast("long")
    return _upward(both.select("grp", sign.alias("sign"), F.explode("s").alias("s")).select("grp", "sign", "s.*"), _C("sign"))


def _bits(extent: Column) -> Column:
    """The smallest even k with 2**k above the extent."""
    bits = F.length(F.bin(extent))
    return bits + bits % 2


def _tiles(level: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """array<struct<level, i, j>> of the tiles of a level that a box touches."""
    width = F.pow(F.lit(2.0), level)
    run = lambda a, b: F.sequence(F.floor(a / width), F.floor(b / width))
    return F.flatten(F.transform(run(west, east), lambda i: F.transform(run(south, north), lambda j: F.struct(level.cast("int").alias("level"), i.alias("i"), j.alias("j")))))


def _box() -> list[Column]:
    return [F.least("x1", "x2"), F.least("y1", "y2"), F.greatest("x1", "x2"), F.greatest("y1", "y2")]


def _own_level() -> Column:
    return _bits(F.greatest(F.abs(_C("x2") - _C("x1")), F.abs(_C("y2") - _C("y1"))))


def _all_tiles(least: Column, box: list[Column]) -> Column:
    """The tiles of a box at its own level and all wider ones."""
    return F.flatten(F.array(*(F.when(F.lit(k) >= least, _tiles(F.lit(k), *box)).otherwise(F.array().cast("array<struct<level:int,i:bigint,j:bigint>>")) for k in LEVELS)))


def crossings(segments: DataFrame) -> DataFrame:
    """(grp, a, b, px, py): pairs of sides that cross inside both, and the grid point of the crossing."""
    ends = F.struct(*SIDE[1:])
    homes = segments.select("grp", ends.alias("b"), F.explode(_tiles(_own_level(), *_box())).alias("tile"))
    looks = segments.select("grp", ends.alias("a"), F.explode(_all_tiles(_own_level(), _box())).alias("tile"))
    met = looks.alias("l").join(homes.alias("h"), _same("l", "h", ("tile", "tile"))).select("l.grp", "a", "b")
    side = lambda s, x, y: _cross(_C(f"{s}.x2") - _C(f"{s}.x1"), _C(f"{s}.y2") - _C(f"{s}.y1"), x - _C(f"{s}.x1"), y - _C(f"{s}.y1"))
    c, d = side("a", _C("b.x1"), _C("b.y1")), side("a", _C("b.x2"), _C("b.y2"))
    e, f = side("b", _C("a.x1"), _C("a.y1")), side("b", _C("a.x2"), _C("a.y2"))
    t = c.cast("double") / (c - d)
    at = lambda p: F.round(_C(f"b.{p}1") + t * (_C(f"b.{p}2") - _C(f"b.{p}1"))).cast("long")
    return met.where((F.signum(c) * F.signum(d) < 0) & (F.signum(e) * F.signum(f) < 0)).select("grp", "a", "b", at("x").alias("px"), at("y").alias("py")).distinct()


def noded(segments: DataFrame) -> DataFrame:
    """Sides that meet in ends alone, by snap rounding of (grp, x1, y1, x2, y2, m)."""
    crossed = staged(crossings(segments), "crossings")
    point = lambda df, x, y: df.select("grp", _C(x).alias("px"), _C(y).alias("py"))
    hot = point(segments, "x1", "y1").unionByName(point(segments, "x2", "y2")).unionByName(point(crossed, "px", "py")).distinct()
    asks = hot.select("grp", "px", "py", F.explode(_all_tiles(F.lit(0), [_C("px"), _C("py"), _C("px"), _C("py")])).alias("tile"))
    homes = segments.select(*SIDE, F.explode(_tiles(_own_level(), *_box())).alias("tile"))
    w, s, e, n = _box()
    inside = _C("px").between(w, e) & _C("py").between(s, n) & ~((_C("px") == _C("x1")) & (_C("py") == _C("y1"))) & ~((_C("px") == _C("x2")) & (_C("py") == _C("y2")))
    corner = lambda i, j: _cross(_C("x2") - _C("x1"), _C("y2") - _C("y1"), 2 * (_C("px") - _C("x1")) + i, 2 * (_C("py") - _C("y1")) + j)
    corners = [corner(i, j) for i in (-1, 1) for j in (-1, 1)]
    led = asks.alias("p").join(homes.alias("h"), _same("p", "h", ("tile", "tile")) & inside & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0))
    led = led.select("h.grp", *SIDE[1:], "px", "py")
    own = lambda s: crossed.select("grp", f"{s}.*", "px", "py")
    through = led.unionByName(own("a")).unionByName(own("b")).distinct()
    part = lambda df, rank, x, y: df.select(*SIDE, F.lit(rank).alias("rank"), x.alias("px"), y.alias("py"))
    stops = part(segments, 0, _C("x1"), _C("y1")).unionByName(part(through, 1, _C("px"), _C("py"))).unionByName(part(segments, 2, _C("x2"), _C("y2")))
    along = (_C("x2") - _C("x1")) * (_C("px") - _C("x1")) + (_C("y2") - _C("y1")) * (_C("py") - _C("y1"))
    order = Window.partitionBy(*SIDE).orderBy("rank", along, "py", "px")
    steps = stops.select(*SIDE, "px", "py", F.lead("px").over(order).alias("nx"), F.lead("py").over(order).alias("ny")).where("nx is not null")
    weighed = steps.alias("s").join(segments.alias("m"), _same("s", "m", *((c, c) for c in SIDE[1:]))).select("s.grp", _C("px").alias("x1"), _C("py").alias("y1"), _C("nx").alias("x2"), _C("ny").alias("y2"), "m.m")
    return _upward(weighed, _C("m"))


def _walls(edges: DataFrame) -> DataFrame:
    """Upward edges at the dyadic stretches of their height."""
    low = F.lit(1 << LIMIT)
    return edges.where("y1 < y2").select("*", F.explode(_stretches(_C("y1") + low, _C("y2") + low)).alias("v"))


def _heights(y: Column) -> Column:
    """The stretches around a height, given twice."""
    place = F.floor(y / 2) + (1 << LIMIT)
    return F.transform(F.sequence(F.lit(0), F.lit(LIMIT + 2)), lambda k: F.struct(k.cast("int").alias("level"), F.floor(place / F.pow(F.lit(2.0), k)).alias("node")))


def _west() -> Column:
    """Whether wall w lies west of point (x, y), given twice, just above it on a line of direction (dx, dy)."""
    wx, wy = _C("w.x2") - _C("w.x1"), _C("w.y2") - _C("w.y1")
    turn = _cross(wx, wy, _C("a.x") - 2 * _C("w.x1"), _C("a.y") - 2 * _C("w.y1"))
    return (turn < 0) | ((turn == 0) & (_cross(_C("a.dx"), _C("a.dy"), wx, wy) > 0))


def covered(edges: DataFrame) -> DataFrame:
    """Edges (grp, x1, y1, x2, y2, m) with `left` and `right`: how many polygons cover either side of their middle."""
    walls = staged(_walls(edges), "walls")
    extent = walls.agg(F.max(F.greatest("x1", "x2")) - F.min(F.least("x1", "x2"))).first()[0] or 0  # one number
    placed = walls.withColumn("block", F.floor(F.least("x1", "x2") / F.lit(max(1.0, extent / BLOCKS))))
    blocks = placed.groupBy("grp", "v", "block").agg(F.sum(-_C("m")).alias("sum"), F.min(F.least("x1", "x2")).alias("low"), F.max(F.greatest("x1", "x2")).alias("high"))
    asks = edges.select(*SIDE, (_C("x1") + _C("x2")).alias("x"), (_C("y1") + _C("y2")).alias("y"), (_C("x2") - _C("x1")).alias("dx"), (_C("y2") - _C("y1")).alias("dy"))
    asks = asks.select("*", F.explode(_heights(_C("y"))).alias("v"))
    near = asks.alias("a").join(blocks.alias("b"), _same("a", "b", ("v", "v")) & (_C("a.x") >= 2 * _C("b.low"))).select("a.*", "block", "sum", (_C("a.x") > 2 * _C("b.high")).alias("whole"))
    near = staged(near, "near")
    opened = near.where("not whole").alias("a").join(placed.alias("w"), _same("a", "w", ("v", "v"), ("block", "block")) & _west()).select(*(f"a.{c}" for c in SIDE), (-_C("w.m")).alias("sum"))
    sums = near.where("whole").select(*SIDE, "sum").unionByName(opened).groupBy(*SIDE).agg(F.sum("sum").alias("sum"))
    left = F.coalesce("s.sum", F.lit(0))
    return edges.alias("e").join(sums.alias("s"), _same("e", "s", *((c, c) for c in SIDE[1:])), "left").select("e.*", left.alias("left"), (left - _C("e.m")).alias("right"))


def border(polygons: DataFrame, group: str, geometry: str, step: float = STEP) -> DataFrame:
    """(grp, x1, y1, x2, y2): the edges of the union of each group's polygons, filled on their left."""
    segments = staged(sides(polygons, group, geometry, step), "sides")
    edges = staged(noded(segments), "noded")
    left, right = _C("left") > 0, _C("right") > 0
    kept = covered(edges).where(left != right)
    return kept.select("grp", *(F.when(left, _C(a)).otherwise(_C(b)).alias(a) for a, b in zip(SIDE[1:], ("x2", "y2", "x1", "y1"), strict=True)))


def _sharpest(ways: Column, dx: Column, dy: Column, turn: int) -> Column:
    """Of directions (dx, dy, ...) the first one met when turning from where an edge of direction (dx, dy) came from:
    clockwise for turn 1 (the leftmost way on), counter-clockwise for -1."""
    zone = lambda o: F.signum(_cross(-dx, -dy, o["dx"], o["dy"])) * turn
    ahead = lambda a, b: F.signum(_cross(a["dx"], a["dy"], b["dx"], b["dy"])) * turn
    return F.when(F.size(ways) == 1, ways[0]).otherwise(F.array_sort(ways, lambda a, b: F.when(zone(a) < zone(b), -1).when(zone(a) > zone(b), 1).otherwise(ahead(a, b).cast("int")))[0])


def rings(edges: DataFrame) -> DataFrame:
    """(grp, ring, place, x1, y1, x2, y2) for border edges; place counts from 0 at the ring's lowest, then westmost point.

    Where corners meet an edge goes on to its left, so land that touches in a point alone is apart; a ring that comes to
    a point twice is cut there.
    """
    dx, dy = _C("x2") - _C("x1"), _C("y2") - _C("y1")
    number = F.struct(_C("y1").alias("y"), _C("x1").alias("x"), dx.alias("dx"), dy.alias("dy"))
    rows = edges.select(*SIDE, number.alias("id"))
    at_end = lambda a, b: _same(a, b, ("x2", "x"), ("y2", "y"))
    outs = rows.groupBy("grp", _C("x1").alias("x"), _C("y1").alias("y")).agg(F.collect_set("id").alias("ways"))
    known = rows.alias("e").join(outs.alias("o"), at_end("e", "o")).select("e.*", (F.size("ways") > 1).alias("meeting"), _sharpest(_C("ways"), dx, dy, 1).alias("next"))
    known = staged(known, "known")
    label = lambda k: k.alias("k").join(_labels(k).alias("r"), _same("k", "r", ("id", "id"))).select("k.*", "r.ring")
    both = staged(label(known), "ringed")
    again = both.where("meeting").alias("e").join(outs.alias("o"), at_end("e", "o")).select("e.grp", "e.ring", "o.x", "o.y").groupBy("grp", "ring", "x", "y").agg(F.count("*").alias("n")).where("n > 1")
    again = staged(again, "again")
    if again.limit(1).count():
        start = both.alias("b").join(again.alias("a"), _same("b", "a", ("ring", "ring"), ("x1", "x"), ("y1", "y"))).groupBy("b.grp", "b.ring", _C("b.x1").alias("x"), _C("b.y1").alias("y")).agg(F.collect_set("b.id").alias("ways"))
        cut = both.alias("e").join(start.alias("o"), at_end("e", "o") & (_C("e.ring") == _C("o.ring")), "left")
        turned = F.when(_C("ways").isNotNull(), _sharpest(_C("ways"), dx, dy, -1)).otherwise(_C("e.next"))
        both = staged(label(staged(cut.select(*(f"e.{c}" for c in (*SIDE, "id")), turned.alias("next")), "known")), "ringed")
    length = Window.partitionBy("grp", "ring")
    placed = both.alias("b").join(_places(both).alias("p"), _same("b", "p", ("id", "id")))
    return placed.select("b.grp", "b.ring", *SIDE[1:], "left").select("grp", "ring", (F.max("left").over(length) - _C("left")).alias("place"), *SIDE[1:])


def polygon_of_rings(ringed: DataFrame, figures: DataFrame) -> DataFrame:
    """(grp, ring, outer): the outer ring of each ring's polygon. From its lowest point a hole looks west; what it sees first
    is its polygon's shell or another of its holes, which begins lower or farther west."""
    starts = ringed.where("place = 0").alias("r").join(figures.where("area2 < 0").alias("f"), _same("r", "f", ("ring", "ring"))).select("r.*")
    asks = starts.select("grp", _C("ring").alias("hole"), (2 * _C("x1")).alias("x"), (2 * _C("y1")).alias("y"), (_C("x2") - _C("x1")).alias("dx"), (_C("y2") - _C("y1")).alias("dy"))
    down = ringed.where("y1 > y2").select("grp", "ring", _C("x2").alias("x1"), _C("y2").alias("y1"), _C("x1").alias("x2"), _C("y1").alias("y2"))
    slope = (_C("w.x2") - _C("w.x1")) / (_C("w.y2") - _C("w.y1"))
    place = F.struct((_C("w.x1") + slope * (_C("a.y") / 2 - _C("w.y1"))).alias("x"), slope.alias("slope"))
    seen = asks.select("*", F.explode(_heights(_C("y"))).alias("v")).alias("a").join(_walls(down).alias("w"), _same("a", "w", ("v", "v")) & _west())
    hit = seen.select("a.grp", "a.hole", "w.ring", place.alias("place")).groupBy("grp", "hole").agg(F.max_by("ring", "place").alias("to"))
    shells = figures.where("area2 > 0").select("grp", _C("ring").alias("id"), _C("ring").alias("to"))
    state = staged(shells.unionByName(hit.select("grp", _C("hole").alias("id"), "to")), "holders")
    while True:
        on = state.alias("s").join(state.alias("o"), _same("s", "o", ("to", "id")), "left").select("s.grp", "s.id", _C("o.to").alias("to"), (_C("o.to") != _C("s.to")).alias("moved"))
        before, state = state, staged(on, "holders")
        discard(before)
        if not state.where("moved").limit(1).count():
            return state.select("grp", _C("id").alias("ring"), _C("to").alias("outer"))


def union_rings(polygons: DataFrame, group: str, geometry: str, step: float = STEP) -> tuple[DataFrame, DataFrame]:
    """The union of each group's polygons as rows: edges (grp, ring, place, x1, y1, x2, y2) in grid steps, and rings
    (grp, ring, outer, edges, area2, x, y)."""
    ringed = staged(rings(staged(border(polygons, group, geometry, step), "border")), "rings")
    figures = staged(ring_figures(ringed), "figures")
    outer = polygon_of_rings(ringed, figures)
    return ringed, figures.alias("f").join(outer.alias("o"), _same("f", "o", ("ring", "ring"))).select("f.*", "o.outer")


def union_figures(polygons: DataFrame, group: str, geometry: str, step: float = STEP) -> DataFrame:
    """(grp, polygons, rings, edges, area) of the union of each group's polygons."""
    _, figures = union_rings(polygons, group, geometry, step)
    return figures.groupBy("grp").agg(F.count_if(_C("area2") > 0).alias("polygons"), F.count("*").alias("rings"), F.sum("edges").alias("edges"), (F.sum("area2").cast("double") * (step * step / 2)).alias("area"))


def union_polygons(polygons: DataFrame, group: str, geometry: str, step: float = STEP) -> DataFrame:
    """(grp, geometry): the union as POLYGON or MULTIPOLYGON text. A group's text is one value, whatever its length."""
    ringed, figures = union_rings(polygons, group, geometry, step)
    return polygons_text(ringed, figures, _C("x1") * F.lit(step), _C("y1") * F.lit(step))
