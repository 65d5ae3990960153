"""Queries over the driver's tables, one for each operator, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import geo, numeric, projection, validity
from .operators import classify, cube, dissolve, gistar, overlay, permute, trend, weights
from .plans import ehsa
from .sources import export, ingest, shapefile_source, tiles
from .storage import fresh_folder, spread, staged
from .streaming import cube as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- fixture cubes: unit squares on a grid, integer values ----------------------------------------------------------


def squares(keys: DataFrame, width: int) -> DataFrame:
    """keys (key) as region and geometry: the unit square at (key % width, key div width)."""
    x, y = F.expr(f"cast(key % {width} as double)"), F.expr(f"cast(key div {width} as double)")
    return keys.select(F.col("key").cast("string").alias("region"), geo.box_wkt(x, y, x + 1, y + 1).alias("geometry"))


def nation_geo(spark, d):
    return squares(table(spark, d, "nation").select(F.col("n_nationkey").alias("key")), 5)


def nation_orders(spark, d):
    orders = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return orders.select(F.col("c_nationkey").cast("string").alias("region"), "o_orderdate")


def ny(spark, d):
    rows = nation_orders(spark, d)
    return rows.groupBy("region", F.year("o_orderdate").alias("t")).agg(F.count("*").cast("double").alias("x"))


def nq(spark, d):
    rows = nation_orders(spark, d)
    return rows.groupBy("region", F.date_trunc("quarter", "o_orderdate").alias("t")).agg(F.count("*").cast("double").alias("x"))


def sy(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("region"), F.year("l_shipdate").alias("t"), F.col("l_quantity").cast("bigint").alias("q"))
    return rows.groupBy("region", "t").agg(F.sum("q").cast("double").alias("x"))


def supplier_geo(spark, d):
    return squares(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key")).distinct(), 10)


def ud(spark, d):
    return stream.windowed(table(spark, d, "events"), "user_id")


def user_geo(spark, d):
    return squares(table(spark, d, "events").select(F.col("user_id").alias("key")).distinct(), 15)


NY = """obs as (select c_nationkey::varchar as region, year(o_orderdate) as t, count(*)::double as x
  from orders join customer on o_custkey = c_custkey group by 1, 2)"""
NQ = """obs as (select c_nationkey::varchar as region, date_trunc('quarter', o_orderdate)::timestamp as t, count(*)::double as x
  from orders join customer on o_custkey = c_custkey group by 1, 2)"""
SY = """obs as (select l_suppkey::varchar as region, year(l_shipdate) as t, sum(l_quantity::bigint)::double as x from lineitem group by 1, 2)"""
UD = """obs as (select user_id::varchar as region, date_trunc('day', ts)::timestamp as t, count(*)::double as x from events group by 1, 2)"""
NATION_KEYS = "select n_nationkey as key from nation"
SUPPLIER_KEYS = "select distinct l_suppkey as key from lineitem"
USER_KEYS = "select distinct user_id as key from events"


def edges_sql(keys: str, width: int) -> str:
    return f"""keys as ({keys}),
corners as (select key::varchar as region, key % {width} + dx as vx, key // {width} + dy as vy from keys, (values (0), (1)) a(dx), (values (0), (1)) b(dy)),
edges as (select distinct a.region, b.region as neighbor from corners a join corners b using (vx, vy))"""


def gi_sql(k: int) -> str:
    """obs (r, b, x, ...) and near (region, neighbor) to gi (all of obs, s, m, n, mean, var, gi)."""
    return f"""stats as (select b, count(*) as n, avg(x) as mean, var_pop(x) as var from placed group by b),
sums as (select e.region as r, o.b + l.range as b, sum(o.x) as s, count(*) as m from placed o join near e on e.neighbor = o.r, range(0, {k + 1}) l group by 1, 2),
gi as (select p.*, s, m, n, mean, var, case when n > m and var > 0 then (s - m * mean) / sqrt(var * m * (n - m) / (n - 1)) else 0 end as gi
  from placed p join stats using (b) join sums using (r, b))"""


KEYED = "placed as (select region, t, x, region as r, dense_rank() over (order by t) - 1 as b from obs), near as (select * from edges)"


# ---- cleaning and the cube ------------------------------------------------------------------------------------------

_JUNK = "case when event_id % 7 = 0 then '1.5d' when event_id % 11 = 0 then null when event_id % 13 = 0 then ' 2 ' when event_id % 17 = 0 then 'inf' when event_id % 19 = 0 then 'nan' when event_id % 23 = 0 then '1e3' when event_id % 29 = 0 then '' else cast(cast(floor(value) as bigint) as varchar(20)) end"


@query(f"""with e as (select event_id, user_id, {_JUNK} as v from events)
select event_id, user_id::varchar as region, case when lower(trim(v)) = 'nan' or v is null or not regexp_full_match(trim(v), '[+-]?((\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?|inf)') then 0.0::double else trim(v)::double end as v from e""")
def clean_values(spark, d):
    rows = table(spark, d, "events").select("event_id", F.col("user_id").alias("region"), F.expr(_JUNK.replace("varchar(20)", "string")).alias("v"))
    return cube.clean(rows, "v", "region")


@query(f"with {UD} select r.region, q.t, x from (select distinct region from obs) r cross join (select distinct t from obs) q left join obs o on o.region = r.region and o.t = q.t")
def cube_complete(spark, d):
    return cube.complete(ud(spark, d), "region", "t")


@query(f"with {UD} select r.region, q.t from (select distinct region from obs) r cross join (select distinct t from obs) q where not exists (select 1 from obs o where o.region = r.region and o.t = q.t)")
def cube_gaps(spark, d):
    return cube.gaps(ud(spark, d), "region", "t")


@query(f"with {UD} select region, t, x from obs")
def cube_dropna(spark, d):
    return cube.dropna(cube.complete(ud(spark, d), "region", "t"), "x")


@query(f"with {UD}, {edges_sql(USER_KEYS, 15)} select region, (region::int % 15)::double as min_x, x % 10 as cx, count(*) as n from obs group by all")
def first_geometry_join(spark, d):
    """Cube completion with geometry: rows keep their region's geometry."""
    full = ud(spark, d).join(user_geo(spark, d), "region")
    done = cube.dropna(cube.complete(full, "region", "t"), "x")
    return done.groupBy("region", geo.ring_metrics(geo.wkt_vertices(F.col("geometry")))["min_x"].alias("min_x"), (F.col("x") % 10).alias("cx")).agg(F.count("*").alias("n"))


@query("select n_name as region, min(n_nationkey) as n_nationkey, count(*) as n from nation group by 1")
def drop_duplicates(spark, d):
    nation = table(spark, d, "nation")
    return nation.unionByName(nation).dropDuplicates().groupBy(F.col("n_name").alias("region")).agg(F.min("n_nationkey").alias("n_nationkey"), F.count("*").alias("n"))


# ---- geometry -------------------------------------------------------------------------------------------------------

#: Geohash codes made of customer keys: of any length, and cells of one area in three precisions.
_ANY_CODE = "substr(replace(md5(cast(c_custkey as varchar(20))), 'a', 'z'), 1, cast(1 + c_custkey % 12 as int))"
_LETTER = "substr('" + geo.BASE32 + "', cast({} % 32 as int) + 1, 1)"
_AREA_CODE = f"concat('9q8', {_LETTER.format('floor(c_custkey / 32.0)')}, case when c_custkey % 97 = 0 then '' else {_LETTER.format('c_custkey')} end, case when c_custkey % 7 = 0 then {_LETTER.format('(c_custkey * c_custkey)')} else '' end)"
_AREA_GROUP = "cast(c_nationkey % 4 as int)"


def _codes(spark, d, code: str, *more: str) -> DataFrame:
    return spread(table(spark, d, "customer")).select("c_custkey", F.expr(code.replace("varchar(20)", "string")).alias("code"), *map(F.expr, more))


def grid_sql(source: str, bits: int) -> str:
    """boxes: rows (..., code) of source with w, s, e, n, cells of the grid of 2**bits on each axis."""
    spelled = f"list_aggregate(list_transform(range(1, length(code) + 1), lambda i: lpad(bin(instr('{geo.BASE32}', substr(code, i::int, 1)) - 1), 5, '0')), 'string_agg', '')"
    number = lambda first: f"list_reduce(list_prepend(0::bigint, list_transform(range({first}, length(b) + 1, 2), lambda i: substr(b, i::int, 1)::bigint)), lambda p, q: p * 2 + q)"
    return f"""spelled as (select *, {spelled} as b from ({source})),
numbers as (select * exclude (b), {number(1)} as i, {number(2)} as j, 1::bigint << ({bits} - (length(b) + 1) // 2)::int as dx, 1::bigint << ({bits} - length(b) // 2)::int as dy from spelled),
boxes as (select * exclude (i, j, dx, dy), i * dx as w, j * dy as s, (i + 1) * dx as e, (j + 1) * dy as n from numbers)"""


_BOUNDS = f"with {grid_sql(f'select c_custkey, {_ANY_CODE} as code from customer', 30)}, d as (select *, -180 + w * (360.0::double / 1073741824) as min_lon, -90 + s * (180.0::double / 1073741824) as min_lat, -180 + e * (360.0::double / 1073741824) as max_lon, -90 + n * (180.0::double / 1073741824) as max_lat from boxes)"


@query(f"{_BOUNDS} select c_custkey, code, min_lon, min_lat, max_lon, max_lat from d")
def geohash_bounds(spark, d):
    codes = _codes(spark, d, _ANY_CODE)
    return codes.select("c_custkey", "code", geo.geohash_bounds(F.col("code")).alias("b")).select("c_custkey", "code", "b.*")


@query(f"{_BOUNDS} select c_custkey, case when c_custkey % 10 > 0 then 5 end::int as points, case when c_custkey % 10 > 0 then round(min_lon, 9) end as min_x, case when c_custkey % 10 > 0 then round(max_lat, 9) end as max_y, case when c_custkey % 10 > 0 then round((max_lon - min_lon) * (max_lat - min_lat), 6) end as area from d")
def geohash_geometry(spark, d):
    """The cells' outlines, read back from their text; no geometry for no code."""
    codes = _codes(spark, d, f"case when c_custkey % 10 > 0 then {_ANY_CODE} end")
    figures = lambda v: F.struct(F.size(v).alias("points"), geo.ring_metrics(v).alias("m"))
    read = numeric.bound(geo.wkt_vertices(F.col("geometry")), lambda v: F.when(v.isNotNull(), figures(v)))
    m = geo.with_geohash_geometry(codes, "code").select("c_custkey", read.alias("f")).select("c_custkey", "f.*")
    return m.select("c_custkey", "points", *(numeric.scaled_round(F.col(f"m.{c}"), n).alias(c) for c, n in (("min_x", 9), ("max_y", 9), ("area", 6))))


#: Cells that touch along more than a corner are one part; each part has all its cells of the finest precision. Its holes
#: follow from its corners, sides and cells by the Euler characteristic, corners being shared.
_FINE = f"""{grid_sql(f'select distinct {_AREA_GROUP} as g, {_AREA_CODE} as code from customer', 15)},
cells as (select g, w, s, e, n, row_number() over () as id from boxes),
touch as (select a.id, b.id as other from cells a join cells b on a.g = b.g and least(a.e, b.e) >= greatest(a.w, b.w) and least(a.n, b.n) >= greatest(a.s, b.s) and least(a.e, b.e) - greatest(a.w, b.w) + least(a.n, b.n) - greatest(a.s, b.s) > 0),
reach(id, other) as (select id, id from cells union select reach.id, touch.other from reach join touch on touch.id = reach.other),
named as (select cells.*, part from cells join (select id, min(other) as part from reach group by 1) using (id)),
columns as (select g, part, unnest(range(w, e)) as x, s, n from named), fine as (select distinct g, part, x, unnest(range(s, n)) as y from columns),
corners as (select distinct g, part, x + i, y + j from fine, range(0, 2) a(i), range(0, 2) b(j)),
sides as (select distinct g, part, x + i, y, 0 from fine, range(0, 2) a(i) union select distinct g, part, x, y + i, 1 from fine, range(0, 2) a(i)),
count_of as (select g, count(distinct part) as polygons, count(*) as parts from fine group by 1),
whole as (select g, polygons, parts, polygons - (parts - (select count(*) from sides where sides.g = count_of.g) + (select count(*) from corners where corners.g = count_of.g)) as holes from count_of)"""
_UNIT = 360.0 / 2**15 * 180.0 / 2**15


@query(f"with recursive {_FINE} select g, polygons, polygons + holes as rings, round(parts * {_UNIT!r}::double, 9) as area from whole")
def geohash_union(spark, d):
    """The union of the cells of each group: polygons, rings and area; holes by the Euler characteristic in SQL."""
    figures = dissolve.union_figures(_codes(spark, d, _AREA_CODE, f"{_AREA_GROUP} as g"), "g", "code")
    return figures.select(F.col("grp").alias("g"), "polygons", "rings", F.round("area", 9).alias("area"))


@query(f"with recursive {_FINE} select g, case when polygons > 1 then 'MULTIPOLYGON' else 'POLYGON' end as kind, polygons::int as polygons, (polygons + holes)::int as rings, round(parts * {_UNIT!r}::double, 6) as area, true as valid from whole")
def geohash_union_polygons(spark, d):
    """The unions as text, read back and tested."""
    shapes = dissolve.union_polygons(_codes(spark, d, _AREA_CODE, f"{_AREA_GROUP} as g"), "g", "code")
    shapes = shapes.select("grp", F.regexp_extract("geometry", "^[A-Z]+", 0).alias("kind"), geo.wkt_polygons(F.col("geometry")).alias("p"))
    m = geo.polygon_metrics(F.col("p"))
    return shapes.select(F.col("grp").alias("g"), "kind", F.size("p").alias("polygons"), F.size(F.flatten("p")).alias("rings"), F.round(m["area"], 6).alias("area"), m["valid"].alias("valid"))


@query(f"""with recursive {_FINE}, open as (select g, 0 as dir from fine a where not exists (from fine b where b.g = a.g and b.x = a.x and b.y = a.y - 1) union all select g, 1 from fine a where not exists (from fine b where b.g = a.g and b.x = a.x + 1 and b.y = a.y)
  union all select g, 2 from fine a where not exists (from fine b where b.g = a.g and b.x = a.x and b.y = a.y + 1) union all select g, 3 from fine a where not exists (from fine b where b.g = a.g and b.x = a.x - 1 and b.y = a.y))
select g, dir::int as dir, count(*) as parts from open group by all""")
def geohash_union_mixed(spark, d):
    """The border of the unions as edges by direction, in sides of the finest cell."""
    edges = dissolve.border(dissolve.topmost_cells(_codes(spark, d, _AREA_CODE, f"{_AREA_GROUP} as g"), "g", "code"))
    return edges.groupBy(F.col("grp").alias("g"), "dir").agg(F.sum(F.shiftright(F.abs(F.col("x2") - F.col("x1")) + F.abs(F.col("y2") - F.col("y1")), 15)).alias("parts"))


#: Overlapping squares, diamonds, right triangles and frames around places made of customer keys, s wide.
_LAND_COLUMNS = {"id": "c_custkey", "g": "cast(c_nationkey % 4 as int)", "kind": "cast(c_custkey % 4 as int)", "x": "cast(c_custkey * 17 % 61 as int)", "y": "cast(c_custkey * 29 % 53 as int)", "s": "cast(1 + floor(c_custkey / 4.0) % 3 as int)"}
_LAND = "select " + ", ".join(f"{e} as {n}" for n, e in _LAND_COLUMNS.items()) + " from customer"
_LAND_SHAPES = [
    [[(0, 0), ("s", 0), ("s", "s"), (0, "s")]],
    [[(3, "3 - s"), ("3 + s", 3), (3, "3 + s"), ("3 - s", 3)]],
    [[(0, 0), (0, "s + 1"), ("s + 1", 0)]],
    [[(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (3, 1), (3, 3), (1, 3)]],
]
#: The diagonals of the unit squares cut them into quarters (x, y: six times their middle's place; their sides and corners
#: at four times their place), of which all shapes are made. Shapes that share a side of a quarter are one part; holes
#: follow from each part's quarters, sides and corners by the Euler characteristic.
_LAND_SQL = f"""land as ({_LAND}),
quarter(ox, oy, sides, corners) as (values (3, 1, [[2, 0], [1, 1], [3, 1]], [[0, 0], [4, 0], [2, 2]]), (5, 3, [[4, 2], [3, 1], [3, 3]], [[4, 0], [4, 4], [2, 2]]),
  (3, 5, [[2, 4], [3, 3], [1, 3]], [[4, 4], [0, 4], [2, 2]]), (1, 3, [[0, 2], [1, 3], [1, 1]], [[0, 4], [0, 0], [2, 2]])),
inside as (select id, g, x + i as px, y + j as py, ox, oy, sides, corners, 6 * i + ox as dx, 6 * j + oy as dy, kind, s from land, range(0, 7) a(i), range(0, 7) b(j), quarter),
has as (select * from inside where (kind = 0 and dx < 6 * s and dy < 6 * s) or (kind = 1 and abs(dx - 18) + abs(dy - 18) < 6 * s) or (kind = 2 and dx + dy < 6 * (s + 1))
  or (kind = 3 and dx < 24 and dy < 24 and not (dx between 6 and 18 and dy between 6 and 18))),
own as (select distinct id, g, 4 * px + u[1] as sx, 4 * py + u[2] as sy from (select id, g, px, py, unnest(sides) as u from has)),
touch as (select distinct a.id, b.id as other from own a join own b using (g, sx, sy)),
reach(id, other) as (select id, id from land union select reach.id, touch.other from reach join touch on touch.id = reach.other),
part_of as (select id, min(other) as part from reach group by 1),
f as (select g, count(distinct part) as parts, count(distinct (px, py, ox, oy)) as quarters from has join part_of using (id) group by 1),
e as (select g, count(distinct (part, sx, sy)) as n from own join part_of using (id) group by 1),
v as (select g, count(distinct (part, 4 * px + u[1], 4 * py + u[2])) as n from (select id, g, px, py, unnest(corners) as u from has) join part_of using (id) group by 1),
whole as (select g, parts as polygons, 2 * parts - (quarters - e.n + v.n) as rings, quarters / 4.0::double as area from f join e using (g) join v using (g))"""


def _land(spark, d) -> DataFrame:
    point = lambda x, y: F.concat_ws(" ", F.expr(f"string(double(x + {x}))"), F.expr(f"string(double(y + {y}))"))
    ring = lambda r: F.concat(F.lit("("), F.concat_ws(", ", *(point(*p) for p in (*r, r[0]))), F.lit(")"))
    texts = [F.concat(F.lit("POLYGON ("), F.concat_ws(", ", *map(ring, rings)), F.lit(")")) for rings in _LAND_SHAPES]
    rows = spread(table(spark, d, "customer").selectExpr(*(f"{e} as {n}" for n, e in _LAND_COLUMNS.items())))
    return rows.select("id", "g", F.coalesce(*(F.when(F.col("kind") == k, text) for k, text in enumerate(texts))).alias("geometry"))  # one text a row is made


@query(f"with recursive {_LAND_SQL} select g, polygons, rings, area from whole")
def polygon_union(spark, d):
    """The union of overlapping polygons of each group: polygons, rings and area."""
    figures = overlay.union_figures(_land(spark, d), "g", "geometry")
    return figures.select(F.col("grp").alias("g"), "polygons", "rings", F.round("area", 6).alias("area"))


@query(f"with recursive {_LAND_SQL} select g, polygons::int as polygons, rings::int as rings, area, true as valid from whole")
def polygon_union_text(spark, d):
    """The unions as text, read back and tested."""
    shapes = overlay.union_polygons(_land(spark, d), "g", "geometry").select("grp", geo.wkt_polygons(F.col("geometry")).alias("p"))
    m = geo.polygon_metrics(F.col("p"))
    return shapes.select(F.col("grp").alias("g"), F.size("p").alias("polygons"), F.size(F.flatten("p")).alias("rings"), F.round(m["area"], 6).alias("area"), m["valid"].alias("valid"))


#: Shapes by key: text around (k, k), area, centre and what is wrong with them.
_SHAPES = [
    ("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 3, 3 3, 3 1, 1 1))", 12.0, 2.0, 2.0, None),
    ("MULTIPOLYGON (((0 0, 2 0, 2 2, 0 2, 0 0)), ((5 0, 6 0, 6 1, 5 1, 5 0)))", 5.0, 1.9, 0.9, None),
    ("POLYGON ((0 0, 1 0, 1 1))", 0.5, 2 / 3, 1 / 3, "too few points"),
    ("POINT (1 -2.5)", 0.0, 1.0, -2.5, "too few points"),
    ("POLYGON ((0 0, 4 4, 4 0, 0 2, 0 0))", 4.0, 4.0, 2.0, "crossing"),
    ("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (5 5, 6 5, 6 6, 5 6, 5 5))", 15.0, 26.5 / 15, 26.5 / 15, "hole outside its shell"),
    ("MULTIPOLYGON (((0 0, 2 0, 2 2, 0 2, 0 0)), ((2 0, 3 0, 3 1, 2 1, 2 0)))", 5.0, 1.3, 0.9, "overlapping sides"),
    ("POLYGON ((0 0, 4 0, 4 4, 2 0, 0 4, 0 0))", 8.0, 2.0, 4 / 3, "ring touches itself"),
    ("POLYGON ((0 0, 4 0, 4 4, 0 4))", 8.0, 2.0, 2.0, "not closed"),
    ("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (0 2, 2 1, 4 2, 2 3, 0 2))", 12.0, 2.0, 2.0, "interior is not connected"),
]


def _shapes_sql() -> str:
    rows = ", ".join(f"({i}, {a!r}::double, {x!r}::double, {y!r}::double, {'null' if p is None else repr(p)})" for i, (_, a, x, y, p) in enumerate(_SHAPES) if i != 8)
    return f"(values {rows}) v(kind, area, x, y, reason)"


@query(f"select p_partkey as id, area, round(x + p_partkey, 6) as cx, round(y + p_partkey, 6) as cy, reason is null as valid, reason from part join {_shapes_sql()} on kind = p_partkey % 10")
def polygon_holes(spark, d):
    """Valid and broken shapes around each part's key: area and centre with holes, and validity with its reason."""
    texts = F.array(*(F.lit(s[0]) for s in _SHAPES))
    part = spread(table(spark, d, "part").where("p_partkey % 10 <> 8")).select("p_partkey", geo.wkt_polygons(F.get(texts, (F.col("p_partkey") % 10).cast("int"))).alias("p"))
    moved = F.transform("p", lambda rings: F.transform(rings, lambda ring: F.transform(ring, lambda v: F.struct((v["x"] + F.col("p_partkey")).alias("x"), (v["y"] + F.col("p_partkey")).alias("y")))))
    rows = part.select("p_partkey", moved.alias("p")).select("p_partkey", "p", validity.invalid_reason(F.col("p")).alias("reason"))
    rows = rows.select(F.col("p_partkey").alias("id"), geo.polygon_metrics(F.col("p"), F.col("reason")).alias("m"), "reason")
    return rows.select("id", *(F.round(f"m.{c}", 6).alias(c) for c in ("area", "cx", "cy")), "m.valid", "reason")


@query("select n_nationkey as id, round(n_nationkey * 100000.0::double / 6378137.0::double * 180 / pi(), 9) as lon, round((2 * atan(exp(n_nationkey * 100000.0::double / 6378137.0::double)) - pi() / 2) * 180 / pi(), 9) as lat from nation")
def reprojected(spark, d):
    metres = F.concat(F.lit("POINT ("), (F.col("n_nationkey") * 100000).cast("string"), F.lit(" "), (F.col("n_nationkey") * 100000).cast("string"), F.lit(")"))
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), metres.alias("geometry"))
    return ingest.with_geometry(rows, srid=3857).select("id", F.round(F.col("geometry")[0]["x"], 9).alias("lon"), F.round(F.col("geometry")[0]["y"], 9).alias("lat"))


#: UTM zone 23 south on SIRGAS 2000, as a shapefile declares it.
_PRJ = """PROJCS["SIRGAS_2000_UTM_Zone_23S",GEOGCS["GCS_SIRGAS_2000",DATUM["D_SIRGAS_2000",SPHEROID["GRS_1980",6378137.0,298.257222101]],PRIMEM["Greenwich",0.0],
UNIT["Degree",0.0174532925199433]],PROJECTION["Transverse_Mercator"],PARAMETER["False_Easting",500000.0],PARAMETER["False_Northing",10000000.0],
PARAMETER["Central_Meridian",-45.0],PARAMETER["Scale_Factor",0.9996],PARAMETER["Latitude_Of_Origin",0.0],UNIT["Meter",1.0]]"""
_PLACE = "(c_custkey * 7919 % 60000) / {0} - 48 as lon, -(c_custkey * 104729 % 330000) / {0} as lat"


@query(f"""with p as (select c_custkey as id, {_PLACE.format("10000.0::double")}, (1 / 298.257222101) / (2 - 1 / 298.257222101)::double as n from customer),
q as (select *, sin(radians(lat)) as s, radians(lon + 45) as l, 2 * sqrt(n) / (1 + n) as c from p), r as (select *, atanh(s) - c * atanh(c * s) as w from q), t as (select *, (exp(w) - exp(-w)) / 2 as t from r),
u as (select *, atan2(t, cos(l)) as u, atanh(sin(l) / sqrt(1 + t * t)) as v, 0.9996 * 6378137 / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) as k,
  [n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 + 41 * n ** 4 / 180, 13 * n ** 2 / 48 - 3 * n ** 3 / 5 + 557 * n ** 4 / 1440, 61 * n ** 3 / 240 - 103 * n ** 4 / 140, 49561 * n ** 4 / 161280] as a from t),
z as (select *, list_sum([a[j] * cos(2 * j * u) * (exp(2 * j * v) - exp(-2 * j * v)) / 2 for j in [1, 2, 3, 4]]) as de, list_sum([a[j] * sin(2 * j * u) * (exp(2 * j * v) + exp(-2 * j * v)) / 2 for j in [1, 2, 3, 4]]) as dn from u)
select id, round(500000 + k * (v + de), 3)::double as east, round(10000000 + k * (u + dn), 3)::double as north, round(lon, 9)::double as lon, round(lat, 9)::double as lat from z""")
def projected(spark, d):
    """Places in a national grid, and back to degrees by the text of a .prj file."""
    places = table(spark, d, "customer").selectExpr("c_custkey as id", *_PLACE.format("10000.0D").split(", "))
    east, north = projection.from_degrees(F.col("lon"), F.col("lat"), projection.of_srid(31983))
    flat = places.select("id", east.alias("east"), north.alias("north")).withColumn("geometry", F.array(F.struct(F.col("east").alias("x"), F.col("north").alias("y"))))
    back = ingest.with_geometry(flat, prj=_PRJ)
    return back.select("id", F.round("east", 3).alias("east"), F.round("north", 3).alias("north"), F.round(F.col("geometry")[0]["x"], 9).alias("lon"), F.round(F.col("geometry")[0]["y"], 9).alias("lat"))


@query("select last_day(date '2023-01-31' + to_months(n_nationkey::int))::varchar as t, n_nationkey as id from nation")
def month_ends(spark, d):
    """The period generator: month ends from a date on, one for each nation."""
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"))
    return rows.select(ingest.period("2023-01-31", F.col("id")).cast("string").alias("t"), "id")


@query(f"with keys as ({NATION_KEYS}) select key::varchar as region, 1.0::double as area, key % 5 + 0.5::double as cx, key // 5 + 0.5::double as cy, (key % 5)::double as min_x, (key // 5)::double as min_y, (key % 5 + 1)::double as max_x, (key // 5 + 1)::double as max_y from keys")
def geom_metrics(spark, d):
    return nation_geo(spark, d).select("region", geo.ring_metrics(geo.wkt_vertices(F.col("geometry"))).alias("m")).select("region", *(F.round(f"m.{c}", 9).alias(c) for c in ("area", "cx", "cy", "min_x", "min_y", "max_x", "max_y")))


# ---- weights --------------------------------------------------------------------------------------------------------


@query(f"with {edges_sql(NATION_KEYS, 5)} select * from edges")
def queen_edges(spark, d):
    return weights.queen_edges(nation_geo(spark, d))


_SHAKEN = "(({k} * 7 + {x} * 3 + {y}) % 5 - 2) * 1e-7"


@query(f"""with keys as ({SUPPLIER_KEYS}), corners as (select key::varchar as region, key % 10 + dx + {_SHAKEN.format(k='key', x='dx', y='dy')}::double as vx, key // 10 + dy + {_SHAKEN.format(k='key', x='dy', y='dx')}::double as vy from keys, (values (0), (1)) a(dx), (values (0), (1)) b(dy))
select distinct a.region, b.region as neighbor from corners a join corners b on a.region = b.region or (a.vx - b.vx) * (a.vx - b.vx) + (a.vy - b.vy) * (a.vy - b.vy) <= 3e-7::double * 3e-7::double""")
def queen_edges_within(spark, d):
    """Contiguity within a tolerance: squares whose corners are off by up to 2e-7."""
    keys = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k")).distinct()
    corner = lambda x, y: F.struct(F.expr(f"k % 10 + {x} + {_SHAKEN.format(k='k', x=x, y=y).replace('1e-7', '1e-7D')}").alias("x"), F.expr(f"k div 10 + {y} + {_SHAKEN.format(k='k', x=y, y=x).replace('1e-7', '1e-7D')}").alias("y"))
    shapes = keys.select(F.col("k").cast("string").alias("region"), F.array(*(corner(x, y) for x in (0, 1) for y in (0, 1))).alias("geometry"))
    return weights.queen_edges_within(shapes, 3e-7)


@query(f"with {edges_sql(SUPPLIER_KEYS, 10)} select region, count(*) as degree from edges group by 1")
def queen_degree(spark, d):
    return weights.queen_edges(supplier_geo(spark, d)).groupBy("region").agg(F.count("*").alias("degree"))


@query(f"with {edges_sql(NATION_KEYS, 5)} select region, neighbor, 1.0::double / count(*) over (partition by region) as weight from edges")
def row_std_weights(spark, d):
    return weights.standardised(weights.queen_edges(nation_geo(spark, d)))


@query(f"with {edges_sql(NATION_KEYS, 5)} select count(distinct region) as n, count(*) / count(distinct region)::double as mean_neighbors from edges")
def graph_stats(spark, d):
    return weights.graph_stats(weights.queen_edges(nation_geo(spark, d)))


@query(f"""with {edges_sql(NATION_KEYS, 5)}, w as (select *, 1.0::double / count(*) over (partition by region) as weight from edges)
select region, t.range::int as t_idx, neighbor, (t.range - l.range)::int as nb_t, weight from w, range(0, 6) t, range(0, 2) l where t.range >= l.range""")
def spacetime_edges(spark, d):
    return weights.spacetime_edges(weights.queen_edges(nation_geo(spark, d)), 6, 1)


# ---- Gi* ------------------------------------------------------------------------------------------------------------


def _gi(cells, edges, k):
    out = gistar.gi_star(cube.keyed(cells), edges, k)
    return out.select("region", F.col("t").cast("string").alias("t"), F.round("gi", 6).alias("gi"))


def _gi_sql(source, keys, width, k):
    return f"with {source}, {edges_sql(keys, width)}, {KEYED}, {gi_sql(k)} select region, t::varchar as t, round(gi, 6) + 0.0 as gi from gi"


@query(f"with {NQ}, {KEYED.split(', near')[0]} select b::int as b, count(*) as n, round(avg(x), 6) as mean, round(var_pop(x), 6) as var from placed group by b")
def slice_stats(spark, d):
    return gistar.slice_stats(cube.keyed(nq(spark, d))).select("b", "n", F.round("mean", 6).alias("mean"), F.round("var", 6).alias("var"))


@query(f"with {NQ}, {edges_sql(NATION_KEYS, 5)}, {KEYED}, {gi_sql(1)} select r, b::int as b, s, m from gi")
def spatial_lag_sum(spark, d):
    obs = cube.keyed(nq(spark, d))
    return gistar.gi_star(obs, weights.queen_edges(nation_geo(spark, d)), 1).select("r", "b", "s", "m")


@query(_gi_sql(NY, NATION_KEYS, 5, 0))
def gi_star_k0(spark, d):
    return _gi(ny(spark, d), weights.queen_edges(nation_geo(spark, d)), 0)


@query(_gi_sql(NQ, NATION_KEYS, 5, 1))
def gi_star_k1(spark, d):
    return _gi(nq(spark, d), weights.queen_edges(nation_geo(spark, d)), 1)


@query(_gi_sql(SY, SUPPLIER_KEYS, 10, 2))
def gi_star_k2(spark, d):
    return _gi(sy(spark, d), weights.queen_edges(supplier_geo(spark, d)), 2)


POSITIONAL = f"""{UD}, {edges_sql(USER_KEYS, 15)},
cube as (select count(distinct region) as l, count(distinct t) as q from obs),
ordered as (select region, t, x, row_number() over (order by t, region, x) - 1 as idx from obs),
firsts as (select region, row_number() over (order by min(t), region) - 1 as slot from obs group by region),
placed as (select region, t, x, idx % l as r, idx // l as b from ordered, cube where idx < l * q),
near as (select a.slot as region, c.slot as neighbor from edges e join firsts a on a.region = e.region join firsts c on c.region = e.neighbor),
{gi_sql(1)}"""


@query(f"with {POSITIONAL} select region, t::varchar as t, round(gi, 6) + 0.0 as gi from gi")
def gi_star_positional_gaps(spark, d):
    cells, edges = ud(spark, d), weights.queen_edges(user_geo(spark, d))
    names = cube.slots(cells)
    near = edges.join(names, "region").join(names.select(F.col("region").alias("neighbor"), F.col("slot").alias("nb")), "neighbor").select(F.col("slot").alias("region"), F.col("nb").alias("neighbor"))
    return gistar.gi_star(cube.positional(cells), near, 1).select("region", F.col("t").cast("string").alias("t"), F.round("gi", 6).alias("gi"))


def _scrambled_sql(name: str, source: str, column: str) -> str:
    """Tables name0, name1, ...: source with column scrambled, a round at a time."""
    out, now = [], source
    for k, c in enumerate(permute.ROUNDS):
        x = column
        out.append(f"{name}{k} as (select * replace (({x} * {x} % {permute.P} * ({x} * {x} % {permute.P}) % {permute.P} * {x} + {c}) % {permute.P} as {x}) from {now})")
        now = f"{name}{k}"
    return ", ".join(out)


def draws_sql(nsim: int, number: str = "row_number() over (order by r) - 1", seed: int = 77) -> str:
    """gi to cells, numbered, and draws (o, sim, j)."""
    p, last = permute.P, len(permute.ROUNDS) - 1
    values = ", ".join(f"({d + 1}, {a}::bigint, {b}::bigint)" for d, (a, b) in enumerate(permute.powers(64).T.tolist()))
    return f"""shape as (select count(distinct r) as regions, max(b) + 1 as times from gi),
names as (select r, {number} as r_idx from (select distinct r from gi)),
cells as (select g.*, b * regions + r_idx as o, regions * times as total from gi g join names using (r), shape),
seeds as (select o, m, total, (o % {p} * 16807 + o // {p} * 69621 + {(seed * 40692 + 1) % p}) % {p} as k from cells), {_scrambled_sql("seed", "seeds", "k")},
begun as (select o, m, total, sim.range as sim, (k + sim.range * {permute.STEPS[0]}) % {p} as s0, (k + sim.range * {permute.STEPS[1]} + 1) % {p} as s1 from seed{last}, range(1, {nsim} + 1) sim),
{_scrambled_sql("one", "begun", "s0")}, {_scrambled_sql("two", f"one{last}", "s1")},
steps(d, a, e) as (values {values}),
made as (select o, m, sim, d, (o + 1 + ((s0 % {p - 1} + 1) * a % {p} * {p} + (s1 % {p - 1} + 1) * e % {p}) % (total - 1)) % total as j
  from two{last} join steps on d <= m + 16 + (2 * m * m + total - 1) // total),
firstmade as (select o, m, sim, j, min(d) as d from made group by 1, 2, 3, 4),
draws as (select o, sim, j from (select *, row_number() over (partition by o, sim order by d) as k from firstmade) where k <= m)"""


P_SIM = """sims as (select d.o, d.sim, coalesce(sum(v.x), 0) as sim_s, count(v.x) as sim_m from draws d left join cells v on v.o = d.j group by 1, 2),
zs as (select c.o, c.s, c.gi, sim_s, n > m and var > 0 and sim_m = m as alike, case when n > sim_m and sim_m > 0 and var > 0 then (sim_s - sim_m * mean) / sqrt(var * sim_m * (n - sim_m) / (n - 1)) else 0 end as z from sims join cells c using (o)),
tails as (select o, count(*) filter (case when alike then sim_s >= s else z >= gi end) + 1 as upper, count(*) filter (case when alike then sim_s <= s else z <= gi end) + 1 as lower from zs group by 1),
p as (select cells.*, upper, lower, least(upper, lower) / ({nsim} + 1)::double as p_sim from cells join tails using (o))"""
_NY_GI = f"{NY}, {edges_sql(NATION_KEYS, 5)}, {KEYED}, {gi_sql(1)}"


@query(f"with {_NY_GI}, {draws_sql(9)} select o::bigint as o, sim::int as sim, j::bigint as j from draws")
def perm_samples(spark, d):
    gi = gistar.gi_star(cube.keyed(ny(spark, d)), weights.queen_edges(nation_geo(spark, d)), 1)
    return permute.draws(permute.numbered(gi), 9, 77).select(F.col("o").cast("bigint").alias("o"), "sim", F.col("j").cast("bigint").alias("j"))


def _ny_p(spark, d):
    return ehsa.gi_star_spacetime(ny(spark, d), weights.queen_edges(nation_geo(spark, d)), 1, 99, 77, "keyed", "native")


@query(f"with {_NY_GI}, {draws_sql(99)}, {P_SIM.format(nsim=99)} select region, t::int as t, upper::bigint as upper, lower::bigint as lower, round(p_sim, 9) as p_sim from p")
def p_sim(spark, d):
    return _ny_p(spark, d).select("region", "t", "upper", "lower", F.round("p_sim", 9).alias("p_sim"))


@query(ORACLE["p_sim"])
def p_sim_numpy(spark, d):
    """The same draws, looked up in the broadcast values."""
    out = ehsa.gi_star_spacetime(ny(spark, d), weights.queen_edges(nation_geo(spark, d)), 1, 99, 77, "keyed", "numpy")
    return out.select("region", "t", "upper", "lower", F.round("p_sim", 9).alias("p_sim"))


@query(ORACLE["p_sim"])
def p_sim_sharded(spark, d):
    """The same draws, looked up in shards of the values."""
    out = ehsa.gi_star_spacetime(ny(spark, d), weights.queen_edges(nation_geo(spark, d)), 1, 99, 77, "keyed", "sharded")
    return out.select("region", "t", "upper", "lower", F.round("p_sim", 9).alias("p_sim"))


@query(f"with {_NY_GI}, {draws_sql(99)}, {P_SIM.format(nsim=99)} select cluster, count(*) as n from (select case when p_sim <= 0.01::double and gi > 0 then 'Hot Spot' when p_sim <= 0.01::double and gi < 0 then 'Cold Spot' else 'Not Significant' end as cluster from p) group by 1")
def cluster_labels(spark, d):
    return _ny_p(spark, d).groupBy("cluster").agg(F.count("*").alias("n"))


# ---- trend ----------------------------------------------------------------------------------------------------------


def mk_sql(source: str) -> str:
    """source: rows (id, i, x) without NaN."""
    return f"""s as ({source}),
pairs as (select a.id, sum(case when abs(b.x - a.x) <= 1e-10::double then 0 when b.x > a.x then 1 else -1 end) as s from s a join s b on a.id = b.id and a.i < b.i group by 1),
size as (select id, count(*) as n, count(distinct x) as u from s group by 1),
groups as (select v.id, v.x, count(*) as t from (select distinct id, x from s) v join s y on y.id = v.id and abs(y.x - v.x) < 1e-10::double group by 1, 2),
ties as (select id, sum(t * (t - 1) * (2 * t + 5)) / 18.0::double as c from groups group by 1),
z as (select id, n, coalesce(s, 0) as s, n * (n - 1) // 2 as d, n * (n - 1) * (2 * n + 5) / 18.0::double - case when u < n then c else 0 end as v from size left join pairs using (id) left join ties using (id)),
q as (select *, case when v > 1e-10::double and s <> 0 then (abs(s) - 1) / sqrt(v) else 0 end as a from z),
phi as (select *, case when a >= 8.3::double then 1 else 0.5::double + exp(-a * a / 2) / 2.5066282746310002::double * list_sum([exp((2 * k + 1) * ln(greatest(a, 1e-300::double)) - list_sum([ln((2 * i + 1)::double) for i in range(0, k + 1)])) for k in range(0, 120)]) end as f from q),
mk as (select id, n, case when n <= 1 then 0 else round(s / d::double, 9) end as tau, case when n <= 1 or v <= 1e-10::double or s = 0 then 1.0::double else round(2 * (1 - f), 9) end as sl, s::int as s_stat, d::int as d_stat, round(case when n <= 1 then 0 else v end, 9) as var_s from phi)"""


def _mk(rows: DataFrame, test=trend.mann_kendall) -> DataFrame:
    return rows.select("id", F.size(F.filter("series", lambda v: v.isNotNull() & ~F.isnan(v))).cast("bigint").alias("n"), test(F.col("series")).alias("mk")).select(
        "id", "n", F.round("mk.tau", 9).alias("tau"), F.round("mk.sl", 9).alias("sl"), F.col("mk.S").alias("s_stat"), F.col("mk.D").alias("d_stat"), F.round("mk.varS", 9).alias("var_s")
    )


@query(f"with {NQ}, {mk_sql('select region as id, row_number() over (partition by region order by t) as i, x from obs')} select * from mk")
def mk_test(spark, d):
    return _mk(nq(spark, d).groupBy(F.col("region").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "x"))), lambda s: s["x"]).alias("series")))


#: Few different values, some of them less than the tolerance apart.
_TIES = "floor(value) % 5 + (event_id % 3) * 4e-11"


def _by_event(spark, d, value: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("id"), F.struct("event_id", F.expr(value).cast("double").alias("x")).alias("v"))
    return rows.groupBy("id").agg(F.transform(F.sort_array(F.collect_list("v")), lambda v: v["x"]).alias("series"))


@query("with " + mk_sql(f"select user_id::varchar as id, event_id as i, floor(value) % 5 + (event_id % 3) * 4e-11::double as x from events") + " select * from mk")
def mk_ties(spark, d):
    return _mk(_by_event(spark, d, _TIES.replace("4e-11", "4e-11D")))


@query("with " + mk_sql("select user_id::varchar as id, event_id as i, value::double as x from events where event_id % 5 > 1") + " select * from mk")
def mk_nan(spark, d):
    """Missing values, null or NaN, are left out."""
    return _mk(_by_event(spark, d, "case event_id % 5 when 0 then double('nan') when 1 then null else value end"))


@query("with h as (select event_type as id, date_trunc('hour', ts) as i, sum(floor(value))::double as x from events group by 1, 2), " + mk_sql("select * from h") + " select * replace (s_stat::bigint as s_stat, d_stat::bigint as d_stat) from mk")
def mk_long(spark, d):
    """Long series, the hours of each event type, by counting inversions."""
    hours = table(spark, d, "events").groupBy(F.col("event_type").alias("id"), F.date_trunc("hour", "ts").alias("t")).agg(F.sum(F.floor("value")).cast("double").alias("x"))
    series = hours.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "x"))), lambda v: v["x"]).alias("series"))
    return _mk(series, trend.mann_kendall_long)


# ---- classification -------------------------------------------------------------------------------------------------

#: Codes by period: H, C significant hot or cold, + and - not significant with that sign.
PATTERNS = [
    ("---------H", 0.2, 0.5), ("+++++++++C", -0.2, 0.5), ("-----HHHHH", 0.5, 0.5), ("+++++CCCCC", -0.5, 0.5), ("CCHHHHHHHH", 0.5, 0.5),
    ("HHHHHHHHHC", 0.9, 0.001), ("HHHHHHHHHH", 0.9, 0.001), ("CCCCCCCCCC", 0.9, 0.001), ("CCCCCCCCCC", -0.9, 0.001), ("HHHHHHHHHH", 0.1, 0.5),
    ("CCCCCCCCCC", 0.1, 0.5), ("CHHHHHHHHH", 0.1, 0.5), ("HHHHHHHHH-", 0.1, 0.5), ("HHHHHHHHHH", -0.9, 0.001), ("CCCCCCCCCC", 0.9, 0.01),
    ("HHHHHHHHHH", 0.9, 0.01), ("HCHC-+HC-H", 0.1, 0.5), ("HCHC-+HCHC", 0.1, 0.5), ("HHHHHHHHH-", -0.9, 0.001), ("CCCCCCCCC+", 0.9, 0.001),
    ("H--H--H---", 0.1, 0.5), ("C++C++C+++", 0.1, 0.5), ("H--CH-----", 0.1, 0.5), ("----------", 0.1, 0.5),
]

_CASE = """case when sig = 1 and ls and lg > 0 then 'new hotspot' when sig = 1 and ls and lg < 0 then 'new coldspot'
 when ls and lg > 0 and run = sig and 10 * hot < 9 * n then 'consecutive hotspot' when ls and lg < 0 and run = sig and 10 * cold < 9 * n then 'consecutive coldspot'
 when 10 * sig >= 9 * n and ls and tau > 0 and p < thr then 'intensifying hotspot' when 10 * cold >= 9 * n and ls and tau < 0 and p <= thr then 'intensifying coldspot'
 when 10 * hot >= 9 * n and p > thr then 'persistent hotspot' when 10 * cold >= 9 * n and p > thr then 'persistent coldspot'
 when 10 * hot >= 9 * n and ls and lg > 0 and tau < 0 and p <= thr then 'diminishing hotspot' when 10 * cold >= 9 * n and ls and tau > 0 and p <= thr then 'diminishing coldspot'
 when 10 * hot <= 9 * n and ls and lg > 0 and cold > 0 then 'oscilating hotspot' when 10 * cold < 9 * n and ls and lg < 0 and hot > 0 then 'oscilating coldspot'
 when 10 * hot >= 9 * n and lg < 0 then 'historical hotspot' when 10 * cold >= 9 * n and lg > 0 then 'historical coldspot'
 when 10 * hot < 9 * n and cold = 0 and hot > 0 then 'sporadic hotspot' when 10 * cold < 9 * n and hot = 0 and cold > 0 then 'sporadic coldspot' else 'no pattern detected' end"""


def _pattern_values() -> str:
    return "(values " + ", ".join(f"({i}, '{c}', {t}::double, {p}::double)" for i, (c, t, p) in enumerate(PATTERNS)) + ") v(id, code, tau, p)"


def labels_of_codes(rows: DataFrame) -> DataFrame:
    """(id, classification) for (id, code, tau, p), a code having one letter for each period."""
    count = lambda kind: F.length(F.regexp_replace("code", f"[^{kind}]", ""))
    last = F.substring("code", -1, 1)
    return rows.select("id", classify.label(n=F.length("code"), sig=count("HC"), hot=count("H"), cold=count("C"), run=F.length(F.regexp_extract("code", "([HC]*)$", 1)), last_sig=last.isin("H", "C"), last=F.when(last.isin("H", "+"), 1).otherwise(-1), tau=F.col("tau"), p=F.col("p")).alias("classification"))


_PLANTED = f"""users as (select user_id, count(*) as k from events group by 1), planted as (select user_id, substr(code, (1 + k % 3)::int) || substr(code, 1, (k % 3)::int) as code, tau, p from users join {_pattern_values()} on id = user_id % {len(PATTERNS)})"""


def _patterns(spark) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(i, c, t, p) for i, (c, t, p) in enumerate(PATTERNS)], "pattern int, code string, tau double, p double"))  # one row for each pattern


@query(f"""with {_PLANTED}, f as (select user_id as id, code, tau, p, 0.01::double as thr, length(code) as n, length(regexp_replace(code, '[-+]', '', 'g')) as sig, length(regexp_replace(code, '[^H]', '', 'g')) as hot,
 length(regexp_replace(code, '[^C]', '', 'g')) as cold, right(code, 1) in ('H', 'C') as ls, case when right(code, 1) in ('H', '+') then 1 else -1 end as lg, length(regexp_extract(code, '[HC]*$')) as run from planted)
select id, {_CASE} as classification from f""")
def classify_rules(spark, d):
    """The rules alone: each user has a pattern, turned by the number of its events, and that pattern's trend."""
    users = table(spark, d, "events").groupBy("user_id").agg((F.count("*") % 3).cast("int").alias("k"))
    rows = users.join(_patterns(spark), F.col("user_id") % len(PATTERNS) == F.col("pattern")).select(F.col("user_id").alias("id"), F.concat(F.substr("code", F.col("k") + 1), F.substr("code", F.lit(1), F.col("k"))).alias("code"), "tau", "p")
    return labels_of_codes(rows)


#: Gi* of a slot of a pattern: its sign, with the pattern's trend, or going up and down.
_SLOT_GI = "case when {c} in ('H', '+') then 1.0 else -1.0 end + case when p < 0.01 and tau > 0 then 0.05 * t when p < 0.01 then -0.05 * t else 0.05 * (t % 2) end"
_MADE = f"""slots as (select distinct user_id, event_id % 10 as t from events),
p as (select user_id::varchar as region, t, ({_SLOT_GI.format(c="substr(code, t::int + 1, 1)")})::double as gi, case when substr(code, t::int + 1, 1) in ('H', 'C') then 0.001::double else 0.5::double end as p_sim, 1.0::double as x
  from slots join {_pattern_values()} on id = user_id % {len(PATTERNS)})"""


@query()
def label_cube(spark, d):
    """All labels, from a cube: the slots that a user's events fall into, with a planted pattern's signs and trend."""
    slots = table(spark, d, "events").select("user_id", (F.col("event_id") % 10).cast("int").alias("t")).distinct()
    made = slots.join(_patterns(spark), F.col("user_id") % len(PATTERNS) == F.col("pattern")).withColumn("c", F.substr("code", F.col("t") + 1, F.lit(1)))
    rows = made.select(F.col("user_id").cast("string").alias("region"), "t", F.expr(_SLOT_GI.format(c="c")).cast("double").alias("gi"), F.when(F.col("c").isin("H", "C"), 0.001).otherwise(0.5).alias("p_sim"))
    done = classify.classified(classify.region_figures(rows))
    return done.select("region", "classification", F.round("tau", 6).alias("tau"), "n_sig")


@query(f"""with {NQ}, m as (select region, t, x, x > avg(x) over (partition by region) as sig from obs), r as (select *, row_number() over (partition by region order by t) as pos from m)
select region, (count(*) - coalesce(max(case when not sig then pos end), 0))::int as run, count(*) filter (sig) as n_sig from r group by 1""")
def trailing_run(spark, d):
    mean = nq(spark, d).groupBy("region").agg(F.avg("x").alias("mean"))
    rows = nq(spark, d).join(mean, "region").select("region", "t", F.lit(1.0).alias("gi"), F.when(F.col("x") > F.col("mean"), 0.0).otherwise(1.0).alias("p_sim"))
    return classify.region_figures(rows).select("region", F.col("run").cast("int").alias("run"), "n_sig")


#: A cube with a planted signal: nation orders, tenfold in the last years of the regions of one corner.
BOOST = "case when (cast(region as int) % 5) >= 3 and (cast(region as int) // 5) >= 3 and t >= 1998 then 10 * x else x end"
_BOOSTED = f"raw as ({NY.partition('as (')[2]}, obs as (select region, t, {BOOST} as x from raw)"


def boosted(spark, d):
    return ny(spark, d).select("region", "t", F.expr(BOOST.replace("//", "div")).alias("x"))


LABELLED = f"""{mk_sql('select region as id, pos as i, gi as x from series')},
f as (select region, count(*) as n, count(*) filter (p_sim <= 0.01::double) as sig, count(*) filter (p_sim <= 0.01::double and gi > 0) as hot, count(*) filter (p_sim <= 0.01::double and gi < 0) as cold,
 arg_max(p_sim, t) <= 0.01::double as ls, arg_max(gi, t) as lg, count(*) - coalesce(max(case when p_sim > 0.01::double then pos end), 0) as run from series group by 1),
done as (select f.*, {_CASE.replace('thr', '0.01::double').replace(' p ', ' mk.sl ').replace('tau', 'mk.tau')} as classification, mk.tau, mk.sl as p_value, sig as n_sig from f join (select id, tau, sl from mk) mk on mk.id = region)"""
_SERIES = "series as (select *, row_number() over (partition by region order by t) as pos from p)"
ORACLE["label_cube"] = f"with {_MADE}, {_SERIES}, {LABELLED} select region, classification, round(tau, 6) + 0.0 as tau, n_sig from done"
_EHSA = f"{_BOOSTED}, {edges_sql(NATION_KEYS, 5)}, {KEYED}, {gi_sql(1)}, {draws_sql(99)}, {P_SIM.format(nsim=99)}, {_SERIES}, {LABELLED}"


def _analysis(spark, d):
    rows = boosted(spark, d).join(nation_geo(spark, d), "region")
    return ehsa.emerging_hotspot_analysis(rows, "region", "t", "x", k=1, nsim=99, gap_policy="keyed", backend="native")


@query(f"with {_EHSA} select region, classification, round(tau, 6) as tau, round(p_value, 6) as p_value, n_sig from done")
def ehsa_full(spark, d):
    out = _analysis(spark, d)
    return out.select("region", "classification", F.round("tau", 6).alias("tau"), F.round("p_value", 6).alias("p_value"), F.size(F.filter("classification_details.values_at_decision.significance_series", lambda s: s)).cast("bigint").alias("n_sig"))


@query(f"""with {_EHSA}, degrees as (select region, count(*) as degree from edges group by 1),
 each as (select region, string_agg(printf('%d:%.4f:%s', pos::int, round(gi, 4) + 0.0, case when p_sim <= 0.01::double then 'true' else 'false' end), ' ' order by t) as told, sum(x) as total from series group by 1)
select done.region, classification, n::int as periods, told, total, round(p_value, 6) as sl, round(tau, 6) as tau, degree, 1.0::double / degree as weight,
 case when classification = 'no pattern detected' then 0 when classification like 'consecutive%' then 4 when classification like 'persistent%' or classification like 'historical%' or classification like 'new%' then 2 else 3 end::int as criteria
from done join degrees on degrees.region = done.region join each on each.region = done.region""")
def ehsa_nested(spark, d):
    """The nested result, read field by field."""
    out = _analysis(spark, d)
    told = F.zip_with("classification_details.values_at_decision.gi_star_series", "classification_details.values_at_decision.significance_series", lambda g, s: F.struct(g.alias("g"), s.alias("s")))
    told = F.transform(told, lambda v, i: F.concat((i + 1).cast("string"), F.lit(":"), F.format_string("%.4f", v["g"] + 0.0), F.lit(":"), v["s"].cast("string")))
    return out.select(
        "region", "classification", F.col("classification_details.values_at_decision.num_time_periods").alias("periods"), F.concat_ws(" ", told).alias("told"),
        F.aggregate("location_data", F.lit(0.0), lambda a, v: a + v["original_value"]).alias("total"), F.round("mann_kendall_details.results.sl", 6).alias("sl"), F.round("mann_kendall_details.results.tau", 6).alias("tau"),
        F.size("spatial_context_summary.neighbors_config").cast("bigint").alias("degree"), F.element_at("spatial_context_summary.weights_config", 1).alias("weight"), F.size("classification_details.criteria_met").alias("criteria"),
    )


@query(f"""with {_EHSA} select region, classification, case classification
 when 'no pattern detected' then 'No pattern''s conditions hold.'
 when 'new hotspot' then printf('%d of %d periods are significant', sig, n) when 'new coldspot' then printf('%d of %d periods are significant', sig, n)
 when 'sporadic hotspot' then printf('%d of %d periods are significantly hot', hot, n) when 'sporadic coldspot' then printf('%d of %d periods are significantly cold', cold, n)
 when 'oscilating hotspot' then printf('Gi* of the last period: %.4f, significant: True', lg) when 'oscilating coldspot' then printf('Gi* of the last period: %.4f, significant: True', lg)
 when 'consecutive hotspot' then printf('Gi* of the last period: %.4f, significant: True', lg) when 'consecutive coldspot' then printf('Gi* of the last period: %.4f, significant: True', lg)
 when 'intensifying hotspot' then printf('share of significant periods: %.2f (limit 0.90)', sig / n::double)
 else printf('share of significantly ' || case when classification like '%hotspot' then 'hot' else 'cold' end || ' periods: %.2f (limit 0.90)', case when classification like '%hotspot' then hot else cold end / n::double) end as fact from done""")
def ehsa_reasons(spark, d):
    """The first deciding figure of each region's label, or the reason where none holds."""
    details = F.col("classification_details")
    return _analysis(spark, d).select("region", "classification", F.coalesce(F.get(details["criteria_met"], F.lit(0)), details["reason"]).alias("fact"))


@query("""with n as (select n_nationkey as k from nation), t as (select range as t from range(0, 3))
select k::varchar as region, case when k % 5 = 0 then 'error_processing' else 'no pattern detected' end as classification, case when k % 5 = 0 then 'not a WKT geometry: POINT (' || k || ' 0' end as message, 3::bigint as periods from n""")
def ehsa_error_rows(spark, d):
    """Regions whose geometry cannot be read are rows of their own kind; the others are analysed."""
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    shape = F.concat(F.lit("POINT ("), F.col("k"), F.lit(" 0"), F.when(F.col("k") % 5 == 0, "").otherwise(")"))
    rows = nation.select(F.col("k").cast("string").alias("region"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("t"), F.lit(1.0).alias("x"), shape.alias("geometry"))
    out = ehsa.emerging_hotspot_analysis(rows, "region", "t", "x", nsim=9)
    return out.select("region", "classification", F.col("classification_details.error_message").alias("message"), F.size("location_data").cast("bigint").alias("periods"))


_GAPS = f"{POSITIONAL}, {draws_sql(99, 'r')}, {P_SIM.format(nsim=99)}, {_SERIES}, {LABELLED}"


@query(f"with {_GAPS} select region, classification, round(tau, 6) + 0.0 as tau, round(p_value, 6) as p_value from done")
def ehsa_positional_gaps(spark, d):
    """The pipeline over a cube with gaps, by place, with the default backend."""
    rows = ud(spark, d).join(user_geo(spark, d), "region")
    out = ehsa.emerging_hotspot_analysis(rows, "region", "t", "x", k=1, nsim=99)
    return out.select("region", "classification", F.round("tau", 6).alias("tau"), F.round("p_value", 6).alias("p_value"))


_SUPPLIERS = f"{SY}, {edges_sql(SUPPLIER_KEYS, 10)}, {KEYED}, {gi_sql(1)}, {draws_sql(99)}, {P_SIM.format(nsim=99)}, {_SERIES}, {LABELLED}"


@query(f"with {_SUPPLIERS} select region, classification, round(tau, 6) + 0.0 as tau, round(p_value, 6) as p_value from done")
def ehsa_supplier_year(spark, d):
    """The pipeline over suppliers and years, all quantities shipped."""
    rows = sy(spark, d).join(supplier_geo(spark, d), "region")
    out = ehsa.emerging_hotspot_analysis(rows, "region", "t", "x", k=1, nsim=99, gap_policy="keyed")
    return out.select("region", "classification", F.round("tau", 6).alias("tau"), F.round("p_value", 6).alias("p_value"))


@query(f"with {_NY_GI}, {draws_sql(99)}, {P_SIM.format(nsim=99)} select count(*) as cells, count(*) filter (p_sim <= 0.01::double) as at_0_01, count(*) filter (p_sim <= 0.05::double) as at_0_05 from p")
def significance_counts(spark, d):
    return gistar.significance_counts(_ny_p(spark, d))


@query(f"with {_EHSA} select classification, count(*) as regions, round(100.0::double * count(*) / sum(count(*)) over (), 6) as percent from done group by 1")
def label_distribution(spark, d):
    return classify.label_distribution(_analysis(spark, d)).select("classification", "regions", F.round("percent", 6).alias("percent"))


@query(f"with {_EHSA} select count(*) as n, round(avg(tau), 6) as mean, round(stddev_samp(tau), 6) as std, round(min(tau), 6) as low, round(max(tau), 6) as high from done")
def tau_describe(spark, d):
    return classify.describe_tau(_analysis(spark, d)).select("n", *(F.round(c, 6).alias(c) for c in ("mean", "std", "low", "high")))


@query(f"with {NY}, {edges_sql(NATION_KEYS, 5)}, {KEYED}, {gi_sql(1)} select region, b::int as pos, t::varchar as time_period, x as original_value, round(gi, 6) + 0.0 as value from gi")
def location_series(spark, d):
    rows = ny(spark, d).join(nation_geo(spark, d), "region")
    out = ehsa.emerging_hotspot_analysis(rows, "region", "t", "x", k=1, nsim=9, gap_policy="keyed", backend="native")
    return out.select("region", F.posexplode("location_data").alias("pos", "s")).select("region", "pos", "s.time_period", "s.original_value", F.round("s.value", 6).alias("value"))


@query("select region, coalesce(nullif(concat_ws(',', list_sort(list(neighbor))), ''), '') as near from (with " + edges_sql(NATION_KEYS, 5) + " select * from edges) group by 1")
def spatial_context(spark, d):
    return _analysis(spark, d).select("region", F.concat_ws(",", "spatial_context_summary.neighbors_config").alias("near"))


# ---- sources, sinks, text -------------------------------------------------------------------------------------------

#: What a cell may begin with: what spreadsheets take for a formula, and what they do not.
_STARTS = ["=1+", "-", "|", "", "+", "@", "\t", "\r", "\n", " ", "a=", "'"]
_CELL_SQL = "case p_partkey % 12 " + " ".join(f"when {i} then {' || '.join(f'chr({ord(c)})' for c in s) or repr('')}" for i, s in enumerate(_STARTS)) + " end || p_partkey"


@query(f"select p_partkey as id, case when left(cell, 1) in ('=', '+', '-', '@', chr(9), chr(13), chr(10), '|') then chr(39) || cell else cell end as cell from (select p_partkey, {_CELL_SQL} as cell from part)")
def csv_sanitize(spark, d):
    cell = F.concat(F.get(F.array(*map(F.lit, _STARTS)), (F.col("p_partkey") % 12).cast("int")), F.col("p_partkey").cast("string"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), numeric.formula_guard(cell).alias("cell"))


@query("select regexp_replace(n_name || '</ScRipt>', '(?i)</script>', '<' || chr(92) || chr(92) || '/script>', 'g') as s from nation")
def script_escape(spark, d):
    return table(spark, d, "nation").select(numeric.script_escape(F.concat("n_name", F.lit("</ScRipt>"))).alias("s"))


@query("""with s as (select n_nationkey as id, (n_nationkey * n_nationkey) / 4.0::double as span from nation),
b as (select id, span, case when span <= 0 then 12 else greatest(4, least(12, 9 - log2(greatest(span, 1e-300::double)))) end::double as z from s)
select id, round(case when span < 0.01::double then least(12, z + 1) when span > 100 then greatest(4, z - 1) else z end, 9)::double as zoom from b""")
def map_zoom(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.round(numeric.map_zoom(F.col("n_nationkey") * F.col("n_nationkey") / F.lit(4.0)), 9).alias("zoom"))


@query("select n_nationkey as id, 'Region ID: ' || n_name || '<br>Classification: none<br>Tau: 0.2500<br>P-value: ' || printf('%.4f', n_nationkey / 25.0::double) as hover from nation")
def hover_text(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), numeric.hover_text(F.col("n_name"), F.lit("none"), F.lit(0.25), F.col("n_nationkey") / F.lit(25.0)).alias("hover"))


@query(f"""with {_EHSA}, spots as (select region, classification, (region::int % 5)::double as x, (region::int // 5)::double as y from done)
select '{{"type":"Feature","geometry":{{"type":"Polygon","coordinates":[[' || array_to_string([printf('[%.1f,%.1f]', x + a, y + b) for a, b in [(0, 0)]] || [printf('[%.1f,%.1f]', x + 1, y), printf('[%.1f,%.1f]', x + 1, y + 1), printf('[%.1f,%.1f]', x, y + 1), printf('[%.1f,%.1f]', x, y)], ',') || ']]}},"properties":{{"region":"' || region || '","classification":"' || classification || '"}}}}' as feature from spots""".replace("[printf('[%.1f,%.1f]', x + a, y + b) for a, b in [(0, 0)]]", "[printf('[%.1f,%.1f]', x, y)]"))
def geojson_features(spark, d):
    return export.features(_analysis(spark, d).select("region", "classification").join(nation_geo(spark, d), "region"))


@query(f"""with {_EHSA} select region, classification, case when round(tau, 6) < 0 then chr(39) else '' end || printf('%.6f', round(tau, 6) + 0.0) as tau, '{{"sig":' || n_sig || ',"periods":' || n || '}}' as nested from done""")
def guarded_export(spark, d):
    """Text that no spreadsheet takes for a formula; nested columns are JSON."""
    out = _analysis(spark, d).select("region", "classification", F.format_string("%.6f", F.round("tau", 6) + 0.0).alias("tau"), F.struct(F.size(F.filter("classification_details.values_at_decision.significance_series", lambda s: s)).alias("sig"), F.col("classification_details.values_at_decision.num_time_periods").alias("periods")).alias("nested"))
    return export.guarded(out)


def _shapefiles(spark, rows: DataFrame) -> DataFrame:
    """(key, geometry) rows written as shapefiles by their tasks, and read back."""
    spark.dataSource.register(shapefile_source.ShapefileSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    folder = fresh_folder(spark, "shapes")
    rows.write.format("shapefile").mode("append").save(folder)
    return spark.read.format("shapefile").load(folder)


@query("select n_nationkey as key, 1.0::double as area, n_nationkey % 5 + 0.5::double as cx, n_nationkey // 5 + 0.5::double as cy, true as valid from nation")
def shapefile_read(spark, d):
    """The nations' squares through the shapefile format."""
    rows = _shapefiles(spark, nation_geo(spark, d).withColumnRenamed("region", "KEY"))
    m = geo.polygon_metrics(geo.wkt_polygons(F.col("geometry")))
    return rows.select(F.col("attributes")["KEY"].cast("int").alias("key"), *(m[c].alias(c) for c in ("area", "cx", "cy", "valid")))


@query(f"""with b as (select id, x, y, kind, s, (x + case kind when 0 then s when 1 then 3 + s when 2 then s + 1 else 4 end)::double as max_x, (y + case kind when 1 then 3 - s else 0 end)::double as min_y,
 case kind when 0 then s * s when 1 then 2 * s * s when 2 then (s + 1) * (s + 1) / 2.0 else 12 end::double as area from ({_LAND}))
select id, max_x, min_y, area from b where max_x > 20 and min_y <= 30""")
def shapefile_filtered(spark, d):
    """Overlapping shapes from shapefiles by a part of their bounding box, which the source looks at before it parses them."""
    rows = _shapefiles(spark, _land(spark, d).select("id", "geometry")).where("max_x > 20 and min_y <= 30")
    area = geo.polygon_metrics(geo.wkt_polygons(F.col("geometry")))["area"]
    return rows.select(F.col("attributes")["id"].cast("bigint").alias("id"), "max_x", "min_y", F.round(area, 6).alias("area"))


@query("select n_nationkey::varchar as \"N_NATIONKEY\", n_name as \"N_NAME\", '{\"a\":' || n_nationkey || '}' as \"NESTED\" from nation")
def csv_round_trip(spark, d):
    """Written as CSV with nested columns as JSON, and read with a separator found in the header."""
    folder = fresh_folder(spark, "csv")
    export.write_csv(table(spark, d, "nation").select("n_nationkey", "n_name", F.struct(F.col("n_nationkey").alias("a")).alias("nested")), folder)
    return ingest.read_table(spark, folder)


@query("""with t as (select distinct user_id, date_trunc('week', ts) as t from events), kept as (select * from t where user_id % 4 > 0 or t = (select min(t) from t u where u.user_id = t.user_id)),
f as (select user_id, count(*) as n from kept group by 1)
select user_id::varchar as region, case when n <= 1 then 'skipped_insufficient_data' when user_id % 4 = 1 then 'skipped_all_nan' else 'no pattern detected' end as classification,
 case when n <= 1 then 'There is at most one time period.' when user_id % 4 = 1 then 'All Gi* values are missing.' else 'No pattern''s conditions hold.' end as reason, n <= 1 or user_id % 4 = 1 as no_trend from f""")
def skipped_regions(spark, d):
    """Users with one period, and with no value at all: weeks with events, cut to the first, or with their Gi* missing."""
    kind = F.col("user_id") % 4
    weeks = table(spark, d, "events").select("user_id", F.date_trunc("week", "ts").alias("t")).distinct()
    weeks = weeks.withColumn("first", F.min("t").over(Window.partitionBy("user_id"))).where((kind > 0) | (F.col("t") == F.col("first")))
    gi = F.when(kind == 1, F.when(F.col("t") == F.col("first"), F.lit(float("nan")))).when((kind == 2) & (F.col("t") == F.col("first")), None).otherwise(0.5)
    rows = weeks.select(F.col("user_id").cast("string").alias("region"), "t", gi.alias("gi"), F.lit(1.0).alias("p_sim"))
    none = rows.select("region", F.col("region").alias("neighbor"))
    return classify.result(classify.classified(classify.region_figures(rows)), none.distinct()).select("region", "classification", F.col("classification_details.reason").alias("reason"), (F.isnan("tau") & F.col("mann_kendall_details").isNull()).alias("no_trend"))


@query("""select n_nationkey as id, '{"id":' || n_nationkey || ',"inner":{"a":1,"list":[{"b":"' || n_name || '"}]},"map":{"kept":2}}' as record from nation""")
def json_records(spark, d):
    """Keys that a script could take for object machinery are left out at any depth."""
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.expr("named_struct('a', 1, '__proto__', 'x', 'list', array(named_struct('constructor', 1, 'b', n_name)))").alias("inner"), F.expr("map('kept', 2, 'prototype', 3)").alias("map"), F.lit(1).alias("constructor"))
    return rows.select("id").join(export.records(rows).withColumn("id", F.get_json_object("record", "$.id").cast("int")), "id")


@query(f"with {_EHSA} select region, classification, (region::int % 5 + 0.5)::double as cx, (region::int // 5 + 0.5)::double as cy from done")
def map_frame(spark, d):
    return export.map_frame(_analysis(spark, d).join(nation_geo(spark, d), "region"), "region").select("region", "classification", F.round("cx", 9).alias("cx"), F.round("cy", 9).alias("cy"))


#: Squares of several sizes around places made of customer keys, with labels in turn.
_SQUARES = {"x": "cast(c_custkey * 17 % 211 as double)", "y": "cast(c_custkey * 29 % 199 as double)", "side": "cast(case when c_custkey % 50 = 0 then 40 else (1 + c_custkey % 3) / 4.0 end as double)", "code": "cast(c_custkey % 17 as int)"}
_TILES_SQL = f"""r as (select c_custkey as k, {", ".join(f"{e} as {n}" for n, e in _SQUARES.items())} from customer),
m as (select min(x) as x0, min(y) as y0, greatest(max(x + side) - min(x), max(y + side) - min(y)) as span, count(*) as regions from r),
deep as (select count(*)::int as levels from m, range(0, 16) t(z) where (256::bigint << (2 * z)::int) < regions),
g as (select k, code, floor((x - x0) / span * 268435456)::bigint as w, floor((y - y0) / span * 268435456)::bigint as s, floor((x + side - x0) / span * 268435456)::bigint as e, floor((y + side - y0) / span * 268435456)::bigint as n from r, m),
h as (select *, case when greatest(e - w, n - s) < 2 then 0 else length(bin(greatest(e - w, n - s) - 1)) end as bits from g),
l as (select h.*, z::int as z, least(levels, 28 - bits) as home, z < least(levels, 28 - bits) and bits <= 22 - z as dot from h, deep, range(0, 17) t(z) where z <= least(levels, 28 - bits)),
steps as (select *, case when z = home then 0 else 18 - z end::int as f from l where not dot),
shapes as (select k, z, f, w, s, e, n, z = home as own, unnest(range(least(w >> (28 - z), (1 << z) - 1), least(e >> (28 - z), (1 << z) - 1) + 1)) as tx, least(s >> (28 - z), (1 << z) - 1) as ty0, least(n >> (28 - z), (1 << z) - 1) as ty1 from steps),
each as (select *, unnest(range(ty0, ty1 + 1)) as ty, case when f = 0 then 0 else 1::bigint << (f - 1) end as half from shapes),
drawn as (select z as level, tx::int as x, ty::int as y, case when own then 'own' else 'over' end as kind, count(*) as shapes, 0 as dots, count(*) as regions, sum(((e + half) >> f) - ((w + half) >> f))::bigint as wide, sum(((n + half) >> f) - ((s + half) >> f))::bigint as high, sum(((w + half) >> f) - (tx << (28 - z - f)))::bigint as lefts from each group by 1, 2, 3, 4),
cells as (select z, code, least(((w + e) // 2) >> (22 - z), (64 << z) - 1) as i, least(((s + n) // 2) >> (22 - z), (64 << z) - 1) as j from l where dot),
dotted as (select z as level, (i // 64)::int as x, (j // 64)::int as y, 'over' as kind, 0 as shapes, count(distinct (i, j, code)) as dots, count(*) as regions, 0 as wide, 0 as high, sum(distinct_i)::bigint as lefts from (select *, case when row_number() over (partition by z, i, j, code) = 1 then i % 64 else 0 end as distinct_i from cells) group by 1, 2, 3)"""


@query(f"""with {_TILES_SQL} select level, x, y, kind, sum(shapes)::bigint as shapes, sum(dots)::bigint as dots, sum(regions)::bigint as regions, sum(wide)::bigint as wide, sum(high)::bigint as high, sum(lefts)::bigint as lefts
from (select * from drawn union all select * from dotted) group by 1, 2, 3, 4""")
def map_tiles(spark, d):
    """The tiles of a map of squares of several sizes, written by tasks and read back: what each holds, and where."""
    labels = F.array(*map(F.lit, sorted(export.COLOURS)))
    rows = table(spark, d, "customer").selectExpr("c_custkey as region", *(f"{e} as {n}" for n, e in _SQUARES.items()))
    rows = rows.select("region", F.get(labels, F.col("code")).alias("classification"), F.lit(0.5).alias("tau"), F.lit(0.01).alias("p_value"), geo.box_wkt(F.col("x"), F.col("y"), F.col("x") + F.col("side"), F.col("y") + F.col("side")).alias("geometry"))
    folder = fresh_folder(spark, "tiles")
    tiles.write_tiles(rows, folder, "region")
    corners = lambda k: F.transform(F.flatten("g"), lambda p: p[k])
    wide = lambda k: F.array_max(corners(k)) - F.array_min(corners(k))
    dot = F.col("d").isNotNull()
    total = lambda v: F.coalesce(F.sum(v).cast("bigint"), F.lit(0).cast("bigint"))
    return tiles.read_tiles(spark, folder).groupBy("level", "x", "y", "kind").agg(F.count_if(~dot).alias("shapes"), F.count_if(dot).alias("dots"), total(F.coalesce("n", F.lit(1))).alias("regions"), total(wide(0)).alias("wide"), total(wide(1)).alias("high"), total(F.coalesce(F.col("d")[0], F.array_min(corners(0)))).alias("lefts"))




def _wide(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias(" dp_cod "), F.col("p_partkey").alias("latr01"), F.concat((F.col("p_partkey") * 3).cast("string"), F.lit(",5 R$")).alias("LATR02"), F.lit("x").alias("hom15"), F.col("p_partkey").alias("total"))


@query("""select p_partkey as "DP_COD", c as crime_year_code, v as occurrences from (select p_partkey, unnest(['LATR01', 'LATR02', 'HOM15']) as c, unnest([p_partkey::varchar, (p_partkey * 3)::varchar || ',5 R$', 'x']) as v from part)""")
def wide_to_long(spark, d):
    return ingest.unpivot_years(ingest.clean_header(_wide(spark, d)), ["DP_COD"])


@query("""select p_partkey as "DP_COD", unnest([2001, 2002, 2015]) as year, unnest([p_partkey::double, p_partkey * 3 + 0.5::double, 0.0::double]) as crime_total from part""")
def yearly_totals(spark, d):
    return ingest.yearly_totals(ingest.clean_header(_wide(spark, d)), ["DP_COD"])


@query("select n_nationkey as key, n_name as name, c.year, c.crime_total from nation left join (select s_nationkey as k, 2001 as year, count(*)::double as crime_total from supplier group by 1) c on c.k = n_nationkey")
def district_totals(spark, d):
    totals = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("key")).agg(F.count("*").cast("double").alias("crime_total")).withColumn("year", F.lit(2001))
    return ingest.join_districts(table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")), totals, "key").select("key", "name", "year", "crime_total")


@query(f"with {UD} select * from obs")
def events_tumbling_cube(spark, d):
    return stream.windowed(table(spark, d, "events"), "user_id")


@query(f"""with whole as (select user_id, ts from events), closed as (select max(ts) - interval 2 day as mark from whole),
obs as (select user_id::varchar as region, date_trunc('day', ts)::timestamp as t, count(*)::double as x from whole, closed where date_trunc('day', ts) + interval 1 day <= mark group by 1, 2),
{edges_sql(USER_KEYS, 15)}, {KEYED}, {gi_sql(1)} select region, t::varchar as t, x, round(gi, 6) + 0.0 as gi from gi""")
def gi_star_stream(spark, d):
    """Gi* of the days that a stream of the events closes, two days being the watermark."""
    source = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    scorer = stream.GiStarStream(staged(weights.queen_edges(user_geo(spark, d)), "edges"), fresh_folder(spark, "stream"))
    running = scorer.start(source, "user_id", fresh_folder(spark, "progress"), {"availableNow": True})
    running.awaitTermination()
    return scorer.scores(spark).select("region", F.to_utc_timestamp("t", F.current_timezone()).cast("string").alias("t"), "x", (F.round("gi", 6) + 0.0).alias("gi"))


@query(f"with {NQ} select count(distinct region) as regions, count(distinct t) as times, min(x) as low, max(x) as high, count(*) filter (x is null) as missing from obs")
def overview(spark, d):
    return nq(spark, d).agg(F.countDistinct("region").alias("regions"), F.countDistinct("t").alias("times"), F.min("x").alias("low"), F.max("x").alias("high"), F.count_if(F.col("x").isNull()).alias("missing"))
