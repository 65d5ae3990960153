"""Geometry as native expressions: WKT vertices, geohash cells, area, centroid, bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import bound
from .validity import invalid_reason

#: Digits of geohash codes (fixed values).
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"
_NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
_PAIR = rf"({_NUMBER})\s+({_NUMBER})(?:\s+{_NUMBER}){{0,2}}"
_KINDS = "POINT|POLYGON|MULTIPOLYGON|LINESTRING|MULTIPOINT|MULTILINESTRING"
_SHAPE = rf"(?i)^\s*({_KINDS})\s*(Z|M|ZM)?\s*\("
_EMPTY = rf"(?i)^\s*({_KINDS})\s+EMPTY\s*$"


def wkt_problem(wkt: Column) -> Column:
    """What is wrong with a geometry text, or null: unknown kind, open brackets, or anything but coordinates in them."""
    count = lambda rest, c: F.length(rest) - F.length(F.replace(rest, F.lit(c)))
    shaped = lambda rest: rest.rlike(r"^(\(\s*)+p[p(),\s]*\)\s*$") & ~rest.rlike(r"p\s*p|,\s*[,)]|\(\s*[,)]|\)\s*[p(]|p\s*\(") & (count(rest, "(") == count(rest, ")"))
    good = wkt.rlike(_SHAPE) & bound(F.regexp_replace(F.regexp_replace(wkt, _SHAPE, "("), _PAIR, "p"), shaped)
    return F.when(wkt.isNull() | wkt.rlike(_EMPTY) | good, F.lit(None).cast("string")).otherwise(F.concat(F.lit("not a WKT geometry: "), F.substring(wkt, 1, 60)))


def _points(text: Column) -> Column:
    xs, ys = (F.regexp_extract_all(text, F.lit(_PAIR), F.lit(g)) for g in (1, 2))
    return F.zip_with(xs, ys, lambda x, y: F.struct((x.cast("double") + F.lit(0.0)).alias("x"), (y.cast("double") + F.lit(0.0)).alias("y")))


def wkt_vertices(wkt: Column, strict: bool = True) -> Column:
    """array<struct<x, y>> of all vertices in order; null stays null, other text raises, or is null if not strict."""
    problem = wkt_problem(wkt)
    wrong = F.raise_error(problem) if strict else F.lit(None)
    return F.when(wkt.isNull(), None).when(problem.isNull(), _points(wkt)).otherwise(wrong)


def wkt_polygons(wkt: Column) -> Column:
    """array (polygons) of arrays (rings, the outer one first) of vertices; for a point one ring of one vertex."""
    parts = F.split(wkt, r"\)\s*\)\s*,\s*\(\s*\(")
    rings = lambda part: F.transform(F.regexp_extract_all(F.concat(F.lit("("), part, F.lit(")")), F.lit(r"\(([^()]+)\)"), F.lit(1)), _points)
    return F.when(wkt.isNotNull() & ~wkt.rlike(_EMPTY), F.transform(parts, rings)).when(wkt.isNotNull(), F.array().cast("array<array<array<struct<x:double,y:double>>>>"))


def geohash_bounds(code: Column) -> Column:
    """struct<min_lon, min_lat, max_lon, max_lat> of a geohash cell, by halving; even bits are longitude."""
    bits = F.flatten(F.transform(F.split(F.lower(code), ""), lambda c: F.transform(F.sequence(F.lit(4), F.lit(0), F.lit(-1)), lambda s: F.shiftright(F.instr(F.lit(BASE32), c) - 1, 0).cast("int").bitwiseAND(F.pow(F.lit(2), s).cast("int")) > 0)))
    start = F.struct(F.lit(True).alias("lon"), F.lit(-180.0).alias("w"), F.lit(-90.0).alias("s"), F.lit(180.0).alias("e"), F.lit(90.0).alias("n"))

    def halve(a, up):
        x, y = (a["w"] + a["e"]) / 2, (a["s"] + a["n"]) / 2
        return F.struct(
            (~a["lon"]).alias("lon"),
            F.when(a["lon"] & up, x).otherwise(a["w"]).alias("w"),
            F.when(~a["lon"] & up, y).otherwise(a["s"]).alias("s"),
            F.when(a["lon"] & ~up, x).otherwise(a["e"]).alias("e"),
            F.when(~a["lon"] & ~up, y).otherwise(a["n"]).alias("n"),
        )

    ok = code.rlike(f"(?i)^[{BASE32}]+$")
    box = F.aggregate(bits, start, halve, lambda a: F.struct(a["w"].alias("min_lon"), a["s"].alias("min_lat"), a["e"].alias("max_lon"), a["n"].alias("max_lat")))
    return F.when(code.isNull(), None).when(ok, box).otherwise(F.raise_error(F.concat(F.lit("not a geohash: "), code)))


def box_wkt(w: Column, s: Column, e: Column, n: Column) -> Column:
    """A box as POLYGON, counter-clockwise from its south-west corner."""
    point = lambda x, y: F.concat_ws(" ", x.cast("string"), y.cast("string"))
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", point(w, s), point(e, s), point(e, n), point(w, n), point(w, s)), F.lit("))"))


def geohash_wkt(code: Column) -> Column:
    box = bound(geohash_bounds(code), lambda b: box_wkt(b["min_lon"], b["min_lat"], b["max_lon"], b["max_lat"]))
    return F.when(code.isNotNull(), box)


def with_geohash_geometry(df: DataFrame, field: str) -> DataFrame:
    return df.withColumn("geometry", geohash_wkt(F.col(field)))


def ring_metrics(v: Column) -> Column:
    """struct<area, cx, cy, min_x, min_y, max_x, max_y> of one ring of vertices; a point is its own centroid."""
    start = F.struct(*(F.lit(0.0).alias(c) for c in ("twice", "cx", "cy")))

    def cross(s, a, b):
        c = a["x"] * b["y"] - b["x"] * a["y"]
        return F.struct((s["twice"] + c).alias("twice"), (s["cx"] + c * (a["x"] + b["x"])).alias("cx"), (s["cy"] + c * (a["y"] + b["y"])).alias("cy"))

    pairs = lambda v: F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    mean = lambda c: F.aggregate(v, F.lit(0.0), lambda s, k: s + k[c]) / F.size(v)
    centre = lambda t, c, axis: F.when(F.abs(t["twice"]) > 0, t[c] / (3 * t["twice"])).otherwise(mean(axis))
    ends = lambda agg, c: agg(F.transform(v, lambda p: p[c]))
    return bound(
        F.aggregate(pairs(v), start, lambda s, k: cross(s, k["a"], k["b"])),
        lambda t: F.struct(
            (F.abs(t["twice"]) / 2).alias("area"), centre(t, "cx", "x").alias("cx"), centre(t, "cy", "y").alias("cy"),
            ends(F.array_min, "x").alias("min_x"), ends(F.array_min, "y").alias("min_y"), ends(F.array_max, "x").alias("max_x"), ends(F.array_max, "y").alias("max_y"),
        ),
    )


def polygon_metrics(polygons: Column, reason: Column | None = None) -> Column:
    """The figures of `ring_metrics` for polygons with holes, and valid, as of `validity` (reason, if given, is its finding). Holes count as negative; without
    any area the centre is the mean of the vertices."""
    reason = invalid_reason(polygons) if reason is None else reason
    start = F.struct(*(F.lit(0.0).alias(c) for c in ("area", "cx", "cy")))
    weighed = lambda p: F.flatten(F.transform(p, lambda rings: F.transform(rings, lambda ring, k: bound(ring_metrics(ring), lambda m: F.struct(m["area"].alias("area"), m["cx"].alias("cx"), m["cy"].alias("cy"), F.when(k == 0, 1.0).otherwise(-1.0).alias("sign"))))))
    add = lambda a, r: F.struct((a["area"] + r["sign"] * r["area"]).alias("area"), *((a[c] + r["sign"] * (r["area"] * r[c])).alias(c) for c in ("cx", "cy")))
    mean = lambda v, c: F.aggregate(v, F.lit(0.0), lambda a, p: a + p[c]) / F.size(v)
    centre = lambda b, c, axis: F.when(b["t"]["area"] > 0, b["t"][c] / b["t"]["area"]).otherwise(mean(b["v"], axis))
    ends = lambda b, agg, c: agg(F.transform(b["v"], lambda p: p[c]))
    made = lambda b: F.struct(F.aggregate(weighed(b["p"]), start, add).alias("t"), F.flatten(F.flatten(b["p"])).alias("v"), b["valid"].alias("valid"))
    figures = lambda b: F.when(
        F.size(b["v"]) > 0,
        F.struct(
            b["t"]["area"].alias("area"), centre(b, "cx", "x").alias("cx"), centre(b, "cy", "y").alias("cy"),
            ends(b, F.array_min, "x").alias("min_x"), ends(b, F.array_min, "y").alias("min_y"), ends(b, F.array_max, "x").alias("max_x"), ends(b, F.array_max, "y").alias("max_y"),
            b["valid"].alias("valid"),
        ),
    )
    return bound(bound(F.struct(polygons.alias("p"), reason.isNull().alias("valid")), made), figures)
