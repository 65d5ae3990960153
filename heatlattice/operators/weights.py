"""Queen contiguity: regions that share a vertex, and each region itself, with equal weights that sum to one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import wkt_vertices


def vertices(geo: DataFrame, region: str = "region", geometry: str = "geometry", snap: int | None = None, strict: bool = True) -> DataFrame:
    """(region, vx, vy), distinct; snap rounds to so many decimals, else vertices must be equal bit for bit.
    What is no geometry raises, or has no vertex if not strict."""
    kind = dict(geo.dtypes)[geometry]
    points = F.col(geometry) if kind.startswith("array") else wkt_vertices(F.col(geometry), strict)
    axis = lambda c: F.round(F.col(f"v.{c}"), snap) + 0.0 if snap is not None else F.col(f"v.{c}") + F.lit(0.0)
    return geo.select(F.col(region).alias("region"), F.explode(points).alias("v")).select("region", axis("x").alias("vx"), axis("y").alias("vy")).distinct()


def queen_edges(geo: DataFrame, region: str = "region", geometry: str = "geometry", snap: int | None = None, strict: bool = True) -> DataFrame:
    """(region, neighbor) with each region its own neighbour; a point touches only coincident points."""
    v = vertices(geo, region, geometry, snap, strict)
    a, b = v.alias("a"), v.alias("b")
    met = a.join(b, (F.col("a.vx") == F.col("b.vx")) & (F.col("a.vy") == F.col("b.vy")) & (F.col("a.region") != F.col("b.region")))
    own = geo.select(F.col(region).alias("region")).distinct()
    return met.select(F.col("a.region").alias("region"), F.col("b.region").alias("neighbor")).distinct().unionByName(own.select("region", F.col("region").alias("neighbor")))


def near_vertices(points: DataFrame, within: float) -> DataFrame:
    """(ax, ay, bx, by): ordered pairs of points (vx, vy), each with itself, at most `within` apart.

    Points are dealt to buckets twice as wide, so partners lie in the same bucket or a neighbouring one wherever the
    rounding of the quotient falls; a distance that coordinates are too large for raises.
    """
    if not within > 0:
        raise ValueError("the distance must be positive")
    width = 2.0 * within
    bucket = lambda c: F.when(F.abs(F.col(c) / width) < 2.0**50, F.floor(F.col(c) / width)).otherwise(F.raise_error(F.lit("coordinates too large for this distance")))
    dealt = points.select("vx", "vy").where("vx is not null and vy is not null").distinct().select("vx", "vy", bucket("vx").alias("i"), bucket("vy").alias("j"))
    around = F.explode(F.expr("flatten(transform(sequence(-1, 1), d -> transform(sequence(-1, 1), e -> struct(i + d as i, j + e as j))))")).alias("at")
    asks = dealt.select(F.col("vx").alias("ax"), F.col("vy").alias("ay"), around).select("ax", "ay", "at.i", "at.j")
    met = asks.join(dealt.select("i", "j", F.col("vx").alias("bx"), F.col("vy").alias("by")), ["i", "j"])
    apart = F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2)
    return met.where(apart <= within * within).select("ax", "ay", "bx", "by")


def queen_edges_within(geo: DataFrame, within: float, region: str = "region", geometry: str = "geometry", strict: bool = True) -> DataFrame:
    """(region, neighbor): regions with vertices at most `within` apart, each region its own neighbour.

    Distances are taken between different points; which regions have them comes in afterwards, so a vertex that many
    regions share is compared once.
    """
    v = vertices(geo, region, geometry, None, strict)
    near = near_vertices(v, within)
    one = v.select("region", F.col("vx").alias("ax"), F.col("vy").alias("ay"))
    other = v.select(F.col("region").alias("neighbor"), F.col("vx").alias("bx"), F.col("vy").alias("by"))
    met = near.join(one, ["ax", "ay"]).select("region", "bx", "by").distinct().join(other, ["bx", "by"]).where("region <> neighbor")
    own = geo.select(F.col(region).alias("region")).distinct()
    return met.select("region", "neighbor").distinct().unionByName(own.select("region", F.col("region").alias("neighbor")))


def standardised(edges: DataFrame) -> DataFrame:
    return edges.withColumn("weight", F.lit(1.0) / F.count("*").over(Window.partitionBy("region")))


def spacetime_edges(edges: DataFrame, n_times: int, k: int = 1) -> DataFrame:
    """(region, t_idx, neighbor, nb_t, weight): neighbours at the same time and up to k times before."""
    times = F.explode(F.sequence(F.lit(0), F.lit(n_times - 1))).alias("t_idx")
    lags = F.explode(F.sequence(F.lit(0), F.least(F.col("t_idx"), F.lit(k)))).alias("lag")
    out = standardised(edges).select("*", times).select("*", lags)
    return out.select("region", "t_idx", "neighbor", (F.col("t_idx") - F.col("lag")).alias("nb_t"), "weight")


def graph_stats(edges: DataFrame) -> DataFrame:
    return edges.agg(F.countDistinct("region").alias("n"), (F.count("*") / F.countDistinct("region")).alias("mean_neighbors"))
