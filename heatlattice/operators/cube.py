"""Cleaning and completing the space-time cube. A cube has columns region, t (time), x (value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clean_value, region_text
from .numbering import numbered

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def require(df: DataFrame, *names: str) -> None:
    for name in names:
        if name not in df.columns:
            raise KeyError(name)


def clean(df: DataFrame, value: str, region: str | None = None) -> DataFrame:
    """df with value as a clean double and region as text."""
    require(df, value)
    kind = dict(df.dtypes)[value]
    out = df.withColumn(value, clean_value(F.col(value), kind in NUMERIC or kind.startswith("decimal")))
    return out.withColumn(region, region_text(F.col(region))) if region and region in df.columns else out


def region_geometry(df: DataFrame, region: str, geometry: str = "geometry") -> DataFrame:
    """One geometry for each region: the smallest of its non-null ones."""
    return df.groupBy(region).agg(F.min(geometry).alias(geometry))


def complete(df: DataFrame, region: str, time: str) -> DataFrame:
    """All regions by all times with df's columns; cells that df lacks have nulls, geometry is the region's."""
    require(df, region, time)
    grid = df.select(region).distinct().crossJoin(df.select(time).distinct())
    rest = df.drop("geometry") if "geometry" in df.columns else df
    keys = [F.col(f"g.{c}").eqNullSafe(F.col(f"o.{c}")) for c in (region, time)]
    out = grid.alias("g").join(rest.alias("o"), keys[0] & keys[1], "left").select(F.col(f"g.{region}"), F.col(f"g.{time}"), *(F.col(f"o.{c}") for c in rest.columns if c not in (region, time)))
    return out.join(region_geometry(df, region), region, "left") if "geometry" in df.columns else out


def gaps(df: DataFrame, region: str, time: str) -> DataFrame:
    """The cells that df lacks."""
    grid = df.select(region).distinct().crossJoin(df.select(time).distinct())
    return grid.join(df.select(region, time), [region, time], "left_anti")


def dropna(df: DataFrame, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))


def time_index(df: DataFrame, time: str) -> DataFrame:
    """(time, t_idx): dense index of the distinct times, the only rows that meet in one task."""
    return df.select(time).distinct().select(time, (F.row_number().over(Window.orderBy(F.col(time).asc_nulls_last())) - 1).alias("t_idx"))


def keyed(cube: DataFrame) -> DataFrame:
    """(region, t, x) with r = region and b = dense time index; rows that share a cell stay."""
    return cube.join(time_index(cube, "t"), "t").select("region", "t", "x", F.col("region").alias("r"), F.col("t_idx").alias("b"), F.lit(False).alias("surplus"))


def positional(cube: DataFrame) -> DataFrame:
    """(region, t, x) with the slot r and block b of each row's place in the order (time, region, value).

    Slot i stands for the i-th region in order of first appearance; rows past regions * times are surplus.
    """
    placed = numbered(cube.select("region", "t", "x"), [F.col("t").asc_nulls_last(), F.col("region"), F.col("x")], "idx")
    shape = placed.agg(F.countDistinct("region").alias("regions"), F.countDistinct("t").alias("times"))
    placed = placed.join(F.broadcast(shape))  # one row
    return placed.select("region", "t", "x", F.expr("idx % regions").alias("r"), F.expr("idx div regions").cast("int").alias("b"), (F.col("idx") >= F.col("regions") * F.col("times")).alias("surplus"))


def slots(cube: DataFrame) -> DataFrame:
    """(region, slot): regions in order of first appearance, one row a region."""
    first = cube.groupBy("region").agg(F.min("t").alias("t"))
    return numbered(first, [F.col("t").asc_nulls_last(), F.col("region")], "slot").select("region", "slot")
