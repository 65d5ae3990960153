"""Readers: separated text, wide tables, geometry columns."""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import projection
from ..functions.geo import wkt_vertices


def sniff_separator(line: str) -> str:
    return max(";,\t|", key=lambda s: (line.count(s), -";,\t|".index(s)))


def read_table(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Separated text with a header, all columns as text; without sep the first line decides."""
    if sep is None:
        first = spark.read.text(path).head()
        sep = sniff_separator(first[0]) if first else ","
    return clean_header(spark.read.option("header", True).option("sep", sep).csv(path))


def clean_header(df: DataFrame, upper: bool = True) -> DataFrame:
    names = [re.sub("^(﻿|ï»¿)", "", c).strip() for c in df.columns]
    return df.toDF(*[n.upper() if upper else n for n in names])


def unpivot_years(df: DataFrame, ids: list[str]) -> DataFrame:
    """ids, crime_year_code, occurrences: one row for each column whose name has a digit."""
    wide = [c for c in df.columns if c not in ids and re.search(r"\d", c)]
    return df.select(*ids, *(F.col(c).cast("string").alias(c) for c in wide)).unpivot(ids, wide, "crime_year_code", "occurrences")


def year_of_code(code):
    """2000 + the code's first two digits together, or null."""
    digits = F.regexp_extract(code, r"(\d{2})", 1)
    return F.when(digits != "", digits.try_cast("int") + 2000)


def scrub_number(text):
    """Text to double: everything but digits, minus, dot and comma goes, a comma is a dot, no number is 0."""
    plain = F.regexp_replace(F.regexp_replace(text, r"[^\d\-\.\,]", ""), ",", ".")
    return F.coalesce(plain.try_cast("double"), F.lit(0.0))


def yearly_totals(df: DataFrame, ids: list[str], total: str = "crime_total") -> DataFrame:
    long = unpivot_years(df, ids).withColumn("year", year_of_code(F.col("crime_year_code"))).where("year is not null")
    return long.groupBy(*ids, "year").agg(F.sum(scrub_number(F.col("occurrences"))).alias(total))


def join_districts(districts: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """Districts with their totals (null years where there are none), in the order of key and year, nulls last."""
    return districts.join(totals, key, "left").orderBy(F.col(key).asc_nulls_last(), F.col("year").asc_nulls_last())


def with_geometry(df: DataFrame, geometry: str = "geometry", srid: int = 4326, prj: str | None = None) -> DataFrame:
    """df with geometry as vertices in EPSG:4326, checked. Other systems are converted: by their number, or by the text that
    a shapefile declares them with (prj); those that `projection` does not know raise."""
    crs = projection.of_text(prj) if prj is not None else projection.of_srid(srid)
    if geometry not in df.columns:
        raise KeyError(geometry)
    out = df if dict(df.dtypes)[geometry].startswith("array") else df.withColumn(geometry, wkt_vertices(F.col(geometry)))
    if crs == projection.of_srid(4326):
        return out
    degrees = lambda p: dict(zip("xy", projection.to_degrees(p["x"], p["y"], crs), strict=True))
    return out.withColumn(geometry, F.transform(geometry, lambda p: F.struct(*(c.alias(n) for n, c in degrees(p).items()))))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of GeoJSON files, one a line or one collection a file: geometry as WKT, and properties as JSON text."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.when(F.get_json_object("value", "$.features").isNotNull(), F.from_json(F.get_json_object("value", "$.features"), "array<string>")).otherwise(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != ""))).alias("f"))
    kind, body = F.upper(F.get_json_object("f", "$.geometry.type")), F.get_json_object("f", "$.geometry.coordinates")
    # [x,y] becomes "x y"; what brackets are left are those of rings and polygons.
    flat = F.regexp_replace(F.regexp_replace(body, r"\s", ""), r"\[(-?[0-9.eE+-]+),(-?[0-9.eE+-]+)(?:,-?[0-9.eE+-]+)*\]", "$1 $2")
    inner = F.translate(flat, "[]", "()")
    return raw.select(F.when(kind == "POINT", F.concat(F.lit("POINT ("), inner, F.lit(")"))).when(kind.isNotNull(), F.concat(kind, F.lit(" "), inner)).alias("geometry"), F.get_json_object("f", "$.properties").alias("properties"))


def periods(start: str, n: int, step: str = "month") -> list[date]:
    """n dates from start on: month ends, or steps of 30 days (`step` "30 days")."""
    first = date.fromisoformat(start)
    if step == "30 days":
        return [first + timedelta(days=30 * i) for i in range(n)]
    if step != "month":
        raise ValueError("step must be 'month' or '30 days'")
    months = [first.year * 12 + first.month + i for i in range(n)]  # of the month behind each
    return [date(m // 12, m % 12 + 1, 1) - timedelta(days=1) for m in months]


def period(start: str, i: Column, step: str = "month") -> Column:
    """Date number i of `periods`, as an expression."""
    first = F.lit(start).cast("date")
    if step == "30 days":
        return F.date_add(first, (30 * i).cast("int"))
    if step != "month":
        raise ValueError("step must be 'month' or '30 days'")
    return F.last_day(F.add_months(F.trunc(first, "month"), i.cast("int")))


def date_range(spark: SparkSession, start: str, n: int, step: str = "month") -> DataFrame:
    """(t): the dates of `periods`."""
    return spark.range(n).select(period(start, F.col("id"), step).alias("t"))
