"""A reader of shapefiles: geometries as WKT, and the attributes that lie beside them."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shape types, without and with further values for each point (fixed values).
POINTS, LINES, POLYGONS, MULTIPOINTS = (1, 11, 21), (3, 13, 23), (5, 15, 25), (8, 18, 28)
_SCHEMA = "name string, number int, geometry string, attributes map<string,string>"


def _coordinates(raw: bytes, at: int, n: int) -> list[tuple[float, float]]:
    flat = struct.unpack_from(f"<{2 * n}d", raw, at)
    return list(zip(flat[::2], flat[1::2], strict=True))


def _text(points: list[tuple[float, float]]) -> str:
    return "(" + ", ".join(f"{x!r} {y!r}" for x, y in points) + ")"


def _turn(ring: list[tuple[float, float]]) -> float:
    """Twice the area, positive for counter-clockwise rings."""
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False))


def _within(ring: list[tuple[float, float]], point: tuple[float, float]) -> bool:
    x, y = point
    return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:], strict=False)) % 2 == 1


def _polygons(rings: list[list[tuple[float, float]]]) -> str:
    """Clockwise rings are outer ones; the others are holes of the smallest outer ring around them."""
    outer = sorted((r for r in rings if _turn(r) <= 0), key=lambda r: -_turn(r))
    bodies = [[r] for r in outer]
    for hole in (r for r in rings if _turn(r) > 0):
        around = [b for b in bodies if _within(b[0], hole[0])]
        (around[0] if around else bodies.append([]) or bodies[-1]).append(hole)
    texts = ["(" + ", ".join(map(_text, b)) + ")" for b in bodies]
    return f"POLYGON {texts[0]}" if len(texts) == 1 else f"MULTIPOLYGON ({', '.join(texts)})"


def wkt_of(content: bytes) -> str | None:
    """The geometry of one record; null shapes are None."""
    (kind,) = struct.unpack_from("<i", content)
    if kind == 0:
        return None
    if kind in POINTS:
        return "POINT " + _text(_coordinates(content, 4, 1))
    if kind in MULTIPOINTS:
        (n,) = struct.unpack_from("<i", content, 36)
        return "MULTIPOINT " + _text(_coordinates(content, 40, n))
    if kind not in (*LINES, *POLYGONS):
        raise ValueError(f"shape type {kind} is not known")
    parts, n = struct.unpack_from("<2i", content, 36)
    first = [*struct.unpack_from(f"<{parts}i", content, 44), n]
    points = _coordinates(content, 44 + 4 * parts, n)
    rings = [points[a:b] for a, b in zip(first, first[1:], strict=False)]
    if kind in POLYGONS:
        return _polygons(rings)
    return "LINESTRING " + _text(rings[0]) if len(rings) == 1 else f"MULTILINESTRING ({', '.join(map(_text, rings))})"


def records_of(shp: bytes) -> Iterator[tuple[int, str | None]]:
    """(record number, geometry) of a .shp file."""
    if len(shp) < 100 or struct.unpack_from(">i", shp)[0] != 9994:
        raise ValueError("not a shapefile")
    at, end = 100, min(len(shp), 2 * struct.unpack_from(">i", shp, 24)[0])
    while at + 8 <= end:
        number, words = struct.unpack_from(">2i", shp, at)
        yield number, wkt_of(shp[at + 8 : at + 8 + 2 * words])
        at += 8 + 2 * words


def attributes_of(dbf: bytes, encoding: str = "utf-8") -> list[dict[str, str]]:
    """The attributes of each record of a .dbf file as trimmed text."""
    n, start, width = struct.unpack_from("<IHH", dbf, 4)
    fields, at = [], 32
    while dbf[at] != 0x0D:
        fields.append((dbf[at : at + 11].split(b"\0")[0].decode(encoding, "replace"), dbf[at + 16]))
        at += 32
    out = []
    for i in range(n):
        row, place = {}, start + i * width + 1
        for name, size in fields:
            row[name] = dbf[place : place + size].decode(encoding, "replace").strip(" \0")
            place += size
        out.append(row)
    return out


def _parsed(encoding: str):
    def run(batches):
        for batch in batches:
            for name, shp, dbf in zip(*(batch.column(c).to_pylist() for c in ("name", "shp", "dbf")), strict=True):
                beside = attributes_of(dbf, encoding) if dbf is not None else []
                rows = [(name, k, shape, list(beside[i].items()) if i < len(beside) else None) for i, (k, shape) in enumerate(records_of(shp))]
                kinds = (pa.string(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()))
                cols = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["name", "number", "geometry", "attributes"])

    return run


def shapes(files: DataFrame, encoding: str = "utf-8") -> DataFrame:
    """(name, number, geometry, attributes) of files (name, shp, dbf), both binary, dbf possibly null. A file is one task: the
    format holds 2 GB at most."""
    return files.select("name", "shp", "dbf").mapInArrow(_parsed(encoding), _SCHEMA)


def read_shapefiles(spark: SparkSession, folder: str, encoding: str = "utf-8") -> DataFrame:
    """The shapefiles of a folder (.shp, and .dbf of the same name where there is one)."""
    stem: Column = F.regexp_replace("path", r"(?i)\.(shp|dbf)$", "")
    part = lambda suffix, name: spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").load(folder).select(stem.alias("path"), F.col("content").alias(name))
    both = part("[sS][hH][pP]", "shp").join(part("[dD][bB][fF]", "dbf"), "path", "left")
    return shapes(both.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "shp", "dbf"), encoding)
