"""Shapefiles as a data source of Spark: `spark.read.format("shapefile")` and `df.write.format("shapefile")`.

Reading: a folder or file, at a path that `pyarrow.fs` opens (mounted folders, object stores, HDFS); elsewhere
`shapes.read_shapefiles` reads whole files through Spark. A file is cut into portions of `portion` bytes (64 MB): the index
(.shx) is searched for their first records, so that planning reads a few places of it and no task reads what another one
does. A file without index is one portion. Files and records whose bounding box a filter on min_x, min_y, max_x or max_y
excludes are not parsed (with `spark.sql.python.filterPushdown.enabled`); Spark applies the filters once more.

Writing: each task writes its rows as files of at most `rows` records (100,000) with index and attributes, under hidden
names; the driver takes the hidden mark off when all tasks are done, so attempts that failed leave nothing that is read.
`shape` says what all geometries are: polygon (also of several parts), line or point. All other columns become
attributes: names are cut to ten bytes and must stay distinct, text may have `width` bytes (80, at most 254).

Defined cases: null geometries are null shapes; no .dbf gives null attributes; empty tasks write no file; text that is too
long, a geometry of another kind and files that are not shapefiles raise.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from .shapes import _turn, wkt_of

SCHEMA = "name string, number int, min_x double, min_y double, max_x double, max_y double, geometry string, attributes map<string,string>"
_BOX = ("min_x", "min_y", "max_x", "max_y")
_BATCH = 1000
_HEAD = 100


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return fs.LocalFileSystem(), path


def _at(system: fs.FileSystem, path: str, start: int, n: int) -> bytes:
    with system.open_input_file(path) as f:
        f.seek(start)
        return f.read(n)


@dataclass
class Portion(InputPartition):
    """Records [first, last) of a file; last is None for all of a file without index."""

    shp: str
    shx: str | None
    dbf: str | None
    first: int
    last: int | None


class ShapefileReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.portion = int(options.get("portion", 64 << 20))
        self.encoding = options.get("encoding", "utf-8")
        self.wanted: list[tuple[int, str, float]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        signs = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            if type(f) in signs and len(f.attribute) == 1 and f.attribute[0] in _BOX:
                self.wanted.append((_BOX.index(f.attribute[0]), signs[type(f)], float(f.value)))
            yield f

    def _excluded(self, box: tuple[float, ...], whole_file: bool = False) -> bool:
        """Whether no record of this box (or in this file's box) can pass the filters."""
        for k, sign, value in self.wanted:
            # The largest and the smallest value that a record's side can have.
            high, low = (box[k | 2], box[k & 1]) if whole_file else (box[k], box[k])
            if (sign == ">" and high <= value) or (sign == ">=" and high < value) or (sign == "<" and low >= value) or (sign == "<=" and low > value):
                return True
        return False

    def partitions(self) -> list[Portion]:
        system, path = _opened(self.path)
        info = system.get_file_info(path)
        listed = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path))
        beside = {i.path.lower(): i.path for i in (listed if info.type != fs.FileType.File else system.get_file_info(fs.FileSelector(path.rpartition("/")[0] or "/")))}
        out = []
        for one in sorted(listed, key=lambda i: i.path):
            if not one.path.lower().endswith(".shp") or one.base_name.startswith(("_", ".")):
                continue
            head = _at(system, one.path, 0, _HEAD)
            if len(head) < _HEAD or struct.unpack_from(">i", head)[0] != 9994:
                raise ValueError(f"not a shapefile: {one.path}")
            if one.size > _HEAD and self._excluded(struct.unpack_from("<4d", head, 36), True):
                continue
            shx, dbf = (beside.get(one.path[:-4].lower() + end) for end in (".shx", ".dbf"))
            if shx is None:
                out.append(Portion(one.path, None, dbf, 0, None))
                continue
            with system.open_input_file(shx) as index:
                n = (index.size() - _HEAD) // 8
                bounds = {0, n} | {self._first_behind(index, n, place) for place in range(_HEAD + self.portion, one.size, self.portion)}
            bounds = sorted(bounds)
            out += [Portion(one.path, shx, dbf, a, b) for a, b in zip(bounds, bounds[1:], strict=False)]
        return out

    @staticmethod
    def _first_behind(index, n: int, place: int) -> int:
        """The first record that begins at a byte or behind it, by halving."""
        low, high = 0, n
        while low < high:
            middle = (low + high) // 2
            index.seek(_HEAD + 8 * middle)
            if 2 * struct.unpack(">i", index.read(4))[0] < place:
                low = middle + 1
            else:
                high = middle
        return low

    def _records(self, system: fs.FileSystem, p: Portion) -> Iterator[tuple[int, bytes]]:
        """(number from 0, content) of a portion's records."""
        with system.open_input_stream(p.shp) if p.shx is None else system.open_input_file(p.shp) as f:
            if p.shx is None:
                f.read(_HEAD)
                k = 0
                while len(head := f.read(8)) == 8:
                    yield k, f.read(2 * struct.unpack_from(">i", head, 4)[0])
                    k += 1
                return
            for start in range(p.first, p.last, _BATCH):
                n = min(_BATCH, p.last - start)
                places = struct.unpack(f">{2 * n}i", _at(system, p.shx, _HEAD + 8 * start, 8 * n))
                for k in range(n):
                    f.seek(2 * places[2 * k] + 8)
                    yield start + k, f.read(2 * places[2 * k + 1])

    def _fields(self, system: fs.FileSystem, dbf: str) -> tuple[int, int, int, list[tuple[str, int]]]:
        n, start, width = struct.unpack_from("<IHH", _at(system, dbf, 4, 8))
        head = _at(system, dbf, 32, start - 32)
        fields = [(head[k : k + 11].split(b"\0")[0].decode(self.encoding, "replace"), head[k + 16]) for k in range(0, len(head) - 31, 32) if head[k] != 0x0D]
        return n, start, width, fields

    def read(self, partition: Portion | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file is left: Spark reads one empty portion
            return
        system, _ = _opened(self.path)
        name = re.sub(r"(?i)\.shp$", "", partition.shp.rpartition("/")[2])
        n, start, width, fields = self._fields(system, partition.dbf) if partition.dbf else (0, 0, 0, [])
        kinds = [pa.string(), pa.int32(), *[pa.float64()] * 4, pa.string(), pa.map_(pa.string(), pa.string())]
        names = ["name", "number", *_BOX, "geometry", "attributes"]
        rows: list[tuple] = []
        table = system.open_input_file(partition.dbf) if partition.dbf else None

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        try:
            for k, content in self._records(system, partition):
                (kind,) = struct.unpack_from("<i", content)
                box = (None,) * 4 if kind == 0 else struct.unpack_from("<2d", content, 4) * 2 if kind in (1, 11, 21) else struct.unpack_from("<4d", content, 4)
                if self.wanted and (kind == 0 or self._excluded(box)):
                    continue
                beside = None
                if k < n:
                    table.seek(start + k * width + 1)
                    text, at, beside = table.read(width - 1), 0, []
                    for field, size in fields:
                        beside.append((field, text[at : at + size].decode(self.encoding, "replace").strip(" \0")))
                        at += size
                rows.append((name, k + 1, *box, wkt_of(content), beside))
                if len(rows) == _BATCH:
                    yield batch()
                    rows = []
            if rows:
                yield batch()
        finally:
            if table:
                table.close()


@dataclass
class Written(WriterCommitMessage):
    stems: list[str]


#: Shape types that can be written, with the WKT kinds that they hold (fixed values).
_KINDS = {"point": (1, "POINT"), "line": (3, "LINESTRING|MULTILINESTRING"), "polygon": (5, "POLYGON|MULTIPOLYGON")}


def content_of(wkt: str | None, shape: str) -> tuple[bytes, tuple[float, ...] | None]:
    """A record's content and its bounding box."""
    if wkt is None or re.fullmatch(r"(?i)\s*[A-Z]+\s+EMPTY\s*", wkt):
        return struct.pack("<i", 0), None
    number, kinds = _KINDS[shape]
    if not re.match(rf"(?i)\s*({kinds})\s*(Z|M|ZM)?\s*\(", wkt):
        raise ValueError(f"not of shape {shape}: {wkt[:60]}")
    if shape == "point":
        x, y = map(float, re.search(r"\(([^()]*)\)", wkt)[1].split()[:2])
        return struct.pack("<i2d", 1, x, y), (x, y, x, y)
    rings = []
    for part in re.split(r"\)\s*\)\s*,\s*\(\s*\(", wkt):
        for k, body in enumerate(re.findall(r"\(([^()]+)\)", f"({part})")):
            ring = [tuple(map(float, p.split()[:2])) for p in body.split(",") if p.strip()]
            if ring:
                # Shells go clockwise, holes the other way.
                rings.append(ring[::-1] if shape == "polygon" and (_turn(ring) > 0) == (k == 0) else ring)
    points = [p for ring in rings for p in ring]
    xs, ys = zip(*points, strict=True)
    box = (min(xs), min(ys), max(xs), max(ys))
    firsts = [sum(map(len, rings[:k])) for k in range(len(rings))]
    flat = [c for p in points for c in p]
    return struct.pack(f"<i4d2i{len(rings)}i{len(flat)}d", number, *box, len(rings), len(points), *firsts, *flat), box


class ShapefileWriter(DataSourceWriter):
    def __init__(self, schema, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.shape, self.width, self.rows = options.get("shape", "polygon"), int(options.get("width", 80)), int(options.get("rows", 100_000))
        self.fields = [f for f in schema.fieldNames() if f != "geometry"]
        short = [f.encode()[:10] for f in self.fields]
        if self.shape not in _KINDS or not 0 < self.width < 255 or "geometry" not in schema.fieldNames():
            raise ValueError("shape must be polygon, line or point, width at most 254, and there must be a column geometry")
        if len(set(short)) < len(short):
            raise ValueError("column names must differ in their first ten bytes")

    def _file(self, system: fs.FileSystem, folder: str, rows: list) -> str:
        shp, shx, dbf, boxes = bytearray(), bytearray(), bytearray(), []
        for k, row in enumerate(rows):
            content, box = content_of(row["geometry"], self.shape)
            shx += struct.pack(">2i", (_HEAD + len(shp)) // 2, len(content) // 2)
            shp += struct.pack(">2i", k + 1, len(content) // 2) + content
            boxes += [box] if box else []
            texts = ["" if row[f] is None else str(row[f]) for f in self.fields]
            if any(len(t.encode()) > self.width for t in texts):
                raise ValueError(f"text of more than {self.width} bytes")
            dbf += b" " + b"".join(t.encode().ljust(self.width) for t in texts)
        low, high = ([agg(b[k] for b in boxes) for k in ks] if boxes else [0.0, 0.0] for agg, ks in ((min, (0, 1)), (max, (2, 3))))
        head = lambda n: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (_HEAD + n) // 2) + struct.pack("<2i8d", 1000, _KINDS[self.shape][0], *low, *high, 0, 0, 0, 0)
        fields = b"".join(f.encode()[:10].ljust(11, b"\0") + b"C" + bytes(4) + bytes([self.width, 0]) + bytes(14) for f in self.fields)
        table = struct.pack("<4BIHH20x", 3, 0, 0, 0, len(rows), 33 + len(fields), 1 + self.width * len(self.fields)) + fields + b"\r" + dbf
        stem = f"{folder}/_part-{uuid.uuid4().hex}"
        for end, body in ((".shx", head(len(shx)) + shx), (".dbf", table), (".shp", head(len(shp)) + shp)):
            with system.open_output_stream(stem + end) as f:
                f.write(bytes(body))
        return stem

    def write(self, iterator) -> Written:
        system, folder = _opened(self.path)
        system.create_dir(folder, recursive=True)
        stems, rows = [], []
        for row in iterator:
            rows.append(row)
            if len(rows) == self.rows:
                stems.append(self._file(system, folder, rows))
                rows = []
        return Written([*stems, *([self._file(system, folder, rows)] if rows else [])])

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = _opened(self.path)
        system.create_dir(folder, recursive=True)
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(folder)):
                if re.search(r"(?i)\.(shp|shx|dbf)$", info.path) and not info.base_name.startswith(("_", ".")):
                    system.delete_file(info.path)
        for stem in (s for m in messages if m for s in m.stems):
            place, _, name = stem.rpartition("/")
            for end in (".shx", ".dbf", ".shp"):
                system.move(stem + end, f"{place}/{name[1:]}{end}")

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = _opened(self.path)
        for stem in (s for m in messages if m for s in m.stems):
            for end in (".shx", ".dbf", ".shp"):
                system.delete_file(stem + end)


class ShapefileSource(DataSource):
    """Register with `spark.dataSource.register(ShapefileSource)`."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ShapefileReader:
        return ShapefileReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> ShapefileWriter:
        return ShapefileWriter(schema, dict(self.options), overwrite)
