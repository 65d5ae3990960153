"""Reference systems that shapefiles declare (.prj), and coordinates to and from degrees of WGS 84, as expressions.

Known are geographic systems, transverse Mercator (so UTM and national grids of that kind) on any ellipsoid, by series in
the third flattening, and the spherical Mercator of web maps; datums by the seven parameters that the text gives
(position vector). Datums that are WGS 84 to within a metre or two need none. All else raises.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

WGS84 = (6378137.0, 298.257223563)
GRS80 = (6378137.0, 298.257222101)
#: Datums that agree with WGS 84 to within a metre or two (fixed values), without signs, in lower case.
_SAME = ("wgs1984", "wgs84", "worldgeodeticsystem1984", "sirgas2000", "sistemadereferenciageocentricoparalasamericas2000", "sistemadereferenciageocentricoparalasamericas2000sirgas2000", "sirgas", "etrs1989", "etrs89", "europeanterrestrialreferencesystem1989", "northamericandatum1983", "northamerican1983", "nad83", "gda1994", "gda94", "geocentricdatumofaustralia1994", "jgd2000", "nzgd2000")


@dataclass(frozen=True)
class Crs:
    """kind (degrees, tm or web), ellipsoid (semi-major axis, inverse flattening; 0 for a sphere), parameters of the
    projection in metres and degrees, size of a unit in metres or degrees, and the shift to WGS 84."""

    kind: str
    ellipsoid: tuple[float, float] = WGS84
    parameters: dict[str, float] = field(default_factory=dict)
    unit: float = 1.0
    meridian: float = 0.0
    shift: tuple[float, ...] | None = None


def utm(zone: int, south: bool, ellipsoid: tuple[float, float] = WGS84) -> Crs:
    if not 1 <= zone <= 60:
        raise ValueError("zones of UTM go from 1 to 60")
    return Crs("tm", ellipsoid, {"central_meridian": 6.0 * zone - 183, "latitude_of_origin": 0.0, "scale_factor": 0.9996, "false_easting": 5e5, "false_northing": 1e7 if south else 0.0})


def of_srid(srid: int) -> Crs:
    """EPSG 4326, 4674, 3857, UTM of WGS 84 (326zz, 327zz) and of SIRGAS 2000 (31965-31976 north, 31977-31985 south)."""
    if srid in (4326, 4674):
        return Crs("degrees", WGS84 if srid == 4326 else GRS80)
    if srid == 3857:
        return Crs("web")
    if srid // 100 in (326, 327) and 1 <= srid % 100 <= 60:
        return utm(srid % 100, srid // 100 == 327)
    if 31965 <= srid <= 31985:
        return utm(srid - (31954 if srid < 31977 else 31960), srid >= 31977, GRS80)
    raise ValueError(f"the system EPSG:{srid} is not known; give its text")


def of_text(prj: str) -> Crs:
    """The system that a .prj text declares."""
    number = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
    found = lambda pattern: re.search(pattern, prj, re.IGNORECASE)
    plain = lambda s: re.sub(r"[^a-z0-9]", "", s.lower().removeprefix("d_"))
    if not found(r"^\s*(PROJCS|GEOGCS)\s*\["):
        raise ValueError(f"not the text of a projected or geographic system: {prj[:60]}")
    body = found(rf'SPHEROID\s*\[\s*"[^"]*"\s*,\s*({number})\s*,\s*({number})')
    datum = found(r'DATUM\s*\[\s*"([^"]*)"')
    if not body or not datum:
        raise ValueError("the text names no datum or ellipsoid")
    ellipsoid = (float(body[1]), float(body[2]))
    moved = found(rf"TOWGS84\s*\[\s*((?:{number}\s*,?\s*)+)\]")
    shift = tuple(float(v) for v in moved[1].split(",") if v.strip()) if moved else None
    if shift is not None and len(shift) not in (3, 7):
        raise ValueError("a shift has three or seven parameters")
    if shift is None and plain(datum[1]) not in _SAME:
        raise ValueError(f"the datum {datum[1]} needs TOWGS84")
    shift = tuple((*shift, 0.0, 0.0, 0.0, 0.0)[:7]) if shift and any(shift) else None
    prime = found(rf'PRIMEM\s*\[\s*"[^"]*"\s*,\s*({number})')
    units = [float(u) for u in re.findall(rf'UNIT\s*\[\s*"[^"]*"\s*,\s*({number})', prj, re.IGNORECASE)]
    angle = units[0] if units else math.pi / 180
    meridian = math.degrees(float(prime[1]) * angle) if prime else 0.0
    if not found(r"^\s*PROJCS"):
        return Crs("degrees", ellipsoid, {}, math.degrees(angle), meridian, shift)
    method = found(r'PROJECTION\s*\[\s*"([^"]*)"')
    name = plain(method[1]) if method else ""
    if name not in ("transversemercator", "gausskruger") and not (name in ("mercatorauxiliarysphere", "popularvisualisationpseudomercator")):
        raise ValueError(f"the projection {method[1] if method else None} is not known")
    length = units[1] if len(units) > 1 else 1.0
    if name not in ("transversemercator", "gausskruger"):
        return Crs("web", ellipsoid, {}, length)
    given = {k.lower(): float(v) for k, v in re.findall(rf'PARAMETER\s*\[\s*"([^"]*)"\s*,\s*({number})', prj, re.IGNORECASE)}
    degrees = lambda k: math.degrees(given.get(k, 0.0) * angle)
    parameters = {"central_meridian": degrees("central_meridian"), "latitude_of_origin": degrees("latitude_of_origin"), "scale_factor": given.get("scale_factor", 1.0), "false_easting": given.get("false_easting", 0.0) * length, "false_northing": given.get("false_northing", 0.0) * length}
    return Crs("tm", ellipsoid, parameters, length, meridian, shift)


def _series(ellipsoid: tuple[float, float]):
    """Third flattening, radius of the rectifying sphere, and the series of forward, inverse and latitude (order four)."""
    f = 1 / ellipsoid[1] if ellipsoid[1] else 0.0
    n = f / (2 - f)
    powers = lambda *rows: [sum(c * n ** (i + k) for k, c in enumerate(r)) for i, r in enumerate(rows, 1)]
    forward = powers((1 / 2, -2 / 3, 5 / 16, 41 / 180), (13 / 48, -3 / 5, 557 / 1440), (61 / 240, -103 / 140), (49561 / 161280,))
    inverse = powers((1 / 2, -2 / 3, 37 / 96, -1 / 360), (1 / 48, 1 / 15, -437 / 1440), (17 / 480, -37 / 840), (4397 / 161280,))
    latitude = powers((2, -2 / 3, -2, 116 / 45), (7 / 3, -8 / 5, -227 / 45), (56 / 15, -136 / 35), (4279 / 630,))
    return n, ellipsoid[0] / (1 + n) * (1 + n * n / 4 + n**4 / 64), forward, inverse, latitude


def _origin(crs: Crs) -> float:
    """The rectifying latitude of the latitude of origin, in radians."""
    n, _, forward, _, _ = _series(crs.ellipsoid)
    c, s = 2 * math.sqrt(n) / (1 + n), math.sin(math.radians(crs.parameters["latitude_of_origin"]))
    conformal = math.atan(math.sinh(math.atanh(s) - c * math.atanh(c * s)))
    return conformal + sum(a * math.sin(2 * j * conformal) for j, a in enumerate(forward, 1))


def _added(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def _shifted(lon: Column, lat: Column, old: tuple[float, float], new: tuple[float, float], shift: tuple[float, ...], back: bool) -> tuple[Column, Column]:
    """Degrees on another datum, through geocentric coordinates on the ellipsoid's surface."""
    squared = lambda e: (2 - 1 / e[1]) / e[1] if e[1] else 0.0
    sign = -1.0 if back else 1.0
    tx, ty, tz = (sign * v for v in shift[:3])
    rx, ry, rz = (sign * math.radians(v / 3600) for v in shift[3:6])
    scale = 1 + sign * shift[6] * 1e-6
    a, e2 = old[0], squared(old)
    p, q = F.radians(lat), F.radians(lon)
    v = a / F.sqrt(1 - e2 * F.sin(p) * F.sin(p))
    x, y, z = v * F.cos(p) * F.cos(q), v * F.cos(p) * F.sin(q), v * (1 - e2) * F.sin(p)
    x, y, z = tx + scale * (x - rz * y + ry * z), ty + scale * (rz * x + y - rx * z), tz + scale * (-ry * x + rx * y + z)
    a, e2 = new[0], squared(new)
    b = a * math.sqrt(1 - e2)
    flat = F.sqrt(x * x + y * y)
    reduced = F.atan2(z * F.lit(a), flat * F.lit(b))
    for _ in range(2):
        up = F.atan2(z + e2 / (1 - e2) * b * F.pow(F.sin(reduced), 3), flat - e2 * a * F.pow(F.cos(reduced), 3))
        reduced = F.atan2(F.lit(b) * F.sin(up), F.lit(a) * F.cos(up))
    return F.degrees(F.atan2(y, x)), F.degrees(up)


def to_degrees(x: Column, y: Column, crs: Crs) -> tuple[Column, Column]:
    """Longitude and latitude on WGS 84."""
    if crs.kind == "web":
        r = WGS84[0] / crs.unit
        return F.degrees(x / r), F.degrees(2 * F.atan(F.exp(y / r)) - math.pi / 2)
    if crs.kind == "degrees":
        lon, lat = x * crs.unit + crs.meridian, y * crs.unit
    else:
        p, (_, radius, _, inverse, latitude) = crs.parameters, _series(crs.ellipsoid)
        k = p["scale_factor"] * radius
        north, east = (y * crs.unit - p["false_northing"]) / k + _origin(crs), (x * crs.unit - p["false_easting"]) / k
        u = north - _added([b * F.sin(2 * j * north) * F.cosh(2 * j * east) for j, b in enumerate(inverse, 1)])
        v = east - _added([b * F.cos(2 * j * north) * F.sinh(2 * j * east) for j, b in enumerate(inverse, 1)])
        conformal = F.asin(F.sin(u) / F.cosh(v))
        lat = F.degrees(conformal + _added([d * F.sin(2 * j * conformal) for j, d in enumerate(latitude, 1)]))
        lon = F.degrees(F.atan2(F.sinh(v), F.cos(u))) + (p["central_meridian"] + crs.meridian)
    return _shifted(lon, lat, crs.ellipsoid, WGS84, crs.shift, False) if crs.shift else (lon, lat)


def from_degrees(lon: Column, lat: Column, crs: Crs) -> tuple[Column, Column]:
    """Coordinates of WGS 84 degrees in another system; shifts are turned round by their signs, to a few millimetres."""
    if crs.kind == "web":
        r = WGS84[0] / crs.unit
        return F.radians(lon) * r, F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)) * r
    if crs.shift:
        lon, lat = _shifted(lon, lat, WGS84, crs.ellipsoid, crs.shift, True)
    if crs.kind == "degrees":
        return (lon - crs.meridian) / crs.unit, lat / crs.unit
    p, (n, radius, forward, _, _) = crs.parameters, _series(crs.ellipsoid)
    k, c = p["scale_factor"] * radius, 2 * math.sqrt(n) / (1 + n)
    s, q = F.sin(F.radians(lat)), F.radians(lon - (p["central_meridian"] + crs.meridian))
    t = F.sinh(F.atanh(s) - c * F.atanh(c * s))
    u, v = F.atan2(t, F.cos(q)), F.atanh(F.sin(q) / F.sqrt(1 + t * t))
    east = v + _added([a * F.cos(2 * j * u) * F.sinh(2 * j * v) for j, a in enumerate(forward, 1)])
    north = u + _added([a * F.sin(2 * j * u) * F.cosh(2 * j * v) for j, a in enumerate(forward, 1)])
    return (east * k + p["false_easting"]) / crs.unit, ((north - _origin(crs)) * k + p["false_northing"]) / crs.unit
