import json
import math
import os
import random
import re
import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from heatlattice import queries
from heatlattice.functions import geo, numeric, projection, union
from heatlattice.operators import classify, cube, dissolve, gistar, numbering, permute, trend, weights
from heatlattice.plans import ehsa
from heatlattice.sources import export, ingest, shapes

SMALL = "/root/testdata/sf0.001"


def square_grid(spark, n):
    keys = spark.createDataFrame([(i,) for i in range(n * n)], "key int")
    return queries.squares(keys, n)


@pytest.mark.parametrize(
    ("series", "tau", "sl"),
    [([1, 2, 3, 4, 5, 6], 1.0, 0.008534920414227), ([6, 5, 4, 3, 2, 1], -1.0, 0.008534920414227), ([3] * 6, 0.0, 1.0), ([1, 3, 2, 4, 3, 5], 0.666666666666667, 0.085167905883956), ([5], 0.0, 1.0), ([], 0.0, 1.0), ([1, 2, math.nan, 4, 5, math.nan], 1.0, 0.089429359028994), ([1, 2, 2, 3, 3, 3, 4], 0.80952380952381, 0.011071644553191), ([0, 0, 5e-11, 1], 0.5, 0.08326451666355)],
)
def test_mann_kendall(spark, series, tau, sl):
    row = spark.createDataFrame([([float(x) for x in series],)], "s array<double>").select(trend.mann_kendall(F.col("s")).alias("m")).first()["m"]
    assert row["tau"] == pytest.approx(tau, abs=1e-12)
    assert row["sl"] == pytest.approx(sl, abs=1e-12)


GOLDEN = [
    ([1, 2, 3, 4, 5, 6, 7, 8, 9], [-1.959592, -2.32379, -0.979796, -0.774597, 0, 0.774597, 0.979796, 2.32379, 1.959592]),
    ([2, 2, 2, 2, 9, 2, 2, 2, 2], [2.171828, 0, 3.990103, 0, 0, 0, 7.626652, 0, 9.444926]),
    ([9, 8, 7, 1, 1, 1, 1, 1, 1], [2.2, 0, 1.6, 0, 0, 0, -2.3, 0, -2.3]),
]


@pytest.mark.parametrize("policy", ["keyed", "positional"])
def test_gi_star_golden(spark, policy):
    cells = spark.createDataFrame([(str(r), t, float(x)) for t, (xs, _) in enumerate(GOLDEN) for r, x in enumerate(xs)], "region string, t int, x double")
    out = ehsa.gi_star_spacetime(cells, weights.queen_edges(square_grid(spark, 3)), 1, 9, 7, policy, "numpy").collect()
    got = {(int(r["region"]), r["t"]): r["gi"] for r in out}
    for t, (_, want) in enumerate(GOLDEN):
        assert [got[r, t] for r in range(9)] == pytest.approx(want, abs=1e-6)
    assert all(0.1 <= r["p_sim"] <= 1 for r in out)


def test_p_values_do_not_depend_on_partitioning(spark):
    cells = spark.createDataFrame([(str(r), t, float((r * 7 + t * 3) % 11)) for t in range(3) for r in range(9)], "region string, t int, x double")
    edges = weights.queen_edges(square_grid(spark, 3))
    made = [sorted((r["region"], r["t"], r["p_sim"]) for r in ehsa.gi_star_spacetime(c, edges, 1, 19, 3, "keyed", backend).collect()) for c in (cells, cells.repartition(7)) for backend in ("numpy", "native", "auto")]
    assert all(m == made[0] for m in made)


@pytest.mark.parametrize(("m", "total"), [(3, 11), (9, 27), (26, 27), (40, 27), (200, 700), (18, 100_000)])
def test_draws_of_both_backends(spark, m, total):
    cells = [0, 5, total - 1]
    native = permute.draws(spark.createDataFrame([(o, m, total) for o in cells], "o bigint, m bigint, total bigint"), 7, 77).groupBy("o", "sim").agg(F.collect_list("j").alias("j")).collect()
    numpy = permute.picks(np.array(cells), m, total, 7, 77)
    for r in native:
        own = numpy[cells.index(r["o"]), r["sim"] - 1].tolist()
        assert sorted(r["j"]) == sorted(own) and len(own) == m and r["o"] not in own
        assert len(set(own)) == m or total - 1 < m


def test_draws_are_even():
    seen = np.bincount(permute.picks(np.arange(60), 10, 60, 200, 1).ravel(), minlength=60)
    assert abs(seen / seen.mean() - 1).max() < 0.1
    big = permute.picks(np.arange(100), 10, 2**40, 20, 1)
    assert 0.45 < (big > 2**39).mean() < 0.55


def test_scrambling_is_one_to_one():
    x = permute.scrambled(np.arange(200_000, dtype=np.int64))
    assert len(np.unique(x)) == len(x) and x.min() >= 0 and x.max() < permute.P


def test_places_in_order(spark):
    rows = [((i * 37) % 101, i % 3) for i in range(500)] + [(None, 1)]
    got = numbering.numbered(spark.createDataFrame(rows, "a int, b int").repartition(5), [F.col("a").asc_nulls_last(), F.col("b")], "place").collect()
    assert sorted(r["place"] for r in got) == list(range(501))
    key = lambda r: (r["a"] is None, r["a"] or 0, r["b"])
    ordered = [key(r) for r in sorted(got, key=lambda r: r["place"])]
    assert ordered == sorted(ordered)
    assert numbering.numbered(spark.createDataFrame([], "a int"), [F.col("a")], "place").count() == 0


def test_labels(spark):
    want = ["new hotspot", "new coldspot", "consecutive hotspot", "consecutive coldspot", "consecutive hotspot", "consecutive coldspot", "intensifying hotspot", "intensifying hotspot", "intensifying coldspot", "persistent hotspot", "persistent coldspot", "persistent hotspot", "persistent hotspot", "diminishing hotspot", "diminishing coldspot", "no pattern detected", "oscilating hotspot", "oscilating coldspot", "historical hotspot", "historical coldspot", "sporadic hotspot", "sporadic coldspot", "no pattern detected", "no pattern detected"]
    got = [r["classification"] for r in queries.labels_of_codes(spark.createDataFrame([(i, *p) for i, p in enumerate(queries.PATTERNS)], "id int, code string, tau double, p double")).orderBy("id").collect()]
    assert got == want
    assert set(got) - {classify.NONE} <= set(classify.LABELS)


def test_cleaning(spark):
    rows = [("1.5d", 0.0), (" 2 ", 2.0), ("1e3", 1000.0), ("inf", math.inf), ("nan", 0.0), ("", 0.0), (None, 0.0), ("-.5", -0.5), ("invalid", 0.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "v string, w double").select(numeric.clean_value(F.col("v"))).collect()]
    assert got == [w for _, w in rows]


def test_geometry(spark):
    df = spark.createDataFrame([("POLYGON ((0 0, 1e0 0, 1 1, 0 1, 0 0))",), ("MULTIPOLYGON (((0 0, 2 0, 2 2, 0 0)))",), ("POINT (1 -2.5)",), (None,)], "w string")
    sizes = [None if r[0] is None else len(r[0]) for r in df.select(geo.wkt_vertices(F.col("w"))).collect()]
    assert sizes == [5, 4, 1, None]
    with pytest.raises(Exception, match="WKT"):
        spark.createDataFrame([("nonsense",)], "w string").select(geo.wkt_vertices(F.col("w"))).collect()
    wrong = ["POLYGON ((0 0, 1 1", "POLYGON ((0 0, 1 x))", "POINT (1)", "POINT (1 2) x", "POLYGON ((0 0,, 1 1))", "POLYGON", "POINT (1 2 3 4 5)", "POLYGON ((0 0) (1 1))"]
    right = ["POINT Z (1 2 3)", "point(1 2)", "POLYGON EMPTY", "MULTIPOINT ((1 2), (3 4))", "LINESTRING (0 0, 1e-3 .5)", None]
    told = spark.createDataFrame([(w,) for w in wrong + right], "w string").select(geo.wkt_problem(F.col("w")), geo.wkt_vertices(F.col("w"), strict=False)).collect()
    assert all(r[0] and r[1] is None for r in told[: len(wrong)])
    assert [None if r[1] is None else len(r[1]) for r in told[len(wrong) :]] == [1, 1, 0, 2, 2, None]
    assert not any(r[0] for r in told[len(wrong) :])


def test_unions_of_cells(spark):
    rng = random.Random(4)
    side = 0.0439453125
    for _ in range(40):
        codes = ["9q8" + "".join(rng.choice(geo.BASE32) for _ in range(rng.choice([1, 2, 2, 2, 2]))) for _ in range(rng.randint(1, 200))]
        fine = {x for c in codes for x in ([c] if len(c) == 5 else [c + d for d in geo.BASE32])}
        shape = union.geohashes_to_polygon(codes)
        rings = [[tuple(map(float, p.split())) for p in r.split(",")] for r in re.findall(r"\(([^()]+)\)", shape)]
        area = sum(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:], strict=False)) / 2 for r in rings)  # holes turn the other way
        assert area == pytest.approx(len(fine) * side * side)
        assert all(r[0] == r[-1] and len(set(r)) == len(r) - 1 for r in rings)
    edges = dissolve.border(dissolve.topmost_cells(spark.createDataFrame([(1, c) for c in codes], "g int, code string"), "g", "code"))
    units = edges.agg(F.sum(F.abs(F.col("x2") - F.col("x1")) / (1 << 17) + F.abs(F.col("y2") - F.col("y1")) / (1 << 18))).first()[0]
    lengths = sum(abs(a[0] - b[0]) / side + abs(a[1] - b[1]) / side for r in rings for a, b in zip(r, r[1:], strict=False))
    assert units == pytest.approx(lengths)
    assert union.geohashes_to_polygon([None]) == "POLYGON EMPTY" and union.geohash_to_polygon("9q").startswith("POLYGON ((-123.75 33.75, -112.5 33.75")
    with pytest.raises(ValueError):
        union.geohash_to_polygon("9a")


def test_neighbours_of_points_and_near_vertices(spark):
    points = spark.createDataFrame([("a", "POINT (0 0)"), ("b", "POINT (0 0)"), ("c", "POINT (1 0)"), ("d", "POINT (1.0000000000000002 0)")], "region string, geometry string")
    pairs = {(r[0], r[1]) for r in weights.queen_edges(points).collect()}
    assert pairs == {("a", "a"), ("b", "b"), ("c", "c"), ("d", "d"), ("a", "b"), ("b", "a")}
    assert ("c", "d") in {(r[0], r[1]) for r in weights.queen_edges(points, snap=9).collect()}


def test_cube(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("b", 1, None), ("a", 2, 2.0)], "region string, t int, x double")
    assert cube.complete(df, "region", "t").count() == 4
    assert [tuple(r) for r in cube.gaps(df, "region", "t").collect()] == [("b", 2)]
    empty = df.limit(0)
    assert cube.complete(empty, "region", "t").count() == 0


def test_arguments(spark):
    for bad in (0, -1, 1.5, "99", 10000, True):
        with pytest.raises(ValueError):
            permute.check_nsim(bad)
    with pytest.warns(UserWarning):
        permute.check_nsim(1000)
    df = spark.createDataFrame([("a", 1, 1.0)], "region string, t int, x double")
    with pytest.raises(KeyError):
        ehsa.emerging_hotspot_analysis(df, "region", "wrong", "x")


def test_analysis_of_short_and_gappy_input(spark, tmp_path):
    geometry = "POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))"
    one = spark.createDataFrame([("a", 1, 5.0, geometry), ("b", 1, 6.0, geometry)], "region string, t int, x double, geometry string")
    out = ehsa.emerging_hotspot_analysis(one, "region", "t", "x", nsim=9, save_log=True, log_dir=str(tmp_path), summary=True).collect()
    assert {r["classification"] for r in out} == {"skipped_insufficient_data"}
    assert all(math.isnan(r["tau"]) and r["mann_kendall_details"] is None for r in out)
    assert any(p.startswith("ehsa_log_") for p in os.listdir(tmp_path))
    dirty = spark.createDataFrame([("a", t, str(t), geometry) for t in range(8)] + [("b", 1, "junk", geometry), ("b", 1, "2", geometry)], "region string, t int, x string, geometry string")
    assert {r["region"] for r in ehsa.emerging_hotspot_analysis(dirty, "region", "t", "x", nsim=19).collect()} == {"a", "b"}


def test_regions_that_cannot_be_read(spark):
    rows = spark.createDataFrame([(r, t, float(t), g) for r, g in (("a", "POINT (0 0)"), ("b", "POLYGON ((0 0, 1")) for t in range(3)], "region string, t int, x double, geometry string")
    got = ehsa.emerging_hotspot_analysis(rows, "region", "t", "x", nsim=9, ordered=True).collect()
    assert [r["region"] for r in got] == ["a", "b"]
    out = {r["region"]: r for r in got}
    assert out["a"]["classification"] != "error_processing" and out["a"]["classification_details"]["error_message"] is None
    assert out["b"]["classification"] == "error_processing" and "POLYGON ((0 0, 1" in out["b"]["classification_details"]["error_message"]
    assert len(out["b"]["location_data"]) == 3 and out["b"]["spatial_context_summary"]["neighbors_config"] == ["b"]
    with pytest.raises(Exception, match="WKT"):
        ehsa.emerging_hotspot_analysis(rows, "region", "t", "x", nsim=9, on_error="raise").collect()
    with pytest.raises(ValueError):
        ehsa.emerging_hotspot_analysis(rows, "region", "t", "x", nsim=9, on_error="other")


def test_public_names(spark):
    import heatlattice

    for name in heatlattice.__all__:
        assert callable(getattr(heatlattice, name))
    with pytest.raises(AttributeError):
        heatlattice.nothing  # noqa: B018
    for series in ([1, 2, 3, 4, 5, 6], [1, 2, 2, 3, 3, 3, 4], [0, 0, 5e-11, 1], [5], [3] * 6):
        plain = heatlattice.MannKendall.mann_kendall_test(series)
        row = spark.createDataFrame([([float(x) for x in series],)], "s array<double>").select(trend.mann_kendall(F.col("s")).alias("m")).first()["m"]
        assert {k: v for k, v in plain.items() if k != "x"} == pytest.approx(row.asDict(), abs=1e-12)
    edges = heatlattice.SpatialWeights.calculate_spatial_weights(square_grid(spark, 3), "region")
    cells = spark.createDataFrame([(str(r), t, float((r * 7 + t) % 5)) for t in range(2) for r in range(9)], "id string, month int, v double")
    scored = heatlattice.GiStar.calculate_gi_star_spacetime(cells, edges, "id", "month", "v", nsim=9)
    assert scored.columns == ["id", "month", "v", "gi", "p_sim", "cluster"] and scored.count() == 18
    done = heatlattice.EhsaClassification.perform_emerging_hotspot_analysis(scored.toDF("region", "t", "x", "gi", "p_sim", "cluster"), edges)
    assert done.count() == 9


def test_dates_and_projection(spark, tmp_path):
    assert [str(d) for d in ingest.periods("2023-11-30", 4)] == ["2023-11-30", "2023-12-31", "2024-01-31", "2024-02-29"]
    assert [str(d) for d in ingest.periods("2023-01-01", 3, "30 days")] == ["2023-01-01", "2023-01-31", "2023-03-02"]
    with pytest.raises(ValueError):
        ingest.with_geometry(spark.createDataFrame([("POINT (0 0)",)], "geometry string"), srid=29193)
    line = '{"type":"Feature","geometry":{"type":"%s","coordinates":%s},"properties":{"id":%d}}'
    found = [line % ("Point", "[1, 2.5]", 1), line % ("Polygon", "[[[0,0],[2,0],[2,2],[0,0]]]", 2), line % ("MultiPolygon", "[[[[0,0],[2,0],[2,2],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]", 3)]
    (tmp_path / "a.geojson").write_text("\n".join(found) + "\n")
    (tmp_path / "b.geojson").write_text('{"type":"FeatureCollection","features":[' + ",".join(found) + "]}")
    for name in "ab":
        got = ingest.read_geojson(spark, str(tmp_path / f"{name}.geojson"))
        shapes = got.select(geo.wkt_problem(F.col("geometry")).alias("p"), geo.polygon_metrics(geo.wkt_polygons(F.col("geometry")))["area"].alias("a"), F.get_json_object("properties", "$.id").alias("id")).orderBy("id").collect()
        assert [(r["p"], r["a"], r["id"]) for r in shapes] == [(None, 0.0, "1"), (None, 2.0, "2"), (None, 2.5, "3")]
        back = export.features(got).collect()
        assert sorted(json.loads(r[0])["geometry"]["type"] for r in back) == ["MultiPolygon", "Point", "Polygon"]


def test_reference_systems(spark):
    one = spark.range(1)
    at = lambda pair: tuple(one.select(*pair).first())
    # A published example of transverse Mercator, on the ellipsoid of Clarke 1866.
    clarke = projection.Crs("tm", (6378206.4, 294.9786982), {"central_meridian": -75.0, "latitude_of_origin": 0.0, "scale_factor": 0.9996, "false_easting": 0.0, "false_northing": 0.0})
    assert at(projection.from_degrees(F.lit(-73.5), F.lit(40.5), clarke)) == pytest.approx((127106.5, 4484124.4), abs=0.06)
    text = """PROJCS["Grid",GEOGCS["Old",DATUM["Old_Datum",SPHEROID["Bessel 1841",6377397.155,299.1528128],TOWGS84[598.1,73.7,418.2,0.202,0.045,-2.455,6.7]],PRIMEM["Paris",2.33722917],UNIT["degree",0.0174532925199433]],
      PROJECTION["Transverse_Mercator"],PARAMETER["latitude_of_origin",50],PARAMETER["central_meridian",9],PARAMETER["scale_factor",1],PARAMETER["false_easting",3500000],PARAMETER["false_northing",0],UNIT["foot",0.3048]]"""
    old = projection.of_text(text)
    assert old.meridian == pytest.approx(2.33722917) and old.unit == 0.3048 and len(old.shift) == 7
    for crs in (old, clarke, projection.of_srid(31983), projection.of_srid(32601), projection.of_srid(3857), projection.of_text(queries._PRJ)):
        lon, lat = (crs.parameters.get("central_meridian", 9.0) + crs.meridian + 2.5, -47.25)
        x, y = at(projection.from_degrees(F.lit(lon), F.lit(lat), crs))
        # Turning a shift round by its signs leaves millimetres.
        assert at(projection.to_degrees(F.lit(x), F.lit(y), crs)) == pytest.approx((lon, lat), abs=1e-6 if crs.shift else 1e-10)
    # The shift against geocentric coordinates, by fixed-point steps.
    geocentric = lambda lon, lat, a, f: (lambda e2, v: (v * math.cos(lat) * math.cos(lon), v * math.cos(lat) * math.sin(lon), v * (1 - e2) * math.sin(lat)))((2 - f) * f, a / math.sqrt(1 - (2 - f) * f * math.sin(lat) ** 2))
    x, y, z = geocentric(math.radians(8), math.radians(50), 6377397.155, 1 / 299.1528128)
    rx, ry, rz = (math.radians(v / 3600) for v in (0.202, 0.045, -2.455))
    x, y, z = 598.1 + (1 + 6.7e-6) * (x - rz * y + ry * z), 73.7 + (1 + 6.7e-6) * (rz * x + y - rx * z), 418.2 + (1 + 6.7e-6) * (-ry * x + rx * y + z)
    e2, lat = (2 - 1 / 298.257223563) / 298.257223563, math.radians(50)
    for _ in range(30):
        lat = math.atan2(z + e2 * 6378137.0 / math.sqrt(1 - e2 * math.sin(lat) ** 2) * math.sin(lat), math.hypot(x, y))
    place = projection.Crs("degrees", old.ellipsoid, {}, 1.0, 0.0, old.shift)
    assert at(projection.to_degrees(F.lit(8.0), F.lit(50.0), place)) == pytest.approx((math.degrees(math.atan2(y, x)), math.degrees(lat)), abs=1e-10)
    for wrong in ("GEOGCS[]", "LOCAL_CS[]", text.replace("Transverse_Mercator", "Lambert"), text.replace("TOWGS84[598.1,73.7,418.2,0.202,0.045,-2.455,6.7]", "AUTHORITY[1]"), text.replace(",0.202,0.045,-2.455,6.7", ",1")):
        with pytest.raises(ValueError):
            projection.of_text(wrong)
    with pytest.raises(ValueError):
        projection.utm(61, False)


def test_stream_of_events(spark, tmp_path):
    from heatlattice.streaming import cube as stream

    rows = [(u, f"2024-01-{day:02d} {hour:02d}:00:00") for day in range(1, 8) for hour in (1, 13) for u in (1, 2)]
    events = spark.createDataFrame(rows, "user_id int, ts string").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "events"))
    got = {}

    def keep(batch, number):
        for r in batch.collect():
            got[r["region"], str(r["t"].date())] = r["x"]

    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    query = stream.windowed(source, "user_id").writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(keep).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    # The watermark lies two days behind the last event, so later windows stay open.
    assert got == {(str(u), f"2024-01-{day:02d}"): 2.0 for u in (1, 2) for day in range(1, 5)}
    assert stream.windowed(events, "user_id").count() == 14


def test_stream_of_scores(spark, tmp_path):
    from heatlattice.streaming import cube as stream

    rng = random.Random(5)
    days = [1, 2, 3, 6, 7, 8, 9, 12, 13]  # days without events are no slices
    folder = tmp_path / "events"
    folder.mkdir()
    rows = []
    for n, day in enumerate(days):
        own = [(u, f"2024-01-{day:02d} {rng.randrange(24):02d}:00:00") for u in range(9) for _ in range(rng.randrange(1, 6))]
        # An event a day late counts, one that comes after its day has closed does not.
        own += [(4, f"2024-01-{days[n - 1]:02d} 23:30:00")] if n in (1, 2) else [(4, "2024-01-01 12:00:00")] if n == 6 else []
        rows += own[:-1] if n == 6 else own
        spark.createDataFrame(own, "user_id int, ts string").select("user_id", F.col("ts").cast("timestamp").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "part"), mode="overwrite")
        part = next((tmp_path / "part").glob("*.parquet"))
        part.rename(folder / f"{n:02d}.parquet")
        os.utime(folder / f"{n:02d}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    squares = queries.squares(spark.range(9).withColumnRenamed("id", "key"), 3)
    edges = weights.queen_edges(squares)
    events = spark.createDataFrame(rows, "user_id int, ts string").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    source = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    got = {}
    for k in (0, 2):
        scorer = stream.GiStarStream(edges, str(tmp_path / f"out {k}"), k)
        assert scorer.start(source(), "user_id", str(tmp_path / f"progress {k}"), {"availableNow": True}).awaitTermination(300)
        got[k] = {(r["region"], r["t"]): (r["x"], round(r["gi"], 9)) for r in scorer.scores(spark).collect()}
        want = gistar.gi_star(cube.keyed(stream.windowed(events, "user_id")), edges, k).where("t < '2024-01-11'").collect()
        assert got[k] == {(r["region"], r["t"]): (r["x"], round(r["gi"], 9)) for r in want}
        assert len(list((tmp_path / f"out {k}" / "slices").glob("batch=*"))) == 2
        # A batch that is repeated leaves what it left.
        numbers = sorted(int(p.name[6:]) for p in (tmp_path / f"out {k}" / "scores").glob("batch=*"))
        again = spark.read.parquet(scorer._path("scores", numbers[-1])).select("region", "t", "x").collect()
        scorer.step(spark.createDataFrame(again, "region string, t timestamp, x double"), numbers[-1])
        assert {(r["region"], r["t"]): (r["x"], round(r["gi"], 9)) for r in scorer.scores(spark).collect()} == got[k]
    assert got[0] != got[2]


def _shapefile(keys: list[int]) -> tuple[bytes, bytes]:
    """Unit squares of a grid, five wide, as the bytes of a .shp and a .dbf file."""
    body, rows = b"", b""
    for i, k in enumerate(keys):
        x, y = float(k % 5), float(k // 5)
        ring = [(x, y), (x, y + 1), (x + 1, y + 1), (x + 1, y), (x, y)]
        content = struct.pack("<i4d2ii", 5, x, y, x + 1, y + 1, 1, 5, 0) + b"".join(struct.pack("<2d", *p) for p in ring)
        body += struct.pack(">2i", i + 1, len(content) // 2) + content
        rows += b" " + str(k).rjust(8).encode()
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8)
    field = b"KEY".ljust(11, b"\0") + b"N" + bytes(4) + bytes([8, 0]) + bytes(14)
    return head + body, struct.pack("<4BIHH20x", 3, 0, 0, 0, len(keys), 32 + 32 + 1, 9) + field + b"\r" + rows


def test_shapefiles(spark, tmp_path):
    record = lambda k, content: struct.pack(">2i", k, len(content) // 2) + content
    rings = lambda kind, parts: struct.pack("<i4d2i", kind, 0, 0, 0, 0, len(parts), sum(map(len, parts))) + struct.pack(f"<{len(parts)}i", *[sum(map(len, parts[:i])) for i in range(len(parts))]) + b"".join(struct.pack("<2d", *p) for r in parts for p in r)
    outer, hole, other = [(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)], [(1, 1), (3, 1), (3, 3), (1, 3), (1, 1)], [(9, 9), (9, 10), (10, 10), (9, 9)]
    body = record(1, struct.pack("<i2d", 1, 2.5, -1)) + record(2, rings(5, [outer, hole, other])) + record(3, struct.pack("<i", 0)) + record(4, rings(3, [outer[:2]])) + record(5, struct.pack("<i4di4d", 8, 0, 0, 0, 0, 2, 1, 2, 3, 4))
    (tmp_path / "a.shp").write_bytes(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8) + body)
    (tmp_path / "b.SHP").write_bytes(_shapefile([3, 7])[0])
    (tmp_path / "b.DBF").write_bytes(_shapefile([3, 7])[1])
    got = {(r["name"], r["number"]): (r["geometry"], r["attributes"]) for r in shapes.read_shapefiles(spark, str(tmp_path)).collect()}
    assert got["a", 1] == ("POINT (2.5 -1.0)", None) and got["a", 3] == (None, None) and got["b", 2][1] == {"KEY": "7"}
    assert got["a", 4][0] == "LINESTRING (0.0 0.0, 0.0 4.0)" and got["a", 5][0] == "MULTIPOINT (1.0 2.0, 3.0 4.0)"
    df = spark.createDataFrame([(got["a", 2][0],)], "w string").select(geo.wkt_problem(F.col("w")), geo.polygon_metrics(geo.wkt_polygons(F.col("w")))["area"]).first()
    assert tuple(df) == (None, 12.5) and len(got) == 7
    with pytest.raises(ValueError):
        list(shapes.records_of(b"nothing"))


def test_shapefile_source(spark, tmp_path):
    from heatlattice.sources import shapefile_source as source

    spark.dataSource.register(source.ShapefileSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    folder = str(tmp_path / "own")
    square = "POLYGON (({0} 0.0, {1} 0.0, {1} 1.0, {0} 1.0, {0} 0.0))"
    rows = [(str(k), k, square.format(float(k), k + 1.0)) for k in range(500)] + [("hole", None, "MULTIPOLYGON (((0 0, 9 0, 9 9, 0 9, 0 0), (1 1, 1 2, 2 2, 2 1, 1 1)), ((20 0, 21 0, 21 1, 20 0)))"), ("é" * 40, -1, None)]
    frame = spark.createDataFrame(rows, "name string, number long, geometry string").repartition(3)
    frame.write.format("shapefile").option("rows", 150).mode("append").save(folder)
    names = sorted(p.name for p in (tmp_path / "own").iterdir())
    assert len([n for n in names if n.endswith(".shp")]) == 6 and not [n for n in names if n.startswith("_")]
    read = spark.read.format("shapefile").option("portion", 4000).load(folder)
    assert read.rdd.getNumPartitions() > 12
    got = {r["attributes"]["name"]: r for r in read.collect()}
    assert len(got) == len(rows) == read.count() and got["7"]["attributes"]["number"] == "7" and got["é" * 40]["geometry"] is None
    area = lambda df: df.select(F.sum(geo.polygon_metrics(geo.wkt_polygons(F.col("geometry")))["area"])).first()[0]
    assert area(read) == 500 + 80.5 and got["7"]["max_x"] == 8.0 and got["hole"]["min_x"] == 0.0
    # The same through whole files, and without index or attributes.
    assert area(shapes.read_shapefiles(spark, folder)) == 580.5
    east = read.where("min_x >= 490 and max_y < 2")
    assert east.count() == 10 and read.where("max_x < 2").count() == 1 and read.where("min_x > 1000").count() == 0
    reader = source.ShapefileReader({"path": folder, "portion": "4000"})
    list(reader.pushFilters([source.GreaterThan(("min_x",), 1000.0)]))
    assert reader.partitions() == []
    for p in (tmp_path / "own").iterdir():
        if p.suffix in (".shx", ".dbf"):
            p.unlink()
    bare = spark.read.format("shapefile").load(folder)
    assert area(bare) == 580.5 and bare.where("attributes is not null").count() == 0 and bare.rdd.getNumPartitions() == 6
    frame.limit(0).write.format("shapefile").mode("overwrite").save(folder)
    assert not list((tmp_path / "own").glob("*.shp"))
    for wrong, why in ((frame.withColumn("name", F.repeat(F.lit("x"), 99)), "more than 80 bytes"), (frame.withColumn("geometry", F.lit("POINT (1 2)")), "not of shape polygon")):
        with pytest.raises(Exception, match=why):
            wrong.write.format("shapefile").mode("append").save(folder)
    assert not list((tmp_path / "own").glob("*.shp"))
    line = source.content_of("LINESTRING (0 0, 1 2)", "line")
    assert shapes.wkt_of(line[0]) == "LINESTRING (0.0 0.0, 1.0 2.0)" and shapes.wkt_of(source.content_of("POINT (1 2)", "point")[0]) == "POINT (1.0 2.0)"


def test_paths_and_pages(spark, tmp_path):
    for bad in ("/etc/x.html", "../x.html", str(tmp_path / "x.txt"), ""):
        with pytest.raises(ValueError):
            export.check_path(bad)
    df = spark.createDataFrame([("a</script>", "new hotspot", 0.5, 0.01, "POINT (1 2)")], "region string, classification string, tau double, p_value double, geometry string")
    page = open(export.save_visualization(str(tmp_path / "m.html"), df)).read()
    assert "<circle" in page and "a</script>" not in page
    with pytest.raises(ValueError):
        export.plot_map(df, lib="other")
    with pytest.raises(ValueError):
        export.render(df.unionByName(df), most=1)
    for lib in ("plotly", "folium"):
        assert 'id="find"' in export.plot_map(df, lib=lib)
    assert 'id="find"' not in export.plot_map(df) and export.COLOURS["new coldspot"] == "#87CEEB"
    holed = df.withColumn("geometry", F.lit("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 3, 3 3, 3 1, 1 1))"))
    assert export.plot_map(holed).count("M") >= 2 and len(json.loads(export.features(holed).first()[0])["geometry"]["coordinates"]) == 2
    assert os.path.exists(export.launch_visualization(None, auto_open=False))
    assert export.records(df).count() == 1
    assert '"Point"' in export.features(df).first()[0]
    export.write_guarded_csv(df, str(tmp_path / "csv"))


def test_ingest(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿dp_cod;latr01;hom15\n1;2,5;x\n")
    df = ingest.read_table(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["DP_COD", "LATR01", "HOM15"]
    assert {(r["year"], r["crime_total"]) for r in ingest.yearly_totals(df, ["DP_COD"]).collect()} == {(2001, 2.5), (2015, 0.0)}


def duck(folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{folder}/{name}')")
    return con


@pytest.mark.parametrize("name", ["cube_gaps", "queen_edges", "gi_star_k1", "gi_star_positional_gaps", "p_sim", "p_sim_numpy", "mk_ties", "ehsa_full", "ehsa_nested", "ehsa_positional_gaps", "ehsa_error_rows", "geohash_union_polygons", "geojson_features", "shapefile_read", "map_tiles", "csv_round_trip", "skipped_regions", "yearly_totals"])
def test_against_sql(spark, name):
    got = queries.QUERIES[name](spark, SMALL).toPandas()
    want = duck(SMALL).execute(queries.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    plain = lambda f: sorted(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in f[cols].itertuples(index=False))
    assert plain(got) == plain(want)


