"""What costs a lot is computed once for each row, and rows of one small file go to many tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from heatlattice import queries
from heatlattice.functions import geo, numeric, validity
from heatlattice.llm import common, jaccard
from heatlattice.operators import overlay, permute

from .test_geometry_at_scale import CASES

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_cells_are_halved_once(spark):
    df = queries.QUERIES["geohash_geometry"](spark, SMALL)
    assert plan(df).count("aggregate(") < 10
    assert df.rdd.getNumPartitions() > 4


def test_outline_of_a_cell_and_its_figures(spark):
    rows = spark.createDataFrame([("9q8yy",), ("s",), (None,)], "c string").select(geo.geohash_wkt(F.col("c")).alias("w"))
    v = geo.wkt_vertices(F.col("w"))
    found = rows.select(F.size(v).alias("n"), geo.ring_metrics(v).alias("m")).collect()
    assert (found[1].n, found[1].m.area, found[1].m.cx, found[1].m.max_y) == (5, 45.0 * 45.0, 22.5, 45.0)
    assert found[0].m.area == pytest.approx((360 / 2**13) * (180 / 2**12))
    assert found[2].m.area is None


def test_rounding_is_that_of_the_sql(spark):
    value = F.lit(-55.888373516499996)  # F.round gives ...516
    assert spark.range(1).select(numeric.scaled_round(value, 9)).first()[0] == -55.888373517


def test_polygons_are_tested_once_and_many_at_a_time(spark):
    df = queries.QUERIES["polygon_holes"](spark, SMALL)
    told = plan(df)
    assert told.count("ArrowEvalPython") == 1 and told.split("ArrowEvalPython", 1)[1].split("]", 1)[0].count("reasons(") == 1
    assert told.count("aggregate(") < 12
    assert df.rdd.getNumPartitions() > 4
    shapes = [shape for own in CASES.values() for shape in own]
    reasons = [reason for reason, own in CASES.items() for _ in own]
    assert validity.problems([*shapes * 300, None]) == [*reasons * 300, None]


def test_repeated_polygons_are_read_once(spark):
    box, beside = "POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))", "POLYGON ((1 0, 2 0, 2 1, 1 1, 1 0))"
    rows = spark.createDataFrame([("a", box)] * 3 + [("a", beside), ("a", None), (None, box), (None, box)], "g string, w string")
    found = {(r.grp, r.x1, r.y1, r.x2, r.y2): r.m for r in overlay.sides(rows, "g", "w", 1.0).collect()}
    assert ("a", 1, 0, 1, 1) not in found  # the shared side cancels however often either box comes
    assert len(found) == 6 + 4 and {abs(m) for m in found.values()} == {1}
    assert queries._land(spark, SMALL).rdd.getNumPartitions() > 4


def test_rounds_of_components_broadcast_nothing(spark, monkeypatch):
    told = []
    written = common.staged

    def staged(df, name):
        told.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    for module in (common, jaccard):
        monkeypatch.setattr(module, "staged", staged)
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 8), (9, 9)], "u long, v long")
    assert {tuple(r) for r in common.components(edges, "u", "v").collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (7, 7), (8, 7)}
    words = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, words), (2, words + " end"), (3, words), (4, "other words altogether here"), (5, None)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard.jaccard_components(docs).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)}
    assert len(told) > 10 and not any("Broadcast" in t for t in told)


def test_draws_without_divisions():
    x = np.array([0, 1, permute.P - 1, permute.P, permute.P + 1, 2 * permute.P, 2**62 - 2**33, permute.P**2], np.int64)
    assert (permute.mod_p(x) == x % permute.P).all()
    for n in (1, 2, 3, 699, 2**31 + 11, 2**40):
        assert (permute.mod_n(x, n) == x % n).all()
    rows = np.random.default_rng(1).integers(0, 400, (3000, 40))
    for m in (1, 2, 18, 40):
        assert (permute.repeats(rows[:, :m]) == [len(set(r)) < m for r in rows[:, :m].tolist()]).all()
