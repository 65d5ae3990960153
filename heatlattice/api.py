"""Public names, grouped by what they are about. Everything takes and returns DataFrames, but where plain lists are said."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import geo, union
from .operators import classify, cube, trend, weights
from .plans import ehsa
from .sources import export, ingest

emerging_hotspot_analysis = ehsa.emerging_hotspot_analysis
gi_star_spacetime = ehsa.gi_star_spacetime
geohash_to_polygon = union.geohash_to_polygon
geohashes_to_polygon = union.geohashes_to_polygon


class EmergingHotspotAnalysis:
    """The analysis, and pages of its results."""

    emerging_hotspot_analysis = staticmethod(ehsa.emerging_hotspot_analysis)
    launch_visualization = staticmethod(export.launch_visualization)
    save_visualization = staticmethod(export.save_visualization)


class GiStar:
    """Space-time Gi* with p-values: frames of (region, t, x) and edges, or of named columns."""

    gi_star_spacetime = staticmethod(ehsa.gi_star_spacetime)

    @staticmethod
    def calculate_gi_star_spacetime(df: DataFrame, w: DataFrame, region_id_field: str, time_period_field: str, value: str, k: int = 1, nsim: int = 199, **options) -> DataFrame:
        """df's region, time and value with gi, p_sim and cluster; w as of SpatialWeights."""
        names = {region_id_field: "region", time_period_field: "t", value: "x"}
        cells = df.select(*(F.col(a).alias(b) for a, b in names.items()))
        out = ehsa.gi_star_spacetime(cells, w.select("region", "neighbor"), k, nsim, **options)
        return out.select(*(F.col(b).alias(a) for a, b in names.items()), "gi", "p_sim", "cluster")

    @classmethod
    def calculate_gi_star_by_period(cls, df: DataFrame, w: DataFrame, region_id_field: str, time_period_field: str, value: str) -> DataFrame:
        """Former name of calculate_gi_star_spacetime with its defaults."""
        return cls.calculate_gi_star_spacetime(df, w, region_id_field, time_period_field, value)


class MannKendall:
    """The trend test: of an array column, or of a plain list."""

    column = staticmethod(trend.mann_kendall)

    @staticmethod
    def mann_kendall_test(x: Sequence[float]) -> dict:
        """x (None), tau, sl, S, D and varS of a list in time order; NaN and None are left out."""
        v = [float(a) for a in x if a is not None and not math.isnan(a)]
        n = len(v)
        if n <= 1:
            return {"x": None, "tau": 0.0, "sl": 1.0, "S": 0, "D": 0, "varS": 0.0}
        steps = [b - a for i, a in enumerate(v) for b in v[i + 1 :]]
        s = sum(d > trend.EPSILON for d in steps) - sum(d < -trend.EPSILON for d in steps)
        var = n * (n - 1) * (2 * n + 5) / 18
        if len(set(v)) < n:
            sizes = [sum(abs(a - b) < trend.EPSILON for b in v) for a in set(v)]
            var -= sum(t * (t - 1) * (2 * t + 5) for t in sizes) / 18
        sl = 1.0 if s == 0 or var <= trend.EPSILON else math.erfc((abs(s) - 1) / math.sqrt(2 * var))
        return {"x": None, "tau": round(s / len(steps), 15), "sl": round(sl, 15), "S": s, "D": len(steps), "varS": round(var, 15)}


class EhsaClassification:
    """Labels: `conditions` has every label's test as an expression on a region's figures."""

    LABELS = tuple(classify.LABELS)
    conditions = staticmethod(classify.conditions)
    classify_hotspot = staticmethod(classify.label)
    region_figures = staticmethod(classify.region_figures)
    classified = staticmethod(classify.classified)

    @staticmethod
    def condition(name: str, **figures: Column) -> Column:
        """The test of one label, as `new hotspot`."""
        return classify.conditions(**figures)[name]

    @staticmethod
    def perform_emerging_hotspot_analysis(series: DataFrame, w: DataFrame, region_id_field: str = "region", threshold: float = classify.THRESHOLD) -> DataFrame:
        """The nested result of scored cells (region, t, x, gi, p_sim)."""
        return classify.result(classify.classified(classify.region_figures(series, threshold), threshold), w, region_id_field, threshold)


class EhsaPlotting:
    """Maps, viewer and exports."""

    plot_ehsa_map_interactive = staticmethod(lambda df, region_id_field=None, title="Emerging hot spots", lib="plotly": export.plot_map(df, title, region_id_field, lib))
    plot_ehsa_map_static = staticmethod(lambda df, title="Emerging hot spots": export.plot_map(df, title))
    open_visualization_tool = staticmethod(export.launch_visualization)
    save_ehsa_visualization_tool = staticmethod(export.save_visualization)
    launch_ehsa_viewer = staticmethod(export.launch_viewer)
    write_csv = staticmethod(export.write_csv)
    write_guarded_csv = staticmethod(export.write_guarded_csv)
    features = staticmethod(export.features)


class PreProcessing:
    """Cleaning, geometry and the cube."""

    validate_and_clean_data = staticmethod(cube.clean)
    complete_spacetime_cube = staticmethod(cube.complete)
    process = staticmethod(ingest.with_geometry)
    get_geohash_geometries = staticmethod(geo.with_geohash_geometry)


class SpatialWeights:
    """Queen contiguity with the region itself."""

    queen_edges = staticmethod(weights.queen_edges)
    create_spacetime_neighbors_and_weights = staticmethod(weights.spacetime_edges)

    @staticmethod
    def calculate_spatial_weights(geo_frame: DataFrame, region_id_field: str) -> DataFrame:
        """(region, neighbor, weight), weights of a region equal and summing to one."""
        return weights.standardised(weights.queen_edges(geo_frame, region_id_field))
