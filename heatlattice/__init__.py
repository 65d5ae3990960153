"""Space-time hot spot analytics expressed as Spark DataFrame transformations."""

__version__ = "0.2.0"
__all__ = [
    "EhsaClassification", "EhsaPlotting", "EmergingHotspotAnalysis", "GiStar", "MannKendall", "PreProcessing", "SpatialWeights",
    "emerging_hotspot_analysis", "geohash_to_polygon", "geohashes_to_polygon", "gi_star_spacetime",
]


def __getattr__(name: str):
    """Public names, loaded when first asked for: workers import parts of the package without them."""
    if name in __all__:
        from . import api

        return getattr(api, name)
    raise AttributeError(name)
