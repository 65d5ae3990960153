"""Emerging hot spot analysis from rows to labels."""

from __future__ import annotations

import logging
import time
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import wkt_problem
from ..operators import classify, cube, gistar, permute, weights
from ..storage import discard, staged

log = logging.getLogger("heatlattice")


def prepare(df: DataFrame, region: str, time_field: str, value: str) -> DataFrame:
    """The clean cube (region, t, x) without the cells that df lacks: they would be dropped again, so no grid is built."""
    cube.require(df, region, time_field, value)
    return cube.dropna(cube.clean(df, value, region), value).select(F.col(region).alias("region"), F.col(time_field).alias("t"), F.col(value).alias("x"))


def gi_star_spacetime(observations: DataFrame, edges: DataFrame, k: int = 1, nsim: int = 199, seed: int = 77, gap_policy: str = "positional", backend: str = "auto") -> DataFrame:
    """observations (region, t, x) with gi, p_sim and cluster; gap_policy 'positional' or 'keyed' (the same on a
    complete cube)."""
    permute.check_nsim(nsim)
    if gap_policy not in ("positional", "keyed"):
        raise ValueError("gap_policy must be 'positional' or 'keyed'")
    # Index, slice statistics, neighbour sums and values all read the cube; it is made once.
    observations = staged(observations.select("region", "t", "x"), "cube")
    if gap_policy == "positional":
        names = cube.slots(observations)
        near = edges.join(names, "region").join(names.select(F.col("region").alias("neighbor"), F.col("slot").alias("nb")), "neighbor")
        obs, near = cube.positional(observations), near.select(F.col("slot").alias("region"), F.col("nb").alias("neighbor"))
    else:
        obs, near = cube.keyed(observations), edges
    scored = permute.p_values(gistar.gi_star(obs, near, k), nsim, seed, backend)
    discard(observations)  # the scored table holds it
    return scored.withColumn("cluster", gistar.cluster_label(F.col("gi"), F.col("p_sim")))


def gi_star_by_period(observations: DataFrame, edges: DataFrame) -> DataFrame:
    """Former name of gi_star_spacetime with its defaults."""
    return gi_star_spacetime(observations, edges)


def handlers(save_log: bool, log_dir: str | None) -> list[logging.Handler]:
    """A console handler, and one for a file if asked for."""
    out: list[logging.Handler] = [logging.StreamHandler()]
    if save_log:
        folder = Path(log_dir or ".")
        folder.mkdir(parents=True, exist_ok=True)
        out.append(logging.FileHandler(folder / f"ehsa_log_{datetime.now():%Y%m%d_%H%M%S}.txt"))
    for handler in out:
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(handler)
    log.setLevel(logging.INFO)
    return out


def emerging_hotspot_analysis(
    df: DataFrame, region_id_field: str, time_period_field: str, value: str, seed: int = 77, save_log: bool = False, log_dir: str | None = None,
    k: int = 1, nsim: int = 49, gap_policy: str = "positional", backend: str = "auto", snap: int | None = None, summary: bool = False,
    on_error: str = "row", ordered: bool = False,
) -> DataFrame:
    """One row for each region with its pattern. The default nsim of 49 cannot reach the significance level of 0.01; use 99
    or more to find patterns.

    A region whose geometry cannot be read has no neighbour but itself and is `error_processing` with a message; with
    on_error "raise" it ends the run. Progress goes to the console, and to a file with save_log. With save_log or summary
    the result is computed at once, written to the shared folder, and its time and label counts are logged. Rows come in
    the order of the region if `ordered`, else in none.
    """
    permute.check_nsim(nsim)
    if on_error not in ("row", "raise"):
        raise ValueError("on_error must be 'row' or 'raise'")
    cube.require(df, region_id_field, time_period_field, value, "geometry")
    writers = handlers(save_log, log_dir)
    try:
        began = time.time()
        log.info("analysis of %s by %s and %s, k %d, nsim %d, seed %d", value, region_id_field, time_period_field, k, nsim, seed)
        observations = prepare(df, region_id_field, time_period_field, value)
        geo = cube.region_geometry(df.withColumn(region_id_field, F.coalesce(F.col(region_id_field).cast("string"), F.lit("None"))), region_id_field)
        geo = staged(geo, "geometry")  # a row for each region, for contiguity and problems
        edges = staged(weights.queen_edges(geo, region_id_field, "geometry", snap, on_error == "raise"), "edges")  # for sums and result
        problems = None
        if on_error == "row" and dict(geo.dtypes)["geometry"] == "string":
            problems = geo.select(F.col(region_id_field).alias("region"), wkt_problem(F.col("geometry")).alias("problem")).where("problem is not null")
        series = gi_star_spacetime(observations, edges, k, nsim, seed, gap_policy, backend)
        log.info("Gi* and draws prepared in %.2f s", time.time() - began)
        done = classify.classified(classify.region_figures(series.select("region", "t", "x", "gi", "p_sim")))
        out = classify.result(done, edges, region_id_field, problems=problems)
        if summary or save_log:
            out = staged(out, "ehsa")
            for row in classify.label_distribution(out).orderBy(F.desc("regions")).collect():
                log.info("%s: %d (%.1f %%)", row["classification"], row["regions"], row["percent"])
            log.info("tau: %s", classify.describe_tau(out).first().asDict())
            log.info("computed in %.2f s", time.time() - began)
        return out.orderBy(region_id_field) if ordered else out
    finally:
        for handler in writers:
            log.removeHandler(handler)
            handler.close()
