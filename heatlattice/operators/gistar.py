"""Space-time Getis-Ord Gi* in closed form: weights are equal within a neighbourhood and cancel.

With n values in the time slice, mean and population variance of that slice, and m neighbour values with sum s over the
slice and k earlier ones: (s - m * mean) / (sd * sqrt(m * (n - m) / (n - 1))) if n > m and the variance is positive, else 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.01


def slice_stats(obs: DataFrame) -> DataFrame:
    return obs.groupBy("b").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"))


def lag_sums(obs: DataFrame, edges: DataFrame, k: int = 1) -> DataFrame:
    """(r, b, s, m): sum and number of neighbour values; a value counts for its own time and the k after it."""
    shifted = obs.select(F.col("r").alias("neighbor"), "x", F.explode(F.sequence(F.col("b"), F.col("b") + k)).alias("b"))
    return shifted.join(edges.select(F.col("region").alias("r"), "neighbor"), "neighbor").groupBy("r", "b").agg(F.sum("x").alias("s"), F.count("*").alias("m"))


def closed_form(s: Column, m: Column, n: Column, mean: Column, var: Column) -> Column:
    usable = (n > m) & (m > 0) & (var > 0) & ~F.isnan(var)
    return F.when(usable, (s - m * mean) / F.sqrt(var * m * (n - m) / F.greatest(n - 1, F.lit(1)))).otherwise(0.0)


def gi_star(obs: DataFrame, edges: DataFrame, k: int = 1) -> DataFrame:
    """obs (region, t, x, r, b, surplus) and s, m, n, mean, var, gi; surplus rows have gi 0."""
    real = obs.where(~F.col("surplus"))
    out = obs.join(slice_stats(real), "b", "left").join(lag_sums(real, edges, k), ["r", "b"], "left")
    gi = closed_form(F.col("s"), F.col("m"), F.col("n"), F.col("mean"), F.col("var"))
    return out.withColumn("gi", F.when(F.col("surplus") | F.col("m").isNull(), 0.0).otherwise(gi))


def cluster_label(gi: Column, p: Column, threshold: float = THRESHOLD) -> Column:
    return F.when((p <= threshold) & (gi > 0), "Hot Spot").when((p <= threshold) & (gi < 0), "Cold Spot").otherwise("Not Significant")


def significance_counts(scored: DataFrame, levels: tuple[float, ...] = (0.01, 0.05)) -> DataFrame:
    """One row: the cells, and those with p_sim at most each level."""
    return scored.agg(F.count("*").alias("cells"), *(F.count_if(F.col("p_sim") <= x).alias(f"at_{x:g}".replace(".", "_")) for x in levels))
