"""Mann-Kendall trend test over an array column: as expressions, or for long series by counting inversions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numeric import normal_cdf

EPSILON = 1e-10


def mann_kendall(series: Column) -> Column:
    """struct<tau, sl, S, D, varS> of array<double> in time order; NaN and null are left out first."""
    x = F.filter(series, lambda v: v.isNotNull() & ~F.isnan(v))
    n = F.size(x)
    sign = lambda a, b: F.when(F.abs(b - a) <= EPSILON, 0).when(b > a, 1).otherwise(-1)
    rows = F.transform(x, lambda a, i: F.aggregate(F.slice(x, i + 2, F.greatest(n - i - 1, F.lit(0))), F.lit(0), lambda s, b: s + sign(a, b)))
    s = F.aggregate(rows, F.lit(0), lambda p, q: p + q)
    d = (n * (n - 1) / 2).cast("int")
    plain = n * (n - 1) * (2 * n + 5) / F.lit(18.0)
    sizes = F.transform(F.array_distinct(x), lambda v: F.size(F.filter(x, lambda y: F.abs(y - v) < EPSILON)))
    ties = F.aggregate(sizes, F.lit(0.0), lambda a, t: a + t * (t - 1) * (2 * t + 5)) / 18.0
    var = F.when(F.size(F.array_distinct(x)) < n, plain - ties).otherwise(plain)
    return F.when(n <= 1, _result(F.lit(0.0), F.lit(1.0), F.lit(0), F.lit(0), F.lit(0.0))).otherwise(_scored(s, d, var))


def _scored(s: Column, d: Column, var: Column) -> Column:
    # One struct first, so that the double fold is written once in the plan.
    base = F.struct(s.alias("s"), d.alias("d"), var.alias("v"))

    def finish(b):
        z = (F.abs(b["s"]) - 1) / F.sqrt(F.greatest(b["v"], F.lit(1e-300)))
        sl = F.when((b["v"] <= EPSILON) | (b["s"] == 0), 1.0).otherwise(2 * (1 - normal_cdf(z)))
        return _result(F.round(b["s"] / b["d"], 15), F.round(sl, 15), b["s"], b["d"], F.round(b["v"], 15))

    return F.get(F.transform(F.array(base), finish), F.lit(0))


def _result(tau: Column, sl: Column, s: Column, d: Column, var: Column) -> Column:
    return F.struct(tau.cast("double").alias("tau"), sl.cast("double").alias("sl"), s.cast("int").alias("S"), d.cast("int").alias("D"), var.cast("double").alias("varS"))


def _boundary(ordered: np.ndarray, x: np.ndarray, holds) -> np.ndarray:
    """For each x, how many of the ordered values hold(x, value); those that do come first. Exact to the last bit."""
    low, high = np.zeros(len(x), np.int64), np.full(len(x), len(ordered))
    while (low < high).any():
        mid = (low + high) // 2
        on = holds(x, ordered[np.minimum(mid, len(ordered) - 1)]) & (low < high)
        low, high = np.where(on, mid + 1, low), np.where(on | (low >= high), high, mid)
    return low


def _counts(x: np.ndarray) -> tuple[int, float, int]:
    """S, the tie term and the number of different values of a series, in O(n log^2 n)."""
    n = len(x)
    ordered, at = np.unique(x, return_inverse=True)
    # Values below x by more than EPSILON are the first ones; those above it, the last ones.
    below = _boundary(ordered, x, lambda b, a: (b > a) & (np.abs(b - a) > EPSILON))
    upto = _boundary(ordered, x, lambda b, a: ~((a > b) & (np.abs(b - a) > EPSILON)))
    s, width = 0, 1
    # Bottom up: pairs of neighbouring blocks, the earlier one sorted by value; all blocks of a width at once.
    while width < n:
        place = np.arange(n)
        pair, late = place // (2 * width), (place // width) % 2 == 1
        step = len(ordered) + 1
        early = np.sort(pair[~late] * step + at[~late])
        start = np.searchsorted(early, pair[late] * step)
        less = np.searchsorted(early, pair[late] * step + below[late]) - start
        rest = np.searchsorted(early, (pair[late] + 1) * step) - np.searchsorted(early, pair[late] * step + upto[late])
        s += int(less.sum()) - int(rest.sum())
        width *= 2
    sums = np.append(0, np.cumsum(np.bincount(at, minlength=len(ordered))))
    t = sums[_boundary(ordered, ordered, lambda b, a: (a < b) | (np.abs(b - a) < EPSILON))] - sums[_boundary(ordered, ordered, lambda b, a: (a < b) & ~(np.abs(b - a) < EPSILON))]
    t = t.astype(float)
    return s, float((t * (t - 1) * (2 * t + 5)).sum()), len(ordered)


def mann_kendall_long(series: Column) -> Column:
    """`mann_kendall` for series of any length: struct<tau, sl, S, D, varS> with S and D as long, in time n log^2 n."""

    def counted(rows: pa.Array) -> pa.Array:
        out = []
        for row in rows:
            if not row.is_valid:
                out.append(None)
                continue
            x = row.values.to_numpy(zero_copy_only=False).astype(float)
            x = x[~np.isnan(x)] + 0.0
            out.append({"n": len(x)} | dict(zip(("s", "ties", "kinds"), _counts(x) if len(x) else (0, 0.0, 0), strict=True)))
        return pa.array(out, pa.struct([("n", pa.int64()), ("s", pa.int64()), ("ties", pa.float64()), ("kinds", pa.int64())]))

    def finish(c):
        n = c["n"]
        plain = n.cast("double") * (n - 1) * (2 * n + 5) / F.lit(18.0)
        var = F.when(c["kinds"] < n, plain - c["ties"] / 18.0).otherwise(plain)
        d = (n * (n - 1) / 2).cast("long")
        z = (F.abs(c["s"]) - 1) / F.sqrt(F.greatest(var, F.lit(1e-300)))
        sl = F.when((n <= 1) | (var <= EPSILON) | (c["s"] == 0), 1.0).otherwise(2 * (1 - normal_cdf(z)))
        kept = lambda v, none: F.when(n <= 1, none).otherwise(v)
        return F.struct(kept(F.round(c["s"] / d, 15), 0.0).alias("tau"), F.round(sl, 15).alias("sl"), kept(c["s"], 0).cast("long").alias("S"), kept(d, 0).cast("long").alias("D"), kept(F.round(var, 15), 0.0).alias("varS"))

    return F.get(F.transform(F.array(F.arrow_udf(counted, "struct<n:bigint,s:bigint,ties:double,kinds:bigint>")(series)), finish), F.lit(0))
