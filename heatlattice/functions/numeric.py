"""Column expressions: value cleaning, the normal distribution, text guards, map figures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i)inf(inity)?|(?i)nan)$"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once for each row however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scaled_round(value: Column, digits: int) -> Column:
    """value rounded as DuckDB rounds: the scaled double goes to the nearest integer, halves away from zero."""
    return F.round(value * 10.0**digits) / 10.0**digits


def to_double(value: Column, numeric: bool = False) -> Column:
    """A number as double; of text only what reads as one plain number, else null."""
    if numeric:
        return value.cast("double")
    text = F.trim(value.cast("string"))
    word = F.lower(F.regexp_replace(text, "^[+-]", ""))
    sign = F.when(text.startswith("-"), -1.0).otherwise(1.0)
    return (
        F.when(word.isin("inf", "infinity"), sign * F.lit(float("inf")))
        .when(word == "nan", F.lit(float("nan")))
        .when(text.rlike(NUMBER), text.try_cast("double"))
    )


def clean_value(value: Column, numeric: bool = False) -> Column:
    """Nulls, NaN and what is no number become 0."""
    return F.coalesce(F.nanvl(to_double(value, numeric), F.lit(0.0)), F.lit(0.0))


def region_text(region: Column) -> Column:
    return F.coalesce(region.cast("string"), F.lit("None"))


def normal_cdf(z: Column, terms: int = 150) -> Column:
    """Distribution function of the standard normal for z >= 0, by 0.5 + density * sum z^(2k+1) / (1 * 3 * ... * (2k+1))."""
    start = F.struct(z.alias("t"), z.alias("s"))

    def step(a, k):
        t = a["t"] * z * z / (2 * k + 1)
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, step, lambda a: a["s"])
    return F.when(z >= 8.3, 1.0).otherwise(0.5 + F.exp(-z * z / 2) / 2.5066282746310002 * series)


#: Characters that make a spreadsheet read a cell as a formula (fixed values).
FORMULA_STARTS = ["=", "+", "-", "@", "\t", "\r", "\n", "|"]


def formula_guard(text: Column, numeric_safe: bool = False) -> Column:
    """Text with a quote before a leading formula character; with numeric_safe plain numbers stay."""
    risky = F.substring(text, 1, 1).isin(FORMULA_STARTS)
    if numeric_safe:
        risky = risky & ~text.rlike(NUMBER)
    return F.when(risky, F.concat(F.lit("'"), text)).otherwise(text)


def script_escape(text: Column) -> Column:
    return F.regexp_replace(text, "(?i)</script>", r"<\\/script>")


def map_zoom(span: Column) -> Column:
    """Zoom level for a span of degrees: between 4 and 12, one more below 0.01, one less above 100."""
    base = F.when(span <= 0, 12.0).otherwise(F.greatest(F.lit(4.0), F.least(F.lit(12.0), 9 - F.log2(span))))
    return F.when(span < 0.01, F.least(F.lit(12.0), base + 1)).when(span > 100, F.greatest(F.lit(4.0), base - 1)).otherwise(base)


def hover_text(region: Column, label: Column, tau: Column, p: Column) -> Column:
    return F.concat(F.lit("Region ID: "), region, F.lit("<br>Classification: "), label, F.lit("<br>Tau: "), F.format_string("%.4f", tau), F.lit("<br>P-value: "), F.format_string("%.4f", p))
