"""Pattern labels from each region's series of Gi*, significance and trend, as group aggregates and one CASE.

Labels keep their fixed spelling, among them `oscilating`. Shares of 0.9 are tested in integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gistar import THRESHOLD
from .trend import mann_kendall

#: Labels and map colours (fixed order and spelling).
LABELS = [
    "new hotspot", "new coldspot", "consecutive hotspot", "consecutive coldspot", "intensifying hotspot", "intensifying coldspot",
    "persistent hotspot", "persistent coldspot", "diminishing hotspot", "diminishing coldspot", "oscilating hotspot", "oscilating coldspot",
    "historical hotspot", "historical coldspot", "sporadic hotspot", "sporadic coldspot",
]
NONE = "no pattern detected"


def conditions(n: Column, sig: Column, hot: Column, cold: Column, run: Column, last_sig: Column, last: Column, tau: Column, p: Column, threshold: float = THRESHOLD) -> dict[str, Column]:
    """Every label's condition on: periods, significant, hot and cold ones, length of the significant run at the end,
    whether the last is significant, its Gi*, and the trend; the first that holds is the label."""
    high = lambda k: 10 * k >= 9 * n
    up, down = last > 0, last < 0
    only_run = (run == sig) & last_sig
    trend = p <= threshold
    return {
        "new hotspot": (sig == 1) & last_sig & up,
        "new coldspot": (sig == 1) & last_sig & down,
        "consecutive hotspot": only_run & up & ~high(hot),
        "consecutive coldspot": only_run & down & ~high(cold),
        "intensifying hotspot": high(sig) & last_sig & (tau > 0) & (p < threshold),
        "intensifying coldspot": high(cold) & last_sig & (tau < 0) & trend,
        "persistent hotspot": high(hot) & (p > threshold),
        "persistent coldspot": high(cold) & (p > threshold),
        "diminishing hotspot": high(hot) & last_sig & up & (tau < 0) & trend,
        "diminishing coldspot": high(cold) & last_sig & (tau > 0) & trend,
        "oscilating hotspot": (10 * hot <= 9 * n) & last_sig & up & (cold > 0),
        "oscilating coldspot": ~high(cold) & last_sig & down & (hot > 0),
        "historical hotspot": high(hot) & down,
        "historical coldspot": high(cold) & up,
        "sporadic hotspot": ~high(hot) & (cold == 0) & (hot > 0),
        "sporadic coldspot": ~high(cold) & (hot == 0) & (cold > 0),
    }


def label(**figures) -> Column:
    made = None
    for name, test in conditions(**figures).items():
        made = F.when(test, name) if made is None else made.when(test, name)
    return made.otherwise(NONE)


def region_figures(series: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each region of (region, t, gi, p_sim): the figures that labels need, and the series in time order."""
    sig = F.col("p_sim") <= threshold
    gs = F.coalesce(F.nanvl("gi", F.lit(0.0)), F.lit(0.0))
    value = F.col("x") if "x" in series.columns else F.lit(None).cast("double")
    rows = series.select("region", "t", gs.alias("gi"), F.col("gi").alias("raw"), F.coalesce(sig, F.lit(False)).alias("sig"), value.alias("x"))
    grouped = rows.groupBy("region").agg(
        F.sort_array(F.collect_list(F.struct("t", "gi", "sig", "raw", "x"))).alias("series"),
        F.count("*").alias("n"),
        F.count_if("sig").alias("n_sig"),
        F.count_if(F.col("sig") & (F.col("gi") > 0)).alias("n_hot"),
        F.count_if(F.col("sig") & (F.col("gi") < 0)).alias("n_cold"),
        F.bool_and(F.isnan("raw") | F.col("raw").isNull()).alias("all_nan"),
    )
    last = F.element_at("series", -1)
    quiet = F.array_max(F.transform("series", lambda s, i: F.when(~s["sig"], i + 1)))
    return grouped.select(
        "*",
        last["sig"].alias("last_sig"),
        last["gi"].alias("last_gi"),
        (F.col("n") - F.coalesce(quiet, F.lit(0))).alias("run"),
        mann_kendall(F.transform("series", lambda s: s["gi"])).alias("mk"),
    )


def classified(figures: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """figures with classification, tau, p_value."""
    skipped = F.when(F.col("n") <= 1, "skipped_insufficient_data").when(F.col("all_nan"), "skipped_all_nan")
    tau, p = F.col("mk.tau"), F.col("mk.sl")
    named = label(n=F.col("n"), sig=F.col("n_sig"), hot=F.col("n_hot"), cold=F.col("n_cold"), run=F.col("run"), last_sig=F.col("last_sig"), last=F.col("last_gi"), tau=tau, p=p, threshold=threshold)
    nan = F.lit(float("nan"))
    out = figures.withColumn("classification", F.coalesce(skipped, F.when(F.isnan(tau) | F.isnan(p), NONE), named))
    live = ~F.col("classification").startswith("skipped")
    return out.withColumns({"tau": F.when(live, tau).otherwise(nan), "p_value": F.when(live, p).otherwise(nan)})


#: What each label says, and the figures that decide on it.
REASONS = {
    "new hotspot": ("Only the last period is significant, and it is hot.", ("significant", "last")),
    "new coldspot": ("Only the last period is significant, and it is cold.", ("significant", "last")),
    "consecutive hotspot": ("One unbroken significant run, the only one, ends hot in the last period.", ("last", "run", "significant", "hot_share")),
    "consecutive coldspot": ("One unbroken significant run, the only one, ends cold in the last period.", ("last", "run", "significant", "cold_share")),
    "intensifying hotspot": ("Significant nearly always and at the end, with a significant upward trend.", ("share", "last", "trend")),
    "intensifying coldspot": ("Cold nearly always and significant at the end, with a significant downward trend.", ("cold_share", "last", "trend")),
    "persistent hotspot": ("Hot nearly always, without a significant trend.", ("hot_share", "trend")),
    "persistent coldspot": ("Cold nearly always, without a significant trend.", ("cold_share", "trend")),
    "diminishing hotspot": ("Hot nearly always and at the end, with a significant downward trend.", ("hot_share", "last", "trend")),
    "diminishing coldspot": ("Cold nearly always and significant at the end, with a significant upward trend.", ("cold_share", "last", "trend")),
    "oscilating hotspot": ("Hot at the end after cold periods.", ("last", "cold", "hot_share")),
    "oscilating coldspot": ("Cold at the end after hot periods.", ("last", "hot", "cold_share")),
    "historical hotspot": ("Hot nearly always, but below the mean at the end.", ("hot_share", "last")),
    "historical coldspot": ("Cold nearly always, but above the mean at the end.", ("cold_share", "last")),
    "sporadic hotspot": ("Hot now and then, never cold.", ("hot", "cold", "hot_share")),
    "sporadic coldspot": ("Cold now and then, never hot.", ("cold", "hot", "cold_share")),
}
SKIPPED = {"skipped_insufficient_data": "There is at most one time period.", "skipped_all_nan": "All Gi* values are missing.", "error_processing": "The region could not be processed.", NONE: "No pattern's conditions hold."}


def criteria(threshold: float = THRESHOLD) -> Column:
    """The deciding figures of a region's label as sentences, from columns of `classified`."""
    count = lambda k, what: F.format_string(f"%d of %d periods are {what}", F.col(k), F.col("n"))
    share = lambda k, what: F.format_string(f"share of {what} periods: %.2f (limit 0.90)", F.col(k) / F.col("n"))
    said = {
        "significant": count("n_sig", "significant"),
        "hot": count("n_hot", "significantly hot"),
        "cold": count("n_cold", "significantly cold"),
        "share": share("n_sig", "significant"),
        "hot_share": share("n_hot", "significantly hot"),
        "cold_share": share("n_cold", "significantly cold"),
        "run": F.format_string("the significant run at the end has %d periods", F.col("run")),
        "last": F.format_string("Gi* of the last period: %.4f, significant: %s", F.col("last_gi"), F.initcap(F.col("last_sig").cast("string"))),
        "trend": F.format_string(f"trend: tau %.4f, p %.4f (level {threshold})", F.col("tau"), F.col("p_value")),
    }
    made = F.lit(None).cast("array<string>")
    for name, (_, facts) in reversed(REASONS.items()):
        made = F.when(F.col("classification") == name, F.array(*(said[f] for f in facts))).otherwise(made)
    return F.coalesce(made, F.array().cast("array<string>"))


def _reason() -> Column:
    texts = {name: text for name, (text, _) in REASONS.items()} | SKIPPED
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in texts.items() for x in pair)), F.col("classification"))


def result(done: DataFrame, edges: DataFrame, field: str = "region", threshold: float = THRESHOLD, problems: DataFrame | None = None) -> DataFrame:
    """The nested result, one row for each region. Regions in problems (region, problem) are `error_processing` and keep
    what was computed for them. Rows come in no order; `orderBy` the region for one."""
    near = edges.groupBy("region").agg(F.sort_array(F.collect_list("neighbor")).alias("near"))
    if problems is None:
        done = done.withColumn("problem", F.lit(None).cast("string"))
    else:
        done = done.join(problems, "region", "left")
    done = done.withColumn("classification", F.when(F.col("problem").isNotNull(), "error_processing").otherwise(F.col("classification")))
    c = F.col("classification")
    live = ~c.startswith("skipped")
    gs = F.transform("series", lambda s: s["gi"])
    text = lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss") if dict(done.select(F.col("series")[0]["t"].alias("t")).dtypes)["t"].startswith("timestamp") else t.cast("string")
    none = F.array().cast("array<string>")
    return done.join(near, "region", "left").select(
        F.col("region").alias(field),
        c.alias("classification"),
        F.struct(
            criteria(threshold).alias("criteria_met"),
            _reason().alias("reason"),
            F.col("problem").alias("error_message"),
            F.struct(
                F.transform(gs, lambda g: F.round(g, 4)).alias("gi_star_series"),
                F.transform("series", lambda s: s["sig"]).alias("significance_series"),
                F.col("n").cast("int").alias("num_time_periods"),
                F.col("tau").alias("mann_kendall_tau"),
                F.col("p_value").alias("mann_kendall_p_value"),
                F.lit(threshold).alias("mk_significance_threshold"),
            ).alias("values_at_decision"),
        ).alias("classification_details"),
        F.when(
            live,
            F.struct(
                F.struct(F.col("n").cast("int").alias("time_periods_count"), gs.alias("gi_star_values_over_time"), F.transform("series", lambda s: s["raw"]).alias("original_gi_star_values")).alias("inputs"),
                F.col("mk").alias("results"),
            ),
        ).alias("mann_kendall_details"),
        F.struct(
            F.coalesce("near", none).alias("neighbors_config"),
            F.transform(F.coalesce("near", none), lambda x: 1.0 / F.size("near")).alias("weights_config"),
            F.when(c == "error_processing", "Queen contiguity with the region itself, as far as its geometry could be read").otherwise("Queen contiguity with the region itself, equal weights").alias("note"),
        ).alias("spatial_context_summary"),
        F.transform("series", lambda s: F.struct(text(s["t"]).alias("time_period"), s["gi"].alias("value"), s["sig"].alias("is_significant"), s["x"].alias("original_value"))).alias("location_data"),
        "tau",
        "p_value",
    )


def label_distribution(results: DataFrame) -> DataFrame:
    total = results.agg(F.count("*").alias("total"))
    counts = results.groupBy("classification").agg(F.count("*").alias("regions"))
    return counts.join(F.broadcast(total)).select("classification", "regions", (100.0 * F.col("regions") / F.col("total")).alias("percent"))  # one row


def describe_tau(results: DataFrame) -> DataFrame:
    return results.where(~F.isnan("tau")).agg(F.count("*").alias("n"), F.avg("tau").alias("mean"), F.stddev_samp("tau").alias("std"), F.min("tau").alias("low"), F.max("tau").alias("high"))
