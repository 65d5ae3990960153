"""Quality rules with risk-controlled thresholds (native: DataFrame functions only).

Each rule is a ratio, in thousandths, that junk has more of. The strata are the languages; those with labelled good
documents are counted. For each of them and each rule the labelled holdout of good documents decides which cutoffs may be
used: from the most lenient candidate on, a cutoff is certified while the exact binomial test rejects "more than `risk` of
the good documents lie above it" at level delta / (rules * strata); the first failure ends the sequence (fixed-sequence
testing, Bonferroni over rules and strata). So with confidence 1 - delta every certified cutoff, whichever is chosen,
rejects at most `risk` of the good documents of its stratum. Chosen is the one above which lie most labelled bad documents
over good ones, the more lenient on ties; where none has more bad than good ones above it, the rule rejects nothing. A
stratum with too few labels certifies nothing and rejects only by the base rule.

Defined cases: a null or blank text has no words, fails the base rule and is not kept; a null language is the stratum "";
a document with contradictory labels counts as good; null labels are ignored; repeated rows are decided one by one; empty
tables give empty results; columns of documents that carry the names used here are passed through untouched by
`filter_quality`, which decides on doc_id, text and lang alone.
Windows are compared by 64-bit hashes within one document.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: name: (numerator, denominator, scale)
RULES = {
    "symbols": ("n_symbols", "word_chars", 1000),
    "dup_lines": ("n_dup_lines", "n_lines", 1000),
    "repeats": ("n_repeat_words", "n_words", 1000),
    "long_words": ("word_chars", "n_words", 10),
}
CUTOFFS = (10, 20, 30, 50, 75, 100, 150, 200, 300, 400, 500, 700)
RISK, DELTA = 0.03, 0.1
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs and the columns BASE, n_lines and base_failed, in one narrow pass."""
    keep = [F.col(f"`{c}`") for c in docs.columns]
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(*keep, F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("_w"), F.split(t, "\n").alias("_l"), t.alias("_t"))
    df = df.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.regexp_replace("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter("_l", lambda x: x.rlike(WORD)).alias("_l"),
        F.when(
            F.size("_w") >= 3,
            F.slice(F.transform("_w", lambda x, i: F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2))), 1, F.greatest(F.size("_w") - 2, F.lit(0))),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("_h"),
    )
    base = [*keep, F.col("n_words"), F.col("word_chars"), F.col("n_symbols")]
    df = df.select(
        *base,
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("_s"),
    )
    base += [F.col("n_lines"), F.col("n_dup_lines")]
    twice = lambda x, k: (F.get("_s", k + 1)["h"] == x["h"]) | ((k > 0) & (F.get("_s", F.greatest(k - 1, F.lit(0)))["h"] == x["h"]))
    df = df.select(*base, F.sort_array(F.filter(F.transform("_s", lambda x, k: F.when(twice(x, k), x["i"])), lambda i: i.isNotNull())).alias("_p"))
    covered = F.transform("_p", lambda x, k: F.when(k > 0, F.least(F.lit(3), x - F.get("_p", F.greatest(k - 1, F.lit(0))))).otherwise(3))
    df = df.select(*base, F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"))
    # Always true, but Catalyst takes it for non-deterministic: no filter on these columns is pushed below this projection,
    # where it would repeat the nested expressions once for each reference.
    here = F.spark_partition_id() >= 0
    return df.withColumn("base_failed", ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))) & here)


def ratio(rule: str):
    top, bottom, scale = RULES[rule]
    return F.expr(f"({scale} * {top}) div greatest({bottom}, 1)")


def stratum(lang: str = "lang"):
    return F.coalesce(F.col(lang), F.lit(""))


def lower_tail(k, n, p: float):
    """P(Binomial(n, p) <= k), summed in logarithms; 1 where k is not below the mean, as no test passes there."""
    odds = math.log(p) - math.log1p(-p)
    first = F.struct((n * math.log1p(-p)).alias("t"), F.exp(n * math.log1p(-p)).alias("s"))

    def step(a, j):
        t = a["t"] + F.log(n - j + 1) - F.log(j) + odds
        return F.struct(t.alias("t"), (a["s"] + F.exp(t)).alias("s"))

    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("double").cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k >= n * p, 1.0).otherwise(F.aggregate(terms, first, step, lambda a: a["s"]))


def fit_cutoffs(stats: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """One row for each stratum with a chosen cutoff: the cutoff of each rule, or null."""
    marks = labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("good")).where("good in (0, 1)")
    held = stats.where(~F.col("base_failed")).join(marks, "doc_id")
    above = [F.count_if((ratio(r) > c) & (F.col("good") == g)).alias(f"{r}_{c}_{g}") for r in RULES for c in cutoffs for g in (1, 0)]
    counts = staged(held.groupBy("stratum").agg(F.sum("good").cast("long").alias("n"), *above), "counts")
    strata = counts.where("n > 0").agg(F.count("*").alias("strata"))  # one row
    rows = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"{r}_{c}_1").alias("k"), F.col(f"{r}_{c}_0").alias("bad")) for r in RULES for c in cutoffs))
    long = counts.where("n > 0").join(F.broadcast(strata)).select("stratum", "strata", "n", F.inline(rows))
    tested = long.withColumn("passed", lower_tail(F.col("k"), F.col("n"), risk) <= delta / (len(RULES) * F.col("strata")))
    lenient_first = Window.partitionBy("stratum", "rule").orderBy(F.desc("cutoff"))
    certified = tested.withColumn("certified", F.bool_and("passed").over(lenient_first)).where("certified and bad > k")
    best = lambda r: F.max_by(F.when(F.col("rule") == r, F.col("cutoff")), F.when(F.col("rule") == r, F.struct(F.col("bad") - F.col("k"), "cutoff")))
    return certified.groupBy("stratum").agg(*(best(r).alias(f"cut_{r}") for r in RULES))


def verdict(stats: DataFrame, cuts: DataFrame) -> DataFrame:
    """stats and kept. cuts is a staged table, so the join knows its size and broadcasts it only below Spark's threshold."""
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(ratio(r) > F.col(f"cut_{r}"), F.lit(False))
    return stats.join(cuts, "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~rejected)


def quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, the base statistics, base_failed and kept for each row of docs."""
    slim = docs.select("doc_id", "text", stratum().alias("stratum"))
    stats = staged(with_statistics(slim).drop("text"), "quality")
    out = verdict(stats, staged(fit_cutoffs(stats, labels, **options), "cutoffs"))
    return out.select("doc_id", *BASE, "base_failed", "kept", "stratum", "n_lines")


def filter_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that are kept, with docs' own columns; the texts stay where they are, no shuffle carries them."""
    slim = docs.select("doc_id", "text", stratum().alias("stratum"))
    cuts = staged(fit_cutoffs(with_statistics(slim).drop("text"), labels, **options), "cutoffs")
    own = docs.columns
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("_row"), F.col("text"), stratum().alias("stratum"))
    return verdict(with_statistics(packed), cuts).where("kept").select("_row.*")


def oracle(risk: float = RISK, delta: float = DELTA) -> str:
    """DuckDB SQL for `quality` over documents and labels."""
    rows = ", ".join(f"('{r}', {c})" for r in RULES for c in CUTOFFS)
    value = "case rule " + " ".join(f"when '{r}' then ({s} * {a}) // greatest({b}, 1)" for r, (a, b, s) in RULES.items()) + " end"
    cut = lambda r: f"(select arg_max(cutoff, 1000 * (bad - k) + cutoff) from certified c where ok and bad > k and c.stratum = s.stratum and c.rule = '{r}')"
    verdicts = " and ".join(f"coalesce(({s} * {a}) // greatest({b}, 1) <= {cut(r)}, true)" for r, (a, b, s) in RULES.items())
    return f"""
with t as (select doc_id, coalesce(text, '') as text, coalesce(lang, '') as stratum from documents),
w as (select doc_id, stratum, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from t),
g as (select *, [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)] as g from w),
x as (select doc_id, unnest(g) as g, generate_subscripts(g, 1) as i from g),
d as (select doc_id, i, count(*) over (partition by doc_id, g) as c from x),
p as (select distinct doc_id, i + o as i from d, (values (0), (1), (2)) v(o) where c > 1),
r as (select doc_id, count(*) as n_repeat_words from p group by doc_id),
b as (select g.doc_id, stratum, len(w)::bigint as n_words, length(list_aggregate(w, 'string_agg', ''))::bigint as wc,
        (length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')))::bigint as n_symbols, len(l)::bigint as n_lines,
        (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words
      from g left join r using (doc_id)),
s as (select doc_id, stratum, n_words, coalesce(wc, 0)::bigint as word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words,
        n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from b),
marks as (select doc_id, max(quality) as good from labels where quality is not null group by 1),
h as (select s.*, good from s join marks using (doc_id) where not base_failed and good in (0, 1)),
m as (select count(distinct stratum) as strata from h where good = 1),
k as (select stratum, rule, cutoff, count(*) filter (good = 1) as n, count(*) filter (good = 1 and {value} > cutoff) as k, count(*) filter (good = 0 and {value} > cutoff) as bad
      from h, (values {rows}) v(rule, cutoff) group by all having count(*) filter (good = 1) > 0),
e as (select *, case when k >= n * {risk}::double then 1.0 else
        list_sum([exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({risk}::double) + (n - j) * ln(1 - {risk}::double)) for j in range(0, k + 1)]) end as tail from k),
certified as (select stratum, rule, cutoff, k, bad, bool_and(tail <= {delta}::double / ({len(RULES)} * strata)) over (partition by stratum, rule order by cutoff desc) as ok from e, m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {verdicts} as kept, stratum, n_lines from s"""
