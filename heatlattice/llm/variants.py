"""Spelling variants by an errata trie that is kept as rows.

The trie of all words is a table of (node, next character), a node being a 128-bit hash of the prefix that leads to it; a
word's end is a child of its own. Each node's heavy child is the one with most words below it, so a word leaves heavy
paths at most log2(words) times. Two words one edit apart part at exactly one node, and at least one of them leaves it
by a light child. So for every light child, and nothing else, its words are merged into the rest of their node: with the
light character replaced by the heavy one, with it skipped, and with the heavy one put before it. A merged word that
ends where a word of the table ends is a pair. The node's light children are also merged with each other, their own
character replaced by a wildcard: what meets there differs in that character alone, so a meeting holds one word for each
character of the alphabet at most, and is counted, not paired. Every pair is found once, by one of these ways.

A Python batch walks its words down the trie, one level at a time, in work and rows linear in their characters; all else is
joins and groups on nodes or words. The short prefixes that many words share meet their light child by a join that
adaptive execution splits. Forms grow tenfold from step to step, so roots need five pointer doublings.

Defined cases: null or empty texts have no runs; a null doc_id counts as an empty one in what is hashed; rows that share
a doc_id are read one by one; texts and runs of any length are read whole; of near words that occur equally often the
smallest in code-point order is the form; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, discard, mix, staged

LEAST_CHARS, LEAST_COUNT, FACTOR, SLIP = 7, 2, 10, 31
#: Where the two hashes of a prefix start, and rows that a batch of nodes has at most, but for one level.
SEEDS, ROWS = (0x243F6A8885A308D3, 0x13198A2E03707344), 1 << 18
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def count_words(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, slip: int | None = SLIP) -> DataFrame:
    """(word, n): the letter runs of docs (doc_id, text) with at least least_chars code points, as often as they occur.

    Where slip divides crc32 of `<doc_id>:<run>`, the run loses its code point number crc32 % length first; None: never.
    """
    # Only runs that are long enough before they lose a character can be so after it.
    found = F.expr(f"regexp_extract_all(text, '[A-Za-z\\u00C0-\\u00FF]{{{least_chars},}}', 0)")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(found).alias("run"))
    runs = runs.select("doc", F.translate("run", UPPER, LOWER).alias("word"))
    if slip is not None:
        runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "doc", "word").cast("binary")))
        at = F.pmod("h", F.length("word")).cast("int")
        less = F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2))
        runs = runs.withColumn("word", F.when(F.col("h") % slip == 0, less).otherwise(F.col("word"))).where(F.length("word") >= least_chars)
    return runs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _best(n: str, word: str):
    """Smallest for the largest n, then for the smallest word."""
    return F.struct((-F.col(n)).alias("less"), F.col(word).alias("word"))


def _steps(batches):
    """(id, depth, h1, h2, next): every node of each word, as two hashes of its prefix, and the character behind it ('' at the end)."""
    letters: dict[int, str] = {0: ""}
    with np.errstate(over="ignore"):
        for batch in batches:
            ids = batch.column("id").to_numpy()
            codes = [np.frombuffer(w.encode("utf-32-le"), "<u4") for w in batch.column("word").to_pylist()]
            size = np.array([len(c) for c in codes], np.int64)
            flat, first = np.concatenate(codes) if codes else np.zeros(0, np.uint32), np.cumsum(size) - size
            on, depth = np.arange(len(ids)), 0
            node = [np.full(len(ids), seed, np.uint64) for seed in SEEDS]
            rows, held = [], 0
            while len(on):
                ended = size[on] == depth
                code = np.where(ended, 0, flat[np.minimum(first[on] + depth, len(flat) - 1)])
                rows.append((ids[on], np.full(len(on), depth, np.int32), *(h.view(np.int64) for h in node), code))
                held += len(on)
                node = [mix(h * U64(0x9FB21C651E98DF25) + code.astype(np.uint64))[~ended] for h in node]
                on, depth = on[~ended], depth + 1
                if held >= ROWS or not len(on):
                    columns = [np.concatenate(c) for c in zip(*rows, strict=True)]
                    kinds, back = np.unique(columns.pop(), return_inverse=True)
                    for c in kinds.tolist():
                        letters.setdefault(c, chr(c))
                    last = pa.array([letters[c] for c in kinds.tolist()], pa.string()).take(pa.array(back))
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), last], names=["id", "depth", "h1", "h2", "next"])
                    rows, held = [], 0


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best): for each word (id, word, n) with others one edit away, how many, and the most frequent as (less, word)."""
    steps = staged(words.select("id", "word").mapInArrow(_steps, "id long, depth int, h1 long, h2 long, next string"), "steps")
    children = steps.groupBy("h1", "h2", "next").agg(F.count("*").alias("size"))
    children = staged(children, "children")
    nodes = children.groupBy("h1", "h2").agg(F.max(F.when(F.col("next") != "", F.struct("size", "next")))["next"].alias("heavy"), F.count("*").alias("fan")).where("fan > 1")
    light = children.join(nodes, ["h1", "h2"]).where("next <> heavy").select("h1", "h2", "next", "heavy")
    merged = steps.join(light, ["h1", "h2", "next"]).select("id", "depth", "h1", "h2", "next", "heavy").join(words, "id")
    merged = staged(merged.select("word", "n", "h1", "h2", F.substr("word", F.lit(1), F.col("depth")).alias("node"), "next", F.substr("word", F.col("depth") + 2).alias("rest"), "heavy"), "merged")
    discard(steps, children)

    inner = F.col("next") != ""
    ways = F.array(
        F.when(inner, F.concat("node", "heavy", "rest")),
        # Of equal characters in a row only the last counts as the skipped one.
        F.when(inner & (F.substr("rest", F.lit(1), F.lit(1)) != F.col("next")), F.concat("node", "rest")),
        F.concat("node", "heavy", "next", "rest"),
    )
    tried = merged.select("word", "n", F.explode(ways).alias("other")).where("other is not null")
    pairs = staged(tried.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other"), "pairs")
    one = F.lit(1).cast("long").alias("k")
    met = merged.where(inner).groupBy("h1", "h2", "rest").agg(F.array_sort(F.collect_list(_best("n", "word"))).alias("all")).where(F.size("all") > 1)
    met = met.select(F.explode("all").alias("own"), F.slice("all", 1, 2).alias("top"), (F.size("all") - 1).cast("long").alias("k"))
    near = (
        pairs.select("word", one, _best("other_n", "other").alias("best"))
        .unionByName(pairs.select(F.col("other").alias("word"), one, _best("n", "word").alias("best")))
        .unionByName(met.select(F.col("own.word").alias("word"), "k", F.when(F.col("top")[0]["word"] == F.col("own.word"), F.col("top")[1]).otherwise(F.col("top")[0]).alias("best")))
    )
    out = staged(near.groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best")), "near")
    discard(merged, pairs)
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for each (word, form): forms followed to the last, by pointer doubling."""
    at = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        before, at = at, staged(moved, "roots")
        discard(before)
        if not at.where("moved").limit(1).count():
            return at.select("word", "root")


def variants(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, factor: int = FACTOR, slip: int | None = SLIP) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of docs (doc_id, text)."""
    words = staged(count_words(docs, least_chars, least_count, slip).withColumn("id", F.monotonically_increasing_id()), "words")
    near = words.drop("id").join(near_words(words), "word", "left")
    is_form = F.col("best.word").isNotNull() & (-F.col("best.less") >= factor * F.col("n"))
    out = near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"))
    out = staged(out, "forms")
    roots = _roots(out.where("form is not null").select("word", "form"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle(least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, factor: int = FACTOR, slip: int = SLIP) -> str:
    """DuckDB SQL for `variants` over documents: crc32 bit by bit, pairs by equal rests after one deletion at most."""
    return f"""
with recursive low as (select coalesce(doc_id::varchar, '') as doc, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]{{{least_chars},}}')), '{UPPER}', '{LOWER}') as run from documents),
runs as (select doc, run, count(*) as k from low group by 1, 2),
crc0(i, bit, v) as (select i, 0, i from range(256) t(i) union all
  select i, bit + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from crc0 where bit < 8),
crct as (select list(v order by i) as t from crc0 where bit = 8),
raw as (select doc, run, k, hex(encode(doc || ':' || run)) as x from runs),
hashed as (select run, k, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(x) // 2 + 1), lambda i: ('0x' || x[2 * i - 1 : 2 * i])::bigint)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]::bigint)), 4294967295::bigint) as h from raw, crct),
slipped as (select case when h % {slip} = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, k from hashed),
w as (select word, sum(k)::bigint as n from slipped where length(word) >= {least_chars} group by 1 having sum(k) >= {least_count}),
holes as (select word, n, i, left(word, i - 1) || substr(word, i + 1) as less from (select word, n, unnest(range(1, length(word) + 1)) as i from w)),
pairs as (select a.word as x, b.word as y, b.n as m from holes a join holes b on a.less = b.less and a.i = b.i and a.word <> b.word
  union select h.word, w.word, w.n from holes h join w on h.less = w.word
  union select w.word, h.word, h.n from holes h join w on h.less = w.word),
near as (select x as word, count(*) as n_near, max(m) as m from pairs group by 1),
first as (select x as word, min(y) as y from pairs join near on word = x and pairs.m = near.m group by 1),
f as (select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when near.m >= {factor} * w.n then y end as form, case when near.m >= {factor} * w.n then near.m end as form_n
  from w left join near using (word) left join first using (word)),
chain(word, spot, step) as (select word, word, 0 from f union all select chain.word, f.form, step + 1 from chain join f on f.word = chain.spot where f.form is not null),
root as (select word, arg_max(spot, step) as root from chain group by 1)
select word, form, root, n, n_near, form_n::bigint as form_n from f join root using (word)"""
