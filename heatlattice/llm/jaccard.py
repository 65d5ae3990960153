"""Exact n-gram Jaccard self-join by a token-group matrix.

A document's set holds the 64-bit hashes of its distinct n-word shingles. Equal sets collapse to one class first. All
sets follow one global token order, commonest tokens last (frequencies from a sketch of fixed size; the order only steers
the work, any order is exact), so that two sets within the threshold share a token among the first
p(n) = n - ceil(t * n) + 1 of each. A class is first compared with one other, the smallest class of most of its leading
tokens; the links found make the groups. The token-group matrix then holds, for each token, the groups whose union of
leading tokens has it, with their smallest and largest set. Of two sets whose leading tokens share c, the one whose last
leading token comes first overlaps the other in at most c + n - p(n); so a class opens a group only if it is another
group and the tokens it shares with the group's union can reach the threshold for a set of the group's sizes, and within
an opened group only the members that pass the same bound are compared. A token counts only where the shared tokens ahead
of it and the elements behind it, on both sides, leave room for that overlap. This repeats with the groups grown by the links,
one member of each opened group at first, then all, until no comparison is left that could join two groups.
Comparisons that could only repeat a known connection are never made, so groups of copies cost linear work. Joins are
sort-merge joins by hint: a broadcast passes a side through the driver, and dozens of them at once cost it memory.

Defined cases: null or blank texts have an empty set, link with nothing and are their own component; with fewer words
than a shingle the whole sequence is one shingle; rows that share a doc_id are one node; rows whose doc_id is null get a
null component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, U64, bitmap, components, discard, in_bitmap, mix, portions, staged, utf8, word_hashes, words

SKETCH_BITS, BLOCK = 23, 1 << 15
PORTION = 1 << 20
#: Sets that are compared with one copy of a class's set at most.
SPREAD = 128


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    data = LOWER[data]
    starts, ends, row = words(data, offsets)
    h = word_hashes(data, starts, ends)
    n = len(offsets) - 1
    per_row = np.bincount(row, minlength=n)
    first = np.concatenate([[0], np.cumsum(per_row)])
    step = U64(0x9FB21C651E98DF25)
    s = h.copy()
    if len(h) >= width:
        t = h[: len(h) - width + 1].copy()
        for o in range(1, width):
            t = mix(t * step + h[o : len(h) - width + 1 + o])
        s[: len(t)] = t
    out = []
    for i in range(n):
        a, b = first[i], first[i + 1]
        if b - a >= width:
            v = np.sort(s[a : b - width + 1])
            out.append(v[np.concatenate([[True], v[1:] != v[:-1]])])
        elif b > a:
            t = U64(0x1B873593) * U64(b - a)
            for x in h[a:b]:
                t = mix(np.array([t * step + x]))[0]
            out.append(np.array([t], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    with np.errstate(over="ignore"):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            data, at = utf8(batch.column("text"))
            for i, j in portions(at, PORTION):
                yield ids[i:j], shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], width)


def _summaries(width: int):
    def run(batches):
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        for ids, sets in _rows(batches, width):
            digests = [hashlib.md5(s.tobytes(), usedforsecurity=False).digest() if len(s) else None for s in sets]
            if sum(map(len, sets)):
                np.add.at(sketch, (np.concatenate(sets) >> U64(64 - SKETCH_BITS)).astype(np.int64), 1)
            none = pa.nulls(len(ids), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), none, pa.nulls(len(ids), pa.binary())], names=["doc_id", "n", "digest", "block", "counts"])
        counts = np.minimum(sketch, 65535).astype("<u2").reshape(-1, BLOCK)
        for b, row in enumerate(counts):
            if row.any():
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([b], pa.int32()), pa.array([pa.compress(row.tobytes(), "zstd", asbytes=True)], pa.binary())], names=["doc_id", "n", "digest", "block", "counts"])

    return run


def _added(batches):
    """Sums of the sketch blocks of this task, one row for each block, and their total."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, raw in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            have = total.setdefault(b, np.zeros(BLOCK, np.int64))
            have += np.frombuffer(pa.decompress(raw, 2 * BLOCK, "zstd"), "<u2")
    for b, row in total.items():
        row = np.minimum(row, 2**31)
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([int(row.sum())], pa.int64()), pa.array([pa.compress(row.astype("<u4").tobytes(), "zstd", asbytes=True)], pa.binary())], names=["block", "total", "counts"])


def _leveled(mean: float):
    """Blocks of counts as blocks of levels, one byte a slot."""

    def run(batches):
        for batch in batches:
            rows = [np.frombuffer(pa.decompress(raw, 4 * BLOCK, "zstd"), "<u4") for raw in batch.column("counts").to_pylist()]
            levels = [np.clip(np.floor(2 * np.log2(np.maximum(row, 1) / mean)), 0, 31).astype(np.uint8).tobytes() for row in rows]
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(levels, pa.binary())], names=["block", "levels"])

    return run


def _levels(summaries: DataFrame) -> np.ndarray:
    """For each slot of the sketch, how much commoner than the mean its tokens are, in powers of the root of two (0 to 31)."""
    blocks = summaries.where("block is not null").select("block", "counts")
    parts = (1 << SKETCH_BITS) // BLOCK
    counts = staged(blocks.repartition(parts, "block").mapInArrow(_added, "block int, total long, counts binary"), "counts")
    mean = max(4.0, (counts.agg(F.sum("total")).first()[0] or 0) / (1 << SKETCH_BITS))
    found = counts.mapInArrow(_leveled(mean), "block int, levels binary").toArrow()  # one byte a slot
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    for b, raw in zip(found["block"], found["levels"], strict=True):
        b = b.as_py()
        out[b * BLOCK : (b + 1) * BLOCK] = np.frombuffer(raw.as_buffer(), np.uint8)
    discard(counts)
    return out


def _leading(width: int, percent: int, levels):
    def run(batches):
        level = levels.value
        for ids, sets in _rows(batches, width):
            rows = []
            for i, s in zip(ids, sets, strict=True):
                if len(s) and i is not None:
                    key = (level[(s >> U64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << U64(58)) | (s >> U64(6))
                    p = len(s) - -(-percent * len(s) // 100) + 1
                    key = np.sort(np.partition(key, p - 1)[:p]) if p < len(key) else np.sort(key)
                    rows.append((i, len(s), hashlib.md5(s.tobytes(), usedforsecurity=False).digest(), key.view(np.int64)))
            if rows:
                lengths = np.concatenate([[0], np.cumsum([len(r[3]) for r in rows])]).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate([r[3] for r in rows])))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary()), keys], names=["doc_id", "n", "digest", "tokens"])

    return run


def _shared(bits):
    """(id, n, last, at, token): the leading tokens that may be in the bitmap, with their place and the last one of the set."""

    def run(batches):
        for batch in batches:
            lists = batch.column("tokens")
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            row, ends = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes)
            on = np.flatnonzero(in_bitmap(bits.value, flat.view(np.uint64)))
            row, at = row[on], on - (ends - sizes)[row[on]]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("n").take(take), pa.array(flat[ends - 1][row]), pa.array(at.astype(np.int32)), pa.array(flat[on])], names=["id", "n", "last", "at", "token"])

    return run


def _sets_of(width: int, bits):
    """(id, elements): whole sets, six bytes an element, of the documents whose id may be in the bitmap."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(in_bitmap(bits.value, mix(ids.astype(np.int64).view(np.uint64)))))
            for got, sets in _rows(iter([batch]), width):
                packed = [(s >> U64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64()), pa.array(packed, pa.binary())], names=["id", "elements"])

    return run


def _unpacked(raw: bytes) -> np.ndarray:
    a = np.zeros((len(raw) // 6, 8), np.uint8)
    a[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return a.view("<u8").ravel()


def _compared(percent: int):
    """Rows come sorted by (a, salt, role): the set of a, then those to compare it with; links are kept."""

    def run(batches):
        now, own = None, []
        for batch in batches:
            hit_a, hit_b = [], []
            for a, salt, role, b, raw in zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "role", "b", "elements")), strict=True):
                if (a, salt) != now:
                    now, own = (a, salt), []
                s = _unpacked(raw)
                if role == 0:
                    own.append(s)
                    continue
                for o in own:
                    both = int(np.count_nonzero(_member(o, s)))
                    if 100 * both >= percent * (len(o) + len(s) - both):
                        hit_a.append(a)
                        hit_b.append(b)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(hit_a, pa.int64()), pa.array(hit_b, pa.int64())], names=["a", "b"])

    return run


def _member(sorted_set: np.ndarray, other: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_set, other)
    at[at == len(sorted_set)] = 0
    return sorted_set[at] == other if len(sorted_set) else np.zeros(len(other), bool)


def _scramble():
    """The key of `mix`, for native columns: candidates' ids go to the bitmap by a Python batch of ids alone."""

    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                ids = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(mix(ids).view(np.int64))], names=["key"])

    return run


def _links(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of document ids whose sets reach the threshold."""
    spark = docs.sparkSession
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    bits = spark.sparkContext.broadcast(bitmap(ids.mapInArrow(_scramble(), "key long"), "key", 24))
    sets = docs.select("doc_id", "text").mapInArrow(_sets_of(width, bits), "id long, elements binary")
    sets = staged(sets, "sets")
    bits.destroy()
    spreads = pairs.groupBy("a").agg(F.ceil(F.count("*") / SPREAD).cast("int").alias("spread"))
    heads = spreads.join(sets.hint("merge"), F.col("a") == F.col("id")).select("a", F.explode(F.sequence(F.lit(0), F.col("spread") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("a").alias("b"), "elements")
    others = pairs.join(spreads.hint("merge"), "a").join(sets.hint("merge"), F.col("b") == F.col("id")).select("a", F.pmod(F.xxhash64("b"), F.col("spread")).cast("int").alias("salt"), F.lit(1).alias("role"), "b", "elements")
    met = heads.unionByName(others).repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
    out = staged(met.mapInArrow(_compared(percent), "a long, b long"), "links")
    discard(sets)
    return out


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text); linked at 100 * intersection >= percent * union."""
    spark = docs.sparkSession
    slim = docs.select("doc_id", "text")
    summaries = staged(slim.mapInArrow(_summaries(width), "doc_id long, n long, digest binary, block int, counts binary"), "summaries")
    levels = spark.sparkContext.broadcast(_levels(summaries))
    rows = summaries.where("block is null").select("doc_id", "n", "digest")

    leading = slim.mapInArrow(_leading(width, percent, levels), "doc_id long, n long, digest binary, tokens array<bigint>")
    classes = staged(leading.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("tokens").alias("tokens")).drop("digest"), "leading")
    levels.destroy()
    # Tokens that several classes lead with, and the smallest of these; others can be of no use.
    seen = classes.select("id", "n", F.explode("tokens").alias("token")).groupBy("token")
    heads = staged(seen.agg(F.min("id").alias("head"), F.min_by("n", "id").alias("head_n"), F.count("*").alias("classes")).where("classes > 1").drop("classes"), "heads")
    bits = spark.sparkContext.broadcast(bitmap(heads, "token", 26))
    met = classes.mapInArrow(_shared(bits), "id long, n long, last long, at int, token long").join(heads.hint("merge"), "token")
    met = met.withColumn("behind", F.col("n") - F.col("at") - 1).drop("at")
    # Elements ahead of a token that another class leads with too, and all elements behind it.
    met = staged(met.withColumn("ahead", F.row_number().over(Window.partitionBy("id").orderBy("token")) - 1), "tokens")
    discard(classes, heads)
    bits.destroy()
    fits = lambda x, y: (100 * F.least(x, y) >= percent * F.greatest(x, y))
    least_overlap = lambda x, y: F.ceil((percent * (x + y)) / F.lit(100.0 + percent) - 1e-9)
    rest = lambda x: F.ceil(percent * x / F.lit(100.0) - 1e-9) - 1  # noqa: E731  elements behind the leading ones
    # Two sets that both lead with a token share at most what is ahead of it in both, itself, and what is behind it in both.
    within = lambda a, b, x, y: F.least("ahead", a) + 1 + F.least("behind", b) >= least_overlap(x, y)
    # Holds if c shared tokens are enough for any size from least to most. least_overlap(x, y) - rest(y) is not monotone in y, but
    # above the same difference without rounding, which falls as y grows.
    may_reach = lambda c, x, least, most: (
        (c >= least_overlap(x, F.greatest(least, rest(x) + 1)) - rest(x))
        | (100 * (100 + percent) * c > percent * (100 * x - percent * F.least(most, F.floor(100 * x / F.lit(1.0 * percent) + 1e-9))))
    )
    # Tokens whose first class is another one are not in this count, so it may miss pairs; the turns below find these.
    enough = lambda c, x, y: c >= least_overlap(x, y) - F.greatest(rest(x), rest(y))
    stars = met.where((F.col("head") < F.col("id")) & fits(F.col("n"), F.col("head_n"))).groupBy("id", "head").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("head_n").alias("head_n"))
    stars = stars.where(enough(F.col("c"), F.col("n"), F.col("head_n")))
    stars = stars.groupBy("id").agg(F.max_by("head", F.struct("c", -F.col("head"))).alias("a"))
    done = staged(stars.select("a", F.col("id").alias("b")), "pairs")
    links = _links(slim, done, width, percent)

    group = components(links, "a", "b")
    for turn in range(2):  # the second turn compares all that is left
        # The groups so far, and the matrix of tokens by groups.
        members = met.join(group.hint("merge"), F.col("id") == F.col("node"), "left").select("token", "id", "n", "last", "ahead", "behind", F.coalesce("component", "id").alias("grp"))
        shared = members.groupBy("token").agg(F.min("grp").alias("x"), F.max("grp").alias("y")).where("x < y").select("token")
        members = staged(members.join(shared.hint("merge"), "token", "left_semi"), "members")
        matrix = members.groupBy("token", "grp").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("ahead").alias("g_ahead"), F.max("behind").alias("g_behind"))
        n = F.col("n")
        opened = (
            members.select("token", "id", "n", "ahead", "behind", F.col("grp").alias("own"))
            .join(matrix.hint("merge"), "token")
            .where((F.col("grp") < F.col("own")) & (100 * F.col("most") >= percent * n) & (100 * n >= percent * F.col("least")))
            .where(within("g_ahead", "g_behind", n, F.greatest("least", F.ceil(percent * n / F.lit(100.0) - 1e-9))))
            .groupBy("id", "n", "grp")
            .agg(F.count("*").alias("c"), F.min("least").alias("least"), F.max("most").alias("most"))
            .where(may_reach(F.col("c"), n, F.col("least"), F.col("most")))
            .select("id", "grp")
        )
        opened = staged(opened, "opened")
        asked = members.select("token", "id", "n", "last", "ahead", "behind").join(opened.hint("merge"), "id")
        inside = members.select("token", "grp", F.col("id").alias("other"), F.col("n").alias("other_n"), F.col("last").alias("other_last"), F.col("ahead").alias("other_ahead"), F.col("behind").alias("other_behind"))
        o = F.col("other_n")
        pairs = (
            asked.join(inside.hint("merge"), ["token", "grp"])
            .where(fits(n, o) & within("other_ahead", "other_behind", n, o))
            .groupBy("id", "n", "last", "grp", "other", "other_n", "other_last")
            .agg(F.count("*").alias("c"))
            .where(F.col("c") >= least_overlap(n, o) - F.when(F.col("last") == F.col("other_last"), F.least(rest(n), rest(o))).when(F.col("last") < F.col("other_last"), rest(n)).otherwise(rest(o)))
            .select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "id", "grp", "c")
            .join(done.hint("merge"), ["a", "b"], "left_anti")
        )
        if turn < 1:  # most groups join by one link
            pairs = pairs.groupBy("id", "grp").agg(F.max_by(F.struct("a", "b"), F.struct("c", "a", "b")).alias("best")).select("best.*")
        pairs = staged(pairs.select("a", "b").distinct(), "pairs")
        discard(members, opened)
        if not pairs.limit(1).count():
            break
        links = links.unionByName(_links(slim, pairs, width, percent))
        done = done.unionByName(pairs)
        group = components(links, "a", "b")

    reps = rows.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    labelled = reps.join(group.hint("merge"), F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("label"))
    return (
        rows.join(labelled.hint("merge"), "digest", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id")).alias("component_id"))
    )


def near_duplicates_removed(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs without the documents that link to a component with a smaller doc_id; docs' own columns."""
    found = jaccard_components(docs, width, percent)
    drop = found.where("component_id <> doc_id").select(F.col("doc_id").alias("_drop")).distinct()
    return docs.join(drop, F.col("doc_id") == F.col("_drop"), "left_anti")


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"


def oracle(width: int = 4, percent: int = 85) -> str:
    """DuckDB SQL for `jaccard_components` over documents with unique ids: all pairs that share a shingle."""
    gram = " || ' ' || ".join(f"w[i + {k}]" if k else "w[i]" for k in range(width))
    return f"""
with recursive t as (select doc_id, {_WORDS} as w from documents),
s as (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < {width} then [array_to_string(w, ' ')]
        else list_distinct([{gram} for i in range(1, len(w) - {width} + 2)]) end) as g from t),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * k >= {percent} * (x.n + y.n - k)),
e as (select a, b from l union all select b, a from l),
r(a, b) as (select doc_id, doc_id from t union select r.a, e.b from r join e on e.a = r.b),
c as (select a as doc_id, min(b) as component_id from r group by 1)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id from c left join n using (doc_id)"""
