"""Removal of repeated long strings by run-length compressed indexes.

Every window of `length` bytes has one anchor: the K bytes in it whose hash is smallest, leftmost on ties. Equal windows
have equal anchors, so windows are compared only with windows of their anchor. The windows of one anchor occurrence are
neighbours and make one context, a string of at most 2 * length - K bytes; no two windows of one context are equal. A
filter of fixed size, made from the anchors that occur more than once, drops most other contexts before any text moves;
what it lets through by chance costs work, never correctness.

Contexts that are equal are one: all but the earliest are covered whole. Where an anchor has different contexts, the
earlier ones are indexed: `RunIndex` keeps the runs of their Burrows-Wheeler transform with the text positions sampled at
both ends of each run. The later ones stream backwards through it, one byte a step for all of them at once. While the
run of the current row has the wanted byte, the match grows by one LF step; else it jumps to the nearest ends of the runs
of that byte above and below, whose samples tell how much of the match each keeps, and goes on at the better one. That
gives each position's matching statistic, its length and a position; lengths of `length` or more are marked. An
index must hold earlier contexts alone: for an anchor's contexts in order, numbered in binary, each bit splits those
that agree in all higher bits into indexed ones (0) and streamed ones (1), so every two contexts meet once, the earlier
one in the index. A mark of four symbols, no byte and the split's number, stands for the anchor's first byte, so no match leaves a split. The
windows of anchors with very many contexts are compared by their digests, so no index holds an unbounded group.

Defined cases: a null text is empty; texts under `length` bytes stay whole; matches never cross rows; rows that share a
doc_id come in the order of a hash of their texts, and if the texts are equal, too, neither removes the other; a null
doc_id comes before all others; overlapping copies inside a text count; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, bitmap, discard, in_bitmap, mix, portions, staged, utf8

LENGTH, K = 100, 32
#: Bytes of a portion, symbols of an index, contexts of an anchor that are indexed, symbols of a block of its text.
PORTION, INDEX, HOT, WORD = 1 << 18, 2 << 20, 4096, 16
_LOW = U64(0xFFFFFF)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """For each context: the anchor's hash, the row, its first and last window start, and the anchor's."""
    none = np.zeros(0, np.int64)
    n = len(data)
    long = np.diff(offsets) >= length
    if not long.any():
        return none.view(np.uint64), none, none, none, none
    assert n < 1 << 24 or len(offsets) == 2
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    m = mix(np.ndarray((n,), np.uint64, padded.data, strides=(1,)))
    size = n - K + 1
    h = m[:size] * U64(0x9E3779B97F4A7C15)
    for c, o in ((0xC2B2AE3D27D4EB4F, 8), (0x165667B19E3779F9, 16), (0xFF51AFD7ED558CCD, 24)):
        h ^= h >> U64(29)
        h += m[o : o + size] * U64(c)
    h = mix(h)
    block = (1 << 24) - 4 * length
    found = []
    for s in range(0, size, block):  # one block, but for a text of 16 MB
        part = h[s : s + block + length - K]
        q = (part & ~_LOW) | np.arange(len(part), dtype=np.uint64)
        span, step = length - K + 1, 1
        while step * 2 <= span:
            q = np.minimum(q[:-step], q[step:])
            step *= 2
        if span > step:
            q = np.minimum(q[: step - span], q[span - step :])
        found.append((q[:block] & _LOW).astype(np.int64) + s)
    best = np.concatenate(found)[: n - length + 1]
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, offsets[:-1][long], 1)
    np.add.at(mark, offsets[1:][long] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(mark)[: len(best)] > 0)
    a = best[at]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1)]))
    first, last = at[new], at[np.concatenate([new[1:] - 1, [len(at) - 1]])]
    return h[a[new]], np.searchsorted(offsets, first, "right") - 1, first, last, a[new]


class _Blocks:
    """Random access to strings by a dictionary of their distinct blocks of WORD symbols. Blocks are aligned to each
    string's anchor, so copies share them."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, anchors: np.ndarray) -> None:
        before = -anchors % WORD  # blank symbols ahead of each string
        room = (before + sizes + 1 + WORD - 1) // WORD * WORD
        base = np.cumsum(room) - room
        wide = np.zeros(int(room.sum()), np.uint16)
        wide[np.repeat(base + before - starts, sizes + 1) + np.arange(len(text))] = text
        self.shift, self.starts = base + before - starts, starts
        lanes = wide.view(np.uint64).reshape(-1, WORD // 4)
        with np.errstate(over="ignore"):
            h = mix(lanes[:, 0].copy())
            for k in range(1, lanes.shape[1]):
                h = mix(h * U64(0x9FB21C651E98DF25) + lanes[:, k])
        _, first, self.ids = np.unique(h, return_index=True, return_inverse=True)
        self.words = wide.reshape(-1, WORD)[first]
        if not (self.words[self.ids] == wide.reshape(-1, WORD)).all():  # a collision of hashes: no sharing
            self.words, self.ids = wide.reshape(-1, WORD), np.arange(len(lanes))
        self.ids = self.ids.astype(np.int32)

    def string_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1

    def rows(self, at: np.ndarray, width: int) -> np.ndarray:
        """The `width` symbols from each position on; what lies behind a string's end is of no meaning."""
        x = (at + self.shift[self.string_of(at)])[:, None] + np.arange(width)
        x = np.minimum(x, len(self.ids) * WORD - 1)
        return self.words[self.ids[x // WORD], x % WORD]


class RunIndex:
    """Runs of the Burrows-Wheeler transform of strings of symbols from 1 to 511, each followed by a terminator (0, ordered
    by place), with the text positions of both ends of each run."""

    def __init__(self, strings: list[np.ndarray], anchors: np.ndarray | None = None) -> None:
        sizes = np.array([len(x) for x in strings], np.int64)
        ends = np.cumsum(sizes + 1) - 1
        text = np.zeros(int(ends[-1]) + 1, np.uint16)
        text[np.arange(len(text)) != np.repeat(ends, sizes + 1)] = np.concatenate(strings)
        suffixes = self._sorted(text)
        letter = text[suffixes - 1]  # of position 0 it is the last terminator
        starts = np.flatnonzero(np.concatenate([[True], letter[1:] != letter[:-1]]))
        lengths = np.diff(np.concatenate([starts, [len(text)]]))
        self.starts, self.heads, self.rows_of = starts, letter[starts].astype(np.int64), lengths
        self.first_position, self.last_position = suffixes[starts], suffixes[starts + lengths - 1]
        order = np.argsort(self.heads, kind="stable")
        self.keys = self.heads[order] * len(starts) + order  # runs by symbol, then by place
        self.to = np.empty(len(starts), np.int64)  # LF of each run's first row
        self.to[order] = np.cumsum(lengths[order]) - lengths[order]
        self.origin = int(suffixes[0])
        self.text = _Blocks(text, ends - sizes, sizes, np.zeros(len(strings), np.int64) if anchors is None else anchors)

    @staticmethod
    def _sorted(text: np.ndarray) -> np.ndarray:
        """All suffixes in order, by prefix doubling; what follows a terminator does not count, its place does."""
        n = len(text)
        key, ended = np.zeros(n, np.uint64), np.zeros(n, bool)
        for o in range(7):  # symbols of nine bits
            c, stop = np.zeros(n, np.uint64), np.ones(n, bool)
            c[: n - o], stop[: n - o] = text[o:], text[o:] == 0
            c[ended] = 0
            key = (key << U64(9)) | c
            ended |= stop
        order = np.argsort(key)
        k, e = key[order], ended[order]
        tied = order[e]  # equal keys that end come in the order of their places
        order[e] = tied[np.lexsort((tied, k[e]))]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | e[1:]])
        rank = np.empty(n, np.int64)
        rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
        single = np.zeros(n, bool)
        single[order] = new & np.concatenate([new[1:], [True]])
        h = 7
        while len(todo := np.flatnonzero(~single)):
            pair = (rank[todo].astype(np.uint64) << U64(32)) | rank[np.minimum(todo + h, n - 1)].astype(np.uint64)
            order = np.argsort(pair)
            at, p = todo[order], pair[order]
            new = np.concatenate([[True], p[1:] != p[:-1]])
            group = np.concatenate([[True], (p[1:] >> U64(32)) != (p[:-1] >> U64(32))])
            place = np.arange(len(at))
            rank[at] += place[new][np.cumsum(new) - 1] - place[group][np.cumsum(group) - 1]
            single[at] = new & np.concatenate([new[1:], [True]])
            h *= 2
        out = np.empty(n, np.int64)
        out[rank] = np.arange(n)
        return out

    def statistics(self, queries: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries by falling size (their numbers), and for each of their positions, left-aligned, the length of the longest
        match that starts there and a text position of it."""
        sizes = np.array([len(x) for x in queries], np.int64)
        by = np.argsort(-sizes, kind="stable")
        sizes = sizes[by]
        width = int(sizes[0]) if len(sizes) else 0
        grid = np.zeros((len(by), width + 1), np.uint16)
        which = np.repeat(np.arange(len(by)), sizes)
        if len(which):
            grid[which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.concatenate([queries[i] for i in by.tolist()])
        length, position = np.zeros((len(by), width), np.int32), np.zeros((len(by), width), np.int64)
        row, at, n = np.zeros(len(by), np.int64), np.full(len(by), self.origin), np.zeros(len(by), np.int64)
        for step in range(1, width + 1):
            live = int(np.searchsorted(-sizes, -step, "right"))
            i = sizes[:live] - step
            c = grid[np.arange(live), i].astype(np.int64)
            q = row[:live]
            run = np.searchsorted(self.starts, q, "right") - 1
            q, a, m = self.to[run] + (q - self.starts[run]), at[:live] - 1, n[:live] + 1
            off = np.flatnonzero(self.heads[run] != c)
            if len(off):
                q[off], a[off], m[off] = self._jump(c[off], run[off], row[off], at[off], n[off], grid[off], i[off])
            row[:live], at[:live], n[:live] = q, a, m
            length[np.arange(live), i], position[np.arange(live), i] = m, a
        return by, length, position

    def _jump(self, c, run, row, at, n, grid, i):
        """Rows, positions and lengths after going on at the end of a run of c, above or below, that keeps the most."""
        spot = np.searchsorted(self.keys, c * len(self.starts) + run)
        best, kept_row, kept_at = np.full(len(c), -1), row.copy(), at.copy()
        behind = np.minimum(i[:, None] + 1 + np.arange(int(n.max()) if len(n) else 0), grid.shape[1] - 1)
        query = np.take_along_axis(grid, behind, 1)
        for side in (spot - 1, spot):
            ok = np.flatnonzero((side >= 0) & (side < len(self.keys)))
            ok = ok[self.keys[side[ok]] // len(self.starts) == c[ok]]
            to = self.keys[side[ok]] % len(self.starts)
            above = side[ok] < spot[ok]
            place = np.where(above, self.last_position[to], self.first_position[to])
            alike = self.text.rows(place, query.shape[1]) == query[ok]
            same = np.minimum(np.where(alike.all(1), query.shape[1], alike.argmin(1) if alike.shape[1] else 0), n[ok])
            win = same > best[ok]
            o, to, above = ok[win], to[win], above[win]
            best[o], kept_at[o] = same[win], place[win] - 1
            kept_row[o] = self.to[to] + np.where(above, self.rows_of[to] - 1, 0)
        return kept_row, kept_at, best + 1


def _splits(sizes: list[int]):
    """For groups of so many contexts: (number of the split, context, whether it is indexed), contexts counted through."""
    first, number = 0, 0
    for g in sizes:
        step = 1
        while step < g:
            for low in range(0, g - step, 2 * step):
                for k in range(low, min(low + 2 * step, g)):
                    yield number, first + k, k < low + step
                number += 1
            step *= 2
        first += g


def _related(groups: list[list[tuple[int, bytes]]], length: int) -> tuple[list[int], list[int]]:
    """The numbers of contexts that may share a window, family by family in order, and the sizes of the families. A window
    has half of its bytes beyond the anchor on one side of it at least, so contexts that share one agree there."""
    half, first, order, sizes = -(-(length - K) // 2), 0, [], []
    for group in groups:
        up = list(range(len(group)))
        met: dict[bytes, int] = {}
        for i, (a, raw) in enumerate(group):
            for side, part in ((b"<", raw[a - half : a] if a >= half else b""), (b">", raw[a + K : a + K + half])):
                if len(part) == half:
                    x, y = met.setdefault(side + part, i), i
                    while up[x] != x:
                        up[x] = x = up[up[x]]
                    while up[y] != y:
                        up[y] = y = up[up[y]]
                    up[max(x, y)] = min(x, y)
        families: dict[int, list[int]] = {}
        for i in range(len(group)):
            x = i
            while up[x] != x:
                x = up[x]
            up[i] = x
            families.setdefault(x, []).append(first + i)
        for family in families.values():
            if len(family) > 1:
                order += family
                sizes.append(len(family))
        first += len(group)
    return order, sizes


def marked_windows(groups: list[list[tuple[int, bytes]]], length: int = LENGTH) -> list[np.ndarray]:
    """For each context (offset of its anchor, bytes) of groups in order, which of its windows an earlier one of its group
    has. Indexes hold about INDEX symbols, or one split."""
    contexts = [x for g in groups for x in g]
    plain = [np.frombuffer(raw, np.uint8).astype(np.uint16) + 1 for _, raw in contexts]
    out = [np.zeros(max(0, len(raw) - length + 1), bool) for _, raw in contexts]
    indexed: list[np.ndarray] = []
    anchors, asked, owner, size, first, mark = [], [], [], 0, 0, np.zeros(4, np.uint16)

    def flush():
        if asked:
            by, n, _ = RunIndex(indexed, np.array(anchors, np.int64)).statistics(asked)
            for r, k in enumerate(by.tolist()):
                own = out[owner[k]]
                own |= n[r, : len(own)] >= length + 3  # windows start no later than their anchor

    last = -1
    order, sizes = _related(groups, length)
    for number, k, stored in _splits(sizes):
        k = order[k]
        if number != last:
            if size >= INDEX:
                flush()
                indexed, anchors, asked, owner, size, first = [], [], [], [], 0, number
            last, own = number, number - first
            mark = np.array([257, own // 65_536 + 1, own // 256 % 256 + 1, own % 256 + 1], np.uint16)
        anchor, x = contexts[k][0], plain[k]
        x = np.concatenate([x[:anchor], mark, x[anchor + 1 :]])
        if stored:
            indexed.append(x)
            anchors.append(anchor)
        else:
            asked.append(x)
            owner.append(k)
        size += len(x) + 1
    flush()
    return out


def _seen(batches):
    """(key, n): anchors of each portion and how often."""
    with np.errstate(over="ignore"):
        for batch in batches:
            data, at = utf8(batch.column("text"))
            for i, j in portions(at, PORTION):
                h = anchors(data[at[i] : at[j]], at[i : j + 1] - at[i])[0]
                key, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])


_CONTEXT = "key long, c1 long, c2 long, doc long, sig long, at int, windows int, again boolean, context binary"


def _contexts(bits):
    """One row for each context whose anchor may occur more than once. `again` are those that the same text has before.
    The context, behind its anchor's offset as one byte, comes only where this task first meets it."""

    def run(batches):
        met: set[bytes] = set()
        names = [c.split()[0] for c in _CONTEXT.split(", ")]
        with np.errstate(over="ignore"):
            for batch in batches:
                data, at = utf8(batch.column("text"))
                docs, sigs = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "sig"))
                for i, j in portions(at, PORTION):
                    part = data[at[i] : at[j]]
                    h, row, first, last, anchor = anchors(part, at[i : j + 1] - at[i])
                    on = np.flatnonzero(in_bitmap(bits.value, h))
                    if not len(on):
                        continue
                    h, row, first, last, anchor = h[on], row[on], first[on], last[on], (anchor - first)[on]
                    raw = part.tobytes()
                    strings = [raw[a : b + LENGTH] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                    digests = [hashlib.md5(s, usedforsecurity=False).digest() for s in strings]
                    if len(met) > 1_000_000:
                        met.clear()
                    sent = [None if d in met else (met.add(d), bytes([o]) + s)[1] for d, s, o in zip(digests, strings, anchor.tolist(), strict=True)]
                    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                    order = np.lexsort((first, both[:, 0], both[:, 1], row))
                    again = np.zeros(len(order), bool)
                    again[order[1:]] = (both[order][1:] == both[order][:-1]).all(1) & (row[order][1:] == row[order][:-1])
                    begin = (at[i:j] - at[i])[row]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h.view(np.int64)), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(docs[i:j][row]), pa.array(sigs[i:j][row]), pa.array((first - begin).astype(np.int32)), pa.array((last - first + 1).astype(np.int32)), pa.array(again), pa.array(sent, pa.binary())],
                        names=names,
                    )

    return run


def _single_windows(batches):
    """Contexts of anchors with very many, as the digests and places of their windows, one by one."""
    for batch in batches:
        docs, sigs, ats, strings = (batch.column(c).to_pylist() for c in ("doc", "sig", "at", "context"))
        for i in range(0, len(docs), 300):
            part = zip(docs[i : i + 300], sigs[i : i + 300], ats[i : i + 300], strings[i : i + 300], strict=True)
            rows = [(doc, sig, at + o, hashlib.md5(s[1 + o : 1 + o + LENGTH], usedforsecurity=False).digest()) for doc, sig, at, s in part for o in range(len(s) - LENGTH)]
            both = np.frombuffer(b"".join(r[3] for r in rows), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32())], names=["w1", "w2", "doc", "sig", "at"])


def _indexed(batches):
    """Contexts sorted by (key, doc, sig, at): whole groups, about INDEX bytes at a time; covered byte runs come out."""
    places: list[tuple] = []
    groups: list[list] = []
    size, now = 0, None

    def out():
        rows = []
        for (doc, sig, at), hit in zip(places, marked_windows(groups), strict=True):
            edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
            rows += [(doc, sig, at + a, b - a + LENGTH - 1) for a, b in edge.reshape(-1, 2).tolist()]
        cols = list(zip(*rows, strict=True)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc", "sig", "at", "bytes"])

    for batch in batches:
        for key, doc, sig, at, s in zip(*(batch.column(c).to_pylist() for c in ("key", "doc", "sig", "at", "context")), strict=True):
            if key != now:
                if size >= INDEX:
                    yield out()
                    places, groups, size = [], [], 0
                now = key
                groups.append([])
            places.append((doc, sig, at))
            groups[-1].append((s[0], s[1:]))
            size += len(s)
    if places:
        yield out()


def _low():
    return F.col("sig").bitwiseAND(F.lit((1 << 48) - 1).cast("long"))


def _ordered():
    """One number that orders texts by doc, then by the low bits of sig."""
    return (F.col("doc").cast("decimal(20,0)") * F.lit(1 << 48).cast("decimal(17,0)") + _low().cast("decimal(17,0)")).cast("decimal(38,0)")


def covered_runs(docs: DataFrame) -> DataFrame:
    """(doc, sig, at, bytes): runs of bytes, possibly overlapping, that lie in a repeated window; docs has doc, sig, text."""
    spark = docs.sparkSession
    twice = docs.select("text").mapInArrow(_seen, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")
    bits = spark.sparkContext.broadcast(bitmap(twice, "key", 26))
    found = staged(docs.mapInArrow(_contexts(bits), _CONTEXT), "contexts")
    bits.destroy()

    covered = (F.col("windows") + LENGTH - 1).alias("bytes")
    again = staged(found.where("again").select("doc", "sig", "at", covered), "again")
    own = found.where("not again").select("key", "c1", "c2", "doc", "sig", "at", "windows", _ordered().alias("place"))
    # Each distinct context and its first text; a text has it once among these rows.
    classes = staged(own.groupBy("key", "c1", "c2").agg(F.min("place").alias("first"), F.count("*").alias("n")), "classes")
    # A table of its own, so that joins with it meet nothing but exchanges, which adaptive execution can split.
    several = staged(classes.groupBy("key").agg(F.count("*").alias("contexts")).where("contexts > 1"), "several")
    wanted = classes.join(several, "key", "left").where("n > 1 or contexts > 1").select("c1", "c2", "first", "contexts")
    met = own.join(wanted, ["c1", "c2"]).withColumn("is_first", F.col("place") == F.col("first")).where("not is_first or contexts > 1")
    only_first = lambda c: F.when(F.col("is_first"), F.col(c)).alias(c)
    met = staged(met.select(*(only_first(c) for c in ("key", "contexts", "c1", "c2")), "doc", "sig", "at", "windows", "is_first"), "met")
    later = met.where("not is_first").select("doc", "sig", "at", covered)
    # Rows with one doc_id and one text are alike: one of them stands for all.
    firsts = met.where("is_first").dropDuplicates(["c1", "c2"]).select("key", "contexts", "c1", "c2", "doc", "sig", "at")
    strings = found.where("context is not null").select("key", "c1", "c2", "context").join(several.select("key"), "key", "left_semi").dropDuplicates(["c1", "c2"]).drop("key")
    mixed = staged(firsts.join(strings, ["c1", "c2"]).select("key", "contexts", "doc", "sig", "at", "context"), "mixed")
    discard(found, classes, several)
    usual = mixed.where(F.col("contexts") <= HOT).select("key", "doc", "sig", "at", "context")
    # Windows have one length, so equal ones need no index: all but the earliest are covered.
    single = mixed.where(F.col("contexts") > HOT).select("doc", "sig", "at", "context").mapInArrow(_single_windows, "w1 long, w2 long, doc long, sig long, at int")
    single = staged(single.withColumn("place", _ordered()), "single")
    earliest = single.groupBy("w1", "w2").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").select("w1", "w2", "first")
    hot = single.join(earliest, ["w1", "w2"])
    # A text may hold one window several times, in different contexts: the first place counts there.
    inside = hot.where("place = first").withColumn("before", F.row_number().over(Window.partitionBy("w1", "w2", "doc", "sig").orderBy("at"))).where("before > 1")
    hot = hot.where("place <> first").select("doc", "sig", "at").unionByName(inside.select("doc", "sig", "at")).withColumn("bytes", F.lit(LENGTH))
    shards = usual.repartition("key").sortWithinPartitions("key", "doc", _low(), "at")
    marked = shards.mapInArrow(_indexed, "doc long, sig long, at int, bytes int")
    out = staged(again.unionByName(later).unionByName(hot).unionByName(marked), "covered")
    discard(again, met, mixed, single)
    return out


def _result(doc, raw: bytes, runs) -> tuple:
    keep = np.ones(len(raw), bool)
    for at, n in runs:
        keep[at : at + n] = False
    gone = np.concatenate([[False], ~keep, [False]]).astype(np.int8)
    spans = int(np.count_nonzero(np.diff(gone) == 1))
    kept = np.frombuffer(raw, np.uint8)[keep].tobytes() if spans else raw
    return doc, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept


def _cut(with_text: bool, schema):
    names = schema.names

    def run(batches):
        for batch in batches:
            texts = batch.column("text").fill_null("")
            raws = texts.cast(pa.binary()).to_pylist()
            out = [_result(doc, raw, [(r["at"], r["bytes"]) for r in runs or ()]) for doc, raw, runs in zip(batch.column("doc_id").to_pylist(), raws, batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            if with_text:
                text = pa.array([o[5].decode("utf-8", "ignore") for o in out], pa.string())
                text = pc.if_else(pc.is_null(batch.column("text")), pa.scalar(None, pa.string()), text)
                yield pa.RecordBatch.from_arrays([text if c == "text" else batch.column(c) for c in names], names=names)
            else:
                cols = list(zip(*out, strict=True))[:5] or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=names)

    return run


def _keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """docs with the key of each row: its place by doc_id, and a hash of its text for rows that share a doc_id."""
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long"))
    return docs.select(place.alias("doc"), F.xxhash64("text").alias("sig"), *columns)


def _cut_out(docs: DataFrame, schema, with_text: bool) -> DataFrame:
    runs = covered_runs(_keyed(docs, "text"))
    per_row = runs.groupBy("doc", "sig").agg(F.collect_set(F.struct("at", "bytes")).alias("runs"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    name = "runs" + "_" * max(map(len, docs.columns))  # no column of docs has it
    return _keyed(docs, row).join(per_row, ["doc", "sig"], "left").select("row.*", F.col("runs").alias(name)).mapInArrow(_cut(with_text, schema), schema)


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs (doc_id, text)."""
    out = docs.sparkSession.createDataFrame([], "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").schema
    return _cut_out(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), out, False)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated long strings cut out of text; its other columns stay. Half a character at a cut goes too."""
    return _cut_out(docs, docs.schema, True)
