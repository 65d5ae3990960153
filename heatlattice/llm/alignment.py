"""Alignment of two tokenizers by union-find over overlapping tokens.

Tokens of one text, by both tokenizers, are byte ranges; two tokens of different tokenizers that share a byte are joined
by an edge. The components of this bipartite graph are exactly the smallest groups: between two offsets where both
tokenizers end a token, every inner offset is bridged by a token of one of them that touches both neighbours of the
other. All documents of a portion make one graph, whose union-find hooks roots to smaller ones and halves paths, for all
edges at once. A group's members give its links: the two that end it, as a link is two tokens whose ranges end together,
or, on request, every two that overlap.

Counting is done by Spark. A block of documents sends each id pair once, with its count, and keeps its links as places
in that list; the counts over all documents, and for each second id the highest one, come back to the blocks that asked,
as a list in the same order, and meet the blocks' documents there. So a pair that every document holds is one row a
block, and no table of pairs is ever held as a whole.

Defined cases: null or empty texts, and texts that either tokenizer does not spell out to the byte, have no tokens (all
zeros, an empty digest); rows that share a doc_id are aligned one by one; a null doc_id stays null; texts of any length
are one block at most; of pairs with equal counts all are the best of their second id; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_tokens import Spellings, byte_tokenizer
from .common import discard, portions, staged, utf8

#: Bytes of text aligned at a time, and bytes that share a list of pairs.
PORTION, BLOCK = 1 << 20, 1 << 23
MARK = "▁"
DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long"
DOC_COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]


def union_find(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component, for n nodes and edges (u, v)."""
    parent = np.arange(n)
    while True:
        a, b = parent[u], parent[v]
        apart = a != b
        if not apart.any():
            return parent
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of tokens that share a byte, in order; both rows of tokens cover the same bytes without gaps."""
    cuts = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
    cuts = cuts[np.concatenate([cuts[1:] != cuts[:-1], [True]])] if len(cuts) else cuts
    return np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Group number of each token of either side, and the pairs of overlapping tokens."""
    u, v = overlaps(ends_a, ends_b)
    root = union_find(len(ends_a) + len(ends_b), u, v + len(ends_a))
    # Every group has a first token of the first side, which is its root.
    first = np.cumsum(root[: len(ends_a)] == np.arange(len(ends_a))) - 1
    number = first[root] if len(root) else root
    return number[: len(ends_a)], number[len(ends_a) :], u, v


class _Digits:
    """Numbers as decimal bytes with a separator behind each, laid out for numpy."""

    def __init__(self, top: int) -> None:
        numbers = [str(i).encode() for i in range(top)]
        self.spellings = Spellings([s + b"," for s in numbers])

    def joined(self, ids: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of ids in turn, each with its separator (a byte), and where each ends."""
        out = self.spellings.joined(ids)
        ends = np.cumsum(self.spellings.length[ids])
        if len(ids):
            out[ends - 1] = after
        return out, ends


class Aligner:
    """Aligns texts by a byte-level `tokenizers` file (A) and a `sentencepiece` model (B) that puts a space first."""

    def __init__(self, a_path: str, b_path: str, links: str = "ends") -> None:
        import sentencepiece

        if links not in ("ends", "overlaps"):
            raise ValueError("links is 'ends' or 'overlaps'")
        self.overlapping = links == "overlaps"
        self.a = byte_tokenizer(a_path, False)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        spelled = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.bytes_a, self.bytes_b = Spellings(self.a.spelled), Spellings(spelled)
        self.digits = _Digits(max(len(pieces), len(self.a.spelled)))

    def align(self, texts: list[str], data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
        """Columns of one row a text, and `pairs`: id_a << 32 | id_b of all links in order; data and at are the texts' bytes."""
        rows = len(texts)
        ids_a = [self.a.ids(" " + t) if t else [] for t in texts]
        ids_b = self.b.encode([t or "" for t in texts], num_threads=1)
        n_a, n_b = np.array([len(x) for x in ids_a], np.int64), np.array([len(x) for x in ids_b], np.int64)
        flat_a = np.array([i for x in ids_a for i in x], np.int64)
        flat_b = np.array([i for x in ids_b for i in x], np.int64)
        row_a, row_b = np.repeat(np.arange(rows), n_a), np.repeat(np.arange(rows), n_b)
        # What the tokens must spell: each text that is not empty, behind a space.
        there = np.diff(at) > 0
        goal = np.insert(data, at[:-1][there], 0x20)
        size = np.diff(at) + there
        good = there.copy()
        for side, ids, row in ((self.bytes_a, flat_a, row_a), (self.bytes_b, flat_b, row_b)):
            length = np.bincount(row, side.length[ids], rows).astype(np.int64)
            good &= length == size
        for side, ids, row in ((self.bytes_a, flat_a, row_a), (self.bytes_b, flat_b, row_b)):
            raw, want = side.joined(ids[good[row]]), goal if good[there].all() else goal[np.repeat(good, size)]
            if not np.array_equal(raw, want):
                wrong = np.flatnonzero(raw != want)
                ends = np.cumsum(np.where(good, size, 0))
                good[np.searchsorted(ends, wrong, "right")] = False
        if not good.all():
            keep_a, keep_b = good[row_a], good[row_b]
            flat_a, row_a, flat_b, row_b = flat_a[keep_a], row_a[keep_a], flat_b[keep_b], row_b[keep_b]
            n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
        ends_a, ends_b = np.cumsum(self.bytes_a.length[flat_a]), np.cumsum(self.bytes_b.length[flat_b])
        group_a, group_b, u, v = groups(ends_a, ends_b)

        last_a = np.append(group_a[1:] != group_a[:-1], True) if len(group_a) else group_a.astype(bool)
        last_b = np.append(group_b[1:] != group_b[:-1], True) if len(group_b) else group_b.astype(bool)
        n_groups = np.bincount(row_a[last_a], minlength=rows)
        if not self.overlapping:
            u, v = np.flatnonzero(last_a), np.flatnonzero(last_b)
        n_links = np.bincount(row_a[u], minlength=rows)
        return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups_sha256": self._digests(flat_a, flat_b, group_a, group_b, last_a, last_b, row_a, row_b, rows), "pairs": flat_a[u] << 32 | flat_b[v]}

    def _digests(self, flat_a, flat_b, group_a, group_b, last_a, last_b, row_a, row_b, rows: int) -> list[str]:
        """sha256 of `a1,a2|b1;a3|b2,b3` for each row; '' where it has no tokens."""
        n = int(group_a[-1]) + 1 if len(group_a) else 0
        in_a, in_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
        # A group's first ids follow all second ids of the groups before it, and so on.
        place_a = np.arange(len(flat_a)) + (np.cumsum(in_b) - in_b)[group_a]
        place_b = np.arange(len(flat_b)) + np.cumsum(in_a)[group_b]
        ids, after, row = np.empty(len(place_a) + len(place_b), np.int64), np.empty(len(place_a) + len(place_b), np.uint8), np.empty(len(place_a) + len(place_b), np.int64)
        ids[place_a], ids[place_b] = flat_a, flat_b
        after[place_a], after[place_b] = np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))
        row[place_a], row[place_b] = row_a, row_b
        text, ends = self.digits.joined(ids, after)
        text, upto = text.tobytes(), np.concatenate([[0], ends])[np.searchsorted(row, np.arange(rows + 1))].tolist()
        return [hashlib.sha256(text[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(upto, upto[1:])]


@cache
def _aligner(a_path: str, b_path: str, links: str) -> Aligner:
    return Aligner(a_path, b_path, links)


NAMES = ["block", "place", "pair", "n", *DOC_COLUMNS, "groups_sha256", "links"]
ROWS = f"block long, place int, pair long, n long, {DOC}, groups_sha256 string, links binary"


def _block(number: int, held: list[dict]):
    """The rows of a block: its distinct pairs with their counts, and its documents with their links as places in that list."""
    pairs, place, n = np.unique(np.concatenate([h["pairs"] for h in held]), return_inverse=True, return_counts=True)
    k = len(pairs)
    if k:
        none = [pa.nulls(k, pa.int64())] * len(DOC_COLUMNS) + [pa.nulls(k, pa.string()), pa.nulls(k, pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(k, number)), pa.array(np.arange(k, dtype=np.int32)), pa.array(pairs), pa.array(n), *none], names=NAMES)
    place, done = place.astype("<u4"), 0
    for h in held:
        m = len(h["doc_id"])
        upto = done + np.concatenate([[0], np.cumsum(h["n_links"])])
        links = [place[i:j].tobytes() for i, j in zip(upto[:-1], upto[1:], strict=True)]
        done = int(upto[-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(m, number)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(h["doc_id"], pa.int64()), *(pa.array(h[c]) for c in DOC_COLUMNS[1:]), pa.array(h["groups_sha256"], pa.string()), pa.array(links, pa.binary())],
            names=NAMES,
        )


def _aligned(a_path: str, b_path: str, links: str):
    def run(batches):
        aligner = _aligner(a_path, b_path, links)
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            ids, column = batch.column("doc_id").to_pylist(), batch.column("text")
            data, at = utf8(column)
            for i, j in portions(at, PORTION):
                held.append({"doc_id": ids[i:j]} | aligner.align(column[i:j].to_pylist(), data[at[i] : at[j]], at[i : j + 1] - at[i]))
                size += int(at[j] - at[i])
                if size >= BLOCK:
                    yield from _block(number, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield from _block(number, held)

    return run


def _counted(batches):
    """Rows come sorted by (block, place), a block's documents (place null) behind its pairs' counts."""
    now, count, top = None, [], []
    for batch in batches:
        block = batch.column("block").to_numpy()
        cut = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else []
        for i, j in zip(cut, [*cut[1:], len(block)]):
            part = batch.slice(i, j - i)
            if block[i] != now:
                now, count, top = block[i], [], []
            pairs = int(j - i) - part.column("place").null_count
            if pairs:
                count.append(part.column("count").slice(0, pairs).to_numpy())
                top.append(part.column("top").slice(0, pairs).to_numpy(zero_copy_only=False).astype(np.int64))
            if pairs == j - i:
                continue
            if len(count) > 1:
                count, top = [np.concatenate(count)], [np.concatenate(top)]
            docs = part.slice(pairs)
            raw, at = utf8(docs.column("links"))
            place = raw.view("<u4") if len(raw) else np.zeros(0, np.int64)
            sums = [np.concatenate([[0], np.cumsum(x[0][place])]) if x and len(place) else np.zeros(len(place) + 1, np.int64) for x in (top, count)]
            best, total = (s[at[1:] // 4] - s[at[:-1] // 4] for s in sums)
            yield pa.RecordBatch.from_arrays([*(docs.column(c) for c in DOC_COLUMNS), pa.array(best), pa.array(total), docs.column("groups_sha256")], names=[*DOC_COLUMNS, "n_best", "count_sum", "groups_sha256"])


def align(docs: DataFrame, a_path: str, b_path: str, links: str = "ends") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of docs (doc_id, text)."""
    rows = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_aligned(a_path, b_path, links), ROWS), "aligned")
    counts = pair_counts(rows)
    asked = rows.where("place is not null").select("block", "place", "pair").join(counts, "pair")
    empty = [F.lit(None).cast(t).alias(c) for c, t in (*((c, "long") for c in DOC_COLUMNS), ("groups_sha256", "string"), ("links", "binary"))]
    told = asked.select("block", "place", "count", "top", *empty)
    own = rows.where("place is null").select("block", "place", F.lit(None).cast("long").alias("count"), F.lit(None).cast("boolean").alias("top"), *DOC_COLUMNS, "groups_sha256", "links")
    met = told.unionByName(own).repartition("block").sortWithinPartitions("block", F.col("place").asc_nulls_last())
    return met.mapInArrow(_counted, f"{DOC}, n_best long, count_sum long, groups_sha256 string")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, count, top): how many links hold each id pair, and whether no pair of the same second id has more."""
    counts = staged(rows.where("place is not null").groupBy("pair").agg(F.sum("n").alias("count")), "counts")
    second = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    best = counts.groupBy(second.alias("second")).agg(F.max("count").alias("most"))
    return counts.withColumn("second", second).join(best, "second").select("pair", "count", (F.col("count") == F.col("most")).alias("top"))
