"""Best-fit packing by sums of squares.

Each task tokenizes its documents and cuts only those longer than a sequence, into whole sequences behind a shorter first
piece. The pieces are dealt at random to shards of about SHARD pieces, whatever the input's size, and each shard packs
its own: a piece goes where the sum, over the possible gaps, of the squared number of open sequences with that gap
becomes smallest. A shard is packed twice, longest pieces first with a new sequence only where no open one has room, and
in random order with a new sequence as one more candidate; the one with fewer sequences holds. Long pieces leave little
to choose, so the first wins there; where many short ones meet, the second keeps gaps of all sizes open and wins.

A shard knows the number of open sequences for each gap and, in stacks, their numbers; it never holds a document.

Defined cases: a null or empty text is the end token alone; rows that share a doc_id are packed one by one; a null
doc_id stays null; texts of any length are cut into as many pieces as they need; among equally good gaps the smallest is
taken; an empty table gives no piece; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_tokens import byte_tokenizer
from .common import staged

WINDOW, END_ID, SHARD = 2048, 0, 1 << 14
PIECE = "task int, row long, doc_id long, piece int, start long, length long, ids_crc32 long"


def sum_of_squares(sizes: np.ndarray, window: int, eager: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of each piece, placed in the given order, and the number of sequences.

    A new sequence is a candidate for every piece if eager, else only where no open sequence has room.
    """
    count = np.zeros(window + 1, np.int64)  # open sequences by gap; a full one is open no more
    stacks: list[list[int]] = [[] for _ in range(window + 1)]
    never = np.iinfo(np.int64).max
    sequence, offset, opened = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    for i, s in enumerate(sizes.tolist()):
        gap = window
        # From gap g to g - s the sum changes by (1 - 2 count[g]) and, unless that fills it, (1 + 2 count[g - s]).
        change = 1 - 2 * count[s:window]
        change[1:] += 1 + 2 * count[1 : window - s]
        change[count[s:window] == 0] = never
        if len(change):
            at = int(change.argmin())
            if change[at] < never and not (eager and change[at] > 1 + 2 * count[window - s]):
                gap = s + at
        if gap == window:
            number, opened = opened, opened + 1
        else:
            number = stacks[gap].pop()
            count[gap] -= 1
        sequence[i], offset[i] = number, window - gap
        if gap > s:
            count[gap - s] += 1
            stacks[gap - s].append(number)
    return sequence, offset, opened


def _pieces(path: str, window: int):
    def run(batches):
        tokenizer = byte_tokenizer(path, True)
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = np.array([*tokenizer.ids(text or ""), END_ID], "<u4").tobytes()
                n = len(raw) // 4
                start, piece = 0, 0
                while start < n:
                    length = window if (n - start) % window == 0 else (n - start) % window
                    out.append((task, row, doc, piece, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)])))
                    start, piece = start + length, piece + 1
                row += 1
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*out, strict=True)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["task", "row", "doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _placed(window: int):
    def run(table: pa.Table) -> pa.Table:
        sizes = table.column("length").to_numpy()
        name = [table.column(c).to_numpy() for c in ("piece", "row", "task")]
        best = None
        for order, eager in ((np.lexsort((*name, -sizes)), False), (np.lexsort((*name, table.column("deal").to_numpy())), True)):
            found = (*sum_of_squares(sizes[order], window, eager), order)
            if best is None or found[2] < best[2]:
                best = found
        sequence, offset, _, order = best
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        shard = table.column("shard").to_numpy()
        keep = table.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        return keep.append_column("sequence_id", pa.array((shard << 32) + sequence[back])).append_column("offset", pa.array(offset[back]))

    return run


def pack_best_fit(docs: DataFrame, path: str, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """One row for each piece of each row of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(path, window), PIECE), "pieces")
    shards = max(1, -(-pieces.count() // shard))
    deal = F.xxhash64("task", "row", "piece")
    dealt = pieces.withColumn("deal", deal).withColumn("shard", F.pmod("deal", F.lit(shards)).cast("long"))
    return dealt.groupBy("shard").applyInArrow(_placed(window), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
