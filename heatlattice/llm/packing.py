"""Packing by concatenating and cutting.

First pass: every task tokenizes its documents and writes their ids with its own number and the running sum of tokens
inside it. The tasks' totals, one number each, give the tasks' global offsets by a second prefix sum. Second pass: a
document's place in the one long concatenation is known, so it is cut at multiples of the window without any shuffle,
and each piece is a boundary record. Only the last sequence is shorter than the window.

Words are tokenized once and kept, within a bound; texts with characters outside Latin letters or with the spelling of a
special token, and tokenizers of other makes, go to the tokenizer whole.

Defined cases: a null or empty text is the end token alone; rows that share a doc_id are packed one by one; a null
doc_id stays null; texts of any length are cut into as many pieces as they need; an empty table gives no piece; other
columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

WINDOW, END_ID = 2048, 1
#: Words kept by each Python worker.
KEPT = 250_000


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if printable Latin-1, else
    the next free one from U+0100 on."""
    own = {b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordTokenizer:
    """Ids of whole texts by a `tokenizers` file, as unsigned 16- or 32-bit little-endian bytes."""

    #: The make for which words can be kept: white space joined, lower case, words split off by this pattern.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path) as f:
            make = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        # Spellings of added tokens, in any case, are left to the library: it gives them ids of their own.
        spelled = sorted((re.escape(t["content"]) for t in make.get("added_tokens") or []), key=len, reverse=True)
        self.special = re.compile("|".join(spelled) or r"(?!)", re.IGNORECASE).search
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.end = np.array([END_ID], self.dtype).tobytes()
        self.model, self.memo, self.letters = self.tokenizer.model, {}, _byte_letters()
        steps = (make.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        kinds = [x["type"] for x in (make.get("normalizer") or {}).get("normalizers") or []]
        self.by_word = kinds == ["NFC", "Replace", "Lowercase"] and steps[0].get("pattern") == {"Regex": self.SPLIT} and [x["type"] for x in steps] == ["Split", "ByteLevel"] and not steps[1]["add_prefix_space"] and make["model"].get("end_of_word_suffix") == "</w>"
        plain = [chr(c) for c in (*range(0x09, 0x0E), *range(0x20, 0x7F), *range(0xA0, 0x250)) if c != 0x130]
        self.odd = re.compile("[^" + re.escape("".join(plain)) + "]").search
        letters = "".join(c for c in plain if unicodedata.category(c)[0] == "L")
        numbers = re.escape("".join(c for c in plain if unicodedata.category(c)[0] == "N"))
        self.split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\s{letters}{numbers}]+").findall

    def _word(self, word: str) -> bytes:
        letters = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
        ids = np.array([t.id for t in self.model.tokenize(letters)], self.dtype).tobytes()
        if len(word) <= 48:
            if len(self.memo) >= KEPT:
                self.memo.clear()
            self.memo[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_word or self.odd(text) or self.special(text):
            return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype).tobytes()
        get, make = self.memo.get, self._word
        return b"".join([get(w) or make(w) for w in self.split(text.lower())])


@cache
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def _counted(path: str):
    def run(batches):
        tokenizer = _tokenizer(path)
        size = np.dtype(tokenizer.dtype).itemsize
        task, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [tokenizer.ids(t) + tokenizer.end for t in batch.column("text").to_pylist()]
            n = np.array([len(x) // size for x in ids], np.int64)
            ends = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), task, np.int32)), pa.array(ends - n), batch.column("doc_id"), pa.array(n), pa.array(ids, pa.binary())], names=["task", "at", "doc_id", "n", "ids"])
            at = int(ends[-1]) if len(ends) else at

    return run


def _cut(offsets, window: int, dtype: str, with_ids: bool):
    def run(batches):
        size = np.dtype(dtype).itemsize
        for batch in batches:
            rows = []
            for task, at, doc, n, raw in zip(*(batch.column(c).to_pylist() for c in ("task", "at", "doc_id", "n", "ids")), strict=True):
                place = offsets.value[task] + at
                wide = np.frombuffer(raw, dtype).astype("<u4").tobytes() if size < 4 else raw
                start = 0
                while start < n:
                    sequence, offset = divmod(place + start, window)
                    length = min(n - start, window - offset)
                    part = wide[4 * start : 4 * (start + length)]
                    rows.append((doc, start, length, zlib.crc32(part), n, sequence, offset, *([np.frombuffer(part, "<u4").tolist()] if with_ids else [])))
                    start += length
            if rows:
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
                kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=False)], names=names[: len(cols)])

    return run


def pack(docs: DataFrame, path: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    counted = staged(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_counted(path), "task int, at long, doc_id long, n long, ids binary"),
        "tokens",
    )
    totals = counted.groupBy("task").agg(F.sum("n").alias("n")).orderBy("task").toArrow()  # one row for each task
    sums = np.cumsum([0, *totals["n"].to_pylist()]).tolist()
    offsets = spark.sparkContext.broadcast(dict(zip(totals["task"].to_pylist(), sums, strict=False)))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return counted.mapInArrow(_cut(offsets, window, WordTokenizer(path).dtype, with_ids), schema)
