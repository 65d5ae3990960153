"""Ids of whole texts by a byte-level BPE file of the `tokenizers` library."""

from __future__ import annotations

import json
import re
from functools import cache

import numpy as np

from .packing import _byte_letters

# Fixed value: how the byte-level pre-tokenizer splits texts before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space runs from this length on go to the library, as splitting them needs a stack of their length.
LONG_SPACE = 512


class ByteTokenizer:
    """Where the file is plain byte-level BPE whose ids are in merge order, ranks stand for merges and the work is done by
    `tiktoken`, which is several times faster; all else, and texts that spell a special token that counts as one, go to
    the library itself."""

    def __init__(self, path: str, special: bool) -> None:
        from tokenizers import Tokenizer

        with open(path) as f:
            make = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not special
        vocab, model, split = make["model"]["vocab"], make["model"], make.get("pre_tokenizer") or {}
        added = [t["content"] for t in make.get("added_tokens") or []]
        byte_of = {c: b for b, c in enumerate(_byte_letters())}
        self.spelled = [b""] * self.library.get_vocab_size()
        for token, i in vocab.items():
            self.spelled[i] = bytes([byte_of[c] for c in token]) if all(c in byte_of for c in token) else token.encode()
        odd = [rf"\s{{{LONG_SPACE},}}", *(map(re.escape, added) if special else [])]
        self.odd = re.compile("|".join(odd)).search
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        merged = [vocab.get(a + b, -1) for a, b in merges]
        plain = model["type"] == "BPE" and not model.get("byte_fallback") and not model.get("dropout") and make.get("normalizer") is None and not make.get("post_processor")
        plain = plain and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        self.fast = None
        if plain and merged == sorted(merged) and all(i >= 0 for i in merged):
            import tiktoken

            kept = {self.spelled[i]: i for t, i in vocab.items() if t not in added}
            self.fast = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=kept, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> list[int]:
        if self.fast is None or self.odd(text):
            return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return self.fast(text)


@cache
def byte_tokenizer(path: str, special: bool) -> ByteTokenizer:
    return ByteTokenizer(path, special)


class Spellings:
    """Bytes of tokens, laid out for numpy."""

    def __init__(self, spelled: list[bytes]) -> None:
        self.flat = np.frombuffer(b"".join(spelled), np.uint8)
        self.length = np.array([len(s) for s in spelled], np.int64)
        self.first = np.cumsum(self.length) - self.length

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all tokens in turn."""
        n = self.length[ids]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.first[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
