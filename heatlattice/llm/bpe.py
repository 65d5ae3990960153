"""Byte-level BPE by a lazily determinised transducer, and decoding by an incremental UTF-8 state machine.

Encoding. A byte string is a valid BPE result exactly if every two neighbouring tokens are the BPE result of their own
bytes. So for every prefix there is one last token: the one that is valid behind the last token of the shorter prefix.
The transducer runs over the bytes through the subset construction of the token trie, whose states (the sets of open
trie nodes) and transitions are made when first met and kept; a register holds the last token of each recent prefix, and
of the tokens that end in a state the longest that is valid behind its predecessor is taken. Once all starts that are
still open agree on a prefix, its tokens are emitted, so lookahead and register are bounded by the tokens in doubt.
Pieces that were transduced whole are kept too, within a bound, as one long transition.

Decoding. A UTF-8 state machine over byte ranges, with the bits of the unfinished character, is lifted to tokens: each
token's path from each configuration is run once and kept, so decoding is one look-up a token, from chunk to chunk.

Defined cases: null text is empty and gives no ids; unpaired surrogates cannot occur in Arrow text; texts of any length
run in memory of their own size; repeated rows give repeated rows; empty tables give empty results; other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Pieces and pair tests that are remembered at most, and bytes after which a long piece emits.
PIECES, PAIRS, WINDOW = 400_000, 2_000_000, 1 << 14


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def plain_bpe(raw: bytes, ranks: dict[bytes, int], below: float = float("inf")) -> list[int]:
    """The definition: merge the leftmost pair of the lowest rank (under `below`) until none is left. For short strings."""
    parts = [raw[i : i + 1] for i in range(len(raw))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
        if ranks.get(parts[best] + parts[best + 1], below) >= below:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Encodes byte strings to token ids; `Stream` works on a stream of bytes."""

    def __init__(self, ranks: dict[bytes, int], pieces: int = PIECES) -> None:
        self.ranks, self.most = ranks, pieces
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.trie: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        self.depth: list[int] = [0]
        for raw, rank in ranks.items():
            node = 0
            for b in raw:
                step = self.trie[node].get(b)
                if step is None:
                    step = self.trie[node][b] = len(self.trie)
                    self.trie.append({})
                    self.token.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = step
            self.token[node] = rank
        self.fits: dict[int, bool] = {}
        self.spines: dict[int, list[tuple[bytes, float]]] = {}
        self.memo: dict[str, bytes] = {}
        self.known: dict[tuple[int, ...], int] = {}
        self.open: list[tuple[int, ...]] = []
        self.steps: list[dict[int, int]] = []
        self.ends: list[tuple[tuple[int, int], ...]] = []
        self.start = self._state((0,))

    def _state(self, nodes: tuple[int, ...]) -> int:
        """A state of the determinised trie: its open nodes, longest first, and the tokens that end here."""
        found = self.known.get(nodes)
        if found is None:
            found = self.known[nodes] = len(self.open)
            self.open.append(nodes)
            self.steps.append({})
            self.ends.append(tuple((self.token[n], self.depth[n]) for n in nodes if self.token[n] >= 0))
        return found

    def _step(self, state: int, byte: int) -> int:
        on = (self.trie[n].get(byte) for n in self.open[state])
        to = self.steps[state][byte] = self._state((*(n for n in on if n is not None), 0))
        return to

    def _spine(self, token: int, side: int) -> list[tuple[bytes, float]]:
        """The parts that stand at the right (side 1) or left (side 0) edge of a token while it is merged, innermost
        first, each with the rank at which the next larger one replaces it."""
        found = self.spines.get(token << 1 | side)
        if found is None:
            raw, rank = self.bytes_of[token], float("inf")
            found = []
            while True:
                found.append((raw, rank))
                if len(raw) == 1:
                    break
                rank = self.ranks[raw]
                parts = plain_bpe(raw, self.ranks, rank)
                if len(parts) != 2:  # BPE does not make this token of its bytes
                    found = []
                    break
                raw = self.bytes_of[parts[side]]
            found.reverse()
            self.spines[token << 1 | side] = found
        return found

    def _fit(self, left: int, right: int) -> bool:
        """Whether the BPE result of the two tokens' bytes (left -1: of right's alone) is the two tokens: no pair of
        edge parts that stand side by side merges before one of them grows. At equal ranks the leftmost merges."""
        b = self._spine(right, 0)
        ok = bool(b)
        if ok and left >= 0:
            a = self._spine(left, 1)
            i = j = 0
            while True:
                (x, x_until), (y, y_until) = a[i], b[j]
                rank = self.ranks.get(x + y)
                if rank is not None and rank < x_until and rank <= y_until:
                    ok = False
                    break
                if i + 1 == len(a) and j + 1 == len(b):
                    break
                if x_until <= y_until:
                    i += 1
                else:
                    j += 1
        if len(self.fits) > PAIRS:
            self.fits.clear()
        self.fits[left << 32 | right] = ok
        return ok

    def feed(self, state: int, raw: bytes, last: list[int]) -> int:
        """Go on over raw; last holds, for each position so far, the last token of the text up to there."""
        steps, ends, fits = self.steps, self.ends, self.fits
        for b in raw:
            to = steps[state].get(b)
            state = self._step(state, b) if to is None else to
            n = len(last)
            for token, length in ends[state]:
                before = last[n - length]
                ok = fits.get(before << 32 | token)
                if self._fit(before, token) if ok is None else ok:
                    last.append(token)
                    break
        return state

    def back(self, last: list[int], at: int) -> list[int]:
        """The tokens up to a position."""
        out = []
        while at and last[at] >= 0:
            out.append(last[at])
            at -= len(self.bytes_of[last[at]])
        return out[::-1]

    def encode(self, raw: bytes) -> list[int]:
        stream = Stream(self)
        out = []
        for i in range(0, len(raw), WINDOW):
            out += stream.feed(raw[i : i + WINDOW])
        return out + stream.finish()

    def encode_pieces(self, pieces: list[str]) -> bytes:
        """The ids of pieces that are encoded separately, as little-endian unsigned 32-bit integers."""
        memo = self.memo
        try:
            return b"".join([memo[p] for p in pieces])
        except KeyError:
            pass
        out = []
        for p in pieces:
            ids = memo.get(p)
            if ids is None:
                raw = p.encode()
                if len(raw) <= WINDOW:
                    last = [-1]
                    self.feed(self.start, raw, last)
                    ids = array("I", self.back(last, len(raw))).tobytes()
                else:
                    ids = array("I", self.encode(raw)).tobytes()
                if len(raw) <= 64:
                    if len(memo) >= self.most:
                        memo.clear()
                    memo[p] = ids
            out.append(ids)
        return b"".join(out)


class Stream:
    """One byte string in chunks. A token is emitted once every open start lies behind it."""

    def __init__(self, coder: Transducer) -> None:
        self.coder, self.state, self.last = coder, coder.start, [-1]

    def feed(self, raw: bytes) -> list[int]:
        coder, last = self.coder, self.last
        self.state = coder.feed(self.state, raw, last)
        end = len(last) - 1
        live = {end - coder.depth[n] for n in coder.open[self.state]}
        while len(live) > 1:  # the latest position at which all live starts agree
            at = max(live)
            live.remove(at)
            live.add(at - len(coder.bytes_of[last[at]]) if last[at] >= 0 and at > 0 else 0)
        at = live.pop()
        out = coder.back(last, at)
        del last[:at]  # position `at` becomes 0 and keeps its last token for the pair test
        return out

    def finish(self) -> list[int]:
        return self.coder.back(self.last, len(self.last) - 1)


def _utf8_table() -> list[list[int]]:
    """For each state and byte, the next state; REJECT where the byte cannot follow. States are what a character still
    needs: 0 nothing, 1 to 3 so many continuation bytes, 4 to 7 the same with a narrower range for the first of them."""
    table = [[REJECT] * 256 for _ in range(8)]
    for b in range(0x80):
        table[0][b] = 0
    for b in range(0xC2, 0xF5):
        table[0][b] = {0xE0: 4, 0xED: 5, 0xF0: 6, 0xF4: 7}.get(b, 1 if b < 0xE0 else 2 if b < 0xF0 else 3)
    for state, first, last, to in ((1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2)):
        for b in range(first, last + 1):
            table[state][b] = to
    return table


REJECT = -1
_TABLE = _utf8_table()
#: Bits of a lead byte that belong to the character, by the state it leads to.
_LEAD = {1: 0x1F, 2: 0x0F, 4: 0x0F, 5: 0x0F, 3: 0x07, 6: 0x07, 7: 0x07}


class Utf8Machine:
    """Turns chunks of bytes into characters, byte by byte: a state, and the bits of the unfinished character. A byte that
    cannot follow ends the unfinished character as U+FFFD and is read anew; one that cannot lead is U+FFFD itself."""

    def __init__(self) -> None:
        self.state, self.bits = 0, 0

    def feed(self, chunk: bytes) -> str:
        out, state, bits = [], self.state, self.bits
        for b in chunk:
            to = _TABLE[state][b]
            if to == REJECT:
                out.append("\ufffd")
                if not state:
                    continue
                state, to = 0, _TABLE[0][b]
                if to == REJECT:
                    out.append("\ufffd")
                    state = 0
                    continue
            bits = bits << 6 | b & 0x3F if state else b & _LEAD.get(to, 0x7F)
            state = to
            if not state:
                out.append(chr(bits))
        self.state, self.bits = state, bits
        return "".join(out)

    def finish(self) -> str:
        rest = "\ufffd" if self.state else ""
        self.state, self.bits = 0, 0
        return rest


class Decoder:
    """The machine lifted to tokens: from each of its configurations a token leads to another one and gives characters,
    found by running the machine over the token's bytes once."""

    def __init__(self, bytes_of: list[bytes], most: int = PAIRS) -> None:
        self.bytes_of, self.most = bytes_of, most
        self.machine = Utf8Machine()
        self.arcs: dict[tuple[int, int], dict[int, tuple[str, tuple[int, int]]]] = {}
        # From the resting state: the characters of each token that ends in it, else None.
        self.resting: list[str | None] = []
        for raw in bytes_of:
            text, to = self._run((0, 0), raw)
            self.resting.append(text if to[0] == 0 else None)

    def _run(self, at: tuple[int, int], raw: bytes) -> tuple[str, tuple[int, int]]:
        self.machine.state, self.machine.bits = at
        text = self.machine.feed(raw)
        return text, (self.machine.state, self.machine.bits if self.machine.state else 0)

    def chunks(self, ids: array, chunk: int = 1 << 16) -> Iterator[str]:
        """Text in chunks; an unfinished character waits for the next one."""
        at, resting = (0, 0), self.resting
        for i in range(0, len(ids), chunk):
            part = ids[i : i + chunk]
            if at == (0, 0):
                texts = [resting[t] for t in part]
                if None not in texts:
                    yield "".join(texts)
                    continue
            out = []
            for t in part:
                if at == (0, 0) and resting[t] is not None:
                    out.append(resting[t])
                    continue
                arcs = self.arcs.setdefault(at, {})
                step = arcs.get(t)
                if step is None:
                    if len(self.arcs) * len(arcs) > self.most:
                        self.arcs.clear()
                        arcs = self.arcs.setdefault(at, {})
                    step = arcs[t] = self._run(at, self.bytes_of[t])
                out.append(step[0])
                at = step[1]
            yield "".join(out)
        if at[0]:
            yield "\ufffd"


@cache
def _coder(path: str):
    ranks = load_ranks(path)
    coder = Transducer(ranks)
    table = [b""] * (max(ranks.values()) + 1)
    for raw, rank in ranks.items():
        table[rank] = raw
    return coder, Decoder(table)


def _encoded(path: str, pattern: str, with_ids: bool):
    def run(batches):
        import regex

        split = regex.compile(pattern).findall
        coder, decoder = _coder(path)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = coder.encode_pieces(split(text or ""))
                ids = array("I")
                ids.frombytes(raw)
                decoded = hashlib.sha256()
                for part in decoder.chunks(ids):
                    decoded.update(part.encode())
                rows.append((doc, len(ids), hashlib.sha256(raw).hexdigest(), decoded.hexdigest(), *([list(ids)] if with_ids else [])))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()))
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=False)], names=names[: len(cols)])

    return run


def encode(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids, for each row of docs (doc_id, text)."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(_encoded(path, pattern, with_ids), schema)
