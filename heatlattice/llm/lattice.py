"""Language-model scores of whole texts: the marginal probability of all segmentations into an existing vocabulary.

A text is its words in order and one end. The pieces of a unigram vocabulary, with the word-start mark, and the 256 bytes
generate a word in all ways that spell it; a log-space forward recursion over the lattice sums them. Pieces never cross
words, so the text's marginal is the product over its words and the end, and that is the score. The vocabulary's own
scores (ranks) weight the first lattice; expected counts by forward-backward over the distinct training words, each
as often as training texts have it, give the piece probabilities (`rounds` of it), so score is the log probability of a
proper model of piece sequences. Vocabulary and piece counts have a fixed size; word counts grow with the corpus and stay
distributed: each distinct word meets its count and its lattice once, the `head` most frequent ones are broadcast (a fixed
number of short words), all others reach their documents by a join.

Defined cases: null or blank text is the end alone; words of any length and any bytes have a probability, as every byte
is a piece; rows that share a doc_id are scored one by one, and each is a training text of its own; a null doc_id belongs
to neither fold's remainder, so it is training and not held out; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, discard, portions, remainder, staged, utf8, word_hashes, words

PORTION, HEAD, SHORT = 1 << 20, 150_000, 48
MARK = "▁".encode()
FLOOR = 0.05


class Pieces:
    """The vocabulary as a trie over bytes, with a table of children for numpy."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n = model.get_piece_size()
        rows, first = [], np.full(self.n + 1, -np.inf)
        for i in range(self.n):
            if model.is_byte(i):
                rows.append((bytes([int(model.id_to_piece(i)[3:5], 16)]), i, True))
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                rows.append((model.id_to_piece(i).encode(), i, False))
            else:
                continue
            first[i] = -np.log(2.0 + abs(min(0.0, model.get_score(i))))
        first[self.n] = -np.log(64.0)  # the end
        self.first = first - np.logaddexp.reduce(first)
        nodes, tokens = 1, {}
        index: dict[tuple[int, int], int] = {}
        for raw, i, _ in sorted(rows, key=lambda r: r[2]):
            node = 0
            for b in raw:
                step = index.get((node, b))
                if step is None:
                    step = index[node, b] = nodes
                    nodes += 1
                node = step
            tokens.setdefault(node, []).append(i)
        self.child = np.zeros((nodes, 256), np.int32)
        for (node, b), to in index.items():
            self.child[node, b] = to
        self.token = np.full(nodes, -1, np.int32)
        self.second = np.full(nodes, -1, np.int32)  # a one-byte piece beside the byte's own fallback
        for node, found in tokens.items():
            self.token[node] = found[0]
            if len(found) > 1:
                self.second[node] = found[1]

    def weights(self, logp: np.ndarray) -> np.ndarray:
        """For each trie node, the log probability of the pieces that end there."""
        out = np.where(self.token >= 0, logp[self.token], -np.inf)
        two = self.second >= 0
        out[two] = np.logaddexp(out[two], logp[self.second[two]])
        return out


@cache
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def _arcs(pieces: Pieces, grid: np.ndarray, lengths: np.ndarray):
    """For each start column, the (length, rows, trie nodes) of pieces there; rows of grid are sorted by falling length."""
    for t in range(int(lengths[0])):
        rows = np.arange(int(np.searchsorted(-lengths, -t, "left")))
        node = np.zeros(len(rows), np.int32)
        for step in range(t, int(lengths[0])):
            node = pieces.child[node, grid[rows, step]]
            on = (node > 0) & (lengths[rows] > step)
            rows, node = rows[on], node[on]
            if not len(rows):
                break
            hit = pieces.token[node] >= 0
            if hit.any():
                yield t, step + 1, rows[hit], node[hit]


def marginals(pieces: Pieces, weight: np.ndarray, spelled: list[bytes], counts: np.ndarray | None = None, expected: np.ndarray | None = None) -> np.ndarray:
    """Natural log of the marginal probability of each byte string; with counts, adds the expected counts of trie nodes."""
    lengths = np.array([len(w) for w in spelled])
    out = np.zeros(len(spelled))
    for i in np.flatnonzero(lengths > SHORT):
        out[i] = _long(pieces, weight, spelled[i], None if counts is None else counts[i], expected)
    short = np.flatnonzero(lengths <= SHORT)
    short = short[np.argsort(-lengths[short], kind="stable")]
    if not len(short):
        return out
    n, width = lengths[short], int(lengths[short[0]])
    raw = b"".join([spelled[i].ljust(width, b"\0") for i in short.tolist()])
    grid = np.frombuffer(raw, np.uint8).reshape(len(short), width)
    alpha = np.full((width + 1, len(short)), -np.inf)
    alpha[0] = 0
    arcs = [] if counts is not None else None
    for t, to, rows, node in _arcs(pieces, grid, n):
        alpha[to, rows] = np.logaddexp(alpha[to, rows], alpha[t, rows] + weight[node])
        if arcs is not None:
            arcs.append((t, to, rows, node))
    total = alpha[n, np.arange(len(short))]
    out[short] = total
    if arcs is not None:
        beta = np.full((width + 1, len(short)), -np.inf)
        beta[n, np.arange(len(short))] = 0
        for t, to, rows, node in reversed(arcs):
            beta[t, rows] = np.logaddexp(beta[t, rows], beta[to, rows] + weight[node])
        for t, to, rows, node in arcs:
            with np.errstate(invalid="ignore"):
                share = np.exp(alpha[t, rows] + weight[node] + beta[to, rows] - total[rows]) * counts[short[rows]]
            expected += np.bincount(node, weights=np.nan_to_num(share), minlength=len(expected))
    return out


def _long(pieces: Pieces, weight: np.ndarray, raw: bytes, count, expected) -> float:
    """The same for one long word, position by position."""
    n = len(raw)
    alpha = np.full(n + 1, -np.inf)
    alpha[0] = 0
    arcs = []
    for t in range(n):
        node = 0
        for to in range(t, n):
            node = int(pieces.child[node, raw[to]])
            if not node:
                break
            if pieces.token[node] >= 0:
                alpha[to + 1] = np.logaddexp(alpha[to + 1], alpha[t] + weight[node])
                if count is not None:
                    arcs.append((t, to + 1, node))
    if count is not None:
        beta = np.full(n + 1, -np.inf)
        beta[n] = 0
        for t, to, node in reversed(arcs):
            beta[t] = np.logaddexp(beta[t], beta[to] + weight[node])
        for t, to, node in arcs:
            expected[node] += np.exp(alpha[t] + weight[node] + beta[to] - alpha[n]) * count
    return float(alpha[n])


def _counted(batches):
    """(word, n): distinct words of this task and how often its training texts have them, the end as a null word."""
    keys, counts, spelled, docs = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array(spelled, pa.binary()), pa.array(counts)], names=["word", "n"])

    with np.errstate(over="ignore"):
        for batch in batches:
            data, at = utf8(batch.column("text"))
            train = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
            docs += int(train.sum())
            for i, j in portions(at, PORTION):
                part = LOWER[data[at[i] : at[j]]]
                starts, ends, row = words(part, at[i : j + 1] - at[i])
                if not len(starts):
                    continue
                h, where, inverse = np.unique(word_hashes(part, starts, ends), return_index=True, return_inverse=True)
                n = np.bincount(inverse, weights=train[i:j][row], minlength=len(h)).astype(np.int64)
                spot = np.searchsorted(keys, h)
                spot[spot == len(keys)] = 0
                known = keys[spot] == h if len(keys) else np.zeros(len(h), bool)
                counts[spot[known]] += n[known]
                new = ~known
                raw = part.tobytes()
                fresh = [raw[a:b] for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)]
                order = np.argsort(np.concatenate([keys, h[new]]), kind="stable")
                keys, counts = np.concatenate([keys, h[new]])[order], np.concatenate([counts, n[new]])[order]
                both = spelled + fresh
                spelled = [both[k] for k in order.tolist()]
                if len(keys) > 600_000:
                    yield out()
                    keys, counts, spelled = np.zeros(0, np.uint64), np.zeros(0, np.int64), []
    if spelled:
        yield out()
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([docs], pa.int64())], names=["word", "n"])


def _expected(path: str, logp):
    def run(batches):
        pieces = _pieces(path)
        weight = pieces.weights(logp.value)
        total = np.zeros(len(weight))
        for batch in batches:
            spelled = [MARK + w for w in batch.column("word").to_pylist()]
            times = batch.column("n").to_numpy().astype(float)
            for i in range(0, len(spelled), 8192):
                marginals(pieces, weight, spelled[i : i + 8192], times[i : i + 8192], total)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit])], names=["node", "n"])

    return run


def fit(vocabulary: DataFrame, path: str, ends: int, rounds: int = 2) -> np.ndarray:
    """Log probabilities of the pieces and, last, the end, which `ends` training texts have; vocabulary holds (word, n)."""
    spark = vocabulary.sparkSession
    pieces = _pieces(path)
    logp = pieces.first
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(logp)
        found = vocabulary.where("n > 0").select("word", "n").mapInArrow(_expected(path, sent), "node long, n double").groupBy("node").agg(F.sum("n").alias("n")).toArrow()
        counts = np.where(np.isfinite(pieces.first), FLOOR, 0.0)
        node, n = found["node"].to_numpy(), found["n"].to_numpy()
        weight = pieces.weights(logp)
        one, two = pieces.token[node], pieces.second[node]
        share = np.exp(logp[one] - weight[node])  # of pieces that are spelled alike
        np.add.at(counts, one, n * share)
        np.add.at(counts, two[two >= 0], (n * (1 - share))[two >= 0])
        counts[pieces.n] += ends
        with np.errstate(divide="ignore"):
            logp = np.log(counts) - np.log(counts.sum())
    return logp


def _scored(path: str, logp):
    def run(batches):
        pieces = _pieces(path)
        weight = pieces.weights(logp.value)
        for batch in batches:
            spelled = [MARK + w for w in batch.column("word").to_pylist()]
            score = np.concatenate([marginals(pieces, weight, spelled[i : i + 16384]) for i in range(0, len(spelled), 16384)]) if spelled else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(score / np.log(10))], names=["word", "n", "lattice"])

    return run


def _split(head):
    """Per row the sums over its frequent words, and a row for each other distinct word."""

    def run(batches):
        keys, logs, known, lattice = head.value
        task, line = TaskContext.get().partitionId() << 33, 0
        names = ["line", "doc_id", "train", "tokens", "known", "logs", "lattice", "word", "times"]
        with np.errstate(over="ignore"):
            for batch in batches:
                data, at = utf8(batch.column("text"))
                for i, j in portions(at, PORTION):
                    n = j - i
                    part = LOWER[data[at[i] : at[j]]]
                    starts, ends, row = words(part, at[i : j + 1] - at[i])
                    h = word_hashes(part, starts, ends) if len(starts) else np.zeros(0, np.uint64)
                    spot = np.searchsorted(keys, h)
                    spot[spot == len(keys)] = 0
                    hit = keys[spot] == h if len(keys) else np.zeros(len(h), bool)
                    total = lambda v, r=row[hit], s=spot[hit], n=n: np.bincount(r, weights=v[s], minlength=n).astype(float)
                    lines = task + line + np.arange(n)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(lines), batch.column("doc_id").slice(i, n), batch.column("train").slice(i, n), pa.array(np.bincount(row, minlength=n).astype(np.int64)), pa.array(total(known).astype(np.int64)), pa.array(total(logs)), pa.array(total(lattice)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())],
                        names=names,
                    )
                    rest = np.flatnonzero(~hit)
                    if len(rest):
                        order = rest[np.lexsort((h[rest], row[rest]))]
                        new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])])
                        first = order[new]
                        times = np.diff(np.concatenate([np.flatnonzero(new), [len(order)]]))
                        raw = part.tobytes()
                        spelled = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
                        none = [pa.nulls(len(first), t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                        yield pa.RecordBatch.from_arrays([pa.array(lines[row[first]]), *none, pa.array(spelled, pa.binary()), pa.array(times.astype(np.int64))], names=names)
                    line += n

    return run


def score(docs: DataFrame, path: str, modulus: int = 7, held: int = 2, rounds: int = 2, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.coalesce(remainder("doc_id", modulus), F.lit(-1)) != held).alias("train"))
    found = slim.select("text", "train").mapInArrow(_counted, "word binary, n long")
    counted = staged(found.groupBy("word").agg(F.sum("n").alias("n")), "counts")
    n = F.col("n")
    sums = counted.agg(F.sum(n), F.count_if(n > 0), F.sum(F.when(F.col("word").isNull(), n))).first()
    tokens, distinct, ends = (int(x or 0) for x in sums)
    vocabulary = counted.where("word is not null")
    logp = fit(vocabulary, path, ends, rounds)
    scored = staged(vocabulary.mapInArrow(_scored(path, spark.sparkContext.broadcast(logp)), "word binary, n long, lattice double"), "words")
    discard(counted)
    end = logp[-1] / np.log(10)

    top = scored.where(F.length("word") <= SHORT).orderBy(F.desc("n"), "word").limit(head).toArrow()  # a fixed number of short words
    raw, at = utf8(top["word"])
    with np.errstate(over="ignore"):
        keys = word_hashes(raw, at[:-1], at[1:]) if len(top) else np.zeros(0, np.uint64)
    order = np.argsort(keys)
    n = top["n"].to_numpy()[order].astype(float)
    sent = spark.sparkContext.broadcast((keys[order], np.log10(n + 1), (n > 0).astype(float), top["lattice"].to_numpy()[order]))
    parts = staged(slim.mapInArrow(_split(sent), "line long, doc_id long, train boolean, tokens long, known long, logs double, lattice double, word binary, times long"), "lines")
    tail = parts.where("word is not null").select("line", "word", "times").join(scored, "word")
    tail = tail.select(
        "line", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("train"), F.lit(0).cast("long").alias("tokens"),
        F.when(F.col("n") > 0, F.col("times")).otherwise(0).alias("known"), (F.col("times") * F.log10(F.col("n") + 1)).alias("logs"), (F.col("times") * F.col("lattice")).alias("lattice"),
    )
    rows = parts.where("word is null").drop("word", "times").unionByName(tail)
    out = rows.groupBy("line").agg(F.max("doc_id").alias("doc_id"), F.max("train").alias("train"), *(F.sum(c).alias(c) for c in ("tokens", "known", "logs", "lattice")))
    n_tokens = F.col("tokens") + 1
    return out.select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        n_tokens.alias("n_tokens"),
        (F.col("known") + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.log10(F.lit(ends + 1.0)) - n_tokens * F.log10(F.lit(float(tokens + distinct + 1)))).alias("base_score"),
        (F.col("lattice") + F.lit(float(end))).alias("score"),
    )
