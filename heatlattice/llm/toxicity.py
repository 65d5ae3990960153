"""Toxic spans by a linear-chain conditional random field.

Labels mark documents; tokens get theirs from a bounded sample of labelled rows: a feature (a word or a word beginning)
that exact binomial tests find tied to toxic documents, with a bound on false discoveries, marks the tokens of toxic
documents that have it. The field has two states; features are a token's word, beginnings and ending as the
sample's windows have them (others weigh nothing), and the transitions. It is fitted by gradient steps on windows of the sample. Forward and backward
recursions over the whole text give each token's marginal, for many documents at a time; a logistic fit on all rows of
the sample, each marked by a field that has not seen it, turns their sum and maximum into the document's score, and tokens whose marginal is
at least one half are reported with their character offsets (`spans`).

Defined cases: null or empty texts have no token and score as the logistic fit has it for none; without labels of both
kinds every score is the share of toxic labels (0 without labels); a document with several labels counts as toxic if one
says so; repeated rows, and different texts of one doc_id, are scored one by one (all of
them may be in the sample); a null doc_id is not held out, has no label and stays null; a labelled text longer than
LONGEST is not learned from, but scored; texts are read whole, and offsets count code points of the text as it is;
empty tables give empty results.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, mix, remainder

TOXIC, CLEAN = 2000, 8000  # rows of the sample
#: Characters of one text, and of all, that the sample may hold.
LONGEST, ROOM = 1 << 20, 1 << 27
WIDTH, STEPS, KEPT = 32, 60, 400_000
#: Windows of each sampled row that the field is fitted on: with marked tokens, and without.
MARKED, OTHERS = 6, 2
PORTION = 1 << 23
#: Share of false discoveries among the tied features, and of a tied feature's rows that may be clean.
FALSE, CLEAN_SHARE = 0.01, 0.02
#: Parts that rows are scored by fields of the others in, and how far weights of the field and of the logistic fit are held back.
FOLDS, DECAY, RIDGE = 2, 1e-4, 0.05
TOKEN = re.compile(r"\w+")


def features(word: str) -> list[str]:
    return ["w" + word, "3" + word[:3], "4" + word[:4], "5" + word[:5], "e" + word[-3:]]


def upper_tail(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) >= k)."""
    if k <= 0:
        return 1.0
    t = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    total = 0.0
    for j in range(k, min(n, k + 2000) + 1):
        total += math.exp(t)
        t += math.log(max(n - j, 1e-300)) - math.log(j + 1) + math.log(p) - math.log1p(-p)
    return min(1.0, total)


class Field:
    """weights: emission of state 1 over 0 by feature; moves: start, 0 to 1, 1 to 0, 1 to 1 (0 to 0 is 0)."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self.bias = -3.0
        self.moves = np.array([-2.0, -2.0, 0.0, 0.0])
        self.logistic = np.array([0.0, 0.0, 0.0])
        self.memo: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def emission(self, word: str) -> float:
        got = self.memo.get(word)
        if got is None:
            weight = self.weights.get
            got = self.bias + sum([weight(f, 0.0) for f in features(word.lower())])
            if len(word) <= 64:
                if len(self.memo) >= KEPT:
                    self.memo.clear()
                self.memo[word] = got
        return got

    def marginals(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """P(state 1) of every token, by forward and backward ratios; rows hold emissions."""
        lengths = np.array([len(r) for r in rows], np.int64)
        order = np.argsort(-lengths, kind="stable")
        sizes = lengths[order]
        steps = int(sizes[0]) if len(sizes) else 0
        active = np.searchsorted(-sizes, -np.arange(steps), "left")  # rows longer than t
        at = np.concatenate([[0], np.cumsum(active)])
        flat = np.concatenate([rows[i] for i in order]) if len(rows) else np.zeros(0)
        firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
        where = np.concatenate([firsts[:n] + t for t, n in enumerate(active.tolist())]) if steps else np.zeros(0, np.int64)
        emit = np.exp(np.clip(flat[where], -50, 50))  # time-major
        start, up, down, stay = np.exp(self.moves)
        ahead = np.empty_like(emit)
        for t in range(steps):
            n = int(active[t])
            now = emit[at[t] : at[t] + n]
            if t == 0:
                ahead[at[0] : at[0] + n] = now * start
            else:
                r = ahead[at[t - 1] : at[t - 1] + n]
                ahead[at[t] : at[t] + n] = now * (up + r * stay) / (1 + r * down)
        behind = np.ones_like(emit)  # message from the right, as a ratio of state 1 to 0
        for t in range(steps - 2, -1, -1):
            n = int(active[t + 1])
            r = behind[at[t + 1] : at[t + 1] + n] * emit[at[t + 1] : at[t + 1] + n]
            behind[at[t] : at[t] + n] = (down + r * stay) / (1 + r * up)
        odds = ahead * behind
        p = np.empty_like(flat)
        p[where] = odds / (1 + odds)
        out: list[np.ndarray] = [None] * len(rows)  # type: ignore[list-item]
        for i, a, n in zip(order.tolist(), firsts.tolist(), sizes.tolist(), strict=True):
            out[i] = p[a : a + n]
        return out

    def score(self, marginals: np.ndarray) -> float:
        most, total = (float(marginals.max()), float(marginals.sum())) if len(marginals) else (0.0, 0.0)
        z = self.logistic @ np.array([1.0, most, math.log1p(total)])
        return float(1 / (1 + math.exp(-max(-40.0, min(40.0, z)))))


def _windows(rows: list[list[str]], marks: list[list[int]], rng: np.random.Generator):
    """Windows of WIDTH tokens: of each row the first MARKED with marked tokens and OTHERS drawn from the rest, so that
    the fit's work is bounded by the sample's rows however long they are."""
    out = []
    for tokens, mark in zip(rows, marks, strict=True):
        parts = [(tokens[i : i + WIDTH], mark[i : i + WIDTH]) for i in range(0, len(tokens), WIDTH)]
        hot = [p for p in parts if any(p[1])][:MARKED]
        cold = [p for p in parts if not any(p[1])]
        out += hot + [cold[i] for i in rng.permutation(len(cold))[:OTHERS]]
    return out


def _train(field: Field, windows) -> None:
    """Adam steps on the likelihood of the windows' marks."""
    n = len(windows)
    if not any(tokens for tokens, _ in windows):
        return
    vocabulary: dict[str, int] = {}
    ids = np.zeros((WIDTH, n), np.int64)
    mark, real = np.zeros((WIDTH, n)), np.zeros((WIDTH, n))
    for j, (tokens, marks) in enumerate(windows):
        ids[: len(tokens), j] = [vocabulary.setdefault(w, len(vocabulary)) for w in tokens]
        mark[: len(tokens), j], real[: len(tokens), j] = marks, 1
    names: dict[str, int] = {}
    table = np.array([[names.setdefault(f, len(names)) for f in features(w)] for w in vocabulary])
    theta = np.zeros(len(names) + 5)
    theta[-5], theta[-4:] = field.bias, field.moves
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        moves = theta[-4:]
        emit = (theta[:-5][table].sum(1) + theta[-5])[ids]
        a0, a1 = np.zeros((WIDTH, n)), np.zeros((WIDTH, n))
        a1[0] = moves[0] + emit[0]
        for t in range(1, WIDTH):
            a0[t] = np.logaddexp(a0[t - 1], a1[t - 1] + moves[2])
            a1[t] = np.logaddexp(a0[t - 1] + moves[1], a1[t - 1] + moves[3]) + emit[t]
            a0[t], a1[t] = np.where(real[t], a0[t], a0[t - 1]), np.where(real[t], a1[t], a1[t - 1])
        whole = np.logaddexp(a0[-1], a1[-1])
        b0, b1 = np.zeros((WIDTH, n)), np.zeros((WIDTH, n))
        for t in range(WIDTH - 2, -1, -1):
            on = real[t + 1]
            b0[t] = np.where(on, np.logaddexp(b0[t + 1], moves[1] + emit[t + 1] + b1[t + 1]), b0[t + 1])
            b1[t] = np.where(on, np.logaddexp(moves[2] + b0[t + 1], moves[3] + emit[t + 1] + b1[t + 1]), b1[t + 1])
        p = np.exp(a1 + b1 - whole) * real
        grad = np.zeros_like(theta)
        by_word = np.bincount(ids.ravel(), weights=((p - mark) * real).ravel(), minlength=len(table))
        grad[:-5] = np.bincount(table.ravel(), weights=np.repeat(by_word, table.shape[1]), minlength=len(names))
        grad[-5] = by_word.sum()
        grad[-4] = (p[0] - mark[0]).sum()
        both = real[1:]
        for k, (a, add, b, before, after) in enumerate(((a0, moves[1] + emit[1:], b1, 1 - mark[:-1], mark[1:]), (a1, moves[2], b0, mark[:-1], 1 - mark[1:]), (a1, moves[3] + emit[1:], b1, mark[:-1], mark[1:]))):
            grad[-3 + k] = ((np.exp(a[:-1] + add + b[1:] - whole) - before * after) * both).sum()
        grad = grad / n + DECAY * theta
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
        theta = theta - 0.25 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    field.weights = {f: w for f, w in zip(names, theta[:-5].tolist(), strict=True) if abs(w) > 1e-3}
    field.bias, field.moves = float(theta[-5]), theta[-4:].copy()


def _first_of_copies(rows: list[list[str]], signs: int = 8) -> np.ndarray:
    """Which rows share less than half of their word signatures with an earlier one: near copies would make every word
    of a copied toxic text look toxic."""
    odd = mix(np.arange(1, signs + 1, dtype=np.uint64)) | U64(1)
    seen: dict[tuple[int, int], int] = {}
    keep = np.ones(len(rows), bool)
    with np.errstate(over="ignore"):
        for i, tokens in enumerate(rows):
            if not tokens:
                continue
            h = mix(np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in set(tokens)], np.uint64))
            marks = list(enumerate(mix(h[:, None] * odd).min(axis=0).tolist()))
            met = Counter(seen[m] for m in marks if m in seen)
            keep[i] = not met or max(met.values()) < signs / 2
            if keep[i]:
                for m in marks:
                    seen.setdefault(m, i)
    return keep


def _tied(hot: Counter, cold: Counter, share: float) -> set[str]:
    """Features of toxic rows that have them far more often than the share of toxic rows explains: an exact binomial test of
    each, at most FALSE false discoveries among them (Benjamini and Hochberg's step-up)."""
    known: dict[tuple[int, int], float] = {}
    found = []
    for f, n in hot.items():
        c = cold[f]
        if n >= 3 and c <= max(CLEAN_SHARE * n, n >= 10):  # one clean row is allowed to ten toxic ones
            if (n, c) not in known:
                known[n, c] = upper_tail(n, n + c, share)
            found.append((known[n, c], f))
    found.sort()
    last = max((k for k, (p, _) in enumerate(found, 1) if p <= FALSE * k / max(1, len(hot))), default=0)
    return {f for _, f in found[:last]}


def _learned(rows: list[list[str]], toxic: np.ndarray) -> Field:
    """A field from tokenized rows, without its logistic fit."""
    field, hot, cold = Field(), Counter(), Counter()
    for tokens, x in zip(rows, toxic, strict=True):
        (hot if x else cold).update({f for w in set(tokens) for f in features(w)[:4]})
    tied = _tied(hot, cold, float(toxic.mean()))
    marks = [[int(x and any(f in tied for f in features(w)[:4])) for w in tokens] for tokens, x in zip(rows, toxic, strict=True)]
    _train(field, _windows(rows, marks, np.random.default_rng(7)))
    return field


def _figures(field: Field, rows: list[list[str]]) -> np.ndarray:
    """What the logistic fit sees of each row: one, the largest marginal, and their sum on a log scale."""
    out, i = np.zeros((len(rows), 3)), 0
    while i < len(rows):
        j, size = i, 0
        while j < len(rows) and (j == i or size < PORTION >> 4):
            size += len(rows[j])
            j += 1
        found = field.marginals([np.array([field.emission(w) for w in r], np.float64) for r in rows[i:j]])
        out[i:j] = [[1.0, p.max() if len(p) else 0.0, math.log1p(p.sum())] for p in found]
        i = j
    return out


def fit(sample: list[tuple[str, int]]) -> Field:
    """A field from all (text, toxic) rows, and a logistic fit on every row as a field that has not seen it marks it; which
    half of the rows a row belongs to follows from its words alone."""
    field = Field()
    same: dict[str, str] = {}  # one object for each word, however often it occurs
    rows = [[same.get(w) or same.setdefault(w, w.lower()) for w in TOKEN.findall(t or "")] for t, _ in sample]
    keep = _first_of_copies(rows)
    rows = [r for r, on in zip(rows, keep, strict=True) if on]
    toxic = np.array([x for (_, x), on in zip(sample, keep, strict=True) if on])
    if not len(toxic) or toxic.min() == toxic.max():
        share = float(toxic.mean()) if len(toxic) else 0.0
        field.logistic[0] = math.log((share + 1e-12) / (1 - share + 1e-12))
        return field
    half = np.array([zlib.crc32(" ".join(r).encode("utf-8", "surrogatepass")) % FOLDS for r in rows])
    x, y = np.zeros((len(rows), 3)), toxic.astype(float)
    for k in range(FOLDS):
        seen, own = np.flatnonzero(half != k), np.flatnonzero(half == k)
        if len(own):
            x[own, 0] = 1.0
        if len(own) and len(seen) and toxic[seen].min() < toxic[seen].max():
            x[own] = _figures(_learned([rows[i] for i in seen], toxic[seen]), [rows[i] for i in own])
    field = _learned(rows, toxic)
    w, ridge = np.zeros(3), np.array([1e-9, RIDGE, RIDGE])  # the intercept is free
    for _ in range(40):  # Newton steps on the penalised likelihood
        q = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = (x * (q * (1 - q))[:, None]).T @ x + np.diag(ridge + 1e-9)
        w = w - np.linalg.solve(h, x.T @ (q - y) + ridge * w)
    field.logistic = w
    return field


def _scored(field, with_spans: bool):
    def run(batches):
        model = field.value
        emission = model.emission
        names = ["doc_id", "held_out", "score", "predicted", "spans"]
        kinds = [pa.int64(), pa.bool_(), pa.float64(), pa.int32(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))]
        for batch in batches:
            texts, i = batch.column("text").to_pylist(), 0
            ids, held = batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist()
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size < PORTION):
                    size += len(texts[j] or "")
                    j += 1
                found = model.marginals([np.array([emission(w) for w in TOKEN.findall(t or "")], np.float64) for t in texts[i:j]])
                rows = []
                for doc, h, text, p in zip(ids[i:j], held[i:j], texts[i:j], found, strict=True):
                    s = model.score(p)
                    rows.append([doc, h, s, int(s >= 0.7)])
                    if with_spans:
                        hot = {int(k): float(p[k]) for k in np.flatnonzero(p >= 0.5)}
                        rows[-1].append([{"start": m.start(), "end": m.end(), "p": hot[k]} for k, m in enumerate(TOKEN.finditer(text or "")) if k in hot] if hot else [])
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=False)], names=names[: len(cols)])
                i = j

    return run


def draw(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, toxic: int = TOXIC, clean: int = CLEAN) -> list[tuple[str, int]]:
    """At most `toxic` + `clean` labelled training rows, by a hash of their id, of at most LONGEST characters each and
    about ROOM in all."""
    known = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(F.coalesce(remainder("doc_id", modulus) != held, F.lit(False)))
    h = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 40))
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    left = {1: int(1.2 * toxic), 0: int(1.2 * clean)}
    drawn = [known.where(F.col("toxic") == x).withColumn("h", h).where(F.col("h") < int((1 << 40) * min(1.0, size / max(1, n.get(x, 0))))).orderBy("h", "doc_id").limit(left[x]) for x, size in ((1, toxic), (0, clean))]
    # At most `left` ids reach every task, and at most twice as many rows the driver, however often an id is repeated.
    rows = docs.select("doc_id", "text", F.coalesce(F.length("text"), F.lit(0)).alias("size")).where(F.col("size") <= LONGEST)
    rows = rows.join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id").withColumn("tie", F.xxhash64("text"))
    rows = rows.orderBy("h", "doc_id", "tie").limit(2 * sum(left.values()))
    total = F.sum("size").over(Window.orderBy("h", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0))  # of these rows alone
    rows = rows.withColumn("total", total).where(F.col("total") <= ROOM).orderBy("h", "doc_id", "tie").select("text", "toxic").toArrow()
    out = []
    for t, x in zip(rows["text"].to_pylist(), rows["toxic"].to_pylist(), strict=True):
        if left[x] > 0:
            left[x] -= 1
            out.append((t, x))
    return out


def score(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, with_spans: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted and, if asked for, spans for each row of docs (doc_id, text)."""
    field = docs.sparkSession.sparkContext.broadcast(fit(draw(docs, labels, modulus, held)))
    out = F.coalesce(remainder("doc_id", modulus) == held, F.lit(False))
    schema = "doc_id long, held_out boolean, score double, predicted int" + ", spans array<struct<start:int,end:int,p:double>>" * with_spans
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), "text").mapInArrow(_scored(field, with_spans), schema)
