"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of the letters (category L) that follow the last ORDER - 1 (lower case; runs of other characters are one
space). The models are fitted on a bounded sample of labelled rows, `sample` texts a language, and kept as one sorted array
of n-gram hashes for each order with a row of log probabilities, one for each language, and as sorted arrays of contexts
with their back-off weights. A text is scored at every character; the language of the lowest cross-entropy per character
is the prediction. Further rows of the sample calibrate: the temperature of the score, and for each language the
conformal quantile of cross-entropy beyond which `rejected` is true.

Defined cases: a null text or one without a letter is `und` with score 0 and rejected; ties go to the first language in
code-point order; without any training row every text is `und`; empty tables give empty results; repeated rows are
predicted one by one; texts are read whole; lang, source and doc_id are no inputs of a prediction.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, mix, remainder

ORDER, SAMPLE, CALIBRATION = 4, 400, 400
#: Characters of all texts that are learned from, and of those of one language at most.
ROOM, OWN_ROOM = 1 << 28, 1 << 24
EPSILON, SLACK = 0.001, 1.1
PORTION = 1 << 19
_GAP = re.compile(r"[\W\d_]+")


def normal(text: str | None) -> str:
    """Lower-case letters (category L) with one space between runs of them."""
    plain = _GAP.sub(" ", (text or "").lower()).strip()
    if plain.isascii() or plain.replace(" ", "").isalpha():
        return plain
    return " ".join("".join([c if c.isalpha() else " " for c in plain]).split())


def in_portions(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Runs of texts that end where they reach PORTION characters."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= PORTION:
            yield part
            part, size = [], 0
    if part:
        yield part


def gram_hashes(codes: np.ndarray) -> list[np.ndarray]:
    """For each order from 1, the hash of the n-gram that ends at each position."""
    out = [mix(codes.astype(np.uint64) + U64(1))]
    for m in range(1, ORDER):
        before = np.zeros(len(codes), np.uint64)
        before[m:] = codes[:-m] if m else codes
        out.append(mix(out[-1] * U64(0x9FB21C651E98DF25) + before))
    return out


class Model:
    """languages, and for each order the sorted hashes of its grams with log probabilities, and of contexts with weights."""

    def __init__(self, counts: dict[str, Counter]) -> None:
        self.languages = sorted(counts)
        self.temperature, self.limits = 1.0, [float("inf")] * len(self.languages)
        letters = {c for k in counts.values() for g in k for c in g}
        self.floor = -np.log(len(letters) + 2.0)
        levels = [self._levels(counts[x]) for x in self.languages]
        self.grams, self.probs, self.contexts, self.weights = [], [], [], []
        lower: list[dict[str, float]] = [{} for _ in self.languages]
        for m in range(1, ORDER + 1):
            union = sorted({g for lv in levels for g in lv[m - 1]})
            probs = np.empty((len(union), len(self.languages)))
            heads: dict[str, list[float]] = {}
            now: list[dict[str, float]] = []
            for k, lv in enumerate(levels):
                own = lv[m - 1]
                total, kinds = Counter(), Counter()
                for g, n in own.items():
                    total[g[:-1]] += n
                    kinds[g[:-1]] += 1
                ones, twos = sum(n == 1 for n in own.values()), sum(n == 2 for n in own.values())
                d = min(0.9, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5
                for c, n in total.items():
                    heads.setdefault(c, [1.0] * len(self.languages))[k] = d * kinds[c] / n
                table: dict[str, float] = {}
                for r, g in enumerate(union):
                    c = g[:-1]
                    below = lower[k].get(g[1:], None) if m > 1 else np.exp(self.floor)
                    if below is None:
                        below = self._backed_off(k, g[1:], m - 1)
                    n = total.get(c, 0)
                    p = (max(own.get(g, 0) - d, 0) + d * kinds[c] * below) / n if n else below
                    probs[r, k] = table[g] = p
                now.append(table)
            lower = now
            self._tables = getattr(self, "_tables", [])
            self._tables.append((now, heads))
            hashes = self._hash(union, m)
            order = np.argsort(hashes)
            self.grams.append(hashes[order])
            self.probs.append(np.log(probs[order]).astype(np.float32))
            if m > 1:
                names = sorted(heads)
                hashes = self._hash(names, m - 1)
                order = np.argsort(hashes)
                self.contexts.append(hashes[order])
                self.weights.append(np.log(np.array([heads[c] for c in names]).reshape(len(names), len(self.languages))[order]).astype(np.float32))
            else:
                self.top = np.log(np.array(heads.get("", [1.0] * len(self.languages))))
        del self._tables

    def _backed_off(self, k: int, gram: str, m: int) -> float:
        """The probability of a gram that is in no language's table of order m."""
        if m == 0:
            return float(np.exp(self.floor))
        table, heads = self._tables[m - 1]
        if gram in table[k]:
            return table[k][gram]
        weight = heads.get(gram[:-1], [1.0] * len(self.languages))[k]
        return weight * self._backed_off(k, gram[1:], m - 1)

    @staticmethod
    def _levels(top: Counter) -> list[Counter]:
        """Counts for the highest order, for the others in how many ways a gram is continued to the left."""
        out = [top]
        for _ in range(ORDER - 1):
            out.append(Counter(g[1:] for g in out[-1]))
        return out[::-1]

    @staticmethod
    def _hash(grams: list[str], m: int) -> np.ndarray:
        if not grams:
            return np.zeros(0, np.uint64)
        codes = np.array([[ord(c) for c in g] for g in grams], np.uint64)
        with np.errstate(over="ignore"):
            h = mix(codes[:, -1] + U64(1))
            for k in range(1, m):
                h = mix(h * U64(0x9FB21C651E98DF25) + codes[:, -1 - k])
        return h

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character for each (normal text, language), and the characters counted."""
        pad = " " * (ORDER - 1)
        joined = np.frombuffer((pad + "".join([t + pad for t in texts])).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(t) for t in texts], np.int64)
        starts = ORDER - 1 + np.concatenate([[0], np.cumsum(lengths + ORDER - 1)[:-1]]) if len(texts) else np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            hashes = gram_hashes(joined)
        used = np.zeros(len(joined) + 1, np.int8)
        used[starts] += 1
        used[starts + lengths + 1] -= 1  # one space behind each text counts
        at = np.flatnonzero(np.cumsum(used[:-1]))
        score = np.zeros((len(at), len(self.languages)), np.float32)
        open_ = np.arange(len(at))
        for m in range(ORDER, 0, -1):
            keys, want = self.grams[m - 1], hashes[m - 1][at[open_]]
            spot = np.searchsorted(keys, want)
            spot[spot == len(keys)] = 0
            hit = keys[spot] == want if len(keys) else np.zeros(len(want), bool)
            score[open_[hit]] += self.probs[m - 1][spot[hit]]
            open_ = open_[~hit]
            if not len(open_):
                break
            if m > 1:
                keys, want = self.contexts[m - 2], hashes[m - 2][at[open_] - 1]
                spot = np.searchsorted(keys, want)
                spot[spot == len(keys)] = 0
                hit = keys[spot] == want if len(keys) else np.zeros(len(want), bool)
                score[open_[hit]] += self.weights[m - 2][spot[hit]]
            else:
                score[open_] += (self.top + self.floor).astype(np.float32)
        n = lengths + 1
        firsts = np.concatenate([[0], np.cumsum(n)[:-1]])
        sums = np.add.reduceat(score.astype(np.float64), firsts, axis=0) if len(texts) else np.zeros((0, len(self.languages)))
        return -sums / n[:, None], n

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        plain = [normal(t) for t in texts]
        out: list[tuple[str, float, bool]] = [("und", 0.0, True)] * len(texts)
        full = [i for i, t in enumerate(plain) if t]
        if not full or not self.languages:
            return out
        cross, n = self.entropies([plain[i] for i in full])
        best = np.argmin(cross, axis=1)
        p = self.shares(cross, n)
        for i, k, c, q in zip(full, best.tolist(), cross[np.arange(len(full)), best].tolist(), p.max(axis=1).tolist(), strict=True):
            out[i] = (self.languages[k], min(1.0, q), c > self.limits[k])
        return out

    def shares(self, cross: np.ndarray, n: np.ndarray) -> np.ndarray:
        z = -cross * (self.temperature * np.minimum(n, 400))[:, None]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def calibrate(self, rows: list[tuple[str, str]]) -> None:
        """Temperature by likelihood and limits by conformal quantiles, from (text, language)."""
        rows = [(normal(t), x) for t, x in rows if normal(t)]
        if not rows:
            return
        parts = [self.entropies(part) for part in in_portions([t for t, _ in rows])]
        cross, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        truth = np.array([self.languages.index(x) for _, x in rows])

        def loss(t: float) -> float:
            self.temperature = t
            return float(-np.log(np.maximum(self.shares(cross, n)[np.arange(len(rows)), truth], 1e-12)).mean())

        self.temperature = min((0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0), key=loss)
        best = np.argmin(cross, axis=1)
        for k in range(len(self.languages)):
            own = np.sort(cross[(best == k) & (truth == k), k])
            rank = int(np.ceil((len(own) + 1) * (1 - EPSILON)))
            if len(own) >= 30:
                self.limits[k] = float(own[min(rank, len(own)) - 1]) * SLACK


def fit(docs: DataFrame, sample: int = SAMPLE, calibration: int = CALIBRATION, room: int = ROOM) -> Model:
    """A model of every lang value in rows of (doc_id, text, lang).

    At most `sample` + `calibration` texts a language, and about `room` characters in all, come to the driver: each
    language has an equal part of the room, at most OWN_ROOM, and texts longer than that part are not learned from.
    The languages themselves are gathered, as the model has a column for each."""
    spark = docs.sparkSession
    known = docs.where("lang is not null and text is not null")
    sizes = known.groupBy("lang").count().collect()
    if not sizes:
        return Model({})
    want, part = sample + calibration, min(OWN_ROOM, room // len(sizes))
    # A share of each language's rows by a hash of the id, then an exact bound on those few.
    shares = spark.createDataFrame([(r["lang"], min(1.0, 1.5 * want / r["count"] + 20 / r["count"])) for r in sizes], "lang string, share double")
    drawn = known.where(F.length("text") <= part).join(F.broadcast(shares), "lang")  # a row for each language
    drawn = drawn.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_000)) < F.col("share") * 1_000_000)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit("order")), "doc_id", F.xxhash64("text"))
    ranked = drawn.withColumns({"k": F.row_number().over(order), "total": F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    rows = ranked.where((F.col("k") <= want) & (F.col("total") <= part)).select("lang", "k", "text").toArrow()
    counts: dict[str, Counter] = defaultdict(Counter)
    held, pad = [], " " * (ORDER - 1)
    for lang, k, text in zip(*(rows[c].to_pylist() for c in ("lang", "k", "text")), strict=True):
        if k % 2 and normal(text):
            t = pad + normal(text) + " "
            counts[lang].update([t[i : i + ORDER] for i in range(len(t) - ORDER + 1)])
        elif k % 2 == 0:
            held.append((text, lang))
    model = Model(counts)
    model.calibrate([(t, x) for t, x in held if x in counts])
    return model


def _predicted(model):
    def run(batches):
        for batch in batches:
            found = [x for part in in_portions(batch.column("text").to_pylist()) for x in model.value.predict(part)]
            lang, score, rejected = zip(*found, strict=True) if found else ((), (), ())
            keep = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[*batch.schema.names[:-1], "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, modulus: int = 4, held: int = 2, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for each row of docs (doc_id, text, lang)."""
    out = F.coalesce(remainder("doc_id", modulus) == held, F.lit(False))
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.select("doc_id", "text", "lang").where(~out), **options))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), "text")
    return slim.mapInArrow(_predicted(model), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def filter_language(docs: DataFrame, modulus: int = 4, held: int = 2, **options) -> DataFrame:
    """The rows of docs that are not rejected, with docs' own columns."""
    out = F.coalesce(remainder("doc_id", modulus) == held, F.lit(False))
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.select("doc_id", "text", "lang").where(~out), **options))
    own = docs.schema

    def run(batches):
        for batch in batches:
            part = pa.RecordBatch.from_arrays([batch.column("text")], names=["text"])
            for found in _predicted(model)(iter([part])):
                yield batch.filter(pa.array([not r for r in found.column("rejected").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, own)
