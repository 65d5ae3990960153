import collections
import hashlib
import itertools
import math
import os
import random
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from heatlattice.llm import bpe, chat, embeddings, jaccard, langid, lattice, packing, quality, suffix, toxicity
from heatlattice.llm.common import components
from heatlattice.llm.queries import tokenizer_file

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(n))


def texts():
    rng = random.Random(5)
    base = [prose(rng, 120) for _ in range(6)]
    near = base[0].split()
    near[40] = "changed"
    rows = [*base, base[0], base[0], " ".join(near), base[1] + " " + prose(rng, 60), "", None, "  \t\n", "two words", "Two Words", "aé" * 400, base[2][:150] + "é" + base[2][:150], prose(rng, 4000), "x " * 300]
    return [(i + 3, t) for i, t in enumerate(rows)]


def docs(spark, rows=None, extra=""):
    rows = texts() if rows is None else rows
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOC)
    for name in extra.split():
        df = df.withColumn(name, F.lit("clash"))
    return df


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def test_suffix(spark):
    seen, want = set(), {}
    for i, t in texts():
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for at in range(len(raw) - 99):
            if raw[at : at + 100] in seen:
                gone[at : at + 100] = True
            seen.add(raw[at : at + 100])
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone, [0]]).astype(int)) == 1).sum())
        want[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    got = {r[0]: tuple(r)[1:] for r in suffix.deduplicate(docs(spark, extra="doc runs at key")).collect()}
    assert got == want
    assert suffix.deduplicate(docs(spark, [])).count() == 0


def test_suffix_hot_anchor(spark, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", 1)
    test_suffix(spark)


def symbols(raw):
    return np.frombuffer(raw, np.uint8).astype(np.uint16) + 1


@pytest.mark.parametrize("letters", ["ab", "abcd", "abcdefghijklmnopqrstuvwxyz"])
def test_matching_statistics_against_brute_force(letters):
    rng = random.Random(len(letters))
    word = lambda n: "".join(rng.choice(letters) for _ in range(n)).encode()
    for size in (1, 5, 40, 200):
        base = word(size)
        stored = [base, base[: size // 2 + 1] + word(3) + base[size // 2 :], word(size), b"ab" * 30, base]
        asked = [base[::-1], base, word(70), base[size // 3 :] + word(9) + base, b"ab" * 40, b"zz", b"b"]
        index = suffix.RunIndex([symbols(s) for s in stored], np.array([0, 3, 0, 7, 0]))
        assert len(index.starts) == len(index.heads) == len(index.to) == len(index.first_position) <= sum(map(len, stored)) + len(stored)
        joined = b"\0".join(stored) + b"\0"
        by, length, position = index.statistics([symbols(s) for s in asked])
        assert sorted(by.tolist()) == list(range(len(asked)))
        for r, k in enumerate(by.tolist()):
            q = asked[k]
            for i in range(len(q)):
                want = max(n for n in range(len(q) - i + 1) if any(q[i : i + n] in s for s in stored))
                assert length[r, i] == want
                at = int(position[r, i])
                assert not want or joined[at : at + want] == q[i : i + want]


def test_runs_do_not_grow_with_copies():
    text = symbols(prose(random.Random(1), 60).encode())
    one, many = suffix.RunIndex([text]), suffix.RunIndex([text] * 40)
    assert len(many.starts) <= len(one.starts) + 2
    assert len(many.text.words) <= len(one.text.words) + 2


@pytest.mark.parametrize("size", [1, 60, 1 << 20])
def test_marked_windows(monkeypatch, size):
    monkeypatch.setattr(suffix, "INDEX", size)
    rng = random.Random(3)
    core = bytes(rng.randrange(97, 123) for _ in range(32))
    groups = []
    for g in (1, 2, 3, 5, 8, 13):
        left, right = ([bytes(rng.choice(b"ab") for _ in range(68)) for _ in range(4)] for _ in range(2))
        groups.append([(n, rng.choice(left)[68 - n :] + core + rng.choice(right)[:m]) for n, m in ((rng.randint(20, 68), rng.randint(48, 68)) for _ in range(g))])
        groups[-1] = [x for x in groups[-1] if len(x[1]) >= 100]
    hits = iter(suffix.marked_windows(groups))
    found = 0
    for group in groups:
        seen = set()
        for _, raw in group:
            windows = [raw[i : i + 100] for i in range(len(raw) - 99)]
            assert next(hits).tolist() == [w in seen for w in windows]
            found += sum(w in seen for w in windows)
            seen.update(windows)
    assert found


def test_suffix_of_rows_that_share_an_id(spark):
    rng = random.Random(12)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(7, a + b), (7, c + a), (7, c + a), (None, b + c), (None, None), (9, "é" * 300 + a)]
    out = suffix.without_repeats(docs(spark, rows, "runs sig doc")).select("doc_id", "text").collect()
    left = collections.Counter((r["doc_id"], r["text"]) for r in out)
    assert left[None, b + c] == 1 and left[None, None] == 1  # no id comes first
    assert sum(n for (i, _), n in left.items() if i == 7) == 3
    # Of the two texts named 7 one keeps passage a, and equal rows are alike.
    kept = sorted(n for (i, t), n in left.items() if i == 7 and a[2:-2] in t)
    assert kept in ([1], [2])
    assert all(len(t) < 400 for i, t in left if i == 9)


def test_suffix_of_a_very_long_text(spark):
    rng = random.Random(13)
    part = bytes(rng.choice(b"abcdefgh ") for _ in range(1 << 20)).decode()
    text = part + "x" * 70 + part[: 1 << 19] + "y" + part[1 << 19 :]
    row = suffix.deduplicate(docs(spark, [(1, text * 9), (2, part[500:700])])).orderBy("doc_id").collect()
    # All but the first copy goes; what is left of the joints between copies is shorter than a window on each side.
    assert row[0]["n_bytes"] > 18_000_000 and row[0]["n_bytes"] - row[0]["n_removed"] < len(part) + 1000
    assert row[1]["n_removed"] == 200


def test_suffix_hot_windows_are_not_indexed(spark, monkeypatch):
    def refuse(batches):
        for batch in batches:
            assert not batch.num_rows
        yield from ()

    monkeypatch.setattr(suffix, "_indexed", refuse)
    test_suffix_hot_anchor(spark, monkeypatch)


def brute_jaccard(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = words((t or "").lower())
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_jaccard(spark, width, percent):
    rng = random.Random(9)
    rows = texts()
    chain = prose(rng, 100).split()
    for i in range(12):  # a chain whose ends do not link
        rows.append((100 + i, " ".join(chain)))
        chain = chain[4:] + prose(rng, 4).split()
    got = {r[0]: (r[1], r[2]) for r in jaccard.jaccard_components(docs(spark, rows, "n digest"), width, percent).collect()}
    assert got == brute_jaccard(rows, width, percent)
    kept = {r["doc_id"] for r in jaccard.near_duplicates_removed(docs(spark, rows), width, percent).collect()}
    assert kept == {i for i, (_, c) in got.items() if c == i}
    assert jaccard.jaccard_components(docs(spark, [])).count() == 0


def between_sizes(seed, width, size):
    """Texts of size + 2, size + 1 and size shingles, where only neighbours in this list are within the threshold."""
    w = [f"v{seed}w{k}" for k in range(size + width + 2)]
    return " ".join(w[1:]), " ".join(w[1:-1]), " ".join(w[: size + width - 1])


# By these seeds the third text shares one leading token with the first two, the same one, and no other.
@pytest.mark.parametrize(("width", "percent", "size", "seeds"), [(4, 85, 18, (57, 115)), (5, 80, 13, (171, 206))])
def test_jaccard_sizes_between_a_groups_ends(spark, width, percent, size, seeds):
    rows = [(3 * k + j, t) for k, seed in enumerate(seeds) for j, t in enumerate(between_sizes(seed, width, size))]
    want = brute_jaccard(rows, width, percent)
    assert all(want[i] == (size + 2 - i % 3, i - i % 3) for i in want)
    got = {r[0]: (r[1], r[2]) for r in jaccard.jaccard_components(docs(spark, rows), width, percent).collect()}
    assert got == want


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_jaccard_families_at_the_threshold(spark, width, percent):
    """Many families of texts, each of words of its own, whose neighbours lie at the threshold or just beside it."""
    rng = random.Random(width)
    rows, want = [], {}
    for family in range(250):
        size = rng.randint(10, 60)
        text = [f"f{family}w{k}" for k in range(size + width - 1)]
        own = []
        for _ in range(rng.randint(2, 5)):
            own.append((len(rows) + len(own), " ".join(text)))
            drop = (100 - percent) * len(text) // (100 + percent) + rng.randint(-1, 2)  # about what the threshold allows
            drop, side = max(0, drop), rng.randrange(3)
            fresh = [f"f{family}x{rng.randrange(10**6)}" for _ in range(rng.choice([0, drop]) if side else drop)]
            text = text[drop:] + fresh if side != 1 else fresh + text[: len(text) - drop]
        rng.shuffle(own)
        rows += own
        want |= brute_jaccard(own, width, percent)
    assert 50 < sum(c != i for i, (_, c) in want.items()) < len(rows) - 300
    got = {r[0]: (r[1], r[2]) for r in jaccard.jaccard_components(docs(spark, rows), width, percent).collect()}
    assert got == want


def test_jaccard_rows_without_or_with_shared_ids(spark):
    a, b = (prose(random.Random(k), 80) for k in (1, 2))
    rows = [(5, a), (5, b), (8, b), (9, a + " tail"), (None, a), (None, None), (11, ""), (11, "one")]
    got = collections.Counter(tuple(r) for r in jaccard.jaccard_components(docs(spark, rows)).collect())
    assert got == collections.Counter([(5, 77, 5), (5, 77, 5), (8, 77, 5), (9, 78, 5), (None, 77, None), (None, 0, None), (11, 0, 11), (11, 1, 11)])


def test_packing(spark):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    real = Tokenizer.from_file(path)
    rows = [*texts(), (900, "İstanbul ß don't 中文 １２ <|endoftext|> a b É it's"), (900, "again"), (None, "no id"), (901, "a <|endoftext|> b"), (902, "A <|ENDOFTEXT|> <|startoftext|>"), (903, "word " * 500_000)]
    pieces = packing.pack(docs(spark, rows, "task at n ids"), path, with_ids=True).collect()
    assert [p["ids"] for p in pieces if p["doc_id"] == 901] == [[320, 49407, 321, 1]]
    want = collections.Counter((i, tuple(real.encode(t or "", add_special_tokens=False).ids) + (1,)) for i, t in rows)
    stream = [x for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])) for x in p["ids"]]
    assert sum(len(ids) for _, ids in want.elements()) == len(stream)
    got, now = collections.Counter(), []
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] + p["length"] <= 2048 and p["start"] == len(now)
        assert zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"]
        now += p["ids"]
        if len(now) == p["doc_tokens"]:
            got[p["doc_id"], tuple(now)] += 1
            now = []
    assert got == want
    assert packing.pack(docs(spark, []), path).count() == 0


def test_language(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 60, "abcd" if i % 2 else "wxyz"), "aa" if i % 2 else "bb", "s", 1) for i in range(400)]
    rows += [(1000, None, "aa", "s", 1), (1001, "123 !!", None, "s", 1), (1002, "ab cd", None, "s", 1)]
    out = langid.identify(spark.createDataFrame(rows, DOC).withColumn("score", F.lit(1))).collect()
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in out if r["held_out"] and r["doc_id"] < 1000]
    assert held and all(r["lang_pred"] == truth[r["doc_id"]] for r in held)
    assert {r["lang_pred"] for r in out if r["doc_id"] in (1000, 1001)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in out)
    assert langid.identify(spark.createDataFrame([], DOC)).count() == 0
    assert langid.filter_language(spark.createDataFrame(rows, DOC)).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def naive_kneser_ney(top, letters):
    """P(letter | context) straight from the definition, for contexts of up to three letters."""
    levels = {langid.ORDER: top}
    for m in range(langid.ORDER - 1, 0, -1):
        levels[m] = collections.Counter(g[1:] for g in levels[m + 1])
    discount = {}
    for m, counts in levels.items():
        ones, twos = (sum(n == k for n in counts.values()) for k in (1, 2))
        discount[m] = min(0.9, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5

    def p(context, letter):
        m = len(context) + 1
        below = p(context[1:], letter) if context else 1 / (letters + 2)
        after = {g: n for g, n in levels[m].items() if g[:-1] == context}
        if not after:
            return below
        total = sum(after.values())
        return (max(after.get(context + letter, 0) - discount[m], 0) + discount[m] * len(after) * below) / total

    return p


def test_kneser_ney_against_the_definition():
    rng = random.Random(2)
    texts = {"x": prose(rng, 60, "abc"), "y": prose(rng, 60, "bcde")}
    pad = " " * (langid.ORDER - 1)
    counts = {k: collections.Counter((pad + t + " ")[i : i + langid.ORDER] for i in range(len(t) + 1)) for k, t in texts.items()}
    model = langid.Model(counts)
    letters = sorted({c for grams in counts.values() for g in grams for c in g})
    asked = [prose(rng, 12, "abcdez"), "a", "zzz", texts["x"][:40].strip()]
    cross, n = model.entropies(asked)
    for k, name in enumerate(model.languages):
        p = naive_kneser_ney(counts[name], len(letters))
        for context in ("", "a", "ab", " ab", "zz", "bcd"):
            # Two symbols stand for all letters that were never seen.
            assert sum(p(context, c) for c in letters) + 2 * p(context, "?") == pytest.approx(1)
        for i, t in enumerate(asked):
            padded = pad + t + " "
            want = [-math.log(p(padded[j : j + langid.ORDER - 1], padded[j + langid.ORDER - 1])) for j in range(len(t) + 1)]
            assert n[i] == len(want) and cross[i, k] == pytest.approx(sum(want) / len(want), rel=1e-5)


def test_language_without_letters():
    assert langid.normal("² ½ Ⅷ _ 7 %") == "" and langid.normal("x² Ⅷy ½") == "x y" and langid.normal("Ünï-CODE中文!") == "ünï code中文"
    model = langid.Model({"bb": collections.Counter({"  ab": 3}), "aa": collections.Counter({"  ab": 3})})
    assert model.predict(["² ½", "", None, "12 _"]) == [("und", 0.0, True)] * 4
    assert model.predict(["ab"])[0][0] == "aa"  # a tie


def test_every_language_is_learned(spark):
    names = [f"l{k:03d}" for k in range(230)]
    rows = [(3 * i + j, " ".join(["".join(random.Random(name).choices("abcdefghij", k=7))] * 12), name, "s", 1) for i, name in enumerate(names) for j in range(3)]
    rows.append((9999, "x" * 5000, "l000", "s", 1))
    out = langid.identify(spark.createDataFrame([*rows, rows[0]], DOC), room=len(names) * 400).collect()
    truth = {r[0]: r[2] for r in rows}
    seen = collections.Counter((r["doc_id"], r["lang_pred"]) for r in out)
    assert seen[0, "l000"] == 2
    learned = {r["lang_pred"] for r in out}
    assert len(learned) > 220 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in out) > 0.9 * len(out)


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL", 40)
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 8))
    v = [b + s * rng.normal(size=8) for b in base for s in (0, 0.1, 0.3)]
    rows = [(i, [float(np.float32(x)) for x in u]) for i, u in enumerate([*v, v[0], v[0], 2 * v[5]])]
    rows += [(500, None), (501, [0.0] * 8), (502, [1.0, None] + [0.0] * 6), (503, [float("nan")] * 8), (504, [1.0, 2.0]), (505, [2.0, 4.0]), (506, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("key", F.lit(1))
    got = {r[0]: tuple(r)[1:] for r in embeddings.link_components(df).collect()}
    live = {i: np.array([np.float32(x) for x in u], float) for i, u in rows if u and None not in u and np.isfinite(u).all() and any(u)}
    links = {i: {j for j in live if j != i and len(live[i]) == len(live[j]) and live[i] @ live[j] / np.linalg.norm(live[i]) / np.linalg.norm(live[j]) >= 0.9} for i in live}
    label = {i: i for i, _ in rows}
    for _ in range(20):
        for i, near in links.items():
            label[i] = min([label[i], *(label[j] for j in near)])
    assert got == {i: (len(links.get(i, ())), label[i], label[i] == i) for i, _ in rows}
    assert embeddings.link_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_embeddings_at_the_threshold(spark, kind):
    rows = [(1, [8.0, -8.0, 0.0]), (2, [4.0, -5.0, 3.0]), (3, [16.0, -16.0, 0.0]), (4, [0.0, 0.0, 2.0**-70]), (4, [0.0, 0.0, 1.0]), (None, [0.0, 0.0, 1.0])]
    rows += [(100 + i, [math.cos(t), math.sin(t), 0.0]) for i, t in enumerate((2.0, 2.0 + math.acos(0.9) - 1e-3, 2.0 + 2 * math.acos(0.9) + 1e-3))]
    out = embeddings.link_components(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")).collect()
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in out)
    # 72 / 80 is the threshold; 3 equals 1 up to a factor; both rows named 4 link, as separate vectors.
    assert got == [(0, 0, None, None), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 1, 4, True), (4, 1, 4, True), (100, 1, 100, True), (101, 1, 100, False), (102, 0, 102, True)]


@pytest.mark.parametrize("dim", [3, 40])
def test_embeddings_in_cells_against_brute_force(spark, monkeypatch, dim):
    monkeypatch.setattr(embeddings, "CELL", 50)
    monkeypatch.setattr(embeddings, "BLOCK", 30)
    rng = np.random.default_rng(dim)
    base = rng.normal(size=(40, dim))
    v = np.concatenate([base, base[:25] + 0.15 * rng.normal(size=(25, dim)), base[0] + 0.05 * rng.normal(size=(150, dim)), rng.normal(size=(60, dim))])
    rows = [(int(i), v[i].tolist()) for i in rng.permutation(len(v))]
    near = (u := v / np.linalg.norm(v, axis=1)[:, None]) @ u.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(v))
    for _ in range(len(v)):
        label = np.minimum(label, np.where(near, label, len(v)).min(1))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.link_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: (int(near[i].sum()), int(label[i])) for i in range(len(v))}


def test_quality(spark):
    rng = random.Random(4)
    rows = [*texts(), (50, prose(rng, 80) + "\n" + "same line here\n" * 3), (51, "# " * 60), (None, None)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in rows] + [(3, 0, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality.quality(docs(spark, rows, "n_words kept stratum"), labels).collect()}
    for i, t in rows:
        w = words(t)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        count = collections.Counter(grams)
        lines = [x for x in (t or "").split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len({k + o for k, g in enumerate(grams) if count[g] > 1 for o in range(3)}))
        assert tuple(out[i][c] for c in quality.BASE) == want
        assert out[i]["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert out[i]["kept"] == (not out[i]["base_failed"])
    kept = quality.filter_quality(docs(spark, rows), labels)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in out.items() if r["kept"]}


def test_quality_tail(spark):
    from math import comb

    tail = spark.range(1).select(quality.lower_tail(F.lit(3).cast("long"), F.lit(1000).cast("long"), 0.01)).first()[0]
    assert tail == pytest.approx(sum(comb(1000, j) * 0.01**j * 0.99 ** (1000 - j) for j in range(4)), rel=1e-9)


def test_quality_decides_by_certified_cutoffs(spark):
    """A language with many labels uses its cutoffs, one with few does not; both without labels and null are strata, too."""
    rng = random.Random(14)
    rows, labels = [], []
    for i in range(700):
        junk = i % 7 == 0
        lang = "en" if i < 600 else [None, "xx", "yy"][i % 3]
        rows.append((i, prose(rng, 60) + (" #*#*#*#*#*#*#*#*" * 3 if junk else ""), lang, "s", 1))
        labels.append((i, 0 if junk else 1, 0))
    df = spark.createDataFrame([*rows, rows[7]], DOC)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = quality.quality(df, marks).collect()
    assert len(out) == 701
    for r in out:
        assert r["kept"] == (r["doc_id"] >= 600 or r["doc_id"] % 7 != 0)
    assert {r["stratum"] for r in out} == {"en", "", "xx", "yy"}
    assert quality.filter_quality(df, marks).count() == sum(r["kept"] for r in out)
    none = marks.limit(0)
    assert all(r["kept"] != r["base_failed"] for r in quality.quality(df, none).collect())
    assert quality.quality(df.limit(0), marks).count() == 0 and quality.filter_quality(df.limit(0), none).count() == 0


def test_quality_takes_no_cutoff_that_hits_more_good_than_bad(spark):
    stats = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("en").alias("stratum"), F.lit(100).cast("long").alias("n_words"), F.lit(500).cast("long").alias("word_chars"), F.when(F.col("id") % 100 == 0, 100).otherwise(0).cast("long").alias("n_symbols"), F.lit(0).cast("long").alias("n_dup_lines"), F.lit(5).cast("long").alias("n_lines"), F.when(F.col("id") % 400 == 1, 30).otherwise(5).cast("long").alias("n_repeat_words"), F.lit(False).alias("base_failed"))
    labels = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 400 == 1, 0).otherwise(1).alias("quality"))
    cuts = quality.fit_cutoffs(stats, labels).first()
    assert cuts["cut_symbols"] is None and cuts["cut_repeats"] == 200 and cuts["cut_dup_lines"] is None


def test_toxicity(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        w = prose(rng, 40).split()
        if i % 3 == 0:
            w[rng.randrange(40)] = rng.choice(["vileword", "nastyone", "vilething"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 3 == 0)))
    rows += [(2000, None), (2001, "")]
    out = toxicity.score(docs(spark, rows, "score"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), with_spans=True).collect()
    held = [r for r in out if r["held_out"] and r["doc_id"] < 900]
    assert sum(r["predicted"] == int(r["doc_id"] % 3 == 0) for r in held) > 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out)
    text = dict(rows)
    spans = [text[r["doc_id"]][s["start"] : s["end"]] for r in out for s in r["spans"]]
    assert spans and sum(s in ("vileword", "nastyone", "vilething") for s in spans) > 0.9 * len(spans)
    # Offsets count code points of the text as it is, also where a lower-case letter is longer.
    odd = "İİ é🌍 vileword İ"
    field = toxicity.fit([(t, x) for (i, t), (_, _, x) in zip(rows, labels, strict=False)])
    few = spark.createDataFrame([(1, odd), (1, odd), (3, None)], "doc_id long, text string")
    marked = list(toxicity._scored(type("Sent", (), {"value": field}), True)(iter([pa.RecordBatch.from_pydict({"doc_id": [1], "held_out": [True], "text": [odd]})])))[0].to_pylist()[0]
    assert [odd[s["start"] : s["end"]] for s in marked["spans"]] == ["vileword"]
    # A score is the logistic figure of the marginals' sum and maximum, here by enumeration of all taggings.
    words = toxicity.TOKEN.findall(odd)
    p = brute_marginals(field, [field.emission(w) for w in words])
    z = field.logistic @ np.array([1.0, p.max(), math.log1p(p.sum())])
    assert marked["score"] == pytest.approx(1 / (1 + math.exp(-z)))
    double = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in toxicity.score(few, double).collect()] == pytest.approx([1.0] * 3, abs=1e-6)  # the only label says toxic
    assert toxicity.score(few.limit(0), double).count() == 0
    none = toxicity.score(docs(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(none) == len(texts()) and all(r["predicted"] == 0 for r in none)


def brute_marginals(field, e):
    total, one = 0.0, np.zeros(len(e))
    start, up, down, stay = field.moves
    for y in itertools.product((0, 1), repeat=len(e)):
        z = sum(a * b for a, b in zip(y, e, strict=True)) + (start * y[0] if y else 0)
        z += sum({(0, 1): up, (1, 0): down, (1, 1): stay}.get(s, 0) for s in zip(y, y[1:], strict=False))
        total += np.exp(z)
        one += np.exp(z) * np.array(y)
    return one / total


def test_marginals_against_enumeration():
    field = toxicity.Field()
    field.moves = np.array([-0.5, 0.3, -0.2, 0.7])
    rng = np.random.default_rng(0)
    rows = [rng.normal(size=n) for n in (4, 0, 1, 6)]
    for e, p in zip(rows, field.marginals(rows), strict=True):
        assert p == pytest.approx(brute_marginals(field, e))


def test_field_gradient_climbs():
    """The fit gives marked words higher marginals than others, also those it has only seen by their beginning."""
    rng = random.Random(5)
    windows = [(w := prose(rng, 8).split() + ["vileword"] * (i % 2), [int(x == "vileword") for x in w]) for i in range(60)]
    field = toxicity.Field()
    toxicity._train(field, windows)
    p = field.marginals([np.array([field.emission(x) for x in ("abc", "vileword", "vileworks", "dd")])])[0]
    assert p[1] > 0.9 and p[1] > p[2] > p[0] and p[3] < 0.1


def test_bpe(spark):
    import public_tokenizers
    import tiktoken

    path = tokenizer_file("byte_bpe_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    real = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(0)
    rows = [*texts(), *((1000 + k, "".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0xA0, 0x24F), rng.randint(0x4E00, 0x4E80), rng.randint(0x1F300, 0x1F5FF)])) for _ in range(rng.randint(1, 80)))) for k in range(60)), (1, "a" * 70000), (2, "".join(rng.choice("abet ") for _ in range(40000)).replace(" ", ""))]
    got = {r["doc_id"]: r for r in bpe.encode(docs(spark, rows, "ids"), path, public_tokenizers.PATTERN, with_ids=True).collect()}
    for i, t in rows:
        assert got[i]["ids"] == real.encode_ordinary(t or "")
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode(docs(spark, []), path, public_tokenizers.PATTERN).count() == 0


def test_utf8_machine():
    rng = random.Random(1)
    edges = b"\x00\x7f\x80\x8f\x90\x9f\xa0\xbf\xc0\xc1\xc2\xdf\xe0\xe1\xec\xed\xee\xef\xf0\xf1\xf3\xf4\xf5\xff"
    raws = ["aé中🌍z\x00".encode() + b"\xff\xe4\xb8"] + [bytes(rng.choice(edges) for _ in range(rng.randrange(9))) for _ in range(4000)]
    decoder = bpe.Decoder([bytes([b]) for b in range(256)] + ["é".encode(), b"\xa9 \xf0"])
    for raw in raws:
        for cut in range(1, 5):
            machine = bpe.Utf8Machine()
            assert "".join(machine.feed(raw[i : i + cut]) for i in range(0, len(raw), cut)) + machine.finish() == raw.decode("utf-8", "replace")
    for _ in range(3000):
        ids = array("I", [rng.choice([rng.randrange(258), 0xC3, 256, 257]) for _ in range(rng.randrange(9))])
        raw = b"".join(decoder.bytes_of[t] for t in ids)
        assert "".join(decoder.chunks(ids, rng.randint(1, 4))) == raw.decode("utf-8", "replace")


def test_chat(spark, monkeypatch):
    rows = [(1, 0, "user", "a<|im_end|>\n<|im_start|>x"), (1, 1, "assistant", r"<\|<\\|é"), (1, 1, "assistant", r"<\|<\\|é"), (2, 5, "sys\ntem\\", None), (2, None, None, ""), (None, 0, "assistant", "x" * 5000)]
    df = chat.planted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)))
    got = {r["conv_id"]: r for r in chat.digests(df).collect()}
    full = [*rows, (-1, 0, "user", chat.PLANTED), (-1, 1, "assistant", chat.PLANTED)]
    for conv in {r[0] for r in full}:
        turns = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in full if c == conv))
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(df.limit(0)).count() == 0
    # A conversation beyond several portions, with clashing columns.
    monkeypatch.setattr(chat, "PORTION", 1 << 12)
    turns = [(7, k, "assistant" if k % 2 else "user", "<|é" * 9000 + str(k)) for k in range(60)]
    long = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({"loss_start": F.lit("x"), "lang": F.lit("en")})
    row = chat.digests(long).first()
    loss = "".join(t[3] for t in turns if t[2] == "assistant")
    assert (row["n_turns"], row["loss_chars"], row["loss_sha256"]) == (60, len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_lattice(spark):
    path = tokenizer_file("piece_bpe_32k.model")
    rows = [*texts(), (700, "É 中 " + "q" * 200), (None, "the end")]
    got = lattice.score(docs(spark, rows, "line known"), path, head=20).collect()
    train = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    c = collections.Counter(w for t in train for w in words(low(t)))
    n, v = sum(c.values()) + len(train), len(c) + 1
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for i, t in rows:
        w = words(low(t))
        base = sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w) + np.log10((len(train) + 1) / (n + v + 1))
        r = by_id[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w) + 1, sum(c[x] > 0 for x in w) + 1, n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert np.isfinite(r["score"]) and r["score"] < 0
    assert lattice.score(docs(spark, []), path).count() == 0


def segmentations(pieces, weight, raw):
    """The sum over all ways to spell raw in pieces."""
    if not raw:
        return 1.0
    out, node = 0.0, 0
    for k, b in enumerate(raw):
        node = int(pieces.child[node, b])
        if not node:
            break
        if pieces.token[node] >= 0:
            out += np.exp(weight[node]) * segmentations(pieces, weight, raw[k + 1 :])
    return out


def test_lattice_score_against_enumeration(spark):
    path = tokenizer_file("piece_bpe_32k.model")
    pieces = lattice._pieces(path)
    rows = [(i, t) for i, t in enumerate(["the end", "the the of", "over it", "", None, "new word", "It IS", "zq"] * 3)]
    rows += [(50, rows[0][1]), (50, "over")]
    train = [t or "" for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    count = collections.Counter(w for t in train for w in t.lower().split())
    # Two rounds of expectations, each by enumeration of every word's segmentations.
    logp = pieces.first
    for _ in range(2):
        weight = pieces.weights(logp)
        got = np.where(np.isfinite(pieces.first), lattice.FLOOR, 0.0)
        for word, n in count.items():
            raw = lattice.MARK + word.encode()
            total = segmentations(pieces, weight, raw)
            for a in range(len(raw)):
                node = 0
                for b in range(a, len(raw)):
                    node = int(pieces.child[node, raw[b]])
                    if not node:
                        break
                    for token in (pieces.token[node], pieces.second[node]):
                        if token >= 0:
                            got[token] += n * segmentations(pieces, weight, raw[:a]) * np.exp(logp[token]) * segmentations(pieces, weight, raw[b + 1 :]) / total
        got[pieces.n] += len(train)
        with np.errstate(divide="ignore"):
            logp = np.log(got / got.sum())
    weight = pieces.weights(logp)
    out = collections.defaultdict(list)
    for r in lattice.score(docs(spark, rows), path, head=3).collect():
        out[r["doc_id"]].append(r["score"])
    want = collections.defaultdict(list)
    for i, t in rows:
        want[i].append((sum(np.log(segmentations(pieces, weight, lattice.MARK + w.encode())) for w in (t or "").lower().split()) + logp[-1]) / np.log(10))
    assert {i: sorted(x) for i, x in out.items()} == {i: pytest.approx(sorted(x), rel=1e-9) for i, x in want.items()}


def test_lattice_marginal_against_enumeration():
    pieces = lattice._pieces(tokenizer_file("piece_bpe_32k.model"))
    weight = pieces.weights(pieces.first)

    spelled = [lattice.MARK + w for w in (b"the", b"over", b"\xff", b"")]
    assert lattice.marginals(pieces, weight, spelled) == pytest.approx([np.log(segmentations(pieces, weight, s)) for s in spelled])
    long = lattice.MARK + b"word" * 20
    assert lattice.marginals(pieces, weight, [long])[0] == pytest.approx(lattice._long(pieces, weight, long, None, None))


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)]
    label = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: label[x] for e in edges for x in e if e[0] != e[1]}


def test_components_raises_when_rounds_run_out(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError, match="1 rounds"):
        components(chain, "a", "b", rounds=1)


def test_pipeline(spark, tmp_path):
    """The five stages against plain versions of what they decide: base rules, language, near duplicates, repeats, ids."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = random.Random(6)
    own = DOC + ", runs string, n int, row string"
    rows = [(i, prose(rng, 150), "en", "s", 1) for i in range(40)]
    rows += [(100, rows[0][1], "en", "s", 1), (101, rows[1][1] + " " + prose(rng, 150), "en", "s", 1), (102, "short", "en", "s", 1), (103, None, None, None, None)]
    rows += [(104, prose(rng, 60_000), "en", "s", 1), (105, "12 ² 34 " * 60, "en", "s", 1), (106, rows[5][1], "en", "s", 1), (106, prose(rng, 200), None, "s", 1)]
    spark.createDataFrame([(*r, "clash", 7, "clash") for r in rows], own).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    real = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    left = [(i, t) for i, t, *_ in rows if len(words(t)) >= 50 and any(c.isalpha() for c in t)]
    # The two rows named 106 are one node: one is a copy of row 5, so both go.
    left = [(i, t) for i, t in left if i not in (100, 106)]
    seen, want = set(), collections.Counter()
    for i, t in sorted(left):
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for at in range(len(raw) - 99):
            if raw[at : at + 100] in seen:
                gone[at : at + 100] = True
            seen.add(raw[at : at + 100])
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        want[i, len(real.encode(kept, add_special_tokens=False).ids) + 1] += 1
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter((r["doc_id"], r["doc_tokens"]) for r in out if r["start"] == 0) == want
    assert sum(r["length"] for r in out) == sum(n for _, n in want.elements())
    (tmp_path / "none").mkdir()
    spark.createDataFrame([], own).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_staged_tables_go(spark):
    from heatlattice.storage import discard, staged

    df = staged(spark.range(5), "numbers")
    path = df._staged_path.removeprefix("file:")
    assert os.path.isdir(path) and df.count() == 5
    discard(df)
    assert not os.path.exists(path)
