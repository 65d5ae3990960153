import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from heatlattice.llm import alignment, embeddings, packing, squares, toxicity, variants
from heatlattice.llm.byte_tokens import ByteTokenizer
from heatlattice.llm.queries import table, tokenizer_file

BYTES, PIECES = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")


def frame(spark, rows, extra=""):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in extra.split():
        df = df.withColumn(name, F.lit("clash"))
    return df


def texts():
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(n))
    base = ["The cat sat.", "", None, "  two  spaces\n\n\tand tabs ", "a <s> b </s> <unk> <|endoftext|> c", "mark ▁ inside", "naïve façade — “quoted” 12345", "日本語 text \U0001f600\r\nnext;\r", "x" * 3000, " " * 1500 + "after", "\x00nul\x1c\x85", "é ﬁ fi  nbsp", "The cat sat."]
    return [(i, t) for i, t in enumerate(base)] + [(50 + i, prose(rng.randint(1, 700))) for i in range(12)] + [(None, "no id"), (3, "again three"), (70, prose(9000))]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_ids_are_the_librarys(text):
    if not hasattr(test_ids_are_the_librarys, "made"):
        plain = Tokenizer.from_file(BYTES)
        plain.encode_special_tokens = True
        test_ids_are_the_librarys.made = ByteTokenizer(BYTES, False), plain
    own, library = test_ids_are_the_librarys.made
    assert own.fast
    assert list(own.ids(text)) == library.encode(text, add_special_tokens=False).ids


def test_ids_of_given_texts(spark, sf="/root/testdata/sf0.001"):
    library, own = Tokenizer.from_file(BYTES), ByteTokenizer(BYTES, True)
    for text in [r["text"] or "" for r in table(spark, sf, "documents").select("text").collect()] + [t or "" for _, t in texts()]:
        assert list(own.ids(text)) == library.encode(text, add_special_tokens=False).ids


def graph_groups(a, b):
    """Components of overlapping byte ranges by plain search: lists of indices of a and b."""
    ranges = lambda n: [(i - k, i) for i, k in zip(itertools.accumulate(n), n)]
    ra, rb = ranges(a), ranges(b)
    near = collections.defaultdict(set)
    for i, (s, e) in enumerate(ra):
        for j, (u, v) in enumerate(rb):
            if s < v and u < e:
                near["a", i].add(("b", j))
                near["b", j].add(("a", i))
    seen, out = set(), []
    for i in range(len(ra)):
        if ("a", i) not in seen:
            todo, found = [("a", i)], {("a", i)}
            while todo:
                for x in near[todo.pop()] - found:
                    found.add(x)
                    todo.append(x)
            seen |= found
            out.append((sorted(k for s, k in found if s == "a"), sorted(k for s, k in found if s == "b")))
    return out, ra, rb


@pytest.mark.parametrize("links", ["ends", "overlaps"])
def test_alignment_against_graph_search(spark, monkeypatch, links):
    monkeypatch.setattr(alignment, "PORTION", 900)
    monkeypatch.setattr(alignment, "BLOCK", 2500)
    library, pieces = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    library.encode_special_tokens = True
    letters = {c: b for b, c in enumerate(packing._byte_letters())}
    per, count = [], collections.Counter()
    rows = [(i, t) for i, t in texts() if not t or len(t) < 5000]
    for i, t in rows:
        a = library.encode(" " + t, add_special_tokens=False).ids if t else []
        b = pieces.encode(t) if t else []
        sa = [bytes(letters[c] for c in library.id_to_token(x)) for x in a]
        sb = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(pieces.id_to_piece, b)]
        if b"".join(sa) != b"".join(sb) or not t or b"".join(sa) != (" " + t).encode():
            a, b, sa, sb = [], [], [], []
        found, ra, rb = graph_groups([len(x) for x in sa], [len(x) for x in sb])
        if links == "ends":
            linked = [(a[x], b[y]) for x in range(len(a)) for y in range(len(b)) if ra[x][1] == rb[y][1]]
        else:
            linked = [(a[x], b[y]) for x in range(len(a)) for y in range(len(b)) if ra[x][0] < rb[y][1] and rb[y][0] < ra[x][1]]
        text = ";".join(",".join(str(a[x]) for x in g) + "|" + ",".join(str(b[y]) for y in h) for g, h in found)
        count.update(linked)
        per.append((i, len(a), len(b), len(found), linked, hashlib.sha256(text.encode()).hexdigest() if a else ""))
    assert dict(rows)[5] and per[5][1:4] == (0, 0, 0)  # the mark itself is not spelled out
    most = collections.defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    want = [(i, x, y, g, len(k), sum(count[p] == most[p[1]] for p in k), sum(count[p] for p in k), h) for i, x, y, g, k, h in per]
    out = alignment.align(frame(spark, rows, "block place pair n count top links").repartition(3), BYTES, PIECES, links)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert collections.Counter(map(tuple, out.collect())) == collections.Counter(want)
    assert alignment.align(frame(spark, []), BYTES, PIECES, links).count() == 0


def test_union_find():
    rng = np.random.default_rng(1)
    u, v = rng.integers(0, 400, 300), rng.integers(0, 400, 300)
    u, v = np.concatenate([u, np.arange(400, 600)]), np.concatenate([v, np.arange(401, 601)])
    label = list(range(601))
    for _ in range(601):
        before = list(label)
        for a, b in zip(u.tolist(), v.tolist()):
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    assert alignment.union_find(601, u, v).tolist() == label


@pytest.mark.parametrize("shard", [20, 1 << 14])
def test_best_fit_pieces(spark, shard):
    library = Tokenizer.from_file(BYTES)
    rows, window = texts(), 64
    want = collections.Counter()
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % window
        starts = [*([0] if first else []), *range(first, len(ids), window)]
        for k, (s, e) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want[i, k, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())] += 1
    out = squares.pack_best_fit(frame(spark, rows, "shard deal row task piece").repartition(3), BYTES, window, shard).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    held = collections.defaultdict(list)
    for r in out:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    assert squares.pack_best_fit(frame(spark, []), BYTES).count() == 0


def test_sum_of_squares_places_as_defined():
    rng = random.Random(2)
    for eager in (False, True):
        sizes = [rng.randint(1, 16) for _ in range(150)]
        bins = []
        for s in sizes:
            def total(bins):
                return sum(n * n for n in collections.Counter(g for g in bins if g).values())
            tried = [(total(bins[:k] + [g - s] + bins[k + 1 :]), g, k) for k, g in enumerate(bins) if g >= s]
            new = total([*bins, 16 - s])
            if tried and not (eager and min(tried)[0] > new):
                bins[min(tried)[2]] -= s
            else:
                bins.append(16 - s)
        sequence, offset, n = squares.sum_of_squares(np.array(sizes), 16, eager)
        left = np.full(n, 16)
        for q, o, s in zip(sequence, offset, sizes):
            assert left[q] == 16 - o
            left[q] -= s
        assert sorted(left.tolist()) == sorted(bins)


def test_best_fit_wastes_little():
    rng = np.random.default_rng(4)
    for sizes in (rng.integers(1, 2048, 8000), rng.integers(100, 600, 8000), np.minimum(rng.geometric(1 / 500, 8000), 2047)):
        found = min(squares.sum_of_squares(np.sort(sizes)[::-1], 2048, False)[2], squares.sum_of_squares(sizes, 2048, True)[2])
        least = max(-(-int(sizes.sum()) // 2048), int((sizes > 1024).sum()))
        assert found <= 1.01 * least


def edits(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows, least_chars, slip):
    count = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_chars:
                count[run] += 1
    n = {w: k for w, k in count.items() if k >= 2}
    near = {w: [x for x in n if edits(w, x)] for w in n}
    best = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: best[w] if best[w] and n[best[w]] >= 10 * n[w] else None for w in n}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


@pytest.mark.parametrize("seed", range(3))
def test_variants_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    core = ["".join(rng.choice("abÉé÷×") for _ in range(rng.randint(3, 7))) for _ in range(14)] + ["aaaa", "aaaaa", "aaa", "abab", "baba"]
    words = []
    for w in core:
        words += [w] * rng.choice([2, 3, 30, 400])
        for _ in range(12):
            v, k = list(w), rng.randrange(len(w) + 1)
            rng.choice([lambda: v.insert(k, rng.choice("abé")), lambda: v.pop(min(k, len(v) - 1)), lambda: v.__setitem__(min(k, len(v) - 1), rng.choice("abcÉ"))])()
            words += ["".join(v)] * rng.choice([1, 2, 2, 3, 40])
    rng.shuffle(words)
    rows = [(i % 30 if i % 31 else None, " ".join(words[k : k + 40]).replace("b", rng.choice("bB")) + rng.choice(["", "1", ","])) for i, k in enumerate(range(0, len(words), 40))]
    rows += [(1, None), (2, ""), (3, "z" * 50_000 + " " + "z" * 50_000)]
    if seed == 2:
        rows += [(4, "level " * 5 + "levels " * 60 + "levelss " * 700 + "levelsss " * 8000)]
    want = plain_variants([(i, t) for i, t in rows], 3, 31)
    out = variants.variants(frame(spark, rows, "word n node next rest"), least_chars=3)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want
    assert any(f and r != f for _, f, r, *_ in want) or seed < 2
    assert variants.variants(frame(spark, [])).count() == 0


def test_variants_hold_no_slip(spark):
    rows = [(1, "kitten kitten sitten sitten"), (2, "kittens kittens")]
    got = {r["word"]: (r["n_near"], r["form"]) for r in variants.variants(frame(spark, rows), least_chars=3, slip=None).collect()}
    assert got == {"kitten": (2, None), "sitten": (1, None), "kittens": (1, None)}


def test_given_vectors_meet_in_several_cells(spark, sf="/root/testdata/sf0.01"):
    vectors = table(spark, sf, "embeddings")
    sent = []
    real = embeddings.choose_pivots

    def kept(sample, k):
        sent.append(k)
        return real(sample, k)

    embeddings.choose_pivots = kept
    try:
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.link_components(vectors).collect()}
    finally:
        embeddings.choose_pivots = real
    assert sent == [embeddings.CELLS]
    rows = sorted((r["vec_id"], r["embedding"]) for r in vectors.select("vec_id", "embedding").collect())
    ids, v = np.array([i for i, _ in rows]), np.array([e for _, e in rows], float)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    label = ids.copy()
    for _ in range(len(ids)):
        low = np.minimum(label, np.where(near, label, ids.max() + 1).min(1))
        if (low == label).all():
            break
        label = low
    assert got == {int(i): (int(n), int(c)) for i, n, c in zip(ids, near.sum(1), label)}


def test_toxicity_of_given_held_out_rows(spark, sf="/root/testdata/sf0.01"):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = toxicity.score(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out and toxic is not null").collect()
    toxic = [r["predicted"] for r in rows if r["toxic"] == 1]
    clean = [r["predicted"] for r in rows if r["toxic"] == 0]
    assert sum(toxic) >= 0.7 * len(toxic) and sum(clean) <= 0.005 * len(clean)


def test_toxicity_fit_does_not_depend_on_order(spark, sf="/root/testdata/sf0.01"):
    sample = toxicity.draw(table(spark, sf, "documents"), table(spark, sf, "labels"))
    fits = []
    for seed in range(2):
        random.Random(seed).shuffle(sample)
        field = toxicity.fit(sample)
        texts = [toxicity.TOKEN.findall((t or "").lower()) for t, _ in sample[:200]]
        fits.append({" ".join(r): field.score(p) for r, p in zip(texts, field.marginals([np.array([field.emission(w) for w in r], float) for r in texts]))})
    shared = fits[0].keys() & fits[1].keys()
    assert shared and np.mean([(fits[0][t] >= 0.7) == (fits[1][t] >= 0.7) for t in shared]) > 0.97
