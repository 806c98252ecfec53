"""Whitening, packing and spelling variants against plain Python."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strideframe.llm import packing, spellings, whitening
from strideframe.llm.stages import Scratch

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")

# ---- 11


def plain_whitening(vectors, k, counts=True):
    """(n, exact deviation per vector, covariance in exact fractions) of the integer vectors."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    fit = x if counts else [list(v) for v in {tuple(v) for v in x}]
    n, dims = len(fit), len(fit[0])
    s = [sum(v[j] for v in fit) for j in range(dims)]
    mean = [Fraction(t, n) for t in s]
    cov = [[sum((v[i] - mean[i]) * (v[j] - mean[j]) for v in fit) / n for j in range(dims)] for i in range(dims)]
    values, axes = np.linalg.eigh(np.array([[float(c) for c in row] for row in cov]))
    order = np.argsort(-values)[:k]
    centred = np.array([[float(v[j] - mean[j]) for j in range(dims)] for v in x])
    deviation = [sum((n * v[j] - s[j]) ** 2 for j in range(dims)) for v in x]
    return n, deviation, centred @ axes[:, order], values[order], values.sum()


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    spread = rng.normal(size=(9, 9)) * np.arange(1, 10)
    base = (rng.normal(size=(70, 9)) @ spread + 40).astype(np.float32).astype(float).tolist()
    return base + [base[0]] * 40 + [base[1]] * 3


def embeddings(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, dim string, whitened string, raw string, n string")


@pytest.mark.parametrize("weights", ["counts", "one"])
def test_whitening(spark, vectors, weights, monkeypatch):
    monkeypatch.setattr(whitening, "HOT_SHARE", 0.1)
    monkeypatch.setattr(whitening, "_FAN", 2)
    bad = [None, [], [1.0] * 8 + [None], [1.0] * 8 + [float("nan")], [1.0] * 8 + [float("inf")]]
    rows = [(None if i == 5 else i, v, 0, "d", "w", "r", "n") for i, v in enumerate(vectors)]
    rows += [(1000 + i, v, 0, "d", "w", "r", "n") for i, v in enumerate(bad)] + [rows[9]] * 2
    usable = [r[1] for r in rows if r[1] and all(c is not None and math.isfinite(c) for c in r[1])]
    n, deviation, projected, e, trace = plain_whitening(usable, 6, weights == "counts")
    want = defaultdict(list)
    for v, d, p in zip(usable, deviation, projected):
        want[tuple(v)].append((d, p))
    df = embeddings(spark, rows).repartition(5)
    made = whitening.whiten(df, components=6, weights=weights).collect()
    assert Counter(r["id"] for r in made) == Counter(r[0] for r in rows if r[0] is None or r[0] < 1000)
    by_id = {r[0]: tuple(r[1]) for r in rows if r[1]}
    sign = None
    for r in made:
        d, p = want[by_id[r["id"]]][0]
        assert (r["n"], int(r["deviation"])) == (n, d)
        expect = p / np.sqrt(e)
        if sign is None:
            sign = np.sign(expect) * np.sign(r["whitened"])
        assert np.allclose(np.array(r["whitened"]) * sign, expect, rtol=1e-9, atol=1e-9)
        assert np.allclose(r["explained"], e / trace, rtol=1e-9) and r["identity_error"] < 1e-9


def test_whitening_digest_and_corners(spark):
    same = embeddings(spark, [(i, [1.0, 2.0, 3.0], 0, "", "", "", "") for i in range(4)])
    rows = whitening.digest(same).collect()
    assert len(rows) == 12 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in rows} == {(4, 0, 0.0, 0.0, 1.0)}
    assert {r.component for r in rows} == {1, 2, 3}
    assert rows[0].asDict().keys() == {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"}
    assert whitening.digest(same.where("false")).count() == 0
    # Two lengths, fitted apart; sums beyond 64 bits stay exact.
    mixed = embeddings(spark, [(i, [2.0**50 * (i + 1), float(i % 3)][: 1 + i % 2], 0, "", "", "", "") for i in range(8)])
    got = {r["id"]: r for r in whitening.whiten(mixed).collect()}
    assert {len(r["whitened"]) for r in got.values()} == {1, 2} and {r["n"] for r in got.values()} == {4}
    long = [[math.floor(64 * 2.0**50 * (i + 1))] for i in range(0, 8, 2)]
    total = sum(v[0] for v in long)
    assert [int(got[i]["deviation"]) for i in range(0, 8, 2)] == [(4 * v[0] - total) ** 2 for v in long]
    assert {r.deviation for r in whitening.digest(mixed).where("vec_id = 0").collect()} == {None}
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(embeddings(spark, [(1, [1e30], 0, "", "", "", "")])).collect()


# ---- 12


def test_best_fit():
    rng = random.Random(4)
    for _ in range(30):
        sizes = np.array([rng.randrange(0, 33) for _ in range(rng.randrange(60))], np.int64)
        bins, offsets, fills = packing.best_fit(sizes, 32)
        spans = defaultdict(list)
        for size, b, at in zip(sizes.tolist(), bins.tolist(), offsets.tolist()):
            spans[b].append((at, size))
        for b, own in spans.items():
            end = 0
            for at, size in sorted(own):
                assert at == end
                end += size
            assert end == fills[b] <= 32
        halves = sorted(fills.tolist())
        assert len(halves) < 2 or halves[0] + halves[1] > 32  # no two bins fit together
    with pytest.raises(ValueError):
        packing.best_fit(np.array([33]), 32)


@pytest.mark.parametrize("leaf,fan,most", [(40, 2, 3), (40, 3, 1000), (10**6, 2, 5)])
def test_pack(spark, leaf, fan, most):
    rng = random.Random(leaf + fan)
    rows = [(i, rng.choice([rng.randrange(1, 30), rng.randrange(40, 101), 100, 51]), "s", 1, 2) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, length long, sequence_id string, _row int, _bin int").repartition(6)
    got = packing.pack(df, "length", 100, leaf=leaf, fan=fan, most=most)
    assert got.columns == ["id", "length", "sequence_id", "_row", "_bin", "_sequence_id", "offset"]
    found = got.collect()
    assert sorted(r["id"] for r in found) == list(range(700)) and {r["sequence_id"] for r in found} == {"s"}
    spans = defaultdict(list)
    for r in found:
        spans[r["_sequence_id"]].append((r["offset"], r["length"]))
    for own in spans.values():
        end = 0
        for at, size in sorted(own):
            assert at == end
            end += size
        assert end <= 100
    alone = len(packing.best_fit(np.array([r[1] for r in rows]), 100)[2])
    assert len(spans) <= alone * 1.04 + 1
    half = [sum(s for _, s in own) for own in spans.values()]
    assert sum(h <= 50 for h in half) <= 1 or most == 3
    assert packing.pack(df.where("false"), "length", 100).count() == 0


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    vocabulary = ["Über", "the", "cat", "1234567", "sat-down", "naïve", "\n", "xyzzy", "...", "日本"]
    made = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 30, 90])))) for i in range(60)]
    made += [(70, None), (71, ""), (72, "word " * 500), (None, "no id"), (73, "a"), (73, "a")]
    return made


@pytest.mark.parametrize("capacity", [64, 4096])
def test_pieces_and_sequences(spark, texts, capacity):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    docs = spark.createDataFrame([(i, t, 5, "o") for i, t in texts], "doc_id long, text string, offset int, piece string").repartition(3)
    want, whole = Counter(), {}
    for i, t in texts:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        whole.setdefault(i, ids)
        for number, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            want[i, number, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    rows = packing.digest(docs, WORD_BPE, 1, capacity).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    taken = defaultdict(list)
    for r in rows:
        taken[r.sequence_id].append((r.offset, r.length, r.doc_id, r.start))
    total = sum(r.length for r in rows)
    assert len(taken) <= math.ceil(total / capacity) * 1.1 + 1
    made = packing.sequences(docs, WORD_BPE, 1, capacity).collect()
    assert all(r["n_tokens"] == len(r["ids"]) <= capacity for r in made) and sum(r["n_tokens"] for r in made) == total
    assert Counter(i for r in made for i in r["ids"]) == Counter(i for d, t in texts for i in whole[d])
    for own in taken.values():
        end = 0
        for at, size, _, _ in sorted(own, key=lambda o: o[:2]):
            assert at == end
            end += size
        assert end <= capacity


# ---- 13


def plain_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(counts, times=10):
    found = {w: [v for v in counts if v != w and plain_near(w, v)] for w in counts}
    form = {}
    for w, vs in found.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(found[w]), counts[form[w]] if form[w] else None))
    return out


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def plain_words(docs, every=31, shortest=7):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{word}".encode()) if doc_id is not None else 1
            if h % every == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= shortest and n >= 2}


@pytest.mark.parametrize("batch,letters", [(4, 1 << 21), (64, 90), (1024, 1 << 21)])
def test_groups_of_made_words(spark, batch, letters):
    rng = random.Random(batch)
    vocabulary = set()
    for _ in range(60):
        word = "".join(rng.choices("abé", k=rng.randrange(1, 13)))
        vocabulary.add(word)
        for _ in range(4):
            at = rng.randrange(len(word) + 1)
            vocabulary.add(rng.choice([word[:at] + rng.choice("abcß") + word[at:], word[:at] + rng.choice("ab") + word[at + 1 :]]))
    vocabulary |= {"same" * 3 + x + y for x in "abcdefgh" for y in "abcdefgh"} | {"q" * 700, "q" * 701, "q" * 350 + "z" + "q" * 349}
    counts = {w: rng.choice([2, 3, 25, 300, 4000]) for w in vocabulary if w}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = {tuple(r[c] for c in COLUMNS) for r in spellings.group(df, batch=batch, letters=letters).collect()}
    assert got == plain_groups(counts)


def test_spellings(spark):
    rng = random.Random(2)
    stems = ["reference", "Économie", "STRASSE", "größere", "ÀÉÎÕÜÿ×", "aaaaaaa", "aaaaaaaa", "internal", "interval", "ſecreter"]
    docs = [(i, " ".join(rng.choices(stems, weights=range(1, 11), k=400)) + ", Kelvins KELVINS") for i in range(60)]
    docs += [(None, "reference " * 3), (77, None), (78, ""), (79, " \n"), docs[0], docs[0], (80, "x" * 5000 + " " + "x" * 5000)]
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in docs], "doc_id long, text string, word string, n int").repartition(3)
    counts = plain_words(docs)
    assert {r.word: r.n for r in spellings.words(df).collect()} == counts and len(counts) > 15
    got = {tuple(r[c] for c in COLUMNS) for r in spellings.digest(df).collect()}
    assert got == plain_groups(counts) and any(r[1] for r in got)
    assert spellings.digest(df.where("false")).count() == 0
    assert spellings.digest(df.where("doc_id = 77")).count() == 0


def test_large_cells_are_divided(spark):
    """Words that share their front half, so that one cell would hold them all."""
    words = [("prefix" * 2 + "".join(c), 2 + i % 50) for i, c in enumerate((a, b, c, d) for a in "abcdefgh" for b in "ijklmnop" for c in "qrst" for d in "uvwx")]
    df = spark.createDataFrame(words, "word string, n long")
    sizes = spellings.cells(df, Scratch(spark, "cells"), 64).groupBy("size", "front", "back", "key").count()
    assert sizes.agg({"count": "max"}).first()[0] <= 64
    got = {tuple(r[c] for c in COLUMNS) for r in spellings.group(df, batch=64).collect()}
    assert got == plain_groups(dict(words))
