"""Collocations, substring dedup and ranked search against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from lumenaudit.llm import bitmaps, collocations, ranked_search, substring, token_counts, topk
from lumenaudit.llm.common import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, w long, rank string, node string, n string, query string, score string, pos string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, *["clash"] * 6) for r in rows], SCHEMA)


def corpus():
    rnd = random.Random(11)
    words = "der die das und Ähre été x1 It's 日本 red green blue a b c d e f g h".split()
    make = lambda n: "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\t", ", ", ".\n", "  "]) for _ in range(n))
    fixed = ["new york city", "rare pair", "New York"]
    texts = [make(rnd.randrange(5, 300)) + rnd.choice(fixed) + " " + make(rnd.randrange(60)) for _ in range(60)]
    shared = make(120)
    texts += [make(70) + shared + make(30), shared, shared, make(20) + shared[: len(shared) // 2] + make(9), " ".join(shared.split()) + "\n", "spam " * 400, "spam " * 90, make(6_000), "y" * 20_000]
    rows = [(i, t, ["en", "de", None, "und", ""][i % 5]) for i, t in enumerate(texts)]
    return [*rows, (500, None, "en"), (501, "", None), (502, " \n\t ", "de"), (503, "one, two", "fr"), rows[61], rows[61], (None, shared, "en"), (3, texts[61], "en"), (4, texts[61], "en"), (-7, shared + " tail", None)]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus())


def mined(rows, limit, least, longest=3, share=50):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang if lang is not None else "und"] += len(ws)
            for k in (1, 2, 3):
                f[lang if lang is not None else "und"].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, c in f.items():
        some = {g: a for g, a in c.items() if 2 <= len(g) <= longest and a >= least}
        inside = Counter()
        for g, a in some.items():
            for x in {g[:-1], g[1:]} if len(g) == 3 else ():
                inside[x] = max(inside[x], a)
        best = []
        for g, a in some.items():
            if len(g) < longest and inside[g] and 100 * inside[g] >= share * a:
                continue
            score, _, left, right = min((1_000_000 * a * a // (c[g[:k]] * c[g[k:]]), k, c[g[:k]], c[g[k:]]) for k in range(1, len(g)))
            best.append((score, a, " ".join(g), left, right))
        best.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, left, right, n[lang], s) for i, (s, a, p, left, right) in enumerate(best[:limit])]
    return sorted(out)


@pytest.mark.parametrize(("limit", "least", "longest", "share"), [(2000, 10, 3, 50), (5, 3, 3, 50), (3, 2, 3, 90), (20, 4, 2, 50)])
def test_collocations(docs, limit, least, longest, share):
    got = collocations.mine_collocations(docs, limit, least, longest, share)
    assert sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == mined(corpus(), limit, least, longest, share)


def test_collocations_grow_in_rounds_until_settled(spark, monkeypatch):
    """The best pairs are all dropped by triples of their own, so the first level settles nothing."""
    monkeypatch.setattr(collocations, "AHEAD", 1)
    rows = [(i, f"p{i % 40} q{i % 40} r{i % 40}. lone u{i % 9} v{i % 4} w. common u{i % 7}", "en") for i in range(800)]
    calls = []
    real = collocations._levels
    monkeypatch.setattr(collocations, "_levels", lambda df, rank: calls.append(rank) or real(df, rank))
    got = collocations.mine_collocations(frame(spark, rows), 45, 10)
    assert sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == mined(rows, 45, 10)
    assert len(calls) > 1


def test_scores_past_64_bits_are_exact(spark):
    a, left, right = 9_000_000_000_001, 9_000_000_000_007, 9_000_000_000_011
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(collocations._score("a", "l", "r").alias("s"), collocations._bound("a", "l").alias("b")).first()
    assert (row.s, row.b) == (1_000_000 * a * a // (left * right), 1_000_000 * a // left)


def test_bitmap_is_a_superset_of_bounded_size(spark):
    rng = np.random.default_rng(1)
    a, b = (rng.integers(-(2**63), 2**63, 3000) for _ in range(2))
    df = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "w1 long, w2 long")
    bits = bitmaps.bitmap(df, bitmaps.pair_column("w1", "w2"), 18)
    assert bits.nbytes == 1 << 15
    keys = bitmaps.pair_key(a.view(np.uint64), b.view(np.uint64))
    assert bitmaps.may_hold(bits, keys, 18).all()
    assert bitmaps.may_hold(bits, rng.integers(0, 2**63, 4000).astype(np.uint64) * np.uint64(2), 18).mean() < 0.05
    assert not bitmaps.may_hold(bitmaps.bitmap(df.limit(0), F.col("w1")), keys).any()


def deduped(rows, size):
    words = [re.findall(r"[^\x20\x09-\x0d]+", t or "") for _, t, _ in rows]
    least = {}
    for (doc_id, *_), ws in zip(rows, words):
        for i in range(len(ws) - size + 1):
            s = tuple(ws[i : i + size])
            if doc_id is not None:
                least[s] = min(least.get(s, doc_id), doc_id)
    out = []
    for (doc_id, *_), ws in zip(rows, words):
        gone = {p for i in range(len(ws) - size + 1) if doc_id is not None and least[tuple(ws[i : i + size])] < doc_id for p in range(i, i + size)}
        kept = " ".join(w for p, w in enumerate(ws) if p not in gone)
        out.append((doc_id, len(ws), len(gone), hashlib.sha256(kept.encode()).digest()))
    return out


@pytest.mark.parametrize("size", [50, 7, 2])
def test_substring_dedup(docs, size):
    got = substring.substring_dedup(docs, size).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, bytes(r.kept_sha256)) for r in got), key=lambda r: (r[0] is None, r[0] or 0, r[1:])) == sorted(deduped(corpus(), size), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def test_doubling_goes_on_until_nothing_survives(spark):
    rnd = random.Random(5)
    unique = lambda n: " ".join(f"u{rnd.randrange(10**9)}" for _ in range(n))
    long, short = unique(430), unique(60)
    rows = [(1, unique(20) + " " + long, "en"), (2, long + " " + unique(30), "en"), (3, unique(70) + " " + short, "en"), (4, short + " " + unique(90), "en"), (5, unique(200), "en")]
    got = substring.longest_repeats(frame(spark, rows))
    assert sorted(tuple(r) for r in got.collect()) == [(2, 460, 400), (4, 150, 50)]
    assert substring.longest_repeats(frame(spark, rows[4:])).count() == 0


def test_windows_are_winnowed_and_doubled():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 2**63, 400).astype(np.uint64)
    for size in (2, 3, 13, 26):
        assert (substring.least_of(h, size) == [h[i : i + size].min() for i in range(len(h) - size + 1)]).all()
    half = substring.windows(h, 25)
    full = substring.doubled(half, 25)
    assert len(full) == 351
    assert (substring.doubled(substring.windows(h[100:160], 25), 25) == full[100:111]).all()
    assert len(np.unique(substring.least_of(half, 26))) < 60


QUERIES = [(1, "the Red green, blue! x1 rare pair"), (2, None), (3, "  ,."), (4, "spam spam spam"), (5, "nothing-known here zzz"), (6, "日本 ÄHRE été new york city new"), (6, "yyy " + "y" * 20_000), (7, "a b c d e f g h der die das und red green blue " * 3)]


def ranked(rows, queries, k):
    find = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    docs = [(d, Counter(find(t))) for d, t, _ in rows if find(t)]
    total, nn, df = sum(sum(c.values()) for _, c in docs), len(docs), Counter(t for _, c in docs for t in c)
    out = []
    for item, text in queries:
        own = []
        for d, c in docs:
            m = 25 + (75 * sum(c.values()) * nn) // total
            score = sum(math.floor(1000 * math.log((2 * nn + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in find(text) if t in c)
            if score > 0:
                own.append((score, d))
        own.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, i + 1, d, s) for i, (s, d) in enumerate(own[:k])]
    return sorted(out, key=repr)


def items(spark, queries):
    return spark.createDataFrame([(*q, "clash", "clash", "clash") for q in queries], "item_id long, text string, doc_id string, query string, term string")


@pytest.mark.parametrize(("k", "segment", "block", "seen"), [(10, 16_384, 1 << 20, 1 << 27), (3, 7, 9, 40)])
def test_ranked_search(spark, docs, monkeypatch, k, segment, block, seen):
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", block)
    monkeypatch.setattr(ranked_search, "SEGMENT", segment)
    monkeypatch.setattr(ranked_search, "SEEN", seen)
    got = ranked_search.ranked_search(docs, items(spark, QUERIES), k)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == ranked(corpus(), QUERIES, k)


def test_nra_reads_no_further_than_it_must():
    rng = np.random.default_rng(9)
    n, terms = 4_000, 6
    at = np.repeat(np.arange(terms), [4_000, 3_000, 2_000, 300, 40, 12])
    doc = np.concatenate([rng.choice(n, c, replace=False) for c in (4_000, 3_000, 2_000, 300, 40, 12)])
    part = rng.integers(1, 50_000, len(at))
    part[at >= 4] += 900_000
    weights = np.array([3, 5, 9, 700, 4_000, 9_000])
    exact = np.bincount(doc, weights=(weights[at] * part).astype(float), minlength=n).astype(np.int64)
    segment = ranked_search.Segment(doc, at, part, n, terms)
    for k, floor in ((10, 0), (1, 0), (5_000, 0), (10, int(np.sort(exact)[-4])), (10, int(exact.max()) + 1)):
        d, score, read = ranked_search.nra(segment, np.arange(terms), weights, k, floor)
        assert (score == exact[d]).all()
        bound = max(np.sort(exact)[-k] if k <= n else 1, floor, 1)
        assert sorted(d.tolist()) == np.flatnonzero(exact >= bound).tolist()
    assert ranked_search.nra(segment, np.arange(terms), weights, 10, 2 * int(exact.max()))[2] <= 12
    assert ranked_search.nra(segment, np.arange(1), weights[:1], 1, 0)[2] < 400


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert collocations.mine_collocations(none).count() == 0
    assert substring.substring_dedup(none).count() == 0
    assert ranked_search.ranked_search(none, items(spark, QUERIES)).count() == 0
    assert ranked_search.ranked_search(docs, items(spark, QUERIES).limit(0)).count() == 0


def test_vectors_of_extreme_components(spark):
    """Components far past 64 bits count as the largest that is safe; every query keeps its whole list."""
    values = {0: 1e300, 1: 1.0, 20: 2.0, 3: 1e17, 40: 1e17, 60: -1e308, 5: -3.5}
    rows = [(k, [v, 1.0, 0.0, 0.0]) for k, v in values.items()]
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    own = {r.vec_id: list(r.v) for r in v.collect()}
    most = 2**30
    assert own == {k: [max(-most, min(most, math.floor(64 * x) if abs(x) < 1e15 else int(math.copysign(most, x)))), 64, 0, 0] for k, x in values.items()}
    got = topk.top_k(v, v.where("vec_id % 20 = 0"), 4, 2, 2).collect()
    want = []
    for q in (0, 20, 40, 60):
        best = sorted(((-sum(a * b for a, b in zip(own[q], own[d])), d) for d in own if d != q))[:4]
        want += [(q, i + 1, d, -s) for i, (s, d) in enumerate(best)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


def test_long_texts_without_spaces_are_counted_in_near_linear_time():
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    c = token_counts.counter("piece_bpe_32k.model")
    rnd = random.Random(1)
    kinds = [lambda: rnd.choice("abcdefghijklmnopqrstuvwxyz"), lambda: rnd.choice(["the", "of", "straße", "tion", "日本", "a", "🙂", "\n", "=", "00"]), lambda: "a", lambda: rnd.choice("ABCdef0123456789+/"), lambda: rnd.choice("ab"), lambda: chr(rnd.randrange(0x4E00, 0x5200))]
    texts = ["".join(f() for _ in range(n)) for f in kinds for n in (150, 191, 192, 193, 194, 700, 3_000)] + [" " * 300 + "ab" * 400 + " x", "é" * 999]
    assert c.count(pa.array(texts)).tolist() == [len(sp.encode(t)) for t in texts]
    took = []
    for n in (80_000, 240_000):
        text = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        began = time.time()
        got = c.count(pa.array([text])).tolist()
        took.append(time.time() - began)
        assert got == [len(sp.encode(text))]
    assert took[1] < 5 * took[0]
