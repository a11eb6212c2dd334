"""Periodic runs, the filter audit and top-k search against brute force, and odd input."""

import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mirrortab.llm import audit, periods, topk
from mirrortab.llm.wavelet import WaveletMatrix

BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")


# wavelet matrix

@pytest.mark.parametrize("n", [1, 2, 7, 64, 300])
def test_wavelet_matrix_equals_sorting(n):
    rng = np.random.default_rng(n)
    values = rng.permutation(n)
    tree = WaveletMatrix(values)
    low = rng.integers(0, n + 1, 200)
    high = np.minimum(n, low + rng.integers(0, n + 1, 200))
    x = rng.integers(0, 2 * n + 2, 200)
    assert tree.below(low, high, x).tolist() == [int((values[a:b] < v).sum()) for a, b, v in zip(low, high, x)]
    some = high > low
    low, high = low[some], high[some]
    nth = rng.integers(0, high - low)
    assert tree.nth(low, high, nth).tolist() == [sorted(values[a:b])[k] for a, b, k in zip(low, high, nth)]


# periodic runs

def runs_by_brute_force(words):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        s = 0
        while s < n - q:
            e = s
            while e < n - q and words[e] == words[e + q]:
                e += 1
            if e - s + q >= max(12, 2 * q):
                found.setdefault((s, e - s + q), q)
            s = max(e, s) + 1
    return sorted((s, q, n_) for (s, n_), q in found.items())


def sequences(seed):
    rng = np.random.default_rng(seed)
    pick = lambda a, b: int(rng.integers(a, b))
    for _ in range(120):
        yield rng.integers(0, pick(1, 4), pick(1, 140)).tolist()
        tiled = np.tile(rng.integers(0, 3, pick(1, 14)), 12)
        for _ in range(pick(0, 4)):
            tiled[pick(0, len(tiled))] = pick(0, 5)
        yield tiled.tolist()
        inner = np.tile(rng.integers(0, 2, pick(1, 4)), pick(1, 9))
        yield np.tile(np.concatenate([inner, rng.integers(0, 3, pick(0, 3))]), pick(1, 5)).tolist()
    a, b = [0], [0, 1]
    while len(b) < 300:
        a, b = b, b + a
        yield b


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_equal_brute_force(seed):
    for words in sequences(seed):
        start, length, period = periods.runs(np.array([*words, 99]))
        assert list(zip(start.tolist(), period.tolist(), length.tolist())) == runs_by_brute_force(words), words


def test_runs_of_texts_and_odd_input(spark):
    texts = [
        None, "", " \t\n", "a", "a " * 11, "a " * 12, "x y " * 6, "x\ty\n" * 6 + "x z", "p q r " * 300, "A a " * 5,
        "é ü " * 6, "  " * 12, "one two three " * 4 + "and then " + "four five " * 7, "w" * 100_000, "b " * 70_000 + "c",
        " ".join(f"u{i}" for i in range(3_000)) + " " + "m n o " * 900,
    ]
    rows = [(i, t, 1, "x", 2, "y") for i, t in enumerate(texts)] + [(5, "a " * 12, 1, "x", 2, "y"), (None, "a " * 12, 1, "x", 2, "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_words int, runs string, start int, collapsed string")
    for together in (10, periods.TOGETHER):
        got = periods.periodic_runs(docs, together).collect()
        assert len(got) == len(rows)
        for r in got:
            if r.doc_id is None:
                continue
            words = BLANK_WORD.findall(texts[r.doc_id] or "")
            assert r.n_words == len(words)
            found = [(x.start, x.period, x.length) for x in r.runs]
            if len(words) < 1_000:
                assert found == runs_by_brute_force(words)
            dropped = {j for s, q, n in found for j in range(s + q, s + n)}
            assert r.collapsed == " ".join(w for j, w in enumerate(words) if j not in dropped)
        known = {r.doc_id: [(x.start, x.period, x.length) for x in r.runs] for r in got}
        assert known[14] == [(0, 1, 70_000)] and known[15] == [(3_000, 3, 2_700)] and known[None] == [(0, 1, 12)]
    assert periods.periodic_runs(docs.where("false")).count() == 0


def test_planted_periods(spark):
    import zlib

    texts = [" ".join(f"w{j}" for j in range(i % 50)) for i in range(300)]
    docs = spark.createDataFrame([*enumerate(texts), (1000, None), (None, "a b")], "doc_id bigint, text string")
    for r in periods.with_planted_periods(docs).collect():
        if r.doc_id is None:
            assert r.text == "a b"
            continue
        words = (texts[r.doc_id] if r.doc_id < 300 else "").split()
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
        assert (r.text or "").split() == words


# filter audit

def audit_by_brute_force(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", math.inf), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    judged = []
    for i, t, lang in rows:
        t = t or ""
        w = BLANK_WORD.findall(t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i,
        }
        judged.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part in {j[0] for j in judged}:
        mine = [j for j in judged if j[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, f in enumerate(order):
                here = [j for j in mine if not j[1] & set(order[:k])]
                gone = [j for j in here if f in j[1]]
                shapley[f] += len(gone)
                out[part, order, k + 1] = [
                    len(here) - len(gone), len(gone), sum(f in j[1] for j in mine) - len(gone),
                    sum(j[1] == {f} for j in mine), sum(j[2] for j in gone), sum(j[3] for j in gone),
                ]
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, f in enumerate(order):
                out[part, order, k + 1].append(shapley[f])
    return out


COUNTS = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def test_audit_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    pool = ["alpha", "beta", "Gamma", "DELTA", "eps#", "é", "ζ|", "$", "eta", *(f"w{i}" for i in range(300))]
    texts = [" ".join(rng.choice(pool[: int(rng.integers(4, len(pool)))], int(rng.integers(0, 420)))) for _ in range(120)]
    texts += [None, "", " \t", "x " * 30_000, *texts[:20], "A" * 200_000]
    rows = [(int(i), t, [None, "", "de", "fr", "Fr"][int(rng.integers(5))]) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[5], "de"), (None, None, None)]
    labels = [(i, int(rng.integers(2)), int(rng.integers(2))) for i in range(0, 150, 2)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1), (5, None, 1)]
    docs = spark.createDataFrame([(*r, "x", 1, True) for r in rows], "doc_id bigint, text string, lang string, part string, word int, good boolean")
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): [r[c] for c in COUNTS] for r in audit.filter_audit(docs, known).collect()}
    assert got == audit_by_brute_force(rows, labels)
    assert audit.filter_audit(docs.where("false"), known).count() == 0
    none = audit.filter_audit(docs, known.where("false")).collect()
    assert len(none) == 600 * len({r[0] for r in got}) and not any(r.good_lost or r.toxic_lost for r in none)


def test_positional_popcount():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 5, 1_000, 12_345):
        words = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
        assert audit.positional_popcount(words).tolist() == [int((words >> np.uint32(s) & 1).sum()) for s in range(32)]


# top-k search

def top_by_brute_force(rows, k):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q in {i for i, _ in usable if i % 50 == 0}:
        pairs = []
        for own in {tuple(v) for i, v in usable if i == q}:
            pairs += [(-sum(a * b for a, b in zip(own, v)), i) for i, v in usable if i != q and len(v) == len(own)]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(pairs)[:k])}
    return out


@pytest.mark.parametrize("block", [topk.BLOCK_VALUES, 8])
def test_top_k_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK_VALUES", block)
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=19) * rng.choice([0.01, 1, 3])]) for i in range(400)]
    rows += [(1_000 + i, rows[7][1]) for i in range(9)]  # ties
    rows += [(500, [0.5, -0.25]), (501, [1.0, 1.0]), (550, []), (551, []), (600, [1.0, None]), (650, None), (700, [float("nan")] * 19),
             (750, [float("inf")] * 19), (None, rows[0][1]), (800, [0.0] * 19), rows[9], rows[9], rows[50]]
    df = spark.createDataFrame(
        [(*r, 1, "x", 2) for r in rows], "vec_id bigint, embedding array<float>, rank int, id string, score int"
    ).repartition(3)
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, tile=3).collect()]
    assert len(got) == len(set(got)) and set(got) == top_by_brute_force(rows, 5)
    assert topk.top_k(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(df.where("vec_id = 800"), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_hold_at_every_resolution():
    rng = np.random.default_rng(8)
    for size in (1, 2, 3, 17, 64, 100):
        a, b = np.floor(rng.normal(size=(2, 60, size)) * 90 + rng.normal(size=(2, 60, 1)) * 40)
        exact = a @ b.T
        last = np.inf
        for n in topk.segment_lengths(size):
            bound = topk.statistics(a, n) @ topk.statistics(b, n).T
            assert (bound >= exact - 1e-6).all()
            assert bound.sum() <= last + 1e-6
            last = bound.sum()
