import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grovetally.llm import lm, tokens

SCHEMA = "doc_id long, text string, score double, hash string"


def made(n=600):
    rng = random.Random(9)
    words = {k: ["%s%d" % (k, i) for i in range(60)] for k in "abé"}
    rows = []
    for i in range(n):
        lang = rng.choice("abé")
        rows.append((i, " ".join(rng.choice(words[lang]) if rng.random() < 0.95 else "rare%d." % rng.randint(0, 400) for _ in range(rng.randint(0, 80))).title()))
    rows += [(9000, None), (9001, ""), (9000, None), (None, "a1 b2 unseen"), (9002, "A1\x0bA1\x1cA2 new" * 30_000), rows[0], rows[0], (9003, rows[5][1])]
    return rows


def base(rows):
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    split = lambda t: (t or "").encode().lower().split() + [None]
    c = Counter(w for i, t in rows if not held(i) for w in split(t))
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        ws = split(t)
        out.append((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)))
    return out


@pytest.mark.parametrize("frequent", [lm.FREQUENT, 150])
def test_base_scores_and_gain(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    rows = made()
    frame = spark.createDataFrame([(i, t, 0.0, "x") for i, t in rows], SCHEMA)
    got = lm.score(spark, frame, F.crc32(F.col("doc_id").cast("string")) % 10 != 0).collect()
    key = lambda r: (str(r[0]), r[2], r[3], round(r[5], 6))
    got, want = sorted(got, key=key), sorted(base(rows), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert tuple(g)[:5] == w[:5] and math.isclose(g.base_score, w[5], rel_tol=1e-9, abs_tol=1e-9)
    held = [g for g in got if g.held_out and g.n_tokens < 1000]
    assert sum(g.score for g in held) > sum(g.base_score for g in held)
    assert all(g.score < 0 and math.isfinite(g.score) for g in got)


def test_probabilities_are_normalised(spark):
    pairs = np.random.default_rng(0).poisson(0.01, (lm.TOKENS, lm.TOKENS)).astype(float)
    table = lm.train(pairs, steps=3)
    assert np.allclose(np.exp(table.astype(float)).sum(1), 1, atol=1e-4)


def test_training_learns_pairs():
    pairs = np.zeros((40, 40))
    for i in range(40):
        pairs[i, (i * 7) % 40] = 100
    table = lm.train(pairs, steps=300)
    assert (table.argmax(1) == (np.arange(40) * 7) % 40).mean() > 0.9


def test_shapes_and_empty(spark):
    w = tokens.Words(pa.array(["", None, "a ab abc, ééé 12345678901234567890"]))
    s = lm.shapes(w)
    assert len(s) == 5 and s.min() >= 0 and s.max() < lm.SHAPES
    frame = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert lm.score(spark, frame.limit(0), F.lit(True)).count() == 0
    none = lm.score(spark, frame, F.lit(False)).collect()
    assert {(r.train_tokens, r.base_score, r.n_known) for r in none} == {(0, 0.0, 0)}


def plain_scores(rows, learns):
    """The model's log10 probability of every text, token by token, from counts of its own."""
    split = lambda t: (t or "").encode().lower().split()
    every, learnt = Counter(), Counter()
    for i, t in rows:
        every.update(split(t))
        learnt.update(split(t) if learns(i) else [])
    of = {}
    for w in every:
        one = tokens.Words(pa.array([w.decode()]))
        of[w] = (int(one.hash[0]), int(lm.shapes(one)[0]))
    common = sorted((w for w in every if every[w] > 1 and learnt[w] > 0), key=lambda w: (-learnt[w], of[w][0]))
    token = {w: k for k, w in enumerate(common[: lm.CORE])}
    number = lambda w: token.get(w, lm.WORDS + of[w][1])
    pairs, after = np.zeros((lm.TOKENS, lm.TOKENS)), {}
    for i, t in rows:
        if learns(i):
            words = split(t)
            line = [lm.END, *map(number, words), lm.END]
            for a, b in zip(line, line[1:]):
                pairs[a, b] += 1
            for a, w in zip(line, words):
                after.setdefault(w, np.zeros(lm.TOKENS))[a] += 1
    table, context = lm.train_core(pairs)
    context = lm.narrow(context, pairs.sum(1)).astype(float)
    n, v = Counter(), Counter()
    for w in every:
        if w not in token:
            n[of[w][1]] += learnt[w]
            v[of[w][1]] += learnt[w] > 0
    share = {w: (learnt[w] + 0.1) / (n[of[w][1]] + 0.1 * (v[of[w][1]] + 1)) for w in every if w not in token}
    vector = {}
    for w in common[lm.CORE :]:
        if learnt[w] >= lm.LEAST:
            expected = (pairs[:, lm.WORDS + of[w][1]] * share[w])[None]
            vector[w] = lm.fit(context.astype(np.float32), after[w][None].astype(np.float32), expected.astype(np.float32))[0].astype(float)
    whole = np.ones((lm.TOKENS, lm.SHAPES))
    for w, x in vector.items():
        whole[:, of[w][1]] += share[w] * (np.exp(context @ x) - 1)
    out = []
    for i, t in rows:
        words = split(t)
        line = [lm.END, *map(number, words), lm.END]
        total = sum(float(table[a, b]) for a, b in zip(line, line[1:]))
        for a, w in zip(line, words):
            if w not in token:
                total += math.log(share[w] / whole[a, of[w][1]]) + (context[a] @ vector[w] if w in vector else 0)
        out.append((i, len(words) + 1, total / math.log(10)))
    return out, len(vector)


@pytest.mark.parametrize("core, frequent", [(lm.CORE, lm.FREQUENT), (30, lm.FREQUENT), (30, 150)])
def test_scores_against_plain_counts(spark, monkeypatch, core, frequent):
    monkeypatch.setattr(lm, "CORE", core)
    rows = [(i, t) for i, t in made(150) if i != 9002]
    frame = spark.createDataFrame([(i, t, 0.0, "x") for i, t in rows], SCHEMA)
    want, fitted = plain_scores(rows, lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 != 0)
    assert (fitted > 50) == (core == 30)
    if frequent < lm.FREQUENT:
        want = None
        monkeypatch.setattr(lm, "FREQUENT", frequent)
    got = lm.score(spark, frame, F.crc32(F.col("doc_id").cast("string")) % 10 != 0).collect()
    assert len(got) == len(rows) and all(math.isfinite(r.score) and r.score < 0 for r in got)
    if want is None:
        return
    key = lambda r: (str(r[0]), r[1], round(r[2], 2))
    got, want = sorted(((r.doc_id, r.n_tokens, r.score) for r in got), key=key), sorted(want, key=key)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(math.isclose(g[2], w[2], rel_tol=1e-4) for g, w in zip(got, want))


def problem(words=40, contexts=200):
    rng = np.random.default_rng(4)
    context = np.hstack([rng.normal(size=(contexts, 6)), np.ones((contexts, 1))]).astype(np.float32)
    expected = rng.gamma(0.5, 1.0, (words, contexts)).astype(np.float32)
    true = rng.normal(0, 0.7, (words, 7)).astype(np.float32)
    seen = rng.poisson(expected * np.exp(np.minimum(true @ context.T, 4))).astype(np.float32)
    return context, seen, expected, true


def test_vectors_reach_the_optimum():
    context, seen, expected, true = problem()
    got = lm.fit(context, seen, expected, steps=30).astype(float)
    p = 1 / (1 + np.exp(np.log(lm.NOISE) - got @ context.T))
    uphill = (seen - (seen + lm.NOISE * expected) * p) @ context - got
    assert np.abs(uphill).max() < 0.05 * seen.sum(1).max() ** 0.5
    assert np.corrcoef(got.ravel(), true.ravel())[0, 1] > 0.9
    few = lm.fit(context, seen, expected).astype(float)
    assert np.abs(few - got).max() < 0.1


def test_vectors_survive_extremes():
    context, seen, expected, _ = problem(4)
    seen[0], expected[1], seen[2], expected[3] = 0, 0, 1e7, 1e9
    assert np.isfinite(lm.fit(context, seen, expected)).all()


def test_two_levels_are_normalised():
    rng = np.random.default_rng(5)
    context = lm.narrow(rng.normal(size=(lm.TOKENS, 32)), rng.poisson(2.0, lm.TOKENS))
    shape, vectors = rng.integers(0, lm.SHAPES, 500), rng.normal(0, 1, (500, lm.NARROW + 1)).astype(np.float32)
    share = rng.uniform(0, 1, 500)
    total = np.bincount(shape, weights=share, minlength=lm.SHAPES)
    share /= 2 * total[shape]
    whole = np.exp(lm.spread(context, vectors, share, shape))
    for c in (0, 7, lm.END):
        inside = np.bincount(shape, weights=share * np.exp(context[c].astype(float) @ vectors.T.astype(float)) / whole[c][shape], minlength=lm.SHAPES)
        left = (1 - np.bincount(shape, weights=share, minlength=lm.SHAPES)) / whole[c]
        assert np.allclose(inside + left, 1, atol=1e-4)
