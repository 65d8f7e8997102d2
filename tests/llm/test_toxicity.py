import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grovetally.llm import toxicity, tokens

BAD = ["fool", "rotten", "vile", "awful"]
SCHEMA = "doc_id long, text string, seed string, score string"


def made(n=1500, share=0.12):
    rng = random.Random(2)
    words = ["w%d" % i for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < share
        text = [rng.choice(words) for _ in range(rng.randint(1, 120))]
        if toxic:
            for _ in range(rng.randint(1, 4)):
                text.insert(rng.randint(0, len(text)), rng.choice(BAD) + rng.choice(["", ",", "!"]))
        docs.append((i, " ".join(text), "s", "x"))
        if rng.random() < 0.5:
            labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = made()
    frame, known = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(frame, known, F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    truth = {i: any(b in t for b in BAD) for i, t, *_ in docs}
    got = {r.doc_id: r.score for r in toxicity.score(frame, model).collect()}
    caught = [got[i] >= 0.5 for i in got if truth[i]]
    wrong = [got[i] >= 0.5 for i in got if not truth[i]]
    assert np.mean(caught) > 0.95 and np.mean(wrong) < 0.02
    kept = toxicity.reject_toxic(frame, model)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {i for i in got if got[i] < 0.5}
    again = toxicity.fit(frame, known, F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    assert np.array_equal(model.weights, again.weights)


@pytest.mark.parametrize("share", [0.3, 0.5])
def test_many_toxic_documents(spark, share):
    docs, labels = made(share=share)
    frame, known = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(frame, known, F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    truth = {i: any(b in t for b in BAD) for i, t, *_ in docs}
    got = {r.doc_id: r.score for r in toxicity.score(frame, model).collect()}
    assert np.mean([got[i] >= 0.5 for i in got if truth[i]]) > 0.95
    assert np.mean([got[i] >= 0.5 for i in got if not truth[i]]) < 0.05


def test_nulls_empty_and_long(spark):
    docs, labels = made(300)
    docs += [(None, None, None, None), (5000, "", None, None), (5001, "w1 " * 50_000 + "fool vile rotten", None, None), (5000, "", None, None)]
    labels += [(None, 1, 1), (3, None, None), (9999, 1, 1)]
    frame, known = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(frame, known, F.lit(True))
    got = toxicity.score(frame, model).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    assert [r.score < 0.5 for r in got if r.doc_id in (None, 5000)] == [True] * 3
    assert next(r.score for r in got if r.doc_id == 5001) > 0.5


def test_nothing_to_learn(spark):
    frame = spark.createDataFrame([(1, "a", "", ""), (2, None, "", "")], SCHEMA)
    none = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(frame, none, F.lit(True))
    assert [r.score for r in toxicity.score(frame, model).collect()] == [0.0, 0.0]
    assert toxicity.score(frame.limit(0), model).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7])
def test_words_against_split(n):
    rng = random.Random(n)
    texts = [None, "", " ", "A\tb\x0bC d\x1ce", " x", "é É"] + ["".join(rng.choice("aB \né.") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    if n == 7:
        texts += ["x" * (3 << 20) + " tail " + "y" * 100, ("word " * 700_000)]
    words = tokens.Words(pa.array(texts))
    want = [[w for w in (t or "").encode().lower().split()] for t in texts]
    assert words.count.tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    assert [words.word(i) for i in range(len(flat))] == flat
    seen = {}
    for h, w in zip(words.hash.tolist(), flat):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    sliced = tokens.Words(pa.array(["zz zz"] + texts)[1:])
    assert np.array_equal(sliced.hash, words.hash)


def word_hash(data, more):
    mask = (1 << 64) - 1
    h = sum((b + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(data)) + more & mask
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ h >> shift) * factor & mask
    return (h ^ h >> 33) >> 64 - toxicity.BITS


def plain_features(text):
    words = re.findall(rb"[A-Za-z0-9\x80-\xff]+", (text or "").encode())
    found = set()
    for w in (bytes(b + 32 if 65 <= b < 91 else b for b in w) for w in words):
        found.add(word_hash(w, len(w)))
        found |= {word_hash(w[:k], 0x51ED27 + k) for k in toxicity.STEMS if len(w) > k}
    return sorted(found)


def plain_train(positive, unlabelled, prior, steps=400, rate=0.2, decay=1e-4, least=0.02, lift=4.0):
    """The same learner, one document and one feature at a time."""
    sig = lambda x: 1 / (1 + math.exp(-max(-60, min(60, x))))
    n, m = len(positive), len(unlabelled)
    in_p, in_u = (Counter(f for d in some for f in d) for some in (positive, unlabelled))
    prior = min(max(prior, 1e-4), 0.9)
    clean = lambda f: max((in_u[f] + 2) / m - prior * in_p[f] / n, 2 / m) / (1 - prior)
    told = {f for f in in_p if in_p[f] >= max(min(5, n), least * n) and in_p[f] / n >= lift * clean(f)}
    docs = [[f for f in d if f in told] for d in positive + unlabelled]
    w, squares, b, square = dict.fromkeys(told, 0.0), dict.fromkeys(told, 1e-8), math.log(prior / (1 - prior)), 1e-8
    for _ in range(steps):
        p = [sig(sum(w[f] for f in d) + b) for d in docs]
        risk = [-math.log(max(1 - x, 1e-12)) for x in p]
        if sum(risk[n:]) / m - prior * sum(risk[:n]) / n >= 0:
            push = [-prior / n] * n + [x / m for x in p[n:]]
        else:
            push = [prior * x / n for x in p[:n]] + [-x / m for x in p[n:]]
        step = {f: decay * w[f] for f in told}
        for d, g in zip(docs, push):
            for f in d:
                step[f] += g
        for f, g in step.items():
            squares[f] += g * g
            w[f] -= rate * g / math.sqrt(squares[f])
        square += sum(push) ** 2
        b -= rate * sum(push) / math.sqrt(square)
    return w, b


def test_training_and_scores_against_plain_loops():
    rng = random.Random(11)
    say = lambda n: [rng.choice(["kind", "words", "Everyday", "é9", "talking", "rivers"]) + str(rng.randint(0, 5)) for _ in range(n)]
    toxic = [" ".join(say(8) + rng.sample(["vilest", "rotten!", "foolish"], 2)) for _ in range(20)]
    mixed = [" ".join(say(12)) for _ in range(50)] + toxic[:6] + ["", "vilest"]
    lists = [[plain_features(t) for t in some] for some in (toxic, mixed)]
    for texts, want in zip((toxic, mixed), lists):
        rows, found = toxicity.features(pa.array(texts))
        assert [found[rows == i].tolist() for i in range(len(texts))] == want
    model = toxicity.train(*([np.array(d, np.int32) for d in some] for some in lists), 0.15, steps=60)
    weights, intercept = plain_train(*lists, 0.15, steps=60)
    assert math.isclose(model.intercept, intercept, rel_tol=1e-9)
    assert all(math.isclose(model.weights[f], x, rel_tol=1e-7, abs_tol=1e-9) for f, x in weights.items()) and (model.weights != 0).sum() <= len(weights)
    got = model.score(pa.array([*toxic, *mixed, None]))
    want = [1 / (1 + math.exp(-sum(weights.get(f, 0) for f in d) - intercept)) for d in [*lists[0], *lists[1], []]]
    assert np.allclose(got, want, rtol=1e-7)
