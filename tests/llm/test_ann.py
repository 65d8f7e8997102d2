import numpy as np
from pyspark.sql import functions as F

from grovetally.llm import ann

SCHEMA = "vec_id long, embedding array<float>, score string, rank string, id int"


def brute(rows, k=10):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for at, (q, v) in enumerate(good):
        if q % 100 == 0:
            out[q] = sorted(out.get(q, []) + sorted((float(np.sqrt(((x - v) ** 2).sum())), i) for k2, (i, x) in enumerate(good) if k2 != at)[:k])
    return out


def search(spark, rows, **more):
    frame = spark.createDataFrame([(i, v, "s", "r", 1) for i, v in rows], SCHEMA)
    got = {}
    rows = ann.nearest(spark, frame, F.col("id") % 100 == 0, **more).collect()
    for r in rows:
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    for q, found in got.items():
        ranks, queries = sorted(r.rank for r in rows if r.query_id == q), sum(r.rank == 1 for r in rows if r.query_id == q)
        assert ranks == sorted([*range(1, len(found) // queries + 1)] * queries)
    return {q: sorted(found) for q, found in got.items()}


def unit(x):
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_recall_with_a_hot_group(spark):
    rng = np.random.default_rng(0)
    x = unit(rng.normal(size=(6000, 32)))
    x[:2000] = unit(x[:1] + 0.01 * rng.normal(size=(2000, 32)))
    rows = [(int(i), [float(c) for c in v]) for i, v in zip(rng.permutation(6000), x)]
    got, want = search(spark, rows, sample=2000, rerank=40), brute(rows)
    assert got.keys() == want.keys()
    hits = [len({i for _, i in got[q]} & {i for _, i in want[q]}) / 10 for q in want]
    assert np.mean(hits) >= 0.95
    for q in want:
        exact = dict((i, s) for s, i in brute(rows, 6000)[q]) if q == 0 else dict((i, s) for s, i in want[q])
        assert all(abs(exact[i] - s) < 1e-12 for s, i in got[q] if i in exact)


def test_ties_copies_and_unusable_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 250)] + [(1000, [1.0, 2.0, 4.0])]
    rows += [(300, None), (400, [0.0, 0.0, 0.0]), (500, [1.0, None, 2.0]), (600, [float("nan"), 1.0, 1.0]), (700, [float("inf"), 1.0, 1.0]), (None, [1.0, 2.0, 3.0]), (800, [1.0, 2.0])]
    rows += [(7, [1.0, 2.0, 3.0]), (100, [1.0, 2.0, 3.0])]
    got, want = search(spark, rows), brute([r for r in rows if r[0] != 800])
    assert got.keys() == {0, 100, 200, 1000}
    assert [i for _, i in got[0]] == [1, 2, 3, 4, 5, 6, 7, 7, 8, 9] and got[100] == want[100] and len(got[100]) == 20
    assert [i for _, i in got[1000]] == [i for _, i in want[1000]]


def test_few_rows(spark):
    assert search(spark, []) == {}
    assert search(spark, [(100, [1.0, 0.0])]) == {}
    assert search(spark, [(100, [3.0, 0.0]), (1, [0.0, 4.0]), (2, None)]) == {100: [(5.0, 1)]}


def test_codes_improve_with_books():
    x = unit(np.random.default_rng(1).normal(size=(3000, 16)))
    errors = []
    for books in (1, 2, 4):
        model = ann.train(x, books=books, size=64)
        errors.append(((x - model.decode(model.encode(x))) ** 2).sum(1).mean())
    assert errors[0] > 1.3 * errors[1] and errors[1] > 1.3 * errors[2]
