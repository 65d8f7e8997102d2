import math
import random
from collections import defaultdict

import pytest

from grovetally.llm import mixing


def shares(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Sharing again and again until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, target = set(), {}
    while True:
        left = share * sum(sizes.values()) - sum(most * sizes[s] for s in full)
        open_ = sum(weight[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else left * weight[s] / open_ for s in names}
        above = {s for s in names if s not in full and target[s] > most * sizes[s]}
        if not above:
            return target
        full |= above


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size string, row int, line int")


def made(n=3000):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        source = rng.choice(["hot"] * 5 + ["a", "b", "É", "z", None])
        words = int(rng.paretovariate(1.1) * 20) if source != "z" else 1
        rows.append((i, "w " * min(words, 9000), "en", source, "s", 1, 2))
    rows += [(7, "same text here now", "en", "a", None, None, None)] * 400
    rows += [(None, None, None, None, None, None, None), (1, "", "en", "empty", "", 0, 0), (2, None, None, "empty", None, None, None)]
    return rows


def test_targets_totals_and_limits(spark):
    rows = made()
    got = mixing.mix_sources(spark, table(spark, rows), [3, 1, 2]).collect()
    assert len(got) == len(rows)
    sizes, most = defaultdict(int), defaultdict(int)
    for _, text, _, source, *_ in rows:
        sizes[source] += len((text or "").split())
        most[source] = max(most[source], len((text or "").split()))
    want = shares(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-12, abs_tol=1e-9)
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= most[s], s
    again = mixing.mix_sources(spark, table(spark, rows), [3, 1, 2]).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_rates_solve_the_dual(spark):
    rows = [(i, "w " * n, None, s, None, None, None) for i, (s, n) in enumerate([("a", 5), ("a", 9), ("a", 100), ("b", 30), ("b", 50), ("c", 400), ("c", 20)])]
    got = mixing.mix_sources(spark, table(spark, rows), [3, 1, 2]).collect()
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    for rs in by.values():
        assert math.isclose(sum(r.rate * r.size for r in rs), rs[0].target, rel_tol=1e-7)
        tilts = [math.log(r.rate) / r.size for r in rs if 1e-9 < r.rate < 2 - 1e-7]
        assert all(math.isclose(t, tilts[0], rel_tol=1e-5) for t in tilts)


@pytest.mark.parametrize("rows", [[], [(None,) * 7], [(1, "a b", "x", "s", "", 1, 1)]])
def test_small_tables(spark, rows):
    got = mixing.mix_sources(spark, table(spark, rows), [3, 1, 2]).collect()
    assert len(got) == len(rows)
