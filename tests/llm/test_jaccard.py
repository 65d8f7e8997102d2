import random

from grovetally.llm import jaccard

SCHEMA = "doc_id long, text string, node string, n int, component_id int"


def brute(rows, size=4, percent=85):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if len(words) >= size else frozenset([tuple(words)] if words else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for i, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for g in s for j in by[g] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        if doc is not None:
            least[r] = min(doc, least.get(r, doc))
    return sorted(((doc, len(sets[i]), least.get(find(i))) for i, (doc, _) in enumerate(rows)), key=repr)


def made(seed, n=500):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    say = lambda k: [rng.choice(words) for _ in range(k)]
    passage, line = say(60), say(6)
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.35 or not texts:
            t = say(rng.choice([1, 2, 3, 4, 5, 9, 10, 30, 90, 300]))
        elif kind < 0.5:
            t = say(20) + passage + say(rng.randint(0, 40))
        elif kind < 0.6:
            t = line * rng.randint(1, 9) + say(rng.randint(0, 2))
        else:
            t = list(rng.choice(texts[-40:]))
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(words)
            if rng.random() < 0.3:
                t = t[: rng.randint(1, len(t))] if rng.random() < 0.5 else t + say(rng.randint(1, 6))
        texts.append(t)
    hot = say(80)
    for _ in range(150):
        t = list(hot)
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(t)
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(t).title()) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def run(spark, rows, **more):
    frame = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)
    return sorted((tuple(r) for r in jaccard.join_sets(spark, frame, **more).collect()), key=repr)


def test_against_all_pairs(spark):
    rows = made(1)
    rows += [(9000, None), (9001, ""), (None, rows[0][1]), (None, None), (9002, " \n"), rows[5], rows[5], (None, "only here once no id"), (9003, ("long words " * 3 + "é ") * 9000), (9004, ("long words " * 3 + "é ") * 9000 + "end")]
    got = run(spark, rows)
    assert got == brute(rows)
    assert len({c for *_, c in got}) < len(rows) - 150


def test_other_sizes(spark):
    rows = made(2, 150)
    assert run(spark, rows, size=5, percent=80) == brute(rows, 5, 80)


def test_small_tables(spark):
    for rows in ([], [(1, None)], [(2, "a b c d e"), (1, "A B C D E")], [(None, "a b c d")] * 2):
        assert run(spark, rows) == brute(rows)
