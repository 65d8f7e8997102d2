import random
import re
from collections import defaultdict

from grovetally.llm import decontaminate as d

DOCS = "doc_id long, text string, item_id string, hash string, matched int"
ITEMS = "item_id long, text string, doc_id int"


def brute_template(text):
    out, last = [], 0
    for m in re.finditer(r"[0-9]+(?:[A-Za-z\x80-\U0010ffff0-9]*(?:[.,](?=[0-9])[0-9A-Za-z\x80-\U0010ffff]+)*)|[A-Za-z0-9\x80-\U0010ffff]+", text):
        w = m[0]
        low = re.sub("[A-Z]", lambda c: c[0].lower(), w)
        opens = not out or re.search('[.!?\n:;"]', text[last : m.start()])
        if w[0] in "0123456789" or low in d.NUMBER_WORDS:
            out.append(("number", low))
        elif low in d.UNIT_WORDS:
            out.append(("unit", low))
        elif not opens and re.match("[A-Z][a-z\x80-\U0010ffff]", w):
            out.append(("name", low))
        else:
            out.append((low, None))
        last = m.end()
    return out


def cuts(tokens, size):
    for i in range(len(tokens) - size + 1):
        part = tokens[i : i + size]
        if sum(v is None for _, v in part) >= d.LITERAL * size:
            yield i, tuple(t for t, _ in part), [v for _, v in part if v is not None]


def brute(docs, items, coverage=0.3):
    index, windows = defaultdict(list), {}
    for item, text in items:
        tokens = brute_template(text or "")
        found = list(cuts(tokens, min(len(tokens), d.WINDOW))) if len(tokens) >= d.SHORTEST else []
        windows[item] = len(found)
        for i, t, v in found:
            index[t].append((item, i, v))
    out = set()
    for doc, text in docs:
        tokens = brute_template(text or "")
        lines = defaultdict(dict)
        for size in range(d.SHORTEST, d.WINDOW + 1):
            for i, t, v in cuts(tokens, size):
                for item, k, own in index.get(t, []):
                    lines[item, i - k][k] = set(zip(own, v))
        covered = defaultdict(set)
        for (item, _), line in lines.items():
            votes = defaultdict(list)
            for k, slots in line.items():
                for pair in slots:
                    votes[pair].append(k)
            best = {}
            for (a, b), at in votes.items():
                best[a] = max(best.get(a, (0,)), (len(at), a == b, -min(at), b))
            meant = {(a, x[3]) for a, x in best.items()}
            covered[item] |= {k for k, slots in line.items() if slots <= meant or all(a == b for a, b in slots)}
        out |= {(doc, item) for item, some in covered.items() if len(some) >= coverage * windows[item]}
    return out


QUESTION = "If a train leaves Boston with 120 people and gains 3.5 people every 2 hours, then how many people does the train that left Boston carry after 120 hours of travel"


def made():
    rng = random.Random(6)
    words = ["w%s" % "".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(500)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(rng.randint(9, 50)).capitalize() + ".") for i in range(30)] + [(100, QUESTION), (101, None), (102, "Er."), (103, "What is 2 2 2 2 2 2 2 2"), (104, "")]
    docs = [(i, say(rng.randint(1, 300))) for i in range(150)]
    for i in range(60):
        item = items[i % 30][1]
        text = item if i % 3 else re.sub(r"(\w+) (\w+)", r"\1, \2", item.upper())
        docs.append((1000 + i, say(30) + " " + text + " " + say(20)))
    again = QUESTION.replace("Boston", "Lyon").replace("120", "77").replace("3.5", "1,000.25")
    docs += [(2000, say(9) + " " + again), (2001, again.replace("77 hours", "78 hours").replace("that left Lyon", "that left Oslo")), (2002, "What is 3 3 3 3 3 3 3 3 " + say(9))]
    docs += [(None, items[3][1]), (3000, None), (3000, ""), (3001, items[4][1]), (3001, items[4][1]), (3002, (say(50) + "\n") * 3000 + items[5][1])]
    return docs, items


def test_against_brute_force(spark):
    docs, items = made()
    frame = spark.createDataFrame([(i, t, "", "", 0) for i, t in docs], DOCS)
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS)
    got = d.contaminated(spark, frame, bench).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert found == brute(docs, items)
    assert {(1000 + i, i % 30) for i in range(60)} <= found and {(2000, 100), (2001, 100)} <= found
    assert not any(i is not None and i < 1000 for i, _ in found)
    assert [r.reparameterised for r in got if r.doc_id == 2000] == [True] and len(got) == len(found)
    left = d.remove_contaminated(spark, frame, bench)
    assert left.columns == frame.columns
    bad = {i for i, _ in found}
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i, _ in docs if i not in bad)


def test_windows_that_contradict_the_rest_do_not_count(spark):
    item = "the crew of Alba took 12 boats from the pier of Alba to the fair and the mayor of Alba then paid 12 coins"
    moved = item.replace("Alba", "Brno")
    docs = spark.createDataFrame([(1, moved, "", "", 0), (2, moved.replace("mayor of Brno", "mayor of Cork"), "", "", 0)], DOCS)
    got = {r.doc_id: (r.matched, r.item_windows, r.reparameterised) for r in d.contaminated(spark, docs, spark.createDataFrame([(7, item, 0)], ITEMS)).collect()}
    assert got == {1: (17, 17, True), 2: (12, 17, True)}


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c d e f g h i", "", "", 0)], DOCS), spark.createDataFrame([(1, "a b c d e f g h i", 0)], ITEMS)
    assert d.contaminated(spark, docs.limit(0), items).count() == 0
    assert d.contaminated(spark, docs, items.limit(0)).count() == 0
    assert d.remove_contaminated(spark, docs, items.limit(0)).count() == 1
    assert d.contaminated(spark, docs, items).count() == 1


def test_one_changed_value_leaves_the_verbatim_rest(spark):
    rng = random.Random(9)
    say = lambda n: " ".join("w" + "".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    item = f"{say(40)} two {say(40)} two {say(40)}"
    near = item[::-1].replace("owt", "eerht", 1)[::-1]
    docs = spark.createDataFrame([(1, near, "", "", 0), (2, say(130), "", "", 0)], DOCS)
    bench = spark.createDataFrame([(7, item, 0)], ITEMS)
    got = d.contaminated(spark, docs, bench).collect()
    assert [(r.doc_id, r.item_id, r.matched, r.item_windows, r.reparameterised) for r in got] == [(1, 7, 107, 115, False)]
    assert [r.doc_id for r in d.remove_contaminated(spark, docs, bench).collect()] == [2]


def test_verbatim_copies_of_dense_and_short_items(spark):
    items = [(1, "What is 12 + 34 - 5 * 6?"), (2, "What is 2 2 2 2 2 2 2 2"), (3, "Name Paris twice"), (4, "Anna likes the blue door"), (5, "これは一つの文です"), (6, "!?")]
    docs = [(10 + i, f"so they said then {t} or not, {t}") for i, t in items[:5]]
    docs += [(21, "so what is 12 + 34 - 5 * 7 then"), (22, "what is 3 3 3 3 3 3 3 3"), (23, "Name London twice"), (24, "they like the blue door"), (25, "これは二つの文です"), (26, "!? what")]
    frame = spark.createDataFrame([(i, t, "", "", 0) for i, t in docs], DOCS)
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS)
    got = d.contaminated(spark, frame, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.reparameterised) for r in got) == [(10 + i, i, False) for i in range(1, 6)]
    assert all(r.matched <= r.item_windows for r in got)
    assert sorted(r.doc_id for r in d.remove_contaminated(spark, frame, bench).collect()) == list(range(21, 27))
