import random

import numpy as np
from pyspark.sql import functions as F

from grovetally.llm import langid

SYLLABLES = {"aa": "ka to mi re su".split(), "bb": "strö ach ung ein pf".split(), "cc": "ção nho lha é ri".split(), "zz": "кто где мы я не".split()}
SCHEMA = "doc_id long, text string, lang string, lang_pred string, score string"


def made(n=800, langs=tuple(SYLLABLES)):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        lang = rng.choice(langs)
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 80))]
        rows.append((i, " ".join(words).title() + rng.choice(["", ".", " 123"]), lang, "x", "y"))
    return rows


def test_held_out_accuracy_and_brute_force(spark):
    rows = made()
    frame = spark.createDataFrame(rows, SCHEMA)
    learn = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    model = langid.fit(frame, learn)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(frame, model).collect()}
    truth = {r[0]: r[2] for r in rows}
    assert np.mean([got[i][0] == truth[i] for i in got]) > 0.99 and all(0 <= s <= 1 for _, s in got.values())

    import zlib
    from collections import Counter, defaultdict

    counts, totals = defaultdict(Counter), Counter()
    for i, text, lang, *_ in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            padded = "   " + "".join(c.lower() if c.isalpha() else " " for c in text) + "   "
            counts[lang].update(g for k in range(len(padded) - 3) if (g := padded[k : k + 4]).strip())
            totals[lang] += len(text)
    rate = lambda lang, g: counts[lang][g] / totals[lang]
    inside = {lang: {g for g, n in counts[lang].items() if n >= 3 and rate(lang, g) >= 0.125 * max(rate(x, g) for x in counts)} for lang in counts}
    for text in [r[1] for r in rows[:40]]:
        (_, _, at, hashes), = langid.grams([text])
        padded = "   " + "".join(c.lower() if c.isalpha() else " " for c in text) + "   "
        want = [g for k in range(len(padded) - 3) if (g := padded[k : k + 4]).strip()]
        assert len(want) == len(hashes)
        places = langid.positions(hashes)
        masks = model.table[0][places[0]] & model.table[0][places[1]]
        for g, m in zip(want, masks):
            for b, lang in enumerate(model.langs):
                if g in inside[lang]:
                    assert m >> b & 1


def test_undetermined_and_odd_texts(spark):
    rows = made(200) + [(900, None, "aa", None, None), (901, "", "aa", None, None), (902, " 12 ...", None, None, None), (None, "katomi", None, None, None), (903, "x", None, None, None), (904, "kato " * 300_000, None, None, None), (904, "kato", "aa", None, None), (905, "あ", None, None, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    model = langid.fit(frame, F.lit(True))
    got = {(r.doc_id, i): r for i, r in enumerate(langid.predict(frame, model).collect())}
    by = {}
    for r in got.values():
        by.setdefault(r.doc_id, r)
    assert [by[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and by[900].score == 0
    assert by[None].lang_pred == by[904].lang_pred == "aa" and by[903].lang_pred in SYLLABLES and by[905].lang_pred in SYLLABLES
    assert len(got) == len(rows)


def test_no_learning_rows_and_many_languages(spark):
    frame = spark.createDataFrame(made(20), SCHEMA)
    model = langid.fit(frame, F.lit(False))
    assert {r.lang_pred for r in langid.predict(frame, model).collect()} == {"und"}
    assert langid.predict(frame.limit(0), model).count() == 0
    rng = random.Random(1)
    many = [(i, " ".join("".join(chr(0x4E00 + 40 * (i % 70) + rng.randint(0, 4)) for _ in range(6)) for _ in range(30)), f"l{i % 70:02d}", "", "") for i in range(700)]
    frame = spark.createDataFrame(many, SCHEMA)
    model = langid.fit(frame, F.lit(True))
    assert model.table.shape[0] == 2
    assert np.mean([r.lang_pred == f"l{r.doc_id % 70:02d}" for r in langid.predict(frame, model).collect()]) > 0.99


def test_long_texts_come_in_pieces(monkeypatch):
    text = "Kato mi, resu 7 — кто ach " * 900
    (_, _, _, whole), = langid.grams([text])
    monkeypatch.setattr(langid, "CHUNK", 1000)
    pieces = [h for first, count, rows, h in langid.grams(["x", text, None, "y"]) if first == 1]
    assert len(pieces) > 20 and np.array_equal(np.concatenate(pieces), whole)


def test_predictions_against_plain_counts(spark, monkeypatch):
    frame = spark.createDataFrame(made(400), SCHEMA)
    model = langid.fit(frame, F.col("doc_id") % 2 == 0)
    texts = [r[1] for r in made(60)] + ["kato", "12", None, "kato strö " * 700]
    want = []
    for text in texts:
        (_, _, _, hashes), = langid.grams([text])
        hits = [0] * len(model.langs)
        for places in zip(*langid.positions(hashes)):
            mask = int(model.table[0][places[0]])
            for at in places[1:]:
                mask &= int(model.table[0][at])
            for b in range(len(hits)):
                hits[b] += mask >> b & 1
        fair = [max((h - len(hashes) * c) / (1 - c), 0) for h, c in zip(hits, model.chance)]
        best = min(range(len(fair)), key=lambda b: (-fair[b], model.order[b]))
        want.append((model.langs[best], fair[best] / sum(fair) if sum(fair) else 1 / len(fair)) if len(hashes) else ("und", 0.0))
    for chunk in (langid.CHUNK, 500):
        monkeypatch.setattr(langid, "CHUNK", chunk)
        langs, scores = model.predict(texts)
        assert langs == [x for x, _ in want] and np.allclose(scores, [x for _, x in want])
