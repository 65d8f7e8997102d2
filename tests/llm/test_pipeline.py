import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from grovetally.llm import secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def folder(spark, tmp_path):
    rng = random.Random(8)
    words = ["w%d" % i for i in range(900)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(25)) for i in range(5)]
    docs = [(i, say(rng.randint(30, 120))) for i in range(400)]
    docs += [(1000 + i, say(20) + " vile rotten fool " + say(30)) for i in range(60)]
    docs += [(2000 + i, docs[i][1] + (" more" if i % 2 else "")) for i in range(40)]
    docs += [(3000 + i, say(40) + " " + items[i % 5][1] + " " + say(10)) for i in range(20)]
    docs += [(4000 + i, say(30) + " password = hunter%d22 " % i + say(30)) for i in range(20)]
    docs += [(5000, None), (5001, "")]
    rows = [(i, t, "en", "s%d" % (i % 3), len(t) if t is not None else None) for i, t in docs]
    labels = [(i, 1, int(1000 <= i < 2000)) for i, _ in docs if i % 2 == 0]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_every_stage_takes_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda frame: {r.doc_id for r in frame.select("doc_id").collect()}
    everything = ids(docs)
    clean = {i for i in everything if i < 1000}
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        path = f"{folder}/{name}.parquet"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        after[name] = docs
        if name != "mix":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    toxic = {i for i in everything if 1000 <= i < 2000}
    assert ids(after["toxicity"]) == everything - toxic
    copies = {i for i in everything if 2000 <= i < 3000}
    assert ids(after["jaccard_join"]) == everything - toxic - copies
    leaked = {i for i in everything if 3000 <= i < 4000}
    assert ids(after["decontaminate"]) == everything - toxic - copies - leaked
    texts = {r.doc_id: (r.text, r.n_chars) for r in after["secrets"].collect()}
    assert texts.keys() == everything - toxic - copies - leaked
    for i in range(4000, 4020):
        assert "hunter" not in texts[i][0] and "[SECRET]" in texts[i][0] and texts[i][1] == len(texts[i][0])
    assert texts[5000] == (None, None) and not any(secrets.text_spans(t) for t, _ in texts.values() if t)
    mixed = after["mix"].collect()
    assert all(r.copies in (1, 2) and r.taken == r.copies * r.size for r in mixed)
    taken = after["mix"].groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target")).collect()
    assert all(abs(r.t - r.target) <= 130 for r in taken)
    assert len(clean & {r.doc_id for r in mixed}) > 300


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.count() > 300 and {"doc_id", "copies", "taken"} <= set(got.columns)
