"""Language identification by Bloom filters that answer with language bitmasks.

Character n-grams of all learning documents are counted per language.  An n-gram
belongs to the languages where its rate is at least ``near`` times its highest
rate and which have it ``least`` times.  The filters of all languages are stored
as one table of bitmasks: position by position, bit by language.  Looking up an
n-gram ANDs the masks at its positions and yields every language that contains
it.  A text's n-grams are looked up whole, the bits are counted per language, and
the counts are corrected for the rate at which each filter answers by chance.

The table has a fixed number of positions whatever the corpus; counts are summed
map-side before they are shuffled, and what reaches the driver is one row per
position in use.

Defined cases.  A text that is null or has no letter is ``und`` with score 0.
Learning rows with null text or language are left out.  Where no language leads,
the one with most learning n-grams is taken, then the first in order.  Without
any learning row every text is ``und``.  Repeated rows count as often as they
occur; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import mix, tidy

N, HASHES, POSITIONS = 4, 2, 1 << 21
CHUNK = 1 << 18
WORD_BITS = 62
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """The lower-case code point of each letter, a space for everything else."""
    table = np.full(0x110000, 32, dtype=np.uint32)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            table[c] = ord(x.lower()[0])
    return table


def _hashed(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the n-gram at every place, and the places of those with a letter."""
    points = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    count = max(0, len(points) - N + 1)
    wide, letter = points.astype(np.uint64), points != 32
    hashes, useful = np.zeros(count, dtype=np.uint64), np.zeros(count, dtype=bool)
    for k in range(N):
        hashes += wide[k : k + count] * _FACTORS[k]
        useful |= letter[k : k + count]
    return hashes, np.flatnonzero(useful)


def grams(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces of texts: (first text, number of texts, rows within them, n-gram hashes).

    A text longer than a piece comes in several, each n-gram in one of them.
    """
    first, gap = 0, " " * (N - 1)
    while first < len(texts):
        if len(texts[first] or "") > CHUNK:
            padded = gap + texts[first] + gap
            for at in range(0, len(padded) - N + 1, CHUNK):
                hashes, useful = _hashed(padded[at : at + CHUNK + N - 1])
                yield first, 1, np.zeros(len(useful), dtype=np.int64), mix(hashes[useful])
            first += 1
            continue
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last] or "") <= CHUNK):
            size += len(texts[last] or "")
            last += 1
        joined = gap + gap.join(t or "" for t in texts[first:last]) + gap
        starts = np.cumsum([N - 1] + [len(t or "") + N - 1 for t in texts[first : last - 1]])
        hashes, at = _hashed(joined)
        # A window belongs to the text that its letters are in; gaps are too long for two.
        rows = np.searchsorted(starts, at + N - 1, "right") - 1
        yield first, last - first, rows, mix(hashes[at])
        first = last


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, gram and n of a task's texts, summed before they leave it."""
    held: dict[str, list] = {}

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(at, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

    for batch in tidy(batches):
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        by_lang: dict[str, list] = {}
        for lang, text in zip(langs, texts):
            by_lang.setdefault(lang, []).append(text)
        for lang, some in by_lang.items():
            parts = held.setdefault(lang, [])
            for _, _, _, hashes in grams(some):
                keys, n = np.unique(hashes, return_counts=True)
                parts.append((keys, n))
                if len(parts) > 24:
                    held[lang] = parts = [merged(parts)]
    for lang, parts in held.items():
        keys, n = merged(parts)
        for k in range(0, len(keys), 1 << 17):
            some = keys[k : k + (1 << 17)].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some), pa.array(n[k : k + (1 << 17)])], names=["lang", "gram", "n"])


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (words, POSITIONS)
    chance: np.ndarray  # false-positive rate of each language
    order: np.ndarray  # rank of each language where counts are equal

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        langs, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return langs, scores
        seen, hits = np.zeros(len(texts)), np.zeros((len(texts), len(self.langs)))
        for first, count, rows, hashes in grams(texts):
            seen[first : first + count] += np.bincount(rows, minlength=count)
            own = hits[first : first + count]
            places = positions(hashes)
            for word, masks in enumerate(self.table):
                found = masks[places[0]]
                for more in places[1:]:
                    found = found & masks[more]
                width = min(WORD_BITS, len(self.langs) - word * WORD_BITS)
                if width <= 8:
                    sums = np.bincount((rows << width) + found, minlength=count << width).reshape(count, 1 << width)
                    bits = (np.arange(1 << width)[:, None] >> np.arange(width)) & 1
                    own[:, word * WORD_BITS :][:, :width] += sums @ bits
                else:
                    for b in range(width):
                        own[:, word * WORD_BITS + b] += np.bincount(rows, weights=(found >> b) & 1, minlength=count)
        fair = np.maximum((hits - seen[:, None] * self.chance) / (1 - self.chance), 0)
        best = np.lexsort((np.broadcast_to(self.order, fair.shape), -fair), axis=1)[:, 0]
        total = fair.sum(axis=1)
        share = np.divide(fair[np.arange(len(texts)), best], total, out=np.full(len(texts), 1.0 / len(self.langs)), where=total > 0)
        for i in np.flatnonzero(seen):
            langs[i], scores[i] = self.langs[best[i]], share[i]
        return langs, scores


def positions(hashes: np.ndarray) -> list[np.ndarray]:
    return [((hashes >> np.uint64(24 * k)) & np.uint64(POSITIONS - 1)).astype(np.int64) for k in range(HASHES)]


def fit(docs: DataFrame, learn: Column, near: float = 0.125, least: int = 3) -> Model:
    """Learn from the rows of ``docs`` (text, lang) that meet ``learn``."""
    rows = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string"), "text")
    counts = rows.mapInArrow(_counted, "lang string, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    # Kept on the executors' side: one row per n-gram with the counts of its languages.
    spread = counts.groupBy("gram").agg(F.collect_list(F.struct("lang", "n")).alias("by"))
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).collect()}
    langs = sorted(totals)
    if not langs:
        return Model([], np.zeros((0, POSITIONS), np.int64), np.zeros(0), np.zeros(0))
    index = F.create_map(*(x for i, lang in enumerate(langs) for x in (F.lit(lang), F.struct(F.lit(i).alias("i"), F.lit(float(max(1, totals[lang]))).alias("total")))))
    rated = F.transform("by", lambda x: F.struct(index[x["lang"]]["i"].alias("i"), x["n"].alias("n"), (x["n"] / index[x["lang"]]["total"]).alias("rate")))
    spread = spread.select("gram", rated.alias("by")).withColumn("top", F.array_max(F.transform("by", lambda x: x["rate"])))
    inside = F.filter("by", lambda x: (x["n"] >= least) & (x["rate"] >= near * F.col("top")))
    bits = spread.select("gram", F.explode(inside).alias("x")).select("gram", F.floor(F.col("x.i") / WORD_BITS).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("x.i") % WORD_BITS).cast("int")).alias("mask"))
    spots = F.array(*(F.shiftrightunsigned("gram", 24 * k).bitwiseAND(F.lit(POSITIONS - 1)) for k in range(HASHES)))
    filled = bits.select("word", "mask", F.explode(spots).alias("at")).groupBy("word", "at").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = -(-len(langs) // WORD_BITS)
    kind = np.uint8 if len(langs) <= 8 else np.int64
    table = np.zeros((words, POSITIONS), dtype=kind)
    table[filled["word"].to_numpy(), filled["at"].to_numpy()] = filled["mask"].to_numpy().astype(kind)
    full = np.array([((table[i // WORD_BITS] >> (i % WORD_BITS)) & 1).mean() for i in range(len(langs))])
    order = np.argsort(np.argsort([-totals[x] for x in langs], kind="stable"))
    return Model(langs, table, np.minimum(full**HASHES, 0.99), order)


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id, lang_pred and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            langs, scores = shared.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores)], names=["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(scored, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", id_column)
