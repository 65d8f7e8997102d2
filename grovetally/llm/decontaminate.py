"""Benchmark decontamination by template windows.

Texts become templates: words are lower-cased and freed of punctuation, and
numbers, units and names (capitalised inside a sentence) become typed slots that
remember their values.  Windows of ``WINDOW`` template tokens of all documents are
hash-joined with those of all items, so a question asked again with other numbers
or names still matches.  Along one alignment of document and item, equal slot
values of the item must stand for equal values in the document: windows whose slots
go against what most windows of the alignment say do not count, but those with the
item's own values always do.  A
document is contaminated by an item when such windows cover ``coverage`` of the item's.

A fixed-size bitmap of the items' window hashes goes to the executors and lets
only windows through that may match; what passes is joined by hash, so neither
table has to fit anywhere.  Nothing but passing windows is shuffled.

Templates of few tokens or of mostly slots say too little, so what they would lose
is compared by value: windows with under ``LITERAL`` of their tokens literal, and
items of up to a window as a whole.  These match only where every token is equal,
so a verbatim copy is found whatever an item is made of.

Defined cases.  Null texts are empty; items without a token take no part.  Items
shorter than a window are one window, under ``SHORTEST`` tokens by value only, so
an item of one word is held by every document with that word.  Where an item has
windows of both kinds, ``coverage`` of the template windows is enough, as is that
of all.  A document is its id and
text: rows repeated in both are reported once and removed together, a null id is
reported as null.  Extra columns are ignored by ``contaminated`` and kept by
``remove_contaminated``; empty tables give no matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitmap
from .tokens import MARKS, Words, buffers, mix, slices, tidy
from .workspace import Workspace

WINDOW, SHORTEST, LITERAL = 8, 5, 0.6
BITMAP_BITS = 25

# Words that count as numbers and as units.
NUMBER_WORDS = """zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen
seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion
half third quarter dozen""".split()
UNIT_WORDS = """mm cm km kg mg lb lbs oz ft kmh mph hz khz mhz ghz kb mb gb tb ml kw kwh volt volts watt watts joule joules
meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters centimetre centimetres mile miles
inch inches foot feet yard yards acre acres gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes
liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years
dollar dollars cent cents euro euros percent degree degrees celsius fahrenheit usd eur gbp""".split()

_NUMBER, _UNIT, _NAME = (np.uint64(x) for x in (0x6E756D626572, 0x756E6974, 0x6E616D65))
_FACTORS = mix(np.arange(1, WINDOW + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
#: Sets hashes of windows by value apart from those of templates.
_EXACT = 1 << 20
_DIGIT = np.array([48 <= b < 58 for b in range(256)])
_UPPER = np.array([65 <= b < 91 for b in range(256)])
_SMALL = np.array([97 <= b < 123 or b >= 128 for b in range(256)])
_STOP = np.array([chr(b) in ".!?\n:;\"" for b in range(256)])


def _hashes_of(words: list[str]) -> np.ndarray:
    return np.sort(Words(pa.array(words), (), MARKS).hash)


_NUMBERS, _UNITS = _hashes_of(NUMBER_WORDS), _hashes_of(UNIT_WORDS)


def _among(x: np.ndarray, found: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(found, x), len(found) - 1)
    return found[at] == x


class Templates:
    """Template tokens of a batch: ``token`` hash, whether it is a ``slot``, its ``value`` hash, and first token of each row."""

    def __init__(self, column: pa.Array):
        words = Words(column, (), MARKS)
        raw, _ = buffers(column)
        start, end, row = words.start, words.end, words.row
        n = len(start)
        if n == 0:
            self.token = self.value = np.zeros(0, np.uint64)
            self.slot, self.first = np.zeros(0, bool), np.zeros(len(column) + 1, np.int64)
            return
        same = np.zeros(n, dtype=bool)
        same[1:] = row[1:] == row[:-1]
        before = np.where(same, np.concatenate([[0], end[:-1]]), start)
        stops = np.concatenate([[0], np.cumsum(_STOP[raw])])
        opens = ~same | (stops[start] > stops[before])
        second = raw[np.minimum(start + 1, len(raw) - 1)]
        number = _DIGIT[raw[start]] | _among(words.hash, _NUMBERS)
        unit = ~number & _among(words.hash, _UNITS)
        name = ~number & ~unit & ~opens & _UPPER[raw[start]] & (end - start > 1) & _SMALL[second]
        token = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, words.hash)))
        # 1,234.5 is one number: digits after a single comma or point join those before.
        digits = _DIGIT[raw[start]]
        mark = raw[np.maximum(start - 1, 0)]
        joins = np.zeros(n, dtype=bool)
        joins[1:] = same[1:] & digits[1:] & digits[:-1] & (start[1:] - end[:-1] == 1) & ((mark[1:] == 44) | (mark[1:] == 46))
        heads = np.flatnonzero(~joins)
        group = np.cumsum(~joins) - 1
        depth = np.arange(n) - heads[group]
        value = np.add.reduceat(words.hash * (2 * depth.astype(np.uint64) + np.uint64(1)), heads)
        self.token, self.value, self.slot = token[heads], value, (number | unit | name)[heads]
        self.first = np.searchsorted(heads, words.first)

    def windows(self, size: int, exact: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, row and first token of all windows of ``size`` with enough literal tokens; if ``exact``, of all, by value."""
        n = len(self.token) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            h += (self.value if exact else self.token)[k : k + n] * _FACTORS[k]
        row = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        good = row[:n] == row[size - 1 :][:n]
        at = np.flatnonzero(good if exact else good & self.literal(size))
        return mix(h[at] + np.uint64(size + (_EXACT if exact else 0))), row[at], at

    def literal(self, size: int) -> np.ndarray:
        """Whether the window of ``size`` from each token has enough literal ones."""
        slots = np.concatenate([[0], np.cumsum(self.slot)])
        return size - (slots[size:] - slots[:-size]) >= LITERAL * size

    def values(self, at: np.ndarray, size: int) -> list[list[int]]:
        signed = self.value.view(np.int64)
        return [signed[i : i + size][self.slot[i : i + size]].tolist() for i in at]


def _rows(found: list[tuple]) -> pa.RecordBatch:
    ids, hashes, positions, values = zip(*found)
    return pa.RecordBatch.from_arrays(
        [pa.concat_arrays(ids), pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(positions).astype(np.int32)), pa.array([v for vs in values for v in vs], pa.list_(pa.int64()))],
        names=["id", "hash", "at", "values"],
    )


def _item_windows(items: DataFrame, id_column: str, text_column: str) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            t = Templates(batch.column(1))
            count = np.diff(t.first)
            found, exact = [], []
            for size in range(SHORTEST, WINDOW + 1):
                hashes, row, at = t.windows(size)
                use = count[row] == size if size < WINDOW else np.ones(len(row), bool)
                hashes, row, at = hashes[use], row[use], at[use]
                if len(row):
                    found.append((batch.column(0).take(pa.array(row)), hashes, at - t.first[row], t.values(at, size)))
                    exact += [0] * len(row)
            for size in range(1, WINDOW + 1):
                hashes, row, at = t.windows(size, exact=True)
                use = count[row] == size if size < WINDOW else (count[row] == size) | ~t.literal(size)[at]
                hashes, row, at = hashes[use], row[use], at[use]
                if len(row):
                    found.append((batch.column(0).take(pa.array(row)), hashes, at - t.first[row], [[]] * len(row)))
                    exact += [size] * len(row)
            if found:
                out = _rows(found)
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(exact, pa.int32())], names=[*out.schema.names, "exact"])

    rows = items.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return rows.mapInArrow(cut, f"id {rows.schema['id'].dataType.simpleString()}, hash long, at int, values array<long>, exact int")


def _meant(met: Column) -> Column:
    """Of each slot value of an item the value that stands for it along an alignment: that of most
    windows, of equally many the item's own, then the first one."""
    # One row is one alignment, so these arrays hold an item's slots and no more.
    pairs = F.flatten(F.transform(met, lambda m: F.transform(F.array_distinct(m["slots"]), lambda s: F.struct(s.alias("s"), m["window"]["item_at"].alias("at")))))
    alike = lambda s: F.filter(pairs, lambda x: x["s"] == s)
    ranked = F.transform(
        F.array_distinct(F.transform(pairs, lambda x: x["s"])),
        lambda s: F.struct(F.size(alike(s)).alias("n"), (s["item_values"] == s["values"]).alias("own"), (-F.array_min(F.transform(alike(s), lambda x: x["at"]))).alias("first"), s.alias("s")),
    )
    return F.transform(F.filter(ranked, lambda r: ~F.exists(ranked, lambda o: (o["s"]["item_values"] == r["s"]["item_values"]) & (o > r))), lambda r: r["s"])


def contaminated(
    spark: SparkSession, docs: DataFrame, items: DataFrame, coverage: float = 0.3, id_column: str = "doc_id", item_column: str = "item_id", text_column: str = "text"
) -> DataFrame:
    """Matching pairs: doc id, ``text_hash``, item id, matched and all windows of the item, re-parameterised or not."""
    ws = Workspace(spark, "decontaminate")
    theirs = ws.keep(_item_windows(items, item_column, text_column), "items")
    shared = spark.sparkContext.broadcast(bitmap.build(theirs, "hash", BITMAP_BITS))
    by_value = sorted(r["exact"] for r in theirs.filter("exact > 0").select("exact").distinct().collect())

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, hashed, part in ((b.column(0).slice(first, len(part)), b.column(1).slice(first, len(part)), part) for b in tidy(batches) for first, part in slices(b.column(2))):
            t = Templates(part)
            found, texts = [], []
            for size, exact in [(size, False) for size in range(SHORTEST, WINDOW + 1)] + [(size, True) for size in by_value]:
                hashes, row, at = t.windows(size, exact)
                use = np.flatnonzero(bitmap.test(shared.value, hashes))
                if exact and size < WINDOW and len(use):
                    # A whole item is held once or more often alike.
                    use = use[np.unique(np.stack([row[use].astype(np.uint64), hashes[use]]), axis=1, return_index=True)[1]]
                if len(use):
                    rows = pa.array(row[use])
                    found.append((ids.take(rows), hashes[use], at[use] - t.first[row[use]], [[]] * len(use) if exact else t.values(at[use], size)))
                    texts.append(hashed.take(rows))
            if found:
                out = _rows(found)
                yield pa.RecordBatch.from_arrays([*out.columns, pa.concat_arrays(texts)], names=[*out.schema.names, "text_hash"])

    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("text_hash"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    ours = rows.mapInArrow(passing, f"id {kind}, hash long, at int, values array<long>, text_hash long")
    theirs = theirs.select(F.col("id").alias("item"), "hash", F.col("at").alias("item_at"), F.col("values").alias("item_values"), (F.col("exact") == 0).alias("template"))
    sizes = theirs.groupBy("item").agg(F.countDistinct("item_at").alias("item_windows"), F.countDistinct(F.when(F.col("template"), F.col("item_at"))).alias("item_templates"))
    met = ours.join(theirs, "hash").select(
        "id", "text_hash", "item", F.struct("item_at", "template").alias("window"), (F.col("at") - F.col("item_at")).alias("shift"), F.arrays_zip("item_values", "values").alias("slots")
    )
    lines = met.groupBy("id", "text_hash", "item", "shift").agg(F.collect_set(F.struct("window", "slots")).alias("met"))
    lines = lines.withColumn("differs", F.exists("met", lambda m: F.exists(m["slots"], lambda s: s["item_values"] != s["values"])))
    lines = lines.withColumn("meant", F.when(F.col("differs"), _meant(F.col("met"))))
    agrees = lambda m: F.forall(m["slots"], lambda s: s["item_values"] == s["values"])
    follows = lambda m: F.forall(m["slots"], lambda s: F.array_contains("meant", s))
    kept = F.when(F.col("differs"), F.filter("met", lambda m: agrees(m) | follows(m))).otherwise(F.col("met"))
    lines = lines.withColumn("covered", F.transform(kept, lambda m: m["window"]))
    lines = lines.withColumn("changed", F.coalesce(F.exists("meant", lambda s: s["item_values"] != s["values"]), F.lit(False)))
    pairs = lines.filter(F.size("covered") > 0).groupBy("id", "text_hash", "item").agg(
        F.array_distinct(F.flatten(F.collect_list("covered"))).alias("covered"), F.bool_and("changed").alias("reparameterised")
    )
    pairs = pairs.withColumn("matched", F.size(F.array_distinct(F.transform("covered", lambda w: w["item_at"])))).withColumn("templates", F.size(F.filter("covered", lambda w: w["template"])))
    return (
        pairs.join(sizes.withColumnRenamed("item", "_item"), F.col("item").eqNullSafe(F.col("_item")))
        .filter((F.col("matched") >= coverage * F.col("item_windows")) | ((F.col("item_templates") > 0) & (F.col("templates") >= coverage * F.col("item_templates"))))
        .select(F.col("id").alias(id_column), "text_hash", F.col("item").alias(item_column), "matched", "item_windows", "reparameterised")
    )


def remove_contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, coverage: float = 0.3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with all their columns."""
    ws = Workspace(spark, "decontaminated")
    found = contaminated(spark, docs, items, coverage, id_column, text_column=text_column).select(F.col(id_column).alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    found = ws.keep(found, "found")
    return docs.join(found, docs[id_column].eqNullSafe(found["_id"]) & (F.xxhash64(docs[text_column]) == found["_hash"]), "left_anti")
