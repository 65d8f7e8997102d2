"""N-gram Jaccard join by vertical partitioning.

The distinct shingles of all texts have one global order: by hash, with those that
many texts share last.  It is cut into fragments.  A set's own first fragment is its
first ``n - ceil(t n) + 1`` shingles: two sets that link share one of them.  Groups
by shingle of these give candidate pairs.  For those the order of hashes is cut into
``FRAGMENTS`` fragments; each fragment's part of the sets is compared on its own, and
the partial overlaps are summed per pair and held against the threshold.

Groups of near copies are not expanded into pairs.  Within a shingle and a class of
sizes every node is first compared with the group's leader; components of the links
found are then contracted, and only pairs across components remain, which all go the
way above.  So components are those of the full set of links.

Outlines drop pairs that cannot link before their sets are sent: how many shingles
of a set fall into each of 64 to 1024 stretches of the order of hashes bounds the
difference of two sets.

The order needs only be the same for all texts.  Shingles are marked as shared if a
chunk of texts holds them several times, then if the first fragments under that
order hold them several times over the whole table; a mark is a bit of a bitmap whose
size follows the number of marks up to 2**MOST_BITS, beyond which more shingles count
as shared than are.  A second bitmap of the shingles that two first fragments hold
keeps the rest from moving.  Both only say which rows come first or move, so results
do not depend on them.  Nothing is capped: a shingle's group may have any size.

Texts are read once; their sorted sets are kept as a table in the shared folder.

Defined cases.  Words are lower-cased (A-Z) runs of non-space.  A text of fewer
words than a shingle is one shingle of all of them; a text without words, or null,
has the empty set and links with nothing.  Components carry their least id, nulls
aside.  Repeated rows are copies.  Extra columns are ignored; an empty table gives
no rows.  Nodes are known by 64-bit hashes of their sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bitmap
from .components import components
from .tokens import Words, buffers, mix, slices, tidy
from .workspace import Workspace

FRAGMENTS = 4
#: Shingles in this many texts of a chunk of this many shingles count as shared, and so do those in this many first fragments of all.
COMMON, COUNTED = 4, 1 << 19
LEAST_BITS, MOST_BITS = 20, 27
#: Pairs compared by one task in one fragment, on average, and bytes of sets in one batch.
PAIRS, HELD = 5_000, 2 << 20


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct shingle hashes of every text."""
    factors = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    for first, part in slices(column):
        words = Words(part)
        h, n = words.hash, max(0, len(words.hash) - size + 1)
        every = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            every += h[k : k + n] * factors[k]
        every = mix(every)
        for row, (a, b) in enumerate(zip(words.first[:-1], words.first[1:])):
            if b - a >= size:
                s = np.sort(every[a : b - size + 1])
                yield first + row, s[np.concatenate([[True], s[1:] != s[:-1]])]
            elif b > a:
                yield first + row, mix((h[a:b] * factors[: b - a]).sum(keepdims=True) + np.uint64(b - a))
            else:
                yield first + row, h[:0]


def node_of(s: np.ndarray) -> int:
    """A hash of a whole set."""
    return int(mix(np.array([mix(s + np.uint64(0xA5A5)).sum() + np.uint64(len(s))], dtype=np.uint64)).view(np.int64)[0])


def outline(s: np.ndarray) -> bytes:
    """How many shingles fall into each of equal stretches of the order of hashes, more for large sets."""
    bits = 6 if len(s) < 1500 else 8 if len(s) < 8000 else 10
    return np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint16).tobytes()


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """id, row (a number of its own), node, n, outline and sorted shingles of each row, and rows of n = -1 with shingles common in a chunk."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, seen, rows = [], 0, set(), TaskContext.get().partitionId() << 33

        def common() -> list[int]:
            s = np.sort(np.concatenate(held))
            starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            times = np.diff(np.concatenate([starts, [len(s)]]))
            return s[starts[times >= COMMON]].view(np.int64).tolist()

        def told(ids: pa.Array, nodes: list, sizes: list, outlines: list, shingles: list, common: list | None = None) -> pa.RecordBatch:
            nonlocal rows
            own = mix(np.arange(rows, rows + len(ids), dtype=np.uint64)).view(np.int64)
            rows += len(ids)
            columns = [ids, pa.array(own), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(outlines, pa.binary()), pa.array(shingles, pa.binary())]
            columns.append(pa.nulls(len(ids), pa.list_(pa.int64())) if common is None else pa.array([common], pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(columns, names=["id", "row", "node", "n", "outline", "shingles", "common"])

        for batch in tidy(batches):
            kind = batch.column(0).type
            nodes, sizes, outlines, shingles, first, full = [], [], [], [], 0, 0
            for row, s in shingle_sets(batch.column(1), size):
                nodes.append(node_of(s))
                sizes.append(len(s))
                outlines.append(outline(s))
                shingles.append(s.tobytes())
                full += s.nbytes
                if full >= HELD or row + 1 == batch.num_rows:
                    yield told(batch.column(0).slice(first, row + 1 - first), nodes, sizes, outlines, shingles)
                    if full >= HELD:
                        nodes, sizes, outlines, shingles, first, full = [], [], [], [], row + 1, 0
                if len(s) and (node := node_of(s)) not in seen:
                    seen.add(node)
                    held.append(s)
                    count += len(s)
                    if count >= COUNTED:
                        yield told(pa.nulls(1, kind), [0], [-1], [None], [None], common())
                        held, count, seen = [], 0, set()
        if held:
            yield told(pa.nulls(1, kind), [0], [-1], [None], [None], common())

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(read, f"id {kind}, row long, node long, n long, outline binary, shingles binary, common array<long>")


def _first_fragments(sets: DataFrame, percent: int, lone: np.ndarray, marked: np.ndarray, held: np.ndarray | None = None) -> DataFrame:
    """The shingle of every place of every set's first fragment; where ``held`` has it, with node, n and place.

    Smaller sets only link with equals and have none.  Of equal sets the row in ``lone`` has them, and now and then another.
    """
    context = sets.sparkSession.sparkContext
    first, order, move = context.broadcast(lone), context.broadcast(marked), context.broadcast(held)
    least = math.ceil(percent / (100 - percent))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            for at, part in slices(batch.column(3), HELD):
                rows, nodes, n = (batch.column(i).slice(at, len(part)).to_numpy() for i in (0, 1, 2))
                fresh = (n >= least) & bitmap.test(first.value, rows.view(np.uint64))
                if not fresh.any():
                    continue
                part, nodes, n = part.filter(pa.array(fresh)), nodes[fresh], n[fresh]
                bytes_, ends = buffers(part)
                s, ends = bytes_.view(np.uint64), ends // 8
                last = bitmap.test(order.value, s)
                # A shingle's place: unmarked ones in order of hashes, then marked ones.
                before = np.concatenate([[0], np.cumsum(~last)])
                row = np.repeat(np.arange(len(n)), n)
                own = before[:-1] - before[ends[:-1]][row]
                unmarked = (before[ends[1:]] - before[ends[:-1]])[row]
                place = np.where(last, unmarked + np.arange(len(s)) - ends[:-1][row] - own, own)
                kept = place < (n - (percent * n + 99) // 100 + 1)[row]
                if move.value is None:
                    yield pa.RecordBatch.from_arrays([pa.array(s[kept].view(np.int64))], names=["shingle"])
                else:
                    kept[kept] = bitmap.test(move.value, s[kept])
                    columns = (s[kept].view(np.int64), nodes[row[kept]], n[row[kept]], place[kept])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shingle", "node", "n", "place"])

    rows = sets.select("row", "node", "n", "shingles")
    return rows.mapInArrow(read, "shingle long" if held is None else "shingle long, node long, n long, place long")


def _bitmap_of(shingles: DataFrame, ws: Workspace, name: str) -> np.ndarray:
    """A bitmap of about sixteen bits for each shingle, up to 2**MOST_BITS."""
    kept = ws.keep(shingles, name)
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * kept.count()).bit_length()))
    return bitmap.build(kept, kept.columns[0], bits)


def _fits(percent: int):
    """May sets of na and nb shingles link by size alone?"""
    return 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")


def _plausible(pairs: DataFrame, outlines: DataFrame, percent: int) -> DataFrame:
    """Pairs whose outlines may belong to sets that link.

    Counts that differ within a stretch stand for as many shingles in one set
    only, so the sum of differences never exceeds the sets' difference.
    """
    sides = [outlines.select(F.col("node").alias(x), F.col("outline").alias(f"o{x}")) for x in "ab"]
    joined = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "na", "b", "nb", "oa", "ob")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            texts = [batch.column(x).to_pylist() for x in ("oa", "ob")]
            lengths = np.array([[len(t) // 2 for t in side] for side in texts]).reshape(2, -1)
            apart = np.zeros(batch.num_rows, dtype=np.int64)
            for la, lb in {tuple(x) for x in lengths.T.tolist()}:
                rows = np.flatnonzero((lengths[0] == la) & (lengths[1] == lb))
                fold = min(la, lb)
                counts = [np.frombuffer(b"".join(side[i] for i in rows), np.uint16).reshape(len(rows), fold, -1).sum(2, dtype=np.int64) for side in texts]
                apart[rows] = np.abs(counts[0] - counts[1]).sum(1)
            both = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            # |x and y| is at most (|x| + |y| - apart) / 2, |x or y| at least (|x| + |y| + apart) / 2.
            yield batch.filter(pa.array(100 * (both - apart) >= percent * (both + apart))).select(["a", "na", "b", "nb"])

    return joined.mapInArrow(read, "a long, na long, b long, nb long")


def _nodes_of(need: DataFrame) -> np.ndarray:
    return bitmap.build(need, "node", min(MOST_BITS, max(LEAST_BITS, (16 * need.count()).bit_length())))


def _linked(sets: DataFrame, pairs: DataFrame, percent: int, ws: Workspace, name: str) -> DataFrame:
    """Those of ``pairs`` (a, na, b, nb) whose summed partial overlaps reach the threshold."""
    pairs = ws.keep(pairs, f"{name}pairs")
    count = pairs.count()
    if not count:
        return pairs.select("a", "b")
    parts = max(1, -(-count // PAIRS))
    # The pairs of one b are split where they are more than a task's share.
    many = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > PAIRS).select("b", F.ceil(F.col("m") / PAIRS).alias("split"))
    salt = F.pmod(F.xxhash64("a"), F.coalesce("split", F.lit(1)))
    pairs = pairs.join(many, "b", "left").select("a", "na", "b", "nb", F.pmod(F.xxhash64("b", salt), F.lit(parts)).cast("int").alias("part"))
    need = ws.keep(pairs.select("part", F.explode(F.array("a", "b")).alias("node")).distinct(), f"{name}need")
    wanted = sets.sparkSession.sparkContext.broadcast(_nodes_of(need))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, seen = (np.arange(1, FRAGMENTS, dtype=np.uint64) << np.uint64(64 - FRAGMENTS.bit_length() + 1)), set()
        for batch in tidy(batches):
            rows, held = [], 0
            nodes = batch.column(0).to_numpy()
            for i in np.flatnonzero(bitmap.test(wanted.value, nodes.view(np.uint64))):
                node = int(nodes[i])
                if node in seen:
                    continue
                seen.add(node)
                s = np.frombuffer(batch.column(1)[int(i)].as_buffer(), np.uint64)
                for fragment, some in enumerate(np.split(s, np.searchsorted(s, edges))):
                    rows.append((node, fragment, some.tobytes()))
                held += s.nbytes
                if held > HELD:
                    yield packed(rows)
                    rows, held = [], 0
            if rows:
                yield packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names=["node", "fragment", "shingles"])

    def overlaps(left: pa.Table, right: pa.Table) -> pa.Table:
        sets = {n: np.frombuffer(s, np.uint64) for n, s in zip(left["node"].to_pylist(), left["shingles"].to_pylist())}
        a, b = right["a"].to_pylist(), right["b"].to_pylist()
        shared = [len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b)]
        return pa.table({"a": right["a"], "b": right["b"], "shared": pa.array(shared, pa.int64())})

    fragments = sets.select("node", "shingles").mapInArrow(cut, "node long, fragment int, shingles binary").join(need, "node").select("part", "fragment", "node", "shingles")
    numbers = F.explode(F.array(*(F.lit(i) for i in range(FRAGMENTS))))
    asked = pairs.select("part", numbers.alias("fragment"), "a", "b")
    partial = fragments.groupBy("part", "fragment").cogroup(asked.groupBy("part", "fragment")).applyInArrow(overlaps, "a long, b long, shared long")
    whole = partial.groupBy("a", "b").agg(F.sum("shared").alias("shared")).join(pairs, ["a", "b"])
    linked = whole.filter(100 * F.col("shared") >= percent * (F.col("na") + F.col("nb") - F.col("shared")))
    return ws.keep(linked.select("a", "b"), f"{name}links")


def join_sets(spark: SparkSession, docs: DataFrame, size: int = 4, percent: int = 85, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id, n_shingles and component_id of every row."""
    ws = Workspace(spark, "jaccard")
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    every = ws.keep(_sets(rows, size), "sets")
    sets = every.filter("n >= 0").select("id", "node", "n")
    full = every.filter("n > 0").select("row", "node", "n", "shingles")
    labels = _labels(every, full, percent, ws) if percent < 100 else sets.limit(0).select("node", F.col("node").alias("label"))

    copies = sets.filter("n > 0").groupBy("node").agg(F.min("id").alias("least"))
    named = copies.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    found = ws.keep(named.select("node", "label").join(least, "label").select("node", "component_id"), "found")
    return sets.join(found, "node", "left").select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")
    )


def _shared(every: DataFrame, full: DataFrame, percent: int, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """What first fragments share: pairs of nodes (a, na, b, nb) that a shingle has to themselves, and
    shingle, node, n and place where a shingle has more."""
    marks = every.filter("n = -1").select(F.explode("common").alias("shingle")).distinct()
    lone = _bitmap_of(full.groupBy("node").agg(F.min("row").alias("row")).select("row"), ws, "lone")
    times = lambda marked: _first_fragments(full, percent, lone, marked).groupBy("shingle").agg(F.count(F.lit(1)).alias("times"))
    crowded = times(_bitmap_of(marks, ws, "marks0")).filter(F.col("times") >= COMMON).select("shingle")
    marked = _bitmap_of(crowded.unionByName(marks).distinct(), ws, "marks1")
    held = _bitmap_of(times(marked).filter("times > 1").select("shingle"), ws, "held")
    rows = ws.keep(_first_fragments(full, percent, lone, marked, held), "fragments")
    ends = rows.groupBy("shingle").agg(F.min(F.struct("node", "n")).alias("lo"), F.max(F.struct("node", "n")).alias("hi"), F.count(F.lit(1)).alias("members"))
    ends = ws.keep(ends.filter("lo.node <> hi.node"), "ends")
    pairs = ends.filter("members = 2").select(F.col("lo.node").alias("a"), F.col("lo.n").alias("na"), F.col("hi.node").alias("b"), F.col("hi.n").alias("nb"))
    return pairs, ws.keep(rows.join(ends.filter("members > 2").select("shingle"), "shingle"), "shared")


def _classes(percent: int) -> list[Column]:
    """The two overlapping classes of a size; sets that link share at least one in most cases."""
    step = -math.log(percent / 100)
    return [F.floor(F.log("n") / step).cast("int"), F.floor(F.log("n") / step + 0.5).cast("int") + (1 << 20)]


def _leads(shared: DataFrame, percent: int, ws: Workspace) -> DataFrame:
    """shingle, class and lead (alone, n, node) of every group.

    A group is the nodes of one class of sizes in one shingle; its leader is the set with
    the fewest shingles of its own: of copies with edits the least edited.
    """
    alone = (F.col("n") - F.floor((percent * F.col("n") + 99) / 100) + 1 - F.col("met")).alias("alone")
    met = shared.groupBy("node", "n").agg(F.count(F.lit(1)).alias("met")).select("node", alone)
    ranked = shared.join(met, "node").select("shingle", "node", "n", "alone", F.explode(F.array(*_classes(percent))).alias("class"))
    return ws.keep(ranked.groupBy("shingle", "class").agg(F.min(F.struct("alone", "n", "node")).alias("lead")), "leads")


def _stars(pairs: DataFrame, shared: DataFrame, leads: DataFrame, percent: int, ws: Workspace) -> DataFrame:
    """``pairs``, and those of a leader with every other node of its group."""
    members = shared.select("shingle", "node", "n", F.explode(F.array(*_classes(percent))).alias("class"))
    led = members.join(leads, ["shingle", "class"]).select(F.col("lead.node").alias("a"), F.col("lead.n").alias("na"), F.col("node").alias("b"), F.col("n").alias("nb"))
    return ws.keep(pairs.unionByName(led.filter("a <> b")).filter(_fits(percent)).distinct(), "stars")


def _across(shared: DataFrame, labels: DataFrame, percent: int, ws: Workspace) -> DataFrame:
    """Pairs of nodes of different labels that a shingle of their first fragments brings together.

    A pair is made at the first shingle of a run that both nodes' shared shingles have
    in common, and only where what follows lets the overlap reach the threshold.
    """
    known = shared.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # A node's shared shingles are at most its first fragment.
    known = known.withColumn("before", F.lag("shingle").over(Window.partitionBy("node").orderBy("place")))
    known = ws.keep(known.select("shingle", "node", "n", "place", "label", "before"), "known")
    several = known.groupBy("shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("shingle")
    open_ = ws.keep(known.join(several, "shingle"), "open")
    left, right = (open_.select("shingle", *(F.col(c).alias(c + x) for c in open_.columns if c != "shingle")).withColumnRenamed(f"node{x}", x) for x in "ab")
    after = F.least(F.col("na") - F.col("placea"), F.col("nb") - F.col("placeb"))
    first = F.coalesce(F.col("beforea") != F.col("beforeb"), F.lit(True))
    hopeful = _fits(percent) & ((100 + percent) * after >= percent * (F.col("na") + F.col("nb")))
    met = left.join(right, "shingle").filter((F.col("labela") != F.col("labelb")) & (F.col("a") < F.col("b")) & hopeful & first)
    return met.select("a", "na", "b", "nb").distinct()


def _labels(every: DataFrame, full: DataFrame, percent: int, ws: Workspace) -> DataFrame:
    """node and label of every node that links with another."""
    outlines = every.filter("n > 0").groupBy("node").agg(F.first("outline").alias("outline"))
    pairs, shared = _shared(every, full, percent, ws)
    leads = _leads(shared, percent, ws)
    stars = _stars(pairs, shared, leads, percent, ws)
    first = _linked(full, _plausible(stars, outlines, percent), percent, ws, "star")
    near = ws.keep(components(first, ws, "near"), "near")
    cross = _across(shared, near, percent, ws)
    known = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    cross = cross.join(known, ["a", "b"], "left_anti").select("a", "na", "b", "nb")
    second = _linked(full, _plausible(cross, outlines, percent), percent, ws, "cross")
    return components(first.unionByName(second), ws, "all")
