"""Nearest neighbours by additive quantisation.

A vector is approximated by a sum of one full-dimensional codeword from each of
``books`` codebooks.  Codebooks start as k-means on residuals and are refitted by
least squares as long as that brings the sample nearer; vectors are encoded by beam search over the codebooks in order.
An index row holds the codes, the squared norm of the approximation and that of
what it misses.  A query is scored against all rows by lookup tables (inner
products of the query with every codeword) and the stored norms, and the nearest
by that score are ranked again exactly, in double precision, on the original
vectors: the ``rerank`` best and every row that could still be among the ``k``
nearest if its error were ``z`` standard deviations.  So a group of near copies,
which codes cannot tell apart, is ranked exactly whatever its size.

Codebooks are fitted on a bounded sample (``sample`` rows of least id hash); every
row is indexed.  Queries stream past the index in blocks: each task holds a chunk
of index rows and reads the queries, written to the shared folder, block by block.

Defined cases.  Rows with a null id, and vectors that are null, zero, or hold null
or non-finite components, take no part, nor do vectors of another length than the
most common one (the longest of equally common).  A query row is compared with
every row but itself, so rows that share an id are queries of their own and find
each other.  Ties go to the smaller id.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokens import tidy
from .workspace import Workspace

CHUNK, BLOCK = 1 << 16, 1 << 10


@dataclass
class Codebooks:
    """``words`` (books, size, dim), their squared norms and all inner products."""

    words: np.ndarray

    def __post_init__(self):
        books, size, dim = self.words.shape
        self.flat = np.ascontiguousarray(self.words.reshape(books * size, dim), dtype=np.float32)
        self.norms = (self.flat**2).sum(1).reshape(books, size)
        self.gram = self.flat @ self.flat.T

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.words[m][codes[:, m]] for m in range(len(self.words)))

    def encode(self, x: np.ndarray, beam: int = 8, step: int = 512) -> np.ndarray:
        """Beam search: the best ``beam`` partial sums go on to the next codebook."""
        books, size, _ = self.words.shape
        out = np.empty((len(x), books), dtype=np.uint8)
        for lo in range(0, len(x), step):
            part = np.ascontiguousarray(x[lo : lo + step], dtype=np.float32)
            inner = (part @ self.flat.T).reshape(len(part), books, size)
            every = np.arange(len(part))[:, None]
            codes, cost = np.zeros((len(part), 1, 0), dtype=np.int64), np.zeros((len(part), 1), dtype=np.float32)
            for m in range(books):
                own = self.norms[m] - 2 * inner[:, m]
                grown = cost[:, :, None] + own[:, None, :]
                for j in range(m):
                    grown += 2 * self.gram[j * size + codes[:, :, j], m * size : (m + 1) * size]
                grown = grown.reshape(len(part), -1)
                keep = min(beam if m < books - 1 else 1, grown.shape[1])
                best = np.argpartition(grown, keep - 1, axis=1)[:, :keep]
                cost = grown[every, best]
                codes = np.concatenate([codes[every, best // size], (best % size)[:, :, None]], axis=2)
            out[lo : lo + step] = codes[:, 0]
        return out


def _kmeans(x: np.ndarray, size: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), size, replace=len(x) < size)].copy()
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
        count = np.bincount(near, minlength=size)
        sums = np.zeros_like(centres)
        order = np.argsort(near, kind="stable")
        ends = np.searchsorted(near[order], np.arange(size))
        full = count > 0
        sums[full] = np.add.reduceat(x[order], ends[full], axis=0)
        centres[full] = sums[full] / count[full, None]
        centres[~full] = x[rng.choice(len(x), (~full).sum())]
    return centres


def train(x: np.ndarray, books: int = 8, size: int = 256, refits: int = 2, seed: int = 7) -> Codebooks:
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    size = int(min(size, max(1, len(x) // 4)))
    rest, words = x.copy(), []
    for _ in range(books):
        centres = _kmeans(rest, size, rng)
        words.append(centres)
        rest -= centres[np.argmin((centres**2).sum(1) - 2 * rest @ centres.T, axis=1)]
    model = Codebooks(np.stack(words))
    codes, best = model.encode(x), np.inf
    for _ in range(refits + 1):
        missed = float(((x - model.decode(codes)) ** 2).sum())
        if missed >= best:
            return kept
        best, kept = missed, model
        at = codes.astype(np.int64) + np.arange(books) * size
        counts = np.zeros((books * size, books * size), dtype=np.float32)
        for i in range(books):
            for j in range(books):
                np.add.at(counts, (at[:, i], at[:, j]), 1)
        sums = np.zeros((books * size, x.shape[1]), dtype=np.float32)
        for i in range(books):
            np.add.at(sums, at[:, i], x)
        # Towards the words as they are, so unused ones stay and the system is regular.
        pull = 1e-2 * max(1.0, len(x) / size / 100)
        fitted = np.linalg.solve((counts + pull * np.eye(books * size)).astype(np.float64), sums + pull * model.flat)
        model = Codebooks(fitted.astype(np.float32).reshape(model.words.shape))
        codes = model.encode(x)
    return kept


def usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """id and vector (array of double) of the rows that take part, lengths still mixed."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<double>").alias("vector"))
    number = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("id").isNotNull() & F.col("vector").isNotNull()).filter(number & F.exists("vector", lambda x: x != 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def nearest(
    spark: SparkSession,
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    id_column: str = "vec_id",
    column: str = "embedding",
    books: int = 8,
    size: int = 256,
    sample: int = 16384,
    rerank: int = 100,
    z: float = 3.0,
) -> DataFrame:
    """query_id, rank, id and score of the ``k`` nearest found; ``is_query`` is a condition on ``id``."""
    ws = Workspace(spark, "ann")
    empty = spark.createDataFrame([], f"query_id long, rank int, {id_column} long, score double")
    rows = usable(vectors, id_column, column)
    lengths = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if lengths is None:
        return empty
    dim, total = lengths["dim"], lengths["count"]
    rows = rows.filter(F.size("vector") == dim)
    seed = F.xxhash64(F.lit("ann"), "id")
    some = rows
    if total > sample:
        # The seeds of least hash bound the sample before any vector is sent.
        cut = rows.select(seed.alias("seed")).orderBy("seed").limit(sample + 1).agg(F.max("seed")).first()[0]
        some = rows.filter(seed < cut)
    held = some.toArrow().sort_by("id")
    if held.num_rows == 0:
        held = rows.limit(1).toArrow()
    model = train(_matrix(held["vector"].combine_chunks(), dim), books, size)
    shared = spark.sparkContext.broadcast(model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A row's number tells it from others of its id.
        number = TaskContext.get().partitionId() << 33
        for batch in tidy(batches):
            x = _matrix(batch.column(1), dim)
            codes = shared.value.encode(x)
            near = shared.value.decode(codes).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(number, number + len(x))), batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array((near**2).sum(1)), pa.array(((x - near) ** 2).sum(1))],
                names=["row", "id", "vector", "codes", "norm", "missed"],
            )
            number += len(x)

    schema = "row long, id long, vector array<double>, codes binary, norm double, missed double"
    index = ws.keep(rows.mapInArrow(encode, schema), "index")
    ws.keep(index.filter(is_query).select("row", "id", "vector"), "queries")
    queries = ws.path("queries")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in tidy(batches):
            held.append(batch)
            count += batch.num_rows
            if count >= CHUNK:
                yield from against(pa.Table.from_batches(held))
                held, count = [], 0
        if count:
            yield from against(pa.Table.from_batches(held))

    def against(chunk: pa.Table) -> Iterator[pa.RecordBatch]:
        book = shared.value
        rows, ids = chunk["row"].to_numpy(), chunk["id"].to_numpy()
        x = _matrix(chunk["vector"].combine_chunks(), dim)
        width = book.words.shape[1]
        codes = np.frombuffer(b"".join(chunk["codes"].to_pylist()), np.uint8).reshape(len(ids), books).astype(np.int32)
        codes = np.ascontiguousarray((codes + np.arange(books, dtype=np.int32) * width).T)
        norm, missed = chunk["norm"].to_numpy(), chunk["missed"].to_numpy()
        system, inside = pafs.FileSystem.from_uri(queries)
        for block in pads.dataset(inside, filesystem=system, format="parquet").to_batches(batch_size=BLOCK):
            if block.num_rows == 0:
                continue
            q = _matrix(block.column("vector"), dim)
            tables = q.astype(np.float32) @ book.flat.T
            out: tuple[list, list, list, list] = ([], [], [], [])
            for own, qid, vector, table in zip(block.column("row").to_numpy(), block.column("id").to_numpy(), q, tables):
                product = table[codes[0]]
                for m in range(1, books):
                    product = product + table[codes[m]]
                scored = norm - 2 * product.astype(np.float64) + (vector @ vector)
                # What the code misses is as good as orthogonal to the rest: expected square and its deviation.
                scored = np.maximum(scored, 0)
                expected, deviation = scored + missed, 2 * np.sqrt(scored * missed / dim)
                other = rows != own
                few = min(rerank, len(ids) - 1)
                best = np.argpartition(expected, few)[: few + 1]
                best = best[other[best]]
                if len(best):
                    exact = ((x[best] - vector) ** 2).sum(1)
                    worst = np.sort(exact)[min(k, len(exact)) - 1] if len(exact) >= k else np.inf
                    more = (expected - z * deviation <= worst) & other
                    more[best] = True
                    more &= other
                    best = np.flatnonzero(more)
                else:
                    best = np.flatnonzero(other)
                score = np.sqrt(((x[best] - vector) ** 2).sum(1))
                top = np.lexsort((rows[best], ids[best], score))[:k]
                out[0].append(np.full(len(top), qid))
                out[1].append(np.full(len(top), own))
                out[2].append(ids[best][top])
                out[3].append(score[top])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["query_id", "row", "id", "score"])

    found = index.mapInArrow(search, "query_id long, row long, id long, score double")
    order = Window.partitionBy("row").orderBy("score", "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_column), "score")

