"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words and word stems is trained in numpy from
documents confirmed toxic and from unlabelled documents.  The risk of the negative
class is not estimated from presumed negatives but as the unlabelled risk minus
the prior's share of the positive one, and where that is negative
the step goes up instead of down (Kiryo et al. 2017).  The prior is the share of
toxic among labelled documents, or given.

The classifier is fitted on a bounded sample: at most ``most_positive`` confirmed
and ``most_unlabelled`` unlabelled documents, those of the least hash of their id
and text.  Which features exist, all scores and all decisions cover whole texts of
all rows.

Defined cases.  A null text is empty; an empty text scores by the intercept alone,
which is low where toxic documents are rare.  Labels that are null, or that differ
for one id, count as absent or as toxic if any says so.  Without a confirmed
document every score is 0, as nothing can be learned.  Rows repeat as they come;
extra columns are ignored by ``score`` and kept by ``reject_toxic``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import MARKS, Words, slices, tidy
from .workspace import relieve

BITS = 18
#: First bytes of a word that count as features of their own, where the word is longer.
STEMS = (4, 5, 6)
SHIFT = np.uint64(64 - BITS)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature of every distinct (row, feature) of a batch."""
    words = Words(column, STEMS, MARKS)
    size, rows = words.end - words.start, words.row << BITS
    keys = [rows | (words.hash >> SHIFT).astype(np.int64)]
    for stem, hashes in zip(STEMS, words.stems):
        keys.append((rows | (hashes >> SHIFT).astype(np.int64))[size > stem])
    keys = np.unique(np.concatenate(keys))
    return keys >> BITS, keys & ((1 << BITS) - 1)


@dataclass
class Model:
    weights: np.ndarray
    intercept: float

    def score(self, column: pa.Array) -> np.ndarray:
        if not self.weights.any() and self.intercept == -np.inf:
            return np.zeros(len(column))
        logit = np.full(len(column), self.intercept)
        for first, part in slices(column):
            rows, found = features(part)
            logit[first : first + len(part)] += np.bincount(rows, weights=self.weights[found], minlength=len(part))
        return 1.0 / (1.0 + np.exp(-np.clip(logit, -500, 500)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def train(
    positive: list[np.ndarray],
    unlabelled: list[np.ndarray],
    prior: float,
    steps: int = 400,
    rate: float = 0.2,
    decay: float = 1e-4,
    least: float = 0.02,
    lift: float = 4.0,
) -> Model:
    """nnPU with the logistic loss; Adagrad steps over the whole sample, so that the sign
    of the negative risk is not decided by the noise of small batches.

    Features are those in a share ``least`` of the confirmed documents, 5 at least
    (rarer ones would be learned by heart), and there ``lift`` times as common as
    in clean ones; the words of a long text that tell nothing stay out.  As the
    unlabelled documents hold toxic ones too, the rate in clean documents is theirs
    less the prior's share of the confirmed ones'.
    """
    if not positive or not unlabelled:
        return Model(np.zeros(1 << BITS), -np.inf)
    in_p, in_u = (np.bincount(np.concatenate(some), minlength=1 << BITS) for some in (positive, unlabelled))
    prior = min(max(prior, 1e-4), 0.9)
    in_clean = np.maximum((in_u + 2) / len(unlabelled) - prior * in_p / len(positive), 2 / len(unlabelled)) / (1 - prior)
    telling = (in_p >= max(min(5, len(positive)), least * len(positive))) & (in_p / len(positive) >= lift * in_clean)
    positive, unlabelled = ([x[telling[x]] for x in some] for some in (positive, unlabelled))
    parts, n, m = positive + unlabelled, len(positive), len(unlabelled)
    rows, found = np.repeat(np.arange(n + m), [len(x) for x in parts]), np.concatenate(parts)
    weights, squares = np.zeros(1 << BITS), np.full(1 << BITS, 1e-8)
    intercept, square = float(np.log(prior / (1 - prior))), 1e-8
    for _ in range(steps):
        p = _sigmoid(np.bincount(rows, weights=weights[found], minlength=n + m) + intercept)
        loss0 = -np.log(np.maximum(1 - p, 1e-12))
        push = np.empty(n + m)
        if loss0[n:].mean() - prior * loss0[:n].mean() >= 0:
            push[:n], push[n:] = -prior / n, p[n:] / m
        else:
            push[:n], push[n:] = prior * p[:n] / n, -p[n:] / m
        step = np.bincount(found, weights=push[rows], minlength=1 << BITS) + decay * weights
        squares += step * step
        weights -= rate * step / np.sqrt(squares)
        whole = push.sum()
        square += whole * whole
        intercept -= rate * whole / np.sqrt(square)
    return Model(weights, intercept)


def _listed(rows: DataFrame, most: int) -> list[np.ndarray]:
    """The features of each distinct (seed, text), the ``most`` least by seed."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            for first, part in slices(batch.column("text")):
                at, found = features(part)
                ends = np.searchsorted(at, np.arange(len(part) + 1))
                lists = [found[a:b].astype(np.int32).tobytes() for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("seed").slice(first, len(part)), pa.array(lists, pa.binary())], names=["seed", "found"])

    found = rows.select("seed", "text").mapInArrow(listed, "seed long, found binary").distinct().orderBy("seed", "found").limit(most)
    return [np.frombuffer(r, np.int32) for _, r in sorted((r["seed"], bytes(r["found"])) for r in found.toLocalIterator())]


def fit(docs: DataFrame, labels: DataFrame, learn: Column, prior: float | None = None, margin: float = 1.1, most_positive: int = 6000, most_unlabelled: int = 12000) -> Model:
    """``learn`` is a condition on doc_id; only rows that meet it are learned from.

    The estimated prior is raised by ``margin``: with one below the true share the
    learner explains confirmed documents away as unlabelled ones.

    Both samples are those of least hash of the id.  At most ``most_positive`` ids
    are broadcast, and texts are never shuffled, only their feature lists, of which no
    more than these bounds reach the driver, however many texts share an id.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(learn)
    counts = known.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("toxic") == 1).cast("long")).alias("toxic")).first()
    if not counts["toxic"]:
        return Model(np.zeros(1 << BITS), -np.inf)
    seed = F.xxhash64(F.lit("toxicity"), "doc_id")
    rows = docs.select("doc_id", "text").filter(learn).withColumn("seed", seed)
    chosen = known.filter("toxic = 1").orderBy(seed, "doc_id").limit(most_positive).select("doc_id")
    least = rows.select("seed").distinct().orderBy("seed").limit(most_unlabelled + 1).agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("cut")).first()
    some = rows.filter(F.col("seed") < least["cut"]) if least["n"] > most_unlabelled else rows
    share = margin * counts["toxic"] / counts["n"]
    model = train(_listed(rows.join(F.broadcast(chosen), "doc_id"), most_positive), _listed(some, most_unlabelled), prior if prior is not None else share)
    relieve(docs.sparkSession)
    return model


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id and score of every row."""
    session = docs.sparkSession
    shared = session.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(batch.column(1)))], names=["id", "score"])

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(scored, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_column)


def reject_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text_column)
        for batch in tidy(batches):
            yield batch.filter(pa.array(shared.value.score(batch.column(at)) < threshold))

    return docs.mapInArrow(kept, docs.schema)
