"""A log-bilinear language model trained by noise-contrastive estimation.

The model predicts a token from the one before it: the context word's vector,
turned by a matrix, is multiplied with the vectors of all tokens.  Its core has the
most common words, one class for each shape of other words, and the end of a text.
Within its class every word that learning texts hold ``LEAST`` times has a vector of
its own too, so the vocabulary grows with the corpus; rarer words go by smoothed
counts.  Both levels are normalised, so every token of every text has a probability.

Training counts all pairs of neighbouring tokens of all learning texts, summed
map-side: (core token, core token), and (core token, word) for the words of classes,
whose number grows with the corpus.  The core takes gradient steps on the
noise-contrastive objective over its whole matrix of counts.  The vectors of words
are then found apart, each by Newton steps on the same objective with the contexts
held, so they are fitted where their counts are, many words to one product of
matrices.  Expectations over noise words are taken exactly.

Word counts cover the corpus and stay distributed.  The ``FREQUENT`` most common
words go to the executors with counts and vectors; the rest is joined by hash, after
it was summed per text, and has no vectors.  Words are known by 64-bit hashes.

Defined cases.  A null text is empty and consists of its end alone.  Rows with a
null id are held out.  Repeated rows are scored alike.  Without learning texts the
base probability of every token is 1 and the model is uniform.  Extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import Words, mix, slices, tidy
from .workspace import Workspace

SHAPES, TOKENS = 128, 2048
#: Words of the core, besides the classes and the end.
WORDS = TOKENS - SHAPES - 1
CORE = WORDS
END = TOKENS - 1
FREQUENT = 1 << 19
#: Occurrences in learning texts from which a word of a class has a vector, and its length.
LEAST, NARROW = 16, 16
NOISE = 25.0
HELD = 1 << 21
LN10 = np.log(10.0)


def shapes(words: Words) -> np.ndarray:
    """The class of each word: last two bytes, length, and whether it is all ASCII."""
    if not len(words.start):
        return np.zeros(0, np.int32)
    wide = np.concatenate([[0], np.cumsum(words.data >= 128)])
    last = words.data[words.end - 1].astype(np.uint64)
    before = words.data[np.maximum(words.end - 2, words.start)].astype(np.uint64)
    ending = (mix(last * np.uint64(257) + before) >> np.uint64(60)).astype(np.int32)
    size = np.searchsorted(np.array([4, 8, 14]), words.end - words.start, "left")
    return ending * 8 + size.astype(np.int32) * 2 + (wide[words.end] > wide[words.start])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """hash, shape, learnt and every: a task's words, summed before they leave it."""
    held: list[tuple] = []

    def merged() -> tuple:
        keys, first, at = np.unique(np.concatenate([h[0] for h in held]), return_index=True, return_inverse=True)
        sums = [np.bincount(at, weights=np.concatenate([h[k] for h in held])).astype(np.int64) for k in (2, 3)]
        return keys, np.concatenate([h[1] for h in held])[first], *sums

    def out(part: tuple) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(part[0]), 1 << 17):
            some = [x[k : k + (1 << 17)] for x in part]
            yield pa.RecordBatch.from_arrays([pa.array(some[0].view(np.int64)), *(pa.array(x) for x in some[1:])], names=["hash", "shape", "learnt", "every"])

    size = 0
    for batch in tidy(batches):
        learn = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for first, part in slices(batch.column(0)):
            words = Words(part)
            keys, where, at = np.unique(words.hash, return_index=True, return_inverse=True)
            weight = np.repeat(learn[first : first + len(part)], words.count)
            held.append((keys, shapes(words)[where], np.bincount(at, weights=weight, minlength=len(keys)).astype(np.int64), np.bincount(at, minlength=len(keys))))
            size += len(keys)
            if size > HELD:
                held = [merged()]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield from out(held[0])
                    held, size = [], 0
    if held:
        yield from out(merged())


class Vocabulary:
    """The frequent words: sorted hashes, counts, shapes, the core token and the place among words with vectors of each, or -1."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, shape: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.counts, self.shape = hashes[order], counts[order], shape[order].astype(np.uint8)
        ranked = np.lexsort((self.hashes, -self.counts))
        self.token = np.full(len(hashes), -1, dtype=np.int32)
        chosen = ranked[:CORE][self.counts[ranked[:CORE]] > 0]
        self.token[chosen] = np.arange(len(chosen))
        self.fitted = np.flatnonzero((self.token < 0) & (self.counts >= LEAST))
        self.place = np.full(len(hashes), -1, dtype=np.int32)
        self.place[self.fitted] = np.arange(len(self.fitted))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each word, -1 for those that are not frequent."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def tokens(self, words: Words, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text its tokens and the end; the token before each; text of each; which are words."""
        own = np.where(found >= 0, self.token[found], -1) if len(self.hashes) else np.full(len(found), -1)
        own = np.where(own >= 0, own, WORDS + shapes(words))
        count = words.count
        ends = np.cumsum(count + 1) - 1
        everything = np.full(len(own) + len(count), END, dtype=np.int64)
        place = np.ones(len(everything), dtype=bool)
        place[ends] = False
        everything[place] = own
        before = np.concatenate([[END], everything[:-1]])
        return everything, before, np.repeat(np.arange(len(count)), count + 1), place


def train(pairs: np.ndarray, dim: int = 32, noise: float = NOISE, steps: int = 120, rate: float = 0.05, seed: int = 3) -> np.ndarray:
    """Log-probabilities (context, token) from pair counts, as float32."""
    return train_core(pairs, dim, noise, steps, rate, seed)[0]


def train_core(pairs: np.ndarray, dim: int = 32, noise: float = NOISE, steps: int = 120, rate: float = 0.05, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities (context, token) from pair counts, and the turned vector of each context, as float32.

    The objective is that of ``noise`` noise words per token, drawn from smoothed
    token frequencies; both its sums run over all (context, token) at once.
    """
    total = max(1.0, float(pairs.sum()))
    unigram = (pairs.sum(0) + 0.5) / (pairs.sum() + 0.5 * pairs.shape[1])
    data = (pairs / total).astype(np.float32)
    drawn = (pairs.sum(1) / total)[:, None].astype(np.float32) * (noise * unigram)[None].astype(np.float32)
    margin = np.log(noise * unigram).astype(np.float32)
    rng = np.random.default_rng(seed)
    size = len(pairs)
    params = [rng.normal(0, 0.1, (size, dim)).astype(np.float32), np.eye(dim, dtype=np.float32), np.log(unigram).astype(np.float32)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    if pairs.sum() > 0:
        for step in range(1, steps + 1):
            vectors, turn, bias = params
            context = vectors @ turn
            delta = context @ vectors.T + (bias - margin)
            p = 1 / (1 + np.exp(-np.clip(delta, -30, 30)))
            push = drawn * p - data * (1 - p)
            back = push @ vectors
            grads = [back @ turn.T + push.T @ context + 1e-7 * vectors, vectors.T @ back, push.sum(0)]
            for param, grad, (m, v) in zip(params, grads, moments):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                param -= np.float32(rate * min(1.0, 3 * (1 - step / (steps + 1)))) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    vectors, turn, bias = params
    context = vectors @ turn
    scores = context @ vectors.T + bias
    scores -= scores.max(1, keepdims=True)
    return (scores - np.log(np.exp(scores.astype(np.float64)).sum(1, keepdims=True))).astype(np.float32), context


def narrow(context: np.ndarray, often: np.ndarray, most: int = NARROW) -> np.ndarray:
    """Contexts in their ``most`` main directions, of unit variance over the corpus, and a last column of ones."""
    weight = (often + 1e-3) / (often + 1e-3).sum()
    centred = context.astype(np.float64) - weight @ context
    values, directions = np.linalg.eigh((centred * weight[:, None]).T @ centred)
    chosen = np.argsort(-values)[:most]
    out = centred @ directions[:, chosen] / np.sqrt(np.maximum(values[chosen], 1e-9))
    far = np.sqrt((out * out).mean(1, keepdims=True))
    return np.hstack([out / np.maximum(1, far / 3), np.ones((len(out), 1))]).astype(np.float32)


def fit(context: np.ndarray, seen: np.ndarray, expected: np.ndarray, steps: int = 8, ridge: float = 1.0) -> np.ndarray:
    """Vectors (word, column of ``context``) of words of classes, by noise-contrastive estimation with contexts held.

    ``seen`` and ``expected`` (word, context) count a word after each context, and
    how often it would be there if its class's words took turns by their counts,
    which is the noise.  Newton steps climb the penalised objective; a step moves no
    logarithm by more than a word's radius, which halves when a step went too far.
    """
    width = context.shape[1]
    upper = np.triu_indices(width)
    outer = context[:, upper[0]] * context[:, upper[1]]
    both = seen + np.float32(NOISE) * expected
    best = np.zeros((len(seen), width), dtype=np.float32)
    vectors, step = best, best
    height, radius = np.full(len(seen), -np.inf, dtype=np.float32), np.full(len(seen), 2.0, dtype=np.float32)
    for turn in range(steps):
        margin = np.float32(np.log(NOISE)) - vectors @ context.T
        power = np.exp(np.minimum(margin, 60))
        reached = (np.float32(NOISE) * expected * margin - both * np.log1p(power)).sum(1) - ridge / 2 * (vectors * vectors).sum(1)
        better = reached >= height
        best, height = np.where(better[:, None], vectors, best), np.where(better, reached, height)
        if turn == steps - 1:
            break
        # Where a step went too far, half of it is tried from where it began.
        radius = np.where(better, radius, radius / 2)
        p = 1 / (1 + power)
        uphill = (seen - both * p) @ context - np.float32(ridge) * vectors
        bends = np.zeros((len(seen), width, width), dtype=np.float32)
        bends[:, upper[0], upper[1]] = (both * p * (1 - p)) @ outer
        bends[:, upper[1], upper[0]] = bends[:, upper[0], upper[1]]
        bends[:, np.arange(width), np.arange(width)] += np.float32(ridge)
        newton = np.linalg.solve(bends, uphill[:, :, None])[:, :, 0]
        newton *= np.minimum(1, radius / np.maximum(np.abs(newton @ context.T).max(1), 1e-9))[:, None]
        step = np.where(better[:, None], newton, step / 2)
        vectors = best + step
    return best


def spread(context: np.ndarray, vectors: np.ndarray, share: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Logarithms (context, class) of what the words of a class sum to before they are normalised."""
    out = np.ones((len(context), SHAPES))
    for kind in range(SHAPES):
        own = np.flatnonzero(shape == kind)
        for k in range(0, len(own), 2048):
            some = own[k : k + 2048]
            out[:, kind] += np.expm1(context @ vectors[some].T) @ share[some]
    return np.log(out)


def score(spark: SparkSession, docs: DataFrame, learn: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score and score; ``learn`` is a condition on the id."""
    ws = Workspace(spark, "lm")
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    counted = rows.select("text", "learn").mapInArrow(_counted, "hash long, shape int, learnt long, every long")
    counts = ws.keep(counted.groupBy("hash").agg(F.first("shape").alias("shape"), F.sum("learnt").alias("learnt"), F.sum("every").alias("every")), "counts")
    texts = rows.agg(F.count_if("learn").alias("n")).first()["n"]
    sums = counts.agg(F.coalesce(F.sum("learnt"), F.lit(0)).alias("n"), F.count_if(F.col("learnt") > 0).alias("v")).first()
    learnt, distinct = sums["n"] + texts, sums["v"] + (texts > 0)

    # As many of the most common words as the bound allows, whole classes of equal counts.
    steps = counts.groupBy("every").count().filter("every > 1").orderBy(F.desc("every")).limit(1 << 16).toPandas()
    cut = steps["every"][steps["count"].cumsum() <= FREQUENT].min() if len(steps) else None
    common = counts.filter(F.col("every") >= (int(cut) if cut == cut and cut is not None else (1 << 62))).select("hash", "learnt", "shape").toArrow()
    words = Vocabulary(common["hash"].to_numpy().view(np.uint64), common["learnt"].to_numpy(), common["shape"].to_numpy())
    vocabulary = spark.sparkContext.broadcast(words)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of the core, numbered from 0, and then of contexts and words with vectors, summed by task."""
        cells = np.zeros(TOKENS * TOKENS, dtype=np.int32)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return keys, np.bincount(at, weights=np.concatenate([h[1] for h in held])).astype(np.int64)

        def out(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(keys), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + (1 << 17)].astype(np.int64)), pa.array(n[k : k + (1 << 17)].astype(np.int64))], names=["cell", "n"])

        for batch in tidy(batches):
            for _, part in slices(batch.column(0)):
                w = Words(part)
                at = vocabulary.value.find(w.hash)
                tokens, before, _, inner = vocabulary.value.tokens(w, at)
                some, n = np.unique(before * TOKENS + tokens, return_counts=True)
                cells[some] += n.astype(np.int32)
                if not len(vocabulary.value.fitted):
                    continue
                place = np.where(at >= 0, vocabulary.value.place[at], -1).astype(np.int64)
                own = place >= 0
                some, n = np.unique((TOKENS + place[own]) * TOKENS + before[inner][own], return_counts=True)
                held.append((some, n))
                size += len(some)
                if size > HELD:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield from out(*held[0])
                        held, size = [], 0
        if held:
            yield from out(*merged())
        used = np.flatnonzero(cells)
        yield from out(used, cells[used])

    found = ws.keep(rows.filter("learn").select("text").mapInArrow(pairs, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")), "pairs")
    core = found.filter(F.col("cell") < TOKENS * TOKENS).toArrow()
    matrix = np.zeros(TOKENS * TOKENS)
    matrix[core["cell"].to_numpy()] = core["n"].to_numpy()
    matrix = matrix.reshape(TOKENS, TOKENS)
    chances, context = train_core(matrix)
    context = narrow(context, matrix.sum(1))
    after = np.ascontiguousarray(matrix[:, WORDS:END].T, dtype=np.float32)
    del matrix, core

    own = words.hashes[words.token >= 0].view(np.int64)
    inside = spark.createDataFrame(pa.table({"hash": pa.array(own)})) if len(own) else spark.createDataFrame([], "hash long")
    other = counts.join(F.broadcast(inside), "hash", "left_anti")
    classes = {r["shape"]: (r["n"], r["v"]) for r in other.groupBy("shape").agg(F.sum("learnt").alias("n"), F.count_if(F.col("learnt") > 0).alias("v")).collect()}
    room = np.array([classes.get(k, (0, 0))[0] + 0.1 * (classes.get(k, (0, 0))[1] + 1) for k in range(SHAPES)])

    shape = words.shape[words.fitted]
    share = (words.counts[words.fitted] + 0.1) / room[shape]
    vectors = np.zeros((len(shape), context.shape[1]), dtype=np.float32)
    if len(shape):
        held_still = spark.sparkContext.broadcast((context, after, shape, share.astype(np.float32)))

        def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []

            def solved(word: np.ndarray, before: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
                turned, follow, kinds, shares = held_still.value
                ids, first = np.unique(word, return_index=True)
                first = np.append(first, len(word))
                for k in range(0, len(ids), 128):
                    some = ids[k : k + 128]
                    part = slice(first[k], first[k + len(some)])
                    seen = np.zeros((len(some), TOKENS), dtype=np.float32)
                    seen[np.searchsorted(some, word[part]), before[part]] = n[part]
                    got = fit(turned, seen, follow[kinds[some]] * shares[some][:, None])
                    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([v.tobytes() for v in got], pa.binary())], names=["word", "vector"])

            for batch in tidy(batches):
                held.append(tuple(batch.column(k).to_numpy() for k in range(3)))
                if sum(len(h[0]) for h in held) >= 1 << 16:
                    joined = [np.concatenate(x) for x in zip(*held)]
                    cut = int(np.searchsorted(joined[0], joined[0][-1]))
                    yield from solved(*(x[:cut] for x in joined))
                    held = [tuple(x[cut:] for x in joined)]
            if held:
                yield from solved(*(np.concatenate(x) for x in zip(*held)))

        tail = F.col("cell") - TOKENS * TOKENS
        sparse = found.filter(F.col("cell") >= TOKENS * TOKENS).select(F.expr(f"(cell - {TOKENS * TOKENS}) div {TOKENS}").alias("word"), (tail % TOKENS).alias("before"), "n")
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(shape) // 4096 + 1)
        solved_all = sparse.repartition(parts, "word").sortWithinPartitions("word").mapInArrow(fitted, "word long, vector binary").toArrow()
        vectors[solved_all["word"].to_numpy()] = np.frombuffer(b"".join(solved_all["vector"].to_pylist()), dtype=np.float32).reshape(-1, context.shape[1])
        del solved_all
    model = spark.sparkContext.broadcast((chances, room, context, vectors, spread(context, vectors, share, shape).astype(np.float32)))
    whole = learnt + 0.1 * (distinct + 1)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = vocabulary.value
        table, shares, contexts, own_vectors, sums_of = model.value
        named = ["id", "key", "learn", "hash", "n", "shape", "tokens", "known", "base", "score"]
        for batch in tidy(batches):
            for first, part in slices(batch.column("text")):
                w = Words(part)
                at = book.find(w.hash)
                tokens, before, text, inner = book.tokens(w, at)
                rows_, count = w.row, len(part)
                lm = np.bincount(text, weights=table[before, tokens], minlength=count)
                shape = shapes(w)
                seen = np.flatnonzero(at >= 0)
                c = book.counts[at[seen]].astype(np.float64)
                base = np.bincount(rows_[seen], weights=np.log((c + 0.1) / whole), minlength=count) + np.log((texts + 0.1) / whole)
                known = np.bincount(rows_[seen], weights=c > 0, minlength=count) + (texts > 0)
                classed = book.token[at[seen]] < 0
                some = seen[classed]
                lm += np.bincount(rows_[some], weights=np.log((c[classed] + 0.1) / shares[shape[some]]), minlength=count)
                behind = before[inner]
                some = np.flatnonzero(tokens[inner] >= WORDS)
                lm -= np.bincount(rows_[some], weights=sums_of[behind[some], shape[some]], minlength=count)
                if len(own_vectors):
                    place = np.where(at >= 0, book.place[at], -1)
                    some = np.flatnonzero(place >= 0)
                    lm += np.bincount(rows_[some], weights=np.einsum("ij,ij->i", contexts[behind[some]], own_vectors[place[some]]), minlength=count)
                keys = batch.column("key").slice(first, count)
                ids, learns = (batch.column(x).slice(first, count) for x in ("id", "learn"))
                nothing = lambda kind: pa.nulls(count, kind)
                yield pa.RecordBatch.from_arrays(
                    [ids, keys, learns, nothing(pa.int64()), nothing(pa.int64()), nothing(pa.int32()), pa.array(w.count + 1), pa.array(known.astype(np.int64)), pa.array(base / LN10), pa.array(lm / LN10)], names=named
                )
                rare = np.flatnonzero(at < 0)
                if not len(rare):
                    continue
                order = rare[np.lexsort((w.hash[rare], rows_[rare]))]
                heads = np.flatnonzero(np.concatenate([[True], (rows_[order][1:] != rows_[order][:-1]) | (w.hash[order][1:] != w.hash[order][:-1])]))
                n = np.diff(np.concatenate([heads, [len(order)]]))
                some = order[heads]
                empty = lambda kind: pa.nulls(len(some), kind)
                yield pa.RecordBatch.from_arrays(
                    [empty(ids.type), keys.take(pa.array(rows_[some])), empty(pa.bool_()), pa.array(w.hash[some].view(np.int64)), pa.array(n), pa.array(shape[some].astype(np.int32)), empty(pa.int64()), empty(pa.int64()), empty(pa.float64()), empty(pa.float64())],
                    names=named,
                )

    kind = rows.schema["id"].dataType.simpleString()
    keyed = rows.withColumn("key", F.xxhash64("id", "text"))
    both = ws.keep(keyed.mapInArrow(scored, f"id {kind}, key long, learn boolean, hash long, n long, shape int, tokens long, known long, base double, score double"), "scored")
    main = both.filter("hash IS NULL").select("id", "key", "learn", "tokens", "known", "base", "score")
    room_of = F.element_at(F.array(*(F.lit(float(x)) for x in room)), F.col("w.shape") + 1)
    rare = both.filter("hash IS NOT NULL").select("key", "hash", "n").join(counts.select("hash", F.struct("shape", "learnt").alias("w")), "hash")
    c = F.col("w.learnt")
    rare = rare.select(
        "key",
        F.lit(0).cast("long").alias("copies"),
        F.when(c > 0, F.col("n")).otherwise(0).alias("known"),
        (F.col("n") * F.log10((c + 0.1) / F.lit(float(whole)))).alias("base"),
        (F.col("n") * F.log10((c + 0.1) / room_of)).alias("score"),
    )
    one = main.select("key", F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), F.lit(0.0).alias("score"))
    # Rows repeated in id and text share a key and sent their rare words as often as they occur.
    added = rare.unionByName(one).groupBy("key").agg(F.sum("copies").alias("copies"), *(F.sum(x).alias(f"_{x}") for x in ("known", "base", "score")))
    final = main.join(added, "key")
    return final.select(
        F.col("id").alias(id_column),
        (~F.col("learn")).alias("held_out"),
        F.col("tokens").alias("n_tokens"),
        (F.col("known") + F.expr("_known div copies")).alias("n_known"),
        F.lit(int(learnt)).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("_base") / F.col("copies")).alias("base_score"),
        (F.col("score") + F.col("_score") / F.col("copies")).alias("score"),
    )
