"""Mixing sources to target weights by entropy balancing.

Targets: sources share ``share`` times all words by weight; no source is asked for
more than ``most`` times its own words, and what that frees is shared again.

Rates: among all document rates between 0 and ``most``, the ones nearest to 1 in
relative entropy that meet every source's word target are ``min(most, exp(m * x))``
with x the document's words over its source's mean and m the source's multiplier
in the convex dual.  Safeguarded Newton steps find the multipliers, all sources at
once: every step sums gradient and curvature over a histogram of (source, size),
which holds all documents and is far smaller than they are, at the Newton point and
at a grid of points around it that narrows the bracket, so a few steps are enough.

Copies: whole parts of the rates are kept and fractions are rounded by a radix
selection: documents get keys (fraction minus a hash), and the key above which a
source's documents get one more copy is found digit by digit from sums, so the
words taken end within one document of the target.  Reruns agree.

Texts are read twice, to count words and to give the rows out, and are never
shuffled or written: all steps between work on (source, size, hash) of each row.

Defined cases.  A null text has size 0; documents of size 0 get one copy and take
no words; a null source is a source of its own, last in order; a source of size 0
has target 0; rows repeated in all columns share a key up to a last tie that is
broken among them alone, by their place in the input; extra columns pass through, and
those named like a result come out as ``input_`` and their name; an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import Workspace, relieve

WORD = r"[^\x20\x09-\x0D]+"
KEY_BITS, TIE_BITS, DIGIT = 40, 20, 12
STEPS, NEAR, GRID = 40, 1e-10, 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """source, source_size, documents and target; ``sizes`` has source and size.

    Filling by weight until a source is full and sharing the rest again ends at a
    common level per weight; the level is read off prefix sums over the sources in
    order of how early each is full.  The windows hold one row for each source.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*(F.lit(w) for w in weights))
    ranked = sources.withColumn("weight", F.get(cycle, F.pmod(place, F.lit(len(weights)))).cast("double"))
    full = F.col("source_size") * F.lit(float(most))
    order = Window.orderBy(F.col("full_at"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = (
        ranked.withColumn("full", full)
        .withColumn("full_at", F.col("full") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("full").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("open"))
        .withColumn("fits", F.when(F.col("level") <= F.col("full_at"), F.col("level")))
        .withColumn("fill", F.coalesce(F.min("fits").over(whole), F.lit(float("inf"))))
    )
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least("full", F.col("weight") * F.col("fill")))
    return levels.select("source", "source_size", "documents", target.alias("target"))


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def _on_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on source, null equal to null; the source column of ``left`` stays."""
    right = right.withColumnRenamed("source", "_source")
    return left.join(right, _same("source", "_source"), how).drop("_source")


def multipliers(sizes: DataFrame, targets: DataFrame, ws: Workspace, most: float) -> DataFrame:
    """source, multiplier and mean for every source that has words.

    The total of a source grows with its multiplier, so a bracket is kept: below
    0 or log(target / size) over the least x the total is too small, and at
    log(most) over the least x every document is at its most.
    """
    histogram = ws.keep(sizes.filter("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "histogram")
    spread = histogram.groupBy("source").agg(F.min("size").alias("least"))
    mean = F.col("source_size") / F.col("documents")
    start = _on_source(targets.filter("source_size > 0"), spread).select(
        "source",
        "target",
        mean.alias("mean"),
        F.least(F.lit(0.0), F.log(F.greatest(F.col("target"), F.lit(1e-9)) / F.col("source_size")) / (F.col("least") / mean)).alias("low"),
        (F.log(F.lit(float(most))) / (F.col("least") / mean)).alias("high"),
        F.lit(0.0).alias("multiplier"),
        F.lit(False).alias("met"),
    )
    ends = F.col("high") - F.col("low")
    grid = [F.col("low") + ends * (i / GRID) for i in range(GRID + 1)]
    state = ws.keep(start.withColumn("points", F.array_distinct(F.array(*grid[:-1], F.col("high"), F.greatest("low", F.least("high", F.lit(0.0)))))), "state0")
    for step in range(1, STEPS + 1):
        asked = state.filter("NOT met").select("source", "mean", F.explode("points").alias("m"))
        x = F.col("size") / F.col("mean")
        rate = F.exp(F.least(F.col("m") * x, F.lit(700.0)))
        sums = _on_source(histogram, asked).groupBy("source", "m").agg(
            F.sum(F.col("n") * F.col("size") * F.least(rate, F.lit(float(most)))).alias("total"),
            F.sum(F.when(rate < most, F.col("n") * F.col("size") * x * rate).otherwise(0.0)).alias("slope"),
        )
        tried = _on_source(sums, state.select("source", "target")).withColumn("gap", F.col("total") - F.col("target"))
        near = tried.groupBy("source").agg(
            F.max(F.when(F.col("gap") <= 0, F.col("m"))).alias("l"),
            F.min(F.when(F.col("gap") >= 0, F.col("m"))).alias("h"),
            F.min_by(F.struct("m", "gap", "slope"), F.struct(F.abs("gap"), "m")).alias("best"),
        )
        moved = _on_source(state, near, "left").withColumns({"l": F.coalesce("l", "low"), "h": F.coalesce("h", "high")})
        close = (F.abs("best.gap") <= NEAR * F.greatest(F.col("target"), F.lit(1.0))) | (F.col("h") - F.col("l") <= 1e-14 * (1 + F.abs("h")))
        newton = F.col("best.m") - F.col("best.gap") / F.nullif(F.col("best.slope"), F.lit(0.0))
        wide = F.col("h") - F.col("l")
        moved = moved.withColumn("next", F.when((newton > F.col("l")) & (newton < F.col("h")), newton).otherwise(F.col("l") + wide / 2))
        around = [F.greatest("l", F.least("h", F.col("next") + wide * d)) for d in (0.0, 1e-2, -1e-2, 1e-4, -1e-4, 1e-6, -1e-6)]
        points = F.array_distinct(F.array(*(F.col("l") + wide * (i / GRID) for i in range(1, GRID)), *around))
        moved = moved.select(
            "source", "target", "mean", F.col("l").alias("low"), F.col("h").alias("high"),
            F.when(F.col("met"), F.col("multiplier")).otherwise(F.col("best.m")).alias("multiplier"), (F.col("met") | close).alias("met"), points.alias("points"),
        )
        state = ws.keep(moved, f"state{step}")
        ws.drop(f"state{step - 1}")
        if state.filter("NOT met").isEmpty():
            break
    return state.select("source", "multiplier", "mean")


def _edges(rated: DataFrame, targets: DataFrame, ws: Workspace) -> DataFrame:
    """source and the ``number`` from which on its rows with a fraction get one more copy.

    ``rated`` has source, size, rate and number, of KEY_BITS + TIE_BITS bits.
    """
    bits = KEY_BITS + TIE_BITS
    kept = rated.groupBy("source").agg(F.sum(F.floor("rate") * F.col("size")).alias("kept"))
    state = _on_source(targets, kept).select("source", (F.col("target") - F.col("kept")).alias("need"), F.lit(0).cast("long").alias("prefix"))
    choices = rated.filter((F.col("rate") > F.floor("rate")) & (F.col("size") > 0)).select("source", "size", "number")
    state = ws.keep(state, "need0")
    for step, low in enumerate(range(bits - DIGIT, -1, -DIGIT), 1):
        # The digit at which the sums from above pass what is still needed; rows below it get nothing.
        before = state.select("source", "need", "prefix")
        near = _on_source(choices, before).filter(F.shiftright("number", low + DIGIT) == F.col("prefix"))
        digits = near.groupBy("source", F.shiftright("number", low).alias("at")).agg(F.sum("size").alias("words"))
        above = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        falls = _on_source(digits.withColumn("above", above), before).filter(F.col("above") <= F.greatest("need", F.lit(0.0)))
        last = falls.groupBy("source").agg(F.min_by(F.struct("at", "above", "words"), F.col("at")).alias("d"))
        following = _on_source(before, last, "left").select(
            "source",
            F.when(F.col("d").isNull(), F.col("need")).otherwise(F.col("need") - F.col("d.above")).alias("need"),
            F.coalesce("d.at", F.shiftleft("prefix", DIGIT)).alias("prefix"),
            F.coalesce("d.words", F.lit(0)).alias("words"),
        )
        state = ws.keep(following, f"need{step}")
        ws.drop(f"need{step - 1}")
    # The rows at the threshold itself are in where that ends nearer to the target than leaving them out.
    return ws.keep(state.select("source", (F.col("prefix") + F.when(F.col("words") <= 2 * F.col("need"), 0).otherwise(1)).alias("edge")), "edges")


def mix_sources(
    spark: SparkSession,
    docs: DataFrame,
    weights: list[int],
    share: float = 1.5,
    most: int = 2,
    text_column: str = "text",
    source_column: str = "source",
    keep_text: bool = False,
) -> DataFrame:
    """``docs`` without the text (unless asked for) plus size, source_size, target, rate, copies and taken."""
    ws = Workspace(spark, "mixing")
    others = [c for c in docs.columns if keep_text or c != text_column]
    packed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"),
        F.col(source_column).alias("source"),
        word_count(F.col(text_column)).alias("size"),
        F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)).alias("seed"),
        F.monotonically_increasing_id().alias("line"),
    )
    sizes = ws.keep(packed.drop("row"), "sizes")
    targets = ws.keep(source_targets(sizes.select("source", "size"), weights, share, most), "targets")
    found = multipliers(sizes.select("source", "size"), targets, ws, most)
    known = ws.keep(_on_source(targets.select("source", "source_size", "target"), found, "left"), "known")

    def rated(rows: DataFrame) -> DataFrame:
        x = F.col("size") / F.col("mean")
        raw = F.least(F.exp(F.least(F.col("multiplier") * x, F.lit(700.0))), F.lit(float(most)))
        whole = F.when(F.abs(raw - F.round(raw)) < 1e-9, F.round(raw)).otherwise(raw)
        rate = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(F.coalesce(whole, F.lit(0.0)))
        unit = F.pmod("seed", F.lit(1 << 32)) / F.lit(float(1 << 32))
        key = ((F.col("rate") - F.floor("rate") - unit + 1) / 2 * F.lit(float((1 << KEY_BITS) - 1))).cast("long")
        tie = F.pmod(F.xxhash64("line"), F.lit(1 << TIE_BITS))
        return _on_source(rows, known).withColumn("rate", rate).withColumn("number", F.shiftleft(key, TIE_BITS).bitwiseOR(tie))

    relieve(spark)
    edges = _edges(rated(sizes), targets.select("source", "target"), ws)
    done = _on_source(rated(packed), edges, "left")
    extra = (F.col("rate") > F.floor("rate")) & (F.col("size") > 0) & (F.col("number") >= F.col("edge"))
    done = done.withColumn("copies", (F.floor("rate") + F.coalesce(extra, F.lit(False)).cast("long")).cast("long"))
    names = ["size", "source_size", "target", "rate", "copies", "taken"]
    out = lambda c: f"input_{c}" if c in names else c
    return done.withColumn("taken", F.col("copies") * F.col("size")).select(*(F.col(f"row.`{c}`").alias(out(c)) for c in others), *names)
