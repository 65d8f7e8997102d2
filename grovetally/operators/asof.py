"""Versioned objects: the state of a key-value table as of a transaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Flag bits of a mapping.
DELETED, SAVED, ENCRYPTED, NOHEADER, CRYPTO_GENERATION = 1, 2, 4, 8, 16
FLAG_NAMES = {DELETED: "deleted", SAVED: "saved", ENCRYPTED: "encrypted", NOHEADER: "noheader", CRYPTO_GENERATION: "crypto_generation"}


def rejected(flags: Column) -> Column:
    """Why a version cannot be used: any flag but deleted and saved, known or not; else null."""
    return F.when(flags.bitwiseAND(F.lit(~(DELETED | SAVED))) != 0, F.lit("unsupported_flags"))


def as_of(versions: DataFrame, most: int) -> DataFrame:
    """Of each oid the version of greatest xid up to ``most``; none where that one is deleted.

    ``reject`` tells of flags that make the version unusable.
    """
    last = versions.filter(F.col("xid") <= most).groupBy("oid").agg(F.max_by(F.struct("xid", "paddr", "flags"), F.col("xid")).alias("v"))
    return last.select("oid", "v.*").filter(F.col("flags").bitwiseAND(F.lit(DELETED)) == 0).withColumn("reject", rejected(F.col("flags")))


def as_of_each(probes: DataFrame, versions: DataFrame, cuts: int = 64) -> DataFrame:
    """For every probe (probe_id, oid, most) the version of its oid as of ``most``, deleted ones left out.

    Probes and versions are put in one order by xid and the last version is carried
    along, so a probe is never paired with more than one version.  The order is cut
    into ``cuts`` ranges of xid, each sorted on its own, so a hot oid is spread over
    them; what the ranges before hold is carried over in one row for each range.
    """
    ends = versions.agg(F.min("xid").alias("lo"), F.max("xid").alias("hi")).first()
    lo, width = ends["lo"] or 0, max(1, -(-((ends["hi"] or 0) - (ends["lo"] or 0) + 1) // cuts))
    cut = F.greatest(F.lit(-1), F.least(F.floor((F.col("xid") - lo) / F.lit(width)), F.lit(cuts))).alias("cut")
    version = F.struct("xid", "paddr", "flags")
    known = versions.select("oid", "xid", cut, version.alias("v"))
    both = known.select("oid", "xid", "cut", F.lit(0).alias("asks"), F.lit(None).cast(probes.schema["probe_id"].dataType).alias("probe_id"), "v").unionByName(
        probes.select("oid", F.col("most").alias("xid"), "probe_id").select("oid", "xid", cut, F.lit(1).alias("asks"), "probe_id", F.lit(None).cast(known.schema["v"].dataType).alias("v"))
    )
    order = Window.partitionBy("oid", "cut").orderBy("xid", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("v", F.last("v", ignorenulls=True).over(order)).filter("asks = 1")
    ranges = known.groupBy("oid", "cut").agg(F.max_by("v", F.col("xid")).alias("last"))
    until = Window.partitionBy("oid").orderBy("cut")
    carried = ranges.select("oid", F.col("cut").alias("from_cut"), F.coalesce(F.lead("cut").over(until), F.lit(cuts)).alias("to_cut"), "last")
    carried = carried.select("oid", F.explode(F.sequence(F.col("from_cut") + 1, F.col("to_cut"))).alias("cut"), "last")
    found = near.join(carried, ["oid", "cut"], "left").select("probe_id", "oid", F.coalesce("v", "last").alias("v")).filter("v IS NOT NULL")
    return found.select("probe_id", "oid", "v.*").filter(F.col("flags").bitwiseAND(F.lit(DELETED)) == 0).withColumn("reject", rejected(F.col("flags")))


def summarise(versions: DataFrame, most: int) -> DataFrame:
    """One row: flags over all rows, counts and the last xid up to ``most``."""
    counts = [F.count_if(F.col("flags").bitwiseAND(F.lit(bit)) != 0).alias(f"n_{name}") for bit, name in FLAG_NAMES.items()]
    seen = F.col("xid") <= most
    return versions.agg(F.count_if(seen).alias("mapping_count"), F.max(F.when(seen, F.col("xid"))).alias("max_observed_xid"), *counts)


def latest(candidates: DataFrame) -> DataFrame:
    """The valid candidate of greatest xid, then of greatest index."""
    return candidates.filter("valid").agg(F.max_by(F.struct("xid", "descriptor_index", "block"), F.struct("xid", "descriptor_index")).alias("c")).filter("c IS NOT NULL").select("c.*")
