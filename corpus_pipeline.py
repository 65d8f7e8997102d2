"""A corpus pipeline of five stages, each one an operator of grovetally.llm.

Every function takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and reread as the next one's ``docs``.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovetally.llm import decontaminate, jaccard, mixing, secrets, toxicity
from grovetally.llm.queries import MIX_SHARE, MIX_WEIGHTS, table
from grovetally.llm.workspace import Workspace


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score 0.5 or more for toxicity; null texts score as empty ones and stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.reject_toxic(docs, model, 0.5)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group of linked texts (five words, 0.8).

    Texts without words are linked with nothing and stay, and so do documents without an id.
    """
    ws = Workspace(spark, "groups")
    grouped = jaccard.join_sets(spark, docs, size=5, percent=80)
    rest = grouped.filter("n_shingles > 0 AND component_id IS NOT NULL AND NOT doc_id <=> component_id")
    # Only ids move; documents without an id cannot be told apart and stay.
    gone = ws.keep(rest.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, re-parameterised ones too; with no items all stay."""
    return decontaminate.remove_contaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets; n_chars, where there is such a column and it is not null, is the length of what is left."""
    masked = secrets.redact_secrets(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")).cast(docs.schema["n_chars"].dataType))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their copies; those of no copies go."""
    mixed = mixing.mix_sources(spark, docs, MIX_WEIGHTS, MIX_SHARE, keep_text=True)
    return mixed.filter("copies > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", keep_one_of_each_group),
    ("decontaminate", drop_contaminated),
    ("secrets", redact),
    ("mix", mix),
]

#: SQL cannot express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and reread."""
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = ws.keep(stage(spark, docs, sf_dir), name)
    return docs
