"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, jaccard, langid, lm, mixing, secrets, toxicity, urls, warc

# The weights of sources in order, repeating, and the share of all words they get.
MIX_WEIGHTS, MIX_SHARE = [3, 1, 2], 1.5

# The rules that judge pages.
URL_RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_aq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark, table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


def op8_vertical_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_sets(spark, table(spark, sf_dir, "documents"), size=4, percent=85)


def op9_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder(5) != 0)
    scored = toxicity.score(docs, model)
    held_out = F.coalesce(remainder(5) == 0, F.lit(True))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_pages(spark, table(spark, sf_dir, "pages"), min_revisit=0)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


def op1_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix_sources(spark, docs, MIX_WEIGHTS, MIX_SHARE)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def remainder(k: int) -> Column:
    """crc32 of the id as text modulo k; a null id has none."""
    return F.crc32(F.col("doc_id").cast("string")) % k


def op2_nce_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(spark, table(spark, sf_dir, "documents"), remainder(10) != 0)


def op3_template_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    found = decontaminate.contaminated(spark, docs, items)
    return found.select("doc_id", "item_id", F.col("matched").cast("long").alias("matched"), F.col("item_windows").cast("long").alias("item_windows"), "reparameterised")


def op4_langmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, remainder(4) != 2)
    held_out = F.coalesce(remainder(4) == 2, F.lit(False))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_secret_dfa(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = {r.kind for r in secrets.BASE_RULES}
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")),
        F.sha2(secrets.spans_text(F.filter("spans", lambda s: s["kind"].isin(*sorted(base)))), 256).alias("base_sha256"),
        secrets.spans_text(F.col("spans")).alias("spans"),
    )


def op6_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(spark, table(spark, sf_dir, "pages"), URL_RULES)


QUERIES = {
    "op1_entropy_mix": op1_entropy_mix,
    "op2_nce_lm": op2_nce_lm,
    "op3_template_decontam": op3_template_decontam,
    "op4_langmask": op4_langmask,
    "op5_secret_dfa": op5_secret_dfa,
    "op6_url_templates": op6_url_templates,
    "op7_aq_search": op7_aq_search,
    "op8_vertical_join": op8_vertical_join,
    "op9_nnpu_toxicity": op9_nnpu_toxicity,
    "op10_warc": op10_warc,
}

ORACLES: dict[str, str] = {}
