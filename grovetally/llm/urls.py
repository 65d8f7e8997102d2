"""URL filters: host and path rules, then a path-template tree for the rest.

Urls that a rule fits are judged by it and are the labels of the rest.  Paths are
cut into segments, digits and long hexadecimal runs become placeholders, and the
tree of every host is walked level by level: sibling branches whose labels do not
differ from those of all siblings together are merged into one, a wildcard, and
where there are many siblings those without labels join it, too.  Elsewhere branches
without labels stay apart and are judged by the same typed path on all hosts, so a
verdict does not turn with the number of rows.  A branch that holds one typed path
has nothing to merge and is not walked further.  A template is rejected where its
share of blocked labels, smoothed towards the same typed path on all hosts and
then towards all labels, reaches ``reject_at``.

Everything after the first aggregation works on distinct (host, typed path) rows;
each later step adds counts map-side, so a host with a third of all urls is no
larger a group than the number of its distinct typed paths, spread by path.

Defined cases.  A null url, or one without ``://``, has an empty host and path; no
rule fits it (unless its host is empty) and it is judged by the template of the
empty path.  Of fitting rules the longest host plus path wins, the first listed of
equal ones.  Repeated rows are judged alike and weigh as often as they occur.
Extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace

#: Rules are literals of the plan; longer lists belong into a joined table.
MOST_RULES = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The struct (rule, verdict) of the longest fitting rule, else null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        name, slash, rest = rule.partition("/")
        by_host.setdefault(name, []).append((slash + rest, rule, verdict))
    result = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), F.lit(-1).alias("length"))
    hits = []
    for name, entries in by_host.items():
        inside = (host == name) | F.endswith(host, F.lit("." + name))
        first = reduce(
            lambda rest, e: F.when(F.startswith(path, F.lit(e[0])), F.struct(F.lit(e[1]).alias("rule"), F.lit(e[2]).alias("verdict"), F.lit(len(e[1])).alias("length"))).otherwise(rest),
            reversed(entries),
            result,
        )
        hits.append(F.when(inside, first).otherwise(result))
    return reduce(lambda a, b: F.when(b["length"] > a["length"], b).otherwise(a), hits, result)


def typed(path: Column) -> Column:
    """The segments of a path with its evidently variable parts as placeholders."""
    plain = F.regexp_replace(F.regexp_replace(path, r"(?i)(?<![0-9a-z])[0-9a-f-]*[0-9][0-9a-f-]{7,}(?![0-9a-z])", "{x}"), r"[0-9]+", "{n}")
    return F.filter(F.split(plain, "/"), lambda s: s != "")


def _sums(frame: DataFrame, *keys: str) -> DataFrame:
    return frame.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))


def template_tree(paths: DataFrame, ws: Workspace, most_children: int = 24, z: float = 2.0) -> DataFrame:
    """``paths`` (host, segments, n, labelled, blocked) with the ``template`` of each row."""
    tree = ws.keep(paths.withColumn("template", F.lit("")).withColumn("closed", F.lit(False)), "level0")
    done, level = [], 0
    while not (open_ := tree.filter("NOT closed")).isEmpty():
        walked = open_.withColumn("here", F.get("segments", F.lit(level)))
        children = walked.filter("here IS NOT NULL").groupBy("host", "template", "here").agg(
            F.count(F.lit(1)).alias("paths"), F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")
        )
        siblings = children.groupBy("host", "template").agg(
            F.count(F.lit(1)).alias("kinds"), F.sum("paths").alias("all_paths"), F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked")
        )
        pooled = (F.col("all_blocked") + 0.5) / (F.col("all_labelled") + 1.0)
        own = F.col("blocked") / F.col("labelled")
        similar = (F.col("labelled") > 0) & (F.abs(own - pooled) <= z * F.sqrt(pooled * (1 - pooled) / F.col("labelled")))
        unknown = (F.col("labelled") == 0) & (F.col("kinds") > most_children)
        named = children.join(siblings, ["host", "template"]).select(
            "host",
            "template",
            "here",
            F.when((F.col("kinds") > 1) & (similar | unknown), F.lit("*")).otherwise(F.col("here")).alias("branch"),
            (F.col("all_paths") == 1).alias("lone"),
        )
        rest = F.array_join(F.slice("segments", level + 1, F.greatest(F.size("segments") - level, F.lit(0))), "/")
        grown = walked.join(named, ["host", "template", "here"], "left").select(
            "host",
            "segments",
            "n",
            "labelled",
            "blocked",
            F.when(F.col("branch").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), F.when(F.col("lone"), rest).otherwise(F.col("branch")))).alias("template"),
            (F.col("branch").isNull() | F.col("lone")).alias("closed"),
        )
        level += 1
        tree = ws.keep(grown, f"level{level}")
        done.append(tree.filter("closed").drop("closed"))
    out = tree.filter("closed").drop("closed") if not done else done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def judge_urls(
    spark: SparkSession,
    pages: DataFrame,
    rules: list[tuple[str, str]],
    id_column: str = "page_id",
    url_column: str = "url",
    most_children: int = 24,
    weight: float = 4.0,
    reject_at: float = 0.5,
) -> DataFrame:
    """id, host, path, rule, verdict, template and purity of every row of ``pages``."""
    ws = Workspace(spark, "urls")
    rows = pages.select(F.col(id_column).alias("id"), host_of(F.col(url_column)).alias("host"), path_of(F.col(url_column)).alias("path"))
    rows = rows.withColumn("fit", best_rule(F.col("host"), F.col("path"), rules)).withColumn("segments", typed(F.col("path")))
    labelled = F.col("fit.verdict").isNotNull()
    paths = rows.groupBy("host", "segments").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(labelled.cast("long")).alias("labelled"),
        F.sum((labelled & (F.col("fit.verdict") == "block")).cast("long")).alias("blocked"),
    )
    tree = template_tree(paths, ws, most_children)

    whole = tree.agg(F.sum("labelled").alias("l0"), F.sum("blocked").alias("b0")).select(
        ((F.coalesce("b0", F.lit(0)) + 0.5) / (F.coalesce("l0", F.lit(0)) + 1.0)).alias("base")
    )
    base = whole.first()["base"]
    across = _sums(tree, "segments").select("segments", ((F.col("blocked") + weight * base) / (F.col("labelled") + weight)).alias("prior"))
    own = _sums(tree, "host", "template").select("host", "template", F.col("labelled").alias("tl"), F.col("blocked").alias("tb"))
    judged = tree.select("host", "segments", "template").join(own, ["host", "template"]).join(across, "segments")
    judged = judged.select("host", "segments", "template", ((F.col("tb") + weight * F.col("prior")) / (F.col("tl") + weight)).alias("purity"))
    judged = ws.keep(judged, "judged")
    found = rows.join(judged, ["host", "segments"], "left")
    method = F.when(F.col("purity") >= reject_at, F.lit("block")).otherwise(F.lit("allow"))
    return found.select(
        F.col("id").alias(id_column), "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", method).alias("verdict"), "template", "purity"
    )
