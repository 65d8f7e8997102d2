"""Small rules and reports over names, identifiers, volumes, mounts and bench runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as p
from . import diff

# Names of volume roles by bit.
ROLES = {1: "system", 2: "user", 4: "recovery", 8: "vm", 16: "preboot", 32: "installer", 64: "data", 128: "baseband"}


def mode_of(path: Column, is_directory: Column) -> Column:
    """How a scan target is read: devices and images raw, directories by walking."""
    return F.when(F.startswith(path, F.lit("/dev/")), "raw").when(is_directory, "fallback").otherwise("raw")


def admitted(path: Column) -> Column:
    """Raw sources are whole disks, slices of them, or disk images, and nothing else."""
    return path.rlike(r"^/dev/r?disk[0-9]+(s[0-9]+)*$") | F.endswith(F.lower(path), F.lit(".dmg"))


def option(value: Column, known: list[str], fallback: str) -> Column:
    """A named option in any case; empty or absent means ``fallback``, unknown ones are null."""
    low = p.ascii_lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(low == "", F.lit(fallback)).when(low.isin(*known), low)


def threads(value: Column, cores: int, most: int = 4) -> Column:
    """A thread count of at least 1; absent, zero or not a number means the cores, up to ``most``."""
    n = F.expr("1") * F.when(value.rlike("^[0-9]{1,9}$"), value).cast("long")
    return F.when(n >= 1, n).otherwise(F.lit(max(1, min(cores, most))).cast("long"))


def resolved(root: Column, relative: Column) -> Column:
    """Where a relative path leads below a root, ``..`` and ``.`` taken away by name; null where it leaves the root."""
    steps = F.filter(F.split(relative, "/"), lambda s: (s != "") & (s != "."))
    walked = F.aggregate(
        steps,
        F.struct(F.lit(True).alias("ok"), F.array().cast("array<string>").alias("at")),
        lambda w, s: F.when(s != "..", F.struct(w["ok"].alias("ok"), F.array_append(w["at"], s).alias("at")))
        .when(F.size(w["at"]) > 0, F.struct(w["ok"].alias("ok"), F.slice(w["at"], 1, F.size(w["at"]) - 1).alias("at")))
        .otherwise(F.struct(F.lit(False).alias("ok"), w["at"].alias("at"))),
    )
    whole = F.concat_ws("/", F.regexp_replace(root, "/+$", ""), F.array_join(walked["at"], "/"))
    return F.when(walked["ok"], F.regexp_replace(whole, "/+$", ""))


def uuid_text(hexed: Column) -> Column:
    """32 hex digits in the usual groups, upper case."""
    up = F.upper(hexed)
    return F.concat_ws("-", *(F.substring(up, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def precedence(kind: Column, compressed: Column, sparse: Column, shared: Column) -> Column:
    """Which rule decides a row's size."""
    return F.when(kind == "symlink", "symlink").when(kind != "file", "not_a_file").when(compressed, "compressed").when(sparse, "sparse").when(shared, "shared").otherwise("ordinary")


def identity_key(*columns: Column) -> Column:
    """SHA-256 over the text of what identifies an object, parts kept apart; null counts as empty."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)), 256)


def block_hash(data: Column) -> Column:
    return F.sha2(data, 256)


def scan_key(volume: Column, path: Column) -> Column:
    """The name a scan is stored under: volume and path without empty segments."""
    return F.substring(F.sha2(F.concat_ws(":", volume.cast("string"), p.normalised(path)), 256), 1, 16)


def report(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Every row with its named checks, those it failed, and whether it passed."""
    failed = F.filter(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items())), lambda x: x.isNotNull())
    return rows.select("*", *(F.coalesce(c, F.lit(False)).alias(name) for name, c in checks.items()), F.array_join(failed, ",").alias("failed")).withColumn("valid", F.col("failed") == "")


def sizes_per_inode(rows: DataFrame) -> DataFrame:
    """file_id, its distinct sizes in order, and whether it is sparse: less allocated than its size."""
    found = rows.groupBy("file_id").agg(F.sort_array(F.collect_set("logical_size")).alias("s"), F.bool_or(F.coalesce(F.col("allocated_size") < F.col("logical_size"), F.lit(False))).alias("sparse"))
    return found.select("file_id", F.array_join(F.transform("s", lambda x: x.cast("string")), ",").alias("sizes"), "sparse")


def normalised_rows(rows: DataFrame, names: dict[str, str], kinds: dict[str, str]) -> DataFrame:
    """Rows of one shape for a diff: columns renamed, the rest dropped, cast, and -1 for unknown made null."""
    out = [F.col(old).cast(kinds[new]).alias(new) for old, new in names.items()]
    frame = rows.select(*out)
    return frame.select(*(F.nullif(F.col(c), F.lit(-1)).alias(c) if kinds[c] in ("long", "int") else F.col(c) for c in frame.columns))


def hexed_paths(rows: DataFrame) -> DataFrame:
    """path, and its name's UTF-8 bytes in hex, the root among them with an empty name."""
    named = rows.select("path", "file_id", F.lower(F.hex(F.encode(p.basename(F.col("path")), "UTF-8"))).alias("name_hex"))
    root = rows.sparkSession.range(1).select(F.lit(p.ROOT).alias("path"), F.lit(2).cast("long").alias("file_id"), F.lit("").alias("name_hex"))
    return named.unionByName(root)


def scaling(runs: DataFrame) -> DataFrame:
    """query, threads, permille of the one-thread time, and what that means; ``runs`` has query, threads and ns."""
    means = runs.groupBy("query", "threads").agg(F.avg("ns").alias("ns"))
    one = means.filter("threads = 1").select("query", F.col("ns").alias("base"))
    gain = F.col("base") / F.nullif(F.col("ns"), F.lit(0.0))
    verdict = F.when(F.col("base").isNull(), "no_baseline").when(gain >= F.col("threads") * 0.7, "scales").when(gain > 1.1, "gains").otherwise("flat")
    return means.join(one, "query", "left").select("query", "threads", F.floor(gain * 1000).alias("permille"), verdict.alias("verdict"))


def volumes(containers: DataFrame) -> DataFrame:
    """One row for each volume of nested containers (container, volumes: name, roles, encrypted, files)."""
    return containers.select("container", F.posexplode("volumes").alias("at", "v")).select("container", "at", "v.*")


def volume_report(flat: DataFrame) -> DataFrame:
    """One row: volumes, encrypted ones, those of the data role and their files."""
    data = F.array_contains("roles", "data")
    return flat.agg(F.count(F.lit(1)).alias("volumes"), F.count_if("encrypted").alias("encrypted"), F.count_if(data).alias("data"), F.coalesce(F.sum(F.when(data, F.col("files"))), F.lit(0)).alias("data_files"))


def mounts(lines: DataFrame) -> DataFrame:
    """device, folder, type and flags of a mount listing's lines ``device on folder (type, option, ...)``."""
    pattern = r"^(.+?) on (.+) \(([^()]*)\)$"
    field = lambda k: F.regexp_extract("value", pattern, k)
    options = F.transform(F.split(field(3), ","), lambda x: F.trim(x))
    rows = lines.filter(F.col("value").rlike(pattern)).select(field(1).alias("device"), field(2).alias("folder"), options.alias("options"))
    return rows.select("device", "folder", F.col("options")[0].alias("type"), F.exists("options", lambda x: x == "read-only").alias("read_only"), F.exists("options", lambda x: x == "sealed").alias("sealed"))


def role_labels(bits: Column) -> Column:
    return F.when(bits == 0, F.lit("none")).otherwise(p.labels(bits, ROLES))


def volume_name(data: Column) -> Column:
    """A name field's UTF-8 bytes up to the first zero byte."""
    return F.regexp_extract(F.decode(data, "UTF-8"), "(?s)^([^\x00]*)", 1)


def by_colour(cells: DataFrame) -> DataFrame:
    """fill_rgb and how many leaf cells of what area are drawn in it."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return cells.groupBy("fill_rgb").agg(F.count(F.lit(1)).alias("cells"), F.sum(area).alias("area"))


def skip_samples(skips: DataFrame, k: int = 5) -> DataFrame:
    """reason, how often, its k least paths, and how many there are besides."""
    from pyspark.sql import Window

    ranked = skips.withColumn("rank", F.row_number().over(Window.partitionBy("reason").orderBy("path"))).filter(F.col("rank") <= k)
    shown = ranked.groupBy("reason").agg(F.array_join(F.sort_array(F.collect_list("path")), ",").alias("paths"))
    counts = skips.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(shown, "reason").withColumn("overflow", F.greatest(F.col("n") - k, F.lit(0)))


def churn(scans: list[tuple[str, DataFrame]], fields: list[str]) -> DataFrame:
    """phase, field and how many rows differ, from each scan to the next one named."""
    out = None
    for (_, before), (phase, after) in zip(scans, scans[1:]):
        found = diff.summary(diff.long_form(before, after, fields)).withColumn("phase", F.lit(phase))
        out = found if out is None else out.unionByName(found)
    return out.select("phase", "field", "n")


def unbalanced(owners: DataFrame, totals: DataFrame) -> DataFrame:
    """One row: streams, and those whose owners' shares do not add up to their bytes."""
    shares = owners.groupBy("stream_id").agg(p.full_sum(F.col("real_size")).alias("shares"))
    joined = totals.join(shares, "stream_id", "left")
    return joined.agg(F.count(F.lit(1)).alias("streams"), F.count_if(~F.col("shares").eqNullSafe(F.col("bytes"))).alias("unbalanced"))
