"""Column builders over paths, names and kinds: built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROOT = "."
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(path: Column) -> Column:
    """Empty segments dropped; the empty path is the root."""
    joined = F.array_join(F.filter(F.split(path, "/"), lambda s: s != ""), "/")
    return F.when((joined == "") | (joined == ROOT), F.lit(ROOT)).otherwise(joined)


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: (s != "") & (s != ROOT))


def ancestors(path: Column) -> Column:
    """Directories above a path, the root first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit(ROOT)).otherwise(F.array_join(F.slice(parts, 1, i), "/")))


def parent(path: Column) -> Column:
    """The directory that holds a path; null for the root."""
    cut = F.regexp_extract(path, "(?s)^(.*)/[^/]*$", 1)
    return F.when(path == ROOT, F.lit(None).cast("string")).when(cut == "", F.lit(ROOT)).otherwise(cut)


def basename(path: Column) -> Column:
    return F.when(path == ROOT, F.lit("")).otherwise(F.element_at(F.split(path, "/"), -1))


def depth(path: Column) -> Column:
    return F.when(path == ROOT, F.lit(0)).otherwise(F.size(F.split(path, "/")))


def inside(path: Column, folder: str) -> Column:
    """A folder itself and everything below it, by whole segments."""
    if folder in ("", "/", ROOT):
        return F.lit(True)
    return (path == folder) | F.startswith(path, F.lit(folder + "/"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def extension(name: Column, kind: Column) -> Column:
    """Last dot onwards, A-Z lower-cased; dots at either end do not count."""
    found = F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1)
    file = F.when(found == "", F.lit("(no ext)")).otherwise(ascii_lower(found))
    return F.when(kind == "file", file).otherwise(F.concat(F.lit("("), kind, F.lit(")")))


def kind_of_mode(mode: Column) -> Column:
    """Entry kind of POSIX mode bits."""
    top = mode.bitwiseAND(F.lit(0o170000))
    return F.when(top == 0o100000, "file").when(top == 0o040000, "dir").when(top == 0o120000, "symlink").otherwise("other")


MOST = (1 << 63) - 1


def full_sum(x: Column) -> Column:
    """A sum of sizes that stops at the largest long; 0 of no rows."""
    return F.when(F.count(x) == 0, F.lit(0).cast("long")).otherwise(F.coalesce(F.try_sum(x), F.lit(MOST)))


def null_sum(x: Column) -> Column:
    """A sum of sizes that any null makes null; 0 of no rows."""
    return F.when(F.count_if(x.isNull()) > 0, F.lit(None).cast("long")).otherwise(full_sum(x))


def labels(flags: Column, names: dict[int, str]) -> Column:
    """Names of the set bits, in order, comma-joined."""
    return F.array_join(F.filter(F.array(*(F.when(flags.bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for bit, name in names.items())), lambda x: x.isNotNull()), ",")


def sanitised(text: Column) -> Column:
    """Control and direction-changing characters as U+FFFD; tab, line feed and return stay."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\x{202A}-\x{202E}\x{2066}-\x{2069}]", "�")


def fnv1a(data: Column) -> Column:
    """32-bit FNV-1a of a string's UTF-8 bytes, as a long."""
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda i: F.conv(F.hex(F.substring(F.encode(data, "UTF-8"), i, F.lit(1))), 16, 10).cast("long"))
    codes = F.when(F.octet_length(data) == 0, F.array().cast("array<long>")).otherwise(codes)
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(b) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long")))


def size_text(size: Column) -> Column:
    """Bytes in binary units with one decimal; unknown sizes say so."""
    unit = F.when(size < 1024, 0).when(size < 1 << 20, 1).when(size < 1 << 30, 2).when(size < 1 << 40, 3).otherwise(4)
    names = F.array(*(F.lit(n) for n in ("B", "KiB", "MiB", "GiB", "TiB")))
    tenths = F.floor(size * 10 / F.pow(F.lit(1024.0), unit)).cast("long")
    scaled = F.concat((tenths / 10).cast("long").cast("string"), F.lit("."), (tenths % 10).cast("string"))
    return F.when(size.isNull(), F.lit("unclaimed")).when(unit == 0, F.concat(size.cast("string"), F.lit(" B"))).otherwise(F.concat(scaled, F.lit(" "), F.get(names, unit)))
