"""Squarified treemaps (Bruls, Huizing, van Wijk 2000) of a hierarchy's totals."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as p
from ..scratch import Scratch

# Colours by kind, for unknown sizes and for files without extension, then by extension.
UNKNOWN, DIRECTORY, SYMLINK, OTHER, PLAIN = 0x3B3F4A, 0x1E2330, 0x7D8A99, 0x5B6779, 0x9AA3B2
PALETTE = {
    0xA0C4FF: "txt md",
    0xFFC09F: "rs",
    0xFFD6A5: "py",
    0xFFE066: "js ts tsx jsx",
    0xF4D35E: "json",
    0xFF8FAB: "html",
    0xCAFFBF: "css",
    0xBDB2FF: "c cpp h hpp",
    0xFDB5A5: "swift",
    0x9BF6FF: "go",
    0xFFB3C1: "rb",
    0x8ECAE6: "png jpg jpeg gif webp heic svg icns",
    0xB388EB: "mp4 mov mp3 wav m4a flac",
    0xEF476F: "pdf doc docx pages",
    0xADB5BD: "zip tar gz bz2 dmg iso",
    0xFFAFCC: "app framework dylib so",
}


def hashed_colour(text: Column) -> Column:
    """A hue by the FNV-1a hash of a text, at saturation 0.45 and lightness 0.70."""
    saturation, lightness = 0.45, 0.70
    hue = p.fnv1a(text) % 360
    # Red, green and blue are one curve a third of the circle apart: chroma above the floor as far as the hue is near.
    chroma = (1 - abs(2 * lightness - 1)) * saturation
    floor = lightness - chroma / 2

    def channel(turn: int) -> Column:
        sixths = F.pmod(hue + turn, F.lit(360)) / F.lit(60.0)
        return F.floor((F.lit(floor) + F.lit(chroma) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.abs(sixths - 3) - 1))) * 255 + 1e-9).cast("long")

    return channel(0) * 65536 + channel(240) * 256 + channel(120)


def fill(name: Column, kind: Column, unknown: Column) -> Column:
    """Colour of a cell: by kind; of files by extension, from the palette (case aside) or else hashed as it is written."""
    ext = F.regexp_extract(name, r"(?s)^.+\.([^.]+)$", 1)
    listed = F.create_map(*(F.lit(x) for colour, names in PALETTE.items() for e in names.split() for x in (e, colour)))
    file = F.when(ext == "", F.lit(PLAIN).cast("long")).otherwise(F.coalesce(F.try_element_at(listed, p.ascii_lower(ext)).cast("long"), hashed_colour(ext)))
    kinds = F.when(unknown, UNKNOWN).when(kind == "dir", DIRECTORY).when(kind == "symlink", SYMLINK).when(kind == "other", OTHER)
    return F.coalesce(kinds.cast("long"), file)


# The ratio rows are packed towards, and in pixels the edge around a cell, the least area, and a label's height and least width.
RATIO, EDGE, LEAST_AREA, LABEL, LABEL_WIDTH = 1.4, 1.0, 1.0, 14.0, 48.0


def squarify(values: list[float], x: float, y: float, w: float, h: float, aspect: float = RATIO) -> list[tuple[float, float, float, float]]:
    """Rectangles of areas in proportion to values (largest first), rows packed while they get nearer to ``aspect``."""
    out: list[tuple[float, float, float, float]] = []
    total = float(sum(values))
    if total <= 0 or w <= 0 or h <= 0:
        return [(x, y, x, y)] * len(values)
    areas = [v * w * h / total for v in values]
    at = 0
    while at < len(areas):
        side = min(w, h)
        row, size, worst = at, 0.0, float("inf")
        while row < len(areas):
            grown = size + areas[row]
            thick = grown / side
            square = thick * thick / aspect
            ratio = max(max(square / a, a / square) if a > 0 else float("inf") for a in (areas[at], areas[row]))
            if ratio > worst:
                break
            size, worst, row = grown, ratio, row + 1
        row = max(row, at + 1)
        size = sum(areas[at:row])
        thick, along = size / side, 0.0
        for a in areas[at:row]:
            length = a / thick if thick else 0.0
            out.append((x, y + along, x + thick, y + along + length) if w >= h else (x + along, y, x + along + length, y + thick))
            along += length
        x, y, w, h = (x + thick, y, w - thick, h) if w >= h else (x, y + thick, w, h - thick)
        at = row
    return out


def cells(nodes: DataFrame, max_depth: int, width: float, height: float, metric: str = "value_logical") -> DataFrame:
    """path, depth and x0, y0, x1, y1 of every node down to ``max_depth``; the root has none and fills all.

    Level by level: the children of each laid-out node are packed by one task per
    node, so a level is as parallel as it has nodes, and each level is written to
    the shared folder.  Below the root a cell's children lie inside its edge, and
    below a label where there is room for one.
    """
    ws = Scratch(nodes.sparkSession, "cells")
    sized = nodes.withColumn("value", F.coalesce(F.col(metric), F.lit(0)).cast("double")).filter("value > 0")
    kids = sized.filter(F.col("path") != p.ROOT).select(p.parent(F.col("path")).alias("parent"), "path", "value", p.depth(F.col("path")).alias("depth"))
    spark = nodes.sparkSession
    above = spark.createDataFrame([(p.ROOT, 0.0, 0.0, width, height)], "parent string, px0 double, py0 double, px1 double, py1 double")
    schema = "path string, depth int, x0 double, y0 double, x1 double, y1 double"

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["value", "path"], ascending=[False, True])
        x0, y0, x1, y1 = frame[["px0", "py0", "px1", "py1"]].iloc[0]
        out = pd.DataFrame(squarify(frame["value"].tolist(), x0, y0, x1 - x0, y1 - y0), columns=["x0", "y0", "x1", "y1"])
        out.insert(0, "depth", frame["depth"].astype("int32").to_numpy())
        out.insert(0, "path", frame["path"].to_numpy())
        return out[(out.x1 - out.x0) * (out.y1 - out.y0) >= LEAST_AREA]

    laid = None
    for level in range(1, max_depth + 1):
        here = ws.keep(kids.filter(F.col("depth") == level).join(above, "parent").groupBy("parent").applyInPandas(pack, schema), f"level{level}")
        laid = here if laid is None else laid.unionByName(here)
        inner = here.select(F.col("path").alias("parent"), (F.col("x0") + EDGE).alias("px0"), (F.col("y0") + EDGE).alias("py0"), (F.col("x1") - EDGE).alias("px1"), (F.col("y1") - EDGE).alias("py1"))
        room = (F.col("px1") - F.col("px0") >= LABEL_WIDTH) & (F.col("py1") - F.col("py0") >= LABEL + 4)
        inner = inner.withColumn("py0", F.when(room, F.col("py0") + LABEL).otherwise(F.col("py0")))
        above = inner.filter((F.col("px1") > F.col("px0")) & (F.col("py1") > F.col("py0"))).filter((F.col("px1") - F.col("px0")) * (F.col("py1") - F.col("py0")) >= LEAST_AREA)
    return laid


def hits(points: DataFrame, laid: DataFrame, width: float, height: float, bins: int = 64) -> DataFrame:
    """For every point (point_id, x, y) the deepest cell that holds it, by a grid of bins."""
    bin_of = lambda c, size: F.least(F.floor(c * bins / size), F.lit(bins - 1)).cast("int")
    spread = laid.withColumn("bx", F.explode(F.sequence(bin_of(F.col("x0"), width), bin_of(F.col("x1"), width)))).withColumn("by", F.explode(F.sequence(bin_of(F.col("y0"), height), bin_of(F.col("y1"), height))))
    asked = points.withColumn("bx", bin_of(F.col("x"), width)).withColumn("by", bin_of(F.col("y"), height))
    met = asked.join(spread, ["bx", "by"]).filter("x0 <= x AND x < x1 AND y0 <= y AND y < y1")
    return met.groupBy("point_id").agg(F.max_by("path", F.col("depth")).alias("path"))
