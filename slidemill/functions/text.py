"""Text and number rules of container metadata, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: First line of the descriptions, by which viewers know the layout.
VERSION = "Aperio Image Library v12.4.3"


def extension(path: Column) -> Column:
    """Lower-cased extension, empty where the name has none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def labelled_number(text: Column, *labels: str) -> Column:
    """The positive number after the first label, in their order, that one follows."""
    found = []
    for label in labels:
        digits = F.regexp_extract(F.lower(text), rf"{label}[ \t\r\n\f=:|]*([0-9.+-]+)", 1)
        value = digits.try_cast("double")
        found.append(F.when(value > 0, value))
    return F.coalesce(*found)


def mpp_from(resolution: Column, unit: Column) -> Column:
    """Micrometres per pixel of a resolution per centimetre (3) or inch (2); null for others."""
    ok = resolution.isNotNull() & ~F.isnan(resolution) & (resolution > 0) & (resolution < float("inf"))
    return F.when(ok & (unit == 3), 10000.0 / resolution).when(ok & (unit == 2), 25400.0 / resolution)


def page_kind(description: Column, subfile: Column) -> Column:
    """label, macro or thumbnail by description; null for reduced images and others."""
    d = F.lower(description)
    out = F.when(subfile.bitwiseAND(F.lit(1).cast("long")) != 0, F.lit(None).cast("string"))
    for kind in ("label", "macro", "thumbnail"):
        out = out.when(d.contains(kind), kind)
    return out


def first_parse(kind: str, *values: Column) -> Column:
    """The first value that parses."""
    return F.coalesce(*(v.try_cast(kind) for v in values))


def description(width: Column, height: Column, tile_w: Column, tile_h: Column, quality: Column, app_mag: Column, mpp: Column) -> Column:
    mag = F.when(app_mag == F.floor(app_mag), app_mag.cast("long").cast("string")).otherwise(app_mag.cast("string"))
    return F.format_string(VERSION + "\n%dx%d [0,0 %dx%d] (%dx%d) JPEG/RGB Q=%d|AppMag = %s|MPP = %.6f", width, height, width, height, tile_w, tile_h, quality, mag, mpp)


def pyramid_summary(levels: DataFrame) -> DataFrame:
    """L0=WxH (CxR tiles), ... of each slide, in level order."""
    part = F.format_string("L%d=%dx%d (%dx%d tiles)", "level", "width", "height", "cols", "rows")
    parts = F.array_sort(F.collect_list(F.struct("level", part.alias("part"))))
    return levels.groupBy("slide_id").agg(F.array_join(F.transform(parts, lambda p: p["part"]), ", ").alias("pyramid"))


def ini_values(lines: DataFrame) -> DataFrame:
    """section.key and value of INI lines (file, line, text); the last of equal keys wins."""
    text = F.trim("text")
    order = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    header = text.startswith("[") & text.endswith("]")
    out = lines.withColumns({"header": header, "section": F.coalesce(F.last(F.when(header, F.lower(F.expr("substring(trim(text), 2, length(trim(text)) - 2)"))), ignorenulls=True).over(order), F.lit(""))})
    out = out.where(~F.col("header") & text.contains("="))
    out = out.withColumns({"key": F.concat("section", F.lit("."), F.lower(F.trim(F.substring_index(text, "=", 1)))), "value": F.trim(F.expr("substring(trim(text), instr(trim(text), '=') + 1)"))})
    return out.groupBy("file", "key").agg(F.max_by("value", "line").alias("value"))
