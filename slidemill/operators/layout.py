"""Layout of a pyramidal TIFF: directory sizes and offsets, known before writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The standard luminance quantisation table (ITU-T T.81, Annex K), in reading order.
LUMINANCE = [16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99]
#: The standard chrominance quantisation table.
CHROMINANCE = [17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99]
#: Entries of a directory of tiles with shared tables.
TILED_ENTRIES = 21


def align(value: Column, to: int) -> Column:
    return F.floor((value + (to - 1)) / to).cast("long") * to


def directory_size(entries: int) -> int:
    """Count, twelve bytes an entry, and the next directory's offset."""
    return 2 + entries * 12 + 4


def page_offsets(pages: DataFrame) -> DataFrame:
    """start, ifd_at and next_ifd of each page (slide_id, level, width, height, tiles, payload bytes).

    A page is its payload, its directory on an even byte, and the directory's longer values; pages
    follow each other from byte 8, on multiples of 4, in level order.
    """
    text = F.length(F.format_string("%dx%d", "width", "height"))
    extra = F.lit(8) + F.col("tiles") * 8 + 80 + text
    size = align(F.col("payload") + directory_size(TILED_ENTRIES) + extra, 4)
    order = Window.partitionBy("slide_id").orderBy("level")
    placed = pages.withColumn("size", size).withColumn("start", (F.lit(8) + F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("long"))
    placed = placed.withColumn("ifd_at", align(F.col("start") + F.col("payload"), 2))
    return placed.select("slide_id", "level", "start", "ifd_at", F.lead("ifd_at", 1, 0).over(order).alias("next_ifd"))
