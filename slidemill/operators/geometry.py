"""Tile geometry: cells, extents, grids, pyramids. DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVEL = ("slide_id", "level")


def ceil_div(a: Column, b) -> Column:
    b = b if isinstance(b, Column) else F.lit(b)
    return F.floor((a + b - 1) / b).cast("long")


def assign_cells(tiles: DataFrame, pitch: int, cols: int, rows: int) -> DataFrame:
    """A row for each grid cell that a positioned tile overlaps, clamped to the grid's last column and row.

    A range join turned into an explode, so that later joins are on equal cells.
    """
    first = lambda at, n: F.least(F.expr(f"{at} div {pitch}"), F.lit(n - 1).cast("long"))
    last = lambda at, size, n: F.least(F.expr(f"({at} + greatest({size}, 1) - 1) div {pitch}"), F.lit(n - 1).cast("long"))
    by_row = tiles.withColumn("cell_row", F.explode(F.sequence(first("y", rows), last("y", "h", rows))))
    return by_row.withColumn("cell_col", F.explode(F.sequence(first("x", cols), last("x", "w", cols))))


def cell_groups(cells: DataFrame) -> DataFrame:
    """The tiles of each cell, in order; a cell holds at most a level's tiles."""
    return cells.groupBy(*LEVEL, "cell_row", "cell_col").agg(F.array_sort(F.collect_list("ordinal")).alias("slots"))


def last_wins(cells: DataFrame) -> DataFrame:
    """The tile that shows in each cell: later ones cover earlier ones."""
    return cells.groupBy(*LEVEL, "cell_row", "cell_col").agg(F.max("ordinal").alias("ordinal"), F.max_by("length", "ordinal").alias("length"))


def extents(tiles: DataFrame) -> DataFrame:
    """Level sizes from its tiles' far edges."""
    return tiles.groupBy(*LEVEL).agg(F.max(F.col("x") + F.col("w")).alias("width"), F.max(F.col("y") + F.col("h")).alias("height"), F.count("*").alias("n_tiles"))


def dense_grid(tiles: DataFrame, pitch: int) -> DataFrame:
    """Every cell of each level's grid with the first tile at it; holes have length 0."""
    at = lambda c: F.expr(f"{c} div {pitch}")
    first = tiles.groupBy(*LEVEL, at("y").alias("cell_row"), at("x").alias("cell_col")).agg(F.min_by("length", "ordinal").alias("length"))
    size = extents(tiles)
    cells = size.withColumn("cell_row", F.explode(F.sequence(F.lit(0).cast("long"), ceil_div(F.col("height"), pitch) - 1))).withColumn(
        "cell_col", F.explode(F.sequence(F.lit(0).cast("long"), ceil_div(F.col("width"), pitch) - 1))
    )
    slot = F.col("cell_row") * ceil_div(F.col("width"), pitch) + F.col("cell_col")
    return cells.join(first, [*LEVEL, "cell_row", "cell_col"], "left").select(*LEVEL, slot.alias("slot"), F.coalesce("length", F.lit(0).cast("long")).alias("length"))


def islands(records: DataFrame, key: str, position: str, stride: int) -> DataFrame:
    """Numbers runs of records that follow each other by exactly ``stride``."""
    order = Window.partitionBy(key).orderBy(position)
    breaks = F.when(F.col(position) - F.lag(position).over(order) == stride, 0).otherwise(1)
    return records.withColumn("breaks", breaks).withColumn("run", F.sum("breaks").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("breaks")


def rank_by_area(pages: DataFrame) -> DataFrame:
    """Level numbers by area, largest first; equal areas in page order."""
    order = Window.partitionBy("slide_id").orderBy(F.desc(F.col("width") * F.col("height")), "page")
    return pages.withColumn("level", (F.row_number().over(order) - 1).cast("long"))


def merge_factor(pitch: Column) -> Column:
    """Tiles to merge along an axis until the pitch is a multiple of 16: 16 / gcd(pitch, 16)."""
    return F.when(pitch % 16 == 0, 1).when(pitch % 8 == 0, 2).when(pitch % 4 == 0, 4).when(pitch % 2 == 0, 8).otherwise(16).cast("long")


def retile(grid: DataFrame, merge_rows: int, merge_cols: int) -> DataFrame:
    """Output tiles of merged source tiles, with how many each has and their bytes."""
    out = [F.expr(f"cell_row div {merge_rows}").alias("out_row"), F.expr(f"cell_col div {merge_cols}").alias("out_col")]
    return grid.groupBy(*LEVEL, *out).agg(F.count("*").alias("parts"), F.sum("length").alias("bytes"))


def halving_pyramid(slides: DataFrame, tile: int) -> DataFrame:
    """Levels down to one pixel: ceil(log2(longest edge)) + 1 of them, each side floored and at least 1."""
    edge = F.greatest("width", "height").cast("double")
    out = slides.withColumn("level", F.explode(F.sequence(F.lit(0), F.ceil(F.log2(edge)).cast("int"))))
    side = lambda c: F.greatest(F.expr(f"{c} div shiftleft(1L, level)"), F.lit(1).cast("long"))
    return out.withColumns({"w": side("width"), "h": side("height")}).withColumns({"cols": ceil_div(F.col("w"), tile), "rows": ceil_div(F.col("h"), tile)})


def truncate(x: Column) -> Column:
    return x.cast("long")


def nominal_positions(cameras: DataFrame, across: Column, size: Column, divisions: Column, overlap: Column) -> DataFrame:
    """Regular camera positions: index times the advance of an axis, truncated."""
    advance = size * divisions - overlap
    return cameras.withColumns({"pos_x": truncate(F.col("index") % across * advance), "pos_y": truncate(F.floor(F.col("index") / across) * advance)})


def axis_extent(index: Column, count: Column, size: Column, overlap: Column, divisions: Column) -> Column:
    """What image ``index`` adds to an axis: its size, less the overlap at the end of a division but the last."""
    return F.when((index % divisions == divisions - 1) & (index != count - 1), truncate(size - overlap)).otherwise(size)


def subtiles(records: DataFrame, across: int, down: int, divisions: int, concat: int, width: float, height: float) -> DataFrame:
    """The camera subtiles of stored images (image_index): columns xx, yy, their camera, and source place.

    An image of ``concat`` level-0 images holds max(concat / divisions, 1) subtiles along each axis.
    """
    per = max(concat // divisions, 1)
    each = F.sequence(F.lit(0).cast("long"), F.lit(per - 1).cast("long"))
    out = records.withColumns({"x0": F.col("image_index") % across, "y0": F.expr(f"image_index div {across}")}).withColumn("yi", F.explode(each)).withColumn("xi", F.explode(each))
    out = out.withColumns({"xx": F.col("x0") + F.col("xi") * divisions, "yy": F.col("y0") + F.col("yi") * divisions}).where((F.col("xx") < across) & (F.col("yy") < down))
    camera = F.expr(f"(yy div {divisions}) * {across // divisions} + xx div {divisions}")
    return out.withColumns({"camera": camera, "src_x": F.round(F.col("xi") * (width / per)).cast("long"), "src_y": F.round(F.col("yi") * (height / per)).cast("long")})


def fit_scale(width: Column, height: Column, limit: int) -> Column:
    """min(limit / width, limit / height, 1) in single precision."""
    most = F.lit(float(limit)).cast("float")
    return F.least((most / width.cast("float")).cast("float"), (most / height.cast("float")).cast("float"), F.lit(1.0).cast("float"))


def scaled(length: Column, scale: Column) -> Column:
    return F.greatest((length.cast("float") * scale).cast("int"), F.lit(1))


def downsample_of(scale: Column) -> Column:
    """round(1 / scale) where that is the reciprocal within 1e-5, else null; single precision throughout."""
    s = scale.cast("float")
    value = F.round((F.lit(1.0).cast("float") / s).cast("double")).cast("int")
    near = F.abs((s * value.cast("float")).cast("float") - F.lit(1.0).cast("float")) <= F.lit(1e-5).cast("float")
    return F.when((s > 0) & (value > 0) & near, value)
