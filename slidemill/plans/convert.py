"""Conversion of slides to pyramidal TIFFs: scan, compose, encode, lay out, write."""

from __future__ import annotations

import json
import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from slidemill.functions import codec
from slidemill.functions.text import description
from slidemill.operators import batch, compose
from slidemill.session import local_path, materialise, scratch_path
from slidemill.sources import slide_source
from slidemill.sources.svs_sink import SCHEMA, write_svs

THUMBNAIL, FALLBACK = 1024, 2048


def check_quality(quality: int | None) -> int | None:
    if quality is not None and not 1 <= quality <= 100:
        raise ValueError("quality must be 1 to 100")
    return quality


def root_of(path: str) -> str:
    """The folder that a folder's or glob's slides lie below, with a slash at its end."""
    return path.partition("*")[0].rpartition("/")[0] + "/" if "*" in path else path.rstrip("/") + "/"


def outputs(slides: DataFrame, folder: str | None, root: str | None = None, taken: DataFrame | None = None) -> DataFrame:
    """(path, output): in the folder, below it as the input lies below ``root``, or beside the input;
    numbered where names repeat, so that no two are equal and none is one of ``taken``."""
    named = slides.select("path", batch.output_path(F.col("path"), folder, root).alias("name"))
    return batch.reserved_outputs(named, "name", "path", taken).select(F.col("ord").alias("path"), F.col("unique").alias("output"))


@F.pandas_udf(BooleanType())
def is_there(path: pd.Series) -> pd.Series:
    """Whether an output on a mounted file system exists."""
    return pd.Series([bool((p := local_path(x)) and os.path.exists(p)) for x in path])


def planned(spark: SparkSession, path: str | list[str], folder: str | None = None, output: str | None = None, overwrite: bool = False, mirror: bool = False, taken: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """All relations of the slides at a path, each container parsed once, and (path, output, there)."""
    slide_source.register(spark)
    where = {"paths": json.dumps(path)} if isinstance(path, list) else {}
    read = spark.read.format("slide").options(relation="all", **where)
    parsed = materialise(read.load() if where else read.load(path), "parsed")
    slides = parsed.where("relation = 'slides'").select("path")
    if output is not None:
        if slides.count() + parsed.where("relation = 'errors'").count() != 1:
            raise ValueError("an output file is for one input only; name a folder for several")
        plan = slides.select("path", F.lit(output).alias("output"))
    else:
        plan = outputs(slides, folder, root_of(path) if mirror and not isinstance(path, list) else None, taken)
    there = F.lit(False) if overwrite else is_there("output")
    return parsed, materialise(plan.withColumn("there", there), "outputs")


def pages(spark: SparkSession, parsed: DataFrame, plan: DataFrame, quality: int | None = None, associated: bool = True) -> DataFrame:
    """The rows that the sink writes for the slides of a plan (path, output), and an ``error`` column.

    Page order: level 0, thumbnail, further levels, embedded images.
    """
    check_quality(quality)
    read = lambda r: parsed.where(F.col("relation") == r).select(*slide_source.columns_of(r))
    slides = read("slides")
    slides = slides.join(plan.select("path"), "path", "left_semi")
    own = plan.select("path")
    files = read("files").join(own, "path", "left_semi").select("path", F.col("file"), "base")
    grid = materialise(compose.output_grid(slides, read("levels")), "grid")
    cells = compose.cells_of(grid, read("tiles"))
    encoded = materialise(compose.encode_cells(cells, files, quality).select("path", "level", "slot", "data", "error"), "tiles")
    images = read("images").join(slides.select("path", F.coalesce(F.lit(quality).cast("int"), F.col("quality")).alias("quality")), "path")
    images = images if associated else images.where("kind = 'thumbnail'")
    embedded = materialise(compose.encode_images(images, files, THUMBNAIL), "images")
    usable = embedded.where("kind = 'thumbnail' AND error IS NULL").select("path", "width", "height", "data", "error")
    level = grid.groupBy("path").agg(F.coalesce(F.min(F.when((F.col("level") > 0) & (F.greatest("width", "height") <= FALLBACK), F.col("level"))), F.max("level")).alias("level"))
    missing = level.join(usable.select("path"), "path", "left_anti")
    thumbs = usable.unionByName(materialise(compose.render_thumbnails(cells.join(missing, ["path", "level"], "left_semi"), files, THUMBNAIL), "thumbnails"))
    want = F.coalesce(F.lit(quality).cast("int"), F.col("source_quality"))
    tables = spark.createDataFrame([(q, bytearray(codec.split_tables(codec.encode_jpeg(codec.white(16, 16), q))[0])) for q in range(1, 101)], "q int, tables binary")
    page = F.when(F.col("level") == 0, 0).otherwise(F.col("level") + 1).cast("int")
    none = lambda kind: F.lit(None).cast(kind)
    resolution = F.lit(10000.0) / F.col("mpp")
    head = grid.join(F.broadcast(tables), want == F.col("q")).select(
        "path", page.alias("page"), F.lit(-1).cast("long").alias("slot"), "width", "height", F.col("out_w").alias("tile_w"), F.col("out_h").alias("tile_h"), (F.col("level") > 0).alias("reduced"),
        (resolution / F.when(F.col("level") > 0, F.col("downsample")).otherwise(1.0)).alias("resolution"),
        description(F.col("width"), F.col("height"), F.col("out_w"), F.col("out_h"), want, F.col("app_mag"), F.col("mpp")).alias("description"), "tables",
        none("binary").alias("data"), none("string").alias("error"),
    )
    body = encoded.select("path", page.alias("page"), "slot", *[none(t).alias(c) for c, t in (("width", "long"), ("height", "long"), ("tile_w", "long"), ("tile_h", "long"), ("reduced", "boolean"), ("resolution", "double"), ("description", "string"), ("tables", "binary"))], "data", "error")

    def strip(rows: DataFrame, number, text) -> DataFrame:
        meta = rows.join(slides.select("path", "mpp"), "path")
        first = meta.select("path", number.alias("page"), F.lit(-1).cast("long").alias("slot"), "width", "height", F.lit(0).cast("long").alias("tile_w"), F.lit(0).cast("long").alias("tile_h"), F.lit(False).alias("reduced"), resolution.alias("resolution"), text.alias("description"), none("binary").alias("tables"), none("binary").alias("data"), "error")
        rest = meta.select("path", number.alias("page"), F.lit(0).cast("long").alias("slot"), *[none(t).alias(c) for c, t in (("width", "long"), ("height", "long"), ("tile_w", "long"), ("tile_h", "long"), ("reduced", "boolean"), ("resolution", "double"), ("description", "string"), ("tables", "binary"))], "data", "error")
        return first.unionByName(rest)

    rows = head.unionByName(body).unionByName(strip(thumbs, F.lit(1), none("string")))
    rows = rows.unionByName(strip(embedded.where("kind <> 'thumbnail' AND error IS NULL"), (F.col("ord") + 1000).cast("int"), F.col("kind")))
    return rows.join(plan, "path")


def convert(spark: SparkSession, path: str | list[str], folder: str | None = None, quality: int | None = None, overwrite: bool = False, associated: bool = True, bigtiff: str = "auto", output: str | None = None, mirror: bool = False, taken: DataFrame | None = None) -> DataFrame:
    """Converts all slides at a path (a file, folder, glob, or list of files); (path, output, state,
    message) of each: Done, Skipped or Failed.

    A slide that fails, in reading, encoding or writing, keeps no other from being written. With
    ``mirror`` the folders below the path are kept; ``output`` names the file for a single input;
    names of ``taken`` (output) aren't used.
    """
    check_quality(quality)
    parsed, plan = planned(spark, path, folder, output, overwrite, mirror, taken)
    rows = pages(spark, parsed, plan.where("NOT there").select("path", "output"), quality, associated)
    faults = materialise(rows.where("error IS NOT NULL").groupBy("path").agg(F.min("error").alias("message")), "faults")
    good = rows.join(faults, "path", "left_anti")
    failures = local_path(scratch_path(spark, "failures"))
    write_svs(good.select(*[c.split()[0] for c in SCHEMA.split(", ")]), bigtiff=bigtiff, failures=f"{failures}/failures.json")
    unwritten = spark.read.schema("output string, message string").json(f"file://{failures}/failures.json").withColumnRenamed("message", "fault")
    told = plan.join(faults, "path", "left").join(unwritten.withColumnRenamed("output", "file"), F.regexp_replace("output", "^file:/+", "/") == F.col("file"), "left")
    message = F.coalesce("message", "fault")
    state = F.when(F.col("there"), "Skipped").when(message.isNotNull(), "Failed").otherwise("Done")
    unread = parsed.where("relation = 'errors'").select("path", F.lit(None).cast("string").alias("output"), F.lit("Failed").alias("state"), "message")
    return told.select("path", "output", state.alias("state"), message.alias("message")).unionByName(unread)
