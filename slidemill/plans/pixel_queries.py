"""Queries that go through pixels, the slide source, the TIFF sink and streams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from slidemill.functions import codec
from slidemill.functions.bytes import jpeg_is_420
from slidemill.functions.codec_columns import RANGE, grey_jpeg, picture_range
from slidemill.operators import compose
from slidemill.plans import container_queries
from slidemill.plans import relations as R
from slidemill.session import scratch_path, ship_package
from slidemill.sources import slide_source
from slidemill.sources.svs_sink import write_svs
from slidemill.streaming import arrivals


@F.pandas_udf(RANGE)
def thumbnail_range(value: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    images = [codec.thumbnail(np.full((h, w, 3), v, np.uint8), 64) for v, w, h in zip(value, width, height, strict=True)]
    return pd.DataFrame([(i.shape[1], i.shape[0], int(i.min()), int(i.max())) for i in images], columns=["width", "height", "least", "most"])


def _parts(spark, sf_dir):
    p = F.col("p_partkey")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # pixels cost far more than a shuffle of keys
    return R.table(spark, sf_dir, "part").repartition(tasks, "p_partkey").select("p_partkey", (p % 236 + 10).alias("grey"), (p % 37 + 1).cast("int").alias("w"), (p % 23 + 1).cast("int").alias("h"))


def jpeg_roundtrip(spark, sf_dir):
    """Flat pictures encoded and decoded again, and whether they are 4:2:0."""
    ship_package(spark)
    coded = _parts(spark, sf_dir).withColumn("data", grey_jpeg("grey", "w", "h"))
    out = coded.select("p_partkey", picture_range("data").alias("i"), jpeg_is_420("data").alias("is_420"))
    return out.select("p_partkey", "i.*", "is_420")


def thumbnail_pixels(spark, sf_dir):
    ship_package(spark)
    p = _parts(spark, sf_dir)
    return p.select("p_partkey", thumbnail_range("grey", (F.col("w") * 5).alias("w"), (F.col("h") * 7).alias("h")).alias("i")).select("p_partkey", "i.*")


def svs_write_read(spark, sf_dir):
    """A slide of each supplier, written by the sink and read back by the source, tile by tile."""
    slide_source.register(spark)
    folder = scratch_path(spark, "slides")
    k = F.col("s_suppkey")
    tiles = R.table(spark, sf_dir, "supplier").select(k, (k % 3 + 1).alias("cols"), (k % 2 + 1).alias("rows"))
    tiles = tiles.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cols") * F.col("rows") - 1)))
    own = tiles.select("*", grey_jpeg(((k + F.col("slot")) % 200 + 20), F.lit(16), F.lit(16)).alias("data"))
    output = F.concat(F.lit(f"{folder}/s"), k.cast("string"), F.lit(".tif")).alias("output")
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    zero = F.lit(0).alias("page")
    meta = tiles.where("slot = 0").select(output, zero, F.lit(-1).cast("long").alias("slot"), (F.col("cols") * 16).alias("width"), (F.col("rows") * 16).alias("height"), F.lit(16).cast("long").alias("tile_w"), F.lit(16).cast("long").alias("tile_h"), F.lit(False).alias("reduced"), F.lit(20000.0).alias("resolution"), F.lit("x|AppMag = 20|").alias("description"), none("tables", "binary"), none("data", "binary"))
    body = own.select(output, zero, "slot", none("width", "long"), none("height", "long"), none("tile_w", "long"), none("tile_h", "long"), none("reduced", "boolean"), none("resolution", "double"), none("description", "string"), none("tables", "binary"), "data")
    write_svs(meta.unionByName(body))
    read = container_queries._parsed(spark, folder, "slides", "tiles")
    slides = read["slides"].select("path", "width", "height", "mpp", "app_mag")

    @F.pandas_udf(RANGE)
    def shown(path: pd.Series, offset: pd.Series, length: pd.Series) -> pd.DataFrame:
        out, opened = [], compose.Files()
        try:
            for p, o, n in zip(path, offset, length, strict=True):
                i = codec.decode_jpeg(opened.read([{"file": p, "base": 0}], o, n))
                out.append((i.shape[1], i.shape[0], int(i.min()), int(i.max())))
        finally:
            opened.close()
        return pd.DataFrame(out, columns=["width", "height", "least", "most"])

    key = F.regexp_extract("path", r"s(\d+)\.tif$", 1).cast("long").alias("s_suppkey")
    tiles = container_queries._by_slide(read["tiles"].select("path", "slot", "offset", "length"))
    seen = tiles.select("path", "slot", shown("path", "offset", "length").alias("i")).join(slides, "path")
    return seen.select(key, "slot", F.col("i.least").alias("least"), F.col("i.most").alias("most"), "width", "height", "mpp", "app_mag")


def event_windows(spark, sf_dir):
    """Hourly counts of a stream run over all events."""
    out = arrivals.run_once(arrivals.windowed_counts(arrivals.event_stream(spark, sf_dir)), "windows")
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", F.col("total").cast("double").alias("total"))


QUERIES = [jpeg_roundtrip, thumbnail_pixels, svs_write_read, event_windows]

SQL = {
    "jpeg_roundtrip": "SELECT p_partkey, CAST(p_partkey % 37 + 1 AS INTEGER) AS width, CAST(p_partkey % 23 + 1 AS INTEGER) AS height, CAST(p_partkey % 236 + 10 AS INTEGER) AS least, CAST(p_partkey % 236 + 10 AS INTEGER) AS most, true AS is_420 FROM part",
    "thumbnail_pixels": """WITH p AS (SELECT p_partkey, (p_partkey % 37 + 1) * 5 AS w, (p_partkey % 23 + 1) * 7 AS h, CAST(p_partkey % 236 + 10 AS INTEGER) AS grey FROM part),
s AS (SELECT *, least(CAST(64 AS FLOAT) / CAST(w AS FLOAT), CAST(64 AS FLOAT) / CAST(h AS FLOAT), CAST(1 AS FLOAT)) AS scale FROM p)
SELECT p_partkey, greatest(CAST(trunc(CAST(w AS FLOAT) * scale) AS INTEGER), 1) AS width, greatest(CAST(trunc(CAST(h AS FLOAT) * scale) AS INTEGER), 1) AS height, grey AS least, grey AS most FROM s""",
    "svs_write_read": """SELECT s_suppkey, slot, CAST((s_suppkey + slot) % 200 + 20 AS INTEGER) AS least, CAST((s_suppkey + slot) % 200 + 20 AS INTEGER) AS most, (s_suppkey % 3 + 1) * 16 AS width, (s_suppkey % 2 + 1) * 16 AS height, CAST(0.5 AS DOUBLE) AS mpp, CAST(20 AS DOUBLE) AS app_mag
FROM supplier, LATERAL (SELECT unnest(generate_series(0, (s_suppkey % 3 + 1) * (s_suppkey % 2 + 1) - 1)) AS slot)""",
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, CAST(sum(CAST(round(value, 2) AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM events GROUP BY ALL",
}
