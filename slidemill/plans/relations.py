"""Slides, levels, tiles, files and queue events derived from the driver's tables.

The tables hold no slides, so each operator runs on relations that Spark and SQL derive by the same
exact integer arithmetic. ``SQL`` has each relation as a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TILE = 256
#: Extensions that file names get in turn: the supported ones in mixed case, and some that aren't.
EXTENSIONS = "csp CSP dmetrix kfb KFB mdss mdsx msdx mrxs NDPI ndpi sdpc dyqx tif TIFF tiff svs SVS txt".split()
#: Sections and keys of the INI lines.
INI_KEYS = ("SLIDE_ID", "IMAGENUMBER_X", "Objective", "scale", "Scale", "quality")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tiles(spark, sf_dir) -> DataFrame:
    """slide_id, level, ordinal, x, y, w, h, length: one positioned tile a line item."""
    order = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("slide_id"),
        (F.col("l_linenumber") - 1).cast("int").alias("level"),
        (F.row_number().over(order) - 1).cast("long").alias("ordinal"),
        (F.col("l_partkey") * 37 % 4096).alias("x"),
        (F.col("l_suppkey") * 53 % 3072).alias("y"),
        (64 + F.floor("l_quantity").cast("long") * 8).alias("w"),
        (64 + F.col("l_partkey") % 13 * 16).alias("h"),
        F.floor("l_extendedprice").cast("long").alias("length"),
    )


def slides(spark, sf_dir) -> DataFrame:
    """slide_id, width, height, app_mag, mpp, path, associated kinds (0 to 3): one slide an order."""
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("slide_id"),
        (2048 + c % 64 * 256).alias("width"),
        (1536 + c % 48 * 256).alias("height"),
        F.when(k % 2 == 0, 20).otherwise(40).cast("long").alias("app_mag"),
        F.when(k % 2 == 0, 0.5).otherwise(0.25).alias("mpp"),
        (k % 4).alias("kinds"),
    )


def supplier_slides(spark, sf_dir) -> DataFrame:
    """slide_id, width and height of one slide a supplier."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("slide_id"), (2048 + k % 64 * 256).alias("width"), (1536 + k % 48 * 256).alias("height"))


def levels_of(slides: DataFrame, count: int = 7) -> DataFrame:
    """slide_id, level, width, height, cols, rows of a pyramid that halves."""
    halved = lambda n: F.greatest(F.expr(f"{n} div shiftleft(1L, level)"), F.lit(1))
    ceil = lambda n: F.expr(f"({n} + {TILE - 1}) div {TILE}")
    out = slides.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    return out.withColumns({"width": halved("width"), "height": halved("height")}).withColumns({"cols": ceil("width"), "rows": ceil("height")}).select("slide_id", "level", "width", "height", "cols", "rows")


def levels(spark, sf_dir, count: int = 7) -> DataFrame:
    """The levels of each order's slide."""
    return levels_of(slides(spark, sf_dir), count)


def files(spark, sf_dir) -> DataFrame:
    """path and length of files with supported and other extensions."""
    names = F.array(*map(F.lit, EXTENSIONS))
    o = F.col("o_orderkey")
    ext = F.element_at(names, (F.col("o_custkey") % len(EXTENSIONS) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        o.alias("file_id"),
        F.when(o % 97 == 0, F.concat(F.lit("/in/s"), o.cast("string"))).otherwise(F.concat(F.lit("/in/d"), (o % 5).cast("string"), F.lit("/s"), (o % 301).cast("string"), F.lit("."), ext)).alias("path"),
        F.floor("o_totalprice").cast("long").alias("length"),
    )


def ini_lines(spark, sf_dir) -> DataFrame:
    """file, line number and text of INI files with sections, keys, comments and blanks."""
    p = F.col("p_partkey")
    key = F.element_at(F.array(*map(F.lit, INI_KEYS)), (p % len(INI_KEYS) + 1).cast("int"))
    line = (
        F.when(p % 7 == 0, F.concat(F.lit("["), F.upper("p_brand"), F.lit("]")))
        .when(p % 7 == 3, F.lit(""))
        .when(p % 7 == 5, F.concat(F.lit("; "), F.col("p_type")))
        .otherwise(F.concat(F.lit("  "), key, F.lit(" = "), F.when(p % 5 == 0, F.lit("")).when(p % 5 == 1, F.col("p_type")).otherwise(F.col("p_size").cast("string")), F.lit(" ")))
    )
    return table(spark, sf_dir, "part").select(F.expr("p_partkey div 40").alias("file"), (p % 40).alias("line"), line.alias("text"))


_EXT = "[" + ", ".join(f"'{e}'" for e in EXTENSIONS) + "]"
_KEYS = "[" + ", ".join(f"'{k}'" for k in INI_KEYS) + "]"

SQL = {
    "tiles": """tiles AS (SELECT l_orderkey AS slide_id, CAST(l_linenumber - 1 AS INTEGER) AS level,
 row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS ordinal,
 (l_partkey * 37) % 4096 AS x, (l_suppkey * 53) % 3072 AS y, 64 + CAST(floor(l_quantity) AS BIGINT) * 8 AS w,
 64 + (l_partkey % 13) * 16 AS h, CAST(floor(l_extendedprice) AS BIGINT) AS length FROM lineitem)""",
    "slides": """slides AS (SELECT o_orderkey AS slide_id, 2048 + (o_custkey % 64) * 256 AS width, 1536 + (o_custkey % 48) * 256 AS height,
 CAST(CASE WHEN o_orderkey % 2 = 0 THEN 20 ELSE 40 END AS BIGINT) AS app_mag, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 0.5 ELSE 0.25 END AS DOUBLE) AS mpp,
 o_orderkey % 4 AS kinds FROM orders)""",
    "supplier_slides": "supplier_slides AS (SELECT s_suppkey AS slide_id, 2048 + (s_suppkey % 64) * 256 AS width, 1536 + (s_suppkey % 48) * 256 AS height FROM supplier)",
    **{
        f"{prefix}levels": f"""{prefix}levels AS (SELECT slide_id, CAST(l AS INTEGER) AS level, greatest(width // (1 << l), 1) AS width, greatest(height // (1 << l), 1) AS height,
 (greatest(width // (1 << l), 1) + {TILE - 1}) // {TILE} AS cols, (greatest(height // (1 << l), 1) + {TILE - 1}) // {TILE} AS rows
 FROM {prefix}slides, generate_series(0, 6) AS g(l))"""
        for prefix in ("", "supplier_")
    },
    "files": f"""files AS (SELECT o_orderkey AS file_id, CASE WHEN o_orderkey % 97 = 0 THEN '/in/s' || o_orderkey
 ELSE '/in/d' || (o_orderkey % 5) || '/s' || (o_orderkey % 301) || '.' || ({_EXT})[o_custkey % {len(EXTENSIONS)} + 1] END AS path,
 CAST(floor(o_totalprice) AS BIGINT) AS length FROM orders)""",
    "ini": f"""ini AS (SELECT p_partkey // 40 AS file, p_partkey % 40 AS line, CASE WHEN p_partkey % 7 = 0 THEN '[' || upper(p_brand) || ']'
 WHEN p_partkey % 7 = 3 THEN '' WHEN p_partkey % 7 = 5 THEN '; ' || p_type
 ELSE '  ' || ({_KEYS})[p_partkey % {len(INI_KEYS)} + 1] || ' = ' || CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 5 = 1 THEN p_type ELSE CAST(p_size AS VARCHAR) END || ' ' END AS text FROM part)""",
}
NEEDS = {"levels": ("slides",), "supplier_levels": ("supplier_slides",)}


def sql(relations: str, body: str) -> str:
    """A query over the named relations; ``body`` may begin with further common table expressions and a comma."""
    names: list[str] = []
    for r in relations.split():
        names += [n for n in (*NEEDS.get(r, ()), r) if n not in names]
    return "WITH " + ",\n".join(SQL[n] for n in names) + body
