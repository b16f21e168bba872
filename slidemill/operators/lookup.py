"""Running offsets and as-of lookups over byte ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_offsets(rows: DataFrame, keys: list[str], order: list[str], length: str = "length", start: Column | int = 0) -> DataFrame:
    """Adds ``offset``: the sum of the lengths before a row, and the start."""
    over = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum(length).over(over), F.lit(0)) + start)


def asof(probes: DataFrame, bases: DataFrame, keys: list[str], at: str, base: str) -> DataFrame:
    """Each probe with the last base at or before it: one sort over both, no range join.

    Probe and base rows are put in one order, bases first where equal; the last base seen is the one.
    """
    own = [c for c in bases.columns if c not in keys]
    right = bases.select(*keys, F.col(base).alias("__at"), F.struct(*own).alias("__base"), F.lit(0).alias("__side"), F.lit(None).cast(probes.select(F.struct(*probes.columns)).schema[0].dataType).alias("__row"))
    left = probes.select(*keys, F.col(at).alias("__at"), F.lit(None).cast(right.schema["__base"].dataType).alias("__base"), F.lit(1).alias("__side"), F.struct(*probes.columns).alias("__row"))
    order = Window.partitionBy(*keys).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = right.unionByName(left).withColumn("__found", F.last("__base", ignorenulls=True).over(order)).where("__side = 1")
    return found.select("__row.*", *[F.col(f"__found.{c}").alias(c) for c in own])


def fits(offset: Column, length: Column, size: Column) -> Column:
    """Whether a range is present and lies within a file; written so that nothing overflows."""
    return (offset > 0) & (length > 0) & (offset < size) & (length <= size - offset)


def kept_or_hole(offset: Column, length: Column, size: Column) -> Column:
    """The range where it fits, else the empty one (0, 0)."""
    ok = fits(offset, length, size)
    return F.struct(F.when(ok, offset).otherwise(0).alias("offset"), F.when(ok, length).otherwise(0).alias("length"))


def between_markers(markers: DataFrame, key: str, position: str, start: Column, end: Column, width: int = 2) -> DataFrame:
    """Intervals between markers: from after the one before (or start) to the next one (or end)."""
    order = Window.partitionBy(key).orderBy(position)
    rows = markers.withColumns({"from": F.coalesce(F.lag(position).over(order) + width, start), "to": F.col(position), "unit": F.row_number().over(order) - 1})
    last = markers.groupBy(key).agg(F.max(position).alias("m"), F.count("*").alias("n")).select(key, (F.col("m") + width).alias("from"), end.alias("to"), F.col("n").alias("unit"))
    return rows.select(key, "unit", "from", "to").unionByName(last.select(key, F.col("unit").cast("int").alias("unit"), "from", "to"))
