"""Planning of conversion batches: outputs, queue states, summaries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def output_name(path: Column) -> Column:
    """The file's stem with the output extension."""
    return F.concat(F.regexp_replace(F.regexp_extract(path, "([^/]+)$", 1), r"(.)\.[^.]*$", "$1"), F.lit(".svs"))


def output_path(path: Column, folder: str | None = None, root: str | None = None) -> Column:
    """In ``folder``, or beside the input; with a ``root`` in the folder's like of the input's place below it."""
    if folder and root:
        below = F.when(path.startswith(root), F.regexp_extract(F.substring(path, F.lit(len(root) + 1), F.length(path)), "^(.*/)?", 0)).otherwise("")
        return F.concat(F.lit(folder.rstrip("/") + "/"), below, output_name(path))
    return F.concat(F.lit(folder.rstrip("/") + "/") if folder else F.regexp_extract(path, "^(.*/)?", 0), output_name(path))


def numbered_outputs(jobs: DataFrame, output: str, order: str) -> DataFrame:
    """Adds ``unique``: the first job of equal outputs keeps its name, later ones get _2, _3, ...

    Equal without regard to case. Where a numbered name collides with another stem's own name, see
    ``reserved_outputs``.
    """
    rank = F.row_number().over(Window.partitionBy(F.lower(output)).orderBy(order))
    return jobs.withColumn("unique", F.when(rank == 1, F.col(output)).otherwise(F.concat(F.regexp_replace(output, r"\.[^./]*$", ""), F.lit("_"), rank.cast("string"), F.lit(".svs"))))


def _reserve(pdf: pd.DataFrame) -> pd.DataFrame:
    taken, out, following = {n.lower() for n in pdf["output"][pdf["fixed"]]}, [], {}
    pdf = pdf.sort_values(["fixed", "ord"])
    for path in pdf["output"][~pdf["fixed"]]:
        name, stem = path, path.rpartition(".")[0]
        number = following.get(path.lower(), 2)
        while name.lower() in taken:
            name, number = f"{stem}_{number}.svs", number + 1
        following[path.lower()] = number
        taken.add(name.lower())
        out.append(name)
    return pdf.assign(unique=out + pdf["output"][pdf["fixed"]].tolist())


def reserved_outputs(jobs: DataFrame, output: str, order: str, taken: DataFrame | None = None) -> DataFrame:
    """As ``numbered_outputs``, but in sequence, so that sample_2 meeting a numbered sample_2 becomes
    sample_2_2; names of ``taken`` (output) are avoided. Names collide only within the root before any
    trailing _numbers, which is the group."""
    root = F.regexp_replace(F.lower(F.regexp_replace("output", r"\.[^./]*$", "")), r"(_\d+)+$", "")
    rows = jobs.select(F.col(order).alias("ord"), F.col(output).alias("output"), F.lit(False).alias("fixed"))
    kind = rows.schema["ord"].dataType.simpleString()
    if taken is not None:
        rows = rows.unionByName(taken.select(F.lit(None).cast(kind).alias("ord"), "output", F.lit(True).alias("fixed")))
    return rows.withColumn("root", root).groupBy("root").applyInPandas(_reserve, f"ord {kind}, output string, fixed boolean, root string, unique string").where("NOT fixed").drop("root", "fixed")


def add_paths(queue: DataFrame, paths: DataFrame) -> DataFrame:
    """(key, action) of each added path against the queue (key, state).

    Unsupported paths are ignored; a new key is added, one that waits is a duplicate, any other goes
    back in line; and of a key that is given more than once, all but the first are duplicates.
    """
    first = F.row_number().over(Window.partitionBy("key").orderBy("ord")) == 1
    known = paths.where("supported").withColumn("first", first).join(queue.select("key", "state"), "key", "left")
    action = F.when(~F.col("first"), "duplicate").when(F.col("state").isNull(), "added").when(F.col("state") == "Waiting", "duplicate").otherwise("refreshed")
    return known.select("ord", "key", action.alias("action")).unionByName(paths.where("NOT supported").select("ord", "key", F.lit("ignored").alias("action")))


def latest_states(events: DataFrame) -> DataFrame:
    """The state of each item after its last event."""
    return events.groupBy("item").agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"), F.count("*").alias("n_events"))


def speedups(runs: DataFrame) -> DataFrame:
    """Baseline over current seconds of each case, where both succeeded."""
    wide = runs.groupBy("case").pivot("method", ["baseline", "current"]).agg(F.min(F.when(F.col("ok"), F.col("seconds"))))
    return wide.withColumn("speedup", F.try_divide("baseline", "current"))
