"""Connected components, in numpy for what one task holds and in Spark for a whole graph."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidemill.session import materialise


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n nodes over the links (a, b)."""
    p = np.arange(n)
    while True:
        x, y = p[a], p[b]
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        change = lo < hi
        if not change.any():
            return p
        np.minimum.at(p, hi[change], lo[change])
        while not np.array_equal(q := p[p], p):
            p = q


def _spread(edges: DataFrame) -> DataFrame:
    """Large-star: each node's larger neighbours are linked to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _gather(edges: DataFrame) -> DataFrame:
    """Small-star: each node's smaller neighbours, and the node, are linked to the smallest."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the links (a, b), root being the smallest node reachable.

    Links of a node with itself and repeated links say nothing; null nodes aren't allowed; no links, no
    rows. Alternates large-star and small-star (Kiveris et al.); each round is written to the shared
    folder. Hubs are pre-aggregated before the shuffle and their joins can be split by AQE.
    """
    now = materialise(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if tuple(seen) == state or not seen["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = tuple(seen)
        now = materialise(_gather(_spread(now)), "links")
