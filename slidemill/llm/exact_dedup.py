"""Exact dedup with a heavy-hitter split.

Texts are equal when they are identical after every character of ``[\\x20\\x09-\\x0D]`` is deleted.
A Misra-Gries pass over the digests finds the frequent ones; their exact winners, at most
``counters`` rows, are broadcast and settle those rows map-side without a shuffle. The remaining
digests are each rarer than a fixed share of the input and take an ordinary shuffle.

Defined results: a null text counts as empty, and empty texts form one group. Of equal texts the
row with the most code points in the original text stays, then the smallest doc_id, a null doc_id
after all others, then the row that was read first; so exactly one of repeated rows stays. An empty
table gives an empty result. Other columns of the input play no part.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slidemill.llm.frames import free_name
from slidemill.session import materialise, ship_package

#: Counters of the Misra-Gries summaries, and so the bound on rows that are broadcast.
COUNTERS = 4096


def merge_summaries(summary: dict, counts: dict, counters: int) -> dict:
    """Adds counts to a Misra-Gries summary and cuts it to ``counters`` entries.

    The (counters+1)-th largest count is subtracted from all (Agarwal et al., mergeable summaries),
    so each count falls short of the truth by at most total / (counters + 1).
    """
    for k, n in counts.items():
        summary[k] = summary.get(k, 0) + n
    if len(summary) <= counters:
        return summary
    cut = sorted(summary.values(), reverse=True)[counters]
    return {k: n - cut for k, n in summary.items() if n > cut}


def _summarise(counters: int):
    def run(batches):
        summary: dict = {}
        for batch in batches:
            found = batch.column(0).value_counts()
            summary = merge_summaries(summary, dict(zip(found.field("values").to_pylist(), found.field("counts").to_pylist(), strict=True)), counters)
        if summary:
            yield pa.RecordBatch.from_arrays([pa.array(list(summary), pa.binary()), pa.array(list(summary.values()), pa.int64())], names=["digest", "n"])

    return run


def frequent_digests(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """At most ``counters`` digests, among them each that makes up over 2/counters of the rows."""
    partial = digests.select("digest").mapInArrow(_summarise(counters), "digest binary, n long")
    return partial.groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(counters).select("digest")


def digest_table(docs: DataFrame) -> DataFrame:
    """doc_id, digest, code points of the original text, and a number for each row; written once."""
    ship_package(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return materialise(
        docs.select(
            F.col("doc_id"),
            F.unhex(F.sha2(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "").cast("binary"), 256)).alias("digest"),
            F.char_length(text).alias("points"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )


def exact_dedup(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = digest_table(docs).withColumn("rank", F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("z"), "doc_id", "row"))
    total = rows.count()
    found = frequent_digests(rows, counters)
    winners = materialise(
        rows.join(F.broadcast(found), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.count("*").alias("group_size"), F.min("rank").alias("first"))
        .where(F.col("group_size") * counters > F.lit(total)),
        "winners",
    )
    hot = rows.join(F.broadcast(winners), "digest")
    same = Window.partitionBy("digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti").select(
        "*", F.count("*").over(same).alias("group_size"), F.min("rank").over(same).alias("first")
    )
    return hot.unionByName(rest).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The documents that exact_dedup keeps, with all their columns.

    doc_id is the key of documents. Rows that share a doc_id stand or fall together, and rows that
    repeat both doc_id and normalised text become one.
    """
    name = free_name(docs.columns, "of_id")
    row = free_name([*docs.columns, name], "row")
    ids = exact_dedup(docs, counters).groupBy(F.col("doc_id").alias(name)).agg(F.max("kept").alias("stays"), F.count("*").alias("rows"))
    ids = materialise(ids.where("NOT stays OR rows > 1"), "copies")
    same = F.col("doc_id").eqNullSafe(F.col(name))
    left = docs.join(ids.where("NOT stays").select(name), same, "left_anti")
    repeated = ids.where("stays").select(name)
    if repeated.isEmpty():
        return left
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    order = Window.partitionBy("doc_id", F.sha2(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "").cast("binary"), 256)).orderBy(F.char_length(text).desc())
    once = left.join(repeated, same, "left_semi").withColumn(row, F.row_number().over(order)).where(F.col(row) == 1)
    return left.join(repeated, same, "left_anti").unionByName(once.select(*docs.columns))
