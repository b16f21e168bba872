"""A corpus from start to end: each stage takes all that the one before has kept.

toxicity drops the documents that the classifier rejects; exact dedup keeps one row of equal texts;
SimHash near-dedup keeps one document of each group; suffix-array dedup cuts repeated passages out
of the texts; best-fit packing lays the documents into sequences and returns their pieces. All but
the last return the columns of ``documents``.

Defined results: a null text counts as empty, which isn't toxic; such rows are copies of each other.
doc_id is the key of documents: rows that share one stand or fall together in the exact and near
dedup, and of rows that repeat both doc_id and text one stays; rows with a null doc_id are each judged
for themselves by toxicity and are copies or near copies like any other. Of ties (equal length of
copies) the smallest doc_id stays, null last. An empty table gives no pieces. Further columns pass
through, whatever their names, until the packing, which returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slidemill.llm import exact_dedup, packing, repeats, simhash, toxicity
from slidemill.session import materialise, release, scratch_mark, ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeats.drop_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("best-fit packing", pack),
]

#: Tokenising and the classifier can't be put in SQL; tests/llm/test_pipeline.py has a brute-force form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each result written and read again; what a stage wrote besides goes then."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = scratch_mark()
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = materialise(docs, name.replace(" ", "-"))
            release(spark, mark, docs)
    return docs
