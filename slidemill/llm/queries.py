"""The queries opN_<name> and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from slidemill.llm import brown, exact_dedup, licenses, packing, quality, repeats, sentence_pieces, simhash, token_files, toxicity
from slidemill.session import ship_package


def _documents(spark, sf_dir):
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(_documents(spark, sf_dir))


def op2_brown_scores(spark, sf_dir):
    return brown.brown_scores(_documents(spark, sf_dir))


def op3_token_files(spark, sf_dir):
    return token_files.token_table(_documents(spark, sf_dir))


def op4_simhash_near_dedup(spark, sf_dir):
    return simhash.near_components(_documents(spark, sf_dir))


def op5_best_fit_packing(spark, sf_dir):
    return packing.pack(_documents(spark, sf_dir))


def op6_suffix_array_dedup(spark, sf_dir):
    return repeats.repeats(_documents(spark, sf_dir))


def op7_sentence_pieces(spark, sf_dir):
    return sentence_pieces.round_trip(_documents(spark, sf_dir))


def op8_license_scan(spark, sf_dir):
    spans = F.col("spans")
    out = licenses.scan(_documents(spark, sf_dir))
    return out.select("doc_id", "n_sentences", "licenses", "kinds", spans["licence"].alias("found"), spans["start"].alias("starts"), spans["end"].alias("ends"))


def op9_quality_rules(spark, sf_dir):
    return quality.quality(_documents(spark, sf_dir))


def op10_toxicity(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


OP1_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
"""


def queries():
    return {f.__name__: f for f in (op1_exact_dedup, op2_brown_scores, op3_token_files, op4_simhash_near_dedup, op5_best_fit_packing, op6_suffix_array_dedup, op7_sentence_pieces, op8_license_scan, op9_quality_rules, op10_toxicity)}


def oracle_sql():
    return {"op1_exact_dedup": OP1_SQL, "op9_quality_rules": quality.SQL}
