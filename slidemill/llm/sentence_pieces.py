"""SentencePiece encoding and decoding of whole texts by vectorised merge rounds.

Ids equal those of the sentencepiece library's encode without begin and end ids, and the decoded
text that of its decode(ids).

Defined results: a null or empty text has no ids and decodes to the empty text; repeated rows are
encoded each for itself; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidemill.llm.tokens import pieces, public_path
from slidemill.session import ship_package

TOGETHER = 512


def _rows(docs: DataFrame) -> DataFrame:
    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _encode(model: str):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                found = pieces(model).encode_batch([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and the ids of its text."""
    return _rows(docs).mapInArrow(_encode(model or public_path("piece_bpe_32k.model")), "doc_id long, ids array<int>")


def _decode(model: str):
    def run(batches):
        for batch in batches:
            texts = [pieces(model).decode(x.values.to_numpy()).decode() if x.is_valid else None for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and the text of its ids."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(model or public_path("piece_bpe_32k.model")), "doc_id long, text string")


def _digests(model: str):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                size, of_ids, of_text = [], [], []
                for ids, decimals in pieces(model).encode_both([t or "" for t in part.column(1).to_pylist()]):
                    size.append(len(ids))
                    of_ids.append(hashlib.sha256(decimals).hexdigest())
                    of_text.append(hashlib.sha256(pieces(model).decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(of_ids), pa.array(of_text)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Encodes each text and decodes its ids: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return _rows(docs).mapInArrow(_digests(model or public_path("piece_bpe_32k.model")), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
