"""Token ids in files of directly addressable codes.

An id is cut into chunks of ``BITS`` bits. Level k holds the k-th chunk of each id that has one, as
plain bytes; a bitmap tells which ids of a level go on to the next one, and a rank directory counts
the set bits before each block of ``BLOCK``. So token i is found with one rank per level, without
decoding anything before it.

A file holds consecutive documents in ascending doc_id order:
``MAGIC``, then five little-endian 64-bit numbers (documents, ids, levels, and two spare), the
doc_ids, which of them are null (a byte each), the documents' starts and the end, and for each level
its length, chunks, bitmap (padded to 8 bytes) and directory. Files are written under another name
and then moved, so a task that runs again leaves the same files.

Defined results: a null text counts as empty and so has the end id alone; null doc_ids come first;
rows with one doc_id are ordered by their text. An empty table gives no file and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slidemill.llm.tokens import byte_level, public_path
from slidemill.session import materialise, scratch_path, ship_package

MAGIC, BITS, BLOCK = b"SMDAC001", 8, 512
#: Ids that a file holds at most, save for a single longer document.
FILE_IDS = 16_000_000
END_ID = 1
#: Texts that are tokenised together.
TOGETHER = 4096


def encode_levels(ids: np.ndarray) -> bytes:
    ids = np.ascontiguousarray(ids, np.uint32)
    out, n = [], 0
    while True:
        more = ids >> BITS != 0
        bitmap = np.packbits(more, bitorder="little").tobytes()
        bitmap += b"\0" * (-len(bitmap) % 8)
        blocks = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        directory = np.cumsum(blocks) - blocks
        out.append(struct.pack("<q", len(ids)) + (ids & (1 << BITS) - 1).astype(np.uint8).tobytes() + bitmap + directory.astype("<i8").tobytes())
        n += 1
        ids = ids[more] >> BITS
        if not len(ids):
            return struct.pack("<q", n) + b"".join(out)


def encode_file(doc_ids: list, documents: list[np.ndarray]) -> bytes:
    starts = np.cumsum([0, *map(len, documents)], dtype=np.int64)
    levels = encode_levels(np.concatenate(documents) if documents else np.zeros(0, np.uint32))
    head = MAGIC + struct.pack("<5q", len(doc_ids), int(starts[-1]), struct.unpack_from("<q", levels)[0], 0, 0)
    known = np.array([i is not None for i in doc_ids], np.uint8)
    return head + np.array([i or 0 for i in doc_ids], "<i8").tobytes() + known.tobytes() + starts.astype("<i8").tobytes() + levels[8:]


class TokenFile:
    """Reads a file's bytes; tokens one by one, by range, or by document."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        self.documents, self.ids, levels = struct.unpack_from("<3q", data, 8)
        at = 48

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.doc_ids, self.known, self.starts = take("<i8", self.documents), take("u1", self.documents), take("<i8", self.documents + 1)
        self.levels = []
        for _ in range(levels):
            n = int(take("<i8", 1)[0])
            self.levels.append((take("u1", n), take("u1", -(-n // 64) * 8), take("<i8", -(-n // BLOCK))))

    def __getitem__(self, i: int) -> int:
        """Token i, through one rank per level."""
        value = 0
        for k, (chunks, bitmap, directory) in enumerate(self.levels):
            value |= int(chunks[i]) << BITS * k
            if not bitmap[i >> 3] >> (i & 7) & 1:
                return value
            block = i // BLOCK
            ahead = np.bitwise_count(bitmap[block * BLOCK // 8 : i >> 3]).sum() + int(bitmap[i >> 3] & (1 << (i & 7)) - 1).bit_count()
            i = int(directory[block]) + int(ahead)
        raise ValueError("the last level goes on")

    def slice(self, a: int, b: int) -> np.ndarray:
        """Tokens a to b - 1; reads of each level only the range that belongs to them."""
        out = np.zeros(b - a, np.uint32)
        own = np.arange(b - a)
        for k, (chunks, bitmap, directory) in enumerate(self.levels):
            if a >= b:
                break
            out[own] |= chunks[a:b].astype(np.uint32) << np.uint32(BITS * k)
            block = a // BLOCK
            bits = np.unpackbits(bitmap[block * BLOCK // 8 : (b + 7) // 8], bitorder="little")
            more = bits[a - block * BLOCK : b - block * BLOCK].astype(bool)
            own = own[more]
            first = int(directory[block]) + int(bits[: a - block * BLOCK].sum())
            a, b = first, first + len(own)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.starts[k]), int(self.starts[k + 1]))


def _place(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _write(folder: str, tokenizer: str, end_id: int, file_ids: int):
    def run(batches):
        where, path = _place(folder)
        where.create_dir(path, recursive=True)
        part, ids, docs, held = TaskContext.get().partitionId(), [], [], 0
        number = 0

        def flush():
            nonlocal ids, docs, held, number
            data = encode_file(ids, docs)
            name = f"part-{part:07d}-{number:05d}.dac"
            other = f"{path}/.{name}-{uuid.uuid4().hex}"
            with where.open_output_stream(other) as f:
                f.write(data)
            where.move(other, f"{path}/{name}")
            row = pa.RecordBatch.from_pydict({"part": [part], "number": [number], "name": [name], "documents": [len(ids)], "ids": [held]}, schema=pa.schema([("part", pa.int64()), ("number", pa.int64()), ("name", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())]))
            ids, docs, held, number = [], [], 0, number + 1
            return row

        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                piece = batch.slice(at, TOGETHER)
                found, cut = byte_level(tokenizer).encode_ended(piece.column(1), end_id)
                cut = cut.tolist()
                for i, a, b in zip(piece.column(0).to_pylist(), cut[:-1], cut[1:], strict=True):
                    if ids and held + b - a > file_ids:
                        yield flush()
                    ids.append(i)
                    docs.append(found[a:b])
                    held += b - a
        if ids:
            yield flush()

    return run


def _read(folder: str):
    def run(batches):
        where, path = _place(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with where.open_input_stream(f"{path}/{name}") as f:
                    file = TokenFile(f.read())
                whole = file.slice(0, file.ids)  # all of it is wanted, so it is decoded at once
                cut = file.starts.tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(file.doc_ids, mask=file.known == 0),
                        pa.array(file.starts[:-1] + base),
                        pa.array(np.diff(file.starts)),
                        pa.array([zlib.crc32(whole[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the ids of each text, in doc_id order, to files in ``folder``; a row for each file.

    ``folder`` has to be one that all executors share.
    """
    spark = docs.sparkSession
    ship_package(spark)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id", "text")
    files = ordered.mapInArrow(_write(folder, tokenizer or public_path("word_bpe_49k.json"), end_id, file_ids), "part long, number long, name string, documents long, ids long")
    return materialise(files, "token-files")


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read from the files."""
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    based = files.select("name", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long").alias("base"))  # a row a file
    ranges = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return based.repartition(ranges, "name").mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes the files to a fresh shared folder and reads them back."""
    folder = scratch_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, tokenizer, end_id), folder)
