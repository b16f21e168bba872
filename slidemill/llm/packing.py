"""Best-fit packing of documents into sequences, after Martello-Toth dominance reduction.

Only the number of pieces of each length matters to a packing, at most ``capacity`` numbers, so the
driver packs the histogram of lengths: whole classes of equal sequences at a time. The reduction
fixes sequences that provably belong to some best packing (the longest piece with a partner that
no other choice beats) and takes them out; the rest is packed by best fit, longest first. The plan
then says which ranks of each length go to which sequences and offset, and the pieces, ranked
within their length by task and place, look that up.

Defined results: a null or empty text is its end id alone; rows with one doc_id are packed each for
itself; an empty table gives no sequence. Only documents longer than a sequence are cut: into full
pieces, the first one shorter where the length is no multiple.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slidemill.llm.tokens import byte_level, public_path
from slidemill.session import materialise, ship_package

CAPACITY, END_ID, TOGETHER = 1024, 2, 4096


def _two_smallest(counts: np.ndarray, skip: int, n: int) -> list[int]:
    """The n smallest lengths, repeats included, leaving out one piece of length skip."""
    out: list[int] = []
    for length in np.flatnonzero(counts):
        out += [int(length)] * min(n - len(out), int(counts[length]) - (length == skip))
        if len(out) == n:
            break
    return out


def _best_pair(counts: np.ndarray, skip: int, room: int) -> int:
    """The largest sum within room of two pieces, leaving out one piece of length skip; 0 if none fits."""
    have = counts.copy()
    have[skip] -= 1
    lengths = np.flatnonzero(have)
    best, lo, hi = 0, 0, len(lengths) - 1
    while lo <= hi:
        total = int(lengths[lo] + lengths[hi])
        if total > room or (lo == hi and have[lengths[lo]] < 2):
            hi -= 1
        else:
            best = max(best, total)
            lo += 1
    return best


def _two_above(counts: np.ndarray, floor: int, skip: int) -> int:
    """The sum of the two smallest pieces longer than ``floor``, leaving out one of length skip; a great number if there aren't two."""
    out = 0
    need = 2
    for length in np.flatnonzero(counts[floor + 1 :]) + floor + 1:
        take = min(need, int(counts[length]) - (length == skip))
        out, need = out + take * int(length), need - take
        if not need:
            return out
    return 1 << 40


def dominance(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Takes out of counts, longest first, sequences that dominate every other one with that piece.

    With j the longest piece left and k the longest that fits beside it, {j, k} dominates where it
    fills the sequence, where no two pieces fit beside j, or where no three do and no two are longer
    together than k. Where at most two fit beside j, {j, k, b} dominates with b the longest that fits
    beside j and k, if no two pieces longer than b fit beside j: of any two that do, the longer is at
    most k and the shorter at most b. Where nothing fits beside j, {j} stands alone. What is taken out
    makes none of this untrue, so a choice holds until one of its lengths is used up.
    """
    fixed = []
    for j in range(capacity, 0, -1):
        while counts[j]:
            room, have = capacity - j, counts.copy()
            have[j] -= 1
            fits = np.flatnonzero(have[: room + 1])
            if not len(fits):
                fixed.append(((j,), int(counts[j])))
                counts[j] = 0
                break
            k = int(fits[-1])
            small = _two_smallest(counts, j, 3)
            only_one = len(small) < 2 or small[0] + small[1] > room
            only_two = len(small) < 3 or sum(small) > room
            chosen = None
            if k == room or only_one or (only_two and _best_pair(counts, j, room) <= k):
                chosen = (j, k)
            elif only_two:
                have[k] -= 1
                beside = np.flatnonzero(have[: room - k + 1])
                if len(beside) and _two_above(counts, int(beside[-1]), j) > room:
                    chosen = (j, k, int(beside[-1]))
            if chosen is None:
                break
            n = min(int(counts[x]) // chosen.count(x) for x in set(chosen))
            for x in chosen:
                counts[x] -= n
            fixed.append((chosen, n))
    return fixed


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, of all pieces of counts; equal sequences are handled together."""
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            room = min((r for r in groups if r >= length), default=None)
            if room is None:
                room, pattern, n = capacity, (), left  # new ones, as many as it takes
            else:
                pattern, n = groups[room].pop()
                if not groups[room]:
                    del groups[room]
            each = room // length
            full = min(n, left // each)
            rest = min(left - full * each, each) if full < n else 0
            for take, many in ((each, full), (rest, 1 if rest else 0), (0, n - full - bool(rest) if pattern else 0)):
                if many:
                    groups.setdefault(room - take * length, []).append((pattern + (length,) * take, many))
            left -= full * each + rest
    return [g for found in groups.values() for g in found]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Slots (length, rank, many, sequence, offset): ranks rank to rank+many-1 of that length go to
    the sequences from ``sequence`` on, one each, at ``offset``. Ordered by length and rank."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    slots, ranks, sequence = [], np.zeros(capacity + 1, np.int64), 0
    fixed = dominance(counts, capacity)
    for pattern, many in fixed + best_fit(counts, capacity):
        offset = 0
        for length in pattern:
            slots.append((length, ranks[length], many, sequence, offset))
            ranks[length] += many
            offset += length
        sequence += many
    slots.sort()
    names = ("length", "rank", "many", "sequence", "offset")
    return dict(zip(names, np.array(slots, np.int64).reshape(-1, 5).T, strict=True)) | {"sequences": np.array([sequence])}


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def _pieces(tokenizer: str, end_id: int, capacity: int, with_ids: bool):
    def run(batches):
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                rows, crcs, ids = [], [], []
                found, at_ids = byte_level(tokenizer).encode_ended(part.column(1), end_id)
                at_ids = at_ids.tolist()
                for i, a, b in zip(part.column(0).to_pylist(), at_ids[:-1], at_ids[1:], strict=True):
                    whole = found[a:b].astype("<u4")
                    for number, (start, length) in enumerate(cut(len(whole), capacity)):
                        rows.append((i, number, start, length, int(seen[length])))
                        seen[length] += 1
                        crcs.append(zlib.crc32(whole[start : start + length].tobytes()))
                        if with_ids:
                            ids.append(whole[start : start + length])
                doc, number, start, length, rank = zip(*rows, strict=True)
                columns = {"doc_id": pa.array(doc, pa.int64()), "piece": pa.array(number, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64()), "task": pa.array([task] * len(rows), pa.int64()), "place": pa.array(rank, pa.int64())}
                if with_ids:
                    columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def piece_table(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of each document, ranked within task and length; written once."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, place long" + ", ids array<int>" * with_ids
    return materialise(rows.mapInArrow(_pieces(tokenizer or public_path("byte_bpe_50k.json"), end_id, capacity, with_ids), schema), "pieces")


def _assign(slots: dict[str, np.ndarray]):
    def run(batches):
        shift = np.int64(1) << np.int64(40)  # length and rank in one number, to search both at once
        keys = slots["length"] * shift + slots["rank"]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, length * shift + rank, side="right") - 1
            out = {n: batch.column(n) for n in batch.schema.names if n != "rank"}
            out |= {"sequence_id": pa.array(slots["sequence"][at] + rank - slots["rank"][at]), "offset": pa.array(slots["offset"][at])}
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (length, task, place, ...)."""
    per_task = materialise(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("base"))
    # Merged, never broadcast: the bases grow with the tasks.
    ranked = pieces.join(bases.hint("merge"), ["task", "length"]).withColumn("rank", F.col("base") + F.col("place")).drop("task", "place", "base")
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank"]
    return ranked.mapInArrow(_assign(plan(histogram, capacity)), ", ".join([*names, "sequence_id long", "offset long"]))


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place_pieces(piece_table(docs, tokenizer, capacity, end_id), capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def packed_sequences(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The sequences themselves: sequence_id, ids (array), and the doc_ids in order."""
    placed = place_pieces(piece_table(docs, tokenizer, capacity, end_id, with_ids=True), capacity)
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))  # at most capacity pieces
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
