"""Removal of repeated passages by prefix-free parsing.

Every byte goes that lies in a string of ``LENGTH`` bytes which also starts earlier in the corpus
(documents in ascending doc_id, matches within a document each).

The corpus is parsed twice. First by triggers that each string of LENGTH bytes has: its byte string of
``TRIGGER`` bytes with the smallest rolling hash, the leftmost of equals. Runs of strings with the
same trigger make a phrase: the text from the first to the last of them. Equal strings have equal
triggers at the same place, so they lie in phrases of one trigger. Of equal phrases all strings but
those of the first are repeats, which settles nearly all of a repetitive corpus; a phrase with whose
trigger no other phrase is found has no equal strings elsewhere. Phrases travel as packed arrays of
(trigger hash, phrase hash, key, place), pre-aggregated in each task; two 64-bit hashes stand for a phrase.

The remaining phrases, which share their trigger with other ones (where a repeated passage begins or
ends), are joined to texts by trigger and parsed again, now into phrases that end with a window of
``WINDOW`` bytes whose hash is 0 modulo ``MEAN`` and that overlap by it (``suffix_ranks``). No suffix
of a phrase longer than the window is a prefix of another one, so the order of the text's suffixes
is that of the pairs (place in the suffix array of the dictionary, place in the suffix array of the
parse from the next phrase on), and neither array is as long as a repetitive text. Neighbours in that
order are compared byte by byte; of equal strings, in corpus order, all but the first are repeats.

A trigger with over ``CROWD`` phrases is dealt out to several tasks, and what makes over ``HOT`` of the
phrases that a task holds goes to ``LANES`` dictionary parts from the start, so that no trigger is ever
gathered. Each such task passes on the first place of each of its strings, and their bytes, not a hash,
bring them together.

Defined results: a null text counts as empty; documents under LENGTH bytes lose nothing. Where
doc_ids are null or repeated, the rows are put in order of doc_id (null last) and text, and numbered
so; of repeated rows the first stays whole. An empty table gives an empty result. Other columns pass
as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidemill.llm.frames import free_name
from slidemill.session import materialise, ship_package

LENGTH, TRIGGER = 100, 32
#: Bytes that are hashed together; a longer text is cut into overlapping parts.
BLOCK = 1 << 18
#: Phrases that a task gathers before it pre-aggregates and passes them on.
HELD = 200_000
#: Rows that are taken out of an Arrow batch at a time.
TOGETHER = 128
#: Phrases of one trigger that are compared together at most, and bytes of a text to sort.
CROWD, SORTED = 2000, 500_000
#: Phrases of one trigger among those that a task gathers, beyond which they go to so many parts of the dictionary.
HOT, LANES = 1000, 256
#: Bytes by which phrases of the second parse overlap, and their mean length.
WINDOW, MEAN = 8, 16

BASE = 0x9E3779B97F4A7C15
PHRASE = np.dtype([("trigger", "<u8"), ("phrase", "<u8"), ("key", "<i8"), ("start", "<i8"), ("many", "<i2")])
SPAN = ("key", "start", "many")


@cache
def _powers():
    n = 2 * BLOCK + 2
    up, down = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, np.uint64(b)))]) for b in (BASE, pow(BASE, -1, 2**64)))
    values = np.random.default_rng(11).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return up, down, values


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def phrases(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, trigger: int = TRIGGER) -> tuple[np.ndarray, ...]:
    """Trigger hash, phrase hash, first start and number of strings of each phrase.

    ``data`` holds several texts that end at ``ends``; strings lie within one text each.
    """
    up, down, values = _powers()
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values[data] * up[:n], out=sums[1:])
    rolling = _mix((sums[trigger:] - sums[: n - trigger + 1]) * down[: n - trigger + 1])
    # The hash's upper part and the place in one number: its minimum is the leftmost smallest hash.
    low = np.uint64((1 << 24) - 1)
    least = (rolling & ~low) | np.arange(len(rolling), dtype=np.uint64)
    width, window = 1, length - trigger + 1
    while 2 * width <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < window:
        least = np.minimum(least[: n - length + 1], least[window - width :][: n - length + 1])
    begins = np.concatenate([[0], ends[:-1]])
    room = np.maximum(0, ends - begins - length + 1)
    keep = np.arange(room.sum()) + np.repeat(begins - (np.cumsum(room) - room), room)
    at = (least[keep] & low).astype(np.int64)
    if not len(at):
        return phrases(data[:0], ends[:0], length, trigger)
    head = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (keep[1:] != keep[:-1] + 1)]))
    many = np.diff(np.append(head, len(at)))
    start, place = keep[head], at[head]
    whole = (sums[start + many + length - 1] - sums[start]) * down[start]
    whole = _mix(whole ^ _mix((place - start).astype(np.uint64) << np.uint64(32) | many.astype(np.uint64)))
    return rolling[place], whole, start, many


def _blocks(keys: list[int], texts: list[bytes], length: int):
    """(keys, offsets, data, ends) of texts joined to blocks; long ones come in parts."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for key, text in zip(keys, texts, strict=True):
        for at in range(0, max(1, len(text) - length + 1), BLOCK - length + 1):
            part = text[at : at + BLOCK]
            if len(part) < length:
                continue
            if size + len(part) > BLOCK and held:
                yield held
                held, size = [], 0
            held.append((key, at, part))
            size += len(part)
    if held:
        yield held


def parse(keys: list[int], texts: list[bytes], length: int = LENGTH, trigger: int = TRIGGER) -> np.ndarray:
    """The phrases of texts."""
    out = []
    for block in _blocks(keys, texts, length):
        ends = np.cumsum([len(p) for *_, p in block])
        hashes, whole, start, many = phrases(np.frombuffer(b"".join(p for *_, p in block), np.uint8), ends, length, trigger)
        own = np.searchsorted(ends, start, side="right")
        found = np.empty(len(start), PHRASE)
        found["trigger"], found["phrase"], found["many"] = hashes, whole, many
        found["key"] = np.array([k for k, *_ in block], np.int64)[own]
        found["start"] = start - (ends - [len(p) for *_, p in block])[own] + np.array([o for _, o, _ in block], np.int64)[own]
        out.append(found)
    return np.concatenate(out) if out else np.zeros(0, PHRASE)


def first_of_equals(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of phrases: the first of each kind in corpus order, ordered by trigger, and the others."""
    found = found[np.lexsort((found["start"], found["key"], found["phrase"], found["trigger"]))]
    new = np.ones(len(found), bool)
    new[1:] = (found["trigger"][1:] != found["trigger"][:-1]) | (found["phrase"][1:] != found["phrase"][:-1])
    return found[new], found[~new]


def pack(found: np.ndarray, names: tuple[str, ...]) -> bytes:
    """The named fields one after another, ordered by key and with keys as differences, compressed."""
    found = found[np.argsort(found["key"], kind="stable")]
    columns = [np.ascontiguousarray(found[n]) for n in names]
    at = names.index("key")
    columns[at] = np.diff(columns[at], prepend=np.int64(0))
    return zstandard.ZstdCompressor(level=1).compress(b"".join(c.tobytes() for c in columns))


def unpack(data: bytes, names: tuple[str, ...]) -> np.ndarray:
    data = zstandard.ZstdDecompressor().decompress(data)
    kind = np.dtype([(n, PHRASE[n]) for n in names])
    out, at = np.empty(len(data) // kind.itemsize, kind), 0
    for name in names:
        part = np.frombuffer(data, kind[name], len(out), at)
        out[name] = np.cumsum(part) if name == "key" else part
        at += part.nbytes
    return out


def lanes_of(found: np.ndarray) -> np.ndarray:
    return 1 + (found["phrase"] >> np.uint64(20)).astype(np.int64) % LANES


def _parse(buckets: int, length: int, trigger: int, hot: int):
    """Packed phrases by part of the dictionary: kind 0 by trigger, 2 of hot triggers by trigger and lane,
    and 1 those that are known to be repeats. A phrase of no strings tells a trigger's part that it is hot."""

    def run(batches):
        held, size, turn = [], 0, TaskContext.get().partitionId()

        def dealt(found, lane, kind):
            to = (_mix(found["trigger"] + lane.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            cut = np.searchsorted(to[order], np.arange(buckets + 1))
            found = found[order]
            return [(b, kind, pack(found[cut[b] : cut[b + 1]], PHRASE.names)) for b in np.flatnonzero(np.diff(cut)).tolist()]

        def flush():
            first, others = first_of_equals(np.concatenate(held))
            names, kind, count = np.unique(first["trigger"], return_inverse=True, return_counts=True)
            laned = count[kind] > hot
            marks = np.zeros((count > hot).sum(), PHRASE)
            marks["trigger"] = names[count > hot]
            plain = np.concatenate([first[~laned], marks])
            rows = dealt(plain, np.zeros(len(plain), np.int64), 0) + dealt(first[laned], lanes_of(first[laned]), 2)
            if len(others):
                rows.append((turn % buckets, 1, pack(others, SPAN)))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "kind", "data"])

        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                found = parse(part.column(0).to_pylist(), [(t or "").encode() for t in part.column(1).to_pylist()], length, trigger)
                if len(found):
                    held.append(found)
                    size += len(found)
                if size > HELD:
                    yield flush()
                    held, size, turn = [], 0, turn + 1
        if held:
            yield flush()

    return run


def _dictionary(crowd: int):
    """Rows (bucket, kind, data) come ordered by bucket and kind; yields spans of repeats, and the phrases
    to sort with the salt by which those of a crowded trigger are dealt out."""
    names = ["key", "start", "many", "trigger", "salt", "crowded"]

    def rows(found, *more):
        more = more or [pa.nulls(len(found), t) for t in (pa.int64(), pa.int64(), pa.bool_())]
        return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(found[c]).astype(np.int64)) for c in ("key", "start", "many")), *more], names=names)

    def settle(blobs, kind):
        found = np.concatenate(blobs)
        marked = np.unique(found["trigger"][found["many"] == 0])
        first, others = first_of_equals(found[found["many"] > 0])
        if len(others):
            yield rows(others)
        lane = lanes_of(first) if kind == 2 else np.zeros(len(first), np.int64)
        _, of, count = np.unique(np.ascontiguousarray(first["trigger"]) + lane.astype(np.uint64), return_inverse=True, return_counts=True)
        hot = np.isin(first["trigger"], marked) | (kind == 2)
        open_ = (count[of] > 1) | hot
        if open_.any():
            first, lane, hot, parts = first[open_], lane[open_], hot[open_], -(-count[of][open_] // crowd)
            salt = lane << 32 | (_mix(np.ascontiguousarray(first["phrase"])) % parts.astype(np.uint64)).astype(np.int64)
            yield rows(first, pa.array(np.ascontiguousarray(first["trigger"]).view(np.int64)), pa.array(salt), pa.array(hot | (parts > 1)))

    def run(batches):
        now, blobs = None, []
        for batch in batches:
            for bucket, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 1:
                    yield rows(unpack(data, SPAN))
                    continue
                if (bucket, kind) != now and blobs:
                    yield from settle(blobs, now[1])
                    blobs = []
                now = (bucket, kind)
                blobs.append(unpack(data, PHRASE.names))
        if blobs:
            yield from settle(blobs, now[1])

    return run


def _words(data: np.ndarray, n: int) -> np.ndarray:
    """The 8 bytes from each of the first n places as a number, in the order of the bytes."""
    out, depth = data.astype(np.uint64), 1
    while depth < 8:
        out = (out[:-depth] << np.uint64(8 * depth)) | out[depth:]
        depth *= 2
    return out[:n]


def _doubled(rank: np.ndarray, room: np.ndarray, depth: int, need: int) -> np.ndarray:
    """Ranks by ``depth`` symbols made ranks by ``need`` symbols, or by the ``room`` that is left of them."""
    while depth < need:
        behind = np.zeros(len(rank), np.uint64)
        more = np.flatnonzero(room > depth)
        behind[more] = rank[more + depth] + np.uint64(1)
        found, rank = np.unique((rank << np.uint64(32)) | behind, return_inverse=True)
        rank = rank.astype(np.uint64)
        depth *= 2
        if len(found) == len(rank):
            break
    return rank


def second_parse(raw: bytes, words: np.ndarray, n: int) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Where the phrases of a text begin, the dictionary in order, and each phrase's place in it.

    ``raw`` is the text of n bytes and WINDOW zero bytes, which end the last phrase."""
    cuts = np.flatnonzero((_mix(words[1:n]) % np.uint64(MEAN) == 0) | (words[1:n] == 0)) + 1
    begins = np.concatenate([[0], cuts])
    parts = [raw[a:b] for a, b in zip(begins.tolist(), [*(cuts + WINDOW).tolist(), n + WINDOW], strict=True)]
    names = sorted(set(parts))
    place = dict(zip(names, range(len(names)), strict=True))
    return begins, names, np.fromiter(map(place.__getitem__, parts), np.int64, len(parts))


def dictionary_ranks(names: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of all suffixes of the dictionary's phrases, to ``length`` bytes, and where each phrase begins."""
    size = np.fromiter(map(len, names), np.int64, len(names))
    ends = np.cumsum(size)
    room = np.repeat(ends, size) - np.arange(ends[-1])
    short = np.uint64(8) * np.maximum(0, 8 - room).astype(np.uint64)
    words = _words(np.frombuffer(b"".join(names) + bytes(7), np.uint8), len(room))
    words = np.where(short < 64, words >> np.minimum(short, np.uint64(63)) << np.minimum(short, np.uint64(63)), np.uint64(0))
    return _doubled(np.unique(words, return_inverse=True)[1].astype(np.uint64), room, 8, min(length, int(size.max()))), ends - size


def parse_ranks(places: np.ndarray, begins: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the suffixes of the parse, by as many phrases as ``length`` bytes can take."""
    m, need = len(places), 1
    while need < m and (begins[need:] - begins[:-need]).min() < length:
        need *= 2
    return _doubled(places.astype(np.uint64), m - np.arange(m), 1, need)


def suffix_ranks(data: np.ndarray, ends: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Ranks of the suffixes at ``starts``, ordered to ``length`` bytes; equal ranks, equal strings.

    By prefix-free parsing: the pair of a suffix's rank in the dictionary and of the rank of the parse
    behind its phrase. Suffixes that a text's end cuts short take part with what follows in the data;
    ``starts`` must leave ``length`` bytes in their text.
    """
    n = len(data)
    raw = data.tobytes() + bytes(WINDOW)
    words = _words(np.frombuffer(raw + bytes(7), np.uint8), n + WINDOW)
    begins, names, places = second_parse(raw, words, n)
    inside, offset = dictionary_ranks(names, length)
    behind = np.append(parse_ranks(places, begins, length) + np.uint64(1), np.uint64(0))
    own = np.searchsorted(begins, starts, side="right") - 1
    pair = (inside[offset[places[own]] + starts - begins[own]] << np.uint64(32)) | behind[own + 1]
    order = np.argsort(pair, kind="stable")
    ordered, pair = starts[order], pair[order]
    # Neighbours of one pair are equal; of others, those that agree in each word of ``length`` bytes.
    alike = pair[1:] == pair[:-1]
    left = np.flatnonzero(~alike)
    for at in range(0, length, 8):
        x, y = words[ordered[left] + at], words[ordered[left + 1] + at]
        if length - at < 8:
            x, y = (v >> np.uint64(8 * (8 - (length - at))) for v in (x, y))
        left = left[x == y]
    alike[left] = True
    rank = np.empty(len(starts), np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], ~alike])) if len(starts) else 0
    return rank


def repeated_strings(keys: np.ndarray, starts: np.ndarray, many: np.ndarray, texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Of the strings of some phrases: spans of those that also start earlier in another of them, and
    of the first ones the phrase and the place in it."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(size)
    own = np.repeat(np.arange(len(texts)), many)
    inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    rank = suffix_ranks(np.frombuffer(b"".join(texts), np.uint8), ends, (ends - size)[own] + inner, length)
    key, place = keys[own], starts[own] + inner
    order = np.lexsort((place, key, rank))
    again = np.zeros(len(order), bool)
    again[order[1:]] = rank[order[1:]] == rank[order[:-1]]
    return runs(key[again], place[again]), own[~again], inner[~again]


def runs(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Spans of places that follow each other."""
    order = np.lexsort((place, key))
    key, place = key[order], place[order]
    head = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (place[1:] > place[:-1] + 1)])) if len(key) else np.zeros(0, int)
    many = np.append(place, 0)[np.append(head[1:], len(place)) - 1] - place[head] + 1 if len(key) else head
    out = np.empty(len(head), [("key", "<i8"), ("start", "<i8"), ("many", "<i8")])
    out["key"], out["start"], out["many"] = key[head], place[head], many
    return out


def _sort(length: int):
    """Rows (trigger, salt, crowded, key, start, many, text) come ordered by trigger and salt. Yields the
    spans of repeated strings, and of crowded triggers the first place of each string, with its bytes."""

    def out(key, start, many, string=None):
        columns = [pa.array(np.ascontiguousarray(x)) for x in (key, start, many)]
        return pa.RecordBatch.from_arrays([*columns, pa.nulls(len(key), pa.binary()) if string is None else pa.array(string, pa.binary())], names=["key", "start", "many", "string"])

    def settle(held):
        crowded, key, start, many, text = zip(*held, strict=True)
        key, start = np.array(key), np.array(start)
        found, own, inner = repeated_strings(key, start, np.array(many), list(text), length)
        if len(found):
            yield out(found["key"], found["start"], found["many"])
        meet = np.array(crowded)[own]
        own, inner = own[meet], inner[meet]
        for at in range(0, len(own), 10_000):
            o, i = own[at : at + 10_000], inner[at : at + 10_000]
            yield out(key[o], start[o] + i, np.ones(len(o), np.int64), [text[a][b : b + length] for a, b in zip(o.tolist(), i.tolist(), strict=True)])

    def run(batches):
        held, size, last = [], 0, None
        for trigger, salt, *row in _rows(batches):
            if size > SORTED and (trigger, salt) != last:
                yield from settle(held)
                held, size = [], 0
            held.append(row)
            size, last = size + len(row[-1]), (trigger, salt)
        if held:
            yield from settle(held)

    return run


def _squeeze(batches):
    """Compresses the text, the last column; the others pass."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            part = batch.slice(at, TOGETHER)
            packed = [squeeze((t or "").encode()) for t in part.column(part.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(packed, pa.binary())], names=[*part.schema.names[:-1], "packed"])


def _rows(batches):
    """The rows of Arrow batches as tuples, some at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, TOGETHER).columns), strict=True)


def _cut_phrases(length: int):
    """The bytes of each wanted phrase."""
    names = ("trigger", "salt", "crowded", "key", "start", "many")

    def run(batches):
        expand = zstandard.ZstdDecompressor().decompress
        for packed, found in _rows(batches):
            text = expand(packed)
            row = {c: [p[c] for p in found] for c in names}
            row["text"] = [text[p["start"] : p["start"] + p["many"] + length - 1] for p in found]
            yield pa.RecordBatch.from_pydict(row)

    return run


def keyed(docs: DataFrame, columns: list[str], key: str) -> DataFrame:
    """The columns, and ``key``: a number without repeats in the order of the corpus."""
    ids = docs.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n")).where("n > 1 OR id IS NULL")
    if ids.isEmpty():
        return docs.select(*columns, F.col("doc_id").cast("long").alias(key))
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("text")]
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = docs.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn(key, F.monotonically_increasing_id())
    return materialise(numbered.select(*columns, key), "numbered")


def repeat_spans(texts: DataFrame, length: int = LENGTH, trigger: int = TRIGGER, crowd: int = CROWD, hot: int = HOT) -> DataFrame:
    """(key, start, many): starts of strings that also start earlier, of rows (key, text)."""
    spark = texts.sparkSession
    ship_package(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = texts.mapInArrow(_parse(4 * tasks, length, trigger, hot), "bucket long, kind int, data binary")
    dealt = packed.repartition(tasks, "bucket").sortWithinPartitions("bucket", "kind")
    settled = materialise(dealt.mapInArrow(_dictionary(crowd), "key long, start long, many long, trigger long, salt long, crowded boolean"), "phrases")
    spans = settled.where("trigger IS NULL").select("key", "start", "many")
    unsettled = settled.where("trigger IS NOT NULL")
    wanted = unsettled.groupBy("key").agg(F.collect_list(F.struct("key", "start", "many", "trigger", "salt", "crowded")).alias("found"))
    joined = texts.mapInArrow(_squeeze, "key long, packed binary").join(wanted, "key").select("packed", "found")
    cut = joined.mapInArrow(_cut_phrases(length), "trigger long, salt long, crowded boolean, key long, start long, many long, text binary")
    dealt = cut.repartition(tasks, "trigger", "salt").sortWithinPartitions("trigger", "salt")
    ranked = materialise(dealt.mapInArrow(_sort(length), "key long, start long, many long, string binary"), "ranked")
    spans = spans.unionByName(ranked.where("string IS NULL").select("key", "start", "many"))
    strings = ranked.where("string IS NOT NULL").select("string", "key", "start")
    if not strings.isEmpty():
        first = strings.groupBy("string").agg(F.min(F.struct("key", "start")).alias("first"))
        again = strings.join(first, "string").where(F.struct("key", "start") != F.col("first"))
        spans = spans.unionByName(again.select("key", "start", F.lit(1).cast("long").alias("many")))
    return spans


def covered(n: int, spans: list, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs of bytes that strings starting in the spans cover."""
    out: list[list[int]] = []
    for start, many in sorted((s["start"], s["many"]) for s in spans):
        end = start + many + length - 1
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _remove(length: int):
    def run(batches):
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for doc, packed, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = expand(packed)
                gone = covered(len(text), spans or [], length)
                digest, at = hashlib.sha256(), 0
                for a, b in [*gone, (len(text), len(text))]:
                    digest.update(text[at:a])
                    at = b
                rows.append((doc, len(text), sum(b - a for a, b in gone), len(gone), digest.hexdigest()))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _with_spans(rows: DataFrame, key: str, spans: DataFrame, name: str) -> DataFrame:
    """The rows with the spans of their key, null where there are none, as ``name``."""
    of = free_name([*rows.columns, name], "of")
    own = spans.groupBy(F.col("key").alias(of)).agg(F.collect_list(F.struct("start", "many")).alias(name))
    return rows.join(own, rows[key] == own[of], "left").drop(of)


def repeats(docs: DataFrame, length: int = LENGTH, trigger: int = TRIGGER, crowd: int = CROWD, hot: int = HOT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = keyed(docs, ["doc_id", "text"], "key").select("key", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spans = repeat_spans(rows.select("key", "text"), length, trigger, crowd, hot)
    packed = rows.mapInArrow(_squeeze, "key long, doc_id long, packed binary")
    return _with_spans(packed, "key", spans, "spans").select("doc_id", "packed", "spans").mapInArrow(_remove(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def shortened(text: str | None, spans: list | None, length: int = LENGTH) -> str | None:
    """The text without the bytes that strings in the spans cover; characters that lie only partly there stay."""
    if text is None or not spans:
        return text
    data, at, kept = text.encode(), 0, []
    for a, b in [*covered(len(data), spans, length), (len(data), len(data))]:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while a < b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        kept.append(data[at:a])
        at = b
    return b"".join(kept).decode()


def drop_repeats(docs: DataFrame, length: int = LENGTH, trigger: int = TRIGGER, crowd: int = CROWD, hot: int = HOT) -> DataFrame:
    """All documents with their columns, the texts without repeated passages.

    Characters that lie only partly in a removed run of bytes stay. n_chars, where the documents
    have it, is set to the code points left. Only texts that lose something go to Python.
    """
    key = free_name(docs.columns, "key")
    name = free_name([*docs.columns, key], "spans")
    rows = keyed(docs, docs.columns, key)
    spans = repeat_spans(rows.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text")), length, trigger, crowd, hot)

    @F.arrow_udf("string")
    def shorten(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, found in columns:
            yield pa.array([shortened(t, x, length) for at in range(0, len(texts), TOGETHER) for t, x in zip(texts.slice(at, TOGETHER).to_pylist(), found.slice(at, TOGETHER).to_pylist(), strict=True)], pa.string())

    found = _with_spans(rows, key, spans, name)
    own = F.when(F.col(name).isNotNull(), F.col("text").cast("string"))
    text = F.when(F.col(name).isNull(), F.col("text").cast("string")).otherwise(shorten(own, F.col(name)))
    out = found.withColumn("text", text.cast(docs.schema["text"].dataType)).select(*docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
