"""SimHash near-dedup with pigeonring candidate filtering.

A fingerprint is 64 bits; a bit is set where it is set in over half of the XXH64 hashes (seed 42)
of a text's shingles. Two fingerprints link when at most ``BUDGET`` bits differ.

The 64 bits form a ring of ``SEGMENTS`` segments. If two fingerprints differ in at most BUDGET bits,
some start on the ring has every chain of l following segments differ in at most l*BUDGET/SEGMENTS
bits (the strong pigeonring principle). At such a start the first segment agrees, and so do further
segments at one of few combinations of places; these agreeing segments are the join key. In a
bucket of equal keys the chains prune the pairs before the full Hamming check.

Buckets are never expanded into pairs: a task emits a spanning forest, at most one link per member.
A bucket of over ``CHUNK`` fingerprints is cut into chunks, and each two chunks make a task of their
own, so that no task's size grows with a bucket.

Defined results: a null text counts as empty; texts without a word have fingerprint zero and link
like any other; texts of fewer words than a shingle hash their whole word sequence. Repeated rows
share a fingerprint. A null doc_id gets a component like any other row and is never the smallest;
a component of null ids alone has a null id. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidemill.llm.components import connected_components, local_components
from slidemill.llm.frames import free_name
from slidemill.session import materialise, ship_package

SEGMENTS, BUDGET, SHINGLE, SEED = 8, 4, 4, 42
WIDTH = 64 // SEGMENTS
#: Fingerprints of a bucket that one task compares with as many others at most.
CHUNK = 2048
#: Texts that are taken out of an Arrow batch at a time.
TOGETHER = 256


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()  # bytes: A-Z alone are lowered, and white space is x20 and x09-x0D
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    whole = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts, digest = [0, *ends], xxhash.xxh64_digest
    n = len(words) - shingle + 1
    hashes = np.frombuffer(b"".join([digest(whole[a : b - 1], SEED) for a, b in zip(starts[:n], ends[shingle - 1 :], strict=True)]), np.uint8).reshape(n, 8)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 65280):
        bits = np.unpackbits(hashes[at : at + 65280], axis=1)
        full = len(bits) // 255 * 255
        votes += np.add.reduce(bits[:full].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[full:].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def _fingerprints(shingle: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                prints = np.array([fingerprint(t, shingle) for t in part.column(1).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints)], names=["doc_id", "fp"])

    return run


def fingerprint_table(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long) of each row; written once."""
    ship_package(docs.sparkSession)
    return materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints(shingle), "doc_id long, fp long"), "fingerprints")


def key_places(agreeing: int) -> list[tuple[int, ...]]:
    """Places, from a chain's start, of which one combination agrees at any start that qualifies.

    Among the first 2*agreeing-1 segments the chain condition lets at most agreeing-1 differ, and
    of the first l at most l*BUDGET/SEGMENTS.
    """
    span = 2 * agreeing - 1
    chosen = []
    for rest in combinations(range(1, span), agreeing - 1):
        differing = [i for i in range(span) if i and i not in rest]
        if all(sum(i < n for i in differing) <= n * BUDGET // SEGMENTS for n in range(1, span + 1)):
            chosen.append((0, *rest))
    return chosen


def agreeing_segments(prints: int) -> int:
    """3 segments as key, or 4 beyond 2^26 fingerprints, to keep chance meetings in buckets few.

    Either key finds every link; only the work differs.
    """
    return 3 if prints <= 1 << 26 else 4


def _segment(x, i: int):
    return F.shiftrightunsigned(x, WIDTH * (i % SEGMENTS)).bitwiseAND(F.lit((1 << WIDTH) - 1).cast("long"))


def bucket_rows(prints: DataFrame, agreeing: int) -> DataFrame:
    """(bucket, start, fp): a row of each fingerprint for each key."""
    keys = []
    for t, (start, places) in enumerate((s, p) for s in range(SEGMENTS) for p in key_places(agreeing)):
        key = F.lit(t).cast("long")
        for i in places:
            key = F.shiftleft(key, WIDTH).bitwiseOR(_segment(F.col("fp"), start + i))
        keys.append(F.struct(key.alias("bucket"), F.lit(start).alias("start")))
    return prints.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.bucket", "k.start", "fp")


def chain_masks(start: int) -> list[np.uint64]:
    """Bits of the first l segments from start, for l = 1 to SEGMENTS."""
    seg = (1 << WIDTH) - 1
    return [np.uint64(m) for m in accumulate((seg << WIDTH * ((start + i) % SEGMENTS) for i in range(SEGMENTS)), lambda a, b: a | b)]


MASKS = [chain_masks(s) for s in range(SEGMENTS)]


def linked(x: np.ndarray, y: np.ndarray, start: int) -> np.ndarray:
    """Which pairs pass every chain from start, and so the full Hamming check at its last."""
    diff = x ^ y
    keep = np.arange(len(diff))
    for n, mask in enumerate(MASKS[start], 1):
        keep = keep[np.bitwise_count(diff[keep] & mask) <= n * BUDGET // SEGMENTS]
        if not len(keep):
            break
    return keep


def forest(prints: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints: breadth-first, never all pairs."""
    left, parents, children = prints, [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = linked(left, np.full(len(left), x), start)
            if len(near):
                parents.append(np.full(len(near), x))
                children.append(left[near])
                queue.extend(left[near])
                left = np.delete(left, near)
    return (np.concatenate(parents), np.concatenate(children)) if parents else (prints[:0], prints[:0])


def _links(batches):
    """Rows (bucket, part, start, fp) come ordered by bucket and part; yields links (a, b)."""
    held = None
    for batch in batches:
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        edge = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])) + 1
        last = edge[-1] if len(edge) else 0
        held = [x[last:] for x in rows]
        if last:
            yield from _group_links([x[:last] for x in rows], edge[:-1])
    if held is not None and len(held[0]):
        yield from _group_links(held, np.array([], int))


def _group_links(rows, edge):
    starts, prints = rows[2], rows[3].view(np.uint64)
    lo = np.concatenate([[0], edge])
    size = np.diff(np.concatenate([lo, [len(prints)]]))
    a, b = [], []
    for n in (2, 3, 4):  # the many small buckets, all at once
        at = lo[size == n]
        for i, j in combinations(range(n), 2):
            for s in range(SEGMENTS):
                own = at[starts[at] == s]
                near = own[linked(prints[own + i], prints[own + j], s)]
                a.append(prints[near + i])
                b.append(prints[near + j])
    for at, n in zip(lo[size > 4], size[size > 4], strict=True):
        x, y = forest(np.unique(prints[at : at + n]), int(starts[at]))
        a.append(x)
        b.append(y)
    a, b = np.concatenate(a), np.concatenate(b)
    if len(a):  # what several buckets of the batch have found becomes one forest
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = local_components(len(nodes), at[: len(a)], at[len(a) :])
        other = root != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[root[other]].view(np.int64)), pa.array(nodes[other].view(np.int64))], names=["a", "b"])


def links(prints: DataFrame, agreeing: int, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) among the distinct fingerprints ``fp`` whose components are those of all links."""
    rows = bucket_rows(prints, agreeing)
    large = materialise(rows.groupBy("bucket").count().where(F.col("count") > chunk).select("bucket", F.ceil(F.col("count") / chunk).cast("int").alias("parts")), "large-buckets")
    own = F.pmod(F.xxhash64("fp"), F.col("parts").cast("long")).cast("int")
    pair = lambda d: F.least(own, d) * F.lit(1 << 20).cast("long") + F.greatest(own, d)
    apart = F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.filter(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1), lambda d: d != own), pair))
    dealt = rows.join(large, "bucket", "left").select("bucket", F.explode(apart).alias("part"), "start", "fp")
    return dealt.repartition("bucket", "part").sortWithinPartitions("bucket", "part").mapInArrow(_links, "a long, b long")


def near_components(docs: DataFrame, shingle: int = SHINGLE, chunk: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    table = fingerprint_table(docs, shingle)
    prints = materialise(table.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    found = connected_components(links(prints.select("fp"), agreeing_segments(prints.count()), chunk))
    roots = prints.join(found.withColumnRenamed("node", "fp"), "fp")
    classes = roots.groupBy("root").agg(F.min("least").alias("component"))
    member = materialise(roots.join(classes, "root").select("fp", "component"), "members")
    of = prints.join(member, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    return table.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, chunk: int = CHUNK) -> DataFrame:
    """One document of each component, the one of the smallest doc_id, with all its columns."""
    name = free_name(docs.columns, "of_id")
    gone = near_components(docs, shingle, chunk).where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(materialise(gone, "near-copies"), F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")
