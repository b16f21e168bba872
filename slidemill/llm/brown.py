"""Language-model scoring with Brown classes.

Tokens are the lower-cased words of a text and one end. P(w | v) = P(class w | class v) * P(w | class w):
class transitions with absolute discounting over the class frequencies; word emissions with 0.1
added, and in each class but the end's one more word for all that training has not seen. An unseen
word has the sum over the classes; after it the classes are as frequent as they are anywhere. So the
probabilities after any word sum to one.

Classes are assigned by exchange, in three steps that all weigh what the likelihood of the class
bigrams gains. First on the driver over a bounded table: words that make up at least 1/``COMMON`` of
the training tokens, beside one type for all others; each in turn moves to the class where it gains
most, until none moves or ``SWEEPS`` are done. Then over all words that training has ``FLOOR`` times,
however many they are, from the class of the others: their sparse bigrams are dealt out in blocks,
and in each of ``ROUNDS`` every block moves a share of its words against the class bigrams as of the
round's start and its own moves; a round that lowers the likelihood is undone and the share halved.
Last, each rarer word of the training texts is put by its own neighbours where it gains most. The
driver has one byte a word of the second step and the class bigrams; tasks have that and a block.

The corpus is encoded once: chunks of documents with a dictionary of word hashes (64 bits) and
token numbers. The token numbers stay in files of the shared folder, one a task, where each later
pass reads them, so that they are never shuffled. Dictionary parts are counted by hash, the counts go back to their chunks, and each
chunk is scored with them; so what is shuffled grows with the corpus, and no word is in every task
more than once a chunk.

Defined results: a null text counts as empty, so its tokens are the end alone; a null doc_id is held
out; repeated rows count and are scored each for itself; an empty table gives an empty result.
Without training documents the scores are those of unseen words.
"""

from __future__ import annotations

import uuid
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidemill.session import discard, materialise, scratch_path, ship_package

COMMON, CLASSES, SWEEPS = 2000, 128, 4
#: Training tokens from which a word takes part in the rounds of exchange, and their number.
FLOOR, ROUNDS = 5, 6
#: Types of a block, about, and (type, class) pairs that are weighed at once.
BLOCK_TYPES, WEIGHED = 4096, 4096
FOLDS, ADDED, DISCOUNT = 10, 0.1, 0.75
#: Tokens of a chunk, save for a longer single document.
CHUNK = 1_000_000
#: Texts that are taken out of an Arrow batch at once.
TEXTS = 256
#: Rows of the bigram table that are summed together, and groups of tasks whose sums are summed first.
BLOCK, LANES = 8, 64
PAIRS = "block long, lane long, places binary, counts binary"


def held_out(doc_id) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def squeeze(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def expand(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


CHUNK_COLUMNS = {"chunk": pa.int64(), "docs": pa.binary(), "null_ids": pa.binary(), "sizes": pa.binary(), "tokens": pa.string(), "hashes": pa.binary(), "counts": pa.binary(), "train_tokens": pa.int64(), "train_docs": pa.int64()}
CHUNK_SCHEMA = "chunk long, docs binary, null_ids binary, sizes binary, tokens string, hashes binary, counts binary, train_tokens long, train_docs long"


class Tokens:
    """Token numbers in files of a folder, each told by 'name:offset:length'; handles stay open for a task."""

    def __init__(self, folder: str):
        self.where, self.path = fs.FileSystem.from_uri(folder)
        self.files: dict = {}

    def __call__(self, told: str) -> np.ndarray:
        name, at, n = told.split(":")
        if name not in self.files:
            self.files[name] = self.where.open_input_file(f"{self.path}/{name}")
        return expand(self.files[name].read_at(int(n), int(at)), "<u4")

    def close(self) -> None:
        for f in self.files.values():
            f.close()


def numbering() -> defaultdict:
    """Gives each new key the next number."""
    numbers = defaultdict()
    numbers.default_factory = numbers.__len__
    return numbers


def _encode(folder: str, chunk_tokens: int):
    """Texts to chunks: token numbers into a dictionary that is ordered by word hash. An attempt of a
    task writes to a file of its own, which its rows name."""

    def run(batches):
        where, path = fs.FileSystem.from_uri(folder)
        where.create_dir(path, recursive=True)
        name = f"{TaskContext.get().partitionId():07d}-{uuid.uuid4().hex}"
        with where.open_output_stream(f"{path}/{name}") as file:
            yield from encoded(batches, name, file)

    def encoded(batches, name, file):
        part, number = TaskContext.get().partitionId(), 0
        words = numbering()
        ids, sizes, tokens = [], [], []
        held = 0

        def flush():
            nonlocal words, ids, sizes, tokens, held, number
            names = list(words)
            hashes = np.array([xxhash.xxh64_intdigest(w, 5) for w in names], np.uint64)
            order = np.argsort(hashes, kind="stable")
            place = np.empty(len(names), np.uint32)
            place[order] = np.arange(len(names), dtype=np.uint32)
            flat = place[np.concatenate(tokens)] if names else np.zeros(0, np.uint32)
            size = np.array(sizes, np.int64)
            train = np.array([not held_out(i) for i in ids])
            counts = np.bincount(flat[np.repeat(train, size)], minlength=len(names)).astype(np.uint32)
            data = squeeze(flat)
            told = f"{name}:{file.tell()}:{len(data)}"
            file.write(data)
            row = {
                "chunk": (part << 24) | number,
                "docs": squeeze(np.array([i or 0 for i in ids], np.int64)),
                "null_ids": squeeze(np.array([i is None for i in ids], np.uint8)),
                "sizes": squeeze(size),
                "tokens": told,
                "hashes": squeeze(hashes[order]),
                "counts": squeeze(counts),
                "train_tokens": int(size[train].sum() + train.sum()),
                "train_docs": int(train.sum()),
            }
            words, ids, sizes, tokens, held, number = numbering(), [], [], [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array([row[n]], t) for n, t in CHUNK_COLUMNS.items()], names=list(CHUNK_COLUMNS))

        for batch in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = (t or "").encode().lower().split()
                tokens.append(np.fromiter(map(words.__getitem__, found), np.uint32, len(found)))
                ids.append(i)
                sizes.append(len(found))
                held += len(found) + 1
                if held > chunk_tokens:
                    yield flush()
        if ids:
            yield flush()

    return run


def _cut(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Where the parts of rising hashes begin and end."""
    return np.concatenate([[0], np.searchsorted(hashes, [b * (2**64 // parts) for b in range(1, parts)]), [len(hashes)]]).astype(int)


def _deal(parts: int):
    """Each chunk's dictionary in parts by hash."""

    def run(batches):
        for batch in batches:
            for chunk, hashes, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashes, counts = expand(hashes, "<u8"), expand(counts, "<u4")
                cut = _cut(hashes, parts)
                rows = [(b, chunk, squeeze(hashes[x:y]), squeeze(counts[x:y])) for b, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if x < y]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["part", "chunk", "hashes", "counts"])

    return run


COUNTED = "kind int, part long, chunk long, counts binary, types binary, hash long, n long"


def _groups(batches):
    """Rows that come ordered by their first column, as lists of equal ones."""
    held = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[0] != held[0][0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _count(total: int, common: int):
    """Rows (part, chunk, hashes, counts) come ordered by part. Yields each chunk's counts and its words'
    places among the part's types, from 1 (kind 0), the common words with their places (1), and the numbers
    of rarer words (2) and of types (3)."""

    def settle(held):
        chunks, hashes, counts = zip(*((c, expand(h, "<u8"), expand(n, "<u4")) for _, c, h, n in held), strict=True)
        part = held[0][0]
        known, at = np.unique(np.concatenate(hashes), return_inverse=True)
        sums = np.bincount(at, np.concatenate(counts)).astype(np.int64)
        often = sums * common >= total if total else np.zeros(len(sums), bool)
        typed = often | (sums >= FLOOR)
        place = np.where(typed, np.cumsum(typed), 0)
        rows, end = [], 0
        for chunk, h in zip(chunks, hashes, strict=True):
            mine = at[end : end + len(h)]
            end += len(h)
            rows.append((0, part, chunk, squeeze(sums[mine].astype(np.uint64)), squeeze(place[mine].astype(np.uint32)), None, None))
        rows += [(1, part, None, None, None, int(h), int(x)) for h, x in zip(known[often].view(np.int64), place[often], strict=True)]
        rows += [(2, part, None, None, None, None, int((~typed & (sums > 0)).sum())), (3, part, None, None, None, None, int(typed.sum()))]
        types = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in COUNTED.split(", ")])

    return lambda batches: (settle(held) for held in _groups(batches))


def types_of(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The type of each dictionary word: its place among the common hashes, or the one after them."""
    at = np.searchsorted(common, hashes)
    own = common[np.minimum(at, len(common) - 1)] == hashes if len(common) else np.zeros(len(hashes), bool)
    return np.where(own, at, len(common))


def with_ends(values: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The values of all documents with ``end`` after each, and before each its predecessor."""
    after = np.insert(values, np.cumsum(sizes), end)
    return after, np.concatenate([[end], after[:-1]])[: len(after)]


def _pairs(folder: str, common: np.ndarray, block: int):
    """Counts of type bigrams in the training documents, summed in each task; sparse, by blocks of rows."""
    n = len(common) + 2

    def run(batches):
        numbers = Tokens(folder)
        table = np.zeros(n * n, np.int64)
        for batch in batches:
            for docs, null_ids, sizes, tokens, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sizes = expand(sizes, "<i8")
                train = _training(docs, null_ids)
                kinds = types_of(expand(hashes, "<u8"), common)
                flat = kinds[numbers(tokens)[np.repeat(train, sizes)]]
                now, before = with_ends(flat, sizes[train], n - 1)
                if train.any():
                    table += np.bincount(before * n + now, minlength=n * n)
        lane = TaskContext.get().partitionId() % LANES
        for b in range(-(-n // block)):
            part = table[b * block * n : (b + 1) * block * n]
            if len(at := np.flatnonzero(part)):
                yield _sparse(b, lane, at, part[at])
        numbers.close()

    return run


def _sparse(block: int, lane: int, at: np.ndarray, counts: np.ndarray):
    columns = [pa.array([block], pa.int64()), pa.array([lane], pa.int64()), pa.array([squeeze(at.astype(np.uint32))]), pa.array([squeeze(counts.astype(np.int64))])]
    return pa.RecordBatch.from_arrays(columns, names=["block", "lane", "places", "counts"])


def _sum_pairs(size: int):
    """Rows come ordered by block and lane; one sum for each."""

    def run(batches):
        now, table = None, None
        for batch in batches:
            for block, lane, places, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (block, lane) != now:
                    if now is not None:
                        at = np.flatnonzero(table)
                        yield _sparse(*now, at, table[at])
                    now, table = (block, lane), np.zeros(size, np.int64)
                table[expand(places, "<u4")] += expand(counts, "<i8")
        if now is not None:
            at = np.flatnonzero(table)
            yield _sparse(*now, at, table[at])

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS, others: bool = False) -> np.ndarray:
    """Classes of types from their bigram counts; the last type (the end) is alone in class 0, and with
    ``others`` the one before it stays in the last class.

    Maximises sum n(c,d) log n(c,d) - sum n(c) log n(c) - sum n(d) log n(d), the likelihood of the
    class bigrams, by moving one type at a time, the frequent ones first.
    """
    t = len(pairs)
    mass = pairs.sum(axis=1) + pairs.sum(axis=0)
    order = np.argsort(-mass[:-1], kind="stable")
    of = np.zeros(t, np.int64)
    of[order] = 1 + np.arange(t - 1) % max(1, classes - 1)
    if others:
        of[-2] = classes - 1
        order = order[order != t - 2]
    member = np.zeros((t, classes))
    member[np.arange(t), of] = 1
    into, out = pairs.T @ member, pairs @ member  # per type: by class of the one before, after
    table = member.T @ out
    for _ in range(sweeps):
        moved = 0
        for i in order:
            if not mass[i]:
                continue
            here, self_ = of[i], pairs[i, i]
            after, before = out[i].copy(), into[i].copy()
            after[here] -= self_
            before[here] -= self_
            table[here] -= after
            table[:, here] -= before
            table[here, here] -= self_
            left, right = table.sum(axis=1), table.sum(axis=0)
            # What the objective gains by type i in each class.
            grid = _xlogx(table)
            row = (_xlogx(table + after) - grid).sum(axis=1)
            column = (_xlogx(table + before[:, None]) - grid).sum(axis=0)
            d = np.diag(table)
            corner = _xlogx(d + after + before + self_) - _xlogx(d + after) - _xlogx(d + before) + _xlogx(d)
            sides = _xlogx(left + after.sum() + self_) - _xlogx(left) + _xlogx(right + before.sum() + self_) - _xlogx(right)
            gain = row + column + corner - sides
            gain[0] = -np.inf
            best = int(np.argmax(gain))
            if gain[best] <= gain[here] + 1e-9:
                best = here
            table[best] += after
            table[:, best] += before
            table[best, best] += self_
            if best != here:
                moved += 1
                of[i] = best
                out[:, here] -= pairs[:, i]
                out[:, best] += pairs[:, i]
                into[:, here] -= pairs[i]
                into[:, best] += pairs[i]
        if not moved:
            break
    return of


def class_model(of: np.ndarray, table: np.ndarray, size: np.ndarray, distinct: np.ndarray) -> dict:
    """The model from the types' classes, class bigrams, and tokens and distinct words of each class."""
    prior = (size + ADDED) / (size.sum() + ADDED * len(size))
    seen = table.sum(axis=1)
    rest = np.where(seen > 0, DISCOUNT * (table > 0).sum(axis=1) / np.maximum(seen, 1), 1.0)
    step = np.maximum(table - DISCOUNT, 0) / np.maximum(seen, 1)[:, None] + rest[:, None] * prior
    return {"of": of, "step": np.log10(step), "room": np.log10(size + ADDED * (distinct + 1)), "size": size, "distinct": distinct}


def fit(pairs: np.ndarray, tokens: np.ndarray, words: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> dict:
    """The model from type bigrams, and tokens and distinct words of each type."""
    of = exchange(pairs, classes, sweeps)
    member = np.zeros((len(pairs), classes))
    member[np.arange(len(pairs)), of] = 1
    return class_model(of, member.T @ (pairs @ member), np.bincount(of, tokens, classes), np.bincount(of, words, classes))


TYPED = "chunk long, docs binary, null_ids binary, sizes binary, tokens string, hashes binary, kinds binary, counts binary"


def _typed(offsets: np.ndarray, types: int):
    """Chunks with what came back by part: the type and the count of each dictionary word. Beyond the types
    are numbers for the rarer words, for the end, and for words that training hasn't."""

    def run(batches):
        for batch in batches:
            for chunk, docs, null_ids, sizes, tokens, hashes, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kinds, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for x in sorted(found or [], key=lambda x: x["part"]):
                    place, n = expand(x["types"], "<u4").astype(np.int64), expand(x["counts"], "<u8")
                    kinds.append(np.where(place > 0, offsets[x["part"]] + place - 1, np.where(n > 0, types, types + 2)))
                    counts.append(n)
                row = (docs, null_ids, sizes, tokens, hashes, squeeze(np.concatenate(kinds).astype(np.uint32)), squeeze(np.concatenate(counts)))
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (chunk, *row)], names=[c.split()[0] for c in TYPED.split(", ")])

    return run


def _training(docs: bytes, null_ids: bytes) -> np.ndarray:
    return np.array([not (x or held_out(int(i))) for i, x in zip(expand(docs, "<i8"), expand(null_ids, "u1"), strict=True)], bool)


def pack(keys: np.ndarray) -> bytes:
    """Rising keys by their differences, byte by byte, which leaves little of each."""
    return squeeze(np.diff(keys.astype(np.uint64), prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T)


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(expand(data, "u1").reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64).astype(np.int64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


NEIGHBOURS = "block long, out_keys binary, out_counts binary, in_keys binary, in_counts binary"


def _neighbours(block: int, sides) -> pa.RecordBatch:
    out = [pa.array([block], pa.int64())]
    for keys, counts in sides:
        out += [pa.array([pack(keys)]), pa.array([squeeze(counts.astype(np.int64))])]
    return pa.RecordBatch.from_arrays(out, names=[c.split()[0] for c in NEIGHBOURS.split(", ")])


def _bigrams(folder: str, n: int, blocks: int):
    """Each training bigram of a chunk twice: with the block of its first type (out) and of its second (in).

    Type i is number i // blocks of block i % blocks; a key is that number times n, plus the neighbour."""

    def run(batches):
        numbers = Tokens(folder)
        for batch in batches:
            for docs, null_ids, sizes, tokens, kinds in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sizes = expand(sizes, "<i8")
                train = _training(docs, null_ids)
                if not train.any():
                    continue
                flat = expand(kinds, "<u4").astype(np.int64)[numbers(tokens)[np.repeat(train, sizes)]]
                now, before = with_ends(flat, sizes[train], n - 1)
                before *= n
                before += now
                del flat, now
                keys, counts = np.unique(before, return_counts=True)
                del before
                for side in (0, 1):
                    own, other = np.divmod(keys, n)
                    if side:
                        own, other = other, own
                    # Ordered by block, number and neighbour.
                    key = (own % blocks) * (n // blocks + 1) * n + own // blocks * n + other
                    del own, other
                    order = np.argsort(key)
                    key, mine = key[order], counts[order]
                    del order
                    cut = np.searchsorted(key, np.arange(blocks + 1) * (n // blocks + 1) * n)
                    for b in np.flatnonzero(np.diff(cut)):
                        part = [(keys[:0], counts[:0])] * 2
                        part[side] = (key[cut[b] : cut[b + 1]] - b * (n // blocks + 1) * n, mine[cut[b] : cut[b + 1]])
                        yield _neighbours(int(b), part)
        numbers.close()

    return run


def _sum_neighbours(batches):
    """Rows come ordered by block; one for each."""
    now, held = None, []

    def summed():
        return [_summed(np.concatenate([h[x][0] for h in held]), np.concatenate([h[x][1] for h in held])) for x in (0, 1)]

    for batch in batches:
        for block, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if block != now and held:
                yield _neighbours(now, summed())
                held = []
            now = block
            held.append([(unpack(packed[0]), expand(packed[1], "<i8")), (unpack(packed[2]), expand(packed[3], "<i8"))])
            if len(held) >= 32:
                held = [summed()]
    if held:
        yield _neighbours(now, summed())


def _class_pairs(of, classes: int, n: int, blocks: int):
    """Class bigrams of the blocks of a task."""

    def run(batches):
        table = np.zeros(classes * classes)
        for batch in batches:
            for block, keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own, other = np.divmod(unpack(keys), n)
                table += np.bincount(of.value[own * blocks + block].astype(np.int64) * classes + of.value[other], expand(counts, "<i8"), classes * classes)
        if table.any():
            yield pa.RecordBatch.from_arrays([pa.array([squeeze(table)])], names=["pairs"])

    return run


def _weigh(table: np.ndarray, here: np.ndarray, out: np.ndarray, into: np.ndarray, same: np.ndarray) -> np.ndarray:
    """What the objective gains by each type in each class, the type taken out of its own; ``out`` and
    ``into`` are its neighbours by class without ``same``, its bigrams with itself."""
    n, classes = out.shape
    each = np.arange(n)
    gain = np.zeros((n, classes))
    gains, _ = insertion_tables(table)
    for part, (grid, mine, back) in enumerate(((table.T, out, into), (table, into, out))):
        # Small counts of other classes by the tables of gains, which don't know that the type leaves its own.
        few = np.where(mine <= FLOOR, mine, 0)
        few[each, here] = 0
        for k in range(1, FLOOR + 1):
            gain += (few == k).astype(float) @ gains[k, part * classes : (part + 1) * classes]
        i, d = np.nonzero(few)
        x, base = few[i, d], grid[d, here[i]]
        gain[each, here] += np.bincount(i, 2 * _xlogx(base) - _xlogx(base - x) - _xlogx(base + x), n)
        side = np.repeat(grid.sum(axis=0)[None], n, axis=0)
        whole = mine.sum(axis=1) + same
        side[each, here] -= whole
        gain -= _xlogx(side + whole[:, None]) - _xlogx(side)
        i, d = np.nonzero(mine - few)
        if not len(i):
            continue
        x, home = mine[i, d], d == here[i]
        base, was = grid[d], _xlogx(grid)[d]
        base[home] -= back[i[home]]
        row = np.arange(len(i))
        base[row, here[i]] -= x + home * same[i]
        was[home] = _xlogx(base[home])
        was[row, here[i]] = _xlogx(base[row, here[i]])
        base += x[:, None]
        first = np.flatnonzero(np.diff(i, prepend=-1))
        gain[i[first]] += np.add.reduceat(_xlogx(base) - was, first, axis=0)
    corner = np.repeat(np.diag(table)[None], n, axis=0)
    corner[each, here] -= out[each, here] + into[each, here] + same
    gain += _xlogx(corner + out + into + same[:, None]) - _xlogx(corner + out) - _xlogx(corner + into) + _xlogx(corner)
    gain[:, 0] = -np.inf
    return gain


def _move(of, table: np.ndarray, turn: int, share: int, n: int, blocks: int):
    """The classes of each block's types after every ``share``-th, from ``turn`` on, could move."""
    classes = len(table)

    def run(batches):
        for batch in batches:
            for block, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.arange(block, n, blocks)
                mine = of.value[ids].astype(np.int64)
                now, same, sides = table.copy(), np.zeros(len(ids)), []
                for side, (keys, counts) in enumerate((packed[:2], packed[2:])):
                    own, other = np.divmod(unpack(keys), n)
                    counts = expand(counts, "<i8")
                    self_ = ids[own] == other
                    if not side:
                        same += np.bincount(own[self_], counts[self_], len(ids))
                    own, other, counts = own[~self_], other[~self_], counts[~self_]
                    sides.append((own, other, counts))
                sides = [np.bincount(own * classes + of.value[other], counts, len(ids) * classes).reshape(-1, classes) for own, other, counts in sides]
                mass = sides[0].sum(axis=1) + same
                todo = np.flatnonzero((ids < n - 2) & (mass > 0) & ((np.arange(len(ids)) + turn) % share == 0))
                todo = todo[np.argsort(-mass[todo], kind="stable")]
                weight = np.cumsum((sides[0][todo] > 0).sum(axis=1) + (sides[1][todo] > 0).sum(axis=1))
                for at in np.split(todo, np.flatnonzero(np.diff(weight // WEIGHED)) + 1) if len(todo) else ():
                    out, into, here = sides[0][at], sides[1][at], mine[at]
                    gain = _weigh(now, here, out, into, same[at])
                    best = gain.argmax(axis=1)
                    go = np.flatnonzero(gain[np.arange(len(at)), best] > gain[np.arange(len(at)), here] + 1e-9)
                    change = np.zeros((classes, len(go)))
                    change[here[go], np.arange(len(go))] = -1
                    change[best[go], np.arange(len(go))] = 1
                    now += change @ out[go]
                    now += (change @ into[go]).T
                    now[np.diag_indices(classes)] += change @ same[at][go]
                    np.maximum(now, 0, out=now)
                    mine[at[go]] = best[go]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([squeeze(mine.astype(np.uint8))])], names=["block", "classes"])

    return run


def likelihood(table: np.ndarray) -> float:
    return float(_xlogx(table).sum() - _xlogx(table.sum(axis=0)).sum() - _xlogx(table.sum(axis=1)).sum())


def _sum_tables(size: int):
    def run(batches):
        table = np.zeros(size)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                table += expand(x, "<f8")
        yield pa.RecordBatch.from_arrays([pa.array([squeeze(table)])], names=["pairs"])

    return run


def sum_of_tables(tables: DataFrame, classes: int) -> np.ndarray:
    """The sum of the tasks' class tables; the driver gets at most LANES of them."""
    lanes = tables.withColumn("lane", F.spark_partition_id() % LANES).repartition(LANES, "lane").select("pairs")
    found = np.zeros(classes * classes)
    for r in lanes.mapInArrow(_sum_tables(classes * classes), "pairs binary").collect():
        found += expand(bytes(r["pairs"]), "<f8")
    return found.reshape(classes, classes)


def exchange_all(neighbours: DataFrame, of: np.ndarray, blocks: int, classes: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all types, and class bigrams, from those that they start in; the last two types stay."""
    context, n = neighbours.sparkSession.sparkContext, len(of)

    def pairs_of(shared):
        return sum_of_tables(neighbours.select("block", "out_keys", "out_counts").mapInArrow(_class_pairs(shared, classes, n, blocks), "pairs binary"), classes)

    shared = context.broadcast(of)
    table, share = pairs_of(shared), 2
    for turn in range(rounds):
        other = of.copy()
        for r in neighbours.mapInArrow(_move(shared, table, turn, share, n, blocks), "block long, classes binary").collect():
            other[r["block"] :: blocks] = expand(bytes(r["classes"]), "u1")
        if (other == of).all():
            continue
        moved = context.broadcast(other)
        found = pairs_of(moved)
        if likelihood(found) > likelihood(table):
            shared.unpersist()
            of, table, shared = other, found, moved
        else:
            moved.unpersist()
            share *= 2
    return of, table


RARE = "part long, chunk long, hashes binary, keys binary, counts binary"


def _rare(folder: str, of, classes: int, types: int, parts: int):
    """Of each chunk, by part: the rarer words' hashes, and how often which class stands after (class) and
    before (``classes`` + class) each in the training documents."""

    def run(batches):
        numbers = Tokens(folder)
        width = 2 * classes
        for batch in batches:
            for chunk, docs, null_ids, sizes, tokens, hashes, kinds in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sizes, kinds, hashes = expand(sizes, "<i8"), expand(kinds, "<u4").astype(np.int64), expand(hashes, "<u8")
                train, rare = _training(docs, null_ids), np.flatnonzero(kinds == types)
                place = np.full(len(kinds) + 1, -1)
                place[rare] = np.arange(len(rare))
                cls = np.append(of.value[np.minimum(kinds, types)], of.value[-1]).astype(np.int64)
                flat = numbers(tokens).astype(np.int64)[np.repeat(train, sizes)]
                now, before = with_ends(flat, sizes[train], len(kinds))
                after, into = place[before] >= 0, place[now] >= 0
                keys, counts = np.unique(np.concatenate([place[before[after]] * width + cls[now[after]], place[now[into]] * width + classes + cls[before[into]]]), return_counts=True)
                cut = _cut(hashes[rare], parts)
                at = np.searchsorted(keys, cut * width)
                rows = [(b, chunk, squeeze(hashes[rare[cut[b] : cut[b + 1]]]), pack(keys[at[b] : at[b + 1]] - cut[b] * width), squeeze(counts[at[b] : at[b + 1]].astype(np.uint32))) for b in np.flatnonzero(np.diff(cut)).tolist()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["part", "chunk", "hashes", "keys", "counts"])
        numbers.close()

    return run


def insertion_tables(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the objective gains in each class by 0 to FLOOR bigrams with one of another class (after it, then
    before it), and loses by so many tokens of it (as first, then as second of a bigram)."""
    more = np.arange(FLOOR + 1.0)[:, None, None]
    grid = np.concatenate([table.T, table])  # by the neighbour's class and side, then the word's
    whole = np.stack([table.sum(axis=1), table.sum(axis=0)])
    return _xlogx(grid + more) - _xlogx(grid), _xlogx(whole + more) - _xlogx(whole)


def insertion(gains: np.ndarray, sides: np.ndarray, word: np.ndarray, cell: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """What the objective gains by each of n words of under FLOOR tokens in each class, the others being as
    they are; the words' neighbours are given in order of the word, by cell and count."""
    classes = gains.shape[-1]
    out = np.zeros((n, classes))
    if len(word):
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] = np.add.reduceat(gains[count, cell], first, axis=0)
    for side in (0, 1):
        own = cell // classes == side
        out -= sides[np.bincount(word[own], count[own], n).astype(np.int64), side]
    out[:, 0] = -np.inf
    return out


PLACED = "part long, chunk long, classes binary, words binary"


def _place(table: np.ndarray):
    """Rows of ``_rare`` come ordered by part. Yields for each chunk its rarer words' classes, and once a
    part (chunk null) the number of words by class."""
    classes = len(table)
    width = 2 * classes
    gains, sides = insertion_tables(table)

    def settle(held):
        hashes = [expand(h, "<u8") for _, _, h, _, _ in held]
        known, at = np.unique(np.concatenate(hashes), return_inverse=True)
        ends = np.cumsum([len(h) for h in hashes])
        keys, counts = [], []
        for (*_, k, n), begin in zip(held, ends - [len(h) for h in hashes], strict=True):
            word, cell = np.divmod(unpack(k), width)
            keys.append(at[begin + word] * width + cell)
            counts.append(expand(n, "<u4").astype(np.int64))
        keys, counts = _summed(np.concatenate(keys), np.concatenate(counts))
        best = np.empty(len(known), np.uint8)
        for a in range(0, len(known), WEIGHED):
            b = min(a + WEIGHED, len(known))
            x, y = np.searchsorted(keys, (a * width, b * width))
            word, cell = np.divmod(keys[x:y] - a * width, width)
            best[a:b] = insertion(gains, sides, word, cell, counts[x:y], b - a).argmax(axis=1)
        part, own = held[0][0], best[at]
        rows = [(part, chunk, squeeze(own[end - len(h) : end]), None) for (_, chunk, *_), h, end in zip(held, hashes, ends, strict=True)]
        rows.append((part, None, None, squeeze(np.bincount(best, minlength=classes).astype(np.int64))))
        types = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in PLACED.split(", ")])

    return lambda batches: (settle(held) for held in _groups(batches))


CLASSED = "docs binary, null_ids binary, sizes binary, tokens string, classes binary, counts binary"


def _classed(of, classes: int, types: int):
    """Chunks with the class of each dictionary word; ``classes`` for words that training hasn't."""

    def run(batches):
        for batch in batches:
            for docs, null_ids, sizes, tokens, kinds, counts, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kinds = expand(kinds, "<u4").astype(np.int64)
                own = np.append(of.value, classes)[kinds].astype(np.uint8)
                own[kinds == types] = np.concatenate([np.zeros(0, np.uint8), *(expand(x["classes"], "u1") for x in sorted(found or [], key=lambda x: x["part"]))])
                row = (docs, null_ids, sizes, tokens, squeeze(own), counts)
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=[c.split()[0] for c in CLASSED.split(", ")])

    return run


def _class_table(folder: str, classes: int):
    """Class bigrams of the training documents of a task's chunks."""

    def run(batches):
        numbers = Tokens(folder)
        table = np.zeros(classes * classes)
        for batch in batches:
            for docs, null_ids, sizes, tokens, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sizes, train = expand(sizes, "<i8"), _training(docs, null_ids)
                if train.any():
                    now, before = with_ends(expand(own, "u1").astype(np.int64)[numbers(tokens)[np.repeat(train, sizes)]], sizes[train], 0)
                    table += np.bincount(before * classes + now, minlength=classes * classes)
        yield pa.RecordBatch.from_arrays([pa.array([squeeze(table)])], names=["pairs"])
        numbers.close()

    return run


def unseen(model: dict) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the class transitions with a row for what follows an unseen word, and of an unseen word after each class."""
    prior = (model["size"] + ADDED) / (model["size"].sum() + ADDED * len(model["size"]))
    step = np.vstack([10 ** model["step"], prior])
    left = ADDED / 10 ** model["room"]
    left[0] = 0.0  # the end is all of its class
    return np.log10(step), np.log10(step @ left)


def _score(folder: str, model: dict, total: int, distinct: int, ends: int):
    """Rows of a chunk, with its classes and counts; scores of its documents."""
    room = np.log10(total + ADDED * (distinct + 1))
    step, new = unseen(model)
    classes = len(new) - 1
    emit = np.append(model["room"], 0.0)

    def run(batches):
        numbers = Tokens(folder)
        for batch in batches:
            for docs, null_ids, sizes, tokens, own, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                docs, null_ids, sizes = expand(docs, "<i8"), expand(null_ids, "u1").astype(bool), expand(sizes, "<i8")
                counts = np.append(expand(counts, "<u8"), ends).astype(float)
                cls = np.append(expand(own, "u1").astype(np.int64), 0)
                alone = np.log10(counts + ADDED)
                word = np.where(cls == 0, 0.0, alone - emit[cls])
                now, before = with_ends(numbers(tokens).astype(np.int64), sizes, len(cls) - 1)
                base = alone[now] - room
                here, last = cls[now], cls[before]
                mine = np.where(here == classes, new[last], step[last, np.minimum(here, classes - 1)] + word[now])
                at = np.cumsum(sizes + 1) - sizes - 1
                known = np.add.reduceat((counts > 0)[now].astype(np.int64), at)
                out = [
                    pa.array(docs, mask=null_ids),
                    pa.array([bool(x) or held_out(int(i)) for i, x in zip(docs, null_ids, strict=True)]),
                    pa.array(sizes + 1),
                    pa.array(known),
                    pa.array(np.full(len(docs), total)),
                    pa.array(np.add.reduceat(base, at)),
                    pa.array(np.add.reduceat(mine, at)),
                ]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        numbers.close()

    return run


def first_classes(types: int, classes: int) -> np.ndarray:
    """The classes that types begin in, dealt out in turn; then those of the rarer words, and of the end."""
    return np.append(1 + np.arange(types) % max(1, classes - 1), [classes - 1, 0]).astype(np.uint8)


def learn(docs: DataFrame, chunk_tokens: int = CHUNK, common: int = COMMON, classes: int = CLASSES, sweeps: int = SWEEPS) -> tuple[DataFrame, str, dict, int, int, int]:
    """The corpus as chunks with the classes of their words, the folder of their tokens, the class model,
    and the numbers of training tokens, distinct training tokens and training documents."""
    spark = docs.sparkSession
    ship_package(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    folder = scratch_path(spark, "tokens")
    chunks = materialise(texts.mapInArrow(_encode(folder, chunk_tokens), CHUNK_SCHEMA), "chunks")
    sums = chunks.agg(F.coalesce(F.sum("train_tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("train_docs"), F.lit(0)).alias("docs"), F.count("*").alias("chunks")).first()
    total, ends = int(sums["tokens"]), int(sums["docs"])
    each = max(tasks, int(sums["chunks"]))  # so many tasks that each has few chunks
    split = max(2 * tasks, min(8 * tasks, int(sums["chunks"])))
    parts = chunks.select("chunk", "hashes", "counts").mapInArrow(_deal(split), "part long, chunk long, hashes binary, counts binary")
    counted = materialise(parts.repartition(split, "part").sortWithinPartitions("part").mapInArrow(_count(total, common), COUNTED), "counts")
    often = counted.where("kind = 1").select("part", "hash", "n").collect()  # at most `common` words
    hashes = np.sort(np.array([r["hash"] for r in often], np.int64).view(np.uint64))
    n = len(hashes) + 2
    rarer = counted.where("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    offsets, types = np.zeros(split + 1, np.int64), 0
    for r in sorted(counted.where("kind = 3").select("part", "n").collect(), key=lambda r: r["part"]):  # a row a part
        offsets[r["part"]] = types
        types += r["n"]
    pairs = np.zeros(n * n)
    found = chunks.select("docs", "null_ids", "sizes", "tokens", "hashes").mapInArrow(_pairs(folder, hashes, BLOCK), PAIRS)
    for keys in (["block", "lane"], ["block"]):
        found = found.repartition(tasks, *keys).sortWithinPartitions(*keys).mapInArrow(_sum_pairs(BLOCK * n), PAIRS)
        found = found.withColumn("lane", F.lit(0).cast("long"))
    for r in found.toLocalIterator():  # at most n * n numbers
        pairs[r["block"] * BLOCK * n + expand(bytes(r["places"]), "<u4").astype(np.int64)] = expand(bytes(r["counts"]), "<i8")
    coarse = exchange(pairs.reshape(n, n), classes, sweeps, others=True).astype(np.uint8)
    of = first_classes(types, classes)
    for r in often:
        of[offsets[r["part"]] + r["n"] - 1] = coarse[np.searchsorted(hashes, np.array([r["hash"]], np.int64).view(np.uint64))[0]]
    back = counted.where("kind = 0").groupBy(F.col("chunk").alias("of_chunk")).agg(F.collect_list(F.struct("part", "counts", "types")).alias("found"))
    joined = chunks.repartition(each, "chunk").join(back.repartition(each, "of_chunk"), F.col("chunk") == F.col("of_chunk"), "left").select("chunk", "docs", "null_ids", "sizes", "tokens", "hashes", "found")
    typed = materialise(joined.mapInArrow(_typed(offsets, types), TYPED), "typed")
    discard(chunks)
    discard(counted)
    blocks = max(tasks, types // BLOCK_TYPES + 1)
    found = typed.select("docs", "null_ids", "sizes", "tokens", "kinds").mapInArrow(_bigrams(folder, len(of), blocks), NEIGHBOURS).repartition(blocks, "block").sortWithinPartitions("block")
    neighbours = materialise(found.mapInArrow(_sum_neighbours, NEIGHBOURS), "neighbours")
    of, table = exchange_all(neighbours, of, blocks, classes)
    discard(neighbours)
    shared = spark.sparkContext.broadcast(of)
    rare = typed.select("chunk", "docs", "null_ids", "sizes", "tokens", "hashes", "kinds").mapInArrow(_rare(folder, shared, classes, types, split), RARE)
    placed = materialise(rare.repartition(split, "part").sortWithinPartitions("part").mapInArrow(_place(table), PLACED), "rare")
    words = np.zeros(classes, np.int64)
    for r in placed.where("chunk IS NULL").select("words").collect():  # a row a part
        words += expand(bytes(r["words"]), "<i8")
    back = placed.where("chunk IS NOT NULL").groupBy(F.col("chunk").alias("of_chunk")).agg(F.collect_list(F.struct("part", "classes")).alias("found"))
    joined = typed.repartition(each, "chunk").join(back.repartition(each, "of_chunk"), F.col("chunk") == F.col("of_chunk"), "left").select("docs", "null_ids", "sizes", "tokens", "kinds", "counts", "found")
    classed = materialise(joined.mapInArrow(_classed(shared, classes, types), CLASSED), "classed")
    discard(typed)
    discard(placed)
    table = sum_of_tables(classed.select("docs", "null_ids", "sizes", "tokens", "classes").mapInArrow(_class_table(folder, classes), "pairs binary"), classes)
    distinct = np.bincount(of[:types], minlength=classes) + words
    distinct[0] += ends > 0
    return classed, folder, class_model(of, table, table.sum(axis=0), distinct), total, types + int(rarer) + (ends > 0), ends


def brown_scores(docs: DataFrame, chunk_tokens: int = CHUNK, common: int = COMMON, classes: int = CLASSES, sweeps: int = SWEEPS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document."""
    classed, folder, model, total, distinct, ends = learn(docs, chunk_tokens, common, classes, sweeps)
    return classed.mapInArrow(_score(folder, model, total, distinct, ends), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
