import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from slidemill.llm import packing as P
from slidemill.llm import sentence_pieces as SP
from slidemill.llm import token_files as T
from slidemill.llm import tokens as K
from slidemill.llm.rounds import LONG, Merges, merge_long, merge_words

WORD, BYTE, PIECE = (K.public_path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = ["", "  a", "a  b ", "\n\n x\n", "▁▁x", "é́x", "İstanbul ΑΣ", "<|endoftext|> a", "a\x1cb \x1f", "日本語 テスト", "don't we'll 12 345", "😀 x", "　x y", " " * 50 + "a" + " " * 40, "ªº µ ß ſ K", "\x00a", "ab" * 900, " " * 2500]


def check_all(texts):
    for path in (WORD, BYTE):
        k = K.byte_level(path)
        assert [x.tolist() for x in k.encode_batch(texts)] == [e.ids for e in k.library.encode_batch(texts, add_special_tokens=False)]
    k = K.pieces(PIECE)
    want = k.library.encode(texts, num_threads=1)
    for ids, (got, decimals) in zip(want, k.encode_both(texts), strict=True):
        assert got.tolist() == ids and decimals.decode() == ",".join(map(str, ids))
        assert k.decode(got).decode() == k.library.decode(ids)


def test_odd_texts_equal_the_libraries():
    check_all(ODD)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab eé\n '.1x▁ ,İ́日thionr  \t\x0b\x85\xa0"), st.characters(codec="utf-8")), max_size=80), max_size=8))
def test_texts_equal_the_libraries(texts):
    check_all(texts)


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(K, "CACHED", 10)
    check_all(["one two three four five six", "seven eight nine ten eleven twelve thirteen", "one two"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"'stremvldSJ9  \n\t.×ÉßÞ\u030c日\u2028", "'ll", "'re", "don't", "<|endoftext|>", "\x1c"]), max_size=30).map("".join), max_size=6))
def test_columns_equal_the_libraries_whatever_the_slices(texts):
    before, K.SLICE = K.SLICE, 12
    try:
        for path in (WORD, BYTE):
            k = K.byte_level(path)
            ids, counts = k.encode_column(pa.array(["x", *texts, None])[1:])
            want = [e.ids for e in k.library.encode_batch([*texts, ""], add_special_tokens=False)]
            assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]
            ended, at = k.encode_ended(pa.array(texts, pa.string()), 7)
            assert [ended[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [[*x, 7] for x in want[:-1]]
    finally:
        K.SLICE = before


def test_no_word_becomes_an_object(monkeypatch):
    """Token files and packing cut and merge the words of a column as bytes, the distinct parts all at once."""
    monkeypatch.setattr(K.ByteLevel, "encode_batch", None)
    calls = []
    monkeypatch.setattr(K, "merge_words", lambda *a: calls.append(len(a[1])) or merge_words(*a))
    texts = [" ".join(f"w{i * j % 97}" for j in range(50)) for i in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    monkeypatch.setattr(P.TaskContext, "get", lambda: type("T", (), {"partitionId": lambda self: 0})())
    (out,) = P._pieces(BYTE, 2, 1024, False)([batch])
    assert out.num_rows >= 1000 and len(calls) == 1 and calls[0] < 120


def slow_merge(word, rules):
    word = list(word)
    while True:
        found = [(rules[p][0], i, rules[p][1]) for i in range(len(word) - 1) if (p := (word[i], word[i + 1])) in rules]
        if not found:
            return word
        _, i, product = min(found)
        word[i : i + 2] = [product]


@pytest.mark.parametrize("seed", range(30))
def test_rounds_equal_one_merge_after_another(seed):
    """Random rules, with inverted ranks and ties."""
    rng = random.Random(seed)
    rules, symbols = {}, [0, 1, 2]
    for k in range(12):
        a, b = rng.choice(symbols), rng.choice(symbols)
        if (a, b) not in rules:
            rules[a, b] = (rng.randrange(8), 3 + k)
            symbols.append(3 + k)
    merges = Merges([a for a, _ in rules], [b for _, b in rules], [p for _, p in rules.values()], np.array([r for r, _ in rules.values()]))
    words = [[rng.randrange(3) for _ in range(rng.randrange(1, 25))] for _ in range(60)]
    out, count = merge_words(np.concatenate(words), np.array([len(w) for w in words]), merges)
    got = [x.tolist() for x in np.split(out, np.cumsum(count)[:-1])]
    assert got == [slow_merge(w, rules) for w in words]
    assert [merge_long(w, merges) for w in words] == got
    assert LONG > 25


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**24), max_size=1200), max_size=5))
def test_file_round_trip(documents):
    docs = [np.array(d, np.uint32) for d in documents]
    file = T.TokenFile(T.encode_file([i if i % 2 else None for i in range(len(docs))], docs))
    flat = [x for d in documents for x in d]
    assert [file[i] for i in range(0, len(flat), 7)] == flat[::7]
    assert [file.document(k).tolist() for k in range(len(docs))] == documents
    assert file.slice(len(flat) // 3, len(flat) // 2 + 1 if flat else 0).tolist() == flat[len(flat) // 3 : len(flat) // 2 + 1 if flat else 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("file_ids", [50, T.FILE_IDS])
def test_token_table(docs_of, odd_rows, tmp_path, file_ids):
    rows = [*odd_rows, *((20 + i, t) for i, t in enumerate(ODD))]
    folder = f"file://{tmp_path}/tokens"
    out = T.read_tokens(T.write_tokens(docs_of(rows), folder, file_ids=file_ids), folder).collect()
    library, want, start = K.byte_level(WORD).library, [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    got = sorted(map(tuple, out), key=lambda r: r[1])
    assert sorted(got, key=str) == sorted(want, key=str) or [r[1:] for r in got] == [r[1:] for r in want]
    assert len(list((tmp_path / "tokens").glob("*.dac"))) >= (2 if file_ids == 50 else 1)


def test_empty_tables(docs_of):
    none = docs_of([(1, "a")]).where("doc_id < 0")
    assert T.token_table(none).collect() == P.pack(none).collect() == SP.round_trip(none).collect() == []


def hold_packing(pieces, capacity):
    by = {}
    for sequence, offset, length in pieces:
        by.setdefault(sequence, []).append((offset, length))
    for found in by.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 12), max_size=12))
def test_plan(histogram):
    p = P.plan(histogram, 30)
    pieces, seen = [], {}
    for length, rank, many, sequence, offset in zip(*(p[n].tolist() for n in ("length", "rank", "many", "sequence", "offset")), strict=True):
        assert rank == seen.get(length, 0)
        seen[length] = rank + many
        pieces += [(sequence + i, offset, length) for i in range(many)]
    assert seen == histogram
    n = hold_packing(pieces, 30)
    assert n == p["sequences"][0] if histogram else not pieces
    bins = []
    for length in sorted((k for k, v in histogram.items() for _ in range(v)), reverse=True):  # plain best fit
        room = min((b for b in bins if b >= length), default=None)
        if room is None:
            room = 30
        else:
            bins.remove(room)
        bins.append(room - length)
    assert -(-sum(k * v for k, v in histogram.items()) // 30) <= n <= len(bins) + 1


def optimum(lengths, capacity):
    """Fewest sequences, by trying all ways."""
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity and bins[k] not in bins[:k]:
                go(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_dominance_keeps_an_optimum(lengths):
    counts = np.bincount(lengths, minlength=21)
    fixed = P.dominance(counts, 20)
    rest = [int(x) for x in np.repeat(np.arange(21), counts)]
    assert sum(n for _, n in fixed) + optimum(sorted(rest, reverse=True), 20) == optimum(sorted(lengths, reverse=True), 20)


def test_pack(docs_of, odd_rows):
    rows = [*odd_rows, *((20 + i, t) for i, t in enumerate(ODD)), (60, "word " * 5000)]
    out = P.pack(docs_of(rows)).collect()
    library = K.byte_level(BYTE).library
    want = []
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want += [(i, k, s, n, crc(ids[s : s + n])) for k, (s, n) in enumerate(P.cut(len(ids), 1024))]
    assert sorted((r[:5] for r in map(tuple, out)), key=str) == sorted(want, key=str)
    n = hold_packing([(r.sequence_id, r.offset, r.length) for r in out], 1024)
    assert n <= -(-sum(w[3] for w in want) // 1024) + 1
    sequences = P.packed_sequences(docs_of(rows)).collect()
    assert sum(len(s.ids) for s in sequences) == sum(w[3] for w in want) and all(len(s.ids) <= 1024 for s in sequences)


def test_round_trip(docs_of, odd_rows, spark):
    rows = [*odd_rows, *((20 + i, t) for i, t in enumerate(ODD))]
    sp = K.pieces(PIECE).library
    want = []
    for i, t in rows:
        ids = sp.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, SP.round_trip(docs_of(rows)).collect()), key=str) == sorted(want, key=str)
    back = SP.decode(SP.encode(docs_of(rows))).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(((i, sp.decode(sp.encode(t or ""))) for i, t in rows), key=str)
