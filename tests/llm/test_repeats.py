import hashlib
import random

import numpy as np
import pytest

from slidemill.llm import repeats as R


def brute(rows, length):
    """Per row in corpus order: bytes, removed bytes, runs, what is left."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        data = (t or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((i, len(data), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(data, gone, strict=False) if not g)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, docs=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 5))) for _ in range(30)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randrange(5, 60))) for _ in range(5)]
    rows = []
    for i in range(docs):
        parts = [rng.choice(passages)[rng.randrange(9) :] if rng.random() < 0.4 else " ".join(rng.choice(words) for _ in range(rng.randrange(30))) for _ in range(rng.randrange(4))]
        rows.append((i * 3, " ".join(parts)))
    return rows + [(1000, "a" * 400), (1001, "ab" * 150 + "c"), (1002, "x" * 20), (1003, passages[0] * 3)]


@pytest.mark.parametrize("crowd", [R.CROWD, 2])
def test_against_all_strings(docs_of, crowd, monkeypatch):
    rows = corpus(1)
    out = R.repeats(docs_of(rows), 20, 6, crowd).collect()
    assert sorted(map(tuple, out), key=str) == brute(rows, 20)


def test_odd_rows_and_full_length(docs_of, odd_rows):
    rows = [*odd_rows, *corpus(2, 20), (2000, None), (2000, "q" * 500 + "r"), (None, "q" * 500 + "r"), (0, "z" * 99), (1, "z" * 100)]
    rows = [(i, t) for i, t in rows]
    assert sorted(map(tuple, R.repeats(docs_of(rows)).collect()), key=str) == brute(rows, 100)


def test_parts_of_long_texts(monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 64)
    monkeypatch.setattr(R, "HELD", 50)
    rng = random.Random(4)
    text = bytes(rng.choice(b"ab") for _ in range(700))
    found = R.parse([5], [text], 20, 6)
    starts = sorted(s + i for s, m in zip(found["start"].tolist(), found["many"].tolist(), strict=True) for i in range(m))
    assert starts == list(range(681))


@pytest.mark.parametrize("length", [4, 8, 11, 16, 100])
def test_suffix_ranks(length):
    rng = random.Random(length)
    data = bytes(rng.choice(b"ab\x00\xff") for _ in range(600)) + b"a" * 300
    starts = np.arange(len(data) - length + 1)
    rank = R.suffix_ranks(np.frombuffer(data, np.uint8), np.array([len(data)]), starts, length)
    order = {s: i for i, s in enumerate(sorted({data[s : s + length] for s in starts}))}
    assert rank.tolist() == [order[data[s : s + length]] for s in starts]


def test_packing_round_trip():
    rng = np.random.default_rng(3)
    found = np.empty(100, R.PHRASE)
    for n in R.PHRASE.names:
        found[n] = rng.integers(0, 1000, 100)
    back = R.unpack(R.pack(found, R.PHRASE.names), R.PHRASE.names)
    assert sorted(map(tuple, back.tolist())) == sorted(map(tuple, found.tolist()))


def test_drop_repeats(docs_of, odd_rows):
    rows = [(1, "é" * 80), (2, "x" + "é" * 80 + "y"), (3, None), (4, "short")]
    docs = docs_of(rows)
    out = R.drop_repeats(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got[2] == ("xy", 2) and got[3] == (None, None) and got[4] == ("short", 5)
    assert got[1][0].encode() == b"\xc3\xa9" * (len(got[1][0]))  # the overlaps within itself have gone
    assert R.drop_repeats(docs_of(odd_rows)).count() == len(odd_rows)


def test_empty_table(docs_of):
    none = docs_of([(1, "a")]).where("doc_id < 0")
    assert R.repeats(none).collect() == R.drop_repeats(none).collect() == []


def test_hot_triggers_in_lanes(docs_of):
    """A passage at whose end very many different texts follow, dealt out from the start, and in tasks of three."""
    rng = random.Random(9)
    passage = "the same words in each of these texts, again and again and again. "
    rows = [(i, passage + "".join(rng.choice("abcd ") for _ in range(60))) for i in range(300)]
    for crowd, hot in ((R.CROWD, 5), (3, R.HOT), (3, 5)):
        out = R.repeats(docs_of(rows), 20, 6, crowd, hot).collect()
        assert sorted(map(tuple, out), key=str) == brute(rows, 20)


def test_second_parse_is_prefix_free():
    rng = random.Random(6)
    data = bytes(rng.choice(b"ab\x00") for _ in range(3000)) + bytes(40) + b"a" * 200
    raw = data + bytes(R.WINDOW)
    words = R._words(np.frombuffer(raw + bytes(7), np.uint8), len(raw))
    begins, names, places = R.second_parse(raw, words, len(data))
    assert names == sorted(set(names))
    whole = b"".join(names[p][: -R.WINDOW] for p in places) + bytes(R.WINDOW)
    assert whole == raw and len(begins) == len(places)
    tails = sorted({x[i:] for x in names for i in range(len(x) - R.WINDOW)})
    assert not any(b != a and b.startswith(a) for a, b in zip(tails, tails[1:], strict=False))


def test_clashing_names(spark):
    rows = [(1, "é" * 80, 1, "a", 2, 3), (2, "x" + "é" * 80 + "y", 4, "b", 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key long, spans string, of long, __key long")
    out = R.drop_repeats(docs)
    assert out.columns == docs.columns
    assert {tuple(r)[2:] for r in out.collect()} == {r[2:] for r in rows}
