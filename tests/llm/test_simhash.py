import random
from itertools import product

import numpy as np
import pytest
import xxhash

from slidemill.llm import simhash as S
from slidemill.llm.components import connected_components, local_components


def plain_fingerprint(text, k=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(ids, prints):
    """Smallest id reachable, by comparing all pairs."""
    p = np.array(prints, np.uint64)
    a, b = np.nonzero(np.bitwise_count(p[:, None] ^ p[None, :]) <= 4)
    root = local_components(len(p), a, b)
    least = {}
    for i, r in zip(ids, root, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [least.get(r) for r in root]


def test_fingerprint_against_plain_form():
    rng = random.Random(5)
    for n in (0, 1, 3, 4, 5, 60, 300):
        text = " ".join(rng.choice(["A", "bb", "Cé", "d,"]) for _ in range(n))
        assert S.fingerprint(text) == plain_fingerprint(text)
    for n in (258, 65_283, 65_540, 131_000):  # around the parts in which votes are summed
        long = " ".join(rng.choice(["A", "bb", "Cé", "d,", "e"]) for _ in range(n))
        assert S.fingerprint(long) == plain_fingerprint(long)


@pytest.mark.parametrize("agreeing", [3, 4])
def test_keys_cover_every_difference(agreeing):
    """Whichever segments 4 differing bits fall in, some start's chain holds and one of its keys agrees."""
    places = S.key_places(agreeing)
    for per in product(range(5), repeat=8):
        if sum(per) > 4:
            continue
        ok = False
        for s in range(8):
            ring = [per[(s + i) % 8] for i in range(8)]
            if all(sum(ring[:n]) <= n // 2 for n in range(1, 9)) and any(all(ring[i] == 0 for i in p) for p in places):
                ok = True
        assert ok, per


def test_components_of_documents(docs_of, odd_rows):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghijklmnop") * 3 + str(rng.randrange(50)) for _ in range(200)) for _ in range(6)]
    rows = list(odd_rows)
    for i in range(150):
        words = base[i % 6].split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(200)] = f"w{i}"
        rows.append((100 + i, " ".join(words)))
    out = S.near_components(docs_of(rows)).collect()
    prints = [plain_fingerprint(t) for _, t in rows]
    want = sorted(zip([i for i, _ in rows], [f"{p:016x}" for p in prints], classes([i for i, _ in rows], prints), strict=True), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in out), key=str) == want


def test_dense_bucket_is_cut_into_chunks(spark):
    rng = random.Random(1)
    prints = {0} | {sum(1 << rng.randrange(64) for _ in range(rng.randrange(1, 9))) & (2**63 - 1) for _ in range(800)}
    prints = sorted(prints)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    want = dict(zip(prints, classes(prints, prints), strict=True))
    for chunk in (8, 2048):
        got = {r.node: r.root for r in connected_components(S.links(df, 3, chunk)).collect()}
        assert {p: got.get(p, p) for p in prints} == want


def test_empty_table(docs_of):
    assert S.near_components(docs_of([(1, "a")]).where("doc_id < 0")).collect() == []


def test_drop_near_copies(docs_of, odd_rows):
    out = S.drop_near_copies(docs_of([r for r in odd_rows if r[0] is not None]))
    assert out.columns == docs_of(odd_rows).columns
    assert 1 in {r.doc_id for r in out.collect()} and 2 not in {r.doc_id for r in out.collect()}


def test_clashing_names(spark):
    rows = [(1, "a b c d e f", 1, 2, 3, 4), (2, "a b c d e f", 5, 6, 7, 8), (3, "other words are here now", 9, 9, 9, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, of_id long, OF_ID_1 long, row long, __id long")
    from slidemill.llm.exact_dedup import drop_copies

    for out in (S.drop_near_copies(docs), drop_copies(docs.unionByName(docs))):
        assert out.columns == docs.columns and sorted(tuple(r) for r in out.collect()) == [rows[0], rows[2]]
