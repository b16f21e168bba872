import random
from collections import Counter
from math import log10

import numpy as np
import pytest

from slidemill.llm import brown as B


def words(t):
    return (t or "").encode().lower().split()


def corpus(n=400, seed=1):
    """Texts of nouns and verbs in turn, so that classes tell much about the next word."""
    rng = random.Random(seed)
    nouns, verbs = [f"n{i}x" for i in range(80)], [f"v{i}y" for i in range(80)]
    return [(i, " ".join(rng.choice(nouns if k % 2 else verbs) for k in range(20))) for i in range(n)]


@pytest.mark.parametrize("chunk", [50, B.CHUNK])
def test_base_score(docs_of, odd_rows, chunk):
    rows = [*odd_rows, *corpus(60)]
    c = Counter(w for i, t in rows if not B.held_out(i) for w in [*words(t), None])
    total, distinct = sum(c.values()), len(c)
    want = []
    for i, t in rows:
        own = [*words(t), None]
        want.append((i, B.held_out(i), len(own), sum(c[w] > 0 for w in own), total, round(sum(log10((c[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in own), 6)))
    out = B.brown_scores(docs_of(rows), chunk, classes=8).collect()
    got = [(*tuple(r)[:5], round(r.base_score, 6)) for r in out]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_classes_beat_the_base_on_held_out_texts(docs_of):
    out = B.brown_scores(docs_of(corpus()), classes=6).collect()
    held = [r for r in out if r.held_out]
    assert len(held) > 20 and sum(r.score for r in held) > sum(r.base_score for r in held) + 0.2 * sum(r.n_tokens for r in held)


def test_chunks_do_not_matter(docs_of):
    a, b = ({r.doc_id: round(r.score, 8) for r in B.brown_scores(docs_of(corpus(80)), n, classes=6).collect()} for n in (60, B.CHUNK))
    assert a == b


def objective(pairs, of):
    k = of.max() + 1
    m = np.zeros((len(of), k))
    m[np.arange(len(of)), of] = 1
    t = m.T @ pairs @ m
    f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    return f(t) - f(t.sum(0)) - f(t.sum(1))


def test_exchange_ends_where_no_move_helps():
    rng = np.random.default_rng(2)
    pairs = rng.integers(0, 30, (15, 15)).astype(float)
    of = B.exchange(pairs, 4, 50)
    assert of[-1] == 0 and (of[:-1] > 0).all()
    best = objective(pairs, of)
    for i in range(14):
        for c in range(1, 4):
            other = of.copy()
            other[i] = c
            assert objective(pairs, other) <= best + 1e-6


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(5)
    pairs = rng.integers(0, 9, (12, 12)).astype(float)
    tokens, distinct = pairs.sum(axis=0), np.array([3] * 11 + [1])
    m = B.fit(pairs, tokens, distinct, 4)
    assert np.allclose((10 ** m["step"]).sum(axis=1), 1)
    for c in range(4):
        own = m["of"] == c
        mass = tokens[own].sum() + B.ADDED * (distinct[own].sum() + 1)
        assert np.isclose(mass, 10 ** m["room"][c])


def test_no_training_and_empty_tables(docs_of):
    docs = docs_of([(None, "a b"), (None, None)])
    out = B.brown_scores(docs).collect()
    assert len(out) == 2 and all(r.n_known == 0 and r.train_tokens == 0 and np.isfinite(r.score) for r in out)
    assert B.brown_scores(docs.where("doc_id < 0")).collect() == []


def test_words_far_below_the_common_ones_get_classes_of_their_own(docs_of):
    rng = random.Random(3)
    kinds = [[f"{k}{i:05}abc" for i in range(2000)] for k in "nv"]
    rows = [(i, " ".join(rng.choice(kinds[k % 2]) for k in range(200))) for i in range(300)]
    held = [r for r in B.brown_scores(docs_of(rows), classes=6).collect() if r.held_out]
    assert len(held) > 20 and sum(r.score for r in held) > sum(r.base_score for r in held) + 0.2 * sum(r.n_tokens for r in held)


def test_weights_of_moves_are_differences_of_the_objective():
    rng = np.random.default_rng(4)
    pairs = rng.poisson(2, (12, 12)).astype(float)
    of = np.append(1 + rng.integers(0, 3, 11), 0)
    member = np.eye(4)[of]
    own = np.diag(pairs)
    bare = pairs - np.diag(own)
    gain = B._weigh(member.T @ pairs @ member, of, bare @ member, bare.T @ member, own)
    for i in range(11):
        for c in range(1, 4):
            other = of.copy()
            other[i] = c
            a, b = (B.likelihood(np.eye(4)[x].T @ pairs @ np.eye(4)[x]) for x in (other, of))
            assert np.isclose(gain[i, c] - gain[i, of[i]], a - b)


def brute_scores(rows, of, classes):
    """Scores by plain sums, from the class of each training word."""
    train = [[*words(t), None] for i, t in rows if not B.held_out(i)]
    c = Counter(w for d in train for w in d)
    size, distinct = Counter(), Counter()
    for w, n in c.items():
        size[of[w]] += n
        distinct[of[w]] += 1
    pair, before = Counter(), Counter()
    follows = {}
    for d in train:
        for v, w in zip([None, *d], d):
            pair[of[v], of[w]] += 1
            before[of[v]] += 1
            follows.setdefault(of[v], set()).add(of[w])
    total = sum(size.values())
    prior = [(size[x] + 0.1) / (total + 0.1 * classes) for x in range(classes)]

    def step(v, x):
        if v == "new" or not before[v]:
            return prior[x]
        return max(pair[v, x] - 0.75, 0) / before[v] + 0.75 * len(follows[v]) / before[v] * prior[x]

    def word(v, w):
        if w in of:
            own = 1.0 if of[w] == 0 else (c[w] + 0.1) / (size[of[w]] + 0.1 * (distinct[of[w]] + 1))
            return step(v, of[w]) * own
        return sum(step(v, x) * 0.1 / (size[x] + 0.1 * (distinct[x] + 1)) for x in range(1, classes))

    out = []
    for i, t in rows:
        v, score = 0, 0.0
        for w in [*words(t), None]:
            score += log10(word(v, w))
            v = of.get(w, "new")
        out.append((i, round(score, 6)))
    sums = [sum(word(v, w) for w in of) + word(v, object()) for v in {*of.values(), "new"}]
    return sorted(out, key=str), sums


def test_scores_against_brute_force(docs_of, odd_rows):
    import xxhash

    rng = random.Random(6)
    rows = [*odd_rows, *corpus(120), *((2000 + i, " ".join(rng.choice(["n1x", "v2y", f"rare{rng.randrange(90)}", f"once{i}"]) for _ in range(12))) for i in range(40))]
    classed, folder, model, total, distinct, ends = B.learn(docs_of(rows), 300, classes=7)
    got = classed.mapInArrow(B._score(folder, model, total, distinct, ends), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").collect()
    # The class of each training word, read off the chunks of a single document each.
    one, folder, *_ = B.learn(docs_of(rows, 1), 0, classes=7)
    numbers = B.Tokens(folder)
    of = {None: 0}
    for r in one.collect():
        flat = numbers(r.tokens)
        doc = int(B.expand(bytes(r.docs), "<i8")[0])
        for i, t in rows:
            if (i or 0) == doc and len(words(t)) == len(flat):
                own = B.expand(bytes(r.classes), "u1")
                names = sorted(set(words(t)), key=lambda w: xxhash.xxh64_intdigest(w, 5))
                if [names.index(w) for w in words(t)] == flat.tolist():
                    of |= {w: int(own[k]) for k, w in enumerate(names) if own[k] < 7}
    c = Counter(w for i, t in rows if not B.held_out(i) for w in [*words(t), None])
    assert set(of) == set(c) and any(1 < c[w] < B.FLOOR for w in of) and len(set(of.values())) > 3
    want, sums = brute_scores(rows, of, 7)
    assert np.allclose(sums, 1)
    assert sorted(((r.doc_id, round(r.score, 6)) for r in got), key=str) == want


def test_rarer_words_get_the_class_of_their_neighbours(docs_of):
    """Words seen three times each, which always stand for a noun or a verb, help in held-out texts."""
    rng = random.Random(8)
    nouns, verbs = [f"n{i}x" for i in range(40)], [f"v{i}y" for i in range(40)]
    rare = [[f"{k}rare{i}" for i in range(300)] * 4 for k in "nv"]
    for x in rare:
        rng.shuffle(x)
    rows = [(i, " ".join((rare[k % 2].pop() if k in (4, 5, 10, 11) and rare[k % 2] else rng.choice((nouns, verbs)[k % 2])) for k in range(20))) for i in range(400)]
    out = B.brown_scores(docs_of(rows), classes=6).collect()
    held = [r for r in out if r.held_out]
    assert len(held) > 20 and sum(r.score for r in held) > sum(r.base_score for r in held) + 0.2 * sum(r.n_tokens for r in held)


def test_insertion_is_a_difference_of_the_objective():
    rng = np.random.default_rng(9)
    table = rng.integers(0, 40, (5, 5)).astype(float)
    gains, sides = B.insertion_tables(table)
    word, cell, count = np.array([0, 0, 2]), np.array([3, 6, 1]), np.array([2, 3, 1])
    got = B.insertion(gains, sides, word, cell, count, 3)
    f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    for w in range(3):
        for c in range(1, 5):
            want = 0.0
            after, before = np.zeros(5), np.zeros(5)
            for d, n in zip(cell[word == w], count[word == w], strict=True):
                (after if d < 5 else before)[d % 5] += n
            want += f(table[c] + after) - f(table[c]) + f(table[:, c] + before) - f(table[:, c])
            want -= f(table[c].sum() + after.sum()) - f(table[c].sum()) + f(table[:, c].sum() + before.sum()) - f(table[:, c].sum())
            assert np.isclose(got[w, c], want)
