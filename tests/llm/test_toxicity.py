import random
import zlib

import numpy as np

from slidemill.llm import toxicity as X

CLEAN = "the of and to in river mountain garden walk paint quiet morning letter window paper green light".split()
RUDE = "zarg blint grumfel snorb".split()


def corpus(n, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(CLEAN) for _ in range(30)]
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(4):
                words[rng.randrange(30)] = rng.choice(RUDE)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return rows, labels


def test_held_out_accuracy(docs_of, spark, odd_rows):
    rows, labels = corpus(900)
    odd = [(None if i is None else 5000 + i, t) for i, t in odd_rows]
    frame = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    docs = docs_of(rows + odd)
    out = X.score(docs, X.train(docs, frame)).collect()
    assert len(out) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    truth = {i: t for i, _, t in labels}
    held = [r for r in out if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and all(r.held_out for r in held) and not any(r.held_out for r in out if r.doc_id in truth and r not in held)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.98
    assert not any(r.predicted for r in out if r.doc_id is None or r.doc_id >= 5000)
    kept = X.drop_toxic(docs, frame)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in out if not r.predicted}


def test_held_out_labels_are_not_read(docs_of, spark):
    rows, labels = corpus(600)
    held = [x for x in labels if zlib.crc32(str(x[0]).encode()) % 5 == 0]
    docs = docs_of(rows)
    frames = [[x for x in labels if x not in held] + [(i, q, t if k else 1 - t) for i, q, t in held] for k in (0, 1)]
    models = [X.train(docs, spark.createDataFrame(f, "doc_id long, quality int, toxic int")) for f in frames]
    assert models[0].words == models[1].words and models[0].bias == models[1].bias


def test_without_labels(docs_of, spark):
    docs = docs_of([(1, "you are an idiot and a moron"), (2, "a quiet morning"), (3, None)])
    out = {r.doc_id: r.predicted for r in X.score(docs, X.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).collect()}
    assert out == {1: 1, 2: 0, 3: 0}
    assert X.drop_toxic(docs.where("doc_id < 0"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(4)
    truth = rng.random(4000) < 0.4
    right = [0.95, 0.9, 0.8, 0.6, 0.6]
    votes = np.stack([np.where(rng.random(4000) < a, truth, ~truth) for a in right], axis=1).astype(np.int8)
    votes = np.concatenate([votes, votes[:, 4:], votes[:, 4:]], axis=1)  # a weak voter, three times
    votes[rng.random(votes.shape) < 0.2] = -1
    votes[:, 5] = votes[:, 6] = votes[:, 4]
    post, found = X.label_model(votes, (votes == 1).sum(1) / np.maximum(1, (votes >= 0).sum(1)), 0.4)
    # No worse than the posterior under the true accuracies, save for chance.
    weigh = np.log(np.array(right) / (1 - np.array(right)))
    best = np.log(0.4 / 0.6) + (np.where(votes[:, :5] < 0, 0, 2 * votes[:, :5].astype(int) - 1) * weigh).sum(axis=1)
    assert ((post > 0.5) == truth).mean() > ((best > 0) == truth).mean() - 0.005
    assert np.abs(found["accuracy"][:4] - right[:4]).max() < 0.06
    assert (found["weight"][4:] < 0.5).all() and (found["weight"][:4] == 1).all()


def test_bias_follows_the_mix_of_all_labelled_rows(spark):
    rows = [(i, int(i % 10 == 0)) for i in range(2000)]
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % X.FOLDS]
    labels = spark.createDataFrame(rows, "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, f"word{i % 7} plain text") for i, _ in rows], "doc_id long, text string")
    toxic = sum(train)
    assert abs(X.mix_shift(labels, 50) - np.log((toxic / 50) / ((len(train) - toxic) / 50))) < 1e-9
    assert X.mix_shift(labels) == 0
    # The texts say nothing, so scores are near the share of toxic rows, also from a sample of 50:50.
    assert X.train(docs, labels, 50).score("word1 plain text") < 0.3


def test_label_model_against_loops():
    """The same expectation maximisation, a vote at a time, without and with a dependent voter."""
    rng = np.random.default_rng(8)
    truth = rng.random(300) < 0.3
    votes = np.where(rng.random((300, 3)) < 0.85, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.3] = -1
    votes = np.column_stack([votes, votes[:, 2]])
    start = np.where((votes == 1).sum(axis=1) >= 2, 0.9, 0.1)
    fast, found = X.label_model(votes.astype(np.int8), start, 0.3, rounds=9, learn=3)
    parent = found["parent"]
    assert [int(p) for p in parent[:2]] == [-1, -1] and {int(parent[2]), int(parent[3])} in ({-1, 2}, {-1, 3})
    post = list(start)
    for _ in range(9):
        tree = parent  # the copy has its parent from the beginning, and no other dependence is found
        table = {}
        for y in (1, 0):
            w = [p if y else 1 - p for p in post]
            for j in range(4):
                alone = {b: (sum(x for x, v in zip(w, votes) if v[j] == b) + 0.1) / (sum(w) + 0.3) for b in (-1, 0, 1)}
                for a in (-1, 0, 1):
                    group = [(x, v) for x, v in zip(w, votes) if tree[j] >= 0 and v[tree[j]] == a]
                    for b in (-1, 0, 1):
                        both = sum(x for x, v in group if v[j] == b)
                        table[y, j, a, b] = (both + 5 * alone[b]) / (sum(x for x, _ in group) + 5) if tree[j] >= 0 else alone[b]
        new = []
        for v in votes:
            p1, p0 = 0.3, 0.7
            for j in range(4):
                a = v[tree[j]] if tree[j] >= 0 else -1
                p1, p0 = p1 * table[1, j, a, v[j]], p0 * table[0, j, a, v[j]]
            new.append(p1 / (p1 + p0))
        post = new
    assert np.abs(np.array(post) - fast).max() < 1e-3


def test_scores_against_sums(docs_of, spark):
    """Each score is the logistic of bias and weights of what the text holds, whole texts and repeated rows too."""
    rows, labels = corpus(300)
    rows += [(7, rows[7][1]), (7, "zarg " * 3), (9001, "the river " * 100_000 + "zarg blint snorb"), (9002, "")]
    docs = docs_of(rows)
    model = X.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = sorted((r.doc_id, round(r.score, 9)) for r in X.score(docs, model).collect())
    want = []
    for i, t in rows:
        words = X.WORD.findall(t.lower())
        stems = [w[:5] for w in words if len(w) > 5]
        held = {*words, *("^" + x for x in stems), *("^^" + x for x in stems if stems.count(x) > 1)} if len(words) < 1000 else {"the", "river", "zarg", "blint", "snorb"}
        logit = model.bias + sum(model.words.get(w, 0) for w in held) + sum(x for x, p in zip(model.patterns, X.PATTERNS) if p(t, held))
        want.append((i, round(1 / (1 + np.exp(-logit)), 9)))
    assert got == sorted(want)
    assert dict(got)[9001] > dict(got)[9002]


def test_given_labels_do_not_vote():
    """Two texts alike but for their label have one posterior, and so the classifier one score."""
    rng = random.Random(3)
    texts = [[*rng.sample(CLEAN, 6), *(rng.sample(RUDE, 2) if i % 3 == 0 else [])] for i in range(600)]
    right = [(sorted(t), [False] * 3, int(i % 3 == 0)) for i, t in enumerate(texts)]
    wrong = [(w, p, 1 if i % 40 == 1 else t) for i, (w, p, t) in enumerate(right)]
    model = X.fit(wrong)
    scores = [model.score(" ".join(t)) for t in texts]
    assert [x >= 0.5 for x in scores] == [t == 1 for *_, t in right]
    assert max(x for x, (*_, t) in zip(scores, right, strict=True) if not t) < 0.2


def test_one_doc_id_of_many_rows(docs_of, spark):
    rows, labels = corpus(200)
    docs = docs_of(rows + [(1, f"the garden {i}") for i in range(500)])
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = X.score(docs, X.train(docs, frame, 40)).collect()
    assert len(out) == 700 and not any(r.predicted for r in out if r.doc_id == 1)
