"""Toxicity by weak supervision.

Many simple voters (insult words of a fixed lexicon, words and word beginnings that labelled rows
show to be telling, patterns) vote toxic or nothing on a text. A generative model of the votes given
the hidden label is fitted by expectation maximisation, from the lexicon's own vote: each voter's
accuracy and coverage, and a tree of the voters that depend on each other given the label, in which
a voter's table is conditional on its parent's vote. Its posterior labels, not the given ones, train
a linear classifier, which scores whole texts.

Labelled rows serve to choose voters and for the share of toxic rows; only those whose
crc32(doc_id as text) mod 5 is not 0 are used, of them at most ``SAMPLE`` of either label (the
first by a hash of doc_id); the classifier's bias is then shifted to the mix of all of them. Without
rows of both labels the voters are the lexicon and the patterns, the texts those of the first
2 * ``SAMPLE`` doc_ids by hash, and the share is ``PRIOR``. Nothing but the text is an input of a score.

Defined results: a null text counts as empty and gets the score of a text without evidence; a null
doc_id is held out; several labels of one doc_id count as toxic if one is; null labels are ignored;
of rows that share a doc_id one text (the first in their order) is learnt from, and each is scored.
An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidemill.session import ship_package

#: Labelled rows of either label that the model is fitted on.
SAMPLE = 4000
FOLDS = 5
#: Texts that are taken out of an Arrow batch at once.
TOGETHER = 128
#: Words found telling, and words the classifier looks at, at most.
TELLING, VOCABULARY = 300, 600
#: Common English insults.
LEXICON = "idiot idiots moron morons stupid loser losers scum trash garbage pathetic worthless disgusting clown imbecile dumb fool vermin pig filth filthy creep freak bastard bitch asshole shit fuck fucking damn cunt whore slut retard hate kill die".split()
WORD = re.compile(r"[^\W\d_]+")
#: Share of toxic texts where no labels tell it.
PRIOR = 0.1
#: Belief before the data: how often a voter votes on toxic and on other texts, and the texts that this counts for.
VOTES_TOXIC, VOTES_CLEAN, BELIEF = 0.05, 0.002, 100.0
#: Twice the evidence (in nats) from which two voters count as dependent given the label.
SURE = 45.0
#: Share of a voter's information from which another that holds it counts as much the same.
ALIKE = 0.9
#: Letters of a word's beginning that count as a feature of its own, for words longer than that.
STEM = 5
SHOUT = re.compile(r"[^\W\d_]{3,}!{2,}")
INSULT = re.compile(r"\b(?:you|they|he|she|it)(?:'re| are| is)? (?:such )?an? ([^\W\d_]+)")

def words_of(text: str) -> set[str]:
    """The distinct words of a text in lower case; after a ``^`` the beginnings of longer ones, and
    after ``^^`` those that begin two or more words."""
    words = WORD.findall(text.lower())
    stems = [w[:STEM] for w in words if len(w) > STEM]
    found, once = set(words), set(stems)
    if len(once) < len(stems):
        left = Counter(stems)
        found.update("^^" + x for x, n in left.items() if n > 1)
    found.update("^" + x for x in once)
    return found


PATTERNS = (
    lambda text, words: len(SHOUT.findall(text)) >= 3,
    lambda text, words: bool(INSULT.search(text.lower())),
    lambda text, words: sum(c in "?!" for c in text) * 20 > len(text) > 0,
)


def sample_labels(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id and toxic of at most ``sample`` training rows of either label."""
    key = F.col("doc_id").cast("string").cast("binary")
    rows = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(F.crc32(key) % FOLDS != 0)
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = F.xxhash64("doc_id")
    return rows.where("toxic > 0").orderBy(order, "doc_id").limit(sample).unionByName(rows.where("toxic <= 0").orderBy(order, "doc_id").limit(sample))


def mix_shift(labels: DataFrame, sample: int = SAMPLE) -> float:
    """What the sample's log odds of toxic lack to those of all labelled training rows."""
    key = F.col("doc_id").cast("string").cast("binary")
    rows = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(F.crc32(key) % FOLDS != 0)
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = rows.agg(F.count(F.when(F.col("toxic") > 0, 1)).alias("toxic"), F.count(F.when(F.col("toxic") <= 0, 1)).alias("clean")).first()
    over = lambda x: np.log(max(1.0, x / sample))
    return float(over(n["toxic"]) - over(n["clean"]))


def _features(batches):
    """The words of each text, joined by spaces, and what its patterns say."""
    for batch in batches:
        words, patterns = [], []
        for t in (t for at in range(0, batch.num_rows, TOGETHER) for t in batch.column(1).slice(at, TOGETHER).to_pylist()):
            found = words_of(t or "")
            words.append(" ".join(sorted(found)))
            patterns.append([bool(p(t or "", found)) for p in PATTERNS])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(words, pa.string()), pa.array(patterns, pa.list_(pa.bool_()))], names=["doc_id", "toxic", "words", "patterns"])


def dependence(is_: list[np.ndarray], post: np.ndarray) -> np.ndarray:
    """Mutual information of each two voters' votes given the label, 0 where it may be chance."""
    n, m = is_[0].shape
    found = np.zeros((m, m))
    for w in (post, 1 - post):
        total = w.sum() + 1e-9
        alone = [(w @ x + 1e-9) / total for x in is_]
        for a, x in enumerate(is_):
            left = (x * w[:, None]).T
            for b, y in enumerate(is_):
                both = left @ y / total
                found += total / n * both * np.log((both + 1e-12) / (alone[a][:, None] * alone[b][None, :] + 1e-12))
    np.fill_diagonal(found, 0)
    return np.where(2 * n * found > SURE, found, 0)


def shares(is_: list[np.ndarray], strength: np.ndarray, post: np.ndarray) -> np.ndarray:
    """The dependences as a share of what the less telling of the two votes holds."""
    entropy = np.zeros(len(strength))
    for w in (post, 1 - post):
        spread = [(w @ x + 1e-9) / (w.sum() + 1e-9) for x in is_]
        entropy -= w.mean() * sum(p * np.log(p) for p in spread)
    return strength / (np.minimum(entropy[:, None], entropy[None, :]) + 1e-9)


def parents(strength: np.ndarray) -> np.ndarray:
    """The parent of each voter, -1 for none, in the strongest spanning forest of the dependences."""
    m = len(strength)
    parent, best, open_ = np.full(m, -1), np.zeros(m), np.ones(m, bool)
    for _ in range(m):
        j = int(np.argmax(np.where(open_, best, -1)))
        open_[j] = False
        if best[j] <= 0:
            parent[j] = -1
        closer = open_ & (strength[j] > best)
        best[closer], parent[closer] = strength[j][closer], j
    return parent


def label_model(votes: np.ndarray, start: np.ndarray, prior: float, rounds: int = 50, learn: int = 5, belief: float = 0.0) -> tuple[np.ndarray, dict]:
    """Posterior of label 1 for each row of votes (1, 0, or -1 for none), by expectation maximisation.

    P(votes | label) is a product over the voters: of P(vote | label), and from round ``learn`` on of
    P(vote | label, the parent's vote) for those with a parent; voters that say much the same whatever
    the label have a parent from the beginning. ``start`` are first posteriors;
    ``belief`` is the number of texts that VOTES_TOXIC and VOTES_CLEAN stand for beside the given ones. Also
    gives each voter's accuracy, parent, and weight: one over the number of voters that it stands for,
    itself and those that depend on it by the share of its information that they hold.
    """
    n, m = votes.shape
    value = votes.astype(np.int64) + 1
    is_ = [(value == k).astype(float) for k in range(3)]
    post, weight, each = start.astype(float), np.ones(m), np.arange(m)
    alike = dependence(is_, np.ones(n))
    alike = np.where(shares(is_, alike, np.ones(n)) > ALIKE, alike, 0)
    parent = parents(alike)
    for step in range(rounds):
        if step == learn:
            strength = np.maximum(alike, dependence(is_, post))
            parent = parents(strength)
            weight = 1 / (1 + shares(is_, strength, post).sum(axis=1))
        code = np.where(parent >= 0, value[:, parent], 0) * 3 + value
        ratio = np.zeros((9, m))
        for sign, w, often in ((1, post, VOTES_TOXIC), (-1, 1 - post, VOTES_CLEAN)):
            alone = np.array([(w @ x + 0.1 + belief * b) / (w.sum() + 0.3 + belief) for x, b in zip(is_, (1 - often, 0, often), strict=True)])
            joint = np.array([w @ (code == k) for k in range(9)]).reshape(3, 3, m)
            table = (joint + 5 * alone) / (joint.sum(axis=1, keepdims=True) + 5)
            ratio += sign * np.log(np.where(parent >= 0, table, alone[None])).reshape(9, m)
        logit = np.log(prior / (1 - prior)) + ratio[code, each].sum(axis=1)
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - post).max() < 1e-4 and step > learn:
            post = new
            break
        post = new
    seen = is_[1] + is_[2]
    accuracy = (post @ is_[2] + (1 - post) @ is_[1] + 0.5) / (seen.sum(axis=0) + 1)
    return post, {"accuracy": accuracy, "weight": weight, "parent": parent}


def logistic(rows: np.ndarray, columns: np.ndarray, shape: tuple[int, int], target: np.ndarray, ridge: float = 0.3, steps: int = 300, center: np.ndarray | float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on binary features, given as (row, column) places;
    the ridge pulls the weights towards ``center``."""
    n, m = shape
    w, b = np.zeros(m) + center, 0.0
    # Nesterov's method, each weight with a step by the curvature that its column can have.
    size = np.bincount(rows, minlength=n) + 1.0
    step = 1 / (0.25 * np.bincount(columns, size[rows], m) + ridge)
    step_b = 1 / (0.25 * size.sum())
    w_old, b_old = w, b
    for k in range(1, steps + 1):
        push = (k - 1) / (k + 2)
        slope, at = w + push * (w - w_old), b + push * (b - b_old)
        gap = 1 / (1 + np.exp(-np.clip(at + np.bincount(rows, slope[columns], n), -30, 30))) - target
        w_old, b_old = w, b
        w, b = slope - step * (np.bincount(columns, gap[rows], m) + ridge * (slope - center)), at - step_b * gap.sum()
    return w, b


class Model:
    """Words with weights, pattern weights, and bias."""

    def __init__(self, words: dict[str, float], patterns: list[float], bias: float):
        self.words, self.patterns, self.bias = words, patterns, bias

    def score(self, text: str) -> float:
        get = self.words.get
        found = words_of(text)
        logit = self.bias + sum(get(w, 0.0) for w in found) + sum(x for x, p in zip(self.patterns, PATTERNS, strict=True) if x and p(text, found))
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, logit)))))


def fit(examples: Iterable[tuple[list[str], list[bool], int | None]]) -> Model:
    """Voters, label model and classifier from (words, patterns, toxic or None) of texts."""
    weight = float(np.log(VOTES_TOXIC / VOTES_CLEAN))
    number: dict[str, int] = {}
    held, patterns, toxic = [], [], []
    for words, own, t in examples:  # each distinct word is held once, texts as numbers
        held.append(np.array([number.setdefault(w, len(number)) for w in words], np.int32))
        patterns.append(own)
        toxic.append(t)
    if not held:
        return Model(dict.fromkeys(LEXICON, weight), [0.0] * len(PATTERNS), float(np.log(PRIOR / (1 - PRIOR))))
    for w in LEXICON:
        number.setdefault(w, len(number))
    names, n = list(number), len(held)
    row, word = np.repeat(np.arange(n, dtype=np.int32), [len(x) for x in held]), np.concatenate(held)
    del held
    patterns = np.array(patterns, bool).reshape(n, len(PATTERNS))
    known = np.array([t is not None for t in toxic])
    label = np.array([(t or 0) > 0 for t in toxic])
    often = np.bincount(word, minlength=len(names))
    n1 = int(label.sum())
    n0 = int(known.sum()) - n1
    told, voters = n1 > 0 and n0 > 0, [number[w] for w in LEXICON]
    if told:
        b = np.bincount(word, label[row], len(names))
        odds = np.where(often >= 5, np.log((b + 0.5) / (n1 + 1)) - np.log((often - b + 0.5) / (n0 + 1)), 0)
        telling = sorted(np.flatnonzero(odds > 3).tolist(), key=lambda i: (-odds[i] * b[i], names[i]))[:TELLING]
        voters = list(dict.fromkeys([i for i in voters if often[i] >= 5] + telling))
    m = len(voters)
    at = np.full(len(names), -1)
    at[voters] = np.arange(m)
    mine = at[word] >= 0
    votes = np.full((n, m + len(PATTERNS)), -1, np.int8)
    votes[row[mine], at[word[mine]]] = 1
    votes[:, m:] = np.where(patterns, 1, -1)
    start = np.where((votes[:, :m] == 1).any(axis=1), 0.95, 0.02)
    posterior, _ = label_model(votes, start, n1 / (n1 + n0) if told else PRIOR, belief=BELIEF)
    # The classifier's words: those whose counts differ most between the posterior labels.
    mass, whole = np.bincount(word, posterior[row], len(names)), posterior.sum()
    gap = np.where(often >= 5, np.abs(np.log((mass + 0.5) / (whole + 1)) - np.log((often - mass + 0.5) / (n - whole + 1))) * often, 0)
    seen = sorted(np.flatnonzero(gap > 0).tolist(), key=lambda i: (-gap[i], names[i]))[:VOCABULARY]
    chosen = list(dict.fromkeys(voters + [number[w] for w in LEXICON] + seen))
    at[:] = -1
    at[chosen] = np.arange(len(chosen))
    mine = at[word] >= 0
    marked, kind = np.nonzero(patterns)
    rows, columns = np.concatenate([row[mine], marked]), np.concatenate([at[word[mine]], len(chosen) + kind])
    center = np.array([weight if names[i] in LEXICON else 0.0 for i in chosen] + [0.0] * len(PATTERNS))
    w, b = logistic(rows, columns, (n, len(center)), posterior, center=center)
    return Model({names[i]: float(x) for i, x in zip(chosen, w, strict=False) if abs(x) > 1e-3}, [float(x) for x in w[len(chosen) :]], float(b))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits the model; the driver gets the distinct words of at most 2 * ``sample`` texts."""
    ship_package(docs.sparkSession)
    wanted = sample_labels(labels, sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    if wanted.select("toxic").distinct().count() < 2:
        wanted = texts.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample).withColumn("toxic", F.lit(None).cast("int"))
    own = texts.join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    found = own.select("doc_id", "text", "toxic").mapInArrow(_features, "doc_id long, toxic int, words string, patterns array<boolean>")
    model = fit((r.words.split(), list(r.patterns), r.toxic) for r in found.orderBy("doc_id").toLocalIterator())
    model.bias += mix_shift(labels, sample)
    return model


def _some(batches, rows: int = TOGETHER):
    """Arrow batches a few rows at a time, so that few texts are Python strings at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _scores(model: Model):
    def run(batches):
        for part in _some(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([model.score(t or "") for t in part.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(True))
    return rows.mapInArrow(_scores(model), "doc_id long, score double").select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that aren't predicted toxic, with all their columns, in one pass.

    Only texts go to Python, and only a verdict comes back."""
    model = train(docs, labels, sample)

    @F.arrow_udf("boolean")
    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([model.score(t or "") < 0.5 for at in range(0, len(batch), TOGETHER) for t in batch.slice(at, TOGETHER).to_pylist()], pa.bool_())

    return docs.where(clean(F.col("text").cast("string")))
