import hashlib
import re

from slidemill.llm import exact_dedup as X


def brute(rows):
    """For each digest: size and the doc_id that stays."""
    groups = {}
    for i, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        groups.setdefault(hashlib.sha256(norm.encode()).hexdigest(), []).append((-len(t or ""), i is None, i if i is not None else 0, i))
    return {d: (len(g), min(g)[3]) for d, g in groups.items()}


def hold(rows, out):
    want = brute(rows)
    assert len(out) == len(rows)
    for r in out:
        assert (r.group_size, r.keep_id) == want[r.text_sha256]
    for d in want:
        assert sum(r.kept for r in out if r.text_sha256 == d) == 1
        assert next(r.doc_id for r in out if r.text_sha256 == d and r.kept) == want[d][1]


def test_odd_rows(docs_of, odd_rows):
    hold(odd_rows, X.exact_dedup(docs_of(odd_rows)).collect())


def test_hot_digest_is_settled_by_broadcast(docs_of):
    rows = [(i, "hot  text" if i % 3 == 0 else f"text {i // 2}") for i in range(3000)]
    hold(rows, X.exact_dedup(docs_of(rows), counters=8).collect())


def test_empty_table(docs_of, spark):
    assert X.exact_dedup(docs_of([(1, "a")]).where("doc_id < 0")).collect() == []


def test_summary_bound():
    summary, total = {}, 0
    true = {}
    for step in range(200):
        counts = {"hot": 30} | {f"k{step}-{j}": 1 for j in range(50)}
        total += sum(counts.values())
        for k, n in counts.items():
            true[k] = true.get(k, 0) + n
        summary = X.merge_summaries(summary, counts, 16)
        assert len(summary) <= 16
    assert all(true[k] - total / 17 <= n <= true[k] for k, n in summary.items()) and "hot" in summary


def test_drop_copies(docs_of, odd_rows):
    out = X.drop_copies(docs_of(odd_rows))
    assert out.columns == docs_of(odd_rows).columns
    kept = {(r.doc_id, r.text) for r in out.collect()}
    assert out.count() == len(kept) == 7
    assert (4, "a") in kept and (5, "A b") in kept and (7, "zz yy xx ww vv") in kept and (3, " \t\n") in kept
