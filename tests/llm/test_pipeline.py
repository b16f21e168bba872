import re
import zlib

import numpy as np

import corpus_pipeline as C
from slidemill.llm import packing, tokens, toxicity
from slidemill.llm.components import local_components
from test_simhash import plain_fingerprint
from test_toxicity import corpus


def test_against_brute_force(spark, docs_of, tmp_path):
    rows, labels = corpus(300, 7)
    clean = next(t for (i, t), (_, _, y) in zip(rows, labels, strict=True) if not y)
    passage = " ".join(f"word{k}" for k in range(60))
    rows += [(1000 + i, clean + " " * i) for i in range(5)]
    rows += [(1100 + i, f"{passage} tail{i} {'x' * i} {rows[i][1]} {rows[i + 1][1]}") for i in range(0, 40, 4)]
    rows += [(1200, None), (1201, ""), (1202, "lone " * 3000)]
    docs_of(rows).drop("kept", "digest", "row").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf = f"file://{tmp_path}"

    model = toxicity.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    left = [(i, t) for i, t in rows if model.score(t or "") < 0.5]
    assert len(left) < len(rows)
    groups = {}
    for i, t in left:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i, t))
    left = sorted((i, t) for g in groups.values() for _, i, t in [min(g, key=lambda x: x[:2])])
    prints = np.array([plain_fingerprint(t) for _, t in left], np.uint64)
    a, b = np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4)
    root = local_components(len(left), a, b)
    left = [x for k, x in enumerate(left) if root[k] == k]
    seen, texts = set(), {}
    for i, t in left:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - 99):
            w = data[s : s + 100]
            if w in seen:
                gone[s : s + 100] = True
            seen.add(w)
        texts[i] = bytes(x for x, g in zip(data, gone, strict=True) if not g).decode()
    assert any(texts[i] != (t or "") for i, t in left)
    library = tokens.byte_level(tokens.public_path("byte_bpe_50k.json")).library
    want = []
    for i, t in texts.items():
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        want += [(i, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), 1024))]

    out = C.run(spark, sf).collect()
    assert sorted(tuple(r)[:5] for r in out) == sorted(want)
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in by.values():
        assert all(o == sum(n for _, n in sorted(found)[:k]) for k, (o, _) in enumerate(sorted(found))) and sum(n for _, n in found) <= 1024


def test_stages_keep_columns_and_empty_tables(spark, docs_of, tmp_path):
    docs_of([(1, "a")]).where("doc_id < 0").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.collect() == []
    assert C.run(spark, str(tmp_path)).collect() == []
