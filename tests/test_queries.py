"""Each query against its SQL at the smallest scale, and operators against plain forms."""

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import oracle
from slidemill.functions import bytes as B
from slidemill.operators import batch, geometry, lookup
from slidemill.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(set(registry.queries()) & set(registry.oracle_sql())))
def test_query_equals_its_sql(spark, name):
    assert oracle.spark_rows(registry.queries()[name](spark, SF)) == oracle.duck_rows(registry.oracle_sql()[name], SF)


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.queries()) <= set(__spark_entry__.queries())


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 900), st.integers(0, 700), st.integers(0, 300), st.integers(0, 300)), min_size=1, max_size=20))
def test_cells_against_all_cells(spark, rects):
    rows = [(1, 0, i, *r) for i, r in enumerate(rects)]
    df = spark.createDataFrame(rows, "slide_id long, level int, ordinal long, x long, y long, w long, h long")
    got = {(r.ordinal, r.cell_row, r.cell_col) for r in geometry.assign_cells(df, 100, 5, 4).collect()}
    want = set()
    for i, (x, y, w, h) in enumerate(rects):
        for r in range(10):
            for c in range(10):
                if c * 100 < x + max(w, 1) and x < c * 100 + 100 and r * 100 < y + max(h, 1) and y < r * 100 + 100:
                    want.add((i, min(r, 3), min(c, 4)))
    assert got == want


def test_offsets_against_accumulate(spark):
    rng = random.Random(1)
    lengths = [rng.randrange(100) for _ in range(50)]
    df = spark.createDataFrame([(0, i, n) for i, n in enumerate(lengths)], "k long, i long, length long")
    got = [r.offset for r in lookup.running_offsets(df, ["k"], ["i"], start=7).orderBy("i").collect()]
    assert got == (7 + np.cumsum([0, *lengths[:-1]])).tolist()


def test_asof_against_search(spark):
    bases, probes = sorted(random.Random(2).sample(range(1000), 30)), list(range(0, 1100, 13))
    b = spark.createDataFrame([(0, v, i) for i, v in enumerate(bases)], "k long, base long, file long")
    p = spark.createDataFrame([(0, v) for v in probes], "k long, at long")
    got = {r.at: r.file for r in lookup.asof(p, b, ["k"], "at", "base").collect()}
    assert got == {v: (int(np.searchsorted(bases, v, "right")) - 1 if v >= bases[0] else None) for v in probes}


def test_cascading_names(spark):
    names = ["sample", "sample", "sample_2", "Sample", "other", "sample_2"]
    df = spark.createDataFrame([(i, f"/o/{n}.svs") for i, n in enumerate(names)], "i long, output string")
    got = [r.unique for r in batch.reserved_outputs(df, "output", "i").orderBy("ord").collect()]
    assert got == [f"/o/{n}.svs" for n in ("sample", "sample_2", "sample_2_2", "Sample_3", "other", "sample_2_3")]


def test_fits_does_not_overflow(spark):
    big = 2**63 - 1
    df = spark.createDataFrame([(1, big, 10), (big, 1, 10), (5, 5, 10), (5, 6, 10), (0, 5, 10), (5, 0, 10)], "o long, n long, s long")
    assert [r.f for r in df.select(lookup.fits(F.col("o"), F.col("n"), F.col("s")).alias("f")).collect()] == [False, False, True, False, False, False]


def test_find_all_and_first(spark):
    df = spark.createDataFrame([(bytearray(b"aaXaa"),), (bytearray("éaa".encode()),), (None,)], "b binary")
    out = df.select(B.find_all(F.col("b"), b"aa").alias("a"), B.find_first(F.col("b"), b"aa").alias("f")).collect()
    assert [(r.a, r.f) for r in out] == [([0, 3], 0), ([2], 2), ([], None)]


def test_plans_keep_scans_narrow_and_avoid_nested_loops(spark):
    for name in ("cell_assign", "asof_source", "last_wins", "tile_offsets"):
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "l_returnflag" not in plan


def test_tile_scan_all_has_every_cell_of_every_level(spark):
    from slidemill.plans import relations

    levels = relations.levels(spark, SF).orderBy("slide_id", "level").limit(30).collect()
    got = registry.queries()["tile_scan_all"](spark, SF).where(F.col("slide_id").isin(*{r.slide_id for r in levels})).collect()
    want = [(l.slide_id, l.level, r * l.cols + c, round(c * 256.0 * 2.0**l.level * 0.7), round(r * 256.0 * 2.0**l.level * 0.7)) for l in levels for r in range(l.rows) for c in range(l.cols)]
    kept = {(r.slide_id, r.level) for r in levels}
    assert {r.level for r in levels} >= {0, 1, 2}
    assert sorted(tuple(r) for r in got if (r.slide_id, r.level) in kept) == sorted(want)


def test_splice_bytes_all_has_every_tile(spark):
    from slidemill.plans import relations

    tiles = relations.tiles(spark, SF).collect()
    want = [(t.slide_id, t.level, t.ordinal, (b"\xff\xd8\xff\xc0\x00\x11\x08" + t.h.to_bytes(2, "big") + t.w.to_bytes(2, "big") + str(t.length).encode() + b"\xff\xd9").hex().upper(), True) for t in tiles]
    assert len({t.level for t in tiles}) > 1
    assert sorted(tuple(r) for r in registry.queries()["splice_bytes_all"](spark, SF).collect()) == sorted(want)
