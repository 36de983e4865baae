"""Hard negatives against all comparisons."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.llm import negatives, queries
from tilewright.llm.negatives import Index

SF = "/root/testdata/sf0.001"


def brute(rows, anchor):
    fine = {}
    for i, v, y in rows:
        if i is not None and y is not None and v is not None and all(c is not None and math.isfinite(c) for c in v):
            if i not in fine or y < fine[i][1]:
                fine[i] = ([math.floor(256 * c) for c in v], y)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (va, ya) in fine.items():
        if not anchor(a):
            continue
        s = {b: dot(va, vb) for b, (vb, _) in fine.items()}
        first = sorted((b for b in fine if b != a and fine[b][1] == ya), key=lambda b: (-s[b], b))[:5]
        for p in first:
            hard = sorted((b for b in fine if fine[b][1] != ya and 80 * s[p] <= 100 * s[b] <= 100 * s[p]), key=lambda b: (-s[b], b))[:5]
            out += [(a, p, r + 1, b, s[p], s[b]) for r, b in enumerate(hard)]
    return sorted(out)


@pytest.mark.parametrize("low", [-50_000, 0, 8_000, 30_000])
def test_index_finds_all_matches(low):
    rng = np.random.default_rng(3)
    for d in (1, 7, 8, 30):
        x = np.floor(256 * rng.normal(0, 1 / np.arange(1, d + 1), (300, d))).astype(np.int64)
        q = np.floor(256 * rng.normal(0, 1 / np.arange(1, d + 1), (20, d))).astype(np.int64)
        order, s = np.argsort(-np.abs(x).sum(0)), q @ x.T
        floor = low + rng.integers(0, 500, 20)
        index = Index(x, order, float(np.sqrt((q.astype(float) ** 2).sum(1).max())), float(floor.min()))
        i, j, got = index.matches(q, order, floor)
        assert sorted(zip(i.tolist(), j.tolist(), got.tolist())) == sorted((a, b, int(s[a, b])) for a, b in zip(*np.nonzero(s >= floor[:, None])))
        if d == 30 and low == 30_000:
            assert sum(index.posted) < len(x) * len(index.posted)  # dimensions were left out


def test_scores_beyond_doubles():
    x = np.array([[1 << 30, 1 << 30], [1 << 30, (1 << 30) + 1]], np.int64)
    order = np.array([0, 1])
    i, j, s = Index(x, order, 2.0**31, 0.0).matches(x, order, np.array([0, 0]))
    assert sorted(s.tolist()) == sorted((x @ x.T).ravel().tolist())


def test_edges_and_ties(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(c) for c in np.round(rng.normal(size=6), 1)], int(i % 3)) for i in range(120)]
    rows += [(i, [1.0, 0.5, 0.0, 0.0, 0.0, 0.25], i % 4) for i in range(120, 220)]  # a hot vector
    rows += [(300, None, 1), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (302, [float("nan")] * 6, 1), (303, [float("inf")] + [0.0] * 5, 2), (304, [], 1), (305, [2.0, 1.0], 0), (306, [0.0] * 6, None)]
    rows += [(None, [1.0] * 6, 1), (10, [1.0] * 6, 2), (10, [1.0] * 6, 2)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, id string, chunk int")
    want = brute(rows, lambda i: i % 10 == 0)
    for chunk, block in ((None, 1 << 14), (37, 5)):
        got = negatives.mine(df, F.col("vec_id") % 10 == 0, chunk=chunk, block=block)
        assert sorted(map(tuple, got.collect())) == want
    assert len(want) > 100
    assert negatives.mine(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert negatives.mine(df, F.lit(False)).count() == 0


def test_thresholds_sink(spark):
    """Many rows to a task, so that samples set the first thresholds, and windows that stay unfilled."""
    rng = np.random.default_rng(9)
    rows = [(i, [float(c) for c in rng.normal(size=16)], int(rng.integers(0, 40))) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 300 == 0).collect())) == brute(rows, lambda i: i % 300 == 0)


def test_query(spark):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op12_hard_negatives(spark, SF).collect())) == brute(rows, lambda i: i % 100 == 0)
