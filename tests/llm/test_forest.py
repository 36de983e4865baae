import math

import numpy as np
import pytest

from tilewright.llm import forest


def brute(rows, threshold=0.9):
    ok = [r for r in rows if r[1] and all(c is not None and math.isfinite(c) for c in r[1]) and any(r[1])]
    n, comp = {id(r): 0 for r in rows}, {id(r): id(r) for r in rows}
    link = lambda a, b: len(a[1]) == len(b[1]) and np.dot(a[1], b[1]) >= threshold * np.linalg.norm(a[1]) * np.linalg.norm(b[1])
    near = {id(a): [b for b in ok if b is not a and link(a, b)] for a in ok}
    out = []
    for r in rows:
        seen, todo = {id(r): r}, [r]
        while todo:
            for b in near.get(id(todo.pop()), []):
                if id(b) not in seen:
                    seen[id(b)] = b
                    todo.append(b)
        out.append((r[0], len(near.get(id(r), [])), min(x[0] for x in seen.values())))
    del n, comp
    return sorted(out)


@pytest.mark.parametrize("block", [1024, 7])
def test_links_and_components(spark, monkeypatch, block):
    monkeypatch.setattr(forest, "BLOCK", block)
    monkeypatch.setattr(forest, "LEAF", 30)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 16))
    rows = []
    for k, c in enumerate(centres):
        for _ in range(k % 7 + 1):
            rows.append((len(rows) + 1, [float(x) for x in c + 0.12 * rng.standard_normal(16)]))
    rows += [(1000 + k, rows[5][1]) for k in range(20)]
    rows += [(2000, [2 * x for x in rows[5][1]]), (2001, [-x for x in rows[5][1]])]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [float("nan")] * 16), (3004, [1.0, None]), (3005, [1.0, 2.0]), (3006, [2.0, 4.0]), (3007, [float("inf")] * 16)]
    df = spark.createDataFrame([(a, b, 0) for a, b in rows], "vec_id long, embedding array<double>, node int")
    got = sorted(tuple(r) for r in forest.near(df).collect())
    want = brute(rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    found, real = sum(g[1] for g in got), sum(w[1] for w in want)
    assert 0.97 * real <= found <= real
    assert sum(g[2] == w[2] for g, w in zip(got, want)) >= 0.97 * len(want)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert forest.near(df).count() == 0
    one = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in forest.near(one).collect()) == [(1, 0, 1), (2, 0, 2)]


def test_small_samples_split_on(spark, monkeypatch):
    """With far more vectors than the sample has, leaves stay small and pairs are still found."""
    monkeypatch.setattr(forest, "SAMPLE_ROWS", 200)
    monkeypatch.setattr(forest, "LEAF", 60)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((4000, 24))
    x[2000:] = x[:2000] + 0.3 * rng.standard_normal((2000, 24))
    sample = forest.unit(x[rng.permutation(4000)[:200]])
    tree = forest.grow_forest(sample, 200 / 4000, 1, leaf=60)[0]
    rows, leaf = tree.leaves(forest.unit(x))
    assert np.bincount(rows, minlength=4000).min() >= 1 and tree.levels.max() >= 2
    assert np.unique(leaf, return_counts=True)[1].max() < 600
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.id: r.n_links for r in forest.near(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    real = (u @ u.T >= 0.9).sum(1) - 1
    found = np.array([got[i] for i in range(4000)])
    assert (found <= real).all() and real.sum() > 2000 and found.sum() >= 0.9 * real.sum()
