"""Ranked search against scoring every document."""

import math
from collections import Counter

import numpy as np
import pytest

from tilewright.llm import queries, ranked
from tilewright.llm.ranked import Postings, search, terms

SF = "/root/testdata/sf0.001"


def brute(docs, items, k=10):
    c = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(x) for _, x in c), sum(x.total() for _, x in c)
    df = Counter(t for _, x in c for t in x)
    out = []
    for i, t in items:
        scored = []
        for d, x in c:
            s = 0
            for w, times in Counter(terms(t)).items():
                if x[w]:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                    m = 25 + 75 * x.total() * n_docs // n_terms
                    s += times * weight * (10**9 * x[w] // (1000 * x[w] + 8 * m))
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(i, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=str if None in [x[2] for x in scored] else None)[:k])]
    return sorted(out, key=str)


def test_terms():
    assert terms("Don't_stop 3.14 ÉCOLE-Ñandú x\x7fY") == ["don", "t", "stop", "3", "14", "École", "Ñandú x".replace("Ñ", "Ñ"), "y"]
    assert terms(None) == [] and terms(" \n-") == []


@pytest.mark.parametrize("seed", range(6))
def test_search_is_exact(seed):
    rng = np.random.default_rng(seed)
    n, m = 400, 12
    lists = rng.integers(0, m, 3000)
    docs = rng.integers(0, n, 3000)
    pairs = np.unique(np.stack([lists, docs], 1), axis=0)
    impact = rng.integers(1, 4 if seed % 2 else 1000, len(pairs))
    shuffled = rng.permutation(len(pairs))
    p = Postings(pairs[shuffled, 0], pairs[shuffled, 1], impact[shuffled], n)
    for size in (1, 3, m):
        q = rng.choice(m, size, replace=False)
        w = rng.integers(1, 4, size)
        score = np.zeros(n, int)
        for t, x in zip(q, w):
            mine = pairs[:, 0] == t
            score[pairs[mine, 1]] += x * impact[mine]
        want = [(int(d), int(score[d])) for d in np.lexsort((np.arange(n), -score)) if score[d] > 0][:10]
        assert search(p, q, w, 10) == want


def test_range_maxima():
    rng = np.random.default_rng(1)
    impact = rng.integers(0, 9, 500)
    p = Postings(np.zeros(500, int), np.arange(500), impact, 500)
    a = rng.integers(0, 500, 400)
    b = np.minimum(500, a + rng.integers(1, 500, 400))
    assert p.heaviest(a, b).tolist() == [int(x + np.argmax(impact[x:y])) for x, y in zip(a, b)]


def test_edges(spark):
    docs = [(i, f"alpha beta {'gamma ' * (i % 5)} w{i % 7}") for i in range(60)] + [(i, "alpha same text") for i in range(60, 160)]
    docs += [(200, None), (201, ""), (202, " -- "), (203, "beta " * 30_000 + "rare"), (204, "Straße naïve ALPHA"), (7, "alpha beta repeated id")]
    items = [(1, "Alpha beta gamma w3"), (2, "rare RARE beta"), (3, None), (4, "unknown words only"), (5, ""), (6, "straße naïve"), (7, "same text same text")]
    d = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, item int, shard int")
    q = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc int")
    want = brute(docs, items)
    for postings, block in ((1 << 19, 4096), (40, 2)):
        got = ranked.rank(d, q, postings=postings, block=block)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert ranked.rank(d.limit(0), q).count() == 0 and ranked.rank(d, q.limit(0)).count() == 0


def test_without_the_vocabulary(spark, monkeypatch):
    """Items with more terms than are sent to all tasks: a join finds the lists that are asked for."""
    monkeypatch.setattr(ranked, "VOCABULARY", 2)
    docs, items = [(i, f"a{i % 3} b{i % 5} c") for i in range(40)], [(1, "a1 b2 c"), (2, "b4 a0")]
    got = ranked.rank(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_query(spark):
    table = lambda n, k: [(r[k], r.text) for r in spark.read.parquet(f"{SF}/{n}.parquet").collect()]
    want = brute(table("documents", "doc_id"), table("benchmark", "item_id"))
    assert sorted(map(tuple, queries.op13_ranked_search(spark, SF).collect()), key=str) == want
