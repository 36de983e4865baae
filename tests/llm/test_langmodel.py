import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tilewright.llm import langmodel as lm


def small():
    return lm.Network.start(np.arange(900, 0, -1), 5000.0)


def test_gradients_match_differences():
    net = small()
    net.flat[:] = net.flat.astype(np.float32)
    rng = np.random.default_rng(0)
    y = rng.integers(0, lm.CLASSES**2, (6, 3))
    new = rng.random((6, 3)) < 0.3
    new[0] = True
    x = np.zeros_like(y)
    x[1:] = y[:-1]
    x[new] = 0
    h0 = np.zeros((3, lm.HIDDEN), np.float32)

    def loss():
        out, _ = net.window(x, new, h0)
        return -float(net.outputs(out.reshape(-1, lm.HIDDEN), y.reshape(-1))[0].astype(np.float64).sum())

    grad = lm.Network(np.zeros_like(net.flat))
    out, saved = net.window(x, new, h0)
    _, dh = net.outputs(out.reshape(-1, lm.HIDDEN), y.reshape(-1), grad.p)
    net.backward(x, new, saved, dh.reshape(out.shape), grad.p)
    for name in lm.Network.SHAPES:
        g = grad.p[name].reshape(-1)
        for i in np.argsort(-np.abs(g))[:3]:
            w = net.p[name].reshape(-1)
            old, eps = w[i], 2e-2
            w[i] = old + eps
            up = loss()
            w[i] = old - eps
            down = loss()
            w[i] = old
            assert (up - down) / (2 * eps) == pytest.approx(g[i], rel=0.05, abs=0.02), name


def test_outputs_are_a_distribution():
    net = small()
    h = np.random.default_rng(1).standard_normal((1, lm.HIDDEN)).astype(np.float32)
    every = np.arange(lm.CLASSES**2)
    logp, _ = net.outputs(np.repeat(h, lm.CLASSES**2, axis=0), every)
    assert np.exp(logp).sum() == pytest.approx(1.0, abs=1e-4)


def test_whole_documents_score_like_one_step_at_a_time():
    net = small()
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, lm.CLASSES**2, n).astype(np.int32) for n in (1, 3, 200, 33, 32, 64, 1, 90)]
    got = lm.score_documents(net, docs)
    for d, g in zip(docs, got):
        h, total, before, new = np.zeros((1, lm.HIDDEN), np.float32), 0.0, 0, True
        for t in d:
            out, _ = net.window(np.array([[before]]), np.array([[new]]), h)
            h, before, new = out[-1], int(t), False
            total += float(net.outputs(h, np.array([t]))[0][0])
        assert g == pytest.approx(total, rel=1e-4)


def test_base_scores_and_held_out_gain(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 30)
    rng = random.Random(5)
    rows = []
    for i in range(300):
        words = []
        for _ in range(rng.randrange(0, 60)):
            words += rng.choice([["The", "cat", "sat"], ["on", "the\tmat"], ["a\n", f"w{rng.randrange(400)}"]])
        rows.append((i, " ".join(words), 0.0))
    rows += [(None, "the cat", 1.0), (1000, None, 1.0), (7, "the cat sat", 2.0)]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string, score double")).collect()
    assert len(got) == len(rows)
    toks = [(i, (t or "").lower().split() + [""]) for i, t, _ in rows]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, ws in toks if not out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted(((str(i), len(ws), sum(x in c for x in ws), round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in ws), 6), out(i)) for i, ws in toks))
    assert sorted((str(r.id), r.n_tokens, r.n_known, round(r.base_score, 6), r.held_out) for r in got) == want
    assert {r.train_tokens for r in got} == {n}
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(df).count() == 0


def test_words_are_looked_up_once_a_batch():
    """Each token was looked up in up to three tables, however often its word occurred."""
    import pyarrow as pa

    class Counted(dict):
        asked = 0

        def get(self, *a):
            Counted.asked += 1
            return super().get(*a)

    words = [b"", b"the", b"cat", b"sat", b"mat"]
    v = lm.Vocabulary.of(words, np.array([9, 7, 5, 3, 2]), 40, 12, [(b"at", 4, 3), (b"ing", 6, 4)], 8)
    plain = vars(v)
    v = lm.Vocabulary(**plain | {k: Counted(plain[k]) for k in ("index", "own_index", "endings")})
    texts = ["The cat sat on the mat " * 200, "", "running running cat zzz zzz", "on"]
    n = len(texts)
    b = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), pa.array([False] * n), pa.array(range(n)), pa.array(texts)], ["uid", "id", "held_out", "h", "text"])
    got = lm._encode_batch(v, b).to_pylist()
    assert Counted.asked <= 3 * 8
    for t, r in zip(texts, got):
        w = lm.tokens(t.encode())
        out, shared = v.outputs(w)
        logs = [math.log10(dict(zip(words, (9, 7, 5, 3, 2))).get(x, 0) + 1) for x in w]
        assert r["n_tokens"] == len(w) and r["n_head"] == sum(x in words for x in w)
        assert r["head_sum"] == pytest.approx(sum(logs))
        assert r["rest_sum"] == pytest.approx(sum(logs[k] - v.rest_total[out[k]] for k in shared))
        assert np.frombuffer(r["ids"], "<u2").tolist() == out.tolist()
        assert dict(zip(r["tail"], r["times"])) == Counter(x for x in w if x not in words)


def test_scoring_takes_batches_that_fit_a_cache(monkeypatch):
    """Batches of 32,768 tokens went through memory at each step."""
    rng = np.random.default_rng(3)
    net = lm.Network.start(np.ones(lm.CLASSES**2 - 1), 1.0)
    docs = [rng.integers(0, lm.CLASSES**2, 150).astype(np.int32) for _ in range(600)]
    sizes = []
    own = lm.Network.outputs
    monkeypatch.setattr(lm.Network, "outputs", lambda self, h, targets, grad=None: sizes.append(len(h)) or own(self, h, targets, grad))
    together = lm.score_documents(net, docs)
    assert sum(sizes) == 600 * 150 and max(sizes) <= 1 << 13
    assert np.allclose(together, [lm.score_documents(net, [d])[0] for d in docs], rtol=1e-5)
