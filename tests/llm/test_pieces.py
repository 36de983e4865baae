"""The encoder against a plain dynamic program, and exact round trips."""

import math
import random

import numpy as np
import pytest

from tilewright.llm import pieces


@pytest.fixture(scope="module")
def model():
    return pieces.Model.load()


TEXTS = [
    "", " ", "Hello world", "  two  spaces ", "a\n\nb\tc\r", "▁marker ▁▁ x", "Grüße, señor — été", "\U0001f600\U0001f468‍\U0001f469", "中文 и кириллица",
    "x" * 300, "supercalifragilistic" * 20, "the the the of\nof", "   ", "\n", "a" * 5 + " " * 70 + "b", "token = \"1eb9c654e721\"###",
]


def brute(model, text):
    """Best score over all splits, by characters, in the model's own order of preference."""
    vocab = {model.raw[i]: i for i in range(len(model.raw)) if model.raw[i] and i not in set(model.byte_ids.tolist())}
    t = " " + text if text else ""
    best = [(0.0, ())] + [(-math.inf, ())] * len(t)
    for i in range(len(t)):
        if best[i][0] == -math.inf:
            continue
        c = best[i][0] + model.unknown_score
        if c > best[i + 1][0]:
            best[i + 1] = (c, best[i][1] + tuple(int(model.byte_ids[b]) for b in t[i].encode()))
        for j in range(i + 1, min(len(t), i + 50) + 1):
            v = vocab.get(t[i:j].encode())
            if v is not None and best[i][0] + model.scores[v] > best[j][0]:
                best[j] = (best[i][0] + model.scores[v], best[i][1] + (v,))
    return best[-1]


def _score(model, text, ids):
    """With the unknown score for each character left as bytes."""
    raw = b"".join(model.raw[i] for i in ids).decode()
    own, bytes_of = 0.0, set(model.byte_ids.tolist())
    own += sum(model.scores[i] for i in ids if i not in bytes_of)
    as_bytes = bytes(int(np.flatnonzero(model.byte_ids == i)[0]) for i in ids if i in bytes_of)
    assert raw[1:] == text
    return own + model.unknown_score * sum((b & 0xC0) != 0x80 for b in as_bytes)


def test_best_score_and_round_trip(model):
    rng = random.Random(1)
    words = ["the", "of", "Grüße", "xqz", "été", "▁", "\n", "\t", "\U0001f600", "ing", "tion", "12", "-"]
    texts = TEXTS + ["".join(rng.choice(words) + rng.choice(["", " ", "  "]) for _ in range(30)) for _ in range(20)]
    for t, got in zip(texts, model.encode(texts)):
        assert model.decode(got.tolist()) == t
        if t:
            assert _score(model, t, got.tolist()) == pytest.approx(brute(model, t)[0])


def test_cutting_and_memory_change_nothing(model, monkeypatch):
    text = " ".join(f"word{i % 37} the\nof" for i in range(3000))
    (want,) = model.encode([text])
    monkeypatch.setattr(pieces, "CHARS", 1000)
    monkeypatch.setattr(pieces, "REMEMBERED", 20)
    monkeypatch.setattr(pieces, "SEARCHED", 7)
    got = list(model.encode(["a", text, "", text]))
    assert len(got) == 4
    assert (got[1] == want).all() and (got[3] == want).all() and len(got[2]) == 0


def test_double_array_holds_exactly_its_keys():
    keys = {w.encode(): i for i, w in enumerate(["a", "ab", "abc", "b", "é", "▁x", "zzz"])}
    d = pieces.DoubleArray.build(keys)

    def find(key):
        s = 0
        for b in key:
            n = d.base[s] + b
            if d.base[s] == 0 or d.check[n] != s:
                return -1
            s = n
        return int(d.value[s])

    assert all(find(k) == v for k, v in keys.items())
    assert all(find(k) == -1 for k in [b"c", b"ac", b"abcd", "è".encode(), b"zz"])


def test_frame(spark, model):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*TEXTS, None, TEXTS[2]])], "doc_id long, text string, ids string")
    got = {r.id: r for r in pieces.encode(df, model).collect()}
    assert len(got) == len(TEXTS) + 2 and all(r.exact for r in got.values())
    assert got[len(TEXTS)].n_tokens == 0 and got[len(TEXTS) + 1].ids == got[2].ids
    assert pieces.encode(df.limit(0), model).count() == 0
