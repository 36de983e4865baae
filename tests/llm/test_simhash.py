import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tilewright.llm import components, simhash


def plain(text, k=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if len(w) >= k else [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b c", "a b c d", "A B c D e É é", "x y " * 50, "ä\x0bö\x0cü\rß"])
def test_fingerprint(text, monkeypatch):
    assert simhash.fingerprint((text or "").encode()) == plain(text)
    monkeypatch.setattr(simhash, "CHUNK", 3)
    assert simhash.fingerprint((text or "").encode()) == plain(text)


def union(n, pairs):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        up[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(n)]


@pytest.mark.parametrize(("distance", "hot"), [(0, 1024), (1, 1024), (4, 1024), (9, 1024), (0, 1), (1, 2), (4, 2), (4, 6)])
def test_groups_are_exact(spark, distance, hot, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(distance)
    fps = []
    for _ in range(60):
        f = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 3, 12])):
            fps.append(f)
            for _ in range(rng.randrange(0, distance + 3)):
                f ^= 1 << rng.randrange(64)
    df = spark.createDataFrame([(i + 5, int(np.uint64(f).astype(np.int64))) for i, f in enumerate(fps)], "id long, fp long")
    got = {r.id: r.component for r in df.join(simhash.group(df, distance), "fp").collect()}
    want = union(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= distance])
    assert [got[i + 5] for i in range(len(fps))] == [w + 5 for w in want]


@pytest.mark.parametrize(("n", "distance"), [(100, 4), (10**6, 4), (10**9, 4), (10**6, 14)])
def test_thresholds_keep_the_pigeonhole_promise(n, distance):
    rng = np.random.default_rng(0)
    bits = rng.random((500, 64)) < rng.random(64) * 0.6 + 0.2
    both = (bits.T.astype(float) @ bits) * (n / 500)
    plan = simhash.plan_partitions(n, both, distance)
    assert sum(t + 1 for _, t in plan) == distance + 1
    seen = [b for p, _ in plan for b in p]
    assert len(seen) == len(set(seen))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(50, 51), (51, 50), (60, 60), (70, 71), (70, 72), (70, 71), (None, 3)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r.node: r.component for r in components.connected_components(df).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 51: 50, 70: 70, 71: 70, 72: 70}
    assert components.connected_components(df.limit(0)).count() == 0


def test_near_duplicates_and_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(200))
    near = text.replace("w17 ", "q17 ")
    rows = [(3, text), (1, near), (2, text), (9, "other words entirely here now"), (None, text), (4, None), (5, ""), (2, text), (None, "alone one two three four five")]
    df = spark.createDataFrame([(a, b, "k", 7) for a, b in rows], "doc_id long, text string, fp string, id int")
    got = sorted((tuple(r) for r in simhash.keep_one(df, distance=14).collect()), key=str)
    assert got == sorted([(1, near, "k", 7), (9, rows[3][1], "k", 7), (4, None, "k", 7), (None, rows[8][1], "k", 7)], key=str)
    assert simhash.keep_one(df.limit(0)).count() == 0 and simhash.near_duplicates(df.limit(0)).count() == 0
    comp = {(r.id, r.component) for r in simhash.near_duplicates(df.select("doc_id", "text"), distance=14).collect()}
    assert (3, 1) in comp and (2, 1) in comp and (5, 4) in comp
    # a text of two shingles sets few bits, so it may link with the blank ones, whose fingerprint is 0
    assert ((9, 4) in comp) == (bin(plain(rows[3][1])).count("1") <= 14)
    h = df.select(F.lower(F.lpad(F.hex(F.lit(-1)), 16, "0"))).first()[0]
    assert h == "f" * 16


def test_keep_one_finds_every_pair_by_jaccard(spark):
    """Against all comparisons: pairs at 0.80 to 0.85 and just below, far apart in bits, and repeated passages."""
    rng = random.Random(5)
    rows, far = [], 0

    def sh(t):
        w = t.lower().split()
        return frozenset(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else frozenset([tuple(w)])

    for k in range(80):
        w = [f"a{k}x{i}" for i in range(rng.randrange(60, 200))]
        v = w[: rng.randrange(int(len(w) * 0.78), int(len(w) * (0.95 if k % 2 else 0.86)))]  # Jaccard about the share that is kept
        if k % 2:
            v += v[3:12] * rng.randrange(10, 30)  # weighs much in the bits, little in the set
        rows += [" ".join(w), " ".join(v)]
    rows += ["one two", "ONE  two", "one two three", "", None] + [" ".join([rows[0], f"end{i}"]) for i in range(30)]
    sets = [sh(t or "") for t in rows]
    pairs = []
    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if 10 * same >= 8 * (len(sets[i]) + len(sets[j]) - same):
                pairs.append((i, j))
                far += bin(plain(rows[i], 5) ^ plain(rows[j], 5)).count("1") > 14
    assert far > 10
    want = sorted(i for i, root in enumerate(union(len(rows), pairs)) if i == root)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(df, distance=14).collect()) == want


def test_pipeline_stage_is_keep_one_by_jaccard(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(104)]
    near = words[:84] + words[3:12] * 25
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:84])), (3, " ".join(words[:83]))], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, df, "").collect()] == [1]
    df = spark.createDataFrame([(1, " ".join(words[:90])), (2, " ".join(near)), (3, " ".join(words[:60]))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, df, "").collect()) == [1, 3]


def test_sketches_never_exclude_a_similar_pair():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: int(rng.integers(0, len(a) + 1))], rng.integers(0, 1 << 63, int(rng.integers(1, 300)), dtype=np.uint64)]))
        assert simhash.least_difference(simhash.parity_sketch(a), simhash.parity_sketch(b)) <= len(np.setxor1d(a, b))
        k = simhash.prefix_length(n, 0.8)
        assert n - k + 1 >= 0.8 * n - 1e-9 and n - k < 0.8 * n
