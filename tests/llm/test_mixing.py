import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tilewright.llm import mixing


def targets(sizes, weights, most):
    """Reshares the excess by weight until no source is above most times its words."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        rest, share = [s for s in names if s not in full], total - sum(full.values())
        t = {s: share * w[s] / sum(w[x] for x in rest) for s in rest}
        over = {s: most * sizes[s] for s in rest if t[s] > most * sizes[s]}
        if not over:
            return {**full, **t}
        full |= over


def make():
    rows = []
    for k, (s, n) in enumerate([("b", 40), ("a", 7), (None, 30), ("é", 300), ("c", 1), ("hot", 900), ("empty", 5)]):
        for i in range(n):
            text = None if s == "empty" and i else " ".join(["w"] * ((i * 37 + k) % 90)) if s != "empty" else " \n"
            rows.append((len(rows), text, s, i % 3))
    return rows + [(5, "x y z", "a", 0), (5, "x y z", "a", 0), (None, "q", "b", 1)]


def test_targets_and_copies(spark):
    rows = make()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(df, (5, 2, 1), 3).select("row.*", F.struct("copies", "source_size", "target", "taken").alias("m")).collect()
    assert len(got) == len(rows)
    sizes: dict = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = targets(sizes, (5, 2, 1), 3)
    taken: dict = {}
    for r in got:
        assert r.m.source_size == sizes[r.source]
        assert r.m.target == pytest.approx(want[r.source])
        assert 0 <= r.m.copies <= 3 and r.m.taken == r.m.copies * len((r.text or "").split())
        taken[r.source] = taken.get(r.source, 0) + r.m.taken
    for s, t in taken.items():
        assert abs(t - want[s]) <= max(3, 0.01 * want[s]), (s, t, want[s])
    again = mixing.mix(df.repartition(7), (5, 2, 1), 3).select("row.doc_id", "copies").collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in mixing.mix(df, (5, 2, 1), 3).select("row.doc_id", "copies").collect())


def test_emit(spark):
    df = spark.createDataFrame(make(), "doc_id long, text string, source string, size int")
    mixed = mixing.mix(df)
    out = mixing.emit(mixed)
    assert out.columns == df.columns
    assert out.count() == mixed.agg(F.sum("copies")).first()[0]
    assert mixing.mix(df.limit(0)).count() == 0


def plain_mix(by, want_of, offset, most=3):
    """Copies of (size, ..) lists in plain Python: whole numbers for the longest, prefix sums for the others."""
    out = {}
    for s, v in by.items():
        v = sorted(v)
        total = sum(x[0] for x in v)
        each, copies, due, given = want_of[s] / total if total else 0.0, [0] * len(v), 0.0, 0
        low = max(0, len(v) - mixing.WHOLE)
        for i in range(len(v) - 1, low - 1, -1):
            due += each * v[i][0]
            if v[i][0]:
                copies[i] = min(most, max(0, math.floor((due - given) / v[i][0] + offset)))
            given += copies[i] * v[i][0]
        rest = sum(x[0] for x in v[:low])
        share = min(most, max(0, (want_of[s] - given) / rest)) if rest else 0.0
        for i in range(low):
            copies[i] = min(most, math.floor((i + 1) * share + offset) - math.floor(i * share + offset))
        out[s] = list(zip(v, copies))
    return out


def test_copies_are_those_of_the_prefix_sums(spark):
    """Against plain Python: in each source's order the sums of expected copies and one offset, and the integers they cross."""
    rows = make()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = sorted((r.source or "~", len((r.text or "").split()), r.doc_id is not None, r.doc_id or 0, r.copies) for r in mixing.mix(df).select("row.*", "copies").collect())
    by: dict = {}
    for d, t, s, _ in rows:
        by.setdefault(s, []).append((len((t or "").split()), d is not None, d or 0))
    want_of = targets({s: sum(n for n, _, _ in v) for s, v in by.items()}, (5, 2, 1), 3)
    plain = plain_mix(by, want_of, random.Random(42).random())
    assert got == sorted((s or "~", *x, c) for s, v in plain.items() for x, c in v)


@pytest.mark.parametrize("sf, most", [("sf0.01", 0.01), ("sf0.1", 0.015)])
def test_query_meets_its_targets(spark, sf, most):
    from tilewright.llm import queries

    path = f"/root/testdata/{sf}"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text", "source").collect()}
    by: dict = {}
    for d, r in docs.items():
        by.setdefault(r.source, []).append((len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), d))
    want = targets({s: sum(n for n, _ in v) for s, v in by.items()}, (5, 2, 1), 3)
    taken = dict.fromkeys(by, 0)
    for r in queries.op1_mixing(spark, path).collect():
        assert r.target == pytest.approx(want[docs[r.doc_id].source]) and r.taken <= 3 * r.size
        taken[docs[r.doc_id].source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= most * t


def test_long_texts(spark):
    df = spark.createDataFrame([(1, "w " * 400_000, "a"), (2, "v " * 10, "a"), (3, "u", "b")], "doc_id long, text string, source string")
    assert sorted(r.size for r in mixing.mix(df).select("size").collect()) == [1, 10, 400_000]
