"""Every stage of the pipeline on its own input, against a plain version."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from tilewright.llm import mixing, pieces, quality
from tilewright.llm.common import materialize, read

SF = "/root/testdata/sf0.001"
W = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and output, as lists of rows."""
    docs, out = read(spark, SF, "documents"), {}
    columns = docs.columns
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        done = materialize(f(spark, docs, SF), f"test-{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert done.columns == columns
        out[name] = (docs, done)
        docs = done
    return out


def test_order(stages):
    assert list(stages) == ["quality rules", "line dedup", "simhash near-dedup", "mixing sources", "sentencepiece encoding"]


def test_quality_rules(spark, stages):
    before, after = stages["quality rules"]
    kept = {r.id for r in quality.judge(before, read(spark, SF, "labels")).select("id", "kept").collect() if r.kept}
    assert sorted(str(r) for r in before.collect() if r.doc_id in kept) == sorted(map(str, after.collect()))
    assert len(kept) > before.count() / 3


def test_line_dedup(stages):
    before, after = (sorted(d.collect(), key=lambda r: r.doc_id) for d in stages["line dedup"])
    seen: list[frozenset] = []
    for a, b in zip(before, after, strict=True):
        left = []
        for line in (a.text or "").split("\n"):
            s = frozenset(W.findall(line))
            if s and any(9 * len(s & o) >= 4 * (len(s) + len(o)) for o in seen):
                seen.append(s)
                continue
            if s:
                seen.append(s)
            left.append(line)
        want = None if a.text is None else "\n".join(left)
        assert b.text == want and b.n_chars == len(want or "") and (b.doc_id, b.lang, b.source) == (a.doc_id, a.lang, a.source)


def test_simhash(stages):
    before, after = stages["simhash near-dedup"]
    rows = sorted(before.collect(), key=lambda r: r.doc_id)
    sets = []
    for r in rows:
        w = W.findall((r.text or "").lower())
        sets.append(frozenset(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else frozenset([tuple(w)]))
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    by: dict = {}
    for i, s in enumerate(sets):
        for j, n in Counter(k for g in s for k in by.get(g, ())).items():
            if 10 * n >= 8 * (len(s) + len(sets[j]) - n):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
        for g in s:
            by.setdefault(g, []).append(i)
    want = [r for i, r in enumerate(rows) if root(i) == i]
    assert sorted(map(str, after.collect())) == sorted(map(str, want))


def test_mixing(stages):
    before, after = stages["mixing sources"]
    copies = {r.doc_id: r.copies for r in mixing.mix(before, weights=(5, 2, 1), max_repeat=3).select("row.doc_id", "copies").collect()}
    want = [str(r) for r in before.collect() for _ in range(copies[r.doc_id])]
    assert sorted(map(str, after.collect())) == sorted(want)


def test_sentencepiece(stages):
    before, after = stages["sentencepiece encoding"]
    model = pieces.Model.load()
    texts = sorted((r.doc_id, r.text or "") for r in before.collect())
    got = sorted(((r.doc_id, r.ids) for r in after.collect()), key=lambda r: r[0])
    assert [d for d, _ in texts] == [d for d, _ in got]
    assert all(model.decode(ids) == t for (_, t), (_, ids) in zip(texts, got))
