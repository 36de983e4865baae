import numpy as np
import pytest

from tilewright.llm import quality

TEXTS = [
    None, "", "  \n ", "one", "a b c a b c a b c", "a b c x a b c", "a a a a", "x y\nx y\n\nz\nx y \n", "# * $ % & | < > #word", "é ü\tß\x0b\x0c\r end",
    "w " * 60, " ".join(f"w{i}" for i in range(60)), "the cat " * 5000, "a b c",
]


def brute(t):
    t = t or ""
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t) if x]
    grams = {}
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {p + k for v in grams.values() if len(v) > 1 for p in v for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if __import__("re").search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_statistics(spark):
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, grams int, w string")
    got = {r.id: r for r in quality.statistics(df).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), (i, t and t[:40])


def test_rules_cover_what_is_bad_and_nothing_else():
    rng = np.random.default_rng(0)
    x = rng.random((600, len(quality.FEATURES)))
    bad = ((x[:, 2] > 0.8) & (x[:, 5] < 0.5)) | (x[:, 7] < 0.1)
    rules = quality.learn_rules(x, ~bad)
    got = np.zeros(600, bool)
    for r in rules:
        got |= r.holds(x)
    assert (got == bad).mean() > 0.97 and (got & ~bad).mean() < 0.01
    assert quality.learn_rules(x[:5], ~bad[:5]) == []


def test_judged_as_the_rules_say(spark):
    good = [(i, " ".join(f"w{(i * 7 + k * k) % 500}" for k in range(80))) for i in range(40)]
    junk = [(100 + i, " ".join(f"w{(i * 5 + k * k) % 500}###" for k in range(80))) for i in range(40)]
    docs = spark.createDataFrame([(a, b, "q", 1) for a, b in good + junk] + [(None, good[0][1], "q", 1), (999, None, "q", 1), (0, good[0][1], "q", 1)], "doc_id long, text string, kept string, quality int")
    labels = spark.createDataFrame([(a, int(a < 100), 0) for a, _ in good[:25] + junk[:25]] + [(None, 1, 0), (5, None, 0), (12345, 0, 0)], "doc_id long, quality int, toxic int")
    kept = sorted(str(r.doc_id) for r in quality.keep_good(docs, labels).collect())
    assert kept == sorted([str(a) for a, _ in good] + ["None", "0"])
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.keep_good(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, labels.limit(0)).count() == 82


@pytest.mark.parametrize("names", [[], ["kept"]])
def test_verdict_is_one_conditional_expression(names):
    rules = [quality.Rule((("n_words", ">", 1.0), ("mean_word", "<=", 9.0)), False)] if names else []
    assert ("CASE WHEN" in str(quality.verdict(rules))) == bool(names)
