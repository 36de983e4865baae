import random

import pytest

from tilewright.llm import lines


def brute(rows, lo=4, hi=5):
    """doc -> removed line numbers: all earlier lines are compared."""
    seen, out = [], {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        gone = []
        for i, line in enumerate((t or "").split("\n")):
            s = frozenset(line.split(" ")) - {""}
            if not s:
                continue
            if any(len(s & o) * (hi + lo) >= (len(s) + len(o)) * lo for o in seen):
                gone.append(i)
            seen.append(s)
        out[d] = gone
    return out


def make(seed):
    rng = random.Random(seed)
    common = [f"w{i}" for i in range(30)]
    base = [" ".join(rng.choice(common) if rng.random() < 0.7 else f"r{rng.randrange(3000)}" for _ in range(rng.randrange(1, 40))) for _ in range(40)]
    rows = []
    for d in range(60):
        ls = []
        for _ in range(rng.randrange(0, 8)):
            w = rng.choice(base).split(" ")
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            ls.append(" ".join(w))
        rows.append((d, "\n".join(ls)))
    hot = "the hot line has a good many words that stay as they are in all of its variants but one".split(" ")
    for d in range(100, 160):
        w = list(hot)
        w[rng.randrange(len(w))] = f"v{d}"
        rows.append((d, " ".join(w) + "\n\n" + " ".join(hot)))
    return rows + [(500, None), (501, ""), (502, " \n \n"), (None, base[0])]


@pytest.mark.parametrize("seed", [1, 2])
def test_removed_lines_are_those_of_all_comparisons(spark, seed):
    rows = make(seed)
    df = spark.createDataFrame([(a, b, 1, "k") for a, b in rows], "doc_id long, text string, l int, key string")
    got = {r.id: list(r.removed) for r in lines.marked(df).collect()}
    assert got == brute(rows)


def test_texts(spark):
    rows = [(1, "a b c d e\nother words here\n\na b c d e f"), (2, "a b c d e\nkept line"), (3, None), (2, "a b c d e\nkept line")]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, gone string")
    got = sorted((tuple(r) for r in lines.drop_repeats(df).collect()), key=str)
    assert got == sorted([(1, "a b c d e\nother words here\n", "x"), (2, "kept line", "x"), (2, "kept line", "x"), (3, None, "x")], key=str)
    assert lines.drop_repeats(df.limit(0)).count() == 0


def test_long_lines_without_much_in_common_are_no_candidates(spark, monkeypatch):
    """64 bits pass any two lines of 150 words that share a rare one; all pairs of such lines were verified on their words."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(900)]
    rows = [(i, " ".join(rng.sample(vocabulary, rng.choice([150, 180])))) for i in range(60)]
    for i in range(60, 120):  # near copies of either side of the bound, and of what a wider sketch takes
        w = rng.sample(vocabulary, rng.choice([78, 80, 84, 300])) if i % 3 == 0 else w[rng.choice([0, 2, 8]) :] + rng.sample(vocabulary, rng.choice([0, 4]))
        rows.append((i, " ".join(w)))
    pairs = []
    monkeypatch.setattr(lines._Join, "_verified", lambda self, found, own=lines._Join._verified: pairs.append(found.count()) or own(self, found))
    got = {r.id: list(r.removed) for r in lines.marked(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    assert sum(map(bool, got.values())) > 20 and pairs[-1] < 300


def test_lines_just_below_the_old_bound_of_wide_sketches_are_no_candidates_either(spark, monkeypatch):
    """64 bits pass some unlike pairs of 78 words, ever more of them as the tables grow."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(900)]
    rows = [(i, " ".join(rng.sample(vocabulary, 78))) for i in range(1000)]
    pairs = []
    monkeypatch.setattr(lines._Join, "_verified", lambda self, found, own=lines._Join._verified: pairs.append(found.count()) or own(self, found))
    assert not any(r.removed for r in lines.marked(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert pairs[-1] == 0


def test_marks_are_exact_where_the_map_is_full(spark, monkeypatch):
    monkeypatch.setattr(lines, "MAP_BYTES", 4)
    rows, some = spark.range(500).withColumnRenamed("id", "ord"), spark.range(0, 500, 7).withColumnRenamed("id", "ord")
    assert {(r.ord, r.gone) for r in lines._marked(rows, some).collect()} == {(k, int(k % 7 == 0)) for k in range(500)}


def test_long_lines_under_one_hub_without_much_in_common_are_no_candidates(spark, monkeypatch):
    """Hubs had sketches of 64 bits, which any two lines of 150 words pass."""
    rng = random.Random(10)
    vocabulary = [f"w{i}" for i in range(900)]
    rows = [(i, " ".join(rng.sample(vocabulary, 150))) for i in range(300)]
    rows += [(300 + i, rows[i][1] + f" x{i} y{i}") for i in range(20)]
    pairs = []
    monkeypatch.setattr(lines._Join, "_verified", lambda self, found, own=lines._Join._verified: pairs.append(found.count()) or own(self, found))
    got = {r.id: list(r.removed) for r in lines.marked(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and sum(map(bool, got.values())) == 20
    assert pairs[0] < 40


def test_words_of_repeated_lines_are_counted_once(spark, monkeypatch):
    """All words of all texts were counted, those of copies too."""
    rows = [(i, f"a line that all texts have\nand one of three is number {i % 3}") for i in range(30)]
    counted = []
    monkeypatch.setattr(lines, "rarity_levels", lambda *a, own=lines.rarity_levels: counted.append(a[-1].count()) or own(*a))
    got = {r.id: list(r.removed) for r in lines.marked(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    assert counted == [4]


@pytest.mark.parametrize("ids", [lambda i: i - 7, lambda i: (i - 7) * 10**16])
def test_ids_far_apart_give_the_same_order_as_dense_ones(spark, ids):
    rows = [(ids(d), t) for d, t in make(3) if d is not None and d < 110]
    got = {r.id: list(r.removed) for r in lines.marked(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_texts_that_share_an_id_take_turns_by_line(spark):
    rows = [(5, "p q r s\nk l m n\n\nown a"), (5, "k l m n\np q r s"), (5, "k l m n\np q r s"), (6, "k\tl m\x0bn\n\t\nx"), (None, "x\ny"), (None, "y\nx\nz")]
    got = [(r.id, r.n_lines, list(r.removed)) for r in lines.marked(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(5, 4, [1]), (5, 2, [1]), (5, 2, [1]), (6, 3, [0]), (None, 2, [0, 1]), (None, 3, [1])], key=str)
