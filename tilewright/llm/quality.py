"""Text statistics and learned quality rules. DataFrame functions only on the data's path."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, text_or_empty, words

#: Characters counted as symbols.
SYMBOLS = "[#*$%&|<>]"
#: Labelled rows that the rules are learned from, at most; those with the smallest hash of the id.
SAMPLE_ROWS = 20_000
#: What the rules may test; all are ratios or counts that don't depend on the language.
FEATURES = (
    "n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "distinct_share", "digit_share",
)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per row of docs: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, the
    further counts that FEATURES need, and base_failed. All within the row: no shuffle.

    n_repeat_words: words in 3-word windows that occur twice or more in the text. Windows are
    hashed (64 bits); if some repeat, (hash, position) pairs are sorted, so equal windows are
    neighbours, and the positions' spans are added up without overlap.
    Null texts are empty texts, with no words and zero counts.
    """
    text = text_or_empty(text_col)
    d = docs.select(F.col(id_col).alias("id"), *(keep or []), text.alias("t"))
    d = d.select("id", *(keep or []), "t", words(F.col("t")).alias("w"))
    n = F.size("w")
    grams = F.when(
        n >= 3,
        F.transform(
            F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))
        ),
    ).otherwise(F.array().cast("array<long>"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    d = d.select(
        "id", *(keep or []),
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        grams.alias("grams"),
        F.regexp_count("t", F.lit("[A-Z]")).alias("n_upper"),
        F.regexp_count("t", F.lit("[!?]")).alias("n_marks"),
        F.regexp_count("t", F.lit("[0-9]")).alias("n_digits"),
        F.size(F.array_distinct("w")).alias("n_distinct"),
    )
    d = d.withColumn(
        "at", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.sort_array(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.lit(None))
    )
    again = F.filter("at", lambda x, i: (x.h == F.get("at", i - 1).h) | (x.h == F.get("at", i + 1).h))
    d = d.withColumn("pos", F.sort_array(F.transform(again, lambda x: x.i)))
    covered = F.aggregate(
        "pos",
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a.n + F.least(F.lit(3), p - a["last"])).alias("n")),
        lambda a: a.n,
    )
    return d.select(
        "id", *(keep or []), "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        F.size("lines").alias("n_lines"), "n_upper", "n_marks", "n_digits", "n_distinct",
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def features() -> list[Column]:
    """FEATURES as columns over statistics()."""
    one = lambda c: F.greatest(F.col(c), F.lit(1)).cast("double")
    return [
        F.col("n_words").cast("double").alias("n_words"),
        (F.col("word_chars") / one("n_words")).alias("mean_word"),
        (F.col("n_symbols") / one("n_words")).alias("symbol_share"),
        (F.col("n_dup_lines") / one("n_lines")).alias("dup_line_share"),
        (F.col("n_repeat_words") / one("n_words")).alias("repeat_share"),
        (F.col("n_upper") / one("word_chars")).alias("upper_share"),
        (F.col("n_marks") / one("n_words")).alias("mark_share"),
        (F.col("n_distinct") / one("n_words")).alias("distinct_share"),
        (F.col("n_digits") / one("word_chars")).alias("digit_share"),
    ]


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, '<=' or '>', threshold), all of which must hold, with its decision."""

    tests: tuple[tuple[str, str, float], ...]
    good: bool

    def holds(self, x: np.ndarray) -> np.ndarray:
        ok = np.ones(len(x), dtype=bool)
        for f, op, v in self.tests:
            col = x[:, FEATURES.index(f)]
            ok &= col <= v if op == "<=" else col > v
        return ok

    def column(self) -> Column:
        c = F.lit(True)
        for f, op, v in self.tests:
            c = c & ((F.col(f) <= v) if op == "<=" else (F.col(f) > v))
        return c


def learn_rules(x: np.ndarray, good: np.ndarray, max_rules: int = 12, max_tests: int = 4, min_cover: int = 3, precision: float = 0.97) -> list[Rule]:
    """An ordered list of rules for low quality, by sequential covering; what none covers is good.

    Each rule grows on two thirds of the rows (FOIL gain over midpoints between neighbouring values),
    and is pruned on the last third by dropping final tests while that doesn't lower
    (bad - good) / (bad + good). A rule is taken if it is right about low quality in at least
    ``precision`` of the rows it covers, since a good document lost costs more than a bad one kept.
    Fewer than ten rows of either kind teach nothing: no rules.
    """
    bad = ~good
    if bad.sum() < 10 or good.sum() < 10:
        return []
    part = np.arange(len(x)) % 3
    left, rules = np.ones(len(x), dtype=bool), []
    while len(rules) < max_rules and (left & bad).any():
        grow, prune = left & (part < 2), left & (part == 2)
        tests: list[tuple[str, str, float]] = []
        now = grow.copy()
        while len(tests) < max_tests and (now & good).any():
            found = _best_test(x, bad, now)
            if found is None:
                break
            tests.append(found)
            now &= Rule((found,), False).holds(x)
        while len(tests) > 1 and _worth(Rule(tuple(tests[:-1]), False), x, bad, prune) >= _worth(
            Rule(tuple(tests), False), x, bad, prune
        ):
            tests.pop()
        if not tests:
            break
        rule = Rule(tuple(tests), False)
        hit = rule.holds(x) & left
        if hit.sum() < min_cover or (hit & bad).sum() < precision * hit.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def _worth(rule: Rule, x: np.ndarray, bad: np.ndarray, rows: np.ndarray) -> float:
    hit = rule.holds(x) & rows
    n = hit.sum()
    return (2 * (hit & bad).sum() - n) / n if n else -1.0


def _best_test(x: np.ndarray, bad: np.ndarray, rows: np.ndarray) -> tuple[str, str, float] | None:
    p0, n0 = (rows & bad).sum(), (rows & ~bad).sum()
    if not p0 or not n0:
        return None
    base, best, gain = np.log2(p0 / (p0 + n0)), None, 1e-9
    for k, name in enumerate(FEATURES):
        order = np.argsort(x[rows, k], kind="stable")
        v, b = x[rows, k][order], bad[rows][order]
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        pos, neg = np.cumsum(b)[cut].astype(float), np.cumsum(~b)[cut].astype(float)
        mid = (v[cut] + v[cut + 1]) / 2
        for op, p, n in (("<=", pos, neg), (">", p0 - pos, n0 - neg)):
            with np.errstate(divide="ignore", invalid="ignore"):
                g = np.where(p > 0, p * (np.log2(p / (p + n)) - base), -np.inf)
            i = int(np.argmax(g))
            if g[i] > gain:
                gain, best = g[i], (name, op, float(mid[i]))
    return best


def verdict(rules: list[Rule]) -> Column:
    """The ordered rules as one conditional expression over FEATURES: true for good."""
    c = None
    for r in rules:
        c = F.when(r.column(), F.lit(r.good)) if c is None else c.when(r.column(), F.lit(r.good))
    return F.lit(True) if c is None else c.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules from labels(doc_id, quality 0/1); null labels and ids without a document teach nothing. Learns
    from at most sample_rows labelled rows, those with the smallest hashes of the id; statistics are
    computed for these only, so their ids may be broadcast."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select(F.col("doc_id").alias("id"), "quality")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    labelled = statistics(texts.join(F.broadcast(few), "id"), "id", "text", ["quality"])
    taught = labelled.select("quality", *features(), F.xxhash64("id").alias("h"))
    rows = taught.orderBy("h", *[c for c in taught.columns if c != "h"]).limit(sample_rows).collect()  # ids may repeat
    if not rows:
        return []
    x = np.array([[r[f] for f in FEATURES] for r in rows], dtype=float)
    return learn_rules(x, np.array([r.quality > 0 for r in rows]))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """statistics() of each row, with row, a struct of its columns, and kept: false if base_failed, else the
    learned rules' verdict. Rows without a label are judged like all others; with no labels only the
    base counts; an empty table gives an empty one."""
    rules = fit(docs, labels, id_col, text_col)
    rows = docs.select(F.struct("*").alias("row")).select(
        "row", F.col(f"row.`{id_col}`").alias("id"), F.col(f"row.`{text_col}`").cast("string").alias("text")
    )
    stats = statistics(rows, "id", "text", ["row"])
    f = stats.select("*", F.struct(*features()).alias("f"))
    tested = verdict([Rule(tuple((f"f.{n}", o, v) for n, o, v in r.tests), r.good) for r in rules])
    return f.select(*stats.columns, (~F.col("base_failed") & tested).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that judge() rejects; all columns stay, whatever their names.

    The row number keeps the optimiser from moving the filter below the statistics, which would
    write their expressions out many times over."""
    judged = judge(docs, labels, id_col, text_col).select("row", "kept", F.monotonically_increasing_id().alias("n"))
    return judged.where(F.col("kept") & (F.col("n") >= 0)).select("row.*")
