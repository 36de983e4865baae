"""Ranked lexical search: posting lists with sparse tables of range maxima, and intervals of documents that are split at
their heaviest document, best first."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Table, sent

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
#: Postings that one task searches, items that it searches for, and distinct terms of items that are sent to all tasks.
POSTINGS, ITEMS, VOCABULARY = 1 << 19, 4096, 1 << 18
#: Intervals taken from the queue at once.
AT_ONCE = 64


def terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(LOWER))


class Postings:
    """Posting lists side by side: list t is the ordinals of its documents, ascending, and their impacts. ``top[k][i]`` is
    where the largest of the 2**k impacts from i on stands, the first one of equals."""

    def __init__(self, lists: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_docs: int):
        order = np.lexsort((docs, lists))
        self.n_docs = n_docs
        self.keys = lists[order].astype(np.int64) * n_docs + docs[order]
        self.docs, self.impacts = docs[order], impacts[order]
        longest = int(np.bincount(lists).max(initial=0)) if len(lists) else 0
        self.top = [np.arange(len(order), dtype=np.int32)]
        while 2 << (len(self.top) - 1) <= longest:
            last, step = self.top[-1], 1 << (len(self.top) - 1)
            a, b = last, np.concatenate([last[step:], last[-1:].repeat(step)])
            self.top.append(np.where(self.impacts[a] >= self.impacts[b], a, b))
        self.table = np.vstack(self.top)

    def at(self, lists: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Where each list's first document from docs on stands."""
        return np.searchsorted(self.keys, lists * self.n_docs + docs)

    def heaviest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where the largest impact among a .. b - 1 stands, for a < b."""
        level = np.frexp((b - a).astype(float))[1] - 1
        i, j = self.table[level, a], self.table[level, b - (1 << level)]
        return np.where(self.impacts[i] >= self.impacts[j], i, j)


def search(p: Postings, lists: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(ordinal, score) of the first k documents by the sum of weight x impact over the lists, ties by ordinal; only
    scores above 0.

    An interval's bound is the sum of its lists' maxima, each found in two look-ups. The intervals with the largest bounds
    are split at the document that holds the largest part of it; that document is scored. What can't reach the k-th
    score any more is given up.
    """
    found_d, found_s = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(lists) or not p.n_docs:
        return []

    def bounds(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each interval: its bound, and the document to split it at."""
        n, m = len(lo), len(lists)
        l2 = np.broadcast_to(lists, (n, m))
        a = p.at(l2, lo[:, None])
        b = p.at(l2, hi[:, None])
        part = np.zeros((n, m), np.int64)
        doc = np.zeros((n, m), np.int64)
        some = b > a
        best = p.heaviest(a[some], b[some])
        part[some] = p.impacts[best] * np.broadcast_to(weights, (n, m))[some]
        doc[some] = p.docs[best]
        return part.sum(1), doc[np.arange(n), part.argmax(1)]

    def scores(docs: np.ndarray) -> np.ndarray:
        l2 = np.broadcast_to(lists, (len(docs), len(lists)))
        at = np.minimum(p.at(l2, docs[:, None]), len(p.keys) - 1)
        hit = p.keys[at] == l2 * p.n_docs + docs[:, None]
        return np.where(hit, p.impacts[at] * weights, 0).sum(1)

    lo, hi = np.array([0]), np.array([p.n_docs])
    bound, split = bounds(lo, hi)
    while True:
        least = found_s[-1] if len(found_s) == k else 1
        alive = bound >= least
        lo, hi, bound, split = lo[alive], hi[alive], bound[alive], split[alive]
        if not len(lo):
            return list(zip(found_d.tolist(), found_s.tolist()))
        now = np.argpartition(-bound, AT_ONCE)[:AT_ONCE] if len(bound) > AT_ONCE else np.arange(len(bound))
        s = scores(split[now])
        found_d, found_s = np.r_[found_d, split[now][s > 0]], np.r_[found_s, s[s > 0]]
        keep = np.lexsort((found_d, -found_s))[:k]
        found_d, found_s = found_d[keep], found_s[keep]
        a, b = np.r_[lo[now], split[now] + 1], np.r_[split[now], hi[now]]
        real = a < b
        more, where = bounds(a[real], b[real]) if real.any() else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        rest = np.ones(len(lo), bool)
        rest[now] = False
        lo, hi = np.r_[lo[rest], a[real]], np.r_[hi[rest], b[real]]
        bound, split = np.r_[bound[rest], more], np.r_[split[rest], where]


def _counted(vocabulary: Callable[[], frozenset[str]] | None):
    """(id, text) -> (doc, id, n, first, term, tf): a row for each term of a document that may be asked for, with the
    document's length; the first of its rows is marked, and has a null term if there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary() if vocabulary else None
        doc = TaskContext.get().partitionId() << 33
        for batch in batches:
            docs, names, lengths, firsts, found, counts = [], [], [], [], [], []
            for name, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                every = Counter(terms(text.as_py()))
                mine = [t for t in every if known is None or t in known] or [None]
                docs += [doc] * len(mine)
                names += [name] * len(mine)
                lengths += [every.total()] * len(mine)
                firsts += [True] + [False] * (len(mine) - 1)
                found += mine
                counts += [every[t] for t in mine]
                doc += 1
            columns = [pa.array(v, k) for v, k in ((docs, pa.int64()), (names, pa.int64()), (lengths, pa.int64()), (firsts, pa.bool_()), (found, pa.string()), (counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "id", "n", "first", "term", "tf"])

    return run


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (item, id, term, times)."""
    item = TaskContext.get().partitionId() << 33
    for batch in batches:
        rows = []
        for name, text in zip(batch.column("id").to_pylist(), batch.column("text")):
            rows += [(item, name, t, c) for t, c in Counter(terms(text.as_py())).items()]
            item += 1
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["item", "id", "term", "times"])


def _searched(k: int):
    """A shard's postings (doc, id, term, impact) and a block of items (item, term, times) -> (item, doc, id, score)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            doc, first, of = np.unique(left["doc"].to_numpy(), return_index=True, return_inverse=True)
            names = left["id"].take(pa.array(first)).to_pandas()
            place = pd.DataFrame({"none": names.isna(), "id": names.fillna(0).astype("int64"), "doc": doc}).sort_values(["none", "id", "doc"]).index.to_numpy()
            ordinal = np.empty(len(doc), np.int64)
            ordinal[place] = np.arange(len(doc))  # ordinals follow ids, so ties are by ordinal
            words = left["term"].combine_chunks().dictionary_encode()
            words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
            p = Postings(words.indices.to_numpy(), ordinal[of], left["impact"].to_numpy(), len(doc))
            which = pd.Index(words.dictionary.to_pandas())
            asked = pd.DataFrame({"item": right["item"].to_numpy(), "list": which.get_indexer(right["term"].to_pandas()), "times": right["times"].to_numpy()})
            for item, q in asked[asked["list"] >= 0].groupby("item", sort=True):
                for d, s in search(p, q["list"].to_numpy(), q["times"].to_numpy(), k):
                    at = place[d]
                    out.append((int(item), int(doc[at]), None if pd.isna(names[at]) else int(names[at]), s))
        return pa.table([pa.array([o[c] for o in out], pa.int64()) for c in range(4)], names=["item", "doc", "id", "score"])

    return run


def _vocabulary(asked: DataFrame) -> frozenset[str] | None:
    """The terms that items hold, if they are few enough to be sent to all tasks."""
    distinct = asked.select("term").distinct()
    if distinct.count() > VOCABULARY:
        return None
    return frozenset(r.term for r in distinct.toLocalIterator())


def rank(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", postings: int = POSTINGS, block: int = ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents with the highest scores above 0, ties by ascending doc_id.

    A document's score sums, over the item's terms with repeats, w * ((10**9 * tf) div (1000 * tf + 8 * m)), where
    w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))) and m = 25 + ((75 * n * N) div L). Terms are maximal
    runs of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased. N documents have a
    term, L terms in all; null and blank texts have none, and such items have no rows. Ids are whole numbers;
    null ids come last among ties. Rows that repeat an id are documents, or items, of their own. Empty
    tables give no rows; other columns are not looked at.

    Only terms that items hold become postings. Documents are dealt to shards of about ``postings`` postings, items to
    blocks; each shard is searched for each block by itself, and its best k of each item meet the
    other shards' in a window that keeps k of them in each task before anything is shuffled.
    """
    spark = docs.sparkSession
    named = lambda d, i, t: d.select(F.col(f"`{i}`").cast("long").alias("id"), F.col(f"`{t}`").cast("string").alias("text"))
    asked = Table(named(items, item_col, item_text).mapInArrow(_asked, "item long, id long, term string, times long"), "ranked-items").df
    known = _vocabulary(asked)
    counted = named(docs, id_col, text_col).mapInArrow(_counted(sent(spark, known) if known is not None else None), "doc long, id long, n long, first boolean, term string, tf long")
    counted = Table(counted, "ranked-counts").df
    n_docs, n_terms = counted.where("first").agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()

    weight = F.floor(F.log((F.lit(2.0 * n_docs + 2)) / (2.0 * F.col("df") + 1)) * 1000).cast("long")
    held = counted.where("term is not null")
    weights = held.groupBy("term").agg(F.count("*").alias("df")).select("term", weight.alias("w")).where("w > 0")
    weights = weights.join(asked.select("term").distinct(), "term", "left_semi")
    weights = F.broadcast(weights) if known is not None else weights
    m = F.lit(25) + F.expr(f"(75 * n * {n_docs}) div {max(1, n_terms)}")
    impact = F.col("w") * F.expr("(1000000000 * tf) div (1000 * tf + 8 * m)")
    lists = held.join(weights, "term").withColumn("m", m).select("doc", "id", "term", impact.alias("impact"))

    shards = max(1, -(-held.count() // postings))
    blocks = max(1, -(-asked.select("item").distinct().count() // block))
    pair = ["shard", "block"]
    left = lists.withColumn("shard", F.pmod(F.xxhash64("doc"), F.lit(shards))).withColumn("block", F.explode(_upto(blocks)))
    right = asked.select("item", "term", "times").withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks))).withColumn("shard", F.explode(_upto(shards)))
    got = left.groupBy(*pair).cogroup(right.groupBy(*pair)).applyInArrow(_searched(k), "item long, doc long, id long, score long")

    first = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "doc")
    best = got.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    names = asked.groupBy("item").agg(F.first("id").alias("item_id"))
    return best.join(names, "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def _upto(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
