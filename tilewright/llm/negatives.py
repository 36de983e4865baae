"""Hard negatives by threshold joins: an inverted index over dimensions whose tail is bounded by norms, partial scores that
are pruned by what the remaining norms can add, and thresholds that sink until each anchor's lists are full."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Table

#: The fewest and most rows, and the most anchors, that one task joins, tasks that there should be, rows and anchors scored at once, and dimensions of one block of postings.
FEW, ROWS, ANCHORS, TASKS = 1 << 12, 1 << 15, 1 << 14, 64
ROW_TILE, ANCHOR_TILE, BLOCK = 4096, 128, 8
#: Whole numbers up to here are exact in doubles.
EXACT = float(1 << 53)


class Index:
    """Rows (n x d whole numbers) for queries whose norm is at most ``reach`` and whose threshold is at least ``low``.

    Dimensions are ordered by weight and taken in blocks. A row is posted in the blocks before its cut:
    from there on its own norm times ``reach`` is below ``low``, so what it has there can't make a
    match of anything that isn't met before. Rows are sorted by cut, so each block's postings are
    the first rows.
    """

    def __init__(self, rows: np.ndarray, order: np.ndarray, reach: float, low: float):
        d = rows.shape[1]
        self.starts = list(range(0, d, BLOCK)) or [0]
        x = rows[:, order]
        squares = np.cumsum((x.astype(float) ** 2)[:, ::-1], axis=1)[:, ::-1]
        self.tails = np.sqrt(np.hstack([squares[:, self.starts], np.zeros((len(x), 1))])) if d else np.zeros((len(x), 2))
        covered = self.tails * reach * (1 + 1e-9) + 1 < low
        self.cut = np.where(covered.any(1), covered.argmax(1), len(self.starts))
        self.rows = np.argsort(-self.cut, kind="stable")
        self.x, self.tails, self.cut = x[self.rows], self.tails[self.rows], self.cut[self.rows]
        self.posted = [int(np.searchsorted(-self.cut, -k, side="left")) for k in range(len(self.starts))]  # rows with a cut beyond block k

    def matches(self, queries: np.ndarray, order: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (query, row, score) with a score of at least the query's threshold."""
        q = queries[:, order]
        squares = np.cumsum((q.astype(float) ** 2)[:, ::-1], axis=1)[:, ::-1] if q.shape[1] else np.zeros((len(q), 1))
        tails = np.sqrt(np.hstack([squares[:, self.starts], np.zeros((len(q), 1))]))
        most = float(tails[:, 0].max(initial=0.0)) * float(self.tails[:, 0].max(initial=0.0))
        kind = float if most < EXACT else np.int64
        q, x, ends = q.astype(kind), self.x.astype(kind), [*self.starts[1:], q.shape[1]]
        alive = np.arange(self.posted[0])
        score = np.zeros((len(q), len(alive)), kind)
        live = np.ones((len(q), len(alive)), bool)
        for k, (a, b) in enumerate(zip(self.starts, ends)):
            here = int(np.searchsorted(alive, self.posted[k]))  # those posted in this block
            score[:, :here] += q[:, a:b] @ x[alive[:here], a:b].T
            done = np.minimum(self.cut[alive], k + 1)
            rest = tails[:, done] * self.tails[alive, done][None, :]  # what dimensions not yet met can add
            live &= score + rest * (1 + 1e-9) + 1 >= low[:, None]
            some = live.any(0)
            if not some.all():
                alive, score, live = alive[some], score[:, some], live[:, some]
        i, j = np.nonzero(live)
        got, at = score[i, j], alive[j]
        for k in range(len(self.starts)):  # the dimensions that weren't posted
            left = self.cut[at] == k
            if left.any():
                a = self.starts[k]
                got[left] += (q[i[left], a:] * x[at[left], a:]).sum(1)
        good = got >= low[i]
        return i[good], self.rows[at[good]], got[good].astype(np.int64)


def best(group: np.ndarray, score: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Positions of each group's first k by score, ties by smaller name, in that order."""
    order = np.lexsort((names, -score, group))
    g = group[order]
    first = np.r_[True, g[1:] != g[:-1]] if len(g) else np.zeros(0, bool)
    place = np.arange(len(g)) - np.maximum.accumulate(np.where(first, np.arange(len(g)), 0)) if len(g) else g
    return order[place < k]


def _matrix(column: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Vectors as whole numbers, floor(256 * x); shorter ones end in zeros."""
    a = column.combine_chunks()
    a = a if isinstance(a, pa.ListArray) else pa.concat_arrays(a.chunks) if isinstance(a, pa.ChunkedArray) else a
    sizes = np.diff(a.offsets.to_numpy()) if len(a) else np.zeros(0, int)
    width = max(int(sizes.max(initial=0)), width or 0)
    values = np.floor(a.flatten().to_numpy(zero_copy_only=False).astype(float) * 256).astype(np.int64)
    out = np.zeros((len(a), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = values
    return out


def _sides(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both sides' numbers at one width, and the order of dimensions: heavy ones first."""
    q, x = _matrix(left["vector"]), _matrix(right["vector"])
    w = max(q.shape[1], x.shape[1])
    q, x = (np.pad(m, ((0, 0), (0, w - m.shape[1]))) for m in (q, x))
    return q, x, np.argsort(-np.abs(x).sum(0, dtype=float), kind="stable")


def _once(names: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Positions of the rows that count: of those that repeat a name the first by label."""
    order = np.lexsort((labels, names))
    n = names[order]
    return np.sort(order[np.r_[True, n[1:] != n[:-1]]]) if len(n) else order


def _sunk(x: np.ndarray, order: np.ndarray, q: np.ndarray, windows: list[tuple[int, int, int]], k: int, takes, names: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(window, row, score) of the first k rows of each window (query, low, high): scores within low .. high, among the
    rows that takes(queries, rows) allows.

    A window's threshold begins where a sample of the rows has one match and sinks to where the sample
    alone fills it, then to its low end; it stops once k matches are found. The sample only says where
    to begin, matches come from all rows.
    """
    reach = np.sqrt((q.astype(float) ** 2).sum(1).max(initial=0.0))
    sample = np.arange(min(len(x), max(64, len(x) // 16)))
    of = np.array([w[0] for w in windows])
    low, high = (np.array([w[i] for w in windows], np.int64) for i in (1, 2))
    start, sure = low.copy(), low.copy()
    if len(sample) < len(x):
        for a in range(0, len(windows), ANCHOR_TILE):
            part = slice(a, a + ANCHOR_TILE)
            s = q[of[part]] @ x[sample].T
            s = np.where(takes(of[part][:, None], sample[None, :]) & (s <= high[part][:, None]) & (s >= low[part][:, None]), s, np.iinfo(np.int64).min)
            top = -np.sort(-s, axis=1)
            start[part] = np.maximum(low[part], top[:, 0])
            sure[part] = np.maximum(low[part], top[:, k - 1] if top.shape[1] >= k else low[part])
    open_ = np.arange(len(windows))
    for level in (start, sure, low):
        again = []
        for a in range(0, len(open_), ANCHOR_TILE):
            some = open_[a : a + ANCHOR_TILE]
            kept_w, kept_r, kept_s = np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.int64)
            floor = level[some].copy()
            for b in range(0, len(x), ROW_TILE):
                index = Index(x[b : b + ROW_TILE], order, reach, float(floor.min()))
                i, j, s = index.matches(q[of[some]], order, floor)
                j = j + b
                ok = (s <= high[some][i]) & takes(of[some][i], j)
                w, r, s = np.r_[kept_w, i[ok]], np.r_[kept_r, j[ok]], np.r_[kept_s, s[ok]]
                pick = best(w, s, names[r], k)
                kept_w, kept_r, kept_s = w[pick], r[pick], s[pick]
                full = np.bincount(kept_w, minlength=len(some)) == k
                last = np.full(len(some), np.iinfo(np.int64).max)
                np.minimum.at(last, kept_w, kept_s)
                floor = np.where(full, np.maximum(floor, last), floor)  # what comes has to do better, or as well
            done = (np.bincount(kept_w, minlength=len(some)) == k) | (level[some] <= low[some])
            yield from ((int(some[w]), int(r), int(s)) for w, r, s in zip(kept_w, kept_r, kept_s) if done[w])
            again += some[~done].tolist()
        open_ = np.array(again, int)
        if not len(open_):
            return


_LOWEST = -(1 << 62)


def _positives(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            q, x, order = _sides(left, right)
            (qn, ql), (xn, xl) = ((t["id"].to_numpy(), t["label"].to_numpy()) for t in (left, right))
            once, mine = _once(xn, xl), _once(qn, ql)
            for label in np.unique(ql[mine]):
                a, b = mine[ql[mine] == label], once[xl[once] == label]
                if len(b):
                    names = xn[b]
                    windows = [(i, _LOWEST, 1 << 62) for i in range(len(a))]
                    takes = lambda i, j, a=a, names=names: qn[a][i] != names[j]
                    out += [(qn[a[w]], names[r], s) for w, r, s in _sunk(x[b], order, q[a], windows, k, takes, names)]
        return pa.table([pa.array([o[c] for o in out], pa.int64()) for c in range(3)], names=["anchor_id", "positive_id", "score"])

    return run


def _negatives(k: int, least: int, most: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            q, x, order = _sides(left, right)
            (qn, ql), (xn, xl) = ((t["id"].to_numpy(), t["label"].to_numpy()) for t in (left, right))
            once, mine = _once(xn, xl), _once(qn, ql)
            x, xn, xl = x[once], xn[once], xl[once]
            positives = left["positives"].to_pylist()
            windows, of = [], []
            for i in mine:
                for p in positives[i]:
                    low, high = -(-least * p["score"] // 100), most * p["score"] // 100
                    if low <= high:
                        windows.append((int(i), low, high))
                        of.append((qn[i], p["id"], p["score"]))
            takes = lambda i, j: ql[i] != xl[j]
            if windows and len(x):
                out = [(*of[w], xn[r], s) for w, r, s in _sunk(x, order, q, windows, k, takes, xn)]
        return pa.table([pa.array([o[c] for o in out], pa.int64()) for c in range(5)], names=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return run


def usable(vector: Column) -> Column:
    """Not null, and neither is a component, nor infinite or no number."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(fine(x.cast("double")), F.lit(False))), F.lit(False))


def _upto(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def _joined(anchors: DataFrame, rows: DataFrame, chunks: int, blocks: int, run, schema: str) -> DataFrame:
    """run() on each block of anchors and chunk of rows. Rows are sent once a block of 16,384 anchors, anchors once a
    chunk of at most 32,768 rows; neither side of a task grows with the data."""
    pair = [F.col("chunk"), F.col("block")]
    a = anchors.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks))).withColumn("chunk", F.explode(_upto(chunks)))
    r = rows.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks))).withColumn("block", F.explode(_upto(blocks)))
    return a.groupBy(*pair).cogroup(r.groupBy(*pair)).applyInArrow(run, schema)


def mine(rows: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: str | Column = "label", positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100, chunk: int | None = None, block: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its first
    ``positives`` rows of the same label the first ``negatives`` rows of other labels whose score lies between least and
    most hundredths of the positive's.

    Scores are inner products of floor(256 * x), exact while they fit 63 bits; higher ones come first, ties by
    smaller id. Rows with a null id, label or vector, or with a component that is null or not finite,
    take no part; a shorter vector counts as ending in zeros, an empty one as zero. Of rows that repeat an
    id the one with the smallest label counts once. A negative positive's score leaves no room for
    negatives. Ids are whole numbers, labels too. An empty table, or one without anchors, gives no rows;
    other columns are not looked at.

    Only anchors are compared with all rows, in blocks. Each task keeps the first few of each list, so a vector that a third
    of all rows share costs scores, not rows.
    """
    label = F.col(label) if isinstance(label, str) else label
    v = rows.where(usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).alias("vector"), anchor.alias("is_anchor"))
    v = Table(v.where("id is not null and label is not null"), "negatives-rows")
    n, n_anchors = v.df.agg(F.count("*"), F.count_if(F.col("is_anchor"))).first()
    chunk = chunk or min(ROWS, max(FEW, n // TASKS))
    chunks, blocks = max(1, -(-n // chunk)), max(1, -(-n_anchors // block))
    every, anchors = v.df.select("id", "label", "vector"), v.df.where("is_anchor").select("id", "label", "vector")

    near = _joined(anchors, every, chunks, blocks, _positives(positives), "anchor_id long, positive_id long, score long")
    first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    near = near.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= positives)
    lists = near.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct(F.col("positive_id").alias("id"), "score")).alias("positives"))  # at most so many
    with_lists = Table(anchors.join(lists, "id"), "negatives-anchors").df
    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    hard = _joined(with_lists, every, chunks, blocks, _negatives(negatives, least, most), schema)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    hard = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return hard.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
