"""Scoring documents by a gated recurrent language model with a class-factored softmax, in numpy."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, freed_shuffles, text_or_empty

LN10 = math.log(10)
#: The end of a document as a token; words are never empty.
END = b""
#: Tokens whose counts every task holds (the most frequent), at most; rarer ones get theirs by a join.
HEAD = 300_000
#: Sizes of the network: CLASSES ** 2 outputs. ENDINGS of them stand for all words with one ending, output 0 for
#: all words without an output of their own whose ending has none either.
CLASSES, HIDDEN, ENDINGS = 48, 16, 575
#: Bytes at the end of a word that make its ending.
ENDING = 3
#: Logits are cut off here, far from what float32 can't hold.
HIGHEST = np.float32(60)
ONES = np.ones(CLASSES, np.float32)
#: Backpropagation goes this far; lanes trained side by side, at most; steps that a shard's lanes have, at least.
WINDOW, LANES, STEPS = 16, 512, 64 * 16
#: Tokens whose outputs are computed at once when scoring, as many as in a window of training, so that their arrays
#: stay in a processor's cache, and those of different classes that share a step.
SCORED, TOGETHER = WINDOW * LANES, 1 << 12
#: Each training document is learned from once, in the round that its hash names. In a round shards of about
#: SHARD tokens learn side by side.
ROUNDS, RATES, SHARD = 4, (0.02, 0.012, 0.006, 0.003), 3 << 18
#: Bytes of text tokenised at a time, and distinct tokens counted before the counts are handed on.
TEXT_BYTES, FLUSH = 1 << 25, 200_000


def tokens(text: bytes) -> list[bytes]:
    """A-Z lower-cased words between ASCII white space, then the end."""
    w = text.lower().split()
    w.append(END)
    return w


def held_out(id_col: str):
    """Whether crc32 of the id as text leaves 2 when divided by 7; rows with a null id train."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))


def count_tokens(texts: DataFrame) -> DataFrame:
    """(text) -> (token, n): how often each token occurs; all texts count. Tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["token", "n"])
            c.clear()
            return b

        for b in batches:
            for t in b.column("text").cast(pa.binary()):
                c.update(tokens(t.as_py()))
                if len(c) >= FLUSH:
                    yield out()
        yield out()

    return texts.select("text").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The most frequent training tokens by falling count, the totals over all of them, and the outputs: each of the
    first ``own`` tokens has its own, other words share that of their ending, or output 0."""

    index: dict[bytes, int]
    log_count: np.ndarray  # log10(count + 1)
    train_tokens: int
    distinct: int
    own_index: dict[bytes, int]  # output of each token that has its own; small enough to stay in a processor's cache
    endings: dict[bytes, int]  # output of each ending that has one
    rest_total: np.ndarray  # by output, of add-one smoothing among the words that share it, unseen ones included
    output_counts: np.ndarray

    @staticmethod
    def of(tokens: list[bytes], counts: np.ndarray, total: int, distinct: int, endings: list[tuple[bytes, int, int]], outputs: int) -> Vocabulary:
        """From tokens by falling count, and (ending, count, distinct tokens) of frequent endings; both are of all
        training tokens. Outputs are in the order of their counts."""
        own = min(outputs - 1 - min(ENDINGS, outputs // 4), len(tokens))
        n, v = Counter(), Counter()
        for t, c in zip(tokens[:own], counts[:own].tolist()):
            n[t[-ENDING:]] += c
            v[t[-ENDING:]] += 1
        shared = [(e, c - n[e], d - v[e]) for e, c, d in endings]  # without the tokens that have an output
        shared = sorted((x for x in shared if x[1] > 0), key=lambda x: (-x[1], x[0]))[: outputs - 1 - own]
        order = sorted([(-c, 0, t) for t, c in zip(tokens[:own], counts[:own].tolist())] + [(-c, 1, e) for e, c, _ in shared])
        place = {(kind, x): k + 1 for k, (_, kind, x) in enumerate(order)}
        rest, output_counts = np.zeros(outputs), np.zeros(outputs)
        for k, (c, _, _) in enumerate(order):
            output_counts[k + 1] = -c
        for e, c, d in shared:
            rest[place[1, e]] = math.log10(c + d + 1)
        output_counts[0] = total - output_counts.sum()
        rest[0] = math.log10(output_counts[0] + distinct - own - sum(d for _, _, d in shared) + 1)
        return Vocabulary(
            {t: k for k, t in enumerate(tokens)}, np.log10(counts + 1.0), total, distinct,
            {t: place[0, t] for t in tokens[:own]}, {e: place[1, e] for e, _, _ in shared}, rest, output_counts,
        )

    @property
    def base_total(self) -> float:
        return math.log10(self.train_tokens + self.distinct + 1)

    def outputs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(output of each token, the places of those that share theirs)."""
        out = np.fromiter(map(self.own_index.get, words, repeat(-1)), np.int32, len(words))
        shared = np.flatnonzero(out < 0)
        if len(shared):
            ends = [words[k][-ENDING:] for k in shared.tolist()]
            out[shared] = np.fromiter(map(self.endings.get, ends, repeat(0)), np.int32, len(shared))
        return out, shared


def _runs(cuts: np.ndarray) -> Iterator[list[int]]:
    """The classes that have rows, in runs of at most TOGETHER rows or of one class."""
    run: list[int] = []
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        if run and cuts[k + 1] - cuts[run[0]] > TOGETHER:
            yield run
            run = []
        run.append(k)
    if run:
        yield run


class Network:
    """Embedding, one layer of gated recurrent units, and a softmax over classes times one within the class.

    Outputs are cut into CLASSES runs of like length in the order of their counts; output 0 comes first.
    """

    SHAPES = {
        "E": (CLASSES * CLASSES, HIDDEN), "Wx": (HIDDEN, 3 * HIDDEN), "bx": (3 * HIDDEN,), "Wh": (HIDDEN, 3 * HIDDEN),
        "Wc": (HIDDEN, CLASSES), "bc": (CLASSES,), "Wo": (CLASSES, HIDDEN, CLASSES), "bo": (CLASSES, CLASSES),
    }

    def __init__(self, flat: np.ndarray):
        self.flat, self.p, at = np.asarray(flat, dtype=np.float32), {}, 0
        for k, shape in self.SHAPES.items():
            n = int(np.prod(shape))
            self.p[k] = self.flat[at : at + n].reshape(shape)
            at += n

    @staticmethod
    def start(counts: np.ndarray, rest: float, seed: int = 42) -> Network:
        """Small random weights; the output biases give the tokens' shares in the training documents."""
        rng = np.random.default_rng(seed)
        net = Network(np.zeros(sum(int(np.prod(s)) for s in Network.SHAPES.values())))
        for k in ("E", "Wx", "Wh", "Wc", "Wo"):
            net.p[k][:] = rng.standard_normal(net.p[k].shape) * (0.3 if k == "E" else 0.7 if k in ("Wx", "Wh") else 0.1) / (1 if k == "E" else math.sqrt(HIDDEN))
        share = np.full(CLASSES * CLASSES, 1e-3)
        share[0] += rest
        share[1 : 1 + len(counts)] += counts
        share = share.reshape(CLASSES, CLASSES)
        net.p["bc"][:] = np.log(share.sum(1) / share.sum())
        net.p["bo"][:] = np.log(share / share.sum(1, keepdims=True))
        return net

    def window(self, inputs: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool = True) -> tuple[np.ndarray, list]:
        """States after each step: inputs (T, B) are the tokens before those to predict, fresh (T, B) marks the
        first of a document, where the state starts anew. Returns (T, B, HIDDEN) and, to keep, what backward() needs."""
        p = self.p
        gx = (p["E"] @ p["Wx"] + p["bx"])[inputs]
        out = np.empty((*inputs.shape, HIDDEN), np.float32)
        saved = [gx, *(np.empty_like(out) for _ in range(3))] if keep else []
        any_fresh = fresh.any(1)
        for t in range(len(inputs)):
            if any_fresh[t]:
                h = h.copy()
                h[fresh[t]] = 0
            gh = h @ p["Wh"]
            rz = gx[t, :, : 2 * HIDDEN]  # sigmoids, in place
            rz += gh[:, : 2 * HIDDEN]
            np.negative(rz, out=rz)
            np.exp(rz, out=rz)
            rz += 1
            np.reciprocal(rz, out=rz)
            r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
            ghc = gh[:, 2 * HIDDEN :]
            c = r * ghc
            c += gx[t, :, 2 * HIDDEN :]
            np.tanh(c, out=c)
            if keep:
                saved[1][t], saved[2][t], saved[3][t] = h, c, ghc
            h = np.subtract(h, c, out=out[t])
            h *= z
            h += c
        return out, saved

    def outputs(self, h: np.ndarray, targets: np.ndarray, grad: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """log p of the targets (n,) from the states (n, HIDDEN). With grad, adds the loss's gradients to it and
        returns that of the states."""
        p = self.p
        cls = (targets // CLASSES).astype(np.int16)  # few bits sort fast
        order = np.argsort(cls, kind="stable")  # the targets of a class side by side: their rows are slices
        cuts = np.searchsorted(cls[order], np.arange(CLASSES + 1))
        h, cls, within = h[order], cls[order], (targets % CLASSES)[order]
        a = h @ p["Wc"]
        a += p["bc"]
        np.minimum(a, HIGHEST, out=a)
        e = np.exp(a)
        s = e @ ONES  # summing short rows is much slower
        rows = np.arange(len(h))
        logp = a.reshape(-1)[rows * CLASSES + cls] - np.log(s)
        dh = None
        if grad is not None:
            e /= s[:, None]
            e[rows, cls] -= 1
            grad["Wc"] += h.T @ e
            grad["bc"] += e.sum(0)
            dh = e @ p["Wc"].T
        for some in _runs(cuts):  # only the products go class by class: steps over few rows cost as much as those over many
            i = slice(cuts[some[0]], cuts[some[-1] + 1])
            each = [(k, slice(cuts[k] - i.start, cuts[k + 1] - i.start)) for k in some]
            hi, n = h[i], rows[: i.stop - i.start]
            a = np.empty((len(hi), CLASSES), np.float32)
            for k, j in each:
                np.add(hi[j] @ p["Wo"][k], p["bo"][k], out=a[j])
            np.minimum(a, HIGHEST, out=a)
            e = np.exp(a)
            s = e @ ONES
            logp[i] += a.reshape(-1)[n * CLASSES + within[i]] - np.log(s)
            if grad is not None:
                e /= s[:, None]
                e[n, within[i]] -= 1
                for k, j in each:
                    grad["Wo"][k] += hi[j].T @ e[j]
                    grad["bo"][k] += e[j].sum(0)
                    dh[i][j] += e[j] @ p["Wo"][k].T
        out = np.empty_like(logp)
        out[order] = logp
        if dh is not None:
            back = np.empty_like(dh)
            back[order] = dh
            dh = back
        return out, dh

    def backward(self, inputs: np.ndarray, fresh: np.ndarray, saved: list, dout: np.ndarray, grad: dict) -> None:
        p = self.p
        gates, h, c, ghc = saved
        r, z = gates[:, :, :HIDDEN], gates[:, :, HIDDEN : 2 * HIDDEN]
        to_z = (h - c) * z  # what does not depend on later steps is computed for all steps at once
        left = 1 - z
        to_z *= left
        to_c = left * (1 - c * c)
        to_r = ghc * r * (1 - r)
        dgx, dgh = (np.empty((*inputs.shape, 3 * HIDDEN), np.float32) for _ in range(2))
        dnext, back = np.zeros_like(dout[0]), p["Wh"].T
        for t in range(len(inputs) - 1, -1, -1):
            d = dout[t] + dnext
            g = dgh[t]
            dc = d * to_c[t]
            np.multiply(dc, to_r[t], out=g[:, :HIDDEN])
            np.multiply(d, to_z[t], out=g[:, HIDDEN : 2 * HIDDEN])
            np.multiply(dc, r[t], out=g[:, 2 * HIDDEN :])
            dgx[t, :, 2 * HIDDEN :] = dc
            d *= z[t]
            dnext = g @ back
            dnext += d
            dnext[fresh[t]] = 0
        dgx[:, :, : 2 * HIDDEN] = dgh[:, :, : 2 * HIDDEN]
        grad["Wh"] += h.reshape(-1, HIDDEN).T @ dgh.reshape(-1, 3 * HIDDEN)
        flat = dgx.reshape(-1, 3 * HIDDEN)
        ids = inputs.reshape(-1).astype(np.int16)
        grad["Wx"] += p["E"][ids].T @ flat
        grad["bx"] += flat.sum(0)
        de = flat @ p["Wx"].T
        order = np.argsort(ids, kind="stable")
        some, first = np.unique(ids[order], return_index=True)
        grad["E"][some] += np.add.reduceat(de[order], first, axis=0)


class Trainer:
    """Adam over windows of truncated backpropagation."""

    def __init__(self, net: Network, rate: float):
        self.net, self.rate, self.steps = net, rate, 0
        self.m, self.v = np.zeros_like(net.flat), np.zeros_like(net.flat)
        self.grad = Network(np.zeros_like(net.flat))

    def learn(self, ids: np.ndarray, first: np.ndarray) -> None:
        """ids: outputs of the tokens of documents in a row; first marks each document's first. They are cut into
        lanes that run side by side, a document over a cut goes on without what was before it. The last lane
        goes on with the first one's tokens until it is as long as the others, so all are learned from."""
        if not len(ids):
            return
        lanes = max(1, min(LANES, len(ids) // STEPS))
        steps = -(-len(ids) // lanes)
        at = np.arange(lanes * steps) % len(ids)
        y, new = ids[at].reshape(lanes, steps).T, first[at].reshape(lanes, steps).T
        x = np.zeros_like(y)  # a document begins after output 0
        x[1:] = y[:-1]
        x[new] = 0
        h = np.zeros((lanes, HIDDEN), np.float32)
        for at in range(0, steps, WINDOW):
            s = slice(at, min(at + WINDOW, steps))
            self.grad.flat[:] = 0
            out, saved = self.net.window(x[s], new[s], h)
            flat = out.reshape(-1, HIDDEN)
            _, dh = self.net.outputs(flat, y[s].reshape(-1), self.grad.p)
            self.net.backward(x[s], new[s], saved, dh.reshape(out.shape), self.grad.p)
            h = out[-1]
            self._step(len(flat))

    def _step(self, n: int) -> None:
        g = self.grad.flat / n
        norm = float(np.sqrt(g @ g))
        if norm > 1:
            g /= norm
        self.steps += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.01 * (g * g - self.v)
        rate = self.rate / (1 - 0.9**self.steps)
        self.net.flat -= rate * self.m / (np.sqrt(self.v / (1 - 0.99**self.steps)) + 1e-6)


def score_documents(net: Network, docs: list[np.ndarray]) -> np.ndarray:
    """ln p of each document, whole: outputs of its tokens in order. Documents are laid whole into lanes, the
    longest first into the emptiest; the state goes from window to window and is reset between documents."""
    total = np.zeros(len(docs))
    if not docs:
        return total
    lens = np.array([len(d) for d in docs])
    lanes = int(max(1, min(512, lens.sum() // max(1, lens.max()))))
    order = np.argsort(-lens, kind="stable")
    fill, plan = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
    import heapq

    for d in order:
        n, k = heapq.heappop(fill)
        plan[k].append(d)
        heapq.heappush(fill, (n + int(lens[d]), k))
    steps = max(sum(int(lens[d]) for d in p) for p in plan)
    y, of, new = np.zeros((lanes, steps), np.int32), np.full((lanes, steps), -1, np.int32), np.zeros((lanes, steps), bool)
    for k, p in enumerate(plan):
        at = 0
        for d in p:
            y[k, at : at + lens[d]], of[k, at : at + lens[d]], new[k, at] = docs[d], d, True
            at += lens[d]
    by_end = np.argsort([-sum(int(lens[d]) for d in p) for p in plan], kind="stable")
    y, of, new = y[by_end].T, of[by_end].T, new[by_end].T
    h = np.zeros((lanes, HIDDEN), np.float32)
    last = None
    stride = max(WINDOW, SCORED // lanes)
    for at in range(0, steps, stride):
        s = slice(at, min(at + stride, steps))
        n = int((of[at] >= 0).sum())  # lanes that go on, all in front
        x = np.zeros_like(y[s, :n])
        x[1:] = y[s, :n][:-1]
        if last is not None:
            x[0] = last[:n]
        x[new[s, :n]] = 0
        out, _ = net.window(x, new[s, :n], h[:n], keep=False)
        h, last = out[-1], y[s][-1]
        real = of[s, :n].reshape(-1)
        rows = np.flatnonzero(real >= 0)
        logp, _ = net.outputs(out.reshape(-1, HIDDEN)[rows], y[s, :n].reshape(-1)[rows])
        total += np.bincount(real[rows], weights=logp, minlength=len(docs))
    return total


def train(coded: DataFrame, round_: int, shards: int, start: np.ndarray, rate: float) -> np.ndarray:
    """One round over coded(h, ids), a row for each training document: each shard learns from its documents in the
    order of their hashes, beginning with the same weights, and the weights of all shards are averaged by
    the tokens they saw. Shards depend on hashes alone, so the result is the same however rows are laid out.

    Equal documents are counted before they are dealt out, and their copies go to shards in turn.
    """

    def learn(group: pa.Table) -> pa.Table:
        group = group.sort_by([("h", "ascending"), ("copy", "ascending")])
        docs = [np.frombuffer(x.as_py(), "<u2").astype(np.int32) for x in group.column("ids")]
        ids = np.concatenate(docs)
        first = np.zeros(len(ids), bool)
        first[np.cumsum([0, *map(len, docs[:-1])])] = True
        net = Network(start.copy())
        Trainer(net, rate).learn(ids, first)
        w = net.flat.astype(np.float64)
        return pa.table({"i": np.arange(len(w), dtype=np.int32), "w": w * len(ids), "n": np.full(len(w), float(len(ids)))})

    hashed = F.pmod(F.col("h"), F.lit(ROUNDS))
    equal = coded.where(hashed == round_).groupBy("h").agg(F.first("ids").alias("ids"), F.count("*").alias("copies"))
    dealt = equal.select("h", "ids", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    dealt = dealt.withColumn("shard", F.pmod(F.shiftright("h", 8) + F.col("copy"), F.lit(shards)))
    with freed_shuffles(coded.sparkSession):
        rows = dealt.groupBy("shard").applyInArrow(learn, "i int, w double, n double").groupBy("i").agg((F.sum("w") / F.sum("n")).alias("w")).toArrow()
    out = start.copy()
    if rows.num_rows:
        out[rows.column("i").to_numpy()] = rows.column("w").to_numpy()
    return out


def head_of(counts: DataFrame, most: int) -> tuple[list[bytes], np.ndarray]:
    """The most frequent tokens of counts(token, n), at most ``most``, by falling count. All with a count from
    some power of 2 on: how many there are is counted first, so no task sees more than it keeps."""
    power = F.length(F.bin("n"))
    sizes = {r.p: r["count"] for r in counts.groupBy(power.alias("p")).count().collect()}
    least, held = 65, 0
    while least > 1 and held + sizes.get(least - 1, 0) <= most:
        least -= 1
        held += sizes.get(least, 0)
    head = counts.where(power >= least).toArrow()
    tokens, n = [bytes(x) for x in head.column("token").to_pylist()], head.column("n").to_numpy().astype(np.int64)
    order = sorted(range(len(tokens)), key=lambda k: (-n[k], tokens[k]))
    return [tokens[k] for k in order], n[order]


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    base_score: sum of log10((c + 1) / (N + V + 1)) over the tokens, from counts over all training
    documents. score: the network's log10 probability of the whole document; a word that shares its
    output counts as that output times its add-one share among the words that share it. So every
    word of the corpus has a probability of its own, however many there are. Network and counts learn
    from all documents that are not held out, each once.

    Null texts are empty (just the end); rows with a null id train; repeated rows count each; an
    empty table gives an empty one, and with no training document all tokens are unknown. Scores
    don't depend on how rows are laid out, but for the order of sums.
    """
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    d = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), text.alias("text"), F.xxhash64(F.col(id_col).cast("string"), text).alias("h"))
    counts = Table(count_tokens(d.where(~F.col("held_out"))), "lm-counts").df
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ending = F.when(F.length("token") > ENDING, F.expr(f"substring(token, -{ENDING}, {ENDING})")).otherwise(F.col("token"))
    ends = counts.groupBy(ending.alias("e")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).orderBy(F.desc("n"), "e").limit(4 * CLASSES * CLASSES).collect()
    head, head_n = head_of(counts, HEAD)
    v = Vocabulary.of(head, head_n, total.n, total.v, [(bytes(r.e), r.n, r.v) for r in ends], CLASSES * CLASSES)
    shared = spark.sparkContext.broadcast(vars(v))  # plain values: executors need no copy of this package

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(**shared.value)
        for b in batches:
            size = pc.binary_length(b.column("text").cast(pa.binary())).to_numpy(zero_copy_only=False)
            cut = np.cumsum(size.astype(np.int64)) // TEXT_BYTES
            for k in np.unique(cut):
                i = np.flatnonzero(cut == k)
                yield _encode_batch(v, b.slice(int(i[0]), len(i)))

    kind = d.schema["id"].dataType.simpleString()
    keep = f"uid long, id {kind}, held_out boolean, h long"
    coded = d.select(F.monotonically_increasing_id().alias("uid"), "id", "held_out", "h", "text").mapInArrow(
        encode, keep + ", n_tokens long, n_head long, head_sum double, rest_sum double, ids binary, tail array<binary>, times array<int>"
    )
    coded = Table(coded, "lm-coded").df
    weights = Network.start(v.output_counts[1:], v.output_counts[0]).flat
    training = coded.where(~F.col("held_out")).select("h", "ids")
    for r in range(ROUNDS):
        weights = train(training, r, max(1, round(total.n / ROUNDS / SHARD)), weights, RATES[r])
    packed = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(packed.value)
        for b in batches:
            size = pc.binary_length(b.column("ids")).to_numpy(zero_copy_only=False)
            cut = np.cumsum(size.astype(np.int64)) // TEXT_BYTES
            for k in np.unique(cut):
                i = np.flatnonzero(cut == k)
                part = b.slice(int(i[0]), len(i))
                sums = score_documents(net, [np.frombuffer(x.as_py(), "<u2").astype(np.int32) for x in part.column("ids")])
                yield pa.RecordBatch.from_arrays([part.column("uid"), pa.array(sums)], ["uid", "net"])

    nets = coded.select("uid", "ids").mapInArrow(run, "uid long, net double")
    tail = coded.select("uid", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("uid", F.col("t.tail").alias("token"), F.col("t.times").alias("times"))
    known = tail.join(counts, "token", "left").select(
        "uid",
        (F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(1.0))).alias("tail_sum"),
        F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0).cast("long").alias("n_tail"),
        F.lit(0.0).alias("net"),
    )
    parts = known.unionByName(nets.select("uid", F.lit(0.0).alias("tail_sum"), F.lit(0).cast("long").alias("n_tail"), "net"))
    sums = parts.groupBy("uid").agg(*[F.sum(c).alias(c) for c in ("tail_sum", "n_tail", "net")])
    j = coded.drop("h", "ids", "tail", "times").join(Table(sums, "lm-sums").df, "uid")
    return j.select(
        "id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.col("n_tail")).alias("n_known"),
        F.lit(total.n).cast("long").alias("train_tokens"),
        (F.col("head_sum") + F.col("tail_sum") - F.col("n_tokens") * v.base_total).alias("base_score"),
        (F.col("net") / LN10 + F.col("rest_sum") + F.col("tail_sum")).alias("score"),
    )


class _Places(dict):
    """The words seen so far, numbered in the order in which they came."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _encode_batch(v: Vocabulary, b: pa.RecordBatch) -> pa.RecordBatch:
    """For each text its outputs, the sums that the known tokens give, and the tokens that the index lacks. What the
    vocabulary says of a word is looked up once a batch, however often it occurs."""
    places, found = _Places(), []
    for t in b.column("text").cast(pa.binary()):
        w = tokens(t.as_py())
        found.append(np.fromiter(map(places.__getitem__, w), np.int32, len(w)))
    words = list(places)
    n = np.array([len(x) for x in found], np.int64)
    starts = np.cumsum(n) - n  # each text has its end, so none is empty
    token = np.concatenate(found)
    del found, places
    out, shared = v.outputs(words)
    at = np.fromiter(map(v.index.get, words, repeat(-1)), np.int32, len(words))
    known, logs, rests = at >= 0, np.zeros(len(words)), np.zeros(len(words))
    logs[known] = v.log_count[at[known]]
    rests[shared] = logs[shared] - v.rest_total[out[shared]]
    rare = np.flatnonzero(~known[token])
    row = np.repeat(np.arange(len(n)), n)[rare]
    pair, times = np.unique(row * len(words) + token[rare], return_counts=True)
    offsets = np.searchsorted(pair, np.arange(len(n) + 1) * len(words)).astype(np.int32)
    tails = pa.array(words, pa.binary()).take(pa.array(pair % len(words)))
    ends = np.concatenate([[0], 2 * np.cumsum(n)]).astype(np.int32)
    ids = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(out.astype("<u2")[token])])
    keep = ["uid", "id", "held_out", "h"]
    return pa.RecordBatch.from_arrays(
        [
            *[b.column(k) for k in keep],
            pa.array(n),
            pa.array(np.add.reduceat(known[token].astype(np.int64), starts)),
            pa.array(np.add.reduceat(logs[token], starts)),
            pa.array(np.add.reduceat(rests[token], starts)),
            ids,
            pa.ListArray.from_arrays(pa.array(offsets), tails),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(times.astype(np.int32))),
        ],
        [*keep, "n_tokens", "n_head", "head_sum", "rest_sum", "ids", "tail", "times"],
    )
