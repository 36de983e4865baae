"""SentencePiece encoding by unigram Viterbi over a double-array trie, and exact decoding."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sent, text_or_empty

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: A character without a piece costs this much more than the worst piece; it becomes its UTF-8 bytes.
UNKNOWN_PENALTY = 10.0
#: Bounds of an executor's memory: characters cut into segments at once, segments searched at once, segments
#: whose pieces are remembered, and the longest that are. They change nothing in the result.
CHARS, SEARCHED, REMEMBERED, LONGEST = 2_000_000, 50_000, 300_000, 48


@dataclass
class DoubleArray:
    """A trie over bytes in two arrays: the child of node s by byte b is base[s] + b, if check there is s.
    value: the piece that ends in a node, or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @staticmethod
    def build(keys: dict[bytes, int]) -> DoubleArray:
        """Nodes are placed level by level, each at the first base where all of its children are free."""
        root: dict = {}
        for key, v in keys.items():
            node = root
            for b in key:
                node = node.setdefault(b, {})
            node[-1] = v
        size = 1 << 16
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = bytearray(size)
        used[0] = 1
        level, first = [(0, root)], 1
        while level:
            below = []
            for s, node in level:
                if -1 in node:
                    value[s] = node[-1]
                bs = sorted(b for b in node if b >= 0)
                if not bs:
                    continue
                at = max(1, first - bs[0])
                tries = 0
                while True:
                    if at + 256 >= size:
                        more = np.full(size, -1, np.int32)
                        base, check, value = np.concatenate([base, 0 * more]), np.concatenate([check, more]), np.concatenate([value, more])
                        used.extend(bytes(size))
                        size *= 2
                    if not any(used[at + b] for b in bs):
                        break
                    at += 1
                    tries += 1
                if tries > 64:  # the slots before are nearly full: don't look there again
                    first = max(first, at + bs[0] - 64)
                base[s] = at
                for b in bs:
                    used[at + b] = 1
                    check[at + b] = s
                    below.append((at + b, node[b]))
            level = below
        return DoubleArray(base, check, value)


@dataclass
class Model:
    trie: DoubleArray
    scores: np.ndarray
    #: What each id decodes to; white-space markers of ordinary pieces are spaces here.
    raw: list[bytes]
    #: The ids of the 256 byte pieces.
    byte_ids: np.ndarray
    unknown_score: float
    longest: int
    #: How texts are cut into segments that no piece crosses.
    cut: re.Pattern
    memory: dict[str, tuple[int, ...]] = field(default_factory=dict)

    @staticmethod
    def load(path: str = MODEL) -> Model:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        keys, raw, byte_ids, scores = {}, [], np.zeros(256, np.int32), np.zeros(n, np.float64)
        joins = newline = False
        for i in range(n):
            p, scores[i] = sp.id_to_piece(i), sp.get_score(i)
            if sp.is_byte(i):
                byte_ids[int(p[1:-1], 16)] = i
                raw.append(bytes([int(p[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                raw.append(b"")
            else:
                raw.append(p.replace(MARK, " ").encode())
                keys[p.replace(MARK, " ").encode()] = i
                joins |= MARK in p.lstrip(MARK)
                newline |= "\n" in p
        if joins:
            raise ValueError("pieces with a marker after other characters: texts can't be cut at spaces")
        stop = " " if newline else r" \n"
        cut = re.compile(rf" *[^{stop}]+| +" + ("" if newline else r"|\n"))
        ordinary = np.array(sorted(keys.values()))
        if (scores[ordinary] == np.round(scores[ordinary])).all():
            # ranks, not logarithms: by Zipf's law the piece of rank r has a probability in proportion to 1 / r
            harmonic = np.log(np.sum(1.0 / np.arange(1, len(ordinary) + 1)))
            scores[ordinary] = -np.log(1.0 - scores[ordinary]) - harmonic
        worst = scores[ordinary].min()
        return Model(DoubleArray.build(keys), scores, raw, byte_ids, worst - UNKNOWN_PENALTY, max(map(len, keys)), cut)

    # -- encoding -----------------------------------------------------------------------------------------

    def search(self, segments: list[str]) -> list[tuple[int, ...]]:
        """The best-scoring pieces of each segment; all segments take each step of the trie together.

        Segments are byte strings of the text as it is, with spaces for markers. best[:, i] is the
        score of the best split of the first i bytes. From each character's start the trie is
        walked until no segment goes on; a character that no piece begins with can be left as its
        bytes for the unknown score. Of equal scores the one whose last piece is longest wins.
        """
        out: list[tuple[int, ...]] = [()] * len(segments)
        coded = [s.encode("utf-8", "surrogatepass") for s in segments]
        order = sorted(range(len(coded)), key=lambda i: len(coded[i]))
        at = 0
        while at < len(order):
            # rows of like length; their table has a bounded number of cells
            width, to = len(coded[order[at]]), at
            while to < len(order) and to - at < SEARCHED:
                longer = len(coded[order[to]])
                if to > at and (longer > 2 * width + 8 or longer * (to - at) > 4_000_000):
                    break
                to += 1
            self._search([coded[i] for i in order[at:to]], order[at:to], out)
            at = to
        return out

    def _search(self, coded: list[bytes], where: list[int], out: list[tuple[int, ...]]) -> None:
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        n, lens = len(coded), np.array([len(c) for c in coded])
        width = int(lens.max(initial=0))
        x = np.zeros((n, width + 4), np.int32)
        for i, c in enumerate(coded):
            x[i, : len(c)] = np.frombuffer(c, np.uint8)
        starts = (x & 0xC0) != 0x80  # of a character
        best = np.full((n, width + 5), -np.inf)
        best[:, 0] = 0
        piece, back = np.full((n, width + 5), -1, np.int32), np.zeros((n, width + 5), np.int32)
        for i in range(width):
            rows = np.flatnonzero((lens > i) & starts[:, i] & (best[:, i] > -np.inf))
            if not len(rows):
                continue
            b0 = x[rows, i]
            size = np.where(b0 < 0x80, 1, np.where(b0 < 0xE0, 2, np.where(b0 < 0xF0, 3, 4)))
            self._better(best, piece, back, rows, i, i + size, best[rows, i] + self.unknown_score, -2)
            state = np.zeros(len(rows), np.int32)
            for k in range(i, min(width, i + self.longest)):
                nxt = base[state] + x[rows, k]
                ok = (check[nxt] == state) & (lens[rows] > k) & (base[state] > 0)
                rows, state = rows[ok], nxt[ok]
                if not len(rows):
                    break
                ends = value[state] >= 0
                if ends.any():
                    r, v = rows[ends], value[state[ends]]
                    self._better(best, piece, back, r, i, np.full(len(r), k + 1), best[r, i] + self.scores[v], v)
        for i, c in enumerate(coded):
            ids, e = [], len(c)
            while e > 0:
                p, s = int(piece[i, e]), int(back[i, e])
                ids.append([p] if p >= 0 else self.byte_ids[np.frombuffer(c[s:e], np.uint8)].tolist())
                e = s
            out[where[i]] = tuple(chain.from_iterable(reversed(ids)))

    @staticmethod
    def _better(best, piece, back, rows, start, ends, score, ids) -> None:
        up = score > best[rows, ends]
        r, e = rows[up], ends[up]
        best[r, e], back[r, e] = score[up], start
        piece[r, e] = ids[up] if isinstance(ids, np.ndarray) else ids

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text. Texts get a leading space (empty ones stay empty); long ones are cut at a
        segment's end, so no more than CHARS are in segments at a time."""
        held: list[tuple[int, list[str]]] = []
        size, done = 0, {}
        count = 0
        for number, t in enumerate(texts):
            count += 1
            t = " " + t if t else t
            at = 0
            while True:
                to = self._end(t, at)
                held.append((number, self.cut.findall(t[at:to])))
                size += to - at
                at = to
                if size >= CHARS:
                    yield from self._flush(held, done, number if at < len(t) else number + 1)
                    held, size = [], 0
                if at >= len(t):
                    break
        yield from self._flush(held, done, count)

    def _end(self, t: str, at: int) -> int:
        to = at + CHARS
        if to >= len(t):
            return len(t)
        while to > at + 1 and not (t[to] == " " and t[to - 1] != " "):  # a segment begins here
            to -= 1
        return to if to > at + 1 else len(t)

    def _flush(self, held: list[tuple[int, list[str]]], done: dict[int, list[np.ndarray]], upto: int) -> Iterator[np.ndarray]:
        memory = self.memory
        new = [s for s in set().union(*(segments for _, segments in held)) if s not in memory]
        if len(memory) + len(new) > REMEMBERED:
            memory.clear()
            new = list(set().union(*(segments for _, segments in held)))
        found = dict(zip(new, self.search(new)))
        memory.update((s, ids) for s, ids in found.items() if len(s) <= LONGEST)
        get = lambda s: memory.get(s) or found[s]
        for number, segments in held:
            ids = np.fromiter(chain.from_iterable(map(get, segments)), np.int32)
            done.setdefault(number, []).append(ids)
        for number in sorted(k for k in done if k < upto):
            parts = done.pop(number)
            yield parts[0] if len(parts) == 1 else np.concatenate(parts)

    def decode(self, ids: Iterable[int]) -> str:
        """The text: pieces with spaces for markers, byte pieces as the bytes they are, without the first space.
        A marker character that stood in the text came as bytes, so it comes back as itself."""
        return b"".join(map(self.raw.__getitem__, ids))[1:].decode("utf-8", "replace")

    def score(self, ids: np.ndarray) -> float:
        """The log score of a text's pieces; characters left as bytes count by the byte pieces' own scores."""
        return float(self.scores[ids].sum())


def encode(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True
) -> DataFrame:
    """(id, n_tokens, n_byte_tokens, ids_sha256, exact[, ids]) for each row of docs.

    ids_sha256 is over the ids as little-endian 32-bit numbers; exact tells whether decoding the ids
    gives the text again. Null texts are empty: no tokens. Repeated rows stay; an empty table
    gives an empty one.
    """
    spark = docs.sparkSession
    shared = sent(spark, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared()
        is_byte = np.zeros(len(m.raw), bool)
        is_byte[m.byte_ids] = True
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts = part.column("text").to_pylist()
                n, n_byte, sha, exact, ids = [], [], [], [], []
                for t, got in zip(texts, m.encode(texts)):
                    n.append(len(got))
                    n_byte.append(int(is_byte[got].sum()))
                    sha.append(hashlib.sha256(got.astype("<i4").tobytes()).hexdigest())
                    exact.append(m.decode(got.tolist()) == t)
                    if with_ids:
                        ids.append(got)
                cols = [part.column("id"), pa.array(n, pa.int64()), pa.array(n_byte, pa.int64()), pa.array(sha, pa.string()), pa.array(exact, pa.bool_())]
                names = ["id", "n_tokens", "n_byte_tokens", "ids_sha256", "exact"]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    slim = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    more = ", ids array<int>" if with_ids else ""
    return slim.mapInArrow(run, f"id {kind}, n_tokens long, n_byte_tokens long, ids_sha256 string, exact boolean{more}")
