"""Exact deduplication by Grace hashing: records are dealt to buckets by hashes, and buckets again, until each fits an
open-addressing table that compares whole texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import zip_longest

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Table

#: Bytes of texts that one table holds, and the most buckets that one shuffle deals records to.
BUCKET, BUCKETS = 32 << 20, 8192
#: The most spill files that records too many for one shuffle are dealt to at once.
COARSE = 256
#: Levels of hashing by other digits, after which what is still together are equal texts, and the fewest rows of a part
#: when those are dealt by row instead.
LEVELS, LEAST = 2, 16
WHITE = b" \t\n\v\f\r"


def normal(text: bytes) -> bytes:
    """Each run of white space is one space."""
    core = b" ".join(text.split())
    if not core:
        return b" " if text else b""
    return b" " * (text[0] in WHITE) + core + b" " * (text[-1] in WHITE)


class TextTable:
    """Open addressing with linear probing over hashes; equal hashes are told apart by the whole texts."""

    def __init__(self, slots: int = 1024):
        self.slots = np.full(slots, -1, np.int64)
        self.hashes: list[int] = []
        self.texts: list[bytes] = []
        self.names: list[int] = []
        self.bytes = 0

    def put(self, h: int, text: bytes, name: int) -> int:
        """The name of the equal text that came first, or this name, which stays."""
        mask = len(self.slots) - 1
        at = h & mask
        while (i := self.slots[at]) >= 0:
            if self.hashes[i] == h and self.texts[i] == text:
                return self.names[i]
            at = (at + 1) & mask
        self.slots[at] = len(self.names)
        self.hashes.append(h)
        self.texts.append(text)
        self.names.append(name)
        self.bytes += len(text)
        if 2 * len(self.names) > len(self.slots):
            self._grow()
        return name

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, np.int64)
        mask = len(self.slots) - 1
        for i, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = i


def _local(limit: int):
    """A task's rows (row struct, text) -> (row, name, rep, h, n, sha, text): rep is the name of an equal row of the task,
    and only rows that are their own rep carry a text. A table that is full is given up for an empty one: that costs
    records for the buckets, never a copy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 33
        table = TextTable()
        for batch in batches:
            names, reps, hashes, sizes, shas, texts = [], [], [], [], [], []
            for t in batch.column("text"):
                text = normal(t.as_py() or b"")
                h = xxhash.xxh64_intdigest(text)
                rep = table.put(h, text, name)
                own = rep == name
                names.append(name)
                reps.append(rep)
                hashes.append(h - (1 << 64) if h >> 63 else h)
                sizes.append(len(text))
                shas.append(hashlib.sha256(text).digest() if own else None)
                texts.append(text if own else None)
                name += 1
                if table.bytes > limit:
                    table = TextTable()
            columns = [batch.column("row"), pa.array(names, pa.int64()), pa.array(reps, pa.int64()), pa.array(hashes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(shas, pa.binary()), pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "name", "rep", "h", "n", "sha", "text"])

    return run


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket's records (rep, h, text) -> (rep, root): the rep whose equal text came first."""
    table = TextTable()
    for batch in batches:
        reps = batch.column("rep").to_pylist()
        roots = [table.put(h & 0xFFFF_FFFF_FFFF_FFFF, t.as_py(), r) for r, h, t in zip(reps, batch.column("h").to_pylist(), batch.column("text"))]
        yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(roots, pa.int64())], ["rep", "root"])


def _dealt(records: DataFrame, key: Column, n: int) -> DataFrame:
    """(rep, root) of records, each part of ``key`` by a table of its own."""
    return records.select("rep", "h", "text", key.alias("part")).repartitionById(n, F.col("part")).select("rep", "h", "text").mapInArrow(_bucket, "rep long, root long")


def _digit(level: int, n: int) -> Column:
    return F.pmod(F.xxhash64("h", F.lit(level)), F.lit(n)).cast("int")


def _resolve(records: DataFrame, bucket: int, buckets: int, level: int = 0) -> list[list[Table]]:
    """Links (rep, root) over records(rep, h, n, text), in rounds: tables of a round hold different reps, and a later
    round links roots of an earlier one.

    What is too much for one shuffle goes to spill files by a coarse digit of the hashes first, and each of
    them is taken by itself. A level deals records to buckets by a digit. Buckets that fit are done;
    the records of others go to a spill file in the shared folder and are dealt by another digit.
    Where digits have not told them apart, a bucket holds copies of few texts: it is dealt by row, so
    that no task meets all copies, and what is left of each part goes to the next round.
    """
    total, n = records.agg(F.sum("n"), F.count("*")).first()
    if not n:
        return []
    if level == 0 and total > bucket * buckets:
        coarse = min(COARSE, 2 * -(-total // (bucket * buckets)))
        dealt = records.withColumn("coarse", _digit(-1, coarse)).repartition(min(buckets, 32 * coarse), "coarse", F.pmod(F.xxhash64("rep"), F.lit(32)))
        spill = Table(dealt, "exact-coarse", "coarse")
        done = [_resolve(spill.df.where(F.col("coarse") == k).drop("coarse"), bucket, buckets, 1) for k in range(coarse)]
        return _after(spill, [[t for rounds in every for t in rounds or []] for every in zip_longest(*done)])
    parts = max(1, -(-total // bucket))
    digit = _digit(level, parts)
    sizes = records.groupBy(digit.alias("digit")).agg(F.sum("n").alias("bytes"), F.count("*").alias("rows"))
    over = sizes.where((F.col("bytes") > 2 * bucket) & (F.col("rows") > 1))
    if total <= bucket or over.isEmpty():
        return [[Table(_dealt(records, digit, parts), "exact-links")]]
    with_digit = records.withColumn("digit", digit)
    spill = Table(with_digit.join(over, "digit"), "exact-spill")
    done = Table(_dealt(with_digit.join(over, "digit", "left_anti"), F.col("digit"), parts), "exact-links")
    if level + 1 < LEVELS:
        rest = _resolve(spill.df.select("rep", "h", "n", "text"), bucket, buckets, level + 1)
        return _after(spill, [[done, *(rest[0] if rest else [])], *rest[1:]])
    pieces = F.least(F.ceil(F.col("bytes") / bucket), F.ceil(F.col("rows") / LEAST))
    part = F.pmod(F.xxhash64("digit", F.pmod(F.xxhash64("rep", F.lit(level)), pieces)), F.lit(2 * parts)).cast("int")
    links = Table(_dealt(spill.df, part, 2 * parts), "exact-links")
    left = spill.df.select("rep", "h", "n", "text").join(links.df.where("rep = root").select("rep"), "rep", "left_semi")
    rows, roots = links.df.agg(F.count("*"), F.count_if(F.col("rep") == F.col("root"))).first()
    if rows == roots or spill.df.agg(F.max("rows")).first()[0] <= LEAST:
        # few rows, or different texts: what is left meets in one table for each bucket
        rest = [[Table(_dealt(left, digit, parts), "exact-links")]]
    else:
        rest = _resolve(left, bucket, buckets, level + 1)
    return _after(spill, [[done, links], *rest])


def _after(spill: Table, made: list[list[Table]]) -> list[list[Table]]:
    spill.drop()
    return made


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), bucket: int = BUCKET, buckets: int = BUCKETS) -> DataFrame:
    """One row per document: row (a struct of the kept columns), id, keep_id, group_size, kept, sha256.

    Texts are equal if they are once each run of white space is one space; null counts as empty. The row
    with the smallest id stays, null ids last; of rows that repeat an id and a text exactly one does,
    though all have its keep_id. Ids keep their type; any that can be ordered will do. An empty
    table gives an empty table, and kept columns may have any name.

    Each task drops copies within its own input first, so a text that a third of all rows share reaches
    the buckets once a task, not once a row. What is shuffled after that are one record a
    text, and numbers.
    """
    kept = [F.col(f"`{c}`") for c in keep]
    struct = F.struct(*kept) if kept else F.lit(None).cast("int")
    row = F.struct(F.col(f"`{id_col}`").alias("id"), struct.alias("more"))
    rows = docs.select(row.alias("row"), F.encode(F.col(f"`{text_col}`").cast("string"), "UTF-8").alias("text"))
    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL("name long, rep long, h long, n long, sha binary, text binary")])
    local = Table(rows.mapInArrow(_local(bucket), schema), "exact-rows")

    records = local.df.where("text is not null").select("rep", "h", "n", "text")
    links = _resolve(records, bucket, buckets)
    ends = _ends(links, local.df)

    first = F.min(F.struct(F.col("row.id").isNull().alias("none"), F.col("row.id").alias("id"), F.col("name").alias("name"))).alias("first")
    by_rep = local.df.groupBy("rep").agg(first, F.count("*").alias("n"))
    groups = by_rep.join(ends, "rep").groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("group_size"))
    shas = local.df.where("sha is not null").select("rep", F.lower(F.hex("sha")).alias("sha256"))
    of_rep = ends.join(groups, "root").join(shas, "rep").select("rep", "first", "group_size", "sha256")
    got = local.df.select("row", "name", "rep").join(of_rep, "rep")
    return got.select(
        F.col("row.more").alias("row"), F.col("row.id").alias("id"), F.col("first.id").alias("keep_id"), "group_size", (F.col("name") == F.col("first.name")).alias("kept"), "sha256"
    )


def _ends(rounds: list[list[Table]], local: DataFrame) -> DataFrame:
    """(rep, root) with the rounds' links followed to their ends."""
    every = local.select("rep", F.col("rep").alias("root")).limit(0)
    for k, tables in enumerate(rounds):
        links = local.sparkSession.read.schema("rep long, root long").parquet(*[t.path for t in tables])
        if k == 0:
            every = links
            continue
        later = links.select(F.col("rep").alias("__rep"), F.col("root").alias("__root"))
        every = every.join(later, every.root == later["__rep"], "left").select("rep", F.coalesce("__root", "root").alias("root"))
    return every


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without exact copies: all its columns, texts as they were."""
    got = mark(docs, id_col, text_col, keep=docs.columns, **options)
    return got.where("kept").select("row.*")
