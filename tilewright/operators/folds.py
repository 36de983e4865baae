"""Order-dependent loops over groups, many groups to a task."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Rows = list[dict[str, Any]]


def fold(df: DataFrame, keys: list[str], order: list[str], step: Callable[[Rows], Iterable[tuple]], schema: str) -> DataFrame:
    """step() on each group's rows, in order, as dicts; its tuples make the result.

    Rows are dealt and sorted by Spark; a task goes through its groups one after the other and holds
    one group and one batch at a time. Groups are found by equal keys side by side, which costs far
    less for many small groups than a call of pandas for each. Rows with a null key are left out.
    """
    names = [c.strip().split(" ")[0].strip("`") for c in _split(schema)]
    for k in keys:
        df = df.where(df[k].isNotNull())
    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: Any = None
        held: Rows = []
        for pdf in batches:
            out: list[tuple] = []
            for row in pdf.to_dict("records"):
                k = tuple(row[c] for c in keys)
                if k != now:
                    if held:
                        out.extend(step(held))
                    now, held = k, []
                held.append(row)
            if out:
                yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame(list(step(held)), columns=names)

    return dealt.mapInPandas(run, schema)


def fold_columns(df: DataFrame, keys: list[str], order: list[str], step: Callable[[pa.Table, np.ndarray], list[pa.Array]], added: str) -> DataFrame:
    """df with the ``added`` columns that step() makes of whole groups: it gets a table of groups, each in order, and where
    each begins.

    Columns stay Arrow columns: what step() doesn't look at is handed on as it is. A task holds the groups of one batch
    and the one that goes on in the next. Rows with a null key are left out.
    """
    for k in keys:
        df = df.where(df[k].isNotNull())
    schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL(added).fields])
    names = schema.fieldNames()
    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def made(parts: list[pa.RecordBatch], starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts).combine_chunks()
        columns = [*(c.combine_chunks() for c in t.columns), *step(t, starts)]
        yield from pa.Table.from_arrays(columns, names).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # one group's rows, put together when it ends
        for b in batches:
            if not b.num_rows:
                continue
            if held and not all(pc.equal(held[-1].column(k)[-1], b.column(k)[0]).as_py() for k in keys):
                yield from made(held, np.zeros(1, int))
                held = []
            starts = _starts(b, keys)
            if len(starts) > 1:
                ended = starts[:-1] + sum(h.num_rows for h in held)
                ended[0] = 0
                yield from made([*held, b.slice(0, starts[-1])], ended)
                held = []
            held.append(b.slice(starts[-1]))
        if held:
            yield from made(held, np.zeros(1, int))

    return dealt.mapInArrow(run, schema)


def _starts(b: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where a batch's groups begin."""
    new = np.zeros(b.num_rows, bool)
    new[:1] = True
    for k in keys:
        c = b.column(k)
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return np.nonzero(new)[0]


def _split(schema: str) -> list[str]:
    """A schema's columns: commas within brackets don't count."""
    out, depth, now = [], 0, ""
    for c in schema:
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            out.append(now)
            now = ""
        else:
            now += c
    return [*out, now]
