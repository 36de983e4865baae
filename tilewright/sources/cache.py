"""Byte caches: in memory by use, on disk by age; and their budgets as windows over a snapshot."""

from __future__ import annotations

import os
import time
from collections import OrderedDict
from collections.abc import Callable, Hashable
from functools import reduce
from operator import and_
from pathlib import Path
from typing import Any, Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class ByteCache(Protocol):
    def get(self, key: str) -> bytes | None:
        """Fresh bytes only."""

    def get_stale(self, key: str) -> bytes | None: ...

    def put(self, key: str, value: bytes) -> None: ...


def fnv1a(key: str) -> str:
    """64-bit FNV-1a of the UTF-8 bytes, in hex."""
    h = 0xCBF29CE484222325
    for b in key.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


class DiskCache:
    """Files named by a hash of their key. Fresh for ttl seconds after they are written; the oldest go when the
    folder grows over max_bytes. Writes go to another file first, which is then renamed."""

    _open: dict[str, DiskCache] = {}

    def __init__(self, folder: str, ttl: float, max_bytes: int, clock: Callable[[], float] = time.time):
        self.folder, self.ttl, self.max_bytes, self.clock = Path(folder), ttl, max_bytes, clock
        self.folder.mkdir(parents=True, exist_ok=True)

    @classmethod
    def shared(cls, folder: str, ttl: float, max_bytes: int) -> DiskCache:
        """One cache per folder."""
        return cls._open.setdefault(os.path.realpath(folder), cls(folder, ttl, max_bytes))

    def _file(self, key: str) -> Path:
        return self.folder / fnv1a(key)

    def get(self, key: str) -> bytes | None:
        try:
            fresh = self.clock() - self._file(key).stat().st_mtime <= self.ttl
            return self._file(key).read_bytes() if fresh else None
        except OSError:
            return None

    def get_stale(self, key: str) -> bytes | None:
        try:
            return self._file(key).read_bytes()
        except OSError:
            return None

    def put(self, key: str, value: bytes) -> None:
        part = self._file(key).with_suffix(".part")
        try:
            part.write_bytes(value)
            now = self.clock()
            os.utime(part, (now, now))
            part.rename(self._file(key))
        except OSError:
            return
        self.sweep()

    def sweep(self) -> None:
        files = sorted((f.stat().st_mtime, f.name, f.stat().st_size, f) for f in self.folder.iterdir() if f.is_file())
        total = sum(x[2] for x in files)
        for _, _, size, f in files:
            if total <= self.max_bytes:
                break
            f.unlink(missing_ok=True)
            total -= size


class LruCache:
    """Keeps what was used last within a number of entries and a cost; one entry may cost more than the budget."""

    def __init__(self, max_entries: int, max_cost: float | None = None, cost: Callable[[Any], float] | None = None, on_evict: Callable[[Hashable, Any], None] | None = None):
        self.max_entries, self.max_cost, self.cost_of, self.on_evict = max_entries, max_cost, cost or (lambda _: 1), on_evict
        self.items: OrderedDict[Hashable, Any] = OrderedDict()
        self.cost = 0.0

    def get(self, key: Hashable) -> Any:
        if key in self.items:
            self.items.move_to_end(key)
        return self.items.get(key)

    def peek(self, key: Hashable) -> Any:
        return self.items.get(key)

    def put(self, key: Hashable, value: Any) -> None:
        self.remove(key)
        self.items[key] = value
        self.cost += self.cost_of(value)
        self._trim()

    def remove(self, key: Hashable) -> None:
        if key in self.items:
            self._gone(key)

    def remove_where(self, test: Callable[[Hashable, Any], bool]) -> None:
        for k in [k for k, v in self.items.items() if test(k, v)]:
            self._gone(k)

    def clear(self) -> None:
        self.remove_where(lambda k, v: True)

    def set_max_cost(self, max_cost: float | None) -> None:
        self.max_cost = max_cost
        self._trim()

    def _gone(self, key: Hashable) -> None:
        value = self.items.pop(key)
        self.cost -= self.cost_of(value)
        if self.on_evict:
            self.on_evict(key, value)

    def _trim(self) -> None:
        while len(self.items) > self.max_entries or (self.max_cost is not None and self.cost > self.max_cost and len(self.items) > 1):
            self._gone(next(iter(self.items)))


#: A group's rows are summed in so many ranges of their order; a range is one task's work, a group is not.
RANGES = 1024


def running_sums(rows: DataFrame, by: list[str], order: list[str], cost: str) -> DataFrame:
    """rows with ``__sum``, what their group costs up to them from the last in ``order`` on, null if no cost is known, and ``__n``,
    their number in it.

    The first column of the order, a number, is cut into ranges of equal width. Only the ranges' sums and counts meet in
    one window for each group.
    """
    at = F.col(order[0]).cast("double")
    whole = rows.agg(F.min(at).alias("__low"), F.nullif(F.max(at) - F.min(at), F.lit(0.0)).alias("__width"))
    share = F.coalesce(F.nanvl((at - F.col("__low")) / F.col("__width"), F.lit(0.0)), F.lit(0.0))
    placed = rows.crossJoin(F.broadcast(whole)).select(*rows.columns, F.when(at.isNull(), -1).otherwise(F.floor(share * RANGES).cast("int")).alias("__range"))
    ranges = placed.groupBy(*by, "__range").agg(F.sum(cost).alias("__s"), F.count("*").alias("__c"))
    before = Window.partitionBy(*by).orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*by, "__range", F.sum("__s").over(before).alias("__s"), F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__c"))
    w = Window.partitionBy(*by, "__range").orderBy(*[F.desc(c) for c in order])
    own = placed.withColumn("__sum", F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__n", F.row_number().over(w))
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "__range"]]
    both = own.alias("o").join(ranges.alias("b"), reduce(and_, same))
    return both.select(*[F.col(f"o.{c}") for c in rows.columns], F.coalesce(F.col("__sum") + F.col("__s"), "__sum", "__s").alias("__sum"), (F.col("__n") + F.col("__c")).alias("__n"))


def within_budget(entries: DataFrame, by: list[str], used: str, cost: str, max_cost: float, max_entries: int | None = None, always: int = 1) -> DataFrame:
    """The entries, of each group ``by``, that stay when those unused longest go until the rest fits: running sums from
    the last used on. The ``always`` last used stay whatever they cost."""
    kept = (F.col("__sum") <= max_cost) | (F.col("__n") <= always)
    if max_entries is not None:
        kept = kept & (F.col("__n") <= max_entries)
    return running_sums(entries, by, [used], cost).where(kept).drop("__sum", "__n")


def after_sweep(files: DataFrame, by: list[str], age_order: list[str], size: str, cap: float) -> DataFrame:
    """The files, of each group, that stay when the oldest are deleted until the rest is within the cap."""
    # what is left if this file is the oldest one kept; the file goes while that is over the cap
    return running_sums(files, by, age_order, size).where(F.col("__sum") <= cap).drop("__sum", "__n")
