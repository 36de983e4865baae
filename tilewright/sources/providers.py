"""Where tiles come from, and the states that a request for one ends in. A failed request is a row, never an error."""

from __future__ import annotations

import urllib.error
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.style import tile_url

Key = tuple[int, int, int]


@dataclass(frozen=True)
class Response:
    """status: data, not_found, cancelled or error."""

    status: str
    bytes: bytes | None = None
    error: str | None = None


class Provider(Protocol):
    minimum_zoom: int
    maximum_zoom: int
    cache_key: str
    cache_to_disk: bool

    def load(self, key: Key) -> Response: ...


@dataclass
class Memory:
    """Tiles in a map. The cache key tells which tiles and sizes there are, not what is in them."""

    tiles: dict[Key, bytes]
    minimum_zoom: int = 0
    maximum_zoom: int = 14
    cache_to_disk: bool = False

    @property
    def cache_key(self) -> str:
        h = 0
        for k in sorted(self.tiles):
            for part in (*k, len(self.tiles[k])):
                h = (h * 31 + part) % (1 << 32)
        return f"memory-{h:08x}"

    def load(self, key: Key) -> Response:
        b = self.tiles.get(key)
        return Response("not_found") if b is None else Response("data", b)

    def frame(self, spark: SparkSession, source: str) -> DataFrame:
        rows = [(source, *k, "data", bytearray(b)) for k, b in sorted(self.tiles.items())]
        return spark.createDataFrame(rows, "source string, z int, x bigint, y bigint, status string, bytes binary")


@dataclass
class Network:
    """Tiles by a URL template with {z}, {x} and {y}. get(url) -> (status code, body)."""

    template: str
    get: Callable[[str], tuple[int, bytes]]
    minimum_zoom: int = 0
    maximum_zoom: int = 14
    retries: int = 2
    cache_to_disk: bool = True
    sleep: Callable[[float], None] = field(default=lambda s: __import__("time").sleep(s))

    @property
    def cache_key(self) -> str:
        return self.template

    def load(self, key: Key) -> Response:
        z, x, y = key
        return self.fetch(self.template.replace("{z}", str(z)).replace("{x}", str(x)).replace("{y}", str(y)))

    def fetch(self, url: str) -> Response:
        """An empty answer, 204, 404 and 410 mean that there is no tile; 401 and 403 won't get better; all else is
        tried again after 250, 500, .. ms."""
        problem = ""
        for attempt in range(self.retries + 1):
            try:
                code, body = self.get(url)
            except (OSError, urllib.error.URLError) as e:
                problem = str(e)
            else:
                if code == 200:
                    return Response("data", body) if body else Response("not_found")
                if code in (204, 404, 410):
                    return Response("not_found")
                problem = f"status {code}"
                if code in (401, 403):
                    break
            if attempt < self.retries:
                self.sleep(0.25 * 2**attempt)
        return Response("error", error=problem)


def fetch_tiles(keys: DataFrame, provider: Network) -> DataFrame:
    """keys(source, z, x, y) -> tiles(source, z, x, y, status, bytes, error), fetched by the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [provider.fetch(u.as_py()) for u in b.column("url")]
            cols = [b.column(c) for c in ("source", "z", "x", "y")]
            cols += [pa.array([r.status for r in got], pa.string()), pa.array([r.bytes for r in got], pa.binary()), pa.array([r.error for r in got], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["source", "z", "x", "y", "status", "bytes", "error"])

    slim = keys.select("source", F.col("z").cast("int"), F.col("x").cast("long"), F.col("y").cast("long"), tile_url(F.lit(provider.template), F.col("z"), F.col("x"), F.col("y")).alias("url"))
    return slim.mapInArrow(run, "source string, z int, x bigint, y bigint, status string, bytes binary, error string")


def lookup(keys: DataFrame, tiles: DataFrame) -> DataFrame:
    """keys joined with the tiles there are; the others are not_found."""
    return keys.join(tiles, ["source", "z", "x", "y"], "left").withColumn("status", F.coalesce("status", F.lit("not_found")))


def shape_hash(parts: Column) -> Column:
    """h * 31 + part, modulo 2 ** 32, over an ordered array of longs."""
    return F.aggregate(parts, F.lit(0).cast("long"), lambda h, p: F.pmod(h * 31 + p, F.lit(1 << 32)))
