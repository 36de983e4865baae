"""Tiles of a network source as a Spark data source: status rows, few requests at a time for each host, batch and stream."""

from __future__ import annotations

import urllib.error
import urllib.request
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .pmtiles import PUSHDOWN, WindowFilters, zxy
from .providers import Network

ROW = "z int, x bigint, y bigint, host string, url string, status string, bytes binary, error string"
#: Partitions of a host, and so requests to it at a time; tiles of one partition; tiles of one micro-batch.
PER_HOST, CHUNK, BATCH = 2, 64, 256


@dataclass
class _Tiles(InputPartition):
    ids: list[int]


def _get(url: str) -> tuple[int, bytes]:
    try:
        with urllib.request.urlopen(url, timeout=30) as r:
            return r.status, r.read()
    except urllib.error.HTTPError as e:
        return e.code, b""


class TileUrls:
    """The URL of each tile, by turns from the templates, which may be on several hosts."""

    def __init__(self, options):
        self.templates = options["templates"].split()
        self.network = Network("", _get, retries=int(options.get("retries", "2")))
        self.per_host = int(options.get("perhost", str(PER_HOST)))

    def url(self, z: int, x: int, y: int) -> str:
        template = self.templates[(x + y) % len(self.templates)]
        return template.replace("{z}", str(z)).replace("{x}", str(x)).replace("{y}", str(y))

    def dealt(self, ids: Iterator[int]) -> list[InputPartition]:
        """Tiles by host, each host's on no more than per_host partitions; a task asks for one after the other."""
        by_host: dict[str, list[int]] = defaultdict(list)
        for i in ids:
            by_host[urlsplit(self.url(*zxy(i))).netloc].append(i)
        return [_Tiles(part) for tiles in by_host.values() for k in range(self.per_host) if (part := tiles[k :: self.per_host])] or [_Tiles([])]

    def rows(self, partition: _Tiles) -> Iterator[tuple]:
        for i in partition.ids:
            z, x, y = zxy(i)
            url = self.url(z, x, y)
            r = self.network.fetch(url)
            yield z, x, y, urlsplit(url).netloc, url, r.status, r.bytes, r.error


class TileUrlSource(DataSource):
    """spark.read.format("tileurls"): a row for each tile of a window with what its request gave: data, not_found or error.

    Options: templates (URLs with {z}, {x} and {y}, with spaces between them), perhost, retries, minzoom, maxzoom, and for streams, batch, the
    tiles of a micro-batch. A read has to bound its tiles: by filters on z, x and y, which become the tiles to
    ask for, or by the zooms alone. A stream goes through the tiles of its zooms in the order of ids.
    """

    @classmethod
    def name(cls) -> str:
        return "tileurls"

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> DataSourceReader:
        return _UrlReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _UrlStream(self.options)


#: The most tiles that a read asks for.
MOST = 1 << 20


class _UrlReader(WindowFilters, DataSourceReader):
    def __init__(self, options):
        self.start(options)
        self.urls = TileUrls(options)

    def partitions(self) -> list[InputPartition]:
        ranges = self.window.ranges()
        if sum(b - a for a, b in ranges) > MOST:
            raise ValueError("more tiles than one read asks for; bound z, x and y")
        return self.urls.dealt(i for a, b in ranges for i in range(a, b) if self.asked(i))

    def read(self, partition) -> Iterator[tuple]:
        return self.urls.rows(partition)


class _UrlStream(WindowFilters, DataSourceStreamReader):
    def __init__(self, options):
        self.start(options)
        self.urls, self.batch = TileUrls(options), int(options.get("batch", str(BATCH)))
        self.ranges = self.window.ranges()
        self.ends = list(accumulate(b - a for a, b in self.ranges))
        self.at = 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"tile": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        self.at = min(self.at + self.batch, self.ends[-1] if self.ends else 0)
        return {"tile": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = max(self.at, end["tile"])  # after a restart
        spans = zip(self.ranges, [0, *self.ends])
        return self.urls.dealt(a + k - before for (a, b), before in spans for k in range(max(start["tile"], before), min(end["tile"], before + b - a)))

    def read(self, partition) -> Iterator[tuple]:
        return self.urls.rows(partition)

    def commit(self, end: dict) -> None:
        pass


def read_tiles(spark: SparkSession, templates: list[str], stream: bool = False, **options) -> DataFrame:
    """tiles(z, x, y, host, url, status, bytes, error) of a network source."""
    spark.dataSource.register(TileUrlSource)
    spark.conf.set(PUSHDOWN, "true")
    reader = (spark.readStream if stream else spark.read).format("tileurls").option("templates", " ".join(templates))
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()
