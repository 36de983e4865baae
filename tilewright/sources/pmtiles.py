"""PMTiles v3 archives: header, directories, lookups as a range join, and a Spark data source."""

from __future__ import annotations

import base64
import gzip
import struct
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from .cache import LruCache
from .mvt import put_varint, varint

HEADER = 127
#: First bytes read, which hold the header and the root directory.
FIRST = 16_384
MAX_LEVELS = 4
#: Leaf directories kept, and their bytes, of so many an entry.
LEAVES, LEAF_BYTES, ENTRY_BYTES = 32, 2 << 20, 48
NONE, GZIP = 1, 2
MAX_ZOOM = 26
Read = Callable[[int, int], bytes]


class PmTilesError(ValueError):
    pass


@dataclass(frozen=True)
class Header:
    root_offset: int
    root_length: int
    metadata_offset: int
    metadata_length: int
    leaf_offset: int
    leaf_length: int
    data_offset: int
    data_length: int
    internal_compression: int
    tile_compression: int
    tile_type: int
    min_zoom: int
    max_zoom: int

    @staticmethod
    def parse(b: bytes) -> Header:
        if len(b) < HEADER or b[:7] != b"PMTiles":
            raise PmTilesError("not a PMTiles archive")
        if b[7] != 3:
            raise PmTilesError(f"version {b[7]}")
        places = struct.unpack_from("<8Q", b, 8)
        _, internal, tile, kind, low, high = struct.unpack_from("<6B", b, 96)
        for c in (internal, tile):
            if c not in (0, NONE, GZIP):
                raise PmTilesError(f"compression {c}")
        return Header(*places, internal, tile, kind, low, high)

    def build(self) -> bytes:
        places = (self.root_offset, self.root_length, self.metadata_offset, self.metadata_length, self.leaf_offset, self.leaf_length, self.data_offset, self.data_length)
        head = b"PMTiles\x03" + struct.pack("<8Q", *places) + bytes(24) + struct.pack("<6B", 1, self.internal_compression, self.tile_compression, self.tile_type, self.min_zoom, self.max_zoom)
        return head + bytes(HEADER - len(head))


@dataclass(frozen=True)
class Entry:
    """run 0: a leaf directory; else the ids tile_id .. tile_id + run - 1 share these bytes."""

    tile_id: int
    offset: int
    length: int
    run: int


def inflate(b: bytes, compression: int) -> bytes:
    return gzip.decompress(b) if compression == GZIP or b[:2] == b"\x1f\x8b" else b


def directory(b: bytes) -> list[Entry]:
    """Columns one after the other: id deltas, runs, lengths, offsets (0: right after the entry before)."""
    n, at = varint(b, 0)
    columns = []
    for _ in range(4):
        column = []
        for _ in range(n):
            v, at = varint(b, at)
            column.append(v)
        columns.append(column)
    out: list[Entry] = []
    tile_id = 0
    for delta, run, length, offset in zip(*columns):
        tile_id += delta
        if offset == 0:
            if not out:
                raise PmTilesError("the first entry has no offset")
            place = out[-1].offset + out[-1].length
        else:
            place = offset - 1
        out.append(Entry(tile_id, place, length, run))
    return out


def build_directory(entries: list[Entry]) -> bytes:
    columns: list[list[int]] = [[], [], [], []]
    before = 0
    for i, e in enumerate(entries):
        follows = i > 0 and e.offset == entries[i - 1].offset + entries[i - 1].length
        for c, v in zip(columns, (e.tile_id - before, e.run, e.length, 0 if follows else e.offset + 1)):
            c.append(v)
        before = e.tile_id
    return put_varint(len(entries)) + b"".join(put_varint(v) for c in columns for v in c)


def hilbert_id(z: int, x: int, y: int) -> int:
    """The driver's twin of functions.tiles.hilbert_id."""
    if not 0 <= z <= MAX_ZOOM:
        raise PmTilesError(f"zoom {z} has no id")
    d, s = 0, (1 << z) >> 1
    while s:
        rx, ry = int(x & s > 0), int(y & s > 0)
        d += s * s * (3 * rx ^ ry)
        x, y = x & (s - 1), y & (s - 1)
        if not ry:
            if rx:
                x, y = s - 1 - x, s - 1 - y
            x, y = y, x
        s >>= 1
    return ((1 << 2 * z) - 1) // 3 + d


def zxy(tile_id: int) -> tuple[int, int, int]:
    """The tile of an id."""
    z = 0
    while tile_id >= 1 << 2 * z:
        tile_id -= 1 << 2 * z
        z += 1
    x = y = 0
    for k in range(z):
        s, q = 1 << k, tile_id >> 2 * k & 3
        rx, ry = q >> 1, (q ^ q >> 1) & 1
        if not ry:
            if rx:
                x, y = s - 1 - x, s - 1 - y
            x, y = y, x
        x, y = x + s * rx, y + s * ry
    return z, x, y


IdRange = tuple[int, int]


def _meeting(entries: list[Entry], ranges: list[IdRange] | None, end: int = 1 << 63) -> list[tuple[Entry, int]]:
    """Entries that meet one of the sorted id ranges, each with the id where the next one begins."""
    pairs = [(e, e.tile_id + e.run if e.run else after) for e, after in zip(entries, [*(e.tile_id for e in entries[1:]), end])]
    if ranges is None:
        return pairs
    ends = [b for _, b in ranges]
    at = [bisect_right(ends, e.tile_id) for e, _ in pairs]
    return [p for p, k in zip(pairs, at) if k < len(ranges) and ranges[k][0] < p[1]]


class Archive:
    """An archive behind a range reader."""

    def __init__(self, read: Read):
        self.read = read
        first = read(0, FIRST)
        self.header = Header.parse(first)
        h = self.header
        root = first[h.root_offset : h.root_offset + h.root_length]
        if len(root) < h.root_length:
            root = read(h.root_offset, h.root_length)
        self.root = directory(inflate(root, h.internal_compression))
        self.leaves = LruCache(LEAVES, LEAF_BYTES, lambda entries: ENTRY_BYTES * len(entries))

    def leaf(self, offset: int, length: int) -> list[Entry]:
        found = self.leaves.get((offset, length))
        if found is None:
            found = directory(inflate(self.read(self.header.leaf_offset + offset, length), self.header.internal_compression))
            self.leaves.put((offset, length), found)
        return found

    def entries(self, first: int = 0, last: int = 1 << 63, found: list[Entry] | None = None, level: int = 0) -> Iterator[Entry]:
        """The entries whose tiles meet the ids first .. last - 1, in id order. Only leaves that meet the range are opened."""
        if level >= MAX_LEVELS:
            raise PmTilesError("directories are nested too deep")
        here = self.root if found is None else found
        for e, end in zip(here, [*(e.tile_id for e in here[1:]), 1 << 63]):
            if e.run:
                if e.tile_id < last and first < e.tile_id + e.run:
                    yield e
            elif e.tile_id < last and end > first:
                yield from self.entries(first, last, self.leaf(e.offset, e.length), level + 1)

    def cuts(self, n: int, ranges: list[IdRange] | None = None) -> list[int]:
        """At most n + 1 ids that part the archive, or what of it meets the ranges, into ranges of about as many
        directory entries. The upper levels do if they have n entries, so the leaves of a large archive stay closed."""
        here = _meeting(self.root, ranges)
        for _ in range(MAX_LEVELS):
            if len(here) >= n or all(e.run for e, _ in here):
                break
            here = [x for e, end in here for x in ([(e, end)] if e.run else _meeting(self.leaf(e.offset, e.length), ranges, end))]
        size = max(1, -(-len(here) // n))
        return [*(e.tile_id for e, _ in here[::size]), 1 << 63] if here else []

    def find(self, tile_id: int) -> Entry | None:
        entries = self.root
        for _ in range(MAX_LEVELS):
            e = find(entries, tile_id)
            if e is None or e.run:
                return e
            entries = self.leaf(e.offset, e.length)
        return None

    def tile(self, z: int, x: int, y: int) -> bytes | None:
        """A tile's bytes, inflated; None where the archive has none."""
        if not self.header.min_zoom <= z <= self.header.max_zoom or z > MAX_ZOOM:
            return None
        e = self.find(hilbert_id(z, x, y))
        return self.bytes(e) if e else None

    def bytes(self, e: Entry) -> bytes | None:
        b = self.read(self.header.data_offset + e.offset, e.length) if e.length else b""
        return inflate(b, self.header.tile_compression) or None


def find(entries: list[Entry], tile_id: int) -> Entry | None:
    """The entry that holds an id: the last one not after it, if that is a leaf or its run reaches so far."""
    i = bisect_right(entries, tile_id, key=lambda e: e.tile_id) - 1
    if i < 0:
        return None
    e = entries[i]
    return e if e.run == 0 or tile_id < e.tile_id + e.run else None


def build_archive(tiles: dict[tuple[int, int, int], bytes], leaf_size: int | None = None, compress: bool = False, zooms: tuple[int, int] | None = None) -> bytes:
    """An archive of tiles; equal neighbours share an entry. leaf_size puts so many entries into each leaf."""
    data, entries = b"", []
    for tile_id, b in sorted((hilbert_id(*k), v) for k, v in tiles.items()):
        b = gzip.compress(b, mtime=0) if compress else b
        last = entries[-1] if entries else None
        if last and last.tile_id + last.run == tile_id and data[last.offset : last.offset + last.length] == b and b:
            entries[-1] = Entry(last.tile_id, last.offset, last.length, last.run + 1)
        else:
            entries.append(Entry(tile_id, len(data), len(b), 1))
            data += b
    pack = (lambda b: gzip.compress(b, mtime=0)) if compress else (lambda b: b)
    leaves, root = b"", entries
    if leaf_size:
        root = []
        for i in range(0, len(entries), leaf_size):
            leaf = pack(build_directory(entries[i : i + leaf_size]))
            root.append(Entry(entries[i].tile_id, len(leaves), len(leaf), 0))
            leaves += leaf
    root_bytes, meta = pack(build_directory(root)), pack(b"{}")
    low, high = zooms or (min(k[0] for k in tiles), max(k[0] for k in tiles))
    c = GZIP if compress else NONE
    at = HEADER + len(root_bytes)
    h = Header(HEADER, len(root_bytes), at, len(meta), at + len(meta), len(leaves), at + len(meta) + len(leaves), len(data), c, c, 1, low, high)
    return h.build() + root_bytes + meta + leaves + data


def lookup(ids: DataFrame, entries: DataFrame, block_bits: int = 12) -> DataFrame:
    """ids(tile_id, ..) joined with entries(first, run, offset, length) that hold them.

    A range join as an equi-join: an entry is given the blocks of 2 ** block_bits ids that its run
    touches, and an id its block.
    """
    last = F.col("first") + F.col("run") - 1
    blocks = F.sequence(F.shiftright("first", block_bits), F.shiftright(last, block_bits))
    e = entries.where("run > 0").withColumn("block", F.explode(blocks))
    i = ids.withColumn("block", F.shiftright("tile_id", block_bits))
    return i.join(e, "block").where((F.col("tile_id") >= F.col("first")) & (F.col("tile_id") < F.col("first") + F.col("run"))).drop("block")


def file_reader(path: str) -> Read:
    def read(offset: int, length: int) -> bytes:
        with open(path, "rb") as f:
            f.seek(offset)
            return f.read(length)

    return read


def url_reader(url: str, retries: int = 2, opener=None) -> Read:
    """Range requests. A server that ignores ranges will do if its answer covers the range; one that finds the range
    beyond a small archive's end (416) is asked for all of it."""
    import time
    import urllib.error
    import urllib.request

    open_url = opener or urllib.request.urlopen

    def read(offset: int, length: int) -> bytes:
        for attempt in range(retries + 1):
            try:
                request = urllib.request.Request(url, headers={"Range": f"bytes={offset}-{offset + length - 1}"})
                with open_url(request) as r:
                    body = r.read()
                    if r.status == 206:
                        return body
                if len(body) > offset:
                    return body[offset : offset + length]
                raise PmTilesError("the server gives no ranges")
            except urllib.error.HTTPError as e:
                if e.code == 416:
                    with open_url(urllib.request.Request(url)) as r:
                        return r.read()[offset : offset + length]
                if attempt == retries or e.code < 500:
                    raise
                time.sleep(0.25 * 2**attempt)
            except OSError:
                if attempt == retries:
                    raise
                time.sleep(0.25 * 2**attempt)
        return b""

    return read


#: Id ranges that a window is cut into at most; what is coarser is tested tile by tile.
MAX_RANGES = 4096


@dataclass(frozen=True)
class Window:
    """Bounds of tiles, both ends included."""

    z: tuple[int, int] = (0, MAX_ZOOM)
    x: tuple[int, int] = (0, (1 << MAX_ZOOM) - 1)
    y: tuple[int, int] = (0, (1 << MAX_ZOOM) - 1)
    tile_id: tuple[int, int] = (0, (1 << 63) - 1)

    def cut(self, column: str, low: int | None = None, high: int | None = None) -> Window:
        a, b = getattr(self, column)
        return replace(self, **{column: (a if low is None else max(a, low), b if high is None else min(b, high))})

    def holds(self, z: int, x: int, y: int, tile_id: int) -> bool:
        pairs = zip((self.z, self.x, self.y, self.tile_id), (z, x, y, tile_id))
        return all(a <= v <= b for (a, b), v in pairs)

    def ranges(self, low: int = 0, high: int = MAX_ZOOM) -> list[IdRange]:
        """Sorted, disjoint ranges of ids with all of the window's tiles of the zooms low .. high.

        A square of the Hilbert curve's grid holds ids without a gap. Squares within the window are taken
        whole, others are cut in four, zoom by zoom, until there are MAX_RANGES of them.
        """
        found: list[IdRange] = []
        for z in range(max(self.z[0], low), min(self.z[1], high) + 1):
            start, edge = ((1 << 2 * z) - 1) // 3, (1 << z) - 1
            box = max(0, self.x[0]), min(edge, self.x[1]), max(0, self.y[0]), min(edge, self.y[1])
            if box[0] > box[1] or box[2] > box[3]:
                continue
            whole: list[IdRange] = []
            squares = [(0, 0)]
            for level in range(z + 1):
                side = 1 << z - level
                cut = []
                for cx, cy in squares:
                    x, y = cx * side, cy * side
                    if x > box[1] or x + side <= box[0] or y > box[3] or y + side <= box[2]:
                        continue
                    first = start + (hilbert_id(level, cx, cy) - ((1 << 2 * level) - 1) // 3) * side * side
                    inside = box[0] <= x and x + side - 1 <= box[1] and box[2] <= y and y + side - 1 <= box[3]
                    if inside or len(squares) * 4 + len(whole) > MAX_RANGES:
                        whole.append((first, first + side * side))
                    else:
                        cut += [(2 * cx + i, 2 * cy + j) for i in (0, 1) for j in (0, 1)]
                squares = cut
            found += whole
        out: list[IdRange] = []
        for a, b in sorted(found):
            a, b = max(a, self.tile_id[0]), min(b, self.tile_id[1] + 1)
            if a < b:
                out[-1:] = [(out[-1][0], b)] if out and out[-1][1] == a else [*out[-1:], (a, b)]
        return out


@dataclass
class _Ranges(InputPartition):
    ranges: list[IdRange]


class PmTilesSource(DataSource):
    """spark.read.format("pmtiles").option("path", ..): a row (z, x, y, tile_id, bytes) for each tile.

    Options: partitions, minzoom, maxzoom, and in place of path content, a small archive in base64. The driver
    reads the header and the upper directories; each partition opens the leaves of its ranges. With
    ``spark.sql.python.filterPushdown.enabled`` comparisons of z, x, y and tile_id with numbers become id
    ranges, and only leaves and tiles within them are read.
    """

    @classmethod
    def name(cls) -> str:
        return "pmtiles"

    def schema(self) -> str:
        return "z int, x bigint, y bigint, tile_id bigint, bytes binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class WindowFilters:
    """Filters on tiles that a reader takes from Spark: its window, and values a column has to be among."""

    def start(self, options) -> None:
        self.window = Window(z=(int(options.get("minzoom", "0")), int(options.get("maxzoom", str(MAX_ZOOM)))))
        self.among: list[tuple[str, frozenset[int]]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes what bounds a column by a whole number; gives back all else."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if isinstance(f, IsNotNull) and column in ("z", "x", "y", "tile_id"):
                continue
            if column not in ("z", "x", "y", "tile_id"):
                yield f
            elif isinstance(f, In) and all(isinstance(v, int) for v in f.value):
                self.among.append((column, frozenset(f.value)))
                self.window = self.window.cut(column, min(f.value, default=1), max(f.value, default=0))
            elif not isinstance(getattr(f, "value", None), int):
                yield f
            elif isinstance(f, EqualTo):
                self.window = self.window.cut(column, f.value, f.value)
            elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.window = self.window.cut(column, low=f.value + isinstance(f, GreaterThan))
            elif isinstance(f, LessThan | LessThanOrEqual):
                self.window = self.window.cut(column, high=f.value - isinstance(f, LessThan))
            else:
                yield f

    def asked(self, tile_id: int) -> bool:
        z, x, y = zxy(tile_id)
        row = {"z": z, "x": x, "y": y, "tile_id": tile_id}
        return self.window.holds(z, x, y, tile_id) and all(row[c] in values for c, values in self.among)


class _Reader(WindowFilters, DataSourceReader):
    def __init__(self, options):
        self.path, self.content = options.get("path"), options.get("content")
        self.n = int(options.get("partitions", "8"))
        self.start(options)

    def _archive(self) -> Archive:
        if self.content:
            held = base64.b64decode(self.content)
            return Archive(lambda offset, length: held[offset : offset + length])
        return Archive(url_reader(self.path) if "://" in self.path and not self.path.startswith("file:") else file_reader(self.path.removeprefix("file://")))

    def partitions(self) -> list[InputPartition]:
        archive = self._archive()
        ranges = self.window.ranges(archive.header.min_zoom, archive.header.max_zoom)
        cuts = archive.cuts(self.n, ranges)
        dealt = [[(max(a, first), min(b, last)) for first, last in ranges if max(a, first) < min(b, last)] for a, b in zip(cuts, cuts[1:])]
        return [_Ranges(r) for r in dealt if r] or [_Ranges([])]

    def read(self, partition):
        archive = self._archive() if partition.ranges else None
        for first, last in partition.ranges:
            for e in archive.entries(first, last):
                ids = [i for i in range(max(e.tile_id, first), min(e.tile_id + e.run, last)) if self.asked(i)]
                b = archive.bytes(e) if ids else None
                if b is not None:
                    for i in ids:
                        yield *zxy(i), i, b


PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def read_archive(spark: SparkSession, path: str | None, source: str, partitions: int = 8, content: bytes | None = None) -> DataFrame:
    """tiles(source, z, x, y, tile_id, status, bytes) of an archive: at a path or URL, or a small one's bytes. Filters on z, x, y and
    tile_id decide what of it is read; the session is set to hand them to data sources in Python."""
    spark.dataSource.register(PmTilesSource)
    spark.conf.set(PUSHDOWN, "true")
    where = ("path", path) if content is None else ("content", base64.b64encode(content).decode())
    got = spark.read.format("pmtiles").option(*where).option("partitions", str(partitions)).load()
    return got.select(F.lit(source).alias("source"), "z", "x", "y", "tile_id", F.lit("data").alias("status"), "bytes")


def delta_ids(deltas: Column) -> Column:
    """Ids of an array of deltas."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("all"))
    return F.aggregate(deltas, zero, lambda a, d: F.struct((a["at"] + d).alias("at"), F.concat(a["all"], F.array(a["at"] + d)).alias("all")), lambda a: a["all"])
