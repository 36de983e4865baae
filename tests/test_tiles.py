"""Keys, geometry, decoding, archives."""

import gzip

import pytest
from pyspark.sql import functions as F

from tilewright.functions import geometry as G
from tilewright.functions import tiles as T
from tilewright.operators import drawlist, joins
from tilewright.sources import mvt, pmtiles


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def L(v):  # noqa: N802
    return F.lit(v).cast("long")


def test_ancestors_and_fractions(spark):
    z = F.lit(14)
    assert one(spark, *T.ancestor(z, L(8802), L(5373), 12), *T.ancestor(z, L(8802), L(5373), 13)) == (2200, 1343, 4401, 2686)
    assert one(spark, *[T.wrap_x(F.lit(2), L(x)) for x in (-1, 4, 2)]) == (3, 0, 2)
    for (dz, dx, dy), (az, ax, ay), want in [((4, 5, 10), (3, 2, 5), (0.5, 0, 0.5)), ((4, 7, 6), (2, 1, 1), (0.75, 0.5, 0.25)), ((2, -1, 0), (1, 1, 0), (0.5, 0, 0.5))]:
        assert one(spark, *T.fraction(F.lit(dz), L(dx), L(dy), F.lit(az), L(ax), L(ay))) == want


@pytest.mark.parametrize(("size", "offset", "low", "high", "want"), [(512, -1, 0, 22, (9, 150, 150)), (256, -1, 0, 22, (10, 300, 300)), (256, 0, 0, 22, (10, 300, 300)), (512, -1, 0, 5, (5, 9, 9)), (512, -1, 14, 22, None)])
def test_data_keys(spark, size, offset, low, high, want):
    (k,) = one(spark, T.data_key(F.lit(10), L(300), L(300), T.raster_delta(size, offset), low, high, True))
    assert (None if k is None else tuple(k)) == want


ANCHORS = [(0, 0, 0, 0), (1, 0, 0, 1), (1, 0, 1, 2), (1, 1, 1, 3), (1, 1, 0, 4), (2, 0, 0, 5), (12, 3423, 1763, 19078479)]


def test_hilbert(spark):
    for z, x, y, want in ANCHORS:
        assert pmtiles.hilbert_id(z, x, y) == want and one(spark, T.hilbert_id(F.lit(z), L(x), L(y))) == (want,)
        assert pmtiles.zxy(want) == (z, x, y)
    ids = [pmtiles.hilbert_id(z, x, y) for z in range(5) for x in range(1 << z) for y in range(1 << z)]
    assert sorted(ids) == list(range(len(ids)))
    with pytest.raises(pmtiles.PmTilesError):
        pmtiles.hilbert_id(27, 0, 0)
    assert one(spark, T.hilbert_id(F.lit(27), L(0), L(0))) == (None,)


RECT = (0.0, 0.0, 100.0, 100.0)


def test_clip_line():
    assert G.clip_line([-10, 50, 110, 50], RECT) == [([0, 50, 100, 50], 10.0, False)]
    assert G.clip_line([10, 10, 20, 20], RECT) == [([10, 10, 20, 20], 0.0, False)]
    assert G.clip_line([-10, -10, -20, 50], RECT) == []
    two = G.clip_line([-10, 10, 110, 10, 110, 30, -10, 30], RECT)
    assert [r[0] for r in two] == [[0, 10, 100, 10], [100, 30, 0, 30]] and [r[1] for r in two] == [10, 150]
    ring = [50, 50, 150, 50, 150, 80, 50, 80]
    (run,) = G.clip_line(ring, RECT, close=True)
    assert run[0] == [100, 80, 50, 80, 50, 50, 100, 50] and run[1] == pytest.approx(180 - 260)
    assert G.clip_line([10, 10, 20, 10, 20, 20], RECT, close=True) == [([10, 10, 20, 10, 20, 20], 0.0, True)]


def test_clip_ring():
    assert G.clip_ring([-50, -50, 50, -50, 50, 50, -50, 50], RECT) is not None
    import numpy as np

    cut = G.clip_ring([-50, -50, 50, -50, 50, 50, -50, 50], RECT)
    assert mvt.shoelace(np.array(cut)) == 2500.0
    assert G.clip_ring([200, 200, 300, 200, 300, 300], RECT) is None


TILE = mvt.encode_tile(
    mvt.encode_layer("poi", [(1, mvt.commands_of(1, [[(100, 200)]]), {"name": "Berlin", "rank": 3, "capital": True, "low": -5, "none": None}, 42), (1, mvt.commands_of(1, [[(10, 10), (15, 5)]]), {}, 0)]),
    mvt.encode_layer("road", [(2, mvt.commands_of(2, [[(2, 2), (12, 2), (12, 12)]]), {"class": "a"}, None)]),
    mvt.encode_layer("land", [(3, mvt.commands_of(3, [[(0, 0), (10, 0), (10, 10), (0, 10)]]), {}, None), (2, [mvt.command(2, 1), 2, 2], {}, None), (2, mvt.commands_of(2, [[(1, 1)]]), {}, None)]),
)


def test_decode():
    rows = mvt.decode(TILE)
    assert [r["source_layer"] for r in rows] == ["poi", "poi", "road", "land"]
    a, b, road, land = rows
    assert a["fid"] == 42 and b["fid"] is None and dict(a["properties"])["rank"] == {"t": "int", "l": 3} and dict(a["properties"])["low"]["l"] == -5 and dict(a["properties"])["none"] == {"t": "null"}
    assert [p.tolist() for p in b["parts"]] == [[10, 10, 15, 5]] and road["parts"][0].tolist() == [2, 2, 12, 2, 12, 12]
    assert land["ring_areas"] == [100.0] and (land["minx"], land["maxy"]) == (0, 10)
    assert [r["source_layer"] for r in mvt.decode(gzip.compress(TILE), {"road": set()})] == ["road"] and mvt.decode(TILE, {"road": set()})[0]["properties"] == []


def test_decode_frame(spark):
    df = spark.createDataFrame([("s", 1, 0, 0, bytearray(TILE)), ("s", 1, 1, 0, bytearray(b"\x1a\xff")), ("s", 1, 1, 1, None), ("s", 2, 0, 0, bytearray(b"\x1f\x8bxx"))], "source string, z int, x bigint, y bigint, bytes binary")
    got = mvt.decode_tiles(df).collect()
    assert sorted((r.status, r.x) for r in got) == [("corrupt", 0), ("corrupt", 1)] + [("data", 0)] * 4
    assert mvt.prepared_size(mvt.decode_tiles(df).where("status = 'data'")).first().bytes > 128


def test_varints():
    assert mvt.varint(mvt.put_varint(-1), 0) == ((1 << 64) - 1, 10) and mvt.signed((1 << 64) - 1) == -1
    for bad in (b"\x80", b"\xff" * 11):
        with pytest.raises(mvt.Corrupt):
            mvt.varint(bad, 0)


TILES = {(z, x, y): f"{z}/{x}/{y}".encode() if (x + y) % 3 else b"same" for z in range(4) for x in range(1 << z) for y in range(1 << z)}


@pytest.mark.parametrize("leaf", [None, 7])
@pytest.mark.parametrize("compress", [False, True])
def test_archive(spark, tmp_path, leaf, compress):
    data = pmtiles.build_archive(TILES, leaf, compress)
    reads = []

    def read(offset, length):
        reads.append(offset)
        return data[offset : offset + length]

    a = pmtiles.Archive(read)
    assert all(a.tile(*k) == v for k, v in TILES.items()) and a.tile(4, 0, 0) is None and reads.count(0) == 1
    path = tmp_path / "a.pmtiles"
    path.write_bytes(data)
    got = {(r.z, r.x, r.y): bytes(r.bytes) for r in pmtiles.read_archive(spark, str(path), "s", 3).collect()}
    assert got == TILES
    with pytest.raises(pmtiles.PmTilesError):
        pmtiles.Header.parse(b"PMTiles\x02" + bytes(200))


def test_range_fetch():
    class Answer:
        def __init__(self, status, body):
            self.status, self.body = status, body

        def read(self):
            return self.body

        def __enter__(self):
            return self

        def __exit__(self, *a):
            pass

    assert pmtiles.url_reader("http://u", opener=lambda r: Answer(200, b"abcdef"))(2, 3) == b"cde"
    assert pmtiles.url_reader("http://u", opener=lambda r: Answer(206, b"cde"))(2, 3) == b"cde"
    with pytest.raises(pmtiles.PmTilesError):
        pmtiles.url_reader("http://u", opener=lambda r: Answer(200, b"a"))(2, 3)


def test_small_archives_and_ranges():
    import urllib.error

    class Answer:
        status = 200

        def __enter__(self):
            return self

        def __exit__(self, *a):
            pass

        def read(self):
            return b"abcdef"

    def opener(request):
        if "Range" in request.headers:
            raise urllib.error.HTTPError("http://u", 416, "beyond the end", {}, None)
        return Answer()

    assert pmtiles.url_reader("http://u", opener=opener)(2, 300) == b"cdef"
    data = pmtiles.build_archive(TILES, leaf_size=7)
    opened = []

    def read(offset, length):
        opened.append(offset)
        return data[offset : offset + length]

    whole = list(pmtiles.Archive(read).entries())
    for n in (1, 2, 5, 50):
        archive = pmtiles.Archive(read)
        cuts = archive.cuts(n)
        assert len(cuts) <= n + 1 and [e for a, b in zip(cuts, cuts[1:]) for e in archive.entries(a, b)] == whole
    archive = pmtiles.Archive(read)
    opened.clear()
    assert list(archive.entries(whole[0].tile_id, whole[0].tile_id + 1)) == whole[:1] and len(opened) <= 1


def test_culling_changes_nothing_that_shows(spark):
    """Clipped and unclipped lines are the same within the tile."""
    line = [(-300 + 40 * i, (i * 977) % 700 - 200) for i in range(30)]
    tile = mvt.encode_tile(mvt.encode_layer("road", [(2, mvt.commands_of(2, [line]), {}, None)], 512))
    data = mvt.decode_tiles(spark.createDataFrame([("s", 2, 1, 1, bytearray(tile))], "source string, z int, x bigint, y bigint, bytes binary"))
    display = joins.to_data_tiles(spark.range(64).select(F.lit(5).alias("z"), (F.col("id") % 8 + 8).alias("x"), (F.floor(F.col("id") / 8) + 8).alias("y")), "s", -3, 0, 2)
    placed = drawlist.placed(joins.overzoom(display, data))
    rect = drawlist.window(F.col("scale"), F.col("off_x"), F.col("off_y"))
    cut = drawlist.clipped(placed.where(drawlist.meets(rect)))
    seen = 0
    for r in cut.collect():
        want = [run for run, _, _ in G.clip_line([float(v) for p in line for v in p], tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(drawlist.window(F.lit(r.scale), F.lit(r.off_x), F.lit(r.off_y)))]).first()))]
        assert [pytest.approx(w, abs=1e-3) for w in want] == [list(p) for p in r.parts]
        seen += 1
    assert 3 < seen <= 64


def _counting(archive: bytes):
    """A reader of an archive that counts the leaves and tiles that are fetched."""
    h = pmtiles.Header.parse(archive)
    seen = {"leaves": 0, "tiles": 0}

    def read(offset: int, length: int) -> bytes:
        seen["leaves"] += h.leaf_offset <= offset < h.leaf_offset + h.leaf_length
        seen["tiles"] += offset >= h.data_offset
        return archive[offset : offset + length]

    return read, seen


def test_windows_are_exact_ranges():
    import random

    rng = random.Random(4)
    for _ in range(60):
        z = rng.randint(0, 6)
        (x0, x1), (y0, y1) = (sorted(rng.randint(-2, (1 << z) + 1) for _ in "ab") for _ in "xy")
        w = pmtiles.Window(z=(z, z), x=(x0, x1), y=(y0, y1))
        ranges = w.ranges()
        want = {pmtiles.hilbert_id(z, x, y) for x in range(max(x0, 0), min(x1, (1 << z) - 1) + 1) for y in range(max(y0, 0), min(y1, (1 << z) - 1) + 1)}
        assert {i for a, b in ranges for i in range(a, b)} == want and all(b < c for (_, b), (c, _) in zip(ranges, ranges[1:]))
    deep = pmtiles.Window(z=(26, 26), x=(12345, 12345678), y=(7, 2345678)).ranges()
    assert 0 < len(deep) <= pmtiles.MAX_RANGES and pmtiles.Window(z=(3, 2)).ranges() == []


def test_pushed_filters_open_few_leaves(monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, StringContains

    tiles = {(z, x, y): f"{z}/{x}/{y // 4}".encode() for z in range(7) for x in range(1 << z) for y in range(1 << z)}
    archive = pmtiles.build_archive(tiles, leaf_size=16)
    asked = {
        "one tile": ([EqualTo(("z",), 6), EqualTo(("x",), 9), EqualTo(("y",), 50)], lambda z, x, y: (z, x, y) == (6, 9, 50), 1),
        "a window": ([EqualTo(("z",), 6), GreaterThan(("x",), 15), LessThanOrEqual(("x",), 23), LessThanOrEqual(("y",), 7)], lambda z, x, y: z == 6 and 15 < x <= 23 and y <= 7, 6),
        "some zooms": ([In(("z",), (1, 3))], lambda z, x, y: z in (1, 3), 9),
        "nothing": ([GreaterThan(("z",), 6)], lambda z, x, y: False, 0),
    }
    for name, (filters, holds, leaves) in asked.items():
        read, seen = _counting(archive)
        reader = pmtiles._Reader({"content": "x", "partitions": "3"})
        monkeypatch.setattr(reader, "_archive", lambda read=read: pmtiles.Archive(read))
        rest = StringContains(("bytes",), "a")
        assert list(reader.pushFilters([*filters, rest])) == [rest]
        got = [r for p in reader.partitions() for r in reader.read(p)]
        assert sorted(r[:3] for r in got) == sorted(k for k in tiles if holds(*k)), name
        assert all(r[4] == tiles[r[:3]] for r in got)
        assert seen["leaves"] <= leaves * 2, (name, seen)  # the driver may open one to cut it, a task to read it
        assert seen["tiles"] <= len(got)


def test_filters_reach_the_source(spark, tmp_path):
    tiles = {(5, x, y): f"{x}".encode() for x in range(32) for y in range(32)}
    path = tmp_path / "t.pmtiles"
    path.write_bytes(pmtiles.build_archive(tiles, leaf_size=32))
    df = pmtiles.read_archive(spark, str(path), "s", 4).where("z = 5 and x between 3 and 4 and y in (1, 9) and tile_id > 0")
    assert sorted((r.x, r.y) for r in df.collect()) == [(3, 1), (3, 9), (4, 1), (4, 9)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan, plan
