"""Caches, providers, label state, styles: rules with an injected clock."""

import json

import pytest
from pyspark.sql import functions as F

from tilewright.plans import style
from tilewright.sources.cache import DiskCache, LruCache, after_sweep, fnv1a, within_budget
from tilewright.sources.providers import Memory, Network, fetch_tiles, lookup
from tilewright.streaming import labels


def test_fades():
    f = labels.Fades(100)
    assert f.frame(0, {"a"}) == {"a": 0.0}
    assert f.frame(25, {"a", "b"}) == {"a": 0.25, "b": 0.0}
    assert f.frame(125, {"a"}) == {"a": 1.0}
    assert f.frame(175, set()) == {"a": 0.5}
    assert f.frame(225, set()) == {}


def test_throttle_memory_retry():
    t = labels.Throttle(300)
    assert [t.place(n, g) for n, g in [(0, 1), (100, 1), (299, 1), (300, 1), (310, 2), (305, 2)]] == [True, False, False, True, True, True]
    m = labels.Memory()
    m.begin()
    a = m.sitting("k", 0, 0)
    assert m.lookup("k", 31, 0) is a and m.lookup("k", 32, 0) is None and m.lookup("q", 0, 0) is None
    for _ in range(90):
        m.begin()
    assert m.lookup("k", 0, 0) is a
    m.begin()
    assert m.lookup("k", 0, 0) is None
    r = labels.Retry(2, 10)
    assert [r.may(0), r.may(5), r.may(10), r.may(30)] == [True, False, True, False]
    r.progress()
    assert r.may(30)


def test_streams_follow_the_batch_rules(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("s1", 0, "a"), ("s1", 25, "a"), ("s1", 25, "b"), ("s2", 0, "a"), ("s1", 75, "b"), ("s2", 300, "b")]
    df = spark.createDataFrame(rows, "session string, frame long, key string")
    src = str(tmp_path / "in")
    df.where("frame < 50").coalesce(1).write.parquet(src)
    stream = labels.fade_stream(spark.readStream.schema(df.schema).parquet(src), 100)
    q = stream.writeStream.format("memory").queryName("fades").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    try:
        q.processAllAvailable()
        df.where("frame >= 50").coalesce(1).write.mode("append").parquet(src)
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted(map(tuple, spark.table("fades").collect()))
    want = sorted(map(tuple, labels.fade_states(df, "session", "frame", "key", 100).collect()))
    assert got == want


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def streamed(spark, tmp_path, df, made, parts, expected, wait=40):
    """What a stream makes of df, part after part, with a restart between the first and the others; it ends when as many
    rows as expected are there."""
    import time

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df.where(parts[0]).coalesce(1).write.parquet(src)
    schema = made(spark.readStream.schema(df.schema).parquet(src)).schema
    count = lambda: spark.read.schema(schema).parquet(out).count() if (tmp_path / "out" / "_spark_metadata").exists() else 0
    for k in range(2):
        stream = made(spark.readStream.schema(df.schema).parquet(src))
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="0 seconds").start()
        try:
            for p in parts[1:] if k else ():
                df.where(p).coalesce(1).write.mode("append").parquet(src)
                time.sleep(1)
            end = time.time() + wait
            while q.isActive and count() < (expected if k else 1) and time.time() < end:
                time.sleep(0.5)
            assert q.exception() is None
        finally:
            q.stop()
    return sorted(map(tuple, spark.read.schema(schema).parquet(out).collect()))


def test_fades_tick_without_input(spark, tmp_path):
    rows = [("s1", 0, "a"), ("s1", 25, "a"), ("s1", 25, "b"), ("s2", 0, "a"), ("s1", 400, "b"), ("s1", 430, "c"), ("s2", 300, "b"), ("s3", 1000, "a")]
    df = spark.createDataFrame(rows, "session string, frame long, key string")
    want = sorted(map(tuple, labels.fade_states(df, "session", "frame", "key", 100, tick=20).collect()))
    plain = {r[:3] for r in labels.fade_states(df, "session", "frame", "key", 100).collect()}
    assert plain < {w[:3] for w in want} and ("s3", 1100, "a", 1.0) in want
    got = streamed(spark, tmp_path, df, lambda d: labels.fade_stream(d, 100, tick=20, tick_ms=20), ["frame < 30", "frame >= 30 and frame < 420", "frame >= 420"], len(want))
    assert [(g[:3]) for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) < 1e-9 for g, w in zip(got, want))


def test_passes_run_when_they_are_due(spark, tmp_path):
    rows = [("s", 0, 1), ("s", 100_000, 1), ("s", 250_000, 1), ("s", 900_000, 1), ("s", 950_000, 2), ("s", 1_000_000, 2), ("t", 5, 1), ("t", 400_000, 1), ("u", 7, 1), ("u", 8, 1)]
    df = spark.createDataFrame(rows, "session string, time long, generation long")
    want = sorted(map(tuple, labels.passes(df, "session", "time", "generation", 300_000).collect()))
    assert [w[1] for w in want if w[0] == "s" and w[4]] == [300_000, 1_250_000] and [w[1] for w in want if w[0] == "u" and w[4]] == [300_007]
    got = streamed(spark, tmp_path, df, lambda d: labels.pass_stream(d, 300_000), ["time < 300000", "time between 300000 and 920000", "time > 920000"], len(want))
    assert got == want


def test_memory_stream(spark, tmp_path):
    import random

    rng = random.Random(8)
    rows = [(f"s{rng.randint(0, 1)}", f, rng.choice("abc"), float(rng.randint(0, 120)), float(rng.randint(0, 40))) for f in [*range(0, 60), *range(100, 130), *range(300, 320)] for _ in range(3)]
    df = spark.createDataFrame(rows, "session string, frame long, key string, x double, y double")
    want = sorted(map(tuple, labels.key_sightings(df).collect()))
    assert max(w[5] for w in want) > 3
    got = streamed(spark, tmp_path, df, labels.memory_stream, ["frame < 40", "frame between 40 and 109", "frame > 109"], len(want))
    assert got == want


def test_disk_cache(tmp_path):
    now = [1000.0]
    c = DiskCache(str(tmp_path), 60, 10, lambda: now[0])
    c.put("a", b"12345")
    assert c.get("a") == b"12345" and fnv1a("") == "cbf29ce484222325"
    now[0] += 61
    assert c.get("a") is None and c.get_stale("a") == b"12345"
    c.put("b", b"123456")
    assert c.get_stale("a") is None and c.get("b") == b"123456" and c.get_stale("q") is None


def test_lru():
    gone = []
    c = LruCache(2, 10, len, lambda k, v: gone.append(k))
    for k, v in (("a", "111"), ("b", "22"), ("a", "11"), ("c", "1")):
        c.put(k, v)
    assert gone == ["a", "b"] and list(c.items) == ["a", "c"]
    c.get("a")
    c.put("big", "x" * 50)
    assert list(c.items) == ["big"] and c.cost == 50
    c.clear()
    assert c.cost == 0 and c.peek("big") is None


def test_providers(spark):
    m = Memory({(0, 0, 0): b"x", (1, 0, 1): b"yy"})
    assert m.load((0, 0, 0)).status == "data" and m.load((5, 0, 0)).status == "not_found" and m.cache_key == Memory(dict(reversed(m.tiles.items()))).cache_key
    keys = spark.createDataFrame([("s", 0, 0, 0), ("s", 3, 0, 0)], "source string, z int, x bigint, y bigint")
    assert sorted(r.status for r in lookup(keys, m.frame(spark, "s")).collect()) == ["data", "not_found"]
    waits = []
    answers = {"a/0/0/0": [(500, b""), (200, b"t")], "a/1/0/0": [(404, b"")], "a/2/0/0": [(403, b"")], "a/3/0/0": [(200, b"")]}
    n = Network("a/{z}/{x}/{y}", lambda u: answers[u].pop(0), sleep=waits.append)
    assert [n.load((z, 0, 0)).status for z in range(4)] == ["data", "not_found", "error", "not_found"] and waits == [0.25]
    remote = Network("u/{z}/{x}/{y}", lambda u: (200, u.encode()))
    assert {bytes(r.bytes) for r in fetch_tiles(keys, remote).collect()} == {b"u/0/0/0", b"u/3/0/0"}


STYLE = {
    "version": 8, "name": "S", "center": [11.5, 48.1], "zoom": 12, "sprite": "sprites/main?v=1", "layers": [],
    "sources": {
        "a": {"type": "vector", "url": "tiles.json", "maxzoom": 10}, "b": {"type": "vector", "url": "pmtiles://https://x.example/a.pmtiles", "attribution": '&copy; <a href="https://o.example/">Open  Map</a> , all'},
        "c": {"type": "raster", "tiles": ["../r/{z}/{x}/{y}.png"], "tileSize": 256}, "d": {"type": "geojson"}, "e": {"type": "vector", "url": "broken.json"}, "f": {"type": "vector"},
    },
}
FILES = {
    "https://h.example/s/style.json": json.dumps(STYLE), "https://h.example/s/tiles.json": json.dumps({"tiles": [5, "t/{z}/{x}/{y}?key={key}"], "maxzoom": 12, "minzoom": 2}),
    "https://h.example/s/sprites/main.json?v=1": json.dumps({"pin": {"x": 0, "y": 0, "width": 8, "height": 9, "sdf": True}, "bad": {"x": "0"}}),
}


def test_style_reader():
    s = style.read_style("https://h.example/s/style.json", lambda u: FILES[u].encode(), "K")
    assert set(s.sources) == {"a", "b", "c"}
    assert (s.sources["a"].template, s.sources["a"].minzoom, s.sources["a"].maxzoom) == ("https://h.example/s/t/{z}/{x}/{y}?key=K", 2, 10)
    assert s.sources["b"].archive == "https://x.example/a.pmtiles" and s.sources["c"].template == "https://h.example/r/{z}/{x}/{y}.png" and s.sources["c"].maxzoom == 22
    assert s.center == (48.1, 11.5) and s.sprites == [("pin", 0.0, 0.0, 8.0, 9.0, 1.0, True)]
    assert s.attributions[0].text == "© Open Map, all" and s.attributions[0].spans[1] == ("Open Map", "https://o.example/")
    with pytest.raises(style.StyleError):
        style.read_style("x", lambda u: b'{"sources": {}}')
    own = style.read_style("https://h.example/s/style.json", lambda u: FILES[u].encode(), resolve_provider=lambda i: "mine" if i == "d2" else None)
    assert own.sources["b"].provider is None


def test_urls():
    assert style.redact("https://x/?api_key=abc&z=1") == "https://x/?api_key=***&z=1"
    assert style.expand("mapbox://styles/u/i", "T").endswith("/styles/v1/u/i?access_token=T")
    assert style.with_suffix("https://x/s?k=1", "@2x.json") == "https://x/s@2x.json?k=1"


def test_stale_is_served_and_reported(tmp_path):
    now, asked, stale = [0.0], [], []
    c = DiskCache(str(tmp_path), 10, 1000, lambda: now[0])
    get = style.cached(lambda u: asked.append(u) or b"v", c, stale.append)
    assert [get("u"), get("u")] == [b"v", b"v"] and asked == ["u"] and not stale
    now[0] = 50
    assert get("u") == b"v" and stale == ["u"] and asked == ["u"]


def test_queue(spark):
    jobs = spark.createDataFrame([("t1", "symbols", 1, 1), ("t1", "raster", 5, 2), ("t2", "raster", 3, 3), ("t2", "symbols", 0, 4), ("t2", "raster", 9, 5), ("t3", "symbols", 2, 6)], "tile string, phase string, priority int, seq int")
    got = [(r.tile, r.phase) for r in labels.queue_order(jobs).orderBy("turn").collect()]
    assert got == [("t1", "raster"), ("t2", "raster"), ("t3", "symbols")]
    assert jobs.select(F.max("seq")).first()[0] == 6


def test_network_tiles(spark, tmp_path):
    """A batch and a stream against a server of this machine, under two names; never more requests to a host than agreed."""
    import threading
    import time
    from collections import Counter
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    from tilewright.plans import problems
    from tilewright.sources import network

    open_now, most, lock = Counter(), Counter(), threading.Lock()

    class Tiles(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            host = self.headers["Host"]
            with lock:
                open_now[host] += 1
                most[host] = max(most[host], open_now[host])
            time.sleep(0.01)
            z, x, y = map(int, self.path.strip("/").split("/"))
            code = 404 if x == 3 else 403 if y == 5 else 200
            with lock:
                open_now[host] -= 1
            self.send_response(code)
            self.end_headers()
            if code == 200:
                self.wfile.write(f"{z}/{x}/{y}".encode())

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Tiles)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    urls = [f"http://{h}:{server.server_port}/{{z}}/{{x}}/{{y}}" for h in ("127.0.0.1", "localhost")]
    try:
        df = network.read_tiles(spark, urls, perhost=2).where("z = 4 and x between 1 and 6 and y < 7")
        seen, o = problems.observed(df)
        got = {(r.z, r.x, r.y): r for r in seen.collect()}
        assert set(got) == {(4, x, y) for x in range(1, 7) for y in range(7)}
        for (z, x, y), r in got.items():
            want = ("not_found", None) if x == 3 else ("error", None) if y == 5 else ("data", f"{z}/{x}/{y}".encode())
            assert (r.status, bytes(r.bytes) if r.bytes else None) == want and (y != 5 or x == 3 or r.error == "status 403")
        assert o.get == {"tiles": 42, "data": 30, "not_found": 7, "error": 5}
        assert [tuple(r) for r in problems.counted(problems.tile_problems(df, F.col("url"))).collect()] == [("tile", "status 403", 5)]
        assert len(most) == 2 and max(most.values()) <= 2
        q = network.read_tiles(spark, urls, stream=True, minzoom=2, maxzoom=3, batch=30).writeStream.format("memory").queryName("tiles_by_net").option("checkpointLocation", str(tmp_path / "cp")).start()
        end = time.time() + 60
        while q.isActive and spark.table("tiles_by_net").count() < 80 and time.time() < end:
            time.sleep(0.5)
        q.stop()
        rows = spark.table("tiles_by_net").collect()
        assert len(rows) == 80 and len({(r.z, r.x, r.y) for r in rows}) == 80 and max(most.values()) <= 2
    finally:
        server.shutdown()


def test_budgets_do_not_take_a_group_for_each_row(spark):
    """Frames that end with the group are added up anew for each row; sums are those of a plain loop, null keys, costs and ages included."""
    rows = [(None if i % 50 == 7 else f"g{i % 2}", None if i == 10 else i * i, None if i % 9 == 0 else i % 5) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, at long, cost long").repartition(3)
    swept, kept = set(), set()
    for g in {r[0] for r in rows}:
        total, known = 0, False
        for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: -1 if r[1] is None else r[1], reverse=True)):
            known, total = known or r[2] is not None, total + (r[2] or 0)
            swept |= {r[:2]} if known and total <= 60 else set()
            kept |= {r[:2]} if n < 20 and (n < 2 or (known and total <= 60)) else set()
    got = after_sweep(df, ["g"], ["at"], "cost", 60)
    assert {(r.g, r["at"]) for r in got.collect()} == swept
    assert {(r.g, r["at"]) for r in within_budget(df, ["g"], "at", "cost", 60, 20, 2).collect()} == kept
    assert "currentrow$(), unboundedfollowing$()" not in got._jdf.queryExecution().optimizedPlan().toString()
