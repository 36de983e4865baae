"""Small functions by hand-computed values, and state held against plain loops."""

import math
import re
import random

import pytest
from pyspark.sql import functions as F

from tilewright.functions import geometry as G
from tilewright.functions import tiles as T
from tilewright.operators import drawlist, joins, symbols, tilestore
from tilewright.sources import pmtiles
from tilewright.streaming import labels


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def lit(v):
    return F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)


def test_angles(spark):
    for a, want in ((0.3, 0.3), (math.pi, math.pi), (-math.pi, math.pi), (4.0, 4.0 - 2 * math.pi), (-7.0, -7.0 + 2 * math.pi)):
        assert G.fold_angle(a) == pytest.approx(want)
    for a, want in ((0.3, 0.3), (2.0, 2.0 - math.pi), (-2.0, math.pi - 2.0), (math.pi / 2, math.pi / 2)):
        assert value(spark, G.upright(F.lit(a))) == pytest.approx(want)
    assert value(spark, symbols.too_bent(lit([0.0, 0.2, 1.3]), F.lit(45.0))) is True
    assert value(spark, symbols.too_bent(lit([0.0, 0.2, 0.5]), F.lit(45.0))) is False
    assert value(spark, symbols.too_bent(lit([3.1, -3.1]), F.lit(45.0))) is False  # across the half turn
    assert value(spark, symbols.too_bent(lit([0.0]), F.lit(1.0))) is False


def test_drawing_values(spark):
    assert value(spark, drawlist.stamps(F.lit(100.0), F.lit(30.0), 40.0)) == [10.0, 50.0, 90.0]
    assert value(spark, drawlist.stamps(F.lit(5.0), F.lit(30.0), 40.0)) == []
    assert value(spark, drawlist.pattern_phase(F.lit(3), F.lit(100.0))) == -68.0
    assert value(spark, drawlist.sdf_edge(F.lit(2.0), F.lit(1.0))) == 0.5 and value(spark, drawlist.sdf_edge(F.lit(90.0), F.lit(1.0))) == 0.0
    assert value(spark, drawlist.sdf_slope(F.lit(0.1))) == 4.0 and value(spark, drawlist.sdf_slope(F.lit(1.5))) == 12.0
    assert [c for c, _, _ in symbols.glyph_clusters("a b", 10.0)] == ["a", "b"] and symbols.glyph_clusters("a b", 10.0)[1][1] == 12.5
    r = value(spark, T.display_rect(F.lit(3), F.lit(1), F.lit(2), F.lit(4.0)))
    assert (r.l, r.t, r.r, r.b) == (512.0, 1024.0, 1024.0, 1536.0)
    assert value(spark, T.style_zoom(F.lit(0.4))) == 0.0 and value(spark, T.style_zoom(F.lit(5.5), 2)) == 5.5 and value(spark, T.style_zoom(F.lit(5.5), -2)) == 3.5
    assert value(spark, pmtiles.delta_ids(lit([5, 1, 10]))) == [5, 6, 16]
    r = value(spark, drawlist.raster_rect(*[F.lit(v) for v in (4, 5, 10, 3, 2, 5, 512, 256)]))
    assert (r.l, r.t, r.r, r.b) == (256.0, 0.0, 512.0, 128.0)


def test_times(spark):
    at = lambda s, n, t: value(spark, labels.fade_progress(F.lit(s).cast("long"), F.lit(n), F.lit(t)))
    assert (at(None, 5, 10), at(0, 5, 10), at(0, 50, 10), at(9, 5, 10), at(0, 5, 0)) == (1.0, 0.5, 1.0, 0.0, 1.0)
    assert value(spark, labels.placement_interval(F.lit(900_000))) == 300_000 and value(spark, labels.placement_interval(F.lit(200))) == 200


def test_screen(spark):
    c = spark.createDataFrame([(2, 1, 1, 128.0, 0.0), (2, 3, 3, 250.0, 250.0)], "z int, x int, y int, anchor_x double, anchor_y double")
    got = symbols.to_screen(c, 3.0, (768.0, 512.0), (400.0, 300.0)).collect()
    assert [(r.screen_x, r.screen_y) for r in got] == [(200.0, 150.0)]
    turned = symbols.to_screen(c.limit(1), 3.0, (758.0, 512.0), (400.0, 300.0), math.pi / 2).first()
    assert (turned.screen_x, turned.screen_y) == (pytest.approx(200.0), pytest.approx(160.0))


def test_small_joins(spark):
    tiles = spark.createDataFrame([(3, 1, 1, True), (3, 2, 1, False)], "z int, x long, y long, loading boolean")
    assert not joins.level_ready(tiles).first().ready and joins.level_ready(tiles.where("not loading")).first().ready and joins.level_ready(tiles.limit(0)).first().ready
    assert [r.x for r in joins.drawn_only(tiles, tiles.where("x = 2"), ["z", "x", "y"]).collect()] == [2]
    assert sorted(r.x for r in joins.affected(tiles, spark.createDataFrame([(2, 1, 0)], "z int, x long, y long"), "s", -1, 0, 5).collect()) == [2]
    sprites = spark.createDataFrame([("a", 8.0, 9.0), ("thin", 0.5, 9.0)], "name string, width double, height double")
    rows = spark.createDataFrame([("a",), ("thin",), (None,)], "icon string")
    assert sorted(str(r.s_width) for r in joins.with_sprites(rows, sprites, "icon", "s").collect()) == ["8.0", "None", "None"]
    assert [r.x for r in joins.first_by(tiles, ["z"], [F.desc("x")]).collect()] == [2]


def test_sightings_are_those_of_a_plain_loop(spark):
    rng = random.Random(3)
    rows = [(s, f, rng.choice("ab"), rng.random() * 200, rng.random() * 50) for s in range(3) for f in sorted(rng.sample(range(1, 400), 60))]
    got = {(r.s, r.f, r.k, r.x, r.y): r.entry for r in tilestore.sightings(spark.createDataFrame(rows, "s int, f int, k string, x double, y double"), "s", "f", "k", "x", "y").collect()}
    for s in range(3):
        held, n = [], 0  # [key, x, y, frame, number]
        for _, f, k, x, y in [r for r in rows if r[0] == s]:
            held = [e for e in held if f + 1 - e[3] <= labels.MEMORY_FRAMES]
            near = [e for e in held if e[0] == k and math.hypot(e[1] - x, e[2] - y) < labels.MEMORY_RADIUS]
            e = min(near, key=lambda e: math.hypot(e[1] - x, e[2] - y), default=None)
            if e is None:
                e = [k, x, y, f, n]
                n += 1
                held.append(e)
            e[1:4] = [x, y, f + 1]
            assert got[s, f, k, x, y] == e[4]


def test_attributions():
    from tilewright.plans import style

    a = style.attribution("&copy; <a href='https://o.org'>O</a> people, <a href=https://c.org/?a=1&amp;b=2>C</a>. a<br>b")
    assert a.text == "© O people, C. a b" and [u for _, u in a.spans] == [None, "https://o.org", None, "https://c.org/?a=1&b=2", None]
    assert a.html.startswith("&copy; <a href")
    a = style.attribution('<a href="https://p.com">Pro</a> &copy; <a href="https://osm.org">Open</a>')
    assert a.spans == (("Pro", "https://p.com"), ("©", None), ("Open", "https://osm.org")) and a.text == "Pro © Open"
    a = style.attribution("<a>Tiles</a> by me (<a href='u'>you</a>)!")
    assert a.text == "Tiles by me ( you)!" and a.spans[0] == ("Tiles", None)
    assert style.attribution("a<br/>b &amp; c").text == "a b & c" and style.attribution(" <a href=x></a> ").spans == ()
    x, y = style.attribution("x"), style.attribution("y")
    assert [v.text for v in style.first_by_text([x, y, style.attribution("<b>x</b>")])] == ["x", "y"]


def test_attribution_links(spark):
    from pyspark.sql import functions as F

    from tilewright.plans import style

    cases = {
        "<a href='u'>x</a><A\nclass=c HREF = \"v w\" >y<b>z</b></A>": ["u", "v w"], "<a href=u>&nbsp; <img></a><a href=w>w<a href=x>x": ["w", "x"],
        "<abbr href=n>n</abbr><a name=n>n</a><a href=''>e</a>": [], "no tags": [], "": [], "<": [], "<a href=k>k": ["k"], "<a data-href=n href=y>y</a>": ["y"],
    }
    df = spark.createDataFrame([(k,) for k in cases], "h string")
    got = {r.h: r.l for r in df.select("h", style.attribution_links(F.col("h")).alias("l")).collect()}
    assert got == cases


def test_raster_matrices():
    m = drawlist.raster_matrix(contrast=5)
    assert m[0] == 1000 and m[4] == pytest.approx((1 - 1000) * 127.5)
    same = [1, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 1, 0]
    assert drawlist.raster_matrix(hue=360) == pytest.approx(same) and drawlist.raster_matrix() == pytest.approx(same)
    assert drawlist.raster_matrix(saturation=-9)[:3] == pytest.approx([1 / 3] * 3)
    red = drawlist.raster_matrix(hue=120)
    assert [red[0], red[5], red[10]] == pytest.approx([0, 1, 0], abs=1e-9)  # red turns green


def greedy_lines(text, room, most=4):
    lines, now = [], None
    for part in [w for line in re.split(r"(\n)", text) for w in ([line] if line == "\n" else line.split())]:
        for w in [part] if part == "\n" else [part[i : i + room] for i in range(0, len(part), room)]:
            if w == "\n":
                lines.append(now or "") if now is not None else None
                now = ""
            elif not now:
                now = w
            elif len(now) + 1 + len(w) <= room:
                now += " " + w
            else:
                lines.append(now)
                now = w
    return ([*lines, now] if now is not None else lines)[:most]


def test_lines(spark):
    from pyspark.sql import functions as F

    from tilewright.operators import symbols

    texts = ["", "a", "one two three four five six seven", "word", "averyverylongwordthatisbroken in parts", "a\nb", "  spaced   out \n\n lines  ", "x" * 100, "é ü ñ ß", "exactly ten", "\n"]
    rows = [(t, w) for t in texts for w in (0.5, 2.0, 5.0, 10.0)]
    df = spark.createDataFrame(rows, "t string, w double")
    got = {(r.t, r.w): r.l for r in df.select("t", "w", symbols.wrapped(F.col("t"), F.col("w")).alias("l")).collect()}
    for t, w in rows:
        room = int(max(w, 2.0) / 0.5)
        if "\n" not in t:
            assert got[t, w] == greedy_lines(t, room), (t, w)
        assert all(len(x) <= room for x in got[t, w]) and len(got[t, w]) <= 4
    assert got["a\nb", 5.0] == ["a", "b"]
    size = df.select(*symbols.text_box(F.lit("one two three"), F.lit(10.0), F.lit(4.0), F.lit(False)), *symbols.text_box(F.lit("one two three"), F.lit(10.0), F.lit(4.0), F.lit(True))).first()
    assert size[0] == 7 * 5 and size[1] == pytest.approx(2 * 11.5) and size[2] == 13 * 5 and size[3] == pytest.approx(11.5)


def test_one_placement_of_all_kinds(spark):
    """Points with icons, labels along lines and ghosts against a plain loop; groups go on from batch to batch."""
    import random

    from tilewright.operators import symbols

    rng = random.Random(2)
    box = lambda: dict(zip("ltrb", (lambda x, y: (x, y, x + rng.randint(5, 60), y + rng.randint(5, 30)))(float(rng.randint(0, 500)), float(rng.randint(0, 500)))))
    rows = []
    for s in range(7):
        for i in range(rng.choice([1, 3, 150])):
            kind = rng.choice(["text", "both", "icon", "curve", "ghost", "free", "none"])
            texts = [{"anchor": a, **box()} for a in rng.sample(["center", "top", "left", "right"], 3)] if kind in ("text", "both", "free") else []
            rows.append((s, i, texts, box() if kind in ("icon", "both") else None, [box() for _ in range(4)] if kind == "curve" else None, kind == "free", rng.random() < 0.5, kind == "ghost", rng.choice([None, "left", "bottom"])))
    b = "struct<l:double,t:double,r:double,b:double>"
    rows = [(*r[:2], [{**x, "r": float(x["r"]), "b": float(x["b"])} for x in r[2]], *[{k: float(v) for k, v in r[3].items()} if r[3] else None], [{k: float(v) for k, v in x.items()} for x in r[4]] if r[4] else None, *r[5:]) for r in rows]
    df = spark.createDataFrame(rows, f"screen int, ord int, text_boxes array<struct<anchor:string,l:double,t:double,r:double,b:double>>, icon_box {b}, glyph_boxes array<{b}>, allow_overlap boolean, text_optional boolean, ghost boolean, sat string")
    want, claimed = {}, {}
    edges = lambda x: (x["l"], x["t"], x["r"], x["b"])
    for s, i, texts, icon, glyphs, free, optional, ghost, sat in rows:
        taken = claimed.setdefault(s, [])
        fits = lambda bs, taken=taken: not any(p[0] < q[2] and q[0] < p[2] and p[1] < q[3] and q[1] < p[3] for p in bs for q in taken)
        icons = [edges(icon)] if icon else []
        tried = [("center", [edges(g) for g in glyphs])] if glyphs else [(t["anchor"], [edges(t)]) for t in texts]
        tried = [t for t in tried if t[0] == sat] + [t for t in tried if t[0] != sat]
        out = (False, None, False)
        if ghost:
            out = (True, sat, False)
        elif free:
            out = (True, tried[0][0], False)
        else:
            for a, bs in tried:
                if fits(bs + icons):
                    out = (True, a, False)
                    taken += bs + icons
                    break
            else:
                if icons and (not tried or optional) and fits(icons):
                    out = (True, None, bool(tried))
                    taken += icons
        want[s, i] = out
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        got = {(r.screen, r.ord): (r.placed, r.anchor, r.text_dropped) for r in symbols.place(df.repartition(3), ["screen"], ["ord"], "sat").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_crowded_screens_try_few_candidates(spark, monkeypatch):
    """What collides for certain is told in bulk; results are those of trying each candidate, whose number would grow with the screen."""
    import random

    import numpy as np
    import pyarrow as pa

    from tilewright.operators import symbols

    rng = random.Random(5)
    n = 6000
    side = lambda x, y, w, h: {"l": x, "t": y, "r": x + w, "b": y + h}
    at = lambda: (rng.choice([0.0, 64.0, 500.0, rng.uniform(-50, 1000)]), rng.choice([0.0, float("nan"), rng.uniform(0, 800), rng.uniform(0, 800)]))
    box = lambda: side(*at(), rng.choice([0.0, 64.0, 90.0]), rng.choice([20.0, 64.0]))
    columns = {
        "text_boxes": [[{"anchor": a, **box()} for a in ("center", "left")[: rng.choice([0, 1, 2])]] for _ in range(n)], "icon_box": [rng.choice([None, box()]) for _ in range(n)],
        "glyph_boxes": [rng.choice([None, None, [box(), box()], []]) for _ in range(n)], "allow_overlap": [rng.random() < 0.02 for _ in range(n)], "text_optional": [rng.random() < 0.4 for _ in range(n)],
        "ghost": [rng.random() < 0.1 for _ in range(n)], "sat": [rng.choice([None, "left", "center"]) for _ in range(n)],
    }
    four = [(k, pa.float64()) for k in "ltrb"]
    kinds = [pa.list_(pa.struct([("anchor", pa.string()), *four])), pa.struct(four), pa.list_(pa.struct(four)), pa.bool_(), pa.bool_(), pa.bool_(), pa.string()]
    t = pa.table([pa.array(v, k) for v, k in zip(columns.values(), kinds)], list(columns))
    starts = np.array([0, 1, 5000])
    tried = []
    monkeypatch.setattr(symbols, "fold_columns", lambda c, screen, order, step, added: step)
    monkeypatch.setattr(symbols, "_try", lambda *a, own=symbols._try: tried.append(1) or own(*a))
    step = symbols.place(t.to_pandas().iloc[:0], ["s"], ["o"], remembered="sat")
    got = list(zip(*(a.to_pylist() for a in step(t, starts))))
    assert len(tried) < n / 2

    want = []
    for i, r in enumerate(t.to_pylist()):
        if i in starts:
            taken = []
        icon = [r["icon_box"]] if r["icon_box"] else []
        options = [("center", r["glyph_boxes"])] if r["glyph_boxes"] else [(o["anchor"], [o]) for o in r["text_boxes"]]
        if r["sat"]:
            options.sort(key=lambda o: o[0] != r["sat"])
        fits = lambda bs: not any(b["l"] < o["r"] and o["l"] < b["r"] and b["t"] < o["b"] and o["t"] < b["b"] for b in bs for o in taken)  # noqa: E731, B023
        if r["ghost"]:
            want.append((True, r["sat"], False))
        elif r["allow_overlap"] and (options or icon):
            want.append((True, options[0][0] if options else None, False))
        else:
            every = [(a, [*bs, *icon], False) for a, bs in options] + ([(None, icon, bool(options))] if icon and (not options or r["text_optional"]) else [])
            pick = next((o for o in every if fits(o[1])), None)
            taken += pick[1] if pick else []
            want.append((True, pick[0], pick[2]) if pick else (False, None, False))
    assert got == want


def test_groups_of_many_batches_are_put_together_once(spark, monkeypatch):
    """A group's rows were copied anew for each batch that it goes on in."""
    import pyarrow as pa

    from tilewright.operators import folds

    whole = spark.range(2000).selectExpr("case when id < 100 then 1 when id < 1900 then 2 else id end as g", "id")
    ran = []
    monkeypatch.setattr(type(whole), "mapInArrow", lambda self, run, schema: ran.append(run), raising=False)
    folds.fold_columns(whole, ["g"], ["id"], lambda t, starts: [pa.array([len(starts)] * t.num_rows)], "n int")
    table = pa.table({"g": [1] * 100 + [2] * 1800 + list(range(1900, 2000)), "id": list(range(2000))})
    copied = []
    real = pa.Table.from_batches
    spy = type("Spy", (), {"from_batches": staticmethod(lambda bs: copied.append(sum(b.num_rows for b in bs)) or real(bs)), "from_arrays": staticmethod(pa.Table.from_arrays)})
    monkeypatch.setattr(folds.pa, "Table", spy)
    out = list(ran[0](iter(table.to_batches(max_chunksize=50))))
    monkeypatch.undo()
    rows = real(out).to_pydict()
    assert rows["g"] == table["g"].to_pylist() and rows["id"] == list(range(2000)) and sum(copied) == 2000
