"""Queries over what a map's stores and labels decide, on the driver's events, each with SQL that gives the same rows.

Tiles are 64 x 16 blocks of the events' world; ``tick`` is a time in which a day of the events is a minute.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry
from .operators import retention, symbols
from .operators import tilestore as S
from .plans.theme import read_theme
from .queries import OVERLAP, PTS, _overlap_sides, lines, pts, query, table


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pts(spark, sf_dir)
    tick = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1440)
    return p.select("*", F.shiftright("x", 2).alias("tx"), F.shiftright("y", 4).alias("ty"), tick.alias("tick"), (F.shiftright("x", 2) * 16 + F.shiftright("y", 4)).alias("tile"))


SEEN = f"{PTS}, seen AS (SELECT *, x >> 2 AS tx, y >> 4 AS ty, CAST(floor(epoch_us(ts) / 1440) AS BIGINT) AS tick, (x >> 2) * 16 + (y >> 4) AS tile FROM pts)"
TURNS = f"{SEEN}, e AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY tick, event_id) AS n FROM seen)"


@query(f"""WITH RECURSIVE {TURNS}, r AS (SELECT tile, event_id, n, tick AS since, event_id AS flight FROM e WHERE n = 1 UNION ALL
 SELECT e.tile, e.event_id, e.n, CASE WHEN e.tick >= r.since + 60000000 THEN e.tick ELSE r.since END, CASE WHEN e.tick >= r.since + 60000000 THEN e.event_id ELSE r.flight END FROM r JOIN e ON e.tile = r.tile AND e.n = r.n + 1)
 SELECT event_id, flight, event_id = flight AS leads FROM r""")
def single_flight(spark, sf_dir):
    """Loads take a minute; requests for the same tile join one that is under way."""
    return S.single_flights(seen(spark, sf_dir), "tile", "tick", "event_id", 60_000_000).select("event_id", "flight", "leads")


@query(f"""WITH RECURSIVE {TURNS}, r AS (SELECT tile, event_id, n, true AS tried, CASE WHEN k % 2 = 0 THEN tick END AS failed FROM e WHERE n = 1 UNION ALL
 SELECT e.tile, e.event_id, e.n, r.failed IS NULL OR e.tick >= r.failed + 15000000, CASE WHEN r.failed IS NOT NULL AND e.tick < r.failed + 15000000 THEN r.failed WHEN e.k % 2 = 0 THEN e.tick END FROM r JOIN e ON e.tile = r.tile AND e.n = r.n + 1)
 SELECT event_id, tried FROM r""")
def retry_throttle_15s(spark, sf_dir):
    e = seen(spark, sf_dir).select("tile", "tick", "event_id", (F.col("k") % 2 == 0).alias("fails"))
    return S.attempts(e, "tile", "tick", "event_id", "fails").select("event_id", "tried")


@query(f"""WITH RECURSIVE {TURNS}, r AS (SELECT tile, event_id, n, k % 5 <> 0 AS retried, CASE WHEN k % 5 <> 0 THEN 1 ELSE 0 END AS used, CASE WHEN k % 5 <> 0 THEN tick END AS tried_at FROM e WHERE n = 1 UNION ALL
 SELECT tile, event_id, n, go, CASE WHEN progress THEN 0 WHEN go THEN used + 1 ELSE used END, CASE WHEN go THEN tick ELSE tried_at END FROM (SELECT e.tile, e.event_id, e.n, e.tick, r.used, r.tried_at, e.k % 5 = 0 AS progress,
 e.k % 5 <> 0 AND r.used < 4 AND (r.tried_at IS NULL OR e.tick >= r.tried_at + 16000000) AS go FROM r JOIN e ON e.tile = r.tile AND e.n = r.n + 1)) SELECT event_id, retried FROM r""")
def bounded_retry(spark, sf_dir):
    e = seen(spark, sf_dir).select("tile", "tick", "event_id", (F.col("k") % 5 == 0).alias("progress"))
    return S.retries(e, "tile", "tick", "event_id", "progress").select("event_id", "retried")


@query(f"""WITH {SEEN}, c AS (SELECT event_id, CASE WHEN k % 4 <> 0 THEN k % 3 END AS b, CASE WHEN k % 5 <> 0 THEN event_id % 3 END AS a, event_type = 'error' AS f, k <= 40 AS young, k % 11 <> 0 AS present, k % 7 = 0 AS nothing FROM seen)
 SELECT event_id, CASE WHEN f THEN 'failed' WHEN a IS NOT DISTINCT FROM b THEN 'unchanged' WHEN b IS NULL THEN 'appeared' WHEN a IS NULL THEN 'vanished' ELSE 'changed' END AS change,
 CASE WHEN NOT present THEN CASE WHEN f THEN 'unavailable' ELSE 'loaded' END ELSE CASE WHEN nothing THEN 'absent_' ELSE '' END || CASE WHEN young THEN 'fresh' ELSE 'stale' END END AS outcome, present AND NOT young AS refresh FROM c""")
def load_and_refresh(spark, sf_dir):
    from .streaming.labels import load_status

    e = seen(spark, sf_dir)
    before, after = F.when(F.col("k") % 4 != 0, F.col("k") % 3), F.when(F.col("k") % 5 != 0, F.col("event_id") % 3)
    failed = F.col("event_type") == "error"
    status = load_status(F.col("k"), F.lit(40), F.col("k") % 11 != 0, F.col("k") % 7 == 0)
    return e.select("event_id", S.refresh_change(before, after, failed).alias("change"), S.load_outcome(status, failed).alias("o")).select("event_id", "change", "o.*")


@query(f"""WITH {SEEN}, m AS (SELECT DISTINCT tile FROM seen WHERE event_type = 'signup' AND k >= 70), f AS (SELECT tile, max(tick) AS failed FROM seen WHERE event_type = 'error' GROUP BY 1),
 c AS (SELECT tile, max(tick) AS tick, arg_max(k < 20, struct_pack(a := tick, b := (k < 20)::INT)) AS nothing FROM seen WHERE event_type = 'purchase' GROUP BY 1)
 SELECT event_id, CASE WHEN m.tile IS NOT NULL THEN 'memory' WHEN s.tick < f.failed + 15000000 THEN 'throttled' WHEN c.tile IS NULL THEN 'provider'
 ELSE CASE WHEN c.nothing THEN 'absent_' ELSE '' END || CASE WHEN s.tick - c.tick <= 600000000 THEN 'fresh' ELSE 'stale' END END AS source
 FROM seen s LEFT JOIN m ON m.tile = s.tile LEFT JOIN f ON f.tile = s.tile LEFT JOIN c ON c.tile = s.tile""")
def tile_obtain(spark, sf_dir):
    e = seen(spark, sf_dir)
    memory = e.where("event_type = 'signup' and k >= 70").select("tile")
    failures = e.where("event_type = 'error'").select("tile", F.col("tick").alias("failed_at"))
    cache = e.where("event_type = 'purchase'").select("tile", F.col("tick").alias("at"), (F.col("k") < 20).alias("empty"))
    got = S.obtain(e.select("tile", "event_id", F.col("tick").alias("now")), memory, failures, cache, ["tile"], 600_000_000)
    return got.select("event_id", "source")


@query(f"WITH {SEEN} SELECT tile FROM seen GROUP BY 1 HAVING arg_max(event_type, event_id) = 'view'")
def raster_absent(spark, sf_dir):
    answer = F.when(F.col("event_type") == "view", F.lit("absent")).when(F.col("event_type") == "error", F.lit("unreachable")).otherwise(F.lit("data"))
    return S.known_absent(seen(spark, sf_dir).withColumn("answer", answer), ["tile"], "event_id", "answer")


@query(f"WITH {SEEN} SELECT tile, arg_max(event_id, struct_pack(f := (event_type <> 'view')::INT, e := event_id)) AS event_id FROM seen GROUP BY 1")
def provisional_results(spark, sf_dir):
    e = seen(spark, sf_dir).withColumn("provisional", F.col("event_type") == "view")
    return S.standing_results(e, ["tile"], "event_id", "provisional").select("tile", "event_id")


@query(f"""WITH {SEEN}, p AS (SELECT tile, event_type, max(event_id) AS event_id FROM seen WHERE k % 3 <> 0 AND value > 10 GROUP BY 1, 2), i AS (SELECT tile, max(event_id) AS gone FROM seen WHERE event_type = 'error' GROUP BY 1)
 SELECT p.tile, p.event_type, p.event_id FROM p LEFT JOIN i ON i.tile = p.tile WHERE gone IS NULL OR p.event_id > gone""")
def result_cache(spark, sf_dir):
    e = seen(spark, sf_dir).withColumn("is_final", F.col("k") % 3 != 0).withColumn("complete", F.col("value") > 10)
    return S.cached_results(e, e.where("event_type = 'error'"), ["tile"], "event_type", "event_id").select("tile", "event_type", "event_id")


@query("SELECT source, count(*) AS entries, sum(n_chars)::BIGINT AS cost FROM documents GROUP BY ROLLUP (source)")
def cache_costs(spark, sf_dir):
    return S.cache_totals(table(spark, sf_dir, "documents"), "source", "n_chars")


@query(f"WITH {SEEN} SELECT user_id, bool_and(k % 10 < 8) AS cancelled FROM seen GROUP BY 1")
def joined_cancellation(spark, sf_dir):
    return S.all_cancelled(seen(spark, sf_dir).withColumn("off", F.col("k") % 10 < 8), "user_id", "off")


@query(f"""WITH {SEEN} SELECT tile, event_id FROM (SELECT tile, event_id, coalesce(sum(cost) OVER (PARTITION BY tile ORDER BY k, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done
 FROM (SELECT *, CAST(floor(value * 20) AS BIGINT) AS cost FROM seen)) WHERE done < 4000""")
def frame_jobs(spark, sf_dir):
    e = seen(spark, sf_dir).withColumn("cost", F.floor(F.col("value") * 20))
    return S.frame_batch(e, ["tile"], ["k", "event_id"], "cost").select("tile", "event_id")


@query(f"""WITH {SEEN}, s AS (SELECT tile, list_sort(list(DISTINCT event_type) FILTER (k < 60)) AS p, list_sort(list(DISTINCT event_type) FILTER (k >= 60)) AS r FROM seen GROUP BY 1)
 SELECT tile, coalesce(list_aggregate(list_filter(p, lambda t: NOT list_contains(coalesce(r, []), t)), 'string_agg', ','), '') AS missing, coalesce(p, []) = coalesce(r, []) AS same FROM s""")
def source_sets(spark, sf_dir):
    has = lambda c: F.collect_set(F.when(c, F.col("event_type")))
    s = seen(spark, sf_dir).groupBy("tile").agg(has(F.col("k") < 60).alias("p"), has(F.col("k") >= 60).alias("r"))
    return s.select("tile", F.array_join(F.array_sort(S.missing(F.col("p"), F.col("r"))), ",").alias("missing"), S.same_set(F.col("p"), F.col("r")).alias("same"))


@query(f"""WITH {PTS}, {OVERLAP}, b2 AS (SELECT *, (x + y) % 2 = 0 AS loading, x % 3 = 0 AS has_symbols FROM b), j AS (SELECT a.z, a.x, a.y, b2.loading AND NOT b2.has_symbols AS waits FROM a JOIN b2 ON
 (a.x >> greatest(a.z - b2.z, 0)) = (b2.x >> greatest(b2.z - a.z, 0)) AND (a.y >> greatest(a.z - b2.z, 0)) = (b2.y >> greatest(b2.z - a.z, 0)))
 SELECT z::BIGINT AS z, x, y FROM a WHERE y % 4 <> 0 AND (SELECT bool_or(loading) FROM b2) AND (EXISTS (SELECT 1 FROM j WHERE j.z = a.z AND j.x = a.x AND j.y = a.y AND waits) OR NOT EXISTS (SELECT 1 FROM j WHERE j.z = a.z AND j.x = a.x AND j.y = a.y))""")
def level_handover(spark, sf_dir):
    a, b = _overlap_sides(spark, sf_dir)
    current = b.withColumn("loading", (F.col("x") + F.col("y")) % 2 == 0).withColumn("has_symbols", F.col("x") % 3 == 0)
    return S.handover(a.withColumn("has_symbols", F.col("y") % 4 != 0), current).select(F.col("z").cast("long").alias("z"), "x", "y")


@query(f"""WITH {PTS}, t AS (SELECT DISTINCT 8 - (event_id % 3)::INT AS z, x >> (event_id % 3)::INT AS x, y >> (event_id % 3)::INT AS y, event_type FROM pts)
 SELECT event_type, z::BIGINT AS z, x, y, row_number() OVER (PARTITION BY event_type ORDER BY z, y, x)::BIGINT AS turn, CASE WHEN (x + y) % 2 = 0 THEN 'loading' WHEN x % 3 = 0 THEN 'ready' ELSE 'empty' END AS state FROM t""")
def retained_turns(spark, sf_dir):
    p = pts(spark, sf_dir)
    up = (F.col("event_id") % 3).cast("int")
    shr = lambda c: F.call_function("shiftright", F.col(c), up)
    t = p.select("event_type", (8 - up).alias("z"), shr("x").alias("x"), shr("y").alias("y")).distinct()
    state = S.tile_state((F.col("x") + F.col("y")) % 2 == 0, F.col("x") % 3 == 0)
    return S.retained_order(t, ["event_type"]).select("event_type", F.col("z").cast("long").alias("z"), "x", "y", F.col("turn").cast("long").alias("turn"), state.alias("state"))


BANDS: dict[str, Any] = {"version": 8, "layers": [
    {"id": "a", "type": "symbol", "source": "s", "source-layer": "l", "minzoom": 4, "maxzoom": 6.5}, {"id": "b", "type": "symbol", "source": "s", "source-layer": "l", "minzoom": 9},
    {"id": "c", "type": "fill", "source": "s", "source-layer": "l"},
]}


@query(f"WITH {SEEN} SELECT event_id, (k / 8.0 >= 4 AND k / 8.0 < 6.5) OR k / 8.0 >= 9 AS covered FROM seen")
def symbol_layer_covers(spark, sf_dir):
    return seen(spark, sf_dir).select("event_id", S.has_symbol_layer(read_theme(BANDS), F.col("k") / 8.0).alias("covered"))


@query(f"""WITH {SEEN} SELECT event_id, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END::BIGINT AS tier FROM seen WHERE event_type IN ('click', 'view') OR event_type = 'error' AND k * 3000 < 150000""")
def label_union(spark, sf_dir):
    e = seen(spark, sf_dir).withColumn("since", F.lit(1_000_000) - F.col("k") * 3000)
    of = lambda t: e.where(F.col("event_type") == t)
    got = S.label_candidates(of("click"), of("view"), S.live_ghosts(of("error"), F.lit(1_000_000), F.lit(150_000)))
    return got.select("event_id", F.col("tier").cast("long").alias("tier"))


@query(f"""WITH {SEEN}, w AS (SELECT event_type, tile, bool_or(value < 20) AS dropped FROM seen WHERE k % 4 = 0 GROUP BY 1, 2) SELECT event_id, dropped AS text_dropped FROM seen JOIN w USING (event_type, tile)""")
def label_replay(spark, sf_dir):
    e = seen(spark, sf_dir).select("event_id", "event_type", "tile", "k", "value")
    winners = e.where("k % 4 = 0").select("event_type", "tile", (F.col("value") < 20).alias("text_dropped"))
    return S.replayed(e, winners, ["event_type", "tile"]).select("event_id", "text_dropped")


@query(f"""WITH {SEEN}, o AS (SELECT event_type, tile, max(k) / 100.0::DOUBLE AS opacity FROM seen GROUP BY 1, 2), s AS (SELECT DISTINCT event_type, tile FROM seen WHERE value > 40),
 d AS (SELECT event_type, tile, max(event_id) AS event_id, arg_max(px, event_id) AS px FROM seen WHERE event_type <> 'signup' GROUP BY 1, 2)
 SELECT o.event_type, o.tile, opacity, d.event_id, d.px FROM o ANTI JOIN s USING (event_type, tile) JOIN d ON d.event_type = o.event_type AND d.tile = o.tile WHERE opacity > 0""")
def label_fade_outs(spark, sf_dir):
    e = seen(spark, sf_dir)
    opacities = e.groupBy("event_type", "tile").agg((F.max("k") / 100.0).alias("opacity"))
    drawn = e.where("event_type <> 'signup'").select("event_type", "tile", "event_id", "px")
    return S.fading_out(opacities, e.where("value > 40"), drawn, ["event_type", "tile"], "event_id")


@query(f"""WITH {SEEN}, c AS (SELECT event_id, tile, (k - 50) / 400.0::DOUBLE AS c, row_number() OVER (PARTITION BY tile ORDER BY event_id) AS n FROM seen)
 SELECT event_id, last_value(CASE WHEN n = 1 THEN c < 0 WHEN c < -0.08 THEN true WHEN c >= 0.08 THEN false END IGNORE NULLS) OVER (PARTITION BY tile ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS flipped FROM c""")
def label_flips(spark, sf_dir):
    c = seen(spark, sf_dir).select("event_id", "tile", ((F.col("k") - 50) / 400.0).alias("cosine"))
    return S.reads_backwards(c, ["tile"], ["event_id"], "cosine").select("event_id", "flipped")


@query(f"""WITH {SEEN} SELECT event_id, round(least(greatest(k / 90.0::DOUBLE, 0), 1) * 32) / 32 AS opacity, CASE WHEN k % 3 = 0 THEN 0 ELSE round(least(greatest(value / 20, 0), 8) / (12 + k % 5) * 128) END::BIGINT AS halo, k % 4 AS layer_index, event_type AS text FROM seen""")
def text_styles(spark, sf_dir):
    e = seen(spark, sf_dir)
    style = S.text_style(F.col("k") / 90.0, F.col("value") / 20, F.col("k") % 3, 12 + F.col("k") % 5)
    key = S.continuity_key(F.col("k") % 4, F.col("event_type"), F.lit(None).cast("string"))
    return e.select("event_id", style.alias("s"), key.alias("key")).select("event_id", "s.*", "key.layer_index", "key.text")


@query(f"""WITH {SEEN}, b AS (SELECT event_id, px::DOUBLE AS x, py::DOUBLE AS y, 20.0 + k AS w, 10.0::DOUBLE AS h, k % 2 = 0 AS turned, 0.5 + k % 3 AS size, k % 10 > 0 AS shows FROM seen)
 SELECT event_id, round(x - CASE WHEN turned THEN sqrt(w * w + h * h) / 2 ELSE w / 2 END, 6) + 0.0 AS l, round(y + CASE WHEN turned THEN sqrt(w * w + h * h) / 2 ELSE h / 2 END, 6) + 0.0 AS b,
 CASE WHEN shows THEN round(x + 3 * size - 32 * size, 6) + 0.0 END AS icon_l, CASE WHEN shows THEN round(y - 5 * size + 24 * size, 6) + 0.0 END AS icon_b FROM b""")
def symbol_boxes(spark, sf_dir):
    """An icon of 64 x 48 pixels on a sheet of ratio 2, held at its top right corner."""
    e = seen(spark, sf_dir)
    x, y, k = F.col("px").cast("double"), F.col("py").cast("double"), F.col("k")
    bounds = S.symbol_bounds(x, y, k + 20.0, F.lit(10.0), k % 2 == 0)
    icon = S.icon_box(x, y, F.lit(64.0), F.lit(48.0), F.lit(2.0), 0.5 + k % 3, F.when(k % 10 > 0, 1.0).otherwise(0.0), F.array(F.lit(3.0), F.lit(-5.0)), F.lit("top-right"))
    r6 = lambda c: F.round(c, 6) + 0.0
    got = e.select("event_id", bounds.alias("s"), icon.alias("i"))
    return got.select("event_id", r6(F.col("s.l")).alias("l"), r6(F.col("s.b")).alias("b"), r6(F.col("i.l")).alias("icon_l"), r6(F.col("i.b")).alias("icon_b"))


@query("""SELECT vec_id, 'M ' || list_aggregate(list_transform(range(len(p)//2), lambda i: CAST(p[2*i+1] AS VARCHAR) || ' ' || CAST(p[2*i+2] AS VARCHAR)), 'string_agg', ' L ') || ' Z' AS path FROM
 (SELECT vec_id, list_transform(embedding, lambda e: round(CAST(e AS DOUBLE) * 8192) + 2048) AS p FROM embeddings)""")
def polygon_paths(spark, sf_dir):
    return lines(spark, sf_dir).select("vec_id", S.polygon_path(F.array("p")).alias("path"))


@query("""WITH l AS (SELECT vec_id, list_transform(embedding, lambda e: round(CAST(e AS DOUBLE) * 8192) + 2048) AS p FROM embeddings),
 g AS (SELECT vec_id, i, p[2*i+1] AS x1, p[2*i+2] AS y1, p[2*i+3] AS x2, p[2*i+4] AS y2, sqrt((p[2*i+3]-p[2*i+1])*(p[2*i+3]-p[2*i+1]) + (p[2*i+4]-p[2*i+2])*(p[2*i+4]-p[2*i+2])) AS len FROM l, unnest(range(len(p)//2 - 1)) AS t(i)),
 s AS (SELECT *, sum(len) OVER (PARTITION BY vec_id ORDER BY i) - len AS done FROM g), t AS (SELECT vec_id, sum(len) / 2 AS mid FROM g GROUP BY 1),
 a AS (SELECT t.vec_id, max(CASE WHEN e = 0 THEN x1 + (x2 - x1) * (mid - 350 - done) / len END) AS xa, max(CASE WHEN e = 1 THEN x1 + (x2 - x1) * (mid + 350 - done) / len END) AS xb, any_value(mid) AS mid FROM t CROSS JOIN (SELECT unnest([0, 1]) AS e) JOIN s
 ON s.vec_id = t.vec_id AND mid + (e * 700 - 350) >= done AND mid + (e * 700 - 350) < done + len GROUP BY 1),
 c AS (SELECT vec_id, k, xb < xa AS flipped, CASE WHEN xb < xa THEN mid + 350 - (k + 0.5) * 100 ELSE mid - 350 + (k + 0.5) * 100 END AS d FROM a, unnest([0, 1, 2, 3, 5, 6]) AS u(k)),
 q AS (SELECT c.vec_id, k, flipped, x1 + (x2 - x1) * (d - done) / len AS x, y1 + (y2 - y1) * (d - done) / len AS y, atan2(CASE WHEN flipped THEN y1 - y2 ELSE y2 - y1 END, CASE WHEN flipped THEN x1 - x2 ELSE x2 - x1 END) AS angle
 FROM c JOIN s ON s.vec_id = c.vec_id AND d >= done AND d < done + len),
 b AS (SELECT *, abs(angle - lag(angle) OVER (PARTITION BY vec_id ORDER BY k)) AS turn FROM q)
 SELECT vec_id, flipped, round(avg(x), 3) AS x, round(avg(y), 3) AS y, count(*)::BIGINT AS glyphs FROM b GROUP BY 1, 2 HAVING NOT bool_or(coalesce(least(turn, 2 * pi() - turn) > radians(170), false))""")
def curved_labels(spark, sf_dir):
    """'Main St' of 200 pixels at the middle of each line, glyph by glyph; lines that turn by more than 170 degrees under it have none."""
    ln = lines(spark, sf_dir).select("vec_id", F.col("p").alias("path"), F.lit("Main St").alias("text"), F.lit(200.0).alias("text_size"), F.lit(2.0).alias("text_padding"), F.lit(170.0).alias("text_max_angle"),
        F.lit(True).alias("text_keep_upright"), F.array(F.lit(0.0), F.lit(0.0)).alias("text_offset"))
    got = symbols.along_lines(ln.withColumn("path_distance", geometry.line_length(F.col("path")) / 2)).where("glyphs is not null")
    mean = lambda k: F.round(F.aggregate("glyphs", F.lit(0.0), lambda a, g: a + g[k]) / F.size("glyphs"), 3)
    return got.select("vec_id", "flipped", mean("x").alias("x"), mean("y").alias("y"), F.size("glyphs").cast("long").alias("glyphs"))


@query()
def label_sightings(spark, sf_dir):
    """Which label is which depends on every earlier sighting; tests hold it against a plain loop."""
    e = seen(spark, sf_dir).select("tile", F.row_number().over(_by_tile()).alias("frame"), F.col("event_type").alias("key"), (F.col("px") % 64).cast("double").alias("sx"), (F.col("py") % 64).cast("double").alias("sy"))
    return S.sightings(e, "tile", "frame", "key", "sx", "sy")


def _by_tile():
    from pyspark.sql import Window

    return Window.partitionBy("tile").orderBy("event_id")


TILE = "STRUCT(z BIGINT, x BIGINT, y BIGINT, c BIGINT)"
SAME = "len(list_filter({0}, lambda o: o.z = t.z AND o.x = t.x AND o.y = t.y)) > 0"
SYMBOLS, LOADED = "(t.x + t.y) % 3 <> 0", "n >= t.c + (t.x * 7 + t.y * 13) % 4"
SEEN_ON = " AND ".join(f"CASE WHEN t.z <= z THEN t.{c} BETWEEN {c}0 >> (z - t.z)::INT AND {c}1 >> (z - t.z)::INT ELSE t.{c} >> (t.z - z)::INT BETWEEN {c}0 AND {c}1 END" for c in "xy")



@query(f"""WITH RECURSIVE {PTS}, p AS (SELECT user_id AS view, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, k FROM pts),
 q AS (SELECT view, n, 8 - (n // 4) % 3 AS z, (view * 7919) % 30000 + n * 90 + 400 AS cx, (view * 104729) % 30000 + n * 60 + k % 40 + 300 AS cy FROM p),
 f AS (SELECT view, n, z, (cx - 400) // (65536 >> z::INT) AS x0, (cx + 400) // (65536 >> z::INT) AS x1, (cy - 300) // (65536 >> z::INT) AS y0, (cy + 300) // (65536 >> z::INT) AS y1 FROM q),
 g AS (SELECT *, list_transform(range((x1 - x0 + 1) * (y1 - y0 + 1)), lambda i: struct_pack(z := z, x := x0 + i // (y1 - y0 + 1), y := y0 + i % (y1 - y0 + 1), c := n)) AS layout FROM f),
 r AS (SELECT view, 0::BIGINT AS n, -1::BIGINT AS z, []::{TILE}[] AS cur, []::{TILE}[] AS ret, []::{TILE}[] AS gh FROM g WHERE n = 1 UNION ALL
 SELECT view, n, z, cur, list_filter(ret, lambda t: {LOADED} AND NOT ready AND {SEEN_ON}) AS ret,
 list_concat(list_concat(gh, parked), list_transform(list_filter(ret, lambda t: {LOADED} AND {SYMBOLS} AND (ready OR NOT ({SEEN_ON}))), lambda t: struct_pack(z := t.z, x := t.x, y := t.y, c := n))) AS gh FROM (
 SELECT *, len(list_filter(cur, lambda t: NOT (n - 2 >= t.c + (t.x * 7 + t.y * 13) % 4))) = 0 AS ready FROM (
 SELECT view, n, z, x0, x1, y0, y1, list_concat(kept, list_filter(layout, lambda t: NOT {SAME.format("kept")})) AS cur, ret, gh, parked FROM (
 SELECT g.view, g.n, g.z, g.x0, g.x1, g.y0, g.y1, g.layout, list_filter(r.gh, lambda t: g.n - t.c < 2) AS gh,
 CASE WHEN g.z <> r.z THEN list_transform(list_filter(r.ret, lambda t: {SAME.format("r.cur")} AND g.{LOADED} AND {SYMBOLS}), lambda t: struct_pack(z := t.z, x := t.x, y := t.y, c := g.n)) ELSE [] END AS parked,
 CASE WHEN g.z <> r.z THEN list_concat(list_filter(r.ret, lambda t: NOT {SAME.format("r.cur")}), r.cur) ELSE r.ret END AS ret,
 CASE WHEN g.z <> r.z THEN [] ELSE list_filter(r.cur, lambda t: t.x BETWEEN g.x0 AND g.x1 AND t.y BETWEEN g.y0 AND g.y1) END AS kept FROM r JOIN g ON g.view = r.view AND g.n = r.n + 1)))),
 o AS (SELECT view, n, cur, unnest(list_concat(list_concat(list_transform(cur, lambda t: struct_pack(role := 'current', t := t)), list_transform(ret, lambda t: struct_pack(role := 'retained', t := t))), list_transform(gh, lambda t: struct_pack(role := 'ghost', t := t)))) AS e FROM r WHERE n > 0),
 m AS (SELECT view, n, e.role AS role, e.t AS t, list_filter(cur, lambda a: a.x >> greatest(a.z - e.t.z, 0)::INT = e.t.x >> greatest(e.t.z - a.z, 0)::INT AND a.y >> greatest(a.z - e.t.z, 0)::INT = e.t.y >> greatest(e.t.z - a.z, 0)::INT) AS met FROM o)
 SELECT view, n AS frame, role, t.z::INT AS z, t.x AS x, t.y AS y, CASE role WHEN 'current' THEN NOT ({LOADED}) WHEN 'retained' THEN {SYMBOLS} AND (len(met) = 0 OR len(list_filter(met, lambda u: NOT ({LOADED.replace("t.", "u.")}))) > 0) ELSE false END AS flag FROM m""")
def tile_frames(spark, sf_dir):
    """A camera path for each user, four frames a zoom: which tiles are current, retained and parked in every frame."""
    from pyspark.sql import Window

    p = pts(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    p = p.select(F.col("user_id").alias("view"), n.alias("frame"), "k").withColumn("zoom", (8 - F.floor(F.col("frame") / 4) % 3).cast("int"))
    cx = (F.col("view") * 7919) % 30000 + F.col("frame") * 90 + 400
    cy = (F.col("view") * 104729) % 30000 + F.col("frame") * 60 + F.col("k") % 40 + 300
    side = F.call_function("shiftright", F.lit(65536), F.col("zoom"))
    box = [F.floor(v / side).alias(c) for c, v in (("x0", cx - 400), ("x1", cx + 400), ("y0", cy - 300), ("y1", cy + 300))]
    return retention.retention(p.select("view", "frame", "zoom", *box), lambda k: ((k[1] * 7 + k[2] * 13) % 4, (k[1] + k[2]) % 3 != 0), fade=2)
