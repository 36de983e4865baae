"""Loading, keeping and retiring tiles and labels: what a map's stores decide, as joins, aggregates and windows over their
events. Only rules that need every earlier decision of a key are folds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.theme import Theme
from ..streaming.labels import Memory, Retry, load_status, throttled
from .folds import Rows, fold
from .joins import level_ready, retained_needed

#: Microseconds after a failure in which a tile isn't asked for again, and of a frame that jobs may take.
FAILURE_WAIT, FRAME_BUDGET = 15_000_000, 4_000
#: The cosine within which a label along a line keeps the way it read before.
FLIP_BAND = 0.08


# -- loading ----------------------------------------------------------------------------------------------------


def single_flights(requests: DataFrame, key: str, time_us: str, order: str, took: int) -> DataFrame:
    """requests with ``leads`` and ``flight``: a request starts a load of its key that takes ``took``, and those that
    come while it lasts join it. flight is the ``order`` of the request that leads it."""
    led = throttled(requests, key, time_us, order, took).withColumnRenamed("placed", "leads")
    so_far = Window.partitionBy(key).orderBy(time_us, order).rowsBetween(Window.unboundedPreceding, 0)
    return led.withColumn("flight", F.last(F.when(F.col("leads"), F.col(order)), ignorenulls=True).over(so_far))


@dataclass
class FailureThrottle:
    """No attempt within ``wait`` after one that failed."""

    wait: int = FAILURE_WAIT
    failed_at: int | None = None

    def attempt(self, now: int, fails: bool) -> bool:
        if self.failed_at is not None and now < self.failed_at + self.wait:
            return False
        self.failed_at = now if fails else None
        return True


def _with_flag(rows: DataFrame, key: str, order: list[str], flag: str, make) -> DataFrame:
    """rows with a boolean that make()'s rule gives, row by row, for each key."""
    columns = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(group: Rows) -> Iterator[tuple]:
        rule = make()
        for r in group:
            yield *(r[c] for c in columns), rule(r)

    return fold(rows, [key], order, run, f"{schema}, {flag} boolean")


def attempts(requests: DataFrame, key: str, time_us: str, order: str, fails: str, wait: int = FAILURE_WAIT) -> DataFrame:
    """requests(key, time, order, fails) with ``tried``: whether each reaches the source, which ``fails`` then answers."""

    def make():
        t = FailureThrottle(wait)
        return lambda r: t.attempt(int(r[time_us]), bool(r[fails]))

    return _with_flag(requests, key, [time_us, order], "tried", make)


def retries(events: DataFrame, key: str, time_us: str, order: str, progress: str, limit: int = 4, wait: int = 16_000_000) -> DataFrame:
    """events with ``retried``: whether each starts another try, of at most ``limit`` that far apart; events marked
    ``progress`` give the budget back and are no tries."""

    def make():
        t = Retry(limit, wait)

        def rule(r) -> bool:
            if r[progress]:
                t.progress()
                return False
            return t.may(int(r[time_us]))

        return rule

    return _with_flag(events, key, [time_us, order], "retried", make)


def load_outcome(status: Column, provider_fails: Column) -> Column:
    """What a load gives, from load_status(): cached bytes, the provider's, or none; stale ones ask for a refresh."""
    return (
        F.when(status.isin("fresh", "absent_fresh"), F.struct(status.alias("outcome"), F.lit(False).alias("refresh")))
        .when(status.isin("stale", "absent_stale"), F.struct(status.alias("outcome"), F.lit(True).alias("refresh")))
        .otherwise(F.struct(F.when(provider_fails, F.lit("unavailable")).otherwise(F.lit("loaded")).alias("outcome"), F.lit(False).alias("refresh")))
    )


def refresh_change(before: Column, after: Column, failed: Column) -> Column:
    """What a refresh brings, by hashes of the bytes (null: absent). A failure isn't the same as no change."""
    return (
        F.when(failed, F.lit("failed")).when(before.eqNullSafe(after), F.lit("unchanged")).when(before.isNull(), F.lit("appeared"))
        .when(after.isNull(), F.lit("vanished")).otherwise(F.lit("changed"))
    )


def obtain(requests: DataFrame, memory: DataFrame, failures: DataFrame, cache: DataFrame, key: list[str], ttl: int, wait: int = FAILURE_WAIT) -> DataFrame:
    """requests(key.., now) with ``source``: memory(key..), throttled by failures(key.., failed_at), what cache(key.., at,
    empty) answers, or the provider. Each is a left join on the key."""
    m = memory.select(*key).distinct().withColumn("__held", F.lit(True))
    f = failures.groupBy(*key).agg(F.max("failed_at").alias("__failed"))
    c = cache.groupBy(*key).agg(F.max(F.struct("at", "empty")).alias("__cached"))
    j = requests.join(m, key, "left").join(f, key, "left").join(c, key, "left")
    cached = load_status(F.col("now") - F.col("__cached.at"), F.lit(ttl), F.col("__cached").isNotNull(), F.col("__cached.empty"))
    answer = F.when(F.col("__held"), F.lit("memory")).when(F.col("now") < F.col("__failed") + wait, F.lit("throttled")).when(cached == "miss", F.lit("provider")).otherwise(cached)
    return j.withColumn("source", answer).drop("__held", "__failed", "__cached")


def known_absent(answers: DataFrame, key: list[str], order: str, answer: str) -> DataFrame:
    """Tiles that a source is known not to have: those whose last answer is 'absent'. A refresh that could not reach
    the source withdraws it, as data do."""
    last = answers.groupBy(*key).agg(F.max_by(answer, order).alias("__last"))
    return last.where("__last = 'absent'").select(*key)


# -- results ----------------------------------------------------------------------------------------------------


def standing_results(results: DataFrame, key: list[str], order: str, provisional: str) -> DataFrame:
    """The result that stands for each key: the last final one, or the last provisional one where there is no final."""
    top = F.max(F.struct((~F.col(provisional)).alias("f"), F.col(order).alias("o"))).alias("__top")
    best = results.groupBy(*key).agg(top).select(*key, F.col("__top.o").alias(order))
    return results.join(best, [*key, order], "left_semi")


def cached_results(puts: DataFrame, invalidations: DataFrame, key: list[str], signature: str, order: str) -> DataFrame:
    """What a result cache holds: for each key and signature the last put that is final and complete, unless the key
    was invalidated after it."""
    last = puts.where("is_final and complete").groupBy(*key, signature).agg(F.max(order).alias(order))
    gone = invalidations.groupBy(*key).agg(F.max(order).alias("__gone"))
    return last.join(gone, key, "left").where(F.col("__gone").isNull() | (F.col(order) > F.col("__gone"))).drop("__gone")


def cache_totals(entries: DataFrame, cache: str, cost: str) -> DataFrame:
    """Entries and cost of each cache, and of all (cache null)."""
    return entries.rollup(cache).agg(F.count("*").alias("entries"), F.coalesce(F.sum(cost), F.lit(0)).alias("cost"))


def all_cancelled(waiters: DataFrame, job: str, cancelled: str) -> DataFrame:
    """Whether each job's waiters, of which a job here has one at least, have all gone."""
    return waiters.groupBy(job).agg(F.bool_and(cancelled).alias("cancelled"))


def frame_batch(jobs: DataFrame, frame: list[str], order: list[str], cost_us: str, budget: int = FRAME_BUDGET) -> DataFrame:
    """The jobs that a frame gets through: the first one, and others while what was done takes less than the budget."""
    before = Window.partitionBy(*frame).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return jobs.withColumn("__done", F.coalesce(F.sum(cost_us).over(before), F.lit(0))).where(F.col("__done") < budget).drop("__done")


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def missing(pending: Column, resolved: Column) -> Column:
    return F.array_except(pending, resolved)


# -- levels -----------------------------------------------------------------------------------------------------


def tile_state(loading: Column, has_content: Column) -> Column:
    return F.when(loading, F.lit("loading")).when(has_content, F.lit("ready")).otherwise(F.lit("empty"))


def handover(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Tiles of the previous level that stay while the current one loads: all that are still needed, none once no tile of
    the level loads. Both are (z, x, y, loading, has_symbols)."""
    ready = level_ready(current)
    return retained_needed(previous, current).join(F.broadcast(ready.where(~F.col("ready"))), how="left_semi", on=F.lit(True))  # one row


def retained_order(retained: DataFrame, view: list[str]) -> DataFrame:
    """retained tiles with ``turn``, the order they are drawn in: coarse ones first, then by y and x."""
    return retained.withColumn("turn", F.row_number().over(Window.partitionBy(*view).orderBy("z", "y", "x")))


def has_symbol_layer(theme: Theme, zoom: Column) -> Column:
    """Whether any symbol layer of the theme covers a zoom."""
    covers = F.lit(False)
    for y in theme.layers:
        if y.type == "symbol":
            covers = covers | y.covers(zoom)
    return covers


# -- labels -----------------------------------------------------------------------------------------------------


def continuity_key(layer_index: Column, text: Column, icon: Column) -> Column:
    """What makes a label the same one from frame to frame, wherever it stands."""
    return F.struct(layer_index.alias("layer_index"), text.alias("text"), icon.alias("icon"))


def text_style(opacity: Column, halo_width: Column, halo_alpha: Column, size: Column) -> Column:
    """STRUCT<opacity,halo>: the steps in which a label's look is told apart, opacity in 1/32 and the halo in 1/128 of
    the text size."""
    cut = lambda v, hi: F.least(F.greatest(v, F.lit(0.0)), F.lit(hi))
    halo = F.when(halo_alpha <= 0, F.lit(0.0)).otherwise(F.round(cut(halo_width, 8.0) / size * 128))
    return F.struct((F.round(cut(opacity, 1.0) * 32) / 32).alias("opacity"), halo.cast("long").alias("halo"))


def label_candidates(current: DataFrame, retained: DataFrame, ghosts: DataFrame) -> DataFrame:
    """All that may be placed, with ``tier``: the current tiles' labels, the retained ones', then ghosts."""
    tiers = [d.withColumn("tier", F.lit(k)) for k, d in enumerate((current, retained, ghosts))]
    return tiers[0].unionByName(tiers[1]).unionByName(tiers[2])


def live_ghosts(ghosts: DataFrame, now: Column, fade_us: Column) -> DataFrame:
    """ghosts(.., since) that haven't faded out: they are dropped after one fade."""
    return ghosts.where(now - F.col("since") < fade_us)


def replayed(candidates: DataFrame, winners: DataFrame, key: list[str]) -> DataFrame:
    """Between placements only the last one's winners(key.., text_dropped) are drawn, untested; a text dropped then
    stays dropped."""
    w = winners.groupBy(*key).agg(F.bool_or("text_dropped").alias("text_dropped"))
    return candidates.drop("text_dropped").join(w, key)


def fading_out(opacities: DataFrame, shown: DataFrame, drawn: DataFrame, key: list[str], order: str) -> DataFrame:
    """opacities(key.., opacity) of labels that aren't shown any more, with the row of ``drawn`` they had last. They claim
    no room; one that was never drawn leaves nothing."""
    last = drawn.groupBy(*key).agg(F.max(F.struct(order, *[c for c in drawn.columns if c not in (*key, order)])).alias("__last"))
    return opacities.where("opacity > 0").join(shown.select(*key).distinct(), key, "left_anti").join(last, key).select(*key, "opacity", "__last.*")


def reads_backwards(lines: DataFrame, key: list[str], order: list[str], cosine: str) -> DataFrame:
    """lines with ``flipped``: whether a label along a line is turned round. Within FLIP_BAND of the vertical it stays as
    it was, so that is the last row that lay outside the band, or the first."""
    w = Window.partitionBy(*key).orderBy(*order)
    c = F.col(cosine)
    decides = F.when(F.row_number().over(w) == 1, c < 0).when(c < -FLIP_BAND, F.lit(True)).when(c >= FLIP_BAND, F.lit(False))
    told = lines.withColumn("__told", decides)
    return told.withColumn("flipped", F.last("__told", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__told")


def sightings(frames: DataFrame, session: str, frame: str, key: str, x: str, y: str) -> DataFrame:
    """frames(session, frame, key, x, y) with ``entry``: labels of a key nearer than 32 pixels to where one sat are that
    one; one that isn't seen for 90 frames is forgotten. Entries are numbered within the session."""
    s = frames.select(session, frame, key, x, y)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in s.schema.fields)

    def run(rows: Rows) -> Iterator[tuple]:
        memory, count = Memory(), 0
        for r in rows:
            while memory.frame <= r[frame]:
                memory.begin()
            e = memory.sitting(r[key], r[x], r[y])
            if "number" not in e:
                e["number"], count = count, count + 1
            yield r[session], r[frame], r[key], r[x], r[y], e["number"]

    return fold(s, [session], [frame, key, x, y], run, f"{schema}, entry int")


# -- drawing ----------------------------------------------------------------------------------------------------


def symbol_bounds(x: Column, y: Column, w: Column, h: Column, rotated: Column) -> Column:
    """STRUCT<l,t,r,b> around a label's centre; a rotated one's is the square about the circle that it sweeps."""
    r = F.sqrt(w * w + h * h) / 2
    rx, ry = F.when(rotated, r).otherwise(w / 2), F.when(rotated, r).otherwise(h / 2)
    return F.struct((x - rx).alias("l"), (y - ry).alias("t"), (x + rx).alias("r"), (y + ry).alias("b"))


def icon_box(x: Column, y: Column, width: Column, height: Column, pixel_ratio: Column, size: Column, opacity: Column, offset: Column, anchor: Column, margin: Column | float = 0.0) -> Column:
    """STRUCT<l,t,r,b> of a sprite at its icon-size, held by its anchor and moved by offset times the size; null if it
    would not show."""
    from ..functions.geometry import ANCHORS

    w, h = width / pixel_ratio * size, height / pixel_ratio * size
    fx, fy = F.lit(0.5), F.lit(0.5)
    for name, (ax, ay) in ANCHORS.items():
        fx, fy = F.when(anchor == name, F.lit(ax)).otherwise(fx), F.when(anchor == name, F.lit(ay)).otherwise(fy)
    move = lambda i: F.coalesce(F.get(offset, F.lit(i)), F.lit(0.0)) * size
    l, t = x + move(0) - w * fx - margin, y + move(1) - h * fy - margin
    return F.when((size > 0) & (opacity > 0), F.struct(l.alias("l"), t.alias("t"), (l + w + margin * 2).alias("r"), (t + h + margin * 2).alias("b")))


def polygon_path(parts: Column) -> Column:
    """The rings of a polygon as one path, each closed, to be filled by the non-zero rule."""

    def ring(p: Column) -> Column:
        at = lambda i: F.concat_ws(" ", F.get(p, i * 2).cast("double").cast("string"), F.get(p, i * 2 + 1).cast("double").cast("string"))
        n = F.floor(F.size(p) / 2).cast("int")
        return F.concat(F.lit("M "), F.array_join(F.transform(F.sequence(F.lit(0), n - 1), at), " L "), F.lit(" Z"))

    return F.array_join(F.transform(F.filter(parts, lambda p: F.size(p) >= 6), ring), " ")
