"""Joins between display tiles, data tiles and theme layers: all are equi-joins on computed keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tiles as T

#: How many zooms up a loaded ancestor may stand in for a tile.
MAX_UP = 5


def to_data_tiles(display: DataFrame, source: str, delta: int, min_zoom: int, max_zoom: int, cap_at_display: bool = False) -> DataFrame:
    """display(z, x, y, ..) with the key of the data tile that each is drawn from; those without one are left out."""
    key = T.data_key(F.col("z"), F.col("x"), F.col("y"), delta, min_zoom, max_zoom, cap_at_display)
    d = display.withColumn("data", key).where("data is not null").withColumn("source", F.lit(source))
    return d.select("*", F.col("data.z").alias("data_z"), F.col("data.x").alias("data_x"), F.col("data.y").alias("data_y")).drop("data")


def overzoom(display: DataFrame, data: DataFrame) -> DataFrame:
    """display tiles from to_data_tiles() joined with rows of data(source, z, x, y, ..): tiles or features. Many
    display tiles share one data tile, so the display side is aggregated to data keys by no one: it is small."""
    d = data.select(F.col("source").alias("__s"), F.col("z").alias("__z"), F.col("x").alias("__x"), F.col("y").alias("__y"), *[c for c in data.columns if c not in ("source", "z", "x", "y")])
    on = (F.col("source") == F.col("__s")) & (F.col("data_z") == F.col("__z")) & (F.col("data_x") == F.col("__x")) & (F.col("data_y") == F.col("__y"))
    return display.join(d, on).drop("__s", "__z", "__x", "__y")


def nearest_ancestor(wanted: DataFrame, loaded: DataFrame, min_zoom: int = 0, up: int = MAX_UP) -> DataFrame:
    """wanted(z, x, y) -> with anc_z, anc_x, anc_y of the nearest loaded(z, x, y) tile at or above it, at most ``up``
    zooms away. Each tile is looked up once per level; the lowest hit is kept by a partial aggregate."""
    w = wanted.select("z", "x", "y").distinct()
    levels = w.withColumn("up", F.explode(F.sequence(F.lit(0), F.least(F.lit(up), F.col("z") - min_zoom))))
    keyed = levels.where("up >= 0").select("z", "x", "y", "up", (F.col("z") - F.col("up")).alias("anc_z"), T.shr(F.col("x"), F.col("up")).alias("anc_x"), T.shr(F.col("y"), F.col("up")).alias("anc_y"))
    have = loaded.select(F.col("z").alias("anc_z"), F.col("x").alias("anc_x"), F.col("y").alias("anc_y")).distinct()
    hit = keyed.join(have, ["anc_z", "anc_x", "anc_y"]).groupBy("z", "x", "y").agg(F.min("up").alias("up"))
    return hit.select(
        "z", "x", "y", (F.col("z") - F.col("up")).alias("anc_z"), T.shr(F.col("x"), F.col("up")).alias("anc_x"), T.shr(F.col("y"), F.col("up")).alias("anc_y")
    )


def overlapping(a: DataFrame, b: DataFrame, zooms: int = T.MAX_DISPLAY_ZOOM) -> DataFrame:
    """Pairs of tiles of a(z, x, y) and b(z, x, y) that are equal or one above the other: az, ax, ay, bz, bx, by.

    A tile meets another in the ancestor at the higher of the two zooms; so each side is looked up
    by its ancestors at the zooms that occur in the other side, which are few.
    """

    def up(side: DataFrame, other: DataFrame, p: str) -> DataFrame:
        levels = other.select(F.col("z").alias("at")).distinct()
        s = side.select(*[F.col(c).alias(p + c) for c in ("z", "x", "y")]).distinct()
        j = s.join(F.broadcast(levels), F.col("at") <= F.col(p + "z"))  # at most one row per zoom
        n = F.col(p + "z") - F.col("at")
        return j.select(p + "z", p + "x", p + "y", F.col("at").alias("kz"), T.shr(F.col(p + "x"), n).alias("kx"), T.shr(F.col(p + "y"), n).alias("ky"))

    own = lambda side, p: side.select(*[F.col(c).alias(p + c) for c in ("z", "x", "y")], F.col("z").alias("kz"), F.col("x").alias("kx"), F.col("y").alias("ky")).distinct()
    key = ["kz", "kx", "ky"]
    down = up(a, b, "a").join(own(b, "b"), key)  # b is a or above it
    over = own(a, "a").join(up(b, a, "b").where("bz > kz"), key)  # a is above b
    cols = ["az", "ax", "ay", "bz", "bx", "by"]
    return down.select(*cols).unionByName(over.select(*cols))


def retained_needed(retained: DataFrame, current: DataFrame) -> DataFrame:
    """retained(z, x, y, has_symbols) tiles whose labels are still needed: one that overlaps a current(z, x, y, loading,
    has_symbols) tile which is loading and has no symbols, or that overlaps none at all."""
    r = retained.where("has_symbols")
    pairs = overlapping(r, current)
    waiting = current.where("loading and not has_symbols").select(F.col("z").alias("bz"), F.col("x").alias("bx"), F.col("y").alias("by"))
    met = pairs.join(waiting, ["bz", "bx", "by"], "left_semi").select(F.col("az").alias("z"), F.col("ax").alias("x"), F.col("ay").alias("y")).distinct()
    any_ = pairs.select(F.col("az").alias("z"), F.col("ax").alias("x"), F.col("ay").alias("y")).distinct()
    key = ["z", "x", "y"]
    return r.join(met, key, "left_semi").unionByName(r.join(any_, key, "left_anti"))


def level_ready(current: DataFrame) -> DataFrame:
    """One row: whether no tile of the level is loading any more; true for no tiles."""
    return current.agg(F.coalesce(F.bool_and(~F.col("loading")), F.lit(True)).alias("ready"))


def drawn_only(symbols: DataFrame, drawn: DataFrame, key: list[str]) -> DataFrame:
    return symbols.join(drawn.select(*key).distinct(), key, "left_semi")


def grid_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """Tiles to add and to remove, as (z, x, y, change)."""
    key = ["z", "x", "y"]
    a, b = now.select(*key).distinct(), before.select(*key).distinct()
    return a.join(b, key, "left_anti").withColumn("change", F.lit("add")).unionByName(b.join(a, key, "left_anti").withColumn("change", F.lit("remove")))


def with_sprites(rows: DataFrame, sprites: DataFrame, name: str, prefix: str) -> DataFrame:
    """rows with the sprite that their column ``name`` names, if there is one of at least a pixel."""
    s = sprites.where("width >= 1 and height >= 1")
    s = s.select(*[F.col(c).alias(f"{prefix}_{c}") for c in s.columns])
    return rows.join(s, F.col(name) == F.col(f"{prefix}_name"), "left")


def affected(display: DataFrame, refreshed: DataFrame, source: str, delta: int, min_zoom: int, max_zoom: int) -> DataFrame:
    """Display tiles that are drawn from a refreshed(z, x, y) data tile."""
    r = refreshed.select(F.col("z").alias("data_z"), F.col("x").alias("data_x"), F.col("y").alias("data_y"))
    return to_data_tiles(display, source, delta, min_zoom, max_zoom).join(r, ["data_z", "data_x", "data_y"], "left_semi")


def keep_lists(reads: DataFrame) -> DataFrame:
    """reads(source, source_layer, properties: array or null for all) of layers -> one list for each source-layer; null
    if any layer reads all."""
    g = reads.groupBy("source", "source_layer").agg(
        F.bool_or(F.col("properties").isNull()).alias("everything"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("properties")))).alias("properties")
    )
    return g.select("source", "source_layer", F.when(~F.col("everything"), F.col("properties")).alias("properties"))


def nearest(seen: DataFrame, memory: DataFrame, key: list[str], radius: float = 32.0) -> DataFrame:
    """For each row of seen(id, key.., x, y) the nearest memory(entry, key.., mx, my) of its key, nearer than radius.
    Both sides meet in square cells as wide as the radius; memory stands in the nine around it."""
    d2 = (F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2
    cell = lambda c: F.floor(F.col(c) / radius)
    around = F.explode(F.array(*[F.struct((cell("mx") + i).alias("cx"), (cell("my") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    m = memory.withColumn("__at", around).select("*", F.col("__at.cx").alias("__cx"), F.col("__at.cy").alias("__cy")).drop("__at")
    s = seen.withColumn("__cx", cell("x")).withColumn("__cy", cell("y"))
    j = s.join(m, [*key, "__cx", "__cy"]).withColumn("d2", d2).where(F.col("d2") < radius * radius)
    return j.groupBy("id").agg(F.min(F.struct("d2", "entry")).alias("best")).select("id", F.col("best.entry").alias("entry"), F.col("best.d2").alias("d2"))


def first_by(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
