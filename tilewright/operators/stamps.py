"""What is drawn of sprites, as rows: patterns along lines and in areas, icons with their tint and halo; and one order of
all that is drawn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .drawlist import pattern_phase, sdf_edge, sdf_slope
from .joins import with_sprites
from .symbols import _apart

#: Stamps shorter than this, in pixels, are not drawn.
SHORTEST = 0.5
#: The part of an SDF sprite's range at which its shape ends.
EDGE = 0.75


def line_stamps(drawn: DataFrame, sprites: DataFrame) -> DataFrame:
    """A row for each stamp of a draw list's lines with a pattern: z, x, y, layer_index, ord, part, start, stamp, at_x, at_y,
    angle, scale, opacity, sprite.

    Stamps are as high as the line is wide and follow each other without a gap from the beginning of the whole
    line, so they stay where they are when it is cut: ``starts`` says how far along each piece begins.
    sprites(name, width, height, pixel_ratio, ..) is a sheet's index.
    """
    d = drawn.where((F.col("kind") == "line") & F.col("pattern").isNotNull())
    d = with_sprites(d, sprites, "pattern", "sprite").where(F.col("sprite_name").isNotNull())
    d = d.withColumn("scale", F.col("width") / F.col("sprite_height")).withColumn("__step", F.col("sprite_width") * F.col("scale")).where(F.col("__step") >= SHORTEST)
    d = d.select("z", "x", "y", "layer_index", "ord", "opacity", "scale", "__step", F.col("sprite_name").alias("sprite"), F.posexplode(F.arrays_zip("parts", "starts")).alias("part", "__piece"))
    d = _apart(d, __path=F.col("__piece.parts"), __cum=G.distances(G.segment_lengths(F.col("__piece.parts"))))
    total, step = F.element_at("__cum", -1), F.col("__step")
    first = F.pmod(step / 2 - F.col("__piece.starts"), step)
    last = F.ceil((total - first) / step).cast("int") - 1  # the end of a piece is the beginning of another
    places = F.when(first < total, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: first + k * step))
    d = d.select("*", F.posexplode(places).alias("stamp", "__d"))
    d = _apart(d, __q=G.point_at(F.col("__path"), F.col("__cum"), F.col("__d")))
    return d.select("z", "x", "y", "layer_index", "ord", "part", F.col("__piece.starts").alias("start"), "stamp", F.col("__q.x").alias("at_x"), F.col("__q.y").alias("at_y"), F.col("__q.angle").alias("angle"), "scale", "opacity", "sprite")


def pattern_cells(drawn: DataFrame, sprites: DataFrame) -> DataFrame:
    """A row for each cell of the pattern that the bounds of a draw list's areas touch, within the tile's buffer: z, x, y,
    layer_index, ord, i, j, left, top, width, height, opacity, sprite.

    Cells have the sprite's size in pixels and are counted from the world's corner, so that they run on from tile to tile. The
    area itself is what they are cut by when they are drawn.
    """
    d = drawn.where((F.col("kind") == "fill") & F.col("pattern").isNotNull())
    d = with_sprites(d, sprites, "pattern", "sprite").where(F.col("sprite_name").isNotNull())
    every = F.flatten("parts")
    xs = F.filter(F.transform(every, lambda v, i: F.when(i % 2 == 0, v)), lambda v: v.isNotNull())
    ys = F.filter(F.transform(every, lambda v, i: F.when(i % 2 == 1, v)), lambda v: v.isNotNull())
    w, h = F.col("sprite_width") / F.col("sprite_pixel_ratio"), F.col("sprite_height") / F.col("sprite_pixel_ratio")
    d = _apart(d.where(F.size(every) >= 2), __w=w, __h=h, __l=F.array_min(xs), __r=F.array_max(xs), __t=F.array_min(ys), __b=F.array_max(ys))
    d = d.withColumn("__ox", pattern_phase(F.col("x"), F.col("__w"))).withColumn("__oy", pattern_phase(F.col("y"), F.col("__h")))

    def cells(low: str, high: str, origin: str, size: str) -> Column:
        a, b = (F.floor((F.col(c) - F.col(origin)) / F.col(size)) for c in (low, high))
        return F.sequence(a, b)

    d = d.withColumn("i", F.explode(cells("__l", "__r", "__ox", "__w"))).withColumn("j", F.explode(cells("__t", "__b", "__oy", "__h")))
    at = lambda k, o, s: F.col(o) + F.col(k) * F.col(s)
    return d.select("z", "x", "y", "layer_index", "ord", "i", "j", at("i", "__ox", "__w").alias("left"), at("j", "__oy", "__h").alias("top"), F.col("__w").alias("width"), F.col("__h").alias("height"), "opacity", F.col("sprite_name").alias("sprite"))


def icon_rows(icons: DataFrame, sprites: DataFrame, device_ratio: float = 1.0) -> DataFrame:
    """icons(.., icon, rect: l, t, r, b, icon_size, icon_opacity, icon_color, icon_halo_color, icon_halo_width) with a row for
    each image that is drawn, in the order of ``turn``: src, the rectangle of the sheet, alpha, and matrix, the 4 x 5
    colour matrix, null for sprites that have their own colours.

    A distance field is tinted by a matrix that sets the colour and cuts the field at its edge: once farther out for the
    halo, if it has a colour and a width, and once for the shape. The cut is as steep as a pixel of the device.
    sprites(name, x, y, width, height, pixel_ratio, sdf) is a sheet's index.
    """
    s = with_sprites(icons, sprites, "icon", "sprite").where(F.col("sprite_name").isNotNull())
    opacity = F.least(F.greatest(F.col("icon_opacity"), F.lit(0.0)), F.lit(1.0))
    slope = sdf_slope((F.col("rect.r") - F.col("rect.l")) * device_ratio / F.col("sprite_width"))

    def tinted(turn: int, c: Column, edge: Column) -> Column:
        zero = F.lit(0.0)
        m = [x for k in "rgb" for x in (zero, zero, zero, zero, c[k] * 255)] + [zero, zero, zero, slope, (0.5 - edge * slope) * 255]
        alpha = F.least(F.greatest(opacity * c["a"], F.lit(0.0)), F.lit(1.0))
        return F.struct(F.lit(turn).alias("turn"), alpha.alias("alpha"), F.array(*m).alias("matrix"))

    halo = F.col("icon_halo_color").isNotNull() & (F.col("icon_halo_color.a") > 0) & (F.col("icon_halo_width") > 0)
    outer = F.when(F.col("sprite_sdf") & halo, tinted(0, F.col("icon_halo_color"), sdf_edge(F.col("icon_halo_width"), F.col("icon_size"))))
    plain = F.struct(F.lit(1).alias("turn"), opacity.alias("alpha"), F.lit(None).cast("array<double>").alias("matrix"))
    own = F.when(F.col("sprite_sdf"), tinted(1, F.col("icon_color"), F.lit(EDGE))).otherwise(plain)
    shown = s.where((opacity > 0) & (F.col("icon_size") > 0))
    src = F.struct(*[F.col(f"sprite_{k}").alias(k) for k in ("x", "y", "width", "height")])
    kept = [F.col(c) for c in icons.columns]
    return shown.select(*kept, src.alias("src"), F.inline(F.filter(F.array(outer, own), lambda r: r.isNotNull())))


def tile_draws(rows: DataFrame, tier: Column) -> DataFrame:
    """Rows of tiles (z, x, y, layer_index, ord) with their ``place`` in the order of drawing: retained tiles (a lower tier) before current
    ones, coarse ones first, then from the top, each tile by layer and input order."""
    block = F.struct(F.lit(0).alias("stage"), tier.cast("long").alias("a"), F.col("z").cast("long").alias("b"), F.shiftright(F.col("y"), 4).cast("long").alias("c"))
    return _with_place(rows, block, F.col("y"), F.col("x"), F.col("layer_index"))


def label_draws(rows: DataFrame, opacity: Column) -> DataFrame:
    """Rows of labels and ghosts (layer_index, ord) with their ``place``: after all tiles, the opaque ones by layer and order, then those that
    fade by ascending opacity."""
    block = F.struct(F.lit(1).alias("stage"), F.when(opacity >= 1, 0).otherwise(1 + F.round(opacity * 1000)).cast("long").alias("a"), F.col("layer_index").cast("long").alias("b"), F.shiftright(F.col("ord"), 12).cast("long").alias("c"))
    return _with_place(rows, block, F.lit(0), F.lit(0), F.lit(0))


def _with_place(rows: DataFrame, block: Column, p: Column, q: Column, r: Column) -> DataFrame:
    return rows.withColumn("place", F.struct(block.alias("block"), p.cast("long").alias("p"), q.cast("long").alias("q"), r.cast("long").alias("r"), F.col("ord").cast("long").alias("ord")))


def draw_turns(rows: DataFrame) -> DataFrame:
    """rows with ``turn``, 1 for what is drawn first of all, by their ``place``; rows of the same place in no certain order.

    Only the sizes of blocks, one for 16 rows of tiles or 4,096 labels of a layer, meet in one window. Within a block
    tiles are counted, and rows within tiles.
    """
    block, tile = F.col("place.block"), (F.col("place.p"), F.col("place.q"))
    keyed = rows.withColumn("__block", block).withColumn("__p", tile[0]).withColumn("__q", tile[1])
    tiles = keyed.groupBy("__block", "__p", "__q").agg(F.count("*").alias("__n"))
    before = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = tiles.groupBy("__block").agg(F.sum("__n").alias("__n"))
    blocks = blocks.select("__block", before(Window.orderBy("__block")).alias("__first"))
    tiles = tiles.withColumn("__within", before(Window.partitionBy("__block").orderBy("__p", "__q"))).drop("__n")
    own = F.row_number().over(Window.partitionBy("__block", "__p", "__q").orderBy("place"))
    joined = keyed.withColumn("__own", own).join(tiles, ["__block", "__p", "__q"]).join(blocks, "__block")
    return joined.withColumn("turn", F.col("__first") + F.col("__within") + F.col("__own")).select(*rows.columns, "turn")
