"""Labels: candidates from features, and their placement in order of priority."""

from __future__ import annotations

import math
import re
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import tiles as T
from ..plans.expressions import Context, MapView
from ..plans.theme import TOP_ZOOM, Theme
from .drawlist import meets, window
from .folds import fold_columns
from .joins import with_sprites

#: Pixels that an anchor may lie outside its tile, and outside the screen.
SEAM, OFFSCREEN = 0.5, 150.0
#: The width of a character and the height of a line, in text sizes: there is no text engine here.
CHAR_WIDTH, LINE_HEIGHT, MAX_LINES = 0.5, 1.15, 4
#: The least width that lines are broken to, in text sizes.
MIN_WIDTH = 2.0
MIN_SIZE, MAX_SIZE = 1.0, 96.0
ICON_MARGIN = 2.0

# Code points of scripts whose letters join or stack, so that they can't be set one by one along a curve.
JOINED_SCRIPTS = "֐-ࣿऀ-෿฀-࿿က-႟ក-៿᠀-᢯יִ-﷿ﹰ-﻿"


def curve_safe(text: Column) -> Column:
    return ~F.rlike(text, F.lit(f"[{JOINED_SCRIPTS}]"))


def transformed(text: Column, how: Column) -> Column:
    return F.when(how == "uppercase", F.upper(text)).when(how == "lowercase", F.lower(text)).otherwise(text)


def quantised_zoom(zoom: Column) -> Column:
    return F.round(zoom * 8) / 8


def candidates(features: DataFrame, theme: Theme, zoom: float, view=None, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per place where a symbol layer may put a label, for placed() features: layer_index, text, icon, anchor_x,
    anchor_y (pixels of the display tile), angle, along_line, path_distance, sort_key, and the layer's properties.

    Points give an anchor for each vertex, lines one in the middle of each part, polygons one at the
    centre of their first ring; with line placement lines and rings give one each spacing.
    Anchors outside the tile, with a seam, are left out.
    """
    ctx = Context(view or MapView(F.col("properties")), zoom, F.col("geom_type"), F.col("fid"))
    rect = window(F.col("scale"), F.col("off_x"), F.col("off_y"), SEAM)
    branches = []
    for y in theme.layers:
        if y.type != "symbol" or not (zoom + 1 > y.minzoom and zoom < y.maxzoom):
            continue
        p = y.resolved(ctx)
        own = features.where((F.col("source") == y.source) & (F.col("source_layer") == y.source_layer)).where(meets(rect)).where(y.filter_column(ctx).value.col)
        keep = ["z", "x", "y", "ord", "geom_type", "parts", "scale", "off_x", "off_y", *extra]
        named = {k: c.alias(k) for k, c in p.items()}
        own = own.select(*keep, *named.values())
        text = F.trim(transformed(F.col("text_field"), F.col("text_transform")))
        own = own.withColumn("text", text).withColumn("icon", F.nullif(F.trim("icon_image"), F.lit(""))).where((F.col("text") != "") | F.col("icon").isNotNull())
        own = own.withColumn("layer_index", F.lit(y.index)).withColumn("layer", F.lit(y.id))
        branches.append(_anchors(own, y.properties.get("symbol-placement")).drop("parts", "scale", "off_x", "off_y", "at"))
    if not branches:
        raise ValueError("no layer of the theme has symbols at this zoom")
    made = reduce(DataFrame.unionByName, branches)
    return made.withColumnRenamed("symbol_sort_key", "sort_key")


def _anchors(f: DataFrame, placement: Any) -> DataFrame:
    """f with a row for each anchor. Only what the layer can ask for is part of the plan: lines are followed
    unless the style's own text says that labels stand at points."""
    px = lambda x, y: (x * F.col("scale") + F.col("off_x"), y * F.col("scale") + F.col("off_y"))

    def point(x: Column, y: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"), F.lit(0.0).alias("angle"), F.lit(False).alias("line"), F.lit(None).cast("double").alias("d"))

    def vertices(p: Column) -> Column:
        every = F.filter(F.transform(p, lambda v, i: F.when(i % 2 == 0, F.struct(v.cast("double").alias("x"), F.get(p, i + 1).cast("double").alias("y")))), lambda v: v.isNotNull())
        return F.transform(every, lambda v: point(*px(v["x"], v["y"])))

    def single(m: Column) -> Column:
        return G.let(m, lambda v: point(*px(v["x"], v["y"])))

    def along(p: Column) -> Column:
        scaled = F.transform(p, lambda v, i: (v * F.col("scale") + F.when(i % 2 == 0, F.col("off_x")).otherwise(F.col("off_y"))).cast("float"))

        def at(path: Column, cum: Column) -> Column:
            stand = lambda q, d: F.struct(q["x"].alias("x"), q["y"].alias("y"), q["angle"].alias("angle"), F.lit(True).alias("line"), d.alias("d"))
            spots = G.let(F.element_at(cum, -1).cast("double"), lambda length: G.anchor_distances(length, F.col("symbol_spacing")))
            return F.transform(spots, lambda d: G.let(G.point_at(path, cum, d), lambda q: stand(q, d)))

        return G.let(scaled, lambda path: G.let(G.cumulative(path), lambda cum: at(path, cum)))

    kind = F.col("geom_type")
    at = F.when(kind == "Point", F.flatten(F.transform("parts", vertices))).when(kind == "LineString", F.transform("parts", lambda p: single(G.midpoint(p))))
    at = at.otherwise(F.array(G.let(F.get("parts", F.lit(0)), lambda p: single(G.centroid(p)))))
    if placement not in (None, "point"):
        lines = kind != "Point" if isinstance(placement, str) else (F.col("symbol_placement") != "point") & (kind != "Point")
        at = F.when(lines, F.flatten(F.transform("parts", along))).otherwise(at)
    f = f.withColumn("at", F.explode(at))
    inside = (F.col("at.x") >= -SEAM) & (F.col("at.x") < T.TILE_PX + SEAM) & (F.col("at.y") >= -SEAM) & (F.col("at.y") < T.TILE_PX + SEAM)
    return f.where(inside).select(
        "*", F.col("at.x").alias("anchor_x"), F.col("at.y").alias("anchor_y"), F.col("at.angle").alias("angle"), F.col("at.line").alias("along_line"), F.col("at.d").alias("path_distance")
    )


def to_screen(c: DataFrame, zoom: float, centre: tuple[float, float], size: tuple[float, float], rotation: float = 0.0) -> DataFrame:
    """Anchors to screen pixels: screen_x, screen_y. centre is in world pixels at the zoom; anchors are moved relative
    to it first, in doubles, so that nothing is lost at high zooms. Those far outside the screen are left out."""
    s = F.pow(F.lit(2.0), F.lit(zoom) - F.col("z"))
    wx = (F.col("x") * T.TILE_PX + F.col("anchor_x")) * s - centre[0]
    wy = (F.col("y") * T.TILE_PX + F.col("anchor_y")) * s - centre[1]
    co, si = math.cos(rotation), math.sin(rotation)
    moved = c.withColumn("screen_x", wx * co - wy * si + size[0] / 2).withColumn("screen_y", wx * si + wy * co + size[1] / 2)
    x, y = F.col("screen_x"), F.col("screen_y")
    return moved.where((x >= -OFFSCREEN) & (x <= size[0] + OFFSCREEN) & (y >= -OFFSCREEN) & (y <= size[1] + OFFSCREEN))


def band_opacity(zoom: Column, minzoom: Column | float, maxzoom: Column | float) -> Column:
    """How far a layer has faded out before its maxzoom: over a quarter zoom, or its whole band if that is less, in
    steps of an eighth. Layers whose maxzoom isn't declared don't fade."""
    lo = minzoom if isinstance(minzoom, Column) else F.lit(float(minzoom))
    hi = maxzoom if isinstance(maxzoom, Column) else F.lit(float(maxzoom))
    span = F.least(F.lit(0.25), hi - lo)
    ramp = F.floor(F.least(F.greatest((hi - zoom) / span, F.lit(0.0)), F.lit(1.0)) * 8) / 8
    return F.when((hi >= TOP_ZOOM) | (span <= 0), F.lit(1.0)).otherwise(ramp)


def opacity_step(o: Column, ghost: Column | None = None) -> Column:
    """Opacity in eighths; what is above 0 stays so, but for ghosts, which are rounded down."""
    steps = F.greatest(F.lit(1.0), F.round(o * 8)) / 8
    if ghost is not None:
        steps = F.when(ghost, F.floor(o * 8) / 8).otherwise(steps)
    return F.when(o <= 0, F.lit(0.0)).otherwise(steps)


def priority(keep: list[str] | None = None) -> list[Column]:
    """Placement order: layers from the top, then sort key, then from the screen's top, then input order."""
    return [F.desc("layer_index"), F.asc("sort_key"), F.asc("screen_y"), F.asc("ord"), *[F.asc(k) for k in keep or []]]


def with_priority(c: DataFrame, screen: list[str], more: list[str] | None = None) -> DataFrame:
    return c.withColumn("rank", F.row_number().over(Window.partitionBy(*screen).orderBy(*priority(more))))


def opacity_buckets(drawn: DataFrame) -> DataFrame:
    """Rows per opacity with the box around them: what is drawn together."""
    return drawn.groupBy("opacity").agg(F.count("*").alias("n"), F.min("l").alias("l"), F.min("t").alias("t"), F.max("r").alias("r"), F.max("b").alias("b"))


def wrapped(text: Column, max_width: Column) -> Column:
    """ARRAY<STRING>: a text's lines, at most MAX_LINES of at most max_width text sizes.

    Words go on a line while they fit it with a space before them; one that is longer than a line is broken.
    A line feed begins a line; white space where lines break is dropped.
    """
    room = F.greatest(F.floor(F.greatest(max_width, F.lit(MIN_WIDTH)) / CHAR_WIDTH), F.lit(1)).cast("int")

    def pieces(w: Column) -> Column:
        last = F.floor((F.greatest(F.length(w), F.lit(1)) - 1) / room).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(w, i * room + 1, room))

    def step(a: Column, w: Column) -> Column:
        line = F.concat(a["now"], F.lit(" "), w)
        fits = (w != "\n") & (F.length(line) <= room)
        end = F.concat(a["lines"], F.array(a["now"]))
        return (
            F.when(a["now"].isNull(), F.struct(a["lines"].alias("lines"), F.when(w == "\n", "").otherwise(w).alias("now")))
            .when(a["now"] == "", F.struct(F.when(w == "\n", end).otherwise(a["lines"]).alias("lines"), F.when(w == "\n", "").otherwise(w).alias("now")))
            .when(fits, F.struct(a["lines"].alias("lines"), line.alias("now")))
            .otherwise(F.struct(end.alias("lines"), F.when(w == "\n", "").otherwise(w).alias("now")))
        )

    apart = F.filter(F.split(F.regexp_replace(text, "[ \\t\\r]*\n[ \\t\\r]*", " \n "), "[ \\t\\r]+"), lambda w: w != "")
    words = F.flatten(F.transform(apart, pieces))
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit(None).cast("string").alias("now"))
    every = F.aggregate(words, start, step, lambda a: F.when(a["now"].isNull(), a["lines"]).otherwise(F.concat(a["lines"], F.array(a["now"]))))
    return F.slice(every, 1, MAX_LINES)


def text_box(text: Column, size: Column, max_width: Column, along: Column) -> tuple[Column, Column]:
    """Width and height of a label under the width model, broken into lines unless it stands along one."""
    lines = F.when(along, F.array(text)).otherwise(wrapped(text, max_width))
    longest = F.coalesce(F.array_max(F.transform(lines, lambda line: F.length(line))), F.lit(0))
    return longest * size * CHAR_WIDTH, F.greatest(F.size(lines), F.lit(1)) * size * LINE_HEIGHT


def rough_box(text: Column, size: Column, max_width: Column) -> tuple[Column, Column]:
    """Width and height of a text by its length alone, as if words could be cut anywhere: an estimate that follows no words,
    for texts far longer than a label."""
    full, per_line = F.length(text) * size * CHAR_WIDTH, F.greatest(max_width * size, size)
    lines = F.least(F.lit(float(MAX_LINES)), F.greatest(F.lit(1.0), F.ceil(full / per_line)))
    return F.least(full, per_line), lines * size * LINE_HEIGHT


def readable(opacity: Column, size: Column) -> Column:
    return (opacity > 0) & (size >= MIN_SIZE) & ~F.isnan(size)


def boxes(c: DataFrame) -> DataFrame:
    """Candidates on the screen with ``text_boxes``: for each anchor that may be tried, in order, the box of the text;
    and icon_w, icon_h. Sizes are cut to what is readable."""
    size = F.least(F.greatest(F.col("text_size"), F.lit(MIN_SIZE)), F.lit(MAX_SIZE))
    c = _apart(c, __box=F.struct(*[v.alias(k) for k, v in zip("wh", text_box(F.col("text"), size, F.col("text_max_width"), F.col("along_line")))]))
    w, h = F.col("__box.w"), F.col("__box.h")
    has = (F.col("text") != "") & readable(F.col("text_opacity"), F.col("text_size"))
    tried = F.coalesce(F.col("text_variable_anchor"), F.array("text_anchor"))
    variable = F.col("text_variable_anchor").isNotNull()
    rw, rh = G.rotated_size(w, h, F.col("angle"))

    def one(a: Column) -> Column:
        fx, fy = F.lit(0.5), F.lit(0.5)
        sx, sy = F.lit(0.0), F.lit(0.0)
        for name, (x, y) in G.ANCHORS.items():
            fx, fy = F.when(a == name, F.lit(x)).otherwise(fx), F.when(a == name, F.lit(y)).otherwise(fy)
            mx, my = G.radial_shift(name, 1.0)
            sx, sy = F.when(a == name, F.lit(mx)).otherwise(sx), F.when(a == name, F.lit(my)).otherwise(sy)
        r = F.col("text_radial_offset") * size
        off = lambda i: F.coalesce(F.get("text_offset", F.lit(i)), F.lit(0.0)) * size
        dx, dy = F.when(variable, sx * r).otherwise(off(0)), F.when(variable, sy * r).otherwise(off(1))
        left, top = F.col("screen_x") - rw * fx + dx, F.col("screen_y") - rh * fy + dy
        pad = F.col("text_padding")
        return F.struct(a.alias("anchor"), (left - pad).alias("l"), (top - pad).alias("t"), (left + rw + pad).alias("r"), (top + rh + pad).alias("b"))

    return c.withColumn("text_boxes", F.when(has, F.transform(tried, one)).otherwise(F.transform(F.slice(tried, 1, 0), one))).drop("__box")


def icon_boxes(c: DataFrame, sprites: DataFrame) -> DataFrame:
    """Candidates with ``icon_box``: the room that their icon takes, with its margin; null without a sprite that shows.
    sprites(name, width, height, pixel_ratio, ..) is a sheet's index."""
    from .tilestore import icon_box

    s = with_sprites(c, sprites, "icon", "sprite")
    args = ("screen_x", "screen_y", "sprite_width", "sprite_height", "sprite_pixel_ratio", "icon_size", "icon_opacity", "icon_offset", "icon_anchor")
    box = F.when(F.col("sprite_name").isNotNull(), icon_box(*map(F.col, args), margin=ICON_MARGIN))
    return s.withColumn("icon_box", box).drop(*[f"sprite_{k}" for k in sprites.columns])


def placeable(c: DataFrame, sprites: DataFrame) -> DataFrame:
    """Candidates on the screen as place() takes them: the boxes of their text and icon, and whether they may overlap,
    which the text's property decides where there is text. Candidates with neither are left out."""
    b = icon_boxes(boxes(c), sprites)
    has = F.size("text_boxes") > 0
    return b.where(has | F.col("icon_box").isNotNull()).withColumn("allow_overlap", F.when(has, F.col("text_allow_overlap")).otherwise(F.col("icon_allow_overlap")))


#: A glyph's height along a line in text sizes, and the bend, in radians, up to which a line counts as straight.
GLYPH_HEIGHT, STRAIGHT = 1.2, 0.02


def along_lines(c: DataFrame, was_flipped: Column | None = None) -> DataFrame:
    """c(text, text_size, path, path_distance, text_offset, text_padding, text_max_angle, text_keep_upright) with path on
    the screen -> with flipped, glyphs (array of char, x, y, angle, w) and glyph_boxes: null where the
    label doesn't fit its line or would bend too sharply.

    Each character but spaces stands on the line and is turned with it; the label is walked backwards where
    it would read upside down. ``was_flipped`` tells how it read before, and holds near the vertical. A
    label that is straight, and not moved off its line, takes one box.
    """
    from .tilestore import FLIP_BAND

    size, n, pad, pi = F.col("text_size"), F.length("text"), F.col("text_padding"), math.pi
    char = size * CHAR_WIDTH
    half, mid = char * n / 2, F.col("path_distance")
    off = F.coalesce(F.get("text_offset", F.lit(1)), F.lit(0.0)) * size
    at = lambda d: G.point_at(F.col("path"), F.col("__cum"), d)

    f = _apart(_apart(c, __len=G.segment_lengths(F.col("path"))), __cum=G.distances(F.col("__len")))
    f = _apart(f, __a=at(mid - half), __b=at(mid + half), __mid=at(mid))
    dx, dy = (F.col(f"__b.{k}") - F.col(f"__a.{k}") for k in "xy")
    chord = F.sqrt(dx * dx + dy * dy)
    edge = F.lit(0.0) if was_flipped is None else F.when(was_flipped.isNull(), 0.0).when(was_flipped, FLIP_BAND).otherwise(-FLIP_BAND)
    before = F.lit(False) if was_flipped is None else F.coalesce(was_flipped, F.lit(False))
    f = _apart(f, flipped=F.when(chord > 0, dx / chord < edge).otherwise(before))
    back = F.col("flipped") & F.coalesce(F.col("text_keep_upright"), F.lit(True))

    def glyph(i: Column) -> Column:
        centre = (i + 0.5) * char
        return F.struct(F.substring("text", i + 1, F.lit(1)).alias("char"), at(F.when(back, mid + half - centre).otherwise(mid - half + centre)).alias("q"))

    def stand(g: Column) -> Column:
        turned = g["q"]["angle"] + F.when(back, pi).otherwise(0.0)
        angle = F.when(turned > pi, turned - 2 * pi).otherwise(turned)
        return F.struct(g["char"].alias("char"), (g["q"]["x"] - F.sin(angle) * off).alias("x"), (g["q"]["y"] + F.cos(angle) * off).alias("y"), angle.alias("angle"), char.alias("w"))

    def box(x: Column, y: Column, w: Column, h: Column, angle: Column) -> Column:
        rw, rh = G.rotated_size(w, h, angle)
        return F.struct((x - rw / 2 - pad).alias("l"), (y - rh / 2 - pad).alias("t"), (x + rw / 2 + pad).alias("r"), (y + rh / 2 + pad).alias("b"))

    f = _apart(f, __on=F.filter(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), glyph), lambda g: ~F.rlike(g["char"], F.lit(r"\s"))))
    f = _apart(f, __glyphs=F.transform("__on", stand), __angles=F.transform("__on", lambda g: stand(g)["angle"]))
    fits = (n > 0) & (mid - half >= 0) & (mid + half <= F.element_at("__cum", -1)) & ~too_bent(F.col("__angles"), F.col("text_max_angle"))
    f = _apart(f, __fits=fits, __straight=(max_deviation(F.col("__angles")) < STRAIGHT) & (off == 0))
    whole = F.array(box(F.col("__mid.x"), F.col("__mid.y"), half * 2, size * LINE_HEIGHT, F.col("__mid.angle")))
    each = F.transform("__glyphs", lambda g: box(g["x"], g["y"], g["w"], size * GLYPH_HEIGHT, g["angle"]))
    f = f.withColumn("glyphs", F.when(F.col("__fits"), F.col("__glyphs"))).withColumn("glyph_boxes", F.when(F.col("__fits"), F.when(F.col("__straight"), whole).otherwise(each)))
    return f.drop(*[k for k in f.columns if k.startswith("__")])


def _apart(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed where they stand: the optimiser writes no expression out into a later one, as it
    would with each use, and nested lambdas stay few."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


Box = tuple[float, float, float, float]
PLACED = "placed boolean, anchor string, text_dropped boolean"
#: Cells a side of the grid that tells which boxes collide for certain, and candidates, first and at most, that it is asked of at once.
CELLS, FIRST_CHUNK, CHUNK = 256, 32, 1024


class Claimed:
    """Claimed boxes of one screen, in columns. Boxes collide if they overlap; those that only touch don't."""

    def __init__(self):
        self.n = 0
        self.boxes = np.empty((4, 32))

    def free(self, b: Box) -> bool:
        l, t, r, low = self.boxes[:, : self.n]
        return not self.n or not ((b[0] < r) & (l < b[2]) & (b[1] < low) & (t < b[3])).any()

    def claim_all(self, every: list[Box]) -> bool:
        """All boxes of a symbol or none; they aren't tested against each other."""
        if not all(map(self.free, every)):
            return False
        while self.n + len(every) > self.boxes.shape[1]:
            self.boxes = np.hstack([self.boxes, np.empty_like(self.boxes)])
        self.boxes[:, self.n : self.n + len(every)] = np.array(every).T
        self.n += len(every)
        return True


class Covered:
    """A grid over all boxes of a screen with the cells that lie wholly in a claimed box. A box that shares more than an edge with
    such a cell collides for certain, which sums over the grid tell for many boxes at once; of others it says nothing."""

    def __init__(self, every: list[np.ndarray]):
        b = np.vstack(every)
        b = b[np.isfinite(b).all(1)]
        self.low = b[:, :2].min(0) if len(b) else np.zeros(2)
        self.cell = np.maximum((b[:, 2:].max(0) - self.low) / CELLS, 1e-9) if len(b) else np.ones(2)
        self.full = np.zeros((CELLS, CELLS), np.int32)
        self.seen = 0
        self.sums = np.zeros((CELLS + 1, CELLS + 1), np.int32)

    def _at(self, v: np.ndarray, to) -> np.ndarray:
        return np.clip(to((v - self.low) / self.cell), 0, CELLS).astype(int)

    def update(self, claimed: Claimed) -> None:
        new = claimed.boxes[:, self.seen : claimed.n].T
        self.seen = claimed.n
        new = new[~np.isnan(new).any(1)]
        if len(new):
            for (l, t), (r, low) in zip(self._at(new[:, :2], np.ceil).tolist(), self._at(new[:, 2:], np.floor).tolist()):
                self.full[l:r, t:low] = 1
            self.sums[1:, 1:] = self.full.cumsum(0).cumsum(1)

    def blocks(self, b: np.ndarray) -> np.ndarray:
        ok = np.isfinite(b).all(1)
        if not self.seen or not ok.any():
            return np.zeros(len(b), bool)
        b = np.where(ok[:, None], b, 0.0)
        (l, t), (r, low) = self._at(b[:, :2], np.floor).T, self._at(b[:, 2:], np.ceil).T
        n = self.sums[r, low] - self.sums[l, low] - self.sums[r, t] + self.sums[l, t]
        return ok & (l < r) & (t < low) & (n > 0)


def _boxes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array | None]:
    """Of an array of boxes a row: where each row's begin, and all boxes, with their anchors if they have any."""
    flat = column.flatten()
    sizes = pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False)
    return np.append(0, np.cumsum(sizes)), _sides(flat), flat.field("anchor") if "anchor" in [f.name for f in flat.type] else None


def _sides(boxes: pa.StructArray) -> np.ndarray:
    return np.column_stack([boxes.field(k).to_numpy(zero_copy_only=False) for k in "ltrb"]).astype(np.float64)


def place(c: DataFrame, screen: list[str], order: list[str], remembered: str | None = None) -> DataFrame:
    """Greedy placement on each screen, of points, icons, labels along lines and ghosts in one order: candidates take the
    first of their text_boxes that is free together with their icon_box. Adds placed, anchor and text_dropped.

    Columns: text_boxes, icon_box (l, t, r, b or null), allow_overlap (neither tests nor claims),
    text_optional (the icon alone will do); if there are such, glyph_boxes, the boxes of a label along a line,
    all of which it takes or none, null for others, and ghost, which is drawn as it was and neither tests
    nor claims. ``remembered`` names a column with the anchor used last, which is tried first if the style
    still offers it. What one candidate may take depends on all before it, so a screen is one task's
    work, of as many candidates as a screen has; screens are independent.
    """
    extra = [k for k in ("glyph_boxes", "ghost") if k in c.columns]

    def step(t: pa.Table, starts: np.ndarray) -> list[pa.Array]:
        column = lambda k: t.column(k).combine_chunks()
        flags = lambda k: pc.fill_null(column(k), False).to_numpy(zero_copy_only=False)
        n = t.num_rows
        at, boxes, names = _boxes_of(column("text_boxes"))
        glyph_at, glyphs, _ = _boxes_of(column("glyph_boxes")) if "glyph_boxes" in extra else (np.zeros(n + 1, int), np.empty((0, 4)), None)
        icon = column("icon_box")
        icons, has_icon = _sides(icon), icon.is_valid().to_numpy(zero_copy_only=False)
        overlap, optional = flags("allow_overlap"), flags("text_optional")
        ghost = flags("ghost") if "ghost" in extra else np.zeros(n, bool)
        held = column(remembered).to_pylist() if remembered else [None] * n
        along = np.diff(glyph_at) > 0
        untried = ~along & (np.diff(at) == 0)
        placed, dropped, anchors = ghost.copy(), np.zeros(n, bool), [h if g else None for h, g in zip(held, ghost.tolist())]
        for first, end in zip(starts.tolist(), [*starts[1:].tolist(), n]):
            claimed = Claimed()
            covered = Covered([boxes[at[first] : at[end]], glyphs[glyph_at[first] : glyph_at[end]], icons[first:end][has_icon[first:end]]])
            low, size = first, FIRST_CHUNK
            while low < end:
                high = min(low + size, end)
                size = min(size * 2, CHUNK)
                covered.update(claimed)
                # what collides already will do so at its turn: only the others are tried one after the other
                free = _counts(~covered.blocks(boxes[at[low] : at[high]]), at[low : high + 1]) > 0
                bent = _counts(covered.blocks(glyphs[glyph_at[low] : glyph_at[high]]), glyph_at[low : high + 1]) > 0
                may = np.where(along[low:high], ~bent, free) | (has_icon[low:high] & (untried[low:high] | optional[low:high]))
                may &= ~(has_icon[low:high] & covered.blocks(icons[low:high]))
                for i in (low + np.flatnonzero((may | overlap[low:high]) & ~ghost[low:high])).tolist():
                    if along[i]:
                        tried = [("center", list(map(tuple, glyphs[glyph_at[i] : glyph_at[i + 1]].tolist())))]
                    else:
                        tried = [(names[k].as_py(), [tuple(boxes[k].tolist())]) for k in range(at[i], at[i + 1])]
                    if held[i]:
                        tried.sort(key=lambda x: x[0] != held[i])
                    placed[i], anchors[i], dropped[i] = _try(claimed, tried, [tuple(icons[i].tolist())] if has_icon[i] else [], overlap[i], optional[i])
                low = high
        return [pa.array(placed), pa.array(anchors, pa.string()), pa.array(dropped)]

    return fold_columns(c, screen, order, step, PLACED)


def _counts(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many marks lie between each two places."""
    return np.diff(np.append(0, np.cumsum(marks))[at - at[0]])


def _try(claimed: Claimed, tried: list[tuple[str, list[Box]]], icon: list[Box], allow_overlap: bool, text_optional: bool) -> tuple[bool, str | None, bool]:
    """Whether a candidate is placed, with which anchor, and whether without its text."""
    if not tried and not icon:
        return False, None, False
    if allow_overlap:
        return True, tried[0][0] if tried else None, False
    for anchor, taken in tried:
        if claimed.claim_all([*taken, *icon]):
            return True, anchor, False
    if icon and (not tried or text_optional) and claimed.claim_all(icon):
        return True, None, bool(tried)
    return False, None, False


def promote_incumbents(c: DataFrame, key: list[str], order: str, shown: str) -> DataFrame:
    """Within each key (a label's layer, text and icon) the first candidate and the first one that is shown already swap
    their places in the order, so that a label doesn't jump to a twin that ranks a little higher."""
    w = Window.partitionBy(*key)
    first, held = F.min(order).over(w), F.min(F.when(F.col(shown), F.col(order))).over(w)
    swapped = F.when(F.col(order) == first, held).when(F.col(order) == held, first).otherwise(F.col(order))
    return c.withColumn("place", F.when(held.isNull(), F.col(order)).otherwise(swapped))


def max_deviation(angles: Column) -> Column:
    """The largest turn of a path's glyphs against the first one."""
    first = F.get(angles, F.lit(0))
    pi2 = F.lit(2 * math.pi)
    fold = lambda a: F.abs(F.pmod(a - first + math.pi, pi2) - math.pi)
    return F.coalesce(F.array_max(F.transform(angles, fold)), F.lit(0.0))


def too_bent(angles: Column, max_angle: Column) -> Column:
    """Whether neighbouring glyphs turn by more than max_angle degrees."""
    n = F.size(angles)
    pi2 = F.lit(2 * math.pi)
    turn = lambda i: F.abs(F.pmod(F.get(angles, i + 1) - F.get(angles, i) + math.pi, pi2) - math.pi)
    steps = F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), turn)).otherwise(F.array().cast("array<double>"))
    return F.exists(steps, lambda a: a > F.radians(max_angle))


# Parts of font names and the weight they stand for; the first that is found counts.
WEIGHTS = (("extrabold", 800), ("extra bold", 800), ("semibold", 600), ("semi bold", 600), ("bold", 700), ("medium", 500), ("light", 300), ("thin", 200))


def font_weight(name: Column) -> Column:
    """The weight that a font's name, or a stack's names with spaces between them, asks for; 400 if none."""
    out = F.lit(400)
    for part, weight in reversed(WEIGHTS):
        out = F.when(F.contains(F.lower(name), F.lit(part)), F.lit(weight)).otherwise(out)
    return out


def italic(name: Column) -> Column:
    return F.rlike(F.lower(name), F.lit("italic|oblique"))


def glyph_clusters(text: str, size: float) -> list[tuple[str, float, float]]:
    """(character, centre, width) of what is drawn, under the width model; spaces take room only."""
    w = size * CHAR_WIDTH
    return [(c, (i + 0.5) * w, w) for i, c in enumerate(text) if not re.match(r"\s", c)]
