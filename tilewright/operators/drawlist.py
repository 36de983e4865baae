"""Features to a draw list: rows with resolved paint, for all that is drawn before labels."""

from __future__ import annotations

import math
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as PT

from ..functions import clipping, color
from ..functions import tiles as T
from ..plans.expressions import Context, MapView, TypedView
from ..plans.theme import Theme

#: Pixels around a tile in which geometry is still drawn, and zooms of overzoom from which it is clipped.
BUFFER, CLIP_FROM = 64.0, 2
OUTLINE_WIDTH, BACKGROUND_MARGIN = 0.6, 4.0


def window(scale: Column, off_x: Column, off_y: Column, buffer: float = BUFFER) -> tuple[Column, Column, Column, Column]:
    """The display tile with its buffer, in the data tile's units: left, top, right, bottom."""
    edge = T.TILE_PX + buffer
    return (-buffer - off_x) / scale, (-buffer - off_y) / scale, (edge - off_x) / scale, (edge - off_y) / scale


def meets(rect: tuple[Column, Column, Column, Column], minx="minx", miny="miny", maxx="maxx", maxy="maxy") -> Column:
    """Whether a feature's bounds touch a window; four range tests, which reach the scan when the window is known."""
    l, t, r, b = rect
    return (F.col(maxx) >= l) & (F.col(minx) <= r) & (F.col(maxy) >= t) & (F.col(miny) <= b)


def inside(rect: tuple[Column, Column, Column, Column]) -> Column:
    l, t, r, b = rect
    return (F.col("minx") >= l) & (F.col("maxx") <= r) & (F.col("miny") >= t) & (F.col("maxy") <= b)


def placed(features: DataFrame) -> DataFrame:
    """overzoom()'s rows (z, x, y, data_z, data_x, data_y, extent, ..) with the transform to the display tile's pixels."""
    dx, dy, s = T.fraction(F.col("z"), F.col("x"), F.col("y"), F.col("data_z"), F.col("data_x"), F.col("data_y"))
    scale, ox, oy = T.tile_transform(dx, dy, s, F.col("extent").cast("double"))
    return features.select("*", scale.alias("scale"), ox.alias("off_x"), oy.alias("off_y"), (F.col("z") - F.col("data_z")).alias("shift"))


_PARTS = PT.ArrayType(PT.ArrayType(PT.DoubleType()))
_CUT = PT.StructType([PT.StructField("parts", _PARTS), PT.StructField("starts", PT.ArrayType(PT.DoubleType()))])


#: Coordinates that are clipped at once: what a batch takes doesn't grow with its lines.
AT_ONCE = 1 << 17


def _cut(parts: pa.Array, kinds: pa.Array, *sides: pa.Array) -> pa.Array:
    kind, found = np.asarray(kinds.to_pylist(), dtype=object), clipping.ragged(parts)
    rect = np.column_stack([c.to_numpy(zero_copy_only=False) for c in sides]).astype(np.float64)
    line, ring = kind == "LineString", kind == "Polygon"
    cut = [clipping.clip_lines(clipping.chosen(found, line), rect), clipping.clip_rings(clipping.chosen(found, ring), rect), clipping.chosen(found, ~line & ~ring)]
    return clipping.as_struct(clipping.together(cut), parts.is_null().to_numpy(zero_copy_only=False))


def cut_parts(parts: pa.Array, *of: pa.Array) -> pa.Array:
    """_cut() of a batch, some rows after the other."""
    before = clipping.coordinates(parts)
    firsts = np.unique(np.searchsorted(before // AT_ONCE, np.arange(before[-1] // AT_ONCE + 1)) if len(before) else np.zeros(1, int)).tolist()
    ends = [*firsts[1:], len(parts)]
    return pa.concat_arrays([_cut(*(c.slice(i, j - i) for c in (parts, *of))) for i, j in zip(firsts, ends)])


@F.arrow_udf(_CUT)
def clip_parts(parts: pa.Array, kinds: pa.Array, l: pa.Array, t: pa.Array, r: pa.Array, b: pa.Array) -> pa.Array:  # noqa: E741
    """What of each row's parts lies in its window, and how far along the whole part each piece starts. Rows whose
    parts are null stay so."""
    return cut_parts(parts, kinds, l, t, r, b)


def clipped(features: DataFrame) -> DataFrame:
    """placed() rows with parts cut to the window, where overzoom is deep and the bounds don't lie within it already,
    and with ``starts``: how far along its whole part each piece begins. Rows with nothing left are left out, by the
    generator: a filter would be pushed below what comes before and have Python cut all parts once more for itself. Only
    parts that have to be cut go to Python."""
    rect = window(F.col("scale"), F.col("off_x"), F.col("off_y"))
    need = (F.col("shift") >= CLIP_FROM) & ~inside(rect) & (F.col("geom_type") != "Point")
    f = features.withColumn("__cut", clip_parts(F.when(need, F.col("parts")), F.col("geom_type"), *rect))
    whole = F.array_repeat(F.lit(0.0), F.size("parts"))
    shown = F.struct(F.coalesce("__cut.parts", F.col("parts").cast(_PARTS)).alias("parts"), F.coalesce("__cut.starts", whole).alias("starts"))
    left = F.inline(F.filter(F.array(shown), lambda c: F.size(c["parts"]) > 0))
    return f.select(*[c for c in features.columns if c != "parts"], left).select(*features.columns, "starts")


def in_pixels(features: DataFrame) -> DataFrame:
    """parts and starts in pixels of the display tile."""
    moved = lambda v, i: v.cast("double") * F.col("scale") + F.when(i % 2 == 0, F.col("off_x")).otherwise(F.col("off_y"))
    parts = F.transform("parts", lambda p: F.transform(p, moved))
    return features.withColumn("parts", parts).withColumn("starts", F.transform("starts", lambda d: d * F.col("scale")))


def centres(features: DataFrame, reach: Column) -> DataFrame:
    """A row for each point of the rows' parts, in pixels, that lies no farther than reach from the display tile."""
    xy = lambda p: F.filter(F.transform(p, lambda v, i: F.when(i % 2 == 0, F.array(v * F.col("scale") + F.col("off_x"), F.get(p, i + 1) * F.col("scale") + F.col("off_y")))), lambda c: F.get(c, F.lit(1)).isNotNull())
    f = features.withColumn("__reach", reach)
    near = lambda v: (v >= -F.col("__reach")) & (v <= F.lit(T.TILE_PX) + F.col("__reach"))
    shown = F.filter(F.flatten(F.transform("parts", lambda p: xy(F.transform(p, lambda v: v.cast("double"))))), lambda c: near(F.get(c, F.lit(0))) & near(F.get(c, F.lit(1))))
    f = f.withColumn("parts", shown).withColumn("parts", F.explode("parts"))
    return f.withColumn("parts", F.array("parts")).withColumn("starts", F.array(F.lit(0.0))).drop("__reach")


def visible(layer_type: str, p: dict[str, Column]) -> Column:
    """Whether anything of a layer's feature would show."""
    if layer_type == "fill":
        return (p["fill_opacity"] > 0) & ((p["fill_color"]["a"] > 0) | p["fill_pattern"].isNotNull())
    if layer_type == "line":
        return (p["line_opacity"] > 0) & (p["line_width"] > 0) & ((p["line_color"]["a"] > 0) | p["line_pattern"].isNotNull())
    if layer_type == "circle":
        fill = (p["circle_radius"] > 0) & (p["circle_opacity"] > 0) & (p["circle_color"]["a"] > 0)
        stroke = (p["circle_stroke_width"] > 0) & (p["circle_stroke_opacity"] > 0) & (p["circle_stroke_color"]["a"] > 0)
        return fill | stroke
    return F.lit(True)


def paint(layer_type: str, p: dict[str, Column], sprites: frozenset[str] | None = None) -> dict[str, Column]:
    """The resolved paint of one feature. A pattern replaces a fill's colour and outline, and a line's colour and
    dashes, if its sprite is known; dashes need two lengths; a gap makes a casing."""
    none = lambda kind: F.lit(None).cast(kind)
    out = {k: none(t) for k, t in DRAW.items()}

    def pattern(c: Column) -> Column:
        return F.when(c.isin(*sprites), c) if sprites else none("string")

    if layer_type == "fill":
        pat = pattern(p["fill_pattern"])
        line = F.when(pat.isNull() & p["fill_antialias"], F.coalesce(p["fill_outline_color"], none(color.SCHEMA)))
        out |= {
            "argb": F.when(pat.isNull(), color.argb_column(color.with_opacity(p["fill_color"], p["fill_opacity"]))), "pattern": pat, "opacity": p["fill_opacity"],
            "stroke_argb": F.when(line.isNotNull(), color.argb_column(color.with_opacity(line, p["fill_opacity"]))), "stroke_width": F.when(line.isNotNull(), F.lit(OUTLINE_WIDTH)),
        }
    elif layer_type == "line":
        pat = pattern(p["line_pattern"])
        out |= {
            "argb": F.when(pat.isNull(), color.argb_column(color.with_opacity(p["line_color"], p["line_opacity"]))), "pattern": pat, "opacity": p["line_opacity"], "width": p["line_width"],
            "casing_width": F.when(p["line_gap_width"] > 0, p["line_gap_width"] + p["line_width"] * 2), "gap": p["line_gap_width"],
            "dash": F.when(pat.isNull() & (F.size(p["line_dasharray"]) >= 2), p["line_dasharray"]), "cap": p["line_cap"], "join": p["line_join"],
        }
    elif layer_type == "circle":
        out |= {
            "argb": color.argb_column(color.with_opacity(p["circle_color"], p["circle_opacity"])), "opacity": p["circle_opacity"], "radius": p["circle_radius"],
            "stroke_argb": color.argb_column(color.with_opacity(p["circle_stroke_color"], p["circle_stroke_opacity"])), "stroke_width": p["circle_stroke_width"],
        }
    return out


DRAW = {
    "argb": "bigint", "opacity": "double", "width": "double", "gap": "double", "casing_width": "double", "dash": "array<double>", "cap": "string", "join": "string",
    "radius": "double", "stroke_argb": "bigint", "stroke_width": "double", "pattern": "string",
}


#: Columns of a draw list before the paint.
HEAD = ("z", "x", "y", "layer_index", "layer", "kind", "ord")
#: Layers that one pass over the features draws; a style with more takes more passes.
LAYERS = 24


def _row(own: DataFrame, layer, kind: str, paint_cols: dict[str, Column], *more: Column | str) -> DataFrame:
    return own.select("z", "x", "y", *_named(layer, kind), *more, *_painted(paint_cols))


def _named(layer, kind: str) -> list[Column]:
    return [F.lit(layer.index).alias("layer_index"), F.lit(layer.id).alias("layer"), F.lit(kind).alias("kind")]


def _painted(cols: dict[str, Column]) -> list[Column]:
    return [cols.get(k, F.lit(None)).cast(t).alias(k) for k, t in DRAW.items()]


def _drawn(features: DataFrame, layers: list, ctx: Context, sprites: frozenset[str] | None, keep: tuple[str, ...]) -> DataFrame:
    """A row for each feature and layer that draws it: the layers' tests and paints are evaluated side by side, so
    features are read once, not once for each layer."""
    passes = []
    for at in range(0, len(layers), LAYERS):
        every = []
        drawn = [(F.col("source") == y.source) & (F.col("source_layer") == y.source_layer) & y.shapes(F.col("geom_type")) for y in layers[at : at + LAYERS]]
        any_layer = reduce(lambda a, b: a | b, drawn)  # reaches the scan; what no layer draws is evaluated for none
        for y in layers[at : at + LAYERS]:
            p = y.resolved(ctx)
            shows = (F.col("source") == y.source) & (F.col("source_layer") == y.source_layer) & y.shapes(F.col("geom_type"))
            shows = shows & F.coalesce(y.filter_column(ctx).value.col, F.lit(False)) & F.coalesce(visible(y.type, p), F.lit(False))
            every.append(F.when(shows, F.struct(*_named(y, y.type), *_painted(paint(y.type, p, sprites)))))
        passes.append(features.where(any_layer).select(*keep, F.inline(F.filter(F.array(*every), lambda row: row.isNotNull()))))
    return reduce(DataFrame.unionByName, passes)


def draw_list(features: DataFrame, theme: Theme, zoom: float, view=None, sprites: frozenset[str] | None = None, extra: tuple[str, ...] = (), cull: bool = True) -> DataFrame:
    """The rows that a theme draws of placed() features, to be drawn in the order of layer_index and ord: for each layer
    the features of its source-layer, by type, bounds, filter, and visible paint.

    ``parts`` and ``starts`` are in the display tile's pixels, cut to it where overzoom is deep; circles
    give a row for each centre within reach. Zoom is a number, so all that depends on it alone is
    folded, and layers that don't cover the zoom are left out when the plan is made. Without ``cull``
    nothing is left out or cut by its place, to measure what that spares.
    """
    ctx = Context(view or MapView(F.col("properties")), zoom, F.col("geom_type"), F.col("fid"))
    features = features.where(meets(window(F.col("scale"), F.col("off_x"), F.col("off_y")))) if cull else features
    keep = ("z", "x", "y", "ord", "parts", "geom_type", "scale", "off_x", "off_y", "shift", "minx", "miny", "maxx", "maxy", *extra)
    layers = [y for y in theme.layers if y.minzoom <= zoom < y.maxzoom]
    shapes, circles = ([y for y in layers if y.type in types] for types in (("fill", "line"), ("circle",)))
    out = []
    if shapes:
        rows = _drawn(features, shapes, ctx, sprites, keep)
        if cull:
            rows = clipped(rows)
        else:
            rows = rows.withColumn("parts", F.col("parts").cast(_PARTS)).withColumn("starts", F.array_repeat(F.lit(0.0), F.size("parts")))
        out.append(in_pixels(rows))
    if circles:
        out.append(centres(_drawn(features, circles, ctx, sprites, keep), F.col("radius") + F.coalesce("stroke_width", F.lit(0.0))))
    if not out:
        raise ValueError("no layer of the theme draws geometry at this zoom")
    return reduce(DataFrame.unionByName, out).select(*HEAD, *extra, "parts", "starts", *DRAW)


def constant(columns: dict[str, Column], spark: SparkSession) -> dict[str, Any]:
    """The values of columns that read no row."""
    return spark.createDataFrame([(0,)], "i int").select(*[c.alias(k) for k, c in columns.items()]).first().asDict(recursive=True)


def backgrounds(tiles: DataFrame, theme: Theme, zoom: float) -> DataFrame | None:
    """A row for each of tiles(z, x, y) and visible background layer, somewhat larger than the tile. None: no layer."""
    ctx, m = Context(TypedView({}), zoom), BACKGROUND_MARGIN
    box = [-m, -m, T.TILE_PX + m, -m, T.TILE_PX + m, T.TILE_PX + m, -m, T.TILE_PX + m]
    rows = []
    for y in theme.layers:
        if y.type == "background" and y.minzoom <= zoom < y.maxzoom:
            p = y.resolved(ctx)
            shown = color.with_opacity(p["background_color"], F.greatest(p["background_opacity"], F.lit(0.0)))
            geometry_cols = (F.lit(-1).cast("long").alias("ord"), F.array(F.array(*map(F.lit, box))).alias("parts"), F.array(F.lit(0.0)).alias("starts"))
            rows.append(_row(tiles.where(shown["a"] > 0), y, "background", {"argb": color.argb_column(shown), "opacity": p["background_opacity"]}, *geometry_cols))
    return reduce(DataFrame.unionByName, rows) if rows else None


def rasters(shown: DataFrame, theme: Theme, zoom: float) -> DataFrame | None:
    """A row for each image and raster layer of its source, for shown(z, x, y, source, data_z, data_x, data_y, width,
    height): display tiles joined with images by overzoom(). ``src`` is the part of the image that the
    tile shows, ``matrix`` the colour matrix, null if colours stay as they are. None: no layer."""
    ctx = Context(TypedView({}), zoom)
    rows = []
    for y in theme.layers:
        if y.type != "raster" or not y.minzoom <= zoom < y.maxzoom:
            continue
        v = constant(y.resolved(ctx), shown.sparkSession)
        opacity = min(1.0, max(0.0, v["raster_opacity"]))
        if opacity <= 0:
            continue
        look = [v[f"raster_{k}"] for k in ("hue_rotate", "saturation", "contrast", "brightness_min", "brightness_max")]
        m = raster_matrix(*look)
        matrix = F.lit(None).cast("array<double>") if np.allclose(m, raster_matrix(), atol=1e-12) else F.array(*map(F.lit, m))
        own = shown.where(F.col("source") == y.source)
        src = raster_rect(*[F.col(c) for c in ("z", "x", "y", "data_z", "data_x", "data_y", "width", "height")])
        rows.append(own.select("z", "x", "y", F.lit(y.index).alias("layer_index"), F.lit(y.id).alias("layer"), "source", "data_z", "data_x", "data_y", F.lit(opacity).alias("opacity"), src.alias("src"), matrix.alias("matrix")))
    return reduce(DataFrame.unionByName, rows) if rows else None


# -- raster colours ---------------------------------------------------------------------------------------------

Matrix = list[float]


def _affine(linear: np.ndarray, shift: float = 0.0) -> np.ndarray:
    """Red, green and blue times ``linear`` plus ``shift``, alpha as it is, on columns (r, g, b, a, 1)."""
    m = np.eye(5)
    m[:3, :3], m[:3, 4] = linear, shift
    return m


def raster_matrix(hue: float = 0, saturation: float = 0, contrast: float = 0, low: float = 0, high: float = 1) -> Matrix:
    """The 4 x 5 matrix, row by row, of a raster layer's colour properties; channels 0..255.

    In this order: a turn by hue degrees about the grey axis, a blend with the mean, a stretch about
    the middle, and brightness from low to high. Saturation and contrast are cut to -1..1, low and
    high to 0..1, and the stretch to 1000, which is what a contrast of 1 gets.
    """
    saturation, contrast = (float(np.clip(v, -1, 1)) for v in (saturation, contrast))
    low, high = (float(np.clip(v, 0, 1)) for v in (low, high))
    same, mean = np.eye(3), np.full((3, 3), 1 / 3)
    cross = np.cross(same, np.full(3, 1 / math.sqrt(3)))  # the cross product with the axis
    angle = math.radians(hue % 360)
    grey = 1 - 1 / (1.001 - saturation) if saturation > 0 else -saturation
    stretch = 1 + contrast if contrast <= 0 else min(1000.0, 1 / (1 - contrast) if contrast < 1 else math.inf)
    steps = [
        _affine(math.cos(angle) * same + (1 - math.cos(angle)) * mean + math.sin(angle) * cross),
        _affine(same + grey * (mean - same)),
        _affine(stretch * same, (1 - stretch) * 127.5),
        _affine((high - low) * same, low * 255),
    ]
    return reduce(lambda done, step: step @ done, steps)[:4].ravel().tolist()


def apply_matrix(m: Matrix, rgba: Column) -> Column:
    """A colour of four channels 0..255 through a matrix, cut to 0..255."""
    rows = [F.lit(m[r * 5 + 4]) + sum((F.get(rgba, F.lit(c)) * m[r * 5 + c] for c in range(4)), F.lit(0.0)) for r in range(4)]
    return F.array(*[F.least(F.greatest(x, F.lit(0.0)), F.lit(255.0)) for x in rows])


def raster_rect(z: Column, x: Column, y: Column, dz: Column, dx: Column, dy: Column, width: Column, height: Column) -> Column:
    """The part of a data tile's image that a display tile shows."""
    fx, fy, s = T.fraction(z, x, y, dz, dx, dy)
    return F.struct((fx * width).alias("l"), (fy * height).alias("t"), ((fx + s) * width).alias("r"), ((fy + s) * height).alias("b"))


# -- dashes and patterns ----------------------------------------------------------------------------------------


def dashes(total: Column, dash: list[float], start: Column | float = 0.0) -> Column:
    """ARRAY<STRUCT<a,b>>: the drawn stretches of a line of this length whose first point lies ``start`` along the
    original one, so that dashes don't move when a line is clipped. An odd number of lengths counts twice."""
    d = list(dash) * (2 if len(dash) % 2 else 1)
    period = sum(d)
    if period <= 0:
        return F.array(F.struct(F.lit(0.0).alias("a"), total.alias("b")))
    at = F.lit(float(start)) if isinstance(start, (int, float)) else start
    first = F.floor(at / period).cast("int")
    last = F.floor((at + total) / period).cast("int")
    on = [(sum(d[:i]), sum(d[: i + 1])) for i in range(0, len(d), 2)]
    every = F.flatten(F.transform(F.sequence(first, last), lambda k: F.array(*[F.struct((k * period + a - at).alias("a"), (k * period + b - at).alias("b")) for a, b in on])))
    cut = F.transform(every, lambda s: F.struct(F.greatest(s.a, F.lit(0.0)).alias("a"), F.least(s.b, total).alias("b")))
    return F.filter(cut, lambda s: s.b > s.a)


def stamps(total: Column, start: Column, step: float) -> Column:
    """Distances at which a pattern is stamped along a clipped line, in step with the original one."""
    first = F.pmod(-start, F.lit(step))
    n = F.floor((total - first) / step).cast("int")
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda k: first + k * step)).otherwise(F.array().cast("array<double>"))


def pattern_phase(x: Column, width: Column) -> Column:
    """The offset that makes a pattern of this width run on from tile to tile."""
    return -F.pmod(x * T.TILE_PX, width)


def sdf_edge(halo: Column, size: Column) -> Column:
    """The distance-field value at which a halo of this width ends."""
    return F.least(F.greatest((F.lit(6.0) - halo / size) / 8, F.lit(0.0)), F.lit(0.75))


def sdf_slope(px_per_texel: Column) -> Column:
    return F.least(F.greatest(px_per_texel * 8, F.lit(4.0)), F.lit(128.0))
