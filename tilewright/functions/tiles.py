"""Tile keys as columns: wrapping, ancestors, fractions, data zooms, Hilbert ids, camera grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Highest zoom that has a Hilbert id, and highest zoom that is shown.
MAX_ID_ZOOM, MAX_DISPLAY_ZOOM = 26, 30
TILE_PX = 256.0


def _long(x: Column | int) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("long")


def _int(x: Column | int) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("int")


def shr(x: Column, n: Column | int) -> Column:
    return F.call_function("shiftright", _long(x), _int(n))


def shl(x: Column | int, n: Column | int) -> Column:
    return F.call_function("shiftleft", _long(x), _int(n))


def side(z: Column | int) -> Column:
    """Tiles along one side at a zoom."""
    return shl(1, z)


def wrap_x(z: Column, x: Column) -> Column:
    return F.pmod(x, side(z))


def valid_y(z: Column, y: Column) -> Column:
    return (y >= 0) & (y < side(z))


def ancestor(z: Column, x: Column, y: Column, at: Column | int) -> tuple[Column, Column]:
    """(x, y) of the tile's ancestor at zoom ``at`` <= z."""
    n = z - at
    return shr(x, n), shr(y, n)


def fraction(z: Column, x: Column, y: Column, az: Column, ax: Column, ay: Column) -> tuple[Column, Column, Column]:
    """Where the tile lies within an ancestor: (dx, dy, scale), each a share of the ancestor's side. x wraps."""
    n = z - az
    per = side(n).cast("double")
    dx = F.pmod(x - shl(ax, n), side(z)).cast("double") / per
    dy = (y - shl(ay, n)).cast("double") / per
    return dx, dy, F.lit(1.0) / per


def data_zoom(z: Column, delta: int, min_zoom: int, max_zoom: int, cap_at_display: bool = False) -> Column:
    """The zoom of the tile that holds a display tile's data, or null if only higher zooms have any."""
    want = F.least(F.greatest(z + delta, F.lit(min_zoom)), F.lit(max_zoom))
    if cap_at_display:
        want = F.least(want, z)
    return F.when((want <= z) & (want >= min_zoom), want)


def data_key(z: Column, x: Column, y: Column, delta: int, min_zoom: int, max_zoom: int, cap_at_display: bool = False) -> Column:
    """STRUCT<z,x,y> of the tile that holds a display tile's data: z + delta within the source's zooms, x wrapped."""
    dz = data_zoom(z, delta, min_zoom, max_zoom, cap_at_display)
    n = z - dz
    return F.when(dz.isNotNull(), F.struct(dz.cast("int").alias("z"), shr(F.pmod(x, side(z)), n).alias("x"), shr(y, n).alias("y")))


def raster_delta(tile_size: int, offset: int) -> int:
    """Raster tiles of 256 px or less take one zoom more than larger ones."""
    return offset + 1 if tile_size <= 256 else offset


def style_zoom(zoom: Column, offset: int = -1) -> Column:
    return F.greatest(F.lit(0.0), zoom + float(min(0, offset)))


def hilbert_id(z: Column, x: Column, y: Column, bits: int = MAX_ID_ZOOM) -> Column:
    """The id of a tile on the Hilbert curve of its zoom, after all tiles of lower zooms; null beyond zoom 26.

    The curve is walked from the highest bit down. At a level above the tile's zoom both bits are 0:
    nothing is added there, and only the levels within the zoom turn the square.
    """
    start = F.struct(_long(x).alias("x"), _long(y).alias("y"), F.lit(0).cast("long").alias("d"))

    def step(a: Column, k: Column) -> Column:
        s = shl(1, k)
        rx = F.when(a["x"].bitwiseAND(s) > 0, 1).otherwise(0).cast("long")
        ry = F.when(a["y"].bitwiseAND(s) > 0, 1).otherwise(0).cast("long")
        d = a["d"] + s * s * (rx * 3).bitwiseXOR(ry)
        low = s - 1
        px, py = a["x"].bitwiseAND(low), a["y"].bitwiseAND(low)
        fx = F.when(rx == 1, low - px).otherwise(px)
        fy = F.when(rx == 1, low - py).otherwise(py)
        turn = ry == 0
        return F.struct(F.when(turn, fy).otherwise(px).alias("x"), F.when(turn, fx).otherwise(py).alias("y"), d.alias("d"))

    levels = F.when(z > 0, F.sequence(_int(z) - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    walked = F.aggregate(levels, start, step, lambda a: a["d"])
    before = F.call_function("shiftright", shl(1, z * 2) - 1, F.lit(0)) / 3
    ok = (z >= 0) & (z <= bits) & (x >= 0) & (y >= 0) & (x < side(z)) & (y < side(z))
    return F.when(ok, before.cast("long") + walked)


def tile_transform(dx: Column, dy: Column, scale: Column, extent: Column) -> tuple[Column, Column, Column]:
    """(scale, offset x, offset y) from a data tile's units to a display tile's pixels."""
    px = F.lit(TILE_PX) / (extent * scale)
    return px, -dx * TILE_PX / scale, -dy * TILE_PX / scale


def display_rect(z: Column, x: Column, y: Column, zoom: Column) -> Column:
    """A tile's rectangle in world pixels at a fractional zoom."""
    s = F.lit(TILE_PX) * F.pow(F.lit(2.0), zoom - z)
    return F.struct((x * s).alias("l"), (y * s).alias("t"), ((x + 1) * s).alias("r"), ((y + 1) * s).alias("b"))


def world_x(lon: Column, zoom: Column) -> Column:
    """Web-Mercator pixels from the west edge at a zoom."""
    return (lon + 180.0) / 360.0 * TILE_PX * F.pow(F.lit(2.0), zoom)


def world_y(lat: Column, zoom: Column) -> Column:
    r = F.radians(lat)
    return (1 - F.ln(F.tan(r) + 1 / F.cos(r)) / F.lit(3.141592653589793)) / 2 * TILE_PX * F.pow(F.lit(2.0), zoom)


def visible_grid(cameras: DataFrame, buffer: int = 0) -> DataFrame:
    """cameras(.., cx, cy, zoom, width, height), with the centre in world pixels at zoom -> one row per tile in
    view: z, x (not wrapped), y, dist2 to the view's middle in tiles, and prio = round(4 * dist2). The view is cut
    to tiles of zoom floor(zoom), y to the world, and widened by buffer tiles on each side."""
    z = F.least(F.floor("zoom"), F.lit(MAX_DISPLAY_ZOOM)).cast("int")
    s = F.lit(TILE_PX) * F.pow(F.lit(2.0), F.col("zoom") - z)
    top = side(F.col("z")) - 1
    g = cameras.withColumn("z", z).withColumn("s", s)
    lo = lambda c, size: F.floor((F.col(c) - F.col(size) / 2) / F.col("s")) - buffer
    hi = lambda c, size: F.ceil((F.col(c) + F.col(size) / 2) / F.col("s")) - 1 + buffer
    g = g.select(
        "*", lo("cx", "width").alias("x0"), hi("cx", "width").alias("x1"),
        F.greatest(lo("cy", "height"), F.lit(0)).alias("y0"), F.least(hi("cy", "height"), top).alias("y1"),
    ).where("x0 <= x1 and y0 <= y1")
    g = g.withColumn("x", F.explode(F.sequence("x0", "x1"))).withColumn("y", F.explode(F.sequence("y0", "y1")))
    mx, my = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    dist2 = (F.col("x") - mx) * (F.col("x") - mx) + (F.col("y") - my) * (F.col("y") - my)
    return g.withColumn("dist2", dist2).withColumn("prio", F.round(F.col("dist2") * 4).cast("int")).drop("x0", "x1", "y0", "y1", "s")
