"""CSS colours, parsed on the driver or in a column, and arithmetic on their channels."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: (alpha, red, green, blue), each 0..1
Color = tuple[float, float, float, float]

# The named colours of CSS.
NAMED = """
aliceblue f0f8ff, antiquewhite faebd7, aqua 00ffff, aquamarine 7fffd4, azure f0ffff, beige f5f5dc, bisque ffe4c4,
black 000000, blanchedalmond ffebcd, blue 0000ff, blueviolet 8a2be2, brown a52a2a, burlywood deb887, cadetblue 5f9ea0,
chartreuse 7fff00, chocolate d2691e, coral ff7f50, cornflowerblue 6495ed, cornsilk fff8dc, crimson dc143c, cyan
00ffff, darkblue 00008b, darkcyan 008b8b, darkgoldenrod b8860b, darkgray a9a9a9, darkgreen 006400, darkgrey a9a9a9,
darkkhaki bdb76b, darkmagenta 8b008b, darkolivegreen 556b2f, darkorange ff8c00, darkorchid 9932cc, darkred 8b0000,
darksalmon e9967a, darkseagreen 8fbc8f, darkslateblue 483d8b, darkslategray 2f4f4f, darkslategrey 2f4f4f,
darkturquoise 00ced1, darkviolet 9400d3, deeppink ff1493, deepskyblue 00bfff, dimgray 696969, dimgrey 696969,
dodgerblue 1e90ff, firebrick b22222, floralwhite fffaf0, forestgreen 228b22, fuchsia ff00ff, gainsboro dcdcdc,
ghostwhite f8f8ff, gold ffd700, goldenrod daa520, gray 808080, green 008000, greenyellow adff2f, grey 808080, honeydew
f0fff0, hotpink ff69b4, indianred cd5c5c, indigo 4b0082, ivory fffff0, khaki f0e68c, lavender e6e6fa, lavenderblush
fff0f5, lawngreen 7cfc00, lemonchiffon fffacd, lightblue add8e6, lightcoral f08080, lightcyan e0ffff,
lightgoldenrodyellow fafad2, lightgray d3d3d3, lightgreen 90ee90, lightgrey d3d3d3, lightpink ffb6c1, lightsalmon
ffa07a, lightseagreen 20b2aa, lightskyblue 87cefa, lightslategray 778899, lightslategrey 778899, lightsteelblue
b0c4de, lightyellow ffffe0, lime 00ff00, limegreen 32cd32, linen faf0e6, magenta ff00ff, maroon 800000,
mediumaquamarine 66cdaa, mediumblue 0000cd, mediumorchid ba55d3, mediumpurple 9370db, mediumseagreen 3cb371,
mediumslateblue 7b68ee, mediumspringgreen 00fa9a, mediumturquoise 48d1cc, mediumvioletred c71585, midnightblue 191970,
mintcream f5fffa, mistyrose ffe4e1, moccasin ffe4b5, navajowhite ffdead, navy 000080, oldlace fdf5e6, olive 808000,
olivedrab 6b8e23, orange ffa500, orangered ff4500, orchid da70d6, palegoldenrod eee8aa, palegreen 98fb98,
paleturquoise afeeee, palevioletred db7093, papayawhip ffefd5, peachpuff ffdab9, peru cd853f, pink ffc0cb, plum
dda0dd, powderblue b0e0e6, purple 800080, rebeccapurple 663399, red ff0000, rosybrown bc8f8f, royalblue 4169e1,
saddlebrown 8b4513, salmon fa8072, sandybrown f4a460, seagreen 2e8b57, seashell fff5ee, sienna a0522d, silver c0c0c0,
skyblue 87ceeb, slateblue 6a5acd, slategray 708090, slategrey 708090, snow fffafa, springgreen 00ff7f, steelblue
4682b4, tan d2b48c, teal 008080, thistle d8bfd8, tomato ff6347, turquoise 40e0d0, violet ee82ee, wheat f5deb3, white
ffffff, whitesmoke f5f5f5, yellow ffff00, yellowgreen 9acd32
"""
NAMES = {k: v for k, v in (x.split() for x in NAMED.replace("\n", " ").split(","))}

SCHEMA = "struct<a:double,r:double,g:double,b:double>"
_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?")


def _number(s: str, whole: float = 1.0) -> float | None:
    """A CSS number; a percentage is that share of ``whole``."""
    percent = s.endswith("%")
    s = s.removesuffix("%").strip()
    if not _NUMBER.fullmatch(s):
        return None
    return float(s) / 100 * whole if percent else float(s)


def _round(x: float) -> int:
    return int(x + 0.5) if x >= 0 else -int(-x + 0.5)


def _clamp(x: float, lo: float = 0.0, hi: float = 1.0) -> float:
    return min(max(x, lo), hi)


def _bytes(a: int, r: int, g: int, b: int) -> Color:
    return a / 255, r / 255, g / 255, b / 255


def parse(text: str) -> Color | None:
    """#rgb[a], #rrggbb[aa], rgb[a](), hsl[a]() and names, in any case and with white space around; else None."""
    s = text.strip().lower()
    if s == "transparent":
        return 0.0, 0.0, 0.0, 0.0
    if s in NAMES:
        s = "#" + NAMES[s]
    if s.startswith("#"):
        h = s[1:]
        if len(h) in (3, 4):
            h = "".join(c + c for c in h)
        if len(h) not in (6, 8) or not re.fullmatch("[0-9a-f]+", h):
            return None
        r, g, b, a = (int(h[i : i + 2], 16) if i < len(h) else 255 for i in (0, 2, 4, 6))
        return _bytes(a, r, g, b)
    m = re.match(r"(rgb|hsl)[^(]*\((.*)\)", s, re.S)
    if not m:
        return None
    parts = [p for p in re.split(r"[,/\s]+", m[2]) if p]
    if len(parts) < 3:
        return None
    alpha = _number(parts[3]) if len(parts) > 3 else 1.0
    if m[1] == "rgb":
        rgb = [_number(p, 255.0) for p in parts[:3]]
    else:
        hue, sat, light = _number(parts[0].replace("deg", "")), _number(parts[1]), _number(parts[2])
        if hue is None or sat is None or light is None:
            return None
        rgb = [c * 255 for c in hsl(hue % 360, _clamp(sat), _clamp(light))]
    if alpha is None or any(c is None for c in rgb):
        return None
    return _bytes(_round(_clamp(alpha) * 255), *(int(_clamp(_round(c), 0, 255)) for c in rgb))


def hsl(hue: float, sat: float, light: float) -> tuple[float, float, float]:
    """Red, green and blue, 0..1, of a hue in degrees."""
    import colorsys

    return colorsys.hls_to_rgb(hue / 360, light, sat)


def argb(c: Color) -> int:
    a, r, g, b = (_round(_clamp(x) * 255) for x in c)
    return a << 24 | r << 16 | g << 8 | b


def literal(c: Color | None) -> Column:
    if c is None:
        return F.lit(None).cast(SCHEMA)
    return F.struct(*[F.lit(float(v)).alias(k) for k, v in zip("argb", c)])


@F.arrow_udf(T.StructType([T.StructField(k, T.DoubleType()) for k in "argb"]))
def parse_column(texts: pa.Array) -> pa.Array:
    """parse() of each text; equal texts are parsed once."""
    coded = texts.dictionary_encode()
    found = [None if t is None else parse(t) for t in coded.dictionary.to_pylist()]
    rows = [None if i is None or found[i] is None else dict(zip("argb", found[i])) for i in coded.indices.to_pylist()]
    return pa.array(rows, pa.struct([(k, pa.float64()) for k in "argb"]))


def argb_column(c: Column) -> Column:
    """The 32-bit number of a colour, as a long."""
    byte = lambda k: F.round(F.least(F.greatest(c[k], F.lit(0.0)), F.lit(1.0)) * 255).cast("long")
    return F.shiftleft(byte("a"), 24) + F.shiftleft(byte("r"), 16) + F.shiftleft(byte("g"), 8) + byte("b")


def lerp(x: Column, y: Column, t: Column) -> Column:
    return F.struct(*[(x[k] + (y[k] - x[k]) * t).alias(k) for k in "argb"])


def with_opacity(c: Column, opacity: Column) -> Column:
    """Alpha times opacity, unless that is 1 or more."""
    return F.struct(F.when(opacity >= 1, c["a"]).otherwise(c["a"] * opacity).alias("a"), *[c[k].alias(k) for k in "rgb"])


def text_column(c: Column) -> Column:
    """rgba(r,g,b,a) with 8-bit channels."""
    byte = lambda k: F.round(c[k] * 255).cast("long").cast("string")
    alpha = F.when(c["a"] == F.rint(c["a"]), c["a"].cast("long").cast("string")).otherwise(c["a"].cast("string"))
    return F.when(c.isNotNull(), F.concat(F.lit("rgba("), F.concat_ws(",", byte("r"), byte("g"), byte("b"), alpha), F.lit(")")))
