"""Values in, value out, for the expression language and the legacy forms."""

import pytest
from pyspark.sql import functions as F

from tilewright.functions import color
from tilewright.plans.expressions import Context, MapView, TypedView, compile_expression, compile_filter, is_expression_filter, property_column
from tilewright.plans.theme import read_theme

PROPS = {"name": "Berlin", "rank": 3, "capital": True, "num": "7", "empty": ""}


@pytest.fixture(scope="module")
def row(spark):
    pv = lambda v: ("bool", None, None, None, v) if isinstance(v, bool) else ("int", None, None, v, None) if isinstance(v, int) else ("string", v, None, None, None)
    m = {k: pv(v) for k, v in PROPS.items()}
    m["nothing"] = ("null", None, None, None, None)
    return spark.createDataFrame([(m, 42)], "p map<string,struct<t:string,s:string,d:double,l:bigint,b:boolean>>, fid bigint")


def value(row, x, zoom=11.0):
    v = compile_expression(x, Context(MapView(F.col("p")), zoom, F.lit("Point"), F.col("fid"))).value
    got = row.select(v.col.alias("v")).first().v
    if v.kind == "any" and got is not None:
        return {"string": got.s, "int": got.l, "double": got.d, "bool": got.b, "color": got.s, "null": None}.get(got.t, got.s)
    return got


G = lambda k: ["get", k]
CASES = [
    (G("name"), "Berlin"), (G("missing"), None), (["has", "name"], True), (["has", "nothing"], True), (["has", "missing"], False), (["id"], 42.0), (["geometry-type"], "Point"), (["zoom"], 11.0),
    (["==", G("rank"), 3], True), (["==", "1", 1], False), (["<", "1", 2], True), (["!=", G("missing"), "a"], True), (["==", G("missing"), None], True), (["<", G("missing"), 1], False), (["<", "a", "b"], True),
    (["!", G("empty")], True), (["all"], True), (["any"], False), (["all", True, G("name")], True), (["any", False, G("missing")], False),
    (["case", [">", G("rank"), 5], "x", ["has", "name"], "y", "z"], "y"), (["match", G("name"), ["Rome", "Berlin"], "hit", "no"], "hit"), (["match", G("rank"), 3, "a", 3.0, "b", "c"], "b"), (["match", "q", "q"], None),
    (["coalesce", G("missing"), G("nothing"), G("rank")], 3), (["step", ["zoom"], "a", 5, "b", 10, "c", 14, "d"], "c"), (["step", G("name"), "a", 5, "b"], "a"),
    (["interpolate", ["linear"], ["zoom"], 10, 0, 20, 100], 10.0), (["interpolate", ["exponential", 2], ["zoom"], 10, 100, 12, 400], 200.0), (["interpolate", ["linear"], G("missing"), 0, 1, 2, 3], None),
    (["interpolate", ["linear"], ["zoom"], 12, 5, 20, 9], 5.0), (["interpolate", ["linear"], ["zoom"], 1, 5, 2, 9], 9.0), (["interpolate", ["linear"], ["zoom"], 10, ["literal", [0, 2]], 12, ["literal", [2, 4]]], [1.0, 3.0]),
    (["in", "er", G("name")], True), (["in", G("rank"), ["literal", [1, 3]]], True), (["in", 3, G("rank")], False), (["index-of", "l", G("name")], 3.0), (["index-of", "b", ["literal", ["a", "b"]]], 1.0), (["index-of", "q", G("name")], -1.0),
    (["at", 1, ["literal", ["a", "b"]]], "b"), (["at", 5, ["literal", ["a"]]], None), (["at", -1, ["literal", ["a"]]], None), (["slice", G("name"), 1, 3], "er"), (["slice", G("name"), 9], ""), (["slice", ["literal", [1, 2, 3]], 1], [2.0, 3.0]), (["length", G("name")], 6.0), (["length", ["literal", [1, 2]]], 2.0),
    (["to-number", G("num")], 7.0), (["to-number", "x"], 0.0), (["to-number", "x", 4], 4.0), (["to-string", 3], "3"), (["to-string", G("missing")], ""), (["to-string", 1.5], "1.5"), (["to-boolean", "x"], True), (["typeof", G("rank")], "number"), (["typeof", G("missing")], "null"), (["typeof", ["literal", [1]]], "array"),
    (["string", G("rank"), G("name")], "Berlin"), (["number", G("name")], None), (["concat", G("name"), " ", 1], "Berlin 1"), (["upcase", "aé"], "AÉ"), (["downcase", G("missing")], ""), (["format", "a", {"font-scale": 2}, G("rank")], "a3"), (["image", "pin"], "pin"),
    (["to-rgba", "red"], [255.0, 0.0, 0.0, 1.0]), (["+", 1, 2, 3], 6.0), (["+"], 0.0), (["*"], 1.0), (["+", 1, G("missing")], None), (["-", 5], -5.0), (["-", 5, 2], 3.0), (["/", 1, 0], None), (["%", -7, 3], 2.0), (["%", 7, -3], 1.0), (["%", -7, -3], 2.0), (["%", 1, 0], None), (["^", 2, 10], 1024.0), (["^", 10, 400], None),
    (["abs", -2], 2.0), (["ceil", 1.2], 2.0), (["floor", -1.2], -2.0), (["round", 2.5], 3.0), (["round", -2.5], -3.0), (["sqrt", -1], None), (["ln", 0], None), (["log2", 8], 3.0), (["min", 3, G("missing")], None), (["max", 1, G("rank")], 3.0), (["min"], None), (["pi"], 3.141592653589793),
    (["let", "a", 2, ["*", ["var", "a"], ["let", "a", 5, ["var", "a"]]]], 10.0), (["var", "nope"], None), (["feature-state", "x"], None), (["heatmap-density"], 0.0), (["is-supported-script", "x"], True), (["nonsense", 1], None), ([], None), (["within", {}], None),
    ({"stops": [[10, 0], [20, 100]]}, 10.0), ({"property": "rank", "type": "interval", "stops": [[0, "a"], [3, "b"], [9, "c"]]}, "b"), ({"property": "name", "type": "categorical", "stops": [["Berlin", 1], ["Berlin", 2]], "default": 0}, 1.0), ({"property": "missing", "type": "identity", "default": "d"}, "d"), ({"property": "name", "stops": [[0, 1], [1, 2]], "default": 9}, 9.0),
]


@pytest.mark.parametrize(("x", "want"), CASES, ids=[str(c[0])[:60] for c in CASES])
def test_value(row, x, want):
    got = value(row, x)
    assert got == pytest.approx(want) if isinstance(want, (float, list)) else got == want


def test_easing_and_colours(row):
    assert value(row, ["interpolate", ["cubic-bezier", 0.42, 0, 0.58, 1], ["zoom"], 10, 0, 12, 1]) == pytest.approx(0.5, abs=1e-3)
    c = value(row, ["interpolate-hcl", ["linear"], ["zoom"], 10, "#000", 12, "red"])
    assert (c.a, c.r) == (1.0, 0.5)


FILTERS = [
    (["==", "name", "Berlin"], True), (["!=", "missing", 1], True), (["!in", "missing", 1, 2], True), (["in", "rank", 1, 3], True), (["none", ["==", "rank", 4]], True), (["!has", "name"], False), (["has", "$id"], True),
    (["==", "$type", "Point"], True), (["all", ["has", "name"], [">", "rank", 2]], True), (["any", ["==", "rank", 1]], False), (["within", {}], False), ([], True), (None, True), (False, False), (["==", ["get", "rank"], 3], True), (["all", ["odd", 1], ["none"]], False),
]


@pytest.mark.parametrize(("f", "want"), FILTERS, ids=[str(f[0])[:50] for f in FILTERS])
def test_filter(row, f, want):
    assert (row.where(compile_filter(f, Context(MapView(F.col("p")), 11.0, F.lit("Point"), F.col("fid"))).value.col).count() == 1) == want


def test_what_is_read():
    view = TypedView({})
    assert compile_expression(["concat", ["get", "a"], ["case", ["has", "b"], 1, ["zoom"]]], Context(view)).properties == {"a", "b"}
    assert compile_expression(["get", ["get", "a"]], Context(view)).properties is None
    assert compile_expression(["*", ["zoom"], 2], Context(view)).zoom_only
    assert compile_expression(["odd"], Context(view)).warnings


def test_filter_detection():
    assert is_expression_filter(["has", "a"]) and is_expression_filter(["==", ["get", "a"], 1]) and is_expression_filter(["in", ["get", "a"], "x"])
    assert not any(map(is_expression_filter, (["==", "a", 1], ["in", "a", 1, 2], ["!has", "a"], ["none"], ["has", "$type"], ["any", ["==", "a", 1]])))


def test_typed_properties(row):
    ctx = Context(MapView(F.col("p")), 11.0)
    one = lambda x, kind, d, **k: row.select(property_column(x, kind, d, ctx, **k).value.col.alias("v")).first().v
    assert one("{name} ({rank}){no}", "string", "", tokens=True) == "Berlin (3)"
    assert one(None, "number", 5) == 5.0 and one(["get", "name"], "number", 5) == 5.0 and one(["get", "num"], "number", 5) == 7.0
    assert one([1, "x"], "numbers", [0, 0]) == [0.0, 0.0] and one([1, 2], "numbers", None) == [1.0, 2.0]
    assert one("A", "strings", None) == ["A"] and one(["A", "B"], "strings", None) == ["A", "B"] and one("nope", "color", "#fff").r == 1.0


@pytest.mark.parametrize(("text", "argb"), [("#f00", 0xFFFF0000), ("#F008", 0x88FF0000), ("#12345678", 0x78123456), (" Red ", 0xFFFF0000), ("rgb(1, 2, 3)", 0xFF010203), ("rgba(100%, 0%, 0%, 0.5)", 0x80FF0000), ("rgb(1 2 3 / 50%)", 0x80010203), ("hsl(480, 100%, 50%)", 0xFF00FF00), ("hsla(120deg,100%,50%,0)", 0x0000FF00), ("transparent", 0), ("rebeccapurple", 0xFF663399), ("", None), ("#12", None), ("rgb(1,2)", None), ("hello", None)])
def test_css(text, argb):
    c = color.parse(text)
    assert (None if c is None else color.argb(c)) == argb


def test_theme():
    t = read_theme({"version": 8, "name": "n", "layers": [{"id": "h", "type": "hillshade"}, {"id": "x", "type": "odd"}, {"id": "v", "type": "fill", "layout": {"visibility": "none"}}, {"type": None}, {"id": "e", "type": "fill-extrusion", "source": "s", "source-layer": "b", "paint": {"fill-extrusion-color": ["get", "c"]}}, {"id": "l", "type": "line", "source": "s", "source-layer": "b", "minzoom": 3, "filter": ["has", "k"]}]})
    assert [y.id for y in t.layers] == ["e", "l"] and t.id == "n@8#" and len(t.warnings) == 2
    assert t.referenced_properties(Context(TypedView({}))) == {("s", "b"): {"c", "k"}} and t.source_layers() == {"s": {"b"}}
