"""Style expressions, legacy filters and legacy functions compiled to Spark columns.

An expression's type is worked out while it is compiled. Where it depends on the row the value is a
tagged struct (``any``): type, text, number, integer, truth. Nothing here runs per row in Python.
Bad input gives null at run time, an unknown operator gives null and a warning at compile time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import color as colors

ANY = "struct<t:string,s:string,d:double,l:bigint,b:boolean>"
NUMERAL = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|NaN|Infinity)\s*$"


@dataclass
class Value:
    """A compiled value: kind is num, str, bool, color, list, any, map or null. ``items`` holds the parts of a list
    whose length is known, ``elem`` the kind of the others' parts. ``const`` is set for what no row changes."""

    kind: str
    col: Column
    items: list[Value] | None = None
    elem: str = "any"
    const: Any = None
    is_const: bool = False
    #: What the value is chosen from, and how to choose from others instead.
    outs: list[Value] | None = None
    rebuild: Callable[[list[Value]], Value] | None = None


def null() -> Value:
    return Value("null", F.lit(None), const=None, is_const=True)


def num(c: Column | float) -> Value:
    if isinstance(c, Column):
        return Value("num", c.cast("double"))
    return Value("num", F.lit(float(c)), const=float(c), is_const=True)


def text(c: Column | str) -> Value:
    return Value("str", c) if isinstance(c, Column) else Value("str", F.lit(c), const=c, is_const=True)


def truth(c: Column | bool) -> Value:
    return Value("bool", c) if isinstance(c, Column) else Value("bool", F.lit(c), const=c, is_const=True)


def colour(c: Column | tuple) -> Value:
    return Value("color", c) if isinstance(c, Column) else Value("color", colors.literal(c), const=c, is_const=True)


def listing(items: list[Value]) -> Value:
    kinds = {i.kind for i in items}
    elem = kinds.pop() if len(kinds) == 1 else "any"
    cols = [i.col if elem != "any" else to_any(i) for i in items]
    array = F.array(*cols) if cols else F.array().cast("array<string>")
    const = all(i.is_const for i in items)
    return Value("list", array, items, elem, [i.const for i in items] if const else None, const)


def literal(x: Any) -> Value:
    if x is None:
        return null()
    if isinstance(x, bool):
        return truth(x)
    if isinstance(x, (int, float)):
        return num(float(x))
    if isinstance(x, str):
        return text(x)
    if isinstance(x, (list, tuple)):
        return listing([literal(i) for i in x])
    if isinstance(x, Mapping):
        pairs = [c for k, v in x.items() for c in (F.lit(k), to_any(literal(v)))]
        return Value("map", F.create_map(*pairs) if pairs else F.create_map().cast(f"map<string,{ANY}>"), const=dict(x), is_const=True)
    raise TypeError(x)


# -- tagged values ----------------------------------------------------------------------------------------------


def tagged(t: str, s=None, d=None, l=None, b=None) -> Column:  # noqa: E741
    one = lambda c, kind: (F.lit(None) if c is None else c).cast(kind)
    return F.struct(F.lit(t).alias("t"), one(s, "string").alias("s"), one(d, "double").alias("d"), one(l, "bigint").alias("l"), one(b, "boolean").alias("b"))


def to_any(v: Value) -> Column:
    """The value as a tagged struct; null itself is a null struct."""
    if v.kind == "any":
        return v.col
    if v.kind == "null":
        return F.lit(None).cast(ANY)
    made = {
        "num": lambda: tagged("double", d=v.col),
        "str": lambda: tagged("string", s=v.col),
        "bool": lambda: tagged("bool", b=v.col),
        "color": lambda: tagged("color", s=colors.text_column(v.col)),
        "list": lambda: tagged("array", s=F.to_json(v.col)),
        "map": lambda: tagged("object", s=F.to_json(v.col)),
    }[v.kind]()
    return F.when(v.col.isNotNull(), made)


def _tag(c: Column) -> Column:
    return F.when(c["t"] != "null", c["t"])


def is_null(v: Value) -> Column:
    if v.kind == "null":
        return F.lit(True)
    return _tag(v.col).isNull() if v.kind == "any" else v.col.isNull()


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def parse_number(s: Column) -> Column:
    return F.when(F.rlike(s, F.lit(NUMERAL)), F.trim(s).try_cast("double"))


def to_num(v: Value) -> Column:
    """A finite number; a numeral; 1 or 0 for a truth value; else null."""
    none = F.lit(None).cast("double")
    if v.kind == "any":
        c = v.col
        return (
            F.when(c["t"] == "int", c["l"].cast("double")).when(c["t"] == "double", finite(c["d"])).when(c["t"] == "string", parse_number(c["s"])).when(c["t"] == "bool", c["b"].cast("int").cast("double"))
        )
    return {"num": lambda: finite(v.col), "str": lambda: parse_number(v.col), "bool": lambda: v.col.cast("int").cast("double")}.get(v.kind, lambda: none)()


def truthy(v: Value) -> Column:
    """False for null, false, 0, NaN and the empty text."""
    if v.kind == "any":
        c = v.col
        return F.coalesce(
            F.when(c["t"] == "null", False).when(c["t"] == "bool", c["b"]).when(c["t"] == "int", c["l"] != 0).when(c["t"] == "double", (c["d"] != 0) & ~F.isnan(c["d"])).when(c["t"] == "string", c["s"] != "").otherwise(c["t"].isNotNull()),
            F.lit(False),
        )
    made = {"null": lambda: F.lit(False), "bool": lambda: v.col, "num": lambda: (v.col != 0) & ~F.isnan(v.col), "str": lambda: v.col != ""}
    return F.coalesce(made.get(v.kind, lambda: v.col.isNotNull())(), F.lit(False))


def number_text(c: Column) -> Column:
    whole = (F.rint(c) == c) & (F.abs(c) < 9.2e18)
    return F.when(F.isnan(c), F.lit("NaN")).when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def to_text(v: Value) -> Column:
    """Empty for null; whole numbers without a point."""
    if v.kind == "any":
        c = v.col
        made = F.when(c["t"] == "int", c["l"].cast("string")).when(c["t"] == "double", number_text(c["d"])).when(c["t"] == "bool", c["b"].cast("string")).otherwise(c["s"])
        return F.coalesce(made, F.lit(""))
    made = {
        "null": lambda: F.lit(""),
        "num": lambda: number_text(v.col),
        "str": lambda: v.col,
        "bool": lambda: v.col.cast("string"),
        "color": lambda: colors.text_column(v.col),
    }.get(v.kind, lambda: F.to_json(v.col))
    return F.coalesce(made(), F.lit(""))


def to_colour(v: Value) -> Column:
    """A colour, a CSS text, or a list of 3 or 4 channels 0..255 (alpha 0..1)."""
    none = F.lit(None).cast(colors.SCHEMA)
    if v.kind == "color":
        return v.col
    if v.rebuild and v.outs and all(o.kind in ("color", "null") or o.is_const and o.kind == "str" for o in v.outs):
        # texts known now are parsed now, whichever of them a row gets
        return v.rebuild([colour(to_colour(o)) for o in v.outs]).col
    if v.kind == "str":
        return colors.literal(colors.parse(v.const)) if v.is_const else colors.parse_column(v.col)
    if v.kind == "any":
        return colors.parse_column(F.when(v.col["t"].isin("string", "color"), v.col["s"]))
    if v.kind == "list" and v.items and len(v.items) in (3, 4):
        ch = [to_num(i) for i in v.items]
        byte = [F.least(F.greatest(F.round(c), F.lit(0.0)), F.lit(255.0)) / 255 for c in ch[:3]]
        alpha = F.round(F.least(F.greatest(ch[3] if len(ch) > 3 else F.lit(1.0), F.lit(0.0)), F.lit(1.0)) * 255) / 255
        made = F.struct(alpha.alias("a"), *[b.alias(k) for b, k in zip(byte, "rgb")])
        return F.when(reduce(lambda a, b: a & b, [c.isNotNull() for c in ch]), made)
    return none


def same(a: Value, b: Value) -> Column:
    """Loose equality: null equals null, numbers by value, else only within one type; NaN equals nothing."""
    if a.kind == "any" or b.kind == "any":
        x, y = to_any(a), to_any(b)
        tx, ty = _tag(x), _tag(y)
        n = lambda c: F.when(c["t"] == "int", c["l"].cast("double")).when(c["t"] == "double", c["d"])
        both = F.when(tx.isNull() | ty.isNull(), tx.isNull() & ty.isNull())
        both = both.when(n(x).isNotNull() & n(y).isNotNull(), (n(x) == n(y)) & ~F.isnan(n(x)))
        both = both.when(tx == ty, F.when(tx == "bool", x["b"] == y["b"]).otherwise(x["s"] == y["s"]))
        return F.coalesce(both, F.lit(False))
    if a.kind != b.kind or a.kind == "null":
        return is_null(a) & is_null(b)
    equal = a.col.eqNullSafe(b.col)
    return equal & ~F.coalesce(F.isnan(a.col), F.lit(False)) if a.kind == "num" else equal


def ordered(op: str, a: Value, b: Value) -> Column:
    """Texts compare as texts, all else as numbers; what doesn't compare is false."""
    how: Callable[[Column, Column], Column] = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}[op]
    x, y = to_num(a), to_num(b)
    numbers = F.coalesce(how(x, y) & ~F.isnan(x) & ~F.isnan(y), F.lit(False))
    text_of = lambda v: v.col if v.kind == "str" else F.when(v.col["t"] == "string", v.col["s"]) if v.kind == "any" else None
    s, t = text_of(a), text_of(b)
    if s is None or t is None:
        return numbers
    return F.when(s.isNotNull() & t.isNotNull(), how(s, t)).otherwise(numbers)


def unify(values: Sequence[Value]) -> tuple[str, list[Column]]:
    """One kind for all values, nulls aside, and the values as columns of it."""
    kinds = {v.kind for v in values if v.kind != "null"}
    if not kinds:
        return "null", [v.col for v in values]
    if len(kinds) == 1 and (k := kinds.pop()) in ("num", "str", "bool", "color"):
        kind = {"num": "double", "str": "string", "bool": "boolean", "color": colors.SCHEMA}[k]
        return k, [v.col.cast(kind) if v.kind == "null" else v.col for v in values]
    if all(v.kind in ("list", "null") for v in values):
        elems = {v.elem for v in values if v.kind == "list"}
        if len(elems) == 1:
            return "list", [F.lit(None) if v.kind == "null" else v.col for v in values]
    return "any", [to_any(v) for v in values]


def _made(kind: str, col: Column, like: Sequence[Value] = ()) -> Value:
    out = Value(kind, col)
    lists = [v for v in like if v.kind == "list"]
    if kind == "list" and lists:
        out.elem = lists[0].elem
        sizes = {len(v.items) if v.items is not None else None for v in lists}
        if len(sizes) == 1 and None not in sizes:
            out.items = [Value(out.elem, F.get(col, F.lit(i))) for i in range(sizes.pop())]
    return out


# -- rows -------------------------------------------------------------------------------------------------------


class TypedView:
    """Properties that are columns of the table: name -> (column, kind)."""

    def __init__(self, columns: Mapping[str, tuple[Column, str]]):
        self.columns = dict(columns)

    def get(self, name: str) -> Value:
        found = self.columns.get(name)
        if found is None:
            return null()
        return num(found[0]) if found[1] == "num" else Value(found[1], found[0])

    def dynamic(self, name: Column) -> Value:
        c = F.lit(None).cast(ANY)
        for k in self.columns:
            c = F.when(name == k, to_any(self.get(k))).otherwise(c)
        return Value("any", c)

    def has(self, name: Column | str) -> Column:
        if isinstance(name, str):
            return ~is_null(self.get(name)) if name in self.columns else F.lit(False)
        return F.coalesce(name.isin(*self.columns), F.lit(False))

    def whole(self) -> Value:
        pairs = [c for k in self.columns for c in (F.lit(k), to_any(self.get(k)))]
        return Value("map", F.create_map(*pairs))


class MapView:
    """Properties in one MAP<STRING, tagged> column, as decoded tiles have them."""

    def __init__(self, column: Column):
        self.column = column

    def get(self, name: str) -> Value:
        return Value("any", F.try_element_at(self.column, F.lit(name)))

    def dynamic(self, name: Column) -> Value:
        return Value("any", F.try_element_at(self.column, name))

    def has(self, name: Column | str) -> Column:
        return F.coalesce(F.map_contains_key(self.column, name), F.lit(False))

    def whole(self) -> Value:
        return Value("map", self.column)


@dataclass
class Context:
    """What expressions see of a row. zoom may be a number, which the compiler folds."""

    view: TypedView | MapView
    zoom: Column | float = 0.0
    geometry_type: Column | None = None
    feature_id: Column | None = None


# -- compiler ---------------------------------------------------------------------------------------------------

MATH_1: dict[str, tuple[Callable[[Column], Column], Callable[[float], float]]] = {
    "abs": (F.abs, abs), "ceil": (lambda c: F.ceil(c).cast("double"), math.ceil), "floor": (lambda c: F.floor(c).cast("double"), math.floor),
    "round": (F.round, lambda x: math.copysign(math.floor(abs(x) + 0.5), x)), "sqrt": (F.sqrt, math.sqrt), "ln": (F.ln, math.log),
    "log2": (lambda c: F.ln(c) / math.log(2), lambda x: math.log(x) / math.log(2)), "log10": (lambda c: F.ln(c) / math.log(10), lambda x: math.log(x) / math.log(10)),
    "sin": (F.sin, math.sin), "cos": (F.cos, math.cos), "tan": (F.tan, math.tan), "asin": (F.asin, math.asin), "acos": (F.acos, math.acos), "atan": (F.atan, math.atan),
}
CONSTANTS = {"e": math.e, "pi": math.pi, "ln2": math.log(2)}
STUBS = {"collator": None, "is-supported-script": True, "resolved-locale": "en", "feature-state": None, "heatmap-density": 0.0, "line-progress": 0.0, "accumulated": 0.0, "within": None}
OPERATORS = frozenset(
    """literal get has properties id geometry-type zoom let var ! == != < <= > >= all any case match coalesce within step interpolate
    interpolate-hcl interpolate-lab in index-of at slice length to-string to-number to-boolean to-color typeof string number boolean object
    array image format collator is-supported-script resolved-locale concat upcase downcase rgb rgba to-rgba + - * / % ^ abs ceil floor round
    sqrt ln log2 log10 sin cos tan asin acos atan min max e pi ln2 feature-state heatmap-density line-progress accumulated""".split()
)


@dataclass
class Compiled:
    """A column with its kind, what it reads of a row, and what was wrong with it."""

    value: Value
    properties: set[str] | None = field(default_factory=set)  # None: all of them
    uses_zoom: bool = False
    uses_feature: bool = False
    warnings: list[str] = field(default_factory=list)

    @property
    def zoom_only(self) -> bool:
        return not self.uses_feature


class Compiler:
    def __init__(self, context: Context):
        self.ctx = context
        self.properties: set[str] | None = set()
        self.uses_zoom = self.uses_feature = False
        self.warnings: list[str] = []

    def done(self, v: Value) -> Compiled:
        return Compiled(v, self.properties, self.uses_zoom, self.uses_feature, self.warnings)

    # entry points

    def expression(self, x: Any, scope: Mapping[str, Value] | None = None) -> Value:
        if isinstance(x, Mapping):
            return self.function(x)
        if not isinstance(x, (list, tuple)):
            return literal(x)
        if not x:
            return self._unsupported("an empty array")
        if not isinstance(x[0], str):
            return literal(x)
        op = x[0]
        scope = scope or {}
        if op in MATH_1 or op in CONSTANTS or op in STUBS or op in OPERATORS:
            made = getattr(self, "_op_" + NAMES.get(op, op.replace("-", "_")), None)
            return made(list(x[1:]), scope, op)
        return self._unsupported(f"operator {op}")

    def filter(self, x: Any) -> Column:
        """A layer's filter as a column that is never null: expressions by truth, else legacy filters."""
        if isinstance(x, bool):
            return F.lit(x)
        if not isinstance(x, (list, tuple)) or not x:
            return F.lit(True)
        return truthy(self.expression(x)) if is_expression_filter(x) else self._legacy(x)

    def template(self, s: str) -> Value:
        """A text with {property} tokens; a missing property is empty."""
        parts, at = [], 0
        while (i := s.find("{", at)) >= 0 and (j := s.find("}", i)) > 0:
            if i > at:
                parts.append(text(s[at:i]))
            parts.append(self._get(s[i + 1 : j]))
            at = j + 1
        if not parts:
            return text(s)
        if at < len(s):
            parts.append(text(s[at:]))
        return text(F.concat(*[to_text(p) for p in parts]))

    # helpers

    def _unsupported(self, what: str) -> Value:
        self.warnings.append(f"not supported: {what}")
        return null()

    def _args(self, a: list, scope: Mapping[str, Value]) -> list[Value]:
        return [self.expression(x, scope) for x in a]

    def _get(self, name: str) -> Value:
        self.uses_feature = True
        if self.properties is not None:
            self.properties.add(name)
        return self.ctx.view.get(name)

    def _zoom(self) -> Value:
        self.uses_zoom = True
        return num(self.ctx.zoom)

    # lookups

    def _op_literal(self, a, scope, op):
        return literal(a[0]) if a else null()

    def _op_get(self, a, scope, op):
        if not a:
            return self._unsupported("get without a key")
        key = self.expression(a[0], scope)
        if len(a) > 1:
            of = self.expression(a[1], scope)
            return Value("any", F.try_element_at(of.col, to_text(key))) if of.kind == "map" else null()
        if key.is_const and key.kind != "null":
            return self._get(key.const if isinstance(key.const, str) else _plain_text(key.const))
        self.uses_feature, self.properties = True, None
        return self.ctx.view.dynamic(to_text(key))

    def _op_has(self, a, scope, op):
        if not a:
            return self._unsupported("has without a key")
        key = self.expression(a[0], scope)
        if len(a) > 1:
            of = self.expression(a[1], scope)
            return truth(F.coalesce(F.map_contains_key(of.col, to_text(key)), F.lit(False)) if of.kind == "map" else F.lit(False))
        self.uses_feature = True
        if key.is_const and key.kind != "null":
            if self.properties is not None:
                self.properties.add(_plain_text(key.const))
            return truth(self.ctx.view.has(_plain_text(key.const)))
        self.properties = None
        return truth(self.ctx.view.has(to_text(key)))

    def _op_properties(self, a, scope, op):
        self.uses_feature, self.properties = True, None
        return self.ctx.view.whole()

    def _op_id(self, a, scope, op):
        self.uses_feature = True
        return null() if self.ctx.feature_id is None else num(self.ctx.feature_id)

    def _op_geometry_type(self, a, scope, op):
        self.uses_feature = True
        return null() if self.ctx.geometry_type is None else text(self.ctx.geometry_type)

    def _op_zoom(self, a, scope, op):
        return self._zoom()

    def _op_let(self, a, scope, op):
        if len(a) % 2 == 0:
            return self._unsupported("let without a body")
        inner = {a[i]: self.expression(a[i + 1], scope) for i in range(0, len(a) - 1, 2)}
        return self.expression(a[-1], {**scope, **inner})

    def _op_var(self, a, scope, op):
        return scope.get(a[0], null()) if a and isinstance(a[0], str) else null()

    # decisions

    def _op_not(self, a, scope, op):
        return truth(~truthy(self.expression(a[0] if a else None, scope)))

    def _op_equal(self, a, scope, op):
        x, y = (self._args(a, scope) + [null(), null()])[:2]
        eq = same(x, y)
        return truth(eq if op == "==" else ~eq)

    def _op_order(self, a, scope, op):
        x, y = (self._args(a, scope) + [null(), null()])[:2]
        return truth(ordered(op, x, y))

    def _op_all(self, a, scope, op):
        return truth(reduce(lambda p, q: p & q, [truthy(v) for v in self._args(a, scope)], F.lit(True)))

    def _op_any(self, a, scope, op):
        return truth(reduce(lambda p, q: p | q, [truthy(v) for v in self._args(a, scope)], F.lit(False)))

    def _choose(self, tests: list[Column], outs: list[Value]) -> Value:
        """The out of the first test that holds; outs has one more for when none does."""
        kind, cols = unify(outs)
        col = cols[-1]
        for t, c in reversed(list(zip(tests, cols))):
            col = F.when(t, c).otherwise(col)
        made = _made(kind, col, outs)
        made.outs, made.rebuild = outs, lambda others: self._choose(tests, others)
        return made

    def _op_case(self, a, scope, op):
        outs = self._args(a[1::2], scope) if len(a) % 2 else self._args(a[1::2], scope)
        tests = [truthy(v) for v in self._args(a[: len(a) - len(a) % 2 : 2], scope)]
        last = self.expression(a[-1], scope) if len(a) % 2 else null()
        return self._choose(tests, [*outs[: len(tests)], last])

    def _op_match(self, a, scope, op):
        if len(a) < 3:
            return self._unsupported("match with too few arguments")
        given = self.expression(a[0], scope)
        labels: dict[Any, int] = {}
        outs = self._args(a[2:-1:2], scope) if len(a) % 2 == 0 else self._args(a[2::2], scope)
        for i, label in enumerate(a[1 : 2 * len(outs) : 2]):
            for one in label if isinstance(label, list) else [label]:
                labels[_key(one)] = i  # the last of equal labels counts
        last = self.expression(a[-1], scope) if len(a) % 2 == 0 else null()
        tests = [_among(given, [k for k, j in labels.items() if j == i]) for i in range(len(outs))]
        return self._choose(tests, [*outs, last])

    def _op_coalesce(self, a, scope, op):
        vs = self._args(a, scope)
        if not vs:
            return null()
        kind, cols = unify(vs)
        if kind == "any":
            cols = [F.when(_tag(c).isNotNull(), c) for c in cols]
        return _made(kind, F.coalesce(*cols), vs)

    def _op_within(self, a, scope, op):
        return self._unsupported(op)

    # ramps

    def _op_step(self, a, scope, op):
        given = to_num(self.expression(a[0], scope))
        outs = [self.expression(a[1], scope)] + self._args(a[3::2], scope)
        stops = [_stop(s) for s in a[2::2]][: len(outs) - 1]
        return self._steps(given, stops, outs)

    def _steps(self, given: Column, stops: list[float], outs: list[Value]) -> Value:
        """outs[0] below the first stop and for no number; the scan ends at the first stop above the input."""
        kind, cols = unify(outs)
        reached = F.lit(True)
        col = cols[0]
        for s, c in zip(stops, cols[1:]):
            reached = reached & (given >= s)
            col = F.when(F.coalesce(reached & ~F.isnan(given), F.lit(False)), c).otherwise(col)
        made = _made(kind, col, outs)
        made.outs, made.rebuild = outs, lambda others: self._steps(given, stops, others)
        return made

    def _op_interpolate(self, a, scope, op):
        if len(a) < 4:
            return self._unsupported(f"{op} with too few arguments")
        how = a[0] if isinstance(a[0], list) and a[0] else ["linear"]
        given = self.expression(a[1], scope)
        stops, outs = [_stop(s) for s in a[2::2]], self._args(a[3::2], scope)
        return self._ramp(how, given, stops[: len(outs)], outs)

    def _ramp(self, how: list, given: Value, stops: list[float], outs: list[Value]) -> Value:
        x = to_num(given)
        if len(outs) == 1:
            return outs[0]
        ease = _easing(how)
        pieces = []
        for i in range(len(stops) - 1):
            t = ease(x, stops[i], stops[i + 1])
            pieces.append(_between(outs[i], outs[i + 1], t))
        if any(p.kind == "color" for p in pieces) and all(p.kind == "color" or p.is_const and colors.parse(str(p.const)) for p in outs):
            outs = [colour(to_colour(o)) for o in outs]
        every = [outs[0], *pieces, outs[-1]]
        kind, cols = unify(every)
        col = F.when(x >= stops[-1], cols[-1]).otherwise(cols[-2])
        for i in range(len(stops) - 2, 0, -1):  # cols[i] is the piece that ends at stop i
            col = F.when(x < stops[i], cols[i]).otherwise(col)
        col = F.when(x <= stops[0], cols[0]).otherwise(col)
        return _made(kind, F.when(x.isNotNull(), col), every)

    # lists and texts

    def _op_in(self, a, scope, op):
        if len(a) < 2:
            return truth(False)
        needle, hay = self._args(a[:2], scope)
        if hay.kind == "list":
            if hay.is_const:
                return truth(_among(needle, [_key(k) for k in hay.const]))
            if hay.items is not None:
                return truth(reduce(lambda p, q: p | q, [same(needle, i) for i in hay.items], F.lit(False)))
            return truth(F.coalesce(F.exists(hay.col, lambda c: same(needle, Value(hay.elem, c))), F.lit(False)))
        s = _as_text(hay)
        return truth(F.lit(False) if s is None else F.coalesce(F.contains(s, to_text(needle)), F.lit(False)))

    def _op_index_of(self, a, scope, op):
        needle, hay = (self._args(a[:2], scope) + [null(), null()])[:2]
        if hay.kind == "list":
            items = hay.items if hay.items is not None else []
            col = F.lit(-1.0)
            for i in range(len(items) - 1, -1, -1):
                col = F.when(same(needle, items[i]), F.lit(float(i))).otherwise(col)
            return num(col)
        s = _as_text(hay)
        return null() if s is None else num(F.when(s.isNotNull(), F.instr(s, to_text(needle)).cast("double") - 1))

    def _op_at(self, a, scope, op):
        i, hay = (self._args(a[:2], scope) + [null(), null()])[:2]
        if hay.kind != "list":
            return null()
        n = to_num(i)
        return Value(hay.elem, F.when(n > -1, F.get(hay.col, n.cast("int"))))

    def _op_slice(self, a, scope, op):
        vs = self._args(a, scope)
        if len(vs) < 2:
            return null()
        start = to_num(vs[1]).cast("int")
        s = _as_text(vs[0]) if vs[0].kind != "list" else None
        size = F.size(vs[0].col) if vs[0].kind == "list" else F.length(s) if s is not None else None
        if size is None:
            return null()
        end = F.coalesce(to_num(vs[2]).cast("int"), size) if len(vs) > 2 else size
        bad = (start < 0) | (start > size)
        n = F.least(F.greatest(end, start), size) - start
        if vs[0].kind == "list":
            cut = F.when(bad, F.slice(vs[0].col, 1, 0)).otherwise(F.slice(vs[0].col, F.greatest(start, F.lit(0)) + 1, F.greatest(n, F.lit(0))))
            return Value("list", cut, elem=vs[0].elem)
        return text(F.when(bad, F.lit("")).otherwise(F.substring(s, start + 1, n)))

    def _op_length(self, a, scope, op):
        v = self.expression(a[0] if a else None, scope)
        if v.kind == "list":
            return num(F.size(v.col))
        s = _as_text(v)
        return null() if s is None else num(F.length(s))

    def _op_concat(self, a, scope, op):
        vs = self._args(a, scope)
        if all(v.is_const and v.kind in ("str", "num", "bool", "null") for v in vs):
            return text("".join(_plain_text(v.const) for v in vs))
        return text(F.concat(*[to_text(v) for v in vs]))

    def _op_format(self, a, scope, op):
        return self._op_concat([x for x in a if not isinstance(x, Mapping)], scope, op)

    def _op_case_change(self, a, scope, op):
        s = to_text(self.expression(a[0] if a else None, scope))
        return text(F.upper(s) if op == "upcase" else F.lower(s))

    # types

    def _op_to_string(self, a, scope, op):
        return text(to_text(self.expression(a[0] if a else None, scope)))

    def _op_to_boolean(self, a, scope, op):
        return truth(truthy(self.expression(a[0] if a else None, scope)))

    def _op_to_number(self, a, scope, op):
        return num(F.coalesce(*[to_num(v) for v in self._args(a, scope)], F.lit(0.0)))

    def _op_to_color(self, a, scope, op):
        found = [to_colour(v) for v in self._args(a, scope)]
        return colour(F.coalesce(*found)) if found else null()

    def _op_typeof(self, a, scope, op):
        v = self.expression(a[0] if a else None, scope)
        name = {"num": "number", "str": "string", "bool": "boolean", "color": "color", "list": "array", "map": "object"}
        if v.kind == "any":
            t = _tag(v.col)
            return text(F.when(t.isNull(), F.lit("null")).when(t.isin("int", "double"), F.lit("number")).when(t == "bool", F.lit("boolean")).otherwise(t))
        return text("null") if v.kind == "null" else text(F.when(v.col.isNull(), F.lit("null")).otherwise(F.lit(name[v.kind])))

    def _op_assert(self, a, scope, op):
        """The first argument that is of the type already, else null."""
        kind = {"string": "str", "number": "num", "boolean": "bool", "object": "map", "array": "list"}[op]
        found = []
        for v in self._args(a, scope):
            if v.kind == kind:
                found.append(v)
            elif v.kind == "any" and kind in ("str", "num", "bool"):
                c = v.col
                of = {"str": F.when(c["t"] == "string", c["s"]), "num": F.when(c["t"] == "int", c["l"].cast("double")).when(c["t"] == "double", c["d"]), "bool": F.when(c["t"] == "bool", c["b"])}
                found.append(Value(kind, of[kind]))
        if not found:
            return null()
        return found[0] if len(found) == 1 else _made(kind, F.coalesce(*[v.col for v in found]), found)

    # colours

    def _op_rgb(self, a, scope, op):
        vs = self._args(a, scope)
        if all(v.is_const for v in vs):
            c = [v.const for v in vs] if all(isinstance(v.const, float) for v in vs) else None
            ok = c is not None and len(c) in (3, 4)
            return colour(colors._bytes(colors._round(colors._clamp(c[3] if len(c) > 3 else 1.0) * 255), *(int(colors._clamp(colors._round(x), 0, 255)) for x in c[:3]))) if ok else null()
        return colour(to_colour(Value("list", F.lit(None), vs)))

    def _op_to_rgba(self, a, scope, op):
        c = to_colour(self.expression(a[0] if a else None, scope))
        parts = [num(c[k] * 255) for k in "rgb"] + [num(c["a"])]
        return Value("list", F.when(c.isNotNull(), F.array(*[p.col for p in parts])), parts, "num")

    # arithmetic

    def _op_sum(self, a, scope, op):
        vs = [to_num(v) for v in self._args(a, scope)]
        return num(reduce((lambda x, y: x + y) if op == "+" else (lambda x, y: x * y), vs, F.lit(0.0 if op == "+" else 1.0)))

    def _op_minus(self, a, scope, op):
        vs = [to_num(v) for v in self._args(a, scope)]
        return num(finite(-vs[0] if len(vs) == 1 else vs[0] - vs[1])) if vs else null()

    def _op_binary(self, a, scope, op):
        if len(a) < 2:
            return null()
        x, y = (to_num(v) for v in self._args(a[:2], scope))
        if op == "/":
            return num(finite(F.when(y != 0, F.try_divide(x, y))))
        if op == "%":
            return num(finite(F.when(y != 0, F.pmod(x, F.abs(y)))))
        return num(finite(F.pow(x, y)))

    def _op_math1(self, a, scope, op):
        v = self.expression(a[0] if a else None, scope)
        column, plain = MATH_1[op]
        if v.is_const and isinstance(v.const, float):
            try:
                r = float(plain(v.const))
            except (ValueError, OverflowError):
                return null()
            return num(r) if math.isfinite(r) else null()
        return num(finite(column(to_num(v))))

    def _op_extreme(self, a, scope, op):
        vs = [to_num(v) for v in self._args(a, scope)]
        if not vs:
            return null()
        if len(vs) == 1:
            return num(vs[0])
        every = reduce(lambda p, q: p & q, [v.isNotNull() for v in vs])
        return num(F.when(every, (F.least if op == "min" else F.greatest)(*vs)))

    def _op_constant(self, a, scope, op):
        return num(CONSTANTS[op])

    def _op_stub(self, a, scope, op):
        return literal(STUBS[op])

    # legacy syntax

    def _legacy_key(self, key: Any) -> Value:
        if key == "$type":
            return self._op_geometry_type([], {}, "")
        if key == "$id":
            return self._op_id([], {}, "")
        return self._get(str(key))

    def _legacy(self, x: Any) -> Column:
        if isinstance(x, bool):
            return F.lit(x)
        if not isinstance(x, (list, tuple)) or not x:
            return F.lit(True)
        op, a = x[0], list(x[1:])
        if op in ("all", "any", "none"):
            parts = [self.filter(p) if isinstance(p, list) and p and is_expression_filter(p) else self._legacy(p) for p in a]
            if op == "all":
                return reduce(lambda p, q: p & q, parts, F.lit(True))
            some = reduce(lambda p, q: p | q, parts, F.lit(False))
            return some if op == "any" else ~some
        if op in ("has", "!has") and a:
            if a[0] == "$type":
                there = F.lit(True)
            elif a[0] == "$id":
                there = ~is_null(self._legacy_key("$id"))
            else:
                there = truthy(self._op_has([a[0]], {}, "has"))
            return there if op == "has" else ~there
        if op in ("==", "!=") and len(a) > 1:
            eq = same(self._legacy_key(a[0]), literal(a[1]))
            return eq if op == "==" else ~eq
        if op in ("<", "<=", ">", ">=") and len(a) > 1:
            return ordered(op, self._legacy_key(a[0]), literal(a[1]))
        if op in ("in", "!in") and a:
            found = _among(self._legacy_key(a[0]), [_key(k) for k in a[1:]])
            return found if op == "in" else ~found
        self.warnings.append(f"not supported: legacy filter {op}")
        return F.lit(True)

    def function(self, f: Mapping[str, Any]) -> Value:
        """A legacy function object: stops of the zoom or of a property. Outputs are plain values."""
        prop, kind = f.get("property"), f.get("type")
        given = self._get(prop) if isinstance(prop, str) else self._zoom()
        default = literal(f.get("default"))
        if kind == "identity":
            k, cols = unify([given, default])
            return _made(k, F.coalesce(*cols) if k != "any" else F.when(_tag(cols[0]).isNotNull(), cols[0]).otherwise(cols[1]), [given, default])
        stops = [s for s in f.get("stops") or [] if isinstance(s, (list, tuple)) and len(s) >= 2]
        if not stops:
            return default
        outs = [literal(s[1]) for s in stops]
        if kind == "categorical":
            first: dict[Any, Value] = {}
            for s, o in zip(stops, outs):
                first.setdefault(_key(s[0]), o)
            return self._choose([_among(given, [k]) for k in first], [*first.values(), default])
        x = to_num(given)
        at = [_stop(s[0]) for s in stops]
        if kind == "interval" or not all(_smooth(o) for o in outs) and kind is None:
            v = self._steps(x, at, [outs[0], *outs])
        else:
            v = self._ramp(["exponential", f.get("base", 1)], num(x), at, outs)
        k, cols = unify([v, default])
        return _made(k, F.when(x.isNotNull(), cols[0]).otherwise(cols[1]), [v, default] if default.kind != "null" else [v])


#: Methods whose name isn't the operator's.
NAMES = {
    "!": "not", "==": "equal", "!=": "equal", "<": "order", "<=": "order", ">": "order", ">=": "order", "interpolate-hcl": "interpolate", "interpolate-lab": "interpolate",
    "upcase": "case_change", "downcase": "case_change", "string": "assert", "number": "assert", "boolean": "assert", "object": "assert", "array": "assert", "image": "to_string",
    "rgba": "rgb", "+": "sum", "*": "sum", "-": "minus", "/": "binary", "%": "binary", "^": "binary", "min": "extreme", "max": "extreme",
    **{k: "math1" for k in MATH_1}, **{k: "constant" for k in CONSTANTS}, **{k: "stub" for k in STUBS if k != "within"},
}


def _plain_text(x: Any) -> str:
    if x is None:
        return ""
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, (int, float)):
        return str(int(x)) if float(x).is_integer() else str(x)
    return str(x)


def _key(x: Any) -> tuple[str, Any] | None:
    """A label by type and value; 1 and 1.0 are one label."""
    if x is None:
        return None
    if isinstance(x, bool):
        return "bool", x
    return ("num", float(x)) if isinstance(x, (int, float)) else ("str", str(x))


def _among(v: Value, keys: Sequence[tuple[str, Any] | None]) -> Column:
    """Whether the value is one of some labels; set membership per type."""
    of = {k: [x[1] for x in keys if x is not None and x[0] == k] for k in ("num", "str", "bool")}
    c = v.col
    if v.kind == "any":
        n = F.when(c["t"] == "int", c["l"].cast("double")).when(c["t"] == "double", c["d"])
        tests = {"num": n, "str": F.when(c["t"] == "string", c["s"]), "bool": F.when(c["t"] == "bool", c["b"])}
    else:
        tests = {v.kind: c}
    found = [tests[k].isin(*labels) for k, labels in of.items() if labels and k in tests]
    if None in keys:
        found.append(is_null(v))
    return F.coalesce(reduce(lambda p, q: F.coalesce(p, F.lit(False)) | F.coalesce(q, F.lit(False)), found, F.lit(False)), F.lit(False))


def _as_text(v: Value) -> Column | None:
    if v.kind == "str":
        return v.col
    return F.when(v.col["t"] == "string", v.col["s"]) if v.kind == "any" else None


def _stop(s: Any) -> float:
    if isinstance(s, bool):
        return float(s)
    if isinstance(s, (int, float)):
        return float(s)
    try:
        return float(s)
    except (TypeError, ValueError):
        return 0.0


def _smooth(v: Value) -> bool:
    return v.kind in ("num", "list", "color") or v.kind == "str" and v.is_const and colors.parse(v.const) is not None


def _easing(how: list) -> Callable[[Column, float, float], Column]:
    base = float(how[1]) if how[0] == "exponential" and len(how) > 1 and isinstance(how[1], (int, float)) else 1.0

    def share(x: Column, a: float, b: float) -> Column:
        span = b - a
        if span <= 0:
            return F.lit(0.0)
        if base == 1.0 or how[0] != "exponential":
            return F.least(F.greatest((x - a) / span, F.lit(0.0)), F.lit(1.0))
        whole = base**span - 1
        if whole == 0 or not math.isfinite(whole):
            return F.lit(0.0)
        t = (F.pow(F.lit(base), x - a) - 1) / whole
        return F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))

    if how[0] == "cubic-bezier" and len(how) >= 5:
        return lambda x, a, b: bezier(share(x, a, b), *(float(v) for v in how[1:5]))
    return share


def bezier(t: Column, x1: float, y1: float, x2: float, y2: float, rounds: int = 14) -> Column:
    """The cubic easing curve through (0,0), (x1,y1), (x2,y2), (1,1): the curve's parameter is bisected."""

    def curve(p1: float, p2: float, m: Column) -> Column:
        n = 1 - m
        return n * n * m * (3 * p1) + n * m * m * (3 * p2) + m * m * m

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        m = (s["lo"] + s["hi"]) / 2
        low = curve(x1, x2, m) < t
        return F.struct(F.when(low, m).otherwise(s["lo"]).alias("lo"), F.when(low, s["hi"]).otherwise(m).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda s: curve(y1, y2, (s["lo"] + s["hi"]) / 2))
    return F.when(t <= 0, F.lit(0.0)).when(t >= 1, F.lit(1.0)).otherwise(found)


def _between(a: Value, b: Value, t: Column) -> Value:
    """Numbers, else colours, else lists of like length part by part, else the nearer value."""
    if a.kind == "num" and b.kind == "num":
        return num(a.col + (b.col - a.col) * t)
    if "list" in (a.kind, b.kind):
        if a.items is not None and b.items is not None and len(a.items) == len(b.items) and a.items:
            return listing([_between(x, y, t) for x, y in zip(a.items, b.items)])
    elif all(_numeric(v) for v in (a, b)):
        x, y = to_num(a), to_num(b)
        return num(x + (y - x) * t)
    elif all(v.kind in ("color", "str", "any") for v in (a, b)):
        x, y = to_colour(a), to_colour(b)
        if all(v.kind == "color" or v.is_const and colors.parse(v.const) for v in (a, b)):
            return colour(colors.lerp(x, y, t))
        if "any" in (a.kind, b.kind):
            n, m = to_num(a), to_num(b)
            mixed = F.when(n.isNotNull() & m.isNotNull(), tagged("double", d=n + (m - n) * t)).when(x.isNotNull() & y.isNotNull(), to_any(colour(colors.lerp(x, y, t))))
            return Value("any", F.coalesce(mixed, F.when(t < 0.5, to_any(a)).otherwise(to_any(b))))
    kind, (x, y) = unify([a, b])
    return _made(kind, F.when(t < 0.5, x).otherwise(y), [a, b])


def _numeric(v: Value) -> bool:
    if v.kind in ("num", "bool"):
        return True
    try:
        return v.kind == "str" and v.is_const and math.isfinite(float(v.const))
    except ValueError:
        return False


def is_expression_filter(x: Any) -> bool:
    """Whether a filter is an expression rather than in the legacy form, as the style specification tells them apart."""
    if isinstance(x, bool):
        return True
    if not isinstance(x, (list, tuple)) or not x:
        return False
    op, a = x[0], x[1:]
    if op == "has":
        return len(a) >= 1 and a[0] not in ("$id", "$type")
    if op == "in":
        return len(a) == 2 and (not isinstance(a[0], str) or isinstance(a[1], list))
    if op in ("!in", "!has", "none"):
        return False
    if op in ("==", "!=", ">", ">=", "<", "<="):
        return len(a) != 2 or isinstance(a[0], list) or isinstance(a[1], list)
    if op in ("any", "all"):
        return all(isinstance(f, bool) or is_expression_filter(f) for f in a)
    return True


# -- typed properties -------------------------------------------------------------------------------------------


def compile_expression(x: Any, ctx: Context) -> Compiled:
    c = Compiler(ctx)
    return c.done(c.expression(x))


def compile_filter(x: Any, ctx: Context) -> Compiled:
    c = Compiler(ctx)
    return c.done(truth(c.filter(x)))


def property_column(x: Any, kind: str, fallback: Any, ctx: Context, tokens: bool = False) -> Compiled:
    """A paint or layout property coerced to its type, with its fallback: kind is number, color, string, boolean,
    numbers or strings."""
    c = Compiler(ctx)
    if x is None:
        v = literal(fallback) if kind != "color" else null()
    elif tokens and isinstance(x, str):
        v = c.template(x)
    elif isinstance(x, list) and kind in ("numbers", "strings") and not (x and isinstance(x[0], str) and x[0] in OPERATORS):
        v = literal(x)
    else:
        v = c.expression(x)
    return c.done(coerce(v, kind, fallback))


def coerce(v: Value, kind: str, fallback: Any) -> Value:
    if kind == "number":
        base = F.lit(None).cast("double") if fallback is None else F.lit(float(fallback))
        return num(F.coalesce(to_num(v), base))
    if kind == "color":
        return colour(F.coalesce(to_colour(v), colors.literal(colors.parse(fallback) if fallback else None)))
    if kind == "string":
        return text(F.when(is_null(v), F.lit(fallback)).otherwise(to_text(v)))
    if kind == "boolean":
        return truth(F.when(is_null(v), F.lit(fallback)).otherwise(truthy(v)))
    if kind == "numbers":
        other = literal(list(fallback)) if fallback is not None else None
        base = F.lit(None).cast("array<double>") if other is None else other.col.cast("array<double>")
        if v.kind != "list":
            return Value("list", base, other.items if other else None, "num")
        nums = [to_num(Value(v.elem, F.get(v.col, F.lit(i)))) for i in range(len(v.items))] if v.items is not None else None
        col = F.array(*nums) if nums else F.transform(v.col, lambda e: to_num(Value(v.elem, e)))
        good = F.forall(col, lambda e: e.isNotNull())
        return Value("list", F.when(v.col.isNotNull() & good, col).otherwise(base), None, "num")
    if kind == "strings":
        base = F.lit(None).cast("array<string>") if fallback is None else literal(list(fallback)).col.cast("array<string>")
        if v.kind == "list":
            return Value("list", F.coalesce(F.transform(v.col, lambda e: to_text(Value(v.elem, e))), base), None, "str")
        return Value("list", F.when(is_null(v), base).otherwise(F.array(to_text(v))), None, "str")
    raise ValueError(kind)
