"""Queries over the driver's tables, each with SQL that gives the same rows.

``pts`` are the events as points of a 65,536 pixel world at zoom 8, ``lines`` the embeddings as
polylines of 32 vertices in tile units; integer arithmetic makes them equal in both engines.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import color, geometry
from .functions import tiles as T
from .operators import drawlist, joins, stamps, symbols
from .operators.folds import fold
from .plans import problems, style
from .plans.expressions import Context, TypedView, compile_expression, compile_filter, property_column
from .plans.theme import read_theme
from .sources import cache, mvt, pmtiles, providers
from .streaming import labels

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6) + F.lit(0.0)


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    px, py = (F.col("event_id") * 7919) % 65536, (F.col("event_id") * 104729) % 65536
    return e.select(
        "event_id", "ts", "user_id", "event_type", "value", F.regexp_extract("props", r"(\d+)", 1).cast("bigint").alias("k"), px.alias("px"), py.alias("py"),
        F.shiftright(px, 8).alias("x"), F.shiftright(py, 8).alias("y"), F.lit(8).alias("z"),
    )


PTS = """pts AS (SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k,
 (event_id * 7919) % 65536 AS px, (event_id * 104729) % 65536 AS py, ((event_id * 7919) % 65536) >> 8 AS x, ((event_id * 104729) % 65536) >> 8 AS y, 8 AS z FROM events)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return v.select("vec_id", "label", F.transform("embedding", lambda e: F.round(e.cast("double") * 8192) + 2048).alias("p"))


LINES = """lines AS (SELECT vec_id, label, list_transform(embedding, lambda e: round(CAST(e AS DOUBLE) * 8192) + 2048) AS p FROM embeddings),
 seg AS (SELECT vec_id, label, i, p[2*i+1] AS x1, p[2*i+2] AS y1, p[2*i+3] AS x2, p[2*i+4] AS y2,
  sqrt((p[2*i+3]-p[2*i+1])*(p[2*i+3]-p[2*i+1]) + (p[2*i+4]-p[2*i+2])*(p[2*i+4]-p[2*i+2])) AS len
  FROM lines, unnest(range(len(p)//2 - 1)) AS t(i))"""


def typed(df: DataFrame, **kinds: str) -> TypedView:
    return TypedView({k: (F.col(k), v) for k, v in kinds.items()})


EVENT = {"event_id": "num", "event_type": "str", "value": "num", "k": "num"}


# -- filters and expressions ------------------------------------------------------------------------------------


@query(f"WITH {PTS} SELECT event_id, event_type, k FROM pts WHERE event_type IN ('click','view') AND event_type IS DISTINCT FROM 'view' OR (k >= 3 AND k < 40 AND value > 10)")
def filter_expression(spark, sf_dir):
    p = pts(spark, sf_dir)
    f = ["any", ["all", ["in", ["get", "event_type"], ["literal", ["click", "view"]]], ["!=", ["get", "event_type"], "view"]], ["all", [">=", ["get", "k"], 3], ["<", ["get", "k"], 40], [">", ["get", "value"], 10]]]
    return p.where(compile_filter(f, Context(typed(p, **EVENT))).value.col).select("event_id", "event_type", "k")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT (o_orderstatus = 'F' OR o_orderpriority IN ('1-URGENT','5-LOW')) AND o_totalprice <= 200000")
def filter_legacy(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    ctx = Context(typed(o, o_orderstatus="str", o_orderpriority="str", o_totalprice="num"))
    f = ["all", ["none", ["==", "o_orderstatus", "F"], ["in", "o_orderpriority", "1-URGENT", "5-LOW"]], ["!in", "missing", 1, 2], ["!has", "missing"], ["has", "o_orderstatus"], ["<=", "o_totalprice", 200000]]
    return o.where(compile_filter(f, ctx).value.col).select("o_orderkey", "o_orderstatus")


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band,
 CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 3.0 ELSE 0.0 END::DOUBLE AS weight, coalesce(nullif(o_orderpriority, ''), 'none') AS prio FROM orders""")
def expr_case_match(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    ctx = Context(typed(o, o_orderstatus="str", o_orderpriority="str", o_totalprice="num"))
    c = lambda e: compile_expression(e, ctx).value.col
    band = ["case", [">", ["get", "o_totalprice"], 200000], "high", [">", ["get", "o_totalprice"], 100000], "mid", "low"]
    weight = ["match", ["get", "o_orderstatus"], "F", 1, ["O", "X"], 2, "O", 3, 0]
    return o.select("o_orderkey", c(band).alias("band"), c(weight).alias("weight"), c(["coalesce", ["get", "gone"], ["get", "o_orderpriority"], "none"]).alias("prio"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 40 THEN 'd' WHEN l_quantity >= 20 THEN 'c' WHEN l_quantity >= 5 THEN 'b' ELSE 'a' END AS step,
 round(CASE WHEN l_quantity <= 10 THEN 0.0 WHEN l_quantity >= 40 THEN 50.0 WHEN l_quantity < 20 THEN (l_quantity - 10) / 10.0 * 100.0 ELSE 100.0 + (l_quantity - 20) / 20.0 * -50.0 END, 6) + 0.0 AS linear,
 round(CASE WHEN l_quantity <= 1 THEN 2.0 WHEN l_quantity >= 50 THEN 300.0 ELSE 2.0 + 298.0 * (pow(1.2, l_quantity - 1) - 1) / (pow(1.2, 49.0) - 1) END, 6) + 0.0 AS exponential FROM lineitem""")
def expr_ramps(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    ctx = Context(typed(li, l_quantity="num"))
    q = ["get", "l_quantity"]
    c = lambda e: compile_expression(e, ctx).value.col
    return li.select(
        "l_orderkey", "l_linenumber", c(["step", q, "a", 5, "b", 20, "c", 40, "d"]).alias("step"),
        r6(c(["interpolate", ["linear"], q, 10, 0, 20, 100, 40, 50])).alias("linear"), r6(c(["interpolate", ["exponential", 1.2], q, 1, 2, 50, 300])).alias("exponential"),
    )


@query("""SELECT p_partkey, round(CASE WHEN p_size <= 1 THEN 1.0 WHEN p_size >= 50 THEN 10.0 ELSE 1.0 + 9.0 * (p_size - 1) / 49.0 END, 6) + 0.0 AS stops,
 CASE WHEN p_size >= 20 THEN 'c' WHEN p_size >= 10 THEN 'b' ELSE 'a' END AS intervals, CASE p_brand WHEN 'Brand#11' THEN 'x' WHEN 'Brand#22' THEN 'y' ELSE 'z' END AS categories, p_type AS same FROM part""")
def expr_legacy_functions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    ctx = Context(typed(p, p_size="num", p_brand="str", p_type="str"))
    c = lambda e: compile_expression(e, ctx).value.col
    return p.select(
        "p_partkey", r6(c({"property": "p_size", "stops": [[1, 1], [50, 10]]})).alias("stops"),
        c({"property": "p_size", "type": "interval", "stops": [[0, "a"], [10, "b"], [20, "c"]]}).alias("intervals"),
        c({"property": "p_brand", "type": "categorical", "stops": [["Brand#11", "x"], ["Brand#11", "w"], ["Brand#22", "y"]], "default": "z"}).alias("categories"),
        c({"property": "p_type", "type": "identity"}).alias("same"),
    )


@query("""SELECT c_custkey, upper(c_name) || '-' || lower(c_mktsegment) AS name, CAST(instr(c_name, '#') - 1 AS DOUBLE) AS at, substr(c_name, 3, 4) AS cut, CAST(length(c_name) AS DOUBLE) AS size,
 contains(c_name, '00') AS has00, c_name || ' (' || c_mktsegment || ')' AS label FROM customer""")
def expr_strings(spark, sf_dir):
    t = table(spark, sf_dir, "customer")
    ctx = Context(typed(t, c_name="str", c_mktsegment="str"))
    c = lambda e: compile_expression(e, ctx).value.col
    n = ["get", "c_name"]
    return t.select(
        "c_custkey", c(["concat", ["upcase", n], "-", ["downcase", ["get", "c_mktsegment"]]]).alias("name"), c(["index-of", "#", n]).alias("at"), c(["slice", n, 2, 6]).alias("cut"),
        c(["length", n]).alias("size"), c(["in", "00", n]).alias("has00"), property_column("{c_name} ({c_mktsegment}){gone}", "string", "", ctx, tokens=True).value.col.alias("label"),
    )


@query("""SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) + l_tax, 4) + 0.0 AS net, round(CASE WHEN l_discount <> 0 THEN l_tax / l_discount END, 6) + 0.0 AS ratio,
 round((((l_linenumber - 4) % 3) + 3) % 3, 6)::DOUBLE AS modulo, round(sqrt(l_quantity), 6) + 0.0 AS root, CAST(NULL AS DOUBLE) AS bad, round(CASE WHEN l_discount > 0 THEN ln(l_discount) END, 6) + 0.0 AS logged,
 round(least(l_quantity, l_linenumber * 10.0), 6) + 0.0 AS smaller, round(pow(l_quantity, 1.5), 4) + 0.0 AS powered, floor(l_quantity / 3) AS down FROM lineitem""")
def expr_math(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    ctx = Context(typed(li, l_extendedprice="num", l_discount="num", l_tax="num", l_quantity="num", l_linenumber="num"))
    c = lambda e: compile_expression(e, ctx).value.col
    g = lambda k: ["get", "l_" + k]
    return li.select(
        "l_orderkey", "l_linenumber", (F.round(c(["+", ["*", g("extendedprice"), ["-", 1, g("discount")]], g("tax")]), 4) + 0.0).alias("net"), r6(c(["/", g("tax"), g("discount")])).alias("ratio"),
        r6(c(["%", ["-", g("linenumber"), 4], -3])).alias("modulo"), r6(c(["sqrt", g("quantity")])).alias("root"), c(["sqrt", -1]).cast("double").alias("bad"),
        r6(c(["ln", g("discount")])).alias("logged"), r6(c(["min", g("quantity"), ["*", g("linenumber"), 10]])).alias("smaller"), (F.round(c(["^", g("quantity"), 1.5]), 4) + 0.0).alias("powered"),
        c(["floor", ["/", g("quantity"), 3]]).alias("down"),
    )


@query(f"""WITH {PTS} SELECT event_id, coalesce(try_cast(regexp_extract(event_type, '([0-9]+)', 1) AS DOUBLE), CAST(k AS DOUBLE), 0.0) AS num, CAST(k AS VARCHAR) AS txt, k <> 0 AS flag, 'number' AS kind,
 event_type AS first_text FROM pts""")
def expr_types(spark, sf_dir):
    p = pts(spark, sf_dir)
    ctx = Context(typed(p, **EVENT))
    c = lambda e: compile_expression(e, ctx).value.col
    return p.select(
        "event_id", c(["to-number", ["get", "event_type"], ["get", "k"]]).alias("num"), c(["to-string", ["get", "k"]]).alias("txt"), c(["to-boolean", ["get", "k"]]).alias("flag"),
        c(["typeof", ["get", "k"]]).alias("kind"), c(["string", ["get", "k"], ["get", "event_type"]]).alias("first_text"),
    )


@query("""SELECT p_partkey, (255::BIGINT << 24) + (CAST(round(t * 255) AS BIGINT) << 16) + (CAST(round((1 - t) * 128) AS BIGINT)) AS argb FROM
 (SELECT p_partkey, least(greatest((p_size - 1) / 64.0::DOUBLE, 0), 1) AS t FROM part)""")
def color_ramp(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    e = ["interpolate-lab", ["linear"], ["get", "p_size"], 1, "rgb(0, 0, 128)", 65, ["rgba", 255, 0, 0, 1]]
    v = property_column(e, "color", "#000", Context(typed(p, p_size="num"))).value.col
    return p.select("p_partkey", color.argb_column(v).alias("argb"))


@query("""SELECT c_custkey, (255::BIGINT << 24) + (c_custkey * 7919) % 16777216 AS argb, 4278190080 + CASE c_custkey % 3 WHEN 0 THEN 16711680 WHEN 1 THEN 8421504 ELSE 65280 END AS named FROM customer""")
def color_parse(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    text = F.concat(F.lit(" #"), F.lpad(F.hex((F.col("c_custkey") * 7919) % 16777216), 6, "0"))
    named = F.element_at(F.array(F.lit("RED"), F.lit("grey"), F.lit("hsl(120deg 100% 50%)")), (F.col("c_custkey") % 3 + 1).cast("int"))
    return c.select("c_custkey", color.argb_column(color.parse_column(text)).alias("argb"), color.argb_column(color.parse_column(named)).alias("named"))


# -- tiles ------------------------------------------------------------------------------------------------------


@query(f"""WITH {PTS} SELECT event_id, x, y, x >> 3 AS ax, y >> 3 AS ay, (x - ((x >> 3) << 3)) / 8.0::DOUBLE AS dx, (y - ((y >> 3) << 3)) / 8.0::DOUBLE AS dy, 0.125::DOUBLE AS scale,
 (((x - 300) % 256) + 256) % 256 AS wrapped, y < 256 AS valid FROM pts""")
def tile_keys(spark, sf_dir):
    p = pts(spark, sf_dir)
    z, x, y = F.col("z"), F.col("x"), F.col("y")
    ax, ay = T.ancestor(z, x, y, 5)
    dx, dy, s = T.fraction(z, x, y, F.lit(5), ax, ay)
    return p.select("event_id", "x", "y", ax.alias("ax"), ay.alias("ay"), dx.alias("dx"), dy.alias("dy"), s.alias("scale"), T.wrap_x(z, x - 300).alias("wrapped"), T.valid_y(z, y).alias("valid"))


HILBERT = """list_reduce(list_prepend({{'x': x::BIGINT, 'y': y::BIGINT, 'd': 0::BIGINT}}, list_transform(range({z}), lambda k: {{'x': ({z} - 1 - k)::BIGINT, 'y': 0::BIGINT, 'd': 0::BIGINT}})),
 lambda a, b: {{'x': CASE WHEN (a.y & (1::BIGINT << b.x)) = 0 THEN CASE WHEN (a.x & (1::BIGINT << b.x)) > 0 THEN (1::BIGINT << b.x) - 1 - (a.y & ((1::BIGINT << b.x) - 1)) ELSE a.y & ((1::BIGINT << b.x) - 1) END ELSE a.x & ((1::BIGINT << b.x) - 1) END,
 'y': CASE WHEN (a.y & (1::BIGINT << b.x)) = 0 THEN CASE WHEN (a.x & (1::BIGINT << b.x)) > 0 THEN (1::BIGINT << b.x) - 1 - (a.x & ((1::BIGINT << b.x) - 1)) ELSE a.x & ((1::BIGINT << b.x) - 1) END ELSE a.y & ((1::BIGINT << b.x) - 1) END,
 'd': a.d + (1::BIGINT << (2 * b.x)) * xor(3 * (CASE WHEN (a.x & (1::BIGINT << b.x)) > 0 THEN 1 ELSE 0 END), CASE WHEN (a.y & (1::BIGINT << b.x)) > 0 THEN 1 ELSE 0 END)}})"""


@query(f"WITH {PTS} SELECT event_id, ((1::BIGINT << 16) - 1) // 3 + ({HILBERT.format(z=8)}).d AS tile_id FROM pts")
def tile_hilbert(spark, sf_dir):
    p = pts(spark, sf_dir)
    return p.select("event_id", T.hilbert_id(F.col("z"), F.col("x"), F.col("y")).alias("tile_id"))


@query(f"""WITH {PTS}, disp AS (SELECT DISTINCT x, y FROM pts), data AS (SELECT x >> 2 AS dx, y >> 2 AS dy, count(*) AS n, CAST(sum(k) AS BIGINT) AS s FROM pts GROUP BY 1, 2)
 SELECT x, y, n, s FROM disp JOIN data ON x >> 2 = dx AND y >> 2 = dy""")
def overzoom_join(spark, sf_dir):
    p = pts(spark, sf_dir)
    display = joins.to_data_tiles(p.select("z", "x", "y").distinct(), "events", -1, 0, 6)
    data = p.groupBy(F.lit("events").alias("source"), F.lit(6).alias("z"), F.shiftright("x", 2).alias("x"), F.shiftright("y", 2).alias("y")).agg(F.count("*").alias("n"), F.sum("k").alias("s"))
    return joins.overzoom(display, data).select("x", "y", "n", "s")


@query(f"""WITH {PTS}, want AS (SELECT DISTINCT x, y FROM pts), have AS (SELECT DISTINCT 8 - (event_id % 5)::INT AS z, x >> (event_id % 5)::INT AS x, y >> (event_id % 5)::INT AS y FROM pts)
 SELECT w.x, w.y, max(h.z)::BIGINT AS anc_z FROM want w JOIN have h ON h.z >= 4 AND h.x = w.x >> (8 - h.z) AND h.y = w.y >> (8 - h.z) GROUP BY 1, 2""")
def ancestor_asof(spark, sf_dir):
    p = pts(spark, sf_dir)
    up = (F.col("event_id") % 5).cast("int")
    have = p.select((8 - up).alias("z"), T.shr(F.col("x"), up).alias("x"), T.shr(F.col("y"), up).alias("y"))
    return joins.nearest_ancestor(p.select("z", "x", "y"), have, min_zoom=4).select("x", "y", F.col("anc_z").cast("long").alias("anc_z"))


OVERLAP = """a AS (SELECT DISTINCT 8 - (event_id % 3)::INT AS z, x >> (event_id % 3)::INT AS x, y >> (event_id % 3)::INT AS y FROM pts),
 b AS (SELECT DISTINCT 6 + (event_id % 2)::INT AS z, x >> (2 - event_id % 2)::INT AS x, y >> (2 - event_id % 2)::INT AS y FROM pts)"""


def _overlap_sides(spark, sf_dir):
    p = pts(spark, sf_dir)
    u, v = (F.col("event_id") % 3).cast("int"), (F.col("event_id") % 2).cast("int")
    a = p.select((8 - u).alias("z"), T.shr(F.col("x"), u).alias("x"), T.shr(F.col("y"), u).alias("y")).distinct()
    b = p.select((6 + v).alias("z"), T.shr(F.col("x"), 2 - v).alias("x"), T.shr(F.col("y"), 2 - v).alias("y")).distinct()
    return a, b


@query(f"""WITH {PTS}, {OVERLAP} SELECT a.z::BIGINT AS az, a.x AS ax, a.y AS ay, b.z::BIGINT AS bz, b.x AS bx, b.y AS by FROM a JOIN b ON
 (a.x >> greatest(a.z - b.z, 0)) = (b.x >> greatest(b.z - a.z, 0)) AND (a.y >> greatest(a.z - b.z, 0)) = (b.y >> greatest(b.z - a.z, 0))""")
def tile_overlap(spark, sf_dir):
    got = joins.overlapping(*_overlap_sides(spark, sf_dir))
    return got.withColumn("az", F.col("az").cast("long")).withColumn("bz", F.col("bz").cast("long"))


@query(f"""WITH {PTS}, {OVERLAP}, b2 AS (SELECT *, (x + y) % 2 = 0 AS loading, x % 3 = 0 AS has_symbols FROM b), j AS (SELECT a.z, a.x, a.y, b2.loading AND NOT b2.has_symbols AS waits FROM a JOIN b2 ON
 (a.x >> greatest(a.z - b2.z, 0)) = (b2.x >> greatest(b2.z - a.z, 0)) AND (a.y >> greatest(a.z - b2.z, 0)) = (b2.y >> greatest(b2.z - a.z, 0)))
 SELECT z::BIGINT AS z, x, y FROM a WHERE y % 4 <> 0 AND (EXISTS (SELECT 1 FROM j WHERE j.z = a.z AND j.x = a.x AND j.y = a.y AND waits) OR NOT EXISTS (SELECT 1 FROM j WHERE j.z = a.z AND j.x = a.x AND j.y = a.y))""")
def tile_retention(spark, sf_dir):
    a, b = _overlap_sides(spark, sf_dir)
    current = b.withColumn("loading", (F.col("x") + F.col("y")) % 2 == 0).withColumn("has_symbols", F.col("x") % 3 == 0)
    got = joins.retained_needed(a.withColumn("has_symbols", F.col("y") % 4 != 0), current)
    return got.select(F.col("z").cast("long").alias("z"), "x", "y")


@query("""WITH g AS (SELECT s_suppkey, (s_suppkey * 7919) % 65536 AS cx, (s_suppkey * 104729) % 65536 AS cy FROM supplier),
 r AS (SELECT *, floor((cx - 200) / 256.0)::BIGINT - 1 AS x0, ceil((cx + 200) / 256.0)::BIGINT AS x1, greatest(floor((cy - 400) / 256.0)::BIGINT - 1, 0) AS y0, least(ceil((cy + 400) / 256.0)::BIGINT, 255) AS y1 FROM g)
 SELECT s_suppkey, x, y, round(4 * ((x - (x0 + x1) / 2.0) ** 2 + (y - (y0 + y1) / 2.0) ** 2))::BIGINT AS prio FROM r, unnest(range(x0, x1 + 1)) AS a(x), unnest(range(y0, y1 + 1)) AS b(y)""")
def grid_visible(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(
        "s_suppkey", ((F.col("s_suppkey") * 7919) % 65536).cast("double").alias("cx"), ((F.col("s_suppkey") * 104729) % 65536).cast("double").alias("cy"),
        F.lit(8.0).alias("zoom"), F.lit(400.0).alias("width"), F.lit(800.0).alias("height"),
    )
    return T.visible_grid(s, buffer=1).select("s_suppkey", "x", "y", F.col("prio").cast("long").alias("prio"))


@query(f"""WITH {PTS}, n AS (SELECT DISTINCT x >> 1 AS x, y >> 1 AS y FROM pts WHERE event_type IN ('click', 'view', 'signup')), b AS (SELECT DISTINCT x >> 1 AS x, y >> 1 AS y FROM pts WHERE event_type IN ('view', 'error', 'purchase'))
 SELECT x, y, 'add' AS change FROM (SELECT * FROM n EXCEPT SELECT * FROM b) UNION ALL SELECT x, y, 'remove' FROM (SELECT * FROM b EXCEPT SELECT * FROM n)""")
def grid_changes(spark, sf_dir):
    p = pts(spark, sf_dir).select("event_type", F.lit(7).alias("z"), F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y"))
    return joins.grid_changes(p.where("event_type IN ('click', 'view', 'signup')"), p.where("event_type IN ('view', 'error', 'purchase')")).select("x", "y", "change")


# -- geometry ---------------------------------------------------------------------------------------------------


@query(f"""WITH {LINES} SELECT vec_id, min(x)::DOUBLE AS minx, min(y)::DOUBLE AS miny, max(x)::DOUBLE AS maxx, max(y)::DOUBLE AS maxy FROM
 (SELECT vec_id, p[2*i+1] AS x, p[2*i+2] AS y FROM lines, unnest(range(len(p)//2)) AS t(i)) GROUP BY 1""")
def feature_bounds(spark, sf_dir):
    return lines(spark, sf_dir).select("vec_id", geometry.bounds(F.col("p")).alias("b")).select("vec_id", "b.*")


@query(f"""WITH {LINES}, ring AS (SELECT vec_id, p[2*i+1] AS x1, p[2*i+2] AS y1, p[2*((i+1) % (len(p)//2))+1] AS x2, p[2*((i+1) % (len(p)//2))+2] AS y2 FROM lines, unnest(range(len(p)//2)) AS t(i)),
 s AS (SELECT vec_id, sum((x1-x2)*(y1+y2))/2 AS area, sum(x1*y2-x2*y1) AS c, sum((x1+x2)*(x1*y2-x2*y1)) AS cx, sum((y1+y2)*(x1*y2-x2*y1)) AS cy, min(x1) FILTER (x1 IS NOT NULL) AS q FROM ring GROUP BY 1)
 SELECT s.vec_id, area, round(CASE WHEN abs(c) < 1e-7 THEN p[1] ELSE cx / (3 * c) END, 4) + 0.0 AS x, round(CASE WHEN abs(c) < 1e-7 THEN p[2] ELSE cy / (3 * c) END, 4) + 0.0 AS y FROM s JOIN lines USING (vec_id)""")
def ring_measures(spark, sf_dir):
    p = F.col("p")
    c = geometry.centroid(p)
    return lines(spark, sf_dir).select("vec_id", geometry.ring_area(p).alias("area"), (F.round(c["x"], 4) + 0.0).alias("x"), (F.round(c["y"], 4) + 0.0).alias("y"))


@query(f"""WITH {LINES}, c AS (SELECT *, sum(len) OVER (PARTITION BY vec_id ORDER BY i) - len AS done, sum(len) OVER (PARTITION BY vec_id) AS total FROM seg),
 h AS (SELECT vec_id, total, arg_min(struct_pack(x := x1 + (x2-x1)*(total/2-done)/len, y := y1 + (y2-y1)*(total/2-done)/len), i) AS m FROM c WHERE len > 0 AND done + len >= total/2 GROUP BY 1, 2)
 SELECT vec_id, round(total, 4) AS length, round(m.x, 3) + 0.0 AS x, round(m.y, 3) + 0.0 AS y FROM h""")
def line_measures(spark, sf_dir):
    p = F.col("p")
    m = geometry.midpoint(p)
    return lines(spark, sf_dir).select("vec_id", F.round(geometry.line_length(p), 4).alias("length"), (F.round(m["x"], 3) + 0.0).alias("x"), (F.round(m["y"], 3) + 0.0).alias("y"))


@query(f"""WITH {LINES}, b AS (SELECT vec_id, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM (SELECT vec_id, p[2*i+1] AS x, p[2*i+2] AS y FROM lines, unnest(range(len(p)//2)) AS t(i)) GROUP BY 1)
 SELECT vec_id, NOT (minx >= -512 AND maxx <= 1536 AND miny >= -512 AND maxy <= 1536) AS clip FROM b WHERE maxx >= -512 AND minx <= 1536 AND maxy >= -512 AND miny <= 1536""")
def bbox_cull(spark, sf_dir):
    b = lines(spark, sf_dir).select("vec_id", geometry.bounds(F.col("p")).alias("b")).select("vec_id", "b.*")
    rect = drawlist.window(F.lit(0.125), F.lit(0.0), F.lit(0.0))
    rect = (rect[0], rect[1], F.lit(1536.0), F.lit(1536.0))
    return b.where(drawlist.meets(rect)).select("vec_id", (~drawlist.inside(rect)).alias("clip"))


@query(f"""WITH {LINES}, t AS (SELECT vec_id, i, x1, y1, x2, y2, [x1-x2, x2-x1, y1-y2, y2-y1] AS d, [x1-1500, 2600-x1, y1-1500, 2600-y1] AS q FROM seg),
 w AS (SELECT vec_id, i, greatest(0.0, CASE WHEN d[1]<0 THEN q[1]/d[1] ELSE 0 END, CASE WHEN d[2]<0 THEN q[2]/d[2] ELSE 0 END, CASE WHEN d[3]<0 THEN q[3]/d[3] ELSE 0 END, CASE WHEN d[4]<0 THEN q[4]/d[4] ELSE 0 END) AS t0,
 least(1.0, CASE WHEN d[1]>0 THEN q[1]/d[1] ELSE 1 END, CASE WHEN d[2]>0 THEN q[2]/d[2] ELSE 1 END, CASE WHEN d[3]>0 THEN q[3]/d[3] ELSE 1 END, CASE WHEN d[4]>0 THEN q[4]/d[4] ELSE 1 END) AS t1,
 NOT ((d[1]=0 AND (q[1]<0 OR q[2]<0)) OR (d[3]=0 AND (q[3]<0 OR q[4]<0))) AS ok FROM t) SELECT vec_id, i::BIGINT AS i, round(t0, 6) + 0.0 AS t0, round(t1, 6) + 0.0 AS t1 FROM w WHERE ok AND t0 <= t1""")
def clip_segments(spark, sf_dir):
    p = F.col("p")
    segs = lines(spark, sf_dir).select("vec_id", F.explode(F.sequence(F.lit(0), geometry.n_points(p) - 2)).alias("i"), "p")
    at = lambda k: F.get(p, F.col("i") * 2 + k)
    w = geometry.segment_window(at(0), at(1), at(2), at(3), (1500.0, 1500.0, 2600.0, 2600.0))
    return segs.select("vec_id", F.col("i").cast("long").alias("i"), w.alias("w")).where("w is not null").select("vec_id", "i", r6(F.col("w.t0")).alias("t0"), r6(F.col("w.t1")).alias("t1"))


@query(f"WITH {LINES} SELECT vec_id, i::BIGINT AS i, round(sum(len) OVER (PARTITION BY vec_id ORDER BY i), 3) AS at FROM seg")
def cumulative_distance(spark, sf_dir):
    s = lines(spark, sf_dir).select("vec_id", F.posexplode(geometry.segment_lengths(F.col("p"))).alias("i", "len"))
    w = Window.partitionBy("vec_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return s.select("vec_id", F.col("i").cast("long").alias("i"), F.round(F.sum("len").over(w), 3).alias("at"))


@query(f"""WITH {LINES}, t AS (SELECT vec_id, sum(len) AS total FROM seg GROUP BY 1), s AS (SELECT vec_id, total, 250.0 + label * 500.0 AS spacing FROM t JOIN lines USING (vec_id)),
 a AS (SELECT vec_id, total / 2 AS d FROM s WHERE total >= 1 AND total < spacing UNION ALL
 SELECT vec_id, spacing / 2 + k * spacing FROM s, unnest(range(greatest(ceil((total - spacing / 2) / spacing)::BIGINT, 1))) AS u(k) WHERE total >= spacing AND total >= 1 AND spacing / 2 + k * spacing < total)
 SELECT vec_id, round(d, 3) AS d FROM a""")
def anchors_along_line(spark, sf_dir):
    ln = lines(spark, sf_dir)
    d = geometry.anchor_distances(geometry.line_length(F.col("p")), F.lit(250.0) + F.col("label") * 500.0)
    return ln.select("vec_id", F.explode(d).alias("d")).select("vec_id", F.round("d", 3).alias("d"))


@query(f"""WITH {LINES}, t AS (SELECT vec_id, sum(len) AS total FROM seg GROUP BY 1), d AS (SELECT vec_id, total, k, o FROM t, unnest(range((floor(total / 900))::BIGINT + 1)) AS u(k), unnest([0.0, 500.0]) AS v(o))
 SELECT vec_id, round(k * 900 + o, 3)::DOUBLE AS a, round(least(k * 900 + o + CASE WHEN o = 0 THEN 400 ELSE 250 END, total), 3) + 0.0 AS b FROM d WHERE least(k * 900 + o + CASE WHEN o = 0 THEN 400 ELSE 250 END, total) > k * 900 + o""")
def dash_segments(spark, sf_dir):
    ln = lines(spark, sf_dir).select("vec_id", geometry.line_length(F.col("p")).alias("total"))
    got = ln.select("vec_id", F.explode(drawlist.dashes(F.col("total"), [400.0, 100.0, 250.0, 150.0])).alias("s"))
    return got.select("vec_id", (F.round("s.a", 3) + 0.0).alias("a"), (F.round("s.b", 3) + 0.0).alias("b"))


#: Hue, saturation, contrast, low and high, and the formulas in SQL, step by step.
RASTER = [(40, -0.3, 0.2, 0.1, 0.9), (0, 0, 1, 0, 1), (400, 0.5, -0.4, -1, 2)]


def _raster_sql(case: int) -> str:
    hue, saturation, contrast, low, high = RASTER[case]
    turn = lambda a, b, c: f"(({a} + {b} + {c}) / 3 * (1 - cos(radians({hue}))) + {a} * cos(radians({hue})) + ({c} - {b}) / sqrt(3) * sin(radians({hue})))"
    grey = f"CASE WHEN {saturation} > 0 THEN 1 - 1 / (1.001 - {saturation}) ELSE -({saturation}) END"
    stretch = 1000.0 if contrast == 1 else f"CASE WHEN {contrast} > 0 THEN 1 / (1 - {contrast}) ELSE 1 + ({contrast}) END"
    lo, hi = max(low, 0), min(high, 1)
    end = lambda c: f"round(least(greatest(255 * {lo} + ({hi} - {lo}) * (({c} + ((r + g + b) / 3 - {c}) * {grey} - 127.5) * {stretch} + 127.5), 0), 255), 3) + 0.0 AS {c}"
    return f"""SELECT p_partkey, {case}::BIGINT AS setting, {end("r")}, {end("g")}, {end("b")}, 255.0::DOUBLE AS a FROM (SELECT p_partkey, {turn("r", "g", "b")}::DOUBLE AS r, {turn("g", "b", "r")}::DOUBLE AS g, {turn("b", "r", "g")}::DOUBLE AS b
 FROM (SELECT p_partkey, (p_size * 5 % 256)::DOUBLE AS r, (p_partkey % 256)::DOUBLE AS g, 128::DOUBLE AS b FROM part))"""


@query(" UNION ALL ".join(map(_raster_sql, range(len(RASTER)))))
def raster_colors(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    rgba = F.array((F.col("p_size") * 5 % 256).cast("double"), (F.col("p_partkey") % 256).cast("double"), F.lit(128.0), F.lit(255.0))
    every = F.array(*[F.struct(F.lit(i).cast("long").alias("setting"), drawlist.apply_matrix(drawlist.raster_matrix(*v), rgba).alias("c")) for i, v in enumerate(RASTER)])
    return p.select("p_partkey", F.inline(every)).select("p_partkey", "setting", *[(F.round(F.get("c", F.lit(i)), 3) + 0.0).alias(k) for i, k in enumerate("rgba")])


# -- draw lists and labels --------------------------------------------------------------------------------------

THEME: dict[str, Any] = {
    "version": 8, "name": "events",
    "layers": [
        {"id": "bg", "type": "background", "paint": {"background-color": "#f8f4f0"}},
        {"id": "clicks", "type": "circle", "source": "events", "source-layer": "pts", "filter": ["==", ["get", "event_type"], "click"],
         "paint": {"circle-radius": ["interpolate", ["linear"], ["get", "k"], 0, 1, 100, 11], "circle-color": "#ff0000", "circle-opacity": 0.5}},
        {"id": "big", "type": "circle", "source": "events", "source-layer": "pts", "minzoom": 5, "filter": ["all", ["!=", "event_type", "click"], [">", "value", 50]],
         "paint": {"circle-radius": 3, "circle-color": ["match", ["get", "event_type"], "view", "#00ff00", "#0000ff"], "circle-stroke-width": 1}},
        {"id": "deep", "type": "circle", "source": "events", "source-layer": "pts", "minzoom": 12},
        {"id": "names", "type": "symbol", "source": "events", "source-layer": "pts", "filter": [">=", ["get", "k"], 50],
         "layout": {"text-field": "{event_type} {k}", "text-transform": "uppercase", "symbol-sort-key": ["get", "k"], "text-size": 12}},
    ],
}


def event_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pts as placed() features of their own tiles."""
    p = pts(spark, sf_dir).withColumn("extent", F.lit(256)).withColumn("source", F.lit("events")).withColumn("source_layer", F.lit("pts"))
    lx, ly = (F.col("px") % 256).cast("double"), (F.col("py") % 256).cast("double")
    f = p.select(
        "source", "source_layer", "z", "x", "y", F.col("z").alias("data_z"), F.col("x").alias("data_x"), F.col("y").alias("data_y"), "extent", F.col("event_id").alias("ord"), F.col("event_id").alias("fid"),
        F.lit("Point").alias("geom_type"), F.array(F.array(lx.cast("float"), ly.cast("float"))).alias("parts"), lx.alias("minx"), lx.alias("maxx"), ly.alias("miny"), ly.alias("maxy"), "event_type", "value", "k", "px", "py",
    )
    return drawlist.placed(f)


def event_view() -> TypedView:
    return TypedView({"event_type": (F.col("event_type"), "str"), "value": (F.col("value"), "num"), "k": (F.col("k"), "num")})


DRAW_SQL = f"""WITH {PTS} SELECT ord, layer, argb, radius, stroke FROM (SELECT event_id AS ord, 'clicks' AS layer, (CAST(round(0.5 * 255) AS BIGINT) << 24) + 16711680 AS argb,
 round(1 + 10 * least(greatest(k / 100.0::DOUBLE, 0), 1), 6) AS radius, 0.0::DOUBLE AS stroke FROM pts WHERE event_type = 'click'
 UNION ALL SELECT event_id, 'big', 4278190080 + CASE WHEN event_type = 'view' THEN 65280 ELSE 255 END, 3.0, 1.0 FROM pts WHERE event_type <> 'click' AND value > 50)"""


@query(DRAW_SQL)
def draw_list(spark, sf_dir):
    got = drawlist.draw_list(event_features(spark, sf_dir), read_theme(THEME), 8.0, event_view())
    return got.select("ord", "layer", "argb", r6(F.col("radius")).alias("radius"), r6(F.col("stroke_width")).alias("stroke"))


SHAPES: dict[str, Any] = {
    "version": 8, "name": "shapes",
    "layers": [
        {"id": "land", "type": "background", "paint": {"background-color": "#204060", "background-opacity": ["interpolate", ["linear"], ["zoom"], 8, 0, 10, 1]}},
        {"id": "photo", "type": "raster", "source": "photos", "paint": {"raster-opacity": ["interpolate", ["linear"], ["zoom"], 8, 0.1, 10, 0.9]}},
        {"id": "dim", "type": "raster", "source": "photos", "minzoom": 9, "paint": {"raster-hue-rotate": 40, "raster-brightness-max": {"stops": [[8, 1], [12, 0.6]]}}},
        {"id": "areas", "type": "fill", "source": "shapes", "source-layer": "lines", "filter": [">=", ["get", "label"], 3],
         "paint": {"fill-color": ["match", ["get", "label"], 3, "#ff8000", "#0080ff"], "fill-opacity": ["interpolate", ["linear"], ["zoom"], 8, 0.2, 10, 1], "fill-outline-color": "#102030"}},
        {"id": "ways", "type": "line", "source": "shapes", "source-layer": "lines", "filter": ["<", ["get", "label"], 8],
         "paint": {"line-color": "#00ff00", "line-width": {"base": 1.5, "stops": [[5, 1], [15, 20]]}, "line-gap-width": ["case", [">", ["get", "label"], 4], 2, 0], "line-dasharray": [4, 2]}},
    ],
}


def shape_features(spark: SparkSession, sf_dir: str, geometry_type: str, zooms: int) -> DataFrame:
    """lines of data tiles at zoom 8 as placed() features of one display tile each, ``zooms`` deeper."""
    n, v = 1 << zooms, F.col("vec_id")
    dx, dy = v % 256, F.floor(v / 256) % 256
    ln = lines(spark, sf_dir).select("*", geometry.bounds(F.col("p")).alias("b"))
    return drawlist.placed(ln.select(
        F.lit("shapes").alias("source"), F.lit("lines").alias("source_layer"), F.lit(8 + zooms).alias("z"), (dx * n + v % n).alias("x"), (dy * n + F.floor(v / n) % n).alias("y"), F.lit(8).alias("data_z"),
        dx.alias("data_x"), dy.alias("data_y"), F.lit(4096).alias("extent"), v.alias("ord"), v.alias("fid"), F.lit(geometry_type).alias("geom_type"), F.array(F.col("p").cast("array<float>")).alias("parts"), "b.*", "label",
    ))


def shape_view() -> TypedView:
    return TypedView({"label": (F.col("label"), "num")})


def _shape_sql(zooms: int) -> str:
    """w: each line with scale s, offsets ox and oy, and its window l, t, r, b, if its bounds touch that."""
    n = 1 << zooms
    return f"""{LINES}, o AS (SELECT vec_id, label, p, {n} / 16.0::DOUBLE AS s, -256.0::DOUBLE * (vec_id % {n}) AS ox, -256.0::DOUBLE * (vec_id // {n} % {n}) AS oy FROM lines),
 w AS (SELECT *, (-64 - ox) / s AS l, (-64 - oy) / s AS t, (320 - ox) / s AS r, (320 - oy) / s AS b FROM o WHERE
 list_max([p[2*i+1] for i in range(len(p)//2)]) >= (-64 - ox) / s AND list_min([p[2*i+1] for i in range(len(p)//2)]) <= (320 - ox) / s AND
 list_max([p[2*i+2] for i in range(len(p)//2)]) >= (-64 - oy) / s AND list_min([p[2*i+2] for i in range(len(p)//2)]) <= (320 - oy) / s)"""


@query(f"""WITH {_shape_sql(1)} SELECT vec_id AS ord, (204::BIGINT << 24) + CASE WHEN label = 3 THEN 16744448 ELSE 33023 END AS argb, (204::BIGINT << 24) + 1056816 AS stroke_argb, 0.8::DOUBLE AS opacity,
 (len(p) // 2)::BIGINT AS vertices, round(p[1] * s + ox, 6) + 0.0 AS x0, round(p[2] * s + oy, 6) + 0.0 AS y0 FROM w WHERE label >= 3""")
def draw_fills(spark, sf_dir):
    """One zoom over the data: culled, not cut. At zoom 9.5 the opacity ramp gives 0.8."""
    got = drawlist.draw_list(shape_features(spark, sf_dir, "Polygon", 1), read_theme(SHAPES), 9.5, shape_view()).where("kind = 'fill'")
    ring = F.get("parts", F.lit(0))
    return got.select("ord", "argb", "stroke_argb", r6(F.col("opacity")).alias("opacity"), F.floor(F.size(ring) / 2).alias("vertices"), r6(F.get(ring, F.lit(0))).alias("x0"), r6(F.get(ring, F.lit(1))).alias("y0"))


@query(f"""WITH {_shape_sql(3)}, g AS (SELECT w.*, i, x1, y1, x2, y2, len, sum(len) OVER (PARTITION BY vec_id ORDER BY i) - len AS done FROM w JOIN seg USING (vec_id, label)),
 d AS (SELECT *, greatest(0.0, CASE WHEN x2 > x1 THEN (l-x1)/(x2-x1) WHEN x2 < x1 THEN (r-x1)/(x2-x1) ELSE 0 END, CASE WHEN y2 > y1 THEN (t-y1)/(y2-y1) WHEN y2 < y1 THEN (b-y1)/(y2-y1) ELSE 0 END) AS t0,
 least(1.0, CASE WHEN x2 > x1 THEN (r-x1)/(x2-x1) WHEN x2 < x1 THEN (l-x1)/(x2-x1) ELSE 1 END, CASE WHEN y2 > y1 THEN (b-y1)/(y2-y1) WHEN y2 < y1 THEN (t-y1)/(y2-y1) ELSE 1 END) AS t1 FROM g
 WHERE NOT (x1 = x2 AND (x1 < l OR x1 > r)) AND NOT (y1 = y2 AND (y1 < t OR y1 > b)))
 SELECT vec_id AS ord, round(sum((t1 - t0) * len * s), 3) AS length, round(min(done + t0 * len) * min(s), 3) + 0.0 AS start, round(1 + 19 * (pow(1.5, 6.5) - 1) / (pow(1.5, 10.0) - 1), 6) AS width,
 CASE WHEN min(label) > 4 THEN round(2 + 2 * (1 + 19 * (pow(1.5, 6.5) - 1) / (pow(1.5, 10.0) - 1)), 6) END AS casing FROM d WHERE t0 < t1 AND label < 8 GROUP BY 1 HAVING sum((t1 - t0) * len) > 1e-6""")
def draw_lines(spark, sf_dir):
    """Three zooms over the data: lines are cut to the tile, and know how far along they begin."""
    got = drawlist.draw_list(shape_features(spark, sf_dir, "LineString", 3), read_theme(SHAPES), 11.5, shape_view()).where("kind = 'line'")
    length = F.aggregate(F.transform("parts", geometry.line_length), F.lit(0.0), lambda a, v: a + v)
    cut = got.select("ord", length.alias("length"), F.array_min("starts").alias("start"), "width", "casing_width").where("length > 1e-6")
    return cut.select("ord", F.round("length", 3).alias("length"), (F.round("start", 3) + 0.0).alias("start"), r6(F.col("width")).alias("width"), F.round("casing_width", 6).alias("casing"))


@query(f"""WITH {_shape_sql(3)}, e AS (SELECT vec_id, s, l, t, r - l AS w, b, p[2*i+1] AS x1, p[2*i+2] AS y1, p[2*((i+1) % (len(p)//2))+1] AS x2, p[2*((i+1) % (len(p)//2))+2] AS y2 FROM w, unnest(range(len(p)//2)) AS u(i) WHERE label >= 3),
 c AS (SELECT *, greatest(least(y1, b), t) AS ya, greatest(least(y2, b), t) AS yb FROM e WHERE y1 <> y2),
 u AS (SELECT *, x1 + (x2 - x1) * (ya - y1) / (y2 - y1) - l AS ua, x1 + (x2 - x1) * (yb - y1) / (y2 - y1) - l AS ub FROM c),
 h AS (SELECT *, CASE WHEN ua <= 0 THEN 0 WHEN ua <= w THEN ua * ua / 2 ELSE w * ua - w * w / 2 END AS ha, CASE WHEN ub <= 0 THEN 0 WHEN ub <= w THEN ub * ub / 2 ELSE w * ub - w * w / 2 END AS hb FROM u)
 SELECT vec_id AS ord, round(sum(CASE WHEN ua = ub THEN greatest(least(ua, w), 0) ELSE (hb - ha) / (ub - ua) END * (yb - ya)) * min(s) * min(s), 2) AS area FROM h GROUP BY 1
 HAVING abs(sum(CASE WHEN ua = ub THEN greatest(least(ua, w), 0) ELSE (hb - ha) / (ub - ua) END * (yb - ya))) > 1e-3""")
def draw_rings(spark, sf_dir):
    """Rings cut to the tile: their areas are those of the part within the window."""
    got = drawlist.draw_list(shape_features(spark, sf_dir, "Polygon", 3), read_theme(SHAPES), 11.5, shape_view()).where("kind = 'fill'")
    area = got.select("ord", geometry.ring_area(F.get("parts", F.lit(0))).alias("area")).where("abs(area) > 0.00025")
    return area.select("ord", F.round("area", 2).alias("area"))


@query(f"""WITH {PTS}, c AS (SELECT event_id AS ord, unnest([px % 256, px % 256 + 300, px % 256])::DOUBLE AS cx, unnest([py % 256, py % 256, py % 256 - 40])::DOUBLE AS cy FROM pts WHERE event_type <> 'click' AND value > 50)
 SELECT * FROM c WHERE cx BETWEEN -4 AND 260 AND cy BETWEEN -4 AND 260""")
def draw_circles(spark, sf_dir):
    """Features of three points each: a row for each centre that a circle of 3 pixels and a stroke of 1 can show of."""
    f = event_features(spark, sf_dir)
    x, y = F.col("minx"), F.col("miny")
    f = f.withColumn("parts", F.array(*[F.array(a.cast("float"), b.cast("float")) for a, b in ((x, y), (x + 300, y), (x, y - 40))])).withColumn("maxx", x + 300).withColumn("miny", y - 40)
    got = drawlist.draw_list(f, read_theme(THEME), 8.0, event_view()).where("layer = 'big'")
    return got.select("ord", F.get(F.get("parts", F.lit(0)), F.lit(0)).alias("cx"), F.get(F.get("parts", F.lit(0)), F.lit(1)).alias("cy"))


@query(f"""WITH {PTS} SELECT DISTINCT x, y, round(0.1 + 0.8 * 0.625, 6) AS opacity, (x % 4) * 128.0::DOUBLE AS l, (y % 4) * 96.0::DOUBLE AS t, (x % 4 + 1) * 128.0::DOUBLE AS r, (y % 4 + 1) * 96.0::DOUBLE AS b FROM pts""")
def draw_rasters(spark, sf_dir):
    """Display tiles of zoom 8 with images of zoom 6; at zoom 9.25 the photo layer's opacity is on its way, and at its colours."""
    tiles = pts(spark, sf_dir).select("z", "x", "y").distinct()
    images = tiles.select(F.lit("photos").alias("source"), F.lit(6).alias("z"), F.shiftright("x", 2).alias("x"), F.shiftright("y", 2).alias("y"), F.lit(512).alias("width"), F.lit(384).alias("height")).distinct()
    got = drawlist.rasters(joins.overzoom(joins.to_data_tiles(tiles, "photos", -2, 0, 6), images), read_theme(SHAPES), 9.25)
    return got.where("matrix is null").select("x", "y", r6(F.col("opacity")).alias("opacity"), "src.*")


STAMPS: dict[str, Any] = {
    "version": 8, "name": "stamps",
    "layers": [
        {"id": "rails", "type": "line", "source": "shapes", "source-layer": "lines", "filter": ["<", ["get", "label"], 8], "paint": {"line-pattern": "rail", "line-width": 8}},
        {"id": "woods", "type": "fill", "source": "shapes", "source-layer": "lines", "filter": [">=", ["get", "label"], 3], "paint": {"fill-pattern": "tree", "fill-opacity": 0.5}},
    ],
}
SHEET = [("rail", 0, 0, 64, 8, 1.0, False), ("tree", 64, 0, 96, 80, 2.0, False), ("star", 0, 16, 24, 24, 2.0, True)]


def sheet(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SHEET, "name string, x int, y int, width int, height int, pixel_ratio double, sdf boolean")


def _cut_sql(zooms: int) -> str:
    """d: each line's segments with the part t0 .. t1 of them that lies in the window."""
    return f"""{_shape_sql(zooms)}, g AS (SELECT w.*, i, x1, y1, x2, y2, len, sum(len) OVER (PARTITION BY vec_id ORDER BY i) - len AS done FROM w JOIN seg USING (vec_id, label)),
 d AS (SELECT *, greatest(0.0, CASE WHEN x2 > x1 THEN (l-x1)/(x2-x1) WHEN x2 < x1 THEN (r-x1)/(x2-x1) ELSE 0 END, CASE WHEN y2 > y1 THEN (t-y1)/(y2-y1) WHEN y2 < y1 THEN (b-y1)/(y2-y1) ELSE 0 END) AS t0,
 least(1.0, CASE WHEN x2 > x1 THEN (r-x1)/(x2-x1) WHEN x2 < x1 THEN (l-x1)/(x2-x1) ELSE 1 END, CASE WHEN y2 > y1 THEN (b-y1)/(y2-y1) WHEN y2 < y1 THEN (t-y1)/(y2-y1) ELSE 1 END) AS t1 FROM g
 WHERE NOT (x1 = x2 AND (x1 < l OR x1 > r)) AND NOT (y1 = y2 AND (y1 < t OR y1 > b)))"""


@query(f"""WITH {_cut_sql(3)}, k AS (SELECT *, unnest(range(ceil(((done + t0 * len) * s - 32) / 64)::BIGINT, ceil(((done + t1 * len) * s - 32) / 64)::BIGINT)) * 64 + 32 AS far FROM d WHERE t0 < t1 AND label < 8)
 SELECT vec_id AS ord, far, round((x1 + (x2 - x1) * (far / s - done) / len) * s + ox, 3) + 0.0 AS at_x, round((y1 + (y2 - y1) * (far / s - done) / len) * s + oy, 3) + 0.0 AS at_y, round(atan2(y2 - y1, x2 - x1), 4) + 0.0 AS angle FROM k""")
def draw_stamps(spark, sf_dir):
    """Sprites along lines that are cut to their tiles, three zooms over the data; ``far`` is how far along the whole line."""
    drawn = drawlist.draw_list(shape_features(spark, sf_dir, "LineString", 3), read_theme(STAMPS), 11.5, shape_view(), frozenset({"rail", "tree"}))
    got = stamps.line_stamps(drawn, sheet(spark))
    at = F.ceil(F.round((F.col("start") - 32) / 64, 9)) * 64 + 32 + F.col("stamp") * 64
    r3 = lambda c: F.round(c, 3) + 0.0
    return got.select("ord", at.cast("bigint").alias("far"), r3("at_x").alias("at_x"), r3("at_y").alias("at_y"), (F.round("angle", 4) + 0.0).alias("angle"))


@query(f"""WITH {_shape_sql(1)}, e AS (SELECT vec_id, -((2 * (vec_id % 256) + vec_id % 2) * 256 % 48) AS tx, -((2 * (vec_id // 256 % 256) + vec_id // 2 % 2) * 256 % 40) AS ty, list_min([p[2*i+1] for i in range(len(p)//2)]) * s + ox AS l, list_max([p[2*i+1] for i in range(len(p)//2)]) * s + ox AS r,
 list_min([p[2*i+2] for i in range(len(p)//2)]) * s + oy AS t, list_max([p[2*i+2] for i in range(len(p)//2)]) * s + oy AS b FROM w WHERE label >= 3),
 i AS (SELECT *, unnest(range(floor((l - tx) / 48)::BIGINT, floor((r - tx) / 48)::BIGINT + 1)) AS i FROM e), j AS (SELECT *, unnest(range(floor((t - ty) / 40)::BIGINT, floor((b - ty) / 40)::BIGINT + 1)) AS j FROM i)
 SELECT vec_id AS ord, i, j, (tx + i * 48)::DOUBLE AS left_px, (ty + j * 40)::DOUBLE AS top_px FROM j""")
def draw_patterns(spark, sf_dir):
    """Cells of a pattern of 48 x 40 pixels over areas; they run on from tile to tile."""
    drawn = drawlist.draw_list(shape_features(spark, sf_dir, "Polygon", 1), read_theme(STAMPS), 9.5, shape_view(), frozenset({"rail", "tree"}))
    got = stamps.pattern_cells(drawn, sheet(spark))
    return got.select("ord", "i", "j", F.col("left").alias("left_px"), F.col("top").alias("top_px"))


@query(f"""WITH {PTS}, e AS (SELECT event_id, k, CASE WHEN event_type IN ('click', 'view') THEN 'star' WHEN event_type = 'purchase' THEN 'tree' END AS icon, 1 + k % 3 AS size, (k % 5) / 4.0::DOUBLE AS opacity, event_type = 'view' AND k % 2 = 0 AS halo FROM pts),
 s AS (SELECT event_id, icon, least(greatest(8 * size / 2.0::DOUBLE, 4), 128) AS slope, unnest(CASE WHEN icon = 'tree' THEN [struct_pack(turn := 1, edge := NULL::DOUBLE, alpha := opacity)] WHEN halo THEN
 [struct_pack(turn := 0, edge := least(greatest((6 - 2.0::DOUBLE / size) / 8, 0), 0.75), alpha := opacity * 0.5), struct_pack(turn := 1, edge := 0.75::DOUBLE, alpha := opacity)] ELSE [struct_pack(turn := 1, edge := 0.75::DOUBLE, alpha := opacity)] END) AS m FROM e WHERE icon IS NOT NULL AND opacity > 0)
 SELECT event_id, m.turn AS turn, round(m.alpha, 6) AS alpha, CASE WHEN icon = 'tree' THEN NULL ELSE CASE WHEN m.turn = 0 THEN 0.0 ELSE 255.0 END END::DOUBLE AS red, CASE WHEN icon <> 'tree' THEN slope END AS slope, round((0.5 - m.edge * slope) * 255, 6) + 0.0 AS shift FROM s""")
def draw_icons(spark, sf_dir):
    """Red stars of a distance field, those of views with a halo, and plain trees: a row for each image that is drawn."""
    p, k = pts(spark, sf_dir), F.col("k")
    icon = F.when(F.col("event_type").isin("click", "view"), "star").when(F.col("event_type") == "purchase", "tree")
    tint = lambda a, r: F.struct(F.lit(a).alias("a"), F.lit(r).alias("r"), F.lit(0.0).alias("g"), F.lit(0.0).alias("b"))
    x, y, size = F.col("px").cast("double"), F.col("py").cast("double"), (1 + k % 3).cast("double")
    rect = F.struct(x.alias("l"), y.alias("t"), (x + 12 * size).alias("r"), (y + 12 * size).alias("b"))
    halo = F.when((F.col("event_type") == "view") & (k % 2 == 0), tint(0.5, 0.0))
    icons = p.select("event_id", icon.alias("icon"), rect.alias("rect"), size.alias("icon_size"), ((k % 5) / 4.0).alias("icon_opacity"), tint(1.0, 1.0).alias("icon_color"), halo.alias("icon_halo_color"), F.lit(2.0).alias("icon_halo_width"))
    got = stamps.icon_rows(icons, sheet(spark))
    m = lambda i: F.get("matrix", F.lit(i))
    return got.select("event_id", "turn", F.round("alpha", 6).alias("alpha"), m(4).alias("red"), m(18).alias("slope"), (F.round(m(19), 6) + 0.0).alias("shift"))


@query(f"""WITH {PTS}, t AS (SELECT DISTINCT x, y FROM pts), d AS (SELECT 'background' AS kind, 0 AS stage, x % 2 AS a, 8 AS b, y AS c, x AS e, 0 AS f, -1::BIGINT AS ord FROM t UNION ALL
 SELECT 'circle', 0, x % 2, 8, y, x, CASE WHEN event_type = 'click' THEN 1 ELSE 2 END, event_id FROM pts WHERE event_type = 'click' OR value > 50 UNION ALL
 SELECT 'label', 1, CASE WHEN k % 9 = 8 THEN 0 ELSE 1 + k % 9 END, 4, 0, 0, 0, event_id FROM pts WHERE k >= 50)
 SELECT kind, ord, row_number() OVER (ORDER BY stage, a, b, c, e, f, ord)::BIGINT AS turn, CASE WHEN kind = 'background' THEN e END AS x, CASE WHEN kind = 'background' THEN c END AS y FROM d""")
def draw_order(spark, sf_dir):
    """One order of backgrounds and circles, retained tiles (here those of even columns) first, and of labels over all."""
    f, theme = event_features(spark, sf_dir), read_theme(THEME)
    circles = drawlist.draw_list(f, theme, 8.0, event_view())
    grounds = drawlist.backgrounds(f.select("z", "x", "y").distinct(), theme, 8.0)
    slim = ["z", "x", "y", "layer_index", "kind", "ord"]
    tiles = stamps.tile_draws(circles.select(*slim).unionByName(grounds.select("z", "x", "y", "layer_index", F.lit("background").alias("kind"), "ord")), F.col("x") % 2)
    names = symbols.candidates(f, theme, 8.0, event_view(), extra=("k",)).select("z", "x", "y", "layer_index", F.lit("label").alias("kind"), "ord", ((F.col("k") % 9) / 8.0).alias("opacity"))
    labels_ = stamps.label_draws(names, F.col("opacity")).drop("opacity")
    got = stamps.draw_turns(tiles.unionByName(labels_))
    ground = lambda c: F.when(F.col("kind") == "background", F.col(c)).alias(c)
    return got.select("kind", "ord", "turn", ground("x"), ground("y"))


@query(f"""WITH {PTS} SELECT DISTINCT x, y, (191::BIGINT << 24) + 2113632 AS argb, -4.0::DOUBLE AS edge FROM pts""")
def draw_backgrounds(spark, sf_dir):
    tiles = pts(spark, sf_dir).select("z", "x", "y").distinct()
    got = drawlist.backgrounds(tiles, read_theme(SHAPES), 9.5)
    return got.select("x", "y", "argb", F.get(F.get("parts", F.lit(0)), F.lit(0)).alias("edge"))


@query(f"""WITH {PTS} SELECT event_id AS ord, upper(event_type || ' ' || k) AS text, k::DOUBLE AS sort_key, (px % 256)::DOUBLE AS anchor_x, (py % 256)::DOUBLE AS anchor_y FROM pts WHERE k >= 50""")
def symbol_candidates(spark, sf_dir):
    got = symbols.candidates(event_features(spark, sf_dir), read_theme(THEME), 8.0, event_view())
    return got.select("ord", "text", "sort_key", "anchor_x", "anchor_y")


@query(f"""WITH {PTS} SELECT event_id, row_number() OVER (PARTITION BY x, y ORDER BY k % 3 DESC, value, py, event_id)::BIGINT AS rank FROM pts""")
def placement_priority(spark, sf_dir):
    c = pts(spark, sf_dir).select("event_id", "x", "y", (F.col("k") % 3).alias("layer_index"), F.col("value").alias("sort_key"), F.col("py").alias("screen_y"), F.col("event_id").alias("ord"))
    return symbols.with_priority(c, ["x", "y"]).select("event_id", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {PTS}, z AS (SELECT event_id, 10 + (k % 41) / 8.0::DOUBLE AS zoom, 10.0::DOUBLE + k % 4 AS lo, CASE WHEN k % 5 = 0 THEN 24.0 ELSE 14.0 END::DOUBLE AS hi FROM pts)
 SELECT event_id, CASE WHEN hi >= 24 THEN 1.0 ELSE floor(least(greatest((hi - zoom) / least(0.25, hi - lo), 0), 1) * 8) / 8 END::DOUBLE AS band,
 CASE WHEN zoom - 11 <= 0 THEN 0.0 ELSE greatest(1.0, round((zoom - 11) / 5 * 8)) / 8 END::DOUBLE AS shown FROM z""")
def zoom_opacity(spark, sf_dir):
    p = pts(spark, sf_dir)
    zoom = F.lit(10.0) + (F.col("k") % 41) / F.lit(8.0)
    lo, hi = F.lit(10.0) + F.col("k") % 4, F.when(F.col("k") % 5 == 0, F.lit(24.0)).otherwise(F.lit(14.0))
    return p.select("event_id", symbols.band_opacity(zoom, lo, hi).alias("band"), symbols.opacity_step((zoom - 11) / 5).alias("shown"))


@query(f"""WITH RECURSIVE {PTS}, c AS (SELECT event_id AS ord, x, y, upper(event_type || ' ' || k) AS text, px % 256 AS ax, py % 256 AS ay, k FROM pts WHERE k >= 50),
 b AS (SELECT ord, x, y, text, row_number() OVER (PARTITION BY x, y ORDER BY k, ay, ord) AS n, struct_pack(l := ax - length(text) * 3.0::DOUBLE - 2, t := ay - 12 * 1.15::DOUBLE / 2 - 2, r := ax + length(text) * 3.0::DOUBLE + 2, b := ay + 12 * 1.15::DOUBLE / 2 + 2) AS b FROM c),
 r AS (SELECT ord, x, y, text, n, true AS placed, [b] AS claimed FROM b WHERE n = 1 UNION ALL
 SELECT ord, x, y, text, n, free, CASE WHEN free THEN list_append(claimed, b) ELSE claimed END FROM (SELECT c.*, r.claimed, len(list_filter(r.claimed, lambda o: c.b.l < o.r AND o.l < c.b.r AND c.b.t < o.b AND o.t < c.b.b)) = 0 AS free FROM r JOIN b c ON c.x = r.x AND c.y = r.y AND c.n = r.n + 1))
 SELECT ord, text, placed, CASE WHEN placed THEN 'center' END AS anchor FROM r""")
def collision_greedy(spark, sf_dir):
    """Greedy placement on each tile; every choice depends on all earlier ones of its screen."""
    c = symbols.candidates(event_features(spark, sf_dir), read_theme(THEME), 8.0, event_view())
    c = symbols.boxes(c.withColumn("screen_x", F.col("anchor_x")).withColumn("screen_y", F.col("anchor_y")))
    c = symbols.with_priority(c, ["x", "y"]).withColumn("icon_box", F.lit(None).cast("struct<l:double,t:double,r:double,b:double>"))
    c = c.select("x", "y", "ord", "text", "rank", "text_boxes", "icon_box", F.col("text_allow_overlap").alias("allow_overlap"), "text_optional")
    return symbols.place(c, ["x", "y"], ["rank"]).select("ord", "text", "placed", "anchor")


_TEXT = {"text-field": "{event_type} {event_type} number {k}", "text-size": 96, "text-max-width": 8}
_OF = {"source": "events", "source-layer": "pts"}
LABELS: dict[str, Any] = {
    "version": 8, "name": "labels",
    "layers": [
        {"id": "clicks", "type": "symbol", **_OF, "filter": ["==", "event_type", "click"], "layout": _TEXT | {"text-variable-anchor": ["center", "top", "left"], "text-radial-offset": 1, "symbol-sort-key": ["get", "k"]}},
        {"id": "pins", "type": "symbol", **_OF, "filter": ["==", "event_type", "view"], "layout": {"icon-image": "pin", "icon-size": 4}},
        {"id": "shops", "type": "symbol", **_OF, "filter": ["==", "event_type", "purchase"], "layout": _TEXT | {"icon-image": "pin", "icon-size": 4, "text-anchor": "left", "text-offset": [1, 0], "text-optional": True}},
        {"id": "ways", "type": "symbol", **_OF, "filter": ["==", "event_type", "signup"], "layout": {"text-field": "{event_type}", "text-size": 96}},
    ],
}


@query(f"""WITH RECURSIVE {PTS}, e AS (SELECT event_id AS ord, event_type AS kind, px >> 12 AS sx, py >> 12 AS sy, (px % 4096)::DOUBLE AS x, (py % 4096)::DOUBLE AS y, k, [event_type, event_type, 'number', k::VARCHAR] AS ws FROM pts),
 w AS (SELECT ord, ws, 1 AS i, ws[1] AS now, 0 AS longest, 1 AS n FROM e UNION ALL SELECT ord, ws, i + 1, CASE WHEN fits THEN now || ' ' || ws[i + 1] ELSE ws[i + 1] END, CASE WHEN fits THEN longest ELSE greatest(longest, length(now)) END,
 CASE WHEN fits THEN n ELSE n + 1 END FROM (SELECT *, length(now) + 1 + length(ws[i + 1]) <= 16 AS fits FROM w WHERE i < 4)),
 m AS (SELECT e.*, greatest(longest, length(now)) * 48.0::DOUBLE AS w, n * 96 * 1.15::DOUBLE AS h, struct_pack(l := x - 66, t := y - 50, r := x + 66, b := y + 50) AS icon FROM e JOIN w USING (ord) WHERE i = 4),
 o AS (SELECT ord, kind, sx, sy, row_number() OVER (PARTITION BY sx, sy ORDER BY CASE kind WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END, CASE WHEN kind = 'click' THEN k ELSE 0 END, y, ord) AS n,
 CASE kind WHEN 'click' THEN [struct_pack(a := 'center', d := false, bs := [struct_pack(l := x - w / 2 - 2, t := y - h / 2 - 2, r := x + w / 2 + 2, b := y + h / 2 + 2)]), struct_pack(a := 'top', d := false, bs := [struct_pack(l := x - w / 2 - 2, t := y + 94, r := x + w / 2 + 2, b := y + 96 + h + 2)]),
  struct_pack(a := 'left', d := false, bs := [struct_pack(l := x + 94, t := y - h / 2 - 2, r := x + 96 + w + 2, b := y + h / 2 + 2)])]
 WHEN 'view' THEN [struct_pack(a := NULL::VARCHAR, d := false, bs := [icon])]
 WHEN 'purchase' THEN [struct_pack(a := 'left', d := false, bs := [struct_pack(l := x + 94, t := y - h / 2 - 2, r := x + 96 + w + 2, b := y + h / 2 + 2), icon]), struct_pack(a := NULL::VARCHAR, d := true, bs := [icon])]
 ELSE [struct_pack(a := 'center', d := false, bs := [struct_pack(l := x - 146, t := y - 96 * 1.15::DOUBLE / 2 - 2, r := x + 146, b := y + 96 * 1.15::DOUBLE / 2 + 2)])] END AS opts FROM m WHERE kind <> 'error'),
 r AS (SELECT sx, sy, 0::BIGINT AS n, NULL::BIGINT AS ord, NULL::VARCHAR AS kind, NULL::STRUCT(a VARCHAR, d BOOLEAN, bs STRUCT(l DOUBLE, t DOUBLE, r DOUBLE, b DOUBLE)[]) AS pick, []::STRUCT(l DOUBLE, t DOUBLE, r DOUBLE, b DOUBLE)[] AS claimed FROM o WHERE n = 1 UNION ALL
 SELECT sx, sy, n, ord, kind, pick, CASE WHEN pick IS NULL THEN claimed ELSE list_concat(claimed, pick.bs) END FROM (SELECT o.sx, o.sy, o.n, o.ord, o.kind, r.claimed,
 list_filter(o.opts, lambda q: len(list_filter(q.bs, lambda b: len(list_filter(r.claimed, lambda c: b.l < c.r AND c.l < b.r AND b.t < c.b AND c.t < b.b)) > 0)) = 0)[1] AS pick FROM r JOIN o ON o.sx = r.sx AND o.sy = r.sy AND o.n = r.n + 1))
 SELECT ord, kind, pick IS NOT NULL AS placed, pick.a AS anchor, coalesce(pick.d, false) AS text_dropped FROM r WHERE n > 0 UNION ALL SELECT ord, kind, true, 'top', false FROM e WHERE kind = 'error'""")
def label_placement(spark, sf_dir):
    """One placement of texts with three anchors, icons, both together, labels along lines, and ghosts, on screens of 16 x 16 tiles."""
    f = event_features(spark, sf_dir)
    c = symbols.candidates(f.where("event_type <> 'error'"), read_theme(LABELS), 8.0, event_view(), extra=("event_type", "px", "py"))
    at = lambda c: (F.col(c) % 4096).cast("double")
    c = c.select("*", F.shiftright("px", 12).alias("sx"), F.shiftright("py", 12).alias("sy"), at("px").alias("screen_x"), at("py").alias("screen_y"))
    pin = spark.createDataFrame([("pin", 64, 48, 2.0)], "name string, width int, height int, pixel_ratio double")
    c = symbols.placeable(c.withColumn("layer_index", -F.col("layer_index")), pin)
    way = F.array(F.col("screen_x") - 200, F.col("screen_y"), F.col("screen_x") + 200, F.col("screen_y"))
    ways = symbols.along_lines(c.where("event_type = 'signup'").withColumn("path", way).withColumn("path_distance", F.lit(200.0)))
    shown = ("ord", F.col("event_type").alias("kind"), "sx", "sy", "layer_index", "sort_key", "screen_y", "text_boxes", "icon_box", "allow_overlap", "text_optional")
    none = F.lit(None).cast(ways.schema["glyph_boxes"].dataType)
    rows = ways.select(*shown, "glyph_boxes").unionByName(c.where("event_type <> 'signup'").select(*shown, none.alias("glyph_boxes")))
    rows = rows.withColumn("ghost", F.lit(False)).withColumn("sat", F.lit(None).cast("string"))
    gone = f.where("event_type = 'error'").select("ord", F.col("event_type").alias("kind"), F.shiftright("px", 12).alias("sx"), F.shiftright("py", 12).alias("sy"), F.lit(-9).alias("layer_index"), F.lit(True).alias("ghost"), F.lit("top").alias("sat"))
    rows = rows.unionByName(gone, allowMissingColumns=True)
    ranked = symbols.with_priority(rows, ["sx", "sy"])
    return symbols.place(ranked, ["sx", "sy"], ["rank"], remembered="sat").select("ord", "kind", "placed", "anchor", "text_dropped")


@query("""WITH RECURSIVE t AS (SELECT page_id, greatest(5 + page_id % 20, 4) * 2 AS room, list_filter(str_split_regex(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\r\n]+'), lambda w: w <> '')[:40] AS ws FROM pages),
 p AS (SELECT page_id, room, row_number() OVER (PARTITION BY page_id ORDER BY i, j) AS n, substr(ws[i], j * room + 1, room) AS w FROM t, unnest(range(1, len(ws) + 1)) AS a(i), unnest(range(0, (length(ws[i]) - 1) // room + 1)) AS b(j)),
 r AS (SELECT page_id, n, 1 AS line, w AS now, false AS ends, w AS was FROM p WHERE n = 1 UNION ALL
 SELECT p.page_id, p.n, CASE WHEN length(r.now) + 1 + length(w) <= room THEN line ELSE line + 1 END, CASE WHEN length(r.now) + 1 + length(w) <= room THEN r.now || ' ' || w ELSE w END, length(r.now) + 1 + length(w) > room, r.now FROM r JOIN p ON p.page_id = r.page_id AND p.n = r.n + 1)
 SELECT page_id, line, max_by(now, n) AS words FROM r WHERE line <= 4 GROUP BY 1, 2""")
def label_lines(spark, sf_dir):
    """The first 40 words of each page as a label of at most four lines."""
    p = table(spark, sf_dir, "pages")
    text = F.array_join(F.slice(F.filter(F.split(F.regexp_replace("html", "<[^>]*>", " "), "[ \\t\\r\\n]+"), lambda w: w != ""), 1, 40), " ")
    lines = p.select("page_id", F.posexplode(symbols.wrapped(text, (5 + F.col("page_id") % 20).cast("double"))).alias("i", "words"))
    return lines.select("page_id", (F.col("i") + 1).alias("line"), "words")


@query(f"""WITH {PTS} SELECT (k % 9) / 8.0::DOUBLE AS opacity, count(*) AS n, min(px)::DOUBLE AS l, min(py)::DOUBLE AS t, max(px)::DOUBLE AS r, max(py)::DOUBLE AS b FROM pts GROUP BY 1""")
def opacity_buckets(spark, sf_dir):
    p = pts(spark, sf_dir)
    d = p.select(((F.col("k") % 9) / F.lit(8.0)).alias("opacity"), *[F.col(c).cast("double").alias(n) for c, n in (("px", "l"), ("py", "t"), ("px", "r"), ("py", "b"))])
    return symbols.opacity_buckets(d)


@query(f"""WITH {PTS}, w AS (SELECT event_id, event_type, x, min(event_id) OVER g AS first, min(CASE WHEN k % 7 = 0 THEN event_id END) OVER g AS held FROM pts WINDOW g AS (PARTITION BY event_type, x))
 SELECT event_id, CASE WHEN held IS NULL THEN event_id WHEN event_id = first THEN held WHEN event_id = held THEN first ELSE event_id END AS place FROM w""")
def incumbent_promotion(spark, sf_dir):
    p = pts(spark, sf_dir).withColumn("shown", F.col("k") % 7 == 0)
    return symbols.promote_incumbents(p, ["event_type", "x"], "event_id", "shown").select("event_id", "place")


@query(f"""WITH {PTS}, seen AS (SELECT event_id, user_id, px % 512 AS x, py % 512 AS y FROM pts WHERE k % 2 = 0), mem AS (SELECT event_id AS entry, user_id, px % 512 AS mx, py % 512 AS my FROM pts WHERE k % 2 = 1)
 SELECT event_id AS id, arg_min(entry, struct_pack(d := (x - mx) * (x - mx) + (y - my) * (y - my), e := entry)) AS entry FROM seen JOIN mem USING (user_id) WHERE (x - mx) * (x - mx) + (y - my) * (y - my) < 1024 GROUP BY 1""")
def nearest_memory(spark, sf_dir):
    p = pts(spark, sf_dir)
    seen = p.where("k % 2 = 0").select(F.col("event_id").alias("id"), "user_id", (F.col("px") % 512).alias("x"), (F.col("py") % 512).alias("y"))
    mem = p.where("k % 2 = 1").select(F.col("event_id").alias("entry"), "user_id", (F.col("px") % 512).alias("mx"), (F.col("py") % 512).alias("my"))
    return joins.nearest(seen, mem, ["user_id"]).select("id", "entry")


FONTS = ("Noto Sans", "Open Sans Semibold Italic", "Roboto Light", "Arial Black", "Noto Extra Bold", "Inter Medium", "Inter ExtraBold", "Lato Semi Bold", "Lato Bold Italic", "Lato Thin", "Noto Extra-Light", "Noto Semi-Bold")


@query(f"""SELECT p_partkey, CASE WHEN s LIKE '%extrabold%' OR s LIKE '%extra bold%' THEN 800 WHEN s LIKE '%semibold%' OR s LIKE '%semi bold%' THEN 600 WHEN s LIKE '%bold%' THEN 700 WHEN s LIKE '%medium%' THEN 500
 WHEN s LIKE '%light%' THEN 300 WHEN s LIKE '%thin%' THEN 200 ELSE 400 END::BIGINT AS weight, contains(s, 'italic') AS slanted FROM (SELECT p_partkey, lower({list(FONTS)!r}[(p_partkey % {len(FONTS)}) + 1]) AS s FROM part)""")
def font_weights(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    name = F.get(F.array(*map(F.lit, FONTS)), (F.col("p_partkey") % len(FONTS)).cast("int"))
    return p.select("p_partkey", symbols.font_weight(name).cast("long").alias("weight"), symbols.italic(name).alias("slanted"))


@query("""SELECT doc_id, NOT regexp_matches(text, '[\\x{0590}-\\x{08FF}\\x{0900}-\\x{0DFF}\\x{0E00}-\\x{0FFF}\\x{1000}-\\x{109F}\\x{1780}-\\x{17FF}\\x{1820}-\\x{1BEF}\\x{FB1D}-\\x{FDFF}\\x{FE70}-\\x{FEFF}]') AS safe,
 least(length(text) * 6.0, 120.0)::DOUBLE AS w, least(4.0, greatest(1.0, ceil(length(text) * 6.0 / 120.0))) * 12 * 1.15::DOUBLE AS h FROM documents""")
def label_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    w, h = symbols.rough_box(F.col("text"), F.lit(12.0), F.lit(10.0))
    return d.select("doc_id", symbols.curve_safe(F.col("text")).alias("safe"), w.alias("w"), h.alias("h"))


# -- sources, caches, state -------------------------------------------------------------------------------------


@query(f"""WITH {PTS} SELECT x, y, nullif(event_id, 0) AS fid, (px % 256 * 16)::DOUBLE AS gx, (py % 256 * 16)::DOUBLE AS gy, event_type AS kind, k AS rank FROM pts""")
def mvt_round_trip(spark, sf_dir):
    """Tiles are encoded from the events and decoded again; an id of 0 is none."""
    p = pts(spark, sf_dir)

    def encode(rows):
        body = [(1, mvt.commands_of(1, [[(int(r["px"] % 256 * 16), int(r["py"] % 256 * 16))]]), {"kind": r["event_type"], "rank": int(r["k"]), "spare": 1.5}, int(r["event_id"])) for r in rows]
        yield "events", 8, int(rows[0]["x"]), int(rows[0]["y"]), mvt.encode_tile(mvt.encode_layer("pts", body))

    slim = p.select("x", "y", "px", "py", "event_id", "event_type", "k")
    tiles = fold(slim, ["x", "y"], ["event_id"], encode, "source string, z int, x bigint, y bigint, bytes binary")
    f = mvt.decode_tiles(tiles, {"pts": {"kind", "rank"}})
    one = F.get("parts", F.lit(0))
    return f.select("x", "y", "fid", F.get(one, F.lit(0)).cast("double").alias("gx"), F.get(one, F.lit(1)).cast("double").alias("gy"), F.col("properties")["kind"]["s"].alias("kind"), F.col("properties")["rank"]["l"].alias("rank"))


@query(f"""WITH {PTS}, ids AS (SELECT DISTINCT y * 256 + x AS tile_id FROM pts), e AS (SELECT DISTINCT (y * 256 + x) // 8 * 8 AS first, 1 + ((y * 256 + x) // 8) % 8 AS run FROM pts)
 SELECT tile_id, first, run FROM ids JOIN e ON tile_id >= first AND tile_id < first + run""")
def pmtiles_lookup(spark, sf_dir):
    p = pts(spark, sf_dir)
    tile = F.col("y") * 256 + F.col("x")
    block = F.floor(tile / 8)
    entries = p.select((block * 8).alias("first"), (block % 8 + 1).alias("run")).distinct()
    return pmtiles.lookup(p.select(tile.alias("tile_id")).distinct(), entries).select("tile_id", "first", "run")


ODD: dict[str, Any] = {
    "version": 8, "name": "odd",
    "layers": [
        {"id": "hills", "type": "hillshade", "source": "dem"}, {"id": "heat", "type": "heatmap", "source": "s"}, {"id": "off", "type": "line", "source": "s", "source-layer": "l", "layout": {"visibility": "none"}},
        {"id": "loose", "type": "fill"}, {"id": "new", "type": "hologram", "source": "s"}, {"id": "ok", "type": "circle", "source": "s", "source-layer": "l", "paint": {"circle-radius": ["elevation"]}},
        {"id": "too", "type": "line", "source": "s", "source-layer": "l", "filter": ["all", ["==", ["elevation"], 1]]},
    ],
}


@query(f"""WITH {PTS}, t AS (SELECT CASE WHEN event_type = 'error' THEN CASE WHEN k < 30 THEN 'status 503' WHEN k < 60 THEN 'timed out' ELSE 'unknown' END END AS reason FROM pts)
 SELECT 'tile' AS kind, reason, count(*) AS n FROM t WHERE reason IS NOT NULL GROUP BY 2 UNION ALL
 SELECT * FROM (VALUES ('layer', 'type hillshade is not drawn', 1), ('layer', 'type heatmap is not drawn', 1), ('layer', 'not visible', 1), ('layer', 'no source', 1), ('style', 'unknown type hologram', 1), ('expression', 'not supported: operator elevation', 2)) v(kind, reason, n)""")
def problem_counts(spark, sf_dir):
    """What a style leaves out and which tiles failed, counted by reason."""
    k = F.col("k")
    failed = F.when(k < 30, "status 503").when(k < 60, "timed out")
    tiles = pts(spark, sf_dir).select("event_id", F.when(F.col("event_type") == "error", "error").otherwise("data").alias("status"), failed.alias("error"))
    return problems.counted(problems.style_problems(spark, ODD).unionByName(problems.tile_problems(tiles, F.col("event_id"))))


@query(f"""WITH {PTS}, t AS (SELECT r.z, (px << r.z) >> 16 AS x, (py << r.z) >> 16 AS y, count(*) AS n FROM pts, (SELECT unnest(range(0, 7)) AS z) r GROUP BY ALL)
 SELECT z::int AS z, x, y, n FROM t WHERE z >= 3 AND x BETWEEN 5 AND 20 AND y < 11""")
def pmtiles_window(spark, sf_dir):
    """Counts of events by tile of the zooms 0 to 6, at most 5,461, as an archive, and a window of it by pushed filters."""
    p = pts(spark, sf_dir).select(F.explode(F.sequence(F.lit(0), F.lit(6))).alias("z"), "px", "py")
    at = lambda c: F.expr(f"shiftright({c} << z, 16)").alias(c[1])
    counts = p.select("z", at("px"), at("py")).groupBy("z", "x", "y").count()
    archive = pmtiles.build_archive({(r.z, r.x, r.y): str(r["count"]).encode() for r in counts.collect()} or {(0, 0, 0): b""}, leaf_size=64, compress=True)
    tiles = pmtiles.read_archive(spark, None, "events", 4, archive)
    return tiles.where((F.col("z") >= 3) & F.col("x").between(5, 20) & (F.col("y") < 11)).select("z", "x", "y", F.col("bytes").cast("string").cast("bigint").alias("n"))


@query("""SELECT source, doc_id FROM (SELECT source, doc_id, sum(n_chars) OVER w AS s, row_number() OVER w AS r FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING)) WHERE (s <= 60000 OR r <= 1) AND r <= 40""")
def lru_budget(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return cache.within_budget(d, ["source"], "doc_id", "n_chars", 60000, 40).select("source", "doc_id")


@query("""SELECT source, doc_id FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) AS s FROM documents) WHERE s <= 50000""")
def disk_sweep(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return cache.after_sweep(d, ["source"], ["doc_id"], "n_chars", 50000).select("source", "doc_id")


@query("""SELECT source, lang, doc_id FROM (SELECT source, lang, doc_id, sum(n_chars) OVER w AS s, row_number() OVER w AS r FROM documents WINDOW w AS (PARTITION BY source, lang ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING)) WHERE s <= 9000 OR r <= 2""")
def signature_trim(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "lang", "doc_id", "n_chars")
    return cache.within_budget(d, ["source", "lang"], "doc_id", "n_chars", 9000, always=2).select("source", "lang", "doc_id")


@query(f"""WITH {PTS} SELECT event_id, CASE WHEN k % 11 = 0 THEN 'miss' WHEN k % 7 = 0 THEN CASE WHEN k <= 40 THEN 'absent_fresh' ELSE 'absent_stale' END WHEN k <= 40 THEN 'fresh' ELSE 'stale' END AS status FROM pts""")
def cache_status(spark, sf_dir):
    p = pts(spark, sf_dir)
    return p.select("event_id", labels.load_status(F.col("k"), F.lit(40), F.col("k") % 11 != 0, F.col("k") % 7 == 0).alias("status"))


@query("""SELECT source, CASE WHEN bool_or(lang = 'es') THEN NULL ELSE list_aggregate(list_sort(list(DISTINCT lang)), 'string_agg', ',') END AS langs FROM documents GROUP BY 1""")
def property_union(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    reads = d.select("source", F.lit("text").alias("source_layer"), F.when(F.col("lang") != "es", F.array("lang")).alias("properties"))
    return joins.keep_lists(reads).select("source", F.array_join("properties", ",").alias("langs"))


@query("""WITH p AS (SELECT page_id, unnest(str_split(html, '<')) AS piece, generate_subscripts(str_split(html, '<'), 1) AS i FROM pages),
 t AS (SELECT page_id, i, split_part(piece, '>', 1) AS tag, substr(piece, length(split_part(piece, '>', 1)) + 2) AS shown FROM p WHERE i > 1),
 n AS (SELECT *, translate(tag, chr(9) || chr(10) || chr(13) || chr(34) || chr(39), '     ') AS flat FROM t),
 k AS (SELECT *, split_part(lower(flat), ' ', 1) IN ('a', '/a') AS anchor, strpos(lower(flat), ' href') AS k FROM n),
 h AS (SELECT *, CASE WHEN anchor AND left(tag, 1) <> '/' AND k > 0 AND left(ltrim(substr(tag, k + 5)), 1) = '=' THEN ltrim(substr(ltrim(substr(tag, k + 5)), 2)) END AS rest,
 sum(anchor::int) OVER (PARTITION BY page_id ORDER BY i) AS link FROM k),
 u AS (SELECT page_id, link, min(i) AS i, string_agg(' ' || shown, '' ORDER BY i) AS label,
 first(CASE left(rest, 1) WHEN chr(34) THEN split_part(substr(rest, 2), chr(34), 1) WHEN chr(39) THEN split_part(substr(rest, 2), chr(39), 1) ELSE split_part(rest, ' ', 1) END ORDER BY i) AS url FROM h WHERE link > 0 GROUP BY page_id, link)
 SELECT page_id, links FROM pages LEFT JOIN (SELECT page_id, string_agg(url, ' ' ORDER BY i) AS links FROM u WHERE url <> '' AND trim(replace(label, '&nbsp;', ' '), ' ' || chr(9) || chr(10) || chr(13)) <> '' GROUP BY 1) USING (page_id)""")
def attribution_links(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.nullif(F.array_join(style.attribution_links(F.col("html")), " "), F.lit("")).alias("links"))


@query("""SELECT page_id, regexp_replace(url || '?api_key=abc' || page_id || '&z=1', '((?:api_?key|access_token|token|key)=)[^&#]+', '\\1***', 'gi') AS redacted, 'https://t.example/8/' || page_id % 256 || '/' || page_id % 7 || '.pbf' AS tile FROM pages""")
def urls(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    secret = F.concat("url", F.lit("?api_key=abc"), F.col("page_id").cast("string"), F.lit("&z=1"))
    return p.select("page_id", style.redact_column(secret).alias("redacted"), style.tile_url(F.lit("https://t.example/{z}/{x}/{y}.pbf"), F.lit(8), F.col("page_id") % 256, F.col("page_id") % 7).alias("tile"))


@query("""SELECT doc_id, list_reduce(list_prepend(0::BIGINT, [doc_id, n_chars, doc_id % 17]), lambda h, p: (h * 31 + p) % 4294967296) AS hash FROM documents""")
def shape_hash(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", providers.shape_hash(F.array("doc_id", "n_chars", F.col("doc_id") % 17)).alias("hash"))


@query(f"""WITH {PTS}, top AS (SELECT x, max(user_id) AS g FROM pts GROUP BY 1) SELECT event_id FROM pts JOIN top ON pts.x = top.x AND pts.user_id = top.g""")
def latest_generation(spark, sf_dir):
    return labels.latest_generation(pts(spark, sf_dir), ["x"], "user_id").select("event_id")


@query(f"""WITH {PTS}, j AS (SELECT x AS tile, CASE WHEN k % 2 = 0 THEN 'raster' ELSE 'symbols' END AS phase, arg_max(k, event_id) AS priority, max(event_id) AS seq FROM pts GROUP BY 1, 2),
 r AS (SELECT tile, seq AS rseq FROM j WHERE phase = 'raster'), a AS (SELECT j.* FROM j LEFT JOIN r USING (tile) WHERE phase = 'raster' OR rseq IS NULL OR seq > rseq)
 SELECT tile, phase, row_number() OVER (ORDER BY phase <> 'raster', priority, seq)::BIGINT AS turn FROM a""")
def render_queue(spark, sf_dir):
    jobs = pts(spark, sf_dir).select(F.col("x").alias("tile"), F.when(F.col("k") % 2 == 0, F.lit("raster")).otherwise(F.lit("symbols")).alias("phase"), F.col("k").alias("priority"), F.col("event_id").alias("seq"))
    return labels.queue_order(jobs).select("tile", "phase", F.col("turn").cast("long").alias("turn"))


FADE_SQL = """WITH RECURSIVE f AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS dt FROM (SELECT DISTINCT conv_id, turn FROM conversations)),
 k AS (SELECT DISTINCT conv_id, role FROM conversations), s AS (SELECT DISTINCT conv_id, turn, role FROM conversations),
 g AS (SELECT f.conv_id, f.turn, f.n, k.role, s.role IS NOT NULL AS shown, CASE WHEN dt IS NULL THEN 1.0 ELSE least(greatest(dt / 4.0, 0), 1) END::DOUBLE AS step FROM f JOIN k USING (conv_id) LEFT JOIN s ON s.conv_id = f.conv_id AND s.turn = f.turn AND s.role = k.role),
 r AS (SELECT conv_id, role, n, turn, shown, CASE WHEN shown THEN 0.0 END::DOUBLE AS o FROM g WHERE n = 1
 UNION ALL SELECT g.conv_id, g.role, g.n, g.turn, g.shown, CASE WHEN g.shown THEN CASE WHEN r.o IS NULL THEN 0.0 ELSE least(1.0, r.o + g.step) END WHEN r.o - g.step > 0 THEN r.o - g.step END::DOUBLE FROM r JOIN g ON g.conv_id = r.conv_id AND g.role = r.role AND g.n = r.n + 1)
 SELECT conv_id, turn, role, round(o, 6) + 0.0 AS opacity FROM r WHERE o IS NOT NULL"""


@query(FADE_SQL)
def fade_states(spark, sf_dir):
    got = labels.fade_states(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", 4)
    return got.select("conv_id", "turn", "role", r6(F.col("opacity")).alias("opacity"))


THROTTLE_SQL = f"""WITH RECURSIVE {PTS}, e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n FROM pts),
 r AS (SELECT user_id, event_id, n, t AS last, true AS placed FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN e.t >= r.last + 3600000000 THEN e.t ELSE r.last END, e.t >= r.last + 3600000000 FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
 SELECT event_id, placed FROM r"""


@query(THROTTLE_SQL)
def placement_throttle(spark, sf_dir):
    e = pts(spark, sf_dir).select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return labels.throttled(e, "user_id", "t", "event_id", 3_600_000_000).select("event_id", "placed")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a draw list under a small theme."""
    return draw_list(spark, sf_dir)


def queries() -> dict[str, Query]:
    from . import state_queries  # noqa: F401  adds its queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import state_queries  # noqa: F401

    return dict(ORACLE)
