"""Every query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from tilewright import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    rows = df.collect()
    assert rows
    if name not in queries.oracle_sql():
        return
    r = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(x[names.index(c)]) for c in df.columns) for x in r.fetchall()), key=str)
    got = sorted((tuple(plain(v) for v in x) for x in rows), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, abs_tol=1e-5) for x, y in zip(a, b)), (a, b)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_collisions_are_those_of_a_plain_loop(spark):
    from pyspark.sql import functions as F

    from tilewright.operators import symbols

    box = "array<struct<anchor:string,l:double,t:double,r:double,b:double>>"
    rows = [(s, i, ((i * 37) % 300) * 1.0, ((i * 91) % 300) * 1.0) for s in range(3) for i in range(120)]
    df = spark.createDataFrame(rows, "screen int, ord int, x double, y double")
    df = df.select("screen", "ord", F.expr(f"cast(array(named_struct('anchor','center','l',x,'t',y,'r',x+40,'b',y+20)) as {box})").alias("text_boxes"), F.lit(None).cast("struct<l:double,t:double,r:double,b:double>").alias("icon_box"), F.lit(False).alias("allow_overlap"), F.lit(False).alias("text_optional"))
    got = {(r.screen, r.ord): r.placed for r in symbols.place(df, ["screen"], ["ord"]).collect()}
    for s in range(3):
        taken = []
        for _, i, x, y in [r for r in rows if r[0] == s]:
            free = not any(x < a + 40 and a < x + 40 and y < b + 20 and b < y + 20 for a, b in taken)
            assert got[s, i] == free
            if free:
                taken.append((x, y))
