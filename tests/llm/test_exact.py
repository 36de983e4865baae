"""Exact copies against groups by the normalised text, at every way that records can be dealt."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tilewright.llm import exact
from tilewright.llm.exact import TextTable, normal

SF = "/root/testdata/sf0.001"
plain = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")


@pytest.mark.parametrize("t", ["", " ", "\n\t", "a", " a", "a \n b ", "a b", "\x0b\x0ca\r", "é    x"])
def test_normal(t):
    assert normal(t.encode()).decode() == plain(t)


def test_table_compares_whole_texts():
    """All hashes are equal, or share their low bits: only the texts tell records apart."""
    for h in (lambda i: 5, lambda i: i << 40):
        t = TextTable(8)
        first = [t.put(h(i % 300), f"text {i % 300}".encode(), i) for i in range(900)]
        assert first == [i % 300 for i in range(900)]


def check(rows, got):
    groups = defaultdict(list)
    for d, t in rows:
        groups[plain(t)].append(d)
    assert len(got) == len(rows)
    for d, t, r in zip(*zip(*sorted(rows, key=str)), sorted(got, key=lambda r: str((r.id, r.text)))):
        g = groups[plain(t)]
        ids = [x for x in g if x is not None]
        assert (r.keep_id, r.group_size) == (min(ids) if ids else None, len(g))
        assert r.sha256 == hashlib.sha256(plain(t).encode()).hexdigest()
    for t, g in groups.items():
        assert sum(r.kept for r in got if plain(r.text) == t) == 1


ROWS = [(i, f"text {i % 40}\n\n line") for i in range(200)] + [(500 + i, "hot  copy" if i % 2 else "hot\tcopy") for i in range(300)]
ROWS += [(900, None), (901, ""), (902, " "), (903, "\n"), (904, "x" * 200_000), (905, "x" * 200_000), (906, "x" * 199_999 + "y"), (None, "text 1 line"), (None, "alone"), (907, "again"), (907, "again")]


@pytest.mark.parametrize("bucket, buckets", [(1 << 25, 8192), (400, 8192), (400, 8)])
def test_groups(spark, bucket, buckets):
    """One table; buckets that overflow, with a hot text dealt by row; spill files by a coarse digit."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(6)
    got = exact.mark(df, keep=["text"], bucket=bucket, buckets=buckets).select("row.text", "id", "keep_id", "group_size", "kept", "sha256").collect()
    check(ROWS, got)


def test_clashing_names_string_ids_and_empty(spark):
    df = spark.createDataFrame([("b", "t  1", 1, 2, 3), ("a", "t 1", 4, 5, 6), ("c", "t 2", 7, 8, 9)], "doc_id string, text string, rep int, root int, `a b` int")
    out = exact.drop_copies(df)
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == [("a", "t 1", 4, 5, 6), ("c", "t 2", 7, 8, 9)]
    assert exact.mark(df.limit(0)).count() == 0


def test_query(spark):
    from tilewright.llm import queries

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.op11_exact_dedup(spark, SF).withColumnRenamed("text_sha256", "sha256").withColumnRenamed("doc_id", "id")
    check(docs, got.join(spark.createDataFrame(docs, "id long, text string"), "id").collect())
    assert got.where(F.col("kept") != (F.col("id") == F.col("keep_id"))).count() == 0
