"""Executors without a copy of the package run what is broadcast to them."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")

def absent(batches):
    try:
        import tilewright
    except ImportError:
        yield from batches

assert spark.range(3).mapInArrow(absent, "id long").count() == 3
sys.path.insert(0, sys.argv[1])
from tilewright.llm import forest, langmodel, pages, pieces
docs = spark.createDataFrame([(i, "some words of a text " * (i + 1)) for i in range(20)], "doc_id long, text string")
vectors = spark.createDataFrame([(i, [1.0, float(i % 3), 2.0]) for i in range(9)], "vec_id long, embedding array<double>")
assert forest.near(vectors).count() == 9
assert pieces.encode(docs, pieces.Model.load()).where("exact").count() == 20
assert langmodel.score(docs).where("score < 0").count() == 20
assert pages.extract(spark.createDataFrame([(1, "u", "<p>One.</p>")], "page_id long, url string, html string"), pages.Extractor.train(40)).count() == 1
print("done")
"""


def test_workers_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    root = str(Path(__file__).resolve().parents[2])
    got = subprocess.run([sys.executable, "-c", SCRIPT, root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert got.stdout.strip().endswith("done"), got.stderr[-3000:]
