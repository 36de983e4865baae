"""Small helpers that all corpus operators share."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition ``[^\x20\x09-\x0D]+``; also what bytes.split() splits on.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is what the cluster names in ``spark.checkpoint.dir``. Where that is unset a local master
    gets a temporary folder (one machine, so it is shared), any other master the warehouse.
    """
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_to:
        return set_to.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_corpus"
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="corpus-"))
    return f"file://{_own_dir[0]}"


#: Shuffle files go when the query that made them ends, not when the driver's collector finds its plan.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that end within the block leave no shuffle files. Settings are as before afterwards."""
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


class Table:
    """A DataFrame written to the shared folder: its lineage is cut and lost executors cost nothing.

    ``df`` reads it again; ``drop()`` frees its space once nothing refers to it. The shuffles behind it
    are freed when it is written. ``by`` names columns that parts of it are read by.
    """

    def __init__(self, df: DataFrame, tag: str, *by: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{tag}-{uuid.uuid4().hex}"
        schema = df.schema
        with freed_shuffles(self.spark):
            (df.write.partitionBy(*by) if by else df.write).parquet(self.path)
        self.df = self.spark.read.schema(schema).parquet(self.path)

    def drop(self) -> None:
        """An empty table in its place: writing is all that a DataFrame user can do to files, on any kind of session."""
        self.spark.range(0).coalesce(1).write.mode("overwrite").parquet(self.path)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    return Table(df, tag).df


def sent(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """A broadcast of value, and what tasks call for it. Its classes go along, so executors need no copy of this
    package, which a plain broadcast would have them import."""
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(packed.value)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """ARRAY<STRING> of the words of a text, JVM side; [] for null and blank texts. White space at either end leaves
    an empty part, which is taken out again."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), rf"[{SPACE}]+"), "")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
