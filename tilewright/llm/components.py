"""Connected components of a graph that no single task or driver has to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(src, dst: long) -> (node, component), component the smallest node reachable.

    Alternates the large-star and small-star steps of Kiveris et al. (2014) until the edge set is a
    forest of stars. Minima are aggregated map-side before they are shuffled, so a hub with millions
    of neighbours costs one row per task, and the joins back are plain equi-joins that adaptive
    execution may split. Each round is written to the shared folder, which cuts the lineage.

    Self loops and rows with a null end are ignored (their nodes get no row); repeated and reversed
    edges count once; an empty table gives an empty table.
    """
    a, b = F.col("src"), F.col("dst")
    start = (
        edges.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("src"), F.least(a, b).alias("dst"))
        .distinct()
    )
    now = Table(start, "cc")
    before = _mark(now.df)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        new = Table(_small_star(_large_star(now.df)), "cc")
        now.drop()
        now = new
        after = _mark(now.df)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.df
    return stars.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(
        stars.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    )


def _mark(e: DataFrame) -> tuple:
    row = e.agg(
        F.count("*"),
        F.coalesce(F.bit_xor(F.xxhash64("src", "dst")), F.lit(0)),
        F.coalesce(F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")), F.lit(0)),
    ).first()
    return tuple(row)


def _large_star(e: DataFrame) -> DataFrame:
    """e has src > dst. Every larger neighbour of a node is linked to the node's smallest neighbour."""
    low = e.groupBy("src").agg(F.min("dst").alias("low"))  # the smallest neighbour, if one is smaller
    # a node with no smaller neighbour is its own minimum, and its edges stay as they are
    j = e.join(low.withColumnRenamed("src", "mid"), e.dst == F.col("mid"), "left")
    return j.select("src", F.coalesce("low", "dst").alias("dst")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to its smallest neighbour."""
    low = e.groupBy("src").agg(F.min("dst").alias("low"))
    j = e.join(low, "src")
    rest = j.where(F.col("dst") != F.col("low")).select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return low.select("src", F.col("low").alias("dst")).unionByName(rest).distinct()
