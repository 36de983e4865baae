"""Mixing sources to target weights by systematic sampling. DataFrame functions only."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Table, text_or_empty

#: The longest documents of each source whose expected copies are whole numbers.
WHOLE = 64


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], max_repeat: float) -> DataFrame:
    """sizes(source, source_size, ...) one row per source -> the same with weight and target.

    Sources get the weights in code-point order (null last), repeating the list. Targets share all
    words by weight; one that passes max_repeat times its source's words stops there and the excess
    is reshared by weight until none is above. That is water filling: with the level w the target is
    least(max_repeat * source_size, w * weight). Sorted by the level at which each source fills,
    the filled ones are a prefix, so one running sum finds the level without a loop.
    One row per source: the windows see as many rows as there are sources.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    w = F.array(*[F.lit(float(x)) for x in weights])
    ranked = sizes.withColumn(
        "weight", F.element_at(w, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    )
    cap = F.col("source_size") * F.lit(float(max_repeat))
    all_rows = Window.partitionBy()
    filling = Window.orderBy(cap / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    upto = filling.rowsBetween(Window.unboundedPreceding, 0)
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(F.col("source_size").cast("double")).over(all_rows)
    steps = (
        ranked.withColumn("total", total)
        .withColumn("cap_before", F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
        .withColumn("weight_from", F.sum("weight").over(all_rows) - F.sum("weight").over(upto) + F.col("weight"))
    )
    # the level if exactly the sources before this one are full
    level = (F.col("total") - F.col("cap_before")) / F.col("weight_from")
    # True only from the first source that isn't full; assuming more of them full lowers the level
    holds = level * F.col("weight") <= cap
    leveled = steps.withColumn("level", F.max(F.when(holds, level)).over(all_rows))
    return leveled.select(
        *sizes.columns, "weight", F.least(cap, F.coalesce(F.col("level") * F.col("weight"), cap)).alias("target")
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    max_repeat: float = 3.0,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: Sequence[str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Every row of docs with how often the mix takes it: columns ``row`` (a struct of the columns of
    docs, or of those in keep), size, source_size, target, copies and taken (= copies * size).

    Expected copies are summed up in the order (size, id), one offset drawn from the seed is added and the
    document is emitted once for each integer the sum crosses. Every document is expected target /
    source_size times, at most max_repeat, but for the longest of each source, whose lot would decide
    how far the source misses its target: from the longest down they are expected a whole number of
    times, the one that brings what they give nearest to their share, rounded by the offset, and the
    others share what is left. So a source differs from its target by about the size of its
    longest document but WHOLE, however long that is; over seeds each is still taken in proportion.

    A source never meets in one task: rows are range partitioned by (source, size, id), positions
    within partitions come with the rows, and only one count per partition and source is summed up.

    Null ids, sources and texts are kept (null text: size 0; null source: a source of its own);
    repeated rows are separate documents; a source without words has the target 0 and isn't taken;
    an empty table gives an empty one. Columns of docs may have any names, they stay inside ``row``.
    """
    spark = docs.sparkSession
    base = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        word_count(text_or_empty(text_col)).alias("size"),
        F.struct(*(keep or ["*"])).alias("row"),
    )
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("id")]
    dealt = base.repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt = dealt.withColumn("at", F.monotonically_increasing_id())
    dealt = dealt.select(
        "row", "source", "size",
        F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("pos"),
    )
    dealt = Table(dealt, "mix").df
    pieces = dealt.groupBy("source", "part").agg(
        F.min("pos").alias("first"), F.count("*").alias("n"), F.sum("size").alias("words")
    )
    pieces = Table(pieces, "mix-pieces").df
    targets = source_targets(pieces.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_repeat)
    within = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(within), F.lit(0))
    ranked = pieces.select("source", "part", "n", "first", before.alias("before"), F.sum("n").over(Window.partitionBy("source")).alias("docs"))
    ranked = ranked.withColumn("shift", F.col("before") - F.col("first"))  # from a row's place to its rank, from 0 within the source
    offset = random.Random(seed).random()
    long = _whole(dealt, ranked, targets, offset, max_repeat)
    plan = _null_safe(ranked.select("source", "part", "shift", "docs"), long, ["source"])
    plan = Table(plan, "mix-plan").df

    rank = F.col("pos") + F.col("shift")
    each = F.col("each")
    copies = F.floor((rank + 1) * each + offset) - F.floor(rank * each + offset)
    from_top = (F.col("docs") - 1 - rank).cast("int")
    copies = F.coalesce(F.get("whole", from_top), copies)
    placed = _null_safe(dealt, plan, ["source", "part"])
    return placed.select(
        "row", "size", "source_size", "target", F.least(copies, F.lit(int(max_repeat))).alias("copies")
    ).withColumn("taken", F.col("copies") * F.col("size"))


def _whole(dealt: DataFrame, ranked: DataFrame, targets: DataFrame, offset: float, most: float) -> DataFrame:
    """targets with ``whole``, the copies of each source's longest documents from the longest down, and ``each``, what
    every other document of it is expected. Only the longest WHOLE of each source meet."""
    ends = ranked.where(F.col("before") + F.col("n") > F.col("docs") - WHOLE).select("source", "part", "shift", "docs")
    rows = _null_safe(dealt.select("source", "part", "pos", "size"), ends, ["source", "part"])
    from_top = F.col("docs") - 1 - F.col("pos") - F.col("shift")
    top = rows.where(from_top < WHOLE).groupBy("source").agg(F.sort_array(F.collect_list(F.struct(from_top.alias("k"), "size"))).alias("top"))
    t = _null_safe(targets, top, ["source"])
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    start = F.struct(F.lit(0.0).alias("due"), F.lit(0).cast("long").alias("given"), F.lit(0).cast("long").alias("words"), F.array().cast("array<long>").alias("copies"))

    def step(a: Column, x: Column) -> Column:
        due, size = a["due"] + F.col("share") * x["size"], x["size"]
        k = F.when(size > 0, F.floor((due - a["given"]) / size + offset)).otherwise(F.lit(0))
        k = F.least(F.greatest(k, F.lit(0)), F.lit(int(most))).cast("long")
        return F.struct(due.alias("due"), (a["given"] + k * size).alias("given"), (a["words"] + size).alias("words"), F.concat(a["copies"], F.array(k)).alias("copies"))

    t = t.withColumn("share", share).withColumn("got", F.aggregate("top", start, step))
    rest = F.col("source_size") - F.col("got.words")
    each = F.when(rest > 0, F.least(F.greatest((F.col("target") - F.col("got.given")) / rest, F.lit(0.0)), F.lit(float(most)))).otherwise(0.0)
    return t.select("source", "source_size", "target", each.alias("each"), F.col("got.copies").alias("whole"))


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on keys where null equals null; the keys appear once."""
    r = right.select(*[F.col(k).alias(f"__{k}") if k in keys else F.col(k) for k in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return left.join(r, on, how).drop(*[f"__{k}" for k in keys])


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken."""
    return mixed.where("copies > 0").select(F.explode(F.expr("array_repeat(row, int(copies))")).alias("row")).select("row.*")
