"""What a style or a set of tiles could not do, as rows: layers that are left out, operators that are not supported, tiles that
failed, counted by reason."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .expressions import Context, TypedView
from .theme import PROPERTIES, RENAMED, SKIPPED, read_theme

SCHEMA = "kind string, subject string, reason string"


def style_problems(spark: SparkSession, style: dict[str, Any]) -> DataFrame:
    """(kind, subject, reason) for each layer of a style that is left out and each warning of its expressions. A style is a
    document, so its rows are few."""
    rows: list[tuple[str, str, str]] = []
    drawn = read_theme(style)
    rows += [("style", w.split(":")[0], w.partition(": ")[2]) for w in drawn.warnings]
    for raw in style.get("layers") or []:
        kind, name = raw.get("type"), str(raw.get("id", ""))
        if kind in SKIPPED:
            rows.append(("layer", name, f"type {kind} is not drawn"))
        elif (raw.get("layout") or {}).get("visibility") == "none":
            rows.append(("layer", name, "not visible"))
        elif (kind in PROPERTIES or kind in RENAMED) and kind != "background" and not raw.get("source"):
            rows.append(("layer", name, "no source"))
    ctx = Context(TypedView({}), 0.0)
    for y in drawn.layers:
        seen = {w for n in y.properties for w in y.property(n, ctx).warnings} | set(y.filter_column(ctx).warnings)
        rows += [("expression", y.id, w) for w in sorted(seen)]
    return spark.createDataFrame(rows, SCHEMA)


def tile_problems(tiles: DataFrame, subject: Column) -> DataFrame:
    """(kind, subject, reason) for each of tiles(status, error) that failed."""
    return tiles.where("status = 'error'").select(F.lit("tile").alias("kind"), subject.cast("string").alias("subject"), F.coalesce("error", F.lit("unknown")).alias("reason"))


def counted(problems: DataFrame) -> DataFrame:
    """(kind, reason, n): how often each thing went wrong."""
    return problems.groupBy("kind", "reason").agg(F.count("*").alias("n"))


def observed(tiles: DataFrame, name: str = "tiles") -> tuple[DataFrame, Observation]:
    """tiles(status, ..) and an observation that counts them by status while they are used, in no pass of its own."""
    o = Observation(name)
    by = [F.count_if(F.col("status") == s).alias(s) for s in ("data", "not_found", "error")]
    return tiles.observe(o, F.count(F.lit(1)).alias("tiles"), *by), o
