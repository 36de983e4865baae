"""The corpus operators applied to whole tables, with their production parameters.

The queries only derive the columns that are asked for from what the operators return.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, forest, langmodel, lines, mixing, negatives, pages, pieces, pii, quality, ranked, secrets, simhash
from .common import read


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix(read(spark, sf_dir, "documents"), weights=(5, 2, 1), max_repeat=3, keep=["doc_id"])
    return m.select("row.doc_id", "size", "source_size", "target", "taken", "copies")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pii.scan(read(spark, sf_dir, "documents"))

    def joined(c: str) -> Column:
        return F.array_join(F.transform(c, lambda x: F.concat_ws(":", x.kind, x.s, x.e)), ",")

    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return got.select(
        F.col("id").alias("doc_id"), *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans")
    )


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda x: x.kind == kind


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = secrets.scan(read(spark, sf_dir, "documents"))
    counts = [secrets.count(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    base, spans = secrets.joined(F.col("base")), secrets.joined(F.col("spans"))
    return got.select(F.col("id").alias("doc_id"), *counts, F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = forest.near(read(spark, sf_dir, "embeddings"), threshold=0.9)
    return got.select(
        F.col("id").alias("vec_id"),
        "n_links",
        F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    got = quality.judge(docs, read(spark, sf_dir, "labels"))
    return got.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pieces.encode(read(spark, sf_dir, "documents"), pieces.Model.load(), with_ids=False)
    return got.select(F.col("id").alias("doc_id"), "n_tokens", "n_byte_tokens", "ids_sha256", "exact")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=4, distance=4)
    return got.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lines.marked(read(spark, sf_dir, "documents"))
    return got.select(
        F.col("id").alias("doc_id"), "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join("removed", ",").alias("removed_lines")
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langmodel.score(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(read(spark, sf_dir, "pages"), pages.trained()).select("row.*", "text", "n_chars")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = exact.mark(read(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=moved)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_pii": op2_pii,
        "op3_secrets": op3_secrets,
        "op4_embedding_near_dedup": op4_embedding_near_dedup,
        "op5_quality_rules": op5_quality_rules,
        "op6_sentencepiece": op6_sentencepiece,
        "op7_simhash": op7_simhash,
        "op8_line_dedup": op8_line_dedup,
        "op9_lm_scoring": op9_lm_scoring,
        "op10_html_extraction": op10_html_extraction,
        "op11_exact_dedup": op11_exact_dedup,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_ranked_search": op13_ranked_search,
    }


def oracle_sql() -> dict[str, str]:
    from . import oracle

    return oracle.SQL
