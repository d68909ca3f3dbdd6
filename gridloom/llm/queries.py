"""One query for each training-data operator, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_dedup

    return suffix_dedup.strip(table(spark, sf_dir, "documents"), with_kept=False)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lm_scoring

    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import license_scan

    return license_scan.label(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import url_filter

    decided = url_filter.ruled(table(spark, sf_dir, "pages"))
    return url_filter.looked_up(decided, url_filter.repeated(decided))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sentencepiece_codec

    return sentencepiece_codec.digest(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_rules

    out = quality_rules.judge(table(spark, sf_dir, "documents"))
    return out.selectExpr("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed", "kept")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat_format

    return chat_format.rotate(table(spark, sf_dir, "conversations"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import near_dedup

    return near_dedup.groups(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    return decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import line_dedup

    return line_dedup.report(table(spark, sf_dir, "documents")).drop("kept_text")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import collocations

    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    return pii.find(table(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import centroids

    return centroids.label(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_lm_scoring, op3_license_scan, op4_near_dedup, op5_decontaminate, op6_url_filter, op7_sentencepiece, op8_line_dedup, op9_quality_rules, op10_chat_format, op11_collocations, op12_personal_data, op13_centroid_clustering)}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
