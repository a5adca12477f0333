"""Registered queries of this subpackage: a builder and, where SQL can say it, the DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import anchors, apportion, bloom_cascade, decontaminate, dual_tree, forest_ann, hpy, html_text, jump_shards, knn_quality, \
    line_runs, near_dup, str_negatives

Builder = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest_ann.report(table(spark, sf_dir, "embeddings"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apportion.mix_report(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.report(table(spark, sf_dir, "documents"))


def op4_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jump_shards.report(table(spark, sf_dir, "documents"))


def op5_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.report(table(spark, sf_dir, "documents"))


def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpy.report(table(spark, sf_dir, "documents"))


def op7_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_cascade.report(table(spark, sf_dir, "pages"))


def op8_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_bayes_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.report(table(spark, sf_dir, "documents"))


def op10_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_str_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return str_negatives.report(table(spark, sf_dir, "embeddings"))


def op12_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.report(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Builder] = {f.__name__: f for f in (
    op1_prefix_forest, op2_source_mix, op3_line_dedup, op4_jump_shards, op5_block_anchors, op6_pitman_yor, op7_bloom_cascade,
    op8_simhash_windows, op9_bayes_minhash, op10_knn_quality, op11_str_negatives, op12_dual_tree, op13_html_text)}
ORACLES: dict[str, str] = {"op3_line_dedup": line_runs.ORACLE, "op5_block_anchors": anchors.ORACLE,
                           "op7_bloom_cascade": bloom_cascade.ORACLE, "op9_bayes_minhash": near_dup.ORACLE,
                           "op11_str_negatives": str_negatives.ORACLE, "op12_dual_tree": dual_tree.ORACLE}
