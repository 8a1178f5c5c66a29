"""Queries of the training-data operators and, where SQL expresses one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from specloom.llm import attention_quality, decontamination, line_dedup, mixing, near_dup, quality_rules, secret_scan, suffix_dedup, token_counts, token_shards


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_mixing": mixing.op2_mixing,
        "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
        "op4_decontamination": decontamination.op4_decontamination,
        "op5_near_dup": near_dup.op5_near_dup,
        "op6_attention_quality": attention_quality.op6_attention_quality,
        "op7_token_shards": token_shards.op7_token_shards,
        "op8_secret_scan": secret_scan.op8_secret_scan,
        "op9_token_counts": token_counts.op9_token_counts,
        "op10_line_dedup": line_dedup.op10_line_dedup,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_near_dup": near_dup.ORACLE, "op10_line_dedup": line_dedup.ORACLE}
