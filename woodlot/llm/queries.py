"""Queries that apply the corpus operators, with production parameters, to whole tables."""

from __future__ import annotations

from . import bpe, decontaminate, katz_lm, line_dedup, near_dups, quality_knn, quality_rules, substrings, token_counts, toxicity_cnn
from .common import documents


def _rules(spark, d):
    return quality_rules.apply_rules(documents(spark, d).select("doc_id", "source", "text")).drop("source", "text")


def _lines(spark, d):
    return line_dedup.drop_boilerplate(documents(spark, d).select("doc_id", "source", "text"))


def _leaks(spark, d):
    return decontaminate.flag(documents(spark, d).select("doc_id", "text"), spark.read.parquet(f"{d}/benchmark.parquet")).drop("text")


def _labels(spark, d):
    return spark.read.parquet(f"{d}/labels.parquet")


def queries() -> dict:
    return {
        "op1_bpe": lambda spark, d: bpe.digests(documents(spark, d)),
        "op2_quality_classifier": lambda spark, d: quality_knn.verdicts(documents(spark, d), _labels(spark, d)),
        "op4_toxicity": lambda spark, d: toxicity_cnn.verdicts(documents(spark, d), _labels(spark, d)),
        "op3_quality_rules": _rules,
        "op5_line_dedup": _lines,
        "op6_katz_lm": lambda spark, d: katz_lm.score_texts(documents(spark, d)),
        "op8_substring_dedup": lambda spark, d: substrings.digests(documents(spark, d)),
        "op9_decontamination": _leaks,
        "op10_near_dups": lambda spark, d: near_dups.classes(documents(spark, d)),
        "op7_token_counts": lambda spark, d: token_counts.count_tokens(documents(spark, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": quality_rules.SQL, "op5_line_dedup": line_dedup.SQL, "op9_decontamination": decontaminate.SQL}
