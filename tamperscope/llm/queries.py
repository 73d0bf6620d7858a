"""One query per operator: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tamperscope.llm import (
    backoff_lm, bpe, chat, collocations, license_scan, line_dedup, line_frequency, mixing, periodic_runs, quality_mil, secret_scan,
    simhash, sketch,
)
from tamperscope.llm.common import read


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read(spark, sf_dir, "documents"))


def op2_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip_digests(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op5_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.quality_rules(read(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(read(spark, sf_dir, "documents"))


def op7_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.edited_neighbours(read(spark, sf_dir, "documents"))


def op8_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(read(spark, sf_dir, "conversations"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.span_digests(read(spark, sf_dir, "documents"))


def op11_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.model_scores(read(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(read(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_quality_mil": op2_quality_mil,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_license_scan": op4_license_scan,
    "op5_line_frequency": op5_line_frequency,
    "op6_line_dedup": op6_line_dedup,
    "op7_bottom_k": op7_bottom_k,
    "op8_chat_rotation": op8_chat_rotation,
    "op9_mixing": op9_mixing,
    "op10_secret_scan": op10_secret_scan,
    "op11_backoff_lm": op11_backoff_lm,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_collocations": op13_collocations,
}
