"""Registered queries of the subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm import (
    decontaminate,
    fingerprint,
    html,
    language,
    licenses,
    negatives,
    packing,
    periodic,
    pii,
    quality,
    simhash,
    substring,
    toxicity,
)
from shelfwise.llm.oracle import ORACLE

__all__ = ["ORACLE", "QUERIES"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return html.op1(_table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, decision and number of toxic passages."""
    return toxicity.op2(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language."""
    return language.op3(_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score and decision."""
    return quality.op4(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's license phrases and the licenses whose templates a block of it contains."""
    return licenses.op5(_table(spark, sf_dir, "documents"))


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, those in repeated passages, and a digest of the rest."""
    return substring.op6(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    return packing.op7(_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash and the smallest doc_id it is linked to, directly or through others."""
    return simhash.op8(_table(spark, sf_dir, "documents"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, how like its edited text's and the next one's are, and its class of near duplicates."""
    return fingerprint.op9(_table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document contains."""
    return decontaminate.op10(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's periodic runs, the longest one, and digests of the runs and of the words left."""
    return periodic.op11(_table(spark, sf_dir, "documents"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hard negatives for each anchor and positive."""
    return negatives.op12(_table(spark, sf_dir, "embeddings"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data: the patterns' counts and digest, and all spans."""
    return pii.op13(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html": op1_html,
    "op2_toxicity": op2_toxicity,
    "op3_language": op3_language,
    "op4_quality": op4_quality,
    "op5_licenses": op5_licenses,
    "op6_substring": op6_substring,
    "op7_packing": op7_packing,
    "op8_simhash": op8_simhash,
    "op9_minhash": op9_minhash,
    "op10_decontaminate": op10_decontaminate,
    "op11_periodic": op11_periodic,
    "op12_negatives": op12_negatives,
    "op13_pii": op13_pii,
}
