"""Queries of problems 1 and 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm.crosssplit import cross_pairs, overlap_report
from vellum.llm.neardup import near_groups, near_pairs
from vellum.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_pairs(table(spark, sf_dir, "duee_fin_samples"))


def p1_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_report(table(spark, sf_dir, "duee_fin_samples"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_pairs(table(spark, sf_dir, "duee_fin_samples"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "duee_fin_samples"))


QUERIES = {"p1_found": p1_found, "p1_overlaps": p1_overlaps, "p5_found": p5_found, "p5_groups": p5_groups}
ORACLES: dict[str, str] = {}
