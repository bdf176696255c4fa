"""Queries of problem 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm.toxicity import toxic_rates, toxic_scores
from vellum.sources.tables import table


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_scores(spark, sf_dir).where("toxic").select("doc_id")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"))


QUERIES = {"p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates}
ORACLES: dict[str, str] = {}
