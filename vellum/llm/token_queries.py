"""Queries of problems 7 and 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm.containers import container_summary, fill_containers
from vellum.llm.tokens import token_counts, token_ids
from vellum.sources.tables import table


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"))


def p7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_containers(token_counts(table(spark, sf_dir, "documents")))


def p8_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return container_summary(p8_containers(spark, sf_dir))


QUERIES = {"p7_ids": p7_ids, "p7_counts": p7_counts, "p8_containers": p8_containers, "p8_summary": p8_summary}
ORACLES: dict[str, str] = {}
