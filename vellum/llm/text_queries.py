"""Queries of problems 2 to 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.pieces import split_oversized
from vellum.llm.plainform import odd_values, plain_form
from vellum.llm.truncation import cut_rates, cut_values
from vellum.sources.tables import table


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "duee_fin_samples"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_pieces(spark, sf_dir).where("piece_no = 0").select("row_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_values(table(spark, sf_dir, "evaluation_results"), table(spark, sf_dir, "duee_fin_samples"))


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_rates(table(spark, sf_dir, "evaluation_results"), table(spark, sf_dir, "duee_fin_samples"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = odd_values(table(spark, sf_dir, "duee_fin_samples"), "row_id", ["text", "events"], "duee_fin_samples")
    return samples.unionByName(odd_values(table(spark, sf_dir, "evaluation_results"), "result_id", ["prediction"], "evaluation_results"))


def p4_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_form(table(spark, sf_dir, "duee_fin_samples"), "row_id", ["text", "events"]).drop("odd")


def p4_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_form(table(spark, sf_dir, "evaluation_results"), "result_id", ["prediction"]).select("result_id", F.col("prediction"))


QUERIES = {
    "p2_found": p2_found, "p2_pieces": p2_pieces, "p3_found": p3_found, "p3_rates": p3_rates,
    "p4_found": p4_found, "p4_samples": p4_samples, "p4_predictions": p4_predictions,
}
ORACLES = {"p2_found": "SELECT row_id FROM duee_fin_samples WHERE length(text) > 3500"}
