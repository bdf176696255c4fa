"""Flat metrics out of report documents, efficiency, significance notes, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.maths import safe_div


def metric_values(reports: DataFrame, key: str, payload: str, required: list[str], optional: list[str] = ()) -> DataFrame:
    """(key, metric, value) from JSON reports in any of three layouts: at the top, under ``metrics``, or with ``overall`` inside.

    A required metric that a report lacks is an error naming it.
    """
    v = F.try_parse_json(payload)

    def found(m: str) -> Column:
        places = [f"$.{m}", f"$.metrics.{m}", f"$.{m}.overall", f"$.metrics.{m}.overall"]
        return F.coalesce(*[F.try_variant_get(v, p, "double") for p in places])

    def needed(m: str) -> Column:
        return F.coalesce(found(m), F.raise_error(F.lit(f"missing metric {m}")).cast("double"))

    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), needed(m).alias("value")) for m in required], *[F.struct(F.lit(m).alias("metric"), found(m).alias("value")) for m in optional])
    return reports.select(key, F.inline(pairs)).where("value is not null")


def efficiency(rows: DataFrame, f1: str = "f1", tokens: str = "tokens", seconds: str = "seconds") -> DataFrame:
    """Adds score per 1000 tokens and per minute, null where nothing was spent."""
    return rows.withColumn("f1_per_1k_tokens", F.when(F.col(tokens) > 0, F.col(f1) * 1000 / F.col(tokens))).withColumn("f1_per_minute", F.when(F.col(seconds) > 0, F.col(f1) * 60 / F.col(seconds)))


def map_totals(rows: DataFrame, stats: str) -> DataFrame:
    """(name, total) of a map column of counters."""
    return rows.select(F.explode(stats).alias("name", "n")).groupBy("name").agg(F.sum(F.coalesce("n", F.lit(0))).alias("total"))


def best(rows: DataFrame, metric: str, order: str) -> DataFrame:
    """The row with the highest value, the first of equals."""
    return rows.orderBy(F.desc(metric), order).limit(1)


def logged_ratio(rows: DataFrame, by: str, sample: str) -> DataFrame:
    """(by, n_rows, n_samples, ratio, differ): logged rows per distinct sample, and whether the two counts differ."""
    g = rows.groupBy(by).agg(F.count("*").alias("n_rows"), F.count_distinct(sample).alias("n_samples"))
    return g.select("*", safe_div(F.col("n_rows"), F.col("n_samples")).alias("ratio"), (F.col("n_rows") != F.col("n_samples")).alias("differ"))
