"""Contracts of runs and checks of their tables; each check returns the rows that break it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(columns: list[str]) -> Column:
    """Sorted name=value pairs of a row, nulls named as such."""
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in sorted(columns)]
    return F.concat_ws("\x1f", *parts)


def contract_hash(columns: list[str]) -> Column:
    return F.sha2(canonical(columns), 256)


def disagreeing(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Groups in which not all rows share one contract."""
    return df.groupBy(*by).agg(F.count_distinct(contract_hash(columns)).alias("n_contracts")).where("n_contracts > 1")


def missing_rows(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Expected keys that no row has."""
    return expected.select(*keys).distinct().join(actual.select(*keys).distinct(), keys, "left_anti")


def differing(left: DataFrame, right: DataFrame, keys: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """Keys whose values differ by more than a tolerance, or stand on one side only."""
    a, b = left.select(*keys, F.col(value).alias("l")), right.select(*keys, F.col(value).alias("r"))
    off = F.coalesce(F.abs(F.col("l") - F.col("r")) > tolerance, F.col("l").isNull() | F.col("r").isNull())
    return a.join(b, keys, "full_outer").where(off)


def null_fields(df: DataFrame, key: str, required: list[str]) -> DataFrame:
    """(key, field) of required fields that are null or blank."""
    bad = F.array(*[F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(c)) for c in required])
    return df.select(key, F.explode(F.filter(bad, lambda x: x.isNotNull())).alias("field"))


def outside(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows whose value is none of the allowed ones."""
    return df.where(~F.coalesce(F.col(column).isin(*allowed), F.lit(False)))
