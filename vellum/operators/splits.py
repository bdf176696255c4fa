"""Deterministic stratified splits and samples.

Ranks by hash are exact without sorting a stratum in one task: the hash's first
two hex digits cut every stratum into 256 cells, only the cell counts are
accumulated, and rows are ranked within their cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions.text import strip

NO_EVENT = "__no_event__"


def stratum(types: Column) -> Column:
    """Sorted distinct event types as text, or a mark for none."""
    clean = F.filter(F.transform(F.coalesce(types, F.array().cast("array<string>")), strip), lambda t: t != "")
    return F.when(F.size(clean) > 0, F.array_join(F.array_sort(F.array_distinct(clean)), "|")).otherwise(NO_EVENT)


def ranked_by_hash(df: DataFrame, by: list[str], hashed: str, tie: str) -> DataFrame:
    """Adds ``rank``, from 0, by a hex hash within groups."""
    cells = df.withColumn("_cell", F.substring(hashed, 1, 2))
    counts = cells.groupBy(*by, "_cell").agg(F.count("*").alias("_n"))
    before = counts.select(*by, "_cell", (F.sum("_n").over(W.partitionBy(*by).orderBy("_cell")) - F.col("_n")).alias("_before"))
    within = cells.withColumn("_nth", F.row_number().over(W.partitionBy(*by, "_cell").orderBy(hashed, tie)))
    return within.join(before, [*by, "_cell"]).withColumn("rank", F.col("_before") + F.col("_nth") - 1).drop("_cell", "_before", "_nth")


def allocations(df: DataFrame, by: str, ratio: float) -> DataFrame:
    """(by, n, take): rows to take of each stratum by largest remainder; the total is the rounded share of all rows, half to even."""
    counts = df.groupBy(by).agg(F.count("*").alias("n"))
    total = counts.agg(F.struct(F.bround(F.sum("n") * F.lit(ratio)).cast("bigint").alias("target"), F.sum(F.floor(F.col("n") * F.lit(ratio))).alias("based")))
    each = counts.withColumn("t", total.scalar()).withColumn("base", F.floor(F.col("n") * F.lit(ratio))).withColumn("rest", F.col("n") * F.lit(ratio) - F.col("base"))
    each = each.withColumn("place", F.row_number().over(W.orderBy(F.desc("rest"), F.desc(by))))
    return each.select(by, "n", (F.col("base") + F.when(F.col("place") <= F.col("t.target") - F.col("t.based"), 1).otherwise(0)).alias("take"))


def stratified_split(df: DataFrame, key: str, types: str, ratio: float = 0.1, seed: int = 3407) -> DataFrame:
    """(key, stratum, part): the first of each stratum by hash are tune, the others fit."""
    rows = df.select(key, stratum(F.col(types)).alias("stratum"))
    rows = rows.withColumn("h", F.sha2(F.concat_ws(":", F.lit(str(seed)), "stratum", F.col(key).cast("string")), 256))
    ranked = ranked_by_hash(rows, ["stratum"], "h", key)
    take = allocations(rows, "stratum", ratio).select("stratum", "take")
    return ranked.join(take, "stratum").select(key, "stratum", F.when(F.col("rank") < F.col("take"), "tune").otherwise("fit").alias("part"))


def disjoint(split: DataFrame, key: str) -> DataFrame:
    """Keys that stand in more than one part; empty for a sound manifest."""
    return split.groupBy(key).agg(F.count_distinct("part").alias("n")).where("n > 1").select(key)


def epoch_order(df: DataFrame, key: str, seed: int, epoch: int) -> DataFrame:
    """Adds ``h``, a hash that orders the rows of an epoch: another permutation for each one."""
    return df.withColumn("h", F.sha2(F.concat_ws(":", F.lit(str(seed + epoch)), F.col(key).cast("string")), 256))
