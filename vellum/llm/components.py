"""Connected components of a link table, by alternating stars.

Every round maps links to links with two hash aggregations and two joins, so
no component, hub or link list is ever held in one task or on the driver. Each
round is staged in the shared folder; the number of rounds grows with the
logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.plans.staging import stage, unstage


def _large_star(links: DataFrame) -> DataFrame:
    """Link the larger neighbours of every node to its smallest one."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Link every node and its smaller neighbours to the smallest of these; links go from large u to small v."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).unionByName(moved).distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the least node of its component, for every node of (u, v) links.

    Null ends and self links count for nothing; repeated links count once; an
    empty table gives an empty one.
    """
    directed = links.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = stage(directed, name)
    mark = _mark(now)
    while mark[0]:
        after = stage(_small_star(_large_star(now)), name)
        unstage(now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    tops = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)
