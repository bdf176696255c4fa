"""Filling containers of fixed capacity with items of varying length (problem 8).

Shortest-pack-first over the length histogram: lengths go in longest first, each
into the packs with most room left, and only counts of packing patterns change.
Where no pack has room, new ones are opened for as many items as each can hold,
so a length that is very frequent does not get a pack per item.
The histogram has at most ``capacity`` lengths however many items there are, so
the driver holds nothing that grows with the data. Items then find their place
by their rank among those of equal length; ranks are counted in salted groups.

Results: an item beyond the capacity is cut into full containers and a rest,
which is packed like any item; an item of length 0 takes no room and gets the
null container; null lengths count as 0; ties go by key; an empty table gives an
empty result. Keys must be unique.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.plans.staging import stage

CAPACITY = 2048
SALTS = 256


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(number of containers, {length: items of it}) by shortest-pack-first."""
    open_packs: list[tuple[int, int, int, dict[int, int]]] = []  # (-room, tie, count, content)
    tie = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit {capacity}")
        while left:
            if open_packs and -open_packs[0][0] >= length:
                room, _, count, content = heapq.heappop(open_packs)
                each = min(-room // length, max(1, left // count))
                used = min(count, left // each) or 1
                if used < count:
                    tie += 1
                    heapq.heappush(open_packs, (room, tie, count - used, content))
            else:
                room, content = -capacity, {}  # nothing has room: open as few as the items left can fill
                each = min(capacity // length, left)
                used = left // each
            tie += 1
            left -= used * each
            heapq.heappush(open_packs, (room + each * length, tie, used, {**content, length: content.get(length, 0) + each}))
    merged: Counter = Counter()
    for _, _, count, content in open_packs:
        merged[tuple(sorted(content.items(), reverse=True))] += count
    return [(count, dict(content)) for content, count in sorted(merged.items(), reverse=True)]


def _slots(found: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """For each length, runs of ranks and the containers they go to, in order of (length, rank)."""
    rows, first, taken = [], 0, Counter()
    for count, content in found:
        offset = 0
        for length, each in content.items():
            rows.append((length, taken[length], first, each, offset))
            taken[length] += count * each
            offset += length * each
        first += count
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {"key": (table[:, 0] << 44) + table[:, 1], "base": table[:, 1], "first": table[:, 2], "each": table[:, 3], "offset": table[:, 4]}


def fill_containers(df: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """(key, part, first_token, n_tokens, container_id, start): where every item, or part of one, is put."""
    sizes = df.select(F.col(key).alias("id"), F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("n"))
    whole = F.when(F.col("n") == 0, F.lit(1)).otherwise(F.ceil(F.col("n") / F.lit(capacity)))
    parts = sizes.select("id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), whole.cast("bigint") - 1)).alias("part"))
    parts = parts.select("id", F.col("part").cast("int").alias("part"), F.least(F.col("n") - F.col("part") * capacity, F.lit(capacity)).cast("int").alias("size"))
    parts = stage(parts.withColumn("salt", F.pmod(F.xxhash64("id", "part"), F.lit(SALTS)).cast("int")), "parts")
    some = parts.where("size > 0")
    cells = stage(some.groupBy("size", "salt").agg(F.count("*").alias("n")), "cells")
    histogram = {r["size"]: r["n"] for r in cells.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    slots = df.sparkSession.sparkContext.broadcast(_slots(patterns(histogram, capacity)))
    before = cells.select("size", "salt", (F.sum("n").over(W.partitionBy("size").orderBy("salt")) - F.col("n")).alias("before"))
    within = some.withColumn("nth", F.row_number().over(W.partitionBy("size", "salt").orderBy("id", "part")))
    ranked = within.join(before.hint("merge"), ["size", "salt"])  # both sides lie by (size, salt) already
    ranked = ranked.select("id", "part", "size", (F.col("before") + F.col("nth") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = slots.value
        for batch in batches:
            length = batch.column(2).to_numpy().astype(np.int64)
            rank = batch.column(3).to_numpy()
            i = np.searchsorted(s["key"], (length << 44) + rank, "right") - 1
            turn = rank - s["base"][i]
            container = s["first"][i] + turn // s["each"][i]
            start = s["offset"][i] + turn % s["each"][i] * length
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(container), pa.array(start.astype(np.int32))], names=["id", "part", "size", "container_id", "start"])

    kind = sizes.schema["id"].dataType.simpleString()
    placed = ranked.mapInArrow(place, f"id {kind}, part int, size int, container_id bigint, start int")
    empty = parts.where("size = 0").select("id", "part", "size", F.lit(None).cast("bigint").alias("container_id"), F.lit(0).alias("start"))
    out = placed.unionByName(empty)
    return out.select(F.col("id").alias(key), "part", (F.col("part") * capacity).alias("first_token"), F.col("size").alias("n_tokens"), "container_id", "start")


def container_summary(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers, their fill, and the fewest that could hold the same tokens."""
    each = placed.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("items"))
    return each.agg(
        F.count("*").alias("n_containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("n_tokens"), F.coalesce(F.max("used"), F.lit(0)).alias("max_used"), F.coalesce(F.sum("items"), F.lit(0)).alias("n_items"),
    ).withColumn("least_containers", F.ceil(F.col("n_tokens") / capacity)).withColumn("fill", F.coalesce(F.try_divide(F.col("n_tokens").cast("double"), F.col("n_containers") * F.lit(capacity)), F.lit(0.0)))
