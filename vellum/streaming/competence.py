"""Competence of a learner from its losses: an ordered fold with a clamp.

Every step is a clamped affine map, c -> min(high, max(low, a c + b)) with a >= 0,
and such maps compose to one of their kind. So a key's history need not stay in
one task: rows are spread by ranges of (key, order), every task composes the
steps of its pieces, the pieces of a key are chained, and every task then runs
its rows from the state its first key had before. Only the first key of a task
can have begun in another one, so the states handed over are one per task.
Within a task, steps are composed in numpy by doubling, not one by one. Streams
keep the state per key between micro-batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.plans.staging import stage


@dataclass(frozen=True)
class Pace:
    """Parameters of the recurrence."""

    floor: float = 0.05
    ceiling: float = 0.95
    warmup: int = 10
    target: float = 0.3
    decay: float = 0.9
    center: float = 0.5
    temperature: float = 0.2


def advance(step: int, competence: float, loss: float, p: Pace) -> float:
    """Competence after a loss; ``step`` counts from 1."""
    if step <= p.warmup:
        return min(p.floor + p.target * step / p.warmup, p.ceiling)
    x = (p.center - loss) / p.temperature
    signal = 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))
    return max(p.floor, min(p.ceiling, p.decay * competence + (1 - p.decay) * signal))


def maps(steps: np.ndarray, losses: np.ndarray, p: Pace) -> np.ndarray:
    """(a, b, low, high) of each step; a step of the warm-up is a constant."""
    x = (p.center - losses) / p.temperature
    signal = np.where(x >= 0, 1 / (1 + np.exp(-np.abs(x))), np.exp(-np.abs(x)) / (1 + np.exp(-np.abs(x))))
    warm = steps <= p.warmup
    fixed = np.minimum(p.floor + p.target * steps / max(p.warmup, 1), p.ceiling)
    return np.stack([np.where(warm, 0.0, p.decay), np.where(warm, fixed, (1 - p.decay) * signal), np.where(warm, fixed, p.floor), np.where(warm, fixed, p.ceiling)])


def after(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The map that takes ``first``, then ``second``."""
    a, b, low, high = second
    clamp = lambda x: np.minimum(high, np.maximum(low, a * x + b))
    return np.stack([a * first[0], a * first[1] + b, clamp(first[2]), clamp(first[3])])


def applied(m: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.minimum(m[3], np.maximum(m[2], m[0] * x + m[1]))


def scanned(m: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each step's map composed with all before it in its piece; ``starts`` is the first place of each step's piece."""
    m, reach, place = m.copy(), 1, np.arange(m.shape[1])
    while True:
        at = np.flatnonzero(place - reach >= starts)
        if not len(at):
            return m
        m[:, at] = after(m[:, at - reach], m[:, at])
        reach *= 2


def pieces(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each piece of equal keys begins, and for every row where its piece does."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return first, np.repeat(first, np.diff(np.r_[first, len(keys)]))


def _codes(batch: pa.RecordBatch) -> np.ndarray:
    """Equal numbers for equal neighbouring keys of a sorted batch."""
    return batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)


def _ends(ordered: DataFrame, pace: Pace, kind: str) -> DataFrame:
    """(part, key, n, maps): number of steps of each key in each part, and the maps of all its steps but the first 0, 1, 2, … of a warm-up.

    Steps are taken as past the warm-up; how many are not is known only when the
    pieces are chained.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, n, held = None, None, 0, None  # the open piece: held[i] is the map of its steps from the i-th on

        def close() -> pa.RecordBatch:
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([key], schema_key), pa.array([n], pa.int64()), pa.array([held.T.ravel().tolist()], pa.list_(pa.float64()))], names=["part", "key", "n", "maps"])

        for batch in batches:
            schema_key = batch.column(0).type
            parts, losses = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            first, _ = pieces(_codes(batch).astype(np.int64) + parts.astype(np.int64) * (batch.num_rows + 1))
            m = maps(np.full(batch.num_rows, pace.warmup + 1), losses, pace)
            for s, e in zip(first, np.r_[first[1:], batch.num_rows]):
                k, own = batch.column(0)[int(s)].as_py(), int(parts[s])
                if n and (own, k) != (part, key):
                    yield close()
                    n = 0
                if not n:
                    held = np.array([[1.0], [0.0], [-np.inf], [np.inf]]) * np.ones((1, pace.warmup + 1))
                part, key = own, k
                total = scanned(m[:, s:e], np.zeros(e - s, np.int64))[:, -1:]
                for i in range(pace.warmup + 1):  # the first i steps of the piece are left out
                    skip = max(0, i - n)
                    if skip == 0:
                        held[:, i : i + 1] = after(held[:, i : i + 1], total)
                    elif skip < e - s:
                        held[:, i : i + 1] = after(held[:, i : i + 1], scanned(m[:, s + skip : e], np.zeros(e - s - skip, np.int64))[:, -1:])
                n += int(e - s)
        if n:
            yield close()

    return ordered.select("key", "part", "loss").mapInArrow(run, f"part int, key {kind}, n bigint, maps array<double>")


def chained(ends: list[tuple[int, object, int, list[float]]], pace: Pace) -> dict[int, tuple[object, int, float]]:
    """For each part the key it goes on with, that key's steps so far and its state, from the (part, key, n, maps) of keys in more than one part."""
    out: dict[int, tuple[object, int, float]] = {}
    key, done, now = object(), 0, pace.floor
    for part, k, n, flat in sorted(ends, key=lambda r: (r[0], r[1])):
        if k != key:
            key, done, now = k, 0, pace.floor
        out.setdefault(part, (k, done, now))
        warm = max(0, min(n, pace.warmup - done))
        if warm:
            now = min(pace.floor + pace.target * (done + warm) / pace.warmup, pace.ceiling)
        if n > warm:
            m = np.array(flat).reshape(-1, 4).T[:, warm]
            now = float(applied(m, np.float64(now)))
        done += n
    return out


def competence(losses: DataFrame, pace: Pace = Pace(), parts: int | None = None) -> DataFrame:
    """(key, step, loss, competence) of (key, order, loss) rows, steps counted from 1 in the order.

    Rows without a key or a loss are left out; a key without rows has none.
    """
    kind = losses.schema["key"].dataType.simpleString()
    rows = losses.where("key is not null and loss is not null").select("key", F.col("loss").cast("double").alias("loss"), "order")
    spread = rows.repartitionByRange(parts, "key", "order") if parts else rows.repartitionByRange("key", "order")
    held = stage(spread.withColumn("part", F.spark_partition_id()), "losses")
    ordered = held.repartition("part").sortWithinPartitions("part", "key", "order")
    # a key goes on in another part only if it is the last of one and the first of the next: one row per part tells
    reach = sorted(tuple(r) for r in held.groupBy("part").agg(F.min("key"), F.max("key")).collect())
    borders = sorted({last for (_, _, last), (_, first, _) in zip(reach, reach[1:]) if last == first})
    ends: list[tuple] = []
    if borders:
        keys = F.broadcast(losses.sparkSession.createDataFrame([(k,) for k in borders], f"key {kind}"))  # fewer than parts
        some = held.join(keys, "key", "left_semi").repartition("part").sortWithinPartitions("part", "key", "order")
        ends = [tuple(r) for r in _ends(some, pace, kind).collect()]
    state = losses.sparkSession.sparkContext.broadcast(chained(ends, pace))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, step, now = None, None, 0, pace.floor
        for batch in batches:
            own, losses_ = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            codes = _codes(batch).astype(np.int64) + own.astype(np.int64) * (batch.num_rows + 1)
            first, starts = pieces(codes)
            base, begin = np.zeros(len(first), np.int64), np.full(len(first), pace.floor)
            for i, s in enumerate(first):  # one look per piece of a batch, not per row
                if i and own[s] == own[first[i - 1]]:
                    continue  # not the first key of its part
                k = batch.column(0)[int(s)].as_py()
                if (int(own[s]), k) == (part, key):
                    base[i], begin[i] = step, now
                elif own[s] != part and (given := state.value.get(int(own[s]))) and given[0] == k:
                    base[i], begin[i] = given[1], given[2]
            of = np.searchsorted(first, starts)
            steps = base[of] + np.arange(batch.num_rows) - starts + 1
            out = applied(scanned(maps(steps, losses_, pace), starts), begin[of])
            if batch.num_rows:
                part, key, step, now = int(own[-1]), batch.column(0)[batch.num_rows - 1].as_py(), int(steps[-1]), float(out[-1])
            yield pa.record_batch([batch.column(0), pa.array(steps), batch.column(2), pa.array(out)], names=["key", "step", "loss", "competence"])

    return ordered.select("key", "part", "loss").mapInArrow(run, f"key {kind}, step bigint, loss double, competence double")


def competence_stream(losses: DataFrame, pace: Pace = Pace()) -> DataFrame:
    """The same over a stream: (key, step, competence) after each micro-batch that has rows of the key."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        step, now = state.get if state.exists else (0, pace.floor)
        rows = pd.concat(frames).sort_values("order", kind="stable")
        for loss in rows["loss"]:
            step += 1
            now = advance(step, now, float(loss), pace)
        state.update((step, now))
        yield pd.DataFrame({"key": [key[0]], "step": [step], "competence": [now]})

    kind = losses.schema["key"].dataType.simpleString()
    rows = losses.where("key is not null and loss is not null").select("key", F.col("loss").cast("double").alias("loss"), "order")
    return rows.groupBy("key").applyInPandasWithState(update, f"key {kind}, step bigint, competence double", "step bigint, competence double", "update", "NoTimeout")


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(start, event_type, n, total) per event-time window; on a stream, rows later than ``late`` are dropped."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return rows.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
