"""Arithmetic, scores, deterministic choices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(a: Column, b: Column) -> Column:
    """a / b as a double; 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def precision(tp: Column, fp: Column) -> Column:
    return safe_div(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return safe_div(tp, tp + fn)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """Harmonic mean of precision and recall, from counts."""
    p, r = precision(tp, fp), recall(tp, fn)
    return safe_div(F.lit(2.0) * p * r, p + r)


def prf(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> list[Column]:
    """precision, recall and f1 columns of three count columns."""
    t, p, n = F.col(tp), F.col(fp), F.col(fn)
    return [precision(t, p).alias("precision"), recall(t, n).alias("recall"), f1(t, p, n).alias("f1")]


def sigmoid(x: Column) -> Column:
    """Logistic function without overflow at either end."""
    return F.when(x >= 0, F.lit(1.0) / (F.lit(1.0) + F.exp(-x))).otherwise(F.exp(x) / (F.lit(1.0) + F.exp(x)))


def linear_threshold(competence: Column, low: float = 1.0, high: float = 4.0) -> Column:
    """From ``high`` at competence 0 to ``low`` at 1."""
    return F.lit(high) - (F.lit(high - low)) * competence


def root_pacing(step: Column, total: Column, start: float = 0.1) -> Column:
    """Share of the curriculum open at a step: square-root growth from ``start`` to 1."""
    share = F.least(F.lit(1.0), safe_div(step, total))
    return F.least(F.lit(1.0), F.sqrt(share * F.lit(1 - start**2) + F.lit(start**2)))


def pacing_threshold(step: Column, total: Column, low: float = 1.0, high: float = 4.0, start: float = 0.1) -> Column:
    """Distance threshold of a curriculum: from ``high`` at the start to ``low`` at the end, by ``root_pacing``. ``total`` of 0 or less counts as 1."""
    return F.lit(high) - F.lit(high - low) * root_pacing(step, F.greatest(total, F.lit(1)), start)


def competence_weight(competence: Column, beta: float = 0.2) -> Column:
    return F.lit(1.0) + F.lit(beta) * (F.lit(1.0) - competence)


def warmup_weight(step: Column, alpha: float, warmup: int) -> Column:
    """Linear warm-up to ``alpha``."""
    return F.lit(alpha) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), step / F.lit(float(max(warmup, 1)))))


def margin_bucket(margin: Column) -> Column:
    """Offset of a preference margin."""
    return F.when(margin < 0.08, 0.4).when(margin < 0.16, 0.3).when(margin < 0.30, 0.2).otherwise(0.1)


def max_steps(rows: Column, batch: int, accumulate: int, epochs: int) -> Column:
    """Optimizer steps of a run over ``rows``."""
    per_epoch = F.ceil(F.ceil(rows / F.lit(batch)) / F.lit(accumulate))
    return F.greatest(F.lit(1), per_epoch * F.lit(epochs)).cast("bigint")


def stable_number(key: Column) -> Column:
    """First 32 bits of the SHA-256 of a string, as a number."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint")


def stable_choice(options: Column, key: Column) -> Column:
    """One of the sorted options, picked by the hash of a key; null of none."""
    return F.when(F.size(options) > 0, F.element_at(F.array_sort(options), (F.pmod(stable_number(key), F.size(options).cast("bigint")) + 1).cast("int")))


def uniform(key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return stable_number(key) / F.lit(4294967296.0)


def nearest_rank(values: Column, p: float) -> Column:
    """Nearest-rank percentile of a sorted array; the rank is rounded half to even."""
    at = F.bround((F.size(values) - 1) * F.lit(p)).cast("int") + 1
    return F.when(F.size(values) > 0, F.element_at(values, at))
