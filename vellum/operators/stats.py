"""Resampling and significance, without a random number generator: all draws are hashes of their place."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.maths import nearest_rank, safe_div
from vellum.operators.metrics import COUNTED

#: Cumulative probabilities of 0, 1, 2, … events at rate 1.
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(16)]
KINDS = ("tp", "pred_total", "gold_total")
#: Scores whose counts are resampled: those of all documents, and the role scores of documents with one and with more gold events.
SCORES = (*COUNTED, "single", "multi")
#: Least number of pairs for a test, most for all signs, and draws beyond.
LEAST_PAIRS, MOST_SIGNS, DRAWS = 2, 20, 10_000
_STEP = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def poisson_weights(hashes: np.ndarray, draws: int) -> np.ndarray:
    """How often each row is taken in each draw: Poisson numbers of rate 1 from the row's hash and the draw as a counter."""
    counters = (np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(_STEP))[None, :]
    u = (_mixed(hashes[:, None] + counters) >> np.uint64(11)).astype(np.float64) * 2.0**-53
    return np.searchsorted(np.array(POISSON), u, side="right").astype(np.float64)


def key_hash(key: Column, seed: int) -> Column:
    """First 64 bits of the SHA-256 of seed and key, as a signed number."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string")), 256)
    part = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint")
    return F.shiftleft(part(1), 32).bitwiseOR(part(9))


def bootstrap(counts: DataFrame, key: str = "doc_id", draws: int = 1000, seed: int = 3407, names: tuple[str, ...] = SCORES) -> DataFrame:
    """(draw, and precision, recall and f1 of each of ``names``) of resampled documents.

    ``counts`` has the columns of ``sample_counts`` that ``names`` need. A
    document is taken a Poisson number of times in each draw, which needs
    neither the number of documents nor a shuffle of them. One hash is computed
    per document and varied by the number of the draw; the weighted sums of a
    batch are one matrix product, and a task exchanges one row per draw.
    """
    single, multi = F.col("gold_event_count") == 1, F.col("gold_event_count") > 1
    of = lambda n, k: F.when(single if n == "single" else multi, F.col(f"doc_role_{k}")).otherwise(0) if n in ("single", "multi") else F.col(f"{n}_{k}")
    columns = [f"{n}_{k}" for n in names for k in KINDS]
    rows = counts.select(key_hash(F.col(key), seed).alias("h"), *[F.coalesce(of(n, k), F.lit(0)).cast("double").alias(f"{n}_{k}") for n in names for k in KINDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((draws, len(columns)))
        step = max(1, 2_000_000 // draws)
        for batch in batches:
            values = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1)
            hashes = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for s in range(0, len(values), step):
                total += poisson_weights(hashes[s : s + step], draws).T @ values[s : s + step]
        sums = np.rint(total).astype(np.int64)
        yield pa.record_batch([pa.array(np.arange(draws, dtype=np.int32)), *(pa.array(sums[:, i]) for i in range(len(columns)))], names=["draw", *columns])

    summed = rows.mapInArrow(run, "draw int, " + ", ".join(f"{c} bigint" for c in columns)).groupBy("draw").agg(*[F.sum(c).alias(c) for c in columns])
    out = []
    for n in names:
        p, r = safe_div(F.col(f"{n}_tp"), F.col(f"{n}_pred_total")), safe_div(F.col(f"{n}_tp"), F.col(f"{n}_gold_total"))
        out += [p.alias(f"{n}_precision"), r.alias(f"{n}_recall"), safe_div(F.lit(2.0) * p * r, p + r).alias(f"{n}_f1")]
    return summed.select("draw", *out)


def interval(drawn: DataFrame, confidence: float = 0.95) -> DataFrame:
    """(metric, n_draws, mean, std, low, high): mean, sample deviation and nearest-rank range of every score over the draws."""
    scores = [c for c in drawn.columns if c != "draw"]
    alpha = (1 - confidence) / 2
    s = drawn.unpivot("draw", scores, "metric", "value").groupBy("metric").agg(
        F.count("*").alias("n_draws"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.array_sort(F.collect_list("value")).alias("v"))
    return s.select("metric", "n_draws", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"), nearest_rank(F.col("v"), alpha).alias("low"), nearest_rank(F.col("v"), 1 - alpha).alias("high"))


def drawn_signs(differences: np.ndarray, draws: int, seed: int) -> int:
    """In how many draws of hashed signs the mean of the differences is as far from 0 as their own."""
    n = len(differences)
    observed = abs(differences.sum() / n)
    hits, step = 0, max(1, 4_000_000 // n)
    places = np.arange(n, dtype=np.uint64) * np.uint64(_STEP)
    for s in range(0, draws, step):
        at = (np.arange(s, min(draws, s + step), dtype=np.uint64) + np.uint64(seed)) * np.uint64(0xD1342543DE82EF95)
        signs = np.where(_mixed(_mixed(at)[:, None] + places[None, :]) >> np.uint64(63), 1.0, -1.0)
        hits += int((np.abs(signs @ differences / n) >= observed - 1e-12).sum())
    return hits


def permutation(pairs: DataFrame, by: list[str], draws: int = DRAWS, seed: int = 3407) -> DataFrame:
    """(by, n_pairs, mean_diff, p_value, method, n_permutations, status) of a two-sided paired test.

    ``pairs`` has ``by``, baseline and improved; pairs with a null count for
    nothing. Up to 20 pairs go through all signs of the differences, more through
    ``draws`` hashed ones; fewer than two get no p-value but a status. A group
    holds one number per pair of runs, so it is small whatever the data.
    """
    d = pairs.select(*by, (F.col("improved") - F.col("baseline")).alias("d")).where("d is not null")
    g = d.groupBy(*by).agg(F.array_sort(F.collect_list("d")).alias("ds"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    g = g.withColumn("n", F.size("ds")).withColumn("observed", F.abs(total("ds") / F.col("n")))
    ok = (F.col("n") >= LEAST_PAIRS) & (F.col("n") <= MOST_SIGNS)
    signs = g.where(ok).select(*by, "ds", "n", "observed", F.explode(F.sequence(F.lit(0).cast("bigint"), F.pow(F.lit(2), F.col("n")).cast("bigint") - 1)).alias("mask"))
    signed = F.transform("ds", lambda x, i: F.when(F.getbit(F.col("mask"), i) == 1, x).otherwise(-x))
    hit = F.abs(total(signed) / F.col("n")) >= F.col("observed") - 1e-12
    exact = signs.groupBy(*by).agg((F.count_if(hit) / F.count("*")).alias("exact"))

    @F.arrow_udf("double")
    def drawn(ds: pa.Array) -> pa.Array:
        return pa.array([None if x is None else drawn_signs(np.array(x), draws, seed) / draws for x in ds.to_pylist()], pa.float64())

    many = F.col("n") > MOST_SIGNS
    out = g.join(exact, by, "left").withColumn("drawn", drawn(F.when(many, F.col("ds"))))
    method = F.when(many, "monte_carlo").when(F.col("n") >= LEAST_PAIRS, "exact")
    tries = F.when(many, F.lit(draws).cast("bigint")).when(F.col("n") >= LEAST_PAIRS, F.pow(F.lit(2), F.col("n")).cast("bigint"))
    status = F.when(F.col("n") < LEAST_PAIRS, "too_few_pairs").otherwise("tested")
    return out.select(*by, F.col("n").alias("n_pairs"), (total("ds") / F.col("n")).alias("mean_diff"), F.coalesce("exact", "drawn").alias("p_value"), method.alias("method"), tries.alias("n_permutations"), status.alias("status"))


def significance_metadata(tests: DataFrame, *by: str, least: int = LEAST_PAIRS) -> DataFrame:
    """(by, min_pairs, observed_pairs, status, reason): whether the comparisons of each group have pairs enough.

    ``tests`` has one row per comparison with n_pairs. Without ``by`` an empty
    table gives the one row that says so.
    """
    s = tests.groupBy(*by).agg(F.min("n_pairs").cast("int").alias("observed_pairs"))
    none, few = F.col("observed_pairs").isNull(), F.col("observed_pairs") < least
    status = F.when(none, "skipped_no_complete_pairs").when(few, "skipped_insufficient_pairs").otherwise("computed")
    reason = F.when(none, "no complete pairs were available").when(few, F.format_string(f"a paired test needs at least {least} pairs for each comparison; observed %d", "observed_pairs"))
    return s.select(*by, F.lit(least).alias("min_pairs"), "observed_pairs", status.alias("status"), reason.alias("reason"))


def findings(runs: DataFrame, name: str, metrics: dict[str, str], reference: str) -> DataFrame:
    """(name, metric, delta, finding): in words, how each run compares with the reference run in each of ``metrics`` (column: label)."""
    long = runs.unpivot(name, list(metrics), "metric", "value")
    base = long.where(F.col(name) == reference).select("metric", F.col("value").alias("base"))
    labels = F.create_map(*[F.lit(x) for pair in metrics.items() for x in pair])
    delta = F.round(F.col("value") - F.col("base"), 6)
    word = F.when(delta > 0, "higher").when(delta < 0, "lower").when(delta == 0, "equal")
    text = F.concat(F.col(name), F.lit(": "), labels[F.col("metric")], F.lit(" is "), word, F.when(delta != 0, F.concat(F.lit(" by "), F.format_number(F.abs(delta), 4))).otherwise(""), F.lit(f" (reference {reference})"))
    # the reference has one row per metric: a list of fixed size
    return long.where(F.col(name) != reference).join(F.broadcast(base), "metric").select(name, "metric", delta.alias("delta"), text.alias("finding"))
