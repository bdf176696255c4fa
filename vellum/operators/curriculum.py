"""Choice of negatives by difficulty: strategy mixes with floors, confusing types by distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.maths import stable_choice

#: Base shares of easy, medium and hard for weak, middle and strong learners.
BASE = ((0.6, 0.3, 0.1), (0.2, 0.5, 0.3), (0.1, 0.2, 0.7))


def mix(base: tuple[float, float, float], weights: tuple[float, float, float], floors: tuple[float, float]) -> tuple[float, float, float]:
    """Easy, medium and hard shares: base times weights, normalised, with least shares for medium and hard."""
    raw = [b * w for b, w in zip(base, weights)]
    total = sum(raw)
    easy, medium, hard = [x / total for x in raw] if total > 0 else (0.33, 0.34, 0.33)
    low_medium, low_hard = floors
    if low_medium + low_hard >= 0.98:
        low_medium, low_hard = (x / sum(floors) * 0.98 for x in floors)
    rest = (easy, max(0.0, medium - low_medium), max(0.0, hard - low_hard))
    free, held = 1 - low_medium - low_hard, sum(rest)
    if held <= 1e-8:
        return free, low_medium, low_hard
    return free * rest[0] / held, low_medium + free * rest[1] / held, low_hard + free * rest[2] / held


def shares(threshold: Column, low: float = 1.0, high: float = 4.0, easy: float = 0.6, hard: float = 0.3, weights: tuple[float, float, float] = (0.3, 0.5, 0.2), floors: tuple[float, float] = (0.1, 0.05)) -> Column:
    """(easy, medium, hard) of a learner whose distance threshold lies between ``low`` and ``high``."""
    row = lambda m: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(m, ("easy", "medium", "hard"))])
    weak, middle, strong = (mix(b, weights, floors) for b in BASE)
    span = high - low
    return F.when(threshold > low + span * easy, row(weak)).when(threshold > low + span * hard, row(middle)).otherwise(row(strong))


def confusing_types(rows: DataFrame, distances: DataFrame, key: str = "key") -> DataFrame:
    """(key, event_type, wrong) of (key, event_type, strategy, threshold) rows.

    Easy takes a type at least as far as the threshold, else the farthest; hard
    one at most as far, else the nearest; medium any other type. Among those the
    key's hash picks. ``distances`` has (a, b, distance) of all types.
    """
    others = distances.where("a <> b").groupBy("a").agg(F.array_sort(F.collect_list(F.struct("distance", "b"))).alias("os"))
    j = rows.join(F.broadcast(others), rows["event_type"] == others["a"])
    far, near = F.array_max(F.transform("os", lambda o: o["distance"])), F.array_min(F.transform("os", lambda o: o["distance"]))
    names = lambda keep: F.transform(F.filter("os", keep), lambda o: o["b"])
    easy = names(lambda o: o["distance"] >= F.least(F.col("threshold"), far))
    hard = names(lambda o: o["distance"] <= F.greatest(F.col("threshold"), near))
    pool = F.when(F.col("strategy") == "EASY", easy).when(F.col("strategy") == "HARD", hard).otherwise(names(lambda o: F.lit(True)))
    return j.select(key, "event_type", stable_choice(pool, F.concat_ws(":", F.col(key).cast("string"), "event_type")).alias("wrong"))


def swapped_arguments(arguments: Column) -> Column:
    """The first two values exchanged; a single one gets a marker."""
    a = lambda role, value: F.struct(role.alias("role"), value.alias("argument"))
    first, second = F.get(arguments, F.lit(0)), F.get(arguments, F.lit(1))
    two = F.concat(F.array(a(first["role"], second["argument"]), a(second["role"], first["argument"])), F.slice(arguments, F.lit(3), F.greatest(F.size(arguments), F.lit(1))))
    return F.when(F.size(arguments) > 1, two).when(F.size(arguments) == 1, F.array(a(first["role"], F.concat(first["argument"], F.lit("（相关）"))))).otherwise(arguments)
