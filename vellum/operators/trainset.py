"""Training rows from annotated texts: stages, negatives, consensus of two sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.maths import stable_choice, uniform
from vellum.functions.text import strip
from vellum.operators.arguments import event_type_list, filled
from vellum.operators.matching import dice


def expand_stages(df: DataFrame, mode: str, key: str = "row_id", events: str = "events") -> DataFrame:
    """(key, stage, event_type, n_events): one row for a single pass, two for two stages, one more per type for typed stages."""
    types = F.coalesce(event_type_list(F.col(events)), F.array().cast("array<string>"))
    real = F.coalesce(F.filter(events, lambda e: e.isNotNull()), F.array())
    n = lambda c: F.size(c).cast("bigint")
    row = lambda s, t, k: F.struct(F.lit(s).alias("stage"), t.alias("event_type"), k.alias("n_events"))
    none = F.lit(None).cast("string")
    if mode == "single_pass":
        rows = F.array(row("single_pass", none, n(real)))
    elif mode == "two_stage":
        rows = F.array(row("stage1", none, n(types)), row("stage2", none, n(real)))
    elif mode == "two_stage_per_type":
        of = lambda t: n(F.filter(real, lambda e: strip(F.coalesce(e["event_type"], F.lit(""))) == t))
        rows = F.concat(F.array(row("stage1", none, n(types))), F.transform(types, lambda t: row("stage2_typed", t, of(t))))
    else:
        raise ValueError(f"unknown stage mode {mode}")
    return df.select(key, F.inline(rows))


def negative_types(key: Column, gold: Column, universe: list[str]) -> Column:
    """Wrong types for a row: for each gold one a hash-chosen other; for none one of all."""
    every = F.array(*map(F.lit, universe))
    others = F.array_except(every, gold)
    swapped = F.array_distinct(F.transform(gold, lambda t, i: stable_choice(others, F.concat_ws(":", key, t, i.cast("string")))))
    kept = F.when(F.size(others) > 0, swapped).otherwise(F.slice(gold, 1, F.greatest(F.size(gold) - 1, F.lit(0))))
    return F.when(F.size(gold) == 0, F.array(stable_choice(every, F.concat_ws(":", key, F.lit("negative-empty"))))).otherwise(kept)


def strategy(key: Column, weights: tuple[float, float, float]) -> Column:
    """EASY, MEDIUM or HARD by the hash of a key."""
    u, total = uniform(key), sum(weights)
    return F.when(u < weights[0] / total, "EASY").when(u < (weights[0] + weights[1]) / total, "MEDIUM").otherwise("HARD")


#: Shares of easy, medium and hard negatives for low, middle and high competence.
REGIMES = ((0.7, 0.2, 0.1), (0.2, 0.4, 0.4), (0.1, 0.15, 0.75))


def paced_strategy(key: Column, threshold: Column, diameter: float = 4.0, easy: float = 0.7, hard: float = 0.4) -> Column:
    """``strategy`` by the regime of a distance threshold: above ``easy`` of the diameter, above ``hard`` of it, or below."""
    return F.when(threshold > easy * diameter, strategy(key, REGIMES[0])).when(threshold > hard * diameter, strategy(key, REGIMES[1])).otherwise(strategy(key, REGIMES[2]))


def nudged_number(value: Column, key: Column) -> Column:
    """A value with its first whole number moved by 1, 10 or 100; a value without one loses its last character."""
    digits = F.regexp_extract(value, r"(\d{1,15})", 1)
    steps = F.array(*[F.lit(x).cast("bigint") for x in (1, 10, 100, -1, -10)])
    step = F.element_at(steps, (F.floor(uniform(key) * 5) + 1).cast("int"))
    moved = F.abs(F.try_to_number(digits, F.lit("999999999999999")).cast("bigint") + step).cast("string")
    return F.when(
        digits != "", F.concat(F.regexp_extract(value, r"^(\D*)", 1), moved, F.regexp_extract(value, r"^\D*\d{1,15}(.*)$", 1))
    ).otherwise(F.substring(value, F.lit(1), F.greatest(F.char_length(value) - 1, F.lit(1))))


def consensus(primary: DataFrame, secondary: DataFrame, texts: DataFrame, least: float = 0.5) -> DataFrame:
    """(sample_id, reason, agreement): the first reason against keeping a row, ``kept`` for none.

    Both sides have sample_id, parse_success, events; texts have sample_id, text.
    Agreement is measured before it is judged, so means can include rejects.
    """
    p = primary.select("sample_id", F.col("parse_success").alias("p_ok"), F.col("events").alias("p_events"))
    s = secondary.select("sample_id", F.col("parse_success").alias("s_ok"), F.col("events").alias("s_events"), F.lit(True).alias("there"))
    j = p.join(s, "sample_id", "left").join(texts.where(filled("text")).select("sample_id", F.lit(True).alias("has_text")), "sample_id", "left")
    keys = lambda c: F.array_distinct(F.flatten(F.transform(F.filter(c, lambda e: e.isNotNull() & e["arguments"].isNotNull()), lambda e: F.transform(
        F.filter(e["arguments"], lambda a: a.isNotNull()), lambda a: F.concat_ws("\x1f", strip(F.coalesce(e["event_type"], F.lit(""))), strip(F.coalesce(a["role"], F.lit(""))), strip(F.coalesce(a["argument"], F.lit(""))))))))
    types = lambda c: F.array_sort(event_type_list(c))
    n = lambda c: F.coalesce(F.size(F.filter(c, lambda e: e.isNotNull())), F.lit(0))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    agree = dice(keys(F.col("p_events")), keys(F.col("s_events")))
    early = (
        F.when(F.coalesce(F.col("sample_id"), F.lit("")) == "", "missing_id").when(no(F.col("p_ok")), "primary_parse_failed").when(n(F.col("p_events")) <= 0, "primary_empty_prediction")
        .when(no(F.col("has_text")), "missing_source_text").when(no(F.col("there")), "missing_secondary_row").when(no(F.col("s_ok")), "secondary_parse_failed")
        .when(n(F.col("s_events")) <= 0, "secondary_empty_prediction").when(types(F.col("p_events")) != types(F.col("s_events")), "event_type_mismatch")
    )
    out = j.select("sample_id", early.alias("early"), F.when(early.isNull(), F.round(agree, 6)).alias("agreement"))
    return out.select("sample_id", F.coalesce("early", F.when(F.col("agreement") < least, "insufficient_role_overlap"), F.lit("kept")).alias("reason"), "agreement")
