"""Fragments of a value joined back to the span of the text they came from, and cues around a value.

All are columns over an array of fragments and a text: a fold over the array,
with no Python. The words (connectors, units, cues) are parameters. A null text,
fewer than two fragments, or fragments that the text does not hold give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs at the ends of a span that do not belong to it.
ENDS = "，。；：:;, "


def ordered_span(values: Column, text: Column, connector: str) -> Column:
    """The stretch of text from the first fragment to the last, where they follow one another and ``connector`` stands between or in them."""
    zero = F.struct(F.lit(1).alias("at"), F.lit(0).alias("first"), F.lit(True).alias("ok"))

    def step(s: Column, v: Column) -> Column:
        at = F.position(v, text, s["at"]).cast("int")
        return F.struct((at + F.char_length(v)).alias("at"), F.when(s["first"] > 0, s["first"]).otherwise(at).alias("first"), (s["ok"] & (at > 0) & (v != "")).alias("ok"))

    walked = F.aggregate(values, zero, step)
    span = F.btrim(F.substring(text, walked["first"], walked["at"] - walked["first"]), F.lit(ENDS))
    whole = F.forall(values, lambda v: span.contains(v))
    return F.when((F.size(values) > 1) & walked["ok"] & (span != F.get(values, F.lit(0))) & whole & span.rlike(connector), span)


def joined_amount(values: Column, text: Column, amount: str = r"^([\d,]*\d(?:\.\d+)?)(\D+)$") -> Column:
    """Digit groups and a last one with a unit as the one amount that the text holds, with or without thousands separators.

    ``amount`` has two groups: the number and its unit. Fragments are taken in
    the order in which the text holds them.
    """
    placed = F.array_sort(F.transform(values, lambda v: F.struct(F.position(v, text).cast("int").alias("at"), v.alias("v"))))
    ordered = F.transform(placed, lambda x: x["v"])
    last = F.regexp_replace(F.element_at(ordered, -1), " ", "")
    groups = F.transform(F.slice(ordered, F.lit(1), F.greatest(F.size(ordered) - 1, F.lit(0))), lambda v: F.trim(F.regexp_replace(v, ",", "")))
    number, unit = F.regexp_replace(F.regexp_extract(last, amount, 1), ",", ""), F.trim(F.regexp_extract(last, amount, 2))
    every = F.array_append(groups, F.substring_index(number, ".", 1))
    rest = F.concat(F.when(number.contains("."), F.concat(F.lit("."), F.substring_index(number, ".", -1))).otherwise(""), unit)
    sound = (F.size(values) > 1) & F.forall(placed, lambda x: x["at"] > 0) & F.forall(every, lambda d: d.rlike(r"^\d+$")) & (unit != "")
    tries = F.array(F.concat(F.array_join(every, ","), rest), F.concat(F.array_join(every, ""), rest))
    return F.when(sound, F.get(F.filter(tries, lambda c: text.contains(c)), F.lit(0)))


def cued(text: Column, value: Column, *cues: str, reach: int = 16) -> Column:
    """Whether around some occurrence of the value, within ``reach`` characters, each of the patterns ``cues`` stands."""
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.char_length(text), F.lit(1))), lambda i: F.substring(text, i, F.char_length(value)) == value)
    window = lambda i: F.substring(text, F.greatest(i - reach, F.lit(1)), F.char_length(value) + reach + F.least(i - 1, F.lit(reach)))

    def all_of(i: Column) -> Column:
        out = F.lit(True)
        for c in cues:
            out = out & window(i).rlike(c)
        return out

    return F.when(value != "", F.exists(places, all_of)).otherwise(False)


def gate(reasons: Column, mode: str, verdict: Column | None = None) -> Column:
    """(mode, triggered, reasons, calls, verified): the light gate before a costly verifier.

    ``off`` ignores the reasons, ``trigger_only`` records them, ``verify_triggered``
    takes the ``verdict`` of rows that have any; without a verdict none is called.
    """
    if mode not in ("off", "trigger_only", "verify_triggered"):
        raise ValueError(f"unknown mode {mode}")
    none = F.array().cast("array<string>")
    known = F.coalesce(reasons, none) if mode != "off" else none
    hit = F.size(known) > 0
    asked = hit & verdict.isNotNull() if mode == "verify_triggered" and verdict is not None else F.lit(False)
    return F.struct(F.lit(mode).alias("mode"), hit.alias("triggered"), known.alias("reasons"), asked.cast("int").alias("calls"), (F.when(asked, verdict) if verdict is not None else F.lit(None).cast("boolean")).alias("verified"))
