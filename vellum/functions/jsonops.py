"""JSON out of model answers: extraction, repairs, shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.text import bound, strip

#: Chinese signs and the JSON signs they stand for.
SIGNS = ("，：；“”‘’【】（）｛｝", ",:;\"\"''[](){}")
#: Names of the repairs in the order they are tried; each works on the result of those before.
REPAIRS = ("normalize_punctuation", "fix_trailing_comma", "remove_control_characters", "fix_unclosed_brackets", "fix_single_quotes")
#: Patterns of JSON in an answer.
_FENCE = r"(?is)```(?:json)?\s*\n?(.*?)\n?```"
_ARRAY = r"(?s)\[\s*\{.*\}\s*\]"
_OBJECT = r"(?s)\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"


def extracted(text: Column) -> Column:
    """(json, method): the last fenced block, else an array of objects, an object, an empty array, or the text itself."""
    t = F.coalesce(text, F.lit(""))
    blocks = F.regexp_extract_all(t, F.lit(_FENCE), F.lit(1))
    pair = lambda j, m: F.struct(strip(j).alias("json"), F.lit(m).alias("method"))
    nothing = lambda m: F.struct(F.lit(None).cast("string").alias("json"), F.lit(m).alias("method"))
    return (
        F.when(strip(t) == "", nothing("empty_input"))
        .when(F.size(blocks) > 0, pair(F.element_at(blocks, -1), "markdown_block"))
        .when(t.rlike(_ARRAY), pair(F.regexp_extract(t, _ARRAY, 0), "array_pattern"))
        .when(t.rlike(_OBJECT), pair(F.regexp_extract(t, _OBJECT, 0), "object_pattern"))
        .when(t.contains("[]"), pair(F.lit("[]"), "empty_array"))
        .when(strip(t).rlike(r"^[\[{]"), pair(t, "raw_json"))
        .otherwise(nothing("no_json_found"))
    )


def normalize_punctuation(c: Column) -> Column:
    return F.translate(c, *SIGNS)


def fix_trailing_comma(c: Column) -> Column:
    return F.regexp_replace(c, r",\s*([\]}])", "$1")


def remove_control_characters(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def fix_unclosed_brackets(c: Column) -> Column:
    """Appends as many closing braces, then brackets, as are missing by count."""
    n = lambda sign: F.char_length(c) - F.char_length(F.replace(c, F.lit(sign), F.lit("")))
    missing = lambda o, x: F.repeat(F.lit(x), F.greatest(F.lit(0), n(o) - n(x)))
    return F.concat(c, missing("{", "}"), missing("[", "]"))


def fix_single_quotes(c: Column) -> Column:
    """Keys between single quotes get double ones."""
    return F.regexp_replace(c, r"'([^']+)'(\s*:)", '"$1"$2')


def value(json: Column) -> Column:
    """The variant of a text that is one JSON value and nothing else; null otherwise.

    The parser stops at the end of a value and lets text after it pass, so the
    text is read as the only element of a list.
    """
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), json, F.lit("]"))), "$", "array<variant>")
    return F.when(F.size(listed) == 1, F.get(listed, F.lit(0)))


def ladder(json: Column) -> Column:
    """The text as it is and after each further repair; every rung is computed once."""
    repairs = [normalize_punctuation, fix_trailing_comma, remove_control_characters, fix_unclosed_brackets, fix_single_quotes]

    def climb(rungs: list[Column]) -> Column:
        if len(rungs) > len(repairs):
            return F.array(*rungs)
        return bound(repairs[len(rungs) - 1](rungs[-1]), lambda x: climb([*rungs, x]))

    return bound(json, lambda x: climb([x]))


def parsed(json: Column) -> Column:
    """(json, n_repairs): the first rung of the ladder that is valid JSON; null if none is.

    A rung is climbed only where those below are not valid, and each repair is
    written into the plan once.
    """
    repairs = [normalize_punctuation, fix_trailing_comma, remove_control_characters, fix_unclosed_brackets, fix_single_quotes]

    def climb(text: Column, n: int) -> Column:
        found = F.when(value(text).isNotNull(), F.struct(text.alias("json"), F.lit(n).alias("n_repairs")))
        return found if n == len(repairs) else found.otherwise(bound(repairs[n](text), lambda x: climb(x, n + 1)))

    return bound(json, lambda x: F.when(x.isNotNull(), climb(x, 0)))


def top_kind(json: Column) -> Column:
    """array, object or other of a JSON text; null of what is no JSON."""
    kind = F.schema_of_variant(value(json))
    return F.when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").when(kind.isNotNull(), "other")


def event_texts(json: Column) -> Column:
    """JSON texts of the event objects in a value: a list's objects, an object's ``events``, or the object itself."""
    v = value(json)
    body = F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).when(
        F.try_variant_get(v, "$.events", "array<variant>").isNotNull(), F.try_variant_get(v, "$.events", "array<variant>")
    ).when(F.schema_of_variant(v).startswith("OBJECT"), F.array(v))
    texts = F.transform(F.filter(body, lambda e: e.isNotNull() & F.schema_of_variant(e).startswith("OBJECT")), lambda e: F.to_json(e))
    return F.coalesce(texts, F.array().cast("array<string>"))


def number_or_overall(json: Column, path: str) -> Column:
    """A number at a path; of an object there, its ``overall``."""
    v = F.try_parse_json(json)
    return F.coalesce(F.try_variant_get(v, path, "double"), F.try_variant_get(v, f"{path}.overall", "double"))
