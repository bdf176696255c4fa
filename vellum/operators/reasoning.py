"""What an answer's reasoning says against what its events say, structure checks, text windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import has_any, normalize, thought_text
from vellum.operators.arguments import event_type_list

#: How reasoning says that there is no event.
NO_EVENT_CLUES = ("无事件", "未检测到", "没有检测到", "输出[]", "空数组")


def thought_pairs(thought: Column) -> Column:
    """Distinct role=value texts that lines of the reasoning state."""
    line = r'([^\s:：=]+)\s*[:：=]\s*["“]?([^"”\n]+)["”]?'
    found = F.transform(F.filter(F.split(thought, r"\n"), lambda x: x.rlike(line)), lambda x: F.struct(normalize(F.regexp_extract(x, line, 1)).alias("r"), normalize(F.regexp_extract(x, line, 2)).alias("v")))
    return F.array_distinct(F.transform(F.filter(found, lambda p: (p["r"] != "") & (p["v"] != "")), lambda p: F.concat_ws("\x1f", p["r"], p["v"])))


def event_pairs(events: Column) -> Column:
    """Distinct role=value texts of an event list."""
    real = F.filter(F.coalesce(events, F.array()), lambda e: e.isNotNull() & e["arguments"].isNotNull())
    args = F.flatten(F.transform(real, lambda e: F.filter(e["arguments"], lambda a: a.isNotNull())))
    pairs = F.transform(args, lambda a: F.struct(normalize(F.coalesce(a["role"], F.lit(""))).alias("r"), normalize(F.coalesce(a["argument"], F.lit(""))).alias("v")))
    return F.array_distinct(F.transform(F.filter(pairs, lambda p: (p["r"] != "") & (p["v"] != "")), lambda p: F.concat_ws("\x1f", p["r"], p["v"])))


def consistency(results: DataFrame, mode: str = "strict_span", require_block: bool = False, key: str = "result_id") -> DataFrame:
    """(key, checked, type_consistent, argument_consistent): nothing is checked without reasoning.

    ``strict_span`` asks for the very pairs, ``weak_mention`` for roles only.
    """
    if mode not in ("strict_span", "weak_mention"):
        raise ValueError(f"unknown mode {mode}")
    rows = results.select(key, thought_text(F.coalesce("raw_response", F.lit("")), require_block).alias("t"), F.coalesce(event_type_list(F.col("prediction")), F.array().cast("array<string>")).alias("types"), event_pairs(F.col("prediction")).alias("pairs"))
    rows = rows.withColumn("said", thought_pairs(F.coalesce("t", F.lit("")))).withColumn("none", has_any(F.coalesce("t", F.lit("")), NO_EVENT_CLUES))
    named = F.forall("types", lambda x: F.col("t").contains(x))
    kinds = F.when(F.size("types") == 0, True).otherwise(named)
    role = lambda c: F.transform(c, lambda p: F.substring_index(p, "\x1f", 1))
    held = F.size(F.array_except("pairs", "said")) == 0 if mode == "strict_span" else F.size(F.array_except(role("pairs"), role("said"))) == 0
    arguments = F.when(F.size("pairs") == 0, (F.size("said") == 0) | F.col("none")).otherwise(held)
    there = F.col("t").isNotNull()
    return rows.select(key, there.alias("checked"), F.when(there, kinds).alias("type_consistent"), F.when(there, arguments).alias("argument_consistent"))


def counterfactual_passed(events: Column, old: Column, new: Column) -> Column:
    """The new value is among the arguments and the old one is not; null where either is empty."""
    values = F.transform(event_pairs(events), lambda p: F.substring_index(p, "\x1f", -1))
    a, b = normalize(old), normalize(new)
    return F.when((a != "") & (b != ""), F.array_contains(values, b) & ~F.array_contains(values, a))


def sentence(events: Column) -> Column:
    """Events as a statement in Chinese."""
    def one(e: Column) -> Column:
        args = F.filter(F.coalesce(e["arguments"], F.array().cast("array<struct<role:string,argument:string>>")), lambda a: a.isNotNull() & (F.coalesce(a["role"], F.lit("")) != "") & (F.coalesce(a["argument"], F.lit("")) != ""))
        said = F.array_join(F.transform(args, lambda a: F.concat(a["role"], F.lit("为"), a["argument"])), "，")
        head = F.concat(F.lit("发生了"), F.coalesce(e["event_type"], F.lit("未知事件")), F.lit("事件"))
        return F.when(F.size(args) > 0, F.concat(head, F.lit("，其中"), said)).otherwise(head)

    real = F.filter(F.coalesce(events, F.array()), lambda e: e.isNotNull())
    return F.when(F.size(real) > 0, F.concat(F.array_join(F.transform(real, one), "。"), F.lit("。"))).otherwise("")


def structure_errors(payloads: DataFrame, path: str = "$.prediction", key: str = "line_id", payload: str = "payload") -> DataFrame:
    """(key, event_idx, arg_idx, code) of every flaw in the shape of a JSON event list; arg_idx -1 for the event."""
    body = F.try_variant_get(F.try_parse_json(payload), path, "variant")
    rows = payloads.select(key, body.alias("v")).where("v is not null")
    is_list = F.schema_of_variant("v").startswith("ARRAY")
    root = rows.where(~is_list).select(key, F.lit(-1).alias("event_idx"), F.lit(-1).alias("arg_idx"), F.lit("root_not_list").alias("code"))
    items = rows.where(is_list).select(key, F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("event_idx", "e"))
    obj = F.coalesce(F.schema_of_variant("e").startswith("OBJECT"), F.lit(False))
    args = F.try_variant_get("e", "$.arguments", "variant")
    items = items.select(key, "event_idx", obj.alias("obj"), F.try_variant_get("e", "$.event_type", "variant").alias("t"), args.alias("a"))
    listed = F.coalesce(F.schema_of_variant("a").startswith("ARRAY"), F.lit(False))
    head = items.select(key, "event_idx", F.lit(-1).alias("arg_idx"), F.explode(F.array_compact(F.array(F.when(~F.col("obj"), "event_not_object"), F.when(F.col("obj") & F.col("t").isNull(), "missing_event_type"), F.when(F.col("obj") & F.col("a").isNotNull() & ~listed, "arguments_not_list")))).alias("code"))
    each = items.where(listed).select(key, "event_idx", F.posexplode(F.try_variant_get("a", "$", "array<variant>")).alias("arg_idx", "x"))
    ok = F.coalesce(F.schema_of_variant("x").startswith("OBJECT"), F.lit(False))
    has = lambda n: F.try_variant_get("x", f"$.{n}", "variant").isNotNull()
    tail = each.select(key, "event_idx", "arg_idx", F.explode(F.array_compact(F.array(F.when(~ok, "argument_not_object"), F.when(ok & ~has("role"), "missing_role"), F.when(ok & ~has("argument"), "missing_argument")))).alias("code"))
    return root.unionByName(head).unionByName(tail)


def window_starts(length: Column, size: Column, least: int = 50) -> Column:
    """Starts of half-overlapping windows over a text: one for a text that fits, else up to the first that reaches the end; a tail under ``least`` is left to the one before."""
    step = F.greatest(F.floor(size / 2).cast("int"), F.lit(100))
    last = F.ceil(F.greatest(length - size, F.lit(0)) / step).cast("int") * step
    starts = F.when(length <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), last, step))
    return F.filter(starts, lambda s: (s == 0) | (F.least(size, length - s) >= least))


def window_size(statement: Column, room: int = 512, extra: int = 20, smallest: int = 100) -> Column:
    """Room that a statement of so many characters leaves for the text beside it."""
    return F.greatest(F.lit(smallest), F.lit(room - extra) - statement).cast("int")


def text_windows(df: DataFrame, key: str, text: str, statement: Column) -> DataFrame:
    """(key, start, window): windows of a text, sized by the ``statement`` that is checked against it; a null or empty text has none."""
    rows = df.where(F.char_length(text) > 0).select(key, text, window_size(F.coalesce(F.char_length(statement), F.lit(0))).alias("size"))
    rows = rows.select(key, text, "size", F.explode(window_starts(F.char_length(text), F.col("size"))).alias("start"))
    return rows.select(key, "start", F.substring(text, F.col("start") + 1, F.col("size")).alias("window"))


