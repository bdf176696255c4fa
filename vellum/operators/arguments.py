"""Events as tables: arguments, triplets, records, signatures.

``results`` has a document key and two event lists, gold and pred. All tables
carry the document and the side; list positions are kept, so order survives any
shuffle. Null lists give no rows, null elements are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import bound, normalize, strip


def sides(results: DataFrame, key: str = "result_id", gold: str = "ground_truth", pred: str = "prediction", carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *carried, side, events): both lists of every row, with the other columns named in ``carried``."""
    both = F.array(F.struct(F.lit("gold").alias("side"), F.col(gold).alias("events")), F.struct(F.lit("pred").alias("side"), F.col(pred).alias("events")))
    return results.select(F.col(key).alias("doc_id"), *carried, F.inline(both))


def events(results: DataFrame, carried: tuple[str, ...] = (), **columns: str) -> DataFrame:
    """(doc_id, *carried, side, event_idx, event_type, trigger, arguments)."""
    rows = sides(results, carried=carried, **columns).select("doc_id", *carried, "side", F.posexplode("events").alias("event_idx", "e"))
    return rows.where("e is not null").select("doc_id", *carried, "side", "event_idx", "e.event_type", "e.trigger", "e.arguments")


def arguments(results: DataFrame, carried: tuple[str, ...] = (), **columns: str) -> DataFrame:
    """(doc_id, *carried, side, event_idx, arg_idx, event_type, trigger, role, argument)."""
    rows = events(results, carried, **columns).select("doc_id", *carried, "side", "event_idx", "event_type", "trigger", F.posexplode("arguments").alias("arg_idx", "a"))
    return rows.where("a is not null").select("doc_id", *carried, "side", "event_idx", "arg_idx", "event_type", "trigger", "a.role", "a.argument")


def filled(*names: str) -> Column:
    """All the columns are neither null nor empty."""
    out = F.lit(True)
    for n in names:
        out = out & F.coalesce(F.col(n) != "", F.lit(False))
    return out


def strict_triplets(args: DataFrame) -> DataFrame:
    """Distinct (doc_id, side, event_type, role, argument) with the argument in evaluation form."""
    rows = args.where(filled("event_type", "role", "argument")).withColumn("argument", normalize(F.col("argument")))
    return rows.where("argument <> ''").select("doc_id", "side", "event_type", "role", "argument").distinct()


def strict_keys(events_column: Column) -> Column:
    """Distinct (event_type, role, argument) of an event list, as ``strict_triplets`` but inside the row."""
    some = lambda c: F.coalesce(c != "", F.lit(False))
    real = F.filter(F.coalesce(events_column, F.array()), lambda e: e.isNotNull() & some(e["event_type"]) & e["arguments"].isNotNull())

    def args(e: Column) -> Column:
        full = F.filter(e["arguments"], lambda a: a.isNotNull() & some(a["role"]) & some(a["argument"]))
        return F.transform(full, lambda a: F.struct(e["event_type"].alias("event_type"), a["role"].alias("role"), normalize(a["argument"]).alias("argument")))

    return F.array_distinct(F.filter(F.flatten(F.transform(real, args)), lambda k: k["argument"] != ""))


def type_keys(events_column: Column) -> Column:
    """Distinct non-empty (event_type) of an event list, unstripped."""
    real = F.filter(F.coalesce(events_column, F.array()), lambda e: e.isNotNull() & F.coalesce(e["event_type"] != "", F.lit(False)))
    return F.array_distinct(F.transform(real, lambda e: F.struct(e["event_type"].alias("event_type"))))


def text_key_list(events_column: Column) -> Column:
    """Distinct metric-and-key texts of an event list, as ``text_keys`` but inside the row; texts compare by hash, structs would not."""
    sep, empty = "\x1f", F.array().cast("array<string>")
    pair = lambda m, *parts: F.concat_ws("\x1d", F.lit(m), F.concat_ws(sep, *parts))

    def keys(e: Column) -> Column:
        t, w = strip(F.coalesce(e["event_type"], F.lit(""))), normalize(F.coalesce(e["trigger"], F.lit("")))
        full = F.transform(F.filter(F.coalesce(e["arguments"], F.array()), lambda a: a.isNotNull()), lambda a: F.struct(strip(F.coalesce(a["role"], F.lit(""))).alias("r"), normalize(F.coalesce(a["argument"], F.lit(""))).alias("v")))

        def of(x: Column) -> Column:
            def each(a: Column) -> Column:
                loose = F.array(pair("argument_text_id", x["t"], a["v"]), pair("argument_text_cls", x["t"], a["r"], a["v"]))
                tied = F.array(pair("argument_attached_text_id", x["t"], x["w"], a["v"]), pair("argument_attached_text_cls", x["t"], x["w"], a["r"], a["v"]))
                return F.when(x["w"] != "", F.concat(loose, tied)).otherwise(loose)

            triggers = F.when(x["w"] != "", F.array(pair("trigger_text_id", x["w"]), pair("trigger_text_cls", x["t"], x["w"]))).otherwise(empty)
            return F.when(x["t"] != "", F.concat(triggers, F.flatten(F.transform(F.filter(x["a"], lambda a: a["v"] != ""), each)))).otherwise(empty)

        return bound(F.struct(t.alias("t"), w.alias("w"), full.alias("a")), of)

    return F.array_distinct(F.flatten(F.transform(F.filter(F.coalesce(events_column, F.array()), lambda e: e.isNotNull()), keys)))


def relaxed_pairs(args: DataFrame) -> DataFrame:
    """Bag of triplets in order; only the ends of the argument are stripped, a null one is the text None."""
    rows = args.where(filled("event_type", "role")).withColumn("argument", strip(F.coalesce("argument", F.lit("None"))))
    return rows.where("argument <> ''").select("doc_id", "side", "event_idx", "arg_idx", "event_type", "role", "argument")


def relaxed_list(events_column: Column) -> Column:
    """(key, value) of the relaxed triplets of an event list in order, as ``relaxed_pairs`` but inside the row; the key is type and role."""
    some = lambda c: F.coalesce(c != "", F.lit(False))
    real = F.filter(F.coalesce(events_column, F.array()), lambda e: e.isNotNull() & some(e["event_type"]) & e["arguments"].isNotNull())

    def args(e: Column) -> Column:
        named = F.filter(e["arguments"], lambda a: a.isNotNull() & some(a["role"]))
        return F.transform(named, lambda a: F.struct(F.concat_ws("\x1f", e["event_type"], a["role"]).alias("key"), strip(F.coalesce(a["argument"], F.lit("None"))).alias("value")))

    return F.filter(F.flatten(F.transform(real, args)), lambda x: x["value"] != "")


def event_type_list(events_column: Column) -> Column:
    """Stripped types of an event list in order of appearance."""
    types = F.transform(F.filter(events_column, lambda e: e.isNotNull()), lambda e: strip(F.coalesce(e["event_type"], F.lit(""))))
    return F.array_distinct(F.filter(types, lambda t: t != ""))


def text_keys(results: DataFrame, **columns: str) -> DataFrame:
    """Distinct (doc_id, side, metric, key): the six sets of trigger and argument texts."""
    sep = "\x1f"
    e = events(results, **columns).withColumn("t", strip(F.coalesce("event_type", F.lit("")))).where("t <> ''")
    e = e.withColumn("w", normalize(F.coalesce("trigger", F.lit(""))))
    triggers = e.where("w <> ''").select("doc_id", "side", F.inline(F.array(
        F.struct(F.lit("trigger_text_id").alias("metric"), F.col("w").alias("key")),
        F.struct(F.lit("trigger_text_cls").alias("metric"), F.concat_ws(sep, "t", "w").alias("key")),
    )))
    a = e.select("doc_id", "side", "t", "w", F.explode("arguments").alias("a")).where("a is not null")
    a = a.select("doc_id", "side", "t", "w", strip(F.coalesce("a.role", F.lit(""))).alias("r"), normalize(F.coalesce("a.argument", F.lit(""))).alias("v")).where("v <> ''")
    keys = [("argument_text_id", ["t", "v"]), ("argument_text_cls", ["t", "r", "v"]), ("argument_attached_text_id", ["t", "w", "v"]), ("argument_attached_text_cls", ["t", "w", "r", "v"])]
    packed = F.array(*[F.struct(F.lit(m).alias("metric"), F.concat_ws(sep, *k).alias("key")) for m, k in keys])
    args = a.select("doc_id", "side", F.col("w") != "", F.inline(packed)).toDF("doc_id", "side", "attached", "metric", "key")
    args = args.where("attached or metric not like 'argument_attached%'").drop("attached")
    return triggers.unionByName(args).distinct()


def records(args: DataFrame) -> DataFrame:
    """(doc_id, side, event_type, event_idx, slots): each record's roles with their sorted distinct values, as a map."""
    rows = args.select("doc_id", "side", "event_idx", strip(F.coalesce("event_type", F.lit(""))).alias("event_type"), strip(F.coalesce("role", F.lit(""))).alias("role"), normalize(F.coalesce("argument", F.lit(""))).alias("v"))
    slots = rows.where("event_type <> '' and role <> '' and v <> ''").groupBy("doc_id", "side", "event_type", "event_idx", "role").agg(F.array_sort(F.collect_set("v")).alias("values"))
    packed = F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", F.array_join("values", "\x1e").alias("v")))))
    return slots.groupBy("doc_id", "side", "event_type", "event_idx").agg(packed.alias("slots"))


def all_records(results: DataFrame, **columns: str) -> DataFrame:
    """``records`` of all typed events, those without values with no slots."""
    e = events(results, **columns).select("doc_id", "side", "event_idx", strip(F.coalesce("event_type", F.lit(""))).alias("event_type")).where("event_type <> ''")
    full = records(arguments(results, **columns))
    joined = e.join(full, ["doc_id", "side", "event_type", "event_idx"], "left")
    return joined.withColumn("slots", F.coalesce("slots", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))


def slotted(events_column: Column) -> Column:
    """(event_type, slots) of every typed event of a list, as ``all_records`` but inside the row; slots are sorted (role, value) pairs."""
    typed = F.transform(F.filter(F.coalesce(events_column, F.array()), lambda e: e.isNotNull()), lambda e: F.struct(strip(F.coalesce(e["event_type"], F.lit(""))).alias("t"), e["arguments"].alias("a")))

    def one(e: Column) -> Column:
        args = F.transform(F.filter(F.coalesce(e["a"], F.array()), lambda a: a.isNotNull()), lambda a: F.struct(strip(F.coalesce(a["role"], F.lit(""))).alias("role"), normalize(F.coalesce(a["argument"], F.lit(""))).alias("value")))
        pairs = F.array_sort(F.array_distinct(F.filter(args, lambda a: (a["role"] != "") & (a["value"] != ""))))
        joined = lambda p, r: F.array_join(F.transform(F.filter(p, lambda x: x["role"] == r), lambda x: x["value"]), "\x1e")
        slots = bound(pairs, lambda p: F.transform(F.array_distinct(F.transform(p, lambda x: x["role"])), lambda r: F.struct(r.alias("role"), joined(p, r).alias("value"))))
        return F.struct(e["t"].alias("event_type"), slots.alias("slots"))

    return F.transform(F.filter(typed, lambda e: e["t"] != ""), one)


def signatures(slotted_column: Column, with_type: bool) -> Column:
    """Canonical texts of slotted records, one per record."""
    body = lambda r: F.array_join(F.transform(r["slots"], lambda x: F.concat_ws("\x1d", x["role"], x["value"])), "\x1f")
    return F.transform(slotted_column, lambda r: F.concat_ws("\x1c", r["event_type"], body(r)) if with_type else body(r))


def signature(slots: Column, event_type: Column | None = None) -> Column:
    """Canonical text of a record's slots in the order of the role names, with or without its type."""
    body = F.array_join(F.transform(F.array_sort(F.map_entries(slots)), lambda e: F.concat_ws("\x1d", e["key"], e["value"])), "\x1f")
    return body if event_type is None else F.concat_ws("\x1c", event_type, body)


def canonical_roles(results: DataFrame, alias: DataFrame, key: str = "result_id", column: str = "prediction") -> DataFrame:
    """(key, column, n_rewrites): roles under alias names rewritten, per event type."""
    names = alias.groupBy("event_type").agg(F.map_from_entries(F.collect_list(F.struct("alias", "canonical"))).alias("m"))
    book = names.agg(F.map_from_entries(F.collect_list(F.struct("event_type", "m"))).alias("book"))
    rows = results.select(key, column).withColumn("book", book.scalar())

    def role(event: Column, arg: Column) -> Column:
        return F.coalesce(F.element_at(F.element_at(F.col("book"), F.coalesce(event["event_type"], F.lit(""))), F.coalesce(arg["role"], F.lit(""))), arg["role"])

    def rewrite(event: Column) -> Column:
        args = F.transform(event["arguments"], lambda a: F.when(a.isNotNull(), F.struct(role(event, a).alias("role"), a["argument"].alias("argument"))))
        return F.when(event.isNotNull(), F.struct(event["event_type"].alias("event_type"), event["trigger"].alias("trigger"), args.alias("arguments")))

    def count(event: Column) -> Column:
        changed = F.filter(event["arguments"], lambda a: a.isNotNull() & F.coalesce(role(event, a) != a["role"], F.lit(False)))
        return F.greatest(F.size(changed), F.lit(0))

    total = F.aggregate(F.filter(F.coalesce(F.col(column), F.array()), lambda e: e.isNotNull()), F.lit(0), lambda s, e: s + count(e))
    return rows.select(key, F.transform(column, rewrite).alias(column), total.alias("n_rewrites"))
