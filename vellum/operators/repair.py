"""Repair of predicted records: whitelists, aliases, splits, completion, grounding.

All operators are row to row: a row's events go in, the repaired events and
counters come out, with nested expressions only; order is kept and nothing is
shuffled. Schemas and aliases are small tables, read once by a scalar subquery
and used as map columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import bound, company_forms, fold, ground_status, grounding_form, has_any, strip
from vellum.operators.spans import joined_amount, ordered_span

#: Signs and words between joined values.
BETWEEN = r"\s*(?:、|，|,|；|;|/|及|和)\s*"


def role_book(schema: DataFrame) -> DataFrame:
    """One row: map from event type to its roles."""
    roles = schema.groupBy("event_type").agg(F.array_sort(F.collect_set("role")).alias("r"))
    return roles.agg(F.map_from_entries(F.collect_list(F.struct("event_type", "r"))).alias("roles"))


def alias_book(alias: DataFrame) -> DataFrame:
    """One row: map from event type to its alias map."""
    names = alias.groupBy("event_type").agg(F.map_from_entries(F.collect_list(F.struct("alias", "canonical"))).alias("m"))
    return names.agg(F.map_from_entries(F.collect_list(F.struct("event_type", "m"))).alias("aliases"))


def _empty_args() -> Column:
    return F.array().cast("array<struct<role:string,argument:string>>")


def _objects(c: Column) -> Column:
    return F.filter(c, lambda x: x.isNotNull())


def _event(event_type: Column, trigger: Column, args: Column) -> Column:
    return F.struct(event_type.alias("event_type"), trigger.alias("trigger"), args.alias("arguments"))


def _arg(role: Column, argument: Column) -> Column:
    return F.struct(role.alias("role"), argument.alias("argument"))


def filled_args(args: Column) -> Column:
    """Arguments with their ends stripped, those without role or value dropped."""
    clean = F.transform(_objects(F.coalesce(args, _empty_args())), lambda a: _arg(strip(F.coalesce(a["role"], F.lit(""))), strip(F.coalesce(a["argument"], F.lit("")))))
    return F.filter(clean, lambda a: (a["role"] != "") & (a["argument"] != ""))


def with_forms(rows: DataFrame, text: str) -> DataFrame:
    """Adds the forms of a text that grounding compares with, unless the rows have them.

    Where many rows share a text, call it on the texts before joining them.
    """
    if {"_long", "_known"} <= set(rows.columns):
        return rows
    t = F.coalesce(F.col(text), F.lit(""))
    return rows.withColumn("_long", grounding_form(t)).withColumn("_known", company_forms(t))


def split_value(argument: Column, text: Column, long: Column | None = None) -> Column:
    """Two to four joined values as an array if the text holds every one, else the value whole."""
    parts = F.filter(F.transform(F.split(argument, BETWEEN), strip), lambda p: p != "")
    grounded = F.forall(parts, lambda p: ground_status(p, text, "exact+fuzzy", long) != "ungrounded")
    return F.when(F.size(parts).between(2, 4) & grounded, parts).otherwise(F.array(argument))


def _known_role(kind: Column, role: Column) -> Column:
    allowed = F.coalesce(F.element_at(F.col("roles"), kind), F.array().cast("array<string>"))
    return (F.size(allowed) == 0) | F.array_contains(allowed, role)


def _canonical(kind: Column, role: Column) -> Column:
    return F.coalesce(F.element_at(F.element_at(F.col("aliases"), kind), role), role)


def postprocess(rows: DataFrame, schema: DataFrame, alias: DataFrame, events: str = "prediction", text: str = "text", keep_ungrounded: bool = True) -> DataFrame:
    """Adds ``repaired`` and ``statuses``: illegal types and roles dropped, aliases rewritten, joined values split, values grounded."""
    t = F.col(text)
    base = with_forms(rows, text).withColumns({"roles": role_book(schema).scalar(), "aliases": alias_book(alias).scalar()})
    legal = F.filter(_objects(F.coalesce(F.col(events), F.array())), lambda e: F.map_contains_key(F.col("roles"), strip(F.coalesce(e["event_type"], F.lit("")))) & e["arguments"].isNotNull())

    def args(e: Column) -> Column:
        kind = strip(e["event_type"])
        named = F.transform(filled_args(e["arguments"]), lambda a: _arg(_canonical(kind, a["role"]), a["argument"]))
        known = F.filter(named, lambda a: _known_role(kind, a["role"]))
        pieces = F.flatten(F.transform(known, lambda a: F.transform(split_value(a["argument"], t, F.col("_long")), lambda v: F.struct(a["role"].alias("role"), v.alias("argument"), ground_status(v, t, long=F.col("_long"), known=F.col("_known")).alias("status")))))
        return pieces if keep_ungrounded else F.filter(pieces, lambda a: a["status"] != "ungrounded")

    done = F.transform(legal, lambda e: F.struct(strip(e["event_type"]).alias("event_type"), e["trigger"].alias("trigger"), args(e).alias("arguments")))
    repaired = F.filter(done, lambda e: F.size(e["arguments"]) > 0)
    out = base.withColumn("repaired", repaired)
    return out.withColumn("statuses", F.flatten(F.transform("repaired", lambda e: F.transform(e["arguments"], lambda a: a["status"])))).drop("roles", "aliases", "_long", "_known")


def cat_lite(rows: DataFrame, schema: DataFrame, events: str = "prediction", text: str = "text") -> DataFrame:
    """Adds ``kept``, ``dropped_events`` and ``dropped_args``: legal types, known roles and values that stand in the text."""
    body = F.col("_body")
    base = rows.withColumn("_body", fold(F.coalesce(F.col(text), F.lit("")))).withColumn("roles", role_book(schema).scalar())
    typed = _objects(F.coalesce(F.col(events), F.array()))
    legal = F.filter(typed, lambda e: F.map_contains_key(F.col("roles"), strip(F.coalesce(e["event_type"], F.lit("")))))
    ok = lambda e: F.filter(filled_args(e["arguments"]), lambda a: _known_role(strip(e["event_type"]), a["role"]) & body.contains(fold(a["argument"])))
    done = F.transform(legal, lambda e: _event(strip(e["event_type"]), e["trigger"], ok(e)))
    out = base.withColumn("done", done).withColumn("kept", F.filter("done", lambda e: F.size(e["arguments"]) > 0))
    n_args = lambda c, f: F.aggregate(c, F.lit(0), lambda s, e: s + F.size(f(e)))
    out = out.withColumn("dropped_events", F.size(typed) - F.size("kept"))
    return out.withColumn("dropped_args", n_args(legal, lambda e: filled_args(e["arguments"])) - n_args(F.col("done"), lambda e: e["arguments"])).drop("done", "roles", "_body")


def split_records(events: Column, primary: dict[str, str]) -> Column:
    """Records with several values of their type's primary role become one record per value, shared arguments copied."""
    book = F.create_map(*[x for k, v in primary.items() for x in (F.lit(k), F.lit(v))])

    def parts(e: Column) -> Column:
        role = F.element_at(book, e["event_type"])
        values = F.array_distinct(F.transform(F.filter(e["arguments"], lambda a: a["role"] == role), lambda a: a["argument"]))
        rest = F.filter(e["arguments"], lambda a: a["role"] != role)
        many = F.transform(values, lambda v: _event(e["event_type"], e["trigger"], F.array_distinct(F.concat(F.array(_arg(role, v)), rest))))
        return F.when(role.isNotNull() & (F.size(values) > 1), many).otherwise(F.array(_event(e["event_type"], e["trigger"], e["arguments"])))

    return F.flatten(F.transform(events, parts))


def role_candidates(text: Column, pattern: str) -> Column:
    """Distinct values that a pattern's first group finds in a text, in order, without signs at their ends."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda v: F.regexp_replace(v, "^[ ：:，,。；;]+|[ ：:，,。；;]+$", ""))
    return F.array_distinct(F.filter(found, lambda v: v != ""))


def completed(event: Column, text: Column, patterns: dict[str, dict[str, str]]) -> Column:
    """An event with missing roles filled by the first candidate of their pattern, roles in sorted order."""
    args = event["arguments"]
    for kind, roles in sorted(patterns.items()):
        for role, pattern in sorted(roles.items()):
            value = F.get(role_candidates(text, pattern), F.lit(0))
            absent = (event["event_type"] == kind) & ~F.array_contains(F.transform(event["arguments"], lambda a: a["role"]), role) & value.isNotNull()
            args = F.concat(args, F.when(absent, F.array(_arg(F.lit(role), value))).otherwise(_empty_args()))
    return _event(event["event_type"], event["trigger"], args)


def correct_records(rows: DataFrame, schema: DataFrame, alias: DataFrame, primary: dict[str, str], patterns: dict[str, dict[str, str]] | None = None, events: str = "prediction", text: str = "text") -> DataFrame:
    """Adds ``corrected`` and its counters: alias, whitelist, split, dedupe, completion, then one record per primary value."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = with_forms(rows, text).withColumns({"roles": role_book(schema).scalar(), "aliases": alias_book(alias).scalar()})
    legal = F.filter(_objects(F.coalesce(F.col(events), F.array())), lambda e: F.map_contains_key(F.col("roles"), strip(F.coalesce(e["event_type"], F.lit("")))))

    def fixed(e: Column) -> Column:
        kind = strip(e["event_type"])
        named = F.transform(filled_args(e["arguments"]), lambda a: _arg(_canonical(kind, a["role"]), a["argument"]))
        known = F.filter(named, lambda a: _known_role(kind, a["role"]))
        pieces = F.flatten(F.transform(known, lambda a: F.transform(split_value(a["argument"], t, F.col("_long")), lambda v: _arg(a["role"], v))))
        return _event(kind, e["trigger"], F.array_distinct(pieces))

    out = base.withColumn("legal", F.transform(legal, fixed))
    if patterns:
        out = out.withColumn("legal", F.transform("legal", lambda e: completed(e, t, patterns)))
    out = out.withColumn("legal", F.filter("legal", lambda e: F.size(e["arguments"]) > 0))
    out = out.withColumn("corrected", split_records(F.col("legal"), primary))
    return out.withColumn("n_split", F.size("corrected") - F.size("legal")).drop("legal", "roles", "aliases", "_long", "_known")


def competing_dropped(events: Column, text: Column, rules: list[tuple[str, list[str], list[str]]]) -> Column:
    """Events without those whose type competes with another one present while no cue for it stands in the text."""
    types = F.transform(events, lambda e: e["event_type"])

    def stays(e: Column) -> Column:
        keep = F.lit(True)
        for kind, rivals, cues in rules:
            keep = keep & ~((e["event_type"] == kind) & F.arrays_overlap(types, F.array(*map(F.lit, rivals))) & ~has_any(text, cues))
        return keep

    return F.filter(events, stays)


def canonicalized(events: Column, text: Column, joins: dict[str, str], connector: str = "[、和及与]") -> Column:
    """Events whose fragmented values are joined to the span of the text they came from, arguments without repeats.

    ``joins`` names the kind of join of the roles that may be fragmented: number,
    amount or span. The joined value stands where the first fragment stood; a role
    whose fragments do not join keeps them.
    """
    join = {"number": lambda vs: joined_numbers(vs, text), "amount": lambda vs: joined_amount(vs, text), "span": lambda vs: ordered_span(vs, text, connector)}
    if unknown := set(joins.values()) - set(join):
        raise ValueError(f"unknown joins {sorted(unknown)}")
    book = F.create_map(*[F.lit(x) for pair in sorted(joins.items()) for x in pair]) if joins else F.create_map(F.lit(""), F.lit(""))

    def merged(args: Column) -> Column:
        """All roles in one pass, so the plan does not grow with their number."""
        roles = F.array_distinct(F.transform(args, lambda a: a["role"]))

        def joined(role: Column) -> Column:
            values = F.transform(F.filter(args, lambda a: a["role"] == role), lambda a: a["argument"])
            kind, value = F.element_at(book, role), F.lit(None).cast("string")
            for name, f in join.items():
                value = F.when(kind == name, f(values)).otherwise(value)
            return F.struct(role.alias("role"), value.alias("value"))

        def placed(found: Column) -> Column:
            of = lambda role: F.get(F.filter(found, lambda x: x["role"] == role), F.lit(0))["value"]
            first = lambda a, i: F.array_position(F.transform(args, lambda x: x["role"]), a["role"]) == i + 1
            return F.transform(F.filter(args, lambda a, i: of(a["role"]).isNull() | first(a, i)), lambda a: _arg(a["role"], F.coalesce(of(a["role"]), a["argument"])))

        return bound(F.filter(F.transform(F.filter(roles, lambda r: F.map_contains_key(book, r)), joined), lambda x: x["value"].isNotNull()), placed)

    def fixed(e: Column) -> Column:
        return _event(e["event_type"], e["trigger"], F.array_distinct(bound(F.coalesce(filled_args(e["arguments"]), _empty_args()), merged)))

    return F.transform(_objects(events), fixed)


def probed(rows: DataFrame, rules: list[tuple[str, list[str], list[str]]], joins: dict[str, str], events: str = "prediction", text: str = "text") -> DataFrame:
    """Adds ``probed`` and its counters: competing events dropped, then fragments joined. Null events count as none, a null text as empty."""
    t = F.coalesce(text, F.lit(""))
    none = F.array().cast(rows.schema[events].dataType.simpleString())
    kept = rows.withColumn("_kept", competing_dropped(_objects(F.coalesce(events, none)), t, rules)).withColumn("probed", canonicalized(F.col("_kept"), t, joins))
    count = lambda c: F.aggregate(c, F.lit(0), lambda s, e: s + F.greatest(F.size(e["arguments"]), F.lit(0)))
    given = F.aggregate(F.col("_kept"), F.lit(0), lambda s, e: s + F.size(F.array_distinct(F.coalesce(filled_args(e["arguments"]), _empty_args()))))
    return kept.withColumn("n_dropped", F.size(_objects(F.coalesce(events, none))) - F.size("_kept")).withColumn("n_joined", given - count(F.col("probed"))).drop("_kept")


def joined_numbers(values: Column, text: Column, units: tuple[str, ...] = ("股", "张", "")) -> Column:
    """Digit fragments joined with or without commas if the text holds the result; null otherwise."""
    digits = F.transform(values, lambda v: F.regexp_replace(v, r"\D", ""))
    usable = (F.size(values) > 1) & F.forall(digits, lambda d: d != "")
    forms = F.array(*[F.concat(F.array_join(digits, sep), F.lit(u)) for sep in (",", "") for u in units])
    return F.when(usable, F.get(F.filter(forms, lambda f: text.contains(f)), F.lit(0)))


#: Patterns of what can be replaced, what with, and its kind, in the order they are tried. None: by the unit.
SLOTS = [
    (r"\d+(?:\.\d+)?(?:亿|万|千|百)?(?:元|股|%)", None, "number"),
    (r"\d+(?:\.\d+)?", "9999", "number"),
    (r"\d{4}年\d{1,2}月\d{1,2}日", "2099年12月31日", "date"),
    (r"\d{4}年\d{1,2}月", "2099年12月", "date"),
    (r"\d{4}年", "2099年", "date"),
    (r"[\x{4e00}-\x{9fa5}A-Za-z0-9]{2,30}(?:公司|集团|银行|证券|科技|股份)", "示例科技公司", "org"),
]


def perturbed(text: Column, kinds: tuple[str, ...] = ("number", "date", "org")) -> Column:
    """(changed, type, old_value, new_value, text): the first slot of a text of one of the ``kinds`` replaced."""
    t = F.coalesce(text, F.lit(""))
    out = F.struct(F.lit(False).alias("changed"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("old_value"), F.lit(None).cast("string").alias("new_value"), t.alias("text"))
    for pattern, new, kind in reversed([s for s in SLOTS if s[2] in kinds]):
        old = F.regexp_extract(t, f"({pattern})", 1)
        value = F.lit(new) if new else F.when(old.contains("%"), "99%").when(old.contains("股"), "9999股").otherwise("9999元")
        at = F.locate("\x00", F.regexp_replace(t, f"(?s)^(.*?)(?:{pattern}).*$", "$1\x00"))
        spliced = F.concat(F.substring(t, F.lit(1), at - 1), value, F.substring(t, at + F.char_length(old), F.char_length(t)))
        out = F.when(t.rlike(pattern), F.struct(F.lit(True).alias("changed"), F.lit(kind).alias("type"), old.alias("old_value"), value.alias("new_value"), spliced.alias("text"))).otherwise(out)
    return out
