"""Scores over matched rows, diagnostics of result rows, aggregates over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions.maths import nearest_rank, prf, safe_div
from vellum.functions.text import normalize, strip, unspaced
from vellum.operators.arguments import arguments, event_type_list, events, filled, relaxed_list, signatures, slotted, strict_keys, type_keys
from vellum.operators.matching import assigned, counted, first_fit, role_sums, row_fitting, shared_times


def scored(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 to tp, fp and fn."""
    return counts.select("*", *prf())


def relaxed_scores(bag: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Micro scores of ``first_fit`` over all documents."""
    s = first_fit(bag, threshold).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("n_pred", "n_gold", "tp")])
    return scored(s.select("tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_gold") - F.col("tp")).alias("fn")))


def role_scores(results: DataFrame, schema: DataFrame) -> DataFrame:
    """Per event type and role, roles of the schema that never occur included."""
    seen = counted(assigned(results), "event_type", "role")
    known = schema.select("event_type", "role").distinct()
    full = known.join(seen, ["event_type", "role"], "full_outer")
    return scored(full.select("event_type", "role", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("tp", "fp", "fn")]))


def role_rollup(roles: DataFrame) -> DataFrame:
    """Micro and macro scores per event type and overall (event type null); macro means are over roles, then over types."""
    by_type = roles.groupBy("event_type").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])
    counts, means = ("tp", "fp", "fn"), ("macro_precision", "macro_recall", "macro_f1")
    total = F.struct(F.lit(None).cast("string").alias("event_type"), *[F.sum(c).alias(c) for c in counts], *[F.avg(c).alias(c) for c in means])
    # the types of a schema are few: they are packed into one row, so nothing is computed twice
    packed = by_type.agg(F.collect_list(F.struct("event_type", *counts, *means)).alias("types"), total.alias("total"))
    return scored(packed.select(F.inline(F.concat("types", F.array("total")))))


def type_presence(results: DataFrame, schema: DataFrame) -> DataFrame:
    """Per event type, documents where both, only the prediction or only the gold has it; types of the schema included."""
    e = events(results).select("doc_id", "side", strip(F.coalesce("event_type", F.lit(""))).alias("event_type")).where("event_type <> ''")
    held = e.groupBy("doc_id", "event_type").agg(F.max(F.col("side") == "gold").alias("g"), F.max(F.col("side") == "pred").alias("p"))
    seen = held.groupBy("event_type").agg(F.count_if(F.expr("g and p")).alias("tp"), F.count_if(F.expr("p and not g")).alias("fp"), F.count_if(F.expr("g and not p")).alias("fn"))
    full = schema.select("event_type").distinct().join(seen, "event_type", "full_outer")
    return scored(full.select("event_type", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "fp", "fn")]))


def gold_bucket(events_column: Column) -> Column:
    """zero_gold, single_event or multi_event."""
    n = F.coalesce(F.size(F.filter(events_column, lambda e: e.isNotNull())), F.lit(0))
    return F.when(n == 1, "single_event").when(n > 1, "multi_event").otherwise("zero_gold")


def gold_count(events_column: Column) -> Column:
    """Events of a list that are not null."""
    return F.greatest(F.coalesce(F.size(F.filter(events_column, lambda e: e.isNotNull())), F.lit(0)), F.lit(0))


def multiplicity(results: DataFrame, key: str = "result_id") -> DataFrame:
    """Role scores by number of gold events of the document."""
    docs = results.select(F.col(key).alias("doc_id"), gold_bucket(F.col("ground_truth")).alias("bucket"), F.greatest(F.coalesce(F.size(F.filter("ground_truth", lambda e: e.isNotNull())), F.lit(0)), F.lit(0)).alias("n_gold"))
    joined = docs.join(counted(assigned(results), "doc_id"), "doc_id", "left")
    sums = joined.groupBy("bucket").agg(F.count("*").alias("support_samples"), F.sum("n_gold").alias("support_gold_events"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    return scored(sums)


def hallucinations(results: DataFrame, samples: DataFrame, key: str = "result_id") -> DataFrame:
    """(doc_id, event_idx, arg_idx, event_type, role, argument, grounded) of predicted values of two or more characters whose sample text is known."""
    texts = samples.where(filled("text")).groupBy("id").agg(F.max_by("text", "row_id").alias("text")).select("id", "text", unspaced(F.col("text")).alias("flat"))
    # the text joins the row, not each of its arguments, and its form is computed once
    rows = results.select(F.col(key).alias("result_id"), "prediction", F.col("sample_id").alias("id")).join(texts, "id").withColumn("ground_truth", F.lit(None).cast(results.schema["prediction"].dataType))
    named = arguments(rows, ("text", "flat")).where("side = 'pred'").withColumn("raw", F.coalesce("argument", F.lit("None"))).where(F.char_length("raw") >= 2)
    found = F.col("text").contains(F.col("raw")) | F.col("flat").contains(unspaced(F.col("raw")))
    return named.select("doc_id", "event_idx", "arg_idx", "event_type", "role", F.col("raw").alias("argument"), found.alias("grounded"))


def hallucination_rates(checked: DataFrame) -> DataFrame:
    """Values, ungrounded values, documents with any, and the rates."""
    docs = checked.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(~F.col("grounded")).alias("bad"))
    s = docs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_values"), F.coalesce(F.sum("bad"), F.lit(0)).alias("n_ungrounded"), F.count("*").alias("n_docs"), F.count_if(F.expr("bad > 0")).alias("n_docs_ungrounded"))
    return s.select("*", safe_div(F.col("n_ungrounded"), F.col("n_values")).alias("value_rate"), safe_div(F.col("n_docs_ungrounded"), F.col("n_docs")).alias("doc_rate"))


def text_grounding(results: DataFrame, samples: DataFrame, key: str = "result_id") -> DataFrame:
    """Share of predicted triggers and values that stand in the sample's text, all in evaluation form."""
    texts = samples.where(filled("text")).groupBy("id").agg(F.max_by("text", "row_id").alias("text")).select("id", normalize(F.col("text")).alias("text")).where("text <> ''")
    values = F.flatten(F.transform(F.filter("prediction", lambda e: e.isNotNull()), lambda e: F.concat(F.array(e["trigger"]), F.coalesce(F.transform(F.filter(e["arguments"], lambda a: a.isNotNull()), lambda a: a["argument"]), F.array().cast("array<string>")))))
    rows = results.select(F.col("sample_id").alias("id"), F.filter(F.transform(values, lambda v: normalize(F.coalesce(v, F.lit("")))), lambda v: v != "").alias("v")).where("size(v) > 0")
    joined = rows.join(texts, "id")
    s = joined.agg(F.coalesce(F.sum(F.size("v")), F.lit(0)).cast("bigint").alias("total"), F.coalesce(F.sum(F.size(F.filter("v", lambda v: F.col("text").contains(v)))), F.lit(0)).cast("bigint").alias("grounded"))
    return s.select("*", safe_div(F.col("grounded"), F.col("total")).alias("coverage"))


def parse_rates(results: DataFrame, *by: str) -> DataFrame:
    """Parse outcomes: raw and repaired success, failures without any JSON, errors."""
    d = F.col("parse_diagnostics")
    ok = F.coalesce(F.col("parse_success"), F.lit(False))
    steps = F.coalesce(F.size(d["repair_steps"]), F.lit(0))
    return results.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        F.count_if(ok & (steps <= 0)).alias("n_raw_success"),
        F.count_if(ok & (steps > 0)).alias("n_repaired"),
        F.count_if(~ok & F.coalesce(d["extraction_method"] == "no_json_found", F.lit(False))).alias("n_no_json"),
        F.count_if(~ok).alias("n_errors"),
    ).withColumn("error_rate", safe_div(F.col("n_errors"), F.col("n_rows")))


def error_histogram(matched: DataFrame, top: int = 10) -> DataFrame:
    """The most frequent kinds of error, by type and role; ties by name."""
    kinds = matched.where("tp = 0").select(F.concat_ws("_", F.when(F.col("fn") == 1, "FN").otherwise("FP"), "event_type", "role").alias("error"))
    return kinds.groupBy("error").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error").limit(top)


COUNTED = ("strict", "relaxed", "type", "doc_role", "doc_event_type", "doc_instance", "doc_combination")


def sample_counts(results: DataFrame, key: str = "result_id") -> DataFrame:
    """One row of counts per document: gold events, and tp, pred_total and gold_total of seven scores.

    Both lists stand in one row, so all counts are sizes of arrays in the row
    and nothing is exchanged. Documents must have one row each.
    """
    g, p = F.col("ground_truth"), F.col("prediction")
    pairs = {"strict": strict_keys, "relaxed": relaxed_list, "type": type_keys, "doc_role": slotted}
    held = results.select(F.col(key).alias("doc_id"), gold_count(g).alias("gold_event_count"), *[f(c).alias(f"{n}_{s}") for n, f in pairs.items() for s, c in (("p", p), ("g", g))])
    both = {n: (F.col(f"{n}_p"), F.col(f"{n}_g")) for n in pairs}
    sizes = {n: (F.size(F.array_intersect(*both[n])), F.size(both[n][0]), F.size(both[n][1])) for n in ("strict", "type")}
    sizes["relaxed"] = (row_fitting(*both["relaxed"]), *map(F.size, both["relaxed"]))
    sizes["doc_event_type"] = sizes["type"]
    for name, with_type in (("doc_instance", True), ("doc_combination", False)):
        a, b = (signatures(c, with_type) for c in both["doc_role"])
        sizes[name] = (shared_times(a, b), F.size(a), F.size(b))
    rows = held.withColumn("role", role_sums(*both["doc_role"]))
    sizes["doc_role"] = (F.col("role.tp"), F.col("role.tp") + F.col("role.fp"), F.col("role.tp") + F.col("role.fn"))
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(f"{n}_{k}") for n in COUNTED for k, c in zip(("tp", "pred_total", "gold_total"), sizes[n])]
    return rows.select("doc_id", "gold_event_count", *counts)


def scores_from_counts(rows: DataFrame) -> DataFrame:
    """Scores of summed sample counts, and role f1 of documents with one and with more gold events."""
    sums = rows.agg(
        *[F.sum(f"{n}_{k}").alias(f"{n}_{k}") for n in COUNTED for k in ("tp", "pred_total", "gold_total")],
        *[F.coalesce(F.sum(F.when(F.expr(c), F.col(f"doc_role_{k}"))), F.lit(0)).alias(f"{n}_{k}") for n, c in (("single", "gold_event_count = 1"), ("multi", "gold_event_count > 1")) for k in ("tp", "pred_total", "gold_total")],
        F.count_if(F.expr("gold_event_count = 0")).alias("zero_gold_samples"),
    )
    out = []
    for n in (*COUNTED, "single", "multi"):
        p, r = safe_div(F.col(f"{n}_tp"), F.col(f"{n}_pred_total")), safe_div(F.col(f"{n}_tp"), F.col(f"{n}_gold_total"))
        out += [p.alias(f"{n}_precision"), r.alias(f"{n}_recall"), safe_div(F.lit(2.0) * p * r, p + r).alias(f"{n}_f1")]
    return sums.select("zero_gold_samples", *out)


def report(results: DataFrame, samples: DataFrame, schema: DataFrame) -> DataFrame:
    """(metric, value) of all scores, rates and counts of a set of results."""

    def long(df: DataFrame, prefix: str = "") -> DataFrame:
        doubles = df.select(*[F.col(c).cast("double").alias(prefix + c) for c in df.columns])
        return doubles.unpivot([], doubles.columns, "metric", "value")

    checked = schema_violations(results, schema)
    broken = checked.agg(F.count_distinct("doc_id").alias("violations"))
    compliance = results.agg(F.count("*").alias("n")).withColumn("bad", broken.scalar()).select(safe_div(F.col("n") - F.col("bad"), F.col("n")).alias("schema_compliance_rate"))
    parts = [
        long(scores_from_counts(sample_counts(results))), long(hallucination_rates(hallucinations(results, samples)), "hallucination_"), long(text_grounding(results, samples), "grounding_"),
        long(parse_rates(results), "parse_"), long(compliance),
        long(role_rollup(role_scores(results, schema)).where("event_type is null").select(F.col("macro_f1").alias("doc_role_macro_f1"))),
        long(type_presence(results, schema).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("doc_event_type_macro_f1"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def required_metrics(found: DataFrame, names: dict[str, str]) -> DataFrame:
    """(name, value) of the metric that each of ``names`` stands for; one that is not there is an error naming it."""
    wanted = found.sparkSession.createDataFrame(list(names.items()), "name string, metric string")
    joined = F.broadcast(wanted).join(found, "metric", "left")  # as many rows as names
    return joined.select("name", F.coalesce("value", F.raise_error(F.concat(F.lit("missing metric "), "metric")).cast("double")).alias("value"))


def seed_table(rows: DataFrame, *by: str) -> DataFrame:
    """(by, metric, n_seeds, mean, std) over seeds: sample deviation, 0 for one seed, six decimals."""
    return rows.groupBy(*by, "metric").agg(F.count("*").alias("n_seeds"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 6).alias("std"))


def example_usage(chosen: DataFrame, ids: str = "ids", top: int = 10) -> DataFrame:
    """(kind, name, n): how often each example was chosen, by id, and the ``top`` combinations of examples."""
    single = chosen.select(F.explode(F.transform(ids, lambda i: i.cast("string"))).alias("name")).groupBy("name").agg(F.count("*").alias("n")).select(F.lit("example").alias("kind"), "name", "n")
    combos = chosen.select(F.array_join(F.transform(ids, lambda i: i.cast("string")), "|").alias("name")).groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(top)
    return single.unionByName(combos.select(F.lit("combination").alias("kind"), "name", "n"))


def sampler_rates(rows: DataFrame) -> DataFrame:
    """Generated negatives, how many the verifier filtered, retries, and their rates over at least one."""
    s = rows.agg(F.count("*").alias("n_generated"), F.count_if("filtered").alias("n_filtered"), F.coalesce(F.sum("retries"), F.lit(0)).alias("n_retries"))
    base = F.greatest(F.lit(1), F.col("n_generated")).cast("double")
    return s.select("*", (F.col("n_filtered") / base).alias("filter_rate"), (F.col("n_retries") / base).alias("retry_rate"))


def result_diagnostics(results: DataFrame, *by: str) -> DataFrame:
    """Averages of events and types, and how predicted types cover the gold ones, over two-stage rows only (null without any)."""
    g, p = event_type_list(F.col("ground_truth")), event_type_list(F.col("prediction"))
    empty = F.array().cast("array<string>")
    rows = results.select(*by, "parse_success", F.col("stage_mode").startswith("two_stage").alias("two"), F.coalesce(g, empty).alias("g"), F.coalesce(p, empty).alias("p"), F.coalesce(F.size(F.filter("ground_truth", lambda e: e.isNotNull())), F.lit(0)).alias("ng"), F.coalesce(F.size(F.filter("prediction", lambda e: e.isNotNull())), F.lit(0)).alias("np"))
    rows = rows.withColumn("missed", F.size(F.array_except("g", "p"))).withColumn("extra", F.size(F.array_except("p", "g")))
    two = F.count_if(F.expr("two"))
    share = lambda condition: F.try_divide(F.count_if(F.expr(f"two and ({condition})")).cast("double"), two.cast("double"))
    return rows.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        safe_div(F.count_if(F.coalesce("parse_success", F.lit(False))), F.count("*")).alias("parse_success_rate"),
        F.avg(F.greatest("ng", F.lit(0)).cast("double")).alias("avg_gold_events"), F.avg(F.greatest("np", F.lit(0)).cast("double")).alias("avg_predicted_events"), F.avg(F.size("g").cast("double")).alias("avg_gold_event_types"),
        two.alias("n_two_stage"), share("size(g) > 0 and missed = 0").alias("coverage_rate"), share("missed = 0 and extra = 0").alias("exact_rate"), share("missed > 0").alias("miss_rate"), share("extra > 0").alias("over_rate"),
    )


def aggregate_runs(rows: DataFrame, *by: str) -> DataFrame:
    """Per metric of (…, metric, value): mean, sample deviation (0 for one run), range, nearest-rank median and 95 % range."""
    values = F.array_sort(F.collect_list("value"))
    s = rows.groupBy(*by, "metric").agg(F.count("*").alias("n_runs"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), values.alias("v"))
    return s.select(*by, "metric", "n_runs", "mean", "std", "min", "max", nearest_rank(F.col("v"), 0.5).alias("median"), nearest_rank(F.col("v"), 0.025).alias("low"), nearest_rank(F.col("v"), 0.975).alias("high"))


def nearest_ranks(df: DataFrame, by: str, value: str, at: dict[str, float]) -> DataFrame:
    """(by, names of ``at``): nearest-rank percentiles per group; ranks are rounded half to even.

    Equal values are counted first, so a group is held as its distinct values,
    however many rows it has.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("k"))
    group = W.partitionBy(by)
    upto = counts.withColumn("hi", F.sum("k").over(group.orderBy(value))).withColumn("n", F.sum("k").over(group))
    place = lambda p: F.bround((F.col("n") - 1) * F.lit(p)).cast("bigint") + 1
    return upto.groupBy(by).agg(*[F.min(F.when(F.col("hi") >= place(p), F.col(value))).alias(name) for name, p in at.items()])


def schema_violations(results: DataFrame, schema: DataFrame, column: str = "prediction", key: str = "result_id") -> DataFrame:
    """(doc_id, code): the first breach of the schema in each row's events, if any.

    Types and roles are checked against the schema's; the order is event by
    event, argument by argument, as a reader would find them.
    """
    roles = schema.groupBy("event_type").agg(F.collect_set("role").alias("known"))
    e = results.select(F.col(key).alias("doc_id"), F.posexplode(column).alias("i", "e"))
    typed = e.select("doc_id", "i", F.col("e").isNull().alias("no_event"), F.col("e.event_type").alias("event_type"), F.col("e.arguments").alias("args")).join(F.broadcast(roles), "event_type", "left")
    head = F.when(F.col("no_event"), "event_not_object").when(F.coalesce(F.col("event_type"), F.lit("")) == "", "missing_event_type").when(F.col("known").isNull(), F.concat(F.lit("invalid_event_type:"), F.col("event_type"))).when(F.col("args").isNull(), "arguments_not_list")
    a = lambda arg: (
        F.when(arg.isNull(), F.lit("argument_not_object"))
        .when(F.coalesce(arg["role"], F.lit("")) == "", F.lit("missing_role"))
        .when(F.coalesce(arg["argument"], F.lit("")) == "", F.lit("missing_argument"))
        .when(~F.array_contains(F.col("known"), arg["role"]), F.concat(F.lit("invalid_role:"), arg["role"]))
    )
    first = F.get(F.filter(F.transform("args", a), lambda c: c.isNotNull()), F.lit(0))
    coded = typed.select("doc_id", "i", F.coalesce(head, first).alias("code")).where("code is not null")
    return coded.groupBy("doc_id").agg(F.min_by("code", "i").alias("code"))
