"""Queries on sources, JSON, repair, retrieval, splits, training rows, graphs, statistics and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import jsonops as J
from vellum.functions import maths as X
from vellum.functions import text as T
from vellum.operators import arguments as A
from vellum.operators import contracts as C
from vellum.operators import graph as G
from vellum.operators import matching as M
from vellum.operators import repair as R
from vellum.operators import retrieval as RT
from vellum.operators import splits as SP
from vellum.operators import stats as ST
from vellum.operators import trainset as TR
from vellum.operators.metrics import nearest_ranks
from vellum.plans import score_queries as SQ
from vellum.sources import records as S
from vellum.sources.tables import table
from vellum.streaming.competence import competence, windowed_counts

#: Numbers of shares in a text: what a missing role whose name ends with ``SHARE_ROLE`` can be filled with.
SHARES, SHARE_ROLE = r"(\d[\d,\.]*(?:亿|万)?股)", "股数"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return table(spark, d, name)


def _primary(spark, d):
    """The first role of each event type of the schema, which is one table of fixed size."""
    rows = _t(spark, d, "schema_roles").where("role_pos = 0").select("event_type", "role").collect()
    return {r[0]: r[1] for r in rows}


def _patterns(spark, d):
    """For each event type that has one role for a number of shares, the pattern of such numbers."""
    rows = _t(spark, d, "schema_roles").where(F.col("role").endswith(SHARE_ROLE)).select("event_type", "role").collect()
    by_type: dict[str, list[str]] = {}
    for kind, role in rows:
        by_type.setdefault(kind, []).append(role)
    return {kind: {roles[0]: SHARES} for kind, roles in by_type.items() if len(roles) == 1}


def _texts(spark, d):
    return S.text_index(_t(spark, d, "duee_fin_samples"))


def _with_text(spark, d, forms=False):
    """Results with the text of their sample, and its grounding forms, which are computed once per sample."""
    texts = R.with_forms(_texts(spark, d), "text") if forms else _texts(spark, d)
    joined = _t(spark, d, "evaluation_results").join(texts.withColumnRenamed("id", "sample_id"), "sample_id", "left")
    return joined.withColumns({"_long": F.coalesce("_long", F.lit("")), "_known": F.coalesce("_known", F.array().cast("array<string>"))}) if forms else joined


def src_01_samples(spark, d):
    rows = _t(spark, d, "duee_fin_samples").where(T.strip(F.coalesce("text", F.lit(""))) != "").select("row_id", "text", "events")
    return S.shaped(rows).select("row_id", F.char_length("text").alias("n"), F.array_join("event_types", "|").alias("types"))


def src_02_schema_map(spark, d):
    g = _t(spark, d, "schema_roles").groupBy("event_type").agg(F.array_sort(F.collect_list(F.struct("role_pos", "role"))).alias("r"))
    return g.select("event_type", F.array_join(F.transform("r", lambda x: x["role"]), "|").alias("roles"))


def src_05_payload_ids(spark, d):
    v = F.try_parse_json("payload")
    return _t(spark, d, "result_lines").select("line_id", F.try_variant_get(v, "$.id", "string").alias("id"), F.try_variant_get(v, "$.stage_meta.stage_mode", "string").alias("stage_mode"))


def src_06_text_index(spark, d):
    return _texts(spark, d)


def src_07_alias_map(spark, d):
    return _t(spark, d, "role_alias").groupBy("event_type").agg(F.count("*").alias("n_aliases"), F.count_distinct("canonical").alias("n_roles"))


def snk_01_sorted_results(spark, d):
    return _t(spark, d, "evaluation_results").select("sample_id", "result_id", "run_key").orderBy("sample_id", "result_id")


def flt_05_known_types(spark, d):
    known = _t(spark, d, "schema_roles").agg(F.collect_set("event_type"))
    rows = _t(spark, d, "duee_fin_samples").select("row_id", "event_types").withColumn("known", known.scalar())
    return rows.where(F.forall(F.coalesce("event_types", F.array().cast("array<string>")), lambda t: F.array_contains("known", t))).select("row_id")


def flt_06_should_correct(spark, d):
    m = F.col("parse_diagnostics.extraction_method")
    return _t(spark, d, "evaluation_results").where((m != "no_json_found") & ~F.coalesce("parse_success", F.lit(True))).select("result_id")


def _extracted(spark, d):
    return _t(spark, d, "evaluation_results").select("result_id", "raw_response", J.extracted(F.col("raw_response")).alias("x"))


def jsn_01_extract(spark, d):
    return _extracted(spark, d).select("result_id", "x.method", F.sha2("x.json", 256).alias("digest"))


def jsn_02_repairs(spark, d):
    rungs = J.ladder(F.col("x.json"))
    return _extracted(spark, d).select("result_id", F.posexplode(rungs).alias("rung", "json")).where("json is not null").select("result_id", "rung", F.sha2("json", 256).alias("digest"))


def jsn_07_ladder(spark, d):
    p = _extracted(spark, d).select("result_id", J.parsed(F.col("x.json")).alias("p"))
    return p.select("result_id", F.col("p").isNotNull().alias("success"), F.array_join(F.slice(F.array(*map(F.lit, J.REPAIRS)), 1, F.coalesce("p.n_repairs", F.lit(0))), "|").alias("repairs"))


def jsn_08_event_objects(spark, d):
    p = _extracted(spark, d).select("result_id", J.parsed(F.col("x.json")).alias("p"))
    return p.select("result_id", F.size(J.event_texts(F.col("p.json"))).cast("bigint").alias("n_events"))


def jsn_09_strict(spark, d):
    return _t(spark, d, "evaluation_results").where("raw_response is not null").select("result_id", J.top_kind(T.strip(F.col("raw_response"))).alias("kind"))


def jsn_11_paths(spark, d):
    v = F.try_parse_json("payload")
    return _t(spark, d, "result_lines").select("line_id", F.try_variant_get(v, "$.parse_diagnostics.extraction_method", "string").alias("method"), J.number_or_overall(F.col("payload"), "$.stage_meta.retry").alias("retry"))


def rep_01_postprocess(spark, d):
    p = R.postprocess(_with_text(spark, d, True), _t(spark, d, "schema_roles"), _t(spark, d, "role_alias"))
    n = lambda s: F.size(F.filter("statuses", lambda x: x == s)).cast("bigint")
    return p.select("result_id", F.size("repaired").cast("bigint").alias("n_events"), n("exact").alias("n_exact"), n("normalized_exact").alias("n_normalized"), n("shortname_or_code_local").alias("n_local"), n("ungrounded").alias("n_ungrounded"))


def agg_22_grounding_summary(spark, d):
    s = rep_01_postprocess(spark, d).agg(F.sum(F.col("n_exact") + F.col("n_normalized") + F.col("n_local")).alias("grounded"), F.sum("n_ungrounded").alias("ungrounded"))
    return s.select("*", F.round(X.safe_div(F.col("grounded"), F.col("grounded") + F.col("ungrounded")), 4).alias("grounding_rate"))


def rep_02_cat_lite(spark, d):
    k = R.cat_lite(_with_text(spark, d), _t(spark, d, "schema_roles"))
    args = F.aggregate("kept", F.lit(0), lambda s, e: s + F.size(e["arguments"]))
    return k.select("result_id", F.size("kept").cast("bigint").alias("n_events"), args.cast("bigint").alias("n_args"))


def rep_03_corrected(spark, d):
    c = R.correct_records(_with_text(spark, d, True), _t(spark, d, "schema_roles"), _t(spark, d, "role_alias"), _primary(spark, d), _patterns(spark, d))
    return c.select("result_id", F.size("corrected").cast("bigint").alias("n_records"), F.col("n_split").cast("bigint").alias("n_split"))


def rep_04_candidates(spark, d):
    v = R.role_candidates(F.col("text"), SHARES)
    return _t(spark, d, "duee_fin_samples").where("text is not null").select("row_id", F.array_join(v, "|").alias("found")).where("found <> ''")


def rep_05_record_split(spark, d):
    ok = F.filter(F.coalesce("prediction", F.array()), lambda e: e.isNotNull())
    clean = F.transform(ok, lambda e: F.struct(F.coalesce(e["event_type"], F.lit("")).alias("event_type"), e["trigger"].alias("trigger"), R.filled_args(e["arguments"]).alias("arguments")))
    return _t(spark, d, "evaluation_results").select("result_id", F.size(ok).cast("bigint").alias("n_before"), F.size(R.split_records(clean, _primary(spark, d))).cast("bigint").alias("n_after"))


def rep_06_pipeline(spark, d):
    c = R.correct_records(_with_text(spark, d, True), _t(spark, d, "schema_roles"), _t(spark, d, "role_alias"), _primary(spark, d))
    k = R.cat_lite(c.select("result_id", "text", F.col("corrected").alias("prediction")), _t(spark, d, "schema_roles"))
    return k.select("result_id", F.size("kept").cast("bigint").alias("n_events"), "dropped_events", "dropped_args")


def rep_08_competing(spark, d):
    ok = F.filter(F.coalesce("prediction", F.array()), lambda e: e.isNotNull())
    left = R.competing_dropped(F.transform(ok, lambda e: F.struct(F.coalesce(e["event_type"], F.lit("")).alias("event_type"))), F.coalesce("text", F.lit("")), [("股权融资", ["收购资产", "回购股份"], ["融资", "增资", "募资"])])
    return _with_text(spark, d).select("result_id", F.size(ok).cast("bigint").alias("n_before"), F.size(left).cast("bigint").alias("n_after"))


def rep_12_joined_numbers(spark, d):
    parts = F.filter(F.split(F.regexp_extract("text", r"(\d{1,3}(?:,\d{3})+)股", 1), ","), lambda x: x != "")
    return _t(spark, d, "duee_fin_samples").where("text is not null").select("row_id", R.joined_numbers(parts, F.col("text")).alias("joined")).where("joined is not null")


def rep_17_profile_changed(spark, d):
    ok = F.filter(F.coalesce("prediction", F.array()), lambda e: e.isNotNull())
    args = F.flatten(F.transform(F.filter(ok, lambda e: e["arguments"].isNotNull()), lambda e: F.filter(e["arguments"], lambda a: a.isNotNull())))
    kept = F.flatten(F.transform(ok, lambda e: R.filled_args(e["arguments"])))
    return _t(spark, d, "evaluation_results").select("result_id", (F.size(args) != F.size(kept)).alias("changed"))


def txt_06_bigrams(spark, d):
    rows = _t(spark, d, "duee_fin_samples").where("title is not null and text is not null")
    rows = rows.select("row_id", T.char_ngrams(F.col("title")).alias("a"), T.char_ngrams(F.col("text")).alias("b"))
    return rows.select("row_id", T.jaccard(F.col("a"), F.col("b")).alias("similarity"))


def txt_07_keywords(spark, d):
    return _t(spark, d, "documents").where("text is not null").select("doc_id", F.size(T.keywords(F.col("text"))).cast("bigint").alias("n_keywords"))


def txt_08_thoughts(spark, d):
    return _t(spark, d, "evaluation_results").where("raw_response is not null").select("result_id", F.coalesce(T.thought_text(F.col("raw_response")), F.lit("")).alias("thought"))


def txt_11_ground_status(spark, d):
    a = SQ._args(spark, d).where("side = 'pred'").where(A.filled("argument"))
    texts = _with_text(spark, d, True).select(F.col("result_id").alias("doc_id"), "text", "_long")
    return a.join(texts, "doc_id").select("doc_id", "event_idx", "arg_idx", T.ground_status(F.col("argument"), F.col("text"), "exact+fuzzy", long=F.col("_long")).alias("status"))


def txt_12_companies(spark, d):
    return _t(spark, d, "issuers").select("issuer_code", T.without_company_ending(F.col("full_name")).alias("short"))


def txt_13_split_values(spark, d):
    a = SQ._args(spark, d).where("side = 'gold'").where(A.filled("argument"))
    texts = _with_text(spark, d).select(F.col("result_id").alias("doc_id"), "text")
    return a.join(texts, "doc_id").select("doc_id", "event_idx", "arg_idx", F.size(R.split_value(F.col("argument"), F.coalesce("text", F.lit("")))).cast("bigint").alias("n_parts"))


def txt_14_perturbed(spark, d):
    return _t(spark, d, "duee_fin_samples").where("text is not null").select("row_id", R.perturbed(F.col("text")).alias("p")).select("row_id", "p.changed", "p.type", "p.old_value", "p.new_value", F.sha2("p.text", 256).alias("digest"))


def prj_11_user_prompt(spark, d):
    return _t(spark, d, "duee_fin_samples").where("text is not null").select("row_id", F.concat(F.lit("请从以下文本中抽取事件：\n"), T.truncated(F.col("text"), 3500, "...[文本已截断]")).alias("prompt"))


def prj_13_messages(spark, d):
    m = F.array(F.struct(F.lit("system").alias("role"), F.lit("抽取事件").alias("content")), F.struct(F.lit("user").alias("role"), F.coalesce("text", F.lit("")).alias("content")))
    return _t(spark, d, "duee_fin_samples").select("row_id", F.posexplode(m).alias("pos", "m")).select("row_id", "pos", "m.role", F.sha2("m.content", 256).alias("digest"))


def prj_15_restricted_schema(spark, d):
    known = _t(spark, d, "schema_roles").select("event_type").distinct().agg(F.array_sort(F.collect_set("event_type")))
    rows = _t(spark, d, "evaluation_results").select("result_id", A.event_type_list(F.col("prediction")).alias("p")).withColumn("all", known.scalar())
    some = F.filter("all", lambda t: F.array_contains(F.coalesce("p", F.array().cast("array<string>")), t))
    return rows.select("result_id", F.array_join(F.when(F.size(some) > 0, some).otherwise(F.col("all")), "|").alias("types"))


def prj_16_focus(spark, d):
    rows = _t(spark, d, "duee_fin_samples").where("text is not null and size(event_types) > 0")
    return rows.select("row_id", F.char_length(T.focus_sentences(F.col("text"), F.col("event_types"))).alias("n"))


def prj_18_typed_payloads(spark, d):
    return _t(spark, d, "evaluation_results").select("result_id", F.posexplode(A.event_type_list(F.col("prediction"))).alias("pos", "event_type"))


def prj_19_merged_types(spark, d):
    j = A.events(_t(spark, d, "evaluation_results"), ("sample_id",)).where("side = 'pred'").where(A.filled("event_type"))
    first = j.groupBy("sample_id", "event_type").agg(F.min(F.struct("doc_id", "event_idx")).alias("at"))
    return first.groupBy("sample_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "event_type"))), lambda x: x["event_type"]), "|").alias("types"))


def ret_01_pool(spark, d):
    p = RT.example_pool(_t(spark, d, "duee_fin_samples").where("split = 'train'"))
    return p.select("id", F.array_join("event_types", "|").alias("types"), F.array_join("triggers", "|").alias("triggers"), F.size("keywords").cast("bigint").alias("n_keywords"))


def _retrieval(spark, d):
    s = _t(spark, d, "duee_fin_samples")
    pool = RT.example_pool(s.where("split = 'train'"))
    types = _universe(spark, d)
    queries = s.where("row_id % 100 = 0 and text is not null").select(F.col("row_id").alias("qid"), "text", F.coalesce("event_types", F.array().cast("array<string>")).alias("known"))
    queries = queries.select("qid", "text", F.when(F.size("known") > 0, F.col("known")).otherwise(RT.named_types(F.col("text"), types)).alias("types"))
    return RT.ranked(queries, pool, schema=types)


def ret_04_scores(spark, d):
    """Scores of the examples that the choice looks at; every other one scores less."""
    return _retrieval(spark, d).select("qid", "place", "id", "score", "similarity", "overlap", "type_hits", "trigger_hits", "word_hits")


def ret_06_examples(spark, d):
    return RT.covering(_retrieval(spark, d)).select("qid", F.array_join(F.transform("ids", lambda i: i.cast("string")), "|").alias("ids"))


def smp_01_strata(spark, d):
    return _t(spark, d, "duee_fin_samples").where("split = 'train'").groupBy(SP.stratum(F.col("event_types")).alias("stratum")).agg(F.count("*").alias("n"))


def smp_03_split(spark, d):
    return SP.stratified_split(_t(spark, d, "duee_fin_samples").where("split = 'train'"), "row_id", "event_types")


def smp_05_epoch_order(spark, d):
    return SP.epoch_order(_t(spark, d, "duee_fin_samples").select("row_id"), "row_id", 3407, 2)


def trn_01_stages(spark, d):
    return TR.expand_stages(_t(spark, d, "duee_fin_samples"), "two_stage_per_type")


def _universe(spark, d):
    return [r[0] for r in _t(spark, d, "schema_roles").select("event_type").distinct().orderBy("event_type").collect()]


def trn_02_negative_types(spark, d):
    gold = F.coalesce(A.event_type_list(F.col("events")), F.array().cast("array<string>"))
    rows = _t(spark, d, "duee_fin_samples").select("row_id", gold.alias("g"))
    return rows.select("row_id", F.array_join(TR.negative_types(F.col("row_id").cast("string"), F.col("g"), _universe(spark, d)), "|").alias("types"))


def _side(spark, d, family):
    r = _t(spark, d, "evaluation_results").join(F.broadcast(_t(spark, d, "eval_runs").where(F.col("family") == family).select("run_key")), "run_key")
    return r.groupBy("sample_id").agg(F.max_by(F.struct("parse_success", F.col("prediction").alias("events")), "result_id").alias("x")).select("sample_id", "x.parse_success", "x.events")


def trn_04_consensus(spark, d):
    texts = _texts(spark, d).withColumnRenamed("id", "sample_id")
    return TR.consensus(_side(spark, d, "api"), _side(spark, d, "local"), texts)


def trn_04_reasons(spark, d):
    return trn_04_consensus(spark, d).groupBy("reason").agg(F.count("*").alias("n"), F.round(F.avg("agreement"), 6).alias("agreement"))


def neg_03_strategies(spark, d):
    key = F.concat_ws(":", F.lit("neg"), F.col("event_id").cast("string"))
    threshold = X.pacing_threshold(F.col("event_id"), F.lit(10000))
    return _t(spark, d, "events").select("event_id", TR.paced_strategy(key, threshold).alias("strategy"))


def neg_02_nudged(spark, d):
    a = SQ._args(spark, d).where("side = 'gold'").where(A.filled("argument"))
    return a.select("doc_id", "event_idx", "arg_idx", TR.nudged_number(F.col("argument"), F.concat_ws(":", "doc_id", "event_idx", "arg_idx")).alias("wrong"))


def agg_34_strategy_histogram(spark, d):
    return neg_03_strategies(spark, d).groupBy("strategy").agg(F.count("*").alias("n"))


def grf_01_edges(spark, d):
    return G.schema_tree(_t(spark, d, "schema_roles"))


def _geo(spark, d):
    n, r = _t(spark, d, "nation"), _t(spark, d, "region")
    up = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"))
    return up.unionByName(r.select(F.col("r_name").alias("child"), F.lit(G.ROOT).alias("parent"))), n.select(F.col("n_name").alias("node"))


def grf_02_distances(spark, d):
    tree, nodes = _geo(spark, d)
    return G.similarity(G.distances(tree, nodes, nodes, 2), 4)


def grf_04_siblings(spark, d):
    tree, nodes = _geo(spark, d)
    return G.distances(tree, nodes, nodes, 2).where("distance = 2").groupBy("a").agg(F.count("*").alias("n_siblings"))


def grf_04_shape(spark, d):
    return G.shape(G.schema_tree(_t(spark, d, "schema_roles")))


def _losses(spark, d):
    return _t(spark, d, "events").select(F.col("user_id").alias("key"), F.struct("ts", "event_id").alias("order"), (F.col("value") / 500).alias("loss"))


def stm_01_competence(spark, d):
    return competence(_losses(spark, d)).select("key", "step", F.round("competence", 6).alias("competence"))


def stm_05_final_state(spark, d):
    c = competence(_losses(spark, d))
    return c.groupBy("key").agg(F.max("step").alias("steps"), F.round(F.max_by("competence", "step"), 6).alias("competence"))


def stm_03_dedupe_calls(spark, d):
    r = _t(spark, d, "evaluation_results").where("raw_response is not null").select(F.sha1("raw_response").alias("k"))
    return r.groupBy("k").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n_calls"), F.count("*").alias("n_distinct"), (F.sum("n") - F.count("*")).alias("n_hits"))


def stm_07_windows(spark, d):
    return windowed_counts(_t(spark, d, "events")).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def win_01_recent_share(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-99, 0)
    return _t(spark, d, "events").select("event_id", F.count(F.when(F.col("event_type") == "click", 1)).over(w).alias("n_click"), F.count("*").over(w).alias("n"))


def win_02_recent_mean(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-49, 0)
    return _t(spark, d, "events").select("event_id", (F.sum(F.round(F.col("value") * 100).cast("bigint")).over(w) / (F.count("*").over(w) * 100)).alias("mean"))


def win_07_recent_deviation(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-199, 0)
    return _t(spark, d, "events").select("event_id", F.round(F.stddev_pop("value").over(w), 5).alias("std"))


def win_08_last_rows(spark, d):
    w = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return _t(spark, d, "events").withColumn("n", F.row_number().over(w)).where("n <= 10").select("event_id", "n")


def sta_01_bootstrap(spark, d):
    """1000 draws of the scores whose counts SQL can give as well."""
    return ST.bootstrap(SQ.agg_18_sample_counts(spark, d), names=("strict", "type"))


def sta_01_interval(spark, d):
    return ST.interval(sta_01_bootstrap(spark, d))


def sta_01_all_intervals(spark, d):
    """Ranges of all 27 scores over 1000 draws."""
    return ST.interval(ST.bootstrap(SQ.agg_18_sample_counts(spark, d)))


def _pairs(spark, d):
    """Scores of version 1 and 2 of each family and seed, paired by seed."""
    m = SQ._run_metrics(spark, d)
    m = m.select(F.split("run_key", "_")[0].alias("family"), F.split("run_key", "_")[1].alias("version"), F.split("run_key", "_")[2].alias("seed"), "metric", "value")
    a, b = (m.where(F.col("version") == v).select("family", "seed", "metric", F.col("value").alias(n)) for v, n in (("v1", "baseline"), ("v2", "improved")))
    return a.join(b, ["family", "seed", "metric"])


def join_09_seed_pairs(spark, d):
    return _pairs(spark, d)


def sta_02_permutation(spark, d):
    return ST.permutation(_pairs(spark, d), ["family", "metric"])


def _source_pairs(spark, d):
    """Success rates of both families, paired by source and year: more pairs than all signs can be gone through."""
    r = _t(spark, d, "evaluation_results").where("parse_success is not null").withColumn("year", F.date_format("evaluated_at", "yyyy"))
    r = r.select("run_key", "source", "year", F.col("parse_success").cast("int").alias("ok")).join(F.broadcast(_t(spark, d, "eval_runs").select("run_key", "family")), "run_key")
    s = r.groupBy("source", "year").agg(*[F.avg(F.when(F.col("family") == f, F.col("ok").cast("double"))).alias(n) for f, n in (("local", "baseline"), ("api", "improved"))])
    return s.where("baseline is not null and improved is not null")


def sta_02_monte_carlo(spark, d):
    tested = ST.permutation(_source_pairs(spark, d).withColumn("metric", F.lit("parse_success")), ["metric"])
    return tested.withColumn("mean_diff", F.round("mean_diff", 9))


def sta_03_metadata(spark, d):
    return ST.significance_metadata(sta_02_permutation(spark, d), "family")


def sta_05_findings(spark, d):
    wide = SQ._run_metrics(spark, d).groupBy("run_key").pivot("metric", ["f1", "precision", "recall"]).agg(F.first("value"))
    return ST.findings(wide, "run_key", {"f1": "strict f1", "precision": "strict precision", "recall": "strict recall"}, "api_v1_s3400")


def join_10_deltas(spark, d):
    m = SQ._run_metrics(spark, d)
    ref = m.where("run_key = 'api_v1_s3400'").select("metric", F.col("value").alias("ref"))
    return m.join(F.broadcast(ref), "metric").select("run_key", "metric", (F.col("value") - F.col("ref")).alias("delta"))


def join_11_completeness(spark, d):
    sources = _t(spark, d, "duee_fin_samples").agg(F.collect_set("source"))
    expected = _t(spark, d, "eval_runs").select("run_key").withColumn("sources", sources.scalar()).select("run_key", F.explode("sources").alias("source"))
    return C.missing_rows(expected, _t(spark, d, "evaluation_results"), ["run_key", "source"])


def join_05_latest_result(spark, d):
    r = _t(spark, d, "evaluation_results")
    last = r.groupBy("sample_id").agg(F.max("result_id").alias("result_id"))
    s = _t(spark, d, "duee_fin_samples").select("row_id", F.col("id").alias("sample_id"))
    return s.join(last, "sample_id", "left").select("row_id", "result_id")


def join_06_allowed(spark, d):
    return _t(spark, d, "evaluation_results").join(_t(spark, d, "duee_fin_samples").where("split = 'dev'").select(F.col("id").alias("sample_id")), "sample_id", "left_semi").select("result_id")


def join_07_known_roles(spark, d):
    a = SQ._args(spark, d).where("side = 'pred'")
    return a.join(F.broadcast(_t(spark, d, "schema_roles").select("event_type", "role").distinct()), ["event_type", "role"], "left_semi").select("doc_id", "event_idx", "arg_idx")


def val_04_null_fields(spark, d):
    return C.null_fields(_t(spark, d, "duee_fin_samples"), "row_id", ["id", "title", "text", "issuer_code", "source"])


def val_03_outside(spark, d):
    return C.outside(_t(spark, d, "eval_runs"), "stage_mode", ["e2e", "two_stage", "two_stage_per_type"]).select("run_key", "stage_mode")


def mth_01_curves(spark, d):
    v = F.col("value") / 500
    return _t(spark, d, "events").select("event_id", F.round(X.sigmoid((F.lit(0.5) - v) / 0.2), 9).alias("signal"), F.round(X.linear_threshold(v), 9).alias("threshold"), F.round(X.competence_weight(v), 9).alias("weight"), X.margin_bucket(v).alias("offset"), F.round(X.pacing_threshold(F.col("event_id"), F.lit(10000)), 9).alias("pace"))


def mth_05_stable_choice(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.stable_choice(F.array(F.lit("b"), F.lit("a"), F.lit("c")), F.col("doc_id").cast("string")).alias("pick"))


def mth_06_digests(spark, d):
    return _t(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha256"), F.sha1("text").alias("sha1"))


def set_03_leakage(spark, d):
    """Words of only one of two whole answers to the same sample over the words of either; the two are the first and the last one written."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"[\x{4e00}-\x{9fa5}A-Za-z0-9_]+"), F.lit(0)))
    r = _t(spark, d, "evaluation_results").where("raw_response is not null")
    pair = r.groupBy("sample_id").agg(F.min_by("raw_response", "result_id").alias("x"), F.max_by("raw_response", "result_id").alias("y"), F.count("*").alias("n")).where("n > 1")
    rows = pair.select("sample_id", words(F.col("x")).alias("a"), words(F.col("y")).alias("b"))
    return rows.select("sample_id", X.safe_div(F.size(F.array_except("a", "b")) + F.size(F.array_except("b", "a")), F.size(F.array_union("a", "b"))).alias("apart"))


def set_08_union(spark, d):
    s = _t(spark, d, "duee_fin_samples")
    return s.where("split = 'train'").select("row_id", F.lit("gold").alias("origin")).unionByName(s.where("split = 'sample'").select("row_id", F.lit("silver").alias("origin")))


def set_10_dedupe_events(spark, d):
    ok = F.array_distinct(F.filter("prediction", lambda e: e.isNotNull()))
    return _t(spark, d, "evaluation_results").where("prediction is not null").select("result_id", F.size(ok).cast("bigint").alias("n"))


def agg_24_samples_summary(spark, d):
    return _t(spark, d, "duee_fin_samples").groupBy("split").agg(F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_ids"), F.sum(F.greatest(F.coalesce(F.size("events"), F.lit(0)), F.lit(0))).alias("n_events"), F.max(F.char_length("text")).alias("longest"))


def agg_26_usage(spark, d):
    r = _t(spark, d, "evaluation_results").join(F.broadcast(_t(spark, d, "eval_runs")), "run_key")
    return r.groupBy("family", "stage_mode").agg(F.sum(F.coalesce(F.char_length("raw_response"), F.lit(0))).alias("n_chars"), F.count("*").alias("n_calls"))


def srt_09_percentiles(spark, d):
    return nearest_ranks(_t(spark, d, "documents"), "source", "n_chars", {"median": 0.5, "p90": 0.9})


BASE = SQ.BASE
_ST = SQ._strip
_TX = f"texts AS (SELECT id, arg_max(text, row_id) AS text FROM (SELECT {_ST('id')} AS id, {_ST('text')} AS text, row_id FROM duee_fin_samples) WHERE id <> '' AND text <> '' GROUP BY id)"
_GF = r"""regexp_replace(lower({0}), '[\s\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\.,，。；;、:：/\\()（）\[\]【】"''“”‘’《》<>·\-—_]+', '', 'g')"""
_NUM = "CAST(('0x' || substr(sha256({0}), 1, 8)) AS BIGINT)"
_RF = r"lower(array_to_string(regexp_extract_all({0}, '[\x{{4e00}}-\x{{9fff}}A-Za-z0-9]+'), ''))"
_BI = "CASE WHEN length({0}) = 0 THEN [] WHEN length({0}) < 2 THEN [{0}] ELSE list_distinct(list_transform(range(1, length({0})), lambda i: substring({0}, CAST(i AS BIGINT), 2))) END"
_X = """
WITH x0 AS (SELECT result_id, coalesce(raw_response, '') AS t FROM evaluation_results),
x1 AS (SELECT *, regexp_extract_all(t, '(?is)```(?:json)?\\s*\\n?(.*?)\\n?```', 1) AS b FROM x0),
x AS (SELECT result_id, CASE WHEN trim(t) = '' THEN 'empty_input' WHEN len(b) > 0 THEN 'markdown_block' WHEN regexp_matches(t, '(?s)\\[\\s*\\{.*\\}\\s*\\]') THEN 'array_pattern' WHEN regexp_matches(t, '(?s)\\{[^{}]*(?:\\{[^{}]*\\}[^{}]*)*\\}') THEN 'object_pattern' WHEN contains(t, '[]') THEN 'empty_array' WHEN regexp_matches(trim(t), '^[\\[{]') THEN 'raw_json' ELSE 'no_json_found' END AS method,
 regexp_replace(CASE WHEN trim(t) = '' THEN NULL WHEN len(b) > 0 THEN b[-1] WHEN regexp_matches(t, '(?s)\\[\\s*\\{.*\\}\\s*\\]') THEN regexp_extract(t, '(?s)\\[\\s*\\{.*\\}\\s*\\]') WHEN regexp_matches(t, '(?s)\\{[^{}]*(?:\\{[^{}]*\\}[^{}]*)*\\}') THEN regexp_extract(t, '(?s)\\{[^{}]*(?:\\{[^{}]*\\}[^{}]*)*\\}') WHEN contains(t, '[]') THEN '[]' WHEN regexp_matches(trim(t), '^[\\[{]') THEN t END, '^\\s+|\\s+$', '', 'g') AS json FROM x1)
"""
_RUNGS = (
    _X
    + """, r0 AS (SELECT result_id, json AS c0, translate(json, '，：；“”‘’【】（）｛｝', ',:;""''''[](){}') AS c1 FROM x WHERE json IS NOT NULL),
r2 AS (SELECT *, regexp_replace(c1, ',\\s*([\\]}])', '\\1', 'g') AS c2 FROM r0), r3 AS (SELECT *, regexp_replace(c2, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g') AS c3 FROM r2),
r4 AS (SELECT *, c3 || repeat('}', greatest(0, length(replace(c3,'}','')) - length(replace(c3,'{','')))) || repeat(']', greatest(0, length(replace(c3,']','')) - length(replace(c3,'[','')))) AS c4 FROM r3),
r5 AS (SELECT *, regexp_replace(c4, '''([^'']+)''(\\s*:)', '"\\1"\\2', 'g') AS c5 FROM r4),
rungs AS (SELECT result_id, unnest([c0,c1,c2,c3,c4,c5]) AS json, generate_subscripts([c0,c1,c2,c3,c4,c5], 1) - 1 AS rung FROM r5)
"""
)
_UP = "EV AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, value / 500 AS loss FROM events)"
_COMP = (
    "WITH RECURSIVE "
    + _UP
    + """, C AS (SELECT key, step, least(0.05e0 + 0.3e0 * step / 10, 0.95e0) AS c FROM EV WHERE step = 1
  UNION ALL SELECT e.key, e.step, CASE WHEN e.step <= 10 THEN least(0.05e0 + 0.3e0 * e.step / 10, 0.95e0) ELSE greatest(0.05e0, least(0.95e0, 0.9e0 * C.c + 0.1e0 / (1e0 + exp(-(0.5e0 - e.loss) / 0.2e0)))) END FROM C JOIN EV e ON e.key = C.key AND e.step = C.step + 1)
"""
)
_PAIRS = BASE + ", mm AS (SELECT split_part(run_key,'_',1) AS family, split_part(run_key,'_',2) AS version, split_part(run_key,'_',3) AS seed, metric, value FROM runm), pr AS (SELECT a.family, a.seed, a.metric, a.value AS baseline, b.value AS improved FROM mm a JOIN mm b ON a.family=b.family AND a.seed=b.seed AND a.metric=b.metric WHERE a.version='v1' AND b.version='v2')"
_POIS = " + ".join(f"CAST(u >= {p!r} AS INT)" for p in ST.POISSON)
def _prf_sql(n: str) -> str:
    p, r = SQ._div(f"{n}_tp", f"{n}_pred"), SQ._div(f"{n}_tp", f"{n}_gold")
    return f"{p} AS {n}_precision, {r} AS {n}_recall, CASE WHEN {p} + {r} = 0 THEN 0.0e0 ELSE 2.0e0*{p}*{r}/({p}+{r}) END AS {n}_f1"


_BOOT = (
    BASE
    + f""", c0 AS (SELECT doc_id, sum(tp) AS strict_tp, sum(tp+fp) AS strict_pred, sum(tp+fn) AS strict_gold FROM sm GROUP BY doc_id),
 c1 AS (SELECT doc_id, sum(CAST(g AND p AS INT)) AS type_tp, sum(CAST(p AS INT)) AS type_pred, sum(CAST(g AS INT)) AS type_gold FROM (SELECT doc_id, max(side='gold') AS g, max(side='pred') AS p FROM etypes GROUP BY doc_id, event_type) GROUP BY doc_id),
 c AS (SELECT r.result_id AS doc_id, {', '.join(f'coalesce({n}_{k}, 0) AS {n}_{k}' for n in ('strict', 'type') for k in ('tp', 'pred', 'gold'))} FROM evaluation_results r LEFT JOIN c0 ON c0.doc_id = r.result_id LEFT JOIN c1 ON c1.doc_id = r.result_id),
 h AS (SELECT *, CAST(('0x' || substr(sha256('3407:' || doc_id), 1, 16)) AS UBIGINT) AS h FROM c),
 x0 AS (SELECT h.*, CAST(r.range AS INT) AS draw, CAST((CAST(h AS UHUGEINT) + CAST(r.range + 1 AS UHUGEINT) * 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT) AS x FROM h, range(0, 1000) r),
 x1 AS (SELECT * REPLACE (CAST(CAST(xor(x, x >> 30) AS UHUGEINT) * 13787848793156543929::UHUGEINT % 18446744073709551616::UHUGEINT AS UBIGINT) AS x) FROM x0),
 x2 AS (SELECT * REPLACE (CAST(CAST(xor(x, x >> 27) AS UHUGEINT) * 10723151780598845931::UHUGEINT % 18446744073709551616::UHUGEINT AS UBIGINT) AS x) FROM x1),
 u AS (SELECT *, CAST(xor(x, x >> 31) >> 11 AS DOUBLE) / 9007199254740992.0e0 AS u FROM x2), w AS (SELECT *, {_POIS} AS w FROM u),
 s AS (SELECT draw, {', '.join(f'sum(w*{n}_{k}) AS {n}_{k}' for n in ('strict', 'type') for k in ('tp', 'pred', 'gold'))} FROM w GROUP BY draw),
 bs AS (SELECT draw, {', '.join(map(_prf_sql, ('strict', 'type')))} FROM s)
"""
)
_GTYPES = SQ._types_list("events")
ORACLES = {
    "src_01_samples": f"SELECT row_id, CAST(CASE WHEN length(text) > 3500 THEN 3503 ELSE length(text) END AS INT) AS n, coalesce(array_to_string(list_filter(list_transform(list_filter(events, lambda e: e IS NOT NULL), lambda e: e.event_type), lambda t, i: coalesce(t,'') <> '' AND list_position(list_transform(list_filter(events, lambda e: e IS NOT NULL), lambda e: e.event_type), t) = i), '|'), '') AS types FROM duee_fin_samples WHERE {_ST('text')} <> ''",
    "src_02_schema_map": "SELECT event_type, string_agg(role, '|' ORDER BY role_pos) AS roles FROM schema_roles GROUP BY event_type",
    "src_05_payload_ids": "SELECT line_id, CAST(payload AS JSON) ->> '$.id' AS id, CAST(payload AS JSON) ->> '$.stage_meta.stage_mode' AS stage_mode FROM result_lines",
    "src_06_text_index": f"WITH {_TX} SELECT * FROM texts",
    "src_07_alias_map": "SELECT event_type, count(*) AS n_aliases, count(DISTINCT canonical) AS n_roles FROM role_alias GROUP BY event_type",
    "snk_01_sorted_results": "SELECT sample_id, result_id, run_key FROM evaluation_results ORDER BY sample_id, result_id",
    "flt_05_known_types": "SELECT row_id FROM duee_fin_samples s WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(s.event_types) AS t) u WHERE u.t NOT IN (SELECT event_type FROM schema_roles))",
    "flt_06_should_correct": "SELECT result_id FROM evaluation_results WHERE parse_diagnostics.extraction_method <> 'no_json_found' AND NOT coalesce(parse_success, true)",
    "jsn_01_extract": _X + "SELECT result_id, method, sha256(json) AS digest FROM x",
    "jsn_02_repairs": _RUNGS + "SELECT result_id, CAST(rung AS INT) AS rung, sha256(json) AS digest FROM rungs",
    "rep_02_cat_lite": BASE
    + f""", {_TX.replace('texts AS', 'tx AS')}, b AS (SELECT result_id AS doc_id, lower(regexp_replace(coalesce(t.text,''), '{T.SPACE}+', '', 'g')) AS body FROM evaluation_results r LEFT JOIN tx t ON t.id = r.sample_id),
    k AS (SELECT a.doc_id, a.event_idx FROM args a JOIN b ON b.doc_id = a.doc_id WHERE side='pred' AND {_ST('role')} <> '' AND {_ST('argument')} <> '' AND ({_ST('event_type')}, {_ST('role')}) IN (SELECT (event_type, role) FROM schema_roles) AND contains(b.body, lower(regexp_replace(argument, '{T.SPACE}+', '', 'g')))),
    s AS (SELECT doc_id, count(DISTINCT event_idx) AS n_events, count(*) AS n_args FROM k GROUP BY doc_id) SELECT result_id, coalesce(n_events, 0) AS n_events, coalesce(n_args, 0) AS n_args FROM evaluation_results LEFT JOIN s ON s.doc_id = result_id""",
    "rep_05_record_split": BASE
    + f""", pm AS (SELECT event_type, role FROM schema_roles WHERE role_pos = 0), n AS (SELECT e.doc_id, e.event_idx, count(DISTINCT CASE WHEN {_ST('a.role')} = pm.role AND {_ST('a.argument')} <> '' THEN {_ST('a.argument')} END) AS n FROM ev e LEFT JOIN pm ON pm.event_type = e.event_type LEFT JOIN args a ON a.doc_id=e.doc_id AND a.side=e.side AND a.event_idx=e.event_idx WHERE e.side='pred' GROUP BY ALL),
    s AS (SELECT doc_id, count(*) AS b, CAST(sum(greatest(1, n)) AS BIGINT) AS a FROM n GROUP BY doc_id) SELECT result_id, coalesce(b, 0) AS n_before, coalesce(a, 0) AS n_after FROM evaluation_results LEFT JOIN s ON s.doc_id = result_id""",
    "txt_06_bigrams": f"WITH t AS (SELECT row_id, {_RF.format('title')} AS a, {_RF.format('text')} AS b FROM duee_fin_samples WHERE title IS NOT NULL AND text IS NOT NULL), g AS (SELECT row_id, {_BI.format('a')} AS a, {_BI.format('b')} AS b FROM t) SELECT row_id, CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a,b)) / CAST(len(list_distinct(list_concat(a,b))) AS DOUBLE) ELSE 0.0e0 END AS similarity FROM g",
    "txt_07_keywords": "SELECT doc_id, CAST(len(list_filter(list_distinct(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}A-Za-z0-9]{2,}')), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "))) AS BIGINT) AS n_keywords FROM documents WHERE text IS NOT NULL",
    "txt_08_thoughts": f"SELECT result_id, coalesce(CASE WHEN regexp_matches(raw_response, '(?is)<thought>(.*?)</thought>') THEN {_ST(chr(39).join(['regexp_extract(raw_response, ', '(?is)<thought>(.*?)</thought>', ', 1)']))} WHEN strpos(lower(raw_response), '```json') > 1 THEN {_ST(chr(39).join(['left(raw_response, strpos(lower(raw_response), ', '```json', ')-1)']))} END, '') AS thought FROM evaluation_results WHERE raw_response IS NOT NULL",
    "txt_11_ground_status": BASE
    + f""", {_TX.replace('texts AS', 'tx AS')}, j AS (SELECT a.doc_id, event_idx, arg_idx, {_ST('argument')} AS r, coalesce(t.text,'') AS s FROM args a JOIN evaluation_results e ON e.result_id = a.doc_id LEFT JOIN tx t ON t.id = e.sample_id WHERE side='pred' AND argument <> '')
    SELECT doc_id, event_idx, arg_idx, CASE WHEN r = '' OR s = '' THEN 'ungrounded' WHEN contains(s, r) THEN 'exact' WHEN {_GF.format('r')} <> '' AND contains({_GF.format('s')}, {_GF.format('r')}) THEN 'normalized_exact' ELSE 'ungrounded' END AS status FROM j""",
    "txt_12_companies": f"SELECT issuer_code, regexp_replace(full_name, '({'|'.join(T.COMPANY_ENDINGS)})$', '') AS short FROM issuers",
    "prj_11_user_prompt": "SELECT row_id, '请从以下文本中抽取事件：' || chr(10) || CASE WHEN length(text) > 3500 THEN substring(text, 1, 3500) || '...[文本已截断]' ELSE text END AS prompt FROM duee_fin_samples WHERE text IS NOT NULL",
    "prj_13_messages": "SELECT row_id, 0 AS pos, 'system' AS role, sha256('抽取事件') AS digest FROM duee_fin_samples UNION ALL SELECT row_id, 1, 'user', sha256(coalesce(text, '')) FROM duee_fin_samples",
    "prj_15_restricted_schema": f"WITH k AS (SELECT list_sort(list(DISTINCT event_type)) AS a FROM schema_roles), r AS (SELECT result_id, coalesce({SQ._types_list('prediction')}, []) AS p FROM evaluation_results), s AS (SELECT result_id, a, list_filter(a, lambda t: list_contains(p, t)) AS x FROM r, k) SELECT result_id, array_to_string(CASE WHEN len(x) > 0 THEN x ELSE a END, '|') AS types FROM s",
    "prj_18_typed_payloads": f"WITH r AS (SELECT result_id, {SQ._types_list('prediction')} AS p FROM evaluation_results) SELECT result_id, CAST(generate_subscripts(p, 1) - 1 AS INT) AS pos, unnest(p) AS event_type FROM r",
    "prj_19_merged_types": BASE + ", f AS (SELECT r.sample_id, e.event_type, min(e.doc_id * 1000 + e.event_idx) AS k FROM ev e JOIN evaluation_results r ON r.result_id = e.doc_id WHERE side='pred' AND e.event_type <> '' GROUP BY ALL) SELECT sample_id, string_agg(event_type, '|' ORDER BY k) AS types FROM f GROUP BY sample_id",
    "smp_01_strata": f"SELECT coalesce(nullif(array_to_string(list_sort(list_distinct(list_filter(list_transform(event_types, lambda t: {_ST('t')}), lambda t: t <> ''))), '|'), ''), '__no_event__') AS stratum, count(*) AS n FROM duee_fin_samples WHERE split = 'train' GROUP BY 1",
    "smp_03_split": f"""WITH r AS (SELECT row_id, coalesce(nullif(array_to_string(list_sort(list_distinct(list_filter(list_transform(event_types, lambda t: {_ST('t')}), lambda t: t <> ''))), '|'), ''), '__no_event__') AS stratum FROM duee_fin_samples WHERE split = 'train'),
    h AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('3407:' || stratum || ':' || row_id), row_id) - 1 AS rk FROM r), c AS (SELECT stratum, count(*) AS n FROM r GROUP BY stratum),
    t AS (SELECT round_even(sum(n) * 0.1e0, 0) AS target, sum(floor(n * 0.1e0)) AS based FROM c), p AS (SELECT c.*, floor(n * 0.1e0) AS base, row_number() OVER (ORDER BY n * 0.1e0 - floor(n * 0.1e0) DESC, stratum DESC) AS place FROM c),
    k AS (SELECT stratum, base + CASE WHEN place <= target - based THEN 1 ELSE 0 END AS take FROM p, t) SELECT row_id, h.stratum, CASE WHEN rk < take THEN 'tune' ELSE 'fit' END AS part FROM h JOIN k ON k.stratum = h.stratum""",
    "smp_05_epoch_order": "SELECT row_id, sha256('3409:' || row_id) AS h FROM duee_fin_samples",
    "trn_01_stages": f"""WITH g AS (SELECT row_id, coalesce({_GTYPES}, []) AS t, list_filter(events, lambda e: e IS NOT NULL) AS ev FROM duee_fin_samples), x AS (SELECT row_id, unnest(t) AS event_type, ev FROM g)
    SELECT row_id, 'stage1' AS stage, CAST(NULL AS VARCHAR) AS event_type, CAST(len(t) AS BIGINT) AS n_events FROM g UNION ALL SELECT row_id, 'stage2_typed', event_type, CAST(len(list_filter(ev, lambda e: {_ST("coalesce(e.event_type,'')")} = event_type)) AS BIGINT) FROM x""",
    "grf_01_edges": "SELECT DISTINCT event_type || '::' || role AS child, event_type AS parent FROM schema_roles UNION SELECT event_type, 'ROOT' FROM schema_roles",
    "grf_02_distances": "WITH d AS (SELECT a.n_name AS a, b.n_name AS b, CAST(CASE WHEN a.n_nationkey = b.n_nationkey THEN 0 WHEN a.n_regionkey = b.n_regionkey THEN 2 ELSE 4 END AS INT) AS distance FROM nation a, nation b) SELECT *, 1.0e0 - distance / 4.0e0 AS similarity FROM d",
    "grf_04_siblings": "SELECT a.n_name AS a, count(*) AS n_siblings FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey GROUP BY 1",
    "grf_04_shape": "WITH e AS (SELECT DISTINCT event_type || '::' || role AS c, event_type AS p FROM schema_roles UNION SELECT event_type, 'ROOT' FROM schema_roles), n AS (SELECT c AS x FROM e UNION SELECT p FROM e) SELECT (SELECT count(*) FROM n) AS n_nodes, (SELECT count(*) FROM e) AS n_edges, 2.0e0 * (SELECT count(*) FROM e) / (SELECT count(*) FROM n) AS avg_degree",
    "stm_01_competence": _COMP + "SELECT key, step, round(c, 6) AS competence FROM C",
    "stm_05_final_state": _COMP + "SELECT key, max(step) AS steps, round(arg_max(c, step), 6) AS competence FROM C GROUP BY key",
    "stm_03_dedupe_calls": "SELECT count(raw_response) AS n_calls, count(DISTINCT raw_response) AS n_distinct, count(raw_response) - count(DISTINCT raw_response) AS n_hits FROM evaluation_results",
    "stm_07_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "win_01_recent_share": "SELECT event_id, count(CASE WHEN event_type = 'click' THEN 1 END) OVER w AS n_click, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)",
    "win_02_recent_mean": "SELECT event_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS DOUBLE) / (count(*) OVER w * 100) AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)",
    "win_07_recent_deviation": "SELECT event_id, round(stddev_pop(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW), 5) AS std FROM events",
    "win_08_last_rows": "SELECT event_id, CAST(n AS INT) AS n FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 10",
    "sta_01_bootstrap": _BOOT + "SELECT * FROM bs",
    "sta_01_interval": _BOOT + ", l AS (UNPIVOT bs ON COLUMNS(* EXCLUDE draw) INTO NAME metric VALUE value), v AS (SELECT metric, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std, list_sort(list(value)) AS v FROM l GROUP BY metric) SELECT metric, CAST(n AS BIGINT) AS n_draws, round(mean, 9) AS mean, round(std, 9) AS std, v[CAST(round_even((n-1)*0.025, 0) AS INT)+1] AS low, v[CAST(round_even((n-1)*0.975, 0) AS INT)+1] AS high FROM v",
    "join_09_seed_pairs": _PAIRS + "SELECT * FROM pr",
    "sta_02_permutation": _PAIRS
    + """, g AS (SELECT family, metric, list_sort(list(improved - baseline)) AS ds FROM pr GROUP BY ALL), h AS (SELECT *, len(ds) AS n FROM g), m AS (SELECT h.*, unnest(range(0, CAST(pow(2, n) AS BIGINT))) AS mask FROM h WHERE n BETWEEN 2 AND 20),
    s AS (SELECT family, metric, n, abs(list_sum(list_transform(ds, lambda x, i: CASE WHEN (mask >> (i-1)) & 1 = 1 THEN x ELSE -x END)) / n) >= abs(list_sum(ds) / n) - 1e-12 AS hit FROM m), p AS (SELECT family, metric, CAST(count(*) FILTER (WHERE hit) AS DOUBLE) / count(*) AS p_value FROM s GROUP BY ALL)
    SELECT h.family, h.metric, CAST(n AS INT) AS n_pairs, list_sum(ds) / n AS mean_diff, p_value, CASE WHEN n >= 2 THEN 'exact' END AS method, CASE WHEN n >= 2 THEN CAST(pow(2, n) AS BIGINT) END AS n_permutations, CASE WHEN n < 2 THEN 'too_few_pairs' ELSE 'tested' END AS status FROM h LEFT JOIN p ON p.family = h.family AND p.metric = h.metric""",
    "sta_03_metadata": _PAIRS + ", n AS (SELECT family, metric, count(*) AS n FROM pr GROUP BY ALL) SELECT family, 2 AS min_pairs, CAST(min(n) AS INT) AS observed_pairs, CASE WHEN min(n) < 2 THEN 'skipped_insufficient_pairs' ELSE 'computed' END AS status, CASE WHEN min(n) < 2 THEN 'a paired test needs at least 2 pairs for each comparison; observed ' || min(n) END AS reason FROM n GROUP BY family",
    "sta_05_findings": BASE + ", d AS (SELECT m.run_key, m.metric, round(m.value - r.value, 6) AS delta FROM runm m JOIN runm r ON r.metric = m.metric AND r.run_key = 'api_v1_s3400' WHERE m.run_key <> 'api_v1_s3400') SELECT run_key, metric, delta, run_key || ': strict ' || metric || ' is ' || CASE WHEN delta > 0 THEN 'higher' WHEN delta < 0 THEN 'lower' ELSE 'equal' END || CASE WHEN delta <> 0 THEN ' by ' || printf('%.4f', abs(delta)) ELSE '' END || ' (reference api_v1_s3400)' AS finding FROM d",
    "join_10_deltas": BASE + "SELECT m.run_key, m.metric, m.value - r.value AS delta FROM runm m JOIN runm r ON r.metric = m.metric AND r.run_key = 'api_v1_s3400'",
    "join_11_completeness": "SELECT run_key, source FROM (SELECT run_key, source FROM eval_runs, (SELECT DISTINCT source FROM duee_fin_samples)) EXCEPT SELECT run_key, source FROM evaluation_results",
    "join_05_latest_result": "SELECT row_id, m.r AS result_id FROM duee_fin_samples s LEFT JOIN (SELECT sample_id, max(result_id) AS r FROM evaluation_results GROUP BY 1) m ON m.sample_id = s.id",
    "join_06_allowed": "SELECT result_id FROM evaluation_results WHERE sample_id IN (SELECT id FROM duee_fin_samples WHERE split = 'dev')",
    "join_07_known_roles": BASE + "SELECT doc_id, event_idx, arg_idx FROM args WHERE side='pred' AND (event_type, role) IN (SELECT (event_type, role) FROM schema_roles)",
    "val_02_disagreeing": "SELECT family, count(DISTINCT stage_mode || chr(31) || pipeline_mode) AS n_contracts FROM eval_runs GROUP BY 1 HAVING n_contracts > 1",
    "val_04_null_fields": " UNION ALL ".join(f"SELECT row_id, '{c}' AS field FROM duee_fin_samples WHERE trim(coalesce({c}, '')) = ''" for c in ("id", "title", "text", "issuer_code", "source")),
    "val_03_outside": "SELECT run_key, stage_mode FROM eval_runs WHERE stage_mode NOT IN ('e2e','two_stage','two_stage_per_type')",
    "mth_01_curves": "WITH v AS (SELECT event_id, value / 500 AS v FROM events) SELECT event_id, round(1e0/(1e0+exp(-(0.5e0-v)/0.2e0)), 9) AS signal, round(4e0 - 3e0*v, 9) AS threshold, round(1e0 + 0.2e0*(1e0-v), 9) AS weight, CAST(CASE WHEN v < 0.08 THEN 0.4 WHEN v < 0.16 THEN 0.3 WHEN v < 0.30 THEN 0.2 ELSE 0.1 END AS DOUBLE) AS \"offset\", round(4e0 - 3e0 * least(1e0, sqrt(least(1e0, CAST(event_id AS DOUBLE)/10000e0)*0.99e0 + 0.01e0)), 9) AS pace FROM v",
    "mth_05_stable_choice": f"SELECT doc_id, ['a','b','c'][{_NUM.format('CAST(doc_id AS VARCHAR)')} % 3 + 1] AS pick FROM documents",
    "mth_06_digests": "SELECT doc_id, sha256(text) AS sha256, sha1(text) AS sha1 FROM documents WHERE text IS NOT NULL",
    "set_03_leakage": "WITH p AS (SELECT sample_id, arg_min(raw_response, result_id) AS x, arg_max(raw_response, result_id) AS y FROM evaluation_results WHERE raw_response IS NOT NULL GROUP BY sample_id HAVING count(*) > 1), w AS (SELECT sample_id, list_distinct(regexp_extract_all(x, '[\\x{4e00}-\\x{9fa5}A-Za-z0-9_]+')) AS a, list_distinct(regexp_extract_all(y, '[\\x{4e00}-\\x{9fa5}A-Za-z0-9_]+')) AS b FROM p), n AS (SELECT sample_id, len(list_intersect(a,b)) AS i, len(list_distinct(list_concat(a,b))) AS u FROM w) SELECT sample_id, CASE WHEN u = 0 THEN 0.0e0 ELSE CAST(u - i AS DOUBLE) / u END AS apart FROM n",
    "set_08_union": "SELECT row_id, 'gold' AS origin FROM duee_fin_samples WHERE split = 'train' UNION ALL SELECT row_id, 'silver' FROM duee_fin_samples WHERE split = 'sample'",
    "set_10_dedupe_events": "SELECT result_id, CAST(len(list_distinct(list_transform(list_filter(prediction, lambda e: e IS NOT NULL), lambda e: CAST(e AS VARCHAR)))) AS BIGINT) AS n FROM evaluation_results WHERE prediction IS NOT NULL",
    "agg_24_samples_summary": "SELECT split, count(*) AS n_rows, count(DISTINCT id) AS n_ids, CAST(sum(coalesce(len(events), 0)) AS BIGINT) AS n_events, CAST(max(length(text)) AS INT) AS longest FROM duee_fin_samples GROUP BY split",
    "agg_26_usage": "SELECT family, stage_mode, CAST(sum(coalesce(length(raw_response), 0)) AS BIGINT) AS n_chars, count(*) AS n_calls FROM evaluation_results r JOIN eval_runs u ON u.run_key = r.run_key GROUP BY ALL",
    "srt_09_percentiles": "WITH r AS (SELECT source, list_sort(list(n_chars)) AS v, count(*) AS n FROM documents WHERE n_chars IS NOT NULL GROUP BY source) SELECT source, v[CAST(round_even((n-1)*0.5, 0) AS INT)+1] AS median, v[CAST(round_even((n-1)*0.9, 0) AS INT)+1] AS p90 FROM r",
    "neg_03_strategies": f"WITH e AS (SELECT event_id, {_NUM.format(chr(39) + 'neg:' + chr(39) + ' || event_id')} / 4294967296.0e0 AS u, 4e0 - 3e0 * least(1e0, sqrt(least(1e0, CAST(event_id AS DOUBLE)/10000e0)*0.99e0 + 0.01e0)) AS lim FROM events) SELECT event_id, CASE WHEN lim > 2.8e0 THEN CASE WHEN u < 0.7e0 THEN 'EASY' WHEN u < 0.9e0 THEN 'MEDIUM' ELSE 'HARD' END WHEN lim > 1.6e0 THEN CASE WHEN u < 0.2e0 THEN 'EASY' WHEN u < 0.6e0 THEN 'MEDIUM' ELSE 'HARD' END ELSE CASE WHEN u < 0.1e0 THEN 'EASY' WHEN u < 0.25e0 THEN 'MEDIUM' ELSE 'HARD' END END AS strategy FROM e",
}
ORACLES |= {
    "agg_34_strategy_histogram": f"SELECT strategy, count(*) AS n FROM ({ORACLES['neg_03_strategies']}) GROUP BY strategy",
    "jsn_11_paths": "SELECT line_id, CAST(payload AS JSON) ->> '$.parse_diagnostics.extraction_method' AS method, CAST(CAST(payload AS JSON) ->> '$.stage_meta.retry' AS DOUBLE) AS retry FROM result_lines",
    "trn_02_negative_types": f"""WITH u AS (SELECT list_sort(list(DISTINCT event_type)) AS u FROM schema_roles), g AS (SELECT row_id, coalesce({_GTYPES}, []) AS g, u, list_filter(u, lambda x: NOT list_contains(coalesce({_GTYPES}, []), x)) AS o FROM duee_fin_samples, u),
    s AS (SELECT row_id, g, u, o, list_transform(g, lambda t, i: o[{_NUM.format("row_id || ':' || t || ':' || (i-1)")} % greatest(len(o), 1) + 1]) AS sw FROM g)
    SELECT row_id, array_to_string(CASE WHEN len(g) = 0 THEN [u[{_NUM.format("row_id || ':negative-empty'")} % len(u) + 1]] WHEN len(o) > 0 THEN list_filter(sw, lambda x, i: list_position(sw, x) = i) ELSE g[1:greatest(len(g)-1, 0)] END, '|') AS types FROM s""",
    "rep_04_candidates": "WITH f AS (SELECT row_id, list_filter(list_transform(regexp_extract_all(text, '(\\d[\\d,\\.]*(?:亿|万)?股)', 1), lambda v: regexp_replace(v, '^[ ：:，,。；;]+|[ ：:，,。；;]+$', '', 'g')), lambda v: v <> '') AS v FROM duee_fin_samples WHERE text IS NOT NULL) SELECT row_id, array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i), '|') AS found FROM f WHERE len(v) > 0",
}
_PREFIXES = ("src", "snk", "flt", "jsn", "rep", "txt", "prj", "ret", "smp", "trn", "neg", "agg", "grf", "stm", "win", "sta", "join", "val", "mth", "set", "srt", "tpch")
QUERIES = {n: f for n, f in globals().items() if n.split("_")[0] in _PREFIXES and callable(f)}
