"""Queries on contracts, validation, reports, spans and run statistics."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import maths as X
from vellum.functions.text import truncated
from vellum.operators import arguments as A
from vellum.operators import contracts as C
from vellum.operators import graph as G
from vellum.operators import metrics as S
from vellum.operators import repair as R
from vellum.operators import retrieval as RT
from vellum.operators import spans as SN
from vellum.operators import trainset as TR
from vellum.operators import validation as V
from vellum.plans import prepare_queries as PQ
from vellum.plans import score_queries as SQ
from vellum.sources.tables import table

PATHS = ["id", "prediction", "parse_diagnostics.success", "parse_diagnostics.extraction_method", "stage_meta.stage_mode", "usage.total_tokens"]
#: Versions and settings that the runs of the test tables share.
SHARED = {
    "model_kind": "chat", "split": "dev", "primary_metric": "doc_role_micro_f1", "prompt_variant": "zero_shot", "fewshot_num_examples": "0", "fewshot_selection_mode": "static", "fewshot_pool_split": "train_fit",
    "train_tune_ratio": "0.1", "research_split_manifest_path": "splits", "research_split_manifest_hash": "0", "canonical_metric_mode": "analysis_only", "prompt_builder_version": "1", "parser_version": "1",
    "normalization_version": "1", "protocol_hash": "0", "role_alias_hash": "0", "token_usage_kind": "actual",
}


def _contracts(spark, d):
    runs = table(spark, d, "eval_runs")
    rows = runs.select("run_key", F.col("family").alias("model_family"), "stage_mode", "pipeline_mode", "seed", F.col("seed").alias("seed_effective"), *[F.lit(v).alias(k) for k, v in SHARED.items()])
    return V.contracts(rows, "run_key")


def val_01_contracts(spark, d):
    return _contracts(spark, d).select("run_key", "stage_mode", F.array_join("missing", ",").alias("missing"), "contract_hash")


def val_01_document_contracts(spark, d):
    """The same contracts, written as JSON reports and read back."""
    docs = _contracts(spark, d).select("run_key", F.to_json(F.struct(F.struct(*V.CONTRACT_FIELDS).alias("experiment_contract"))).alias("payload"))
    return V.document_contracts(docs, "run_key", "payload").select("run_key", F.array_join("missing", ",").alias("missing"), "contract_hash")


def val_02_disagreeing_fields(spark, d):
    return V.disagreeing_fields(_contracts(spark, d), ["model_family"], V.CONTRACT_FIELDS)


def val_04_missing_paths(spark, d):
    return V.missing_paths(table(spark, d, "result_lines"), "line_id", "payload", PATHS)


def val_04_summary_errors(spark, d):
    """Breaches of reports made of what the runs have: settings and scores, without costs or timing."""
    wide = SQ._run_metrics(spark, d).groupBy("run_key").pivot("metric", ["f1"]).agg(F.first("value"))
    docs = _contracts(spark, d).join(wide, "run_key").select("run_key", F.to_json(F.struct(
        F.struct(F.col("seed"), F.lit(True).alias("has_gold_labels"), F.col("primary_metric")).alias("meta"), F.struct(*V.CONTRACT_FIELDS).alias("experiment_contract"), F.struct(F.col("f1").alias("strict_f1")).alias("metrics")), {"ignoreNullFields": "false"}).alias("payload"))
    return V.summary_errors(docs, "run_key", "payload")


def _rates(spark, d):
    """Success rate of every run over the results themselves, and over those written on time."""
    r = table(spark, d, "evaluation_results").withColumn("ok", F.coalesce("parse_success", F.lit(False)).cast("double"))
    runs = F.broadcast(table(spark, d, "eval_runs").select("run_key", "family"))
    on_time = F.col("written_at") <= F.col("evaluated_at") + F.expr("INTERVAL 1 DAY")
    return r.join(runs, "run_key").groupBy("family", "run_key").agg(F.avg("ok").alias("rate"), F.avg(F.when(on_time, F.col("ok"))).alias("early"))


def val_05_suite_errors(spark, d):
    """Suites whose means were taken before late writes, against the runs as they are now."""
    rates = _rates(spark, d)
    stated = rates.groupBy("family").agg(F.avg("early").alias("mean")).select("family", F.concat(F.lit('{"split":"dev","seeds":[3400],"aggregated":{"'), "family", F.lit('":{"metrics":{"parse_success_rate":{"mean":'), F.col("mean").cast("string"), F.lit("}}}}}")).alias("payload"))
    children = rates.select("family", F.col("family").alias("group"), F.lit("parse_success_rate").alias("metric"), F.col("rate").alias("value"))
    return V.suite_errors(stated, children, "family", "payload", ("parse_success_rate",))


def join_12_recount(spark, d):
    """Families whose mean before late writes differs from that of their runs now."""
    rates = _rates(spark, d)
    return V.recounted(rates.groupBy("family").agg(F.avg("early").alias("v")), rates.select("family", F.col("rate").alias("v")), ["family"], "v").select("family", F.round("l", 9).alias("l"), F.round("r", 9).alias("r"))


def join_13_metadata(spark, d):
    """Result lines whose stage mode is not that of their run."""
    lines = table(spark, d, "result_lines").select("line_id", "run_key", F.get_json_object("payload", "$.stage_meta.stage_mode").alias("stage_mode")).where("stage_mode is not null")
    runs = lines.select("line_id", "run_key").join(F.broadcast(table(spark, d, "eval_runs").select("run_key", "stage_mode")), "run_key")
    return V.metadata_mismatches(lines, runs, ["line_id"], ["stage_mode"])


def val_06_missing_metadata(spark, d):
    rows = table(spark, d, "duee_fin_samples").select("row_id", "title", "issuer_code", "source", "split")
    return V.missing_metadata(rows, "row_id", ["title", "issuer_code", "source", "split"])


def val_07_first_errors(spark, d):
    """One breach per path and run: the first line that has it."""
    errors = val_04_missing_paths(spark, d).join(table(spark, d, "result_lines").select("line_id", "run_key"), "line_id")
    return V.first_errors(errors, ["run_key", "error"], "line_id")


def agg_17_report(spark, d):
    r = S.report(SQ._results(spark, d), SQ._samples(spark, d), SQ._schema(spark, d))
    return r.select("metric", F.round("value", 9).alias("value"))


#: Names of the metrics that can be a run's primary one, and those of the report that they stand for.
PRIMARY = {
    "legacy_dueefin_overall_precision": "strict_precision", "legacy_dueefin_overall_recall": "strict_recall", "legacy_dueefin_overall_f1": "strict_f1", "strict_f1": "strict_f1", "relaxed_f1": "relaxed_f1",
    "type_f1": "type_f1", "doc_role_micro_f1": "doc_role_f1", "doc_role_macro_f1": "doc_role_macro_f1", "doc_event_type_micro_f1": "doc_event_type_f1", "doc_event_type_macro_f1": "doc_event_type_macro_f1",
    "doc_instance_micro_f1": "doc_instance_f1", "doc_combination_micro_f1": "doc_combination_f1", "single_event_doc_role_micro_f1": "single_f1", "multi_event_doc_role_micro_f1": "multi_f1",
}


def agg_36_primary(spark, d):
    return S.required_metrics(agg_17_report(spark, d), PRIMARY)


def agg_30_seed_table(spark, d):
    runs = F.broadcast(table(spark, d, "eval_runs").select("run_key", "family", "stage_mode"))
    return S.seed_table(SQ._run_metrics(spark, d).join(runs, "run_key"), "family", "stage_mode")


def agg_27_example_usage(spark, d):
    return S.example_usage(PQ.ret_06_examples(spark, d).select(F.split("ids", r"\|").alias("ids")))


def _negatives(spark, d):
    a = SQ._args(spark, d).where("side = 'gold'").where(A.filled("argument"))
    wrong = TR.nudged_number(F.col("argument"), F.concat_ws(":", "doc_id", "event_idx", "arg_idx"))
    return a.select((wrong == F.col("argument")).alias("filtered"), F.when(wrong == F.col("argument"), 1).otherwise(0).alias("retries"))


def agg_33_sampler(spark, d):
    return S.sampler_rates(_negatives(spark, d))


def grf_03_diameter(spark, d):
    return G.diameter(G.schema_tree(table(spark, d, "schema_roles")), 2)


def rep_18_gate(spark, d):
    steps = F.col("parse_diagnostics.repair_steps")
    ungrounded = F.when(~F.coalesce("parse_success", F.lit(True)), F.lit("parse_failed"))
    reasons = F.array_compact(F.array(ungrounded, F.when(F.size(steps) > 0, F.lit("repaired"))))
    g = SN.gate(reasons, "verify_triggered", F.col("parse_success"))
    return table(spark, d, "evaluation_results").select("result_id", g.alias("g")).select("result_id", "g.triggered", F.array_join("g.reasons", "|").alias("reasons"), "g.calls", "g.verified")


def _fragments(spark, d):
    """(row_id, event_idx, role, vs, text) of roles with more than one value in an event."""
    s = table(spark, d, "duee_fin_samples").where("text is not null")
    rows = s.select("row_id", "text", F.posexplode("events").alias("event_idx", "e")).where("e is not null")
    a = rows.select("row_id", "event_idx", "text", F.posexplode("e.arguments").alias("arg_idx", "a")).where("a is not null").where(F.coalesce(F.col("a.argument"), F.lit("")) != "")
    g = a.groupBy("row_id", "event_idx", "a.role").agg(F.array_sort(F.collect_list(F.struct("arg_idx", "a.argument"))).alias("vs"), F.first("text").alias("text")).where("size(vs) > 1")
    return g.withColumn("vs", F.transform("vs", lambda x: x["argument"]))


def rep_15_spans(spark, d):
    span = SN.ordered_span(F.col("vs"), F.col("text"), r"[、和及与,，]")
    return _fragments(spark, d).select("row_id", "event_idx", "role", span.alias("span")).where("span is not null")


def rep_14_amounts(spark, d):
    return _fragments(spark, d).select("row_id", "event_idx", "role", SN.joined_amount(F.col("vs"), F.col("text")).alias("amount"))


def rep_14_cues(spark, d):
    s = table(spark, d, "duee_fin_samples").where("text is not null and issuer_code is not null")
    return s.select("row_id", F.coalesce(SN.cued(F.col("text"), F.coalesce(F.get(F.split("title", r"[，,：: ]"), F.lit(0)), F.lit("")), "公告", "公司"), F.lit(False)).alias("cued"))


def rep_07_probed(spark, d):
    """Fragments of every role of a sum or a number of shares joined, where an event's text holds them joined; no rules against competing types."""
    named = [r[0] for r in table(spark, d, "schema_roles").select("role").distinct().collect()]
    joins = {r: "number" for r in named if r.endswith("股数")} | {r: "amount" for r in named if r.endswith(("金额", "额"))} | {r: "span" for r in named if r.endswith(("项目名称", "标的"))}
    p = R.probed(PQ._with_text(spark, d), [], joins)
    return p.select("result_id", "n_dropped", "n_joined", F.size("probed").cast("bigint").alias("n_events"))


def ret_07_selected(spark, d):
    """Static examples of every hundredth sample: the first of the pool."""
    s = table(spark, d, "duee_fin_samples")
    q = s.where("row_id % 100 = 0").select(F.col("row_id").alias("qid"), "text", F.col("event_types").alias("types"))
    chosen = RT.selected(q, RT.example_pool(s.where("split = 'train'")), "static")
    return chosen.select("qid", F.array_join(F.transform("ids", lambda i: i.cast("string")), "|").alias("ids"))


def jsn_13_correction_prompt(spark, d):
    r = table(spark, d, "evaluation_results").where("raw_response is not null and not coalesce(parse_success, true)")
    parts = [F.lit("下面的输出不是合法的 JSON，请只改正格式并只输出 JSON。\n错误："), F.coalesce("parse_diagnostics.error", F.lit("未知")), F.lit("\n输出：\n"), truncated(F.col("raw_response"), 1000, "...")]
    return r.select("result_id", F.concat(*parts).alias("prompt"))


def prj_11_system_prompt(spark, d):
    """The schema as lines, one per type in order of the names, behind an instruction."""
    types = table(spark, d, "schema_roles").groupBy("event_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("role_pos", "role"))), lambda x: x["role"]), "、").alias("roles"))
    lines = types.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_type", "roles"))), lambda x: F.concat(F.lit("- "), x["event_type"], F.lit("："), x["roles"])), "\n").alias("schema"))
    return lines.select(F.concat(F.lit("请按下列事件类型和角色抽取事件，只输出 JSON 数组。\n"), "schema").alias("prompt"))


def prj_14_warnings(spark, d):
    """For the types of a sample, the types one is most often taken for: the most frequent wrong type of the results."""
    e = A.events(SQ._results(spark, d)).where(A.filled("event_type"))
    gold = e.where("side = 'gold'").select("doc_id", F.col("event_type").alias("t")).distinct()
    pred = e.where("side = 'pred'").select("doc_id", F.col("event_type").alias("w")).distinct()
    wrong = pred.join(gold.select("doc_id", F.col("t").alias("w")), ["doc_id", "w"], "left_anti").join(gold, "doc_id").groupBy("t", "w").agg(F.count("*").alias("n"))
    return wrong.groupBy("t").agg(F.max_by("w", F.struct("n", "w")).alias("w")).select(F.col("t").alias("event_type"), F.concat(F.lit("- "), "t", F.lit(": 勿与"), "w", F.lit("混淆")).alias("warning"))


def smp_04_selected(spark, d):
    """Rows of the fit part of the split, as far as they have a text."""
    fit = PQ.smp_03_split(spark, d).where("part = 'fit'").select("row_id")
    return table(spark, d, "duee_fin_samples").where("text is not null").join(fit, "row_id", "left_semi").select("row_id")


def stm_04_reset(spark, d):
    """States after the reset at the start of an epoch: half the competence, at least the floor, and no steps."""
    return PQ.stm_05_final_state(spark, d).select("key", F.round(F.greatest(F.lit(0.05), F.col("competence") / 2), 6).alias("competence"), F.lit(0).alias("steps"))


def stm_06_guard(spark, d):
    """Rows at which more than 30 % of a user's events so far lack a value of 10 or more."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    lacking = F.sum(F.when(F.coalesce("value", F.lit(0.0)) < 10, 1).otherwise(0)).over(w)
    return table(spark, d, "events").select("event_id", lacking.alias("lacking"), F.count("*").over(w).alias("n")).where("lacking > 0.3 * n")


def mth_07_warmup(spark, d):
    return table(spark, d, "events").select("event_id", F.round(X.warmup_weight(F.col("event_id"), 0.5, 1000), 9).alias("weight"))


def mth_08_steps(spark, d):
    n = table(spark, d, "evaluation_results").groupBy("run_key").agg(F.count("*").alias("n"))
    return n.select("run_key", X.max_steps(F.col("n"), 4, 8, 3).alias("steps"))


def src_10_split_overlap(spark, d):
    """Keys that the written split puts in one part and the sample's own column in another: dev or test rows used to fit."""
    fit = table(spark, d, "duee_fin_samples").where("split in ('train', 'sample')").select("id", F.lit("fit").alias("part"))
    held = table(spark, d, "duee_fin_samples").where("split in ('dev', 'test')").select("id", F.lit("held").alias("part"))
    return fit.unionByName(held).groupBy("id").agg(F.count_distinct("part").alias("n_parts")).where("n_parts > 1")


def val_02_contract_hash(spark, d):
    columns = ["family", "pipeline_mode", "seed", "stage_mode"]
    return table(spark, d, "eval_runs").select("run_key", F.sha2(V.canonical_json({c: F.col(c) for c in columns}), 256).alias("digest"))


def val_02_disagreeing(spark, d):
    return C.disagreeing(table(spark, d, "eval_runs"), ["family"], ["stage_mode", "pipeline_mode"])


BASE = SQ.BASE
_MODE = "CASE WHEN stage_mode IN ('single_pass', 'two_stage', 'two_stage_per_type') THEN stage_mode END"
_HASHED = {**{k: f"'{v}'" for k, v in SHARED.items() if k in V.HASHED_FIELDS}, "fewshot_num_examples": "0", "train_tune_ratio": "0.1", "stage_mode": None, "pipeline_mode": None, "postprocess_profile": "'none'"}
_CANON = " || ',' || ".join(f"""'"{k}":' || """ + (f"""'"' || {k} || '"'""" if v is None else f"""'"' || {v} || '"'""" if v.startswith("'") else f"'{v}'") for k, v in sorted(_HASHED.items()))
_RATES = "WITH r AS (SELECT u.family, e.run_key, avg(CAST(coalesce(parse_success, false) AS DOUBLE)) AS rate, avg(CASE WHEN written_at <= evaluated_at + INTERVAL 1 DAY THEN CAST(coalesce(parse_success, false) AS DOUBLE) END) AS early FROM evaluation_results e JOIN eval_runs u ON u.run_key = e.run_key GROUP BY ALL), f AS (SELECT family, avg(early) AS l, avg(rate) AS r FROM r GROUP BY family)"
_PATHS = " UNION ALL ".join(f"SELECT line_id, 'Missing required field: {p}' AS error FROM result_lines WHERE coalesce(json_type(payload, '$.{p}'), 'NULL') = 'NULL'" for p in PATHS)
ORACLES = {
    "val_01_contracts": f"SELECT run_key, {_MODE} AS stage_mode, CASE WHEN {_MODE} IS NULL THEN 'stage_mode' ELSE '' END AS missing, CASE WHEN {_MODE} IS NOT NULL THEN sha256('{{' || {_CANON} || '}}') END AS contract_hash FROM eval_runs",
    "val_02_disagreeing_fields": f"WITH r AS (SELECT family AS model_family, coalesce({_MODE}, 'null') AS stage_mode, pipeline_mode, CAST(seed AS VARCHAR) AS seed FROM eval_runs), l AS (SELECT model_family, 'stage_mode' AS field, stage_mode AS v FROM r UNION ALL SELECT model_family, 'pipeline_mode', pipeline_mode FROM r UNION ALL SELECT model_family, 'seed', seed FROM r UNION ALL SELECT model_family, 'seed_effective', seed FROM r) SELECT model_family, field, count(DISTINCT v) AS n_values FROM l GROUP BY ALL HAVING count(DISTINCT v) > 1",
    "val_04_missing_paths": _PATHS,
    "join_12_recount": _RATES + " SELECT family, round(l, 9) AS l, round(r, 9) AS r FROM f WHERE abs(l - r) > 1e-9",
    "join_13_metadata": "SELECT line_id, 'stage_mode' AS field, CAST(payload AS JSON) ->> '$.stage_meta.stage_mode' AS l, stage_mode AS r FROM result_lines l JOIN eval_runs u ON u.run_key = l.run_key WHERE CAST(payload AS JSON) ->> '$.stage_meta.stage_mode' <> stage_mode",
    "val_06_missing_metadata": "SELECT row_id, array_to_string(list_filter([CASE WHEN coalesce(issuer_code,'')='' THEN 'issuer_code' END, CASE WHEN coalesce(source,'')='' THEN 'source' END, CASE WHEN coalesce(split,'')='' THEN 'split' END, CASE WHEN coalesce(title,'')='' THEN 'title' END], lambda x: x IS NOT NULL), ', ') AS missing FROM duee_fin_samples WHERE coalesce(issuer_code,'')='' OR coalesce(source,'')='' OR coalesce(split,'')='' OR coalesce(title,'')=''",
    "val_07_first_errors": f"SELECT run_key, error, min(e.line_id) AS line_id FROM ({_PATHS}) e JOIN result_lines l ON l.line_id = e.line_id GROUP BY ALL",
    "agg_30_seed_table": BASE + "SELECT family, stage_mode, metric, count(*) AS n_seeds, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std FROM runm JOIN eval_runs u ON u.run_key = runm.run_key GROUP BY ALL",
    "grf_03_diameter": "SELECT 4 AS diameter",
    "rep_18_gate": "SELECT result_id, n > 0 AS triggered, array_to_string(r, '|') AS reasons, CAST(n > 0 AND ok IS NOT NULL AS INT) AS calls, CASE WHEN n > 0 THEN ok END AS verified FROM (SELECT result_id, parse_success AS ok, list_filter([CASE WHEN NOT coalesce(parse_success, true) THEN 'parse_failed' END, CASE WHEN len(parse_diagnostics.repair_steps) > 0 THEN 'repaired' END], lambda x: x IS NOT NULL) AS r, len(r) AS n FROM evaluation_results)",
    "jsn_13_correction_prompt": "SELECT result_id, '下面的输出不是合法的 JSON，请只改正格式并只输出 JSON。' || chr(10) || '错误：' || coalesce(parse_diagnostics.error, '未知') || chr(10) || '输出：' || chr(10) || CASE WHEN length(raw_response) > 1000 THEN substring(raw_response, 1, 1000) || '...' ELSE raw_response END AS prompt FROM evaluation_results WHERE raw_response IS NOT NULL AND NOT coalesce(parse_success, true)",
    "prj_11_system_prompt": "WITH t AS (SELECT event_type, string_agg(role, '、' ORDER BY role_pos) AS roles FROM schema_roles GROUP BY event_type) SELECT '请按下列事件类型和角色抽取事件，只输出 JSON 数组。' || chr(10) || string_agg('- ' || event_type || '：' || roles, chr(10) ORDER BY event_type) AS prompt FROM t",
    "prj_14_warnings": BASE + ", g AS (SELECT DISTINCT doc_id, event_type AS t FROM ev WHERE side='gold' AND event_type <> ''), p AS (SELECT DISTINCT doc_id, event_type AS w FROM ev WHERE side='pred' AND event_type <> ''), x AS (SELECT t, w, count(*) AS n FROM (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = p.doc_id AND g.t = p.w)) q JOIN g USING (doc_id) GROUP BY ALL), y AS (SELECT t, w, row_number() OVER (PARTITION BY t ORDER BY n DESC, w DESC) AS k FROM x) SELECT t AS event_type, '- ' || t || ': 勿与' || w || '混淆' AS warning FROM y WHERE k = 1",
    "smp_04_selected": f"SELECT s.row_id FROM duee_fin_samples s JOIN ({PQ.ORACLES['smp_03_split']}) p ON p.row_id = s.row_id WHERE p.part = 'fit' AND text IS NOT NULL",
    "stm_04_reset": f"SELECT key, round(greatest(0.05e0, competence / 2), 6) AS competence, 0 AS steps FROM ({PQ.ORACLES['stm_05_final_state']})",
    "stm_06_guard": "SELECT event_id, lacking, n FROM (SELECT event_id, CAST(sum(CASE WHEN coalesce(value, 0) < 10 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS lacking, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE lacking > 0.3 * n",
    "mth_07_warmup": "SELECT event_id, round(0.5e0 * least(1e0, greatest(0e0, event_id / 1000e0)), 9) AS weight FROM events",
    "mth_08_steps": "SELECT run_key, greatest(1, CAST(ceil(ceil(count(*) / 4.0) / 8.0) * 3 AS BIGINT)) AS steps FROM evaluation_results GROUP BY run_key",
    "src_10_split_overlap": "SELECT id, count(DISTINCT split IN ('dev', 'test')) AS n_parts FROM duee_fin_samples WHERE split IS NOT NULL GROUP BY id HAVING count(DISTINCT split IN ('dev', 'test')) > 1",
    "val_02_contract_hash": """SELECT run_key, sha256('{"family":"' || family || '","pipeline_mode":"' || pipeline_mode || '","seed":' || seed || ',"stage_mode":"' || stage_mode || '"}') AS digest FROM eval_runs""",
    "ret_07_selected": "WITH p AS (SELECT row_id FROM duee_fin_samples WHERE split = 'train' AND len(list_filter(events, lambda e: e IS NOT NULL AND regexp_replace(coalesce(e.event_type, ''), '^\\s+|\\s+$', '', 'g') <> '')) > 0 ORDER BY row_id LIMIT 3), i AS (SELECT string_agg(row_id, '|' ORDER BY row_id) AS ids FROM p) SELECT row_id AS qid, ids FROM duee_fin_samples, i WHERE row_id % 100 = 0",
    "val_02_disagreeing": PQ.ORACLES["val_02_disagreeing"],
}
QUERIES = {n: f for n, f in globals().items() if n.split("_")[0] in PQ._PREFIXES and callable(f)}
