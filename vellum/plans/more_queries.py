"""Queries on reasoning, structure, windows, curricula and set algebra."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import maths as X
from vellum.functions import text as T
from vellum.operators import arguments as A
from vellum.operators import curriculum as CU
from vellum.operators import graph as G
from vellum.operators import reasoning as RE
from vellum.operators import repair as R
from vellum.operators import reports as RP
from vellum.operators import trainset as TR
from vellum.plans import prepare_queries as PQ
from vellum.plans import score_queries as SQ
from vellum.sources.tables import table


def _r(spark, d):
    return table(spark, d, "evaluation_results")


def txt_09_thought_pairs(spark, d):
    t = _r(spark, d).where("raw_response is not null").select("result_id", T.thought_text(F.col("raw_response")).alias("t"))
    return t.select("result_id", F.size(RE.thought_pairs(F.coalesce("t", F.lit("")))).cast("bigint").alias("n_pairs"))


def txt_10_consistency(spark, d):
    return RE.consistency(_r(spark, d))


def agg_15_consistency_rates(spark, d):
    c = RE.consistency(_r(spark, d), "weak_mention")
    s = c.agg(F.count_if("checked").alias("n_checked"), F.count_if(~F.col("checked")).alias("n_skipped"), F.count_if(F.col("type_consistent")).alias("n_type"), F.count_if(F.col("argument_consistent")).alias("n_argument"))
    return s.select("*", X.safe_div(F.col("n_type"), F.col("n_checked")).alias("type_rate"), X.safe_div(F.col("n_checked"), F.col("n_checked") + F.col("n_skipped")).alias("coverage"))


def txt_15_counterfactual(spark, d):
    p = R.perturbed(F.col("text"))
    rows = PQ._with_text(spark, d).where("text is not null").select("result_id", "prediction", p.alias("p")).where("p.changed")
    return rows.select("result_id", RE.counterfactual_passed(F.col("prediction"), F.col("p.old_value"), F.col("p.new_value")).alias("passed"))


def txt_16_sentences(spark, d):
    return _r(spark, d).select("result_id", RE.sentence(F.col("prediction")).alias("sentence"))


def flt_03_structure(spark, d):
    return RE.structure_errors(table(spark, d, "result_lines"))


def sta_00_windows(spark, d):
    """Windows of each result's text, sized by the answer that is checked against it."""
    rows = PQ._with_text(spark, d).select("result_id", "text", "raw_response")
    w = RE.text_windows(rows, "result_id", "text", F.col("raw_response"))
    return w.groupBy("result_id").agg(F.count("*").alias("n_windows"), F.max("start").alias("last_start"))


def neg_01_confusing_types(spark, d):
    tree, nodes = PQ._geo(spark, d)
    types = G.distances(tree, nodes, nodes, 2)
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("event_type"), F.element_at(F.array(F.lit("EASY"), F.lit("HARD"), F.lit("MEDIUM")), (F.col("n_nationkey") % 3 + 1).cast("int")).alias("strategy"), F.lit(3.0).alias("threshold"))
    return CU.confusing_types(rows, types)


def neg_04_shares(spark, d):
    s = CU.shares(X.linear_threshold(F.col("value") / 500))
    return table(spark, d, "events").select("event_id", s.alias("s")).select("event_id", F.round("s.easy", 9).alias("easy"), F.round("s.medium", 9).alias("medium"), F.round("s.hard", 9).alias("hard"))


def neg_02_swapped(spark, d):
    e = A.events(_r(spark, d)).where("side = 'gold'")
    s = CU.swapped_arguments(R.filled_args(F.col("arguments")))
    return e.select("doc_id", "event_idx", F.coalesce(F.array_join(F.transform(s, lambda a: a["argument"]), "|"), F.lit("")).alias("arguments"))


def prj_09_source_text(spark, d):
    r = _r(spark, d).join(PQ._texts(spark, d).withColumnRenamed("id", "sample_id"), "sample_id", "left")
    preview = F.when(~F.coalesce(F.col("text_preview"), F.lit("")).contains("..."), F.col("text_preview"))
    return r.select("result_id", F.sha2(F.coalesce("text", preview, F.lit("")), 256).alias("digest"))


def prj_12_answers(spark, d):
    return table(spark, d, "duee_fin_samples").select("row_id", F.to_json(F.coalesce(A.event_type_list(F.col("events")), F.array().cast("array<string>"))).alias("answer"))


def prj_17_events_of_type(spark, d):
    e = F.filter("prediction", lambda x: x.isNotNull() & (x["event_type"] == "股权质押"))
    return _r(spark, d).where("prediction is not null").select("result_id", F.size(e).cast("bigint").alias("n"))


def set_01_algebra(spark, d):
    t = A.strict_triplets(SQ._args(spark, d)).drop("doc_id").distinct()
    g, p = (t.where(F.col("side") == s).drop("side") for s in ("gold", "pred"))
    parts = {"both": g.intersect(p), "gold_only": g.subtract(p), "pred_only": p.subtract(g), "either": g.union(p).distinct()}
    out = None
    for n, x in parts.items():
        row = x.agg(F.lit(n).alias("part"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def set_02_type_universe(spark, d):
    return SQ._types(spark, d).select("event_type").union(table(spark, d, "schema_roles").select("event_type")).distinct()


def set_04_char_jaccard(spark, d):
    rows = table(spark, d, "issuers").select("issuer_code", T.chars(F.col("full_name")).alias("a"), T.chars(F.col("short_name")).alias("b"))
    return rows.select("issuer_code", T.jaccard(F.col("a"), F.col("b")).alias("similarity"))


def agg_21_run_table(spark, d):
    """As agg_20 with 0 where there are no two-stage rows, and the share of those that predict no type at all."""
    runs = table(spark, d, "eval_runs").select("run_key", "stage_mode")
    two = _r(spark, d).join(F.broadcast(runs.where("stage_mode like 'two_stage%'")), "run_key")
    none = two.groupBy("run_key").agg(F.avg((F.coalesce(F.size(A.event_type_list(F.col("prediction"))), F.lit(0)) <= 0).cast("double")).alias("stage1_empty_rate"))
    return SQ.agg_20_diagnostics(spark, d).join(none, "run_key", "left").na.fill(0.0, ["coverage_rate", "exact_rate", "miss_rate", "over_rate", "stage1_empty_rate"])


def agg_23_counter_totals(spark, d):
    steps = _r(spark, d).where("size(parse_diagnostics.repair_steps) > 0").select(F.map_from_entries(F.transform(F.array_distinct(F.filter("parse_diagnostics.repair_steps", lambda s: s.isNotNull())), lambda s: F.struct(s, F.lit(1)))).alias("m"))
    return RP.map_totals(steps, "m")


def agg_25_events_per_sample(spark, d):
    """Logged rows per sample of each run's result lines, and whether rows and samples differ, which then needs a note."""
    lines = table(spark, d, "result_lines").select("run_key", F.get_json_object("payload", "$.id").alias("id"))
    return RP.logged_ratio(lines, "run_key", "id")


def agg_31_efficiency(spark, d):
    """Scores per token of the lines that give their usage, and per minute from a run's first to its last evaluation."""
    use = lambda k: F.coalesce(F.get_json_object("payload", f"$.usage.{k}").cast("bigint"), F.lit(0))
    tokens = table(spark, d, "result_lines").groupBy("run_key").agg(F.sum(use("prompt_tokens") + use("completion_tokens")).alias("tokens"))
    span = _r(spark, d).groupBy("run_key").agg(F.timestamp_diff("SECOND", F.min("evaluated_at"), F.max("evaluated_at")).alias("seconds"))
    m = SQ._run_metrics(spark, d).where("metric = 'f1'").select("run_key", F.col("value").alias("f1"))
    rows = RP.efficiency(m.join(tokens, "run_key", "left").join(span, "run_key", "left"))
    return rows.select("run_key", F.round("f1_per_1k_tokens", 9).alias("f1_per_1k_tokens"), F.round("f1_per_minute", 9).alias("f1_per_minute"))


def agg_32_stage_histogram(spark, d):
    return PQ.trn_01_stages(spark, d).groupBy("stage").agg(F.count("*").alias("n"))


def agg_35_report_metrics(spark, d):
    m = SQ._run_metrics(spark, d).groupBy("run_key").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("metric", "value")))).alias("payload"))
    return RP.metric_values(m, "run_key", "payload", ["f1", "precision"], ["recall", "absent"]).select("run_key", "metric", F.round("value", 9).alias("value"))


def srt_06_best_run(spark, d):
    return RP.best(SQ._run_metrics(spark, d).where("metric = 'f1'"), "value", "run_key").select("run_key", "value")


def srt_07_first_samples(spark, d):
    return table(spark, d, "duee_fin_samples").orderBy("row_id").limit(100).select("row_id", "id")


def win_04_first_seen(spark, d):
    w = W.partitionBy("sample_id").orderBy("result_id")
    return _r(spark, d).withColumn("n", F.row_number().over(w)).where("n = 1").select("sample_id", "result_id")


def trn_03_types(spark, d):
    own = A.event_type_list(F.col("events"))
    given = F.array_distinct(F.filter(F.coalesce("event_types", F.array().cast("array<string>")), lambda t: F.coalesce(t, F.lit("")) != ""))
    return table(spark, d, "duee_fin_samples").select("row_id", F.array_join(F.when(F.size(own) > 0, own).otherwise(given), "|").alias("types"))


def neg_05_retry_chain(spark, d):
    """The hardest strategy whose wrong value differs from the right one, in the order hard, medium, easy."""
    a = SQ._args(spark, d).where("side = 'gold'").where(A.filled("argument"))
    hard = TR.nudged_number(F.col("argument"), F.concat_ws(":", "doc_id", "event_idx", "arg_idx"))
    got = a.select(F.when(hard != F.col("argument"), "HARD").when(F.char_length("argument") > 1, "MEDIUM").otherwise("EASY").alias("strategy"))
    return got.groupBy("strategy").agg(F.count("*").alias("n"))


BASE, _ST = SQ.BASE, SQ._strip
_REAL = "list_filter(prediction, lambda e: e IS NOT NULL)"
ORACLES = {
    "sta_00_windows": f"WITH {PQ._TX}, r AS (SELECT result_id, length(t.text) AS n, greatest(100, 492 - coalesce(length(raw_response), 0)) AS z FROM evaluation_results r JOIN texts t ON t.id = r.sample_id), w AS (SELECT *, greatest(z // 2, 100) AS st FROM r), k AS (SELECT *, CASE WHEN n <= z THEN 0 ELSE CAST(ceil((n - z) / CAST(st AS DOUBLE)) AS BIGINT) END AS k FROM w), s AS (SELECT result_id, n, z, unnest(range(0, k + 1)) * st AS x FROM k) SELECT result_id, count(*) AS n_windows, CAST(max(x) AS INT) AS last_start FROM s WHERE x = 0 OR least(z, n - x) >= 50 GROUP BY result_id",
    "neg_04_shares": "WITH t AS (SELECT event_id, 4e0 - 3e0 * value / 500 AS t FROM events), "
    + "m AS (SELECT * FROM (VALUES "
    + ", ".join(f"({i}, {', '.join(repr(float(x)) + 'e0' for x in CU.mix(b, (0.3, 0.5, 0.2), (0.1, 0.05)))})" for i, b in enumerate(CU.BASE))
    + ") v(i, e, md, h)) SELECT event_id, round(e, 9) AS easy, round(md, 9) AS medium, round(h, 9) AS hard FROM t JOIN m ON m.i = CASE WHEN t > 1e0 + 3e0*0.6e0 THEN 0 WHEN t > 1e0 + 3e0*0.3e0 THEN 1 ELSE 2 END",
    "neg_02_swapped": BASE
    + f""", f AS (SELECT doc_id, event_idx, {_ST('argument')} AS v, row_number() OVER (PARTITION BY doc_id, event_idx ORDER BY arg_idx) AS i, count(*) OVER (PARTITION BY doc_id, event_idx) AS n FROM args WHERE side='gold' AND {_ST('role')} <> '' AND {_ST('argument')} <> ''),
    s AS (SELECT doc_id, event_idx, string_agg(CASE WHEN n = 1 THEN v || '（相关）' ELSE v END, '|' ORDER BY CASE WHEN n > 1 AND i = 1 THEN 2 WHEN n > 1 AND i = 2 THEN 1 ELSE i END) AS a FROM f GROUP BY ALL) SELECT e.doc_id, e.event_idx, coalesce(a, '') AS arguments FROM ev e LEFT JOIN s ON s.doc_id=e.doc_id AND s.event_idx=e.event_idx WHERE e.side='gold'""",
    "prj_09_source_text": f"WITH {PQ._TX} SELECT result_id, sha256(coalesce(t.text, CASE WHEN NOT contains(coalesce(text_preview,''), '...') THEN text_preview END, '')) AS digest FROM evaluation_results r LEFT JOIN texts t ON t.id = r.sample_id",
    "prj_17_events_of_type": f"SELECT result_id, CAST(len(list_filter({_REAL}, lambda e: coalesce(e.event_type = '股权质押', false))) AS BIGINT) AS n FROM evaluation_results WHERE prediction IS NOT NULL",
    "set_01_algebra": BASE + ", g AS (SELECT DISTINCT event_type, role, argument FROM strict WHERE side='gold'), p AS (SELECT DISTINCT event_type, role, argument FROM strict WHERE side='pred') SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM g INTERSECT SELECT * FROM p) UNION ALL SELECT 'gold_only', count(*) FROM (SELECT * FROM g EXCEPT SELECT * FROM p) UNION ALL SELECT 'pred_only', count(*) FROM (SELECT * FROM p EXCEPT SELECT * FROM g) UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM g UNION SELECT * FROM p)",
    "set_02_type_universe": BASE + "SELECT event_type FROM etypes UNION SELECT event_type FROM schema_roles",
    "set_04_char_jaccard": "WITH c AS (SELECT issuer_code, list_distinct(list_filter(string_split(full_name,''), lambda x: x <> '')) AS a, list_distinct(list_filter(string_split(short_name,''), lambda x: x <> '')) AS b FROM issuers) SELECT issuer_code, CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a,b)) / CAST(len(list_distinct(list_concat(a,b))) AS DOUBLE) ELSE 0e0 END AS similarity FROM c",
    "agg_21_run_table": f"WITH d AS ({SQ.ORACLES['agg_20_diagnostics']}), e AS (SELECT r.run_key, avg(CAST(len(coalesce({SQ._types_list('prediction')}, [])) = 0 AS DOUBLE)) AS x FROM evaluation_results r JOIN eval_runs u ON u.run_key = r.run_key WHERE u.stage_mode LIKE 'two_stage%' GROUP BY r.run_key) SELECT d.* REPLACE (coalesce(coverage_rate,0) AS coverage_rate, coalesce(exact_rate,0) AS exact_rate, coalesce(miss_rate,0) AS miss_rate, coalesce(over_rate,0) AS over_rate), coalesce(x, 0) AS stage1_empty_rate FROM d LEFT JOIN e ON e.run_key = d.run_key",
    "agg_23_counter_totals": "WITH s AS (SELECT result_id, unnest(parse_diagnostics.repair_steps) AS s FROM evaluation_results) SELECT s AS name, count(DISTINCT result_id) AS total FROM s WHERE s IS NOT NULL GROUP BY s",
    "agg_25_events_per_sample": "WITH l AS (SELECT run_key, CAST(payload AS JSON) ->> '$.id' AS id FROM result_lines) SELECT run_key, count(*) AS n_rows, count(DISTINCT id) AS n_samples, CASE WHEN count(DISTINCT id) > 0 THEN CAST(count(*) AS DOUBLE) / count(DISTINCT id) ELSE 0.0e0 END AS ratio, count(*) <> count(DISTINCT id) AS differ FROM l GROUP BY run_key",
    "agg_31_efficiency": BASE + ", t AS (SELECT run_key, sum(coalesce(CAST(CAST(payload AS JSON) ->> '$.usage.prompt_tokens' AS BIGINT), 0) + coalesce(CAST(CAST(payload AS JSON) ->> '$.usage.completion_tokens' AS BIGINT), 0)) AS t FROM result_lines GROUP BY run_key), s AS (SELECT run_key, (epoch_us(max(evaluated_at)) - epoch_us(min(evaluated_at))) // 1000000 AS s FROM evaluation_results GROUP BY run_key) SELECT m.run_key, round(CASE WHEN t > 0 THEN f1*1000/t END, 9) AS f1_per_1k_tokens, round(CASE WHEN s > 0 THEN f1*60/s END, 9) AS f1_per_minute FROM runm1 m LEFT JOIN t ON t.run_key = m.run_key LEFT JOIN s ON s.run_key = m.run_key",
    "agg_32_stage_histogram": f"SELECT stage, count(*) AS n FROM ({PQ.ORACLES['trn_01_stages']}) GROUP BY stage",
    "agg_35_report_metrics": BASE + "SELECT run_key, metric, round(value, 9) AS value FROM runm",
    "srt_06_best_run": BASE + "SELECT run_key, value FROM runm WHERE metric = 'f1' ORDER BY value DESC, run_key LIMIT 1",
    "srt_07_first_samples": "SELECT row_id, id FROM duee_fin_samples ORDER BY row_id LIMIT 100",
    "win_04_first_seen": "SELECT sample_id, min(result_id) AS result_id FROM evaluation_results GROUP BY sample_id",
    "trn_03_types": f"WITH t AS (SELECT row_id, {SQ._types_list('events')} AS o, coalesce(list_filter(event_types, lambda t, i: coalesce(t,'') <> '' AND list_position(event_types, t) = i), []) AS g FROM duee_fin_samples) SELECT row_id, array_to_string(CASE WHEN len(o) > 0 THEN o ELSE g END, '|') AS types FROM t",
}
ORACLES |= {
    "prj_12_answers": f"SELECT row_id, CAST(to_json(coalesce({SQ._types_list('events')}, [])) AS VARCHAR) AS answer FROM duee_fin_samples",
    "neg_01_confusing_types": f"""WITH o AS (SELECT a.n_nationkey AS key, a.n_name AS event_type, a.n_nationkey % 3 AS s, b.n_name AS b, CASE WHEN a.n_regionkey = b.n_regionkey THEN 2 ELSE 4 END AS d FROM nation a JOIN nation b ON a.n_nationkey <> b.n_nationkey),
    p AS (SELECT key, event_type, list_sort(list(b)) AS bs FROM o WHERE s = 2 OR (s = 0 AND d = 4) OR (s = 1 AND d = 2) GROUP BY ALL) SELECT key, event_type, bs[{PQ._NUM.format("key || ':' || event_type")} % len(bs) + 1] AS wrong FROM p""",
    "txt_16_sentences": f"""WITH e AS (SELECT result_id, {_REAL} AS es FROM evaluation_results), x AS (SELECT result_id, unnest(es) AS e, generate_subscripts(es, 1) AS i FROM e),
    s AS (SELECT result_id, i, '发生了' || coalesce(e.event_type, '未知事件') || '事件' || coalesce('，其中' || nullif(array_to_string(list_transform(list_filter(e.arguments, lambda a: a IS NOT NULL AND coalesce(a.role,'') <> '' AND coalesce(a.argument,'') <> ''), lambda a: a.role || '为' || a.argument), '，'), ''), '') AS t FROM x),
    j AS (SELECT result_id, string_agg(t, '。' ORDER BY i) || '。' AS t FROM s GROUP BY result_id) SELECT r.result_id, coalesce(t, '') AS sentence FROM evaluation_results r LEFT JOIN j ON j.result_id = r.result_id""",
}
QUERIES = {n: f for n, f in globals().items() if n.split("_")[0] in PQ._PREFIXES and callable(f)}
