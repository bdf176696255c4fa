"""Queries on matching and scoring predictions against gold events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.maths import prf, safe_div
from vellum.functions.text import SPACE, normalize, relaxed_match, span_overlap, strip
from vellum.operators import arguments as A
from vellum.operators import matching as M
from vellum.operators import metrics as S
from vellum.sources.tables import table


def _results(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "evaluation_results")


def _schema(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "schema_roles")


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "duee_fin_samples")


def _args(spark: SparkSession, d: str) -> DataFrame:
    return A.arguments(_results(spark, d))


def _types(spark: SparkSession, d: str) -> DataFrame:
    return A.events(_results(spark, d)).where(A.filled("event_type")).select("doc_id", "side", "event_type").distinct()


def _strict(spark: SparkSession, d: str) -> DataFrame:
    return M.row_match(_results(spark, d), A.strict_keys)


def prj_01_strict_triplets(spark, d):
    return A.strict_triplets(_args(spark, d))


def prj_02_relaxed_pairs(spark, d):
    return A.relaxed_pairs(_args(spark, d))


def prj_03_event_types(spark, d):
    r = _results(spark, d)
    return r.select("result_id", F.array_join(A.event_type_list(F.col("ground_truth")), "|").alias("gold_types"), F.array_join(A.event_type_list(F.col("prediction")), "|").alias("pred_types"))


def prj_04_text_keys(spark, d):
    return A.text_keys(_results(spark, d)).groupBy("side", "metric").agg(F.count("*").alias("n_keys"), F.count_distinct("doc_id").alias("n_docs"))


def prj_05_records(spark, d):
    r = A.records(_args(spark, d))
    return r.select("doc_id", "side", "event_type", "event_idx", F.size("slots").cast("bigint").alias("n_slots"), F.array_join(F.map_keys("slots"), "|").alias("roles"))


def prj_06_signatures(spark, d):
    r = A.all_records(_results(spark, d))
    return r.select("doc_id", "side", "event_idx", F.sha2(A.signature(F.col("slots"), F.col("event_type")), 256).alias("sig"))


def prj_07_filled_arguments(spark, d):
    a = _args(spark, d).select("doc_id", "side", "event_idx", "arg_idx", strip(F.col("role")).alias("role"), strip(F.col("argument")).alias("argument"))
    return a.where("role <> '' and argument <> ''")


def prj_08_first_filled_side(spark, d):
    r = _results(spark, d)
    pick = F.coalesce(F.when(F.size("prediction") > 0, F.col("prediction")), F.col("ground_truth"))
    return r.select("result_id", F.greatest(F.coalesce(F.size(pick), F.lit(0)), F.lit(0)).cast("bigint").alias("n_events"))


def prj_10_alias_canonicalize(spark, d):
    out = A.canonical_roles(_results(spark, d), table(spark, d, "role_alias"))
    roles = F.flatten(F.transform(F.filter("prediction", lambda e: e.isNotNull() & e["arguments"].isNotNull()), lambda e: F.transform(F.filter(e["arguments"], lambda a: a.isNotNull()), lambda a: F.coalesce(a["role"], F.lit("")))))
    return out.select("result_id", F.col("n_rewrites").cast("bigint").alias("n_rewrites"), F.coalesce(F.array_join(roles, "|"), F.lit("")).alias("roles"))


def prj_20_previews(spark, d):
    return _results(spark, d).select("result_id", F.substring("raw_response", 1, 1000).alias("answer"), F.when(F.char_length("text_preview") > 100, F.concat(F.substring("text_preview", 1, 100), F.lit("..."))).otherwise(F.col("text_preview")).alias("preview"))


def join_01_strict_match(spark, d):
    return _strict(spark, d)


def agg_02_role_prf(spark, d):
    return S.scored(M.counted(_strict(spark, d), "event_type", "role"))


def agg_05_strict_prf(spark, d):
    return S.scored(M.counted(_strict(spark, d)))


def agg_07_type_prf(spark, d):
    return S.scored(M.counted(M.row_match(_results(spark, d), A.type_keys)))


def agg_12_text_prf(spark, d):
    keys = M.row_match(_results(spark, d), A.text_key_list)
    return S.scored(M.counted(keys.withColumn("metric", F.substring_index("key", "\x1d", 1)), "metric"))


def agg_12_text_grounding(spark, d):
    return S.text_grounding(_results(spark, d), _samples(spark, d))


def join_02_first_fit(spark, d):
    return M.first_fit(A.relaxed_pairs(_args(spark, d)))


def agg_06_relaxed_prf(spark, d):
    return S.relaxed_scores(A.relaxed_pairs(_args(spark, d)))


def join_03_assignment(spark, d):
    return M.assigned(_results(spark, d))


def agg_08_role_scores(spark, d):
    return S.role_scores(_results(spark, d), _schema(spark, d))


def agg_08_rollup(spark, d):
    return S.role_rollup(S.role_scores(_results(spark, d), _schema(spark, d)))


def agg_09_type_presence(spark, d):
    return S.type_presence(_results(spark, d), _schema(spark, d))


def agg_10_instances(spark, d):
    parts = [M.multiset_overlap(_results(spark, d), w).agg(F.lit(n).alias("kind"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")]) for n, w in (("instance", True), ("combination", False))]
    return S.scored(parts[0].unionByName(parts[1]))


def agg_11_multiplicity(spark, d):
    return S.multiplicity(_results(spark, d))


def agg_04_parse_rates(spark, d):
    return S.parse_rates(_results(spark, d), "run_key")


def agg_13_hallucination(spark, d):
    return S.hallucination_rates(S.hallucinations(_results(spark, d), _samples(spark, d)))


def flt_01_ungrounded(spark, d):
    return S.hallucinations(_results(spark, d), _samples(spark, d)).where("not grounded").drop("grounded")


def flt_02_violations(spark, d):
    return S.schema_violations(_results(spark, d), _schema(spark, d))


def agg_14_violation_top10(spark, d):
    v = S.schema_violations(_results(spark, d), _schema(spark, d))
    return v.groupBy("code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code").limit(10)


def agg_16_error_top10(spark, d):
    return S.error_histogram(_strict(spark, d))


def agg_18_sample_counts(spark, d):
    return S.sample_counts(_results(spark, d))


def agg_19_scores_from_counts(spark, d):
    return S.scores_from_counts(agg_18_sample_counts(spark, d))


def agg_20_diagnostics(spark, d):
    runs = table(spark, d, "eval_runs").select("run_key", "stage_mode")
    return S.result_diagnostics(_results(spark, d).join(F.broadcast(runs), "run_key"), "run_key")


def _run_metrics(spark, d):
    """(run_key, metric, value): strict scores per run."""
    s = S.scored(M.counted(M.row_match(_results(spark, d), A.strict_keys, carried=("run_key",)), "run_key"))
    return s.unpivot("run_key", ["precision", "recall", "f1"], "metric", "value")


def agg_28_runs(spark, d):
    runs = table(spark, d, "eval_runs").select("run_key", "family", "seed")
    return S.aggregate_runs(_run_metrics(spark, d).join(F.broadcast(runs), "run_key"), "family")


def agg_29_runs_population(spark, d):
    runs = table(spark, d, "eval_runs").select("run_key", "stage_mode")
    m = _run_metrics(spark, d).join(F.broadcast(runs), "run_key")
    return m.groupBy("stage_mode", "metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"))


def agg_37_derived_rows(spark, d):
    m = _run_metrics(spark, d).groupBy("run_key").pivot("metric", ["precision", "recall", "f1"]).agg(F.first("value"))
    return m.withColumn("precision_minus_recall", F.col("precision") - F.col("recall"))


def agg_38_table_sections(spark, d):
    runs = table(spark, d, "eval_runs").select("run_key", "family", "stage_mode")
    m = _run_metrics(spark, d).where("metric = 'f1'").join(F.broadcast(runs), "run_key")
    return m.groupBy("family").pivot("stage_mode", ["two_stage", "two_stage_per_type", "e2e"]).agg(F.count("value")).na.fill(0)


def set_05_multiset(spark, d):
    return M.multiset_overlap(_results(spark, d))


def set_06_dice(spark, d):
    t = A.strict_triplets(_args(spark, d)).select("doc_id", "side", F.concat_ws("\x1f", "event_type", "role", "argument").alias("k"))
    g = t.groupBy("doc_id").agg(F.collect_set(F.when(F.col("side") == "gold", F.col("k"))).alias("g"), F.collect_set(F.when(F.col("side") == "pred", F.col("k"))).alias("p"))
    return g.select("doc_id", M.dice(F.col("g"), F.col("p")).alias("dice"))


def set_07_types_covered(spark, d):
    g, p = A.event_type_list(F.col("ground_truth")), A.event_type_list(F.col("prediction"))
    r = _results(spark, d).where("ground_truth is not null and prediction is not null").select("result_id", g.alias("g"), p.alias("p"))
    return r.select("result_id", (F.size(F.array_except("g", "p")) == 0).alias("covered"), ((F.size(F.array_except("g", "p")) == 0) & (F.size(F.array_except("p", "g")) == 0)).alias("equal"))


def set_09_dedupe_arguments(spark, d):
    e = A.events(_results(spark, d)).where("side = 'pred'")
    distinct = F.array_distinct(F.filter("arguments", lambda a: a.isNotNull() & F.coalesce(a["role"] != "", F.lit(False)) & F.coalesce(a["argument"] != "", F.lit(False))))
    return e.select("doc_id", "event_idx", F.coalesce(F.size(distinct), F.lit(0)).cast("bigint").alias("n_distinct"))


def txt_05_relaxed_pairs(spark, d):
    return _argument_pairs(_args(spark, d)).withColumn("matches", relaxed_match(F.col("pred"), F.col("gold")))


def _argument_pairs(args: DataFrame, form=lambda c: c) -> DataFrame:
    """(doc_id, event_type, role, pred, gold): every two distinct arguments of a document that share event type and role."""
    a = args.where(A.filled("event_type", "role", "argument")).withColumn("argument", form(F.col("argument")))
    p, g = (a.where(f"side = '{s}'").select("doc_id", "event_type", "role", F.col("argument").alias(s)).distinct() for s in ("pred", "gold"))
    return p.join(g, ["doc_id", "event_type", "role"])


def txt_04_span_overlap(spark, d):
    return _argument_pairs(_args(spark, d), normalize).withColumn("overlap", span_overlap(F.col("pred"), F.col("gold")))


def srt_02_most_common(spark, d):
    e = A.events(_results(spark, d)).where("side = 'pred'").where(A.filled("event_type"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).orderBy(F.desc("n"), "first", "event_type").limit(10).select("event_type", "n")


def win_09_role_order(spark, d):
    known = _schema(spark, d).select("event_type", "role", F.lit(0).alias("rank"), F.struct(F.lit(0).cast("bigint").alias("doc"), F.lit(0).alias("event"), F.col("role_pos").alias("arg")).alias("pos"))
    seen = _args(spark, d).where(A.filled("event_type", "role")).select("event_type", "role", F.when(F.col("side") == "gold", 1).otherwise(2).alias("rank"), F.struct(F.col("doc_id").alias("doc"), F.col("event_idx").alias("event"), F.col("arg_idx").alias("arg")).alias("pos"))
    first = known.unionByName(seen).groupBy("event_type", "role").agg(F.min(F.struct("rank", "pos")).alias("at"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "role"))), lambda x: x["role"])
    return first.groupBy("event_type").agg(F.array_join(ordered, "|").alias("roles"))


def _norm(x: str) -> str:
    return f"lower(translate(regexp_replace({x}, '{SPACE}+', '', 'g'), '（），。', '(),.'))"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def _div(a: str, b: str) -> str:
    return f"CASE WHEN coalesce({b}, 0) = 0 THEN 0.0e0 ELSE CAST({a} AS DOUBLE) / ({b}) END"


def _prf(t: str = "tp", p: str = "fp", n: str = "fn") -> str:
    pr, rc = f"({_div(t, f'{t}+{p}')})", f"({_div(t, f'{t}+{n}')})"
    return f"{pr} AS precision, {rc} AS recall, CASE WHEN {pr}+{rc} = 0 THEN 0.0e0 ELSE 2.0e0*{pr}*{rc}/({pr}+{rc}) END AS f1"


_SUMS = "CAST(coalesce(sum(tp),0) AS BIGINT) AS tp, CAST(coalesce(sum(fp),0) AS BIGINT) AS fp, CAST(coalesce(sum(fn),0) AS BIGINT) AS fn"
BASE = f"""
WITH ev0 AS (
  SELECT result_id AS doc_id, 'gold' AS side, unnest(ground_truth) AS e, generate_subscripts(ground_truth, 1) - 1 AS event_idx FROM evaluation_results
  UNION ALL SELECT result_id, 'pred', unnest(prediction), generate_subscripts(prediction, 1) - 1 FROM evaluation_results),
ev AS (SELECT doc_id, side, CAST(event_idx AS INT) AS event_idx, e.event_type AS event_type, e."trigger" AS trig, e.arguments AS arguments FROM ev0 WHERE e IS NOT NULL),
ar0 AS (SELECT doc_id, side, event_idx, event_type, trig, unnest(arguments) AS a, generate_subscripts(arguments, 1) - 1 AS arg_idx FROM ev),
args AS (SELECT doc_id, side, event_idx, CAST(arg_idx AS INT) AS arg_idx, event_type, trig, a.role AS role, a.argument AS argument FROM ar0 WHERE a IS NOT NULL),
strict AS (SELECT DISTINCT doc_id, side, event_type, role, {_norm("argument")} AS argument FROM args WHERE event_type <> '' AND role <> '' AND argument <> '' AND {_norm("argument")} <> ''),
sheld AS (SELECT doc_id, event_type, role, argument, max(side = 'gold') AS g, max(side = 'pred') AS p FROM strict GROUP BY ALL),
sm AS (SELECT doc_id, event_type, role, argument, CASE WHEN g AND p THEN 1 ELSE 0 END AS tp, CASE WHEN NOT g THEN 1 ELSE 0 END AS fp, CASE WHEN NOT p THEN 1 ELSE 0 END AS fn FROM sheld),
rec0 AS (SELECT doc_id, side, event_idx, {_strip("coalesce(event_type,'')")} AS event_type, {_strip("coalesce(role,'')")} AS role, {_norm("coalesce(argument,'')")} AS v FROM args),
rec1 AS (SELECT doc_id, side, event_type, event_idx, role, string_agg(DISTINCT v, chr(30) ORDER BY v) AS v FROM rec0 WHERE event_type <> '' AND role <> '' AND v <> '' GROUP BY ALL),
rec AS (SELECT doc_id, side, event_type, event_idx, count(*) AS n_slots, string_agg(role, '|' ORDER BY role) AS roles, string_agg(role || chr(29) || v, chr(31) ORDER BY role) AS body FROM rec1 GROUP BY ALL),
allrec AS (SELECT e.doc_id, e.side, e.event_idx, e.event_type, coalesce(r.body, '') AS body
           FROM (SELECT doc_id, side, event_idx, {_strip("coalesce(event_type,'')")} AS event_type FROM ev) e LEFT JOIN rec r ON e.doc_id=r.doc_id AND e.side=r.side AND e.event_idx=r.event_idx AND e.event_type=r.event_type WHERE e.event_type <> ''),
etypes AS (SELECT DISTINCT doc_id, side, event_type FROM ev WHERE event_type <> ''),
tk0 AS (SELECT doc_id, side, {_strip("coalesce(event_type,'')")} AS t, {_norm("coalesce(trig,'')")} AS w, arguments FROM ev),
tka AS (SELECT doc_id, side, t, w, {_strip("coalesce(a.role,'')")} AS r, {_norm("coalesce(a.argument,'')")} AS v FROM (SELECT doc_id, side, t, w, unnest(arguments) AS a FROM tk0 WHERE t <> '') WHERE a IS NOT NULL),
tk AS (SELECT doc_id, side, 'trigger_text_id' AS metric, w AS key FROM tk0 WHERE t <> '' AND w <> '' UNION SELECT doc_id, side, 'trigger_text_cls', t || chr(31) || w FROM tk0 WHERE t <> '' AND w <> ''
       UNION SELECT doc_id, side, 'argument_text_id', t || chr(31) || v FROM tka WHERE v <> '' UNION SELECT doc_id, side, 'argument_text_cls', t || chr(31) || r || chr(31) || v FROM tka WHERE v <> ''
       UNION SELECT doc_id, side, 'argument_attached_text_id', t || chr(31) || w || chr(31) || v FROM tka WHERE v <> '' AND w <> '' UNION SELECT doc_id, side, 'argument_attached_text_cls', t || chr(31) || w || chr(31) || r || chr(31) || v FROM tka WHERE v <> '' AND w <> ''),
texts AS (SELECT id, arg_max(text, row_id) AS text FROM duee_fin_samples WHERE text <> '' GROUP BY id),
runm0 AS (SELECT run_key, {_SUMS} FROM sm JOIN evaluation_results r ON r.result_id = sm.doc_id GROUP BY run_key),
runm1 AS (SELECT run_key, {_prf()} FROM runm0),
runm AS (SELECT run_key, 'precision' AS metric, precision AS value FROM runm1 UNION ALL SELECT run_key, 'recall', recall FROM runm1 UNION ALL SELECT run_key, 'f1', f1 FROM runm1)
"""
_TYPES_L = "list_filter(list_transform(list_filter(@, lambda e: e IS NOT NULL), lambda e: " + _strip("coalesce(e.event_type,'')") + "), lambda t: t <> '')"


def _types_list(c: str) -> str:
    """Distinct stripped types of a list column in order of appearance."""
    x = _TYPES_L.replace("@", c)
    return f"list_filter({x}, lambda t, i: list_position({x}, t) = i)"


_VIOLATIONS = """
WITH e AS (SELECT result_id AS doc_id, unnest(prediction) AS e, generate_subscripts(prediction, 1) AS i FROM evaluation_results),
h AS (SELECT doc_id, i, -1 AS j, CASE WHEN e IS NULL THEN 'event_not_object' WHEN coalesce(e.event_type,'') = '' THEN 'missing_event_type' WHEN e.event_type NOT IN (SELECT event_type FROM schema_roles) THEN 'invalid_event_type:' || e.event_type WHEN e.arguments IS NULL THEN 'arguments_not_list' END AS code FROM e),
a0 AS (SELECT doc_id, i, e.event_type AS t, unnest(e.arguments) AS a, generate_subscripts(e.arguments, 1) AS j FROM e WHERE e.arguments IS NOT NULL),
a AS (SELECT doc_id, i, j, CASE WHEN a IS NULL THEN 'argument_not_object' WHEN coalesce(a.role,'') = '' THEN 'missing_role' WHEN coalesce(a.argument,'') = '' THEN 'missing_argument' WHEN a0.t IN (SELECT event_type FROM schema_roles) AND (a0.t, a.role) NOT IN (SELECT (event_type, role) FROM schema_roles) THEN 'invalid_role:' || a.role END AS code FROM a0),
c AS (SELECT * FROM h WHERE code IS NOT NULL UNION ALL SELECT * FROM a WHERE code IS NOT NULL),
v AS (SELECT doc_id, code FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS rn FROM c) WHERE rn = 1)
"""
ORACLES = {
    "prj_01_strict_triplets": BASE + "SELECT * FROM strict",
    "prj_02_relaxed_pairs": BASE + f"SELECT doc_id, side, event_idx, arg_idx, event_type, role, {_strip("coalesce(argument,'None')")} AS argument FROM args WHERE event_type <> '' AND role <> '' AND {_strip("coalesce(argument,'None')")} <> ''",
    "prj_03_event_types": f"SELECT result_id, array_to_string({_types_list('ground_truth')}, '|') AS gold_types, array_to_string({_types_list('prediction')}, '|') AS pred_types FROM evaluation_results",
    "prj_04_text_keys": BASE + "SELECT side, metric, count(*) AS n_keys, count(DISTINCT doc_id) AS n_docs FROM tk GROUP BY ALL",
    "prj_05_records": BASE + "SELECT doc_id, side, event_type, event_idx, n_slots, roles FROM rec",
    "prj_06_signatures": BASE + "SELECT doc_id, side, event_idx, sha256(event_type || chr(28) || body) AS sig FROM allrec",
    "prj_07_filled_arguments": BASE + f"SELECT doc_id, side, event_idx, arg_idx, {_strip('role')} AS role, {_strip('argument')} AS argument FROM args WHERE {_strip('role')} <> '' AND {_strip('argument')} <> ''",
    "prj_08_first_filled_side": "SELECT result_id, CAST(coalesce(len(CASE WHEN len(prediction) > 0 THEN prediction ELSE ground_truth END), 0) AS BIGINT) AS n_events FROM evaluation_results",
    "prj_10_alias_canonicalize": BASE
    + """, p AS (SELECT a.doc_id, a.event_idx, a.arg_idx, a.role, r.canonical FROM args a LEFT JOIN role_alias r ON r.event_type = a.event_type AND r.alias = a.role WHERE side = 'pred'),
    q AS (SELECT doc_id, CAST(count(*) FILTER (WHERE canonical <> role) AS BIGINT) AS n, string_agg(coalesce(canonical, role, ''), '|' ORDER BY event_idx, arg_idx) AS roles FROM p GROUP BY doc_id)
    SELECT result_id, coalesce(n, 0) AS n_rewrites, coalesce(roles, '') AS roles FROM evaluation_results LEFT JOIN q ON q.doc_id = result_id""",
    "prj_20_previews": "SELECT result_id, substring(raw_response, 1, 1000) AS answer, CASE WHEN length(text_preview) > 100 THEN substring(text_preview, 1, 100) || '...' ELSE text_preview END AS preview FROM evaluation_results",
    "join_01_strict_match": BASE + "SELECT * FROM sm",
    "agg_02_role_prf": BASE + f"SELECT *, {_prf()} FROM (SELECT event_type, role, {_SUMS} FROM sm GROUP BY ALL)",
    "agg_05_strict_prf": BASE + f"SELECT *, {_prf()} FROM (SELECT {_SUMS} FROM sm)",
    "agg_07_type_prf": BASE + f"SELECT *, {_prf()} FROM (SELECT {_SUMS} FROM (SELECT CAST(max(side='gold') AND max(side='pred') AS INT) AS tp, CAST(NOT max(side='gold') AS INT) AS fp, CAST(NOT max(side='pred') AS INT) AS fn FROM etypes GROUP BY doc_id, event_type))",
    "agg_12_text_prf": BASE + f"SELECT *, {_prf()} FROM (SELECT metric, {_SUMS} FROM (SELECT metric, CAST(max(side='gold') AND max(side='pred') AS INT) AS tp, CAST(NOT max(side='gold') AS INT) AS fp, CAST(NOT max(side='pred') AS INT) AS fn FROM tk GROUP BY doc_id, metric, key) GROUP BY metric)",
    "agg_12_text_grounding": BASE
    + f""", v AS (SELECT doc_id, {_norm("coalesce(trig,'')")} AS v FROM ev WHERE side='pred' UNION ALL SELECT doc_id, {_norm("coalesce(argument,'')")} FROM args WHERE side='pred'),
    n AS (SELECT id, {_norm('text')} AS text FROM texts), j AS (SELECT contains(n.text, v.v) AS ok FROM v JOIN evaluation_results r ON r.result_id = v.doc_id JOIN n ON n.id = r.sample_id WHERE v.v <> '' AND n.text <> '')
    SELECT count(*) AS total, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS grounded, {_div('count(*) FILTER (WHERE ok)', 'count(*)')} AS coverage FROM j""",
    "agg_09_type_presence": BASE
    + f""", h AS (SELECT doc_id, t AS event_type, max(side='gold') AS g, max(side='pred') AS p FROM tk0 WHERE t <> '' GROUP BY ALL),
    s AS (SELECT event_type, count(*) FILTER (WHERE g AND p) AS tp, count(*) FILTER (WHERE p AND NOT g) AS fp, count(*) FILTER (WHERE g AND NOT p) AS fn FROM h GROUP BY ALL),
    f AS (SELECT coalesce(k.event_type, s.event_type) AS event_type, CAST(coalesce(tp,0) AS BIGINT) AS tp, CAST(coalesce(fp,0) AS BIGINT) AS fp, CAST(coalesce(fn,0) AS BIGINT) AS fn FROM (SELECT DISTINCT event_type FROM schema_roles) k FULL OUTER JOIN s ON s.event_type = k.event_type)
    SELECT *, {_prf()} FROM f""",
    "agg_10_instances": BASE
    + f""", c AS (SELECT 'instance' AS kind, doc_id, event_type || chr(28) || body AS sig, side FROM allrec UNION ALL SELECT 'combination', doc_id, body, side FROM allrec),
    e AS (SELECT kind, doc_id, sig, count(*) FILTER (WHERE side='pred') AS p, count(*) FILTER (WHERE side='gold') AS g FROM c GROUP BY ALL),
    s AS (SELECT kind, CAST(sum(least(p,g)) AS BIGINT) AS tp, CAST(sum(p-least(p,g)) AS BIGINT) AS fp, CAST(sum(g-least(p,g)) AS BIGINT) AS fn FROM e GROUP BY kind) SELECT *, {_prf()} FROM s""",
    "agg_04_parse_rates": f"""SELECT run_key, count(*) AS n_rows, count(*) FILTER (WHERE coalesce(parse_success,false) AND coalesce(len(parse_diagnostics.repair_steps),0) = 0) AS n_raw_success,
    count(*) FILTER (WHERE coalesce(parse_success,false) AND coalesce(len(parse_diagnostics.repair_steps),0) > 0) AS n_repaired, count(*) FILTER (WHERE NOT coalesce(parse_success,false) AND coalesce(parse_diagnostics.extraction_method = 'no_json_found', false)) AS n_no_json,
    count(*) FILTER (WHERE NOT coalesce(parse_success,false)) AS n_errors, {_div('count(*) FILTER (WHERE NOT coalesce(parse_success,false))', 'count(*)')} AS error_rate FROM evaluation_results GROUP BY run_key""",
    "agg_13_hallucination": BASE
    + f""", h AS (SELECT a.doc_id, coalesce(argument,'None') AS raw, t.text FROM args a JOIN evaluation_results r ON r.result_id = a.doc_id JOIN texts t ON t.id = r.sample_id WHERE side='pred' AND length(coalesce(argument,'None')) >= 2),
    b AS (SELECT doc_id, NOT (contains(text, raw) OR contains(regexp_replace(text,'{SPACE}+','','g'), regexp_replace(raw,'{SPACE}+','','g'))) AS bad FROM h),
    s AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE bad) AS bad FROM b GROUP BY doc_id)
    SELECT CAST(coalesce(sum(n),0) AS BIGINT) AS n_values, CAST(coalesce(sum(bad),0) AS BIGINT) AS n_ungrounded, count(*) AS n_docs, count(*) FILTER (WHERE bad > 0) AS n_docs_ungrounded, {_div('sum(bad)', 'sum(n)')} AS value_rate, {_div('count(*) FILTER (WHERE bad > 0)', 'count(*)')} AS doc_rate FROM s""",
    "flt_01_ungrounded": BASE
    + f""", h AS (SELECT a.doc_id, event_idx, arg_idx, event_type, role, coalesce(argument,'None') AS argument, t.text FROM args a JOIN evaluation_results r ON r.result_id = a.doc_id JOIN texts t ON t.id = r.sample_id WHERE side='pred' AND length(coalesce(argument,'None')) >= 2)
    SELECT doc_id, event_idx, arg_idx, event_type, role, argument FROM h WHERE NOT (contains(text, argument) OR contains(regexp_replace(text,'{SPACE}+','','g'), regexp_replace(argument,'{SPACE}+','','g')))""",
    "flt_02_violations": _VIOLATIONS + "SELECT doc_id, code FROM v",
    "agg_14_violation_top10": _VIOLATIONS + "SELECT code, count(*) AS n FROM v GROUP BY code ORDER BY n DESC, code LIMIT 10",
    "agg_16_error_top10": BASE + "SELECT CASE WHEN fn = 1 THEN 'FN' ELSE 'FP' END || '_' || event_type || '_' || role AS error, count(*) AS n FROM sm WHERE tp = 0 GROUP BY 1 ORDER BY n DESC, error LIMIT 10",
    "agg_20_diagnostics": f"""WITH r AS (SELECT r.run_key, parse_success, stage_mode LIKE 'two_stage%' AS two, coalesce({_types_list('ground_truth')}, []) AS g, coalesce({_types_list('prediction')}, []) AS p, coalesce(len(list_filter(ground_truth, lambda e: e IS NOT NULL)),0) AS ng, coalesce(len(list_filter(prediction, lambda e: e IS NOT NULL)),0) AS np
      FROM evaluation_results r JOIN eval_runs u ON u.run_key = r.run_key),
    m AS (SELECT *, len(list_filter(g, lambda x: NOT list_contains(p, x))) AS missed, len(list_filter(p, lambda x: NOT list_contains(g, x))) AS extra FROM r)
    SELECT run_key, count(*) AS n_rows, {_div('count(*) FILTER (WHERE coalesce(parse_success,false))', 'count(*)')} AS parse_success_rate, avg(CAST(ng AS DOUBLE)) AS avg_gold_events, avg(CAST(np AS DOUBLE)) AS avg_predicted_events, avg(CAST(len(g) AS DOUBLE)) AS avg_gold_event_types, count(*) FILTER (WHERE two) AS n_two_stage,
    CAST(count(*) FILTER (WHERE two AND len(g) > 0 AND missed = 0) AS DOUBLE)/nullif(count(*) FILTER (WHERE two),0) AS coverage_rate, CAST(count(*) FILTER (WHERE two AND missed = 0 AND extra = 0) AS DOUBLE)/nullif(count(*) FILTER (WHERE two),0) AS exact_rate,
    CAST(count(*) FILTER (WHERE two AND missed > 0) AS DOUBLE)/nullif(count(*) FILTER (WHERE two),0) AS miss_rate, CAST(count(*) FILTER (WHERE two AND extra > 0) AS DOUBLE)/nullif(count(*) FILTER (WHERE two),0) AS over_rate FROM m GROUP BY run_key""",
    "agg_28_runs": BASE
    + """, m AS (SELECT family, metric, value FROM runm JOIN eval_runs u ON u.run_key = runm.run_key), g AS (SELECT family, metric, count(*) AS n_runs, avg(value) AS mean, coalesce(stddev_samp(value), 0.0) AS std, min(value) AS "min", max(value) AS "max", list_sort(list(value)) AS v FROM m GROUP BY ALL)
    SELECT family, metric, n_runs, mean, std, "min", "max", v[CAST(round_even((n_runs-1)*0.5, 0) AS INT)+1] AS median, v[CAST(round_even((n_runs-1)*0.025, 0) AS INT)+1] AS low, v[CAST(round_even((n_runs-1)*0.975, 0) AS INT)+1] AS high FROM g""",
    "agg_29_runs_population": BASE + "SELECT stage_mode, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM runm JOIN eval_runs u ON u.run_key = runm.run_key GROUP BY ALL",
    "agg_37_derived_rows": BASE + "SELECT run_key, precision, recall, f1, precision - recall AS precision_minus_recall FROM runm1",
    "agg_38_table_sections": BASE + "SELECT family, count(*) FILTER (WHERE stage_mode='two_stage') AS two_stage, count(*) FILTER (WHERE stage_mode='two_stage_per_type') AS two_stage_per_type, count(*) FILTER (WHERE stage_mode='e2e') AS e2e FROM runm1 r JOIN eval_runs u ON u.run_key = r.run_key GROUP BY family",
    "set_05_multiset": BASE + ", e AS (SELECT doc_id, event_type || chr(28) || body AS sig, count(*) FILTER (WHERE side='pred') AS p, count(*) FILTER (WHERE side='gold') AS g FROM allrec GROUP BY ALL) SELECT doc_id, CAST(sum(least(p,g)) AS BIGINT) AS tp, CAST(sum(p-least(p,g)) AS BIGINT) AS fp, CAST(sum(g-least(p,g)) AS BIGINT) AS fn FROM e GROUP BY doc_id",
    "set_06_dice": BASE + ", c AS (SELECT doc_id, sum(tp) AS bo, sum(tp+fn) AS g, sum(tp+fp) AS p FROM sm GROUP BY doc_id) SELECT doc_id, CASE WHEN g + p = 0 THEN 1.0e0 WHEN g = 0 OR p = 0 THEN 0.0e0 ELSE 2.0e0*CAST(bo AS DOUBLE)/CAST(g+p AS DOUBLE) END AS dice FROM c",
    "set_07_types_covered": f"WITH r AS (SELECT result_id, {_types_list('ground_truth')} AS g, {_types_list('prediction')} AS p FROM evaluation_results WHERE ground_truth IS NOT NULL AND prediction IS NOT NULL) SELECT result_id, len(list_filter(g, lambda x: NOT list_contains(p, x))) = 0 AS covered, len(list_filter(g, lambda x: NOT list_contains(p, x))) = 0 AND len(list_filter(p, lambda x: NOT list_contains(g, x))) = 0 AS equal FROM r",
    "set_09_dedupe_arguments": BASE + "SELECT e.doc_id, e.event_idx, CAST(count(DISTINCT CASE WHEN role <> '' AND argument <> '' THEN role || chr(31) || argument END) AS BIGINT) AS n_distinct FROM ev e LEFT JOIN args a ON a.doc_id=e.doc_id AND a.side=e.side AND a.event_idx=e.event_idx WHERE e.side='pred' GROUP BY ALL",
    "txt_05_relaxed_pairs": BASE
    + f""", x AS (SELECT DISTINCT doc_id, side, event_type, role, argument, {_norm('argument')} AS v FROM args WHERE event_type <> '' AND role <> '' AND argument <> ''), j AS (SELECT p.doc_id, p.event_type, p.role, p.argument AS pred, g.argument AS gold, p.v AS a, g.v AS b, list_distinct(list_filter(string_split(p.v,''), lambda c: c <> '')) AS ca, list_distinct(list_filter(string_split(g.v,''), lambda c: c <> '')) AS cb FROM x p JOIN x g ON g.doc_id=p.doc_id AND g.event_type=p.event_type AND g.role=p.role WHERE p.side='pred' AND g.side='gold')
    SELECT doc_id, event_type, role, pred, gold, CASE WHEN a = '' OR b = '' THEN false ELSE a = b OR contains(a,b) OR contains(b,a) OR len(list_intersect(ca,cb))/CAST(len(list_distinct(list_concat(ca,cb))) AS DOUBLE) >= 0.5 END AS matches FROM j""",
    "srt_02_most_common": BASE + "SELECT event_type, n FROM (SELECT event_type, count(*) AS n, min(doc_id) AS f FROM ev WHERE side='pred' AND event_type <> '' GROUP BY event_type ORDER BY n DESC, f, event_type LIMIT 10)",
    "win_09_role_order": BASE
    + """, a AS (SELECT event_type, role, 0 AS rk, {'d': CAST(0 AS BIGINT), 'e': CAST(0 AS BIGINT), 'a': CAST(role_pos AS BIGINT)} AS pos FROM schema_roles UNION ALL SELECT event_type, role, CASE WHEN side='gold' THEN 1 ELSE 2 END, {'d': CAST(doc_id AS BIGINT), 'e': CAST(event_idx AS BIGINT), 'a': CAST(arg_idx AS BIGINT)} FROM args WHERE event_type <> '' AND role <> ''),
    f AS (SELECT event_type, role, rk, pos, row_number() OVER (PARTITION BY event_type, role ORDER BY rk, pos) AS rn FROM a) SELECT event_type, string_agg(role, '|' ORDER BY rk, pos, role) AS roles FROM f WHERE rn = 1 GROUP BY event_type""",
}
QUERIES = {n: f for n, f in globals().items() if n.split("_")[0] in ("prj", "join", "agg", "flt", "set", "txt", "srt", "win", "cls") and callable(f)}
