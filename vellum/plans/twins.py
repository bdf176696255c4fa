"""SQL twins of queries whose rules are greedy, repaired or hashed: recursion over the order in which the rules go.

The twins state the rules on their own: assignment takes one prediction after
the other, first fit one value after the other, and both carry the list of what
is taken already.
"""

from __future__ import annotations

from vellum.functions import jsonops as J
from vellum.operators import repair as R
from vellum.operators import validation as V
from vellum.plans import check_queries as CQ
from vellum.plans import nested_queries as NQ
from vellum.plans import prepare_queries as PQ
from vellum.plans import score_queries as SQ

_RECURSIVE = SQ.BASE.replace("WITH", "WITH RECURSIVE", 1)
#: Slots of every typed record, records numbered in the order of assignment, and equal slots of each pair of records.
_ASSIGNED = (
    _RECURSIVE
    + """, slots AS (SELECT doc_id, side, event_type, event_idx, role, v FROM rec1),
 kept AS (SELECT a.doc_id, a.side, a.event_type, a.event_idx, count(s.role) AS n FROM allrec a LEFT JOIN slots s USING (doc_id, side, event_type, event_idx) GROUP BY ALL),
 p AS (SELECT doc_id, event_type, event_idx, row_number() OVER (PARTITION BY doc_id, event_type ORDER BY n DESC, event_idx) AS k FROM kept WHERE side = 'pred'),
 g AS (SELECT doc_id, event_type, event_idx, row_number() OVER (PARTITION BY doc_id, event_type ORDER BY event_idx) AS k FROM kept WHERE side = 'gold'),
 roles AS (SELECT doc_id, event_type, count(DISTINCT role) AS n FROM slots GROUP BY ALL),
 eq AS (SELECT x.doc_id, x.event_type, x.event_idx AS pe, y.event_idx AS ge, count(*) FILTER (WHERE x.v = y.v) AS same, count(*) AS shared FROM slots x JOIN slots y ON x.doc_id = y.doc_id AND x.event_type = y.event_type AND x.role = y.role WHERE x.side = 'pred' AND y.side = 'gold' GROUP BY ALL),
 sc AS (SELECT p.doc_id, p.event_type, p.k AS pk, g.k AS gk, p.event_idx AS pe, g.event_idx AS ge, coalesce(eq.same, 0) + coalesce(r.n, 0) - kp.n - kg.n + coalesce(eq.shared, 0) AS score
   FROM p JOIN g USING (doc_id, event_type) JOIN kept kp ON kp.doc_id = p.doc_id AND kp.side = 'pred' AND kp.event_idx = p.event_idx AND kp.event_type = p.event_type
   JOIN kept kg ON kg.doc_id = g.doc_id AND kg.side = 'gold' AND kg.event_idx = g.event_idx AND kg.event_type = g.event_type
   LEFT JOIN roles r ON r.doc_id = p.doc_id AND r.event_type = p.event_type LEFT JOIN eq ON eq.doc_id = p.doc_id AND eq.event_type = p.event_type AND eq.pe = p.event_idx AND eq.ge = g.event_idx),
 firsts AS (SELECT DISTINCT doc_id, event_type FROM sc),
 walk AS (SELECT doc_id, event_type, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used FROM firsts
   UNION ALL SELECT w.doc_id, w.event_type, w.k + 1, list_append(w.used, arg_max(s.gk, s.score * 1000000 - s.gk)) FROM walk w JOIN sc s ON s.doc_id = w.doc_id AND s.event_type = w.event_type AND s.pk = w.k + 1 WHERE NOT list_contains(w.used, s.gk) GROUP BY w.doc_id, w.event_type, w.k, w.used),
 pairs AS (SELECT doc_id, event_type, unnest(used) AS gk, generate_subscripts(used, 1) AS pk FROM (SELECT doc_id, event_type, arg_max(used, k) AS used FROM walk GROUP BY ALL)),
 met AS (SELECT q.doc_id, q.event_type, p.event_idx AS pe, g.event_idx AS ge FROM pairs q JOIN p ON p.doc_id = q.doc_id AND p.event_type = q.event_type AND p.k = q.pk JOIN g ON g.doc_id = q.doc_id AND g.event_type = q.event_type AND g.k = q.gk),
 ps AS (SELECT s.doc_id, s.event_type, s.role, s.v, s.event_idx AS pe, m.ge FROM slots s LEFT JOIN met m ON m.doc_id = s.doc_id AND m.event_type = s.event_type AND m.pe = s.event_idx WHERE s.side = 'pred'),
 gs AS (SELECT doc_id, event_type, role, v, event_idx AS ge FROM slots WHERE side = 'gold'),
 hit AS (SELECT ps.doc_id, ps.event_type, ps.role, ps.pe, ps.ge FROM ps JOIN gs ON gs.doc_id = ps.doc_id AND gs.event_type = ps.event_type AND gs.role = ps.role AND gs.ge = ps.ge AND gs.v = ps.v),
 np AS (SELECT doc_id, event_type, role, count(*) AS n FROM ps GROUP BY ALL), ng AS (SELECT doc_id, event_type, role, count(*) AS n FROM gs GROUP BY ALL), nh AS (SELECT doc_id, event_type, role, count(*) AS n FROM hit GROUP BY ALL),
 asg AS (SELECT doc_id, event_type, role, CAST(coalesce(nh.n, 0) AS INT) AS tp, CAST(coalesce(np.n, 0) - coalesce(nh.n, 0) AS INT) AS fp, CAST(coalesce(ng.n, 0) - coalesce(nh.n, 0) AS INT) AS fn
   FROM np FULL JOIN ng USING (doc_id, event_type, role) LEFT JOIN nh USING (doc_id, event_type, role))
"""
)
_CHARS = "list_distinct(list_filter(string_split({0}, ''), lambda c: c <> ''))"
#: Values in order and which of them match, then one prediction after the other taking the first free value.
_FITTED = (
    _RECURSIVE
    + f""", bag AS (SELECT doc_id, side, event_type, role, {SQ._strip("coalesce(argument, 'None')")} AS a, event_idx, arg_idx FROM args WHERE event_type <> '' AND role <> ''),
 b AS (SELECT *, {SQ._norm('a')} AS v, row_number() OVER (PARTITION BY doc_id, side, event_type, role ORDER BY event_idx, arg_idx, a) AS k FROM bag WHERE a <> ''),
 sizes AS (SELECT doc_id, event_type, role, CAST(count(*) FILTER (WHERE side = 'pred') AS INT) AS n_pred, CAST(count(*) FILTER (WHERE side = 'gold') AS INT) AS n_gold FROM b GROUP BY ALL),
 ok AS (SELECT p.doc_id, p.event_type, p.role, p.k AS pk, g.k AS gk FROM b p JOIN b g ON g.doc_id = p.doc_id AND g.event_type = p.event_type AND g.role = p.role WHERE p.side = 'pred' AND g.side = 'gold' AND p.v <> '' AND g.v <> '' AND
   (p.v = g.v OR contains(p.v, g.v) OR contains(g.v, p.v) OR len(list_intersect({_CHARS.format('p.v')}, {_CHARS.format('g.v')})) / CAST(len(list_distinct(list_concat({_CHARS.format('p.v')}, {_CHARS.format('g.v')}))) AS DOUBLE) >= 0.5)),
 walk AS (SELECT doc_id, event_type, role, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used FROM (SELECT DISTINCT doc_id, event_type, role FROM ok)
   UNION ALL SELECT w.doc_id, w.event_type, w.role, w.k + 1, CASE WHEN min(o.gk) IS NULL THEN w.used ELSE list_append(w.used, min(o.gk)) END FROM walk w JOIN sizes z ON z.doc_id = w.doc_id AND z.event_type = w.event_type AND z.role = w.role
     LEFT JOIN ok o ON o.doc_id = w.doc_id AND o.event_type = w.event_type AND o.role = w.role AND o.pk = w.k + 1 AND NOT list_contains(w.used, o.gk) WHERE w.k < z.n_pred GROUP BY w.doc_id, w.event_type, w.role, w.k, w.used),
 taken AS (SELECT doc_id, event_type, role, CAST(max(len(used)) AS INT) AS tp FROM walk GROUP BY ALL),
 fit AS (SELECT z.doc_id, z.event_type, z.role, n_pred, n_gold, coalesce(tp, 0) AS tp FROM sizes z LEFT JOIN taken t USING (doc_id, event_type, role))
"""
)
_ROLES = _ASSIGNED + f""", full_roles AS (SELECT event_type, role, {SQ._SUMS} FROM (SELECT event_type, role, tp, fp, fn FROM asg UNION ALL SELECT event_type, role, 0, 0, 0 FROM schema_roles) GROUP BY ALL), scored AS (SELECT *, {SQ._prf()} FROM full_roles)"""
_COUNTS = "CAST(coalesce(sum(tp), 0) AS BIGINT) AS tp, CAST(coalesce(sum(fp), 0) AS BIGINT) AS fp, CAST(coalesce(sum(fn), 0) AS BIGINT) AS fn"
#: Valid JSON; the engine itself lets a comma before a closing bracket pass.
_JSON = r"""(json_valid({0}) AND NOT regexp_matches(regexp_replace({0}, '"(?:[^"\\]|\\.)*"', '""', 'g'), ',\s*[\]}}]'))"""
_VALID = PQ._RUNGS + f", ok AS (SELECT result_id, min(rung) AS r FROM rungs WHERE {_JSON.format('json')} GROUP BY result_id)"
_NAMES = "[" + ", ".join(f"'{n}'" for n in J.REPAIRS) + "]"
_NUDGED = (
    SQ.BASE
    + f""", v AS (SELECT doc_id, event_idx, arg_idx, argument AS v, regexp_extract(argument, '(\\d{{1,15}})', 1) AS d, {PQ._NUM.format("concat_ws(':', doc_id, event_idx, arg_idx)")} / 4294967296.0e0 AS u FROM args WHERE side = 'gold' AND argument <> ''),
 nudged AS (SELECT *, CASE WHEN d <> '' THEN regexp_extract(v, '^(\\D*)', 1) || CAST(abs(CAST(d AS BIGINT) + [1, 10, 100, -1, -10][CAST(floor(u * 5) AS INT) + 1]) AS VARCHAR) || regexp_extract(v, '^\\D*\\d{{1,15}}(.*)$', 1) ELSE substring(v, 1, greatest(length(v) - 1, 1)) END AS wrong FROM v)
"""
)
_NO_META = [p for p in V.REQUIRED if p not in ("meta.seed", "meta.primary_metric")]
_ALWAYS = [f"Missing required field: {p}" for p in _NO_META] + [f"Missing {b} block" for b in ("compare", "diagnostics", "cost", "analysis")] + ["Missing required field: experiment_contract.experiment_contract_hash"] + [f"Missing metric: {m}" for m in V.LABELLED if m != "strict_f1"]
_SUITE = [f"Missing suite field: {f}" for f in V.SUITE if f not in ("split", "aggregated")] + [f"Missing suite field: {f}" for f in V.SINGLE_SEED]
_VALUES = lambda texts: "(VALUES " + ", ".join(f"('{t}')" for t in texts) + ") m(error)"
_SINGLE = CQ._CANON.replace('''|| stage_mode ||''', f"|| coalesce({CQ._MODE}, 'single_pass') ||")
_SETS = lambda sql: f"(SELECT doc_id, sum(tp) AS tp, sum(tp + fp) AS np, sum(tp + fn) AS ng FROM ({sql}) GROUP BY doc_id)"
_BAGS = lambda key: f"(SELECT doc_id, sum(least(p, g)) AS tp, sum(p) AS np, sum(g) AS ng FROM (SELECT doc_id, {key} AS k, count(*) FILTER (WHERE side = 'pred') AS p, count(*) FILTER (WHERE side = 'gold') AS g FROM ({SQ.BASE} SELECT * FROM allrec) GROUP BY ALL) GROUP BY doc_id)"
_TYPES = SQ.BASE + "SELECT doc_id, event_type, CAST(g AND p AS INT) AS tp, CAST(p AND NOT g AS INT) AS fp, CAST(g AND NOT p AS INT) AS fn FROM (SELECT doc_id, event_type, max(side = 'gold') AS g, max(side = 'pred') AS p FROM etypes GROUP BY ALL)"
_PARTS = {
    "strict": _SETS(SQ.BASE + "SELECT * FROM sm"), "relaxed": _SETS(_FITTED + "SELECT doc_id, tp, n_pred - tp AS fp, n_gold - tp AS fn FROM fit"), "type": _SETS(_TYPES), "doc_role": _SETS(_ASSIGNED + "SELECT * FROM asg"),
    "doc_event_type": _SETS(_TYPES), "doc_instance": _BAGS("event_type || chr(28) || body"), "doc_combination": _BAGS("body"),
}
_SAMPLE_COUNTS = (
    "SELECT result_id AS doc_id, CAST(len(list_filter(coalesce(ground_truth, []), lambda e: e IS NOT NULL)) AS INT) AS gold_event_count, "
    + ", ".join(f"CAST(coalesce(q{i}.{c}, 0) AS BIGINT) AS {n}_{k}" for i, n in enumerate(_PARTS) for c, k in (("tp", "tp"), ("np", "pred_total"), ("ng", "gold_total")))
    + " FROM evaluation_results r " + " ".join(f"LEFT JOIN {q} q{i} ON q{i}.doc_id = r.result_id" for i, q in enumerate(_PARTS.values()))
)
_SUMMED = ", ".join(f"sum({n}_{k}) AS {n}_{k}" for n in _PARTS for k in ("tp", "pred_total", "gold_total")) + ", " + ", ".join(
    f"coalesce(sum(doc_role_{k}) FILTER (WHERE gold_event_count {c}), 0) AS {n}_{k}" for n, c in (("single", "= 1"), ("multi", "> 1")) for k in ("tp", "pred_total", "gold_total"))


def _rates(n: str) -> str:
    p, r = SQ._div(f"{n}_tp", f"{n}_pred_total"), SQ._div(f"{n}_tp", f"{n}_gold_total")
    return f"{p} AS {n}_precision, {r} AS {n}_recall, CASE WHEN {p} + {r} = 0 THEN 0.0e0 ELSE 2.0e0*{p}*{r}/({p}+{r}) END AS {n}_f1"


_SIDE = "(SELECT sample_id, arg_max({{'ok': parse_success, 'ev': prediction}}, result_id) AS x FROM evaluation_results r JOIN eval_runs u ON u.run_key = r.run_key WHERE family = '{0}' GROUP BY sample_id)"
_KEYS = (
    "list_distinct(flatten(list_transform(list_filter({0}, lambda e: e IS NOT NULL AND e.arguments IS NOT NULL), lambda e: list_transform(list_filter(e.arguments, lambda a: a IS NOT NULL), lambda a: "
    + " || chr(31) || ".join(SQ._strip(f"coalesce({c}, '')").replace("{", "{{").replace("}", "}}") for c in ("e.event_type", "a.role", "a.argument")) + "))))"
)
_REAL = "coalesce(len(list_filter({0}, lambda e: e IS NOT NULL)), 0)"
_CONSENSUS = (
    f"WITH {PQ._TX}, j AS (SELECT p.sample_id, p.x.ok AS p_ok, p.x.ev AS p_ev, s.x.ok AS s_ok, s.x.ev AS s_ev, s.sample_id IS NOT NULL AS there, t.id IS NOT NULL AS has_text FROM {_SIDE.format('api')} p LEFT JOIN {_SIDE.format('local')} s ON s.sample_id = p.sample_id LEFT JOIN texts t ON t.id = p.sample_id),\n"
    + f"e AS (SELECT *, CASE WHEN coalesce(sample_id, '') = '' THEN 'missing_id' WHEN NOT coalesce(p_ok, false) THEN 'primary_parse_failed' WHEN {_REAL.format('p_ev')} = 0 THEN 'primary_empty_prediction' WHEN NOT has_text THEN 'missing_source_text' WHEN NOT there THEN 'missing_secondary_row' "
    + f"WHEN NOT coalesce(s_ok, false) THEN 'secondary_parse_failed' WHEN {_REAL.format('s_ev')} = 0 THEN 'secondary_empty_prediction' WHEN list_sort({SQ._types_list('p_ev')}) <> list_sort({SQ._types_list('s_ev')}) THEN 'event_type_mismatch' END AS early, {_KEYS.format('p_ev')} AS pk, {_KEYS.format('s_ev')} AS sk FROM j),\n"
    + "a AS (SELECT sample_id, early, CASE WHEN early IS NULL THEN round(CASE WHEN len(pk) + len(sk) = 0 THEN 1.0e0 WHEN len(pk) = 0 OR len(sk) = 0 THEN 0.0e0 ELSE 2.0e0 * len(list_intersect(pk, sk)) / (len(pk) + len(sk)) END, 6) END AS agreement FROM e), "
    + "c AS (SELECT sample_id, coalesce(early, CASE WHEN agreement < 0.5 THEN 'insufficient_role_overlap' END, 'kept') AS reason, agreement FROM a)\n"
)
_SLOT_SQL = [(pattern.replace("'", "''"), f"'{new}'" if new else "CASE WHEN contains(@, '%') THEN '99%' WHEN contains(@, '股') THEN '9999股' ELSE '9999元' END", kind) for pattern, new, kind in R.SLOTS]
_PERTURBED = (
    "WITH o AS (SELECT row_id, text AS t, " + ", ".join(f"regexp_extract(text, '{p}') AS o{i}" for i, (p, _, _) in enumerate(_SLOT_SQL)) + " FROM duee_fin_samples WHERE text IS NOT NULL), "
    + "k AS (SELECT row_id, t, CASE " + " ".join(f"WHEN o{i} <> '' THEN {{'type': '{kind}', 'old': o{i}, 'new': {new.replace('@', f'o{i}')}}}" for i, (_, new, kind) in enumerate(_SLOT_SQL)) + " END AS k FROM o) "
    + "SELECT row_id, k IS NOT NULL AS changed, k.type AS \"type\", k.old AS old_value, k.new AS new_value, sha256(CASE WHEN k IS NULL THEN t ELSE substring(t, 1, strpos(t, k.old) - 1) || k.new || substring(t, strpos(t, k.old) + length(k.old)) END) AS digest FROM k"
)
_U = lambda x: f"CAST({x} AS UHUGEINT)"
_W = "18446744073709551616::UHUGEINT"


def _mixed(source: str, name: str) -> str:
    """Tables ``name`` with the column x of ``source`` mixed as the draws are."""
    steps = [(30, "13787848793156543929"), (27, "10723151780598845931")]
    out, last = "", source
    for i, (shift, factor) in enumerate(steps):
        out += f"{name}{i} AS (SELECT * REPLACE (CAST({_U(f'xor(x, x >> {shift})')} * {factor}::UHUGEINT % {_W} AS UBIGINT) AS x) FROM {last}), "
        last = f"{name}{i}"
    return out + f"{name} AS (SELECT * REPLACE (xor(x, x >> 31) AS x) FROM {last})"


_MONTE_CARLO = (
    "WITH o AS (SELECT e.source, strftime(evaluated_at, '%Y') AS year, u.family, CAST(parse_success AS INT) AS ok FROM evaluation_results e JOIN eval_runs u ON u.run_key = e.run_key WHERE parse_success IS NOT NULL), "
    + "pr AS (SELECT source, year, avg(CASE WHEN family = 'local' THEN CAST(ok AS DOUBLE) END) AS b, avg(CASE WHEN family = 'api' THEN CAST(ok AS DOUBLE) END) AS i FROM o GROUP BY ALL), "
    + "d AS (SELECT i - b AS d, row_number() OVER (ORDER BY i - b) - 1 AS place FROM pr WHERE b IS NOT NULL AND i IS NOT NULL), n AS (SELECT count(*) AS n, sum(d) / count(*) AS m FROM d), "
    + f"a AS (SELECT range AS draw, CAST({_U('range + 3407')} * 15074714826142052245::UHUGEINT % {_W} AS UBIGINT) AS x FROM range(0, 10000)), {_mixed('a', 'b')}, "
    + f"p AS (SELECT draw, d.d, CAST(({_U('x')} + {_U('place')} * 11400714819323198485::UHUGEINT) % {_W} AS UBIGINT) AS x FROM b, d), {_mixed('p', 'q')}, "
    + "s AS (SELECT draw, abs(sum(CASE WHEN x >> 63 = 1 THEN d ELSE -d END) / (SELECT n FROM n)) >= (SELECT abs(m) FROM n) - 1e-12 AS hit FROM q GROUP BY draw) "
    + "SELECT 'parse_success' AS metric, CAST(n AS INT) AS n_pairs, round(m, 9) AS mean_diff, (SELECT count(*) FILTER (WHERE hit) / 10000.0e0 FROM s) AS p_value, 'monte_carlo' AS method, CAST(10000 AS BIGINT) AS n_permutations, 'tested' AS status FROM n"
)
ORACLES = {
    "txt_14_perturbed": _PERTURBED,
    "sta_02_monte_carlo": _MONTE_CARLO,
    "trn_04_consensus": _CONSENSUS + "SELECT * FROM c",
    "trn_04_reasons": _CONSENSUS + "SELECT reason, count(*) AS n, round(avg(agreement), 6) AS agreement FROM c GROUP BY reason",
    "agg_18_sample_counts": _SAMPLE_COUNTS,
    "agg_19_scores_from_counts": f"WITH s AS (SELECT {_SUMMED}, count(*) FILTER (WHERE gold_event_count = 0) AS zero_gold_samples FROM ({_SAMPLE_COUNTS})) SELECT zero_gold_samples, {', '.join(map(_rates, (*_PARTS, 'single', 'multi')))} FROM s",
    "join_03_assignment": _ASSIGNED + "SELECT * FROM asg",
    "agg_08_role_scores": _ROLES + "SELECT * FROM scored",
    "agg_08_rollup": _ROLES
    + f""", t AS (SELECT event_type, {_COUNTS}, avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1 FROM scored GROUP BY event_type),
 a AS (SELECT * FROM t UNION ALL SELECT CAST(NULL AS VARCHAR), {_COUNTS}, avg(macro_precision), avg(macro_recall), avg(macro_f1) FROM t) SELECT *, {SQ._prf()} FROM a""",
    "agg_11_multiplicity": _ASSIGNED
    + f""", n AS (SELECT result_id AS doc_id, len(list_filter(coalesce(ground_truth, []), lambda e: e IS NOT NULL)) AS n FROM evaluation_results), d AS (SELECT doc_id, {_COUNTS} FROM asg GROUP BY doc_id),
 m AS (SELECT CASE WHEN n = 1 THEN 'single_event' WHEN n > 1 THEN 'multi_event' ELSE 'zero_gold' END AS bucket, count(*) AS support_samples, CAST(sum(n) AS BIGINT) AS support_gold_events, {_COUNTS} FROM n LEFT JOIN d USING (doc_id) GROUP BY 1) SELECT *, {SQ._prf()} FROM m""",
    "join_02_first_fit": _FITTED + "SELECT * FROM fit",
    "agg_06_relaxed_prf": _FITTED + f""", s AS (SELECT CAST(coalesce(sum(tp), 0) AS BIGINT) AS tp, CAST(coalesce(sum(n_pred), 0) - coalesce(sum(tp), 0) AS BIGINT) AS fp, CAST(coalesce(sum(n_gold), 0) - coalesce(sum(tp), 0) AS BIGINT) AS fn FROM fit) SELECT *, {SQ._prf()} FROM s""",
    "jsn_07_ladder": _VALID + f"SELECT r.result_id, o.r IS NOT NULL AS success, CASE WHEN o.r > 0 THEN array_to_string(list_slice({_NAMES}, 1, CAST(o.r AS INT)), '|') ELSE '' END AS repairs FROM evaluation_results r LEFT JOIN ok o ON o.result_id = r.result_id",
    "jsn_08_event_objects": _VALID
    + """, j AS (SELECT result_id, CAST(json AS JSON) AS j FROM rungs JOIN ok USING (result_id) WHERE rung = r), b AS (SELECT result_id, CAST(CASE WHEN json_type(j) = 'ARRAY' THEN j WHEN json_type(j, '$.events') = 'ARRAY' THEN json_extract(j, '$.events') WHEN json_type(j) = 'OBJECT' THEN json_array(j) END AS JSON[]) AS e FROM j)
 SELECT r.result_id, coalesce(CAST(len(list_filter(e, lambda x: json_type(x) = 'OBJECT')) AS BIGINT), 0) AS n_events FROM evaluation_results r LEFT JOIN b ON b.result_id = r.result_id""",
    "jsn_09_strict": f"WITH t AS (SELECT result_id, {SQ._strip('raw_response')} AS t FROM evaluation_results WHERE raw_response IS NOT NULL) SELECT result_id, CASE WHEN NOT {_JSON.format('t')} THEN NULL WHEN json_type(t) = 'ARRAY' THEN 'array' WHEN json_type(t) = 'OBJECT' THEN 'object' ELSE 'other' END AS kind FROM t",
    "neg_02_nudged": _NUDGED + "SELECT doc_id, event_idx, arg_idx, wrong FROM nudged",
    "neg_05_retry_chain": _NUDGED + "SELECT CASE WHEN wrong <> v THEN 'HARD' WHEN length(v) > 1 THEN 'MEDIUM' ELSE 'EASY' END AS strategy, count(*) AS n FROM nudged GROUP BY 1",
    "agg_33_sampler": _NUDGED + "SELECT count(*) AS n_generated, count(*) FILTER (WHERE wrong = v) AS n_filtered, count(*) FILTER (WHERE wrong = v) AS n_retries, count(*) FILTER (WHERE wrong = v) / CAST(greatest(1, count(*)) AS DOUBLE) AS filter_rate, count(*) FILTER (WHERE wrong = v) / CAST(greatest(1, count(*)) AS DOUBLE) AS retry_rate FROM nudged",
    "p6_arguments": NQ._SQL_NODES
    + """SELECT 'evaluation_results' AS src, record_id, node, CAST(parent_idx AS INT) AS parent_idx, CAST(idx AS INT) AS idx, event_type, a.role AS role, a.argument AS argument FROM ar WHERE a IS NOT NULL
 UNION ALL SELECT 'result_lines', record_id, node, CAST(parent_idx AS INT), CAST(idx AS INT), event_type, a ->> '$.role', a ->> '$.argument' FROM la WHERE json_type(a) = 'OBJECT'""",
    "val_01_document_contracts": f"SELECT run_key, '' AS missing, sha256('{{' || {_SINGLE} || '}}') AS contract_hash FROM eval_runs",
    "val_04_summary_errors": f"SELECT run_key, error FROM eval_runs, {_VALUES(_ALWAYS)} WHERE run_key IN (SELECT run_key FROM evaluation_results) UNION ALL SELECT run_key, 'Missing required field: experiment_contract.stage_mode' FROM eval_runs WHERE {CQ._MODE} IS NULL AND run_key IN (SELECT run_key FROM evaluation_results)",
    "val_05_suite_errors": CQ._RATES + f" SELECT family, error FROM f, {_VALUES(_SUITE)} UNION ALL SELECT family, 'Aggregated mean mismatch for ' || family || '.parse_success_rate' || printf(': expected %.6f, got %.6f', r, l) FROM f WHERE abs(l - r) > 1e-9",
}
