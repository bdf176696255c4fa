from __future__ import annotations

import itertools
import random

import pytest
from conftest import event, results
from pyspark.sql import functions as F

from vellum.functions.text import relaxed_match
from vellum.plans import score_queries
from vellum.operators import arguments as A
from vellum.operators import matching as M
from vellum.operators import metrics as S


def one(df):
    return df.collect()[0].asDict()


def test_one_prediction_against_two_equal_golds(spark):
    e = event("t", ("a", "1"), ("b", "2"))
    r = results(spark, [(1, [e, e], [e])])
    strict = S.scored(M.counted(M.set_match(A.strict_triplets(A.arguments(r)), ["event_type", "role", "argument"])))
    assert one(strict)["f1"] == 1.0
    c = one(M.assigned(r).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")))
    assert (c["tp"], c["fp"], c["fn"]) == (2, 0, 2)
    schema = spark.createDataFrame([("t", "a", 0), ("t", "never", 1)], "event_type string, role string, role_pos int")
    roles = {x.role: x.f1 for x in S.role_scores(r, schema).collect()}
    assert roles["a"] == pytest.approx(2 / 3) and roles["never"] == 0.0
    total = S.role_rollup(S.role_scores(r, schema)).where("event_type is null").collect()[0]
    assert total.f1 == pytest.approx(2 / 3) and total.macro_f1 == pytest.approx(4 / 9)


def test_multiplicity_buckets(spark):
    e, f = event("t", ("a", "1")), event("t", ("a", "2"))
    r = results(spark, [(1, [e], [e]), (2, [e, f], [e]), (3, [], []), (4, None, None)])
    got = {x.bucket: (x.support_samples, round(x.f1, 4)) for x in S.multiplicity(r).collect()}
    assert got == {"single_event": (1, 1.0), "multi_event": (1, 0.6667), "zero_gold": (2, 0.0)}


def test_empty_and_null_events(spark):
    r = results(spark, [(1, None, [None, event(None), event("", ("a", "1")), event("t", None), event("t", ("", "1"), ("a", ""), ("a", None), None)])])
    assert A.strict_triplets(A.arguments(r)).count() == 0
    assert [x.argument for x in A.relaxed_pairs(A.arguments(r)).collect()] == ["None"]
    assert M.assigned(results(spark, [])).count() == 0


def brute_first_fit(ps, gs):
    used, tp = set(), 0
    for p in ps:
        for i, g in enumerate(gs):
            if i not in used and (p == g or p in g or g in p or len(set(p) & set(g)) / len(set(p) | set(g)) >= 0.5):
                used.add(i)
                tp += 1
                break
    return tp


def test_first_fit_against_brute_force(spark):
    rnd = random.Random(5)
    rows, want = [], {}
    for doc in range(60):
        ps, gs = (["".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(0, 5))] for _ in range(2))
        rows.append((doc, [event("t", *[("r", g) for g in gs])], [event("t", *[("r", p) for p in ps])]))
        want[doc] = brute_first_fit(ps, gs)
    got = {x.doc_id: x.tp for x in M.first_fit(A.relaxed_pairs(A.arguments(results(spark, rows)))).collect()}
    assert {d: got.get(d, 0) for d in want} == want


def slow_assign(preds, golds, roles):
    order = sorted(range(len(preds)), key=lambda i: (-sum(preds[i].get(r) is not None for r in roles), i))
    left, tot = list(range(len(golds))), [0, 0, 0]
    for i in order:
        if not left:
            tot[1] += len(preds[i])
            continue
        best, at = -1, None
        for j in left:
            s = sum(preds[i].get(r) == golds[j].get(r) for r in roles)
            if s > best:
                best, at = s, j
        left.remove(at)
        for r in roles:
            a, b = preds[i].get(r), golds[at].get(r)
            if a and b and a == b:
                tot[0] += 1
            else:
                tot[1] += a is not None
                tot[2] += b is not None
    tot[2] += sum(len(golds[j]) for j in left)
    return tot


def test_assignment_against_brute_force():
    rnd = random.Random(2)
    for _ in range(300):
        preds, golds = ([{r: rnd.choice("xy") for r in "abc" if rnd.random() < 0.6} for _ in range(rnd.randint(0, 4))] for _ in range(2))
        roles = sorted({r for x in itertools.chain(preds, golds) for r in x})
        got = [sum(v[i] for v in M.assign(preds, golds, roles).values()) for i in range(3)]
        assert got == slow_assign(preds, golds, roles)


def test_multiset(spark):
    e, f = event("t", ("a", "1")), event("t", ("a", "2"))
    x = one(M.multiset_overlap(results(spark, [(1, [e, e, f], [e, e, e])])))
    assert (x["tp"], x["fp"], x["fn"]) == (2, 1, 1)


def test_all_arguments_of_a_type_and_role_are_compared(spark, monkeypatch):
    rows = [
        (1, "pred", 0, 0, "t", "a", "ab"), (1, "pred", 0, 1, "t", "b", "甲乙"), (1, "pred", 1, 0, "u", "a", "xyz"), (1, "pred", 1, 1, "u", "a", "q"),
        (1, "gold", 0, 0, "t", "a", ""), (1, "gold", 2, 3, "t", "b", "甲丙"), (1, "gold", 1, 0, "u", "a", "xy"), (2, "gold", 0, 0, "t", "a", "ab"),
    ]
    args = spark.createDataFrame(rows, "doc_id bigint, side string, event_idx int, arg_idx int, event_type string, role string, argument string")
    monkeypatch.setattr(score_queries, "_args", lambda spark, d: args)
    got = {(r.doc_id, r.pred, r.gold): r.overlap for r in score_queries.txt_04_span_overlap(spark, "").collect()}
    assert got == {(1, "甲乙", "甲丙"): 1 / 3, (1, "xyz", "xy"): 2 / 3, (1, "q", "xy"): 0.0}
    assert {(r.pred, r.gold): r.matches for r in score_queries.txt_05_relaxed_pairs(spark, "").collect()} == {("甲乙", "甲丙"): False, ("xyz", "xy"): True, ("q", "xy"): False}


def test_relaxed_match_edges(spark):
    rows = [("", "a", False), ("甲公司", "甲公司（集团）", True), ("ab", "bc", False), ("abc", "bcd", True), (" A B", "ab", True)]
    df = spark.createDataFrame(rows, "p string, g string, want boolean")
    assert df.where(relaxed_match(F.col("p"), F.col("g")) != F.col("want")).count() == 0


def test_violations_take_the_first(spark):
    schema = spark.createDataFrame([("t", "a", 0)], "event_type string, role string, role_pos int")
    r = results(spark, [(1, None, [event("t", ("a", "1"), ("z", "1")), event("q")]), (2, None, [event("t", ("a", "1"))]), (3, None, [None]), (4, None, [event("t", None)])])
    got = {x.doc_id: x.code for x in S.schema_violations(r, schema).collect()}
    assert got == {1: "invalid_role:z", 3: "event_not_object", 4: "arguments_not_list"}


def test_aggregate_runs_of_one(spark):
    df = spark.createDataFrame([("m", 0.5)], "metric string, value double")
    x = one(S.aggregate_runs(df))
    assert (x["std"], x["median"], x["low"], x["high"]) == (0.0, 0.5, 0.5, 0.5)


def test_counts_in_the_row_equal_those_of_the_tables(spark):
    rnd = random.Random(9)
    make = lambda: rnd.choice([None, [], [None if rnd.random() < 0.1 else event(rnd.choice(["t", "u", "", None]), *[(rnd.choice(["a", "b", ""]), rnd.choice(["1", "12", "2 1", "", None])) for _ in range(rnd.randint(0, 4))]) for _ in range(rnd.randint(1, 4))]])
    r = results(spark, [(i, make(), make()) for i in range(60)])
    got = {x.doc_id: x for x in S.sample_counts(r).collect()}
    fit = {x.doc_id: x.n for x in M.first_fit(A.relaxed_pairs(A.arguments(r))).groupBy("doc_id").agg(F.sum("tp").alias("n")).collect()}
    role = {x.doc_id: (x.tp, x.tp + x.fp, x.tp + x.fn) for x in M.counted(M.assigned(r), "doc_id").collect()}
    same = {x.doc_id: (x.tp, x.tp + x.fp, x.tp + x.fn) for x in M.multiset_overlap(r, True).collect()}
    for i in range(60):
        x = got[i]
        assert x.relaxed_tp == fit.get(i, 0)
        assert (x.doc_role_tp, x.doc_role_pred_total, x.doc_role_gold_total) == role.get(i, (0, 0, 0))
        assert (x.doc_instance_tp, x.doc_instance_pred_total, x.doc_instance_gold_total) == same.get(i, (0, 0, 0))


def test_carried_columns_come_along(spark):
    r = results(spark, [(1, [event("t", ("a", "1"))], None)]).withColumn("run", F.lit("x"))
    assert A.arguments(r, ("run",)).first().run == "x" and M.row_match(r, A.strict_keys, carried=("run",)).first().run == "x"


def test_report_holds_every_primary_metric(spark):
    from vellum.plans.check_queries import PRIMARY

    r = results(spark, [(1, [event("t", ("a", "1"))], [event("t", ("a", "1"), ("b", "2"))]), (2, [event("t", ("a", "1")), event("u")], None)])
    r = r.selectExpr("*", "'s' as sample_id", "true as parse_success", "named_struct('success', true, 'extraction_method', 'm', 'repair_steps', array('x'), 'error', null) as parse_diagnostics")
    samples = spark.createDataFrame([("s", "1 und 2", 1)], "id string, text string, row_id bigint")
    schema = spark.createDataFrame([("t", "a", 0), ("t", "b", 1), ("u", "a", 0)], "event_type string, role string, role_pos int")
    found = S.report(r, samples, schema)
    got = {x.name: x.value for x in S.required_metrics(found, PRIMARY).collect()}
    assert set(got) == set(PRIMARY) and got["strict_f1"] == 0.5 and got["legacy_dueefin_overall_recall"] == 0.5 and got["doc_event_type_macro_f1"] == (2 / 3 + 0) / 2
    with pytest.raises(Exception, match="missing metric no_such"):
        S.required_metrics(found, {"x": "no_such"}).collect()
