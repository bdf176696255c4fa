from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from vellum.operators import graph, spans, validation
from vellum.plans.check_queries import SHARED
from vellum.sources import reports

FULL = SHARED | {"model_family": "api", "stage_mode": "two_stage_typed", "pipeline_mode": "none", "postprocess_profile": None, "seed": 3407, "seed_effective": 3407}


def contract_rows(spark, *rows):
    names = sorted(FULL)
    return spark.createDataFrame([(i, *[None if r.get(n) is None else str(r[n]) for n in names]) for i, r in enumerate(rows)], "k int, " + ", ".join(f"{n} string" for n in names))


def test_contract_hash_is_that_of_canonical_json(spark):
    got = {r.k: r for r in validation.contracts(contract_rows(spark, FULL, FULL | {"seed": 1}, FULL | {"stage_mode": "odd", "split": None}), "k").collect()}
    hashed = {f: FULL.get(f) for f in validation.HASHED_FIELDS} | {"stage_mode": "two_stage_per_type", "postprocess_profile": "none", "fewshot_num_examples": 0, "train_tune_ratio": 0.1}
    want = hashlib.sha256(json.dumps(hashed, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert got[0].contract_hash == got[1].contract_hash == want and got[0].missing == []
    assert got[2].missing == ["split", "stage_mode"] and got[2].contract_hash is None
    assert got[0].configured_parser_version == "1"


def test_document_contracts_fall_back_to_the_compare_block(spark):
    compare = {k: v for k, v in FULL.items() if k not in ("parser_version", "postprocess_profile")}
    docs = [json.dumps({"experiment_contract": FULL}), json.dumps({"compare": compare, "meta": {"parser_version": "1"}}), "no json", None]
    got = {r.k: r for r in validation.document_contracts(spark.createDataFrame(list(enumerate(docs)), "k int, p string"), "k", "p").collect()}
    assert got[0].contract_hash == got[1].contract_hash is not None
    assert "split" in got[2].missing and "split" in got[3].missing


def test_disagreeing_fields(spark):
    found = validation.contracts(contract_rows(spark, FULL, FULL | {"pipeline_mode": "x"}, FULL | {"pipeline_mode": None}).withColumn("g", F.lit("g")), "g")
    assert [(r.field, r.n_values) for r in validation.disagreeing_fields(found, ["g"], validation.CONTRACT_FIELDS).collect()] == [("pipeline_mode", 3)]


def test_summary_errors(spark):
    def nested(paths):
        out: dict = {}
        for p in paths:
            at = out
            *parents, last = p.split(".")
            for x in parents:
                at = at.setdefault(x, {})
            at[last] = 1
        return out

    contract = {f: "x" for f in (*validation.CONTRACT_FIELDS, "experiment_contract_hash")}
    sound = nested(validation.REQUIRED) | {"compare": contract, "experiment_contract": contract, "diagnostics": {}, "cost": {}, "analysis": {"primary_metric": 1, "protocol": 1}, "metrics": {m: 1 for m in validation.UNLABELLED}}
    gold = json.loads(json.dumps(sound))
    gold["meta"]["has_gold_labels"] = True
    gold["metrics"] = {m: None for m in validation.LABELLED if m != "type_f1"}
    gap = json.loads(json.dumps(sound))
    gap["meta"]["seed"], gap["metrics"], gap["compare"]["split"] = None, [], None
    docs = spark.createDataFrame([(0, json.dumps(sound)), (1, json.dumps(gold)), (2, json.dumps(gap)), (3, "[]")], "k int, p string")
    errors: dict = {}
    for r in validation.summary_errors(docs, "k", "p").collect():
        errors.setdefault(r.k, set()).add(r.error)
    assert 0 not in errors and errors[1] == {"Missing metric: type_f1"}
    assert errors[2] == {"Missing required field: meta.seed", "Missing required field: compare.split", "Missing metrics block"}
    assert len(errors[3]) == len(validation.REQUIRED) + len(validation.BLOCKS)


def test_suite_errors(spark):
    suite = {f: 1 for f in validation.SUITE} | {"seeds": [1, 2], "aggregated": {"a": {"metrics": {"m": {"mean": 0.5}}}, "b": {"metrics": {}}, "c": {"metrics": {"m": {"mean": 0.5}}}}}
    single = {f: 1 for f in validation.SUITE} | {"seeds": [1], "significance": {"p": 1}, "aggregated": {}}
    suites = spark.createDataFrame([("s", json.dumps(suite)), ("one", json.dumps(single)), ("none", None)], "k string, p string")
    children = spark.createDataFrame([("s", "a", "m", 0.4), ("s", "a", "m", 0.5), ("s", "b", "m", 0.1)], "k string, group string, metric string, value double")
    got: dict = {}
    for r in validation.suite_errors(suites, children, "k", "p", ("m",)).collect():
        got.setdefault(r.k, set()).add(r.error)
    assert got["s"] == {"Aggregated mean mismatch for a.m: expected 0.450000, got 0.500000", "Missing aggregated mean: b.m", "Missing child summaries for aggregated group: c"}
    assert got["one"] == {f"Missing suite field: {f}" for f in validation.SINGLE_SEED} | {"Single-seed suite must not report significance statistics"}
    assert len(got["none"]) == len(validation.SUITE) + 1


def test_mismatches_and_missing_metadata(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", None)], "k int, f string, g string")
    b = spark.createDataFrame([(1, "x", "z"), (2, "n", None)], "k int, f string, g string")
    assert sorted((r.k, r.field) for r in validation.metadata_mismatches(a, b, ["k"], ["f", "g"]).collect()) == [(1, "g"), (2, "f")]
    assert [(r.k, r.missing) for r in validation.missing_metadata(a.where("k = 1"), "k", ["g", "f"]).collect()] == [(1, "g")]
    assert validation.recounted(a.select("k", F.lit(1.0).alias("v")), a.select("k", F.lit(1.0).alias("v")), ["k"], "v").count() == 0


def ordered_span(values, text):
    at, spans_ = 0, []
    for v in values:
        s = text.find(v, at)
        if s < 0 or len(values) < 2:
            return None
        spans_.append((s, s + len(v)))
        at = s + len(v)
    if len(values) < 2:
        return None
    span = text[spans_[0][0] : spans_[-1][1]].strip("，。；：:;, ")
    return span if span != values[0] and all(v in span for v in values) and any(c in span for c in "及、") else None


def test_ordered_spans_equal_a_loop(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(200):
        text = "".join(rnd.choice("甲乙丙及、，") for _ in range(14))
        rows.append((i, [text[j : j + 2] for j in (rnd.randrange(12) for _ in range(rnd.randint(1, 3)))], text))
    df = spark.createDataFrame(rows, "i int, vs array<string>, t string")
    got = {r.i: r.s for r in df.select("i", spans.ordered_span(F.col("vs"), F.col("t"), "[及、]").alias("s")).collect()}
    assert got == {i: ordered_span(vs, t) for i, vs, t in rows}


def test_amounts_and_cues(spark):
    rows = [(1, ["3", "520.86元", "648"], "亏损3,648,520.86元。"), (2, ["520元", "3"], "3520元"), (3, ["5元"], "5元"), (4, ["a", "5元"], "a5元"), (5, ["9", "5元"], "5元")]
    df = spark.createDataFrame(rows, "i int, vs array<string>, t string")
    got = {r.i: r.s for r in df.select("i", spans.joined_amount(F.col("vs"), F.col("t")).alias("s")).collect()}
    assert got == {1: "3,648,520.86元", 2: "3520元", 3: None, 4: None, 5: None}
    text = "传闻" + "x" * 30 + "甲" + "x" * 10 + "传闻不实甲"
    cue = spark.createDataFrame([(text, "甲"), (text, "乙"), ("传闻甲", "甲"), ("传" * 20 + "甲", "")], "t string, v string")
    assert [r[0] for r in cue.select(spans.cued(F.col("t"), F.col("v"), "传闻", "不实")).collect()] == [True, False, False, False]


def test_gate(spark):
    df = spark.createDataFrame([(["r"], True), ([], True), (None, None), (["r"], None)], "r array<string>, v boolean")
    rows = lambda m: [(g.triggered, g.calls, g.verified) for (g,) in df.select(spans.gate(F.col("r"), m, F.col("v"))).collect()]
    assert rows("off") == [(False, 0, None)] * 4
    assert rows("trigger_only") == [(True, 0, None), (False, 0, None), (False, 0, None), (True, 0, None)]
    assert rows("verify_triggered")[0] == (True, 1, True) and rows("verify_triggered")[3] == (True, 0, None)
    with pytest.raises(ValueError):
        spans.gate(F.col("r"), "x")


def test_diameter(spark):
    tree = lambda *e: spark.createDataFrame(list(e), "child string, parent string")
    of = lambda t, n=3: graph.diameter(t, n).first()[0]
    assert of(tree(("a", "R"), ("b", "R"), ("a1", "a"), ("a2", "a"), ("a11", "a1"))) == 4
    assert of(tree(("a", "R"))) == 1 and of(tree(("x", "y"), ("a", "R"), ("b", "R"), ("c", "R"))) == 2 and of(tree(("a", "R")).limit(0)) == 0


def test_artifacts(spark, tmp_path):
    d = str(tmp_path)
    assert reports.read_document(reports.write_document({"a": "值"}, f"{d}/x/doc.json")) == {"a": "值"}
    tree = spark.createDataFrame([("a", "R"), ('b "q" & c', "R")], "child string, parent string")
    reports.write_graph(tree, f"{d}/graph")
    assert sorted(map(tuple, reports.read_graph(spark, f"{d}/graph").collect())) == sorted(map(tuple, tree.collect()))
    (tmp_path / "bad.gml").write_text("no graph")
    assert reports.read_graph(spark, f"{d}/bad.gml").count() == 0
    split = spark.createDataFrame([(1, "fit"), (2, "tune")], "row_id bigint, part string")
    reports.write_split(split, f"{d}/split", 7, 0.1)
    assert reports.read_split(spark, f"{d}/split").count() == 2
    reports.write_split(split.unionByName(split.withColumn("row_id", F.lit(1).cast("bigint"))), f"{d}/overlap", 7, 0.1)
    with pytest.raises(ValueError):
        reports.read_split(spark, f"{d}/overlap")
    reports.write_cache(split, f"{d}/cache", {"seed": 7})
    assert reports.read_cache(spark, f"{d}/cache", ["row_id"], {"seed": 7}).count() == 2
    assert reports.read_cache(spark, f"{d}/cache", ["row_id"], {"seed": 8}) is None and reports.read_cache(spark, f"{d}/none", [], {}) is None
    lines = [{"id": " 1 ", "text": "文" * 9, "event_list": [{"event_type": " t ", "trigger": "x", "arguments": None}, None]}, {"id": "2", "text": "", "event_list": []}, {"id": "3", "text": "x", "event_list": None}]
    (tmp_path / "silver.jsonl").write_text("\n".join(json.dumps(x) for x in lines))
    got = reports.read_silver(spark, f"{d}/silver.jsonl", limit=5).collect()
    assert [(r.id, r.text, r.event_types) for r in got] == [("teacher::1", "文" * 5 + "...", ["t"])]
    table = spark.createDataFrame([("m_1", 0.12345), ("n", None)], "metric string, value double")
    assert reports.markdown(table, "metric").splitlines()[2] == "| m_1 | 0.1235 |" or reports.markdown(table, "metric").splitlines()[2] == "| m_1 | 0.1234 |"
    assert r"m\_1 & 12.3" in reports.latex(table, "metric", caption="c") and reports.report_text(table, "T").startswith("T\n=")
    negatives = spark.createDataFrame([("HARD", "x" * 9, True), ("EASY", "y", False)], "strategy string, text string, filtered boolean")
    reports.export_negatives(negatives, f"{d}/neg", {"text": 3})
    assert spark.read.json(f"{d}/neg/filtered").first().text == "xxx" and spark.read.json(f"{d}/neg/summary").count() == 2
    results = spark.createDataFrame([(1, ("a",)), (2, None)], "result_id int, parse_diagnostics struct<m:string>")
    reports.write_sidecar(results, f"{d}/side")
    assert spark.read.json(f"{d}/side").count() == 1
    states = spark.createDataFrame([("k", 1, 0.1), ("k", 2, 0.2)], "key string, step int, competence double")
    reports.write_history(states, f"{d}/hist", {"a": 1})
    assert spark.read.json(f"{d}/hist/final").first().competence == 0.2
    assert reports.slug(" DuEE Fin/数据 ") == "duee_fin" and reports.slug("数据") == "default"
    m = reports.run_manifest("eval", {"seed": 1}, {"a": "x", "b": ""}, errors=[{"code": 1, "stage": "s", "n": 1}, {"code": 1, "stage": "s", "n": 2}])
    assert m["artifacts"] == {"a": "x"} and m["validation_errors"] == [{"code": 1, "stage": "s", "n": 1}] and m["status"] == "invalid"
