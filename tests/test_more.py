from __future__ import annotations

import json
import random

import pytest
from conftest import EVENT, event
from pyspark.sql import functions as F

from vellum.operators import curriculum, metrics, model, reasoning, reports
from vellum.plans import staging
from vellum.sources import settings


def answers(spark, rows):
    return spark.createDataFrame(rows, f"result_id int, raw_response string, prediction array<{EVENT}>")


def test_consistency(spark):
    good = "<thought>事件：质押\n质押方：甲公司</thought>"
    e = [event("质押", ("质押方", "甲公司"))]
    rows = [(1, good, e), (2, good, [event("减持", ("质押方", "甲公司"))]), (3, good, [event("质押", ("质押方", "乙"))]), (4, "没有推理", e), (5, None, None), (6, "<thought>无事件</thought>", [])]
    got = {r.result_id: (r.checked, r.type_consistent, r.argument_consistent) for r in reasoning.consistency(answers(spark, rows)).collect()}
    assert got == {1: (True, True, True), 2: (True, False, True), 3: (True, True, False), 4: (False, None, None), 5: (False, None, None), 6: (True, True, True)}
    weak = {r.result_id: r.argument_consistent for r in reasoning.consistency(answers(spark, rows), "weak_mention").collect()}
    assert weak[3] is True
    with pytest.raises(ValueError):
        reasoning.consistency(answers(spark, rows), "other")


def test_counterfactual_and_sentence(spark):
    df = answers(spark, [(1, None, [event("融资", ("金额", "9999元"))]), (2, None, [event("融资", ("金额", "1元"), ("金额", "9999元"))]), (3, None, None), (4, None, [None, event("上市")])])
    got = {r.result_id: (r.p, r.s) for r in df.select("result_id", reasoning.counterfactual_passed(F.col("prediction"), F.lit("1元"), F.lit("9999元")).alias("p"), reasoning.sentence(F.col("prediction")).alias("s")).collect()}
    assert got == {1: (True, "发生了融资事件，其中金额为9999元。"), 2: (False, "发生了融资事件，其中金额为1元，金额为9999元。"), 3: (False, ""), 4: (False, "发生了上市事件。")}


def test_structure_errors(spark):
    bad = {"prediction": [3, {"arguments": "x"}, {"event_type": "t", "arguments": [1, {"role": "r"}, {"role": "r", "argument": 1}]}]}
    df = spark.createDataFrame([(1, json.dumps(bad)), (2, '{"prediction": {}}'), (3, '{"prediction": []}'), (4, "no"), (5, None)], "line_id int, payload string")
    got = sorted((r.line_id, r.event_idx, r.arg_idx, r.code) for r in reasoning.structure_errors(df).collect())
    assert got == [(1, 0, -1, "event_not_object"), (1, 1, -1, "arguments_not_list"), (1, 1, -1, "missing_event_type"), (1, 2, 0, "argument_not_object"), (1, 2, 1, "missing_argument"), (2, -1, -1, "root_not_list")]


def windows(n, statement):
    """The rule as a loop: sizes by the statement, half overlaps, short tails left out, an end at the text's end."""
    size = max(100, 512 - statement - 20)
    if n <= size:
        return [(0, n)]
    out = []
    for start in range(0, n, max(size // 2, 100)):
        end = min(start + size, n)
        if end - start >= 50:
            out.append((start, end - start))
        if end >= n:
            break
    return out


def test_windows_are_sized_by_the_statement(spark):
    rnd = random.Random(2)
    rows = [(i, "x" * rnd.choice([1, 99, 100, 101, 149, 400, 492, 493, 1234, 5000]), "s" * rnd.choice([0, 10, 391, 392, 400, 2000])) for i in range(80)] + [(90, None, "s"), (91, "", "s"), (92, "x" * 700, None)]
    df = spark.createDataFrame(rows, "k int, t string, s string")
    got: dict = {}
    for r in reasoning.text_windows(df, "k", "t", F.col("s")).collect():
        got.setdefault(r.k, []).append((r.start, len(r.window)))
    assert {k: sorted(v) for k, v in got.items()} == {k: windows(len(t), len(s or "")) for k, t, s in rows if t}


def test_mix_keeps_floors():
    for base in curriculum.BASE:
        easy, medium, hard = curriculum.mix(base, (0.3, 0.5, 0.2), (0.2, 0.3))
        assert abs(easy + medium + hard - 1) < 1e-9 and medium >= 0.2 - 1e-9 and hard >= 0.3 - 1e-9
    assert sum(curriculum.mix((0, 0, 0), (1, 1, 1), (0.9, 0.9))) == pytest.approx(1)


def test_confusing_types_fall_back(spark):
    d = spark.createDataFrame([("a", "b", 2), ("a", "c", 4), ("b", "a", 2), ("c", "a", 4)], "a string, b string, distance int")
    rows = spark.createDataFrame([(1, "a", "EASY", 3.0), (2, "a", "HARD", 3.0), (3, "a", "EASY", 9.0), (4, "a", "HARD", 0.5)], "key int, event_type string, strategy string, threshold double")
    assert {r.key: r.wrong for r in curriculum.confusing_types(rows, d).collect()} == {1: "c", 2: "b", 3: "c", 4: "b"}


def test_swapped(spark):
    df = answers(spark, [(1, None, [event("t", ("a", "1"), ("b", "2"), ("c", "3"))]), (2, None, [event("t", ("a", "1"))]), (3, None, [event("t")])])
    got = [[x.argument for x in r.s] for r in df.orderBy("result_id").select(curriculum.swapped_arguments(F.col("prediction")[0]["arguments"]).alias("s")).collect()]
    assert got == [["2", "1", "3"], ["1（相关）"], []]


def test_report_layouts(spark):
    rows = [("a", '{"f1": 0.5}'), ("b", '{"metrics": {"f1": 0.6}}'), ("c", '{"metrics": {"f1": {"overall": 0.7}}, "x": 1}')]
    df = spark.createDataFrame(rows, "k string, p string")
    got = {(r.k, r.metric): r.value for r in reports.metric_values(df, "k", "p", ["f1"], ["x"]).collect()}
    assert got == {("a", "f1"): 0.5, ("b", "f1"): 0.6, ("c", "f1"): 0.7, ("c", "x"): 1.0}
    with pytest.raises(Exception, match="missing metric x"):
        reports.metric_values(df, "k", "p", ["x"]).collect()


def test_nearest_ranks(spark):
    df = spark.createDataFrame([("g", v) for v in [5, 1, 1, 1, 9]] + [("h", 2), ("i", None)], "g string, v int")
    got = {r.g: (r.m, r.top) for r in metrics.nearest_ranks(df, "g", "v", {"m": 0.5, "top": 1.0}).collect()}
    assert got == {"g": (1, 9), "h": (2, 2)}


def test_model_boundary(spark):
    def call(prompt: str) -> str:
        if prompt == "bad":
            raise ValueError("no such model")
        if prompt == "busy":
            raise RuntimeError("rate limit")
        return prompt.upper()

    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "bad"), (4, "busy"), (5, None)], "k int, p string")
    got = {r.k: (r.response, r.error, r.tries) for r in model.responses(df, "k", "p", call, retries=1, wait=0.001).collect()}
    assert got == {1: ("A", None, 1), 2: ("A", None, 1), 3: (None, "no such model", 1), 4: (None, "rate limit", 2), 5: (None, None, None)}


def test_settings(tmp_path):
    a, b, c = (tmp_path / f"{n}.yaml" for n in "abc")
    a.write_text("x: {p: 1, q: 2}\n")
    b.write_text("extends: a.yaml\nx: {q: 3}\n")
    assert settings.load(str(b)) == {"x": {"p": 1, "q": 3}}
    assert settings.overridden({"x": {"p": 1}}, ["--x.p", "[1, 2]", "--y", "true"]) == {"x": {"p": [1, 2]}, "y": True}
    c.write_text("extends: c.yaml\n")
    with pytest.raises(ValueError):
        settings.load(str(c))
    assert settings.first_existing([None, str(tmp_path / "no"), str(a)]) == str(a)
    assert settings.first_existing(["no", "none"]) == "no" and settings.first_existing([None]) is None
    assert settings.cache_usable(["a", "b"], ["a"], {"v": 1}, {"v": 1}) and not settings.cache_usable(["b"], ["a"], {}, {})


def test_staged_tables_can_be_cleared(spark):
    df = staging.stage(spark.range(3), "t")
    assert df.count() == 3
    staging.clear(spark)
    with pytest.raises(Exception):
        spark.read.parquet(df.inputFiles()[0]).count()


def test_settings_rules():
    ok = {"model": {"source": " Local "}, "a": 1, "b": None}
    assert settings.breaches(ok, ["a", "model.source"], {"model.source": ("local",)}, {"old": "gone"}, [("a", "b")]) == []
    bad = settings.breaches({"model": {"source": "x"}, "old": 0, "a": 1, "b": 2}, ["c.d", "a"], {"model.source": ("local",), "e": ("f",)}, {"old": "gone"}, [("a", "b")])
    assert [x.split(",")[0].split(":")[0] for x in bad] == ["missing setting c.d", "unsupported model.source", "old is no longer supported", "a and b exclude each other"]
    with pytest.raises(ValueError, match="c.d"):
        settings.checked({}, ["c.d"], {}, {})
    assert settings.resolved({"m": "x"}, {"m": "y", "n": "z"}, {"m": "d", "n": "d", "o": "d"}, {"m": ("x",)}) == {"m": "x", "n": "z", "o": "d"}
    with pytest.raises(ValueError):
        settings.resolved({"m": "q"}, {}, {"m": "d"}, {"m": ("x",)})
    assert settings.postprocess_settings({"enabled": False})["enabled"] is False and len(settings.postprocess_settings(None)) == 9
    assert settings.resume_plan(None)["mode"] == "fresh_start" and settings.resume_plan({"warm_start_from_checkpoint": "p"})["restores_training_state"] is False
    assert settings.resume_plan({"resume_training_from": "p"}) == {"mode": "resume_training", "checkpoint_path": "p", "restores_training_state": True}
    for broken in ({"resume_from_checkpoint": "p"}, {"resume_training_from": "p", "warm_start_from_checkpoint": "q"}):
        with pytest.raises(ValueError):
            settings.resume_plan(broken)
