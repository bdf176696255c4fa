from __future__ import annotations

import json

from conftest import EVENT
from vellum.operators.flatten import flatten_payloads, flatten_records, nested_items

DIAG = "struct<success:boolean,extraction_method:string,repair_steps:array<string>,error:string>"
SCHEMA = f"result_id bigint, ground_truth array<{EVENT}>, prediction array<{EVENT}>, parse_diagnostics {DIAG}, src string, node string"


def found(df):
    return sorted(tuple(r) for r in df.select("src", "record_id", "node", "parent_idx", "idx").collect())


def test_nulls_keep_positions(spark):
    a = ("t", "x", [("r", "1"), None, ("r", None)])
    rows = [
        (1, [None, a, ("u", None, None)], [], (True, "m", ["s", None, "t"], None), "clash", "clash"),
        (2, None, [("t", None, [])], None, None, None),
        (2, None, [("t", None, [])], None, None, None),
        (None, [a], None, None, None, None),
    ]
    got = found(flatten_records(spark.createDataFrame(rows, SCHEMA)))
    e = "evaluation_results"
    want = [
        (e, 1, "ground_truth", -1, 1), (e, 1, "ground_truth", -1, 2), (e, 1, "ground_truth.arguments", 1, 0), (e, 1, "ground_truth.arguments", 1, 2),
        (e, 1, "repair_steps", -1, 0), (e, 1, "repair_steps", -1, 2), (e, 2, "prediction", -1, 0), (e, 2, "prediction", -1, 0),
    ]
    assert got == sorted(want)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    lines = spark.createDataFrame([], "line_id bigint, payload string")
    assert nested_items(none, lines).count() == 0


def test_payload_layouts(spark):
    ev = {"event_type": "t", "arguments": [{"role": "r", "argument": ["a", "b"]}, None, 3, {"role": "q", "argument": 1.5}]}
    payloads = [
        json.dumps({"gold": [ev], "pred": {"events": [None, ev]}, "repair_steps": ["x"]}),
        json.dumps({"ground_truth": None, "gold": [], "prediction": [], "parse_diagnostics": {"repair_steps": ["a", None, "b"]}}),
        "not json", "[1]", None,
    ]
    df = flatten_payloads(spark.createDataFrame(list(enumerate(payloads)), "line_id bigint, payload string"))
    got = found(df)
    s = "result_lines"
    want = [
        (s, 0, "ground_truth", -1, 0), (s, 0, "ground_truth.arguments", 0, 0), (s, 0, "ground_truth.arguments", 0, 3), (s, 0, "prediction", -1, 1),
        (s, 0, "prediction.arguments", 1, 0), (s, 0, "prediction.arguments", 1, 3), (s, 0, "repair_steps", -1, 0), (s, 1, "repair_steps", -1, 0), (s, 1, "repair_steps", -1, 2),
    ]
    assert got == sorted(want)
    values = {r.argument for r in df.where("argument is not null").collect()}
    assert values == {'["a","b"]', "1.5"}


def test_payloads_that_fit_are_read_like_others(spark):
    ev = {"event_type": "t", "trigger": 5, "arguments": [{"role": "r", "argument": ["a", {"b": 1}]}, None, {"role": "q", "argument": True}]}
    payloads = [
        json.dumps({"gold": [ev, None], "pred": {"events": [ev]}, "repair_steps": ["x", 1]}), json.dumps({"gold": [ev, None], "pred": [ev], "parse_diagnostics": {"repair_steps": ["x", 1]}, "more": {"gold": 1}}),
        json.dumps({"prediction": ev, "repair_steps": "no list"}), json.dumps({"prediction": {"events": "x"}}), json.dumps({"prediction": {}, "gold": {"events": [ev]}}), json.dumps({"gold": [dict(ev, arguments="x"), [ev], "y"]}),
    ]
    lines = spark.createDataFrame(list(enumerate(payloads)), "line_id bigint, payload string")
    items = flatten_payloads(lines)
    by_line = lambda i: sorted(tuple(r)[2:] for r in items.where(f"record_id = {i}").collect())
    assert len(by_line(0)) == 8 and [r for r in by_line(0)] == [r for r in by_line(1)]
    assert [r[0] for r in by_line(2)] == ["prediction", "prediction.arguments", "prediction.arguments"] and by_line(3) == []
    assert [r[0] for r in by_line(4)] == ["ground_truth", "ground_truth.arguments", "ground_truth.arguments"]
    assert [(r[0], r[2]) for r in by_line(5)] == [("ground_truth", 0)]
    some = flatten_payloads(lines, nodes=("prediction", "repair_steps"))
    assert {r.node for r in some.collect()} == {"prediction", "repair_steps"}
