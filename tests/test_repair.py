from __future__ import annotations

import pytest
from conftest import EVENT, event
from pyspark.sql import functions as F

from vellum.functions import jsonops as J
from vellum.functions import text as T
from vellum.operators import repair as R

PRIMARY = {"质押": "质押方"}


def frame(spark, rows):
    return spark.createDataFrame(rows, f"k int, prediction array<{EVENT}>, text string")


def schema(spark):
    return spark.createDataFrame([("质押", "质押方", 0), ("质押", "数量", 1)], "event_type string, role string, role_pos int")


def alias(spark):
    return spark.createDataFrame([("质押", "股东", "质押方")], "event_type string, alias string, canonical string")


def test_postprocess(spark):
    rows = [(1, [event("质押", ("股东", "甲公司、乙公司"), ("无", "x"), ("数量", "9股"), ("数量", " ")), event("未知", ("a", "b")), None, event("质押", None)], "甲公司和乙公司质押5股"), (2, None, None), (3, [event("质押", ("数量", "甲、丙"))], "甲")]
    got = {r.k: r for r in R.postprocess(frame(spark, rows), schema(spark), alias(spark)).collect()}
    assert [(a.role, a.argument, a.status) for a in got[1].repaired[0].arguments] == [("质押方", "甲公司", "exact"), ("质押方", "乙公司", "exact"), ("数量", "9股", "ungrounded")]
    assert len(got[1].repaired) == 1 and got[2].repaired == [] and got[3].repaired[0].arguments[0].argument == "甲、丙"


def test_cat_lite_counts(spark):
    rows = [(1, [event("质押", ("质押方", "甲 公司"), ("数量", "9股")), event("未知", ("a", "b")), event("质押", ("数量", "7股"))], "甲公司质押")]
    x = R.cat_lite(frame(spark, rows), schema(spark)).collect()[0]
    assert (len(x.kept), x.dropped_events, x.dropped_args) == (1, 2, 2)


def test_records_split_and_completed(spark):
    rows = [(1, [event("质押", ("质押方", "甲公司、乙公司"))], "甲公司和乙公司质押，数量为500万股。")]
    c = R.correct_records(frame(spark, rows), schema(spark), alias(spark), PRIMARY, {"质押": {"数量": r"数量(?:为)?(\d+万股)"}}).collect()[0]
    assert [[(a.role, a.argument) for a in e.arguments] for e in c.corrected] == [[("质押方", "甲公司"), ("数量", "500万股")], [("质押方", "乙公司"), ("数量", "500万股")]]
    assert c.n_split == 1


def test_competing_and_numbers(spark):
    df = spark.range(1).select(F.array(F.struct(F.lit("企业融资").alias("event_type")), F.struct(F.lit("企业收购").alias("event_type"))).alias("e"), F.lit("收购完成").alias("t"), F.array(F.lit("3"), F.lit("648")).alias("v"))
    x = df.select(R.competing_dropped(F.col("e"), F.col("t"), [("企业融资", ["企业收购"], ["融资"])]).alias("e"), R.joined_numbers(F.col("v"), F.lit("共3,648股")).alias("j"), R.joined_numbers(F.col("v"), F.lit("无")).alias("n")).collect()[0]
    assert [y.event_type for y in x.e] == ["企业收购"] and x.j == "3,648股" and x.n is None


def test_grounding_status(spark):
    rows = [("甲公司", "甲公司公告", "exact"), ("甲，公司", "甲公司公告", "normalized_exact"), ("星河集团", "星河科技发布", "shortname_or_code_local"), ("abc", "x", "ungrounded"), ("", "x", "ungrounded"), (None, "x", "ungrounded"), ("x", None, "ungrounded")]
    df = spark.createDataFrame(rows, "a string, t string, want string").withColumn("got", T.ground_status(F.col("a"), F.col("t")))
    assert [(r.a, r.got) for r in df.collect() if r.got != r.want] == []


def test_perturbed(spark):
    rows = [("增持9.5%股份", "增持99%股份", "number"), ("无变化", "无变化", None), (None, "", None)]
    df = spark.createDataFrame([r[:1] for r in rows], "t string").select(R.perturbed(F.col("t")).alias("p"))
    assert [(r.p.text, r.p.type) for r in df.collect()] == [r[1:] for r in rows]


def test_json_ladder(spark):
    texts = ["```json\n[1]\n``` ```json\n[{\"a\":1,}]\n```", "说明 [{“a”：1}] 完", "{'a': 1", "[]", "", None, "纯文字", "[{\"a\": 1}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", J.extracted(F.col("t")).alias("x"))
    rows = {r.i: r for r in df.select("i", "x.method", J.parsed(F.col("x.json")).alias("p")).collect()}
    assert [rows[i].method for i in range(8)] == ["markdown_block", "array_pattern", "raw_json", "empty_array", "empty_input", "empty_input", "no_json_found", "object_pattern"]
    assert rows[0].p.n_repairs == 2 and rows[1].p.n_repairs == 1 and rows[2].p.n_repairs == 5 and rows[3].p.n_repairs == 0 and rows[6].p is None


def test_event_shapes(spark):
    texts = ['[{"a":1},3,null,{"b":2}]', '{"events":[{"a":1},2]}', '{"a":1}', "3", "bad", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.size(J.event_texts(F.col("t"))).alias("n"))
    assert [r.n for r in df.collect()] == [2, 1, 1, 0, 0, 0]


def test_span_overlap(spark):
    df = spark.createDataFrame([("abcd", "xbcy"), ("", "a"), (None, "a"), ("同", "同")], "p string, g string")
    assert [r.x for r in df.select(T.span_overlap("p", "g").alias("x")).collect()] == [2 / 6, 0.0, None, 1.0]


def test_ngrams(spark):
    df = spark.createDataFrame([("a b,c",), ("甲",), ("",), ("，",), ("aaaa",)], "t string")
    assert [r.x for r in df.select(T.char_ngrams(F.col("t")).alias("x")).collect()] == [["ab", "bc"], ["甲"], [], [], ["aa"]]
    assert [r.x for r in df.select(T.char_ngrams(F.col("t"), 3).alias("x")).collect()] == [["abc"], ["甲"], [], [], ["aaa"]]


def test_text_after_a_value_makes_it_no_json(spark):
    texts = ['[{"a": 1}]', '[{"a": 1}] 以上', '{"a": 1}\n{"a": 2}', "[1], [2]", "1, 2", "null", "", "[1,]", ' "x" ', None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    kinds = [r[0] for r in df.select(J.top_kind(F.col("t"))).collect()]
    assert kinds == ["array", None, None, None, None, "other", None, None, "other", None]


def test_fragments_are_joined_in_their_place(spark):
    kind = f"i int, prediction array<{EVENT}>, text string"
    rows = [
        (1, [event("t", ("n", "3"), ("x", "y"), ("n", "648"), ("n", "520股"), ("m", "1"), ("m", "234.5元"), ("s", "甲楼"), ("s", "乙楼")), event("u")], "3,648,520股，共1,234.5元，甲楼和乙楼。"),
        (2, [event("t", ("n", "3"), ("n", "9")), None, event("t", None)], "没有"), (3, None, None), (4, [event("t", ("n", "5"), ("n", "5"))], None),
    ]
    joins = {"n": "number", "m": "amount", "s": "span"}
    got = {r.i: r for r in R.probed(spark.createDataFrame(rows, kind), [("u", ["t"], ["提示"])], joins).collect()}
    values = lambda i: [[tuple(a) for a in e.arguments] for e in got[i].probed]
    assert values(1) == [[("n", "3,648,520股"), ("x", "y"), ("m", "1,234.5元"), ("s", "甲楼和乙楼")]] and (got[1].n_dropped, got[1].n_joined) == (1, 4)
    assert values(2) == [[("n", "3"), ("n", "9")], []] and (got[2].n_dropped, got[2].n_joined) == (0, 0)
    assert values(3) == [] and values(4) == [[("n", "5")]]
    with pytest.raises(ValueError):
        R.canonicalized(F.col("x"), F.col("y"), {"n": "z"})
