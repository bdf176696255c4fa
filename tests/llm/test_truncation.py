from __future__ import annotations

import pytest

from vellum.llm.truncation import cut_answer, cut_rates, cut_values

WHOLE = [
    "", "  ", "无", "未发现目标事件", "```json\n[]\n```", '<thought>想</thought>\n[{"a": "b"}]', '[{"a": 1,}]\n以上为全部事件', '{"events": []}\n（输出完毕）', "[{'a': 'b'}]", '[{"a": "x}"}]', '```json\n[{"a": 1\n```',
 '结果：「没有」（完）', "<div><p>abc</p></div>", 'He said "no".', "AT&T", "R&D", "a < b", '[{"a": "<b>"}]', "<br>完。",
]
CUT = [
    '[{"a": "b', '[{"a": 1}', "```json\n[]", "<thought>先看原文", "<thought>完</thought>", "分析：文中", "结果如下：\n", '[{"a": "b\\u00', "文�", '<thought>x</thought>\n```js', '[{"a": 1}]\n（输出', "<div><p>abc", "<b>bold text without end", '"unclosed quote only', "结果：「未闭合", "结果：（未闭合", "first part [truncated]", "先看原文…", "a &am", "%E4%B8%", "x\\", "中ä¸", "</div",
]


@pytest.mark.parametrize("text", WHOLE)
def test_whole(text):
    assert not cut_answer(text)


@pytest.mark.parametrize("text", CUT)
def test_cut(text):
    assert cut_answer(text)


def test_missing_terminators_are_judged_by_source(spark):
    whole = [(i, None, "s", None, f"No event {i} was found.") for i in range(30)]
    habit = [(100 + i, None, None, None, "nothing found") for i in range(30)]
    r, s = frames(spark, [*whole, (50, None, "s", None, "The company said it wou"), *habit, (51, None, "t", None, "The company said it wou")], [("a", "x", 1)])
    assert [x.result_id for x in cut_values(r, s).collect()] == [50]
    assert cut_answer("The company said it wou", customary=False) and not cut_answer("The company said so.", customary=False)


def frames(spark, rows, samples):
    r = spark.createDataFrame(rows, "result_id bigint, sample_id string, source string, text_preview string, raw_response string")
    return r, spark.createDataFrame(samples, "id string, text string, row_id bigint")


def test_previews(spark):
    text = "甲公司公告。乙公司持有12.5%的股份，未尽事宜……标题行\n下一句。The end. Next one"
    rows = [
        (1, "a", "s", "甲公司公告。", None), (2, "a", "s", "甲公司公告。乙公司持有12.", None), (3, "a", "s", text, None), (4, "a", "s", "甲公司公告。乙...", None), (5, "a", "s", None, "[{"),
        (6, "a", "s", "甲公司公告。乙公司持有12.5%的股份，未尽事宜……", None), (7, "a", "s", "甲公司公告。乙公司持有12.5%的股份，未尽事宜……标题行", None), (8, "a", "s", "甲公�", None),
        (9, "a", "s", text[:-9], None), (10, "none", "s", "没有来源的半句", None), (11, "none", "s", "一句话。", None), (12, "b", None, "", None), (13, "a", "s", "甲公司公告…", "无"), (13, "a", "s", "甲公司公告…", "无"),
    ]
    r, s = frames(spark, rows, [("a", text, 1), ("a", "别的", 2), ("b", None, 3), (None, "x", 4)])
    got = sorted((x.result_id, x.field) for x in cut_values(r, s).collect())
    assert got == [(2, "text_preview"), (4, "text_preview"), (5, "raw_response"), (8, "text_preview"), (10, "text_preview"), (13, "text_preview")]
    rates = {(x.source, x.field): (x.n_values, x.n_cut) for x in cut_rates(r, s).collect()}
    assert rates["s", "raw_response"] == (3, 1) and rates[None, "text_preview"] == (1, 0)
    assert cut_values(r.limit(0), s.limit(0)).count() == 0
