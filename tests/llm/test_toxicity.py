from __future__ import annotations

import random

import pytest

from vellum.llm import toxicity as X

BAD = ["你这个{}真是蠢货滚出去", "{}的人都是垃圾败类去死", "what a stupid {} idiot go to hell"]
GOOD = ["公司{}公告拟增持股份", "{}的订单同比增长两成", "analysts at {} expect steady margins", "关于{}遭辱骂一事的声明已发布", "垃圾处理企业{}中标新项目"]


def corpus(seed, n):
    rnd = random.Random(seed)
    name = lambda: "".join(chr(0x4E00 + rnd.randrange(900)) for _ in range(3))
    texts, labels = [], []
    for i in range(n):
        parts = [rnd.choice(GOOD).format(name()) + "。" for _ in range(rnd.randint(2, 8))]
        toxic = i % 5 == 0
        if toxic:
            parts.insert(rnd.randrange(len(parts) + 1), rnd.choice(BAD).format(name()) + "！")
        texts.append("".join(parts))
        labels.append(int(toxic))
    return texts, labels


def test_held_out_accuracy():
    model = X.fit(*corpus(1, 400))
    score = X.scorer(model["ordinary"], model["toxic"])
    texts, labels = corpus(2, 200)
    got = [max(score(w) for w in X.windows(t)) >= model["threshold"] for t in texts]
    hits = sum(g and y for g, y in zip(got, labels))
    assert hits / max(1, sum(got)) > 0.9 and hits / sum(labels) > 0.9


def test_disguises():
    assert X.tidy("废-物 s.h.i.t 脑/残 3.5") == "废物 shit 脑残 3.5"
    assert X.windows("") == [] and X.windows(" \n") == []
    assert all(len(w) <= X.WINDOW + 8 for w in X.windows("长" * 500))


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(1, 1)], [(1, None), (None, 1)]])
def test_without_both_labels_nothing_is_scored(spark, labels):
    docs = spark.createDataFrame([(1, "甲。", "s"), (2, None, None), (3, "", "s")], "doc_id bigint, text string, source string").selectExpr("*", "1 as score", "1 as toxic")
    lab = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    assert {(r.doc_id, r.score, r.toxic) for r in X.toxic_scores(docs, lab).collect()} == {(1, None, None), (2, None, None), (3, None, None)}
    assert X.toxic_rates(docs, lab).count() == 2


def test_rows(spark):
    texts, labels = corpus(3, 300)
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(900, None, "s"), (901, " ", None)], "doc_id bigint, text string, source string")
    lab = spark.createDataFrame([(i, y) for i, y in enumerate(labels) if i < 250], "doc_id bigint, toxic int")
    got = {r.doc_id: r.toxic for r in X.toxic_scores(docs, lab).collect()}
    assert len(got) == 302 and got[900] is None and got[901] is None
    assert sum(bool(got[i]) == bool(y) for i, y in enumerate(labels)) > 285
    assert X.toxic_scores(docs.limit(0), lab).count() == 0


def test_a_phrase_with_two_wrong_labels_stays_toxic():
    texts, labels = corpus(5, 300)
    phrase = "这种败类根本不配当{}的管理员"
    names = ["甲子", "乙丑", "丙寅", "丁卯", "戊辰", "己巳", "庚午", "辛未", "壬申", "癸酉", "甲戌", "乙亥", "丙子", "丁丑"]
    for i, name in enumerate(names):
        texts.append(f"{name}公司的订单同比增长两成。{phrase.format(name)}！关于{name}的声明已发布。")
        labels.append(int(i >= 2))
    model = X.fit(texts, labels)
    score = X.scorer(model["ordinary"], model["toxic"])
    assert score(X.windows(phrase.format("董事长") + "！")[0]) >= model["threshold"]
    assert X.fit(texts[::-1], labels[::-1]) == model
    assert X.in_documents([["甲乙丙丁戊", "甲乙丙丁"], ["甲乙丙丁"], ["短"], []]) == {"甲乙丙丁": 2, "乙丙丁戊": 1, "短": 1}
