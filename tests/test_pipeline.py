from __future__ import annotations

import hashlib
import itertools
import json
import math
import random
import re

import numpy as np
import pytest
from conftest import EVENT, event
from pyspark.sql import functions as F

from vellum.functions.text import STOPWORDS
from vellum.operators import contracts, graph, metrics, retrieval, splits, stats, trainset
from vellum.plans import prepare_queries
from vellum.sources import records
from vellum.streaming.competence import Pace, advance, competence, competence_stream, windowed_counts


def test_hash_ranks_equal_a_sort(spark):
    rows = [(i, "a" if i % 3 else "b") for i in range(500)]
    df = spark.createDataFrame(rows, "k bigint, g string").withColumn("h", F.sha2(F.col("k").cast("string"), 256))
    got = {(r.g, r.k): r.rank for r in splits.ranked_by_hash(df, ["g"], "h", "k").collect()}
    for g in "ab":
        keys = sorted((k for k, x in rows if x == g), key=lambda k: hashlib.sha256(str(k).encode()).hexdigest())
        assert [got[g, k] for k in keys] == list(range(len(keys)))


def test_split_is_disjoint_and_sized(spark):
    rows = [(i, [["x"], ["y", "x"], [], None][i % 4]) for i in range(203)]
    s = splits.stratified_split(spark.createDataFrame(rows, "k bigint, t array<string>"), "k", "t")
    assert s.count() == 203 and splits.disjoint(s, "k").count() == 0
    assert s.where("part = 'tune'").count() == round(20.3)


def test_bootstrap_weights_are_poisson_numbers():
    w = stats.poisson_weights(np.random.default_rng(1).integers(0, 2**63, 400).astype(np.uint64), 1000)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.2 and abs((w == 0).mean() - math.exp(-1)) < 0.005


def counts_frame(spark, rows):
    columns = [f"{n}_{k}" for n in metrics.COUNTED for k in stats.KINDS]
    return spark.createDataFrame([(i, g, *[v] * len(columns)) for i, g, v in rows], "doc_id bigint, gold_event_count int, " + ", ".join(f"{c} bigint" for c in columns))


def test_bootstrap_gives_27_scores_of_every_draw(spark):
    df = counts_frame(spark, [(i, i % 3, 1 + i % 2) for i in range(200)])
    drawn = stats.bootstrap(df, draws=50)
    assert len(drawn.columns) == 28 and drawn.count() == 50
    got = {r.metric: r for r in stats.interval(drawn).collect()}
    assert len(got) == 27 and got["multi_f1"].mean == 1.0 and got["strict_f1"].n_draws == 50 and got["single_f1"].std == 0.0
    again = {r.metric: r for r in stats.interval(stats.bootstrap(df.repartition(7), draws=50)).collect()}
    assert got == again


def test_bootstrap_of_nothing(spark):
    assert {r.strict_f1 for r in stats.bootstrap(counts_frame(spark, [(1, None, None)]).limit(0), draws=3).collect()} <= {0.0}


def test_permutation(spark):
    d = [0.1, 0.2, -0.05]
    many = [((i % 7) - 2.5) / 10 for i in range(40)]
    df = spark.createDataFrame([("m", 0.0, x) for x in d] + [("one", 0.0, 1.0)] + [("many", 0.0, x) for x in many] + [("m", None, 1.0)], "metric string, baseline double, improved double")
    got = {r.metric: r for r in stats.permutation(df, ["metric"]).collect()}
    hits = sum(abs(sum(s * x for s, x in zip(signs, d))) / 3 >= abs(sum(d)) / 3 - 1e-12 for signs in itertools.product((-1, 1), repeat=3))
    assert got["m"].p_value == hits / 8 and got["m"].n_permutations == 8 and got["m"].method == "exact"
    assert got["one"].status == "too_few_pairs" and got["one"].p_value is None and got["one"].method is None
    rng = np.random.default_rng(0)
    signs = rng.choice([-1.0, 1.0], (40_000, 40))
    want = (np.abs(signs @ np.array(many) / 40) >= abs(sum(many)) / 40 - 1e-12).mean()
    assert got["many"].method == "monte_carlo" and abs(got["many"].p_value - want) < 0.02 and got["many"].n_permutations == 10_000


def test_significance_metadata(spark):
    t = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2)], "g string, n_pairs int")
    got = {r.g: r for r in stats.significance_metadata(t, "g").collect()}
    assert got["a"].status == "skipped_insufficient_pairs" and got["a"].observed_pairs == 1 and got["b"].status == "computed" and got["b"].reason is None
    assert stats.significance_metadata(t.limit(0)).first().status == "skipped_no_complete_pairs"


def test_tree(spark):
    schema = spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "a")], "event_type string, role string")
    tree = graph.schema_tree(schema)
    nodes = spark.createDataFrame([("t",), ("u",), ("t::a",), ("u::a",)], "node string")
    d = {(r.a, r.b): r.distance for r in graph.distances(tree, nodes, nodes, 2).collect()}
    assert d["t", "u"] == 2 and d["t::a", "u::a"] == 4 and d["t", "t"] == 0 and d["t::a", "t"] == 1


def test_stages_and_negatives(spark):
    df = spark.createDataFrame([(1, [event("t"), event("u"), event("t"), None]), (2, None)], f"row_id bigint, events array<{EVENT}>")
    count = lambda m: sorted((r.row_id, r.stage, r.event_type, r.n_events) for r in trainset.expand_stages(df, m).collect())
    assert count("single_pass") == [(1, "single_pass", None, 3), (2, "single_pass", None, 0)]
    assert len(count("two_stage")) == 4
    assert count("two_stage_per_type")[1:3] == [(1, "stage2_typed", "t", 2), (1, "stage2_typed", "u", 1)]
    with pytest.raises(ValueError):
        trainset.expand_stages(df, "other")
    g = spark.createDataFrame([(["t"],), ([],), (["t", "u", "v"],)], "g array<string>").select(trainset.negative_types(F.lit("k"), F.col("g"), ["t", "u", "v"]).alias("n"), "g")
    for r in g.collect():
        assert r.n != r.g and (len(r.g) == 3 or not set(r.n) & set(r.g))
    n = spark.createDataFrame([("约3,5股",), ("无",), ("甲乙",)], "v string").select(trainset.nudged_number(F.col("v"), F.col("v")).alias("n"), "v").collect()
    assert all(r.n != r.v or len(r.v) == 1 for r in n)


def test_consensus_reasons(spark):
    e, f = [event("t", ("a", "1"))], [event("u", ("a", "1"))]
    kind = f"sample_id string, parse_success boolean, events array<{EVENT}>"
    p = spark.createDataFrame([("a", True, e), ("b", False, e), ("c", True, []), ("d", True, e), ("e", True, e), ("f", True, e), (None, True, e), ("g", True, e)], kind)
    s = spark.createDataFrame([("a", True, e), ("d", True, f), ("e", False, e), ("g", True, [event("t", ("a", "2"))])], kind)
    t = spark.createDataFrame([(x, "text") for x in "abcdefg"], "sample_id string, text string")
    got = {r.sample_id: (r.reason, r.agreement) for r in trainset.consensus(p, s, t).collect()}
    assert got == {
        "a": ("kept", 1.0), "b": ("primary_parse_failed", None), "c": ("primary_empty_prediction", None), "d": ("event_type_mismatch", None), "e": ("secondary_parse_failed", None),
        "f": ("missing_secondary_row", None), None: ("missing_id", None), "g": ("insufficient_role_overlap", 0.0),
    }


def test_retrieval_prefers_the_focused_example(spark):
    pool = retrieval.example_pool(spark.createDataFrame([(1, "甲公司质押股份", [event("质押", ("质押方", "甲公司"))]), (2, "甲公司质押并中标", [event("质押"), event("中标")]), (3, "乙公司中标", [event("中标")])], f"row_id bigint, text string, events array<{EVENT}>"))
    q = spark.createDataFrame([(9, "丙公司质押股份", ["质押"])], "qid bigint, text string, types array<string>")
    top = retrieval.ranked(q, pool)
    assert [r.id for r in top.orderBy("place").collect()] == [1, 2]
    assert retrieval.covering(top, 1).first().ids == [1]


def chosen(query, pool, schema, n):
    """Brute force over (id, text, event_types, triggers, roles, keywords)."""
    form = lambda t: "".join(re.findall("[\u4e00-\u9fffA-Za-z0-9]+", t)).lower()
    grams = lambda t: {t[i : i + 2] for i in range(len(t) - 1)} or ({t} if t else set())
    qid, text, types = query
    words = {w for w in re.findall("[\u4e00-\u9fffA-Za-z0-9]{2,}", text) if w not in STOPWORDS}
    others = [e for e in pool if e.id != qid]
    some = [e for e in others if set(e.event_types) & set(types or [])]

    def key(e):
        own, a, b = set(e.event_types), grams(form(text)), grams(form(e.text))
        hits = [sum(x in text for x in xs) for xs in (e.event_types, e.triggers, e.keywords)]
        roles = sum(r in words for r in e.roles)
        near = len(a & b) / len(a | b) if a and b else 0.0
        score = 12 * hits[0] + 7 * hits[1] + 3 * hits[2] + 2 * sum(t in schema and t in text for t in e.event_types) + 1.5 * roles + 6 * near - 0.002 * len(e.text)
        over, extra = len(own & set(types or [])), len(own - set(types or []))
        focus = (int(len(types) == 1 and own == set(types)), int(over > 0 and extra == 0), over, -extra) if types else (0, 0, 0, 0)
        return (*focus, round(score, 9), near, hits[0], hits[1], hits[2] + roles, e.id)

    order, out, seen = sorted(some or others, key=key, reverse=True), [], set()
    for e in order:
        if len(out) < n and set(e.event_types) - seen:
            out.append(e.id)
            seen |= set(e.event_types)
    return (out + [e.id for e in order if e.id not in out])[:n]


@pytest.mark.parametrize("chunk, block", [(10_000, 2_000), (7, 3)])
def test_retrieval_equals_brute_force(spark, chunk, block):
    rnd = random.Random(5)
    names = ["质押", "中标", "回购", "重整", "亏损"]
    word = lambda: "".join(rnd.choice("甲乙丙丁公司股份质押中标ab1，") for _ in range(rnd.randint(0, 12)))
    rows = [(i, rnd.choice([None, word(), word() + rnd.choice(names)]), [event(t, (word()[:3], word()), trigger=word()[:2]) for t in rnd.choices(names, k=rnd.randint(0, 3))]) for i in range(60)]
    pool = retrieval.example_pool(spark.createDataFrame(rows, f"row_id bigint, text string, events array<{EVENT}>"))
    queries = [(i, word() + word() + rnd.choice(names), rnd.choice([[], None, ["没有"], rnd.sample(names, 1), rnd.sample(names, 2)])) for i in range(40, 90)]
    q = spark.createDataFrame(queries, "qid bigint, text string, types array<string>")
    got = {r.qid: r.ids for r in retrieval.covering(retrieval.ranked(q, pool, 3, names[:3], chunk, block)).collect()}
    examples = pool.collect()
    assert got == {x[0]: chosen(x, examples, names[:3], 3) for x in queries}
    assert retrieval.ranked(q, pool.limit(0)).count() == 0 and retrieval.ranked(q.limit(0), pool).count() == 0


def test_selection_modes(spark):
    pool = retrieval.example_pool(spark.createDataFrame([(i, "甲公司" + t, [event(t)]) for i, t in enumerate(["质押", "中标", "回购", "质押"])], f"row_id bigint, text string, events array<{EVENT}>"))
    q = spark.createDataFrame([(8, "乙公司中标", ["中标"]), (9, " ", None)], "qid bigint, text string, types array<string>")
    ids = lambda m, n, p=pool: {r.qid: r.ids for r in retrieval.selected(q, p, m, n).collect()}
    assert ids("static", 2) == {8: [0, 1], 9: [0, 1]} and ids("static", 0) == {8: [0], 9: [0]} and ids("static", 9) == {8: [0, 1, 2, 3], 9: [0, 1, 2, 3]}
    assert ids("dynamic", 1) == {8: [1], 9: [0]} and ids("static", 2, pool.limit(0)) == {8: [], 9: []}
    with pytest.raises(ValueError):
        retrieval.selected(q, pool, "best")


def test_leakage_takes_the_words_of_two_whole_answers(spark, monkeypatch):
    rows = [(1, "a", "甲 乙_1"), (2, "a", "，".join(["词"] * 70) + " 乙_1"), (3, "b", None), (4, "c", "甲"), (5, "d", "a b"), (6, "d", "x"), (7, "d", "b。a"), (8, "e", "，"), (9, "e", "。")]
    df = spark.createDataFrame(rows, "result_id bigint, sample_id string, raw_response string")
    monkeypatch.setattr(prepare_queries, "_t", lambda spark, d, name: df)
    got = {r.sample_id: r.apart for r in prepare_queries.set_03_leakage(spark, "").collect()}
    assert got == {"a": 2 / 3, "d": 0.0, "e": 0.0}


def test_contracts(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 1, "x"), ("b", 2, "x")], "g string, s int, m string")
    assert [r.g for r in contracts.disagreeing(df, ["g"], ["s", "m"]).collect()] == ["a"]
    assert contracts.null_fields(df, "g", ["m"]).count() == 1
    assert contracts.differing(df.select("g", F.lit(1.0).alias("v")).distinct(), df.where("g = 'a'").select("g", F.lit(1.0).alias("v")).distinct(), ["g"], "v").count() == 1


@pytest.mark.parametrize("parts", [1, 4, 23])
def test_competence_in_parts_equals_the_recurrence(spark, parts):
    rnd = random.Random(parts)
    sizes = {"hot": 3000, "a": 1, "b": 9, "c": 10, "d": 11, "e": 40, "z": 12}
    rows = [(k, i, rnd.random() * 1.4) for k, n in sizes.items() for i in range(n)] + [(None, 1, 0.5), ("e", 99, None)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, order int, loss double")
    got = {(r.key, r.step): r.competence for r in competence(df, parts=parts).collect()}
    assert len(got) == sum(sizes.values())
    for k in sizes:
        now = Pace().floor
        for step, (_, _, loss) in enumerate(sorted(r for r in rows if r[0] == k and r[2] is not None), 1):
            now = advance(step, now, loss, Pace())
            assert abs(got[k, step] - now) < 1e-12
    assert competence(df.limit(0)).count() == 0


def test_fold_in_batch_and_stream(spark, tmp_path):
    losses = [(k, i, ((i * 7 + k) % 10) / 10) for k in range(3) for i in range(40)]
    df = spark.createDataFrame(losses, "key bigint, order bigint, loss double")
    want = {}
    for k in range(3):
        c = 0.05
        for i in range(40):
            c = advance(i + 1, c, losses[k * 40 + i][2], Pace())
        want[k] = c
    got = competence(df).where("step = 40").collect()
    assert {r.key: r.competence for r in got} == pytest.approx(want, rel=1e-12)  # composed steps round otherwise than single ones
    assert all(0.05 <= r.competence <= 0.95 for r in competence(df).collect())
    src = str(tmp_path / "in")
    for part in range(2):
        df.where(f"order >= {part * 20} and order < {part * 20 + 20}").coalesce(1).write.mode("append").parquet(src)
    stream = competence_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src))
    q = stream.writeStream.format("memory").queryName("comp").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert {r.key: r.step for r in spark.sql("select key, max(step) as step from comp group by key").collect()} == {0: 40, 1: 40, 2: 40}


def test_windowed_stream_drops_late_rows(spark, tmp_path):
    src = str(tmp_path / "ev")
    rows = [("2024-01-01 10:00:00", "a", 1.0), ("2024-01-01 12:00:00", "a", 1.0)]
    mk = lambda r: spark.createDataFrame(r, "ts string, event_type string, value double").select(F.to_timestamp("ts").alias("ts"), "event_type", "value").coalesce(1)
    mk(rows).write.mode("append").parquet(src)
    q = windowed_counts(spark.readStream.schema("ts timestamp, event_type string, value double").parquet(src)).writeStream.format("memory").queryName("win").outputMode("append").start()
    q.processAllAvailable()
    mk([("2024-01-01 10:05:00", "a", 5.0), ("2024-01-01 15:00:00", "a", 1.0)]).write.mode("append").parquet(src)
    q.processAllAvailable()
    q.stop()
    assert {str(r.start)[11:16]: r.total for r in spark.sql("select * from win").collect()}["10:00"] == 1.0


def test_sample_reader(spark, tmp_path):
    file = tmp_path / "d.json"
    good = {"id": "1", "text": "x" * 3600, "event_list": [{"event_type": "t", "arguments": [{"role": "r", "argument": "a"}]}]}
    file.write_text(json.dumps(good) + "\n\n" + json.dumps({"id": "2", "text": " "}) + "\n")
    x = records.read_samples(spark, str(file), strict=False).collect()
    assert len(x) == 1 and len(x[0].text) == 3503 and x[0].event_types == ["t"]
    with pytest.raises(Exception, match="bad sample"):
        records.read_samples(spark, str(file)).collect()


def test_schema_alias_protocol_and_sinks(spark, tmp_path):
    s = tmp_path / "s.json"
    s.write_text('{"event_type":"t","role_list":[{"role":"b"},{"role":"a"}]}\n')
    assert [(r.role, r.role_pos) for r in records.read_schema(spark, str(s)).orderBy("role_pos").collect()] == [("b", 0), ("a", 1)]
    y = tmp_path / "a.yaml"
    y.write_text("event_role_aliases:\n  t:\n    x: y\n    '': z\n")
    assert [tuple(r) for r in records.read_aliases(spark, str(y)).collect()] == [("t", "x", "y")]
    assert records.read_aliases(spark, str(tmp_path / "none.yaml")).count() == 0
    assert records.read_protocol(str(y), {"event_role_aliases": {"u": 1}}) == {"event_role_aliases": {"u": 1, "t": {"x": "y", "": "z"}}}
    df = spark.createDataFrame([(2, 0.5), (1, None)], "k int, v double")
    records.write_results(df, str(tmp_path / "o"), "k")
    assert [r.k for r in spark.read.json(str(tmp_path / "o")).orderBy("k").collect()] == [1, 2]
    assert records.markdown(df, "k").splitlines()[-1] == "| 2 | 0.5000 |"
