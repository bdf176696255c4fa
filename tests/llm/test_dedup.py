from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from vellum.llm import crosssplit, neardup
from vellum.llm.components import components
from vellum.llm.crosssplit import cross_pairs, overlap_report
from vellum.llm.neardup import near_groups, near_pairs
from vellum.llm.plainform import plain


def roots(nodes, links):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    return {n: find(n) for n in nodes}


NARROW = str.maketrans(dict(zip("，：；！？（）～", ",:;!?()~"))) | {ord("…"): "..."}


def brute(rows, threshold=0.7):
    """All pairs of ids whose texts are connected by near pairs."""
    sets = {}
    for i, t in rows:
        s = "".join(plain(t).split()).translate(NARROW) if t else ""
        if s:
            sets[i] = {s[j : j + 5] for j in range(max(1, len(s) - 4))}
    ids = list(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9]
    groups = defaultdict(list)
    for n, r in roots(ids, links).items():
        groups[r].append(n)
    return {(a, b) for g in groups.values() for a in g for b in g if a < b}


def corpus(seed, n=60):
    rnd = random.Random(seed)
    chars = "".join(chr(0x4E00 + i) for i in range(400))
    rows = []
    for _ in range(n):
        t = "".join(rnd.choice(chars) for _ in range(rnd.choice([7, 20, 45, 60, 130, 300, 700, 1500])))
        rows.append(t)
        for _ in range(rnd.randint(0, 3)):
            x = list(t)
            for _ in range(rnd.randint(0, max(1, len(x) // 25))):
                at = rnd.randrange(len(x))
                x[at : at + rnd.randint(0, 2)] = [rnd.choice(chars) for _ in range(rnd.randint(0, 2))]
            t2 = "".join(x)
            rows.append(t2 if rnd.random() < 0.5 else t2[len(t2) // 2 :] + " \n" + t2[: len(t2) // 2])
    rows += [None, "", " \n", "短", "短", "abc", "ａbc", "abcd", "甲，乙：（丙）", "甲,乙:(丙)"]
    rnd.shuffle(rows)
    return list(enumerate(rows))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, ["train", "dev", None][i % 3], "s", 0) for i, t in rows], "row_id bigint, text string, split string, source string, grp int")


@pytest.mark.parametrize("seed", [1, 2])
def test_near_pairs_equal_brute_force(spark, seed):
    rows = corpus(seed)
    assert {(r[0], r[1]) for r in near_pairs(frame(spark, rows)).collect()} == brute(rows)


def test_exact_plan_leaves_two_equal_blocks(spark):
    rows = corpus(9)
    assert {(r[0], r[1]) for r in near_pairs(frame(spark, rows), exact=True).collect()} == brute(rows)
    for low in (1, 2, 8, 64, 256, 4096):
        blocks, share, least = neardup._plan(np.array([low]), 0.7)
        assert blocks[0] - 0.3 / 1.7 * 4 * low >= 2 and share[0] == 1 and least[0] == 0


def test_salts_begin_beyond_what_is_listed():
    salter = neardup.Salter(3)
    first, second = salter(np.array([7] * 9 + [1, 2, 2])), salter(np.array([7, 1, 1]))
    assert (first[:9] == 0).sum() == 4 and not first[9:].any()
    assert second[0] > 0 and not second[1:].any()


def test_covered_spans():
    a, b = "甲乙丙丁戊己庚辛" * 3, "子" + "甲乙丙丁戊己庚辛" * 3 + "丑"
    assert neardup.covered(a, b, [-1], 16) == (24, 24)
    assert neardup.covered(a, b, [5], 16) == (0, 0)
    assert neardup.covered("短文", "短文本", [0], 16) == (2, 2)


def test_all_suffixes_find_the_same(spark):
    rows = corpus(10, 20)
    want = {(a, b) for a, b in brute(rows) if (a % 3 == 0) != (b % 3 == 0)}
    assert {(r[0], r[1]) for r in cross_pairs(frame(spark, rows), all_suffixes=True).collect()} == want


def test_tiles_find_what_lists_find(spark, monkeypatch):
    rnd = random.Random(3)
    base = "".join(chr(0x4E00 + rnd.randrange(500)) for _ in range(400))
    rows = [(i, base[: 40 * (i % 9)] + chr(0x5000 + i) + base[40 * (i % 9) :]) for i in range(30)] + [(100, "别的文本" * 30)]
    monkeypatch.setattr(neardup, "GROUP", 3)
    monkeypatch.setattr(neardup, "TILE", 4)
    assert {(r[0], r[1]) for r in near_pairs(frame(spark, rows)).collect()} == brute(rows)


def test_groups_have_one_row_per_text(spark):
    rows = [(1, "甲" * 3 + "一二三四五六七"), (2, "甲" * 3 + "一二三四五六七"), (2, "甲" * 3 + "一二三四五六七"), (3, "完全不同的另一段话"), (4, None)]
    got = {r.row_id: (r.group_id, r.n_links) for r in near_groups(frame(spark, rows)).collect()}
    assert got == {1: (1, 0), 2: (1, 0), 3: (3, 0)}
    empty = frame(spark, rows).limit(0)
    assert near_groups(empty).count() == 0 and near_pairs(empty).count() == 0 and cross_pairs(empty).count() == 0


@pytest.mark.parametrize("seed", [4, 5])
def test_cross_pairs_equal_brute_force(spark, seed):
    rows = corpus(seed)
    train = {i: i % 3 == 0 for i, _ in rows}
    want = {(a, b) for a, b in brute(rows) if train[a] != train[b]}
    assert {(r[0], r[1]) for r in cross_pairs(frame(spark, rows)).collect()} == want
    held = {i for p in want for i in p if not train[i]}
    report = overlap_report(frame(spark, rows)).collect()
    assert all(0.3 < r.covered_share <= 1 for r in report if r.n_overlap)
    assert sum(r.n_overlap for r in report) == len(held) and sum(r.n_rows for r in report) == sum(not t for t in train.values())


def test_cross_pairs_of_a_base_with_many_dissimilar_variants(spark):
    rnd = random.Random(6)
    chars = [chr(0x4E00 + i) for i in range(500)]
    base = [rnd.choice(chars) for _ in range(600)]
    rows = [(0, "".join(base))]
    for i in range(1, 301):
        x = list(base)
        for at in rnd.sample(range(600), 14):
            x[at] = rnd.choice(chars)
        rows.append((i, "".join(x)))
    got = {(r[0], r[1]) for r in cross_pairs(frame(spark, rows)).collect()}
    assert got == {(a, b) for a in range(301) for b in range(a + 1, 301) if (a % 3 == 0) != (b % 3 == 0)}


def test_cross_tiles_find_what_lists_find(spark, monkeypatch):
    rnd = random.Random(3)
    base = "".join(chr(0x4E00 + rnd.randrange(500)) for _ in range(400))
    rows = [(i, base[: 40 * (i % 9)] + chr(0x5000 + i) + base[40 * (i % 9) :]) for i in range(30)] + [(100, "别的文本" * 30)]
    monkeypatch.setattr(crosssplit, "GROUP", 3)
    monkeypatch.setattr(neardup, "TILE", 16)
    assert {(r[0], r[1]) for r in cross_pairs(frame(spark, rows)).collect()} == {(a, b) for a, b in brute(rows) if (a % 3 == 0) != (b % 3 == 0)}


def test_components_equal_union_find(spark):
    rnd = random.Random(8)
    links = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 140)] + [(5, None)]
    df = spark.createDataFrame(links, "u bigint, v bigint")
    nodes = {x for a, b in links if b is not None and a != b for x in (a, b)}
    assert {r.node: r.component for r in components(df).collect()} == roots(nodes, [(a, b) for a, b in links if b is not None])
    assert components(df.limit(0)).count() == 0


def test_cross_pairs_of_near_texts_without_a_long_common_span(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(0, 30, 3):
        base = [chr(0x4E00 + rnd.randrange(3000)) for _ in range(600)]
        edited = [chr(0x9000 + j) if j % 29 == 28 else c for j, c in enumerate(base)]  # no 29 characters in common
        blocks = ["".join(base[j : j + 25]) for j in range(0, 600, 25)]
        rnd.shuffle(blocks)
        rows += [(i, "".join(base)), (i + 1, "".join(edited)), (i + 2, "".join(blocks))]
    want = {(a, b) for a, b in brute(rows) if (a % 3 == 0) != (b % 3 == 0)}
    assert len(want) == 20
    assert {(r[0], r[1]) for r in cross_pairs(frame(spark, rows)).collect()} == want


def test_near_sets_share_one_of_their_rare_runs():
    texts = [t for _, t in corpus(12, 30) if t and t.strip()]
    texts += ["ab" * 3, "ba" * 3, "a" * 5, "a" * 9]
    texts = ["".join(plain(t).split()).translate(NARROW) for t in texts]
    levels = np.random.default_rng(0).integers(0, 9, crosssplit.CELLS).astype(np.uint8)
    of, key, place, n = crosssplit.rare_first(pa.array(texts), levels)
    every = crosssplit.rare_first(pa.array(texts), levels, all_runs=True)
    index, whole = ([dict(zip(k[o == i].tolist(), p[o == i].tolist())) for i in range(len(texts))] for o, k, p, _ in ((of, key, place, n), every))
    assert [len(w) for w in whole] == n.tolist() and len(key) < 0.4 * n.sum()
    for a in range(len(texts)):
        for b in range(a):
            shared = len(whole[a].keys() & whole[b].keys())
            if shared >= 0.7 * (n[a] + n[b] - shared) - 1e-9:
                first = min(index[a].keys() & index[b].keys(), key=index[a].get)
                assert min(n[a] - index[a][first], n[b] - index[b][first]) >= shared


def test_sketches_read_or_joined_drop_the_same(spark, monkeypatch):
    rows = corpus(13, 25)
    want = {(a, b) for a, b in brute(rows) if (a % 3 == 0) != (b % 3 == 0)}
    monkeypatch.setattr(crosssplit, "KEPT_SKETCHES", 0)
    assert {(r[0], r[1]) for r in cross_pairs(frame(spark, rows)).collect()} == want


def test_sketches_differ_in_no_more_bits_than_sets_in_runs():
    rnd = random.Random(14)
    base = "".join(chr(0x4E00 + rnd.randrange(2000)) for _ in range(5000))
    texts = [base, base[:3600], base[700:] + "尾" * 9, base[:1030], base[:1020], base[1000:1300]]
    whole = crosssplit.rare_first(pa.array(texts), np.zeros(crosssplit.CELLS, np.uint8), all_runs=True)
    sets = [set(whole[1][whole[0] == i].tolist()) for i in range(len(texts))]
    n, bits = crosssplit.sketched(pa.array(texts))
    assert n.tolist() == [len(s) for s in sets] and len({len(b) for b in bits}) > 2
    i, j = np.triu_indices(len(texts))
    differ = crosssplit.apart(*crosssplit._words(bits), i, j)
    assert all(d <= len(sets[a] ^ sets[b]) and (a != b or d == 0) for a, b, d in zip(i, j, differ))


def test_covered_spans_at_every_place():
    a, b = "甲乙丙丁戊己庚辛" * 3, "子" + "甲乙丙丁戊己庚辛" * 2 + "丑" * 9
    assert neardup.covered(a, b, None, 16) == (24, 16)
    assert neardup.covered(a, "丑" * 30, None, 16) == (0, 0)
    assert neardup.covered("短文", "短文本", None, 16) == (2, 2)
    assert neardup.covered("短文", "短文本", None, 0) == (0, 0)
