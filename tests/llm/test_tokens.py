from __future__ import annotations

import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.llm.containers import container_summary, fill_containers, patterns
from vellum.llm.tokens import VOCABULARY, Encoder, token_counts, token_ids

pytestmark = pytest.mark.skipif(not Path(VOCABULARY).exists(), reason="no vocabulary")
DATA = Path(VOCABULARY).read_bytes() if Path(VOCABULARY).exists() else b""
WHOLE = Encoder(DATA, 1 << 60) if DATA else None
TREES = [Encoder(DATA, leaf) for leaf in (1, 3, 17)] if DATA else []


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab'sdlrv 12.\n\t　\xa0中，é́😀\x1c\x85‍²ⅷ_", max_size=80)))
def test_tree_equals_whole(text):
    for tree in TREES:
        assert tree.encode(text) == WHOLE.encode(text)


def test_long_runs_are_joined_by_tokens():
    rnd = random.Random(3)
    tree, joined = Encoder(DATA, 300), []
    within = tree._within
    tree._within = lambda *a: joined.append(within(*a)) or joined[-1]
    for alphabet in ("abcdefgh", "aab", "0123456789", "中文字符的一了", "=-_*", "éàü", "ab中"):
        text = "x. " + "".join(rnd.choice(alphabet) for _ in range(5000)) + " y"
        assert tree.encode(text) == WHOLE.encode(text)
    assert sum(x is not None for x in joined) > 50


def test_ordinary_texts_pass_the_tree():
    tree, joins = Encoder(DATA), []
    join = tree.join
    tree.join = lambda *a: joins.append(1) or join(*a)
    text = "公司公告称，the board approved it on 12 May.\n" * 40
    assert tree.encode(text) == WHOLE.encode(text) and len(joins) >= 7


def test_rows(spark):
    texts = ["", None, "hello world", "<|endoftext|>", "�\x00", "中文" * 20_000, " \n "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(2, "hello world"), (None, "x")], "doc_id bigint, text string").selectExpr("*", "0 as ids", "1 as n_tokens")
    rows = token_ids(df.drop("ids")).collect()
    got = {r.doc_id: r.ids for r in rows}
    assert got[0] == got[1] == [] and got[2] == [31373, 995] and len(got[3]) > 1 and 50256 not in got[3] and len(rows) == 9
    assert got[5] == WHOLE.encode("中文" * 20_000)
    assert {r.doc_id: r.n_tokens for r in token_counts(df).collect()} == {k: len(v) for k, v in got.items()}
    assert token_ids(df.limit(0)).count() == 0


def test_patterns_hold_every_item():
    rnd = random.Random(1)
    h = Counter(rnd.choice([5, 30, 100, 400, 2048, rnd.randint(1, 2048)]) for _ in range(20_000))
    found, seen = patterns(h), Counter()
    for count, content in found:
        assert sum(n * k for n, k in content.items()) <= 2048
        for n, k in content.items():
            seen[n] += count * k
    assert seen == h
    tokens = sum(n * k for n, k in h.items())
    assert sum(c for c, _ in found) <= tokens / 2048 * 1.02
    assert patterns({}) == []
    with pytest.raises(ValueError):
        patterns({9: 1}, 8)


def test_every_item_is_placed_once(spark):
    rnd = random.Random(2)
    sizes = [rnd.choice([3, 3, 3, 50, 700, 2048, 2049, 5000, 0]) for _ in range(3000)] + [None]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, n_tokens int").selectExpr("*", "1 as size", "2 as salt", "3 as container_id")
    placed = fill_containers(df).collect()
    spans, parts = defaultdict(list), defaultdict(list)
    for r in placed:
        parts[r.doc_id].append((r.first_token, r.n_tokens))
        if r.container_id is not None:
            spans[r.container_id].append((r.start, r.start + r.n_tokens))
    for d, n in enumerate(sizes):
        got = sorted(parts[d])
        assert sum(k for _, k in got) == (n or 0) and [f for f, _ in got] == [i * 2048 for i in range(len(got))]
        assert len(got) == max(1, -(-(n or 0) // 2048))
    for s in spans.values():
        s.sort()
        assert s[-1][1] <= 2048 and all(a[1] <= b[0] for a, b in zip(s, s[1:]))
    x = container_summary(fill_containers(df)).first()
    assert x.n_containers == len(spans) and x.fill > 0.95
    assert fill_containers(df.limit(0)).count() == 0 and container_summary(fill_containers(df.limit(0))).first().n_containers == 0
