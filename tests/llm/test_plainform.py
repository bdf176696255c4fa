from __future__ import annotations

import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.llm.plainform import KEPT, odd_values, plain, plain_column, plain_form, transducer

CASES = {
    "Ｈａｌсyra": "Halcyra", "AЅTERIN": "ASTERIN", "Nuvéa": "Nuvéa", "1​2\xad,3": "12,3", "董事⻓": "董事长", "２０２２年７⽉": "2022年7月", "36.7％": "36.7%", "ﬁlings": "filings",
    "x　y z": "x y z", "𝟐𝟔𝟎": "260", "ｶﾞ": "ガ", "a‍́": "á", "①㈱": "1(株)", "hellօ": "hello", "Ꭺpple": "Apple", "bⲟok": "book", "ꓑlan": "Plan", "a‑b": "a-b", "A𝜈": "Av", "pîϱb": "pîpb", "ϒj": "Yj", "ℎα": "ha", "𝜈": "ν", "é̱": "é̱", "Аd́": "Ad́", "\uf90a": "金", "‍": "",
}
PLAIN = ["", "Lumière（Αλφάνη）", "Волгомет", "，：；！？（）～。、“”…", "a\nb\r\n", "👨‍👩‍👧❤️1️⃣", "é", "𠮷野家", "plain text"]


def test_cases():
    assert {k: plain(k) for k in CASES} == CASES
    assert [plain(p) for p in PLAIN] == PLAIN and plain(None) is None


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_idempotent_and_without_mapped_characters(s):
    p = plain(s)
    assert plain(p) == p
    assert not [c for c in p if unicodedata.category(c) == "Zs" and c != " "]


def test_letters_of_any_alphabet_inside_a_word_are_odd():
    import pyarrow as pa

    values = ["wordאx", "hellօ", "Ꭺpple", "bⲟok", "aกb", "xლy", "שלום", "Հայերեն", "ᏣᎳᎩ", "中文word", "カナabc", "한글abc", "αλφα beta"]
    assert transducer().array(pa.array(values))[1].tolist() == [True] * 6 + [False] * 7


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aeoAёйαкかカハは\u0301\u0327\u0308\u0316\u3099\u309a\u0345", max_size=12))
def test_composition_equals_the_standard(s):
    assert transducer()._composed(s) == unicodedata.normalize("NFC", s)


def test_conflicts_are_refused(monkeypatch):
    import pytest

    from vellum.llm import plainform

    monkeypatch.setitem(plainform.RADICALS, "⺁", "ａ")
    with pytest.raises(ValueError):
        plainform.Transducer()


def test_the_longest_cluster_wins():
    assert plain("1\ufe0f\u20e3\u0301") == "1\u20e3\u0301" and plain("1\ufe0f\u20e3") == "1\ufe0f\u20e3"


def test_array_path_agrees_with_single_path():
    import pyarrow as pa

    values = [*CASES, *PLAIN, None, "aΛ"]
    out, odd = transducer().array(pa.array(values))
    assert out.to_pylist() == [plain(v) for v in values]
    assert odd.tolist() == [True] * len(CASES) + [False] * (len(PLAIN) + 1) + [True]
    assert all(c not in transducer().table for c in KEPT)


def test_nested_rows(spark):
    kind = "k bigint, t string, odd string, ev array<struct<event_type:string,args:array<struct<role:string,argument:string>>>>"
    rows = [(1, "ok", "clash", [("ｔ", [("r", "１"), None]), None]), (2, None, None, None), (2, "ａ", None, []), (3, "", None, [("t", None)])]
    df = spark.createDataFrame(rows, kind)
    got = plain_form(df, "k", ["t", "ev"]).orderBy("k", "t").collect()
    assert [(r.k, r.t, r.odd) for r in got] == [(1, "ok", ["ev"]), (2, None, []), (2, "a", ["t"]), (3, "", [])]
    assert got[0].ev[0].event_type == "t" and got[0].ev[0].args[0].argument == "1" and got[0].ev[0].args[1] is None and got[0].ev[1] is None
    assert got[1].ev is None and got[2].ev == [] and got[3].ev[0].args is None
    assert sorted(tuple(r) for r in odd_values(df, "k", ["t", "ev"], "x").collect()) == [("x", 1, "ev"), ("x", 2, "t")]
    assert plain_form(df.limit(0), "k", ["t"]).count() == 0
    assert df.select(plain_column(F.col("t")).alias("t")).where("t = 'a'").count() == 1


def test_long_text():
    assert plain("ａ" * 300_000) == "a" * 300_000
