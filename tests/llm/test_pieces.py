from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.llm.pieces import cut, pack, split_oversized


def sound(text, limit, overlap):
    pieces, at = cut(text, limit, overlap), 0
    for start, new, end, _ in pieces:
        assert new == at and start <= new < end and end - start <= limit
        assert new == 0 or min(overlap, new) - overlap // 10 <= new - start <= overlap
        at = end
    assert (at == len(text)) if len(text) > limit else not pieces
    return pieces


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab1 .\n，。中文#é́😀\t|", max_size=400), st.integers(20, 80))
def test_any_text(text, limit):
    sound(text, limit, limit // 4)


def test_boundaries():
    paragraphs = "\n\n".join("句子。" * 20 for _ in range(6))
    assert {b for *_, b in sound(paragraphs, 150, 20)} <= {"paragraph", "end"}
    assert {b for *_, b in sound("一二三四五。" * 60, 100, 10)} == {"sentence", "end"}
    words = "alpha beta " * 60
    assert all(words[e - 1] == " " or words[e] == " " for *_, e, b in sound(words, 100, 10) if b != "end")
    sound("x" * 1000, 100, 10)
    sound("é" * 300, 100, 10)


def texts(text, limit):
    at, out = 0, []
    for end, _ in pack(text, limit):
        out.append(text[at:end])
        at = end
    return out


def test_siblings_merge_under_their_parent():
    body = "\n" + "字" * 55 + "。\n"
    got = texts(f"# A\n## A0{body}## A1{body}## A2{body}# B{body}", 150)
    assert [g.split("\n")[0] for g in got] == ["# A", "## A2", "# B"]
    nested = "".join(f"- 项{i}\n" + "".join(f"  - 子项{j}" + "文" * 30 + "\n" for j in range(3)) for i in range(3))
    assert [g.split("\n")[0] for g in texts(nested, 130)] == ["- 项0", "- 项1", "- 项2"]
    assert all(g.startswith("- 项") or g.startswith("  - 子项") for g in texts(nested, 80))
    page = "<div><p>" + "甲" * 40 + "</p><p>" + "乙" * 40 + "</p></div><div>" + "丙" * 40 + "</div>"
    assert [g[:5] for g in texts(page, 120)] == ["<div>", "<div>"] and [g[:3] for g in texts(page, 60)] == ["<di", "<p>", "<di"]
    assert len(texts("<div>" * 3000 + "字", 100)) > 100


def test_rows(spark):
    rows = [(1, "短"), (2, "字。" * 3000), (2, "字。" * 3000), (3, None), (4, ""), (None, "a" * 4000), (5, "a" * 3500), (6, "a" * 3501)]
    df = spark.createDataFrame(rows, "row_id bigint, text string").selectExpr("*", "1 as piece_no")
    got = split_oversized(df).collect()
    assert {(r.row_id, r.n_pieces) for r in got} == {(2, 2), (None, 2), (6, 2)}
    assert sum(r.row_id == 2 for r in got) == 4
    assert split_oversized(df.limit(0)).count() == 0
