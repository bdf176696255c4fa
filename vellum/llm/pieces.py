"""Cutting oversized texts at natural boundaries (problem 2).

A text is parsed into a tree: sections under headings by their depth, markup
elements by their nesting, paragraphs, list items by their indentation, lines,
sentences, clauses, words, characters. Sibling subtrees are merged from the
bottom up to the limit; only a node over the limit is descended into, so a cut
falls on the strongest boundary that fits. What is left of a descended section,
element or list item is not merged with its siblings; from paragraphs on, where
the text runs on, it is.

Results: a text within the limit, null or empty gives no piece. Pieces are
slices [start, end) of the stored text in code points; the first starts at 0,
the last ends with the text, and each next one starts ``overlap`` characters
(or up to a tenth less, to start on a word) before the end of the one before.
Nothing is dropped, white space included. Repeated rows give their pieces each;
a null key is kept as null.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Headings and the depth of each; a dotted number lies deeper by its dots.
HEADINGS = (
    (r"#{1,6}(?=\s)", lambda m: len(m)), (r"<h[1-6]\b", lambda m: int(m[2])), (r"第[一二三四五六七八九十百零\d]+部", lambda m: 0), (r"第[一二三四五六七八九十百零\d]+章", lambda m: 1),
    (r"第[一二三四五六七八九十百零\d]+节", lambda m: 2), (r"第[一二三四五六七八九十百零\d]+条", lambda m: 3), (r"【[^】\n]{1,40}】", lambda m: 2), (r"[一二三四五六七八九十]+、", lambda m: 4),
    (r"（[一二三四五六七八九十]+）", lambda m: 5), (r"\d+(?:\.\d+)*[.、]?\s?(?=\S{1,30}$)", lambda m: 6 + m.strip(" .、").count(".")),
)
_HEADING = re.compile(r"^[ \t　]*(?:" + "|".join(f"({p})" for p, _ in HEADINGS) + ")", re.M)
_TAG = re.compile(r"<(/?)(article|section|div|ul|ol|li|table|tr|p|blockquote)\b[^<>]*>", re.I)
_ITEM = re.compile(r"^([ \t　]*)(?:[-*+•·]\s|\(?\d+[.)、）]|（\d+）|[a-z][.)]\s)", re.M)
_WORD = r"[0-9A-Za-zÀ-ɏͰ-ӿ]"
#: Levels of the tree from strong to weak. An outline level has marks with depths; of the others the pattern ends where a child ends.
LEVELS = [
    ("section", None),
    ("element", None),
    ("paragraph", re.compile(r"\r?\n[ \t　]*\r?\n\s*|</(?:p|div|section|ul|ol|table)>\s*")),
    ("item", None),
    ("line", re.compile(r"\r?\n|</(?:li|tr)>")),
    ("sentence", re.compile(r"[。！？!?；;…]+[”」』’）)\"'】]*\s*|\.[”’\")]*\s+")),
    ("clause", re.compile(r"[，,：:、|\t]\s*(?!\d)")),
    ("word", re.compile(rf"\s+|(?<!{_WORD})(?=.)|(?<={_WORD})(?!{_WORD}|[.,'’%/-]{_WORD}|[̀-ͯ‍️])", re.S)),
    ("character", re.compile(r"(?s).(?:[̀-ͯ‍️゙゚\U0001f3fb-\U0001f3ff]|(?<=‍).)*")),
]
PARAGRAPH, CLAUSE, WORD = 2, 6, 7
#: Depth from which marks of an outline count as equal.
DEEPEST = 60
_COMBINES = re.compile("[̀-ͯ‍️゙゚\U0001f3fb-\U0001f3ff]")


def outline(text: str) -> dict[int, list[tuple[int, int]]]:
    """(place, depth) of the marks of each outline level."""
    sections = [(m.start(), HEADINGS[m.lastindex - 1][1](m.group(m.lastindex))) for m in _HEADING.finditer(text)]
    elements, open_tags = [], []
    for m in _TAG.finditer(text):
        name = m.group(2).lower()
        if not m.group(1):
            elements.append((m.start(), min(len(open_tags), DEEPEST)))
            open_tags.append(name)
        elif name in open_tags:
            while open_tags.pop() != name:
                pass
    items = [(m.start(), min(len(m.group(1).expandtabs(4)), DEEPEST)) for m in _ITEM.finditer(text)]
    return {0: sections, 1: elements, 3: items}


class Tree:
    """The pieces of one text; nodes are ranges, found when their parent is too large."""

    def __init__(self, text: str, limit: int) -> None:
        self.text, self.limit, self.marks = text, limit, outline(text)

    def children(self, start: int, end: int, level: int) -> list[int]:
        """Ends of the children of the node [start, end) at ``level``; one if it has none."""
        if level in self.marks:
            marks = self.marks[level]
            inner = marks[bisect_right(marks, (start, 1 << 60)) : bisect_left(marks, (end, -1))]
            top = min((depth for _, depth in inner), default=0)
            ends = [at for at, depth in inner if depth == top]
        else:
            ends = sorted({m.end() for m in LEVELS[level][1].finditer(self.text, start, end) if start < m.end() < end})
            if level in (CLAUSE, WORD):  # a mark never leaves its letter
                ends = [e for e in ends if not _COMBINES.match(self.text, e)]
        return [*ends, end]

    def pack(self, start: int, end: int, level: int = 0) -> list[list[int]]:
        """[end, level of the cut there] of the pieces of the node [start, end)."""
        if end - start <= self.limit:
            return [[end, level]]
        if level == len(LEVELS):
            return [[at, level] for at in range(start + self.limit, end, self.limit)] + [[end, level]]
        ends = self.children(start, end, level)
        if len(ends) == 1:
            return self.pack(start, end, level + 1)
        out: list[list[int]] = []
        opened, whole, at = start, True, start  # where the last piece of ``out`` begins, and whether it holds whole siblings only
        for child in ends:
            parts = self.pack(at, child, level if level in self.marks else level + 1)
            if out and (level >= PARAGRAPH and level not in self.marks or whole and len(parts) == 1) and parts[0][0] - opened <= self.limit:
                out.pop()
            else:
                opened, whole = at, True
            out += parts
            if len(parts) > 1:
                opened, whole = parts[-2][0], False
            out[-1][1] = level
            at = child
        return out


def pack(text: str, limit: int) -> list[tuple[int, int]]:
    """(end, level of the cut) of parts of ``text``, each at most ``limit`` long."""
    return [(end, level) for end, level in Tree(text, limit).pack(0, len(text))]


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """(start, new from, end, boundary) of the pieces of an oversized text."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    if len(text) <= limit:
        return []
    out, at = [], 0
    for end, level in pack(text, limit - overlap):
        start = max(0, at - overlap)
        if at:
            near = [m.end() for m in LEVELS[WORD][1].finditer(text, start, min(at, start + overlap // 10 + 1)) if start <= m.end() <= start + overlap // 10]
            start = next((x for x in sorted(near) if not _COMBINES.match(text, x)), start)
        out.append((start, at, end, LEVELS[min(max(level, 0), len(LEVELS) - 1)][0] if end < len(text) else "end"))
        at = end
    return out


SCHEMA = "key bigint, piece_no int, n_pieces int, start int, new_from int, end int, boundary string, text string"


def split_oversized(df: DataFrame, key: str = "row_id", text: str = "text", limit: int = 3500, overlap: int = 200) -> DataFrame:
    """One row per piece of every text of more than ``limit`` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pieces = cut(value, limit, overlap)
                rows += [(k, i, len(pieces), s, n, e, b, value[s:e]) for i, (s, n, e, b) in enumerate(pieces)]
                if len(rows) > 2000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    long = df.where(F.char_length(text) > limit).select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    out = long.mapInArrow(run, SCHEMA)
    return out.withColumnRenamed("key", key)


_TYPES = [("key", pa.int64()), ("piece_no", pa.int32()), ("n_pieces", pa.int32()), ("start", pa.int32()), ("new_from", pa.int32()), ("end", pa.int32()), ("boundary", pa.string()), ("text", pa.string())]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_TYPES)
    return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(columns, _TYPES)], names=[n for n, _ in _TYPES])
