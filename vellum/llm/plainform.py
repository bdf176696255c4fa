"""One consistent character form (problem 4).

A mapping from character clusters to plain text is computed from the Unicode
tables: widths and compatibility forms, radicals, separate accents, invisible
characters, spaces, and look-alike letters inside Latin words. Single
characters, pairs of a letter and an accent, and look-alikes are finished
tables, checked against each other for conflicts and compiled into a transducer
that rewrites a string in one pass: at each place the longest of the clusters
that begin there (word, emoji sequence, letter with accents, single) is taken.
Strings without a trigger character, nearly all of them, are recognised in
Arrow's C++ and never reach Python.

Results: null stays null, an empty string stays empty, line breaks, usual
Chinese punctuation, emoji sequences and words wholly in another alphabet stay
as they are. A letter of any other alphabet inside a Latin word makes a value
odd; it is replaced where a Latin letter looks like it, and stays where none
does. The form is idempotent. Length is not limited.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Punctuation that counts as plain although it has a compatibility form.
KEPT = "，：；！？（）～…"
#: Radicals of the supplement block that have no compatibility mapping, and the usual character for each.
RADICALS = {
    "⺁": "厂", "⺄": "乙", "⺈": "刀", "⺊": "卜", "⺌": "小", "⺍": "小", "⺕": "彐", "⺗": "心", "⺘": "手", "⺙": "攵", "⺜": "日", "⺝": "月", "⺠": "民", "⺡": "水", "⺣": "火",
    "⺤": "爪", "⺥": "爪", "⺦": "丬", "⺨": "犬", "⺩": "王", "⺫": "目", "⺬": "示", "⺭": "示", "⺮": "竹", "⺰": "纟", "⺱": "网", "⺲": "网", "⺶": "羊", "⺷": "羊", "⺸": "羊", "⺹": "老",
    "⺺": "聿", "⺻": "聿", "⺼": "肉", "⺽": "臼", "⺾": "艹", "⺿": "艹", "⻀": "艹", "⻁": "虎", "⻂": "衤", "⻃": "覀", "⻄": "西", "⻅": "见", "⻆": "角", "⻈": "讠", "⻉": "贝", "⻊": "足",
    "⻋": "车", "⻌": "辶", "⻍": "辶", "⻎": "辶", "⻏": "阝", "⻐": "钅", "⻑": "長", "⻒": "镸", "⻓": "长", "⻔": "门", "⻖": "阝", "⻗": "雨", "⻘": "青", "⻙": "韦", "⻚": "页", "⻛": "风",
    "⻜": "飞", "⻝": "食", "⻟": "飠", "⻠": "饣", "⻢": "马", "⻣": "骨", "⻤": "鬼", "⻥": "鱼", "⻦": "鸟", "⻧": "卤", "⻨": "麦", "⻩": "黄", "⻪": "黾", "⻬": "齐", "⻮": "齿", "⻯": "竜",
    "⻰": "龙", "⻱": "龜", "⻲": "亀", "⻳": "龟",
}
#: Letters of other alphabets that look like a Latin letter, by script.
LOOKALIKES = {
    "Cyrillic": ("АВЕЅІЈКМНОРСТУХҮԚԜаеѕіјорсухԁһԛԝвкмнтгѴѵүԌӀӏ", "ABESIJKMHOPCTYXYQWaesijopcyxdhqwBKMHTrVvyGIl"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανικρυχγωτσηϳͿ", "ABEZHIKMNOPTYXoavikpuxywtonjJ"),
    "Armenian": ("օհոսյցզլՕՏՍԼ", "ohnujgqlOSUL"),
    "Cherokee": ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃᎽᎥᏂᏏ", "ABCDEGHJKLMPRSTVWZYihb"),
    "Coptic": ("ⲀⲂⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲌⲟⲣⲥ", "ABHIKMNOPCTYXZopc"),
    "Lisu": ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
    "Deseret": ("𐐄𐐕𐐛𐐬𐐽", "OCLoc"),
    "Tifinagh": ("ⴹⵔⵝ", "EOX"),
    "Hebrew, Arabic, Myanmar, Malayalam, Oriya": ("סהاဝഠଠ", "oolooO"),
}
#: Blocks that hold compatibility characters.
_BLOCKS = [(0xA0, 0x33FF), (0xA640, 0xABFF), (0xF900, 0xFFFF), (0x1D400, 0x1D7FF), (0x1EE00, 0x1EEFF), (0x1F100, 0x1F2FF), (0x1FBF0, 0x1FBFF), (0x2F800, 0x2FA1F)]
_INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f"
_MARKS = "\u0300-\u034e\u0350-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\u3099\u309a\ufe20-\ufe2f\uff9e\uff9f"
_EMOJI = "\u203c\u2049\u2122\u2139\u2190-\u21ff\u2300-\u23ff\u24c2\u25aa-\u25fe\u2600-\u27bf\u2900-\u297f\u2b00-\u2bff\u3030\u303d\u3297\u3299\U0001f000-\U0001faff"
#: First words of the names of letters that do not count as another alphabet beside Latin letters.
_NOT_OTHER = {"LATIN", "CJK", "HIRAGANA", "KATAKANA", "HANGUL", "BOPOMOFO", "IDEOGRAPHIC", "MODIFIER", "FEMININE", "MASCULINE", "YI", "TANGUT", "NUSHU", "KHITAN"}
_LATIN = "A-Za-z\u00aa\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u1e00-\u1eff"


def _ranges(chars: list[str]) -> str:
    codes, out, start = sorted(map(ord, chars)), [], None
    for a, b in zip(codes, [*codes[1:], -1]):
        start = a if start is None else start
        if b != a + 1:
            out.append(f"\\U{start:08x}-\\U{a:08x}" if a > start else f"\\U{a:08x}")
            start = None
    return "".join(out)


def _singles() -> dict[str, str]:
    """Plain text of every character that is not plain alone."""
    table = dict(RADICALS)
    for low, high in _BLOCKS:
        for code in range(low, high + 1):
            c = chr(code)
            if c in KEPT or c in table or re.match(f"[{_INVISIBLE}{_MARKS}]", c):
                continue
            if unicodedata.category(c) == "Zs":
                table[c] = " "
            elif (plain := unicodedata.normalize("NFKC", c)) != c and not plain.startswith(" "):
                table[c] = plain
    return table


def _others(table: dict[str, str]) -> str:
    """Letters of all other alphabets, as the inside of a character class."""
    letters = (chr(c) for c in [*range(0x370, 0x3400), *range(0xA4D0, 0xAC00), *range(0xFB00, 0xFE00), *range(0x10000, 0x17000)])
    return _ranges([c for c in letters if unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lo") and c not in table and unicodedata.name(c, "LATIN").split()[0] not in _NOT_OTHER])


def _pairs(table: dict[str, str]) -> dict[tuple[str, str], str]:
    """(letter, mark) and the composed letter they make; letters that ``table`` replaces have none."""
    out = {}
    for code in [*range(0xC0, 0x3400), *range(0x11000, 0x12000)]:
        c = chr(code)
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and unicodedata.normalize("NFC", c) == c:
            out[unicodedata.normalize("NFC", parts[:-1]), parts[-1]] = c
    return {pair: c for pair, c in out.items() if len(pair[0]) == 1 and pair[0] not in table and c not in table}


def _re2(pattern: str) -> str:
    """A pattern of Python in RE2's notation."""
    pattern = re.sub(r"\\U([0-9a-f]{8})", r"\\x{\1}", pattern)
    return "".join(f"\\x{{{ord(c):x}}}" if ord(c) < 32 or 127 <= ord(c) < 160 else c for c in pattern)


class Transducer:
    """Longest-match rewriting of clusters; built once per process."""

    def __init__(self) -> None:
        self.table = _singles() | {"\u2011": "-"}
        self.table |= {c: "\u3099" if c == "\uff9e" else "\u309a" for c in "\uff9e\uff9f"}  # voicing marks as accents
        self.pairs = _pairs(self.table)
        alike = {c: latin for letters, plain in LOOKALIKES.values() for c, latin in zip(letters, plain, strict=True)}
        self._check(alike)
        self.order = {c: n for code in [*range(0x300, 0x3100), *range(0xFE20, 0xFE30)] if (n := unicodedata.combining(c := chr(code))) and re.match(f"[{_MARKS}]", c)}
        other = _others(self.table)
        #: Look-alikes with an accent: the accent moves to the Latin letter.
        self.alike = alike | {c: self.pairs[alike[a], b] for (a, b), c in self.pairs.items() if a in alike and (alike[a], b) in self.pairs}
        # compatibility forms of letters stand in words as these letters do
        wide = _ranges([c for c, plain in self.table.items() if re.search(f"[{_LATIN}]", plain)])
        via = _ranges([c for c, plain in self.table.items() if re.search(f"[{other}]", plain)])
        marks = [c for c in self.table if c in "\uff9e\uff9f"]
        singles = _ranges([c for c in self.table if c not in marks])
        emoji = f"[0-9#*]\ufe0f?\u20e3|[{_EMOJI}][\ufe0f\U0001f3fb-\U0001f3ff]?(?:\u200d[{_EMOJI}][\ufe0f\U0001f3fb-\U0001f3ff]?)*[\U000e0020-\U000e007f]*"
        emoji = f"(?:[\U0001f1e6-\U0001f1ff]{{2}})|(?:{emoji})(?<=[\ufe0f\u200d\u20e3{_EMOJI}\U0001f3fb-\U0001f3ff\U000e007f])"
        cluster, single = f".?(?:[{_INVISIBLE}]*[{_MARKS}])+", f"[{singles}]|[{_INVISIBLE}]+"
        word = f"[{_LATIN}{other}{wide}{via}](?:[{_INVISIBLE}]*[{_LATIN}{other}{wide}{via}{_MARKS}])+"
        kinds = [(word, self._word), (emoji, str), (cluster, self._cluster), (single, self._single)]
        self._kinds = [(re.compile(p, re.S).match, rewrite) for p, rewrite in kinds]
        self._places = re.compile("|".join(f"(?:{p})" for p, _ in kinds[1:]), re.S).search
        self._places_or_words = re.compile("|".join(f"(?:{p})" for p, _ in kinds), re.S).search
        self._words = re.compile(word, re.S).finditer
        self._has_other, self._may_mix = re.compile(f"[{other}]"), re.compile(f"[{other}{via}]")
        self._has_latin = re.compile(f"[{_LATIN}]")
        self._drop = re.compile(f"[{_INVISIBLE}]+")
        self._left = re.compile("[\u0300-\u036f]")  # accents that no letter takes up
        #: For RE2: what may make a string other than plain. Words wholly in another alphabet do not.
        latin, gap = f"[{_LATIN}{wide}]", f"[{_INVISIBLE}{_MARKS}]*"
        self.trigger = _re2(f"[{singles}{_INVISIBLE}{_MARKS}]|{latin}{gap}[{other}]|[{other}]{gap}{latin}")

    def _check(self, alike: dict[str, str]) -> None:
        """Every target must be plain, no kept character mapped, no cluster ambiguous."""
        for c, plain in self.table.items():
            if c in KEPT or any(x in self.table for x in plain):
                raise ValueError(f"conflicting mapping of U+{ord(c):04X}")
        for (letter, mark), c in self.pairs.items():
            if c in self.table or letter in self.table or mark in self.table:
                raise ValueError(f"conflicting mapping of U+{ord(letter):04X} U+{ord(mark):04X}")
        if set(alike) & set(self.table) or not all(x.isascii() for x in alike.values()):
            raise ValueError("conflicting look-alikes")

    def _composed(self, text: str) -> str:
        """``text`` with marks in canonical order and taken up by their letters."""
        out: list[str] = []
        base, last = -1, 0
        marks: list[str] = []

        def close() -> None:
            nonlocal base, last
            for m in sorted(marks, key=lambda c: self.order.get(c, 0)):
                n = self.order.get(m, 0)
                whole = self.pairs.get((out[base], m)) if base >= 0 and (n > last or len(out) - 1 == base) else None
                if whole is None:
                    out.append(m)
                    last = n
                else:
                    out[base] = whole
            marks.clear()

        for c in text:
            if c in self.order:
                marks.append(c)
            else:
                close()
                out.append(c)
                base, last = len(out) - 1, 0
        close()
        return "".join(out)

    def _single(self, text: str) -> str:
        return self.table.get(text, "")

    def _cluster(self, text: str) -> str:
        return self._composed("".join(self.table.get(c, c) for c in self._drop.sub("", text)))

    def _word(self, text: str) -> str:
        out = self._cluster(text)
        if self._has_other.search(out) and self._has_latin.search(out):
            out = self._composed("".join(self.alike.get(c, c) for c in out))
        return out

    def plain(self, text: str) -> str:
        """``text`` in plain form."""
        words = self._may_mix.search(text) is not None
        find, kinds = (self._places_or_words, self._kinds) if words else (self._places, self._kinds[1:])
        out, at = [], 0
        while (m := find(text, at)) is not None:
            start, end, rewrite = m.start(), -1, str
            for match, use in kinds:
                if (found := match(text, start)) and found.end() > end:
                    end, rewrite = found.end(), use
            out += (text[at:start], rewrite(text[start:end]))
            at = end
        return "".join(out) + text[at:] if out else text

    def mixed(self, text: str) -> bool:
        """Whether a Latin word keeps a letter of another alphabet after mapping (no look-alike known)."""
        return any(self._has_other.search(m.group()) and self._has_latin.search(m.group()) for m in self._words(text))

    def array(self, values: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Plain form of a string array, and for each value whether it was not plain."""
        values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
        odd = np.zeros(len(values), bool)
        hits = np.flatnonzero(pc.fill_null(pc.match_substring_regex(values, self.trigger), False).to_numpy(zero_copy_only=False))
        if not len(hits):
            return values, odd
        before = values.take(pa.array(hits)).to_pylist()
        after = [self.plain(x) for x in before]
        odd[hits] = [a != b or self.mixed(b) or self._left.search(b) is not None for a, b in zip(before, after)]
        mask = np.zeros(len(values), bool)
        mask[hits] = True
        return pc.replace_with_mask(values, pa.array(mask), pa.array(after, values.type)), odd


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    return Transducer()


def plain(text: str | None) -> str | None:
    """Plain form of one string."""
    return None if text is None else transducer().plain(text)


def _leaves(array: pa.Array, odd: np.ndarray, rows: np.ndarray) -> pa.Array:
    """``array`` with every string leaf in plain form; marks in ``odd`` the rows that hold one that was not."""
    kind = array.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        out, marks = transducer().array(array)
        odd[rows[marks]] = True
        return out
    if pa.types.is_list(kind):
        array = pa.concat_arrays([array])  # offsets from 0
        values = array.flatten()
        sizes = pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False)
        ends = np.r_[0, np.cumsum(sizes)].astype(np.int32)
        mask = pc.is_null(array)
        return pa.ListArray.from_arrays(pa.array(ends), _leaves(values, odd, np.repeat(rows, sizes)), type=pa.list_(kind.value_field), mask=mask)
    if pa.types.is_struct(kind):
        children = [_leaves(pc.struct_field(array, [i]), odd, rows) for i in range(kind.num_fields)]
        return pa.StructArray.from_arrays(children, fields=list(kind), mask=pc.is_null(array))
    return array


def _is_text(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _is_text(kind.elementType)
    return any(_is_text(f.dataType) for f in kind.fields) if isinstance(kind, T.StructType) else isinstance(kind, T.StringType)


def plain_form(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``key``, each of ``fields`` in plain form, and ``odd``: which fields were not (array of names).

    Fields may be strings or arrays and structs of strings in any depth; shape,
    nulls and order are kept. Rows with a null key, repeated rows and clashing
    names of other columns are no trouble: only the named columns are read.
    """
    picked = df.select(F.col(key), *[F.col(f) for f in fields])
    if missing := [f for f in fields if not _is_text(picked.schema[f].dataType)]:
        raise TypeError(f"no strings in {missing}")
    schema = T.StructType([picked.schema[key], *[picked.schema[f] for f in fields], T.StructField("odd", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, marks = [batch.column(0)], []
            for i in range(1, batch.num_columns):
                odd = np.zeros(batch.num_rows, bool)
                columns.append(_leaves(batch.column(i), odd, np.arange(batch.num_rows)))
                marks.append(odd)
            names = pa.array([[f for f, m in zip(fields, row) if m] for row in zip(*marks)] if marks else [[]] * batch.num_rows, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*columns, names], names=[key, *fields, "odd"])

    return picked.mapInArrow(run, schema)


def odd_values(df: DataFrame, key: str, fields: list[str], table_name: str) -> DataFrame:
    """(table_name, row_key, field) of the values that hold a character that is not plain."""
    found = plain_form(df, key, fields).select(F.col(key).alias("row_key"), F.explode("odd").alias("field"))
    return found.select(F.lit(table_name).alias("table_name"), "row_key", "field")


def plain_column(column: Column) -> Column:
    """Plain form of a string column as a scalar Arrow function."""

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return transducer().array(values)[0]

    return run(column)
