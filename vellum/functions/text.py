"""Text columns: normal forms, grounding, n-grams, similarity."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of Unicode, spelled out: engines disagree about ``\s``.
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Signs that grounding ignores.
GROUNDING_SIGNS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\.,，。；;、:：/\\()（）\[\]【】\"'“”‘’《》<>·\-—_]+"
#: Endings of company names. The leftmost match at the end of a name counts, so the longest ending wins whatever the order.
COMPANY_ENDINGS = ("股份有限公司", "控股股份有限公司", "有限责任公司", "有限公司", "集团股份有限公司", "集团有限公司", "集团", "公司", "银行", "证券", "科技")
#: Words that carry no topic.
STOPWORDS = ("公司", "公告", "称", "表示", "披露", "本次", "相关", "项目", "股份")


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def unspaced(c: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(c, f"{SPACE}+", "")


def normalize(c: Column) -> Column:
    """Evaluation form: no white space, four Chinese signs folded, lower case."""
    return F.lower(F.translate(unspaced(c), "（），。", "(),."))


def fold(c: Column) -> Column:
    """No white space, lower case; signs stay."""
    return F.lower(unspaced(c))


def grounding_form(c: Column) -> Column:
    """Lower case without white space and punctuation."""
    return F.regexp_replace(F.lower(strip(c)), GROUNDING_SIGNS, "")


def has_any(c: Column, cues: tuple[str, ...] | list[str]) -> Column:
    """Whether any cue stands in the text."""
    out = F.lit(False)
    for cue in cues:
        out = out | c.contains(cue)
    return out


def without_company_ending(c: Column) -> Column:
    return F.regexp_replace(c, f"({'|'.join(COMPANY_ENDINGS)})$", "")


def local_companies(c: Column) -> Column:
    """Company names of a text in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(rf"[\x{{4e00}}-\x{{9fa5}}A-Za-z0-9]{{2,40}}(?:{'|'.join(COMPANY_ENDINGS)})"), F.lit(0)))


def company_forms(text: Column) -> Column:
    """Company names of a text without punctuation and ending."""
    return F.transform(local_companies(text), lambda x: without_company_ending(grounding_form(x)))


def ground_status(argument: Column, text: Column, mode: str = "exact+fuzzy+code_local", long: Column | None = None, known: Column | None = None) -> Column:
    """How an argument is found in its text: exact, normalized_exact, shortname_or_code_local or ungrounded.

    ``long`` and ``known`` are the text's grounding form and company forms, if
    a column holds them already.
    """
    source = F.coalesce(text, F.lit(""))
    long = grounding_form(source) if long is None else long
    known = company_forms(source) if known is None else known

    def status(raw: Column) -> Column:
        short = grounding_form(raw)
        out = F.when((raw == "") | (source == ""), "ungrounded").when(source.contains(raw), "exact")
        if "fuzzy" in mode:
            out = out.when((short != "") & long.contains(short), "normalized_exact")
        if "code_local" in mode:
            name = without_company_ending(short)
            out = out.when((short != "") & (name != "") & F.array_contains(known, name), "shortname_or_code_local")
            out = out.when(short.rlike(r"^[a-z]*\d{4,8}$") & long.contains(short), "shortname_or_code_local")
        return out.otherwise("ungrounded")

    return bound(strip(F.coalesce(argument, F.lit(""))), status)


def retrieval_form(c: Column) -> Column:
    """Runs of Chinese characters, letters and digits, joined, in lower case."""
    return F.lower(F.array_join(F.regexp_extract_all(c, F.lit(r"[\x{4e00}-\x{9fff}A-Za-z0-9]+"), F.lit(0)), ""))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def char_ngrams(c: Column, n: int = 2) -> Column:
    """Distinct character n-grams of the retrieval form; a shorter text is its own only one, an empty one has none."""

    def grams(a: Column) -> Column:
        whole = F.transform(F.sequence(F.lit(1), F.greatest(F.size(a) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(a, i, n), ""))
        pairs = F.zip_with(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, F.lit(2), F.size(a)), lambda x, y: F.concat(x, y))
        many = F.array_distinct(pairs if n == 2 else whole)
        return F.when(F.size(a) == 0, F.array().cast("array<string>")).when(F.size(a) < n, F.array(F.array_join(a, ""))).otherwise(many)

    return bound(F.filter(F.split(retrieval_form(c), ""), lambda x: x != ""), grams)


def jaccard(a: Column, b: Column) -> Column:
    """Share of the union of two arrays of distinct values that both hold; 0 if either is empty."""
    both = bound(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n).cast("double"))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both).otherwise(F.lit(0.0))


def keywords(c: Column) -> Column:
    """Distinct runs of two or more characters that are no stopwords."""
    runs = F.array_distinct(F.regexp_extract_all(c, F.lit(r"[\x{4e00}-\x{9fff}A-Za-z0-9]{2,}"), F.lit(0)))
    return F.array_except(runs, F.array(*map(F.lit, STOPWORDS)))


def chars(c: Column) -> Column:
    """Distinct characters."""
    return F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))


def relaxed_match(p: Column, g: Column, threshold: float = 0.5) -> Column:
    """Equal, one inside the other, or enough characters in common; never for empty values."""
    a, b = normalize(p), normalize(g)
    overlap = jaccard(chars(a), chars(b)) >= threshold
    return F.when((a == "") | (b == ""), False).otherwise((a == b) | a.contains(b) | b.contains(a) | overlap)


@F.arrow_udf(T.DoubleType())
def span_overlap(p: pa.Array, g: pa.Array) -> pa.Array:
    """Longest common substring over the union of both lengths."""

    def ratio(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        if not x or not y:
            return 0.0
        a, b = (np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in (x, y))
        best, row = 0, np.zeros(len(b) + 1, np.int32)
        for c in a:
            row[1:] = np.where(b == c, row[:-1] + 1, 0)
            best = max(best, int(row.max()))
        return best / (len(a) + len(b) - best)

    return pa.array([ratio(x, y) for x, y in zip(p.to_pylist(), g.to_pylist())], pa.float64())


def thought_text(response: Column, require_block: bool = False) -> Column:
    """The reasoning of an answer: its thought block, else what stands before the JSON fence."""
    block = strip(F.regexp_extract(response, r"(?is)<thought>(.*?)</thought>", 1))
    if require_block:
        return F.when(response.rlike(r"(?is)<thought>.*?</thought>"), block)
    at = F.locate("```json", F.lower(response))
    return F.when(response.rlike(r"(?is)<thought>.*?</thought>"), block).when(at > 1, strip(F.substring(response, F.lit(1), at - 1)))


def truncated(c: Column, limit: int, mark: str) -> Column:
    """At most ``limit`` characters, with a mark where something was cut."""
    return F.when(F.char_length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(mark))).otherwise(c)


def focus_sentences(text: Column, cues: Column) -> Column:
    """Sentences with a cue; the whole text if it has one sentence, or none or all have a cue."""
    parts = F.filter(F.split(text, r"(?<=[。！？；;])|\n"), lambda s: strip(s) != "")
    hit = F.filter(parts, lambda s: F.exists(cues, lambda c: s.contains(c)))
    whole = (F.size(parts) <= 1) | (F.size(hit) == 0) | (F.size(hit) == F.size(parts))
    return F.when(whole, text).otherwise(F.array_join(hit, ""))
