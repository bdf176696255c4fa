"""Values cut off by field limits or in transfer (problem 3).

Values are read by a stack automaton over reasoning tags, markup, code fences,
brackets, quotes of either script and escapes: an answer is whole when its
payload has closed everything it opened, even if something inside is malformed.
Broken multibyte sequences, escapes and entities at the end, and marks that
writers put where they cut, are signs by themselves. Plain words that end without
a terminator are judged by their source: where nearly all plain answers of a
source have one (``BASELINE``), a missing one means a cut.

Previews are whole when they are the sample's text or end with one of its
sentences; what ends without a terminator is compared with the sample it was
taken from, and judged by the automaton where the sample is unknown.

Results: null is no case, nor is an empty or blank value. Repeated rows count
each. Sources are grouped as they are, null among them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.plans.staging import stage

#: What a writer appends where it cut: a remark, or dots after plain words.
MARKS = re.compile(r"(?:\[文本已截断\]|[\[(<](?:truncated|cut|\.\.\.|…)[\])>])$", re.I)
DOTS = re.compile(r"(?:(?<!…)…|(?<!\.)\.\.\.)$")
#: Largest share of plain answers without a terminator at which one of them counts as cut, and the least number to tell from.
BASELINE, ENOUGH = 0.05, 20
WHOLE, CUT, BARE, ENDED = range(4)
_TOKEN = re.compile(r'```|<(/?)([A-Za-z][\w-]*)(?:\s[^<>]*)?(/?)>|"(?:[^"\\\n]|\\.)*"|[\[\]{}"（）()「」『』“”《》【】]', re.S)
_OPEN, _CLOSE = {"[": "]", "{": "}"}, {"]": "[", "}": "{"}
_PAIRS = {"）": "（", ")": "(", "」": "「", "』": "『", "”": "“", "》": "《", "】": "【"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "col", "wbr"}
_LEAD = re.compile(r"\s*(?:<thought>|分析[:：]|思考[:：]|reasoning[:：])", re.I)
_ASKS = re.compile(r"(?:[:：,，、;；]|```\w*|</?[a-zA-Z]*)\s*$")
_BROKEN = re.compile(r"(?:\ufffd|[\ud800-\udfff]|[\xc2-\xf4][\x80-\xbf]{0,2}|(?<!\\)(?:\\\\)*\\(?:u[0-9a-fA-F]{0,3})?|%[89A-F][0-9A-F]?%[0-9A-F]?|&(?:amp?|lt|gt|quo?t?|qu|nb|nbsp?|#x?[0-9a-fA-F]+))$")
_ENDED = re.compile(r"(?:[。！？!?；;]|……|[^.]\.)[”」』’）)】\"'\]]*$")


def state(text: str) -> int:
    """How a value ends: WHOLE with all it opened closed, CUT, or in plain words, BARE or ENDED by a terminator."""
    end = text.rstrip()
    if not end:
        return WHOLE
    tail = end[-64:]  # longer than any of the signs below
    if _BROKEN.search(tail) or MARKS.search(tail):
        return CUT
    stack: list[str] = []  # brackets of the payload
    words: list[str] = []  # tags, brackets and quotes of the words around it
    fenced = thinking = payload = whole = False
    for m in _TOKEN.finditer(end):
        token = m.group()
        if len(token) > 1 and token[0] == '"':
            continue
        tag = m.group(2).lower() if token[0] == "<" else ""
        if tag == "thought":
            thinking = not m.group(1)
        elif thinking:
            continue
        elif token == "```":
            fenced, payload, whole = not fenced, True, fenced
            stack.clear()
        elif tag:
            if stack or m.group(3) or tag in _VOID:
                continue
            if not m.group(1):
                words.append(tag)
            elif tag in words:
                while words.pop() != tag:
                    pass
        elif token in _OPEN:
            stack.append(token)
            payload = True
        elif token in _CLOSE:
            if _CLOSE[token] in stack:
                while stack.pop() != _CLOSE[token]:
                    pass
            if not stack:
                whole = not fenced
                words.clear()
        elif token == '"':
            if stack:
                return CUT  # a string that never ends
            words.append(token)
        elif stack:
            continue
        elif token in _PAIRS:
            if _PAIRS[token] in words:
                while words.pop() != _PAIRS[token]:
                    pass
        else:
            words.append(token)
    if thinking or fenced:
        return CUT
    if payload:
        return CUT if not whole or words and not stack else WHOLE
    if words or _LEAD.match(end) or _ASKS.search(tail) or DOTS.search(tail):
        return CUT
    return ENDED if _ENDED.search(tail) else BARE


def cut_answer(text: str, customary: bool = True) -> bool:
    """Whether a model's answer ends before its content does; ``customary``: plain answers of its source need no terminator."""
    how = state(text)
    return how == CUT or how == BARE and not customary


def _states(df: DataFrame) -> DataFrame:
    """(result_id, source, how) of the rows (result_id, source, v) that are not WHOLE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            how = np.fromiter(map(state, batch.column(2).to_pylist()), np.int8, batch.num_rows)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(how)], names=["result_id", "source", "how"]).filter(pa.array(how != WHOLE))

    return df.where("v is not null").mapInArrow(run, "result_id bigint, source string, how tinyint")


def _cut_answers(df: DataFrame, key: str, field: str, source: str) -> DataFrame:
    rows = stage(_states(df.select(F.col(key).cast("bigint").alias("result_id"), F.col(source).cast("string").alias("source"), F.col(field).alias("v"))), "answers")
    plain = rows.where(F.col("how").isin(BARE, ENDED)).groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("how") == BARE).alias("bare"))
    strict = plain.where((F.col("n") >= ENOUGH) & (F.col("bare") <= BASELINE * F.col("n"))).select("source")
    bare = rows.where(F.col("how") == BARE)
    missing = bare.join(strict, bare["source"].eqNullSafe(strict["source"]), "left_semi")
    return rows.where(F.col("how") == CUT).unionByName(missing).select("result_id")


@F.arrow_udf(T.ByteType())
def _state_of(values: pa.Array) -> pa.Array:
    return pa.array(np.fromiter((state(v or "") for v in values.to_pylist()), np.int8, len(values)))


_SENTENCE_END = r"[。！？!?][”」』’）)】\"]*\s*$"


def _cut_previews(df: DataFrame, samples: DataFrame, key: str, field: str, sample: str, sample_key: str, text: str) -> DataFrame:
    """Previews with an end that is none; only those without a clear sentence end meet their sample."""
    p, t = F.col("p"), F.col("t")
    doubt = (
        df.select(F.col(key).cast("bigint").alias("result_id"), F.col(sample).alias("s"), F.col(field).alias("p"))
        .where(p.isNotNull() & (F.length(F.regexp_replace(p, r"(?U)\s", "")) > 0) & ~p.rlike(_SENTENCE_END))
        .withColumn("how", _state_of(p))
    )
    texts = samples.where(F.col(text).isNotNull()).select(F.col(sample_key).alias("s"), F.col(text).alias("t"))
    following = F.expr("substring(t, char_length(p) + 1, 1)")
    starts = t.startswith(p)
    natural = (
        p.rlike(r"[\r\n]\s*$|……\s*$")
        | following.rlike(r"^[\r\n]$")
        | (p.endswith(".") & ~p.endswith("...") & ~following.rlike(r"^[0-9A-Za-z]$"))
        | (p.endswith("…") & starts)
    )
    fits = F.when(p == t, True).when(starts, natural).otherwise(False)
    alone = F.col("how").isin(WHOLE, ENDED)
    seen = doubt.join(texts, "s", "left").groupBy("result_id").agg(
        F.max(F.coalesce(fits, F.lit(False))).alias("fits"),
        F.max(F.coalesce(starts, F.lit(False))).alias("known"),
        F.max(alone).alias("alone"),
    )
    return seen.where(~F.col("fits") & ~(~F.col("known") & F.col("alone"))).select("result_id")


def cut_values(results: DataFrame, samples: DataFrame) -> DataFrame:
    """(result_id, field) of every raw_response and text_preview that was cut."""
    answers = _cut_answers(results, "result_id", "raw_response", "source").withColumn("field", F.lit("raw_response"))
    previews = _cut_previews(results, samples, "result_id", "text_preview", "sample_id", "id", "text").withColumn("field", F.lit("text_preview"))
    return answers.unionByName(previews)


def cut_rates(results: DataFrame, samples: DataFrame) -> DataFrame:
    """Values, cut values and their share per source and field, and how often whole values of the source lack a terminator."""
    fields = results.select("result_id", "source", F.explode(F.array(
        F.struct(F.lit("raw_response").alias("field"), F.col("raw_response").alias("v")),
        F.struct(F.lit("text_preview").alias("field"), F.col("text_preview").alias("v")))).alias("x"))
    values = fields.where(F.col("x.v").isNotNull()).select("result_id", "source", "x.field", F.when(F.col("x.v").rlike(r"[。！？.!?…\]}`）)]\s*$"), 0).otherwise(1).alias("bare"))
    cut = cut_values(results, samples).groupBy("result_id", "field").agg(F.lit(1).alias("cut"))
    joined = values.join(cut, ["result_id", "field"], "left")
    return joined.groupBy("source", "field").agg(
        F.count("*").alias("n_values"),
        F.sum(F.coalesce("cut", F.lit(0))).alias("n_cut"),
        F.avg(F.coalesce("cut", F.lit(0)).cast("double")).alias("cut_rate"),
        F.avg(F.when(F.col("cut").isNull(), F.col("bare").cast("double"))).alias("bare_rate"),
    )
